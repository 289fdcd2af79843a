"""Byte-level BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from strandloom.llm.common import shipped, slices, table, utf8

#: Letters and numbers of Unicode 16 that Python's tables (15.1) don't have, as (first, last).
LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Pieces whose ids a worker remembers; beyond that it starts anew.
CACHE = 100_000
#: Symbols that one call of the merge rounds takes together, unless a single piece has more.
ROUND_SYMBOLS = 1 << 20


def ranges(kind: str, more: tuple) -> str:
    """A character class body of the code points whose category begins with ``kind``."""
    out, start = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append((start, c - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*out, *more])


def split_pattern(letter: str, number: str) -> str:
    """The public byte-level split: contractions, words, numbers, other runs, white space."""
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}


class Bpe:
    """A vocabulary file's merges as sorted pair keys, with its decoder."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.first = np.array([vocab[symbols[b]] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.letters, self.numbers = ranges("L", LETTERS_16), ranges("N", NUMBERS_16)
        self.compiled = None

    def patterns(self) -> tuple:
        if self.compiled is None:
            fast = regex.compile(split_pattern(r"\p{L}", r"\p{N}"))
            exact = regex.compile(split_pattern(self.letters, self.numbers))
            added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
            self.compiled = fast, exact, added
        return self.compiled

    def __getstate__(self) -> dict:
        return self.__dict__ | {"compiled": None}

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without added tokens."""
        fast, exact, _ = self.patterns()
        try:
            text.encode("latin-1")  # up to U+00FF all versions of Unicode agree
            return fast.findall(text)
        except UnicodeEncodeError:
            return exact.findall(text)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, by binary search over the sorted pair keys; the number of merges if it has none."""
        if not len(self.keys):
            return np.full(len(left), len(self.rank), np.int32)
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], np.int32(len(self.rank)))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as in encode(): in every round each word merges all pairs of its lowest rank, left to right."""
        if not words:
            return []
        size = np.array([len(w) for w in words], np.int64)
        sym, word = self.first[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words), dtype=np.int32), size)
        none = np.int32(len(self.rank))
        rank = np.full(len(sym), none, np.int32)  # of the pair that begins at each symbol
        rank[:-1] = np.where(word[:-1] == word[1:], self.ranks(sym[:-1], sym[1:]), none)
        ended_sym, ended_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.concatenate((starts, [len(sym)]))))
            alive = low < none
            if not alive.all():
                ended_sym.append(sym[~alive])
                ended_word.append(word[~alive])
                sym, word, rank, low = sym[alive], word[alive], rank[alive], low[alive]
            mark = rank == low
            place = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(mark, -1, place)) + 1  # where the run of marks that a mark is in begins
            left = np.flatnonzero(mark & ((place - run) % 2 == 0))
            sym[left] = self.made[rank[left]]
            stay = np.ones(len(sym), bool)
            stay[left + 1] = False
            sym, word, rank, place = sym[stay], word[stay], rank[stay], np.cumsum(stay) - 1
            if not len(sym):
                break
            new = place[left]
            at = np.concatenate((new, new - 1))
            at = at[(at >= 0) & (at < len(sym) - 1)]
            rank[at] = np.where(word[at] == word[at + 1], self.ranks(sym[at], sym[at + 1]), none)
            if new[-1] == len(sym) - 1:
                rank[-1] = none
        sym, word = np.concatenate(ended_sym), np.concatenate(ended_word)
        flat = sym[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[str], cache: list[dict]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers. cache: two dictionaries, of recent pieces and older ones."""
        _, _, added = self.patterns()
        split = []
        for t in texts:
            if added is not None and added.search(t):
                split.append([p for part in added.split(t) if part for p in ([(part,)] if part in self.added else self.pieces(part))])
            else:
                split.append(self.pieces(t))
        if len(cache[0]) > CACHE:
            cache[:] = [{}, cache[0]]
        known, older = cache
        new = set().union(*split).difference(known)
        known.update({p: older[p] for p in new & older.keys()})
        chunk, total = [], 0
        for p in new.difference(older):
            if isinstance(p, tuple):
                known[p] = np.array([self.added[p[0]]], "<u4").tobytes()
                continue
            chunk.append(p)
            total += len(p)
            if total > ROUND_SYMBOLS:
                known.update(zip(chunk, self.merge([c.encode() for c in chunk]), strict=True))
                chunk, total = [], 0
        known.update(zip(chunk, self.merge([c.encode() for c in chunk]), strict=True))
        return [b"".join(map(known.__getitem__, ps)) for ps in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def load(path: str) -> Bpe:
    """Reads a tokenizer's JSON file on the driver; its size is that of the vocabulary, whatever the input."""
    with open(path, encoding="utf-8") as f:
        return Bpe(f.read())


def encode(docs: DataFrame, text: str = "text", path: str | None = None, ids: str = "ids") -> DataFrame:
    """Docs with a column ``ids`` (array<int>) that holds each whole text's token ids; one of that name is replaced.

    Null and empty texts have no ids. Strings of added tokens in a text become those tokens, as the file says.
    """
    bpe = shipped(docs.sparkSession, load(path or vocabulary_path()))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache: list[dict] = [{}, {}]
        for column in batches:
            got = [np.frombuffer(x, "<u4").astype(np.int32) for part in slices([pa.RecordBatch.from_arrays([column], ["t"])], "t") for x in bpe().encode([t.decode() for t in part.column(0).to_pylist()], cache)]
            yield pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(x) for x in got]))).astype(np.int32), np.concatenate([*got, np.zeros(0, np.int32)]))

    return docs.withColumn(ids, F.arrow_udf(run, "array<int>", ArrowUDFType.SCALAR_ITER)(utf8(text)))


def decode(tokens: DataFrame, ids: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """Tokens with a column ``text`` that ``ids`` stand for; null ids give a null text."""
    bpe = shipped(tokens.sparkSession, load(path or vocabulary_path()))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([None if x is None else bpe().decode(np.array(x, "<u4").tobytes()) for x in column.to_pylist()], pa.string())

    return tokens.withColumn(text, F.arrow_udf(run, "string", ArrowUDFType.SCALAR_ITER)(F.col(ids)))


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256 of each row: its text encoded, and those ids decoded again; also the ids if asked.

    Null and empty texts have no ids. Repeated rows give equal rows.
    """
    bpe = shipped(docs.sparkSession, load(path or vocabulary_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: list[dict] = [{}, {}]
        sha = hashlib.sha256
        for batch in slices(batches, "_text"):
            ids = bpe().encode([t.decode() for t in batch.column("_text").to_pylist()], cache)
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids], pa.string()), pa.array([sha(bpe().decode(x).encode()).hexdigest() for x in ids], pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(key, utf8(text).alias("_text")).mapInArrow(run, schema)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of tokens and the digests of its ids and of what they decode to. Null and empty texts have no ids; repeated rows give equal rows."""
    return round_trip(table(spark, sf_dir, "documents"))
