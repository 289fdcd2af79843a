"""Benchmark decontamination by a prefix-filtered containment join over item-sized windows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import cut, shipped, slices, table, utf8

#: Words of a window; an item of fewer is one window.
WINDOW = 8
#: Windows that are broadcast at once (about 100 bytes each); a larger benchmark is joined in several rounds. So many rounds
#: follow one another within a stage, and are released after it.
MAX_WINDOWS, ROUNDS = 100_000, 10
#: Different words of a benchmark whose counts in the corpus order them, at most; the words of a larger one are ordered by its own counts.
VOCABULARY = 1_000_000
#: Documents that may be expected to hold the same items of under WINDOW words by chance, for such items to count as a leak.
CHANCE = 0.01
#: Every byte that is no word byte becomes a blank, A-Z becomes a-z; the rest, all of non-ASCII UTF-8 included, stays.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

NEW = ("n_words", "n_hit", "items")


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def windows_of(items: list[tuple[object, bytes]], width: int = WINDOW) -> list[tuple[str, tuple[bytes, ...]]]:
    """(item id as text, words) of each window; items without words have none."""
    out = []
    for item, text in items:
        w = words(text)
        out += [(str(item), tuple(w[i : i + width])) for i in range(max(1, len(w) - width + 1))] if w else []
    return out


class Index:
    """Windows by their rarest word, the one prefix token that any text containing the window must have."""

    def __init__(self, windows: list[tuple[str, tuple[bytes, ...]]], counts: dict[bytes, int]):
        vocabulary = sorted({w for _, ws in windows for w in ws}, key=lambda w: (counts.get(w, 0), w))
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}  # rarest first, 0 is any other word
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, ws in windows:
            owners.setdefault(tuple(self.ids[w] for w in ws), set()).add(item)
        keys = sorted(owners)
        self.owners = [sorted(owners[k]) for k in keys]
        self.length = np.array([len(k) for k in keys], np.int64)
        self.width = int(self.length.max(initial=1))
        self.tokens = np.zeros((len(keys), self.width), np.int32)
        for i, k in enumerate(keys):
            self.tokens[i, : len(k)] = k
        self.at = np.array([int(np.argmin(k)) for k in keys], np.int64)
        rare = np.array([min(k) for k in keys], np.int64)
        self.order = np.argsort(rare, kind="stable")
        self.first = np.searchsorted(rare[self.order], np.arange(len(vocabulary) + 2))

    def find(self, ids: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of every window that occurs in the words; a document's words lie in starts..ends."""
        n = self.first[ids + 1] - self.first[ids]
        n[ids == 0] = 0
        if not n.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.repeat(np.arange(len(ids)), n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        window = self.order[self.first[ids[at]] + within]
        start = at - self.at[window]
        fits = (start >= starts[doc[at]]) & (start + self.length[window] <= ends[doc[at]])  # positional and length bounds
        start, window = start[fits], window[fits]
        for k in range(self.width):
            inside = self.length[window] > k
            same = ~inside | (ids[np.minimum(start + k, len(ids) - 1)] == self.tokens[window, k])
            start, window = start[same], window[same]
        return start, window


def scan(batches: Iterator[pa.RecordBatch], index: Index, more: bool) -> Iterator[pa.RecordBatch]:
    """Adds what ``index`` finds to what earlier rounds have; the text and the hit spans stay if ``more`` rounds follow."""
    get = index.ids.get
    for batch in slices(batches, "_text"):
        names = batch.schema.names
        split = [words(t) for t in batch.column("_text").to_pylist()]
        n = np.array([len(w) for w in split], np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        ids = np.fromiter((get(w, 0) for ws in split for w in ws), np.int64, int(n.sum()))
        start, window = index.find(ids, np.repeat(np.arange(len(n)), n), starts, ends)
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + index.length[window], -1)
        items: list[set[str]] = [set() for _ in split]
        if "_hits" in names:
            items = [set(x) for x in batch.column("items").to_pylist()]
            for d, spans in enumerate(batch.column("_hits").to_pylist()):
                before = np.frombuffer(spans, np.int64).reshape(-1, 2) + starts[d]
                np.add.at(cover, before[:, 0], 1)
                np.add.at(cover, before[:, 1], -1)
        hit = np.cumsum(cover)[:-1] > 0
        doc = np.searchsorted(ends, start, side="right")
        for d, w in {*zip(doc.tolist(), window.tolist(), strict=True)}:
            items[d].update(index.owners[w])
        new = {"items": pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
        if more:
            edge = [np.diff(np.concatenate(([0], hit[s:e].view(np.int8), [0]))) for s, e in zip(starts, ends, strict=True)]
            new |= {"_text": batch.column("_text"), "_hits": pa.array([np.stack((np.flatnonzero(x == 1), np.flatnonzero(x == -1)), 1).astype(np.int64).tobytes() for x in edge], pa.binary())}
        else:
            total = np.concatenate(([0], np.cumsum(hit)))
            new |= {"n_words": pa.array(n), "n_hit": pa.array(total[ends] - total[starts])}
        held = [c for c in names if c not in ("_text", "_hits", "items")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), *new.values()], [*held, *new])


def vocabulary_counts(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often these words occur in all documents; one row for each of them at most reaches the driver."""
    names = sorted(vocabulary)
    held = shipped(docs.sparkSession, {w: i for i, w in enumerate(names)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = held()
        total = np.zeros(len(ids) + 1, np.int64)
        for batch in slices(batches, "_text"):
            for t in batch.column("_text").to_pylist():
                w = words(t)
                total += np.bincount(np.fromiter((ids.get(x, len(ids)) for x in w), np.int64, len(w)), minlength=len(total))
        at = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["w", "n"])

    rows = docs.select(utf8(text).alias("_text")).mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    return {names[w]: n for w, n in zip(rows["w"].to_pylist(), rows["n"].to_pylist(), strict=True)}


def word_totals(texts: DataFrame, text: str) -> DataFrame:
    """(word, n) over all rows, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            total: dict[bytes, int] = {}
            for t in batch.column("_text").to_pylist():
                for w in words(t):
                    total[w] = total.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return texts.select(utf8(text).alias("_text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """Columns ``keep`` of docs (all but the text if None), with n_words, n_hit and items (ids as sorted text) for each row.

    A word is hit if it lies inside any occurrence of a window of a benchmark item; items holds those with an occurring window.
    Null and empty texts have no words: 0, 0 and no items. Repeated rows give equal rows, repeated items count once by their id.
    An empty benchmark hits nothing. Columns of docs named like the new ones are replaced.
    The benchmark comes to the driver in item order, ``max_windows`` windows and an item at a time; each round's are broadcast,
    and the rounds follow one another over the same rows, ROUNDS of them within one stage. One pass counts the words of all.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*NEW, text, "_text", "_hits")]
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t"))
    totals = cut(word_totals(items, "t"))
    n = totals.count()
    counts = {bytes(r.word): r.n for r in totals.toLocalIterator()} if n <= VOCABULARY else None
    if counts:
        counts = vocabulary_counts(docs, text, set(counts))
    held = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema)
    found = docs.select(*keep, utf8(text).alias("_text"))
    done = 0

    def searched(windows: list[tuple[str, tuple[bytes, ...]]], more: bool) -> DataFrame:
        own = counts
        if own is None:
            own = {}
            for w in (w for _, ws in windows for w in ws):
                own[w] = own.get(w, 0) + 1
        index = shipped(spark, Index(windows, own))
        new = "items array<string>, " + ("_text binary, _hits binary" if more else "n_words long, n_hit long")
        return found.mapInArrow(lambda b: scan(b, index(), more), held + new)

    windows: list = []
    for row in items.orderBy("i").toLocalIterator():
        if len(windows) >= max_windows:
            found, windows, done = searched(windows, True), [], done + 1
            if done % ROUNDS == 0:
                found = cut(found)
        windows += windows_of([(row.i, bytes(row.t))])
    return searched(windows, False)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows that hold no window of WINDOW words of a benchmark item and no shorter items that tell, whole and unchanged.

    Shorter items tell if documents would hold all those that this one holds by chance, were words dealt out by their
    frequencies in the corpus, fewer than CHANCE times; so a common word alone never does, and a whole question does.
    """
    folded = F.translate(F.coalesce(F.col("text"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.regexp_extract_all(folded, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    named = benchmark.select(F.when(F.size(own) < WINDOW, F.array_join(own, " ")).otherwise("").alias("item_id"), "text")  # short items by their words
    found = contaminated(docs.withColumn("_body", F.col(text)), named, text, keep=[*(c for c in docs.columns if c != text), "_body"])
    short = [r.item_id for r in named.where("item_id <> ''").distinct().collect()]
    rows = found.where(F.size("items") == 0)
    if short:
        split = {x: x.encode().split() for x in short}
        counts = vocabulary_counts(docs, text, {w for ws in split.values() for w in ws})
        total = max(1, found.agg(F.sum("n_words")).first()[0] or 0)
        chance = {x: sum(math.log(counts[w] / total) for w in ws) for x, ws in split.items() if all(w in counts for w in ws)}
        held = shipped(docs.sparkSession, chance)

        @F.arrow_udf("boolean")
        def leaks(items: pa.Array, n_words: pa.Array) -> pa.Array:
            out = []
            for own, n in zip(items.to_pylist(), n_words.to_pylist(), strict=True):
                expected = math.log(total / max(1, n)) + sum(min(0.0, math.log(max(1, n)) + held()[x]) for x in own if x)
                out.append("" in own or (bool(own) and expected < math.log(CHANCE)))
            return pa.array(out, pa.bool_())

        rows = found.where(~leaks("items", "n_words"))
    return rows.withColumnRenamed("_body", text).select(*docs.columns)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words that benchmark windows cover, and the items with such windows; contaminated from two items.

    Null and empty texts have no words and no items; repeated rows give equal rows; no documents give no rows, and an empty
    benchmark hits nothing.
    """
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))
