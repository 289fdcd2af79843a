"""Media columns of baseline JPEG: markers, Huffman scans in lock step, DC-only luminance thumbnails and their hashes."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm.common import slices, table, utf8

#: Samples in a row of blocks, and rows that one image has at most (65,528 lines); longer payloads take more images.
COLUMNS, ROWS = 64, 8191
#: Code lengths of the difference categories 0 to 8, and the canonical codes of them.
LENGTHS = {3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 0: 4, 2: 4, 1: 5, 8: 6}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, length) of each symbol, as a DHT segment implies them."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman_segment(kind: int, lengths: dict[int, int]) -> bytes:
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    return segment(0xC4, bytes([kind, *(sum(n == k for n in lengths.values()) for k in range(1, 17)), *symbols]))


CODES = canonical(LENGTHS)
CODE, CODE_LEN = (np.array([CODES[c][i] for c in range(9)], np.int64) for i in (0, 1))
TABLES = segment(0xDB, bytes([0, *[8] * 64])) + huffman_segment(0x00, LENGTHS) + huffman_segment(0x10, {0: 1}) + segment(0xDD, struct.pack(">H", COLUMNS))


def header(rows: int) -> bytes:
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + TABLES + segment(0xC0, struct.pack(">BHHB3B", 8, 8 * rows, 8 * COLUMNS, 1, 1, 0x11, 0)) + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def encode(payloads: list[bytes]) -> list[list[bytes]]:
    """Grey images of each payload, a multiple of 64 bytes: a flat 8 by 8 block for each byte, so that no byte is lost.

    Each row of 64 blocks is a restart interval; an image holds up to 524,224 bytes.
    """
    if not payloads:
        return []
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, COLUMNS).astype(np.int64) - 128
    diff = np.diff(data, axis=1, prepend=0)
    size = np.abs(diff)
    cat = np.zeros(diff.shape, np.int64)
    for k in range(8):
        cat += size >= 1 << k
    bits = (((CODE[cat] << cat) | np.where(diff >= 0, diff, diff + (1 << cat) - 1)) << 1).ravel()  # with the end of the block
    n = CODE_LEN[cat] + cat + 1
    used = n.sum(axis=1)
    nbytes = (used + 7) // 8
    first = np.cumsum(nbytes) - nbytes  # of each row in the packed bytes
    at = (8 * first[:, None] + np.cumsum(n, axis=1) - n).ravel()
    word = bits << (24 - (at & 7) - n.ravel())
    total = int(nbytes.sum())
    byte = at >> 3
    packed = np.bincount(byte, word >> 16, total + 2) + np.bincount(byte + 1, (word >> 8) & 255, total + 2) + np.bincount(byte + 2, word & 255, total + 2)
    packed = packed[:total].astype(np.int64)
    packed[first + nbytes - 1] |= (1 << (8 * nbytes - used)) - 1  # ones up to the byte's end
    packed = packed.astype(np.uint8)
    # Room for the zero after each 0xFF and for the two bytes of the marker after each row.
    end = first + nbytes - 1
    room = 1 + (packed == 255).astype(np.int64)
    room[end] += 2
    place = np.cumsum(room) - room
    out = np.zeros(int(room.sum()), np.uint8)
    out[place] = packed
    after = place[end] + room[end]
    rows_of = [len(p) // COLUMNS for p in payloads]
    images, row = [], 0
    spans = []
    for k in rows_of:
        own = [(r, min(r + ROWS, row + k)) for r in range(row, row + k, ROWS)]
        spans.append(own)
        row += k
    number = np.concatenate([np.arange(b - a) for own in spans for a, b in own])
    out[after - 2] = 0xFF
    out[after - 1] = 0xD0 + number % 8
    raw = out.tobytes()
    starts = np.concatenate(([0], after))
    for own in spans:
        images.append([header(b - a) + raw[starts[a] : after[b - 1] - 2] + b"\xff\xd9" for a, b in own])
    return images


@dataclass
class Image:
    """What the markers of a baseline JPEG say."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quant: dict[int, int] = field(default_factory=dict)  # of the DC coefficients
    huffman: dict[int, tuple] = field(default_factory=dict)
    interval: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component id, DC table, AC table
    data: bytes = b""


def parse(image: bytes) -> Image:
    """Reads the markers up to the scan; raises ValueError for what isn't one baseline scan of all components."""
    out, at = Image(), 2
    if image[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while at + 4 <= len(image):
        if image[at] != 0xFF:
            raise ValueError("a marker is missing")
        if image[at + 1] == 0xFF:
            at += 1
            continue
        marker, size = image[at + 1], int.from_bytes(image[at + 2 : at + 4], "big")
        body, at = image[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                out.quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                symbols = body[17 : 17 + sum(counts)]
                out.huffman[body[0]] = tuple(zip([k + 1 for k, n in enumerate(counts) for _ in range(n)], symbols, strict=True))
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            _, out.height, out.width, n = struct.unpack(">BHHB", body[:6])
            out.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDD:
            out.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            if body[0] != len(out.components) or not out.components:
                raise ValueError("the scan doesn't hold all components")
            out.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            end = image.rfind(b"\xff\xd9", at)
            out.data = image[at : end if end >= 0 else len(image)]
            return out
    raise ValueError("no scan")


class Lookup:
    """What each 16 bits begin with: for single codes, and for a whole block without AC coefficients."""

    def __init__(self, dc: tuple, ac: tuple):
        self.dc, self.ac = self.single(dc), self.single(ac)
        peek = np.arange(65536)
        length, cat = self.dc >> 8, self.dc & 255
        used = length + cat
        fits = (length > 0) & (used <= 15) & (cat < 16)
        extra = np.where(fits, (peek >> np.maximum(16 - used, 0)) & ((1 << np.minimum(cat, 15)) - 1), 0)
        self.diff = np.where((cat > 0) & (extra < 1 << np.maximum(cat - 1, 0)), extra - (1 << np.minimum(cat, 15)) + 1, extra).astype(np.int32)
        rest = (peek << np.minimum(used, 16)) & 0xFFFF
        eob = self.ac[rest]
        whole = fits & (eob >> 8 > 0) & (eob & 255 == 0) & (used + (eob >> 8) <= 16)
        self.bits = np.where(whole, used + (eob >> 8), 0).astype(np.int32)  # 0: not such a block, or longer

    @staticmethod
    def single(codes: tuple) -> np.ndarray:
        out, code, last = np.zeros(65536, np.int64), 0, 0
        for n, symbol in codes:
            code <<= n - last
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
            code, last = code + 1, n
        return out

    def slow(self, peek, p: int) -> tuple[int, int]:
        """(difference, next bit) of the block at bit ``p``, whatever coefficients follow; peek(p): 16 bits from there."""

        def bits(p: int, n: int) -> int:
            return peek(p) >> (16 - n) if n else 0

        found = int(self.dc[peek(p)])
        if not found:
            raise ValueError("a Huffman code is unknown")
        p += found >> 8
        cat = found & 255
        v = bits(p, cat)
        diff = v - (1 << cat) + 1 if cat and v < 1 << (cat - 1) else v
        p, k = p + cat, 1
        while k < 64:
            found = int(self.ac[peek(p)])
            if not found:
                raise ValueError("a Huffman code is unknown")
            p += found >> 8
            run, size = (found & 255) >> 4, found & 15
            if not size and run < 15:
                break
            k += run + 1
            p += size
        return diff, p


def thumbnails(images: list[bytes]) -> list[np.ndarray]:
    """Each image's luminance from its DC coefficients alone, a sample for each 8 by 8 block of it."""
    parsed = [parse(x) for x in images]
    alike = defaultdict(list)
    for i, x in enumerate(parsed):
        alike[tuple(x.components), tuple(sorted(x.huffman.items())), tuple(x.scan)].append(i)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(images)
    for (components, huffman, scan), members in alike.items():
        tables = dict(huffman)
        lookups = [Lookup(tables[d], tables[16 + a]) for _, d, a in scan]
        sampling = {c: (h, v) for c, h, v, _ in components}
        single = len(scan) == 1
        order = [0] if single else [k for k, (c, _, _) in enumerate(scan) for _ in range(sampling[c][0] * sampling[c][1])]
        hmax, vmax = (1, 1) if single else (max(h for h, _ in sampling.values()), max(v for _, v in sampling.values()))
        grid = [(-(-parsed[i].width // (8 * hmax)), -(-parsed[i].height // (8 * vmax))) for i in members]
        # The intervals of all images, one after another, without stuffing and markers.
        raw = np.frombuffer(b"\0".join([parsed[i].data for i in members]) + b"\0" * 8, np.uint8)
        image_at = np.cumsum([0, *(len(parsed[i].data) + 1 for i in members[:-1])])
        ff = np.concatenate((raw[:-1] == 255, [False]))
        following = np.concatenate((raw[1:], [0]))
        reset = ff & (following >= 0xD0) & (following <= 0xD7)
        drop = reset | (ff & (following == 255))
        drop[1:] |= (ff & ((following == 0) | reset))[:-1]
        kept = ~drop
        shift = np.cumsum(kept) - kept
        begins = np.sort(np.concatenate((image_at, np.flatnonzero(reset) + 2)))
        start = shift[np.minimum(begins, len(shift) - 1)]
        data = raw[kept].astype(np.uint32)
        data = np.concatenate((data, np.zeros(8, np.uint32)))
        word = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        owner = np.searchsorted(image_at, begins, side="right") - 1
        nth = np.arange(len(begins)) - np.searchsorted(owner, owner)
        mcus = np.array([a * b for a, b in grid])
        interval = np.array([parsed[i].interval or m for i, m in zip(members, mcus, strict=True)])
        if (np.bincount(owner, minlength=len(members)) != -(-mcus // interval)).any():
            raise ValueError("restart intervals are missing")
        count = np.minimum(interval[owner], mcus[owner] - nth * interval[owner])
        bit = start.astype(np.int64) * 8
        base = np.concatenate(([0], np.cumsum(mcus)))[owner] + nth * interval[owner]
        luma = sum(k == 0 for k in order)
        dc = np.zeros((int(mcus.sum()), luma), np.int32)
        last = np.zeros((len(scan), len(begins)), np.int32)
        peek = lambda p: int(word[min(p >> 3, len(word) - 1)] >> (8 - (p & 7))) & 0xFFFF
        live = np.argsort(-count, kind="stable")
        sizes = count[live]
        for step in range(int(count.max(initial=0))):
            live = live[: int(np.searchsorted(-sizes, -step))]
            sizes = sizes[: len(live)]
            done = 0
            for k in order:
                p = bit[live]
                bits16 = (word[np.minimum(p >> 3, len(word) - 1)] >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF
                used, diff = lookups[k].bits[bits16], lookups[k].diff[bits16]
                for j in np.flatnonzero(used == 0):
                    diff[j], end = lookups[k].slow(peek, int(p[j]))
                    used[j] = end - p[j]
                bit[live] = p + used
                last[k, live] += diff
                if k == 0:
                    dc[base[live] + step, done] = last[0, live]
                    done += 1
        first = np.concatenate(([0], np.cumsum(mcus)))
        h, v = (1, 1) if single else sampling[scan[0][0]]
        for m, i in enumerate(members):
            x = parsed[i]
            q = x.quant[next(t for c, _, _, t in components if c == scan[0][0])]
            across, down = grid[m]
            blocks = dc[first[m] : first[m + 1]].reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            wide, high = -(-x.width * h // (8 * hmax)), -(-x.height * v // (8 * vmax))
            out[i] = np.clip((blocks[:high, :wide].astype(np.int64) * q + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return out


def average_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which of 8 by 8 cells of the thumbnail are brighter than their mean."""
    if not thumb.size:
        return "0" * 16
    y, x = (np.arange(9) * n // 8 for n in thumb.shape)
    total = np.pad(thumb.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    low = lambda e: (e[:-1], np.maximum(e[1:], e[:-1] + 1))
    (a, b), (c, d) = low(y), low(x)
    cell = (total[np.ix_(b, d)] - total[np.ix_(a, d)] - total[np.ix_(b, c)] + total[np.ix_(a, c)]) * 1000 // np.outer(b - a, d - c)
    return np.packbits(64 * cell.ravel() > cell.sum()).tobytes().hex()


def padded(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % 64 if text else 64)


def media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, payload_bytes and media (array of JPEG images) of each row's whole text; null is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", 1 << 20):
            texts = batch.column("_text").to_pylist()
            payloads = [padded(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(len, payloads)), pa.int64()), pa.array(encode(payloads), pa.list_(pa.binary()))], [key, "n_bytes", "payload_bytes", "media"])

    return docs.select(key, utf8(text).alias("_text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, media array<binary>")


def features(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the stored images of ``media`` say: digests of the payload that their thumbnails hold, sizes and thumbnail hashes.

    feature: ``WIDTHxHEIGHT:HASH`` of each image, joined by ``+``. Equal media give equal values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                media = part.column("media").to_pylist()
                flat = iter(thumbnails([x for images in media for x in images]))
                thumbs = [[next(flat) for _ in images] for images in media]
                payloads = [b"".join(t.tobytes() for t in ts) for ts in thumbs]
                columns = [
                    part.column(key),
                    part.column("n_bytes"),
                    pa.array(list(map(len, payloads)), pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                    pa.array([zlib.crc32(p[-64:]) for p in payloads], pa.int64()),
                    pa.array([sum(map(len, images)) for images in media], pa.int64()),
                    pa.array([hashlib.sha256(b"".join(images)).hexdigest() for images in media], pa.string()),
                    pa.array(["+".join(f"{8 * t.shape[1]}x{8 * t.shape[0]}:{average_hash(t)}" for t in ts) for ts in thumbs], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select(key, "n_bytes", "media").mapInArrow(run, f"{key} {stored.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as a baseline JPEG and what is read back from it. Null texts are empty, equal texts have equal values, and no documents give no rows."""
    return features(media(table(spark, sf_dir, "documents")))
