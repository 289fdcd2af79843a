"""Near-duplicates by SimHash: fingerprints, sharded BK-trees that link them, and groups."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import connected, cut, slices, stars, table, trim, utf8

SEED = 42
#: Shards of more rows are split: by a second key, and then by cells; nothing is dropped.
SHARD = 2048
#: Pairs of a row and a tree's node that are compared at once, about.
FRONTIER = 100_000
#: Hot shards whose list is broadcast, at most; a longer list is joined by a shuffle.
HOT = 100_000
#: Wide sketches: smallest shingle hashes that place a text into shards, those that split a large shard, counters and bits.
ANCHORS, SPLIT, COUNTERS, BITS = 8, 12, 4096, 1024
#: Sketches make candidates from this much under the asked similarity, 4.8 standard errors of the distance of texts of SHORT
#: shingles and more, so that they lose no more pairs than the anchors do.
TOLERANCE = 0.15
#: Texts of fewer shingles meet those as short, and what can be similar to them, without any loss: sketches can't tell so few.
SHORT = 64
#: Candidates' groups of more texts or bytes are compared in tiles; texts and bytes of a tile, about, and rows that are compared at once.
EXACT, TILE, TILE_BYTES = 1024, 512, 32 << 20
#: Rows that are broadcast to fetch candidates' texts, at most (about 50 bytes each); more are joined by a shuffle.
FETCH = 200_000


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; of the whole sequence if it has fewer; none without words."""
    ws = text.lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    digest = xxhash.xxh64_intdigest
    if len(ws) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(ws) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it's set in over half the hashes; zero if there are none."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)).tobytes(), "big")


def hamming(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of the rows of two arrays of uint64 words."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


class Trees:
    """The BK-trees of many shards in flat arrays: a node's children are keyed by their integer Hamming distance to it.

    Rows go in in their order, all trees a level at a time: the first row that comes to a free place becomes the node
    there, the others follow the edge of their distance to it. A row equal to a node is no node of its own: ``same`` links them.
    """

    def __init__(self, shard: np.ndarray, prints: np.ndarray):
        n = len(shard)
        self.prints, self.wide = prints, 64 * prints.shape[1] + 1
        self.visited = 0
        place = np.unique(shard, return_inverse=True)[1].astype(np.int64)
        left = np.argsort(place, kind="stable")
        group = place[left]
        first = np.concatenate(([True], group[1:] != group[:-1]))[: len(group)]
        self.root = np.zeros(n, np.int64)
        self.root[left] = np.repeat(left[first], np.diff(np.append(np.flatnonzero(first), n)))
        parent, key, same = np.full(n, -1), np.zeros(n, np.int64), np.full(n, -1)
        while len(left):
            head = np.concatenate(([True], group[1:] != group[:-1]))
            node = left[np.maximum.accumulate(np.where(head, np.arange(len(left)), 0))][~head]
            left = left[~head]
            d = hamming(prints[left], prints[node])
            same[left[d == 0]] = node[d == 0]
            left, node, d = left[d > 0], node[d > 0], d[d > 0]
            parent[left], key[left] = node, d
            group = node * self.wide + d
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
        self.same = np.flatnonzero(same >= 0), same[same >= 0]
        child = np.flatnonzero((parent >= 0) & (same < 0))
        edge = parent[child] * self.wide + key[child]
        order = np.argsort(edge, kind="stable")
        self.child, self.edge = child[order], edge[order]

    def near(self, rows: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, earlier node) of all pairs within each row's reach. At distance d from a node, only edges of d - reach to d + reach are followed."""
        q, r, node = rows, reach, self.root[rows]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(q):
            early = node < q  # what is below a node is later than it
            q, r, node = q[early], r[early], node[early]
            self.visited += len(q)
            d = hamming(self.prints[q], self.prints[node])
            hit = d <= r
            a.append(q[hit])
            b.append(node[hit])
            low = np.searchsorted(self.edge, node * self.wide + np.maximum(0, d - r))
            n = np.searchsorted(self.edge, node * self.wide + np.minimum(self.wide - 1, d + r), side="right") - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            q, r, node = np.repeat(q, n), np.repeat(r, n), self.child[at]
        return np.concatenate(a), np.concatenate(b)


def shard_links(shard: np.ndarray, prints: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of the same shard, enough to connect all that are within their reach of each other."""
    trees = Trees(shard, prints)
    _, place, size = np.unique(shard, return_inverse=True, return_counts=True)
    rows = np.flatnonzero((size[place] > 1) & (trees.root != np.arange(len(shard))))
    rows = np.setdiff1d(rows, trees.same[0])
    a, b = [trees.same[0]], [trees.same[1]]
    block = np.cumsum(size[place[rows]]) // FRONTIER
    for part in np.split(rows, np.flatnonzero(np.diff(block)) + 1):
        x, y = trees.near(part, reach[part])
        if len(x) > 4 * len(part):
            x, y = stars(x, y)
        a.append(x)
        b.append(y)
    return np.concatenate(a), np.concatenate(b)


def link_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (shard, node, print, reach), in order of their shard, to links (a, b) of nodes. A shard may span batches."""

    def flush(shard: np.ndarray, node: np.ndarray, prints: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
        a, b = shard_links(shard, prints, reach)
        a, b = node[a], node[b]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    held: list[tuple] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        prints = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
        rows = (batch.column("shard").to_numpy(), batch.column("node").to_numpy(), prints, batch.column("reach").to_numpy().astype(np.int64))
        end = int(np.searchsorted(rows[0] != held[-1][0][-1], True)) if held else 0
        if held and end < batch.num_rows:  # what is held is whole with the rows up to end
            yield flush(*(np.concatenate(x) for x in zip(*held, tuple(r[:end] for r in rows), strict=True)))
            held = []
        held.append(tuple(r[end:] for r in rows) if not held else rows)
    if held:
        yield flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
    trim()


def large(rows: DataFrame, most: int) -> DataFrame | None:
    """(shard, _count) of the shards of over ``most`` rows, broadcast if it is a list of up to HOT; None if there are none."""
    hot = cut(rows.groupBy("shard").agg(F.count("*").alias("_count")).where(F.col("_count") > most))
    n = hot.count()
    return None if not n else F.broadcast(hot) if n <= HOT else hot


def crossed(rows: DataFrame) -> DataFrame:
    """rows (shard, node, major, more) dealt into cells, of about 2 TILE rows, in which every two rows of a shard meet unless both are major.

    The other rows, the minor ones, go to the cells of all tiles of major rows, and to those of each two tiles of their
    own; major rows to one cell for each tile of minor ones. What is in one cell alone is left out.
    """
    sizes = cut(rows.groupBy("shard").agg(*(F.ceil(F.sum(F.when(m, 1).otherwise(0)) / TILE).cast("int").alias(c) for m, c in ((F.col("major"), "_majors"), (~F.col("major"), "_minors")))).where("_minors > 0"))
    n = sizes.count()
    sized = rows.join(F.broadcast(sizes) if n <= HOT else sizes, "shard")
    own = F.pmod(F.xxhash64("node"), F.when(F.col("major"), F.col("_majors")).otherwise(F.col("_minors"))).cast("int")  # a long hashes otherwise than an int
    over = lambda count, f: F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), f)).otherwise(F.array().cast("array<bigint>"))
    mixed = lambda major, minor: F.xxhash64("shard", F.lit("mixed"), major, minor)
    minor = F.concat(over("_majors", lambda t: mixed(t, own)), over("_minors", lambda t: F.xxhash64("shard", F.lit("minor"), F.least(own, t), F.greatest(own, t))))
    cells = F.when(F.col("major"), over("_minors", lambda t: mixed(own, t))).otherwise(minor)
    return sized.select(F.explode(cells).alias("shard"), *(c for c in rows.columns if c not in ("shard", "major")))


def link(keyed: DataFrame) -> DataFrame:
    """Links (a, b) between nodes whose prints are within reach in a shard. keyed: shard, node, print, reach (the same within a shard), second.

    Shards of over SHARD rows are dealt out again by (shard, each element of ``second``): an array of long such that two
    linked rows of a shard have an element in common; rows without any stay together. A shard that is too large even then
    is one of many copies, mostly: its rows are held against the smallest node's print, and only those that aren't near it
    meet all others, in cells.
    """
    own = ("shard", "node", "print", "reach")
    hot = large(keyed, SHARD)
    if hot is None:
        return dealt(keyed.select(*own))
    second = F.when(F.col("_count").isNotNull() & (F.size("second") > 0), F.transform("second", lambda x: F.xxhash64("shard", x))).otherwise(F.array("shard"))
    keyed = keyed.join(hot, "shard", "left").select(F.explode(second).alias("shard"), "node", "print", "reach")
    hot = large(keyed, SHARD)
    if hot is None:
        return dealt(keyed)
    crowd = keyed.join(hot, "shard", "left_semi")
    pivots = crowd.groupBy("shard").agg(F.min(F.struct("node", "print")).alias("p")).select("shard", F.col("p.node").alias("_pivot"), F.col("p.print").alias("_print"))

    @F.arrow_udf("boolean")
    def within(a: pa.Array, b: pa.Array, reach: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) for c in (a, b))
        return pa.array(hamming(x, y) <= reach.to_numpy())

    crowd = cut(crowd.join(F.broadcast(pivots) if hot.count() <= HOT else pivots, "shard").select(*own, "_pivot", within("print", "_print", "reach").alias("major")))
    sure = crowd.where("major and node <> _pivot").select(F.col("node").alias("a"), F.col("_pivot").alias("b"))
    cells = crossed(crowd.drop("_pivot"))
    return dealt(keyed.join(hot, "shard", "left_anti").unionByName(cells)).unionByName(sure)


def dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(link_shards, "a long, b long")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """key and fingerprint (long, the 64 bits as signed) of each row's whole text; null and empty texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            fp = np.array([fingerprint(shingle_hashes(t, width)) for t in batch.column("_text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [key, "fingerprint"])

    return docs.select(key, utf8(text).alias("_text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, fingerprint long")


def groups(prints: DataFrame, key: str = "doc_id", radius: int = 3) -> DataFrame:
    """prints with component_id: the smallest key that links of at most ``radius`` differing bits reach.

    Of equal fingerprints one stands for all, so copies make no pairs. Two fingerprints within the radius have one of
    radius + 1 pieces of their bits in common (16 bits each at radius 3), and in a shard that such a piece makes too
    large, one of the pieces of the other bits. Rows without a key keep the group of their fingerprint.
    """
    prints = cut(prints)
    distinct = cut(prints.groupBy("fingerprint").agg(F.min(key).alias("node")))
    n = radius + 1
    bounds = [64 * i // n for i in range(n + 1)]
    piece = lambda f, i, m, b=bounds: F.shiftrightunsigned(f, b[i]).bitwiseAND(F.lit((1 << (b[i + 1] - b[i])) - 1)) * F.lit(m) + F.lit(i)
    shards = distinct.where("node is not null").select(
        F.explode(F.array(*(piece(F.col("fingerprint"), i, n) for i in range(n)))).alias("shard"), "node", "fingerprint"
    ).select("shard", "node", "fingerprint", F.unhex(F.lpad(F.hex("fingerprint"), 16, "0")).alias("print"))
    own = F.pmod("shard", F.lit(n))
    width = [bounds[k + 1] - bounds[k] for k in range(n)]

    def part(k: int, i: int) -> "F.Column":
        """The i-th of n parts of piece k."""
        low, high = width[k] * i // n, width[k] * (i + 1) // n
        return F.when(own == F.lit(k), F.lit(-1)).otherwise(F.shiftrightunsigned("fingerprint", bounds[k] + low).bitwiseAND(F.lit((1 << (high - low)) - 1)))

    rest = F.array(*(F.xxhash64(F.lit(i), *(part(k, i) for k in range(n))) for i in range(n)))
    roots = connected(link(shards.select("shard", "node", "print", F.lit(radius).alias("reach"), rest.alias("second"))))
    named = distinct.join(roots, distinct.node == roots.node, "left").select("fingerprint", F.coalesce("root", distinct.node).alias("component_id"))
    return prints.join(named, "fingerprint")


def sketches(sets: list[np.ndarray], signs: np.ndarray) -> tuple[list[bytes], list[list[int]]]:
    """(print, anchors) of each set of shingle hashes: SimHash of BITS bits, and the SPLIT smallest of them.

    The bits are signs of random projections of a count sketch of the shingles, whole numbers below 2**24 in float32,
    so they are the same everywhere.
    """
    counters, anchors = np.zeros((len(sets), COUNTERS), np.float32), []
    for i, h in enumerate(sets):
        anchors.append(h[:SPLIT].view(np.int64).tolist())
        counters[i] = np.bincount((h >> np.uint64(20) & np.uint64(COUNTERS - 1)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0), COUNTERS)
    bits = np.packbits(counters @ signs > 0, axis=1)
    return [x.tobytes() for x in bits], anchors


def projection() -> np.ndarray:
    """COUNTERS by BITS of 1 and -1, always the same."""
    bits = np.unpackbits(np.frombuffer(np.random.RandomState(SEED).bytes(COUNTERS * BITS // 8), np.uint8))
    return (2.0 * bits.reshape(COUNTERS, BITS) - 1).astype(np.float32)


def short_sketch(h: np.ndarray, similarity: float, most: int) -> bytes:
    """A print of BITS bits of a set of at most ``most`` hashes; similar sets' are never farther apart than short_radius.

    Half of the bits are the hashes' own, which differ in at most the sets' symmetric difference. A set's own share of what
    larger sets may differ in is filled up by bits of its own in the other half, so that one radius suits all sizes.
    """
    out, half = np.zeros(BITS, np.uint8), BITS // 2
    out[(h >> np.uint64(30) & np.uint64(half - 1)).astype(np.int64)] = 1
    own = max(0, int((most - len(h)) * (1 - similarity) / (1 + similarity) + 1e-9))
    for k in range(own):
        out[half + xxhash.xxh64_intdigest(h.tobytes(), k) % half] = 1
    return np.packbits(out).tobytes()


def short_radius(similarity: float, most: int) -> int:
    return int(2 * most * (1 - similarity) / (1 + similarity) + 1e-9)


def heads(h: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first of a set's sorted hashes, and how many of them any set as similar must share one of within its own; with all, two."""
    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
    return h[: n + 1], n


def wide_radius(similarity: float) -> int:
    """Differing bits at which texts of this Jaccard similarity are, on average, if they are of equal length."""
    return int(BITS * math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi)


def normal(text: str) -> "F.Column":
    """md5 of the words in lower case (A-Z), joined by blanks."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.md5(F.trim(F.regexp_replace(folded, r"[\x20\x09-\x0D]+", " ")).cast("binary"))


def tile_links(a: list[np.ndarray], b: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two lists of different shingle hashes whose Jaccard similarity is at least as asked, exactly."""
    flat = [np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (a, b)]
    rows = [np.repeat(np.arange(len(x)), [len(h) for h in x]) for x in (a, b)]
    common = np.intersect1d(*flat)
    shared = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(common), 4096):
        part = common[at : at + 4096]
        dense = []
        for hashes, row, x in zip(flat, rows, (a, b), strict=True):
            place = np.minimum(np.searchsorted(part, hashes), len(part) - 1)
            hit = part[place] == hashes
            m = np.zeros((len(x), len(part)), np.float32)
            m[row[hit], place[hit]] = 1
            dense.append(m)
        shared += dense[0] @ dense[1].T
    sizes = [np.array([len(h) for h in x], np.float64) for x in (a, b)]
    return np.nonzero(shared.astype(np.float64) * (1 + similarity) >= similarity * (sizes[0][:, None] + sizes[1][None, :]) - 1e-6)


def verify(width: int, similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (shard, node, text), in order of their shard, to links (a, b) of nodes whose texts are similar, by their whole shingles."""

    def flush(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i in range(0, len(sets), TILE):
            for j in range(i, len(sets), TILE):
                x, y = tile_links(sets[i : i + TILE], sets[j : j + TILE], similarity)
                keep = (x + i) < (y + j)
                a, b = stars(np.concatenate((a, x[keep] + i)), np.concatenate((b, y[keep] + j)))
        ends = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(ends[a], ends[b])), pa.array(np.minimum(ends[a], ends[b]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, nodes, sets, seen = None, [], [], set()
        for batch in batches:
            for s, n, t in zip(*(batch.column(c).to_pylist() for c in ("shard", "node", "text")), strict=True):
                if s != shard and nodes:
                    if len(nodes) > 1:
                        yield flush(nodes, sets)
                    nodes, sets, seen = [], [], set()
                shard = s
                if n not in seen:
                    seen.add(n)
                    nodes.append(n)
                    sets.append(np.unique(shingle_hashes(t, width)))
        if len(nodes) > 1:
            yield flush(nodes, sets)
        trim()

    return run


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest key (null keys last), whole and unchanged.

    Texts are linked if the Jaccard similarity of their different shingles of ``width`` words is ``similarity`` or more;
    groups are what links connect. Candidates among texts of SHORT shingles and more are those whose wide SimHash sketches are
    as near as those of sets that are TOLERANCE less similar; BK-trees find them in shards, in which texts meet by one of the
    ANCHORS smallest shingle hashes (all pairs this similar have one in common but for 0.2**8 of them), and in a shard that is
    too large by another of the SPLIT smallest. Shorter texts, and what can be similar to them, meet by as many of their smallest
    hashes as any similar text must share one of, and by prints that lose no pair.
    Within what candidates connect, whole shingle sets are compared exactly. A large group of them is compared in tiles that
    each hold the group's smallest node, too; what isn't connected with it then meets all others of its group in cells.
    Equal words are equal texts: one stands for all. Null and empty texts have no words and are one group. Texts of fewer
    words have one shingle, all of them. Repeated rows are one.
    """
    columns, most = docs.columns, int((SHORT - 1) / similarity + 1e-9)
    tagged = docs.withColumns({"_row": F.xxhash64(*columns), "_mix": F.xxhash64(F.lit(SEED), *columns)})  # 128 bits that tell rows apart

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = projection()
        for batch in slices(batches, "_text", 1 << 20):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("_text").to_pylist()
                sets = [np.unique(shingle_hashes(t, width)) for t in texts]
                prints, anchors = sketches(sets, signs)
                small = [short_sketch(h, similarity, most) if 0 < len(h) <= most else None for h in sets]
                first = [heads(h, similarity) if 0 < len(h) <= most else (h[:0], 0) for h in sets]
                new = {
                    "size": pa.array(list(map(len, texts)), pa.int64()), "print": pa.array(prints, pa.binary()), "anchors": pa.array([x if len(h) >= SHORT else [] for x, h in zip(anchors, sets, strict=True)], pa.list_(pa.int64())),
                    "small": pa.array(small, pa.binary()), "heads": pa.array([h.view(np.int64).tolist() for h, _ in first], pa.list_(pa.int64())), "met": pa.array([n for _, n in first], pa.int32()),
                }
                own = ("_norm", "_key", "_row", "_mix")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *new.values()], [*own, *new])

    light = tagged.select(normal(text).alias("_norm"), F.col(key).alias("_key"), "_row", "_mix", utf8(text).alias("_text"))
    drawn = light.mapInArrow(run, f"_norm string, _key {docs.schema[key].dataType.simpleString()}, _row long, _mix long, size long, print binary, anchors array<long>, small binary, heads array<long>, met int")
    best = F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "_row", "_mix")).alias("best")
    distinct = cut(drawn.groupBy("_norm").agg(best, *(F.min(c).alias(c) for c in ("size", "print", "anchors", "small", "heads", "met")))).withColumn("node", F.monotonically_increasing_id())

    def places(kind: str, keys: "F.Column", print_: str, near: str, reach: int) -> "F.Column":
        shard = lambda x: F.struct(F.xxhash64(F.lit(kind), x).alias("shard"), F.col(print_).alias("print"), F.lit(reach).alias("reach"), F.array_except(near, F.array(x)).alias("second"))
        return F.transform(keys, shard)

    wide = places("wide", F.slice("anchors", 1, ANCHORS), "print", "anchors", wide_radius(similarity - TOLERANCE))
    short = places("short", F.slice("heads", F.lit(1), F.col("met")), "small", "heads", short_radius(similarity, most))
    loose = connected(link(distinct.select("node", F.explode(F.concat(wide, short)).alias("x")).select("node", "x.*")))

    names = distinct.select("node", "size", F.col("best._row").alias("_row"), F.col("best._mix").alias("_mix"))
    members = cut(loose.join(names, "node"))
    sizes = members.groupBy("root").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    tiles = F.ceil(F.greatest(F.col("_n") / TILE, F.col("_size") / TILE_BYTES)).cast("int").alias("_tiles")
    crowds = cut(sizes.where(f"_n > {EXACT} or _size > 2 * {TILE_BYTES}").select("root", tiles))
    n = crowds.count()
    crowd = F.broadcast(crowds) if n <= HOT else crowds
    sized = members.join(crowd, "root", "left") if n else members.withColumn("_tiles", F.lit(None).cast("int"))
    tile = lambda t: F.xxhash64("root", F.lit("tile"), t)
    whole = F.transform(F.sequence(F.lit(0), F.col("_tiles") - 1), tile)  # the group's smallest node is in every tile
    shards = F.when(F.col("_tiles").isNull(), F.array("root")).when(F.col("node") == F.col("root"), whole).otherwise(F.array(tile(F.pmod(F.xxhash64("node"), F.col("_tiles")).cast("int"))))

    def compared(rows: DataFrame) -> DataFrame:
        """Links of rows (shard, node, _row, _mix) whose texts are similar."""
        held = F.broadcast(rows) if rows.count() <= FETCH else rows
        texts = tagged.select("_row", "_mix", utf8(text).alias("text")).join(held, ["_row", "_mix"]).select("shard", "node", "text")
        return texts.repartition("shard").sortWithinPartitions("shard", "node").mapInArrow(verify(width, similarity), "a long, b long")

    roots = connected(compared(sized.select(F.explode(shards).alias("shard"), "node", "_row", "_mix")))
    if n:
        found = roots.select("node", F.col("root").alias("_found"))
        rest = members.join(crowd, "root").join(found, "node", "left").select(F.col("root").alias("shard"), "node", "_row", "_mix", F.coalesce(F.col("_found") == F.col("root"), F.col("node") == F.col("root")).alias("major"))
        roots = connected(compared(crossed(cut(rest))).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))

    grouped = distinct.join(roots, "node", "left").withColumn("_group", F.coalesce("root", "node"))
    kept = grouped.groupBy("_group").agg(F.min("best").alias("w")).select("w._row", "w._mix")
    return tagged.join(kept, ["_row", "_mix"], "left_semi").dropDuplicates(["_row", "_mix"]).select(*columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the smallest doc_id that links of 3 bits or fewer reach from it.

    Null and empty texts have fingerprint zero; repeated rows give equal rows; no documents give no rows.
    """
    found = groups(fingerprints(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
