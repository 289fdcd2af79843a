"""What the training-data operators share: table access, checkpoints, Arrow batch slicing and connected components."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import strandloom
from strandloom.operators.lineage import cut

# Functions travel to the executors with their code, so that workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(strandloom)

#: Edges that one task contracts, at most (16 bytes each); more go through rounds of stars first.
CONTRACT = 1_000_000
#: Bytes of text that a Python worker turns into numpy arrays at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str) -> "F.Column":
    """The whole text as UTF-8 bytes; null counts as the empty text."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def trim() -> None:
    """Gives free memory back to the system, as workers outlive their tasks; without an effect where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of whole rows of about ``limit`` bytes in ``column``; a longer row is a run of its own."""
    trim()  # what an earlier task has left
    for batch in batches:
        col = batch.column(column)
        sizes = np.diff(np.frombuffer(col.buffers()[1], dtype=np.int32 if pa.types.is_binary(col.type) or pa.types.is_string(col.type) else np.int64)[col.offset : col.offset + len(col) + 1]) if len(col) else []
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def shipped(spark: SparkSession, model: Any) -> Callable[[], Any]:
    """A broadcast model as a function that gives it: pickled with its classes, which workers need not be able to import, and unpickled once a worker."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def get() -> Any:
        if not hasattr(held, "model"):  # a worker has one object for each broadcast
            held.model = pickle.loads(held.value)
        return held.model

    return get


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it's connected to) of all ends of the edges but those that are the smallest themselves."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        rx, ry = root[x], root[y]
        apart = rx != ry
        if not apart.any():
            break
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root[root] != root).any():
            root = root[root]
    far = np.flatnonzero(root != np.arange(len(root)))
    return nodes[far], nodes[root[far]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars of what they connect; of at most CONTRACT edges at once, so a task's memory is bounded."""
    u, v, n = [], [], 0
    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n > CONTRACT:
            u, v = ([x] for x in stars(np.concatenate(u), np.concatenate(v)))
            n = len(u[0])
            if n > CONTRACT // 2:
                yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(v[0])], ["u", "v"])
                u, v, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(np.concatenate(u), np.concatenate(v))], ["u", "v"])


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges of long ids: (node, root) for each node with an edge, root being its smallest.

    Every partition's edges become stars where they are. Once CONTRACT edges or fewer are left, one task joins them, which
    takes as many bytes as that; until then large-star and small-star rounds, each a min-aggregation and a join, go on
    over all partitions, so that no node's neighbours are ever gathered in one task. Loops and null ends are ignored; no
    edges give no rows.
    """
    pairs = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v").mapInArrow(contracted, "u long, v long"))
    while pairs.count() > CONTRACT:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        pairs = cut(small.distinct())
        # Stars alone are left when no node has two parents or is a parent and a child.
        ends = pairs.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").limit(1).count():
            break
    else:
        pairs = pairs.coalesce(1).mapInArrow(contracted, "u long, v long")
    return cut(pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v"))).alias("x")).select(F.col("x.u").alias("node"), F.col("x.v").alias("root")).distinct())
