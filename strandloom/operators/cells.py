"""Cells: interval overlaps, sparse peak by barcode counts, rank curves, knees and the export of the called cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.lineage import cut


def overlaps(a: DataFrame, b: DataFrame, width: int, least: int = 1, key: str | None = None, names: tuple = ("start", "end", "start2", "end2")) -> DataFrame:
    """Pairs of rows of a and b (of equal ``key``, if there is one) whose half-open intervals share at least ``least``.

    Both sides are dealt by bins of ``width`` and joined by equality on the bin; a pair is taken in the bin where the
    later of the two begins, so once. ``names``: start and end in a, start and end in b, all different columns.
    """
    if least < 1:
        raise ValueError("an overlap is 1 at least")
    s, e, s2, e2 = names
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    left = a.where(F.col(e) > F.col(s)).withColumn("_bin", bins(s, e))
    right = b.where(F.col(e2) > F.col(s2)).withColumn("_bin", bins(s2, e2))
    on = ["_bin"] + ([key] if key else [])
    shared = F.least(e, e2) - F.greatest(s, s2)
    return left.join(right, on).where((shared >= least) & (F.col("_bin") == F.floor(F.greatest(s, s2) / width))).drop("_bin")


def distinct_peaks(peaks: DataFrame) -> DataFrame:
    """The first peak of each place."""
    first = peaks.groupBy("chrom", "start", "end").agg(F.min_by(F.struct("name", "score", "strand"), "ord").alias("p"), F.min("ord").alias("ord"))
    return first.select("ord", "chrom", "start", "end", "p.name", "p.score", "p.strand")


def peak_counts(records: DataFrame, peaks: DataFrame, least: int = 1, width: int = 1000, tag: str = "CB") -> DataFrame:
    """(peak, barcode, n): records of each barcode that share ``least`` bases with each peak, pre-aggregated before any shuffle of counts.

    records: rname, start, end and the tag, which every record must have.
    """
    checked = F.when(F.col(tag).isNotNull() & (F.col(tag) != ""), F.col(tag)).otherwise(F.raise_error(F.lit(f"a record has no {tag}")).cast("string"))
    reads = records.select(F.col("rname").alias("chrom"), "start", "end", checked.alias("barcode"))
    places = distinct_peaks(peaks).select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("name").alias("peak"))
    return cell_counts(overlaps(reads, places, width, least, "chrom"))


def cell_counts(rows: DataFrame, feature: str = "peak", column: str = "barcode") -> DataFrame:
    """(feature, column, n): the cells of a sparse matrix that have a row at least."""
    return rows.groupBy(feature, column).agg(F.count("*").alias("n"))


def column_sums(cells: DataFrame, all_columns: DataFrame, column: str = "barcode", value: str = "n") -> DataFrame:
    """(column, n) of every listed column, 0 for those without cells."""
    total = cells.groupBy(column).agg(F.sum(value).alias("_n"))
    return all_columns.select(column).distinct().join(total, column, "left").select(column, F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def ranked(counts: DataFrame, order: list, rank: str = "rank") -> DataFrame:
    """Rows with a dense place 1..n in an order, without bringing them into one task.

    Rows are dealt by ranges of the order and sorted within them; a row's place is its place in its part plus the sizes
    of the parts before, of which the driver gets one number each.
    """
    parts = counts.sparkSession.sparkContext.defaultParallelism
    dealt = counts.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order)
    placed = dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    placed = cut(placed)  # a later action must see the same parts
    sizes = {r["_part"]: r["n"] for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before += [F.lit(p), F.lit(total)]
        total += sizes[p]
    if not sizes:
        return placed.withColumn(rank, F.lit(0).cast("long")).drop("_part", "_at")
    return placed.withColumn(rank, F.create_map(*before)[F.col("_part")] + F.col("_at") + 1).drop("_part", "_at")


def rank_curve(counts: DataFrame, value: str, name: str) -> DataFrame:
    """Positive counts with their rank, the highest first and equal ones by name."""
    return ranked(counts.where(F.col(value) > 0), [F.desc(value), F.asc(name)])


def knee(values: list[int], ranks: list[int] | None = None, sensitivity: float = 1.0) -> tuple[int, int] | None:
    """(rank, value) of the knee of a falling curve, by Kneedle for concave curves, online: the last found from the far end on.

    The distance from the diagonal is followed from the highest rank to the lowest. A local maximum sets a threshold under
    it, a local minimum one of 0; where the distance falls below the threshold, the last maximum is a knee. ranks: the
    places of the values, if not all are given, so that a sample has the curve's own axis. None if there is none.
    """
    y, x = np.array(values, float), np.arange(1, len(values) + 1) if ranks is None else np.array(ranks)
    if len(y) < 2 or y.max() == y.min():
        return None
    d = ((y - y.min()) / (y.max() - y.min()) + (x - 1) / (x[-1] - 1) - 1)[::-1]
    edge = np.pad(d, 1, mode="edge")
    top, bottom = (d >= edge[:-2]) & (d >= edge[2:]), (d <= edge[:-2]) & (d <= edge[2:])
    at = found = None
    threshold = 0.0
    for i in range(len(d) - 1):
        if top[i]:
            at, threshold = i, d[i] - sensitivity / (x[-1] - 1)
        if bottom[i]:
            threshold = 0.0
        if at is not None and d[i + 1] < threshold:
            found = at
    return None if found is None else (int(x[len(x) - 1 - found]), int(values[len(x) - 1 - found]))


def checked_n(n: object, most: int) -> int | None:
    """The number of cells to force: None leaves it to the knee, 0 means all."""
    if n is None:
        return None
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError("the number of cells isn't a whole number")
    if n < 0 or n > most:
        raise ValueError(f"the number of cells isn't from 0 to {most}")
    return n or most


def top_cells(counts: DataFrame, n: int | None, value: str = "n", name: str = "barcode") -> DataFrame:
    """The n columns of the highest sums, equal ones by name; all without n."""
    rows = counts.orderBy(F.desc(value), F.asc(name))
    return rows if n is None else rows.limit(n)


def selected_features(cells: DataFrame, chosen: DataFrame, feature: str = "peak", column: str = "barcode") -> DataFrame:
    """Features with a cell in the chosen columns."""
    return cells.join(chosen.select(column).distinct(), column, "left_semi").select(feature).distinct()


def indexed(names: DataFrame, name: str, index: str) -> DataFrame:
    """(name, index): 1..n in the order of names."""
    return ranked(names.select(name).distinct(), [F.asc(name)], index)


def matrix_slice(cells: DataFrame, rows: DataFrame, columns: DataFrame, feature: str = "peak", column: str = "barcode") -> DataFrame:
    """(row, column, n): the cells of chosen features and columns with new dense indices, both in the order of names."""
    r, c = indexed(rows, feature, "row"), indexed(columns, column, "col")
    return cells.join(r, feature).join(c, column).select("row", "col", "n")


def cell_value(cells: DataFrame, feature: str, column: str, features: DataFrame, columns: DataFrame, names: tuple = ("peak", "barcode")) -> int:
    """The count of one cell, 0 if it has none. A name that isn't text, or isn't in its dimension, raises."""
    for value, known, name in ((feature, features, names[0]), (column, columns, names[1])):
        if not isinstance(value, str):
            raise TypeError(f"{name} isn't text")
        if known.where(F.col(name) == value).isEmpty():
            raise ValueError(f"no {name} {value}")
    return cells.where((F.col(names[0]) == feature) & (F.col(names[1]) == column)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def matrix_lines(cells: DataFrame, rows: int, columns: int, comment: str = "peaks by barcodes") -> DataFrame:
    """MatrixMarket coordinate lines as (ord, value): a head of three, then one line a cell."""
    head = cells.agg(F.count("*").alias("n")).select(F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("%%MatrixMarket matrix coordinate integer general").alias("value")),
        F.struct(F.lit(1).alias("ord"), F.lit(f"%{comment}").alias("value")),
        F.struct(F.lit(2).alias("ord"), F.concat(F.lit(f"{rows} {columns} "), F.col("n").cast("string")).alias("value")),
    )).alias("h")).select(F.col("h.ord").cast("long").alias("ord"), "h.value")
    body = cells.select((F.col("row") * F.lit(max(columns, 1)) + F.col("col") + 2).cast("long").alias("ord"), F.concat_ws(" ", F.col("row").cast("string"), F.col("col").cast("string"), F.col("n").cast("string")).alias("value"))
    return head.unionByName(body)


def split_counts(records: DataFrame, tag: str = "CB") -> DataFrame:
    """(barcode, count): records of each barcode, the most first, equal ones by first appearance."""
    found = records.groupBy(F.col(tag).alias("barcode")).agg(F.count("*").alias("count"), F.min("ord").alias("_first"))
    return found.orderBy(F.desc("count"), "_first").drop("_first")


def split(records: DataFrame, path: str, tag: str = "CB") -> None:
    """Writes each barcode's records to a folder of its own, in order of reference and position.

    Rows are dealt by barcode and a part of their position, so a hot barcode takes several files, each in order.
    """
    salted = records.withColumn("_salt", F.pmod(F.floor(F.col("pos") / 1_000_000), F.lit(16)))
    salted.repartition(tag, "_salt").sortWithinPartitions(tag, "rname", "pos", "ord").drop("_salt").write.mode("overwrite").partitionBy(tag).parquet(path)


def full_counts(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, count) by count, equal ones by first appearance."""
    w = rows.groupBy(key).agg(F.count("*").alias("count"), F.min(order).alias("_first"))
    return w.orderBy(F.desc("count"), "_first")
