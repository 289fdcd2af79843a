"""Text tables: whitelists, BED, barcode and UMI maps, and the writers for single ordered text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BED = "chrom string, start int, end int, name string, score int, strand string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the lines of one text file with their place; gz is read as one split."""
    lines = spark.read.text(path)
    # Ids of unshuffled scans ascend with the place in the file, so they keep its order.
    return lines.select(F.monotonically_increasing_id().alias("ord"), "value")


def whitelist(spark: SparkSession, path: str, cut: tuple[int | None, int | None] | None = None) -> DataFrame:
    """(ord, entry) of a whitelist file; ``cut`` slices the padding off each line, and blank entries are left out."""
    line = F.trim(F.col("value"))
    if cut:
        start, stop = cut[0] or 0, cut[1]
        size = F.length(line) - start if stop is None else F.lit(stop - start) if stop >= 0 else F.length(line) - start + stop
        line = F.when(size > 0, F.substr(line, F.lit(start + 1), size)).otherwise("")
    return numbered_lines(spark, path).select("ord", line.alias("entry")).where("entry <> ''")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """BED6+ with its order: more columns are ignored; fewer, or scores outside 0 to 1000, raise."""
    parts = F.split("value", "\t")
    rows = numbered_lines(spark, path).where("value <> ''").select("ord", parts.alias("p"))
    field = lambda i: F.get("p", F.lit(i))
    score = field(4).cast("int")
    checked = F.when((F.size("p") >= 6) & score.between(0, 1000), score).otherwise(F.raise_error(F.concat(F.lit("no BED6 line: "), F.array_join("p", " "))).cast("int"))
    return rows.select("ord", field(0).alias("chrom"), field(1).cast("int").alias("start"), field(2).cast("int").alias("end"), field(3).alias("name"), checked.alias("score"), field(5).alias("strand"))


def read_barcodes(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(qname, barcode) of a table without header: the id is the first word of column 1, the last row of an id counts."""
    rows = numbered_lines(spark, path).select("ord", F.split("value", sep).alias("p")).select("ord", F.substring_index(F.get("p", F.lit(0)), " ", 1).alias("qname"), F.get("p", F.lit(1)).alias("barcode"))
    return rows.groupBy("qname").agg(F.max_by("barcode", "ord").alias("barcode"))


def read_umis(spark: SparkSession, path: str) -> DataFrame:
    """(qname, UR, UB) of a tab-separated table of id, barcode, raw and corrected UMI; the last row of an id counts."""
    p = F.split("value", "\t")
    rows = numbered_lines(spark, path).select("ord", F.get(p, F.lit(0)).alias("qname"), F.get(p, F.lit(2)).alias("UR"), F.get(p, F.lit(3)).alias("UB"))
    return rows.groupBy("qname").agg(F.max_by(F.struct("UR", "UB"), "ord").alias("u")).select("qname", "u.UR", "u.UB")


def barcodes_from_status(lines: DataFrame, value: str = "value") -> DataFrame:
    """(name, barcode, status) rows for a barcode table from the pipe-delimited lines that extraction writes."""
    p = F.split(F.col(value), r"\|")
    return lines.select(F.get(p, F.lit(0)).alias("name"), F.substring_index(F.get(p, F.lit(1)), ":", -1).alias("barcode"), F.get(p, F.lit(1)).alias("status"))


def write_lines(lines: DataFrame, path: str, order: str | None = "ord", compression: str | None = None) -> None:
    """Writes a column ``value`` as text; with an order, range-partitioned by it, so that the parts in name order are the file."""
    ordered = lines.orderBy(order) if order else lines
    ordered.select("value").write.mode("overwrite").text(path, compression=compression or "none")


def write_bed(peaks: DataFrame, path: str, order: str | None = None) -> None:
    cols = [F.col(c).cast("string") for c in ("chrom", "start", "end", "name", "score", "strand")]
    write_lines(peaks.select(*([order] if order else []), F.concat_ws("\t", *cols).alias("value")), path, order)


def md5_matches(spark: SparkSession, path: str, expected: str) -> bool:
    """Whether a file has this MD5, in whichever case it's written."""
    return spark.read.format("binaryFile").load(path).select(F.md5("content").alias("m")).first().m == expected.lower()
