"""FASTQ files as rows of (ord, name, seq, qual), and back."""

from __future__ import annotations

import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ord long, name string, seq string, qual string"
PAIRED = "ord long, name string, seq string, qual string, name2 string, seq2 string, qual2 string"
BATCH = 10_000


class Piece(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, number: int):
        self.path, self.start, self.end, self.number = path, start, end, number


class FastqReader(DataSourceReader):
    """One partition for each compressed file, and one for each ``splitbytes`` of a plain one.

    A split begins at a record: a line that starts with @ two lines before one that starts with +, with a quality as
    long as its sequence. Records keep their order by ord, whose high bits are the split's number.
    """

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.lines = 8 if options.get("pairedend", "false").lower() == "true" else 4
        self.split = int(options.get("splitbytes", 128 << 20))

    def partitions(self) -> list[Piece]:
        out: list[Piece] = []
        for path in self.paths:
            path = path.removeprefix("file://")
            if not os.path.exists(path):
                raise FileNotFoundError(path)
            if path.endswith((".gz", ".lz4")) or self.lines == 8:
                out.append(Piece(path, 0, None, len(out)))
            else:
                for at in range(0, max(1, os.path.getsize(path)), self.split):
                    out.append(Piece(path, at, at + self.split, len(out)))
        return out

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] + [pa.string()] * (3 * self.lines // 4)
        names = ["ord", "name", "seq", "qual", "name2", "seq2", "qual2"][: len(kinds)]
        rows: list[tuple] = []
        for n, record in enumerate(records(piece, self.lines)):
            rows.append(((piece.number << 40) + n, *record))
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def opened(path: str):
    if path.endswith(".gz"):
        import gzip

        return gzip.open(path, "rb")
    if path.endswith(".lz4"):
        return io.BufferedReader(pa.CompressedInputStream(pa.OSFile(path), "lz4"), 1 << 20)
    return open(path, "rb")


def records(piece: Piece, lines: int = 4) -> Iterator[tuple]:
    """Names, sequences and qualities of a piece, without @ and separators; an incomplete last one is left out, a corrupt stream raises."""
    with opened(piece.path) as f:
        at = 0
        if piece.end is not None:
            at = align(f, piece.start)
            f.seek(at)
        while piece.end is None or at < piece.end:
            block = [f.readline() for _ in range(lines)]
            if not block[-1]:
                return
            at += sum(map(len, block))
            text = [x.decode().strip() for x in block]
            out: list[str] = []
            for k in range(0, lines, 4):
                out += [text[k].removeprefix("@"), text[k + 1], text[k + 3]]
            yield tuple(out)


def align(f, start: int) -> int:
    """The first record that begins at a byte or after it."""
    if start == 0:
        return 0
    f.seek(start - 1)
    at = start - 1 + len(f.readline())
    window: list[tuple[int, bytes]] = []
    while True:
        line = f.readline()
        if not line:
            return at
        window.append((at, line))
        at += len(line)
        if len(window) == 4:
            (first, a), (_, s), (_, p), (_, q) = window
            if a[:1] == b"@" and p[:1] == b"+" and len(s.strip()) == len(q.strip()):
                return first
            window.pop(0)


class FastqSource(DataSource):
    """``spark.read.format("fastq")``; options pairedEnd (eight lines a row) and splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return PAIRED if self.options.get("pairedend", "false").lower() == "true" else SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader({**self.options, "path": self.options.get("path") or ",".join(self.options.get("paths", ()))})


def read_fastq(spark: SparkSession, path: str, paired: bool = False) -> DataFrame:
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("pairedEnd", str(paired).lower()).load(path)


def read_fastq_text(spark: SparkSession, path: str) -> DataFrame:
    """The same rows from any store that Spark reads, by the text source: for one file, whose lines are numbered in place.

    Lines are numbered within their partition, and partitions by a count of lines, so nothing is sorted; the four lines
    of a record then meet by its number.
    """
    lines = spark.read.text(path).select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("id"), F.trim("value").alias("value"))
    sizes = {r.p: r.n for r in lines.groupBy("p").agg(F.count("*").alias("n")).collect()}  # one row for each split
    first, total = {}, 0
    for p in sorted(sizes):
        first[p], total = total, total + sizes[p]
    if not total:
        return lines.sparkSession.createDataFrame([], SCHEMA)
    base = F.create_map(*(F.lit(x) for p, n in first.items() for x in (p, n)))
    at = base[F.col("p")] + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = lines.select(F.floor(at / 4).alias("ord"), (at % 4).alias("k"), "value").where(F.col("ord") < total // 4)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    return numbered.groupBy("ord").agg(F.regexp_replace(pick(0), "^@", "").alias("name"), pick(1).alias("seq"), pick(3).alias("qual"))


def record_text(name: str = "name", seq: str = "seq", qual: str = "qual"):
    """A column with the four lines of a record."""
    return F.concat_ws("\n", F.concat(F.lit("@"), F.col(name)), F.col(seq), F.lit("+"), F.col(qual))


def write_fastq(reads: DataFrame, path: str, order: str | None = "ord", compression: str = "gzip", name: str = "name", seq: str = "seq", qual: str = "qual") -> None:
    from strandloom.sources.tables import write_lines

    write_lines(reads.select(*([order] if order else []), record_text(name, seq, qual).alias("value")), path, order, compression)
