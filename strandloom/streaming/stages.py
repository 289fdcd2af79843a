"""The row-local stages and first-seen deduplication over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import reads
from strandloom.plans.chemistry import Chemistry

READS = "ord long, name string, seq string, qual string"


def read_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Reads that arrive as Parquet files of a folder."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files).parquet(folder)


def annotated_stream(stream: DataFrame, chemistry: Chemistry, fast: bool = False) -> DataFrame:
    """Barcodes, UMIs, targets and arms of a stream of reads: projections alone, without state."""
    found = reads.with_umis(reads.extracted(stream, chemistry, fast).where("success"), chemistry).where("umi_outcome = 'accepted'")
    return reads.prepared(reads.with_targets(found, chemistry), chemistry)


def first_seen_stream(records: DataFrame, keys: list[str], time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first record of each key; with a time, keys are forgotten once they're older than the watermark."""
    if time is None:
        return records.dropDuplicates(keys)
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(records: DataFrame, time: str, keys: list[str], size: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Records of each key by window of time, which late ones still reach until the watermark has passed."""
    return records.withWatermark(time, delay).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))
