"""Approximate joins of short texts: k-mer blocking for lookups, deletion neighbourhoods for close pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequences import deletions


def kmers(column: str, k: int):
    """The different k-mers of a column; none of texts shorter than k."""
    n = F.length(column) - k + 1
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(F.col(column), i, F.lit(k)))).otherwise(F.array().cast("array<string>")))


def fuzzy_lookup(rows: DataFrame, entries: DataFrame, text: str, entry: str, budget: int, k: int = 4) -> DataFrame:
    """Pairs of a different text and an entry that share a k-mer and are at most ``budget`` edits apart: (text, entry, distance).

    Equality on k-mers stands in for the pairwise comparison, texts and entries count once each, and a pair is verified
    once, however many k-mers it shares. The distance stops at the budget.
    """
    left = rows.select(text).distinct().withColumn("_kmer", F.explode(kmers(text, k)))
    right = entries.select(entry).distinct().withColumn("_kmer", F.explode(kmers(entry, k)))
    pairs = left.join(right, "_kmer").where(F.abs(F.length(text) - F.length(entry)) <= budget).select(text, entry).distinct()
    return pairs.withColumn("distance", F.levenshtein(F.col(text), F.col(entry), budget)).where("distance >= 0")


def best_unique(pairs: DataFrame, text: str, entry: str) -> DataFrame:
    """(text, entry, distance): the nearest entry of each text, null where several are as near."""
    nearest = pairs.groupBy(text).agg(F.min("distance").alias("_least"))
    held = pairs.join(nearest, text).where("distance = _least").groupBy(text).agg(F.count("*").alias("_n"), F.min(entry).alias("_entry"), F.min("distance").alias("distance"))
    return held.select(text, F.when(F.col("_n") == 1, F.col("_entry")).alias(entry), "distance")


def close_pairs(entries: DataFrame, entry: str, budget: int) -> DataFrame:
    """(a, b, distance) of different entries at most ``budget`` edits apart, a before b, by a self-join on shared deletions."""
    forms = entries.select(F.col(entry).alias("a")).where("a is not null").distinct().withColumn("_form", F.explode(deletions(F.col("a"), budget)))
    pairs = forms.join(forms.withColumnRenamed("a", "b"), "_form").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("distance", F.levenshtein(F.col("a"), F.col("b"), budget)).where("distance >= 0")


def exact_lookup(rows: DataFrame, entries: DataFrame, key: str, entry: str) -> DataFrame:
    """Rows with the columns of the entry that their key equals; those without one are left out. Spark broadcasts entries that are small."""
    return rows.join(entries, F.col(key) == F.col(entry))
