"""Deduplication: the best-scoring record of a fragment, the first seen, and the tags that keys are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_of_group(rows: DataFrame, keys: list, score: Column, order: list) -> DataFrame:
    """The row of the highest score of each group; of equal scores the first by ``order``. Null scores are the lowest.

    The filter on the row number makes Spark keep one row of each group before its shuffle, so a hot group sends one
    row a task.
    """
    w = Window.partitionBy(*keys).orderBy(score.desc_nulls_last(), *order)
    return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def best_keyed(rows: DataFrame, keys: list[str], score: Column, order: str) -> DataFrame:
    """Keys and the ``order`` value of the best row of each group, by one partial aggregation and no sort."""
    return rows.groupBy(*keys).agg(F.max_by(order, F.struct(score, -F.col(order))).alias(order))


def first_seen(rows: DataFrame, keys: list[str], order: str, flag: str = "DU") -> DataFrame:
    """Rows with a flag: 0 for the first of its key by ``order``, 1 for later ones. Null keys are one key."""
    first = rows.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(F.min(order).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return rows.join(first, same, "left").select(*rows.columns, F.when(F.col(order) == F.col("_first"), 0).otherwise(1).alias(flag))


def skip_reason(tag: str = "cb") -> Column:
    """Why a first mate isn't a candidate: non_primary, unpaired, unmapped; a missing tag raises; null for candidates."""
    missing = F.raise_error(F.concat(F.lit(f"no {tag} tag: "), F.col("qname"))).cast("string")
    return (
        F.when(F.col("category") != "primary", "non_primary")
        .when(~F.coalesce(F.col("paired"), F.lit(True)), "unpaired")
        .when(F.col("unmapped") | F.col("mate_unmapped"), "unmapped")
        .when(F.col(tag).isNull() | (F.col(tag) == ""), missing)
    )


def fragment_position() -> Column:
    """The place of a fragment's 5' end: the alignment's end on the reverse strand, else its start."""
    return F.when(F.col("is_reverse"), F.col("ref_start") + F.col("ref_len")).otherwise(F.col("ref_start"))


def linear_winners(records: DataFrame, tag: str = "cb") -> DataFrame:
    """The first mates that stay: of each barcode, reference, strand and position the highest AS, the first of equals."""
    candidates = records.where("mate = 1").withColumn("_skip", skip_reason(tag)).where("_skip is null").drop("_skip")
    keyed = candidates.withColumn("_pos", fragment_position())
    return best_of_group(keyed, [tag, "rname", "is_reverse", "_pos"], F.col("as_tag").cast("double"), ["ord"]).drop("_pos")


def linear_dedup(records: DataFrame, tag: str = "cb") -> DataFrame:
    """All primary records, of both mates, of the fragments that stay."""
    return records.where("category = 'primary'").join(linear_winners(records, tag).select("qname").distinct(), "qname", "left_semi")


def linear_stats(records: DataFrame, tag: str = "cb") -> DataFrame:
    """(measure, key, n): first mates in total, skipped by reason, and eligible and kept by reference."""
    mates = records.where("mate = 1").withColumn("_skip", skip_reason(tag))
    kept = linear_winners(records, tag)
    n = F.count("*").alias("n")
    parts = [
        mates.groupBy(F.lit("total").alias("measure"), F.lit("").alias("key")).agg(n),
        mates.where("_skip is not null").groupBy(F.lit("skipped").alias("measure"), F.col("_skip").alias("key")).agg(n),
        mates.where("_skip is null").groupBy(F.lit("eligible").alias("measure"), F.col("rname").alias("key")).agg(n),
        kept.groupBy(F.lit("kept").alias("measure"), F.col("rname").alias("key")).agg(n),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_map(records: DataFrame, known: DataFrame, key: str = "qname", all_rows: bool = False) -> DataFrame:
    """Records with the columns that a map has for their key; those without an entry are left out, or null with ``all_rows``."""
    return records.join(known, key, "left" if all_rows else "inner")


def tagged(records: DataFrame, barcodes: DataFrame, umis: DataFrame | None = None) -> DataFrame:
    """Placed records of known reads with CB, and UR and UB if there is a UMI map, and DU: 1 for later copies of a fragment.

    A fragment is (reference, start, signed template length, CB, and UB with a map); mates are told apart by their
    places. Reads without a barcode are left out; those without a UMI share none.
    """
    placed = with_map(records.where("rname is not null and rname <> '*'"), barcodes.select("qname", F.col("barcode").alias("CB")))
    keys = ["rname", "pos", "tlen", "CB"]
    if umis is not None:
        placed = with_map(placed, umis, all_rows=True)
        keys.append("UB")
    return first_seen(placed, keys, "ord")


def checked_flag(value: Column) -> Column:
    """A duplicate flag as a whole number; anything but 0 or 1 raises."""
    number = value.try_cast("int")
    return F.when(number.isin(0, 1), number).otherwise(F.raise_error(F.concat(F.lit("no duplicate flag: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("int"))


def unique_counts(rows: DataFrame, flag: str = "DU") -> DataFrame:
    return rows.agg(F.count_if(F.col(flag) == 0).alias("unique_reads"), F.count_if(F.col(flag) == 1).alias("duplicate_reads"))
