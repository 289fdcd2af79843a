"""The eight workflow commands from files to files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.numbers import sampled_ranks
from strandloom.operators import cells, dedup, reads, reports
from strandloom.plans.chemistry import Chemistry, Kind
from strandloom.sources import bam
from strandloom.sources.fastq import read_fastq, write_fastq
from strandloom.sources.tables import bed, read_barcodes, read_umis, write_lines


#: Ranks that the driver gets of a curve to find its knee on; a shorter curve is taken whole.
KNEE_POINTS = 100_000


def put(folder: str, name: str, text: str) -> None:
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def extract_barcodes(spark: SparkSession, fastq: str, kit: Chemistry, out: str, prefix: str, fast: bool = False) -> dict:
    """Status lines of all and of valid reads, annotated reads, barcode counts, report and payloads."""
    os.makedirs(out, exist_ok=True)
    found = reads.extracted(read_fastq(spark, fastq), kit, fast).persist()
    stats = reports.extraction_stats(found, kit)
    at = lambda name: os.path.join(out, f"{prefix}.{name}")
    lines = found.select("ord", "success", reads.status_line(kit).alias("value"))
    write_lines(lines, at("bc_all.txt"), compression="gzip")
    write_lines(lines.where("success"), at("bc_valid.txt"), compression="gzip")
    write_fastq(reads.annotated(found.where("success"), kit), at("r1_annotated.fastq"))
    counts = cells.full_counts(found.where("success"), "full_barcode", "ord")
    listed = cells.ranked(counts, [F.desc("count"), F.asc("_first")])
    write_lines(listed.select(F.col("rank").alias("ord"), F.concat_ws(",", "full_barcode", F.col("count").cast("string")).alias("value")), at("bc_counts.csv"))
    put(out, f"{prefix}.bc_stats.txt", reports.extraction_report(stats))
    plain = {k: stats[k] for k in ("total", "perfect", "corrected", "failed")}
    sampled = sampled_ranks(listed, listed.count()).orderBy("rank").collect()
    curve = [(r["rank"], r["count"]) for r in sampled]
    put(out, f"{prefix}.bc_rank.svg", reports.rank_svg(curve))
    reports.write_payloads(out, prefix, [*reports.payloads("extract", prefix, plain | {"edit_distance": reports.combined_distances(stats) or {}}), reports.rank_payload(prefix, curve)])
    found.unpersist()
    return stats


def extract_umis(spark: SparkSession, r1: DataFrame, kit: Chemistry, out: str, prefix: str) -> dict:
    umi = kit.first(Kind.UMI)
    if umi is None:
        raise ValueError(f"{kit.name} has no UMI")
    reads.checked_headers(r1, kit.anchor(umi.name)[0].spans)
    os.makedirs(out, exist_ok=True)
    found = reads.with_umis(reads.parsed(r1, kit).drop("umi", "target", "target_start", "target_end"), kit).persist()
    stats = reports.umi_stats(found)
    write_fastq(reads.annotated(found.where("umi_outcome = 'accepted'"), kit), os.path.join(out, f"{prefix}.r1_umi.fastq"))
    put(out, f"{prefix}.umi_stats.txt", reports.report("UMIs", stats))
    reports.write_payloads(out, prefix, reports.payloads("umi", prefix, stats))
    found.unpersist()
    return stats


def assign_targets(spark: SparkSession, r1: DataFrame, kit: Chemistry, out: str, prefix: str) -> dict:
    reads.checked_headers(r1, kit.anchor(kit.layout.beside(kit.first(Kind.TARGET).name, -1).name)[0].spans)
    os.makedirs(out, exist_ok=True)
    found = reads.with_targets(reads.parsed(r1, kit).drop("target", "target_start", "target_end"), kit).persist()
    stats = reports.target_stats(found)
    write_fastq(reads.annotated(found, kit), os.path.join(out, f"{prefix}.r1_tgidx.fastq"))
    put(out, f"{prefix}.tgidx_stats.txt", reports.report("Targets", stats))
    reports.write_payloads(out, prefix, reports.payloads("assign", prefix, stats))
    found.unpersist()
    return stats


def prepare_reads(spark: SparkSession, r1: DataFrame, r2: DataFrame, kit: Chemistry, out: str, prefix: str) -> dict:
    """Cut reads of every arm, empty ones included, with their mates, and the unmatched arm's barcode reads."""
    os.makedirs(out, exist_ok=True)
    found = reads.paired(reads.prepared(reads.parsed(r1, kit), kit), r2).persist()
    target = kit.first(Kind.TARGET)
    arms = ["none", *(kit.whitelist(target.name) if target is not None else ())]
    for arm, rows in reads.routed(found, "arm", arms).items():
        at = lambda name, arm=arm: os.path.join(out, f"{prefix}.{arm}.{name}.fastq")
        write_fastq(rows, at("r1"), name="header", seq="insert_seq", qual="insert_qual")
        write_fastq(rows, at("r2"), name="header", seq="seq2", qual="qual2")
    write_fastq(reads.barcode_records(found, kit), os.path.join(out, f"{prefix}.none.barcodes.fastq"), name="read_id")
    stats = reports.prepare_stats(found)
    put(out, f"{prefix}.prepare_stats.txt", reports.report("Prepared reads", stats))
    put(out, f"{prefix}.detected_targets.txt", reports.detected_targets(stats))
    reports.write_payloads(out, prefix, reports.payloads("prepare", prefix, stats))
    found.unpersist()
    return stats


def linear_dedup(spark: SparkSession, path: str, out: str, prefix: str, tag: str = "CB") -> dict:
    os.makedirs(out, exist_ok=True)
    records = bam.viewed(bam.read_bam(spark, path), tag).persist()
    stats = reports.linear_stats(dedup.linear_stats(records))
    bam.write_bam(dedup.linear_dedup(records), os.path.join(out, f"{prefix}.linear_dedup.bam"), bam.bam_header(path))
    put(out, f"{prefix}.linear_dedup_stats.txt", reports.report("Linear deduplication", stats))
    reports.write_payloads(out, prefix, reports.payloads("linear_dedup", prefix, stats))
    records.unpersist()
    return stats


def tag_deduplicate(spark: SparkSession, path: str, valid_csv: str, out: str, prefix: str, umi_map: str | None = None, remove: bool = False) -> dict:
    os.makedirs(out, exist_ok=True)
    umis = read_umis(spark, umi_map) if umi_map else None
    found = dedup.tagged(bam.read_bam(spark, path), read_barcodes(spark, valid_csv), umis).persist()
    tags = bam.with_tag("CB", "Z", F.col("CB"))
    for name, kind in (("UR", "Z"), ("UB", "Z")) if umis is not None else ():
        found = found.withColumn("tags", bam.with_tag(name, kind, F.col(name)))
    found = found.withColumn("tags", tags).withColumn("tags", bam.with_tag("DU", "i", F.col("DU")))
    head = bam.bam_header(path)
    bam.write_bam(found, os.path.join(out, f"{prefix}.tagged.bam"), head, ["ord"])
    if remove:
        bam.write_bam(found.where("DU = 0"), os.path.join(out, f"{prefix}.dedup.tagged.bam"), head, ["ord"])
    n = dedup.unique_counts(found).first().asDict()
    put(out, f"{prefix}.dedup.stats_mqc.log", "unique_reads,duplicate_reads\n{unique_reads},{duplicate_reads}\n".format(**n))
    return n


def split_bam(spark: SparkSession, path: str, out: str, prefix: str) -> DataFrame:
    """A folder of coordinate-sorted records for each barcode, and their counts. A record without a barcode raises."""
    os.makedirs(out, exist_ok=True)
    cb = bam.tag("CB")
    checked = F.when(cb.isNotNull() & (cb != ""), cb).otherwise(F.raise_error(F.concat(F.lit("no CB tag: "), F.col("qname"))).cast("string"))
    records = bam.read_bam(spark, path).where("rname <> '*'").withColumn("CB", checked)
    cells.split(records, os.path.join(out, f"{prefix}.split"))
    counts = cells.split_counts(records)
    put(out, f"{prefix}_split_counts.csv", "barcode,count\n" + "".join(f"{r[0]},{r[1]}\n" for r in counts.toLocalIterator()))
    return counts


def call_cells(spark: SparkSession, peaks_path: str, path: str, out: str, prefix: str, force_n: int | None = None, min_overlap: int = 1) -> dict:
    """Barcodes, peaks and matrix of the called cells; peaks in the matrix's row order."""
    os.makedirs(out, exist_ok=True)
    records = bam.viewed(bam.read_bam(spark, path)).select("rname", F.col("ref_start").alias("start"), (F.col("ref_start") + F.col("ref_len")).alias("end"), F.col("cb").alias("CB"))
    peaks = bed(spark, peaks_path)
    grid = cells.peak_counts(records, peaks, min_overlap).persist()
    everyone = records.select(F.col("CB").alias("barcode")).distinct()
    totals = cells.column_sums(grid, everyone).persist()
    most = totals.count()
    n = cells.checked_n(force_n, most)
    curve = cells.rank_curve(totals, "n", "barcode")
    sampled = [(r["rank"], r.n) for r in sampled_ranks(curve, curve.count(), KNEE_POINTS).orderBy("rank").collect()]
    if n is None:
        at = cells.knee([v for _, v in sampled], [k for k, _ in sampled])
        n = at[0] if at else most
    put(out, f"{prefix}_cells.svg", reports.rank_svg(sampled, n or None))
    top = cells.top_cells(totals, n).persist()
    features = cells.selected_features(grid, top)
    rows, columns = cells.indexed(features, "peak", "row").persist(), cells.indexed(top, "barcode", "col").persist()
    put(out, f"{prefix}_barcodes.tsv", "".join(f"{r.barcode}\n" for r in columns.orderBy("col").toLocalIterator()))
    places = cells.distinct_peaks(peaks).join(rows, F.col("name") == F.col("peak")).orderBy("row", "ord")
    put(out, f"{prefix}_peaks.bed", "".join(f"{r.chrom}\t{r.start}\t{r.end}\n" for r in places.toLocalIterator()))
    sliced = grid.join(rows, "peak").join(columns, "barcode").select("row", "col", "n")
    lines = cells.matrix_lines(sliced, rows.count(), columns.count()).orderBy("ord")
    with open(os.path.join(out, f"{prefix}_matrix.mtx"), "w", encoding="utf-8") as f:
        f.writelines(f"{r.value}\n" for r in lines.toLocalIterator())
    return {"cells": columns.count(), "peaks": rows.count(), "barcodes": most}
