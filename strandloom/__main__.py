"""Command line: ``python -m strandloom COMMAND …``."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from strandloom.plans import commands
from strandloom.plans.chemistry import chemistry
from strandloom.sources.fastq import read_fastq


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    top.add_argument("-v", "--verbose", action="store_true")
    top.add_argument("-l", "--log-file")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *files: str, kit: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for f in files:
            p.add_argument(f)
        if kit:
            p.add_argument("-c", "--chemistry", required=True)
            p.add_argument("-w", "--whitelist", action="append", default=[], metavar="COMPONENT=FILE")
        p.add_argument("-o", "--output", default=".")
        p.add_argument("-p", "--prefix")
        return p

    command("extract-barcodes", "fastq", kit=True).add_argument("--fast", action="store_true")
    command("extract-umis", "r1", kit=True)
    command("assign-targets", "r1", kit=True)
    command("prepare-reads", "r1", "r2", kit=True)
    p = command("bam-tag-deduplicate", "bam", "valid_csv")
    p.add_argument("-d", "--dedup", action="store_true")
    p.add_argument("--umi-map")
    command("split-bam", "bam")
    p = command("call-cells", "bed", "bam")
    p.add_argument("-f", "--force-n", type=int)
    p.add_argument("-m", "--min-overlap", type=int, default=1)
    command("linear-dedup", "bam").add_argument("-b", "--barcode-tag", default="CB")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, filename=a.log_file)
    spark = spark or SparkSession.builder.appName("strandloom").getOrCreate()
    first = getattr(a, "fastq", None) or getattr(a, "r1", None) or getattr(a, "bam", None)
    prefix = a.prefix or first.rsplit("/", 1)[-1].partition(".")[0]
    kit = chemistry(a.chemistry).load(spark, dict(w.split("=", 1) for w in a.whitelist)) if "chemistry" in a else None
    run = {
        "extract-barcodes": lambda: commands.extract_barcodes(spark, a.fastq, kit, a.output, prefix, a.fast),
        "extract-umis": lambda: commands.extract_umis(spark, read_fastq(spark, a.r1), kit, a.output, prefix),
        "assign-targets": lambda: commands.assign_targets(spark, read_fastq(spark, a.r1), kit, a.output, prefix),
        "prepare-reads": lambda: commands.prepare_reads(spark, read_fastq(spark, a.r1), read_fastq(spark, a.r2), kit, a.output, prefix),
        "bam-tag-deduplicate": lambda: commands.tag_deduplicate(spark, a.bam, a.valid_csv, a.output, prefix, a.umi_map, a.dedup),
        "split-bam": lambda: commands.split_bam(spark, a.bam, a.output, prefix),
        "call-cells": lambda: commands.call_cells(spark, a.bed, a.bam, a.output, prefix, a.force_n, a.min_overlap),
        "linear-dedup": lambda: commands.linear_dedup(spark, a.bam, a.output, prefix, a.barcode_tag),
    }
    logging.info("%s: %s", a.command, run[a.command]())
    return 0


if __name__ == "__main__":
    sys.exit(main())
