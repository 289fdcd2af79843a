import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import numbers
from strandloom.operators import cells, dedup, fuzzy
from strandloom.plans import commands
from strandloom.sources import bam, tables

SCHEMA = "ord long, qname string, mate int, category string, paired boolean, unmapped boolean, mate_unmapped boolean, rname string, is_reverse boolean, ref_start int, ref_len int, cb string, as_tag double"
#: name, category, reference, reverse, start, length, barcode, score, unmapped, mate unmapped
FRAGMENTS = [
    ("low", "primary", "chr1", False, 100, 50, "A", 50.0, False, False),
    ("high", "primary", "chr1", False, 100, 50, "A", 90.0, False, False),
    ("cell", "primary", "chr1", False, 100, 50, "B", 10.0, False, False),
    ("chrom", "primary", "chr2", False, 100, 50, "A", 10.0, False, False),
    ("shift", "primary", "chr1", True, 210, 40, "A", 40.0, False, False),
    ("base", "primary", "chr1", True, 200, 50, "A", 80.0, False, False),
    ("noas", "primary", "chr1", False, 300, 50, "A", None, False, False),
    ("scored", "primary", "chr1", False, 300, 50, "A", 1.0, False, False),
    ("alone", "primary", "chr1", False, 400, 50, "A", None, False, False),
    ("tie1", "primary", "chr1", False, 500, 50, "A", 7.0, False, False),
    ("tie2", "primary", "chr1", False, 500, 50, "A", 7.0, False, False),
    ("un", "primary", "chr1", False, 600, 50, None, 7.0, True, False),
    ("mateun", "primary", "chr1", False, 600, 50, None, 7.0, False, True),
    ("high", "secondary", "chr1", False, 100, 50, "A", 99.0, False, False),
    ("base", "supplementary", "chr1", True, 200, 50, "A", 99.0, False, False),
]


@pytest.fixture(scope="module")
def records(spark):
    rows = []
    for name, cat, ref, rev, at, n, cb, score, un, mate_un in FRAGMENTS:
        for mate in (1, 2):
            rows.append((len(rows), name, mate, cat, True, un, mate_un, ref, rev, at, n, cb, score))
    return spark.createDataFrame(rows, SCHEMA).persist()


def test_linear_dedup(records):
    kept = {r.qname for r in dedup.linear_winners(records).collect()}
    assert kept == {"high", "cell", "chrom", "base", "scored", "alone", "tie1"}
    out = dedup.linear_dedup(records).collect()
    assert len(out) == 2 * len(kept) and {r.category for r in out} == {"primary"}


def test_linear_stats(records):
    got = {(r.measure, r.key): r.n for r in dedup.linear_stats(records).collect()}
    assert got == {("total", ""): 15, ("skipped", "non_primary"): 2, ("skipped", "unmapped"): 2, ("eligible", "chr1"): 10, ("eligible", "chr2"): 1, ("kept", "chr1"): 6, ("kept", "chr2"): 1}


def test_missing_barcodes_raise(records):
    with pytest.raises(Exception, match="no cb tag"):
        dedup.linear_winners(records.withColumn("cb", F.lit(None).cast("string"))).collect()


def test_keyed_best_agrees(records):
    rows = records.where("mate = 1 and category = 'primary' and cb is not null").withColumn("s", F.coalesce("as_tag", F.lit(float("-inf"))))
    keys = ["cb", "rname", "is_reverse", "ref_start"]
    a = {r.ord for r in dedup.best_of_group(rows, keys, F.col("s"), ["ord"]).collect()}
    assert a == {r.ord for r in dedup.best_keyed(rows, keys, F.col("s"), "ord").collect()}


def test_first_seen_and_umis(spark):
    rows = spark.createDataFrame([(0, "a", "chr1", 5, 90), (1, "b", "chr1", 5, 90), (2, "a", "chr1", 5, -90), (3, "c", "chr1", 5, 90), (4, "d", "*", 5, 90), (5, "x", "chr1", 5, 90)], "ord long, qname string, rname string, pos int, tlen int")
    barcodes = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "A"), ("d", "A")], "qname string, barcode string")
    assert {r.ord: r.DU for r in dedup.tagged(rows, barcodes).collect()} == {0: 0, 1: 1, 2: 0, 3: 1}
    umis = spark.createDataFrame([("a", "U", "U"), ("b", "V", "V")], "qname string, UR string, UB string")
    found = dedup.tagged(rows, barcodes, umis)
    assert {r.ord: r.DU for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
    n = dedup.unique_counts(found).first()
    assert (n.unique_reads, n.duplicate_reads) == (4, 0)


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(2)
    a = [(i, rng.choice("xy"), s := rng.randint(0, 300), s + rng.randint(0, 60)) for i in range(150)]
    b = [(i, rng.choice("xy"), s := rng.randint(0, 300), s + rng.randint(0, 60)) for i in range(120)]
    left, right = spark.createDataFrame(a, "i int, c string, start int, end int"), spark.createDataFrame(b, "j int, c string, start2 int, end2 int")
    for least in (1, 7):
        want = sorted((i, j) for i, c, s, e in a for j, d, t, f in b if c == d and min(e, f) - max(s, t) >= least)
        assert sorted((r.i, r.j) for r in cells.overlaps(left, right, 16, least, "c").collect()) == want
    assert "NestedLoop" not in cells.overlaps(left, right, 16, 1)._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        cells.overlaps(left, right, 16, 0)


def test_rank_is_total(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(200)], "k int, n int")
    got = [(r.rank, r.n, r.k) for r in cells.ranked(rows, [F.desc("n"), F.asc("k")]).orderBy("rank").collect()]
    assert [g[0] for g in got] == list(range(1, 201)) and [(g[1], g[2]) for g in got] == sorted(((i % 7, i) for i in range(200)), key=lambda x: (-x[0], x[1]))
    assert cells.ranked(rows.limit(0), [F.asc("k")]).count() == 0


def test_knee():
    assert cells.knee([100] * 20 + [1] * 80)[0] in (20, 21) and cells.knee([5, 5, 5]) is None and cells.knee([2, 1]) is None
    values = sorted((int(1000 / (1 + 2.718 ** ((i - 50) / 3))) + 1 for i in range(200)), reverse=True)
    assert 38 <= cells.knee(values)[0] <= 60


def test_forced_numbers():
    assert cells.checked_n(None, 5) is None and cells.checked_n(0, 5) == 5 and cells.checked_n(3, 5) == 3
    for bad, kind in ((6, ValueError), (-1, ValueError), ("3", TypeError), (True, TypeError)):
        with pytest.raises(kind):
            cells.checked_n(bad, 5)


def test_fuzzy_against_all_pairs(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 8))) for _ in range(80)]
    d = spark.createDataFrame([(w,) for w in words], "x string")
    from strandloom.plans.chemistry import distance

    want = sorted((a, b, distance(a, b)) for a in set(words) for b in set(words) if a < b and distance(a, b) <= 2)
    assert sorted(map(tuple, fuzzy.close_pairs(d, "x", 2).collect())) == want


HEADER = ("@HD\tVN:1.6\n", [("chr1", 5000), ("chr2", 5000)])


def alignments(spark):
    rows = [
        (0, "a", 99, "chr1", 10, 60, "10M", "chr1", 50, 50, "ACGTACGTAC", "IIIIIIIIII", ["CB:Z:AA", "AS:i:50", "XF:f:1.5", "XB:B:c,1,-2"]),
        (1, "a", 147, "chr1", 50, 60, "5M2D5M", "chr1", 10, -50, "ACGTACGTAN", "IIIIIIIIII", ["CB:Z:AA", "AS:i:50"]),
        (2, "b", 99, "chr1", 10, 60, "10M", "chr1", 50, 50, "ACGTACGTA", "*", ["CB:Z:AA", "AS:i:90", "XA:A:q"]),
        (3, "c", 0, "chr2", 7, 0, "3S7M", "*", -1, 0, "ACGTACGTAC", "IIIIIIIIII", ["CB:Z:BB"]),
        (4, "d", 77, "*", -1, 0, "*", "*", -1, 0, "*", "*", []),
    ]
    return spark.createDataFrame(rows, bam.SCHEMA)


def test_bam_round_trip(spark, tmp_path):
    path = str(tmp_path / "x.bam")
    bam.write_bam(alignments(spark), path, HEADER)
    assert bam.bam_header(path) == HEADER
    got, want = bam.read_bam(spark, path).orderBy("ord").collect(), alignments(spark).orderBy(F.col("rname") == "*", "rname", "pos", "ord").collect()
    assert [tuple(r)[1:] for r in got] == [tuple(r)[1:] for r in want]
    assert [tuple(r) for r in bam.read_bam_store(spark, path).orderBy("ord").collect()] == [tuple(r) for r in got]
    seen = {(r.qname, r.mate): r for r in bam.viewed(bam.read_bam(spark, path)).collect()}
    assert seen["a", 2].ref_len == 12 and seen["a", 2].is_reverse and seen["a", 1].cb == "AA" and seen["b", 1].as_tag == 90 and seen["d", 1].unmapped
    with open(path, "rb") as f:
        data = f.read()
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception, match="cut off"):
        bam.read_bam(spark, str(tmp_path / "cut.bam")).count()


def test_sam_text(spark, tmp_path):
    (tmp_path / "x.sam").write_text("@HD\tVN:1.6\na\t99\tchr1\t11\t60\t10M\t=\t51\t50\tACGTACGTAC\tIIIIIIIIII\tCB:Z:AA\n")
    r = bam.read_sam(spark, str(tmp_path / "x.sam")).first()
    assert (r.pos, r.rnext, r.pnext, r.tags) == (10, "chr1", 50, ["CB:Z:AA"])


def test_bam_commands(spark, tmp_path):
    path, out = str(tmp_path / "x.bam"), str(tmp_path / "out")
    bam.write_bam(alignments(spark).where("qname <> 'c'"), path, HEADER)
    stats = commands.linear_dedup(spark, path, out, "x")
    assert stats["pairs_kept"] == 1 and stats["skipped"] == {"unmapped": 1}
    assert {r.qname for r in bam.read_bam(spark, f"{out}/x.linear_dedup.bam").collect()} == {"b"}
    (tmp_path / "v.csv").write_text("a 2:N,AA,ok\nb 2:N,XX,ok\nb 2:N,AA,ok\n")
    (tmp_path / "u.tsv").write_text("a\tAA\tUUUU\tUUUC\n")
    n = commands.tag_deduplicate(spark, path, str(tmp_path / "v.csv"), out, "x", str(tmp_path / "u.tsv"), remove=True)
    assert n == {"unique_reads": 3, "duplicate_reads": 0}
    assert commands.tag_deduplicate(spark, path, str(tmp_path / "v.csv"), out, "y")["duplicate_reads"] == 1
    tagged = {(r.qname, r.flag): r.tags for r in bam.read_bam(spark, f"{out}/x.tagged.bam").collect()}
    assert "UB:Z:UUUC" in tagged["a", 99] and "DU:i:0" in tagged["a", 99] and not any(t.startswith("UB") for t in tagged["b", 99])
    assert commands.split_bam(spark, path, out, "x").collect()[0][1] == 3
    (tmp_path / "p.bed").write_text("chr1\t0\t15\tp2\t1\t.\textra\nchr1\t0\t15\tdup\t1\t.\nchr1\t55\t80\tp1\t1000\t.\n")
    bam.write_bam(alignments(spark).where("qname not in ('d')"), path, HEADER)
    assert commands.call_cells(spark, str(tmp_path / "p.bed"), path, out, "x", force_n=1) == {"cells": 1, "peaks": 2, "barcodes": 2}
    with open(f"{out}/x_matrix.mtx") as f:
        assert f.read().split("\n")[2:-1] == ["2 1 2", "1 1 1", "2 1 2"]
    with open(f"{out}/x_peaks.bed") as f:
        assert f.read() == "chr1\t55\t80\nchr1\t0\t15\n"


def test_bed(spark, tmp_path):
    path = tmp_path / "p.bed"
    for bad in ("chr1\t0\t5\n", "chr1\t0\t5\tx\t1001\t.\n"):
        path.write_text(bad)
        with pytest.raises(Exception, match="no BED6"):
            tables.bed(spark, str(path)).collect()
    path.write_text("chr1\t0\t5\tx\t7\t+\n")
    tables.write_bed(tables.bed(spark, str(path)), str(tmp_path / "o"), "ord")
    assert spark.read.text(str(tmp_path / "o")).first().value == "chr1\t0\t5\tx\t7\t+"
    assert tables.md5_matches(spark, str(path), __import__("hashlib").md5(path.read_bytes()).hexdigest().upper())


def test_whitelists(spark, tmp_path):
    path = tmp_path / "w"
    path.write_text("xxACGTyy\n\nxxTTTTyy\n")
    assert [r.entry for r in tables.whitelist(spark, str(path), (2, -2)).orderBy("ord").collect()] == ["ACGT", "TTTT"]
    assert [r.entry for r in tables.whitelist(spark, str(path)).orderBy("ord").collect()] == ["xxACGTyy", "xxTTTTyy"]


def test_status_lines_as_barcode_table(spark):
    d = spark.createDataFrame([("r 1:N|SUCCESS:PERFECT:ACGT|BC1:EXACTMATCH",)], "value string")
    assert tables.barcodes_from_status(d).first().barcode == "ACGT"


def test_single_cells_and_flags(spark, tmp_path):
    grid = spark.createDataFrame([("p", "b", 3)], "peak string, barcode string, n long")
    other = spark.createDataFrame([("b",), ("c",)], "barcode string")
    assert cells.cell_value(grid, "p", "b", grid, other) == 3 and cells.cell_value(grid, "p", "c", grid, other) == 0
    for bad, kind in ((("q", "b"), ValueError), (("p", 7), TypeError)):
        with pytest.raises(kind):
            cells.cell_value(grid, *bad, grid, other)
    flags = spark.createDataFrame([("0",), ("1",)], "x string")
    assert [r[0] for r in flags.select(dedup.checked_flag(F.col("x"))).collect()] == [0, 1]
    with pytest.raises(Exception, match="no duplicate flag: 2"):
        spark.createDataFrame([("2",)], "x string").select(dedup.checked_flag(F.col("x"))).collect()
    with pytest.raises(FileNotFoundError):
        bam.index_of(str(tmp_path / "x.bam"))


def test_knee_is_the_last_found_from_the_far_end():
    """Of two bends, online keeps the one of the lower rank; a sample with its ranks has the curve's own axis."""
    values = [1000] * 30 + [400] * 60 + [5] * 400
    rank, value = cells.knee(values)
    assert (rank, value) == (30, 1000)
    places = sorted({*range(1, 491, 7), 30, 31, 90, 91, 490})
    assert cells.knee([values[i - 1] for i in places], places) == (30, 1000)
    smooth = sorted((int(5000 / (1 + 2.718 ** ((i - 400) / 20))) + 1 for i in range(4000)), reverse=True)
    near = sorted({*numbers.log_spaced_ranks(4000, 300), *range(300, 500, 2)})
    assert abs(cells.knee(smooth)[0] - cells.knee([smooth[i - 1] for i in near], near)[0]) <= 4


def test_ranks_hold_no_cache(spark):
    before = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert cells.ranked(spark.range(50).toDF("k"), [F.asc("k")]).count() == 50
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == before
