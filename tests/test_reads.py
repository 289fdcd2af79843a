import glob
import gzip
import json
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandloom.__main__ import main
from strandloom.operators import reads, reports
from strandloom.plans import chemistry as C
from strandloom.plans import commands
from strandloom.sources.fastq import FastqReader, read_fastq, read_fastq_text, records

ENTRIES = ("ACGTTGCAAC", "TTGACCGATA", "GGCATTACGA", "CATGGTCTAC")
INSERT = "CATTAGACCATTACAGGATACC"


@pytest.fixture(scope="module")
def kit():
    base = C.chemistry("custom_seq_1_0")
    return replace(base, whitelists=base.whitelists | dict.fromkeys(("BC1", "BC2", "BC3"), ENTRIES))


def seq(bc=ENTRIES[:3], umi="ACGTACGA", run="GGGGGG", target="TATAGCCT", insert=INSERT):
    return bc[0] + "TGTGTATAAGGACCTCGTTGCC" + bc[1] + "ATGGAAGCCGACGAATTAGACC" + bc[2] + umi + run + target + "AGATGTGTATAAGAGACAG" + insert


CASES = [
    ("perfect", seq()),
    ("hurt", seq(bc=("NCGTTGCAAC", ENTRIES[1], ENTRIES[2]))),
    ("lost", "C" * 120),
    ("none", seq(target="CCAACCAA")),
    ("cut", seq()[:80]),
    ("short", seq()[:88]),
    ("noinsert", seq(insert="")),
    ("target1", seq(target="TATAGCCA")),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f"{n} 1:N:0", s, "I" * len(s)) for i, (n, s) in enumerate(CASES)], "ord long, name string, seq string, qual string").persist()


def test_extraction(rows, kit):
    found = {r.name.split()[0]: r for r in reads.extracted(rows, kit).withColumn("line", reads.status_line(kit)).collect()}
    full = "".join(ENTRIES[:3])
    assert found["perfect"].perfect and found["perfect"].line == f"perfect 1:N:0|SUCCESS:PERFECT:{full}|BC3:EXACTMATCH|BC2:EXACTMATCH|BC1:EXACTMATCH"
    assert found["hurt"].line == f"hurt 1:N:0|SUCCESS:CORROK:{full}|BC3:KMERMATCH-ED0|BC2:EXACTMATCH|BC1:EXACTMATCH"
    assert found["lost"].line == "lost 1:N:0|FAIL|BC3:NOMATCH|BC2:NOMATCH|BC1:NOMATCH" and not found["lost"].success


def test_perfect_reads_skip_python(rows, kit):
    plan = reads.extracted(rows, kit)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" in plan and "Join" not in plan


def test_umis_targets_and_arms(rows, kit):
    found = reads.with_targets(reads.with_umis(reads.extracted(rows, kit).where("success"), kit), kit)
    got = {r.name.split()[0]: r for r in found.collect()}
    assert got["perfect"].umi.value == "ACGTACGA" and got["perfect"].umi_run == 6 and (got["perfect"].target_start, got["perfect"].target_end) == (88, 96)
    assert got["cut"].umi_outcome == "truncated" and got["cut"].target_outcome == "short_window"
    assert got["none"].target == "NONE" and got["none"].target_outcome == "no_match" and got["target1"].target_distance == 1
    arms = {r.name.split()[0]: r for r in reads.prepared(found.where("umi_outcome = 'accepted'"), kit).collect()}
    assert arms["perfect"].arm == "TATAGCCT" and arms["perfect"].insert_seq == INSERT and arms["perfect"].header == f"perfect|CB={''.join(ENTRIES[:3])}|UR=ACGTACGA"
    assert arms["none"].arm == "none" and arms["none"].header == "none" and arms["none"].cut == 88
    assert arms["noinsert"].arm is None and arms["short"].arm is None


def jobs_of(spark, f):
    """What a function returns, and how many jobs it ran."""
    spark.sparkContext.setJobGroup("jobs_of", "")
    try:
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("jobs_of"))
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup("jobs_of")) - before
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_filters_stay_out_of_the_stages(rows, kit):
    found = reads.with_targets(reads.with_umis(reads.extracted(rows, kit), kit), kit)
    for kept in (found.where("target_outcome = 'matched'"), found.where("umi_outcome = 'accepted'"), reads.prepared(found.where("umi is not null"), kit).where("arm = 'none'")):
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert 1 <= plan.count("ArrowEvalPython") <= 2
    assert [r.ord for r in found.where("target_outcome = 'no_match'").collect()] == [3]


def test_stage_stats_are_one_pass(spark, rows, kit):
    found = reads.with_targets(reads.with_umis(reads.extracted(rows, kit), kit), kit)
    hold = lambda: [r.asDict() for r in found.collect()]
    once, passes = jobs_of(spark, lambda: reports.tally(found, "target_outcome"))
    n = lambda rs, k: {v: sum(r[k] == v for r in rs) for v in sorted({r[k] for r in rs} - {None})}
    all_reads = hold()
    hit, kept = [r for r in all_reads if r["target_outcome"] == "matched"], [r for r in all_reads if r["umi_outcome"] == "accepted"]
    target, jobs = jobs_of(spark, lambda: reports.target_stats(found))
    assert jobs == passes and {k[0]: v for k, v in once.items()} == n(all_reads, "target_outcome")
    assert target == {"total": 8, "matched": 4, "no_match": 1, "no_left_anchor_pos": 1, "short_window": 2, "targets": n(hit, "target"), "distances": n(hit, "target_distance"), "runs": n(all_reads, "target_run")}
    assert list(target["distances"].items()) == [(0, 3), (1, 1)]
    umi, jobs = jobs_of(spark, lambda: reports.umi_stats(found))
    assert jobs == passes and umi == {"total": 8, "accepted": 6, "missing_left_anchor": 1, "truncated": 1, "runs": n(kept, "umi_run")}


def test_extraction_stats_match_reads_once(spark, kit):
    close = replace(kit, enforce=False, whitelists={**kit.whitelists, "BC3": (*ENTRIES, "ACGTTGCAAG")})
    seqs = [s for _, s in CASES] + [seq(bc=("ACGTTGCAAT", *ENTRIES[1:3])), seq(bc=("ACGTTGCAAT", *ENTRIES[1:3])).replace("TGTGTATAAGGACCTCGTTGCC", "TGTGTATAAGGACCTCGTTGCA"), seq(bc=ENTRIES[1:4]), "T" + seq()]
    # the accumulator counts the reads that reach the stage, in all jobs
    made = spark.sparkContext.accumulator(0)
    listed = [(i, "r", s, "I" * len(s)) for i, s in enumerate(seqs)]
    counted = spark.sparkContext.parallelize(listed, 2).map(lambda r: (made.add(1), r)[1])
    found = reads.extracted(spark.createDataFrame(counted, "ord long, name string, seq string, qual string"), close)
    stats, once = reports.extraction_stats(found, close), made.value
    assert once == len(seqs)
    want = found.collect()
    assert [stats[k] for k in ("total", "perfect", "corrected", "failed")] == [len(want), sum(r.perfect for r in want), sum(r.success and not r.perfect for r in want), sum(not r.success for r in want)]
    parts = {}
    for r in want:
        for k in {(a.bc, a.method) for a in r.attempts}:
            own = [a for a in r.attempts if (a.bc, a.method) == k]
            p = parts.setdefault(k, {"checked": 0, "matched": 0, "failed": 0, "ambiguous": 0, "distances": {}, "spacers": 0})
            hit = any(a.match for a in own)
            p["checked"], p["matched"], p["failed"], p["ambiguous"] = p["checked"] + 1, p["matched"] + hit, p["failed"] + (not hit), p["ambiguous"] + (len(own) > 1)
            p["spacers"] += sum(a.upstream is not None or a.downstream is not None for a in own)
            for a in own:
                if a.distance is not None:
                    p["distances"][a.distance] = p["distances"].get(a.distance, 0) + 1
    assert stats["parts"] == parts and any(p["ambiguous"] for p in parts.values()) and any(p["spacers"] for p in parts.values())
    n = {b: (sum(r.full_barcode == b for r in want), min(r.ord for r in want if r.full_barcode == b)) for b in {r.full_barcode for r in want} - {None}}
    assert stats["top"] == [(b, k) for b, (k, _) in sorted(n.items(), key=lambda x: (-x[1][0], x[1][1]))]


def test_headers_carry_the_stages(rows, kit):
    found = reads.with_targets(reads.with_umis(reads.extracted(rows.where("ord = 0"), kit), kit), kit)
    text = reads.annotated(found, kit).first().name
    assert text == "perfect 1:N:0 BC3=ACGTTGCAAC BC3_POS=0:10 BC2=TTGACCGATA BC2_POS=32:42 BC1=GGCATTACGA BC1_POS=64:74 UMI=ACGTACGA UMI_POS=74:82 TGIDX=TATAGCCT TGIDX_POS=88:96"
    back = reads.parsed(reads.annotated(found, kit).select("ord", "name", "seq", "qual"), kit).first()
    assert back.read_id == "perfect" and [c.end for c in back.calls] == [10, 42, 74] and back.umi.end == 82 and back.target_end == 96


def test_headers_are_taken_apart_once(rows, kit):
    found = reads.with_targets(reads.with_umis(reads.extracted(rows, kit), kit), kit)
    for made in (reads.annotated(found, kit).select("name"), reads.parsed(rows, kit).select("read_id", "calls", "umi", "target", "target_end")):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("split(trim(") == 1
    back = reads.parsed(reads.annotated(found, kit).select("ord", "name", "seq", "qual"), kit)
    same = lambda d: sorted(map(str, d.select("ord", "calls", "umi", "target", "target_start", "target_end").collect()))
    assert back.columns == ["ord", "name", "seq", "qual", "read_id", "calls", "umi", "target", "target_start", "target_end"] and same(back) == same(found)


def test_missing_headers_raise(spark, rows, kit):
    with pytest.raises(ValueError, match="BC1_POS"):
        reads.checked_headers(rows, "BC1_POS")
    reads.checked_headers(rows.limit(0), "BC1_POS")
    bad = rows.where("ord = 0").withColumn("name", F.lit("x TGIDX=TATAGCCT"))
    with pytest.raises(Exception, match="no span to cut at"):
        reads.prepared(reads.parsed(bad, kit), kit).collect()


def test_pairs(spark):
    r1 = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "ord long, read_id string")
    r2 = spark.createDataFrame([(0, "a 2", "X", "!"), (1, "b 2", "Y", "!"), (2, "a 2", "Z", "!"), (3, "c 2", "W", "!")], "ord long, name string, seq string, qual string")
    assert [r.seq2 for r in reads.paired(r1, r2).orderBy("ord").collect()] == ["X", "Y", "Z"]
    with pytest.raises(Exception, match="no second read of b"):
        reads.paired(r1, r2.where("ord <> 1")).collect()


def test_buckets(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,)], "arm string")
    assert {k: d.count() for k, d in reads.routed(rows, "arm", ["a", "b"]).items()} == {"a": 2, "b": 0}
    with pytest.raises(Exception, match="no such bucket"):
        reads.routed(rows, "arm", ["b"])["b"].collect()
    assert {r.bucket: r.n for r in reads.bucket_counts(rows, "arm", ["a", "b"]).collect()} == {"a": 2, "b": 0}


def lines(path):
    out = []
    for part in sorted(glob.glob(os.path.join(path, "part-*"))):
        with (gzip.open if part.endswith(".gz") else open)(part, "rt") as f:
            out += f.read().split("\n")[:-1]
    return out


def test_commands_from_file_to_file(spark, kit, tmp_path):
    r1, r2, out = tmp_path / "lib_R1.fastq", tmp_path / "lib_R2.fastq.gz", str(tmp_path / "out")
    r1.write_text("".join(f"@{n} 1:N:0\n{s}\n+\n{'I' * len(s)}\n" for n, s in CASES))
    with gzip.open(r2, "wt") as f:
        f.write("".join(f"@{n} 2:N:0\n{'ACGT' * 5}\n+\n{'#' * 20}\n" for n, _ in CASES))
    for k in ("BC1", "BC2", "BC3"):
        (tmp_path / k).write_text("\n".join(ENTRIES) + "\n\n")
    lists = [x for k in ("BC1", "BC2", "BC3") for x in ("-w", f"{k}={tmp_path / k}")]
    common = ["-c", "custom_seq_1_0", *lists, "-o", out, "-p", "lib"]
    assert main(["extract-barcodes", str(r1), *common], spark) == 0
    assert len(lines(f"{out}/lib.bc_all.txt")) == 8 and lines(f"{out}/lib.bc_counts.csv") == ["".join(ENTRIES[:3]) + ",7"]
    stage = lambda name: read_fastq(spark, ",".join(sorted(glob.glob(f"{out}/lib.{name}.fastq/part-*"))))
    umi = commands.extract_umis(spark, stage("r1_annotated"), kit, out, "lib")
    assert umi["total"] == 7 and umi["accepted"] == 6 and umi["truncated"] == 1
    target = commands.assign_targets(spark, stage("r1_umi"), kit, out, "lib")
    assert (target["matched"], target["no_match"], target["short_window"]) == (4, 1, 1)
    done = commands.prepare_reads(spark, stage("r1_tgidx"), read_fastq(spark, str(r2)), kit, out, "lib")
    assert done["total"] == 6 == done["unmatched"] + done["matched"] + done["insert_not_sequenced"] and done["targets"] == {"TATAGCCT": 3}
    assert lines(f"{out}/lib.TATAGCCT.r1.fastq")[1] == INSERT and lines(f"{out}/lib.none.barcodes.fastq")[1] == "".join(ENTRIES[:3]) + "ACGTACGA"
    with open(f"{out}/lib.detected_targets.txt") as f:
        assert f.read() == "NONE\t1\nTATAGCCT\t3\n"
    assert json.load(open(f"{out}/lib.prepare_breakdown_mqc.json"))["data"]["lib"]["unmatched"] == 1


def test_reports(rows, kit, tmp_path):
    found = reads.extracted(rows, kit)
    stats = reports.extraction_stats(found, kit)
    assert (stats["total"], stats["perfect"], stats["corrected"], stats["failed"]) == (8, 6, 1, 1)
    assert stats["parts"]["BC3", "KMERMATCH"] == {"checked": 2, "matched": 1, "failed": 1, "ambiguous": 0, "distances": {0: 1}, "spacers": 0}
    assert "## BC3 by KMERMATCH" in reports.extraction_report(stats) and reports.combined_distances(stats) == {0: 1}
    with pytest.raises(ValueError, match="no reads"):
        reports.extraction_stats(found.limit(0), kit)
    with pytest.raises(ValueError, match="without points"):
        reports.xy({})
    with pytest.raises(ValueError, match="no id"):
        reports.write_payloads(str(tmp_path), "x", [{"id": "a", "data": {"b": 1}}, dict(id="", data={})])
    assert not os.listdir(tmp_path)
    assert reports.write_payloads(str(tmp_path), "x", [None, {"id": "strandloom_a", "data": {"b": 1}}]) == [str(tmp_path / "x.a_mqc.json")]
    assert reports.rank_svg([(1, 100), (10, 1), (11, 0)], 10).count("<") > 5 and "polyline" in reports.rank_svg([])
    assert reports.rank_payload("s", [(1, 5), (2, 0)])["data"]["s"] == [[1, 5]] and reports.rank_payload("s", []) is None


def test_fastq_splits(tmp_path, spark):
    path = tmp_path / "x.fastq"
    path.write_text("".join(f"@r{i}\n{'ACGT'[: i % 4 + 1]}\n+\n{'@+@+'[: i % 4 + 1]}\n" for i in range(500)) + "@half\nAC\n")
    want = [f"r{i}" for i in range(500)]
    for size in (37, 500, 1 << 20):
        reader = FastqReader({"path": str(path), "splitbytes": size})
        assert [n for p in reader.partitions() for n, _, _ in records(p)] == want
    assert [r.name for r in read_fastq(spark, str(path)).orderBy("ord").collect()] == want
    assert [r.name for r in read_fastq_text(spark, str(path)).orderBy("ord").collect()] == want
    pairs = read_fastq(spark, str(path), paired=True)
    assert pairs.count() == 250 and pairs.orderBy("ord").first().name2 == "r1"
    with gzip.open(tmp_path / "x.fastq.gz", "wb") as f:
        f.write(path.read_bytes())
    assert read_fastq(spark, str(tmp_path / "x.fastq.gz")).count() == 500
    broken = tmp_path / "b.fastq.gz"
    broken.write_bytes((tmp_path / "x.fastq.gz").read_bytes()[:-20])
    with pytest.raises(Exception, match="(?i)eof|end-of-stream|ended"):
        read_fastq(spark, str(broken)).count()
    with pytest.raises(Exception, match="(?i)not.*found|missing.fastq"):
        read_fastq(spark, str(tmp_path / "missing.fastq")).count()


def test_lz4_lines(spark, tmp_path):
    import pyarrow as pa

    text = "".join(f"@r{i}\nACGT{'ACGT' * (i % 40)}\n+\nIIII{'IIII' * (i % 40)}\n" for i in range(30_000))
    with pa.CompressedOutputStream(pa.OSFile(f"{tmp_path}/a.fastq.lz4", "wb"), "lz4") as f:
        f.write(text.encode())
    rows = read_fastq(spark, f"{tmp_path}/a.fastq.lz4")
    assert rows.count() == 30_000 and rows.where("length(seq) <> length(qual)").count() == 0
