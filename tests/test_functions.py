import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import headers, numbers
from strandloom.functions import sequences as S
from strandloom.operators.lookup import prefix_distances


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_header_round_trip(spark):
    h = headers.parse(F.lit("  id1 loose BC1=AC  x=1 BC1=GT other "))
    r = one(spark, h=h, out=headers.render(h["read_id"], h["passthrough"], headers.with_tag(h["tags"], "UMI", F.lit("T"))), bc=headers.tag(h["tags"], "BC1"), none=headers.tag(h["tags"], "zz"))
    assert r.h.read_id == "id1" and r.h.passthrough == ["loose", "other"]
    assert r.out == "id1 loose other BC1=GT x=1 UMI=T" and r.bc == "GT" and r.none is None


def test_headers_against_plain_python(spark):
    rng = random.Random(17)
    token = lambda: rng.choice(["a", "b", "loose", "=", "x=", "a=1", "b=2", "a=b=3", "c=", f"k{rng.randint(0, 9)}={rng.randint(0, 9)}"])
    texts = [None, "", "  ", *(" ".join(token() for _ in range(rng.randint(1, 12))) for _ in range(200))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string")
    got = headers.with_parsed(rows.withColumn("h", headers.parse(F.col("x"))), "x").orderBy("i").collect()
    for text, r in zip(texts, got, strict=True):
        first, *rest = (text or "").split() or [None]
        loose, tags = [x for x in rest if "=" not in x], {}
        for x in rest:
            if "=" in x:
                tags[x.split("=", 1)[0]] = x.split("=", 1)[1]
        want = (first, loose, list(tags.items())) if text is not None else (None, None, None)
        for read_id, passthrough, found in ((r._read_id, r._passthrough, r._tags), (r.h.read_id, r.h.passthrough, r.h.tags)):
            assert (read_id, passthrough, found and [tuple(t) for t in found]) == want


def test_header_set_keeps_the_place(spark):
    h = headers.parse(F.lit("r a=1 b=2"))
    assert one(spark, x=headers.render(h["read_id"], h["passthrough"], headers.with_tag(h["tags"], "a", F.lit("9")))).x == "r a=9 b=2"


@pytest.mark.parametrize("text", ["1", "1:2:3", "a:2", "-1:2", "3:2", ""])
def test_bad_spans_raise(spark, text):
    with pytest.raises(Exception, match="span"):
        one(spark, s=headers.parse_span(F.lit(text)))


def test_spans(spark):
    r = one(spark, a=headers.parse_span(F.lit("3:3")), b=headers.parse_span(F.lit(None).cast("string")), c=headers.span(F.lit(0), F.lit(4)), p=headers.file_prefix(F.lit("/a.b/c.d.fastq.gz")))
    assert (r.a.start, r.a.end) == (3, 3) and r.b is None and r.c == "0:4" and r.p == "c"


def test_edit_distance_with_wildcards(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ACGTN") for _ in range(rng.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(300)]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == prefix_distances(r.a, r.b)[-1] for r in got)
    assert one(spark, d=S.edit_distance(F.lit("NAC"), F.lit("GAC"), wildcard=False)).d == 1


def test_hamming(spark):
    assert one(spark, d=S.hamming(F.lit("ACGT"), F.lit("AGGA"))).d == 2
    with pytest.raises(Exception, match="lengths differ"):
        one(spark, d=S.hamming(F.lit("A"), F.lit("AB")))


@pytest.mark.parametrize(
    ("seq", "at", "span"),
    [("AAGGGGT", 2, (2, 6)), ("AATGGGC", 2, (3, 6)), ("AATTGGG", 2, (4, 7)), ("AATTTGGG", 2, (2, 2)), ("AAGGTGGGA", 2, (2, 8)), ("AAGGTGGA", 2, (2, 4)), ("AATGG", 2, (2, 2)), ("AAG", 2, (2, 3)), ("AA", 5, (5, 5))],
)
def test_anchor_run(spark, seq, at, span):
    r = one(spark, x=S.anchor_run(F.lit(seq), F.lit(at), "G", 3)).x
    assert (r.start, r.end) == span


def test_windows_and_slices(spark):
    r = one(
        spark,
        run=S.run_length(F.lit("AGGGA"), F.lit(1), "G"), past=S.run_length(F.lit("A"), F.lit(9), "G"), u=S.umi_slice(F.lit("ABCDEFGH"), F.lit(2), 1, 4), short=S.umi_slice(F.lit("ABC"), F.lit(2), 1, 4),
        w=S.target_window(F.lit("ACGTACGTACGT"), F.lit(4), 4, 1), end=S.target_window(F.lit("ACGT"), F.lit(9), 8, 1), clean=S.sanitised(F.lit("AcGX")), d=S.deletions(F.lit("ABC"), 2), v=S.overlap(F.lit(1), F.lit(5), F.lit(3), F.lit(9)),
    )
    assert (r.run, r.past) == (3, 0) and (r.u.value, r.u.start, r.u.end) == ("DEFG", 3, 7) and r.short is None
    assert (r.w.start, r.w.sequence, r.w.matchable) == (1, "CGTACGTA", True) and r.end.matchable is False
    assert r.clean == "ANGN" and set(r.d) == {"ABC", "BC", "AC", "AB", "A", "B", "C"} and r.v == 2


def test_ranks_and_fractions(spark):
    assert numbers.log_spaced_ranks(5) == [1, 2, 3, 4, 5]
    many = numbers.log_spaced_ranks(10_000, 50)
    assert many[0] == 1 and many[-1] == 10_000 and many == sorted(set(many)) and len(many) <= 50
    assert numbers.percent(1, 0) == "0.00%" and one(spark, x=numbers.fraction(F.lit(1), F.lit(0))).x == 0.0


def test_durations():
    assert [numbers.duration(x) for x in (5, 65, 3725)] == ["5s", "1m 5s", "1h 2m 5s"]
