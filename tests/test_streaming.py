from dataclasses import replace

from pyspark.sql import functions as F

from strandloom.plans import chemistry as C
from strandloom.streaming import stages

ENTRIES = ("ACGTTGCAAC", "TTGACCGATA", "GGCATTACGA")


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stages_stream(spark, tmp_path):
    base = C.chemistry("custom_seq_1_0")
    kit = replace(base, whitelists=base.whitelists | dict.fromkeys(("BC1", "BC2", "BC3"), ENTRIES))
    seq = ENTRIES[0] + "TGTGTATAAGGACCTCGTTGCC" + ENTRIES[1] + "ATGGAAGCCGACGAATTAGACC" + ENTRIES[2] + "ACGTACGAGGGGGGTATAGCCTAGATGTGTATAAGAGACAGCATTAG"
    for k in range(2):
        spark.createDataFrame([(k, f"r{k}", seq, "I" * len(seq))], stages.READS).write.mode("append").parquet(str(tmp_path / "in"))
    got = drained(stages.annotated_stream(stages.read_stream(spark, str(tmp_path / "in")), kit), "arms").collect()
    assert sorted((r.ord, r.arm, r.insert_seq) for r in got) == [(0, "TATAGCCT", "CATTAG"), (1, "TATAGCCT", "CATTAG")]


def test_first_seen_stream(spark, tmp_path):
    for rows in ([(1, "a"), (2, "b")], [(3, "a"), (4, "c")]):
        spark.createDataFrame(rows, "n int, k string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("n int, k string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert sorted(r.k for r in drained(stages.first_seen_stream(stream, ["k"]), "seen").collect()) == ["a", "b", "c"]


def test_windows_and_late_rows(spark, tmp_path):
    schema = "t timestamp, k string"
    for minute in ("2024-01-01 00:05:00", "2024-01-01 05:00:00", "2024-01-01 00:06:00"):
        spark.sql(f"SELECT TIMESTAMP '{minute}' AS t, 'a' AS k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = drained(stages.windowed_counts(stream, "t", ["k"]), "windows", "complete").agg(F.sum("n")).first()[0]
    assert got == 3
    once = stages.first_seen_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "t")
    assert drained(once, "once").count() == 1
