import os
import random
import subprocess
import sys

import duckdb
import pytest

import corpus_pipeline
from strandloom.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def plain(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert plain(df.select(*cols).collect()) == plain(con.sql(registry.oracle_sql()[name]).select(*cols).fetchall())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, SF).persist()
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and kept <= ids and (k != 3 or kept == ids)
        ids = kept
    assert {r.doc_id for r in corpus_pipeline.tokenised(spark, docs, SF).collect()} == ids


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and got.count() > 0


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


ELSEWHERE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from strandloom.llm import registry
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
for name in ("op2_toxicity", "op4_bpe", "op6_langid", "op8_decontaminate", "op10_urls"):
    print(name, registry.queries()[name](spark, {sf!r}).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED") and not k.startswith("PYSPARK_GATEWAY")}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(repo=repo, sf=SF)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0 and done.stdout.count("op") == 5, done.stderr[-2000:]


def odd_tables(spark, folder):
    """Small tables with nulls, repeated rows, empty and long texts, and labels and items to match."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(3))
    texts = [" ".join(word() for _ in range(40)) for _ in range(60)]
    rows = [(i, t, "en" if i % 2 else "de", "s") for i, t in enumerate(texts)]
    rows += [(100, None, "en", None), (101, "", None, "s"), (102, "w " * 30_000, "en", "s"), (None, texts[0], None, None), (103, "mail a@b.org " + texts[1], "en", "s"), rows[3], rows[3]]
    items = [("a", texts[5]), ("b", None), ("b", "one two"), (None, "x y z"), ("a", texts[5])]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(0, 1, 1), (None, None, None), (7, 1, None)]
    pages = [(i, f"http://a{i % 5}.net/p?{i}", "page " * i) for i in range(20)] + [(None, None, None), (30, "no url", ""), (3, "http://a.org/", "x")]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string"), ("benchmark", items, "item_id string, text string"), ("labels", labels, "doc_id long, quality int, toxic int"), ("pages", pages, "page_id long, url string, html string")):
        spark.createDataFrame(data, schema).selectExpr("*", "'own' as score", "'own' as _n", "'own' as items").write.parquet(f"{folder}/{name}.parquet")
    return rows


def test_registered_queries_on_odd_tables(spark, tmp_path):
    rows = odd_tables(spark, tmp_path)
    for name, q in registry.queries().items():
        got = q(spark, str(tmp_path)).collect()
        assert len(got) == (23 if name in ("op3_warc", "op10_urls") else len(rows)), name
        key = "page_id" if name in ("op3_warc", "op10_urls") else "doc_id"
        by = [tuple(r) for r in got if r[key] == 3]
        assert len(by) == (2 if key == "page_id" else 3) and (key == "page_id" or len({*map(repr, by)}) == 1), name
    for name in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    for name, q in registry.queries().items():
        assert q(spark, f"{tmp_path}/none").count() == 0, name


def test_pipeline_on_odd_tables(spark, tmp_path):
    rows = odd_tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).persist()
        assert docs.columns == columns and {r.score for r in docs.select("score").collect()} == {"own"}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert len(kept) == docs.count() and 5 not in kept and None not in kept and 100 in kept and 101 not in kept
    assert kept[1] == rows[1][1] and 103 not in kept  # near copies: the smallest id stays
    assert {r.doc_id for r in corpus_pipeline.tokenised(spark, docs, str(tmp_path)).collect()} == set(kept)
