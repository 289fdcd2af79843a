import os

import duckdb
import pytest

import __spark_entry__ as entry
from strandloom.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows):
    return sorted(repr(tuple(str(x) if hasattr(x, "year") else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert plain(map(tuple, df.select(*cols).collect())) == plain(want.select(*(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", ["extraction_counts", "extraction_totals", "target_outcomes", "umi_outcomes"])
def test_reports_read_their_table_once(spark, monkeypatch, name):
    read = spark.sparkContext.accumulator(0)
    keys = spark.sparkContext.parallelize([(k, 3 * k) for k in range(70)], 2).map(lambda r: (read.add(1), r)[1])
    orders = spark.createDataFrame(keys, "o_orderkey long, o_custkey long")
    monkeypatch.setattr(catalog, "table", lambda *_: orders)
    assert catalog.queries()[name](spark, "").count() and read.value == 70


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_knee_query(spark):
    assert catalog.queries()["knee_point"](spark, SF).columns == ["rank", "n"]


def test_no_nested_loops(spark):
    for name in ("interval_overlap", "kmer_fuzzy_lookup", "whitelist_close_pairs", "tag_dedup"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_pruned_scans(spark):
    plan = catalog.queries()["linear_dedup"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "l_tax" not in plan
