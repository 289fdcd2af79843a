"""The registered queries of the library and the SQL that checks them.

Each applies an operator to the driver's relational tables; the operators are those that read files go through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import headers, numbers
from strandloom.functions import sequences as S
from strandloom.operators import cells, dedup, fuzzy, reads, reports

FLAGSHIP = "linear_dedup"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def exact_lookup(spark, sf):
    return fuzzy.exact_lookup(table(spark, sf, "customer"), table(spark, sf, "nation"), "c_nationkey", "n_nationkey").select("c_custkey", "c_name", "n_name")


def damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with the name of their nation, less one letter."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    at = (F.col("s_suppkey") % F.length("n_name")).cast("int")
    return s.select("s_suppkey", F.concat(F.substr("n_name", F.lit(1), at), F.substr("n_name", at + 2)).alias("damaged"))


DAMAGED = "d AS (SELECT s_suppkey, substr(n_name, 1, CAST(s_suppkey % length(n_name) AS INT)) || substr(n_name, CAST(s_suppkey % length(n_name) AS INT) + 2) AS damaged FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
KMERS = "p AS (SELECT DISTINCT damaged, n_name, levenshtein(damaged, n_name) AS distance FROM d, nation WHERE levenshtein(damaged, n_name) <= 2 AND abs(length(damaged) - length(n_name)) <= 2 AND length(damaged) >= 4 AND length(n_name) >= 4 AND list_has_any([substr(damaged, i, 4) FOR i IN range(1, length(damaged) - 2)], [substr(n_name, i, 4) FOR i IN range(1, length(n_name) - 2)]))"


@query(f"WITH {DAMAGED}, {KMERS} SELECT s_suppkey, p.damaged, n_name, CAST(distance AS INT) AS distance FROM d JOIN p ON d.damaged = p.damaged")
def kmer_fuzzy_lookup(spark, sf):
    rows = damaged(spark, sf)
    return rows.join(fuzzy.fuzzy_lookup(rows, table(spark, sf, "nation"), "damaged", "n_name", 2), "damaged").select("s_suppkey", "damaged", "n_name", F.col("distance").cast("int").alias("distance"))


@query(f"WITH {DAMAGED}, {KMERS}, m AS (SELECT damaged, n_name, distance, min(distance) OVER (PARTITION BY damaged) AS least FROM p) SELECT damaged, CASE WHEN count(*) = 1 THEN min(n_name) END AS n_name, CAST(min(distance) AS INT) AS distance FROM m WHERE distance = least GROUP BY damaged")
def fuzzy_best_unique(spark, sf):
    rows = damaged(spark, sf)
    best = fuzzy.best_unique(fuzzy.fuzzy_lookup(rows, table(spark, sf, "nation"), "damaged", "n_name", 2), "damaged", "n_name")
    return best.select("damaged", "n_name", F.col("distance").cast("int").alias("distance"))


@query(f"WITH {DAMAGED}, {KMERS} SELECT CAST(distance AS INT) AS distance, count(*) AS n FROM p GROUP BY distance")
def edit_distance_hist(spark, sf):
    pairs = fuzzy.fuzzy_lookup(damaged(spark, sf), table(spark, sf, "nation"), "damaged", "n_name", 2)
    return reports.frequencies(pairs.withColumn("distance", F.col("distance").cast("int")), "distance")


@query("WITH e AS (SELECT DISTINCT p_brand || ' ' || p_type AS x FROM part) SELECT a.x AS a, b.x AS b, CAST(levenshtein(a.x, b.x) AS INT) AS distance FROM e a JOIN e b ON a.x < b.x AND levenshtein(a.x, b.x) <= 2")
def whitelist_close_pairs(spark, sf):
    entries = table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("x"))
    return fuzzy.close_pairs(entries, "x", 2).select("a", "b", F.col("distance").cast("int").alias("distance"))


@query("SELECT length(regexp_extract(substr(text, 2), '^[n]*')) AS run_length, count(*) AS n FROM documents GROUP BY 1")
def run_length(spark, sf):
    return table(spark, sf, "documents").groupBy(S.run_length(F.col("text"), F.lit(1), "n").cast("long").alias("run_length")).agg(F.count("*").alias("n"))


SHIFT = "CASE WHEN regexp_matches(r, '^e') THEN 0 WHEN regexp_matches(r, '^[^e]ee') THEN 1 WHEN regexp_matches(r, '^[^e][^e]ee') THEN 2 END"


@query(f"WITH t AS (SELECT doc_id, substr(text, 11) AS r FROM documents), s AS (SELECT doc_id, r, {SHIFT} AS k FROM t) SELECT doc_id, CAST(10 + coalesce(k, 0) AS INT) AS run_start, CAST(10 + coalesce(k + length(regexp_extract(substr(r, k + 1), '^e+(?:[^e]e{{2,}})?')), 0) AS INT) AS run_end FROM s")
def anchor_run_shift(spark, sf):
    run = S.anchor_run(F.col("text"), F.lit(10), "e", 2)
    return table(spark, sf, "documents").select("doc_id", run["start"].alias("run_start"), run["end"].alias("run_end"))


@query("SELECT doc_id, CASE WHEN doc_id % 50 + 11 <= length(text) THEN substr(text, doc_id % 50 + 4, 8) END AS value, CASE WHEN doc_id % 50 + 11 <= length(text) THEN CAST(doc_id % 50 + 3 AS INT) ELSE -1 END AS start_at, doc_id % 50 + 11 > length(text) AS truncated FROM documents")
def span_slice(spark, sf):
    d = table(spark, sf, "documents").withColumn("_u", S.umi_slice(F.col("text"), (F.col("doc_id") % 50).cast("int"), 3, 8))
    return d.select("doc_id", F.col("_u.value").alias("value"), F.coalesce("_u.start", F.lit(-1)).alias("start_at"), F.col("_u").isNull().alias("truncated"))


@query("WITH c AS (SELECT CASE WHEN doc_id % 900 >= length(text) THEN 'dropped' WHEN lang = 'en' THEN 'matched' ELSE 'none' END AS arm FROM documents) SELECT arm, count(*) AS n FROM c GROUP BY arm")
def insert_drop(spark, sf):
    arm = reads.arm_of(F.col("doc_id") % 900, F.col("text"), F.col("lang") == "en", F.lit("matched"))
    return reports.frequencies(table(spark, sf, "documents").withColumn("arm", F.coalesce(arm, F.lit("dropped"))), "arm")


@query("SELECT page_id, regexp_extract(url, '^[^?&#]*') AS read_id, CASE WHEN contains(url, 'utm_source=') THEN regexp_extract(url, 'utm_source=([^&#]*)', 1) END AS utm_source, CASE WHEN contains(url, 'page=') THEN regexp_extract(url, 'page=([^&#]*)', 1) END AS page, CASE WHEN contains(url, 'ref=') THEN regexp_extract(url, 'ref=([^&#]*)', 1) END AS ref FROM pages")
def header_tags(spark, sf):
    parsed = headers.parse(F.regexp_replace("url", "[?&#]", " "))
    rows = table(spark, sf, "pages").select("page_id", parsed.alias("h"))
    return rows.select("page_id", F.col("h.read_id").alias("read_id"), *(headers.tag(F.col("h.tags"), k).alias(k) for k in ("utm_source", "page", "ref")))


@query("SELECT page_id, regexp_extract(url, '^[^?&#]*') || CASE WHEN contains(url, '#') THEN ' top' ELSE '' END || coalesce(' ' || nullif(replace(regexp_extract(url, '[?]([^#]*)', 1), '&', ' '), ''), '') || ' seen=1' AS header FROM pages")
def header_render(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", headers.parse(F.regexp_replace("url", "[?&#]", " ")).alias("h"))
    return rows.select("page_id", headers.render(F.col("h.read_id"), F.col("h.passthrough"), headers.with_tag(F.col("h.tags"), "seen", F.lit("1"))).alias("header"))


@query("SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus || CAST(l_suppkey AS VARCHAR) AS full_key FROM lineitem")
def full_key_concat(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", reads.full_barcode(F.array(*(F.struct(F.col(c).cast("string").alias("value")) for c in ("l_returnflag", "l_linestatus", "l_suppkey")))).alias("full_key"))


@query("WITH g AS (SELECT l_partkey, count(*) AS n, min(l_orderkey * 10 + l_linenumber) AS first_at FROM lineitem GROUP BY l_partkey) SELECT l_partkey, n, row_number() OVER (ORDER BY n DESC, first_at, l_partkey) AS rank FROM g")
def key_counts_ranked(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_at"))
    return cells.ranked(rows, [F.desc("n"), F.asc("first_at"), F.asc("l_partkey")]).select("l_partkey", "n", "rank")


@query("SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_shipdate, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_shipdate ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def linear_dedup(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice")
    return dedup.best_of_group(rows, ["l_suppkey", "l_returnflag", "l_shipdate"], F.col("l_extendedprice"), [F.asc("l_orderkey"), F.asc("l_linenumber")])


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT DISTINCT l_orderkey FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_suppkey, l_returnflag, l_shipdate ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1) w ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def winner_semi_join(spark, sf):
    winners = linear_dedup(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").join(winners, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


EVENTS = "SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_id % 2 END AS ub FROM events"


def event_keys(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"), F.when(F.col("user_id") % 3 != 0, F.col("event_id") % 2).alias("ub"))


@query(f"WITH e AS ({EVENTS}) SELECT event_id, CAST(CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY event_id) = 1 THEN 0 ELSE 1 END AS INT) AS DU FROM e")
def tag_dedup(spark, sf):
    return dedup.first_seen(event_keys(spark, sf), ["user_id", "event_type", "day"], "event_id").select("event_id", "DU")


@query(f"WITH e AS ({EVENTS}) SELECT event_id, CAST(CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, day, ub ORDER BY event_id) = 1 THEN 0 ELSE 1 END AS INT) AS DU FROM e")
def umi_tag_dedup(spark, sf):
    return dedup.first_seen(event_keys(spark, sf), ["user_id", "event_type", "day", "ub"], "event_id").select("event_id", "DU")


@query(f"WITH e AS ({EVENTS}), f AS (SELECT row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY event_id) AS r FROM e) SELECT count(*) FILTER (r = 1) AS unique_reads, count(*) FILTER (r > 1) AS duplicate_reads FROM f")
def unique_duplicate_counts(spark, sf):
    return dedup.unique_counts(tag_dedup(spark, sf))


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey")
def read_barcode_left_join(spark, sf):
    known = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return dedup.with_map(table(spark, sf, "orders"), known, "o_custkey", all_rows=True).select("o_orderkey", "c_name")


@query("WITH a AS (SELECT CAST(o_custkey AS VARCHAR) AS read_id, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT CAST(o_custkey AS VARCHAR) AS read_id, o_orderpriority AS seq2, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT a.ord, a.read_id, b.seq2 FROM a JOIN b ON a.read_id = b.read_id AND a.k = b.k")
def ordered_pair_join(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("seq"), F.col("o_orderstatus").alias("qual"))
    thin = orders.where("ord % 3 <> 0").select(F.col("name").alias("read_id"), "ord")
    return reads.paired(thin, orders).select("ord", "read_id", "seq2")


INTERVALS = "r AS (SELECT o_orderkey, o_orderstatus AS chrom, o_custkey AS a, o_custkey + o_orderkey % 20 + 1 AS b FROM orders), q AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS chrom, s_suppkey * 13 AS c, s_suppkey * 13 + 40 AS d FROM supplier)"


def interval_tables(spark, sf):
    left = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("chrom"), F.col("o_custkey").alias("start"), (F.col("o_custkey") + F.col("o_orderkey") % 20 + 1).alias("end"))
    k = F.col("s_suppkey")
    right = table(spark, sf, "supplier").select("s_suppkey", F.when(k % 3 == 0, "F").when(k % 3 == 1, "O").otherwise("P").alias("chrom"), (k * 13).alias("start2"), (k * 13 + 40).alias("end2"))
    return left, right


@query(f"WITH {INTERVALS} SELECT o_orderkey, s_suppkey, least(b, d) - greatest(a, c) AS shared FROM r JOIN q ON r.chrom = q.chrom AND least(b, d) - greatest(a, c) >= 3")
def interval_overlap(spark, sf):
    left, right = interval_tables(spark, sf)
    shared = S.overlap(F.col("start"), F.col("end"), F.col("start2"), F.col("end2"))
    return cells.overlaps(left, right, 64, 3, "chrom").select("o_orderkey", "s_suppkey", shared.alias("shared"))


@query(f"WITH {INTERVALS} SELECT s_suppkey AS peak, o_orderkey % 50 AS barcode, count(*) AS n FROM r JOIN q ON r.chrom = q.chrom AND least(b, d) - greatest(a, c) >= 1 GROUP BY ALL")
def peak_barcode_overlaps(spark, sf):
    left, right = interval_tables(spark, sf)
    return cells.overlaps(left, right, 64, 1, "chrom").groupBy(F.col("s_suppkey").alias("peak"), (F.col("o_orderkey") % 50).alias("barcode")).agg(F.count("*").alias("n"))


COO = "coo AS (SELECT event_type AS peak, CAST(user_id AS VARCHAR) AS barcode, count(*) AS n FROM events GROUP BY ALL)"


def coo(spark, sf):
    return cells.cell_counts(table(spark, sf, "events").select(F.col("event_type").alias("peak"), F.col("user_id").cast("string").alias("barcode")))


@query(f"WITH {COO} SELECT * FROM coo")
def peak_barcode_coo(spark, sf):
    return coo(spark, sf)


@query("SELECT CAST(c_custkey AS VARCHAR) AS barcode, count(user_id) AS n FROM customer LEFT JOIN (SELECT user_id FROM events WHERE event_type = 'purchase') ON c_custkey = user_id GROUP BY 1")
def column_sums(spark, sf):
    bought = coo(spark, sf).where("peak = 'purchase'")
    return cells.column_sums(bought, table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("barcode")))


SUMS = f"{COO}, sums AS (SELECT barcode, CAST(sum(n) AS BIGINT) AS n FROM coo GROUP BY barcode)"


def sums(spark, sf):
    return coo(spark, sf).groupBy("barcode").agg(F.sum("n").alias("n"))


@query(f"WITH {SUMS} SELECT barcode, n, row_number() OVER (ORDER BY n DESC, barcode) AS rank FROM sums WHERE n > 0")
def rank_curve(spark, sf):
    return cells.rank_curve(sums(spark, sf), "n", "barcode").select("barcode", "n", "rank")


@query(f"WITH {SUMS} SELECT barcode, n FROM sums ORDER BY n DESC, barcode LIMIT 25")
def top_n_cells(spark, sf):
    return cells.top_cells(sums(spark, sf), 25)


@query(f"WITH {SUMS}, top AS (SELECT barcode FROM sums ORDER BY n DESC, barcode LIMIT 3) SELECT DISTINCT peak FROM coo SEMI JOIN top USING (barcode)")
def selected_features(spark, sf):
    return cells.selected_features(coo(spark, sf), cells.top_cells(sums(spark, sf), 3))


@query(f'WITH {SUMS}, top AS (SELECT barcode FROM sums ORDER BY n DESC, barcode LIMIT 25), c AS (SELECT barcode, row_number() OVER (ORDER BY barcode) AS col FROM top), r AS (SELECT peak, row_number() OVER (ORDER BY peak) AS "row" FROM (SELECT DISTINCT peak FROM coo SEMI JOIN top USING (barcode))) SELECT "row", col, n FROM coo JOIN r USING (peak) JOIN c USING (barcode)')
def matrix_slice(spark, sf):
    grid, top = coo(spark, sf), cells.top_cells(sums(spark, sf), 25)
    return cells.matrix_slice(grid, cells.selected_features(grid, top), top)


@query("WITH k AS (SELECT count(DISTINCT user_id) AS n FROM events), i AS (SELECT n, unnest(range(1, 11)) AS i FROM k) SELECT DISTINCT CAST(CASE WHEN n <= 12 THEN NULL ELSE least(greatest(round_even(exp(ln(n) * i / 11), 0), 2), n - 1) END AS BIGINT) AS rank FROM i UNION SELECT 1 UNION SELECT n FROM k")
def log_spaced_ranks(spark, sf):
    curve = cells.rank_curve(sums(spark, sf), "n", "barcode")
    return numbers.sampled_ranks(curve, curve.count(), 12).select("rank")


@query("SELECT l_shipmode AS barcode, count(*) AS count FROM (SELECT l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1")
def split_counts(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("CB"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return cells.split_counts(rows)


@query("WITH b AS (SELECT unnest(['en', 'de', 'fr', 'es', 'xx']) AS bucket) SELECT bucket, count(doc_id) AS n FROM b LEFT JOIN documents ON lang = bucket GROUP BY bucket")
def bucket_router(spark, sf):
    return reads.bucket_counts(table(spark, sf, "documents"), "lang", ["en", "de", "fr", "es", "xx"])


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS matched, count(*) FILTER (o_orderstatus = 'O') AS no_match, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 6) AS matched_fraction, round(count(*) FILTER (o_orderstatus = 'O') / count(*), 6) AS no_match_fraction FROM orders GROUP BY 1")
def outcome_breakdown(spark, sf):
    return reports.breakdown(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", {"matched": "F", "no_match": "O"})


WILD = "t AS (SELECT n_nationkey, lower(n_name) AS w, CAST(n_nationkey % length(n_name) AS INT) AS k, lower(r_name) AS b FROM nation JOIN region ON n_regionkey = r_regionkey), a AS (SELECT n_nationkey, substr(w, 1, k) || 'N' || substr(w, k + 2) AS a, b FROM t)"


@query(f"WITH {WILD}, c AS (SELECT n_nationkey, a, b, min(levenshtein(replace(a, 'N', c), b)) AS d FROM (SELECT n_nationkey, a, b, unnest(string_split(b, '')) AS c FROM a) GROUP BY ALL), p AS (SELECT n_nationkey, a, left(a || b, least(length(a), length(b))) AS x, left(b, least(length(a), length(b))) AS y FROM a) SELECT n_nationkey, a, CAST(d AS INT) AS distance, CAST(hamming(x, y) AS INT) AS hamming FROM c JOIN p USING (n_nationkey, a)")
def wildcard_distance(spark, sf):
    """Nations with a letter that equals any, to their region; Hamming distance takes it as it is."""
    t = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, w = (F.col("n_nationkey") % F.length("n_name")).cast("int"), F.lower("n_name")
    a = t.select("n_nationkey", F.concat(F.substr(w, F.lit(1), k), F.lit("N"), F.substr(w, k + 2)).alias("a"), F.lower("r_name").alias("b"))
    n = F.least(F.length("a"), F.length("b"))
    return a.select("n_nationkey", "a", S.edit_distance(F.col("a"), F.col("b")).alias("distance"), S.hamming(F.left("a", n), F.left("b", n)).alias("hamming"))


@query("SELECT n_name, count(DISTINCT v) AS n FROM (SELECT n_name, unnest(list_concat([n_name], [substr(n_name, 1, i - 1) || substr(n_name, i + 1) FOR i IN range(1, length(n_name) + 1)])) AS v FROM nation) GROUP BY n_name")
def deletion_variants(spark, sf):
    return table(spark, sf, "nation").select("n_name", F.size(S.deletions(F.col("n_name"), 1)).cast("long").alias("n"))


@query(f"""WITH {SUMS}, c AS (SELECT n, row_number() OVER (ORDER BY n DESC, barcode) AS rank FROM sums WHERE n > 0), m AS (SELECT *, max(n) OVER () AS hi, min(n) OVER () AS lo, count(*) OVER () AS k FROM c),
    d AS (SELECT rank, n, k, k - rank AS i, CAST(n - lo AS DOUBLE) / (hi - lo) + CAST(rank - 1 AS DOUBLE) / (k - 1) - 1 AS d FROM m WHERE hi > lo),
    e AS (SELECT *, d >= coalesce(lag(d) OVER w, d) AND d >= coalesce(lead(d) OVER w, d) AS top, d <= coalesce(lag(d) OVER w, d) AND d <= coalesce(lead(d) OVER w, d) AS bottom, lead(d) OVER w AS after FROM d WINDOW w AS (ORDER BY i)),
    t AS (SELECT *, last_value(CASE WHEN bottom THEN 0.0 WHEN top THEN d - CAST(1 AS DOUBLE) / (k - 1) END IGNORE NULLS) OVER w AS threshold, last_value(CASE WHEN top THEN i END IGNORE NULLS) OVER w AS mark FROM e WINDOW w AS (ORDER BY i ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT mark FROM t WHERE mark IS NOT NULL AND after < threshold ORDER BY i DESC LIMIT 1) SELECT rank, n FROM d JOIN f ON i = mark""")
def knee_point(spark, sf):
    """The rank and value at the knee of the users' counts; beyond so many ranks the driver gets log-spaced ones."""
    from strandloom.plans.commands import KNEE_POINTS

    curve = cells.rank_curve(sums(spark, sf), "n", "barcode")
    rows = numbers.sampled_ranks(curve, curve.count(), KNEE_POINTS).orderBy("rank").select("rank", "n").collect()
    at = cells.knee([r.n for r in rows], [r["rank"] for r in rows])
    return spark.createDataFrame([at] if at else [], "rank long, n long")


def synthetic_reads(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """A read for each order: barcodes of a small whitelist by its keys, some with an error, UMI, anchor, target and insert."""
    entries = ["ACGTTGCAAC", "TTGACCGATA", "GGCATTACGA", "CATGGTCTAC", "AGTCCAGTTG", "TCAGATCGGA"]
    pick = lambda c: F.element_at(F.array(*map(F.lit, entries)), (c % len(entries)).cast("int") + 1)
    orders = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    hurt = F.when(key % 7 == 0, F.concat(F.lit("N"), F.substr(pick(cust), F.lit(2)))).otherwise(pick(cust))
    bases = F.substr(F.translate(F.md5(key.cast("string").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT"), F.lit(1), F.lit(28))
    seq = F.concat(hurt, F.lit("TGTGTATAAGGACCTCGTTGCC"), pick(key), F.lit("ATGGAAGCCGACGAATTAGACC"), pick(key + cust), F.left(bases, F.lit(8)), F.lit("GGGGGG"), F.when(key % 5 == 0, "CCAACCAA").otherwise("TATAGCCT"), F.lit("AGATGTGTATAAGAGACAG"), bases)
    return orders.select(key.alias("ord"), F.concat(F.lit("r"), key.cast("string"), F.lit(" 1:N:0")).alias("name"), seq.alias("seq"), F.repeat(F.lit("I"), F.length(seq)).alias("qual")), entries


PICK = "['ACGTTGCAAC', 'TTGACCGATA', 'GGCATTACGA', 'CATGGTCTAC', 'AGTCCAGTTG', 'TCAGATCGGA']"


MADE = f"""b AS (SELECT o_orderkey AS ord, 'r' || o_orderkey AS read_id, {PICK}[o_custkey % 6 + 1] || {PICK}[o_orderkey % 6 + 1] || {PICK}[(o_orderkey + o_custkey) % 6 + 1] AS full_barcode, o_orderkey % 7 <> 0 AS perfect,
    CASE WHEN o_orderkey % 5 = 0 THEN 'NONE' ELSE 'TATAGCCT' END AS target, translate(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 28), '0123456789abcdef', 'ACGTACGTACGTACGT') AS bases FROM orders), r AS (SELECT *, left(bases, 8) AS umi FROM b)"""


def found_reads(spark: SparkSession, sf: str) -> tuple[DataFrame, object]:
    """Synthetic reads with barcodes, UMI and target, and their chemistry."""
    from dataclasses import replace

    from strandloom.plans.chemistry import chemistry

    rows, entries = synthetic_reads(spark, sf)
    base = chemistry("custom_seq_1_0")
    kit = replace(base, whitelists=base.whitelists | dict.fromkeys(("BC1", "BC2", "BC3"), tuple(entries)))
    return reads.with_targets(reads.with_umis(reads.extracted(rows.repartition("ord"), kit), kit), kit), kit  # made reads are computed once, as those of files are, and over all cores


@query(f"WITH {MADE} SELECT ord, full_barcode, perfect, target, umi FROM r")
def barcode_cascade(spark, sf):
    """Barcodes, UMI and target of each synthetic read."""
    return found_reads(spark, sf)[0].select("ord", "full_barcode", "perfect", "target", F.col("umi.value").alias("umi"))


@query(f"WITH {MADE}, t AS (SELECT count(*) AS n, count(*) FILTER (NOT perfect) AS bad FROM r) SELECT bc, method, checked, matched, checked - matched AS failed, 0::BIGINT AS ambiguous FROM (SELECT unnest(['BC3', 'BC2', 'BC1']) AS bc, 'EXACTMATCH' AS method, n AS checked, unnest([n - bad, n, n]) AS matched FROM t UNION ALL SELECT 'BC3', 'KMERMATCH', bad, bad FROM t)")
def extraction_counts(spark, sf):
    """Reads that each matcher was tried on, by component, and what came of it."""
    rows, kit = found_reads(spark, sf)
    parts = reports.extraction_stats(rows, kit)["parts"]
    names = ("checked", "matched", "failed", "ambiguous")
    return spark.createDataFrame([(*k, *(p[c] for c in names)) for k, p in parts.items()], "bc string, method string, checked long, matched long, failed long, ambiguous long")


@query(f"WITH {MADE} SELECT 'total' AS measure, count(*) AS n FROM r UNION ALL SELECT 'perfect', count(*) FILTER (perfect) FROM r UNION ALL SELECT 'corrected', count(*) FILTER (NOT perfect) FROM r UNION ALL SELECT 'failed', 0")
def extraction_totals(spark, sf):
    stats = reports.extraction_stats(*found_reads(spark, sf))
    return spark.createDataFrame([(k, stats[k]) for k in ("total", "perfect", "corrected", "failed")], "measure string, n long")


@query(f"WITH {MADE}, t AS (SELECT count(*) AS n FROM r) SELECT unnest(['total', 'accepted', 'missing_left_anchor', 'truncated', 'run 6']) AS measure, unnest([n, n, 0, 0, n]) AS n FROM t")
def umi_outcomes(spark, sf):
    """UMI outcomes, and how long the run after accepted UMIs is."""
    stats = reports.umi_stats(found_reads(spark, sf)[0])
    rows = [(k, v) for k, v in stats.items() if isinstance(v, int)] + [(f"run {k}", v) for k, v in stats["runs"].items()]
    return spark.createDataFrame(rows, "measure string, n long")


@query(f"WITH {MADE}, t AS (SELECT count(*) AS n, count(*) FILTER (target = 'NONE') AS no FROM r) SELECT unnest(['total', 'matched', 'no_match', 'no_left_anchor_pos', 'short_window', 'targets TATAGCCT', 'distances 0', 'runs 6']) AS measure, unnest([n, n - no, no, 0, 0, n - no, n - no, n]) AS n FROM t")
def target_outcomes(spark, sf):
    """Target outcomes, and the targets, distances and runs that were measured."""
    stats = reports.target_stats(found_reads(spark, sf)[0])
    rows = [(k, v) for k, v in stats.items() if isinstance(v, int)] + [(f"{k} {x}", n) for k in ("targets", "distances", "runs") for x, n in stats[k].items()]
    return spark.createDataFrame(rows, "measure string, n long")


@query(f"WITH {MADE} SELECT ord, CASE WHEN target = 'NONE' THEN 'none' ELSE target END AS arm, CASE WHEN target = 'NONE' THEN read_id ELSE read_id || '|CB=' || full_barcode || '|UR=' || umi END AS header, CASE WHEN target = 'NONE' THEN 'CCAACCAAAGATGTGTATAAGAGACAG' ELSE '' END || bases AS insert_seq, repeat('I', length(insert_seq)) AS insert_qual FROM r")
def prepared_inserts(spark, sf):
    """Each read's arm, header and insert: unmatched reads are cut after the run behind their UMI, matched ones after what follows their target."""
    rows, kit = found_reads(spark, sf)
    return reads.prepared(rows, kit).select("ord", "arm", "header", "insert_seq", "insert_qual")


@query(f"WITH {MADE} SELECT ord, read_id, full_barcode || umi AS seq, repeat('I', 38) AS qual FROM r WHERE target = 'NONE'")
def barcode_records(spark, sf):
    """Barcodes and UMI of the unmatched arm as records of their own."""
    rows, kit = found_reads(spark, sf)
    return reads.barcode_records(reads.prepared(rows, kit), kit)


@query(f"WITH {MADE} SELECT ord, read_id || ' 1:N:0|SUCCESS:' || CASE WHEN perfect THEN 'PERFECT' ELSE 'CORROK' END || ':' || full_barcode || '|BC3:' || CASE WHEN perfect THEN 'EXACTMATCH' ELSE 'KMERMATCH-ED0' END || '|BC2:EXACTMATCH|BC1:EXACTMATCH' AS status FROM r")
def status_lines(spark, sf):
    rows, kit = found_reads(spark, sf)
    return rows.select("ord", reads.status_line(kit).alias("status"))


@query(f"WITH {MADE} SELECT ord, read_id || ' 1:N:0 BC3=' || full_barcode[1:10] || ' BC3_POS=0:10 BC2=' || full_barcode[11:20] || ' BC2_POS=32:42 BC1=' || full_barcode[21:30] || ' BC1_POS=64:74 UMI=' || umi || ' UMI_POS=74:82 TGIDX=' || target || CASE WHEN target = 'NONE' THEN '' ELSE ' TGIDX_POS=88:96' END AS name FROM r")
def annotated_headers(spark, sf):
    """What the stages found, as tags of each read's header."""
    rows, kit = found_reads(spark, sf)
    return reads.annotated(rows, kit).select("ord", "name")


@query(f"WITH {MADE} SELECT ord, full_barcode, umi, target FROM r")
def parsed_headers(spark, sf):
    """The same findings, read back from the headers."""
    rows, kit = found_reads(spark, sf)
    back = reads.parsed(reads.annotated(rows, kit).select("ord", "name", "seq", "qual"), kit)
    return back.select("ord", reads.full_barcode(F.col("calls")).alias("full_barcode"), F.col("umi.value").alias("umi"), "target")


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as alignments: references by flag, barcodes by supplier, scores by quantity, some of them no candidates."""
    n = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + n).alias("ord"), F.concat(F.lit("q"), (F.col("l_orderkey") * 10 + n).cast("string")).alias("qname"), F.lit(1).alias("mate"), F.when(n == 6, "secondary").otherwise("primary").alias("category"),
        (n != 5).alias("paired"), (F.col("l_quantity") < 3).alias("unmapped"), F.lit(False).alias("mate_unmapped"), F.col("l_suppkey").cast("string").alias("cb"), F.col("l_returnflag").alias("rname"), (F.col("l_linestatus") == "F").alias("is_reverse"),
        (F.col("l_partkey") % 40).cast("int").alias("ref_start"), (F.col("l_orderkey") % 3 + 5).cast("int").alias("ref_len"), F.col("l_quantity").cast("string").alias("as_tag"),
    )


ALIGNED = """a AS (SELECT l_orderkey * 10 + l_linenumber AS ord, 'q' || (l_orderkey * 10 + l_linenumber) AS qname, CAST(l_suppkey AS VARCHAR) AS cb, l_returnflag AS rname, l_linestatus = 'F' AS is_reverse, CAST(l_quantity AS DOUBLE) AS score,
    l_partkey % 40 + CASE WHEN l_linestatus = 'F' THEN l_orderkey % 3 + 5 ELSE 0 END AS place, CASE WHEN l_linenumber = 6 THEN 'non_primary' WHEN l_linenumber = 5 THEN 'unpaired' WHEN l_quantity < 3 THEN 'unmapped' END AS skip FROM lineitem),
    w AS (SELECT *, row_number() OVER (PARTITION BY cb, rname, is_reverse, place ORDER BY score DESC, ord) AS r FROM a WHERE skip IS NULL)"""


@query(f"WITH {ALIGNED} SELECT ord, qname FROM w WHERE r = 1")
def linear_winners(spark, sf):
    """The records that stay of each barcode, reference, strand and 5' end."""
    return dedup.linear_winners(records(spark, sf)).select("ord", "qname")


@query(f"WITH {ALIGNED} SELECT 'total' AS measure, '' AS key, count(*) AS n FROM a UNION ALL SELECT 'skipped', skip, count(*) FROM a WHERE skip IS NOT NULL GROUP BY skip UNION ALL SELECT 'eligible', rname, count(*) FROM a WHERE skip IS NULL GROUP BY rname UNION ALL SELECT 'kept', rname, count(*) FROM w WHERE r = 1 GROUP BY rname")
def linear_measures(spark, sf):
    """Records in all, skipped by reason, and eligible and kept by reference."""
    return dedup.linear_stats(records(spark, sf))


@query("WITH r AS (SELECT event_id AS ord, user_id, CASE WHEN event_id % 9 = 0 THEN '*' ELSE event_type END AS rname, event_id % 20 AS pos FROM events), t AS (SELECT ord, user_id, rname, pos, CAST(user_id % 4 AS VARCHAR) AS cb, CASE WHEN user_id % 3 <> 0 THEN CAST(user_id % 5 AS VARCHAR) END AS ub FROM r WHERE rname <> '*' AND user_id % 7 <> 0) SELECT ord, cb AS CB, ub AS UB, CAST(CASE WHEN row_number() OVER (PARTITION BY rname, pos, cb, ub ORDER BY ord) = 1 THEN 0 ELSE 1 END AS INT) AS DU FROM t")
def read_tagging(spark, sf):
    """Placed records with the barcode and UMI of their read, and whether they repeat a fragment."""
    e, user = table(spark, sf, "events"), F.col("user_id").cast("string")
    rows = e.select(F.col("event_id").alias("ord"), user.alias("qname"), F.when(F.col("event_id") % 9 == 0, "*").otherwise(F.col("event_type")).alias("rname"), (F.col("event_id") % 20).alias("pos"), F.lit(0).alias("tlen"))
    users = e.select("user_id").distinct()
    barcodes = users.where("user_id % 7 <> 0").select(user.alias("qname"), (F.col("user_id") % 4).cast("string").alias("barcode"))
    umis = users.where("user_id % 3 <> 0").select(user.alias("qname"), (F.col("user_id") % 5).cast("string").alias("UB"))
    return dedup.tagged(rows, barcodes, umis).select("ord", "CB", "UB", "DU")


@query("SELECT event_id, CAST(event_id % 2 AS INT) AS flag FROM events")
def duplicate_flags(spark, sf):
    """Flags read from text; anything but 0 or 1 would raise."""
    return table(spark, sf, "events").select("event_id", dedup.checked_flag((F.col("event_id") % 2).cast("string")).alias("flag"))


@query(f"WITH {INTERVALS} SELECT CAST(s_suppkey AS VARCHAR) AS peak, CAST(o_orderkey % 50 AS VARCHAR) AS barcode, count(*) AS n FROM r JOIN q ON r.chrom = q.chrom AND least(b, d) - greatest(a, c) >= 5 GROUP BY ALL")
def peak_barcode_counts(spark, sf):
    """Records of each barcode that share five bases with each peak, every place counted by its first peak."""
    left, right = interval_tables(spark, sf)
    aligned = left.select(F.col("chrom").alias("rname"), "start", "end", (F.col("o_orderkey") % 50).cast("string").alias("CB"))
    peaks = right.select(F.col("s_suppkey").alias("ord"), "chrom", F.col("start2").alias("start"), F.col("end2").alias("end"), F.col("s_suppkey").cast("string").alias("name"), F.lit("0").alias("score"), F.lit("+").alias("strand"))
    repeated = peaks.unionByName(peaks.withColumn("ord", F.col("ord") + 1_000_000).withColumn("name", F.lit("later")))
    return cells.peak_counts(aligned, repeated, 5, 64)


@query("SELECT min(s_suppkey) AS ord, 'c' || s_nationkey AS chrom, s_suppkey % 3 AS start, s_suppkey % 3 + 5 AS \"end\", arg_min(s_name, s_suppkey) AS name FROM supplier GROUP BY s_nationkey, s_suppkey % 3")
def distinct_peaks(spark, sf):
    k = F.col("s_suppkey")
    peaks = table(spark, sf, "supplier").select(k.alias("ord"), F.concat(F.lit("c"), F.col("s_nationkey").cast("string")).alias("chrom"), (k % 3).alias("start"), (k % 3 + 5).alias("end"), F.col("s_name").alias("name"), F.lit("0").alias("score"), F.lit("+").alias("strand"))
    return cells.distinct_peaks(peaks).select("ord", "chrom", "start", "end", "name")


@query(f"WITH {SUMS}, top AS (SELECT barcode FROM sums ORDER BY n DESC, barcode LIMIT 1) SELECT coalesce(sum(n), 0)::BIGINT AS n FROM coo SEMI JOIN top USING (barcode) WHERE peak = 'purchase'")
def cell_value(spark, sf):
    """One cell of the matrix: purchases of the first user of the rank curve."""
    grid = coo(spark, sf)
    first = cells.top_cells(sums(spark, sf), 1).first().barcode
    return spark.createDataFrame([(cells.cell_value(grid, "purchase", first, grid.select("peak").distinct(), grid.select("barcode").distinct()),)], "n long")


@query(f"WITH {SUMS} SELECT barcode, n FROM sums")
def forced_cells(spark, sf):
    """All cells, which is what forcing 0 of them asks for."""
    counts = sums(spark, sf)
    return cells.top_cells(counts, cells.checked_n(0, counts.count()))


@query(f'WITH {SUMS}, c AS (SELECT barcode, row_number() OVER (ORDER BY barcode) AS col FROM sums), r AS (SELECT peak, row_number() OVER (ORDER BY peak) AS "row" FROM (SELECT DISTINCT peak FROM coo)) SELECT "row" || \' \' || col || \' \' || n AS value FROM coo JOIN r USING (peak) JOIN c USING (barcode) UNION ALL SELECT unnest([\'%%MatrixMarket matrix coordinate integer general\', \'%peaks by barcodes\', (SELECT count(*) FROM r) || \' \' || (SELECT count(*) FROM c) || \' \' || (SELECT count(*) FROM coo)])')
def matrix_lines(spark, sf):
    """The whole matrix as lines of a coordinate file."""
    grid = coo(spark, sf)
    peaks, users = grid.select("peak").distinct(), grid.select("barcode").distinct()
    return cells.matrix_lines(cells.matrix_slice(grid, peaks, users), peaks.count(), users.count()).select("value")


@query("SELECT p_partkey, p_size || ':' || (p_size + length(p_name)) AS span, CAST(p_size AS INT) AS start_at, CAST(p_size + length(p_name) AS INT) AS end_at, 'TGIDX_POS' AS key FROM part")
def spans(spark, sf):
    """Places as text and read back, and the key that they are kept under."""
    text = headers.span(F.col("p_size"), F.col("p_size") + F.length("p_name"))
    rows = table(spark, sf, "part").select("p_partkey", text.alias("span"))
    back = headers.parse_span(F.col("span"))
    return rows.select("p_partkey", "span", back["start"].alias("start_at"), back["end"].alias("end_at"), F.lit(headers.position_key("TGIDX")).alias("key"))


@query("SELECT page_id, regexp_extract(url, '([^/.]*)[^/]*$', 1) AS prefix FROM pages")
def file_prefixes(spark, sf):
    return table(spark, sf, "pages").select("page_id", headers.file_prefix(F.col("url")).alias("prefix"))


@query("SELECT n_name, regexp_replace(n_name, '[^ACGTN]', 'N', 'g') AS clean FROM nation")
def sanitised_sequences(spark, sf):
    return table(spark, sf, "nation").select("n_name", S.sanitised(F.col("n_name")).alias("clean"))


@query("WITH t AS (SELECT doc_id, text, doc_id % 60 AS mark FROM documents), w AS (SELECT *, greatest(mark - 3, 0) AS low, least(mark + 9, length(text)) AS high FROM t) SELECT doc_id, CAST(low AS INT) AS start_at, CASE WHEN high > low THEN substr(text, low + 1, high - low) ELSE '' END AS sequence, high - low >= 7 AS matchable FROM w")
def target_windows(spark, sf):
    """Where a target of eight bases can be after a run, with an error."""
    w = S.target_window(F.col("text"), (F.col("doc_id") % 60).cast("int"), 8, 1)
    return table(spark, sf, "documents").select("doc_id", w["start"].alias("start_at"), w["sequence"].alias("sequence"), w["matchable"].alias("matchable"))
