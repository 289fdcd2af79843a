"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from strandloom.llm.bpe import op4_bpe
from strandloom.llm.decontaminate import op8_decontaminate
from strandloom.llm.jpeg import op9_jpeg
from strandloom.llm.langid import op6_langid
from strandloom.llm.licenses import op7_licenses
from strandloom.llm.pii import op1_pii
from strandloom.llm.simhash import op5_simhash
from strandloom.llm.toxicity import op2_toxicity
from strandloom.llm.urls import op10_urls
from strandloom.llm.warc import op3_warc

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha1(h) AS d FROM p),
        g AS (SELECT d, max(page_id) AS largest FROM s WHERE n >= 1000 GROUP BY d)
        SELECT page_id, n AS payload_bytes, s.d AS payload_digest, CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < largest THEN largest END AS refers_to, strftime(TIMESTAMP '1996-01-01' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') AS warc_date
        FROM s LEFT JOIN g ON s.d = g.d AND s.n >= 1000""",
    "op8_decontaminate": f"""
        WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS s
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM iw WHERE len(w) > 0)),
        d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
            FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        h AS (SELECT doc_id, item, i, win.n FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
        g AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN g ON d.doc_id = g.doc_id""",
}


def queries() -> dict:
    found = (op1_pii, op2_toxicity, op3_warc, op4_bpe, op5_simhash, op6_langid, op7_licenses, op8_decontaminate, op9_jpeg, op10_urls)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
