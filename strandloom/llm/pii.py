"""Information-theoretic sanitisation of personal data, in DataFrame functions alone.

Patterns find protected entities. Corpus co-occurrence then says how strongly the words around them reveal that there is
one; those over the disclosure thresholds are generalised or removed together with the entities.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import cut, table

LOCAL = "A-Za-z0-9._%+-"
#: What each pattern finds is as the plain pattern would find it; the looks behind and the possessive quantifiers only
#: keep matching linear in very long runs. A match may begin after a character of its own class only where the last ended.
#: Secrets, which the contract doesn't list, are runs of 20 to 128 letters and digits that have both.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,128}+(?![A-Za-z0-9])",
}
#: Texts without it have no match, found faster.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.contains("+"),
    "secret": lambda t: t.rlike(r"[A-Za-z0-9]{20}"),
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
BASE, KINDS = ("email", "ip", "card", "phone"), tuple(PATTERNS)
TERM = "term"
#: Characters on either side of an entity whose whole words are its window, and what a word is.
REACH, WORD = 80, r"(?<!\p{L})\p{L}{2,64}(?!\p{L})"
#: Different entities that a word must stand near, copies of a document counting as one; the normalised mutual information
#: from which it's generalised, and removed.
SUPPORT, GENERALISE, REMOVE = 3, 0.35, 0.7
#: Words, or texts with words, that are broadcast at most (under 100 bytes each, and with few words a text); more are joined by a shuffle.
CUES = 50_000
#: Matches whose positions are summed together; a text may have any number.
BLOCK = 256


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def valid(kind: str, m: Column) -> Column:
    if kind in ("email", "secret"):
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.length(digits(m))
    return n.between(13, 19) & F.call_function("luhn_check", digits(m)) if kind == "card" else n.between(9, 15)


def window(before: Column, after: Column) -> Column:
    """The different words, in lower case, that are whole within REACH characters before and after."""
    head, tail = F.left(after, F.lit(REACH)), F.right(before, F.lit(REACH))
    tail = F.when(F.length(before) > REACH, F.regexp_replace(tail, r"^\p{L}+", "")).otherwise(tail)
    head = F.when(F.length(after) > REACH, F.regexp_replace(head, r"\p{L}+$", "")).otherwise(head)
    return F.array_distinct(F.transform(F.regexp_extract_all(F.concat(tail, F.lit(" "), head), F.lit(WORD), F.lit(0)), F.lower))


def with_spans(df: DataFrame, text: str, name: str, pattern: Column, some: Column, ok, near) -> DataFrame:
    """df with an array column ``name`` of (start, end, print, near) of the matches that are ok: ends are exclusive code
    points, print tells the match, and near is what ``near`` makes of the texts before and after; null where not ``some``."""
    t = F.col(text)
    p, m, i, b, o = (f"_{c}_{name}" for c in "pmibo")
    df = df.withColumns({p: F.when(some, F.split(t, pattern, -1)), m: F.when(some, F.regexp_extract_all(t, pattern, F.lit(0)))})
    n = F.size(m)
    matched = F.zip_with(m, F.slice(p, 2, n), lambda x, after: F.struct(x.alias("m"), after.alias("after")))
    items = F.zip_with(F.slice(p, 1, n), matched, lambda before, x: F.struct(F.length(before).alias("b"), F.length(x["m"]).alias("n"), ok(x["m"]).alias("ok"), F.xxhash64(x["m"]).alias("print"), F.when(ok(x["m"]), near(before, x["after"])).alias("near")))
    df = df.withColumn(i, F.when(F.coalesce(n, F.lit(0)) > 0, items)).drop(p, m)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(i) - 1) / BLOCK).cast("int")), lambda k: F.slice(i, k * BLOCK + 1, F.lit(BLOCK)))
    df = df.withColumn(b, F.when(F.col(i).isNotNull(), blocks)).drop(i)
    df = df.withColumn(o, F.transform(F.col(b), lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x["b"] + x["n"])))
    offsets = F.transform(F.col(o), lambda _, k: F.aggregate(F.slice(o, F.lit(1), k), F.lit(0), lambda a, x: a + x))

    def one(xs: Column, x: Column, k: Column, off: Column) -> Column:
        end = off + F.aggregate(F.slice(xs, F.lit(1), k + 1), F.lit(0), lambda a, y: a + y["b"] + y["n"])
        return F.struct((end - x["n"]).alias("start"), end.alias("end"), x["ok"].alias("ok"), x["print"].alias("print"), x["near"].alias("near"))

    spans = F.flatten(F.zip_with(F.col(b), offsets, lambda xs, off: F.transform(xs, lambda x, k: one(xs, x, k, off))))
    kept = F.transform(F.filter(spans, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["print"].alias("print"), x["near"].alias("near")))
    return df.withColumn(name, F.when(F.col(b).isNotNull(), kept)).drop(b, o)


def words(t: Column) -> Column:
    """The different words of a text, in lower case."""
    return F.array_distinct(F.split(F.lower(t), r"[^\p{L}]+"))


def analysed(docs: DataFrame, text: str) -> DataFrame:
    """_row, _md5, keys and an array of (start, end, print, near) for each kind of each row, without its text: cut off from the scan."""
    held = [c for c in docs.columns if c != text]
    found = docs.select(*held, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    for kind, pattern in PATTERNS.items():
        found = with_spans(found, "_text", f"_s_{kind}", F.lit(pattern), NEEDS[kind](F.col("_text")), lambda m, kind=kind: valid(kind, m), window)
    none = F.array().cast("array<struct<start:int,end:int,print:bigint,near:array<string>>>")
    some = F.array_max(F.array(*(F.coalesce(F.size(f"_s_{k}"), F.lit(0)) for k in KINDS))) > 0
    base = cut(found.select(*held, F.when(some, F.md5(F.col("_text").cast("binary"))).alias("_md5"), *(F.coalesce(f"_s_{k}", none).alias(f"_s_{k}") for k in KINDS)))
    return base.withColumn("_row", F.monotonically_increasing_id())  # the partitions of a checkpoint stay as they are


def occurrences(base: DataFrame) -> DataFrame:
    """(_row, _md5, kind, print, term) of the words near entities: once for each row, kind and word, print being the least of the row's entities of that kind."""
    each = F.transform(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"_s_{k}").alias("s")) for k in KINDS)), lambda x: F.struct(x["kind"].alias("kind"), F.array_min(x["s"]["print"]).alias("print"), F.array_distinct(F.flatten(x["s"]["near"])).alias("near")))
    kinds = base.where("_md5 is not null").select("_row", "_md5", F.explode(each).alias("x"))
    return kinds.select("_row", "_md5", "x.kind", "x.print", F.explode("x.near").alias("term"))


def small(df: DataFrame) -> DataFrame:
    """df, broadcast if it has at most CUES rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= CUES else df


def disclosive(docs: DataFrame, base: DataFrame, text: str) -> DataFrame:
    """(kind, term, npmi, action) of the words that reveal a kind of entity.

    npmi is the normalised pointwise mutual information of a document having the word and having it near such an entity:
    log(n_both * n / (n_word * n_kind)) / -log(n_both / n), with counts over all documents. Words near fewer than SUPPORT
    different entities are no candidates; n_word of the others comes from one pass over all words of the corpus.
    """
    counted = base.agg(F.count("*").alias("n"), *(F.sum((F.size(f"_s_{k}") > 0).cast("long")).alias(k) for k in KINDS)).first()
    near = occurrences(base).groupBy("kind", "term", "print").agg(F.count("*").alias("n")).groupBy("kind", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("entities"))
    candidates = small(near.where(F.col("entities") >= SUPPORT))
    everywhere = docs.select(F.explode(words(F.col(text))).alias("term")).join(small(candidates.select("term").distinct()), "term", "left_semi")
    everywhere = everywhere.groupBy("term").agg(F.count("*").alias("n_word"))
    n = float(max(counted["n"], 1))
    kind = F.create_map(*(F.lit(x) for k in KINDS for x in (k, float(max(counted[k] or 0, 1)))))
    npmi = F.log(F.col("n_both") * n / (F.col("n_word") * kind[F.col("kind")])) / (math.log(n) - F.log("n_both") + 1e-9)
    scored = candidates.join(everywhere, "term").withColumn("npmi", F.round(npmi, 9))
    return scored.where(F.col("npmi") >= GENERALISE).select("kind", "term", "npmi", F.when(F.col("npmi") >= REMOVE, "remove").otherwise("generalise").alias("action"))


def cued(base: DataFrame, cues: DataFrame) -> DataFrame:
    """(_md5, _cues): of each text with words near its entities that reveal them, these (term, action); removal goes before generalising."""
    own = occurrences(base).join(small(cues), ["kind", "term"]).groupBy("_md5", "term").agg(F.max("action").alias("action"))
    return small(own.groupBy("_md5").agg(F.collect_set(F.struct("term", "action")).alias("_cues")))


def pattern_of(terms: Column) -> Column:
    """A pattern of whole words, in any case, that are one of the terms and no placeholder of an entity."""
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\[])(?:"), F.array_join(F.sort_array(terms), "|"), F.lit(r")(?![\p{L}\]])"))


def found_in(docs: DataFrame, text: str = "text") -> DataFrame:
    """Docs without their text, with _s_KIND arrays of entities (start, end and more) and _terms, an array of (start, end), by start.

    _terms are all places, outside entities, of the words that reveal an entity which stands in the text near them.
    Null texts are empty. A repeated row has its own findings; rows without any have empty arrays.
    """
    base = analysed(docs, text)
    listed = cued(base, disclosive(docs, base, text))
    texts = docs.select(F.col(text).alias("_text"), F.md5(F.col(text).cast("binary")).alias("_md5")).join(listed, "_md5").dropDuplicates(["_md5"])
    none = lambda before, after: F.lit(None).cast("boolean")
    places = with_spans(texts, "_text", "_found", pattern_of(F.col("_cues")["term"]), F.lit(True), lambda m: F.lit(True), none)
    places = small(places.select("_md5", F.transform("_found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("_terms")))
    entities = F.concat(*(F.transform(f"_s_{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS))
    apart = F.filter("_terms", lambda t: ~F.exists(entities, lambda e: (e["start"] < t["end"]) & (t["start"] < e["end"])))
    return base.join(places, "_md5", "left").withColumn("_terms", F.coalesce(apart, F.array().cast("array<struct<start:int,end:int>>")))


def replaced(t: Column, kind: str) -> Column:
    """A text with a placeholder for each valid entity of a kind."""
    pattern = PATTERNS[kind]
    matches = F.concat(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    label = F.lit(f"[{kind.upper()}]")
    joined = F.zip_with(F.split(t, pattern, -1), matches, lambda p, m: F.concat(p, F.when(m == "", m).when(valid(kind, m), label).otherwise(m)))
    return F.when(NEEDS[kind](t), F.array_join(joined, "")).otherwise(t)


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """Docs with every entity of their texts replaced by its kind in brackets, and the words that reveal it removed or by ``[WORD]``.

    A word that passes the threshold goes wherever it stands in a text that has it near such an entity. Null texts stay
    null; texts without entities stay as they are; repeated rows give equal rows; no rows give none. The words and the
    texts that have them have no bound: they are broadcast up to CUES rows, else joined by a shuffle.
    """
    base = analysed(docs.select(F.col(text).alias("_source")).where("_source is not null"), "_source")
    listed = cued(base, disclosive(docs, base, text))
    rows = docs.withColumn("_md5", F.md5(F.col(text).cast("binary"))).join(listed, "_md5", "left")
    for kind in ("email", "secret", "card", "phone", "ip"):
        rows = rows.withColumn(text, replaced(F.col(text), kind))
    of = lambda action: F.filter("_cues", lambda c: c["action"] == action)["term"]
    for action, instead in (("remove", ""), ("generalise", "[WORD]")):
        terms = of(action)
        rows = rows.withColumn(text, F.when(F.size(terms) > 0, F.regexp_replace(text, pattern_of(terms), F.lit(instead))).otherwise(F.col(text)))
    return rows.select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's personal data: counts by kind, base_sha256 of the base spans, all spans, and how many are secrets and revealing words.

    Null and empty texts have none; repeated rows give equal rows; no documents give no rows.
    """
    found = found_in(table(spark, sf_dir, "documents").select("doc_id", "text"))
    place = lambda kind, column: F.transform(column, lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))
    base = F.concat(*(place(k, f"_s_{k}") for k in BASE))
    spans = F.concat(base, place("secret", "_s_secret"), place(TERM, "_terms"))
    counts = [F.size(c).cast("long").alias(f"n_{k}") for k, c in (*((k, f"_s_{k}") for k in BASE), ("secrets", "_s_secret"), ("terms", "_terms"))]
    return found.select("doc_id", *counts[:4], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(spans, ",").alias("spans"), *counts[4:])
