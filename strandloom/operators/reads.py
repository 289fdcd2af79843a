"""The four row-local stages over reads: barcodes, UMIs, targets, and cutting and routing inserts.

Reads are (ord, name, seq, qual). Each stage adds typed columns; ``annotated`` renders them into headers, and
``parsed`` reads them back, so stages also run from files that another has written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from strandloom.functions import headers
from strandloom.functions import sequences as S
from strandloom.operators.lookup import ATTEMPT, EXACT, K, Cascade, Kmer, attempts_of
from strandloom.plans.chemistry import Chemistry, Kind

NO_TARGET = "NONE"


def once(udf: Callable[..., Column]) -> Callable[..., Column]:
    """A function that's called once a row. Spark pushes filters on a stage's columns through the stage, with the function and
    all it's called with in them again, unless it's told that another call may say something else."""
    return udf.asNondeterministic()


def attempt_column(bc: str, value: Column, start: int, end: int) -> Column:
    none = F.lit(None).cast("string")
    parts = {"bc": F.lit(bc), "method": F.lit(EXACT), "candidate": value, "match": value, "start": F.lit(start), "end": F.lit(end), "distance": F.lit(None).cast("int"), "upstream": none, "downstream": none}
    return F.struct(*(v.alias(k) for k, v in parts.items()))


def full_barcode(calls: Column) -> Column:
    """The barcodes of all components, in their order, as one."""
    return F.array_join(F.transform(calls, lambda c: c["value"]), "")


def extracted(reads: DataFrame, chemistry: Chemistry, fast: bool = False, tiers: tuple | None = None) -> DataFrame:
    """Reads with attempts, calls (an array of bc, value, start, end), success, perfect and full_barcode.

    Reads whose barcodes all stand where the layout says are settled by set membership in the JVM; only the others reach
    the matchers, as the one column of their sequence. Reads of under four bases raise there.
    tiers: matchers to try after the exact one, by their names, instead of those by k-mers and alignment.
    """
    chemistry.check()
    cascade = Cascade(chemistry, fast, tiers)
    pieces = {c.name: F.substr("seq", F.lit(c.start + 1), F.lit(c.size)) for c in chemistry.barcodes}
    exact = F.lit(True)
    for c in chemistry.barcodes:
        exact = exact & pieces[c.name].isin(list(chemistry.whitelist(c.name)))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([(k, pa.int32() if k in ("start", "end", "distance") else pa.string()) for k in ("bc", "method", "candidate", "match", "start", "end", "distance", "upstream", "downstream")]))
        for column in batches:
            yield pa.array(list(attempts_of(column.to_pylist(), cascade)), kind)

    search = once(F.arrow_udf(run, f"array<{ATTEMPT}>", ArrowUDFType.SCALAR_ITER))
    out = reads.withColumn("_exact", exact).withColumn("_searched", search(F.when(~F.col("_exact"), F.col("seq"))))
    settled = F.array(*(attempt_column(c.name, pieces[c.name], c.start, c.start + c.size) for c in chemistry.barcodes))
    out = out.withColumn("attempts", F.when(F.col("_exact"), settled).otherwise(F.col("_searched"))).drop("_searched")
    calls = F.transform(F.filter("attempts", lambda a: a["match"].isNotNull()), lambda a: F.struct(a["bc"].alias("bc"), a["match"].alias("value"), a["start"].alias("start"), a["end"].alias("end")))
    out = out.withColumn("calls", calls).withColumn("success", F.size("calls") == len(chemistry.barcodes))
    out = out.withColumn("full_barcode", F.when(F.col("success"), full_barcode(F.col("calls"))))
    return out.withColumnRenamed("_exact", "perfect")


def status(bc: str) -> Column:
    """``BC:METHOD[-EDn][-spacers]`` of a component's last tier: its match, -AMBIG if several tied, or NOMATCH."""
    own = F.filter("attempts", lambda a: a["bc"] == bc)
    last = F.element_at(own, -1)
    tied = F.size(F.filter(own, lambda a: a["method"] == last["method"])) > 1
    extra = F.concat(F.coalesce(F.concat(F.lit("-ED"), last["distance"].cast("string")), F.lit("")), *(F.coalesce(F.concat(F.lit("-"), last[s]), F.lit("")) for s in ("upstream", "downstream")))
    said = F.when(tied, F.concat(last["method"], F.lit("-AMBIG"))).when(last["match"].isNotNull(), F.concat(last["method"], extra)).otherwise("NOMATCH")
    return F.concat(F.lit(f"{bc}:"), said)


def status_line(chemistry: Chemistry) -> Column:
    """``name|SUCCESS:PERFECT:barcode|BC…`` or ``name|FAIL|BC…``."""
    won = F.concat(F.lit("SUCCESS:"), F.when(F.col("perfect"), "PERFECT").otherwise("CORROK"), F.lit(":"), F.col("full_barcode"))
    return F.concat_ws("|", "name", F.when(F.col("success"), won).otherwise("FAIL"), *(status(c.name) for c in chemistry.barcodes))


def called(bc: str) -> Column:
    return F.get(F.filter("calls", lambda c: c["bc"] == bc), F.lit(0))


def call(bc: str, field: str) -> Column:
    return called(bc)[field]


def with_umis(reads: DataFrame, chemistry: Chemistry) -> DataFrame:
    """Reads with umi (value, start, end) and umi_outcome: accepted, missing_left_anchor or truncated."""
    umi = chemistry.first(Kind.UMI)
    if umi is None:
        raise ValueError(f"{chemistry.name} has no UMI")
    anchor, gap = chemistry.anchor(umi.name)
    end = F.col("_end")  # a column of its own is evaluated once, however often it's used
    out = reads.withColumn("_end", call(anchor.name, "end")).withColumn("umi", S.umi_slice(F.col("seq"), end, gap, umi.size))
    out = out.withColumn("umi_outcome", F.when(end.isNull(), "missing_left_anchor").when(F.col("umi").isNull(), "truncated").otherwise("accepted"))
    right = chemistry.layout.beside(umi.name, 1)
    run = S.run_length(F.col("seq"), F.col("umi.end"), right.base) if right is not None and right.kind is Kind.HOMOPOLYMER else F.lit(None).cast("int")
    return out.withColumn("umi_run", run).drop("_end")


def with_targets(reads: DataFrame, chemistry: Chemistry) -> DataFrame:
    """Reads with target (NONE or an entry), target_start, target_end, target_distance, target_run and target_outcome.

    Windows after the anchor run repeat in a library, so a worker remembers what each one holds.
    """
    target = chemistry.first(Kind.TARGET)
    if target is None:
        raise ValueError(f"{chemistry.name} has no target index")
    anchor = chemistry.layout.beside(target.name, -1)
    if anchor is None or anchor.kind is not Kind.HOMOPOLYMER:
        raise ValueError(f"{target.name} doesn't follow a homopolymer")
    left, gap = chemistry.anchor(anchor.name)
    matcher = Kmer(chemistry, target, chemistry.errors.target)
    matcher.place.component = type(target)(target.name, target.kind, target.length)  # a window is a read without a layout
    matcher.place.drift, matcher.place.spacers = None, [None, None]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, dict | None] = {None: None}
        kind = pa.struct([("match", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())])
        for column in batches:
            if len(known) > 200_000:
                known = {None: None}
            values = column.to_pylist()
            for w in set(values) - known.keys():
                tried = matcher.tried(w)
                known[w] = {k: getattr(tried[0], k) for k in ("match", "start", "end", "distance")} if len(tried) == 1 and tried[0].match else None
            yield pa.array([known[w] for w in values], kind)

    find = once(F.arrow_udf(run, "struct<match:string,start:int,end:int,distance:int>", ArrowUDFType.SCALAR_ITER))
    run_pattern = S.anchor_pattern(anchor.base, anchor.min_run)
    out = reads.withColumn("_at", call(left.name, "end") + gap).withColumn("_rest", S.tail(F.col("seq"), F.col("_at")))
    out = out.withColumns({"_whole": F.length(F.regexp_extract("_rest", run_pattern, 0)), "_run": F.length(F.regexp_extract("_rest", run_pattern, 1))})
    low, high, matchable = S.target_bounds(F.col("seq"), F.col("_at") + F.col("_whole"), target.size, chemistry.errors.target, K)
    out = out.withColumns({"_low": low, "_high": high}).withColumn("_ok", matchable(F.col("_low"), F.col("_high")))
    out = out.withColumn("_found", find(F.when(F.col("_ok"), F.substr("seq", F.col("_low") + 1, F.col("_high") - F.col("_low")))))
    outcome = F.when(F.col("_at").isNull(), "no_left_anchor_pos").when(~F.col("_ok"), "short_window").when(F.col("_found").isNull(), "no_match").otherwise("matched")
    return out.withColumns(
        {
            "target": F.coalesce("_found.match", F.lit(NO_TARGET)),
            "target_start": F.col("_low") + F.col("_found.start"),
            "target_end": F.col("_low") + F.col("_found.end"),
            "target_distance": F.col("_found.distance"),
            "target_run": F.col("_run"),
            "target_outcome": outcome,
        }
    ).drop("_at", "_rest", "_whole", "_run", "_low", "_high", "_ok", "_found")


def annotated(reads: DataFrame, chemistry: Chemistry) -> DataFrame:
    """Reads whose name holds all that the stages found so far, as tags with their spans."""
    out = headers.with_parsed(reads, "name")
    add: list[tuple[str, Column]] = []
    if "calls" in reads.columns:
        out = out.withColumns({f"_{c.name}": called(c.name) for c in chemistry.barcodes})
        for c in chemistry.barcodes:
            own = F.col(f"_{c.name}")
            add += [(c.name, own["value"]), (c.spans, headers.span(own["start"], own["end"]))]
    if "umi" in reads.columns:
        umi = chemistry.first(Kind.UMI)
        add += [(umi.name, F.col("umi.value")), (umi.spans, headers.span(F.col("umi.start"), F.col("umi.end")))]
    if "target" in reads.columns:
        target = chemistry.first(Kind.TARGET)
        add += [(target.name, F.col("target")), (target.spans, headers.span(F.col("target_start"), F.col("target_end")))]
    names, tags = [k for k, _ in add], F.col("_tags")
    kept = F.filter(tags, lambda t: ~t["k"].isin(names)) if names else tags
    new = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in add)), lambda t: t["v"].isNotNull()) if add else F.array()
    name = headers.render(F.col("_read_id"), F.col("_passthrough"), F.concat(kept, new) if add else kept)
    return out.withColumn("name", name).drop("_read_id", "_passthrough", "_tags", *(f"_{c.name}" for c in chemistry.barcodes))


def parsed(reads: DataFrame, chemistry: Chemistry) -> DataFrame:
    """Reads with the columns that their header's tags stand for: read_id, calls, and umi and target where the layout has them."""
    umi, target = chemistry.first(Kind.UMI), chemistry.first(Kind.TARGET)
    placed = [*chemistry.barcodes, *(c for c in (umi, target) if c is not None)]
    out = headers.with_parsed(reads, "name").withColumn("_tag", F.map_from_entries("_tags"))
    out = out.withColumns({f"_{c.name}": headers.parse_span(F.col("_tag")[c.spans]) for c in placed})
    value, place = lambda c: F.col("_tag")[c.name], lambda c: F.col(f"_{c.name}")
    call = lambda c: F.struct(F.lit(c.name).alias("bc"), value(c).alias("value"), place(c)["start"].alias("start"), place(c)["end"].alias("end"))
    out = out.withColumn("read_id", F.col("_read_id")).withColumn("calls", F.filter(F.array(*(call(c) for c in chemistry.barcodes)), lambda c: c["value"].isNotNull()))
    if umi is not None:
        out = out.withColumn("umi", F.when(value(umi).isNotNull(), F.struct(value(umi).alias("value"), place(umi)["start"].alias("start"), place(umi)["end"].alias("end"))))
    if target is not None:
        out = out.withColumns({"target": F.coalesce(value(target), F.lit(NO_TARGET)), "target_start": place(target)["start"], "target_end": place(target)["end"]})
    return out.drop("_read_id", "_passthrough", "_tags", "_tag", *(f"_{c.name}" for c in placed))


def checked_headers(reads: DataFrame, key: str) -> None:
    """Raises if the first read's header doesn't have a tag, before anything is written; no reads are no error."""
    first = reads.select(headers.tag(headers.parse(F.col("name"))["tags"], key).isNotNull().alias("ok")).limit(1).collect()
    if first and not first[0].ok:
        raise ValueError(f"the first read has no {key} tag; is this the file of the stage before?")


def insert_cut(seq: Column, reference: Column, anchor) -> Column:
    """Where the insert begins: after the run of a homopolymer beside the reference, or after a component of fixed length."""
    if anchor is None:
        return reference
    if anchor.kind is Kind.HOMOPOLYMER:
        return S.anchor_run(seq, reference, anchor.base, anchor.min_run)["end"]
    return reference + anchor.size


def arm_of(cut: Column, seq: Column, matched: Column, target: Column) -> Column:
    """Where a read goes: to its target or to ``none``; null if no insert was sequenced, as the cut is at its end or after it."""
    return F.when(cut < F.length(seq), F.when(matched, target).otherwise("none"))


def prepared(reads: DataFrame, chemistry: Chemistry) -> DataFrame:
    """Reads with arm (none, a target, or null where no insert was sequenced), cut, read_id, header, insert_seq and insert_qual.

    Unmatched reads are cut after their UMI, matched ones after their target. A read without the span that its arm is cut
    at raises, whether its insert was sequenced or not.
    """
    umi, target = chemistry.first(Kind.UMI), chemistry.first(Kind.TARGET)
    if umi is None:
        raise ValueError(f"{chemistry.name} has no UMI to cut unmatched reads at")
    full = full_barcode(F.col("calls"))
    matched = F.col("target") != NO_TARGET if target is not None else F.lit(False)
    low = insert_cut(F.col("seq"), F.col("umi.end"), chemistry.layout.beside(umi.name, 1))
    high = insert_cut(F.col("seq"), F.col("target_end"), chemistry.layout.beside(target.name, 1)) if target is not None else low
    corrupt = F.col("umi").isNull() | (matched & F.col("target_end").isNull()) if target is not None else F.col("umi").isNull()
    stop = F.raise_error(F.concat(F.lit("a read has no span to cut at: "), F.col("read_id"))).cast("int")
    cut = F.when(corrupt, stop).otherwise(F.when(matched, high).otherwise(low))
    out = reads if "read_id" in reads.columns else reads.withColumn("read_id", headers.parse(F.col("name"))["read_id"])
    out = out.withColumn("cut", cut).withColumn("arm", arm_of(F.col("cut"), F.col("seq"), matched, F.col("target") if target is not None else F.lit(None)))
    header = F.when(F.col("arm") == "none", F.col("read_id")).otherwise(F.concat(F.col("read_id"), F.lit("|CB="), full, F.lit("|UR="), F.col("umi.value")))
    return out.withColumns({"header": header, "insert_seq": S.tail(F.col("seq"), F.col("cut")), "insert_qual": S.tail(F.col("qual"), F.col("cut"))})


def barcode_records(prepared_reads: DataFrame, chemistry: Chemistry) -> DataFrame:
    """(ord, read_id, seq, qual) of the unmatched arm's barcodes: corrected barcodes and UMI, with qualities of their declared lengths."""
    umi = chemistry.first(Kind.UMI)
    spans = [(call(c.name, "start"), c.size) for c in chemistry.barcodes] + [(F.col("umi.start"), umi.size)]
    qual = F.concat(*(F.substr("qual", s + 1, F.lit(n)) for s, n in spans))
    return prepared_reads.where("arm = 'none'").select("ord", "read_id", F.concat(full_barcode(F.col("calls")), "umi.value").alias("seq"), qual.alias("qual"))


def paired(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """r1 with seq2 and qual2 of its mate by read_id; a read without one raises. Ids that repeat pair up in their order."""
    from pyspark.sql.window import Window

    nth = lambda d: d.withColumn("_nth", F.row_number().over(Window.partitionBy("read_id").orderBy("ord")))
    mates = r2.select(headers.parse(F.col("name"))["read_id"].alias("read_id"), "ord", F.col("seq").alias("seq2"), F.col("qual").alias("qual2"))
    both = nth(r1).join(nth(mates).drop("ord").withColumn("_mate", F.lit(True)), ["read_id", "_nth"], "left")
    found = F.when(F.col("_mate"), F.col("seq2")).otherwise(F.raise_error(F.concat(F.lit("no second read of "), F.col("read_id"))).cast("string"))
    return both.withColumn("seq2", found).drop("_nth", "_mate")


def routed(rows: DataFrame, bucket: str, buckets: list[str]) -> dict[str, DataFrame]:
    """A frame for every bucket, empty ones included; a row of another bucket raises."""
    known = F.when(F.col(bucket).isNull() | F.col(bucket).isin(buckets), F.col(bucket)).otherwise(F.raise_error(F.concat(F.lit("no such bucket: "), F.col(bucket))).cast("string"))
    checked = rows.withColumn(bucket, known)
    return {b: checked.where(F.col(bucket) == b) for b in buckets}


def bucket_counts(rows: DataFrame, bucket: str, buckets: list[str]) -> DataFrame:
    """(bucket, n) of every bucket in the list, 0 for those without rows."""
    listed = rows.sparkSession.createDataFrame([(b,) for b in buckets], "bucket string")
    n = rows.groupBy(F.col(bucket).cast("string").alias("bucket")).agg(F.count("*").alias("n"))
    return listed.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

