"""Read headers as columns: an id, loose tokens, and key=value tags in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN_SUFFIX = "_POS"


def position_key(name: str) -> str:
    return name + SPAN_SUFFIX


def held(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, also where ``f`` uses it for every element of an array.

    Spark evaluates an expression wherever it's written; only a function's element is a variable.
    """
    return F.get(F.transform(F.array(value), f), F.lit(0))


def tokens_of(header: Column) -> Column:
    return F.filter(F.split(F.trim(header), r"\s+"), lambda x: x != "")


def rest_of(tokens: Column) -> Column:
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))


def loose_of(rest: Column) -> Column:
    return F.filter(rest, lambda x: ~x.contains("="))


def pairs_of(rest: Column) -> Column:
    key = lambda x: F.substring_index(x, "=", 1)
    return F.transform(F.filter(rest, lambda x: x.contains("=")), lambda x: F.struct(key(x).alias("k"), F.substr(x, F.length(key(x)) + 2).alias("v")))


def tags_of(pairs: Column) -> Column:
    """Pairs without repeated keys; those of most headers as they are, since to look for repeats takes the square of their number."""
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    last = F.transform(names, lambda n: F.struct(n.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == n), -1)["v"].alias("v")))
    return F.when(F.size(names) == F.size(pairs), pairs).otherwise(last)


def parse(header: Column) -> Column:
    """struct(read_id, passthrough, tags) of a header; a tag given twice keeps its first place and its last value."""
    whole = lambda t, r: F.struct(F.get(t, F.lit(0)).alias("read_id"), loose_of(r).alias("passthrough"), held(pairs_of(r), tags_of).alias("tags"))
    return held(tokens_of(header), lambda t: whole(t, rest_of(t)))


def with_parsed(rows: DataFrame, header: str) -> DataFrame:
    """Rows with _read_id, _passthrough and _tags as ``parse`` has them. Each step is a column of its own, which is evaluated once."""
    out = rows.withColumn("_tokens", tokens_of(F.col(header))).withColumn("_rest", rest_of(F.col("_tokens")))
    out = out.withColumns({"_read_id": F.get("_tokens", F.lit(0)), "_passthrough": loose_of(F.col("_rest")), "_pairs": pairs_of(F.col("_rest"))})
    return out.withColumn("_tags", tags_of(F.col("_pairs"))).drop("_tokens", "_rest", "_pairs")


def render(read_id: Column, passthrough: Column, tags: Column) -> Column:
    """The header text: id, loose tokens, then tags."""
    return F.concat_ws(" ", F.array(read_id), passthrough, F.transform(tags, lambda t: F.concat(t["k"], F.lit("="), t["v"])))


def tag(tags: Column, key: str) -> Column:
    """The value of a tag, null if it's absent."""
    return F.get(F.filter(tags, lambda t: t["k"] == key), F.lit(0))["v"]


def with_tag(tags: Column, key: str, value: Column) -> Column:
    """Tags with one set: in its place if it's there, else at the end."""
    one = F.struct(F.lit(key).alias("k"), value.alias("v"))
    return F.when(F.exists(tags, lambda t: t["k"] == key), F.transform(tags, lambda t: F.when(t["k"] == key, one).otherwise(t))).otherwise(F.concat(tags, F.array(one)))


def span(start: Column, end: Column) -> Column:
    """``start:end``; raises where it isn't 0 <= start <= end."""
    ok = (start >= 0) & (start <= end)
    return F.when(ok, F.concat(start.cast("string"), F.lit(":"), end.cast("string"))).otherwise(F.when(start.isNotNull() & end.isNotNull(), F.raise_error(F.lit("a span isn't 0 <= start <= end")).cast("string")))


def parse_span(text: Column) -> Column:
    """struct(start, end) of a span's text, null of null; raises for anything else than two whole numbers in order."""
    ok = text.rlike(r"^\d+:\d+$")
    start, end = (F.try_element_at(F.split(text, ":"), F.lit(i)).try_cast("int") for i in (1, 2))
    good = F.struct(start.alias("start"), end.alias("end"))
    return F.when(text.isNull(), F.lit(None)).when(ok & (start <= end), good).otherwise(F.raise_error(F.concat(F.lit("no span: "), text)).cast("struct<start:int,end:int>"))


def file_prefix(path: Column) -> Column:
    """The base name of a path up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)
