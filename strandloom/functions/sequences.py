"""Sequence arithmetic as columns: runs, windows, slices and edit distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SHIFT, MAX_LEADING = 2, 2


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two texts of equal length; raises for others."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (~x.eqNullSafe(y)).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x)).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.raise_error(F.lit("lengths differ")).cast("int")))


def edit_distance(a: Column, b: Column, wildcard: bool = True) -> Column:
    """Levenshtein distance; with ``wildcard``, N on either side equals anything. The built-in is used where neither has an N."""
    plain = F.levenshtein(a, b)
    if not wildcard:
        return plain
    steps = F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1)))

    def row(before: Column, i: Column) -> Column:
        x = F.substr(a, i, F.lit(1))

        def cell(acc: Column, j: Column) -> Column:
            y = F.substr(b, j, F.lit(1))
            same = (x == y) | (x == "N") | (y == "N")
            best = F.least(F.element_at(before, j + 1) + 1, F.element_at(acc, -1) + 1, F.element_at(before, j) + F.when(same, 0).otherwise(1))
            return F.array_append(acc, best)

        return F.aggregate(steps, F.array(i), cell)

    table = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), F.sequence(F.lit(0), F.length(b)), row)
    general = F.when((a == "") | (b == ""), F.length(a) + F.length(b)).otherwise(F.element_at(table, -1))
    return F.when(a.contains("N") | b.contains("N"), general).otherwise(plain)


def tail(seq: Column, start: Column) -> Column:
    """What follows the first ``start`` characters; none past the end."""
    return F.substr(seq, start + 1)


def run_length(seq: Column, start: Column, base: str) -> Column:
    """How often ``base`` is repeated from a 0-based place on; 0 past the end."""
    return F.length(F.regexp_extract(tail(seq, start), f"^{base}*", 0))


def anchor_pattern(base: str, min_run: int, max_shift: int = MAX_SHIFT) -> str:
    """What an anchor run looks like from its expected place on; group 1 is the run without the shift before it."""
    return rf"^(?:[^{base}]{{1,{max_shift}}}(?={base}{{{min_run}}}))?({base}+(?:[^{base}]{base}{{{min_run},}})?)"


def anchor_run(seq: Column, expected: Column, base: str, min_run: int, max_shift: int = MAX_SHIFT) -> Column:
    """struct(start, end) of the run of ``base`` at a place, or up to ``max_shift`` after it if it then has ``min_run``.

    The end may reach over a single other base if ``min_run`` of the anchor follow. Without a run, both are the place.
    """
    pattern = anchor_pattern(base, min_run, max_shift)
    rest = tail(seq, expected)
    whole, run = F.length(F.regexp_extract(rest, pattern, 0)), F.length(F.regexp_extract(rest, pattern, 1))
    return F.struct((expected + whole - run).alias("start"), (expected + whole).alias("end"))


def target_bounds(seq: Column, run_end: Column, length: int, max_errors: int, k: int = 4) -> tuple:
    """(low, high, matchable) of where a target after an anchor run can be, clamped to the read; matchable is of low and high."""
    low = F.greatest(run_end - MAX_LEADING - max_errors, F.lit(0))
    high = F.least(run_end + length + max_errors, F.length(seq))
    return F.when(run_end.isNotNull(), low), F.when(run_end.isNotNull(), high), lambda a, b: b - a >= max(k, length - max_errors)


def target_window(seq: Column, run_end: Column, length: int, max_errors: int, k: int = 4) -> Column:
    """struct(start, sequence, matchable) of the window that ``target_bounds`` says."""
    low, high, matchable = target_bounds(seq, run_end, length, max_errors, k)
    window = F.when(high > low, F.substr(seq, low + 1, high - low)).otherwise("")
    return F.struct(low.alias("start"), window.alias("sequence"), matchable(low, high).alias("matchable"))


def umi_slice(seq: Column, anchor_end: Column, offset: int, length: int) -> Column:
    """struct(value, start, end) of a fixed slice after an anchor; null where the anchor is, or where the read ends before it."""
    start = anchor_end + offset
    whole = start + length <= F.length(seq)
    return F.when(whole, F.struct(F.substr(seq, start + 1, F.lit(length)).alias("value"), start.alias("start"), (start + length).alias("end")))


def sanitised(seq: Column) -> Column:
    return F.regexp_replace(seq, "[^ACGTN]", "N")


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Shared length of two half-open intervals, negative where they're apart."""
    return F.least(end_a, end_b) - F.greatest(start_a, start_b)


def deletions(entry: Column, n: int) -> Column:
    """All texts that remain of ``entry`` without up to ``n`` of its characters, itself included."""
    found = F.array(entry)
    for _ in range(n):
        shorter = F.flatten(F.transform(found, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))))
        found = F.array_distinct(F.concat(found, shorter))
    return found
