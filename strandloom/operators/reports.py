"""Stage statistics as one aggregate query each, the text reports made of them, and MultiQC payloads."""

from __future__ import annotations

import json
import math
import os
from collections import Counter
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.numbers import fraction, percent
from strandloom.operators.lookup import MATCHERS
from strandloom.plans.chemistry import Chemistry

NAMESPACE = "strandloom"


def frequencies(rows: DataFrame, column: str) -> DataFrame:
    """(column, n): rows of each value; nulls are left out."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))


def histogram(rows: DataFrame, column: str) -> dict:
    """Value to number of rows, in order; nulls are left out."""
    return dict(sorted((r[0], r.n) for r in frequencies(rows, column).collect()))


def tally(rows: DataFrame, *columns: str) -> Counter:
    """Rows of each combination of values, in one pass and without a filter, which Spark would push into what the rows are made of."""
    return Counter({tuple(r)[:-1]: r[-1] for r in rows.groupBy(*columns).agg(F.count("*")).collect()})


def marginal(counts: Counter, at: int, outcome: str | None = None) -> dict:
    """Value to number of rows at one place of a tally, in order; nulls are left out. outcome: those whose first value it is alone."""
    out: Counter = Counter()
    for k, n in counts.items():
        if k[at] is not None and outcome in (None, k[0]):
            out[k[at]] += n
    return dict(sorted(out.items()))


def breakdown(rows: DataFrame, by: str, column: str, outcomes: dict[str, str]) -> DataFrame:
    """(by, total, a column for each outcome, its fraction): how many rows of each group have each value, named by ``outcomes``."""
    counts = rows.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(F.col(column) == v).alias(k) for k, v in outcomes.items()))
    return counts.withColumns({f"{k}_fraction": F.round(fraction(F.col(k), F.col("total")), 6) for k in outcomes})


def histogram_lines(counts: dict, whole: int | None = None) -> list[str]:
    total = sum(counts.values()) if whole is None else whole
    return [f"\t{k}\t{n} ({percent(n, total)})" for k, n in counts.items()]


def extraction_stats(extracted: DataFrame, chemistry: Chemistry) -> dict[str, Any]:
    """Totals, and by component and method reads checked, matched, ambiguous, and edit distances of the attempts. No reads raise."""
    seen = F.transform("attempts", lambda a: F.struct(a["bc"].alias("bc"), a["method"].alias("method"), a["match"].isNotNull().alias("hit"), a["distance"].alias("distance"), (a["upstream"].isNotNull() | a["downstream"].isNotNull()).alias("beside")))
    # Reads that went alike are one row, so that reads are made and matched once whatever is counted of them.
    alike = extracted.groupBy("perfect", "success", "full_barcode", seen.alias("seen")).agg(F.count("*").alias("n"), F.min("ord").alias("first")).persist()
    try:
        outcomes = {(r.perfect, r.success): r.n for r in alike.groupBy("perfect", "success").agg(F.sum("n").alias("n")).collect()}
        tries = alike.select("n", "seen", F.explode(F.array_distinct(F.transform("seen", lambda a: F.struct(a["bc"], a["method"])))).alias("of"))
        own = F.filter("seen", lambda a: (a["bc"] == F.col("of.bc")) & (a["method"] == F.col("of.method")))
        found = tries.groupBy(own.alias("own")).agg(F.sum("n").alias("n")).collect()
        top = alike.where("success").groupBy("full_barcode").agg(F.sum("n").alias("n"), F.min("first").alias("first")).orderBy(F.desc("n"), "first").limit(10).collect()
    finally:
        alike.unpersist()
    total = sum(outcomes.values())
    if not total:
        raise ValueError("there are no reads")
    one = {"total": total, "perfect": sum(n for k, n in outcomes.items() if k[0]), "corrected": outcomes.get((False, True), 0), "failed": sum(n for k, n in outcomes.items() if k[1] is False)}
    counts: dict[tuple[str, str], Counter] = {}
    distances: dict[tuple[str, str], Counter] = {}
    for r in found:
        key, hit = (r.own[0].bc, r.own[0].method), any(a.hit for a in r.own)
        counts.setdefault(key, Counter()).update(checked=r.n, matched=r.n * hit, failed=r.n * (not hit), ambiguous=r.n * (len(r.own) > 1), spacers=r.n * sum(a.beside for a in r.own))
        for a in r.own:
            if a.distance is not None:
                distances.setdefault(key, Counter())[a.distance] += r.n
    parts = {}
    for c in chemistry.barcodes:
        for m in MATCHERS:
            if (k := (c.name, m)) in counts:
                parts[k] = {x: counts[k][x] for x in ("checked", "matched", "failed", "ambiguous")} | {"distances": dict(sorted(distances.get(k, {}).items())), "spacers": counts[k]["spacers"]}
    return one | {"top": [(r.full_barcode, r.n) for r in top], "parts": parts}


def extraction_report(stats: dict[str, Any]) -> str:
    total = stats["total"]
    lines = ["# Barcodes", f"Total reads: {total}"] + [f"{k.capitalize()}: {stats[k]} ({percent(stats[k], total)})" for k in ("perfect", "corrected", "failed")]
    lines += ["Most frequent barcodes:"] + [f"\t{b}\t{n / total:.2f}" for b, n in stats["top"]]
    for (bc, method), p in stats["parts"].items():
        lines += ["", f"## {bc} by {method}", f"Reads checked: {p['checked']}"] + [f"{k.capitalize()}: {p[k]} ({percent(p[k], p['checked'])})" for k in ("matched", "failed", "ambiguous")]
        if p["distances"]:
            lines += ["Edit distances:"] + histogram_lines(p["distances"])
    return "\n".join(lines) + "\n"


def combined_distances(stats: dict[str, Any]) -> dict[int, int] | None:
    """Edit distances over all components and methods; None if there are none."""
    out: dict[int, int] = {}
    for p in stats["parts"].values():
        for d, n in p["distances"].items():
            out[d] = out.get(d, 0) + n
    return dict(sorted(out.items())) or None


def umi_stats(rows: DataFrame) -> dict[str, Any]:
    """Outcomes and the run lengths of the anchor after accepted UMIs; the outcomes add up to the total."""
    counts = tally(rows, "umi_outcome", "umi_run")
    n = marginal(counts, 0)
    out = {"total": sum(n.values())} | {k: n.get(k, 0) for k in ("accepted", "missing_left_anchor", "truncated")}
    return out | {"runs": marginal(counts, 1, "accepted")}


def target_stats(rows: DataFrame) -> dict[str, Any]:
    """Outcomes, targets, edit distances and measured run lengths."""
    counts = tally(rows, "target_outcome", "target", "target_distance", "target_run")
    n = marginal(counts, 0)
    out = {"total": sum(n.values())} | {k: n.get(k, 0) for k in ("matched", "no_match", "no_left_anchor_pos", "short_window")}
    return out | {"targets": marginal(counts, 1, "matched"), "distances": marginal(counts, 2, "matched"), "runs": marginal(counts, 3)}


def prepare_stats(rows: DataFrame) -> dict[str, Any]:
    """Unmatched, targets and reads without an insert, which add up to the total."""
    total, n = rows.count(), histogram(rows, "arm")
    unmatched = n.pop("none", 0)
    return {"total": total, "unmatched": unmatched, "targets": n, "matched": sum(n.values()), "insert_not_sequenced": total - unmatched - sum(n.values())}


def linear_stats(rows: DataFrame) -> dict[str, Any]:
    """The measures of linear deduplication as nested counts."""
    out: dict[str, Any] = {"total": 0, "skipped": {}, "eligible": {}, "kept": {}}
    for r in rows.collect():
        if r.measure == "total":
            out["total"] = r.n
        else:
            out[r.measure][r.key] = r.n
    eligible, kept = sum(out["eligible"].values()), sum(out["kept"].values())
    return out | {"pairs_eligible": eligible, "pairs_kept": kept, "pairs_removed": eligible - kept}


def report(title: str, stats: dict[str, Any]) -> str:
    """Counts with their share of the total, and every histogram under a title of its own."""
    total = stats["total"]
    lines = [f"# {title}", f"Total reads: {total}"]
    lines += [f"{k.replace('_', ' ').capitalize()}: {v} ({percent(v, total)})" for k, v in stats.items() if isinstance(v, int) and k != "total"]
    for k, v in stats.items():
        if isinstance(v, dict):
            lines += ["", f"# {k.capitalize()}", *(histogram_lines(v) or ["\tnone"])]
    return "\n".join(lines) + "\n"


def detected_targets(stats: dict[str, Any]) -> str:
    """``target<tab>count`` lines, unmatched first, then by name; without those of none."""
    rows = [("NONE", stats["unmatched"]), *sorted(stats["targets"].items())]
    return "".join(f"{k}\t{n}\n" for k, n in rows if n)


def xy(counts: dict) -> list[list]:
    """Sorted [x, y] pairs of a line; an empty one raises."""
    if not counts:
        raise ValueError("a line without points")
    return [[k, counts[k]] for k in sorted(counts)]


def payload(stage: str, kind: str, plot: str, data: Any, title: str) -> dict[str, Any]:
    return {"id": f"{NAMESPACE}_{stage}_{kind}", "plot_type": plot, "section_name": title, "pconfig": {"id": f"{NAMESPACE}_{stage}_{kind}_plot", "title": title}, "data": data}


def payloads(stage: str, sample: str, stats: dict[str, Any]) -> list[dict[str, Any] | None]:
    """General numbers, the breakdown of outcomes, and a line for each histogram; None for empty ones."""
    plain = {k: v for k, v in stats.items() if isinstance(v, int)}
    general = {k: v for k, v in plain.items()} | {f"{k}_fraction": (v / stats["total"] if stats["total"] else 0.0) for k, v in plain.items() if k != "total"}
    out: list[dict[str, Any] | None] = [payload(stage, "general_stats", "generalstats", {sample: general}, f"{stage} in general"), payload(stage, "breakdown", "bargraph", {sample: {k: v for k, v in plain.items() if k != "total"}}, f"{stage} by outcome")]
    for k, v in stats.items():
        if isinstance(v, dict) and all(isinstance(n, int) for n in v.values()):
            text = any(isinstance(x, str) for x in v)
            out.append(payload(stage, k, "bargraph" if text else "linegraph", {sample: v if text else xy(v)}, f"{stage} by {k}") if v else None)
    return out


def rank_payload(sample: str, curve: list[tuple[int, int]]) -> dict[str, Any] | None:
    """The (rank, count) points of a rank curve, sampled before they reached the driver."""
    points = [[r, n] for r, n in sorted(curve) if n > 0]
    return payload("extract", "barcode_rank", "linegraph", {sample: points}, "barcodes by rank") if points else None


def rank_svg(curve: list[tuple[int, int]], knee: int | None = None, size: tuple[int, int] = (640, 480)) -> str:
    """A rank curve on logarithmic axes as SVG, with the last called rank marked; no points give empty axes."""
    points = [(r, n) for r, n in sorted(curve) if n > 0]
    width, height = size[0] - 60, size[1] - 60
    across, up = (math.log(max([p[k] for p in points] + [2])) for k in (0, 1))
    place = lambda r, n: (50 + width * math.log(r) / across, 10 + height * (1 - math.log(n) / up))
    line = " ".join(f"{x:.1f},{y:.1f}" for x, y in (place(r, n) for r, n in points))
    mark = "" if knee is None or not points else f'<line x1="{place(knee, 1)[0]:.1f}" x2="{place(knee, 1)[0]:.1f}" y1="10" y2="{10 + height}" stroke="grey" stroke-dasharray="4"/>'
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0]}" height="{size[1]}" font-family="sans-serif" font-size="12">'
        f'<path d="M50 10V{10 + height}H{50 + width}" fill="none" stroke="black"/><polyline points="{line}" fill="none" stroke="black"/>{mark}'
        f'<text x="{50 + width / 2}" y="{size[1] - 15}">rank</text><text x="5" y="{10 + height / 2}">count</text></svg>'
    )


def write_payloads(folder: str, prefix: str, items: list[dict[str, Any] | None]) -> list[str]:
    """Writes each payload as JSON. One without an id or data raises before anything is written; None is passed over."""
    real = [p for p in items if p is not None]
    for p in real:
        if not p.get("id") or not p.get("data"):
            raise ValueError("a payload has no id or no data")
    paths = []
    for p in real:
        paths.append(os.path.join(folder, f"{prefix}.{p['id'].removeprefix(NAMESPACE + '_')}_mqc.json"))
        with open(paths[-1], "w", encoding="utf-8") as f:
            json.dump(p, f, indent=2)
    return paths
