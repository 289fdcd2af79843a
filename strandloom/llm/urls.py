"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule covers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from strandloom.llm.common import shipped, table

#: Different labelled URLs that the trees learn from, give or take some per cent; all if there are fewer.
TRAIN_URLS = 20_000
#: Trees, their depth, the bins of a feature, the step of each tree, and the least weight of a leaf.
TREES, DEPTH, BINS, RATE, LEAF = 60, 3, 32, 0.2, 5.0
#: Labelled URLs with a suffix (the last label, the last two) that its block rate is shrunk by.
SHRINK = 20.0
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
FEATURES = ("length", "host_length", "labels", "depth", "digits", "entropy", "host_entropy", "parameters", "hyphens", "fragment", "suffix", "domain", "segment")


def split_url(url: str) -> tuple["F.Column", "F.Column"]:
    """(host, path) of a column of URLs, both empty where it is null or has no ``://``; A-Z of the host in lower case."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def matched(rules: tuple, host: str, path: str) -> tuple["F.Column", "F.Column"]:
    """(rule, verdict) of the longest rule that fits; of equally long ones a block; null without any."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        h, slash, p = text.partition("/")
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def entropy(data: bytes) -> float:
    if not data:
        return 0.0
    n = np.bincount(np.frombuffer(data, np.uint8))
    p = n[n > 0] / len(data)
    return float(-(p * np.log2(p)).sum())


def suffixes(host: str, path: str) -> tuple:
    """What block rates are kept of: the last label, the last two, and the path's first segment."""
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), "/" + path[1:].partition("/")[0]


def lexical(url: str, host: str, path: str, rates: dict[str, float], base: float) -> list[float]:
    """The features of one URL; suffixes without labelled URLs count as the average."""
    url = url or ""
    query = url.partition("#")[0].partition("?")[2]
    last, two, segment = suffixes(host, path)
    digits = sum(c.isdigit() for c in url)
    return [len(url), len(host), host.count(".") + 1 if host else 0, path.count("/"), digits / max(1, len(url)), entropy(url.encode("utf-8", "replace")), entropy(host.encode("utf-8", "replace")), len([x for x in query.split("&") if x]), url.count("-"), float("#" in url), rates.get(last, base), rates.get(two, rates.get(last, base)), rates.get(segment, base)]


@dataclass
class Trees:
    """Boosted trees of the log odds that a URL is blocked: of each, features and thresholds by level order, and leaf values."""

    rates: dict[str, float]
    base: float
    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[np.arange(len(x)), f[node]] > t[node])
            out += v[node - len(f)]
        return out

    def score(self, urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
        """The probability of each URL that it's to be blocked."""
        if not urls:
            return np.zeros(0)
        x = np.array([lexical(u, h, p, self.rates, self.base) for u, h, p in zip(urls, hosts, paths, strict=True)])
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def suffix_rates(hosts: list[str], paths: list[str], y: np.ndarray, source: list[str], base: float) -> dict[str, float]:
    """The share of blocked URLs by suffix; a suffix that a single source has labelled only says what that source covers, so it has none."""
    count: dict[str, list] = {}
    for h, p, b, r in zip(hosts, paths, y.tolist(), source, strict=True):
        for s in {*suffixes(h, p)}:
            c = count.setdefault(s, [0.0, 0.0, set()])
            c[0] += b
            c[1] += 1
            c[2].add(r)
    return {s: (b + SHRINK * base) / (n + SHRINK) for s, (b, n, sources) in count.items() if len(sources) > 1}


def boost(urls: list[str], hosts: list[str], paths: list[str], blocked: np.ndarray, source: list[str]) -> Trees:
    """Fits the trees to the logistic loss by histograms. Without URLs of both labels, every score is the labels' average, or 0."""
    y = blocked.astype(float)
    base = float(y.mean()) if len(y) else 0.0
    nodes = 2**DEPTH - 1
    if base in (0.0, 1.0):
        return Trees({}, base, 30.0 if base else -30.0, np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)))
    # A URL's own label isn't in the suffix rates that it is trained with: each half has those of the other.
    half = np.arange(len(urls)) % 2
    x = np.zeros((len(urls), len(FEATURES)))
    for k in (0, 1):
        other = np.flatnonzero(half != k)
        rates = suffix_rates([hosts[i] for i in other], [paths[i] for i in other], y[other], [source[i] for i in other], base)
        for i in np.flatnonzero(half == k):
            x[i] = lexical(urls[i], hosts[i], paths[i], rates, base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    start = float(np.log(base / (1 - base)))
    margin = np.full(len(y), start)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            best = np.full(wide, 1e-9)
            at = node - first
            for j, c in enumerate(cuts):
                key = at * (BINS + 1) + binned[:, j]
                sums = [np.bincount(key, v, wide * (BINS + 1)).reshape(wide, -1).cumsum(1) for v in (g, h)]
                gl, hl = sums[0][:, :-1], sums[1][:, :-1]
                gt, ht = sums[0][:, -1:], sums[1][:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(hl < LEAF / 4) | (ht - hl < LEAF / 4)] = 0
                gain = gain[:, : len(c)]
                if gain.shape[1]:
                    pick = gain.argmax(1)
                    better = np.flatnonzero(gain[np.arange(wide), pick] > best)
                    best[better] = gain[better, pick[better]]
                    feature[first + better], threshold[first + better] = j, c[pick[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - nodes
        value = -RATE * np.bincount(leaf, g, nodes + 1) / (np.bincount(leaf, h, nodes + 1) + 1)
        margin += value[leaf]
        trees.append((feature, threshold, value))
    return Trees(suffix_rates(hosts, paths, y, source, base), base, start, *(np.stack(t) for t in zip(*trees, strict=True)))


def train(pages: DataFrame, url: str = "url", rules: tuple = RULES) -> Trees:
    """Fits the trees on URLs that a rule labels, about TRAIN_URLS different ones, those with the lowest hashes; no more come to the driver.

    Null URLs and those without a rule don't count, repeated ones count once. Without any, every score is 0.
    """
    host, path = split_url("_url")
    named = pages.select(F.col(url).alias("_url")).where("_url is not null").select("_url", host.alias("_host"), path.alias("_path"))
    rule, verdict = matched(rules, "_host", "_path")
    labelled = named.select("*", rule.alias("_rule"), verdict.alias("_verdict")).where("_verdict is not null")
    # The share of hashes that this many different URLs have, by an estimate of how many there are.
    share = TRAIN_URLS / max(1, labelled.agg(F.approx_count_distinct("_url", 0.02)).first()[0])
    if share < 1:
        labelled = labelled.where(F.shiftrightunsigned(F.xxhash64("_url"), 1) < F.lit(int(share * 2**63)))
    rows = sorted(labelled.distinct().collect(), key=lambda r: r._url)
    return boost([r._url for r in rows], [r._host for r in rows], [r._path for r in rows], np.array([r._verdict == "block" for r in rows], bool), [r._rule for r in rows])


def judged(pages: DataFrame, url: str = "url", rules: tuple = RULES, model: Trees | None = None) -> DataFrame:
    """Pages with host, path, rule, score and verdict; columns of those names are replaced.

    The longest rule that fits decides; where none does, ``block`` if the trees' probability is 0.5 or more, else ``allow``.
    Null URLs and those without ``://`` have empty host and path, fit no rule and are judged by the trees.
    """
    trees = shipped(pages.sparkSession, model or train(pages, url, rules))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for u, h, p in batches:
            yield pa.array(trees().score(u.to_pylist(), h.to_pylist(), p.to_pylist()), pa.float64())

    score = F.arrow_udf(run, "double", ArrowUDFType.SCALAR_ITER)
    host, path = split_url("_url")
    out = pages.withColumn("_url", F.col(url)).withColumn("host", host).withColumn("path", path)
    rule, verdict = matched(rules, "host", "path")
    out = out.withColumns({"rule": rule, "_verdict": verdict, "score": score("_url", "host", "path")})
    return out.withColumn("verdict", F.coalesce("_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))).drop("_url", "_verdict")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's host, path, rule, verdict and score. Null URLs and those without ``://`` have an empty host and path and no rule; repeated rows give equal rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "score")
