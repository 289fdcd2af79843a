"""Toxicity from a learned lexicon: a trie intersected with Levenshtein automata, and scores of context windows."""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from strandloom.llm.common import shipped, slices, table, trim, utf8
from strandloom.llm.simhash import shingle_hashes

#: Labelled rows, at most, that the lexicon and the weights are learned from: so many of each label, by the hash of their id.
TRAIN_TOXIC, TRAIN_CLEAN = 1500, 3000
#: The shortest word that counts, the shortest that also counts misspelled.
MIN_LETTERS, MIN_FUZZY = 4, 5
#: A stem stands for all words that begin with it; it takes so many different words to be one.
STEM_LETTERS, STEM_WORDS = range(4, 9), 3
#: Share of a stem's texts that a longer stem must have to stand for it.
SHARED = 0.9
#: Words on either side of a hit that its window holds.
WINDOW = 15
#: Share of the strongest term's evidence under which a term has to tell texts that no stronger one does.
WEAK = 0.2
#: Characters that are turned into arrays at once.
PART = 1 << 20
#: Signs that may replace a letter inside a word.
INSIDE = "@$*!|"
#: Log odds of a term that is worth a whole hit; less counts in proportion.
SURE = 4.0
#: Misspelled forms of a term in toxic texts that an innocent word near it weighs as much as: where there is one, more are unseen.
NEIGHBOUR = 4
FEATURES = ("plain", "stem", "fuzzy", "quoted", "dense")


#: 1 for the code points that words are made of.
WORD = np.array([chr(i).isalnum() for i in range(0x110000)], np.uint8)


def words_of(text: str) -> list[str]:
    return regex.findall(r"[^\W\d_]+", text.lower())


class Automaton:
    """All texts within one edit of a term, as a table: the trie of terms times the Levenshtein automaton, made deterministic.

    Terms that end in * are stems: whatever begins with one is accepted. States: 0 is dead, 1 the start.
    """

    def __init__(self, terms: list[str], exact: set[str] = frozenset()):
        """exact: the terms that nothing else stands for."""
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        stems: set[int] = set()
        for k, term in enumerate(terms):
            at = 0
            for c in term.rstrip("*"):
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = k
            if term.endswith("*"):
                stems.add(at)
        long = {k for k, t in enumerate(terms) if not t.endswith("*") and len(t) >= MIN_FUZZY and t not in exact}
        # Nodes from which a term that may be misspelled can be reached.
        reach = [ends[i] in long for i in range(len(children))]
        for i in reversed(range(len(children))):
            reach[i] = reach[i] or any(reach[j] for j in children[i].values())
        alphabet = sorted({c for node in children for c in node})
        self.classes = {c: i + 2 for i, c in enumerate(alphabet)}  # 0: no word character, 1: any other word character

        def closed(states: set[tuple[int, int]]) -> frozenset:
            more = {(j, 1) for i, e in states if e == 0 for j in children[i].values() if reach[j]}
            states |= more
            return frozenset(s for s in states if s[1] == 0 or (s[0], 0) not in states)

        def step(states: frozenset, c: str) -> frozenset:
            out = set()
            for i, e in states:
                if i in stems and e == 0:
                    return frozenset({(i, 0)})
                j = children[i].get(c)
                if j is not None and (e == 0 or reach[j]):
                    out.add((j, e))
                if e == 0:
                    out |= {(x, 1) for y, x in children[i].items() if y != c and reach[x]}
                    if reach[i]:
                        out.add((i, 1))
            for i, e in out:
                if i in stems and e == 0:
                    return frozenset({(i, 0)})
            return closed(out)

        ids = {frozenset(): 0, closed({(0, 0)}): 1}
        todo, rows = [frozenset(), closed({(0, 0)})], []
        for states in todo:  # grows
            row = [0]
            for c in ["", *alphabet]:
                to = step(states, c)
                if to not in ids:
                    ids[to] = len(todo)
                    todo.append(to)
                row.append(ids[to])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.kind = np.zeros(len(todo), np.int8)  # of what a word that ends here is: 1 the term, 2 of its stem, 3 one edit from it
        self.term = np.zeros(len(todo), np.int32)
        for k, states in enumerate(todo):
            found = [(1 if i not in stems else 2, ends[i]) for i, e in states if e == 0 and ends[i] >= 0] or [(3, ends[i]) for i, e in states if e == 1 and ends[i] in long]
            if found:
                self.kind[k], self.term[k] = min(found)

    def tables(self) -> np.ndarray:
        """The class of each code point, folded to lower case."""
        out = WORD.copy()
        for c, k in self.classes.items():
            for x in {c, c.upper()}:
                if len(x) == 1:
                    out[ord(x)] = k
        for c in INSIDE:
            out[ord(c)] = 255
        return out


class Model:
    """An automaton with the weights of its hits."""

    def __init__(self, odds: dict[str, float], innocent: dict[str, float] | None = None):
        """innocent: words near terms that say nothing; they are found as themselves, with no weight, and so not as misspelled terms."""
        weights = odds | {w: 0.0 for w in innocent or () if w not in odds}
        self.automaton = Automaton(list(weights), set(weights) - set(odds))
        self.codes = self.automaton.tables()
        self.odds = np.array([min(1.0, x / SURE) for x in weights.values()])  # weight of a hit of each term
        self.fuzzy = np.ones(len(weights))  # weight of a hit that is misspelled, beside that
        self.weights = np.zeros(len(FEATURES) + 1)

    def state(self) -> dict:
        """The model as numbers and texts alone, as it goes from the task that fits it to the driver."""
        a = self.automaton
        return {"automaton": {k: getattr(a, k) for k in ("terms", "classes", "table", "kind", "term")}} | {k: getattr(self, k) for k in ("odds", "fuzzy", "weights")}

    @classmethod
    def of(cls, state: dict) -> "Model":
        model, automaton = cls.__new__(cls), Automaton.__new__(Automaton)
        automaton.__dict__.update(state["automaton"])
        model.__dict__.update({k: v for k, v in state.items() if k != "automaton"}, automaton=automaton, codes=automaton.tables())
        return model

    def hits(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Of all words that are hits: text, word number, start and end in it, term, kind, and whether it stands in quotes."""
        sizes = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(sizes + 1)
        raw = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        cls = self.codes[raw]
        odd = np.flatnonzero(cls == 255)
        odd_ok = (odd > 0) & (odd < len(cls) - 1)
        inner = np.zeros(len(odd), bool)
        at = odd[odd_ok]
        inner[odd_ok] = (cls[at - 1] > 0) & (cls[at + 1] > 0) & (cls[at - 1] < 255) & (cls[at + 1] < 255)
        cls[odd] = np.where(inner, 1, 0)
        inside = cls > 0
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        a = self.automaton
        state = np.ones(len(start), np.int32)
        live, k = np.arange(len(start)), 0
        while len(live):
            go = end[live] - start[live] > k
            live = live[go]
            state[live] = a.table[state[live], cls[start[live] + k]]
            live = live[state[live] > 0]
            k += 1
        word = np.flatnonzero(a.kind[state] > 0)
        text = np.searchsorted(ends, start[word], side="right")
        first = np.searchsorted(start, np.concatenate(([0], ends[:-1])))  # a text's first word
        # Quotes open and close within a line.
        s = start[word]
        lines = np.concatenate(([-1], np.flatnonzero(raw == 0x0A)))
        line = lines[np.searchsorted(lines, s) - 1]

        def before(*marks: int) -> np.ndarray:
            """How many of the marks stand in a hit's line before it."""
            at = np.flatnonzero(np.isin(raw, marks)) if len(marks) > 1 else np.flatnonzero(raw == marks[0])
            return np.searchsorted(at, s) - np.searchsorted(at, line)

        quoted = (before(0x22) % 2 == 1) | (before(0x201C, 0xAB, 0x201E) > before(0x201D, 0xBB))
        base = np.concatenate(([0], ends[:-1]))[text]
        return text, word - first[text], s - base, end[word] - base, a.term[state[word]], a.kind[state[word]], quoted

    def features(self, texts: list[str]) -> np.ndarray:
        text, word, _, _, term, kind, quoted = self.hits(texts)
        out = np.zeros((len(texts), len(FEATURES)))
        weight = self.odds[term] * np.where(kind == 3, self.fuzzy[term], 1.0)
        for j, at in enumerate(((kind == 1) & ~quoted, (kind == 2) & ~quoted, (kind == 3) & ~quoted, quoted)):
            np.add.at(out[:, j], text[at], weight[at])
        sure = np.flatnonzero((weight >= 0.5) & ~quoted)
        for j in range(1, min(4, len(sure))):  # hits that share a window
            near = (text[sure[j:]] == text[sure[:-j]]) & (word[sure[j:]] - word[sure[:-j]] <= WINDOW)
            np.add.at(out[:, 4], text[sure[j:]][near], 1.0)
        return np.minimum(out, 4.0)

    def score(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self.features(texts) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def parts_of(texts: list[str], most: int = PART) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of runs of texts of about ``most`` characters; a longer text is a run of its own."""
    first = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield first, texts[first:i]
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, texts[first:]


def stems(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEM_LETTERS if n < len(word)]


class Sample:
    """Which words and stems of toxic texts each labelled text has, as numbers, with a print that near copies share."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.toxic = toxic
        ids: dict[str, int] = {}
        under: list[tuple[int, int]] = []
        pairs: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        self.prints = np.zeros(len(texts), np.uint64)
        for y in (1, 0):
            for i in np.flatnonzero(toxic == y).tolist():
                ws = words_of(texts[i])
                self.prints[i] = shingle_hashes(texts[i].encode(), 5).min(initial=np.uint64(2**64 - 1))
                own = set()
                for w in {w for w in ws if len(w) >= MIN_LETTERS}:
                    if y and w not in ids:
                        ids[w] = k = len(ids)
                        under += [(ids.setdefault(t, len(ids)), k) for t in stems(w)]
                    own.update(ids[t] for t in (w, *stems(w)) if t in ids)
                pairs[i] = np.fromiter(own, np.int32, len(own))
        self.pairs, self.terms, self.under = pairs, list(ids), np.array(under, np.int64).reshape(-1, 2)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """In how many prints of these rows each term is."""
        which = np.unique(self.prints[rows], return_inverse=True)[1]
        both = [self.pairs[i].astype(np.int64) * (len(rows) + 1) + w for i, w in zip(rows.tolist(), which.tolist(), strict=True)]
        return np.bincount(np.unique(np.concatenate([*both, np.zeros(0, np.int64)])) // (len(rows) + 1), minlength=len(self.terms))


def lexicon(sample: Sample, rows: np.ndarray) -> dict[str, float]:
    """Words and stems that tell toxic texts, each by a binomial test corrected for their number, with their log odds.

    Near copies count once. A stem has to hold without its most frequent word, too; else it's that word.
    """
    toxic, clean = rows[sample.toxic[rows] == 1], rows[sample.toxic[rows] == 0]
    n1, n0 = len(np.unique(sample.prints[toxic])), len(np.unique(sample.prints[clean]))
    if not n0 or not n1:
        return {}
    k1, k0 = sample.counts(toxic), sample.counts(clean)
    base = n1 / (n0 + n1)
    stem = np.array([t[-1] == "*" for t in sample.terms], bool)
    top, kinds = np.zeros(len(stem), np.int64), np.zeros(len(stem), np.int64)
    np.maximum.at(top, sample.under[:, 0], k1[sample.under[:, 1]])
    np.add.at(kinds, sample.under[:, 0], (k1[sample.under[:, 1]] > 0).astype(np.int64))
    candidate = (k1 >= 3) & (~stem | (kinds >= STEM_WORDS))
    least = math.log(20 * max(1, int(candidate.sum())))

    def evidence(n: np.ndarray, k: np.ndarray) -> np.ndarray:
        p = k / np.maximum(1, n + k)
        with np.errstate(divide="ignore", invalid="ignore"):
            e = (n + k) * (p * np.log(p / base) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - base)), 0))
        return np.where(p > base, e, 0.0)

    own, rest = evidence(k0, k1), k1 - top
    good = candidate & (k0 * n1 <= 0.1 * k1 * n0) & (own >= least) & (~stem | ((evidence(k0, rest) >= least) & (2 * rest > k1)))
    found = {sample.terms[i]: i for i in np.flatnonzero(good).tolist()}
    out: list[str] = []
    for t in sorted((t for t in found if t[-1] == "*"), key=lambda t: (len(t), t)):
        if not any(t.startswith(x[:-1]) or x.startswith(t[:-1]) for x in out):
            # The longest stem that nearly all of its words share is the least likely to have others.
            longer = [x for x in found if x[-1] == "*" and x.startswith(t[:-1]) and k1[found[x]] >= SHARED * k1[found[t]]]
            out.append(max(longer, key=lambda x: (len(x), x)))
    out += [t for t in found if t[-1] != "*" and not any(t.startswith(x[:-1]) for x in out if x[-1] == "*")]
    # A weak word of texts that strong ones tell anyway is one of their copies' own words.
    best = max((own[found[t]] for t in out), default=0.0)
    strong = {found[t] for t in out if own[found[t]] >= WEAK * best}
    lone: dict[int, set] = defaultdict(set)
    for i in toxic.tolist():
        if strong.isdisjoint(terms := sample.pairs[i].tolist()):
            for t in terms:
                lone[t].add(sample.prints[i])
    out = [t for t in out if found[t] in strong or len(lone[found[t]]) >= 2]
    odds = lambda i: math.log((k1[i] + 0.5) / (n1 + 1) * (n0 + 1) / (k0[i] + 0.5))
    return {t: odds(found[t]) for t in sorted(out)}


def neighbours(model: Model, texts: list[str], toxic: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
    """(innocent words, weight of each term's misspelled forms) from the words of texts that are one edit from a term.

    A form is innocent if its share of clean texts that have it is a tenth of that of toxic ones or more: an ordinary word,
    whatever it is near. A term's other forms count by how many of them there are beside its innocent ones.
    """
    seen: dict[tuple[str, str], list[set]] = defaultdict(lambda: [set(), set()])
    for at, part in parts_of(texts):
        for t, _, s, e, term, kind, quoted in zip(*(x.tolist() for x in model.hits(part)), strict=True):
            if kind == 3 and not quoted:
                seen[model.automaton.terms[term], part[t][s:e].lower()][int(toxic[at + t])].add(at + t)
    n1, n0 = max(1, int(toxic.sum())), max(1, int((toxic == 0).sum()))
    innocent, told, plain = {}, defaultdict(int), defaultdict(int)
    for (term, form), (clean, bad) in seen.items():
        if len(clean) * n1 > 0.1 * len(bad) * n0:
            innocent[form] = 0.0
            plain[term] += 1
        else:
            told[term] += 1
    return innocent, {t: (told[t] + 1) / (told[t] + 1 + NEIGHBOUR * plain[t]) for t in model.automaton.terms}


def fit(texts: list[str], toxic: np.ndarray) -> Model:
    """Learns lexicon and weights. The weights come from hits of a lexicon that the other half of the rows gave."""
    sample = Sample(texts, toxic)
    half = (sample.prints % np.uint64(2)).astype(np.int64)

    def learned(rows: np.ndarray) -> Model:
        odds = lexicon(sample, rows)
        innocent, fuzzy = neighbours(Model(odds), [texts[i] for i in rows.tolist()], toxic[rows])
        model = Model(odds, innocent)
        model.fuzzy = np.array([fuzzy.get(t, 1.0) for t in model.automaton.terms])
        return model

    model = learned(np.arange(len(texts)))
    x, y = [np.zeros((0, len(FEATURES)))], [np.zeros(0)]
    for h in (0, 1):
        own, other = np.flatnonzero(half == h), np.flatnonzero(half != h)
        part = learned(other)
        if len(own):
            x += [part.features(ts) for _, ts in parts_of([texts[i] for i in own])]
            y.append(toxic[own])
    x, y = np.concatenate(x), np.concatenate(y)
    z = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(z.shape[1])
    ridge = np.array([1e-3, *[0.3] * len(FEATURES)])
    prior = np.array([0.0, 5.0, 5.0, 4.0, 0.5, 0.5])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * (w - prior)
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6), grad)
    w[1:] = np.maximum(w[1:], 0.0)
    w[0] = min(w[0], -0.5)  # a text without hits is clean
    w[1:4] = np.maximum(w[1:4], 0.5 - w[0])  # one with a single sure hit outside quotes isn't
    w[3] = min(w[3], w[1])  # a misspelled word says no more than the word
    model.weights = w
    return model


def held_out(key: str = "doc_id") -> "F.Column":
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fold: "F.Column | None" = None) -> Model:
    """Fits on TRAIN_TOXIC and TRAIN_CLEAN labelled rows at most, those with the lowest hashes of their ids, none held out.

    Texts are gathered, and the model is fitted, in one task; only the model comes to the driver. Ids without a text or
    labelled otherwise than 0 or 1 don't count, repeated labels count once, and of texts with the same id the least in
    order does. Without any labelled text, or with one label alone, no text has a hit.
    """
    learn = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).where(~F.coalesce(held_out(key) if fold is None else fold, F.lit(True)))
    parts = [learn.where(F.col(label) == y).select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_y")).distinct().orderBy(F.xxhash64("_key"), "_key").limit(n) for y, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(chosen, "_key").where("_text is not null").groupBy("_key", "_y").agg(F.min("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("_key", pa.string()), ("_y", pa.int32()), ("_text", pa.string())]))
        order = sorted(zip(*(rows[c].to_pylist() for c in ("_key", "_y", "_text")), strict=True))
        model = fit([t for _, _, t in order], np.array([y for _, y, _ in order], np.int64))
        del rows, order
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.state())], pa.binary())], ["model"])

    fitted = rows.select(F.col("_key").cast("string"), "_y", "_text").coalesce(1).mapInArrow(run, "model binary").first()
    return Model.of(pickle.loads(bytes(fitted.model))) if fitted else fit([], np.zeros(0, np.int64))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Docs with a column ``score`` from 0 to 1; one of that name is replaced. Null and empty texts count as without hits."""
    held = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            parts = [held().score([t.decode() for t in part.column(0).to_pylist()]) for part in slices(iter([pa.RecordBatch.from_arrays([column], ["t"])]), "t", PART)]
            yield pa.array(np.concatenate([*parts, np.zeros(0)]))

    return docs.withColumn(score, F.arrow_udf(run, "double", ArrowUDFType.SCALAR_ITER)(utf8(text)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity: doc_id, held_out, score from 0 to 1, and predicted, 1 from 0.5.

    Null and empty texts score as texts without hits, repeated rows give equal rows, and no documents no rows. Labels of
    ids whose crc32 is divisible by 5 are never learned from; without any label every score is that of a text without hits.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
