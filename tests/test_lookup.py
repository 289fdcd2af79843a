import random
from dataclasses import replace

import numpy as np
import pytest

from strandloom.operators import lookup as L
from strandloom.operators import reads
from strandloom.plans import chemistry as C

ENTRIES = ("ACGTTGCAAC", "TTGACCGATA", "GGCATTACGA", "CATGGTCTAC")


def kit(name="custom_seq_1_0"):
    base = C.chemistry(name)
    return replace(base, whitelists=base.whitelists | dict.fromkeys(("BC1", "BC2", "BC3"), ENTRIES))


def read(a=ENTRIES[0], b=ENTRIES[1], c=ENTRIES[2], tail="ACGTACGAGGGGGGTATAGCCT"):
    return a + "TGTGTATAAGGACCTCGTTGCC" + b + "ATGGAAGCCGACGAATTAGACC" + c + tail


def calls(seq, name="custom_seq_1_0", fast=False):
    found = L.Cascade(kit(name), fast).run(seq)
    return {a.bc: (a.method, a.match, a.start, a.end, a.distance) for a in found if a.match}


def test_layout_facts():
    k = C.chemistry("custom_seq_1_0")
    assert [c.start for c in k.layout] == [0, 10, 32, 42, 64, 74, 82, None, None]
    assert k.drift()["BC1"] == 6 and k.drift()["TGIDX"] is None and C.chemistry("hydrop").drift()["BC1"] == 6
    assert k.anchor("UMI")[1] == 0 and k.anchor("POLYG")[1] == 8
    with pytest.raises(ValueError, match="no fixed length"):
        k.anchor("ME")
    assert k.layout.beside("BC1", -1, barcodes=True).name == "BC2" and k.layout.beside("ME", 1) is None
    with pytest.raises(ValueError, match="hydrop"):
        C.chemistry("nothing")
    with pytest.raises(KeyError):
        k.check()


@pytest.mark.parametrize("bad", [dict(name="x", kind=C.Kind.BARCODE), dict(name="x", kind=C.Kind.HOMOPOLYMER, base="G"), dict(name="x", kind=C.Kind.PRIMER, length=2, sequence="ACG")])
def test_bad_components(bad):
    with pytest.raises(ValueError):
        C.Component(**bad)


def test_close_pairs_against_all_pairs():
    rng = random.Random(5)
    entries = tuple({"".join(rng.choices("ACGT", k=5)) for _ in range(60)})
    want = sorted((a, b, C.distance(a, b)) for a in entries for b in entries if a < b and C.distance(a, b) <= 2)
    assert C.close_pairs(entries, 2) == want
    near = replace(kit(), whitelists={**kit().whitelists, "BC1": ("ACGTTGCAAC", "ACGTTGCAAT")})
    with pytest.raises(ValueError, match="1 edits apart"):
        near.check()
    assert replace(near, enforce=False).check()
    assert replace(near, exempt=frozenset({frozenset({"ACGTTGCAAC", "ACGTTGCAAT"})})).check() == []


def test_best_window_against_all_windows():
    rng = random.Random(7)
    for _ in range(200):
        seq = "".join(rng.choices("ACGTN", k=30))
        entry, at, budget = "".join(rng.choices("ACGT", k=8)), rng.randint(0, 22), rng.randint(0, 2)
        found = []
        for s in range(max(0, at - budget), min(len(seq) - 1, at + budget) + 1):
            for n in range(max(1, 8 - budget), 8 + budget + 1):
                if s + n <= len(seq) and (d := L.prefix_distances(seq[s : s + n], entry)[-1]) <= budget:
                    found.append(((0, 0, 0, s, n) if d == 0 else (d, abs(n - 8), abs(s - at), s, n), (s, s + n, d)))
        assert L.best_window(seq, entry, at, budget) == (min(found)[1] if found else None)


def test_local_alignment_against_plain_recursion():
    rng = random.Random(11)
    for _ in range(40):
        a, b = ("".join(rng.choices("ACGT", k=n)) for n in (rng.randint(3, 12), 6))
        m, x, y = (np.full((len(a) + 1, 7), -1e9) for _ in range(3))
        best = 0.0
        for i in range(1, len(a) + 1):
            for j in range(1, 7):
                s = 1 if a[i - 1] == b[j - 1] else -1
                m[i, j] = max(0, s + max(0, m[i - 1, j - 1], x[i - 1, j - 1], y[i - 1, j - 1]))
                x[i, j] = max(m[i - 1, j] - 0.5, y[i - 1, j] - 0.5, x[i - 1, j] - 1)
                y[i, j] = max(m[i, j - 1] - 0.5, x[i, j - 1] - 0.5, y[i, j - 1] - 1)
                best = max(best, m[i, j])
        score, start = L.local_starts(a, np.array([list(b.encode())], np.uint8))
        assert score[0] == best and 0 <= start[0] < len(a)


def test_exact_then_seeded():
    assert {v[0] for v in calls(read()).values()} == {L.EXACT}
    hurt = calls(read(a="A" + "GGTTGCAAC"))
    assert hurt["BC3"] == (L.KMER, ENTRIES[0], 0, 10, 1) and hurt["BC1"][0] == L.EXACT
    assert calls(read(a="NCGTTGCAAC"))["BC3"][4] == 0


def test_shifted_barcodes_follow():
    found = calls("T" + read())
    assert found["BC2"][1:4] == (ENTRIES[1], 33, 43) and found["BC1"][1:4] == (ENTRIES[2], 65, 75)


def test_two_errors_are_too_many_for_one():
    assert "BC3" not in calls(read(a="AAATTGCAAC")) and "BC3" in calls("AAATTGCAAC" + "AGGGTACTCG" + ENTRIES[1] + "GCAGTAGCTG" + ENTRIES[2] + "ACGTAC", "hydrop")


def test_alignment_needs_evidence_far_off():
    far = "GATTACAGATTACAGATTAC" + ENTRIES[0]
    attempts = [a for a in L.Cascade(kit()).run(read(a="C" * 10)[:40] + far) if a.bc == "BC3"]
    assert all(a.match is None for a in attempts) and [a.method for a in attempts] == [L.EXACT, L.KMER, L.ALIGN]
    assert [a.method for a in L.Cascade(kit(), fast=True).run("C" * 100) if a.bc == "BC3"] == [L.EXACT, L.KMER]


def test_short_reads_raise():
    with pytest.raises(ValueError, match="no seed"):
        L.Cascade(kit()).run("ACG")


def test_ties():
    close = replace(kit(), whitelists={**kit().whitelists, "BC3": ("ACGTTGCAAC", "ACGTTGCAAG")})
    spaced = [a for a in L.Cascade(close).run(read(a="ACGTTGCAAT")) if a.bc == "BC3"]
    assert [a.method for a in spaced].count(L.KMER) == 2 and all(a.match is None for a in spaced if a.method == L.KMER)
    bare = read(a="ACGTTGCAAT").replace("TGTGTATAAGGACCTCGTTGCC", "TGTGTATAAGGACCTCGTTGCA")
    assert [a.method for a in L.Cascade(close).run(bare) if a.bc == "BC3"] == [L.EXACT, L.KMER, L.ALIGN, L.ALIGN]


def test_wrong_calls_stay_rare():
    rng, wrong, called = random.Random(13), 0, 0
    cascade = L.Cascade(kit())
    for _ in range(60):
        want = [rng.choice(ENTRIES) for _ in range(3)]
        hurt = []
        for e in want:
            i, how = rng.randrange(10), rng.choice("sdi")
            hurt.append(e[:i] + {"s": rng.choice("ACGT") + e[i + 1 :], "d": e[i + 1 :], "i": rng.choice("ACGT") + e[i:]}[how])
        got = [a.match for a in cascade.run(read(*hurt)) if a.match]
        called += len(got) == 3
        wrong += len(got) == 3 and got != want
    assert wrong == 0 and called > 40


def test_targets_that_cannot_be_told():
    lists = kit().whitelists
    with pytest.raises(ValueError, match="bases of its anchor"):
        replace(kit(), whitelists={**lists, "TGIDX": ("GGGTACCA",)}).check()
    assert "5 targets" in replace(kit(), whitelists={**lists, "TGIDX": ("AACCAACC", "TTGGTTAA", "CATCATCA", "ACACGTGT", "TCTCAGAG")}).check()[0]


def test_matchers_plug_in(spark):
    class Anywhere(L.Matcher):
        method = "ANYWHERE"
        kinds = frozenset({C.Kind.BARCODE})

        def __init__(self, chemistry, component, budget):
            super().__init__(chemistry, component, budget)
            self.entries = chemistry.whitelist(component.name)

        def tried(self, read, floor=0):
            at = next(((e, read.find(e, floor)) for e in self.entries if e in read[floor:]), None)
            return [L.Attempt(self.component.name, self.method, at[0], at[0], at[1], at[1] + len(at[0]))] if at else [L.Attempt(self.component.name, self.method)]

    with pytest.raises(ValueError, match="taken"):
        L.register_matcher(type("Again", (L.Matcher,), {"method": L.EXACT}))
    with pytest.raises(ValueError, match="no such matcher"):
        L.Cascade(kit(), tiers=("NOWHERE",))
    with pytest.raises(ValueError, match="can't handle UMI"):
        Anywhere(kit(), kit().first(C.Kind.UMI), 1)
    with pytest.raises(TypeError):
        L.Matcher(kit(), kit().barcodes[0], 1).tried("ACGT")
    L.register_matcher(Anywhere)
    try:
        shifted = "TTTTTTTTTTTT" + read()
        found = [a for a in L.Cascade(kit(), tiers=("ANYWHERE",)).run(shifted) if a.match]
        assert {a.method for a in found} == {"ANYWHERE"} and found[0].start == 12
        rows = spark.createDataFrame([(0, "r", shifted, "I" * len(shifted)), (1, "s", read(), "I" * len(read()))], "ord long, name string, seq string, qual string")
        got = {r.ord: r.success for r in reads.extracted(rows, kit(), tiers=("ANYWHERE",)).collect()}
        assert got == {0: True, 1: True}
    finally:
        del L.MATCHERS["ANYWHERE"]
