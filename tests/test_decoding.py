"""Decoding with a running state, rounds of masks, and padded batches, against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from helixframe.functions import codons as C
from helixframe.operators import batching, decoding
from helixframe.operators.usage import CODONS

CODE = {c: C.TABLES[2][16 * i + 4 * j + k] for i, a in enumerate(C.BASES) for j, b in enumerate(C.BASES) for k, x in enumerate(C.BASES) for c in [a + b + x]}


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    p, first = rng.random((64, 64)) ** 3, rng.random(64)
    return p / p.sum(axis=1, keepdims=True), first / first.sum()


@pytest.fixture(scope="module")
def proteins():
    rng = random.Random(2)
    return ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=n)) for n in (0, 1, 2, 9, 30, 30, 31)] + ["MXW", "B", "é"]


def walk(protein, p, first, beta=0.0, target=0.44):
    before, gc, out = None, 0, []
    for i, a in enumerate([*protein, "*"]):
        options = sorted(c for c in CODONS if CODE[c] == a)
        if not options:
            before = None
            continue
        row = first if before is None else p[CODONS.index(before)]
        total = sum(row[CODONS.index(c)] for c in options)
        value = {c: math.log(row[CODONS.index(c)] / total) - beta * ((gc + sum(x in "GC" for x in c)) / (3 * (i + 1)) - target) ** 2 for c in options}
        before = max(options, key=lambda c: round(value[c], 12))
        gc += sum(x in "GC" for x in before)
        out.append(before)
    return "".join(out)


@pytest.mark.parametrize("beta", [0.0, 1.0, 500.0])
def test_same_as_a_walk(model, proteins, beta):
    got = decoding.decode(proteins, np.arange(len(proteins)), decoding.markov(*model), beta=beta, target_gc=0.6)
    assert got == [walk(p, *model, beta, 0.6) for p in proteins]


def test_guidance_moves_the_share(model, proteins):
    share = lambda s: sum(x in "GC" for x in s) / len(s)
    made = {t: decoding.decode(proteins[4:7], np.arange(3), decoding.markov(*model), beta=1000.0, target_gc=t) for t in (0.2, 0.7)}
    assert all(share(a) < share(b) for a, b in zip(made[0.2], made[0.7]))


def test_draws(model, proteins):
    ids = np.arange(len(proteins)) + 70
    scorer = decoding.markov(*model)
    one = decoding.decode(proteins, ids, scorer, "sample", seed=3)
    assert one == decoding.decode(proteins, ids, scorer, "sample", seed=3) != decoding.decode(proteins, ids, scorer, "sample", seed=4)
    assert one[::-1] == decoding.decode(proteins[::-1], ids[::-1], scorer, "sample", seed=3)
    assert decoding.decode(proteins, ids, scorer, "sample", temperature=1e-6) == decoding.decode(proteins, ids, scorer)
    many = decoding.decode(["L"] * 4000, np.arange(4000), scorer, "sample")
    options = [c for c in CODONS if CODE[c] == "L"]
    total = sum(model[1][CODONS.index(c)] for c in options)
    for c in options:
        assert sum(s[:3] == c for s in many) / 4000 == pytest.approx(model[1][CODONS.index(c)] / total, abs=0.03)
    with pytest.raises(ValueError, match="strategy"):
        decoding.decode(["A"], np.arange(1), scorer, "beam")


def test_rounds_of_masks(model, proteins):
    p, first = model
    trace = []
    got = decoding.mask_predict(proteins, decoding.neighbours(p, first), rounds=4, trace=trace)
    for r, protein in enumerate(proteins):
        good = [i for i, a in enumerate(protein) if any(CODE[c] == a for c in CODONS)]
        now, certain = dict.fromkeys(good, None), dict.fromkeys(good, 1.0)
        for t in range(4):
            found = {}
            for i in good:
                if now[i] is None:
                    value = {}
                    for c in sorted(c for c in CODONS if CODE[c] == protein[i]):
                        k = CODONS.index(c)
                        left, right = now.get(i - 1), now.get(i + 1)
                        value[c] = first[k] * (p[CODONS.index(left)][k] if left else 1) * (p[k][CODONS.index(right)] if right else 1)
                    best = max(value, key=lambda c: value[c])
                    found[i] = (best, value[best] / sum(value.values()))
            for i, (c, x) in found.items():
                now[i], certain[i] = c, x
            n = len(good) * (3 - t) // 4
            if t < 3 and t < len(trace):
                masked = sorted(sorted(good, key=lambda i: (round(certain[i], 12), i))[:n])
                assert np.flatnonzero(trace[t][r]).tolist() == masked
                now |= dict.fromkeys(masked)
        assert got[r] == "".join(now[i] for i in good)


def test_ties_and_specials_of_masks():
    scores = np.array([[0.5, 0.1, 0.5, 0.1, 0.9], [0.0, 0.0, 0.0, 0.0, 0.0]])
    maskable = np.array([[True, True, True, True, False], [False, True, True, False, True]])
    assert decoding.least_certain(scores, maskable, np.array([3, 9])).tolist() == [[True, True, False, True, False], [False, True, True, False, True]]
    assert not decoding.least_certain(scores, maskable, np.array([0, 0])).any()


def test_frames(spark, model, proteins):
    rows = [(i, p) for i, p in enumerate(proteins)] + [(99, None)]
    frame = spark.createDataFrame(rows, "idx long, protein string").repartition(3)
    got = {r.idx: r.generated for r in decoding.with_decoded(frame, decoding.markov(*model), batch=3, beta=2.0).collect()}
    assert got == {i: walk(p, *model, 2.0) for i, p in enumerate(proteins)} | {99: None}
    got = {r.idx: r.generated for r in decoding.with_refined(frame, decoding.neighbours(*model), batch=3).collect()}
    assert got == {i: s + "TAA" for i, s in enumerate(decoding.mask_predict(proteins, decoding.neighbours(*model)))} | {99: None}


def test_training_masks(spark, proteins):
    got = {r.idx: r.masked for r in decoding.training_masks(spark.createDataFrame(list(enumerate(proteins)), "idx long, protein string"), seed=5).collect()}
    h = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    for i, p in enumerate(proteins):
        if p:
            n = max(1, math.ceil((int(h(5, i, "ratio")[:8], 16) + 1) / 2**32 * len(p)))
            assert got.pop(i) == sorted(sorted(range(len(p)), key=lambda k: (h(5, i, k), k))[:n])
    assert not got


@pytest.mark.parametrize("budget", [1, 40, 1000, 5000])
def test_batches_are_those_of_a_walk(spark, budget):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 1, 3, 17, 39, 40, 41, 200, rng.randint(1, 300)])) for i in range(700)]
    batch, held, want, cost = 0, 0, {}, {}
    for i, n in sorted(rows, key=lambda r: (r[1], r[0])):
        if held and (held + 1) * max(n, 1) > budget:
            batch, held = batch + 1, 0
        held += 1
        want[i] = batch
        cost.setdefault(batch, []).append(n)
    frame = spark.createDataFrame([*rows, (9999, None)], "idx long, n int").repartition(5)
    got = {r.idx: r.batch for r in batching.padded_batches(frame, "n", budget, ["idx"]).collect()}
    assert got == want
    assert all(len(v) * max(v) <= budget or len(v) == 1 for v in cost.values())


def test_scores_by_neighbours_are_looked_up():
    rng = np.random.default_rng(3)
    p, first = rng.random((64, 64)) ** 4 + 1e-6, rng.random(64)
    proteins = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWYX*"), k)) for k in (0, 1, 40, 77, 12)]
    ids = np.arange(5)
    chain, around = decoding.markov(p, first), decoding.neighbours(p, first)
    # The same scorers without their tables.
    slow = {f: (lambda *a, f=f: f(*a)) for f in (chain, around)}
    assert hasattr(chain, "values") and hasattr(around, "best")
    for choice in ({}, {"beta": 200.0, "target_gc": 0.4}):
        assert decoding.decode(proteins, ids, chain, **choice) == decoding.decode(proteins, ids, slow[chain], **choice)
    assert decoding.mask_predict(proteins, around) == decoding.mask_predict(proteins, slow[around])
