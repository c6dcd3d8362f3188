"""The coding-sequence operators on small fixtures, against brute force."""

import math
import random
import re

import numpy as np
import pytest
from helixframe.functions import codons as C
from helixframe.operators import clustering, editing, generation, graph, ranking, similarity, statistics, usage
from pyspark.sql import functions as F

ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def proteins(n, seed, genes=("ND1", "COX1")):
    """Families of proteins with edits, equal ones and an empty one among them."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = "".join(rng.choices(ACIDS, k=rng.randint(5, 30)))
        for _ in range(rng.randint(1, 6)):
            p = list(base)
            for _ in range(rng.randint(0, len(p) // 3)):
                p[rng.randrange(len(p))] = rng.choice(ACIDS)
            out.append("".join(p[: rng.randint(max(1, len(p) - 4), len(p))]))
    out[3] = ""
    return [(i, rng.choice(genes), f"s{rng.randint(0, 5)}", p) for i, p in enumerate(out[:n])]


SCHEMA = "idx long, gene_name string, species string, protein string"


@pytest.fixture(scope="module")
def both(spark):
    rows = proteins(90, 4)
    queries, pool = rows[:30], rows[20:]  # ten queries are in the pool
    return queries, pool, spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(pool, SCHEMA)


def ranked(query, pool, cap=None):
    out = []
    for t in pool:
        if t[1] == query[1] and t[0] != query[0]:
            d = distance(query[3], t[3])
            ident = 1 - d / max(len(query[3]), len(t[3]), 1)
            if cap is None or ident <= cap:
                out.append((d, t[0], ident))
    return sorted(out)


@pytest.mark.parametrize("cap", [None, 0.5])
def test_top_neighbours(both, cap, monkeypatch):
    monkeypatch.setattr(similarity, "SALT_ROWS", 5)
    monkeypatch.setattr(similarity, "QUERY_ROWS", 4)
    queries, pool, q, p = both
    got = {(r.q_idx, r.rank): (r.edit_distance, r.t_idx) for r in similarity.top_neighbours(q, p, k=3, max_identity=cap).collect()}
    assert got == {(x[0], k): y[:2] for x in queries for k, y in enumerate(ranked(x, pool, cap)[:3])}


def test_max_and_nearest_identity(both, monkeypatch):
    monkeypatch.setattr(similarity, "SALT_ROWS", 5)
    monkeypatch.setattr(similarity, "QUERY_ROWS", 4)
    queries, pool, q, p = both
    want = {x[0]: min(((-i, t) for _, t, i in ranked(x, pool)), default=(0.0, None)) for x in queries}
    assert {r.idx: r.max_identity for r in similarity.max_identity(q, p).collect()} == pytest.approx({k: -m for k, (m, _) in want.items()})
    assert {r.q_idx: r.t_idx for r in similarity.nearest_by_length_bound(q, p).collect()} == {k: t for k, (_, t) in want.items() if t is not None}


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_threshold_pairs(both, threshold):
    queries, pool, q, p = both
    got = {(r.q_idx, r.t_idx) for r in similarity.threshold_pairs(q, p, threshold).collect()}
    assert got == {(x[0], t[0]) for x in queries for t in pool if x[1] == t[1] and x[0] != t[0] and distance(x[3], t[3]) <= int(len(x[3]) * (1.0 - threshold))}


def mixed_lengths(n, seed):
    """Families of proteins from 20 to 900 residues, in each of which some are near one another."""
    rng, out = random.Random(seed), []
    while len(out) < n:
        base = "".join(rng.choices(ACIDS, k=int(20 * 45 ** rng.random())))
        for _ in range(6):
            p = list(base)
            for _ in range(rng.randint(1, max(1, len(p) // 8))):
                p[rng.randrange(len(p))] = rng.choice(ACIDS)
            out.append((len(out), "ND1", "s", "".join(p)))
    rng.shuffle(out)
    return out


def test_few_pairs_are_compared(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SALT_ROWS", 60)
    monkeypatch.setattr(similarity, "QUERY_ROWS", 30)
    rows = mixed_lengths(360, 9)
    queries, pool = rows[:60], rows[60:]
    q, p = spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(pool, SCHEMA)
    every = editing.distances([x[3] for x in queries], [x[3] for x in pool])
    size = np.maximum(np.array([len(x[3]) for x in queries])[:, None], np.array([len(x[3]) for x in pool])[None, :])
    want = {x[0]: max((round(1 - d / s, 12), -t[0]) for t, d, s in zip(pool, every[i], size[i])) for i, x in enumerate(queries)}
    assert {r.q_idx: (round(r.identity, 12), -r.t_idx) for r in similarity.nearest_by_length_bound(q, p).collect()} == want
    assert 0 < similarity.pairs_compared(q, p) < every.size / 10
    found = similarity.threshold_grid(q, p, 0.7).collect()
    bound = [int(len(x[3]) * (1.0 - 0.7)) for x in queries]
    assert {(r.q_idx, r.t_idx, r.edit_distance) for r in found if r.compared is None} == {(x[0], t[0], every[i, j]) for i, x in enumerate(queries) for j, t in enumerate(pool) if every[i, j] <= bound[i]}
    window = sum(abs(len(x[3]) - len(t[3])) <= b for x, b in zip(queries, bound) for t in pool)
    assert sum(r.compared or 0 for r in found) < window / 3


@pytest.mark.parametrize("relative", [False, True])
def test_blocks_and_their_bounds(relative):
    rows = [r[3] for r in mixed_lengths(150, 3)] + ["", "A", "AC"]
    queries, pool = rows[:50], rows[40:]
    full = editing.distances(queries, pool)
    assert (editing.least_distances(queries, pool) <= full).all()
    i, j = np.nonzero(np.ones(full.shape))
    for bound in (0, 7, 1 << 40):
        d = editing.pair_distances(queries, pool, i, j, np.full(len(i), bound)).reshape(full.shape)
        assert np.where(full <= bound, d == full, d > bound).all()
    size = np.maximum(np.maximum(np.array([len(x) for x in queries])[:, None], np.array([len(x) for x in pool])[None, :]), 1)
    cost = np.where(full > 0, full / size if relative else full, np.inf)
    for k in (1, 3):
        kth = np.sort(cost, axis=1)[:, k - 1]
        out, compared = editing.nearest(queries, pool, k, kth, relative, lambda d, i, j: d > 0)
        needed = np.isfinite(cost) & (cost <= kth[:, None])
        assert (out[needed] == full[needed]).all() and compared < full.size / 3


@pytest.mark.parametrize("top", [1, 8])
def test_kmer_candidates_of_common_kmers(spark, monkeypatch, top):
    monkeypatch.setattr(similarity, "SALT_ROWS", 7)
    monkeypatch.setattr(similarity, "QUERY_ROWS", 5)
    rows = [(i, g, s, p + "AAAA" * (i % 3) + "CCC") for i, g, s, p in proteins(80, 6)]  # k-mers that stand in all
    queries, pool = rows[:25], rows[15:]
    grams = lambda p: {p[i : i + 3] for i in range(len(p) - 2)}
    want = {}
    for x in queries:
        votes = sorted((-len(grams(x[3]) & grams(t[3])), t[0]) for t in pool if t[1] == x[1] and t[0] != x[0])
        want |= {(x[0], k): (t, -v) for k, (v, t) in enumerate(v for v in votes[:top] if v[0] < 0)}
    got = {(r.q_idx, r.rank): (r.t_idx, r.votes) for r in similarity.kmer_candidates(spark.createDataFrame(queries, SCHEMA), spark.createDataFrame(pool, SCHEMA), top=top).collect()}
    assert got == want


def test_exact_signed_rank(spark):
    rng = random.Random(3)
    for n in range(1, 13):
        sums = [sum(r for r in range(1, n + 1) if bits >> (r - 1) & 1) for bits in range(1 << n)]
        assert statistics.subset_counts(n).tolist() == [sums.count(s) for s in range(n * (n + 1) // 2 + 1)]
    groups = {f"g{n}": [rng.choice([-1, 1]) * (k + 0.5) for k in range(n)] for n in (1, 2, 5, 12, 50, 51)} | {"tied": [1.0, 1.0, -2.0], "zero": [0.0, 1.0, 2.0], "same": [0.0, 0.0]}
    rows = [(g, i, d) for g, v in groups.items() for i, d in enumerate(v)]
    frame = spark.createDataFrame(rows, "g string, idx long, d double")
    got = {r.g: r for r in statistics.signed_rank_p(statistics.signed_rank(frame, ["g"])).collect()}
    for g, values in groups.items():
        assert got[g].exact == (g in ("g1", "g2", "g5", "g12", "g50"))
        if g in ("g1", "g2", "g5", "g12"):
            n = len(values)
            all_ = [sum(r for r in range(1, n + 1) if bits >> (r - 1) & 1) for bits in range(1 << n)]
            assert got[g].p == pytest.approx(min(1.0, 2 * sum(s <= got[g].statistic for s in all_) / 2**n))
    normal = math.erfc(abs(got["g51"].z) / math.sqrt(2))
    assert got["g51"].p == pytest.approx(normal) and got["same"].p == 1.0
    assert got["g50"].p == pytest.approx(math.erfc(abs(got["g50"].z) / math.sqrt(2)), rel=0.05)


def test_kmer_candidates_fall_back_to_the_first_of_the_gene(spark):
    pool = spark.createDataFrame([(i, "ND1", "s", "ACDEF"[: 3 + i % 3]) for i in range(12)], SCHEMA)
    queries = spark.createDataFrame([(100, "ND1", "s", "WWWWW"), (101, "ND1", "s", "CDE"), (102, "COX1", "s", "ACD")], SCHEMA)
    got = {}
    for r in similarity.kmer_candidates(queries, pool).collect():
        got.setdefault(r.q_idx, {})[r.rank] = (r.t_idx, r.votes)
    assert got[100] == {k: (k, 0) for k in range(8)}
    assert got[101] == {k: (t, 1) for k, t in enumerate(i for i in range(12) if i % 3)} and 102 not in got


def greedy(rows, threshold):
    out = {}
    for gene in {r[1] for r in rows}:
        reps = []
        for i, _, _, p in sorted((r for r in rows if r[1] == gene), key=lambda r: (-len(r[3]), r[0])):
            hit = next((c for c, r in enumerate(reps) if distance(p, r) <= int(len(p) * (1.0 - threshold))), None)
            if hit is None:
                hit = len(reps)
                reps.append(p)
            out[i] = hit
    return out


@pytest.mark.parametrize("first", [8, 1024])
def test_clusters_are_greedy_longest_first(spark, monkeypatch, first):
    monkeypatch.setattr(clustering, "FIRST_ROUND", first)
    rows = proteins(80, 9)
    got = clustering.cluster(spark.createDataFrame(rows, SCHEMA), 0.7).collect()
    assert {r.idx: r.cluster for r in got} == greedy(rows, 0.7)


def assigned(groups, fractions):
    """Split of each group (place, size): largest first, to the split that lacks most."""
    total, have, out = sum(n for _, n in groups), dict.fromkeys(fractions, 0), {}
    for place, n in sorted(groups, key=lambda g: (-g[1], g[0])):
        lack = {k: fractions[k] * total - have[k] for k in fractions}
        pick = max(lack, key=lack.get)
        have[pick] += n
        out[place] = pick
    return out


@pytest.mark.parametrize("seed", range(3))
def test_groups_go_to_the_split_that_lacks_most(spark, seed):
    rng = random.Random(seed)
    groups = {s: [(g, rng.choice([1, 1, 1, 2, 3, 3, 7, 20])) for g in range(rng.choice([1, 3, 150]))] for s in ("a", "b")}
    members = [(s, g, g * 1000 + i, g) for s, x in groups.items() for g, n in x for i in range(n)]
    got = clustering.assign_groups(spark.createDataFrame(members, "scope string, grp int, idx long, place int")).collect()
    assert {(r.scope, r.grp): r.split for r in got} == {(s, g): v for s, x in groups.items() for g, v in assigned(x, clustering.FRACTIONS).items()}


def test_component_and_gene_splits(spark):
    rows = proteins(60, 12)
    df = clustering.cluster(spark.createDataFrame(rows, SCHEMA), 0.7)
    label = greedy(rows, 0.7)
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for i, g, s, _ in rows:
        root[top((g, label[i]))] = top(s)
    comps = {}
    for i, g, *_ in rows:
        comps.setdefault(top((g, label[i])), []).append(i)
    want = assigned([(min(v), len(v)) for v in comps.values()], clustering.FRACTIONS)
    assert {r.idx: r.split for r in clustering.component_split(df).collect()} == {i: want[min(v)] for v in comps.values() for i in v}
    parts = {r.idx: r.new_split for r in clustering.gene_split(df).collect()}
    for gene in {r[1] for r in rows}:
        mine = [r[0] for r in rows if r[1] == gene]
        sizes = {c: sum(label[i] == c for i in mine) for c in {label[i] for i in mine}}
        want = assigned(list(sizes.items()), clustering.FRACTIONS)
        assert {i: parts[i] for i in mine} == {i: want[label[i]] for i in mine}
    kept = {r.idx for r in clustering.enforce(clustering.gene_split(df), 0.7).collect()}
    train = [r for r in rows if parts[r[0]] == "train"]
    assert kept == {r[0] for r in rows if parts[r[0]] == "train" or max((x[2] for x in ranked(r, train)), default=0) <= 0.7}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 205), (205, 201)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 200, 201: 200, 205: 200}


def test_ranks_and_quantiles(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, 1.0, 2.0, 2.5, rng.random()])) for i, g in enumerate("ab" * 40)]
    df = spark.createDataFrame(rows, "g string, idx long, v double")
    present = {g: [(v, i) for h, i, v in rows if h == g and v is not None] for g in "ab"}
    ranks = {r.idx: r.r for r in ranking.tied_ranks(df.where("v is not null"), ["g"], "v", "r").collect()}
    for values in present.values():
        for v, i in values:
            assert ranks[i] == sum(w < v for w, _ in values) + (sum(w == v for w, _ in values) + 1) / 2
    places = {r.idx: r.position for r in ranking.positions(df.where("v is not null"), ["g"], ["v", "idx"]).collect()}
    assert places == {i: k for values in present.values() for k, (_, i) in enumerate(sorted(values))}
    for r in statistics.spread(df, ["g"], "v").collect():
        x = [v for v, _ in present[r.g]]
        assert (r.n, r.mean, r.median, r.p10, r.p90, r.p95) == pytest.approx((len(x), np.mean(x), *np.quantile(x, [0.5, 0.1, 0.9, 0.95])))


def test_signed_rank_and_correction(spark):
    d = [0.0, 1.0, -1.0, 2.0, 2.0, -3.0, 4.0, 0.5]
    out = statistics.signed_rank(spark.createDataFrame([("m", i, x) for i, x in enumerate(d)] + [("same", 1, 0.0)], "method string, idx long, d double"), ["method"])
    got = {r.method: r for r in out.collect()}
    assert (got["m"].n, got["m"].statistic, got["same"].statistic, got["same"].identical) == (7, 8.5, 0.0, True)
    tests = spark.createDataFrame([("a", 0.001), ("b", 0.02), ("c", 0.03), ("d", 0.9)], "method string, p double")
    q = {r.method: (round(r.q, 9), r.reject, r.bonferroni) for r in statistics.adjusted(tests).collect()}
    assert q == {"a": (0.004, True, True), "b": (0.04, True, False), "c": (0.04, True, False), "d": (0.9, False, False)}


def test_tails(spark):
    rows = spark.createDataFrame([(3.84, 1.0), (124.3, 100.0), (0.0, 5.0), (18.3, 10.0)], "x double, k double")
    got = [r.p for r in rows.select(statistics.chi2_sf("x", "k").alias("p")).collect()]
    assert got == pytest.approx([0.05004, 0.05027, 1.0, 0.05009], abs=1e-4)
    z = spark.createDataFrame([(1.959964,), (None,)], "z double").select(statistics.normal_two_sided("z").alias("p")).collect()
    assert [r.p for r in z] == pytest.approx([0.05, 1.0], abs=1e-6)


def test_transition_fit_against_numpy(spark):
    rng = random.Random(8)
    words = usage.CODONS[:6]
    seqs = {s: ["".join(rng.choices(words, k=rng.randint(2, 9))) for _ in range(n)] for s, n in (("a", 30), ("b", 12))}
    counts = {}
    for s, rows in seqs.items():
        m = np.zeros((64, 64))
        for x in rows:
            c = [usage.CODONS.index(x[i : i + 3]) for i in range(0, len(x), 3)]
            np.add.at(m, (c[:-1], c[1:]), 1)
        counts[s] = m
    p = (counts["a"] + 1e-3) / (counts["a"] + 1e-3).sum(axis=1, keepdims=True)
    chi2 = dof = n = 0
    for i in range(64):
        o = counts["b"][i]
        if o.sum() >= 5 and ((e := p[i] * o.sum()) > 1e-6).sum() >= 2:
            k = e > 1e-6
            chi2, dof, n = chi2 + ((o[k] - e[k]) ** 2 / e[k]).sum(), dof + k.sum() - 1, n + o.sum()
    frames = [usage.transition_counts(spark.createDataFrame([(x,) for x in seqs[s]], "sequence string")) for s in "ab"]
    got = usage.transition_chi2(*frames, spark).first()
    assert (got.chi2, got.dof, got.n, got.cohens_w) == pytest.approx((chi2, dof, n, math.sqrt(chi2 / n)))
    assert got.n > 0


def test_lookups_have_all_residues(spark):
    train = spark.createDataFrame([(1, "COX1", "ATGAAA", "MK"), (2, "ND1", "ATGAAG", "MK")], "idx long, gene_name string, sequence string, protein string")
    tables = {"high": usage.lookup_table(train, spark, C.HIGH_EXPRESSION), "remap": usage.standard_remap(train, spark)}
    for t in tables.values():
        found = {r.aa: r.codon for r in t.collect()}
        assert sorted(found) == sorted(ACIDS) and found["W"] == "TGA" and found["M"] == "ATG"
    test = spark.createDataFrame([(9, "MWK", "ATGTGATAA")], "idx long, protein string, sequence string")
    made = {r.method: r.generated for r in generation.generate_all(test, train, spark).collect()}
    assert made["mt_cai_lookup"] == "ATGTGAAAATAA" and not any("UNK" in x for x in made.values())
    assert {r.aa: r.codon for r in usage.copy_fallback(train).where("gene_name = 'ND1'").collect()} == {"M": "ATG", "K": "AAG"}


def brute_affine(a, b):
    """Score of the best global alignment, by the three-state recursion cell by cell."""
    far = -1e9
    m, x, y = ({(i, j): far for i in range(len(a) + 1) for j in range(len(b) + 1)} for _ in range(3))
    m[0, 0] = 0.0
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i and j:
                m[i, j] = max(m[i - 1, j - 1], x[i - 1, j - 1], y[i - 1, j - 1]) + (2 if a[i - 1] == b[j - 1] else -1)
            if i:
                x[i, j] = max(max(m[i - 1, j], y[i - 1, j]) - 4, x[i - 1, j] - 0.5)
            if j:
                y[i, j] = max(max(m[i, j - 1], x[i, j - 1]) - 4, y[i, j - 1] - 0.5)
    return max(m[len(a), len(b)], x[len(a), len(b)], y[len(a), len(b)])


def align_map(query: str, target: str) -> tuple[int, list[int], int]:
    """(identical residues, target position of each query residue or -1, edit distance) of a global alignment.

    Unit costs; matches and substitutions are preferred over gaps, then gaps in the target.
    """
    n, m = len(query), len(target)
    q, t = np.frombuffer(query.encode("utf-32-le"), np.uint32), np.frombuffer(target.encode("utf-32-le"), np.uint32)
    d = np.zeros((n + 1, m + 1), dtype=np.int32)
    d[0] = np.arange(m + 1)
    ramp = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.empty(m + 1, dtype=np.int32)
        row[0] = i
        row[1:] = np.minimum(d[i - 1, :-1] + (t != q[i - 1]), d[i - 1, 1:] + 1)
        d[i] = np.minimum.accumulate(row - ramp) + ramp
    i, j, same, places = n, m, 0, [-1] * n
    while i > 0:
        if j > 0 and d[i, j] == d[i - 1, j - 1] + (q[i - 1] != t[j - 1]):
            i, j = i - 1, j - 1
            places[i] = j
            same += q[i] == t[j]
        elif d[i, j] == d[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return int(same), places, int(d[n, m])


def test_alignments():
    rng = random.Random(6)
    for _ in range(150):
        a, b = ("".join(rng.choices("ACD", k=rng.randint(0, 9))) for _ in range(2))
        same, places, d = align_map(a, b)
        hit = [(i, j) for i, j in enumerate(places) if j >= 0]
        assert d == distance(a, b) == sum(a[i] != b[j] for i, j in hit) + len(a) + len(b) - 2 * len(hit)
        assert same == sum(a[i] == b[j] for i, j in hit) and [j for _, j in hit] == sorted({j for _, j in hit})
        same, places, score = generation.affine_map(a, b)
        hit = [(i, j) for i, j in enumerate(places) if j >= 0]
        assert score == pytest.approx(brute_affine(a, b)) and same == sum(a[i] == b[j] for i, j in hit)
        assert [j for _, j in hit] == sorted({j for _, j in hit})


def test_alignments_of_many_pairs_at_once(spark, monkeypatch):
    monkeypatch.setattr(editing, "KEPT", 1 << 18)  # several blocks
    rng = random.Random(11)
    rows = []
    for i in range(300):
        a = "".join(rng.choices(ACIDS[:5], k=rng.choice([0, 1, 3, 20, 63, 64, 65, 130])))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 3 + 1)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 2)] = rng.choices(ACIDS[:5], k=rng.randint(0, 2))
        rows.append((i, a, "".join(b) if i % 5 else "".join(rng.choices(ACIDS[:5], k=rng.randint(0, 90)))))
    frame = spark.createDataFrame(rows, "i int, q_protein string, t_protein string")
    got = {r.i: r for r in generation.with_alignment(frame).collect()}
    text = {r.i: r for r in generation.with_runs(frame).withColumn("line", generation.run_length(F.col("runs"))).collect()}
    for i, a, b in rows:
        same, places, d = align_map(a, b)
        assert (got[i].n_identical, got[i].pos_map, got[i].align_distance) == (same, places, d) and d == distance(a, b)
        runs = [(int(n), k) for n, k in re.findall(r"(\d+)([=XID])", text[i].line)]
        assert sum(n for n, k in runs if k != "D") == len(a) and sum(n for n, k in runs if k != "I") == len(b)
        assert sum(n for n, k in runs if k != "=") == d and all(x[1] != y[1] for x, y in zip(runs, runs[1:]))


def test_copies(spark):
    rows = spark.createDataFrame([
        (1, 10, "ND1", "MKW", "ATGAAATGATAG", "MKL", "ATGAAGTTATAA"),  # equal residues are copied, then the gene's, then its own codon; the neighbour's stop
        (2, 11, "ND1", "MK", "ATGAAA", "MK", "ATGAAG"),  # no stop
        (3, 12, "ND1", "MK", "ATGAAATAA", "MK", "ATGAAG"),  # the neighbour has no stop
    ], "q_idx int, t_idx int, gene string, q_protein string, q_sequence string, t_protein string, t_sequence string")
    fallback = spark.createDataFrame([("ND1", "L", "CTA")], "gene_name string, aa string, codon string")
    assert {r.q_idx: r.copied_sequence for r in generation.homolog_copy(rows, fallback).collect()} == {1: "ATGAAGTGATAA", 2: "ATGAAG", 3: "ATGAAGTAA"}
    ranked_ = rows.withColumn("rank", F.lit(0)).unionByName(rows.where("q_idx = 1").withColumns({"t_idx": F.lit(99), "t_protein": F.lit("MKW"), "rank": F.lit(1)}))
    best = generation.copied(generation.best_aligned(ranked_), fallback, spark).collect()
    assert {r.q_idx: (r.t_idx, r.copied_fraction) for r in best} == {1: (99, 1.0), 2: (11, 1.0), 3: (12, 1.0)}


def test_copies_spell_unknown_residues_by_their_first_synonym(spark):
    rows = spark.createDataFrame([(1, 10, "ND1", "MLK", "ATGTTGAAGTAA", "MW", "ATGTGATAG", [0, -1, -1])], "q_idx int, t_idx int, gene string, q_protein string, q_sequence string, t_protein string, t_sequence string, pos_map array<int>")
    fallback = spark.createDataFrame([("ND1", "K", "AAG")], "gene_name string, aa string, codon string")
    (made,) = generation.copied(rows, fallback, spark).collect()
    assert made.copied_sequence == "ATGCTAAAGTAG" and made.copied_fraction == pytest.approx(1 / 3) and not [c for c in made.asDict() if c.startswith("__")]


def test_variants_keep_protein_start_and_stop(spark):
    records = spark.createDataFrame([(i, f"r{i}", "COX1", "s", "ATGAAACTTTGATAA", "MKLW*") for i in range(20)], "idx long, id string, gene_name string, species string, sequence string, protein_sequence string")
    weights = usage.rscu_weights(records, spark)
    rows = generation.augment(records, weights).collect()
    made = [r for r in rows if r.idx >= 20]
    assert len(rows) == 60 and {r.idx for r in rows} == set(range(60)) and all(r.is_augmented and r.sequence[:3] == "ATG" and r.sequence[-3:] == "TAA" for r in made)
    table = {r.codon: r.aa for r in usage.genetic_code(spark).collect()}
    assert all("".join(table[r.sequence[i : i + 3]] for i in range(0, 15, 3)) == "MKLW*" for r in made)


def test_decoding_takes_allowed_codons_and_keeps_failures(spark):
    def scorer(batch):
        if "X" in batch[0]:
            raise ValueError("no")
        return [np.tile(np.arange(64.0), (len(p), 1)) for p in batch]

    rows = generation.decode_with(spark.createDataFrame([(1, "MW"), (2, "XX")], "idx long, protein string"), scorer, batch=1).collect()
    assert {r.idx: (r.generated, r.error) for r in rows} == {1: ("ATGTGGTAA", None), 2: (None, "ValueError: no")}


def test_small_functions(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    lit = F.lit
    assert one(C.normalised_protein(lit(" mkw** "))) == "MKW"
    assert one(C.input_error(lit("MKB1"))) == "invalid residues: 1,B" and one(C.input_error(lit(""))) == "empty protein" and one(C.input_error(lit("MKW"))) is None
    assert one(C.input_error(lit("M" * 701))) == "longer than 700"
    assert [one(C.condition(lit("ND6"), m)) for m in ("none", "strand", "gene")] == [0, 1, 11] and one(C.gene_index(lit("?"))) == 0
    assert one(C.exact_under(C.chunked(lit("ATGTGATAA")), lit("MW"))) is True and one(C.exact_under(C.chunked(lit("ATGTGATAA")), lit("MW"), 1)) is False
    assert one(C.padded(F.array(lit(1), lit(2)), 4)) == [1, 2, 0, 0] and one(C.padded(F.array(lit(1), lit(2)), 1)) == [1]
    assert one(C.merged_map(F.create_map(lit("a"), lit(1), lit("b"), lit(2)), F.create_map(lit("b"), lit(3)))) == {"a": 1, "b": 3}
    assert one(C.without_field(F.array(F.struct(lit(1).alias("a"), lit(2).alias("b"))), "b"))[0].asDict() == {"a": 1}
    assert one(C.measured(lit("ACG"), lit(None).cast("string"), lambda r, s: F.length(r))) is None
    assert one(C.categories(F.array(lit("Random search"), lit("IDT tool"), lit("Wild-type")), lit(True))) == ["algo", "commercial", "wt", "homology"]
    assert one(C.to_rna(lit("atg"))) == "AUG" and one(statistics.clean(lit(float("nan")))) is None


def test_bleu_and_diversity_against_counts(spark):
    rng = random.Random(2)
    rows = [("".join(rng.choices(["AAA", "CCC", "GGG", "TT"], k=rng.randint(0, 12))), "".join(rng.choices(["AAA", "CCC", "GGG"], k=rng.randint(0, 12)))) for _ in range(40)]

    def cut(s):
        return [s[i : i + 3] for i in range(0, len(s), 3)]

    def bleu(r, h):
        r, h, logs = cut(r), cut(h), []
        if not r or not h:
            return 0.0
        for n in range(1, 5):
            a, b = ([tuple(x[i : i + n]) for i in range(len(x) - n + 1)] for x in (r, h))
            hit = sum(min(a.count(g), b.count(g)) for g in set(b))
            logs.append(math.log(max(hit / max(len(b), 1), 1e-8)))
        return (1.0 if len(h) >= len(r) else math.exp(1 - len(r) / len(h))) * math.exp(sum(logs) / 4)

    df = spark.createDataFrame(rows, "r string, h string")
    got = df.select("r", "h", C.bleu(C.chunked(F.col("r"), partial=True), C.chunked(F.col("h"), partial=True)).alias("b"), C.diversity(C.chunked(F.col("r"), partial=True)).alias("d")).collect()
    for x in got:
        n = len(cut(x.r))
        assert x.b == pytest.approx(bleu(x.r, x.h), rel=1e-9)
        assert x.d == pytest.approx(-sum(k / n * math.log2(k / n) for k in (cut(x.r).count(c) for c in set(cut(x.r)))) if n else 0.0)


