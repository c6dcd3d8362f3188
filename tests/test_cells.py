"""Cells of similarity joins that are gone through in blocks."""

import random

import pytest
from helixframe.operators import editing, similarity
from pyspark.sql import functions as F


def proteins(seed, n, alphabet="ACDEF"):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.choice([18, 19, 20, 20, 3]))) for _ in range(n)]


@pytest.fixture
def sides(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SALT_ROWS", 9)
    monkeypatch.setattr(similarity, "QUERY_ROWS", 4)
    monkeypatch.setattr(similarity, "CELLS", 0.02)
    schema = "idx long, gene_name string, species string, protein string"
    q, p = proteins(1, 60), proteins(2, 130)
    q[:5] = p[:5]
    left = [(1000 + k, "ND1", "s", x) for k, x in enumerate(q)]
    right = [(k, "ND1", "s", x) for k, x in enumerate(p)]
    return spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), q, p, editing.distances(q, p)


def test_copies_of_rows_do_not_grow_with_the_other_side(sides):
    q, t, *_ = sides
    left = q.select(F.col("gene_name").alias("gene"), F.col("protein").alias("q_protein")).distinct()
    grid = similarity.Grid.of(left, similarity._few(t, 2))
    assert grid.pool.groupBy("t_idx").count().agg(F.max("count")).first()[0] <= 5  # a copy for four queries would make some 15


def test_blocks_of_a_cell_find_what_whole_tables_hold(sides):
    q, t, a, b, d = sides
    got = {}
    for r in similarity.top_neighbours(q, t, k=3).collect():
        got.setdefault(r.q_idx - 1000, []).append((r["rank"], r.edit_distance, r.t_idx))
    assert {k: sorted(v) for k, v in got.items()} == {i: [(n, *x) for n, x in enumerate(sorted((int(d[i, j]), j) for j in range(len(b)))[:3])] for i in range(len(a))}
    longer = lambda i, j: max(len(a[i]), len(b[j]))
    best = {r.q_idx - 1000: (r.t_idx, r.identity) for r in similarity.nearest_by_length_bound(q, t).collect()}
    for i in range(len(a)):
        want = min((d[i, j] / longer(i, j), j) for j in range(len(b)))
        assert best[i][0] == want[1] and best[i][1] == pytest.approx(1 - want[0])
    pairs = {(r.q_idx - 1000, r.t_idx) for r in similarity.threshold_pairs(q, t, 0.7).collect()}
    assert pairs == {(i, j) for i in range(len(a)) for j in range(len(b)) if d[i, j] <= int(len(a[i]) * (1.0 - 0.7))}
    votes = {}
    for r in similarity.kmer_candidates(q, t, top=4).collect():
        votes.setdefault(r.q_idx - 1000, []).append((r["rank"], r.votes, r.t_idx))
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    for i in range(len(a)):
        want = sorted((-len(grams(a[i]) & grams(b[j])), j) for j in range(len(b)) if grams(a[i]) & grams(b[j]))[:4]
        if want:
            assert sorted(votes[i]) == [(n, -v, j) for n, (v, j) in enumerate(want)]


@pytest.mark.parametrize("cap", [0.0, 0.1, 0.3, 0.45, 0.6])
def test_queries_without_an_unlike_row(sides, cap):
    q, t, a, b, d = sides
    long = t.where("length(protein) > 3")  # no row whose length alone decides
    kept = [j for j, x in enumerate(b) if len(x) > 3]
    for pool, columns in ((t, range(len(b))), (long, kept), (t.where("idx < 0"), [])):
        got = {r.idx - 1000 for r in similarity.unlike_none(q, pool, cap).collect()}
        assert got == {i for i in range(len(a)) if not any(1 - d[i, j] / max(len(a[i]), len(b[j])) <= cap for j in columns)}


def test_without_neighbours_looks_at_all_training_records(spark, sf):
    from __spark_entry__ import oracle_sql, queries

    assert "JOIN train t" in oracle_sql()["without_neighbours"]
    tests = queries()["records"](spark, sf).where("split = 'test'")
    assert {r.gene_name: r.of for r in queries()["without_neighbours"](spark, sf).collect()} == {r.gene_name: r["count"] for r in tests.groupBy("gene_name").count().collect()}
