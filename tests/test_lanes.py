"""Comparisons of one string with many at once, against plain distances."""

import random

import numpy as np
import pytest
from helixframe.operators import editing, lanes, similarity
from test_cells import sides  # noqa: F401
from test_cells import test_blocks_of_a_cell_find_what_whole_tables_hold as blocks_hold


def pool(rng, alphabet, longest, n):
    return ["".join(rng.choices(alphabet, k=rng.choice([longest, longest, rng.randint(0, longest)]))) for _ in range(n)]


def edited(rng, text, alphabet, most):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        at = rng.randint(0, len(out))
        out[at : at + rng.randint(0, 2)] = rng.choices(alphabet, k=rng.randint(0, 2))
    return "".join(out)


def cases(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        alphabet, longest = "ACDEFGé"[: rng.choice([2, 5, 7])], rng.choice([3, 20, 70])
        strings = pool(rng, alphabet, longest, rng.choice([1, 30, 150]))
        queries = [*pool(rng, alphabet + "Z", longest + 5, 4), "", strings[0], *[edited(rng, rng.choice(strings), alphabet, 6) for _ in range(5)]]
        yield queries, strings, editing.distances(queries, strings)


def held(d, most):
    return {(i, j, int(d[i, j])) for i, j in zip(*(x.tolist() for x in np.nonzero(d <= most[:, None])))}


@pytest.mark.parametrize("share", [0, 0.1, 0.3, 0.5, 1, 2])
def test_pairs_within_a_bound(monkeypatch, share):
    monkeypatch.setattr(lanes, "OPEN", 0.3)  # some are left to single comparisons
    monkeypatch.setattr(lanes, "PAIRS", 40)
    for queries, strings, d in cases(int(share * 10), 12):
        most = np.array([int(len(x) * share) for x in queries])
        for found in (lanes.within(queries, lanes.Lanes(strings), strings, most), lanes.close(queries, strings, most)[:3]):
            got = list(zip(*(x.tolist() for x in found)))
            assert set(got) == held(d, most) and len(got) == len(set(got))
        # The longer side is looked up, the bound stays the query's.
        assert {tuple(int(v) for v in x) for x in zip(*lanes.close(queries, strings[:6], most)[:3])} == held(d[:, :6], most)


def test_votes_of_different_pieces():
    grams = lambda x: {x[i : i + 3] for i in range(len(x) - 2)}
    for queries, strings, _ in cases(7, 12):
        pieces = lanes.Pieces(strings, 3)
        for x in queries:
            want = sorted((-len(grams(x) & grams(y)), j) for j, y in enumerate(strings) if grams(x) & grams(y))[:5]
            assert list(zip(*(v.tolist() for v in pieces.most(x, 5)))) == [(j, -n) for n, j in want]


def test_few_of_a_pools_pairs_are_compared_one_by_one():
    rng = random.Random(3)
    strings = ["".join(rng.choices("ACDEFGHIKLMNPQRSTVWY", k=60)) for _ in range(400)]
    queries = [edited(rng, x, "ACD", 4) for x in strings[:40]]
    most = np.array([int(len(x) * 0.3) for x in queries])
    i, j, _, compared = lanes.close(queries, strings, most)
    assert set(range(40)) <= set(i[i == j].tolist()) and compared < 100  # of 16,000


def test_joins_of_cells_that_are_gone_through_whole(sides, monkeypatch):  # noqa: F811
    monkeypatch.setattr(similarity, "LEAST", 1)
    monkeypatch.setattr(similarity, "LEAST_CLOSE", 1)
    monkeypatch.setattr(similarity, "LANES", 50)
    blocks_hold(sides)
