"""Suffix arrays against sorting, and how often they are sorted."""

import random

import numpy as np
import pytest

from helixframe.llm import suffix_dedup


@pytest.mark.parametrize("most", [1, 3, 255, 70_000, 1 << 40])
def test_suffixes_are_in_order_of_their_first_symbols(most):
    rng = random.Random(most)
    some = [rng.randrange(most + 1) for _ in range(7)]
    symbols = [rng.choice(some) for _ in range(300)] * 2
    for depth in (1, 2, 4, 128):
        got = suffix_dedup.suffix_array(np.array(symbols), depth).tolist()
        assert sorted(got) == list(range(600))
        cut = [symbols[i : i + depth] for i in got]
        assert cut == sorted(cut)


def test_no_symbols():
    assert suffix_dedup.suffix_array(np.zeros(0, np.int64), 128).tolist() == []


def test_first_symbols_are_sorted_at_once(monkeypatch):
    calls, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or sort(*a, **k))
    suffix_dedup.suffix_array(np.array([0, 1, 2] * 200), 128)
    assert len(calls) <= 4
