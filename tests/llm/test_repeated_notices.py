"""Notices that repeat within the alignment's band, against the places they were put at."""

import random
import time

import numpy as np
import pytest
from helixframe.llm import licenses
from helixframe.llm.license_templates import TEMPLATES
from helixframe.llm.textnum import BASES, prefix, windows

SHORT = [k for k, v in TEMPLATES.items() if len(v.split()) <= 12]
INDEX = licenses.Index(TEMPLATES)


def found(text):
    data = np.frombuffer(text.lower().encode(), np.uint8)
    _, _, words = licenses._words(data)
    grams = windows(prefix(words, BASES[1]), INDEX.gram, BASES[1])
    return [(INDEX.names[t], start, end) for t, _, start, end in licenses.matches(INDEX, words, INDEX.hits(grams), grams)]


def size(text):
    return len(licenses._words(np.frombuffer(text.lower().encode(), np.uint8))[0])


@pytest.mark.parametrize("name", SHORT)
def test_every_copy_is_found(name):
    n = size(TEMPLATES[name])
    for copies in (1, 2, 3, 5):
        for gap in range(12):
            filler = " " + " ".join(f"x{i}" for i in range(gap)) + " "
            at = [3 + k * (n + gap) for k in range(copies)]
            assert found("a b c " + filler.join([TEMPLATES[name]] * copies) + " tail") == [(name, i, i + n) for i in at], (copies, gap)


def test_a_cut_copy_beside_a_whole_one(spark):
    docs = spark.createDataFrame([(1, "Released under the MIT. Released under the MIT License."), (2, "Released under the MIT License. Released under the MIT.")], "doc_id long, text string")
    got = sorted((r.doc_id, r.word_start, r.word_end, r.n_matched) for r in licenses.scan(docs).collect())
    assert got == [(1, 0, 4, 4), (1, 4, 9, 5), (2, 0, 5, 5), (2, 5, 9, 4)]


def test_time_in_proportion_to_copies():
    name = next(k for k in SHORT if size(TEMPLATES[k]) >= 5)
    n, took = size(TEMPLATES[name]), {}
    for copies in (200, 1600):
        began = time.perf_counter()
        got = found(" ".join([TEMPLATES[name]] * copies))
        took[copies] = time.perf_counter() - began
        assert got == [(name, k * n, (k + 1) * n) for k in range(copies)]
    assert took[1600] < 30 * took[200] + 0.5


def test_chains_against_all_chains():
    rng = random.Random(4)
    for _ in range(150):
        segments = sorted({(rng.randint(1, 9), (t := rng.randint(0, 40)), t + rng.randint(1, 9), (w := rng.randint(0, 90)), w + rng.randint(1, 9)) for _ in range(rng.randint(0, 7))}, key=lambda x: (x[3], x[1]))
        chains = [[x] for x in segments]
        for c in chains:
            chains += [[*c, x] for x in segments if licenses._follows(c[-1], x)]
        got = licenses._chains(segments)
        assert max(got, default=(0,))[0] == max((sum(x[0] for x in c) for c in chains), default=0)
        assert sum(x[0] for x in got) == sum(x[0] for x in segments)
