"""Licence notices, pages and trees against hand-made cases and brute force."""

import random
import time

import numpy as np
import pytest
from helixframe.llm import html_text, licenses, quality
from helixframe.llm.html_text import render
from helixframe.llm.license_templates import TEMPLATES
from helixframe.llm.textnum import BASES, prefix, windows

INDEX = licenses.Index(TEMPLATES)


def found(text):
    data = np.frombuffer(text.lower().encode(), np.uint8)
    _, _, words = licenses._words(data)
    grams = windows(prefix(words, BASES[1]), INDEX.gram, BASES[1])
    return [(*INDEX.names[t], matched, round(matched / len(INDEX.words[t]), 2), start, end) for t, matched, start, end in licenses.matches(INDEX, words, INDEX.hits(grams), grams)]


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_every_notice_is_its_own(name):
    rows = found(f"x y z {TEMPLATES[name]} tail end")
    assert [r[:2] for r in rows] == [name] and rows[0][3] == 1.0


def test_words_put_in_and_parts():
    words = TEMPLATES[("MIT", "grant")].split()
    cut = words[:30] + [f"n{i}" for i in range(9)] + words[30:]
    assert [r[:2] + r[3:] for r in found(" ".join(cut))] == [("MIT", "grant", 1.0, 0, 96)]
    half = found(" ".join(words[: len(words) // 2]))
    assert [r[:2] for r in half] == [("MIT", "grant")] and 0.4 < half[0][3] < 0.6
    assert found("nothing of this kind stands in here at all") == []


def test_local_alignment_against_all_cells():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (np.array(rng.choices(range(1, 5), k=rng.randint(1, 9)), np.uint64) for _ in range(2))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i, j] = max(0, best[i - 1, j - 1] + (1 if x == y else -1), best[i - 1, j] - 1, best[i, j - 1] - 1)
        matched, t0, t1, x0, x1 = licenses.align(a, b, 0, band=12)
        spare = max(t1 - t0, x1 - x0) - matched
        assert matched <= min(t1 - t0, x1 - x0) and best.max() >= matched - 2 * spare and (best.max() == 0) == (matched == 0)


@pytest.mark.parametrize("page, text", [
    ("<style>@media print{.x{display:none}}</style><p class=x>a", "a"),
    ("<style>@media screen{.x{display:none}}</style><p class=x>a<p>b", "b"),
    ("<style>.x{display:none} .x{display:block}</style><p class=x>b", "b"),
    ("<style>#a{display:block} p{display:none}</style><p id=a>shown<p>gone", "shown"),
    ("<style>.k{display:none!important}</style><i class=k style='display:inline'>n</i>ok", "ok"),
    ("<div style='visibility:hidden'>no<b style='visibility:visible'>yes</b></div>", "yes"),
    ("<p don't>hello</p><p>it's</p><p>z</p>", "hello\n\nit's\n\nz"),
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
    ("<table><tr><td colspan=2>A<td>B<tr><td>c<td>d<td>e</table>", "A     B\nc  d  e"),
    ("<table><tr><td>日本<td>x<tr><td>abcde<td>y</table>", "日本   x\nabcde  y"),
    ("<svg><text>drawn</text><defs>not</defs></svg>", "drawn"),
    ("<details><summary>s</summary>body</details><details open><summary>t</summary>body</details>", "s\nt\nbody"),
    ("<ul><li>a<ul><li>b</ul><li>c</ul>", "- a\n  - b\n- c"),
    ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
])
def test_pages(page, text):
    assert render(page) == text


def test_long_pages_take_time_in_proportion():
    for page in ("<style>" + "a" * 300_000 + "</style>x", "<style>" + "/*" * 100_000 + "</style>x", "<p " + "a='" * 100_000 + ">x", "<p>" + "word " * 200_000, "<i>" * 50_000 + "x",
                 "<table><tr><td colspan=1000 rowspan=65534>a" + "<tr><td>b" * 400, "<table>" + "<tr><td colspan=1000 rowspan=65534>a" * 3000, "<table><tr>" + "<td rowspan=65534>a" * 3000 + "<tr><td>b" * 3000,
                 "<table><tr>" + "".join(f"<td rowspan={65000 - k}>a" for k in range(3000)) + "<tr><td>b" * 3000):
        began = time.time()
        text = render(page)
        assert time.time() - began < 15 and len(text) < 40 * len(page)


def test_tables_with_spans_against_a_full_grid():
    rng = np.random.default_rng(6)
    for _ in range(200):
        rows = [[(f"{r}.{k}", int(rng.integers(1, 4)), int(rng.integers(1, 4))) for k in range(rng.integers(0, 4))] for r in range(rng.integers(1, 7))]
        taken, want = set(), []
        for r, row in enumerate(rows):
            line, column = [], 0
            for text, columns, deep in row:
                while (r, column) in taken:
                    column += 1
                line.append((column, text))
                taken |= {(r + d, column + c) for d in range(1, deep) for c in range(columns)}
                column += columns
            want.append(line)
        assert html_text._grid(rows) == want
        used = sorted({c for row in want for c, _ in row})
        width = {c: max(len(t) for row in want for x, t in row if x == c) for c in used}
        lines = ["  ".join(dict(row).get(c, "").ljust(width[c]) for c in used).rstrip() for row in want if row]
        assert html_text._aligned(want) == lines

def test_trees_against_a_walk_by_hand():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(400, 5)), 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.grow(x, y, trees=30, depth=3)
    got = trees.score(x)
    for row, score in zip(x[:50], got[:50]):
        total = trees.base
        for k in trees.roots:
            while trees.left[k] != k:
                k = trees.left[k] if row[trees.feature[k]] <= trees.threshold[k] else trees.right[k]
            total += trees.value[k]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((got > 0.5) == (y > 0.5)).mean() > 0.95


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(9)
    x, y = rng.integers(0, 6, size=(60, 3)).astype(float), rng.integers(0, 2, 60).astype(float)
    tree = quality.grow(x, y, trees=1, depth=1, least=1.0)
    p = y.mean()
    g, h = np.full(60, p) - y, np.full(60, p * (1 - p))

    def gain(mask):
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (mask, ~mask)) - g.sum() ** 2 / (h.sum() + 1)

    best = max(gain(x[:, f] <= c) for f in range(3) for c in np.unique(x[:, f])[:-1])
    k = tree.roots[0]
    assert gain(x[:, tree.feature[k]] <= tree.threshold[k]) == pytest.approx(best)


def test_many_spans_stand_as_few_do():
    """Ends that differ from column to column, in so many rows that a look at each of them in each row would be out of proportion."""
    for n in (20, 3000):
        rows = [[("a", 1, 65000 - k) for k in range(n)]] + [[("b", 1, 1)]] * n
        assert html_text._grid(rows) == [[(k, "a") for k in range(n)]] + [[(n, "b")]] * n
    comb = [[("a", 1 + k % 3, 1 + (k % 2) * 100) for k in range(2000)]] + [[("b", 1, 1)] * 5] * 50
    column, free = 0, []
    for _, columns, deep in comb[0]:
        free += range(column, column + columns) if deep == 1 else []
        column += columns
    assert [c for c, _ in html_text._grid(comb)[50]] == free[:5]


def test_cuts_by_splitting_are_those_of_the_pattern():
    from helixframe.llm import sentencepiece_codec as codec

    for text in ("", "▁", "▁a", "▁a▁b", "a▁b", "▁a▁▁b", "▁▁a", "▁a▁", "▁a\n▁b c", "▁é▁日本"):
        assert codec._cuts(text) == codec.CUT.findall(text)
