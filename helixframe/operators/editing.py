"""Edit distances of blocks of strings: bit-parallel columns, many pairs at a time.

Spark's own levenshtein compares a pair letter by letter, which takes some tens
of microseconds for two proteins of a hundred residues. Here a column of the
distance table is a few 64-bit words, and numpy moves all pairs of a block on by
one letter at once (Myers' recursion with carries between words). Most pairs
need no table: one edit changes at most g of the g-letter pieces of a string, so
what two strings have in common bounds their distance from below, and a product
of two matrices counts it for all pairs of a block.
"""

from __future__ import annotations

import numpy as np

#: Words that one step works on: small enough for a core's cache.
CELLS = 1 << 15
#: The same where pairs stand alone.
ALONE = 1 << 16
#: Different pieces that one product of matrices counts.
PIECES = 4096
#: Share of a block's pairs from which on all are compared together: a pair on its own takes somewhat longer.
DENSE = 0.6
_ONE, _TOP = np.uint64(1), np.uint64(63)


def _codes(strings: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in strings]


def distances(queries: list[str], pool: list[str]) -> np.ndarray:
    """Edit distances, a row for each query and a column for each string of the pool."""
    out = np.zeros((len(queries), len(pool)), dtype=np.int64)
    if not queries or not pool:
        return out
    q, t = _codes(queries), _codes(pool)
    letters = np.unique(np.concatenate([*q, *t]))
    sizes = np.array([len(x) for x in t])
    words = max(1, -(-int(sizes.max()) // 64))
    # Bits of each letter in each pool string; the row behind the last letter stays empty.
    bits = np.zeros((len(letters) + 1, words, len(pool)), dtype=np.uint64)
    for k, x in enumerate(t):
        at = np.arange(len(x))
        np.bitwise_or.at(bits, (np.searchsorted(letters, x), at // 64, k), _ONE << (at % 64).astype(np.uint64))
    # The bits of each string: a column's differences add up to its last value.
    whole = np.zeros((words, len(pool)), dtype=np.uint64)
    for w in range(words):
        inside = np.clip(sizes - 64 * w, 0, 64)
        whole[w] = np.where(inside == 64, ~np.uint64(0), (_ONE << (inside % 64).astype(np.uint64)) - _ONE)
    order = np.argsort([len(x) for x in q], kind="stable")
    step = max(1, CELLS // len(pool))
    for lo in range(0, len(order), step):
        some = order[lo : lo + step]
        length = np.array([len(q[i]) for i in some])
        code = np.full((int(length.max()), len(some)), len(letters))
        for r, i in enumerate(some):
            code[: len(q[i]), r] = np.searchsorted(letters, q[i])
        shape = (len(some), len(pool))
        plus, minus = [np.full(shape, ~np.uint64(0)) for _ in range(words)], [np.zeros(shape, np.uint64) for _ in range(words)]
        eq, xh, ph, mh, x = (np.empty(shape, np.uint64) for _ in range(5))
        ups, downs = [np.empty(shape, np.uint64) for _ in range(2)], [np.empty(shape, np.uint64) for _ in range(2)]
        out[some[length == 0]] = sizes
        for j in range(len(code)):
            for w in range(words):
                p, m = plus[w], minus[w]
                np.take(bits[:, w], code[j], axis=0, out=eq, mode="clip")
                np.bitwise_or(eq, m, out=x)
                if w:
                    np.bitwise_or(eq, downs[(w - 1) % 2], out=eq)
                np.bitwise_and(eq, p, out=xh)
                np.add(xh, p, out=xh)
                np.bitwise_xor(xh, p, out=xh)
                np.bitwise_or(xh, eq, out=xh)
                np.bitwise_or(xh, p, out=ph)
                np.invert(ph, out=ph)
                np.bitwise_or(ph, m, out=ph)
                np.bitwise_and(p, xh, out=mh)
                if w + 1 < words:
                    np.right_shift(ph, _TOP, out=ups[w % 2])
                    np.right_shift(mh, _TOP, out=downs[w % 2])
                np.left_shift(ph, _ONE, out=ph)
                np.bitwise_or(ph, ups[(w - 1) % 2] if w else _ONE, out=ph)
                np.left_shift(mh, _ONE, out=mh)
                if w:
                    np.bitwise_or(mh, downs[(w - 1) % 2], out=mh)
                np.bitwise_or(x, ph, out=p)
                np.invert(p, out=p)
                np.bitwise_or(p, mh, out=p)
                np.bitwise_and(ph, x, out=m)
            done = np.flatnonzero(length == j + 1)
            if len(done):
                score = np.full((len(done), len(pool)), j + 1, dtype=np.int64)
                for w in range(words):
                    score += np.bitwise_count(plus[w][done] & whole[w]).astype(np.int64)
                    score -= np.bitwise_count(minus[w][done] & whole[w]).astype(np.int64)
                out[some[done]] = score
    empty = sizes == 0
    if empty.any():
        out[:, empty] = np.array([len(x) for x in q])[:, None]
    return out


def pair_distances(queries: list[str], pool: list[str], i: np.ndarray, j: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Edit distances of queries[i] and pool[j]; those above the bound of their pair are some number above it.

    A letter changes a column's last value by one at most, so a pair is left as
    soon as the letters that remain cannot bring it back to its bound.
    """
    q, t = _codes(queries), _codes(pool)
    out = np.zeros(len(i), dtype=np.int64)
    if not len(i):
        return out
    sizes = np.array([len(x) for x in t])
    n, m = np.array([len(x) for x in q])[i], sizes[j]
    letters = np.unique(np.concatenate([*q, *t, np.zeros(1, np.uint32)]))
    text = np.full((len(q), max(1, int(n.max()))), len(letters))
    for r, x in enumerate(q):
        text[r, : min(len(x), text.shape[1])] = np.searchsorted(letters, x[: text.shape[1]])
    out[:] = np.where(n == 0, m, np.where(m == 0, n, 0))
    # Pairs of like sizes go together: those of a step have as many words as the longest.
    order = np.lexsort((n, (m + 63) // 64))
    order = order[(n[order] > 0) & (m[order] > 0)]
    code_of = np.searchsorted(letters, np.concatenate(t))
    start = np.cumsum(sizes) - sizes
    lo = 0
    while lo < len(order):
        words = int((m[order[min(len(order), lo + ALONE) - 1]] + 63) // 64)
        some = order[lo : lo + max(1, ALONE // words)]
        lo += len(some)
        words = int((m[some].max() + 63) // 64)
        strings, place = np.unique(j[some], return_inverse=True)
        bits = np.zeros((len(letters) + 1, len(strings), words), dtype=np.uint64)
        size = sizes[strings]
        owner = np.repeat(np.arange(len(strings)), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        np.bitwise_or.at(bits, (code_of[np.repeat(start[strings], size) + at], owner, at // 64), _ONE << (at % 64).astype(np.uint64))
        plus, minus = [np.full(len(some), ~np.uint64(0)) for _ in range(words)], [np.zeros(len(some), np.uint64) for _ in range(words)]
        score, last_word, last_bit = m[some].astype(np.int64), (m[some] - 1) // 64, ((m[some] - 1) % 64).astype(np.uint64)
        row, most, length = i[some], bound[some], n[some]
        for step in range(int(length.max())):
            up, down = np.ones(len(some), np.uint64), np.zeros(len(some), np.uint64)
            code = text[row, step]
            for w in range(words):
                p, g = plus[w], minus[w]
                eq = bits[code, place, w]
                xv = eq | g
                eq = eq | down
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = g | ~(xh | p), p & xh
                here = last_word == w
                score += np.where(here, ((ph >> last_bit) & _ONE).astype(np.int64) - ((mh >> last_bit) & _ONE).astype(np.int64), 0)
                up_out, down_out = ph >> _TOP, mh >> _TOP
                ph, mh = (ph << _ONE) | up, (mh << _ONE) | down
                plus[w], minus[w] = mh | ~(xv | ph), ph & xv
                up, down = up_out, down_out
            done = length == step + 1
            if done.any() or step % 8 == 7:
                out[some[done]] = score[done]
                lost = ~done & (score - (length - step - 1) > most)
                out[some[lost]] = most[lost] + 1
                keep = ~(done | lost)
                if not keep.all():
                    some, row, most, length, place, score, last_word, last_bit = (x[keep] for x in (some, row, most, length, place, score, last_word, last_bit))
                    plus, minus = [x[keep] for x in plus], [x[keep] for x in minus]
                    if not len(some):
                        break
    return out


def _pieces(strings: list[np.ndarray], size: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, piece, how many equal ones of its owner stand before it) of all pieces of a size."""
    owner = np.repeat(np.arange(len(strings)), [max(0, len(x) - size + 1) for x in strings])
    piece = [sum(x[k : len(x) - size + 1 + k].astype(np.int64) * base**k for k in range(size)) for x in strings if len(x) >= size]
    piece = np.concatenate(piece) if piece else np.zeros(0, np.int64)
    order = np.lexsort((piece, owner))
    owner, piece = owner[order], piece[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1])
    at = np.arange(len(owner))
    return owner, piece, at - np.maximum.accumulate(np.where(new, at, 0))


def common_pieces(queries: list[str], pool: list[str], size: int, distinct: bool = False) -> np.ndarray:
    """How many pieces of ``size`` letters each query has in common with each string of the pool, equal ones as often as both have them, or once if distinct."""
    q, t = _codes(queries), _codes(pool)
    letters = np.unique(np.concatenate([*q, *t, np.zeros(1, np.uint32)]))
    sides = [_pieces([np.searchsorted(letters, x) for x in side], size, len(letters)) for side in (q, t)]
    if distinct:
        sides = [tuple(x[nth == 0] for x in (owner, piece, nth)) for owner, piece, nth in sides]
    # The k-th of equal pieces meets the k-th of the other side.
    most = 1 + max((int(s[2].max()) for s in sides if len(s[2])), default=0)
    keys = [piece * most + nth for _, piece, nth in sides]
    both = np.intersect1d(*keys)
    out = np.zeros((len(q), len(t)), dtype=np.float32)
    for lo in range(0, len(both), PIECES):
        part = both[lo : lo + PIECES]
        tables = []
        for (owner, _, _), key, count in zip(sides, keys, out.shape):
            at = np.minimum(np.searchsorted(part, key), len(part) - 1)
            hit = part[at] == key
            table = np.zeros((count, len(part)), dtype=np.float32)
            table[owner[hit], at[hit]] = 1
            tables.append(table)
        out += tables[0] @ tables[1].T
    return out.astype(np.int64)


def least_distances(queries: list[str], pool: list[str]) -> np.ndarray:
    """A lower bound of every edit distance: from the lengths, the common letters and the common pairs of letters."""
    n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (queries, pool))
    longer = np.maximum(n[:, None], m[None, :])
    low = np.maximum(np.abs(n[:, None] - m[None, :]), longer - common_pieces(queries, pool, 1))
    return np.maximum(low, -((common_pieces(queries, pool, 2) - longer + 1) // 2))


def first_bounds(queries: list[str], pool: list[str], k: int, low: np.ndarray, cost: np.ndarray, relative: bool, valid) -> tuple[np.ndarray, np.ndarray, int]:
    """(k-th best cost of each query among its few likeliest pairs by lower bound, inf for fewer than k; the last of these pairs; pairs compared)."""
    few = min(cost.shape[1], 4 * k)
    columns = np.argpartition(cost, few - 1, axis=1)[:, :few] if few < cost.shape[1] else np.broadcast_to(np.arange(few), (len(cost), few))
    i, j = np.repeat(np.arange(len(queries)), few), columns.ravel()
    d = pair_distances(queries, pool, i, j, np.full(len(i), 1 << 40))
    size = np.maximum(np.maximum([len(queries[x]) for x in i], [len(pool[x]) for x in j]), 1)
    found = np.where(valid(d, i, j), d / size if relative else d, np.inf).reshape(columns.shape)
    if few < k:
        return np.full(len(queries), np.inf), columns[:, 0], len(i)
    at = np.argpartition(found, k - 1, axis=1)[:, k - 1]
    rows = np.arange(len(queries))
    return found[rows, at], columns[rows, at], len(i)


def nearest(queries: list[str], pool: list[str], k: int, start: np.ndarray, relative: bool, valid) -> tuple[np.ndarray, int]:
    """(distances, pairs compared): all pairs that can be among the k best of their query; the others have -1.

    Best is least distance, or least distance over the longer length if
    relative; only pairs for which valid(distances, rows, columns) holds count.
    start is what the k-th best of each query is known not to exceed, inf if
    nothing is. The likeliest pairs are compared first. If these leave most
    pairs open, all are compared at once; else the others follow in the order of
    their lower bounds, more at a time as it goes on, until no bound is as low
    as the k-th best found.
    """
    shape = (len(queries), len(pool))
    if shape[1] <= 4 * k:
        return distances(queries, pool), shape[0] * shape[1]
    out = np.full(shape, -1, dtype=np.int64)
    low = least_distances(queries, pool)
    size = np.maximum(np.maximum(np.array([len(x) for x in queries])[:, None], np.array([len(x) for x in pool])[None, :]), 1)
    cost = low / size if relative else low.astype(float)
    kth, compared = start.astype(float), 0
    if np.isinf(kth).any():
        bound, _, compared = first_bounds(queries, pool, k, low, cost, relative, valid)
        kth = np.minimum(kth, bound)
    if (cost <= kth[:, None]).mean() > DENSE:
        return distances(queries, pool), out.size
    order = np.argsort(cost, axis=1, kind="stable")
    found = np.full(shape, np.inf)
    at, width = 0, 4 * k
    while at < shape[1]:
        columns = order[:, at : at + width]
        wanted = np.take_along_axis(cost, columns, 1) <= kth[:, None]
        if not wanted.any():
            break
        i = np.nonzero(wanted)[0]
        j = columns[wanted]
        bound = np.where(np.isinf(kth[i]), float(1 << 40), kth[i] * (size[i, j] if relative else 1) + 1e-9).astype(np.int64)
        d = pair_distances(queries, pool, i, j, bound)
        compared += len(i)
        good = d <= bound
        i, j, d = i[good], j[good], d[good]
        out[i, j] = d
        ok = valid(d, i, j)
        found[i[ok], j[ok]] = d[ok] / size[i[ok], j[ok]] if relative else d[ok]
        kth = np.minimum(kth, np.partition(found, k - 1, axis=1)[:, k - 1])
        at += width
        width *= 2
    return out, compared


#: Kinds of runs of an alignment: pairs that are equal and that differ, residues of the query alone and of the target alone.
EQUAL, OTHER, QUERY, TARGET = "=", "X", "I", "D"
#: Bytes of kept columns up to which pairs are aligned together.
KEPT = 1 << 26


def alignments(queries: list[str], targets: list[str]) -> tuple[np.ndarray, list[list[tuple[str, int]]]]:
    """(edit distances, runs) of global alignments of each query with the target of its place.

    Runs are (kind, length) from the beginning on. Pairs are preferred over
    gaps, then gaps in the target. The columns' differences, up and sideways,
    are kept as bits, from which the ways back of all pairs are read together,
    one step at a time.
    """
    distance, runs = np.zeros(len(queries), np.int64), [None] * len(queries)
    n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (queries, targets))
    order = np.lexsort((n, (m + 63) // 64))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        size = lambda k: 32 * max(1, -(-int(m[order[lo:k]].max()) // 64)) * max(1, int(n[order[lo:k]].max())) * (k - lo)  # noqa: E731, B023
        while hi < len(order) and hi - lo < 4096 and size(min(len(order), hi + 64)) <= KEPT:
            hi = min(len(order), hi + 64)
        some = order[lo:hi]
        d, r = _aligned_block([queries[i] for i in some], [targets[i] for i in some])
        distance[some] = d
        for i, x in zip(some.tolist(), r):
            runs[i] = x
        lo = hi
    return distance, runs


def _aligned_block(queries: list[str], targets: list[str]) -> tuple[np.ndarray, list[list[tuple[str, int]]]]:
    q, t = _codes(queries), _codes(targets)
    n, m = (np.array([len(x) for x in side], dtype=np.int64) for side in (q, t))
    count, steps, words = len(q), int(n.max(initial=0)), max(1, -(-int(m.max(initial=0)) // 64))
    pairs = np.arange(count)
    a, b = np.zeros((count, steps + 1), np.uint32), np.zeros((count, int(m.max(initial=0)) + 1), np.uint32)
    for r, (x, y) in enumerate(zip(q, t)):
        a[r, : len(x)], b[r, : len(y)] = x, y
    letters = np.unique(np.concatenate([*q, *t, np.zeros(1, np.uint32)]))
    code = np.searchsorted(letters, a)
    bits = np.zeros((len(letters), count, words), dtype=np.uint64)
    for r, y in enumerate(t):
        at = np.arange(len(y))
        np.bitwise_or.at(bits, (np.searchsorted(letters, y), r, at // 64), _ONE << (at % 64).astype(np.uint64))
    # kept[step]: up-and-down differences of the column before, and sideways differences into this one, each as plus and minus.
    kept = np.zeros((steps, 4, words, count), dtype=np.uint64)
    plus, minus = np.full((words, count), ~np.uint64(0)), np.zeros((words, count), np.uint64)
    for step in range(steps):
        up, down = np.ones(count, np.uint64), np.zeros(count, np.uint64)
        kept[step, 0], kept[step, 1] = plus, minus
        for w in range(words):
            p, g = plus[w], minus[w]
            eq = bits[code[:, step], pairs, w]
            xv = eq | g
            eq = eq | down
            xh = (((eq & p) + p) ^ p) | eq
            ph, mh = g | ~(xh | p), p & xh
            kept[step, 2, w], kept[step, 3, w] = ph, mh
            up_out, down_out = ph >> _TOP, mh >> _TOP
            ph, mh = (ph << _ONE) | up, (mh << _ONE) | down
            plus[w], minus[w] = mh | ~(xv | ph), ph & xv
            up, down = up_out, down_out

    def change(which: int, step: np.ndarray, row: np.ndarray, who: np.ndarray) -> np.ndarray:
        w, bit = (row - 1) // 64, ((row - 1) % 64).astype(np.uint64)
        return ((kept[step, which, w, who] >> bit) & _ONE).astype(np.int64) - ((kept[step, which + 1, w, who] >> bit) & _ONE).astype(np.int64)

    i, j, distance = n.copy(), m.copy(), np.zeros(count, np.int64)
    back: list[list[list]] = [[] for _ in range(count)]
    kinds = np.array([EQUAL, OTHER, QUERY, TARGET])
    while True:
        live = np.flatnonzero((i > 0) | (j > 0))
        if not len(live):
            break
        x, y = i[live], j[live]
        inner = (x > 0) & (y > 0)
        step, row = np.maximum(x - 1, 0), np.maximum(y, 1)
        side = np.where(inner, change(2, step, row, live), 1)
        corner = side + np.where(inner, change(0, step, row, live), 0)
        same = inner & (a[live, step] == b[live, row - 1])
        pair = inner & (corner == np.where(same, 0, 1))
        gap = ~pair & (x > 0) & ((y == 0) | (side == 1))
        kind = np.where(pair, np.where(same, 0, 1), np.where(gap, 2, 3))
        distance[live] += kind > 0
        i[live] -= pair | gap
        j[live] -= pair | ~gap
        for r, k in zip(live.tolist(), kinds[kind].tolist()):
            runs = back[r]
            if runs and runs[-1][0] == k:
                runs[-1][1] += 1
            else:
                runs.append([k, 1])
    return distance, [[(k, c) for k, c in reversed(runs)] for runs in back]
