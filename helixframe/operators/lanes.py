"""Edit distances within a bound, of one string to tens of thousands at a time.

A whole number holds a bit for each string of the pool. A cell of the distance
table is one such number that says for which strings the way through it costs an
edit, and two each for the differences to the cells on its left and above; they
follow from the neighbours by eight bitwise operations, without carries between
bits, so that numbers of any length cost one step of the interpreter. Only cells
near the main diagonal are gone through: a bound on the distance bounds how far a
way can leave it.
"""

from __future__ import annotations

import numpy as np

from helixframe.operators.editing import pair_distances

#: Strings that are compared with one at a time.
LANES = 1 << 16
#: Fewer are compared faster in other ways: where all cells of a table are gone through, and where pieces decide first.
LEAST, LEAST_CLOSE = 3000, 300
#: Under a bound below this share of the query's length most strings have lost before the query's end.
EARLY = 0.55
#: Share of the strings up to which those that have not lost are compared one by one.
OPEN = 0.002


def _numbers(rows: np.ndarray) -> list[int]:
    """Each row of booleans as a number, the first of them its lowest bit."""
    return [int.from_bytes(x.tobytes(), "little") for x in np.packbits(rows, axis=1, bitorder="little")]


def _sum(levels: list[list[int]]) -> list[int]:
    """The binary digits, lowest first, of how many numbers have each bit; those of levels[k] count 2**k times."""
    out, at = [], 0
    while at < len(levels):
        rows, carry = list(levels[at]), []
        while len(rows) > 2:
            a, b, c = rows.pop(), rows.pop(), rows.pop()
            x = a ^ b
            rows.append(x ^ c)
            carry.append((a & b) | (x & c))
        if len(rows) == 2:
            carry.append(rows[0] & rows[1])
            rows = [rows[0] ^ rows[1]]
        out.append(rows[0] if rows else 0)
        at += 1
        if carry:
            if at == len(levels):
                levels = [*levels, carry]
            else:
                levels = [*levels[:at], [*levels[at], *carry], *levels[at + 1 :]]
    return out


def _coded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different letters in order, the number of each letter)."""
    letters = np.unique(data)
    if len(letters) and letters[-1] < 1 << 16:  # a table is faster than a search
        number = np.zeros(int(letters[-1]) + 1, np.int64)
        number[letters] = np.arange(len(letters))
        return letters, number[data]
    return letters, np.searchsorted(letters, data)


class Lanes:
    """Strings of a pool, each a lane of one bit."""

    def __init__(self, strings: list[str]):
        self.size = np.array([len(x) for x in strings], dtype=np.int64)
        self.full = (1 << len(strings)) - 1
        self.longest = int(self.size.max(initial=0))
        data = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        letters, code = _coded(data)
        lane = np.repeat(np.arange(len(strings)), self.size)
        place = np.arange(len(data)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        table = np.full((self.longest, len(strings)), len(letters), np.uint8 if len(letters) < 255 else np.uint32)
        table[place, lane] = code
        #: Of each letter and place the lanes that have another letter there, or none.
        self.other = {chr(x): _numbers(table != k) for k, x in enumerate(letters.tolist())}
        self.none = [self.full] * self.longest
        self._ends: dict[int, int] = {}
        self._away: dict[tuple[int, int], list[int]] = {}

    def _reaching(self, place: int) -> int:
        """Lanes whose string has this many letters or more."""
        if place not in self._ends:
            self._ends[place] = _numbers((self.size >= place)[None])[0]
        return self._ends[place]

    def _lacking(self, n: int, most: int) -> list[int]:
        """The digits of most less what each string's length differs from n by, at least 0."""
        if (n, most) not in self._away:
            away = np.maximum(0, most - np.abs(self.size - n))
            self._away[n, most] = [_numbers((away >> k & 1 == 1)[None])[0] for k in range(most.bit_length())]
        return self._away[n, most]

    def _at_most(self, digits: list[int], most: int) -> int:
        """Lanes whose number, by its digits, is at most this."""
        if most < 0:
            return 0
        if most >> len(digits):
            return self.full
        found = self.full
        for k, x in enumerate(digits):
            found = found | (self.full ^ x) if most >> k & 1 else found & (self.full ^ x)
        return found

    def _bits(self, number: int) -> np.ndarray:
        return np.frombuffer(number.to_bytes(-(-len(self.size) // 8), "little"), np.uint8)

    def _places(self, number: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self._bits(number), bitorder="little"))

    def within(self, query: str, most: int) -> tuple[np.ndarray, np.ndarray | None]:
        """(lanes at most so many edits from the query, their distances), or (the few lanes that may be, None)."""
        n, full = len(query), self.full
        near = np.abs(self.size - n) <= most
        if not near.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not n:
            return np.flatnonzero(near), self.size[near]
        least, longest = int(self.size[near].min()), int(self.size[near].max())
        columns = max(n, longest)
        # A way that leaves the main diagonal further than this cannot come back in time.
        low, high = (most + n - least) // 2, (most + longest - n) // 2
        # Of each column the difference to the one on its left: lanes where it is not -1, and where it is not 1. Both are 1 at the edges.
        up, flat = [full] * (columns + 1), [0] * (columns + 1)
        check = int(1.45 * most) + 4 if most < EARLY * n else n
        steps = []
        for i, letter in enumerate(query, 1):
            other = self.other.get(letter, self.none)
            # The same of the difference to the row above, from column to column.
            a, c = full, 0
            first, last = max(1, i - low), min(columns, i + high)
            for j in range(first, last + 1):
                x, y = up[j], flat[j]
                cost = x & a
                if j <= self.longest:
                    cost &= other[j - 1]
                up[j], flat[j] = c | cost, a ^ (c & cost)
                a, c = y | cost, x ^ (y & cost)
                if j == i:
                    steps.append(cost)
            if i == check < n:
                # What the rest of the query and the strings differ in length by is to come.
                room = [most - max(0, least - n + i - j, j - i - longest + n) for j in range(columns + 1)]
                alive = self._alive(i, steps, up, flat, first, last, room)
                if alive.bit_count() <= OPEN * len(self.size):
                    found = self._places(alive)
                    return found[near[found]], None
                check += max(8, n // 8)
        # From the end of the diagonal along the last row to where each string ends. Steps of -1, 0 and 1 count as 0, 1
        # and 2, so that each lane counts what its length differs from n by as well; all are brought to the largest such.
        away = int(np.abs(self.size[near] - n).max())
        for j in range(n + 1, longest + 1):
            reach = self._reaching(j)
            steps += [up[j] & reach, reach & (full ^ flat[j])]
        for j in range(n, least, -1):
            short = full ^ self._reaching(j)
            steps += [flat[j] & short, short & (full ^ up[j])]
        levels = [[x] for x in self._lacking(n, away)] or [[]]
        digits = _sum([[*steps, *levels[0]], *levels[1:]])
        hit = self._places(self._at_most(digits, most + away))
        hit = hit[near[hit]]
        distance = np.full(len(hit), -away, np.int64)
        for k, x in enumerate(digits if len(hit) else ()):
            distance += (self._bits(x)[hit // 8] >> (hit % 8).astype(np.uint8) & 1).astype(np.int64) << k
        return hit, distance

    def _alive(self, i: int, steps: list[int], up: list[int], flat: list[int], first: int, last: int, room: list[int]) -> int:
        """Lanes that have in some column of row i no more than its room."""
        start = _sum([steps])
        start += [0] * ((2 * i + last).bit_length() - len(start))
        found = self._at_most(start, room[i])
        for right in (True, False):
            digits = list(start)
            for j in range(i + 1, last + 1) if right else range(i, first, -1):
                more, less = self.full ^ flat[j], self.full ^ up[j]
                if not right:
                    more, less = less, more
                for k, x in enumerate(digits):
                    digits[k], more = x ^ more, x & more
                for k, x in enumerate(digits):
                    digits[k] = x ^ less
                    less &= digits[k]
                found |= self._at_most(digits, room[j if right else j - 1])
        return found


def within(queries: list[str], pool: Lanes, strings: list[str], most: np.ndarray, keep=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(queries, strings, distances) of the pairs of at most so many edits for each query; pool holds the strings.

    keep(query, strings, distances), if given, says which of a query's pairs stay.
    """
    found, left = [(np.zeros(0, np.int64),) * 3], [(np.zeros(0, np.int64),) * 2]
    for i, (query, bound) in enumerate(zip(queries, most.tolist())):
        j, d = pool.within(query, bound)
        if d is None:
            left.append((np.full(len(j), i), j))
            continue
        if keep is not None:
            some = keep(i, j, d)
            j, d = j[some], d[some]
        found.append((np.full(len(j), i), j, d))
    i, j = (np.concatenate(x) for x in zip(*left))
    if len(i):
        d = pair_distances(queries, strings, i, j, most[i])
        ok = d <= most[i]
        i, j, d = i[ok], j[ok], d[ok]
        if keep is not None:
            at = np.concatenate([[0], np.flatnonzero(np.diff(i)) + 1, [len(i)]]) if len(i) else [0]
            some = [lo + keep(int(i[lo]), j[lo:hi], d[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
            some = np.concatenate(some) if some else np.zeros(0, np.int64)
            i, j, d = i[some], j[some], d[some]
        found.append((i, j, d))
    return tuple(np.concatenate(x) for x in zip(*found))


class Pieces:
    """The strings of a pool by the different pieces of a size that they have."""

    def __init__(self, strings: list[str], size: int):
        self.count, self.size = len(strings), size
        data = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(x) for x in strings], dtype=np.int64)
        self.letters, code = _coded(data)
        lane = np.repeat(np.arange(self.count), lengths)
        whole = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data)) >= size
        at = np.flatnonzero(whole)
        piece, lane = self._keys(code, at), lane[at]
        # Numbers of two bytes are sorted in one pass.
        order = np.argsort(piece.astype(np.uint16) if len(self.letters) ** size <= 1 << 16 else piece, kind="stable")
        piece, lane = piece[order], lane[order]
        new = np.ones(len(piece), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (lane[1:] != lane[:-1])
        piece, self.lanes = piece[new], lane[new]
        first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])) if len(piece) else np.zeros(0, np.int64)
        self.pieces, self.ends = piece[first], np.append(first, len(piece))

    def _keys(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        return sum((code[at + k] * len(self.letters) ** k for k in range(self.size)), np.zeros(len(at), np.int64))

    def most(self, query: str, top: int) -> tuple[np.ndarray, np.ndarray]:
        """(strings that have most of the query's different pieces, how many): at most so many, none without any, ties to the first."""
        data = np.frombuffer(query.encode("utf-32-le"), np.uint32)
        none = np.zeros(0, np.int64)
        if len(data) < self.size or not len(self.pieces):
            return none, none
        code = np.minimum(np.searchsorted(self.letters, data), len(self.letters) - 1)
        known = self.letters[code] == data
        at = np.arange(len(data) - self.size + 1)
        at = at[np.logical_and.reduce([known[at + k] for k in range(self.size)])]
        keys = np.unique(self._keys(code, at))
        place = np.minimum(np.searchsorted(self.pieces, keys), len(self.pieces) - 1)
        place = place[self.pieces[place] == keys].tolist()
        if not place:
            return none, none
        votes = np.bincount(np.concatenate([self.lanes[self.ends[x] : self.ends[x + 1]] for x in place]), minlength=self.count)
        # How many strings have so many votes or more.
        above = np.cumsum(np.bincount(votes)[::-1])[::-1]
        least = max(1, int(np.searchsorted(-above, -top, "right")) - 1)
        found = np.flatnonzero(votes >= least)
        found = found[np.lexsort((found, -votes[found]))[:top]]
        return found, votes[found]


#: Different pairs of letters that a table of them has room for.
KINDS = 4096


class Placed:
    """The strings of a pool by their pieces of three letters and the places of these."""

    def __init__(self, strings: list[str]):
        self.size = np.array([len(x) for x in strings], dtype=np.int64)
        self.places = int(self.size.max(initial=0)) + 1
        data = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        self.letters, code = _coded(data)
        lane = np.repeat(np.arange(len(strings)), self.size)
        place = np.arange(len(data)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        at = np.flatnonzero(place + 3 <= self.size[lane])
        keys = self._keys(code, at) * self.places + place[at]
        order = np.argsort(keys)
        self.keys, self.lanes = keys[order], lane[at][order]
        counts = np.bincount(lane * len(self.letters) + code, minlength=len(strings) * len(self.letters))
        self.counts = counts.reshape(len(strings), len(self.letters)).astype(np.int16)
        # The pairs of letters of each string by place, as long as a query's table of them is small.
        self.kinds = len(self.letters) ** 2
        self.pairs = None
        if self.kinds <= KINDS:
            at = np.flatnonzero(place + 2 <= self.size[lane])
            self.pairs = np.full((len(strings), self.places), self.kinds, np.int16)
            self.pairs[lane[at], place[at]] = code[at] * len(self.letters) + code[at + 1]

    def _keys(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = len(self.letters)
        return (code[at] * n + code[at + 1]) * n + code[at + 2]

    def near(self, query: str, most: np.ndarray) -> np.ndarray:
        """Strings that may be at most so many edits from the query, for each string.

        An edit spoils three pieces of the query; the others stand in the string, no
        further from their place than so many edits allow.
        """
        n = len(query)
        near = np.abs(self.size - n) <= most
        if not near.any() or not len(self.letters):
            return np.flatnonzero(near)
        data = np.frombuffer(query.encode("utf-32-le"), np.uint32)
        code = np.minimum(np.searchsorted(self.letters, data), len(self.letters) - 1)
        known = self.letters[code] == data
        low, high = int((most + n - self.size)[near].max()) // 2, int((most + self.size - n)[near].max()) // 2
        wanted = n - 2 - 3 * most
        if wanted[near].max() > 0:
            at = np.flatnonzero(known[:-2] & known[1:-1] & known[2:])
            first = self._keys(code, at) * self.places
            lo = np.searchsorted(self.keys, first + np.maximum(at - low, 0)).tolist()
            hi = np.searchsorted(self.keys, first + np.minimum(at + high, self.places - 1), "right").tolist()
            ranges = [self.lanes[x:y] for x, y in zip(lo, hi) if x < y]
            met = np.bincount(np.concatenate(ranges), minlength=len(self.size)) if ranges else np.zeros(len(self.size), np.int64)
            near &= met >= wanted
        found = np.flatnonzero(near)
        if not len(found):
            return found
        # Letters that the two do not have in common are edits, and an edit spoils two pairs of the string's letters.
        own = np.bincount(code[known], minlength=len(self.letters)).astype(np.int16)
        common = np.minimum(self.counts[found], own).sum(axis=1)
        found = found[np.maximum(self.size[found], n) - common <= most[found]]
        if self.pairs is None or n < 2 or not len(found):
            return found
        there = np.zeros((self.places, self.kinds + 1), bool)
        at = np.flatnonzero(known[:-1] & known[1:])
        for i, kind in zip(at.tolist(), (code[at] * len(self.letters) + code[at + 1]).tolist()):
            there[max(0, i - low) : i + high + 1, kind] = True
        met = there.ravel()[np.arange(self.places) * (self.kinds + 1) + self.pairs[found]].sum(axis=1)
        return found[met >= self.size[found] - 1 - 2 * most[found]]


#: Pairs that are compared one by one at a time.
PAIRS = 1 << 20


def close(queries: list[str], strings: list[str], most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(queries, strings, distances, how many were compared) of the pairs of at most so many edits for each query, the fewer edits the faster."""
    found, count = [(np.zeros(0, np.int64),) * 3], 0
    # What is gone through one by one is the shorter side; the bound stays the query's.
    few, many, turned = (strings, queries, True) if len(queries) > len(strings) else (queries, strings, False)
    for at in range(0, len(many), LANES):
        some = many[at : at + LANES]
        pool, waiting, held = Placed(some), [], 0
        for i, text in enumerate(few):
            j = pool.near(text, most[at : at + LANES] if turned else np.full(len(some), most[i]))
            waiting.append((np.full(len(j), i), j))
            held += len(j)
            if held < PAIRS and i + 1 < len(few):
                continue
            a, b = (np.concatenate(x) for x in zip(*waiting))
            waiting, count, held = [], count + held, 0
            if not len(a):
                continue
            bound = most[b + at] if turned else most[a]
            first = a[0]
            d = pair_distances(few[first : i + 1], some, a - first, b, bound)
            ok = d <= bound
            found.append((b[ok] + at, a[ok], d[ok]) if turned else (a[ok], b[ok] + at, d[ok]))
    return *(np.concatenate(x) for x in zip(*found)), count
