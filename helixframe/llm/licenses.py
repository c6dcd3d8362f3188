"""Licence notices in texts: winnowed fingerprints, banded alignment, chains.

Fingerprints are hashes of three-word runs; of each three neighbouring runs of
a template the smallest is kept in an inverted index, so that any five words
which a text shares with a template, in order, hit the index. Hits on one
diagonal (text position minus template position, within the band) give a
candidate; a banded local alignment of the template against that place gives the
segments that both share. Segments that follow one another in text and template,
with at most GAP other words between them, are chained: words put into a notice
do not hide it. A chain's matched words, covered share of the template and span
are reported where the share reaches ``coverage``, or, as part of a notice, where
PART_WORDS words and PART of the template match.

Licences that share most of their words are told apart by those they do not
share: of overlapping finds the one stays whose template has most matched less
unmatched words (ties: larger share, the earlier, then by name).

Templates are a fixed parameter, not data: the index travels with the task.
Defined results: null, empty and notice-free texts give no row; a notice that
occurs twice gives two rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from helixframe.llm.license_templates import TEMPLATES
from helixframe.llm.textnum import BASES, chunks, prefix, windows, word_hashes

GRAM = 3
WINDOW = 3
BAND = 8
COVERAGE = 0.8
#: Least words of a segment, most words between two segments of one notice, least words and share of a part.
SEGMENT = 3
GAP = 64
PART_WORDS = 12
PART = 0.3

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _LETTER[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = _spans(data)
    return starts, ends, word_hashes(data, starts, ends)


def winnow(grams: np.ndarray, window: int = WINDOW) -> list[int]:
    """Positions of the rightmost smallest hash in each window."""
    if len(grams) <= window:
        return list(range(len(grams)))
    kept = {int(i + window - 1 - np.argmin(grams[i : i + window][::-1])) for i in range(len(grams) - window + 1)}
    return sorted(kept)


class Index:
    def __init__(self, templates: dict[tuple[str, str], str], gram: int = GRAM) -> None:
        self.gram = gram
        self.names, self.words = list(templates), []
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, text in enumerate(templates.values()):
            _, _, words = _words(np.frombuffer(text.lower().encode(), np.uint8))
            self.words.append(words)
            grams = windows(prefix(words, BASES[1]), gram, BASES[1])
            for at in winnow(grams):
                places[int(grams[at])].append((t, at))
        self.prints = np.array(sorted(places), dtype=np.uint64)
        self.places = dict(places)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        if not len(grams) or not len(self.prints):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.prints, grams), len(self.prints) - 1)
        return np.flatnonzero(self.prints[at] == grams)


def align(template: np.ndarray, text: np.ndarray, first: int, band: int = BAND) -> tuple[int, int, int, int, int]:
    """(matched words, template start, end, text start, end) of the best local alignment near a diagonal.

    Words that match count 1, others and gaps -1. Only cells within the band
    around the diagonal that starts at text position first are filled.
    """
    m, low = len(template), first - band
    width = 2 * band + 1
    ramp = np.arange(width)
    score = np.zeros((m + 1, width), dtype=np.int64)
    # Column c of row i stands for text position low + i + c: the words up to there.
    at = low + np.arange(m + 1)[:, None] + ramp
    inside = (at >= 1) & (at <= len(text))
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    same = inside[1:] & (padded[np.where(inside[1:], at[1:] - 1, len(text))] == template[:, None])
    for i in range(1, m + 1):
        best = score[i - 1] + np.where(same[i - 1], 1, -1)
        best[:-1] = np.maximum(best[:-1], score[i - 1][1:] - 1)
        best = np.where(inside[i], np.maximum(best, 0), 0)
        score[i] = np.where(inside[i], np.maximum.accumulate(best + ramp) - ramp, 0)
    i, c = np.unravel_index(int(np.argmax(score)), score.shape)
    i, c = int(i), int(c)
    matched, ends, start = 0, (i, low + i + c), (i, low + i + c)
    while i > 0 and score[i, c] > 0:
        if score[i, c] == score[i - 1, c] + (1 if same[i - 1, c] else -1):
            if same[i - 1, c]:
                matched += 1
                start = (i - 1, low + i + c - 1)
            i -= 1
        elif c + 1 < width and score[i, c] == score[i - 1, c + 1] - 1:
            i, c = i - 1, c + 1
        else:
            c -= 1
    return matched, start[0], ends[0], start[1], ends[1]


def _segments(template: np.ndarray, words: np.ndarray, firsts: list[int]) -> list[tuple[int, int, int, int, int]]:
    """All segments near the diagonals, the longest first; what is found is blanked, so that what lies behind it shows."""
    left, out = words.copy(), []
    heap = [(-x[0], x, first) for first in firsts if (x := align(template, left, first))[0] >= SEGMENT]
    heapq.heapify(heap)
    while heap:
        _, x, first = heapq.heappop(heap)
        if not (left[x[3] : x[4]] == 0).any():
            out.append(x)
            left[x[3] : x[4]] = 0
        # Blanked words only shorten a segment, so the longest on the heap stays the longest there is.
        x = align(template, left, first)
        if x[0] >= SEGMENT:
            heapq.heappush(heap, (-x[0], x, first))
    return sorted(out, key=lambda x: (x[3], x[1]))


def _follows(y: tuple[int, int, int, int, int], x: tuple[int, int, int, int, int]) -> bool:
    """Whether segment x may come behind y in a chain: in text, within the gap, and in template."""
    return y[4] <= x[3] <= y[4] + GAP and y[2] <= x[1]


def _chains(segments: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """(matched, start, end) of chains of segments, best first among those that share segments; a segment is in one chain only.

    Segments that no chain can join are apart, so that notices which repeat in a
    text are chained each for itself.
    """
    longest = max((x[4] - x[3] for x in segments), default=0)
    before: list[list[int]] = []
    part = list(range(len(segments)))

    def root(i: int) -> int:
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    for i, x in enumerate(segments):
        before.append([])
        j = i - 1
        while j >= 0 and x[3] - segments[j][3] <= GAP + longest:
            if _follows(segments[j], x):
                before[i].append(j)
                part[root(i)] = root(j)
            j -= 1
    groups: dict[int, list[int]] = defaultdict(list)
    for i in range(len(segments)):
        groups[root(i)].append(i)
    out = []
    for group in groups.values():
        left = dict.fromkeys(group)
        while left:
            best, last = {}, {}
            for i in left:
                best[i], last[i] = segments[i][0], -1
                for j in before[i]:
                    if j in left and best[j] + segments[i][0] > best[i]:
                        best[i], last[i] = best[j] + segments[i][0], j
            i = max(left, key=lambda k: (best[k], -k))
            matched, end = best[i], segments[i][4]
            while i >= 0:
                start = segments[i][3]
                del left[i]
                i = last[i]
            out.append((matched, start, end))
    return out


def matches(index: Index, words: np.ndarray, hits: np.ndarray, grams: np.ndarray, coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """(template, matched, start, end) without overlaps, by start; words and hits are of one text."""
    diagonals: dict[int, set[int]] = defaultdict(set)
    for at in hits.tolist():
        for t, place in index.places[int(grams[at])]:
            diagonals[t].add(at - place)
    found = []
    for t, firsts in diagonals.items():
        starts: list[int] = []
        for first in sorted(firsts):
            if not starts or first - starts[-1] > BAND // 2:
                starts.append(first)
        size = len(index.words[t])
        for matched, start, end in _chains(_segments(index.words[t], words, starts)):
            if matched >= coverage * size or (matched >= PART_WORDS and matched >= PART * size):
                found.append((t, matched, start, end))
    kept: list[tuple[int, int, int, int]] = []
    taken = np.zeros(len(words) + 1, dtype=bool)
    size = [len(w) for w in index.words]
    for x in sorted(set(found), key=lambda x: (size[x[0]] - 2 * x[1], -x[1] / size[x[0]], x[2], index.names[x[0]])):
        if not taken[x[2] : x[3]].any():
            taken[x[2] : x[3]] = True
            kept.append(x)
    return sorted(kept, key=lambda x: x[2])


def _scanner(templates: dict, coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for b in batches:
            ids, rows = b.column("doc_id").to_pylist(), []
            for lo, _, data, starts, ends in chunks(b.column("text"), lower=True):
                s, e, words = _words(data)
                grams = windows(prefix(words, BASES[1]), index.gram, BASES[1])
                hits = index.hits(grams)
                if not len(hits):
                    continue
                first, last = np.searchsorted(s, starts), np.searchsorted(s, ends)
                of = np.searchsorted(starts, s[hits], side="right") - 1
                for d in np.unique(of).tolist():
                    a, z = int(first[d]), int(last[d])
                    mine = hits[(of == d) & (hits + index.gram <= z)]
                    for t, matched, i, j in matches(index, words[a:z], mine - a, grams[a:z], coverage):
                        raw = data[starts[d] : ends[d]].tobytes()
                        chars = [len(raw[: int(x) - int(starts[d])].decode("utf-8", "replace")) for x in (s[a + i], e[a + j - 1])]
                        name, form = index.names[t]
                        rows.append((ids[lo + d], name, form, matched, matched / len(index.words[t]), i, j, *chars))
            columns = list(zip(*rows)) if rows else [()] * 9
            kinds = [b.schema.field("doc_id").type, pa.string(), pa.string(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NAMES)

    return run


NAMES = ["doc_id", "license", "form", "n_matched", "coverage", "word_start", "word_end", "char_start", "char_end"]


def scan(documents: DataFrame, templates: dict[tuple[str, str], str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row for each notice found: licence, form, matched words, coverage and spans."""
    schema = T.StructType([T.StructField("doc_id", documents.schema["doc_id"].dataType), *T.StructType.fromDDL(
        "license string, form string, n_matched long, coverage double, word_start long, word_end long, char_start long, char_end long")])
    return documents.select("doc_id", "text").mapInArrow(_scanner(dict(templates), coverage), schema)
