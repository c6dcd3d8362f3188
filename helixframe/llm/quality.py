"""Quality classifier: histogram gradient-boosted trees over text statistics.

Statistics come from whole texts, in one pass of numpy per text. Trees are
grown on a bounded sample of labelled rows (``max_rows``), flattened into arrays
and walked for all rows of a batch at once. Ids, languages, sources and labels
are never inputs of a score.

Defined results: null and empty texts have all-zero statistics and a score;
labels that are null are ignored and repeated labels of a document average;
with no labels, or labels of one kind only, every score is that kind's share
(0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.textnum import BASES, prefix, windows, word_hashes, word_spans

THRESHOLD = 0.3
#: Bound of the labelled sample; its statistics (40 numbers a row) fit the driver many times over.
MAX_ROWS = 20_000

_KINDS = np.zeros((8, 256))
for _b in range(256):
    _c = chr(_b)
    _KINDS[0, _b] = _c.isascii() and _c.islower()
    _KINDS[1, _b] = _c.isascii() and _c.isupper()
    _KINDS[2, _b] = _c.isascii() and _c.isdigit()
    _KINDS[3, _b] = _b in (32, 9, 11, 12, 13)
    _KINDS[4, _b] = _b == 10
    _KINDS[5, _b] = _c in ".,;:!?'\"()-"
    _KINDS[6, _b] = 32 < _b < 127 and not _c.isalnum() and _c not in ".,;:!?'\"()-"
    _KINDS[7, _b] = _b >= 128
#: Bytes of letters and digits.
_WORDY = (_KINDS[0] + _KINDS[1] + _KINDS[2] + _KINDS[7]) > 0
_ENDS = np.frombuffer(b".!?,;:", np.uint8)


def _repeats(hashes: np.ndarray) -> tuple[float, float]:
    """Share of items that repeat another one, and of the commonest item."""
    if not len(hashes):
        return 0.0, 0.0
    cuts = np.flatnonzero(np.diff(np.sort(hashes))) + 1
    counts = np.diff(np.concatenate([[0], cuts, [len(hashes)]]))
    return 1 - len(counts) / len(hashes), float(counts.max() / len(hashes))


def statistics(text: str | None) -> list[float]:
    """The numbers that the classifier sees of a text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    kinds = _KINDS @ counts / n
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    starts, ends = word_spans(data)
    m = max(len(starts), 1)
    lengths = ends - starts if len(starts) else np.zeros(1, np.int64)
    first, last = data[starts], data[ends - 1]
    before = data[np.maximum(ends - 2, 0)]
    letters = np.concatenate([[0], np.cumsum(_WORDY[data])])
    uppers = np.concatenate([[0], np.cumsum(_KINDS[1][data])])
    lowers = np.concatenate([[0], np.cumsum(_KINDS[0][data])])
    alone = float((letters[ends] == letters[starts]).sum()) / m
    shouted = float(((uppers[ends] - uppers[starts] > 1) & (lowers[ends] == lowers[starts])).sum()) / m
    capital = float(_KINDS[1][first].sum()) / m
    ended = float(np.isin(last, _ENDS).sum()) / m
    twice = float(((last == before) & (ends - starts > 2) & ~_WORDY[last]).sum()) / m
    words = word_hashes(data, starts, ends)
    sums = prefix(words, BASES[0])
    word_repeats, word_top = _repeats(words)
    pairs, pair_top = _repeats(windows(sums, 2, BASES[0]))
    fives, _ = _repeats(windows(sums, 5, BASES[0]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_repeats = 1 - len(set(lines)) / max(len(lines), 1) if lines else 0.0
    line_top = max(Counter(lines).values()) / len(lines) if lines else 0.0
    line_lengths = np.array([len(x) for x in lines] or [0])
    stopped = sum(1 for x in lines if x.rstrip()[-1:] in b".!?") / max(len(lines), 1)
    doubled = float((data[1:] == data[:-1]).mean()) if n > 1 else 0.0
    return [
        float(np.log1p(n)), float(np.log1p(len(starts))), float(np.log1p(len(lines))), *kinds.tolist(), entropy,
        float(lengths.mean()), float(lengths.std()), float(np.log1p(lengths.max())), float((lengths <= 3).mean()), float((lengths >= 12).mean()),
        alone, shouted, capital, ended, twice, word_repeats, word_top, pairs, pair_top, fives, line_repeats, line_top,
        float(np.log1p(line_lengths.mean())), float(np.log1p(line_lengths.max())), stopped, doubled,
    ]


NAMES = [
    "log_bytes", "log_words", "log_lines", "lower", "upper", "digit", "space", "newline", "punctuation", "symbol", "high", "entropy",
    "word_mean", "word_spread", "word_longest", "short_words", "long_words", "bare_symbols", "shouted", "capital", "ended", "doubled_end",
    "word_repeats", "word_top", "pair_repeats", "pair_top", "five_repeats", "line_repeats", "line_top", "line_mean", "line_longest",
    "stopped_lines", "doubled_bytes",
]


@dataclass
class Trees:
    """An ensemble as arrays: node 0 of each tree is its root; leaves point to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cut points between distinct values, at quantiles where there are many."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
            out.append(values)
        else:
            out.append((values[:-1] + values[1:]) / 2)
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least: float = 4.0) -> Trees:
    """Boosted trees for logistic loss, split on histograms of binned columns."""
    n = len(y)
    share = min(max(y.mean() if n else 0.5, 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    parts: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots: list[int] = []

    def node(feature: int = 0, threshold: float = 0.0, value: float = 0.0) -> int:
        k = len(parts["feature"])
        for name, v in (("feature", feature), ("threshold", threshold), ("left", k), ("right", k), ("value", value)):
            parts[name].append(v)
        return k

    if not n or y.min() == y.max():
        roots.append(node())
    else:
        edges = _edges(x, bins)
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
        columns, width = x.shape[1], bins + 1
        cell = binned + np.arange(columns) * width
        raw = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            roots.append(node())
            front = [(roots[-1], np.arange(n))]
            for level in range(depth + 1):
                after = []
                for k, rows in front:
                    gs, hs = g[rows].sum(), h[rows].sum()
                    best = (1e-6, None)
                    if level < depth and len(rows) >= 2:
                        flat = cell[rows].ravel()
                        hg = np.bincount(flat, np.repeat(g[rows], columns), columns * width).reshape(columns, width).cumsum(axis=1)
                        hh = np.bincount(flat, np.repeat(h[rows], columns), columns * width).reshape(columns, width).cumsum(axis=1)
                        hc = np.bincount(flat, minlength=columns * width).reshape(columns, width).cumsum(axis=1)
                        gain = hg**2 / (hh + ridge) + (gs - hg) ** 2 / (hs - hh + ridge) - gs**2 / (hs + ridge)
                        gain[(hc < least) | (len(rows) - hc < least)] = -1
                        f, b = np.unravel_index(np.argmax(gain), gain.shape)
                        if gain[f, b] > best[0]:
                            best = (gain[f, b], (int(f), int(b)))
                    if best[1] is None:
                        parts["value"][k] = -rate * gs / (hs + ridge)
                        raw[rows] += parts["value"][k]
                        continue
                    f, b = best[1]
                    parts["feature"][k], parts["threshold"][k] = f, float(edges[f][b])
                    goes = binned[rows, f] <= b
                    parts["left"][k], parts["right"][k] = node(), node()
                    after += [(parts["left"][k], rows[goes]), (parts["right"][k], rows[~goes])]
                front = after
    kinds = {"feature": np.int64, "threshold": float, "left": np.int64, "right": np.int64, "value": float}
    return Trees(**{k: np.array(v, dtype=kinds[k]) for k, v in parts.items()}, roots=np.array(roots), depth=depth, base=base)


def _rows(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in texts], dtype=float).reshape(len(texts), len(NAMES))


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _rows(b.column("text"))
        values = pa.array(x.tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([b.column("label"), values], ["label", "x"])


def is_held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> Trees:
    """Trees from at most max_rows labelled documents that are not held out.

    The sample is the labelled ids of smallest hash: bounded, so its ids are
    broadcast and its statistics come to the driver, at any size of the tables.
    """
    known = (
        labels.where("quality is not null and doc_id is not null").where(~is_held_out("doc_id"))
        .groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    texts = documents.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    # One text for each id, however often the id repeats.
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    rows = texts.select("label", "text").mapInArrow(_with_statistics, "label double, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(NAMES))
    y = (rows["label"].to_numpy(dtype=float) >= 0.5).astype(float)
    # Rows arrive in task order; a fixed order makes the sums, and so the trees, repeatable.
    order = np.lexsort((*x.T, y)) if len(y) else []
    return grow(x[order], y[order], **options)


def _scorer(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                scores = trees.score(_rows(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names), pa.array(scores)], [*part.schema.names, "__score"])

    return run


def score(documents: DataFrame, trees: Trees) -> DataFrame:
    """The documents, all columns, with __score, which takes the place of a column of that name."""
    documents = documents.drop("__score")
    return documents.mapInArrow(_scorer(trees), T.StructType([*documents.schema.fields, T.StructField("__score", T.DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    trees = fit(documents, labels, max_rows)
    scored = score(documents.select("doc_id", "text"), trees)
    return scored.select(
        "doc_id", is_held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted")
    )
