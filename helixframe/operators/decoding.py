"""Sequences written codon by codon, by a scorer that sees what has been written.

Proteins of a batch advance together, one position at a time. A scorer gives
each a row of 64 log scores from its protein, the position and the codon before;
only codons that code for the residue count, and a stop comes last. Choices are
greedy, drawn at a temperature by a hash of seed, record and position, or guided:
greedy on the log probability less beta times the squared distance of the running
share of G and C from a target.

Mask-predict works on whole sequences: all codons are predicted at once, then in
each further round those of which the scorer was least certain are masked and
predicted again, fewer each time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import codons as C
from helixframe.operators.usage import CODONS

UNKNOWN, MASK = 64, 65
_AT = {c: k for k, c in enumerate(CODONS)}
_GC = np.array([*(sum(x in "GC" for x in c) for c in CODONS), 0])
#: The codons of each residue, by letter's code; letters that are no residue allow none.
_ALLOWED = np.zeros((128, 64), dtype=bool)
for _c, _k in _AT.items():
    _i = [C.BASES.index(x) for x in _c]
    _a = C.TABLES[2][16 * _i[0] + 4 * _i[1] + _i[2]]
    if _a != "*":
        _ALLOWED[ord(_a), _k] = True
_STOP = np.zeros(64, dtype=bool)
_STOP[[_AT[c] for c in C.STOPS]] = True

#: scorer(proteins as letters, position, codons before: -1 at the beginning, 64 unknown) -> 64 log scores for each.
Scorer = Callable[[np.ndarray, int, np.ndarray], np.ndarray]


def letters(proteins: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of letters, padded with 0, lengths); letters outside ASCII are no residues."""
    lengths = np.array([len(p) for p in proteins], dtype=np.int64)
    out = np.zeros((len(proteins), int(lengths.max(initial=0))), dtype=np.int64)
    for r, p in enumerate(proteins):
        out[r, : len(p)] = np.frombuffer(p.encode("ascii", "replace"), np.uint8)
    return out, lengths


def uniform(seed: int, ids: np.ndarray, position: int) -> np.ndarray:
    """Numbers from 0 to 1 by a hash of seed, id and position, whatever the order of rows."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(position) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


def _log_softmax(scores: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    masked = np.where(allowed, scores, -np.inf)
    top = masked.max(axis=1, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return masked - top - np.log(np.exp(masked - top).sum(axis=1, keepdims=True))


#: The codons of each residue in alphabetical order, by letter's code, filled up with 64; row 128 has the stops.
_MOST = int(max(_ALLOWED.sum(axis=1).max(), _STOP.sum()))
_CHOICES = np.full((129, _MOST), UNKNOWN)
for _a in range(129):
    _k = np.flatnonzero(_ALLOWED[_a] if _a < 128 else _STOP)
    _CHOICES[_a, : len(_k)] = _k
#: Letters that have codons, the stop after them and one for all others, in order; and the place of each letter there.
_RESIDUES = np.array([*np.flatnonzero(_ALLOWED.any(axis=1)), 128, 0])
_PLACE = np.full(129, len(_RESIDUES) - 1)
_PLACE[_RESIDUES[:-1]] = np.arange(len(_RESIDUES) - 1)


def _values(table: np.ndarray, residue: int) -> np.ndarray:
    """Log probabilities of a residue's codons for each row of a table of log scores; those that are filled up have none."""
    allowed = np.broadcast_to(_STOP if residue == 128 else _ALLOWED[residue], table.shape)
    value = np.where(allowed, _log_softmax(table, allowed), -np.inf)
    return np.hstack([value, np.full((len(value), 1), -np.inf)])[:, _CHOICES[residue]]


def decode(proteins: list[str], ids: np.ndarray, scorer: Scorer, strategy: str = "greedy", temperature: float = 1.0, seed: int = 0, target_gc: float = 0.44, beta: float = 0.0) -> list[str]:
    """A sequence for each protein; of equal scores the first codon in alphabetical order wins.

    Residues without codons write nothing, but count as a codon without G and C.
    """
    if strategy not in ("greedy", "sample"):
        raise ValueError(f"unknown strategy {strategy}")
    code, lengths = letters(proteins)
    rows = np.arange(len(proteins))
    values = getattr(scorer, "values", None) if strategy == "greedy" else None
    before, gc = np.full(len(proteins), -1), np.zeros(len(proteins), dtype=np.int64)
    written = np.full((len(proteins), code.shape[1] + 1), UNKNOWN)
    for position in range(code.shape[1] + 1):
        live = rows[lengths >= position]
        ends = lengths[live] == position
        here = code[live, np.minimum(position, code.shape[1] - 1)] if code.shape[1] else np.zeros(len(live), np.int64)
        if values is not None:
            # A score by the codon before alone: the residue's few codons are looked up.
            residue = np.where(ends, 128, here)
            value = values[_PLACE[residue], before[live]]
            if beta:
                choice = _CHOICES[residue]
                running = (gc[live, None] + _GC[choice]) / (3.0 * (position + 1))
                value = value - beta * (running - target_gc) ** 2
            pick = _CHOICES[residue, np.argmax(value, axis=1)]
            written[live, position] = pick
            gc[live] += _GC[pick]
            before[live] = pick
            continue
        allowed = np.where(ends[:, None], _STOP[None, :], _ALLOWED[here])
        scores = np.asarray(scorer(code[live], position, before[live]), dtype=float)
        if strategy == "sample":
            share = np.exp(_log_softmax(scores / max(temperature, 1e-6), allowed))
            total = np.cumsum(np.nan_to_num(share), axis=1)
            u = uniform(seed, ids[live], position) * total[:, -1]
            pick = np.minimum((total <= u[:, None]).sum(axis=1), 63)
        else:
            value = _log_softmax(scores, allowed)
            if beta:
                running = (gc[live, None] + _GC[None, :64]) / (3.0 * (position + 1))
                value = value - beta * (running - target_gc) ** 2
            pick = np.argmax(np.where(allowed, value, -np.inf), axis=1)
        pick = np.where(allowed.any(axis=1), pick, UNKNOWN)
        written[live, position] = pick
        gc[live] += _GC[pick]
        before[live] = pick
    return ["".join(CODONS[k] for k in w[: n + 1] if k != UNKNOWN) for w, n in zip(written, lengths)]


def markov(transitions: np.ndarray, first: np.ndarray) -> Scorer:
    """A scorer by the codon before: a 64 x 64 table of probabilities, and those at the beginning and behind unknown residues."""
    with np.errstate(divide="ignore"):
        table = np.log(np.vstack([transitions, first, first]))  # rows 64 and -1

    def score(_, __, before: np.ndarray) -> np.ndarray:
        return table[before]

    score.values = np.stack([_values(table, a) for a in _RESIDUES])
    return score


def tables(transitions: DataFrame, counts: DataFrame, smoothing: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """The 4,096 transition probabilities and 64 shares of codons of a corpus, for ``markov``."""
    p, first = np.zeros((64, 64)), np.full(64, smoothing)
    for r in transitions.collect():
        p[_AT[r["from"]], _AT[r["to"]]] = r["p"]
    for r in counts.where(F.col("codon").isin(list(CODONS))).collect():
        first[_AT[r["codon"]]] += r["n"]
    return p, first / first.sum()


def with_decoded(records: DataFrame, scorer: Scorer, batch: int = 256, out: str = "generated", **choice: object) -> DataFrame:
    """(idx, generated) of records' proteins; a null protein has null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            # Like lengths go together: a batch takes as many steps as its longest protein.
            some = pdf[pdf["protein"].notna()]
            some = some.iloc[np.argsort(some["protein"].str.len().to_numpy(), kind="stable")]
            yield pdf[pdf["protein"].isna()][["idx"]].assign(**{out: None})
            for lo in range(0, len(some), batch):
                part = some.iloc[lo : lo + batch]
                yield pd.DataFrame({"idx": part["idx"], out: decode(part["protein"].tolist(), part["idx"].to_numpy(), scorer, **choice)})

    return records.select("idx", "protein").mapInPandas(run, f"idx long, {out} string")


#: scorer(proteins as letters, codons: 65 where masked) -> 64 log scores for each place.
PlaceScorer = Callable[[np.ndarray, np.ndarray], np.ndarray]


def least_certain(scores: np.ndarray, maskable: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The n places of each row with the lowest scores, among those that may be masked; of equal ones the first."""
    order = np.argsort(np.where(maskable, scores, 2.0), axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    return (rank < n[:, None]) & maskable


def mask_predict(proteins: list[str], scorer: PlaceScorer, rounds: int = 10, trace: list | None = None) -> list[str]:
    """Sequences by rounds of masking and predicting, without a stop; trace gets the masks of each round."""
    code, lengths = letters(proteins)
    allowed = _ALLOWED[code]
    maskable = allowed.any(axis=2)
    count = maskable.sum(axis=1)
    codons = np.where(maskable, MASK, UNKNOWN)
    certain = np.ones(code.shape)
    best = getattr(scorer, "best", None)
    for t in range(rounds):
        n = count * (rounds - 1 - t) // rounds
        if best is not None:
            # A score by the neighbours alone: open places look up their codon and its probability.
            at = np.nonzero(codons == MASK)
            around = np.pad(codons, ((0, 0), (1, 1)), constant_values=UNKNOWN)
            found = (_PLACE[code[at]], around[at[0], at[1]], around[at[0], at[1] + 2])
            codons, certain = codons.copy(), certain.copy()
            codons[at], certain[at] = best[0][found], best[1][found]
        else:
            codons, certain = _predicted(scorer, code, codons, certain, allowed)
        if t == rounds - 1 or not n.any():
            break
        masked = least_certain(certain, maskable, n)
        if trace is not None:
            trace.append(masked)
        codons = np.where(masked, MASK, codons)
    return ["".join(CODONS[k] for k in c[:n] if k < 64) for c, n in zip(codons, lengths)]


def _predicted(scorer: PlaceScorer, code: np.ndarray, codons: np.ndarray, certain: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest codons of all masked places and their probabilities; what is not masked stays."""
    shape = (-1, 64)
    value = _log_softmax(np.asarray(scorer(code, codons), dtype=float).reshape(shape), allowed.reshape(shape)).reshape(allowed.shape)
    value = np.where(allowed, value, -np.inf)
    open_ = codons == MASK
    return np.where(open_, value.argmax(axis=2), codons), np.where(open_, np.exp(value.max(axis=2, initial=-np.inf)), certain)


def neighbours(transitions: np.ndarray, first: np.ndarray) -> PlaceScorer:
    """A scorer of places by both neighbouring codons, so far as they are known."""
    with np.errstate(divide="ignore"):
        to, start = np.log(transitions), np.log(first)
    left = np.vstack([to, np.zeros((2, 64))])  # a masked or unknown neighbour says nothing
    right = np.vstack([to.T, np.zeros((2, 64))])

    def score(code: np.ndarray, codons: np.ndarray) -> np.ndarray:
        before = np.concatenate([np.full((len(codons), 1), UNKNOWN), codons[:, :-1]], axis=1)
        after = np.concatenate([codons[:, 1:], np.full((len(codons), 1), UNKNOWN)], axis=1)
        return start + left[before] + right[after]

    # By residue, codon before and codon after, 65 where masked: the likeliest codon and its probability.
    codon, share = (np.zeros((len(_RESIDUES), MASK + 1, MASK + 1), kind) for kind in (np.int64, float))
    around = (start + left[:, None] + right[None, :]).reshape(-1, 64)
    for place, residue in enumerate(_RESIDUES[:-2]):
        value = _values(around, residue)
        codon[place] = _CHOICES[residue][value.argmax(axis=1)].reshape(codon[place].shape)
        share[place] = np.exp(value.max(axis=1)).reshape(share[place].shape)
    score.best = codon, share
    return score


def with_refined(records: DataFrame, scorer: PlaceScorer, rounds: int = 10, batch: int = 128) -> DataFrame:
    """(idx, generated) by mask-predict, with TAA behind; a null protein has null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            some = pdf[pdf["protein"].notna()]
            some = some.iloc[np.argsort(some["protein"].str.len().to_numpy(), kind="stable")]
            yield pdf[pdf["protein"].isna()][["idx"]].assign(generated=None)
            for lo in range(0, len(some), batch):
                part = some.iloc[lo : lo + batch]
                yield pd.DataFrame({"idx": part["idx"], "generated": [s + "TAA" for s in mask_predict(part["protein"].tolist(), scorer, rounds)]})

    return records.select("idx", "protein").mapInPandas(run, "idx long, generated string")


def _share(*parts: Column | str) -> Column:
    """From 0 (excluded) to 1 by a hash of the parts."""
    return (F.conv(F.substr(F.md5(F.concat_ws(":", *parts)), F.lit(1), F.lit(8)), 16, 10).cast("double") + 1) / 2.0**32


def training_masks(records: DataFrame, seed: int = 42) -> DataFrame:
    """(idx, masked): the places of each protein that a training step masks, ascending.

    A share is drawn for each protein, and so many of its places, one at least,
    are those with the smallest draws.
    """
    places = F.sequence(F.lit(0), F.length("protein") - 1)
    draws = F.array_sort(F.transform(places, lambda i: F.struct(F.md5(F.concat_ws(":", F.lit(str(seed)), "idx", i)).alias("h"), i.alias("i"))))
    n = F.greatest(F.lit(1), F.ceil(_share(F.lit(str(seed)), "idx", F.lit("ratio")) * F.length("protein"))).cast("int")
    chosen = F.array_sort(F.transform(F.slice(draws, 1, n), lambda x: x["i"]))
    return records.where(F.length("protein") > 0).select("idx", chosen.alias("masked"))
