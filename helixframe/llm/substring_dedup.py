"""Duplicate passages by parsing documents relative to the corpus.

A word goes if a window of 50 consecutive words that covers it also starts in a
document with a smaller id. As in relative Lempel-Ziv coding, documents are
parsed, left to right and greedily, into factors of an indexed reference:

1. Reference blocks are cut where the content says so: a window is anchored at
   its smallest 16-word gram, and a run of windows with one anchor is a block.
   Equal windows have equal anchors, so the blocks that can hold a document's
   passages are those with its anchors; all others need no comparison.
2. The index has each block's earliest document. The parse goes from block to
   block: where an earlier document has the block, a factor begins, and it grows
   for as long as the next block is indexed too. Factors have a window at least.
3. At a factor's ends, where an anchor is shared but the block is not, the
   boundary is checked window by window against the earliest document that has
   each window.

The longest match is thus found by blocks and windows instead of by word-wise
extension into every reference: a reference that a third of all documents share
would otherwise be compared with each of them.

Blocks and windows are looked up by hashes of 128 bits, rows are told apart by
128 bits of id and text. Whatever is grouped by a key is written before it is
joined, so that every join stands on plain shuffles, whose hot keys adaptive
execution splits; groups are minima with partial aggregation. Texts are shuffled
once.

Defined results: null and empty texts have no words; texts of fewer than 50
words lose none; documents without an id come after all others and do not count
against each other, nor do rows that repeat an id; ids may be of any type that
has an order; an empty table gives none; columns of the input named n_words,
n_removed or kept give way to the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.textnum import BASES, chunks, covered, prefix, runs, segments, word_hashes, word_spans
from helixframe.session import discard, materialize

WINDOW = 50
GRAM = 16


def keyed(documents: DataFrame, results: tuple[str, ...]) -> DataFrame:
    """(rest, k, h, g, text): the other columns, the id, 128 bits of id and text."""
    rest = [c for c in documents.columns if c not in ("text", *results)]
    row = [F.col("doc_id").isNull(), F.col("doc_id"), F.coalesce("text", F.lit(""))]
    quoted = ["`" + c.replace("`", "``") + "`" for c in rest]
    return documents.select(F.struct(*quoted).alias("rest"), F.col("doc_id").alias("k"), F.xxhash64(*row).alias("h"), F.xxhash64(F.lit(1), *row).alias("g"), "text")


def before(a: str, b: str) -> Column:
    """Whether document a comes before document b; documents without an id come last and before none."""
    return F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) < F.col(b)))


def _parsed(texts, size: int = 1 << 20):
    """(lo, hi, prefix sums of both lanes, owner, first word of each text, words)."""
    for lo, hi, data, starts, ends in chunks(texts, size):
        s, e = word_spans(data)
        first = np.searchsorted(s, starts)
        owner = np.repeat(np.arange(hi - lo), np.diff(np.concatenate([first, [len(s)]])))
        yield lo, hi, [prefix(word_hashes(data, s, e, lane), base) for lane, base in enumerate(BASES)], owner, first, len(s)


def _blocks(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, sums, owner, first, _ in _parsed(b.column("text")):
                start, n, anchor, _ = segments(sums[1], owner, window, gram)
                of = owner[start]
                row = pa.array(lo + of)
                a, c = (runs(x, start, start + n + window - 1, base) for x, base in zip(sums, BASES))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(x).take(row) for x in ("k", "h", "g")), *(pa.array(x.view(np.int64)) for x in (anchor, a, c)), pa.array((start - first[of]).astype(np.int32)), pa.array(n.astype(np.int32))],
                    ["k", "h", "g", "anchor", "a", "b", "start", "n"])

    return run


def parse(blocks: list[dict], window: int) -> tuple[list[list[int]], list[int]]:
    """(factors, boundary): word spans of the factors, and the windows to check at their ends.

    blocks have start, n windows and whether an earlier document has them (dup).
    """
    factors: list[list[int]] = []
    boundary: list[int] = []
    for x in sorted(blocks, key=lambda x: x["start"]):
        start, stop = x["start"], x["start"] + x["n"] + window - 1
        if not x["dup"]:
            boundary.extend(range(start, start + x["n"]))
        elif factors and start + window - 1 == factors[-1][1]:
            factors[-1][1] = stop
        else:
            factors.append([start, stop])
    return factors, boundary


def _removed(text: str | None, spans: list, keep_text: bool):
    """(n_words, n_removed, kept) once the words within the spans are gone."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not spans and keep_text:
        return len(words), 0, text
    kept = words
    if spans:
        starts, ends = np.array(spans).T
        kept = [w for w, gone in zip(words, covered(len(words), starts, ends).tolist()) if not gone]
    joined = b" ".join(kept)
    return len(words), len(words) - len(kept), joined.decode("utf-8", "surrogatepass") if keep_text else hashlib.sha256(joined).hexdigest()


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_WINS = pa.list_(pa.struct([("pos", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]))


def _factors(window: int, keep_text: bool):
    """The factors of each document; texts with boundaries to check stay pending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, texts = b.column("found").to_pylist(), b.column("text")
            for lo, hi, sums, _, first, n_words in _parsed(texts):
                bounds = np.concatenate([first, [n_words]])
                rows = []
                for d in range(hi - lo):
                    text = texts[lo + d].as_py()
                    factors, boundary = parse(found[lo + d] or [], window)
                    if boundary:
                        at = np.array(boundary) + bounds[d]
                        a, c = (runs(x, at, at + window, base).view(np.int64).tolist() for x, base in zip(sums, BASES))
                        wins = [{"pos": p, "a": x, "b": y} for p, x, y in zip(boundary, a, c)]
                        rows.append((True, int(bounds[d + 1] - bounds[d]), None, text, [{"s": i, "e": j} for i, j in factors], wins))
                    else:
                        rows.append((False, *_removed(text, factors, keep_text), None, None))
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.string(), _SPANS, _WINS]
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("rest", "k", "h", "g")), *(pa.array(c, kind) for c, kind in zip(zip(*rows), kinds))],
                    ["rest", "k", "h", "g", "pending", "n_words", "n_removed", "kept", "spans", "wins"])

    return run


def _finished(window: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans, at in zip(b.column("kept").to_pylist(), b.column("spans").to_pylist(), b.column("at").to_pylist()):
                rows.append(_removed(text, [(x["s"], x["e"]) for x in spans] + [(p, p + window) for p in at or ()], keep_text))
            n, gone, kept = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("rest"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["rest", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """The columns of documents but text, with n_words, n_removed and kept.

    kept is the text itself where nothing is removed, else the remaining words
    joined by one space. Where keep_text is False it is the SHA-256 in lower-case
    hex of the remaining words joined by one space.
    """
    docs = keyed(documents, ("n_words", "n_removed", "kept"))
    kind, rest = docs.schema["k"].dataType, docs.schema["rest"].dataType
    hashes = "h long, g long, anchor long, a long, b long, start int, n int"
    blocks = docs.select("k", "h", "g", "text").mapInArrow(_blocks(window, gram), T.StructType([T.StructField("k", kind), *T.StructType.fromDDL(hashes)]))
    blocks = materialize(blocks, "blocks")
    # Anchors of two documents or more; a block that is alone under its anchor has no boundary to check.
    content = F.struct("a", "b")
    anchors = blocks.groupBy("anchor").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.max(F.col("k").isNull()).alias("none"), (F.min(content) != F.max(content)).alias("several"))
    anchors = materialize(anchors.where("low < high or (low is not null and none)").select("anchor", "several"), "anchors")
    near = materialize(blocks.join(anchors, "anchor"), "near")
    discard(blocks, anchors)
    index = near.groupBy("anchor", "a", "b").agg(F.min("k").alias("first"), F.max("k").alias("high"), F.max(F.col("k").isNull()).alias("none"))
    index = materialize(index.where("first < high or (first is not null and none)").select("anchor", "a", "b", "first"), "index")
    found = near.join(index, ["anchor", "a", "b"], "left").withColumn("dup", F.col("first").isNotNull() & before("first", "k")).where("dup or several")
    found = materialize(found.groupBy("h", "g").agg(F.collect_set(F.struct("start", "n", "dup")).alias("found")), "found")
    discard(near, index)
    parsed = T.StructType([T.StructField("rest", rest), T.StructField("k", kind), *T.StructType.fromDDL(
        "h long, g long, pending boolean, n_words long, n_removed long, kept string, spans array<struct<s:int,e:int>>, wins array<struct<pos:int,a:bigint,b:bigint>>")])
    parsed = materialize(docs.join(found, ["h", "g"], "left").select("rest", "k", "h", "g", "text", "found").mapInArrow(_factors(window, keep_text), parsed), "parsed")
    discard(found)
    pending = parsed.where("pending")
    wins = pending.select("k", "h", "g", F.explode("wins").alias("w")).select("k", "h", "g", "w.*")
    earliest = wins.groupBy("a", "b").agg(F.min("k").alias("first"), F.max("k").alias("high"), F.max(F.col("k").isNull()).alias("none"))
    earliest = materialize(earliest.where("first < high or (first is not null and none)").select("a", "b", "first"), "windows")
    at = materialize(wins.join(earliest, ["a", "b"]).where(before("first", "k")).groupBy("h", "g").agg(F.collect_set("pos").alias("at")), "windows")
    discard(earliest)
    checked = pending.join(at, ["h", "g"], "left").select("rest", "kept", "spans", "at")
    done = T.StructType([T.StructField("rest", rest), *T.StructType.fromDDL("n_words long, n_removed long, kept string")])
    checked = checked.mapInArrow(_finished(window, keep_text), done)
    return parsed.where("not pending").select("rest", "n_words", "n_removed", "kept").unionByName(checked).select("rest.*", "n_words", "n_removed", "kept")


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    return remove_repeats(documents.select("doc_id", "text"), keep_text=False).withColumnRenamed("kept", "kept_sha256")
