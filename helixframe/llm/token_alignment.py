"""Alignment of the tokens of two tokenizers by byte offsets.

Running text repeats its words, so the text is cut where neither tokenizer can
look across, and each different segment is encoded and aligned once: segments
begin and end with tokens of both, so counts add up and groups follow each other.
The alignment is relational: tokens are posexploded, a window sums their lengths
to ends, tokens that end at one byte meet by segment and end, a running count of
common ends numbers the groups, and the tokens that cover each stretch between
neighbouring ends, which a running value brings along, are its link. Every two
tokens that overlap do so in exactly one such stretch, so the links are the
result of the range join without forming the pairs of a group.

Links of all segments, times their occurrences, make the counts of the corpus.
The most frequent pairs, and the most frequent segments, up to a fixed number of
each, are sent to the workers and looked up in place; all others by a join.

Defined results: null and empty texts, and texts whose tokens do not spell them
(such as the white-space marker itself), have no tokens, count in no corpus
figure and get zeros and an empty digest. Repeated rows count each for
itself; rows without doc_id keep it null. An empty table has no rows. Other
columns are not read. A task holds one text's segments and their strings.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.sentencepiece_codec import BYTE, CONTROL, MARK, MODEL_PATH, NORMAL, THREADS, UNKNOWN, USER_DEFINED, Codec, parse
from helixframe.session import discard, materialize

BYTE_PATH = os.environ.get("BYTE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")
#: White space of either tokenizer, and a little more: a cut needs other characters at both sides.
_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Of white space what is no line feed, and what is neither that nor a space.
_NO_LINE = _SPACE.replace(r"\t-\r", r"\t\x0b-\r")
_OTHER = _NO_LINE.replace(r"\x1c-\x20", r"\x1c-\x1f")
#: Segments that every worker knows, and the longest of these in characters: some 20 MB. Pairs of tokens that it knows: 6 MB.
DICTIONARY, LONGEST, PAIRS = 1 << 18, 32, 1 << 18
#: Segments that are encoded at once.
TOGETHER = 512
#: Segments of documents that are put together at once.
AT_ONCE = 1 << 17
_TWO = [("n_a", "n_b"), ("n_groups", "n_links"), ("bad", "n_best")]
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "bad"]


@dataclass(frozen=True)
class Cuts:
    """How texts are cut: at single spaces, also at line feeds if lines, or not at all if neither is known to be safe."""

    words: bool
    lines: bool


def safe_cuts(byte_json: bytes, proto: bytes) -> Cuts:
    """Cuts between segments that both tokenizers encode alike within any text.

    The first tokenizer must cut words by the usual byte-level rule, which never
    looks back and looks ahead of white space only; the second may have no piece
    that goes on past a marker, or past a character that a line feed follows.
    """
    settings, model = json.loads(byte_json), parse(proto)
    rule = {k: (settings["pre_tokenizer"] or {}).get(k) for k in ("type", "add_prefix_space", "use_regex")}
    extra = [t for t in settings["added_tokens"] if not t["special"] or t["lstrip"] or t["rstrip"]]
    plain = rule == {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and not settings["normalizer"] and not extra
    words = plain and Codec(model).cut and model.add_prefix and not model.charsmap and not model.collapse
    return Cuts(words, words and not any("\n" in p[1:] for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)))


def segments(text: Column, cuts: Cuts) -> Column:
    """The segments of a space and the text; null for null and empty texts.

    A segment begins at a single space, or at line feeds with one space or none
    behind them, between other characters than white space. It is written
    without its space, unless other white space follows that. Texts in which
    white space stands alone, or a line feed has one other or a space behind it,
    are split at spaces, which is many times faster than a pattern and as right.
    """
    whole, word, head = F.concat(F.lit(" "), text), f"[^{_SPACE}]", F.length(text) > 0
    bare = lambda x: F.when(x.rlike(f"^ {word}"), F.substr(x, F.lit(2))).otherwise(x)
    if not cuts.words:
        return F.when(head, F.array(bare(whole)))
    cut = r"(?: |\n++ ?)" if cuts.lines else " "
    pattern = f"[{_SPACE}]*+{word}++(?:(?!{cut}{word})[{_SPACE}]++(?:{word}++|\\z))*+|[{_SPACE}]++\\z"
    careful = F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), bare)
    # White space that may be odd: few texts have any, and looking for it takes a tenth of the time that a pattern takes.
    some = text.rlike(r"[\t\x0b-\r\x1c-\x1f\x85\xa0]") | F.contains(text.cast("binary"), F.lit(b"\xe2\x80"))
    for x in ("  ", " \n", "\n\n" if cuts.lines else "\n", "\u1680", "\u205f", "\u3000"):
        some |= F.contains(text, F.lit(x))
    some |= F.startswith(text, F.lit(" ")) | F.startswith(text, F.lit("\n")) | F.endswith(text, F.lit(" "))
    if cuts.lines:
        # Behind a line feed that ends the text, or has another and no third behind it, each is a token of its own for both.
        odd = f"^[{_SPACE}]|[{_SPACE}](?:(?<=[{_NO_LINE}])(?:[{_SPACE}]|\\z)|(?<=\\n)(?:[{_OTHER}]|\\n(?:[{_SPACE}]|\\z)))"
        split = F.split(F.replace(text, F.lit("\n"), F.lit(" \n")), " ")
    else:
        odd, split = f"^[{_SPACE}]|[{_SPACE}](?:[{_SPACE}]|\\z)", F.split(text, " ")
    return F.when(head & some & text.rlike(odd), careful).when(head, split)


def _byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, byte_json: bytes, proto: bytes, cuts: Cuts) -> None:
        self.a = tokenizers.Tokenizer.from_str(byte_json.decode())
        self.a.encode_special_tokens = True
        alphabet = _byte_alphabet()
        self.bytes_a = {i: bytes(alphabet[c] for c in entry) for entry, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in entry)}
        self.codec, self.cut = Codec(parse(proto)), cuts.words
        kinds = {UNKNOWN: lambda p: b"\xff", CONTROL: lambda p: b"\xff", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.size_a = np.zeros(self.a.get_vocab_size(), np.int64)
        self.size_a[list(self.bytes_a)] = list(map(len, self.bytes_a.values()))
        self.bytes_b = [kinds.get(kind, lambda p: p.replace(MARK, " ").encode())(p) for p, _, kind in self.codec.model.pieces]
        self.size_b = np.array([len(x) for x in self.bytes_b], np.int64)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of the first and the second for texts that begin with the space that the second adds by itself; none if they do not spell the text."""
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        if self.cut:
            b = [e.ids for e in self.codec.pieces.encode_batch_fast([t.replace(" ", MARK) for t in texts], add_special_tokens=False)]
        else:
            b = self.codec.encode([t[1:] for t in texts])
        good = [b"".join(map(self.bytes_a.__getitem__, x)) == t.encode() == b"".join(map(self.bytes_b.__getitem__, y)) for t, x, y in zip(texts, a, b)]
        none = np.zeros(0, np.int32)
        return [(np.array(x, np.int32), np.array(y, np.int32)) if g else (none, none) for x, y, g in zip(a, b, good)]

    def encode_joined(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The same for segments between any two of which there is a cut, several hundred a call."""
        whole = "".join(texts)
        raw, ends = whole.encode(), np.cumsum([len(t.encode()) for t in texts])
        a = self.a.encode(whole, add_special_tokens=False).ids
        b = self.codec.pieces.encode([t.replace(" ", MARK) for t in texts], is_pretokenized=True, add_special_tokens=False).ids
        parts = []
        for ids, spell, size in ((a, self.bytes_a, self.size_a), (b, self.bytes_b, self.size_b)):
            ids = np.array(ids, np.int32)
            reached = np.cumsum(size[ids])
            at = np.searchsorted(reached, ends)
            if b"".join(map(spell.__getitem__, ids.tolist())) != raw or not np.array_equal(reached[at], ends):
                return self.encode(texts)  # some segment is not spelled: each for itself
            parts.append(np.split(ids, at[:-1] + 1))
        return list(zip(*parts))


_built: dict[tuple, Pair] = {}


def _coded(byte_json: bytes, proto: bytes, cuts: Cuts):
    """segment, n -> segment, n, n_bytes, n_a, id and size of the tokens of both, the first's first; no tokens if they do not spell the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        key = (hash(byte_json), hash(proto), cuts)
        pair = _built.get(key) or _built.setdefault(key, Pair(byte_json, proto, cuts))
        for batch in batches:
            for lo in range(0, len(batch), TOGETHER):
                part = batch.slice(lo, TOGETHER)
                texts = [x if x[:1].isspace() else " " + x for x in part.column("segment").to_pylist()]
                # Between two that begin with a space or a line feed, and end with none, there is a cut.
                plain = [cuts.words and len(t) < 100 and not t[-1].isspace() and (t[0] == "\n" or t[0] == " " and not t[1].isspace()) for t in texts]
                done = dict(zip((i for i, x in enumerate(plain) if x), pair.encode_joined([t for t, x in zip(texts, plain) if x]) if any(plain) else []))
                done |= zip((i for i, x in enumerate(plain) if not x), pair.encode([t for t, x in zip(texts, plain) if not x]))
                both = [x for i in range(len(texts)) for x in done[i]]
                n = np.array([len(x) for x in both], np.int64)
                ids = np.concatenate(both)
                offsets = np.concatenate([[0], np.cumsum(n[0::2] + n[1::2])]).astype(np.int32)
                first = np.repeat(np.arange(len(both)) % 2 == 0, n)
                sizes = np.where(first, pair.size_a[np.where(first, ids, 0)], pair.size_b[np.where(first, 0, ids)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (ids, sizes)]
                n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("segment"), part.column("n"), n_bytes, pa.array(n[0::2].astype(np.int32)), *lists], ["segment", "n", "n_bytes", "n_a", "ids", "sizes"])

    return run


def links(coded: DataFrame) -> DataFrame:
    """(key, segment, n, a, b, a_ends, b_ends) for each stretch between neighbouring ends of tokens, last stretch first within a segment.

    a and b are the tokens that cover the stretch, a_ends and b_ends say which
    of them end with it. One row of each segment has its string and count.
    """
    tokens = coded.select("key", "segment", "n", "n_a", "n_bytes", "ids", "sizes").repartition("key")
    tokens = tokens.select("key", "segment", "n", "n_a", "n_bytes", F.posexplode(F.arrays_zip("ids", "sizes")).alias("pos", "token"))
    total = F.sum("token.sizes").over(Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    first, once = F.col("pos") < F.col("n_a"), ["segment", "n"]
    ends = tokens.select(
        "key", *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in once], F.when(first, F.col("token.ids")).alias("a"), F.when(~first, F.col("token.ids")).alias("b"),
        F.when(first, total).otherwise(total - F.col("n_bytes")).alias("end"))
    # The outer join of both tokenizers' tokens on segment and end, as a grouping: both stand in one partition.
    met = ends.groupBy("key", "end").agg(*[F.max(c).alias(c) for c in ("a", "b", *once)])
    back = Window.partitionBy("key").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    cover = [F.last(c, ignorenulls=True).over(back).alias(c) for c in ("a", "b")]
    return met.select("key", *once, *cover, F.col("a").isNotNull().alias("a_ends"), F.col("b").isNotNull().alias("b_ends"))


def _strings(ids: np.ndarray, separators: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Numbers with a separator behind each, joined by lists."""
    text = pc.binary_join_element_wise(pc.cast(pa.array(ids), pa.string()), pa.array(separators), "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), text), "")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each segment as one row: key, segment, n, n_a, n_b, n_groups, n_links, groups (each with a semicolon behind it), pairs."""

    def finish(rows: list[np.ndarray], once: pa.RecordBatch) -> pa.RecordBatch:
        key, a, b, a_ends, b_ends = (x[::-1] for x in rows)  # ends now ascend within each segment
        both = a_ends & b_ends
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        group = np.concatenate([[0], np.cumsum(both)[:-1]])
        at_a, at_b = np.flatnonzero(a_ends), np.flatnonzero(b_ends)
        order = np.argsort(np.concatenate([2 * group[at_a], 2 * group[at_b] + 1]), kind="stable")
        ids = np.concatenate([a[at_a], b[at_b]])[order]
        separators = np.concatenate([np.where(both[at_a], "|", ","), np.where(both[at_b], ";", ",")])[order]
        counts = [np.add.reduceat(x.astype(np.int64), start) for x in (a_ends, b_ends, both, np.ones(len(key), bool))]
        offsets = np.concatenate([[0], np.cumsum(counts[0] + counts[1])])
        pairs = (a.astype(np.int64) << 32) | b
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)).astype(np.int32)), pa.array(pairs))
        once = once.take(pa.array(np.arange(len(once))[::-1]))
        return pa.RecordBatch.from_arrays([pa.array(key[start]), *once.columns, *map(pa.array, counts), _strings(ids, separators, offsets), lists], ["key", "segment", "n", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])

    held, names = None, None
    for batch in batches:
        once = batch.select(["segment", "n"]).filter(batch.column("segment").is_valid())
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "a", "b", "a_ends", "b_ends")]
        if held:
            rows, once = [np.concatenate(x) for x in zip(held, rows)], pa.Table.from_batches([names, once]).combine_chunks().to_batches(1 << 30)
            once = once[0] if once else names
        # The last segment may go on in the next batch; all before it are whole.
        whole = int(np.argmax(rows[0] == rows[0][-1])) if len(rows[0]) else 0
        n = len(np.unique(rows[0][:whole]))
        if whole:
            yield finish([x[:whole] for x in rows], once.slice(0, n))
        held, names = [x[whole:] for x in rows], once.slice(n)
    if held and len(held[0]):
        yield finish(held, names)


def _sent(table: pa.Table) -> bytes:
    """A table as compressed bytes: each executor keeps what it is sent on its disk."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _received(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _summed(known: pa.Table):
    """Rows of segments with n_best and count_sum over the pairs that are known, and the others as ``rest``."""
    data = _sent(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _received(data).sort_by("pair")
        there, counts, best = (np.append(table.column(c).to_numpy(), -1) for c in ("pair", "count", "is_best"))
        for batch in batches:
            lists = batch.column("pairs")
            flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            at = np.searchsorted(there[:-1], flat)
            found = there[at] == flat
            start = np.concatenate([[0], np.cumsum(size)])
            sums = [np.diff(np.concatenate([[0], np.cumsum(np.where(found, x[at], 0))])[start]) for x in (best, counts)]
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~found)])[start].astype(np.int32)), pa.array(flat[~found]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, sums), rest], [*batch.schema.names[:-1], "n_best", "count_sum", "rest"])

    return run


def _pack(places: np.ndarray) -> bytes:
    """Compressed, the bytes of one weight after the other: places of frequent segments are small numbers."""
    planes = np.ascontiguousarray(places, "<i4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _in_dictionary(known: pa.Table):
    """Segments as places in the dictionary, -1 for those that are not there and follow as strings."""
    data = _sent(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = pa.concat_arrays(_received(data).column("segment").chunks or [pa.array([], pa.string())])
        for batch in batches:
            lists = batch.column("segments")
            flat = lists.flatten()
            codes = pc.fill_null(pc.index_in(flat, value_set=there), -1)
            missing = np.asarray(codes) < 0
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            rare = np.concatenate([[0], np.cumsum(missing)])[offsets]
            places = codes.cast(pa.int32()).to_numpy(zero_copy_only=False)
            packed = [_pack(places[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(packed, pa.binary()),
                 pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), flat.filter(pa.array(missing)))], ["row", "doc_id", "n", "codes", "rare"])

    return run


def _assembled(known: pa.Table):
    """doc_id and the contract's columns, from places in the dictionary, and strings and sums of the segments that are not there."""
    data = _sent(known)

    def part(rows: pa.RecordBatch, strings: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
        lengths = rows.column("n").to_numpy()
        codes = np.concatenate([_unpack(x, n) for x, n in zip(rows.column("codes").to_pylist(), lengths.tolist())])
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        missing = codes < 0
        place = np.where(missing, len(strings) + np.cumsum(missing) - 1, codes)
        sums = np.stack([np.concatenate([[0], np.cumsum(np.where(missing, 0, numbers[i][np.where(missing, 0, codes)]))]) for i in range(len(_NUMBERS))])
        sums = sums[:, offsets[1:]] - sums[:, offsets[:-1]]
        sums += np.stack([pc.fill_null(rows.column(c), 0).to_numpy(zero_copy_only=False) for c in _NUMBERS])
        text = pa.concat_arrays([strings, rows.column("rare_groups").flatten().cast(pa.large_string())]).take(pa.array(place))
        ends, raw = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1], memoryview(text.buffers()[2] or b"")
        good = (sums[-1] == 0) & (lengths > 0)
        digest = [hashlib.sha256(raw[ends[i] : ends[j] - 1]).hexdigest() if g else "" for i, j, g in zip(offsets[:-1].tolist(), offsets[1:].tolist(), good.tolist())]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(np.where(good, x, 0)) for x in sums[:-1]), pa.array(digest, pa.string())], ["doc_id", *_NUMBERS[:-1], "groups_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _received(data)
        strings = pa.concat_arrays([x.cast(pa.large_string()) for x in table.column("groups").chunks] or [pa.array([], pa.large_string())])
        # A first entry for documents all of whose segments are elsewhere, if the dictionary is empty.
        numbers = [np.append(table.column(c).to_numpy(), 0) for c in _NUMBERS]
        for batch in batches:
            size = np.cumsum(batch.column("n").to_numpy())
            lo = 0
            while lo < len(batch):
                before = size[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(size, before + AT_ONCE, side="right")))
                yield part(batch.slice(lo, hi - lo), strings, numbers)
                lo = hi

    return run


def _frequent(rows: DataFrame, count: str, size: int, *columns: str) -> pa.Table:
    """The rows of the largest counts, as many powers of two of these as have no more than ``size`` rows together."""
    power = F.floor(F.log2(count))
    # Powers of two: some sixty rows.
    counts = {r["power"]: r["count"] for r in rows.groupBy(power.alias("power")).count().where("power is not null").collect()}
    least, total = 64, 0
    for k in sorted(counts, reverse=True):
        total += counts[k]
        if total > size:
            break
        least = k
    return rows.where(power >= least).select(*columns, F.col(count).alias("__n")).toArrow().sort_by([("__n", "descending")]).drop(["__n"])


def _without_bad_texts(texts: DataFrame, coded: DataFrame, cuts: Cuts) -> DataFrame:
    """coded with counts of segments in texts that have tokens; a text without has a segment without."""
    bad = coded.where(F.size("ids") == 0).select("segment")
    if bad.isEmpty():
        return coded
    digest = F.sha2("text", 256).alias("digest")
    held = texts.select(digest, F.explode(F.array_distinct(segments(F.col("text"), cuts))).alias("segment"))
    marked = materialize(held.join(bad, "segment").select("digest").distinct(), "alignment")
    lost = texts.select(digest, "text").join(marked, "digest", "left_semi").select(F.explode(segments(F.col("text"), cuts)).alias("segment"))
    lost = materialize(lost.groupBy("segment").agg(F.count("*").alias("lost")), "alignment")
    return materialize(coded.join(lost, "segment", "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).drop("lost"), "alignment")


def _words(coded: DataFrame, pairs_known: int) -> DataFrame:
    """segment, n, groups and the numbers of every different segment."""
    aligned = "key long, segment string, n long, n_a long, n_b long, n_groups long, n_links long, groups string"
    rows = materialize(links(coded.where(F.size("ids") > 0)).mapInArrow(_gathered, f"{aligned}, pairs array<bigint>"), "alignment")
    counts = materialize(rows.select("n", F.explode("pairs").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count")), "alignment")
    of_b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = counts.groupBy(of_b.alias("b")).agg(F.max("count").alias("best"))
    counts = counts.withColumn("b", of_b).join(best, "b").select("pair", "count", (F.col("count") == F.col("best")).cast("long").alias("is_best"))
    counts = materialize(counts, "alignment")
    known = _frequent(counts, "count", pairs_known, "pair", "count", "is_best")
    out = rows.mapInArrow(_summed(known), f"{aligned}, n_best long, count_sum long, rest array<bigint>")
    if known.num_rows < counts.count():
        out = materialize(out, "alignment")
        rest = out.select("key", F.explode("rest").alias("pair")).join(counts, "pair").groupBy("key").agg(F.sum("is_best").alias("more_best"), F.sum("count").alias("more_count"))
        out = out.join(rest, "key", "left").withColumns({c: F.col(c) + F.coalesce(more, F.lit(0)) for c, more in (("n_best", "more_best"), ("count_sum", "more_count"))})
    columns = ["segment", "n", "groups", *_NUMBERS]
    bad = coded.where(F.size("ids") == 0).select("segment", "n", F.lit("").alias("groups"), *[F.lit(int(c == "bad")).cast("long").alias(c) for c in _NUMBERS])
    out = materialize(out.withColumn("bad", F.lit(0).cast("long")).select(*columns).unionByName(bad), "alignment")
    discard(rows)
    return out


def align(documents: DataFrame, byte_path: str = BYTE_PATH, piece_path: str = MODEL_PATH, dictionary: int = DICTIONARY, pairs_known: int = PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document.

    The driver reads both files and sends them along; executors need no path.
    """
    with open(byte_path, "rb") as f, open(piece_path, "rb") as g:
        byte_json, proto = f.read(), g.read()
    cuts = safe_cuts(byte_json, proto)
    texts = documents.select("doc_id", "text")
    counted = texts.select(F.explode(segments(F.col("text"), cuts)).alias("segment")).groupBy("segment").agg(F.count("*").alias("n"))
    coded = counted.mapInArrow(_coded(byte_json, proto, cuts), "segment string, n long, n_bytes long, n_a int, ids array<int>, sizes array<int>")
    written = materialize(coded.withColumn("key", F.monotonically_increasing_id()), "alignment")
    words = _words(_without_bad_texts(texts, written, cuts), pairs_known)
    discard(written)

    known = _frequent(words.where(F.length("segment") <= LONGEST), "n", dictionary, "segment", "groups", *_NUMBERS)
    kind = documents.schema["doc_id"].dataType.simpleString()
    listed = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", segments(F.col("text"), cuts).alias("segments"))
    listed = materialize(listed.mapInArrow(_in_dictionary(known.select(["segment"])), f"row long, doc_id {kind}, n long, codes binary, rare array<string>"), "alignment")
    # Two counts of a segment, or of a text, go in one number, which halves what is shuffled; no text has 2**31 tokens.
    two = [(F.shiftleft(x, 32) + F.col(y)).alias(f"{x}_{y}") for x, y in _TWO]
    packed = [f"{x}_{y}" for x, y in _TWO]
    rare = listed.select("row", F.posexplode("rare").alias("pos", "segment")).join(words.select("segment", "groups", "count_sum", *two), "segment")
    found = F.sort_array(F.collect_list(F.struct("pos", "groups")))
    rare = rare.groupBy("row").agg(F.transform(found, lambda x: x["groups"]).alias("rare_groups"), F.sum("count_sum").alias("count_sum"), *[F.sum(c).alias(c) for c in packed])
    apart = [c for x, y in _TWO for c in (F.shiftright(f"{x}_{y}", 32).alias(x), F.col(f"{x}_{y}").bitwiseAND(0xFFFFFFFF).alias(y))]
    out = listed.select("row", "doc_id", "n", "codes").join(rare, "row", "left").select("doc_id", "n", "codes", "rare_groups", "count_sum", *apart)
    return out.mapInArrow(_assembled(known.drop(["segment"])), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _NUMBERS[:-1]) + ", groups_sha256 string")
