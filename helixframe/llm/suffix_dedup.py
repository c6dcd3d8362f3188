"""Duplicate byte strings by suffix arrays of shards.

A byte goes if a string of 100 bytes that covers it also starts earlier: in a
document with a smaller id, or further ahead in the same one.

1. Strings are anchored at their smallest 24-byte gram; only runs of strings
   whose anchor occurs twice or more can repeat. Equal runs collapse to their
   earliest, by 128-bit hashes of their bytes; the later ones repeat as a whole.
2. The different runs of an anchor are dealt to shards. Of each shard a suffix
   array is made by Larsson-Sadakane refinement in numpy: ranks double in depth,
   and only groups that are not yet told apart are sorted again. Kasai's loop
   finds the common prefixes, up to 100 bytes, in lanes: many stretches of the
   text go through it side by side, one position each at a time.
3. An anchor with many different runs is dealt to several shards. Their sorted
   strings are merged by binary search of one shard's strings in the others'.

Whatever is grouped by a key is written before it is joined, so that every join
stands on plain shuffles, whose hot keys adaptive execution splits.

Defined results: null and empty texts have no bytes; texts of fewer than 100
bytes repeat nothing; documents without an id come after all others, and rows
that repeat an id follow by the hashes of their texts; rows that repeat id and
text are one document, each with its result; ids may be of any type that has an
order; an empty table gives none; columns of the input named n_bytes, n_removed,
n_spans or kept give way to the results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.substring_dedup import keyed
from helixframe.llm.textnum import BASES, byte_units, chunks, covered, prefix, runs, segments
from helixframe.session import discard, materialize

LENGTH = 100
GRAM = 24
#: Different runs of one anchor in a shard; more are dealt to several.
RUNS = 1024
#: Bytes of a shard's suffix array; whole anchors are added until it is reached.
SHARD_BYTES = 1 << 20
#: Positions that one lane of Kasai's loop goes through.
LANE = 256
_TABLES = [byte_units(np.arange(256)), byte_units((np.arange(256) * 167 + 13) % 256)[::-1].copy()]


def _owner(lo: int, hi: int, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The text of each byte; the bytes between texts belong to none."""
    owner = np.repeat(np.arange(hi - lo), np.diff(np.concatenate([starts, [len(data)]]))) if hi > lo else np.zeros(0, np.int64)
    between = ends[:-1]
    owner[between] = -1 - np.arange(len(between))
    return owner


def _anchors(length: int, gram: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, starts, ends in chunks(b.column("text")):
                sums = prefix(_TABLES[1][data], BASES[1])
                at, n, anchor, loops = segments(sums, _owner(lo, hi, data, starts, ends), length, gram)
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(loops)], ["anchor", "loops"])
                    continue
                of = np.searchsorted(starts, at, side="right") - 1
                row = pa.array(lo + of)
                a, c = (runs(x, at, at + n + length - 1, base) for x, base in zip((prefix(_TABLES[0][data], BASES[0]), sums), BASES))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(x).take(row) for x in ("k", "h", "g")), *(pa.array(x.view(np.int64)) for x in (anchor, a, c)), pa.array((at - starts[of]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(loops)],
                    ["k", "h", "g", "anchor", "a", "b", "start", "n", "loops"])

    return run


def _removed(raw: bytes, starts, ends, keep: bool):
    """(n_bytes, n_removed, n_spans, kept) once the bytes within the spans are gone."""
    gone = spans = 0
    if len(starts):
        mask = covered(len(raw), np.asarray(starts), np.asarray(ends))
        gone, spans = int(mask.sum()), int(mask[0]) + int((np.diff(mask.astype(np.int8)) == 1).sum())
        raw = np.frombuffer(raw, np.uint8)[~mask].tobytes()
    return len(raw) + gone, gone, spans, raw if keep else hashlib.sha256(raw).hexdigest().encode()


_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_RUNS = pa.list_(pa.struct([("anchor", pa.int64()), ("shards", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("bytes", pa.binary())]))


def _structs(kind: pa.DataType, cuts: list[int], columns: list[list]) -> pa.Array:
    """Lists of structs, cut from columns."""
    fields = list(kind.value_type)
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values, type=kind)


def _factors(length: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                lists = part.column("found")
                cuts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).tolist()
                start, n, dup, anchor, shards = (x.to_pylist() for x in pc.list_flatten(lists).flatten())
                rows, spans, parts = [], [[], []], [[], [], [], [], []]
                span_cuts, part_cuts = [0], [0]
                for i, text in enumerate(part.column("text").cast("binary").to_pylist()):
                    raw, of = text or b"", range(cuts[i], cuts[i + 1])
                    gone = [j for j in of if dup[j]]
                    if len(gone) < len(of):
                        rows.append((True, len(raw), None, None, raw))
                        spans[0] += [start[j] for j in gone]
                        spans[1] += [start[j] + n[j] + length - 1 for j in gone]
                        for j in of:
                            if not dup[j]:
                                for kept, x in zip(parts, (anchor[j], shards[j], start[j], n[j], raw[start[j] : start[j] + n[j] + length - 1])):
                                    kept.append(x)
                    else:
                        rows.append((False, *_removed(raw, [start[j] for j in gone], [start[j] + n[j] + length - 1 for j in gone], keep)))
                    span_cuts.append(len(spans[0]))
                    part_cuts.append(len(parts[0]))
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("rest", "k", "h", "g")), *(pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)), _structs(_SPANS, span_cuts, spans), _structs(_RUNS, part_cuts, parts)],
                    ["rest", "k", "h", "g", "pending", "n_bytes", "n_removed", "n_spans", "kept", "spans", "runs"])

    return run


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first depth symbols at least (a power of two), or of all that tell them apart.

    Symbols are non-negative; what lies behind the end is smaller than all of them.
    """
    n = len(symbols)
    # As many first symbols as go into a word, a power of two, are sorted at once; zero stands behind the end.
    bits, h = int(symbols.max() + 1).bit_length() if n else 1, 1
    first = np.concatenate([symbols + 1, [0]]).astype(np.int64)
    while 2 * h * bits < 64 and h < depth:
        first, h = (first << (h * bits)) | first[np.minimum(np.arange(n + 1) + h, n)], 2 * h
    first = first[:n]
    sa = np.argsort(first, kind="stable")
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1

    def named(keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """First slot of the run of equal keys that each of the slots belongs to."""
        new = np.ones(len(slots), dtype=bool)
        new[1:] = keys[1:] != keys[:-1]
        return slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]

    slots = np.arange(n)
    group = named(first[sa], slots)
    rank[sa] = group
    while h < depth:
        # Slots of groups with two or more suffixes.
        alone = np.ones(len(slots), dtype=bool)
        alone[1:] &= group[1:] != group[:-1]
        alone[:-1] &= group[:-1] != group[1:]
        slots, group = slots[~alone], group[~alone]
        if not len(slots):
            break
        at = sa[slots]
        key = group * (n + 1) + rank[np.minimum(at + h, n)] + 1
        order = np.argsort(key, kind="stable")
        sa[slots] = at[order]
        group = named(key[order], slots)
        rank[sa[slots]] = group
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, room: np.ndarray, most: int, lane: int = LANE) -> np.ndarray:
    """Bytes, up to most, that each suffix shares with the one before it in the array; Kasai's loop in lanes.

    A suffix that starts at p has room[p] bytes. Each lane goes through
    neighbouring positions and keeps all but one of the bytes that it has matched
    when it moves on, so that no byte is compared twice; but not if the array,
    which is sorted to a bounded depth, has the two next ones the other way round.
    """
    n = len(sa)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    loads = np.ndarray((n + 1,), dtype="<u8", buffer=padded, strides=(1,))
    ahead = np.full(n, -1)  # the suffix before each suffix in the array
    ahead[sa[1:]] = sa[:-1]
    rank = np.empty(n + 1, dtype=np.int64)
    rank[sa], rank[n] = np.arange(n), -1
    out = np.zeros(n, dtype=np.int64)
    first = np.arange(0, n, lane)
    have = np.zeros(len(first), dtype=np.int64)
    for step in range(min(lane, n)):
        p = first + step
        if p[-1] >= n:
            first, have, p = first[:-1], have[:-1], p[:-1]
        q = ahead[p]
        limit = np.where(q >= 0, np.minimum(np.minimum(room[p], room[q]), most), 0)
        got = np.minimum(have, limit)
        live = np.flatnonzero(got < limit)
        while len(live):
            x = loads[p[live] + got[live]] ^ loads[q[live] + got[live]]
            # Whole bytes that agree: the zero bits below the lowest set one.
            same = np.where(x == 0, 8, np.bitwise_count((x & -x) - np.uint64(1)) >> 3)
            got[live] = np.minimum(got[live] + same, limit[live])
            live = live[(same == 8) & (got[live] < limit[live])]
        out[p] = got
        have = np.where(rank[q + 1] < rank[p + 1], np.maximum(got - 1, 0), 0)
    return out[sa]


def repeated(parts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bases, starts, leaders): where each part begins in their concatenation, the positions where a
    string of length bytes starts within a part, in the array's order, and the first of these with the same string."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    bases = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    symbols = data.astype(np.int64) + len(parts)
    symbols[bases + sizes] = np.arange(len(parts))  # terminators, all different
    sa = suffix_array(symbols, 1 << (length - 1).bit_length())
    room = np.repeat(bases + sizes, sizes + 1) - np.arange(len(symbols))
    shared = common_prefixes(data, sa, room, length)
    # A run of suffixes whose neighbours share the length is one string; those of less room stand before it.
    string = np.cumsum(shared < length)
    fits = room[sa] >= length
    order, string = sa[fits], string[fits]
    if not len(order):
        return bases, order, order
    new = np.concatenate([[True], string[1:] != string[:-1]])
    begin = np.flatnonzero(new)
    low = np.minimum.reduceat(order, begin)
    return bases, order, np.repeat(low, np.diff(np.concatenate([begin, [len(order)]])))


def _place(k, h: int, g: int, start: int) -> tuple:
    """Order of documents and, within one, of starts."""
    return (k is None, k, h, g, start)


def _spans_of(rows: list[tuple], bases: np.ndarray, again: np.ndarray, length: int) -> list[tuple]:
    """(k, h, g, s, e) of the runs of strings that start at the sorted positions."""
    if not len(again):
        return []
    mine = np.searchsorted(bases, again, side="right") - 1
    cuts = np.flatnonzero((np.diff(again) != 1) | (np.diff(mine) != 0)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(again)]]) - 1
    out = []
    for i, j in zip(first.tolist(), last.tolist()):
        *_, k, h, g, start, _ = rows[mine[i]]
        shift = start - int(bases[mine[i]])
        out.append((k, h, g, int(again[i]) + shift, int(again[j]) + shift + length))
    return out


_FOUND = ["k", "h", "g", "s", "e", "anchor", "shard", "shards", "string"]


def _emit(kind: pa.DataType, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [kind, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for i in range(0, len(rows), 8192):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 8192]), kinds)], _FOUND)


def _shards(length: int):
    """Spans of strings that repeat within a shard, and the leaders of anchors that other shards hold too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
            # In the documents' order, so that positions follow it. Rows that repeat id and text come once.
            rows = list({r[4:7]: r for r in sorted(rows, key=lambda r: _place(*r[3:7]))}.values())
            bases, order, leaders = repeated([r[7] for r in rows], length)
            out = [(*x, None, None, None, None) for x in _spans_of(rows, bases, np.sort(order[order != leaders]), length)]
            if any(r[1] > 1 for r in rows):
                first = order[order == leaders]
                for p, o in zip(first.tolist(), (np.searchsorted(bases, first, side="right") - 1).tolist()):
                    shard, shards, anchor, k, h, g, start, raw = rows[o]
                    if shards > 1:
                        at = p - int(bases[o])
                        out.append((k, h, g, at + start, at + start + length, anchor, shard, shards, raw[at : at + length]))
            yield from _emit(kind, out)

        held, size, last, kind = [], 0, None, None
        for b in batches:
            kind = b.schema.field("k").type
            for row in zip(*(b.column(c).to_pylist() for c in ("shard", "shards", "anchor", "k", "h", "g", "start", "bytes"))):
                if row[0] != last and size >= SHARD_BYTES:
                    yield from solved(held, kind)
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[7]) + 1, row[0]
        if held:
            yield from solved(held, kind)

    return run


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def merge(shards: list[list[tuple[bytes, tuple]]]) -> list[tuple]:
    """Places whose string has an earlier place in another shard.

    A shard is a sorted list of different strings with their places. The strings
    known so far are a sorted array, in which the next shard's are found by
    binary search.
    """
    known, owners, gone = _objects([]), _objects([]), []
    for shard in shards:
        strings = _objects([s for s, _ in shard])
        at = np.searchsorted(known, strings)
        new = []
        for i, (slot, (string, place)) in enumerate(zip(at.tolist(), shard)):
            if slot < len(known) and known[slot] == string:
                gone.append(max(owners[slot], place))
                owners[slot] = min(owners[slot], place)
            else:
                new.append(i)
        places = _objects([shard[i][1] for i in new])
        known, owners = np.insert(known, at[new], strings[new]), np.insert(owners, at[new], places)
    return gone


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the shards of each group; rows come sorted by anchor, bucket, shard and string."""
    last, shards, kind = None, {}, pa.int64()

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(*p[1:4], p[4], p[5]) for p in merge(list(shards.values()))]
        if rows:
            kinds = [kind, pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["k", "h", "g", "s", "e"])

    for b in batches:
        kind = b.schema.field("k").type
        for anchor, bucket, shard, k, h, g, s, e, string in zip(*(b.column(c).to_pylist() for c in ("anchor", "bucket", "shard", "k", "h", "g", "s", "e", "string"))):
            if (anchor, bucket) != last:
                yield from out()
                last, shards = (anchor, bucket), {}
            shards.setdefault(shard, []).append((string, (*_place(k, h, g, s), e)))
    yield from out()


def _finished(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, spans, more in zip(b.column("kept").to_pylist(), b.column("spans").to_pylist(), b.column("more").to_pylist()):
                both = [*spans, *(more or ())]
                rows.append(_removed(raw, [x["s"] for x in both], [x["e"] for x in both], keep))
            cols = zip(*rows) if rows else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([b.column("rest"), *(pa.array(c, kind) for c, kind in zip(cols, kinds))], ["rest", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """The columns of documents but text, with n_bytes, n_removed, n_spans and kept.

    kept is the remaining bytes (they may cut a character), or the SHA-256 of
    them in lower-case hex where keep_text is False.
    """
    docs = keyed(documents, ("n_bytes", "n_removed", "n_spans", "kept"))
    key, rest = T.StructField("k", docs.schema["k"].dataType), T.StructField("rest", docs.schema["rest"].dataType)

    def schema(*first: T.StructField, then: str) -> T.StructType:
        return T.StructType([*first, *T.StructType.fromDDL(then)])

    # Anchors are counted first, so that only those rows that can repeat are ever kept.
    anchors = docs.select("text").mapInArrow(_anchors(length, gram, False), "anchor long, loops boolean")
    anchors = materialize(anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.bool_or("loops").alias("loops")).where("n > 1 or loops").select("anchor"), "anchors")
    blocks = docs.select("k", "h", "g", "text").mapInArrow(_anchors(length, gram, True), schema(key, then="h long, g long, anchor long, a long, b long, start int, n int, loops boolean"))
    near = materialize(blocks.join(anchors, "anchor"), "near")
    discard(anchors)
    me = F.struct(F.col("k").isNull(), "k", "h", "g", "start")
    index = materialize(near.groupBy("anchor", "a", "b").agg(F.min(me).alias("first")), "index")
    several = materialize(index.groupBy("anchor").agg(F.count("*").alias("contents")).where("contents > 1"), "several")
    found = near.join(index.join(several, "anchor", "left"), ["anchor", "a", "b"]).withColumn("dup", me > F.col("first"))
    shards = F.ceil(F.coalesce("contents", F.lit(1)) / RUNS).cast("int")
    found = found.where("dup or contents > 1 or loops").select("h", "g", F.struct("start", "n", "dup", F.when(~F.col("dup"), F.col("anchor")).alias("anchor"), shards.alias("shards")).alias("run"))
    found = materialize(found.groupBy("h", "g").agg(F.collect_set("run").alias("found")), "found")
    discard(near, index, several)
    held = "array<struct<anchor:bigint,shards:int,start:int,n:int,bytes:binary>>"
    parsed = schema(rest, key, then=f"h long, g long, pending boolean, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<s:int,e:int>>, runs {held}")
    parsed = materialize(docs.join(found, ["h", "g"], "left").select("rest", "k", "h", "g", "text", "found").mapInArrow(_factors(length, keep_text), parsed), "parsed")
    discard(found)
    pending = parsed.where("pending")
    dealt = pending.select("k", "h", "g", F.explode("runs").alias("r")).select("k", "h", "g", "r.*")
    dealt = dealt.withColumn("shard", F.xxhash64("anchor", F.when(F.col("shards") > 1, F.pmod(F.xxhash64("h", "g", "start"), F.col("shards")))))
    dealt = dealt.repartition("shard").sortWithinPartitions("shard")
    solved = materialize(dealt.mapInArrow(_shards(length), schema(key, then="h long, g long, s int, e int, anchor long, shard long, shards int, string binary")), "shards")
    leaders = solved.where("string is not null").withColumn("bucket", F.pmod(F.xxhash64("string"), 16 * F.col("shards")))
    leaders = leaders.repartition("anchor", "bucket").sortWithinPartitions("anchor", "bucket", "shard", "string")
    spans = solved.where("string is null").select("k", "h", "g", "s", "e").unionByName(leaders.mapInArrow(_merged, schema(key, then="h long, g long, s int, e int")))
    more = materialize(spans.groupBy("h", "g").agg(F.collect_list(F.struct("s", "e")).alias("more")), "spans")
    discard(solved)
    checked = pending.join(more, ["h", "g"], "left").select("rest", "kept", "spans", "more")
    checked = checked.mapInArrow(_finished(keep_text), schema(rest, then="n_bytes long, n_removed long, n_spans long, kept binary"))
    return parsed.where("not pending").select("rest", "n_bytes", "n_removed", "n_spans", "kept").unionByName(checked).select("rest.*", "n_bytes", "n_removed", "n_spans", "kept")


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    out = remove_repeats(documents.select("doc_id", "text"), keep_text=False)
    return out.withColumn("kept_sha256", F.decode("kept", "UTF-8")).drop("kept")
