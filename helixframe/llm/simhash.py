"""SimHash near-duplicates: 64-bit fingerprints linked at 3 or fewer bits.

Fingerprints: A-Z lower-cased, words of non-space bytes, shingles of three
words, XXH64 with seed 42, majority of each bit. Equal fingerprints collapse to
one row first. Distinct ones are compared exactly in tiles with numpy.

A tile holds fingerprints that agree on one of four 16-bit blocks (two that
differ in at most 3 bits agree on at least one) and whose numbers of one bits
fall in one class of RADIUS + 1 neighbouring counts. Tile pairs of classes that
lie apart differ beyond the radius and are never formed: a class meets itself
and the next class only. Within a tile, rows go through numpy in blocks of
bounded size.

Defined results: null and empty texts have fingerprint zero and are linked like
any others; repeated ids keep their rows; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graph import connected_components
from helixframe.session import materialize

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Rows of a tile compared with one another at once.
BLOCK = 2048


def fingerprint(text: str | None, n: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    counts, total = np.zeros(64, dtype=np.int64), len(words) - n + 1
    stops = ends[n - 1 :].tolist()
    for at in range(0, total, 1 << 16):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > total).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t.as_py()) for t in batch.column("text")], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed 64-bit number."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {kind}, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n, by repeated minima over the links."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _tile_links(fp: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one tile, as stars: every linked fingerprint with its smallest.

    own marks the tile's class; the others belong to the next class, whose links
    among themselves are found in their own tile.
    """
    order = np.argsort(fp, kind="stable")
    fp, own = fp[order], own[order]
    found = []
    mine = np.flatnonzero(own)
    for i in range(0, len(mine), BLOCK):
        rows = mine[i : i + BLOCK]
        for j in range(0, len(fp), BLOCK):
            near = np.bitwise_count(fp[rows][:, None] ^ fp[j : j + BLOCK][None, :]) <= radius
            x, y = np.nonzero(near)
            x, y = rows[x], y + j
            keep = x != y
            # Stars within the block keep what is held in memory linear in the tile.
            r = _roots(len(fp), x[keep], y[keep]) if keep.any() else None
            if r is not None:
                moved = np.flatnonzero(r != np.arange(len(fp)))
                found.append((moved, r[moved]))
    if not found:
        return fp[:0], fp[:0]
    a, b = (np.concatenate(z) for z in zip(*found))
    r = _roots(len(fp), a, b)
    moved = np.flatnonzero(r != np.arange(len(fp)))
    return fp[moved], fp[r[moved]]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by tile; a tile that the batches cut is carried on.
        rest = None

        def linked(t: pa.Table) -> pa.RecordBatch:
            tile = t["tile"].to_numpy()
            fp, own = t["fp"].to_numpy().view(np.uint64), t["own"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(tile)) + 1
            sizes = np.diff(np.concatenate([[0], cuts, [len(tile)]]))
            out = []
            # Small tiles at once: compare each row with the d-th after it, for d = 1, 2, ...
            small = np.repeat(sizes <= 32, sizes)
            st, sf, so = tile[small], fp[small], own[small]
            d, alive = 1, True
            while alive and d < len(st):
                same = st[:-d] == st[d:]
                alive = bool(same.any())
                hit = same & (so[:-d] | so[d:]) & (np.bitwise_count(sf[:-d] ^ sf[d:]) <= radius)
                out.append((sf[:-d][hit], sf[d:][hit]))
                d += 1
            at = np.concatenate([[0], cuts])
            for k in np.flatnonzero(sizes > 32):
                s = slice(at[k], at[k] + sizes[k])
                out.append(_tile_links(fp[s], own[s], radius))
            u = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.uint64)
            v = np.concatenate([y for _, y in out]) if out else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            tile = t["tile"].to_numpy()
            cut = int(np.searchsorted(tile, tile[-1], side="left"))
            rest = t.slice(cut)
            if cut:
                yield linked(t.slice(0, cut).combine_chunks())
        if rest is not None:
            yield linked(rest.combine_chunks())

    return run


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints within the radius.

    Links are stars per tile, not all pairs: linked fingerprints stay connected.
    """
    blocks = radius + 1
    width = 64 // blocks
    grouped = fps.select("fp").withColumn("class", F.floor(F.bit_count("fp") / (radius + 1)).cast("long"))
    # A row is in its own class's tile and, as the next class, in that of the class below.
    place = [
        F.struct(F.xxhash64(F.lit(b), F.shiftrightunsigned(F.shiftleft("fp", 64 - width * (b + 1)), 64 - width), F.col("class") - down).alias("tile"), F.lit(not down).alias("own"))
        for b in range(blocks)
        for down in (0, 1)
    ]
    tiles = grouped.select("fp", F.explode(F.array(*place)).alias("p")).select("p.tile", "fp", "p.own")
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_links(radius), "u long, v long").distinct()


def near_duplicates(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint and component_id (smallest doc_id reachable)."""
    docs = materialize(fingerprints(documents), "simhash")
    distinct = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    comp = connected_components(links(distinct, radius))
    # A component of fingerprints is named by its smallest document.
    named = distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "first")
    low = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = named.join(low, "component").select("fp", "component_id")
    return docs.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
