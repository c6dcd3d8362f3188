"""Near copies: SimHash tiles first, then whatever they cannot reach, all by exact likeness.

Shingles: A-Z lower-cased, words without ASCII white space, 64-bit hashes of
five words; fewer words are one shingle. Two documents are near copies if the
Jaccard likeness of their shingle sets is 0.8 or more. Equal sets collapse to
one node first.

Round one links SimHash fingerprints of the shingles at 3 or fewer bits, in the
tiles of `simhash`, and keeps the links whose sets are alike. At likeness 0.8 two
fingerprints differ in some ten of 64 bits, and a radius that reached them would
compare all with all, so 3 bits find the closest copies only. Rounds two and three
find the others by prefix filtering, which loses no pair: under one order of all
shingles, two sets of likeness 0.8 share one of the first n - ceil(0.8 n) + 1
shingles of each. Any order does, so shingles that a sample shows to be common
come last. Lengths and the places of the shared shingle bound what two sets can
share before they become a candidate. Parities of buckets of shingles bound the
difference of two sets from below, which drops most candidates and no alike pair:
first those of 1,024 buckets, or more for longer sets, then those of four times as
many as a set has shingles. The others are verified by their sets.

Round two has each set meet the smallest of those under a shared shingle (a star),
pair by pair. Round three makes no pairs outside a task: under each shingle, in
blocks of bounded size, the sets of different components that parities let be alike
are linked to the smallest that they reach. What these links connect is a cluster;
any two alike sets that are not connected by then are in one. The sets of a cluster
meet in tiles of bounded size, where those not yet connected are compared exactly,
and a tile gives one link for each two components that it joins. So rows stay in
proportion to the sets, however many are alike or nearly so. Components are those
of the graph of all verified links.

Defined results: null, empty and blank texts have no shingle and are copies of
one another; one row of each component stays, of the smallest id (rows without
an id last), then of the smallest hash of the text; of rows equal in both one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import simhash
from helixframe.llm.decontaminate import BROADCAST_ROWS, _sized
from helixframe.llm.simhash import _roots
from helixframe.llm.textnum import BASES, chunks, prefix, runs, windows, word_hashes, word_spans
from helixframe.operators.graph import connected_components
from helixframe.session import discard, materialize

SHINGLE = 5
#: Likeness as a fraction, so that bounds are whole numbers.
NUM, DEN = 4, 5
#: One text of SAMPLE shows which shingles are common: COMMON times or more in the sample, the first MOST of them.
SAMPLE, COMMON, MOST = 16, 8, 20_000
#: Buckets whose parities are kept of each set: so many at least, and in a second row LOAD for each shingle.
BUCKETS = 1024
LOAD = 4
#: Buckets for each shingle in the first row: with fewer than four ninths, sets that share nothing could pass for alike.
THIN = 5 / 8
#: Sets under one shingle compared with one another at once; more than LARGE are compared group by group.
BLOCK, LARGE = 2048, 64
#: Sets and bytes of sets in a side of a tile; a larger cluster has more tiles.
TILE, TILE_BYTES = 1024, 16 << 20


def _shingles(texts) -> Iterator[np.ndarray]:
    """The shingle hashes of each text, repeats included."""
    for _, _, data, starts, ends in chunks(texts, lower=True):
        s, e = word_spans(data)
        sums = prefix(word_hashes(data, s, e), BASES[1])
        grams = windows(sums, SHINGLE, BASES[1])
        first, last = np.searchsorted(s, starts), np.searchsorted(s, ends)
        for a, z in zip(first.tolist(), last.tolist()):
            if z - a >= SHINGLE:
                yield grams[a : z - SHINGLE + 1]
            else:
                yield runs(sums, np.array([a]), np.array([z]), BASES[1]) if z > a else grams[:0]


def _shingle_sets(texts) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    return map(np.unique, _shingles(texts))


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The bits set in more than half of the hashes, as eight bytes."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32), pa.array(values))


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.concatenate([np.zeros(0, np.uint64), *_shingle_sets(b.column("text"))])
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["hash"])


def _signed(common: np.ndarray):
    """(row, sig, n, fp, head, parity, wide) of each text; common is ordered, the most common last."""
    by_hash = np.argsort(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common[by_hash]
        for b in batches:
            sigs, sizes, prints, heads, parity, wide = [], [], [], [], [], []
            for every in _shingles(b.column("text")):
                x = np.unique(every)
                sigs.append(xxhash.xxh64_intdigest(x.tobytes()))
                sizes.append(len(x))
                prints.append(_fingerprint(every))
                buckets = max(BUCKETS, 1 << (LOAD * len(x) - 1).bit_length()) if len(x) else BUCKETS
                odd = (np.bincount((x & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets) & 1).astype(np.uint8)
                wide.append(np.packbits(odd).tobytes())
                thin = max(BUCKETS, 1 << int(THIN * len(x)).bit_length())
                parity.append(np.packbits(np.bitwise_xor.reduce(odd.reshape(-1, thin), axis=0)).tobytes())
                if len(known) and len(x):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    late = np.where(known[at] == x, by_hash[at] + 1, 0)
                    x = x[np.argsort(late, kind="stable")]
                heads.append(x[: len(x) - (NUM * len(x) + DEN - 1) // DEN + 1])
            sig = pa.array(np.array(sigs, dtype=np.uint64).view(np.int64))
            fp = pa.array(np.concatenate([np.zeros(0, np.uint8), *prints]).view(np.int64))
            columns = [b.column("file"), b.column("at"), sig, pa.array(sizes, pa.int32()), fp, _lists(heads), pa.array(parity, pa.binary()), pa.array(wide, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["file", "at", "sig", "n", "fp", "head", "parity", "wide"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("sig"), _lists(list(_shingle_sets(b.column("text"))))], ["sig", "shingles"])


def _possible(na, nb, i, j):
    """Whether sets of na and nb shingles that share their i-th and j-th can be alike."""
    shared = np.minimum(i, j) + 1 + np.minimum(na - i, nb - j) - 1
    return (NUM + DEN) * shared >= NUM * (na + nb)


def _by_group(made):
    """made(rows of whole groups) of rows that come sorted by hash; a group that the batches cut is carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("hash").to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                yield from made(pa.Table.from_batches([*rest, b.slice(0, cut)]).combine_chunks())
                rest = [b.slice(cut)]
            elif rest and rest[-1].column("hash")[-1].as_py() != key[0]:
                yield from made(pa.Table.from_batches(rest).combine_chunks())
                rest = [b]
            else:
                rest.append(b)
        if rest:
            yield from made(pa.Table.from_batches(rest).combine_chunks())

    return run


def _sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each group of equal keys begins, how many rows it has)."""
    begin = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    return begin, np.diff(np.concatenate([begin, [len(key)]]))


def _meeting(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows that are not alone under their shingle."""
    _, sizes = _sizes(t["hash"].to_numpy())
    yield from t.filter(pa.array(np.repeat(sizes, sizes) > 1)).to_batches()


def _stars(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of each set with the smallest under the same shingle."""
    key, sig, n, at, comp = _columns(t)
    begin, sizes = _sizes(key)
    x, y = np.repeat(begin, sizes), np.arange(len(key))
    keep = (comp[x] != comp[y]) & _possible(n[x], n[y], at[x], at[y])
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(sig[x[keep]]), pa.array(sig[y[keep]])], ["u", "v"])


def _columns(t: pa.Table) -> list[np.ndarray]:
    """hash, sig, n, at and component, ordered by the first two."""
    key, sig, n, at, comp = (t[c].to_numpy() for c in ("hash", "sig", "n", "at", "component"))
    order = np.lexsort((sig, key))
    return [key[order], sig[order], n[order].astype(np.int64), at[order].astype(np.int64), comp[order]]


def _small(key: np.ndarray, n: np.ndarray, at: np.ndarray, comp: np.ndarray, few: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that can be alike of the groups in few, whose rows are numbered: each row with the d-th after it, for d = 1, 2, ..."""
    for d in range(1, LARGE):
        x = few[:-d][key[few[:-d]] == key[few[d:]]] if d < len(few) else few[:0]
        if not len(x):
            return
        x = x[(comp[x] != comp[x + d]) & _possible(n[x], n[x + d], at[x], at[x + d])]
        yield x, x + d


def _open(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows under whose shingle there are sets of other components; of few sets, those that can be alike to one of them."""
    key, sig, n, at, comp = _columns(t)
    begin, sizes = _sizes(key)
    size = np.repeat(sizes, sizes)
    keep = np.repeat(np.minimum.reduceat(comp, begin) != np.maximum.reduceat(comp, begin), sizes)
    few = np.flatnonzero(keep & (size <= LARGE))
    keep[few] = False
    for x, y in _small(key, n, at, comp, few):
        keep[x] = keep[y] = True
    if keep.any():
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, sig, n, at, comp)], ["hash", "sig", "n", "at", "component"])


def _reach(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Each set with the smallest that it reaches, under one shingle, by pairs of different components that can be alike."""
    key, sig, n, at, comp = _columns(t)
    odd = t["parity"].to_numpy()[np.lexsort((t["sig"].to_numpy(), t["hash"].to_numpy()))]
    width = np.array([len(x) for x in odd])
    # By width: the rows in it, their parities, and where each row stands among them.
    rows = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
    bits = {w: np.frombuffer(b"".join(odd[at_w].tolist()), np.uint64).reshape(len(at_w), -1) for w, at_w in rows.items()}
    place = np.empty(len(key), np.int64)
    for at_w in rows.values():
        place[at_w] = np.arange(len(at_w))

    def near(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs whose parities do not differ by more than alike sets can."""
        apart = np.zeros(len(x), np.int64)
        for v, w in itertools.product(rows, rows):
            of, m = np.flatnonzero((width[x] == v) & (width[y] == w)), min(v, w) // 8
            for c in range(0, len(of), 1 << 14):
                part = of[c : c + (1 << 14)]
                p, q = (_folded(bits[k][place[z[part]]], m) for k, z in ((v, x), (w, y)))
                apart[part] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
        keep = (NUM + DEN) * apart <= (DEN - NUM) * (n[x] + n[y])
        return x[keep], y[keep]

    begin, sizes = _sizes(key)
    found = [near(x, y) for x, y in _small(key, n, at, comp, np.flatnonzero(np.repeat(sizes <= LARGE, sizes)))]
    for k in np.flatnonzero(sizes > LARGE).tolist():
        lo, hi = int(begin[k]), int(begin[k] + sizes[k])
        root = np.arange(hi - lo)
        for a in range(lo, hi, BLOCK):
            for b in range(a, hi, BLOCK):
                x, y = np.arange(a, min(a + BLOCK, hi)), np.arange(b, min(b + BLOCK, hi))
                i, j = np.nonzero((comp[x][:, None] != comp[y][None, :]) & _possible(n[x][:, None], n[y][None, :], at[x][:, None], at[y][None, :]) & (x[:, None] < y[None, :]))
                for c in range(0, len(i), 1 << 18):
                    u, v = x[i[c : c + (1 << 18)]], y[j[c : c + (1 << 18)]]
                    new = root[u - lo] != root[v - lo]  # what is reached already need not be compared
                    u, v = near(u[new], v[new])
                    if len(u):
                        root = _roots(hi - lo, np.concatenate([np.arange(hi - lo), u - lo]), np.concatenate([root, v - lo]))
        found.append((lo + root, np.arange(lo, hi)))
    u, v = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (zip(*found) if found else ((), ())))
    root = _roots(len(key), u, v)
    far = root != np.arange(len(key))
    if far.any():
        yield pa.RecordBatch.from_arrays([pa.array(sig[far]), pa.array(sig[root[far]])], ["u", "v"])


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities of fewer buckets, which are low bits of hashes."""
    return bits if bits.shape[1] == words else np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), axis=1)


def _links(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """One link for each two components of a tile that alike sets join, by their whole sets."""
    begin, sizes = _sizes(t["hash"].to_numpy())
    for lo, size in zip(begin.tolist(), sizes.tolist()):
        part = t.slice(lo, size)
        sig, comp, side, across = (part[c].to_numpy() for c in ("sig", "component", "side", "across"))
        lists = part["shingles"]
        flat, n = pc.list_flatten(lists).to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64)
        ends = np.cumsum(n)
        ids = np.unique(flat, return_inverse=True)[1]
        mine = np.zeros(len(flat), bool)
        root = np.unique(comp, return_inverse=True)[1]
        out = []
        for u in range(size - 1):
            v = np.arange(u + 1, size)
            v = v[(root[v] != root[u]) & (DEN * np.minimum(n[v], n[u]) >= NUM * np.maximum(n[v], n[u])) & ((side[v] != side[u]) | ~across[u])]
            if not len(v):
                continue
            own = ids[ends[u] - n[u] : ends[u]]
            mine[own] = True
            before = np.cumsum(n[v]) - n[v]
            of = np.repeat(ends[v] - n[v] - before, n[v]) + np.arange(int(n[v].sum()))
            shared = np.add.reduceat(mine[ids[of]], before, dtype=np.int64)
            mine[own] = False
            v = v[(NUM + DEN) * shared >= NUM * (n[v] + n[u])]
            if len(v):
                joined, first = np.unique(root[v], return_index=True)
                out.append((np.full(len(first), sig[u]), sig[v[first]]))
                root[np.isin(root, joined)] = root[u]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in zip(*out)], ["u", "v"])


def _places(nodes: DataFrame) -> DataFrame:
    """(sig, n, at, hash) of the first shingles that two sets or more have among theirs."""
    places = nodes.select("sig", "n", F.posexplode("head").alias("at", "hash"))
    return materialize(_grouped(places, "hash", _meeting, "sig long, n int, at int, hash long"), "near")


def _grouped(rows: DataFrame, by: str, made, schema: str) -> DataFrame:
    """made(rows of whole groups), whose key goes by the name of hash."""
    return rows.withColumnRenamed(by, "hash").repartition("hash").sortWithinPartitions("hash").mapInArrow(_by_group(made), schema)


def _named(places: DataFrame, named: DataFrame) -> DataFrame:
    return places.join(named, "sig", "left").withColumn("component", F.coalesce("component", "sig"))


def _clusters(places: DataFrame, named: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): sets that are connected by pairs under one shingle which are not yet connected and can be alike."""
    rows = _grouped(_named(places, named), "hash", _open, "hash long, sig long, n long, at long, component long")
    reach = _grouped(rows.join(nodes.select("sig", "parity"), "sig"), "hash", _reach, "u long, v long")
    # What a set reaches under several shingles is linked to the smallest of it, which many sets have in common.
    met = reach.groupBy("u").agg(F.min("v").alias("v"), F.collect_set("v").alias("all"))
    return connected_components(met.select(F.explode(F.array_union("all", F.array("u"))).alias("u"), "v"))


def _joined(clusters: DataFrame, named: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v): alike sets of a cluster, enough to connect all that are alike."""
    of = materialize(_named(clusters.select(F.col("node").alias("sig"), F.col("component").alias("cluster")), named).join(nodes.select("sig", "n", "row"), "sig"), "near")
    sides = of.groupBy("cluster").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") * 8 / TILE_BYTES, F.lit(1))).cast("int").alias("sides"))
    of = materialize(of.join(sides, "cluster").withColumn("side", F.pmod(F.xxhash64("sig"), "sides").cast("int")), "near")
    rows = _sized(of.select("sig", "row.*"), BROADCAST_ROWS)
    sets = materialize(docs.select("file", "at", "text").join(rows, ["file", "at"]).select("sig", "text").mapInArrow(_sets, "sig long, shingles array<long>"), "near")
    tiles = of.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    tiles = tiles.select("sig", "component", "side", (F.col("side") != F.col("other")).alias("across"), F.xxhash64("cluster", F.least("side", "other"), F.greatest("side", "other")).alias("tile"))
    out = materialize(_grouped(tiles.join(sets, "sig"), "tile", _links, "u long, v long"), "near")
    discard(of, sets)
    return out


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities do not differ by more than alike sets can.

    Buckets are low bits of hashes, so that longer parities fold into shorter ones.
    """
    for b in batches:
        if not b.num_rows:
            continue
        p, q = b.column("up").to_pylist(), b.column("vp").to_pylist()
        sizes = np.array([[len(x) for x in p], [len(y) for y in q]])
        apart = np.zeros(b.num_rows, dtype=np.int64)
        for m, n in np.unique(sizes, axis=1).T.tolist():
            at = np.flatnonzero((sizes[0] == m) & (sizes[1] == n))
            for lo in range(0, len(at), 4096):
                some = at[lo : lo + 4096]
                x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(side[i] for i in some.tolist()), np.uint64).reshape(len(some), -1, min(m, n) // 8), axis=1) for side in (p, q))
                apart[some] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        keep = pa.array((NUM + DEN) * apart <= (DEN - NUM) * b.column("total").to_numpy())
        yield b.select(["u", "v"]).filter(keep)


def _bounded(pairs: DataFrame, nodes: DataFrame, parity: str) -> DataFrame:
    a, b = (nodes.select(F.col("sig").alias(c), F.col("n").alias(c + "n"), F.col(parity).alias(c + "p")) for c in "uv")
    rows = pairs.join(a, "u").join(b, "v").select("u", "v", "up", "vp", (F.col("un") + F.col("vn")).cast("long").alias("total"))
    return materialize(rows.mapInArrow(_close, "u long, v long"), "near")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose shingle sets are alike."""
    rough = _bounded(pairs, nodes, "parity")
    pairs = _bounded(rough, nodes, "wide")
    discard(rough)
    used = pairs.select(F.explode(F.array("u", "v")).alias("sig")).distinct()
    # Where few rows are wanted the texts stay where they are; else they are shuffled.
    rows = _sized(materialize(nodes.join(used, "sig", "left_semi").select("sig", "row.*"), "near"), BROADCAST_ROWS)
    sets = materialize(docs.select("file", "at", "text").join(rows, ["file", "at"]).select("sig", "text").mapInArrow(_sets, "sig long, shingles array<long>"), "near")
    a, b = (sets.select(F.col("sig").alias(c), F.col("shingles").alias(c + "s")) for c in "uv")
    shared, total = F.size(F.array_intersect("us", "vs")), F.size("us") + F.size("vs")
    out = materialize(pairs.join(a, "u").join(b, "v").where((NUM + DEN) * shared >= NUM * total).select("u", "v"), "near")
    discard(sets, pairs)
    return out


def _close_prints(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes that SimHash tiles link: of each fingerprint, and of each two that are linked, the smallest nodes."""
    low = materialize(nodes.groupBy("fp").agg(F.min("sig").alias("low")), "near")
    links = simhash.links(low.select("fp")).join(low.select(F.col("fp").alias("u"), F.col("low").alias("a")), "u").join(low.select(F.col("fp").alias("v"), F.col("low").alias("b")), "v")
    same = nodes.select("sig", "fp").join(low, "fp").where("sig <> low").select(F.col("sig").alias("u"), F.col("low").alias("v"))
    return same.unionByName(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).distinct()


def located(documents: DataFrame) -> DataFrame:
    """The documents with (file, at), which tell rows apart: where a row stands in the Parquet files that are read.

    What is not read from files as it is, is written first.
    """
    if documents._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        documents = materialize(documents, "near")
    columns = ["`" + c.replace("`", "``") + "`" for c in documents.columns]
    return documents.select(F.struct(*columns).alias("all"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def components(docs: DataFrame) -> DataFrame:
    """(file, at, component) of rows (file, at, text)."""
    sample = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_hashes, "hash long")
    top = sample.groupBy("hash").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "hash").limit(MOST).collect()
    common = np.array([r["hash"] for r in reversed(top)], dtype=np.int64).view(np.uint64)
    schema = "file long, at long, sig long, n int, fp long, head array<long>, parity binary, wide binary"
    full = materialize(docs.select("file", "at", "text").mapInArrow(_signed(common), schema), "near")
    row = F.min(F.struct("file", "at")).alias("row")
    nodes = materialize(full.groupBy("sig").agg(row, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("head").alias("head"), F.first("parity").alias("parity"), F.first("wide").alias("wide")), "near")
    signed = materialize(full.select("file", "at", "sig"), "near")
    discard(full)
    found = _verified(_close_prints(nodes), docs, nodes)
    places = _places(nodes)
    stars = _grouped(_named(places, connected_components(found).withColumnRenamed("node", "sig")), "hash", _stars, "u long, v long").distinct()
    found = found.unionByName(_verified(stars, docs, nodes))
    named = connected_components(found).withColumnRenamed("node", "sig")
    found = found.unionByName(_joined(_clusters(places, named, nodes), named, docs, nodes))
    discard(nodes, places)
    named = connected_components(found).withColumnRenamed("node", "sig")
    return signed.join(named, "sig", "left").select("file", "at", F.coalesce("component", "sig").alias("component"))


def drop(documents: DataFrame) -> DataFrame:
    """The documents, all columns, with one row of each component."""
    docs = located(documents).select("all", "all.doc_id", "all.text", "file", "at")
    keys = docs.select("file", "at", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "file", "at").alias("key"))
    of = materialize(components(docs).join(keys, ["file", "at"]), "near")
    low = of.groupBy("component").agg(F.min("key").alias("first"))
    several = of.groupBy("component").count().where("count > 1").select("component")
    low = materialize(low.join(several, "component"), "near")
    gone = materialize(of.join(low, "component").where("key <> first").select("file", "at"), "near")
    discard(of, low)
    return docs.join(_sized(gone, BROADCAST_ROWS), ["file", "at"], "left_anti").select("all.*")
