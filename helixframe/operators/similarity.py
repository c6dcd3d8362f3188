"""Joins of proteins by likeness within a gene.

A join on the gene alone would make a task of each gene, and one on gene and
k-mer would be as skewed as k-mers are: those of a conserved gene stand in nearly
all its proteins. Here a gene's pool is dealt by length to bands, and a band to
columns; its queries are dealt to rows. Columns and rows are no more than keep all
tasks busy, so that a larger pool makes larger cells and not more copies of a row;
a cell is gone through in blocks of bounded size. A query visits only the
bands that can hold an answer, as a range join on length: those within its
threshold, or, where its nearest are sought, those whose length leaves room for
something nearer than the best of the first cell it was shown. In a cell, what
two proteins have in common bounds their distance from below (`editing`), so that
few pairs are compared letter by letter. Equal proteins are compared once:
queries collapse to their different proteins, and of equal pool rows only as
many stay as a result can hold.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import codons as C
from helixframe.operators.editing import DENSE, distances, first_bounds, least_distances, nearest, pair_distances
from helixframe.operators.lanes import LANES, LEAST, LEAST_CLOSE, Lanes, Pieces, close, within
from helixframe.session import materialize

#: Different proteins of the pool and of the queries that are compared at a time: what a task holds in tables.
SALT_ROWS = 1_000
QUERY_ROWS = 250
#: Cells for each task, about. Beyond them cells grow, not their number: copies of the rows stay in proportion to the rows.
CELLS = 4
#: A cell grows so many times as far along the pool as along the queries, since a query meets many strings of the pool at once.
WIDER = 3


def _tasks(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _proteins(df: DataFrame, *more: Column | str) -> DataFrame:
    return df.select("idx", F.col("gene_name").alias("gene"), "protein", *more)


#: Lengths of a band differ by less than this factor.
BAND = 1.2


#: The same where lengths far apart are visited anyhow, and few bands make for cells of many strings.
WIDE_BAND = 3.0


def _band(length: Column, band: float) -> Column:
    return F.floor(F.log(length + 1.0) / F.log(F.lit(band))).cast("int")


@dataclass
class Grid:
    """A pool dealt to bands of length and columns, queries dealt to rows, and the bands of each gene: written, so that Spark broadcasts
    them if they are few, which they are for any pool of a few genes."""

    queries: DataFrame
    pool: DataFrame
    bands: DataFrame
    band: float
    tasks: int

    @classmethod
    def of(cls, queries: DataFrame, pool: DataFrame, ids: str = "q_protein", band: float = BAND) -> Grid:
        pool = pool.withColumns({"t_length": F.length("t_protein"), "band": _band(F.length("t_protein"), band)})
        bands = pool.groupBy("gene", "band").agg(F.count("*").alias("n"), F.min("t_length").alias("least"), F.max("t_length").alias("most"))
        bands = materialize(bands, "bands")
        rows = materialize(queries.groupBy("gene").agg(F.count("*").alias("m")), "bands")  # one row a gene
        pairs = bands.join(rows, "gene").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
        size = max(1.0, math.sqrt(pairs / (CELLS * _tasks(queries) * SALT_ROWS * QUERY_ROWS)))
        wider, tasks = min(WIDER, size), _tasks(queries)
        cells = pairs / (SALT_ROWS * QUERY_ROWS * size * size)
        tasks *= max(1, min(math.ceil(CELLS), math.ceil(cells / tasks)))  # a task for about each cell
        columns = F.greatest(F.lit(1), F.round(F.col("n") / (SALT_ROWS * size * wider)))
        bands = bands.select("gene", "band", "least", "most", columns.cast("int").alias("columns"))
        rows = rows.select("gene", F.ceil(F.col("m") / (QUERY_ROWS * size / wider)).cast("int").alias("rows"))
        queries = queries.join(rows, "gene").withColumn("row", F.pmod(F.xxhash64(ids), F.col("rows")).cast("int")).drop("rows")
        pool = pool.join(bands.select("gene", "band", "columns"), ["gene", "band"]).withColumn("column", F.pmod(F.xxhash64("t_protein", "t_idx"), F.col("columns")).cast("int"))
        pool = pool.join(rows, "gene").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).drop("rows", "columns", "t_length")
        return cls(queries, pool, bands, band, tasks)

    def visits(self, queries: DataFrame, within: Column) -> DataFrame:
        """queries in every cell of the bands for which the condition on least and most holds."""
        met = queries.withColumn("length", F.length("q_protein")).join(self.bands, "gene").where(within)
        return met.withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).drop("columns", "least", "most", "length")

    def first_visits(self, queries: DataFrame) -> DataFrame:
        """queries in one cell of the band that is nearest in length."""
        met = queries.join(self.bands, "gene").withColumn("away", F.abs(F.col("band") - _band(F.length("q_protein"), self.band)))
        one = F.min_by(F.struct("band", "columns"), F.struct("away", "band")).alias("b")
        met = met.groupBy(*queries.columns).agg(one).select(*queries.columns, "b.*")
        return met.withColumn("column", F.pmod(F.xxhash64("q_protein", F.lit(1)), F.col("columns")).cast("int")).drop("columns")

    def pairs(self, visits: DataFrame, pick: Callable, columns: list[str], best: Callable | None = None, first: bool = False, whole: int = 0) -> DataFrame:
        """The pairs that pick chooses in every cell, with these columns of queries and pool and edit_distance; also
        a row with ``compared`` alone for each cell: how many pairs were compared letter by letter.

        pick gets some rows of both tables at a time, the pool's in the order of t_idx, and returns rows, columns, distances
        and that count. best(queries, pool, rows, columns, distances), if given, says after each time which of the pairs found
        so far stay, and returns the queries, with what it has learnt of them. With first, queries meet the cell's first rows alone.
        With whole, a cell of at least so many pool rows is gone through by all its queries and up to LANES rows at a time.
        """
        keys, n = ["gene", "band", "row", "column"], self.tasks
        fields = {f.name: f for f in [*visits.schema.fields, *self.pool.schema.fields]}
        fields |= {c: T.StructField(c, T.LongType()) for c in ("edit_distance", "compared")}
        schema = T.StructType([T.StructField(fields[c].name, fields[c].dataType) for c in [*columns, "edit_distance", "compared"]])

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            found, count = [(np.zeros(0, int),) * 3], 0
            right = right.sort_by("t_idx") if len(right) else right
            high, wide = QUERY_ROWS, SALT_ROWS
            if whole and len(right) >= whole:
                high, wide = len(left), -(-len(right) // -(-len(right) // LANES))
            for lo in range(0, len(left) if len(right) else 0, high):
                some, held = left.slice(lo, high), (np.zeros(0, int),) * 3
                for at in range(0, wide if first else len(right), wide):
                    i, j, d, compared = pick(some, right.slice(at, wide))
                    held = tuple(np.concatenate(x) for x in zip(held, (i, j + at, d)))
                    count += compared
                    if best:
                        keep, some = best(some, right, *held)
                        held = tuple(x[keep] for x in held)
                found.append((held[0] + lo, *held[1:]))
            i, j, d = (np.concatenate(x) for x in zip(*found))
            data = {c: (left if c in left.column_names else right)[c].take(pa.array(i if c in left.column_names else j)) for c in columns}
            out = pa.table({**data, "edit_distance": pa.array(d.astype(np.int64)), "compared": pa.nulls(len(i), pa.int64())})
            note = pa.table({f.name: pa.array([count], f.type) if f.name == "compared" else pa.nulls(1, f.type) for f in out.schema})
            return pa.concat_tables([out, note])

        # The number of tasks is fixed here: rows are few where work is much, and adaptive execution would join them.
        sides = [x.repartition(n, *keys).groupBy(*keys) for x in (visits, self.pool)]
        return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def _foremost(i: np.ndarray, cost: np.ndarray, j: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which pairs are among the k of least (cost, j) of their row i; the rows that have k; the k-th costs of these)."""
    order = np.lexsort((j, cost, i))
    row = i[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    last = order[nth == k - 1]
    return np.sort(order[nth < k]), i[last], cost[last]


def _longer() -> Column:
    return F.greatest(F.length("q_protein"), F.length("t_protein"), F.lit(1))


def _lengths(side: pa.Table, name: str) -> np.ndarray:
    return np.array([len(x) for x in side[name].to_pylist()])


def _best(queries: DataFrame, pool: DataFrame, k: int, relative: bool, accepted: Callable) -> DataFrame:
    """(gene, q_protein, t_protein, t_idx, ..., edit_distance, compared): at least the k best pool rows of each query protein, and the rows of ``Grid.pairs`` that count.

    Best is least (edit_distance, t_idx), or least edit_distance over the longer
    length if relative. accepted(distances, lengths, lengths) says which pairs count.
    """
    grid = Grid.of(queries, pool, band=WIDE_BAND)

    def many(left: pa.Table, right: pa.Table, k: int, start: np.ndarray):
        a, b = left["q_protein"].to_pylist(), right["t_protein"].to_pylist()
        n, m = _lengths(left, "q_protein"), _lengths(right, "t_protein")
        longest = np.maximum(np.maximum(n, m.max()), 1)
        most = np.where(np.isinf(start), longest, np.floor(np.where(np.isinf(start), 0, start) * (longest if relative else 1) + 1e-9)).astype(np.int64)

        def keep(i: int, j: np.ndarray, d: np.ndarray) -> np.ndarray:
            cost = d / np.maximum(np.maximum(n[i], m[j]), 1) if relative else d
            ok = np.flatnonzero(accepted(d, n[i], m[j]) & (cost <= start[i] + 1e-9))
            return ok[np.lexsort((j[ok], cost[ok]))[:k]]

        return *within(a, Lanes(b), b, most, keep), len(a) * len(b)

    def block(left: pa.Table, right: pa.Table, k: int, start: np.ndarray):
        a, b = left["q_protein"].to_pylist(), right["t_protein"].to_pylist()
        n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        out, count = nearest(a, b, k, start, relative, lambda d, i, j: accepted(d, n[i], m[j]))
        valid = (out >= 0) & accepted(out, n[:, None], m[None, :])
        size = np.maximum(np.maximum(n[:, None], m[None, :]), 1)
        cost = np.where(valid, out / size if relative else out, np.inf)
        order = np.argsort(cost, axis=1, kind="stable")[:, :k]
        return out, cost, order, count

    def seed(left: pa.Table, right: pa.Table):
        a, b = left["q_protein"].to_pylist(), right["t_protein"].to_pylist()
        n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        low = least_distances(a, b)
        size = np.maximum(np.maximum(n[:, None], m[None, :]), 1)
        bound, j, count = first_bounds(a, b, k, low, low / size if relative else low, relative, lambda d, i, j: accepted(d, n[i], m[j]))
        i = np.flatnonzero(np.isfinite(bound))
        return i, j[i], np.rint(bound[i] * (size[i, j[i]] if relative else 1)).astype(np.int64), count

    def pick(left: pa.Table, right: pa.Table):
        start = left["bound"].to_numpy()
        start = np.where(np.isnan(start), np.inf, start)
        if len(right) >= LEAST:
            return many(left, right, k, start)
        out, cost, order, count = block(left, right, k, start)
        i = np.repeat(np.arange(len(left)), order.shape[1]).reshape(order.shape)
        keep = np.isfinite(cost[i, order])
        i, j = i[keep], order[keep]
        return i, j, out[i, j], count

    def best(left: pa.Table, right: pa.Table, i: np.ndarray, j: np.ndarray, d: np.ndarray):
        n = np.array([len(x) for x in left["q_protein"].to_pylist()])[i]
        m = np.array([len(x) for x in right["t_protein"].take(pa.array(j)).to_pylist()], dtype=np.int64)
        cost = d / np.maximum(np.maximum(n, m), 1) if relative else d.astype(float)
        keep, row, kth = _foremost(i, cost, j, k)
        bound = left["bound"].to_numpy().copy()
        bound[row] = np.fmin(bound[row], kth)
        return keep, left.set_column(left.column_names.index("bound"), "bound", pa.array(bound))

    first = grid.pairs(grid.first_visits(grid.queries), seed, ["gene", "q_protein", "t_protein"], first=True)
    first = materialize(first.withColumn("bound", F.col("edit_distance") / (_longer() if relative else F.lit(1))), "first")
    seeded = grid.queries.join(first.where("compared is null").select("gene", "q_protein", "bound"), ["gene", "q_protein"], "left")
    seeded = seeded.withColumn("bound", F.coalesce("bound", F.lit(float("nan"))))
    n, c = F.col("length"), F.col("bound")
    if relative:  # the distance over the longer length is at least 1 - shorter / longer
        near = (F.col("most") >= n * (1 - c) - 1e-6) & (F.col("least") * (1 - c) <= n + 1e-6)
    else:
        near = (F.col("most") >= n - c) & (F.col("least") <= n + c)
    columns = ["gene", "q_protein", "t_protein", *[x for x in pool.columns if x not in ("gene", "t_protein")]]
    found = grid.pairs(grid.visits(seeded, F.isnan(c) | near), pick, columns, best, whole=LEAST)
    return found.unionByName(first.where("compared is not null").drop("bound"), allowMissingColumns=True)


def _nearest(queries: DataFrame, pool: DataFrame, k: int, cap: float | None) -> DataFrame:
    """(gene, q_protein, t_idx, ..., edit_distance, identity): at least the k nearest pool rows of every different query protein.

    Distances are ordered by (edit_distance, t_idx). Only pool rows of identity
    cap or less count where a cap is given.
    """
    different = queries.select("gene", F.col("protein").alias("q_protein")).distinct()
    capped = lambda d, n, m: (1 - d / np.maximum(np.maximum(n, m), 1) <= cap) if cap is not None else np.ones(np.shape(d), bool)
    found = _best(different, pool, k, False, capped).where("compared is null").drop("compared")
    return found.withColumn("identity", 1 - F.col("edit_distance") / _longer()).withColumn("edit_distance", F.col("edit_distance").cast("int")).drop("t_protein")


def _few(pool: DataFrame, k: int, *more: str) -> DataFrame:
    """Of equal proteins of a gene the k rows of the smallest idx: a result holds no more."""
    w = Window.partitionBy("gene_name", "protein").orderBy("idx")
    rows = pool.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return rows.select(F.col("gene_name").alias("gene"), F.col("protein").alias("t_protein"), F.col("idx").alias("t_idx"), *[F.col(c).alias(f"t_{c}") for c in more])


def top_neighbours(queries: DataFrame, pool: DataFrame, k: int = 5, max_identity: float | None = None) -> DataFrame:
    """The k pool rows of the same gene at least edit distance (ties: smaller idx), rank from 0.

    A query does not count as its own neighbour; queries without a neighbour do
    not appear (`without_neighbours` counts them).
    """
    q = _proteins(queries)
    # One more than k, since a query may be in the pool itself.
    found = _nearest(q, _few(pool, k + 1, "species"), k + 1, max_identity)
    w = Window.partitionBy("gene", "q_protein").orderBy("edit_distance", "t_idx")
    found = materialize(found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r"), "nearest")
    rows = q.select(F.col("idx").alias("q_idx"), "gene", F.col("protein").alias("q_protein")).join(found, ["gene", "q_protein"]).where("q_idx <> t_idx")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q_idx").orderBy("edit_distance", "t_idx")) - 1)
    return ranked.where(F.col("rank") < k).drop("q_protein")


def without_neighbours(queries: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Queries that have no neighbour."""
    return queries.join(neighbours.select(F.col("q_idx").alias("idx")).distinct(), "idx", "left_anti")


def unlike_none(queries: DataFrame, pool: DataFrame, cap: float) -> DataFrame:
    """Queries whose gene has no pool row of identity cap or less; cap is below 1.

    One such row is enough, so none is looked for that is nearest: where the
    shortest or the longest pool row of the gene differs so much in length that
    no alignment can reach more than cap, that is one. The other queries are shown
    to cells, and pairs are compared where common letters do not decide.
    """
    q, t = F.length("protein"), pool.groupBy(F.col("gene_name").alias("gene")).agg(F.min(F.length("protein")).alias("least"), F.max(F.length("protein")).alias("most"))
    apart = lambda m: 1 - F.abs(q - F.col(m)) / F.greatest(q, F.col(m), F.lit(1)) <= cap
    met = _proteins(queries).join(materialize(t, "lengths"), "gene", "left")  # one row a gene
    open_ = materialize(met.where(~F.coalesce(apart("least") | apart("most"), F.lit(False))).select("idx", "gene", F.col("protein").alias("q_protein")), "queries")
    if open_.isEmpty():
        return queries.join(open_.select("idx"), "idx", "left_semi")

    def pick(left: pa.Table, right: pa.Table):
        rows = np.flatnonzero(np.isnan(left["bound"].to_numpy()))
        a, b = left["q_protein"].take(pa.array(rows)).to_pylist(), right["t_protein"].to_pylist()
        if not a:
            return rows, rows, rows, 0
        longer = np.maximum(np.maximum(np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :]), 1)
        low = least_distances(a, b)
        hit, count = 1 - low / longer <= cap, 0
        rest = np.flatnonzero(~hit.any(axis=1))
        if len(rest):
            low[rest] = distances([a[r] for r in rest], b)
            hit[rest], count = 1 - low[rest] / longer[rest] <= cap, len(rest) * len(b)
        i = np.flatnonzero(hit.any(axis=1))
        j = hit[i].argmax(axis=1)
        return rows[i], j, low[i, j], count

    def best(left: pa.Table, right: pa.Table, i: np.ndarray, j: np.ndarray, d: np.ndarray):
        bound = left["bound"].to_numpy().copy()
        bound[i] = d
        return slice(None), left.set_column(left.column_names.index("bound"), "bound", pa.array(bound))

    grid = Grid.of(open_.select("gene", "q_protein").distinct(), _few(pool, 1))
    visits = grid.visits(grid.queries, F.lit(True)).withColumn("bound", F.lit(float("nan")))
    found = grid.pairs(visits, pick, ["gene", "q_protein"], best).where("compared is null").select("gene", "q_protein").distinct()
    lone = open_.join(materialize(found, "met"), ["gene", "q_protein"], "left_anti")
    return queries.join(lone.select("idx"), "idx", "left_semi")


def _likest(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(idx, gene, t_idx, identity): the likest pool row of the gene, ties to the smaller idx; null where there is none.

    A query may be in the pool: it does not count for itself, so the two smallest
    idx of equal proteins stay.
    """
    q = _proteins(queries)
    pool = materialize(_few(pool, 2), "pool")
    # A query whose protein another pool row has is done.
    own = materialize(pool.groupBy("gene", "t_protein").agg(F.collect_set("t_idx").alias("of")).select("gene", F.col("t_protein").alias("protein"), "of"), "pool")
    other = q.join(own, ["gene", "protein"], "left").select("idx", "gene", "protein", F.array_min(F.array_remove("of", F.col("idx"))).alias("twin"))
    twins = other.where("twin is not null").select("idx", "gene", F.col("twin").alias("t_idx"), F.lit(1.0).alias("identity"))
    rest = materialize(other.where("twin is null").select("idx", "gene", F.col("protein").alias("q_protein")), "queries")

    # Equal proteins have been dealt with: what is left of them is the query itself.
    found = _best(rest.select("gene", "q_protein").distinct(), pool, 1, True, lambda d, n, m: d > 0).where("compared is null")
    best = found.groupBy("gene", "q_protein").agg(F.min(F.struct((F.col("edit_distance") / _longer() - 1).alias("m"), "t_idx")).alias("b"))
    rest = rest.join(materialize(best, "nearest"), ["gene", "q_protein"], "left").select("idx", "gene", F.col("b.t_idx").alias("t_idx"), (-F.col("b.m")).alias("identity"))
    return twins.unionByName(rest)


def max_identity(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(idx, max_identity) of every query; 0.0 where its gene has no candidate."""
    return _likest(queries, pool).select("idx", F.coalesce("identity", F.lit(0.0)).alias("max_identity"))


def nearest_by_length_bound(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(q_idx, t_idx, identity) of the likest pool row; ties: smaller idx. Queries without candidates do not appear."""
    return _likest(queries, pool).where("t_idx is not null").select(F.col("idx").alias("q_idx"), "t_idx", "identity")


def pairs_compared(queries: DataFrame, pool: DataFrame) -> int:
    """How many pairs the search for the likest compares letter by letter, for tests and tuning."""
    different = queries.select(F.col("gene_name").alias("gene"), F.col("protein").alias("q_protein")).distinct()
    return _best(different, _few(pool, 2), 1, True, lambda d, n, m: d > 0).agg(F.sum("compared")).first()[0] or 0


def threshold_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(q_idx, t_idx, edit_distance) of pairs within int(len * (1 - threshold)) edits of the left protein.

    Pairs are formed within that window of lengths only, and compared only if
    they have enough pieces of two letters in common. Segments of which one must
    be whole would be three letters long at 0.7, and stand in most proteins.
    """
    return threshold_grid(left, right, threshold).where("compared is null").select("q_idx", "t_idx", F.col("edit_distance").cast("int").alias("edit_distance"))


def threshold_grid(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """The pairs of `threshold_pairs`, and how many were compared in each cell."""

    def pick(left: pa.Table, right: pa.Table):
        a, b = left["q_protein"].to_pylist(), right["t_protein"].to_pylist()
        n, m = _lengths(left, "q_protein"), _lengths(right, "t_protein")
        bound = (n * (1.0 - threshold)).astype(np.int64)
        if len(b) >= LEAST_CLOSE:
            i, j, d, count = close(a, b, bound)
            other = left["q_idx"].to_numpy()[i] != right["t_idx"].to_numpy()[j]
            return i[other], j[other], d[other], count
        i, j = np.nonzero((least_distances(a, b) <= bound[:, None]) & (left["q_idx"].to_numpy()[:, None] != right["t_idx"].to_numpy()[None, :]))
        if len(i) > DENSE * len(a) * len(b):
            d = distances(a, b)[i, j]
        else:
            d = pair_distances(a, b, i, j, bound[i])
        keep = d <= bound[i]
        return i[keep], j[keep], d[keep], len(i)

    q = left.select(F.col("gene_name").alias("gene"), F.col("protein").alias("q_protein"), F.col("idx").alias("q_idx"))
    t = right.select(F.col("gene_name").alias("gene"), F.col("protein").alias("t_protein"), F.col("idx").alias("t_idx"))
    grid = Grid.of(q, t, "q_idx")
    room = (F.col("length") * F.lit(1.0 - threshold)).cast("long")
    visits = grid.visits(grid.queries, (F.col("most") >= F.col("length") - room) & (F.col("least") <= F.col("length") + room))
    return grid.pairs(visits, pick, ["q_idx", "t_idx"], whole=LEAST_CLOSE)


def kmer_candidates(queries: DataFrame, pool: DataFrame, k: int = 3, top: int = 8) -> DataFrame:
    """(q_idx, t_idx, votes, rank): pool rows of the gene with the most common distinct k-mers; ties: smaller idx.

    A query that shares no k-mer gets the first rows of its gene, with no votes.
    Votes are counted in a cell, from its lists of the proteins with each k-mer,
    which are not joined whatever the k-mers' frequencies.
    """

    def pick(left: pa.Table, right: pa.Table):
        a, b = left["q_protein"].to_pylist(), right["t_protein"].to_pylist()
        pieces, found = Pieces(b, k), [(np.zeros(0, np.int64),) * 3]
        for i, query in enumerate(a):
            j, votes = pieces.most(query, top + 1)
            found.append((np.full(len(j), i), j, votes))
        return *(np.concatenate(x) for x in zip(*found)), 0

    q = queries.select(F.col("idx").alias("q_idx"), F.col("gene_name").alias("gene"), F.col("protein").alias("q_protein"))
    # One more than top, since a query may be in the pool itself.
    grid = Grid.of(q.select("gene", "q_protein").distinct(), _few(pool, top + 1), band=WIDE_BAND)
    found = grid.pairs(grid.visits(grid.queries, F.lit(True)), pick, ["gene", "q_protein", "t_idx"], lambda left, right, i, j, d: (_foremost(i, -d, j, top + 1)[0], left), whole=1).where("compared is null")
    few = Window.partitionBy("gene", "q_protein").orderBy(F.desc("votes"), "t_idx")
    found = found.select("gene", "q_protein", "t_idx", F.col("edit_distance").alias("votes")).withColumn("r", F.row_number().over(few)).where(F.col("r") <= top + 1)
    votes = q.join(materialize(found.drop("r"), "votes"), ["gene", "q_protein"]).where("q_idx <> t_idx").select("q_idx", "t_idx", "votes")
    w = Window.partitionBy("q_idx").orderBy(F.desc("votes"), "t_idx")
    found = materialize(votes.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < top), "votes")
    # One row more than top, since a query may be in the pool itself.
    first = pool.select(F.col("gene_name").alias("gene"), F.col("idx").alias("t_idx")).withColumn("r", F.row_number().over(Window.partitionBy("gene").orderBy("t_idx"))).where(F.col("r") <= top + 1)
    lone = queries.select(F.col("idx").alias("q_idx"), F.col("gene_name").alias("gene")).join(found.select("q_idx").distinct(), "q_idx", "left_anti")
    rest = lone.join(first, "gene").where("q_idx <> t_idx").withColumn("rank", F.row_number().over(Window.partitionBy("q_idx").orderBy("r")) - 1).where(F.col("rank") < top)
    return found.unionByName(rest.select("q_idx", "t_idx", F.lit(0).cast("long").alias("votes"), "rank"))


def novel(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates whose sequence does not occur among the known ones, by hash."""
    key = C.sequence_hash(F.col("sequence")).alias("h")
    return candidates.withColumn("h", key).join(known.select(key).distinct(), "h", "left_anti").drop("h")
