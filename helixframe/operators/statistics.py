"""Summaries, bootstrap intervals and paired tests over long metric tables."""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.operators.ranking import positions, tied_ranks
from helixframe.session import materialize

STRATA = ((0.0, 0.6, "<60%"), (0.6, 0.8, "60-80%"), (0.8, 0.9, "80-90%"), (0.9, 0.95, "90-95%"), (0.95, 1.01, ">=95%"))


def clean(value: Column) -> Column:
    """NaN means not measured: null."""
    return F.nanvl(value, F.lit(None).cast("double"))


def stratum(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi, name in STRATA:
        out = F.when((x >= lo) & (x < hi), name).otherwise(out)
    return out


def quantiles(df: DataFrame, by: list[str], value: str, **points: float) -> DataFrame:
    """Exact quantiles by group, between neighbours in proportion, as columns named by the keywords.

    Values are numbered across tasks, so that no group is held in one buffer.
    """
    rows = positions(df.where(F.col(value).isNotNull()).select(*by, value), by, [value])
    rows = rows.join(rows.groupBy(*by).agg(F.count("*").alias("__k")), by)
    out = []
    for name, q in points.items():
        at = F.lit(q) * (F.col("__k") - 1)
        part = at - F.floor(at)
        weight = F.when(F.col("position") == F.floor(at), 1 - part).when(F.col("position") == F.floor(at) + 1, part)
        out.append(F.sum(F.when(weight > 0, weight * F.col(value))).alias(name))
    return rows.groupBy(*by).agg(*out)


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, median, p10, p90, p95, min, max, sem of a column by group; rows without a value do not count."""
    v = F.col(value)
    rest = df.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"))
    return rest.join(quantiles(df, by, value, median=0.5, p10=0.1, p90=0.9, p95=0.95), by)


def common_rows(metrics: DataFrame) -> DataFrame:
    """Rows of a long table (idx, method, ...) whose idx every method has."""
    methods = metrics.select(F.countDistinct("method").alias("m"))
    per = metrics.groupBy("idx").agg(F.countDistinct("method").alias("m"))
    return metrics.join(per.join(F.broadcast(methods), "m").select("idx"), "idx", "left_semi")


def stratified(metrics: DataFrame, least: int = 2) -> DataFrame:
    """(stratum, method, metric, n, species, mean): by stratum and, as 'overall', for all.

    A stratum needs at least so many rows and as many species.
    """
    long = metrics.where("value is not null").withColumn("stratum", stratum(F.col("identity")))
    sets = long.groupingSets([["method", "metric"], ["stratum", "method", "metric"]], "stratum", "method", "metric")
    rows = sets.agg(F.count("value").alias("n"), F.countDistinct("species").alias("species"), F.avg("value").alias("mean"), F.grouping("stratum").alias("g"))
    kept = rows.where((F.col("g") == 1) | F.col("stratum").isNotNull() & (F.col("n") >= least) & (F.col("species") >= least))
    return kept.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("stratum")).alias("stratum"), "method", "metric", "n", "species", "mean")


def by_stratum(metrics: DataFrame) -> DataFrame:
    """The rows once for 'overall' and once for their stratum, for whatever is computed by stratum."""
    names = F.array_compact(F.array(F.lit("overall"), stratum(F.col("identity"))))
    return metrics.withColumn("stratum", F.explode(names))


def _draw(seed: int, replicate: Column, position: Column, n: Column) -> Column:
    """A reproducible number 0..n-1 for a replicate and position, by the md5 of both."""
    text = F.concat_ws(":", F.lit(str(seed)), replicate, position)
    return F.pmod(F.conv(F.substr(F.md5(text), F.lit(1), F.lit(12)), 16, 10).cast("long"), n)


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, by: list[str], draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean and its percentile interval when whole clusters are drawn with replacement.

    Clusters are summed first, so that a replicate is a join of as many draws as
    there are clusters with (cluster, sum, n), never with the rows.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    w = Window.partitionBy(*by)
    numbered = sums.withColumn("pos", F.row_number().over(w.orderBy(cluster)) - 1).withColumn("k", F.count("*").over(w))
    wanted = numbered.select(*by, "k", F.col("pos").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("rep"))
    wanted = wanted.withColumn("pos", _draw(seed, F.col("rep"), F.col("slot"), F.col("k")))
    reps = wanted.join(numbered.select(*by, "pos", "s", "c"), [*by, "pos"]).groupBy(*by, "rep").agg((F.sum("s") / F.sum("c")).alias("m"))
    tail = (1 - level) / 2
    ci = reps.groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"))
    mean = sums.groupBy(*by).agg((F.sum("s") / F.sum("c")).alias("mean"), F.sum("c").alias("n"), F.count("*").alias("clusters"))
    return mean.join(ci, by).withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


#: Clusters that one task draws from.
PART = 4096


def _drawn(keys: int, draws: int, seed: int):
    """Draws of one part of a group's clusters: how many fall to it, by halves, and which of its clusters they are."""

    def run(key: tuple, clusters: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        group, part = zlib.crc32(repr(key[:keys]).encode()), int(key[keys])
        path = path.sort_values("level")
        n = np.full(draws, int(path["of"].iloc[0]) if len(path) else len(clusters))
        for level, prefix, of, left in zip(path["level"], path["prefix"], path["of"], path["left"]):
            # Both halves draw the same numbers, for they are those of the node above them.
            low = np.random.default_rng([seed, group, int(level), int(prefix)]).binomial(n, left / of)
            n = n - low if part >> (int(path["depth"].iloc[0]) - int(level) - 1) & 1 else low
        rows = clusters.sort_values("__cluster")
        s, c, rng = rows["s"].to_numpy(float), rows["c"].to_numpy(float), np.random.default_rng([seed, group, part, 1 << 30])
        sums, counts, step = np.zeros(draws), np.zeros(draws), max(1, (1 << 22) // len(rows))
        for lo in range(0, draws, step):
            w = rng.multinomial(n[lo : lo + step], np.full(len(rows), 1 / len(rows)))
            sums[lo : lo + step], counts[lo : lo + step] = w @ s, w @ c
        out = {f"k{i}": [k] * draws for i, k in enumerate(key[:keys])}
        return pd.DataFrame(out | {"rep": np.arange(draws), "s": sums, "c": counts})

    return run


def split_bootstrap(df: DataFrame, cluster: str, value: str, by: list[str], draws: int = 2000, seed: int = 0, level: float = 0.95, part: int = PART) -> DataFrame:
    """What `cluster_bootstrap` gives, for groups of very many clusters: no row is made for a draw.

    Clusters are dealt to parts. How many of a replicate's draws fall to a part
    follows from binomial draws down a tree of halves, the same wherever they are
    made; a part then draws the weights of its clusters and returns two sums a
    replicate. Work grows with clusters times draws, in parts; what is shuffled
    with parts times draws.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    sums = materialize(sums.withColumnRenamed(cluster, "__cluster"), "bootstrap")
    mean = sums.groupBy(*by).agg((F.sum("s") / F.sum("c")).alias("mean"), F.sum("c").alias("n"), F.count("*").alias("clusters"))
    depth = mean.select(*by, F.greatest(F.lit(0), F.ceil(F.log2(F.col("clusters") / part))).cast("int").alias("depth"))
    dealt = sums.join(depth, by).withColumn("part", F.pmod(F.xxhash64("__cluster"), F.expr("shiftleft(1L, depth)"))).drop("depth")
    sizes = materialize(dealt.groupBy(*by, "part").agg(F.count("*").alias("size")).join(depth, by), "bootstrap")
    # The nodes above each part, with how many clusters are below them and below their first halves.
    above = sizes.where("depth > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))
    above = above.withColumn("prefix", F.expr("shiftright(part, depth - level)"))
    first = F.expr("shiftright(part, depth - level - 1) % 2 = 0")
    nodes = above.groupBy(*by, "level", "prefix").agg(F.sum("size").alias("of"), F.sum(F.when(first, F.col("size")).otherwise(0)).alias("left"))
    path = above.select(*by, "part", "depth", "level", "prefix").join(nodes, [*by, "level", "prefix"])
    kinds = [T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(by)]
    schema = T.StructType([*kinds, *T.StructType.fromDDL("rep long, s double, c double")])
    keys = [*by, "part"]
    reps = dealt.groupBy(*keys).cogroup(path.groupBy(*keys)).applyInPandas(_drawn(len(by), draws, seed), schema)
    reps = reps.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(by)], "rep", "s", "c").groupBy(*by, "rep").agg((F.sum("s") / F.sum("c")).alias("m"))
    tail = (1 - level) / 2
    ci = reps.groupBy(*by).agg(F.percentile("m", F.lit(tail)).alias("lo"), F.percentile("m", F.lit(1 - tail)).alias("hi"), F.avg("m").alias("mean_of_draws"), F.stddev_samp("m").alias("sd"))
    return mean.join(ci, by).withColumn("significant", (F.col("lo") > 0) | (F.col("hi") < 0))


#: Differences up to which p is exact; the counts of subsets are 64-bit numbers up to here.
EXACT = 50


def signed_rank(pairs: DataFrame, by: list[str], diff: str = "d") -> DataFrame:
    """Wilcoxon's W with tie-averaged ranks, matched rank-biserial with ordinal ranks, and the numbers for p.

    Zero differences are dropped; identical vectors have statistic 0.
    """
    rows = pairs.where(F.col(diff).isNotNull())
    kept = rows.where(f"{diff} <> 0").select(*by, "idx", diff, F.abs(diff).alias("a"))
    placed = tied_ranks(positions(kept, by, ["a", "idx"], "o").withColumn("o", F.col("o") + 1), by, "a", "r")
    up, down = F.col(diff) > 0, F.col(diff) < 0
    part = lambda c, what: F.sum(F.when(c, F.col(what)).otherwise(0))
    stats = placed.groupBy(*by).agg(
        F.count("*").alias("n"), part(up, "r").alias("w_plus"), part(down, "r").alias("w_minus"), part(up, "o").alias("o_plus"), part(down, "o").alias("o_minus"),
        F.sum(F.col("r_ties") * F.col("r_ties") - 1).cast("double").alias("ties"),
    )
    all_ = rows.groupBy(*by).agg(F.bool_and(F.abs(diff) <= 1e-8).alias("identical"), F.count_if(F.col(diff) == 0).alias("zeros"))
    out = all_.join(stats, by, "left")
    effect = (F.col("o_plus") - F.col("o_minus")) / (F.col("o_plus") + F.col("o_minus"))
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    statistic = F.least("w_plus", "w_minus")
    z = F.when(var > 0, (statistic - mean) / F.sqrt(var))
    return out.select(*by, F.coalesce("n", F.lit(0)).alias("n"), "identical", F.when(F.col("identical"), 0.0).otherwise(statistic).alias("statistic"),
                      F.when(F.col("identical"), 0.0).otherwise(effect).alias("effect"), F.when(F.col("identical"), F.lit(None)).otherwise(z).alias("z"),
                      (~F.col("identical") & (F.col("zeros") == 0) & (F.col("ties") == 0) & (F.col("n") <= EXACT)).alias("exact"))


def signed_rank_p(tests: DataFrame) -> DataFrame:
    """The tests of `signed_rank` with a two-sided p: 1 for identical vectors; by the exact null distribution for groups of
    EXACT differences or fewer without ties and zeros; otherwise by the normal distribution, with the variance less for ties."""
    p = F.when(F.col("identical"), F.lit(1.0)).when(F.col("exact"), exact_two_sided("n", "statistic")).otherwise(normal_two_sided("z"))
    return tests.withColumn("p", p)


@functools.cache
def subset_counts(n: int) -> np.ndarray:
    """How many of the subsets of the ranks 1 to n have each sum: the coefficients of the product of 1 + x**rank."""
    counts = np.zeros(n * (n + 1) // 2 + 1, dtype=np.int64)
    counts[0] = 1
    for rank in range(1, n + 1):
        counts[rank:] += counts[:-rank].copy()
    return counts


@F.pandas_udf(T.DoubleType())
def exact_two_sided(n: pd.Series, statistic: pd.Series) -> pd.Series:
    """Twice the chance that the smaller rank sum of n differences is no larger, all signs being as likely; null for more than EXACT."""

    def tail(n: float, w: float) -> float | None:
        if pd.isna(n) or pd.isna(w) or n > EXACT:
            return None
        return min(1.0, 2 * int(subset_counts(int(n))[: int(w) + 1].sum()) / 2 ** int(n))

    return pd.Series([tail(*x) for x in zip(n, statistic)], dtype=float)


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|N(0,1)| >= |z|); 1 where z is null."""
    return z.map(lambda x: 1.0 if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of chi squared: the regularised incomplete gamma by series or continued fraction."""

    def tail(x: float, k: float) -> float:
        if x <= 0 or k <= 0:
            return 1.0
        a, y = k / 2, x / 2
        lead = -y + a * math.log(y) - math.lgamma(a)
        if y < a + 1:
            term = total = 1 / a
            n = a
            while abs(term) > abs(total) * 1e-16:
                n += 1
                term *= y / n
                total += term
            return max(0.0, 1 - math.exp(lead) * total)
        b, c = y + 1 - a, 1e300
        d = 1 / b
        h = d
        for i in range(1, 100_000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b or 1e-300)
            c = b + an / c or 1e-300
            h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return min(1.0, math.exp(lead) * h)

    return pd.Series([tail(x, k) for x, k in zip(stat, dof)])


def adjusted(tests: DataFrame, p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Adds bonferroni (p < alpha / m), q (Benjamini-Hochberg) and reject (q < alpha); the family is the whole frame.

    A family is one row a comparison (methods x metrics), so one sort holds it.
    """
    every = Window.partitionBy()
    ranked = tests.withColumn("m", F.count("*").over(every)).withColumn("rank", F.row_number().over(Window.orderBy(p, *[c for c in tests.columns if c != p])))
    down = Window.orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("rank")).over(down))
    return ranked.withColumn("bonferroni", F.col(p) < alpha / F.col("m")).withColumn("q", q).withColumn("reject", F.col("q") < alpha).drop("m", "rank")


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Correlation of tie-averaged ranks by group."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = tied_ranks(tied_ranks(rows, by, x, "rx"), by, y, "ry")
    return ranked.groupBy(*by).agg(F.corr("rx", "ry").alias("rho"), F.count("*").alias("n"))


def seed_summary(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, sd (null for one seed), min, max and how many are positive."""
    v = F.col(value)
    return runs.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if(v > 0).alias("positive"))


def paired_t(a: DataFrame, b: DataFrame, on: str, value: str) -> DataFrame:
    """One row: n, mean, sd, sem and t of a - b over shared keys; t is null where sem is 0."""
    d = a.select(on, F.col(value).alias("x")).join(b.select(on, F.col(value).alias("y")), on).select((F.col("x") - F.col("y")).alias("d"))
    s = d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).withColumn("sem", F.col("sd") / F.sqrt("n"))
    return s.withColumn("t", F.when(F.col("sem") > 0, F.col("mean") / F.col("sem")))


def checks(claims: DataFrame) -> DataFrame:
    """(label, claimed, actual, tol) with passed: equal within the tolerance; what is missing fails."""
    return claims.withColumn("passed", F.coalesce(F.abs(F.col("claimed") - F.col("actual")) <= F.col("tol"), F.lit(False)))


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two frames hold the same different rows, and how many each has alone."""
    left, right = a.subtract(b).agg(F.count("*").alias("left_only")), b.subtract(a).agg(F.count("*").alias("right_only"))
    return left.crossJoin(right).withColumn("same", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def best_epochs(history: DataFrame, by: list[str], epoch: str, loss: str, patience: int) -> DataFrame:
    """The epoch of the smallest loss (the first of equals), how long it has stood, and whether patience ran out."""
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col(epoch).alias("epoch")))
    out = history.groupBy(*by).agg(F.count("*").alias("epochs"), best.alias("b"), F.max(epoch).alias("last"))
    stood = F.col("last") - F.col("b.epoch")
    return out.select(*by, "epochs", F.col("b.epoch").alias("best_epoch"), F.col("b.loss").alias("best_loss"), stood.alias("stood"), ((stood >= patience) & (F.col("epochs") > patience)).alias("stopped"))
