"""Codon usage, transitions and the weights and look-up tables made from them."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import codons as C

CODONS = ["".join(x) for x in product("ACGT", repeat=3)]

#: Number of a base's letter in alphabetical order, 4 for what is none.
_BASE = np.full(256, 4, np.uint8)
for _k, _b in enumerate("ACGT"):
    _BASE[ord(_b)] = _BASE[ord(_b.lower())] = _k


def _runs(texts: pa.LargeStringArray, codons: int, without: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a text has other letters than bases; text and number of each run of so many full codons of those that have none).

    The last ``without`` letters do not count.
    """
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base = _BASE[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    odd = np.zeros(len(texts), bool)
    odd[np.searchsorted(ends, np.flatnonzero(base == 4), "right") - 1] = True
    count = np.where(odd, 0, np.maximum((np.diff(ends) - without) // 3 - (codons - 1), 0))
    owner = np.repeat(np.arange(len(count)), count)
    at = np.repeat(ends[:-1] - 3 * (np.cumsum(count) - count), count) + 3 * np.arange(len(owner))
    number = np.zeros(len(owner), np.int64)
    for k in range(3 * codons):
        number = number * 4 + base[at + k]
    return odd, owner, number


def _tallied(by: list[str], codons: int):
    """Runs of so many neighbouring codons in each batch, with how often each stands in each group."""
    letters, width = 3 * codons, 64**codons
    names = ["".join(x) for x in product(CODONS, repeat=codons)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("sequence").cast(pa.large_string()).fill_null("")
            if not len(texts):
                continue
            group, first = np.zeros(len(texts), np.int64), np.zeros(1, np.int64)
            for c in by:
                codes = batch.column(c).dictionary_encode(null_encoding="encode")
                group = group * max(1, len(codes.dictionary)) + codes.indices.to_numpy()
                _, first, group = np.unique(group, return_index=True, return_inverse=True)
            odd, owner, number = _runs(texts, codons)
            seen = np.bincount(group[owner] * width + number, minlength=1)
            key = np.flatnonzero(seen)
            rows, runs, n = key // width, [names[k] for k in (key % width).tolist()], seen[key]
            other = Counter()
            # Texts of other letters are taken apart one by one.
            for r in np.flatnonzero(odd).tolist():
                text = texts[r].as_py().upper()
                other.update((int(group[r]), text[i : i + letters]) for i in range(0, len(text) - letters + 1, 3))
            rows = first[np.concatenate([rows, np.array([g for g, _ in other], np.int64)])]
            out = [batch.column(c).take(pa.array(rows)) for c in by]
            yield pa.RecordBatch.from_arrays([*out, pa.array([*runs, *(c for _, c in other)], pa.string()), pa.array(np.concatenate([n, np.array(list(other.values()), np.int64)]))], [*by, "codon", "n"])

    return run


def tally(records: DataFrame, by: tuple[str, ...] = (), codons: int = 1) -> DataFrame:
    """(by..., codon, n): full codons of records' sequences in capitals, or runs of neighbouring ones, counted in each batch before they are shuffled."""
    rows = records.select(*by, "sequence")
    schema = T.StructType([*(rows.schema[c] for c in by), T.StructField("codon", T.StringType()), T.StructField("n", T.LongType())])
    return rows.mapInArrow(_tallied(list(by), codons), schema).groupBy(*by, "codon").agg(F.sum("n").alias("n"))


def genetic_code(spark: SparkSession, table: int = 2) -> DataFrame:
    """(codon, aa) of the 64 codons: a dimension of fixed size."""
    return spark.createDataFrame([(c,) for c in CODONS], "codon string").select("codon", C.amino_acid(F.col("codon"), table).alias("aa"))


def usage_frequency(records: DataFrame) -> DataFrame:
    """(codon, n, freq) over all records, partial codons included."""
    counts = records.select(F.explode(C.chunked(F.upper("sequence"), partial=True)).alias("codon")).groupBy("codon").agg(F.count("*").alias("n"))
    return counts.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy()))


def codon_counts(records: DataFrame, genes: tuple[str, ...] | None = None, table: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., aa, codon, n): sense codons of full length, per amino acid."""
    rows = records.where(F.col("gene_name").isin(*genes)) if genes else records
    return sense_counts(tally(rows, by), table, by)


def sense_counts(counts: DataFrame, table: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., aa, codon, n) of the sense codons among counts (by..., codon, n): a codon is translated once, not at each of its places."""
    rows = counts.where(~F.col("codon").isin(*C.STOPS)).withColumn("aa", C.amino_acid(F.col("codon"), table)).where("aa not in ('*', 'X')")
    return rows.select(*by, "aa", "codon", "n")


def top_codon(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., aa, codon): the commonest codon; ties go to the alphabetically first."""
    # The smallest of (-n, codon): one grouped minimum, no window.
    best = counts.groupBy(*by, "aa").agg(F.min(F.struct((-F.col("n")).alias("m"), "codon")).alias("best"))
    return best.select(*by, "aa", F.col("best.codon").alias("codon"))


def complete(table: DataFrame, spark: SparkSession) -> DataFrame:
    """A look-up table (aa, codon) for all 20 residues: those that it lacks get their alphabetically first codon."""
    first = genetic_code(spark).where("aa <> '*'").groupBy("aa").agg(F.min("codon").alias("first"))
    return first.join(table, "aa", "left").select("aa", F.coalesce("codon", "first").alias("codon"))


def lookup_table(records: DataFrame, spark: SparkSession, genes: tuple[str, ...] | None = None) -> DataFrame:
    """(aa, codon) of all 20 residues: the commonest codon in the records of some genes."""
    return complete(top_codon(codon_counts(records, genes)), spark)


def copy_fallback(records: DataFrame, by: str = "gene_name") -> DataFrame:
    """(by, aa, codon): the commonest codon at each residue of the protein column, whatever the codon codes for.

    Where protein and codons differ in length the longer one's rest does not count.
    """
    pairs = C.let(F.struct(F.filter(F.split("protein", ""), lambda a: a != "").alias("p"), C.chunked(F.upper("sequence")).alias("c")),
                  lambda x: F.slice(F.arrays_zip(x["p"].alias("aa"), x["c"].alias("codon")), 1, F.least(F.size(x["p"]), F.size(x["c"]))))
    rows = records.select(by, F.explode(pairs).alias("x")).select(by, F.col("x.aa").alias("aa"), F.col("x.codon").alias("codon"))
    return top_codon(rows.groupBy(by, "aa", "codon").agg(F.count("*").alias("n")), (by,))


def constraint_table(spark: SparkSession) -> DataFrame:
    """(aa, codon) of every codon that a residue allows; a stop allows the four stop codons."""
    return genetic_code(spark)


def rscu_weights(records: DataFrame, spark: SparkSession, genes: tuple[str, ...] | None = None) -> DataFrame:
    """(aa, codon, n, weight): count over the largest count among synonyms; 1 / synonyms for amino acids never seen."""
    code = genetic_code(spark).where("aa <> '*'")
    counts = codon_counts(records, genes).select("codon", "n")
    w = Window.partitionBy("aa")
    joined = code.join(counts, "codon", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = F.max("n").over(w)
    return joined.select("aa", "codon", "n", F.when(most > 0, F.col("n") / most).otherwise(1 / F.count("*").over(w)).alias("weight"))


def gene_counts(records: DataFrame) -> DataFrame:
    """(gene_name, codon, n) of all full codons: what every table of some genes can be made of."""
    return tally(records, ("gene_name",))


def pooled(counts: DataFrame) -> DataFrame:
    """(codon, n) of counts by gene."""
    return counts.groupBy("codon").agg(F.sum("n").alias("n"))


def off_ata(table: DataFrame) -> DataFrame:
    """A look-up table with isoleucine moved off ATA to its first other codon."""
    other = F.when((F.col("aa") == "I") & (F.col("codon") == "ATA"), F.lit("ATC")).otherwise(F.col("codon"))
    return table.withColumn("codon", other)


def standard_remap(records: DataFrame, spark: SparkSession) -> DataFrame:
    """(aa, codon) of all 20 residues by the standard code, with isoleucine moved off ATA to its first other codon."""
    return off_ata(complete(top_codon(codon_counts(records, table=1)), spark))


def with_cai(records: DataFrame, weights: DataFrame, seq: str = "sequence", out: str = "cai") -> DataFrame:
    """Adds the geometric mean of the codons' weights; the last three letters, stops and zero weights do not count."""
    table = {r["codon"]: math.log(r["weight"]) for r in weights.where("weight > 0").collect()}  # at most 64 rows
    logs = np.array([table.get(c, np.nan) for c in CODONS])

    @F.arrow_udf(returnType=T.DoubleType())
    def mean(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return pa.array([], pa.float64())
        odd, owner, number = _runs(texts, 1, without=3)
        value = logs[number]
        some = ~np.isnan(value)
        total, n = (np.bincount(owner[some], w[some], len(texts)).astype(float) for w in (value, np.ones(len(value))))
        for r in np.flatnonzero(odd).tolist():
            text = texts[r].as_py().upper()
            found = [table[c] for i in range(0, len(text) - 5, 3) if (c := text[i : i + 3]) in table]
            total[r], n[r] = sum(found), len(found)
        return pa.array(np.where(n > 0, np.exp(total / np.maximum(n, 1)), 0.0))

    return records.withColumn(out, mean(F.col(seq)))


def transition_counts(records: DataFrame) -> DataFrame:
    """(from, to, n) of neighbouring full codons of known letters."""
    # Neighbours stand in one string, which is counted before it is taken apart.
    counts = tally(records, codons=2).withColumnRenamed("codon", "p").where(F.col("p").rlike("^[ACGT]{6}$"))
    return counts.select(F.substr("p", F.lit(1), F.lit(3)).alias("from"), F.substr("p", F.lit(4), F.lit(3)).alias("to"), "n")


def transition_probabilities(counts: DataFrame, spark: SparkSession, smoothing: float = 1e-3) -> DataFrame:
    """(from, to, p) for all 64 x 64 pairs, rows adding up to 1 after smoothing."""
    all_codons = spark.createDataFrame([(c,) for c in CODONS], "codon string")
    # 4,096 pairs whatever the input's size.
    grid = all_codons.select(F.col("codon").alias("from")).crossJoin(all_codons.select(F.col("codon").alias("to")))
    dense = grid.join(counts, ["from", "to"], "left").withColumn("m", F.coalesce("n", F.lit(0)) + smoothing)
    return dense.select("from", "to", (F.col("m") / F.sum("m").over(Window.partitionBy("from"))).alias("p"))


def transition_divergence(counts_p: DataFrame, counts_q: DataFrame, spark: SparkSession, smoothing: float = 1e-3) -> DataFrame:
    """One row: Kullback-Leibler divergence of transition rows, weighted by how often p leaves each codon."""
    p, q = transition_probabilities(counts_p, spark, smoothing), transition_probabilities(counts_q, spark, smoothing)
    share = counts_p.groupBy("from").agg(F.sum("n").alias("m")).withColumn("w", F.col("m") / F.sum("m").over(Window.partitionBy()))
    rows = p.join(q.withColumnRenamed("p", "q"), ["from", "to"]).join(share, "from")
    return rows.agg(F.coalesce(F.sum(F.col("w") * F.col("p") * F.ln(F.col("p") / F.col("q"))), F.lit(0.0)).alias("kl"))


def transition_chi2(counts_reference: DataFrame, counts_observed: DataFrame, spark: SparkSession, least_row: int = 5, least_expected: float = 1e-6) -> DataFrame:
    """One row: chi2, dof, n and Cohen's w of observed transitions against the reference's smoothed probabilities.

    Of each codon that is left least_row times or more, all successors with an
    expected count above least_expected are compared, where there are two or more.
    """
    p = transition_probabilities(counts_reference, spark)
    rows = counts_observed.groupBy("from").agg(F.sum("n").alias("row")).where(F.col("row") >= least_row)
    cells = p.join(rows, "from").withColumn("expected", F.col("p") * F.col("row")).where(F.col("expected") > least_expected)
    gap = F.coalesce("n", F.lit(0)) - F.col("expected")
    rows = cells.join(counts_observed.select("from", "to", "n"), ["from", "to"], "left").groupBy("from")
    rows = rows.agg(F.sum(gap * gap / F.col("expected")).alias("x"), (F.count("*") - 1).alias("d"), F.first("row").alias("n")).where("d > 0")
    total = rows.agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("chi2"), F.coalesce(F.sum("d"), F.lit(0)).alias("dof"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return total.withColumn("cohens_w", F.when(F.col("n") > 0, F.sqrt(F.col("chi2") / F.col("n"))).otherwise(0.0))
