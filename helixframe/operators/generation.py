"""Baselines that write a coding sequence for a protein."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import codons as C
from helixframe.operators import usage
from helixframe.operators.editing import EQUAL, OTHER, QUERY, alignments
from helixframe.session import discard, materialize

METHODS = ("mt_cai_lookup", "random_synonymous", "most_frequent_codon", "codontransformer_remap")


def _spelled(proteins: pa.Array, codon, stops) -> pa.Array:
    """The letters codon(residues' bytes) of each protein's residues, three for each, and its stop; null for null."""
    texts = proteins.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return pa.array([], pa.string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    # A letter outside ASCII counts once, by its first byte.
    first = (data & 0xC0) != 0x80
    ends = np.concatenate([[0], np.cumsum(first)])[ends - ends[0]]
    data = data[first]
    out = np.empty((len(data) + len(texts), 3), np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(len(texts)), np.diff(ends))] = codon(data)
    ends = ends + np.arange(len(texts) + 1)
    out[ends[1:] - 1] = stops
    made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(3 * ends), pa.py_buffer(out)).cast(pa.string())
    return pc.if_else(proteins.is_valid(), made, None)


def _letters(codon: str) -> np.ndarray:
    return np.frombuffer(codon.encode(), np.uint8)


def by_lookup(protein: Column, table: dict[str, str], stop: str = "TAA") -> Column:
    """Each residue's codon and a stop; UNK for residues that the table lacks."""
    codons = np.tile(_letters("UNK"), (256, 1))
    for aa, codon in table.items():
        codons[ord(aa)] = _letters(codon)

    @F.arrow_udf(returnType=T.StringType())
    def spell(proteins: pa.Array) -> pa.Array:
        return _spelled(proteins, lambda data: codons[data], _letters(stop))

    return spell(protein)


def random_synonymous(protein: Column, idx: Column, seed: int = 0) -> Column:
    """A synonym for each residue, and a stop, by a hash of seed, idx and position; NNN for unknown residues."""
    size, options = np.ones(256, np.int64), np.tile(_letters("NNN"), (256, 6, 1))
    for aa in set(C.TABLES[2]) - {"*"}:
        found = sorted(c for c, a in zip(product(C.BASES, repeat=3), C.TABLES[2]) if a == aa)
        size[ord(aa)], options[ord(aa), : len(found)] = len(found), [_letters("".join(c)) for c in found]
    stops = np.array([_letters(s) for s in sorted(C.STOPS)])

    @F.arrow_udf(returnType=T.StringType())
    def spell(proteins: pa.Array, ids: pa.Array) -> pa.Array:
        heads = [f"{seed}:{i}:".encode() if i is not None else f"{seed}:".encode() for i in ids.to_pylist()]
        lengths = pc.utf8_length(proteins.fill_null("")).to_pylist()
        places = [b"%d" % i for i in range(max(lengths, default=0))]
        number = lambda keys: np.frombuffer(b"".join([md5(k, usedforsecurity=False).digest()[:4] for k in keys]), ">u4").astype(np.int64)
        drawn = number(h + p for h, n in zip(heads, lengths) for p in places[:n])
        ends = number(h + b"stop" for h in heads) % len(stops)
        return _spelled(proteins, lambda data: options[data, drawn % size[data]], stops[ends])

    return spell(protein, idx.cast("string"))


def generate_all(test: DataFrame, train: DataFrame, spark: SparkSession, keep: tuple[str, ...] = ("idx",), methods: tuple[str, ...] = (*METHODS, "natural_reference")) -> DataFrame:
    """(keep..., method, generated): the four baselines and the natural sequence, or some of them, all by one pass over the test records."""
    # One pass over the training records for all three tables: a count for each gene and codon.
    seen = materialize(usage.gene_counts(train), "counts")
    high = seen.where(F.col("gene_name").isin(*C.HIGH_EXPRESSION))
    table = lambda rows, code=2: usage.complete(usage.top_codon(usage.sense_counts(usage.pooled(rows), code)), spark)
    lookups = {"mt_cai_lookup": table(high), "most_frequent_codon": table(seen), "codontransformer_remap": usage.off_ata(table(seen, 1))}
    named = [t.select(F.lit(name).alias("name"), "aa", "codon") for name, t in lookups.items() if name in methods]
    tables: dict[str, dict[str, str]] = {name: {} for name in lookups}
    for r in reduce(DataFrame.unionByName, named).collect() if named else []:  # 20 rows a table
        tables[r["name"]][r["aa"]] = r["codon"]
    discard(seen)
    made = {name: by_lookup(F.col("protein"), t) for name, t in tables.items()}
    made["random_synonymous"] = random_synonymous(F.col("protein"), F.col("idx"))
    made["natural_reference"] = F.col("sequence")
    rows = test.select(*keep, *[made[m].alias(f"__{m}") for m in made if m in methods])
    return rows.select(*keep, F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"__{m}").alias("generated")) for m in made if m in methods])))


def generate(name: str, test: DataFrame, train: DataFrame, spark: SparkSession) -> DataFrame:
    if name not in (*METHODS, "natural_reference"):
        raise ValueError(f"unknown method {name}")
    return generate_all(test, train, spark).where(F.col("method") == name)


def augment(records: DataFrame, weights: DataFrame, variants: int = 2, seed: int = 42) -> DataFrame:
    """Originals and, after them, synonymous variants drawn by codon weight; start and stop stay.

    A variant's idx is n + idx * variants + its number, so that originals are
    those below n.
    """
    cumulative = weights.where("weight > 0").groupBy("aa").agg(F.array_sort(F.collect_list(F.struct("codon", "weight"))).alias("o"))
    # Sums up to each codon are made once, in the table of at most 20 rows, not at each place of a sequence.
    upto = lambda x, i: F.aggregate(F.slice("o", 1, i + 1), F.lit(0.0), lambda a, y: a + y["weight"])
    cumulative = cumulative.withColumn("o", F.transform("o", lambda x, i: F.struct(x["codon"].alias("codon"), upto(x, i).alias("sum"))))
    table = cumulative.agg(F.map_from_entries(F.collect_list(F.struct("aa", "o"))).alias("__t"))
    n = records.agg((F.max("idx") + 1).alias("__n"))
    rows = records.crossJoin(F.broadcast(table)).crossJoin(F.broadcast(n)).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    rows = rows.withColumn("__i", F.col("idx"))  # a name that the new idx cannot be taken for
    codons = C.chunked(F.col("sequence"))

    def draw(codon, i):
        share = F.conv(F.substr(F.md5(F.concat_ws(":", F.lit(str(seed)), "__i", "v", i)), F.lit(1), F.lit(8)), 16, 10).cast("double") / 2**32

        def chosen(options):
            return C.let(share * F.element_at(options, -1)["sum"], lambda u: F.get(F.filter(options, lambda x: x["sum"] > u), F.lit(0))["codon"])

        return F.when((i == 0) | codon.isin(*C.STOPS), codon).otherwise(F.coalesce(C.let(F.try_element_at("__t", C.amino_acid(codon)), chosen), codon))

    made = rows.select(
        (F.col("__n") + F.col("idx") * variants + F.col("v")).alias("idx"), F.concat_ws("_", "id", F.concat(F.lit("v"), "v")).alias("id"), "gene_name", "species",
        F.array_join(F.transform(codons, draw), "").alias("sequence"), "protein_sequence", F.lit(True).alias("is_augmented"), F.col("id").alias("source_id"),
    )
    return records.select("idx", "id", "gene_name", "species", "sequence", "protein_sequence").unionByName(made, allowMissingColumns=True)


def affine_map(query: str, target: str, match: float = 2, mismatch: float = -1, opening: float = -4, extending: float = -0.5) -> tuple[int, list[int], float]:
    """(identical residues, target position of each query residue or -1, score) of a global alignment with affine gaps.

    A gap of n costs opening + (n - 1) * extending. Pairs are preferred over
    gaps, then gaps in the target.
    """
    n, m = len(query), len(target)
    q, t = np.frombuffer(query.encode("utf-32-le"), np.uint32), np.frombuffer(target.encode("utf-32-le"), np.uint32)
    best = np.full((n + 1, m + 1), -np.inf)
    up, left = best.copy(), best.copy()  # gaps in the target, gaps in the query
    ramp = np.arange(m + 1) * extending
    best[0, 0] = 0
    best[0, 1:] = left[0, 1:] = opening + ramp[:-1]
    for i in range(1, n + 1):
        up[i] = np.maximum(best[i - 1] + opening, up[i - 1] + extending)
        row = up[i].copy()
        row[1:] = np.maximum(row[1:], best[i - 1, :-1] + np.where(t == q[i - 1], match, mismatch))
        # A gap in the query that opens behind column k: no gap is opened behind another of its kind.
        left[i, 1:] = np.maximum.accumulate(row[:-1] - ramp[:-1]) + opening + ramp[:-1]
        best[i] = np.maximum(row, left[i])
    i, j, state, same, places = n, m, "best", 0, [-1] * n
    while i > 0 or j > 0:
        if state == "best":
            if i and j and best[i, j] == best[i - 1, j - 1] + (match if q[i - 1] == t[j - 1] else mismatch):
                i, j = i - 1, j - 1
                places[i] = j
                same += int(q[i] == t[j])
                continue
            state = "up" if i and best[i, j] == up[i, j] else "left"
        if state == "up":
            state = "best" if up[i, j] == best[i - 1, j] + opening else "up"
            i -= 1
        else:
            state = "best" if left[i, j] == best[i, j - 1] + opening else "left"
            j -= 1
    return same, places, float(best[n, m])


RUN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("n", T.IntegerType())])


def run_length(runs: Column) -> Column:
    """The runs of an alignment as one string, such as 12=1X3I."""
    return F.array_join(F.transform(runs, lambda x: F.concat(x["n"].cast("string"), x["kind"])), "")


def identical(runs: Column) -> Column:
    """How many residues are paired with an equal one."""
    return F.aggregate(runs, F.lit(0), lambda a, x: a + F.when(x["kind"] == EQUAL, x["n"]).otherwise(0))


def target_places(runs: Column) -> Column:
    """The target's place of each residue of the query, -1 for those that are paired with none."""
    n = lambda x: x["n"]
    pair = lambda x: x["kind"].isin(EQUAL, OTHER)
    none = F.array().cast("array<int>")

    def step(a, x):
        places = F.when(pair(x), F.sequence(a["at"], a["at"] + n(x) - 1)).when(x["kind"] == QUERY, F.array_repeat(F.lit(-1), n(x))).otherwise(none)
        return F.struct(F.concat(a["places"], places).alias("places"), (a["at"] + F.when(x["kind"] == QUERY, 0).otherwise(n(x))).alias("at"))

    return F.aggregate(runs, F.struct(none.alias("places"), F.lit(0).alias("at")), step, lambda a: a["places"])


def with_runs(pairs: DataFrame) -> DataFrame:
    """Adds align_distance and runs, (kind, n) of a unit-cost alignment of q_protein and t_protein; many pairs are aligned at once."""
    schema = T.StructType([*pairs.schema.fields, T.StructField("align_distance", T.IntegerType()), T.StructField("runs", T.ArrayType(RUN))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            distance, runs = alignments(pdf["q_protein"].tolist(), pdf["t_protein"].tolist())
            yield pdf.assign(align_distance=distance.astype(np.int32), runs=[[{"kind": k, "n": n} for k, n in x] for x in runs])

    # Alignments are much work for few rows: dealt to all cores.
    return pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, schema)


def with_alignment(pairs: DataFrame, affine: bool = False) -> DataFrame:
    """Adds n_identical, pos_map and, for unit costs, align_distance or, for affine gaps, align_score."""
    if not affine:
        rows = with_runs(pairs)
        return rows.select(*pairs.columns, identical(F.col("runs")).alias("n_identical"), target_places(F.col("runs")).alias("pos_map"), "align_distance")
    schema = T.StructType([*pairs.schema.fields, T.StructField("n_identical", T.IntegerType()), T.StructField("pos_map", T.ArrayType(T.IntegerType())), T.StructField("align_score", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = [affine_map(a, b) for a, b in zip(pdf["q_protein"], pdf["t_protein"])]
            yield pdf.assign(n_identical=[x[0] for x in out], pos_map=[x[1] for x in out], align_score=[x[2] for x in out])

    return pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, schema)


def copied(rows: DataFrame, fallback: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Adds copied_sequence and copied_fraction: the neighbour's codon where an aligned residue is equal, else the gene's commonest.

    rows has gene, pos_map and the protein and sequence of query (q_) and
    neighbour (t_); fallback is (gene_name, aa, codon). A residue that the
    fallback lacks gets the query's own codon, or, given a session, its first
    synonym. Where the query has a stop, the neighbour's follows, or TAA.
    """
    per_gene = fallback.groupBy(F.col("gene_name").alias("gene")).agg(F.map_from_entries(F.collect_list(F.struct("aa", "codon"))).alias("__f"))
    rows = rows.join(per_gene, "gene", "left").withColumns({"__q": C.chunked(F.upper("q_sequence")), "__t": C.chunked(F.upper("t_sequence"))})
    empty = F.create_map().cast("map<string,string>")
    first = None
    if spark is not None:
        code = usage.genetic_code(spark).where("aa <> '*'").groupBy("aa").agg(F.min("codon").alias("codon"))
        synonyms = code.agg(F.map_from_entries(F.collect_list(F.struct("aa", "codon"))).alias("__s"))  # one row of 20 residues
        rows = rows.crossJoin(F.broadcast(synonyms))
        first = lambda a: F.try_element_at("__s", a)

    def place(i):
        a = F.substr("q_protein", i + 1, F.lit(1))
        at = F.get("pos_map", i)
        equal = (at >= 0) & (F.substr("t_protein", at + 1, F.lit(1)) == a)
        codon = F.when(equal, F.get("__t", at))
        return F.struct(F.coalesce(codon, F.try_element_at(F.coalesce("__f", empty), a), first(a) if first else F.get("__q", i), F.lit("TAA")).alias("c"), codon.isNotNull().alias("copied"))

    n, m = F.length("q_protein"), F.length("t_protein")
    placed = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), place)
    rows = rows.withColumn("__m", F.when(n > 0, placed).otherwise(F.array().cast("array<struct<c:string,copied:boolean>>")))
    own = F.try_element_at("__q", F.lit(-1)) if first else F.lit("TAA")
    stop = F.when(F.size("__q") > n, F.coalesce(F.when(F.size("__t") > m, F.get("__t", m)), own)).otherwise("")
    share = F.size(F.filter("__m", lambda x: x["copied"])) / F.greatest(n, F.lit(1))
    made = F.concat(F.array_join(F.transform("__m", lambda x: x["c"]), ""), stop)
    return rows.withColumns({"copied_sequence": made, "copied_fraction": share}).drop("__f", "__m", "__q", "__t", "__s")


def homolog_copy(pairs: DataFrame, fallback: DataFrame) -> DataFrame:
    """Copies of the nearest neighbour by a unit-cost alignment."""
    return copied(with_alignment(pairs), fallback)


def best_aligned(pairs: DataFrame) -> DataFrame:
    """Of each query's candidates (rank) the one with most identical residues under affine gaps; ties to the smaller rank."""
    rows = materialize(with_alignment(pairs, affine=True), "aligned")
    best = rows.groupBy("q_idx").agg(F.min(F.struct((-F.col("n_identical")).alias("m"), "rank")).alias("b")).select("q_idx", F.col("b.rank").alias("rank"))
    return rows.join(materialize(best, "aligned"), ["q_idx", "rank"])


def decode_with(records: DataFrame, scorer, batch: int = 64) -> DataFrame:
    """Sequences by a model: scorer(list of proteins) -> list of (n, 64) arrays of log scores in ACGT order.

    The best codon among those that code for the residue is taken; rows whose
    scorer fails carry the error instead, for a side output.
    """
    allowed = {}
    for k, codon in enumerate(usage.CODONS):
        i = [C.BASES.index(x) for x in codon]
        allowed.setdefault(C.TABLES[2][16 * i[0] + 4 * i[1] + i[2]], []).append(k)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                made, errors = [None] * len(part), [None] * len(part)
                try:
                    scores = scorer(part["protein"].tolist())
                    for r, (p, s) in enumerate(zip(part["protein"], scores)):
                        made[r] = "".join(usage.CODONS[max(allowed[a], key=lambda k: s[i][k])] if a in allowed else "NNN" for i, a in enumerate(p)) + "TAA"
                except Exception as e:  # noqa: BLE001  the side output names the failure
                    errors = [f"{type(e).__name__}: {e}"] * len(part)
                yield pd.DataFrame({"idx": part["idx"], "generated": made, "error": errors})

    return records.select("idx", "protein").mapInPandas(run, "idx long, generated string, error string")
