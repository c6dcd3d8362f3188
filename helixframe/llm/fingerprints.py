"""Bottom-k sketches of word-shingle hashes, DataFrame functions only.

A sketch is the sorted list of the k smallest distinct hashes of a text's
five-word shingles. Sketches of parts merge into the sketch of the whole, and
two sketches estimate resemblance, containment and distinct counts.

Defined results: null and empty texts have the empty sketch (fingerprint "");
two empty sketches resemble each other fully, an empty and a filled one not at
all; a text of one to four words has one shingle, its whole word sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hashes kept in a sketch; the error of a resemblance is at most 0.5 / sqrt(K).
K = 128
#: Words in a shingle.
SHINGLE = 5
WORDS = r"[^\x20\x09-\x0D]+"


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once: a transform over one element binds it."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column, pattern: str = WORDS) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """Hash of each run of n words; of the whole sequence if it is shorter."""

    def of(h):
        # Chained on the words' hashes: no shingle string is built.
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
        whole = F.array(F.aggregate(h, F.lit(n).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(h) >= n, runs).when(F.size(h) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def sketch(text: Column, k: int = K, n: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(words_of(text), n))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: share of the union's sketch that both hold."""
    def of(u):
        both = F.array_intersect(F.array_intersect(u, a), b)
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(u))

    return let(merged(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has as well."""
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    j = resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))


def fingerprint(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def merge_sketches(df: DataFrame, key: str, column: str, k: int = K) -> DataFrame:
    """One sketch per key from those of its parts, by a grouped sketch of hashes.

    Hashes are made distinct per key before the sort, and a hot key's rows are
    first merged in 64 salted groups, so that no task holds a whole key.
    """
    salted = df.groupBy(key, F.pmod(F.xxhash64(column), F.lit(64)).alias("__salt")).agg(
        F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set(column)))), 1, k).alias(column)
    )
    return salted.groupBy(key).agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(column)))), 1, k).alias(column))


#: What tells documents apart and orders them: number, whether it stands for none, hash of the text.
KEY = ["k", "none", "th"]


def neighbours(ids: DataFrame, buckets: int = 512) -> DataFrame:
    """ids with next_k, next_none and next_th: what follows each key in ascending order, the first after the last.

    Keys are cut into ranges at approximate quantiles (``buckets`` numbers), a
    window looks ahead within each range, and a table of one row a range joins
    the ranges' ends.
    """
    cuts = ids.agg(F.percentile_approx("k", F.lit([i / buckets for i in range(1, buckets)]), F.lit(20 * buckets)).alias("cuts"))
    below = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda c: c <= F.col("k")))
    # One row of at most ``buckets`` numbers is joined to every row.
    spread = ids.crossJoin(F.broadcast(cuts)).withColumn("range", below).drop("cuts")
    me = F.struct(*KEY)
    ahead = spread.withColumn("then", F.lead(me).over(Window.partitionBy("range").orderBy(*KEY)))
    firsts = spread.groupBy("range").agg(F.min(me).alias("first"))
    w = Window.orderBy("range")
    ends = firsts.select("range", F.coalesce(F.lead("first").over(w), F.min("first").over(Window.partitionBy())).alias("after"))
    then = F.coalesce("then", "after")
    return ahead.join(F.broadcast(ends), "range").select(*ids.columns, *[then[c].alias(f"next_{c}") for c in KEY])


def edited_fingerprints(documents: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likenesses.

    The edited text has its last half replaced by the start of the next
    document's text. Documents without an id come after all others. Repeated
    ids follow one another by the texts' hashes; rows that repeat id and text
    are one document in this order and each get its result.
    """
    # No key is null, as joins ask for: rows without an id have the largest number, and a mark. Both uses of the texts' shuffle read the same columns, so it is made once.
    number = F.col("doc_id").cast("long")
    docs = documents.select(F.coalesce(number, F.lit((1 << 63) - 1)).alias("k"), number.isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ids = docs.groupBy(*KEY).agg(F.max(F.floor(F.length("text") / 2).cast("int")).alias("half"))
    # What the document before needs of each text, to be sent to it with the sketch.
    wanted = neighbours(ids).select(*[F.col(f"next_{c}").alias(c) for c in KEY], *[F.col(c).alias(f"prev_{c}") for c in KEY], "half")
    # Sketches are made after the texts' shuffle, on either side: they would be half as large again as the texts.
    base = docs.join(wanted, KEY).withColumn("copy", F.row_number().over(Window.partitionBy(*KEY).orderBy("k")))
    base = base.withColumn("sketch", sketch(F.col("text"), k))
    heads = base.where("copy = 1").select(
        *[F.col(f"prev_{c}").alias(c) for c in KEY], F.expr("substring(text, 1, half)").alias("head"), F.col("sketch").alias("next_sketch")
    )
    both = base.select(*KEY, "text", "sketch").join(heads, KEY)
    edited = F.concat(F.expr("substring(text, 1, cast(length(text) - floor(length(text) / 2) as int))"), F.col("head"))
    out = both.withColumn("edited", edited).select(
        F.when(~F.col("none"), F.col("k")).cast(documents.schema["doc_id"].dataType).alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        "sketch", "next_sketch", sketch(F.col("edited"), k).alias("edited_sketch"),
    )
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained"),
    )
