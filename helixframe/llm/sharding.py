"""Reproducible shuffle into shards by a permutation of global row numbers.

Rows get a gapless number 0..N-1 (by bucket of the id's hash, then id), and a
Feistel network permutes the numbers; shard and slot are remainder and
quotient of the permuted number. Only DataFrame functions are used.

Defined results: a null text has size 1 and checksum 0; a null id is placed by
the hash of its text; repeated rows each get a place of their own; an empty
table gives an empty table; columns of the input other than id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rounds of the Feistel network.
ROUNDS = 6
#: Buckets that rows are numbered in; the table of their sizes has as many rows.
BUCKETS = 4096


def _keyed(value: Column, key: int, modulus: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(key), value), modulus)


def feistel(number: Column, a: Column, b: Column, seed: int) -> Column:
    """One pass of the network over pairs (number div b, number mod b) in Z_a x Z_b."""
    left, right = F.floor(number / b).cast("long"), F.pmod(number, b)
    state = F.struct(left.alias("l"), right.alias("r"))
    for k in range(ROUNDS):
        # A one-element transform binds the state, so the tree does not double each round.
        if k % 2:
            step = lambda s, k=k: F.struct(s["l"].alias("l"), F.pmod(s["r"] + _keyed(s["l"], seed + k, b), b).alias("r"))
        else:
            step = lambda s, k=k: F.struct(F.pmod(s["l"] + _keyed(s["r"], seed + k, a), a).alias("l"), s["r"].alias("r"))
        state = F.transform(F.array(state), step)[0]
    return F.transform(F.array(state), lambda s: s["l"] * b + s["r"])[0]


def permuted(number: Column, total: Column, seed: int) -> Column:
    """The place of a row number in a permutation of 0..total-1.

    The network permutes a*b >= total numbers with a*b - total < a ~ sqrt(total);
    a result outside walks on along its cycle. A walk can visit each of the
    fewer than a outside numbers once, and goes outside with probability
    below 1/sqrt(total) a step, so 64 steps end it; if ever not, the job fails
    instead of giving two rows one place.
    """
    a = F.greatest(F.ceil(F.sqrt(total.cast("double"))).cast("long"), F.lit(1).cast("long"))
    b = F.greatest(F.ceil(total / a).cast("long"), F.lit(1).cast("long"))
    first = feistel(number, a, b, seed)
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)), first, lambda at, _: F.when(at < total, at).otherwise(feistel(at, a, b, seed))
    )
    place = F.when(first < total, first).otherwise(walked)
    return F.when(place < total, place).otherwise(F.raise_error(F.lit("the cycle walk did not end")).cast("long"))


def permute_reference(number: int, total: int, seed: int, h) -> int:
    """The same permutation for one number; h(key, value) is Spark's xxhash64."""
    a = max(math.isqrt(max(total - 1, 0)) + 1 if math.isqrt(total) ** 2 != total else math.isqrt(total), 1)
    b = max(-(-total // a), 1)
    at = number
    while True:
        left, right = divmod(at, b)
        for k in range(ROUNDS):
            if k % 2:
                right = (right + h(seed + k, left) % b) % b
            else:
                left = (left + h(seed + k, right) % a) % a
        at = left * b + right
        if at < total:
            return at


def numbered(df: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """Adds row_number 0..N-1 and total N; the order is by hash bucket, then key.

    A row number needs no pass through one task: ranks within a bucket plus the
    sizes of the buckets before it. The size table has at most ``buckets`` rows,
    which bounds the broadcast. It is read off the ranks, so that the rows are
    shuffled once.
    """
    w = Window.partitionBy("__bucket").orderBy(F.col(key).asc_nulls_first(), *[F.col(c) for c in df.columns if c not in (key, "__bucket")])
    ranked = df.withColumn("__rank", F.row_number().over(w).cast("long"))
    sizes = ranked.groupBy("__bucket").agg(F.max("__rank").alias("__n"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "__bucket",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long").alias("__before"),
        F.sum("__n").over(Window.partitionBy()).cast("long").alias("total"),
    )
    return (
        ranked.join(F.broadcast(offsets), "__bucket")
        .withColumn("row_number", F.col("__before") + F.col("__rank") - 1)
        .drop("__bucket", "__rank", "__before")
    )


def shard(documents: DataFrame, shards: int = 16, seed: int = 20240101, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every document.

    Shard sizes in rows differ by one at most and slots are gapless in each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    light = documents.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # By id and text: rows that repeat an id, or have none, are dealt to all buckets by their texts.
        F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(buckets)).alias("__bucket"),
    )
    place = permuted(F.col("row_number"), F.col("total"), seed)
    return (
        numbered(light, "doc_id", buckets)
        .withColumn("place", place)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
            F.floor(F.col("place") / shards).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "row_number",
        )
    )
