"""Benchmark items inside documents: MinHash containment search by item size.

An item of q distinct five-word shingles is contained in a document that holds
at least ``threshold`` of them. Items are partitioned by size, each size class
from 2**c to 2**(c+1) - 1 shingles; each has the number of MinHash values (the
smallest shingle hashes of the item) that makes the search exact at its size: of
any q - ceil(threshold * q) + 1 shingles of a contained item the document holds
one. A document searches only the classes that it is large enough to hold. A long
document is probed with all its shingles, so that its length does not dilute the
likeness. Candidates are then verified by exact containment of shingle strings.

Only DataFrame functions are used. The items' side is broadcast after its rows
and bytes have been counted and found few; else the hashes are shuffled,
documents' texts never are.

Defined results: words are lower-cased runs of letters and digits; a text of
fewer than five words has one shingle, all its words; null and empty texts, and
items without words, match nothing; `contained` ignores rows without an id and
takes the best row of repeated ids; `clean` judges every row by its own text;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.fingerprints import SHINGLE, let, shingle_hashes, words_of
from helixframe.session import materialize

THRESHOLD = 0.8
TOKEN = r"[\p{L}\p{N}]+"
#: Rows that may be broadcast, and bytes of their strings.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def _words(text: Column) -> Column:
    return words_of(F.lower(text), TOKEN)


def _shingles(words: Column, n: int = SHINGLE) -> Column:
    """Distinct shingles as strings."""

    def of(w):
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
        return (
            F.when(F.size(w) >= n, F.array_distinct(runs))
            .when(F.size(w) > 0, F.array(F.array_join(w, " ")))
            .otherwise(F.array().cast("array<string>"))
        )

    return let(words, of)


def item_signatures(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item_id, size_class, hash): the MinHash values of each item's size partition."""
    hashed = items.where("item_id is not null").select(
        "item_id", F.sort_array(F.array_distinct(shingle_hashes(_words(F.col("text"))))).alias("h")
    ).where(F.size("h") > 0)
    q = F.size("h")
    # Sizes from 2**c to 2**(c+1) - 1 are one partition; the largest item in it decides.
    size_class = F.floor(F.log2(q)).cast("int")
    top = F.pow(F.lit(2.0), size_class + 1) - 1
    values = (top - F.ceil(F.lit(threshold) * top) + 1).cast("int")
    # A tolerance below one rounding step keeps ceil(threshold * q) exact.
    own = (q - F.ceil(F.lit(threshold) * q - 1e-9) + 1).cast("int")
    return hashed.select("item_id", size_class.alias("size_class"), F.explode(F.slice("h", 1, F.greatest(values, own))).alias("hash"))


def _sized(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> DataFrame:
    """The frame, to be broadcast if it has few rows and few bytes in strings."""
    texts = [F.octet_length(F.col(f.name)) for f in df.schema if f.dataType.simpleString() == "string"]
    n, total = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df


def _row_hash(lane: int) -> Column:
    return F.xxhash64(F.lit(lane), F.col("doc_id").isNull(), "doc_id", F.coalesce("text", F.lit("")))


def _rows(documents: DataFrame) -> DataFrame:
    """(doc_id, h, g, text): rows are told apart by 128 bits of id and text."""
    return documents.select("doc_id", _row_hash(0).alias("h"), _row_hash(1).alias("g"), "text")


def candidates(rows: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(h, g, item_id) of rows and items that share a MinHash value; a superset of the contained ones."""
    signatures = item_signatures(items, threshold)
    hashed = rows.select("h", "g", shingle_hashes(_words(F.col("text"))).alias("s"))
    # Repeats in a document only make its count larger, and so the classes that it searches.
    largest = F.floor(F.log2(F.greatest(F.size("s"), F.lit(1)) / F.lit(threshold)) + 1e-9)
    probes = hashed.select("h", "g", largest.alias("largest"), F.explode("s").alias("hash"))
    return probes.join(_sized(signatures, broadcast_rows), "hash").where("size_class <= largest").select("h", "g", "item_id").distinct()


def _matches(documents: DataFrame, items: DataFrame, threshold: float, broadcast_rows: int) -> DataFrame:
    """(doc_id, h, g, item_id, n_shingles, count) of every row that contains an item."""
    rows = _rows(documents)
    found = candidates(rows, items, threshold, broadcast_rows).select("h", "g").distinct()
    held = rows.join(found, ["h", "g"], "left_semi").dropDuplicates(["h", "g"]).select("doc_id", "h", "g", F.explode(_shingles(_words(F.col("text")))).alias("shingle"))
    wanted = items.where("item_id is not null").select("item_id", _shingles(_words(F.col("text"))).alias("s")).where(F.size("s") > 0)
    wanted = wanted.select("item_id", F.size("s").alias("n_shingles"), F.explode("s").alias("shingle"))
    # Shingles of a row are distinct, so counts of matches are counts of shingles.
    matched = held.join(_sized(wanted, broadcast_rows), "shingle").groupBy("doc_id", "h", "g", "item_id", "n_shingles").count()
    return matched.where(F.col("count") >= F.lit(threshold) * F.col("n_shingles") - 1e-9)


def contained(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, containment, n_matched and n_shingles of every contained item."""
    return (
        _matches(documents.where("doc_id is not null"), items, threshold, broadcast_rows)
        .groupBy("doc_id", "item_id")
        .agg(F.max("count").alias("n_matched"), F.max("n_shingles").cast("long").alias("n_shingles"))
        .withColumn("containment", F.col("n_matched") / F.col("n_shingles"))
    )


def clean(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents, all columns, whose text contains no item."""
    columns = ["`" + c.replace("`", "``") + "`" for c in documents.columns]
    rows = documents.select(F.struct(*columns).alias("all"), *(F.col("`doc_id`"), F.col("`text`")))
    keyed = rows.select("all", _row_hash(0).alias("h"), _row_hash(1).alias("g"))
    gone = _sized(materialize(_matches(rows, items, threshold, broadcast_rows).select("h", "g").distinct(), "contained"), broadcast_rows)
    return keyed.join(gone, ["h", "g"], "left_anti").select("all.*")
