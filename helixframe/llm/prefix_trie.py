"""The trie of shared beginnings of conversations.

Blocks of 2**k turns get dense numbers, level by level: a block's number stands
for the pair of numbers of its halves, so that equal blocks have equal numbers.
A prefix of d turns is a chain of such blocks, as the bits of d say, and is
named by the number of the prefix without its last block and that block's
number. Both take as many join rounds as the longest conversation has binary
digits. Equal prefixes then have equal numbers and are grouped into nodes.

A node's smallest member owns it. The nodes below a node are owned by its
members, at its depth or deeper: a sum over a subtree is, for each member, a sum
from that depth on over the nodes that it owns, and so takes no round per level.

Defined results: conversations are the different conv_ids; rows without one
belong to none and are left out. Turns of one number stand in the order of the
SHA-256 of their role and text, null numbers first; repeated rows are turns of
their own. A null role or text is empty. ``%`` is SQL's: negative numbers are cut
towards zero. A table without conversations has no nodes. Texts are reduced to
digests and word counts where they are read, whatever their length; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.ranking import positions
from helixframe.session import discard, materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Neighbouring conversations that share the first one's opening turns, and how many turns they share at most, less one.
FAMILY, OPENING = 20, 4
#: Conversation numbers that are joined into one string.
CHUNK = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position from 0, content (digest of role and text), n_words; one row a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The role's length ahead tells where the text begins.
    content = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        content.alias("content"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"))
    return positions(rows, ["conv_id"], ["turn", "content"]).drop("turn")


def rebuilt(own: DataFrame, family: int = FAMILY, opening: int = OPENING) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths): every conversation behind the opening turns of its family's first one.

    The first crc32(conv_id) % opening turns are those of conversation
    ``conv_id - conv_id % family``, or as many as it has.
    """
    c = F.col("conv_id")
    count = materialize(own.groupBy("conv_id").agg(F.count("*").alias("n")), "trie")
    heads = count.withColumns({"base": c - c % family, "h": F.crc32(c.cast("string").cast("binary")) % opening})
    base = count.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    heads = heads.join(base, "base", "left").withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0))))
    heads = materialize(heads.withColumn("length", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "trie")
    first = own.where((c % family == 0) & (F.col("position") < opening - 1)).select(c.alias("base"), "position", "content", "n_words")
    opened = heads.where("lead > 0").select("conv_id", "base", "lead").join(first, "base").where("position < lead")
    kept = own.join(heads.select("conv_id", "h", "lead"), "conv_id").where("position >= h")
    columns = ["content", "n_words"]
    out = kept.select("conv_id", (F.col("position") - F.col("h") + F.col("lead")).alias("position"), *columns)
    out = materialize(out.unionByName(opened.select("conv_id", "position", *columns)), "trie")
    return out, materialize(heads.select("conv_id", "length"), "trie")


def named(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with a dense number from 1 for each different combination of keys as ``name``, the written numbers)."""
    seen = rows.select(*keys).distinct().withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()})
    seen = materialize(seen, "names")
    # One row for each partition that was written.
    part = seen.groupBy("__p").agg(F.count("*").alias("__n"), F.min("__m").alias("__low"))
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("__p", (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__low") + 1).alias("__shift"))
    numbers = seen.join(F.broadcast(part), "__p").withColumn("name", F.col("__m") + F.col("__shift")).drop("__p", "__m", "__shift")
    return rows.join(numbers, keys), seen


def _written(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    out, seen = named(rows, keys)
    out = materialize(out.select(*columns), "trie")
    discard(seen)
    return out


def blocks(sequence: DataFrame, levels: int) -> list[DataFrame]:
    """For each level k, (conv_id, i, name): the block of 2**k turns from turn i * 2**k on."""
    out = [_written(sequence.select("conv_id", F.col("position").alias("i"), "content"), ["content"], ["conv_id", "i", "name"])]
    for _ in range(1, levels):
        half = F.col("i") % 2
        pairs = out[-1].groupBy("conv_id", F.shiftright("i", 1).alias("i")).agg(
            F.max(F.when(half == 0, F.col("name"))).alias("a"), F.max(F.when(half == 1, F.col("name"))).alias("b"))
        out.append(_written(pairs.where("b is not null"), ["a", "b"], ["conv_id", "i", "name"]))
    return out


def prefixes(lengths: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, name): equal prefixes of one depth, and only these, have one name."""
    done = [lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("name"))]
    for k in range(len(levels) - 1, -1, -1):
        block = levels[k].where("i % 2 = 0").select("conv_id", F.shiftleft("i", k).alias("depth"), F.col("name").alias("b"))
        before = reduce(DataFrame.unionByName, done).withColumnRenamed("name", "a")
        longer = before.join(block, ["conv_id", "depth"]).withColumn("depth", F.col("depth") + (1 << k))
        done.append(_written(longer, ["depth", "a", "b"], ["conv_id", "depth", "name"]))
    out = materialize(reduce(DataFrame.unionByName, done), "trie")
    discard(*done[1:])
    return out


def _from_here_on(rows: DataFrame, by: str, order: str, values: list[str]) -> DataFrame:
    """rows with values summed over their own and all later rows of their group, which may be of any size."""
    ranges = materialize(rows.repartitionByRange(by, order).withColumn("__p", F.spark_partition_id()), "trie")
    later = Window.partitionBy(by).orderBy("__p").rowsBetween(1, Window.unboundedFollowing)
    part = ranges.groupBy(by, "__p").agg(*[F.sum(v).alias(v) for v in values])
    part = part.select(by, "__p", *[F.coalesce(F.sum(v).over(later), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy(by, "__p").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranges.withColumns({v: F.sum(v).over(inside) for v in values}).join(part, [by, "__p"])
    return sums.withColumns({v: F.col(v) + F.col(f"__{v}") for v in values}).drop("__p", *[f"__{v}" for v in values])


def _hash_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 for each run of rows with equal depth and name, over their strings joined by commas."""
    at, state = None, None
    row = lambda: pa.RecordBatch.from_pylist([{"depth": at[0], "name": at[1], "ends_sha256": state.hexdigest()}])
    for batch in batches:
        for d, name, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "name", "ids"))):
            if (d, name) == at:
                state.update(b",")
            else:
                if at:
                    yield row()
                at, state = (d, name), hashlib.sha256()
            state.update(ids.encode())
    if at:
        yield row()


def ends_digest(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """depth, name, n_ends, ends_sha256: of the conversations that end at each node.

    Numbers are joined into strings of ``chunk`` numbers; a node with several
    strings is hashed by one task that sees one string at a time, for the digest
    of a sequence cannot be put together from its parts'.
    """
    key = ["depth", "name"]
    placed = positions(ends, key, ["conv_id"]).withColumn("part", F.floor(F.col("position") / chunk))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = materialize(placed.groupBy(*key, "part").agg(ids.alias("ids"), F.count("*").alias("n")), "trie")
    sizes = parts.groupBy(*key).agg(F.sum("n").alias("n_ends"))
    short = parts.where(f"part = 0 and n < {chunk}").select(*key, F.sha2("ids", 256).alias("ends_sha256"))
    long = parts.join(parts.where(f"part = 0 and n = {chunk}").select(*key), key).select(*key, "part", "ids")
    long = long.repartition(*key).sortWithinPartitions(*key, "part").select(*key, "ids").mapInArrow(_hash_in_order, "depth long, name long, ends_sha256 string")
    return sizes.join(short.unionByName(long), key)


def nodes(sequence: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row for each different prefix of the rebuilt conversations, as the query's contract names its columns."""
    key: list[str] = ["depth", "name"]
    longest = lengths.agg(F.max("length")).first()[0] or 0
    levels = blocks(sequence, int(longest).bit_length()) if longest else []
    path = prefixes(lengths, levels)
    discard(*levels)
    ends = path.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"])
    ends = materialize(ends_digest(ends), "trie")
    group = path.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    last = sequence.select("conv_id", (F.col("position") + 1).alias("depth"), "n_words")
    above = path.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    node = group.join(ends, key, "left").join(last, ["conv_id", "depth"], "left").join(above, ["conv_id", "depth"], "left")
    saved: Column = (F.col("n_convs") - 1) * F.coalesce("n_words", F.lit(0))
    leaf = (F.col("n_convs") == F.coalesce("n_ends", F.lit(0))).cast("long")
    node = node.select(*key, "conv_id", "parent", "n_convs", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), leaf.alias("leaf"), saved.alias("saved"))
    node = materialize(node, "trie")

    own = node.select("conv_id", "depth", "leaf", "saved")
    weighed = path.join(own, ["conv_id", "depth"], "left").na.fill(0, ["leaf", "saved"])
    sums = _from_here_on(weighed, "conv_id", "depth", ["leaf", "saved"]).groupBy(*key).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    up = F.col("depth") - 1
    children = node.where("depth > 0").groupBy(up.alias("depth"), F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    parent = node.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = node.join(sums, key).join(children, key, "left").join(parent, ["depth", "parent"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node."""
    own = materialize(turns(conversations), "trie")
    return nodes(*rebuilt(own))
