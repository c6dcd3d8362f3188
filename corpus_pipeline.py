"""Five stages from raw documents to token ids.

Each stage decides by row: rows that repeat an id, or have none, are judged by
their own texts. Extra columns, whatever their names, go through all stages but
the last, which returns token ids. Null and empty texts are texts without words:
they have a score, are near copies of one another, hold no passage and no item,
and have no tokens. An empty table stays empty. Long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import decontaminate, near_copies, quality, sentencepiece_codec, substring_dedup
from helixframe.session import discard, materialize

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def _wrapped(docs: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text, with all columns in one: no operator's column can clash with theirs."""
    columns = ["`" + c.replace("`", "``") + "`" for c in docs.columns if c not in without]
    return docs.select("doc_id", "text", F.struct(*columns).alias("row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Rows that repeat an id are scored each by its text; without labels nothing is learnt, and all score the same."""
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(_wrapped(docs), trees).where(F.col("__score") >= quality.THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, Jaccard 0.8 or more, directly or by a chain."""
    return near_copies.drop(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of earlier documents; texts of which nothing is left go.

    Texts without words stay as they are. Of rows with one id none is earlier;
    rows without an id come after all others, and none of them before another.
    """
    # What is kept of a text that nothing is cut from is the text, so that it need not travel twice.
    out = substring_dedup.remove_repeats(_wrapped(docs, ("text",))).where("n_words = 0 or n_removed < n_words")
    cut = F.col("n_removed") > 0
    new = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; a row goes by its own text, whatever its id. Items without words are held by none."""
    return decontaminate.clean(_wrapped(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with what decoding and the format's own library say of them; null and empty texts have none.

    Parity is checked for every text, a second encoding that makes up about a third of the stage's time.
    """
    return sentencepiece_codec.encode(docs).drop("decoded")


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
