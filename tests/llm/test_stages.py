"""The pipeline's stages on awkward rows: clashing names, null and repeated ids, null, empty and long texts, empty tables."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `__score` double, `kept` string, `n_words` int, `h` long, `k` long, `__text` string, `a.b` int"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    say = lambda n: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    item, passage = say(30), say(80)
    texts = {"item": f"{say(40)} {item} {say(40)}", "first": f"{say(30)} {passage} {say(30)}", "second": f"{say(50)} {passage} {say(20)}", "clean": say(200), "long": say(60_000)}
    rows = [(1, texts["first"]), (2, texts["second"]), (3, texts["item"]), (3, texts["clean"]), (None, None), (None, ""), (5, None), (6, texts["long"]), (7, say(150)), (7, say(150)), (None, say(90))]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, "en", "web", len(t or ""), "r", 0.5, "x", 1, 2, 3, "t", 4) for i, t in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "...")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int(i != 5), 0) for i in (1, 2, 3, 5, 6, 7)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), texts


def run(spark, folder, name, none=False):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.where(F.lit(False)) if none else docs
    return docs, STAGES[name](spark, docs, folder)


@pytest.mark.parametrize("name", list(STAGES))
def test_nothing_in_nothing_out(spark, tables, name):
    docs, out = run(spark, tables[0], name, none=True)
    assert out.collect() == []
    if name != "sentencepiece":
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


@pytest.mark.parametrize("name", [n for n in STAGES if n != "sentencepiece"])
def test_columns_go_through(spark, tables, name):
    docs, out = run(spark, tables[0], name)
    assert out.columns == docs.columns
    rest = [f"`{c}`" for c in docs.columns if c not in ("text", "n_chars")]
    assert out.select(*rest).exceptAll(docs.select(*rest)).isEmpty()


def kept(spark, tables, name):
    return [(r.doc_id, r.text) for r in run(spark, tables[0], name)[1].collect()]


def test_passages_of_earlier_documents(spark, tables):
    got, texts = kept(spark, tables, "substring dedup"), tables[1]
    assert (1, texts["first"]) in got and (3, texts["clean"]) in got and (6, texts["long"]) in got
    (second,) = [t for i, t in got if i == 2]
    words = texts["second"].split()
    assert second.split() == words[:50] + words[130:]
    assert got.count((None, None)) == got.count((None, "")) == got.count((5, None)) == 1 and len(got) == 11


def test_items_take_their_rows_only(spark, tables):
    got, texts = kept(spark, tables, "benchmark decontamination"), tables[1]
    assert len(got) == 10 and (3, texts["item"]) not in got and (3, texts["clean"]) in got


def test_near_copies_of_no_words(spark, tables):
    got = kept(spark, tables, "simhash near-dedup")
    assert sum(not t for _, t in got) == 1 and len(got) == 9


def test_tokens_of_all_rows(spark, tables):
    rows = run(spark, tables[0], "sentencepiece")[1].collect()
    assert len(rows) == 11 and all(r.parity for r in rows) and sum(r.n_tokens == 0 for r in rows) == 3
