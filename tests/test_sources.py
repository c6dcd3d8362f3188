"""Readers and sinks on files of the shapes that the reports have."""

import json
import os
import time

import pytest
from helixframe.sources import corpus, sinks
from helixframe.streaming.windows import hourly
from pyspark.sql import functions as F


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(data if isinstance(data, str) else json.dumps(data))
    return str(path)


def test_records_and_splits(spark, tmp_path):
    doc = {"codon_vocab": {}, "records": [{"id": "a", "gene_name": "ND1", "sequence": "ATG", "codon_tokens": [1]}, {"id": "b", "species": "s", "is_augmented": True, "source_id": "a"}]}
    rows = corpus.records_json(spark, put(tmp_path, "r.json", doc)).collect()
    assert [(r.idx, r.id, r.is_augmented, r.source_id) for r in rows] == [(0, "a", None, None), (1, "b", True, "a")]
    split = corpus.split_json(spark, put(tmp_path, "s.json", {"indices": [5, 2, 9]}), "test").collect()
    assert [(r.split, r.pos, r.idx) for r in split] == [("test", 0, 5), ("test", 1, 2), ("test", 2, 9)]


@pytest.mark.parametrize("order", [("organism", "protein", "dna"), ("dna", "extra", "organism", "protein")])
def test_organisms_by_name(spark, tmp_path, order):
    rows = [{"organism": "x", "protein": "MK_*", "dna": "atgaaataa"}, {"organism": "x", "protein": "MK", "dna": "ATG"}, {"organism": "y", "protein": "M", "dna": "ATGTAA"}, {"organism": "x", "protein": "_", "dna": "TAA"}]
    text = "\n".join([",".join(order), *(",".join(r.get(c, "0") for c in order) for r in rows)])
    got = corpus.organism_csv(spark, put(tmp_path, "o.csv", text), ["x"]).collect()
    assert [tuple(r) for r in got] == [("x", "MK", "ATGAAATAA")]


def test_reports(spark, tmp_path):
    raw = {"raw_results": {"lookup": [{"bleu": 0.5, "code_compliant": True, "mfe": float("nan")}, {"bleu": 0.25, "code_compliant": False}], "natural": [{"mt_cai": 1}]}}
    got = {(r.method, r.pos, r.metric): r.value for r in corpus.raw_results(spark, put(tmp_path, "e.json", raw)).collect()}
    assert got == {("lookup", 0, "bleu"): 0.5, ("lookup", 0, "code_compliant"): 1.0, ("lookup", 1, "bleu"): 0.25, ("lookup", 1, "code_compliant"): 0.0, ("natural", 0, "mt_cai"): 1.0}
    keyed = corpus.keyed_report(spark, put(tmp_path, "k.json", {"per": {"12": 0.5, "7": 1}}), "per", "double").collect()
    assert sorted(map(tuple, keyed)) == [(7, 1.0), (12, 0.5)]
    row = {"idx": 3, "gene": "ND1", "len_ok": True, "neighbors": [{"rank": 0, "train_idx": 8, "identity": 0.5}]}
    got = corpus.retrieval_report(spark, put(tmp_path, "t.json", {"per_sequence": [row]})).first()
    assert (got.idx, got.neighbors[0].train_idx, got.neighbors[0].identity) == (3, 8, 0.5)
    paper = {"short": "A", "venue": "V", "baselines": ["Random"], "homology_baseline": False}
    assert corpus.survey_json(spark, put(tmp_path, "p.json", {"papers": [paper]})).first().baselines == ["Random"]


def test_runs_and_their_status(spark, tmp_path):
    def run(name, losses, config=None, log=None):
        put(tmp_path, f"{name}/metrics.json", [{"epoch": i + 1, "val_loss": x} for i, x in enumerate(losses)])
        if config:
            put(tmp_path, f"{name}/config.json", {"training": config})
        if log is not None:
            put(tmp_path, f"{name}/logs/train.log", log)

    run("20260101_101010_ident70_s2", [3.0, 1.0, 2.0], {"epochs": 3}, "one\nlast line \n")
    run("20260102_101010", [3.0, 1.0, 2.0, 2.0], {"epochs": 9, "early_stopping_patience": 2}, "")
    run("20260103_101010", [3.0, 1.0], {"epochs": 9, "early_stopping_patience": 2})
    run("20260104_101010", [1.0, 2.0])
    put(tmp_path, "20260105_101010/config.json", {"training": {"epochs": 5}})
    got = {r.run[:8]: (r.epochs_completed, r.status, r.best_epoch, r.latest_log_line) for r in corpus.run_status(spark, str(tmp_path)).collect()}
    assert got == {
        "20260101": (3, "complete", 2, "last line"), "20260102": (4, "complete", 2, ""), "20260103": (2, "training", 2, ""),
        "20260104": (2, "training", 1, ""), "20260105": (0, "starting", None, ""),
    }
    seeds = {(r.tag, r.seed) for r in corpus.runs(spark, f"{tmp_path}/20260101*/metrics.json").collect()}
    assert seeds == {("ident70", 2)}


def test_lines_files_and_missing_sources(spark, tmp_path):
    path = put(tmp_path, "a.txt", "x 0.5\ny\nz 0.7")
    assert [(r.line_no, r.line) for r in corpus.numbered_lines(spark, path, r"0\.\d").collect()] == [(1, "x 0.5"), (3, "z 0.7")]
    os.utime(path, (time.time() - 900,) * 2)
    put(tmp_path, "b.txt", "new")
    assert [r.path.rsplit("/", 1)[1] for r in corpus.pending_files(spark, f"{tmp_path}/*.txt", 600).collect()] == ["a.txt"]
    assert corpus.optional(lambda p: spark.read.text(p), f"{tmp_path}/none") is None
    a, b = spark.range(1), spark.range(2)
    assert corpus.preferred(None, b) is b and corpus.preferred(a, b) is a


def test_derived_records_hold_whole_texts(spark, tmp_path):
    rows = [(1, "ab", "en", "web"), (2, "Abc-d", "en", "web"), (3, "abcdefghij " * 200, "de", "book"), (4, None, "en", "web"), (5, "TAATAG", "en", "web")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.idx: r for r in corpus.derived_records(spark, str(tmp_path)).collect()}
    assert sorted(got) == [2 * 10**7, *(3 * 10**7 + k for k in range(7)), 5 * 10**7]
    letters = ("abcdefghij" * 200).translate(str.maketrans(corpus.ALPHABET, ("ACGT" * 7)[:26]))
    whole = "".join(got[3 * 10**7 + k].sequence[:-3] for k in range(7))
    codons = [letters[i : i + 3] for i in range(0, 1998, 3)]
    assert whole == "".join("TTA" if c in ("TAA", "TAG", "AGA", "AGG") else c for c in codons)
    assert all(len(r.sequence) == 3 * len(r.protein_sequence) and "*" not in r.protein_sequence[:-1] for r in got.values())


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(5, "test"), (2, "train"), (9, "train"), (1, "test")], "idx long, split string")
    sinks.write_splits(rows, f"{tmp_path}/s", type="identity", seed="42")
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted((r.split, r.idx) for r in back.collect()) == [("test", 1), ("test", 5), ("train", 2), ("train", 9)]
    assert back.where("split = 'train'").first().construction.asDict() == {"seed": "42", "type": "identity"}
    sinks.write_report(rows.groupBy("split").count(), f"{tmp_path}/r")
    assert {(r.split, r["count"]) for r in spark.read.json(f"{tmp_path}/r").collect()} == {("test", 2), ("train", 2)}
    sinks.write_corpus(rows.select("idx"), f"{tmp_path}/c", f"{tmp_path}/cs")
    assert spark.read.parquet(f"{tmp_path}/c").count() == spark.read.parquet(f"{tmp_path}/cs").where("split = 'train_augmented'").count() == 4
    first = spark.createDataFrame([(1, 0.5), (2, 0.4)], "epoch int, loss double")
    sinks.append_history(first, None, f"{tmp_path}/h1")
    sinks.append_history(spark.createDataFrame([(2, 0.3), (3, 0.2)], "epoch int, loss double"), spark.read.schema(first.schema).json(f"{tmp_path}/h1"), f"{tmp_path}/h2")
    assert sorted((r.epoch, r.loss) for r in spark.read.json(f"{tmp_path}/h2").collect()) == [(1, 0.5), (2, 0.3), (3, 0.2)]
    good, bad = sinks.failures(spark.createDataFrame([(1, None), (2, "x")], "idx int, error string"))
    assert good.collect()[0].asDict() == {"idx": 1} and bad.first().idx == 2
    have = sinks.manifest(spark.createDataFrame([("a",), ("b",)], "path string"), spark.createDataFrame([("b",), ("c",)], "path string")).collect()
    assert {r.path: r.present for r in have} == {"a": False, "b": True}
    table = spark.createDataFrame([("x", 0.5, None), ("y", -1.0, 2.0)], "m string, a double, b double")
    assert {r.line for r in sinks.table_rows(table, "m", ("a", "b"), {"x": "X"}).collect()} == {"X & +0.5000 & --", "y & -1.0000 & +2.0000"}


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    query = hourly(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.window_start, r.event_type): r.n for r in spark.table("hours").collect()}
    assert got == {(r.window_start, r.event_type): r.n for r in hourly(events).select("window_start", "event_type", F.col("n")).collect()}
