"""Stages by the state of their inputs, work that goes on, and a stream that counts once."""

import os

import pytest
from helixframe.plans import catalog
from helixframe.sources import stages
from helixframe.streaming import counts
from pyspark.sql import functions as F


def write(spark, path, values):
    spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).write.mode("overwrite").parquet(path)


def test_a_changed_file_changes_the_stage(spark, tmp_path):
    source, store, built = f"{tmp_path}/in", stages.Store(spark, f"{tmp_path}/store"), []

    def build(limit=0):
        built.append(1)
        return spark.read.parquet(source).where(F.col("v") > limit)

    write(spark, source, [1, 2])
    first = [sorted(r.v for r in store.stage("t", [source], build).collect()) for _ in range(2)]
    assert first == [[1, 2]] * 2 and len(built) == 1
    assert [r.v for r in store.stage("t", [source], lambda: build(1), limit=1).collect()] == [2] and len(built) == 2
    write(spark, source, [1, 2, 3])
    assert store.stage("t", [source], build).count() == 3 and len(built) == 3
    (file,) = [p for p in (tmp_path / "in").iterdir() if p.suffix == ".parquet"]
    os.utime(file, (1, 1))
    store.stage("t", [source], build)
    assert len(built) == 4
    kept = store.path("t", [source])
    store.forget("t", keep=kept)
    assert store.done(kept) and len(list((tmp_path / "store" / "t").iterdir())) == 1


def test_many_files_have_a_fingerprint_too(spark, tmp_path, monkeypatch):
    write(spark, f"{tmp_path}/a", [1])
    monkeypatch.setattr(stages, "LISTED", 0)
    one = stages.fingerprint(spark, [f"{tmp_path}/a"])
    assert one == stages.fingerprint(spark, [f"{tmp_path}/a"]) != stages.fingerprint(spark, [f"{tmp_path}/a"], x=1)
    write(spark, f"{tmp_path}/a", [1, 2])
    assert one != stages.fingerprint(spark, [f"{tmp_path}/a"])


def test_a_run_that_ended_between_writing_and_committing(spark, tmp_path):
    source, store = f"{tmp_path}/in", stages.Store(spark, f"{tmp_path}/store")
    write(spark, source, [1, 2])
    path = store.path("t", [source])
    write(spark, path, [99])
    os.remove(f"{path}/_SUCCESS")  # its files are there, its commit is not
    assert not store.done(path)
    assert sorted(r.v for r in store.stage("t", [source], lambda: spark.read.parquet(source)).collect()) == [1, 2]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.stage("u", [source], lambda: spark.read.parquet(source).withColumn("w", F.expr("1 div (v - 2)")))
    assert not store.done(store.path("u", [source]))


def test_work_goes_on_where_it_stopped(spark, tmp_path):
    done, seen = f"{tmp_path}/done", []

    def build(rest):
        seen.append(sorted(r.id for r in rest.collect()))
        return rest.withColumn("twice", F.col("id") * 2)

    assert stages.resume(spark.range(3), done, ["id"], build).count() == 3
    out = stages.resume(spark.range(5), done, ["id"], build)
    assert sorted((r.id, r.twice) for r in out.collect()) == [(i, 2 * i) for i in range(5)]
    stages.resume(spark.range(5), done, ["id"], build)
    assert seen == [[0, 1, 2], [3, 4]]


def test_provenance(spark, tmp_path):
    write(spark, f"{tmp_path}/a", [1])
    row = stages.provenance(spark, [f"{tmp_path}/a"], seed=4).first()
    assert row.config == '{"seed": 4}' and row.spark_version == spark.version and row.settings["spark.master"].startswith("local")


def test_the_stream_counts_each_record_once(spark, tmp_path):
    source, folder, checkpoint = tmp_path / "in", f"{tmp_path}/counts", tmp_path / "cp"
    schema = "gene_name string, sequence string"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(source / name))
    stream = lambda: spark.readStream.schema(schema).parquet(f"{source}/*")
    rows = lambda: {(r.gene_name, r.codon): r.n for r in counts.totals(spark, folder).collect()}
    assert rows() == {}
    put("1", [("ND1", "ATGATGCCC")])
    counts.follow(stream(), folder, str(checkpoint)).awaitTermination(120)
    assert rows() == {("ND1", "ATG"): 2, ("ND1", "CCC"): 1}
    put("2", [("ND1", "ATG"), ("COX1", "GGG")])
    counts.follow(stream(), folder, str(checkpoint)).awaitTermination(120)
    after = {("ND1", "ATG"): 3, ("ND1", "CCC"): 1, ("COX1", "GGG"): 1}
    assert rows() == after
    # The second batch was written, but the stream ended before it noted that: it runs again.
    os.remove(checkpoint / "commits" / "1")
    os.remove(checkpoint / "commits" / ".1.crc")
    counts.follow(stream(), folder, str(checkpoint)).awaitTermination(120)
    assert rows() == after


def test_queries_follow_their_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = docs.where("doc_id < 20")
    few.write.parquet(f"{tmp_path}/documents.parquet")
    count = lambda: {r.gene_name: r.n for r in catalog.queries()["conditions"](spark, str(tmp_path)).collect()}
    first = count()
    docs.where("doc_id < 60").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert sum(count().values()) > sum(first.values())
