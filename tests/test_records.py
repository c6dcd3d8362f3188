"""Records of long texts, and counts by one pass."""

import time

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from helixframe.functions import codons as C
from helixframe.operators import usage
from helixframe.sources.corpus import ALPHABET, derived_records


def expected(doc_id: int, text: str) -> list[tuple]:
    letters, out = "".join(c for c in text.lower() if c in ALPHABET), []
    for k in range((len(letters) - 3) // 300 + 1 if len(letters) >= 3 else 0):
        piece = letters[300 * k : 300 * k + 300]
        bases = piece.translate(str.maketrans(ALPHABET, ("ACGT" * 7)[:26]))
        codons = ["TTA" if bases[i : i + 3] in C.STOPS else bases[i : i + 3] for i in range(0, len(bases) - 2, 3)]
        residue = lambda c: C.TABLES[2][sum(w * C.BASES.index(x) for w, x in zip((16, 4, 1), c))]
        at = [ord(piece[i]) - 97 if i < len(piece) else 0 for i in (0, 2, 5)]
        out.append((doc_id * 10_000_000 + k, C.GENES[(at[0] + 3 * at[1] + 7 * at[2]) % 13], "".join(codons) + "TAA", "".join(map(residue, codons)) + "*"))
    return out


def write(path, texts):
    ids = pa.array(range(len(texts)), pa.int64())
    same = pa.array(["x"] * len(texts))
    pq.write_table(pa.table({"doc_id": ids, "text": pa.array(texts, pa.string()), "lang": same, "source": same, "n_chars": ids}), path / "documents.parquet")


def test_records_of_odd_texts(spark, tmp_path):
    texts = [None, "", "ab", "abc", "a b-c d", "zq" * 150, "zqx" * 100 + "a", "zqx" * 100 + "abc", "ÄbcßK dé" * 90, "İxyz" * 5]
    write(tmp_path, texts)
    got = derived_records(spark, str(tmp_path)).select("idx", "gene_name", "sequence", "protein_sequence").collect()
    assert sorted(map(tuple, got)) == [x for k, t in enumerate(texts) for x in expected(k, t or "")]


def test_a_long_text_takes_time_in_proportion(spark, tmp_path):
    text = "the quick brown fox jumps over a lazy dog " * 90_000
    write(tmp_path, [text])
    derived_records(spark, str(tmp_path)).agg(F.count("*")).collect()
    start = time.monotonic()
    rows = derived_records(spark, str(tmp_path)).agg(F.count("*"), F.sum(F.length("sequence")), F.max("sequence")).first()
    assert time.monotonic() - start < 8
    want = expected(0, text)
    assert tuple(rows) == (len(want), sum(len(x[2]) for x in want), max(x[2] for x in want))


def test_transitions_of_overlapping_and_unknown_codons(spark):
    df = spark.createDataFrame([("ACGACGACGAA",), ("acgNNNacg",), ("ACG",), ("",), (None,)], "sequence string")
    assert [tuple(x) for x in usage.transition_counts(df).collect()] == [("ACG", "ACG", 2)]


def test_letters_beside_each_other(spark, tmp_path):
    texts = ["Abİ", "Kab", "kıſΩÅ abc", "日本aKb\U0001f600C", "K" * 200 + "İ" * 150, "Ééİ"]
    write(tmp_path, texts)
    out = derived_records(spark, str(tmp_path))
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.select("idx", "gene_name", "sequence", "protein_sequence").collect()
    assert sorted(map(tuple, got)) == [x for k, t in enumerate(texts) for x in expected(k, t)]


def test_codons_are_counted_before_they_are_shuffled(spark):
    rows = [("x", "ACGACGTTTAC"), ("x", "acgacg"), ("y", "NNNACGé\nb"), (None, "ACG"), ("y", ""), ("y", None), ("x", "ß")]
    df = spark.createDataFrame(rows, "gene_name string, sequence string")
    got = sorted(map(tuple, usage.gene_counts(df).collect()), key=str)
    assert got == sorted([("x", "ACG", 4), ("x", "TTT", 1), ("y", "NNN", 1), ("y", "ACG", 1), ("y", "É\nB", 1), (None, "ACG", 1)], key=str)
    assert "Generate" not in usage.gene_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, usage.transition_counts(df).collect())) == [("ACG", "ACG", 2), ("ACG", "TTT", 1)]


def test_adaptation_of_odd_texts(spark):
    weights = spark.createDataFrame([("ACG", 0.5), ("TTT", 0.25), ("GGG", 0.0)], "codon string, weight double")
    texts = ["ACGTTTTAA", "acgGGGACGTAA", "NNNACGé\nbTAA", "ACG", "AC", "", None, "ACGTTTT", "GGGTAA"]
    got = usage.with_cai(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "idx int, sequence string"), weights)
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = [0.125**0.5, 0.5, 0.5, 0.0, 0.0, 0.0, 0.0, 0.5, 0.0]
    assert all(abs(r["cai"] - want[r["idx"]]) < 1e-12 for r in got.collect())


def test_skew_needs_no_join_of_sequences(spark, sf):
    from helixframe.plans import catalog

    plan = catalog.skew_pivot(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (idx" not in plan and "codontransformer_remap" not in plan


def test_tasks_grow_with_few_files(spark, tmp_path, monkeypatch):
    from helixframe import session

    write(tmp_path, ["abc def " * 40 + str(k) for k in range(500)])
    monkeypatch.setattr(session, "DEALT", (tmp_path / "documents.parquet").stat().st_size // 20)
    rows = derived_records(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 20
    assert rows.count() == 500


def test_only_what_is_asked_for_is_made(spark, tmp_path):
    texts = [None, "", "ab", "zqx" * 250 + "a", "ÄbcßK dé" * 90, *(f"some text {k}" * 50 for k in "abcdefghijklmnopq")]
    write(tmp_path, texts)
    whole = derived_records(spark, str(tmp_path))
    for columns in (("idx", "species"), ("gene_name", "split"), ("split",), ("species",), ("protein_sequence",), ("sequence", "id")):
        for split in (None, "train", "val", "test"):
            want = (whole.where(F.col("split") == split) if split else whole).select(*columns)
            got = derived_records(spark, str(tmp_path), columns, split)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "protein_sequence" not in derived_records(spark, str(tmp_path), ("gene_name", "split"))._jdf.queryExecution().optimizedPlan().toString()


def test_one_pass_writes_no_records(spark, sf):
    from helixframe.plans import catalog

    catalog.forget(spark)
    for query in (catalog.split_manifest, catalog.transition_counts, catalog.lookup_tables, catalog.holdout, catalog.generated):
        query(spark, sf).count()
    assert spark.sparkContext.applicationId not in catalog._stores
