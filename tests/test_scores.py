"""Measures of many sequences at once against the measures of one."""

import random

import pytest
from helixframe.functions import codons as C
from pyspark.sql import functions as F


def sequences():
    rng = random.Random(3)
    out = [(None, "ACG"), ("", ""), ("ACG", ""), ("ACGTAA", "ACGTAA"), ("ACGTT", "ACGTT"), ("TAA", "TAA"), ("ACGTAAACGT", "ACGTAATT"), ("UNKNNN", "NNNUNK")]
    for n in (*range(1, 40), 300, 303):
        one = "".join(rng.choice("ACGT") for _ in range(n))
        out.append((one, "".join(rng.choice("ACGT") if rng.random() < 0.2 else x for x in one)[: rng.choice([n, n - 1, n + 1])]))
    return out


def test_measures_of_many_are_those_of_one(spark):
    df = spark.createDataFrame(sequences(), "r string, h string").repartition(1)
    cut = lambda c: C.chunked(F.col(c), partial=True)
    rows = df.select("r", "h", C.bleu(cut("r"), cut("h")).alias("a"), C.bleu_of(F.col("r"), F.col("h")).alias("b"), C.diversity(cut("h")).alias("c"), C.diversity_of(F.col("h")).alias("d"),
                     C.complies(C.translated(C.chunked(F.col("h")))).alias("e"), C.complies_within(F.col("h")).alias("f")).collect()
    for x in rows:
        assert x.b == pytest.approx(x.a, rel=1e-12), (x.r, x.h)
        assert x.d == pytest.approx(x.c, abs=1e-12), x.h
        assert x.f == x.e, x.h


def test_orders_that_a_short_sequence_lacks_do_not_count(spark):
    """As in the SQL of the scores: a sequence of two codons has no run of three or four."""
    df = spark.createDataFrame([("ACGTAA", "ACGTAA"), ("TAA", "TAA"), ("ACGTAA", "ACCTAA")], "r string, h string")
    rows = [x.b for x in df.select(C.bleu_of(F.col("r"), F.col("h"), short="skip").alias("b")).collect()]
    assert rows == pytest.approx([1.0, 1.0, (0.5 * 1e-8) ** 0.5])


def test_lines_and_ranks_count_short_records_as_the_sql_does(spark, tmp_path):
    """Test records of one to three codons, which sf0.001 and sf0.01 lack."""
    import duckdb
    from __spark_entry__ import oracle_sql, queries
    from test_records import write

    base = ["the quick brown fox jumps over a lazy dog " * 12, "abc", "abcdef", "abcdefghi", "pack my box with five dozen liquor jugs " * 9]
    rng = random.Random(5)
    write(tmp_path, [base[(k // 10) % 5] if k % 10 == 0 else "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1500)) for k in range(60)])
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")
    for name in ("report_lines", "signed_rank", "sequence_scores"):
        got = {tuple(r[k] for k in ("method", "idx") if k in r): r for r in (x.asDict() for x in queries()[name](spark, str(tmp_path)).collect())}
        rel = db.execute(oracle_sql()[name])
        names = [c[0] for c in rel.description]
        want = [dict(zip(names, r)) for r in rel.fetchall()]
        assert len(want) == len(got) > 0
        for w in want:
            mine = got[tuple(w[k] for k in ("method", "idx") if k in w)]
            assert {k: v if isinstance(v, str) else pytest.approx(v, abs=2e-9) for k, v in w.items() if v is not None} == {k: v for k, v in mine.items() if v is not None}, name
