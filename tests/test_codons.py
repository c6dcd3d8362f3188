"""Edge rows of the column functions: empty, null, partial codons, case, stops."""

import math

import pytest

from helixframe.functions import codons as C
from pyspark.sql import functions as F


def one(spark, seq, column):
    return spark.createDataFrame([(seq,)], "s string").select(column(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("seq, gc", [("", 0.0), (None, 0.0), ("AC", 0.5), ("acgt", 0.5), ("GGCC", 1.0)])
def test_gc(spark, seq, gc):
    assert one(spark, seq, C.gc_content) == gc


@pytest.mark.parametrize("seq, skew", [("", 0.0), ("AT", 0.0), ("GGC", 1 / 3), ("c", -1.0)])
def test_skew(spark, seq, skew):
    assert one(spark, seq, C.gc_skew) == pytest.approx(skew)


@pytest.mark.parametrize("seq, full, partial", [("", [], []), ("AC", [], ["AC"]), ("ATGAC", ["ATG"], ["ATG", "AC"]), ("ATGTAA", ["ATG", "TAA"], ["ATG", "TAA"])])
def test_codons(spark, seq, full, partial):
    assert one(spark, seq, C.chunked) == full
    assert one(spark, seq, lambda s: C.chunked(s, partial=True)) == partial


def test_translation_table(spark):
    assert one(spark, "ATGTGAATAAGATAA", lambda s: C.translated(C.chunked(s))) == "MWM**"


def test_diversity_and_bleu(spark):
    assert one(spark, "AAACCC", lambda s: C.diversity(C.chunked(s))) == pytest.approx(1.0)
    assert one(spark, "AAACCCGGGTTTAAA", lambda s: C.bleu(C.chunked(s), C.chunked(s))) == pytest.approx(1.0)
    assert one(spark, "", lambda s: C.bleu(C.chunked(s), C.chunked(s))) == 0.0
    assert math.isfinite(one(spark, "AAACCC", lambda s: C.bleu(C.chunked(F.lit("GGGTTTAAA")), C.chunked(s))))
