"""The cluster bootstrap by default, against the reference's 2,000 draws done by hand."""

import hashlib
import random

import numpy as np
import pytest

from helixframe.operators import statistics


def test_default_draws(spark):
    rng = random.Random(2)
    rows = [("m", f"s{c:02d}", rng.gauss(0.1, 1)) for c in range(14) for _ in range(rng.randint(1, 4))]
    sums = {}
    for _, c, v in rows:
        sums.setdefault(c, []).append(v)
    clusters = [(sum(v), len(v)) for _, v in sorted(sums.items())]
    means = []
    for rep in range(2000):
        drawn = [clusters[int(hashlib.md5(f"0:{rep}:{slot}".encode()).hexdigest()[:12], 16) % len(clusters)] for slot in range(len(clusters))]
        means.append(sum(s for s, _ in drawn) / sum(n for _, n in drawn))
    got = statistics.cluster_bootstrap(spark.createDataFrame(rows, "method string, species string, d double"), "species", "d", ["method"]).first()
    assert (got.lo, got.hi) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=1e-9)
    assert abs(got.lo - np.quantile(means[:200], 0.025)) > 1e-6


@pytest.mark.parametrize("part", [7, 64, 4096])
def test_draws_by_parts(spark, part):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(x)) for g, k in (("a", 1), ("b", 200), ("c", 3)) for i in range(k) for x in rng.normal(i % 5, 1, rng.integers(1, 4))]
    frame = spark.createDataFrame([*rows, ("b", 3, None)], "g string, cl long, x double")
    one, two = ({r.g: r for r in statistics.split_bootstrap(f, "cl", "x", ["g"], draws=1500, part=part).collect()} for f in (frame, frame.repartition(5)))
    assert all((one[k].lo, one[k].hi) == pytest.approx((two[k].lo, two[k].hi)) for k in one)
    other = {r.g: r for r in statistics.cluster_bootstrap(frame, "cl", "x", ["g"], draws=1500).collect()}
    for g in ("a", "b", "c"):
        values = [x for k, _, x in rows if k == g]
        assert (one[g].n, one[g].clusters) == (len(values), {"a": 1, "b": 200, "c": 3}[g]) and one[g].mean == pytest.approx(np.mean(values))
        width = other[g].hi - other[g].lo
        assert one[g].lo == pytest.approx(other[g].lo, abs=0.12 * width + 1e-9) and one[g].hi == pytest.approx(other[g].hi, abs=0.12 * width + 1e-9)
    assert one["a"].lo == one["a"].hi == pytest.approx(one["a"].mean)


def test_every_replicate_draws_as_many_as_there_are(spark):
    rows = [("g", i, 1.0, float(i == 7)) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, cl long, x double, y double")
    # The weight of one cluster has mean 1 and the variance of a binomial; all weights add up to the number of clusters.
    out = statistics.split_bootstrap(frame, "cl", "y", ["g"], draws=4000, part=20).first()
    assert out.mean_of_draws * 300 == pytest.approx(1, abs=0.08) and out.sd * 300 == pytest.approx(1, abs=0.08)
    ones = statistics.split_bootstrap(frame, "cl", "x", ["g"], draws=50, part=20).first()
    assert ones.lo == ones.hi == 1.0
