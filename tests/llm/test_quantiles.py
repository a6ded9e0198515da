import numpy as np
import pytest
from pyspark.sql import functions as F

from lexforge.llm import quantiles as q


def test_bucket_keeps_order_and_inverts(spark):
    values = sorted({0, 1, 5, *(2**k + d for k in range(1, 62) for d in (-1, 0, 1))})
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", q.bucket(F.col("v")).alias("b")).select("v", "b", q.bucket_low(F.col("b")).alias("low")).orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    for r in rows:
        assert 0 <= r.b < 1 << q.UNIVERSE_BITS
        assert r.low <= r.v and r.v - r.low <= r.v / (1 << (q.MANTISSA_BITS - 1))
        assert r.v >= 1 << q.MANTISSA_BITS or r.low == r.v


def test_compress_keeps_counts_and_bound():
    rng = np.random.default_rng(1)
    leaf = np.unique(rng.integers(0, 1 << 20, 30_000))
    count = rng.integers(1, 9, len(leaf))
    g, node, c = q.compress(np.zeros(len(leaf), np.int64), leaf + (1 << 20), count, 200)
    assert c.sum() == count.sum()
    assert len(node) <= 3 * 200 + 20
    again = q.compress(g, node, c, 200)
    assert again[2].sum() == count.sum()


def _rank_error(values, estimate, quantile):
    s = np.sort(values)
    wanted = max(1, int(np.ceil(quantile * len(s))))
    low, high = np.searchsorted(s, estimate, "left") + 1, np.searchsorted(s, estimate, "right")
    return 0 if low <= wanted <= max(high, low) else min(abs(wanted - low), abs(wanted - high))


@pytest.mark.parametrize("compression", [50, 1000])
def test_merged_days_within_the_bound(spark, compression):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 3 else "b", int(i % 7), int(v)) for i, v in enumerate(rng.lognormal(5, 1, 20_000))]
    d = spark.createDataFrame(rows, "k string, day int, v long")
    merged = q.merge(q.digest(d, ["k", "day"], "v", compression), ["k"], compression)
    for r in q.percentiles(merged, ["k"], (0.0, 0.01, 0.5, 0.9, 0.99, 1.0), compression).collect():
        values = np.array([v for k, _, v in rows if k == r.k])
        assert r.n == len(values)
        assert _rank_error(values, r.units, r.quantile) <= r.rank_error_bound + 1


def test_small_digests_are_exact_and_odd_input(spark):
    d = spark.createDataFrame([("a", 3), ("a", 1), ("a", None), ("a", 2), ("b", None), (None, -5), (None, 0)], "k string, v long")
    got = {(r.k, r.quantile): (r.n, r.units) for r in q.percentiles(q.digest(d, ["k"], "v"), ["k"], (0.5, 1.0)).collect()}
    assert got == {("a", 0.5): (3, 2), ("a", 1.0): (3, 3), (None, 0.5): (2, 0), (None, 1.0): (2, 0)}
    assert q.percentiles(q.merge(q.digest(d.limit(0), ["k"], "v"), ["k"]), ["k"], (0.5,)).count() == 0
