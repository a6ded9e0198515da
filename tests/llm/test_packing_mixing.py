import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.llm import mixing, packing, queries


def test_differencing_known_result():
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference(np.array([8, 7, 6, 5, 4]), 2))
    assert sums == [14, 16]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 12))
def test_differencing_is_a_partition(sizes, windows):
    found = packing.difference(np.array(sizes), windows)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert len(found) <= max(windows, 1)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_windows_fit(sizes):
    s = np.array(sizes)
    found = packing.fill(s, 100)
    assert sorted(i for w in found for i in w) == list(range(len(s)))
    assert max(s[w].sum() for w in found) <= 100
    # no worse than first fit's guarantee
    assert len(found) <= 2 * -(-s.sum() // 100) + 1


def test_containers_hold_every_text_once(spark, medium):
    d = queries.p6_containers(spark, medium).cache()
    loads = d.groupBy("container_id", "capacity", "container").agg(F.sum("tokens").alias("n"), F.count("*").alias("k"), F.max("position").alias("p"))
    assert loads.filter("n > capacity OR k <> p").count() == 0
    texts = d.groupBy("container_id", "capacity", "doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("k"), F.countDistinct("start_token").alias("s"))
    assert texts.filter("k <> s OR k <> ceil(n / capacity)").count() == 0
    want = mixing.sized(spark.read.parquet(f"{medium}/documents.parquet")).select("doc_id", "tokens")
    assert texts.filter("container_id = 1").select("doc_id", F.col("n").cast("int")).exceptAll(want).count() == 0
    assert texts.select("doc_id", "container_id").distinct().count() == 4 * want.count()
    used = packing.report(d).select(F.min("used_share")).first()[0]
    assert used > 0.9


def test_pack_repeated_ids_and_empty(spark):
    d = spark.createDataFrame([(1, 5, 0.1), (1, 5, 0.2), (2, 30, 0.3), (None, 4, 0.9)], "doc_id long, tokens int, salt double")
    rows = packing.pack(d, [(1, "c", 10)], 4).collect()
    assert sum(r.tokens for r in rows) == 44
    assert packing.pack(d.limit(0), [(1, "c", 10)], 0).count() == 0


def sizes(spark, spec):
    return spark.createDataFrame([(i * 1000 + j, s, n) for i, (s, k, n) in enumerate(spec) for j in range(k)], "doc_id long, source_name string, tokens int")


def test_mix_shares_and_caps(spark):
    d = sizes(spark, [("big", 3000, 100), ("small", 400, 100), ("tiny", 3, 100), ("other", 50, 100)])
    targets = spark.createDataFrame([("Big ", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.15, 2), ("none", 0.05, 3)], "source_name string, target_share double, max_repeats int")
    rates = mixing.plan(d, targets)
    got = {r.source_name: r for r in mixing.report(mixing.copies(d, rates), rates).collect()}
    assert not got["tiny"].reached and got["tiny"].used_tokens == 600 and got["tiny"].most_copies == 2
    assert not got["none"].reached and got["none"].used_tokens == 0
    assert got["big"].reached and got["small"].reached
    assert abs(got["big"].used_tokens / got["small"].used_tokens - 5 / 3) < 0.15
    assert all(r.most_copies <= r.max_repeats for r in got.values())
    assert abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    again = mixing.emit(mixing.copies(d, rates))
    assert again.exceptAll(mixing.emit(mixing.copies(d, rates))).count() == 0
    assert mixing.emit(mixing.copies(d.limit(0), mixing.plan(d.limit(0), targets))).count() == 0


def test_sources_compare_trimmed_and_lower(spark):
    d = spark.createDataFrame([(1, "a b", " Court_Filings "), (2, "a", None), (3, None, "x"), (4, "", "x")], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.sized(d).orderBy("doc_id").collect()] == [(1, "court_filings", 2), (2, None, 1)]


@pytest.mark.parametrize("name", ["p7_mix", "p7_report"])
def test_queries_run(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_targets_are_a_parameter_table(spark):
    many = spark.range(mixing.MOST_TARGETS + 1).selectExpr("cast(id AS string) AS source_name", "0.001 AS target_share", "1 AS max_repeats")
    with pytest.raises(ValueError):
        mixing.plan(sizes(spark, [("a", 1, 1)]), many)


def test_packing_is_the_same_however_the_table_is_split(spark, small):
    rows = lambda: sorted(map(tuple, queries.p6_containers(spark, small).collect()))
    first = rows()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert rows() == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
