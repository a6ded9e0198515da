import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.functions import text as t
from pyspark.sql import functions

from lexforge.operators import analytics, chunking, grading, retrieval, stores
from lexforge.sources import documents, records
from lexforge.streaming import metrics as stream


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n!é", max_size=400), st.integers(2, 20))
def test_split_covers_the_text(text, limit):
    parts = chunking.split(text, limit)
    assert "".join(parts) == text
    assert all(chunking.tokens(p) <= limit for p in parts)


def test_sections_and_overlap():
    text = "intro\n# A\nalpha beta\n## B\ngamma. delta.\n# C\nend"
    assert [p for p, _ in chunking.sections(text)] == [[], ["A"], ["A", "B"], ["C"]]
    assert "".join(b for _, b in chunking.sections(text)) == text
    rows = list(chunking.chunks("one two three four five six", 100, 6, 2))
    assert [r[0] for r in rows] == [1] * len(rows)
    assert "".join(r[4] for r in rows[:1]) == "one two three four five six"


def test_chunk_odd_texts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "x " * 5000), (4, "y")], "document_id long, text string")
    rows = chunking.chunk(d).collect()
    assert {r.document_id for r in rows} == {"4"}
    assert all(chunking.tokens(r.child_text) <= 300 for r in rows)


def test_percentile_definitions(spark):
    values = [5, 1, 1, 9, 3, 3, 3, 8, None, 2]
    d = spark.createDataFrame([("a", v) for v in values] + [("b", None)], "k string, v int")
    s = sorted(v for v in values if v is not None)
    for q in (0.0, 0.1, 0.5, 0.95, 1.0):
        near = analytics.exact_percentiles(d, ["k"], "v", {"p": q}).collect()
        floor = analytics.exact_percentiles(d, ["k"], "v", {"p": q}, rank="floor").collect()
        assert [tuple(r) for r in near] == [("a", s[max(0, math.ceil(q * len(s)) - 1)])]
        assert [tuple(r) for r in floor] == [("a", s[int(q * (len(s) - 1))])]


def test_search_ties_nulls_and_empty(spark):
    c = spark.createDataFrame([(2, "alpha beta", 1), (1, "alpha beta", 1), (3, None, 1), (4, " ", 1), (5, "alpha gamma", 1)], "id long, text string, score int")
    q = spark.createDataFrame([(7, "alpha alpha"), (8, None), (9, "zzz")], "query_id long, text string")
    for f in (retrieval.token_overlap, retrieval.keyword):
        assert [(r.query_id, r.id) for r in f(c, q, 2).orderBy("query_id", "rank").collect()][0] == (7, 1)
        assert {r.query_id for r in f(c, q).collect()} == {7}
        assert f(c.limit(0), q).count() == 0
    assert {r.query_id for r in retrieval.bm25(c, q).collect()} == {7}
    assert retrieval.bm25(c.limit(0), q).count() == 0


def test_cosine_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(200, 8))
    v[5] = 0
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0])], "id long, vector array<double>")
    q = d.filter("id % 50 = 0 AND id < 200").selectExpr("id AS query_id", "vector")
    got = {(r.query_id, r.rank): r.id for r in retrieval.cosine(d, q, 3).collect()}
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    for i in range(0, 200, 50):
        s = np.round(n @ n[i], 6)
        s[5] = -9
        assert [got[i, k] for k in (1, 2, 3)] == sorted(range(200), key=lambda j: (-s[j], j))[:3]
    assert retrieval.cosine(d, q.limit(0)).count() == 0


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2), (1, 11, 0.1, 3)], "query_id long, id long, score double, rank int")
    b = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 4.0, 2)], "query_id long, id long, score double, rank int")
    assert [r.id for r in retrieval.fuse(a, b).orderBy("rank").collect()] == [11, 10, 12]
    assert retrieval.fuse(a.limit(0), b.limit(0)).count() == 0


def test_hit_at_k(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 5, 1)], "query_id long, id long, rank int")
    gold = spark.createDataFrame([(1, 6), (1, 6), (2, 9)], "query_id long, id long")
    rows = {r.query_id: (r.best_rank, r.hit_at_1, r.hit_at_3) for r in grading.hit_at_k(hits, gold).collect()}
    assert rows == {1: (2, 0, 1), 2: (None, 0, 0)}


def test_upsert_and_sample(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 1, "z"), ("c", 1, "w"), ("b", 4, "q")], "k string, t int, v string")
    assert sorted(map(tuple, stores.upsert(old, new, ["k"], "t").collect())) == [("a", 1, "z"), ("b", 5, "y"), ("c", 1, "w")]
    ids = spark.range(4000).select(stores.drawn(__import__("pyspark.sql.functions", fromlist=["col"]).col("id"), "s").alias("d"))
    assert 0.45 < ids.selectExpr("avg(d)").first()[0] < 0.55


def test_text_functions(spark):
    d = spark.createDataFrame([("# Head\n- a `b` [c](http://x) ```code```", "On May 5, 2024 and 2024-13-01, 3 March 2020.")], "m string, d string")
    from pyspark.sql import functions as F

    r = d.select(t.plain_text(F.col("m")).alias("p"), t.dates(F.col("d")).alias("x"), t.uuid5(F.lit("http://example.com/a")).alias("u")).first()
    assert r.p == "Head a b c"
    assert [str(x) for x in r.x] == ["2024-05-05", "2020-03-03"]
    import uuid

    assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, "http://example.com/a"))


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("# A")
    (tmp_path / "d/b.TXT").write_text("")
    (tmp_path / "d/c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d/e.docx").write_bytes(b"x")
    good, warnings = documents.read_documents(spark, str(tmp_path / "d"))
    assert sorted(r.source_name for r in good.collect()) == ["a.md"]
    assert sorted(r.warning for r in warnings.collect()) == ["no PDF converter", "unsupported file type"]
    good, warnings = documents.read_documents(spark, str(tmp_path / "d"), lambda b: (b.decode(), 1))
    assert good.count() == 2
    (tmp_path / "r").mkdir()
    for n, body in {"a": {"run_id": "r1", "generated_at_utc": "2025-01-02T00:00:00Z", "cases": [{}]}, "b": {"runner": "x"}}.items():
        (tmp_path / f"r/{n}.json").write_text(json.dumps(body))
    (tmp_path / "r/bad.json").write_text("{")
    assert [(r.run_id, r.run_order) for r in records.read_runs(spark, str(tmp_path / "r")).orderBy("run_order").collect()] == [("b", 1), ("r1", 2)]
    (tmp_path / "s.jsonl").write_text('{"id": "1", "v": 1}\nbad\n{"v": 2}\n{"id": "1", "v": 3}\n')
    assert [r.body for r in records.read_store(spark, str(tmp_path / "s.jsonl"), "id").collect()] == ['{"id": "1", "v": 3}']
    with pytest.raises(Exception):
        records.read_cases(spark, str(tmp_path / "s.jsonl"), "id string, v int").collect()
    records.append_lines(spark.range(2), str(tmp_path / "feed"))
    records.append_lines(spark.range(2), str(tmp_path / "feed"))
    assert spark.read.json(str(tmp_path / "feed")).count() == 4


def test_stream_drops_repeats(spark, small):
    s = stream.family_windows(stream.read_table(spark, small, "request_metrics"), lateness="3650 days")
    total = stream.run_to_table(s).selectExpr("sum(requests)").first()[0]
    assert total == spark.read.parquet(f"{small}/request_metrics.parquet").select("request_id").distinct().count()


def test_state_of_conversations(spark, tmp_path):
    from lexforge.streaming.shadow import last_values

    schema = "trace string, at timestamp, family string"
    spark.createDataFrame([("a", "2025-01-01 00:00:01", "x"), ("a", "2025-01-01 00:00:02", None), ("b", "2025-01-01 00:00:01", ""), (None, "2025-01-01 00:00:01", "n")], "trace string, at string, family string").selectExpr("trace", "CAST(at AS timestamp) AS at", "family").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([("a", "2025-01-01 00:00:03", "y"), ("b", "2025-01-01 00:00:02", "z")], "trace string, at string, family string").selectExpr("trace", "CAST(at AS timestamp) AS at", "family").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = {}

    def keep(batch, _):
        seen.update({r.key: (r.turns, r.last_value) for r in batch.collect()})

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = last_values(rows, "trace", "at", "family").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    assert seen == {"a": (3, "y"), "b": (2, "z")}


def test_late_rows_are_dropped_and_repeats_end_with_the_watermark(spark, tmp_path):
    """Three batches: a row behind the watermark that the first one set is late by the third (the second still takes it)."""
    schema = "request_id string, legal_family string, recorded_at timestamp, insufficient_answer int, total_tokens int"
    day = lambda d: f"2025-{d:02}-01 00:00:00"
    for n, rows in enumerate(([("a", "f", day(1)), ("b", "f", day(9))], [("a", "f", day(9))], [("late", "f", day(2)), ("b", "f", day(9)), ("c", "f", day(9))])):
        spark.createDataFrame([(i, f, t, 0, 1) for i, f, t in rows], "request_id string, legal_family string, t string, insufficient_answer int, total_tokens int").selectExpr("request_id", "legal_family", "timestamp(t) AS recorded_at", "insufficient_answer", "total_tokens").coalesce(1).write.parquet(f"{tmp_path}/{n}/x.parquet")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/*/x.parquet")
    got = sorted((str(r.window_start)[:10], r.requests) for r in stream.run_to_table(stream.family_windows(source, lateness="60 days"), "update", ["window_start", "family"]).collect())
    assert got == [("2025-01-01", 1), ("2025-09-01", 3)]


def test_upsert_stream_resumes(spark, tmp_path):
    schema = "k string, v int, at int"
    write = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    run = lambda: sorted(map(tuple, stream.upsert_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*"), ["k"], "at", f"{tmp_path}/store").collect()))
    write(0, [("a", 1, 1), ("b", 1, 1)])
    assert run() == [("a", 1, 1), ("b", 1, 1)]
    write(1, [("a", 2, 2)])
    write(2, [("b", 0, 0), ("c", 3, 1)])
    assert run() == [("a", 2, 2), ("b", 1, 1), ("c", 3, 1)] == run()
    assert len(stream._versions(spark, f"{tmp_path}/store")) == 2


def test_chunker_opening_headings_and_leftovers():
    text = "# Lease Agreement\nbetween A and B\n## Parties\nA, B\n## 1. Term\nten years\n### 1.1 Start\nnow\n"
    assert chunking.sections(text) == [(["Lease Agreement"], "# Lease Agreement\nbetween A and B\n## Parties\nA, B\n"), (["Lease Agreement", "1. Term"], "## 1. Term\nten years\n"), (["Lease Agreement", "1. Term", "1.1 Start"], "### 1.1 Start\nnow\n")]
    plain = "# Notes\nx\n## More\ny\n## 1. Term\nz\n"
    assert [p for p, _ in chunking.sections(plain)] == [["Notes"], ["Notes", "More"], ["Notes", "1. Term"]]
    long = "## Fees\n" + "Each fee is due at once. " * 60
    parts = chunking.parts_of(long, 150)
    assert len(parts) > 1 and all(p.startswith("## Fees\n") and chunking.tokens(p) <= 150 for p in parts)
    assert "".join(p.removeprefix("## Fees\n") for p in parts) == long.removeprefix("## Fees\n")
    segments = ["tiny. ", "word " * 40, "end.", "word " * 20, "last"]
    out = chunking.rebalance(segments, 100)
    assert "".join(out) == "".join(segments) and out == ["tiny. " + "word " * 40 + "end.", "word " * 20 + "last"]
    assert chunking.rebalance(segments, 5) == segments


def test_previous_value_in_buckets_equals_one_window(spark):
    rows = [(t, d, i, None if (t * 7 + d * 3 + i) % 4 == 0 else "" if i % 5 == 0 else f"v{d}{i}") for t in range(3) for d in range(6) for i in range(5)] + [(None, 0, 0, "x"), (None, 1, 0, "y")]
    d = spark.createDataFrame(rows, "t int, d int, i int, v string")
    plain = stores.previous_value(d, ["t"], ["d", "i"], ["v"])
    split = stores.previous_value(d, ["t"], ["d", "i"], ["v"], bucket=functions.col("d"))
    assert sorted(map(str, plain.select("t", "d", "i", "prior_v").collect())) == sorted(map(str, split.select("t", "d", "i", "prior_v").collect()))
    assert stores.previous_value(d.limit(0), ["t"], ["d", "i"], ["v"], bucket=functions.col("d")).count() == 0
