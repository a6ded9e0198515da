"""Queries that do more than their SQL twins say, by brute force."""

from pyspark.sql import functions as F

from lexforge.operators import retrieval
from lexforge.plans import analytics_queries, corpus_queries, evidence_queries


def test_own_vector_takes_no_rank(spark, tmp_path):
    rows = [(100, [1.0, 0.0], "a"), (1, [1.0, 0.1], "a"), (2, [0.0, 1.0], "b"), (200, [0.0, 1.0], "b")]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.query_id: (r.best_rank, r.hit_at_1) for r in analytics_queries.embedding_hit_at_k(spark, str(tmp_path)).collect()}
    assert got == {100: (1, 1), 200: (1, 1)}


def test_sentences_of_every_language(spark, small):
    texts = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id for r in texts.filter(F.col("text").rlike(r"\S")).select("doc_id").collect()}
    assert {r.doc_id for r in corpus_queries.sentence_statistics(spark, small).collect()} == want


def test_lone_case_object_matches(spark, tmp_path):
    items = "review_item_id string, exported_at int, source_id string, run_id string, query string, family string"
    spark.createDataFrame([("i1", 1, "r:zz", "r", "q1", "f"), ("i2", 1, "r:c2", "r", "none", "f"), ("i3", 1, "r:zz", "r", "q9", "f")], items).write.parquet(f"{tmp_path}/review_queue.parquet")
    runs = [("a", 1, '{"case_id": "c1", "query": "q1", "family": "f"}'), ("b", 1, '[{"case_id": "c2", "query": "q2"}]')]
    spark.createDataFrame(runs, "source_path string, loaded_at int, cases string").write.parquet(f"{tmp_path}/trace_runs.parquet")
    got = {r.item_id for r in evidence_queries.review_items_with_case(spark, str(tmp_path)).collect()}
    assert got == {"i1", "i2"}


def test_overlong_query_vector_hides_no_other(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "id bigint, vector array<double>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [])], "query_id bigint, vector array<double>")
    assert {(r.query_id, r.id) for r in retrieval.cosine(vectors, queries, 5).collect()} == {(10, 1), (11, 2)}
