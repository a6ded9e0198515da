"""Scores of whole batches of queries stay in the tasks that read the documents."""

import math
import pathlib
from collections import Counter
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lexforge.functions.text import whitespace_tokens
from lexforge.operators import retrieval, scoring
from lexforge.session import shared_dir


def shuffled(df) -> int:
    """Rows that the plan of df wrote to shuffles."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ShuffleExchangeExec":
            total += node.metrics().get("shuffleRecordsWritten").get().value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


@pytest.mark.parametrize("name", ["bm25", "keyword", "token_overlap"])
def test_sums_of_pairs_stay_in_their_tasks(spark, name):
    c = spark.range(2000, numPartitions=4).selectExpr("id", "concat('the term', id % 7, ' of ', id) AS text")
    q = c.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "text")
    hits = getattr(retrieval, name)(c.repartition(4), q)  # no known partitioning by id
    assert shuffled(hits) <= 2000 + 40 * 10 * 4
    assert hits.count() == 400


def _brute(name, corpus, queries, k):
    docs = {i: Counter(t.split()) for i, t in corpus}
    mean = sum(d.total() for d in docs.values()) / len(docs)
    df = Counter(t for d in docs.values() for t in d)
    idf = {t: math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    rows = set()
    for i, text in queries:
        q, found = Counter(text.split()), []
        for j, d in docs.items():
            if both := q.keys() & d.keys():
                if name == "bm25":
                    score = sum(idf[t] * q[t] * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * d.total() / mean)) for t in both)
                else:
                    score = sum(q[t] * (1 + (name == "keyword") * d[t] / d.total()) for t in both) / q.total()
                found.append((-float(Decimal(repr(score)).quantize(Decimal("1e-6"), ROUND_HALF_UP)), j))
        rows |= {(i, j, rank, -score) for rank, (score, j) in enumerate(sorted(found)[:k], 1)}
    return rows


@pytest.mark.parametrize("name", ["bm25", "keyword", "token_overlap"])
@pytest.mark.parametrize("filled", [0, 0.002, 2])
def test_many_batches_and_blocks_equal_brute_force(spark, monkeypatch, name, filled):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(w)}" for w in rng.zipf(1.4, int(rng.integers(1, 30))) if w < 90) or "w1" for _ in range(150)]
    corpus = [(int(i), t) for i, t in zip(rng.permutation(150), texts)]
    queries = [*corpus[:20], (900, "w1"), (901, "w2 w2 " + "x " * 126)]
    monkeypatch.setattr(retrieval, "BROADCAST_TERMS", 60)
    monkeypatch.setattr(scoring, "FILLED", filled)  # every term, some terms or none have a column
    monkeypatch.setattr(scoring, "CHUNK", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        c, q = spark.createDataFrame(corpus, "id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
        got = {(r.query_id, r.id, r["rank"], r.score) for r in getattr(retrieval, name)(c.repartition(3), q, 5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == _brute(name, corpus, queries, 5)


def test_half_up():
    x = np.array([1 / 128, 3 / 128, 0.0000005, 0.1234565, 2.5, 12345.6789125, 0.99999949999])
    assert scoring.half_up(x, 6).tolist() == [0.007813, 0.023438, 0.000001, 0.123457, 2.5, 12345.678913, 0.999999]
    assert scoring.half_up(np.array([]), 6).tolist() == []


@pytest.mark.parametrize("pairs", [1, 5, 1000])
def test_rare_terms_are_added_in_pieces(monkeypatch, pairs):
    monkeypatch.setattr(scoring, "PAIRS", pairs)
    rng = np.random.default_rng(2)
    left, right = rng.integers(0, 2, (6, 9)) * rng.random((6, 9)), rng.integers(0, 2, (9, 8)) * rng.random((9, 8))
    (query, term), (of, doc) = np.nonzero(left), np.nonzero(right)
    start = np.searchsorted(of, np.arange(10))
    sums = np.zeros((6, 8))
    scoring._add_rare(sums, query, term, left[query, term], start, np.diff(start), doc, right[of, doc])
    assert np.allclose(sums, left @ right)


def _documents(spark, folder) -> str:
    rows = spark.range(1, 3001).selectExpr("id AS doc_id", "concat('the term', id % 7, ' of ', id, ' means') AS text", "'en' AS lang", "if(id % 2 = 0, 'letter', 'award') AS document_type", "'x' AS jurisdiction", "concat('m', id % 3) AS matter_id")
    rows.write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["filtered_search_post", "lexical_rerank", "scoped_search_post"])
def test_hits_are_found_without_a_shuffle_of_pairs(spark, tmp_path, name):
    assert shuffled(entry.queries()[name](spark, _documents(spark, tmp_path))) < 30 * 3000 / 3  # 30 queries share a term with 3000 documents


@pytest.mark.parametrize("name", ["rrf_fusion", "merged_hits"])
def test_lists_are_merged_without_postings_of_the_corpus(spark, small, name):
    def written():
        return {p.name for p in pathlib.Path(shared_dir(spark).removeprefix("file://")).glob("postings-*")}

    before = written()
    assert entry.queries()[name](spark, small).count() > 0
    assert written() == before


@pytest.mark.parametrize("name", ["rrf_fusion", "merged_hits"])
def test_both_lists_come_from_one_pass(spark, small, monkeypatch, name):
    passes = []
    monkeypatch.setattr(retrieval, "searcher", lambda *a: passes.append(1) or scoring.searcher(*a))
    assert entry.queries()[name](spark, small).count() > 0
    assert len(passes) == 1


def test_two_lists_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    corpus = [(i, " ".join(f"w{int(w)}" for w in rng.zipf(1.3, int(rng.integers(1, 40))) if w < 60) or "w1") for i in range(200)]
    corpus += [(300, "w1 " * 5000 + "w2"), (301, " W1　w2\n")]  # products beyond 2^24; outer, wide and other white space
    c = spark.createDataFrame(corpus, "id long, text string")
    lists = retrieval.overlap_and_keyword(c.repartition(3), c.filter("id % 10 = 0 OR id > 200").withColumnRenamed("id", "query_id"), 5)
    plain = [(i, t.lower()) for i, t in corpus]
    for name, hits in zip(("token_overlap", "keyword"), lists):
        got = {(r.query_id, r.id, r["rank"], r.score) for r in hits.collect()}
        assert got == _brute(name, plain, [x for x in plain if x[0] % 10 == 0 or x[0] > 200], 5)


@pytest.mark.parametrize("name", ["keyword_topk", "filtered_search_post"])
def test_texts_are_split_where_they_are_scored(spark, tmp_path, name):
    hits = entry.queries()[name](spark, _documents(spark, tmp_path))
    assert "split(" not in hits._jdf.queryExecution().optimizedPlan().toString()  # no row of tokens comes to the products


def test_tokens_of_the_products_are_those_of_the_columns(spark):
    signs = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    c = spark.createDataFrame([(i, f"a{s}b") for i, s in enumerate(signs)], "id long, text string")
    held = c.filter(F.array_contains(whitespace_tokens(F.col("text")), "a"))
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    got = {r.id for r in retrieval.keyword(c, q, len(signs)).collect()}
    assert got == {r.id for r in held.collect()} and 20 < len(got) < 40


def _asked(texts) -> pa.Table:
    rows = [(i, len(t.split()), len(t.split()), w, float(n)) for i, t in texts for w, n in Counter(t.split()).items()]
    return pa.table(dict(zip(("query_id", "query_length", "divisor", "term", "weight"), map(list, zip(*rows)))))


def _found(search, corpus, batch, k) -> set:
    """The best k of each list and query of what `search` lets out."""
    table = pa.table({"id": [i for i, _ in corpus], "text": [t for _, t in corpus]})
    rows = [tuple(r.values()) for b in search(iter(table.to_batches(max_chunksize=batch))) for r in b.to_pylist()]
    best = {}
    for place, query, doc, score in sorted(rows, key=lambda r: (r[0], r[1], -r[3], r[2])):
        mine = best.setdefault((place, query), [])
        mine.append((doc, len(mine) + 1, score))
    return {(*key, *x) for key, xs in best.items() for x in xs[:k]}


@pytest.mark.parametrize("impacts", [[scoring.ONE], [scoring.SHARE], [scoring.ONE, scoring.SHARE]])
@pytest.mark.parametrize("largest", [1, 7, 512])
def test_parts_by_size_equal_brute_force(monkeypatch, impacts, largest):
    monkeypatch.setattr(scoring, "LARGEST", largest)
    monkeypatch.setattr(scoring, "CHUNK", 3)
    rng = np.random.default_rng(4)
    corpus = [(int(i), " ".join(f"w{int(w)}" for w in rng.zipf(1.3, int(rng.integers(0, 60))) if w < 40)) for i in rng.permutation(400)]
    queries = [*[x for x in corpus if x[1]][:25], (900, "w1"), (901, "w2 w2 w39 w38"), (902, "zz")]
    got = _found(scoring.searcher(_asked(queries), impacts, 5, 6), corpus, 60, 5)
    names = {scoring.ONE: "token_overlap", scoring.SHARE: "keyword"}
    assert got == {(place, *x) for place, impact in enumerate(impacts) for x in _brute(names[impact], corpus, queries, 5)}


@pytest.mark.parametrize("impacts", [[scoring.ONE], [scoring.SHARE], [scoring.ONE, scoring.SHARE]])
def test_documents_that_hold_too_few_terms_are_in_no_product(monkeypatch, impacts):
    monkeypatch.setattr(scoring, "LARGEST", 50, raising=False)
    cells, product = [], scoring._product
    monkeypatch.setattr(scoring, "_product", lambda *a: cells.append((x := product(*a)).size) or x)
    texts = [(i, " ".join(f"w{(i + j) % 90}" for j in range(60 if i % 10 == 0 else 1 + i % 20))) for i in range(3000)]
    got = _found(scoring.searcher(_asked(texts[:200:10]), impacts, 5, 6), texts, 1000, 5)
    assert len(got) == 20 * 5 * len(impacts)
    assert sum(cells) < 20 * 3000 * (1 + (scoring.SHARE in impacts)) / 2  # a tenth of the documents are long enough
