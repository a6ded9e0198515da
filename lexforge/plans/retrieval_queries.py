"""Retrieval queries: every document whose id is divisible by 100 is a query, with its whole text, against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import retrieval as r
from lexforge.operators.dedup import one_per_key
from lexforge.session import spread
from lexforge.sources.tables import table

EVERY = 100


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "document_type", "jurisdiction"))


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return _corpus(spark, folder).filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "text")


def bm25_corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return r.corpus_stats(r.postings(_corpus(spark, folder))).select("documents", F.round("mean_length", 6).alias("mean_length"))


def term_document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return r.document_frequency(r.postings(_corpus(spark, folder)))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return r.bm25(_corpus(spark, folder), _queries(spark, folder))


def token_overlap_topk(spark: SparkSession, folder: str) -> DataFrame:
    return r.token_overlap(_corpus(spark, folder), _queries(spark, folder))


def keyword_topk(spark: SparkSession, folder: str) -> DataFrame:
    return r.keyword(_corpus(spark, folder), _queries(spark, folder))


def _ranked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The two lists that are fused, of one pass over the corpus and written once: both sides of a fusion read the same lists."""
    return r.overlap_and_keyword(_corpus(spark, folder), _queries(spark, folder))


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    dense, sparse = _ranked(spark, folder)
    return r.fuse(dense, sparse).select("query_id", "id", "score", "rank", "matched_in", "best_rank", "dense_rank", "sparse_rank")


def lexical_rerank(spark: SparkSession, folder: str) -> DataFrame:
    return r.rerank(token_overlap_topk(spark, folder), _corpus(spark, folder), _queries(spark, folder)).select("query_id", "id", "score", "original_score", "rank")


FILTERS = {"document_type": "letter"}


def filtered_search_post(spark: SparkSession, folder: str) -> DataFrame:
    """Filters after the top k, as a store without filters does: a query may get fewer than k."""
    hits = token_overlap_topk(spark, folder)
    return hits.join(_corpus(spark, folder).filter(r.matches(FILTERS)).select("id"), "id", "left_semi").select("query_id", "id", "score", "rank")


def filtered_search_pre(spark: SparkSession, folder: str) -> DataFrame:
    """Filters before scoring: they reach the scan."""
    return r.token_overlap(_corpus(spark, folder).filter(r.matches(FILTERS)), _queries(spark, folder))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    v = _vectors(spark, folder)
    return r.cosine(v, v.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "vector"))


def parent_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's children, best score first, and the parents they come from, in order of their best child."""
    children = one_per_key(table(spark, folder, "child_chunks"), ["child_chunk_id"], ["ingested_at"], ["parent_chunk_id", "document_id", "score"])
    parents = one_per_key(table(spark, folder, "parent_chunks"), ["parent_chunk_id"], ["ingested_at"], ["heading_text", "parent_order"])
    hits = children.filter(F.col("score").isNotNull()).select(F.col("document_id").alias("query_id"), F.col("child_chunk_id").alias("id"), "score", "parent_chunk_id")
    top = r.top_k(hits, 20, [F.desc("score"), F.asc("id")])
    return r.expand_parents(top.select("query_id", "id", "rank"), children.withColumnRenamed("child_chunk_id", "id"), parents).select("query_id", "parent_chunk_id", "best_rank", "children", "parent_order")


def orphan_children(spark: SparkSession, folder: str) -> DataFrame:
    """Children whose parent is missing: an anti-join."""
    parents = table(spark, folder, "parent_chunks").select("parent_chunk_id")
    return table(spark, folder, "child_chunks").select("child_chunk_id", "parent_chunk_id").distinct().join(parents, "parent_chunk_id", "left_anti").select("child_chunk_id", "parent_chunk_id")


QUERIES = {f.__name__: f for f in (bm25_corpus_stats, term_document_frequency, bm25_topk, token_overlap_topk, keyword_topk, rrf_fusion, lexical_rerank, filtered_search_post, filtered_search_pre, cosine_topk, parent_expansion, orphan_children)}

_TOK = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+'), lambda t: t <> '')"
_CTE = f"""
toks AS (SELECT doc_id AS id, document_type, {_TOK} AS tokens FROM documents),
post AS (SELECT term, id, len, count(*) AS tf, any_value(document_type) AS document_type FROM (SELECT id, document_type, len(tokens) AS len, unnest(tokens) AS term FROM toks) GROUP BY term, id, len),
qt AS (SELECT term, id AS query_id, tf AS qtf, len AS qlen FROM post WHERE id % {EVERY} = 0)
"""
_OVERLAP = "SELECT query_id, p.id, round(sum(qtf) / any_value(qlen)::DOUBLE, 6) AS score FROM qt JOIN post p USING (term) {where} GROUP BY query_id, p.id"
_KEYWORD = "SELECT query_id, p.id, round(sum(qtf * (1 + tf / len::DOUBLE)) / any_value(qlen), 6) AS score FROM qt JOIN post p USING (term) GROUP BY query_id, p.id"


def _top(scored: str, k: int = 10, order: str = "score DESC, id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM ({scored})) WHERE rank <= {k}"


_PARENTS = """
ch AS (SELECT * FROM child_chunks QUALIFY row_number() OVER (PARTITION BY child_chunk_id ORDER BY ingested_at) = 1),
pa AS (SELECT * FROM parent_chunks QUALIFY row_number() OVER (PARTITION BY parent_chunk_id ORDER BY ingested_at) = 1)
"""

SQL = {
    "bm25_corpus_stats": f"WITH {_CTE} SELECT count(*) AS documents, round(avg(len(tokens)), 6) AS mean_length FROM toks WHERE len(tokens) > 0",
    "term_document_frequency": f"WITH {_CTE} SELECT term, count(*) AS df FROM post GROUP BY term",
    "bm25_topk": f"""WITH {_CTE}, st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM toks WHERE len(tokens) > 0), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)
        {_top("SELECT query_id, p.id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM qt JOIN post p USING (term) JOIN df USING (term), st GROUP BY query_id, p.id HAVING score > 0")}""",
    "token_overlap_topk": f"WITH {_CTE} {_top(_OVERLAP.format(where=''))}",
    "keyword_topk": f"WITH {_CTE} {_top(_KEYWORD)}",
    "rrf_fusion": f"""WITH {_CTE}, d AS ({_top(_OVERLAP.format(where=''))}), s AS ({_top(_KEYWORD)})
        {_top("SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 6) AS score, (d.id IS NOT NULL)::INT + (s.id IS NOT NULL)::INT AS matched_in, least(d.rank, s.rank) AS best_rank, d.rank AS dense_rank, s.rank AS sparse_rank FROM d FULL JOIN s ON d.query_id = s.query_id AND d.id = s.id", order="score DESC, matched_in DESC, best_rank, id")}""",
    "lexical_rerank": f"""WITH {_CTE}, h AS ({_top(_OVERLAP.format(where=''))}), u AS (SELECT id, tokens AS t FROM toks)
        {_top("SELECT h.query_id, h.id, h.score AS original_score, round(len(list_filter(q.t, lambda x: list_contains(d.t, x))) / len(q.t)::DOUBLE + len(list_intersect(list_distinct(d.t), ['means', 'shall', 'must', 'defined', 'rule', 'clause'])) * 0.02::DOUBLE, 6) AS score FROM h JOIN u d ON d.id = h.id JOIN u q ON q.id = h.query_id", order="score DESC, original_score DESC, id")}""",
    "filtered_search_post": f"WITH {_CTE} SELECT query_id, id, score, rank FROM ({_top(_OVERLAP.format(where=''))}) WHERE id IN (SELECT doc_id FROM documents WHERE document_type = 'letter')",
    "filtered_search_pre": f"""WITH {_CTE} {_top(_OVERLAP.format(where="WHERE document_type = 'letter'"))}""",
    "cosine_topk": f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % {EVERY} = 0), v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS b FROM embeddings)
        {_top("SELECT query_id, id, round(list_cosine_similarity(a, b), 6) AS score FROM q, v")}""",
    "parent_expansion": f"""WITH {_PARENTS}, h AS ({_top("SELECT document_id AS query_id, child_chunk_id AS id, score, parent_chunk_id FROM ch WHERE score IS NOT NULL", 20)})
        SELECT query_id, pa.parent_chunk_id, min(rank) AS best_rank, count(*) AS children, any_value(pa.parent_order) AS parent_order FROM h JOIN pa USING (parent_chunk_id) GROUP BY query_id, pa.parent_chunk_id""",
    "orphan_children": "SELECT DISTINCT child_chunk_id, parent_chunk_id FROM child_chunks c WHERE NOT EXISTS (SELECT 1 FROM parent_chunks p WHERE p.parent_chunk_id = c.parent_chunk_id)",
}
