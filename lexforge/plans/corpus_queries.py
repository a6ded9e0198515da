"""Corpus queries: chunks and their ids, text functions, metadata, deduplication, and streams over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as t
from lexforge.operators import analytics as a
from lexforge.operators.chunking import chunk
from lexforge.operators.dedup import one_per_key
from lexforge.plans import analytics_queries
from lexforge.session import spread
from lexforge.sources.tables import table
from lexforge.streaming import metrics as stream
from lexforge.streaming import shadow


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def _children(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "child_chunks"), ["child_chunk_id"], ["ingested_at"], ["parent_chunk_id", "document_id", "text", "score", "payload", "child_order"])


def child_chunks_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunk(_documents(spark, folder).select(F.col("doc_id").alias("document_id"), "text")).select("document_id", "parent_chunk_id", "child_chunk_id", "parent_order", "part_number", "total_parts", "child_order", "child_text")


def chunk_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks per document type: parents, children and tokens, from the chunker."""
    types = _documents(spark, folder).select(F.col("doc_id").cast("string").alias("document_id"), a.or_unknown(F.col("document_type")).alias("document_type"))
    made = child_chunks_of_documents(spark, folder).withColumn("tokens", t.token_count(F.col("child_text")))
    per = made.groupBy("document_id").agg(F.max("parent_order").alias("parents"), F.count("*").alias("children"), F.sum("tokens").alias("tokens"))
    return per.join(types, "document_id").groupBy("document_type").agg(F.count("*").alias("documents"), F.sum("parents").alias("parents"), F.sum("children").alias("children"), F.sum("tokens").alias("tokens"))


def chunk_content_ids(spark: SparkSession, folder: str) -> DataFrame:
    c = _children(spark, folder)
    return c.select("child_chunk_id", t.content_id("child", F.col("document_id"), F.col("parent_chunk_id"), F.col("child_order") - 1, F.col("text")).alias("content_id"))


def vector_point_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _children(spark, folder).select("child_chunk_id", t.uuid5(F.concat(F.lit("lexforge-child:"), F.col("child_chunk_id"))).alias("point_id"))


def chunk_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Why a child would be skipped by an index: the first rule it breaks, and how many do."""
    reason = (
        F.when(F.coalesce(F.length("child_chunk_id"), F.lit(0)) == 0, "missing id")
        .when(F.coalesce(F.length("parent_chunk_id"), F.lit(0)) == 0, "missing parent")
        .when(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)), "empty text")
        .when(F.size(t.whitespace_tokens(F.col("text"))) > 120, "too long")
        .otherwise("valid")
    )
    return _children(spark, folder).groupBy(reason.alias("reason")).agg(F.count("*").alias("chunks"))


def payload_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Payload dates, which come in several forms, as dates: counts by year and jurisdiction."""
    d = F.trim("payload.date")
    date = F.coalesce(*[F.call_function("try_to_date", d, F.lit(f)) for f in ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "yyyyMMdd")])
    return _children(spark, folder).groupBy(a.or_unknown(F.col("payload.jurisdiction")).alias("jurisdiction"), F.year(date).alias("year")).agg(F.count("*").alias("chunks"))


def document_date_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Dates named in documents: mentions and documents by year."""
    d = _documents(spark, folder).select("doc_id", F.explode(t.dates(F.col("text"))).alias("date"))
    return d.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"))


def legal_reference_counts(spark: SparkSession, folder: str) -> DataFrame:
    r = _documents(spark, folder).select("doc_id", F.explode(t.legal_references(F.col("text"))).alias("reference"))
    return r.groupBy("reference").agg(F.count("*").alias("mentions"), F.countDistinct("doc_id").alias("documents"))


def sentence_statistics(spark: SparkSession, folder: str) -> DataFrame:
    s = _documents(spark, folder).select("doc_id", F.explode(t.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("s")).alias("longest"))


def plain_text_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("doc_id", F.length(t.canonical(F.col("text"))).alias("canonical_chars"), F.size(t.query_terms(F.col("text"))).alias("terms"))


def dedup_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    p = one_per_key(table(spark, folder, "parent_chunks"), ["parent_chunk_id"], ["ingested_at"], ["document_id", "parent_token_count"])
    return p.groupBy("document_id").agg(F.count("*").alias("parents"), F.sum("parent_token_count").alias("tokens"))


def dedup_last_write(spark: SparkSession, folder: str) -> DataFrame:
    last = one_per_key(table(spark, folder, "review_queue"), ["review_item_id"], ["exported_at"], ["review_status"], latest=True)
    return last.groupBy("review_status").agg(F.count("*").alias("items"))


def stream_family_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The request stream, windowed by day and family, run over all files."""
    out = stream.run_to_table(stream.family_windows(stream.read_table(spark, folder, "request_metrics")), "update", ["window_start", "family"])
    return out.select(F.to_date("window_start").alias("day"), "family", "requests", "insufficient", "total_tokens")


def stream_queue_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The review queue kept as a keyed store by a stream of its exports."""
    s = stream.read_table(spark, folder, "review_queue").select("review_item_id", "review_status", "category", "exported_at")
    return stream.upsert_stream(s, ["review_item_id"], "exported_at").groupBy("category", "review_status").agg(F.count("*").alias("items"))


def stream_shadow_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Citation checks of the review items, graded as they stream in."""
    return stream.run_to_table(shadow.shadow_grades(stream.read_table(spark, folder, "review_queue")), mode="append").dropDuplicates(["id"])


QUERIES = {
    f.__name__: f
    for f in (
        child_chunks_of_documents, chunk_totals, chunk_content_ids, vector_point_ids, chunk_validation, payload_dates, document_date_mentions, legal_reference_counts, sentence_statistics, plain_text_lengths,
        dedup_first_seen, dedup_last_write, stream_family_windows, stream_queue_upsert, stream_shadow_grades,
    )
}

_CH = "ch AS (SELECT * FROM child_chunks QUALIFY row_number() OVER (PARTITION BY child_chunk_id ORDER BY ingested_at) = 1)"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_UUID = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || ('lexforge-child:' || child_chunk_id)::BLOB)"
_QUEUE = "SELECT category, review_status, count(*) AS items FROM (SELECT * FROM review_queue QUALIFY row_number() OVER (PARTITION BY review_item_id ORDER BY exported_at DESC, review_status DESC) = 1) GROUP BY 1, 2"

SQL = {
    "chunk_content_ids": f"WITH {_CH} SELECT child_chunk_id, sha256('child' || chr(0) || coalesce(document_id, '') || chr(0) || coalesce(parent_chunk_id, '') || chr(0) || coalesce((child_order - 1)::VARCHAR, '') || chr(0) || coalesce(text, '')) AS content_id FROM ch",
    "vector_point_ids": f"WITH {_CH}, h AS (SELECT child_chunk_id, {_UUID} AS h FROM ch) SELECT child_chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT & 3) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h",
    "chunk_validation": rf"WITH {_CH}, r AS (SELECT CASE WHEN coalesce(length(child_chunk_id), 0) = 0 THEN 'missing id' WHEN coalesce(length(parent_chunk_id), 0) = 0 THEN 'missing parent' WHEN NOT coalesce(regexp_matches(text, '\S'), false) THEN 'empty text' WHEN len(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\p{{Z}}\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}]+'), lambda t: t <> '')) > 120 THEN 'too long' ELSE 'valid' END AS reason FROM ch) SELECT reason, count(*) AS chunks FROM r GROUP BY 1",
    "payload_dates": f"WITH {_CH}, d AS (SELECT coalesce(nullif(payload.jurisdiction, ''), 'unknown') AS jurisdiction, try_strptime(trim(payload.date), ['%Y-%m-%d', '%B %d, %Y', '%b %d, %Y', '%d %B %Y', '%d %b %Y', '%d/%m/%Y', '%Y/%m/%d', '%Y%m%d']) AS d FROM ch) SELECT jurisdiction, year(d) AS year, count(*) AS chunks FROM d GROUP BY 1, 2",
    "document_date_mentions": rf"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b{_MONTH} \d{{1,2}}, \d{{4}}\b|\b\d{{1,2}} {_MONTH} \d{{4}}\b')) AS s FROM documents), d AS (SELECT doc_id, try_strptime(s, ['%Y-%m-%d', '%B %d, %Y', '%b %d, %Y', '%d %B %Y', '%d %b %Y']) AS d FROM m) SELECT year(d) AS year, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM d WHERE d IS NOT NULL GROUP BY 1",
    "legal_reference_counts": "WITH m AS (SELECT doc_id, unnest(list_concat(" + ", ".join(f"regexp_extract_all(text, '{r}')" for r in t.REFERENCES) + ")) AS reference FROM documents) SELECT reference, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM m GROUP BY 1",
    "sentence_statistics": r"WITH m AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents) SELECT doc_id, count(*) AS sentences, max(length(regexp_replace(s, '^\s+|\s+$', '', 'g'))) AS longest FROM m WHERE regexp_replace(s, '^\s+|\s+$', '', 'g') <> '' GROUP BY 1",
    "plain_text_lengths": r"SELECT doc_id, length(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))) AS canonical_chars, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: NOT list_contains(["
    + ", ".join(f"'{w}'" for w in t.STOP_WORDS)
    + "], w))) AS terms FROM documents",
    "dedup_first_seen": "SELECT document_id, count(*) AS parents, sum(parent_token_count)::BIGINT AS tokens FROM (SELECT * FROM parent_chunks QUALIFY row_number() OVER (PARTITION BY parent_chunk_id ORDER BY ingested_at) = 1) GROUP BY 1",
    "dedup_last_write": "SELECT review_status, count(*) AS items FROM (SELECT * FROM review_queue QUALIFY row_number() OVER (PARTITION BY review_item_id ORDER BY exported_at DESC, review_status DESC) = 1) GROUP BY 1",
    "stream_family_windows": "WITH r AS (SELECT DISTINCT ON (request_id) * FROM request_metrics ORDER BY request_id, received_at) SELECT (recorded_at AT TIME ZONE 'UTC')::DATE AS day, coalesce(nullif(legal_family, ''), 'unknown') AS family, count(*) AS requests, sum(coalesce(insufficient_answer, 0))::BIGINT AS insufficient, sum(coalesce(total_tokens, 0))::BIGINT AS total_tokens FROM r GROUP BY 1, 2",
    "stream_queue_upsert": _QUEUE,
    "stream_shadow_grades": analytics_queries.SQL["citation_checks"],
}
