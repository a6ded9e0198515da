"""Evidence, compression, trace and anchor queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.operators import analytics as a
from lexforge.operators import evidence as e
from lexforge.operators import nested
from lexforge.operators.dedup import one_per_key
from lexforge.plans.data_queries import _TREE, P1_TABLES, _nodes
from lexforge.sources.tables import table


def _units(spark: SparkSession, folder: str) -> DataFrame:
    return e.evidence_units(one_per_key(table(spark, folder, "parent_chunks"), ["parent_chunk_id"], ["ingested_at"], ["heading_text", "text"]))


def evidence_units(spark: SparkSession, folder: str) -> DataFrame:
    return _units(spark, folder).select("evidence_unit_id", "heading", F.length("evidence_text").alias("chars"))


def paragraph_importance(spark: SparkSession, folder: str) -> DataFrame:
    return _units(spark, folder).select("evidence_unit_id", e.importance(F.col("evidence_text")).alias("score"))


def compressed_parents(spark: SparkSession, folder: str) -> DataFrame:
    parents = one_per_key(table(spark, folder, "parent_chunks"), ["parent_chunk_id"], ["ingested_at"], ["text"])
    kept = e.compress(parents)
    return kept.groupBy("parent_chunk_id", "original_chars", "compressed_chars").agg(F.count("*").alias("units"), F.count_if("kept").alias("kept"))


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _nodes(spark, folder, bodies=True).filter("kind = 'spans'")
    case = F.regexp_extract("node_path", r"^(cases\[[0-9]+\])", 1)
    got = lambda n, k: F.try_variant_get(F.try_parse_json("body"), f"$.{n}", k)
    return nodes.select("root_key", case.alias("case_path"), got("stage", "string").alias("stage"), got("status", "string").alias("status"), got("duration_ms", "bigint").alias("duration_ms"))


def trace_status(spark: SparkSession, folder: str) -> DataFrame:
    return e.trace_status(_spans(spark, folder), "root_key", "case_path")


def stage_durations(spark: SparkSession, folder: str) -> DataFrame:
    s = _spans(spark, folder)
    return s.groupBy("stage").agg(F.count("*").alias("spans"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("duration_ms").alias("measured"), F.sum("duration_ms").alias("total_ms"))


def events_after_anchor(spark: SparkSession, folder: str) -> DataFrame:
    found = e.after_anchor(table(spark, folder, "events"), "user_id", "ts", F.col("event_type") == "error")
    return found.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "error").alias("later_errors"))


def review_items_with_case(spark: SparkSession, folder: str) -> DataFrame:
    """Review items whose question a saved case already asks."""
    items = one_per_key(table(spark, folder, "review_queue"), ["review_item_id"], ["exported_at"], ["source_id", "run_id", "query", "family"])
    items = items.select(F.col("review_item_id").alias("item_id"), F.expr("substring(source_id, length(run_id) + 2)").alias("case_id"), "query", a.or_unknown(F.col("family")).alias("family"))
    runs = one_per_key(table(spark, folder, "trace_runs"), ["source_path"], ["loaded_at"], ["cases"])
    form = F.schema_of_variant("v")
    listed = F.when(form.startswith("ARRAY"), F.col("v").cast("array<variant>")).when(form.startswith("OBJECT"), F.array("v"))  # a lone object is position 0
    v = runs.select(a.parsed(F.col("cases")).alias("v")).select(F.explode(listed).alias("c")).filter(F.schema_of_variant("c").startswith("OBJECT"))
    cases = v.select(*[F.try_variant_get("c", f"$.{n}", "string").alias(n) for n in ("case_id", "query")], a.or_unknown(F.try_variant_get("c", "$.family", "string")).alias("family"))
    return e.existing(items, cases)


def recent_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The last six earlier messages of each case, cut at 240 characters, joined in order."""
    messages = nested.flat_table(nested.link_by_containment(_nodes(spark, folder, bodies=True)), "prior_messages", P1_TABLES["prior_messages"])
    w = Window.partitionBy("root_key", "parent_path").orderBy(F.desc("position"))
    last = messages.withColumn("from_end", F.row_number().over(w)).filter("from_end <= 6")
    line = F.concat_ws(": ", "role", F.left(F.coalesce("content", F.lit("")), F.lit(240)))
    return last.groupBy("root_key", "parent_path").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("m")).select("root_key", F.col("parent_path").alias("case_path"), F.array_join(F.transform("m", lambda m: m["line"]), "\n").alias("summary"))


QUERIES = {f.__name__: f for f in (evidence_units, paragraph_importance, compressed_parents, trace_status, stage_durations, events_after_anchor, review_items_with_case, recent_messages)}

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_UNITS = rf"""pa AS (SELECT * FROM parent_chunks QUALIFY row_number() OVER (PARTITION BY parent_chunk_id ORDER BY ingested_at) = 1),
 ps AS (SELECT parent_chunk_id, coalesce(nullif(trim(heading_text), ''), 'Untitled') AS heading, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: {_STRIP.format('p')}), lambda p: p <> '') AS ps FROM pa WHERE text IS NOT NULL),
 u AS (SELECT parent_chunk_id, heading, unnest(ps) AS t, generate_subscripts(ps, 1) - 1 AS position FROM ps)"""
_QUALIFIED = "(" + " OR ".join(f"regexp_matches(t, '{q}')" for q in e.QUALIFIERS) + ")"
_WORDS = r"len(list_filter(regexp_split_to_array(t, '[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+'), lambda w: w <> ''))"
_SCORE = f"""round(least({_WORDS} / 80.0::DOUBLE, 1) + {" + ".join(f"CASE WHEN contains(lower(t), '{w}') THEN 0.35::DOUBLE ELSE 0 END" for w in e.KEYWORDS)}
 + CASE WHEN contains(' ' || lower(t) || ' ', ' means ') OR contains(lower(t), 'defined as') THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(lower(t), '{e.DATED}') THEN 0.2::DOUBLE ELSE 0 END
 + CASE WHEN {_WORDS} <= 35 AND {_QUALIFIED} THEN 0.5::DOUBLE ELSE 0 END, 6)"""
_SPANS = """runs AS (SELECT * FROM trace_runs QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY loaded_at) = 1),
 parsed AS (SELECT source_path AS root_key, CASE WHEN json_valid(cases) THEN cases::JSON END AS j FROM runs),
 ls AS (SELECT root_key, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN [j] END AS l FROM parsed),
 cs AS (SELECT root_key, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS pos FROM ls),
 sp AS (SELECT root_key, 'cases[' || pos || ']' AS case_path, json_extract(c, '$.debug_payload.trace.spans') AS s FROM cs WHERE json_type(c) = 'OBJECT'),
 sl AS (SELECT root_key, case_path, CASE json_type(s) WHEN 'VARCHAR' THEN CASE WHEN json_valid(s->>'$') THEN (s->>'$')::JSON END ELSE s END AS s FROM sp),
 sx AS (SELECT root_key, case_path, unnest(CASE json_type(s) WHEN 'ARRAY' THEN json_extract(s, '$[*]') WHEN 'OBJECT' THEN [s] END) AS s FROM sl),
 spans AS (SELECT root_key, case_path, s->>'$.stage' AS stage, s->>'$.status' AS status, (s->>'$.duration_ms')::BIGINT AS duration_ms FROM sx WHERE json_type(s) = 'OBJECT')"""

SQL = {
    "evidence_units": f"WITH {_UNITS} SELECT parent_chunk_id || ':' || position AS evidence_unit_id, heading, length(t) AS chars FROM u",
    "paragraph_importance": f"WITH {_UNITS} SELECT parent_chunk_id || ':' || position AS evidence_unit_id, {_SCORE} AS score FROM u",
    "compressed_parents": f"""WITH {_UNITS}, s AS (SELECT u.*, {_SCORE} AS score, (position = 0 OR {_QUALIFIED}) AS must, length(t) + 2 AS size, length(pa.text) AS original_chars FROM u JOIN pa USING (parent_chunk_id)),
        w AS (SELECT *, sum(CASE WHEN must THEN size ELSE 0 END) OVER p AS held, coalesce(sum(CASE WHEN must THEN 0 ELSE size END) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER r AS place, count(*) OVER p AS of,
          greatest(floor(original_chars * CASE WHEN original_chars > 2200 THEN 0.6::DOUBLE ELSE 0.75::DOUBLE END), 900) AS target FROM s WINDOW p AS (PARTITION BY parent_chunk_id), r AS (PARTITION BY parent_chunk_id ORDER BY score DESC, position)),
        k AS (SELECT *, original_chars <= 900 OR of = 1 OR must OR place = 1 OR held + before - 2 < target AS kept FROM w),
        g AS (SELECT parent_chunk_id, original_chars, count(*) AS units, count(*) FILTER (WHERE kept) AS kept, (sum(size) FILTER (WHERE kept) - 2)::BIGINT AS joined FROM k GROUP BY ALL)
        SELECT parent_chunk_id, original_chars, units, kept, CASE WHEN original_chars <= 900 OR units = 1 OR joined >= original_chars THEN original_chars ELSE joined END AS compressed_chars FROM g""",
    "trace_status": f"WITH {_SPANS} SELECT root_key, case_path, count(*) AS spans, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_or(status IN ('partial', 'skipped')) THEN 'partial' ELSE 'success' END AS overall_status FROM spans GROUP BY 1, 2",
    "stage_durations": f"WITH {_SPANS} SELECT stage, count(*) AS spans, count(*) FILTER (WHERE status = 'failed') AS failed, count(duration_ms) AS measured, sum(duration_ms)::BIGINT AS total_ms FROM spans GROUP BY 1",
    "events_after_anchor": "WITH a AS (SELECT *, min(CASE WHEN event_type = 'error' THEN ts END) OVER (PARTITION BY user_id) AS anchor_at FROM events) SELECT user_id, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS later_errors FROM a WHERE ts > anchor_at GROUP BY 1",
    "review_items_with_case": f"""WITH {_SPANS}, i AS (SELECT review_item_id AS item_id, substr(source_id, length(run_id) + 2) AS case_id, query, coalesce(nullif(family, ''), 'unknown') AS family FROM review_queue QUALIFY row_number() OVER (PARTITION BY review_item_id ORDER BY exported_at) = 1),
        k AS (SELECT c->>'$.case_id' AS case_id, c->>'$.query' AS query, coalesce(nullif(c->>'$.family', ''), 'unknown') AS family FROM cs WHERE json_type(c) = 'OBJECT'),
        m AS (SELECT item_id, 'id' AS matched_by FROM i WHERE case_id IN (SELECT case_id FROM k WHERE case_id IS NOT NULL) UNION ALL SELECT item_id, 'query' FROM i WHERE EXISTS (SELECT 1 FROM k WHERE k.query = i.query AND k.family = i.family))
        SELECT item_id, min(matched_by) AS matched_by FROM m GROUP BY 1""",
    "recent_messages": rf"""WITH {_TREE}, m AS (SELECT root_key, regexp_replace(node_path, '(\.[A-Za-z_0-9]+)+(\[\d+\])+$', '') AS case_path, regexp_extract(node_path, '\[(\d+)\]$', 1)::INT AS position, value->>'$.role' AS role, value->>'$.content' AS content FROM found WHERE regexp_matches(node_path, '\.prior_messages(\[\d+\])+$')),
        l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY root_key, case_path ORDER BY position DESC) <= 6)
        SELECT root_key, case_path, string_agg(concat_ws(': ', role, left(coalesce(content, ''), 240)), chr(10) ORDER BY position) AS summary FROM l GROUP BY 1, 2""",
}
