"""Metrics, evaluation-run, citation and queue analytics over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.operators import analytics as a
from lexforge.operators import grading, retrieval, stores
from lexforge.operators.dedup import one_per_key
from lexforge.session import cut
from lexforge.sources.tables import table

_METRICS = ["trace_id", "legal_family", "document_type", "grounded_answer", "insufficient_answer", "false_confident_proxy", "family_route_present", "latency_ms", "cost_usd", "input_tokens", "output_tokens", "total_tokens", "model_version", "recorded_at"]


def _requests(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Each request once, as first received."""
    return one_per_key(table(spark, folder, "request_metrics"), ["request_id"], ["received_at"], columns or _METRICS)


def metrics_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return a.metrics_rollup(_requests(spark, folder))


def metrics_by_family_and_type(spark: SparkSession, folder: str) -> DataFrame:
    return a.metrics_rollup(_requests(spark, folder), ("legal_family",), ("document_type",))


def p95_nearest_rank(spark: SparkSession, folder: str) -> DataFrame:
    measured = _requests(spark, folder, "legal_family", "latency_ms").filter("latency_ms >= 0").withColumn("legal_family", a.or_unknown(F.col("legal_family")))
    return a.exact_percentiles(measured, ["legal_family"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def p50_p95_floor_rank(spark: SparkSession, folder: str) -> DataFrame:
    measured = _requests(spark, folder, "model_version", "latency_ms").filter("latency_ms >= 0")
    return a.exact_percentiles(measured, ["model_version"], "latency_ms", {"p50": 0.5, "p95": 0.95}, rank="floor")


def daily_latency_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Mean latency per day with the change against the day before and a 7-day moving mean."""
    days = _requests(spark, folder, "latency_ms", "recorded_at").filter("latency_ms >= 0").groupBy(F.to_date("recorded_at").alias("day")).agg(F.count("*").alias("requests"), F.sum(F.col("latency_ms").cast("bigint")).alias("total"))
    w = Window.orderBy("day")  # one row a day
    mean = F.col("total") / F.col("requests")
    moving = F.sum("total").over(w.rowsBetween(-6, 0)) / F.sum("requests").over(w.rowsBetween(-6, 0))
    return days.select("day", "requests", F.round(mean, 6).alias("mean_ms"), F.round(mean - F.lag(mean).over(w), 6).alias("change_ms"), F.round(moving, 6).alias("moving_ms"))


def version_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """Two model versions by family: full outer join, deltas and direction."""
    base, candidate = "answerer-1.8", "answerer-2.2-rc1"
    rows = _requests(spark, folder, "legal_family", "model_version", "grounded_answer").withColumn("family", a.or_unknown(F.col("legal_family")))
    side = lambda v, n: rows.filter(F.col("model_version") == v).groupBy("family").agg(F.count("*").alias(f"{n}_requests"), F.round(a.rate(F.col("grounded_answer")), 6).alias(f"{n}_rate"))
    both = side(base, "base").join(side(candidate, "candidate"), "family", "full_outer")
    return both.select("*", a.compared(F.col("base_rate"), F.col("candidate_rate"), True).alias("c")).select("family", "base_requests", "candidate_requests", "base_rate", "candidate_rate", "c.delta", "c.delta_pct", "c.direction")


def duplicate_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "request_metrics").groupBy("request_id").agg(F.count("*").alias("copies"), F.max("received_at").alias("last_received")).filter("copies > 1").select("request_id", "copies", F.date_format("last_received", "yyyy-MM-dd HH:mm:ss").alias("last_received"))


def sampling_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Requests drawn for review, with every reason: a random share, a share by family, high cost, low confidence."""
    rows = _requests(spark, folder, "legal_family", "cost_usd", "total_tokens", "insufficient_answer")
    reasons = F.array_compact(
        F.array(
            F.when(stores.drawn(F.col("request_id"), "random") < 0.02, "random"),
            F.when((F.col("legal_family") == "policy_issue_spotting") & (stores.drawn(F.col("request_id"), "family") < 0.25), "family"),
            F.when((F.col("cost_usd") > 0.02) & ~F.isnan("cost_usd"), "high_cost"),
            F.when(F.col("total_tokens") > 6000, "high_tokens"),
            F.when(F.col("insufficient_answer") == 1, "insufficient"),
        )
    )
    return rows.select("request_id", F.array_join(reasons, ",").alias("reasons")).filter("reasons <> ''")


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    return a.run_cases(one_per_key(table(spark, folder, "trace_runs"), ["source_path"], ["loaded_at"], ["run_id", "generated_at_utc", "cases"]))


def family_pass_rates(spark: SparkSession, folder: str) -> DataFrame:
    return a.pass_rates(_cases(spark, folder), "family")


def run_trends(spark: SparkSession, folder: str) -> DataFrame:
    cases = _cases(spark, folder)
    passed = F.sum(F.col("passed").cast("int"))
    return cases.groupBy("source_path").agg(F.count("*").alias("cases"), passed.alias("passed"), F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"), F.round(F.avg("cost_usd"), 6).alias("mean_cost_usd"), F.round(F.avg(F.col("grounded").cast("int")), 6).alias("grounded_rate"))


def top_failing_runs(spark: SparkSession, folder: str) -> DataFrame:
    rates = a.pass_rates(_cases(spark, folder), "source_path").filter("failed > 0")
    return rates.orderBy(F.desc("failed"), F.asc("pass_rate"), F.asc("source_path")).limit(10)


def failure_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Failed checks by name and family. A runner that failed counts twice: as a reason of its case, and by itself."""
    failed = F.map_keys(F.map_filter("checks", lambda _, v: ~v))
    reasons = F.concat(failed, F.when(F.col("runner_status") != "ok", F.array(F.lit("runner"), F.lit("runner"))).otherwise(F.array().cast("array<string>")))
    return _cases(spark, folder).select("family", F.explode(reasons).alias("reason")).groupBy("family", "reason").agg(F.count("*").alias("failures"))


def routing_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Review items' family against the family their run's case had: a confusion matrix in long form (null = unresolved)."""
    items = one_per_key(table(spark, folder, "review_queue"), ["review_item_id"], ["exported_at"], ["source_id", "run_id", "run_file", "family"]).filter("run_file IS NOT NULL")
    cases = _cases(spark, folder).filter("case_id IS NOT NULL").groupBy("source_path", "case_id").agg(F.min("family").alias("case_family"))
    case = F.expr("substring(source_id, length(run_id) + 2)")
    joined = items.select("run_file", case.alias("item_case"), a.or_unknown(F.col("family")).alias("observed"))
    joined = joined.join(cases, (F.col("run_file") == F.col("source_path")) & (F.col("item_case") == F.col("case_id")), "left")
    return joined.groupBy(F.coalesce("case_family", F.lit("unresolved")).alias("expected"), "observed").agg(F.count("*").alias("items"))


def run_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Per run: pass rate and runner failures against the thresholds of a gate."""
    g = _cases(spark, folder).groupBy("source_path").agg(F.count("*").alias("cases"), F.round(a.rate(F.col("passed")), 6).alias("pass_rate"), F.count_if(F.coalesce(F.col("runner_status") != "ok", F.lit(True))).alias("runner_failures"))
    return g.withColumn("gate_passed", (F.col("pass_rate") >= 0.6) & (F.col("runner_failures") <= 0))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "review_queue"), ["review_item_id"], ["exported_at"], ["citations", "selected_document_ids", "final_answer", "family", "trace_id", "category", "review_status", "source_type"])


def citation_checks(spark: SparkSession, folder: str) -> DataFrame:
    items = _items(spark, folder).select(F.col("review_item_id").alias("id"), F.col("final_answer").alias("answer"), "citations", F.col("selected_document_ids").alias("scope"))
    return grading.citation_checks(items)


def citation_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Check rates by family over the items they apply to: null results are in no denominator."""
    families = _items(spark, folder).select(F.col("review_item_id").alias("id"), a.or_unknown(F.col("family")).alias("family"))
    graded = citation_checks(spark, folder).join(families, "id")
    return graded.groupBy("family").agg(F.count("*").alias("items"), F.round(F.avg(F.col("presence").cast("int")), 6).alias("presence_rate"), F.round(F.avg(F.col("in_scope").cast("int")), 6).alias("scope_rate"), F.sum("outside").alias("outside"))


def cited_parents_missing(spark: SparkSession, folder: str) -> DataFrame:
    """Cited parents that aren't in the parent table: an anti-join on exploded citations."""
    c = _items(spark, folder).select("review_item_id", F.explode("citations").alias("c")).select("review_item_id", F.col("c.parent_chunk_id").alias("parent_chunk_id")).filter("parent_chunk_id IS NOT NULL").distinct()
    missing = c.join(table(spark, folder, "parent_chunks").select("parent_chunk_id"), "parent_chunk_id", "left_anti")
    return missing.groupBy("review_item_id").agg(F.count("*").alias("missing"))


def queue_status_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """First exports with the status of each item's last export: the queue as it stands."""
    first = _items(spark, folder).select("review_item_id", "category")
    last = one_per_key(table(spark, folder, "review_queue"), ["review_item_id"], ["exported_at"], ["review_status"], latest=True)
    shown = stores.overlay(first, last, "review_item_id", "review_status", "pending_review", ["pending_review", "approved", "rejected", "escalated", "relabeled", "resolved"])
    return shown.groupBy("category", "review_status").agg(F.count("*").alias("items"))


def queue_upsert(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "review_queue").select("review_item_id", "review_status", "category", "exported_at")
    day = F.lit("2025-07-01").cast("timestamp")
    merged = stores.upsert(q.filter(F.col("exported_at") < day), q.filter(F.col("exported_at") >= day), ["review_item_id"], "exported_at")
    return merged.groupBy("category", "review_status").agg(F.count("*").alias("items"))


def review_to_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Shadow items joined with their traffic by trace: traced and dangling items by category. The hot trace is aggregated before the join."""
    traffic = _requests(spark, folder, "trace_id", "latency_ms").filter("trace_id IS NOT NULL").groupBy("trace_id").agg(F.count("*").alias("requests"), F.max("latency_ms").alias("slowest_ms"))
    items = _items(spark, folder).filter("trace_id IS NOT NULL").select("review_item_id", "category", "trace_id")
    return items.join(traffic, "trace_id", "left").groupBy("category").agg(F.count("*").alias("items"), F.count("requests").alias("traced"), F.sum("requests").alias("requests"), F.max("slowest_ms").alias("slowest_ms"))


def _embedding_grades(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    queries = v.filter(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector", "label")
    others = retrieval.cosine(v.select("id", "vector"), queries.select("query_id", "vector"), 11).filter("query_id <> id").drop("rank")
    hits = retrieval.top_k(others, 10, [F.desc("score"), F.asc("id")])  # ranked again without the query's own vector
    # a hit is gold if it has the query's label: two joins by id, not one by label
    marked = hits.join(v.select("id", F.col("label").alias("hit_label")), "id").join(queries.select("query_id", "label"), "query_id")
    own = F.col("label") == F.col("hit_label")
    found = marked.groupBy("query_id").agg(F.min(F.when(own, F.col("rank"))).alias("best_rank"), F.avg(F.when(own, 0.0).otherwise(1.0)).alias("wrong_share"))
    graded = queries.select("query_id", "label").join(found, "query_id", "left")
    return graded.select("query_id", "label", "best_rank", "wrong_share", *[F.coalesce(F.col("best_rank") <= k, F.lit(False)).cast("int").alias(f"hit_at_{k}") for k in (1, 3, 5, 10)])


def embedding_hit_at_k(spark: SparkSession, folder: str) -> DataFrame:
    """Dense search graded by label: gold are the other vectors of the query's label."""
    return _embedding_grades(spark, folder).drop("label", "wrong_share")


def embedding_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """The grades by label: recall at k, ranks and the share of hits with another label."""
    return grading.retrieval_rollup(_embedding_grades(spark, folder), "label")


def prior_values(spark: SparkSession, folder: str) -> DataFrame:
    """For each request of a trace, the family of the last earlier request that had one (hydration of a later turn)."""
    rows = _requests(spark, folder, "trace_id", "legal_family", "recorded_at").filter("trace_id IS NOT NULL")
    prior = stores.previous_value(rows, ["trace_id"], ["recorded_at", "request_id"], ["legal_family"], bucket=F.to_date("recorded_at"))
    return prior.groupBy(a.or_unknown(F.col("legal_family")).alias("family"), F.coalesce("prior_legal_family", F.lit("none")).alias("prior_family")).agg(F.count("*").alias("requests"))


def user_sessions(spark: SparkSession, folder: str) -> DataFrame:
    s = stores.sessions(table(spark, folder, "events"), "user_id", "ts")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("events").alias("most_events"))


QUERIES = {
    f.__name__: f
    for f in (
        metrics_rollup, metrics_by_family_and_type, p95_nearest_rank, p50_p95_floor_rank, daily_latency_windows, version_comparison, duplicate_requests, sampling_reasons, family_pass_rates, run_trends,
        top_failing_runs, failure_breakdown, routing_confusion, run_gate, citation_checks, citation_rollup, cited_parents_missing, queue_status_overlay, queue_upsert, review_to_requests, embedding_hit_at_k, embedding_rollup,
        prior_values, user_sessions,
    )
}

_REQ = "req AS (SELECT * FROM request_metrics QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY received_at) = 1)"
_HITS = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS a, label FROM embeddings WHERE vec_id % 100 = 0),
 h AS (SELECT query_id, q.label AS ql, v.label AS l, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(a, v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM q, embeddings v WHERE query_id <> v.vec_id),
 b AS (SELECT query_id, ql AS label, min(rank) FILTER (WHERE ql = l) AS best_rank, avg((ql <> l)::INT) AS wrong_share FROM h WHERE rank <= 10 GROUP BY ALL),
 g AS (SELECT *, coalesce(best_rank <= 1, false)::INT AS hit_at_1, coalesce(best_rank <= 3, false)::INT AS hit_at_3, coalesce(best_rank <= 5, false)::INT AS hit_at_5, coalesce(best_rank <= 10, false)::INT AS hit_at_10 FROM b)"""
_UNKNOWN = "coalesce(nullif({0}, ''), 'unknown')"
_ROLLUP = """count(*) AS requests, round(avg(coalesce(grounded_answer, 0)), 6) AS grounded_rate, round(avg(coalesce(insufficient_answer, 0)), 6) AS insufficient_rate,
 round(avg(coalesce(false_confident_proxy, 0)), 6) AS false_confident_rate, round(avg(coalesce(family_route_present, 0)), 6) AS route_rate,
 round(avg(CASE WHEN NOT isnan(cost_usd) THEN cost_usd END), 6) AS mean_cost_usd, sum(coalesce(input_tokens, 0))::BIGINT AS input_tokens, sum(coalesce(output_tokens, 0))::BIGINT AS output_tokens, sum(coalesce(total_tokens, 0))::BIGINT AS total_tokens"""
_CASES = """runs AS (SELECT * FROM trace_runs QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY loaded_at) = 1),
 parsed AS (SELECT source_path, run_id, CASE WHEN json_valid(cases) THEN cases::JSON END AS j FROM runs WHERE cases IS NOT NULL),
 listed AS (SELECT source_path, run_id, unnest(CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN [j] END) AS c FROM parsed),
 objs AS (SELECT source_path, run_id, c, c->>'$.case_id' AS case_id, coalesce(nullif(c->>'$.family', ''), 'unknown') AS family, c->>'$.runner_status' AS runner_status,
  coalesce(c->>'$.system_result.grounded', c->>'$.system_output.grounded')::BOOLEAN AS grounded,
  coalesce(c->>'$.system_result.latency_ms', c->>'$.system_output.latency_ms')::DOUBLE AS latency_ms, coalesce(c->>'$.system_result.cost_usd', c->>'$.system_output.cost_usd')::DOUBLE AS cost_usd,
  coalesce(json_keys(c, '$.deterministic_eval_results'), []) AS ks FROM listed WHERE json_type(c) = 'OBJECT'),
 cs AS (SELECT *, list_filter(ks, lambda k: json_extract_string(c, '$.deterministic_eval_results.' || k || '.passed') = 'false') AS failing FROM objs),
 cases AS (SELECT *, coalesce(runner_status = 'ok', false) AND len(failing) = 0 AS passed FROM cs)"""
_ITEMS = "items AS (SELECT * FROM review_queue QUALIFY row_number() OVER (PARTITION BY review_item_id ORDER BY exported_at) = 1)"
_CHECKS = """live AS (SELECT review_item_id AS id, family, final_answer AS answer, list_filter(coalesce(citations, []), lambda c: c IS NOT NULL) AS cits, list_filter(coalesce(selected_document_ids, []), lambda x: x IS NOT NULL AND x <> '') AS scope FROM items),
 docs AS (SELECT *, list_distinct(list_filter(list_transform(cits, lambda c: c.document_id), lambda x: x IS NOT NULL AND x <> '')) AS docs FROM live),
 graded AS (SELECT id, family, len(cits) AS citations, CASE WHEN length(answer) > 0 THEN len(cits) > 0 END AS presence,
  CASE WHEN len(docs) > 0 AND len(scope) > 0 THEN len(list_filter(docs, lambda x: NOT list_contains(scope, x))) = 0 END AS in_scope,
  CASE WHEN len(docs) > 0 AND len(scope) > 0 THEN len(list_filter(docs, lambda x: NOT list_contains(scope, x))) END AS outside,
  CASE WHEN len(cits) > 0 THEN round(len(list_filter(cits, lambda c: length(c.supporting_excerpt) > 0)) / len(cits)::DOUBLE, 6) END AS excerpt_rate FROM docs)"""
_KNOWN = "('pending_review', 'approved', 'rejected', 'escalated', 'relabeled', 'resolved')"


def _drawn(salt: str) -> str:
    return f"(('0x' || substr(sha256('{salt}' || chr(0) || request_id), 1, 12))::BIGINT % 1000000) / 1000000.0"


SQL = {
    "metrics_rollup": f"WITH {_REQ} SELECT {_ROLLUP} FROM req",
    "metrics_by_family_and_type": f"WITH {_REQ}, k AS (SELECT * REPLACE ({_UNKNOWN.format('legal_family')} AS legal_family, {_UNKNOWN.format('document_type')} AS document_type) FROM req) SELECT legal_family, document_type, {_ROLLUP} FROM k GROUP BY GROUPING SETS ((legal_family), (document_type))",
    "p95_nearest_rank": f"WITH {_REQ}, k AS (SELECT {_UNKNOWN.format('legal_family')} AS legal_family, list_sort(list(latency_ms)) AS s, count(*) AS n FROM req WHERE latency_ms >= 0 GROUP BY 1) SELECT legal_family, s[greatest(ceil(0.5 * n), 1)::BIGINT] AS p50, s[greatest(ceil(0.95 * n), 1)::BIGINT] AS p95, s[greatest(ceil(0.99 * n), 1)::BIGINT] AS p99 FROM k",
    "p50_p95_floor_rank": f"WITH {_REQ}, k AS (SELECT model_version, list_sort(list(latency_ms)) AS s, count(*) AS n FROM req WHERE latency_ms >= 0 GROUP BY 1) SELECT model_version, s[floor(0.5 * (n - 1))::BIGINT + 1] AS p50, s[floor(0.95 * (n - 1))::BIGINT + 1] AS p95 FROM k",
    "daily_latency_windows": f"WITH {_REQ}, d AS (SELECT (recorded_at AT TIME ZONE 'UTC')::DATE AS day, count(*) AS requests, sum(latency_ms)::BIGINT AS total FROM req WHERE latency_ms >= 0 GROUP BY 1) SELECT day, requests, round(total / requests::DOUBLE, 6) AS mean_ms, round(total / requests::DOUBLE - lag(total / requests::DOUBLE) OVER (ORDER BY day), 6) AS change_ms, round(sum(total) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) / (sum(requests) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))::DOUBLE, 6) AS moving_ms FROM d",
    "version_comparison": f"""WITH {_REQ}, s AS (SELECT {_UNKNOWN.format('legal_family')} AS family, model_version, count(*) AS n, round(avg(coalesce(grounded_answer, 0)), 6) AS r FROM req GROUP BY 1, 2),
        j AS (SELECT coalesce(b.family, c.family) AS family, b.n AS base_requests, c.n AS candidate_requests, b.r AS base_rate, c.r AS candidate_rate FROM (SELECT * FROM s WHERE model_version = 'answerer-1.8') b FULL JOIN (SELECT * FROM s WHERE model_version = 'answerer-2.2-rc1') c ON b.family = c.family)
        SELECT *, round(candidate_rate - base_rate, 6) AS delta, CASE WHEN base_rate <> 0 THEN round((candidate_rate - base_rate) / abs(base_rate), 6) END AS delta_pct,
        CASE WHEN candidate_rate - base_rate IS NULL THEN 'unavailable' WHEN abs(candidate_rate - base_rate) <= 1e-12 THEN 'same' WHEN candidate_rate > base_rate THEN 'better' ELSE 'worse' END AS direction FROM j""",
    "duplicate_requests": "SELECT request_id, count(*) AS copies, strftime(max(received_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_received FROM request_metrics GROUP BY 1 HAVING count(*) > 1",
    "sampling_reasons": f"""WITH {_REQ} SELECT request_id, reasons FROM (SELECT request_id, array_to_string(list_filter([CASE WHEN {_drawn('random')} < 0.02 THEN 'random' END, CASE WHEN legal_family = 'policy_issue_spotting' AND {_drawn('family')} < 0.25 THEN 'family' END,
        CASE WHEN cost_usd > 0.02 AND NOT isnan(cost_usd) THEN 'high_cost' END, CASE WHEN total_tokens > 6000 THEN 'high_tokens' END, CASE WHEN insufficient_answer = 1 THEN 'insufficient' END], lambda x: x IS NOT NULL), ',') AS reasons FROM req) WHERE reasons <> ''""",
    "family_pass_rates": f"WITH {_CASES} SELECT family, count(*) AS cases, sum(passed::INT)::BIGINT AS passed, (count(*) - sum(passed::INT))::BIGINT AS failed, round(avg(passed::INT), 6) AS pass_rate FROM cases GROUP BY family",
    "run_trends": f"WITH {_CASES} SELECT source_path, count(*) AS cases, sum(passed::INT)::BIGINT AS passed, round(avg(latency_ms), 6) AS mean_latency_ms, round(avg(cost_usd), 6) AS mean_cost_usd, round(avg(grounded::INT), 6) AS grounded_rate FROM cases GROUP BY source_path",
    "top_failing_runs": f"WITH {_CASES} SELECT source_path, count(*) AS cases, sum(passed::INT)::BIGINT AS passed, (count(*) - sum(passed::INT))::BIGINT AS failed, round(avg(passed::INT), 6) AS pass_rate FROM cases GROUP BY source_path HAVING failed > 0 ORDER BY failed DESC, pass_rate, source_path LIMIT 10",
    "failure_breakdown": f"WITH {_CASES} SELECT family, reason, count(*) AS failures FROM (SELECT family, unnest(list_concat(failing, CASE WHEN runner_status <> 'ok' THEN ['runner', 'runner'] ELSE [] END)) AS reason FROM cases) GROUP BY family, reason",
    "routing_confusion": f"""WITH {_CASES}, {_ITEMS}, k AS (SELECT source_path, case_id, min(family) AS case_family FROM cases WHERE case_id IS NOT NULL GROUP BY 1, 2)
        SELECT coalesce(case_family, 'unresolved') AS expected, {_UNKNOWN.format('i.family')} AS observed, count(*) AS items FROM items i LEFT JOIN k ON k.source_path = i.run_file AND k.case_id = substr(i.source_id, length(i.run_id) + 2) WHERE i.run_file IS NOT NULL GROUP BY 1, 2""",
    "run_gate": f"WITH {_CASES} SELECT source_path, count(*) AS cases, round(avg(passed::INT), 6) AS pass_rate, count(*) FILTER (WHERE coalesce(runner_status <> 'ok', true)) AS runner_failures, round(avg(passed::INT), 6) >= 0.6 AND count(*) FILTER (WHERE coalesce(runner_status <> 'ok', true)) <= 0 AS gate_passed FROM cases GROUP BY source_path",
    "citation_checks": f"WITH {_ITEMS}, {_CHECKS} SELECT id, citations, presence, in_scope, outside, excerpt_rate FROM graded",
    "citation_rollup": f"WITH {_ITEMS}, {_CHECKS} SELECT {_UNKNOWN.format('family')} AS family, count(*) AS items, round(avg(presence::INT), 6) AS presence_rate, round(avg(in_scope::INT), 6) AS scope_rate, sum(outside)::BIGINT AS outside FROM graded GROUP BY 1",
    "cited_parents_missing": f"WITH {_ITEMS}, c AS (SELECT DISTINCT review_item_id, c.parent_chunk_id AS p FROM (SELECT review_item_id, unnest(citations) AS c FROM items) WHERE c.parent_chunk_id IS NOT NULL) SELECT review_item_id, count(*) AS missing FROM c WHERE NOT EXISTS (SELECT 1 FROM parent_chunks x WHERE x.parent_chunk_id = c.p) GROUP BY 1",
    "queue_status_overlay": f"WITH {_ITEMS}, l AS (SELECT review_item_id, review_status FROM review_queue QUALIFY row_number() OVER (PARTITION BY review_item_id ORDER BY exported_at DESC, review_status DESC) = 1) SELECT category, CASE WHEN l.review_status IN {_KNOWN} THEN l.review_status ELSE 'pending_review' END AS review_status, count(*) AS items FROM items LEFT JOIN l USING (review_item_id) GROUP BY 1, 2",
    "queue_upsert": "SELECT category, review_status, count(*) AS items FROM (SELECT * FROM review_queue WHERE exported_at IS NOT NULL QUALIFY row_number() OVER (PARTITION BY review_item_id ORDER BY exported_at DESC, review_status DESC) = 1) GROUP BY 1, 2",
    "review_to_requests": f"WITH {_REQ}, {_ITEMS}, t AS (SELECT trace_id, count(*) AS requests, max(latency_ms) AS slowest_ms FROM req WHERE trace_id IS NOT NULL GROUP BY 1) SELECT category, count(*) AS items, count(requests) AS traced, sum(requests)::BIGINT AS requests, max(slowest_ms) AS slowest_ms FROM items LEFT JOIN t USING (trace_id) WHERE trace_id IS NOT NULL GROUP BY category",
    "embedding_hit_at_k": f"WITH {_HITS} SELECT query_id, best_rank, hit_at_1, hit_at_3, hit_at_5, hit_at_10 FROM g",
    "embedding_rollup": f"""WITH {_HITS} SELECT label, count(*) AS cases, round(avg((best_rank IS NOT NULL)::INT), 6) AS pass_rate, round(avg(hit_at_1), 6) AS recall_at_1, round(avg(hit_at_3), 6) AS recall_at_3, round(avg(hit_at_5), 6) AS recall_at_5, round(avg(hit_at_10), 6) AS recall_at_10,
        round(avg(best_rank), 6) AS mean_rank, median(best_rank) AS median_rank, count(best_rank) AS ranked, round(avg(wrong_share), 6) AS mean_wrong_share FROM g GROUP BY label""",
    "prior_values": f"WITH {_REQ}, p AS (SELECT legal_family, last_value(nullif(legal_family, '') IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY recorded_at, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM req WHERE trace_id IS NOT NULL) SELECT {_UNKNOWN.format('legal_family')} AS family, coalesce(prior, 'none') AS prior_family, count(*) AS requests FROM p GROUP BY 1, 2",
    "user_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g), n AS (SELECT user_id, sid, count(*) AS events FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(events) AS most_events FROM n GROUP BY 1",
}
