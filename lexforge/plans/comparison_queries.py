"""Comparisons of runs, queues, and the ranking, merging and text functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import text as t
from lexforge.operators import comparison as c
from lexforge.operators import ranking as k
from lexforge.operators.dedup import one_per_key
from lexforge.plans import analytics_queries as aq
from lexforge.plans import evidence_queries as eq
from lexforge.plans import retrieval_queries as rq
from lexforge.session import cut
from lexforge.sources.tables import table


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "trace_runs"), ["source_path"], ["loaded_at"], ["runner", "generated_at_utc"])


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return c.previous_runs(_runs(spark, folder), "runner", ["generated_at_utc", "source_path"])


def _cases(spark: SparkSession, folder: str) -> DataFrame:
    """The cases of all runs, read from the JSON once."""
    return cut(aq._cases(spark, folder), "cases")


def run_case_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Each run against the one before it of its runner: how many of the cases both have got better or worse."""
    changes = c.case_changes(_cases(spark, folder), _pairs(spark, folder))
    return changes.groupBy("candidate", "baseline").agg(F.count("*").alias("compared"), *[F.count_if(F.col("change") == x).alias(x) for x in ("improved", "regressed", "unchanged")])


def worst_regressions(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten cases of each run, in its own order, that passed before and fail now."""
    worse = c.case_changes(_cases(spark, folder), _pairs(spark, folder)).filter("change = 'regressed'")
    return k.tail(worse, "candidate", [F.asc("case_pos")], 10).select("candidate", "baseline", "case_id", "family", F.col("from_end").alias("place"))


def run_family_changes(spark: SparkSession, folder: str) -> DataFrame:
    d = c.family_changes(_cases(spark, folder), _pairs(spark, folder))
    return d.select("candidate", "baseline", "family", "before_cases", "now_cases", F.round("delta", 6).alias("delta"), "status", F.round("delta_or_zero", 6).alias("delta_or_zero"))


def run_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return c.verdicts(_cases(spark, folder), _pairs(spark, folder))


def run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Per run: cases, those that ran, and its families in order."""
    cases = aq._cases(spark, folder)
    return cases.groupBy("source_path").agg(F.count("*").alias("cases"), F.count_if(F.col("runner_status") == "ok").alias("ran"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"))


def recent_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The last three runs of each runner that hold a case."""
    held = _runs(spark, folder).join(aq._cases(spark, folder).select("source_path").distinct(), "source_path", "left_semi")
    return k.tail(held, "runner", [F.desc_nulls_last("generated_at_utc"), F.desc("source_path")], 3).select("runner", "source_path", "from_end")


def case_violations(spark: SparkSession, folder: str) -> DataFrame:
    """How many cases of each run break each rule of an eval case."""
    broken = c.violations(aq._cases(spark, folder)).select("source_path", F.explode("violations").alias("rule"))
    return broken.groupBy("source_path", "rule").agg(F.count("*").alias("cases"))


def answerability_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return c.answerability(aq._cases(spark, folder), "family")


def triage_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Failed cases with the status that their review item holds, if there is one."""
    items = one_per_key(table(spark, folder, "review_queue").filter("source_type = 'offline_eval_run'"), ["source_id"], ["exported_at", "review_item_id"], ["review_status"], latest=True)
    queue = c.triage(aq._cases(spark, folder), items.select(F.col("source_id").alias("issue_id"), F.col("review_status").alias("status")))
    return queue.select("issue_id", "source_path", "case_pos", "family", "summary", "status")


def review_categories(spark: SparkSession, folder: str) -> DataFrame:
    return c.review_categories(aq._cases(spark, folder)).select("source_path", "case_pos", "review_item_id", "category", "family")


def first_failed_stages(spark: SparkSession, folder: str) -> DataFrame:
    """The first span of each case that is no success."""
    nodes = eq._nodes(spark, folder, bodies=True).filter("kind = 'spans'")
    got = lambda n: F.try_variant_get(F.try_parse_json("body"), f"$.{n}", "string")
    spans = nodes.select("root_key", F.regexp_extract("node_path", r"^(cases\[[0-9]+\])", 1).alias("case_path"), "position", got("stage").alias("stage"), got("status").alias("status"))
    first = spans.filter(~F.col("status").eqNullSafe("success")).groupBy("root_key", "case_path").agg(F.min_by(F.struct("stage", "status"), "position").alias("f"))
    return first.select("root_key", "case_path", "f.stage", "f.status")


def trace_links(spark: SparkSession, folder: str) -> DataFrame:
    """Per trace: how many review exports link to it, the first and the latest. A hot trace is two extremes a task, never a list."""
    linked = table(spark, folder, "review_queue").filter(F.col("trace_id") != "")
    row = F.struct("exported_at", "review_item_id")
    at = lambda f: F.date_format(f(row)["exported_at"], "yyyy-MM-dd HH:mm:ss")
    return linked.groupBy("trace_id").agg(F.count("*").alias("links"), F.max(row)["review_item_id"].alias("latest_item"), at(F.max).alias("latest_at"), at(F.min).alias("first_at"))


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return aq._items(spark, folder)


def selected_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The selected documents of each item by position, and whether the document table's parents know them."""
    ids = _items(spark, folder).select("review_item_id", F.posexplode("selected_document_ids").alias("position", "document_id"))
    known = table(spark, folder, "parent_chunks").select("document_id").distinct().withColumn("known", F.lit(True))
    return ids.join(known, "document_id", "left").select("review_item_id", "position", "document_id", F.coalesce("known", F.lit(False)).alias("known"))


def scope_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Each item's selected documents against the cited ones: covered, not covered, cited from outside, and whether they have none in common."""
    docs = F.array_distinct(F.filter(F.transform(F.filter("citations", lambda x: x.isNotNull()), lambda x: x["document_id"]), lambda x: x.isNotNull() & (x != "")))
    scope = F.array_distinct(F.filter("selected_document_ids", lambda x: x.isNotNull() & (x != "")))
    none = F.array().cast("array<string>")
    d = _items(spark, folder).select("review_item_id", F.coalesce(docs, none).alias("docs"), F.coalesce(scope, none).alias("scope")).filter(F.size("scope") > 0)
    missing = F.array_join(F.array_sort(F.array_except("scope", "docs")), ",")
    both = F.size(F.array_intersect("scope", "docs"))
    return d.select("review_item_id", both.alias("covered"), missing.alias("missing"), F.size(F.array_except("docs", "scope")).alias("outside"), ((F.size("docs") > 0) & (both == 0)).alias("disjoint"))


def best_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    """The sentence of each item's answer that fits its query best, with a qualifier."""
    return _items_with_query(spark, folder).select("review_item_id", k.best_excerpt(F.col("final_answer"), F.col("query")).alias("excerpt")).filter("excerpt IS NOT NULL")


def _items_with_query(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "review_queue"), ["review_item_id"], ["exported_at"], ["query", "final_answer", "citations"])


def relevant_parents(spark: SparkSession, folder: str) -> DataFrame:
    """Of the parents an item cites, the four that hold most of its query's terms."""
    cited = _items_with_query(spark, folder).select(F.col("review_item_id").alias("query_id"), "query", F.posexplode("citations").alias("place", "x")).select("query_id", "query", "place", F.col("x.parent_chunk_id").alias("id"))
    cited = cited.filter("id IS NOT NULL").groupBy("query_id", "query", "id").agg(F.min("place").alias("place"))
    parents = one_per_key(table(spark, folder, "parent_chunks"), ["parent_chunk_id"], ["ingested_at"], ["text"]).withColumnRenamed("parent_chunk_id", "id")
    return k.relevant(cited.join(parents, "id")).select("query_id", "id", "overlap", "rank")


def chronology(spark: SparkSession, folder: str) -> DataFrame:
    """Every dated mention in the parents, with its place and its surroundings."""
    parents = one_per_key(table(spark, folder, "parent_chunks"), ["parent_chunk_id"], ["ingested_at"], ["text"])
    return k.chronology(parents.select(F.col("parent_chunk_id").alias("id"), "text")).withColumnRenamed("id", "parent_chunk_id")


def merged_hits(spark: SparkSession, folder: str) -> DataFrame:
    """A root list by overlap and a subquery's list by keywords, merged by document."""
    dense, sparse = rq._ranked(spark, folder)
    none = F.lit(None)
    root = dense.select("query_id", none.cast("string").alias("subquery_id"), "rank", "id", F.col("score").alias("dense_score"), none.cast("double").alias("sparse_score"))
    sub = sparse.select("query_id", F.lit("s1").alias("subquery_id"), "rank", "id", none.cast("double").alias("dense_score"), F.col("score").alias("sparse_score"))
    return k.merge_hits(root.unionByName(sub)).select("query_id", "id", "dense_score", "sparse_score", "from_root", F.array_join("subquery_ids", ",").alias("subquery_ids"), "hits", "place")


def _scope(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("matter_id").alias("document_id"))
    return docs, docs.filter((F.col("id") % rq.EVERY == 0) & F.col("document_id").isNotNull()).select(F.col("id").alias("query_id"), "document_id")


def scoped_search_post(spark: SparkSession, folder: str) -> DataFrame:
    """Hits outside a query's matter are dropped after the ranking; queries without a matter keep all."""
    docs, scope = _scope(spark, folder)
    hits = cut(rq.token_overlap_topk(spark, folder), "hits")  # both sides of the scope read them
    return k.in_scope(hits.join(docs, "id"), scope, pushdown=False).select("query_id", "id", "score", "rank")


def normal_queries(spark: SparkSession, folder: str) -> DataFrame:
    items = _items_with_query(spark, folder).filter("query IS NOT NULL")
    return items.select("review_item_id", t.normal_term(F.col("query")).alias("term"))


def date_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    """The bounds that `after`, `since`, `before` and `until` set in documents: how many name each year."""
    docs = table(spark, folder, "documents").select(t.date_boundary(F.col("text"), True).alias("date_from"), t.date_boundary(F.col("text"), False).alias("date_to"))
    return docs.groupBy("date_from", "date_to").agg(F.count("*").alias("documents"))


def heading_confidence(spark: SparkSession, folder: str) -> DataFrame:
    parents = one_per_key(table(spark, folder, "parent_chunks"), ["parent_chunk_id"], ["ingested_at"], ["heading_text", "source_name"])
    return parents.select("parent_chunk_id", t.hint_confidence(F.col("source_name"), F.col("heading_text")).alias("confidence"))


def safe_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The total_tokens of exported lines as counts, by stream: how many are one, and their sum."""
    v = table(spark, folder, "raw_records").select("stream_name", t.json_object(F.col("body")).alias("v"))
    n = t.safe_count(F.try_variant_get("v", "$.total_tokens", "variant"))
    return v.groupBy("stream_name").agg(F.count(n).alias("counts"), F.sum(n).alias("total"))


def repaired_records(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each stream that hold a JSON object, as they stand or within other text."""
    lines = table(spark, folder, "raw_records")
    return lines.groupBy("stream_name").agg(F.count("*").alias("lines"), F.count(t.json_object(F.col("body"))).alias("readable"))


def sub_questions(spark: SparkSession, folder: str) -> DataFrame:
    items = _items_with_query(spark, folder)
    return items.select("review_item_id", F.posexplode(t.sub_queries(F.col("query"))).alias("position", "part"))


def heading_topics(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each parent's text speaks of its heading."""
    parents = one_per_key(table(spark, folder, "parent_chunks"), ["parent_chunk_id"], ["ingested_at"], ["heading_text", "text"])
    return parents.select("parent_chunk_id", t.topic_in_text(F.col("text"), F.col("heading_text")).alias("on_topic"))


def model_versions(spark: SparkSession, folder: str) -> DataFrame:
    return aq._requests(spark, folder, "model_version", "pipeline_mode").groupBy(t.version_or(F.col("model_version")).alias("model_version"), t.version_or(F.col("pipeline_mode"), "default").alias("pipeline_mode")).agg(F.count("*").alias("requests"))


def index_diagnostics(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of the children at an index: each row gets its own outcome, and none stops the others."""
    rows = one_per_key(table(spark, folder, "child_chunks"), ["child_chunk_id"], ["ingested_at"], ["parent_chunk_id", "document_id", "text"])
    missing = (F.coalesce(F.length("parent_chunk_id"), F.lit(0)) == 0) | (F.coalesce(F.length("document_id"), F.lit(0)) == 0) | F.col("child_chunk_id").isNull()
    outcome = F.when(missing, "failed").when(~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)), "skipped").otherwise("indexed")
    n = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return rows.withColumn("outcome", outcome).agg(F.count("*").alias("received"), n("indexed"), n("failed"), n("skipped"))


QUERIES = {
    f.__name__: f
    for f in (
        run_case_changes, worst_regressions, run_family_changes, run_verdicts, run_summaries, recent_runs, case_violations, answerability_rollup, triage_queue, review_categories, first_failed_stages, trace_links,
        selected_documents, scope_coverage, best_excerpts, relevant_parents, chronology, merged_hits, scoped_search_post, normal_queries, date_boundaries, heading_confidence, safe_token_counts, repaired_records,
        sub_questions, heading_topics, model_versions, index_diagnostics,
    )
}

_PAIRS = """pr AS (SELECT source_path AS candidate, lag(source_path) OVER (PARTITION BY runner ORDER BY generated_at_utc NULLS FIRST, source_path) AS baseline FROM (SELECT * FROM trace_runs QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY loaded_at) = 1) QUALIFY baseline IS NOT NULL)"""
_X = """runs AS (SELECT * FROM trace_runs QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY loaded_at) = 1),
 parsed AS (SELECT source_path, coalesce(nullif(generated_at_utc, ''), nullif(run_id, ''), regexp_extract(source_path, '([^/]*?)(?:\\.[^./]*)?$', 1)) AS run, CASE WHEN json_valid(cases) THEN cases::JSON END AS j FROM runs WHERE cases IS NOT NULL),
 lists AS (SELECT source_path, run, CASE json_type(j) WHEN 'ARRAY' THEN json_extract(j, '$[*]') WHEN 'OBJECT' THEN [j] END AS l FROM parsed),
 listed AS (SELECT source_path, run, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS case_pos FROM lists),
 objs AS (SELECT source_path, run, c, case_pos, c->>'$.case_id' AS case_id, coalesce(nullif(c->>'$.family', ''), 'unknown') AS family, c->>'$.runner_status' AS runner_status, c->>'$.error' AS error, c->>'$.query' AS query,
  coalesce(c->>'$.system_result.grounded', c->>'$.system_output.grounded')::BOOLEAN AS grounded,
  coalesce(c->>'$.system_result.latency_ms', c->>'$.system_output.latency_ms')::DOUBLE AS latency, coalesce(c->>'$.system_result.cost_usd', c->>'$.system_output.cost_usd')::DOUBLE AS cost,
  CASE WHEN json_type(c, '$.system_result.citations') = 'ARRAY' THEN json_array_length(c, '$.system_result.citations') WHEN json_type(c, '$.system_output.citations') = 'ARRAY' THEN json_array_length(c, '$.system_output.citations') END AS citations,
  CASE WHEN json_type(c, '$.selected_document_ids') = 'ARRAY' THEN json_array_length(c, '$.selected_document_ids') END AS selected, (c->>'$.selected_document_required')::BOOLEAN AS required,
  (c->>'$.follow_up.depends_on_prior_turn')::BOOLEAN AS depends, CASE WHEN json_type(c, '$.follow_up.prior_messages') = 'ARRAY' THEN json_array_length(c, '$.follow_up.prior_messages') END AS messages,
  CASE WHEN json_type(c, '$.system_result.warnings') = 'ARRAY' THEN c->'$.system_result.warnings' WHEN json_type(c, '$.system_output.warnings') = 'ARRAY' THEN c->'$.system_output.warnings' END AS warnings,
  coalesce(json_keys(c, '$.deterministic_eval_results'), []) AS ks, (c->>'$.deterministic_eval_results.answerability_checks.passed')::BOOLEAN AS answerability, (c->>'$.deterministic_eval_results.citation_checks.passed')::BOOLEAN AS citation_check,
  (c->>'$.deterministic_eval_results.family_routing.passed')::BOOLEAN AS routing, (c->>'$.llm_judge_results.groundedness.passed')::BOOLEAN AS groundedness FROM listed WHERE json_type(c) = 'OBJECT'),
 cs AS (SELECT *, list_filter(ks, lambda k: json_extract_string(c, '$.deterministic_eval_results.' || k || '.passed') = 'false') AS failing FROM objs),
 cases AS (SELECT *, coalesce(runner_status = 'ok', false) AND len(failing) = 0 AS passed FROM cs)"""
_CHANGES = f"""{_X}, {_PAIRS}, lc AS (SELECT * FROM cases WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path, case_id ORDER BY case_pos DESC) = 1),
 ch AS (SELECT candidate, baseline, n.case_id, n.case_pos, n.family, CASE WHEN n.passed = o.passed THEN 'unchanged' WHEN n.passed THEN 'improved' ELSE 'regressed' END AS change FROM pr JOIN lc n ON n.source_path = candidate JOIN lc o ON o.source_path = baseline AND o.case_id = n.case_id)"""
_FAMILIES = f"""{_X}, {_PAIRS}, fr AS (SELECT source_path, family, count(*) AS n, avg(passed::INT) AS rate FROM cases GROUP BY 1, 2),
 fk AS (SELECT DISTINCT candidate, baseline, family FROM pr JOIN fr ON fr.source_path IN (candidate, baseline)),
 fc AS (SELECT candidate, baseline, fk.family, coalesce(o.n, 0) AS before_cases, coalesce(w.n, 0) AS now_cases, round(w.rate - o.rate, 9) AS delta, round(coalesce(w.rate, 0) - coalesce(o.rate, 0), 9) AS delta_or_zero FROM fk LEFT JOIN fr w ON w.source_path = candidate AND w.family = fk.family LEFT JOIN fr o ON o.source_path = baseline AND o.family = fk.family),
 fs AS (SELECT *, CASE WHEN delta IS NULL THEN 'unavailable' WHEN abs(delta) < 1e-12 THEN 'unchanged' WHEN delta > 0 THEN 'improved' ELSE 'regressed' END AS status FROM fc)"""


def _trend(delta: str, up: str, down: str) -> str:
    return f"CASE WHEN {delta} IS NULL THEN 'unavailable' WHEN abs(round({delta}, 9)) < 1e-12 THEN 'unchanged' WHEN {delta} > 0 THEN '{up}' ELSE '{down}' END"


_ITEMS = "it AS (SELECT * FROM review_queue QUALIFY row_number() OVER (PARTITION BY review_item_id ORDER BY exported_at) = 1)"
_PA = "pa AS (SELECT * FROM parent_chunks QUALIFY row_number() OVER (PARTITION BY parent_chunk_id ORDER BY ingested_at) = 1)"
_TERMS = "list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in t.STOP_WORDS) + "], w))"
_QUALIFIES = "(" + " OR ".join(f"contains(lower(s), '{w}')" for w in k.QUALIFIER_TERMS) + ")"
_CANON = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_BARE = r"regexp_replace(body, '^\s+|\s+$', '', 'g')"
_FENCED = rf"coalesce(nullif(regexp_extract({_BARE}, '(?is)^```(?:json)?\s*(.*?)\s*```$', 1), ''), {_BARE})"
_BLOCK = rf"regexp_extract({_FENCED}, '(?s)(\{{.*\}})', 1)"
_CLOSED = r"CASE WHEN regexp_matches({0}, '(?s)^(\{{.*\}}|\[.*\])$') AND json_valid({0}) THEN ({0})::JSON END"
_OBJECT = f"coalesce({_CLOSED.format(_FENCED)}, {_CLOSED.format(_BLOCK)})"

SQL = {
    "run_case_changes": f"WITH {_CHANGES} SELECT candidate, baseline, count(*) AS compared, count(*) FILTER (WHERE change = 'improved') AS improved, count(*) FILTER (WHERE change = 'regressed') AS regressed, count(*) FILTER (WHERE change = 'unchanged') AS unchanged FROM ch GROUP BY 1, 2",
    "worst_regressions": f"WITH {_CHANGES} SELECT candidate, baseline, case_id, family, row_number() OVER (PARTITION BY candidate ORDER BY case_pos) AS place FROM ch WHERE change = 'regressed' QUALIFY place <= 10",
    "run_family_changes": f"WITH {_FAMILIES} SELECT candidate, baseline, family, before_cases, now_cases, round(delta, 6) AS delta, status, round(delta_or_zero, 6) AS delta_or_zero FROM fs",
    "run_verdicts": f"""WITH {_FAMILIES}, m AS (SELECT source_path, avg(passed::INT) AS rate, avg(citation_check::INT) AS citations, avg(CASE WHEN answerability IS NOT NULL THEN (NOT answerability AND coalesce(grounded, false))::INT END) AS fc, avg(latency) AS latency, avg(cost) AS cost FROM cases GROUP BY 1),
        w AS (SELECT candidate, count(*) FILTER (WHERE status = 'regressed') AS family_regressions FROM fs GROUP BY 1),
        d AS (SELECT pr.candidate, pr.baseline, coalesce(w.family_regressions, 0) AS family_regressions, {_trend("n.rate - o.rate", "improved", "regressed")} AS rate_trend,
          ({_trend("n.citations - o.citations", "improved", "regressed")} = 'regressed')::INT + ({_trend("n.fc - o.fc", "regressed", "improved")} = 'regressed')::INT AS risk_regressions,
          ({_trend("n.latency - o.latency", "regressed", "improved")} = 'regressed')::INT + ({_trend("n.cost - o.cost", "regressed", "improved")} = 'regressed')::INT AS slower_or_dearer
          FROM pr JOIN m n ON n.source_path = pr.candidate JOIN m o ON o.source_path = pr.baseline LEFT JOIN w ON w.candidate = pr.candidate)
        SELECT *, CASE WHEN rate_trend = 'regressed' OR risk_regressions > 0 OR family_regressions > 0 THEN 'review' WHEN rate_trend = 'improved' AND slower_or_dearer = 0 THEN 'better' ELSE 'mixed' END AS verdict FROM d""",
    "run_summaries": f"WITH {_X} SELECT source_path, count(*) AS cases, count(*) FILTER (WHERE runner_status = 'ok') AS ran, array_to_string(list_sort(list(DISTINCT family)), ',') AS families FROM cases GROUP BY 1",
    "recent_runs": f"WITH {_X} SELECT runner, source_path, row_number() OVER (PARTITION BY runner ORDER BY generated_at_utc DESC NULLS LAST, source_path DESC) AS from_end FROM runs WHERE source_path IN (SELECT source_path FROM cases) QUALIFY from_end <= 3",
    "case_violations": rf"""WITH {_X}, b AS (SELECT source_path, unnest([CASE WHEN NOT coalesce(regexp_matches(case_id, '^[a-z0-9][a-z0-9._-]*$'), false) THEN 'id' END, CASE WHEN NOT coalesce(regexp_matches(query, '\S'), false) THEN 'query' END, CASE WHEN selected IS NULL THEN 'selected_document_ids' END,
        CASE WHEN coalesce(required, false) AND coalesce(selected, 0) = 0 THEN 'selected_document_required' END, CASE WHEN coalesce(depends, false) AND coalesce(messages, 0) = 0 THEN 'follow_up' END]) AS rule FROM cases) SELECT source_path, rule, count(*) AS cases FROM b WHERE rule IS NOT NULL GROUP BY 1, 2""",
    "answerability_rollup": f"""WITH {_X}, a AS (SELECT family, answerability AND coalesce(grounded, false) AS cs, answerability AND NOT coalesce(grounded, false) AS ci, NOT answerability AND coalesce(grounded, false) AS fp, NOT answerability AND NOT coalesce(grounded, false) AS fn FROM cases WHERE answerability IS NOT NULL)
        SELECT family, count(*) AS cases, sum(cs::INT)::BIGINT AS correct_supported_count, sum(ci::INT)::BIGINT AS correct_insufficient_count, sum(fp::INT)::BIGINT AS false_positive_count, sum(fn::INT)::BIGINT AS false_negative_count,
        round(avg(cs::INT), 6) AS correct_supported_rate, round(avg(ci::INT), 6) AS correct_insufficient_rate, round(avg(fp::INT), 6) AS false_positive_rate, round(avg(fn::INT), 6) AS false_negative_rate FROM a GROUP BY 1""",
    "triage_queue": f"""WITH {_X}, k AS (SELECT source_id, review_status FROM review_queue WHERE source_type = 'offline_eval_run' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY exported_at DESC, review_item_id DESC, review_status DESC) = 1),
        f AS (SELECT run || ':' || coalesce(nullif(case_id, ''), 'unknown_case') AS issue_id, source_path, case_pos, family, CASE WHEN NOT coalesce(runner_status = 'ok', false) THEN coalesce(nullif(error, ''), 'runner failed') ELSE array_to_string(list_sort(failing), ', ') END AS summary FROM cases WHERE NOT passed)
        SELECT issue_id, source_path, case_pos, family, summary, coalesce(review_status, 'untriaged') AS status FROM f LEFT JOIN k ON k.source_id = issue_id""",
    "review_categories": f"""WITH {_X}, r AS (SELECT source_path, case_pos, family, run || ':' || coalesce(nullif(case_id, ''), 'unknown_case') AS sid, unnest([CASE WHEN coalesce(NOT citation_check, false) OR coalesce(citations = 0, false) THEN 'missing_citation' END, CASE WHEN coalesce(NOT routing, false) THEN 'family_routing_disagreement' END,
        CASE WHEN coalesce(NOT groundedness, false) OR coalesce(len(list_filter(json_extract_string(warnings, '$[*]'), lambda w: contains(lower(w), 'hallucin'))) > 0, false) THEN 'suspected_hallucination' END, CASE WHEN family = 'policy_issue_spotting' AND NOT passed THEN 'legal_issue_spotting_disagreement' END]) AS category FROM cases)
        SELECT source_path, case_pos, 'review:' || category || ':' || sid AS review_item_id, category, family FROM r WHERE category IS NOT NULL""",
    "first_failed_stages": "WITH "
    + eq._SPANS.replace("unnest(CASE json_type(s) WHEN 'ARRAY' THEN json_extract(s, '$[*]') WHEN 'OBJECT' THEN [s] END) AS s FROM sl", "unnest(l) AS s, generate_subscripts(l, 1) AS n FROM (SELECT *, CASE json_type(s) WHEN 'ARRAY' THEN json_extract(s, '$[*]') WHEN 'OBJECT' THEN [s] END AS l FROM sl)").replace("SELECT root_key, case_path, s->>'$.stage'", "SELECT root_key, case_path, n, s->>'$.stage'")
    + " SELECT root_key, case_path, stage, status FROM spans WHERE status IS DISTINCT FROM 'success' QUALIFY row_number() OVER (PARTITION BY root_key, case_path ORDER BY n) = 1",
    "trace_links": "SELECT trace_id, count(*) AS links, arg_max(review_item_id, (exported_at, review_item_id)) AS latest_item, strftime(max(exported_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS latest_at, strftime(min(exported_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS first_at FROM review_queue WHERE trace_id <> '' GROUP BY 1",
    "selected_documents": f"WITH {_ITEMS}, x AS (SELECT review_item_id, unnest(selected_document_ids) AS document_id, generate_subscripts(selected_document_ids, 1) - 1 AS position FROM it) SELECT review_item_id, position, document_id, document_id IS NOT NULL AND document_id IN (SELECT document_id FROM parent_chunks WHERE document_id IS NOT NULL) AS known FROM x",
    "scope_coverage": f"""WITH {_ITEMS}, d AS (SELECT review_item_id, coalesce(list_distinct(list_filter(list_transform(list_filter(citations, lambda x: x IS NOT NULL), lambda x: x.document_id), lambda x: x IS NOT NULL AND x <> '')), []) AS docs, coalesce(list_distinct(list_filter(selected_document_ids, lambda x: x IS NOT NULL AND x <> '')), []) AS scope FROM it)
        SELECT review_item_id, len(list_intersect(scope, docs)) AS covered, array_to_string(list_sort(list_filter(scope, lambda x: NOT list_contains(docs, x))), ',') AS missing, len(list_filter(docs, lambda x: NOT list_contains(scope, x))) AS outside, len(docs) > 0 AND len(list_intersect(scope, docs)) = 0 AS disjoint FROM d WHERE len(scope) > 0""",
    "best_excerpts": rf"""WITH {_ITEMS}, s0 AS (SELECT review_item_id, query, string_split(regexp_replace(final_answer, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM it WHERE final_answer IS NOT NULL),
        s1 AS (SELECT review_item_id, query, regexp_replace(unnest(ss), '^\s+|\s+$', '', 'g') AS s, generate_subscripts(ss, 1) AS i FROM s0),
        s2 AS (SELECT *, len(list_filter(coalesce({_TERMS}, []), lambda w: contains(lower(s), w))) AS o, {_QUALIFIES} AS q FROM s1 WHERE s <> ''),
        b AS (SELECT review_item_id, s FROM s2 QUALIFY row_number() OVER (PARTITION BY review_item_id ORDER BY CASE WHEN query IS NULL THEN 1 ELSE -o END, NOT q, length(s), i) = 1), f AS (SELECT review_item_id, s AS q FROM s2 WHERE q QUALIFY row_number() OVER (PARTITION BY review_item_id ORDER BY i) = 1)
        SELECT b.review_item_id, CASE WHEN f.q IS NOT NULL AND NOT contains(b.s, f.q) THEN b.s || ' ' || f.q ELSE b.s END AS excerpt FROM b LEFT JOIN f USING (review_item_id)""",
    "relevant_parents": f"""WITH {_ITEMS}, {_PA}, x AS (SELECT review_item_id AS query_id, query, unnest(citations).parent_chunk_id AS id, generate_subscripts(citations, 1) AS place FROM it), y AS (SELECT query_id, query, id, min(place) AS place FROM x WHERE id IS NOT NULL GROUP BY ALL),
        z AS (SELECT query_id, id, place, len(list_filter({_TERMS}, lambda w: contains(lower(pa.text), w))) AS overlap FROM y JOIN pa ON pa.parent_chunk_id = y.id)
        SELECT query_id, id, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, place, id) AS rank FROM z WHERE overlap > 0 QUALIFY rank <= 4""",
    "merged_hits": f"""WITH {rq._CTE}, d AS ({rq._top(rq._OVERLAP.format(where=''))}), s AS ({rq._top(rq._KEYWORD)}), h AS (SELECT query_id, id, 0 AS l, rank, score AS ds, NULL::DOUBLE AS ss FROM d UNION ALL SELECT query_id, id, 1, rank, NULL, score FROM s),
        g AS (SELECT query_id, id, max(ds) AS dense_score, max(ss) AS sparse_score, min(l) = 0 AS from_root, CASE WHEN max(l) = 1 THEN 's1' ELSE '' END AS subquery_ids, count(*) AS hits, min((l, rank)) AS f FROM h GROUP BY 1, 2)
        SELECT * EXCLUDE f, row_number() OVER (PARTITION BY query_id ORDER BY f) AS place FROM g""",
    "scoped_search_post": f"""WITH {rq._CTE}, d AS ({rq._top(rq._OVERLAP.format(where=''))}) SELECT query_id, id, score, rank FROM d JOIN documents h ON h.doc_id = id JOIN documents q ON q.doc_id = query_id WHERE q.matter_id IS NULL OR q.matter_id = h.matter_id""",
    "normal_queries": rf"WITH {_ITEMS} SELECT review_item_id, regexp_replace(regexp_replace(trim(regexp_replace(lower(query), '[^a-z0-9\s]', ' ', 'g')), '\b([a-z]{{3,}})s\b', '\1', 'g'), '\s+', ' ', 'g') AS term FROM it WHERE query IS NOT NULL",
    "date_boundaries": r"""WITH y AS (SELECT lower(text) AS t, nullif(regexp_extract(text, '\b((?:19|20)\d{2})\b', 1), '') AS y FROM documents) SELECT CASE WHEN contains(t, 'after') OR contains(t, 'since') THEN y || '-01-01' END AS date_from, CASE WHEN contains(t, 'before') OR contains(t, 'until') THEN y || '-12-31' END AS date_to, count(*) AS documents FROM y GROUP BY 1, 2""",
    "heading_confidence": f"""WITH {_PA}, x AS (SELECT parent_chunk_id, coalesce({_CANON.format("source_name")}, '') AS a, coalesce({_CANON.format("heading_text")}, '') AS b FROM pa), y AS (SELECT *, string_split(a, ' ') AS p, string_split(b, ' ') AS q FROM x)
        SELECT parent_chunk_id, CASE WHEN a = '' OR b = '' THEN 0 WHEN a = b THEN 1 WHEN contains(a, b) OR contains(b, a) THEN round(least(len(p), len(q)) / greatest(len(p), len(q))::DOUBLE, 6) ELSE round(len(list_intersect(list_distinct(p), list_distinct(q))) / greatest(len(p), len(q))::DOUBLE, 6) END AS confidence FROM y""",
    "safe_token_counts": rf"""WITH v AS (SELECT stream_name, {_OBJECT} AS v FROM raw_records), x AS (SELECT stream_name, json_type(v, '$.total_tokens') AS k, trim(v->>'$.total_tokens') AS s FROM v),
        n AS (SELECT stream_name, CASE WHEN k IN ('UBIGINT', 'BIGINT', 'VARCHAR') AND regexp_matches(s, '^[+-]?\d+$') THEN try_cast(s AS BIGINT) WHEN k = 'DOUBLE' AND try_cast(s AS DOUBLE) % 1 = 0 THEN try_cast(s AS DOUBLE)::BIGINT END AS n FROM x)
        SELECT stream_name, count(n) FILTER (WHERE n >= 0) AS counts, sum(n) FILTER (WHERE n >= 0)::BIGINT AS total FROM n GROUP BY 1""",
    "repaired_records": f"SELECT stream_name, count(*) AS lines, count({_OBJECT}) AS readable FROM raw_records GROUP BY 1",
    "model_versions": "SELECT coalesce(nullif(trim(model_version), ''), 'unknown') AS model_version, coalesce(nullif(trim(pipeline_mode), ''), 'default') AS pipeline_mode, count(*) AS requests FROM (SELECT * FROM request_metrics QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY received_at) = 1) GROUP BY 1, 2",
    "index_diagnostics": r"WITH c AS (SELECT * FROM child_chunks QUALIFY row_number() OVER (PARTITION BY child_chunk_id ORDER BY ingested_at) = 1), o AS (SELECT CASE WHEN coalesce(length(parent_chunk_id), 0) = 0 OR coalesce(length(document_id), 0) = 0 OR child_chunk_id IS NULL THEN 'failed' WHEN NOT coalesce(regexp_matches(text, '\S'), false) THEN 'skipped' ELSE 'indexed' END AS o FROM c) SELECT count(*) AS received, count(*) FILTER (WHERE o = 'indexed') AS indexed, count(*) FILTER (WHERE o = 'failed') AS failed, count(*) FILTER (WHERE o = 'skipped') AS skipped FROM o",
}
