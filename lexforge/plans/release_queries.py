"""Release gates, series summaries and reports of failing groups over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import analytics as a
from lexforge.operators import gates as g
from lexforge.plans import analytics_queries as aq
from lexforge.plans import comparison_queries as cq

BASE, CANDIDATE = "answerer-1.8", "answerer-2.2-rc1"


def latency_series(spark: SparkSession, folder: str) -> DataFrame:
    rows = aq._requests(spark, folder, "legal_family", "latency_ms").filter("latency_ms >= 0")
    return g.series_summary(rows.select(a.or_unknown(F.col("legal_family")).alias("family"), F.col("latency_ms").cast("bigint").alias("latency_ms")), ["family"], "latency_ms")


def release_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Two model versions against the thresholds of each phase: latency percentiles and mean cost."""
    rows = aq._requests(spark, folder, "model_version", "latency_ms", "cost_usd").filter(F.col("model_version").isin(BASE, CANDIDATE))
    latency = a.exact_percentiles(rows.filter("latency_ms >= 0"), ["model_version"], "latency_ms", {"p95_latency": 0.95, "p99_latency": 0.99})
    cost = rows.filter(~F.isnan("cost_usd")).groupBy("model_version").agg(F.round(F.avg("cost_usd"), 9).alias("mean_cost"))
    wide = latency.join(cost, "model_version", "full_outer")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in g.GATES]))
    long = wide.select("model_version", each.alias("m")).groupBy("m.measure").agg(*[F.max(F.when(F.col("model_version") == v, F.col("m.value"))).alias(n) for n, v in (("baseline", BASE), ("candidate", CANDIDATE))])
    return g.gates(long)


def daily_regressions(spark: SparkSession, folder: str) -> DataFrame:
    """Days whose share of insufficient answers is above that of all days by a fifth, and whether the day before was so too."""
    days = aq._requests(spark, folder, "recorded_at", "insufficient_answer").groupBy(F.to_date("recorded_at").alias("day")).agg(F.count("*").alias("requests"), F.avg(F.coalesce("insufficient_answer", F.lit(0))).alias("share"))
    mean = days.agg((F.sum(F.col("share") * F.col("requests")) / F.sum("requests")).alias("mean"))  # one row
    marked = days.crossJoin(F.broadcast(mean)).withColumn("blocked", F.round("share", 9) > F.round(F.col("mean") * 1.2, 9)).withColumn("all", F.lit(0))
    return g.carried_over(marked, "all", ["day"], F.col("blocked")).select("day", "requests", F.round("share", 6).alias("share"), "blocked", "sustained")


def top_failing_families(spark: SparkSession, folder: str) -> DataFrame:
    return g.top_failing(aq._cases(spark, folder), "family", [F.col("source_path"), F.col("case_pos")])


def cases_of_families(spark: SparkSession, folder: str) -> DataFrame:
    """Cases of two families by run."""
    kept = g.filter_cases(aq._cases(spark, folder), ["chronology_date_event", "party_role_verification"])
    return kept.groupBy("source_path", "family").agg(F.count("*").alias("cases"))


QUERIES = {f.__name__: f for f in (latency_series, release_gates, daily_regressions, top_failing_families, cases_of_families)}

_REQ = aq._REQ
SQL = {
    "latency_series": f"""WITH {_REQ}, m AS (SELECT coalesce(nullif(legal_family, ''), 'unknown') AS family, latency_ms::BIGINT AS v FROM req WHERE latency_ms >= 0), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY family) AS n FROM m)
        SELECT family, any_value(n) AS count, round(avg(v), 6) AS mean, sum(v)::BIGINT AS total, max(v) FILTER (WHERE i = floor(0.5 * (n - 1))) AS p50, max(v) FILTER (WHERE i = floor(0.95 * (n - 1))) AS p95 FROM r GROUP BY family""",
    "release_gates": f"""WITH {_REQ}, q AS (SELECT * FROM req WHERE model_version IN ('{BASE}', '{CANDIDATE}')), l AS (SELECT model_version, latency_ms AS v, row_number() OVER (PARTITION BY model_version ORDER BY latency_ms) AS i, count(*) OVER (PARTITION BY model_version) AS n FROM q WHERE latency_ms >= 0),
        w AS (SELECT model_version, 'p95_latency' AS measure, max(v) FILTER (WHERE i = greatest(ceil(0.95 * n), 1))::DOUBLE AS value FROM l GROUP BY 1 UNION ALL SELECT model_version, 'p99_latency', max(v) FILTER (WHERE i = greatest(ceil(0.99 * n), 1)) FROM l GROUP BY 1
          UNION ALL SELECT model_version, 'mean_cost', round(avg(cost_usd), 9) FROM q WHERE cost_usd IS NOT NULL AND NOT isnan(cost_usd) GROUP BY 1),
        b AS (SELECT measure, max(value) FILTER (WHERE model_version = '{BASE}') AS baseline, max(value) FILTER (WHERE model_version = '{CANDIDATE}') AS candidate FROM w GROUP BY 1),
        t(measure, phase, threshold) AS (VALUES {", ".join(f"('{m}', '{p}', {x}::DOUBLE)" for m, by in g.GATES.items() for p, x in by.items())})
        SELECT measure, phase, baseline, candidate, round((candidate - baseline) / baseline, 6) AS rise, threshold, coalesce(round((candidate - baseline) / baseline, 6) > threshold, false) AS blocked FROM b JOIN t USING (measure)""",
    "daily_regressions": f"""WITH {_REQ}, d AS (SELECT (recorded_at AT TIME ZONE 'UTC')::DATE AS day, count(*) AS requests, avg(coalesce(insufficient_answer, 0)) AS share FROM req GROUP BY 1), m AS (SELECT sum(share * requests) / sum(requests) AS mean FROM d),
        b AS (SELECT day, requests, share, round(share, 9) > round(mean * 1.2, 9) AS blocked FROM d, m) SELECT day, requests, round(share, 6) AS share, blocked, coalesce(sum(blocked::INT) OVER (ORDER BY day NULLS FIRST ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2, false) AS sustained FROM b""",
    "top_failing_families": f"""WITH {cq._X}, g AS (SELECT family, count(*) AS cases, count(*) FILTER (WHERE NOT passed) AS failed, round(avg((NOT passed)::INT), 6) AS fail_rate, min((source_path, case_pos)) AS f FROM cases GROUP BY 1) SELECT family, cases, failed, fail_rate FROM g ORDER BY failed DESC, fail_rate DESC, f LIMIT 10""",
    "cases_of_families": f"WITH {cq._X} SELECT source_path, family, count(*) AS cases FROM cases WHERE family IN ('chronology_date_event', 'party_role_verification') GROUP BY 1, 2",
}
