"""Group-by, percentile and comparison analytics over request metrics and evaluation runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def or_unknown(key: Column) -> Column:
    """Null and empty keys count as 'unknown'."""
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("unknown"))


def rate(flag: Column) -> Column:
    """Share of rows with the flag set (1 or true); 0 without rows. Null flags count as not set."""
    return F.coalesce(F.avg(F.coalesce(flag.cast("int"), F.lit(0)).cast("double")), F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], rank: str = "nearest") -> DataFrame:
    """Exact percentiles per key: one column per name in `quantiles`.

    rank `nearest` takes element max(0, ceil(q * n) - 1) of the sorted values, `floor` element int(q * (n - 1)): two definitions in use, kept
    apart. Values are counted in the map tasks and only distinct values are ranked; meant for values of a limited range (whole
    milliseconds). Nulls aren't values; a key without values has no row. For real numbers over billions of rows use the digests.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = counts.withColumns({"_upto": F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_n").over(w)})

    def index(q: float) -> Column:
        if rank == "nearest":
            return F.greatest(F.ceil(F.lit(q) * F.col("_all")) - 1, F.lit(0))
        return F.floor(F.lit(q) * (F.col("_all") - 1))

    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > index(q), F.col(value))).alias(name) for name, q in quantiles.items()])


def metrics_rollup(requests: DataFrame, *sets: Sequence[str]) -> DataFrame:
    """Counts, flag rates, mean cost and token sums for each grouping set, in one pass (requests one row each).

    Mean cost is over measured costs (not null, not NaN); null tokens add 0. Null or empty grouping values are 'unknown'.
    """
    names = list(dict.fromkeys(n for s in sets for n in s))
    keyed = requests.withColumns({n: or_unknown(F.col(n)) for n in names})
    measured = F.when(~F.isnan("cost_usd"), F.col("cost_usd"))
    grouped = keyed.groupingSets([[F.col(n) for n in s] for s in sets], *[F.col(n) for n in names]) if names else keyed.groupBy()
    return grouped.agg(
        F.count("*").alias("requests"),
        F.round(rate(F.col("grounded_answer")), 6).alias("grounded_rate"),
        F.round(rate(F.col("insufficient_answer")), 6).alias("insufficient_rate"),
        F.round(rate(F.col("false_confident_proxy")), 6).alias("false_confident_rate"),
        F.round(rate(F.col("family_route_present")), 6).alias("route_rate"),
        F.round(F.avg(measured), 6).alias("mean_cost_usd"),
        F.sum(F.coalesce(F.col("input_tokens"), F.lit(0))).cast("bigint").alias("input_tokens"),
        F.sum(F.coalesce(F.col("output_tokens"), F.lit(0))).cast("bigint").alias("output_tokens"),
        F.sum(F.coalesce(F.col("total_tokens"), F.lit(0))).cast("bigint").alias("total_tokens"),
    )


def compared(base: Column, candidate: Column, higher_is_better: bool, epsilon: float = 1e-12) -> Column:
    """delta, delta_pct (null for a base of 0) and direction (better, worse, same, unavailable) of two values."""
    delta = candidate - base
    up, down = ("better", "worse") if higher_is_better else ("worse", "better")
    direction = F.when(delta.isNull(), "unavailable").when(F.abs(delta) <= epsilon, "same").when(delta > 0, up).otherwise(down)
    return F.struct(F.round(delta, 6).alias("delta"), F.round(F.try_divide(delta, F.abs(base)), 6).alias("delta_pct"), direction.alias("direction"))


def parsed(text: Column) -> Column:
    """JSON text as a variant; null if it isn't valid as a whole."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    whole = ((F.left(t, F.lit(1)) == "{") & (F.right(t, F.lit(1)) == "}")) | ((F.left(t, F.lit(1)) == "[") & (F.right(t, F.lit(1)) == "]"))
    return F.when(whole, F.try_parse_json(t))


def run_cases(runs: DataFrame) -> DataFrame:
    """One row per case object of each run file: source_path, run_id, generated_at_utc, run (time, else id, else file), case_pos, case_id, family,
    query, runner_status, error, grounded, latency_ms, cost_usd, checks and judges (name -> passed), citations, selected and messages (numbers
    of members, null where there is no list), warnings, required, depends, passed.

    A lone object in place of the list is one case; members that aren't objects are no cases but keep their position; unreadable files have
    none. A case passed if its runner status is ok and no check failed or errored.
    """
    v = runs.select("source_path", "run_id", "generated_at_utc", parsed(F.col("cases")).alias("v"))
    kind = F.schema_of_variant("v")
    listed = F.when(kind.startswith("ARRAY"), F.col("v").cast("array<variant>")).when(kind.startswith("OBJECT"), F.array("v"))
    each = v.select("source_path", "run_id", "generated_at_utc", F.posexplode(listed).alias("case_pos", "c")).filter(F.schema_of_variant("c").startswith("OBJECT"))

    def got(path: str, as_type: str) -> Column:
        return F.try_variant_get("c", path, as_type)

    def first(name: str, as_type: str) -> Column:
        return F.coalesce(got(f"$.system_result.{name}", as_type), got(f"$.system_output.{name}", as_type))

    file = F.regexp_extract("source_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    run = F.coalesce(F.nullif(F.col("generated_at_utc"), F.lit("")), F.nullif(F.col("run_id"), F.lit("")), file)
    checks = F.coalesce(F.transform_values(got("$.deterministic_eval_results", "map<string,variant>"), lambda _, x: F.try_variant_get(x, "$.passed", "boolean")), F.create_map().cast("map<string,boolean>"))
    rows = each.select(
        "source_path", "run_id", "generated_at_utc", "case_pos",
        got("$.case_id", "string").alias("case_id"),
        or_unknown(got("$.family", "string")).alias("family"),
        got("$.runner_status", "string").alias("runner_status"),
        first("grounded", "boolean").alias("grounded"),
        first("latency_ms", "double").alias("latency_ms"),
        first("cost_usd", "double").alias("cost_usd"),
        checks.alias("checks"),
        run.alias("run"),
        got("$.query", "string").alias("query"),
        got("$.error", "string").alias("error"),
        F.coalesce(F.transform_values(got("$.llm_judge_results", "map<string,variant>"), lambda _, x: F.try_variant_get(x, "$.passed", "boolean")), F.create_map().cast("map<string,boolean>")).alias("judges"),
        F.size(first("citations", "array<variant>")).alias("citations"),
        first("warnings", "array<string>").alias("warnings"),
        F.size(got("$.selected_document_ids", "array<variant>")).alias("selected"),
        got("$.selected_document_required", "boolean").alias("required"),
        got("$.follow_up.depends_on_prior_turn", "boolean").alias("depends"),
        F.size(got("$.follow_up.prior_messages", "array<variant>")).alias("messages"),
    )
    ok = F.coalesce(F.col("runner_status") == "ok", F.lit(False)) & F.forall(F.map_values("checks"), lambda x: F.coalesce(x, F.lit(True)))
    return rows.withColumn("passed", ok)


def pass_rates(cases: DataFrame, *keys: str) -> DataFrame:
    passed = F.sum(F.col("passed").cast("int"))
    return cases.groupBy(*keys).agg(F.count("*").alias("cases"), passed.alias("passed"), (F.count("*") - passed).alias("failed"), F.round(rate(F.col("passed")), 6).alias("pass_rate"))
