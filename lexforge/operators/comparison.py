"""Comparing evaluation runs: case by case, by family, and as one verdict; queues of failed and reviewable cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trend(delta: Column, higher_is_better: bool) -> Column:
    """improved, regressed, unchanged, or unavailable for a null delta."""
    up, down = ("improved", "regressed") if higher_is_better else ("regressed", "improved")
    return F.when(delta.isNull(), "unavailable").when(F.abs(delta) < 1e-12, "unchanged").when(delta > 0, up).otherwise(down)


def previous_runs(runs: DataFrame, by: str, order: list[str]) -> DataFrame:
    """(candidate, baseline) source paths: each run with the one before it of the same `by`; first runs have no row.

    `runs` has one row per run and only its keys: what is sorted per group is a few strings a run.
    """
    before = F.lag("source_path").over(Window.partitionBy(by).orderBy(*order))
    return runs.select(F.col("source_path").alias("candidate"), before.alias("baseline")).filter("baseline IS NOT NULL")


def last_of_case(cases: DataFrame) -> DataFrame:
    """One row per run and case id: the last of repeated ids. Cases without an id are left out."""
    rest = [c for c in cases.columns if c not in ("source_path", "case_id", "case_pos")]
    row = F.max_by(F.struct(*rest), "case_pos").alias("_r")
    return cases.filter(F.col("case_id").isNotNull()).groupBy("source_path", "case_id").agg(row, F.max("case_pos").alias("case_pos")).select("source_path", "case_id", "case_pos", "_r.*")


def case_changes(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per case that both runs of a pair have: candidate, baseline, case_id, case_pos (in the candidate), family, change."""
    own = last_of_case(cases.select("source_path", "case_id", "case_pos", "family", "passed"))
    new = own.select(F.col("source_path").alias("candidate"), "case_id", "case_pos", "family", F.col("passed").alias("now"))
    old = own.select(F.col("source_path").alias("baseline"), "case_id", F.col("passed").alias("before"))
    both = pairs.join(new, "candidate").join(old, ["baseline", "case_id"])
    change = F.when(F.col("now") == F.col("before"), "unchanged").when(F.col("now"), "improved").otherwise("regressed")
    return both.select("candidate", "baseline", "case_id", "case_pos", "family", change.alias("change"))


def family_changes(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair and family that either run has: rates and counts, delta and status, in two variants.

    delta is null and status `unavailable` where a side lacks the family; delta_or_zero counts a missing side as rate 0.
    """
    rates = cases.groupBy("source_path", "family").agg(F.count("*").alias("n"), F.avg(F.col("passed").cast("int")).alias("rate"))
    sides = pairs.select("candidate", "baseline", F.explode(F.array(F.struct(F.col("candidate").alias("source_path"), F.lit(True).alias("new")), F.struct(F.col("baseline").alias("source_path"), F.lit(False).alias("new")))).alias("s"))
    joined = sides.select("candidate", "baseline", "s.*").join(rates, "source_path")
    pick = lambda c, new: F.max(F.when(F.col("new") == new, F.col(c)))
    both = joined.groupBy("candidate", "baseline", "family").agg(pick("rate", False).alias("before"), pick("rate", True).alias("now"), F.coalesce(pick("n", False), F.lit(0)).alias("before_cases"), F.coalesce(pick("n", True), F.lit(0)).alias("now_cases"))
    delta = F.round(F.col("now") - F.col("before"), 9)
    zero = F.round(F.coalesce("now", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)), 9)
    return both.withColumns({"delta": delta, "status": trend(delta, True), "delta_or_zero": zero})


def verdicts(cases: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per pair: the trend of the pass rate, regressed families, risk and performance measures, and the verdict.

    Risk: the share of failed citation checks and of answers that are grounded although the answerability check failed. Performance: mean
    latency and cost. Any regressed rate, family or risk calls for a review; an improved rate without slower or dearer answers is better.
    """
    check = lambda name: F.try_element_at("checks", F.lit(name))
    measures = cases.groupBy("source_path").agg(
        F.avg(F.col("passed").cast("int")).alias("rate"),
        F.avg(check("citation_checks").cast("int")).alias("citations"),
        F.avg(F.when(check("answerability_checks").isNotNull(), (~check("answerability_checks") & F.coalesce("grounded", F.lit(False))).cast("int"))).alias("false_confident"),
        F.avg("latency_ms").alias("latency"),
        F.avg("cost_usd").alias("cost"),
    )
    names = ("rate", "citations", "false_confident", "latency", "cost")
    new = measures.select(F.col("source_path").alias("candidate"), *[F.col(c).alias(f"new_{c}") for c in names])
    old = measures.select(F.col("source_path").alias("baseline"), *[F.col(c).alias(f"old_{c}") for c in names])
    worse = family_changes(cases, pairs).groupBy("candidate").agg(F.count_if(F.col("status") == "regressed").alias("family_regressions"))
    d = pairs.join(new, "candidate").join(old, "baseline").join(worse, "candidate", "left").fillna(0, ["family_regressions"])
    t = {c: trend(F.round(F.col(f"new_{c}") - F.col(f"old_{c}"), 9), c in ("rate", "citations")) for c in names}
    d = d.withColumns({f"{c}_trend": x for c, x in t.items()})
    bad = lambda *cs: sum(((F.col(f"{c}_trend") == "regressed").cast("int") for c in cs), F.lit(0))
    d = d.withColumns({"risk_regressions": bad("citations", "false_confident"), "slower_or_dearer": bad("latency", "cost")})
    verdict = (
        F.when((F.col("rate_trend") == "regressed") | (F.col("risk_regressions") > 0) | (F.col("family_regressions") > 0), "review")
        .when((F.col("rate_trend") == "improved") & (F.col("slower_or_dearer") == 0), "better")
        .otherwise("mixed")
    )
    return d.select("candidate", "baseline", "rate_trend", "family_regressions", "risk_regressions", "slower_or_dearer", verdict.alias("verdict"))


def triage(cases: DataFrame, known: DataFrame) -> DataFrame:
    """Failed cases as a queue: issue_id (`run:case`), family, summary, status of `known` (issue_id, status) or untriaged, and place.

    The summary is the runner's error, or the failed checks in the order of their names. Untriaged issues come first, then by run and case;
    place is a rank within its status, so that no window holds the whole queue's rows of both.
    """
    failing = F.array_sort(F.map_keys(F.map_filter("checks", lambda _, v: ~v)))
    ok = F.coalesce(F.col("runner_status") == "ok", F.lit(False))
    summary = F.when(~ok, F.coalesce(F.nullif(F.col("error"), F.lit("")), F.lit("runner failed"))).otherwise(F.array_join(failing, ", "))
    case = F.coalesce(F.nullif(F.col("case_id"), F.lit("")), F.lit("unknown_case"))
    failed = cases.filter(~F.col("passed")).select(F.concat_ws(":", "run", case).alias("issue_id"), "source_path", "case_pos", "run", case.alias("case_id"), "family", summary.alias("summary"))
    return failed.join(known, "issue_id", "left").withColumn("status", F.coalesce("status", F.lit("untriaged")))


def review_categories(cases: DataFrame) -> DataFrame:
    """One row per case and category of review: checks that failed, no citation, hallucination warnings, any failure of the given family.

    `cases` has run, case_id, family, checks, judges (name -> passed), citations (number, or null where there is no list), warnings, passed.
    """
    check = lambda m, name: F.coalesce(~F.try_element_at(m, F.lit(name)), F.lit(False))
    warned = F.exists(F.coalesce("warnings", F.array().cast("array<string>")), lambda w: F.contains(F.lower(w), F.lit("hallucin")))
    categories = F.array_compact(
        F.array(
            F.when(check("checks", "citation_checks") | F.coalesce(F.col("citations") == 0, F.lit(False)), "missing_citation"),
            F.when(check("checks", "family_routing"), "family_routing_disagreement"),
            F.when(check("judges", "groundedness") | F.coalesce(warned, F.lit(False)), "suspected_hallucination"),
            F.when((F.col("family") == "policy_issue_spotting") & ~F.col("passed"), "legal_issue_spotting_disagreement"),
        )
    )
    case = F.coalesce(F.nullif(F.col("case_id"), F.lit("")), F.lit("unknown_case"))
    each = cases.select("source_path", "case_pos", "family", F.concat_ws(":", "run", case).alias("source_id"), F.explode(categories).alias("category"))
    return each.withColumn("review_item_id", F.concat_ws(":", F.lit("review"), "category", "source_id"))


def answerability(cases: DataFrame, by: str) -> DataFrame:
    """The 2 x 2 table of expected and observed answerability per group: counts and shares of the graded cases.

    Observed: grounded or not. A check passes exactly where the observation is the expected one.
    """
    right, seen = F.try_element_at("checks", F.lit("answerability_checks")), F.coalesce("grounded", F.lit(False))
    kinds = {"correct_supported": right & seen, "correct_insufficient": right & ~seen, "false_positive": ~right & seen, "false_negative": ~right & ~seen}
    graded = cases.filter(right.isNotNull())
    counts = [F.count_if(x).alias(f"{k}_count") for k, x in kinds.items()]
    rates = [F.round(F.avg(x.cast("int")), 6).alias(f"{k}_rate") for k, x in kinds.items()]
    return graded.groupBy(by).agg(F.count("*").alias("cases"), *counts, *rates)


def violations(cases: DataFrame) -> DataFrame:
    """The rules each eval case breaks, as an array of names. `cases` has case_id, query, family, selected, required, messages (numbers of
    members, null where there is no list), depends (whether it depends on a prior turn), status."""
    named = {
        "id": ~F.coalesce(F.col("case_id").rlike(r"^[a-z0-9][a-z0-9._-]*$"), F.lit(False)),
        "query": ~F.coalesce(F.col("query").rlike(r"\S"), F.lit(False)),
        "selected_document_ids": F.col("selected").isNull(),
        "selected_document_required": F.coalesce(F.col("required"), F.lit(False)) & (F.coalesce("selected", F.lit(0)) == 0),
        "follow_up": F.coalesce(F.col("depends"), F.lit(False)) & (F.coalesce("messages", F.lit(0)) == 0),
    }
    return cases.withColumn("violations", F.array_compact(F.array(*[F.when(x, n) for n, x in named.items()])))
