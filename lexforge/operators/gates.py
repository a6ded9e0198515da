"""Release gates over two populations of requests, summaries of series, and case filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.analytics import exact_percentiles

#: The rise against the baseline that blocks a release, by measure and phase.
GATES = {
    "p95_latency": {"merge": 0.08, "staging": 0.07, "ramp": 0.10},
    "p99_latency": {"merge": 0.12, "staging": 0.10, "ramp": 0.15},
    "mean_cost": {"merge": 0.15, "staging": 0.12, "ramp": 0.18},
}


def series_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: count, mean and total of the measured values, and their 50th and 95th percentile by the floor rank. Keys without values have
    no row. Values are counted in the map tasks; the percentiles rank distinct values only."""
    measured = df.filter(F.col(value).isNotNull())
    totals = measured.groupBy(*keys).agg(F.count("*").alias("count"), F.round(F.avg(value), 6).alias("mean"), F.sum(value).alias("total"))
    return totals.join(exact_percentiles(measured, keys, value, {"p50": 0.5, "p95": 0.95}, rank="floor"), list(keys))


def gates(measures: DataFrame) -> DataFrame:
    """One row per measure and phase of (measure, baseline, candidate): the relative rise, the threshold, and whether it blocks.

    rise is null for a baseline of 0 or a missing value, and blocks nothing.
    """
    table = F.explode(F.array(*[F.struct(F.lit(m).alias("of"), F.lit(p).alias("phase"), F.lit(x).alias("threshold")) for m, by in GATES.items() for p, x in by.items()]))
    rise = F.try_divide(F.col("candidate") - F.col("baseline"), F.col("baseline"))
    each = measures.withColumn("_g", table).filter(F.col("_g.of") == F.col("measure"))
    d = each.select("measure", "_g.phase", "baseline", "candidate", F.round(rise, 6).alias("rise"), "_g.threshold")
    return d.withColumn("blocked", F.coalesce(F.col("rise") > F.col("threshold"), F.lit(False)))


def top_failing(cases: DataFrame, by: str, order: Sequence[Column], k: int = 10) -> DataFrame:
    """The k groups with the most failed cases, then the highest share, then the first to come up by `order`: a report of fixed size."""
    first = F.min(F.struct(*order)).alias("_first")
    g = cases.groupBy(by).agg(F.count("*").alias("cases"), F.count_if(~F.col("passed")).alias("failed"), first).withColumn("fail_rate", F.round(F.col("failed") / F.col("cases"), 6))
    return g.orderBy(F.desc("failed"), F.desc("fail_rate"), "_first").limit(k).drop("_first")


def filter_cases(cases: DataFrame, families: Sequence[str] = (), limit: int = -1, order: Sequence[str] = ("source_path", "case_pos")) -> DataFrame:
    """The cases of some families (none named: of all), the first `limit` in order (negative: all of them)."""
    kept = cases.filter(F.coalesce(F.nullif(F.col("family"), F.lit("")), F.lit("unknown")).isin(*families)) if families else cases
    return kept if limit < 0 else kept.orderBy(*order).limit(limit)


def carried_over(df: DataFrame, by: str, order: Sequence[str], blocked: Column, windows: int = 2) -> DataFrame:
    """Adds sustained: whether a window and the ones before it, `windows` in a row, are all blocked."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(1 - windows, 0)
    return df.withColumn("sustained", (F.sum(blocked.cast("int")).over(w) == windows))
