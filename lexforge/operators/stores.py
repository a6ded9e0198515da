"""Keyed stores as tables: upsert, overlay, deterministic sampling, sessions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The latest row per key of both tables by `order` (a table with a later load wins ties), all columns of `old`."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_side", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    row = F.max(F.struct(F.col(order).alias("_o"), "_side", *[F.col(c).alias(f"_v_{c}") for c in rest])).alias("_r")
    return both.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_r._v_{c}").alias(c) for c in rest])


def overlay(queue: DataFrame, records: DataFrame, key: str, status: str, default: str, known: Sequence[str]) -> DataFrame:
    """A queue with the recorded status of each item; items without a record, or with a status that isn't known, get the default."""
    got = records.select(key, F.col(status).alias("_status"))
    return queue.join(got, key, "left").withColumn(status, F.when(F.col("_status").isin(*known), F.col("_status")).otherwise(default)).drop("_status")


def drawn(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key and the rule alone, so a sample is the same on every run and any split of the data."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("\x00", F.lit(salt), key.cast("string")), 256), 1, 12), 16, 10).cast("bigint"), F.lit(1_000_000)) / 1_000_000


def previous_value(df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], bucket: Column | None = None) -> DataFrame:
    """Adds prior_<column>: the last value before each row that isn't null or empty, for each column by itself.

    `bucket`, which must rise with `order`, splits a hot key over tasks: the last value of each bucket is a partial aggregate, those are carried
    on over a small window of buckets, and rows are only sorted within their bucket.
    """
    live = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    if bucket is None:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns({f"prior_{c}": F.last(live(c), ignorenulls=True).over(w) for c in columns})
    rows = df.withColumn("_bucket", bucket)
    last = rows.groupBy(*by, "_bucket").agg(*[F.max(F.when(live(c).isNotNull(), F.struct(*order, live(c).alias("_v"))))["_v"].alias(f"_last_{c}") for c in columns])
    over = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_at"), *[F.last(f"_last_{c}", ignorenulls=True).over(over).alias(f"_carried_{c}") for c in columns])
    w = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumns({f"_own_{c}": F.last(live(c), ignorenulls=True).over(w) for c in columns})
    same = F.col("_bucket").eqNullSafe(F.col("_at"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = own.join(carried, same, "left")
    return joined.select(*df.columns, *[F.coalesce(f"_own_{c}", f"_carried_{c}").alias(f"prior_{c}") for c in columns])


def sessions(events: DataFrame, by: str, time: str, gap: str = "30 minutes") -> DataFrame:
    """Events grouped into sessions: a gap of at least `gap` ends one. One row per session."""
    return events.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")
