"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.llm import mixing, neardup, packing, pii, quantiles, residue
from lexforge.llm.sql import SQL
from lexforge.llm.tokens import token_count
from lexforge.operators.dedup import one_per_key
from lexforge.session import cut
from lexforge.sources.tables import table

__all__ = ["QUERIES", "SQL"]

QUANTILES = (0.5, 0.9, 0.95, 0.99, 0.999)


def _free_texts(spark: SparkSession, folder: str) -> DataFrame:
    """table_name, record_key, field_name, text of every text that names people, each record once."""
    parents = one_per_key(table(spark, folder, "parent_chunks"), ["parent_chunk_id"], ["ingested_at"], ["text"])
    items = one_per_key(table(spark, folder, "review_queue"), ["review_item_id"], ["exported_at"], ["query", "final_answer"])
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("query", "final_answer")]))
    of_items = items.select(F.lit("review_queue").alias("table_name"), F.col("review_item_id").alias("record_key"), fields.alias("f")).select("table_name", "record_key", "f.field_name", "f.text")
    return parents.select(F.lit("parent_chunks").alias("table_name"), F.col("parent_chunk_id").alias("record_key"), F.lit("text").alias("field_name"), "text").union(of_items)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_free_texts(spark, folder)).drop("end_pos")


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    return pii.masked("text", _free_texts(spark, folder))


def _measures(spark: SparkSession, folder: str) -> DataFrame:
    """One row per request and measured value: metric, legal_family, day, units (latency in ms, cost in millionths of a dollar)."""
    requests = one_per_key(table(spark, folder, "request_metrics"), ["request_id"], ["received_at"], ["legal_family", "latency_ms", "cost_usd", "recorded_at"])
    family = F.coalesce(F.nullif(F.col("legal_family"), F.lit("")), F.lit("unknown"))
    latency = F.when(F.col("latency_ms") >= 0, F.col("latency_ms").cast("bigint"))
    cost = F.when(~F.isnan("cost_usd") & (F.col("cost_usd") >= 0), F.round(F.col("cost_usd") * 1e6).cast("bigint"))
    each = F.explode(F.array(F.struct(F.lit("latency_ms").alias("metric"), latency.alias("units")), F.struct(F.lit("cost_usd").alias("metric"), cost.alias("units"))))
    return requests.select(family.alias("legal_family"), F.to_date("recorded_at").alias("day"), each.alias("m")).select("m.metric", "legal_family", "day", "m.units").filter("units IS NOT NULL")


_P4_KEYS = ["metric", "legal_family"]


def p4_daily_digests(spark: SparkSession, folder: str) -> DataFrame:
    """One row per metric, family and day: the day's digest, to be kept and put together with others."""
    by = [*_P4_KEYS, "day"]
    return quantiles.packed(quantiles.digest(_measures(spark, folder), by, "units"), by)


def _p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles from the daily digests put together."""
    days = quantiles.unpacked(p4_daily_digests(spark, folder), _P4_KEYS)
    return quantiles.percentiles(quantiles.merge(days, _P4_KEYS), _P4_KEYS, QUANTILES)


def p4_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    value = F.when(F.col("metric") == "cost_usd", F.col("units") / 1e6).otherwise(F.col("units").cast("double"))
    return _p4_found(spark, folder).select(*_P4_KEYS, "quantile", "n", value.alias("value"), "rank_error_bound")


def p4_error_check(spark: SparkSession, folder: str) -> DataFrame:
    """Each percentile of the daily digests against exact ranks: the exact percentile's bucket (its least number of units), and whether the
    wanted rank lies within the stated bound of the ranks of the bucket that was returned."""
    found = _p4_found(spark, folder).withColumn("bucket", quantiles.bucket(F.col("units")))
    # exact ranks of each bucket, from counts per bucket
    buckets = _measures(spark, folder).groupBy(*_P4_KEYS, quantiles.bucket(F.col("units")).alias("bucket")).agg(F.count("*").alias("c"))
    ranks = buckets.withColumn("last", F.sum("c").over(Window.partitionBy(*_P4_KEYS).orderBy("bucket")))
    wanted = F.greatest(F.ceil(F.col("quantile") * F.col("n")), F.lit(1))
    below = (
        found.join(ranks, _P4_KEYS)
        .groupBy(*_P4_KEYS, "quantile", found.n, "rank_error_bound")
        .agg(
            F.max(F.when(ranks.bucket < found.bucket, F.col("last"))).alias("low"),
            F.max(F.when(ranks.bucket <= found.bucket, F.col("last"))).alias("high"),
            F.min(F.when(F.col("last") >= wanted, ranks.bucket)).alias("exact"),
        )
    )
    within = (wanted >= F.coalesce("low", F.lit(0)) + 1 - F.col("rank_error_bound")) & (wanted <= F.coalesce("high", F.lit(0)) + F.col("rank_error_bound"))
    return below.select(*_P4_KEYS, "quantile", "n", quantiles.bucket_low(F.col("exact")).alias("exact_units"), within.alias("within_bound"))


def _chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = [table(spark, folder, t).select(F.lit(t).alias("collection"), F.col(k).alias("id"), "text") for t, k in (("parent_chunks", "parent_chunk_id"), ("child_chunks", "child_chunk_id"))]
    return parts[0].union(parts[1])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.alike_pairs(_chunk_texts(spark, folder), 3, 0.6).withColumnRenamed("collection", "table_name")


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(_chunk_texts(spark, folder), 3, 0.6).withColumnRenamed("collection", "table_name")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    specs = table(spark, folder, "container_specs").select("container_id", "container_name", "capacity_tokens").limit(1001).collect()
    if len(specs) > 1000:
        raise ValueError("container_specs is a parameter table of at most 1000 rows")
    documents = table(spark, folder, "documents")
    sizes = documents.select("doc_id", token_count(F.col("text")).alias("tokens"), (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) / (1 << 30)).alias("salt"))
    sizes = cut(sizes.withColumn("t", F.explode(F.when(F.col("tokens") > 0, F.array("tokens")))).select("doc_id", "tokens", "salt"), "p6-sizes")
    return packing.pack(sizes, [tuple(r) for r in specs], sizes.count())


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(_packed(spark, folder))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    sizes = cut(mixing.sized(table(spark, folder, "documents")), "p7-sizes")
    return mixing.emit(mixing.copies(sizes, mixing.plan(sizes, table(spark, folder, "mix_targets"))))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    sizes = cut(mixing.sized(table(spark, folder, "documents")), "p7-sizes")
    rates = mixing.plan(sizes, table(spark, folder, "mix_targets"))
    return mixing.report(mixing.copies(sizes, rates), rates)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.flagged(table(spark, folder, "documents")).select("doc_id")


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return residue.without_residue(table(spark, folder, "documents"))


def p8_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return residue.reasons(table(spark, folder, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_masked": p2_masked,
    "p4_percentiles": p4_percentiles,
    "p4_daily_digests": p4_daily_digests,
    "p4_error_check": p4_error_check,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_containers": p6_containers,
    "p6_report": p6_report,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p8_found": p8_found,
    "p8_clean": p8_clean,
    "p8_reasons": p8_reasons,
}
