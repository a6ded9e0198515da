"""Graders of retrieval and citations, as array and join expressions with three-valued results: null means not applicable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_at_k(hits: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per query with gold: hit_at_<k> (any gold id within rank k) and best_rank (null if none is found). Semi-join, no pairs collected."""
    found = hits.join(gold.select("query_id", "id").distinct(), ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("best_rank"))
    queries = gold.select("query_id").distinct().join(found, "query_id", "left")
    return queries.select("query_id", "best_rank", *[F.coalesce(F.col("best_rank") <= k, F.lit(False)).cast("int").alias(f"hit_at_{k}") for k in ks])


def retrieval_rollup(graded: DataFrame, by: str, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Per group of graded queries (`hit_at_k` with `by`, and optionally parent_recall and wrong_share): cases, pass rate (any gold id was
    found), mean recall at each k (any match counts 1), mean, exact median and count of the best ranks, and the means of the optional columns.
    Nulls are in no mean; a group without ranks has null mean and median.
    """
    optional = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("parent_recall", "wrong_share") if c in graded.columns]
    return graded.groupBy(by).agg(
        F.count("*").alias("cases"),
        F.round(F.avg(F.col("best_rank").isNotNull().cast("int")), 6).alias("pass_rate"),
        *[F.round(F.avg(f"hit_at_{k}"), 6).alias(f"recall_at_{k}") for k in ks],
        F.round(F.avg("best_rank"), 6).alias("mean_rank"),
        F.percentile("best_rank", F.lit(0.5)).alias("median_rank"),
        F.count("best_rank").alias("ranked"),
        *optional,
    )


def cited(citations: Column, field: str) -> Column:
    """The distinct non-empty values of a member of the citations."""
    return F.array_distinct(F.filter(F.transform(F.filter(citations, lambda c: c.isNotNull()), lambda c: c[field]), lambda x: x.isNotNull() & (x != "")))


def citation_checks(items: DataFrame) -> DataFrame:
    """Per item (id, answer, citations, scope): presence, scope and support of its citations.

    presence: an answer has a citation (null without an answer). in_scope: every cited document is one of the scope's (null without
    citations or scope). outside: cited documents out of scope. excerpt_rate: share of citations with an excerpt (null without citations).
    """
    live = F.filter(F.coalesce("citations", F.array().cast(items.schema["citations"].dataType)), lambda c: c.isNotNull())
    docs = cited(F.col("citations"), "document_id")
    scope = F.filter(F.coalesce("scope", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    d = items.withColumns({"_live": live, "_docs": F.coalesce(docs, F.array().cast("array<string>")), "_scope": scope})
    outside = F.array_except("_docs", "_scope")
    return d.select(
        "id",
        F.size("_live").alias("citations"),
        F.when(F.length("answer") > 0, F.size("_live") > 0).alias("presence"),
        F.when((F.size("_docs") > 0) & (F.size("_scope") > 0), F.size(outside) == 0).alias("in_scope"),
        F.when((F.size("_docs") > 0) & (F.size("_scope") > 0), F.size(outside)).alias("outside"),
        F.round(F.try_divide(F.size(F.filter("_live", lambda c: F.length(c["supporting_excerpt"]) > 0)), F.nullif(F.size("_live"), F.lit(0))), 6).alias("excerpt_rate"),
    )
