"""Ranking and merging of hits, sentences and dates, and filters with a defined result for unknown keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as t

#: Words that mark a qualifier in a sentence.
QUALIFIER_TERMS = ("unless", "except", "subject to", "provided that", "notwithstanding", "only if")


def merge_hits(hits: DataFrame) -> DataFrame:
    """Root and subquery hit lists as one: query_id, id, the first list's scores, provenance and number of hits.

    `hits` has query_id, subquery_id (null for the root list), rank, id, dense_score, sparse_score. Lists count in order: the root's first, then
    by subquery id; the first non-null of each score is kept, an id's subqueries are listed once each in that order. `place` is the order in
    which ids first come up. All state is per (query, id): one aggregate, no list of a whole query in one row.
    """
    seq = F.struct(F.col("subquery_id").isNotNull().alias("s"), F.coalesce("subquery_id", F.lit("")).alias("q"), F.col("rank").alias("r"))
    h = hits.withColumn("_s", seq)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("_s", c)))[c].alias(c)
    merged = h.groupBy("query_id", "id").agg(
        F.min("_s").alias("_first"),
        first("dense_score"),
        first("sparse_score"),
        F.bool_or(F.col("subquery_id").isNull()).alias("from_root"),
        F.array_sort(F.collect_set("subquery_id")).alias("subquery_ids"),
        F.count("*").alias("hits"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("_first"))
    return merged.withColumn("place", place).drop("_first")


def known_filters(filters: dict[str, object], columns: list[str]) -> tuple[dict[str, object], list[str]]:
    """The filters whose key is a column, and the names of the others: those have no effect, and callers warn of them."""
    return {k: v for k, v in filters.items() if k in columns}, sorted(k for k in filters if k not in columns)


def in_scope(rows: DataFrame, scope: DataFrame, pushdown: bool) -> DataFrame:
    """Hits whose document is in their query's scope (query_id, document_id); queries without a scope keep all their hits.

    With `pushdown` `rows` are candidates and the filter comes before the ranking; else they are ranked hits and a query may keep fewer than k.
    Both are one semi-join and one anti-join on keys; only the place in the plan differs.
    """
    inside = rows.join(scope.select("query_id", "document_id").distinct(), ["query_id", "document_id"], "left_semi")
    free = rows.join(scope.select("query_id").distinct(), "query_id", "left_anti")
    return inside.unionByName(free) if pushdown else inside.unionByName(free).select(rows.columns)


def overlap(text: Column, terms: Column) -> Column:
    """How many of the terms are in the lower-case text, as substrings."""
    low = F.lower(text)
    return F.size(F.filter(terms, lambda w: F.contains(low, w)))


def qualifies(text: Column) -> Column:
    hit = F.lit(False)
    for w in QUALIFIER_TERMS:
        hit = hit | F.contains(F.lower(text), F.lit(w))
    return hit


def best_excerpt(text: Column, query: Column) -> Column:
    """The sentence with the most query terms (then one with a qualifier, the shorter, the first), and the first qualified sentence after it
    unless it is in it already. Null for a text without sentences."""
    terms, sentences = t.query_terms(query), t.sentences(text)
    scored = F.transform(sentences, lambda s, i: F.struct((-overlap(s, terms)).alias("a"), (~qualifies(s)).cast("int").alias("b"), F.length(s).alias("c"), i.alias("i"), s.alias("s")))
    best = F.array_min(scored)["s"]
    qualified = F.get(F.filter(sentences, qualifies), F.lit(0))
    return F.when(qualified.isNotNull() & ~F.contains(best, qualified), F.concat_ws(" ", best, qualified)).otherwise(best)


def relevant(passages: DataFrame, k: int = 4) -> DataFrame:
    """The k passages of each query (query_id, query, id, text, place) that hold most of its terms; passages without any are left out."""
    scored = passages.withColumn("overlap", overlap(F.col("text"), t.query_terms(F.col("query")))).filter("overlap > 0")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "place", "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def chronology(texts: DataFrame, before: int = 80, after: int = 120) -> DataFrame:
    """One row per dated mention of (id, text): event_date, date_text, position in the text, and an excerpt around it in single blanks.

    ISO dates and `March 5, 2024` in long or short form count; what looks like a date and isn't one is left out. Order is by date, id, position.
    """
    found = F.regexp_extract_all("text", F.lit(rf"(?i)\b({t.EVENT_DATE})\b"), F.lit(1))
    cut = texts.select("id", "text", F.split("text", rf"(?i)\b(?:{t.EVENT_DATE})\b", -1).alias("_between"), found.alias("_found"))
    each = cut.select("id", "text", "_between", "_found", F.posexplode("_found").alias("n", "date_text"))
    upto = F.aggregate(F.slice("_between", F.lit(1), F.col("n") + 1), F.lit(0), lambda a, s: a + F.length(s)) + F.aggregate(F.slice("_found", F.lit(1), F.col("n")), F.lit(0), lambda a, s: a + F.length(s))
    placed = each.withColumn("position", upto).withColumn("event_date", t.event_date(F.col("date_text"))).filter(F.col("event_date").isNotNull())
    start = F.greatest(F.col("position") - before, F.lit(0))
    end = F.col("position") + F.length("date_text") + after
    excerpt = F.trim(F.regexp_replace(F.substring(F.col("text"), start + 1, end - start), r"\s+", " "))
    return placed.select("id", "event_date", "date_text", "position", excerpt.alias("excerpt"))


def tail(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The last n rows of each group, in order: `from_end` counts from 1 at the last."""
    return df.withColumn("from_end", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("from_end") <= n)
