"""Evidence from chunks: units, importance of paragraphs, compression to a size, spans of traces, events after an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import paragraphs, whitespace_tokens

# What makes a paragraph important, and the qualifiers that must not be lost.
KEYWORDS = (
    "shall", "must", "may not", "except", "unless", "subject to", "provided that", "termination", "liability", "confidential", "confidentiality", "governing law", "jurisdiction", "indemn", "remedy", "damages", "breach", "means",
    "defined as", "definition",
)
QUALIFIERS = (
    r"(?i)\b(unless|except|subject to|provided that|notwithstanding|only if|conditioned upon)\b",
    r"(?i)\b(shall not|may not|is not liable|limitation of liability)\b",
)
DATED = r"\b\d{1,2}\b|\b(january|february|march|april|may|june|july|august|september|october|november|december)\b"
SHORT_WORDS, SMALL_CHARS, MEDIUM_CHARS, MEDIUM_RATIO, LARGE_RATIO = 35, 900, 2200, 0.75, 0.6


def evidence_units(parents: DataFrame) -> DataFrame:
    """One row per paragraph: evidence_unit_id (`parent:position`, from 0), parent_chunk_id, position, evidence_text, heading."""
    units = parents.select("parent_chunk_id", "heading_text", F.posexplode(paragraphs(F.col("text"))).alias("position", "evidence_text"))
    return units.select(F.concat_ws(":", "parent_chunk_id", F.col("position").cast("string")).alias("evidence_unit_id"), "parent_chunk_id", "position", "evidence_text", F.coalesce(F.nullif(F.trim("heading_text"), F.lit("")), F.lit("Untitled")).alias("heading"))


def importance(text: Column) -> Column:
    """words / 80 up to 1, 0.35 for each keyword, 0.4 for a definition, 0.2 for a day or month, 0.5 for a short paragraph with a qualifier."""
    low = F.lower(text)
    words = F.size(whitespace_tokens(text))
    score = F.least(words / 80.0, F.lit(1.0))
    for word in KEYWORDS:
        score = score + F.when(F.contains(low, F.lit(word)), 0.35).otherwise(0.0)
    score = score + F.when(F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(" means ")) | F.contains(low, F.lit("defined as")), 0.4).otherwise(0.0)
    score = score + F.when(low.rlike(DATED), 0.2).otherwise(0.0)
    return F.round(score + F.when((words <= SHORT_WORDS) & qualified(text), 0.5).otherwise(0.0), 6)


def qualified(text: Column) -> Column:
    return text.rlike(QUALIFIERS[0]) | text.rlike(QUALIFIERS[1])


def compress(parents: DataFrame) -> DataFrame:
    """One row per paragraph of (parent_chunk_id, text): position, evidence_text, score, kept, and the parent's original and compressed length.

    A text of up to SMALL_CHARS characters or of one paragraph is kept whole. Of a longer one the first paragraph and every qualified one are
    kept, then the most important ones until the kept text, joined by blank lines, has its share of the original length (MEDIUM_RATIO, or
    LARGE_RATIO above MEDIUM_CHARS characters; SMALL_CHARS at least); the one that reaches it is kept too. The greedy stop is a running sum over
    the ranking, ties go by position. A result no shorter than the original is the original. Null and blank texts have no paragraph.
    """
    p = parents.withColumn("original_chars", F.length("text")).select("parent_chunk_id", "original_chars", F.posexplode(paragraphs(F.col("text"))).alias("position", "evidence_text"))
    scored = p.withColumns({"score": importance(F.col("evidence_text")), "must": (F.col("position") == 0) | qualified(F.col("evidence_text")), "size": F.length("evidence_text") + 2})
    of = Window.partitionBy("parent_chunk_id")
    rank = of.orderBy(F.desc("score"), "position")
    extra = F.when(F.col("must"), 0).otherwise(F.col("size"))
    sized = scored.withColumns(
        {
            "held": F.sum(F.when(F.col("must"), F.col("size")).otherwise(0)).over(of),
            "before": F.coalesce(F.sum(extra).over(rank.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "place": F.row_number().over(rank),
            "of": F.count("*").over(of),
        }
    )
    ratio = F.when(F.col("original_chars") > MEDIUM_CHARS, LARGE_RATIO).otherwise(MEDIUM_RATIO)
    target = F.greatest(F.floor(F.col("original_chars") * ratio), F.lit(SMALL_CHARS))
    whole = (F.col("original_chars") <= SMALL_CHARS) | (F.col("of") == 1)
    chosen = sized.withColumn("kept", whole | F.col("must") | (F.col("place") == 1) | (F.col("held") + F.col("before") - 2 < target))
    joined = F.sum(F.when(F.col("kept"), F.col("size")).otherwise(0)).over(of) - 2
    chosen = chosen.withColumn("compressed_chars", F.when(whole | (joined >= F.col("original_chars")), F.col("original_chars")).otherwise(joined))
    return chosen.select("parent_chunk_id", "position", "evidence_text", "score", "kept", "original_chars", "compressed_chars")


def trace_status(spans: DataFrame, *keys: str) -> DataFrame:
    """Overall status per trace: failed if a span failed, else partial if one was partial or skipped, else success."""
    status = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_or(F.col("status").isin("partial", "skipped")), "partial").otherwise("success")
    return spans.groupBy(*keys).agg(F.count("*").alias("spans"), status.alias("overall_status"))


def after_anchor(events: DataFrame, by: str, time: str, anchor: Column) -> DataFrame:
    """Events strictly after the first anchor event of their group; groups without an anchor have none. One window, no self-join."""
    first = F.min(F.when(anchor, F.col(time))).over(Window.partitionBy(by))
    return events.withColumn("anchor_at", first).filter(F.col(time) > F.col("anchor_at"))


def existing(items: DataFrame, cases: DataFrame) -> DataFrame:
    """Items (item_id, case_id, query, family) that a case repeats: by id, or by query and family. Two equi-joins in place of an OR."""
    by_id = items.join(cases.select("case_id").distinct(), "case_id", "left_semi").select("item_id", F.lit("id").alias("matched_by"))
    by_text = items.join(cases.select("query", "family").distinct(), ["query", "family"], "left_semi").select("item_id", F.lit("query").alias("matched_by"))
    return by_id.union(by_text).groupBy("item_id").agg(F.min("matched_by").alias("matched_by"))
