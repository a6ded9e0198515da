"""Mixing sources to target weights.

Tokens are summed per source in the map tasks; the plan (one row per source) is small by construction, since it has the target table's rows;
each document then decides its copies by itself from its hash, so nothing is collected and no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.tokens import DEFAULT_VOCABULARY, token_count


def source_key(source: Column) -> Column:
    """The source as it is compared: trimmed (of any white space), lower case."""
    return F.lower(F.regexp_replace(source, r"^[\s\u00A0]+|[\s\u00A0]+$", ""))


def sized(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, source_name, tokens of each document with at least one token."""
    return documents.select("doc_id", source_key(F.col("source")).alias("source_name"), token_count(F.col("text"), vocabulary).alias("tokens")).filter("tokens > 0")


#: Most rows of a table of targets: it is a parameter table, which every task holds.
MOST_TARGETS = 1000


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: available tokens and documents, wanted tokens, rate (uses per document) and whether the target is out of reach.

    The mix aims at `total_tokens`, by default all tokens of the targeted sources. rate = wanted / available, at most max_repeats; a source
    that would need more is used max_repeats times and falls short (`reached` = false), as does one without documents (rate 0).
    """
    if targets.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"targets is a parameter table of at most {MOST_TARGETS} rows")
    have = sizes.groupBy("source_name").agg(F.sum("tokens").alias("available_tokens"), F.count("*").alias("documents"))
    wanted = targets.select(source_key(F.col("source_name")).alias("source_name"), "target_share", "max_repeats")
    rows = wanted.join(F.broadcast(have.join(F.broadcast(wanted.select("source_name")), "source_name", "left_semi")), "source_name", "left")
    rows = rows.fillna(0, ["available_tokens", "documents"])
    total = F.lit(total_tokens) if total_tokens is not None else F.col("all_tokens")
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("available_tokens").alias("all_tokens"))))  # one row
    need = F.col("target_share") * total
    rate = F.when(F.col("available_tokens") > 0, F.least(need / F.col("available_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return rows.select("source_name", "target_share", "max_repeats", "available_tokens", "documents", need.alias("wanted_tokens"), rate.alias("rate"), (rate * F.col("available_tokens") >= need * (1 - 1e-9)).alias("reached"))


def copies(sizes: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source_name, tokens, copies of each selected document: floor(rate), and one more with the fraction's probability by its hash.

    The same document, seed and rate always give the same number, and it never exceeds max_repeats.
    """
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / (1 << 30)
    whole = F.floor("rate")
    n = (whole + (drawn < F.col("rate") - whole).cast("int")).cast("int")
    joined = sizes.join(F.broadcast(rates.select("source_name", "rate", "max_repeats")), "source_name")
    return joined.select("doc_id", "source_name", "tokens", F.least(n, "max_repeats").alias("copies")).filter("copies > 0")


def emit(selected: DataFrame) -> DataFrame:
    """One row per copy, numbered from 1."""
    return selected.select("doc_id", "source_name", "tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))


def report(selected: DataFrame, rates: DataFrame) -> DataFrame:
    """Per target: the plan, and the documents, tokens and share actually reached."""
    got = selected.groupBy("source_name").agg(F.count("*").alias("used_documents"), F.sum(F.col("tokens").cast("bigint") * F.col("copies")).alias("used_tokens"), F.max("copies").alias("most_copies"))
    rows = rates.join(F.broadcast(got), "source_name", "left").fillna(0, ["used_documents", "used_tokens", "most_copies"])
    rows = rows.crossJoin(F.broadcast(rows.agg(F.sum("used_tokens").alias("mix_tokens"))))  # one row
    return rows.withColumn("actual_share", F.coalesce(F.try_divide("used_tokens", "mix_tokens"), F.lit(0.0)))
