"""Shadow grading of live traffic, and state kept per conversation, as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexforge.operators.grading import citation_checks


def shadow_grades(items: DataFrame, time: str = "exported_at", lateness: str = "60 days") -> DataFrame:
    """Citation checks of a stream of review items, a row each. Repeats of an id within `lateness` of event time are dropped, and the state of
    an id ends with it; a repeat after that is graded again, with the same result."""
    once = items.withWatermark(time, lateness).dropDuplicatesWithinWatermark(["review_item_id"])
    return citation_checks(once.select(F.col("review_item_id").alias("id"), F.col("final_answer").alias("answer"), "citations", F.col("selected_document_ids").alias("scope")))


LAST_SCHEMA = "key string, turns bigint, last_value string"


def last_values(turns: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Per key of a stream: turns so far and the last value that isn't null or empty, kept as state of one row a key.

    Rows of a batch are taken in order of `time`; a later batch's value replaces an earlier one. Emits the state of each key that a batch
    touches (update mode).
    """

    def advance(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last, at = state.get if state.exists else (0, None, None)
        for pdf in batches:
            count += len(pdf)
            live = pdf[pdf["v"].notna() & (pdf["v"] != "")].sort_values(["t", "v"])
            if len(live) and (at is None or live["t"].iloc[-1] >= at):
                at, last = int(live["t"].iloc[-1]), live["v"].iloc[-1]
        state.update((count, last, at))
        yield pd.DataFrame({"key": [k[0]], "turns": [count], "last_value": [last]})

    rows = turns.select(F.col(key).cast("string").alias("key"), F.unix_micros(time).alias("t"), F.col(value).cast("string").alias("v")).filter("key IS NOT NULL")
    return rows.groupBy("key").applyInPandasWithState(advance, LAST_SCHEMA, "count bigint, last string, at bigint", "update", GroupStateTimeout.NoTimeout)
