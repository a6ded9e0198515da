"""Keeping one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], latest: bool = False) -> DataFrame:
    """One row per key: the first (or latest) by `order`, with `columns`.

    An aggregate, not a window: partial aggregation collapses a hot key inside each map task, so a key that holds a third of all rows
    sends one row per task over the shuffle. Null keys form one group of their own per key tuple; nulls in `order` come first. Rows that tie
    on `order` are settled by the content of `columns`, so the result is deterministic. An empty table gives an empty result.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in columns if c not in keys]
    pick = F.max if latest else F.min
    row = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_v_{c}") for c in rest])
    return df.groupBy(*keys).agg(pick(row).alias("_row")).select(*keys, *[F.col(f"_row._v_{c}").alias(c) for c in rest])
