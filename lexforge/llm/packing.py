"""Filling fixed-capacity containers, by Karmarkar-Karp multiway differencing within shards.

Texts are cut only where they exceed the capacity; each full piece fills a container of its own, and the rest of such a text is an item like
any other. Items are spread by hash over shards of a bounded number of items (hot sources or matters play no part). Within a shard the
items are divided into as many windows as their sum needs: the partial partitions with the largest imbalances are merged, large sums against
small ones, until one partition is left. Windows above the capacity are divided again with one window more, so the window count rises
exactly where the capacity is exceeded.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a shard, at most about twice this many.
SHARD_ITEMS = 3000


def difference(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Item indexes of each of `windows` windows with near-equal sums, by Karmarkar-Karp multiway differencing. Empty windows are left out.

    The two partial partitions with the largest imbalances (largest sum less smallest) are merged, the largest sums of one with the smallest of
    the other, until one is left. A partition is the ascending list of its windows that hold items, as (sum, window); all others are empty. A
    merged window is a node over two others, and members are read at the end, so that adding a single item to a partition is one insertion.
    """
    if windows <= 1:
        return [list(range(len(sizes)))]
    n = len(sizes)
    over: list[tuple[int, int]] = []  # the two windows below each merged one, numbered from n
    heap: list[tuple] = [(-s, i, [(s, i)]) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) < len(b):
            a, b = b, a
        met = max(len(a) + len(b) - windows, 0)  # so many windows hold items in both
        if len(b) == 1 and not met:
            bisect.insort(a, b[0])
        elif len(b) == 1:
            (s, x), (t, y) = a.pop(0), b[0]
            over.append((x, y))
            bisect.insort(a, (s + t, n + len(over) - 1))
        else:
            joined = []
            for (s, x), (t, y) in zip(reversed(a[:met]), b):
                over.append((x, y))
                joined.append((s + t, n + len(over) - 1))
            a = sorted(joined + a[met:] + b[met:])
        heapq.heappush(heap, (-(a[-1][0] - (a[0][0] if len(a) == windows else 0)), tie, a))
        tie += 1
    found = []
    for _, top in heap[0][2]:
        members, stack = [], [top]
        while stack:
            x = stack.pop()
            if x < n:
                members.append(x)
            else:
                stack.extend(over[x - n])
        found.append(members)
    return found


def fill(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Windows (item indexes) none of which exceeds the capacity; every item is at most the capacity.

    Starts from the fewest windows the sum allows. Windows that fit are kept when they are full enough; the items of those that don't fit,
    and of the emptiest, are divided again with one window more than their sum needs, and so on.
    """
    done: list[list[int]] = []
    todo = np.arange(len(sizes))
    extra = 0
    while len(todo):
        total = int(sizes[todo].sum())
        # two items above half a window never share one
        least = max(math.ceil(total / capacity), int((sizes[todo] * 2 > capacity).sum()), 1)
        windows = difference(sizes[todo], min(least + extra, len(todo)))
        loads = [int(sizes[todo[w]].sum()) for w in windows]
        over = [k for k, load in enumerate(loads) if load > capacity]
        if not over:
            done += [todo[w].tolist() for w in windows if w]
            break
        fine = [k for k, load in enumerate(loads) if load <= capacity]
        # keep the fullest of those that fit, as long as the items left need fewer windows than are taken away
        keep = [k for k in fine if loads[k] >= capacity * (0.97 - 0.03 * extra)]
        done += [todo[windows[k]].tolist() for k in keep if windows[k]]
        left = [i for k in range(len(windows)) if k not in set(keep) for i in windows[k]]
        extra = extra + 1 if len(left) == len(todo) or extra else 1
        todo = todo[np.sort(np.array(left, dtype=np.int64))]
    return done


def pieces(sizes: DataFrame, capacities: list[tuple[int, str, int]]) -> DataFrame:
    """One row per piece and capacity: container_id, container_name, capacity, doc_id, piece, start_token, tokens, salt, whole.

    A text up to the capacity is one piece. A longer one has full pieces (whole = true: each fills a container) and the rest.
    """
    each = F.explode(F.array(*[F.struct(F.lit(int(i)).alias("container_id"), F.lit(n).alias("container_name"), F.lit(int(c)).alias("capacity")) for i, n, c in capacities]))
    d = sizes.withColumn("c", each).select("doc_id", F.col("tokens").alias("all"), "salt", "c.*")
    d = d.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("all") / F.col("capacity")).cast("int") - 1)))
    start = F.col("piece") * F.col("capacity")
    d = d.withColumns({"start_token": start, "tokens": F.least(F.col("capacity"), F.col("all") - start)})
    return d.select("container_id", "container_name", "capacity", "doc_id", "piece", "start_token", "tokens", "salt", (F.col("tokens") == F.col("capacity")).alias("whole"))


PACKED_SCHEMA = "container_id int, container_name string, capacity int, container string, position int, doc_id bigint, piece int, start_token int, tokens int"


def pack(sizes: DataFrame, capacities: list[tuple[int, str, int]], rows: int) -> DataFrame:
    """PACKED_SCHEMA: the container and position of each text or piece, for each capacity.

    `sizes` has doc_id, tokens (at least 1) and salt, a number in [0, 1) that its doc_id (a unique key) decides; `rows` is its row count. Shards
    come from the salt, so the same table packs alike however it is split. Empty input gives an empty result.
    """
    shards = max(1, math.ceil(rows / SHARD_ITEMS))
    found = pieces(sizes, capacities)
    keys = ["container_id", "container_name", "capacity"]
    whole = found.filter("whole").select(*keys, F.format_string("%d-w-%d-%d", "container_id", "doc_id", "piece").alias("container"), F.lit(1).alias("position"), "doc_id", "piece", "start_token", "tokens")

    def one(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        windows = fill(items["tokens"].to_numpy(np.int64), int(key[1]))
        at = np.concatenate([np.array(w, dtype=np.int64) for w in windows])
        out = items.iloc[at].reset_index(drop=True)
        out["container"] = [f"{key[0]}-{key[2]}-{k}" for k, w in enumerate(windows) for _ in w]
        out["position"] = [n for w in windows for n in range(1, len(w) + 1)]
        return out[["container_id", "container_name", "capacity", "container", "position", "doc_id", "piece", "start_token", "tokens"]]

    rest = found.filter("NOT whole").withColumn("shard", F.floor(F.col("salt") * shards).cast("int"))
    packed = rest.groupBy("container_id", "capacity", "shard").applyInPandas(one, PACKED_SCHEMA)
    return packed.unionByName(whole)


def report(packed: DataFrame) -> DataFrame:
    """Per capacity: items, containers, tokens and the share of the room that is used."""
    each = packed.groupBy("container_id", "container_name", "capacity", "container").agg(F.sum("tokens").alias("load"), F.count("*").alias("items"))
    total = each.groupBy("container_id", "container_name", "capacity").agg(F.sum("items").alias("items"), F.count("*").alias("containers"), F.sum("load").alias("tokens"), F.max("load").alias("fullest"))
    return total.withColumn("used_share", F.col("tokens") / (F.col("containers") * F.col("capacity")))
