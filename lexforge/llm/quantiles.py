"""Percentiles of very large numeric columns: q-digests over a bounded universe.

A value becomes an integer in [0, 2**UNIVERSE_BITS) by an order-keeping log-linear rule; a digest is a set of counted nodes of the dyadic tree
over that universe. Digests of days (or partitions) are merged by adding the counts of equal nodes and compressing again.

Stated error of a percentile: the rank of the returned bucket is off by at most UNIVERSE_BITS * floor(n / compression) of n values (a digest
of under `compression` values is exact), and the bucket's value by at most a factor 2**-(MANTISSA_BITS - 1) (integers below
2**MANTISSA_BITS units are exact).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units below 2**MANTISSA_BITS have a bucket each; above, each doubling has 2**(MANTISSA_BITS - 1) buckets.
MANTISSA_BITS = 11
#: More than enough for every value of a signed 64-bit integer under that rule.
UNIVERSE_BITS = 20
#: The bucket of the largest value, 2**62 - 1; the universe has some room above it.
TOP_BUCKET = ((1 << MANTISSA_BITS) - 1) + (62 - MANTISSA_BITS) * (1 << (MANTISSA_BITS - 1))
#: Larger keeps more nodes (at most 3 * compression a digest) and a smaller rank error; this one bounds it by 0.1 % of n.
COMPRESSION = 20_000


def bucket(units: Column) -> Column:
    """The bucket of a non-negative whole number of units: itself below 2**MANTISSA_BITS, else by exponent and leading bits."""
    half = 1 << (MANTISSA_BITS - 1)
    v = F.least(F.greatest(units.cast("bigint"), F.lit(0)), F.lit((1 << 62) - 1))
    # the shift that leaves MANTISSA_BITS bits; log2 of a long may round up at a power of two, so the result is corrected once
    raw = F.greatest(F.floor(F.log2(F.greatest(v, F.lit(1)).cast("double"))).cast("int") - (MANTISSA_BITS - 1), F.lit(0))
    shift = F.when((F.call_function("shiftright", v, raw) < half) & (raw > 0), raw - 1).otherwise(raw)
    return (F.call_function("shiftright", v, shift) + shift * half).cast("int")


def bucket_low(index: Column) -> Column:
    """The smallest number of units in a bucket; a node that reaches above the top bucket counts as it."""
    half = 1 << (MANTISSA_BITS - 1)
    index = F.least(index, F.lit(TOP_BUCKET))
    shift = F.greatest(F.floor(index / half).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (index - shift * half).cast("bigint"), shift)


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, compression: int, bits: int = UNIVERSE_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compresses the digests of many groups at once, level by level from the leaves.

    Nodes are numbered as in a heap: leaves 2**bits + bucket, the parent of i is i // 2, the root 1. Two siblings and their parent that
    together count at most floor(n / compression) become the parent alone.
    """
    limit = np.bincount(group, weights=count).astype(np.int64) // compression
    level = np.frexp(node.astype(np.float64))[1] - 1
    key = (group.astype(np.int64) << (bits + 1)) | node
    mask = (1 << (bits + 1)) - 1
    by_level = {}
    for x in np.unique(level):
        k, inverse = np.unique(key[level == x], return_inverse=True)
        by_level[int(x)] = (k, np.bincount(inverse, weights=count[level == x]))
    none = (np.empty(0, np.int64), np.empty(0))
    up, up_count, kept = *none, []
    for x in range(bits, 0, -1):
        own, own_count = by_level.get(x, none)
        keys, inverse = np.unique(np.concatenate([own, up]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([own_count, up_count]))
        if not len(keys):
            up, up_count = none
            continue
        g = keys >> (bits + 1)
        parents, inverse = np.unique((g << (bits + 1)) | ((keys & mask) >> 1), return_inverse=True)
        total = np.bincount(inverse, weights=counts)
        above, above_count = by_level.get(x - 1, none)
        held = np.zeros(len(parents))
        if len(above):
            at = np.minimum(np.searchsorted(above, parents), len(above) - 1)
            held = np.where(above[at] == parents, above_count[at], 0)
        merge = total + held <= limit[parents >> (bits + 1)]
        stay = ~merge[inverse]
        kept.append((keys[stay], counts[stay]))
        up, up_count = parents[merge], total[merge]
    own, own_count = by_level.get(0, none)
    keys, inverse = np.unique(np.concatenate([own, up]), return_inverse=True)
    kept.append((keys, np.bincount(inverse, weights=np.concatenate([own_count, up_count])) if len(keys) else np.empty(0)))
    keys, counts = (np.concatenate(x) for x in zip(*kept))
    return keys >> (bits + 1), keys & mask, counts.astype(np.int64)


def _compressed(nodes: DataFrame, keys: Sequence[str], compression: int, chunk: int = 200_000) -> DataFrame:
    """Compresses the digests in (keys, node, count); one digest is at most the universe, so a task's memory is bounded by it and `chunk`."""
    keys = list(keys)
    placed = nodes.select(*keys, "node", "count").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= chunk:
                whole, rest = _split(pa.Table.from_batches(held), keys)
                yield from _compress_table(whole, keys, compression)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from _compress_table(pa.Table.from_batches(held), keys, compression)

    return placed.mapInArrow(run, placed.schema)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """True where a row's keys differ from the row before."""
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for k in keys:
        codes = t[k].combine_chunks().dictionary_encode()
        index = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy(zero_copy_only=False)
        change[1:] |= index[1:] != index[:-1]
    return change


def _split(t: pa.Table, keys: list[str]) -> tuple[pa.Table, pa.Table]:
    """The rows before the last group, and the last group's."""
    last = int(np.flatnonzero(_starts(t, keys))[-1])
    return t.slice(0, last), t.slice(last)


def _compress_table(t: pa.Table, keys: list[str], compression: int) -> Iterator[pa.RecordBatch]:
    if not t.num_rows:
        return
    starts = _starts(t, keys)
    group, node, count = compress(np.cumsum(starts) - 1, t["node"].to_numpy(), t["count"].to_numpy(), compression)
    names = t.select(keys).take(np.flatnonzero(starts)[group])
    out = names.append_column("node", pa.array(node, t.schema.field("node").type)).append_column("count", pa.array(count, pa.int64()))
    yield from out.combine_chunks().to_batches()


def digest(values: DataFrame, keys: Sequence[str], units: str, compression: int = COMPRESSION) -> DataFrame:
    """A q-digest per key tuple: (keys, node, count).

    `units` names a column of whole numbers; null is not measured and is left out, negative counts as 0. Equal buckets are counted in the
    map tasks before anything is shuffled, so a key that holds most rows sends no more than its distinct buckets per task. Empty input gives
    an empty digest.
    """
    leaves = values.filter(F.col(units).isNotNull()).withColumn("node", bucket(F.col(units)) + (1 << UNIVERSE_BITS))
    return _compressed(leaves.groupBy(*keys, "node").agg(F.count("*").alias("count")), keys, compression)


def merge(digests: DataFrame, keys: Sequence[str], compression: int = COMPRESSION) -> DataFrame:
    """The digests with equal `keys` put together: equal nodes are added, then compressed. The error bound stays that of one digest."""
    added = digests.groupBy(*keys, "node").agg(F.sum("count").alias("count"))
    return _compressed(added, keys, compression)


def percentiles(digests: DataFrame, keys: Sequence[str], quantiles: Sequence[float], compression: int = COMPRESSION) -> DataFrame:
    """Per key and quantile: n, units (the smallest value whose rank is at least ceil(q * n), within the error), and the rank error bound.

    Nodes are read by their right end, smaller nodes first, until the count reaches the rank. A digest has a bounded number of nodes, so
    the window per key is small.
    """
    keys = list(keys)
    level = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
    right = (F.call_function("shiftleft", F.col("node") + 1, UNIVERSE_BITS - F.col("level")) - 1 - (1 << UNIVERSE_BITS)).cast("int")
    w = Window.partitionBy(*keys)
    nodes = digests.withColumn("level", level).withColumn("right", right)
    nodes = nodes.withColumns({"n": F.sum("count").over(w), "upto": F.sum("count").over(w.orderBy("right", F.desc("level")).rowsBetween(Window.unboundedPreceding, 0))})
    wanted = nodes.withColumn("quantile", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    reached = wanted.filter(F.col("upto") >= F.greatest(F.ceil(F.col("quantile") * F.col("n")), F.lit(1)))
    found = reached.groupBy(*keys, "n", "quantile").agg(F.min("right").alias("right"))
    return found.select(*keys, "quantile", "n", bucket_low(F.col("right")).alias("units"), (F.lit(UNIVERSE_BITS) * F.floor(F.col("n") / compression)).alias("rank_error_bound"))


def packed(digests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per digest: keys, n, and its nodes with their counts as an array (bounded by 3 * compression), for storing and sending on."""
    return digests.groupBy(*keys).agg(F.sum("count").alias("n"), F.array_sort(F.collect_list(F.struct("node", "count"))).alias("nodes"))


def unpacked(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The digests of `packed` as rows: keys, node, count."""
    return stored.select(*keys, F.inline("nodes"))
