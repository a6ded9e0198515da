"""Near-duplicate records with small edits: ProbMinHash signatures, banding, exact verification.

Texts with the same shingle set are one class, so copies meet once, not in pairs. A signature has BANDS * ROWS registers; a register holds
the earliest arrival over all shingles, where each shingle is an exponential arrival process seeded by its own hash. Two signatures agree
in a register with the probability Jaccard similarity of the weighted sets (for equal weights the plain Jaccard similarity). Classes that
agree in all rows of a band are candidates; candidates are verified on the whole shingle sets.

A pair of similarity s is a candidate with probability 1 - (1 - s**ROWS)**BANDS: 0.974 at 0.6, 0.991 at 0.63, 0.9995 at 0.7, above
0.999999 at 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.shingles import mix, shingle_hashes
from lexforge.session import cut, release

ROWS = 5
BANDS = 45
#: Texts are hashed in pieces of about so many characters, to bound a task's memory; a longer text is a piece by itself.
CHUNK_CHARS = 600_000


def prob_min_hash(doc: np.ndarray, element: np.ndarray, docs: int, registers: int, weight: np.ndarray | None = None) -> np.ndarray:
    """(docs, registers) earliest arrivals of the elements of each document.

    An element of weight w arrives at exponential gaps of mean 1 / w, each arrival in a random register. An element stops as soon as its
    next arrival is later than every register of its document (early termination); all elements run in lockstep. Documents without elements
    keep infinite registers. Repeated elements change nothing.
    """
    arrivals = np.full(docs * registers, np.inf)
    at = np.zeros(len(element))
    row = doc * registers
    step = 0
    while len(element):
        step += 1
        draw = mix(element ^ np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        gap = -np.log(((draw >> np.uint64(16)).astype(np.float64) + 0.5) * 2.0**-48)
        at = at + (gap if weight is None else gap / weight)
        np.minimum.at(arrivals, row + ((draw & np.uint64(0xFFFF)) * np.uint64(registers) >> np.uint64(16)).astype(np.int64), at)
        latest = arrivals.reshape(docs, registers).max(axis=1)
        going = at < latest[doc]
        doc, element, at, row = doc[going], element[going], at[going], row[going]
        weight = None if weight is None else weight[going]
    return arrivals.reshape(docs, registers)


def _sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of each document's distinct shingles, in order of both."""
    offsets, hashes = shingle_hashes(texts, width)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def _classes(doc: np.ndarray, shingle: np.ndarray, docs: int, salt: np.ndarray) -> np.ndarray:
    """One hash per document: equal for equal shingle sets with equal salts."""
    total = np.zeros(docs, np.uint64)
    if len(doc):
        starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        total[doc[starts]] = np.add.reduceat(mix(shingle), starts)
    return mix(total ^ salt)


def _pieces(lengths: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Slices of rows with about CHUNK_CHARS characters each."""
    start = total = i = 0
    for i, n in enumerate(lengths):
        if total and total + n > CHUNK_CHARS:
            yield start, i
            start, total = i, 0
        total += n
    if start <= i:
        yield start, i + 1


def _salt(names: list[str | None]) -> np.ndarray:
    """A hash of each collection's whole name; null is a collection of its own."""
    known = {n: np.uint64(int.from_bytes(hashlib.blake2b(b"" if n is None else b"n" + n.encode(), digest_size=8).digest(), "little")) for n in set(names)}
    return mix(np.array([known[n] for n in names], np.uint64))


def class_of(text: Column, collection: Column, width: int) -> Column:
    """The class of a text within its collection: equal for texts with equal shingle sets; null for a text without shingles."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series, names: pd.Series) -> pd.Series:
        found = []
        values, collections = texts.tolist(), names.tolist()
        for a, b in _pieces(len(t or "") for t in values):
            doc, shingle = _sets(values[a:b], width)
            has = np.bincount(doc, minlength=b - a) > 0
            found.append(pd.array(_classes(doc, shingle, b - a, _salt(collections[a:b])).view(np.int64), dtype="Int64"))
            found[-1][~has] = pd.NA
        return pd.Series(pd.concat([pd.Series(x) for x in found], ignore_index=True) if found else [], dtype="Int64")

    return of(text, collection)


def band_keys(records: DataFrame, width: int, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """(band, class) of each class of `records` (collection, text): one row per band. Copies within a batch are met once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _pieces(len(t or "") for t in texts):
                doc, shingle = _sets(texts[a:b], width)
                salt = _salt(names[a:b])
                classes = _classes(doc, shingle, b - a, salt)
                # the first document of each class stands for it
                first = np.unique(classes, return_index=True)[1]
                first = first[np.bincount(doc, minlength=b - a)[first] > 0]
                if not len(first):
                    continue
                place = np.full(b - a, -1)
                place[first] = np.arange(len(first))
                keep = place[doc] >= 0
                signature = prob_min_hash(place[doc[keep]], shingle[keep], len(first), rows * bands).view(np.uint64).reshape(len(first), bands, rows)
                key = np.broadcast_to((salt[first][:, None] + np.arange(1, bands + 1, dtype=np.uint64)), (len(first), bands))
                for r in range(rows):
                    key = mix(key ^ signature[:, :, r])
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(classes[first].view(np.int64), bands))], names=["band", "class"])

    return records.select("collection", "text").filter(F.col("text").isNotNull()).mapInArrow(run, "band bigint, class bigint")


#: Rows of band keys that one partition takes: the number of partitions grows with the data, not their size.
BAND_ROWS = 500_000


def shared(keys: DataFrame, classes: int) -> DataFrame:
    """(band, class, hub) of the bands that several classes have, hub being the smallest of them: most bands are of one class and end here.

    `classes` is about how many classes there are. Bands are shuffled and sorted once, and read as a stream: a hot band needs no memory.
    """
    parts = max(keys.sparkSession.sparkContext.defaultParallelism, -(-classes * BANDS // BAND_ROWS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # band and hub of the run that the last batch ended in, and whether its hub is out
        for batch in batches:
            band, klass = (c.to_numpy() for c in batch.columns)
            out = False
            if held:
                band, klass, out = np.concatenate(([held[0]], band)), np.concatenate(([held[1]], klass)), held[2]
            # sorted by both, so a repeated row is the one before it again
            new = np.ones(len(band), bool)
            new[1:] = (band[1:] != band[:-1]) | (klass[1:] != klass[:-1])
            band, klass = band[new], klass[new]
            first = np.ones(len(band), bool)
            first[1:] = band[1:] != band[:-1]
            starts = np.flatnonzero(first)
            length = np.diff(np.append(starts, len(band)))
            hub = np.repeat(klass[starts], length)
            several = np.repeat(length > 1, length)
            if out:
                several[0] = False
            held = (band[-1], hub[-1], bool(length[-1] > 1 or (out and len(starts) == 1)))
            if several.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (band, klass, hub)], names=["band", "class", "hub"])

    return keys.repartition(parts, "band").sortWithinPartitions("band", "class").mapInArrow(run, "band bigint, class bigint, hub bigint")


def candidates(held: DataFrame) -> DataFrame:
    """Distinct pairs (class_a < class_b) of classes that share a band, from `shared`. Bands are joined by key; skewed bands are split by AQE."""
    a, b = held.select("band", F.col("class").alias("class_a")), held.select("band", F.col("class").alias("class_b"))
    return a.join(b, "band").filter("class_a < class_b").select("class_a", "class_b").distinct()


def jaccard(text_a: Column, text_b: Column, width: int) -> Column:
    """The exact similarity of two texts' shingle sets."""

    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        left, right, found = a.tolist(), b.tolist(), []
        for i, j in _pieces(len(x) + len(y) for x, y in zip(left, right)):
            n = j - i
            doc, shingle = _sets(left[i:j] + right[i:j], width)
            sizes = np.bincount(doc, minlength=2 * n)
            pair = doc % n
            order = np.lexsort((shingle, pair))
            p, s = pair[order], shingle[order]
            same = (p[1:] == p[:-1]) & (s[1:] == s[:-1])
            both = np.bincount(p[1:][same], minlength=n)
            found.append(both / np.maximum(sizes[:n] + sizes[n:] - both, 1))
        return pd.Series(np.concatenate(found) if found else [], dtype="float64")

    return of(text_a, text_b)


def _with_class(records: DataFrame, width: int) -> DataFrame:
    """The records that have shingles, with their class. An explode drops the others: a filter on the class would hash each text twice."""
    found = records.filter(F.col("text").isNotNull()).withColumn("_c", class_of(F.col("text"), F.col("collection"), width))
    return found.withColumn("class", F.explode(F.filter(F.array("_c"), lambda c: c.isNotNull()))).drop("_c")


def verified(pairs: DataFrame, records: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (class_a, class_b) whose similarity on whole shingle sets is at least `threshold`, with it."""
    one = _with_class(records, width).groupBy("class").agg(F.min("text").alias("text"))
    a, b = one.select(F.col("class").alias("class_a"), F.col("text").alias("text_a")), one.select(F.col("class").alias("class_b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "class_a").join(b, "class_b")
    return both.select("class_a", "class_b", jaccard(F.col("text_a"), F.col("text_b"), width).alias("similarity")).filter(F.col("similarity") >= threshold)


def alike_classes(records: DataFrame, width: int, threshold: float) -> DataFrame:
    """Verified pairs of classes: class_a, class_b, similarity (at least `threshold`)."""
    return verified(candidates(shared(band_keys(records, width), records.count())), records, width, threshold)


def members(records: DataFrame, width: int) -> DataFrame:
    """collection, id, class of each record with shingles; repeated rows of an id count once."""
    return _with_class(records.filter(F.col("id").isNotNull()), width).select("collection", "id", "class").distinct()


def alike_pairs(records: DataFrame, width: int, threshold: float) -> DataFrame:
    """Every pair of different ids of one collection whose texts are alike: collection, id_a < id_b.

    `records` has collection, id, text. Rows that repeat an id are the same record. Null ids and null texts, and texts of fewer than
    `width` words, are in no pair. All pairs come out, those between copies too, so the result is as large as the groups make it; a caller
    that wants it linear takes `groups`.
    """
    m = members(records, width)
    within = m.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    links = alike_classes(records, width, threshold).select("class_a", "class_b").union(within)
    a, b = m.select("collection", F.col("class").alias("class_a"), F.col("id").alias("a")), m.select(F.col("collection").alias("_c"), F.col("class").alias("class_b"), F.col("id").alias("b"))
    pairs = links.join(a, "class_a").join(b, "class_b").filter(F.col("collection").eqNullSafe(F.col("_c"))).filter((F.col("class_a") != F.col("class_b")) | (F.col("a") < F.col("b")))
    return pairs.select("collection", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).filter("id_a < id_b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b) is connected with, by alternating star contraction.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest; the edges stay few and are written to the
    shared folder, so lineage stays short, and those of the round before are deleted. Goes on until nothing changes, however long the chains
    are (about log n rounds).
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), "m").union(low.select("a", "m")).filter("a <> m").select("a", F.col("m").alias("b")).distinct()
        new = cut(small, "edges")
        changed = new.join(edges, ["a", "b"], "left_anti").limit(1).count() + edges.join(new, ["a", "b"], "left_anti").limit(1).count()
        release(edges)
        edges = new
        if not changed:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def linked_classes(records: DataFrame, width: int, threshold: float) -> DataFrame:
    """(node, root) of classes that any number of links connects.

    First each class of a band is held against the band's smallest class alone, as many pairs as rows. Then only classes of one band that are
    not yet connected are held against each other: no link between different components is lost, and a large group costs no square of it.
    """
    keys = cut(shared(band_keys(records, width), records.count()), "bands")
    star = keys.filter("class <> hub").select(F.col("hub").alias("class_a"), F.col("class").alias("class_b")).distinct()
    links = cut(verified(star, records, width, threshold).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), "links")
    first = components(links)
    placed = keys.join(first.withColumnRenamed("node", "class"), "class", "left").select("band", "class", F.coalesce("root", "class").alias("root"))
    w = Window.partitionBy("band")
    open_ = placed.withColumns({"_low": F.min("root").over(w), "_high": F.max("root").over(w)}).filter("_low <> _high")
    x, y = open_.select("band", F.col("class").alias("class_a"), F.col("root").alias("root_a")), open_.select("band", F.col("class").alias("class_b"), F.col("root").alias("root_b"))
    rest = x.join(y, "band").filter("class_a < class_b AND root_a <> root_b").select("class_a", "class_b").distinct().join(star, ["class_a", "class_b"], "left_anti")
    more = verified(rest, records, width, threshold).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    return components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))


def groups(records: DataFrame, width: int, threshold: float) -> DataFrame:
    """One row per record with shingles: collection, id, class, group (the smallest class it is linked with, over any number of links)."""
    m = members(records, width)
    roots = linked_classes(records, width, threshold)
    return m.join(roots.withColumnRenamed("node", "class"), "class", "left").select("collection", "id", "class", F.coalesce("root", "class").alias("group"))
