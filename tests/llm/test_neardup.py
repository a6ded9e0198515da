import itertools
import re

import numpy as np
import pandas as pd

from lexforge.llm import neardup as n
from lexforge.llm import queries
from lexforge.llm.shingles import shingle_hashes


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(t, k=3):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_shingles_equal_plain_ones():
    texts = ["A b, C-d e.", None, "", "x", "Ünï cödé 42 ß z", "a b c a b c", "one\r\ntwo\tthree four", "😀 q w e r"]
    offsets, hashes = shingle_hashes(texts, 3)
    for i, t in enumerate(texts):
        w = words(t)
        assert offsets[i + 1] - offsets[i] == max(len(w) - 2, 0)
        assert len(set(hashes[offsets[i] : offsets[i + 1]].tolist())) == len(shingles(t))
    again = shingle_hashes(["zz yy xx", "a b c"], 3)[1]
    assert again[1] == hashes[offsets[5]]


def test_signature_estimates_similarity():
    a, b = np.arange(100, dtype=np.uint64), np.arange(40, 140, dtype=np.uint64)
    s = n.prob_min_hash(np.repeat([0, 1], 100), n.mix(np.concatenate([a, b])), 2, 4000)
    assert abs((s[0] == s[1]).mean() - 60 / 140) < 0.03
    w = n.prob_min_hash(np.repeat([0, 1], 2), n.mix(np.array([1, 2, 1, 3], np.uint64)), 2, 4000, np.array([3.0, 1.0, 3.0, 1.0]))
    assert abs((w[0] == w[1]).mean() - 3 / 5) < 0.03
    same = n.prob_min_hash(np.zeros(6, np.int64), n.mix(np.array([1, 2, 3, 1, 2, 3], np.uint64)), 1, 50)
    assert (same == n.prob_min_hash(np.zeros(3, np.int64), n.mix(np.array([1, 2, 3], np.uint64)), 1, 50)).all()


def test_found_equals_all_pairs(spark, medium):
    got = {tuple(r) for r in queries.p5_found(spark, medium).select("table_name", "id_a", "id_b").collect()}
    want = set()
    for table, key in (("parent_chunks", "parent_chunk_id"), ("child_chunks", "child_chunk_id")):
        d = pd.read_parquet(f"{medium}/{table}.parquet").drop_duplicates(key)
        sets = {k: shingles(t) for k, t in zip(d[key], d.text)}
        holders = {}
        for k, s in sets.items():
            for x in s:
                holders.setdefault(x, []).append(k)
        near = {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}
        want |= {(table, a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    assert len(want - got) <= 0.005 * len(want)
    assert not got - want


def records(spark, rows):
    return spark.createDataFrame(rows, "collection string, id string, text string")


def test_copies_short_texts_and_repeats(spark):
    long = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [("a", "1", long), ("a", "2", long.upper() + "!"), ("a", "2", long.upper() + "!"), ("b", "3", long), ("a", "4", "two words"), ("a", "5", None), ("a", "6", ""), ("a", None, long), ("a", "7", long + " again")]
    pairs = sorted((r.collection, r.id_a, r.id_b) for r in n.alike_pairs(records(spark, rows), 3, 0.6).collect())
    assert pairs == [("a", "1", "2"), ("a", "1", "7"), ("a", "2", "7")]
    groups = {(r.collection, r.id): r.group for r in n.groups(records(spark, rows), 3, 0.6).collect()}
    assert set(groups) == {("a", "1"), ("a", "2"), ("a", "7"), ("b", "3")}
    assert len({groups["a", x] for x in "127"}) == 1 and groups["b", "3"] != groups["a", "1"]
    assert n.alike_pairs(records(spark, rows).limit(0), 3, 0.6).count() == 0


def test_a_third_of_copies(spark):
    rows = [("a", f"c{i:03}", "same text of every copy in this hot group of records") for i in range(60)] + [("a", f"u{i:03}", f"own {i} words {i * 7} here {i * 13} and {i * 17} there {i * 19}") for i in range(120)]
    assert n.alike_pairs(records(spark, rows), 3, 0.6).count() == 60 * 59 // 2


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in n.components(edges).collect()}
    assert {roots[i] for i in range(41)} == {0} and {roots[i] for i in (100, 101, 102)} == {100}
    assert n.components(edges.limit(0)).count() == 0


def test_collections_that_begin_alike_are_apart(spark):
    """The whole name of a collection counts, not its first bytes."""
    text = "one two three four five six seven"
    rows = [(c, i, text) for c, i in (("2025-01-01", "1"), ("2025-01-02", "2"), ("2025-01-01", "3"), (None, "4"))]
    assert sorted(map(tuple, n.alike_pairs(records(spark, rows), 3, 0.6).select("collection", "id_a", "id_b").collect())) == [("2025-01-01", "1", "3")]
    groups = {r.id: r.group for r in n.groups(records(spark, rows), 3, 0.6).collect()}
    assert len({groups[i] for i in "124"}) == 3 and groups["1"] == groups["3"]


def test_groups_equal_components_of_the_pairs(spark):
    """Chains in which only neighbours are alike: the star of a band alone would lose links."""
    words = [f"w{i}" for i in range(400)]
    rows = [("a", f"{i:03}", " ".join(words[i * 4 : i * 4 + 40])) for i in range(60)] + [("a", f"x{i}", f"other {i} text {i * 3} of {i * 5} its {i * 7} own") for i in range(20)]
    r = records(spark, rows)
    pairs = [(p.id_a, p.id_b) for p in n.alike_pairs(r, 3, 0.6).collect()]
    root = {i: i for _, i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    groups = {g.id: g.group for g in n.groups(r, 3, 0.6).collect()}
    by = lambda of: sorted(sorted(i for i in root if of(i) == k) for k in {of(i) for i in root})
    assert len(pairs) >= 59 and by(lambda i: groups[i]) == by(find)


def test_shared_bands_across_batches(spark):
    """Runs that go over the ends of batches, repeated rows, and a band that holds a third of all rows."""
    rows = [(b, c) for b in range(300) for c in range(b % 4)] + [(1000, c) for c in range(300)] + [(7, 0), (7, 0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(tuple(r) for r in n.shared(spark.createDataFrame(rows, "band long, class long"), 1).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = sorted({(b, c, 0) for b, c in rows if b == 1000 or b % 4 > 1})
    assert got == want
