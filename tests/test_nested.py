import json

import pandas as pd
from pyspark.sql import functions as F

from lexforge.operators import nested
from lexforge.plans import data_queries

LISTS = nested.LIST_MEMBERS


def brute(value, path, name, top=False):
    """Paths of listed objects, by plain recursion."""
    out = []

    def as_list(v):
        if isinstance(v, str) and v.lstrip().startswith("["):
            try:
                v = json.loads(v)
            except ValueError:
                return None
        return [v] if isinstance(v, dict) else v if isinstance(v, list) else None

    def members(items, p, n):
        for i, m in enumerate(items):
            if isinstance(m, dict):
                out.append(f"{p}[{i}]")
                inside(m, f"{p}[{i}]")
            elif isinstance(m, list):
                members(m, f"{p}[{i}]", n)

    def inside(o, p):
        for k, v in o.items():
            items = as_list(v) if k in LISTS else v if isinstance(v, list) else None
            if items is not None:
                members(items, f"{p}.{k}", k)
            elif isinstance(v, dict):
                inside(v, f"{p}.{k}")

    items = as_list(value)
    if items is not None:
        members(items, path, name)
    return out


def test_found_equals_recursion(spark, medium):
    got = {tuple(r) for r in data_queries.p1_found(spark, medium).collect()}
    want = set()
    runs = pd.read_parquet(f"{medium}/trace_runs.parquet").drop_duplicates("source_path")
    for key, text in zip(runs.source_path, runs.cases):
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            continue
        want |= {("trace_runs", key, p) for p in brute(value, "cases", "cases")}
    items = pd.read_parquet(f"{medium}/review_queue.parquet").drop_duplicates("review_item_id")
    plain = lambda v: [plain(x) for x in v] if hasattr(v, "tolist") and getattr(v, "ndim", 0) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
    for key, c in zip(items.review_item_id, items.citations):
        if c is not None:
            want |= {("review_queue", key, p) for p in brute(plain(c), "citations", "citations")}
    assert got == want


def make(spark, texts):
    return spark.createDataFrame([(f"k{i}", t, "x", "y") for i, t in enumerate(texts)], "k string, cases string, kind string, pre string")


def paths(spark, texts):
    return sorted((r.root_key, r.node_path) for r in nested.label_nodes(make(spark, texts), "t", "k", "cases").collect())


def test_odd_texts(spark):
    texts = [None, "", "  ", "no json", '[{"a":1}', '[{"a":1}] x', "[NaN]", "[]", "null", "3", '"[{}]"', '{"a": 1}', '[1, null, "x", {"b": [{"c": 2}]}, [{"d": 1}]]', '[{"spans": {"x": 1}, "warnings": "[{}, 1, {}]", "other": "[{}]", "attempts": "[oops"}]']
    assert paths(spark, texts) == sorted(
        [("k10", "cases[0]"), ("k11", "cases[0]"), ("k12", "cases[3]"), ("k12", "cases[3].b[0]"), ("k12", "cases[4][0]"), ("k13", "cases[0]"), ("k13", "cases[0].spans[0]"), ("k13", "cases[0].warnings[0]"), ("k13", "cases[0].warnings[2]")]
    )


def test_empty_table(spark):
    assert nested.label_nodes(make(spark, ["x"]).limit(0), "t", "k", "cases").count() == 0


def test_intervals_and_links(spark, small):
    nodes = data_queries._nodes(spark, small, bodies=False)
    linked = nested.link_by_containment(nodes).toPandas()
    assert len(linked) == nodes.count()
    by_key = {k: g for k, g in linked.groupby(["table_name", "root_key"])}
    for g in by_key.values():
        assert sorted(g.pre) == list(range(len(g))) == sorted(g.post)
        spans = list(zip(g.node_path, g.pre, g.post))
        for path, pre, post, parent in zip(g.node_path, g.pre, g.post, g.parent_path):
            holders = [(q, b) for q, b, e in spans if b < pre and e > post]
            assert parent == (max(holders, key=lambda x: x[1])[0] if holders else None)
            assert all(path.startswith(q) for q, _ in holders)


def test_flat_table_types(spark):
    texts = ['[{"case_id": "a", "family": null, "spans": [{"duration_ms": "7"}, {"duration_ms": true}, {"duration_ms": 5}]}]']
    linked = nested.link_by_containment(nested.label_nodes(make(spark, texts), "t", "k", "cases"))
    rows = nested.flat_table(linked, "spans", {"duration_ms": "bigint"}).orderBy("pre").collect()
    assert [r.duration_ms for r in rows][2] == 5
    assert {r.parent_path for r in rows} == {"cases[0]"}


def test_repeated_keys_count_once(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n"), (None, 0, "m")], "k string, t int, v string")
    from lexforge.operators.dedup import one_per_key

    assert sorted(map(tuple, one_per_key(d, ["k"], ["t"], ["v"]).collect()), key=str) == [("a", "x"), ("b", "z"), (None, "m")]
    assert one_per_key(d.limit(0), ["k"], ["t"], ["v"]).count() == 0
    assert {r.v for r in one_per_key(d, ["k"], ["t"], ["v"], latest=True).filter(F.col("k") == "a").collect()} == {"y"}


def test_flat_table_keeps_all_members(spark):
    texts = ['[{"case_id": "a", "system_result": {"grounded": true, "deep": {"x": [1, 2], "warnings": [{"code": "w"}]}}, "ids": ["p", "q"], "mixed": [1, {"b": 2}], "spans": [{"outputs_summary": {"n": 3}}]}]']
    linked = nested.link_by_containment(nested.label_nodes(make(spark, texts), "t", "k", "cases"))
    rows = {k: [json.loads(r.members) for r in nested.flat_table(linked, k, {}).collect()] for k in ("cases", "spans", "warnings", "mixed")}
    assert rows["cases"] == [{"case_id": "a", "system_result": {"grounded": True, "deep": {"x": [1, 2]}}, "ids": ["p", "q"], "mixed": [1, None]}]
    assert (rows["spans"], rows["warnings"], rows["mixed"]) == ([{"outputs_summary": {"n": 3}}], [{"code": "w"}], [{"b": 2}])


def rebuild(rows):
    """A record from its rows: every object with its own scalars, every value, at its path."""
    import re

    root = {}
    for r in sorted(rows, key=lambda r: r.pre):
        steps = [int(x) if x.isdigit() else x for x in re.findall(r"[^.\[\]]+", r.node_path)]
        at = root
        for step, following in zip(steps, [*steps[1:], None]):
            if isinstance(at, list):
                at.extend([None] * (step + 1 - len(at)))
            new = json.loads(r.body) if following is None else [] if isinstance(following, int) else {}
            held = at[step] if isinstance(at, list) else at.get(step)
            if held is None or following is None:
                at[step] = new if held is None else {**held, **new}
            at = at[step]
    return root


def normal(value, name):
    """The record as the walk reads it: lists by contract are lists, empty root objects aside."""
    items = nested._as_list(value) if name in LISTS else value if isinstance(value, list) else None
    if items is not None:
        return [normal(m, "") if not isinstance(m, list) else [normal(x, "") for x in m] for m in items]
    return {k: normal(v, k) for k, v in value.items()} if isinstance(value, dict) else value


def test_records_can_be_put_together_again(spark):
    texts = [
        '[{"case_id": "a", "system_result": {"grounded": true, "deep": {"x": [1, 2, null], "empty": {}, "none": [], "warnings": [{"code": "w"}]}}, "ids": ["p", "q"], "mixed": [1, {"b": 2}], "spans": "[{\\"n\\": 3}, 5]"}]',
        '{"a": {"b": {"c": [[1, {"d": [{"e": "x"}]}], []]}}, "attempts": {"n": 1}}',
    ]
    nodes = nested.link_by_containment(nested.label_nodes(make(spark, texts), "t", "k", "cases", every=True)).collect()
    for i, text in enumerate(texts):
        rows = [r for r in nodes if r.root_key == f"k{i}"]
        assert sorted(r.pre for r in rows) == sorted(r.post for r in rows) == list(range(len(rows)))
        assert rebuild(rows)["cases"] == normal(json.loads(text), "cases")
        for r in rows:
            holders = [q for q in rows if q.pre < r.pre and q.post > r.post]
            assert r.parent_path == (max(holders, key=lambda q: q.pre).node_path if holders else None)
    deep = {r.node_path: (r.role, r.body) for r in nodes if r.root_key == "k1"}
    assert deep["cases[0].a.b.c[0][1].d[0]"] == ("listed", '{"e":"x"}') and deep["cases[0].attempts[0]"] == ("listed", '{"n":1}') and deep["cases[0].a"] == ("lone", "{}")


def test_every_scalar_of_the_tables_has_a_row(spark, small):
    """Counted against a plain recursion over the JSON: no member at any path is lost."""
    texts = [t for t in pd.read_parquet(f"{small}/trace_runs.parquet").drop_duplicates("source_path").cases.dropna()]

    def leaves(v, name):
        items = nested._as_list(v) if name in LISTS else v if isinstance(v, list) else None
        if items is not None:
            return sum(leaves(m, "") if not isinstance(m, str) else 1 for m in items)
        return sum(leaves(x, k) for k, x in v.items()) if isinstance(v, dict) else 1

    want = 0
    for t in texts:
        try:
            want += leaves(json.loads(t), "cases")
        except ValueError:
            continue
    objects = data_queries.p1_objects(spark, small).filter("table_name = 'trace_runs'").collect()
    got = sum(len([v for v in json.loads(r.members).values() if v != []]) for r in objects)
    assert got + data_queries.p1_values(spark, small).filter("table_name = 'trace_runs'").count() == want > 1000
