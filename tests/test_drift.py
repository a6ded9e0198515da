import json
from collections import Counter, defaultdict

import pandas as pd

from lexforge.operators import drift
from lexforge.plans import data_queries

FIELD = {alias: f.name for f in drift.ALIASES for alias in f.aliases}


def leaves(o, prefix=""):
    for k, v in o.items():
        if isinstance(v, dict):
            yield from leaves(v, f"{prefix}{k}.")
        else:
            kind = "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "decimal" if isinstance(v, float) else "string" if isinstance(v, str) else None
            if kind:
                yield prefix + k, kind


def brute(raw: pd.DataFrame):
    out = set()
    raw = raw.drop_duplicates(["file_name", "line_no"])
    for _, stream in raw.groupby("stream_name"):
        before = None
        for _, file in sorted(stream.groupby(["file_seq", "file_name"])):
            counts, lines = Counter(), 0
            for body in file.body:
                try:
                    o = json.loads(body)
                except (TypeError, ValueError):
                    continue
                lines += 1
                if isinstance(o, dict):
                    counts.update(set(leaves(o)))
            carried = defaultdict(lambda: (set(), set()))
            for (name, kind), n in counts.items():
                if n > lines / 2:
                    carried[FIELD.get(name, name)][0].add(name)
                    carried[FIELD.get(name, name)][1].add(kind)
            if before is not None:
                at = file.file_name.iloc[0]
                for f in set(before) | set(carried):
                    if f not in before:
                        out.add((at, f, "added"))
                    elif f not in carried:
                        out.add((at, f, "removed"))
                    else:
                        out |= {(at, f, c) for c, i in (("renamed", 0), ("retyped", 1)) if not before[f][i] & carried[f][i]}
            before = dict(carried)
    return out


def test_found_equals_brute_force(spark, medium):
    got = [tuple(r) for r in data_queries.p3_found(spark, medium).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(pd.read_parquet(f"{medium}/raw_records.parquet"))


SCHEMA = "stream_name string, file_name string, file_seq int, line_no int, record_kind string, body string, written_at timestamp, field string, extra string"


def raw(spark, files):
    rows = [("s", f"f{seq}", seq, i, "metrics", body, None, "clash", "e") for seq, bodies in files.items() for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, SCHEMA)


def test_changes_of_small_files(spark):
    files = {
        1: ['{"latency_ms": 5, "x": 1}', '{"latency_ms": 7, "x": 1}', "broken {"],
        3: ['{"latency_s": 0.5, "x": 1.0}', '{"latency_s": 0.7, "x": 2.0}', None, ""],
        4: ['{"usage": {"cost_usd": "1"}, "x": null}', '{"usage": {"cost_usd": "2"}}'],
        7: ["not json"],
    }
    found = {(r.file_name, r.field_name, r.change_kind) for r in drift.changes(drift.catalogue(raw(spark, files))).collect()}
    assert found == {("f3", "latency_ms", "renamed"), ("f3", "latency_ms", "retyped"), ("f3", "x", "retyped"), ("f4", "latency_ms", "removed"), ("f4", "x", "removed"), ("f4", "cost_usd", "added"), ("f7", "cost_usd", "removed")}


def test_empty_table(spark):
    empty = raw(spark, {1: ["{}"]}).limit(0)
    assert drift.changes(drift.catalogue(empty)).count() == 0
    assert drift.consistent_table(empty).count() == 0


def test_consistent_table_units(spark):
    files = {1: ['{"latency_s": 1.5, "cost_cents": 2.5, "family": " a ", "totalTokens": "12", "other": [1]}', '{"latency": "1315 ms", "usage": {"cost_usd": "$0.024", "cached": 3}, "runId": 17}', "oops", '{"latency_ms": "n/a"}']}
    rows = drift.consistent_table(raw(spark, files)).orderBy("line_no").collect()
    assert (rows[0].latency_ms, rows[0].cost_usd, rows[0].legal_family, rows[0].total_tokens) == (1500.0, 0.025, "a", 12)
    assert (rows[1].latency_ms, rows[1].cost_usd, rows[1].run_id) == (1315.0, 0.024, "17")
    assert (rows[2].valid, rows[2].latency_ms, rows[3].valid, rows[3].latency_ms) == (False, None, True, None)


def test_members_at_any_depth(spark):
    """Six levels deep, and lines of different depth in one file."""
    deep = '{"a": {"b": {"c": {"d": {"e": {"f": 1}}}}}, "x": 1}'
    files = {1: ['{"x": 1, "t": "a { b { c"}', '{"x": 2}'], 2: [deep, deep]}
    found = {(r.file_name, r.field_name, r.change_kind) for r in drift.changes(drift.catalogue(raw(spark, files))).collect()}
    assert found == {("f2", "a.b.c.d.e.f", "added")}


def test_members_under_alias_names_are_kept(spark):
    import json

    lines = ['{"run": {"id": "r1", "started_at": "t"}, "latency_ms": 5, "latency_s": 9, "usage": {"cost_usd": 1, "cached": 3}}', '{"run": "r2", "cost": "n/a", "meta": {"run_id": "r3"}}', '{"run_id": "r4"}']
    rows = drift.consistent_table(raw(spark, {1: lines})).orderBy("line_no").collect()
    assert [r.run_id for r in rows] == ["r1", "r3", "r4"]
    rest = [json.loads(r.other_fields) for r in rows]
    assert json.loads(rest[0].pop("run")) == {"started_at": "t"} and json.loads(rest[0].pop("usage")) == {"cached": "3"} and rest[0] == {"latency_s": "9"}
    assert rest[1:] == [{"run": "r2", "cost": "n/a"}, {}]
