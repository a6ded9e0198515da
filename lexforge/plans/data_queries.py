"""Queries of the general data-preparation operators (nested records, drifting schemas)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators import drift, nested
from lexforge.operators.dedup import one_per_key
from lexforge.session import cut
from lexforge.sources.tables import table


def _nodes(spark: SparkSession, folder: str, bodies: bool, every: bool = False) -> DataFrame:
    runs = one_per_key(table(spark, folder, "trace_runs"), ["source_path"], ["loaded_at"], ["cases"])
    items = one_per_key(table(spark, folder, "review_queue"), ["review_item_id"], ["exported_at"], ["citations"])
    return nested.label_nodes(runs, "trace_runs", "source_path", "cases", bodies=bodies, every=every).unionByName(nested.label_nodes(items, "review_queue", "review_item_id", "citations", bodies=bodies, every=every))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder, bodies=False).select("table_name", "root_key", "node_path")


def p1_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return nested.link_by_containment(_nodes(spark, folder, bodies=False)).drop("body")


#: The flat table of each kind of object, with the members that become columns.
P1_TABLES = {
    "cases": {"case_id": "string", "family": "string", "query": "string", "runner_status": "string", "error": "string"},
    "citations": {"parent_chunk_id": "string", "document_id": "string", "source_name": "string", "heading": "string", "supporting_excerpt": "string"},
    "locations": {"locator": "string", "start_char": "int", "end_char": "int"},
    "spans": {"span_id": "string", "parent_span_id": "string", "span_name": "string", "stage": "string", "status": "string", "duration_ms": "bigint"},
    "warnings": {"code": "string", "message": "string", "severity": "string"},
    "attempts": {"attempt_no": "int", "wait_ms": "int"},
    "prior_messages": {"role": "string", "content": "string"},
}


def _p1_flat(kind: str):
    return lambda spark, folder: nested.flat_table(nested.link_by_containment(_nodes(spark, folder, bodies=True)), kind, P1_TABLES[kind])


_KEYS = ("table_name", "root_key", "kind", "node_path")


def p1_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Every object, lone or listed, with its own scalars as JSON and the object that holds it: any member at any path is in some row."""
    linked = nested.link_by_containment(_nodes(spark, folder, bodies=True, every=True))
    return linked.filter(F.col("role") != nested.VALUE).select(*_KEYS, "role", "position", "pre", "post", "parent_kind", "parent_path", F.col("body").alias("members"))


def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every scalar member of a list, as JSON, with its position and the object that holds the list."""
    linked = nested.link_by_containment(_nodes(spark, folder, bodies=True, every=True))
    return linked.filter(F.col("role") == nested.VALUE).select(*_KEYS, "position", "pre", "post", "parent_kind", "parent_path", F.col("body").alias("value"))


def p1_other(spark: SparkSession, folder: str) -> DataFrame:
    """Listed objects of a kind without a table of its own. Not registered: the tables at hand have none."""
    return nested.link_by_containment(_nodes(spark, folder, bodies=True)).filter(~F.col("kind").isin(*P1_TABLES))


def _carried(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue (a few rows per file), written once: several windows read it."""
    return cut(drift.catalogue(table(spark, folder, "raw_records")), "p3-catalogue")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(_carried(spark, folder)).select("file_name", "field_name", "change_kind")


def p3_lifespans(spark: SparkSession, folder: str) -> DataFrame:
    return drift.lifespans(_carried(spark, folder)).drop("island")


def p3_table(spark: SparkSession, folder: str) -> DataFrame:
    return drift.consistent_table(table(spark, folder, "raw_records"))


QUERIES = {
    "p1_found": p1_found,
    "p1_nodes": p1_nodes,
    "p1_objects": p1_objects,
    "p1_values": p1_values,
    **{f"p1_{kind}": _p1_flat(kind) for kind in P1_TABLES},
    "p3_found": p3_found,
    "p3_lifespans": p3_lifespans,
    "p3_table": p3_table,
}

_L = "cases|citations|spans|warnings|locations|attempts|prior_messages"

# The objects of the records by a JSON tree: lists that are held as text are trees of their own below their member (two levels of them), and a
# lone object in place of a list has position 0 in every path through it.
_TREE = rf"""docs AS (SELECT 'trace_runs' AS table_name, 'cases' AS col, source_path AS root_key, doc FROM (SELECT source_path, arg_min(cases, loaded_at) AS doc FROM trace_runs GROUP BY ALL) WHERE json_valid(doc)
  UNION ALL SELECT 'review_queue', 'citations', review_item_id, doc FROM (SELECT review_item_id, to_json(arg_min(citations, exported_at))::VARCHAR AS doc FROM review_queue GROUP BY ALL) WHERE doc IS NOT NULL),
 t0 AS (SELECT d.table_name, d.root_key, d.col || substr(j.fullkey, 2) AS path, j.id AS o0, 0 AS o1, 0 AS o2, j.type, j.atom, j.value FROM docs d, json_tree(d.doc) j),
 s1 AS (SELECT table_name, root_key, path, o0, json_extract_string(atom, '$') AS doc FROM t0 WHERE type = 'VARCHAR' AND regexp_matches(path, '\.({_L})$')),
 t1 AS (SELECT s.table_name, s.root_key, s.path || substr(j.fullkey, 2) AS path, s.o0, j.id AS o1, 0 AS o2, j.type, j.atom, j.value FROM (SELECT * FROM s1 WHERE starts_with(ltrim(doc), '[') AND json_valid(doc)) s, json_tree(s.doc) j),
 s2 AS (SELECT table_name, root_key, path, o0, o1, json_extract_string(atom, '$') AS doc FROM t1 WHERE type = 'VARCHAR' AND regexp_matches(path, '\.({_L})$')),
 t2 AS (SELECT s.table_name, s.root_key, s.path || substr(j.fullkey, 2) AS path, s.o0, s.o1, j.id AS o2, j.type, j.atom, j.value FROM (SELECT * FROM s2 WHERE starts_with(ltrim(doc), '[') AND json_valid(doc)) s, json_tree(s.doc) j),
 objects AS (SELECT table_name, root_key, o0, o1, o2, value, regexp_replace(regexp_replace(regexp_replace(path, '^(cases|citations)($|\.)', '\1[0]\2'), '\.({_L})($|\.)', '.\1[0]\2', 'g'), '\.({_L})($|\.)', '.\1[0]\2', 'g') AS node_path
  FROM (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2) WHERE type = 'OBJECT'),
 found AS (SELECT * FROM objects WHERE ends_with(node_path, ']'))"""

_NODES = rf"""WITH {_TREE},
 numbered AS (SELECT *, regexp_extract(node_path, '([A-Za-z_0-9]+)(\[\d+\])+$', 1) AS kind, regexp_extract(node_path, '\[(\d+)\]$', 1)::INT AS position, len(regexp_extract_all(node_path, '(\[\d+\])+'))::INT - 1 AS depth,
  (row_number() OVER (PARTITION BY table_name, root_key ORDER BY o0, o1, o2) - 1)::INT AS pre, nullif(regexp_replace(node_path, '(\.[A-Za-z_0-9]+)+(\[\d+\])+$', ''), node_path) AS parent_path FROM found),
 below AS (SELECT a.table_name, a.root_key, a.pre, count(b.pre)::INT AS n FROM numbered a LEFT JOIN numbered b ON a.table_name = b.table_name AND a.root_key = b.root_key AND starts_with(b.node_path, a.node_path || '.') GROUP BY ALL),
 labelled AS (SELECT numbered.*, pre + n - depth AS post FROM numbered JOIN below USING (table_name, root_key, pre))
 SELECT a.table_name, a.root_key, a.kind, a.node_path, a.position, a.depth, a.pre, a.post, h.kind AS parent_kind, a.parent_path, h.pre AS parent_pre, h.post AS parent_post
 FROM labelled a LEFT JOIN labelled h ON h.table_name = a.table_name AND h.root_key = a.root_key AND h.node_path = a.parent_path"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_TREE} SELECT table_name, root_key, node_path FROM found",
    "p1_nodes": _NODES,
}
