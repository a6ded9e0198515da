"""Deeply nested records to related flat tables, by interval labels.

Every node of a record (object, or scalar member of a list) gets a pre-order and a post-order number from one depth-first walk; a node's interval
(pre, post) lies inside the interval of every object that holds it. The walk may also be told to label the members of lists that are objects only. The walk is a small per-record helper run inside tasks; everything else (one row per key, node tables
per type, links by containment) is DataFrame work. A record is one row of the input, so a task never holds more than one record's objects.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Members that are lists by contract: a lone object in place of the list is position 0, and a string that holds a JSON list is that list.
LIST_MEMBERS = ("cases", "citations", "spans", "warnings", "locations", "attempts", "prior_messages")

NODE_SCHEMA = "table_name string, root_key string, kind string, node_path string, position int, depth int, pre int, post int, body string"


def _not_json(token: str) -> None:
    raise ValueError(token)


def _loads(text: str):
    return json.loads(text, parse_constant=_not_json)


def _as_list(value):
    """The members of a value that is a list by contract, else None."""
    if isinstance(value, str):
        if not value.lstrip().startswith("["):
            return None
        try:
            value = _loads(value)
        except (ValueError, RecursionError):
            return None
    if isinstance(value, dict):
        return [value]
    return value if isinstance(value, list) else None


LISTED, LONE, VALUE = "listed", "lone", "value"


def walk(column: str, text: str | None, lists: frozenset[str], every: bool = False) -> list[tuple]:
    """(kind, node_path, position, depth, pre, post, node, role) of each labelled node in `text`, in pre-order.

    Listed objects are labelled (role `listed`); with `every`, lone objects (`lone`) and the scalar members of lists (`value`, also a list in a list without members) too. kind is the
    name of the member that holds the node or its list. depth counts labelled nodes above it; labels count from 0. The stack is explicit, so
    nesting is bounded by the JSON reader alone. Null, blank or invalid text holds no node.
    """
    if text is None or not text.strip():
        return []
    try:
        root = _loads(text)
    except (ValueError, RecursionError):
        return []
    out: list[list] = []
    post = 0
    # entries: (value, path, name of the member, position or None, depth, node index to close or None)
    stack: list[tuple] = [(root, column, column, None, 0, None)]
    while stack:
        value, path, name, position, depth, close = stack.pop()
        if close is not None:
            out[close][5] = post
            post += 1
            continue
        members = value if position is not None and isinstance(value, list) else _as_list(value) if position is None and name in lists else value if isinstance(value, list) else None
        if members == [] and position is not None and every:
            out.append([name, path, position, depth, len(out), post, value, VALUE])
            post += 1
        elif members is not None:
            stack.extend((m, f"{path}[{i}]", name, i, depth, None) for i, m in reversed(list(enumerate(members))) if every or isinstance(m, (dict, list)))
        elif isinstance(value, dict):
            inner = depth
            if position is not None or (every and path != column):
                out.append([name, path, position, depth, len(out), -1, value, LONE if position is None else LISTED])
                stack.append((None, "", "", None, 0, len(out) - 1))
                inner = depth + 1
            for k, v in reversed(list(value.items())):
                if isinstance(v, (dict, list)) or (k in lists and isinstance(v, str)):
                    stack.append((v, f"{path}.{k}", k, None, inner, None))
        elif position is not None:
            out.append([name, path, position, depth, len(out), post, value, VALUE])
            post += 1
    return [tuple(x) for x in out]


def _scalars(value: dict, lists: frozenset[str]) -> str:
    """An object's members that have no node of their own, as JSON: scalars, and lists without members."""
    own = {k: v for k, v in value.items() if not isinstance(v, (dict, list)) and not (k in lists and _as_list(v))}
    own |= {k: [] for k, v in value.items() if (k in lists or isinstance(v, list)) and _as_list(v) == []}
    return json.dumps(own, ensure_ascii=False, separators=(",", ":"))


def _own(value: dict, lists: frozenset[str]) -> str:
    """All of an object but the listed objects in it, which have rows of their own, as JSON.

    Scalars, lone objects and lists of scalars are kept; a list of listed objects alone is left out, and in a mixed list they are null.
    """
    top: dict = {}
    stack: list[tuple] = [(value, top)]
    while stack:
        source, target = stack.pop()
        if isinstance(source, dict):
            for k, v in source.items():
                if isinstance(v, dict):
                    if k not in lists:
                        target[k] = {}
                        stack.append((v, target[k]))
                elif isinstance(v, list):
                    if not v or not all(isinstance(m, dict) for m in v):
                        target[k] = []
                        stack.append((v, target[k]))
                else:
                    target[k] = v
        else:
            for m in source:
                target.append([] if isinstance(m, list) else None if isinstance(m, dict) else m)
                if isinstance(m, list):
                    stack.append((m, target[-1]))
    return json.dumps(top, ensure_ascii=False, separators=(",", ":"))


def label_nodes(records: DataFrame, table_name: str, root_key: str, column: str, *, bodies: bool = True, list_members: Sequence[str] = LIST_MEMBERS, every: bool = False) -> DataFrame:
    """One labelled row per listed object in `records[column]` (JSON text, or an array / struct column); with `every`, one per node.

    Columns: NODE_SCHEMA, and with `every` role (listed, lone or value). `body` holds all of a listed object but the listed objects in it, as
    JSON; with `every` what has no node of its own: an object's scalars and empty lists, or the scalar itself, so that a record can be put
    together again from its rows. It is null when bodies=False. Records must be one per key. Null keys are kept as null. Columns of `records`
    other than the two named are ignored, so clashing names do no harm.
    """
    lists = frozenset(list_members)
    is_text = dict(records.dtypes)[column] == "string"
    doc = F.col(column) if is_text else F.to_json(F.col(column))
    source = records.select(F.col(root_key).cast("string").alias("root_key"), doc.alias("doc")).filter(F.col("doc").isNotNull())
    schema = NODE_SCHEMA + (", role string" if every else "")
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()] + [pa.string()] * every
    names = [f.split()[0] for f in schema.split(", ")]

    def body(value, role: str) -> str | None:
        if not bodies:
            return None
        if role == VALUE:
            return json.dumps(value, ensure_ascii=False)
        return _scalars(value, lists) if every else _own(value, lists)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, path, position, depth, pre, post, value, role in walk(column, text, lists, every):
                    rows.append((table_name, key, kind, path, position, depth, pre, post, body(value, role)) + ((role,) if every else ()))
                if len(rows) >= 20_000:
                    yield _batch(rows, names, types)
                    rows = []
            if rows:
                yield _batch(rows, names, types)

    return source.mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def link_by_containment(nodes: DataFrame) -> DataFrame:
    """Adds parent_kind, parent_path, parent_pre, parent_post of the innermost labelled object that holds each row (null for the outermost).

    Intervals nest or are disjoint, so only the last node of depth d - 1 opened before a node of depth d in pre-order can hold it; it does so if
    its post-order number is the greater one, which is tested. Each node enters the window of its own level as a holder and that of the level above as a held row; one window per record and level links
    them, with no join and no pairs of nodes, and a huge record is spread over its levels.
    """
    role = F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("held")), F.struct((F.col("depth") - 1).alias("level"), F.lit(True).alias("held"))))
    w = Window.partitionBy("table_name", "root_key", "level").orderBy("pre", "held").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = nodes.withColumn("_r", role).select(*nodes.columns, "_r.level", "_r.held")
    holder = F.last(F.when(~F.col("held"), F.struct("kind", "node_path", "pre", "post")), ignorenulls=True).over(w)
    linked = both.withColumn("_h", holder).filter("held").withColumn("_h", F.when(F.col("_h.post") > F.col("post"), F.col("_h")))
    return linked.select(*nodes.columns, *[F.col(f"_h.{a}").alias(b) for a, b in (("kind", "parent_kind"), ("node_path", "parent_path"), ("pre", "parent_pre"), ("post", "parent_post"))])


def flat_table(linked: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    """The flat table of one kind of object: keys of the record and of the holder, then `fields` (name -> type) read from its members,
    and `members`, all of the object but the listed objects in it, as JSON. A member that is missing, null or not of the type is null.
    """
    body = F.col("_b")
    typed = linked.filter(F.col("kind") == kind).withColumn("_b", F.try_parse_json("body"))
    keys = ["table_name", "root_key", "node_path", "position", "pre", "post", "parent_kind", "parent_path"]
    return typed.select(*keys, *[F.try_variant_get(body, f"$.{name}", as_type).alias(name) for name, as_type in fields.items()], F.col("body").alias("members"))
