"""Schemas that drift between files: a column lifespan catalogue, its changes, and one consistent table.

The catalogue is metadata (rows per file, field and type); the lines are read once, pre-aggregated in the map tasks, and never regrouped
whole. Windows run over the catalogue only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.operators.dedup import one_per_key


@dataclass(frozen=True)
class Field:
    """A field of the consistent table: its type, and each name it goes by with the factor to its own unit."""

    name: str
    as_type: str
    aliases: dict[str, float]


#: The known fields and the names they are carried under, with the factor to the field's own unit.
ALIASES: tuple[Field, ...] = (
    Field("run_id", "string", dict.fromkeys(("run_id", "runId", "RunID", "runID", "meta.run_id", "meta.runId", "eval_run_id", "evalRunId", "run_identifier", "runIdentifier", "run.id", "run"), 1.0)),
    Field("case_count", "bigint", dict.fromkeys(("case_count", "caseCount", "num_cases", "numCases", "n_cases", "cases_total", "summary.case_count"), 1.0)),
    Field(
        "latency_ms",
        "double",
        dict.fromkeys(("latency_ms", "latencyMs", "latency", "latency_millis", "latencyMillis", "elapsed_ms", "elapsedMs", "duration_ms", "durationMs", "total_latency_ms", "totalLatencyMs", "timing.latency_ms", "timing.total_ms", "timing.latencyMs", "metrics.latency_ms"), 1.0)
        | dict.fromkeys(("latency_s", "latencyS", "latency_sec", "latency_seconds", "elapsed_s", "duration_s", "timing.latency_s"), 1000.0)
        | dict.fromkeys(("latency_us", "elapsed_us"), 0.001),
    ),
    Field(
        "cost_usd",
        "double",
        dict.fromkeys(("cost_usd", "costUsd", "costUSD", "cost", "usd_cost", "usdCost", "total_cost_usd", "totalCostUsd", "usage.cost_usd", "usage.costUsd", "billing.cost_usd", "metrics.cost_usd"), 1.0)
        | dict.fromkeys(("cost_cents", "costCents"), 0.01)
        | dict.fromkeys(("cost_milli_usd",), 0.001)
        | dict.fromkeys(("cost_micro_usd", "costMicroUsd", "cost_micros"), 0.000001),
    ),
    Field("total_tokens", "bigint", dict.fromkeys(("total_tokens", "totalTokens", "tokens_total", "tokensTotal", "tokens", "token_count", "usage.total_tokens", "usage.totalTokens"), 1.0)),
    Field("legal_family", "string", dict.fromkeys(("legal_family", "legalFamily", "family", "question_family", "questionFamily", "query_family", "meta.legal_family"), 1.0)),
    Field("model_version", "string", dict.fromkeys(("model_version", "modelVersion", "model", "model_name", "modelName", "meta.model_version", "versions.model"), 1.0)),
)


def unique_lines(raw: DataFrame) -> DataFrame:
    """One row per (file_name, line_no), the first written."""
    return one_per_key(raw, ["file_name", "line_no"], ["written_at"], ["stream_name", "file_name", "file_seq", "line_no", "record_kind", "body"])


def _parsed(body: Column) -> Column:
    """The line as a variant; null if it isn't valid JSON as a whole."""
    text = F.trim(body)
    whole = ((F.left(text, F.lit(1)) == "{") & (F.right(text, F.lit(1)) == "}")) | ~F.left(text, F.lit(1)).isin("{", "[")
    return F.when(whole, F.try_parse_json(text))


def nesting(lines: DataFrame) -> int:
    """How deep objects are nested in the lines, at most: one plain aggregate over the texts, which may name some levels too many."""
    braces = F.regexp_extract_all("body", F.lit(r"[{}]"), F.lit(0))
    step = F.struct(F.lit(0).alias("at"), F.lit(0).alias("top"))

    def count(state: Column, brace: Column) -> Column:
        at = state["at"] + F.when(brace == "{", 1).otherwise(-1)
        return F.struct(at.alias("at"), F.greatest(state["top"], at).alias("top"))

    opened = F.length("body") - F.length(F.replace("body", F.lit("{")))
    return lines.agg(F.max(F.when(opened <= 3, opened).otherwise(F.aggregate(braces, step, count)["top"]))).first()[0] or 0


def line_fields(lines: DataFrame, depth: int) -> DataFrame:
    """One row per line and (nested) member: stream_name, file_name, file_seq, name, kind, valid, first.

    kind is integer, decimal, string, boolean, null or other. Members of nested objects are named `outer.inner`, down to `depth` names (see
    `nesting`: the deepest line sets it, so that no member is left out). A line without members, and one that isn't valid JSON, keep one row with a null name; `first` marks one row per line.
    """
    df = lines.select("stream_name", "file_name", "file_seq", _parsed(F.col("body")).alias("v")).withColumn("valid", F.col("v").isNotNull())
    df = df.withColumns({"name": F.lit(None).cast("string"), "first": F.lit(True)})
    for _ in range(depth):
        inner = F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v"))
        # a leaf, and an object without members, stay as they are: the outer explode keeps their row
        df = df.withColumn("o", inner.cast("map<string,variant>"))
        df = df.select("*", F.posexplode_outer("o").alias("pos", "key", "value"))
        df = df.select(
            "stream_name", "file_name", "file_seq", "valid",
            F.when(F.col("key").isNull(), F.col("name")).otherwise(F.concat_ws(".", "name", "key")).alias("name"),
            F.when(F.col("o").isNotNull(), F.col("value")).otherwise(F.col("v")).alias("v"),
            (F.col("first") & (F.coalesce("pos", F.lit(0)) == 0)).alias("first"),
        )
    written = F.schema_of_variant("v")
    kind = (
        F.when(written == "BIGINT", "integer")
        .when(written.startswith("DECIMAL") | written.isin("DOUBLE", "FLOAT"), "decimal")
        .when(written == "STRING", "string")
        .when(written == "BOOLEAN", "boolean")
        .when(F.col("v").isNull() | (written == "VOID"), "null")
        .otherwise("other")
    )
    return df.select("stream_name", "file_name", "file_seq", "name", kind.alias("kind"), "valid", "first")


def catalogue(raw: DataFrame, share: float = 0.5) -> DataFrame:
    """The carried fields per file: stream_name, file_name, file_seq, ordinal, last_ordinal, field, name, kind (null where a file carries none).

    A file carries a field under a name and type if more than `share` of its valid lines hold a non-null value of both. ordinal numbers the
    files of a stream by file_seq, then name.
    """
    counted = line_fields(unique_lines(raw), max(nesting(raw), 1)).groupBy("stream_name", "file_name", "file_seq", "name", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("valid") & F.col("first")).alias("lines"))
    per_file = Window.partitionBy("stream_name", "file_name", "file_seq")
    seen = counted.withColumn("lines", F.sum("lines").over(per_file))
    real = F.col("name").isNotNull() & ~F.col("kind").isin("null", "other")
    carried = real & (F.col("n") > share * F.col("lines"))
    lists = seen.groupBy("stream_name", "file_name", "file_seq").agg(F.collect_list(F.when(carried, F.struct("name", "kind"))).alias("carried"))
    in_stream = Window.partitionBy("stream_name")
    lists = lists.withColumns({"ordinal": F.row_number().over(in_stream.orderBy("file_seq", "file_name")), "last_ordinal": F.count("*").over(in_stream)})
    flat = lists.select("stream_name", "file_name", "file_seq", "ordinal", "last_ordinal", F.explode_outer("carried").alias("c"))
    return flat.select("stream_name", "file_name", "file_seq", "ordinal", "last_ordinal", _field(F.col("c.name")).alias("field"), F.col("c.name").alias("name"), F.col("c.kind").alias("kind"))


def _field(name: Column) -> Column:
    """The field that a name belongs to: its own, by the alias table, or the name itself."""
    known = F.create_map(*[F.lit(x) for f in ALIASES for alias in f.aliases for x in (alias, f.name)])
    return F.coalesce(F.try_element_at(known, name), name)


def lifespans(carried: DataFrame) -> DataFrame:
    """Islands of consecutive files that carry a field under one name and type: first and last ordinal, file and whether the stream goes on."""
    key = ["stream_name", "field", "name", "kind"]
    w = Window.partitionBy(*key).orderBy("ordinal")
    marked = carried.filter("field IS NOT NULL").withColumn("starts", (F.coalesce(F.lag("ordinal").over(w), F.lit(-1)) != F.col("ordinal") - 1).cast("int"))
    islands = marked.withColumn("island", F.sum("starts").over(w))
    return islands.groupBy(*key, "island", "last_ordinal").agg(F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


def changes(carried: DataFrame) -> DataFrame:
    """One row per change of a file against the previous file of its stream: file_name, field_name, change_kind, old and new names and types.

    Built from the log of lifespan starts and endings: an ending that leaves the field uncarried is `removed`, a start of an uncarried field
    `added`; where the field goes on, a set of names (types) with nothing in common with the old one is `renamed` (`retyped`).
    """
    spans = lifespans(carried)
    files = carried.select("stream_name", "ordinal", "file_name").distinct()
    starts = spans.filter("first > 1").select("stream_name", "field", F.col("first").alias("ordinal"))
    ends = spans.filter("last < last_ordinal").select("stream_name", "field", (F.col("last") + 1).alias("ordinal"))
    log = starts.union(ends).distinct()
    # the state before and after each logged point, from the carried rows of the two files
    here = carried.filter("field IS NOT NULL").select("stream_name", "field", "name", "kind", F.explode(F.array(F.struct(F.col("ordinal").alias("at"), F.lit(False).alias("old")), F.struct((F.col("ordinal") + 1).alias("at"), F.lit(True).alias("old")))).alias("x"))
    state = here.groupBy("stream_name", "field", F.col("x.at").alias("ordinal")).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("x.old") == old, F.col(c)))).alias(f"{'old' if old else 'new'}_{c}s") for old in (True, False) for c in ("name", "kind")]
    )
    at = log.join(state, ["stream_name", "field", "ordinal"]).join(files, ["stream_name", "ordinal"])
    had, has = F.size("old_names") > 0, F.size("new_names") > 0
    kinds = F.array_compact(
        F.array(
            F.when(~had & has, "added"),
            F.when(had & ~has, "removed"),
            F.when(had & has & ~F.arrays_overlap("old_names", "new_names"), "renamed"),
            F.when(had & has & ~F.arrays_overlap("old_kinds", "new_kinds"), "retyped"),
        )
    )
    return at.select("stream_name", "file_name", F.col("field").alias("field_name"), F.explode(kinds).alias("change_kind"), "old_names", "new_names", "old_kinds", "new_kinds")


def _number(value: Column) -> Column:
    """A number from a value's text: units and currency signs around one number are dropped; anything else is null."""
    text = F.regexp_extract(value, r"^\s*(?:USD|\$)?\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\s*(?:ms|s|USD|usd|tokens)?\s*$", 1)
    return text.try_cast("double")


#: Names that alias paths go through: objects under them lose their aliased members only.
_OUTER = tuple(sorted({a.split(".")[0] for f in ALIASES for a in f.aliases if "." in a}))


def consistent_table(raw: DataFrame) -> DataFrame:
    """Every valid line in one schema: the keys, the known fields under one name, type and unit, and all other members as JSON.

    Casts come from the alias table: the first alias, in its order, with a value that the type takes. A field's other aliases, and values that
    its type doesn't take, stay among the other members. Lines that aren't valid JSON have null fields and valid = false; blank texts in
    string fields become null.
    """
    df = unique_lines(raw).withColumn("v", _parsed(F.col("body")))
    columns, used = [], []
    for f in ALIASES:
        each = []
        for a, factor in f.aliases.items():
            text = F.try_variant_get("v", f"$.{a}", "string")
            if f.as_type == "string":
                # an object under the name of a text is no value of it
                value = F.when(~F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{a}", "variant")).startswith("OBJECT"), F.lit(False)), F.nullif(F.trim(text), F.lit("")))
            else:
                value = _number(text) * factor if factor != 1.0 else _number(text)
            each.append(F.when(value.isNotNull(), F.struct(F.lit(a).alias("name"), value.alias("value"))))
        df = df.withColumn(f"_{f.name}", F.coalesce(*each))
        value = F.col(f"_{f.name}.value")
        columns.append((value if f.as_type == "string" else value.try_cast("bigint") if f.as_type == "bigint" else F.round(value, 9)).alias(f.name))
        used.append(F.col(f"_{f.name}.name"))
    df = df.withColumn("_used", F.array_compact(F.array(*used)))
    taken = lambda name: F.array_contains("_used", name)
    strings = "map<string,string>"
    members = F.from_json(F.when(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"), F.to_json("v")), strings)
    inner = lambda k, x: F.to_json(F.map_filter(F.from_json(x, strings), lambda i, _: ~taken(F.concat_ws(".", k, i))))
    nested = lambda k, x: k.isin(*_OUTER) & F.startswith(F.coalesce(x, F.lit("")), F.lit("{"))
    rest = F.transform_values(F.map_filter(members, lambda k, _: ~taken(k)), lambda k, x: F.when(nested(k, x), inner(k, x)).otherwise(x))
    rest = F.map_filter(rest, lambda k, x: ~(k.isin(*_OUTER) & F.coalesce(x == "{}", F.lit(False))))
    return df.select("stream_name", "file_name", "file_seq", "line_no", "record_kind", F.col("v").isNotNull().alias("valid"), *columns, F.to_json(rest).alias("other_fields"))
