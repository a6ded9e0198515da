"""JSON sources and sinks: strict case files, tolerant run files and record stores, append-only feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexforge.operators.analytics import parsed


def read_cases(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, strictly: a malformed line fails the read. Adds _dataset_file; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("_dataset_file", F.col("_metadata.file_path"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One row per readable run file (a JSON object), oldest first: source_path, run_order, run_id, generated_at, runner, cases, body.

    Files that aren't a JSON object are skipped. Runs without a time come first; ties go by path. run_id falls back to the time, then the
    file's name.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), parsed(F.col("value")).alias("v"))
    runs = files.filter(F.schema_of_variant("v").startswith("OBJECT"))
    got = lambda p: F.nullif(F.trim(F.try_variant_get("v", p, "string")), F.lit(""))
    time = F.try_to_timestamp(got("$.generated_at_utc"))
    rows = runs.select(
        "source_path", F.coalesce(got("$.run_id"), got("$.generated_at_utc"), F.regexp_extract("source_path", r"([^/]+?)(?:\.json)?$", 1)).alias("run_id"), time.alias("generated_at"),
        got("$.runner").alias("runner"), F.to_json(F.try_variant_get("v", "$.cases", "variant")).alias("cases"), F.to_json("v").alias("body"),
    )
    # the one window over all runs sees a time and a path a run; bodies are joined back by path and go through no single task
    order = rows.select("source_path", "generated_at").withColumn("run_order", F.row_number().over(Window.orderBy(F.asc_nulls_first("generated_at"), "source_path")))
    return rows.join(order.select("source_path", "run_order"), "source_path")


def read_trace_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs of `read_runs` that hold a case: a list with an object in it, or a lone object in its place."""
    v = F.try_parse_json("cases")
    listed = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.array(v)).when(F.schema_of_variant(v).startswith("ARRAY"), v.cast("array<variant>"))
    return read_runs(spark, path).filter(F.exists(listed, lambda c: F.schema_of_variant(c).startswith("OBJECT")))


def newest(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The most recently written file of a folder, as one row (source_path, body). With `strict` a file that is no JSON object fails the read."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_modification_time").alias("at"), "value")
    last = files.agg(F.max_by(F.struct("source_path", F.col("value").alias("body")), F.struct("at", "source_path")).alias("r")).select("r.*")
    if not strict:
        return last
    whole = F.coalesce(F.schema_of_variant(parsed(F.col("body"))).startswith("OBJECT"), F.lit(False))
    return last.withColumn("body", F.when(whole, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.col("source_path"))).cast("string")))


def write_artifact(df: DataFrame, path: str) -> None:
    """Writes each row as one JSON object a line, nulls included: nested columns keep their form."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("error").text(path)


def read_store(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A record store kept as JSON lines: the last line of each key wins; unreadable lines and lines without a key are dropped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = lines.select(F.try_variant_get(parsed(F.col("value")), f"$.{key}", "string").alias(key), "value", "file", "at").filter(F.length(key) > 0)
    return rows.groupBy(key).agg(F.max_by("value", F.struct("file", "at")).alias("body"))


def append_lines(df: DataFrame, path: str) -> None:
    """Appends a table to a feed of JSON lines."""
    df.write.mode("append").json(path)
