"""Streaming telemetry: duplicates dropped within a watermark, windows over event time, batch-wise upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.analytics import or_unknown
from lexforge.operators.stores import upsert
from lexforge.session import release, shared_dir


def read_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """A table's files as a stream. The path is given as a pattern, since a stream takes a single file by pattern only."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{name}.parque[t]")


def family_windows(requests: DataFrame, window: str = "1 day", lateness: str = "60 days") -> DataFrame:
    """Requests, failures and tokens per window and family, each request once. Rows later than `lateness` behind the newest are dropped."""
    once = requests.withWatermark("recorded_at", lateness).dropDuplicates(["request_id", "recorded_at"])
    keyed = once.withColumn("family", or_unknown(F.col("legal_family")))
    grouped = keyed.groupBy(F.window("recorded_at", window).alias("w"), "family").agg(F.count("*").alias("requests"), F.sum(F.coalesce("insufficient_answer", F.lit(0))).alias("insufficient"), F.sum(F.coalesce("total_tokens", F.lit(0))).cast("bigint").alias("total_tokens"))
    return grouped.select(F.col("w.start").alias("window_start"), "family", "requests", "insufficient", "total_tokens")


def run_to_table(stream: DataFrame, mode: str = "complete", keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over what is there now, into a new table of the shared folder, and reads the table.

    In mode `update` each batch adds the rows it changed, and the last row per `keys` is read; late rows are dropped and state ends with the
    watermark. In mode `complete` all windows stay in the state and no row is late.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{_ddl(stream)}, _batch int").parquet(f"{base}/out")
    if mode != "update":
        return rows.drop("_batch")
    rest = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*").select(stream.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _versions(spark: SparkSession, base: str) -> list[int]:
    """The finished versions of a store, oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS")))


def upsert_stream(stream: DataFrame, keys: list[str], order: str, base: str | None = None) -> DataFrame:
    """Keeps the latest row per key of a stream in a table of the shared folder (a new version a batch), and reads the last version.

    `base` is the store's folder; a run with the folder of an earlier one goes on after its last batch. All state is in the folder: a batch
    that is repeated starts from the version before it, and versions older than that one are deleted.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"

    def version(n: int) -> DataFrame:
        return spark.read.schema(stream.schema).parquet(f"{base}/v{n}")

    def write(batch: DataFrame, number: int) -> None:
        known = [n for n in _versions(spark, base) if n < number]
        old = version(known[-1]) if known else batch.limit(0)
        upsert(old, batch, keys, order).write.mode("overwrite").parquet(f"{base}/v{number}")
        for n in known[:-1]:
            release(version(n))

    query = stream.writeStream.outputMode("append").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    known = _versions(spark, base)
    return version(known[-1]) if known else spark.createDataFrame([], stream.schema)
