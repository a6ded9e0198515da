"""Session helpers: sane defaults for local runs, and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lexforge") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it.

    Only a local session (one machine) may do without: a temporary folder takes its place. On a cluster an unset folder is an error, since a
    machine's own disk would hold a part of each result.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lexforge-shared-")


#: Splits a core beyond which a table's row groups are taken to be enough.
FAR_MORE = 64


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks with rows as the session has cores: only a table of fewer (a small one, or one of few row groups) is repartitioned.

    For work that is heavy per row; at scale a table has far more splits and is left as it is, without a shuffle. A row group is read by one task,
    however many splits it spans; how many tasks have rows is counted from the files' footers, unless the splits are far more than the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = df.rdd.getNumPartitions()
    if tasks < cores:
        return df.repartition(cores)
    few = tasks < FAR_MORE * cores and df.select(F.spark_partition_id()).distinct().count() < cores
    return df.repartition(cores, df.columns[0]) if few else df  # by the key: no task has to sort a whole row group


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends here and later stages survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(written: DataFrame) -> None:
    """Deletes what `cut` wrote, for loops that write anew each round: nothing may read it any more."""
    spark = written.sparkSession
    for file in written.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
