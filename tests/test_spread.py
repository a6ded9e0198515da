"""Work that is heavy per row is spread over the session's cores."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lexforge.session import spread


def test_table_of_one_row_group_is_spread(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    pq.write_table(pa.table({"id": list(range(20000)), "text": [f"text {i * 7919 % 20011}" for i in range(20000)]}), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = spark.read.parquet(path)
        assert df.rdd.getNumPartitions() >= 4  # splits, of which one holds the row group
        got = spread(df)
        assert got.groupBy(F.spark_partition_id()).count().count() >= 4
        assert got.agg(F.count("*"), F.sum("id")).first()[:] == (20000, 199990000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
