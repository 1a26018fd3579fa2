"""Tables written once and read many times: bucketed by a key, so that joins and groups on it need no exchange."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or of the context; a temporary one only with a local master, as in tests."""
    if found := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def bucketed(df: DataFrame, by: str, order: tuple[str, ...] = (), buckets: int | None = None, name: str = "rows") -> DataFrame:
    """df as a table in the shared folder, in as many buckets of `by` as there are shuffle partitions (or `buckets`), each in order.

    Tables of one key and number of buckets are joined and grouped where they lie. The shuffle before the write gives each
    bucket one file. The tables stay in the shared folder until whoever owns it clears it.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{table}"
    df.repartition(n, by).write.format("parquet").bucketBy(n, by).sortBy(by, *order).option("path", path).saveAsTable(table)
    return spark.table(table)
