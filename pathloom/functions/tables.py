"""Table helpers: cutting lineage, and order-based functions without a single-partition window."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or else one in the warehouse: both are seen by driver and executors.

    Raises on a cluster if neither is set: the warehouse's default is a folder of each machine's own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") and not spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
        raise ValueError("on a cluster, set spark.checkpoint.dir to a folder that all machines share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/pathloom-tables"


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one, which release() deletes."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has written down on its way, once its results are stored elsewhere."""
    delete_path(spark, own_dir(spark))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, lineage cut, safe if executors are lost.
    What a loop replaces it discards; the rest stays until release().  No marker of success is written, as nobody looks for it:
    on a local file system the driver starts two processes for one, and each counts the driver's memory once more while it starts."""
    path = f"{own_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pathloom_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more, as between the rounds of a loop."""
    if path := getattr(df, "_pathloom_path", None):
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def global_lead(df: DataFrame, order: list[str], value: str, bucket: Column, name: str) -> DataFrame:
    """The next row's value in a global order.

    `bucket` must not decrease along the order.  Rows look ahead within their bucket; a bucket's last row takes the first
    value of the next bucket, found in a table of one row a bucket.  So only that table is ordered in one place.
    """
    b = df.withColumn("_b", bucket)
    inner = F.lead(F.struct(value)).over(Window.partitionBy("_b").orderBy(*order))
    heads = b.groupBy("_b").agg(F.min_by(value, F.struct(*order)).alias("_h"))
    nexts = heads.select(F.col("_b").alias("_b2"), F.lead("_h").over(Window.orderBy("_b")).alias("_next"))
    joined = b.withColumn("_in", inner).join(nexts, F.col("_b") == F.col("_b2"))
    return joined.withColumn(name, F.when(F.col("_in").isNotNull(), F.col(f"_in.{value}")).otherwise(F.col("_next"))).drop("_b", "_b2", "_in", "_next")


def global_rank(df: DataFrame, order: list[str], bucket: Column, name: str) -> DataFrame:
    """0-based place in a global order, with the same bucket rule: counts of buckets are summed up, rows number within."""
    b = df.withColumn("_b", bucket)
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(F.col("_b").alias("_b2"), (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_o"))
    at = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return b.withColumn("_r", at).join(offsets, F.col("_b") == F.col("_b2")).withColumn(name, (F.col("_r") + F.col("_o")).cast("long")).drop("_b", "_b2", "_r", "_o")


def global_sum(df: DataFrame, order: list[str], value: Column, bucket: Column, name: str) -> DataFrame:
    """The running sum of a value up to and with each row of a global order, with the same bucket rule."""
    b = df.withColumn("_b", bucket).withColumn("_x", value)
    sums = b.groupBy("_b").agg(F.sum("_x").alias("_n"))
    offsets = sums.select(F.col("_b").alias("_b2"), (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_o"))
    within = F.sum("_x").over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("_r", within).join(offsets, F.col("_b") == F.col("_b2")).withColumn(name, (F.col("_r") + F.col("_o")).cast("long")).drop("_b", "_b2", "_x", "_r", "_o")


def range_sum(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """The running sum of a value up to and with each row of a global order of any columns.

    Rows are dealt by ranges of the order, which Spark samples, so equal first columns are split by the next ones; each range
    is summed apart and moved up by the sums of the ranges before it, of which there are as many as partitions.
    """
    b = materialise(df.withColumn("_x", value).repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "ranges")
    sums = b.groupBy("_b").agg(F.sum("_x").alias("_n"))
    offsets = sums.select(F.col("_b").alias("_b2"), F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    within = F.sum("_x").over(Window.partitionBy("_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("_r", within).join(F.broadcast(offsets), F.col("_b") == F.col("_b2")).withColumn(name, F.col("_r") + F.col("_o")).drop("_b", "_b2", "_x", "_r", "_o")
