"""Ordered text: lines numbered in the order of files, and files written in ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of a file, or of a folder's files by name, numbered from 0.

    Spark reads files in splits and plans splits by size, so the order of its partitions is not that of the lines.  A line's number is its
    place in its split plus the lines of the splits before, which are counted in a table of one row a split; lines don't move.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = raw.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("_file").alias("_f2"), F.col("_start").alias("_s2"), "_first", before.alias("_before"))
    rows = raw.join(splits, (F.col("_file") == F.col("_f2")) & (F.col("_start") == F.col("_s2")))
    return rows.select((F.col("_before") + F.col("_id") - F.col("_first")).alias("n"), "value")


def write_lines(lines: DataFrame, order: list[str | Column], path: str, parts: int | None = None) -> None:
    """Writes `value` of all rows in an order, as files whose names follow it; `parts` of them, or as many as Spark sees fit.

    Rows are dealt by ranges of the order and sorted in each, so no task has them all.
    """
    ranged = lines.repartitionByRange(parts, *order) if parts else lines.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).select("value").write.text(path)
