"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathloom.functions.tables import discard, materialise, shared_dir

__all__ = ["bind", "bounded", "byte_texts", "discard", "fold_out", "give_back", "hot_join", "materialise", "running_starts", "salted_rank", "shared_dir", "small_batches"]


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once: a lambda would work a plain expression out again at each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold_out(items: Column, state: Column, empty: Column, step: Callable[[Column, Column], tuple[Column, Column]], chunk: int = 256) -> Column:
    """What a fold over an array emits: step(state, item) gives (next state, array of what to emit); empty is an array of none.

    Appending to an array copies it, so what is emitted is gathered by chunks of items, and the chunks are joined at the end: the work
    is the length times the chunk's, not the square of the length.
    """

    def part(of: Column, a: Column, c: Column) -> Column:
        def one(b: Column, x: Column) -> Column:
            after, made = step(b["state"], x)
            return F.struct(after.alias("state"), F.concat(b["out"], made).alias("out"))

        done = F.aggregate(F.slice(of, c * chunk + 1, F.lit(chunk)), F.struct(a["state"].alias("state"), empty.alias("out")), one)
        return bind(done, lambda x: F.struct(x["state"].alias("state"), F.concat(a["outs"], F.array(x["out"])).alias("outs")))

    def whole(of: Column) -> Column:
        start = F.struct(state.alias("state"), F.slice(F.array(empty), F.lit(1), F.lit(0)).alias("outs"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(of) - 1) / chunk).cast("int")), start, lambda a, c: part(of, a, c), lambda a: F.flatten(a["outs"]))

    return bind(items, lambda of: F.when(F.size(of) > 0, whole(of)).otherwise(empty))


def running_starts(lengths: Column) -> Column:
    """The sums of the lengths before each element of an array of whole numbers."""
    none = F.expr("cast(array() as array<bigint>)")
    return fold_out(lengths, F.lit(0).cast("long"), none, lambda at, n: ((at + n).cast("long"), F.array(at)))


def byte_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of a string column, without decoding; null becomes empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def bounded(docs: DataFrame, most: str = "4m") -> DataFrame:
    """docs, after a session whose Arrow batches have Spark's own bound of bytes has got `most`: a batch of 10,000 texts is
    otherwise as large as they are, in the JVM, in the worker and between them.  A bound set by the user stays."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name).rstrip("b") == str(64 << 20):
        conf.set(name, most)
    return docs


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches, so that only `rows` texts at a time stand beside the batch as Python objects.

    When the task's batches are used up, what Arrow and the C library hold of freed memory goes back: a worker serves many
    tasks of many queries, and its executor counts what it keeps.
    """
    for b in batches:
        for at in range(0, b.num_rows or 1, rows):
            yield b.slice(at, rows)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def hot_join(rows: DataFrame, named: DataFrame, on: Column, total: int, how: str = "left", parts: int = 1000) -> DataFrame:
    """rows joined (left or inner) to named, which has one row a key and the key's number n of rows; n goes.

    Keys with over a `parts`th of all `total` rows, which are fewer than `parts`, are broadcast, so their rows stay where they
    are; the others meet by a shuffle, whose largest key is no longer hot, and never by broadcast: their number follows the rows.
    """
    hot = F.broadcast(named.where(F.col("n") > total / parts))
    rest = named.where(F.col("n") <= total / parts).hint("merge")
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(rest, on, how)).drop("n")


def salted_rank(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, name: str) -> DataFrame:
    """Add `name`: 0-based row number within keys, ordered by (bucket, order).

    A key is numbered bucket by bucket and the buckets are offset by running counts, so a key that holds a third of all
    rows is spread over its buckets.  Null keys equal each other.  Keys become one plain string, so the rows are shuffled
    once: the offsets meet them where the numbering has put them.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("-")) for k in keys])
    rows = df.withColumn("_pl_key", text).withColumn("_pl_bucket", bucket)
    sizes = rows.groupBy("_pl_key", "_pl_bucket").agg(F.count(F.lit(1)).alias("_pl_n"))
    before = Window.partitionBy("_pl_key").orderBy("_pl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pl_key", "_pl_bucket", F.coalesce(F.sum("_pl_n").over(before), F.lit(0)).alias("_pl_base"))
    within = F.row_number().over(Window.partitionBy("_pl_key", "_pl_bucket").orderBy(*order)) - 1
    joined = rows.withColumn("_pl_r", within).join(offsets, ["_pl_key", "_pl_bucket"])
    return joined.withColumn(name, (F.col("_pl_r") + F.col("_pl_base")).cast("long")).drop("_pl_key", "_pl_bucket", "_pl_base", "_pl_r")
