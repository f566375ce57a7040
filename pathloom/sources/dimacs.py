"""DIMACS graphs and coordinates as DataFrames, and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathloom.functions.scalar import clamp_weight
from pathloom.sources.text import numbered_lines, write_lines


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a text or gzip file, or of a folder of them, numbered in order."""
    return numbered_lines(spark, path).withColumnRenamed("value", "line")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """edges(edge_id, src, dst, weight), ids from 0; lines that don't fit `a U V W` are skipped.

    The last `p sp N M` line counts and arcs before it are dropped.  Raises when it is missing or N is 0, and for vertices
    outside 1..N.
    """
    lines = _lines(spark, path)
    head = lines.where(F.col("line").rlike(r"^p sp \d+ \d+")).select("n", F.split("line", r"\s+")[2].cast("long").alias("size")).orderBy(F.desc("n")).first()
    if head is None or not head["size"]:
        raise ValueError("no vertices declared")
    got = F.regexp_extract("line", r"^a\s+(\d+)\s+(\d+)\s+(\d+)", 1) != ""
    part = F.split("line", r"\s+")
    arcs = lines.where((F.col("n") > head["n"]) & got).select("n", (part[1].cast("long") - 1).alias("src"), (part[2].cast("long") - 1).alias("dst"), clamp_weight(part[3]).alias("weight"))
    bad = arcs.where(~F.col("src").between(0, head["size"] - 1) | ~F.col("dst").between(0, head["size"] - 1)).first()
    if bad is not None:
        raise IndexError(f"vertex out of range: {bad}")
    from pathloom.functions.tables import global_rank

    return global_rank(arcs, ["n"], F.shiftright("n", 16), "edge_id").select("edge_id", "src", "dst", "weight")


def read_coordinates(spark: SparkSession, path: str, expected: int = 0) -> DataFrame:
    """coords(v, x, y), v from 0.  Raises for malformed, repeated, missing or surplus ids and values outside 32 bits."""
    v = _lines(spark, path).where(F.col("line").startswith("v"))
    part = F.split("line", r"\s+")
    good = F.col("line").rlike(r"^v \d+ -?\d+ -?\d+$")
    c = v.select(good.alias("good"), F.try_element_at(part, F.lit(2)).try_cast("long").alias("id"), F.try_element_at(part, F.lit(3)).try_cast("int").alias("x"), F.try_element_at(part, F.lit(4)).try_cast("int").alias("y"))
    s = c.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("d"), F.min("id").alias("low"), F.max("id").alias("top"), F.count_if(~F.col("good") | F.col("x").isNull() | F.col("y").isNull()).alias("bad")).first()
    if s["bad"] or s["n"] != s["d"] or (s["n"] and (s["low"] != 1 or s["top"] != s["n"])) or (expected and s["n"] != expected):
        raise ValueError(f"coordinates: {s.asDict()}")
    return c.select((F.col("id") - 1).alias("v"), "x", "y")


def write_graph(edges: DataFrame, n: int, path: str, parts: int | None = None) -> None:
    """A `p` line and the arcs ordered by (src, dst), in files whose names follow the order; ids from 1."""
    m = edges.count()
    body = edges.select(F.struct("src", "dst", "edge_id").alias("k"), F.format_string("a %d %d %d", F.col("src") + 1, F.col("dst") + 1, F.col("weight")).alias("value"))
    head = edges.sparkSession.range(1).select(F.struct(F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit(-1).cast("long").alias("edge_id")).alias("k"), F.lit(f"p sp {n} {m}").alias("value"))
    write_lines(head.union(body), ["k"], path, parts)


def arc_counts(spark: SparkSession, path: str) -> DataFrame:
    """(declared_vertices, declared_arcs, actual_arcs) of a file."""
    l = spark.read.text(path)
    p = F.split("value", r"\s+")
    is_p = F.col("value").startswith("p sp ")
    return l.agg(F.max(F.when(is_p, p[2].cast("long"))).alias("declared_vertices"), F.max(F.when(is_p, p[3].cast("long"))).alias("declared_arcs"), F.count_if(F.col("value").startswith("a ")).alias("actual_arcs"))


def from_rows(spark: SparkSession, n: int, rows: list[tuple[int, int, int]]) -> DataFrame:
    """edges of literal (src, dst, weight) rows in id order; raises for vertices outside 0..n-1 or negative weights."""
    for i, (u, v, w) in enumerate(rows):
        if not (0 <= u < n and 0 <= v < n and w >= 0):
            raise IndexError(f"edge {i}")
    return spark.createDataFrame([(i, u, v, w) for i, (u, v, w) in enumerate(rows)], "edge_id long, src long, dst long, weight long")
