"""Connected components by alternating large-star and small-star steps on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, hot_join, materialise


def _mark(e: DataFrame) -> tuple[int, int]:
    row = e.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], int(row["h"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, many: int = 1 << 15) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Minima are aggregated before the shuffle and joined back; of more than `many` edges the centres of stars, with over a
    thousandth of all edge ends, get theirs by broadcast (under a thousand rows), so a star is no single group.  Edges never
    reach the driver, which sees one count and one hash a round.  Null ends and loops are ignored.
    No edges: no rows.
    """
    e = edges.where(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialise(e, "components")
    seen = _mark(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        meet = lambda x, low, n=seen[0]: hot_join(x, low, F.col("u") == F.col("k"), 2 * n, "inner") if n > many else x.join(low, F.col("u") == F.col("k"))
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"), "n")
        large = meet(both.where("v > u"), low).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = meet(large, low.withColumnRenamed("u", "k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        old, e = e, materialise(small, "components")
        discard(old)
        now = _mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    nodes = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
