"""Shortest-path trees: tight edges, canonical parents, numbered subtrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pathloom.functions.scalar import sat_add
from pathloom.functions.tables import discard, materialise
from pathloom.operators.relax import relax


def within_labels(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """The edges no heavier than the greatest label of their head: no other edge is tight for any source of dist, so the rows an edge
    and source that a join makes are only of these."""
    most = dist.groupBy(F.col("v").alias("_head")).agg(F.max("dist").alias("_most"))
    return edges.join(most, F.col("dst") == F.col("_head")).where(F.col("weight") <= F.col("_most")).drop("_head", "_most")


def tight_edges(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(source, edge_id, src, dst, weight) of edges that lie on some shortest path; dist: (source, v, dist)."""
    edges = within_labels(edges, dist)
    d = dist.select(F.col("source").alias("s2"), F.col("v").alias("v2"), F.col("dist").alias("d2"))
    j = edges.join(dist, F.col("src") == F.col("v")).join(d, (F.col("source") == F.col("s2")) & (F.col("dst") == F.col("v2")))
    return j.where(sat_add(F.col("dist"), F.col("weight")) == F.col("d2")).select("source", "edge_id", "src", "dst", "weight")


def zero_hops(tight: DataFrame) -> DataFrame:
    """(source, v, hops) of vertices that tight edges of weight 0 touch: the edges since the distance last grew, on the way with the fewest.

    With the distance this is a label (dist, hops) that every edge makes larger, so its least values form a tree where
    distances alone may form cycles.
    """
    flat = tight.where("weight = 0").select("source", "src", "dst", F.lit(1).cast("long").alias("weight"))
    grown = tight.where("weight > 0").select("source", F.col("dst").alias("v")).distinct()
    ends = flat.select("source", F.explode(F.array("src", "dst")).alias("v")).distinct()
    seeds = ends.join(grown, ["source", "v"], "left_semi").union(ends.where("v = source")).distinct()
    return relax(seeds.select("source", "v", F.lit(0).cast("long").alias("dist")), flat, ["source"], valid=F.col("source") == F.col("_e_source")).withColumnRenamed("dist", "hops")


def parents(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(source, v, parent_edge, parent, hops): the canonical edge into each vertex but the source.

    Among tight edges it is the one of the least id from a smaller distance, if there is one (hops 0); a vertex that only edges of
    weight 0 reach takes the least id of those from a vertex with one hop less.  So parents never form a cycle.
    """
    t = tight_edges(edges, dist).where("dst <> source")
    best = t.where("weight > 0").groupBy("source", F.col("dst").alias("v")).agg(F.min(F.struct("edge_id", "src")).alias("p")).withColumn("hops", F.lit(0).cast("long"))
    if not edges.where("weight = 0").isEmpty():
        t = materialise(t, "tight")
        h = materialise(zero_hops(t), "hops")
        up = h.select(F.col("source").alias("s1"), F.col("v").alias("v1"), F.col("hops").alias("h1"))
        down = h.select(F.col("source").alias("s2"), F.col("v").alias("v2"), "hops")
        flat = t.where("weight = 0").join(up, (F.col("source") == F.col("s1")) & (F.col("src") == F.col("v1"))).join(down, (F.col("source") == F.col("s2")) & (F.col("dst") == F.col("v2"))).where("h1 + 1 = hops")
        best = best.unionByName(flat.groupBy("source", F.col("dst").alias("v")).agg(F.min(F.struct("edge_id", "src")).alias("p"), F.min("hops").alias("hops")))
    return best.select("source", "v", F.col("p.edge_id").alias("parent_edge"), F.col("p.src").alias("parent"), "hops")


def _rounds(at: DataFrame) -> int:
    """Rounds in which doubling pointers reach the root of any tree of so many rows."""
    return max(1, at.count()).bit_length() + 1


def _settled(at: DataFrame, step, tag: str, pending: str = "up is not null") -> DataFrame:
    """at, stepped until no row is pending; raises beyond the rounds that a tree can take, as its parents then form a cycle."""
    at = materialise(at, tag)
    for _ in range(_rounds(at) + 1):
        if at.where(pending).isEmpty():
            return at
        nxt = materialise(step(at), tag)
        discard(at)
        at = nxt
    raise ValueError("the parents form a cycle")


def _with_roots(tree: DataFrame) -> DataFrame:
    """(source, v, up) of all vertices of trees (source, v, parent): roots are parents that have none."""
    roots = tree.select("source", F.col("parent").alias("v")).distinct().join(tree.select("source", "v"), ["source", "v"], "left_anti")
    return tree.select("source", "v", F.col("parent").alias("up")).unionByName(roots.select("source", "v", F.lit(None).cast("long").alias("up")))


def subtree_sizes(tree: DataFrame) -> DataFrame:
    """(source, v, size) with v itself counted.

    After k rounds a vertex holds the number of those less than 2^k levels below it and a pointer 2^k levels up; it gains
    what the vertices exactly 2^k levels below hold.  So the work is the vertices by the logarithm of the depth.
    """

    def step(at: DataFrame) -> DataFrame:
        gain = at.where("up is not null").groupBy(F.col("source").alias("s2"), F.col("up").alias("v2")).agg(F.sum("size").alias("more"))
        far = at.select(F.col("source").alias("s3"), F.col("v").alias("v3"), F.col("up").alias("up3"))
        nxt = at.join(gain, (F.col("source") == F.col("s2")) & (F.col("v") == F.col("v2")), "left").join(far, (F.col("source") == F.col("s3")) & (F.col("up") == F.col("v3")), "left")
        return nxt.select("source", "v", F.col("up3").alias("up"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))

    return _settled(_with_roots(tree).withColumn("size", F.lit(1).cast("long")), step, "sizes").select("source", "v", "size")


def numbered(tree: DataFrame, salts: int = 64) -> DataFrame:
    """(source, v, enter, leave): places of a walk in which the subtree of v holds the numbers from enter up to leave, leave excluded.

    A child enters after its parent and the subtrees of its earlier siblings; these offsets are summed up to the root by
    doubling pointers (list ranking), so a chain takes the logarithm of its length in rounds.  Siblings are summed in
    salted parts, so a star is no single group.
    """
    sizes = subtree_sizes(tree).select(F.col("source").alias("s2"), F.col("v").alias("v2"), "size")
    at = _with_roots(tree).join(sizes, (F.col("source") == F.col("s2")) & (F.col("v") == F.col("v2"))).select("source", "v", "up", "size", F.pmod(F.xxhash64("v"), F.lit(salts)).alias("salt"))
    at = materialise(at, "numbered")
    parts = at.groupBy("source", "up", "salt").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source", "up").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("source").alias("s2"), F.col("up").alias("u2"), F.col("salt").alias("salt2"), before.alias("before"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("source", "up", "salt").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("within", within).join(parts, (F.col("source") == F.col("s2")) & F.col("up").eqNullSafe(F.col("u2")) & (F.col("salt") == F.col("salt2")))
    at = at.select("source", "v", "up", "size", (F.col("within") + F.col("before") + F.when(F.col("up").isNull(), 0).otherwise(1)).alias("enter"))

    def step(at: DataFrame) -> DataFrame:
        far = at.select(F.col("source").alias("s2"), F.col("v").alias("v2"), F.col("up").alias("up2"), F.col("enter").alias("more"))
        j = at.join(far, (F.col("source") == F.col("s2")) & (F.col("up") == F.col("v2")), "left")
        return j.select("source", "v", F.col("up2").alias("up"), "size", (F.col("enter") + F.coalesce("more", F.lit(0))).alias("enter"))

    return _settled(at, step, "numbered").select("source", "v", "enter", (F.col("enter") + F.col("size")).alias("leave"))


def members(numbers: DataFrame, tops: DataFrame, bits: int = 10) -> DataFrame:
    """(source, top, v): the vertices below and at each of tops (source, top), which may be many and lie in each other.

    Numbers meet the ranges of tops in bins of 2^bits numbers, so the join is on equal keys; a top has a row for each bin of its
    range, never more than its subtree has vertices.
    """
    t = tops.select("source", "top").distinct()
    n = numbers.select(F.col("source").alias("s2"), F.col("v").alias("v2"), F.col("enter").alias("low"), F.col("leave").alias("high"))
    t = t.join(n, (F.col("source") == F.col("s2")) & (F.col("top") == F.col("v2"))).drop("s2", "v2")
    t = t.withColumn("bin", F.explode(F.sequence(F.shiftright("low", bits), F.shiftright(F.col("high") - 1, bits)))).select(F.col("source").alias("s1"), "top", "low", "high", F.col("bin").alias("bin1"))
    j = numbers.withColumn("bin", F.shiftright("enter", bits)).join(t, (F.col("source") == F.col("s1")) & (F.col("bin") == F.col("bin1")))
    return j.where("enter >= low and enter < high").select("source", "top", "v")


def descent(tree: DataFrame) -> DataFrame:
    """(source, top, v): v lies in the subtree of top, top itself included; tree: (source, v, parent)."""
    n = materialise(numbered(tree), "numbers")
    return members(n, n.select("source", F.col("v").alias("top")))


def below(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """(source, v): the union of the subtrees of tops (source, top), each vertex once.

    A vertex asks its ancestors 1, 2, 4, ... levels up whether they are known to lie below a top: the logarithm of the depth
    in rounds, and no row for a pair of a top and a vertex.
    """
    marks = tops.select("source", F.col("top").alias("v")).distinct().withColumn("top", F.lit(True))
    at = _with_roots(tree).join(marks, ["source", "v"], "left").select("source", "v", F.when(F.col("top").isNull(), F.col("up")).alias("up"), F.coalesce("top", F.lit(False)).alias("inside"))

    def step(at: DataFrame) -> DataFrame:
        far = at.select(F.col("source").alias("s2"), F.col("v").alias("v2"), F.col("up").alias("up2"), F.col("inside").alias("in2"))
        nxt = at.join(far, (F.col("source") == F.col("s2")) & (F.col("up") == F.col("v2")), "left")
        known = F.coalesce("in2", F.lit(False))
        return nxt.select("source", "v", F.when(~known, F.col("up2")).alias("up"), (F.col("inside") | known).alias("inside"))

    return _settled(at, step, "below").where("inside").select("source", "v")


def subtree(tree: DataFrame, top: int, most: int | None = None) -> DataFrame | None:
    """(source, v) of the vertices below and at top; None if they are more than `most` (of all sources together)."""
    found = below(tree, tree.select("source", F.lit(top).cast("long").alias("top")).distinct())
    return None if most is not None and found.count() > most else found


def edge_regimes(tree: DataFrame, n: int) -> DataFrame:
    """tree (source, v, parent_edge, parent) plus size, small and catastrophic: what hangs below each tree edge, and whether
    that is very little or a quarter of all n vertices."""
    z = subtree_sizes(tree).select(F.col("source").alias("s2"), F.col("v").alias("v2"), "size")
    j = tree.join(z, (F.col("source") == F.col("s2")) & (F.col("v") == F.col("v2"))).drop("s2", "v2")
    return j.withColumn("small", F.col("size") <= max(8, n // 1000)).withColumn("catastrophic", F.col("size") >= max(2, n // 4))
