"""Graphs and an operation log derived from the driver's relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pathloom.functions.tables import global_lead, global_rank, materialise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(pairs: DataFrame) -> DataFrame:
    """edge_id by (src, dst), numbered source by source."""
    return global_rank(pairs, ["src", "dst"], F.col("src"), "edge_id").select("edge_id", "src", "dst", "weight")


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive users of the event stream: weight is the least 1 + cents of value mod 97 of a pair."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").cast("long").alias("user_id"), "value")
    nxt = global_lead(e, ["ts", "event_id"], "user_id", F.date_trunc("minute", "ts"), "dst")
    pairs = nxt.where("dst is not null and dst <> user_id").groupBy(F.col("user_id").alias("src"), "dst").agg(F.min(1 + F.round(F.col("value") * 100).cast("long") % 97).alias("weight"))
    return materialise(_numbered(pairs), "flow")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items between nations of customer and supplier; weight counts them."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return _numbered(rows.where("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")))


def supply_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers (even vertices) and parts (odd), both directions, without edge ids; weight is the least quantity."""
    p = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_quantity").cast("long").alias("weight"))
    both = p.select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), "weight")
    return both.union(both.select("dst", "src", "weight"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supply_arcs() with edge ids."""
    return _numbered(supply_arcs(spark, sf_dir))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def optrace(spark: SparkSession, sf_dir: str, edges: DataFrame) -> DataFrame:
    """All events as an operation log: op_seq, kind, source, target, edge_id, old_weight, new_weight.

    Operations are numbered by (ts, event_id), minute by minute.
    """
    size = edges.agg(F.count(F.lit(1)).alias("m"), F.max(F.greatest("src", "dst")).alias("top"))
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").cast("long").alias("user_id"), "event_type", "value")
    e = global_rank(e, ["ts", "event_id"], F.date_trunc("minute", "ts"), "op_seq").crossJoin(F.broadcast(size))
    is_query = F.col("event_type").isin("view", "click", "signup")
    none = F.lit(None).cast("long")
    q = e.where(is_query).select("op_seq", F.lit("QUERY").alias("kind"), F.col("user_id").alias("source"), ((F.col("event_id") * 31 + 7) % (F.col("top") + 1)).alias("target"), none.alias("edge_id"), none.alias("old_weight"), none.alias("new_weight"))
    u = e.where(~F.coalesce(is_query, F.lit(False))).select("op_seq", ((F.col("event_id") * 7919) % F.col("m")).alias("edge_id"), (1 + F.round(F.col("value") * 100).cast("long") % 97).alias("new_weight"))
    u = u.withColumn("before", F.lag("new_weight").over(Window.partitionBy("edge_id").orderBy("op_seq")))
    u = u.join(edges.select(F.col("edge_id").alias("e2"), F.col("weight").alias("first")), F.col("edge_id") == F.col("e2"))
    u = u.select("op_seq", F.lit("UPDATE").alias("kind"), none.alias("source"), none.alias("target"), "edge_id", F.coalesce("before", "first").alias("old_weight"), "new_weight")
    return materialise(q.union(u), "optrace")
