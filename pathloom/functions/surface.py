"""Distances from SQL: table functions over a graph of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udf, udtf

from pathloom.functions.scalar import INF
from pathloom.functions.tables import materialise
from pathloom.operators.relax import KERNEL_EDGES, csr_of, sssp


def register(spark: SparkSession, edges: DataFrame, prefix: str = "", sources: list[int] | None = None, kernel_edges: int = KERNEL_EDGES) -> None:
    """Registers over edges, for SQL: the table function <prefix>sssp(source) -> (v, dist) of what can be reached, and the
    function <prefix>shortest_distance(source, target), INF where there is no path; null for a null argument.

    A graph of at most relax.KERNEL_EDGES edges goes to the executors once. Of a larger one the distances from `sources` are found by
    joins and written down, and the functions are SQL over that table: another source is an error when it is asked for, and
    without sources this raises. Functions answer for the weights the graph has now.
    """
    csr = csr_of(edges, kernel_edges)
    if csr is None:
        if not sources:
            raise ValueError("too large for functions: name the sources, or use operators.relax.sssp or distances")
        return _over_labels(spark, edges, prefix, sources)
    sent = spark.sparkContext.broadcast(csr)

    @udtf(returnType="v: bigint, dist: bigint")
    class Sssp:
        def eval(self, source: int) -> Iterator[tuple[int, int]]:
            g = sent.value
            if source is None:
                return
            if g.at(source) < 0:
                yield source, 0
                return
            dist = np.array(g.from_source(source)[0], np.int64)
            for i in np.flatnonzero(dist < INF).tolist():
                yield int(g.names[i]), int(dist[i])

    @udf(returnType="bigint", useArrow=True)
    def shortest_distance(source, target):
        return None if source is None or target is None else sent.value.both_ways(source, target)[0]

    spark.udtf.register(f"{prefix}sssp", Sssp)
    spark.udf.register(f"{prefix}shortest_distance", shortest_distance)


def _over_labels(spark: SparkSession, edges: DataFrame, prefix: str, sources: list[int]) -> None:
    asked = spark.createDataFrame([(s,) for s in sources], "source long")
    materialise(sssp(edges, asked, 0), "labels").createOrReplaceTempView(f"{prefix}labels")
    known = ", ".join(f"{int(s)}L" for s in sources)
    checked = f"CASE WHEN s IS NULL OR s IN ({known}) THEN s ELSE raise_error('not one of the sources') END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}sssp(s BIGINT) RETURNS TABLE (v BIGINT, dist BIGINT) RETURN SELECT l.v, l.dist FROM {prefix}labels l WHERE l.source = {checked}")
    found = f"coalesce((SELECT min(l.dist) FROM {prefix}labels l WHERE l.source = s AND l.v = t), {INF})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}shortest_distance(s BIGINT, t BIGINT) RETURNS BIGINT RETURN CASE WHEN t IS NOT NULL AND {checked} IS NOT NULL THEN CASE WHEN s = t THEN 0L ELSE {found} END END")
