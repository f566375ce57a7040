"""Operation logs: identity, validation, versions as of an operation, replay."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathloom.functions.scalar import INF
from pathloom.functions.tables import discard, global_sum, materialise
from pathloom.operators.history import interval_labels, stabbed
from pathloom.operators.relax import KERNEL_EDGES, csr_of, thinned

#: Updates of a log up to which they go to all executors (20 bytes each as flat arrays).
KERNEL_UPDATES = 4_000_000


def line_of() -> Column:
    """The canonical line of an operation."""
    q = F.concat_ws(" ", F.col("kind"), F.col("source").cast("string"), F.col("target").cast("string"))
    u = F.concat_ws(" ", F.col("kind"), F.col("edge_id").cast("string"), F.col("old_weight").cast("string"), F.col("new_weight").cast("string"))
    return F.when(F.col("kind") == "QUERY", q).otherwise(u)


def canonical_lines(trace: DataFrame) -> DataFrame:
    return trace.select("op_seq", line_of().alias("line"))


def trace_sha256(trace: DataFrame) -> DataFrame:
    """One row: the SHA-256 of all canonical lines, each ended by a line feed, in order.

    A digest is sequential, so one task reads the sorted lines; it holds a batch of them at a time, not the log.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = hashlib.sha256()
        for b in batches:
            for line in b.column(1).to_pylist():
                h.update(line.encode() + b"\n")
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()])], ["sha256"])

    return trace.select("op_seq", line_of().alias("l")).repartition(1).sortWithinPartitions("op_seq").mapInArrow(digest, "sha256 string")


def counts(trace: DataFrame) -> DataFrame:
    u = F.col("kind") == "UPDATE"
    return trace.agg(F.count_if(F.col("kind") == "QUERY").alias("n_query"), F.count_if(u).alias("n_update"), F.count_if(u & (F.col("new_weight") > F.col("old_weight"))).alias("n_increase"), F.count_if(u & (F.col("new_weight") < F.col("old_weight"))).alias("n_decrease"))


def validation_errors(trace: DataFrame, edges: DataFrame, n_vertices: Column | int, logs: list[str] | None = None) -> DataFrame:
    """(op_seq, error) of operations that name no vertex or edge, or whose old weight isn't the edge's last one.

    `logs` names columns that tell several logs of one graph apart; they are returned too.
    """
    n, logs = F.lit(n_vertices) if isinstance(n_vertices, int) else n_vertices, logs or []
    first = edges.select(F.col("edge_id").alias("e2"), F.col("weight").alias("first"))
    ok = lambda c: F.coalesce(F.col(c).between(0, n - 1), F.lit(False))
    is_update = F.coalesce(F.col("kind") == "UPDATE", F.lit(False))
    rest = trace.where(~is_update)
    err = F.when(~F.coalesce(F.col("kind") == "QUERY", F.lit(False)), "kind").when(~(ok("source") & ok("target")), "vertex")
    other = rest.select(*logs, "op_seq", err.alias("error"))
    # only updates are dealt by edge: queries have none
    before = F.lag("new_weight").over(Window.partitionBy(*logs, "edge_id").orderBy("op_seq"))
    t = trace.where(is_update).withColumn("before", before).join(first, F.col("edge_id") == F.col("e2"), "left")
    bad_old = ~F.col("old_weight").eqNullSafe(F.coalesce("before", "first"))
    mine = t.select(*logs, "op_seq", F.when(F.col("e2").isNull(), "edge").when(bad_old, "old_weight").alias("error"))
    return other.union(mine).where("error is not null")


def effective() -> Column:
    return ((F.col("kind") == "UPDATE") & (F.col("new_weight") != F.col("old_weight"))).cast("long")


def epochs(trace: DataFrame) -> DataFrame:
    """trace plus epoch: the effective updates up to and with each operation, summed in ranges of operations."""
    return global_sum(trace, ["op_seq"], F.coalesce(effective(), F.lit(0)), F.shiftright("op_seq", 12), "epoch")


def edge_versions(edges: DataFrame, trace: DataFrame) -> DataFrame:
    """(edge_id, src, dst, weight, valid_from, valid_to): an edge's weight for epochs in [valid_from, valid_to)."""
    e = epochs(trace).where((F.col("kind") == "UPDATE") & (F.col("new_weight") != F.col("old_weight")))
    changes = edges.select("edge_id", "weight", F.lit(0).cast("long").alias("valid_from")).union(e.select("edge_id", F.col("new_weight").alias("weight"), F.col("epoch").alias("valid_from")))
    until = F.coalesce(F.lead("valid_from").over(Window.partitionBy("edge_id").orderBy("valid_from")), F.lit(INF))
    v = changes.withColumn("valid_to", until)
    ends = edges.select(F.col("edge_id").alias("e2"), "src", "dst")
    return v.join(ends, F.col("edge_id") == F.col("e2")).select("edge_id", "src", "dst", "weight", "valid_from", "valid_to")


def weights_asof(versions: DataFrame, epoch: int) -> DataFrame:
    return versions.where((F.col("valid_from") <= epoch) & (F.col("valid_to") > epoch)).select("edge_id", "src", "dst", "weight")


def replay(edges: DataFrame, trace: DataFrame, kernel_edges: int = KERNEL_EDGES, slice_ops: int | None = None) -> DataFrame:
    """(op_seq, source, target, answer) of every query, exact as of its place in the log.

    A graph of bounded size goes to all executors once and the log is cut into ranges of `slice_ops` operations, which are
    answered apart: a range starts from the weights as of its first operation and walks its own operations.  Up to KERNEL_UPDATES updates
    go to all executors too, so a range finds these weights itself; of more, it is sent the last update of an edge in the ranges before.
    Of a larger graph go the edges that a shortest path may take at any time, if they fit (thinned()).  Else the
    distances of all asked sources are found as intervals of epochs in one loop (operators.history).
    """
    csr = csr_of(edges, kernel_edges)
    whole = csr is not None
    if not whole and kernel_edges:
        spans = materialise(_spanned(edges, trace), "spans")
        csr = thinned(spans, kernel_edges)
        discard(spans)
    if csr is None:
        return _replay_relational(edges, trace)
    spark = edges.sparkSession
    n, updates = trace.agg(F.max("op_seq"), F.count_if(F.col("kind") == "UPDATE")).first()
    n = n or 0
    # few ranges while edges change often, as each starts with all changed weights; at most 200,000 operations in memory
    size = slice_ops or max(512, min(200_000, -(-(n + 1) // (4 * spark.sparkContext.defaultParallelism))))
    ops = trace.select(F.floor(F.col("op_seq") / size).cast("int").alias("part"), "op_seq", (F.col("kind") == "QUERY").alias("query"), F.coalesce("source", "edge_id").alias("a"), F.coalesce("target", "new_weight").alias("b"))
    before = None
    if updates <= KERNEL_UPDATES:
        u = ops.where("not query").select("op_seq", "a", "b").toArrow()
        seq, a, b = (u[c].to_numpy() for c in u.column_names)
        at = csr.places(a, whole)
        order = np.argsort(seq, kind="stable")
        order = order[at[order] >= 0]
        before = seq[order], at[order].astype(np.int32), b[order]
    else:
        last = ops.where("not query").groupBy("a", "part").agg(F.max_by("b", "op_seq").alias("b"))
        until = F.coalesce(F.lead("part").over(Window.partitionBy("a").orderBy("part")), F.lit(n // size))
        start = last.withColumn("until", until).where("part < until").select(F.explode(F.sequence(F.col("part") + 1, F.col("until"))).alias("part"), F.lit(-1).cast("long").alias("op_seq"), F.lit(False).alias("query"), "a", "b")
        ops = ops.unionByName(start)
    sent = spark.sparkContext.broadcast((csr, before))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        (g, before), out = sent.value, []
        f = f.sort_values("op_seq", kind="stable")
        seq, query, a, b = f["op_seq"].to_numpy(np.int64), f["query"].to_numpy(bool), f["a"].to_numpy(np.int64).copy(), f["b"].to_numpy(np.int64)
        now = np.frombuffer(g.weight, np.int64).copy()
        if before is not None:
            k = np.searchsorted(before[0], int(f["part"].iloc[0]) * size)
            now[before[1][:k]] = before[2][:k]  # of an edge's updates the last one holds
        a[~query] = g.places(a[~query], whole)
        mine = ~query & (a >= 0)
        low = now.copy()
        np.minimum.at(low, a[mine], b[mine])
        sides, weight = g.by_weight(low), array("q", now.tobytes())
        ends = np.zeros((2, len(f)), np.int64)
        for i, x in enumerate((a, b)):
            ends[i] = np.minimum(np.searchsorted(g.names, x), max(0, len(g.names) - 1))
            ends[i] = np.where(g.names[ends[i]] == x, ends[i], -1) if len(g.names) else -1
        for i, asked, x, y, s, t in zip(seq.tolist(), query.tolist(), a.tolist(), b.tolist(), *ends.tolist(), strict=True):
            if asked:
                out.append((i, x, y, 0 if x == y else INF if s < 0 or t < 0 else g.nearest(s, t, weight, sides)))
            elif x >= 0:
                weight[x] = y
        return pd.DataFrame(out, columns=["op_seq", "source", "target", "answer"])

    return ops.groupBy("part").applyInPandas(run, "op_seq long, source long, target long, answer long")


def _spanned(edges: DataFrame, trace: DataFrame) -> DataFrame:
    """edges with their least and greatest weight over the log."""
    u = trace.where("kind = 'UPDATE'").groupBy(F.col("edge_id").alias("e2")).agg(F.min("new_weight").alias("down"), F.max("new_weight").alias("up"))
    return edges.join(u, F.col("edge_id") == F.col("e2"), "left").select("edge_id", "src", "dst", "weight", F.least("weight", "down").alias("low"), F.greatest("weight", "up").alias("high"))


def _replay_relational(edges: DataFrame, trace: DataFrame) -> DataFrame:
    """All distances that sources have while they are asked, as intervals of epochs; queries look theirs up as of their epoch."""
    q = epochs(trace).where("kind = 'QUERY'").select("op_seq", "source", F.col("target").alias("v"), "epoch")
    q = materialise(q, "queries")
    seeds = q.where("source is not null").groupBy("source").agg(F.min("epoch").alias("valid_from"), (F.max("epoch") + 1).alias("valid_to"))
    a = stabbed(q, interval_labels(edge_versions(edges, trace), seeds))
    dist = F.when(F.col("source") == F.col("v"), 0).otherwise(F.coalesce("dist", F.lit(INF))).cast("long")
    return a.select("op_seq", "source", F.col("v").alias("target"), dist.alias("answer"))


def mismatches(answers: DataFrame, oracle: DataFrame) -> DataFrame:
    """(op_seq, answer, expected) where the two tables (op_seq, answer) differ or one lacks the operation."""
    o = oracle.select(F.col("op_seq").alias("o2"), F.col("answer").alias("expected"))
    j = answers.join(o, F.col("op_seq") == F.col("o2"), "full_outer")
    return j.where("not (answer <=> expected)").select(F.coalesce("op_seq", "o2").alias("op_seq"), "answer", "expected")
