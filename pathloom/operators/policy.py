"""View-selection measures over a stream of accesses, as window and fold expressions."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pathloom.functions import scalar as fn
from pathloom.functions.tables import global_rank, global_sum, materialise, range_sum
from pathloom.operators.trace import effective


def accesses(trace: DataFrame) -> DataFrame:
    """(q, op_seq, source): the queries numbered from 1, range by range of operations."""
    q = global_rank(trace.where("kind = 'QUERY'").select("op_seq", "source"), ["op_seq"], F.shiftright("op_seq", 12), "q")
    return q.select((F.col("q") + 1).alias("q"), "op_seq", "source")


def clocks(trace: DataFrame) -> DataFrame:
    """(op_seq, queries, updates, rate): the running query and effective-update clocks, and updates per query."""
    x = global_sum(trace, ["op_seq"], (F.col("kind") == "QUERY").cast("long"), F.shiftright("op_seq", 12), "queries")
    x = global_sum(x, ["op_seq"], F.coalesce(effective(), F.lit(0)), F.shiftright("op_seq", 12), "updates")
    return x.select("op_seq", "queries", "updates", F.round(F.col("updates") / F.greatest(F.lit(1), F.col("queries")), 9).alias("rate"))


def reuse_gaps(acc: DataFrame) -> DataFrame:
    """(q, source, gap): queries since the source's last one; null at its first."""
    return acc.select("q", "source", (F.col("q") - F.lag("q").over(Window.partitionBy("source").orderBy("q"))).alias("gap"))


def lru(acc: DataFrame, cap: int, slice_ops: int = 1 << 16) -> DataFrame:
    """(q, source, hit, victim) of a least-recently-used cache of `cap` sources; victim: the source that leaves, or null.

    The log is cut into ranges that are walked apart.  What a range finds in the cache are the last `cap` different sources
    before it: each range states its own last ones, and one pass over these, a row a range, carries them forward.
    """
    if cap < 1:
        return acc.select("q", "source", F.lit(0).cast("long").alias("hit"), F.lit(None).cast("long").alias("victim"))
    a = acc.select("q", "source", F.floor(F.col("q") / slice_ops).alias("part"))
    last = a.groupBy("part", "source").agg(F.max("q").alias("q"))
    top = last.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("q")))).where(F.col("r") <= cap)
    tops = top.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "source"))), lambda x: x["source"]).alias("own"))

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for b in batches:
            before = []
            for own in b.column(1).to_pylist():
                before.append(list(held))
                held = [*(x for x in held if x not in own), *own][-cap:]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(before, pa.list_(pa.int64()))], ["part2", "held"])

    held = tops.repartition(1).sortWithinPartitions("part").mapInArrow(carry, "part2 long, held array<long>")

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("q", ignore_index=True)
        cache: OrderedDict[int, None] = OrderedDict.fromkeys(f["held"].iloc[0])
        hits, victims = [], []
        for s in f["source"].tolist():
            hit = s in cache
            victims.append(cache.popitem(last=False)[0] if not hit and len(cache) >= cap else None)
            cache[s] = None
            cache.move_to_end(s)
            hits.append(int(hit))
        return pd.DataFrame({"q": f["q"], "source": f["source"], "hit": hits, "victim": pd.array(victims, "Int64")})

    return a.join(held, F.col("part") == F.col("part2")).drop("part2").groupBy("part").applyInPandas(walk, "q long, source long, hit long, victim long")


def previous(acc: DataFrame, bits: int = 16) -> DataFrame:
    """(q, source, prev): the source's access before, null at its first; a source is looked at in ranges of 2^bits accesses."""
    a = acc.select("q", "source", F.shiftright("q", bits).alias("part"))
    tops = a.groupBy("source", "part").agg(F.max("q").alias("top"))
    before = F.max("top").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(F.col("source").alias("s2"), F.col("part").alias("p2"), before.alias("before"))
    near = F.lag("q").over(Window.partitionBy("source", "part").orderBy("q"))
    j = a.withColumn("near", near).join(tops, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
    return j.select("q", "source", F.coalesce("near", "before").alias("prev"))


def later_and_less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each point the number of points of smaller x and larger y, by merging ever longer runs; no y occurs twice."""
    order = np.lexsort((y, x))
    n, rank = len(order), np.empty(len(order), np.int64)
    rank[np.argsort(-y[order], kind="stable")] = np.arange(len(order))  # of y, the largest first
    at, found, width = np.arange(n), np.zeros(n, np.int64), 1
    while width < n:
        by = np.lexsort((rank, at // (2 * width)))
        left = (at[by] // width) % 2 == 0
        met = np.cumsum(left)
        run = at[by] // (2 * width)
        start = np.searchsorted(run, run)  # what was met before the run is no business of its points
        met = met - np.where(start > 0, met[start - 1], 0)
        found[by[~left]] += met[~left]
        width *= 2
    out = np.empty(n, np.int64)
    out[order] = found
    return out


def stack_distances(acc: DataFrame, block: int | None = None) -> DataFrame:
    """(q, source, distance): the different sources accessed since the source's last access, null at its first; q counts from 1.

    An access finds its source in a least-recently-used cache of every capacity above its distance, so one pass tells the
    hits of all.  Between an access i and the one before, p, lie i - p - 1 accesses, less those j whose own last access
    comes after p: they repeat a source.  These are the points (j, prev j) earlier and higher than (i, p).  Time and value are
    cut into blocks: pairs in different blocks of both are sums over a grid, pairs in one block of time or one of value are
    counted in that block, which holds at most `block` points, as no access is the last one of two.
    """
    a = materialise(previous(acc), "accesses")
    n = a.agg(F.max("q")).first()[0] or 0
    b = block or max(4096, int(4 * n**0.5))
    last = n // b
    p = a.where("prev is not null").select("q", "prev", F.floor(F.col("q") / b).cast("int").alias("t"), F.floor(F.col("prev") / b).cast("int").alias("u"))
    cells = p.groupBy("t", "u").agg(F.count(F.lit(1)).alias("c"))
    grid = acc.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("t"), F.explode(F.sequence(F.lit(0), F.col("id").cast("int"))).alias("u")).join(cells, ["t", "u"], "left")
    higher = F.coalesce(F.sum(F.coalesce("c", F.lit(0))).over(Window.partitionBy("t").orderBy(F.desc("u")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("higher").over(Window.partitionBy("u").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.select("t", "u", higher.alias("higher")).select(F.col("t").alias("t2"), F.col("u").alias("u2"), earlier.alias("far"))

    def count(by: str):
        def run(f: pd.DataFrame) -> pd.DataFrame:
            x = f["q" if by == "t" else "t"].to_numpy()
            return pd.DataFrame({"q": f["q"], "n": later_and_less(x, f["prev"].to_numpy())})

        return p.groupBy(by).applyInPandas(run, "q long, n long")

    far = p.join(grid, (F.col("t") == F.col("t2")) & (F.col("u") == F.col("u2"))).select("q", F.col("far").alias("n"))
    repeats = far.unionByName(count("t")).unionByName(count("u")).groupBy(F.col("q").alias("q2")).agg(F.sum("n").alias("n"))
    j = a.join(repeats, F.col("q") == F.col("q2"), "left")
    return j.select("q", "source", (F.col("q") - F.col("prev") - 1 - F.col("n")).alias("distance"))


def hits_by_capacity(distances: DataFrame, most: int = 64) -> DataFrame:
    """(capacity, hits, misses) of least-recently-used caches of 1 to `most` sources."""
    n = distances.agg(F.count(F.lit(1)).alias("n"))
    d = distances.where(F.col("distance") < most).groupBy("distance").agg(F.count(F.lit(1)).alias("c"))  # fewer rows than `most`
    caps = distances.sparkSession.range(1, most + 1).withColumnRenamed("id", "capacity").join(F.broadcast(d), F.col("distance") < F.col("capacity"), "left")
    hits = F.coalesce(F.sum("c"), F.lit(0))
    return caps.groupBy("capacity").agg(hits.alias("hits")).join(F.broadcast(n)).select("capacity", "hits", (F.col("n") - F.col("hits")).alias("misses"))


def probation(acc: DataFrame, limit: int = 4) -> DataFrame:
    """(q, source, seen, promotes): the count of a source's queries, starting anew after every promotion at `limit`."""
    k = F.row_number().over(Window.partitionBy("source").orderBy("q"))
    return acc.select("q", "source", (F.pmod(k - 1, F.lit(limit)) + 1).cast("long").alias("seen"), (k % limit == 0).cast("long").alias("promotes"))


def recent_slots(acc: DataFrame, slots: int = fn.RECENT_SLOTS) -> DataFrame:
    """(q, source, slot, holder, found): the source that a direct-mapped table holds in the slot before each access."""
    slot = F.col("source") % slots
    holder = F.lag("source").over(Window.partitionBy(slot).orderBy("q"))
    return acc.select("q", "source", slot.alias("slot"), holder.alias("holder"), F.coalesce((holder == F.col("source")).cast("long"), F.lit(0)).cast("long").alias("found"))


def scores(acc: DataFrame, debts: DataFrame, penalty: float = 4.0) -> DataFrame:
    """(source, hits, age, debt, score) at the end of the accesses; debts: (source, debt)."""
    end = acc.agg(F.max("q").alias("end"))
    s = acc.groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.max("q").alias("last")).crossJoin(F.broadcast(end)).join(debts.withColumnRenamed("source", "s2"), F.col("source") == F.col("s2"), "left")
    debt = F.coalesce("debt", F.lit(0)).cast("long")
    age = F.col("end") - F.col("last")
    return s.select("source", "hits", age.alias("age"), debt.alias("debt"), F.round(fn.resident_score(F.col("hits"), age, debt, penalty), 9).alias("score"))


def eviction_plan(scored: DataFrame, each: int, budget: int, need: int) -> DataFrame:
    """(source, score, victim): the lowest scores go until `need` fits the budget; every resident takes `each` bytes.

    Only a number of victims is needed, and their scores are found without an order of all residents in one place.
    """
    count = scored.count()
    go = max(0, min(count, -((budget - need - count * each) // each)))
    if go in (0, count):
        return scored.select("source", "score", F.lit(int(go > 0)).cast("long").alias("victim"))
    ranked = range_sum(scored, [F.asc("score"), F.asc("source")], F.lit(1), "_place")
    return ranked.select("source", "score", (F.col("_place") <= go).cast("long").alias("victim"))


def eviction_by_bytes(residents: DataFrame, budget: int, need: int, cap: int | None = None) -> DataFrame:
    """(source, score, bytes, victim): residents (source, score, bytes) of sizes of their own, of which the lowest scores go, ties to the
    smaller source, until `need` more bytes fit the budget and the newcomer the `cap`.  If not even all of them make room, none goes.
    """
    total, count = residents.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    surplus, over = total + need - budget, 0 if cap is None else count + 1 - cap
    if need > budget or (cap is not None and cap < 1) or (surplus <= 0 and over <= 0):
        return residents.select("source", "score", "bytes", F.lit(0).cast("long").alias("victim"))
    order = [F.asc("score"), F.asc("source")]
    r = range_sum(residents.select("source", "score", "bytes"), order, F.struct("bytes")["bytes"], "freed")
    r = range_sum(r, order, F.lit(1), "place") if over > 0 else r.withColumn("place", F.lit(1))
    goes = (F.col("freed") - F.col("bytes") < surplus) | (F.col("place") <= over)
    return r.select("source", "score", "bytes", goes.cast("long").alias("victim"))


def ewma_gaps(acc: DataFrame, alpha: float = 0.25) -> DataFrame:
    """(source, ewma): the smoothed reuse gap of each source queried twice or more."""
    g = reuse_gaps(acc).where("gap is not null").groupBy("source").agg(F.array_sort(F.collect_list(F.struct("q", "gap"))).alias("xs"))
    return g.select("source", F.round(fn.ewma(F.transform("xs", lambda x: x["gap"]), alpha), 9).alias("ewma"))


def cooldown_blocks(evictions: DataFrame, attempts: DataFrame, queries: int = 32) -> DataFrame:
    """(q, source) of admission attempts (q, source) within `queries` queries after an eviction (q, source)."""
    e = evictions.select(F.col("q").alias("eq"), F.col("source").alias("es"))
    return attempts.join(e, (F.col("source") == F.col("es")) & (F.col("q") >= F.col("eq")) & (F.col("q") < F.col("eq") + queries), "left_semi").select("q", "source")


def account(per_op: DataFrame, n_vertices: int) -> DataFrame:
    """(q, bytes, peak): logical bytes from residents and records per operation (q, residents, probation, cooldown), and their running peak."""
    b = F.col("residents") * (fn.SSSP_BASE + fn.SSSP_VERTEX * n_vertices + fn.ADAPTIVE_ENTRY) + fn.metadata_bytes(F.col("probation"), F.col("cooldown"), F.lit(0), F.lit(0))
    x = per_op.select("q", b.cast("long").alias("bytes"))
    return running_max(x, "q", "bytes", "peak")


def preflight(trace: DataFrame, n_vertices: int, budget: int) -> DataFrame:
    """(sources, bytes, most, fits): the distinct query sources of a log, the bytes of their distance tables, for how many of
    them the budget is enough, and whether it is for all.  A lower bound: neither the graph nor containers are in it."""
    if budget < 1:
        raise ValueError("a budget has a byte or more")
    each = fn.SSSP_VERTEX * n_vertices
    total = fn.accounted(F.col("sources"), each)
    most = F.least(F.col("sources"), F.lit(budget // each)) if each else F.col("sources")
    return trace.agg(F.count_distinct("source").alias("sources")).select("sources", total.alias("bytes"), most.cast("long").alias("most"), (total <= budget).alias("fits"))


def records(lru_log: DataFrame, limit: int = 4, cooldown: int = 32) -> DataFrame:
    """(q, residents, probation, cooldown) after each access of a cache's log (q, source, hit, victim): tables held, sources
    counted and not promoted yet, and sources that left at most `cooldown` - 1 queries ago.

    Each is a running sum of comings and goings; a source that leaves again while it cools down keeps its one record.
    """
    p = probation(lru_log.select("q", "source"), limit).select("q", ((F.col("seen") == 1).cast("long") - F.col("promotes")).alias("p"))
    left = lru_log.where("victim is not null").select("q", F.col("victim").alias("source"))
    again = F.least(F.col("q") + cooldown, F.coalesce(F.lead("q").over(Window.partitionBy("source").orderBy("q")), F.col("q") + cooldown))
    left = left.withColumn("again", again)
    c = left.select(F.explode(F.array(F.struct(F.col("q").alias("q"), F.lit(1).alias("c")), F.struct(F.col("again").alias("q"), F.lit(-1).alias("c")))).alias("x")).select("x.q", "x.c")
    r = lru_log.select("q", (1 - F.col("hit") - F.col("victim").isNotNull().cast("long")).alias("r"))
    zero = F.lit(0).cast("long")
    moves = r.select("q", "r", zero.alias("p"), zero.alias("c")).unionByName(p.select("q", zero.alias("r"), "p", zero.alias("c"))).unionByName(c.select("q", zero.alias("r"), zero.alias("p"), F.col("c").cast("long").alias("c")))
    end = lru_log.agg(F.max("q").alias("end"))
    x = moves.groupBy("q").agg(*[F.sum(k).alias(k) for k in "rpc"]).crossJoin(F.broadcast(end)).where("q <= end").drop("end")
    for k, name in zip("rpc", ("residents", "probation", "cooldown"), strict=True):
        x = range_sum(x, [F.asc("q")], F.col(k), name)
    return x.select("q", "residents", "probation", "cooldown")


def probation_by_work(acc: DataFrame, edges: int, limit: int = 4, ratio: float = 0.25) -> DataFrame:
    """(q, source, seen, scans, promotes) of accesses (q, source, scans): a source is promoted once it was asked `limit` times and its
    searches scanned `ratio` of all edges, and is counted anew from then on.

    Accesses go by source and q; a source is one sequence, read as a stream with two numbers of state.  Null sources are one.
    """
    least = ratio * edges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started, seen, work = None, False, 0, 0
        for b in batches:
            out = []
            for source, scans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not started or source != now:
                    now, started, seen, work = source, True, 0, 0
                seen, work = seen + 1, work + (scans or 0)
                up = seen >= limit and work >= least
                out.append((seen, work, int(up)))
                if up:
                    seen, work = 0, 0
            cols = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["q", "source", "seen", "scans", "promotes"])

    return acc.select(F.col("q").cast("long"), F.col("source").cast("long"), F.col("scans").cast("long")).repartition("source").sortWithinPartitions("source", "q").mapInArrow(run, "q long, source long, seen long, scans long, promotes long")


def running_max(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """The largest value up to and with each row, by ranges of a dense order: one row a range is ordered in one place."""
    b = rows.withColumn("_b", F.shiftright(order, 12))
    tops = b.groupBy("_b").agg(F.max(value).alias("_m"))
    before = tops.select(F.col("_b").alias("_b2"), F.max("_m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    within = F.max(value).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("_w", within).join(before, F.col("_b") == F.col("_b2")).withColumn(name, F.greatest("_w", "_before")).drop("_b", "_b2", "_w", "_before")
