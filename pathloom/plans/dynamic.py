"""Registered queries on trees, batches of updates and whole histories; they join those of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathloom.functions import scalar as fn
from pathloom.functions.tables import materialise
from pathloom.operators import history as hs, labels as lb, policy, relax as rx, repair as rp, stats, trace as tr, tree as tt
from pathloom.plans.catalog import ACC, FLOW, LRU, OPS, REPLAY, SCORES, TREE, VERSIONS, _acc, _dist, _home, _log, _one, _scored, _sp, register
from pathloom.sources import views
from pathloom.streaming import counters as ct

# ---- weights of zero -----------------------------------------------------------------------------------------------
THIN = f"{FLOW}, thin AS (SELECT edge_id, src, dst, weight % 4 AS weight FROM flow)"


def _canonical(edges: str, sp: str = "sp", many: bool = True) -> str:
    """hop and par: hops since the distance grew, and canonical parents, of the distances sp over edges."""
    return f"""tight AS (SELECT a.s, e.edge_id, e.src, e.dst, e.weight FROM {sp} a JOIN {edges} e ON a.v = e.src JOIN {sp} b ON b.s = a.s AND b.v = e.dst WHERE a.dist + e.weight = b.dist AND e.dst <> a.s),
grown AS (SELECT DISTINCT s, dst AS v FROM tight WHERE weight > 0),
hop(s, v, h) USING KEY (s, v) AS (SELECT DISTINCT {sp}.s, {sp}.v, 0::BIGINT FROM {sp} LEFT JOIN grown g ON g.s = {sp}.s AND g.v = {sp}.v WHERE {sp}.v = {sp}.s OR g.v IS NOT NULL UNION SELECT c.s, c.v, c.nh FROM (SELECT t.s, t.dst AS v, min(p.h) + 1 AS nh FROM hop p JOIN tight t ON t.s = p.s AND t.src = p.v AND t.weight = 0 GROUP BY 1, 2) c LEFT JOIN recurring.hop r ON r.s = c.s AND r.v = c.v WHERE r.h IS NULL OR c.nh < r.h),
par AS (SELECT t.s, t.dst AS v, min(t.edge_id) AS parent_edge, arg_min(t.src, t.edge_id) AS parent, min(b.h) AS hops FROM tight t JOIN hop a ON a.s = t.s AND a.v = t.src JOIN hop b ON b.s = t.s AND b.v = t.dst WHERE CASE WHEN t.weight > 0 THEN b.h = 0 ELSE a.h + 1 = b.h END GROUP BY 1, 2)"""


def _thin_tree(spark: SparkSession, d: str) -> DataFrame:
    g = views.flow(spark, d).withColumn("weight", F.col("weight") % 4)
    return materialise(tt.parents(g, _dist(spark, g, 0)), "tree")


@register("zero_weight_tree_parent", f"WITH RECURSIVE {THIN}, {_sp('SELECT 0::BIGINT AS s', 'thin')}, {_canonical('thin')} SELECT v, parent_edge, parent, hops FROM par")
def zero_weight_tree_parent(spark, d):
    """Canonical parents where a quarter of the edges weighs nothing."""
    return _thin_tree(spark, d).select("v", "parent_edge", "parent", "hops")


@register("zero_weight_subtree_sizes", f"WITH RECURSIVE {THIN}, {_sp('SELECT 0::BIGINT AS s', 'thin')}, {_canonical('thin')}, anc(top, v) AS (SELECT v, v FROM sp UNION ALL SELECT par.parent, anc.v FROM anc JOIN par ON par.v = anc.top) SELECT top AS v, count(*) AS size FROM anc GROUP BY 1")
def zero_weight_subtree_sizes(spark, d):
    return tt.subtree_sizes(_thin_tree(spark, d)).select("v", "size")


# ---- subtrees of many edges ----------------------------------------------------------------------------------------
@register("tree_edge_affected_sets", f"WITH RECURSIVE {FLOW}, {_sp('SELECT 0::BIGINT AS s')}, {TREE.format(edges='flow')}, anc(top, v) AS (SELECT v, v FROM sp UNION ALL SELECT par.parent, anc.v FROM anc JOIN par ON par.v = anc.top) SELECT par.parent_edge AS edge_id, anc.v FROM anc JOIN par ON par.v = anc.top")
def tree_edge_affected_sets(spark, d):
    """For every tree edge the vertices whose distance its increase may change."""
    g = views.flow(spark, d)
    tree = materialise(tt.parents(g, _dist(spark, g, 0)), "tree")
    numbers = materialise(tt.numbered(tree), "numbers")
    found = tt.members(numbers, tree.select("source", F.col("v").alias("top")))
    return found.join(tree.select(F.col("v").alias("v2"), "parent_edge"), F.col("top") == F.col("v2")).select(F.col("parent_edge").alias("edge_id"), "v")


# ---- delta-stepping ------------------------------------------------------------------------------------------------
SUPPLY = """p AS (SELECT l_suppkey * 2 AS src, l_partkey * 2 + 1 AS dst, CAST(min(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey), supply AS (SELECT src, dst, weight FROM p UNION ALL SELECT dst, src, weight FROM p)"""


@register("sssp_supply_delta", f"WITH RECURSIVE {SUPPLY}, {_sp('SELECT 2::BIGINT AS s', 'supply')} SELECT v, dist FROM sp")
def sssp_supply_delta(spark, d):
    """Distances from a supplier over the bipartite graph of suppliers and parts, bucket by bucket."""
    return lb.delta_stepping(materialise(views.supply_arcs(spark, d), "supply"), _one(spark, 2)).select("v", "dist")


# ---- batches of updates --------------------------------------------------------------------------------------------
RESIDENTS = f"{OPS}, {VERSIONS}, res AS (SELECT source AS s FROM optrace WHERE kind = 'QUERY' GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 50), last AS (SELECT edge_id, src, dst, weight FROM versions WHERE valid_to = 4611686018427387903)"


def _resident_batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(edges as of half of all epochs, distances and trees of the 50 most asked sources on them, all changes of the other half)."""
    g, t = _log(spark, d)
    versions = materialise(tr.edge_versions(g, t), "versions")
    half = (versions.where("valid_to < 4611686018427387903").agg(F.max("valid_to")).first()[0] or 0) // 2
    old = materialise(tr.weights_asof(versions, half), "edges")
    changes = versions.where((F.col("valid_to") == rx.INF) & (F.col("valid_from") > half)).select("edge_id", F.col("weight").alias("new_weight"))
    asked = t.where("kind = 'QUERY'").groupBy("source").count().orderBy(F.desc("count"), "source").limit(50).select("source")
    dist = materialise(rx.sssp(old, asked), "dist")
    return old, dist, materialise(tt.parents(old, dist), "tree"), materialise(changes, "changes")


@register("batch_repair", f"WITH RECURSIVE {RESIDENTS}, {_sp('SELECT s FROM res', 'last')} SELECT s AS source, v, dist FROM sp")
def batch_repair(spark, d):
    """The 50 most asked sources, resident since half of the log, after all its other updates at once."""
    return rp.repair_batch(*_resident_batch(spark, d))[0].select("source", "v", "dist")


@register("batch_repair_parents", f"WITH RECURSIVE {RESIDENTS}, {_sp('SELECT s FROM res', 'last')}, {_canonical('last')} SELECT s AS source, v, parent_edge, parent FROM par")
def batch_repair_parents(spark, d):
    """Their trees after the batch: the old ones with the parents that changed."""
    old, dist, tree, changes = _resident_batch(spark, d)
    after, changed = rp.repair_batch(old, dist, tree, changes)
    diff = rp.reparent(rp.with_weights(old, changes), after, tree, changed, changes)
    return rp.updated_tree(tree, materialise(diff, "reparented")).select("source", "v", "parent_edge", "parent")


# ---- histories -----------------------------------------------------------------------------------------------------
@register("asof_out_weights", f"WITH {OPS}, {VERSIONS} SELECT op_seq, ep.source, count(*) AS edges, sum(v.weight)::BIGINT AS total, min(v.weight) AS least FROM ep JOIN versions v ON v.src = ep.source AND v.valid_from <= epoch AND epoch < v.valid_to WHERE kind = 'QUERY' GROUP BY 1, 2")
def asof_out_weights(spark, d):
    """The weights of all edges out of a query's source as of its place in the log."""
    g, t = _log(spark, d)
    asked = tr.epochs(t).where("kind = 'QUERY'").select("op_seq", "source", "epoch")
    got = hs.asof(asked, hs.out_weights(tr.edge_versions(g, t)), ["source"], "epoch", "since", ["edges", "total", "least"])
    return got.where("edges > 0").select("op_seq", "source", "edges", "total", "least")


@register("trace_replay_intervals", f"{REPLAY} SELECT op_seq, source, target, answer FROM answers")
def trace_replay_intervals(spark, d):
    """The answers of the log by interval labels, as for graphs beyond the kernel's size."""
    return tr.replay(*_log(spark, d), kernel_edges=0)


# ---- caches of every capacity, residents of every size -------------------------------------------------------------
DISTANCE = f"{ACC}, pv AS (SELECT q, source, lag(q) OVER (PARTITION BY source ORDER BY q) AS prev FROM acc), sd AS (SELECT i.q, i.source, CASE WHEN i.prev IS NOT NULL THEN count(j.q) END AS distance FROM pv i LEFT JOIN pv j ON j.q > i.prev AND j.q < i.q AND coalesce(j.prev, 0) < i.prev GROUP BY i.q, i.source, i.prev)"


@register("stack_distances", f"WITH {DISTANCE} SELECT q, source, distance FROM sd")
def stack_distances(spark, d):
    return policy.stack_distances(_acc(spark, d))


@register("hits_by_capacity", f"WITH {DISTANCE} SELECT capacity, count(*) FILTER (distance < capacity) AS hits, count(*) FILTER (distance IS NULL OR distance >= capacity) AS misses FROM sd, range(1, 65) c(capacity) GROUP BY 1")
def hits_by_capacity(spark, d):
    """Hits of least-recently-used caches of 1 to 64 sources, from one pass."""
    return policy.hits_by_capacity(materialise(policy.stack_distances(_acc(spark, d)), "distances"))


@register("cache_counters_reconcile", f"WITH {DISTANCE} SELECT capacity, count(*) AS queries, count(*) FILTER (distance IS NULL OR distance >= capacity) AS cold_queries, count(*) FILTER (distance < capacity) AS resident_queries FROM sd, (VALUES (2), (4), (16)) c(capacity) GROUP BY 1")
def cache_counters_reconcile(spark, d):
    """Counters of caches that walked the log, kept where cold and resident queries sum up to all and the stack distances agree."""
    acc = materialise(_acc(spark, d), "accesses")
    logs = [policy.lru(acc, c).select(F.lit(c).alias("capacity"), "hit") for c in (2, 4, 16)]
    counted = logs[0].unionByName(logs[1]).unionByName(logs[2]).groupBy("capacity").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("hit") == 0).alias("cold_queries"), F.sum("hit").alias("resident_queries"))
    bad = stats.reconcile(counted, ["cold_queries", "resident_queries"], "queries").select(F.col("capacity").alias("c2"))
    told = policy.hits_by_capacity(materialise(policy.stack_distances(acc), "distances"), 16).select(F.col("capacity").alias("c3"), F.col("hits"))
    return counted.join(bad, F.col("capacity") == F.col("c2"), "left_anti").join(told, (F.col("capacity") == F.col("c3")) & (F.col("resident_queries") == F.col("hits")), "left_semi")


SIZED = f"light AS (SELECT * FROM flow WHERE weight <= 2), {_sp('SELECT source AS s FROM scored', 'light')}, sized AS (SELECT source, score, 8 + 44 * count(*) + 100 AS bytes FROM scored JOIN sp ON s = source GROUP BY ALL), need AS (SELECT sum(bytes) // 2 AS budget, max(bytes) AS need, sum(bytes) AS total FROM sized)"


@register("eviction_by_bytes", f"WITH RECURSIVE {SCORES}, {SIZED}, run AS (SELECT source, score, bytes, sum(bytes) OVER (ORDER BY score, source) - bytes AS before FROM sized) SELECT source, score, bytes::BIGINT AS bytes, CASE WHEN before < total + need - budget THEN 1 ELSE 0 END::BIGINT AS victim FROM run, need")
def eviction_by_bytes(spark, d):
    """Residents as large as what they reach over light edges; half of their bytes is the budget, the largest is to come in."""
    scored = materialise(_scored(spark, d), "scored")
    g = views.flow(spark, d).where("weight <= 2")
    reach = rx.reach(g, scored.select("source")).select(F.col("source").alias("s2"), "reached")
    sized = materialise(scored.join(reach, F.col("source") == F.col("s2")).select("source", "score", (fn.state_bytes(F.col("reached")) + fn.ADAPTIVE_ENTRY).alias("bytes")), "sized")
    total, need = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    return policy.eviction_by_bytes(sized, total // 2, need)


# ---- counters of the query clock -----------------------------------------------------------------------------------
@register("streamed_counters", f"WITH RECURSIVE {ACC}, {LRU}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY q) AS k FROM acc) SELECT k.q, k.source, (k - 1) % 4 + 1 AS seen, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END::BIGINT AS promotes, CASE WHEN EXISTS (SELECT 1 FROM lru b WHERE b.victim = k.source AND k.q >= b.q AND k.q < b.q + 32) THEN 1 ELSE 0 END::BIGINT AS blocked FROM k")
def streamed_counters(spark, d):
    """Probation and cooldown of a streamed log: accesses and the evictions of a cache of four, in two files, with a restart between."""
    home = _home(spark)
    c = materialise(policy.lru(_acc(spark, d), 4), "lru")
    events = c.select("q", "source", F.lit(False).alias("evicted")).unionByName(c.where("victim is not null").select("q", F.col("victim").alias("source"), F.lit(True).alias("evicted")))
    half = (c.agg(F.max("q")).first()[0] or 0) // 2
    for part in (events.where(F.col("q") <= half), events.where(F.col("q") > half)):
        part.repartition(1).write.mode("append").parquet(f"{home}/in")
        ct.run_counters(spark, f"{home}/in", f"{home}/out", f"{home}/state")
    return spark.read.schema("q long, source long, seen long, promotes long, blocked long").parquet(f"{home}/out")


# ---- accounts ------------------------------------------------------------------------------------------------------
@register("preflight_budget", f"WITH {OPS}, p AS (SELECT count(DISTINCT source) AS sources, (SELECT max(n) FROM size) * 44 AS each FROM optrace) SELECT sources, sources * each AS bytes, least(sources, 100000 // each)::BIGINT AS most, sources * each <= 100000 AS fits FROM p")
def preflight_budget(spark, d):
    """Whether 100,000 bytes hold the tables of all sources of the log, and of how many else."""
    g, t = _log(spark, d)
    return policy.preflight(t, g.agg(F.max(F.greatest("src", "dst")) + 1).first()[0] or 0, 100_000)


RECORDS = f"""{ACC}, {LRU}, pr AS (SELECT q, sum(CASE WHEN k % 4 = 1 THEN 1 WHEN k % 4 = 0 THEN -1 ELSE 0 END) OVER (ORDER BY q) AS probation FROM (SELECT q, row_number() OVER (PARTITION BY source ORDER BY q) AS k FROM acc)),
cd AS (SELECT a.q, count(DISTINCT b.victim) AS cooldown FROM acc a LEFT JOIN lru b ON b.victim IS NOT NULL AND b.q <= a.q AND a.q < b.q + 32 GROUP BY 1),
rs AS (SELECT q, sum(1 - hit - CASE WHEN victim IS NULL THEN 0 ELSE 1 END) OVER (ORDER BY q) AS residents FROM lru WHERE q > 0),
acct AS (SELECT q, residents::BIGINT AS residents, probation::BIGINT AS probation, cooldown::BIGINT AS cooldown, (residents * (8 + 44 * (SELECT max(n) FROM size) + 100) + 16 * probation + 12 * cooldown)::BIGINT AS bytes FROM rs JOIN pr USING (q) JOIN cd USING (q))"""


@register("byte_accounting_records", f"WITH RECURSIVE {RECORDS} SELECT q, residents, probation, cooldown, bytes, max(bytes) OVER (ORDER BY q) AS peak FROM acct")
def byte_accounting_records(spark, d):
    """Bytes of tables and of probation and cooldown records after every access of a cache of four, and their peak."""
    g, t = _log(spark, d)
    n = g.agg(F.max(F.greatest("src", "dst")) + 1).first()[0] or 0
    r = materialise(policy.records(materialise(policy.lru(policy.accesses(t), 4), "lru")), "records")
    return r.join(policy.account(r, n).withColumnRenamed("q", "q2"), F.col("q") == F.col("q2")).drop("q2")


@register("probation_by_work", f"WITH RECURSIVE {ACC}, deg AS (SELECT src AS v, count(*) AS n FROM flow GROUP BY 1), w AS (SELECT q, source, row_number() OVER (PARTITION BY source ORDER BY q) AS k, coalesce(n, 0) AS scans FROM acc LEFT JOIN deg ON v = source), p(source, k, q, seen, scans) AS (SELECT source, 0::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT source FROM w) UNION ALL SELECT p.source, w.k, w.q, CASE WHEN p.seen >= 4 AND p.scans >= 0.05 * (SELECT max(m) FROM size) THEN 0 ELSE p.seen END + 1, CASE WHEN p.seen >= 4 AND p.scans >= 0.05 * (SELECT max(m) FROM size) THEN 0 ELSE p.scans END + w.scans FROM p JOIN w ON w.source = p.source AND w.k = p.k + 1) SELECT q, source, seen, scans::BIGINT AS scans, CASE WHEN seen >= 4 AND scans >= 0.05 * (SELECT max(m) FROM size) THEN 1 ELSE 0 END::BIGINT AS promotes FROM p WHERE k > 0")
def probation_by_work(spark, d):
    """Promotions by frequency and work, a search's work being the edges out of its source."""
    g, t = _log(spark, d)
    deg = g.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    acc = policy.accesses(t).join(deg, F.col("source") == F.col("v"), "left").select("q", "source", F.coalesce("n", F.lit(0)).alias("scans"))
    return policy.probation_by_work(acc, g.count(), ratio=0.05)


@register("strict_numbers", "WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN '-' || o_custkey WHEN 1 THEN ' ' || o_custkey WHEN 2 THEN '00' || o_custkey WHEN 3 THEN '1844674407370955' || (1000 + o_custkey % 9000) WHEN 4 THEN '' WHEN 5 THEN o_custkey || 'x' ELSE o_custkey::VARCHAR END AS x FROM orders) SELECT id, CASE WHEN regexp_full_match(x, '[0-9]+') AND x::HUGEINT < 18446744073709551616 THEN (x::HUGEINT)::DECIMAL(20, 0) END AS number, CASE WHEN regexp_full_match(x, '[0-9]+') AND x::HUGEINT < 4294967296 THEN (x::HUGEINT)::DECIMAL(20, 0) END AS small FROM t")
def strict_numbers(spark, d):
    """Digits only, within 64 and 32 bits; signs, blanks, letters and what is too large are none."""
    k, c = F.col("o_orderkey") % 7, F.col("o_custkey").cast("string")
    x = F.when(k == 0, F.concat(F.lit("-"), c)).when(k == 1, F.concat(F.lit(" "), c)).when(k == 2, F.concat(F.lit("00"), c)).when(k == 3, F.concat(F.lit("1844674407370955"), (1000 + F.col("o_custkey") % 9000).cast("string"))).when(k == 4, "").when(k == 5, F.concat(c, F.lit("x"))).otherwise(c)
    return views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), fn.unsigned(x, strict=False).alias("number"), fn.unsigned(x, 32, strict=False).alias("small"))
