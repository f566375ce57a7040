"""As-of joins, interval labels, stack distances, evictions by bytes, and ordered text, against plain versions."""

import random
from collections import OrderedDict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pathloom.functions import scalar, tables
from pathloom.operators import history as hs, policy, repair, stats, trace as tr
from pathloom.sources import dimacs, text, traces, workloads

from .test_trees import plain

INF = hs.INF


def test_asof_takes_the_last_version(spark):
    r = random.Random(1)
    versions = [(r.choice([None, 0, 0, 0, 1]), r.randrange(300), r.randrange(9)) for _ in range(200)]
    probes = [(r.choice([None, 0, 1, 2]), r.choice([None, *range(0, 310, 3)]), i) for i in range(400)]
    want = []
    for k, t, i in probes:
        fits = [(since, w) for k2, since, w in versions if k2 == k and t is not None and since <= t]
        want.append((k, t, i, max(fits)[1] if fits else None))
    p, v = spark.createDataFrame(probes, "k long, at long, id long"), spark.createDataFrame(versions, "k long, since long, w long")
    for bits in (0, 4, 12):
        got = hs.asof(p, v, ["k"], "at", "since", ["w"], bits)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert hs.asof(p.limit(0), v, ["k"], "at", "since", ["w"]).collect() == []
    assert [x.w for x in hs.asof(p, v.limit(0), ["k"], "at", "since", ["w"]).collect()] == [None] * 400


interval = st.tuples(st.integers(0, 20), st.integers(1, 10), st.integers(0, 5), st.booleans())


@given(st.lists(interval, max_size=12))
@settings(max_examples=200, deadline=None)
def test_envelopes_are_the_least_of_every_epoch(rows):
    rows = sorted((a, a + n, d, old) for a, n, d, old in rows)
    got = list(hs._envelope((1, 2, *x) for x in rows))
    at = {}
    for _, _, a, b, d, fresh in got:
        assert a < b
        for e in range(a, b):
            assert e not in at
            at[e] = (d, fresh)
    want = {e: min((d, not old) for a, b, d, old in rows if a <= e < b) for e in range(40) if any(a <= e < b for a, b, *_ in rows)}
    assert at == want
    assert all(x[3] != y[2] or x[4:] != y[4:] for x, y in zip(got, got[1:]))


def test_interval_labels_follow_changes(spark):
    g = dimacs.from_rows(spark, 4, [(0, 1, 5), (1, 2, 1), (0, 2, 9), (2, 3, 0)])
    log = [(0, "UPDATE", None, None, 0, 5, 20), (1, "UPDATE", None, None, 3, 0, 4), (2, "UPDATE", None, None, 0, 20, 5)]
    versions = tr.edge_versions(g, spark.createDataFrame(log, traces.TRACE_SCHEMA))
    seeds = spark.createDataFrame([(0, 0, 4)], "source long, valid_from long, valid_to long")
    got = sorted(tuple(x)[1:] for x in hs.interval_labels(versions, seeds).collect())
    assert got == [(0, 0, 4, 0), (1, 0, 1, 5), (1, 1, 3, 20), (1, 3, 4, 5), (2, 0, 1, 6), (2, 1, 3, 9), (2, 3, 4, 6), (3, 0, 1, 6), (3, 1, 2, 9), (3, 2, 3, 13), (3, 3, 4, 10)]


@given(st.lists(st.integers(0, 12), max_size=60))
@settings(max_examples=100, deadline=None)
def test_points_later_and_less(x):
    y = np.random.default_rng(len(x)).permutation(len(x))
    got = policy.later_and_less(np.array(x, np.int64), y)
    assert got.tolist() == [sum(x[j] < x[i] and y[j] > y[i] for j in range(len(x))) for i in range(len(x))]


@pytest.mark.parametrize("block", [None, 7])
def test_stack_distances_tell_the_hits_of_every_cache(spark, block):
    r = random.Random(5)
    sources = [r.choice([0, 0, 0, r.randrange(25)]) for _ in range(250)]
    acc = spark.createDataFrame([(q + 1, q, s) for q, s in enumerate(sources)], "q long, op_seq long, source long")
    got = policy.stack_distances(acc, block).cache()
    for x in got.collect():
        before = [i for i in range(x.q - 1) if sources[i] == x.source]
        assert x.distance == (len(set(sources[before[-1] + 1 : x.q - 1])) if before else None)
    hits = {x.capacity: (x.hits, x.misses) for x in policy.hits_by_capacity(got, 30).collect()}
    for cap in range(1, 31):
        cache, n = OrderedDict(), 0
        for s in sources:
            n += s in cache
            cache[s] = None
            cache.move_to_end(s)
            if len(cache) > cap:
                cache.popitem(last=False)
        assert hits[cap] == (n, 250 - n)
    assert policy.stack_distances(acc.limit(0), block).collect() == []


def test_evictions_by_bytes(spark):
    r = random.Random(2)
    rows = [(i, float(r.randrange(6)), r.randrange(1, 60)) for i in range(80)]
    df, total = spark.createDataFrame(rows, "source long, score double, bytes long"), sum(b for *_, b in rows)
    for budget, need, cap in ((total // 2, 30, None), (total + 30, 30, None), (total, 30, None), (40, 30, None), (10, 30, None), (total + 99, 1, 20), (total // 3, 5, 70), (total, 1, 0)):
        gone, free, count = set(), budget - total, 80
        if need <= budget and cap != 0:
            for s, score, b in sorted(rows, key=lambda x: (x[1], x[0])):
                if need <= free and (cap is None or count < cap):
                    break
                gone.add(s)
                free, count = free + b, count - 1
        assert {x.source for x in policy.eviction_by_bytes(df, budget, need, cap).where("victim = 1").collect()} == gone, (budget, need, cap)


def test_range_sums_split_ties(spark):
    df = spark.range(2000).selectExpr("id", "0L as same")
    out = tables.range_sum(df.repartition(4), [F.asc("same"), F.asc("id")], F.col("id"), "upto")
    assert out.where("upto <> id * (id + 1) div 2").count() == 0 and out.count() == 2000


def test_lines_keep_their_order_over_splits_and_parts(spark, tmp_path):
    big = "\n".join(f"line {i} " + "x" * (i % 50) for i in range(5000)) + "\n"
    (tmp_path / "in").mkdir()
    for name, part in (("b", big), ("a", "first\n\nlast"), ("c", "")):
        (tmp_path / "in" / f"{name}.txt").write_text(part)
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = text.numbered_lines(spark, str(tmp_path / "in"))
        assert got.rdd.getNumPartitions() > 4
        assert [tuple(x) for x in got.orderBy("n").collect()] == list(enumerate(["first", "", "last", *big.splitlines()]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    r = random.Random(6)
    g = dimacs.from_rows(spark, 30, sorted((r.randrange(30), r.randrange(30), r.randrange(9)) for _ in range(400)))
    dimacs.write_graph(g.repartition(3), 30, str(tmp_path / "g"), parts=8)
    assert len(list((tmp_path / "g").glob("part-*"))) == 8
    assert sorted(map(tuple, dimacs.read_graph(spark, str(tmp_path / "g")).collect())) == sorted(map(tuple, g.collect()))
    log = spark.range(300).selectExpr("id as op_seq", "'QUERY' as kind", "id as source", "id * 7 as target", "null as edge_id", "null as old_weight", "null as new_weight")
    traces.write_trace(log.repartition(5), str(tmp_path / "t"), parts=8)
    assert [x.target for x in traces.read_trace(spark, str(tmp_path / "t")).orderBy("op_seq").collect()] == [7 * i for i in range(300)]
    assert len(list((tmp_path / "t").glob("part-*"))) == 8


@pytest.mark.parametrize("text, bits, want", [("0", 64, 0), ("007", 64, 7), ("18446744073709551615", 64, 2**64 - 1), ("18446744073709551616", 64, None), ("4294967295", 32, 2**32 - 1), ("4294967296", 32, None), ("", 64, None), ("+1", 64, None), ("-0", 64, None), (" 1", 64, None), ("1\n", 64, None), ("1e3", 64, None), ("0" * 40 + "5", 64, 5), ("9" * 40, 64, None), ("\u0661", 64, None)])
def test_numbers_are_digits_within_their_bits(spark, text, bits, want):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(scalar.unsigned(F.col("x"), bits, strict=False)).first()[0] == want
    if want is None:
        with pytest.raises(Exception, match="not a number"):
            df.select(scalar.unsigned(F.col("x"), bits)).collect()
    else:
        assert df.select(scalar.unsigned(F.col("x"), bits)).first()[0] == want


def test_records_and_work(spark):
    r = random.Random(3)
    acc = [(q + 1, q, r.randrange(7), r.randrange(9)) for q in range(200)]
    df = spark.createDataFrame(acc, "q long, op_seq long, source long, scans long")
    log = policy.lru(df, 2).cache()
    seen, until, held = {}, {}, set()
    want = []
    for x in sorted(log.collect(), key=lambda x: x.q):
        seen[x.source] = seen.get(x.source, 0) + 1
        if seen[x.source] == 4:
            del seen[x.source]
        if x.victim is not None:
            until[x.victim] = x.q + 10
            held.discard(x.victim)
        held.add(x.source)
        want.append((x.q, len(held), len(seen), sum(u > x.q for u in until.values())))
    assert sorted(map(tuple, policy.records(log, 4, 10).collect())) == want
    state, out = {}, []
    for q, _, s, scans in acc:
        n, w = state.get(s, (0, 0))
        n, w = n + 1, w + scans
        up = n >= 3 and w >= 0.5 * 40
        out.append((q, s, n, w, int(up)))
        state[s] = (0, 0) if up else (n, w)
    assert sorted(map(tuple, policy.probation_by_work(df, 40, 3, 0.5).collect())) == out
    assert policy.preflight(spark.createDataFrame([("QUERY", 3), ("QUERY", 3), ("UPDATE", None)], "kind string, source long"), 10, 439).first().asDict() == {"sources": 1, "bytes": 440, "most": 0, "fits": False}
    with pytest.raises(ValueError):
        policy.preflight(df, 10, 0)


def test_descriptions_come_back(spark, tmp_path):
    w = workloads.Workload(queries=40)
    text = workloads.describe(w, "a" * 64, "b" * 64, 10, 20, 7, {"query_count": 40, "update_count": 3, "increase_count": 1, "decrease_count": 2})
    workloads.write_description(spark, text, str(tmp_path / "d"))
    [(head, back)] = workloads.read_descriptions(spark, str(tmp_path / "d"))
    assert back == w and head["seed"] == 7
    for n, (old, new) in enumerate([('"seed"', '"sead"'), ("pathloom-workload-2", "other"), ('"burst_length": 1', '"burst_length": 2'), ('"query_count": 40,\n    "up', '"query_count": "40",\n    "up'), (w.family, "unheard-of")]):
        assert old in text
        workloads.write_description(spark, text.replace(old, new), str(tmp_path / f"bad{n}"))
        with pytest.raises(ValueError):
            workloads.read_descriptions(spark, str(tmp_path / f"bad{n}"))


def test_whole_logs_are_classified_as_of_each_update(spark):
    r = random.Random(7)
    rows = [(r.randrange(12), r.randrange(12), r.randrange(1, 9)) for _ in range(40)]
    weights, log = [w for *_, w in rows], []
    for i in range(60):
        e, w = r.randrange(40), r.randrange(1, 9)
        log.append((i, "UPDATE", None, None, e, weights[e], w))
        weights[e] = w
    g, t = dimacs.from_rows(spark, 12, rows), spark.createDataFrame(log, traces.TRACE_SCHEMA)
    src = spark.createDataFrame([(0,), (5,)], "source long")
    got = {(x.op_seq, x.source): x.outcome for x in repair.classify_log(g, t, src).collect()}
    now, want = [list(x) for x in rows], {}
    for i, _, _, _, e, _, w in log:
        for s in (0, 5):
            dist, par = plain([tuple(x) for x in now], s)
            u, v, old = now[e]
            du, dv = dist.get(u, INF), dist.get(v, INF)
            tight = du < INF and du + old == dv
            want[i, s] = "unchanged" if w == old else ("filtered" if du >= INF or du + w >= dv else "repair_decrease") if w < old else "filtered" if not tight else "repair_increase" if v != s and par[v][0] == e else "rebuild"
        now[e][2] = w
    assert got == want


def test_ranks_of_heavy_tails_and_ties(spark):
    r = random.Random(1)
    rows = [(g, x) for g, n in (("a", 900), ("b", 1), (None, 40), ("c", 2)) for x in [r.choice([0.5, 10.0 ** r.randint(-9, 12), float(r.randrange(5))]) for _ in range(n)]] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    ranks = {"p50": stats.nearest_rank(0.5), "p95": stats.rounded_index(0.95), "top": F.col("n")}
    for bits in (0, 3, 16):
        got = {x.g: (x.n, x.p50, x.p95, x.top) for x in stats.values_at(df, ["g"], "x", ranks, bits).collect()}
        want = {}
        for g in ("a", "b", None, "c"):
            xs = sorted(x for h, x in rows if h == g and x is not None)
            want[g] = (len(xs), xs[max(0, -(-len(xs) // 2) - 1)], xs[round((len(xs) - 1) * 0.95)], xs[-1])
        assert got == want
    assert stats.values_at(df.limit(0), ["g"], "x", ranks).collect() == []


def test_written_tables_are_released(spark):
    kept = tables.materialise(spark.range(5), "kept")
    folder = tables.own_dir(spark)
    assert kept.count() == 5 and spark.read.parquet(f"{folder}/kept-*").count() >= 5
    other = tables.materialise(spark.range(3), "dropped")
    tables.discard(other)
    with pytest.raises(Exception, match="dropped|PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(f"{folder}/dropped-*").count()


def test_weights_out_of_a_vertex_follow_its_changes(spark):
    r = random.Random(8)
    g = dimacs.from_rows(spark, 5, [(r.randrange(4), r.randrange(5), r.randint(1, 9)) for _ in range(14)])
    w, log = [x.weight for x in g.orderBy("edge_id").collect()], []
    for i in range(60):
        e, new = r.randrange(14), r.randint(1, 9)
        log.append((i, "UPDATE", None, None, e, w[e], new))
        w[e] = new
    v = tr.edge_versions(g, spark.createDataFrame(log, traces.TRACE_SCHEMA))
    rows, last = v.collect(), max(x.valid_from for x in v.collect())
    probes = spark.createDataFrame([(s, t) for s in range(6) for t in range(last + 3)], "source long, epoch long")
    out = hs.out_weights(v)
    got = {(x.source, x.epoch): (x.edges, x.total, x.least) for x in hs.asof(probes, out, ["source"], "epoch", "since", ["edges", "total", "least"]).collect()}
    for (s, t), found in got.items():
        now = [x.weight for x in rows if x.src == s and x.valid_from <= t < x.valid_to]
        assert found == ((len(now), sum(now), min(now)) if now else (None, None, None))
    assert out.count() <= len(rows)


def test_least_weights_stay_with_their_vertex_over_many_partitions(spark):
    r = random.Random(3)
    rows = [(e, e % 6, r.randint(1, 50), max(0, at - e), at - e + 40 if at < 120 else INF) for e in range(30) for at in range(0, 121, 40)]
    v = spark.createDataFrame(rows, "edge_id long, src long, weight long, valid_from long, valid_to long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(x.source, x.since, x.least) for x in hs.out_weights(v).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) > 60 and got == [(s, at, min(w for _, src, w, low, high in rows if src == s and low <= at < high)) for s, at, _ in got]


def test_intervals_cross_the_network_once_a_merge(spark):
    from pathloom.operators import history

    rows = spark.createDataFrame([(0, 1, 0, 4, 9, True), (0, 1, 0, 4, 7, False), (0, 1, 2, 6, 5, False), (0, 2, 1, 3, 4, True), (0, 2, 1, 3, 4, False)], "source long, v long, valid_from long, valid_to long, dist long, old boolean")
    out = history._merged(rows)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert sorted(map(tuple, out.collect())) == [(0, 1, 0, 2, 7, True), (0, 1, 2, 6, 5, True), (0, 2, 1, 3, 4, False)]


def test_tables_between_steps_have_no_marker(spark):
    t = tables.materialise(spark.range(5), "unmarked")
    home = spark._jvm.org.apache.hadoop.fs.Path(t._pathloom_path)
    names = [f.getPath().getName() for f in home.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(home)]
    assert names and all(n.startswith("part-") for n in names) and t.count() == 5


def test_replay_beyond_the_kernel_keeps_the_edges_that_paths_may_take(spark, monkeypatch):
    """A larger graph is thinned for the whole log, so that no labels of all sources and epochs are made."""
    r = random.Random(5)
    g = dimacs.from_rows(spark, 30, [(r.randrange(30), r.randrange(30), r.randint(0, 90)) for _ in range(700)])
    w, log = [x.weight for x in g.orderBy("edge_id").collect()], []
    for i in range(900):
        if r.random() < 0.5:
            log.append((i, "QUERY", r.randrange(32), r.randrange(32), None, None, None))
            continue
        e, new = r.randrange(700), r.choice([0, 1, 3, 40, 90, 200])
        log.append((i, "UPDATE", None, None, e, w[e], new))
        w[e] = new
    t = spark.createDataFrame(log, traces.TRACE_SCHEMA)
    want = sorted(map(tuple, tr._replay_relational(g, t).collect()))
    monkeypatch.setattr(tr, "_replay_relational", None)
    for most in (650, 1000):  # thinned to fewer than 650 with all updates sent; whole
        assert sorted(map(tuple, tr.replay(g, t, kernel_edges=most, slice_ops=100).collect())) == want
    monkeypatch.setattr(tr, "KERNEL_UPDATES", 100)  # more updates than go to all executors
    assert sorted(map(tuple, tr.replay(g, t, kernel_edges=650, slice_ops=100).collect())) == want


def test_large_graphs_go_bucket_by_bucket():
    """The same distances as by sweeps: with weights of 0, from several labels, over more distances than there may be buckets."""
    from pathloom.operators import relax as rx

    r = np.random.default_rng(4)
    for n, m, low in ((40, 300, 0), (60, 90, 1), (1, 0, 1)):
        g = rx.Csr(np.arange(m), r.integers(0, n, m), r.integers(0, n, m), r.integers(low, 9, m))
        k = len(g.names)
        for _ in range(20):
            dist = np.where(r.random(k) < 0.1, r.integers(0, 30, k), INF)
            assert g.spread(dist, large=-1).tolist() == g.spread(dist, large=1 << 20).tolist()
    chain = rx.Csr(np.arange(3000), np.arange(3000), np.arange(1, 3001), np.full(3000, 3))
    dist = np.full(3001, INF)
    dist[0] = 0
    assert chain._buckets(dist)[1] is False and chain.spread(dist, large=0).tolist() == list(range(0, 9001, 3))


def test_totals_of_all_sources_make_no_row_a_vertex(spark, monkeypatch):
    from pathloom.operators import relax as rx

    r = random.Random(6)
    g = dimacs.from_rows(spark, 12, [(r.randrange(12), r.randrange(12), r.randint(0, 9)) for _ in range(50)])
    src = spark.range(14).withColumnRenamed("id", "source")
    want = {}
    for x in rx.sssp(g, src).collect():
        want.setdefault(x.source, []).append(x.dist)
    found = [sorted(map(tuple, rx.totals(g, src, most).collect())) for most in (1000, 0)]
    assert found[0] == found[1] == sorted((s, len(d), sum(d), max(d)) for s, d in want.items())
    monkeypatch.setattr(rx, "sssp", None)
    assert sorted(map(tuple, rx.totals(g, src).collect())) == found[0]
