"""The sequential engine, the relational operators and the sources, on literal graphs."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.functions.scalar import INF
from pathloom.operators import policy, relax as rx, repair as rp, trace as tr, tree as tt
from pathloom.plans import engine as en
from pathloom.sources import dimacs, generators as gen, traces, workloads as wl

GOLDEN = "dac082c34b7b99ced8f8e9591903694024c4107ac0da61949982187f894a331b"
GOLDEN_EDGES = [(0, 1, 4), (1, 2, 3), (0, 2, 10), (2, 3, 2), (1, 3, 10), (3, 4, 1), (0, 4, 30)]
GOLDEN_LINES = ["QUERY 0 4", "UPDATE 2 10 5", "QUERY 0 3", "UPDATE 1 3 8", "QUERY 0 4"]


def chain(n):
    return [(i, i + 1, 1) for i in range(n - 1)]


def literal(engine, steps):
    out = []
    for s in steps:
        if s[0] == "q":
            out.append(engine.query(*s[1:]))
        else:
            engine.update(*s[1:])
    return out


@pytest.mark.parametrize("make", en.ENGINES.values(), ids=en.ENGINES)
@pytest.mark.parametrize(
    "n, edges, steps, want",
    [
        (3, [(0, 1, 1), (1, 2, 1)], [("q", 0, 2)] * 4 + [("u", 0, 0), ("q", 0, 2)], [2, 2, 2, 2, 1]),
        (4, [(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 20)], [("q", 0, 3)] * 5 + [("u", 0, 10), ("q", 0, 3)], [3] * 5 + [12]),
        (4, [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1)], [("q", 0, 3)] * 5 + [("u", 2, 10), ("q", 0, 3)], [2] * 6),
        (5, [(0, 1, 5), (0, 2, 1), (2, 1, 1), (1, 3, 1), (3, 4, 1)], [("q", 0, 4)] * 5 + [("u", 2, 10), ("q", 0, 4), ("u", 0, 20), ("q", 0, 4)], [4] * 5 + [7, 13]),
        (7, [(0, 1, 0), (0, 2, 0), (1, 3, 5), (2, 3, 5), (3, 4, 9), (3, 4, 1)], [("q", 0, v) for v in range(7)] + [("q", 4, 0)], [0, 0, 0, 5, 6, INF, INF, INF]),
        (3, [(0, 1, INF - 2), (1, 2, 100), (0, 2, INF - 1)], [("q", 0, 2)] * 5, [INF - 1] * 5),
        (4, [(0, 1, 7), (0, 1, 2), (1, 2, 0), (2, 3, 1)], [("q", 0, 3)] * 5 + [("u", 1, 9), ("q", 0, 3), ("u", 0, 1), ("q", 0, 3), ("u", 2, 5), ("q", 0, 3)], [3] * 5 + [8, 2, 7]),
    ],
)
def test_literal_cases(make, n, edges, steps, want):
    assert literal(make(en.Graph(n, edges)), steps) == want


def test_increase_counts_its_work():
    r = en.Resident(en.Graph(6, [*chain(6), (0, 5, 20)]), 0)
    r.g.edges[0][2] = 10
    outcome, work = r.increased(0, 1, 100, 100, float("inf"))
    assert (outcome, work["discovered_vertices"], work["tree_edges"], r.dist[5]) == ("repaired", 5, 4, 14)


def test_abort_leaves_the_state_alone():
    r = en.Resident(en.Graph(6, chain(6)), 0)
    before = list(r.dist), list(r.parent)
    r.g.edges[0][2] = 9
    assert r.increased(0, 1, 1, 1, float("inf"))[0] == "abort" and (r.dist, r.parent) == before


def test_a_long_chain_is_cut_once():
    e = en.Engine(en.Graph(20_000, chain(20_000)), en.Config(admission="frequency"))
    assert [e.query(0, 19_999) for _ in range(5)] == [19_999] * 5
    e.update(0, 100)
    assert e.query(0, 19_999) == 20_098 and e.stats["aborts"] == 1


def test_lru_counts():
    b = en.BoundedResident(en.Graph(6, chain(6)), cap=2)
    seen = []
    for s in (0, 1, 0, 2, 1):
        b.query(s, 5)
        seen.append((b.hits, b.misses, b.evictions))
    assert seen == [(0, 1, 0), (0, 2, 0), (1, 2, 0), (1, 3, 1), (1, 4, 2)]


@pytest.mark.parametrize("seed", range(4))
def test_engines_agree_on_random_logs(seed):
    r = random.Random(seed)
    edges = [(r.randrange(35), r.randrange(35), r.randrange(21)) for _ in range(220)]
    ops = [(i, "UPDATE", r.randrange(220), r.randrange(21)) if r.random() < 1 / 3 else (i, "QUERY", r.randrange(6) if r.random() < 0.7 else r.randrange(35), r.randrange(35)) for i in range(1500)]
    want = en.run_trace(en.Fresh(en.Graph(35, edges)), ops)
    for name, make in en.ENGINES.items():
        assert en.run_trace(make(en.Graph(35, edges)), ops) == want, name
    full = en.Engine(en.Graph(35, edges), en.Config(probation=2, scan_ratio=0.1))
    en.run_trace(full, ops)
    assert len(full.residents) <= 4 and full.stats["promotions"] and full.stats["increase_repairs"]


def test_byte_budget_is_kept():
    one = 8 + 44 * 6 + 100
    e = en.Engine(en.Graph(6, chain(6)), en.Config(admission="frequency", bytes=one + 40))
    for s in (0, 0, 0, 0, 1, 1, 1, 1, 2):
        e.query(s, 5)
    assert len(e.residents) == 1 and e.stats["peak_bytes"] <= one + 40
    small = en.Engine(en.Graph(6, chain(6)), en.Config(admission="frequency", bytes=one - 1))
    assert [small.query(0, 5) for _ in range(9)] == [5] * 9 and not small.residents


def test_unknown_ids_raise():
    e = en.Engine(en.Graph(3, chain(3)))
    for f in (lambda: e.query(0, 3), lambda: e.query(-1, 0), lambda: e.update(2, 1), lambda: e.update(0, -1), lambda: en.Graph(2, [(0, 2, 1)])):
        with pytest.raises(IndexError):
            f()


def _golden(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("".join(x + "\r\n" for x in GOLDEN_LINES))
    return dimacs.from_rows(spark, 5, GOLDEN_EDGES), traces.read_trace(spark, str(p))


def test_golden_trace(spark, tmp_path):
    g, t = _golden(spark, tmp_path)
    assert tr.trace_sha256(t).first()[0] == GOLDEN
    assert tuple(tr.counts(t).first()) == (3, 2, 1, 1)
    assert tr.validation_errors(t, g, 5).isEmpty()
    bad = t.withColumn("old_weight", F.when(F.col("op_seq") == 1, 11).otherwise(F.col("old_weight")))
    assert [tuple(r) for r in tr.validation_errors(bad, g, 5).collect()] == [(1, "old_weight")]
    answers = tr.replay(g, t).select("op_seq", "answer")
    assert sorted(map(tuple, answers.collect())) == [(0, 10), (2, 7), (4, 8)]
    assert tr.mismatches(answers, en.replay_engines(g, t, ["FULL"]).select("op_seq", "answer")).isEmpty()
    traces.write_trace(t, str(tmp_path / "w"))
    traces.write_answers(t, answers, GOLDEN, str(tmp_path / "a"))
    assert sorted(map(tuple, traces.read_trace(spark, str(tmp_path / "w")).collect())) == sorted(map(tuple, t.collect()))
    assert sorted(map(tuple, traces.read_answers(spark, str(tmp_path / "a"), GOLDEN).collect())) == [(0, 10), (2, 7), (4, 8)]
    with pytest.raises(ValueError):
        traces.read_answers(spark, str(tmp_path / "a"), "0" * 64)


@pytest.mark.parametrize("line", ["", "QUERY 1", "QUERY 1 2 3", "UPDATE 1 2", "PUSH 1 2", "QUERY -1 2", "QUERY 4294967296 1"])
def test_bad_lines_raise(spark, tmp_path, line):
    (tmp_path / "t.txt").write_text("QUERY 0 1\n" + line + "\n")
    with pytest.raises(ValueError):
        traces.read_trace(spark, str(tmp_path / "t.txt"))


def test_dimacs(spark, tmp_path):
    p = tmp_path / "g.gr"
    p.write_text("c x\np sp 9 9\na 1 2 3\np sp 3 3\na 1 2 5\nc y\nz 1\na 2 3 18446744073709551615\na 3 1 0\n")
    g = dimacs.read_graph(spark, str(p))
    assert sorted(map(tuple, g.collect())) == [(0, 0, 1, 5), (1, 1, 2, INF), (2, 2, 0, 0)]
    dimacs.write_graph(g, 3, str(tmp_path / "out"))
    assert sorted(map(tuple, dimacs.read_graph(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, g.collect()))
    assert tuple(dimacs.arc_counts(spark, str(tmp_path / "out")).first()) == (3, 3, 3)
    for text in ("a 1 2 3\n", "p sp 0 0\n", "p sp 2 1\na 1 3 1\n"):
        p.write_text(text)
        with pytest.raises((ValueError, IndexError)):
            dimacs.read_graph(spark, str(p))
    c = tmp_path / "c.co"
    c.write_text("c x\nv 1 -5 7\nv 2 0 2147483647\n")
    assert sorted(map(tuple, dimacs.read_coordinates(spark, str(c), 2).collect())) == [(0, -5, 7), (1, 0, 2147483647)]
    for text in ("v 1 1\n", "v 0 1 1\n", "v 1 1 1\nv 1 1 1\n", "v 2 1 1\n", "v 1 1 2147483648\n"):
        c.write_text(text)
        with pytest.raises(ValueError):
            dimacs.read_coordinates(spark, str(c))


def test_relational_loop_equals_kernel_and_repairs_equal_recompute(spark):
    r = random.Random(3)
    g = dimacs.from_rows(spark, 25, [(r.randrange(25), r.randrange(25), r.randrange(1, 15)) for _ in range(90)])
    src = spark.createDataFrame([(0,), (3,)], "source long")
    want = sorted(map(tuple, rx.sssp(g, src).collect()))
    dist = rx.sssp(g, src, kernel_edges=0)
    assert sorted(map(tuple, dist.collect())) == want
    dist = dist.where("source = 0")
    tree = tt.parents(g, dist)
    e = tree.orderBy("parent_edge").first()["parent_edge"]
    up = rp.set_weight(g, e, 40)
    again = lambda x: sorted(map(tuple, rx.sssp(x, src.where("source = 0")).collect()))
    assert sorted(map(tuple, rp.repair_increase(up, dist, tree, e).collect())) == again(up)
    down = rp.set_weight(g, 7, 0)
    assert sorted(map(tuple, rp.repair_decrease(down, dist, 7).collect())) == again(down)
    assert rx.bidirectional(g, 0, 9).first()[0] == dict((v, d) for s, v, d in want if s == 0).get(9, INF)


def test_lru_in_ranges_equals_a_cache(spark):
    r = random.Random(9)
    acc = [(q + 1, q, r.randrange(9)) for q in range(150)]
    for cap, ops in ((1, 7), (2, 1 << 16), (4, 16), (20, 16), (0, 16)):
        cache, want = [], []
        for q, _, s in acc:
            hit, victim = s in cache, None
            if not hit and len(cache) >= cap > 0:
                victim = cache[0]
                cache = cache[1:]
            cache = ([x for x in cache if x != s] + [s]) if cap else []
            want.append((q, s, int(hit), victim))
        got = policy.lru(spark.createDataFrame(acc, "q long, op_seq long, source long"), cap, ops).collect()
        assert sorted(tuple(x) for x in got) == want


@pytest.mark.parametrize("seed", range(3))
def test_replay_in_ranges_equals_the_relational_loop_and_engines(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(20), r.randrange(20), r.randrange(1, 15)) for _ in range(70)]
    g, weights, log = dimacs.from_rows(spark, 20, edges), [w for *_, w in edges], []
    for i in range(120):
        if r.random() < 0.5:
            e, w = r.randrange(70), r.randrange(1, 15)
            log.append((i, "UPDATE", None, None, e, weights[e], w))
            weights[e] = w
        else:
            log.append((i, "QUERY", r.randrange(20), r.randrange(20), None, None, None))
    t = spark.createDataFrame(log, traces.TRACE_SCHEMA)
    want = sorted((x.op_seq, x.answer) for x in tr.replay(g, t, kernel_edges=0).collect())
    for ops in (None, 7, 1000):
        assert sorted((x.op_seq, x.answer) for x in tr.replay(g, t, slice_ops=ops).collect()) == want
    for x in en.replay_engines(g, t).groupBy("engine").agg(F.array_sort(F.collect_list(F.struct("op_seq", "answer"))).alias("a")).collect():
        assert [tuple(y) for y in x.a] == want, x.engine
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(20) if a < 2 or b < 3], "source long, target long")
    by_kernel = sorted(map(tuple, rx.distances(g, pairs).select("source", "target", "dist").collect()))
    assert by_kernel == sorted(map(tuple, rx.distances(g, pairs, kernel_edges=0).select("source", "target", "dist").collect()))


def test_a_long_chain_takes_few_rounds(spark):
    n = 3000
    tree = spark.range(1, n).selectExpr("0L as source", "id as v", "id - 1 as parent", "id - 1 as parent_edge")
    sizes = {x.v: x["size"] for x in tt.subtree_sizes(tree).collect()}
    assert sizes == {v: n - v for v in range(n)}
    assert sorted(x.v for x in tt.subtree(tree, n // 2).collect()) == list(range(n // 2, n))
    assert tt.subtree(tree, n // 2, most=10) is None


def test_sweeps_equal_the_heap(spark):
    r = random.Random(13)
    made = [[(r.randrange(30), r.randrange(30), r.choice([0, 1, 5, INF - 3, INF])) for _ in range(90)] for _ in range(5)]
    for rows in [*made, chain(200)]:
        csr = rx.csr_of(dimacs.from_rows(spark, 200, rows))
        for s in csr.names.tolist()[::7]:
            assert csr.table(s).tolist() == csr.from_source(s)[0]


@pytest.mark.parametrize("kernel", [0, 1 << 20])
def test_light_edges_first_equal_plain_rounds(spark, kernel):
    r = random.Random(11)
    edges = [(i, r.randrange(60), r.randrange(60), r.choice([0, 1, 1, 2, 9, 40])) for i in range(500)]
    edges += [(500 + i, 100 + i, 101 + i, 1) for i in range(12)] + [(590, 0, 100, 50), (591, 3, 111, 70), (592, 700, 701, 2)]
    g = spark.createDataFrame(edges, "edge_id long, src long, dst long, weight long")
    seeds = spark.createDataFrame([(s, s, 0) for s in (0, 3, 700, 999)] + [(3, 105, 4)], "source long, v long, dist long")
    want = sorted(map(tuple, rx.relax(seeds, g, ["source"]).select("source", "v", "dist").collect()))
    for degree in (4,):
        assert sorted(map(tuple, rx.relax_few(seeds, g, kernel, many=0, degree=degree).select("source", "v", "dist").collect())) == want
    assert sorted(map(tuple, rx.relax_few(seeds, g, kernel).select("source", "v", "dist").collect())) == want


def test_rounds_over_a_large_graph_do_not_follow_hops(spark, monkeypatch):
    chain = [(i, i, i + 1, 1) for i in range(200)] + [(200 + i, i, (i * 7) % 200, 90) for i in range(200)]
    g = spark.createDataFrame(chain, "edge_id long, src long, dst long, weight long")
    rounds, plain = [], rx._round
    monkeypatch.setattr(rx, "_round", lambda *a, **k: (rounds.append(1), plain(*a, **k))[1])
    seeds = spark.createDataFrame([(0, 0, 0)], "source long, v long, dist long")
    assert len(rx.relax_few(seeds, g, many=0, degree=1).collect()) == 201 and len(rounds) < 10


def test_repairs_over_a_large_graph_equal_recompute(spark, monkeypatch):
    monkeypatch.setattr(rp, "KERNEL_EDGES", 0)
    r = random.Random(13)
    g = spark.createDataFrame([(i, r.randrange(40), r.randrange(40), r.randrange(1, 9)) for i in range(200)], "edge_id long, src long, dst long, weight long")
    dist = rx.sssp(g, spark.createDataFrame([(0,), (1,)], "source long")).cache()
    e = g.where("weight > 4").first()["edge_id"]
    low = rp.set_weight(g, e, 0)
    want = sorted(map(tuple, rx.sssp(low, spark.createDataFrame([(0,), (1,)], "source long")).collect()))
    assert sorted(map(tuple, rp.repair_decrease(low, dist, e).select("source", "v", "dist").collect())) == want
    one = dist.where("source = 0")
    tree = tt.parents(g, one).cache()
    e = tree.first()["parent_edge"]
    up = rp.set_weight(g, e, 60)
    want = sorted(map(tuple, rx.sssp(up, spark.createDataFrame([(0,)], "source long")).collect()))
    assert sorted(map(tuple, rp.repair_increase(up, one, tree, e).select("source", "v", "dist").collect())) == want


def test_next_edge_goes_round(spark):
    g = dimacs.from_rows(spark, 3, [(0, 1, w) for w in (1, 9, 2, 9, 3)])
    got = {x.start: x.edge_id for x in rp.next_edge(g, F.col("weight") == 9, spark.range(5).withColumnRenamed("id", "start")).collect()}
    assert got == {0: 1, 1: 1, 2: 3, 3: 3, 4: 1}
    assert {x.edge_id for x in rp.next_edge(g, F.col("weight") > 99, spark.range(5).withColumnRenamed("id", "start")).collect()} == {None}


def test_generators(spark):
    for g, n in ((gen.uniform(spark, 50), 300), (gen.clustered(spark, 100, 10), 600), (gen.preferential(spark, 40), 20 + 8 * 35), (gen.small_world(spark, 60), None)):
        assert n is None or g.count() == n == g.select("src", "dst").distinct().count()
        assert g.where("src = dst or weight < 1 or weight > 100000").isEmpty()
    assert gen.grid(spark, 10).count() == 360


def test_the_twister_draws_its_published_number():
    r = wl.Mt64(5489)
    assert [r() for _ in range(10_000)][-1] == 9981545732273789042


@pytest.mark.parametrize("family", wl.FAMILIES)
def test_workload_sources(spark, family):
    n, weights = 9, [7, 3, 40, 300, 12, 5]
    rows = lambda seed: wl._workload(n, list(weights), seed, wl.Workload(40, 0, family, 4, 5)).rows
    sources = [x[2] for x in rows(77)]
    assert rows(77) == rows(77) and len(sources) == 40
    assert len(set(sources)) <= {"single-hot": 1, "uniform": 9}.get(family, 4)
    if family == "churn":
        assert len(set(sources[:4])) == 4


@pytest.mark.parametrize("mode", wl.MODES)
def test_workload_updates(mode):
    rows = wl._workload(9, [7, 3, 40, 300, 12, 5], 91, wl.Workload(30, 2, "hot-pool", 4, 5, 90, mode, "small", 3)).rows
    ups = [x for x in rows if x[1] == "UPDATE"]
    assert len(ups) == 14 and all(1 <= abs(x[6] - x[5]) <= 3 for x in ups)
    grown = [x[6] > x[5] for x in ups]
    if mode == "increase-only":
        assert all(grown)
    elif mode == "decrease-only":
        assert not any(grown)
    elif mode != "balanced-random":
        assert grown == [i % 2 == 0 for i in range(14)]
    if mode == "repeated-edge":
        assert len({x[4] for x in ups}) == 1 and {x[5] for x in ups} | {x[6] for x in ups} == {ups[0][5], ups[0][6]}
    assert any(a[1] == b[1] == "UPDATE" for a, b in zip(rows, rows[1:])) == (mode == "bursty")


def test_update_slots_and_bad_workloads():
    assert wl.update_slots(100, 5) == list(range(5, 100, 5)) and wl.update_slots(1, 5) == wl.update_slots(9, 0) == []
    assert wl.update_slots(30, 10, 3) == [20, 20]
    for bad in ({"queries": 0}, {"queries": 1, "interval": 3}, {"queries": 1, "locality": 101}, {"queries": 1, "hot": 0}, {"queries": 1, "mode": "x"}, {"queries": 1, "epoch": 0}):
        with pytest.raises(ValueError):
            wl.Workload(**bad)
    assert wl.Workload(10).canonical().split("\n")[:2] == ["workload_generator_version=2", "query_count=10"]
    assert [wl.zipf_place(x, 3) for x in (0, 999_999, 1_000_000, 1_499_999, 1_500_000)] == [0, 0, 1, 1, 2]


def test_fast_admission_takes_the_plain_gap():
    # after gaps of 40 and 2 the candidate's gap is 2, not their smoothed mean
    e = en.Engine(en.Graph(40, chain(40)), en.PROFILES["ECONOMIC-FAST"])
    e.query(0, 39)
    for s in range(1, 38):
        e.query(s, 39)
    before = e.stats["promotions"]
    e.query(0, 39)
    e.query(38, 39)
    e.query(0, 39)
    assert before == 0 and e.stats["promotions"] == 1 and 0 in e.residents


def test_rebuilds_are_counted_when_due():
    for make in (lambda g: en.AlwaysResident(g, "rebuild"), lambda g: en.BoundedResident(g, "rebuild")):
        x = make(en.Graph(6, chain(6)))
        assert [x.query(0, 5), x.query(1, 5)] == [5, 4]
        for w in (2, 3, 3):
            x.update(2, w)
        assert x.query(0, 5) == 7 and x.stats["rebuilds"] == 4


def test_a_restarted_stream_goes_on(spark, tmp_path):
    from pathloom.streaming.replay import ReplayStream

    edges = [(0, 1, 4), (1, 2, 3), (0, 2, 10)]
    log = [(0, "QUERY", 0, 2, None, None, None), (1, "UPDATE", None, None, 1, 3, 1), (2, "QUERY", 0, 2, None, None, None), (3, "UPDATE", None, None, 0, 4, 20), (4, "QUERY", 0, 2, None, None, None)]
    part = lambda a, b: spark.createDataFrame(log[a:b], traces.TRACE_SCHEMA)
    make = lambda: ReplayStream(en.Engine(en.Graph(3, edges)), f"{tmp_path}/out")
    make().resume(spark).batch(part(0, 2), 0)
    again = make().resume(spark)
    again.batch(part(0, 2), 0)  # comes again, is skipped
    again.batch(part(2, 5), 1)
    assert again.next == 5 and sorted((r.op_seq, r.answer) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(0, 7), (2, 5), (4, 10)]
    with pytest.raises(ValueError):
        make().resume(spark).batch(part(2, 5), 2)


def test_gaps_hold_where_record_batches_cut_a_source(spark, tmp_path):
    """Rows of a source that come in no order and in several Arrow batches, and a second run that goes on from the state."""
    from pathloom.streaming.replay import reuse_gap_stream

    r, conf = random.Random(4), "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [(i, "QUERY", r.choice([None, 0, 1, 2])) for i in range(600)]
    want, last = [], {}
    for i, _, s in rows:
        want.append((s, i, i - last[s] if s in last else None))
        last[s] = i
    was = spark.conf.get(conf)
    spark.conf.set(conf, "20")
    try:
        for part in (rows[:300], rows[300:]):
            spark.createDataFrame(r.sample(part, 300), "op_seq long, kind string, source long").write.mode("append").parquet(f"{tmp_path}/in")
            log = spark.readStream.schema("op_seq long, kind string, source long").parquet(f"{tmp_path}/in")
            reuse_gap_stream(log).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(conf, was)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("cap", [1, 3, 4, 9])
def test_counters_of_the_log_are_those_of_the_engines(spark, cap):
    r = random.Random(cap)
    edges = [(i, (i * 3 + 1) % 12, 5) for i in range(12)] + [(i, (i + 5) % 12, 3) for i in range(12)]
    g, w, log = dimacs.from_rows(spark, 12, edges), [e[2] for e in edges], []
    for i in range(120):
        if r.random() < 0.6:
            log.append((i, "QUERY", r.randrange(6), r.randrange(12), None, None, None))
        else:
            e, new = r.randrange(24), r.randint(1, 4)
            log.append((i, "UPDATE", None, None, e, w[e], new))
            w[e] = new
    t = spark.createDataFrame(log, traces.TRACE_SCHEMA)
    want = set()
    for name, make in {"B0": en.Fresh, "B1": en.Fresh, "B2": lambda g: en.AlwaysResident(g, "rebuild"), "B3": en.AlwaysResident, "B2L": lambda g: en.BoundedResident(g, "rebuild", cap), "B3L": lambda g: en.BoundedResident(g, "repair", cap)}.items():
        e = make(en.Graph(12, edges))
        en.run_trace(e, [(s, k, *((a, b) if k == "QUERY" else (x, new))) for s, k, a, b, x, _, new in log])
        want |= {(name, k, v) for k, v in e.stats.items() if v and k not in ("filtered", "decrease_repairs", "increase_repairs") and not (k == "rebuilds" and name in ("B3", "B3L"))}
    assert set(map(tuple, en.fixed_counters(g, t, cap).collect())) == want


def test_queries_of_an_older_log_are_no_single_group(spark, tmp_path):
    (tmp_path / "log.txt").write_text("n 3\ne 0 1 5\ne 1 2 7\nq 0 2\nu 1 9\nq 1 2\nu 1 4\nq 2 0\n")
    t = traces.read_legacy(spark, str(tmp_path))[1]
    assert [x.old_weight for x in t.orderBy("op_seq").collect()] == [None, 7, None, 9, None]
    assert "windowspecdefinition(kind" not in t._jdf.queryExecution().toString()


def test_a_streamed_log_is_answered_in_ranges(spark, tmp_path):
    from pathloom.streaming.replay import RangeReplay

    r = random.Random(5)
    edges = [(i, (i + 1) % 10, 4) for i in range(10)] + [(i, (i * 7 + 2) % 10, 6) for i in range(10)]
    g, w, log = dimacs.from_rows(spark, 10, edges), [e[2] for e in edges], []
    for i in range(90):
        if r.random() < 0.5:
            log.append((i, "QUERY", r.randrange(10), r.randrange(10), None, None, None))
        else:
            e, new = r.randrange(20), r.randint(1, 9)
            log.append((i, "UPDATE", None, None, e, w[e], new))
            w[e] = new
    frame = lambda rows: spark.createDataFrame(rows, traces.TRACE_SCHEMA)
    sink = RangeReplay(g, f"{tmp_path}/out")
    for k, at in enumerate((0, 40, 90)):
        sink.batch(frame(r.sample(log[at : (40, 90, 90)[k]], (40, 50, 0)[k])), k)
    sink.batch(frame(log[:40]), 0)
    got = sorted((x.op_seq, x.answer) for x in spark.read.schema("op_seq long, answer long").parquet(f"{tmp_path}/out").collect())
    assert got == en.run_trace(en.Engine(en.Graph(10, edges)), [(s, q, *((a, b) if q == "QUERY" else (e, new))) for s, q, a, b, e, _, new in log])
    for bad in ([(91, "QUERY", 0, 1, None, None, None)], [(90, "QUERY", 0, 1, None, None, None)] * 2):
        with pytest.raises(ValueError):
            sink.batch(frame(bad), 9)


def test_functions_over_a_graph_beyond_the_kernel(spark):
    from pathloom.functions import surface

    g = dimacs.from_rows(spark, 5, [(0, 1, 4), (1, 2, 3), (0, 2, 10), (3, 4, 1)])
    surface.register(spark, g, "far_", [0, 4], 0)
    rows = spark.sql("SELECT v, dist, far_shortest_distance(0L, v) AS again FROM far_sssp(0L)").collect()
    assert sorted(map(tuple, rows)) == [(0, 0, 0), (1, 4, 4), (2, 7, 7)]
    assert spark.sql("SELECT far_shortest_distance(4L, 0L), far_shortest_distance(4L, 4L), far_shortest_distance(NULL, 0L)").first()[:] == (INF, 0, None)
    assert [tuple(x) for x in spark.sql("SELECT * FROM far_sssp(4L)").collect()] == [(4, 0)]
    with pytest.raises(Exception, match="not one of the sources"):
        spark.sql("SELECT * FROM far_sssp(1L)").collect()
    with pytest.raises(ValueError):
        surface.register(spark, g, "far_", None, 0)
