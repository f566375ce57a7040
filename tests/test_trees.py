"""Trees with zero weights, numbered subtrees, delta-stepping and batched repair against plain recomputation."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import labels as lb, relax as rx, repair as rp, tree as tt
from pathloom.sources import dimacs

INF = rx.INF
CYCLE = [(0, 1, 0), (0, 2, 0), (1, 2, 0), (2, 1, 0), (1, 3, 1), (2, 3, 1)]


def plain(edges, source):
    """(dist, canonical parents as v -> (edge, parent, hops)) by a heap over (distance, hops since it grew)."""
    best, heap = {source: (0, 0)}, [((0, 0), source)]
    while heap:
        label, u = heapq.heappop(heap)
        if best[u] != label:
            continue
        for a, b, w in edges:
            if a == u:
                nxt = (label[0] + w, 0 if w else label[1] + 1)
                if nxt[0] < INF and nxt < best.get(b, (INF, 0)):
                    best[b] = nxt
                    heapq.heappush(heap, (nxt, b))
    par = {}
    for i, (a, b, w) in enumerate(edges):
        if a in best and b in best and b != source and (best[a][0] + w, 0 if w else best[a][1] + 1) == best[b] and b not in par:
            par[b] = (i, a, best[b][1])
    return {v: d for v, (d, _) in best.items()}, par


def sources_of(spark, *s):
    return spark.createDataFrame([(x,) for x in s], "source long")


def tree_rows(df):
    return {(r.source, r.v): (r.parent_edge, r.parent, r.hops) for r in df.collect()}


def random_edges(r, n, m, top):
    return [(r.randrange(n), r.randrange(n), r.randint(0, top)) for _ in range(m)]


@pytest.mark.parametrize("seed", [None, 2])
def test_parents_never_form_a_cycle(spark, seed):
    r = random.Random(seed)
    n, edges = (4, CYCLE) if seed is None else (40, random_edges(r, 40, 150, 3))
    g = dimacs.from_rows(spark, n, edges)
    got = tree_rows(tt.parents(g, rx.sssp(g, sources_of(spark, 0, 1))))
    assert got == {(s, v): p for s in (0, 1) for v, p in plain(edges, s)[1].items()}
    for (s, v) in got:
        steps = 0
        while v != s:
            v, steps = got[s, v][1], steps + 1
            assert steps <= n


def test_loops_end_and_cycles_raise(spark):
    for edges in ([(0, 1, 5), (0, 2, 5), (1, 2, 0), (2, 1, 0)], [(0, 1, 1), (1, 2, 0), (2, 3, 0), (3, 2, 0)]):
        g = dimacs.from_rows(spark, 4, edges)
        tree = tt.parents(g, rx.sssp(g, sources_of(spark, 0)))
        sizes = {x.v: x["size"] for x in tt.subtree_sizes(tree).collect()}
        assert sizes[0] == len(plain(edges, 0)[0])
        assert {x.v for x in tt.subtree(tree, 1).collect()} >= {1}
    ring = spark.createDataFrame([(0, 1, 2), (0, 2, 1)], "source long, v long, parent long")
    for f in (tt.subtree_sizes, tt.numbered, lambda t: tt.subtree(t, 5)):
        with pytest.raises(ValueError, match="cycle"):
            f(ring).collect()


def test_numbers_of_a_long_chain_and_a_star(spark, monkeypatch):
    rounds = []
    keep = tt.materialise
    monkeypatch.setattr(tt, "materialise", lambda df, tag: rounds.append(tag) or keep(df, tag))
    n = 20_000
    chain = spark.range(1, n).selectExpr("0L as source", "id as v", "id - 1 as parent")
    got = tt.numbered(chain).agg(F.count("*"), F.count_if(F.expr("enter = v and leave = 20000"))).first()
    assert tuple(got) == (n, n)
    assert len(rounds) <= 2 * (n.bit_length() + 2) + 2
    star = spark.range(1, 500).selectExpr("0L as source", "id as v", "0L as parent")
    rows = {x.v: (x.enter, x.leave) for x in tt.numbered(star).collect()}
    assert rows.pop(0) == (0, 500) and sorted(rows.values()) == [(i, i + 1) for i in range(1, 500)]


def test_members_of_all_tops(spark):
    r = random.Random(8)
    up = {v: r.randrange(v) for v in range(1, 300)}
    tree = spark.createDataFrame([(s, v, p) for s in (0, 7) for v, p in up.items()], "source long, v long, parent long")

    def above(v):
        return [v] + (above(up[v]) if v else [])

    want = sorted((s, top, v) for s in (0, 7) for v in range(300) for top in above(v))
    assert sorted(map(tuple, tt.descent(tree).collect())) == want
    numbers = tt.numbered(tree)
    tops = spark.createDataFrame([(0, 3), (7, 5), (7, 1)], "source long, top long")
    for bits in (0, 4, 20):
        assert sorted(map(tuple, tt.members(numbers, tops, bits).collect())) == [x for x in want if x[:2] in ((0, 3), (7, 5), (7, 1))]
    assert sorted(map(tuple, tt.below(tree, tops).collect())) == sorted({(s, v) for s, t, v in want if (s, t) in ((0, 3), (7, 5), (7, 1))})


@pytest.mark.parametrize("delta, prune", [(None, 1 << 20), (40, 0), (300, 1 << 20)])
def test_delta_stepping_equals_the_kernel(spark, delta, prune):
    r = random.Random(4)
    g = dimacs.from_rows(spark, 60, random_edges(r, 60, 400, 97))
    src = sources_of(spark, 0, 5, 9)
    want = sorted(map(tuple, rx.sssp(g, src).collect()))
    store = lb.LabelStore(src.select("source", F.col("source").alias("v"), F.lit(0).cast("long").alias("dist")), ["source"], parts=16, prune=prune)
    counters = []
    lb.settle(store, store.read(), g, delta, counters)
    assert sorted(map(tuple, store.read().collect())) == want
    assert sum(c["written"] for c in counters) + 3 == sum(store.written)
    assert all(c["written"] <= len(want) for c in counters)
    store.drop()


def test_a_round_writes_its_frontier_only(spark):
    n = 300
    g = dimacs.from_rows(spark, n, [(i, i + 1, 1) for i in range(30)] + [(0, v, 500) for v in range(1, n)])
    src = sources_of(spark, 0)
    store = lb.LabelStore(src.select("source", F.col("source").alias("v"), F.lit(0).cast("long").alias("dist")), ["source"], parts=64, prune=0)
    lb.settle(store, store.read(), g)
    assert {r.v: r.dist for r in store.read().collect()} == {v: min(v, 500) if v <= 30 else 500 for v in range(n)}
    assert store.written[:3] == [1, n - 1, 1] and set(store.written[2:-1]) == {1}  # not n labels a round
    assert len(store.parts_of(store.read().where("v = 3"))) == 1
    store.base = store.added = 1 << 17
    store.added += 1
    store.compact()
    assert store.read().count() == n and store._files().select("round").distinct().count() == 1
    store.drop()


@pytest.mark.parametrize("seed", range(2))
def test_batched_repair_and_tree_equal_recomputation(spark, seed):
    r = random.Random(seed)
    n, top = 30, 3 if seed % 2 else 15
    edges = random_edges(r, n, 120, top)
    g, sources = dimacs.from_rows(spark, n, edges), list(range(6))
    dist = rx.sssp(g, sources_of(spark, *sources))
    tree = tt.parents(g, dist)
    changes = {e: r.choice([0, r.randint(0, top), 3 * top, INF]) for e in r.sample(range(120), 25)}
    c = spark.createDataFrame(list(changes.items()), "edge_id long, new_weight long")
    after, changed = rp.repair_batch(g, dist, tree, c)
    new = [(a, b, changes.get(i, w)) for i, (a, b, w) in enumerate(edges)]
    want = {s: plain(new, s) for s in sources}
    assert {(x.source, x.v): x.dist for x in after.collect()} == {(s, v): d for s in sources for v, d in want[s][0].items()}
    old = {s: plain(edges, s)[0] for s in sources}
    assert {(x.source, x.v): (x.was, x.dist) for x in changed.collect()} == {(s, v): (old[s].get(v), want[s][0].get(v)) for s in sources for v in range(n) if old[s].get(v) != want[s][0].get(v)}
    up = rp.with_weights(g, c)
    moved = spark.createDataFrame([(e,) for e, w in changes.items() if edges[e][2] != w], "edge_id long")
    diff = rp.reparent(up, after, tree, changed, moved)
    fresh = {(s, v): p for s in sources for v, p in want[s][1].items()}
    assert tree_rows(rp.updated_tree(tree, diff)) == fresh
    before = tree_rows(tree)
    assert {k: v for k, v in tree_rows(diff).items()} == {k: fresh.get(k, (None, None, None)) for k in before.keys() | fresh.keys() if (before.get(k) or (None,) * 3)[::2] != (fresh.get(k) or (None,) * 3)[::2]}


def test_reparenting_stays_with_what_changed(spark):
    g = dimacs.from_rows(spark, 200, [(i, i + 1, 1) for i in range(199)] + [(150, 160, 50)])
    dist = rx.sssp(g, sources_of(spark, 0))
    tree = tt.parents(g, dist)
    c = spark.createDataFrame([(199, 3)], "edge_id long, new_weight long")
    after, changed = rp.repair_batch(g, dist, tree, c)
    diff = rp.reparent(rp.with_weights(g, c), after, tree, changed, c)
    assert changed.count() == 40 and [tuple(x)[1:4] for x in diff.collect()] == [(160, 199, 150)]


@pytest.mark.parametrize("kernel", [rx.KERNEL_EDGES, 0])
def test_reach_counts_what_a_whole_search_settles_and_scans(spark, kernel):
    """Graphs of one large part that is strongly connected, of several, and of none."""
    r = random.Random(12)
    for n, m in ((30, 90), (40, 40), (25, 12)):
        edges = random_edges(r, n, m, 5) + [(0, 1, 2), (0, 1, 3)]
        g = dimacs.from_rows(spark, n, edges)
        csr = rx.csr_of(g)
        want = []
        for s in [*range(n), n + 5]:
            dist, _, scans, settled = csr.from_source(s)
            want.append((s, settled, scans) if csr.at(s) >= 0 else (s, 1, 0))
        asked = spark.createDataFrame([(x,) for x in [*range(n), n + 5, 3, None]], "source long")
        assert sorted(map(tuple, rx.reach(g, asked, kernel).collect())) == want


def test_sources_of_one_graph_are_dealt_over_tasks(spark):
    """A few bytes of sources were one partition after their shuffle, so one task searched from all of them."""
    g = dimacs.from_rows(spark, 50, [(i, (i + 1) % 50, 1) for i in range(50)])
    asked = spark.range(50).withColumnRenamed("id", "source")
    for df in (rx.sssp(g, asked), rx.reach(g, asked), rx.distances(g, asked.select("source", F.lit(3).alias("target")))):
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 8


def test_few_sources_over_joins_equal_the_kernel(spark):
    r = random.Random(13)
    g = dimacs.from_rows(spark, 40, random_edges(r, 40, 160, 9))
    asked = spark.createDataFrame([(x,) for x in (0, 7, 99)], "source long")
    assert sorted(map(tuple, rx.sssp(g, asked, 0).select("source", "v", "dist").collect())) == sorted(map(tuple, rx.sssp(g, asked).collect()))


def test_batches_over_a_large_graph_relax_light_edges_first(spark, monkeypatch):
    r = random.Random(21)
    edges = random_edges(r, 30, 120, 9)
    g, sources = dimacs.from_rows(spark, 30, edges), list(range(4))
    dist = rx.sssp(g, sources_of(spark, *sources))
    changes = {e: r.choice([0, 1, 20, INF]) for e in r.sample(range(120), 30)}
    c = spark.createDataFrame(list(changes.items()), "edge_id long, new_weight long")
    monkeypatch.setattr(rp, "settle", None)  # round by round over all edges
    after, changed = rp.repair_batch(g, dist, tt.parents(g, dist), c, many=10)
    want = {s: plain([(a, b, changes.get(i, w)) for i, (a, b, w) in enumerate(edges)], s)[0] for s in sources}
    assert {(x.source, x.v): x.dist for x in after.collect()} == {(s, v): d for s in sources for v, d in want[s].items()}
    old = {s: plain(edges, s)[0] for s in sources}
    assert {(x.source, x.v) for x in changed.collect()} == {(s, v) for s in sources for v in range(30) if old[s].get(v) != want[s].get(v)}


def test_edges_heavier_than_all_labels_of_their_head_are_left_out(spark):
    g = dimacs.from_rows(spark, 4, [(0, 1, 2), (1, 2, 2), (0, 2, 5), (0, 3, 4), (2, 1, 2), (2, 3, 0)])
    dist = rx.sssp(g, sources_of(spark, 0, 2))
    assert sorted(x.edge_id for x in tt.within_labels(g, dist).collect()) == [0, 1, 3, 4, 5]
    assert sorted((x.source, x.edge_id) for x in tt.tight_edges(g, dist).collect()) == [(0, 0), (0, 1), (0, 3), (0, 5), (2, 4), (2, 5)]


def test_large_graphs_from_many_sources_are_thinned(spark, monkeypatch):
    r = random.Random(34)
    edges = random_edges(r, 90, 2500, 97) + [(90, 0, 96), (0, 91, 97), (92, 93, 50)]
    g = dimacs.from_rows(spark, 94, edges)
    small = rx.thinned(g, 1500)
    assert small is not None and len(small.src) <= 1500 < g.count()
    monkeypatch.setattr(lb, "delta_stepping", None)
    monkeypatch.setattr(rx, "relax", None)
    want = {s: plain(edges, s)[0] for s in range(94)}
    asked = sources_of(spark, *range(94))
    assert {(x.source, x.v): x.dist for x in rx.sssp(g, asked, 1500).collect()} == {(s, v): d for s in want for v, d in want[s].items()}
    pairs = [(s, (7 * s + k) % 94) for s in range(94) for k in range(1 + s % 5)]
    got = rx.distances(g, spark.createDataFrame(pairs, "source long, target long"), 1500).collect()
    assert {(x.source, x.target): (x.dist, x.settled) for x in got} == {(s, t): (want[s].get(t, INF), None) for s, t in pairs}


@pytest.mark.parametrize("top", [3, 97, 1 << 40])
def test_sweeps_equal_a_heap(top):
    r = random.Random(top)
    rows = [*random_edges(r, 40, 200, top), *[(i, i + 1, 1) for i in range(40, 60)]]
    src, dst, weight = (np.array(x, np.int64) for x in zip(*rows))
    g = rx.Csr(np.arange(len(rows)), src, dst, weight)
    for s in (0, 7, 40):
        want = plain(rows, s)[0]
        for sweeps in (64, 2):
            assert {int(v): int(d) for v, d in zip(g.names, g.table(s, sweeps)) if d < INF} == want
