"""Shortest distances for many seeds at once: a relational frontier loop, and an Arrow heap kernel for graphs of bounded size."""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pathloom.functions.scalar import INF, sat_add
from pathloom.functions.tables import discard, materialise

#: Edges up to which a graph is sent to every executor (56 bytes each as flat arrays, 220 MB at most in a worker).
KERNEL_EDGES = 4_000_000
#: Sources up to which a larger graph is relaxed in plain rounds, each writing all labels anew.
FEW = 64


def relax(seeds: DataFrame, edges: DataFrame, keys: list[str], reverse: bool = False, valid: Column | None = None, heads: DataFrame | None = None, max_rounds: int = 100_000) -> DataFrame:
    """(keys, v, dist): least distances from seeds (keys, v, dist) over edges (src, dst, weight, ...).

    A round joins the frontier (the labels that improved last) to the edges and takes minima per (keys, v) over old and new
    labels: one aggregation, combined before its shuffle, whose result marks the next frontier.  All keys advance together, so rounds count the longest path in hops and not the keys.  `valid`
    restricts edges by columns of both sides (versions as of a key); `heads` (keys, v) restricts what may be reached.
    Vertices not reached are absent.  Every round is written down, so its lineage is one round long.
    """
    best = _seeded(seeds, keys)
    for _ in range(max_rounds):
        nxt = _round(best, edges, keys, reverse, valid, heads)
        discard(best)
        if nxt.where("fresh").isEmpty():
            return nxt.drop("fresh")
        best = nxt
    raise RuntimeError("relaxation did not settle")


def _seeded(seeds: DataFrame, keys: list[str]) -> DataFrame:
    return materialise(seeds.groupBy(*keys, "v").agg(F.min("dist").alias("dist"), F.lit(True).alias("fresh")), "relax")


def _round(best: DataFrame, edges: DataFrame, keys: list[str], reverse: bool = False, valid: Column | None = None, heads: DataFrame | None = None) -> DataFrame:
    """The labels after one step of the fresh ones, with those that improved marked fresh."""
    tail, head = ("dst", "src") if reverse else ("src", "dst")
    e = edges.select(*[F.col(c).alias("_e_" + c) for c in edges.columns])
    on = F.col("v") == F.col("_e_" + tail)
    step = best.where("fresh").join(e, on if valid is None else on & valid)
    cand = step.select(*map(F.col, keys), F.col("_e_" + head).alias("v"), sat_add(F.col("dist"), F.col("_e_weight")).alias("dist")).where(F.col("dist") < INF)
    if heads is not None:
        cand = cand.join(heads, [*keys, "v"], "left_semi")
    both = best.select(*keys, "v", "dist", F.col("dist").alias("was")).union(cand.select(*keys, "v", "dist", F.lit(None).cast("long")))
    low = both.groupBy(*keys, "v").agg(F.min("dist").alias("dist"), F.min("was").alias("was"))
    return materialise(low.select(*keys, "v", "dist", F.expr("was is null or dist < was").alias("fresh")), "relax")


class Csr:
    """Forward adjacency in edge_id order at each vertex, as flat arrays of 8 bytes; the reverse one points into it."""

    def __init__(self, edge_id: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
        order = np.lexsort((edge_id, src))
        self.names, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        s, d = at[: len(src)][order], at[len(src) :][order]
        n = np.arange(len(self.names) + 1)
        back = np.argsort(d, kind="stable")
        flat = lambda x: array("q", np.ascontiguousarray(x, np.int64).tobytes())
        self.start, self.src, self.dst, self.weight, self.edge_id = flat(np.searchsorted(s, n)), flat(s), flat(d), flat(weight[order]), flat(edge_id[order])
        self.into, self.back = flat(np.searchsorted(d[back], n)), flat(back)

    def at(self, v: int) -> int:
        """The index of a vertex, -1 if no edge touches it."""
        i = int(np.searchsorted(self.names, v))
        return i if i < len(self.names) and self.names[i] == v else -1

    def places(self, edge_ids: np.ndarray, known: bool = True) -> np.ndarray:
        """The places of edge ids in the arrays; ids are sorted once a process, in two flat arrays.  Unknown ones raise, or have -1 if not all are `known`."""
        if not hasattr(self, "_ids"):
            ids = np.frombuffer(self.edge_id, np.int64)
            order = np.argsort(ids, kind="stable")
            self._ids = ids[order], order
        ids, order = self._ids
        at = np.minimum(np.searchsorted(ids, edge_ids), max(0, len(ids) - 1))
        if not len(ids) or not len(edge_ids):
            missing = np.ones(len(edge_ids), bool)
        else:
            missing = ids[at] != edge_ids
        if known and missing.any():
            raise IndexError("unknown edge")
        return np.where(missing, -1, order[at] if len(ids) else -1)

    def table(self, source: int, sweeps: int = 64) -> np.ndarray:
        """Distances of all vertices from a source, by spread()."""
        dist = np.full(len(self.names), INF, np.int64)
        dist[self.at(source)] = 0
        return self.spread(dist, sweeps)

    def _buckets(self, dist: np.ndarray, most: int = 512) -> tuple[np.ndarray, bool]:
        """(labels, whether none improves further): labels lowered bucket by bucket, each the vertices of one distance, whose arcs are relaxed in
        numpy, so that an arc is looked at once; given up after `most` buckets, as where distances are many.  Labels and weights fit 4 bytes."""
        if not hasattr(self, "_narrow"):
            start = np.frombuffer(self.start, np.int64)
            self._narrow = start.astype(np.int32), np.diff(start).astype(np.int32), np.frombuffer(self.dst, np.int64).astype(np.int32), np.frombuffer(self.weight, np.int64).astype(np.int32)
        first, degree, head, arc = self._narrow
        cap, zero, d = 1 << 30, not arc.all(), -1
        at = np.where(dist < INF, dist, cap).astype(np.int32)
        for _ in range(most):
            d = int(at.min(initial=cap, where=at > d))
            if d >= cap:
                return np.where(at < cap, at.astype(np.int64), INF), True
            fresh = np.flatnonzero(at == d)
            while len(fresh):
                n = degree[fresh]
                arcs = np.repeat(first[fresh] - (np.cumsum(n) - n).astype(np.int32), n)
                arcs += np.arange(len(arcs), dtype=np.int32)
                to, nd = head[arcs], arc[arcs] + np.int32(d)
                better = nd < at[to]
                to, nd = to[better], nd[better]
                np.minimum.at(at, to, nd)
                fresh = np.unique(to[nd == d]) if zero else to[:0]
        return np.where(at < cap, at.astype(np.int64), INF), False

    def spread(self, dist: np.ndarray, sweeps: int = 64, large: int = 1 << 20) -> np.ndarray:
        """The labels dist of all vertices, lowered along the arcs until none improves: by sweeps in numpy for as long as `sweeps` suffice,
        as for paths of few hops in most graphs.  The lighter third of the arcs is swept until it is quiet before each sweep over
        all, as most of a shortest path is light; numbers take 4 bytes where no path is too long for them.  Longer ones are left to a heap.
        Beyond `large` arcs, of small weights, it goes bucket by bucket first, as a sweep over all is dear."""
        if not hasattr(self, "_top"):
            self._top = int(np.frombuffer(self.weight, np.int64).max(initial=0))
        if len(self.src) > large and self._top < 1024 and dist.max(initial=0, where=dist < INF) < 1 << 29:
            dist, quiet = self._buckets(dist)
            if quiet:
                return dist
        if not hasattr(self, "_sweep"):
            back = np.frombuffer(self.back, np.int64)
            head, src, weight = np.repeat(np.arange(len(self.names)), np.diff(np.frombuffer(self.into, np.int64))), np.frombuffer(self.src, np.int64)[back], np.frombuffer(self.weight, np.int64)[back]
            top = self._top
            kind = np.int32 if top < 1 << 30 and top * len(self.names) < 1 << 29 else np.int64
            parts = [weight <= np.quantile(weight, 1 / 3), slice(None)] if len(weight) else [slice(None)]
            self._sweep = kind, [(src[m].astype(np.int32), weight[m].astype(kind), *np.unique(head[m], return_index=True)) for m in parts]
        kind, (*light, every) = self._sweep
        cap, at = INF, dist
        if kind is np.int32 and dist.max(initial=0, where=dist < INF) < 1 << 29:
            cap = 1 << 30
            at = np.where(dist < INF, dist, cap).astype(np.int32)

        def lower(src: np.ndarray, weight: np.ndarray, heads: np.ndarray, starts: np.ndarray) -> bool:
            low = np.minimum(at[heads], np.minimum.reduceat(at[src] + weight, starts))  # INF + INF still fits
            if (low == at[heads]).all():
                return False
            at[heads] = low
            return True

        left, quiet = sweeps, not len(self.src)
        while left > 0 and not quiet:
            while left > 0 and any([lower(*x) for x in light]):
                left -= 1
            left -= 1
            quiet = not lower(*every)
        if at is not dist:
            dist = np.where(at < cap, at.astype(np.int64), INF)
        if quiet:
            return dist
        known, start, to, arc = dist.tolist(), self.start, self.dst, self.weight
        heap = [(d, i) for i, d in enumerate(known) if d < INF]
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d == known[u]:
                for e in range(start[u], start[u + 1]):
                    nd = d + arc[e]
                    if nd < known[to[e]]:
                        known[to[e]] = nd
                        heapq.heappush(heap, (nd, to[e]))
        return np.array(known, np.int64)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_sweep", "_ids", "_hub", "_narrow", "_top")}

    def _from_hub(self) -> tuple[bytearray, bytearray, int, int]:
        """What the vertex of most arcs reaches, what reaches it, and the vertices and arcs out of the former; found once a process."""
        if not hasattr(self, "_hub"):
            n = len(self.names)
            start, into = np.frombuffer(self.start, np.int64), np.frombuffer(self.into, np.int64)
            hub, sides = int(np.argmax(np.diff(start) + np.diff(into))), []
            for bounds, ends in ((self.start, self.dst), (self.into, np.frombuffer(self.src, np.int64)[np.frombuffer(self.back, np.int64)].tolist())):
                seen, stack = bytearray(n), [hub]
                seen[hub] = 1
                while stack:
                    u = stack.pop()
                    for v in ends[bounds[u] : bounds[u + 1]]:
                        if not seen[v]:
                            seen[v] = 1
                            stack.append(v)
                sides.append(seen)
            ahead = np.frombuffer(sides[0], np.uint8).astype(bool)
            self._hub = (*sides, int(ahead.sum()), int(np.diff(start)[ahead].sum()))
        return self._hub

    def reach(self, source: int) -> tuple[int, int]:
        """(vertices reached from a source, itself counted; arcs out of them).  What lies behind the hub is counted once for all sources."""
        i = self.at(source)
        if i < 0:
            return 1, 0
        ahead, before, vertices, arcs = self._from_hub()
        through = before[i]
        if through and ahead[i]:
            return vertices, arcs
        n, m, seen, stack = (vertices, arcs, {i}, [i]) if through else (0, 0, {i}, [i])
        while stack:
            u = stack.pop()
            n, m = n + 1, m + self.start[u + 1] - self.start[u]
            for v in self.dst[self.start[u] : self.start[u + 1]]:
                if v not in seen and not (through and ahead[v]):
                    seen.add(v)
                    stack.append(v)
        return n, m

    def from_source(self, source: int, target: int | None = None) -> tuple[list[int], list[int], int, int]:
        """(dist, parent edge, edges scanned, vertices settled); stops at target if given.  Ties keep the first parent."""
        n = len(self.names)
        dist, parent, scans, settled = [INF] * n, [-1] * n, 0, 0
        i = self.at(source)
        if i < 0:
            return dist, parent, 0, 0
        goal = self.at(target) if target is not None else -1
        dist[i], heap = 0, [(0, i)]
        start, dst, weight, pop, push = self.start, self.dst, self.weight, heapq.heappop, heapq.heappush
        while heap:
            d, u = pop(heap)
            if d != dist[u]:
                continue
            settled += 1
            if u == goal:
                break
            for e in range(start[u], start[u + 1]):
                scans += 1
                v, nd = dst[e], d + weight[e]
                if nd < dist[v] and nd < INF:
                    dist[v], parent[v] = nd, self.edge_id[e]
                    push(heap, (nd, v))
        return dist, parent, scans, settled

    def both_ways(self, source: int, target: int, weight: array | None = None) -> tuple[int, int, int]:
        """(distance, edges scanned, vertices settled) of one pair: searches from both ends, the one with the smaller key
        next, until the keys sum to the best path that joins them.  INF where there is none, 0 from a vertex to itself."""
        if source == target:
            return 0, 0, 0
        s, t = self.at(source), self.at(target)
        if s < 0 or t < 0:
            return INF, 0, 0
        weight = self.weight if weight is None else weight
        near, heaps, best, scans, settled = ({s: 0}, {t: 0}), ([(0, s)], [(0, t)]), INF, 0, 0
        while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] < best:
            side = heaps[0][0][0] > heaps[1][0][0]
            mine, other, heap = near[side], near[not side], heaps[side]
            d, u = heapq.heappop(heap)
            if d != mine[u]:
                continue
            settled += 1
            bounds = self.into if side else self.start
            for k in range(bounds[u], bounds[u + 1]):
                e = self.back[k] if side else k
                scans += 1
                v, nd = self.src[e] if side else self.dst[e], d + weight[e]
                if nd < mine.get(v, INF):
                    mine[v] = nd
                    heapq.heappush(heap, (nd, v))
                    best = min(best, nd + other.get(v, INF))
        return best, scans, settled


    def by_weight(self, low: np.ndarray) -> list[tuple[array, array, array, array]]:
        """For both directions (bounds of each vertex, ends, least weights, places) of the arcs, the lightest first at each vertex."""
        kind = "i" if low.max(initial=0) < 1 << 31 and len(low) < 1 << 31 else "q"
        flat = lambda x, t: array(t, np.ascontiguousarray(x, np.dtype(t)).tobytes())
        src, dst = np.frombuffer(self.src, np.int64), np.frombuffer(self.dst, np.int64)
        sides = []
        for bounds, mine, other in ((self.start, src, dst), (self.into, dst, src)):
            order = np.lexsort((low, mine))
            sides.append((bounds, flat(other[order], "i"), flat(low[order], kind), flat(order, "i")))
        return sides

    def nearest(self, s: int, t: int, weight: array, sides: list[tuple[array, array, array, array]]) -> int:
        """The distance between the vertices at two places, as both_ways() finds it, over by_weight() of weights that are nowhere above `weight`.

        A vertex's arcs are left at the first that no unsettled vertex of the other side could complete to a path shorter than the best
        one so far, so most are never looked at; those to settled vertices were seen from there.
        """
        if s == t:
            return 0
        near, heaps, best = ({s: 0}, {t: 0}), ([(0, s)], [(0, t)]), INF
        pop, push = heapq.heappop, heapq.heappush
        while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] < best:
            side = heaps[0][0][0] > heaps[1][0][0]
            mine, other, heap, rest = near[side], near[not side], heaps[side], heaps[not side][0][0]
            d, u = pop(heap)
            if d != mine[u]:
                continue
            bounds, ends, low, place = sides[side]
            for k in range(bounds[u], bounds[u + 1]):
                if d + low[k] + rest >= best:
                    break
                nd = d + weight[place[k]]
                if nd + rest < best and nd < mine.get(v := ends[k], INF):
                    mine[v] = nd
                    push(heap, (nd, v))
                    if (more := other.get(v)) is not None and nd + more < best:
                        best = nd + more
        return best


def csr_of(edges: DataFrame, most: int = KERNEL_EDGES, named: bool = True) -> Csr | None:
    """The graph as arrays if it has at most `most` edges (checked before anything is collected), else None.

    Numbers that fit 4 bytes are sent to the driver as such; unless `named`, edge ids are left out and stand as 0.
    """
    columns = ["edge_id", "src", "dst", "weight"][not named :]
    size = edges.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(*columns)).alias("high"), F.min(F.least(*columns)).alias("low")).first()
    if size["n"] > most:
        return None
    kind = "int" if size["n"] and -(1 << 31) <= size["low"] and size["high"] < 1 << 31 else "long"
    p = edges.select(*[F.col(c).cast(kind) for c in columns]).toArrow()
    return Csr(*(p[c].to_numpy().astype(np.int64) if c in columns else np.zeros(size["n"], np.int64) for c in ("edge_id", "src", "dst", "weight")))


def _spread(csr: Csr, seeds: DataFrame) -> DataFrame:
    """Labels (source, v, dist), source by source, lowered along the arcs of csr."""
    sent = seeds.sparkSession.sparkContext.broadcast(csr)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        names, v, d = sent.value.names, f["v"].to_numpy(np.int64), f["dist"].to_numpy(np.int64)
        at = np.minimum(np.searchsorted(names, v), max(0, len(names) - 1))
        known = names[at] == v if len(names) else np.zeros(len(v), bool)
        dist = np.full(len(names), INF, np.int64)
        np.minimum.at(dist, at[known], d[known])
        if len(names):
            dist = sent.value.spread(dist)
        hit = np.flatnonzero(dist < INF)
        v, d = np.concatenate([names[hit], v[~known]]), np.concatenate([dist[hit], d[~known]])
        return pd.DataFrame({"source": np.full(len(v), f["source"].iloc[0]), "v": v, "dist": d})

    return seeds.groupBy("source").applyInPandas(run, "source long, v long, dist long")


def _cut(edges: DataFrame, m: int, n: int, kernel_edges: int, degree: int) -> int:
    """The weight up to which there are about `degree` edges a vertex, of m edges and n vertices."""
    goal = min(degree * n, kernel_edges or m)
    cut = edges.agg(F.percentile_approx("weight", min(1.0, goal / m))).first()[0]
    return cut - 1 if edges.where(F.col("weight") <= cut).count() > max(goal, m // 2) else cut  # most edges may weigh the same


def thinned(edges: DataFrame, kernel_edges: int = KERNEL_EDGES, degree: int = 10, hubs: int = 8) -> Csr | None:
    """The graph as arrays without edges that no shortest path takes, None if they don't fit the kernel even so.  Distances are the same.

    Over the lightest edges, which fit, the distances from and to the `hubs` vertices of most of them bound those of all pairs: a
    way from the tail of an edge to a hub and on to its head that is shorter than the edge makes it useless for any source.
    Edges are held against these bounds in one pass without a shuffle; the bounds are 8 bytes a hub, side and vertex.

    Where weights change, edges have columns `low` and `high` too, their least and greatest weight: ways by greatest weights bound the
    distances of all times, and an edge goes whose least weight is beyond them.
    """
    own, most = ("low", "high") if {"low", "high"} <= set(edges.columns) else ("weight", "weight")
    e = edges.select("src", "dst", F.col(most).alias("weight"))
    size = e.agg(F.count(F.lit(1)).alias("m"), F.approx_count_distinct("dst").alias("n")).first()
    light = csr_of(e.where(F.col("weight") <= _cut(e, size["m"], size["n"], kernel_edges, degree)), kernel_edges, named=False) if kernel_edges else None
    if light is None or not len(light.names):
        return None
    src, dst, weight = (np.frombuffer(x, np.int64) for x in (light.src, light.dst, light.weight))
    names, back = light.names, Csr(np.zeros(len(src), np.int64), light.names[dst], light.names[src], weight)
    ends = np.bincount(src, minlength=len(names)) * np.bincount(dst, minlength=len(names))
    chosen = names[np.argsort(-ends, kind="stable")[:hubs]].tolist()
    sent = edges.sparkSession.sparkContext.broadcast((names, [(back.table(h), light.table(h)) for h in chosen]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, sides = sent.value
        for f in frames:
            ends = [f[c].to_numpy(np.int64) for c in ("src", "dst")]
            at = [np.minimum(np.searchsorted(names, x), len(names) - 1) for x in ends]
            known = (names[at[0]] == ends[0]) & (names[at[1]] == ends[1])
            bound = np.min([to[at[0]] + of[at[1]] for to, of in sides], axis=0)  # INF + INF still fits
            yield f[~known | (f["_own"].to_numpy(np.int64) <= bound)].drop(columns="_own")

    return csr_of(edges.select("edge_id", "src", "dst", "weight", F.col(own).alias("_own")).mapInPandas(run, "edge_id long, src long, dst long, weight long"), kernel_edges)


def relax_few(seeds: DataFrame, edges: DataFrame, kernel_edges: int = KERNEL_EDGES, many: int = KERNEL_EDGES, degree: int = 10, max_rounds: int = 100_000) -> DataFrame:
    """relax() by source for labels (source, v, dist) of few sources, where a graph of over `many` edges makes each round dear.

    A smaller graph goes to the kernel whole, or is relaxed in plain rounds if it doesn't fit.  Else labels spread over the lightest edges first, about `degree` a vertex, in the kernel if they fit it.  They are bounds:
    an edge no lighter than the largest bound of its head improves nothing from any source and is dropped for good; of the others
    the heavy ones are relaxed from all labels, and what they improve spreads over the light ones again until nothing does.  So
    with the kernel rounds count the heavy edges on a path and not its hops; without it they are over few edges.
    """
    e = edges.select("src", "dst", "weight")
    size = e.agg(F.count(F.lit(1)).alias("m"), F.approx_count_distinct("dst").alias("n")).first()
    if size["m"] <= many:
        csr = csr_of(e, kernel_edges, named=False) if kernel_edges else None
        return _spread(csr, seeds) if csr is not None else relax(seeds, e, ["source"], max_rounds=max_rounds)
    cut = _cut(e, size["m"], size["n"], kernel_edges, degree)
    light = e.where(F.col("weight") <= cut)
    csr = csr_of(light, kernel_edges, named=False) if kernel_edges else None
    labels = _spread(csr, seeds) if csr is not None else relax(seeds, materialise(light, "light"), ["source"], max_rounds=max_rounds)
    best = _seeded(labels, ["source"])
    sources = seeds.select("source").distinct().count()
    bound = best.groupBy(F.col("v").alias("_v")).agg(F.max("dist").alias("_most"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == sources)
    kept = materialise(e.join(bound, F.col("dst") == F.col("_v"), "left").where("_most is null or weight < _most").select("src", "dst", "weight"), "kept")
    over = kept.where(F.col("weight") > cut)
    for _ in range(max_rounds):
        nxt = _round(best, over, ["source"])
        discard(best)
        if nxt.where("fresh").isEmpty():
            discard(kept)
            return nxt.drop("fresh")
        if csr is None:
            best, over = nxt, kept
        else:
            best = _seeded(_spread(csr, nxt.select("source", "v", "dist")), ["source"])
            discard(nxt)
    raise RuntimeError("relaxation did not settle")


def sssp(edges: DataFrame, sources: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(source, v, dist) of every vertex reachable from each row of sources (source).

    A graph of bounded size goes to all executors once and sources are dealt over tasks, as does a larger one from many sources if
    the edges that shortest paths may take fit (thinned()).  Else it is relaxed by joins: from up to FEW sources light edges first (relax_few()), as their labels are few beside the edges, from more of them
    bucket by bucket (operators.labels).  All give the same rows.
    """
    from pathloom.operators.labels import delta_stepping

    csr = csr_of(edges, kernel_edges)
    src = sources.select(F.col("source").cast("long").alias("source")).where("source is not null").distinct()
    if csr is None and src.limit(FEW + 1).count() <= FEW:
        return relax_few(src.select("source", F.col("source").alias("v"), F.lit(0).cast("long").alias("dist")), edges, kernel_edges)
    if csr is None:
        csr = thinned(edges, kernel_edges)
    if csr is None:
        return delta_stepping(edges, src)
    g = edges.sparkSession.sparkContext.broadcast(csr)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = g.value.names
        for f in frames:
            for s in f["source"]:
                if g.value.at(int(s)) < 0:
                    yield pd.DataFrame({"source": [s], "v": [s], "dist": [0]})
                    continue
                dist = g.value.table(int(s))
                hit = np.flatnonzero(dist < INF)
                yield pd.DataFrame({"source": np.full(len(hit), s), "v": names[hit], "dist": dist[hit]})

    return _dealt(src).mapInPandas(run, "source long, v long, dist long")


def totals(edges: DataFrame, sources: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(source, reached, total, farthest): the number, sum and greatest of the distances that sssp() finds from each row of sources.

    Where the graph, or what thinned() leaves of it, fits the kernel, they are summed up there and no row a source and vertex is made."""
    src = sources.select(F.col("source").cast("long").alias("source")).where("source is not null").distinct()
    csr = csr_of(edges, kernel_edges)
    if csr is None and src.limit(FEW + 1).count() > FEW:
        csr = thinned(edges, kernel_edges)
    if csr is None:
        return sssp(edges, sources, kernel_edges).groupBy("source").agg(F.count(F.lit(1)).alias("reached"), F.sum("dist").alias("total"), F.max("dist").alias("farthest"))
    g = edges.sparkSession.sparkContext.broadcast(csr)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for s in f["source"].tolist():
                dist = g.value.table(s) if g.value.at(s) >= 0 else np.zeros(1, np.int64)
                dist = dist[dist < INF]
                rows.append((s, len(dist), int(dist.sum()), int(dist.max())))
            yield pd.DataFrame(rows, columns=["source", "reached", "total", "farthest"])

    return _dealt(src).mapInPandas(run, "source long, reached long, total long, farthest long")


def _dealt(sources: DataFrame) -> DataFrame:
    """sources in as many partitions as keep all cores busy: so few bytes would else be made one partition, and so one task."""
    return sources.repartition(max(1, 4 * sources.sparkSession.sparkContext.defaultParallelism), "source")


def reach(edges: DataFrame, sources: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """(source, reached, arcs): the vertices that each row of sources (source) reaches, itself counted, and the edges out of them.

    A search without a target settles each of these vertices once and scans each of these edges once, so they are also its
    counters.  No row a source and vertex is made: what the vertex of most edges (the hub) reaches is found once; a
    source that reaches the hub has all that and what it reaches besides, one that doesn't meets nothing that reaches the hub.
    """
    src = sources.select(F.col("source").cast("long").alias("source")).where("source is not null").distinct()
    csr = csr_of(edges, kernel_edges)
    if csr is not None:
        sent = edges.sparkSession.sparkContext.broadcast(csr)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame([(s, *sent.value.reach(s)) for s in f["source"].tolist()], columns=["source", "reached", "arcs"])

        return _dealt(src).mapInPandas(run, "source long, reached long, arcs long")
    ends = edges.select(F.col("src").alias("v"), F.lit(1).cast("long").alias("out")).union(edges.select("dst", F.lit(0).cast("long")))
    deg = materialise(ends.groupBy("v").agg(F.sum("out").alias("n"), F.count(F.lit(1)).alias("ends")), "degrees")
    hub = deg.orderBy(F.desc("ends"), "v").first()["v"]
    e = edges.select("src", "dst", F.lit(0).cast("long").alias("weight"))
    seed = edges.sparkSession.range(1).select(F.lit(0).cast("long").alias("k"), F.lit(hub).cast("long").alias("v"), F.lit(0).cast("long").alias("dist"))
    ahead, before = (relax(seed, e, ["k"], reverse=r).select(F.col("v").alias(name), F.lit(True).alias("_" + name)) for r, name in ((False, "a"), (True, "b")))
    vertices, arcs = ahead.join(deg, F.col("a") == F.col("v")).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    flag = lambda c: F.coalesce(c, F.lit(False))
    s = src.join(ahead, F.col("source") == F.col("a"), "left").join(before, F.col("source") == F.col("b"), "left").select("source", flag("_a").alias("ahead"), flag("_b").alias("through"))
    s = materialise(s, "reach")
    core = ahead.join(before, F.col("a") == F.col("b"), "left_semi")
    rest = e.join(core, F.col("src") == F.col("a"), "left_anti").join(ahead, F.col("dst") == F.col("a"), "left").select("src", "dst", "weight", flag("_a").alias("ahead"))
    alone = s.where("not (ahead and through)").select("source", "through", F.col("source").alias("v"), F.lit(0).cast("long").alias("dist"))
    found = relax(alone, materialise(rest, "reach"), ["source", "through"], valid=~(F.col("through") & F.col("_e_ahead")))
    own = found.select("source", F.col("v").alias("_v")).join(deg, F.col("_v") == F.col("v"), "left").groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("more"), F.sum(F.coalesce("n", F.lit(0))).alias("out"))
    both = s.join(own, F.col("source") == F.col("_s"), "left")
    add = lambda c, base: F.coalesce(c, F.lit(0)) + F.when(F.col("through"), F.lit(base)).otherwise(0)
    return both.select("source", add("more", vertices).cast("long").alias("reached"), add("out", arcs).cast("long").alias("arcs"))


def distances(edges: DataFrame, pairs: DataFrame, kernel_edges: int = KERNEL_EDGES, few: int = 2) -> DataFrame:
    """(source, target, dist, edge_scans, settled) for each distinct pair: INF where unreachable, 0 from a vertex to itself.

    With the kernel a source of up to `few` targets searches each from both ends, which the counters describe; one with
    more finds all its distances at once.  There, on the thinned() graph of a larger one, and by joins, the counters are null.
    """
    p = pairs.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")).where("source is not null and target is not null").distinct()
    csr = csr_of(edges, kernel_edges)
    whole = csr is not None
    csr = csr if whole else thinned(edges, kernel_edges)
    if csr is None:
        seeds = p.select("source").distinct().select("source", F.col("source").alias("v"), F.lit(0).cast("long").alias("dist"))
        d = relax(seeds, edges, ["source"]).select(F.col("source").alias("s"), "v", "dist")
        found = p.join(d, (F.col("source") == F.col("s")) & (F.col("target") == F.col("v")), "left")
        none = F.lit(None).cast("long")
        return found.select("source", "target", F.when(F.col("source") == F.col("target"), 0).otherwise(F.coalesce("dist", F.lit(INF))).cast("long").alias("dist"), none.alias("edge_scans"), none.alias("settled"))
    sent = edges.sparkSession.sparkContext.broadcast(csr)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = sent.value
        for f in frames:
            for s, targets in zip(f["source"].tolist(), f["targets"].tolist(), strict=True):
                targets = sorted(map(int, targets))
                if len(targets) <= few or g.at(s) < 0:
                    rows = [(s, t, *((d, scans, settled) if whole else (d, None, None))) for t in targets for d, scans, settled in [g.both_ways(s, t)]]
                else:
                    dist, at = g.table(s), [g.at(t) for t in targets]
                    rows = [(s, t, 0 if s == t else int(dist[i]) if i >= 0 else INF, None, None) for t, i in zip(targets, at, strict=True)]
                yield pd.DataFrame(rows, columns=["source", "target", "dist", "edge_scans", "settled"]).astype({"edge_scans": "Int64", "settled": "Int64"})

    # targets of one source are vertices of a graph of bounded size
    return _dealt(p).groupBy("source").agg(F.collect_list("target").alias("targets")).mapInPandas(run, "source long, target long, dist long, edge_scans long, settled long")


def bidirectional(edges: DataFrame, source: int, target: int, max_rounds: int = 100_000) -> DataFrame:
    """(dist): labels from the source forward meet labels from the target backward; one row, INF if they never do.

    Both sides go on by rounds until the least fresh labels of the two sum to the best meeting: a shorter path would have
    to leave a fresh label on either side.
    """
    spark = edges.sparkSession
    row = lambda d: spark.createDataFrame([(d,)], "dist long")
    if source == target:
        return row(0)
    sides = [_seeded(spark.createDataFrame([(0, v, 0)], "k long, v long, dist long"), ["k"]) for v in (source, target)]
    for _ in range(max_rounds):
        f, b = (x.select(F.col("v").alias("v" + c), F.col("dist").alias("d" + c)) for x, c in zip(sides, "fb", strict=True))
        best = f.join(b, F.col("vf") == F.col("vb")).agg(F.coalesce(F.min(sat_add(F.col("df"), F.col("db"))), F.lit(INF))).first()[0]
        near = [x.where("fresh").agg(F.coalesce(F.min("dist"), F.lit(INF))).first()[0] for x in sides]
        if min(INF, sum(near)) >= best:
            return row(best)
        nxt = [_round(x, edges, ["k"], reverse=bool(i)) for i, x in enumerate(sides)]
        for x in sides:
            discard(x)
        sides = nxt
    raise RuntimeError("relaxation did not settle")
