"""Near-duplicate vectors by a subspace pigeonhole join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import hot_join, materialise
from .components import connected_components


@cache
def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A fixed random orthogonal matrix, which spreads the variance evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> list[tuple[int, int]]:
    cut = [dim * i // blocks for i in range(blocks + 1)]
    return [(a, b) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def layout(dim: int, bits: float, budget: float) -> tuple[int, int]:
    """(blocks, gridded dimensions of each) with the fewest copies of a point that split a label's points by `bits` bits.

    With b blocks the reach is sqrt(budget / b), cells are two reaches wide, a point is sent to two cells a dimension, and
    a dimension tells a spread of 1 / sqrt(dim) apart by the entropy of a normal variable in such cells.  There are at least four
    blocks (as many as dimensions, if these are fewer) and one gridded dimension, however few the points.
    """
    best = None
    for blocks in [b for b in (4, 8, 16, 32) if b <= dim] or [dim]:
        told = max(0.05, math.log2(max(1.0, 4.13 / math.sqrt(dim) / (2 * math.sqrt(budget / blocks)))))
        grid = max(1, min(math.ceil(bits / told), dim // blocks))
        short = max(0.0, bits - grid * told)  # a grid too coarse leaves pairs of chunks, which copy too
        cost = math.log2(blocks) + grid + short
        if best is None or cost < best[0]:
            best = cost, blocks, grid
    return best[1:]


def _packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: 4 a component if single precision holds them all exactly, 8 if not."""
    with np.errstate(over="ignore"):
        single = x.astype("<f4")
    return [s.tobytes() if (s == r).all() else r.tobytes() for s, r in zip(single, x.astype("<f8"), strict=True)]


def _unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    return np.array([np.frombuffer(r, "<f4" if len(r) == 4 * dim else "<f8") for r in rows], np.float64).reshape(-1, dim)


def _chunked(rows: DataFrame, tile: int) -> DataFrame:
    """rows of cells that hold two or more, dealt by label, cell and pair of chunks (i, j): a cell of over two tiles is cut into chunks that
    meet in pairs, so no task holds more than two chunks and no pair is lost."""
    sizes = rows.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("label").alias("l2"), F.col("cell").alias("cell2"), F.ceil(F.col("c") / (2 * tile)).cast("int").alias("c"))
    met = rows.join(sizes, (F.col("label") == F.col("l2")) & (F.col("cell") == F.col("cell2"))).drop("l2", "cell2")
    met = met.withColumn("own", F.pmod(F.xxhash64("uid"), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    return met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("c", "other")


def link_vectors(vectors: DataFrame, threshold: float = 0.98, tile: int = 4096) -> tuple[DataFrame, DataFrame]:
    """vectors: (uid long, rep long, label, v array<double>, n long), distinct finite non-zero vectors -> (counts, edges).

    For unit vectors a cosine of `threshold` is a squared distance of at most 2 - 2 * threshold, and some block of the
    rotated vectors takes at most its proportional share (dimensions / all dimensions) of it.  So each block is
    range-joined on its own: points fall into grid cells of that block's first dimensions and are also sent to the
    neighbouring cells within reach, with the block's coordinates only.  Points that have a partner within a block's share in a cell get their
    vectors, which few do, and meet again in that cell: there pairs are verified by the cosine
    of the stored vectors in double precision, and a pair counts only in the first block that has it within budget and in
    the cell at home to its smaller id: exactly once.  What returns are sums of links per vector and a spanning forest, never
    pairs.

    Blocks and gridded dimensions follow the size of the largest label (see layout()), so that cells hold about two tiles;
    larger ones are cut (see _chunked()).
    """
    budget = 2 - 2 * threshold + 1e-9
    biggest = vectors.groupBy("label").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 1
    bits = max(0.0, math.log2(biggest / (2 * tile)))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for dim, g in f.groupby(f["v"].map(len)):
                x = np.stack(g["v"].to_numpy()).astype(np.float64)
                # a power of two per vector keeps squares in range and changes no digit
                x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
                y = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(dim)
                blocks, grid = layout(dim, bits, budget)
                for k, (a, b) in enumerate(block_edges(dim, blocks)):
                    reach = math.sqrt(budget * (b - a) / dim) * (1 + 1e-9)
                    use = min(grid, b - a)
                    z = y[:, a : a + use] / (2 * reach) + 0.5
                    home = np.floor(z)
                    low = (z - home) * 2 * reach
                    side = np.where(low < reach, -1, 1)
                    gap = np.minimum(low, 2 * reach - low) ** 2
                    sent = np.array([r.tobytes() for r in y[:, a:b].astype("<f4")], object)
                    for m in range(1 << use):
                        pick = np.array([m >> i & 1 for i in range(use)], bool)
                        near = np.flatnonzero(gap[:, pick].sum(axis=1) <= reach * reach)
                        if near.size:
                            cell = home[near] + side[near] * pick
                            yield pd.DataFrame({"uid": g["uid"].to_numpy()[near], "label": g["label"].to_numpy()[near], "cell": [f"{dim}:{k}:" + ",".join(map(str, c)) for c in cell.astype(int).tolist()], "home": m == 0, "z": sent[near]})

    label = vectors.schema["label"].dataType.simpleString()
    points = vectors.select("uid", "label", "v").mapInPandas(deal, f"uid long, label {label}, cell string, home boolean, z binary")

    def partners(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        """The points of a cell that have another within the block's share, or beyond it by what single precision may be off."""
        dim, k, _ = key[1].split(":")
        a, b = block_edges(int(dim), layout(int(dim), bits, budget)[0])[int(k)]
        y = np.array([np.frombuffer(z, "<f4") for z in f["z"]], np.float64).reshape(len(f), b - a)
        sq, hit = (y**2).sum(axis=1), np.zeros(len(f), bool)
        most = budget * (b - a) / int(dim) * (1 + 1e-4) + 1e-5
        for s in range(0, len(f), 512):
            near = sq[s : s + 512, None] + sq[None, :] - 2 * y[s : s + 512] @ y.T <= most
            hit[s : s + 512] |= near.sum(axis=1) > 1  # itself is one
        return f.loc[hit, ["uid", "label", "cell", "home"]]

    near = _chunked(points, tile).groupBy("label", "cell", "i", "j").applyInPandas(partners, f"uid long, label {label}, cell string, home boolean").distinct()
    stored = vectors.select(F.col("uid").alias("uid2"), "rep", "n", F.col("v").alias("stored"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            x = [np.asarray(v, np.float64) for v in f["stored"]]
            x = [np.ldexp(v, -np.frexp(np.abs(v).max())[1]) for v in x]
            yield f.drop(columns="stored").assign(v=[_packed(v[None, :])[0] for v in x])

    dealt = near.join(stored, F.col("uid") == F.col("uid2")).select("uid", "rep", "label", "cell", "home", "stored", "n")
    dealt = materialise(dealt.mapInPandas(packed, f"uid long, rep long, label {label}, cell string, home boolean, n long, v binary"), "near-vectors")
    met = _chunked(dealt, tile)

    def meet(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rep", ignore_index=True)
        dim, k, _ = key[1].split(":")
        edges, k = block_edges(int(dim), layout(int(dim), bits, budget)[0]), int(k)
        x = _unpacked(f["v"].tolist(), int(dim))
        norm = np.linalg.norm(x, axis=1)
        y = x / norm[:, None] @ rotation(int(dim))
        rep, home, own, n = (f[c].to_numpy() for c in ("rep", "home", "own", "n"))
        shares = [budget * (b - a) / int(dim) for a, b in edges]
        a, b = edges[k]
        part = y[:, a:b]
        sq = (part**2).sum(axis=1)
        links, parent = np.zeros(len(f), np.int64), np.arange(len(f))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for s in range(0, len(f), 512):
            t = slice(s, min(s + 512, len(f)))
            near = sq[t, None] + sq[None, s:] - 2 * part[t] @ part[s:].T <= shares[k] + 1e-9
            p, q = np.nonzero(near)
            p, q = p + s, q + s
            use = (rep[p] < rep[q]) & home[p]
            if key[2] != key[3]:
                use &= own[p] != own[q]
            p, q = p[use], q[use]
            for at in range(0, len(p), 65536):
                i, j = p[at : at + 65536], q[at : at + 65536]
                first = ((y[i, a:b] - y[j, a:b]) ** 2).sum(axis=1) <= shares[k]
                for e, (c, d) in enumerate(edges[:k]):
                    first &= ((y[i, c:d] - y[j, c:d]) ** 2).sum(axis=1) > shares[e]
                i, j = i[first], j[first]
                good = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= threshold
                i, j = i[good], j[good]
                np.add.at(links, i, n[j])
                np.add.at(links, j, n[i])
                tops = parent
                while (tops != (up := tops[tops])).any():
                    tops = up
                fresh = np.unique(np.stack([tops[i], tops[j]])[:, tops[i] != tops[j]], axis=1)
                for u, v in fresh.T.tolist():
                    u, v = root(u), root(v)
                    if u != v:
                        parent[max(u, v)] = min(u, v)
        hit = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[hit], "links": links[hit], "root": rep[[root(i) for i in hit]] if hit.size else rep[:0]})

    found = materialise(met.groupBy("label", "cell", "i", "j").applyInPandas(meet, "rep long, links long, root long"), "vector-links")
    return found.groupBy("rep").agg(F.sum("links").alias("links")), found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept (vec_id = component_id).

    Compared only under equal, non-null labels and equal dimensions.  Vectors that are null, empty, zero or hold null or
    non-finite components, and rows with a null label or id, link with nothing: they are their own component.  Equal
    vectors are collapsed before the join and counted as links of each other.  Different vectors under one id count as
    one node, whose links are summed.  Empty table: no rows.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = "vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    v = v.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)))
    groups = v.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = materialise(groups.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    links, edges = link_vectors(reps, threshold)
    parts = connected_components(edges)
    named = reps.join(parts, F.col("rep") == F.col("node"), "left").join(links.withColumnRenamed("rep", "r2"), F.col("rep") == F.col("r2"), "left")
    named = named.select(F.col("label").alias("l2"), F.col("v").alias("v2"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"), "n")
    total = reps.agg(F.sum("n")).first()[0] or 0
    out = hot_join(v.where("fine"), named, (F.col("label") == F.col("l2")) & (F.col("v") == F.col("v2")), total).select("vec_id", "links", "component")
    out = out.unionByName(v.where("not fine").select("vec_id"), allowMissingColumns=True)
    comp = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))
