"""Synthetic graphs with pinned random streams: the same seed gives the same arcs and weights everywhere.

The grid is relational; the others draw from one sequential stream on the driver, whose size is theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from pathloom.functions.scalar import splitmix64
from pathloom.functions.tables import global_rank

# The seeds of the five published-size graphs and the largest arc weight.
SEEDS = {"grid": 0xA47E5, "uniform": 0x147A11, "preferential": 0x5CA1EF, "small_world": 0x5A411, "clustered": 0xC1A57}
MOST = 100_000
_MASK = (1 << 64) - 1


def arc_weights(src: np.ndarray, dst: np.ndarray, seed: int) -> np.ndarray:
    """Weights in 1..MOST from the ends of an arc alone: SplitMix64 of the seed and both ends."""
    mixed = np.uint64(seed) ^ ((src.astype(np.uint64) + np.uint64(1)) << np.uint64(32)) ^ (dst.astype(np.uint64) + np.uint64(1))
    return (splitmix64(mixed) % np.uint64(MOST)).astype(np.int64) + 1


def weight_of(src: Column, dst: Column, seed: int) -> Column:
    @pandas_udf("long")
    def w(u: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series(arc_weights(u.to_numpy(), v.to_numpy(), seed))

    return w(src, dst)


def _draws(seed: int) -> Iterator[int]:
    """The stream x, f(x), f(f(x)), ... of SplitMix64 from f(seed) on."""
    x = seed & _MASK
    while True:
        z = x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & _MASK
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & _MASK
        x = z ^ (z >> 31)
        yield x


def grid(spark: SparkSession, side: int = 224, seed: int = SEEDS["grid"]) -> DataFrame:
    """A square grid with arcs both ways between neighbours: edge_id, src, dst, weight."""
    v = spark.range(side * side).select("id", (F.col("id") % side).alias("x"), F.floor(F.col("id") / side).alias("y"))
    steps = F.array(F.when(F.col("x") < side - 1, F.col("id") + 1), F.when(F.col("x") > 0, F.col("id") - 1), F.when(F.col("y") < side - 1, F.col("id") + side), F.when(F.col("y") > 0, F.col("id") - side))
    e = v.select(F.col("id").alias("src"), F.explode(steps).alias("dst")).where("dst is not null")
    ranked = global_rank(e, ["src", "dst"], F.floor(F.col("src") / 4096), "edge_id")
    return ranked.select("edge_id", "src", "dst", weight_of(F.col("src"), F.col("dst"), seed).alias("weight"))


def _frame(spark: SparkSession, pairs: set[tuple[int, int]], seed: int) -> DataFrame:
    ends = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    f = pd.DataFrame({"edge_id": np.arange(len(ends)), "src": ends[:, 0], "dst": ends[:, 1], "weight": arc_weights(ends[:, 0], ends[:, 1], seed)})
    return spark.createDataFrame(f, "edge_id long, src long, dst long, weight long")


def _other(draw: Iterator[int], n: int, self_: int) -> int:
    """One of n places that isn't self_."""
    x = next(draw) % (n - 1)
    return x + (x >= self_)


def uniform(spark: SparkSession, n: int = 50_000, degree: int = 6, seed: int = SEEDS["uniform"]) -> DataFrame:
    """`degree` different random targets a vertex."""
    draw, pairs = _draws(seed), set()
    for u in range(n):
        mine: set[int] = set()
        while len(mine) < degree:
            mine.add(_other(draw, n, u))
        pairs.update((u, v) for v in mine)
    return _frame(spark, pairs, seed)


def preferential(spark: SparkSession, n: int = 50_000, m: int = 4, seed: int = SEEDS["preferential"]) -> DataFrame:
    """New vertices attach both ways to m others, each with odds by its degree, from a clique of m + 1."""
    draw, pairs = _draws(seed), set()
    for u, v in combinations(range(m + 1), 2):
        pairs |= {(u, v), (v, u)}
    ends = [u for u in range(m + 1) for _ in range(m)]
    for u in range(m + 1, n):
        mine: set[int] = set()
        while len(mine) < m:
            mine.add(ends[next(draw) % len(ends)])
        for v in mine:
            pairs |= {(u, v), (v, u)}
        ends += [*sorted(mine), *[u] * m]
    return _frame(spark, pairs, seed)


def small_world(spark: SparkSession, n: int = 50_000, k: int = 8, percent: int = 10, seed: int = SEEDS["small_world"]) -> DataFrame:
    """A ring of k nearest neighbours with `percent` of the arcs rewired to an end their tail has no arc to yet."""
    draw, pairs = _draws(seed), set()
    for u in range(n):
        for d in range(1, k // 2 + 1):
            for v in ((u + d) % n, (u - d) % n):
                if next(draw) % 100 < percent:
                    v = _other(draw, n, u)
                    while (u, v) in pairs:
                        v = _other(draw, n, u)
                pairs.add((u, v))
    return _frame(spark, pairs, seed)


def clustered(spark: SparkSession, n: int = 50_000, communities: int = 100, local: int = 5, seed: int = SEEDS["clustered"]) -> DataFrame:
    """`local` arcs within a vertex's community and one to another community."""
    draw, pairs, size = _draws(seed), set(), n // communities
    for u in range(n):
        low, mine = u // size * size, set()
        while len(mine) < local:
            mine.add(low + _other(draw, size, u - low))
        far = next(draw) % n
        while far // size == u // size:
            far = next(draw) % n
        pairs.update((u, v) for v in (*mine, far))
    return _frame(spark, pairs, seed)
