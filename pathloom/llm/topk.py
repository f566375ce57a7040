"""Exact top-k search by integer inner product: an impact-ordered index, read score at a time."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded, materialise, small_batches

LOWEST = -(1 << 63)


def integers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component x as a double; null for a vector that takes no part: null, with a null or non-finite
    component, or so long that a score could leave 64 bits (a squared length of 2^62 in whole numbers)."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("long"))
    short = F.aggregate(v, F.lit(0.0), lambda a, x: a + (F.abs(x * F.lit(scale)) + 1) * (F.abs(x * F.lit(scale)) + 1)) < float(1 << 62)
    return F.when(fine & short, whole)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 and 8 bytes, after one byte that tells the width."""
    top = int(np.abs(x).max(initial=0))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind[-1].encode() + x.astype(kind).tobytes()


def _unpacked(b: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(b, f"<i{b[:1].decode()}", offset=1).astype(np.int64).reshape(-1, dim)


#: Where the segments of an index are cut: sizes of a component in units of the block's root mean square.
LEVELS = (1.5, 0.75, 0.375, 0.0)


def segments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(postings, cuts): the places in x.ravel() of all components but 0 in descending order of quantised impact, which is the
    level of their size; segment i holds postings[cuts[i]:cuts[i + 1]], ordered by dimension."""
    size = np.abs(x).T  # a row a dimension
    unit = math.sqrt(max(1.0, float((size.astype(np.float64) ** 2).mean())))
    level = np.full(size.shape, len(LEVELS), np.int8)
    for i, cut in reversed(list(enumerate(LEVELS))):
        level[size >= max(1.0, cut * unit)] = i
    order = np.argsort(level, axis=None, kind="stable")
    cuts = np.searchsorted(level.ravel()[order], np.arange(len(LEVELS) + 1))
    dim, slot = np.divmod(order[: cuts[-1]], x.shape[0])
    return slot * x.shape[1] + dim, cuts


class Block:
    """Some vectors with the impact-ordered segments of their components."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, postings: np.ndarray, cuts: np.ndarray):
        self.ids, self.x, self.postings, self.cuts = ids, x, postings, cuts
        self.sorted = np.argsort(ids, kind="stable")
        self.norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.parts, rest = [], x.astype(np.float64)
        for i in range(len(LEVELS)):
            part = np.zeros(x.size)
            at = postings[cuts[i] : cuts[i + 1]]
            part[at] = x.ravel()[at]
            part = part.reshape(x.shape)
            rest = rest - part
            self.parts.append((part, np.sqrt((rest**2).sum(axis=1))))

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, score, id, segments read), by query: the k best of the block that score `least` or more; rows with a query's own id are none.

        Score at a time: the segments of one impact add to the scores of all queries, greatest impacts first.  What the
        segments not read yet can add to a vector's score is at most the product of the query's length and the length of
        the vector's components in them.  Reading stops only where these bounds leave few vectors that may
        reach a score which k vectors have; all that they leave are scored in whole numbers.
        """
        m, n = len(queries), len(self.x)
        q, least, score = queries.astype(np.float64), least.copy(), np.zeros((m, n))
        length = np.sqrt((q**2).sum(axis=1))
        error = length[:, None] * self.norm.max(initial=0) * (q.shape[1] * 2.0**-50) + 1  # of sums beyond 2^53, and of the roots
        names = self.ids[self.sorted]
        low, high = np.searchsorted(names, own, "left"), np.searchsorted(names, own, "right")
        same = np.repeat(np.arange(m), high - low), self.sorted[np.concatenate([np.arange(a, b) for a, b in zip(low, high, strict=True)] + [np.zeros(0, int)]).astype(int)]
        for read, (part, rest) in enumerate(self.parts, 1):
            score += q @ part.T
            if read == 1 < len(self.parts):
                continue  # bounds are too wide yet to part any
            most = score + length[:, None] * rest + error
            most[same] = -np.inf
            if n > k:
                likely = np.argpartition(-most, k - 1, axis=1)[:, :k]
                found = np.einsum("ij,ikj->ik", queries, self.x[likely])
                found[~np.isfinite(np.take_along_axis(most, likely, axis=1))] = LOWEST
                least = np.maximum(least, found.min(axis=1))
            left = most >= least[:, None]
            left[same] = False
            if read == len(self.parts) or left.sum() <= m * max(4 * k, n // 64):
                break
        i, j = np.nonzero(left)
        exact = np.concatenate([np.einsum("ij,ij->i", queries[i[at : at + 32768]], self.x[j[at : at + 32768]]) for at in range(0, len(i), 32768)] or [np.zeros(0, np.int64)])
        keep = exact >= least[i]
        i, exact, ids = i[keep], exact[keep], self.ids[j[keep]]
        order = np.lexsort((ids, -exact, i))
        i, exact, ids = i[order], exact[order], ids[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        return i[rank < k], exact[rank < k], ids[rank < k], read


def impact_index(vectors: DataFrame, blocks: int) -> DataFrame:
    """(block, dim, ids, x, postings, cuts), a row for the vectors (vec_id, x array<long>) of one dimension in each of
    `blocks` equal parts: their ids, values, and segments() as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId(), {}
        for b in small_batches(batches, 1024):
            for dim, ids, x in _by_dimension(b):
                held.setdefault(dim, []).append((ids, x))
        for dim, parts in held.items():
            ids, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            postings, cuts = segments(x)
            row = [block, dim, ids.astype("<i8").tobytes(), _packed(x), _packed(postings), cuts.astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["block", "dim", "ids", "x", "postings", "cuts"])

    return vectors.repartition(blocks).mapInArrow(run, "block int, dim int, ids binary, x binary, postings binary, cuts binary")


def _by_dimension(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, values) of a batch of (vec_id, x)."""
    ids, lists = b.column(0).to_numpy(), b.column(1)
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == dim)
        if dim:
            yield dim, ids[of], flat[starts[of][:, None] + np.arange(dim)]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 16384, query_rows: int = 512, sample_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): of every row whose id is divisible by `every`, the k rows of the greatest integer inner
    product with it among all rows of other ids, ties to the smaller id.

    Vectors are dealt into blocks of about `block_rows`, each an impact-ordered index; queries into blocks of
    `query_rows`.  Each block of queries meets each block of vectors in a task's row of its own, which returns at most k rows a query.
    A sample of `sample_rows` vectors gives each query a score that k vectors reach before it starts: it saves
    reading and changes no result.  Blocks bound what a task holds; what moves are the blocks, once a block of the others.

    Vectors that are null or hold null or non-finite components, those whose scores could leave 64 bits, and rows with a null id take
    no part; so do empty vectors.  Vectors of other dimensions than the query's are no candidates.  Rows of one id are no
    candidates of each other, and each is a query of its own; equal vectors tie.  Fewer than k candidates: all of them.
    Empty table: no rows.
    """
    spark = vectors.sparkSession
    slim = bounded(vectors).select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col), scale).alias("x")).where("vec_id is not null and size(x) > 0")
    slim = materialise(slim, "integers")
    asks = slim.where(F.col("vec_id") % every == 0)
    n, m = slim.count(), asks.count()
    blocks, groups = max(1, -(-n // block_rows)), max(1, -(-m // query_rows))
    index = materialise(impact_index(slim, blocks), "impacts")
    sample = spark.sparkContext.broadcast([(r["vec_id"], list(r["x"])) for r in slim.limit(sample_rows).collect()])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of one dimension as a row of bytes, each with a score that k vectors reach."""
        part, held = TaskContext.get().partitionId(), {}
        for b in small_batches(batches, 1024):
            for dim, ids, x in _by_dimension(b):
                held.setdefault(dim, []).append((ids, x))
        for dim, parts in held.items():
            ids, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            known = [(i, v) for i, v in sample.value if len(v) == dim]
            least = np.full(len(ids), LOWEST, np.int64)
            if len(known) > k:
                names, y = np.array([i for i, _ in known], np.int64), np.array([v for _, v in known], np.int64)
                score = x @ y.T
                score[ids[:, None] == names] = LOWEST
                least = np.sort(score, axis=1)[:, -k]
            row = [part, dim, ids.astype("<i8").tobytes(), _packed(x), least.astype("<i8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "dim2", "asked", "q", "least"])

    queries = asks.repartition(groups).mapInArrow(group, "part int, dim2 int, asked binary, q binary, least binary")
    # a key for each block of queries and block of vectors that meet, dealt by an explicit number: few bytes may be much work
    pair = lambda group, block, dim: (F.col(group) * F.lit(blocks).cast("long") + F.col(block)) * 65536 + F.col(dim)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, 2 * groups * blocks))
    left = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("pair", pair("group", "block", "dim")).repartition(tasks, "pair")
    right = materialise(queries, "asked").withColumn("block2", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("pair2", pair("part", "block2", "dim2")).repartition(tasks, "pair2")
    met = left.join(right, F.col("pair") == F.col("pair2")).select("group", "dim", "ids", "x", "postings", "cuts", "asked", "q", "least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 1):
            if not b.num_rows:
                continue
            part, dim, ids, x, postings, cuts, asked, q, least = (c[0].as_py() for c in b.columns)
            block = Block(np.frombuffer(ids, "<i8"), _unpacked(x, dim), _unpacked(postings, 1)[:, 0], np.frombuffer(cuts, "<i8"))
            asked, q, least = np.frombuffer(asked, "<i8"), _unpacked(q, dim), np.frombuffer(least, "<i8")
            for at in range(0, len(asked), 128):
                place, score, vec, _ = block.best(q[at : at + 128], asked[at : at + 128], k, least[at : at + 128])
                place = place + at
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), part), pa.int32()), pa.array(np.full(len(place), dim), pa.int32()), pa.array(place, pa.int32()), pa.array(asked[place], pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())], ["part", "dim", "place", "query_id", "vec_id", "score"])

    found = met.mapInArrow(search, "part int, dim int, place int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("part", "dim", "place").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
