"""Removing long passages that repeat across documents, behind a count-min prefilter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from .common import bounded, byte_texts, hot_join, materialise, small_batches

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
GRAM = 8


class WordHashes(dict):
    """64-bit hashes of words, memoised up to a bound."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        if len(word) < 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int, memo: dict = {}) -> np.ndarray:  # noqa: B006
    p = memo.get(base)
    if p is None or len(p) < n:
        p = np.full(max(n, 4096), base, np.uint64)
        p[0] = 1
        p = memo[base] = np.multiply.accumulate(p)
    return p[:n]


def _rolling(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` word hashes, equal for equal runs wherever they stand."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(BASE, len(h)), out=sums[1:])
    n = len(h) - width + 1
    x = (sums[width:] - sums[:n]) * _powers(INVERSE, n)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def anchored(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each window, hash of its anchor, place of its anchor).

    A window's anchor is its run of GRAM words with the least hash, so equal windows have equal anchors, a window occurs
    at most as often as its anchor, and neighbouring windows mostly share one.
    """
    gram = min(GRAM, window)
    grams = _rolling(h, gram)
    n, span = len(h) - window + 1, window - gram + 1
    at = np.empty(n, np.int64)
    for s in range(0, n, 65536):
        e = min(n, s + 65536)
        at[s:e] = sliding_window_view(grams[s : e + span - 1], span).argmin(axis=1) + np.arange(s, e)
    return _rolling(h, window), grams[at], at


def _cells(anchors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The two cells of an anchor; the second row of the sketch stands behind the first."""
    mask = np.uint64(width - 1)
    return (anchors & mask).astype(np.int64), ((anchors >> np.uint64(33)) * np.uint64(0x9E3779B1) & mask).astype(np.int64) + width


def _among(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether each of x is in a sorted array that isn't empty."""
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def repeated_cells(docs: DataFrame, window: int, width: int, id_col: str, text_col: str, hot: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    """Pass 1: a bitmap of the count-min cells whose merged count over all partitions is two or more, and the sorted cells
    with more than `hot`.

    Each task sketches its batches (anchors once a document); sketches merge by a sum per cell.  The bitmap has 2 * width
    bits, whatever the input; hot cells are as many at most as all anchors by `hot`.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            found = [np.empty(0, np.int64)]
            for t in byte_texts(b.column(0)):
                words = t.split()
                if len(words) >= window:
                    found += _cells(np.unique(anchored(hashes.of(words), window)[1]), width)
            cell, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int32))], ["cell", "n"])

    block = 1 << 16  # bits in a returned row
    cells = bounded(docs, "8m").where(f"`{id_col}` is not null").select(text_col).mapInArrow(sketch, "cell long, n int").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").select("cell", (F.col("cell") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(cell % 64 as int)) as bit"), (F.col("n") > hot).alias("hot"))
    words = cells.groupBy("w").agg(F.bit_or("bit").alias("bits"), F.bit_or(F.when(F.col("hot"), F.col("bit")).otherwise(0)).alias("hots")).select((F.col("w") / (block // 64)).cast("long").alias("g"), F.struct("w", "bits", "hots").alias("x"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ends = b.column(1), np.cumsum(b.column(1).value_lengths().to_numpy(zero_copy_only=False))
            flat, out, hots, at = xs.flatten(), [], [], 0
            w, bits, hot_bits = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            for e in ends:
                m, h = np.zeros((2, block // 64), np.int64)
                m[w[at:e] % (block // 64)] = bits[at:e]
                h[w[at:e] % (block // 64)] = hot_bits[at:e]
                out.append(m.tobytes())
                hots.append(np.flatnonzero(np.unpackbits(h.view(np.uint8), bitorder="little")).tolist())
                at = e
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), pa.array(hots, pa.list_(pa.int64()))], ["g", "m", "hots"])

    bitmap, hot_cells = np.zeros((max(2 * width, block) // block, block // 8), np.uint8), [np.empty(0, np.int64)]
    for r in words.groupBy("g").agg(F.collect_list("x").alias("xs")).mapInArrow(blocks, "g long, m binary, hots array<long>").toLocalIterator():
        bitmap[r["g"]] = np.frombuffer(r["m"], np.uint8)
        hot_cells.append(np.array(r["hots"], np.int64) + r["g"] * block)
    return bitmap.reshape(-1), np.sort(np.concatenate(hot_cells))


def sketch_width(size: int, most: int = 1 << 28) -> int:
    """Cells in a sketch row: the power of two above a 32nd of the bytes (about four cells an anchor), within bounds.

    At the upper bound the bitmap takes 64 MB; more input then only makes the prefilter let more windows through.
    """
    return min(most, max(1 << 16, 1 << int(size // 32).bit_length()))


def repeated_windows(docs: DataFrame, window: int = 50, width: int | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """(id, digest, lo, hi): first and last starts of runs of windows that also start in a document with a smaller id.

    digest is the xxhash64 of the text, so that rows repeating an id keep apart.  Pass 2 sends only windows whose anchor
    the sketch has met twice, packed by anchor occurrence and copies of an occurrence in a batch once.  They are grouped
    by the anchor's hash and compared by the window's hash and its distance to the anchor: exact, unless two words of the
    corpus or two windows of an anchor share a 64-bit hash.

    Anchors that over `hot` documents may hold (a 500th of all, 1000 at least) take another way, as their group would be
    one task's: their windows are single rows, the least id of a window is found by partial minima, and the most frequent
    windows get it by broadcast.
    """
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    bitmap, hot_cells = repeated_cells(docs, window, width := width or sketch_width(size or 0), id_col, text_col, max(1000, n // 500) if hot is None else hot)
    bits = docs.sparkSession.sparkContext.broadcast((bitmap, hot_cells))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (bitset, hot_set) = WordHashes(), bits.value
        for b in batches:
            met: dict[tuple, list] = {}
            for doc, digest, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), strict=True):
                words = t.split()
                if len(words) < window:
                    continue
                whole, anchor, at = anchored(hashes.of(words), window)
                hit = np.ones(len(at), bool)
                cells = _cells(anchor, width)
                for c in cells:
                    hit &= (bitset[c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
                often, here = np.zeros(len(at), bool), np.flatnonzero(hit)
                if hot_set.size and here.size:
                    often[here] = _among(hot_set, cells[0][here]) & _among(hot_set, cells[1][here])
                # an anchor occurrence is a run of windows with one place; all of a run hit or none
                edge = np.flatnonzero(np.diff(at, prepend=-1))
                for s, e in zip(edge, [*edge[1:], len(at)], strict=True):
                    if hit[s]:
                        met.setdefault((int(anchor[s].view(np.int64)), int(at[s] - s), whole[s:e].tobytes(), bool(often[s])), []).append((doc, digest, int(s)))
            keys, lists = list(met), list(met.values())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.binary()), pa.array([k[3] for k in keys], pa.bool_()), pa.array([min(x)[0] for x in lists], pa.int64()), *(pa.array([[y[i] for y in x] for x in lists], pa.list_(pa.int64())) for i in range(3))], ["a", "rel", "hashes", "hot", "low", "ids", "digests", "starts"])

    d = docs.where(f"`{id_col}` is not null").select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("t"))
    runs = d.mapInArrow(probe, "a long, rel int, hashes binary, hot boolean, low long, ids array<long>, digests array<long>, starts array<long>")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (anchor, least id): a window is repeated if an earlier, smaller id has it.  What is kept for
        an anchor grows with its different contexts, not with its occurrences."""
        current, first = None, {}
        for b in batches:
            out: list[tuple[int, int, bytes]] = []
            for a, rel, hs, low, ids, digests, starts in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if a != current:
                    current, first = a, {}
                hs = np.frombuffer(hs, np.uint64).tolist()
                owner = np.array([first.setdefault((h, rel - k), low) for k, h in enumerate(hs)])
                for doc, digest, s in zip(ids, digests, starts, strict=True):
                    gone = np.flatnonzero(owner < doc)
                    if gone.size:
                        # runs of consecutive windows become (first, last)
                        cut = np.flatnonzero(np.diff(gone) != 1)
                        ends = np.stack([np.r_[gone[0], gone[cut + 1]], np.r_[gone[cut], gone[-1]]], 1) + s
                        out += [(doc, digest, int(x), int(y)) for x, y in ends]
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "digest", "lo", "hi"])

    def settled(runs: DataFrame) -> DataFrame:
        return runs.drop("hot").repartition("a").sortWithinPartitions("a", "low").mapInArrow(settle, "id long, digest long, lo long, hi long")

    if not hot_cells.size:
        return settled(runs)
    runs = materialise(runs, "window-runs")
    return settled(runs.where("not hot")).unionByName(_hot_windows(runs.where("hot")))


def _hot_windows(runs: DataFrame) -> DataFrame:
    """repeated_windows() of the runs of hot anchors: a row a window, met by its hash."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 16):  # a row's lists are written once a window
            hs = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            each = np.repeat(np.arange(b.num_rows), [len(x) for x in hs])
            step = np.concatenate([np.arange(len(x)) for x in hs]) if hs else np.empty(0, np.int64)
            rel = b.column(0).to_numpy(zero_copy_only=False)[each] - step
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs) if hs else step), pa.array(rel.astype(np.int32)), pa.array(step), *(b.column(i).take(pa.array(each)) for i in (2, 3, 4, 5))], ["h", "rel", "step", "low", "ids", "digests", "starts"])

    schema = "h long, rel int, step long, low long, ids array<long>, digests array<long>, starts array<long>"
    windows = runs.select("rel", "hashes", "low", "ids", "digests", "starts").mapInArrow(split, schema)
    none = F.expr("cast(null as array<long>)")
    bare = runs.select("rel", "hashes", "low", none.alias("ids"), none.alias("digests"), none.alias("starts")).mapInArrow(split, schema)
    least = materialise(bare.groupBy("h", "rel").agg(F.min("low").alias("owner"), F.count(F.lit(1)).alias("n")), "window-owners").select(F.col("h").alias("h2"), F.col("rel").alias("rel2"), "owner", "n")
    total = least.agg(F.sum("n")).first()[0] or 0
    met = hot_join(windows, least, (F.col("h") == F.col("h2")) & (F.col("rel") == F.col("rel2")), total, "inner")
    each = met.select("owner", "step", F.explode(F.arrays_zip("ids", "digests", "starts")).alias("x")).where(F.col("owner") < F.col("x.ids"))
    at = F.col("x.starts") + F.col("step")
    return each.select(F.col("x.ids").alias("id"), F.col("x.digests").alias("digest"), at.alias("lo"), at.alias("hi"))


def drop_repeated(docs: DataFrame, window: int = 50, width: int | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by blanks, without words of repeated windows.

    Judged on the input.  Null text: no words.  Documents under `window` words and null ids lose nothing; rows that share
    an id are no copies of each other.  Empty table: no rows.
    """
    gone = repeated_windows(docs, window, width, id_col, text_col, hot).groupBy("id", "digest").agg(F.collect_set(F.struct("lo", "hi")).alias("runs")).select(F.col("id").alias("i2"), F.col("digest").alias("d2"), "runs")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("t"))
    both = d.join(gone, (F.col("id") == F.col("i2")) & (F.col("digest") == F.col("d2")), "left").select("id", "t", "runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for t, runs in zip(byte_texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                words = t.split()
                n.append(len(words))
                if runs:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for r in runs:
                        cover[r["lo"]] += 1
                        cover[r["hi"] + window] -= 1
                    keep = np.cumsum(cover[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(keep)]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
