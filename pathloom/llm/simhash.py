"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pathloom.functions.scalar import splitmix64

from .common import bounded, byte_texts, hot_join, materialise, small_batches
from .components import connected_components

BITS = 64


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1)-1 masks over 64 bits: two values that differ in at most `radius` bits agree under one of them.

    Bit i gets a vector m(i) of radius+1 bits, none zero, spread evenly.  Mask v (v not zero) keeps the bits with an odd
    product <m(i), v>.  For any `radius` bits some v is orthogonal to all their vectors, so that mask hides them all.
    """
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((i % n + 1) & v).bit_count() & 1) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes, width: int = 3, seed: int = 42, block: int = 4096) -> int:
    """The SimHash of the word shingles of a text, in blocks so that memory does not grow with the text."""
    words = text.lower().split()
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, block):
        part = words[at : min(at + block, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.array([h64(s, seed) for s in shingles], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long): fp has the 64 bits of the fingerprint.  Null or wordless text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            fp = [_signed(fingerprint(t, width)) for t in byte_texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])

    d = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return d.mapInArrow(run, "id long, fp long")


def _forest(fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among values (rows of words) within the radius: each value is compared with those not yet
    reached."""
    out, rest = [], np.arange(len(fp))
    while rest.size > 1:
        stack, root, rest = [rest[0]], rest[0], rest[1:]
        while stack and rest.size:
            near = np.bitwise_count(fp[rest] ^ fp[stack.pop()]).sum(axis=1) <= radius
            if near.any():
                hit, rest = rest[near], rest[~near]
                out += [(int(x), int(root)) for x in hit]
                stack.extend(hit)
    return out


def _met(keyed: DataFrame, tile: int) -> DataFrame:
    """keyed (k, ...) without the keys met once, plus c: the number of chunks of about `tile` rows that its key needs.

    Keys are many times what Spark takes them for, which counts the values they are made from, so they never go through the driver."""
    sizes = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("k").alias("k2"), F.ceil(F.col("n") / tile).cast("int").alias("c"))
    return keyed.join(sizes.hint("merge"), F.col("k") == F.col("k2")).drop("k2")


def _bucket_links(met: DataFrame, radius: int) -> DataFrame:
    """(a, b): a spanning forest of each key's values within the radius, never all pairs; met: (k, rep long, fp, c), fp a
    long or the bytes of several.  A bucket of c chunks meets in pairs of them, so a task holds two at most and no link is
    lost."""
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("c")).cast("int")).withColumn("other", F.explode(F.when(F.col("c") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("c") - 1))))
    met = met.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.struct("rep", "fp").alias("v"))
    groups = met.groupBy("k", "i", "j").agg(F.sort_array(F.collect_list("v")).alias("vs")).where("size(vs) > 1").select("vs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(0)
            flat, ends = lists.flatten(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            rep, fp = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1)
            words = fp.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) if pa.types.is_integer(fp.type) else np.frombuffer(b"".join(fp.to_pylist()), np.uint64)
            words, pairs, at = words.reshape(len(rep), -1 if len(rep) else 1), set(), 0
            for end in ends:
                pairs.update((rep[at + x], rep[at + y]) for x, y in _forest(words[at:end], radius))
                at = end
            a, c = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(a), pa.int64()), pa.array(list(c), pa.int64())], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def simhash_links(values: DataFrame, radius: int = 3, tile: int = 2048) -> DataFrame:
    """(a, b) links that connect all values within the radius; values: distinct (fp long, rep long), rep names an fp.

    Each value is written under every covering mask; keys met once are dropped natively.
    """
    masks = [F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("x")) for i, m in enumerate(covering_masks(radius))]
    return _bucket_links(_met(values.select("rep", "fp", F.explode(F.array(*masks)).alias("k")), tile), radius)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, width: int = 3) -> DataFrame:
    """One row per row of docs: (id, fp, component): the smallest id reachable by fingerprints `radius` or fewer bits apart.

    Equal fingerprints are collapsed to their smallest id before any search.  Null and wordless texts have fingerprint 0
    and link like any other.  A null id takes no part and gets a null component.  Repeated rows each return their row.
    Empty table: no rows.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, width), "simhash")
    return _components(fps, lambda values: simhash_links(values, radius))


def _components(fps: DataFrame, links) -> DataFrame:
    """(id, fp, component) of fingerprints fps (id, fp), links(values) being the links of their different values."""
    values = materialise(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "simhash-values")
    parts = connected_components(links(values))
    named = values.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "rep").alias("c"), "n")
    return hot_join(fps, named, F.col("fp") == F.col("f"), fps.count()).select("id", "fp", F.when(F.col("id").isNotNull(), F.col("c")).alias("component"))


WORDS = 4  # of 64 bits in a wide fingerprint


def wide_fingerprint(text: bytes, width: int = 5, seed: int = 42, block: int = 4096) -> bytes:
    """A SimHash of 256 bits over the word shingles of a text: four hashes a shingle, mixed from one."""
    words = text.lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, n, block):
        part = words[at : min(at + block, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], np.uint64)
        h = np.stack([splitmix64(h + np.uint64(i)) for i in range(WORDS)], 1)
        ones += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n, bitorder="little").tobytes()


def partition_masks(bits: int, size: int, tables: int, seed: int = 5) -> np.ndarray:
    """`tables` masks of `size` bit places: the blocks of one random partition of all bits after another.

    A partition of p blocks covers the radius p - 1: fewer differing bits leave one of its blocks untouched.
    """
    r, found = np.random.default_rng(seed), []
    while len(found) < tables:
        order = r.permutation(bits)
        found += [np.sort(order[i : i + size]) for i in range(0, bits - size + 1, size)]
    return np.array(found[:tables])


def found_share(size: int, tables: int, radius: int, similarity: float, bits: int = 64 * WORDS) -> float:
    """The share of pairs of texts of a shingle similarity s that some mask finds and the radius admits.

    Such texts share 2s / (1 + s) of their shingles, so each bit differs with probability acos(2s / (1 + s)) / pi; the sum
    goes over all numbers of differing bits and not their mean, as few masks find the pairs that lie far out.
    """
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return sum(math.comb(bits, d) * apart**d * (1 - apart) ** (bits - d) * (1 - (1 - math.comb(bits - size, d) / math.comb(bits, d)) ** tables) for d in range(radius + 1))


def tables_for(size: int, radius: int, similarity: float, recall: float) -> int:
    """The least number of masks of `size` bits that finds `recall` of the pairs at a similarity; raises if the radius admits fewer."""
    if found_share(size, 1 << 40, radius, similarity) <= recall:
        raise ValueError("the radius admits fewer pairs")
    high = 1
    while found_share(size, high, radius, similarity) < recall:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if found_share(size, mid, radius, similarity) >= recall else (mid, high)
    return high


def mask_size(values: int) -> int:
    """Bits a mask keeps: two more than it takes to tell the values apart, so keys rarely meet by chance."""
    return max(12, values.bit_length() + 1)


def wide_links(values: DataFrame, radius: int = 51, similarity: float = 0.8, recall: float = 0.92, tile: int = 2048) -> DataFrame:
    """(a, b) links of wide fingerprints at most `radius` of 256 bits apart; values: distinct (fp binary, rep long).

    There are as many masks as find a pair at `similarity` with probability `recall` (see found_share()) at any number of
    values; nearer pairs are found almost surely, and those within the
    radius of partition_masks() always.  Keys per value grow as the 0.29th power of their number.  Only keys met twice
    are sent with a fingerprint.
    """
    size = mask_size(values.count())
    masks = partition_masks(64 * WORDS, size, tables_for(size, radius, similarity, recall))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(size)).astype(np.int64)
        for b in small_batches(batches, 1024):
            bits = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little")
            keys = np.stack([bits[:, m] @ weights * len(masks) + i for i, m in enumerate(masks)], 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), len(masks))), pa.array(keys.reshape(-1))], ["rep", "k"])

    keyed = values.select("rep", "fp").mapInArrow(run, "rep long, k long")
    met = _met(keyed, tile).join(values.select(F.col("rep").alias("r2"), "fp").hint("merge"), F.col("rep") == F.col("r2"))
    return _bucket_links(met.select("k", "rep", "fp", "c"), radius)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 51) -> DataFrame:
    """(id, fp, component) as simhash_components(), for texts whose shingles of five words are similar by 0.8 or more.

    64 bits and radius 3 find few of these.  Of texts at similarity 0.8 a radius of 51 in 256 bits and its masks link 92 %, at 0.7
    half, at 0.6 one in ten and at 0.5 none.  Nulls, wordless texts, repeats and the empty table: as there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([wide_fingerprint(t, width) for t in byte_texts(b.column(1))], pa.binary())], ["id", "fp"])

    d = bounded(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return _components(materialise(d.mapInArrow(run, "id long, fp binary"), "near"), lambda values: wide_links(values, radius))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that near_copies() links to a smaller id.  Rows with a null id stay; repeated rows of a kept id all
    stay; null and wordless texts are copies of each other; empty table: no rows."""
    gone = near_copies(docs, id_col, text_col).where("component <> id").select(F.col("id").alias("_pl_gone")).distinct()
    return docs.join(materialise(gone, "simhash-gone"), F.col(id_col) == F.col("_pl_gone"), "left_anti")
