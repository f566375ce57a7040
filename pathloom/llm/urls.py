"""URL filters by a cascade of Bloom filters over the corpus's keys."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import byte_texts, materialise

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def host_and_path(url: bytes) -> tuple[bytes, bytes]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: on to ?, # or the end.  No ://: both empty."""
    _, mark, rest = url.partition(b"://")
    if not mark:
        return b"", b""
    rest = rest.partition(b"#")[0].partition(b"?")[0]
    host, slash, path = rest.partition(b"/")
    return host.translate(_LOWER), slash + path


def keys_of(host: bytes, path: bytes, lengths: list[int]) -> Iterator[bytes]:
    """The keys under which a rule for this url could be listed, longest first; of one length, the longer host first."""
    suffixes, at = [host], 0
    while (at := host.find(b".", at) + 1) > 0:
        suffixes.append(host[at:])
    found = [(len(s) + n, len(s), s + path[:n]) for s in suffixes for n in lengths if n <= len(path)]
    return (k for _, _, k in sorted(found, reverse=True))


@dataclass
class Bloom:
    level: int
    bits: int
    hashes: int
    data: bytes = b""

    def cells(self, key: bytes) -> list[int]:
        h = xxhash.xxh64_intdigest(key, self.level)
        step = h >> 32 | 1
        return [((h & 0xFFFFFFFF) + i * step) % self.bits for i in range(self.hashes)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.data[c >> 3] >> (c & 7) & 1 for c in self.cells(key))

    @classmethod
    def sized(cls, level: int, n: int, rate: float) -> Bloom:
        rate = min(max(rate, 1e-9), 0.5)
        return cls(level, max(64, math.ceil(n * math.log2(1 / rate) / math.log(2))), max(1, round(math.log2(1 / rate))))


@dataclass
class Cascade:
    """Level 0 holds the listed keys, level 1 the unlisted ones it lets through, level 2 the listed ones level 1 lets
    through, and so on until none is left: exact for every key of the universe it was built over."""

    levels: list[Bloom] = field(default_factory=list)

    def __contains__(self, key: bytes) -> bool:
        for i, b in enumerate(self.levels):
            if key not in b:
                return i % 2 == 1
        return len(self.levels) % 2 == 1


def _filled(b: Bloom, keys: DataFrame) -> Bloom:
    """The filter with the keys of a table set; bits are or-ed in the cluster, the driver gets the filter's own size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.unique(np.array([c for k in byte_texts(batch.column(0)) for c in b.cells(k)], np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(cells >> 5), pa.array(np.int64(1) << (cells & 31))], ["w", "bit"])

    data = np.zeros((b.bits + 31) // 32, "<u4")
    for r in keys.select("key").mapInArrow(run, "w long, bit long").groupBy("w").agg(F.bit_or("bit").alias("bit")).toLocalIterator():
        data[r["w"]] = r["bit"]
    return Bloom(b.level, b.bits, b.hashes, data.tobytes())


def _passing(keys: DataFrame, b: Bloom) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([k in b for k in byte_texts(batch.column(0))], pa.bool_()))

    return keys.select("key").mapInArrow(run, "key string")


def build_cascade(universe: DataFrame, listed: DataFrame, max_levels: int = 64, most_bytes: int = 256 << 20) -> Cascade:
    """A cascade exact on universe and listed (both: distinct key).

    With r listed of s keys, level 0 errs at r / (sqrt(2) s) and later ones at 1/2, so every level after the first holds
    fewer than r keys as expected and the whole takes about r (1.44 log2(s / r) + 5) bits: its size follows the list.  It goes to every worker, so a list
    that needs more than `most_bytes` raises before anything is built.
    """
    r, s = listed.count(), universe.count()
    if r * (math.log2(max(2.0, s / max(1, r))) * 1.45 + 6) / 8 > most_bytes:
        raise ValueError(f"a list of {r} keys needs more than {most_bytes} bytes in every worker")
    levels: list[Bloom] = []
    inside, outside = listed, universe
    n = r
    while n and len(levels) < max_levels:
        b = _filled(Bloom.sized(len(levels), n, r / (math.sqrt(2) * max(s, 1)) if not levels else 0.5), inside)
        levels.append(b)
        through = _passing(outside, b)
        if len(levels) == 1:
            through = through.join(listed.withColumnRenamed("key", "_k"), F.col("key") == F.col("_k"), "left_anti")
        inside, outside = materialise(through, "cascade"), inside
        n = inside.count()
    if n:
        raise RuntimeError("the cascade did not end")
    return Cascade(levels)


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    rules: key (host + path prefix, as example.net/en/) and verdict (block or allow); a rule fits its host and all its
    subdomains if the path starts with its own; the longest key wins, of equals the one with the longer host.  A key with
    both verdicts is allowed.  Urls that no rule fits are in no list: allow.  Null urls have an empty host and path.
    One cascade tells listed keys from all keys of the corpus, a second the blocked from the allowed among the listed;
    neither grows with the corpus but by the logarithm of its keys, and pages meet no join.  Empty tables: no rows, or
    all allowed.
    """
    rules = materialise(rules.where("key is not null and verdict is not null").groupBy("key").agg(F.min("verdict").alias("verdict")), "rules")
    lengths = sorted(r[0] for r in rules.select(F.octet_length("key") - F.expr("coalesce(nullif(position('/', key), 0) - 1, octet_length(key))")).distinct().collect())
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("u"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = {k for u in byte_texts(b.column(0)) for k in keys_of(*host_and_path(u), lengths)}
            yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.binary()).cast(pa.string())], ["key"])

    universe = materialise(p.select("u").mapInArrow(emit, "key string").distinct(), "universe")
    listed = build_cascade(universe, rules.select("key"))
    blocked = build_cascade(rules.select("key"), rules.where("verdict = 'block'").select("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths, found, verdict = [], [], [], []
            for u in byte_texts(b.column(1)):
                host, path = host_and_path(u)
                key = next((k for k in keys_of(host, path, lengths) if k in listed), None)
                hosts.append(host)
                paths.append(path)
                found.append(key)
                verdict.append("block" if key is not None and key in blocked else "allow")
            cols = [pa.array(c, pa.binary()).cast(pa.string()) for c in (hosts, paths, found)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return p.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
