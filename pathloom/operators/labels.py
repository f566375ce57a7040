"""Distance labels kept as a partitioned table of versions, and delta-stepping over it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathloom.functions.scalar import INF, sat_add
from pathloom.functions.tables import delete_path, discard, materialise, own_dir


class LabelStore:
    """Labels (keys, v, dist), each with its latest version, in hash parts of (keys, v).

    A round adds the rows it changes and no others, so what a loop writes follows its frontier and not the table; a label
    of INF is one taken away.  Reading names the parts it needs, and other parts' files are not opened.  Once the added
    rows outnumber the oldest version, all are written anew as one.
    """

    def __init__(self, labels: DataFrame, keys: list[str], parts: int | None = None, prune: int = 1 << 20):
        self.spark: SparkSession = labels.sparkSession
        self.keys, self.by, self.prune = keys, [*keys, "v"], prune
        self.parts = parts or max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.root = f"{own_dir(self.spark)}/labels-{uuid.uuid4().hex}"
        self.kinds = {f.name: f.dataType.simpleString() for f in labels.schema.fields}
        self.round, self.base, self.added, self.written = -1, 0, 0, []
        self.base = self.add(labels)[1]
        self.added = 0

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.parts)).cast("int")

    def _files(self, under: str = "") -> DataFrame:
        schema = ", ".join(f"{k} {self.kinds.get(k, 'long')}" for k in [*self.by, "dist"]) + ", part int" + ("" if under else ", round int")
        return self.spark.read.schema(schema).parquet(self.root + under)

    def add(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """rows (keys, v, dist), at most one a label, as the newest version: (what was written, how many rows)."""
        self.round += 1
        under = f"/round={self.round}"
        rows.select(*self.by, "dist", self._part().alias("part")).repartition("part").write.partitionBy("part").parquet(self.root + under)
        out = self._files(under).select(*self.by, "dist")
        n = out.count()
        self.added += n
        self.written.append(n)
        return out, n

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The latest labels, of some parts or of all; those of INF are left out."""
        rows = self._files()
        if parts is not None and len(parts) < self.parts:
            rows = rows.where(F.col("part").isin(parts))
        return rows.groupBy(*self.by).agg(F.max_by("dist", "round").alias("dist")).where(F.col("dist") < INF)

    def parts_of(self, rows: DataFrame) -> list[int]:
        """The parts that hold the labels of rows (keys, v): at most as many numbers as there are parts."""
        return sorted(r[0] for r in rows.select(self._part()).distinct().collect())

    def improve(self, candidates: DataFrame) -> tuple[DataFrame, int]:
        """The candidates (keys, v, dist) that are less than what is known, added as the newest version; how many they are.

        Of a store of many rows only the parts that the candidates fall into are read; for that they are written first.
        """
        low, many = candidates.where(F.col("dist") < INF).groupBy(*self.by).agg(F.min("dist").alias("dist")), self.base + self.added > self.prune
        low = materialise(low, "candidates") if many else low
        known = self.read(self.parts_of(low) if many else None).select(*[F.col(k).alias("_k_" + k) for k in self.by], F.col("dist").alias("was"))
        same = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in self.by]
        better = low.join(known, same, "left").where("was is null or dist < was")
        out = self.add(better.select(*self.by, "dist"))
        discard(low)
        return out

    def compact(self) -> None:
        """Writes all labels as one version if more rows were added than the oldest has; files read by others must be done with."""
        if self.added <= max(self.base, 1 << 16):
            return
        old = list(range(self.round + 1))
        self.base = self.add(self.read())[1]
        self.added = 0
        for k in old:
            delete_path(self.spark, f"{self.root}/round={k}")

    def drop(self) -> None:
        """Deletes all files."""
        delete_path(self.spark, self.root)


def _step(front: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    e = edges.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("weight").alias("_weight"))
    j = front.join(e, F.col("v") == F.col("_src"))
    return j.select(*keys, F.col("_dst").alias("v"), sat_add(F.col("dist"), F.col("_weight")).alias("dist"))


def settle(store: LabelStore, front: DataFrame, edges: DataFrame, delta: int | None = None, counters: list[dict] | None = None) -> None:
    """Expands the labels of front (keys, v, dist), which stand in the store, and all that improve by them, until none does.

    With a `delta` it goes bucket by bucket of so much distance: arcs of a weight up to delta are relaxed within a bucket
    until it is quiet, the heavier ones once, when its labels are final; a label that is improved before its bucket comes is never expanded.
    Without, every round relaxes all arcs of all labels that improved last.  `counters` gets a dict a round: bucket, kind,
    expanded, written.
    """
    keys, note = store.keys, [] if counters is None else counters

    def improve(of: DataFrame, over: DataFrame, bucket: int, kind: str) -> tuple[DataFrame, int]:
        out = store.improve(_step(of, over, keys))
        if counters is not None:
            note.append({"bucket": bucket, "kind": kind, "expanded": of.count(), "written": out[1]})
        return out

    if delta is None:
        n = 1
        while n:
            front, n = improve(front, edges, 0, "all")
            if store.added > max(store.base, 1 << 16):
                kept = materialise(front, "front")
                store.compact()
                front = kept
        return
    light, heavy = edges.where(F.col("weight") <= delta), edges.where(F.col("weight") > delta)
    any_heavy = not heavy.isEmpty()
    waiting = materialise(front.select(*keys, "v", "dist"), "waiting")
    while (low := waiting.agg(F.min("dist")).first()[0]) is not None:
        bucket = low // delta
        inside = F.col("dist") < (bucket + 1) * delta
        active, later, done = waiting.where(inside), [waiting.where(~inside)], []
        while active is not None:
            done.append(active)
            better, n = improve(active, light, bucket, "light")
            later.append(better.where(~inside))
            active = better.where(inside) if n and not better.where(inside).isEmpty() else None
        final = done[0]
        for d in done[1:]:
            final = final.union(d)
        final = materialise(final.groupBy(*keys, "v").agg(F.min("dist").alias("dist")), "bucket")
        if any_heavy:
            later.append(improve(final, heavy, bucket, "heavy")[0])
        rest = later[0]
        for x in later[1:]:
            rest = rest.union(x)
        named = final.select(*[F.col(k).alias("_k_" + k) for k in store.by])
        same = [F.col(k).eqNullSafe(F.col("_k_" + k)) for k in store.by]
        nxt = materialise(rest.groupBy(*keys, "v").agg(F.min("dist").alias("dist")).join(named, same, "left_anti"), "waiting")
        discard(waiting)
        discard(final)
        waiting = nxt
        store.compact()


def bucket_width(edges: DataFrame) -> int:
    """Twice the mean weight, 1 at least: a bucket then holds paths of a few arcs, so rounds stay few on a cluster."""
    return max(1, round(2 * (edges.agg(F.avg("weight")).first()[0] or 0)))


def delta_stepping(edges: DataFrame, sources: DataFrame, delta: int | None = None, counters: list[dict] | None = None) -> DataFrame:
    """(source, v, dist) of every vertex reachable from sources (source), by settle() over a fresh store."""
    src = sources.select(F.col("source").cast("long").alias("source")).where("source is not null").distinct()
    store = LabelStore(src.select("source", F.col("source").alias("v"), F.lit(0).cast("long").alias("dist")), ["source"])
    settle(store, store.read(), edges, bucket_width(edges) if delta is None else delta, counters)
    out = materialise(store.read(), "dist")
    store.drop()
    return out
