"""Mixing sources to target weights by Pfair scheduling.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bind, materialise, salted_rank


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def whole_weights(weights: DataFrame) -> DataFrame:
    """weights (source, weight) -> (source, w, total): positive weights as whole parts of a total, 2^30 for the largest
    and at least 1, so that releases and deadlines are exact; null, zero and negative weights are left out."""
    all_of = Window.partitionBy(F.lit(0))
    w = weights.where("weight > 0").withColumn("w", F.greatest(F.lit(1), F.round(F.col("weight") / F.max("weight").over(all_of) * (1 << 30)).cast("long")))
    return w.select("source", "w", F.sum("w").over(all_of).alias("total"))


def schedule(sources: DataFrame, steps: int, chunk: int = 512) -> DataFrame:
    """(source, w, total, blocks) -> (source, j, release, deadline, slot, step) of every block, by earliest deadline first.

    Block j of a source is released at floor(j * total / w) and due at ceil((j + 1) * total / w), in whole numbers.  A
    slot goes to the released block with the earliest deadline (ties by name) and stays empty if none is released.  All
    windows together are feasible, since the weights sum to one, so every deadline is met and each source is less than one
    block from its target at every slot before it ends.  One fold over the `steps` blocks carries all counts: a step takes
    the next slot, or the next release where nothing is released before, so empty slots cost nothing; steps
    are gathered in chunks so that no long array is copied.
    """
    row = sources.agg(F.sort_array(F.collect_list(F.struct("source", "w", "total", "blocks"))).alias("q")).where("size(q) > 0")
    row = row.select(F.transform("q", lambda s, at: F.struct(s["source"].alias("source"), s["w"].alias("w"), s["total"].alias("total"), s["blocks"].alias("blocks"), at.alias("at"))).alias("q"))
    none = "cast(array() as array<struct<i:int,j:bigint,slot:bigint>>)"

    def step(a: Column, _: Column) -> Column:
        released = F.array_min(F.zip_with("q", a["k"], lambda s, k: F.when(k < s["blocks"], _div(k * s["total"], s["w"]))))

        def at_slot(now: Column) -> Column:
            free = F.zip_with("q", a["k"], lambda s, k: F.when((k < s["blocks"]) & (_div(k * s["total"], s["w"]) <= now), F.struct(_div((k + 1) * s["total"] + s["w"] - 1, s["w"]).alias("due"), s["at"].alias("at"))))
            taken = lambda i: F.struct((now + 1).alias("t"), F.transform(a["k"], lambda k, at: k + F.when(at == i, 1).otherwise(0)).alias("k"), F.concat(a["s"], F.array(F.struct(i.alias("i"), F.get(a["k"], i).alias("j"), now.alias("slot")))).alias("s"))
            return bind(F.array_min(free)["at"], taken)

        return bind(F.greatest(a["t"], released), at_slot)

    def chunk_of(a: Column, c: Column) -> Column:
        inside = F.sequence(c * chunk, F.least(c * chunk + chunk, F.lit(steps)) - 1)
        return bind(F.aggregate(inside, F.struct(a["t"].alias("t"), a["k"].alias("k"), F.expr(none).alias("s")), step), lambda x: F.struct(x["t"].alias("t"), x["k"].alias("k"), F.concat(a["s"], F.array(x["s"])).alias("s")))

    start = F.struct(F.lit(0).cast("long").alias("t"), F.transform("q", lambda s: F.lit(0).cast("long")).alias("k"), F.expr("cast(array() as array<array<struct<i:int,j:bigint,slot:bigint>>>)").alias("s"))
    laid = row.select("q", F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit((steps - 1) // chunk).cast("long")), start, chunk_of, lambda a: F.flatten(a["s"])).alias("taken"))
    laid = laid.select("q", F.posexplode("taken").alias("step", "x")).select(F.col("step").cast("long").alias("step"), F.col("x.slot").alias("slot"), F.get("q", F.col("x.i")).alias("s"), F.col("x.j").alias("j"))
    return laid.select("s.source", "j", _div(F.col("j") * F.col("s.total"), F.col("s.w")).alias("release"), _div((F.col("j") + 1) * F.col("s.total") + F.col("s.w") - 1, F.col("s.w")).alias("deadline"), "slot", "step")


def mix(rows: DataFrame, weights: DataFrame | None = None, source_col: str = "source", id_col: str = "doc_id", block: int = 32, most: int = 1 << 19, power: float = 0.7, bucket_rows: int = 128, prefix: str = "", step_col: str | None = None) -> DataFrame:
    """rows plus block, release, deadline, slot, place: the slots of all blocks, and the row's place in its block.

    weights: (source, weight), or else each source's count to `power`.  A source's rows are put in an order by the MD5 of
    their ids, dealt over buckets so that a source with a third of all rows is no single group, and cut into blocks,
    which take the slots of `schedule`.  Blocks have `block` rows, whatever the weights; only beyond `most` blocks (16.8
    million rows in blocks of 32) they have as many more as keeps the plan, which every executor gets, at that size.  A source
    is less than one block from its target throughout.  Every row returns once: where a source has ended its slots stay
    empty and the others keep theirs.  Sources without a positive weight, and a null source unless it is weighted, follow
    at the end of the order with null slots.  Null ids count as empty; ties and repeated rows stand next to each other.
    Empty table: no rows.  The fold takes blocks x sources steps: meant for up to some thousand sources.
    """
    sizes = materialise(rows.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("c")), "mix-sizes")
    if weights is None:
        weights = sizes.select("source", F.round(F.pow(F.col("c"), F.lit(power)), 6).alias("weight"))
    counted = sizes.select(F.col("source").alias("_pl_s"), "c")
    due = whole_weights(weights).join(counted, F.col("source").eqNullSafe(F.col("_pl_s"))).select("source", "w", "total", "c")
    block = max(block, -(-(due.agg(F.sum("c")).first()[0] or 0) // most))
    due = due.withColumn("blocks", F.ceil(F.col("c") / block))
    plan = materialise(schedule(due, max(1, due.agg(F.sum("blocks")).first()[0] or 0)), "mix-plan")
    # a source has as many buckets as its rows need, 2^16 at most
    dealt = sizes.select(F.col("source").alias("_pl_s"), F.least(F.lit(1 << 16), F.ceil(F.col("c") / bucket_rows)).alias("_pl_buckets"))
    spread = rows.join(dealt, F.col(source_col).eqNullSafe(F.col("_pl_s")))
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    bucket = (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.col("_pl_buckets") / F.lit(1 << 32)).cast("long")
    numbered = salted_rank(spread, [source_col], [key, F.col(id_col)], bucket, "_pl_no").withColumn("_pl_block", F.floor(F.col("_pl_no") / block))
    laid = plan.select(F.col("source").alias("_pl_s2"), F.col("j").alias("_pl_j2"), *[F.col(c).alias(f"_pl_{c}") for c in ("release", "deadline", "slot", "step")])
    # at most `most` rows and one a source
    out = numbered.join(F.broadcast(laid), F.col(source_col).eqNullSafe(F.col("_pl_s2")) & (F.col("_pl_block") == F.col("_pl_j2")), "left")
    named = {"block": F.col("_pl_block"), "release": F.col("_pl_release"), "deadline": F.col("_pl_deadline"), "slot": F.col("_pl_slot"), "place": F.pmod(F.col("_pl_no"), F.lit(block))}
    if step_col:
        named[step_col] = F.col("_pl_step")
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[x.cast("long").alias(prefix + k) for k, x in named.items()])


def mixed_order(rows: DataFrame, order_col: str | None = None, **options) -> DataFrame:
    """The rows themselves, range-partitioned and sorted in the mixed order, so files written from them are in it.

    order_col names a column to add that keeps the order for later stages: the block's number in the schedule in its upper part, the place in the
    block in the lower 40 bits, null without a slot.  Options, nulls, ties, repeated rows and the empty table: as in mix().
    """
    names = rows.columns
    laid = mix(rows, prefix="_pl_mix_", step_col="step", **options)
    order = [F.asc_nulls_last("_pl_mix_step"), F.asc_nulls_last("_pl_mix_block"), F.asc("_pl_mix_place")]
    kept = [(F.shiftleft("_pl_mix_step", 40) + F.col("_pl_mix_place")).alias(order_col)] if order_col else []
    return laid.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in names], *kept)
