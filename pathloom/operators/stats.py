"""Statistics of paired benchmark measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pathloom.functions.scalar import phase_class, ratio
from pathloom.functions.tables import range_sum

#: Two-sided 95 % quantile of Student's t with two degrees of freedom; other sample sizes take the normal one.
T_THREE, Z = 4.302652729911275, 1.96


def nearest_rank(p: float) -> Column:
    """The 1-based rank ceil(p n) among n values."""
    return F.greatest(F.lit(1), F.ceil(F.col("n") * p))


def rounded_index(p: float) -> Column:
    """The 1-based rank of index round((n - 1) p), halves to even."""
    return F.bround((F.col("n") - 1) * p) + 1


def values_at(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], bits: int = 16) -> DataFrame:
    """(keys, n, one value a rank) of each group's non-null values in ascending order; a rank is a column of n, from 1.

    Equal values of a group become one row with their number.  These are summed in the order of group and value, range by
    range of what Spark samples, so every value knows its places among all; a wanted rank is such a place, and meets the value that holds it in
    a bin of 2^bits places.  So no group is collected or sorted whole, however its values are spread.  Null keys are groups; a group
    of nulls only is absent.
    """
    r = rows.where(F.col(value).isNotNull()).groupBy(F.struct(*keys).alias("k"), F.col(value).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    r = range_sum(r, [F.asc("k"), F.asc("x")], F.col("c"), "upto")
    ends = r.groupBy("k").agg(F.sum("c").alias("n"), F.min(F.col("upto") - F.col("c")).alias("start"))
    named = F.array(*[F.struct(F.lit(name).alias("name"), (F.col("start") + rank.cast("long")).alias("at")) for name, rank in ranks.items()])
    wanted = ends.select(F.col("k").alias("k2"), "n", F.explode(named).alias("r")).select("k2", "n", "r.name", "r.at", F.shiftright("r.at", bits).alias("bin2"))
    held = r.select("x", "c", "upto", F.explode(F.sequence(F.shiftright(F.col("upto") - F.col("c") + 1, bits), F.shiftright("upto", bits))).alias("bin"))
    got = held.join(wanted, (F.col("bin") == F.col("bin2")) & (F.col("at") > F.col("upto") - F.col("c")) & (F.col("at") <= F.col("upto")))
    one = got.groupBy("k2").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in ranks])
    return one.select("k2.*", "n", *ranks)


def medians(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, n, name): exact medians, the mean of the two middle values of an even number."""
    got = values_at(rows, keys, value, {"_lo": F.floor((F.col("n") + 1) / 2), "_hi": F.floor(F.col("n") / 2) + 1})
    return got.select(*keys, "n", ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def summaries(rows: DataFrame, keys: list[str], ns: str, rss: str, sums: list[str]) -> DataFrame:
    """(keys, n, median_ms, p95_ms, median_rss_mb, sums): one line a group of a summary report."""
    t = values_at(rows, keys, ns, {"lo": F.floor((F.col("n") + 1) / 2), "hi": F.floor(F.col("n") / 2) + 1, "p95": rounded_index(0.95)})
    t = t.select(F.struct(*keys).alias("k"), "n", F.round((F.col("lo") + F.col("hi")) / 2 / 1e6, 3).alias("median_ms"), F.round(F.col("p95") / 1e6, 3).alias("p95_ms"))
    m = medians(rows, keys, rss, "mid").select(F.struct(*keys).alias("k2"), F.round(F.col("mid") / 1024, 2).alias("median_rss_mb"))
    out = t.join(m, F.col("k").eqNullSafe(F.col("k2")))
    if sums:
        s = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).select(F.struct(*keys).alias("k3"), *sums)
        out = out.join(s, F.col("k").eqNullSafe(F.col("k3")))
    return out.select("k.*", "n", "median_ms", "p95_ms", "median_rss_mb", *sums)


def campaign_medians(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, samples, median_<value>): whole medians (rounded down) of every value by regime and profile."""
    out = None
    for v in values:
        m = medians(rows, keys, v, "mid").select(F.struct(*keys).alias(f"k_{v}"), F.col("n").alias(f"n_{v}"), F.floor("mid").alias(f"median_{v}"))
        out = m if out is None else out.join(m, F.col(f"k_{values[0]}").eqNullSafe(F.col(f"k_{v}")))
    return out.select(f"k_{values[0]}.*", F.col(f"n_{values[0]}").alias("samples"), *[f"median_{v}" for v in values])


def material(intervals: DataFrame, group: list[str], band: float = 1.10) -> DataFrame:
    """(group, wins, regressions) of intervals (geomean, low, high): over the band with the whole interval on that side of 1."""
    win = (F.col("geomean") >= band) & (F.col("low") > 1)
    loss = (F.col("geomean") <= 1 / band) & (F.col("high") < 1)
    return intervals.groupBy(*group).agg(F.count_if(win).alias("wins"), F.count_if(loss).alias("regressions"))


def stage_ratios(rows: DataFrame, cell: list[str], kind: str, value: str, kinds: list[str]) -> DataFrame:
    """(cell, <a>_over_<b> of neighbouring kinds, fastest): what each stage of a ladder of profiles gains; null over zero."""
    wide = paired(rows, cell, kind, value, kinds)
    steps = [F.round(ratio(F.col(a), F.col(b)), 9).alias(f"{a}_over_{b}") for a, b in zip(kinds, kinds[1:])]
    fastest = F.array_min(F.array(*[F.struct(F.col(k).alias("x"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(kinds)]))["k"]
    return wide.select(*cell, *steps, fastest.alias("fastest"))


def valid_rows(rows: DataFrame, numbers: list[str], exit_col: str = "exit_code") -> DataFrame:
    """Text rows of runs that ended well, whose `numbers` are whole; those columns become longs."""
    x = rows.where(F.col(exit_col) == "0")
    for c in numbers:
        x = x.withColumn(c, F.when(F.col(c).rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(c).try_cast("long")))
    return x.where(" and ".join(f"`{c}` is not null" for c in numbers))


def repeated_traces(rows: DataFrame, identity: list[str], sha: str) -> DataFrame:
    """(sha, n) of logs that differently named configurations share: each identity must have its own."""
    return rows.select(F.struct(*identity).alias("_i"), sha).distinct().groupBy(sha).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def phases(tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of several campaigns under one another, by column name, with the phase's name; missing columns are null."""
    out = None
    for name, t in tables.items():
        t = t.withColumn("phase", F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def paired(rows: DataFrame, cell: list[str], kind: str, value: str, kinds: list[str]) -> DataFrame:
    """One row a cell with a column for each kind; cells that lack a kind are dropped."""
    return rows.groupBy(*cell).pivot(kind, kinds).agg(F.min(value)).dropna(subset=kinds)


def paired_speedups(pairs: DataFrame, group: list[str], base: str, subject: str) -> DataFrame:
    m = medians(pairs.withColumn("_x", ratio(F.col(base), F.col(subject))), group, "_x", "mid")
    return m.select(*group, F.col("n").alias("n_pairs"), F.round("mid", 9).alias("speedup")).withColumn("class", phase_class(F.col("speedup")))


def geomean_interval(rows: DataFrame, group: list[str], seed: str, speedup: str) -> DataFrame:
    """Geometric mean of speedups with a 95 % interval over seeds: logs are averaged per seed first."""
    per = rows.groupBy(*group, seed).agg(F.avg(F.ln(speedup)).alias("_m"))
    t = F.when(F.count(F.lit(1)) == 3, T_THREE).otherwise(Z)
    half = F.coalesce(t * F.stddev_samp("_m") / F.sqrt(F.count(F.lit(1))), F.lit(0.0))
    s = per.groupBy(*group).agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("_m").alias("_a"), half.alias("_h"))
    r = lambda x: F.round(F.exp(x), 6)
    return s.select(*group, "n_seeds", r(F.col("_a")).alias("geomean"), r(F.col("_a") - F.col("_h")).alias("low"), r(F.col("_a") + F.col("_h")).alias("high"))


def win_tie_loss(rows: DataFrame, group: list[str], speedup: str, band: float = 0.01) -> DataFrame:
    x = F.col(speedup)
    return rows.groupBy(*group).agg(F.count_if(x > 1 + band).alias("wins"), F.count_if(x.between(1 / (1 + band), 1 + band)).alias("ties"), F.count_if(x < 1 / (1 + band)).alias("losses"))


def fastest(rows: DataFrame, group: list[str], kind: str, value: str) -> DataFrame:
    """The kind with the least value in each group (ties by name), and how many are within one in a hundred of it."""
    m = rows.groupBy(*group).agg(F.min_by(kind, F.struct(value, kind)).alias("fastest"), F.min(value).alias("_least"))
    g = [F.col(c).alias("_g" + c) for c in group]
    j = rows.join(m.select(*g, "fastest", "_least"), [F.col(c) == F.col("_g" + c) for c in group])
    return j.groupBy(*group, "fastest").agg(F.count_if(F.col(value) <= F.ceil(F.col("_least") * 1.01)).alias("near"))


def decision(rows: DataFrame, speedup: str, win: float = 1.10) -> DataFrame:
    """One row: GO with a material win somewhere and no material loss, NO-GO with no win, else REFRAME."""
    x = F.col(speedup)
    a = rows.agg(F.count_if(x >= win).alias("wins"), F.count_if(x <= 1 / win).alias("losses"))
    return a.withColumn("decision", F.when((F.col("wins") > 0) & (F.col("losses") == 0), "GO").when(F.col("wins") > 0, "REFRAME").otherwise("NO-GO"))


def reconcile(rows: DataFrame, parts: list[str], total: str) -> DataFrame:
    """Rows whose parts don't sum to their total."""
    s = F.lit(0)
    for p in parts:
        s = s + F.coalesce(F.col(p), F.lit(0))
    return rows.where(~(s.eqNullSafe(F.col(total))))


def conflicting_cells(rows: DataFrame, cell: list[str], identity: list[str]) -> DataFrame:
    """Cells whose rows disagree about what was measured."""
    return rows.groupBy(*cell).agg(F.count_distinct(F.struct(*identity)).alias("identities")).where("identities > 1")


def spatial_bins(coords: DataFrame, side: int = 32) -> DataFrame:
    """(v, bx, by) of points (v, x, y) in a side x side grid over their bounding box."""
    box = coords.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda c: F.least(F.lit(side - 1), F.floor((F.col(c) - F.col(c + "0")) * side / (F.col(c + "1") - F.col(c + "0") + 1))).cast("long")
    return coords.crossJoin(F.broadcast(box)).select("v", at("x").alias("bx"), at("y").alias("by"))


def next_filled(bins: DataFrame, starts: DataFrame, side: int = 32, dense: bool = False) -> DataFrame:
    """(start, cell): the first cell (by * side + bx) with a point at or after each start, going round; no points: no rows.
    `dense`: only cells with more points than the mean of all cells count."""
    full = bins.groupBy((F.col("by") * side + F.col("bx")).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    if dense:
        full = full.crossJoin(F.broadcast(bins.agg(F.count(F.lit(1)).alias("all")))).where(F.col("n") * side * side > F.col("all"))
    ring = F.array_sort(F.collect_list("cell"))  # side * side cells at most
    cells = full.agg(ring.alias("cells")).where("size(cells) > 0")
    return starts.crossJoin(F.broadcast(cells)).select("start", F.coalesce(F.try_element_at(F.filter("cells", lambda c: c >= F.col("start")), F.lit(1)), F.element_at("cells", 1)).alias("cell"))
