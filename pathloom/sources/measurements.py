"""Measurement rows, registries and reports as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathloom.operators import stats

# The column names of measurement rows of versions 1 and 2.
FIELDS_1 = [
    "baseline", "family", "seed", "trace_sha256", "queries", "updates", "increase_count", "decrease_count", "update_every", "hot_sources", "epoch", "cap",
    "persistent_state_budget_bytes", "accounted_algorithm_state_bytes", "peak_accounted_algorithm_state_bytes", "accounting_version", "algorithm_ns", "cold_queries",
    "resident_queries", "promotions", "evictions", "rebuilds", "repair_aborts",
]
FIELDS_2 = [
    "schema_version", "baseline", "family", "seed", "trace_sha256", "queries", "updates", "increase_count", "decrease_count", "update_every", "hot_sources", "epoch",
    "cap", "persistent_state_budget_bytes", "accounted_algorithm_state_bytes", "peak_accounted_algorithm_state_bytes", "accounting_version", "oracle_ns", "algorithm_ns",
    "query_ns", "update_ns", "operation_p50_ns", "operation_p95_ns", "query_p50_ns", "query_p95_ns", "update_p50_ns", "update_p95_ns", "cold_queries",
    "resident_queries", "promotions", "evictions", "rebuilds", "repair_aborts", "cooldown_blocks", "admission_rejections", "filtered_updates", "decrease_repairs",
    "increase_repairs", "memory_budget_rejections", "memory_metadata_prunes", "b4_query_time_ns", "b4_update_time_ns", "b4_cold_query_ns", "b4_resident_query_ns",
    "b4_query_policy_ns", "b4_promotion_ns", "b4_eviction_ns", "b4_graph_update_ns", "b4_decrease_repair_ns", "b4_increase_repair_ns", "b4_rebuild_ns",
    "b4_controller_ns", "b4_update_policy_ns",
]
# The other column orders: of engine matrices, controller runs and pilot profiles.
MATRIX = [
    "baseline", "rep", "seed", "workload", "policy", "trace_sha256", "operations", "query_count", "update_count", "increase_count", "decrease_count", "ns",
    "cold_queries", "resident_queries", "promotions", "rebuilds", "filtered_updates", "decrease_repairs", "increase_repairs", "repair_aborts",
]
CONTROLLER = [
    "regime", "policy", "seed", "trace_sha256", "query_count", "update_count", "increase_count", "decrease_count", "source", "ns", "rebuilds", "increase_repairs",
    "repair_aborts", "filtered_updates",
]
PILOT = [
    "profile", "trace_sha256", "query_count", "update_count", "increase_count", "decrease_count", "budget_bytes", "algorithm_ns", "query_ns", "update_ns",
    "operation_p50_ns", "operation_p95_ns", "query_p50_ns", "query_p95_ns", "update_p50_ns", "update_p95_ns", "current_bytes", "peak_bytes", "cold_queries",
    "resident_queries", "promotions", "evictions", "rebuilds", "repair_aborts", "cooldown_blocks", "admission_rejections", "filtered_updates", "decrease_repairs",
    "increase_repairs", "memory_budget_rejections", "memory_metadata_prunes",
]
# Text columns, the parts of query and update times, what makes a cell, and the states of a comparator.
TEXT = {"baseline", "family", "trace_sha256"}
QUERY_PARTS = [
    "b4_cold_query_ns", "b4_resident_query_ns", "b4_query_policy_ns", "b4_promotion_ns", "b4_eviction_ns",
]
UPDATE_PARTS = [
    "b4_graph_update_ns", "b4_decrease_repair_ns", "b4_increase_repair_ns", "b4_rebuild_ns", "b4_controller_ns", "b4_update_policy_ns",
]
CELL = [
    "family", "seed", "trace_sha256", "queries", "updates", "increase_count", "decrease_count", "update_every", "hot_sources", "epoch", "persistent_state_budget_bytes",
    "accounting_version",
]
STATUSES = [
    "DIRECT", "PENDING", "CONTEXT", "INELIGIBLE",
]


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Headerless rows of either version with the columns of version 2 (null where version 1 has none); others raise."""
    p = F.split("value", ",")
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", p.alias("p"), F.size(p).alias("n"))
    two = (F.col("n") == len(FIELDS_2)) & (F.col("p")[0] == "2")
    one = F.col("n") == len(FIELDS_1)
    bad = lines.where(~two & ~one).first()
    if bad is not None:
        raise ValueError(f"a row of {bad['n']} fields")

    def field(i: int, name: str) -> Column:
        x = F.when(two, F.try_element_at("p", F.lit(i + 1)))
        if name in FIELDS_1:
            x = x.when(one, F.try_element_at("p", F.lit(FIELDS_1.index(name) + 1)))
        elif name == "schema_version":
            x = x.when(one, F.lit("1"))
        return (x if name in TEXT else x.cast("long")).alias(name)

    return lines.select(*[field(i, n) for i, n in enumerate(FIELDS_2)])


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows of version 2 as CSV without a header."""
    rows.select(*FIELDS_2).write.csv(path)


def write_plain(rows: DataFrame, columns: list[str], path: str) -> None:
    """Rows as CSV without a header, in the order of MATRIX, CONTROLLER or PILOT; a missing column raises."""
    rows.select(*columns).write.csv(path)


def read_plain(spark: SparkSession, columns: list[str], path: str) -> DataFrame:
    """What write_plain() wrote, as text."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path)


def write_headed(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header in each file."""
    rows.write.option("header", True).csv(path)


def read_headed(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """A CSV with a header, as text; raises if there is no header or `needed` columns are missing."""
    rows = spark.read.option("header", True).csv(path)
    missing = sorted(set(needed) - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return rows


def write_report(rows: DataFrame, path: str, kind: str) -> None:
    """A report table of bounded size as one file in a folder: csv (with header), json (a line a row) or markdown."""
    one = rows.coalesce(1)
    if kind == "csv":
        write_headed(one, path)
    elif kind == "json":
        one.write.json(path)
    elif kind == "markdown":
        lines = rows.sparkSession.createDataFrame([(markdown(rows, 1 << 20),)], "value string")
        lines.coalesce(1).write.text(path)
    else:
        raise ValueError(kind)


def unreconciled(rows: DataFrame, adaptive: list[str]) -> DataFrame:
    """Rows of version 2 whose times don't add up; the parts count for the named adaptive engines only."""
    two = rows.where("schema_version = 2")
    mine = two.where(F.col("baseline").isin(adaptive))
    out = stats.reconcile(two, ["query_ns", "update_ns"], "algorithm_ns").union(stats.reconcile(mine, QUERY_PARTS, "b4_query_time_ns")).union(stats.reconcile(mine, UPDATE_PARTS, "b4_update_time_ns"))
    return out.distinct()


def ablation_faults(rows: DataFrame, profiles: list[str], plain: list[str], cold: str, rebuild: str) -> DataFrame:
    """(fault) of a set of profile rows: one matched cell, each profile once, and what a profile can't have done."""
    b = F.col("baseline")
    zero = lambda names: sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0)) == 0
    checks = {
        "cells": F.count_distinct(F.struct(*CELL)) == 1,
        "profiles": (F.count(F.lit(1)) == len(profiles)) & (F.size(F.array_except(F.array(*map(F.lit, profiles)), F.collect_set("baseline"))) == 0),
        "cold state": F.every((b != cold) | zero(["resident_queries", "promotions", "evictions", "accounted_algorithm_state_bytes", "peak_accounted_algorithm_state_bytes"])),
        "cooldown or hysteresis": F.every(~b.isin(plain) | zero(["cooldown_blocks", "admission_rejections"])),
        "repairs while rebuilding": F.every((b != rebuild) | zero(["filtered_updates", "decrease_repairs", "increase_repairs", "repair_aborts"])),
    }
    one = rows.agg(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]).alias("f"))
    return one.select(F.explode("f").alias("fault")).where("fault is not null")


def budget_faults(rows: DataFrame) -> DataFrame:
    """Rows whose peak of accounted bytes is over a budget that is set."""
    return rows.where("persistent_state_budget_bytes > 0 and peak_accounted_algorithm_state_bytes > persistent_state_budget_bytes")


def read_registry(spark: SparkSession, path: str, entries: str) -> DataFrame:
    """The entries of a JSON registry, one a row."""
    return spark.read.json(path, multiLine=True).select(F.explode(entries).alias("e")).select("e.*")


def dataset_faults(datasets: DataFrame, classes: int = 5) -> DataFrame:
    """(id, fault) of dataset entries: unique ids and paths, counts, hashes, licences, qualification, provenance by kind,
    and, with a null id, too few topology classes or none that isn't road."""
    has = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    generated = F.col("kind") == "generated"
    fields = datasets.columns
    known = F.coalesce(F.col("generator.tool").isNotNull(), F.lit(False)) if "generator" in fields else F.lit(True)
    source = has(F.col("source.url")) & has(F.col("source.collection")) & has(F.col("source.upstream")) if "source" in fields else F.lit(False)
    rules = {
        "kind": F.col("kind").isin("generated", "external-committed"),
        "vertices": F.col("vertices") > 0,
        "arcs": F.col("arcs") > 0,
        "sha256": F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "license": has(F.col("license.status")) & F.col("license.redistribution_review_required").isNotNull(),
        "third party": F.col("license.external_third_party_data") != generated,
        "qualification": (F.col("qualification.scientific_use") == "qualified") & yes("qualification.hash_verified") & yes("qualification.parser_verified"),
        "provenance": F.when(generated, known).otherwise(source),
    }
    own = datasets.select("id", F.explode(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])).alias("fault")).where("fault is not null")
    twice = lambda c: datasets.groupBy(c).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit(f"repeated {c}").alias("fault"))
    spread = datasets.agg(F.count_distinct("topology_class").alias("n"), F.count_if(F.col("topology_class") != "road").alias("other")).where((F.col("n") < classes) | (F.col("other") == 0)).select(F.lit(None).cast("string").alias("id"), F.lit("topology classes").alias("fault"))
    ids = datasets.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("fault"))
    return own.union(ids).union(twice("local_path")).union(spread)


def comparator_faults(comparators: DataFrame, gates: list[str]) -> DataFrame:
    """(id, fault): known status, all gates and no others, DIRECT only where every gate passes, others with a blocker."""
    names = comparators.schema["gates"].dataType.names
    values = F.array(*[F.col(f"gates.`{n}`") for n in names])
    whole = F.lit(set(names) == set(gates)) & F.forall(values, lambda x: x.isNotNull() & (F.trim(x) != ""))
    passed = F.forall(values, lambda x: x == "PASS")
    blocked = F.size(F.coalesce(F.col("blockers"), F.array().cast("array<string>"))) > 0 if "blockers" in comparators.columns else F.lit(False)
    rules = {"status": F.col("status").isin(STATUSES), "gates": whole, "direct": (F.col("status") != "DIRECT") | passed, "blockers": (F.col("status") == "DIRECT") | blocked}
    own = comparators.select("id", F.explode(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()])).alias("fault")).where("fault is not null")
    return own.union(comparators.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated id").alias("fault")))


def cells(spark: SparkSession, **axes: list) -> DataFrame:
    """One row for each combination of literal axis values: the configurations of a campaign."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.crossJoin(spark.createDataFrame([(v,) for v in values], [name]))
    return out


def rotated(rows: DataFrame, kinds: list[str], repeat: str) -> DataFrame:
    """Each repeat's rows with every kind and its turn, the first kind moving on by one from repeat to repeat."""
    k = F.posexplode(F.array(*map(F.lit, kinds))).alias("_i", "engine")
    x = rows.select("*", k)
    return x.withColumn("turn", F.pmod(F.col("_i") - F.col(repeat), F.lit(len(kinds)))).drop("_i")


def markdown(rows: DataFrame, limit: int = 16) -> str:
    """The first rows of a report table as text."""
    got = rows.limit(limit).collect()
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns) + "\n"
    return head + "".join("| " + " | ".join("NA" if v is None else str(v) for v in r) + " |\n" for r in got)
