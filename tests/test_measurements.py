"""Measurement rows, registries and statistics on literal rows."""

import pytest
from pyspark.sql import functions as F

from pathloom.functions import scalar as fn
from pathloom.operators import stats
from pathloom.sources import measurements as ms

PROFILES = ["COLD", "FREQ-LRU-REBUILD", "FULL"]


def _row(name, **more):
    x = dict.fromkeys(ms.FIELDS_2, 0) | {"schema_version": 2, "baseline": name, "family": "f", "trace_sha256": "ab", "algorithm_ns": 5, "query_ns": 3, "update_ns": 2, "b4_query_time_ns": 3, "b4_cold_query_ns": 3, "b4_update_time_ns": 2, "b4_rebuild_ns": 2} | more
    return ",".join(str(x[f]) for f in ms.FIELDS_2)


def test_rows_of_both_versions(spark, tmp_path):
    one = ",".join(["B0", "f", "7", "ab", *["1"] * 19])
    (tmp_path / "r.csv").write_text("\n".join([one, _row("FULL"), _row("FULL", query_ns=4), _row("COLD", b4_rebuild_ns=1)]) + "\n")
    rows = ms.read_rows(spark, str(tmp_path / "r.csv"))
    assert (len(ms.FIELDS_1), len(ms.FIELDS_2)) == (23, 53)
    got = rows.select("schema_version", "baseline", "seed", "repair_aborts", "oracle_ns").collect()
    assert tuple(got[0]) == (1, "B0", 7, 1, None) and got[1]["oracle_ns"] == 0
    assert sorted((r.baseline, r.query_ns, r.b4_rebuild_ns) for r in ms.unreconciled(rows, ["FULL"]).collect()) == [("FULL", 4, 2)]
    ms.write_rows(rows.where("schema_version = 2"), str(tmp_path / "w"))
    assert ms.read_rows(spark, str(tmp_path / "w")).count() == 3
    (tmp_path / "r.csv").write_text("1,2,3\n")
    with pytest.raises(ValueError):
        ms.read_rows(spark, str(tmp_path / "r.csv"))


def test_ablation_faults(spark, tmp_path):
    def faults(*lines):
        (tmp_path / "a.csv").write_text("\n".join(lines))
        return {r.fault for r in ms.ablation_faults(ms.read_rows(spark, str(tmp_path / "a.csv")), PROFILES, PROFILES[:2], "COLD", "FREQ-LRU-REBUILD").collect()}

    good = [_row(p) for p in PROFILES]
    assert faults(*good) == set()
    assert faults(*good[:2]) == {"profiles"}
    assert faults(_row("COLD", promotions=1), _row("FREQ-LRU-REBUILD", increase_repairs=2, cooldown_blocks=1), _row("FULL", seed=3)) == {"cells", "cold state", "cooldown or hysteresis", "repairs while rebuilding"}


def test_registries(spark, tmp_path):
    import json

    d = {"id": "g", "kind": "generated", "vertices": 4, "arcs": 9, "sha256": "a" * 64, "local_path": "p", "topology_class": "grid", "license": {"status": "ok", "redistribution_review_required": False, "external_third_party_data": False}, "qualification": {"scientific_use": "qualified", "hash_verified": True, "parser_verified": True}, "generator": {"tool": "t"}}
    (tmp_path / "d.json").write_text(json.dumps({"datasets": [d, d | {"id": "h", "local_path": "q", "arcs": 0, "sha256": "A"}, d | {"id": "g", "topology_class": "road"}]}))
    got = {tuple(r) for r in ms.dataset_faults(ms.read_registry(spark, str(tmp_path / "d.json"), "datasets"), 2).collect()}
    assert got == {("h", "arcs"), ("h", "sha256"), ("g", "repeated id"), ("g", "repeated local_path")}
    c = {"id": "a", "status": "DIRECT", "gates": {"x": "PASS", "y": "PASS"}, "blockers": []}
    (tmp_path / "c.json").write_text(json.dumps({"comparators": [c, c | {"id": "b", "gates": {"x": "PASS", "y": "MISSING"}}, c | {"id": "c", "status": "PENDING"}, c | {"id": "d", "status": "ODD", "blockers": ["z"]}]}))
    got = {tuple(r) for r in ms.comparator_faults(ms.read_registry(spark, str(tmp_path / "c.json"), "comparators"), ["x", "y"]).collect()}
    assert got == {("b", "direct"), ("c", "blockers"), ("d", "status")}


def test_cells_and_turns(spark):
    c = ms.rotated(ms.cells(spark, family=["a", "b"], rep=[0, 1, 2]), ["x", "y", "z"], "rep")
    assert c.count() == 18
    assert sorted((r.rep, r.turn, r.engine) for r in c.where("family = 'a'").collect()) == [(0, 0, "x"), (0, 1, "y"), (0, 2, "z"), (1, 0, "y"), (1, 1, "z"), (1, 2, "x"), (2, 0, "z"), (2, 1, "x"), (2, 2, "y")]
    assert ms.markdown(c.select("engine").where("rep = 0 and turn = 0 and family = 'a'")) == "| engine |\n|---|\n| x |\n"


def test_percentiles_and_scalars(spark):
    d = spark.createDataFrame([(g, float(x)) for g in ("a", None) for x in (5, 1, 4, 2, 3, 6)] + [("b", 7.0), ("c", None), ("b", None)], "g string, x double")
    for buckets in (1, 3, 1024):
        got = stats.values_at(d, ["g"], "x", {"a": stats.nearest_rank(0.5), "b": stats.nearest_rank(0.95), "c": stats.rounded_index(0.5)}, buckets).collect()
        assert {r.g: (r.n, r.a, r.b, r.c) for r in got} == {"a": (6, 3.0, 6.0, 3.0), None: (6, 3.0, 6.0, 3.0), "b": (1, 7.0, 7.0, 7.0)}
    assert {r.g: r.m for r in stats.medians(d, ["g"], "x", "m").collect()} == {"a": 3.5, None: 3.5, "b": 7.0}
    assert fn.nearest_rank([5, 1, 4, 2, 3, 6], 0.5) == 3
    s = spark.range(1).select(fn.ewma(F.array(F.lit(1), F.lit(2), F.lit(3)), 0.25), fn.sat_add(F.lit(fn.INF - 1), F.lit(1)), fn.sat_add(F.lit(fn.INF - 2), F.lit(1)), fn.clamp_weight(F.lit("18446744073709551615")), fn.magnitude_of(F.lit(-31)), fn.phase_class(F.lit(1.1))).first()
    assert tuple(s) == (1.6875, fn.INF, fn.INF - 1, fn.INF, "medium", "superior")
    import numpy as np

    assert int(fn.splitmix64(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF


def test_reports_and_other_layouts(spark, tmp_path):
    d = spark.createDataFrame([("a", 1), ("b", None)], "name string, n long")
    for kind in ("csv", "json", "markdown"):
        ms.write_report(d, str(tmp_path / kind), kind)
    text = lambda kind: "".join(p.read_text() for p in sorted((tmp_path / kind).glob("part-*")))
    assert text("csv").splitlines()[0] == "name,n" and '{"name":"a","n":1}' in text("json") and "| b | NA |" in text("markdown")
    assert ms.read_headed(spark, str(tmp_path / "csv"), ["n"]).count() == 2
    with pytest.raises(ValueError):
        ms.read_headed(spark, str(tmp_path / "csv"), ["n", "ns"])
    with pytest.raises(ValueError):
        ms.write_report(d, str(tmp_path / "x"), "pdf")
    assert (len(ms.MATRIX), len(ms.CONTROLLER), len(ms.PILOT)) == (20, 14, 31)


def test_plain_answers_must_be_whole(spark, tmp_path):
    from pathloom.sources import traces

    a = spark.createDataFrame([(0, 5), (3, 7)], "op_seq long, answer long")
    traces.write_plain_answers(a, "ab", str(tmp_path / "a"))
    assert sorted(map(tuple, traces.read_plain_answers(spark, str(tmp_path / "a"), "ab", 2).collect())) == [(0, 5), (1, 7)]
    for sha, n in (("cd", 2), ("ab", 3), ("ab", 1)):
        with pytest.raises(ValueError):
            traces.read_plain_answers(spark, str(tmp_path / "a"), sha, n)
    part = next((tmp_path / "a").glob("part-*"))
    (tmp_path / "b.txt").write_text(part.read_text() + "9\n")
    with pytest.raises(ValueError):
        traces.read_plain_answers(spark, str(tmp_path / "b.txt"), "ab", 2)


def test_a_described_workload():
    import json

    from pathloom.sources import workloads as wl

    got = json.loads(wl.describe(wl.Workload(10), "ab", "cd", 3, 4, 7, {"query_count": 10, "update_count": 1}))
    assert got["config"]["query_count"] == 10 and got["graph_vertices"] == 3 and len(got["config_sha256"]) == 64


def test_byte_accounts_are_checked(spark):
    d = spark.createDataFrame([(2,), (1 << 60,), (-1,), (None,)], "n long")
    assert [r[0] for r in d.select(fn.accounted(F.col("n"), 44, 8, strict=False)).collect()] == [96, None, None, None]
    assert d.where("n = 2 or n is null").select(fn.accounted(F.col("n"), 44, 8)).collect()[0][0] == 96
    for bad in ("n = -1", "n > 2"):
        with pytest.raises(Exception, match="overflows"):
            d.where(bad).select(fn.accounted(F.col("n"), 44, 8)).collect()
