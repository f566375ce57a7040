"""Top-k search, conversation repair and lexical ranking against plain versions, with the awkward cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from pathloom.llm import lexical, queries as q, structure, topk

from . import brute
from .test_contracts import _documents, _vectors

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=["made", "empty", "sf0.001"])
def tables(request, spark, tmp_path_factory):
    if request.param == "sf0.001":
        return SF
    top, some = str(tmp_path_factory.mktemp(request.param)), request.param == "made"
    put = lambda name, rows, schema: spark.createDataFrame(rows if some else [], schema).repartition(3).write.parquet(f"{top}/{name}.parquet")
    # extra columns have names the operators use inside
    put("documents", [(*r, 1, "x") for r in [*_documents(), (None, "One two three four", "en", None, 1), (1001, "one TWO three four", None, "s", 2)]], "doc_id long, text string, lang string, source string, n_chars long, term long, score string")
    put("benchmark", [(0, "One two three. Four four, x"), (1, None), (2, ""), (3, "na na na"), (4, "nowhere"), (None, "a b é"), (0, "two"), (5, " ".join("abcdefghij")), (6, "One two three. Four four, x")], "item_id long, text string")
    put("embeddings", [(i, v, l, "x") for i, v, l in _vectors() if i not in (300,)] + [(300, [1.5e5] * 16, 1, "y"), (350, [0.0] * 16, 0, "y"), (-50, _vectors()[0][1], None, "y"), (None, _vectors()[0][1], 0, "y")], "vec_id long, embedding array<double>, label int, x string")
    r = random.Random(3)
    say = lambda: r.choice(["Yes.", "No!", "is it", "Well?\n", " \t", "", None, "x" * r.randint(1, 300) + r.choice([".", ""])])
    conv = [(c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Ü"]), say(), 1) for c in [*range(60), None] for t in range(r.randint(1, 9))]
    conv += [(100, t, ["user", "assistant"][t % 2], f"turn {t}.", 1) for t in range(700)] + [(101, 5, "user", "same.", 1)] * 12 + [(102, None, None, None, 1)] * 3
    put("conversations", conv, "conv_id long, turn long, role string, text string, symbol int")
    return top


def test_op11(spark, tables):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()]
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in q.queries()["op11_topk"](spark, tables).collect()}
    assert got == brute.top_k(rows)


def test_op12(spark, tables):
    rows = [tuple(r)[:4] for r in spark.read.parquet(f"{tables}/conversations.parquet").collect()]
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in q.queries()["op12_structure"](spark, tables).collect()}
    want = brute.structure(rows, brute.damaged(rows))
    assert {k: (got[k], w) for k, w in want.items() if got.get(k) != w} == {} and len(got) == len(want)


def test_op13(spark, tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    got = sorted((tuple(r) for r in q.queries()["op13_lexical"](spark, tables).collect()), key=str)
    assert got == sorted(((i, *x) for i, found in brute.lexical(docs, items) for x in found), key=str)


def test_small_blocks_lose_nothing(spark):
    r = random.Random(9)
    rows = [(i, [r.choice([-1, 1]) * r.random() ** 3 for _ in range(r.choice([3, 12]))]) for i in range(400)] + [(i, [0.25] * 12) for i in range(1000, 1060)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute.top_k(rows, 7, 10)
    for kind in ({"block_rows": 40, "query_rows": 9, "sample_rows": 0}, {"block_rows": 5, "query_rows": 100, "sample_rows": 500}):
        got = {(x.query_id, x.rank): (x.vec_id, x.score) for x in topk.top_k(v, 7, 10, **kind).collect()}
        assert got == want
    again = spark.createDataFrame([(0, [1.0, 0.0]), (0, [2.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(again).collect())) == [(0, 1, 3, 65536), (0, 1, 3, 131072)]


def test_reading_stops_before_the_last_segments():
    r = np.random.default_rng(1)
    x = np.floor(256 * r.standard_normal((3000, 64)) / 8).astype(np.int64)
    x[:40] = x[0] + r.integers(-3, 4, (40, 64))
    block, ids = topk.Block(np.arange(3000), x, *topk.segments(x)), np.arange(3000)
    i, score, found, read = block.best(x[:30], ids[:30], 5, np.full(30, topk.LOWEST))
    assert read < len(topk.LEVELS)
    for n in range(30):
        full = x @ x[n]
        full[n] = -(1 << 60)
        order = np.lexsort((ids, -full))[:5]
        assert found[i == n].tolist() == order.tolist() and score[i == n].tolist() == full[order].tolist()


rows_of_faults = st.lists(st.integers(0, 11), max_size=9)


@given(rows_of_faults, st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_traces_cost_what_the_table_says(symbols, chunk):
    """Chunks chained from the left give the cheapest edits, least by letters, of the whole."""
    a, role = structure.automaton(), ["system", "user", "assistant", "tool"]
    at, cost, behind = a.end, 0, [a.end]
    for s in reversed(symbols):
        at, off, _ = a.read(at, s)
        cost += off
        behind.append(at)
    behind.reverse()
    state, codes = 0, []
    for i in range(0, len(symbols), chunk):
        part = symbols[i : i + chunk]
        got, state = structure.trace(bytes(part), a.vectors[behind[i + len(part)]], state)
        codes += got
    audit = ("".join(codes) + (a.tail(state) if symbols else "")).translate(structure.EDIT)
    texts = [{0: f"text {i}.", 1: f"text {i}", 2: " "}[s % 3] for i, s in enumerate(symbols)]
    want = brute.structure([(1,)], [(1, i, role[s // 3], texts[i]) for i, s in enumerate(symbols)])[1]
    assert (cost + a.vectors[at][0], audit) == (want[5], want[6])


def test_conversations_in_small_chunks(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b", "", f"long {t}!", "same."])) for c in range(12) for t in range(r.randint(0, 40))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = brute.structure(rows, rows)
    for chunk in (1, 5, 8192):
        got = {x.conv_id: tuple(x)[1:] for x in structure.audited(df, df, chunk=chunk).collect()}
        assert got == want
    summary, edited = structure.repair(df)
    kept = {c: [] for c, *_ in rows}
    for x in sorted(edited.collect(), key=lambda x: (x.conv_id, x.place)):
        kept[x.conv_id] += [t.role[0] for t in x.turns]
        assert (x.edits[-1] == "D") == (not x.turns) or "I" in x.edits
    assert all(brute.re.fullmatch("(s?(ua)+)?", "".join(k)) for k in kept.values())


def test_items_in_many_passes_and_small_blocks(spark):
    docs = [(r[0], r[1]) for r in _documents()] + [(i, f"w{i % 7} w{i % 5} common") for i in range(2000, 2100)]
    items = [(i, f"w{i % 9} common w{i % 5} a b token") for i in range(12)]
    d, t = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *x) for i, found in brute.lexical(docs, items) for x in found)
    assert sorted(map(tuple, lexical.rank_documents(d, t, item_bytes=60, block_docs=16).collect())) == want
    assert lexical.term_counts("Ab1é-xÉ y_Z".encode(), piece=2) == {"ab1é".encode(): 1, "xÉ".encode(): 1, b"y": 1, b"z": 1}
