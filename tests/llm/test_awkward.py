"""Null, repeated and clashing ids and long texts for the text operators, and licences against a plain search of every place."""

import random
from collections import Counter

import pytest

from pathloom.llm import licenses, queries as q

from . import brute


def test_labels_and_scores_equal_a_search_of_every_place(spark):
    r, docs = random.Random(3), []
    word = lambda: f"w{r.randrange(500)}"
    pad = lambda n: [word() for _ in range(n)]
    for name, (text, _) in sorted(licenses.TEMPLATES.items()):
        t = text.split()
        edited = list(t)
        for _ in range(3):
            edited.insert(r.randrange(len(edited)), word())
        short = [w for i, w in enumerate(t) if i % 9 != 4]
        docs += [pad(9) + t + pad(5), pad(3) + edited + pad(4), pad(6) + short, pad(2) + t[: len(t) // 2] + pad(20)]
        mixed = list(t)
        r.shuffle(mixed)
        docs.append(mixed)
    docs = r.sample(docs, 24) + [licenses.TEMPLATES["mit"][0].split() + pad(3) + licenses.TEMPLATES["isc"][0].split(), pad(200), []]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {x.doc_id: x for x in licenses.scan_licenses(df).collect()}
    for i, d in enumerate(docs):
        want = brute.license_labels([w.encode() for w in d], licenses.TEMPLATES)
        base = set(got[i].base_labels.split(",")) - {""}
        assert set(got[i].labels.split(",")) - {""} == set(want) | base, " ".join(d)
        assert got[i].score == pytest.approx(max([1.0 if base else 0.0, *want.values()])), " ".join(d)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Null ids, ids with equal and with different texts, and texts of 30,000 words."""
    r = random.Random(8)
    text = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    long, shared = text(30_000), text(80)
    rows = [(None, shared, "en", "a"), (None, shared, "en", "a"), (None, None, None, None), (7, shared, "en", "a"), (7, shared, "en", "a"), (7, text(70), "de", "b"), (9, shared + " token=abcdef123", None, "b"), (9, None, "en", None), (11, long, "en", "a"), (12, long + " end", "en", "a"), (13, "x" * 200_000, "en", "a"), (14, "", "en", "a")]
    top = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame([(*x, 0, "k") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, uid string").repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(7, 1, 0), (7, 1, 0), (9, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top, rows


@pytest.mark.parametrize("name", ["op2_secrets", "op3_quality", "op5_licenses", "op7_mixing", "op8_simhash", "op10_substrings"])
def test_rows_return_once_each(spark, tables, name):
    top, rows = tables
    got = q.queries()[name](spark, top).collect()
    assert Counter(x.doc_id for x in got) == Counter(x[0] for x in rows)
    if name == "op2_secrets":
        assert sorted(x.n_assign for x in got) == [0] * 11 + [1]
    if name == "op3_quality":
        assert Counter((x.doc_id, x.n_words) for x in got) == Counter((i, brute.quality(t)[0]) for i, t, *_ in rows)
    if name == "op5_licenses":
        assert all(x.labels == "" and x.score == 0 for x in got) and max(x.n_words for x in got) == 30_001
    if name == "op8_simhash":
        by = {x.doc_id: x.component_id for x in got}
        assert by[7] == 7 and by[12] == by[11] and by[None] is None
    if name == "op10_substrings":
        lost = Counter((x.doc_id, x.n_removed) for x in got)
        assert lost[9, 80] == 1 and lost[12, 30_000] == 1 and lost[None, 0] == 3 and lost[7, 0] == 3


def test_pieces_of_repeated_and_long_documents(spark, tables):
    from tokenizers import Tokenizer

    top, rows = tables
    tok = Tokenizer.from_file(q.tokenizer_path())
    got = q.queries()["op9_packing"](spark, top).collect()
    want = Counter()
    for i, t, *_ in rows:
        want.update((i, *p) for p in brute.pieces(t, tok))
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
