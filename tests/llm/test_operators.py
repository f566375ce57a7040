"""The operators behind the contracts: guarantees, limits of tiles and chunks, trees, mixing and the pipeline."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pathloom.llm import chat, common, components, embeddings, licenses, mixing, packing, quality, queries as q, secrets, simhash, windows

from . import brute
from .test_contracts import _documents, _vectors


def test_covering_masks_hide_any_three_bits():
    masks, r = simhash.covering_masks(3), random.Random(1)
    assert len(masks) == 15
    for _ in range(3000):
        flips = sum(1 << b for b in r.sample(range(64), r.randint(0, 3)))
        assert any(not m & flips for m in masks)
    assert all(30 <= m.bit_count() <= 36 for m in masks)


def test_small_tiles_lose_no_link(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(5)]
    fps = {b ^ sum(1 << x for x in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(40)}
    rows = [(simhash._signed(f), i) for i, f in enumerate(sorted(fps))]
    links = simhash.simhash_links(spark.createDataFrame(rows, "fp long, rep long"), tile=4)
    got = {x.node: x.component for x in components.connected_components(links).collect()}
    want = brute.components(range(len(rows)), [(i, j) for f, i in rows for g, j in rows if i < j and ((f ^ g) & (1 << 64) - 1).bit_count() <= 3])
    assert {i: got.get(i, i) for _, i in rows} == want
    v = [(i, x, l) for i, x, l in _vectors() if l is not None and x and len(x) == 16 and all(y is not None and math.isfinite(y) for y in x) and any(x)]
    reps = spark.createDataFrame([(i, i, l, list(map(float, x)), 1) for i, x, l in v if i not in (201,)], "uid long, rep long, label int, v array<double>, n long")
    n, edges = embeddings.link_vectors(reps, tile=3)
    want = brute.vectors([x for x in v if x[0] != 201])
    assert {x.rep: x.links for x in n.collect()} == {i: w[0] for i, w in want.items() if w[0]}
    got = {x.node: x.component for x in components.connected_components(edges).collect()}
    assert {i: got.get(i, i) for i in want} == {i: w[1] for i, w in want.items()}


def test_components_of_long_paths_and_stars(spark):
    r = random.Random(7)
    ids = list(range(400))
    r.shuffle(ids)
    links = list(zip(ids[:150], ids[1:150])) + [(ids[200], x) for x in ids[200:300]] + [(3, 3)]
    want = brute.components(ids, links)
    for many in (0, 1 << 22):
        got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(links, "a long, b long"), many=many).collect()}
        assert {i: got.get(i, i) for i in ids} == want


def test_vectors_of_extreme_size(spark):
    base = [random.Random(1).gauss(0, 1) for _ in range(16)]
    rows = [(i, [x * s for x in base], 0) for i, s in enumerate((1.0, 1e200, 1e-200, -1.0, 3e-310))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 2: (3, 0), 3: (0, 3), 4: (3, 0)}


def test_binomial_tail_is_exact():
    for n, k, p in ((10, 0, Fraction(1, 10)), (50, 3, Fraction(1, 20)), (200, 40, Fraction(1, 4)), (5, 5, Fraction(1, 3))):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        assert quality.binomial_tail(k, n, float(p)) == pytest.approx(float(want), rel=1e-9)


def _counted(n_symbols, words=100):
    c = {"n_words": F.lit(words), "word_chars": F.lit(650), "n_symbols": n_symbols, "n_dup_lines": F.lit(0), "n_repeat_words": F.lit(0), "n_lines": F.lit(5)}
    return F.struct(*[x.cast("long").alias(k) for k, x in c.items()])


def test_cutoffs_are_as_sharp_as_the_holdout_allows(spark):
    # of en's 4000 good documents 120 have a symbol score of 0.2: steps that reject them need P(X <= 120) at 160 expected
    rows = [("en", i) for i in range(4000)] + [("de", i) for i in range(30)] + [("fr", i) for i in range(108)] + [("es", i) for i in range(107)]
    made = spark.createDataFrame(rows, "s string, i int").withColumn("_pl_c", _counted(F.when((F.col("s") == "en") & (F.col("i") < 120), 131).otherwise(0)))
    cut = {r.stratum: r.step for r in quality.cutoffs(made, F.col("s")).collect()}
    assert quality.binomial_tail(120, 4000, 0.04) < 0.05 / 4 < quality.binomial_tail(135, 4000, 0.04)
    assert cut == {"en": quality.STEPS - 1, "fr": quality.STEPS - 1, "de": None, "es": None}  # 107 documents refute nothing
    more = made.withColumn("_pl_c", _counted(F.when((F.col("s") == "en") & (F.col("i") < 140), 131).otherwise(0)))
    cut = {r.stratum: r.step for r in quality.cutoffs(more, F.col("s")).collect()}
    assert quality.RULES["symbols"][1][cut["en"]] == 0.25  # the last cutoff above their score
    assert quality.cutoffs(made.limit(0), F.col("s")).collect() == []


def test_each_rule_rejects(spark):
    words = [f"word{i}" for i in range(200)]
    good = [" ".join(words[i % 7 :]) + "\n" + " ".join(words[: i % 5 + 2]) for i in range(120)]
    bad = {"symbols": " ".join(f"{w}##" for w in words), "repeats": " ".join(words + words[:40] * 2), "lines": "\n".join(words[:40] + ["the same"] * 20 + words[60:120]), "word_length": " ".join("x" * 20 + w for w in words)}
    docs = [(i, t, "en") for i, t in enumerate(good)] + [(1000 + i, t, "en") for i, t in enumerate(bad.values())]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(120)] + [(1000, 0)], "doc_id long, quality int")
    assert {r.doc_id for r in quality.keep_good(d, labels).collect()} == set(range(120))
    slim = quality.measured(d)
    got = {r.id: (r._pl_base_failed, r._pl_kept) for r in quality.verdicts(slim, quality.fit(slim, labels), "stratum").collect()}
    assert [got[1000 + i] for i in range(4)] == [(False, False)] * 4
    unlabelled = quality.verdicts(slim, quality.fit(slim, labels.limit(0)), "stratum")
    assert all(r._pl_kept for r in unlabelled.collect())


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=12))
@settings(max_examples=60, deadline=None)
def test_patterns_use_each_piece_once(counts):
    used = {}
    for pattern, times in packing.slack_patterns(counts, 64):
        assert sum(l * n for l, n in pattern) <= 64
        for l, n in pattern:
            used[l] = used.get(l, 0) + n * times
    assert used == counts


_ENC = None


@given(st.text(alphabet=st.sampled_from("ab1 ,.\n'\tñ\xa0é中<|endoftext>²"), max_size=40))
@settings(max_examples=400, deadline=None)
def test_encoder_equals_the_tokenizer(text):
    global _ENC
    _ENC = _ENC or packing.PieceEncoder(q.tokenizer_path(), limit=50)
    assert _ENC.encode(text) == _ENC.whole(text)


@pytest.mark.parametrize("sources", [3, 700, 3000])
def test_mixing_stays_within_a_block_of_its_targets(spark, sources):
    w = {f"s{i}": Fraction(1, 1 + i % 97) if i else Fraction(sources, 3) for i in range(sources)} | {"tiny": Fraction(1, 10**6)}
    n = {s: 7 for s in w} | {"s0": 900, "tiny": 1}
    rows = [(i, s) for i, s in enumerate(s for s in w for _ in range(n[s]))]
    weights = spark.createDataFrame([(s, float(x)) for s, x in w.items()] + [("none", 0.0), ("gone", None)], "source string, weight double")
    d = spark.createDataFrame([*rows, (-1, "none"), (-2, None)], "doc_id long, source string").repartition(8)
    out = mixing.mix(d, weights, block=3, most=6000).collect()
    assert sorted(r.doc_id for r in out) == list(range(-2, len(rows)))
    assert all(r.slot is None for r in out if r.doc_id < 0)
    total, taken, size = sum(w.values()), {}, 1 + max(r.place for r in out)
    for r in out:
        if r.slot is not None:
            assert taken.setdefault(r.slot, (r.source, r.block, r.release, r.deadline)) == (r.source, r.block, r.release, r.deadline)
    assert len(taken) == sum(-(-x // size) for x in n.values()) <= 6000 + len(w)
    done = dict.fromkeys(w, 0)
    for t in sorted(taken):
        s, block, release, deadline = taken[t]
        due = w[s] / total
        assert block == done[s] and release <= t < deadline
        assert abs(block - due * t) < 1.001 and abs(block + 1 - due * (t + 1)) < 1.001
        done[s] += 1


def test_mixed_rows_are_written_in_order(spark):
    rows = [(i, f"s{i % 3 if i % 2 else 0}", "x" * i) for i in range(700)]
    d = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    place = {r.doc_id: (r.m_slot, r.m_place) for r in mixing.mix(d, prefix="m_", block=8, bucket_rows=40).collect()}
    out = [r.doc_id for r in mixing.mixed_order(d, block=8, bucket_rows=40).collect()]
    assert sorted(out) == list(range(700)) and [place[i] for i in out] == sorted(place.values())
    kept = {r.doc_id: r.o for r in mixing.mixed_order(d, "o", block=8, bucket_rows=40).collect()}
    assert sorted(kept, key=kept.get) == out


def test_reply_trees(spark):
    m = [(1, "a", None, "user", "root", 0.0), (1, "b", "a", "assistant", "poor", 0.1), (1, "c", "a", "assistant", "good", 0.9), (1, "d", "c", "user", "more", None), (1, "e", "b", "user", "x", 0.2)]
    m += [(2, "x", "y", "user", "cycle", 1.0), (2, "y", "x", "user", "cycle", 1.0), (2, "o", "gone", "assistant", "orphan <a> \\#h", 1.0), (2, "o", "gone", "assistant", "orphan <a> \\#h", 1.0), (3, None, None, "user", "no id", 1.0)]
    d = spark.createDataFrame(m, "conv_id long, node string, parent string, role string, text string, s double")
    best = chat.format_trees(d, score="s")
    got = {r.conv_id: r.turns for r in best.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert {k: [(t.role, t.text) for t in v] for k, v in got.items()} == {1: [("user", "root"), ("assistant", "good"), ("user", "more")], 2: [("assistant", "orphan <a> \\#h")]}
    every = chat.format_trees(d, score="s", top_k=None).select("conv_id", "leaf", chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    assert sorted(map(tuple, every.collect())) == [(1, "d", "good"), (1, "e", "poor"), (2, "o", "orphan <a> \\#h")]
    two = {(r.leaf, r.branch_rank) for r in chat.format_trees(d, score="s", top_k=2).where("conv_id = 1").collect()}
    assert two == {("d", 1), ("e", 2)}


def test_escapes_are_reversible(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("\\#<:hlc/ \n") for _ in range(r.randint(0, 30))) for _ in range(500)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t"), True).alias("e"), chat.unescape(chat.escape(F.col("t"), True)).alias("u"), chat.unescape(chat.escape(F.col("t"))).alias("v")).collect()
    assert all(x.u == x.t == x.v and not set("#<:") & set(x.e) for x in out)


def test_entropy_and_redaction(spark):
    r = random.Random(8)
    alpha = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    texts = [f"see \U0001f600 {''.join(r.choice(alpha) for _ in range(n))} and {''.join(r.choice('0123456789ABCDEFabcdef') for _ in range(n))}." for n in (19, 20, 24, 40, 90)]
    texts += ["a1" * 30, "heitheitschheitkeitlich1", "/usr/local/lib/python3/dist-packages/x1", "AAAAAAAAAAAAAAAAAAAAAAAAAAAA1", "token=abcdef123 " + "Zx9" * 3 + "".join(r.sample(alpha, 30)) + "1" * 40]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {x.doc_id: sorted((s.start, s.stop) for s in x.added) for x in d.select("doc_id", secrets.scan(F.col("text"))[1].alias("added")).collect()}
    assert got == {i: sorted(brute.entropy_spans(t, secrets.CLASSES, secrets.ALLOWED)) for i, t in enumerate(texts)}
    assert sum(map(bool, got.values())) >= 4
    for x in secrets.redact_secrets(d).collect():
        t = texts[x.doc_id]
        spans = got[x.doc_id] + [tuple(map(int, s.split(":")[1:])) for s in brute.secrets(t)[1]]
        assert x.text == brute.redact(t, spans) and (x.n_chars == len(x.text) if spans else x.n_chars == 1)


@pytest.mark.parametrize(("width", "hot"), [(64, None), (1 << 16, 1), (64, 2), (1 << 16, 4)])
def test_a_full_sketch_or_hot_anchors_lose_nothing(spark, width, hot):
    docs = [(r[0], r[1]) for r in _documents()]
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in windows.drop_repeated(spark.createDataFrame(docs, "doc_id long, text string"), window=12, width=width, hot=hot).collect())
    assert got == sorted(x[:3] for x in brute.substrings(docs, 12))


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows = [r for r in _documents() if r[1]] + [(9000, "token=abcdef123 " + " ".join(f"w{i}" for i in range(90)), "en", "src1", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [(i, t) for i, t, *_ in rows if not brute.quality(t)[5]]
    kept = brute.without_near_copies(kept)
    clean = {i: brute.redact(t, [tuple(map(int, s.split(":")[1:])) for s in brute.secrets(t)[1]] + brute.entropy_spans(t, secrets.CLASSES, secrets.ALLOWED)) for i, t in kept}
    assert "[SECRET]" in clean[9000]
    tok = Tokenizer.from_file(q.tokenizer_path())
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {i: brute.pieces(t, tok) for i, t in clean.items()}


@pytest.mark.parametrize("some", [False, True])
def test_pipeline_over_awkward_tables(spark, tmp_path, some):
    """Empty tables, null texts and ids, repeated rows, columns with the stages' own names: each stage ends with a defined result."""
    import corpus_pipeline

    said = " ".join(f"w{i}" for i in range(90))
    rows = [(1, said, "en", "a"), (1, said, "en", "a"), (2, None, None, None), (None, said + " x", "en", None), (3, "", "de", "a"), (4, " ".join(f"v{i * i}" for i in range(300)), None, None)] if some else []
    d = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "k", 5, 6) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _k string, slot long, fp long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    # a null id takes no part in dedup and stays; rows that repeat a kept id stay; null and empty texts fail the quality base
    assert got == ([(1, 0), (1, 0), (4, 0), (None, 0)] if some else [])


def _licence_index(**idf):
    return licenses.LicenseIndex({w: idf.get(w.decode(), 5.0) for w in licenses.vocabulary()})


def test_a_rare_licence_does_not_hide_a_common_one():
    mit, mpl = licenses.TEMPLATES["mit"][0], licenses.TEMPLATES["mpl-2"][0]
    index = _licence_index(**{w: 1.0 for w in mit.split()})
    assert index.scan(licenses.words_of(f"{mit} and then {mpl}".encode()))[4:] == ("mit,mpl-2", 1.0)
    stray = " x ".join(sorted(w.decode() for w in licenses.vocabulary() if w.decode() not in mit.split())[:40])
    assert index.scan(licenses.words_of(f"{stray} {mit}".encode()))[4:] == ("mit", 1.0)


def test_every_licence_of_a_text_is_found():
    for idf in ({}, {w: 1.0 + len(w) for w in ("permission", "license", "free", "software", "the", "version")}):
        index, everything = _licence_index(**idf), " and ".join(t for t, _ in licenses.TEMPLATES.values())
        assert set(index.scan(licenses.words_of(everything.encode()))[4].split(",")) == set(licenses.TEMPLATES)
        for name, (text, _) in licenses.TEMPLATES.items():
            got = set(index.scan(licenses.words_of(f"x {text} y".encode()))[4].split(","))
            # a versioned text also is its family's, and nothing else is
            assert name in got and got <= {name, name.split("-")[0], "gpl" if name.startswith("gpl") else name}, (name, got)


def test_licences_with_words_added_or_left_out():
    index = _licence_index()
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions"
    assert index.scan(licenses.words_of(bsd.encode()))[4:] == ("bsd", 1.0)
    for name, (text, keys) in licenses.TEMPLATES.items():
        words = text.split()
        held = {i + j for k in keys for i in range(len(words)) if words[i : i + len(k.split())] == k.split() for j in range(len(k.split()))}
        tried = 0
        for at in range(1, len(words)):
            more, less = [*words[:at], "zz", *words[at:]], [*words[:at], *words[at + 1 :]]
            for made, fine in ((more, not {at - 1, at} <= held), (less, at not in held)):
                if fine:
                    tried += 1
                    got = index.scan(licenses.words_of(" ".join(["x", *made, "y"]).encode()))
                    assert name in got[4].split(","), (name, made)
        assert tried > 4
    assert index.scan(licenses.words_of(" ".join(reversed(bsd.split())).encode()))[4:] == ("", 0.0)


def test_sequences_follow_the_mixed_order(spark):
    # a holds a seventh of the rows and half of the weight: half of the order is a's until its documents are used up
    rows = [(i, "a" if i % 7 == 0 else "b", "w " * (20 + i * 37 % 400)) for i in range(4200)]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    mixed = mixing.mixed_order(d, "mix_order", weights=spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double"), block=8)
    out = packing.pack_documents(mixed, q.tokenizer_path(), order_col="mix_order").collect()
    assert {r.doc_id for r in out} == set(range(4200)) and "mix_order" not in out[0].asDict()
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length, r.doc_id))
    assert sorted(seqs) == list(range(len(seqs))) and len(seqs) <= 1.02 * -(-sum(r.length for r in out) // 1024) + 1
    for parts in seqs.values():
        parts.sort()
        assert [o for o, *_ in parts] == [sum(l for _, l, _ in parts[:k]) for k in range(len(parts))]
    order = [i for s in sorted(seqs) for _, _, i in seqs[s]]
    share = [sum(i % 7 == 0 for i in order[k : k + 525]) / 525 for k in range(0, 1050, 525)]
    assert all(abs(x - 0.5) < 0.1 for x in share), share
    assert not any(i % 7 == 0 for i in order[2100:])


def test_a_key_behind_an_allowed_segment_is_redacted(spark):
    r = random.Random(21)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    texts = [f"get /example/{key} now", f"see {key}0123456789 too", "at /usr/Example/lib/python3/x1 and abcdefghij0123456789klmno"]
    out = [x.text for x in secrets.redact_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert all("[SECRET]" in x and key[8:-8] not in x for x in out[:2]) and "example" in out[0] and out[2] == texts[2]


def test_partition_masks_cover_their_radius():
    r, masks = random.Random(2), simhash.partition_masks(256, 19, 60)
    assert masks.shape == (60, 19) and all(len(set(m)) == 19 for m in masks.tolist())
    for _ in range(300):
        flips = set(r.sample(range(256), 256 // 19 - 1))
        assert any(not flips & set(m) for m in masks.tolist())


def test_near_copies_of_five_word_shingles(spark):
    r, docs, made = random.Random(6), [], {}
    word = lambda: f"w{r.getrandbits(30)}"
    for i in range(240):
        a = [word() for _ in range(r.randint(60, 400))]
        b, least = list(a), (0.8, 0.9, 0.4)[i % 3]
        while brute.jaccard(" ".join(a), " ".join(b)) > least + 0.02:
            b[r.randrange(len(b))] = word()
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        made[i] = least
    got = {x.id: x.component for x in simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = {s: sum(got[2 * i + 1] == 2 * i for i, x in made.items() if x == s) / 80 for s in (0.8, 0.9, 0.4)}
    assert found[0.8] >= 0.85 and found[0.9] >= 0.97 and found[0.4] == 0, found
    assert all(c // 2 == i // 2 for i, c in got.items())


def test_hot_keys_join_as_others(spark):
    rows = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 0 when id % 100 = 1 then null else id end as k")
    named = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).selectExpr("k as k2", "k * 2 as x", "n").where("k2 % 7 <> 1")
    got = common.hot_join(rows, named, F.col("k") == F.col("k2"), 3000)
    want = rows.join(named.drop("n"), F.col("k") == F.col("k2"), "left")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


@pytest.mark.parametrize("size", [2, 59, 8192, 10**6, 10**7])
def test_vectors_always_meet_in_blocks_and_cells(size):
    blocks, grid = embeddings.layout(64, max(0.0, math.log2(size / 8192)), 0.04)
    assert blocks >= 4 and grid >= 1
    assert embeddings.layout(3, 0.0, 0.04) == (3, 1) and embeddings.layout(1, 0.0, 0.04) == (1, 1)


def test_a_light_source_does_not_undo_the_mix(spark):
    rows = [(i, "abc"[i // 1000]) for i in range(3000)]
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1e-6)], "source string, weight double")
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights).collect()
    assert max(r.place for r in out) == 31
    slots = {r.slot: r.source for r in out}
    assert [slots[t] for t in range(64) if slots[t] != "c"] in (["a", "b"] * 32, (["a", "b"] * 32)[:63])
    order = [s for t, s in sorted(slots.items()) if s != "c"]
    assert order == ["a", "b"] * 32 and len([s for s in slots.values() if s == "c"]) == 32


@pytest.fixture(scope="module")
def pairs_at_four_fifths():
    """Wide fingerprints of 400 pairs of texts whose five-word similarity is just above 0.8."""
    r, pairs = random.Random(11), []
    word = lambda: f"w{r.getrandbits(30)}"
    for _ in range(400):
        a = [word() for _ in range(r.randint(150, 500))]
        b, last = list(a), list(a)
        while brute.jaccard(" ".join(a), " ".join(b)) >= 0.8:
            last = list(b)
            b[r.randrange(len(b))] = word()
        pairs.append([np.unpackbits(np.frombuffer(simhash.wide_fingerprint(" ".join(t).encode()), np.uint8), bitorder="little") for t in (a, last)])
    return np.array(pairs)


@pytest.mark.parametrize("values", [1000, 250_000, 15_000_000, 10**9])
def test_pairs_at_four_fifths_are_found_at_every_size(pairs_at_four_fifths, values):
    size = simhash.mask_size(values)
    masks = simhash.partition_masks(256, size, simhash.tables_for(size, 51, 0.8, 0.92))
    differ = pairs_at_four_fifths[:, 0] != pairs_at_four_fifths[:, 1]
    found = np.zeros(len(differ), bool)
    for m in masks:
        found |= ~differ[:, m].any(axis=1)
    found &= differ.sum(axis=1) <= 51
    assert found.mean() >= 0.9, found.mean()


def test_keys_of_near_copies_are_not_broadcast(spark):
    """Keys are many times the values that Spark sizes them by; only the few hot ones may go through the driver."""
    values = spark.createDataFrame([(i, bytes([i % 7, i % 3] * 16)) for i in range(21)], "rep long, fp binary")
    named = spark.createDataFrame([(i, i % 2, 1) for i in range(21)], "node long, component long, n long")
    ids = values.select("rep")
    for df, most in ((simhash.wide_links(values), 0), (simhash.simhash_links(spark.range(9).select(F.col("id").alias("rep"), F.col("id").alias("fp"))), 0), (common.hot_join(ids, named, F.col("rep") == F.col("node"), 21_000), 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") <= most and "SortMergeJoin" in plan
    assert common.hot_join(ids, named, F.col("rep") == F.col("node"), 21_000).count() == 21
