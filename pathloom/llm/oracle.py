"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = r"""WITH r AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(14 + length(replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c')) + length(replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l')))::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""

OP4 = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c(n, m) USING KEY (n) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT x.n, x.m FROM (SELECT l.b AS n, min(c.m) AS m FROM c JOIN l ON l.a = c.n GROUP BY 1) x JOIN recurring.c r ON r.n = x.n WHERE x.m < r.m)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, m AS component_id, m = vec_id AS kept FROM embeddings JOIN c ON c.n = vec_id"""

OP6 = f"""WITH r(key, verdict) AS (VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), '{UPPER}', '{LOWER}') AS host, CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM p),
m AS (SELECT page_id, host, path, key, verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(key) DESC NULLS LAST, instr(key, '/') DESC) AS i FROM h LEFT JOIN r ON (host = split_part(key, '/', 1) OR ends_with(host, '.' || split_part(key, '/', 1))) AND starts_with(path, substr(key, instr(key, '/'))))
SELECT h.page_id, h.host, h.path, m.key AS rule, coalesce(m.verdict, 'allow') AS verdict FROM h JOIN m ON m.i = 1 AND m.page_id IS NOT DISTINCT FROM h.page_id AND m.host = h.host AND m.path = h.path"""

OP7 = """WITH RECURSIVE s AS (SELECT source, count(*) AS c, round(pow(count(*)::DOUBLE, 0.7), 6) AS weight FROM documents GROUP BY 1),
v AS (SELECT source, c, greatest(1, round(weight / max(weight) OVER () * 1073741824)::BIGINT) AS w FROM s),
x AS (SELECT source, c, w, (sum(w) OVER ())::BIGINT AS total FROM v),
z AS (SELECT greatest(32, ceil(sum(c) / 524288))::BIGINT AS block FROM x),
q AS (SELECT list(source ORDER BY source NULLS FIRST) AS src, list(w ORDER BY source NULLS FIRST) AS w, any_value(total) AS total, list((c + block - 1) // block ORDER BY source NULLS FIRST) AS blocks FROM x, z),
e(n, t, k, i, slot) AS (SELECT -1::BIGINT, 0::BIGINT, list_transform(w, lambda x: 0::BIGINT), 0::BIGINT, -1::BIGINT FROM q
  UNION ALL SELECT n + 1, now + 1, list_transform(k, lambda x, j: x + CASE WHEN j = i THEN 1 ELSE 0 END), i, now FROM (SELECT n, k, now, list_position(d, list_min(d))::BIGINT AS i
    FROM (SELECT n, k, now, list_transform(k, lambda x, j: CASE WHEN x < q.blocks[j] AND x * q.total // q.w[j] <= now THEN ((x + 1) * q.total + q.w[j] - 1) // q.w[j] ELSE 4000000000000000000 END) AS d
      FROM (SELECT n, k, greatest(t, list_min(list_transform(k, lambda x, j: CASE WHEN x < q.blocks[j] THEN x * q.total // q.w[j] ELSE 4000000000000000000 END)))::BIGINT AS now FROM e, q WHERE n + 1 < list_sum(q.blocks)) y, q))),
plan AS (SELECT q.src[i] AS source, q.w[i] AS w, q.total, slot, row_number() OVER (PARTITION BY i ORDER BY n) - 1 AS j FROM e, q WHERE i > 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST) - 1 AS no FROM documents)
SELECT doc_id, d.source, no // block AS block, j * total // w AS release, ((j + 1) * total + w - 1) // w AS deadline, slot, no % block AS place
FROM d CROSS JOIN z JOIN plan ON plan.source IS NOT DISTINCT FROM d.source AND plan.j = no // block"""

OP10 = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
k AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i, unnest(list_transform(generate_series(1, len(ws)), lambda i: CASE WHEN i + 49 <= len(ws) THEN hash(ws[i:i + 49]) END)) AS key FROM w),
f AS (SELECT key, min(doc_id) AS low FROM k WHERE key IS NOT NULL GROUP BY 1),
g AS (SELECT k.doc_id, i, word, max(CASE WHEN f.low < k.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY k.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM k LEFT JOIN f USING (key)),
a AS (SELECT doc_id, count(*) FILTER (gone = 1) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a USING (doc_id)"""

OP11 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

# crc32 over the bytes of an ASCII key; a row's arcs, then the insertions before it, from the last row to the first
OP12 = r"""WITH RECURSIVE bytes AS (SELECT row_number() OVER () AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
drawn AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS draw FROM bytes),
hurt AS (SELECT k, conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE WHEN draw = 1 THEN '' WHEN draw = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn WHERE draw <> 0),
placed AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, role[1:1] AS c, lead(role[1:1]) OVER w AS c2, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, role, k, copy) AS nth, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, k, copy)),
f AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN bare[-1:] NOT IN ('.', '!', '?') THEN 't' ELSE 'f' END AS fault FROM placed),
d(conv_id, i, v) AS (SELECT conv_id, any_value(n), [{'c': 0, 'a': '', 't': ''}, {'c': 6, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:' || chr(10)}, {'c': 3, 'a': 'I', 't': 'assistant:' || chr(10)}, {'c': 0, 'a': '', 't': ''}] FROM f GROUP BY conv_id
  UNION ALL SELECT conv_id, i, [least(o[1], {'c': o[3].c + 3, 'a': 'I' || o[3].a, 't': 'user:' || chr(10) || o[3].t}), least(o[2], {'c': o[3].c + 3, 'a': 'I' || o[3].a, 't': 'user:' || chr(10) || o[3].t}), o[3], o[4]]
  FROM (SELECT conv_id, i, [x[1], x[2], least(x[3], {'c': x[4].c + 3, 'a': 'I' || x[4].a, 't': 'assistant:' || chr(10) || x[4].t}), least(x[4], {'c': x[3].c + 3, 'a': 'I' || x[3].a, 't': 'user:' || chr(10) || x[3].t})] AS o
  FROM (SELECT d.conv_id, d.i - 1 AS i, list_transform([1, 2, 3, 4], lambda s: list_min(list_filter([{'c': d.v[s].c + 4, 'a': 'D' || d.v[s].a, 't': d.v[s].t},
      CASE WHEN f.fault IN ('f', 't') AND (f.c = 's' AND s = 1 OR f.c = 'u' AND s <> 3 OR f.c = 'a' AND s = 3) THEN {'c': d.v[CASE f.c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].c + CASE f.fault WHEN 't' THEN 3 ELSE 0 END, 'a': 'K' || d.v[CASE f.c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].a, 't': f.role || ':' || f.text || chr(10) || d.v[CASE f.c WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END].t} END,
      CASE WHEN f.fault IN ('f', 't') THEN {'c': d.v[CASE WHEN s = 3 THEN 4 ELSE 3 END].c + 3 + CASE f.fault WHEN 't' THEN 3 ELSE 0 END, 'a': 'R' || d.v[CASE WHEN s = 3 THEN 4 ELSE 3 END].a, 't': CASE WHEN s = 3 THEN 'assistant:' ELSE 'user:' END || f.text || chr(10) || d.v[CASE WHEN s = 3 THEN 4 ELSE 3 END].t} END], lambda y: y IS NOT NULL))) AS x
    FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.i = d.i))),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (c2 IS NOT NULL AND c || c2 NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost, coalesce(v[1].a, '') AS audit, sha256(coalesce(v[1].t[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN d ON d.i = 0 AND d.conv_id IS NOT DISTINCT FROM o.conv_id"""

OP13 = rf"""WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lens AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY 1),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY 1),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))) AS x FROM tf JOIN lens USING (doc_id) JOIN w USING (term), size),
r AS (SELECT item_id, doc_id, sum(x * times)::BIGINT AS score FROM (SELECT item_id, term, count(*) AS times FROM asked GROUP BY ALL) a JOIN impact USING (term) GROUP BY 1, 2),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20"""

SQL = {"op11_topk": OP11, "op12_structure": OP12, "op13_lexical": OP13, "op1_chat": OP1, "op4_embeddings": OP4, "op6_urls": OP6, "op7_mixing": OP7, "op10_substrings": OP10}


def _op3() -> str:
    from .quality import RULES

    score = {
        "symbols": "n_symbols / greatest(word_chars, 1)",
        "repeats": "n_repeat_words / greatest(n_words, 1)",
        "lines": "n_dup_lines / greatest(n_lines, 1)",
        "word_length": "abs(word_chars / greatest(n_words, 1) - 6.5::DOUBLE)",
    }
    grid = ", ".join(f"('{r}', {i}, {c}::DOUBLE)" for r, (_, cs) in RULES.items() for i, c in enumerate(cs))
    scores = " UNION ALL ".join(f"SELECT doc_id, lang, '{r}' AS rule, ({s})::DOUBLE AS score FROM base" for r, s in score.items())
    return f"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS a, unnest(generate_series(1, len(ws))) AS i FROM t),
g AS (SELECT *, lead(a, 1) OVER d AS b, lead(a, 2) OVER d AS c FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, CASE WHEN c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 THEN 1 ELSE 0 END AS rep FROM g),
r AS (SELECT doc_id, sum(cover) AS n_repeat_words FROM (SELECT doc_id, max(rep) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cover FROM h) GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^ \\t\\n\\v\\f\\r]') GROUP BY 1),
counted AS (SELECT t.doc_id, lang, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines FROM t LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
grid(rule, i, cut) AS (VALUES {grid}),
s AS ({scores}),
good AS (SELECT s.* FROM s JOIN base USING (doc_id) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
hits AS (SELECT lang, doc_id, i, max(CASE WHEN score > cut THEN 1 ELSE 0 END) AS hit FROM good JOIN grid USING (rule) GROUP BY ALL),
k AS (SELECT lang, i, count(*) AS n, sum(hit) AS k FROM hits GROUP BY ALL),
p AS (SELECT *, CASE WHEN k = n THEN 1.0 ELSE list_sum(list_transform(generate_series(0, k::BIGINT), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.04::DOUBLE) + (n - j) * ln(0.96::DOUBLE)))) END AS tail FROM k),
v AS (SELECT lang, i, min(CASE WHEN tail <= 0.05 / (SELECT count(DISTINCT lang) + max(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) FROM good) THEN 1 ELSE 0 END) OVER (PARTITION BY lang ORDER BY i) AS fine FROM p),
cuts AS (SELECT lang, rule, cut FROM grid JOIN (SELECT lang, max(i) AS i FROM v WHERE fine = 1 GROUP BY 1) USING (i)),
bad AS (SELECT DISTINCT s.doc_id FROM s JOIN cuts ON cuts.rule = s.rule AND cuts.lang IS NOT DISTINCT FROM s.lang WHERE s.score > cuts.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM base"""


SQL["op3_quality"] = _op3()


def _op2() -> str:
    from .secrets import ALLOWED, CLASSES, KINDS, SAMPLES

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = []
    for i, (name, (pattern, group, least)) in enumerate(KINDS.items()):
        parts.append(f"SELECT {i} AS kind, {q(name)} AS name, doc_id, unnest(regexp_extract_all(text, {q(pattern)})) AS m, unnest(list_transform(regexp_extract_all(text, {q(pattern)}, {group}), lambda x: length(x) >= {least})) AS fine, unnest(regexp_split_to_array(text, {q(pattern)})) AS gap, unnest(generate_series(1, len(regexp_split_to_array(text, {q(pattern)})))) AS i, 0 AS width, 0::DOUBLE AS bits FROM d WHERE regexp_matches(text, {q(pattern)})")
    for i, c in enumerate(CLASSES):
        pattern = "[" + c.alphabet.replace("-", "\\-") + "]{" + str(c.window) + ",}"
        known = " OR ".join(f"regexp_matches(x, {q(p)})" for p in ALLOWED)
        parts.append(f"SELECT {len(KINDS) + i}, {q('entropy_' + c.name)}, doc_id, unnest(regexp_extract_all(runs, {q(pattern)})), unnest(list_transform(regexp_extract_all(runs, {q(pattern)}), lambda x: NOT ({known}))), unnest(regexp_split_to_array(runs, {q(pattern)})), unnest(generate_series(1, len(regexp_split_to_array(runs, {q(pattern)})))), {c.window}, {c.bits}::DOUBLE FROM d WHERE regexp_matches(runs, {q(pattern)})")
    runs = "coalesce(text, '')"
    for x in SAMPLES:
        runs = f"regexp_replace({runs}, {q(x)}, {q(' ' * len(x))}, 'gi')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {runs} AS runs FROM documents),
f AS ({' UNION ALL '.join(parts)}),
a AS (SELECT *, sum(length(gap)) OVER o + coalesce(sum(length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f WINDOW o AS (PARTITION BY doc_id, kind ORDER BY i)),
h AS (SELECT *, CASE WHEN width > 0 THEN list_filter(generate_series(0, length(m) - width), lambda j: list_aggregate(string_split(substr(m, j + 1, width), ''), 'entropy') >= bits - 1e-9) END AS hot FROM a WHERE m IS NOT NULL AND fine),
s AS (SELECT doc_id, kind, name, CASE WHEN width > 0 THEN start + hot[1] ELSE start END::BIGINT AS start, CASE WHEN width > 0 THEN start + hot[-1] + width ELSE start + length(m) END::BIGINT AS stop FROM h WHERE width = 0 OR len(hot) > 0),
k AS (SELECT s.* FROM s WHERE kind < {len(KINDS)} OR NOT EXISTS (SELECT 1 FROM s b WHERE b.kind < {len(KINDS)} AND b.doc_id = s.doc_id AND b.start <= s.start AND s.stop <= b.stop)),
g AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = {i}) AS n_{n}" for i, n in enumerate(KINDS))}, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < {len(KINDS)}) AS base, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM k GROUP BY 1)
SELECT doc_id, {', '.join(f"coalesce(n_{n}, 0) AS n_{n}" for n in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


SQL["op2_secrets"] = _op2()
