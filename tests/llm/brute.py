"""Plain versions of the ten contracts, for small inputs."""

import hashlib
import heapq
import math
import re
import struct
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^ \t\n\x0b\x0c\r]+")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def chat(rows):
    convs = {}
    key = lambda x: (x is not None, x if x is not None else 0)
    txt = lambda x: (x is not None, x or "")
    for c, t, r, x in sorted(rows, key=lambda r: (key(r[1]), txt(r[2]), txt(r[3]))):
        convs.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    return out


KINDS = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def secrets(text):
    text = text or ""
    found = {k: [(m.start(), m.end()) for m in p.finditer(text) if len(m[g]) >= n] for k, p, g, n in KINDS}
    spans = sorted((s, i, k, e) for i, (k, _, _, _) in enumerate(KINDS) for s, e in found[k])
    return (*(len(found[k]) for k, *_ in KINDS), sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans))), [f"{k}:{s}:{e}" for s, _, k, e in spans]


def quality(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    rep = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(rep), n < 50 or 100 * len(rep) > 50 * n


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def vectors(rows, threshold=0.98):
    good = []
    for i, v, l in rows:
        if v is None or l is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.append((i, np.array(v, np.float64), l))
    links = [(a[0], b[0]) for k, a in enumerate(good) for b in good[k + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= threshold]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    comp = components(n, links)
    return {i: (n[i], comp[i], comp[i] == i) for i in n}


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    starts, labels = [], set()
    for p, label in PHRASES.items():
        p = p.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def url(u, rules):
    host = path = ""
    if u is not None and "://" in u:
        rest = re.split(r"[?#]", u.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path
    fit = []
    for key, verdict in rules:
        h, s, p = key.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(s + p):
            fit.append((len(key), len(h), key, verdict))
    return (host, path, max(fit)[2], max(fit)[3]) if fit else (host, path, None, "allow")


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash(rows):
    fp = [(i, fingerprint(t)) for i, t in rows]
    comp = components([i for i, _ in fp], [(a, b) for k, (a, x) in enumerate(fp) for b, y in fp[k + 1 :] if (x ^ y).bit_count() <= 3])
    return {i: (f"{f:016x}", comp[i]) for i, f in fp}


def jaccard(a, b, width=5):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def without_near_copies(rows, least=0.8):
    """Documents that aren't similar, directly or by others, to one with a smaller id; no pair may be near the limit."""
    sure = [(i, j, jaccard(t, u)) for k, (i, t) in enumerate(rows) for j, u in rows[k + 1 :]]
    assert not any(0.55 < s < 0.9 for _, _, s in sure)
    comp = components([i for i, _ in rows], [(i, j) for i, j, s in sure if s >= least])
    return [(i, t) for i, t in rows if comp[i] == i]


def pieces(text, tok, cap=1024):
    ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
    cut = list(range(len(ids), 0, -cap))[::-1]
    out, at = [], 0
    for k, to in enumerate(cut):
        part = ids[at:to]
        out.append((k, at, to - at, zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
        at = to
    return out


def substrings(rows, window=50):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def entropy_spans(text, classes, allowed):
    import math
    from collections import Counter

    out = []
    for x in ("example", "abcdefghij", "0123456789"):
        text = re.sub("(?i)" + x, " " * len(x), text or "")
    for c in classes:
        for m in re.finditer("[" + re.escape(c.alphabet) + "]{%d,}" % c.window, text or ""):
            run = m.group()
            if any(re.search(p, run) for p in allowed):
                continue
            hot = [i for i in range(len(run) - c.window + 1) if -sum(n / c.window * math.log2(n / c.window) for n in Counter(run[i : i + c.window]).values()) >= c.bits - 1e-9]
            if hot:
                out.append((m.start() + hot[0], m.start() + hot[-1] + c.window))
    return out


def redact(text, spans, mark="[SECRET]"):
    out, at = "", 0
    for s, e in sorted(spans):
        if s >= at:
            out += text[at:s] + mark
        at = max(at, e)
    return out + text[at:]


def top_k(rows, k=5, every=50):
    """rows: (id, vector): {(query, rank): (id, score)} for tables without repeated ids."""
    fine = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in fine:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fine if i != q and len(a) == len(b))
            out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(found[:k])}
    return out


def damaged(rows):
    """rows: (conv, turn, role, text)."""
    out = []
    for c, t, role, text in rows:
        blank = lambda x: " " if x is None else str(x)
        draw = zlib.crc32(f"{blank(c)}:{blank(t)}".encode()) % 20
        role, text = "user" if draw == 4 else blank(role), blank(text)
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(c, t, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def structure(original, rows):
    """{conv: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)} by the edits themselves, tried from the left."""
    out = {c: (0, 0, 0, 0, 0, 0, "", sha("")) for c, *_ in original}
    for conv in {c for c, *_ in rows}:
        mine = [(t, role, text) for c, t, role, text in rows if c == conv]
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], xxhash.xxh64_intdigest(x[2].encode(), 42) - ((xxhash.xxh64_intdigest(x[2].encode(), 42) >> 63) << 64)))
        seen, faults = set(), []
        for _, role, text in mine:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        heap, done = [(0, "", 0, "", ())], {}  # cheapest first, then least letters; every place and state is settled once
        while heap:
            cost, audit, i, s, lines = heapq.heappop(heap)
            if (i, s) in done:
                continue
            done[i, s] = True
            if i == len(mine) and s in ("", "a"):
                break
            for new in ("user", "assistant"):
                if (s, new[0]) in follow:
                    heapq.heappush(heap, (cost + 3, audit + "I", i, follow[s, new[0]], (*lines, f"{new}:")))
            if i < len(mine):
                _, role, text = mine[i]
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, lines))
                if faults[i] not in ("blank", "duplicate"):
                    more = 3 if faults[i] == "truncated" else 0
                    for new, price, name in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                        if (s, new[:1]) in follow:
                            heapq.heappush(heap, (cost + price + more, audit + name, i + 1, follow[s, new[:1]], (*lines, f"{new}:{text}")))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(lines)))
    return out


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lexical(docs, items, k=20):
    """docs: rows (id, text); items: (id, text): a list for each item row of (rank, doc, score)."""
    terms = lambda t: TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, ts, {x: ts.count(x) for x in set(ts)}) for i, ts in held if ts]
    n_docs, total, df = len(held), sum(len(ts) for _, ts, _ in held), {}
    for _, _, tf in held:
        for x in tf:
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, ts, tf in held:
            m = 100 - 25 + (25 * len(ts) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 12 * m)) for x in terms(text) if x in tf)
            if s > 0:
                found.append((-s, i is None, i if i is not None else 0))
        out.append((item, [(r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]))
    return out


def license_labels(words, templates, least=0.75, slack=8):
    """{label: best share} of the templates whose words stand in order, each within slack places of one shift tried plainly at
    every place, with all key phrases near."""
    found = {}
    for name, (text, keys) in templates.items():
        text = text.encode().split()
        if not set(text) & set(words):
            continue
        for shift in range(-slack, len(words)):
            if len(set(text) & set(words[max(0, shift - slack) : shift + len(text) + slack])) < least * len(set(text)) / 2:
                continue
            near = words[max(0, shift - 8) : max(0, shift + len(text) + 8)]
            if not all(any(near[i : i + len(k.split())] == k.encode().split() for i in range(len(near))) for k in keys):
                continue
            table = {}
            for q, w in enumerate(text):
                for at in range(shift + q - slack, shift + q + slack + 1):
                    same = 0 <= at < len(words) and words[at] == w
                    table[q, at] = max(table.get((q - 1, at - 1), 0) + same, table.get((q - 1, at), 0), table.get((q, at - 1), 0))
            share = max(v for (q, _), v in table.items() if q == len(text) - 1) / len(text)
            if share >= least:
                found[name] = max(share, found.get(name, 0))
    return found
