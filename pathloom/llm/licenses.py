"""Licence scans over a positional index of rare template words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, byte_texts, small_batches

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening passages of public licences, with the key phrases that must all be met.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge", "sublicense and or sell copies"],
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ["licensed under the apache license version 2", "in compliance with the license"],
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ["redistribution and use in source and binary forms", "retain the above copyright notice"],
    ),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
        ["gnu general public license", "free software foundation"],
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version",
        ["gnu lesser general public license", "free software foundation"],
    ),
    "gpl-2": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
        ["gnu general public license", "version 2 of the license"],
    ),
    "gpl-3": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ["gnu general public license", "version 3 of the license"],
    ),
    "lgpl-2.1": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        ["gnu lesser general public license", "version 2 1 of the license"],
    ),
    "agpl-3": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ["gnu affero general public license", "version 3 of the license"],
    ),
    "bsd-3": (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["neither the name of", "endorse or promote products derived from this software"],
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ["in no event will the authors be held liable", "permission is granted to anyone to use this software"],
    ),
    "boost-1": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ["to any person or organization obtaining a copy", "use reproduce display distribute execute and transmit the software"],
    ),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ["mozilla public license", "subject to the terms"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["for any purpose with or without fee is hereby granted", "appear in all copies"],
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ["free and unencumbered software", "released into the public domain"],
    ),
    "cc-by": (
        "this work is licensed under a creative commons attribution 4 0 international license",
        ["creative commons attribution 4 0 international license"],
    ),
    "cc-by-sa": (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        ["creative commons attribution sharealike"],
    ),
    "cc-by-nc": (
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        ["creative commons attribution noncommercial"],
    ),
}

#: Bytes outside words become blanks, A-Z become a-z; bytes of other alphabets stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def _split(phrase: str) -> list[bytes]:
    return phrase.encode().split()


class LicenseIndex:
    """Postings (template, place) of template words, and each word's IDF over the corpus."""

    def __init__(self, idf: dict[bytes, float], templates: dict = TEMPLATES, base: dict = BASE, least: float = 0.75, slack: int = 8):
        self.idf, self.least, self.slack = idf, least, slack
        self.names = list(templates)
        self.texts = [_split(t) for t, _ in templates.values()]
        self.keys = [[_split(k) for k in keys] for _, keys in templates.values()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        # a template is posted at the rarer half of its words: a text with `least` of it holds so many of these places
        self.needs: list[int] = []
        for t, words in enumerate(self.texts):
            ranked = sorted(set(words), key=lambda w: (-idf.get(w, 0.0), w))
            posted = set(ranked[: (len(ranked) + 1) // 2])
            for q, w in enumerate(words):
                if w in posted:
                    self.postings[w].append((t, q))
            self.needs.append(max(1, sum(w in posted for w in words) - int((1 - least) * len(words))))
        self.base = [(_split(p), label) for p, label in base.items()]
        # a phrase is looked for at its rarest word
        self.rare: dict[bytes, list[tuple[int, list[bytes], str]]] = defaultdict(list)
        for words, label in self.base:
            k = max(range(len(words)), key=lambda i: idf.get(words[i], 0.0))
            self.rare[words[k]].append((k, words, label))
        self.wanted = frozenset(self.postings) | frozenset(self.rare)

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, str, str, float]:
        """(base places, first start, last start, base labels, all labels, best score) of a text's words."""
        places: dict[bytes, list[int]] = defaultdict(list)
        wanted = self.wanted
        for i, w in enumerate(words):
            if w in wanted:
                places[w].append(i)
        starts, labels = [], set()
        for w, phrases in self.rare.items():
            for i in places.get(w, ()):
                for k, phrase, label in phrases:
                    if i >= k and words[i - k : i - k + len(phrase)] == phrase:
                        starts.append(i - k)
                        labels.add(label)
        found, score = set(labels), 1.0 if labels else 0.0
        # all posted words vote, so a licence's votes don't depend on what else the text holds
        held = Counter(t for w in places for t, _ in self.postings.get(w, ()))
        hits: dict[int, list[tuple[int, int]]] = {t: [] for t, n in held.items() if n >= self.needs[t]}
        if hits:
            for w, at in places.items():
                for t, q in self.postings.get(w, ()):
                    if t in hits:
                        hits[t] += [(i - q, q) for i in at]
        for t, votes in hits.items():
            best = self._best(words, t, sorted(votes))
            if best:
                found.add(self.names[t])
                score = max(score, best)
        return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(found)), score

    def _best(self, words: list[bytes], t: int, votes: list[tuple[int, int]]) -> float:
        """The best share of template t's words that stand in order within `slack` of one shift, 0 below `least` or without
        its key phrases.  Words added or left out move the later words by a few shifts, which are joined here."""
        text, best, seen, end = self.texts[t], 0.0, Counter(), 0
        for k, (shift, q) in enumerate(votes):
            while end < len(votes) and votes[end][0] <= shift + self.slack:
                seen[votes[end][1]] += 1
                end += 1
            if len(seen) >= self.needs[t] and (k == 0 or votes[k - 1][0] < shift):
                hit = self._aligned(words, text, shift) / len(text)
                if hit >= self.least and hit > best and all(self._near(words, shift, len(text), key) for key in self.keys[t]):
                    best = hit
                    if best == 1:
                        break
            seen[q] -= 1
            if not seen[q]:
                del seen[q]
        return best

    def _aligned(self, words: list[bytes], text: list[bytes], shift: int) -> int:
        """The longest common subsequence of a template and the text, each word at most slack places off the shift."""
        n, wide = len(words), 2 * self.slack + 1
        row = [0] * (wide + 1)  # row[d]: the most matches up to the text's place shift - slack + q + d
        for q, w in enumerate(text):
            at, left = shift - self.slack + q, 0
            new = []
            for d in range(wide):
                here = row[d] + 1 if 0 <= at + d < n and words[at + d] == w else row[d + 1]
                left = max(left, here)
                new.append(left)
            row = [*new, new[-1]]
        return row[-1]

    @staticmethod
    def _near(words: list[bytes], shift: int, length: int, key: list[bytes]) -> bool:
        area = words[max(0, shift - 8) : max(0, shift + length + 8)]
        return any(area[i : i + len(key)] == key for i in range(len(area) - len(key) + 1))


@cache
def vocabulary() -> frozenset[bytes]:
    return frozenset(w for t, _ in TEMPLATES.values() for w in _split(t)) | frozenset(w for p in BASE for w in _split(p))


def licence_idf(docs: DataFrame, text_col: str = "text") -> dict[bytes, float]:
    """IDF of the licence words over all documents: a sum a partition, then one row a word of the fixed vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, seen, n = vocabulary(), Counter(), 0
        for b in small_batches(batches):
            for t in byte_texts(b.column(0)):
                seen.update(vocab.intersection(words_of(t)))
                n += 1
        seen[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])

    df = {bytes(r["w"]): r["n"] for r in bounded(docs).select(text_col).mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    total = df.get(b"", 0)
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in vocabulary()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    labels: of the base phrases, and of every template of which `least` of the words stand in order near one place, with
    its key phrases; score: the best such share, 1 for a base phrase.  A licence's versions are labels of their own beside
    the one without a version.  Null text: empty, no words, no labels, score 0.  Repeated rows return a row each; empty table: no rows.
    """
    idf = licence_idf(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LicenseIndex(idf)
        for b in small_batches(batches):
            rows = []
            for t in byte_texts(b.column(1)):
                words = words_of(t)
                rows.append((len(words), *index.scan(words)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, schema)
