"""Exact ranked lexical search by a two-level quantised index."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded, byte_texts, materialise, small_batches

# on UTF-8 bytes: every byte of a character beyond ASCII is in the class, so matches are those over code points
TERM, OTHER = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")  # of lower-cased text
NO_ID = np.iinfo(np.int64).max
Item = tuple[object, dict[int, int]]


def term_counts(text: bytes, piece: int = 1 << 20) -> Counter[bytes]:
    """How often each term occurs; a long text is read in pieces that end between terms, so only one piece's are listed."""
    found: Counter[bytes] = Counter()
    text, at = text.lower(), 0  # of bytes: A-Z only
    while at < len(text):
        cut = OTHER.search(text, at + piece) if at + piece < len(text) else None
        end = cut.start() if cut else len(text)
        found.update(TERM.findall(text, at, end))
        at = end
    return found


def forward_index(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: n counts all its terms, terms (int32, ascending) and tfs (int32)
    are those of the vocabulary.  The vocabulary goes to every executor, so the caller bounds it."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in small_batches(batches):
            ids, ns, terms, tfs = [], [], [], []
            for doc, text in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True):
                counts = term_counts(text)
                if counts:
                    mine = sorted((known[t], counts[t]) for t in known.keys() & counts.keys())
                    ids.append(doc)
                    ns.append(counts.total())
                    terms.append(np.array([t for t, _ in mine], "<i4").tobytes())
                    tfs.append(np.array([c for _, c in mine], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    slim = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    return slim.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def document_frequencies(index: DataFrame) -> DataFrame:
    """(term, df): counted in each task first, so a frequent term is one row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"))
            df, got = (got, df) if len(got) > len(df) else (df, got)
            df = df.astype(np.int64)
            df[: len(got)] += got
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(df[hit], pa.int64())], ["term", "df"])

    return index.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Block:
    """The inverted index of some documents.  First level: slots and impacts as bytes, rounded up in steps of `unit`.  Second
    level: term frequencies and lengths, from which impacts are computed exactly."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, terms: list[bytes], tfs: list[bytes], weights: np.ndarray, unit: int, n_docs: int, n_terms: int):
        self.ids, self.weights, self.unit = ids, weights, unit
        self.m = 100 - 25 + (25 * lengths * n_docs) // n_terms
        term = np.frombuffer(b"".join(terms), "<i4")
        slot = np.repeat(np.arange(len(ids)), [len(t) // 4 for t in terms])
        order = np.argsort(term, kind="stable")
        self.slot, self.tf = slot[order].astype(np.int32), np.frombuffer(b"".join(tfs), "<i4")[order].astype(np.int64)
        self.start = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.byte = (-(-self.impact(term[order], self.tf, self.m[self.slot]) // unit)).astype(np.uint8)

    def impact(self, term: np.ndarray | int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))

    def bounds(self, query: dict[int, int]) -> np.ndarray:
        """An upper bound of each document's score, in units."""
        acc = np.zeros(len(self.ids), np.int64)
        for t, times in query.items():
            at = slice(self.start[t], self.start[t + 1])
            acc[self.slot[at]] += self.byte[at].astype(np.int64) * times
        return acc

    def exact(self, query: dict[int, int], slots: np.ndarray) -> np.ndarray:
        """The scores of some documents; slots ascend."""
        score = np.zeros(len(slots), np.int64)
        for t, times in query.items():
            a, b = self.start[t], self.start[t + 1]
            if a < b:
                at = np.minimum(a + np.searchsorted(self.slot[a:b], slots), b - 1)
                hit = self.slot[at] == slots
                score[hit] += times * self.impact(t, self.tf[at[hit]], self.m[slots[hit]])
        return score

    def best(self, query: dict[int, int], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of at most k documents that may be among the best k of all, given that k documents elsewhere score
        `least` or more.  The k largest bounds are rescored first: the least of their scores is a bound that k documents
        reach, and every document whose own bound reaches it is rescored too."""
        acc = self.bounds(query)
        if len(acc) > k:
            top = np.sort(np.argpartition(-acc, k - 1)[:k])
            least = max(least, int(self.exact(query, top).min()))
        slots = np.flatnonzero((acc > 0) & (acc * self.unit >= least))
        score = self.exact(query, slots)
        keep = (score > 0) & (score >= least)
        score, ids = score[keep], self.ids[slots[keep]]
        order = np.lexsort((ids, -score))[:k]
        return score[order], ids[order]


def _search(index: DataFrame, items: list[Item], weights: np.ndarray, n_docs: int, n_terms: int, k: int, block_docs: int) -> DataFrame:
    """(item, doc_id, score): at most k documents an item and task, among them the best k of all."""
    unit = max(1, -(-int(weights.max(initial=0)) * 1_000_000 // 255))
    sent = index.sparkSession.sparkContext.broadcast(([q for _, q in items], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, w = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)

        def take(parts: list[pa.RecordBatch]) -> None:
            ids = np.concatenate([b.column(0).fill_null(NO_ID).to_numpy() for b in parts])
            block = Block(ids, np.concatenate([b.column(1).to_numpy() for b in parts]), [x for b in parts for x in b.column(2).to_pylist()], [x for b in parts for x in b.column(3).to_pylist()], w, unit, n_docs, n_terms)
            for i, q in enumerate(queries):
                score, doc = best[i]
                s, d = block.best(q, k, int(score[k - 1]) if len(score) >= k else 0)
                s, d = np.concatenate([score, s]), np.concatenate([doc, d])
                order = np.lexsort((d, -s))[:k]
                best[i] = s[order], d[order]

        held, rows, size = [], 0, 0
        for b in batches:
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= block_docs or size >= 8 << 20:
                take(held)
                held, rows, size = [], 0, 0
        if rows:
            take(held)
        n = [len(s) for s, _ in best]
        doc = np.concatenate([np.zeros(0, np.int64), *(d for _, d in best)])
        score = np.concatenate([np.zeros(0, np.int64), *(s for s, _ in best)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n), pa.int32()), pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_bytes: int = 32 << 20, block_docs: int = 16384) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0, ties to the smaller doc_id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z lower-cased.  Statistics are
    counted over all documents; the index holds every document's terms that an item asks for.  A task inverts its documents
    block by block, bounds all scores of a block by bytes, and rescores in whole numbers each document whose bound reaches
    the k-th score known; so documents don't move, and k rows an item and task meet at the end.

    Items and their vocabulary go to every executor: they are split into passes of at most about `item_bytes` of text, as many as it takes,
    each over all documents.  Null and empty texts have no terms: such documents don't count, such items have no rows.
    Repeated documents are ranked each; a null doc_id comes last among equals; rows that share an item_id are items of
    their own.  Very long texts are read whole, in pieces.  No documents or no items: no rows.
    """
    asked = items.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null and text <> ''")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // item_bytes))
    made = None
    for p in range(passes):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) if passes > 1 else asked
        found = _ranked(docs, part, k, id_col, text_col, block_docs)
        made = found if made is None else made.union(found)
    return made


def _ranked(docs: DataFrame, asked: DataFrame, k: int, id_col: str, text_col: str, block_docs: int) -> DataFrame:
    spark = docs.sparkSession
    kind = asked.schema["item_id"].dataType.simpleString()
    counted = [(r["item_id"], term_counts(r["text"].encode())) for r in asked.collect()]  # of one pass, so of bounded size
    counted = [(i, c) for i, c in counted if c]
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, c in counted for t in c}))}
    items: list[Item] = [(i, {vocabulary[t]: n for t, n in c.items()}) for i, c in counted]
    index = materialise(forward_index(docs, vocabulary, id_col, text_col), "lexical")
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in document_frequencies(index).collect():  # a row a term of the vocabulary
        df[r["term"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    found = _search(index, items, weights, n_docs, n_terms, k, block_docs)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(items)], f"i2 int, item_id {kind}")
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(F.broadcast(names), F.col("item") == F.col("i2")).select("item_id", "rank", "doc_id", "score")
