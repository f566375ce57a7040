"""Packing documents into sequences by minimum bin slack."""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, byte_texts, materialise, salted_rank, small_batches

EOT = "<|endoftext|>"
#: White space, beside blank and line feed, that the splitter below doesn't treat; texts with it take the tokenizer's own path.
ODD = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(free)) for b in range(256)}


SIGNS = _byte_signs()
BLANK = SIGNS[32]

# Fixed value: the pattern of the vocabulary's pieces, for texts whose only numerals are ASCII digits.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class PieceEncoder(dict):
    """Ids (as little-endian bytes) of texts under a byte-level BPE whose pieces never span a lone blank or line feed.

    Such a vocabulary's pattern lets a piece begin with white space but not hold it later, so a text in which each blank
    or line feed stands between two other characters is the sum of its parts cut before them.  Parts are kept in a
    bounded memo, whose older half goes when it is full; a closing comma or full stop after a letter or digit is a piece of its own.  Any other text goes to the
    tokenizer whole.  A part of letters and ASCII is split by the vocabulary's own pattern and goes straight to the tokenizer's model.  The result always equals tokenizer.encode(text, add_special_tokens=False).
    """

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.tok, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tok.model
        # the shortcuts below are right for this pattern and one added token; any other vocabulary encodes texts whole
        made = json.loads(self.tok.to_str())
        pre = made.get("pre_tokenizer") or {}
        self.known = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and made.get("normalizer") is None and made["model"]["type"] == "BPE" and {x["content"] for x in made["added_tokens"]} <= {EOT}
        self.marks = {c: self.whole(c) for c in ",."}

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def fresh(self, full: str) -> bytes:
        """The ids of a part as it stands in the text."""
        if full.isascii() or all(c.isascii() or c.isalpha() for c in full):
            ids = array("I")
            for piece in PIECES.findall(full):
                ids.extend([x.id for x in self.model.tokenize(piece.encode().decode("latin-1").translate(SIGNS))])
            return ids.tobytes()
        return self.whole(full)

    def __missing__(self, part: str) -> bytes:
        if part[-1] in ",." and len(part) > 1 and part[-2].isalnum():
            return self[part[:-1]] + self.marks[part[-1]]  # not kept: its stem is
        if part.isascii() and part.isalpha():
            ids = array("I", [x.id for x in self.model.tokenize(BLANK + part)]).tobytes()
        else:
            ids = self.fresh(part if part[0] == "\n" else " " + part)
        if len(part) < 64:
            if len(self) >= self.limit:
                for old in list(islice(self, self.limit // 2)):
                    del self[old]
            self[part] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        cut = text.replace("\n", " \n")
        if not self.known or "  " in cut or "\n " in cut or cut[0] in " \n" or cut[-1] in " \n" or EOT in text or any(c in text for c in ODD):
            return self.whole(text)
        first, _, rest = cut.partition(" ")
        return self.fresh(first) + (b"".join(map(self.__getitem__, rest.split(" "))) if rest else b"")


@cache
def encoder(path: str) -> PieceEncoder:
    """One encoder a worker process, whose memo serves all tasks it runs."""
    return PieceEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, order_col: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids][, order_col]): a document's ids with end_id behind them, cut only if
    over capacity.

    Then the first piece takes the remainder and all others are full.  Null text: empty, one piece of one id.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids + [order_col] * bool(order_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, last = encoder(tokenizer_path), np.array([end_id], "<u4").tobytes()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids + [pa.int64()] * bool(order_col)
        for b in small_batches(batches):
            rows: list[tuple] = []
            places = b.column(2).to_pylist() if order_col else [None] * b.num_rows
            for doc, text, place in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), places, strict=True):
                ids = memoryview(enc.encode(text.decode()) + last)
                n = len(ids) // 4
                at, first = 0, n % capacity or capacity
                k = 0
                while at < n:
                    to = at + (first if k == 0 else capacity)
                    part = ids[4 * at : 4 * to]
                    rows.append((doc, k, at, to - at, zlib.crc32(part), *([bytes(part)] if keep_ids else ()), *([place] if order_col else ())))
                    at, k = to, k + 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids + (f", `{order_col}` long" if order_col else "")
    more = [F.col(order_col).cast("long").alias("o")] if order_col else []
    return bounded(docs).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), *more).mapInArrow(run, schema)


def slack_patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Minimum bin slack over a length histogram: [(pattern, times)], a pattern being [(length, copies)], longest first.

    Each bin takes the longest length left; a bitset subset-sum over the lengths available finds the fullest combination
    for the rest, larger lengths preferred.  The combination is removed as often as the counts allow, so the work depends
    on the capacity and not on the number of pieces.
    """
    left, out = dict(sorted(((l, n) for l, n in counts.items() if n > 0), reverse=True)), []
    while left:
        top = next(iter(left))
        room = capacity - top
        mask, reach, used = (1 << room + 1) - 1, [1], []
        for l, n in left.items():
            k = min(n - (l == top), room // l)
            if k <= 0:
                continue
            bits, step = reach[-1], 1
            while k > 0:
                s = min(step, k)
                bits |= bits << s * l
                k, step = k - s, step * 2
            reach.append(bits & mask)
            used.append(l)
            if reach[-1] >> room & 1:
                break
        full, pattern = reach[-1].bit_length() - 1, Counter({top: 1})
        for i in range(len(used) - 1, -1, -1):
            while not reach[i] >> full & 1:
                full -= used[i]
                pattern[used[i]] += 1
        times = min(left[l] // c for l, c in pattern.items())
        for l, c in pattern.items():
            left[l] -= c * times
            if not left[l]:
                del left[l]
        out.append((sorted(pattern.items(), reverse=True), times))
    return out


def pack(parts: DataFrame, capacity: int = 1024, bucket_rows: int = 4096, order_col: str | None = None, groups: int = 64, group_pieces: int = 512) -> DataFrame:
    """parts (with doc_id, piece, length) plus sequence_id and offset, gapless from 0 in each sequence.

    Only the histogram of at most `capacity` lengths comes to the driver.  Pieces of a length are numbered bucket by
    bucket, of about `bucket_rows` pieces for the most frequent length, and number ranges map to patterns in a table of
    bounded size.  Empty table: no rows.

    With order_col the sequences follow that order: it is cut into at most `groups` equal ranges, of about `group_pieces`
    pieces at least, and the sequences of a range, which hold its pieces only, come before those of the next; pieces
    without a place follow in a range of their own.  Patterns alternate within a range, so that long documents don't lead.
    """
    names, group, order = parts.columns, F.lit(0), [F.xxhash64("doc_id", "piece"), F.col("doc_id"), F.col("piece")]
    if order_col:
        n, top = parts.agg(F.count(F.lit(1)), F.max(order_col)).first()
        groups = max(1, min(groups, n // group_pieces))
        at = F.col(order_col) * groups / F.lit(float((top or 0) + 1))
        group = F.coalesce(F.floor(at), F.lit(groups)).cast("int")
    parts = parts.withColumn("_pl_group", group)
    hists: dict[int, dict[int, int]] = {}
    for r in parts.groupBy("_pl_group", "length").agg(F.count(F.lit(1)).alias("n")).collect():
        hists.setdefault(r["_pl_group"], {})[r["length"]] = r["n"]
    biggest = max((n for h in hists.values() for n in h.values()), default=0)
    buckets = min(1 << 16, max(1, -(-biggest // bucket_rows)))
    bucket = F.pmod(order[0], F.lit(buckets))
    if order_col:
        bucket = F.coalesce(F.floor((at - F.floor(at)) * buckets), bucket)
        order = [F.col(order_col), *order]
    table, spans, base = {}, {}, 0
    for g, hist in sorted(hists.items()):
        ranges: dict[int, list[tuple[int, int, int, int]]] = {}
        used: Counter = Counter()
        start = base
        for pattern, times in slack_patterns(hist, capacity):
            offset = 0
            for l, c in pattern:
                ranges.setdefault(l, []).append((used[l], c, base, offset))
                used[l] += c * times
                offset += l * c
            base += times
        table |= {(g, l): tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for l, r in ranges.items()}
        spans[g] = (start, base - start, _stride(base - start) if order_col else 1)

    ranked = salted_rank(parts, ["_pl_group", "length"], order, bucket, "_pl_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank, of = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_pl_rank", "_pl_group"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            both = of.astype(np.int64) * (capacity + 1) + length
            for x in np.unique(both):
                at = np.flatnonzero(both == x)
                g, l = divmod(int(x), capacity + 1)
                start, copies, first, offset = table[g, l]
                p = np.searchsorted(start, rank[at], "right") - 1
                r = rank[at] - start[p]
                low, n, stride = spans[g]
                seq[at] = low + (first[p] + r // copies[p] - low) * stride % n
                off[at] = offset[p] + r % copies[p] * l
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in parts.select(*names).dtypes) + ", sequence_id long, offset long"
    return ranked.select(*names, "_pl_rank", "_pl_group").mapInArrow(run, schema)


def _stride(n: int) -> int:
    """A step near the golden section of n without a common divisor: multiples of it modulo n are spread evenly."""
    step = max(1, round(n * 0.618))
    while math.gcd(step, n) > 1:
        step += 1
    return step


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, order_col: str | None = None) -> DataFrame:
    """Tokenise, cut and pack: one row per piece.  Ties and repeated rows are pieces of their own; null ids stay null; null and
    empty texts are one piece of end_id; an empty table gives no rows.

    With order_col, a column of docs, sequences follow it; it isn't returned.
    """
    parts = materialise(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids, order_col), "pieces")
    packed = pack(parts, capacity, order_col=order_col)
    return packed.drop(order_col) if order_col else packed
