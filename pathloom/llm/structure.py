"""Conversation structure repair by lazy weighted determinisation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded, materialise, small_batches

BLANKS = " \t\n\x0b\x0c\r"
DROPPED, EMPTIED, UNENDED, REPEATED, MADE_USER, OF = 0, 1, 2, 3, 4, 20

# States of the pattern s?(ua)+ or nothing: nothing read, after s, after u, after a.  An inserted or new role is the one that the
# pattern wants next; a kept role must be allowed.  Costs are those of the edits.
NEXT = (2, 2, 3, 2)
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
REROLE, DELETE, INSERT, TRUNCATED, NEVER = 3, 4, 3, 3, 1 << 40
FINE, CUT, GONE = 0, 1, 2
INITIALS = "sua"  # of a symbol: 3 * place in this string (3 for any other) + fault
EDIT = str.maketrans({"U": "I", "A": "I", "k": "K", "d": "D", "u": "R", "a": "R"})


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows after faults drawn by crc32("conv:turn") % 20: 0 drops the row, 1 empties its text, 2 takes its . ! ? away, 3
    repeats it, 4 makes its role user.  A null conversation, turn, role or text counts as one space in the draw and in the row's role and text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(blank(conv), F.lit(":"), blank(turn))) % OF
    said = F.when(draw == EMPTIED, "").when(draw == UNENDED, F.translate(blank(text), ".!?", "")).otherwise(blank(text))
    out = rows.select(F.col(conv), F.col(turn), F.when(draw == MADE_USER, "user").otherwise(blank(role)).alias(role), said.alias(text), draw.alias("_pl_draw"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_pl_draw") == REPEATED, 2).otherwise(1)))
    return out.where(F.col("_pl_draw") != DROPPED).withColumn("_pl_copy", copies).drop("_pl_draw", "_pl_copy")


def _closed(v: list[int]) -> list[int]:
    """Costs to go, with insertions before the next row."""
    user, assistant = min(v[2], v[3] + INSERT), min(v[3], v[2] + INSERT)
    return [min(v[0], user + INSERT), min(v[1], user + INSERT), user, assistant]


class Determinised:
    """The edit automaton read from the last row to the first, made deterministic as far as it is needed.

    A state is a vector: for each state of the pattern, what the rest costs from there, less the least of the four.  Reading
    one more row (in front) gives the next vector, what was taken off, and for each state the first cheapest edits up to
    and with that row; all three are remembered by (vector, symbol), so a row costs a look at a table.  Edits that are
    tight between two vectors lie on a cheapest way, and the one of the least letter is taken: D, I, K, R in that order.
    """

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.table: dict[tuple[int, int], tuple[int, int, tuple]] = {}
        self.end = self.state(_closed([0, NEVER, NEVER, 0]))[0]

    def state(self, costs: list[int]) -> tuple[int, int]:
        """(number, what was taken off) of a vector of costs."""
        off = min(costs)
        key = tuple(min(c - off, NEVER) for c in costs)
        if key not in self.known:
            self.known[key] = len(self.vectors)
            self.vectors.append(key)
        return self.known[key], off

    def read(self, after: int, symbol: int) -> tuple[int, int, tuple]:
        """(vector before the row, cost taken off, per state of the pattern (edits, state after the row))."""
        if (after, symbol) not in self.table:
            self.table[after, symbol] = self._made(self.vectors[after], symbol)
        return self.table[after, symbol]

    def _made(self, after: tuple[int, ...], symbol: int) -> tuple[int, int, tuple]:
        initial, fault = (INITIALS + " ")[symbol // 3], symbol % 3
        ways: list[list[tuple[int, str, int]]] = []
        for s in range(4):
            arcs = [(after[s] + DELETE, "d", s)]
            if fault != GONE:
                more = TRUNCATED if fault == CUT else 0
                if (to := KEPT.get((s, initial))) is not None:
                    arcs.append((after[to] + more, "k", to))
                to = NEXT[s]
                arcs.append((after[to] + REROLE + more, "ua"[to - 2], to))
            ways.append(arcs)
        costs = _closed([min(c for c, _, _ in arcs) for arcs in ways])
        moves = []
        for s in range(4):
            code, at = "", s
            while True:  # ends: an insertion leads to a state that costs less
                tight = [("DKRR"["dkua".index(x)], x, to) for c, x, to in ways[at] if c == costs[at]]
                if costs[NEXT[at]] + INSERT == costs[at]:
                    tight.append(("I", "UA"[NEXT[at] - 2], -1))
                _, x, to = min(tight)
                code += x
                if to >= 0:
                    break
                at = NEXT[at]
            moves.append((code, to))
        number, off = self.state(costs)
        return number, off, tuple(moves)

    def tail(self, s: int) -> str:
        """Edits after the last row."""
        return {0: "", 1: "UA", 2: "A", 3: ""}[s]


@cache
def automaton() -> Determinised:
    """One table a worker, shared by its tasks: vectors differ by a few units, so there are few."""
    return Determinised()


def trace(symbols: bytes, after: tuple[int, ...], start: int) -> tuple[list[str], int]:
    """(edits of each row, state after them) of the cheapest way from a state of the pattern through rows in front of a vector.

    The table is scanned from the last row to the first; then the tight arcs are followed back over the scan, which is
    reading order.
    """
    a = automaton()
    at, scanned = a.state(list(after))[0], []
    for symbol in reversed(symbols):
        at, _, moves = a.read(at, symbol)
        scanned.append(moves)
    codes = []
    for moves in reversed(scanned):
        code, start = moves[start]
        codes.append(code)
    return codes, start


def _rows(batches: Iterator[pa.RecordBatch], size: int = 2048) -> Iterator[tuple]:
    for b in small_batches(batches, size):
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


PLACE = ["_pl_turn", "_pl_role", "_pl_hash", "_pl_uid"]
SCANNED = "_pl_turn long, _pl_role string, _pl_hash long, _pl_uid long, symbols binary, after array<long>, last boolean, n_rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
SUMMARY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _symbols(rows: DataFrame, conv: str) -> DataFrame:
    """Slim rows with what a symbol needs, and a mark beside the first row of each role and text of a conversation."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.substring("_pl_role", 1, 1)
    cls = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(bare == "", GONE).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT)
    slim = rows.select(conv, *PLACE, (cls * 3 + fault).cast("int").alias("symbol"))
    key = F.sha2(F.concat(F.length("_pl_role").cast("string"), F.lit(":"), F.col("_pl_role"), F.col("text")), 256)
    first = rows.where(bare != "").groupBy(conv, key.alias("_pl_key")).agg(F.min(F.struct(*PLACE)).alias("x")).select(conv, *[F.col(f"x.{c}").alias(c) for c in PLACE], F.lit(-1).alias("symbol"))
    return slim.unionByName(first)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 8192) -> tuple[DataFrame, DataFrame]:
    """(summary, edited).  summary: a row a conversation with rows: gaps, blank, duplicate, truncated, illegal, cost.  edited: its
    rows in order, with place, edits (K keep, R new role, D delete, each after the I of insertions before it), and the
    repaired turns they leave as `turns` array<struct<role, text>>; it stands in order within its partitions.

    Rows go by turn (null first), role, a hash of the text, and then as they stand, so copies are adjacent.  A row's first fault
    counts: blank; duplicate of an earlier role and text; truncated, if its last character but blanks isn't . ! or ?.
    Cheapest edits make the roles' initials nothing, or ua once or more, after an s at most: keep 0, new role 3, delete 4 (a must for blank and duplicate
    rows), insert an empty turn 3, and 3 for each truncated row that stays.  Among cheapest edits the least by letters is taken.

    Duplicates are found by minima aggregated before the shuffle.  Two passes go over each conversation as a stream, and
    hold `chunk` rows of it and no more: one from its end, over a byte a row, notes the vector behind each chunk; one from
    its start traces the edits.  A conversation is one sequence, and its repaired text one digest, so it is one task's.

    Nulls in role and text count as one space; a null conversation is one; an empty role can't be kept.  Equal rows are duplicates;
    very long texts and conversations are read whole; extra columns go; empty table: no rows.
    """
    r = bounded(rows).select(F.col(conv).alias("_pl_conv"), F.col(turn).cast("long").alias("_pl_turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("_pl_role"), F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    r = materialise(r.withColumn("_pl_hash", F.xxhash64("text")).withColumn("_pl_uid", F.monotonically_increasing_id()), "turns")
    kind = r.schema["_pl_conv"].dataType.simpleString()
    down = ["_pl_conv", F.desc_nulls_last("_pl_turn"), *[F.desc(c) for c in PLACE[1:]], "symbol"]
    symbols = _symbols(r, "_pl_conv").repartition("_pl_conv").sortWithinPartitions(*down).select("_pl_conv", *PLACE, "symbol")
    arrow = to_arrow_type(r.schema["_pl_conv"].dataType)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, made = automaton(), []

        def rows_of() -> Iterator[tuple]:
            """Chunks from the end of each conversation; its first chunk, which comes last, has the summary."""
            conv, started, first, behind, last = None, False, False, None, True
            held, place = bytearray(), None
            at, cost, n, counts, turns, later = 0, 0, 0, [0, 0, 0, 0], [None, None, 0], None

            def chunked(whole: bool) -> tuple:
                low, high, distinct = turns
                gaps = high - low + 1 - distinct if distinct else 0
                summary = [n, gaps, *counts, cost + a.vectors[at][0]] if whole else [None] * 7
                return (conv, *place, bytes(reversed(held)), list(a.vectors[behind]), last, *summary)

            for c, *p, symbol in _rows(batches):
                if not started or c != conv:
                    if started:
                        yield chunked(True)
                    conv, started, first, last = c, True, False, True
                    held, at, behind, cost, n, counts, turns, later = bytearray(), a.end, a.end, 0, 0, [0, 0, 0, 0], [None, None, 0], None
                if symbol < 0:
                    first = True
                    continue
                if len(held) >= chunk:
                    yield chunked(False)
                    held, behind, last = bytearray(), at, False
                fault = symbol % 3
                if fault == GONE:
                    counts[0] += 1
                elif not first:
                    counts[1] += 1
                    symbol += GONE - fault
                elif fault == CUT:
                    counts[2] += 1
                cls = symbol // 3
                if later is not None and (cls, later) not in ((0, 1), (1, 2), (2, 1)):
                    counts[3] += 1
                later, first, place = cls, False, p
                if p[0] is not None and p[0] != turns[0]:
                    turns = [p[0], p[0] if turns[1] is None else turns[1], turns[2] + 1]
                held.append(symbol)
                at, off, _ = a.read(at, symbol)
                cost, n = cost + off, n + 1
            if started:
                yield chunked(True)

        fields = [arrow, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_(), *[pa.int64()] * 7]
        names = ["_pl_conv", *PLACE, "symbols", "after", "last", "n_rows", *SUMMARY]
        for row in rows_of():
            made.append(row)
            if len(made) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), fields, strict=True)], names)
                made = []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * len(fields), fields, strict=True)], names)

    scanned = materialise(symbols.mapInArrow(scan, f"_pl_conv {kind}, {SCANNED}"), "scanned")
    summary = scanned.where("n_rows is not null").select(F.col("_pl_conv").alias(conv), "n_rows", *SUMMARY)
    none = lambda t: F.lit(None).cast(t)
    chunks = scanned.select("_pl_conv", *PLACE, F.lit(0).alias("kind"), none("string").alias("text"), "symbols", "after", F.col("n_rows").isNotNull().alias("start"), "last")
    texts = r.select("_pl_conv", *PLACE, F.lit(1).alias("kind"), "text", none("binary").alias("symbols"), none("array<long>").alias("after"), F.lit(False).alias("start"), F.lit(False).alias("last"))
    order = ["_pl_conv", F.asc_nulls_first("_pl_turn"), *PLACE[1:], "kind"]
    both = chunks.unionByName(texts).repartition("_pl_conv").sortWithinPartitions(*order).select("_pl_conv", "_pl_turn", "_pl_role", "text", "symbols", "after", "start", "last")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        turn = pa.struct([("role", pa.string()), ("text", pa.string())])
        fields, names = [arrow, pa.int64(), pa.int64(), pa.string(), pa.list_(turn)], ["conv", "place", "turn", "edits", "turns"]

        def rows_of() -> Iterator[tuple]:
            codes, state, place, ends = [], 0, 0, False
            for c, t, role, text, symbols, after, start, last in _rows(batches, 256):
                if symbols is not None:
                    state, place = (0, 0) if start else (state, place)
                    codes, state = trace(symbols, tuple(after), state)
                    codes.reverse()
                    ends = last
                    continue
                code = codes.pop()
                if ends and not codes:
                    code += a.tail(state)
                left = []
                for x in code:
                    if x in "UA":
                        left.append({"role": "user" if x == "U" else "assistant", "text": ""})
                    elif x in "ua":
                        left.append({"role": "user" if x == "u" else "assistant", "text": text})
                    elif x == "k":
                        left.append({"role": role, "text": text})
                yield c, place, t, code.translate(EDIT), left
                place += 1

        made, size = [], 0
        for row in rows_of():
            made.append(row)
            size += sum(len(x["text"]) for x in row[4]) + 64
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), fields, strict=True)], names)
                made, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 5, fields, strict=True)], names)

    edited = both.mapInArrow(apply, f"conv {kind}, place long, turn long, edits string, turns array<struct<role:string,text:string>>")
    return summary, edited.withColumnRenamed("conv", conv)


def digests(edited: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, audit, repaired_sha256) of edited rows as repair() leaves them: all edits of a conversation, and the digest of its
    turns as role:text, joined by newlines.  Rows are read as a stream; what stays of one is its edits and a hash state."""
    kind = edited.schema[conv].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, edits, digest, some, now = [], [], hashlib.sha256(), False, None
        for c, place, code, turns in _rows(batches, 256):
            if place == 0:
                if edits:
                    done.append((now, "".join(edits), digest.hexdigest()))
                now, edits, digest, some = c, [], hashlib.sha256(), False
            edits.append(code)
            for t in turns:
                digest.update(("\n" if some else "").encode() + f"{t['role']}:{t['text']}".encode())
                some = True
        if edits:
            done.append((now, "".join(edits), digest.hexdigest()))
        cols = list(zip(*done, strict=True)) if done else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow_type(kind)), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["conv", "audit", "repaired_sha256"])

    return edited.select(conv, "place", "edits", "turns").mapInArrow(run, f"conv {kind.simpleString()}, audit string, repaired_sha256 string").withColumnRenamed("conv", conv)


def audited(original: DataFrame, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 8192) -> DataFrame:
    """A row for every conversation of `original`: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the
    repair of `rows`; zeros, no edits and the digest of nothing where no row is left."""
    summary, edited = repair(rows, conv, turn, role, text, chunk)
    named = original.select(F.col(conv).alias("_pl_c0")).distinct()
    s = summary.withColumnRenamed(conv, "_pl_c1")
    d = digests(edited, conv).withColumnRenamed(conv, "_pl_c2")
    j = named.join(s, F.col("_pl_c0").eqNullSafe(F.col("_pl_c1")), "left").join(d, F.col("_pl_c0").eqNullSafe(F.col("_pl_c2")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return j.select(F.col("_pl_c0").alias(conv), *map(zero, SUMMARY), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
