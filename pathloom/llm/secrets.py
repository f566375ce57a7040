"""Secret scans: fixed patterns and sliding-window entropy.  DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import bind, fold_out

# The base kinds in order, their patterns, the group whose length counts, and its least length.
KINDS = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]{24,}", 0, 24),
}


@dataclass(frozen=True)
class EntropyClass:
    """Runs of `alphabet` hold a secret where a window of `window` characters has `bits` or more bits of entropy each."""

    name: str
    alphabet: str
    window: int
    bits: float


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CLASSES = (
    EntropyClass("hexcase", _DIGITS + "abcdefABCDEF", 20, 3.0),
    EntropyClass("base64", _DIGITS + _LOWER + _LOWER.upper() + "+/_-", 24, 4.0),
)

#: A run that one of these fits is known to be harmless: words and paths without digits, and documentation samples.
ALLOWED = (r"^[^0-9]*$", r"(?i)example", r"(?i)abcdefghij", r"0123456789", r"^/?([a-z0-9_-]{1,16}/)+[a-z0-9_-]{0,16}$")

#: The allowed samples that may stand anywhere in a run.
SAMPLES = ("example", "abcdefghij", "0123456789")

_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPANS})")


def _placed(items: Column, gaps: Column, span) -> Column:
    """Spans of the items with ok from the lengths of the texts between them: a match starts behind all earlier gaps and matches."""
    both = F.zip_with(items, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("gap")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = (at + x["gap"]).cast("int")
        return (start + x["m"]["size"]).cast("int"), F.when(x["m"]["ok"], F.array(span(start, x["m"]))).otherwise(_none())

    return fold_out(both, F.lit(0), _none(), step)


def base_spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """The leftmost non-overlapping matches of a pattern, without those too short."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    items = F.zip_with(whole, part, lambda w, p: F.struct(F.length(w).alias("size"), (F.length(p) >= least).alias("ok")))
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(whole))
    found = _placed(items, gaps, lambda start, x: F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["size"]).cast("int").alias("stop")))
    return F.when(text.rlike(pattern), found).otherwise(_none())


CELLS, CELL = 12, 5  # counts of five bits in a long


def hot_range(run: Column, c: EntropyClass) -> Column:
    """struct(first, last): ends of the first and last window of a run with enough entropy, null if none has.

    The counts of a window and the sum of n * log2(n) over them change by one character in and one out at each step: two
    cells of a few packed longs.  Windows are shorter than 32, so a count fits its cell.
    """
    assert c.window < 1 << CELL
    table = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(c.window + 2)])
    limit = c.window * (math.log2(c.window) - c.bits) + 1e-9
    codes = F.transform(F.split(run, ""), lambda ch: F.instr(F.lit(c.alphabet), ch) - 1)
    cell = lambda code: F.struct(F.floor(code / CELLS).cast("int").alias("word"), (code % CELLS * CELL).cast("int").alias("bit"))

    def steps_of(come: Column) -> Column:
        gone = F.concat(F.array_repeat(F.lit(-1), c.window), come)
        return F.transform(F.zip_with(come, F.slice(gone, F.lit(1), F.size(come)), lambda x, y: F.struct(x.alias("add"), y.alias("out"), cell(x).alias("up"), cell(y).alias("down"))), lambda x, i: F.struct(x.alias("x"), i.alias("i")))

    words = -(-len(c.alphabet) // CELLS)
    state = F.struct(F.array(*[F.lit(0).cast("long")] * words).alias("n"), F.lit(0.0).alias("sum"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    held = lambda n, at: F.call_function("shiftright", F.get(n, at["word"]), at["bit"]).bitwiseAND((1 << CELL) - 1)
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at["bit"])

    def step(a: Column, s: Column) -> Column:
        x, i = s["x"], s["i"]
        same, full = x["add"] == x["out"], x["out"] >= 0
        gain = bind(held(a["n"], x["up"]), lambda k: F.get(table, (k + 1).cast("int")) - F.get(table, k.cast("int")))
        loss = F.when(full, bind(held(a["n"], x["down"]), lambda k: F.get(table, (k - 1).cast("int")) - F.get(table, k.cast("int")))).otherwise(F.lit(0.0))
        n = F.when(same, a["n"]).otherwise(F.transform(a["n"], lambda v, k: v + F.when(k == x["up"]["word"], one(x["up"])).otherwise(0) - F.when(full & (k == x["down"]["word"]), one(x["down"])).otherwise(0)))

        def noted(total: Column) -> Column:
            hot = (i >= c.window - 1) & (total <= limit)
            return F.struct(n.alias("n"), total.alias("sum"), F.when(hot & a["first"].isNull(), i).otherwise(a["first"]).alias("first"), F.when(hot, i).otherwise(a["last"]).alias("last"))

        return bind(F.when(same, a["sum"]).otherwise(a["sum"] + gain + loss), noted)

    return F.aggregate(bind(codes, steps_of), state, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def entropy_spans(text: Column, kind: int, c: EntropyClass, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """Spans of the hot windows of candidate runs that no allowed pattern fits."""
    pattern = "[" + c.alphabet.replace("-", "\\-") + "]{" + str(c.window) + ",}"
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def item(r: Column) -> Column:
        known = F.lit(False)
        for p in allowed:
            known = known | r.rlike(p)
        return bind(F.when(~known, hot_range(r, c)), lambda hot: F.struct(F.length(r).alias("size"), F.coalesce(hot["first"].isNotNull(), F.lit(False)).alias("ok"), hot["first"].alias("first"), hot["last"].alias("last")))

    items = F.transform(runs, item)
    gaps = F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(runs))
    found = _placed(items, gaps, lambda start, x: F.struct((start + x["first"] - (c.window - 1)).cast("int").alias("start"), F.lit(kind).alias("kind"), (start + x["last"] + 1).cast("int").alias("stop")))
    return F.when(text.rlike(pattern), found).otherwise(_none())


def scan(text: Column, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> tuple[Column, Column]:
    """(base spans, added spans) of a text, each sorted by start, kind: code points, end exclusive; null text: none.

    An added span reaches from the first to the last hot window of a run, cooler windows between them included.  An allowed
    sample clears only the windows that overlap it: it ends a run, and what stands before and behind is judged as runs of
    its own.  A run that an allowed pattern fits whole (words and paths without digits) has no spans.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    base = F.concat(*[base_spans(t, i, *spec) for i, spec in enumerate(KINDS.values())])
    runs = t
    for x in SAMPLES:
        runs = F.regexp_replace(runs, "(?i)" + x, " " * len(x))  # as long as the sample, so places stay
    added = F.concat(*[entropy_spans(runs, len(KINDS) + i, c, allowed) for i, c in enumerate(classes)])
    return F.array_sort(base), F.array_sort(added)


def span_text(spans: Column, classes: tuple[EntropyClass, ...] = CLASSES) -> Column:
    names = F.array(*[F.lit(n) for n in [*KINDS, *("entropy_" + c.name for c in classes)]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): arrays of struct(start, kind, stop) for every row; no shuffle.

    Null and empty texts have none.  Repeated rows return a row each; other columns are not read; empty table: no rows.
    """
    base, added = scan(F.col("t"))
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).select("doc_id", base.alias("base"), added.alias("added"))
    # in order, a base span stands before what starts where it does or later: what reaches no further than one of them lies in it
    base_kinds = len(KINDS)

    def step(far: Column, s: Column) -> tuple[Column, Column]:
        is_base = s["kind"] < base_kinds
        return F.when(is_base, F.greatest(far, s["stop"])).otherwise(far), F.when(is_base | (s["stop"] > far), F.array(s)).otherwise(_none())

    return found.select("doc_id", "base", fold_out(F.array_sort(F.concat("base", "added")), F.lit(-1), _none(), step).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each union of overlapping spans replaced by a mark."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        far = F.greatest(a["at"], s["stop"])
        fresh = F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))
        return F.struct(far.alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1))))


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with secrets replaced by a mark and the length column, if there is one, following; all rows and columns stay.

    Null texts stay null, empty ones empty; repeated rows are treated alike; empty table: no rows."""
    base, added = scan(F.col("_pl_t"))
    x = docs.withColumn("_pl_t", F.col(text_col)).withColumn("_pl_spans", F.array_sort(F.concat(base, added)))
    x = x.withColumn("_pl_new", F.when(F.size("_pl_spans") == 0, F.col("_pl_t")).otherwise(redact(F.col("_pl_t"), F.col("_pl_spans"))))
    out = []
    for c, kind in docs.dtypes:
        if c == text_col:
            out.append(F.col("_pl_new").alias(c))
        elif c == length_col:
            out.append(F.when(F.size("_pl_spans") == 0, F.col(c)).otherwise(F.length("_pl_new").cast(kind)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return x.select(*out)
