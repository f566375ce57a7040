"""Quality rules whose cutoffs are risk-controlled on labelled holdouts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from .common import bounded, byte_texts, give_back, materialise

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_STRUCT = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    v = len(known)
    code = ids[:-2] * v + ids[1:-1]
    if v >= 1 << 21:  # three ids would not fit 63 bits
        code = np.unique(code, return_inverse=True)[1]
    code = code * v + ids[2:]
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not twice.size:
        return 0
    twice = twice[np.r_[True, twice[1:] != twice[:-1]]]
    at = np.searchsorted(twice, code)
    rep = twice[np.minimum(at, len(twice) - 1)] == code
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= rep
    return int(cover.sum())


def text_counts(text: bytes) -> tuple[int, ...]:
    """The counts of COUNTS for one whole text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.decode()) - (len(text) - sum(map(len, words)))
    return len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), _repeat_words(words), len(lines)


def _counts(texts: pa.Array) -> pa.Array:
    rows = [text_counts(t) for at in range(0, len(texts), 256) for t in byte_texts(texts.slice(at, 256))]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(COUNTS)
    give_back()
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], list(COUNTS))


def counts(text: Column) -> Column:
    """A struct of COUNTS of a text; null text: all zero."""
    return arrow_udf(_counts, _STRUCT)(text)


#: name: (score of a struct column c, larger is worse; its cutoffs at each joint step, mildest first).
RULES = {
    "symbols": (lambda c: c["n_symbols"] / F.greatest(c["word_chars"], F.lit(1)), [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04]),
    "repeats": (lambda c: c["n_repeat_words"] / F.greatest(c["n_words"], F.lit(1)), [0.48, 0.44, 0.4, 0.36, 0.32, 0.28, 0.24, 0.2, 0.16, 0.14, 0.12, 0.1]),
    "lines": (lambda c: c["n_dup_lines"] / F.greatest(c["n_lines"], F.lit(1)), [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1]),
    "word_length": (lambda c: F.abs(c["word_chars"] / F.greatest(c["n_words"], F.lit(1)) - 6.5), [30.0, 20.0, 15.0, 12.0, 10.0, 8.0, 7.0, 6.0, 5.0, 4.5, 4.0, 3.5]),
}
STEPS = len(RULES["symbols"][1])


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), exactly summed in logarithms: the level at which a rate of p or more is refuted."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def over(c: Column, step: Column | int) -> Column:
    """Whether any rule's score of counts c exceeds its cutoff at a step; false where the step is null."""
    at = F.lit(step) if isinstance(step, int) else step
    one = [F.coalesce(score(c) > F.get(F.array(*map(F.lit, grid)), at), F.lit(False)) for score, grid in RULES.values()]
    return reduce(lambda a, b: a | b, one)


def cutoffs(good: DataFrame, strata: Column, risk: float = 0.04, delta: float = 0.05, counted: str = "_pl_c") -> DataFrame:
    """(stratum, step) from labelled good documents: the strictest safe joint step of all rules, null where none is safe.

    The steps are one fixed sequence: at each, all rules together reject no fewer documents than at the one before.  They
    are tried from the mildest on while the exact binomial test refutes a false rejection of more than `risk` at the level
    delta / #strata.  A fixed sequence needs no share for its steps, and one for all rules none for the rules; the strata
    share delta (Bonferroni).  So with probability 1 - delta no stratum loses more than `risk` of its good documents to
    the rules.  log(delta / #strata) / log(1 - risk) labels without a rejection are the fewest that allow a step: 108 with
    four strata.  Rejections are counted by partial sums, one row a stratum; an empty table has no strata.
    """
    per = good.groupBy(strata.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(over(F.col(counted), i).cast("long")) for i in range(STEPS)]).alias("k"))
    level = delta / max(1, per.count())

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [next((i for i, x in enumerate(k) if binomial_tail(x, n, risk) > level), STEPS) - 1 for n, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x if x >= 0 else None for x in best], pa.int32())], ["stratum", "step"])

    kind = per.schema["stratum"].dataType.simpleString()
    return per.mapInArrow(choose, f"stratum {kind}, step int")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, _pl_c): the counts of every document without its text, computed once."""
    return materialise(bounded(docs).select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), counts(F.col(text_col)).alias("_pl_c")), "quality")


def _base_failed(c: Column) -> Column:
    return (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def fit(slim: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = 0.04, delta: float = 0.05) -> DataFrame:
    """Steps per stratum from measured() documents labelled 1 that pass the base.  A document labelled twice counts once;
    null ids and labels are no labels; rows that repeat a labelled id each count."""
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).alias("_pl_id")).where("_pl_id is not null").distinct()
    held = slim.where(~_base_failed(F.col("_pl_c"))).join(good, F.col("id") == F.col("_pl_id"), "left_semi")
    return materialise(cutoffs(held, F.col("stratum"), risk, delta), "quality-cutoffs")


def verdicts(rows: DataFrame, cut: DataFrame, stratum_col: str) -> DataFrame:
    """rows with counts `_pl_c`, plus `_pl_base_failed` and `_pl_kept`; every row returns once.

    Base: under 50 words, or over half of them in repeated windows.  A document that passes is rejected if a rule's score
    exceeds the cutoff at its stratum's step.  Null text has no words and fails.  A null stratum is one of its own; strata
    without enough labels and an empty labels table have no step, so only the base rejects.
    """
    cut = cut.select(F.col("stratum").alias("_pl_stratum"), F.col("step").alias("_pl_step"))
    both = rows.join(cut, F.col(stratum_col).eqNullSafe(F.col("_pl_stratum")), "left")
    failed = _base_failed(F.col("_pl_c"))
    return both.withColumn("_pl_base_failed", failed).withColumn("_pl_kept", ~failed & ~over(F.col("_pl_c"), F.col("_pl_step"))).drop("_pl_stratum", "_pl_step")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with their own columns; nulls, repeats and empty tables as in verdicts().

    Counts are worked out once and written beside the texts, of which the fit reads the counts only.
    """
    counted = materialise(bounded(docs).withColumn("_pl_c", counts(F.col(text_col))), "quality")
    cut = fit(counted.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), "_pl_c"), labels, id_col)
    return verdicts(counted, cut, stratum_col).where("_pl_kept").select(*[F.col(f"`{c}`") for c in docs.columns])
