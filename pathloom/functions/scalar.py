"""Constants and scalar functions as Column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

# The distance of unreachable vertices, and sizes in bytes of the logical memory account.
INF = 4611686018427387903
SSSP_BASE, SSSP_VERTEX = 8, 44
BOUNDED_ENTRY, ADAPTIVE_ENTRY = 8, 100
PROBATION, COOLDOWN, ECONOMIC_SOURCE, ECONOMIC_RESIDENT, RECENT_SLOT, RECENT_SLOTS = 16, 12, 44, 36, 29, 64

#: Update magnitudes: inclusive bounds of a weight change.
MAGNITUDES = {"small": (1, 3), "medium": (4, 31), "large": (32, 255)}


def sat_add(a: Column, b: Column) -> Column:
    """a + b, INF once either or the sum reaches INF; never overflows a long, so it is safe under ANSI mode."""
    inf = F.lit(INF)
    return F.when((a >= inf) | (b >= inf - a), inf).otherwise(a + b)


def clamp_weight(w: Column) -> Column:
    """A raw unsigned weight (decimal or string) as a long; values of INF and more act alike."""
    return F.least(w.cast("decimal(20,0)"), F.lit(INF).cast("decimal(20,0)")).cast("long")


def unsigned(text: Column, bits: int = 64, strict: bool = True) -> Column:
    """A whole number of digits only, below 2^bits, as decimal(20, 0); anything else, as a sign, a blank or no digit, is an error, or
    null if not strict.  Null stays null."""
    number = F.when(text.rlike(r"\A0*[0-9]{1,20}\z"), F.regexp_replace(text, r"\A0+(?=[0-9])", "")).try_cast("decimal(20,0)")
    good = F.when(number < F.lit(1 << bits).cast("decimal(20,0)"), number) if bits < 64 else F.when(number <= F.lit("18446744073709551615").cast("decimal(20,0)"), number)
    if not strict:
        return good
    return F.when(text.isNotNull() & good.isNull(), F.raise_error(F.concat(F.lit("not a number of at most "), F.lit(str(bits)), F.lit(" bits: "), text)).cast("decimal(20,0)")).otherwise(good)


def accounted(count: Column, each: int, more: int = 0, strict: bool = True) -> Column:
    """count * each + more bytes.  What doesn't fit a long is an error, or null if not strict."""
    product = F.try_multiply(count.cast("long"), F.lit(each).cast("long"))
    total = F.try_add(product, F.lit(more).cast("long"))
    wrong = count.isNotNull() & (total.isNull() | (count < 0))
    return F.when(wrong, F.raise_error(F.lit("the byte account overflows")).cast("long") if strict else F.lit(None).cast("long")).otherwise(total)


def state_bytes(vertices: Column | int) -> Column:
    """Logical bytes of one resident distance table."""
    return (F.lit(vertices) if isinstance(vertices, int) else vertices) * SSSP_VERTEX + SSSP_BASE


def metadata_bytes(probation: Column, cooldown: Column, sources: Column, residents: Column) -> Column:
    """Logical bytes of policy records."""
    return probation * PROBATION + cooldown * COOLDOWN + sources * ECONOMIC_SOURCE + residents * ECONOMIC_RESIDENT


def resident_score(hits: Column, age: Column, debt: Column, penalty: float = 4.0) -> Column:
    return hits / (1 + age + penalty * debt)


def _expected_uses(gap: Column, horizon: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(horizon)), horizon / F.greatest(F.lit(1.0), gap)))


def candidate_value(gap: Column, cold: Column, build: Column, maintenance: Column, update_rate: Column, horizon: float = 16.0) -> Column:
    """What keeping a source is worth over the horizon: saved cold cost less the build and the upkeep."""
    return _expected_uses(gap, horizon) * cold - build - horizon * update_rate * maintenance


def resident_value(gap: Column, age: Column, cold: Column, maintenance: Column, update_rate: Column, horizon: float = 16.0) -> Column:
    """What a resident is still worth; long unused ones count as rarely used."""
    return _expected_uses(F.greatest(gap, age), horizon) * cold - horizon * update_rate * maintenance


def first_build(cold: Column, arcs: Column, scans: Column) -> Column:
    """The build cost assumed before any build was measured."""
    return cold * F.greatest(F.lit(1.0), F.least(F.lit(64.0), arcs / F.greatest(F.lit(1.0), scans)))


def magnitude_of(delta: Column) -> Column:
    """The name of the magnitude whose bounds hold an absolute change; null outside all."""
    out = F.lit(None).cast("string")
    for name, (low, high) in MAGNITUDES.items():
        out = F.when(F.abs(delta).between(low, high), F.lit(name)).otherwise(out)
    return out


def phase_class(ratio: Column) -> Column:
    return F.when(ratio >= 1.10, "superior").when(ratio <= 0.90, "inferior").otherwise("parity")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def ewma(values: Column, alpha: float) -> Column:
    """Fold of an ordered array: the first sample (or one after a mean of exactly 0) replaces, later ones are smoothed."""
    return F.aggregate(values, F.lit(0.0), lambda m, x: F.when(m == 0.0, x.cast("double")).otherwise((1 - alpha) * m + alpha * x))


def zipf_weight(rank: Column) -> Column:
    """Integer Zipf weight of a rank from 1."""
    return F.floor(F.lit(1_000_000) / rank).cast("long")


def splitmix64(x: np.ndarray) -> np.ndarray:
    """The published SplitMix64 finaliser, on uint64 arrays (modular products don't exist in ANSI SQL)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def nearest_rank(values: list[float], p: float) -> float:
    """The value at rank ceil(p n) of a sorted copy; 0 for none."""
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)] if values else 0
