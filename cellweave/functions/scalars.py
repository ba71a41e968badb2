"""Scalar expressions with IEEE semantics and hashes any SQL engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647


def rounded(col: Column, digits: int = 6) -> Column:
    """Round for display and comparison; adding zero turns -0.0 into 0.0."""
    return F.round(col, digits) + F.lit(0.0)


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b with x/0 = ±Inf and 0/0 = NaN; ANSI mode would raise."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return (
        F.when(b != 0, a / F.when(b != 0, b))
        .when((a == 0) | F.isnan(a), nan)
        .when(a > 0, inf)
        .otherwise(-inf)
    )


def above(a: Column, b: Column) -> Column:
    """a > b, false when either side is NaN."""
    return (a > b) & ~F.isnan(a) & ~F.isnan(b)


def is_finite(a: Column) -> Column:
    return a.isNotNull() & ~F.isnan(a) & (F.abs(a) != F.lit(float("inf")))


def is_inf(a: Column) -> Column:
    return F.abs(a) == F.lit(float("inf"))


def portable_hash_sql(key: str, seed: int) -> str:
    """Integer hash in [0, 2**31-1) from a non-negative long, same text in every SQL engine.

    The square makes splits with different seeds independent of each other.
    """
    v = f"((({key}) % {MODULUS} + {(seed * 1013904223) % MODULUS}) % {MODULUS})"
    return f"((({v} * {v}) % {MODULUS} * 48271 + {v}) % {MODULUS})"


def portable_hash(key: str, seed: int) -> Column:
    return F.expr(portable_hash_sql(f"`{key}`", seed))


def fraction_limit(fraction: float) -> int:
    """Hashes below this make up ``fraction`` of all."""
    return round(fraction * MODULUS)


def in_fraction(key: str, seed: int, fraction: float) -> Column:
    """Membership of a seeded random part that holds ``fraction`` of all rows."""
    return portable_hash(key, seed) < F.lit(fraction_limit(fraction))


def uniform01(key: str, seed: int) -> Column:
    return portable_hash(key, seed).cast("double") / F.lit(float(MODULUS))


def rename_wild_type(name: Column) -> Column:
    """Names that start with ``wt`` have every ``wt`` replaced by ``mock``."""
    return F.when(name.startswith("wt"), F.replace(name, F.lit("wt"), F.lit("mock"))).otherwise(name)


def label_of(code: Column, labels: dict[int, str]) -> Column:
    """Code → text through a literal map; unknown codes give NULL."""
    entries = [F.lit(x) for pair in labels.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), code)


# Shapes that turn a distance relative to a spread into a bounded, outlier-robust distance.
def upside_down_gaussian(d: Column, mad: Column, sharpness: float) -> Column:
    return F.lit(1.0) - F.exp(-F.pow(ieee_divide(d, mad), F.lit(float(sharpness))))


def reverse_exponential(d: Column, mad: Column, sharpness: float) -> Column:
    return F.lit(1.0) - F.exp(-F.lit(float(sharpness)) * ieee_divide(d, mad))


def fermi_dirac(d: Column, mad: Column, sharpness: float) -> Column:
    width = mad / F.lit(float(sharpness))
    return F.lit(1.0) - F.lit(1.0) / (F.exp(ieee_divide(d - mad, width)) + F.lit(1.0))
