"""Numbers as Column functions: half-up rounding, safe division and casts, bands, vector similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantise(x: Column, digits: int = 4) -> Column:
    """x rounded half up on its double value; engines' own rounding differs on ties."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def quantise_any(x: Column, digits: int = 4) -> Column:
    """x as quantise has it, also where it is infinite, no number, or too large for whole numbers of 64 bits."""
    scale = float(10**digits)
    held = x * scale + 0.5
    return F.when(F.abs(held) < 2.0**62, F.floor(held).cast("double")).otherwise(held) / scale


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is null or 0."""
    return F.when(b != 0, a.cast("double") / b)


def quotient(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE has it: by 0 infinite, by the sign of both, of 0 no number."""
    same = (a > 0) == (b.cast("string") != "-0.0")
    over = F.when(F.isnan(a) | (a == 0), float("nan")).when(same, float("inf")).when(a.isNotNull(), float("-inf"))
    return F.when(b == 0, over).otherwise(a.cast("double") / F.nullif(b, F.lit(0.0)))


def safe_double(x: Column) -> Column:
    return x.try_cast("double")


def bands(x: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """The label of the first step that x is below; null for null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for below, label in steps:
        out = out.when(x < below, label)
    return out.otherwise(otherwise)


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two vectors in order, in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where sizes differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / F.nullif(norms, F.lit(0.0))).otherwise(0.0)


def year_over_year(last: Column, before: Column) -> Column:
    """Change in percent of |before|; null where before is null or 0."""
    return F.when(before != 0, quantise((last - before) / F.abs(before) * 100, 4))
