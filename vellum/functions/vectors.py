"""Array-column mathematics inside the JVM; computed in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import as_column

EPS = 1e-12


def doubles(v: Column | str) -> Column:
    return as_column(v).cast("array<double>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where the body's lambdas use it for every element."""
    return F.transform(F.array(value), body)[0]


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalized(v: Column) -> Column:
    """Unit length; a vector shorter than EPS is divided by EPS, so zero stays zero."""
    return let(v, lambda w: let(F.greatest(norm(w), F.lit(EPS)), lambda n: F.transform(w, lambda x: x / n)))


def signed_sqrt(v: Column) -> Column:
    return F.transform(v, lambda x: F.signum(x) * F.sqrt(F.abs(x)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def _exponentials(v: Column, temperature: float, body) -> Column:
    """``body`` of the greatest element of v and exp((v - greatest) / temperature)."""
    return let(v, lambda w: let(F.array_max(w), lambda m: let(F.transform(w, lambda x: F.exp((x - m) / temperature)), lambda e: body(w, m, e))))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """Shifted by the greatest element, so large logits don't overflow."""
    return _exponentials(v, temperature, lambda w, m, e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_softmax(v: Column, temperature: float = 1.0) -> Column:
    return _exponentials(v, temperature, lambda w, m, e: let(F.log(total(e)), lambda t: F.transform(w, lambda x: (x - m) / temperature - t)))


def rounded(v: Column, digits: int = 6) -> Column:
    return F.transform(v, lambda x: F.round(x, digits))


def fraction_below(v: Column, threshold: float) -> Column:
    """Share of elements under ``threshold``; null for an empty array."""
    return F.try_divide(F.size(F.filter(v, lambda x: x < threshold)).cast("double"), F.size(v))
