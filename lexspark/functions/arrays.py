"""Set predicates, similarity and distance of arrays. Duplicates count once, except in equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIMILARITIES = ("cosine", "jaccard", "overlap")
#: Session settings that give the defaults of ``similar`` and ``array_distance``.
THRESHOLD_CONF, FUNCTION_CONF = "lexspark.array.similarity.threshold", "lexspark.array.similarity.function"


def _checked(a: Column) -> Column:
    return F.when(F.exists(a, lambda x: x.isNull()), F.raise_error(F.lit("array must not contain nulls")).cast("void")).otherwise(a)


def _pair(a, b) -> tuple[Column, Column]:
    as_column = lambda x: x if isinstance(x, Column) else F.array(*[F.lit(v) for v in x])
    return _checked(as_column(a)), _checked(as_column(b))


def overlaps(a, b) -> Column:
    """``a && b``: they share an element."""
    a, b = _pair(a, b)
    return F.arrays_overlap(a, b)


def contains(a, b) -> Column:
    """``a @> b``: every element of b is in a."""
    a, b = _pair(a, b)
    return F.size(F.array_except(b, a)) == 0


def contained(a, b) -> Column:
    """``a <@ b``: every element of a is in b."""
    return contains(b, a)


def equal(a, b) -> Column:
    """``a = b``: same elements in the same order."""
    a, b = _pair(a, b)
    return a == b


def similarity(a, b, function: str = "cosine") -> Column:
    """Cosine i / sqrt(n m), Jaccard i / (n + m - i) or overlap i, of distinct elements; null if either is empty."""
    if function not in SIMILARITIES:
        raise ValueError(f"unknown similarity {function!r}")
    a, b = _pair(a, b)
    n, m = F.size(F.array_distinct(a)).cast("double"), F.size(F.array_distinct(b)).cast("double")
    i = F.size(F.array_intersect(a, b)).cast("double")
    value = {"cosine": i / F.sqrt(n * m), "jaccard": i / (n + m - i), "overlap": i}[function]
    return F.when((n > 0) & (m > 0), value)


def similar(a, b, threshold: float = 0.5, function: str = "cosine") -> Column:
    """``a % b``: similarity of at least ``threshold``; false if either is empty."""
    if not 0 <= threshold <= 1 and function != "overlap":
        raise ValueError("threshold must be between 0 and 1")
    x, y = _pair(a, b)
    return F.when(x.isNotNull() & y.isNotNull(), F.coalesce(similarity(a, b, function) >= threshold, F.lit(False)))


def array_distance(a, b, function: str = "cosine") -> Column:
    """``a <=> b``: 1 / similarity; Infinity without a common element, 0 if either is empty."""
    x, y = _pair(a, b)
    s = similarity(a, b, function)
    return F.when(x.isNotNull() & y.isNotNull(), F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(s == 0, float("inf")).otherwise(1 / F.when(s != 0, s)))


def session_defaults(spark) -> tuple[float, str]:
    """(threshold, function) as the session sets them."""
    return float(spark.conf.get(THRESHOLD_CONF, "0.5")), spark.conf.get(FUNCTION_CONF, "cosine")
