"""Distances of scalars and times: nearest on both sides, on the left only, on the right only.

Null arguments give null. If both sides are infinite (or NaN) the distance is 0, if one is, it is Infinity. A left
distance at equality is 0, a right distance at equality is Infinity.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
#: Types with distances, and how a value becomes a number: ``money`` counts cents, times count seconds.
KINDS = ("int2", "int4", "int8", "float4", "float8", "money", "oid", "timestamp", "timestamptz")


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _gap(a: Column, b: Column, kind: str) -> Column:
    """``a - b`` as a double."""
    if kind in ("timestamp", "timestamptz"):
        return F.timestamp_diff("MICROSECOND", b, a) / F.lit(1e6)
    if kind == "money":
        cents = lambda x: F.round(x.cast("decimal(38,2)") * 100).cast("double")
        return cents(a) - cents(b)
    return a.cast("double") - b.cast("double")


def _endless(x: Column, kind: str) -> Column:
    if kind not in ("float4", "float8"):
        return F.lit(False)
    d = x.cast("double")
    return F.isnan(d) | (F.abs(d) == INF)


def _guarded(a: Column, b: Column, kind: str, finite: Column) -> Column:
    ends_a, ends_b = _endless(a, kind), _endless(b, kind)
    out = F.when(ends_a & ends_b, 0.0).when(ends_a | ends_b, INF).otherwise(finite) if kind in ("float4", "float8") else finite
    return F.when(a.isNotNull() & b.isNotNull(), out)


def _checked(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"type {kind} doesn't support ordering")
    return kind


def dist(a, b, kind: str = "float8") -> Column:
    """``a <=> b``: how far apart they are."""
    a, b = _col(a), _col(b)
    return _guarded(a, b, _checked(kind), F.abs(_gap(a, b, kind)))


def left_dist(a, b, kind: str = "float8") -> Column:
    """``a <=| b``: how far ``a`` is below ``b``; Infinity above it."""
    a, b = _col(a), _col(b)
    gap = _gap(b, a, _checked(kind))
    return _guarded(a, b, kind, F.when(a <= b, gap).otherwise(INF))


def right_dist(a, b, kind: str = "float8") -> Column:
    """``a |=> b``: how far ``a`` is above ``b``; Infinity at or below it."""
    a, b = _col(a), _col(b)
    gap = _gap(a, b, _checked(kind))
    return _guarded(a, b, kind, F.when(a > b, gap).otherwise(INF))


DISTANCES = {"<=>": dist, "<=|": left_dist, "|=>": right_dist}


def attached_distance(a, b, kind: str, op: str = "<=>") -> Column:
    """A distance as used for ordering by an attached value: a missing one is infinitely far."""
    return F.coalesce(DISTANCES[op](a, b, kind), F.lit(INF))
