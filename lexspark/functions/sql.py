"""The engine's functions under SQL names, for ``spark.sql``.

Distances and array functions are SQL functions whose bodies Catalyst inlines. Match, rank and vector parsing take
their query as a value that may differ by row, so they run in Arrow batches with parsed queries kept.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, FloatType

from lexspark.functions import rank, tsquery
from lexspark.functions.types import TSVECTOR, parse_tsvector


@lru_cache(maxsize=1024)
def _ranker(query: str, method: int) -> rank.Ranker:
    return rank.Ranker(query, method)


@lru_cache(maxsize=1024)
def _tree(query: str):
    return tsquery.parse(query)


def _pairs(vector) -> list[tuple[str, list[int] | None]]:
    return [(x["lexeme"], None if x["pos"] is None else [int(p) for p in x["pos"]]) for x in vector]


def _holds(vector: dict[str, list[int]], node) -> bool:
    """The query on {lexeme: packed positions}."""
    from lexspark.functions.tsquery import And, Not, Or, Phrase, Term

    match node:
        case None:
            return False
        case Term(w, mask, prefix):
            found = [p for x, p in vector.items() if (x.startswith(w) if prefix else x == w)]
            return bool(found) if not mask else any(mask >> (p >> 14) & 1 for ps in found for p in ps)
        case Not(c):
            return not _holds(vector, c)
        case And(a, b):
            return _holds(vector, a) and _holds(vector, b)
        case Or(a, b):
            return _holds(vector, a) or _holds(vector, b)
        case Phrase():
            p, negated, _ = _ends(vector, node)
            return bool(p) or negated
    raise TypeError(node)


def _ends(vector: dict[str, list[int]], node) -> tuple[set[int], bool, int]:
    """Places where a phrase may end, whether they stand for their complement, and its width."""
    from lexspark.functions.tsquery import Not, Or, Phrase, Term

    if isinstance(node, Term):
        found = [p for x, ps in vector.items() if (x.startswith(node.lexeme) if node.prefix else x == node.lexeme) for p in ps]
        return {p & 16383 for p in found if not node.mask or node.mask >> (p >> 14) & 1}, False, 0
    if isinstance(node, Not):
        p, negated, w = _ends(vector, node.child)
        return p, not negated, w
    (a, na, wa), (b, nb, wb) = _ends(vector, node.left), _ends(vector, node.right)
    if isinstance(node, Or):
        wa, wb = (wa if a or na else 0), (wb if b or nb else 0)
    width = node.distance + wa + wb if isinstance(node, Phrase) else max(wa, wb)
    move_a, move_b = (node.distance + wb, 0) if isinstance(node, Phrase) else (width - wa, width - wb)
    a, b = {x + move_a for x in a}, {x + move_b for x in b}
    if isinstance(node, Or):
        out = a & b if na and nb else a - b if na else b - a if nb else a | b
        return {x for x in out if x > 0}, na or nb, width
    out = a | b if na and nb else b - a if na else a - b if nb else a & b
    return {x for x in out if x > 0}, na and nb, width


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session; returns their names."""

    @F.pandas_udf(BooleanType())
    def ts_match(vectors: pd.Series, queries: pd.Series) -> pd.Series:
        one = lambda v, q: None if v is None or q is None else _holds({x: p or [] for x, p in _pairs(v)}, _tree(q))
        return pd.Series([one(v, q) for v, q in zip(vectors, queries)], dtype=object)

    @F.pandas_udf(FloatType())
    def ts_score(vectors: pd.Series, queries: pd.Series, methods: pd.Series) -> pd.Series:
        one = lambda v, q, m: None if v is None or q is None or pd.isna(m) else _ranker(q, int(m)).score(_pairs(v))
        return pd.Series([one(v, q, m) for v, q, m in zip(vectors, queries, methods)], dtype="float32")

    @F.pandas_udf(TSVECTOR)
    def tsvector(texts: pd.Series) -> pd.Series:
        return texts.map(parse_tsvector, na_action="ignore")

    for name, f in (("ts_match", ts_match), ("ts_score", ts_score), ("tsvector", tsvector)):
        spark.udf.register(name, f)
    endless = lambda x: f"(isnan({x}) OR abs({x}) = double('Infinity'))"
    guard = f"WHEN a IS NULL OR b IS NULL THEN NULL WHEN {endless('a')} AND {endless('b')} THEN 0D WHEN {endless('a')} OR {endless('b')} THEN double('Infinity')"
    bodies = {
        "dist(a DOUBLE, b DOUBLE)": f"CASE {guard} ELSE abs(a - b) END",
        "left_dist(a DOUBLE, b DOUBLE)": f"CASE {guard} WHEN a <= b THEN b - a ELSE double('Infinity') END",
        "right_dist(a DOUBLE, b DOUBLE)": f"CASE {guard} WHEN a > b THEN a - b ELSE double('Infinity') END",
        "time_dist(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ)": "abs(timestampdiff(MICROSECOND, b, a)) / 1e6D",
        "left_time_dist(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ)": "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a <= b THEN timestampdiff(MICROSECOND, a, b) / 1e6D ELSE double('Infinity') END",
        "right_time_dist(a TIMESTAMP_NTZ, b TIMESTAMP_NTZ)": "CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a > b THEN timestampdiff(MICROSECOND, b, a) / 1e6D ELSE double('Infinity') END",
        "score_distance(s FLOAT)": "CASE WHEN s = 0 THEN double('Infinity') ELSE double(float(1D / nullif(double(s), 0D))) END",
        "array_contains_all(a ARRAY<STRING>, b ARRAY<STRING>)": "size(array_except(b, a)) = 0",
        "array_cosine(a ARRAY<STRING>, b ARRAY<STRING>)": "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / sqrt(double(size(array_distinct(a))) * size(array_distinct(b))) END",
    }
    for head, body in bodies.items():
        kind = "BOOLEAN" if head.startswith("array_contains") else "DOUBLE"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return ["ts_match", "ts_score", "tsvector", *(h.split("(")[0] for h in bodies)]
