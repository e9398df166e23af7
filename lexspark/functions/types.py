"""Data types of the engine and parsers for their text forms.

A token vector is ``array<struct<lexeme: string, pos: array<int>>>``: sorted unique lexemes, each with sorted
packed positions ``weight << 14 | position`` (weights D, C, B, A are 0 to 3), or a null ``pos`` where a
vector has no positions. A stored query is its text; parsed queries are trees (see ``tsquery``).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_POSITION = (1 << 14) - 1
#: Weight letters in the order of their numbers.
WEIGHTS = "DCBA"

TSVECTOR = T.ArrayType(T.StructType([T.StructField("lexeme", T.StringType()), T.StructField("pos", T.ArrayType(T.IntegerType()))]))
TSVECTOR_DDL = "array<struct<lexeme:string,pos:array<int>>>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def pack(position: int, weight: str = "D") -> int:
    return WEIGHTS.index(weight.upper()) << 14 | min(position, MAX_POSITION)


def _word(text: str, at: int, stop: str) -> tuple[str, int]:
    """A bare or quoted word from ``at``; bare ones end at white space or a character of ``stop``."""
    out = []
    if text[at] == "'":
        at += 1
        while True:
            if at >= len(text):
                raise ValueError(f"unterminated quote in {text!r}")
            if text[at] == "\\" and at + 1 < len(text):
                out.append(text[at + 1])
                at += 2
            elif text[at] == "'":
                if text[at + 1 : at + 2] != "'":
                    return "".join(out), at + 1
                out.append("'")
                at += 2
            else:
                out.append(text[at])
                at += 1
    while at < len(text) and not text[at].isspace() and text[at] not in stop:
        if text[at] == "\\" and at + 1 < len(text):
            at += 1
        out.append(text[at])
        at += 1
    return "".join(out), at


def parse_tsvector(text: str | None) -> list[dict] | None:
    """The token vector of a literal such as ``fat:2,4A cat``; equal lexemes are merged."""
    if text is None:
        return None
    found: dict[str, set[int]] = {}
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        lexeme, at = _word(text, at, ":")
        positions = found.setdefault(lexeme, set())
        while at < len(text) and text[at] in ":,":
            end = at + 1
            while end < len(text) and text[end].isdigit():
                end += 1
            number = int(text[at + 1 : end])
            weight = text[end : end + 1].upper()
            if weight and weight in WEIGHTS:
                end += 1
            else:
                weight = "D"
            positions.add(pack(number, weight))
            at = end
    by_place = lambda p: (p & MAX_POSITION, -(p >> 14))
    return [{"lexeme": w, "pos": sorted(p, key=by_place) or None} for w, p in sorted(found.items(), key=lambda x: x[0].encode())]


def render_positions(pos: Iterable[int] | None) -> str | None:
    """Positions as text, ``1,5A,9C``: the letter of the default weight is left out."""
    return None if pos is None else ",".join(f"{p & MAX_POSITION}{WEIGHTS[p >> 14] if p >> 14 else ''}" for p in pos)


def positions_text(pos: Column) -> Column:
    """The same for a column of packed positions."""
    name = lambda p: F.element_at(F.array(F.lit(""), F.lit("C"), F.lit("B"), F.lit("A")), F.shiftright(p, 14) + 1)
    return F.array_join(F.transform(pos, lambda p: F.concat(p.bitwiseAND(MAX_POSITION).cast("string"), name(p))), ",")


def parse_array(text: str | None, cast=int) -> list | None:
    """The elements of a literal such as ``{1,2,3}``; nested braces and NULL elements are errors."""
    if text is None:
        return None
    body = text.strip()
    if not (body.startswith("{") and body.endswith("}")):
        raise ValueError(f"malformed array {text!r}")
    if "{" in body[1:]:
        raise ValueError("array must have 1 dimension")
    items = [x.strip().strip('"') for x in body[1:-1].split(",")] if body[1:-1].strip() else []
    if any(x.upper() == "NULL" for x in items):
        raise ValueError("array must not contain nulls")
    return [cast(x) for x in items]
