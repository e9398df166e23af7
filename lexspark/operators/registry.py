"""Classes of indexable columns: what is stored as key, what is attached, and which operators apply."""

from __future__ import annotations

from dataclasses import dataclass, field

from lexspark.functions import distance, scalar

RANGE = ("<", "<=", "=", ">=", ">")
KNN = ("<=>", "<=|", "|=>")
#: Categories of posting rows: an ordinary key, and placeholders for null keys, empty values and null values.
CATEGORIES = {0: "NORM_KEY", 1: "NULL_KEY", 2: "EMPTY_ITEM", 3: "NULL_ITEM", -1: "EMPTY_QUERY"}
NORM_KEY, NULL_KEY, EMPTY_ITEM, NULL_ITEM = 0, 1, 2, 3


@dataclass(frozen=True)
class IndexClass:
    """One kind of column. ``family`` says how keys are made; ``attaches`` whether another column's value is stored."""

    name: str
    family: str  # vector, query, array, scalar
    key: str
    addinfo: str | None
    match: tuple[str, ...]
    order: tuple[str, ...] = ()
    hashed: bool = False
    attaches: bool = False
    prefix: bool = False
    natural_order: tuple[str, ...] = field(default=())


def _classes() -> dict[str, IndexClass]:
    out = [
        IndexClass("tsvector", "vector", "string", "positions", ("@@",), ("<=>",), prefix=True),
        IndexClass("tsvector_hash", "vector", "bigint", "positions", ("@@",), ("<=>",), hashed=True),
        IndexClass("tsvector_addon", "vector", "string", "attached", ("@@",), KNN, attaches=True, prefix=True),
        IndexClass("tsvector_hash_addon", "vector", "bigint", "attached", ("@@",), KNN, hashed=True, attaches=True),
        IndexClass("tsquery", "query", "string", "path", ("@@",)),
        IndexClass("anyarray", "array", "element", "length", ("&&", "@>", "<@", "=", "%"), ("<=>",)),
        IndexClass("anyarray_addon", "array", "element", "attached", ("&&", "@>", "<@", "="), KNN, attaches=True),
    ]
    for time in ("timestamp", "timestamptz"):  # older names of the addon classes with an attached time
        out += [
            IndexClass(f"tsvector_{time}", "vector", "string", "attached", ("@@",), KNN, attaches=True, prefix=True),
            IndexClass(f"tsvector_hash_{time}", "vector", "bigint", "attached", ("@@",), KNN, hashed=True, attaches=True),
        ]
    for kind, spark_type in scalar.TYPES.items():
        knn = KNN if kind in distance.KINDS else ()
        out.append(IndexClass(kind, "scalar", spark_type, None, RANGE, knn, natural_order=knn[1:]))
    return {c.name: c for c in out}


CLASSES = _classes()


def validate(c: IndexClass) -> list[str]:
    """What is wrong with a class; empty for a sound one."""
    wrong = []
    if c.family not in ("vector", "query", "array", "scalar"):
        wrong.append(f"unknown family {c.family}")
    allowed = {"vector": {"@@"}, "query": {"@@"}, "array": {"&&", "@>", "<@", "=", "%"}, "scalar": set(RANGE)}.get(c.family, set())
    wrong += [f"operator {op} does not fit {c.family}" for op in c.match if op not in allowed]
    if not c.match:
        wrong.append("no match operator")
    wrong += [f"unknown ordering {op}" for op in c.order if op not in KNN]
    if c.hashed and c.prefix:
        wrong.append("hashed keys have no prefixes")
    if c.attaches != (c.addinfo == "attached"):
        wrong.append("attached value and addinfo disagree")
    if c.family == "scalar" and c.order and c.name not in distance.KINDS:
        wrong.append(f"{c.name} has no distance")
    return wrong


def properties(name: str) -> dict[str, bool]:
    """What a class can do."""
    c = CLASSES[name]
    return {
        "distance_orderable": bool(c.order), "orderable": False, "returnable": True, "search_array": False, "search_nulls": False, "can_multi_col": True,
        "can_unique": False, "can_exclude": True, "clusterable": False, "backward_scan": False, "bitmap_scan": True, "prefix_match": c.prefix,
    }
