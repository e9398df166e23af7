"""Text to tokens and token vectors, and operations on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.types import MAX_POSITION, TSVECTOR_DDL, WEIGHTS, let


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits, in order."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def vector_of_tokens(words: Column, stop: tuple[str, ...] = ()) -> Column:
    """The token vector of a token array: sorted lexemes with their places; stop words keep their place only.

    Sorts (lexeme, place) once and cuts the sorted array where the lexeme changes: linear after the sort.
    """
    placed = F.transform(words, lambda w, i: F.struct(w.alias("lexeme"), F.least(i + 1, F.lit(MAX_POSITION)).alias("p")))
    if stop:
        placed = F.filter(placed, lambda x: ~x["lexeme"].isin(*stop))

    def cut(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["lexeme"] != F.get(s, i - 1)["lexeme"]))
        return let(starts, lambda st: F.transform(st, lambda a, k: F.struct(
            F.get(s, a)["lexeme"].alias("lexeme"),
            F.array_distinct(F.transform(F.slice(s, a + 1, F.coalesce(F.get(st, k + 1), F.size(s)) - a), lambda x: x["p"])).alias("pos"),
        )))

    return F.when(words.isNotNull(), let(F.array_sort(placed), lambda s: F.when(F.size(s) > 0, cut(s)).otherwise(F.array().cast(TSVECTOR_DDL))))


def to_tsvector(text: Column | str, stop: tuple[str, ...] = ()) -> Column:
    """The token vector of a text, without stemming."""
    return vector_of_tokens(tokens(text), stop)


#: Tokens that are sorted at once in a batch; a longer document is one piece.
PIECE_TOKENS = 1 << 18
#: Bytes of a batch for Python, unless the session has a bound: a worker holds several times as much.
ARROW_BYTES, ARROW_CONF = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def _vectors(words: pa.ListArray) -> pa.ListArray:
    """The token vectors of a batch of token arrays, by one sort of (row, lexeme); places are in order as they come."""
    n, ends = len(words), words.offsets.to_numpy().astype(np.int64)
    flat, ends = words.values.slice(ends[0], ends[-1] - ends[0]), ends - ends[0]
    coded = flat.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank, kinds = np.empty(len(order), np.int64), max(1, len(order))
    rank[order] = np.arange(len(order))
    sizes = np.diff(ends)
    key = np.repeat(np.arange(n), sizes) * kinds + rank[coded.indices.to_numpy()]
    place = np.minimum(np.arange(len(key)) - np.repeat(ends[:-1], sizes) + 1, MAX_POSITION)
    by = np.argsort(key, kind="stable")
    key, place = key[by], place[by]
    first, new = np.ones(len(key), bool), np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    new[1:] = first[1:] | (place[1:] != place[:-1])
    key, place, starts = key[new], place[new], np.flatnonzero(first[new])
    pos = pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(place, pa.int32()))
    row, lexeme = np.divmod(key[starts], kinds)
    items = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(order[lexeme])), pos], ["lexeme", "pos"])
    counts = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), items, mask=words.is_null() if words.null_count else None)


def _vector_batch(words: pa.Array) -> pa.Array:
    """The same for a batch of any size, in pieces of bounded size."""
    pieces, at = [], 0
    ends = words.offsets.to_numpy()
    while at < len(words):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE_TOKENS, "right")) - 1)
        pieces.append(_vectors(words.slice(at, to - at)))
        at = to
    return pa.concat_arrays(pieces) if pieces else _vectors(words)


def table_vectors(words: Column) -> Column:
    """``vector_of_tokens`` for whole tables, in Arrow batches: the same values in a third of the time."""
    spark = SparkSession.getActiveSession()
    if spark is not None and ARROW_CONF not in spark.conf.getAll:
        spark.conf.set(ARROW_CONF, ARROW_BYTES)
    return F.arrow_udf(_vector_batch, TSVECTOR_DDL)(words)


def setweight(vector: Column, weight: str) -> Column:
    """All positions of ``vector`` with one weight (a letter A to D)."""
    w = WEIGHTS.index(weight.upper()) << 14
    return F.transform(vector, lambda x: F.struct(x["lexeme"].alias("lexeme"), F.transform(x["pos"], lambda p: p.bitwiseAND(MAX_POSITION).bitwiseOR(w)).alias("pos")))


def max_position(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0), lambda a, x: F.greatest(a, F.coalesce(F.array_max(F.transform(x["pos"], lambda p: p.bitwiseAND(MAX_POSITION))), F.lit(0))))


def concat_vectors(left: Column, right: Column) -> Column:
    """``left || right``: places of the right vector count on from the largest of the left one."""

    def merged(both: Column) -> Column:
        by = both["shift"]
        moved = F.transform(both["r"], lambda x: F.struct(x["lexeme"].alias("lexeme"), F.transform(x["pos"], lambda p: F.least(p.bitwiseAND(MAX_POSITION) + by, F.lit(MAX_POSITION)) + p.bitwiseAND(3 << 14)).alias("pos")))
        return let(F.struct(both["l"].alias("l"), moved.alias("r")), union)

    def union(both: Column) -> Column:
        names = F.array_sort(F.array_union(F.transform(both["l"], lambda x: x["lexeme"]), F.transform(both["r"], lambda x: x["lexeme"])))
        of = lambda side, name: F.flatten(F.transform(F.filter(both[side], lambda x: x["lexeme"] == name), lambda x: F.coalesce(x["pos"], F.array().cast("array<int>"))))
        return F.transform(names, lambda name: F.struct(name.alias("lexeme"), let(F.concat(of("l", name), of("r", name)), lambda p: F.when(F.size(p) > 0, p)).alias("pos")))

    return let(F.struct(left.alias("l"), right.alias("r"), max_position(left).alias("shift")), merged)


def strip(vector: Column) -> Column:
    """``vector`` without positions."""
    return F.transform(vector, lambda x: F.struct(x["lexeme"].alias("lexeme"), F.lit(None).cast("array<int>").alias("pos")))


def vector_length(vector: Column) -> Column:
    """All positions together; a lexeme without positions counts as one."""
    return F.aggregate(vector, F.lit(0), lambda a, x: a + F.greatest(F.coalesce(F.size(x["pos"]), F.lit(1)), F.lit(1)))
