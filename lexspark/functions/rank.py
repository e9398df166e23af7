"""Cover-density ranking of token vectors.

A cover is a shortest stretch of positions that satisfies the query. Each adds to the score the more, the
heavier its words and the closer they stand; covers of the same words add less each time. The distance is 1 /
score. Queries of one word, of alternatives, and of two words have closed forms made of Spark functions; all
others go through the general search, in Arrow batches. Weights asked for by a query do not count in ranking.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.analyze import vector_length
from lexspark.functions.match import VectorSource
from lexspark.functions.tsquery import And, Node, Not, Or, Phrase, Term, as_tree, terms
from lexspark.functions.types import MAX_POSITION, let

#: Reciprocals of the weights of D, C, B and A, and the sum of 1 / k^2.
RECIPROCALS = (10.0, 5.0, 2.5, 1.0)
DAMPING = 1.64493406685
#: Bits of the normalisation mask.
BY_LOG_LENGTH, BY_LENGTH, BY_COVER_GAPS, BY_UNIQUE, BY_LOG_UNIQUE, BY_SELF = 1, 2, 4, 8, 16, 32


@dataclass(frozen=True)
class DistanceQuery:
    """A query with a normalisation mask; a null mask is 0, a null query an error."""

    query: str | None
    method: int | None = 0

    def __post_init__(self):
        if self.query is None:
            raise ValueError("NULL query value is not allowed")

    @property
    def mask(self) -> int:
        return self.method or 0


def _holds(node: Node, seen: dict[int, int], numbers: dict[int, int], with_not: bool) -> bool:
    """The query over seen operands; each is at its latest position. Without ``with_not``, negations are true."""
    match node:
        case Term():
            return numbers[id(node)] in seen
        case Not(child):
            return not _holds(child, seen, numbers, with_not) if with_not else True
        case And(left, right):
            return _holds(left, seen, numbers, with_not) and _holds(right, seen, numbers, with_not)
        case Or(left, right):
            return _holds(left, seen, numbers, with_not) or _holds(right, seen, numbers, with_not)
        case Phrase():
            p, negated, _ = _places(node, seen, numbers, with_not)
            return bool(p) or negated


def _places(node: Node, seen: dict[int, int], numbers: dict[int, int], with_not: bool) -> tuple[set[int], bool, int]:
    match node:
        case Term():
            at = seen.get(numbers[id(node)])
            return ({at} if at is not None else set()), False, 0
        case Not(child):
            if not with_not:
                return set(), True, 0
            p, negated, w = _places(child, seen, numbers, with_not)
            return p, not negated, w
        case Phrase(left, right) | And(left, right) | Or(left, right):
            (a, na, wa), (b, nb, wb) = _places(left, seen, numbers, with_not), _places(right, seen, numbers, with_not)
            if isinstance(node, Or):
                wa, wb = (wa if a or na else 0), (wb if b or nb else 0)
            if isinstance(node, Phrase):
                move_a, move_b, width = node.distance + wb, 0, node.distance + wa + wb
            else:
                width = max(wa, wb)
                move_a, move_b = width - wa, width - wb
            a, b = {x + move_a for x in a}, {x + move_b for x in b}
            if isinstance(node, Or):
                p = a | b if not na and not nb else a - b if na and not nb else b - a if nb and not na else a & b
                return {x for x in p if x > 0}, na or nb, width
            p = a & b if not na and not nb else b - a if na and not nb else a - b if nb and not na else a | b
            return {x for x in p if x > 0}, na and nb, width


class Ranker:
    """Scores vectors (lists of (lexeme, packed positions)) for one query."""

    def __init__(self, query: str | Node | None, method: int = 0):
        self.node, self.method = as_tree(query), method
        self.operands = list(terms(self.node)) if self.node is not None else []
        self.numbers = {id(t): i for i, t in enumerate(self.operands)}
        #: The operands of different words in order, each with all that ask for its word.
        words: dict[str, Term] = {}
        for t in self.operands:
            words.setdefault(t.lexeme, t)
        self.asked = [(t, tuple(i for i, x in enumerate(self.operands) if x.lexeme == w)) for w, t in words.items()]
        self.ends, self.begins = self._test(False), self._test(True)

    def _test(self, with_not: bool):
        """``_holds`` as one Python expression over the latest position of each operand (0: not seen)."""
        hard: list[Node] = []

        def text(node: Node) -> str:
            match node:
                case Term():
                    return f"s[{self.numbers[id(node)]}]"
                case Not(child):
                    return f"(not {text(child)})" if with_not else "True"
                case And(left, right):
                    return f"({text(left)} and {text(right)})"
                case Or(left, right):
                    return f"({text(left)} or {text(right)})"
                case Phrase(Term() as left, Term() as right, distance):
                    a, b = text(left), text(right)
                    return f"({a} and {b} and {a} + {distance} == {b})"
                case Phrase():
                    hard.append(node)
                    return f"hold({len(hard) - 1}, s)"

        def plain(node: Node, s: list[int]) -> bool:
            return _holds(node, {k: p for k, p in enumerate(s) if p}, self.numbers, with_not)

        try:
            return eval(f"lambda s: {text(self.node)}", {"hold": lambda k, s: plain(hard[k], s)})
        except (SyntaxError, MemoryError, RecursionError):  # too deep for the compiler
            return lambda s: plain(self.node, s)

    def _found(self, lexeme: str) -> list[tuple[int, tuple[int, ...]]]:
        """Which of ``asked`` a lexeme of a vector answers, with their operands."""
        return [(k, items) for k, (t, items) in enumerate(self.asked) if (lexeme.startswith(t.lexeme) if t.prefix else lexeme == t.lexeme)]

    def _covers(self, places: list[int], items: list[tuple[int, ...]]):
        at, nothing, ends, begins = 0, [0] * len(self.operands), self.ends, self.begins
        while at < len(places):
            seen, end = nothing.copy(), -1
            for i in range(at, len(places)):
                for k in items[i]:
                    seen[k] = places[i]
                if ends(seen):
                    end = i
                    break
            if end < 0:
                return
            seen, begin = nothing.copy(), -1
            for i in range(end, at - 1, -1):
                for k in items[i]:
                    seen[k] = places[i]
                if begins(seen):
                    begin = i
                    break
            if begin < 0:
                at += 1
            else:
                yield begin, end
                at = begin + 1

    def _sums(self, places: list[int], lexemes: list, items: list[tuple[int, ...]], weights: list[int]) -> tuple[float, float, int]:
        """The plain score, the sum of reciprocal gaps, and the number of covers, of entries in order of their places (over 0)."""
        total, seen_keys, gaps, previous, n_covers = 0.0, {}, 0.0, 0.0, 0
        for begin, end in self._covers(places, items):
            n = end + 1 - begin
            key = tuple(lexemes[begin : end + 1])
            weight = n / sum([RECIPROCALS[w] for w in weights[begin : end + 1]]) * len(set().union(*items[begin : end + 1]))
            first, last = places[begin], places[end]
            noise = (last - first) - (n - 1)
            if noise < 0:
                noise = (n - 1) // 2  # whole places only
            seen_keys[key] = k = seen_keys.get(key, 0) + 1
            total += weight / (1 + noise) / k**2 / DAMPING
            middle = (first + last) / 2
            if n_covers and middle > previous:
                gaps += 1 / (middle - previous)
            previous = middle
            n_covers += 1
        return total, gaps, n_covers

    def _normalised(self, sums: tuple[float, float, int], length: int, unique: int, method: int) -> float:
        total, gaps, n_covers = sums
        if method & BY_COVER_GAPS and gaps > 0:
            total /= n_covers / gaps
        if method & BY_SELF:
            total /= total + 1
        if method & BY_LOG_LENGTH:
            total /= math.log(length + 1)
        if method & BY_LENGTH:
            total /= length
        if method & BY_UNIQUE:
            total /= unique
        if method & BY_LOG_UNIQUE:
            total /= math.log2(unique + 1)
        return total

    def score(self, vector: list[tuple[str, list[int] | None]]) -> float:
        if self.node is None or not vector:
            return 0.0
        found = [(p & MAX_POSITION, k, i, p >> 14, lexeme, items) for i, (lexeme, packed) in enumerate(vector) for k, items in self._found(lexeme) for p in packed or ()]
        found = sorted((e for e in found if e[0] > 0), key=lambda e: e[:3])
        sums = self._sums([e[0] for e in found], [e[4] for e in found], [e[5] for e in found], [e[3] for e in found])
        return self._normalised(sums, sum(max(1, len(p or ())) for _, p in vector), len(vector), self.method)

    def batch(self, vectors: pa.ListArray, methods: list[int]) -> list[list[float] | None]:
        """The scores of a batch of vectors by each method; a vector's covers are sought once."""
        ends = vectors.offsets.to_numpy().astype(np.int64)
        flat = vectors.values.slice(ends[0], ends[-1] - ends[0])
        ends = ends - ends[0]
        coded, pos = flat.field("lexeme").dictionary_encode(), flat.field("pos")
        sizes = pc.fill_null(pc.list_value_length(pos), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        codes, row = coded.indices.to_numpy(), np.repeat(np.arange(len(vectors)), np.diff(ends))
        packed, item = pos.flatten().to_numpy(), np.repeat(np.arange(len(sizes)), sizes)
        length = np.bincount(row, np.maximum(sizes, 1), len(vectors)).astype(np.int64).tolist()
        # an entry for each position of a lexeme and each operand that it answers
        answers = [self._found(x) for x in coded.dictionary.to_pylist()]
        parts = []
        for k, (_, _items) in enumerate(self.asked):
            hit = np.array([any(k == a for a, _ in x) for x in answers], bool)
            at = np.flatnonzero(hit[codes[item]] & (packed & MAX_POSITION > 0)) if len(packed) else np.empty(0, np.int64)
            parts.append(np.stack([row[item[at]], packed[at] & MAX_POSITION, np.full(len(at), k), item[at], packed[at] >> 14, codes[item[at]]]))
        entries = np.concatenate(parts, axis=1)
        entries = entries[:, np.lexsort(entries[3::-1])]
        starts = np.searchsorted(entries[0], np.arange(len(vectors) + 1)).tolist()
        places, kinds, weights, lexemes = (entries[i].tolist() for i in (1, 2, 4, 5))
        items = [self.asked[k][1] for k in kinds]
        out: list[list[float] | None] = []
        for i, (n, missing) in enumerate(zip(np.diff(ends).tolist(), vectors.is_null().to_pylist())):
            a, b = starts[i], starts[i + 1]
            sums = self._sums(places[a:b], lexemes[a:b], items[a:b], weights[a:b]) if n else None
            out.append(None if missing else [self._normalised(sums, length[i], n, m) if sums else 0.0 for m in methods])
        return out


def _hits(vector: Column, term: Term) -> Column:
    """Packed positions of an operand, by place."""
    found = F.filter(VectorSource(vector).positions(term), lambda p: p.bitwiseAND(MAX_POSITION) > 0)
    return F.array_sort(found, lambda a, b: (a.bitwiseAND(MAX_POSITION) - b.bitwiseAND(MAX_POSITION)).cast("int"))


def _reciprocal(p: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in RECIPROCALS]), F.shiftright(p, 14) + 1)


def _one_word(vector: Column, term: Term) -> Column:
    parts = F.transform(_hits(vector, term), lambda p, k: F.lit(1.0) / _reciprocal(p) / ((k + 1) * (k + 1)) / DAMPING)
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _two_words(vector: Column, one: Term, two: Term) -> Column:
    """Covers of two different words: neighbours in the merged positions that are not the same word."""
    tagged = lambda term, who: F.transform(_hits(vector, term), lambda p: F.struct(p.bitwiseAND(MAX_POSITION).alias("at"), F.lit(who).alias("who"), _reciprocal(p).alias("r")))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("k01"), F.lit(0).alias("k10"), F.lit(0).alias("at"), F.lit(-1).alias("who"), F.lit(0.0).alias("r"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["who"] >= 0) & (acc["who"] != x["who"])
        k01, k10 = acc["k01"] + F.when(new & (acc["who"] == 0), 1).otherwise(0), acc["k10"] + F.when(new & (acc["who"] == 1), 1).otherwise(0)
        k = F.when(acc["who"] == 0, k01).otherwise(k10).cast("double")
        gap = (x["at"] - acc["at"]).cast("double")
        noise = F.greatest(gap - 1, F.lit(0.0))  # both at one place: half of one, in whole places
        gain = F.lit(4.0) / (acc["r"] + x["r"]) / (1 + noise) / F.when(new, k * k).otherwise(1.0) / DAMPING
        return F.struct((acc["sum"] + F.when(new, gain).otherwise(0.0)).alias("sum"), k01.alias("k01"), k10.alias("k10"), x["at"].alias("at"), x["who"].alias("who"), x["r"].alias("r"))

    return F.aggregate(F.array_sort(F.concat(tagged(one, 0), tagged(two, 1))), start, step, lambda acc: acc["sum"])


def _closed(vector: Column, node: Node | None) -> Column | None:
    """The score's closed form, where there is one."""
    match node:
        case Term(_, _, False):
            return _one_word(vector, node)
        case And(Term(a, _, False) as one, Term(b, _, False) as two) if a != b:
            return _two_words(vector, one, two)
        case Or():
            operands = list(terms(node))
            plain = lambda n: isinstance(n, Term) and not n.prefix or isinstance(n, Or) and plain(n.left) and plain(n.right)
            if plain(node) and len({t.lexeme for t in operands}) == len(operands):
                total = _one_word(vector, operands[0])
                for t in operands[1:]:
                    total = total + _one_word(vector, t)
                return total
    return None


def _general(vector: Column, node: Node, methods: list[int]) -> Column:
    """The scores by the general search, over batches, one for each method; the query travels with the function."""

    def run(vectors: pa.Array) -> pa.Array:
        return pa.array(Ranker(node).batch(vectors, methods), pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(vector)


def ts_scores(vector: Column | str, query: str | Node, methods: list[int]) -> Column:
    """The rank by the general search for several masks at once, as an array."""
    node = as_tree(query)
    return _general(F.col(vector) if isinstance(vector, str) else vector, node, methods)


def ts_score(vector: Column | str, query: str | Node | DistanceQuery | None, method: int = 0, general: bool = False) -> Column:
    """The rank of ``vector`` for ``query`` (float, 0 without a cover). ``general`` skips the closed forms."""
    v = F.col(vector) if isinstance(vector, str) else vector
    if isinstance(query, DistanceQuery):
        query, method = query.query, query.mask
    if query is None or method is None:
        return F.lit(None).cast("float")
    node = as_tree(query)
    score = None if general or method & BY_COVER_GAPS else _closed(v, node)
    if score is None:
        return _general(v, node, [method])[0] if node is not None else F.when(v.isNotNull(), F.lit(0.0)).cast("float")
    if method & BY_SELF:
        score = score / (score + 1)
    length, unique = vector_length(v).cast("double"), F.size(v).cast("double")
    for bit, by in ((BY_LOG_LENGTH, F.log(length + 1)), (BY_LENGTH, length), (BY_UNIQUE, unique), (BY_LOG_UNIQUE, F.log2(unique + 1))):
        if method & bit:
            score = F.when(unique > 0, score / F.when(by > 0, by)).otherwise(0.0)
    return F.when(v.isNotNull(), score).cast("float")


def ts_distance(vector: Column | str, query: str | Node | DistanceQuery | None, method: int = 0, general: bool = False) -> Column:
    """1 / score (float), Infinity without a cover."""
    score = ts_score(vector, query, method, general)
    return let(score, lambda s: F.when(s == 0, F.lit(float("inf"))).otherwise((F.lit(1.0) / F.when(s != 0, s.cast("double")))).cast("float"))
