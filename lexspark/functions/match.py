"""Boolean, phrase, prefix and weighted match of token vectors, compiled to Spark columns.

A query tree becomes one boolean column. Outside phrases, operands are presence tests. A phrase is
evaluated by an algebra on (positions, negated, width, maybe): positions where a match may end, whether the
set stands for its complement, how far back the match reaches, and whether positions are missing. It is
made of array functions only, so it runs inside the JVM.

``VectorSource`` reads token vectors; ``TokenSource`` reads plain token arrays (positions are array places), so
documents can be searched without building vectors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions.tsquery import And, Node, Not, Or, Phrase, Term, as_tree
from lexspark.functions.types import MAX_POSITION, let


def _none() -> Column:
    return F.array().cast("array<int>")


class VectorSource:
    """Presence and positions of operands in a column of token vectors."""

    def __init__(self, vector: Column):
        self.vector = vector

    def _named(self, term: Term):
        return (lambda x: F.startswith(x["lexeme"], F.lit(term.lexeme))) if term.prefix else (lambda x: x["lexeme"] == F.lit(term.lexeme))

    def present(self, term: Term) -> Column:
        name = self._named(term)
        if not term.mask:
            return F.exists(self.vector, name)
        allowed = lambda p: F.lit(term.mask).bitwiseAND(F.pow(F.lit(2), F.shiftright(p, 14)).cast("int")) != 0
        return F.exists(self.vector, lambda x: name(x) & F.coalesce(F.exists(x["pos"], allowed), F.lit(False)))

    def positions(self, term: Term) -> Column:
        """Packed positions of all lexemes of the operand; empty where it is absent or has none."""
        return F.flatten(F.transform(F.filter(self.vector, self._named(term)), lambda x: F.coalesce(x["pos"], _none())))

    def unplaced(self, term: Term) -> Column:
        """Whether a lexeme of the operand is present without positions."""
        name = self._named(term)
        return F.exists(self.vector, lambda x: name(x) & (F.coalesce(F.size(x["pos"]), F.lit(0)) <= 0))


class TokenSource:
    """The same over an array of tokens, all of the default weight."""

    def __init__(self, tokens: Column):
        self.tokens = tokens

    def _named(self, term: Term):
        return (lambda x: F.startswith(x, F.lit(term.lexeme))) if term.prefix else (lambda x: x == F.lit(term.lexeme))

    def present(self, term: Term) -> Column:
        if term.mask and not term.mask & 1:
            return self.tokens.isNull() & F.lit(None).cast("boolean")
        return F.exists(self.tokens, self._named(term)) if term.prefix else F.array_contains(self.tokens, term.lexeme)

    def positions(self, term: Term) -> Column:
        name = self._named(term)
        found = F.filter(F.transform(self.tokens, lambda x, i: F.when(name(x), F.least(i + 1, F.lit(MAX_POSITION)))), lambda p: p.isNotNull())
        return F.array_distinct(found)

    def unplaced(self, term: Term) -> Column:
        return F.lit(False)


class BitSource:
    """Presence of operands as bits of a number; of queries that ask for no places."""

    def __init__(self, bits: Column, operands: list[Term]):
        self.tokens, self.operands = bits, operands

    def present(self, term: Term) -> Column:
        return self.tokens.bitwiseAND(F.lit(1 << self.operands.index(term)).cast("long")) != 0


def _shift(positions: Column, by: Column) -> Column:
    return F.transform(positions, lambda p: p + by)


def _result(p: Column, negated: Column, width: Column, maybe: Column) -> Column:
    return F.struct(F.filter(p, lambda x: x > 0).alias("p"), negated.alias("n"), width.alias("w"), maybe.alias("m"))


def _failed(x: Column) -> Column:
    return (F.size(x["p"]) == 0) & ~x["n"] & ~x["m"]


def _phrase(node: Node, source) -> Column:
    """Struct (p: positions, n: negated, w: width, m: maybe) of a node inside a phrase."""
    zero, no = F.lit(0), F.lit(False)
    match node:
        case Term():
            allowed = F.lit(node.mask or 15)
            kept = F.filter(source.positions(node), lambda p: allowed.bitwiseAND(F.pow(F.lit(2), F.shiftright(p, 14)).cast("int")) != 0)
            places = F.array_distinct(F.transform(kept, lambda p: p.bitwiseAND(MAX_POSITION)))
            return let(places, lambda p: _result(p, no, zero, source.unplaced(node) & (F.size(p) == 0)))
        case Not(child):
            return let(_phrase(child, source), lambda x: _result(x["p"], ~x["n"] & ~x["m"], x["w"], x["m"]))
        case Phrase(left, right) | And(left, right) | Or(left, right):
            pair = F.struct(_phrase(left, source).alias("l"), _phrase(right, source).alias("r"))
            return let(pair, lambda x: _joined(node, x["l"], x["r"]))
    raise TypeError(node)


def _joined(node: Node, left: Column, right: Column) -> Column:
    w_l, w_r = left["w"], right["w"]
    if isinstance(node, Or):  # a side that fails has no width
        w_l, w_r = F.when(_failed(left), 0).otherwise(w_l), F.when(_failed(right), 0).otherwise(w_r)
    if isinstance(node, Phrase):
        move_l, move_r, width = F.lit(node.distance) + w_r, F.lit(0), F.lit(node.distance) + w_l + w_r
    else:
        width = F.greatest(w_l, w_r)
        move_l, move_r = width - w_l, width - w_r
    moved = F.struct(_shift(left["p"], move_l).alias("a"), _shift(right["p"], move_r).alias("b"))

    def combined(m: Column) -> Column:
        a, b, neg_l, neg_r = m["a"], m["b"], left["n"], right["n"]
        if isinstance(node, Or):
            p = F.when(~neg_l & ~neg_r, F.array_union(a, b)).when(neg_l & ~neg_r, F.array_except(a, b)).when(~neg_l & neg_r, F.array_except(b, a)).otherwise(F.array_intersect(a, b))
            maybe = left["m"] | right["m"]
            negated = neg_l | neg_r
        else:
            p = F.when(~neg_l & ~neg_r, F.array_intersect(a, b)).when(neg_l & ~neg_r, F.array_except(b, a)).when(~neg_l & neg_r, F.array_except(a, b)).otherwise(F.array_union(a, b))
            maybe = (left["m"] | right["m"]) & ~_failed(left) & ~_failed(right)
            negated = neg_l & neg_r
        # what may hold is neither true nor false; what failed cannot hold again
        return _result(F.when(maybe, _none()).otherwise(p), negated & ~maybe, width, maybe)

    return let(moved, combined)


def compile_match(query: str | Node | None, source) -> Column:
    """The boolean column of a query over a source; null where the source is null, false for an empty query."""
    node = as_tree(query)

    def build(n: Node) -> Column:
        match n:
            case Term():
                return source.present(n)
            case Not(child):
                return ~build(child)
            case And(left, right):
                return build(left) & build(right)
            case Or(left, right):
                return build(left) | build(right)
            case Phrase():
                return let(_phrase(n, source), lambda x: ((F.size(x["p"]) > 0) | x["n"]) & ~x["m"])
        raise TypeError(n)

    column = source.vector if isinstance(source, VectorSource) else source.tokens
    return F.when(column.isNotNull(), build(node) if node is not None else F.lit(False))


def matches(vector: Column | str, query: str | Node | None) -> Column:
    """``vector @@ query`` for a column of token vectors. A null query matches nothing (null)."""
    if query is None:
        return F.lit(None).cast("boolean")
    return compile_match(query, VectorSource(F.col(vector) if isinstance(vector, str) else vector))


def token_matches(tokens: Column | str, query: str | Node | None) -> Column:
    """The same for a column of token arrays in document order."""
    if query is None:
        return F.lit(None).cast("boolean")
    # a filter on computed tokens computes them where it mentions them: here once
    return let(F.col(tokens) if isinstance(tokens, str) else tokens, lambda t: compile_match(query, TokenSource(t)))
