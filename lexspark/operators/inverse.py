"""Inverse search: queries are stored, documents ask which of them they match.

A stored query is a program of its operands and operators in postfix order, and a row per distinct operand. A
document's lexemes join the operands by equality; the hits of each (document, query) are gathered and the
program is run on them with a stack of booleans, inside the JVM. Queries that match an empty vector are
added for documents that hit none of their operands: these queries are held in blocks, and a document meets each block.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import match
from lexspark.functions.tsquery import And, Node, Not, Or, Term, as_tree, has_phrase, push_not, terms, true_of_empty

PROGRAM = "array<struct<op:string,lexeme:string>>"
STORED = f"query_id long, query string, program {PROGRAM}, lexemes array<string>, empty boolean"
#: Queries that match an empty vector, to a block.
SILENT_BLOCK = 1000


def program(node: Node) -> list[tuple[str, str | None]]:
    """Postfix steps; negations stand at the operands."""
    match node:
        case Term(lexeme):
            return [("has", lexeme)]
        case Not(Term(lexeme)):
            return [("lacks", lexeme)]
        case And(left, right):
            return program(left) + program(right) + [("and", None)]
        case Or(left, right):
            return program(left) + program(right) + [("or", None)]
    raise ValueError("negations must stand at operands")


def _compiled(query_id: int, text: str | None) -> tuple | None:
    node = as_tree(text) if text is not None else None
    if node is None:
        return None
    if any(t.prefix for t in terms(node)):
        raise ValueError("indexing of prefix queries is not supported")
    if has_phrase(node):
        raise ValueError("indexing of phrase queries is not supported")
    flat = push_not(node)
    return query_id, text, program(flat), sorted({t.lexeme for t in terms(flat)}), true_of_empty(node)


def store_queries(spark: SparkSession, queries: Iterable[tuple[int, str]]) -> DataFrame:
    """(query_id, query, program, lexemes, empty: matches an empty vector). Weights are ignored; prefixes and phrases are errors."""
    return spark.createDataFrame([row for q in queries if (row := _compiled(*q))], STORED)


def stored_table(queries: DataFrame, id_col: str = "query_id", query_col: str = "query") -> DataFrame:
    """The same from a table of any size, by the tasks that read it. Null and empty queries are left out; write it once, read it often."""

    def run(batches: Iterable) -> Iterable:
        import pandas as pd

        for batch in batches:
            rows = [row for q in zip(batch["query_id"], batch["query"]) if (row := _compiled(*q))]
            out = pd.DataFrame(rows, columns=["query_id", "query", "program", "lexemes", "empty"])
            out["program"] = [[{"op": op, "lexeme": lexeme} for op, lexeme in p] for p in out["program"]]
            yield out

    return queries.select(F.col(f"`{id_col}`").cast("long").alias("query_id"), F.col(f"`{query_col}`").cast("string").alias("query")).mapInPandas(run, STORED)


def _run(steps: Column, hits: Column) -> Column:
    """The program's result, given the operands that the document holds."""

    def step(stack: Column, s: Column) -> Column:
        n = F.size(stack)
        known = F.array_contains(hits, s["lexeme"])
        pushed = lambda b: F.concat(stack, F.array(b))
        rest = F.slice(stack, 1, F.greatest(n - 2, F.lit(0)))
        two = lambda both: F.concat(rest, F.array(both(F.get(stack, n - 1), F.get(stack, n - 2))))
        return F.when(s["op"] == "has", pushed(known)).when(s["op"] == "lacks", pushed(~known)).when(s["op"] == "and", two(lambda a, b: a & b)).otherwise(two(lambda a, b: a | b))

    return F.aggregate(steps, F.array().cast("array<boolean>"), step, lambda stack: F.get(stack, F.lit(0)))


def percolate(docs: DataFrame, stored: DataFrame, words: Column, key: str = "doc_id") -> DataFrame:
    """(key, query_id) for each stored query that a document's words match. Null words match nothing.

    ``words`` is an array of lexemes. Both joins are by equality, on lexemes and on blocks of queries: Spark broadcasts
    the stored side where it measures it to be small, and shuffles and splits skewed keys where it is not.
    """
    have = docs.select(F.col(key).alias("k"), F.array_distinct(words).alias("words")).where("words is not null")
    held = have.select("k", F.explode("words").alias("lexeme"))
    wanted = stored.select("query_id", "program", F.explode("lexemes").alias("lexeme"))
    hits = held.join(wanted, "lexeme").groupBy("k", "query_id").agg(F.collect_set("lexeme").alias("hits"), F.first("program").alias("program"))
    judged = hits.select("k", "query_id", _run(F.col("program"), F.col("hits")).alias("ok"))
    # queries true of an empty vector: every document that holds none of their operands matches
    silent = stored.where("empty").select("query_id", "lexemes")
    n = silent.count()
    blocks = -(-n // SILENT_BLOCK)
    matched = judged.where("ok").select(F.col("k").alias(key), "query_id")
    if not n:
        return matched
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    held = silent.groupBy(block.alias("block")).agg(F.collect_list(F.struct("query_id", "lexemes")).alias("q"))
    meets = have.select("k", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    some = meets.join(held, "block").select("k", F.explode(F.filter("q", lambda q: ~F.arrays_overlap(q["lexemes"], F.col("words")))).alias("q"))
    return matched.union(some.select("k", "q.query_id"))


def percolate_scan(docs: DataFrame, queries: Iterable[tuple[int, str]], words: Column, key: str = "doc_id") -> DataFrame:
    """The same without an index, one compiled column per query; phrases and prefixes are allowed."""
    tests = F.array(*[F.when(match.token_matches(words, text), F.lit(query_id).cast("long")) for query_id, text in queries])
    return docs.select(F.col(key), F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("query_id"))

