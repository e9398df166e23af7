"""Match, rank and vectors: fixed results, and plain versions on random vectors."""

import itertools
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspark.functions import analyze, match, rank
from lexspark.functions import tsquery as q
from lexspark.functions.types import TSVECTOR, TSVECTOR_DDL, pack, parse_array, parse_tsvector, render_positions
from lexspark.operators import inverse


def test_vector_literals():
    assert parse_tsvector("fat:2,4A cat 'it''s':1 fat:3") == [{"lexeme": "cat", "pos": None}, {"lexeme": "fat", "pos": [2, 3, pack(4, "A")]}, {"lexeme": "it's", "pos": [1]}]
    assert render_positions([1, pack(5, "A"), pack(9, "C")]) == "1,5A,9C"
    assert parse_tsvector("") == [] and parse_tsvector(None) is None


def test_array_literals():
    assert parse_array("{1,2,3}") == [1, 2, 3] and parse_array("{}") == []
    with pytest.raises(ValueError, match="must not contain nulls"):
        parse_array("{NULL}")
    with pytest.raises(ValueError, match="must have 1 dimension"):
        parse_array("{{1,2},{3,4}}")


def test_query_parsing():
    assert q.parse("a | b & !c") == q.Or(q.Term("a"), q.And(q.Term("b"), q.Not(q.Term("c"))))
    assert q.parse("a <-> b <2> c") == q.Phrase(q.Phrase(q.Term("a"), q.Term("b")), q.Term("c"), 2)
    assert q.parse("'new york':*AB") == q.Term("new york", 0b1100, True)
    assert q.parse("  ") is None
    for bad in ("a &", "(a", "a b", "& a", "a)"):
        with pytest.raises(ValueError):
            q.parse(bad)
    for text in ("a & !(b | c:A*) <-> d", "!a", "x <5> y | z"):
        assert q.parse(q.render(q.parse(text))) == q.parse(text)
    assert [q.requires_match(q.parse(x)) for x in ("a", "!a", "a & !b", "a | !b", "a <-> !b")] == [True, False, True, False, True]


def frame(spark, vectors):
    return spark.createDataFrame([(i, parse_tsvector(v) if isinstance(v, str) else v) for i, v in enumerate(vectors)], "id int, v " + TSVECTOR.simpleString())


def ids(df, condition):
    return {r.id for r in df.where(condition).collect()}


def test_phrase_over_alternatives(spark):
    df = frame(spark, ["pet:1 dog:2", "pet:1 cat:2", "pet:1 dog:3", "pet:1 fish:2", "pet dog"])
    assert ids(df, match.matches("v", "pet <-> (dog | cat)")) == {0, 1}


def test_phrase_negation_and_missing_positions(spark):
    df = frame(spark, ["half:1 way:2", "gave:1 way:2", "way:1", "other:4 way:5", "gave way", None])
    assert ids(df, match.matches("v", "(gave | half) <-> way")) == {0, 1}
    assert ids(df, match.matches("v", "(gave | !half) <-> way")) == {1, 2, 3}
    assert ids(df, match.matches("v", "!(gave <-> way)")) == {0, 2, 3, 4}
    assert ids(df, match.matches("v", None)) == set()


def test_weights(spark):
    df = frame(spark, ["a:1A b:2", "a:1 b:2A", "a:1B,5D", "a"])
    assert ids(df, match.matches("v", "a:A")) == {0}
    assert ids(df, match.matches("v", "a:AB")) == {0, 2}
    assert ids(df, match.matches("v", "a & !a:A")) == {1, 2, 3}
    assert ids(df, match.matches("v", "a:D <-> b:A")) == {1}


#: Fixed truth table: probe -> numbers of the stored queries that match.
TRUTH = {
    "": {3, 4, 5, 10}, "a": {1, 4, 6}, "b": {1, 4, 5, 10}, "a b": {1, 2, 5, 11}, "c": {3, 4, 5, 8, 10}, "a c": {1, 4, 6, 7, 9}, "b c": {1, 4, 5, 7, 9, 10}, "a b c": {1, 2, 5, 7, 9},
    "d": {3, 4, 5, 10}, "a d": {1, 4, 6, 9}, "b d": {1, 4, 5, 9, 10}, "a b d": {1, 2, 5, 9, 11}, "c d": {3, 4, 5, 8, 10}, "a c d": {1, 4, 6, 7, 9},
}
STORED = [(1, "a|b"), (2, "a&b"), (3, "!(a|b)"), (4, "!(a&b)"), (5, "!a|b"), (6, "a&!b"), (7, "(a|b)&c"), (8, "(!(a|b))&c"), (9, "(a|b)&(c|d)"), (10, "!a")]


def test_truth_table(spark):
    from lexspark.operators import inverse

    docs = spark.createDataFrame([(k, probe.split()) for k, probe in enumerate(TRUTH)], "doc_id long, words array<string>")
    stored = inverse.store_queries(spark, STORED)
    for out in (inverse.percolate(docs, stored, F.col("words")), inverse.percolate_scan(docs, STORED, F.col("words"))):
        found = {}
        for r in out.collect():
            assert r.query_id not in found.setdefault(r.doc_id, set())
            found[r.doc_id].add(r.query_id)
        assert found == {k: numbers - {11} for k, numbers in enumerate(TRUTH.values())}
    for bad in ("a:*", "a <-> b"):
        with pytest.raises(ValueError):
            inverse.store_queries(spark, [(1, bad)])


def plain_match(vector, node):
    """The query on {lexeme: places} by direct reading of its meaning, without phrases."""
    match node:
        case q.Term(w, _, prefix):
            return any(x.startswith(w) for x in vector) if prefix else w in vector
        case q.Not(c):
            return not plain_match(vector, c)
        case q.And(a, b):
            return plain_match(vector, a) and plain_match(vector, b)
        case q.Or(a, b):
            return plain_match(vector, a) or plain_match(vector, b)
        case q.Phrase(a, b, d):
            return bool(places(vector, a) & {p - d for p in places(vector, b)})


def places(vector, node):
    """End places of a phrase without negation."""
    match node:
        case q.Term(w):
            return set(vector.get(w, ()))
        case q.Or(a, b):
            return places(vector, a) | places(vector, b)
        case q.Phrase(a, b, d):
            return {p for p in places(vector, b) if p - d in places(vector, a)}


def test_random_queries_in_both_sources(spark):
    pick = random.Random(1)
    texts = [[pick.choice("abcd") for _ in range(pick.randrange(9))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t array<string>").select("id", "t", analyze.vector_of_tokens(F.col("t")).alias("v"))
    queries = ["a <-> b", "a <2> (b | c)", "a <-> b <-> c", "(a | b) & !(c <-> d)", "!a & !b", "a & b:*", "(a <-> b) | (c <3> d)", "!(a | (b & c))"]
    rows = df.select("id", "v", *[match.matches("v", x).alias(f"m{i}") for i, x in enumerate(queries)], *[match.token_matches("t", x).alias(f"t{i}") for i, x in enumerate(queries)]).collect()
    for r in rows:
        vector = {}
        for k, w in enumerate(texts[r.id]):
            vector.setdefault(w, []).append(k + 1)
        assert {x.lexeme: x.pos for x in r.v} == vector and [x.lexeme for x in r.v] == sorted(vector)
        for i, x in enumerate(queries):
            assert r[f"m{i}"] == r[f"t{i}"] == plain_match(vector, q.parse(x)), (texts[r.id], x)


#: Fixed results: (vector, query) -> distance.
RANKS = [
    ("way:4", "way", 16.4493), ("go:3 way:4", "way & (go | half)", 8.22467), ("go:3 way:10", "way & (go | half)", 57.5727), ("b:1,9", "b:*", 13.1595),
    ("bjarn:6237 stroustrup:6238", "bjarn <-> stroustrup", 8.22467), ("stroustrup:5508B,6233B,6238B bjarn:6235B,6237B", "bjarn <-> stroustrup", 2.05617),
]


def test_fixed_ranks(spark):
    for vector, query, expected in RANKS:
        df = frame(spark, [vector])
        got = df.select(rank.ts_distance("v", query).alias("d"), rank.ts_distance("v", query, general=True).alias("g"), rank.ts_score("v", query).alias("s")).first()
        assert got.d == pytest.approx(expected, rel=1e-5) and got.g == pytest.approx(expected, rel=1e-5) and got.s == pytest.approx(1 / expected, rel=1e-5)


def test_closed_forms_agree_with_the_search(spark):
    pick = random.Random(9)
    vectors = []
    for _ in range(40):
        spots = pick.sample(range(1, 40), 12)
        vectors.append([{"lexeme": w, "pos": [p | pick.randrange(4) << 14 for p in sorted(spots[i * 3 : i * 3 + pick.randrange(4)])] or None} for i, w in enumerate("abcd")])
    df = frame(spark, vectors)
    cases = list(itertools.product(["a", "a | b", "a & b", "a | b | c"], [0, 1, 2, 8, 16, 32, 34]))
    cols = [c for i, (x, m) in enumerate(cases) for c in (rank.ts_score("v", x, m).alias(f"c{i}"), rank.ts_score("v", x, m, general=True).alias(f"g{i}"))]
    for r in df.select(*cols).collect():
        for i, case in enumerate(cases):
            assert r[f"c{i}"] == pytest.approx(r[f"g{i}"], rel=1e-5), case


def test_rank_of_nothing(spark):
    df = frame(spark, ["a b", "", None])
    assert [r.d for r in df.orderBy("id").select(rank.ts_distance("v", "a").alias("d")).collect()] == [float("inf"), float("inf"), None]
    with pytest.raises(ValueError, match="NULL query"):
        rank.DistanceQuery(None)
    assert rank.DistanceQuery("a", None).mask == 0


def test_vector_functions(spark):
    df = frame(spark, ["a:1 b:2"]).select(analyze.concat_vectors(analyze.setweight(F.col("v"), "A"), F.col("v")).alias("v"))
    row = df.select("v", analyze.strip(F.col("v")).alias("s"), analyze.vector_length(F.col("v")).alias("n")).first()
    assert {x.lexeme: set(x.pos) for x in row.v} == {"a": {pack(1, "A"), 3}, "b": {pack(2, "A"), 4}}
    assert row.n == 4 and all(x.pos is None for x in row.s)
    empty = spark.createDataFrame([("",), (None,)], "t string").select(analyze.to_tsvector("t").alias("v")).collect()
    assert empty[0].v == [] and empty[1].v is None


def test_words_at_one_place_rank_without_noise(spark):
    cases = {"a:5 b:5": 0.2, "a:16383 b:16383": 0.2, "a:5 b:6": 0.2, "a:5 b:7": 0.1}
    df = spark.createDataFrame([(text, parse_tsvector(text)) for text in cases], f"text string, v {TSVECTOR_DDL}")
    for row in df.select("text", rank.ts_score("v", "a & b").alias("closed"), rank.ts_score("v", "a & b", general=True).alias("searched")).collect():
        expected = pytest.approx(cases[row.text] / 1.64493406685, rel=1e-6)
        assert row.closed == expected and row.searched == expected


def test_stored_queries_from_a_table(spark, monkeypatch):
    monkeypatch.setattr(inverse, "SILENT_BLOCK", 2)
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, []), (4, None)], "doc_id long, words array<string>")
    texts = ["a & b", "!a", "b | c", "!(a & b)", "!a & !c", "!b | a", "", "!zz"]
    table = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(99, None, 0)], "query_id long, query string, program int").repartition(3)
    expected = {(1, 0), (1, 2), (1, 5), (1, 7), (2, 1), (2, 2), (2, 3), (2, 5), (2, 7), (3, 1), (3, 3), (3, 4), (3, 5), (3, 7)}
    stored = inverse.stored_table(table)
    out = inverse.percolate(docs, stored, F.col("words"))
    assert {(r.doc_id, r.query_id) for r in out.collect()} == expected and out.count() == len(expected)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    assert inverse.percolate(docs, stored.limit(0), F.col("words")).count() == 0


def test_table_vectors_equal_vectors(spark, monkeypatch):
    """Vectors in batches are those of the column, for missing, empty and long texts, in pieces of any size."""
    texts = [None, "", " .. ", "b a b", "Der der DER é z ab a", "a b a " * 6000 + "zz a", "x " * 17000, None, "one"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    for size in (1, 5, 1 << 18):
        df2 = df.select(analyze.to_tsvector("text").alias("a"), analyze.table_vectors(analyze.tokens("text")).alias("b"))
        assert df2.where("NOT a <=> b").count() == 0
        words = pa.array([None if t is None else t.split() for t in texts], pa.list_(pa.string()))
        monkeypatch.setattr(analyze, "PIECE_TOKENS", size)
        assert analyze._vector_batch(words).to_pylist() == analyze._vectors(words).to_pylist()
    assert analyze._vector_batch(words.slice(3, 2)).to_pylist() == analyze._vectors(words).to_pylist()[3:5] and len(analyze._vector_batch(words.slice(0, 0))) == 0


def test_scores_in_batches(spark):
    """Several masks from one search, as by the search of single vectors; words are looked for in one pass over tokens computed once."""
    pick = random.Random(8)
    rows = [(i, None if i == 7 else " ".join(pick.choice(["of", "the", "and", "to", "in", "x"]) for _ in range(pick.randrange(60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, text string").select("i", analyze.to_tsvector("text").alias("v"))
    query = "(of <-> the) | (and & to & in:*) & !(x <-> x)"
    for r in df.select("v", rank.ts_scores("v", query, [0, 4, 34]).alias("s")).collect():
        expected = None if r.v is None else [pytest.approx(rank.Ranker(query, m).score([(x.lexeme, x.pos) for x in r.v]), rel=1e-6) for m in (0, 4, 34)]
        assert r.s == expected


def test_tokens_are_computed_once(spark, sf_dir):
    from lexspark.plans import text_queries

    for name in ("rank_general", "fts_nested"):
        plan = text_queries.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") <= (2 if name == "rank_general" else 1)
