"""Posting tables: the same rows as a scan, changes, inspection, errors."""

import random

import pytest
from pyspark.sql import functions as F

from lexspark.functions import analyze, match
from lexspark.operators import postings, registry, search


@pytest.fixture(scope="module")
def table(spark):
    pick = random.Random(6)
    rows = [(i, " ".join(pick.choice(["one", "two", "three", "onerous", "four"]) for _ in range(pick.randrange(7))), pick.choice([None, 1, 5, 9, 12]), [pick.randrange(6) for _ in range(pick.randrange(5))]) for i in range(80)]
    rows += [(100, None, 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d int, a array<int>").select("doc_id", "d", "a", analyze.to_tsvector("text").alias("v"))
    return df.cache()


@pytest.fixture(scope="module")
def index(table, tmp_path_factory):
    return postings.build_index(table, f"file://{tmp_path_factory.mktemp('index')}/i", {"v": "tsvector", "a": "anyarray"}, attach="d", to="v", buckets=4, attached_kind="int4")


QUERIES = ["one", "one & !two", "one <-> two", "one | three", "one:* & four", "!one", "!(one <-> two) & three", "!(one & two)"]


@pytest.mark.parametrize("query", QUERIES)
def test_search_equals_scan(table, index, query):
    expected = {r.doc_id for r in table.where(match.matches("v", query)).collect()}
    assert {r.doc_id for r in index.search({"v": query}).collect()} == expected


@pytest.mark.parametrize(("op", "probe"), [("&&", [1, 2]), ("@>", [1, 2]), ("<@", [1, 2, 3]), ("=", [1, 2]), ("%", [1, 2, 3]), ("@>", []), ("&&", [])])
def test_array_search_equals_scan(spark, table, index, op, probe):
    from lexspark.functions import arrays

    literal = F.array(*[F.lit(x) for x in probe]).cast("array<int>")
    test = {"&&": arrays.overlaps, "@>": arrays.contains, "<@": arrays.contained, "=": arrays.equal, "%": arrays.similar}[op]
    expected = {r.doc_id for r in table.where(test(F.col("a"), literal)).collect()}
    assert {r.key for r in index.match_array("a", op, probe).collect()} == expected


def test_order_by_attached_value(table, index):
    got = [(r.doc_id, r.distance) for r in index.search({"v": "one"}, order_by=[("<=>", "d", 6)], limit=500).collect()]
    plain = [(r.doc_id, float("inf") if r.d is None else abs(r.d - 6)) for r in table.where(match.matches("v", "one")).collect()]
    assert got == sorted(plain, key=lambda x: (x[1], x[0]))
    filtered = index.search({"v": "one"}, filters=F.col("d") <= 5).collect()
    assert {r.doc_id for r in filtered} == {r.doc_id for r in table.where(match.matches("v", "one") & (F.col("d") <= 5)).collect()}


def test_changes(spark, table, tmp_path):
    path = f"file://{tmp_path}/i"
    first = postings.build_index(table.where("doc_id < 40"), path, {"v": "tsvector"}, buckets=4)
    whole = first.append(table.where("doc_id >= 40"))
    expected = {r.doc_id for r in table.where(match.matches("v", "one & !two")).collect()}
    assert {r.doc_id for r in whole.search({"v": "one & !two"}).collect()} == expected
    left = whole.delete(spark.range(0, 100, 3).toDF("doc_id"))
    expected = {i for i in expected if i % 3}
    assert {r.doc_id for r in left.search({"v": "one & !two"}).collect()} == expected
    old = left.options.generation
    new = left.compact()
    assert new.options.generation != old and {r.doc_id for r in new.search({"v": "one & !two"}).collect()} == expected
    assert {r.doc_id for r in left.search({"v": "one & !two"}).collect()} == expected  # readers of the old generation go on
    assert new.stats().first().n_deleted == 0 and left.stats().first().n_deleted > 0


def test_update_clean_and_empty(spark, table, tmp_path):
    path = f"file://{tmp_path}/u"
    index = postings.build_index(table, path, {"v": "tsvector_addon"}, buckets=4, attach="d", to="v", attached_kind="int4")
    new = table.where("doc_id < 10").select("doc_id", F.lit(7).alias("d"), F.when(F.col("doc_id") % 2 == 0, analyze.to_tsvector(F.lit("fresh one"))).alias("v"))
    for _ in range(2):
        index.update(new)
    assert {r.doc_id for r in index.search({"v": "fresh & one"}, filters=F.col("d") == 7).collect()} == {0, 2, 4, 6, 8}
    expected = {r.doc_id for r in table.where(match.matches("v", "one") & (F.col("doc_id") >= 10)).collect()} | {0, 2, 4, 6, 8}
    assert {r.doc_id for r in index.search({"v": "one"}).collect()} == expected and index.docs().count() == table.count()
    index.delete(spark.range(10).toDF("doc_id")).append(table.where("doc_id < 10").select("doc_id", "d", "v"))
    small = index.compact()
    assert {r.doc_id for r in small.search({"v": "one"}).collect()} == {r.doc_id for r in table.where(match.matches("v", "one")).collect()}
    assert small.clean() == 1 and small.clean() == 0 and postings.PostingIndex(spark, path).docs().count() == table.count()
    empty = postings.build_index(table.limit(0), f"file://{tmp_path}/e", {"v": "tsvector", "a": "anyarray"}, buckets=4)
    assert empty.search({"v": "one"}).count() == 0 == empty.search({"v": "!one"}).count() and empty.stats().first().n_rows == 0
    assert empty.append(table).search({"v": "one"}).count() == table.where(match.matches("v", "one")).count()


def test_nearest_rows_come_from_postings(index):
    plan = index.search({"v": "one"}, filters=F.col("d") >= 2, order_by=[("<=>", "d", 6)], limit=3)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[plan.index("Join") :]
    assert "GlobalLimit 3" in top and top.index("GlobalLimit 3") < top.rindex("/postings") if "/postings" in top else "GlobalLimit 3" in top


def test_inspection(table, index):
    stats = index.stats().first()
    n = table.where("v is not null").select(F.sum(F.size("v"))).first()[0] + table.select(F.sum(F.size(F.array_distinct("a")))).first()[0]
    assert stats.n_postings == n and stats.n_rows == table.count()
    entry = index.entries().where("term = 'one' and col = 'v'").first()
    assert entry.n_rows == table.where(match.matches("v", "one")).count() and entry.category == "NORM_KEY"
    assert {r.category for r in index.entries().collect()} == {"NORM_KEY", "EMPTY_ITEM", "NULL_ITEM"}
    item = index.items("v", "one").orderBy("key").first()
    assert item.positions and index.partitions().count() <= 5


def test_hash_class(table, tmp_path):
    hashed = postings.build_index(table, f"file://{tmp_path}/h", {"v": "tsvector_hash"}, buckets=4)
    assert {r.doc_id for r in hashed.search({"v": "one <-> two"}).collect()} == {r.doc_id for r in table.where(match.matches("v", "one <-> two")).collect()}
    with pytest.raises(ValueError, match="prefix"):
        hashed.search({"v": "one:*"})


def test_builder_errors(table, tmp_path):
    build = lambda **k: postings.build_index(table, f"file://{tmp_path}/e", **k)
    for options in (
        {"columns": {"v": "tsvector_addon"}}, {"columns": {"v": "tsvector"}, "attach": "d"}, {"columns": {"v": "tsvector"}, "attach": "v", "to": "v"},
        {"columns": {"v": "tsvector"}, "attach": "x", "to": "v"}, {"columns": {"nope": "tsvector"}}, {"columns": {"v": "tsvector"}, "order_by_attach": True}, {"columns": {"v": "what"}},
    ):
        with pytest.raises(ValueError):
            build(**options)


def test_registry():
    assert len(registry.CLASSES) == 34
    assert all(registry.validate(c) == [] for c in registry.CLASSES.values())
    assert registry.properties("int4")["distance_orderable"] and not registry.properties("text")["distance_orderable"]
    assert registry.validate(registry.IndexClass("x", "scalar", "string", None, ("@@",)))


def test_generated_table(spark, tmp_path):
    """338 rows of ten two-letter words from a linear congruence, as an index and as a scan."""
    x, rows = 228, []
    for i in range(338):
        out = []
        for _ in range(10):
            x = (x * 261 + 17) % 6760
            out.append(chr(97 + x % 26) + chr(97 + x // 26 % 26))
        rows.append((i, " ".join(out)))
    df = spark.createDataFrame(rows, "doc_id long, t string").select("doc_id", analyze.to_tsvector("t").alias("v"))
    index = postings.build_index(df, f"file://{tmp_path}/g", {"v": "tsvector"}, buckets=4)
    for query in ("ab | qr", "ab & !cd", "a:* & z:*"):
        assert index.search({"v": query}).count() == df.where(match.matches("v", query)).count()


def test_top_rows_and_fuzzy_limit(spark):
    df = spark.range(100).toDF("doc_id")
    assert [r.doc_id for r in search.ordered(df, [F.abs(F.col("doc_id") - 50)], "doc_id", 3).collect()] == [50, 49, 51]
    assert search.fuzzy_limit(df, 200).count() == 100 and search.fuzzy_limit(df, 0).count() == 100
    assert 0 < search.fuzzy_limit(df, 20, seed=1).count() < 60
    plan = search.ordered(df, [F.col("doc_id")], "doc_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("few", [0, 16])
def test_posting_files_keep_their_size(table, tmp_path, monkeypatch, few):
    """A bucket is cut into more files as the rows grow, dealt to tasks or not; every file is of one bucket."""
    for name, value in (("FILE_MB", 1e-4), ("TASK_MB", 1e-4), ("FEW_BUCKETS", few)):
        monkeypatch.setattr(postings, name, value)
    index = postings.build_index(table.repartition(8), f"file://{tmp_path}/s", {"v": "tsvector", "a": "anyarray"}, buckets=2, attach="d", to="v", attached_kind="int4")
    files = index._rows().select(F.input_file_name().alias("f"), "bucket").distinct().collect()
    assert len(files) == len({r.f for r in files}) and all(sum(r.bucket == b for r in files) > 4 for b in (0, 1))
    assert {r.doc_id for r in index.search({"v": "one <-> two"}).collect()} == {r.doc_id for r in table.where(match.matches("v", "one <-> two")).collect()}
    assert {r.category for r in index.entries().collect()} == {"NORM_KEY", "EMPTY_ITEM", "NULL_ITEM"} and index.postings("v").where("attached IS NOT NULL").count() and not index.postings("a").where("attached IS NOT NULL").count()


def test_boolean_search_reads_no_places(index):
    """Where presence decides, positions are not read; phrases need them."""
    scan = lambda q: next(x for x in index.search({"v": q})._jdf.queryExecution().executedPlan().toString().splitlines() if "Scan parquet" in x and "term" in x)
    assert "pos:array" not in scan("one & !two") and "pos:array" in scan("one <-> two")


@pytest.mark.parametrize("query", ["one:A & two", "one | on:* & !(three & !four)", "one & one", "(one | two) & (one | !two)"])
def test_search_by_bits_equals_scan(table, index, query):
    expected = {r.doc_id for r in table.where(match.matches("v", query)).collect()}
    assert {r.doc_id for r in index.search({"v": query}).collect()} == expected


def test_inspection_sums_up_terms_first(table, index):
    """Posting rows meet a hash aggregate by term; nothing sorts them or keeps every row's key apart."""
    plan = index.partitions()._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate") > plan.rindex("SortAggregate")
    assert "Expand" not in index.stats()._jdf.queryExecution().executedPlan().toString()
    plain = index.postings().groupBy("bucket").agg(F.count("*"), F.countDistinct("term"), F.min("term"), F.max("term")).collect()
    assert sorted(index.partitions().collect()) == sorted(plain)


def test_vectors_are_computed_once(spark, sf_dir, monkeypatch):
    """Changes of an index, and a second index of the same rows, take vectors from what is stored."""
    from lexspark.plans import text_queries

    calls, plain = [], text_queries._documents_with_vectors
    monkeypatch.setattr(text_queries, "_documents_with_vectors", lambda *a: calls.append(a) or plain(*a))
    monkeypatch.setattr(text_queries, "_INDEXES", {})
    for query in (text_queries._update, text_queries._items):
        calls.clear()
        assert query(spark, sf_dir).count() and len(calls) == 1
