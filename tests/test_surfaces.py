"""SQL names, text sources, streams, and the query catalogue."""

import json
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexspark.functions import sql
from lexspark.operators import inverse
from lexspark.plans import catalog
from lexspark.sources import text_files
from lexspark.streaming.percolator import percolate_stream


def test_sql_functions(spark):
    names = sql.register(spark)
    assert {"dist", "ts_match", "ts_score"} <= set(names)
    one = lambda e: spark.sql(f"SELECT {e} AS x").first().x
    assert one("dist(1, 4)") == 3 and one("left_dist(4, 1)") == float("inf") and one("right_dist(4, 1)") == 3 and one("dist(null, 1)") is None
    assert one("dist(double('NaN'), double('Infinity'))") == 0
    assert one("time_dist(timestamp_ntz'2020-01-01 00:00:01', timestamp_ntz'2020-01-01')") == 1.0
    assert one("ts_match(tsvector('gave:1 way:2'), '(gave | half) <-> way')") is True
    assert one("ts_match(tsvector('gave way'), 'gave <-> way')") is False
    assert one("ts_match(tsvector('a:1A'), 'a:BC | !a')") is False
    assert one("round(score_distance(ts_score(tsvector('go:3 way:10'), 'go & way', 0)), 4)") == pytest.approx(57.5727, abs=1e-3)
    assert one("array_contains_all(array('a', 'b'), array('b'))") is True


def test_delimited_text(spark, tmp_path):
    (tmp_path / "f.txt").write_text("1\tab:1 cd\t{1,2}\n2\t\\N\t{}\n3\t\t\\N\n")
    rows = text_files.read_delimited(spark, f"file://{tmp_path}/f.txt", "id int,v string,a string", vectors=("v",), arrays={"a": "int"}).orderBy("id").collect()
    assert [(x.lexeme, x.pos) for x in rows[0].v] == [("ab", [1]), ("cd", None)] and rows[0].a == [1, 2]
    assert rows[1].v is None and rows[1].a == [] and rows[2].v == [] and rows[2].a is None
    bad = spark.createDataFrame([("{1,NULL}",)], "a string")
    with pytest.raises(PySparkException, match="must not contain nulls"):
        bad.select(text_files.arrays_from_text(F.col("a"))).collect()


def test_percolator_on_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"doc_id": i, "words": w.split()}) for i, w in enumerate(["a b", "c", "b"])))
    stored = inverse.store_queries(spark, [(1, "a & b"), (2, "!a"), (3, "b | c")])
    found = []
    stream = spark.readStream.schema("doc_id long, words array<string>").json(f"file://{folder}")
    percolate_stream(stream, stored, F.col("words"), lambda df, n: found.extend(df.collect()), f"file://{tmp_path}/c").awaitTermination(60)
    assert sorted((r.doc_id, r.query_id) for r in found) == [(0, 1), (0, 3), (1, 2), (1, 3), (2, 2), (2, 3)]


def test_catalogue_names():
    names, texts = catalog.queries(), catalog.oracle_sql()
    assert set(texts) <= set(names)
    assert set(names) - set(texts) == {"rank_general", "fuzzy_limit"}
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in names)


@pytest.mark.parametrize("name", ["flagship", "fts_phrase_or", "rank_and2", "knn_money", "arr_topk", "postings_negative"])
def test_some_queries_run(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0


def test_range_reaches_the_scan(spark, sf_dir):
    plan = catalog.queries()["range_rows"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and re.search(r"ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>", plan)
