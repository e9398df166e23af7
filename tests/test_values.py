"""Distances, ranges and arrays: fixed results."""

import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexspark.functions import arrays, distance, scalar
from lexspark.operators import search

INF = float("inf")


def values(spark, rows, kind):
    return spark.createDataFrame([(x,) for x in rows], f"i {kind}")


@pytest.mark.parametrize(("kind", "spark_type"), [("int2", "smallint"), ("int4", "int"), ("int8", "bigint"), ("float4", "float"), ("float8", "double")])
def test_number_distances(spark, kind, spark_type):
    df = values(spark, [-2, -1, 0, 1, 2, 3] if "int" in kind else [-2.0, -1.0, 0.0, 1.0, 2.0, 3.0], spark_type)
    got = lambda f, b: [r.d for r in df.select(f(F.col("i"), b, kind).alias("d"), "i").orderBy("i").collect()]
    assert got(distance.dist, 0) == [2, 1, 0, 1, 2, 3]
    assert got(distance.left_dist, 1) == [3, 2, 1, 0, INF, INF]
    assert got(distance.right_dist, 1) == [INF, INF, INF, INF, 1, 2]


def test_money_counts_cents(spark):
    df = values(spark, [], "decimal(19,2)").union(spark.range(-2, 4).select(F.col("id").cast("decimal(19,2)")))
    assert sorted(r.d for r in df.select(distance.dist(F.col("i"), F.lit(0).cast("decimal(19,2)"), "money").alias("d")).collect()) == [0, 100, 100, 200, 200, 300]


def test_time_distances(spark):
    at = datetime.datetime(2004, 10, 26, 6, 24, 8)
    rows = [datetime.datetime(2004, 10, 26, h, 55, 8) for h in (3, 4, 5, 8, 9, 10)]
    for kind, spark_type in (("timestamp", "timestamp_ntz"), ("timestamptz", "timestamp")):
        df = values(spark, rows, spark_type)
        probe = F.lit(str(at)).cast(spark_type)
        got = lambda f: sorted(r.d for r in df.select(f(F.col("i"), probe, kind).alias("d")).collect())  # noqa: E731, B023
        assert got(distance.dist) == [1740, 5340, 8940, 9060, 12660, 16260]
        assert got(distance.left_dist) == [1740, 5340, 8940, INF, INF, INF]
        assert got(distance.right_dist) == [9060, 12660, 16260, INF, INF, INF]


def test_infinite_sides(spark):
    df = spark.createDataFrame([(INF, INF), (INF, -INF), (float("nan"), float("nan")), (1.0, INF), (float("nan"), 1.0), (None, 1.0)], "a double, b double")
    assert [r.d for r in df.select(distance.dist(F.col("a"), F.col("b")).alias("d")).collect()] == [0, 0, 0, INF, INF, None]
    assert [r.d for r in df.select(distance.attached_distance(F.col("a"), F.col("b"), "float8").alias("d")).collect()][-1] == INF
    with pytest.raises(ValueError, match="doesn't support ordering"):
        distance.dist(F.col("a"), F.col("b"), "text")


ROWS = [[], [0], [1, 2, 3, 4], [1, 2, 3], [1, 2], [1]]


@pytest.fixture
def sets(spark):
    return spark.createDataFrame([(r,) for r in ROWS], "i array<int>")


def picked(df, condition):
    return sorted(r.i for r in df.where(condition).collect())


def test_array_predicates(sets):
    i = F.col("i")
    for probe in ([2, 1], [1, 2, 3, 3], [0, 0]):
        assert picked(sets, arrays.equal(i, probe)) == []
    assert picked(sets, arrays.equal(i, [1, 2])) == [[1, 2]]
    assert picked(sets, arrays.overlaps(i, F.array().cast("array<int>"))) == []
    assert picked(sets, arrays.contains(i, F.array().cast("array<int>"))) == sorted(ROWS)
    assert picked(sets, arrays.contains(i, [1, 1, 2])) == [[1, 2], [1, 2, 3], [1, 2, 3, 4]]
    assert picked(sets, arrays.contained(i, F.array().cast("array<int>"))) == [[]]


def test_array_similarity(sets):
    i = F.col("i")
    assert picked(sets, arrays.similar(i, F.array().cast("array<int>"))) == []
    assert picked(sets, arrays.similar(i, [1, 2, 3, 4, 5])) == [[1, 2], [1, 2, 3], [1, 2, 3, 4]]
    assert picked(sets, arrays.similar(i, list(range(1, 16)))) == [[1, 2, 3, 4]]
    assert picked(sets, arrays.similar(i, [1, 10, 20, 30])) == [[1]]
    assert picked(sets, arrays.similar(i, [1, 10, 20, 30, 40, 50])) == []
    ordered = sets.where(arrays.overlaps(i, [1])).orderBy(arrays.array_distance(i, [1])).collect()
    assert [r.i for r in ordered] == [[1], [1, 2], [1, 2, 3], [1, 2, 3, 4]]
    d = {tuple(r.i): r.d for r in sets.select("i", arrays.array_distance(i, [0]).alias("d")).collect()}
    assert d[()] == 0.0 and d[(1,)] == INF and d[(0,)] == 1.0
    with pytest.raises(ValueError):
        arrays.similarity(i, [1], "dice")


def test_array_nulls(spark):
    df = spark.createDataFrame([([1, None],)], "i array<int>")
    with pytest.raises(PySparkException, match="must not contain nulls"):
        df.select(arrays.overlaps(F.col("i"), [1])).collect()
    assert spark.createDataFrame([(None,)], "i array<int>").select(arrays.contains(F.col("i"), [1]).alias("x")).first().x is None


def test_similarity_functions(spark):
    df = spark.createDataFrame([([20, 23, 51],), ([33, 51, 20, 77, 23, 65],), ([1],)], "i array<int>")
    got = [r.d for r in df.select(arrays.array_distance(F.col("i"), [51]).alias("d")).collect()]
    assert got == pytest.approx([1.73205080756888, 2.44948974278318, INF])
    a, b = F.array(*map(F.lit, (1, 2, 3, 3))), F.array(*map(F.lit, (2, 3, 4)))
    row = df.select(arrays.similarity(a, b, "jaccard").alias("j"), arrays.similarity(a, b, "overlap").alias("o"), arrays.similarity(a, b).alias("c")).first()
    assert (row.j, row.o, row.c) == (0.5, 2.0, pytest.approx(2 / 3))


def test_range_operators(spark):
    df = values(spark, [-2, -1, 0, 1, 2, 3], "int")
    counts = [df.where(scalar.compare(op, F.col("i"), F.lit(1))).count() for op in ("<", "<=", "=", ">=", ">")]
    assert counts == [3, 4, 1, 3, 2]
    assert df.where(scalar.between(F.col("i"), 0, 2, high_open=True)).count() == 2


def test_sort_keys(spark):
    nets = ["1.2.3.4/32", "1.2.0.0/16", "1.2.3.0/24", "1.3.0.0/16", "0.0.0.0/0"]
    df = spark.createDataFrame([(n,) for n in nets], "n string").orderBy(scalar.inet_key(F.col("n")))
    assert [r.n for r in df.collect()] == ["0.0.0.0/0", "1.2.0.0/16", "1.2.3.0/24", "1.2.3.4/32", "1.3.0.0/16"]
    df = spark.createDataFrame([(0, 29, 0), (1, 0, 0), (0, 30, 1), (0, 0, 10**6)], "m int, d int, u long")
    assert [tuple(r) for r in df.orderBy(scalar.interval_key(F.col("m"), F.col("d"), F.col("u"))).collect()] == [(0, 0, 10**6), (0, 29, 0), (1, 0, 0), (0, 30, 1)]


def test_nearest_per_probe_by_neighbours(spark):
    """The same rows as meeting all rows of a key: ties, equal values, missing and endless ones, values that rounding makes equally far."""
    import random

    pick = random.Random(3)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e-20, 2e-20, 3e-20, 4e-20, 5e-20, 1e308, -1.7e308]
    value = lambda: pick.choice(odd) if pick.random() < 0.3 else float(pick.randrange(40))
    group = lambda: pick.choice([None, 1, 2, 2, 3, 3, 3])
    probes = spark.createDataFrame([(i, group(), value()) for i in range(120)], "p long, g int, a double")
    rows = spark.createDataFrame([(i, group(), value()) for i in range(400)] + [(1000, 4, 1.0)], "r long, g int, b double")
    near = lambda k, **x: sorted(map(str, search.nearest_per_probe(probes, rows, ["g"], distance.dist(F.col("b"), F.col("a")), "p", "r", k, **x).collect()))
    for k in (1, 3, 30):
        assert near(k, values=("a", "b")) == near(k)


def test_probes_meet_neighbours_only(spark):
    """The number of pairs is bounded by the probes, however many rows a key has."""
    probes = spark.range(50).selectExpr("id AS p", "1 AS g", "id * 1.5D AS a")
    rows = spark.range(5000).selectExpr("id AS r", "1 AS g", "CAST(id % 700 AS DOUBLE) AS b")
    assert search._neighbours(probes, rows, ["g"], ("a", "b"), "r", 3).count() <= 50 * 8 * 3
