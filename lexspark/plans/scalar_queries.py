"""Registered queries over scalars and arrays: distances, ranges, set predicates, similarity."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import arrays, distance, scalar
from lexspark.operators import search

INF = float("inf")


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Type -> (table, key, Spark value, literal, SQL value, SQL literal, SQL gap of a and b as a double).
KNN = {
    "int2": ("part", "p_partkey", F.col, "p_size", "smallint", 25, "CAST(p_size AS SMALLINT)", "25"),
    "int4": ("part", "p_partkey", F.col, "p_size", "int", 25, "p_size", "25"),
    "int8": ("orders", "o_orderkey", F.col, "o_custkey", "bigint", 700, "o_custkey", "700"),
    "float4": ("customer", "c_custkey", F.col, "c_acctbal", "float", 2500.0, "CAST(c_acctbal AS FLOAT)", "CAST(2500 AS FLOAT)"),
    "float8": ("customer", "c_custkey", F.col, "c_acctbal", "double", 2500.0, "c_acctbal", "2500.0"),
    "money": ("supplier", "s_suppkey", F.col, "s_acctbal", "decimal(19,2)", 2500, "CAST(round(s_acctbal * 100) AS BIGINT)", "250000"),
    "oid": ("customer", "c_custkey", F.col, "c_custkey", "bigint", 600, "c_custkey", "600"),
    "timestamp": ("events", "event_id", F.col, "ts", "timestamp_ntz", datetime.datetime(2024, 1, 5, 6, 24, 8), "epoch_us(ts)", "epoch_us(TIMESTAMP '2024-01-05 06:24:08')"),
    "timestamptz": ("orders", "o_orderkey", F.col, "o_orderdate", "timestamp", datetime.datetime(1998, 10, 3), "epoch_us(o_orderdate)", "epoch_us(TIMESTAMP '1998-10-03 00:00:00')"),
}


def _literal(kind: str, value) -> Column:
    if kind.startswith("timestamp"):
        return F.lit(str(value)).cast("timestamp" if kind == "timestamptz" else "timestamp_ntz")
    return F.lit(value).cast(KNN[kind][4])


def _finite(c: Column) -> Column:
    return F.when(c == INF, -1.0).otherwise(F.round(c, 4))


def _knn(kind: str):
    table, key, _, column, spark_type, value, _, _ = KNN[kind]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        a, b = F.col(column).cast(spark_type), _literal(kind, value)
        d = _table(spark, sf, table)
        return d.select(F.col(key), *[_finite(distance.DISTANCES[op](a, b, kind)).alias(name) for op, name in (("<=>", "both"), ("<=|", "on_left"), ("|=>", "on_right"))])

    return run


def _knn_sql(kind: str) -> str:
    table, key, _, _, _, _, a, b = KNN[kind]
    unit = "1000000.0" if kind.startswith("timestamp") else "1.0"
    up, down = (f"round(CAST({x} AS DOUBLE) / {unit} - CAST({y} AS DOUBLE) / {unit}, 4)" for x, y in ((a, b), (b, a)))
    if kind.startswith("timestamp"):
        up, down = f"round(({a} - {b}) / {unit}, 4)", f"round(({b} - {a}) / {unit}, 4)"
    return f"""SELECT {key}, abs({up}) AS "both", CASE WHEN {a} <= {b} THEN {down} ELSE -1.0 END AS on_left, CASE WHEN {a} > {b} THEN {up} ELSE -1.0 END AS on_right FROM {table}"""


def _knn_topk(op: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = _table(spark, sf, "events").select("event_id", "ts")
        d = search.ordered(d, [distance.DISTANCES[op](F.col("ts"), _literal("timestamp", KNN["timestamp"][5]), "timestamp")], "event_id", 25, ["distance"])
        return d.select("event_id", F.round("distance", 4).alias("distance"))

    return run


def _knn_topk_sql(op: str) -> str:
    a, b = KNN["timestamp"][6:]
    expression = {"<=>": f"abs({a} - {b})", "<=|": f"CASE WHEN {a} <= {b} THEN {b} - {a} END", "|=>": f"CASE WHEN {a} > {b} THEN {a} - {b} END"}[op]
    return f"SELECT event_id, round({expression} / 1000000.0, 4) AS distance FROM events WHERE {expression} IS NOT NULL ORDER BY {expression}, event_id LIMIT 25"


def _knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """A range on the same column as the distance, which reaches the scan."""
    d = _table(spark, sf, "part").where(F.col("p_size") < 10)
    return search.ordered(d, [distance.dist(F.col("p_size"), 10, "int4")], "p_partkey", 30, ["distance"]).select("p_partkey", "p_size", "distance")


def _knn_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    out = search.ordered(d, [distance.dist(F.col("p_size"), 20, "int4"), distance.left_dist(F.col("p_retailprice"), 950.0)], "p_partkey", 30, ["d1", "d2"])
    return out.select("p_partkey", "d1", _finite(F.col("d2")).alias("d2"))


def _knn_per_probe(spark: SparkSession, sf: str) -> DataFrame:
    """For each supplier, the three customers of its nation nearest in balance."""
    s = _table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    c = _table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    near = search.nearest_per_probe(s, c, ["nation"], distance.dist(F.col("c_acctbal"), F.col("s_acctbal")), "s_suppkey", "c_custkey", 3, values=("s_acctbal", "c_acctbal"))
    return near.select("s_suppkey", "c_custkey", F.round("distance", 4).alias("distance"), "rank")


#: Type -> (table, Spark column, Spark literal, SQL column, SQL literal).
_ADDRESS = "CAST(167772160 + (s_suppkey % 4) * 65536 + (s_suppkey % 256) * 256 + 1 AS BIGINT)"
_LENGTH = "CAST(16 + s_suppkey % 9 AS BIGINT)"
_INET_SQL = f"{{{{'network': {_ADDRESS} - {_ADDRESS} % CAST(pow(2, 32 - {_LENGTH}) AS BIGINT), 'masklen': {_LENGTH}, 'addr': {_ADDRESS}}}}}"


def _inet_text() -> Column:
    k = F.col("s_suppkey")
    return F.format_string("10.%d.%d.1/%d", k % 4, k % 256, 16 + k % 9)


def _inet_literal(text: str) -> Column:
    return scalar.inet_key(F.lit(text))


RANGES = {
    "int2": ("part", lambda: F.col("p_size").cast("smallint"), lambda: F.lit(25).cast("smallint"), "p_size", "25"),
    "int4": ("part", lambda: F.col("p_size"), lambda: F.lit(25), "p_size", "25"),
    "int8": ("orders", lambda: F.col("o_custkey"), lambda: F.lit(700).cast("long"), "o_custkey", "700"),
    "float4": ("customer", lambda: F.col("c_acctbal").cast("float"), lambda: F.lit(1863.84).cast("float"), "CAST(c_acctbal AS FLOAT)", "CAST(1863.84 AS FLOAT)"),
    "float8": ("customer", lambda: F.col("c_acctbal"), lambda: F.lit(1863.84), "c_acctbal", "CAST(1863.84 AS DOUBLE)"),
    "money": ("customer", lambda: F.col("c_acctbal").cast("decimal(19,2)"), lambda: F.lit("1863.84").cast("decimal(19,2)"), "CAST(c_acctbal AS DECIMAL(19,2))", "CAST('1863.84' AS DECIMAL(19,2))"),
    "oid": ("orders", lambda: F.col("o_orderkey"), lambda: F.lit(7000).cast("long"), "o_orderkey", "7000"),
    "timestamp": ("events", lambda: F.col("ts"), lambda: F.lit("2024-01-05 06:24:08").cast("timestamp_ntz"), "ts", "TIMESTAMP '2024-01-05 06:24:08'"),
    "timestamptz": ("orders", lambda: F.col("o_orderdate").cast("timestamp"), lambda: F.lit("1998-10-03").cast("timestamp"), "o_orderdate", "TIMESTAMP '1998-10-03 00:00:00'"),
    "date": ("orders", lambda: F.col("o_orderdate").cast("date"), lambda: F.lit("1998-10-03").cast("date"), "CAST(o_orderdate AS DATE)", "DATE '1998-10-03'"),
    "time": ("events", lambda: F.timestamp_diff("MICROSECOND", F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"), F.col("ts")), lambda: F.lit(23_048_000_000), "epoch_us(ts) % 86400000000", "23048000000"),
    "timetz": ("events", lambda: scalar.timetz_key(F.col("event_id") * 7_000_000 % 86_400_000_000, (F.col("event_id") % 5 * 3600).cast("int")), lambda: scalar.timetz_key(F.lit(23_048_000_000), F.lit(7200)),
               "{{'instant': event_id * 7000000 % 86400000000 + event_id % 5 * 3600000000, 'zone': CAST(event_id % 5 * 3600 AS INTEGER)}}", "{{'instant': CAST(30248000000 AS BIGINT), 'zone': CAST(7200 AS INTEGER)}}"),
    "interval": ("orders", lambda: scalar.interval_key(F.col("o_orderkey") % 3, F.col("o_orderkey") % 40, F.lit(0)), lambda: scalar.interval_key(F.lit(1), F.lit(10), F.lit(0)), "o_orderkey % 3 * 30 + o_orderkey % 40", "40"),
    "macaddr": ("customer", lambda: scalar.macaddr_key(F.format_string("22:00:5C:03:%02X:%02x", F.col("c_custkey") % 256, F.col("c_custkey") * 7 % 256)), lambda: scalar.macaddr_key(F.lit("22-00-5c-03-55-08")), "c_custkey % 256 * 256 + c_custkey * 7 % 256", "21768"),
    "inet": ("supplier", lambda: scalar.inet_key(_inet_text()), lambda: _inet_literal("10.2.34.1/20"), _INET_SQL, "{{'network': CAST(167911424 AS BIGINT), 'masklen': CAST(20 AS BIGINT), 'addr': CAST(167911937 AS BIGINT)}}"),
    "cidr": ("supplier", lambda: scalar.inet_key(F.format_string("10.%d.0.0/16", F.col("s_suppkey") % 4)), lambda: _inet_literal("10.2.0.0/16"), "s_suppkey % 4", "2"),
    "text": ("part", lambda: F.col("p_name"), lambda: F.lit("red widget"), "p_name", "'red widget'"),
    "varchar": ("part", lambda: F.col("p_brand"), lambda: F.lit("Brand#17"), "p_brand", "'Brand#17'"),
    "char": ("customer", lambda: F.substring("c_mktsegment", 1, 1), lambda: F.lit("F"), "substr(c_mktsegment, 1, 1)", "'F'"),
    "bytea": ("part", lambda: F.encode("p_name", "UTF-8"), lambda: F.encode(F.lit("red widget"), "UTF-8"), "encode(p_name)", "encode('red widget')"),
    "bit": ("part", lambda: F.lpad(F.bin("p_size"), 6, "0"), lambda: F.lit("011001"), "p_size", "25"),
    "varbit": ("part", lambda: F.bin("p_size"), lambda: F.lit("11001"), "bin(p_size)", "'11001'"),
    "numeric": ("orders", lambda: F.col("o_totalprice").cast("decimal(38,10)"), lambda: F.lit("112946.26").cast("decimal(38,10)"), "CAST(o_totalprice AS DECIMAL(38,10))", "CAST('112946.26' AS DECIMAL(38,10))"),
}
NAMES = (("<", "lt"), ("<=", "le"), ("=", "eq"), (">=", "ge"), (">", "gt"))


def _range(kind: str):
    table, column, literal, _, _ = RANGES[kind]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = _table(spark, sf, table).select(column().alias("a"), literal().alias("b"))
        return d.agg(*[F.count_if(scalar.compare(op, F.col("a"), F.col("b"))).alias(f"n_{name}") for op, name in NAMES])

    return run


def _range_sql(kind: str) -> str:
    table, _, _, a, b = RANGES[kind]
    a, b = a.replace("{{", "{").replace("}}", "}"), b.replace("{{", "{").replace("}}", "}")
    return "SELECT " + ", ".join(f"count(*) FILTER (WHERE ({a}) {op} ({b})) AS n_{name}" for op, name in NAMES) + f" FROM {table}"


def _range_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Both ends of a range, pushed to the scan."""
    d = _table(spark, sf, "orders")
    low, high = F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("1997-07-01").cast("timestamp_ntz")
    return d.where(scalar.between(F.col("o_orderdate"), low, high, high_open=True)).select("o_orderkey", "o_totalprice")


def _sets(spark: SparkSession, sf: str) -> DataFrame:
    """For each order, the set of its parts modulo 50, sorted."""
    lines = _table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 50).cast("int").alias("e"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("e")).alias("a"))


SETS_SQL = "s AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_partkey % 50 AS INTEGER)))) AS a FROM lineitem GROUP BY l_orderkey)"
PROBE = [1, 5, 9, 23, 40]
_I, _N, _M = "CAST(len(list_intersect(a, [1, 5, 9, 23, 40])) AS DOUBLE)", "CAST(len(a) AS DOUBLE)", "5.0"
SIMILAR_SQL = {"cosine": f"{_I} / sqrt({_N} * {_M})", "jaccard": f"{_I} / ({_N} + {_M} - {_I})", "overlap": _I}
#: Name -> (condition, SQL condition).
PREDICATES = {
    "arr_overlap": (lambda a: arrays.overlaps(a, [1, 2, 3]), "list_has_any(a, [1, 2, 3])"),
    "arr_contains": (lambda a: arrays.contains(a, [7, 7, 11]), "list_has_all(a, [7, 11])"),
    "arr_contained": (lambda a: arrays.contained(a, list(range(0, 50, 3)) + list(range(1, 50, 3))), "list_has_all([" + ", ".join(map(str, [*range(0, 50, 3), *range(1, 50, 3)])) + "], a)"),
    "arr_equal": (lambda a: arrays.equal(a, [7]), "a = [7]"),
    "arr_similar_cosine": (lambda a: arrays.similar(a, PROBE), f"{SIMILAR_SQL['cosine']} >= 0.5"),
    "arr_similar_jaccard": (lambda a: arrays.similar(a, PROBE, 0.3, "jaccard"), f"{SIMILAR_SQL['jaccard']} >= 0.3"),
    "arr_similar_overlap": (lambda a: arrays.similar(a, PROBE, 2, "overlap"), f"{SIMILAR_SQL['overlap']} >= 2"),
}


def _predicate(test):
    return lambda spark, sf: _sets(spark, sf).where(test(F.col("a"))).select("l_orderkey", F.size("a").alias("n"))


def _distances(spark: SparkSession, sf: str) -> DataFrame:
    d = [_finite(arrays.array_distance(F.col("a"), PROBE, f)).alias(f) for f in arrays.SIMILARITIES]
    return _sets(spark, sf).select("l_orderkey", *d)


def _distances_sql() -> str:
    one = lambda f: f"CASE WHEN {_I} = 0 THEN -1.0 ELSE round(1 / CASE WHEN {_I} = 0 THEN 1 ELSE {SIMILAR_SQL[f]} END, 4) END AS {f}"
    return f"WITH {SETS_SQL} SELECT l_orderkey, {', '.join(map(one, arrays.SIMILARITIES))} FROM s"


def _topk(spark: SparkSession, sf: str) -> DataFrame:
    d = _sets(spark, sf).where(arrays.overlaps(F.col("a"), PROBE))
    out = search.ordered(d, [F.round(arrays.array_distance(F.col("a"), PROBE), 6)], "l_orderkey", 20, ["distance"])
    return out.select("l_orderkey", F.round("distance", 4).alias("distance"))


def _token_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the similarity of their distinct words to a set of words."""
    from lexspark.functions import analyze

    d = _table(spark, sf, "documents").select("doc_id", F.array_distinct(analyze.tokens("text")).alias("a"))
    return d.where(arrays.similar(F.col("a"), ["the", "of", "and", "to", "in", "a"], 0.05, "jaccard")).select("doc_id", F.size("a").alias("n"))


def queries() -> dict:
    out = {f"knn_{k}": _knn(k) for k in KNN} | {f"knn_topk_{n}": _knn_topk(op) for op, n in (("<=>", "both"), ("<=|", "left"), ("|=>", "right"))}
    out |= {"knn_filtered": _knn_filtered, "knn_two_keys": _knn_two_keys, "knn_per_probe": _knn_per_probe}
    out |= {f"range_{k}": _range(k) for k in RANGES} | {"range_rows": _range_rows}
    out |= {name: _predicate(test) for name, (test, _) in PREDICATES.items()}
    return out | {"arr_distance": _distances, "arr_topk": _topk, "arr_token_sets": _token_sets}


def oracle_sql() -> dict:
    out = {f"knn_{k}": _knn_sql(k) for k in KNN} | {f"knn_topk_{n}": _knn_topk_sql(op) for op, n in (("<=>", "both"), ("<=|", "left"), ("|=>", "right"))}
    out["knn_filtered"] = "SELECT p_partkey, p_size, CAST(10 - p_size AS DOUBLE) AS distance FROM part WHERE p_size < 10 ORDER BY distance, p_partkey LIMIT 30"
    out["knn_two_keys"] = """SELECT p_partkey, d1, CASE WHEN d2 = CAST('inf' AS DOUBLE) THEN -1.0 ELSE round(d2, 4) END AS d2 FROM (
      SELECT p_partkey, CAST(abs(p_size - 20) AS DOUBLE) AS d1, CASE WHEN p_retailprice <= 950 THEN 950 - p_retailprice ELSE CAST('inf' AS DOUBLE) END AS d2 FROM part ORDER BY d1, d2, p_partkey LIMIT 30)"""
    out["knn_per_probe"] = """SELECT s_suppkey, c_custkey, round(distance, 4) AS distance, rank FROM (
      SELECT s_suppkey, c_custkey, abs(c_acctbal - s_acctbal) AS distance, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(c_acctbal - s_acctbal), c_custkey) AS INTEGER) AS rank
      FROM supplier JOIN customer ON s_nationkey = c_nationkey) WHERE rank <= 3"""
    out |= {f"range_{k}": _range_sql(k) for k in RANGES}
    out["range_rows"] = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-07-01'"
    out |= {name: f"WITH {SETS_SQL} SELECT l_orderkey, CAST(len(a) AS INTEGER) AS n FROM s WHERE {c}" for name, (_, c) in PREDICATES.items()}
    out["arr_distance"] = _distances_sql()
    out["arr_topk"] = f"WITH {SETS_SQL} SELECT l_orderkey, round(d, 4) AS distance FROM (SELECT l_orderkey, round(1 / ({SIMILAR_SQL['cosine']}), 6) AS d FROM s WHERE list_has_any(a, [1, 5, 9, 23, 40]) ORDER BY d, l_orderkey LIMIT 20)"
    i = "len(list_intersect(a, ['the', 'of', 'and', 'to', 'in', 'a']))"
    out["arr_token_sets"] = rf"WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS a FROM documents) SELECT doc_id, CAST(len(a) AS INTEGER) AS n FROM d WHERE len(a) > 0 AND CAST({i} AS DOUBLE) / (len(a) + 6 - {i}) >= 0.05"
    return out
