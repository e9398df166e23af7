"""Ordered retrieval from a table: match, filter, order by distances, top rows. One Catalyst plan, no index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(df: DataFrame, distances: Sequence[Column], key: str, limit: int | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Rows by ascending distances (nulls last), then by ``key`` so that the order is fixed.

    With ``limit`` Spark keeps a heap of that size per task (TakeOrderedAndProject): no full sort. Constant null
    distances order nothing. With ``names``, the distances stay as columns.
    """
    names = list(names or ())
    temporary = [f"__d{i}" for i in range(len(names), len(distances))]
    for name, d in zip([*names, *temporary], distances):
        df = df.withColumn(name, d)
    out = df.orderBy(*[F.col(n).asc_nulls_last() for n in [*names, *temporary]], F.col(key).asc_nulls_last())
    return (out.limit(limit) if limit is not None else out).drop(*temporary)


def search(df: DataFrame, where: Column | None = None, order_by: Sequence[Column] = (), key: str = "doc_id", limit: int | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """Rows where a predicate holds, in distance order if distances are given."""
    found = df.where(where) if where is not None else df
    if order_by:
        return ordered(found, order_by, key, limit, names)
    return found.limit(limit) if limit is not None else found


def nearest_per_probe(probes: DataFrame, rows: DataFrame, on: Sequence[str], distance: Column, probe_key: str, row_key: str, k: int, values: tuple[str, str] | None = None) -> DataFrame:
    """For each probe, its ``k`` nearest rows among those that agree on the columns ``on``.

    An equi-join and a ranked window per probe: Spark keeps ``k`` rows per probe before the shuffle (window group
    limit), so a hot join key costs comparisons, not shuffled rows. With ``values``, the numeric columns of a probe
    and of a row whose ``dist`` the distance is, a probe meets only its neighbours in the order of the values, not all
    rows of its key.
    """
    joined = lambda p: p.join(rows, list(on)).withColumn("distance", distance)
    w = Window.partitionBy(probe_key).orderBy(F.col("distance").asc_nulls_last(), F.col(row_key))
    if values is None:
        return joined(probes).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    columns = [*on, *[c for c in (*probes.columns, *rows.columns) if c not in on], "distance"]
    near = _neighbours(probes, rows, list(on), values, row_key, k).withColumn("distance", distance)
    by_distance = Window.partitionBy(probe_key).orderBy(F.col("distance").asc_nulls_last())
    near = near.withColumn("__tie", F.rank().over(by_distance)).where(F.col("__tie") <= k)
    near = near.withColumn("rank", F.row_number().over(w)).withColumn("__open", F.max("__edge").over(Window.partitionBy(probe_key)))
    found = near.where(~F.col("__open") & (F.col("rank") <= k)).select(*columns, "rank")
    # values so close that their distances are rounded to the same number: such probes meet all rows
    again = near.where("__open").select(F.col(probe_key).alias("__key")).distinct()
    again = joined(probes.join(again, F.col(probe_key).eqNullSafe(F.col("__key")), "left_semi"))
    return found.unionByName(again.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


#: Into how many stretches of values a key is cut at most, so that a hot key is numbered by many tasks.
CELLS = 1024


def _neighbours(probes: DataFrame, rows: DataFrame, on: list[str], values: tuple[str, str], row_key: str, k: int) -> DataFrame:
    """Pairs that hold each probe's ``k`` nearest rows: of ``k + 1`` values on each side, the ``k`` first rows of each.

    Values are numbered in order within their key: in cells of equal width first, then by the counts of the cells
    before. ``__edge`` marks the last value on each side. Rows without a finite value are candidates of every probe,
    and probes without one meet the first rows of each kind.
    """

    def kinds(df: DataFrame, value: str, name: str) -> DataFrame:
        v = F.col(f"`{value}`").cast("double")
        kind = F.when(v.isNull(), 2).when(F.isnan(v) | (F.abs(v) == float("inf")), 1).otherwise(0)
        df = df.select(*on, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name), kind.alias("__kind"), F.when(kind == 0, v).alias("__v"))
        return df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in on)) if on else df

    p, r = kinds(probes, values[0], "__probe"), kinds(rows, values[1], "__row")
    first = F.col(f"__row.`{row_key}`")
    r = r.withColumn("__i", F.row_number().over(Window.partitionBy(*on, "__kind", "__v").orderBy(first))).where(F.col("__i") <= k)

    # the finite values of both, in one order: a value before the probes that equal it
    ends = r.groupBy(*on).agg((F.min("__v") / 2).alias("__low"), (F.max("__v") / 2).alias("__high"))
    nothing = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)
    both = r.where("__kind = 0").select(*on, "__v", "__row", "__i", nothing(p, "__probe"))
    both = both.unionByName(p.where("__kind = 0").select(*on, "__v", nothing(r, "__row"), F.lit(k + 1).alias("__i"), "__probe")).join(ends, on)
    span = F.col("__high") - F.col("__low")
    at = F.when(span > 0, (F.col("__v") / 2 - F.col("__low")) / F.when(span > 0, span) * CELLS).otherwise(0.0)
    both = both.withColumn("__cell", F.floor(F.least(F.greatest(at, F.lit(0.0)), F.lit(CELLS - 1.0))).cast("int")).drop("__low", "__high")
    counts = both.groupBy(*on, "__cell").agg(F.count_if(F.col("__i") == 1).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*on).orderBy("__cell")) - F.col("__n")
    within = F.count_if(F.col("__i") == 1).over(Window.partitionBy(*on, "__cell").orderBy("__v", "__i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("__at", within).join(counts.select(*on, "__cell", before.alias("__before")), [*on, "__cell"]).withColumn("__at", F.col("__at") + F.col("__before"))

    sought = F.explode(F.sequence(F.lit(-k), F.lit(k + 1)))
    sought = both.where("__probe IS NOT NULL").select(*on, "__probe", "__at", sought.alias("__off"))
    sought = sought.select(*on, "__probe", (F.col("__at") + F.col("__off")).alias("__at"), F.col("__off").isin(-k, k + 1).alias("__edge"))
    near = sought.join(both.where("__row IS NOT NULL").select(*on, "__at", "__row"), [*on, "__at"]).select("__probe", "__row", "__edge")

    firsts = r.where("__kind = 0").withColumn("__i", F.row_number().over(Window.partitionBy(*on).orderBy(first))).where(F.col("__i") <= k)
    others = r.where("__kind > 0").select(*on, "__row").withColumn("__finite", F.lit(False)).unionByName(firsts.select(*on, "__row").withColumn("__finite", F.lit(True)))
    rest = p.join(others, on).where((F.col("__kind") > 0) | ~F.col("__finite")).select("__probe", "__row", F.lit(False).alias("__edge"))
    names = [F.col(f"__probe.`{c}`") for c in probes.columns] + [F.col(f"__row.`{c}`") for c in rows.columns if c not in on]
    return near.unionByName(rest).select(*names, "__edge")


def fuzzy_limit(df: DataFrame, limit: int, seed: int = 0) -> DataFrame:
    """A random share of a result that is expected to hold about ``limit`` rows; all rows if there are fewer.

    The share comes from a count, so the source is read twice. The same seed and partitions give the same rows.
    """
    if limit <= 0:
        return df
    n = df.count()
    return df if n <= limit else df.sample(fraction=limit / n, seed=seed)
