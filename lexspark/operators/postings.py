"""Posting tables: an inverted index as Parquet, with appends, deletes, updates, compaction and inspection.

An index is a folder of generations; the newest numbered description ``meta-<n>.json`` names the current one. A
generation has numbered batches, one per build or append, of

* ``docs``: each row's key, its indexed columns and attached columns (negative queries, empty and null values, and
  exact checks need it),
* ``postings``: (col, bucket, term, key, category, pos | n, attached value), one row per distinct term of a row, in
  ``bucket`` folders by the hash of the term, sorted by term (or by attached value first) within files,

and ``deleted``: (key, until), the last batch in which a row of that key is gone. A key that is appended again later
is in a later batch, so an update is a delete and an append. ``compact`` starts a new generation; ``clean`` removes old ones.

A search reads the buckets and terms it names (partition pruning and pushed-down predicates), gathers the
terms of each row into a small vector, and evaluates the query on that: the same compiled column as
without an index, so both give the same rows.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import arrays, distance, match, rank
from lexspark.functions.tsquery import Node, Term, as_tree, has_phrase, requires_match, terms
from lexspark.functions.types import positions_text
from lexspark.operators.registry import CATEGORIES, CLASSES, EMPTY_ITEM, NORM_KEY, NULL_ITEM
from lexspark.operators.search import ordered

VERSION = 1


@dataclass
class Options:
    """How an index is laid out. ``columns`` maps an indexed column to its class."""

    key: str
    columns: dict[str, str]
    attach: str | None = None
    to: str | None = None
    order_by_attach: bool = False
    buckets: int = 64
    attached_kind: str = "float8"
    version: int = VERSION
    generation: str = field(default_factory=lambda: uuid.uuid4().hex)

    def check(self, df: DataFrame) -> None:
        for column, name in self.columns.items():
            if name not in CLASSES:
                raise ValueError(f"unknown class {name}")
            if column not in df.columns:
                raise ValueError(f"column {column!r} is not found in table")
            if CLASSES[name].attaches and (self.attach is None or self.to != column):
                raise ValueError(f"additional information column for {column!r} is not found in index")
        if (self.attach is None) != (self.to is None):
            raise ValueError("attach and to columns should be defined both")
        if self.attach is not None:
            if self.attach == self.to:
                raise ValueError("column and attached column cannot be the same")
            if self.attach not in df.columns:
                raise ValueError(f"attribute {self.attach!r} is not found in table")
            if self.to not in self.columns:
                raise ValueError(f"attribute {self.to!r} is not found in index")
        if self.order_by_attach and self.attach is None:
            raise ValueError("order_by_attach needs an attached column")


def hash_term(term: Column) -> Column:
    return F.xxhash64(term)


def _posting_rows(df: DataFrame, o: Options) -> list[DataFrame]:
    """Of each indexed column, one row per distinct term, and a placeholder row for each empty or null value.

    ``df`` is a stored table: each value is read once, and exploded once.
    """
    parts = []
    attached = F.col(f"`{o.attach}`") if o.attach else F.lit(None).cast("string")
    nothing = lambda kind: F.lit(None).cast(kind)
    for column, name in o.columns.items():
        c, value = CLASSES[name], F.col(f"`{column}`")
        here = attached if o.to == column else F.lit(None).cast(df.schema[o.attach].dataType if o.attach else "string")
        if c.family == "scalar":
            rows = df.select(F.col(f"`{o.key}`").alias("key"), F.when(value.isNull(), NULL_ITEM).otherwise(NORM_KEY).cast("tinyint").alias("category"), here.alias("attached"), value.cast("string").alias("term"))
            rows = rows.withColumn("pos", nothing("array<int>")).withColumn("n", nothing("int"))
        elif c.family in ("vector", "array"):
            items = value if c.family == "vector" else F.array_distinct(value)
            rows = df.select(F.col(f"`{o.key}`").alias("key"), here.alias("attached"), items.alias("items"))
            category = F.when(F.col("items").isNull(), NULL_ITEM).when(F.size("items") == 0, EMPTY_ITEM).otherwise(NORM_KEY).cast("tinyint")
            rows = rows.select("key", category.alias("category"), "attached", F.size("items").alias("n"), F.explode_outer("items").alias("x"))
            if c.family == "vector":
                rows = rows.withColumn("term", F.col("x.lexeme")).withColumn("pos", F.col("x.pos")).withColumn("n", nothing("int"))
            else:
                rows = rows.withColumn("term", F.col("x").cast("string")).withColumn("pos", nothing("array<int>")).withColumn("n", F.when(F.col("category") == NORM_KEY, F.col("n")))
        else:
            raise ValueError(f"class {name} is stored by the inverse operator")
        term = hash_term(F.col("term")).cast("string") if c.hashed else F.col("term")
        rows = rows.select(F.lit(column).alias("col"), F.when(F.col("category") == NORM_KEY, term).alias("term"), "key", "category", "pos", "n", "attached")
        parts.append(rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(o.buckets)).cast("int")))
    return parts


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    jvm, fs = _files(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []


def _batch(spark: SparkSession, path: str, o: Options) -> int:
    """The number of the next batch."""
    return 1 + max((int(n[6:]) for n in _names(spark, f"{path}/{o.generation}/docs") if n.startswith("batch=")), default=-1)


#: MB of stored rows from which one posting file is made where buckets are dealt to tasks, and from which a task makes
#: posting rows where each sorts its own; a task's sort holds about 20 times as much.
FILE_MB, TASK_MB = 16, 12
#: With so many buckets at most, posting rows are not shuffled: a task writes a file to each.
FEW_BUCKETS = 16


def _stored_mb(spark: SparkSession, path: str) -> float:
    jvm, fs = _files(spark, path)
    return fs.getContentSummary(jvm.org.apache.hadoop.fs.Path(path)).getLength() / 1e6


def _in_small_tasks(spark: SparkSession, stored: str) -> SparkSession:
    """A session like this one that reads ``stored`` in tasks of ``TASK_MB`` at most, and in enough for all cores."""
    out, mb = spark.newSession(), min(TASK_MB, max(1, _stored_mb(spark, stored) / spark.sparkContext.defaultParallelism / 2))
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            out.conf.set(k, v)
    out.conf.set("spark.sql.files.maxPartitionBytes", str(int(mb * 1e6)))
    out.conf.set("spark.sql.files.openCostInBytes", "0")
    return out


def _salts(spark: SparkSession, stored: str, o: Options) -> int:
    """Into how many files each bucket goes: up to 4 while these are small, and then as many as keep their size."""
    mb = _stored_mb(spark, stored) / o.buckets
    return max(1, min(4, math.ceil(mb)), math.ceil(mb / FILE_MB))


def _write(df: DataFrame, path: str, o: Options) -> None:
    """Writes the rows first, so that what their columns cost is paid once, and posting rows from what was written."""
    spark, number = df.sparkSession, _batch(df.sparkSession, path, o)
    keep = dict.fromkeys([o.key, *o.columns, *([o.attach] if o.attach else [])])
    rows = df.select(*[F.col(f"`{c}`") for c in keep])
    stored, target = (f"{path}/{o.generation}/{name}/batch={number}" for name in ("docs", "postings"))
    rows.write.option("parquet.block.size", 16 << 20).parquet(stored)
    sort = ["term", "attached", "key"] if o.order_by_attach else ["term", "key"]
    if o.buckets <= FEW_BUCKETS:  # each task's own rows: nothing is shuffled, and a hot term is split as the rows are
        for part, column in zip(_posting_rows(_in_small_tasks(spark, stored).read.schema(rows.schema).parquet(stored), o), o.columns):
            # what is the same in all rows is left out of the sort
            family, order = CLASSES[o.columns[column]].family, [c for c in sort if c != "attached" or o.to == column]
            same = {"col"} | ({"n"} if family != "array" else set()) | ({"pos"} if family != "vector" else set()) | ({"attached"} if o.to != column else set())
            out = part.drop(*same).sortWithinPartitions("bucket", *order)
            out = out.select(*[(F.lit(column) if c == "col" else F.lit(None).cast(part.schema[c].dataType)).alias(c) if c in same else F.col(c) for c in part.columns])
            out.write.mode("append").partitionBy("bucket").parquet(target)
    else:  # few files per bucket, and a hot term is still split: salted by a hash of the row key. A task has one bucket's share
        salts = _salts(spark, stored, o)
        part = (F.col("bucket") * salts + F.pmod(F.xxhash64("key"), F.lit(salts))).cast("int")
        out = reduce(DataFrame.unionByName, _posting_rows(spark.read.schema(rows.schema).parquet(stored), o)).repartitionById(o.buckets * salts, part)
        out.sortWithinPartitions("bucket", "col", *sort).write.partitionBy("bucket").parquet(target)


def _newest(spark: SparkSession, path: str) -> int:
    return max((int(n[5:-5]) for n in _names(spark, path) if n.startswith("meta-") and n.endswith(".json")), default=0)


def _point(spark: SparkSession, path: str, o: Options) -> None:
    """Makes a generation current by one more description. It appears whole, by a rename, and none is taken away."""
    jvm, fs = _files(spark, path)
    new, last = jvm.org.apache.hadoop.fs.Path(f"{path}/meta-{o.generation}.tmp"), jvm.org.apache.hadoop.fs.Path(f"{path}/meta-{_newest(spark, path) + 1}.json")
    out = fs.create(new, True)
    out.write(json.dumps(o.__dict__).encode())
    out.close()
    if not fs.rename(new, last):
        raise RuntimeError("another writer changed the index")


def build_index(
    df: DataFrame, path: str, columns: dict[str, str], key: str = "doc_id", attach: str | None = None, to: str | None = None, order_by_attach: bool = False, buckets: int = 64, attached_kind: str = "float8",
) -> PostingIndex:
    """Writes an index of ``columns`` (column -> class name) and opens it."""
    o = Options(key, columns, attach, to, order_by_attach, buckets, attached_kind)
    o.check(df)
    _write(df, path, o)
    _point(df.sparkSession, path, o)
    return PostingIndex(df.sparkSession, path)


class PostingIndex:
    """A posting table that can be searched, changed and inspected."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm, fs = _files(spark, path)
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(f"{path}/meta-{_newest(spark, path)}.json"))
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        self.options = Options(**json.loads(text))
        if self.options.version != VERSION:
            raise ValueError("unexpected index version, build it anew")

    # -- reading

    def _folder(self, name: str) -> str:
        return f"{self.path}/{self.options.generation}/{name}"

    def _deleted(self) -> DataFrame | None:
        """(key, until) of deleted rows."""
        if "deleted" not in _names(self.spark, f"{self.path}/{self.options.generation}"):
            return None
        return self.spark.read.parquet(self._folder("deleted")).groupBy("key").agg(F.max("until").alias("until"))

    def _live(self, df: DataFrame, key: str) -> DataFrame:
        gone = self._deleted()
        if gone is not None:
            gone = gone.select(F.col("key").alias("__key"), "until")
            df = df.join(gone, (F.col(f"`{key}`") == F.col("__key")) & (F.col("batch") <= F.col("until")), "left_anti")
        return df.drop("batch")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(self._folder("docs"))

    def docs(self) -> DataFrame:
        return self._live(self._stored(), self.options.key)

    def _rows(self) -> DataFrame:
        """All posting rows. The schema is given: an index of no rows has no files to tell it."""
        kinds, o = dict(self._stored().dtypes), self.options
        kind = kinds[o.attach] if o.attach else "string"
        schema = f"col string, term string, key {kinds[o.key]}, category tinyint, pos array<int>, n int, attached {kind}, batch int, bucket int"
        return self.spark.read.schema(schema).parquet(self._folder("postings"))

    def postings(self, column: str | None = None, term: str | None = None) -> DataFrame:
        """Posting rows, of one column or one term."""
        rows = self._rows()
        if column is not None:
            rows = rows.where(F.col("col") == column)
        if term is not None:
            if column is not None and CLASSES[self.options.columns[column]].hashed:
                term = str(self.spark.range(1).select(hash_term(F.lit(term))).first()[0])
            bucket = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(term)), F.lit(self.options.buckets))).first()[0]
            rows = rows.where((F.col("bucket") == bucket) & (F.col("term") == term))
        return self._live(rows, "key")

    def _hits(self, column: str, operands: Sequence[Term]) -> DataFrame:
        """Posting rows of the operands' terms, named by the lexeme asked for in hashed classes."""
        c, o = CLASSES[self.options.columns[column]], self.options
        rows = self._rows().where((F.col("col") == column) & (F.col("category") == NORM_KEY))
        exact, prefixes = sorted({t.lexeme for t in operands if not t.prefix}), sorted({t.lexeme for t in operands if t.prefix})
        if c.hashed and prefixes:
            raise ValueError("compare with prefix expressions isn't supported")
        condition = F.lit(False)
        if exact:
            names = exact
            if c.hashed:
                hashes = self.spark.range(1).select(*[hash_term(F.lit(x)) for x in exact]).first()
                names = [str(h) for h in hashes]
                back = F.create_map(*[F.lit(x) for pair in zip(names, exact) for x in pair])
            buckets = sorted({r for r in self.spark.range(1).select(*[F.pmod(F.xxhash64(F.lit(x)), F.lit(o.buckets)).cast("int") for x in names]).first()})
            condition = F.col("bucket").isin(buckets) & F.col("term").isin(names)
        for p in prefixes:
            condition = condition | F.startswith(F.col("term"), F.lit(p))
        rows = rows.where(condition)
        if c.hashed and exact:
            rows = rows.withColumn("term", back[F.col("term")])
        return self._live(rows, "key")

    def _gathered(self, column: str, node: Node) -> DataFrame:
        """(key, v): the query's part of each row's vector, for rows that hold any of its operands."""
        item = F.struct(F.col("term").alias("lexeme"), F.col("pos").alias("pos"))
        return self._hits(column, list(terms(node))).groupBy("key").agg(F.array_sort(F.collect_set(item)).alias("v"), F.first("attached").alias("attached"))

    def _matching(self, column: str, query: str | Node | None) -> DataFrame:
        """(key, attached) of rows whose vector matches. Where presence decides, a row is one number and places are not read."""
        node = as_tree(query)
        operands = list(dict.fromkeys(terms(node))) if node is not None else []
        if node is None or not requires_match(node) or len(operands) > 63 or has_phrase(node) or any(t.mask for t in operands):
            return self.match(column, query).select("key", "attached")
        named = lambda t: F.startswith(F.col("term"), F.lit(t.lexeme)) if t.prefix else F.col("term") == t.lexeme
        bits = [F.when(named(t), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, t in enumerate(operands)]
        hits = self._hits(column, operands).withColumn("bits", reduce(Column.bitwiseOR, bits))
        hits = hits.groupBy("key").agg(F.bit_or("bits").alias("bits"), F.first("attached").alias("attached"))
        return hits.where(match.compile_match(node, match.BitSource(F.col("bits"), operands))).select("key", "attached")

    def match(self, column: str, query: str | Node) -> DataFrame:
        """(key, attached, v) of rows whose vector matches; queries that hold without any operand read ``docs``."""
        node, o = as_tree(query), self.options
        if node is None:
            return self.docs().where("false").select(F.col(o.key).alias("key"), F.lit(None).alias("attached"), F.lit(None).alias("v"))
        c = CLASSES[o.columns[column]]
        if c.hashed and any(t.prefix for t in terms(node)):
            raise ValueError("compare with prefix expressions isn't supported")
        if not requires_match(node):
            attached = F.col(f"`{o.attach}`") if o.attach else F.lit(None)
            vector = F.col(f"`{column}`")
            return self.docs().where(vector.isNotNull() & match.matches(vector, node)).select(F.col(f"`{o.key}`").alias("key"), attached.alias("attached"), vector.alias("v"))
        return self._gathered(column, node).where(match.matches("v", node))

    # -- searching

    def search(self, where: dict[str, str] | None = None, filters: Column | None = None, order_by: Sequence[tuple] = (), limit: int | None = None) -> DataFrame:
        """Rows of ``docs`` that match, with ``distance`` columns if ordered.

        ``where``: column -> query (vector columns) or (operator, array) (array columns); all must hold.
        ``filters``: a predicate over attached or scalar columns. ``order_by``: (operator, column, value) in order of
        importance; for a vector column the value is a query, or a DistanceQuery. Missing attached values are infinitely
        far. Equal distances are ordered by key.
        """
        o = self.options
        found, known = None, False  # known: ``found`` has the attached value
        for column, query in (where or {}).items():
            family = CLASSES[o.columns[column]].family
            hits = self._matching(column, query) if family == "vector" else self.match_array(column, *query)
            own = family == "vector" and column == o.to and not known
            hits = hits.select(F.col("key").alias(o.key), *([F.col("attached").alias(o.attach)] if own else []))
            if found is None:
                found = hits
            else:
                found = hits.join(found, o.key, "left_semi") if own else found.join(hits, o.key, "left_semi")
            known = known or own
        if known and filters is not None:
            try:  # a predicate over the attached column alone holds for posting rows
                found, filters = found.where(filters), None
            except AnalysisException:
                pass
        names = ["distance", *[f"distance{i}" for i in range(2, len(order_by) + 1)]]
        if known and filters is None and limit is not None and order_by and all(column == o.attach for _, column, _ in order_by):
            # the nearest rows are known from postings; only these are fetched
            near = ordered(found, [self._distance(*x) for x in order_by], o.key, limit, names).select(F.col(f"`{o.key}`").alias("__key"), *names)
            rows = self.docs().join(near, F.col(f"`{o.key}`") == F.col("__key")).drop("__key")
            return rows.orderBy(*[F.col(n).asc_nulls_last() for n in names], F.col(f"`{o.key}`").asc_nulls_last()).limit(limit)
        if known:
            found = found.select(o.key)
        rows = self.docs() if found is None else self.docs().join(found, o.key, "left_semi")
        if filters is not None:
            rows = rows.where(filters)
        if not order_by:
            return rows.limit(limit) if limit is not None else rows
        return ordered(rows, [self._distance(*x) for x in order_by], o.key, limit, names)

    def _distance(self, op: str, column: str, value) -> Column:
        o = self.options
        name = o.columns.get(column)
        family = CLASSES[name].family if name else "scalar"
        if family == "vector":
            return rank.ts_distance(F.col(f"`{column}`"), value)
        if family == "array":
            return arrays.array_distance(F.col(f"`{column}`"), value)
        if column == o.attach:
            return distance.attached_distance(F.col(f"`{column}`"), value, o.attached_kind, op)
        if name and not CLASSES[name].order:
            raise ValueError(f"class {name} doesn't support ordering")
        return distance.DISTANCES[op](F.col(f"`{column}`"), value, name or "float8")

    def match_array(self, column: str, op: str, values: Sequence, threshold: float = 0.5, function: str = "cosine") -> DataFrame:
        """(key) of rows whose array relates to ``values``: && @> <@ = %. Counts of shared elements decide; = is checked on the row."""
        o, c = self.options, CLASSES[self.options.columns[column]]
        if op not in c.match:
            raise ValueError(f"operator {op} is not in class {c.name}")
        if any(v is None for v in values):
            raise ValueError("array must not contain nulls")
        wanted = {str(v) for v in values}
        docs = self.docs().where(F.col(f"`{column}`").isNotNull())
        key = F.col(f"`{o.key}`").alias("key")
        if op == "<@" or not wanted:  # empty arrays have no postings
            value = F.col(f"`{column}`")
            literal = F.array(*[F.lit(v) for v in values]).cast(dict(docs.dtypes)[column])
            test = {"&&": arrays.overlaps, "@>": arrays.contains, "<@": arrays.contained, "=": arrays.equal, "%": lambda a, b: arrays.similar(a, b, threshold, function)}[op]
            return docs.where(test(value, literal)).select(key)
        hits = self._hits(column, [Term(w) for w in wanted]).groupBy("key").agg(F.count("*").alias("i"), F.first("n").alias("n"))
        m = len(wanted)
        if op == "&&":
            return hits.select("key")
        if op == "@>":
            return hits.where(F.col("i") == m).select("key")
        if op == "=":
            literal = F.array(*[F.lit(v) for v in values]).cast(dict(docs.dtypes)[column])
            close = hits.where((F.col("i") == m) & (F.col("n") == m)).select(F.col("key").alias(o.key))
            return docs.join(close, o.key, "left_semi").where(F.col(f"`{column}`") == literal).select(key)
        i, n = F.col("i").cast("double"), F.col("n").cast("double")
        value = {"cosine": i / F.sqrt(n * m), "jaccard": i / (n + m - i), "overlap": i}[function]
        return hits.where(value >= threshold).select("key")

    # -- changing

    def append(self, df: DataFrame) -> PostingIndex:
        """Adds rows as a further batch; keys must be new, or deleted before."""
        self.options.check(df)
        _write(df, self.path, self.options)
        return self

    def delete(self, keys: DataFrame) -> PostingIndex:
        """Marks the rows of ``keys`` (its first column) that the index has now as deleted."""
        until = _batch(self.spark, self.path, self.options) - 1
        keys.select(F.col(keys.columns[0]).alias("key"), F.lit(until).alias("until")).write.mode("append").parquet(self._folder("deleted"))
        return self

    def update(self, df: DataFrame) -> PostingIndex:
        """Puts the rows of ``df`` in place of those with the same keys."""
        self.options.check(df)
        return self.delete(df.select(F.col(f"`{self.options.key}`"))).append(df)

    def compact(self) -> PostingIndex:
        """Writes a new generation from the live rows and makes it current; readers of the old one are not disturbed."""
        new = Options(**{**self.options.__dict__, "generation": uuid.uuid4().hex})
        _write(self.docs(), self.path, new)
        _point(self.spark, self.path, new)
        return PostingIndex(self.spark, self.path)

    def clean(self) -> int:
        """Removes all generations but the current one, and their descriptions. No reader may use them any more."""
        jvm, fs = _files(self.spark, self.path)
        newest = PostingIndex(self.spark, self.path).options.generation
        keep = {newest, f"meta-{_newest(self.spark, self.path)}.json"}
        gone = [n for n in _names(self.spark, self.path) if n not in keep]
        for n in gone:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)
        return sum(not n.startswith("meta-") for n in gone)

    # -- inspecting

    def stats(self) -> DataFrame:
        """One row: version, rows, postings, distinct terms, placeholder rows, deleted rows, files."""
        # one row per term first: a count of distinct terms beside other sums would keep all posting rows' keys apart
        p = self.postings().groupBy("col", "term", "category").agg(F.count("*").alias("n"))
        rows = self.docs().agg(F.countDistinct(F.col(f"`{self.options.key}`")).alias("n_rows"))
        here = F.col("category") == NORM_KEY
        gone = self._deleted()
        files = len(self._rows().inputFiles())
        p = p.agg(F.sum(F.when(here, F.col("n")).otherwise(0)).alias("n_postings"), F.count_if(here).alias("n_terms"), F.sum(F.when(~here, F.col("n")).otherwise(0)).alias("n_placeholders"))
        n_deleted, n_files = F.lit(gone.count() if gone is not None else 0).cast("long").alias("n_deleted"), F.lit(files).cast("long").alias("n_files")
        return rows.crossJoin(p).select(F.lit(self.options.version).alias("version"), "n_rows", "n_postings", "n_terms", "n_placeholders", n_deleted, n_files)

    def partitions(self) -> DataFrame:
        """Per bucket: postings, distinct terms, first and last term."""
        terms_ = self.postings().groupBy("bucket", "term").agg(F.count("*").alias("n"))
        return terms_.groupBy("bucket").agg(F.sum("n").alias("n_postings"), F.count("term").alias("n_terms"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))

    def entries(self) -> DataFrame:
        """Per (column, term, category): rows, and the first row key."""
        names = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
        return self.postings().groupBy("col", "term", names[F.col("category").cast("int")].alias("category")).agg(F.count("*").alias("n_rows"), F.min("key").alias("first_key"))

    def items(self, column: str, term: str) -> DataFrame:
        """The posting list of a term, with positions and attached values as text."""
        return self.postings(column, term).select("key", positions_text(F.col("pos")).alias("positions"), F.col("attached").cast("string").alias("attached"))


def term_keys(index: PostingIndex, column: str, term: str) -> DataFrame:
    """Keys of rows that hold a term: the operand of set operations on postings."""
    return index._hits(column, [Term(term)]).select("key").distinct()

