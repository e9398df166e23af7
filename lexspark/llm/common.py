"""What the operators share: the shared folder, written tables, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    A temporary folder stands in where the setting is absent and Spark runs in one process; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders of tables that ``written`` made in this session.
_FOLDERS: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    _FOLDERS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def dropped(df: DataFrame) -> None:
    """Deletes a table made by ``written`` once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _deleted(df.sparkSession, path)


def drop_written(spark: SparkSession) -> int:
    """Deletes all tables that this session's operators wrote; call it once their results are stored elsewhere."""
    paths, _FOLDERS[:] = list(_FOLDERS), []
    for path in paths:
        _deleted(spark, path)
    return len(paths)


def give_back() -> None:
    """Hands memory that this process has freed back to the system; Arrow's allocator and the C library's keep it otherwise."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # another C library
        pass


def lean(run):
    """``run``, a function for ``mapInArrow``, whose task gives back what it freed: workers live on into the next stages."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


#: Bytes of rows that Spark hands a Python worker at once. Both sides hold a batch as a whole; Spark's default is 64 MB.
ARROW_BYTES, ARROW_CONF = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python hold ``ARROW_BYTES``, unless the session has a size of its own. No row is left out."""
    if spark.conf.get(ARROW_CONF, None) is None:
        spark.conf.set(ARROW_CONF, ARROW_BYTES)


def bounded_sample(df: DataFrame, by: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hashes of ``by``; few more than that reach the driver.

    A threshold from the row count leaves about half as many again, whatever the number of partitions.
    """
    h = F.shiftrightunsigned(F.xxhash64(by), 1)
    n = df.count()
    if n > rows:
        df = df.where(h < min((1 << 63) - 1, int((1 << 63) * (1.5 * rows + 50) / n)))
    return df.orderBy(h).limit(rows)


def text_key(text: Column) -> Column:
    """128 bits that stand for a text: two independent 64-bit hashes."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _forest(batches):
    """Union-find over the edges of one partition: at most one edge per node is left, to its smallest peer."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.get(top, top) != top:
            top = parent[top]
        while parent.get(x, x) != top:
            parent[x], x = top, parent[x]
        return top

    def edges():
        nodes = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_pydict(
            {"u": pa.array(nodes, pa.int64()), "v": pa.array([root(x) for x in nodes], pa.int64())}
        )

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        if len(parent) > 1_000_000:  # memory stays bounded: what is known so far goes out as edges
            yield edges()
            parent = {}
    yield edges()


#: Edges that one task may hold at the end: a bound on memory, not on the graph.
LAST_EDGES = 500_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v: long): rows (node, component), component = smallest node.

    Every partition first reduces its edges to a forest. While more than ``LAST_EDGES`` are left, large-star and
    small-star steps contract the graph: grouped minima, combined before the shuffle, so a node with a
    third of all edges is harmless. What is left then is a forest that one task can finish. Each round is
    written to the shared folder. Nodes without an edge are not returned.
    """
    plain = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    current, before = written(plain.mapInArrow(_forest, "u long, v long"), "edges"), None
    for _ in range(max_rounds):
        if current.count() <= LAST_EDGES:
            last = written(current.coalesce(1).mapInArrow(_forest, "u long, v long"), "edges")
            dropped(current)
            return _stars(last)
        # large star: each node hands its larger neighbours to its smallest neighbour (or itself)
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each node hands its smaller neighbours, and itself, to the smallest of them
        down = large.where("u > v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = written(small.where("u <> v").distinct(), "edges")
        state = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        dropped(current)
        current = after
        if before == state:
            return _stars(current)
        before = state
    raise RuntimeError("components did not settle")


def _stars(edges: DataFrame) -> DataFrame:
    """(node, component) of edges that lead from each node to the smallest one of its component."""
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component")))


#: Bits of the filter that ``may_match`` builds: 256 rows of 4096 bytes at most, whatever the data.
FILTER_BITS = 1 << 23


def marked(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: may the hashed ``key`` be one of ``wanted``'s? True for all that are, and for few others while few are wanted.

    Keys are 64-bit hashes. The filter has a fixed size, so broadcasting it is safe at any scale.
    """
    slot = lambda c: F.col(c).bitwiseAND(FILTER_BITS - 1) + 1
    bits = wanted.groupBy(F.bitmap_bucket_number(slot(wanted_key)).alias("__b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot(wanted_key))).alias("__m"))
    bit = F.bitmap_bit_position(slot(key))
    byte = F.conv(F.hex(F.substr(F.col("__m"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0, F.lit(False))
    return df.join(F.broadcast(bits), F.bitmap_bucket_number(slot(key)) == F.col("__b"), "left").withColumn(name, hit).drop("__b", "__m")


def may_match(df: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """Rows of ``df`` that ``marked`` tells to be possible."""
    return marked(df, key, wanted, wanted_key, "__may").where("__may").drop("__may")
