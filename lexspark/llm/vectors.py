"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, exact reranking.

A rotation is learnt (on a bounded sample) that maps centred vectors to balanced binary codes. A code is cut
into disjoint segments, and each segment is a table: vectors of one label that agree on it meet in a bucket, where
the Hamming distance of their whole codes decides which of them are candidates. Segments grow with the number
of vectors, so buckets keep their size; codes by further rotations are added until the recall, measured on pairs
at just the threshold, is reached.

Tables hold codes only. Vectors travel to the buckets where they have a candidate, and cosines are taken in
double precision there. Equal vectors are one node with a count. A bucket is never turned into pairs: its task
adds up links per node and emits a spanning forest. A pair found by several tables counts in the first of them,
which both codes tell. Buckets of more than ``BLOCK`` nodes are dealt in blocks, and each pair of blocks is a task's share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import bounded_sample, components, may_match, written

#: Bits of a code, nodes of a block, nodes that a bucket should hold, and the most codes that are tried for the recall.
BITS, BLOCK, PER_BUCKET, MOST_CODES = 64, 1024, 16, 64


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): signs of (x - mean) @ projection are the code of a unit vector x."""
    mean = sample.mean(0)
    centred = sample - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, : min(bits, sample.shape[1])]
    v = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(axes.shape[1],) * 2))[0]
    for _ in range(rounds):
        codes = np.where(v @ rotation >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(codes.T @ v)
        rotation = (u @ w).T
    return mean, axes @ rotation


def codes_of(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = (x - mean) @ projection >= 0
    weights = np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64)
    return (bits * weights).sum(1, dtype=np.uint64)


@dataclass
class Tables:
    """Codes of vectors of one size, and the tables over their segments: (code, mask) each. ``recall`` is as measured."""

    mean: np.ndarray
    projections: list[np.ndarray]
    tables: list[tuple[int, int]]
    radius: int
    recall: float

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One row per vector, one column per code."""
        return np.stack([codes_of(x, self.mean, p) for p in self.projections], axis=1)

    def found(self, left: np.ndarray, right: np.ndarray, t: int) -> np.ndarray:
        """Which pairs of codes table ``t`` finds: they agree on its segment, and their codes are close."""
        code, mask = self.tables[t]
        differ = left[:, None, code] ^ right[None, :, code]
        return ((differ & np.uint64(mask)) == 0) & (np.bitwise_count(differ) <= self.radius)

    def first_found(self, left: np.ndarray, right: np.ndarray, t: int) -> np.ndarray:
        """Pairs that table ``t`` is the first one to find."""
        now = self.found(left, right, t)
        a, b = np.nonzero(now)
        if len(a):
            fresh = np.ones(len(a), bool)
            for code, mask in self.tables[:t]:
                differ = left[a, code] ^ right[b, code]
                fresh &= ~(((differ & np.uint64(mask)) == 0) & (np.bitwise_count(differ) <= self.radius))
            now[a, b] = fresh
        return now


def fit_tables(size: int, sample: np.ndarray | None, n: int, cosine: float, recall: float = 0.998) -> Tables:
    """Tables for unit vectors of ``size`` numbers, of which a label holds up to ``n``; without a sample, for any directions."""
    pick = np.random.default_rng(size)
    if sample is None:
        sample = _unit(pick.normal(size=(64 * BITS, size)))
    sample, seen = sample[::2], sample[1::2]  # a rotation keeps the vectors it is learnt from clear of its planes: others measure
    u = pick.normal(size=seen.shape)
    u -= (u * seen).sum(1, keepdims=True) * seen
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-300)
    partner = cosine * seen + math.sqrt(max(0.0, 1 - cosine * cosine)) * u  # pairs at just the threshold
    width = min(BITS, max(6, math.ceil(math.log2(max(2, n / PER_BUCKET)))))
    cuts = np.linspace(0, BITS, BITS // width + 1).astype(int).tolist()
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    missed, out = np.ones(len(seen), bool), None
    for k in range(MOST_CODES):
        parts = [learn_rotation(sample, seed=k * BITS + j) for j in range(-(-BITS // min(BITS, size)))]
        mean, projection = parts[0][0], np.concatenate([p[1] for p in parts], axis=1)[:, :BITS]
        differ = codes_of(seen, mean, projection) ^ codes_of(partner, mean, projection)
        distance = np.bitwise_count(differ)
        if out is None:
            out = Tables(mean, [], [], int(distance.max()), 0.0)
        out.projections.append(projection)
        out.tables += [(k, m) for m in masks]
        for m in masks:
            missed &= ~(((differ & np.uint64(m)) == 0) & (distance <= out.radius))
        out.recall = 1 - float(missed.mean())
        if out.recall >= recall:
            break
    return out


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, rows, unit vectors) of a list column."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, _unit(flat[starts[rows][:, None] + np.arange(size)])


def _packed(codes: np.ndarray) -> pa.Array:
    n, width = codes.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * 8 * width).astype(np.int32).tobytes()), pa.py_buffer(codes.astype("<u8").tobytes())])


def _unpacked(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u8").reshape(len(raw), -1)


class _Fitted(dict):
    """Tables by vector size; a size that the sample lacks gets the same ones in each task."""

    def __init__(self, known: dict[int, Tables], n: int, cosine: float):
        super().__init__(known)
        self.n, self.cosine = n, cosine

    def __missing__(self, size: int) -> Tables:
        self[size] = found = fit_tables(size, None, self.n, self.cosine)
        return found


def _encode(model):
    """Rows (bucket, size, t, node, codes): one for each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, x in _matrices(batch.column("v")):
                fitted = model.value[size]
                codes = fitted.codes(x)
                place, nodes, packed = batch.column("place").to_numpy()[rows].view(np.uint64), pa.array(batch.column("node").to_numpy()[rows]), _packed(codes)
                for t, (code, mask) in enumerate(fitted.tables):
                    h = (place ^ np.uint64(t * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93) ^ (codes[:, code] & np.uint64(mask))
                    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
                    fixed = [pa.array(np.full(len(rows), v, np.int32)) for v in (size, t)]
                    yield pa.RecordBatch.from_arrays([pa.array((h ^ (h >> np.uint64(29))).view(np.int64)), *fixed, nodes, packed], ["bucket", "size", "t", "node", "codes"])

    return run


KEYS = ["bucket", "size", "t", "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of each key in turn; they arrive together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in KEYS], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(keys[a].tolist())
            if key != last:
                if held:
                    yield last, pa.Table.from_batches(held).combine_chunks()
                held, last = [], key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _sides(key: tuple, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are compared: all with all in one block, one block with the other else."""
    every = np.arange(len(side))
    return (every, every) if key[3] == key[4] else (np.flatnonzero(~side), np.flatnonzero(side))


def _candidates(model):
    """Rows of nodes that have a candidate among those they meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches):
            if rows.num_rows < 2:
                continue
            left, right = _sides(key, _one(rows, "side").to_numpy(zero_copy_only=False))
            codes = _unpacked(_one(rows, "codes"))
            close = model.value[key[1]].first_found(codes[left], codes[right], key[2])
            if key[3] == key[4]:
                np.fill_diagonal(close, False)
            some = np.union1d(left[close.any(1)], right[close.any(0)])
            if len(some):
                yield from rows.take(pa.array(some)).to_batches()

    return run


def _links(model, cosine: float):
    """Rows (node, links, null): links counted by their weights, and (node, null, peer): stars that join linked nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches):
            nodes, n, labels = (_one(rows, c).to_numpy(zero_copy_only=False) for c in ("node", "n", "label"))
            codes, side = _unpacked(_one(rows, "codes")), _one(rows, "side").to_numpy(zero_copy_only=False)
            ((_, _, x),) = _matrices(_one(rows, "v"))
            left, right = _sides(key, side)
            close = model.value[key[1]].first_found(codes[left], codes[right], key[2]) & (labels[left][:, None] == labels[right][None, :])
            close &= x[left] @ x[right].T >= cosine
            if key[3] == key[4]:
                np.fill_diagonal(close, False)
            links = np.zeros(len(nodes), np.int64)
            links[left] += close @ n[right]
            if key[3] != key[4]:
                links[right] += close.T @ n[left]
            both = np.zeros((len(nodes), len(nodes)), bool)
            both[np.ix_(left, right)] = close
            both |= both.T
            open_, u, v = both.any(1), [], []
            while open_.any():  # one star per connected group
                group, edge, start = np.zeros(len(nodes), bool), np.zeros(len(nodes), bool), int(open_.argmax())
                edge[start] = True
                while edge.any():
                    group |= edge
                    edge = both[edge].any(0) & ~group
                members = np.flatnonzero(group)
                u += nodes[members[members != start]].tolist()
                v += [int(nodes[start])] * (len(members) - 1)
                open_ &= ~group
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*nodes[some].tolist(), *u], pa.int64()), pa.array([*links[some].tolist(), *[None] * len(u)], pa.int64()), pa.array([*[None] * len(some), *v], pa.int64())], ["node", "links", "peer"]
            )

    return run


def fitted_tables(nodes: DataFrame, cosine: float, sample: int) -> _Fitted:
    """Tables for each vector size among ``nodes`` (node, label, v), fitted on at most ``sample`` of them."""
    most = nodes.groupBy("label", F.size("v").alias("size")).agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    by_size: dict[int, list] = {}
    for r in bounded_sample(nodes.select("node", "v"), F.col("node"), sample).collect():
        by_size.setdefault(len(r.v), []).append(r.v)
    return _Fitted({size: fit_tables(size, _unit(x), most, cosine) for size, x in by_size.items() if len(x) >= 2 * BITS}, most, cosine)


def near_vectors(df: DataFrame, vector_col: str = "embedding", label_col: str = "label", id_col: str = "vec_id", cosine: float = 0.98, sample: int = 8192) -> DataFrame:
    """One row per row of ``df``: (id: long, n_links: long, component_id: long, kept: boolean).

    Vectors link when their labels are equal and not null and their cosine is at least ``cosine``. Vectors that
    are null, empty, zero, or hold nulls or values that are not finite link with nothing; so do rows without an
    id. Vectors of different sizes link with nothing. Links are exact; tables are added until they find 0.998 of
    pairs at just the threshold (measured on half of the sample, each vector with a partner at that cosine, while the
    other half fits), and more above it.
    ``sample`` vectors at most (those with the smallest hashes) fit the rotations; all are indexed.
    """
    spark = df.sparkSession
    v = F.col("v")
    kept = df.schema[vector_col].dataType.simpleString()
    kept = kept if kept in ("array<float>", "array<double>") else "array<double>"
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").cast(kept).alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce((F.size(v) > 0) & finite, F.lit(False))
    rows = rows.withColumn("node", F.when(valid, F.shiftrightunsigned(F.xxhash64("label", "v"), 1)))
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.first("label").alias("label"), F.first("v").alias("v")), "vectors")
    model = spark.sparkContext.broadcast(fitted_tables(nodes, cosine, sample))

    codes = nodes.select("node", F.xxhash64("label", F.size("v")).alias("place"), "v").mapInArrow(_encode(model), "bucket long, size int, t int, node long, codes binary")
    codes = written(codes, "codes")
    large = written(codes.groupBy("bucket", "size", "t").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("bucket", "size", "t", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "large")
    met = codes.join(large, ["bucket", "size", "t"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("bucket", "size", "t", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "node", "codes")
    near = met.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(_candidates(model), "bucket long, size int, t int, i int, j int, side boolean, node long, codes binary")
    near = written(near, "candidates")
    named = may_match(nodes.select("node", "n", "label", "v"), "node", near, "node").withColumnRenamed("node", "p")
    full = near.join(named, F.col("node") == F.col("p")).drop("p").repartition(*KEYS).sortWithinPartitions(*KEYS)
    found = written(full.mapInArrow(_links(model, cosine), "node long, links long, peer long"), "vector_links")

    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(found.where("peer is not null").select(F.col("node").alias("u"), F.col("peer").alias("v")))
    known = nodes.select("node", "n", "id").join(links, "node", "left").join(classes, "node", "left").withColumn("label", F.coalesce("component", "node"))
    least = written(known.groupBy("label").agg(F.min("id").alias("component_id")), "least")
    known = known.join(least, "label").select("node", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    own = rows.select("id", "node").join(known, "node", "left")
    component = F.coalesce("component_id", "id")
    return own.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op8_itq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, compared within labels at a cosine of 0.98."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
