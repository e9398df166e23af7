"""Exact Jaccard join of word-shingle sets, as connected classes.

A set is the distinct hashed shingles of a text. Sets that are equal are one node (a node's name is the
hash of its sorted set), so copies inherit every answer of the set they equal. All sets are ordered the
same way, by a sketch of how many texts hold a shingle, and only the rarest part of each set is indexed:
two sets that reach the threshold share at least one indexed shingle, whatever the order.

An index list holds (size, node, position), sorted by size. It is never turned into all its pairs:

1. Each entry is paired with the entry before it. Two pairs of each set are verified first, the most frequent one among
   them; those that reach the threshold give classes, those that come near it give families of classes. Then each
   entry is paired with one entry of another family anywhere before it, so that families whose sizes differ meet too.
2. Lists that hold more than one family are read again in blocks. A block is skipped as a whole when its sizes
   are too small, when its positions leave too few shingles to reach the threshold, or when all its entries are in
   the reader's family. Pairs across families are verified one by one.
3. Families are compared within, by differences. Each set is met once with its family's most copied set and becomes
   what it lacks of that set and what it has besides. In families of more than one block, what only one set has counts
   for none but itself, so sets that agree in all else have the same answers and become one profile. Profiles are
   compared in blocks that travel once per pair of blocks; a profile answers for all of its sets.

Verification receives a set with its partners in order and computes the first overlap in full; for a
partner that differs little from the one before, it adds and subtracts the overlap of the differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import components, lean, may_match, written

#: Counters of the sketch that orders shingles, and how many travel in one row. It sets the order only, never the result.
SKETCH, CHUNK = 1 << 21, 1 << 14
#: Entries of a list block; sets that meet one copy of their family's top; profiles of a family block, and shingles they hold together.
BLOCK, MEETING, FAMILY_BLOCK, BLOCK_SHINGLES = 64, 512, 4096, 1 << 20
#: Per cent of the union from which a verified pair belongs to one family.
FAMILY_PERCENT = 70
MULTIPLY = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))


class _Words(dict):
    """Hashes of words, computed once per word; cleared when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_sets(texts: list[str | None], words: int, known: _Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z lower-cased, words split at ASCII white space)."""
    out = []
    for text in texts:
        tokens = (text or "").encode().lower().split()
        if not tokens:
            out.append(np.zeros(0, np.uint64))
            continue
        h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        k = min(words, len(h))
        v = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            v = (v * MULTIPLY[0]) ^ h[i : i + len(v)]
            v ^= v >> np.uint64(29)
            v *= MULTIPLY[1]
        out.append(np.unique(v))
    return out


def _node(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1  # positive as a long


def _needed(total: int, percent: int) -> int:
    """The least overlap of two sets of ``total`` elements together that reaches the threshold."""
    return -(-percent * total // (100 + percent))


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - 21)).astype(np.int64)


def _scan(words: int):
    """Rows (id, h, n, node) of texts, and a task's part of the sketch in rows (chunk, counts)."""
    names = ["id", "h", "n", "node", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, held, size = _Words(), set(), [], 0
        sketch = np.zeros(SKETCH, np.int64)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column("t").to_pylist(), words, known)
                nodes = [_node(s) if len(s) else None for s in sets]
                for s, node in zip(sets, nodes):
                    if node is not None and node not in seen:
                        seen.add(node)
                        held.append(_cell(s))
                        size += len(s)
                if size > 2_000_000:
                    sketch += np.bincount(np.concatenate(held), minlength=SKETCH)
                    held, size = [], 0
                if len(seen) > 500_000:
                    seen.clear()
                nulls = [pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(map(len, sets), pa.int64()), pa.array(nodes, pa.int64()), *nulls], names)
        if held:
            sketch += np.bincount(np.concatenate(held), minlength=SKETCH)
        if sketch.any():
            parts = np.minimum(sketch, 65535).astype("<u2").reshape(-1, CHUNK)
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(len(parts)), pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names)

    return lean(run)


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            total[chunk] = total.get(chunk, 0) + np.frombuffer(counts.as_py(), "<u2").astype(np.int64)
    out = [np.minimum(v, (1 << 32) - 1).astype("<u4").tobytes() for v in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(out, pa.binary())], ["chunk", "counts"])


def _prefixes(words: int, percent: int, sketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, often = _Words(), set(), sketch.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, out = batch.slice(at, 512), []
                for s in shingle_sets(part.column("t").to_pylist(), words, known):
                    n = len(s)
                    if not n or (node := _node(s)) in seen:
                        continue
                    seen.add(node)
                    s = s[np.argsort(often[_cell(s)], kind="stable")]  # equal counts stay in the order of the hashes
                    s = s[: n - -(-percent * n // 100) + 1]
                    out.append((s, np.full(len(s), n), np.full(len(s), node), np.arange(len(s))))
                if len(seen) > 500_000:
                    seen.clear()
                if out:
                    cols = [np.concatenate(c) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), *(pa.array(c.astype(np.int64)) for c in cols[1:])], ["shingle", "n", "node", "pos"])

    return lean(run)


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _chain(percent: int):
    """Entries of lists with two nodes or more, each with the node before it where the two may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last entry so far: (shingle, n, node, pos, was it sent)
        for batch in batches:
            cols = _columns(batch, ("shingle", "n", "node", "pos"))
            if last is not None:
                cols = [np.concatenate([[x], c]) for x, c in zip(last[:4], cols)]
            sh, n, node, pos = cols
            if not len(sh):
                continue
            fresh = np.ones(len(sh), bool)
            fresh[1:] = (sh[1:] != sh[:-1]) | (node[1:] != node[:-1])  # copies of a node stand next to each other
            sent = bool(last[4]) if last is not None else False
            first_is_old = last is not None
            sh, n, node, pos = (c[fresh] for c in cols)
            same = np.zeros(len(sh) + 1, bool)
            same[1:-1] = sh[1:] == sh[:-1]
            a, b = slice(0, len(sh) - 1), slice(1, len(sh))
            near = np.zeros(len(sh), bool)
            near[b] = same[1:-1] & (100 * n[a] >= percent * n[b]) & (np.minimum(n[a] - pos[a], n[b] - pos[b]) >= -(-percent * (n[a] + n[b]) // (100 + percent)))
            before = np.concatenate([[0], node[:-1]])
            keep = same[:-1] | same[1:]
            now_sent = bool(keep[-1]) if len(sh) > 1 else sent
            if first_is_old and sent:
                keep[0] = False
            last = (sh[-1], n[-1], node[-1], pos[-1], now_sent)
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[keep]) for c in (sh, n, node, pos)), pa.array(before[keep], mask=~near[keep])], ["shingle", "n", "node", "pos", "before"]
                )

    return lean(run)


def _across(percent: int, one: bool = False):
    """Pairs of a list's entries that are in different families and may reach the threshold; with ``one``, each entry
    gives one of its pairs at most, with an entry that is anywhere before it in the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, blocks, found = None, [], set()

        def flush() -> pa.RecordBatch:
            rows = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["u", "v"])

        for batch in batches:
            for sh, n, node, pos, label in zip(*(batch.column(c).to_pylist() for c in ("shingle", "n", "node", "pos", "label"))):
                if sh != shingle:
                    shingle, blocks = sh, []
                while blocks and 100 * blocks[0]["max_n"] < percent * n:
                    blocks.pop(0)
                need = _needed(n + -(-percent * n // 100), percent)  # with the smallest partner
                met = False
                turn = node % len(blocks) if one and blocks else 0
                for block in blocks[turn:] + blocks[:turn] if turn else blocks:
                    if 100 * block["max_n"] < percent * n or block["label"] == label or min(block["most_left"], n - pos) < need:
                        continue
                    turn = (node >> 20) % len(block["rows"]) if one else 0
                    for m, other, at, other_label in block["rows"][turn:] + block["rows"][:turn] if turn else block["rows"]:
                        if other_label != label and 100 * m >= percent * n and min(m - at, n - pos) >= _needed(n + m, percent):
                            found.add((min(node, other), max(node, other)))
                            if met := one:
                                break
                    if met:
                        break
                if not blocks or len(blocks[-1]["rows"]) >= BLOCK:
                    blocks.append({"rows": [], "max_n": 0, "most_left": 0, "label": label})
                block = blocks[-1]
                block["rows"].append((n, node, pos, label))
                block["max_n"], block["most_left"] = max(block["max_n"], n), max(block["most_left"], n - pos)
                if block["label"] != label:
                    block["label"] = None
                if len(found) > 200_000:
                    yield flush()
        yield flush()

    return lean(run)


def _verify(words: int, percent: int):
    """Rows (u, v, linked) of sets that reach the threshold, or that come near it; a set (v) comes first, then its partners in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        owner, y, last, last_overlap = None, None, None, 0
        for batch in batches:
            us, vs, linked = [], [], []
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = shingle_sets(part.column("t").to_pylist(), words, known)
                for x, node, v in zip(sets, part.column("node").to_pylist(), part.column("owner").to_pylist()):
                    if v != owner:
                        owner, y, last = v, None, None
                    if node == v:
                        y = x
                        continue
                    overlap = None
                    if last is not None and abs(len(x) - len(last)) <= len(x) // 10:
                        gone, new = np.setdiff1d(last, x, assume_unique=True), np.setdiff1d(x, last, assume_unique=True)
                        if len(gone) + len(new) <= len(x) // 5:  # highly similar: only the differences are looked up
                            overlap = last_overlap - int(np.isin(gone, y, assume_unique=True).sum()) + int(np.isin(new, y, assume_unique=True).sum())
                    if overlap is None:
                        overlap = len(np.intersect1d(x, y, assume_unique=True))
                    last, last_overlap = x, overlap
                    union = len(x) + len(y) - overlap
                    if 100 * overlap >= min(percent, FAMILY_PERCENT) * union:
                        us.append(node)
                        vs.append(v)
                        linked.append(100 * overlap >= percent * union)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(linked, pa.bool_())], ["u", "v", "linked"])

    return lean(run)


def _differences(words: int):
    """Rows (node, family, copies, t, lacks, adds) of sets: the size of their family's top, and how they differ from it.

    Rows arrive by (family, part), the top first; it counts as a set of the family in part 0 only.
    """
    names = ["node", "family", "copies", "t", "lacks", "adds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, key, top = _Words(), None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, out = batch.slice(at, 128), []
                sets = shingle_sets(part.column("t").to_pylist(), words, known)
                for s, node, copies, family, k, is_top in zip(sets, *(part.column(c).to_pylist() for c in ("node", "copies", "family", "part", "is_top"))):
                    if is_top:
                        key, top = (family, k), s
                    if (family, k) != key:
                        raise RuntimeError("a set came without its family's top")
                    if not is_top or k == 0:
                        out.append((node, family, copies, len(top), np.setdiff1d(top, s, assume_unique=True).view(np.int64), np.setdiff1d(s, top, assume_unique=True).view(np.int64)))
                cols = list(zip(*out)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.list_(pa.int64())) for c in cols[4:])], names)

    return lean(run)


class _Lists:
    """Which of some sets hold a shingle: one list for each shingle of theirs."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.shingles, cells = np.unique(np.concatenate(sets), return_inverse=True)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        self.owners = owners[np.argsort(cells, kind="stable")]
        self.lengths = np.bincount(cells, minlength=len(self.shingles))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def cells(self, s: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.shingles, s), len(self.shingles) - 1)
        return at[self.shingles[at] == s]

    def held(self, cells: np.ndarray) -> np.ndarray:
        """How many of the cells each set holds."""
        n = self.lengths[cells]
        at = np.repeat(self.starts[cells] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owners[at], minlength=self.n)


def _count_within(percent: int):
    """Within one family, rows (u, v, null) that link profiles, and rows (u, null, n) with the rows that profile ``u``
    links with in other profiles of the two blocks; rows arrive by (family, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []  # (pid, t, a, size, copies, side, differences)

        def found() -> pa.RecordBatch:
            rows.sort(key=lambda r: (r[3], r[0]))
            one_block = key[1] == key[2]
            left = [r for r in rows if one_block or not r[5]]
            right = rows if one_block else [r for r in rows if r[5]]
            us, vs, ns = [], [], []
            if left and right:
                lists = _Lists([r[6] for r in left])
                lacks, sizes, copies = (np.array([r[k] for r in left], np.int64) for k in (2, 3, 4))
                back, last, common = np.zeros(len(left), np.int64), None, None
                labels = np.arange(len(left))  # what the left profiles are joined to so far
                for b, (pid, t, a, size, many, _, differences) in enumerate(right):
                    cells = lists.cells(differences)
                    if last is not None:
                        gone, new = np.setdiff1d(last, cells, assume_unique=True), np.setdiff1d(cells, last, assume_unique=True)
                    if last is not None and len(gone) + len(new) < len(cells):  # similar to the one before: only the differences are looked up
                        common = common + lists.held(new) - lists.held(gone)
                    else:
                        common = lists.held(cells)
                    last = cells
                    overlap = t - a - lacks + common
                    linked = 100 * overlap >= percent * (sizes + size - overlap)
                    if one_block:
                        linked[b] = False
                    else:
                        back[linked] += many
                    at = np.flatnonzero(linked)
                    if not len(at):
                        continue
                    us.append(pid)
                    vs.append(None)
                    ns.append(int(copies[at].sum()))
                    own = labels[b] if one_block else -1
                    heads, where = np.unique(labels[at], return_index=True)
                    for c in at[where[heads != own]].tolist():  # one link for each class; the rest follows
                        us.append(left[c][0])
                        vs.append(pid)
                        ns.append(None)
                    if len(heads) > 1 or heads[0] != own and one_block:
                        labels[np.isin(labels, np.append(heads, own))] = heads[0]
                for c in np.flatnonzero(back).tolist():
                    us.append(left[c][0])
                    vs.append(None)
                    ns.append(int(back[c]))
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64()), pa.array(ns, pa.int64())], ["u", "v", "n"])

        for batch in batches:
            differences = batch.column("d")
            for at, (family, i, j, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j", "pid", "t", "a", "size", "w", "side")))):
                if (family, i, j) != key:
                    if len(rows) > 1:
                        yield found()
                    key, rows = (family, i, j), []
                rows.append((*row, np.sort(differences[at].values.to_numpy(zero_copy_only=False))))
        if len(rows) > 1:
            yield found()

    return lean(run)


def _compared(met: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Edges (u, v) that join the classes of each family, and (u, n): the rows that set ``u`` links with, without its own copies.

    ``met`` has (family, part, node, is_top, copies, t): the sets of each family in parts, and its top in each part.
    """
    order = met.repartition("family", "part").sortWithinPartitions("family", "part", F.col("is_top").cast("int").desc())
    sets = written(order.mapInArrow(_differences(words), "node long, family long, copies long, t long, lacks array<long>, adds array<long>"), "differences")
    many = sets.groupBy("family").agg(F.count("*").alias("m")).where(F.col("m") > FAMILY_BLOCK).select("family")
    # shingles that one set of the family alone has besides: its count and hashes are taken out of what names its profile
    alone = sets.join(written(many, "large"), "family", "left_semi").select("family", "node", F.explode("adds").alias("e"))
    alone = alone.groupBy("family", "e").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
    alone = alone.groupBy("node").agg(F.count("*").alias("own"), F.bit_xor(F.xxhash64("e")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "e")).alias("x2"))
    zero = F.lit(0).cast("long")
    shared = lambda hashed, x: F.aggregate("adds", zero, lambda s, e: s.bitwiseXOR(hashed(e))).bitwiseXOR(F.coalesce(x, zero))
    own, a, b = F.coalesce("own", zero).alias("own"), F.size("lacks").cast("long"), F.size("adds").cast("long")
    named = sets.join(written(alone, "alone"), "node", "left").select(
        "node", "family", "copies", "t", a.alias("a"), own, (F.col("t") - a + b).alias("size"), F.concat("lacks", "adds").alias("d"),
        F.xxhash64("family", b, own, "lacks", shared(F.xxhash64, F.col("x1"))).alias("k1"),
        F.xxhash64(F.lit(1), "family", b, own, "lacks", shared(lambda e: F.xxhash64(F.lit(1), e), F.col("x2"))).alias("k2"),
    )
    named = written(named, "named")
    profiles = named.groupBy("k1", "k2", "family", "t", "a", "own", "size").agg(F.min(F.struct("node", "d")).alias("first"), F.sum("copies").alias("w"), F.count("*").alias("m"))
    overlap = F.col("size") - F.col("own")  # of two sets of one profile
    inside = (F.col("m") > 1) & (100 * overlap >= percent * (2 * F.col("size") - overlap))
    profiles = written(profiles.select("k1", "k2", "family", "t", "a", "size", "w", F.col("first.node").alias("pid"), F.col("first.d").alias("d"), inside.alias("inside")), "profiles")

    blocks = F.ceil(F.greatest(F.count("*") / FAMILY_BLOCK, F.sum(F.size("d") + 8) / BLOCK_SHINGLES)).cast("int")
    blocks = written(profiles.groupBy("family").agg(blocks.alias("blocks")), "blocks")
    placed = profiles.join(blocks, "family").withColumn("at", F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("family", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), (F.col("at") > F.col("other")).alias("side"), "pid", "t", "a", "size", "w", "d")
    keys = ["family", "i", "j"]
    inner = written(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_count_within(percent), "u long, v long, n long"), "links")

    others = inner.where("v is null").groupBy(F.col("u").alias("pid")).agg(F.sum("n").alias("n"))
    answers = profiles.select("k1", "k2", "pid", "w", "inside").join(others, "pid", "left").where("inside or n > 0")
    answered = named.select("node", "copies", "k1", "k2").join(written(answers, "answers"), ["k1", "k2"])
    counts = answered.select(F.col("node").alias("u"), (F.coalesce("n", zero) + F.when(F.col("inside"), F.col("w") - F.col("copies")).otherwise(zero)).alias("n"))
    edges = inner.where("v is not null").select("u", "v").union(answered.where("node <> pid").select(F.col("node").alias("u"), F.col("pid").alias("v")))
    return edges, counts


def jaccard_classes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """One row per row of ``df``: (id, n_shingles, component_id, text_hash, n_links), ids as long.

    Rows link when 100 * intersection >= percent * union of their shingle sets. ``component_id`` is the
    smallest id reachable by links, ``n_links`` the number of other rows that the row itself links with, copies
    included; without ``count_links`` that column is left out and links are followed only as classes need. A text with fewer words than a shingle is one shingle; null and
    empty texts, and texts of white space, hold none and link with nothing. Rows that repeat an id are rows of
    their own; a null id is never the smallest one unless all ids of its class are null.
    """
    spark = df.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("t"))
    scan = written(docs.mapInArrow(_scan(words), "id long, h long, n long, node long, chunk long, counts binary"), "sets")
    nodes = scan.where("chunk is null").select("id", "h", "n", "node")

    parts = scan.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(lean(_add_sketches), "chunk long, counts binary").collect()
    sketch = np.zeros((SKETCH // CHUNK, CHUNK), np.uint32)
    for r in parts:
        sketch[r["chunk"]] = np.frombuffer(bytes(r["counts"]), "<u4")
    often = spark.sparkContext.broadcast(sketch.ravel())

    postings = docs.select("t").mapInArrow(_prefixes(words, percent, often), "shingle long, n long, node long, pos long")
    entry = "shingle long, n long, node long, pos long, before long"
    lists = written(postings.repartition("shingle").sortWithinPartitions("shingle", "n", "node").mapInArrow(_chain(percent), entry), "lists")
    sources = written(nodes.where("node is not null").groupBy("node").agg(F.min("h").alias("h"), F.count("*").alias("copies")), "sources")

    def with_texts(wanted: DataFrame) -> DataFrame:
        """``wanted`` (with node), the texts of its nodes and how many rows have them. Texts travel, not sets: they are half the size."""
        wanted = written(wanted.join(sources, "node"), "wanted")
        return may_match(docs.select("h", "t"), "h", wanted, "h").dropDuplicates(["h"]).join(wanted, "h").drop("h")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("u").alias("node"), F.col("v").alias("owner")).union(pairs.select("v", "v")).distinct()
        met = with_texts(ends).repartition("owner").sortWithinPartitions("owner", F.col("node") != F.col("owner"), "node")
        return written(met.select("owner", "node", "t").mapInArrow(_verify(words, percent), "u long, v long, linked boolean"), "links")

    def labelled(families: DataFrame) -> DataFrame:
        """Entries of all lists in order, with their families as labels; lists of one family give nothing and need not be told apart."""
        named = lists.select("shingle", "n", "node", "pos").join(families.withColumnRenamed("family", "label"), "node", "left")
        return named.withColumn("label", F.coalesce("label", "node")).repartition("shingle").sortWithinPartitions("shingle", "n", "node")

    def families_of(near: DataFrame) -> DataFrame:
        return written(components(near.select("u", "v")), "families").withColumnRenamed("component", "family")

    neighbours = lists.where("before is not null").select("node", "before").repartition("node").groupBy("node", "before").agg(F.count("*").alias("c")).groupBy("node")
    first = neighbours.agg(F.max(F.struct("c", "before")).getField("before").alias("p"), F.min("before").alias("q"))
    pairs = first.select("node", F.explode(F.array("p", "q")).alias("before")).select(F.least("node", "before").alias("u"), F.greatest("node", "before").alias("v")).distinct()
    near = verified(written(pairs, "pairs"))
    pairs = labelled(families_of(near)).mapInArrow(_across(percent, one=True), "u long, v long").distinct()
    near = near.union(verified(written(pairs, "pairs")))
    links = near.where("linked").select("u", "v")
    classes = written(components(links), "classes")
    families = families_of(near)

    across = labelled(families).mapInArrow(_across(percent), "u long, v long")
    more = verified(written(across.distinct(), "pairs")).where("linked").select("u", "v")  # each pair is here: families differ

    members = families.join(classes.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = members.groupBy("family").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("m"))
    sizes = sizes if count_links else sizes.where("a <> b")
    inside = written(members.join(sizes.select("family"), "family", "left_semi").join(sources, "node").select("family", "node", "copies"), "members")
    tops = inside.groupBy("family").agg(F.min(F.struct(-F.col("copies"), "node")).alias("top"), F.ceil(F.count("*") / MEETING).cast("int").alias("parts"))
    tops = written(tops.select("family", F.col("top.node").alias("top"), "parts"), "tops")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = inside.join(tops, "family").where("node <> top").select("family", part.alias("part"), "node", F.lit(False).alias("is_top"))
    each = tops.select("family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("top").alias("node"), F.lit(True).alias("is_top"))
    edges, linked = _compared(with_texts(others.union(each)), words, percent)
    final = components(links.union(more).union(edges))
    if count_links:
        ends = more.union(more.select("v", "u")).join(sources.select(F.col("node").alias("v"), F.col("copies").alias("n")), "v")
        counts = ends.select("u", "n").union(linked).groupBy("u").agg(F.sum("n").alias("linked"))
        own = sources.join(counts.withColumnRenamed("u", "node"), "node", "left").select("node", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        # written, as ``least`` below
        nodes = nodes.join(written(own.where("n_links > 0"), "counts"), "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    added = ["n_links"] if count_links else []

    labels = nodes.join(final, "node", "left").select("id", "h", "n", F.coalesce("component", "node").alias("label"), *added)
    # written, so that a class with a third of all rows meets it in a join that Spark can split
    least = written(labels.where("label is not null").groupBy("label").agg(F.min("id").alias("component_id")), "least")
    named = labels.where("label is not null").join(least, "label").select("id", F.col("n").alias("n_shingles"), "component_id", F.col("h").alias("text_hash"), *added)
    return named.union(labels.where("label is null").select("id", "n", "id", "h", *added))


def one_of_each_class(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` that stand for their class: of each class one row, with the smallest id.

    Among rows of that id, the one with the smallest text hash; of rows equal in both, one. Texts without words
    link with nothing and stay, once for each id and text.
    """
    classes = jaccard_classes(df, text_col, id_col, words, percent, count_links=False)
    heads = classes.where(F.col("id").eqNullSafe(F.col("component_id")))
    own = F.when((F.col("n_shingles") == 0) | F.col("component_id").isNull(), F.col("text_hash"))
    kept = heads.groupBy("id", own.alias("own")).agg(F.min("text_hash").alias("kept_h")).select(F.col("id").alias("kept_id"), "kept_h").distinct()
    names = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(df.columns)]
    rows = df.select(*names, F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("h")).dropDuplicates(["id", "h"])
    met = rows.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")), "left_semi")
    return met.select(*[F.col(f"o{i}").alias(c) for i, c in enumerate(df.columns)])


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between documents whose five-word shingle sets reach a similarity of 0.8: how many each has, and their classes."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")
