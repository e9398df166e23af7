"""Removal of long passages that repeat anywhere in a corpus, through run-length Burrows-Wheeler indexes.

Every string of ``span`` bytes is filed under its minimiser: the ``GRAM``-byte substring with the smallest hash.
Equal strings have equal minimisers, so strings under different ones need never be compared. A document
falls into regions, runs of window starts with one minimiser; a region that occurs once, under a minimiser
that occurs once, holds nothing repeated. Equal documents are cut into regions once, and regions with equal
texts are collapsed to one with a count: a text that occurs twice is repeated at every one of its windows.

Distinct texts under one minimiser are indexed together, in batches of bounded size. An index keeps the texts
and the runs of their Burrows-Wheeler transform, with the text place sampled at both ends of each run. The
matching statistics of the texts, each against all other places, are read off these samples in one stream.

All equal windows have the minimiser at the same place. Groups of more than ``MANY`` distinct texts (a common
passage in different surroundings) are therefore split by what windows at one place share: cells of
neighbouring windows are counted, and those that differ but share a core are cut into smaller cells, down to
single windows. All of this is grouped counts, combined before the shuffle, so no group has to fit in a task. The
counts name the text of a window that stands once; all other windows of the group's texts are repeated.

Equality of region texts, cells and windows is by 64-bit hashes within one minimiser's group (128 bits together);
equality of documents is by a 64-bit hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import lean, marked, may_match, written

GRAM = 64
#: Window starts handled at once; places within a piece must fit in PLACE_BITS.
PIECE, PLACE_BITS = 1 << 18, 21
#: Bytes of text under one index, the distinct texts from which a minimiser's group is split, and the windows of the cells.
BATCH_BYTES, MANY, CELLS = 1 << 17, 512, (64, 16, 4, 1)
#: Pairs of suffixes measured at once.
PAIRS = 1 << 13
#: The shortest repeated passage: bytes of a window, and words of what the windows cover.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 51
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(a: np.ndarray, b: np.ndarray, by: np.uint64) -> np.ndarray:
    h = (a * by) ^ (b + (a >> np.uint64(31)))
    h *= MIX[2]
    h ^= h >> np.uint64(32)
    return h


def _gram_hashes(raw: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at each place."""
    n = len(raw)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = raw
    words = np.empty(n - 7, np.uint64)
    for k in range(8):
        part = padded[k : k + (n - 7 - k + 7) // 8 * 8].view("<u8")
        words[k::8] = part[: len(words[k::8])]
    h, size = words + np.uint64(seed * 0x632BE59BD9B4E019 % (1 << 64)), 8
    while size < GRAM:
        h = _mixed(h[:-size], h[size:], MIX[size == 8])
        size *= 2
    return h


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima within blocks from both sides."""
    n = len(v)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def regions(raw: bytes, span: int, seed: int = 0) -> Iterator[tuple[int, int, int]]:
    """(start, windows, minimiser) of each region: its windows begin at start, start + 1, ..."""
    data = np.frombuffer(raw, np.uint8)
    for low in range(0, len(data) - span + 1, PIECE):
        piece = data[low : low + PIECE + span - 1]
        h = _gram_hashes(piece, seed)
        places = np.arange(len(h), dtype=np.uint64)
        least = _sliding_least((h >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places, span - GRAM + 1)
        at = (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        names = h[at[cuts[:-1]]].view(np.int64)
        for a, b, name in zip(cuts[:-1].tolist(), cuts[1:].tolist(), names.tolist()):
            yield low + a, b - a, name


class RunIndex:
    """A run-length Burrows-Wheeler index over texts, each closed by an end mark of its own.

    What is kept: the symbols (``text``), and per run of the transform its symbol (``heads``), its length
    (``lengths``) and the text places of its first and last suffix (``run_first``, ``run_last``).
    """

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        marks = len(texts)
        self.text = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + marks
        self.text[self.ends] = np.arange(marks)
        order = self._sorted(np.maximum(self.text - marks, -1) + 1, self.ends)
        before = self.text[order - 1]
        cuts = np.concatenate([[0], np.flatnonzero(before[1:] != before[:-1]) + 1])
        self.heads, self.lengths = before[cuts], np.diff(np.concatenate([cuts, [len(order)]]))
        self.run_first, self.run_last = order[cuts], order[cuts + self.lengths - 1]

    @staticmethod
    def _sorted(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Suffix order by doubling; in each round only suffixes that are still tied are sorted. ``symbols`` are 0 at
        end marks, which order by place."""
        n = len(symbols)
        places = np.arange(n)
        key = np.zeros(n, np.int64)
        size = 7
        padded = np.concatenate([symbols, np.zeros(size, np.int64)])
        stop = np.zeros(n + size, bool)
        stop[ends] = True
        live = np.ones(n, bool)  # nothing counts behind an end mark
        for k in range(size):
            key = key * 257 + np.where(live, padded[k : k + n], 0)
            live &= ~stop[k : k + n]
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        held = places  # places in the order that are still tied
        # suffixes that met their end mark are told apart by it, so by place: the stable sort has done that
        done = ~live[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | done[1:] | done[:-1]])
        while True:
            head = np.maximum.accumulate(np.where(fresh, held, 0))
            rank[order[held]] = head
            tied = ~(fresh & np.concatenate([fresh[1:], [True]]))
            held = held[tied]
            if not len(held):
                return order
            s = order[held]
            key = rank[s] * (n + 1) + rank[s + size]  # tied suffixes reach no end mark within ``size``
            o = np.argsort(key, kind="stable")
            key, order[held] = key[o], s[o]
            fresh = np.concatenate([[True], key[1:] != key[:-1]])
            size *= 2

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of suffixes at a and b, some pairs at a time; end marks differ, so they stop it."""
        text = np.concatenate([self.text, np.arange(-128, 0)])  # one step may read beyond the last mark
        size = np.zeros(len(a), np.int64)
        for low in range(0, len(a), PAIRS):
            live, step = np.arange(low, min(low + PAIRS, len(a))), 16
            while len(live):
                differ = text[(a[live] + size[live])[:, None] + np.arange(step)] != text[(b[live] + size[live])[:, None] + np.arange(step)]
                any_differ = differ.any(1)
                size[live] += np.where(any_differ, differ.argmax(1), step)
                live = live[~any_differ]
                step = min(128, step * 2)
        return size

    def matching_statistics(self) -> np.ndarray:
        """For each place, the length of the longest string that starts there and also starts elsewhere.

        The best partner of a suffix is a neighbour in suffix order. A suffix whose neighbour is preceded by the same
        symbol has its common prefix from the place before, less one, so prefixes are measured only where two
        runs meet, between the last sample of one and the first of the next, and carried on from place to place.
        """
        n = len(self.text)
        best = np.zeros(n, np.int64)
        above, below = self.run_last[:-1], self.run_first[1:]
        size = self._common(above, below)
        for here in (above, below):
            reach = np.full(n, -(1 << 40))
            reach[here] = size + here  # place where the match ends: constant along the places that follow
            best = np.maximum(best, np.maximum.accumulate(reach) - np.arange(n))
        return np.maximum(best, 0)

    def repeated(self, span: int) -> list[list[tuple[int, int]]]:
        """For each text, the runs (first, last) of window starts whose ``span`` bytes also start elsewhere."""
        long = self.matching_statistics() >= span
        edge = np.flatnonzero(np.diff(np.concatenate([[0], long.astype(np.int8), [0]])))
        first, last = edge[0::2], edge[1::2] - 1
        owner = np.searchsorted(self.ends, first)
        out: list[list[tuple[int, int]]] = [[] for _ in self.ends]
        for t, a, b in zip(owner.tolist(), first.tolist(), last.tolist()):
            out[t].append((a - int(self.starts[t]), b - int(self.starts[t])))
        return out


def _find_regions(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start", "windows", "minimiser", "content"]

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

        for batch in batches:
            rows: list[tuple] = []
            for doc, raw in zip(batch.column("doc").to_pylist(), batch.column("b")):
                raw = raw.as_py() or b""
                for start, windows, name in regions(raw, span):
                    content = xxhash.xxh3_64_intdigest(raw[start : start + windows + span - 1])
                    rows.append((doc, start, windows, name, content - (1 << 63)))
                if len(rows) > 20_000:
                    yield sent(rows)
                    rows = []
            if rows:
                yield sent(rows)

    return lean(run)


def _hash(raw: bytes) -> int:
    return xxhash.xxh3_64_intdigest(raw) - (1 << 63)


def _cells(span: int, width: int):
    """Cells of window runs: neighbouring windows by their distance d from the minimiser, under the bytes that all such windows share."""
    names = ["minimiser", "content", "first", "windows", "c", "core", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(low, 1024), []
                for name, content, raw, runs in zip(*(part.column(c).to_pylist() for c in ("minimiser", "content", "bytes", "runs"))):
                    at = int((_gram_hashes(np.frombuffer(raw[:span], np.uint8), 0) >> np.uint64(PLACE_BITS)).argmin())
                    mark = name.to_bytes(8, "little", signed=True)
                    for first, windows, count in ((r["first"], r["windows"], r["c"]) for r in runs):
                        for c in range((at - first - windows + 1) // width, (at - first) // width + 1):
                            a, z = max(first, at - c * width - width + 1), min(first + windows - 1, at - c * width)
                            core = raw[at - c * width : at - c * width - width + 1 + span]
                            rows.append((name, content, a, z - a + 1, count, _hash(mark + c.to_bytes(8, "little", signed=True) + core), _hash(mark + (at - a).to_bytes(8, "little") + raw[a : z + span])))
                cols = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return lean(run)


def _split_groups(texts: DataFrame, span: int) -> DataFrame:
    """Rows (minimiser, content, first, last) of repeated windows in groups of any size.

    Cells that stand more than once are repeated, and cells alone under their core are not. Of the others, each
    different cell goes on to the next width once, by any of the texts that have it and with their count. What is
    left of a text without its windows that stand once is repeated, so nobody is joined with the cells that repeat.
    """
    windows = (F.octet_length("bytes") - (span - 1)).cast("long")
    alone = texts.select("minimiser", "content", F.lit(None).cast("long").alias("first"), windows.alias("windows"))  # each text in full
    if not texts.isEmpty():
        todo = texts.withColumn("runs", F.array(F.struct(F.lit(0).cast("long").alias("first"), windows.alias("windows"), F.lit(1).cast("long").alias("c"))))
        owner = [F.first(c).alias(c) for c in ("content", "first", "windows")]
        for width in CELLS:
            cells = todo.select("minimiser", "content", "bytes", "runs").mapInArrow(_cells(span, width), "minimiser long, content long, first long, windows long, c long, core long, cell long")
            counts = written(cells.groupBy("minimiser", "core", "cell").agg(F.sum("c").alias("c"), *owner), "cell_counts")
            if width == 1:  # a single window is its own core
                alone = alone.union(counts.where("c = 1").select("minimiser", "content", "first", "windows"))
                break
            cores = written(counts.groupBy("minimiser", "core").agg(F.count("*").alias("kinds"), F.sum("c").alias("c"), *owner), "cores")
            alone = alone.union(cores.where("c = 1").select("minimiser", "content", "first", "windows"))
            mixed = counts.join(cores.where("kinds > 1").select("minimiser", "core"), ["minimiser", "core"], "left_semi")
            runs = mixed.groupBy("minimiser", "content").agg(F.collect_list(F.struct("first", "windows", "c")).alias("runs"))
            todo = texts.join(runs, ["minimiser", "content"])
    once = F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("first", "windows"))))
    of_text = alone.groupBy("minimiser", "content").agg(F.max(F.when(F.col("first").isNull(), F.col("windows"))).alias("all"), once.alias("once"))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("once", lambda x: x["first"] + x["windows"]))
    lasts = F.concat(F.transform("once", lambda x: x["first"] - 1), F.array(F.col("all") - 1))
    left = F.filter(F.zip_with(starts, lasts, lambda a, z: F.struct(a.alias("first"), z.alias("last"))), lambda r: r["first"] <= r["last"])
    return of_text.select("minimiser", "content", F.explode(left).alias("r")).select("minimiser", "content", "r.first", "r.last")


def _index_groups(span: int):
    """Window runs of each text that are repeated, from one index per batch of whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []  # (minimiser, content, bytes) of whole groups and of the one still read
        size = 0

        def found(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for row, runs in zip(rows, RunIndex([r[2] for r in rows]).repeated(span) if rows else []):
                out += [(row[0], row[1], a, b) for a, b in runs]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["minimiser", "content", "first", "last"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("minimiser", "content", "bytes"))):
                if size > BATCH_BYTES and waiting[-1][0] != row[0]:
                    yield found(waiting)
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[2])
        yield found(waiting)

    return lean(run)


def _window_runs(once: DataFrame, texts: DataFrame, span: int) -> DataFrame:
    """(doc, first, last): runs of window starts whose ``span`` bytes also start elsewhere in ``once``.

    ``once`` has (doc, b) of each text once; ``texts`` has the same rows, maybe repeated.
    """
    found = written(once.where(F.octet_length("b") >= span).mapInArrow(_find_regions(span), "doc long, start long, windows long, minimiser long, content long"), "regions")
    # what hot keys are joined with is written first: then both sides are plain shuffles, which Spark can split
    often = written(found.groupBy("minimiser").agg(F.count("*").alias("c")).where("c > 1").select("minimiser"), "often")
    shared = written(found.join(often, "minimiser", "left_semi"), "shared")
    distinct = written(shared.groupBy("minimiser", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start", "windows")).alias("at")), "distinct")
    groups = written(distinct.groupBy("minimiser").agg(F.count("*").alias("texts")).where("texts > 1"), "groups")
    place = F.struct(F.col("at.start").alias("start"), F.col("at.windows").alias("windows"), "minimiser", "content", "texts")
    by_doc = written(distinct.join(groups, "minimiser").groupBy(F.col("at.doc").alias("doc")).agg(F.collect_list(place).alias("x")), "wanted")
    sources = may_match(texts, "doc", by_doc, "doc").dropDuplicates(["doc"]).join(by_doc, "doc")
    cut = F.transform("x", lambda r: F.struct(r.minimiser.alias("minimiser"), r.content.alias("content"), r.texts.alias("texts"), F.substr(F.col("b"), (r.start + 1).cast("int"), (r.windows + (span - 1)).cast("int")).alias("bytes")))
    cut_texts = written(sources.select(F.explode(cut).alias("r")).select("r.*"), "texts")

    small = cut_texts.where(F.col("texts") <= MANY).repartition("minimiser").sortWithinPartitions("minimiser")
    runs = small.mapInArrow(_index_groups(span), "minimiser long, content long, first long, last long").union(_split_groups(cut_texts.where(F.col("texts") > MANY), span))
    # a text that occurs more than once is repeated at each of its windows
    whole = distinct.where("n > 1").select("minimiser", "content", F.lit(0).cast("long").alias("first"), (F.col("at.windows") - 1).alias("last"))
    of_text = written(runs.union(whole).groupBy("minimiser", "content").agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    places = shared.join(of_text, ["minimiser", "content"]).select("doc", F.explode("runs").alias("r"), "start")
    return places.select("doc", (F.col("start") + F.col("r.first")).alias("first"), (F.col("start") + F.col("r.last")).alias("last"))


def _joined(runs: list | None) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of window starts."""
    out: list[list[int]] = []
    for r in sorted((r["first"], r["last"]) for r in runs or ()):
        if out and r[0] <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [(a, b) for a, b in out]


def _covered(runs: list | None, span: int) -> list[tuple[int, int]]:
    """Maximal byte runs [first, end) that the windows cover."""
    out: list[list[int]] = []
    for first, last in _joined(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + span)
        else:
            out.append([first, last + span])
    return [(a, b) for a, b in out]


def _stretches(short: int, span: int):
    """(doc, at, piece, b): stretches of at least ``span`` bytes whose windows of ``short`` bytes are all repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part, rows = batch.slice(low, 256), []
                for doc, raw, runs in zip(*(part.column(c).to_pylist() for c in ("doc", "b", "runs"))):
                    for first, last in _joined(runs):
                        if last + short - first >= span:
                            rows.append((doc, first, _hash(doc.to_bytes(8, "little", signed=True) + first.to_bytes(8, "little")), raw[first : last + short]))
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.binary())], ["doc", "at", "piece", "b"])

    return lean(run)


def _per_doc(runs: DataFrame, name: str) -> DataFrame:
    return written(runs.groupBy("doc").agg(F.collect_list(F.struct("first", "last")).alias("runs")), name)


def repeated_windows(docs: DataFrame, span: int, short: int | None = None) -> DataFrame:
    """(doc, runs, short_runs) of ``docs`` (doc: a hash of the text, b: its bytes): array<struct<first, last>> of window starts.

    ``runs`` are those of ``span`` bytes. With ``short``, a smaller span, ``short_runs`` are those of that span: it is
    searched first, and ``span`` only in stretches where every shorter window is repeated, which leaves nothing out.
    """
    least = short or span
    texts = docs.where(F.octet_length("b") >= least).select("doc", "b")
    copies = written(texts.groupBy("doc").agg(F.count("*").alias("c"), F.max(F.octet_length("b")).cast("long").alias("size")).where("c > 1"), "copies")
    told = marked(texts, "doc", copies, "doc", "may")
    once = told.where("not may").select("doc", "b").union(told.where("may").select("doc", "b").dropDuplicates(["doc"]))
    # a text that stands twice is repeated throughout
    whole = lambda width: copies.where(F.col("size") >= width).select("doc", F.lit(0).cast("long").alias("first"), (F.col("size") - width).alias("last"))
    first = _per_doc(_window_runs(once, texts, least).union(whole(least)), "doc_runs")
    if short is None:
        return first.withColumn("short_runs", F.lit(None).cast("array<struct<first:bigint,last:bigint>>"))
    windows = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    long = first.where(windows > span - short)
    sources = may_match(texts, "doc", long, "doc").dropDuplicates(["doc"]).join(long, "doc")
    pieces = written(sources.select("doc", "b", "runs").mapInArrow(_stretches(short, span), "doc long, at long, piece long, b binary"), "stretches")
    part = pieces.select(F.col("piece").alias("doc"), "b")
    found = _window_runs(part, part, span).withColumnRenamed("doc", "piece").join(pieces.select("piece", "doc", "at"), "piece")
    second = _per_doc(found.select("doc", (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")).union(whole(span)), "doc_runs")
    return first.withColumnRenamed("runs", "short_runs").join(second, "doc", "left").select("doc", "runs", "short_runs")


SPANS = "array<struct<first:bigint,end:bigint>>"


def _remove(carry: list[str], as_text: bool, span: int, words: int, short: int | None, short_words: int):
    def enough(raw: bytes, cuts: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
        return [(a, b) for a, b in cuts if not least or len(raw[a:b].split()) >= least]

    def listed(spans: list) -> pa.Array:
        return pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column("b").to_pylist()
                spans = [enough(raw, _covered(r, span), words) for raw, r in zip(texts, part.column("runs").to_pylist())]
                kept = []
                for raw, cuts in zip(texts, spans):
                    edges = [0, *(x for c in cuts for x in c), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[0::2], edges[1::2])))
                column = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
                passages = [enough(raw, _covered(r, short), short_words) for raw, r in zip(texts, part.column("short_runs").to_pylist())] if short else [[]] * len(texts)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), column, listed(spans), listed(passages)], [*carry, "kept", "spans", "passages"])

    return lean(run)


def remove_repeats(
    df: DataFrame, text_col: str = "text", span: int = 400, as_text: bool = False, words: int = 0, passage_bytes: int | None = None, passage_words: int = PASSAGE_WORDS,
) -> DataFrame:
    """``df`` without its text, and with ``kept`` (the bytes that stay) and ``spans`` (removed byte runs [first, end)).

    A byte goes if a string of ``span`` bytes that covers it also starts anywhere else, in the same text or another;
    strings are judged on the input. With ``words``, only where such strings together cover that many words in a
    row or more. With ``as_text``, ``kept`` is a string, without the rests of characters that a cut splits.

    With ``passage_bytes``, smaller than ``span``, a third column ``passages`` lists (without removing them) the runs that
    are covered by repeated strings of that many bytes and hold at least ``passage_words`` words.

    Null texts are empty and keep nothing; empty and short texts stay; rows that repeat a text lose it where it has
    ``span`` bytes or more. All other columns stay; ones named ``kept``, ``spans`` or ``passages`` are replaced.
    """
    made = ["kept", "spans", *(["passages"] if passage_bytes else [])]
    carry = [c for c in df.columns if c not in (text_col, *made)]
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b""))
    named = df.select(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(carry)], F.xxhash64(raw).alias("doc"), raw.alias("b"))
    runs = written(repeated_windows(named, span, passage_bytes), "doc_spans").withColumnRenamed("doc", "p")
    # texts that lose nothing (most of them) are neither shuffled nor sent to Python
    may = F.col("may") | ~F.is_valid_utf8(F.col("b").cast("string")) if as_text else F.col("may")
    told = marked(named, "doc", runs, "p", "may").withColumn("may", may)
    touched = told.where("may").join(runs, F.col("doc") == F.col("p"), "left")
    slots = [f"o{i}" for i in range(len(carry))]
    types = {f.name: f.dataType.simpleString() for f in named.schema}
    schema = ", ".join([*(f"{s} {types[s]}" for s in slots), f"kept {'string' if as_text else 'binary'}, spans {SPANS}, passages {SPANS}"])
    out = touched.select(*slots, "b", "runs", "short_runs").mapInArrow(_remove(slots, as_text, span, words, passage_bytes, passage_words), schema)
    nothing = F.array().cast(SPANS)
    whole = told.where("not may").select(*slots, (F.col("b").cast("string") if as_text else F.col("b")).alias("kept"), nothing.alias("spans"), nothing.alias("passages"))
    out = out.union(whole)
    return out.select(*[F.col(s).alias(c) for s, c in zip(slots, carry)], *made)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 400-byte strings that stand elsewhere too, as digests.

    Besides: how many bytes and runs are in repeated passages of over 50 words, by strings of 200 bytes. No row is
    left out: null and empty texts keep nothing and lose nothing.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    covered = F.aggregate("passages", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])
    return remove_repeats(docs, passage_bytes=PASSAGE_BYTES).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
        covered.alias("passage_bytes"), F.size("passages").cast("long").alias("n_passages"),
    )
