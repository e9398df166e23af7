"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs what it reads, through a pool of bounded size, so packing needs no shuffle and the
padding lost per task is at most one sequence. A sequence takes, time after time, the pending piece
with the largest dot product between its demand and the room left (both as shares of the limits).
Where no piece fits whole and cutting is allowed, the piece with the largest product is cut to fill
the room. The last sequence of a task is dealt into power-of-two lengths, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.bpe import PATTERN, Codec, load_vocabulary
from lexspark.llm.common import lean

#: A text with longer runs of one kind of character goes to the codec whose cost stays near linear.
LONG_RUN = 2_000
SCHEMA = "start long, length long, doc_tokens long, loss_tokens long, sequence_id long, offset long, ids binary"


class Tokenizer:
    """Ids of a text by a byte-level vocabulary file; the fast library where its cost is bounded."""

    def __init__(self, vocabulary: dict):
        import re

        import tiktoken

        self._fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=vocabulary["ranks"], special_tokens=vocabulary["special"])
        self._codec = Codec(vocabulary, max_words=1000)
        self._runs = re.compile(rf"\s{{{LONG_RUN}}}|[^\s]{{{LONG_RUN}}}")

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and self._runs.search(text):
            return np.frombuffer(self._codec.encode(text), dtype="<u4")
        return self._fast.encode_to_numpy(text, allowed_special="all")


class Packer:
    """Packs pieces into sequences; ``rows`` collects (id, start, length, doc_tokens, loss, sequence, offset, ids)."""

    def __init__(self, limits: tuple[int, int, int], pool: int, cut: bool, first_sequence: int):
        self.limits, self.cut, self.size, self.sequence = limits, cut, pool, first_sequence
        self.pending: list[tuple] = []  # (id, start, ids, doc_tokens, loss_from)
        self.demand = np.zeros((0, 3))
        self.rows: list[tuple] = []

    def _loss(self, piece: tuple, n: int) -> int:
        return max(0, n - max(0, piece[4] - piece[1]))

    def _put(self, piece: tuple, n: int, offset: int) -> None:
        self.rows.append((piece[0], piece[1], n, piece[3], self._loss(piece, n), self.sequence, offset, piece[2][:n]))

    def add(self, doc_id, ids: np.ndarray, loss_from: int) -> None:
        """Takes an example of at least one token; whole sequences of a long one leave at once."""
        tokens, _, loss = self.limits
        piece = (doc_id, 0, ids, len(ids), loss_from)
        if not self.cut and (len(ids) > tokens or self._loss(piece, len(ids)) > loss):
            raise ValueError(f"an example of {len(ids)} tokens exceeds the limits and may not be cut")
        while len(piece[2]) >= tokens:
            n = tokens if self._loss(piece, tokens) <= loss else max(0, piece[4] - piece[1]) + loss
            self._put(piece, n, 0)
            self.sequence += 1
            piece = (doc_id, piece[1] + n, piece[2][n:], piece[3], loss_from)
        if len(piece[2]):
            self.pending.append(piece)
            if len(self.pending) >= 2 * self.size:
                self.drain(self.size)

    def drain(self, leave: int) -> None:
        """Closes sequences until at most ``leave`` pieces wait."""
        if len(self.pending) <= leave:
            return
        limits = np.array(self.limits, float)
        pieces = self.pending
        demand = np.array([(len(p[2]), 1, self._loss(p, len(p[2]))) for p in pieces], float) / limits
        alive = np.ones(len(pieces), bool)
        left = len(pieces)
        while left > leave:
            room, offset = np.ones(3), 0
            while True:
                fits = alive & (demand <= room + 1e-12).all(1)
                if not fits.any():
                    break
                i = int(np.where(fits, demand @ room, -1.0).argmax())
                self._put(pieces[i], len(pieces[i][2]), offset)
                offset += len(pieces[i][2])
                room -= demand[i]
                alive[i], left = False, left - 1
            free = round(room[0] * limits[0])
            if self.cut and left and free > 0 and room[1] * limits[1] > 0.5:
                i = int(np.where(alive, demand @ room, -1.0).argmax())
                piece = pieces[i]
                n = min(free, len(piece[2]), max(0, piece[4] - piece[1]) + round(room[2] * limits[2]))
                if n > 0:
                    self._put(piece, n, offset)
                    pieces[i] = piece = (piece[0], piece[1] + n, piece[2][n:], piece[3], piece[4])
                    demand[i] = np.array((len(piece[2]), 1, self._loss(piece, len(piece[2])))) / limits
                    if not len(piece[2]):
                        alive[i], left = False, left - 1
            self.sequence += 1
        self.pending = [p for p, a in zip(pieces, alive) if a]

    def finish(self) -> None:
        """Packs all that waits; the sequence left short is dealt into lengths that are powers of two."""
        self.drain(0)
        if not self.rows or not self.cut:
            return
        last = self.rows[-1][5]
        at = next(i for i in range(len(self.rows), 0, -1) if i == 1 or self.rows[i - 2][5] != last) - 1
        tail, self.rows = self.rows[at:], self.rows[:at]
        total, self.sequence = sum(r[2] for r in tail), last
        room = offset = 0
        for doc_id, start, n, doc_tokens, loss, _, _, ids in tail:
            free_of_loss = n - loss
            done = 0
            while done < n:
                if not room:
                    room, offset = 1 << (total.bit_length() - 1), 0
                    total -= room
                take = min(room, n - done)
                self.rows.append((doc_id, start + done, take, doc_tokens, max(0, take - max(0, free_of_loss - done)), self.sequence, offset, ids[done : done + take]))
                done, room, offset = done + take, room - take, offset + take
                if not room:
                    self.sequence += 1


def pack_examples(
    df: DataFrame, vocabulary_path: str, text_col: str = "text", id_col: str = "doc_id", prompt_col: str | None = None, end_id: int = 1,
    max_tokens: int = 2048, max_segments: int = 256, max_loss_tokens: int | None = None, pool: int = 1024, cut: bool = True,
) -> DataFrame:
    """One row per piece: (id, start, length, doc_tokens, loss_tokens, sequence_id, offset, ids).

    ``ids`` are packed little-endian unsigned 32-bit integers. An example is the ids of its prompt (if a
    column is named: no loss on those), of its text, then ``end_id``. Null texts are empty, so each row has
    at least one id. Rows may repeat and ids may be null. Limits hold for every sequence; with the
    default ``max_loss_tokens`` (= max_tokens) only tokens and segments bind.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    limits = (max_tokens, max_segments, max_loss_tokens or max_tokens)
    id_type = None

    def rows_of(packer: Packer) -> pa.RecordBatch:
        rows, packer.rows = packer.rows, []
        cols = list(zip(*rows)) if rows else [()] * 8
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], id_type), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array([x.astype("<u4").tobytes() for x in cols[7]], pa.binary())],
            ["id", "start", "length", "doc_tokens", "loss_tokens", "sequence_id", "offset", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        tokenize = Tokenizer(shared.value)
        packer = Packer(limits, pool, cut, TaskContext.get().partitionId() << 40)
        for batch in batches:
            id_type = batch.schema.field("id").type
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc_id, prompt, text in zip(part.column("id").to_pylist(), part.column("p").to_pylist(), part.column("t").to_pylist()):
                    before = tokenize(prompt) if prompt else np.zeros(0, "<u4")
                    packer.add(doc_id, np.concatenate([before, tokenize(text or ""), [end_id]]).astype("<u4"), len(before))
                if len(packer.rows) > 2048:
                    yield rows_of(packer)
        packer.finish()
        if id_type is not None:
            yield rows_of(packer)

    kind = df.schema[id_col].dataType.simpleString()
    picked = df.select(F.col(id_col).alias("id"), (F.col(prompt_col) if prompt_col else F.lit(None)).cast("string").alias("p"), F.col(text_col).cast("string").alias("t"))
    return picked.mapInArrow(lean(run), f"id {kind}, {SCHEMA}")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of documents with the checksum of their ids."""
    import public_tokenizers

    return pack_examples(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
