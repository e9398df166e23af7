"""Byte-pair encoding and decoding with a contiguous rank array per word.

A text is cut at special tokens, then into words by the vocabulary's pattern. For each word the part
boundaries and the ranks of adjacent pairs are two short lists: the smallest rank is found by a scan,
its boundary is deleted, and the two neighbouring ranks are refreshed. Words recur, so their ids are
kept packed in a bounded table per task. Words beyond ``LONG_WORD`` bytes, where repeated scans would
cost the square of the length, are merged in the same order through a heap over linked parts.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the word pattern that byte-level vocabularies of this family share.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256
NO_RANK = 1 << 62


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(moved)}


def load_vocabulary(path: str) -> dict:
    """Reads a tokenizers file of byte-level BPE: (ranks: bytes -> id, special: text -> id).

    Ids must rise with merge order; then a token's id is its merge rank.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {raw(token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    order = [ranks[raw(a + b)] for a, b in merges]
    if order != sorted(set(order)):
        raise ValueError("ids of merged tokens do not rise with merge order")
    return {"ranks": ranks, "special": special}


class Codec:
    """Encodes texts to little-endian 32-bit ids and decodes them."""

    def __init__(self, vocabulary: dict, max_words: int = 300_000):
        self.ranks: dict[bytes, int] = vocabulary["ranks"]
        self.special: dict[str, int] = vocabulary["special"]
        self._words = regex.compile(PATTERN).findall
        self._cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._pieces = {i: b for b, i in self.ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        codec = self

        class Packed(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= max_words:
                    self.clear()
                self[word] = ids = np.array(codec.word_ids(word.encode()), dtype="<u4").tobytes()
                return ids

        self._packed = Packed()

    def word_ids(self, word: bytes) -> list[int]:
        if len(word) > LONG_WORD:
            return self._long_word_ids(word)
        get, starts = self.ranks.get, list(range(len(word) + 1))
        near = [get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
        while near and (least := min(near)) != NO_RANK:
            i = near.index(least)
            del starts[i + 1], near[i]
            if i < len(near):
                near[i] = get(word[starts[i] : starts[i + 2]], NO_RANK)
            if i:
                near[i - 1] = get(word[starts[i - 1] : starts[i + 1]], NO_RANK)
        return [self.ranks[word[a:b]] for a, b in zip(starts, starts[1:])]

    def _long_word_ids(self, word: bytes) -> list[int]:
        n, get = len(word), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
        rank = [get(word[i : i + 2], NO_RANK) for i in range(n - 1)] + [NO_RANK]
        heap = [(r, i) for i, r in enumerate(rank) if r != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = end[i]
            end[i], rank[j] = end[j], NO_RANK
            if end[i] < n:
                before[end[i]] = i
            for k in (before[i], i):
                if k >= 0:
                    rank[k] = get(word[k : end[end[k]]], NO_RANK) if end[k] < n else NO_RANK
                    if rank[k] != NO_RANK:
                        heapq.heappush(heap, (rank[k], k))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of ``text`` as packed little-endian unsigned 32-bit integers."""
        look = self._packed.__getitem__
        if self._cut is None or not self._cut.search(text):
            return b"".join(map(look, self._words(text)))
        return b"".join(
            np.array([self.special[part]], dtype="<u4").tobytes() if part in self.special else b"".join(map(look, self._words(part)))
            for part in self._cut.split(text)
        )

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        pieces = self._pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


def encode_decode(df: DataFrame, vocabulary_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, ids: packed little-endian u32, decoded: string), one per row of ``df``.

    A null text is an empty one: no ids, empty text. Rows may repeat. The vocabulary is read on the
    driver and broadcast: its size is fixed by the file, whatever the data.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                ids = [codec.encode(t or "") for t in rows.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())], ["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, ids binary, decoded string")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded, as digests."""
    import public_tokenizers

    out = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
