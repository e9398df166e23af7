"""GIF as a media column: an encoder, an LZW decoder, rendering of timed frames, colour histograms.

Codes are packed and unpacked with numpy: between two clear codes, a code's width depends on its place
alone. Strings are rebuilt with one table of byte strings per clear code. Rendering applies the local or
global palette, the transparent index, interlacing and the disposal rule of each frame.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: code limit, extension labels, block marks, and the four passes of interlaced rows.
MAX_CODES = 4096
EXTENSION, IMAGE, TRAILER, CONTROL = 0x21, 0x2C, 0x3B, 0xF9
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))
WIDTH, MAX_ROWS, DELAY_CS = 64, 16_384, 10
BINS = 8


@lru_cache(maxsize=16)
def _code_widths(min_size: int, n: int) -> np.ndarray:
    """Widths of the first ``n`` codes after a clear code."""
    known = np.minimum((1 << min_size) + 1 + np.arange(n), MAX_CODES - 1)  # the largest code the next entry leaves in use
    return np.maximum(min_size + 1, np.floor(np.log2(np.maximum(known, 1))).astype(np.int64) + 1)


def _lzw_codes(data: bytes, min_size: int) -> list[int]:
    clear = 1 << min_size
    first, stop = clear + 2, MAX_CODES - 1
    codes, table, free = [clear], {}, first
    if not data:
        return [clear, clear + 1]
    put, get = codes.append, table.get
    word, rest = data[0], data[1:]
    for byte in rest:
        key = word << 8 | byte
        found = get(key)
        if found is not None:
            word = found
            continue
        put(word)
        table[key] = free
        free += 1
        word = byte
        if free == stop:
            put(clear)
            table.clear()
            free = first
    put(word)
    put(clear + 1)
    return codes


def _place(codes: np.ndarray, clear: int) -> np.ndarray:
    """How many codes stand between each code and the last clear code before it."""
    at = np.arange(len(codes))
    last = np.maximum.accumulate(np.where(codes == clear, at, -1))
    before = np.concatenate([[-1], last[:-1]])
    return at - before - 1


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """The LZW stream of samples below ``1 << min_size``, without sub-blocks."""
    codes = np.array(_lzw_codes(data, min_size), dtype=np.int64)
    widths = _code_widths(min_size, MAX_CODES)[np.minimum(_place(codes, 1 << min_size), MAX_CODES - 1)]
    ends = np.cumsum(widths)
    at = ends - widths
    value, byte, size = codes << (at & 7), at >> 3, int(ends[-1] + 7) // 8 + 2
    out = sum(np.bincount(byte + k, ((value >> (8 * k)) & 255).astype(float), size) for k in range(3))
    return out.astype(np.uint8).tobytes()[: int(ends[-1] + 7) // 8]


def lzw_decode(stream: bytes, min_size: int) -> bytes:
    """The samples of an LZW stream; one that ends early gives what it holds, a code beyond the table is an error."""
    clear = 1 << min_size
    raw = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.int64)
    bits, at, out = 8 * len(stream), 0, []
    start = [bytes((i,)) for i in range(clear)] + [b"", b""]
    widths = _code_widths(min_size, 2 * MAX_CODES)
    offsets = np.concatenate([[0], np.cumsum(widths)])
    table, before, seen = start[:], None, 0  # seen: codes since the last clear code
    while at < bits:
        low = min(seen, MAX_CODES)
        where = at + offsets[low : low + MAX_CODES] - offsets[low]
        width = widths[low : low + MAX_CODES]
        fits = int(np.searchsorted(where + width, bits, side="right"))
        if not fits:
            break
        where, width = where[:fits], width[:fits]
        byte = where >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (where & 7)) & ((1 << width) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        n = int(marks[0]) if len(marks) else fits
        for code in codes[:n].tolist():
            if code < len(table):
                word = table[code]
            elif code == len(table) and before is not None:
                word = before + before[:1]
            else:
                raise ValueError("LZW code beyond the table")
            out.append(word)
            if before is not None and len(table) < MAX_CODES:
                table.append(before + word[:1])
            before = word
        if len(marks):
            if codes[n] == clear + 1:
                break
            at += int(where[n] + width[n]) - at
            table, before, seen = start[:], None, 0
        else:
            at, seen = int(where[-1] + width[-1]), seen + n
    return b"".join(out)


@dataclass
class Frame:
    """A decoded image block: its place, palette indices by row, colours, and how it is shown."""

    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay_ms: int = 0
    disposal: int = 0
    transparent: int | None = None


def encode_gif(frames: list[Frame], size: tuple[int, int], palette: np.ndarray) -> bytes:
    """An animated GIF with a global palette of 256 colours; frames are stored row by row."""
    out = [b"GIF89a", struct.pack("<HHBBB", size[0], size[1], 0xF7, 0, 0), palette.astype(np.uint8).tobytes()]
    for f in frames:
        clear = f.transparent is not None
        out.append(struct.pack("<BBBBHBB", EXTENSION, CONTROL, 4, f.disposal << 2 | clear, f.delay_ms // 10, f.transparent or 0, 0))
        out.append(struct.pack("<BHHHHBB", IMAGE, f.left, f.top, f.samples.shape[1], f.samples.shape[0], 0, 8))
        stream = lzw_encode(f.samples.tobytes())
        for i in range(0, len(stream), 255):
            part = stream[i : i + 255]
            out += [bytes((len(part),)), part]
        out.append(b"\0")
    return b"".join([*out, bytes((TRAILER,))])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> tuple[tuple[int, int], list[Frame]]:
    """Screen size (width, height) and the image blocks of a GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    colours = lambda at, bits: np.frombuffer(data, np.uint8, 3 << (bits + 1), at).reshape(-1, 3)
    at, shared = 13, np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        shared = colours(at, flags & 7)
        at += 3 << ((flags & 7) + 1)
    frames, delay, disposal, transparent = [], 0, 0, None
    while data[at] != TRAILER:
        if data[at] == EXTENSION:
            body, end = _blocks(data, at + 2)
            if data[at + 1] == CONTROL:
                packed, ticks, index = struct.unpack_from("<BHB", body)
                delay, disposal, transparent = ticks * 10, packed >> 2 & 7, index if packed & 1 else None
            at = end
        elif data[at] == IMAGE:
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = shared
            if packed & 0x80:
                palette = colours(at, packed & 7)
                at += 3 << ((packed & 7) + 1)
            stream, end = _blocks(data, at + 1)
            samples = np.zeros(w * h, np.uint8)
            found = np.frombuffer(lzw_decode(stream, data[at]), np.uint8)[: w * h]
            samples[: len(found)] = found
            samples = samples.reshape(h, w)
            if packed & 0x40:
                rows = np.concatenate([np.arange(a, h, step) for a, step in PASSES])
                straight = np.empty_like(samples)
                straight[rows] = samples
                samples = straight
            frames.append(Frame(left, top, samples, palette, delay, disposal, transparent))
            delay, disposal, transparent, at = 0, 0, None, end
        else:
            raise ValueError("unknown block in a GIF")
    return (width, height), frames


def render(size: tuple[int, int], frames: list[Frame]) -> Iterator[np.ndarray]:
    """The screen as shown with each frame: rows x columns x (red, green, blue, opaque)."""
    screen = np.zeros((size[1], size[0], 4), np.uint8)
    for f in frames:
        h, w = f.samples.shape
        area = (slice(f.top, f.top + h), slice(f.left, f.left + w))
        kept = screen.copy() if f.disposal == 3 else None
        view = screen[area]
        part = f.samples[: view.shape[0], : view.shape[1]]
        colour = np.zeros((256, 4), np.uint8)
        colour[: len(f.palette), :3], colour[: len(f.palette), 3] = f.palette, 255
        if f.transparent is None:
            view[:] = colour[part]
        else:
            view[:] = np.where((part != f.transparent)[..., None], colour[part], view)
        yield screen
        if f.disposal == 2:
            screen[area] = 0
        elif kept is not None:
            screen = kept


def histogram(screen: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of opaque pixels by (red, green, blue) bin."""
    step = 256 // bins
    q = screen[..., :3].astype(np.int32) // step
    cell = (q[..., 0] * bins + q[..., 1]) * bins + q[..., 2]
    return np.bincount(cell[screen[..., 3] > 0].ravel(), minlength=bins**3)


def byte_palette() -> np.ndarray:
    """256 different colours: three bits of red, three of green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 36, (i >> 2 & 7) * 36, (i & 3) * 85], axis=1).astype(np.uint8)


def payload_of(raw: bytes) -> bytes:
    """``raw`` with zero bytes up to a positive multiple of the row width."""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def payload_to_gif(payload: bytes) -> bytes:
    """Rows of 64 samples, in frames of at most ``MAX_ROWS`` rows; each is cleared before the next is shown."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    palette = byte_palette()
    frames = [Frame(0, 0, rows[a : a + MAX_ROWS], palette, DELAY_CS * 10, 2) for a in range(0, len(rows), MAX_ROWS)]
    return encode_gif(frames, (WIDTH, min(len(rows), MAX_ROWS)), palette)


def store_texts(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows (id, n_bytes, media): each text's UTF-8 bytes as the samples of a GIF. Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(t or "").encode() for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([payload_to_gif(payload_of(x)) for x in raw], pa.binary())], ["id", "n_bytes", "media"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")


def frames_table(df: DataFrame, media_col: str = "media", id_col: str = "id") -> DataFrame:
    """One row per frame: (id, frame, shown_at_ms, delay_ms, width, height, samples, histogram).

    ``samples`` are palette indices by row; ``histogram`` counts the rendered screen's opaque pixels by
    colour bin. A null media value has no frames; one that is no GIF is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                media = batch.column("m")[i].as_py()
                if media is None:
                    continue
                size, frames = decode_gif(media)
                at = 0
                for k, (f, screen) in enumerate(zip(frames, render(size, frames))):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(i, 1), *(pa.array([x], pa.int64()) for x in (k, at, f.delay_ms, *f.samples.shape[::-1])),
                         pa.array([f.samples.tobytes()], pa.binary()), pa.array([histogram(screen)], pa.list_(pa.int64()))],
                        ["id", "frame", "shown_at_ms", "delay_ms", "width", "height", "samples", "histogram"],
                    )
                    at += f.delay_ms

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, frame long, shown_at_ms long, delay_ms long, width long, height long, samples binary, histogram array<long>"
    return df.select(F.col(id_col).alias("id"), F.col(media_col).alias("m")).mapInArrow(run, schema)


def media_columns(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds (payload, n_frames, duration_ms, colours) to rows with a GIF: samples of all frames, and their summed histogram.

    Columns of these names are replaced. A null media value has no frames and an empty payload; one that is no GIF is an error.
    """
    df = df.drop(*({"payload", "n_frames", "duration_ms", "colours"} - {media_col}))
    schema = df.schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                payload, n, duration, colours = [], [], [], []
                for media in part.column(media_col).to_pylist():
                    size, frames = decode_gif(media) if media is not None else ((0, 0), [])
                    counts = sum((histogram(s) for s in render(size, frames)), np.zeros(BINS**3, np.int64))
                    payload.append(b"".join(f.samples.tobytes() for f in frames))
                    n.append(len(frames))
                    duration.append(sum(f.delay_ms for f in frames))
                    colours.append(counts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(payload, pa.binary()), pa.array(n, pa.int64()), pa.array(duration, pa.int64()), pa.array(colours, pa.list_(pa.int64()))],
                    [*part.schema.names, "payload", "n_frames", "duration_ms", "colours"],
                )

    return df.mapInArrow(run, f"{fields}, payload binary, n_frames long, duration_ms long, colours array<long>")


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as a GIF, read back from the stored bytes."""
    stored = store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    read = media_columns(stored)
    size = F.octet_length("payload")
    cells = F.filter(F.transform("colours", lambda n, i: F.struct(i.alias("i"), n.alias("n"))), lambda c: c.n > 0)
    listed = F.array_join(F.transform(cells, lambda c: F.concat(c.i.cast("string"), F.lit(":"), c.n.cast("string"))), ",")
    return read.select(
        F.col("id").alias("doc_id"), "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substr(F.col("payload"), size - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", F.concat(F.col("n_frames").cast("string"), F.lit(" frames")), F.concat(F.col("duration_ms").cast("string"), F.lit(" ms")), listed).alias("feature"),
    )
