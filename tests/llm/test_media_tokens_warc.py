import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

pa = pytest.importorskip("pyarrow")
import public_tokenizers
from pyspark.sql import functions as F

from lexspark.llm import bpe, gif, packing, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_vocabulary(VOCABULARY), max_words=50)


def ids_of(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


TEXTS = [
    "", " ", "Hello world", "  two  spaces \n\n\t x", "it's we'll I'D", "naïve — ça 日本語 한국어 🙂🙂", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>",
    "x" * 700, "ab" * 900, " " * 500 + "y", "1234567890" * 60, "\r\n\x0b\x0c\x85 　\x1c\x1f", "á‍﻿", "The the THE. " * 40,
]


def test_codec_matches_library(codec, library):
    for text in TEXTS:
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(codec.encode(text)) == ids, text[:40]
        assert codec.decode(codec.encode(text)) == library.decode(ids, skip_special_tokens=False)


def test_codec_on_random_text(codec, library):
    pick = random.Random(3)
    letters = "abcdeéñ .,'\n12日🙂ÀЖ\t"
    for _ in range(300):
        text = "".join(pick.choice(letters) for _ in range(pick.randrange(80)))
        assert ids_of(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_word_pattern_over_all_letters(codec, library):
    for at in range(0, 0x11000, 64):
        text = " ".join("a" + chr(c) + "b" for c in range(at, at + 64) if not 0xD800 <= c < 0xE000)
        assert ids_of(codec.encode(text)) == library.encode(text, add_special_tokens=False).ids, hex(at)


def test_decoding_broken_utf8(codec, library):
    ids = [codec.ranks[bytes([0xE2])], codec.ranks[b"a"], codec.ranks[bytes([0x80])]]
    assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_encode_decode_rows(spark):
    df = spark.createDataFrame([(1, "Hello  world", "x"), (2, None, "y"), (None, "", "z"), (1, "Hello  world", "x")], "doc_id long, text string, ids string")
    rows = bpe.encode_decode(df, VOCABULARY).collect()
    assert sorted((r.id or 0, len(r.ids) // 4, r.decoded) for r in rows) == [(0, 0, ""), (1, 3, "Hello  world"), (1, 3, "Hello  world"), (2, 0, "")]
    assert bpe.encode_decode(df.limit(0), VOCABULARY).count() == 0


def check_pieces(rows, expected: dict, limits=(2048, 256, 2048)):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for doc, ids in expected.items():
        parts = sorted(by_doc[doc], key=lambda r: r.start)
        assert [i for p in parts for i in ids_of(p.ids)] == ids
        assert [p.start for p in parts] == list(np.cumsum([0, *[p.length for p in parts]])[:-1])
        assert all(p.doc_tokens == len(ids) and p.length == len(p.ids) // 4 > 0 for p in parts)
    padding = 0
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == list(np.cumsum([0, *[p.length for p in parts]])[:-1])
        total = sum(p.length for p in parts)
        assert total <= limits[0] and len(parts) <= limits[1] and sum(p.loss_tokens for p in parts) <= limits[2]
        padding += 0 if total & (total - 1) == 0 else limits[0] - total
    return padding, sum(len(x) for x in expected.values())


def test_packing_covers_each_id_once(spark, library):
    pick = random.Random(5)
    texts = [" ".join(pick.choice(["alpha", "be", "gamma ray", "d"]) for _ in range(int(pick.paretovariate(0.6) * 20) % 6000)) for _ in range(300)] + ["", " " * 9000 + "x", "q" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1000, None)], "doc_id long, text string")
    rows = packing.pack_examples(df, VOCABULARY).collect()
    expected = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in enumerate([*texts])} | {1000: [1]}
    padding, total = check_pieces(rows, expected)
    assert padding <= 0.01 * total


def test_packing_keeps_three_limits(spark, library):
    df = spark.createDataFrame([(i, "w " * (i % 90), "ask " * (i % 7)) for i in range(400)], "doc_id long, text string, prompt string")
    rows = packing.pack_examples(df, VOCABULARY, prompt_col="prompt", max_tokens=512, max_segments=6, max_loss_tokens=300).collect()
    enc = lambda t: library.encode(t, add_special_tokens=False).ids
    check_pieces(rows, {i: enc("ask " * (i % 7)) + enc("w " * (i % 90)) + [1] for i in range(400)}, (512, 6, 300))
    losses = {}
    for r in rows:
        losses[r.id] = losses.get(r.id, 0) + r.loss_tokens
    assert losses == {i: len(enc("w " * (i % 90))) + 1 for i in range(400)}


def test_packing_without_cuts_and_empty_table(spark):
    df = spark.createDataFrame([(i, "w " * (i % 50)) for i in range(100)], "doc_id long, text string")
    rows = packing.pack_examples(df, VOCABULARY, cut=False, max_tokens=128).collect()
    assert len(rows) == 100 and all(r.start == 0 and r.length == r.doc_tokens for r in rows)
    assert packing.pack_examples(df.limit(0), VOCABULARY).count() == 0


def test_lzw_round_trip():
    pick = random.Random(1)
    for data in [b"", b"a", b"\0" * 64, bytes(range(256)) * 40, b"abab" * 9000, bytes(pick.randrange(256) for _ in range(30_000)), bytes(pick.randrange(3) for _ in range(50_000))]:
        assert gif.lzw_decode(gif.lzw_encode(data), 8) == data
    small = bytes(pick.randrange(4) for _ in range(20_000))
    assert gif.lzw_decode(gif.lzw_encode(small, 2), 2) == small


def test_lzw_stream_without_clear_when_full():
    # a writer may keep the full table: literal codes of twelve bits follow
    codes, free = [256], 258
    data = bytes(i % 251 for i in range(5000))
    codes += list(data)
    bits = n = 0
    out = bytearray()
    width, seen = 9, -1
    for c in [*codes, 257]:
        bits |= c << n
        n += width
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8
        seen += 1
        width = min(12, max(9, (257 + seen).bit_length()))
    out.append(bits & 255)
    assert gif.lzw_decode(bytes(out), 8) == data


def test_gif_rules_of_display():
    palette = gif.byte_palette()
    full = np.full((4, 4), 7, np.uint8)
    spot = np.array([[9, 3], [3, 9]], np.uint8)
    data = gif.encode_gif(
        [gif.Frame(0, 0, full, palette, 50, 1), gif.Frame(1, 1, spot, palette, 20, 3, 3), gif.Frame(0, 0, spot, palette, 30, 2), gif.Frame(3, 3, spot[:1, :1], palette, 10, 0)], (4, 4), palette
    )
    size, frames = gif.decode_gif(data)
    assert size == (4, 4) and [f.delay_ms for f in frames] == [50, 20, 30, 10]
    shown = [s.copy() for s in gif.render(size, frames)]
    assert (shown[0][..., :3] == palette[7]).all()
    assert (shown[1][1, 1, :3] == palette[9]).all() and (shown[1][1, 2, :3] == palette[7]).all()  # transparent pixels show what was there
    assert (shown[2][1, 1, :3] == palette[9]).all() and (shown[2][2, 2, :3] == palette[7]).all()  # restored to what it was
    assert (shown[3][:2, :2, 3] == 0).all() and (shown[3][3, 3, :3] == palette[9]).all()  # restored to the background
    assert gif.histogram(shown[3]).sum() == 12


def test_interlaced_rows_and_local_palette():
    rows = np.arange(10, dtype=np.uint8).repeat(3).reshape(10, 3)
    order = np.concatenate([np.arange(a, 10, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
    stream = gif.lzw_encode(rows[order].tobytes(), 4)
    local = bytes(range(48))
    data = b"GIF89a" + struct.pack("<HHBBB", 3, 10, 0, 0, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, 3, 10, 0xC3) + local + b"\x04" + bytes([len(stream)]) + stream + b"\0\x3b"
    _, frames = gif.decode_gif(data)
    assert (frames[0].samples == rows).all() and frames[0].palette[5].tolist() == [15, 16, 17]


def test_media_of_texts(spark):
    texts = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 64), (5, "ab\n" * 700_000), (1, "héllo")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = gif.media_columns(gif.store_texts(df)).collect()
    assert len(rows) == 6
    for r in rows:
        raw = (dict(texts)[r.id] or "").encode()
        assert r.n_bytes == len(raw) and r.payload == raw + bytes(-len(raw) % 64 if raw else 64) and sum(r.colours) == len(r.payload)
    assert {r.id: r.n_frames for r in rows}[5] == 3
    assert gif.media_columns(gif.store_texts(df.limit(0))).count() == 0
    assert gif.frames_table(gif.store_texts(df)).where("id = 5").count() == 3


def test_op9_digests(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in gif.op9_gif_media(spark, sf_dir).collect():
        payload = gif.payload_of(texts[r.doc_id])
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:]) and r.payload_bytes == len(payload)


HARD = ["WARC/1.1\r\nrest", "a\r\n\r\nWARC/1.1\r\nb\r\n\r\nWARC/1.1\r\n", "ends\r\n", "ends\r\n\r\n", "ends\r", "\r\n\r\n", "WARC", "", "WARC/1.1", "x\r\n\r\nWARC/1.1", "x\r\n\r\nWARC/1.1\r", "WARC/1.1WARC/1.1"]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_round_trip_of_hard_payloads(spark, tmp_path, compression):
    pages = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", p) for i, p in enumerate(HARD)] + [(100, None, None)], "page_id long, url string, html string")
    path = warc.write_warc(warc.resolve_revisits(warc.to_records(pages)).coalesce(1), f"file://{tmp_path}/w", compression=compression)
    rows = {r.id: r for r in warc.read_warc(spark, path).collect()}
    assert {i: rows[i].payload for i in range(len(HARD))} == dict(enumerate(HARD)) and rows[100].payload == ""
    assert len(rows) == len(HARD) + 1 and rows[0].uri == "http://a/0%20%20X:%20y"


def test_warc_revisits(spark, tmp_path):
    big, other = "é" * 600, "z" * 1000
    rows = [(1, "u1", big), (5, "u5", big), (3, "u3", big), (3, "u3", big), (7, "u", "small"), (8, "u", "small"), (9, None, other), (None, "n", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_warc(warc.resolve_revisits(warc.to_records(pages)), f"file://{tmp_path}/w")
    got = sorted((r.id or 0, r.n_bytes, r.digest, r.type, r.refers_to) for r in warc.resolved(warc.read_warc(spark, path)).collect())
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert len(got) == 8
    assert {(r[0], r[3], r[4]) for r in got} == {(1, "revisit", 5), (3, "revisit", 5), (5, "response", None), (7, "response", None), (8, "response", None), (9, "response", None), (0, "revisit", 9)}
    assert all(r[2] in {sha(big), sha("small"), sha(other)} for r in got) and {r[1] for r in got if r[0] in (1, 3, 5)} == {1200}


def test_warc_records_are_gzip_members(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 50) for i in range(5)], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(warc.resolve_revisits(warc.to_records(pages)).coalesce(1), f"file://{tmp_path}/w")
    (file,) = tmp_path.glob("w/*.warc.gz")
    raw, records = file.read_bytes(), []
    while raw:
        member = zlib.decompressobj(31)
        records.append(member.decompress(raw))
        raw = member.unused_data
    records = [r for r in records if r]
    assert len(records) == 6 and records[0].startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and all(r.endswith(b"\r\n\r\n") for r in records)
    for r in records:
        head, _, block = r.partition(b"\r\n\r\n")
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert block[size:] == b"\r\n\r\n"


def test_warc_of_an_empty_table_and_clashing_columns(spark, tmp_path):
    schema = "page_id long, url string, html string, id int, payload string, digest string, refers_to string, type int"
    for rows in ([], [(1, "u", "x" * 2000, 7, "p", "d", "r", 8), (2, "u", "x" * 2000, 7, "p", "d", "r", 8)]):
        pages = spark.createDataFrame(rows, schema)
        path = warc.write_warc(warc.resolve_revisits(warc.to_records(pages)), f"file://{tmp_path}/{len(rows)}")
        got = sorted((r.id, r.n_bytes, r.type, r.refers_to) for r in warc.resolved(warc.read_warc(spark, path)).collect())
        assert got == ([(1, 2000, "revisit", 2), (2, 2000, "response", None)] if rows else [])


def test_media_columns_replace_their_namesakes(spark):
    df = gif.store_texts(spark.createDataFrame([(1, "ab")], "doc_id long, text string")).withColumn("payload", F.lit("x")).withColumn("n_frames", F.lit(9)).withColumn("other", F.lit(3))
    out = gif.media_columns(df)
    assert out.columns == ["id", "n_bytes", "media", "other", "payload", "n_frames", "duration_ms", "colours"]
    (row,) = out.collect()
    assert row.payload == b"ab" + bytes(62) and row.n_frames == 1 and row.other == 3


def test_op9_feature(spark, sf_dir):
    """Frames, time and colour counts, from the texts alone."""
    palette = gif.byte_palette().astype(int)
    cell = [(r // 32 * 8 + g // 32) * 8 + b // 32 for r, g, b in palette.tolist()]
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in gif.op9_gif_media(spark, sf_dir).collect():
        payload = gif.payload_of(texts[r.doc_id])
        frames = -(-len(payload) // 64 // gif.MAX_ROWS)
        counts = {}
        for byte in payload:
            counts[cell[byte]] = counts.get(cell[byte], 0) + 1
        assert r.feature == f"{frames} frames;{frames * gif.DELAY_CS * 10} ms;" + ",".join(f"{c}:{n}" for c, n in sorted(counts.items()))
