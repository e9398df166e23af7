import math
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute
from pyspark.sql import functions as F

from lexspark.llm import common, jaccard, lines, repeats, vectors
from lexspark.llm.common import components


def words(pick, n, vocabulary=500):
    return [f"w{pick.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("last", [500_000, 3])
def test_components_match_union_find(spark, monkeypatch, last):
    monkeypatch.setattr(common, "LAST_EDGES", last)
    pick = random.Random(2)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(80)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert found == {x: root(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def near_copies(pick):
    """Families of edited copies from very similar to hardly similar, copies, and texts with a common passage."""
    out = []
    for f in range(12):
        base = words(pick, pick.randrange(5, 160), 5000)
        for _ in range(pick.choice([1, 3, 8])):
            text = [f"e{pick.randrange(10**6)}" if pick.random() < pick.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            out.append(" ".join(text))
    center = words(pick, 120, 9000)
    for _ in range(150):
        text = list(center)
        for _ in range(pick.randrange(0, 7)):
            text[pick.randrange(len(text))] = f"e{pick.randrange(10**6)}"
        out.append(" ".join(text))
    passage = " ".join(words(pick, 60, 9000))
    out += [passage + " " + " ".join(words(pick, pick.randrange(5, 80), 9000)) for _ in range(60)]
    out += ["one two three four five"] * 5 + ["a b c"] * 3 + ["A B  C", "a b", "", " \t\n", None, "x y z w", "one two three four five six"]
    return out


def test_jaccard_classes_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", 32)
    monkeypatch.setattr(jaccard, "MEETING", 20)
    texts = near_copies(random.Random(11))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("h", F.lit(1))
    found = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df.repartition(5)).collect()}
    assert found == brute.jaccard_classes(rows)


def test_jaccard_links_are_all_counted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", 32)
    rows = list(enumerate(near_copies(random.Random(13))))
    # a chain in which each text links with its neighbours only, and all are of one class
    chain = [" ".join(f"c{k}" for k in range(at, at + 104)) for at in range(0, 90, 8)]
    rows += list(enumerate(chain + chain[:2], 1000))
    sets = list(brute.word_sets(rows).items())
    expected = dict.fromkeys(dict(rows), 0)
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                expected[a] += 1
                expected[b] += 1
    found = {r.id: r.n_links for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert found == expected and len(set(expected.values())) > 10


@pytest.mark.parametrize("block", [4, 4096])
def test_sets_of_one_profile_link_as_brute_force_says(spark, monkeypatch, block):
    """Sets that lack the same shingles, and have others of their own or shared ones besides, with copies."""
    monkeypatch.setattr(jaccard, "FAMILY_BLOCK", block)
    pick = random.Random(17)
    center, texts = words(pick, 100, 9000), []
    for place in (10, 40, 70):
        for second in (None, 20, 85):
            for k in range(4):
                text = list(center)
                for at in (place, second):
                    if at is not None:
                        text[at] = f"s{at}" if k == 3 else f"e{pick.randrange(10**9)}"
                texts += [" ".join(text)] * pick.choice([1, 1, 3])
    rows = list(enumerate([*texts, " ".join(center), " ".join(center)]))
    sets = brute.word_sets(rows)
    expected = {a: sum(1 for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])) for a in sets}
    found = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.id: r.n_links for r in found} == expected and len(set(expected.values())) > 3
    assert {r.id: r.component_id for r in found} == {d: c for d, (_, c) in brute.jaccard_classes(rows).items()}


def test_one_of_each_class(spark):
    rows = [(5, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y"), (9, "", "z"), (8, None, "z"), (1, "other words stand in this text", "z")]
    kept = jaccard.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string, owner string"))
    assert kept.columns == ["doc_id", "text", "owner"]
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(1, "other words stand in this text"), (3, "a b c d e f")]
    assert {r.doc_id for r in kept.collect() if not r.text} == {8, 9}
    assert jaccard.one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string, owner string").limit(0)).count() == 0


def plain_lines(rows, key, min_chars=20):
    """Texts after line dedup; ``key`` orders documents."""
    places = sorted((key(doc, text), k, line) for doc, text in rows if text is not None for k, line in enumerate(text.split("\n")) if len(line) >= min_chars)
    first = {}
    for place, k, line in places:
        first.setdefault(line, (place, k))
    gone_lines = {b for b in first for a in first if first[a] < first[b] and brute.within_one_edit(a, b)}
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, None))
            continue
        kept = [line for k, line in enumerate(text.split("\n")) if len(line) < min_chars or (line not in gone_lines and first[line] == (key(doc, text), k))]
        out.append((doc, "\n".join(kept)))
    return out


def test_line_dedup_matches_plain_version(spark):
    pick = random.Random(4)
    letters = "abcdefgh é"
    base = ["".join(pick.choice(letters) for _ in range(n)) for n in [19, 20, 21, 31, 32, 33, 63, 64, 65, 127, 128, 129, 200, 255, 256, 257, 600]]

    def edited(line):
        at, how = pick.randrange(len(line) + 1), pick.randrange(4)
        return [line, line[:at] + "Z" + line[at:], line[:at] + line[at + 1 :], line[:at] + "Y" + line[at + 1 :]][how]

    rows = []
    for doc in range(60):
        text = [edited(edited(pick.choice(base)) if pick.random() < 0.3 else pick.choice(base)) for _ in range(pick.randrange(1, 8))] + pick.choice([[], [""], ["short"], ["short", "short"]])
        rows.append((doc, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "q" * 3000), (104, "q" * 3001), (105, "q" * 1500 + "r" + "q" * 1499)]
    df = spark.createDataFrame([(d, t, "kept", 7) for d, t in rows], "doc_id long, text string, line string, n_lines int")
    out = lines.dedup_lines(df.repartition(3))
    assert out.columns == ["doc_id", "text", "line", "n_lines", "n_removed"]
    found = {r.doc_id: r.text for r in out.collect()}
    assert found == dict(plain_lines(rows, lambda doc, text: doc))
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    line = "this line is long enough to count"
    df = spark.createDataFrame([(1, line), (1, line), (None, line + "!"), (2, line + "\nend")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in lines.dedup_lines(df).collect()) == [(0, ""), (1, line), (1, line), (2, "end")]


def test_contents_of_long_lines_are_hashes(spark):
    """The second level holds a number for each place, not the rest of the content: that would be the square of its length."""
    keys = spark.range(1).select(F.explode(lines._content_keys(F.repeat(F.lit("abcdefgh"), 512), F.lit(0))).alias("c")).select("c.*")
    assert dict(keys.dtypes)["rest"] == "bigint" and keys.count() == 2 * 4096 // 2 + 1
    pick = random.Random(5)
    long = "".join(pick.choices("abcdefgh ij", k=50_000))
    rows = [(1, long), (2, long[:30_000] + "Z" + long[30_000:]), (3, long[:20_001] + long[20_002:]), (4, long[:7] + "Y" + long[8:]), (5, "Y" + long + "Y")]
    found = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: long, 2: "", 3: "", 4: "", 5: rows[4][1]}


@pytest.mark.parametrize("seed", range(3))
def test_run_index_statistics(seed):
    pick = random.Random(seed)
    texts = [bytes(pick.choice(b"ab") for _ in range(pick.randrange(1, 60))) for _ in range(30)] + [b"\0\0\0\0", b"ab" * 30]
    index = repeats.RunIndex(texts)
    found = index.matching_statistics()
    suffixes = [(t, i) for t in range(len(texts)) for i in range(len(texts[t]))]
    for t, i in suffixes:
        best = max(len(os.path.commonprefix([texts[t][i:], texts[u][j:]])) for u, j in suffixes if (u, j) != (t, i))
        assert found[int(index.starts[t]) + i] == best
    assert len(index.run_first) <= len(index.text)


def test_remove_repeats_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", 6)
    monkeypatch.setattr(repeats, "BATCH_BYTES", 4000)
    pick = random.Random(8)
    span = 100
    word = lambda n: "".join(pick.choice("abcdefé ") for _ in range(n))
    passages = [word(n) for n in (90, 100, 101, 150, 400)]
    texts = ["".join(pick.choice([word(pick.randrange(200)), pick.choice(passages)]) for _ in range(pick.randrange(1, 6))) for _ in range(60)]
    texts += [passages[3][:80] + word(300) + passages[3][80:]] * 2 + ["", None, "a" * 350, "ab" * 120, word(99), "z" * 99]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, runs int")
    out = repeats.remove_repeats(df.repartition(4), span=span)
    assert set(out.columns) == {"doc_id", "runs", "kept", "spans"}
    flags = dict(zip(range(len(texts)), brute.repeated_bytes(texts, span)))
    for r in out.collect():
        raw, f = (texts[r.doc_id] or "").encode(), flags[r.doc_id]
        assert r.kept == bytes(b for b, gone in zip(raw, f) if not gone)
        edge = np.flatnonzero(np.diff(np.array([0, *f, 0], int)))
        assert [(s["first"], s["end"]) for s in r.spans] == list(zip(edge[0::2].tolist(), edge[1::2].tolist()))
    texts_out = {r.doc_id: r.kept for r in repeats.remove_repeats(df, span=span, as_text=True).collect()}
    assert all(isinstance(t, str) for t in texts_out.values())
    assert repeats.remove_repeats(df.limit(0), span=span).count() == 0


def test_passages_of_just_over_fifty_words(spark):
    """Planted passages of 50 to 60 words in different surroundings: those of over 50 go, with or without the longer span."""
    pick = random.Random(5)
    word = lambda: "".join(pick.choice("abcdefghij") for _ in range(pick.randrange(4, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    planted = {n: prose(n) for n in range(50, 61)}
    texts = [f"{prose(80)}{k} {p} {k}{prose(70)}" for p in planted.values() for k in range(2)] + [prose(150) for _ in range(8)] + ["", None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("passages", F.lit(1))
    flags = brute.repeated_passages(texts, 200, 51)
    expected = [bytes(b for b, gone in zip((t or "").encode(), f) if not gone) for t, f in zip(texts, flags)]
    got = {r.doc_id: r for r in repeats.remove_repeats(df, span=200, words=51).collect()}
    assert [got[d].kept for d in range(len(texts))] == expected and got[0].passages == 1
    for n, p in planted.items():
        assert all((p not in expected[d].decode()) == (n > 50) for d, t in enumerate(texts) if p in (t or ""))
    both = {r.doc_id: r for r in repeats.remove_repeats(df, span=400, passage_bytes=200).collect()}
    long = brute.repeated_bytes(texts, 400)
    for d, t in enumerate(texts):
        assert both[d].kept == bytes(b for b, gone in zip((t or "").encode(), long[d]) if not gone)
        assert sum(p["end"] - p["first"] for p in both[d].passages) == sum(flags[d])


def test_one_passage_in_many_documents(spark, monkeypatch):
    """A group far beyond what one index takes, split down to single windows; neighbours agree on some letters."""
    monkeypatch.setattr(repeats, "MANY", 8)
    pick = random.Random(6)
    word = lambda n: "".join(pick.choice("abc") for _ in range(n))
    common, ends = word(300), [word(30) for _ in range(4)]
    texts = [word(pick.randrange(150)) + pick.choice(ends)[: pick.randrange(31)] + common + pick.choice(ends) + word(pick.randrange(150)) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for span in (100, 250):
        flags = brute.repeated_bytes(texts, span)
        for r in repeats.remove_repeats(df, span=span).collect():
            assert r.kept == bytes(b for b, gone in zip(texts[r.doc_id].encode(), flags[r.doc_id]) if not gone)


def test_run_index_is_run_compressed():
    text = bytes(random.Random(9).choice(b"abcd") for _ in range(500))
    index = repeats.RunIndex([text[k:] + b"x" for k in range(40)])
    assert len(index.heads) < len(index.text) // 8 and index.lengths.sum() == len(index.text)


def test_regions_cover_each_window_once(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 500)
    raw = bytes(random.Random(1).choice(b"abc") for _ in range(2345))
    got = [(s, w) for s, w, _ in repeats.regions(raw, 100)]
    assert [i for s, w in got for i in range(s, s + w)] == list(range(2345 - 99))
    where = {}
    for s, w, name in repeats.regions(raw, 100):
        for i in range(s, s + w):
            assert where.setdefault(raw[i : i + 100], name) == name


def test_near_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 40)
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        v = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 4))):
            rows.append((v + rng.normal(size=32) * 0.12 * rng.random(), k % 3))
    center = rng.normal(size=32)
    rows += [(center + rng.normal(size=32) * 0.08, 1) for _ in range(150)] + [(center, 1)] * 20 + [(center * 3, 1), (center, 2), (-center, 1)]
    data = [(i, [float(x) for x in v], int(label)) for i, (v, label) in enumerate(rows)]
    odd = [(9001, None, 1), (9002, [0.0] * 32, 1), (9003, [float("nan")] * 32, 1), (9004, [1.0] * 31 + [None], 1), (9005, [float("inf")] + [1.0] * 31, 1), (9006, [float(x) for x in center], None), (9007, [], 1), (9008, [1.0, 2.0], 1), (9009, [2.0, 4.0], 1)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<float>, label int")
    got = {r.id: r for r in vectors.near_vectors(df.repartition(4)).collect()}
    x = np.array([np.array(v, np.float32).astype(float) for _, v, _ in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in data])
    close = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    n = close.sum(1)
    found = np.array([got[i].n_links for i in range(len(data))])
    assert (found <= n).all() and found.sum() >= 0.97 * n.sum()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9001, 9008))
    assert got[9008].n_links == 1 and got[9009].component_id == 9008
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(data)))
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_rotation_balances_bits():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16)) * np.linspace(3, 0.3, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean, projection = vectors.learn_rotation(x, 16)
    share = np.where((x - mean) @ projection >= 0, 1, 0).mean(0)
    assert (abs(share - 0.5) < 0.15).all()
    assert np.allclose(projection.T @ projection, np.eye(16), atol=1e-8)


@pytest.mark.parametrize("n", [500, 20_000, 2_000_000])
def test_tables_reach_their_recall_at_each_size(n):
    """On vectors that the fit has not seen, each with a partner at just the threshold."""
    rng = np.random.default_rng(2)
    x = vectors._unit(rng.normal(size=(9000, 48)) * np.linspace(2, 0.5, 48))
    fitted = vectors.fit_tables(48, x[:4000], n, 0.98)
    width = math.ceil(math.log2(n / vectors.PER_BUCKET))
    for code in range(len(fitted.projections)):
        masks = [m for c, m in fitted.tables if c == code]
        assert sum(masks) == (1 << 64) - 1 and all(m.bit_count() >= min(width, 6) for m in masks)  # disjoint segments
    a = x[4000:]
    u = rng.normal(size=a.shape)
    u -= (u * a).sum(1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * u / np.linalg.norm(u, axis=1, keepdims=True)
    left, right = fitted.codes(a), fitted.codes(b)
    times = np.zeros(len(a), int)
    for t in range(len(fitted.tables)):
        for low in range(0, len(a), 500):
            times[low : low + 500] += fitted.first_found(left[low : low + 500], right[low : low + 500], t).diagonal()
    assert times.max() == 1 and times.mean() >= 0.99  # found, and by one table only
