import math
import os
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from pyspark.sql import functions as F

from lexspark.llm import gru, langid

LETTERS = {"aa": ["ban", "lor", "tim", "ka"], "bb": ["sche", "ung", "über", "dem"], "cc": ["ció", "ñar", "que", "los"]}


def text_in(pick, lang, n=40):
    return " ".join("".join(pick.choice(LETTERS[lang]) for _ in range(pick.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    pick = random.Random(1)
    return spark.createDataFrame([(text_in(pick, lang), lang) for lang in LETTERS for _ in range(30)], "text string, lang string")


@pytest.fixture(scope="module")
def model(labelled):
    return langid.fit_model(labelled, rows=80)


def test_held_out_accuracy(spark, model):
    pick = random.Random(2)
    rows = [(i, text_in(pick, lang, 12), lang) for i, lang in enumerate(list(LETTERS) * 30)]
    found = langid.identify(spark.createDataFrame(rows, "id long, text string, lang string"), model, F.col("text")).collect()
    assert all(r.lang_found == r.lang and r.accepted for r in found)


def test_rare_languages_have_models(spark):
    pick = random.Random(9)
    rows = [(text_in(pick, "aa"), "aa") for _ in range(2000)] + [(text_in(pick, "bb"), "BB") for _ in range(6)] + [(text_in(pick, "cc"), "cc")] * 50
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert langid.fit_model(df, rows=80).languages == ["aa", "bb"]  # cc has one distinct text


def test_documents_in_a_declared_language_without_a_model_stay(spark):
    pick = random.Random(10)
    rows = [(i, text_in(pick, "aa"), "aa", "s") for i in range(20)] + [(20, "漢字" * 40, "zz", "s"), (21, "漢字" * 40, None, "s")]
    kept = langid.accepted_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert {r.doc_id for r in kept.collect()} == set(range(21))


def test_evidence_beside_the_text(spark, model):
    pick = random.Random(3)
    rows = [(i, text_in(pick, "bb"), "bb-XX", "www.site.bb") for i in range(40)] + [(100 + i, text_in(pick, "cc"), "cc", "other.site.cc") for i in range(40)]
    rows += [(500, "", None, "www.site.bb"), (501, "", "cc", None), (502, None, None, None), (503, "12345 !!! 678", "bb", "www.site.bb"), (504, "x", None, "new.site.bb")]
    df = spark.createDataFrame(rows, "id long, text string, tag string, host string")
    got = {r.id: r for r in langid.identify(df, model, F.col("text"), F.col("tag"), F.col("host")).collect()}
    assert got[500].lang_found == "bb" and got[501].lang_found == "cc" and got[504].lang_found == "bb"
    assert not any(got[i].accepted for i in (500, 501, 502, 503)) and got[502].text_lang is None
    assert all(got[i].lang_found == "bb" and got[i].accepted for i in range(40))


def test_texts_in_no_known_language_are_rejected(spark, model):
    pick = random.Random(5)
    junk = ["".join(pick.choice("qxzjwvyhgp") for _ in range(200)) for _ in range(5)] + ["漢字" * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "id long, text string")
    assert langid.identify(df, model, F.col("text")).where("accepted").count() == 0


def test_clashing_columns_and_empty_table(spark, model):
    df = spark.createDataFrame([(1, text_in(random.Random(1), "aa"), 0.1, "p")], "id long, text string, lang_probability double, tag string").withColumn("scores", F.lit(1)).withColumn("host", F.lit("h"))
    out = langid.identify(df, model, F.col("text"))
    assert out.first().lang_found == "aa" and out.columns[:2] == ["id", "text"] and "scores" in out.columns
    assert langid.identify(df.limit(0), model, F.col("text")).count() == 0


def test_page_text(spark):
    html = '<html lang="de"><!-- x --><script>var a="<p>";</script><p class="y">Hallo <b>Welt</b></p></html>'
    row = spark.createDataFrame([(html,)], "h string").select(langid.page_text(F.col("h")).alias("t")).first()
    assert row.t.split() == ["Hallo", "Welt"]


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    mass, place = rng.random(gru.UNITS) + 0.1, rng.permutation(gru.UNITS)
    model = gru.Gru(gru.Gru.start(mass / mass.sum(), place), place)
    units, first = rng.integers(0, gru.UNITS, (5, 3)), np.zeros((5, 3), bool)
    first[0], first[3, 1] = True, True
    weight = np.full(15, 1 / 15, np.float32)

    def loss():
        states, _ = model.run(np.zeros((3, gru.STATE), np.float32), units, first)
        return -float(model.log_probabilities(states.reshape(-1, gru.STATE), units.ravel()).astype(np.float64).mean())

    flat = np.zeros_like(model.flat)
    grads, kept = gru.Gru.views(flat), {}
    states, _ = model.run(np.zeros((3, gru.STATE), np.float32), units, first, kept)
    _, d = model.log_probabilities(states.reshape(-1, gru.STATE), units.ravel(), grads, weight)
    model.back(kept, states, units, first, d.reshape(states.shape), grads)
    strong = np.argsort(-abs(flat))[:40]
    for i in strong:
        old = model.flat[i]
        model.flat[i] = old + 1e-2
        up = loss()
        model.flat[i] = old - 1e-2
        down = loss()
        model.flat[i] = old
        assert (up - down) / 2e-2 == pytest.approx(flat[i], rel=0.05, abs=2e-4)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    mass, place = rng.random(gru.UNITS) + 0.1, rng.permutation(gru.UNITS)
    model = gru.Gru(gru.Gru.start(mass / mass.sum(), place), place)
    state = rng.normal(size=gru.STATE).astype(np.float32)
    every = np.arange(gru.UNITS)
    assert np.exp(model.log_probabilities(np.tile(state, (gru.UNITS, 1)), every).astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(2)
    mass, place = np.ones(gru.UNITS), rng.permutation(gru.UNITS)
    model = gru.Gru(gru.Gru.start(mass / mass.sum(), place), place)
    texts = [rng.integers(0, gru.UNITS, n).astype(np.int16) for n in (1, 3, 70, 16, 17, 200)]
    together = gru.score(model, texts)
    for t, s in zip(texts, together):
        states, _ = model.run(np.zeros((1, gru.STATE), np.float32), t[:, None], np.arange(len(t))[:, None] == 0)
        assert model.log_probabilities(states[:, 0], t).sum() == pytest.approx(s, rel=1e-4)


def test_scores_of_documents(spark):
    pick = random.Random(7)
    habits = [["Red", "green", "blue"], ["eins", "zwei", "drei"]]
    rows = [(i, " ".join(pick.choice(habits[i % 2]) if pick.random() < 0.9 else f"rare{pick.randrange(400)}" for _ in range(pick.randrange(20, 120)))) for i in range(400)]
    rows += [(1000, ""), (1001, None), (1002, "never seen words only"), (1002, "never seen words only"), (None, "red")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = gru.score_documents(df.repartition(3)).collect()
    counts = Counter()
    learnt = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    for i, t in rows:
        if learnt(i):
            counts.update([*(t or "").lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    expected = {}
    for i, t in rows:
        words = [*(t or "").lower().split(), None]
        expected[i] = (not learnt(i), len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expected[r.id][:4] and r.base_score == pytest.approx(expected[r.id][4], rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    held = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert gru.score_documents(df.limit(0)).count() == 0
    alone = gru.score_documents(spark.createDataFrame([(i, "x y") for i in range(1, 400) if not learnt(i)], "doc_id long, text string"))
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in alone.collect())


def grouped_model(words=900, seed=4):
    """A model over ``words`` words with random weights, most of them in groups, and its layout."""
    rng = np.random.default_rng(seed)
    names = [f"{i:x}{'ab'[i % 2]}en".encode() for i in range(words)]
    layout = gru.Layout(names, np.arange(words, 0, -1))
    mass, place = rng.random(layout.units) + 0.1, rng.permutation(layout.units)
    vectors = rng.normal(0, 0.4, (2, len(layout.group), gru.STATE))
    return gru.Gru(gru.Gru.start(mass / mass.sum(), place, classes=layout.classes), place, layout.classes, layout.group, layout.share, vectors), layout


def test_every_frequent_word_has_a_code_of_its_own():
    for words in (0, 100, 159, 160, 900, 40_000):
        names = [f"{i}en".encode() for i in range(words)]
        layout = gru.Layout(names, np.arange(words, 0, -1))
        assert len(set(layout.codes.tolist())) == words and layout.units == layout.classes * layout.members and layout.endings >= gru.ENDINGS
        assert len(layout.group) == max(0, words - gru.SINGLE + 1) and np.bincount(layout.group, minlength=1).max() <= 256
        groups = np.bincount(layout.group, layout.share, layout.units)[np.unique(layout.group)]
        assert np.allclose(groups, 1, atol=1e-5)
    assert gru.unpacked_codes(gru.packed_codes(layout.codes)).tolist() == layout.codes.tolist()
    assert layout.units > gru.UNITS  # grows with the words


def test_probabilities_of_all_words_sum_to_one():
    model, layout = grouped_model()
    state = np.random.default_rng(1).normal(size=gru.STATE).astype(np.float32)
    total = np.exp(model.log_probabilities(np.tile(state, (model.units, 1)), np.arange(model.units)).astype(float))
    words = np.arange(len(layout.group))
    within = np.exp(model.tilts(np.tile(state, (len(words), 1)), words).astype(float)) * layout.share
    groups = np.unique(layout.group)
    assert np.allclose(np.bincount(layout.group, within, model.units)[groups], 1, atol=1e-4)
    everything = total.sum() - total[groups].sum() + (total[layout.group] * within).sum()
    assert everything == pytest.approx(1, abs=1e-4) and abs(within - layout.share).max() > 1e-3


def test_gradients_of_word_vectors_by_differences():
    model, layout = grouped_model()
    rng = np.random.default_rng(6)
    words = np.sort(rng.integers(0, len(layout.group), 300))
    states = rng.normal(size=(300, gru.STATE)).astype(np.float32)
    grads = np.zeros(model.vout.shape)
    for low, high, g in model.word_gradients(states, words):
        grads[low:high] += g
    for at in np.argsort(-abs(grads).ravel())[:20]:
        old, ends = model.vout.flat[at], []
        for by in (1e-2, -1e-2):
            model.vout.flat[at] = old + by
            ends.append(-float(model.tilts(states, words).astype(float).sum()))
        model.vout.flat[at] = old
        assert (ends[0] - ends[1]) / 2e-2 == pytest.approx(grads.flat[at], rel=0.02, abs=1e-2)

    units, first, weight = rng.integers(0, model.units + len(layout.group), (5, 3)), np.zeros((5, 3), bool), np.full(15, 1 / 15, np.float32)
    units[1:4] = model.units + rng.integers(0, len(layout.group), (3, 3))

    def loss():
        found, _ = model.run(np.zeros((3, gru.STATE), np.float32), units, first)
        return -float(model.log_probabilities(found.reshape(-1, gru.STATE), units.ravel()).astype(np.float64).mean())

    kept, parts = {}, gru.Gru.views(np.zeros_like(model.flat), model.units, model.classes)
    found, _ = model.run(np.zeros((3, gru.STATE), np.float32), units, first, kept)
    _, d = model.log_probabilities(found.reshape(-1, gru.STATE), units.ravel(), parts, weight)
    d_inputs = model.back(kept, found, units, first, d.reshape(found.shape), parts)
    for t, s in ((1, 0), (2, 1), (3, 2)):
        word = units[t, s] - model.units
        same = units == units[t, s]
        k = int(abs(d_inputs[same].sum(0)).argmax())
        old, ends = model.vin[word, k], []
        for by in (2e-2, -2e-2):
            model.vin[word, k] = old + by
            ends.append(loss())
        model.vin[word, k] = old
        assert (ends[0] - ends[1]) / 4e-2 == pytest.approx(float(d_inputs[same].sum(0)[k]), rel=0.1, abs=2e-4)


def test_words_are_split_as_plain_ones(monkeypatch):
    pick = random.Random(3)
    some = [" ", "\t", "\n", "\x0b", "\x1c", "\x85", "\u00a0", "\u3000", "A", "z", "É", "漢", "\x00", "wordEN", "x"]
    texts = [None, "", "  ", *("".join(pick.choice(some) for _ in range(pick.randrange(15))) for _ in range(800)), None]
    plain = [(t or "").encode().lower().split() for t in texts]
    monkeypatch.setattr(gru, "PIECE", 200)
    column, got = pa.array(["not read", *texts]).slice(1), []
    cuts = list(gru.pieces(column))
    assert len(cuts) > 10 and [a for a, _ in cuts] == [0, *(b for _, b in cuts[:-1])] and cuts[-1][1] == len(texts)
    for a, b in cuts:
        words, n = gru.split_words(column.slice(a, b - a))
        found = iter(words.to_pylist())
        got += [[next(found).encode() for _ in range(k)] for k in n]
        assert next(found, None) is None
        assert gru.ending_units(words).tolist() == [gru.SINGLE + zlib.crc32(w[-2:]) % gru.ENDINGS for t in plain[a:b] for w in t]
    assert got == plain
    counted = Counter()
    for batch in gru._count_words(iter([pa.RecordBatch.from_arrays([column], ["t"])])):
        counted.update(dict(zip(batch.column("word").to_pylist(), batch.column("c").to_pylist())))
    assert counted == Counter(w.decode() for t in plain for w in t)


def test_neighbouring_groups_are_worked_on_together():
    """Far fewer steps than groups, with the results of one group at a time; a group with most of the tokens is alone."""
    model, layout = grouped_model(40_000)
    rng = np.random.default_rng(8)
    words = np.sort(np.concatenate([rng.integers(0, len(layout.group), 9000), rng.integers(4000, 4010, 3000), rng.integers(len(layout.group) - 200, len(layout.group), 900)]))
    states = rng.normal(0, 0.5, size=(len(words), gru.STATE)).astype(np.float32)
    tilts, grads, steps = np.zeros(len(words)), np.zeros(model.vout.shape), 0
    groups = np.unique(layout.group[words])
    for g in groups:
        own, at = np.flatnonzero(layout.group == g), np.flatnonzero(layout.group[words] == g)
        e = np.exp(states[at].astype(float) @ model.vout[own].T.astype(float))
        e /= (e * layout.share[own]).sum(1, keepdims=True)
        tilts[at] = np.log(e[np.arange(len(at)), words[at] - own[0]])
        every = gru.EXPECTED if len(own) > gru.LARGE and len(at) > gru.LARGE else 1
        grads[own] += layout.share[own][:, None] * (e[::every].T @ states[at][::every]) * len(at) / len(at[::every])
        np.subtract.at(grads, words[at], states[at])
    found = np.zeros(model.vout.shape)
    for low, high, g in model.word_gradients(states, words):
        found[low:high] += g
        steps += 1
    assert steps < len(groups) / 4
    assert np.allclose(model.tilts(states, words), tilts, atol=1e-4) and np.allclose(found, grads, atol=1e-3)
    at = np.flatnonzero(np.diff(words, prepend=-1))
    assert np.allclose(gru.segment_sums(states, at), np.add.reduceat(states, at, axis=0), atol=1e-4)
    strong = np.isin(layout.group, groups[1:8])  # their own states are small, a neighbour's would take these vectors out of range
    model.vout[strong] = 100
    states[strong[words]] *= 0.01
    states[0] = 1
    assert all(np.isfinite(g).all() for _, _, g in model.word_gradients(states, words)) and np.isfinite(model.tilts(states, words)).all()
    shuffled = rng.permutation(np.concatenate([words, words + (1 << 16)]))
    assert gru.rising(shuffled).tolist() == np.argsort(shuffled, kind="stable").tolist()


def test_less_frequent_words_follow_their_context(spark):
    """Words outside the most frequent ones that end alike are told apart: they score lower beside frequent words of the other topic."""
    pick = random.Random(12)

    def text(often, seldom):
        return " ".join(f"w{often}{pick.randrange(75)}" if pick.random() < 0.5 else f"{seldom}{pick.randrange(150)}en" for _ in range(80))

    held = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 5 == 1]
    learnt = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [(i, text("pq"[i % 2], "pq"[i % 2])) for i in [*learnt[:1200], *held[:150]]] + [(i, text("pq"[i % 2], "qp"[i % 2])) for i in held[150:300]]
    got = {r.doc_id: r for r in gru.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).select(F.col("id").alias("doc_id"), "score", "n_tokens").collect()}
    same, crossed = (sum(got[i].score for i in part) / sum(got[i].n_tokens for i in part) for part in (held[:150], held[150:300]))
    assert same - crossed > 0.05


def plain_posteriors(model, rows):
    """Posteriors of rows (text, tag, host), each with its own share taken out of all counts."""
    k = len(model.languages)

    def softmax(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    scored = [model.score(t) for t, _, _ in rows]
    heard = [n / (1 + n / langid.HEARD) for n, _ in scored]
    flat = [math.log((1 - langid.NONE_PRIOR) / k)] * k + [math.log(langid.NONE_PRIOR)]
    p = [softmax([x * w + f for x, f in zip(s, flat)]) for (_, s), w in zip(scored, heard)]
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1] if "." in h else None
    total, out = len(rows), []
    for at, (_, tag, host) in enumerate(rows):
        post = []
        for i in range(k + 1):
            whole = sum(x[i] for x in p)

            def count(same):
                held = [x[i] for x, r in zip(p, rows) if same(r)]  # noqa: B023
                return max(sum(held) - p[at][i], 0.0), len(held)  # noqa: B023

            prior = everywhere = (whole + 1) / (total + k + 1)
            if host:
                c, n = count(lambda r: r[2] and domain(r[2]) == domain(host))  # noqa: B023
                d = (c + langid.DOMAIN_WEIGHT * everywhere) / (n - 1 + langid.DOMAIN_WEIGHT)
                c, n = count(lambda r: r[2] == host)  # noqa: B023
                prior = (c + langid.HOST_WEIGHT * d) / (n - 1 + langid.HOST_WEIGHT)
            value = scored[at][1][i] * heard[at] + math.log(prior)
            for same in ([lambda r: r[1] == tag] if tag else []) + ([lambda r: r[2] and suffix(r[2]) == suffix(host)] if host and suffix(host) else []):  # noqa: B023
                c, n = count(same)
                value += math.log((c + langid.TAG_WEIGHT * n / total) / (whole + langid.TAG_WEIGHT))
            post.append(value)
        out.append(softmax(post))
    return out


def test_posteriors_match_plain_version(spark, model):
    texts = ["the house", "der", "une maison dans la rue", "", "of the and", "xq zv", None, "la", "und die", "la casa"]
    hosts = ["a.one.de", "b.one.de", "two.fr", None, "local", "a.one.de"]
    rows = [(i, texts[i % len(texts)], [None, "en", "de", "fr"][i % 4], hosts[i % len(hosts)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, tag string, host string").repartition(3)
    found = {r.id: r for r in langid.identify(df, model, F.col("text"), declared=F.col("tag"), host=F.col("host")).collect()}
    for (i, *_), post in zip(rows, plain_posteriors(model, [r[1:] for r in rows])):
        assert abs(found[i].lang_probability - max(post)) < 1e-9
        assert sorted(post)[-1] - sorted(post)[-2] < 1e-9 or found[i].lang_found == [*model.languages, langid.NONE][post.index(max(post))]
