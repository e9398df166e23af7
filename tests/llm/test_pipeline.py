"""The pipeline's stages: each on its predecessor's rows, against plain versions."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(__file__))
import brute
import corpus_pipeline

from lexspark.llm import catalog
from lexspark.llm.common import ARROW_CONF, written


def test_stages_in_order(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard", "suffix_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        if name == "packing":
            break
        assert docs.columns == corpus_pipeline.COLUMNS
        after = {r.doc_id: r.text for r in docs.collect()}
        assert all(r.n_chars == len(r.text or "") for r in docs.collect()) or name in ("language_id",)
        if name == "language_id":
            assert after == before
        elif name == "ngram_jaccard":
            classes = brute.jaccard_classes(before.items())
            assert set(after) == {d for d, (_, c) in classes.items() if c == d} and all(after[d] == before[d] for d in after)
        elif name == "suffix_dedup":
            order = list(before)
            for d, flags in zip(order, brute.repeated_passages([before[d] for d in order], 200, 51)):
                kept = bytes(b for b, gone in zip((before[d] or "").encode(), flags) if not gone)
                assert after[d] == kept.decode("utf-8", "ignore")
        before = after
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(before)
    by_sequence = {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == np.cumsum([0, *(r.length for r in rows)])[:-1].tolist() and sum(r.length for r in rows) <= 2048


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_one_query_per_operator():
    names = list(catalog.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(catalog.oracle_sql()) <= set(names)


KEPT = """
import ctypes, random, re
import pyarrow as pa
from lexspark.llm import jaccard, repeats

def own():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches(kind, names):
    pick = random.Random(3)
    vocabulary = ["".join(pick.choices("abcdefgh", k=6)) for _ in range(20000)]
    for at in range(2):
        texts = [" ".join(pick.choices(vocabulary, k=1000)) for _ in range(2500)]
        ids = pa.array(range(at * 2500, at * 2500 + 2500), pa.int64())
        yield pa.RecordBatch.from_arrays([*[ids] * (len(names) - 1), pa.array(texts, pa.string()).cast(kind)], names)

for task, kind, names in ((jaccard._scan(5), pa.string(), ["id", "h", "t"]), (repeats._find_regions(200), pa.binary(), ["doc", "b"])):
    for _ in task(batches(kind, names)):
        pass
    del _
    kept = own()
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)
    print(kept - own())
"""


def test_tasks_give_memory_back():
    """A worker that has ended a task holds no freed memory over into the next stage."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", KEPT], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True, timeout=120)
    assert all(float(kept) < 25 for kept in said.stdout.split()), said.stdout


def test_python_gets_small_batches(spark, sf_dir):
    """No stage hands a worker 64 MB at once, Spark's own bound; a session's own bound stays."""
    before = spark.conf.get(ARROW_CONF, None)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})

    try:
        for stage in (corpus_pipeline.language_id, corpus_pipeline.packing):
            spark.conf.unset(ARROW_CONF)
            stage(spark, docs, sf_dir)
            found = spark.range(0, 9000, 1, 1).selectExpr("repeat('abcdefgh', 256) AS t").mapInArrow(sizes, "n long").collect()
            assert sum(r.n for r in found) == 9000 and max(r.n for r in found) * 2048 <= 5 << 20
        spark.conf.set(ARROW_CONF, "32m")
        corpus_pipeline.packing(spark, docs, sf_dir)
        assert spark.conf.get(ARROW_CONF) == "32m"
    finally:
        spark.conf.unset(ARROW_CONF) if before is None else spark.conf.set(ARROW_CONF, before)


def test_packing_gives_memory_back(spark, sf_dir, monkeypatch):
    """The function that packing hands to Spark ends by giving back what it freed."""
    from lexspark.llm import common, packing

    handed, given = [], []
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "mapInArrow", lambda self, run, schema: handed.append(run) or self.sparkSession.createDataFrame([], schema))
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    packing.packed_documents(docs)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 0})())}))
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1], pa.int64()), "p": pa.array([None], pa.string()), "t": ["a b"]})
    out = list(handed[0](iter([batch])))
    assert sum(b.num_rows for b in out) >= 1 and given == [1]
