"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior: the text (byte trigrams under a multinomial model per
language, and a uniform model for text of no known language), the declared markup language, the address
suffix, and a prior of the host that is smoothed by its domain, which is smoothed by all rows. The last
three are counts of text posteriors, made by grouped aggregation over all rows; a row's own share is taken
out again before its counts are used, so that no text is heard twice.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import lean, written

CELLS = 1 << 16
#: The name of text in no language of the model.
NONE = "und"
#: Trigrams of a text count in full at first, and never for more than this many (they are not independent).
HEARD = 300.0
HOST_WEIGHT, DOMAIN_WEIGHT, TAG_WEIGHT, NONE_PRIOR = 10.0, 20.0, 20.0, 0.01
#: Letters and bytes of longer characters stay, capitals become small, all else separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _cells(text: str) -> np.ndarray:
    """Hashed trigrams of the folded text, one for each place that is not all separators."""
    raw = b" " + b" ".join(text.encode().translate(_FOLD).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(16)


@dataclass
class LanguageModel:
    """Log-probabilities of trigram cells per language; the last column is the uniform model."""

    languages: list[str]
    table: np.ndarray

    def score(self, text: str | None) -> tuple[int, list[float]]:
        """(trigrams, mean log-probability under each language and the uniform model)."""
        cells = _cells(text or "")
        if not len(cells):
            return 0, [0.0] * self.table.shape[1]
        total = np.zeros(self.table.shape[1])
        for at in range(0, len(cells), 1 << 16):
            total += self.table[cells[at : at + (1 << 16)]].sum(0, dtype=np.float64)
        return len(cells), (total / len(cells)).tolist()


def _sample_by_label(known: DataFrame, rows: int, least: int) -> list[Row]:
    """Distinct rows (l, h, t) of ``known``: see ``fit_model``. Only hashes are shuffled to count the texts."""
    many = {r.l: r.n for r in known.select("l", "h").distinct().groupBy("l").agg(F.count("*").alias("n")).collect()}
    names = {name for name, n in many.items() if n >= least}
    if not names:
        return []
    share = max(least, rows // len(names))
    # thresholds leave about half as many again as are wanted, and rare languages whole
    whole = sum(many.values())
    bound = {name: min(1.0, max((1.5 * rows + 50) / whole, (1.5 * share + 20) / many[name])) for name in names}
    limits = known.sparkSession.createDataFrame([(name, min((1 << 63) - 1, int((1 << 63) * b))) for name, b in bound.items()], "l string, below long")
    near = known.join(F.broadcast(limits), "l").where(F.shiftrightunsigned("h", 1) <= F.col("below"))
    held = near.groupBy("l", "h").agg(F.first("t").alias("t")).collect()
    held.sort(key=lambda r: ((r.h & ((1 << 64) - 1)) >> 1, r.l))
    chosen, taken = [], dict.fromkeys(names, 0)
    for i, r in enumerate(held):
        if i < rows or taken[r.l] < share:
            taken[r.l] += 1
            chosen.append(r)
    return chosen


def fit_model(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", rows: int = 2000, max_chars: int = 20_000, least: int = 5) -> LanguageModel:
    """Fits on distinct labelled texts of at most ``max_chars`` characters, those with the smallest hashes.

    Of all texts at most ``rows`` are taken, and of each language that has fewer of them than its even share of ``rows``
    (``least`` at least), texts up to that share. Languages with fewer than ``least`` texts in the table are left out.
    """
    text, label = F.col(f"`{text_col}`"), F.lower(F.col(f"`{label_col}`"))
    known = labelled.where(text.isNotNull() & label.isNotNull() & (F.length(text) <= max_chars)).select(text.alias("t"), label.alias("l"))
    sample = _sample_by_label(known.withColumn("h", F.xxhash64("t")), rows, least)
    counts: dict[str, np.ndarray] = {}
    seen: dict[str, int] = {}
    for r in sample:
        seen[r.l] = seen.get(r.l, 0) + 1
        counts[r.l] = counts.get(r.l, 0) + np.bincount(_cells(r.t), minlength=CELLS)
    languages = sorted(name for name, n in seen.items() if n >= least)
    columns = [np.log((counts[name] + 0.05) / (counts[name].sum() + 0.05 * CELLS)) for name in languages]
    return LanguageModel(languages, np.stack([*columns, np.full(CELLS, -math.log(CELLS))], axis=1).astype(np.float32))


def with_text_scores(df: DataFrame, text: str, model: LanguageModel, keep: bool = False) -> DataFrame:
    """``df`` with (n_grams: long, scores: array<double>) of the column ``text``, which travels once, and back only with ``keep``."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if keep or f.name != text), "n_grams long, scores array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [score(t) for t in part.column(text).to_pylist()]
                rest = [i for i, name in enumerate(part.schema.names) if keep or name != text]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in rest), pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.float64()))],
                    [*(part.schema.names[i] for i in rest), "n_grams", "scores"],
                )

    return df.mapInArrow(lean(run), schema)


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _numbers(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def identify(
    df: DataFrame, model: LanguageModel, text: Column, declared: Column | None = None, host: Column | None = None, with_suffix: bool = True, accept: float = 0.5, text_col: str | None = None,
) -> DataFrame:
    """``df`` with (lang_found, lang_probability, text_lang, accepted); columns of those names are replaced.

    ``text``, ``declared`` (a language tag) and ``host`` are columns of ``df``; each may be null: then it says
    nothing. A row is accepted if a language of the model has the largest posterior, of ``accept`` or more, and
    its text holds a trigram of letters. Equal rows get equal results. An empty table gives no rows. Where ``text`` is
    just a column of ``df``, ``text_col`` names it, and it is not carried twice.
    """
    k = len(model.languages)
    kept = [c for c in df.columns if c not in ("lang_found", "lang_probability", "text_lang", "accepted")]
    others = [c for c in kept if c != text_col]
    none = F.lit(None).cast("string")
    tag = F.regexp_extract(F.lower(declared), r"^([a-z]{2,3})(?:[-_]|$)", 1) if declared is not None else none
    name = F.lower(host) if host is not None else none
    labels = F.split(name, r"\.")
    base = df.select(
        *[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(others)], F.when(tag != "", tag).alias("tag"), F.when(name != "", name).alias("host"), text.alias("__in")
    )
    slim = with_text_scores(base.select("tag", "host", "__in"), "__in", model)
    heard = F.col("n_grams") / (1 + F.col("n_grams") / HEARD)
    flat = _numbers([math.log((1 - NONE_PRIOR) / max(1, k))] * k + [math.log(NONE_PRIOR)])
    own = _softmax(F.zip_with("scores", flat, lambda s, p: s * heard + p))
    share = slim.select("tag", "host", own.alias("p"))
    sums = [F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(k + 1)]
    counts = written(share.groupBy("tag", "host").agg(*sums, F.count("*").alias("n")), "language_counts")  # one row per (tag, host)
    added = [F.sum(f"c{i}").alias(f"c{i}") for i in range(k + 1)] + [F.sum("n").alias("n")]
    packed = lambda prefix: [F.array(*[F.col(f"c{i}") for i in range(k + 1)]).alias(f"{prefix}_c"), F.col("n").alias(f"{prefix}_n")]
    whole = counts.agg(*added).first()
    total = float(whole.n or 0)
    overall = [((whole[f"c{i}"] or 0.0) + 1.0) / (total + k + 1) for i in range(k + 1)]

    parts = F.split("host", r"\.")
    with_levels = lambda t: t.withColumn("suffix", F.when(F.size(parts) > 1, F.element_at(parts, -1))).withColumn("domain", F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), "."))
    by_host = with_levels(counts.where("host is not null").groupBy("host").agg(*added))
    domains = by_host.groupBy("domain").agg(*added).select("domain", *packed("d"))
    suffixes = by_host.groupBy("suffix").agg(*added).select("suffix", *packed("s"))
    hosts = by_host.select("host", "domain", "suffix", *packed("h")).join(domains, "domain").join(suffixes, "suffix", "left").drop("domain", "suffix").withColumnRenamed("host", "of_host")
    hosts = written(hosts, "language_hosts")
    tags = written(counts.where("tag is not null").groupBy("tag").agg(*added).select(F.col("tag").alias("of_tag"), *packed("t")), "language_tags")

    scored = with_text_scores(base, "__in", model, keep=text_col is not None).withColumn("p", _softmax(F.zip_with("scores", flat, lambda s, p: s * heard + p)))
    # both tables are written, so their size is known: Spark broadcasts them if small, and splits hot hosts if not
    rows = scored.join(hosts, F.col("host") == F.col("of_host"), "left").join(tags, F.col("tag") == F.col("of_tag"), "left")
    less = lambda c, i: F.greatest(F.col(c)[i] - F.col("p")[i], F.lit(0.0))
    posterior = []
    for i in range(k + 1):
        everywhere = F.lit(overall[i])
        domain = (less("d_c", i) + DOMAIN_WEIGHT * everywhere) / (F.col("d_n") - 1 + DOMAIN_WEIGHT)
        prior = F.coalesce((less("h_c", i) + HOST_WEIGHT * domain) / (F.col("h_n") - 1 + HOST_WEIGHT), everywhere)
        in_language = (whole[f"c{i}"] or 0.0) + TAG_WEIGHT
        says = lambda prefix: F.log((less(f"{prefix}_c", i) + TAG_WEIGHT * F.col(f"{prefix}_n") / max(total, 1.0)) / in_language)  # noqa: E731, B023
        suffix = F.coalesce(says("s"), F.lit(0.0)) if with_suffix else F.lit(0.0)
        posterior.append(F.col("scores")[i] * heard + F.log(prior) + F.coalesce(says("t"), F.lit(0.0)) + suffix)
    names = F.array(*[F.lit(x) for x in [*model.languages, NONE]])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    final = rows.withColumn("post", _softmax(F.array(*posterior)))
    lang, probability = best(F.col("post")), F.array_max("post")
    return final.select(
        *[F.col(f"o{others.index(c)}" if c != text_col else "__in").alias(c) for c in kept], probability.alias("lang_probability"), F.when(F.col("n_grams") > 0, best(F.col("p"))).alias("text_lang"),
        lang.alias("lang_found"), ((lang != NONE) & (probability >= accept) & (F.col("n_grams") > 0)).alias("accepted"),
    )


def page_text(html: Column) -> Column:
    """What a page shows, roughly: without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents in a language of the model; ``lang`` is what was declared, ``source`` stands for the host.

    Documents whose declared language has no model stay: nothing can be said against them.
    """
    model = fit_model(docs)
    found = identify(docs, model, F.col("text"), declared=F.col("lang"), host=F.col("source"), with_suffix=False, text_col="text")
    declared = F.lower("lang")
    unknown = declared.isNotNull() & (declared != "") & (declared != NONE) & ~declared.isin(model.languages)
    return found.where(F.col("accepted") | F.coalesce(unknown, F.lit(False))).select(*docs.columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages: their text, markup tag, address suffix and host; the model is fitted on documents."""
    model = fit_model(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    html = F.col("html")
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z][A-Za-z_-]*)", 1)
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    found = identify(pages, model, page_text(html), declared=declared, host=host)
    return found.select("page_id", F.col("lang_found").alias("lang"), F.round("lang_probability", 6).alias("lang_probability"), "text_lang", F.nullif(declared, F.lit("")).alias("declared"), "accepted")
