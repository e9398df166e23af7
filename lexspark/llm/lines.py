"""Near-duplicate lines within one edit, by a deletion-neighbourhood join. DataFrame operations only.

Equal lines are one line, found at its earliest place. A line is cut into at most 16 blocks, and each
block is deleted in turn: the hash of what remains (with the block's number and the smaller length of the
pair) is a key. Two lines within one edit agree on a key: the edit lies in one block, and deleting that
block, one character wider in the longer line, leaves the same text. Blocks hold one character in lines
under 16 characters and grow by powers of two, so a line has at most 32 keys and linear work.

Lines that agree on a key differ in that block alone. Its content gets all its single deletions as keys of
a second level. Contents that agree without their p-th character are one substitution apart, all of them, and
a content that equals another one's deletion is one insertion apart; so each group needs to meet its
earliest member only, and no pairs within a group are made. Each such meeting is verified by edit distance.

Keys are made only for lines that can have a partner: one edit leaves the first or the last part of a
line as it was, so two such lines share the hash of a part (a power of two, at least a quarter of the line).
Hot lines and hot keys are counted before the shuffle. Only hashes are shuffled until candidates are known;
a filter of fixed size keeps the texts of other documents from being dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm.common import may_match, written

BLOCKS = 16


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(2.0), exponent).cast("int")


def _half(n: Column) -> Column:
    """The largest power of two that is at most half of ``n``."""
    return _power(F.floor(F.log2(F.greatest(n, F.lit(2)).cast("double")) + 1e-9) - 1)


def _block(n: Column) -> Column:
    """Characters in a block of a line of ``n``: a power of two that makes at most ``BLOCKS`` blocks."""
    return _power(F.greatest(F.lit(0.0), F.ceil(F.log2((n + 1).cast("double") / BLOCKS) - 1e-9).cast("double")))


def _part_keys(line: Column) -> Column:
    """Hashes of first and last parts that lines one edit apart have in common."""
    n = F.length(line)
    ends = lambda m: F.array(F.xxhash64(F.lit(0), m, F.substr(line, F.lit(1), m)), F.xxhash64(F.lit(1), m, F.substr(line, n - m + 1, m)))
    return F.array_distinct(F.flatten(F.transform(F.array(_half(n), _half(n - 1)), ends)))


def _deletion_keys(line: Column) -> Column:
    """(key, start, size, wider) of each block: as the shorter or equal line of a pair, and as the longer one."""
    n = F.length(line)

    def keys(base: Column, wider: int) -> Column:
        b = _block(base)

        def key(i: Column) -> Column:
            left, right = F.substr(line, F.lit(1), i * b), F.substr(line, i * b + b + wider + 1, n)
            return F.struct(F.xxhash64(base, i, left, right).alias("key"), (i * b).alias("start"), (b + wider).alias("size"), F.lit(wider).alias("wider"))

        return F.transform(F.sequence(F.lit(0), F.floor(base / b).cast("int")), key)

    return F.concat(keys(n, 0), keys(n - 1, 1))


def _content_keys(content: Column, wider: Column) -> Column:
    """Second-level keys of a block's content: (kind, place, hash of the rest). Kind 0: equal lengths, kind 1: one longer.

    Only hashes are kept: the rests themselves would hold the square of the content's length.
    """
    places = F.sequence(F.lit(1), F.greatest(F.length(content), F.lit(1)))
    without = lambda p: F.xxhash64(F.concat(F.substr(content, F.lit(1), p - 1), F.substr(content, p + 1, F.length(content))))
    entry = lambda kind, place, rest: F.struct(F.lit(kind).alias("kind"), place.alias("place"), rest.alias("rest"))
    longer = F.transform(places, lambda p: entry(1, F.lit(0), without(p)))
    same = F.concat(F.transform(places, lambda p: entry(0, p, without(p))), F.array(entry(1, F.lit(0), F.xxhash64(content))))
    return F.array_distinct(F.when(wider == 1, longer).otherwise(same))


def _near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """Hashes ``h`` of distinct lines that stand within one edit of an earlier line.

    ``docs``: (k_id, k_text, lines); ``firsts``: distinct lines (h, first, parts).
    """
    parts = firsts.select("h", F.explode("parts").alias("part"))
    shared = written(parts.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part"), "parts")
    candidates = parts.join(shared, "part", "left_semi").select(F.col("h").alias("c")).distinct()
    wanted = firsts.join(candidates, F.col("h") == F.col("c"), "left_semi").select("h", "first")
    at = written(
        wanted.groupBy(F.col("first.k_id").alias("w_id"), F.col("first.k_text").alias("w_text"))
        .agg(F.collect_list(F.struct(F.col("first.pos").alias("pos"), "h")).alias("at")), "wanted",
    )

    near = may_match(docs.select("k_id", "k_text", "lines"), "k_text", at, "w_text")
    found = near.join(at, F.col("k_id").eqNullSafe(F.col("w_id")) & (F.col("k_text") == F.col("w_text")))
    cut = found.select("k_id", "k_text", F.explode(F.transform("at", lambda x: F.struct(x.pos.alias("pos"), x.h.alias("h"), F.element_at("lines", x.pos + 1).alias("line")))).alias("x"))
    place = F.struct(F.col("k_id").isNull().alias("anon"), "k_id", "k_text", F.col("x.pos").alias("pos"))
    texts = written(cut.select(F.col("x.h").alias("h"), place.alias("first"), F.col("x.line").alias("line")).dropDuplicates(["h"]), "candidates")

    keyed = written(texts.select("h", F.explode(_deletion_keys(F.col("line"))).alias("k")).select("h", "k.*"), "keyed")
    several = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
    members = written(keyed.join(several, "key", "left_semi"), "members").join(texts, "h")
    content = F.substr("line", F.col("start") + 1, F.col("size"))
    second = members.select("h", "first", "key", "wider", F.explode(_content_keys(content, F.col("wider"))).alias("c"))
    second = second.select("h", "first", "wider", F.xxhash64("key", "c.kind", "c.place", "c.rest").alias("key"), F.col("c.kind").alias("kind"))
    second = written(second, "contents")
    who = F.struct("first", "h")
    groups = second.groupBy("key", "kind").agg(
        F.min(who).alias("all"), F.min(F.when(F.col("wider") == 0, who)).alias("short"), F.min(F.when(F.col("wider") == 1, who)).alias("long"), F.count("*").alias("n")
    ).where("n > 1")
    met = second.join(groups, ["key", "kind"])
    other = F.when(F.col("kind") == 0, F.col("all")).when(F.col("wider") == 1, F.col("short")).otherwise(F.col("long"))
    pairs = met.select("h", "first", other.alias("o")).where(F.col("o").isNotNull() & (F.col("o.first") < F.col("first"))).select("h", F.col("o.h").alias("h2")).distinct()
    lines = pairs.join(texts.select("h", "line"), "h").join(texts.select(F.col("h").alias("h2"), F.col("line").alias("line2")), "h2")
    return lines.where(F.levenshtein("line", "line2", 1) >= 0).select("h").distinct()


def dedup_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = 20) -> DataFrame:
    """``df`` with near-duplicate lines removed from its texts; adds ``n_lines`` and ``n_removed`` (long).

    A line (text between line feeds) of at least ``min_chars`` characters is removed if an equal line stands
    earlier, or if an earlier line is within one edit (insertion, deletion or substitution of a character).
    Earlier: by (id, hash of the text, line number), null ids last; the earliest of each equal line counts.
    Shorter lines stay. A null text stays null with no lines, an empty one has one empty line. Rows that
    repeat both id and text are one occurrence, and each gets the same result. All columns are kept; columns
    named as the added ones are replaced.
    """
    text = F.col(f"`{text_col}`").cast("string")
    others = [c for c in df.columns if c not in (text_col, "n_lines", "n_removed")]
    # positions stand for names, so no column of df can clash with those used here
    keys = [F.col(f"`{id_col}`").cast("long").alias("k_id"), F.xxhash64(text).alias("k_text"), F.split(text, "\n", -1).alias("lines")]
    docs = df.select(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(others)], *keys)
    each = docs.select("k_id", "k_text", F.posexplode("lines").alias("pos", "line")).where(F.length("line") >= min_chars)
    place = F.struct(F.col("k_id").isNull().alias("anon"), "k_id", "k_text", "pos")
    named = each.select("k_id", "k_text", "pos", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), "line")
    firsts = written(
        named.select("*", _part_keys(F.col("line")).alias("parts")).groupBy("h", "g")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("parts").alias("parts")), "lines",
    )
    near = _near_lines(docs.select("k_id", "k_text", "lines"), firsts).withColumn("near", F.lit(True))
    doomed = firsts.join(near, "h", "left").where("n > 1 or near").select("h", "g", "first", "near")
    gone = named.drop("line").join(doomed, ["h", "g"]).where(F.coalesce("near", F.lit(False)) | (place > F.col("first")))
    removed = gone.groupBy("k_id", "k_text").agg(F.collect_set("pos").alias("places")).select(F.col("k_id").alias("r_id"), F.col("k_text").alias("r_text"), "places")
    joined = docs.join(removed, F.col("k_id").eqNullSafe(F.col("r_id")) & (F.col("k_text") == F.col("r_text")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("places", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(stay, lambda p: F.element_at("lines", p + 1)), "\n")
    at = {c: F.col(f"o{i}").alias(c) for i, c in enumerate(others)}
    return joined.select(
        *[F.when(F.col("lines").isNotNull(), kept).alias(c) if c == text_col else at[c] for c in df.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_removed"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that stand, up to one edit, earlier."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_removed")


#: The same rule stated plainly: near lines meet on the line without one character.
OP7_SQL = """
WITH base AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
firsts AS (SELECT line, min(doc_id * 10000000 + pos) AS f FROM base WHERE length(line) >= 20 GROUP BY line),
cuts AS (SELECT line, f, unnest(range(1, length(line) + 1)) AS i FROM firsts),
keys AS (
  SELECT line, f, substr(line, 1, i - 1) || substr(line, i + 1) AS k FROM cuts
  UNION SELECT line, f, line FROM firsts),
near AS (
  SELECT DISTINCT b.line FROM keys a JOIN keys b ON a.k = b.k
  WHERE a.f < b.f AND levenshtein(a.line, b.line) <= 1),
flagged AS (
  SELECT base.doc_id, base.pos, base.line,
         length(base.line) >= 20 AND (near.line IS NOT NULL OR base.doc_id * 10000000 + base.pos > firsts.f) AS gone
  FROM base LEFT JOIN firsts ON base.line = firsts.line LEFT JOIN near ON base.line = near.line)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM flagged GROUP BY doc_id
"""
