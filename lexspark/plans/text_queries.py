"""Registered queries of text search: match, rank, postings, inverse search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions import analyze, distance, match, rank
from lexspark.functions.types import MAX_POSITION, let
from lexspark.operators import inverse, postings, search
from lexspark.plans.workspace import new_folder

TOKENS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
#: Tokens with their places, as the engine numbers them.
PLACES_SQL = f"""places AS (
  SELECT DISTINCT doc_id, w, least(p, 16383) AS p FROM (
    SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM (SELECT doc_id, {TOKENS_SQL} AS t FROM documents)))"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their tokens; only the columns that text search reads."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", analyze.tokens("text").alias("t"))


#: Name -> (query, SQL condition over the token list t).
MATCHES = {
    "fts_and": ("the & of", "list_contains(t, 'the') AND list_contains(t, 'of')"),
    "fts_or": ("der | que", "list_contains(t, 'der') OR list_contains(t, 'que')"),
    "fts_not": ("de & !la", "list_contains(t, 'de') AND NOT list_contains(t, 'la')"),
    "fts_nested": ("(the | der) & !(of & in) & (a | und)", "(list_contains(t, 'the') OR list_contains(t, 'der')) AND NOT (list_contains(t, 'of') AND list_contains(t, 'in')) AND (list_contains(t, 'a') OR list_contains(t, 'und'))"),
    "fts_negative_only": ("!the & !de", "NOT list_contains(t, 'the') AND NOT list_contains(t, 'de')"),
    "fts_prefix": ("tionth:*", "len(list_filter(t, lambda x: starts_with(x, 'tionth'))) > 0"),
    "fts_prefix_and": ("er:* & !under:*", "len(list_filter(t, lambda x: starts_with(x, 'er'))) > 0 AND NOT len(list_filter(t, lambda x: starts_with(x, 'under'))) > 0"),
}

#: Name -> (query, SQL for the matching doc_id over places).
PHRASES = {
    "fts_phrase": ("of <-> the", "SELECT DISTINCT a.doc_id FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.w = 'of' AND b.w = 'the'"),
    "fts_phrase_distance": ("the <3> of", "SELECT DISTINCT a.doc_id FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.p = a.p + 3 WHERE a.w = 'the' AND b.w = 'of'"),
    "fts_phrase_or": ("of <-> (the | a)", "SELECT DISTINCT a.doc_id FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.w = 'of' AND b.w IN ('the', 'a')"),
    "fts_phrase_not": ("of <-> !the", "SELECT DISTINCT a.doc_id FROM places a LEFT JOIN places b ON a.doc_id = b.doc_id AND b.p = a.p + 1 AND b.w = 'the' WHERE a.w = 'of' AND b.w IS NULL AND a.p + 1 > 0"),
    "fts_phrase_three": ("the <-> of <-> and", "SELECT DISTINCT a.doc_id FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.p = a.p + 1 JOIN places c ON a.doc_id = c.doc_id AND c.p = a.p + 2 WHERE a.w = 'the' AND b.w = 'of' AND c.w = 'and'"),
    "fts_not_phrase": ("de & !(de <-> la)", "SELECT DISTINCT doc_id FROM places WHERE w = 'de' AND doc_id NOT IN (SELECT a.doc_id FROM places a JOIN places b ON a.doc_id = b.doc_id AND b.p = a.p + 1 WHERE a.w = 'de' AND b.w = 'la')"),
}


def _match(query: str):
    return lambda spark, sf: documents(spark, sf).where(match.token_matches("t", query)).select("doc_id")


def mini_vector(tokens: Column, lexemes: list[str]) -> Column:
    """The part of a token vector that names these lexemes, without building the rest: one pass over the tokens."""
    place = lambda w, i: F.when(w.isin(*lexemes), F.struct(w.alias("w"), F.least(i + 1, F.lit(MAX_POSITION)).alias("p")))
    named = F.filter(F.transform(tokens, place), lambda x: x.isNotNull())

    def parts(found: Column) -> Column:
        of = lambda w: F.array_distinct(F.transform(F.filter(found, lambda x: x["w"] == w), lambda x: x["p"]))
        return F.filter(F.array(*[F.struct(F.lit(w).alias("lexeme"), of(w).alias("pos")) for w in sorted(lexemes)]), lambda x: F.size(x["pos"]) > 0)

    return let(named, parts)


def _rounded(c: Column) -> Column:
    return F.round(c.cast("double"), 5)


def _rank(query: str, lexemes: list[str], method: int = 0):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        v = analyze.vector_of_tokens(F.col("t")) if method else mini_vector(F.col("t"), lexemes)
        d = documents(spark, sf).where(match.token_matches("t", query)).select("doc_id", v.alias("v"))
        score = rank.ts_score("v", query, method)
        return d.select("doc_id", score.alias("s")).select("doc_id", _rounded(F.col("s")).alias("score"))

    return run


ONE_SQL = "SELECT doc_id, sum(0.1 / (k * k) / 1.64493406685) AS s FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id, w ORDER BY p) AS k FROM places WHERE w IN ({words})) GROUP BY doc_id"
AND_SQL = """SELECT doc_id, sum(0.2 / (1 + CASE WHEN gap - 1 < 0 THEN 0 ELSE gap - 1 END) / (k * k) / 1.64493406685) AS s FROM (
  SELECT doc_id, gap, row_number() OVER (PARTITION BY doc_id, before, w ORDER BY p) AS k FROM (
    SELECT doc_id, w, p, lag(w) OVER (PARTITION BY doc_id ORDER BY p) AS before, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM places WHERE w IN ('of', 'the'))
  WHERE before <> w) GROUP BY doc_id"""
COUNTS_SQL = "counts AS (SELECT doc_id, count(*) AS len, count(DISTINCT w) AS uniq FROM places GROUP BY doc_id)"
#: Mask -> the divisor in SQL; of the self bit, the whole expression.
NORMS = {1: "s / ln(len + 1)", 2: "s / len", 8: "s / uniq", 16: "s / log2(uniq + 1)", 32: "s / (s + 1)", 34: "s / (s + 1) / len"}


def _rank_sql(body: str, expression: str = "s") -> str:
    return f"WITH {PLACES_SQL}, {COUNTS_SQL}, scored AS ({body}) SELECT doc_id, round(CAST(CAST({expression} AS FLOAT) AS DOUBLE), 5) AS score FROM scored JOIN counts USING (doc_id)"


def _rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).where(match.token_matches("t", "of & the")).select("doc_id", mini_vector(F.col("t"), ["of", "the"]).alias("v"))
    d = d.select("doc_id", _rounded(rank.ts_score("v", "of & the")).alias("score"))
    return search.ordered(d, [-F.col("score")], "doc_id", 10)


def _rank_general(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases and three words, by the general search over vectors of the query's words."""
    query = "(of <-> the) | (and & to & in)"
    d = documents(spark, sf).where(match.token_matches("t", query)).select("doc_id", mini_vector(F.col("t"), ["of", "the", "and", "to", "in"]).alias("v"))
    d = d.select("doc_id", rank.ts_scores("v", query, [0, rank.BY_COVER_GAPS]).alias("s"))
    return d.select("doc_id", _rounded(F.col("s")[0]).alias("score"), _rounded(F.col("s")[1]).alias("score_by_gaps"))


def _rank_forms_agree(spark: SparkSession, sf: str) -> DataFrame:
    """Closed form and general search side by side; each row must hold the same score twice."""
    d = documents(spark, sf).where(match.token_matches("t", "of & the")).select("doc_id", mini_vector(F.col("t"), ["of", "the"]).alias("v"))
    return d.select("doc_id", _rounded(rank.ts_score("v", "of & the", general=True)).alias("score"))


def _rank_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Two lexemes that share all their places, by the closed form and by the general search."""
    d = documents(spark, sf).where(match.token_matches("t", "the")).select("doc_id", match.TokenSource(F.col("t")).positions(match.Term("the")).alias("p"))
    v = F.array(*[F.struct(F.lit(x).alias("lexeme"), F.col("p").alias("pos")) for x in ("left", "right")])
    d = d.select("doc_id", v.alias("v"))
    return d.select("doc_id", _rounded(rank.ts_score("v", "left & right")).alias("score"), _rounded(rank.ts_score("v", "left & right", general=True)).alias("searched"))


def _rank_distance(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("doc_id", mini_vector(F.col("t"), ["der"]).alias("v"))
    far = rank.ts_distance("v", rank.DistanceQuery("der", None)).cast("double")
    return d.select("doc_id", F.when(far == float("inf"), -1.0).otherwise(F.round(far, 3)).alias("distance"))


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    """The source's name has weight A, the text weight D."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    v = analyze.concat_vectors(analyze.setweight(analyze.to_tsvector("source"), "A"), analyze.setweight(mini_vector(analyze.tokens("text"), ["the", "src1"]), "D"))
    return d.select("doc_id", v.alias("v")).where(match.matches("v", "src1:A & the:D & !the:AB")).select("doc_id")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Lexemes with their number of positions, from vectors."""
    d = documents(spark, sf).select("doc_id", analyze.table_vectors(F.col("t")).alias("v")).select("doc_id", F.explode("v").alias("x"))
    return d.groupBy(F.col("x.lexeme").alias("lexeme")).agg(F.count("*").alias("n_docs"), F.sum(F.size("x.pos")).alias("n_positions"))


def _documents_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars", analyze.table_vectors(analyze.tokens("text")).alias("v"))


def _own_index(spark: SparkSession, sf: str, name: str = "tsvector", rows=None, docs=None, **options) -> postings.PostingIndex:
    """A fresh index, for queries that change it."""
    docs = _documents_with_vectors(spark, sf) if docs is None else docs
    docs = docs if rows is None else docs.where(rows)
    return postings.build_index(docs, new_folder(spark, "index"), {"v": name}, buckets=8, **options)


#: Paths of indexes by (session, data folder, layout).
_INDEXES: dict[tuple, str] = {}


def _index(spark: SparkSession, sf: str, name: str = "tsvector", **options) -> postings.PostingIndex:
    """The session's index of a folder, built by the first query that needs it; queries leave it as it is."""
    table = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), sf)
    key = (*table, name, tuple(sorted(options.items())))
    if key not in _INDEXES:
        # another index of the same table that keeps both columns has their vectors already
        other = next((path for k, path in _INDEXES.items() if k[:3] == table and ("attach", "n_chars") in k[4]), None)
        docs = postings.PostingIndex(spark, other).docs() if other and ("attach", "n_chars") in key[4] else None
        _INDEXES[key] = _own_index(spark, sf, name, docs=docs, **options).path
    return postings.PostingIndex(spark, _INDEXES[key])


def _build(spark: SparkSession, sf: str) -> DataFrame:
    return _terms_of(_own_index(spark, sf))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return _terms_of(_index(spark, sf))


def _terms_of(index: postings.PostingIndex) -> DataFrame:
    return index.entries().where("category = 'NORM_KEY'").select("term", "n_rows", "first_key")


def _search_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).search({"v": "(the | der) & !(of & in) & (a | und)"}).select("doc_id")


def _search_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).search({"v": "of <-> (the | a)"}).select("doc_id")


def _search_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).search({"v": "tionth:*"}).select("doc_id")


def _search_negative(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).search({"v": "!the & !de"}).select("doc_id")


def _search_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf, "tsvector_hash").search({"v": "de & !la"}).select("doc_id")


def _append(spark: SparkSession, sf: str) -> DataFrame:
    """An index of the first half, with the rest appended."""
    half = _own_index(spark, sf, rows=F.col("doc_id") % 2 == 0)
    rest = _documents_with_vectors(spark, sf).where("doc_id % 2 = 1")
    return half.append(rest).search({"v": "the & of"}).select("doc_id")


def _delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0").select("doc_id")
    return _own_index(spark, sf).delete(gone).search({"v": "the & of"}).select("doc_id")


def _update(spark: SparkSession, sf: str) -> DataFrame:
    """Rows take the text of the row before them in threes: updated twice, then deleted and appended."""
    index = _own_index(spark, sf, "tsvector_addon", attach="n_chars", to="v", attached_kind="int8")
    docs = index.docs()  # as they are now: later changes do not show in it
    moved = docs.where("doc_id % 3 = 1").select((F.col("doc_id") - 1).alias("doc_id"), "n_chars", "v")
    index.update(docs.where("doc_id % 3 = 0").select("doc_id", "n_chars", analyze.strip(F.col("v")).alias("v"))).update(moved)
    gone = docs.where("doc_id % 3 = 2").select("doc_id")
    return index.delete(gone).append(docs.where("doc_id % 3 = 2")).delete(docs.where("doc_id % 3 = 1").select("doc_id")).search({"v": "the & of"}).select("doc_id", "n_chars")


def _compact(spark: SparkSession, sf: str) -> DataFrame:
    gone = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 0").select("doc_id")
    return _own_index(spark, sf).delete(gone).compact().stats().select("n_rows", "n_postings", "n_terms", "n_placeholders", "n_deleted")


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).stats().select("version", "n_rows", "n_postings", "n_terms", "n_placeholders", "n_deleted")


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf, "tsvector_addon", attach="n_chars", to="v", order_by_attach=True, attached_kind="int8").items("v", "src") .union(
        _index(spark, sf, "tsvector_addon", attach="n_chars", to="v", attached_kind="int8").items("v", "der")
    )


def _partitions(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).partitions().agg(F.count("*").alias("n_buckets"), F.sum("n_postings").alias("n_postings"), F.sum("n_terms").alias("n_terms"), F.min("first_term").alias("first_term"), F.max("last_term").alias("last_term"))


STORED = [
    (1, "the|der"), (2, "the&of"), (3, "!(the|de)"), (4, "!(the&of)"), (5, "!the|de"), (6, "de&!la"), (7, "(the|der)&und"), (8, "(!(the|der))&que"),
    (9, "(the|der)&(of|und)"), (10, "!the"), (11, "(the&of&in)|(der&die&und)|!(de|la|the|der|a)"),
]
HAS = lambda w: f"list_contains(t, '{w}')"
STORED_SQL = {
    1: f"{HAS('the')} OR {HAS('der')}", 2: f"{HAS('the')} AND {HAS('of')}", 3: f"NOT ({HAS('the')} OR {HAS('de')})", 4: f"NOT ({HAS('the')} AND {HAS('of')})", 5: f"NOT {HAS('the')} OR {HAS('de')}",
    6: f"{HAS('de')} AND NOT {HAS('la')}", 7: f"({HAS('the')} OR {HAS('der')}) AND {HAS('und')}", 8: f"NOT ({HAS('the')} OR {HAS('der')}) AND {HAS('que')}",
    9: f"({HAS('the')} OR {HAS('der')}) AND ({HAS('of')} OR {HAS('und')})", 10: f"NOT {HAS('the')}",
    11: f"({HAS('the')} AND {HAS('of')} AND {HAS('in')}) OR ({HAS('der')} AND {HAS('die')} AND {HAS('und')}) OR NOT ({HAS('de')} OR {HAS('la')} OR {HAS('the')} OR {HAS('der')} OR {HAS('a')})",
}
PERCOLATE_SQL = " UNION ALL ".join(f"SELECT doc_id, CAST({i} AS BIGINT) AS query_id FROM d WHERE {c}" for i, c in STORED_SQL.items())


def _percolate(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "queries")
    inverse.stored_table(spark.createDataFrame(STORED, "query_id long, query string")).write.parquet(path)
    return inverse.percolate(documents(spark, sf), spark.read.parquet(path), F.col("t"))


def _percolate_scan(spark: SparkSession, sf: str) -> DataFrame:
    return inverse.percolate_scan(documents(spark, sf), [*STORED, (12, "of <-> the"), (13, "tionth:*")], F.col("t"))


def _set_operation(how: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        index = _index(spark, sf)
        a, b, c = (postings.term_keys(index, "v", w) for w in ("the", "of", "in"))
        out = a.intersect(b) if how == "intersect" else a.union(b).distinct() if how == "union" else a.join(b, "key", "left_semi").join(c, "key", "left_anti")
        return out.select(F.col("key").alias("doc_id"))

    return run


def _attach_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Text match with a predicate on the attached column, both on the index."""
    return _index(spark, sf, "tsvector_addon", attach="n_chars", to="v", attached_kind="int8").search({"v": "the & of"}, filters=F.col("n_chars") <= 1500).select("doc_id", "n_chars")


def _attach_knn(op: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        index = _index(spark, sf, "tsvector_addon", attach="n_chars", to="v", order_by_attach=True, attached_kind="int8")
        out = index.search({"v": "the & of"}, order_by=[(op, "n_chars", 1500)], limit=10)
        return out.select("doc_id", F.when(F.col("distance") == float("inf"), -1.0).otherwise(F.col("distance")).alias("distance"))

    return run


def _attach_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of quality 1 whose text matches, nearest text length first on ties of the label."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    d = documents(spark, sf).where(match.token_matches("t", "the | der")).select("doc_id").join(labels, "doc_id", "left")
    d = d.where(F.col("quality") >= 1)
    return d.select("doc_id", "quality", distance.attached_distance(F.col("toxic"), 1, "int4").alias("distance"))


def _multicol(spark: SparkSession, sf: str) -> DataFrame:
    """An index over several columns: equality on one, match on another, left distance on a third."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.col("n_chars"), analyze.table_vectors(analyze.tokens("text")).alias("v"))
    index = postings.build_index(docs, new_folder(spark, "index"), {"source": "text", "n_chars": "int8", "v": "tsvector"}, buckets=8)
    out = index.search({"v": "the"}, filters=F.col("source") == "src1", order_by=[("<=|", "n_chars", 2000)], limit=20)
    return out.select("doc_id", F.when(F.col("distance") == float("inf"), -1.0).otherwise(F.col("distance")).alias("distance"))


def _fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return search.fuzzy_limit(documents(spark, sf).where(match.token_matches("t", "the")).select("doc_id"), 50, seed=7)


def _flagship_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that match, nearest in length to a given one, top rows with their rank."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars", analyze.tokens("text").alias("t")).where(match.token_matches("t", "the & of & !und"))
    d = d.select("doc_id", "n_chars", mini_vector(F.col("t"), ["of", "the"]).alias("v")).select("doc_id", "n_chars", distance.dist(F.col("n_chars"), 1500, "int8").alias("distance"), "v")
    top = search.ordered(d, [F.col("distance")], "doc_id", 20)
    return top.select("doc_id", "n_chars", "distance", _rounded(rank.ts_score("v", "of & the")).alias("score"))


flagship = _flagship_rows

D_SQL = f"d AS (SELECT doc_id, source, n_chars, {TOKENS_SQL} AS t FROM documents)"
KNN_SQL = {
    "<=>": "abs(CAST(n_chars AS DOUBLE) - 1500)", "<=|": "CASE WHEN n_chars <= 1500 THEN 1500.0 - n_chars ELSE CAST('inf' AS DOUBLE) END",
    "|=>": "CASE WHEN n_chars > 1500 THEN n_chars - 1500.0 ELSE CAST('inf' AS DOUBLE) END",
}


def _knn_sql(op: str, where: str, value: int = 1500, limit: int = 10) -> str:
    expression = KNN_SQL[op].replace("1500", str(value))
    return f"WITH {D_SQL} SELECT doc_id, CASE WHEN distance = CAST('inf' AS DOUBLE) THEN -1.0 ELSE distance END AS distance FROM (SELECT doc_id, {expression} AS distance FROM d WHERE {where} ORDER BY distance, doc_id LIMIT {limit})"


def queries() -> dict:
    out = {name: _match(q) for name, (q, _) in MATCHES.items()} | {name: _match(q) for name, (q, _) in PHRASES.items()}
    out |= {"fts_weighted": _weighted, "fts_vectors": _vectors, "flagship": _flagship_rows}
    out |= {"rank_single": _rank("der", ["der"]), "rank_or": _rank("the | der | que", ["the", "der", "que"]), "rank_and2": _rank("of & the", ["of", "the"])}
    out |= {f"rank_norm_{m}": _rank("of & the", ["of", "the"], m) for m in NORMS}
    out |= {"rank_topk": _rank_topk, "rank_general": _rank_general, "rank_forms_agree": _rank_forms_agree, "rank_distance": _rank_distance, "rank_ties": _rank_ties}
    out |= {
        "postings_build": _build, "postings_search_eq_scan": _search_scan, "postings_phrase": _search_phrase, "postings_prefix": _search_prefix, "postings_negative": _search_negative, "postings_hash": _search_hash,
        "postings_append": _append, "postings_delete": _delete, "postings_compact": _compact, "postings_update": _update, "index_stats": _stats, "index_entries": _entries, "index_postings": _items, "index_partitions": _partitions,
        "percolate": _percolate, "percolate_scan": _percolate_scan, "set_intersect_terms": _set_operation("intersect"), "set_union_terms": _set_operation("union"), "semi_anti_terms": _set_operation("semi_anti"),
        "attach_filter": _attach_filter, "attach_knn_both": _attach_knn("<=>"), "attach_knn_left": _attach_knn("<=|"), "attach_knn_right": _attach_knn("|=>"), "attach_text_filter": _attach_labels,
        "multicol_attach": _multicol, "fuzzy_limit": _fuzzy,
    }
    return out


def oracle_sql() -> dict:
    where = lambda c: f"WITH {D_SQL} SELECT doc_id FROM d WHERE {c}"
    words = lambda *w: ONE_SQL.format(words=", ".join(f"'{x}'" for x in w))
    out = {name: where(c) for name, (_, c) in MATCHES.items()} | {name: f"WITH {PLACES_SQL} {c}" for name, (_, c) in PHRASES.items()}
    out["fts_weighted"] = where("source = 'src1' AND list_contains(t, 'the')")
    out["fts_vectors"] = f"WITH {PLACES_SQL} SELECT w AS lexeme, count(DISTINCT doc_id) AS n_docs, count(*) AS n_positions FROM places GROUP BY w"
    top = AND_SQL
    out["flagship"] = f"""WITH {PLACES_SQL}, {D_SQL}, scored AS ({top})
      SELECT doc_id, n_chars, distance, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 5) AS score FROM (
        SELECT doc_id, n_chars, abs(CAST(n_chars AS DOUBLE) - 1500) AS distance FROM d
        WHERE list_contains(t, 'the') AND list_contains(t, 'of') AND NOT list_contains(t, 'und') ORDER BY distance, doc_id LIMIT 20) JOIN scored USING (doc_id)"""
    out |= {"rank_single": _rank_sql(words("der")), "rank_or": _rank_sql(words("the", "der", "que")), "rank_and2": _rank_sql(AND_SQL), "rank_forms_agree": _rank_sql(AND_SQL)}
    out |= {f"rank_norm_{m}": _rank_sql(AND_SQL, e) for m, e in NORMS.items()}
    # each place gives a pair without noise, and a pair with the place after it
    ties = """SELECT doc_id, sum(0.2 / (k * k) / 1.64493406685) + coalesce(sum(0.2 / gap / (k * k) / 1.64493406685), 0) AS s FROM (
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k, lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p AS gap FROM places WHERE w = 'the') GROUP BY doc_id"""
    out["rank_ties"] = f"WITH {PLACES_SQL}, scored AS ({ties}) SELECT doc_id, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 5) AS score, round(CAST(CAST(s AS FLOAT) AS DOUBLE), 5) AS searched FROM scored"
    out["rank_topk"] = f"SELECT * FROM ({_rank_sql(AND_SQL)}) ORDER BY score DESC, doc_id LIMIT 10"
    out["rank_distance"] = f"WITH {PLACES_SQL}, scored AS ({words('der')}) SELECT documents.doc_id, coalesce(round(CAST(CAST(1.0 / CAST(CAST(s AS FLOAT) AS DOUBLE) AS FLOAT) AS DOUBLE), 3), -1.0) AS distance FROM documents LEFT JOIN scored USING (doc_id)"
    entries = f"WITH {PLACES_SQL} SELECT w AS term, count(DISTINCT doc_id) AS n_rows, min(doc_id) AS first_key FROM places GROUP BY w"
    out |= {"postings_build": entries, "index_entries": entries}
    out |= {"postings_search_eq_scan": out["fts_nested"], "postings_phrase": out["fts_phrase_or"], "postings_prefix": out["fts_prefix"], "postings_negative": out["fts_negative_only"], "postings_hash": out["fts_not"], "postings_append": out["fts_and"]}
    out["postings_delete"] = where(f"{MATCHES['fts_and'][1]} AND doc_id % 3 <> 0")
    both = MATCHES["fts_and"][1]
    out["postings_update"] = f"""WITH {D_SQL} SELECT doc_id, n_chars FROM d WHERE doc_id % 3 = 2 AND {both} UNION ALL SELECT doc_id - 1, n_chars FROM d WHERE doc_id % 3 = 1 AND {both}
      UNION ALL SELECT doc_id, n_chars FROM d WHERE doc_id % 3 = 0 AND doc_id + 1 NOT IN (SELECT doc_id FROM d) AND {both}"""
    count = f"""WITH {D_SQL}, p AS (SELECT DISTINCT doc_id, unnest(t) AS w FROM d WHERE CONDITION)
      SELECT MORE (SELECT count(DISTINCT doc_id) FROM d WHERE CONDITION) AS n_rows, (SELECT count(*) FROM p) AS n_postings, (SELECT count(DISTINCT w) FROM p) AS n_terms,
             (SELECT count(*) FROM d WHERE CONDITION AND len(t) = 0) AS n_placeholders, CAST(0 AS BIGINT) AS n_deleted"""
    out["postings_compact"] = count.replace("CONDITION", "doc_id % 3 <> 0").replace("MORE", "")
    out["index_stats"] = count.replace("CONDITION", "true").replace("MORE", "1 AS version,")
    out["index_postings"] = f"""WITH {PLACES_SQL} SELECT doc_id AS key, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS positions, CAST(any_value(n_chars) AS VARCHAR) AS attached
      FROM places JOIN documents USING (doc_id) WHERE w IN ('der', 'src') GROUP BY doc_id"""
    out["index_partitions"] = f"""WITH {D_SQL}, p AS (SELECT DISTINCT doc_id, unnest(t) AS w FROM d) SELECT CAST(8 AS BIGINT) AS n_buckets, (SELECT count(*) FROM p) + (SELECT count(*) FROM d WHERE len(t) = 0) AS n_postings,
      (SELECT count(DISTINCT w) FROM p) AS n_terms, (SELECT min(w) FROM p) AS first_term, (SELECT max(w) FROM p) AS last_term"""
    out["percolate"] = f"WITH {D_SQL} {PERCOLATE_SQL}"
    out["percolate_scan"] = f"WITH {PLACES_SQL}, {D_SQL} {PERCOLATE_SQL} UNION ALL SELECT doc_id, CAST(12 AS BIGINT) FROM ({PHRASES['fts_phrase'][1]}) UNION ALL SELECT doc_id, CAST(13 AS BIGINT) FROM d WHERE {MATCHES['fts_prefix'][1]}"
    out["set_intersect_terms"] = where(f"{HAS('the')} AND {HAS('of')}")
    out["set_union_terms"] = where(f"{HAS('the')} OR {HAS('of')}")
    out["semi_anti_terms"] = where(f"{HAS('the')} AND {HAS('of')} AND NOT {HAS('in')}")
    out["attach_filter"] = f"WITH {D_SQL} SELECT doc_id, n_chars FROM d WHERE {MATCHES['fts_and'][1]} AND n_chars <= 1500"
    out |= {name: _knn_sql(op, MATCHES["fts_and"][1]) for name, op in (("attach_knn_both", "<=>"), ("attach_knn_left", "<=|"), ("attach_knn_right", "|=>"))}
    out["attach_text_filter"] = f"WITH {D_SQL} SELECT d.doc_id, quality, coalesce(abs(CAST(toxic AS DOUBLE) - 1), CAST('inf' AS DOUBLE)) AS distance FROM d JOIN labels USING (doc_id) WHERE ({HAS('the')} OR {HAS('der')}) AND quality >= 1"
    out["multicol_attach"] = _knn_sql("<=|", "source = 'src1' AND list_contains(t, 'the')", 2000, 20)
    return out
