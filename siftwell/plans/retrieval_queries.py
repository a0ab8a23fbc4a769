"""Retrieval, fusion, re-ranking, context, evaluation, vector, log and record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.functions import vectors as V
from siftwell.operators import context, evaluation, fusion, lexical, monitoring, ratelimit, records, rerank, vector_index, vectors
from siftwell.operators.lexical_index import LexicalIndex
from siftwell.plans.catalogue import QUERIES, query, table
from siftwell.plans.text_queries import WORDS
from siftwell.store import new_path

AS_OF = "2024-01-31 00:00:00"


def _bm25_sql(k1: float = 1.2, b: float = 0.75, delta: float = 0.0, docs: str = "documents") -> str:
    part = f"tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))"
    score = f"ln((n + 1) / df) * ({delta} + {part})" if delta else f"ln(1 + (n - df + 0.5) / (df + 0.5)) * {part}"
    return f"""(WITH dl AS (SELECT doc_id, {WORDS} AS w FROM {docs}), st AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM dl),
    q AS (SELECT item_id AS query_id, unnest({WORDS}) AS token FROM benchmark), tok AS (SELECT doc_id, len(w) AS dl, unnest(w) AS token FROM dl),
    tf AS (SELECT doc_id, token, dl, count(*)::DOUBLE AS tf FROM tok WHERE token IN (SELECT token FROM q) GROUP BY ALL), df AS (SELECT token, count(*)::DOUBLE AS df FROM tf GROUP BY token)
    SELECT query_id, doc_id, round(sum({score}), 6) AS score FROM q JOIN tf USING (token) JOIN df USING (token), st GROUP BY query_id, doc_id)"""


def _top_sql(scores: str, k: int, cols: str = "query_id, doc_id, score", item: str = "doc_id", extra: str = "") -> str:
    return f"SELECT {cols}, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {item}) AS rank FROM {scores} {extra}) WHERE rank <= {k}"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.terms(table(spark, sf_dir, "benchmark"), "item_id")


def _top(spark: SparkSession, sf_dir: str, k: int, *models: lexical.Model, **options) -> list[DataFrame]:
    return lexical.ranked(table(spark, sf_dir, "documents"), _terms(spark, sf_dir), k, models, **options)


OKAPI, PLUS = _bm25_sql(), _bm25_sql(1.5, 0.75, 0.5)


@query("bm25_topk", _top_sql(OKAPI, 10))
def bm25_topk(spark, sf_dir):
    return _top(spark, sf_dir, 10, lexical.OKAPI)[0]


@query("bm25_plus_topk", _top_sql(PLUS, 10))
def bm25_plus_topk(spark, sf_dir):
    return _top(spark, sf_dir, 10, lexical.PLUS)[0]


@query("bm25_by_index", _top_sql(OKAPI, 10))
def bm25_by_index(spark, sf_dir):
    """The way of query sets that are too large to send to every task: an index of postings, joined."""
    return lexical.top(lexical.bm25(table(spark, sf_dir, "documents"), _terms(spark, sf_dir)), 10)


@query("bm25_stored_index", _top_sql(_bm25_sql(docs="(SELECT * FROM documents WHERE lang <> 'es')"), 10))
def bm25_stored_index(spark, sf_dir):
    """A stored index: two segments are inserted, Spanish documents withdrawn, and what is left is searched by blocks."""
    docs, index = table(spark, sf_dir, "documents"), LexicalIndex(spark, new_path(spark, "lexical-index"))
    index.insert(docs.where("lang = 'en'"))
    index.insert(docs.where("lang IS NULL OR lang <> 'en'"))
    index.delete(docs.where("lang IS NULL OR lang = 'es'").select("doc_id"))
    return index.search(_terms(spark, sf_dir), 10)


_ZEROS = f"(SELECT b.item_id AS query_id, d.doc_id, coalesce(s.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN {OKAPI} s ON s.query_id = b.item_id AND s.doc_id = d.doc_id)"


@query("bm25_with_zeros", _top_sql(_ZEROS, 25))
def bm25_with_zeros(spark, sf_dir):
    return _top(spark, sf_dir, 25, lexical.OKAPI, zeros=True)[0]


@query("bm25_positive_postfilter", f"SELECT t.* FROM ({_top_sql(OKAPI, 20)}) t JOIN documents d ON t.doc_id = d.doc_id WHERE t.score > 0 AND d.lang = 'en'")
def bm25_positive_postfilter(spark, sf_dir):
    own = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return _top(spark, sf_dir, 20, lexical.OKAPI)[0].where("score > 0").join(own, "doc_id", "left_semi")


@query("bm25_prefilter", _top_sql(f"(SELECT s.* FROM {OKAPI} s JOIN documents d ON s.doc_id = d.doc_id WHERE d.lang = 'en')", 10))
def bm25_prefilter(spark, sf_dir):
    """Only English documents are ranked, with the counts of all."""
    return _top(spark, sf_dir, 10, lexical.OKAPI, among=F.col("lang") == "en")[0]


#: Synonyms as a caller would give them: of stop words of the corpus' languages.
SYNONYMS = [("the", "le"), ("the", "der"), ("and", "et"), ("and", "und"), ("of", "de"), ("in", "dans"), ("to", "zu")]
_SYN = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in SYNONYMS) + ") s(token, synonym)"


@query("expanded_terms", f"WITH q AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS}) AS token FROM benchmark) SELECT query_id, token FROM q UNION SELECT query_id, synonym FROM q JOIN {_SYN} USING (token)")
def expanded_terms(spark, sf_dir):
    return lexical.expand(_terms(spark, sf_dir), spark.createDataFrame(SYNONYMS, "token string, synonym string")).select("query_id", "token")


def _vec(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf_dir, "embeddings")
    return own, own.where("vec_id % 100 = 0")


_MEASURES = {
    "cosine": "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])",
    "dot": "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])",
    "l2": "-list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])",
    "l1": "-list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda x: abs(x[1] - x[2])))",
}


def _near_sql(metric: str, where: str = "") -> str:
    return f"(SELECT q.vec_id AS query_id, v.vec_id, round({_MEASURES[metric]}, 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id {where})"


_VCOLS = "query_id, vec_id, score"


def _vector_query(metric: str) -> None:
    @query(f"vector_{metric}_topk", _top_sql(_near_sql(metric), 10, _VCOLS, "vec_id"))
    def run(spark, sf_dir):
        return vectors.search(*_vec(spark, sf_dir), 10, metric)


for _m in _MEASURES:
    _vector_query(_m)


@query("vector_index_topk")
def vector_index_topk(spark, sf_dir):
    """As vector_cosine_topk from an index of cells and codes, whose probes are fitted to nine in ten of the nearest vectors and more."""
    own, queries = _vec(spark, sf_dir)
    index = vector_index.build(own)
    index.fit_probes(0.95)
    return index.search(queries, 10)


@query("vector_prefilter_topk", _top_sql(_near_sql("cosine", "AND v.label = 3"), 10, _VCOLS, "vec_id"))
def vector_prefilter_topk(spark, sf_dir):
    own, queries = _vec(spark, sf_dir)
    return vectors.search(own.where("label = 3"), queries, 10)


@query("vector_threshold", f"SELECT * FROM ({_top_sql(_near_sql('cosine'), 20, _VCOLS, 'vec_id')}) WHERE score >= 0.3")
def vector_threshold(spark, sf_dir):
    return vectors.search(*_vec(spark, sf_dir), 20).where("score >= 0.3")


@query("l2_normalize", "SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x / CASE WHEN n > 0 THEN n ELSE 1 END) ** 2)), 6) AS squared, round(e[1] / CASE WHEN n > 0 THEN n ELSE 1 END, 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def l2_normalize(spark, sf_dir):
    u = V.l2_normalise(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", u.alias("u")).select("vec_id", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("squared"), F.round(F.col("u")[0], 6).alias("first"))


@query(
    "quantize_int8",
    "WITH s AS (SELECT 127 / max(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x)))) AS scale FROM embeddings) SELECT vec_id, array_to_string(list_transform(embedding::DOUBLE[], lambda x: trunc(x * scale)::INT), ',') AS codes FROM embeddings, s",
)
def quantize_int8(spark, sf_dir):
    own = table(spark, sf_dir, "embeddings")
    scale = own.agg((127 / F.max(V.abs_max(F.col("embedding")))).alias("scale"))  # one row
    return own.join(F.broadcast(scale)).select("vec_id", F.array_join(V.int8(F.col("embedding"), F.col("scale")).cast("array<string>"), ",").alias("codes"))


@query(
    "vector_stats",
    "SELECT label, count(*) AS n, min(len(embedding))::INT AS dim_min, max(len(embedding))::INT AS dim_max FROM embeddings GROUP BY label",
)
def vector_stats(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dim_min"), F.max(F.size("embedding")).alias("dim_max"))


_ALIKE = "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.5"
_REACHED = f"WITH RECURSIVE l AS MATERIALIZED ({_ALIKE}), r AS (SELECT a AS v, a AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a WHERE r.c < l.b)"


@query(
    "near_dup_cosine_pairs",
    f"{_REACHED}, n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a) SELECT r.v AS vec_id, min(r.c) AS class_id, any_value(n.n_links) AS n_links FROM r JOIN n ON r.v = n.a GROUP BY r.v",
)
def near_dup_cosine_pairs(spark, sf_dir):
    """Of each vector with a cosine of 0.5 or more to another: the class that chains of such pairs make, and its number of them."""
    return vectors.alike_classes(table(spark, sf_dir, "embeddings"), 0.5)


@query("near_dup_cosine_classes", f"{_REACHED} SELECT v AS vec_id, min(c) AS class_id FROM r GROUP BY v")
def near_dup_cosine_classes(spark, sf_dir):
    return vectors.alike_classes(table(spark, sf_dir, "embeddings"), 0.5).drop("n_links")


_NORMS = {
    "minmax": "CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END",
    "zscore": "CASE WHEN sd > 0 THEN (score - m) / sd ELSE 0 END",
    "softmax": "exp(score - hi) / sum(exp(score - hi)) OVER (PARTITION BY query_id)",
    "max": "CASE WHEN hi > 0 THEN score / hi ELSE score END",
}


def _norm_sql(how: str, scores: str) -> str:
    return f"(SELECT query_id, doc_id, {_NORMS[how]} AS score FROM (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS m, stddev_pop(score) OVER w AS sd FROM {scores} WINDOW w AS (PARTITION BY query_id)))"


def _lists(spark, sf_dir):
    return [x.select("query_id", "doc_id", "score") for x in _top(spark, sf_dir, 20, lexical.OKAPI, lexical.PLUS)]


_L1, _L2 = (f"({_top_sql(x, 20)})" for x in (OKAPI, PLUS))


def _norm_query(how: str, name: str) -> None:
    @query(name, f"SELECT query_id, doc_id, round(score, 6) AS score FROM {_norm_sql(how, _L1)}")
    def run(spark, sf_dir):
        return _lists(spark, sf_dir)[0].select("query_id", "doc_id", F.round(fusion.normalised(how), 6).alias("score"))


for _h in ("minmax", "zscore", "softmax"):
    _norm_query(_h, f"{_h}_scores")


def _fused_sql(parts: list[str]) -> str:
    return "(SELECT query_id, doc_id, round(sum(score), 6) AS score FROM (" + " UNION ALL ".join(parts) + ") GROUP BY query_id, doc_id)"


_RRF = _fused_sql([f"SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS score FROM {x}" for x in (_L1, _L2)])


def _mixed_sql(how: str, weights: list[float]) -> str:
    return _fused_sql([f"SELECT query_id, doc_id, {g}::DOUBLE * score AS score FROM {_norm_sql(how, x)}" for x, g in zip((_L1, _L2, _L1), weights)])


@query("fuse_rrf", _top_sql(_RRF, 10))
def fuse_rrf(spark, sf_dir):
    return lexical.top(fusion.rrf(_lists(spark, sf_dir)), 10)


@query("fuse_weighted_max", _top_sql(_mixed_sql("max", [0.7, 0.3]), 10))
def fuse_weighted_max(spark, sf_dir):
    return lexical.top(fusion.weighted(_lists(spark, sf_dir), [0.7, 0.3], "max"), 10)


@query("fuse_linear_minmax", _top_sql(_mixed_sql("minmax", [0.4, 0.6]), 10))
def fuse_linear_minmax(spark, sf_dir):
    return lexical.top(fusion.linear(*_lists(spark, sf_dir), 0.4), 10)


@query("fuse_nlist", _top_sql(_mixed_sql("minmax", [0.5, 0.3, 0.2]), 10))
def fuse_nlist(spark, sf_dir):
    a, b = _lists(spark, sf_dir)
    return lexical.top(fusion.weighted([a, b, a], [0.5, 0.3, 0.2]), 10)


_BY_ID = [f"(SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM {x})" for x in (_L1, _L2)]


@query("fuse_rrf_given_order", _top_sql(_fused_sql([f"SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS score FROM {x}" for x in _BY_ID]), 10))
def fuse_rrf_given_order(spark, sf_dir):
    """Lists that come in an order of their own, here that of ids."""
    w = Window.partitionBy("query_id").orderBy("doc_id")
    lists = [x.select("query_id", "doc_id", F.row_number().over(w).alias("rank")) for x in _lists(spark, sf_dir)]
    return lexical.top(fusion.rrf_by_rank(lists), 10)


_REL = _fused_sql([f"SELECT query_id, doc_id, {g}::DOUBLE * coalesce(score / nullif(max(score) OVER (PARTITION BY query_id), 0), 0) AS score FROM {x}" for x, g in zip((_L1, _L2), (0.6, 0.4))])


@query("fuse_relative", _top_sql(_REL, 10))
def fuse_relative(spark, sf_dir):
    return lexical.top(fusion.relative(_lists(spark, sf_dir), [0.6, 0.4]), 10)


def _semantic(spark, sf_dir, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): vectors stand for the documents and queries of their ids, so the query set is that of benchmark."""
    own = table(spark, sf_dir, "embeddings")
    asked = own.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    docs = own.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return vectors.search(docs, asked, k).withColumnRenamed("vec_id", "doc_id")


_SEM = "(SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN benchmark b ON q.vec_id = b.item_id JOIN embeddings v ON v.vec_id <> q.vec_id JOIN documents d ON d.doc_id = v.vec_id)"
_S20 = f"({_top_sql(_SEM, 20)})"
_HYBRID = _fused_sql([f"SELECT query_id, doc_id, 1.0::DOUBLE / (60 + rank) AS score FROM {x}" for x in (_S20, _L1)])


def _hybrid(spark, sf_dir) -> DataFrame:
    parts = [_semantic(spark, sf_dir, 20), _top(spark, sf_dir, 20, lexical.OKAPI)[0]]
    return fusion.rrf([x.select("query_id", "doc_id", "score") for x in parts])


@query("semantic_topk", _top_sql(_SEM, 10))
def semantic_topk(spark, sf_dir):
    return _semantic(spark, sf_dir, 10)


@query("hybrid_semantic", _top_sql(_HYBRID, 10))
def hybrid_semantic(spark, sf_dir):
    """Twice as many of both the semantic and the lexical side, fused and cut."""
    return lexical.top(_hybrid(spark, sf_dir), 10)


_HT = f"(SELECT t.query_id, t.doc_id, d.text, d.source FROM ({_top_sql(_HYBRID, 20)}) t JOIN documents d ON t.doc_id = d.doc_id)"


def _retrieved_sql() -> str:
    q = "list_distinct(regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}_]+'))"
    d = "list_distinct(regexp_extract_all(lower(coalesce(t.text, '')), '[\\p{L}\\p{N}_]+'))"
    scored = f"(SELECT t.query_id, t.doc_id, round({_OVERLAP.format(q=q, d=d)}, 6) AS score FROM {_HT} t JOIN benchmark b ON t.query_id = b.item_id)"
    counted = f"(SELECT r.*, len({WORDS})::BIGINT AS tokens FROM ({_top_sql(scored, 10, extra='WHERE score >= 0.1')}) r JOIN documents d ON r.doc_id = d.doc_id)"
    running = f"(SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM {counted})"
    return f"SELECT query_id, doc_id, score, rank, tokens, running FROM {running} WHERE running <= 3000 AND rank <= 5"


_TEXTS = f"(SELECT t.*, d.text FROM ({_top_sql(_RRF, 20)}) t JOIN documents d ON t.doc_id = d.doc_id)"


def _with_text(spark, sf_dir, k: int = 20) -> DataFrame:
    ranked = lexical.top(fusion.rrf(_lists(spark, sf_dir)), k)
    return ranked.join(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")


_OVERLAP = "len(list_intersect({q}, {d})) / len({q})"
_QD = "list_distinct(regexp_extract_all(lower(b.text), '[\\p{L}\\p{N}_]+'))"
_DD = "list_distinct(regexp_extract_all(lower(coalesce(t.text, '')), '[\\p{L}\\p{N}_]+'))"
_SCORED = f"(SELECT t.query_id, t.doc_id, round({_OVERLAP.format(q=_QD, d=_DD)}, 6) AS score FROM {_TEXTS} t JOIN benchmark b ON t.query_id = b.item_id)"


def _scored(spark, sf_dir) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _with_text(spark, sf_dir).join(q, "query_id").drop("rank")


_JACCARD = "len(list_intersect({q}, {d})) / len(list_distinct(list_concat({q}, {d})))"
_FIRST = f"(SELECT query_id, doc_id FROM ({_top_sql(_SCORED, 10)}))"
_SECOND = f"(SELECT t.query_id, t.doc_id, round({_JACCARD.format(q=_QD, d=_DD)}, 6) AS score FROM (SELECT f.*, d.text FROM {_FIRST} f JOIN documents d ON f.doc_id = d.doc_id) t JOIN benchmark b ON t.query_id = b.item_id)"


@query("two_stage_rerank", _top_sql(_SECOND, 5))
def two_stage_rerank(spark, sf_dir):
    """Ten by the share of the query's words that a text has, five of these by the Jaccard similarity of both word sets."""
    cheap, precise = rerank.overlap(F.col("query"), F.col("text")), evaluation.jaccard(T.words("query"), T.words("text"))
    return rerank.two_stage(_scored(spark, sf_dir), cheap, precise, 10, 5).select("query_id", "doc_id", "score", "rank")


@query("overlap_rerank", _top_sql(_SCORED, 5, extra="WHERE score >= 0.2"))
def overlap_rerank(spark, sf_dir):
    return rerank.rerank(_scored(spark, sf_dir), rerank.overlap(F.col("query"), F.col("text")), 5, 0.2).select("query_id", "doc_id", "score", "rank")


@query("noop_rerank", _top_sql(_RRF, 5, extra="WHERE score >= 0.02"))
def noop_rerank(spark, sf_dir):
    return rerank.keep_order(fusion.rrf(_lists(spark, sf_dir)), 5, 0.02)


def _candidates(spark, sf_dir) -> DataFrame:
    own, queries = _vec(spark, sf_dir)
    return vectors.search(own, queries, 40).join(own.select("vec_id", "embedding"), "vec_id").select("query_id", "vec_id", F.col("score").alias("relevance"), "embedding")


@query("mmr_select")
def mmr_select(spark, sf_dir):
    return rerank.mmr(_candidates(spark, sf_dir), 10, 0.7, 0.8)


@query("semantic_mmr")
def semantic_mmr(spark, sf_dir):
    """Twice as many as are wanted, chosen for diversity, and only then held against a threshold."""
    near = _candidates(spark, sf_dir)
    chosen = rerank.mmr(near.where(F.col("relevance") > -1), 20, 0.7, 0.8)
    return chosen.join(near.select("query_id", "vec_id", "relevance"), ["query_id", "vec_id"]).where(F.col("relevance") >= 0.2)


@query("diversify")
def diversify(spark, sf_dir):
    return rerank.diversify(_candidates(spark, sf_dir), 0.3)


@query("jaccard_context_dedup")
def jaccard_context_dedup(spark, sf_dir):
    return rerank.drop_overlapping(_with_text(spark, sf_dir), 0.8).select("query_id", "doc_id", "rank")


_BUDGET = f"(SELECT * FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM (SELECT *, len({WORDS})::BIGINT AS tokens FROM {_TEXTS})) WHERE running <= 2000)"


@query("context_token_budget", f"SELECT query_id, doc_id, rank, tokens, running FROM {_BUDGET}")
def context_token_budget(spark, sf_dir):
    return context.budget(_with_text(spark, sf_dir), 2000).select("query_id", "doc_id", "rank", "tokens", "running")


@query("lost_in_middle_order", f"SELECT query_id, doc_id, (CASE WHEN (rank - 1) % 2 = 0 THEN (rank - 1) // 2 ELSE n - 1 - (rank - 2) // 2 END)::BIGINT AS position FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM ({_top_sql(_RRF, 20)}))")
def lost_in_middle_order(spark, sf_dir):
    return context.lost_in_middle(lexical.top(fusion.rrf(_lists(spark, sf_dir)), 20)).select("query_id", "doc_id", "position")


_LINES = "md5(string_agg('[' || rank || '] ' || source || ': ' || replace(coalesce(text, ''), chr(10), ' ')[1:200], chr(10) ORDER BY rank))"


@query("context_format", f"SELECT query_id, {_LINES} AS context_md5 FROM (SELECT t.*, d.source FROM {_TEXTS} t JOIN documents d ON t.doc_id = d.doc_id) GROUP BY query_id")
def context_format(spark, sf_dir):
    return context.snippet_lines(_with_text(spark, sf_dir), F.col("source")).select("query_id", F.md5("context").alias("context_md5"))


_FLAG = f"SELECT query_id, doc_id, rank, score, tokens, running FROM {_BUDGET} WHERE rank <= 8"


@query("hybrid_context", _FLAG)
def hybrid_context(spark, sf_dir):
    """Two lexical rankings fused, cut to a token budget and eight documents."""
    return context.budget(_with_text(spark, sf_dir), 2000).where("rank <= 8").select("query_id", "doc_id", "rank", "score", "tokens", "running")


@query("engine_retrieve", _retrieved_sql())
def engine_retrieve(spark, sf_dir):
    """The whole way: both sides, fusion, re-ranking of 20 over a threshold, a token budget and five documents."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = lexical.top(_hybrid(spark, sf_dir), 20).join(d, "doc_id").join(q, "query_id").drop("rank", "score")
    ranked = rerank.rerank(rows, rerank.overlap(F.col("query"), F.col("text")), 10, 0.1)
    return context.budget(ranked, 3000).where("rank <= 5").select("query_id", "doc_id", "score", "rank", "tokens", "running")


_DATED = "CASE WHEN doc_id % 3 > 0 THEN 2000 + doc_id % 20 END"


@query("context_by_date", f"SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY coalesce(({_DATED})::VARCHAR, ''), doc_id) - 1)::INT AS position FROM ({_top_sql(_RRF, 20)})")
def context_by_date(spark, sf_dir):
    date = F.when(F.col("doc_id") % 3 > 0, 2000 + F.col("doc_id") % 20)
    return context.chronological(lexical.top(fusion.rrf(_lists(spark, sf_dir)), 20), date).select("query_id", "doc_id", "position")


@query("answer_sources", f"SELECT query_id, string_agg(source, ',' ORDER BY rank) AS sources FROM (SELECT t.query_id, d.source, min(t.rank) AS rank FROM ({_top_sql(_RRF, 20)}) t JOIN documents d ON t.doc_id = d.doc_id GROUP BY t.query_id, d.source) GROUP BY query_id")
def answer_sources(spark, sf_dir):
    return context.sources(_with_text(spark, sf_dir), F.col("source")).select("query_id", F.array_join("sources", ",").alias("sources"))


@query("citations", "SELECT doc_id, '[' || doc_id || ']' AS numbered, '([Source: ' || source || ', page ?])' AS inlined FROM documents")
def citations(spark, sf_dir):
    none = F.lit(None).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", context.citation(F.col("doc_id"), F.col("source"), none, "numbered").alias("numbered"), context.citation(F.col("doc_id"), F.col("source"), none).alias("inlined"))


_RANKED = f"(SELECT r.query_id, r.rank, v.label = q.label AS relevant FROM ({_top_sql(_near_sql('cosine'), 10, _VCOLS, 'vec_id')}) r JOIN embeddings v ON r.vec_id = v.vec_id JOIN embeddings q ON r.query_id = q.vec_id)"


@query(
    "retrieval_measures",
    f"""WITH n AS (SELECT q.vec_id AS query_id, count(*) - 1 AS r FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id),
    s AS (SELECT query_id, count_if(relevant) AS hits, coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0) AS mrr, sum(CASE WHEN relevant THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM {_RANKED} GROUP BY query_id)
    SELECT query_id, round(hits / 10, 6) AS precision, round(CASE WHEN r > 0 THEN hits / r ELSE 0 END, 6) AS recall, round(mrr, 6)::DOUBLE AS mrr, round(CASE WHEN r > 0 THEN dcg / list_sum(list_transform(range(1, least(r, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM s JOIN n USING (query_id)""",
)
def retrieval_measures(spark, sf_dir):
    own, queries = _vec(spark, sf_dir)
    label = own.select(F.col("vec_id"), F.col("label"))
    ranked = vectors.search(own, queries, 10).join(label, "vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    sizes = own.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    n = queries.join(sizes, "label").select(F.col("vec_id").alias("query_id"), "n_relevant")
    return evaluation.at_k(ranked.select("query_id", "rank", (F.col("label") == F.col("own")).alias("relevant")), n, 10)


_SETS = "SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(lower(coalesce(q.text, '')), '[\\p{L}\\p{N}_]+')) AS q, list_distinct(regexp_extract_all(lower(coalesce(a.text, '')), '[\\p{L}\\p{N}_]+')) AS r FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND q.turn = a.turn - 1 WHERE a.role = 'assistant'"


@query(
    "answer_overlap_measures",
    f"""SELECT conv_id, turn, round(CASE WHEN len(r) > 0 THEN len(list_intersect(r, q)) / len(r) ELSE 0 END, 6)::DOUBLE AS faithfulness, round(CASE WHEN len(list_distinct(list_concat(q, r))) = 0 THEN 1 ELSE len(list_intersect(q, r)) / len(list_distinct(list_concat(q, r))) END, 6)::DOUBLE AS relevancy,
    round(CASE WHEN len(q) > 0 THEN len(list_intersect(q, r)) / len(q) ELSE 0 END, 6)::DOUBLE AS recall FROM ({_SETS})""",
)
def answer_overlap_measures(spark, sf_dir):
    own = table(spark, sf_dir, "conversations")
    asked = own.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    m = evaluation.answer_measures(F.col("question"), F.col("text"), F.col("question"), F.col("question"))
    return own.where("role = 'assistant'").join(asked, ["conv_id", "turn"]).select("conv_id", "turn", *[F.round(m[k], 6).alias(n) for k, n in (("faithfulness", "faithfulness"), ("answer_relevancy", "relevancy"), ("context_recall", "recall"))])


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events")


def _pct(p: int, order: str = "value") -> str:
    return f"list_sort(list(value))[greatest(round_even({p / 100} * (count(value) - 1), 0), 0)::BIGINT + 1] AS p{p}"


@query("metric_summary", f"SELECT 'all' AS scope, count(*) AS total, count_if(event_type <> 'error') AS success, count_if(event_type = 'error') AS failed, round(avg(value), 6) AS avg_value, {_pct(95)}, {_pct(99)} FROM events")
def metric_summary(spark, sf_dir):
    return monitoring.summary(_events(spark, sf_dir).withColumn("scope", F.lit("all")), F.col("event_type") == "error", [95, 99], ["scope"])


@query(
    "component_summary",
    "SELECT event_type, count(*) AS calls, round(avg(value), 6) AS mean, arg_max(event_id, event_id) AS last_event, max(ts) AS last_ts FROM events GROUP BY event_type",
)
def component_summary(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.avg("value"), 6).alias("mean"), F.max("event_id").alias("last_event"), F.max("ts").alias("last_ts"))


@query("latency_percentiles", f"SELECT event_type, {_pct(50)}, {_pct(95)}, {_pct(99)} FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return monitoring.nearest_rank(_events(spark, sf_dir), "value", [50, 95, 99], ["event_type"])


@query("timeseries_hourly", "SELECT date_trunc('hour', ts) AS bucket, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def timeseries_hourly(spark, sf_dir):
    return monitoring.series(_events(spark, sf_dir)).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(
    "rolling_24h",
    "SELECT until, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT unnest(generate_series(date_trunc('hour', ts) + INTERVAL 1 HOUR, date_trunc('hour', ts) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS until, value FROM events) GROUP BY until",
)
def rolling_24h(spark, sf_dir):
    return monitoring.rolling(_events(spark, sf_dir)).withColumn("until", F.col("until").cast("timestamp_ntz"))


@query("period_summary", f"SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR GROUP BY event_type")
def period_summary(spark, sf_dir):
    since = F.expr(f"CAST('{AS_OF}' AS TIMESTAMP_NTZ) - INTERVAL 24 HOURS")
    return _events(spark, sf_dir).where(F.col("ts") >= since).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("query_log_page", "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 50 OFFSET 100")
def query_log_page(spark, sf_dir):
    return _events(spark, sf_dir).orderBy(F.col("event_id").desc()).offset(100).limit(50).select("event_id", "event_type", "value")


_RULES = [("p95", "over", "warning", 1.0), ("mean", "under", "critical", 1e9), ("failures", "over", "critical", 1e12)]


@query(
    "alerts",
    f"WITH v AS (SELECT {_pct(95)}, avg(value) AS mean FROM events) SELECT 'p95' AS name, 'warning' AS severity, round(p95, 6) AS value, 1.0::DOUBLE AS threshold FROM v WHERE p95 > 1 UNION ALL SELECT 'mean', 'critical', round(mean, 6), 1e9::DOUBLE FROM v WHERE mean < 1e9",
)
def alerts(spark, sf_dir):
    log = _events(spark, sf_dir).withColumn("scope", F.lit("all"))
    values = monitoring.summary(log, F.col("event_type") == "error", [95], ["scope"]).select("p95", F.col("avg_value").alias("mean"), F.col("failed").alias("failures"))
    return monitoring.alerts(values, _RULES).withColumn("value", F.round("value", 6))


@query("histogram_buckets", "SELECT event_type, " + ", ".join(f"count_if(value <= {b}) AS le_{str(b).replace('.', '_')}" for b in monitoring.BUCKETS) + ", count(*) AS n FROM events GROUP BY event_type")
def histogram_buckets(spark, sf_dir):
    return monitoring.histogram(_events(spark, sf_dir), ["event_type"])


@query("rate_limit_decisions")
def rate_limit_decisions(spark, sf_dir):
    return ratelimit.decisions(_events(spark, sf_dir), 2, 8)


@query("last_write_wins_state", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_write_wins_state(spark, sf_dir):
    return records.last_write(_events(spark, sf_dir).select("user_id", "event_id", "event_type", "value"), ["user_id"], [F.col("event_id")])


@query("incremental_pending", "SELECT e.event_id FROM events e LEFT JOIN (SELECT event_id, ts FROM events WHERE event_id % 3 = 0) s ON e.event_id = s.event_id WHERE s.ts IS NULL OR e.ts > s.ts")
def incremental_pending(spark, sf_dir):
    """Files stand for events; the state has every third of them as it is."""
    own = _events(spark, sf_dir).select(F.col("event_id").alias("path"), F.col("ts").alias("mtime"))
    return records.pending(own, own.where("path % 3 = 0")).select(F.col("path").alias("event_id"))


@query(
    "partial_update",
    "SELECT c.c_custkey, CASE WHEN c.c_custkey % 7 = 0 THEN 'UPDATED' ELSE c.c_mktsegment END AS c_mktsegment, c.c_nationkey FROM customer c",
)
def partial_update(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return records.update(own, own.where("c_custkey % 7 = 0").select("c_custkey", F.lit("UPDATED").alias("c_mktsegment")), "c_custkey", ["c_mktsegment"])


@query("delete_cascade", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return records.delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("delete_detach", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def delete_detach(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return records.detach(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@query("list_documents", "SELECT DISTINCT source, lang FROM documents")
def list_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("source", "lang").distinct()


@query("health_worst", "SELECT max(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END)::INT AS worst, count(DISTINCT event_type) AS components FROM events")
def health_worst(spark, sf_dir):
    return _events(spark, sf_dir).agg(F.max(F.when(F.col("event_type") == "error", 2).otherwise(0)).alias("worst"), F.countDistinct("event_type").alias("components"))
