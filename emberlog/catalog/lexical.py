"""Sparse and hybrid retrieval: the sparse index tables, and the documents' own words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.catalog import dense
from emberlog.operators import knn as K
from emberlog.operators import sparse as S
from emberlog.sources.tables import table


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.lexical_postings(table(spark, sf_dir, "documents").filter("text is not null"))


def _item(spark, d, n):
    return S.lexical_postings(table(spark, d, "eval_items").filter(f"item_id = {n}"), "item_id").select("term_id", "weight")


def sparse_index_stats(spark, d):
    return S.index_stats(S.live_index(table(spark, d, "sparse_postings"))[0])


def sparse_shard_stats(spark, d):
    s = table(spark, d, "sparse_index_stats").groupBy("shard_id").agg(F.max_by(F.struct("num_documents", "num_terms", "num_postings"), "taken_at").alias("r"))
    return s.select("shard_id", "r.num_documents", "r.num_terms", "r.num_postings")


def sparse_norms(spark, d):
    return S.norms(S.live_index(table(spark, d, "sparse_postings"))[0])


def sparse_live_docs(spark, d):
    p = table(spark, d, "sparse_postings").select("doc_id", "key").distinct()
    return S.reindex(p)


def sparse_named_topk(spark, d):
    p = table(spark, d, "sparse_postings")
    live = S.live_index(p)[0]
    q = live.filter("doc_id = 7").select("term_id", "weight")
    docs = p.select("doc_id", "key").filter("key is not null").distinct()
    return S.named(S.search(live, q, 10), docs).select("doc_id", "key", F.round("score", 6).alias("score"))


def sparse_delete(spark, d):
    live = S.live_index(table(spark, d, "sparse_postings"))[0]
    return S.index_stats(S.delete(live, live.filter("doc_id % 5 = 0").select("doc_id").distinct()))


def lex_index_stats(spark, d):
    return S.index_stats(words(spark, d))


def lex_topk(spark, d):
    return S.search(words(spark, d), _item(spark, d, 1), 10).select("doc_id", F.round("score", 6).alias("score"))


def _batch(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return S.search_texts(docs, docs.filter("doc_id % 50 = 0").withColumnRenamed("doc_id", "qid"), 10)


def lex_topk_batch(spark, d):
    return _batch(spark, d).select("qid", "doc_id", "rank", F.round("score", 6).alias("score"))


def _sides(spark, d):
    v = dense.vectors(spark, d)
    q = v.filter("key = 50").first()["vector"]
    near = K.search(v, q, 20, round_to=9).withColumnRenamed("key", "doc_id")
    mine = S.lexical_postings(table(spark, d, "documents").filter("doc_id = 50")).select("term_id", "weight")
    return near, S.search(words(spark, d), mine, 20)


def rrf_hybrid(spark, d):
    return S.hybrid("hybrid", *_sides(spark, d), 10)


def hybrid_dense_mode(spark, d):
    return S.hybrid("dense", *_sides(spark, d), 10).withColumn("score", F.round("score", 6))


def hybrid_sparse_mode(spark, d):
    return S.hybrid("sparse", *_sides(spark, d), 10).withColumn("score", F.round("score", 6))


def retrieval_eval(spark, d):
    """Does each queried page find itself? recall@10 and mean reciprocal rank."""
    r = _batch(spark, d).select("qid", F.col("doc_id").alias("key"), "rank")
    truth = table(spark, d, "documents").filter("doc_id % 50 = 0 and text is not null and text <> ''").select(F.col("doc_id").alias("qid"), F.col("doc_id").alias("key"))
    return K.retrieval_quality(r, truth, 10)


QUERIES = {k: f for k, f in globals().items() if k.startswith(("sparse_", "lex_", "rrf_", "hybrid_", "retrieval_")) and callable(f)}

_LIVE = """
WITH r AS (SELECT * FROM sparse_postings WHERE doc_id IS NOT NULL),
live AS (SELECT doc_id FROM r WHERE key IS NULL UNION SELECT max(doc_id) FROM r WHERE key IS NOT NULL GROUP BY key),
p AS (SELECT doc_id, term_id, max(weight)::DOUBLE AS weight FROM r WHERE weight > 0 AND NOT isnan(weight) AND doc_id IN (SELECT doc_id FROM live) GROUP BY ALL)
"""
_WORDS = r"""
WITH raw AS (SELECT doc_id, regexp_replace(unnest(string_split_regex(lower(text), '\s+')), '[^\p{L}\p{N}]', '', 'g') AS term_id FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, term_id, ln(1 + count(*)) AS weight FROM raw WHERE length(term_id) > 2 GROUP BY ALL)
"""
_STATS = "SELECT count(DISTINCT doc_id) AS num_documents, count(DISTINCT term_id) AS num_terms, count(*) AS num_postings, count(*)::DOUBLE / count(DISTINCT doc_id) AS avg_doc_length FROM p"
_SELF = _WORDS + """, s AS (SELECT q.doc_id AS qid, p.doc_id, round(sum(p.weight * q.weight), 9) AS score FROM p JOIN p q USING (term_id) WHERE q.doc_id % 50 = 0 GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10)
"""
_SIDES = _WORDS + """, dn AS (SELECT v.vec_id AS doc_id, round(1 - list_inner_product(v.x, q.x) / sqrt(list_inner_product(v.x, v.x) * list_inner_product(q.x, q.x)), 9) AS score
 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) v, (SELECT CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id = 50) q ORDER BY score, doc_id LIMIT 20),
sp AS (SELECT p.doc_id, round(sum(p.weight * q.weight), 9) AS score FROM p JOIN p q USING (term_id) WHERE q.doc_id = 50 GROUP BY 1 ORDER BY score DESC, p.doc_id LIMIT 20)
"""
ORACLE = {
    "sparse_index_stats": _LIVE + _STATS,
    "sparse_shard_stats": "SELECT shard_id, arg_max(num_documents, taken_at) AS num_documents, arg_max(num_terms, taken_at) AS num_terms, arg_max(num_postings, taken_at) AS num_postings FROM sparse_index_stats GROUP BY shard_id",
    "sparse_norms": _LIVE + "SELECT doc_id, sum(abs(weight)) AS l1, sqrt(sum(weight * weight)) AS l2, count(*) AS nnz FROM p GROUP BY doc_id",
    "sparse_live_docs": "SELECT max(doc_id) AS doc_id, key FROM sparse_postings WHERE key IS NOT NULL GROUP BY key UNION ALL SELECT DISTINCT doc_id, NULL FROM sparse_postings WHERE key IS NULL",
    "sparse_named_topk": _LIVE + """, s AS (SELECT p.doc_id, round(sum(p.weight * q.weight), 9) AS score FROM p JOIN p q USING (term_id) WHERE q.doc_id = 7 GROUP BY 1 ORDER BY score DESC, p.doc_id LIMIT 10)
SELECT doc_id, coalesce(k.key, '_doc_' || doc_id) AS key, round(score, 6) AS score FROM s LEFT JOIN (SELECT DISTINCT doc_id, key FROM r WHERE key IS NOT NULL) k USING (doc_id)""",
    "sparse_delete": _LIVE.replace("WHERE weight > 0", "WHERE doc_id % 5 <> 0 AND weight > 0") + _STATS,
    "lex_index_stats": _WORDS + _STATS,
    "lex_topk": _WORDS + r""", qr AS (SELECT regexp_replace(unnest(string_split_regex(lower(text), '\s+')), '[^\p{L}\p{N}]', '', 'g') AS term_id FROM eval_items WHERE item_id = 1),
q AS (SELECT term_id, ln(1 + count(*)) AS qw FROM qr WHERE length(term_id) > 2 GROUP BY 1)
SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, round(sum(weight * qw), 9) AS score FROM p JOIN q USING (term_id) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10)""",
    "lex_topk_batch": _SELF + "SELECT qid, doc_id, rank, round(score, 6) AS score FROM t",
    "rrf_hybrid": _SIDES + """, a AS (SELECT doc_id, 0.7::DOUBLE / (60 + row_number() OVER (ORDER BY score, doc_id)) AS s FROM dn UNION ALL SELECT doc_id, 0.3::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, doc_id)) FROM sp)
SELECT doc_id, round(sum(s), 9) AS score FROM a GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 10""",
    "hybrid_dense_mode": _SIDES + "SELECT doc_id, round(score, 6) AS score FROM dn ORDER BY dn.score, doc_id LIMIT 10",
    "hybrid_sparse_mode": _SIDES + "SELECT doc_id, round(score, 6) AS score FROM sp ORDER BY sp.score DESC, doc_id LIMIT 10",
    "retrieval_eval": _SELF + """SELECT avg(CASE WHEN t.rank IS NULL THEN 0.0 ELSE 1.0 END) AS recall_at_k, avg(coalesce(1.0 / t.rank, 0.0)) AS mrr, count(*) AS queries
FROM (SELECT doc_id AS qid FROM documents WHERE doc_id % 50 = 0 AND text <> '') q LEFT JOIN t ON t.qid = q.qid AND t.doc_id = q.qid""",
}
