"""Dense search over the embeddings table; the batch queries are every row whose id is divisible by 50."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions import distance as D
from emberlog.operators import knn as K
from emberlog.operators.ann import HashIndex, ListIndex
from emberlog.plans.session import cut, scratch
from emberlog.sources.tables import table


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")


def queries_of(v: DataFrame) -> DataFrame:
    return v.filter(F.col("key") % 50 == 0).select(F.col("key").alias("qid"), "vector")


def _one(spark, d, metric):
    v = vectors(spark, d)
    q = v.filter("key = 0").first()["vector"]
    return K.search(v, q, 10, metric, round_to=6)


def knn_cosine(spark, d):
    return _one(spark, d, "cosine")


def knn_euclidean(spark, d):
    return _one(spark, d, "euclidean")


def knn_dot(spark, d):
    return _one(spark, d, "dot")


def knn_batch(spark, d):
    v = vectors(spark, d)
    return K.search_batch(v, queries_of(v), 10).select("qid", "key", "rank", F.round("score", 6).alias("score"))


def knn_label_vote(spark, d):
    v = vectors(spark, d)
    near = K.search_batch(v, queries_of(v), 5, not_self=True).join(v.select("key", "label"), "key")
    votes = near.groupBy("qid", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("qid").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("vote"))


def _doubled(spark, d):
    v = vectors(spark, d)
    again = v.filter("key % 3 = 0").select("key", F.reverse("vector").alias("vector"), "label", F.lit(2).alias("seq"))
    return v.withColumn("seq", F.lit(1)).unionByName(again)


def knn_first_write_wins(spark, d):
    q = vectors(spark, d).filter("key = 0").first()["vector"]
    return K.search(K.first_write(_doubled(spark, d)), q, 10, round_to=6)


def knn_last_write_wins(spark, d):
    q = vectors(spark, d).filter("key = 0").first()["vector"]
    return K.search(K.last_write(_doubled(spark, d)), q, 10, round_to=6)


def vec_similarity_desc(spark, d):
    v = vectors(spark, d)
    q = F.array(*[F.lit(float(x)) for x in v.filter("key = 1").first()["vector"]])
    return v.select("key", F.round(D.dot(D.normalised(F.col("vector")), D.normalised(q)), 6).alias("similarity")).orderBy(F.desc("similarity"), "key").limit(10)


def vec_centroid_by_label(spark, d):
    return K.centroids(vectors(spark, d), "label").withColumn("mean", F.round("mean", 6))


def vec_norms(spark, d):
    return vectors(spark, d).select("key", F.round(D.norm(F.col("vector")), 6).alias("norm"))


def vec_new_keys(spark, d):
    """How many keys of a batch are new to the store."""
    v = vectors(spark, d)
    batch = v.select((F.col("key") + 100).alias("key"))
    return batch.join(v.select("key"), "key", "left_anti").agg(F.count(F.lit(1)).alias("new_keys"))


def hot_cold_merge(spark, d):
    v = vectors(spark, d)
    q = v.filter("key = 0").first()["vector"]
    hot = K.search(v.filter("key % 3 <> 1"), q, 20, round_to=6)
    cold = K.search(v.filter("key % 3 <> 2"), q, 20, round_to=6)
    return K.merge_tiers(hot, cold, 10)


def hot_cold_promote(spark, d):
    v = vectors(spark, d).select("key", "label")
    return K.promote(v.filter("key % 3 <> 1"), v.filter("key % 3 <> 2"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, vector, seq of the vectors in clusters: of each key its first row with finite numbers that aren't all zero."""
    rows = table(spark, sf_dir, "mmap_vectors").select("key", F.col("vector").cast("array<float>").alias("vector"), "seq")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = rows.filter((F.size("vector") == 128) & finite & F.exists("vector", lambda x: x != 0) & F.col("key").isNotNull())
    return cut(sound.groupBy("key").agg(F.min_by("vector", F.struct("seq", "vector")).alias("vector"), F.min("seq").alias("seq")))


def asked(v: DataFrame) -> DataFrame:
    return v.filter(F.col("seq") % 50 == 0).select(F.col("key").alias("qid"), "vector")


def ivf_search(spark, d):
    """The ten nearest by lists that grow with the corpus; a search opens one list in thirty-two."""
    v = clustered(spark, d)
    index = ListIndex().fit(v)
    return index.search(index.place(v), asked(v), 10)


def ivf_recall(spark, d):
    """One row: are at least 0.95 of the true ten nearest found, with at most a tenth of all pairs measured (or sixty rows a query, where that is more)?"""
    v = clustered(spark, d)
    index, q = ListIndex().fit(v), asked(v)
    placed = cut(index.place(v))
    recall = K.recall_at(index.search(placed, q, 10), K.search_batch(v, q, 10), 10).agg(F.avg("recall").alias("recall"))
    return recall.select((F.col("recall") >= 0.95).alias("recall_held"), F.lit(index.scanned(placed, q, 10) <= max(0.1, 60 / index.rows)).alias("share_held"))


def ivf_list_sizes(spark, d):
    """One row: is every vector in exactly one list, and how many vectors are there?"""
    v = clustered(spark, d)
    index = ListIndex().fit(v)
    return index.sizes(index.place(v)).agg(F.sum("n").alias("vectors"), (F.max("list") < len(index.centres)).alias("lists_known"))


def ivf_stored(spark, d):
    """One row: a stored index that is opened again, and had half of the vectors inserted later, finds the same as one that is not stored."""
    v = clustered(spark, d)
    index, path = ListIndex().fit(v), scratch(spark, "lists")
    early = F.pmod(F.xxhash64("key"), F.lit(2)) == 0
    index.save(v.filter(early), path)
    again = ListIndex.load(spark, path, 128)
    again.insert(v.filter(~early))
    a, b = index.search(index.place(v), asked(v), 10), again.search(again.stored(spark), asked(v), 10)
    both = a.select("qid", "key", "score", "rank").exceptAll(b.select("qid", "key", "score", "rank"))
    return both.agg((F.count(F.lit(1)) == 0).alias("same"))


def lsh_search(spark, d):
    """The ten nearest by hyperplane hashing with bits that grow with the corpus."""
    v = clustered(spark, d)
    index = HashIndex.sized(v.count())
    return index.search(index.buckets(v), v, asked(v), 10)


def lsh_recall(spark, d):
    """One row: of the true ten nearest those within a cosine distance of 0.30: are at least 0.95 found, with at most a tenth of all pairs measured (or sixty rows a query, where that is more)?"""
    v = clustered(spark, d)
    n, q = v.count(), asked(v)
    index = HashIndex.sized(n)
    buckets = cut(index.buckets(v))
    truth = K.search_batch(v, q, 10).filter("score <= 0.30")
    hit = truth.select("qid", "key").join(index.search(buckets, v, q, 10).select("qid", "key", F.lit(1.0).alias("hit")), ["qid", "key"], "left")
    return hit.agg((F.avg(F.coalesce("hit", F.lit(0.0))) >= 0.95).alias("recall_held")).withColumn("share_held", F.lit(index.scanned(buckets, n, q) <= max(0.1, 60 / n)))


def lsh_bucket_stats(spark, d):
    """One row: do all tables together hold every vector once a table?"""
    v = clustered(spark, d)
    index = HashIndex.sized(v.count())
    s = index.stats(index.buckets(v))
    return s.agg(F.count(F.lit(1)).alias("tables"), F.min(F.round(F.col("buckets") * F.col("mean")).cast("bigint")).alias("least"), F.max(F.round(F.col("buckets") * F.col("mean")).cast("bigint")).alias("most"))


def vec_projection(spark, d):
    """The three leading principal components, for a picture of the store."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors(spark, d).select("key", array_to_vector(F.col("vector").cast("array<double>")).alias("x"))
    p = vector_to_array(F.col("p"))
    return PCA(k=3, inputCol="x", outputCol="p").fit(v).transform(v).select("key", p[0].alias("p0"), p[1].alias("p1"), p[2].alias("p2"))


def vec_projection_held(spark, d):
    """One row: one point for each vector, the components in the order of their variance and uncorrelated."""
    p = cut(vec_projection(spark, d))
    var = [F.var_pop(f"p{i}") for i in range(3)]
    apart = [F.abs(F.avg(F.col(f"p{i}") * F.col(f"p{j}")) - F.avg(f"p{i}") * F.avg(f"p{j}")) < 1e-6 for i, j in ((0, 1), (0, 2), (1, 2))]
    return p.agg(F.count(F.lit(1)).alias("points"), ((var[0] >= var[1]) & (var[1] >= var[2])).alias("in_order"), (apart[0] & apart[1] & apart[2]).alias("uncorrelated"))


QUERIES = {k: f for k, f in globals().items() if k.startswith(("knn_", "vec_", "hot_", "ivf_", "lsh_")) and callable(f)}

_V = "WITH v AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings), q AS (SELECT x AS y FROM v WHERE key = 0)\n"
_COS = "round(1 - list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 6)"
_TWO = ", w AS (SELECT key, x, 1 AS seq FROM v UNION ALL SELECT key, list_reverse(x), 2 FROM v WHERE key % 3 = 0)\n"
_ALL = """, p AS (SELECT q.key AS qid, v.key, v.label, 1 - list_inner_product(v.x, q.x) / sqrt(list_inner_product(v.x, v.x) * list_inner_product(q.x, q.x)) AS s FROM v JOIN (SELECT * FROM v WHERE key % 50 = 0) q ON true)\n"""
_SOUND = """WITH s AS (SELECT DISTINCT key FROM mmap_vectors WHERE key IS NOT NULL AND len(vector) = 128
  AND list_bool_and(list_transform(vector, lambda a: a IS NOT NULL AND isfinite(a))) AND list_bool_or(list_transform(vector, lambda a: a <> 0)))
"""
ORACLE = {
    "knn_cosine": _V + f"SELECT key, {_COS} AS score FROM v, q ORDER BY score, key LIMIT 10",
    "knn_euclidean": _V + "SELECT key, round(list_distance(x, y), 6) AS score FROM v, q ORDER BY score, key LIMIT 10",
    "knn_dot": _V + "SELECT key, round(-list_inner_product(x, y), 6) AS score FROM v, q ORDER BY score, key LIMIT 10",
    "knn_batch": _V + _ALL + "SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9), key) AS rank, round(s, 6) AS score FROM p QUALIFY rank <= 10",
    "knn_label_vote": _V + _ALL + """, t AS (SELECT * FROM p WHERE key <> qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(s, 9), key) <= 5),
n AS (SELECT qid, label, count(*) AS n FROM t GROUP BY ALL) SELECT qid, arg_max(label, (n, -label)) AS vote FROM n GROUP BY qid""",
    "knn_first_write_wins": _V + _TWO + f", f AS (SELECT key, arg_min(x, seq) AS x FROM w GROUP BY key) SELECT key, {_COS} AS score FROM f, q ORDER BY score, key LIMIT 10",
    "knn_last_write_wins": _V + _TWO + f", f AS (SELECT key, arg_max(x, seq) AS x FROM w GROUP BY key) SELECT key, {_COS} AS score FROM f, q ORDER BY score, key LIMIT 10",
    "vec_similarity_desc": _V + ", o AS (SELECT x AS y FROM v WHERE key = 1) SELECT key, round(list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 6) AS similarity FROM v, o ORDER BY similarity DESC, key LIMIT 10",
    "vec_centroid_by_label": _V + "SELECT label, pos, avg(e) AS mean FROM (SELECT label, unnest(x) AS e, unnest(range(1, 65)) AS pos FROM v) GROUP BY ALL",
    "vec_norms": _V + "SELECT key, round(sqrt(list_inner_product(x, x)), 6) AS norm FROM v",
    "vec_new_keys": _V + "SELECT count(*) AS new_keys FROM v WHERE key + 100 NOT IN (SELECT key FROM v)",
    "hot_cold_merge": _V + f""", s AS (SELECT key, {_COS} AS score FROM v, q),
h AS (SELECT *, 'hot' AS source FROM s WHERE key % 3 <> 1 ORDER BY score, key LIMIT 20), c AS (SELECT *, 'cold' AS source FROM s WHERE key % 3 <> 2 ORDER BY score, key LIMIT 20)
SELECT key, min(score) AS score, max(source) AS source FROM (SELECT * FROM h UNION ALL SELECT * FROM c) GROUP BY key ORDER BY score, key LIMIT 10""",
    "vec_projection_held": "SELECT count(*) AS points, true AS in_order, true AS uncorrelated FROM embeddings",
    "ivf_recall": "SELECT true AS recall_held, true AS share_held",  # what must hold
    "lsh_recall": "SELECT true AS recall_held, true AS share_held",
    "ivf_stored": "SELECT true AS same",
    "ivf_list_sizes": _SOUND + "SELECT count(*)::BIGINT AS vectors, true AS lists_known FROM s",
    "lsh_bucket_stats": _SOUND + "SELECT 20::BIGINT AS tables, count(*) AS least, count(*) AS most FROM s",
    "hot_cold_promote": _V + "SELECT key, label FROM v",
}
