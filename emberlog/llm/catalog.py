"""Queries of the llm operators, with the SQL that DuckDB runs for the same result where SQL can."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.clusters import cluster_report, similarity_clusters
from emberlog.llm.keyness import keyness, standout_terms
from emberlog.llm.leaks import leaked_passages
from emberlog.llm.lookalikes import consistent_forms, look_equal_pairs, print_classes
from emberlog.llm.neighbours import nearest
from emberlog.llm.packing import mixture, mixture_report, pack
from emberlog.llm.sampling import uniform_sample
from emberlog.plans.session import cut
from emberlog.sources.tables import table

RECORD = ["session_id", "machine_id", "state", "action", "reward", "next_state"]


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform sample of 1 000 distinct transitions."""
    return uniform_sample(table(spark, sf_dir, "transitions"), RECORD, 1000, id="transition_id", seed=20250201)


def p2_sample_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many records were drawn, and whether all are different, numbered densely and among the transitions."""
    drawn = cut(p2_sample(spark, sf_dir))
    known = table(spark, sf_dir, "transitions").select(*RECORD, F.lit(True).alias("known")).dropDuplicates(RECORD)
    same = [drawn[c].eqNullSafe(known[c]) for c in RECORD]
    hit = drawn.join(known, reduce(and_, same)).agg(F.count(F.lit(1))).scalar()
    return drawn.agg(F.count(F.lit(1)).alias("drawn"), (F.countDistinct("position") == F.max("position") + 1).alias("dense"), (F.count(F.lit(1)) == hit).alias("all_known"))


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z-score of every term of every live document."""
    return keyness(table(spark, sf_dir, "sparse_postings"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live documents with a term that scores at least three times as much as any other."""
    return standout_terms(keyness(table(spark, sf_dir, "sparse_postings"))).select("doc_id", "term_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key of a cluster of at least three keys, with the cluster's smallest key."""
    clusters = similarity_clusters(table(spark, sf_dir, "mmap_vectors"))
    sizes = clusters.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("cluster_key")
    return clusters.join(sizes, "cluster_key", "left_semi").select("key", "cluster_key")


def p5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every cluster of at least three keys."""
    return p5_clusters(spark, sf_dir).select("cluster_key", "size")


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical keys of every cluster of at least three keys."""
    return cluster_report(similarity_clusters(table(spark, sf_dir, "mmap_vectors")))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most similar keys of every key, with rank and cosine distance."""
    return nearest(table(spark, sf_dir, "mmap_vectors"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of keys of which one is among the other's three most similar, at a cosine distance of at most 0.30."""
    near = nearest(table(spark, sf_dir, "mmap_vectors"), within=0.30)
    return near.select(F.least("key", "neighbour").alias("key_a"), F.greatest("key", "neighbour").alias("key_b")).distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of 2 048 tokens, and the place in it, of every page or piece of a long page."""
    return pack(table(spark, sf_dir, "documents"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every window of 256 containers holds of each source."""
    return mixture(pack(table(spark, sf_dir, "documents")))


def p7_mixture_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: is every full window within 0.1 of the corpus' shares, and are there at most 1.002 times as many containers as the tokens need, and one?"""
    report = mixture_report(pack(table(spark, sf_dir, "documents")))
    return report.select((F.col("worst") <= 0.1).alias("mixture_held"), (F.col("containers") <= F.col("ideal") * 1.002 + 1).alias("containers_few"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that print at least twelve consecutive words of an evaluation item, with the item."""
    return leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of pages that look the same in print and differ in their characters."""
    return look_equal_pairs(table(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of a class of texts that look the same, with the page that stands for the class."""
    return print_classes(table(spark, sf_dir, "documents")).select("doc_id", "form_id")


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every page's text."""
    return consistent_forms(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


_LIVE = """
WITH r AS (SELECT * FROM sparse_postings WHERE doc_id IS NOT NULL),
live AS (SELECT doc_id FROM r WHERE key IS NULL UNION SELECT max(doc_id) FROM r WHERE key IS NOT NULL GROUP BY key),
p AS (SELECT doc_id, term_id, max(weight)::DOUBLE AS weight FROM r WHERE weight > 0 AND NOT isnan(weight) AND doc_id IN (SELECT doc_id FROM live) GROUP BY ALL),
n AS (SELECT count(*) AS num_documents FROM live),
t AS (SELECT term_id, count(*) AS doc_freq, sum(weight) AS term_weight FROM p GROUP BY 1),
d AS (SELECT doc_id, sum(weight) AS doc_weight FROM p GROUP BY 1),
w AS (SELECT sum(weight) AS all_weight FROM p)
"""


#: The similar pairs of all sound vectors; exact, for small tables.
_PAIRS = """
WITH RECURSIVE v AS (
  SELECT key, CAST(vector AS DOUBLE[]) AS x FROM mmap_vectors
  WHERE key IS NOT NULL AND len(vector) = 128 AND list_bool_and(list_transform(vector, lambda a: a IS NOT NULL AND isfinite(a))) AND list_bool_or(list_transform(vector, lambda a: a <> 0))
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq) = 1),
u AS (SELECT key, list_transform(x, lambda a: a / sqrt(list_inner_product(x, x)))::DOUBLE[128] AS x FROM v),
near AS (SELECT a.key AS a, b.key AS b, round(1 - array_inner_product(a.x, b.x), 9) AS d FROM u a JOIN u b ON a.key <> b.key WHERE 1 - array_inner_product(a.x, b.x) <= 0.31)
"""


_CLUSTERS = """, reach AS (SELECT key AS a, key AS b FROM u UNION SELECT reach.a, near.b FROM reach JOIN near ON near.a = reach.b WHERE near.d <= 0.30),
c AS (SELECT a AS key, min(b) AS cluster_key FROM reach GROUP BY a)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_mixture_held": "SELECT true AS mixture_held, true AS containers_few",  # what must hold
        "p2_sample_held": f"SELECT least(1000, count(*)) AS drawn, true AS dense, true AS all_known FROM (SELECT DISTINCT {', '.join(RECORD)} FROM transitions)",
        "p5_found": _PAIRS + _CLUSTERS + "SELECT key, cluster_key FROM c QUALIFY count(*) OVER (PARTITION BY cluster_key) >= 3",
        "p5_sizes": _PAIRS + _CLUSTERS + "SELECT cluster_key, count(*) AS size FROM c GROUP BY cluster_key HAVING count(*) >= 3",
        "p6_found": _PAIRS
        + """, three AS (SELECT a, b FROM near WHERE d <= 0.30 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 3)
SELECT DISTINCT least(a, b) AS key_a, greatest(a, b) AS key_b FROM three""",
        "p4_scores": _LIVE
        + """, x AS (SELECT *, 10.0::DOUBLE * term_weight / all_weight AS a, term_weight - weight AS yr FROM p JOIN t USING (term_id) JOIN d USING (doc_id), n, w)
SELECT doc_id, term_id, weight, doc_freq, num_documents,
  (ln((weight + a) / (doc_weight + 10 - weight - a)) - ln((yr + a) / (all_weight - doc_weight + 10 - yr - a))) / sqrt(1 / (weight + a) + 1 / (yr + a)) AS z FROM x""",
        "p4_found": _LIVE
        + """, s AS (SELECT doc_id, term_id, weight * ln(num_documents / doc_freq) AS score FROM p JOIN t USING (term_id), n),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term_id) AS r, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, term_id) AS second FROM s)
SELECT doc_id, term_id FROM k WHERE r = 1 AND second IS NOT NULL AND score >= 3 * second""",
    }
