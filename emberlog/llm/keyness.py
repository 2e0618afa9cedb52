"""How distinctive a term is for a document: log-odds with an informative Dirichlet prior, as z-scores.

For a document d and a term t with weight y in d: the log-odds of t in d less those in all other documents, both smoothed
by a prior of ``prior`` pseudo-weight spread as the whole collection is, divided by its standard error.

Defined results
    * postings with a null, NaN, infinite or non-positive weight, or a null doc_id or term_id, are void; a repeated posting counts once
      (of differing weights the greatest).
    * of the documents with one key only that with the greatest doc_id is live; documents without key are all live.
      A document is live by its rows, void ones included.
    * where a term is all there is on a side of the odds (a document or collection of one term), z is 0.
    * empty input: empty. Extra columns are ignored.

Scale: three aggregations with map-side combining (by posting, by document, by term). Totals of terms that are in a large share
of the postings, and of very long documents, are broadcast (a bounded number: ``skew.join_totals``), the others joined by a shuffle.
A document's terms are ranked by z after one shuffle by document; only documents that z's proposals don't settle are ranked by score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.operators.skew import join_totals
from emberlog.operators.sparse import live_index
from emberlog.plans.session import cut


def keyness(postings: DataFrame, *, prior: float = 10.0) -> DataFrame:
    """Per live document and term: doc_id, term_id, weight, doc_freq, num_documents, z."""
    p, live = live_index(postings)
    p = cut(p)  # read four times below
    terms = p.groupBy("term_id").agg(F.sum("weight").alias("term_weight"), F.count(F.lit(1)).alias("doc_freq"))
    docs = p.groupBy("doc_id").agg(F.sum("weight").alias("doc_weight"), F.count(F.lit(1)).alias("doc_terms"))
    whole, n = docs.agg(F.sum("doc_weight")).scalar(), live.agg(F.count(F.lit(1))).scalar()  # one number each
    x = join_totals(join_totals(p, docs, "doc_id", "doc_terms"), terms, "term_id", "doc_freq").withColumns({"all_weight": whole, "num_documents": n})
    y, a = F.col("weight"), F.try_divide(F.lit(prior) * F.col("term_weight"), F.col("all_weight"))
    yr = F.greatest(F.col("term_weight") - y, F.lit(0.0))
    rest, rest_r = F.col("doc_weight") + prior - y - a, F.greatest(F.col("all_weight") - F.col("doc_weight"), F.lit(0.0)) + prior - yr - a
    tiny = F.lit(1e-9)
    z = (F.log(F.try_divide(y + a, rest)) - F.log(F.try_divide(yr + a, rest_r))) / F.sqrt(1 / (y + a) + 1 / (yr + a))
    return x.select("doc_id", "term_id", "weight", "doc_freq", "num_documents", F.when((rest > tiny) & (rest_r > tiny), z).otherwise(F.lit(0.0)).alias("z"))


def proposed_terms(scored: DataFrame, *, proposals: int = 4) -> DataFrame:
    """doc_id, term_id, z, z_rank, score, second, settled: of the ``proposals`` terms of a document with the highest z (ties: smaller term) that with the
    greatest score weight * ln(N / n) (ties: smaller term). second: the greatest other score of the document, null if it has one term only;
    settled: no term outside the proposals has as great a score, so what is asked of the document's best term can be answered for this one.
    """
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("z"), "term_id"))
    ranked = _with_score(scored).withColumn("z_rank", rank)
    proposed = F.struct((-F.col("score")).alias("less"), "term_id", "z", "z_rank")
    per_doc = ranked.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("z_rank") <= proposals, proposed))).alias("proposed"),
        F.max(F.when(F.col("z_rank") > proposals, F.col("score"))).alias("outside"),
    )
    best, score = F.get("proposed", F.lit(0)), -F.get("proposed", F.lit(0))["less"]
    second = F.greatest(-F.get("proposed", F.lit(1))["less"], F.col("outside"))
    settled = F.col("outside").isNull() | (score > F.col("outside"))
    return per_doc.select("doc_id", best["term_id"].alias("term_id"), best["z"].alias("z"), best["z_rank"].alias("z_rank"), score.alias("score"), second.alias("second"), settled.alias("settled"))


def _with_score(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "term_id", "z", (F.col("weight") * F.log(F.col("num_documents") / F.col("doc_freq"))).alias("score"))


def standout_terms(scored: DataFrame, *, ratio: float = 3.0, proposals: int = 4) -> DataFrame:
    """doc_id, term_id, z, z_rank: the terms whose weight * ln(N / n) is at least ``ratio`` times every other score of their document.

    z proposes: what ``proposed_terms`` settles is given with its rank by z, if it passes the exact check; other scores of these documents are not ranked.
    Documents that the proposals don't settle are the rest, and only they are decided by a ranking of the exact score (z_rank null), so no
    case is lost to z. Documents of one term give nothing; of equal best scores the smaller term counts as the best.
    """
    proposed = cut(proposed_terms(scored, proposals=proposals))  # a row a document, read twice
    rest = _with_score(scored).join(proposed.filter(~F.col("settled")).select("doc_id"), "doc_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "term_id"))
    term = F.struct("term_id", "score", "z")
    decided = (
        rest.withColumn("r", rank)
        .filter(F.col("r") <= 2)
        .groupBy("doc_id")
        .agg(F.max(F.when(F.col("r") == 1, term)).alias("best"), F.max(F.when(F.col("r") == 2, F.col("score"))).alias("second"))
        .select("doc_id", "best.term_id", "best.z", F.lit(None).cast("int").alias("z_rank"), "best.score", "second")
    )
    found = proposed.filter("settled").drop("settled").unionByName(decided)
    return found.filter(F.col("score") >= ratio * F.col("second")).select("doc_id", "term_id", "z", "z_rank")
