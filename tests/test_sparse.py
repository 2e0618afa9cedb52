"""Many text queries against all documents: the same rows as pair by pair, without a row per pair of postings."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from emberlog import catalog
from emberlog.operators import sparse as S


def by_pairs(docs, queries, k):
    """What search_texts must give, every document with every query: texts of one id are one document."""

    def weights(rows):
        texts = {}
        for id, text in rows:
            if text is not None:
                texts[id] = f"{texts.get(id, '')} {text}"
        return {id: S.count_terms(t) for id, t in texts.items()}

    d, q = weights(docs), weights(queries)
    words = sorted({w for c in d.values() for w in c})
    x, y = (np.array([[np.log1p(c[w]) for w in words] for c in side.values()]) for side in (d, q))
    names, out = list(d), set()
    ids = sorted(range(len(d)), key=lambda i: (names[i] is None, names[i] or 0))
    scores, names = np.round(x @ y.T, 9)[ids], [names[i] for i in ids]
    for j, qid in enumerate(q):
        best = [i for i in np.argsort(-scores[:, j], kind="stable")[:k] if scores[i, j] > 0]
        out |= {(qid, names[i], n + 1, round(float(scores[i, j]), 6)) for n, i in enumerate(best)}
    return out


def found(spark, docs, queries, k, **how):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    q = spark.createDataFrame(queries, "qid bigint, text string")
    return {(r.qid, r.doc_id, r["rank"], round(r.score, 6)) for r in S.search_texts(d, q, k, **how).collect()}


@pytest.mark.parametrize("chars", [S.QUERY_CHARS, 4000])
def test_as_by_pairs(spark, chars):
    draw = random.Random(3)
    words = [f"{a}{b}{c}" for a in "kmé" for b in "aou" for c in "rstßx"]
    text = lambda n: " ".join(words[int(len(words) * draw.random() ** 3)] for _ in range(draw.randrange(n)))
    docs = [(i, text(12)) for i in range(2300)]  # more than a block of documents
    queries = [(i, text(8)) for i in range(1100)]  # more than a block of queries
    assert found(spark, docs, queries, 3, query_chars=chars) == by_pairs(docs, queries, 3)


def test_odd_rows(spark):
    docs = [(1, "alpha beta"), (1, "ALPHA  g-amma"), (2, None), (3, ""), (None, "alpha"), (4, "no is"), (5, "beta alpha"), (6, "zeta"), (7, "zeta"), (2**62 + 1, "alpha")]
    queries = [(1, "alpha alpha beta"), (1, "gamma"), (2, None), (3, "is"), (4, "zeta"), (5, "unheard"), (6, "betaalpha")]
    want = by_pairs(docs, queries, 2)
    assert found(spark, docs, queries, 2) == want
    assert {(q, d) for q, d, _, _ in want} == {(1, 1), (1, 2**62 + 1), (4, 6), (4, 7), (6, 5)}
    assert found(spark, docs, [(1, "")], 2) == found(spark, [], queries, 2) == set()


@pytest.mark.parametrize("asked, common, most", [(3, 2, 2), (2, 1, 0), (50, 9, 99)])
def test_scores_of_blocks(asked, common, most, monkeypatch):
    monkeypatch.setattr(S, "PAIRS", 7)
    draw = np.random.Generator(np.random.PCG64(1))
    q = draw.integers(1, 5, (8, 12)) * (draw.random((8, 12)) < 0.4)
    qid, term = np.nonzero(q)
    a = S.Asked(pa.table({"qid": qid, "term": pa.array([f"t{t:02}" for t in term]), "tf": q[qid, term]}), asked, common, most)
    x = np.log1p(draw.integers(0, 3, (5, len(a.terms))).astype(float))
    rows, terms = np.nonzero(x[:, a.dense :])
    s = np.concatenate([a.scores(b, x[:, : a.dense], rows, terms + a.dense, x[rows, terms + a.dense]) for b in range(len(a.blocks))], axis=1)
    assert a.dense <= most
    at = [int(t[1:]) for t in a.terms.to_pylist()]
    assert np.allclose(s, x @ np.log1p(q[a.qids.to_numpy()][:, at]).T, atol=1e-12)


def test_lex_topk_batch_forms_no_pairs_of_postings(spark, data):
    plan = catalog.queries()["lex_topk_batch"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_retrieval_eval_forms_no_pairs_of_postings(spark, tmp_path):
    """Of pages 50 to 250, one is beaten by 12 longer ones, one comes second, two first; the empty one has no score and isn't asked."""
    longer = [(1000 + i, "river river mill mill") for i in range(1, 13)]
    pages = [(50, "river mill"), (100, "bridge"), (101, "bridge bridge"), (150, "tower clock"), (200, "garden"), (250, ""), (300, None), (151, "clock")]
    spark.createDataFrame(longer + pages, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.queries()["retrieval_eval"](spark, str(tmp_path))
    assert [tuple(r) for r in df.select("recall_at_k", "mrr", "queries").collect()] == [(0.75, 0.625, 4)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # the truth with what was found
