"""Character n-gram TF-IDF ranking: n-grams are counted where their text is."""

import math
from collections import Counter

from colweave.operators import ngrams

from .test_topk import shuffled_rows


def brute(texts, n, threshold):
    """n-gram -> score over (document, text) rows; a null document counts, but has no score of its own."""
    tf = {}
    for doc, t in texts:
        tf.setdefault(doc, Counter()).update(t[i : i + n] for i in range(len(t) - n + 1))
    df = Counter(g for c in tf.values() for g in c)
    out = Counter()
    for doc, c in tf.items():
        if doc is None:
            continue
        w = {g: m * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, m in c.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for g, x in w.items():
            out[g] += x / norm
    return {g: s for g, s in out.items() if s > threshold}


def test_counts_stay_with_their_texts(spark, monkeypatch):
    texts = [(i, f"steel copper linen {i % 7} almond forest lace") for i in range(300)] + [(5, "again steel"), (None, "copper thistle"), (7, "ab")]
    rows = spark.createDataFrame([("c", i, t) for i, t in texts], "g string, d long, t string")
    scores = ngrams.ngram_tfidf_scores(rows, ["g"], "d", "t", 3, 6, 0.3)
    # before: every n-gram of every text, about 50,000
    assert shuffled_rows(scores) < 25_000
    got = {(r["n"], r["ngram"]): r["score"] for r in scores.collect()}
    want = {(n, g): s for n in range(3, 7) for g, s in brute(texts, n, 0.3).items()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)

    monkeypatch.setattr(ngrams, "TASK_GRAMS", 200)  # many tasks give the same
    again = ngrams.ngram_tfidf_scores(rows, ["g"], "d", "t", 3, 6, 0.3).collect()
    assert {(r["n"], r["ngram"]) for r in again} == want.keys()


def test_no_texts(spark):
    rows = spark.createDataFrame([("c", 1, None)], "g string, d long, t string")
    assert ngrams.ngram_tfidf_scores(rows, ["g"], "d", "t").count() == 0
