import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from notewright.llm import quality_trees, weak_supervision


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


EDGES = [None, "", " \t\n", "a b c", "a b c a b c", "x\n\nx\n x", "é b *|*", "a b a b a b a b", "\x0bw\x0c#\r\n"]


def test_base_columns(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(1000 + i, t) for i, t in enumerate(EDGES)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, w string, quality int")
    got = {r["doc_id"]: r for r in weak_supervision.judge_quality(df).collect()}
    for d, t in rows:
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), (d, t)
        assert not (r["base_failed"] and r["kept"])


def test_verdicts_follow_quality(spark, small):
    sf = small.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    judged = weak_supervision.judge_quality(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id")
    counts = {(r["label"], r["kept"]): r["n"] for r in judged.where("not base_failed").groupBy("label", "kept").agg(F.count("*").alias("n")).collect()}
    assert counts.get((0, True), 0) <= 0.1 * counts[(0, False)] and counts.get((1, False), 0) <= 0.02 * counts[(1, True)]


def test_expectation_maximisation_against_loops(spark):
    rng = np.random.default_rng(2)
    good = rng.random(3000) < 0.7
    rates = {True: [(0.05, 0.35, 0.6), (0.1, 0.2, 0.7), (0.02, 0.9, 0.08)], False: [(0.7, 0.2, 0.1), (0.5, 0.3, 0.2), (0.6, 0.35, 0.05)]}
    votes = np.array([[rng.choice((-1, 0, 1), p=p) for p in rates[bool(g)]] for g in good])
    df = spark.createDataFrame([tuple(map(int, v)) for v in votes], "a int, b int, c int")
    share, if_good, if_bad = weak_supervision.fit_rules(df, ["a", "b", "c"], iterations=15)
    pi, g, b = weak_supervision.START_GOOD, np.tile(weak_supervision.START_IF_GOOD, 3), np.tile(weak_supervision.START_IF_BAD, 3)
    start_g, start_b, prior = g.copy(), b.copy(), weak_supervision.PRIOR_VOTES
    code = votes + 1 + 3 * np.arange(3)
    for _ in range(15):
        q = 1 / (1 + np.exp(-(np.log(pi / (1 - pi)) + np.log(g[code] / b[code]).sum(axis=1))))
        count = lambda w: np.array([(w[:, None] * (code == k)).sum() for k in range(9)])
        pi = (q.sum() + 1) / (len(q) + 2)
        g, b = (count(q) + prior * start_g) / (q.sum() + prior), (count(1 - q) + prior * start_b) / ((1 - q).sum() + prior)
    assert np.allclose([share], [pi]) and np.allclose(if_good, g) and np.allclose(if_bad, b)
    assert weak_supervision.judge_quality(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality_trees.grow(x, y, np.ones(len(y)), trees=40)
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.97

    def walk(f, t, leaf, row):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + int(row[f[at]] > t[at])
        return leaf[at - len(f)]

    slow = [1 / (1 + np.exp(-(forest.start + sum(walk(f, t, v, r) for f, t, v in zip(forest.feature, forest.threshold, forest.leaf))))) for r in x[:50]]
    assert np.allclose(forest.scores(x[:50]), slow)
    assert np.allclose(quality_trees.grow(x, np.ones(2000), np.ones(2000)).scores(x), 1, atol=1e-3)


def test_quality_scores_held_out(spark, small):
    sf = small.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_trees.score_quality(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    held = scored.where("held_out").join(labels, "doc_id").collect()
    assert sum((r["predicted"] == r["quality"]) for r in held) >= 0.9 * len(held)
    edge = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "", 2.0)], "doc_id long, text string, score double")
    rows = quality_trees.score_quality(edge, labels).collect()
    assert len(rows) == 3 and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_trees.score_quality(edge.limit(0), labels.limit(0)).count() == 0
    assert {r["score"] for r in quality_trees.score_quality(edge, labels.limit(0)).collect()} == {0.5}
