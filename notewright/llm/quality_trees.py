"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are DataFrame expressions inside each row. Trees are grown on binned values of a bounded sample and
kept as flat arrays (feature, threshold, leaf value), one full binary tree after another, so that a whole batch
walks down a tree with one gather and one comparison a level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import crc_fold
from notewright.llm.weak_supervision import statistics

#: Labelled rows that the trees are grown on, of each class at most: a bound, whatever the input's size.
SAMPLE_PER_CLASS = {1: 6000, 0: 3000}
TREES, DEPTH, BINS = 80, 4, 64
RATE, LEAST_LEAF, RIDGE = 0.12, 12.0, 2.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0


def feature_columns() -> dict[str, Column]:
    """Ratios and sizes over the columns of ``statistics``; all are finite for an empty text."""
    c = F.col
    words, chars, lines = (F.greatest(c(x), F.lit(1)) for x in ("n_words", "word_chars", "n_lines"))
    return {
        "f_words": F.log1p(c("n_words").cast("double")),
        "f_mean_length": c("word_chars") / words,
        "f_symbols": c("n_symbols") / chars,
        "f_symbol_runs": c("n_symbol_runs") / words,
        "f_letters": c("n_letters") / chars,
        "f_upper": c("n_upper") / chars,
        "f_stops": c("n_stops") / words,
        "f_bangs": c("n_bangs") / words,
        "f_distinct": c("n_distinct") / words,
        "f_repeats": c("n_repeat_words") / words,
        "f_dup_lines": c("n_dup_lines") / lines,
        "f_words_per_line": F.log1p(c("n_words") / lines),
    }


@dataclass
class Forest:
    """``feature``, ``threshold``: (trees, 2**depth - 1); ``leaf``: (trees, 2**depth). A split that was not worth
    making has threshold infinity."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            total += leaf[at - len(f)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boosted trees for weighted log loss. With fewer than two classes every score is the share of label 1."""
    n, width = x.shape
    share = (float((weight * y).sum()) + 0.5) / (float(weight.sum()) + 1.0)
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    features, thresholds, leaves = [], [], []
    raw = np.full(n, start)
    lane = np.arange(width) * bins
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, threshold, split_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = ((at - first)[:, None] * (width * bins) + lane + binned).ravel()
            shape = (count, width, bins)
            g = np.bincount(cell, np.repeat(grad, width), count * width * bins).reshape(shape)
            h = np.bincount(cell, np.repeat(hess, width), count * width * bins).reshape(shape)
            m = np.bincount(cell, np.repeat(weight, width), count * width * bins).reshape(shape)
            gl, hl, ml = g.cumsum(2), h.cumsum(2), m.cumsum(2)
            gt, ht, mt = gl[..., -1:], hl[..., -1:], ml[..., -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(ml < LEAST_LEAF) | (mt - ml < LEAST_LEAF)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for node in range(count):
                if gain.reshape(count, -1)[node, best[node]] > 1e-6:
                    j, b = divmod(int(best[node]), bins)
                    if b < len(edges[j]):
                        feature[first + node], threshold[first + node], split_bin[first + node] = j, edges[j][b], b
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > split_bin[at])
        spot = at - inner
        gs, hs = np.bincount(spot, grad, inner + 1), np.bincount(spot, hess, inner + 1)
        leaf = -RATE * gs / (hs + RIDGE)
        raw += leaf[spot]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Forest(np.stack(features), np.stack(thresholds), np.stack(leaves), start)


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, weight) of a bounded sample outside the held-out fold, weighted to the classes' shares."""
    usable = labels.select(F.col(id_col).cast("long").alias("__id"), F.col("quality").cast("int").alias("y")).where("__id is not null and y in (0, 1)")
    usable = usable.groupBy("__id").agg(F.max("y").alias("y")).where(crc_fold(F.col("__id"), FOLDS) != HELD_OUT)
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [usable.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n) for y, n in SAMPLE_PER_CLASS.items()]
    # at most sum(SAMPLE_PER_CLASS) ids: small enough to send to every task
    chosen = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("t")).join(F.broadcast(parts[0].unionByName(parts[1])), "__id")
    named = feature_columns()
    told = statistics(chosen.select(F.struct("__id", "y").alias("k"), "t"), "k", "t")
    rows = sorted(tuple(r) for r in told.select("doc_id.__id", *[f.alias(k) for k, f in named.items()], "doc_id.y").collect())
    table = np.array(rows, np.float64).reshape(-1, len(named) + 2)
    y = table[:, -1]
    have = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 0) / have[1], counts.get(0, 0) / have[0])
    return table[:, 1:-1], y, weight * (len(y) / max(1e-9, weight.sum()))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model: Forest | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    The trees are grown on at most SAMPLE_PER_CLASS labelled rows outside the held-out fold, or given. Null and
    empty texts are scored by the statistics of no words; null and repeated ids are scored like any other row. Only
    numbers reach Python; a text never leaves the row that it is in.
    """
    forest = model if model is not None else grow(*training_sample(docs, labels, id_col, text_col))
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, batch.num_columns)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(sent.value.scores(x), 6))], ["doc_id", "score"])

    told = statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")), "doc_id", "t")
    scored = told.select("doc_id", *[f.cast("double").alias(k) for k, f in feature_columns().items()]).mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
