"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

The network reads windows of words. A word's input is its own vector, if it is in the vocabulary of the training
sample, plus the mean of its character-trigram vectors, so that unseen spellings still say something. All
overlapping windows of a whole text are scored; a logistic layer over their greatest and mean logits, fitted on
training rows that the network did not see, turns them into the score of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm import rnn
from notewright.llm.common import crc_fold, one_blas_thread, text_bytes

#: Labelled rows that the model is fitted on, of each class at most: a bound, whatever the input's size.
SAMPLE_PER_CLASS = {1: 1500, 0: 2500}
WINDOW, STRIDE = 40, 28
#: Bytes of a word that are one step of a window; what is longer takes several steps.
PIECE = 64
WIDTH, HIDDEN, GRAMS = 12, 10, 1 << 12
LEAST_DOCS = 8
EPOCHS, BATCH, RATE = 3, 256, 0.01
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
FLUSH_WORDS = 60_000
CACHE_WORDS = 120_000
#: All windows of a training text are learned from; those of one with more than this weigh as much as so many.
TEXT_WEIGHT = 24
_EDGES = b"\"'`()[]{}<>.,;:!?*#$%&|-_"


def gram_bags(words: list[bytes], n_grams: int = GRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed character trigrams of each word with a mark at both ends: flat ids, owners, counts."""
    flat = np.frombuffer(b"".join(b"\x02" + w + b"\x03" for w in words), np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(sizes)
    h = np.zeros(len(flat), np.uint32)
    h[:-2] = (flat[:-2] * np.uint32(0x01000193)) ^ (flat[1:-1] * np.uint32(0x9E3779B1)) ^ (flat[2:] * np.uint32(0x85EBCA6B))
    h ^= h >> np.uint32(15)
    whole = np.ones(len(flat), bool)
    whole[ends - 1] = False
    whole[ends - 2] = False
    owner = np.repeat(np.arange(len(words)), sizes)
    return (h[whole] % np.uint32(n_grams)).astype(np.int64), owner[whole], np.maximum(sizes - 2, 0)


def window_starts(n: int) -> np.ndarray:
    """Starts of overlapping windows that cover all ``n`` words; one window even for an empty text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.concatenate((np.arange(0, n - WINDOW, STRIDE), [n - WINDOW]))


def bare(word: bytes) -> bytes:
    return (word.strip(_EDGES) or word).lower()


def words_of_text(text: bytes) -> list[bytes]:
    """Words of a text; longer ones are cut into pieces of PIECE bytes that share two, so no trigram is lost."""
    words = text.split()
    if not words or max(map(len, words)) <= PIECE:
        return words
    out = []
    for word in words:
        if len(word) > PIECE:
            core = bare(word)
            out.extend(core[at : at + PIECE] for at in range(0, max(1, len(core) - 2), PIECE - 2))
        else:
            out.append(word)
    return out


@dataclass
class Model:
    params: rnn.Params
    vocab: dict[bytes, int]
    final: np.ndarray = field(default_factory=lambda: np.zeros(5))
    base: float = 0.0

    def projections(self, words: list[bytes]) -> np.ndarray:
        """(words, 2, 3*hidden): each word's input, already multiplied by the input weights."""
        p = self.params
        ids = np.fromiter((self.vocab.get(w, 0) for w in words), np.int64, len(words))
        grams, owner, count = gram_bags(words)
        x = p["words"][ids]
        starts = np.cumsum(count) - count
        some = count > 0
        if some.any():
            sums = np.add.reduceat(p["grams"][grams], starts[some], axis=0)
            x[some] += sums / count[some, None]
        return (np.einsum("vd,sdk->vsk", x, p["W"], optimize=True) + p["b"][:, 0][None]).astype(np.float32)


class Scorer:
    """Scores texts with a table of the words met so far; row zero is no word."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        scorer = self

        class Rows(dict):
            def __missing__(self, word: bytes) -> int:
                scorer.fresh.append(bare(word))
                self[word] = at = len(self) + 1
                return at

        self.fresh: list[bytes] = []
        self.rows = Rows()
        self.table = np.zeros((1024, 2, self.model.params["W"].shape[2]), np.float32)
        self.filled = 1

    def _fill(self) -> None:
        if not self.fresh:
            return
        need = self.filled + len(self.fresh)
        if need > len(self.table):
            grown = np.zeros((max(need, 2 * len(self.table)), *self.table.shape[1:]), np.float32)
            grown[: self.filled] = self.table[: self.filled]
            self.table = grown
        for at in range(0, len(self.fresh), 20_000):
            part = self.fresh[at : at + 20_000]
            self.table[self.filled + at : self.filled + at + len(part)] = self.model.projections(part)
        self.filled = need
        self.fresh = []

    def window_logits(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(logits of all windows, number of windows of each text)."""
        self._fill()
        begins = [window_starts(len(t)) for t in texts]
        counts = np.fromiter(map(len, begins), np.int64, len(begins))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = np.concatenate([*texts, np.zeros(WINDOW, np.int64)])
        offset = np.cumsum(lengths) - lengths
        start = np.concatenate(begins)
        end = np.repeat(lengths, counts) - start
        place = np.arange(WINDOW)
        present = place[None] < end[:, None]
        ids = np.where(present, flat[(np.repeat(offset, counts) + start)[:, None] + place[None]], 0)
        out = np.empty(len(start), np.float32)
        order = np.argsort(end, kind="stable")
        for at in range(0, len(order), 1500):
            part = order[at : at + 1500]
            steps = max(1, min(WINDOW, int(end[part].max())))
            states, _ = rnn.run_steps(self.model.params, rnn.both_ways(ids[part, :steps], self.table), rnn.both_masks(present[part, :steps]))
            out[part] = rnn.pool(self.model.params, states, present[part, :steps].T)[0]
        return out, counts

    def features(self, texts: list[np.ndarray]) -> np.ndarray:
        logits, counts = self.window_logits(texts)
        starts = np.cumsum(counts) - counts
        top, total = np.maximum.reduceat(logits, starts), np.add.reduceat(logits, starts)
        hits = np.add.reduceat((logits > 0).astype(np.float64), starts)
        return np.stack((np.ones(len(texts)), top, total / counts, hits / counts, np.log(counts)), axis=1).astype(np.float64)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return rnn.sigmoid(self.features(texts) @ self.model.final)

    def encode(self, text: bytes) -> np.ndarray:
        words = words_of_text(text)
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = rnn.sigmoid(x @ beta)
        grad = x.T @ (weight * (p - y)) + ridge * beta
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(rows: list[tuple[bytes, int]], class_counts: dict[int, int], seed: int = 7) -> Model:
    """Fit on (text, label) rows; every fourth row is kept from the network for the logistic layer.

    Rows are weighted so that the classes have the shares of ``class_counts``. Without both classes the model
    gives the share of label 1, or a half if there are no rows at all.
    """
    one_blas_thread()
    rng = np.random.default_rng(seed)
    total = sum(class_counts.values())
    have = {c: sum(y == c for _, y in rows) for c in (0, 1)}
    if not have[0] or not have[1] or len(rows) < 8:
        share = (class_counts.get(1, 0) + 1) / (total + 2)
        model = Model(rnn.new_params(1, GRAMS, WIDTH, HIDDEN, seed), {})
        model.params["w"][:] = 0
        model.final = np.array([np.log(share / (1 - share)), 0, 0, 0, 0])
        return model
    # words become numbers as they are read: a list of all tokens would be most of the driver's memory
    met: dict[bytes, int] = {}
    coded = [np.fromiter((met.setdefault(bare(w), len(met)) for w in words_of_text(t)), np.int32) for t, _ in rows]
    texts_with = np.zeros(len(met), np.int64)
    for numbers in coded:
        texts_with[np.unique(numbers)] += 1
    every = sorted(met)
    vocab = {w: i + 1 for i, w in enumerate(w for w in every if texts_with[met[w]] >= LEAST_DOCS)}
    place_of = np.empty(len(met), np.int32)
    place_of[[met[w] for w in every]] = np.arange(1, len(every) + 1, dtype=np.int32)
    coded = [place_of[numbers] for numbers in coded]
    del met
    word_ids = np.array([0, *[vocab.get(w, 0) for w in every]], np.int64)
    grams, owner, count = gram_bags(every)
    begin = np.cumsum(count) - count
    model = Model(rnn.new_params(len(vocab) + 1, GRAMS, WIDTH, HIDDEN, seed), vocab)
    learn = [i for i in range(len(rows)) if i % 4]
    weight_of = {c: (class_counts[c] / total) / (have[c] / len(rows)) for c in (0, 1)}
    optimiser = rnn.Adam(model.params, RATE)
    place = np.arange(WINDOW)
    ids, present, label, weigh = [], [], [], []
    for i in learn:
        starts = window_starts(len(coded[i]))
        at = starts[:, None] + place[None]
        ok = at < len(coded[i])
        padded = np.concatenate((coded[i], np.zeros(WINDOW, np.int32)))
        ids.append(np.where(ok, padded[at], 0))
        present.append(ok)
        label.append(np.full(len(starts), rows[i][1], np.float32))
        weigh.append(np.full(len(starts), min(1.0, TEXT_WEIGHT / len(starts)), np.float32))
    ids_all, present_all, label_all, weight_all = map(np.concatenate, (ids, present, label, weigh))
    del ids, present, label, weigh, coded
    for epoch in range(EPOCHS):
        order = rng.permutation(len(ids_all))
        optimiser.rate = RATE * (1.0, 0.5, 0.2, 0.1)[min(epoch, 3)]
        for start in range(0, len(order), BATCH):
            part = order[start : start + BATCH]
            used, rows_of = np.unique(ids_all[part], return_inverse=True)
            real = used > 0
            n = np.where(real, count[np.maximum(used - 1, 0)], 0)
            flat = np.repeat(begin[np.maximum(used - 1, 0)] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            bag = (grams[flat], np.repeat(np.arange(len(used)), n), n)
            _, g = rnn.gradients(model.params, rows_of.reshape(len(part), WINDOW), bag, word_ids[used], present_all[part], label_all[part], weight_all[part])
            optimiser.step(model.params, g)
    rest = [i for i in range(len(rows)) if i % 4 == 0]
    scorer = Scorer(model)
    texts = [scorer.encode(rows[i][0]) for i in rest]
    y = np.array([rows[i][1] for i in rest], np.float64)
    w = np.array([weight_of[rows[i][1]] for i in rest])
    x = np.concatenate([scorer.features(texts[a : a + 200]) for a in range(0, len(texts), 200)])
    model.final = fit_logistic(x, y, w)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, folds: int, held_out: int, per_class: dict[int, int]) -> tuple[list[tuple[bytes, int]], dict[int, int]]:
    """A bounded sample of labelled texts outside the held-out fold, and the counts of all such labels by class."""
    usable = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("y")).where("__id is not null and y in (0, 1)")
    usable = usable.groupBy("__id").agg(F.max("y").alias("y")).where(crc_fold(F.col("__id"), folds) != held_out)
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y, n in per_class.items():
        part = usable.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most sum(per_class) ids: small enough to send to every task
    picked = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(chosen), "__id")
    rows = sorted((r["__id"], r["t"], r["y"]) for r in picked.collect())
    order = np.random.default_rng(3).permutation(len(rows))
    return [(rows[i][1].encode("utf-8", "replace"), rows[i][2]) for i in order], counts


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    The model is fitted on at most SAMPLE_PER_CLASS labelled rows of the folds other than the held-out one, or
    given. Null and empty texts are scored as one window without words. Ids that are null or repeated, equal rows and
    texts or words of any length are scored like any other; a label without a document or of another value is ignored,
    of several labels of one id the greatest counts. Other columns are not read; an empty table gives an empty result.
    Memory holds one batch and a bounded table of words.
    """
    if model is None:
        model = train(*training_rows(docs, labels, id_col, text_col, "toxic", FOLDS, HELD_OUT, SAMPLE_PER_CLASS))
    scorer = _batch_scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], ["doc_id", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = source.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _batch_scorer(docs: DataFrame, model: Model):
    """A maker of functions from a column of texts to their scores, rounded to six places."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(sent.value)

        def score(texts: pa.Array) -> np.ndarray:
            out, pending, n = [np.empty(0)], [], 0
            for text in text_bytes(texts):
                pending.append(scorer.encode(text))
                n += len(pending[-1])
                if n >= FLUSH_WORDS or len(pending) >= 2000:
                    out.append(scorer.scores(pending))
                    pending, n = [], 0
                    if scorer.filled > CACHE_WORDS:
                        scorer.clear()
            if pending:
                out.append(scorer.scores(pending))
            return np.round(np.concatenate(out), 6)

        return score

    return make


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored at the threshold or above, all columns kept, in one pass without a join.

    Every row, also one with a null id or text or one that repeats another, is judged by its own text, of any length;
    the other columns pass through, whatever their names. An empty table gives an empty result; without labels of both
    classes nothing can be learned, and all rows get the share of label 1 as their score.
    """
    model = train(*training_rows(docs, labels, id_col, text_col, "toxic", FOLDS, HELD_OUT, SAMPLE_PER_CLASS))
    scorer, at = _batch_scorer(docs, model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer()
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)
