"""LM scoring: a causal self-attention model in numpy over subword ids, scored in overlapping context windows.

Words are counted over all training texts; the counts give the unigram base and, through the tokenizer, the counts
of all subwords. Pairs of an input row and the subword after it are counted over all training texts too. The network's
weights begin with a bounded sample and then learn from every training text: each task takes one epoch of steps over
its texts, and the tasks' weights are averaged. Texts are turned into subwords once and kept. The network predicts the
class of the next subword: frequent ones are classes of their own, the rest share classes, inside which a subword has
its share of the corpus counts. So the probabilities of all subwords and the end add up to one. Its inputs are the last subword (a table of class log-frequencies after it) and what one
head of masked attention gathers from the window. Windows overlap, and each token is scored in the one where it has
the longest context. A word's probability is the product over its subwords, interpolated with its share of
the training tokens, by a weight fitted on texts that the network did not see.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import crc_fold, durable, ensure_checkpoint_dir, one_blas_thread, text_bytes
from notewright.llm.rnn import Adam

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD_OUT = 5, 1
#: Training texts that the network's weights begin with at most; all counts and the epoch cover all training texts.
TRAIN_DOCS = 4000
WINDOW, STRIDE = 32, 24
WIDTH = 16
#: Input rows and output classes: so many subwords of their own, then shared ones.
OWN_IN, SHARED_IN, OWN_OUT, SHARED_OUT = 1000, 24, 112, 15
#: The most frequent subwords, whose share of their class depends on the last input row too.
CLOSE = 2048
SHARE_PRIOR = 3.0
BATCH, RATE, STEPS = 96, 0.01, 1500
#: The rate of the epoch over all training texts: that of the last steps on the sample.
EPOCH_RATE = 0.1 * RATE
#: Words of at least this share of all training tokens are sent to the tasks with their counts: 1 / share words at
#: most. All others are looked up by a join.
HEAD_SHARE = 5e-7
CACHE_WORDS, FLUSH_WORDS = 350_000, 60_000
#: Bytes of stored subwords that a task reads at once.
READ_BYTES = 1_000_000
#: Windows scored at once: the buffers of more would not fit a core's cache.
CHUNK = 32


class Subwords:
    """A word's subword ids by a public SentencePiece model; a word that yields none is one unknown."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()

    def encode(self, words: list[bytes]) -> list[list[int]]:
        return [x or [0] for x in self.model.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)]


def _binary(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values``, ``lengths`` long, as binary values."""
    ends = np.append(0, np.cumsum(lengths * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def id_type(size: int) -> type:
    """The type of stored subwords: the end has the number ``size``."""
    return np.uint16 if size < 1 << 16 else np.uint32


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    """All texts as subwords, once, in the shared folder, and the words of the training texts with their counts.

    Rows of texts: doc_id, learn (a training text), t (lower-cased), ids (its subwords and an end), units (subwords of
    each word, one for the end). Rows of words, counted in each task: word and c."""
    spark = docs.sparkSession
    fields = ["doc_id", "learn", "t", "ids", "units", "word", "c"]
    kinds = [pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, {})
        end = encoder.tokenizer.size
        tally = np.zeros(0, np.int64)

        def counts() -> pa.RecordBatch:
            used = np.flatnonzero(tally)
            names = list(encoder.rows)
            words = [pa.array([names[i] for i in used.tolist()], pa.binary()), pa.array(tally[used])]
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(used), k) for k in kinds[:5]], *words], fields)

        for batch in batches:
            learn = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            lows = [t.lower() for t in text_bytes(batch.column(2))]
            texts, first, n = [], 0, 0
            for at, low in enumerate(lows, 1):
                texts.append(low.split())
                n += len(texts[-1])
                if n < FLUSH_WORDS and len(texts) < 2000 and at < batch.num_rows:
                    continue
                lengths = np.fromiter(map(len, texts), np.int64, len(texts))
                words = encoder.encode(list(chain.from_iterable(texts)))
                ids, sizes, units = encoder.with_ends(words, lengths, end)
                more = np.bincount(words[np.repeat(learn[first:at], lengths)], minlength=len(encoder.rows))
                more[: len(tally)] += tally
                tally = more
                own = [batch.column(0).slice(first, len(texts)), batch.column(1).slice(first, len(texts)), pa.array(lows[first:at], pa.binary())]
                kept = [_binary(ids.astype(id_type(end)), sizes), _binary(units.astype(np.uint32), lengths + 1)]
                yield pa.RecordBatch.from_arrays([*own, *kept, *[pa.nulls(len(texts), k) for k in kinds[5:]]], fields)
                texts, first, n = [], at, 0
                if len(encoder.rows) > CACHE_WORDS:
                    yield counts()
                    encoder.clear()
                    tally = np.zeros(0, np.int64)
        yield counts()

    learn = F.coalesce(crc_fold(F.col(id_col), FOLDS) != HELD_OUT, F.lit(False))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), learn.alias("learn"), F.col(text_col).cast("string").alias("t"))
    place = f"{ensure_checkpoint_dir(spark)}/texts-{uuid.uuid4().hex}"
    source.mapInArrow(run, "doc_id long, learn boolean, t binary, ids binary, units binary, word binary, c long").write.parquet(place)
    return spark.read.parquet(place)


def slices(batch: pa.RecordBatch, column: int, most: int = READ_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch whose values in a binary column are ``most`` bytes, or one row."""
    sizes = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        past = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, past + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def stored(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of a stored column as int64, how many there are in each row)."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), kind).astype(np.int64), np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize


def subword_counts(words: DataFrame, path: str) -> np.ndarray:
    """Counts of all subwords in the training texts, from the word counts: as long as the tokenizer's vocabulary."""
    size = Subwords(path).size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, total = Subwords(path), np.zeros(size, np.int64)
        for batch in batches:
            ids = tokenizer.encode(batch.column(0).to_pylist())
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
            np.add.at(total, flat, np.repeat(batch.column(1).to_numpy(), n))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in words.mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    return counts


@dataclass
class Attention:
    """``rows``: subword to input row; ``klass``: subword to output class; ``close``: subword to a column of
    ``share``, which holds log10 of its share of its class after each input row. The last column is for all other
    subwords, whose share ``far`` doesn't depend on the row but for a factor in that column. The last subword id is
    the end of a text; the last input row its beginning."""

    rows: np.ndarray
    klass: np.ndarray
    close: np.ndarray
    share: np.ndarray
    far: np.ndarray
    after: np.ndarray
    weights: dict[str, np.ndarray]

    def prepare(self) -> None:
        """Tables for scoring: query, key, value and a one, so that attention's weights add up in the same product."""
        w = self.weights
        join = np.concatenate((w["q"] * np.float32(WIDTH**-0.5), w["k"], w["v"]), axis=1)
        one, none = np.ones((len(w["e"]), 1), np.float32), np.zeros((WINDOW, 1), np.float32)
        self.token = np.concatenate((w["e"] @ join, one), axis=1).astype(np.float32)
        self.place = np.concatenate((w["p"] @ join, none), axis=1).astype(np.float32)
        self.past = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.base = (self.after + w["b"]).astype(np.float32)
        self.factor = np.exp(np.clip(self.base, -80.0, 80.0))
        self.buffers = np.empty((2, CHUNK * WINDOW, self.base.shape[1]), np.float32)
        # no exponent can overflow below these bounds; only beyond them are the exponents cut
        reach = np.abs(self.token).max(axis=0) + np.abs(self.place).max(axis=0)
        q, k, v = reach[:WIDTH], reach[WIDTH : 2 * WIDTH], reach[2 * WIDTH : 3 * WIDTH]
        self.cut_scores = float(q @ k) > 60
        self.cut_logits = float(np.abs(self.base).max() + (v @ np.abs(w["o"])).max()) > 80

    def attend(self, rows: np.ndarray) -> np.ndarray:
        """(windows, steps, WIDTH + 1): what each position gathers from itself and those before it, and its weight."""
        x = self.token[rows]
        x += self.place
        q, k, v = x[..., :WIDTH], x[..., WIDTH : 2 * WIDTH], x[..., 2 * WIDTH :]
        s = np.matmul(q, k.transpose(0, 2, 1))
        if self.cut_scores:
            np.clip(s, -30.0, 30.0, out=s)
        np.exp(s, out=s)
        s *= self.past
        return np.matmul(s, v)

    def log10_class(self, rows: np.ndarray, gathered: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 probability of each target class after input row and gathered context, all flat."""
        n = len(target)
        logits, factor = self.buffers[0, :n], self.buffers[1, :n]
        np.matmul(gathered[:, :WIDTH] / gathered[:, WIDTH:], self.weights["o"], out=logits)
        if self.cut_logits:
            logits += self.base[rows]
            np.clip(logits, -60.0, 60.0, out=logits)
            hit = logits[np.arange(n), target]
            factor[:] = 1
        else:
            hit = logits[np.arange(n), target] + self.base[rows, target]
            np.take(self.factor, rows, axis=0, out=factor, mode="clip")
        total = np.einsum("ij,ij->i", np.exp(logits, out=logits), factor)
        return (hit - np.log(total)) * np.float32(1 / np.log(10))


def window_grid(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, first scored place) of the windows over texts of so many predictions, each scored once."""
    more = np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    n = 1 + more
    text = np.repeat(np.arange(len(lengths)), n)
    turn = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return text, turn * STRIDE, np.where(turn == 0, 0, WINDOW - STRIDE)


def subword_logs(model: Attention, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each subword; ``ids``: subwords of all texts, each with its end; ``lengths`` with the end."""
    offset = np.cumsum(lengths) - lengths
    rows = np.empty(len(ids), np.int64)
    rows[1:] = model.rows[ids[:-1]]
    rows[offset] = len(model.after) - 1
    klass = model.klass[ids]
    logs = model.share[rows, model.close[ids]] + model.far[ids]
    rows, klass = np.concatenate((rows, np.zeros(WINDOW, np.int64))), np.concatenate((klass, np.zeros(WINDOW, np.int64)))
    text, start, first = window_grid(lengths)
    place = np.arange(WINDOW)
    for at in range(0, len(text), CHUNK):
        part = slice(at, at + CHUNK)
        spot = (offset[text[part]] + start[part])[:, None] + place
        here = rows[spot]
        wanted = (place >= first[part, None]) & (start[part, None] + place < lengths[text[part], None])
        scored = spot[wanted]
        logs[scored] += model.log10_class(here[wanted], model.attend(here)[wanted], klass[scored])
    return logs


def mixed_logs(words: np.ndarray, log_share: np.ndarray, mix: float) -> np.ndarray:
    """log10 of (1 - mix) times a word's probability by the network plus mix times its share of the training tokens.

    ``log_share`` is not a number where the share is not at hand: it is left out, which only lowers the result."""
    net = words + np.log10(1 - mix)
    uni = np.where(np.isnan(log_share), -1e9, log_share + np.log10(mix))
    gap = np.abs(net - uni)
    gap *= -np.log(10)
    np.exp(gap, out=gap)
    np.log1p(gap, out=gap)
    gap *= 1 / np.log(10)
    return np.maximum(net, uni) + gap


def fit_mix(words: np.ndarray, log_share: np.ndarray, rounds: int = 20) -> float:
    """The mixing weight of greatest likelihood over some words, by expectation-maximisation, within 0.01 and 0.9."""
    if not len(words):
        return 0.1
    uni = np.where(np.isnan(log_share), 0.0, 10.0**log_share)
    net, mix = 10.0**words, 0.3
    for _ in range(rounds):
        mix = float(np.clip((mix * uni / (mix * uni + (1 - mix) * net + 1e-300)).mean(), 0.01, 0.9))
    return mix


@dataclass
class Layout:
    """Where subwords stand in the tables, by the corpus counts: ``rows``, ``klass`` and ``close`` of ``Attention``."""

    rows: np.ndarray
    klass: np.ndarray
    close: np.ndarray
    column_class: np.ndarray
    full: np.ndarray
    n_rows: int
    n_classes: int

    @property
    def width(self) -> int:
        return len(self.column_class)

    def cells(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The flat (input row, close column) cell of each subword; ``ids`` and ``lengths`` as in ``subword_logs``."""
        before = np.empty(len(ids), np.int64)
        before[1:] = self.rows[ids[:-1]]
        before[np.cumsum(lengths) - lengths] = self.n_rows - 1
        return before * self.width + self.close[ids]

    def count(self, texts: list[np.ndarray]) -> np.ndarray:
        """How often each cell occurs in some texts."""
        if not texts:
            return np.zeros(self.n_rows * self.width, np.int64)
        ids, lengths = np.concatenate(texts), np.fromiter(map(len, texts), np.int64, len(texts))
        return np.bincount(self.cells(ids, lengths), minlength=self.n_rows * self.width)

    def tables(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share, far, after) of ``Attention`` from the counts of all cells."""
        cells = cells.reshape(self.n_rows, self.width).astype(np.float64)
        unigram = np.bincount(self.klass, self.full, self.n_classes)
        unigram /= unigram.sum()
        column_mass = np.bincount(self.close, self.full, self.width)
        column_prior = column_mass / np.maximum(unigram[self.column_class] * self.full.sum(), 1e-9)
        member = np.zeros((self.width, self.n_classes))
        member[np.arange(self.width), self.column_class] = 1
        pair = cells @ member
        share = (cells + SHARE_PRIOR * column_prior) / (pair[:, self.column_class] + SHARE_PRIOR)
        share = np.log10(np.maximum(share, 1e-30)).astype(np.float32)
        far = np.log10(self.full / column_mass[self.close]).astype(np.float32)
        after = np.log((pair + 20 * unigram) / (pair.sum(axis=1, keepdims=True) + 20)).astype(np.float32)
        return share, far, after


def layout_of(counts: np.ndarray, n_ends: int) -> Layout:
    size = len(counts)
    full = np.append(counts, n_ends).astype(np.float64) + 0.5
    order = np.argsort(-full[:size], kind="stable")
    rows = np.empty(size + 1, np.int64)
    rows[order[:OWN_IN]] = np.arange(min(OWN_IN, size))
    rows[order[OWN_IN:]] = OWN_IN + np.arange(max(0, size - OWN_IN)) % SHARED_IN
    rows[size] = OWN_IN + SHARED_IN
    klass = np.empty(size + 1, np.int64)
    klass[order[:OWN_OUT]] = np.arange(min(OWN_OUT, size))
    rest = order[OWN_OUT:]
    mass = np.cumsum(full[rest])
    klass[rest] = OWN_OUT + np.minimum(SHARED_OUT - 1, (mass / mass[-1] * SHARED_OUT).astype(np.int64)) if len(rest) else []
    n_classes = OWN_OUT + SHARED_OUT + 1
    klass[size] = n_classes - 1
    # columns of the share table, one more for all far subwords of each shared class
    near = order[:CLOSE]
    close = CLOSE + klass
    close[near] = np.arange(len(near))
    close[size] = CLOSE + n_classes - 1
    column_class = np.concatenate((klass[near], np.zeros(CLOSE - len(near), np.int64), np.arange(n_classes)))
    return Layout(rows, klass, close, column_class, full, OWN_IN + SHARED_IN + 1, n_classes)


def pair_counts(learn: DataFrame, layout: Layout) -> np.ndarray:
    """Counts of all cells of ``layout`` in the stored subwords of all training texts: as long as the table, whatever the
    input's size."""
    sent = learn.sparkSession.sparkContext.broadcast(layout)
    size, kind = layout.n_rows * layout.width, id_type(len(layout.rows) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, total = sent.value, np.zeros(size, np.int64)
        for part in chain.from_iterable(slices(b, 0) for b in batches):
            np.add.at(total, layout.cells(*stored(part.column(0), kind)), 1)
        used = np.flatnonzero(total)
        for at in range(0, len(used), 50_000):
            part = used[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["cell", "n"])

    found = learn.select("ids").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(size, np.int64)
    cells[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return cells


#: What positions may not look at, as summands of their scores.
FUTURE = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)


def gradients(w: dict[str, np.ndarray], after: np.ndarray, r: np.ndarray, y: np.ndarray, ok: np.ndarray, room: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """The gradient of the mean negative log probability of the classes ``y[ok]`` after windows of input rows ``r``.
    ``room``: two buffers of a row a prediction and a column a class. Exponents are cut at 80."""
    x = w["e"][r]
    x += w["p"]
    flat_x = x.reshape(-1, WIDTH)
    q, k, v = (np.matmul(flat_x, w[name]).reshape(x.shape) for name in "qkv")
    scale = np.float32(WIDTH**-0.5)
    q *= scale
    a = np.matmul(q, k.transpose(0, 2, 1))
    a += FUTURE
    np.exp(np.minimum(a, 80.0, out=a), out=a)
    a *= 1 / np.matmul(a, np.ones((WINDOW, 1), np.float32))
    u = np.matmul(a, v)
    flat, here = u[ok], r[ok]
    n = len(flat)
    prob, base = np.empty((2, n, w["o"].shape[1]), np.float32) if room is None else room[:, :n]
    np.matmul(flat, w["o"], out=prob)
    prob += np.take(after, here, axis=0, out=base, mode="clip")
    prob += w["b"]
    np.exp(np.minimum(prob, 80.0, out=prob), out=prob)
    prob *= 1 / (np.float32(n) * np.matmul(prob, np.ones((prob.shape[1], 1), np.float32)))
    prob[np.arange(n), y[ok]] -= np.float32(1 / n)
    g = {"o": np.matmul(flat.T, prob), "b": np.matmul(np.ones((1, n), np.float32), prob)}
    du = np.zeros_like(u)
    du[ok] = np.matmul(prob, w["o"].T)
    da = np.matmul(du, v.transpose(0, 2, 1))
    dv = np.matmul(a.transpose(0, 2, 1), du)
    da -= np.einsum("nij,nij->ni", da, a)[..., None]
    da *= a
    dq, dk = np.matmul(da, k), np.matmul(da.transpose(0, 2, 1), q)
    dq *= scale
    dx = np.zeros_like(flat_x)
    for name, d in (("q", dq), ("k", dk), ("v", dv)):
        flat_d = d.reshape(-1, WIDTH)
        g[name] = np.matmul(flat_x.T, flat_d)
        dx += np.matmul(flat_d, w[name].T)
    spots = (r.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel()
    g["e"] = np.bincount(spots, dx.ravel(), w["e"].size).reshape(w["e"].shape).astype(np.float32)
    g["p"] = dx.reshape(x.shape).sum(axis=0)
    return g


def epoch(w: dict[str, np.ndarray], layout: Layout, after: np.ndarray, parts: Iterator[tuple[np.ndarray, np.ndarray]], rate: float = EPOCH_RATE) -> int:
    """One epoch of steps on ``w`` over the texts of ``parts`` (``ids`` and ``lengths`` as in ``subword_logs``): every
    subword and end is predicted once, in the window where it is scored. Gives the number of windows."""
    optimiser, place, seen = Adam(w, rate, decay=0.0), np.arange(WINDOW), 0
    rng, room = np.random.default_rng(7), np.empty((2, BATCH * WINDOW, layout.n_classes), np.float32)
    for ids, lengths in parts:
        offset = np.cumsum(lengths) - lengths
        ids = np.concatenate((ids, np.zeros(WINDOW, np.int64)))
        before = np.empty(len(ids), np.int64)
        before[1:] = layout.rows[ids[:-1]]
        before[offset] = layout.n_rows - 1
        text, start, first = window_grid(lengths)
        order = rng.permutation(len(text))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            spot = (offset[text[part]] + start[part])[:, None] + place
            ok = (place >= first[part, None]) & (start[part, None] + place < lengths[text[part], None])
            optimiser.step(w, gradients(w, after, before[spot], layout.klass[ids[spot]], ok, room))
        seen += len(text)
    return seen


def learn_all(learn: DataFrame, model: Attention, layout: Layout) -> Attention:
    """``model`` after an epoch over all training texts: each task goes over its own from the model's weights, the
    tasks' weights are averaged by their windows. What reaches the driver is as long as the weights."""
    sent = learn.sparkSession.sparkContext.broadcast((model.weights, model.after, layout))
    names, kind = list(model.weights), id_type(len(layout.rows) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, after, layout = sent.value
        w = {name: weights[name].copy() for name in names}
        seen = epoch(w, layout, after, (stored(part.column(0), kind) for b in batches for part in slices(b, 0)))
        if seen:
            flat = np.append(np.concatenate([w[name].ravel() for name in names]).astype(np.float64), 1.0) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "x"])

    found = learn.select("ids").mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    if not found.num_rows:
        return model
    flat = np.empty(found.num_rows)
    flat[found.column("i").to_numpy()] = found.column("x").to_numpy()
    flat, at, averaged = flat[:-1] / flat[-1], 0, {}
    for name in names:
        shape = model.weights[name].shape
        averaged[name] = flat[at : at + int(np.prod(shape))].reshape(shape).astype(np.float32)
        at += int(np.prod(shape))
    learned = replace(model, weights=averaged)
    learned.prepare()
    return learned


def fit(texts: list[np.ndarray], counts: np.ndarray, n_ends: int, seed: int = 5, steps: int = STEPS, cells: np.ndarray | None = None) -> Attention:
    """Classes from the corpus counts, tables from ``cells`` of the corpus (of ``texts`` if there are none), the
    network from the subwords of a bounded sample of training texts."""
    one_blas_thread()
    rng = np.random.default_rng(seed)
    layout = layout_of(counts, n_ends)
    rows, klass, close, n_rows, n_classes = layout.rows, layout.klass, layout.close, layout.n_rows, layout.n_classes
    share, far, after = layout.tables(layout.count(texts) if cells is None else cells)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    w = {
        "e": normal(n_rows, WIDTH, scale=0.3),
        "p": normal(WINDOW, WIDTH, scale=0.1),
        "q": normal(WIDTH, WIDTH, scale=0.25),
        "k": normal(WIDTH, WIDTH, scale=0.25),
        "v": normal(WIDTH, WIDTH, scale=0.25),
        "o": normal(WIDTH, n_classes, scale=0.05),
        "b": np.zeros((1, n_classes), np.float32),
    }
    model = Attention(rows, klass, close, share, far, after, w)
    lengths = np.array([len(t) for t in texts], np.int64)
    if not len(lengths):
        model.prepare()
        return model
    ids = np.concatenate([*texts, np.zeros(WINDOW, np.int64)])
    offset = np.cumsum(lengths) - lengths
    before = np.empty(len(ids), np.int64)
    before[1:] = rows[ids[:-1]]
    before[offset] = n_rows - 1
    text, start, _ = window_grid(lengths)
    place = np.arange(WINDOW)
    optimiser = Adam(w, RATE, decay=0.0)
    for step in range(steps):
        optimiser.rate = RATE * (1.0 if step < steps * 0.6 else 0.3 if step < steps * 0.85 else 0.1)
        part = rng.integers(0, len(text), BATCH)
        spot = (offset[text[part]] + start[part])[:, None] + place
        ok = start[part, None] + place < lengths[text[part], None]
        r, y = before[spot], klass[ids[spot]]
        optimiser.step(w, gradients(w, after, r, y, ok))
    model.prepare()
    return model


class Encoder:
    """Words met so far: their subwords, flat, and their count if they are head words, or else no number."""

    def __init__(self, path: str, head: dict[bytes, int]) -> None:
        self.tokenizer, self.head = Subwords(path), head
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.flat = np.empty(0, np.int32)
        self.begin, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.count = np.empty(0)

    def encode(self, words: list[bytes]) -> np.ndarray:
        """The numbers of the words; new ones are added at once."""
        found = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            absent = [words[i] for i in missing.tolist()]
            fresh = list(dict.fromkeys(absent))
            self.rows.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh))))
            found[missing] = np.fromiter(map(self.rows.__getitem__, absent), np.int64, len(absent))
            self._add(fresh)
        return found

    def _add(self, fresh: list[bytes]) -> None:
        ids = self.tokenizer.encode(fresh)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        new = np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))
        counts = np.fromiter(map(self.head.get, fresh, repeat(-1)), np.float64, len(ids))
        self.begin = np.concatenate((self.begin, len(self.flat) + np.cumsum(n) - n))
        self.flat, self.size = np.concatenate((self.flat, new)), np.concatenate((self.size, n))
        self.count = np.concatenate((self.count, np.where(counts < 0, np.nan, counts)))

    def subwords(self, words: np.ndarray) -> np.ndarray:
        n = self.size[words]
        return self.flat[np.repeat(self.begin[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def with_ends(self, words: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(subwords with an end after each text, their number in each text, and in each word or end)."""
        owner = np.repeat(np.arange(len(lengths)), lengths)
        sizes = np.bincount(owner, self.size[words], len(lengths)).astype(np.int64) + 1
        spots = np.cumsum(sizes) - 1
        ids = np.full(int(sizes.sum()), end, np.int64)
        keep = np.ones(len(ids), bool)
        keep[spots] = False
        ids[keep] = self.subwords(words)
        units = np.ones(len(words) + len(lengths), np.int64)
        units[np.arange(len(words)) + owner] = self.size[words]
        return ids, sizes, units


def _all_counts(words: DataFrame, encoder: Encoder, flat: np.ndarray) -> np.ndarray:
    """Counts of the words of a bounded sample, those outside the head list looked up in the table of all counts."""
    counts = encoder.count.copy()
    numbers = np.unique(flat)
    wanted = set(numbers[np.isnan(counts[numbers])].tolist())
    lacking = {w: i for w, i in encoder.rows.items() if i in wanted}
    if lacking:
        names = words.sparkSession.createDataFrame([(bytearray(w),) for w in lacking], "word binary")
        for r in words.join(F.broadcast(names), "word").collect():
            counts[lacking[bytes(r["word"])]] = r["c"]
    return np.nan_to_num(counts[flat], nan=0.0)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the text, A to Z lower-cased, and one end; null and empty texts are just an end. The
    base and all counts come from every text outside the held-out fold; a null id counts as held out. Repeated rows
    each get their row. Texts are scored whole. Without any training text all subwords are alike, and N is zero.
    Other columns, whatever their names, are not read; an empty table gives an empty result. The network's weights begin
    with ``train_docs`` training texts at most, those of least hashed id, and learn from all of them after that; the
    counts cover all as well. The mixing weight, one number, is found on a tenth of the first ones. ``tokenizer``
    is a file that the driver and every executor can read.
    Frequent words find their counts in the task, a bounded list; each occurrence of another word is
    joined with the counts, so that the count table may be of any size. It carries the network's logarithm with it, so
    that each word is interpolated with its count wherever that is found. No such word is frequent in the training texts.
    """
    texts = encoded(docs, id_col, text_col, tokenizer)
    words = durable(texts.where("word is not null").groupBy("word").agg(F.sum("c").alias("c")))
    known = texts.where("word is null and learn")
    ends = known.count()
    row = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = row["n"] + ends, row["v"] + (ends > 0)
    head = {bytes(r["word"]): r["c"] for r in words.where(F.col("c") >= max(1.0, HEAD_SHARE * total)).collect()}
    counts = subword_counts(words, tokenizer)
    encoder = Encoder(tokenizer, head)
    sample: list[np.ndarray] = []
    training = docs.where(crc_fold(F.col(id_col), FOLDS) != HELD_OUT)
    picked = training.select(F.col(id_col).cast("long").alias("i")).distinct().orderBy(F.xxhash64("i"), "i").limit(train_docs)
    chosen = training.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).join(F.broadcast(picked), "i")
    for r in sorted(chosen.collect()):
        sample.append(encoder.encode(r["t"].encode("utf-8", "replace").lower().split()))
    # one text in ten only finds the mixing weight, by counts without one occurrence of its own
    held, learned = sample[::10], [x for i, x in enumerate(sample) if i % 10]
    layout = layout_of(counts, ends)
    cells = pair_counts(known, layout)
    learned = [np.append(encoder.subwords(x), len(counts)) for x in learned]
    begun = fit(learned, counts, ends, cells=cells)
    model = learn_all(known, begun, layout)
    mix = 0.1
    if held:
        flat, lengths = np.concatenate(held), np.fromiter(map(len, held), np.int64, len(held))
        ids, sizes, units = encoder.with_ends(flat, lengths, len(counts))
        # the weights before the epoch, which these texts are part of, over the pairs of all other texts
        others = cells - np.bincount(layout.cells(ids, sizes), minlength=len(cells))
        share, far, after = layout.tables(others)
        apart = replace(begun, share=share, far=far, after=after)
        apart.prepare()
        by_word = np.add.reduceat(subword_logs(apart, ids, sizes).astype(np.float64), np.cumsum(units) - units)
        real = np.ones(len(units), bool)
        real[np.cumsum(lengths + 1) - 1] = False
        rest = np.maximum(_all_counts(words, encoder, flat) - 1, 0)
        with np.errstate(divide="ignore"):
            mix = fit_mix(by_word[real], np.log10(rest / max(1, total)))
    sent = docs.sparkSession.sparkContext.broadcast((model, head))
    log_den = float(np.log10(total + 0.5 * (distinct + 1)))
    end_log = float(np.log10(ends + 0.5))
    end_share = float(np.log10(ends / total)) if ends else float("nan")
    kind = id_type(len(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, head = sent.value
        serial = TaskContext.get().partitionId() << 36

        def score(part: pa.RecordBatch) -> pa.RecordBatch:
            every = list(chain.from_iterable(t.split() for t in part.column(1).to_pylist()))
            ids, sizes = stored(part.column(2), kind)
            units, n = stored(part.column(3), np.uint32)
            n -= 1
            counted = np.fromiter(map(head.get, every, repeat(-1)), np.float64, len(every))
            tail = counted < 0
            counted[tail] = np.nan
            owner = np.repeat(np.arange(len(n)), n)
            base = np.bincount(owner, np.where(tail, 0.0, np.log10(counted + 0.5)), len(n)) + end_log
            known = np.bincount(owner, ~tail, len(n)).astype(np.int64) + (ends > 0)
            by_word = np.add.reduceat(subword_logs(model, ids, sizes).astype(np.float64), np.cumsum(units) - units)
            log_share = np.full(len(units), end_share)
            log_share[np.arange(len(every)) + owner] = np.log10(np.maximum(counted, 1e-9) / max(1, total))
            mixed = mixed_logs(by_word, log_share, mix)
            # tail words are mixed after the join
            spots = (np.arange(len(every)) + owner)[tail]
            mixed[spots] = 0.0
            scores = np.add.reduceat(mixed, np.cumsum(n + 1) - (n + 1))
            # each occurrence of a tail word in a text with the network's logarithm of it
            words = pa.array([every[i] for i in np.flatnonzero(tail).tolist()], pa.binary())
            offsets = np.append(0, np.cumsum(np.bincount(owner[tail], minlength=len(n))))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([words, pa.array(by_word[spots])], ["word", "net"]))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(serial, serial + len(n))), part.column(0), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(scores), lists],
                ["row", "doc_id", "n_tokens", "known", "base", "score", "tail"],
            )

        for part in chain.from_iterable(slices(b, 2) for b in batches):
            yield score(part)
            serial += part.num_rows

    source = texts.where("word is null").select("doc_id", "t", "ids", "units")
    scored = source.mapInArrow(run, "row long, doc_id long, n_tokens long, known long, base double, score double, tail array<struct<word:binary,net:double>>")
    own = ["doc_id", "n_tokens", "known", "base", "score"]
    spread = scored.select("row", *own, F.posexplode_outer("tail").alias("pos", "x"))
    once = [F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(c)).alias(c) for c in own]
    # a text without tail words joins with nothing, by a key of its own: no word has a space
    nothing = F.concat(F.lit(" "), F.col("row").cast("string")).cast("binary")
    flat = spread.select("row", *once, F.coalesce("x.word", nothing).alias("word"), F.col("x.net").alias("net"))
    joined = flat.join(words, "word", "left")
    seen, lone = F.col("c").isNotNull(), F.col("net").isNull()
    uni = F.log10(F.col("c") / F.lit(float(max(1, total)))) + F.lit(float(np.log10(mix)))
    net = F.col("net") + F.lit(float(np.log10(1 - mix)))
    tail_score = F.when(seen, F.greatest(net, uni) + F.log10(F.lit(1.0) + F.pow(F.lit(10.0), -F.abs(net - uni)))).otherwise(net)
    per_row = joined.groupBy("row").agg(
        *[F.max(c).alias(c) for c in own],
        F.count("c").alias("more"),
        F.coalesce(F.sum(F.when(~lone, F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)))), F.lit(0.0)).alias("tail_base"),
        F.coalesce(F.sum(tail_score), F.lit(0.0)).alias("tail_score"),
    )
    held = F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True))
    return per_row.select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("more")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_base") - F.col("n_tokens") * F.lit(log_den)).alias("base_score"),
        (F.col("score") + F.col("tail_score")).alias("score"),
    )
