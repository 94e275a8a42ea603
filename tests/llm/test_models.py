import math
import zlib
from collections import Counter

import numpy as np
import pytest

from notewright.llm import language_model as lm
from notewright.llm import rnn, toxicity


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in rnn.new_params(5, 20, 4, 3, 1).items()}
    for v in p.values():
        v += rng.normal(scale=0.3, size=v.shape)
    rows = rng.integers(0, 4, (6, 5))
    present = np.arange(5)[None] < rng.integers(1, 6, 6)[:, None]
    grams, owner, count = rng.integers(0, 20, 8), np.sort(rng.integers(0, 4, 8)), None
    count = np.bincount(owner, minlength=4)
    args = (rows, (grams, owner, count), np.array([0, 1, 2, 3]), present, rng.integers(0, 2, 6).astype(float), rng.random(6))
    _, g = rnn.gradients(p, *args)
    for k in p:
        flat = p[k].ravel()
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            old, eps = flat[i], 1e-2
            flat[i] = old + eps
            up = rnn.gradients(p, *args)[0]
            flat[i] = old - eps
            down = rnn.gradients(p, *args)[0]
            flat[i] = old
            assert g[k].ravel()[i] == pytest.approx((up - down) / (2 * eps), abs=3e-3), k


def test_windows_cover_every_word():
    for n in (0, 1, toxicity.WINDOW, toxicity.WINDOW + 1, 500):
        starts = toxicity.window_starts(n)
        assert {w for s in starts for w in range(s, min(n, s + toxicity.WINDOW))} == set(range(n)) and len(starts) >= 1


def test_toxicity_held_out_and_edges(spark, small):
    sf = small.replace("0.001", "0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels, "doc_id", "left_semi")
    rows, counts = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", 3, 1, toxicity.SAMPLE_PER_CLASS)
    model = toxicity.train(rows, counts)
    scored = toxicity.score_toxicity(docs, labels, model=model)
    held = scored.where("held_out").join(labels, "doc_id").collect()
    clean = [r for r in held if r["toxic"] == 0]
    bad = [r for r in held if r["toxic"] == 1]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored.collect())
    assert sum(r["predicted"] for r in clean) <= 0.03 * len(clean) and np.mean([r["score"] for r in bad]) > np.mean([r["score"] for r in clean]) + 0.3
    edge = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "x" * 100_000 + " y" * 5000, "c")], "doc_id long, text string, score string")
    out = toxicity.score_toxicity(edge, labels, model=model).collect()
    assert len(out) == 4 and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_toxicity(edge.limit(0), labels, model=model).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(edge, labels.limit(0)).collect()} == {0.5}
    whole = toxicity.Scorer(model)
    texts = [t for t, _ in rows[:40]]
    together = whole.scores([whole.encode(t) for t in texts])
    alone = [toxicity.Scorer(model) for _ in texts]
    assert np.allclose(together, [s.scores([s.encode(t)])[0] for s, t in zip(alone, texts)], atol=1e-4)


def test_each_token_once():
    for n in (1, 5, lm.WINDOW, lm.WINDOW + 1, 200):
        text, start, first = lm.window_grid(np.array([n, 3]))
        spots = Counter((int(t), int(s + i)) for t, s, f in zip(text, start, first) for i in range(f, lm.WINDOW) if s + i < (n, 3)[t])
        assert spots == Counter([(0, i) for i in range(n)] + [(1, i) for i in range(3)])


def test_probabilities_add_up_and_use_the_past_only():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 50, 3000)
    texts = [np.append(rng.integers(0, 3000, 60), 3000) for _ in range(20)]
    model = lm.fit(texts, counts, 20, steps=30)
    prefix = rng.integers(0, 3000, 9)
    ids = np.concatenate([np.append(prefix, x) for x in range(3001)])
    logs = lm.subword_logs(model, ids, np.full(3001, 10)).reshape(3001, 10)
    assert (10.0 ** logs[:, 9].astype(np.float64)).sum() == pytest.approx(1, abs=1e-3)
    assert np.allclose(logs[:, :9], logs[0, :9], atol=1e-4)


def test_base_and_scores(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(1001, None), (1002, ""), (1003, "THE the\x0bThe é")]
    c, ends = Counter(), 0
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            c.update((t or "").encode().lower().split())
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + 1
    df = spark.createDataFrame([(d, t, b"x") for d, t in rows] + [(1001, None, b"y")], "doc_id long, text string, word binary")
    got = lm.score_texts(df).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        w = (dict(rows)[r["doc_id"]] or "").encode().lower().split()
        extra = r["train_tokens"] - n
        assert extra == (zlib.crc32(b"1001") % 5 != 1)
        den = math.log10(n + extra + 0.5 * (v + 1))
        base = sum(math.log10(c[x] + 0.5) for x in w) + math.log10(ends + extra + 0.5) - (len(w) + 1) * den
        assert r["base_score"] == pytest.approx(base, abs=1e-6) and r["n_tokens"] == len(w) + 1 and r["n_known"] == sum(c[x] > 0 for x in w) + 1
        assert r["score"] < 0 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
    more = lm.score_texts(spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")).collect()
    for held in (True, False):
        assert sum(r["score"] for r in more if r["held_out"] == held) > sum(r["base_score"] for r in more if r["held_out"] == held)
    assert lm.score_texts(df.limit(0)).count() == 0


def test_mixture_of_logs():
    net, share = np.log10([0.1, 1e-30, 0.2, 1e-320]), np.log10([0.3, 0.2, np.nan, 0.5])
    want = [0.75 * 0.1 + 0.25 * 0.3, 0.25 * 0.2, 0.75 * 0.2, 0.25 * 0.5]
    assert np.allclose(10 ** lm.mixed_logs(net, share, 0.25), want)
    assert 0.5 < lm.fit_mix(np.log10(np.full(100, 1e-4)), np.log10(np.full(100, 1e-2))) <= 0.9


def test_pairs_are_counted_over_all_training_texts(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = [(r["text"] or "").encode().lower().split() for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1]
    seen = []
    fit = lm.fit

    def spy(texts, *args, **kwargs):
        seen.append((len(texts), fit(texts, *args, **{**kwargs, "steps": 1})))
        return seen[-1][1]

    monkeypatch.setattr(lm, "fit", spy)
    lm.score_texts(docs, train_docs=10)
    encoder = lm.Encoder(lm.TOKENIZER, {})
    texts = [np.append(encoder.subwords(encoder.encode(w)), encoder.tokenizer.size) for w in kept]
    counts = np.bincount(np.concatenate(texts), minlength=encoder.tokenizer.size + 1)
    whole = fit(texts, counts[:-1], counts[-1], steps=0)
    (sampled, model), = seen
    assert sampled < 10 < len(kept)
    assert np.array_equal(model.close, whole.close) and np.allclose(model.share, whole.share, atol=1e-5) and np.allclose(model.after, whole.after, atol=1e-5)


def test_head_list_does_not_change_scores(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1, "twice never seen twice qqzzqq qqzzqq"), (2, None)], "doc_id long, text string"))
    monkeypatch.setattr(lm.fit, "__defaults__", (5, 20, None))
    got = []
    for share in (5e-7, 1e-2, 10.0):
        monkeypatch.setattr(lm, "HEAD_SHARE", share)
        got.append(sorted((r["doc_id"], r["n_known"], r["n_tokens"], r["base_score"], r["score"]) for r in lm.score_texts(docs).collect()))
    for other in got[1:]:
        assert np.allclose(np.array(got[0]), np.array(other), rtol=1e-5)


def test_long_words_are_read_to_their_end():
    text = bytes(range(97, 123)) * 30
    parts = toxicity.words_of_text(b"short " + text + b" (" + b"x" * 64 + b")")
    assert parts[0] == b"short" and parts[-1] == b"x" * 64 and max(map(len, parts)) <= 64
    pieces = parts[1:-1]
    assert pieces[0] + b"".join(x[2:] for x in pieces[1:]) == text
    model = toxicity.Model(rnn.new_params(1, toxicity.GRAMS, toxicity.WIDTH, toxicity.HIDDEN, 3), {}, np.array([0.0, 1.0, 1.0, 0.0, 0.0]))
    scorer = toxicity.Scorer(model)
    same, other = ("语" * 30 + x for x in ("好" * 400, "坏" * 400))
    one, two = scorer.scores([scorer.encode(t.encode()) for t in (same, other)])
    assert abs(one - two) > 1e-6


def test_attention_gradients_against_differences():
    rng = np.random.default_rng(0)
    n, k = 9, 5
    shapes = {"e": (n, lm.WIDTH), "p": (lm.WINDOW, lm.WIDTH), "q": (lm.WIDTH, lm.WIDTH), "k": (lm.WIDTH, lm.WIDTH), "v": (lm.WIDTH, lm.WIDTH), "o": (lm.WIDTH, k), "b": (1, k)}
    w = {name: rng.normal(scale=0.4, size=shape) for name, shape in shapes.items()}
    after = np.log(rng.dirichlet(np.ones(k), n))
    r, y, ok = rng.integers(0, n, (2, lm.WINDOW)), rng.integers(0, k, (2, lm.WINDOW)), rng.random((2, lm.WINDOW)) < 0.6

    def loss():
        out = []
        for i, t in zip(*np.nonzero(ok)):
            x = w["e"][r[i, : t + 1]] + w["p"][: t + 1]
            a = np.exp(x @ w["k"] @ (x[t] @ w["q"]) / lm.WIDTH**0.5)
            logits = a / a.sum() @ (x @ w["v"]) @ w["o"] + after[r[i, t]] + w["b"][0]
            out.append(np.log(np.exp(logits).sum()) - logits[y[i, t]])
        return np.mean(out)

    g = lm.gradients({name: v.astype(np.float32) for name, v in w.items()}, after.astype(np.float32), r, y, ok)
    for name, v in w.items():
        flat = v.ravel()
        for i in rng.choice(flat.size, 4, replace=False):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert g[name].ravel()[i] == pytest.approx((up - down) / 2e-4, abs=1e-5), name


def test_weights_learn_from_all_training_texts(spark, small):
    """A task's steps go over every stored training text, not over the first ones alone; the tasks' weights are averaged."""
    docs = spark.read.parquet(f"{small}/documents.parquet").coalesce(1)
    stored = lm.encoded(docs, "doc_id", "text", lm.TOKENIZER)
    known = stored.where("word is null and learn")
    texts = [np.frombuffer(r["ids"], np.uint16).astype(np.int64) for r in known.collect()]
    assert len(texts) == sum(zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1 for r in docs.select("doc_id").collect())
    size = lm.Subwords(lm.TOKENIZER).size
    counts = np.bincount(np.concatenate(texts), minlength=size + 1)
    layout = lm.layout_of(counts[:-1], counts[-1])
    begun = lm.fit(texts[:3], counts[:-1], counts[-1], steps=5, cells=layout.count(texts))
    ends = []
    for part in (texts, texts[:3]):
        w = {name: v.copy() for name, v in begun.weights.items()}
        lengths = np.array([len(t) for t in part])
        assert lm.epoch(w, layout, begun.after, [(np.concatenate(part), lengths)]) == len(lm.window_grid(lengths)[0])
        ends.append(w)
    got = lm.learn_all(known, begun, layout).weights
    gap = lambda w: max(np.abs(got[k] - w[k]).max() for k in got)
    assert gap(ends[0]) < 1e-3 < gap(ends[1])
