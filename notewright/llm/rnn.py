"""A bidirectional gated recurrent network with attention pooling, in numpy: forward, backward and Adam."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def new_params(n_words: int, n_grams: int, width: int, hidden: int, seed: int) -> Params:
    """Word and character tables of ``width``; two directions of ``hidden`` units (update, reset, candidate)."""
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "words": normal(n_words, width, scale=0.1),
        "grams": normal(n_grams, width, scale=0.1),
        "W": normal(2, width, 3 * hidden, scale=width**-0.5),
        "U": normal(2, hidden, 3 * hidden, scale=hidden**-0.5),
        "b": np.zeros((2, 1, 3 * hidden), np.float32),
        "a": normal(2 * hidden, scale=0.1),
        "w": normal(2 * hidden, scale=0.1),
        "c": np.zeros(1, np.float32),
    }


def run_steps(p: Params, inputs: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """States (steps, windows, 2*hidden). ``inputs``: (steps, 2, windows, 3*hidden), the projected words, the second
    direction already in reverse order; ``mask``: (steps, 2, windows, 1), zero where there is no word."""
    steps, _, n, three = inputs.shape
    k = three // 3
    h = np.zeros((2, n, k), np.float32)
    states = np.empty((steps, n, 2 * k), np.float32)
    trace = []
    u_gates, u_new = np.ascontiguousarray(p["U"][:, :, : 2 * k]), np.ascontiguousarray(p["U"][:, :, 2 * k :])
    for t in range(steps):
        x = inputs[t]
        gates = np.matmul(h, u_gates)
        gates += x[:, :, : 2 * k]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1.0
        np.reciprocal(gates, out=gates)
        z, r = gates[:, :, :k], gates[:, :, k:]
        inner = np.matmul(h, u_new)
        new = r * inner
        new += x[:, :, 2 * k :]
        new *= -2.0
        np.exp(new, out=new)
        new += 1.0
        np.reciprocal(new, out=new)
        new *= 2.0
        new -= 1.0
        step = new - h
        step *= z
        step *= mask[t]
        if keep:
            trace.append((h, z, r, inner, new))
        h = h + step
        states[t, :, :k] = h[0]
        states[steps - 1 - t, :, k:] = h[1]
    return states, trace


def pool(p: Params, states: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(logit, attention, pooled) of each window; ``present``: (steps, windows) bool."""
    score = np.where(present, states @ p["a"], -1e9)
    score -= score.max(axis=0, keepdims=True)
    att = np.exp(score)
    att /= att.sum(axis=0, keepdims=True)
    pooled = np.einsum("tn,tnk->nk", att, states)
    return pooled @ p["w"] + p["c"][0], att, pooled


def both_ways(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Projected inputs (steps, 2, windows, 3*hidden) of word rows ``ids`` (windows, steps) from (rows, 2, 3*hidden)."""
    forward = table[ids.T, 0]
    backward = table[ids.T[::-1], 1]
    return np.stack((forward, backward), axis=1)


def both_masks(present: np.ndarray) -> np.ndarray:
    m = present.T.astype(np.float32)
    return np.stack((m, m[::-1]), axis=1)[..., None]


def gradients(p: Params, rows: np.ndarray, bags: tuple[np.ndarray, np.ndarray, np.ndarray], word_ids: np.ndarray, present: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, Params]:
    """Loss and gradients of weighted cross-entropy for a batch of windows.

    ``rows``: (windows, steps) rows of the batch's distinct words; ``word_ids``: their word-table ids; ``bags``:
    flat character-gram ids, the row that each belongs to, and the number of grams of each row.
    """
    grams, owner, count = bags
    k = p["U"].shape[1]
    x = p["words"][word_ids].copy()
    mean = np.zeros_like(x)
    np.add.at(mean, owner, p["grams"][grams])
    x += mean / np.maximum(count, 1)[:, None]
    table = np.einsum("vd,sdk->vsk", x, p["W"]) + p["b"][:, 0][None]
    inputs, mask = both_ways(rows, table.astype(np.float32)), both_masks(present)
    states, trace = run_steps(p, inputs, mask, keep=True)
    logit, att, pooled = pool(p, states, present.T)
    prob = sigmoid(logit)
    total = weight.sum()
    loss = float(-(weight * (label * np.log(prob + 1e-7) + (1 - label) * np.log(1 - prob + 1e-7))).sum() / total)
    d_logit = (weight * (prob - label) / total).astype(np.float32)

    g: Params = {"w": pooled.T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * p["w"]
    d_states = att[:, :, None] * d_pooled[None]
    d_att = np.einsum("tnk,nk->tn", states, d_pooled)
    d_score = att * (d_att - (att * d_att).sum(axis=0, keepdims=True))
    d_states += d_score[:, :, None] * p["a"]
    g["a"] = np.einsum("tn,tnk->k", d_score, states)

    steps, n = states.shape[:2]
    d_inputs = np.zeros_like(inputs)
    g["U"] = np.zeros_like(p["U"])
    dh = np.zeros((2, n, k), np.float32)
    u_t = p["U"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        dh[0] += d_states[t, :, :k]
        dh[1] += d_states[steps - 1 - t, :, k:]
        h, z, r, inner, new = trace[t]
        m = mask[t]
        d_new = dh * z * m * (1 - new * new)
        d_z = dh * (new - h) * m * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_pre = np.concatenate((d_z, d_r, d_new), axis=2)
        d_inputs[t] = d_pre
        d_rec = np.concatenate((d_z, d_r, d_new * r), axis=2)
        g["U"] += np.matmul(h.transpose(0, 2, 1), d_rec)
        dh = dh * (1 - z * m) + np.matmul(d_rec, u_t)
    d_table = np.zeros_like(table, dtype=np.float32)
    np.add.at(d_table[:, 0], rows.T.ravel(), d_inputs[:, 0].reshape(-1, 3 * k))
    np.add.at(d_table[:, 1], rows.T[::-1].ravel(), d_inputs[:, 1].reshape(-1, 3 * k))
    g["b"] = d_table.sum(axis=0)[:, None, :]
    g["W"] = np.einsum("vd,vsk->sdk", x, d_table)
    d_x = np.einsum("vsk,sdk->vd", d_table, p["W"])
    g["words"] = np.zeros_like(p["words"])
    np.add.at(g["words"], word_ids, d_x)
    g["grams"] = np.zeros_like(p["grams"])
    np.add.at(g["grams"], grams, (d_x / np.maximum(count, 1)[:, None])[owner])
    return loss, g


class Adam:
    def __init__(self, p: Params, rate: float, decay: float = 1e-5) -> None:
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.rate, self.decay, self.t = rate, decay, 0

    def step(self, p: Params, g: Params) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, grad in g.items():
            grad = grad * scale
            self.m[k] += 0.1 * (grad - self.m[k])
            self.v[k] += 0.001 * (grad * grad - self.v[k])
            p[k] -= (self.rate * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)
            if p[k].ndim > 1:
                p[k] *= 1 - self.decay
