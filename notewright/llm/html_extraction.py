"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A block's features are the elements above it with their class, id and role names, its nearest named ancestor, and
the look of its text; the chain carries how main text and the rest follow each other. It is trained by forward and
backward sums on labelled pages made by rule.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.html_blocks import Block, leaf_blocks
from notewright.llm.html_training import Maker

FEATURES = 1 << 14
TRAIN_PAGES, TRAIN_SEED = 700, 11
#: Pages of other kinds: short ones, threads of one message, table layouts, titles in headers.
ODD_PAGES = 400
ROUNDS, RATE, RIDGE = 120, 0.1, 2e-4


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


@lru_cache(maxsize=20_000)
def path_features(path: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[int, ...]:
    """Features of the elements above a block."""
    out = [f"parent:{path[-1][0]}" if path else "parent:none", f"depth:{min(len(path), 6)}"]
    inner_tag = inner_name = None
    for tag, names in path:
        if tag not in ("html", "body", "div", "span", "p"):
            out.append(f"tag:{tag}")
        out += [f"name:{n}" for n in names]
        if names:
            inner_name = names
        if tag in ("article", "main", "nav", "aside", "footer", "header", "form", "section", "ul", "ol", "table", "li"):
            inner_tag = tag
    out.append(f"inner:{inner_tag}")
    out += [f"near:{n}" for n in inner_name or ("none",)]
    if not any(t in ("article", "main") for t, _ in path):
        out.append("no article")
    return tuple({_hash(x) for x in out})


def block_features(blocks: list[Block]) -> list[list[int]]:
    n = len(blocks)
    out = []
    for i, b in enumerate(blocks):
        text, words = b.text, b.text.count(" ") + 1
        size = 0 if words <= 2 else 1 if words <= 5 else 2 if words <= 12 else 3 if words <= 30 else 4
        density = b.link_chars / len(text)
        link = 0 if density == 0 else 1 if density < 0.4 else 2 if density < 0.9 else 3
        end = text.rstrip("*#$%&\"')")[-1:]
        stop = end in (".", "?", "!", ":", "…")
        marks = sum(text.count(c) for c in ".,;?!")
        parent = b.path[-1][0] if b.path else "none"
        shape = [
            f"size:{size}", f"link:{link}", f"stop:{stop}", f"size-link:{size}-{link}", f"size-parent:{size}-{parent}",
            f"count:{min(n, 4)}", f"count-stop:{min(n, 4)}-{stop}", f"marks:{min(4, marks * 20 // max(words, 1))}", f"copyright:{'©' in text}", f"first:{i == 0}", f"last:{i == n - 1}", f"place:{5 * i // n}",
        ]
        out.append([*path_features(b.path), *map(_hash, shape)])
    return out


@dataclass
class Chain:
    """Weights: ``unary`` (features, 2), ``pair`` (2, 2), ``start`` (2,)."""

    unary: np.ndarray
    pair: np.ndarray
    start: np.ndarray

    def scores(self, features: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, features), np.int64, len(features))
        flat = np.fromiter((x for f in features for x in f), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.unary[flat], np.cumsum(sizes) - sizes, axis=0)

    def decode(self, features: list[list[int]]) -> list[int]:
        """The most likely labels of a page's blocks."""
        if not features:
            return []
        u = self.scores(features).tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = self.start[0] + u[0][0], self.start[1] + u[0][1]
        back = []
        for x, y in u[1:]:
            from0, from1 = a + p00 >= b + p10, a + p01 >= b + p11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + p00 if from0 else b + p10) + x, (a + p01 if from1 else b + p11) + y
        labels = [0 if a >= b else 1]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def labelled_pages(n: int = TRAIN_PAGES, seed: int = TRAIN_SEED, odd: int = ODD_PAGES) -> Iterator[tuple[list[Block], list[int]]]:
    """``n`` pages of the usual kind and ``odd`` of the others."""
    maker = Maker(seed)
    for make in [maker.page] * n + [maker.odd_page] * odd:
        blocks = leaf_blocks(make())
        yield blocks, [maker.labels.get(b.text, 0) for b in blocks]
        maker.labels.clear()


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train_chain(pages: Iterator[tuple[list[Block], list[int]]] | None = None, rounds: int = ROUNDS) -> Chain:
    """Greatest likelihood with a ridge, by full-batch Adam over all pages at once."""
    pairs = [(block_features(b), y) for b, y in (pages or labelled_pages()) if b]
    n, longest = len(pairs), max(len(y) for _, y in pairs)
    y = np.zeros((n, longest), np.int64)
    ok = np.zeros((n, longest), bool)
    flat, sizes = [], []
    for i, (features, labels) in enumerate(pairs):
        y[i, : len(labels)], ok[i, : len(labels)] = labels, True
        for f in features:
            flat += f
            sizes.append(len(f))
    ids, size = np.array(flat), np.array(sizes)
    begins, owner = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    lengths = ok.sum(axis=1)
    row = np.arange(n)
    w = {"unary": np.zeros((FEATURES, 2)), "pair": np.zeros((2, 2)), "start": np.zeros(2)}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    gold = np.zeros((len(size), 2))
    gold[np.arange(len(size)), y[ok]] = 1
    gold_pair = np.zeros((2, 2))
    both = ok[:, 1:]
    np.add.at(gold_pair, (y[:, :-1][both], y[:, 1:][both]), 1)
    for t in range(1, rounds + 1):
        u = np.zeros((n, longest, 2))
        u[ok] = np.add.reduceat(w["unary"][ids], begins, axis=0)
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        alpha[:, 0] = w["start"] + u[:, 0]
        for i in range(1, longest):
            step = _logsum(alpha[:, i - 1, :, None] + w["pair"][None], 1) + u[:, i]
            alpha[:, i] = np.where(ok[:, i, None], step, alpha[:, i - 1])
        for i in range(longest - 2, -1, -1):
            step = _logsum(w["pair"][None] + (u[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(ok[:, i + 1, None], step, 0)
        z = _logsum(alpha[row, lengths - 1], 1)
        node = np.exp(alpha + beta - z[:, None, None])
        edge = np.exp(alpha[:, :-1, :, None] + w["pair"] + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        edge[~both] = 0
        off = (node[ok] - gold)[owner]
        g = {
            "unary": np.stack([np.bincount(ids, off[:, c], FEATURES) for c in (0, 1)], axis=1) / n + RIDGE * w["unary"],
            "pair": (edge.sum(axis=(0, 1)) - gold_pair) / n,
            "start": (node[:, 0] - np.eye(2)[y[:, 0]]).sum(axis=0) / n,
        }
        for k, x in g.items():
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.01 * (x * x - v[k])
            w[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)
    return Chain(w["unary"], w["pair"], w["start"])


def main_text(html: str, chain: Chain) -> str:
    """The main text of a page: its blocks labelled main text, joined by line feeds."""
    blocks = leaf_blocks(html)
    return "\n".join(b.text for b, y in zip(blocks, chain.decode(block_features(blocks))) if y)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", chain: Chain | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    Null and empty html give an empty text. A page is read whole, with no limit on its length or blocks; repeated
    rows and null ids or urls are passed through, equal rows alike; an empty table gives an empty one; other columns are
    left out, whatever their names. Malformed markup is read as far as it goes: an unknown tag ends a
    block, a stray angle bracket is text.
    """
    sent = pages.sparkSession.sparkContext.broadcast(chain or train_chain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, sent.value) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
