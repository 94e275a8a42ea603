"""SimHash near-duplicate groups: 64-bit fingerprints, pigeonhole blocks, verified Hamming distance, components.

Two fingerprints that differ in at most ``max_bits`` bits agree on at least ``blocks - max_bits`` of ``blocks``
equal pieces, so every close pair meets under one of C(blocks, max_bits) masks. Six blocks and three bits give
twenty masks of about 32 bits each: a key that still separates tens of billions of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import durable, fresh_names, text_bytes
from notewright.llm.graph import connected_components

SEED = 42
WIDTH = 3
MAX_BITS = 3
BLOCKS = 6
#: Runs of up to this many fingerprints are compared pair by pair; longer ones by a search that emits a tree.
PAIRWISE_RUN = 48


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each ``width``-word shingle of the lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in pairs), np.uint64, len(words) - width + 1)


def fold(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is one if it is one in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.flatnonzero(2 * ones > len(hashes))
    return sum(1 << int(b) for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash long, fp long) for each row; a text without words, or null, has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fold(shingle_hashes(t))) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_hash(text_col).alias("text_hash"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, fp long"
    )


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def block_masks(blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> list[int]:
    """One mask for each choice of ``blocks - max_bits`` pieces that a close pair can agree on."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    pieces = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(c)) for c in combinations(pieces, blocks - max_bits)]


def _tree(fps: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links inside one long run: each step takes one fingerprint against all not yet reached."""
    left, right = [], []
    rest = np.arange(len(fps))
    queue: list[int] = []
    while len(rest):
        if not queue:
            queue.append(int(rest[0]))
            rest = rest[1:]
            continue
        at = queue.pop()
        near = np.bitwise_count(fps[rest] ^ fps[at]) <= max_bits
        found = rest[near].tolist()
        left += [at] * len(found)
        right += found
        queue += found
        rest = rest[~near]
    return left, right


def _links(table: np.ndarray, key: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside runs of equal (table, key)."""
    if len(fps) < 2:
        return fps[:0], fps[:0]
    change = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
    starts = np.concatenate(([0], change))
    sizes = np.diff(np.concatenate((starts, [len(fps)])))
    run = np.repeat(np.arange(len(starts)), sizes)
    long_run = sizes > PAIRWISE_RUN
    short = ~long_run[run]
    lefts, rights = [], []
    most = int(sizes[~long_run].max()) if (~long_run).any() else 1
    for shift in range(1, most):
        near = (run[shift:] == run[:-shift]) & short[shift:] & (np.bitwise_count(fps[shift:] ^ fps[:-shift]) <= max_bits)
        hit = np.flatnonzero(near)
        lefts.append(fps[hit])
        rights.append(fps[hit + shift])
    for r in np.flatnonzero(long_run):
        part = fps[int(starts[r]) : int(starts[r] + sizes[r])]
        a, b = _tree(part, max_bits)
        lefts.append(part[a])
        rights.append(part[b])
    return np.concatenate(lefts or [fps[:0]]), np.concatenate(rights or [fps[:0]])


def links(groups: DataFrame, blocks: int = BLOCKS, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to span every component."""
    masks = block_masks(blocks, max_bits)
    keyed = groups.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("block", "key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last run of a batch may go on in the next one: its parts are put together once, when it ends
        held: list[list[np.ndarray]] = []

        def out(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            table, key, fp = (np.concatenate(x) for x in zip(*parts))
            a, b = _links(table, key, fp.view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(3)]
            other = np.flatnonzero((new[0] != new[0][-1]) | (new[1] != new[1][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if not cut and held and (held[-1][0][-1] != new[0][0] or held[-1][1][-1] != new[1][0]):
                yield out(held)
                held = []
            if cut:
                yield out([*held, [x[:cut] for x in new]])
                held = []
            held.append([x[cut:] for x in new])
        if held:
            yield out(held)

    dealt = keyed.repartition("block", "key").sortWithinPartitions("block", "key")
    return dealt.mapInArrow(run, "a long, b long")


def components(marked: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, n_same, component, component_id) for each fingerprint of a row with an id, from ``fingerprints``' rows.

    ``component`` is the component's least fingerprint, ``component_id`` its least id. Fingerprints are the nodes, not
    ids: an id that stands on several texts doesn't tie them together.
    """
    groups = durable(marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_same")))
    found = connected_components(links(groups, blocks, max_bits))
    named = groups.join(found, groups["fp"] == found["node"], "left").select("fp", "rep", "n_same", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(least, "component").select("fp", "n_same", "component", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), n_same.

    Words are runs of non-white-space, shingles are three words. Texts that are null or have no word share
    fingerprint zero and are linked like any other. Repeated rows each get their row; rows that share an id but not a
    text are each judged by their own text. A row whose id is null gets its fingerprint and a null component.
    ``n_same`` counts the rows with this very fingerprint. Copies meet in one group-by before any comparison, so only
    distinct fingerprints are compared. Other columns, whatever their names, are not touched; an empty table gives an
    empty result.
    """
    marked = durable(fingerprints(docs, id_col, text_col))
    joined = marked.join(components(marked, max_bits, blocks), "fp", "left")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.col("n_same")).otherwise(F.lit(0)).cast("long").alias("n_same"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with exactly one row of each component: the one of least id, of several texts with that id the one of
    least hash. Rows with a null id are in no component and all kept.

    Rows are told apart by id and text, so an id that stands on several texts loses only those that are copies.
    Of rows equal in both, one stays, whichever comes first. A null text counts as empty; wordless texts are one
    component. An empty table gives an empty result, extra columns stay, whatever their names. Only ids and hashes
    are compared: a text is moved once at most.
    """
    marked = durable(fingerprints(docs, id_col, text_col)).where("doc_id is not null")
    rows = marked.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("n"))
    placed = durable(rows.join(components(marked).select("fp", "component"), "fp"))
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    decided = placed.join(first, "component").select("doc_id", "text_hash", "n", (F.struct("doc_id", "text_hash") == F.col("first")).alias("stays"))
    decided = durable(decided.where("not stays or n > 1"))

    def rows_of(part: DataFrame, how: str) -> DataFrame:
        keys = part.select(F.col("doc_id").alias(key_names[0]), F.col("text_hash").alias(key_names[1]))
        same = (docs[id_col].cast("long") == F.col(key_names[0])) & (hashed == F.col(key_names[1]))
        return docs.join(keys, same, how)

    key_names = fresh_names(docs, 2)
    hashed = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    rest = rows_of(decided, "left_anti")
    repeated = decided.where("stays")
    if repeated.isEmpty():
        return rest
    again = rows_of(repeated, "inner").dropDuplicates(key_names).drop(*key_names)
    return rest.unionByName(again)
