"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id.

Every 50-byte string has an anchor, the least hash among its 24-byte pieces, and equal strings have equal ones. So
the corpus falls apart, without loss, into the surroundings of the anchors that occur in two documents or more: two
equal strings always lie around equal anchors. Surroundings are grouped by anchor, equal ones are one string with a
list of documents, and a group's strings are searched by merging Burrows-Wheeler transforms of its shards. The strings
of an anchor with too many different surroundings for one task are told apart one by one instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.bwt import build_shard, repeated_intervals
from notewright.llm.common import freeing_shuffles, text_bytes, written

LENGTH, PIECE = 50, 24
SPAN = LENGTH - PIECE
#: Of the bytes beside an anchor a shared string holds at least half on one side.
SIDE = SPAN // 2
#: Bytes that are hashed at once; a longer text is read in parts of this size that share LENGTH - 1 bytes.
CHUNK_BYTES = 1 << 18
#: Low bits that hold a position in a chunk while the least hash of a window is sought.
PLACE_BITS = 20
#: Bits of the filters of anchors. They let through some others, which cost time and change nothing.
FILTER_BITS = 27
SHARD_BYTES, BUFFER_ROWS, SEEN_PIECES = 1 << 19, 60_000, 150_000
#: An anchor with more different pieces than this, counted once a batch, is not gathered: each 50-byte string of its
#: pieces is dealt by itself.
HOT_ROWS = 60_000
#: Marks a row that is one string of such an anchor.
LEAF = -1
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SIDES = np.random.default_rng(17).integers(0, 1 << 63, (2, SIDE)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def piece_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each PIECE bytes of ``data``."""
    h = data.astype(np.uint64) + np.uint64(1)
    parts = {1: h}
    for width, step in zip((1, 2, 4, 8), _STEPS):
        a = parts[width]
        parts[2 * width] = a[:-width] * step + a[width:]
    n = len(data) - PIECE + 1
    h = parts[16][:n] * _STEPS[4] + parts[8][16 : 16 + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _least(h: np.ndarray, width: int) -> np.ndarray:
    have, m = 1, h
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def _edges(*keys: np.ndarray) -> np.ndarray:
    """True where any key differs from the row before."""
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = False
    for k in keys:
        fresh[1:] |= k[1:] != k[:-1]
    return fresh


def anchors(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, low, high) of the anchors in texts laid end to end: the strings that start at low to high
    have this anchor, the leftmost of least hash. A text under LENGTH bytes has none."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, none
    h = piece_hashes(data)
    place = np.uint64((1 << PLACE_BITS) - 1)
    packed = (h & ~place) | np.arange(len(h), dtype=np.uint64)
    at = (_least(packed, SPAN + 1) & place).astype(np.int64)
    ends = np.cumsum(lengths)
    inside = np.ones(len(at), bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - LENGTH + 1) : end] = False
    starts = np.flatnonzero(inside)
    at = at[starts]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else none
    last = np.append(first[1:] - 1, len(at) - 1) if len(first) else none
    return at[first], h[at[first]], starts[first], starts[last]


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """(parts, text of each, where it begins there): whole texts together, long ones cut so that each string of LENGTH
    bytes starts in one part and ends there."""
    parts: list[bytes] = []
    owner: list[int] = []
    begin: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), CHUNK_BYTES):
            part = t[at : at + CHUNK_BYTES + LENGTH - 1] if len(t) > CHUNK_BYTES else t
            if parts and size + len(part) > CHUNK_BYTES:
                yield parts, np.array(owner), np.array(begin)
                parts, owner, begin, size = [], [], [], 0
            parts.append(part)
            owner.append(i)
            begin.append(at)
            size += len(part)
            if len(t) <= CHUNK_BYTES:
                break
    if parts:
        yield parts, np.array(owner), np.array(begin)


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits with those of the column h, of any number of rows."""
    low = F.col("h").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = keys.select(F.shiftright(low, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    # written first: the shuffles behind it are freed with the write, before the driver reads the words
    with written(words.groupBy("w").agg(F.bit_or("b").alias("b"))) as ready:
        packed = ready.toArrow()
    table[packed.column("w").to_numpy()] = packed.column("b").to_numpy()
    return table.view(np.uint64)


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64((1 << FILTER_BITS) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def repeated_anchors(docs: DataFrame) -> np.ndarray:
    """The filter of all anchors that occur in two rows or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text, _ in _chunks(text_bytes(batch.column(0))):
                lengths = np.fromiter(map(len, part), np.int64, len(part))
                at, h, _, _ = anchors(np.frombuffer(b"".join(part), np.uint8), lengths)
                owner = text[np.searchsorted(np.cumsum(lengths), at, side="right")]
                order = np.lexsort((h, owner))
                h, owner = h[order], owner[order]
                yield pa.RecordBatch.from_arrays([pa.array(h[_edges(h, owner)].view(np.int64))], ["h"])

    with freeing_shuffles(docs.sparkSession):
        return _filter_of(docs.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))


def _pieces(texts: list[bytes], keep: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunks of texts: (pieces, text of each, start, anchor's place, anchor's hash) of kept anchors."""
    for part, text, begin in _chunks(texts):
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        joined = b"".join(part)
        at, h, low, high = anchors(np.frombuffer(joined, np.uint8), lengths)
        hit = _held(keep, h)
        at, h, low, high = at[hit], h[hit], low[hit], high[hit] + LENGTH
        ends = np.cumsum(lengths)
        owner = np.searchsorted(ends, at, side="right")
        yield [joined[a:b] for a, b in zip(low.tolist(), high.tolist())], text[owner], low - (ends - lengths)[owner] + begin[owner], at - low, h


def _digests(pieces: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces), np.uint64, len(pieces)).view(np.int64)


def differing_anchors(docs: DataFrame, keep: np.ndarray, hot_rows: int = HOT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The filters of those repeated anchors whose pieces are not all equal, since only these need their text compared,
    and of those among them with more than ``hot_rows`` pieces, equal ones counted once a batch."""
    sent = docs.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            for pieces, _, _, _, h in _pieces(text_bytes(batch.column(0)), sent.value):
                f = _digests(pieces)
                if len(seen) > SEEN_PIECES:
                    seen.clear()
                n = len(seen)
                new = []
                for i, key in enumerate((f ^ h.view(np.int64)).tolist()):
                    seen.add(key)
                    if len(seen) > n:
                        new.append(i)
                        n += 1
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)[new]), pa.array(f[new])], ["h", "f"])

    with freeing_shuffles(docs.sparkSession):
        spread = docs.select("text").mapInArrow(run, "h long, f long").groupBy("h").agg(F.min("f").alias("low"), F.max("f").alias("high"), F.count("*").alias("n"))
        with written(spread.where("low < high").select("h", "n")) as several:
            return _filter_of(several.select("h")), _filter_of(several.where(F.col("n") > hot_rows).select("h"))


def _leaves(pieces: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, place, two hashes) of every string of LENGTH bytes in some pieces."""
    owner, place, first, second = [], [], [], []
    for i in which.tolist():
        p = pieces[i]
        n = len(p) - LENGTH + 1
        owner += [i] * n
        place += range(n)
        for j in range(n):
            both = xxhash.xxh128_digest(p[j : j + LENGTH])
            first.append(both[:8])
            second.append(both[8:])
    return np.array(owner, np.int64), np.array(place, np.int64), np.frombuffer(b"".join(first), np.int64), np.frombuffer(b"".join(second), np.int64)


PIECE_COLUMNS = ["h", "f", "piece", "start", "size", "anchor"]


def surroundings(docs: DataFrame, keep: np.ndarray, differ: np.ndarray, hot: np.ndarray) -> DataFrame:
    """(h, f, piece, start, size, anchor, and the columns that name a row): the strings of each repeated anchor, as one
    piece of text with its digest; without the text where all pieces of the anchor are equal.

    Of equal pieces in a batch only those of the smallest document go to the anchor's task: the others are covered
    for sure, and leave as plain ranges without digest, dealt out evenly. So a piece that very many documents hold
    sends no more rows to one task than there are batches. The same holds for each string of a hot anchor's pieces.
    """
    sent = docs.sparkSession.sparkContext.broadcast((keep, differ, hot))
    keys = [c for c in docs.columns if c != "text"]
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, differ, hot = sent.value
        some_hot = bool(hot.any())
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            ids, texts = ids[order], text_bytes(batch.column(at_text))
            named = [batch.column(c).to_numpy(zero_copy_only=False)[order] for c in keys]
            seen: dict[int, int] = {}

            def first_of(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
                if len(seen) > SEEN_PIECES:
                    seen.clear()
                return np.fromiter(map(seen.setdefault, key.tolist(), doc.tolist()), np.int64, len(doc))

            def out(h: np.ndarray, f: pa.Array, piece: pa.Array, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
                columns = [pa.array(h.view(np.int64)), f, piece, pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(anchor.astype(np.int8))]
                return pa.RecordBatch.from_arrays([*columns, *(pa.array(x[owner], pa.int64()) for x in named)], [*PIECE_COLUMNS, *keys])

            for pieces, owner, start, place, h in _pieces([texts[i] for i in order.tolist()], keep):
                doc, f = ids[owner], _digests(pieces)
                covered = first_of(f ^ h.view(np.int64), doc) < doc
                dealt = np.where(covered, h ^ (doc.astype(np.uint64) * _STEPS[1]), h)
                text = _held(differ, h) & ~covered
                size = np.fromiter(map(len, pieces), np.int64, len(pieces))
                if some_hot:
                    single = text & _held(hot, h)
                    leaf, spot, one, two = _leaves(pieces, np.flatnonzero(single))
                    if len(leaf):
                        told = first_of(one, doc[leaf]) < doc[leaf]
                        one = np.where(told, one ^ (doc[leaf].astype(np.uint64) * _STEPS[1]).view(np.int64), one)
                        none, fifty = pa.nulls(len(leaf), pa.binary()), np.full(len(leaf), LENGTH)
                        yield out(one, pa.array(two, mask=told), none, start[leaf] + spot, fifty, np.full(len(leaf), LEAF), owner[leaf])
                        go = ~single
                        pieces, text = [p for p, g in zip(pieces, go.tolist()) if g], text[go]
                        owner, start, place, f, covered, dealt, size = (x[go] for x in (owner, start, place, f, covered, dealt, size))
                yield out(dealt, pa.array(f, mask=covered), pa.array([p if t else None for t, p in zip(text.tolist(), pieces)], pa.binary()), start, size, place, owner)

    kinds = "h long, f long, piece binary, start int, size int, anchor byte"
    return docs.mapInArrow(run, ", ".join([kinds, *(f"{c} long" for c in keys)]))


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... n[0] of them, then those of the next."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


def candidates(h: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Of pieces sorted by anchor, those that share with another piece of their anchor SIDE bytes on one side of it."""
    wanted = np.zeros(len(h), bool)
    same = h[1:] == h[:-1]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    for side, offset in enumerate((-SIDE, PIECE)):
        fits = many & ((anchor >= SIDE) if side == 0 else (size - anchor - PIECE >= SIDE))
        rows = np.flatnonzero(fits)
        if len(rows):
            beside = data[(begin[rows] + anchor[rows] + offset)[:, None] + np.arange(SIDE)]
            key = h[rows].view(np.uint64) * _STEPS[0] + ((beside.astype(np.uint64) + np.uint64(1)) * _SIDES[side]).sum(axis=1, dtype=np.uint64)
            _, at, n = np.unique(key, return_inverse=True, return_counts=True)
            wanted[rows[n[at] > 1]] = True
    return np.flatnonzero(wanted)


def merged_matches(text: list[np.ndarray], owner: list[np.ndarray], place: list[np.ndarray], least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, low, high): parts of pieces that also start in a piece of a smaller document.

    ``text``: shards of pieces, characters plus one, each piece with a zero after it; ``owner``, ``place``: the piece
    of each character, and its place there; ``least``: the smallest document of each piece.
    """
    shards, origin, spot = [], [], []
    for t, o, p in zip(text, owner, place):
        ends = np.flatnonzero(t == 0)
        left = ends[np.searchsorted(ends, np.arange(len(t)))] - np.arange(len(t))
        shard = build_shard(t, left)
        shards.append(shard)
        origin.append(o[shard.start])
        spot.append(p[shard.start])
    rows, group, _ = repeated_intervals(shards, LENGTH)
    piece, at = np.concatenate(origin)[rows], np.concatenate(spot)[rows]
    if len(piece):
        first = np.flatnonzero(_edges(group))
        smallest = np.repeat(np.minimum.reduceat(least[piece], first), np.diff(np.append(first, len(group))))
        covered = least[piece] > smallest
        piece, at = piece[covered], at[covered]
    if not len(piece):
        return piece, at, at
    order = np.lexsort((at, piece))
    piece, at = piece[order], at[order]
    fresh = _edges(piece)
    fresh[1:] |= at[1:] > at[:-1] + LENGTH
    first = np.flatnonzero(fresh)
    last = np.append(first[1:] - 1, len(piece) - 1)
    return piece[first], at[first], at[last] + LENGTH


def search(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high) of covered bytes, from all rows of some anchors, sorted by anchor, piece and document."""
    h, f, doc = (rows.column(i).to_numpy() for i in range(3))
    start, anchor = rows.column(3).to_numpy().astype(np.int64), rows.column(4).to_numpy().astype(np.int64)
    pieces, row = rows.column(5), np.arange(len(h))
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
    size = rows.column(6).to_numpy().astype(np.int64)
    fresh = _edges(h, f, size)
    group, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    least = doc[first]
    later = doc > least[group]
    out = [(row[later], start[later], start[later] + size[later])]
    chosen = candidates(h[first], data, offsets[first], size[first], anchor[first])
    if len(chosen):
        text, owner, place = [], [], []
        bounds = np.searchsorted(np.cumsum(size[first[chosen]] + 1), np.arange(SHARD_BYTES, int((size[first[chosen]] + 1).sum()) + SHARD_BYTES, SHARD_BYTES))
        for a, b in zip(np.concatenate(([0], bounds[:-1])).tolist(), bounds.tolist()):
            part = chosen[a:b] if b < bounds[-1] else chosen[a:]
            if not len(part):
                continue
            n = size[first[part]]
            flat = np.zeros(int(n.sum()) + len(part), np.int16)
            own = np.repeat(np.arange(len(part)), n + 1)
            inside = np.arange(len(flat)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
            real = inside < n[own]
            flat[real] = data[_spread(offsets[first[part]], n)].astype(np.int16) + np.int16(1)
            text.append(flat)
            owner.append(part[own])
            place.append(inside)
            if b >= bounds[-1]:
                break
        found, low, high = merged_matches(text, owner, place, least)
        if len(found):
            # parts of a piece belong to the rows of its smallest document, which stand first in its group
            count = np.bincount(group[~later], minlength=len(first))
            n = count[found]
            which = _spread(first[found], n)
            out.append((row[which], start[which] + np.repeat(low, n), start[which] + np.repeat(high, n)))
    return tuple(np.concatenate(x) for x in zip(*out))


def united(names: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The ranges with those of one row that touch made one."""
    if not len(low):
        return names, low, high
    order = np.lexsort((low, *reversed(names)))
    names, low, high = [x[order] for x in names], low[order], high[order]
    turn = _edges(*names)
    # rows are set apart by a stride beyond any length, so that one running maximum serves them all
    base = np.cumsum(turn) << 33
    reach = np.maximum.accumulate(high + base) - base
    fresh = turn.copy()
    fresh[1:] |= low[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return [x[first] for x in names], low[first], reach[np.append(first[1:] - 1, len(low) - 1)]


def covered_ranges(around: DataFrame) -> DataFrame:
    """(the columns that name a row, low, high): ranges of bytes to remove, overlapping ones included."""
    keys = [c for c in around.columns if c not in PIECE_COLUMNS]
    order = ["h", "f", "doc_id", "start", "anchor", "piece", "size", *keys[1:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        # the string of a hot anchor met last, and its smallest document: its rows come in the order of their ids
        string, least = (0, 0), 0

        def out(rows: pa.RecordBatch, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
            names = [rows.column(i).to_numpy()[which] for i in (2, *range(7, 6 + len(keys)))]
            names, low, high = united(names, low, high)
            return pa.RecordBatch.from_arrays([*map(pa.array, names), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], [*keys, "low", "high"])

        def plain(rows: pa.RecordBatch) -> pa.RecordBatch:
            low, size = (rows.column(i).to_numpy().astype(np.int64) for i in (3, 6))
            return out(rows, np.arange(len(low)), low, low + size)

        def leaves(rows: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal string, least
            h, f, doc = (rows.column(i).to_numpy() for i in range(3))
            fresh = _edges(h, f)
            fresh[0] = (int(h[0]), int(f[0])) != string
            begin = np.flatnonzero(fresh)
            first = np.concatenate(([least], doc[begin]))[np.cumsum(fresh)]
            string, least = (int(h[-1]), int(f[-1])), int(first[-1])
            return plain(rows.filter(pa.array(doc > first)))

        def whole() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        for batch in batches:
            ready = batch.column(1).is_null()
            if ready.true_count:
                yield plain(batch.filter(ready))
                batch = batch.filter(batch.column(1).is_valid())
            leaf = batch.column(4).to_numpy() == LEAF
            if leaf.any():
                yield leaves(batch.filter(pa.array(leaf)))
                batch = batch.filter(pa.array(~leaf))
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BUFFER_ROWS:
                rows = whole()
                h = rows.column(0).to_numpy()
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
                if cut:
                    done = rows.slice(0, cut)
                    yield out(done, *search(done))
                    held = [rows.slice(cut)]
                else:
                    # one anchor fills the buffer: rows that an equal piece covers go at once, distinct pieces stay,
                    # HOT_ROWS of them at most
                    f, doc, size = rows.column(1).to_numpy(), rows.column(2).to_numpy(), rows.column(6).to_numpy()
                    fresh = _edges(f, size)
                    covered = doc > doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
                    yield plain(rows.filter(pa.array(covered)))
                    held = [rows.filter(pa.array(~covered))]
        if held:
            rows = whole()
            yield out(rows, *search(rows))

    dealt = around.select(*order).repartition("h").sortWithinPartitions("h", "f", "size", "doc_id", "start")
    return dealt.mapInArrow(run, ", ".join([*(f"{c} long" for c in keys), "low int, high int"]))


def _named_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """(doc_id, text), with a hash of the text if an id stands on several rows, and the columns that name a row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    several = narrow.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if several.isEmpty():
        return narrow, ["doc_id"]
    return narrow.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text"), ["doc_id", "text_hash"]


def removed_ranges(narrow: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """(``keys``, ranges): for each row of ``_named_rows`` with something to remove, its ranges, unsorted and with
    overlaps."""
    real = narrow.where("doc_id is not null")
    keep = repeated_anchors(real)
    ranges = covered_ranges(surroundings(real, keep, *differing_anchors(real, keep, hot_rows)))
    return ranges.groupBy(*keys).agg(F.collect_list(F.struct("low", "high")).alias("ranges"))


def dedup_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless ``digest_only``,
    ``kept`` (binary: a range may end inside a character).

    A null text is empty, a row with a null id keeps all its bytes and removes none of another row's. Of rows that
    share an id none is smaller than the other, and each is judged by its own text; rows equal in both get the same
    result. Whole texts are compared, of any length Spark can hold, and no match reaches over the end of a text.
    Other columns are not read; an empty table gives an empty result.
    """
    narrow, keys = _named_rows(docs, id_col, text_col)
    joined = narrow.join(removed_ranges(narrow, keys, hot_rows), keys, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text, ranges in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, spans, removed_bytes, at = [], 0, 0, 0
                reach = -1
                for low, high in sorted((r["low"], r["high"]) for r in ranges or ()):
                    if low > reach:
                        spans += 1
                        kept.append(text[at:low])
                        removed_bytes += high - low
                        at = reach = high
                    elif high > reach:
                        removed_bytes += high - reach
                        at = reach = high
                kept.append(text[at:])
                left = b"".join(kept)
                for have, new in zip(out, (len(text), removed_bytes, spans, hashlib.sha256(left).hexdigest(), None if digest_only else left)):
                    have.append(new)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if not digest_only:
                columns, names = [*columns, pa.array(out[4], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ("" if digest_only else ", kept binary")
    return joined.select("doc_id", "text", "ranges").mapInArrow(run, schema)


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup_texts`` without the texts."""
    return dedup_texts(docs, id_col, text_col, digest_only=True)
