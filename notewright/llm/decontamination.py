"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, slot consistency.

Words become template tokens: numbers, units after a number and capitalised words inside a sentence turn into typed
placeholders, all others into their lower-cased letters. Windows of template tokens are hashed and joined with the
benchmark's, and a pair of windows counts only if each value in the item's slots stands for one value, so that a question with
new numbers or names is still found while chance agreement of placeholders is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import durable, fresh_names, spread_join, text_bytes

WIDTH = 8
#: Items shorter than a window are matched as a whole, down to this many words. Yet shorter ones, which stand in any
#: prose, are never matched.
LEAST_TOKENS = 4
#: What stands around a copy can change the first two template tokens and the last one (a name that begins a sentence, a
#: run of names). Items of fewer tokens than this could fail for that, so they are sought word for word too.
WORDWISE_TOKENS = 15
#: Item tokens that consistent windows must cover, or this share of the item if that is less.
COVER_TOKENS, COVER_SHARE = 13, 0.8
#: Windows with a smaller share of literals are hashed with the values of their slots: they match word for word only.
LITERAL_SHARE = 0.6
#: The bit table has this many bits for each of the benchmark's windows, and 2 ** MOST_BITS (32 MB) at most.
BITS_EACH, MOST_BITS = 16, 28
FLUSH_WORDS = 200_000
CACHE_WORDS = 250_000
#: Units of measure, lower case.
UNITS = (
    "kg g mg lb lbs oz ton tons km m cm mm mile miles ft feet foot inch inches yard yards l ml liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent % dollar dollars cent cents euro euros pound pounds degree degrees mph kmh watt watts volt volts"
).split()
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
_PLACE = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_STEP = np.uint64(0x5851F42D4C957F2D)
_NUMBER = re.compile(rb"[$\xe2\x82\xac]*[+-]?\d[\d,./:]*(%|[a-z]{1,3})?\Z")
_EDGES = b"\"'`()[]{}<>.,;:!?*#$%&|-_"


class Lexicon(dict):
    """A word's number; the arrays hold its literal hash, value hash, kind and whether a sentence may end with it."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, bool]] = []
        self.arrays: tuple[np.ndarray, ...] | None = None

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_EDGES) or word
        lower = core.lower()
        kind = LITERAL
        if _NUMBER.match(lower):
            kind = NUMBER
        elif lower.decode("utf-8", "replace") in _UNIT_SET:
            kind = UNIT
        else:
            letters = core.decode("utf-8", "replace")
            if len(letters) > 1 and letters[0].isupper() and letters[1:].islower():
                kind = NAME
        value = xxhash.xxh64_intdigest(lower.decode("utf-8", "replace").lower())
        self.rows.append((value | 1, value, kind, word.rstrip(b"\"')]*#$%&|")[-1:] in (b".", b"?", b"!", b":")))
        self[word] = len(self.rows) - 1
        return len(self.rows) - 1

    def columns(self) -> tuple[np.ndarray, ...]:
        if self.arrays is None or len(self.arrays[0]) < len(self.rows):
            lit, value, kind, ends = zip(*self.rows, strict=True)
            self.arrays = (np.array(lit, np.uint64), np.array(value, np.uint64), np.array(kind, np.int8), np.array(ends, bool))
        return self.arrays


_UNIT_SET = frozenset(UNITS)


def template(ids: np.ndarray, first: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word that each token begins with, token hashes, slot values): a literal has slot value zero, a run of names is
    one token. ``first``: True where a text begins."""
    lit, value, kind, ends = (a[ids] for a in lexicon.columns())
    before_number = np.concatenate(([False], kind[:-1] == NUMBER)) & ~first
    inside = np.concatenate(([False], ~ends[:-1])) & ~first
    kind = np.where((kind == UNIT) & ~before_number, LITERAL, kind)
    kind = np.where((kind == NAME) & ~inside, LITERAL, kind)
    begins = np.flatnonzero(np.concatenate(([True], ~((kind[1:] == NAME) & (kind[:-1] == NAME)))) | first)
    turn = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
    value = np.add.reduceat(value * (2 * turn.astype(np.uint64) + np.uint64(1)), begins) if len(ids) else value
    kind, lit = kind[begins], lit[begins]
    return begins, np.where(kind == LITERAL, lit, _PLACE[kind]), np.where(kind == LITERAL, np.uint64(0), value | np.uint64(1))


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    n = len(tokens) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    for j in range(width):
        h *= _STEP
        h += tokens[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def windows(table: DataFrame, id_col: str, text_col: str, widths: list[int], whole_short: bool = False, keep: np.ndarray | None = None) -> DataFrame:
    """(id, pos, width, hash, slots, n_tokens) of template windows; ``keep``: a bit table that hashes must hit.

    With ``whole_short`` a text shorter than the greatest width gives one window of its own length instead. Positions
    and lengths count tokens, of which a run of names is one. Negative widths are windows of words as they stand,
    whose positions and lengths count words; with ``whole_short`` texts of few tokens give those as well.
    """

    def packed(names: np.ndarray, place: np.ndarray, width: int, h: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        each = len(values) // max(len(names), 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names),
                pa.array(place.astype(np.int32)),
                pa.array(np.full(len(names), width, np.int32)),
                pa.array(h.view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * each), pa.array(values)),
                pa.array(lengths.astype(np.int32)),
            ],
            ["id", "pos", "width", "hash", "slots", "n_tokens"],
        )

    def held(h: np.ndarray, good: np.ndarray) -> np.ndarray:
        if keep is not None:
            low = h & np.uint64(64 * len(keep) - 1)
            good = good & ((keep[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1) == 1)
        return np.flatnonzero(good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        pending: list[tuple[int, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not pending:
                return
            lengths = np.array([len(x) for _, x in pending])
            ids = np.concatenate([x for _, x in pending])
            owner = np.repeat(np.arange(len(pending)), lengths)
            word_owner, word_lengths = owner, lengths
            begins, tokens, slots = template(ids, np.concatenate(([True], owner[1:] != owner[:-1])), lexicon)
            owner = owner[begins]
            lengths = np.bincount(owner, minlength=len(pending))
            place = np.arange(len(owner)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            valued = np.where(slots == 0, tokens, slots * _STEP)
            literal = np.concatenate(([0], np.cumsum(slots == 0)))
            names = np.array([k for k, _ in pending], np.int64)
            for width in (w for w in widths if w > 0):
                n = len(owner) - width + 1
                if n <= 0:
                    continue
                good = owner[:n] == owner[width - 1 :]
                told = literal[width:] - literal[:n] >= np.ceil(LITERAL_SHARE * width)
                if whole_short:
                    good &= (lengths[owner[:n]] == width) | (width == max(widths))
                h = np.where(told, window_hashes(tokens, width), window_hashes(valued, width))
                hit = held(h, good)
                for at in range(0, len(hit), 20_000):
                    some = hit[at : at + 20_000]
                    values = slots[some[:, None] + np.arange(width)].view(np.int64).ravel()
                    yield packed(names[owner[some]], place[some], width, h[some], values, lengths[owner[some]])
            wordwise = range(LEAST_TOKENS, WIDTH + 1) if whole_short else [-w for w in widths if w < 0]
            for width in wordwise:
                n = len(word_owner) - width + 1
                if n <= 0:
                    continue
                good = word_owner[:n] == word_owner[width - 1 :]
                if whole_short:
                    good &= (lengths[word_owner[:n]] < WORDWISE_TOKENS) & (np.minimum(word_lengths[word_owner[:n]], WIDTH) == width)
                h = window_hashes(lexicon.columns()[1][ids], width)
                hit = held(h, good)
                first = np.cumsum(word_lengths) - word_lengths
                for at in range(0, len(hit), 20_000):
                    some = hit[at : at + 20_000]
                    who = word_owner[some]
                    yield packed(names[who], some - first[who], -width, h[some], np.zeros(0, np.int64), word_lengths[who])
            pending.clear()

        n_words = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, text_bytes(batch.column(1)), strict=True):
                words = text.split()
                if key is None or len(words) < LEAST_TOKENS:
                    continue
                pending.append((key, np.fromiter(map(lexicon.__getitem__, words), np.int32, len(words))))
                n_words += len(words)
                if n_words >= FLUSH_WORDS:
                    yield from flush()
                    n_words = 0
                    if len(lexicon) > CACHE_WORDS:
                        lexicon = Lexicon()
        yield from flush()

    source = table.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, pos int, width int, hash long, slots array<long>, n_tokens int")


def bit_table(hashes: DataFrame, n: int) -> np.ndarray:
    """A filter with a bit set for every one of ``n`` hashes."""
    bits = min(MOST_BITS, max(16, (BITS_EACH * n).bit_length()))
    low = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1))
    words = hashes.select(F.shiftright(low, 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return table.view(np.uint64)


def _torn(pairs: Column) -> Column:
    """The item's slot values that stand for more than one value of the document."""
    distinct = F.array_distinct(pairs)
    return F.transform(F.filter(distinct, lambda x: F.exists(distinct, lambda y: (y["i"] == x["i"]) & (y["d"] != x["d"]))), lambda x: x["i"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, n_windows, covered, item_tokens,
    slots_changed (true if a number, unit or name differs from the item's: a re-parameterised question).

    A pair counts if consistent windows cover COVER_TOKENS of the item's tokens, or COVER_SHARE of a shorter item. Items
    under LEAST_TOKENS words match nothing. Items of few tokens, such as lists of names, are sought word for word as
    well; then covered and item_tokens count words. Windows that are mostly numbers and names match word for word only;
    so an item made of such windows is found as a copy, not with new values. Null or empty texts and rows with a null id
    match nothing; rows that share an id, equal or not, count as one document's parts; texts of any length are read
    whole; an empty table on either side gives an empty result; other columns, whatever their names, are not read.
    The benchmark, of any size, is joined by hash, a window that many documents hold being dealt to several tasks, and
    only windows that pass a bit table made from it are ever shuffled.
    """
    widths = list(range(LEAST_TOKENS, WIDTH + 1))
    items = durable(windows(benchmark, item_col, item_text_col, widths, whole_short=True))
    used = [r["width"] for r in items.select("width").distinct().collect()]
    found = windows(docs, id_col, text_col, sorted(used) or [WIDTH], keep=bit_table(items, items.count()))
    right = items.select(
        F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "width", "hash", F.col("slots").alias("item_slots"), F.col("n_tokens").alias("item_tokens")
    )
    pairs = found.select(F.col("id").alias("doc_id"), "pos", "width", "hash", "slots")
    pairs = spread_join(pairs, right, ["width", "hash"], "doc_id")
    both = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda x: x["i"] != 0)
    pairs = pairs.withColumns({"both": both, "shift": F.col("pos") - F.col("item_pos")})
    # windows at one shift are one reading of the item: a value of the item must stand for one value all along, or else
    # the windows that hold it don't count, unless they are the item's word for word
    window = F.struct("item_pos", "width", F.transform("both", lambda x: x["i"]).alias("own"), F.exists("both", lambda x: x["i"] != x["d"]).alias("changed"))
    readings = pairs.groupBy("doc_id", "item_id", "item_tokens", "shift").agg(
        F.array_distinct(F.flatten(F.collect_list("both"))).alias("values"), F.collect_list(window).alias("windows")
    )
    torn = readings.withColumn("torn", _torn(F.col("values")))
    kept = F.filter("windows", lambda w: ~w["changed"] | ~F.arrays_overlap(w["own"], F.col("torn")))
    good = torn.select("doc_id", "item_id", "item_tokens", F.explode(kept).alias("w")).select("doc_id", "item_id", "item_tokens", "w.item_pos", "w.width", "w.changed")
    # one row for each window of the item first, so that a document that repeats it adds nothing to the lists
    hits = good.groupBy("doc_id", "item_id", "item_pos", "width", "item_tokens").agg(F.count("*").alias("n"), F.min("changed").alias("changed"))
    spans = F.array_distinct(F.flatten(F.collect_list(F.sequence("item_pos", F.col("item_pos") + F.abs("width") - 1))))
    per_kind = hits.groupBy("doc_id", "item_id", "item_tokens", (F.col("width") < 0).alias("wordwise")).agg(
        F.sum("n").alias("n_windows"), F.size(spans).alias("covered"), F.max("changed").alias("slots_changed")
    )
    enough = F.col("covered") >= F.least(F.lit(COVER_TOKENS), F.ceil(F.col("item_tokens") * COVER_SHARE))
    per_pair = per_kind.where(enough).groupBy("doc_id", "item_id").agg(F.min(F.struct("wordwise", "n_windows", "covered", "item_tokens", "slots_changed")).alias("k"))
    return per_pair.select("doc_id", "item_id", "k.n_windows", F.col("k.covered").cast("long").alias("covered"), F.col("k.item_tokens").cast("long").alias("item_tokens"), "k.slots_changed")


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows with a null id, which no item is found in, are kept.

    Null and empty texts hold nothing and stay, equal rows go or stay together, long texts are searched whole; rows
    that share an id go if any of them holds an item. Columns, whatever their names, stay as they are; an empty table
    on either side takes nothing away.
    """
    (leak,) = fresh_names(docs, 1)
    leaks = find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(leaks, docs[id_col].cast("long") == leaks[leak], "left_anti")
