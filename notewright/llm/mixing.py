"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only.

Rows of a source are dealt into blocks. With a weight of k slots in P, block j of a source may not run before slot
floor(j*P/k) and must run before slot ceil((j+1)*P/k). k and P are whole and exact: they stand to each other as the
target weights do. Earliest deadline first orders the blocks on the driver, and each row finds its block's slot by a
join. At every slot each source is less than one block away from its target weight's share. When a source runs out, a
new phase begins with the remaining sources' weights scaled up to fill it. The order holds one entry a block; there
are about PLAN_BLOCKS blocks at most, whatever the input's size, since larger tables have larger blocks.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.llm.common import fresh_names

BLOCK_ROWS = 16
ALPHA = 0.5
#: Blocks of the driver's plan, but for one more a source: a table of more rows than BLOCK_ROWS times this has larger
#: blocks.
PLAN_BLOCKS = 1 << 20
#: Blocks in a row of the plan's table.
PLAN_CHUNK = 1024
#: Rows of a source that are ranked in one window.
BUCKET_ROWS = 1000


def exact_shares(weights: Mapping[str, float]) -> dict[str, int]:
    """The least whole numbers that stand to each other exactly as the weights do."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: x // common for s, x in whole.items()}


class _Standing:
    """Sources that still have blocks, heaviest first: runs of equal weight, by name within a run. A source or a run
    leaves in constant time, so a phase costs what runs in it and not what stands by."""

    def __init__(self, whole: Mapping[str, int]) -> None:
        self.total = sum(whole.values())
        self.weight = dict(whole)
        self.after: dict[str, str | None] = {}
        self.before: dict[str, str | None] = {}
        self.head: dict[int, str | None] = {}
        last: dict[int, str] = {}
        for s in sorted(whole):
            w = whole[s]
            self.after[s], self.before[s] = None, last.get(w)
            if w in last:
                self.after[last[w]] = s
            else:
                self.head[w] = s
            last[w] = s
        runs = sorted(self.head, reverse=True)
        self.lighter: dict[int, int | None] = dict(zip(runs, [*runs[1:], None], strict=True))
        self.heavier: dict[int, int | None] = dict(zip(runs, [None, *runs[:-1]], strict=True))
        self.heaviest = runs[0] if runs else None

    def leave(self, s: str) -> None:
        w, a, b = self.weight.pop(s), self.after.pop(s), self.before.pop(s)
        self.total -= w
        if a is not None:
            self.before[a] = b
        if b is not None:
            self.after[b] = a
        else:
            self.head[w] = a
        if self.head[w] is None:
            del self.head[w]
            lighter, heavier = self.lighter.pop(w), self.heavier.pop(w)
            if lighter is not None:
                self.heavier[lighter] = heavier
            if heavier is not None:
                self.lighter[heavier] = lighter
            else:
                self.heaviest = lighter


def _phase(standing: _Standing, left: dict[str, int], order: list[str]) -> None:
    """One phase onto ``order``, and the source that ends it leaves. All first blocks may run at once and are due by weight, so a run of
    equal weights enters the heap by its first source, and only when nothing in the heap is due before it."""
    period, weight, begin = standing.total, standing.weight, len(order)
    ready: list[tuple[int, str, int]] = []
    waiting: list[tuple[int, int, str, int]] = []
    run = standing.heaviest
    while True:
        now = len(order) - begin
        while waiting and waiting[0][0] <= now:
            _, due, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, j))
        while run is not None and (not ready or -(-period // run) <= ready[0][0]):
            heapq.heappush(ready, (-(-period // run), standing.head[run], 0))
            run = standing.lighter[run]
        due, s, j = heapq.heappop(ready)
        if due < now + 1:
            raise AssertionError("a block missed its deadline")
        if j == 0 and standing.after[s] is not None:
            heapq.heappush(ready, (due, standing.after[s], 0))
        order.append(s)
        left[s] -= 1
        if not left[s]:
            standing.leave(s)
            return
        w = weight[s]
        release, due = (j + 1) * period // w, -(-(j + 2) * period // w)
        heapq.heappush(waiting, (max(release, now + 1), due, s, j + 1))


def edf_phase(share: Mapping[str, int], left: Mapping[str, int]) -> list[str]:
    """Earliest deadline first: the source that runs in each slot, up to the slot in which the first source has run
    all the blocks that it has left."""
    order: list[str] = []
    _phase(_Standing(share), dict(left), order)
    return order


def plan_order(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[str]:
    """The source that runs in each slot until every block has run: one phase after another, each ending with the last
    block of one of its sources. Sources without a weight come last, in the shares of their blocks. A phase touches
    the sources that run in it, so the time grows with the blocks and not with phases times sources."""
    order: list[str] = []
    weighted = {s: weights[s] for s, n in blocks.items() if n > 0 and weights.get(s, 0.0) > 0}
    others = {s: float(n) for s, n in blocks.items() if n > 0 and s not in weighted}
    for group in (weighted, others):
        if group:
            left, standing = {s: blocks[s] for s in group}, _Standing(exact_shares(group))
            while standing.weight:
                _phase(standing, left, order)
    return order


def source_key(source: Column) -> Column:
    """A text key for each source; null is a source of its own."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), source.cast("string")))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    block_rows: int = BLOCK_ROWS,
    alpha: float = ALPHA,
    bucket_rows: int = BUCKET_ROWS,
    plan_blocks: int = PLAN_BLOCKS,
) -> DataFrame:
    """All rows of ``docs`` with ``mix_block`` (in its source), ``mix_slot`` and ``mix_position`` (0 to n-1).

    ``weights`` maps sources to target weights; without it a source of n rows weighs n ** alpha. Sources given no
    weight, or one of zero, follow after all weighted ones. The less-than-one-block bound is held against the target
    weights themselves, in every phase. A block has ``block_rows`` rows, or the table's rows divided by
    ``plan_blocks`` if those are more; the last block of a source may be short. Rows of a source run in the order of a
    hash of their id, rows of one id in the order of a hash of their other columns; rows equal in all are
    interchangeable, and only those are sure to be ranked in one task. A null source is a source of its own, a null id
    is an ordinary row, an empty text too. Nothing is dropped or repeated; an empty table gives an empty result.
    Columns named like one of the three are replaced, all others stay, whatever their names. Otherwise ranks are taken
    in hash buckets of about ``bucket_rows`` rows, and added up over the counts of the buckets, so no source meets in
    one task. The driver holds one number a source and the plan; its time grows with blocks and sources, not with their
    product.
    """
    spark = docs.sparkSession
    kept = docs.drop("mix_block", "mix_slot", "mix_position")
    src, one, two, bucket, buckets, rank, offset, chunk, slots, starts = fresh_names(kept, 10)
    key = source_key(F.col(source_col))
    counts = {r["s"]: r["n"] for r in docs.groupBy(key.alias("s")).agg(F.count("*").alias("n")).collect()}
    if weights is None:
        targets = {s: n**alpha for s, n in counts.items()}
    else:
        targets = {("-" if s is None else f"={s}"): float(w) for s, w in weights.items()}
    size = max(block_rows, -(-sum(counts.values()) // plan_blocks))
    order = plan_order({s: -(-n // size) for s, n in counts.items()}, targets)

    # each source's slots, and the position of the first row of each: short last blocks shift what follows
    own: dict[str, tuple[list[int], list[int]]] = {s: ([], []) for s in counts}
    at = 0
    for slot, s in enumerate(order):
        own[s][0].append(slot)
        own[s][1].append(at)
        at += min(size, counts[s] - (len(own[s][0]) - 1) * size)

    def literal_table(rows: list[dict], kind: str, names: list[str]) -> DataFrame:
        table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")).alias("x"))
        return F.broadcast(table.select(*[F.col(f"x.{k.split(':')[0]}").alias(n) for k, n in zip(kind.split(","), names, strict=True)]))

    sized = literal_table([{"s": s, "b": -(-n // bucket_rows)} for s, n in counts.items()], "s:string,b:long", [src, buckets])
    cut = [{"s": s, "c": i // PLAN_CHUNK, "at": x[i : i + PLAN_CHUNK], "first": y[i : i + PLAN_CHUNK]} for s, (x, y) in own.items() for i in range(0, len(x), PLAN_CHUNK)]
    plan = literal_table(cut, "s:string,c:long,at:array<long>,first:array<long>", [src, chunk, slots, starts])

    hashable = [c for c in kept.columns if c not in (id_col, source_col) and "map<" not in kept.schema[c].dataType.simpleString() and kept.schema[c].dataType.simpleString() != "variant"]
    rest = F.xxhash64(*hashable) if hashable else F.lit(0).cast("long")
    rows = kept.withColumns({src: key, one: F.xxhash64(id_col), two: rest}).join(sized, src)
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(one, two), F.col(buckets))).drop(buckets)
    before = Window.partitionBy(src).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(src, bucket).agg(F.count("*").alias(rank))
    offsets = sizes.select(src, bucket, F.coalesce(F.sum(rank).over(before), F.lit(0)).alias(offset))
    within = Window.partitionBy(src, bucket).orderBy(one, id_col, two)
    ranked = rows.withColumn(rank, F.row_number().over(within) - 1).join(offsets, [src, bucket]).withColumn(rank, (F.col(rank) + F.col(offset)).cast("long"))
    blocked = ranked.withColumn("mix_block", F.expr(f"{rank} div {size}")).withColumn(chunk, F.expr(f"mix_block div {PLAN_CHUNK}"))
    place = F.pmod(F.col("mix_block"), F.lit(PLAN_CHUNK)).cast("int")
    placed = blocked.join(plan, [src, chunk]).withColumns(
        {"mix_slot": F.get(slots, place), "mix_position": F.get(starts, place) + F.pmod(F.col(rank), F.lit(size))}
    )
    return placed.select(*kept.columns, "mix_block", "mix_slot", "mix_position")


def in_mixed_order(mixed: DataFrame, shard_rows: int = 4_000) -> DataFrame:
    """The mixed rows laid out for a reader: each task holds whole shards of consecutive positions, in order."""
    shard = F.floor(F.col("mix_position") / F.lit(shard_rows))
    return mixed.repartition(shard).sortWithinPartitions("mix_position")
