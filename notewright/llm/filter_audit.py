"""Audit of how filters interact: what each removes in every order of them.

Each text's failures are one bit mask, so a part of the corpus is at most 32 counts. All orders of the filters are
visited by single swaps of neighbours; a swap changes two steps only, and those are counted anew from the mask cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import words_of

#: The filters by letter, bit i of a mask belonging to letter i.
FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts whose orders are counted together in a task.
PART_BLOCK = 64


def swap_walk(n: int) -> Iterator[int]:
    """Places i at which neighbours i and i + 1 are swapped to visit all orders of ``n`` things, each once.

    The largest thing runs through the others and turns round at the ends, where the others make one step of their own walk.
    """
    if n < 2:
        return
    down = True
    for step in [*swap_walk(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if step is not None:
            yield step + 1 if down else step
        down = not down


def failure_masks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(doc_id, part, digest, mask): which of the filters A to D each whole text fails, as bits, within its row."""
    s = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    )
    s = s.withColumn("w", words_of(F.col("t")))
    s = s.withColumns({"n_words": F.size("w"), "n_distinct": F.size(F.array_distinct("w"))}).drop("w")
    upper = F.length("t") - F.length(F.translate("t", UPPER, ""))
    bits = [F.col("n_words") < 200, 100 * F.col("n_distinct") < 50 * F.col("n_words"), 100 * upper > 3 * F.length("t"), F.col("t").rlike(r"[#$%&*|]")]
    mask = sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))
    return s.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failure mask, copies included.

    Copies are counted together before anything moves by text, so a text that a third of all rows hold is a few
    rows by then. A text fails E unless its id is the smallest that holds it.
    """
    judged = failure_masks(docs, id_col, text_col, part_col).groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("x"))
    known = judged.where("doc_id is not null").join(marks, "doc_id", "left").select("doc_id", "digest", "part", "mask", "n", *[F.coalesce(c, F.lit(0)).alias(c) for c in "qx"])
    nameless = judged.where("doc_id is null").select("doc_id", "digest", "part", "mask", "n", F.lit(0).alias("q"), F.lit(0).alias("x"))
    texts = known.unionByName(nameless).groupBy("digest", "part", "mask", "q", "x")
    texts = texts.agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("nameless"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("at_low")
    )
    first = F.min("low").over(Window.partitionBy("digest"))
    stays = F.coalesce("nameless", F.lit(0)) + F.when(F.col("low") == first, F.col("at_low")).otherwise(0)
    cells = texts.withColumn("stays", stays).select(
        "part", "q", "x", F.inline(F.array(F.struct(F.col("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("stays")).alias("n"))))
    )
    return cells.where("n > 0").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("q")).alias("good"), F.sum(F.col("n") * F.col("x")).alias("toxic"))


def walk_orders(cells: np.ndarray, filters: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(orders, steps, shapley) of parts by (part, count, mask) cells.

    ``steps`` is (part, order, step, figure), its figures kept, removed, redundant, unique_fails, good_lost and
    toxic_lost; ``shapley`` (part, filter) is what each filter removes over all orders.
    """
    k = len(filters)
    masks = np.arange(1 << k)
    order = list(range(k))
    now = np.zeros((len(cells), k, 6), np.int64)
    shapley = np.zeros((len(cells), k), np.int64)

    def renew(step: int) -> None:
        bit = 1 << order[step]
        before = sum(1 << f for f in order[:step])
        fails, gone = masks & bit != 0, masks & before != 0
        here = cells[:, :, fails & ~gone].sum(axis=2)
        now[:, step, 0] = cells[:, 0, ~fails & ~gone].sum(axis=1)
        now[:, step, 1] = here[:, 0]
        now[:, step, 2] = cells[:, 0, fails & gone].sum(axis=1)
        now[:, step, 3] = cells[:, 0, bit]
        now[:, step, 4:] = here[:, 1:]

    for step in range(k):
        renew(step)
    orders, steps = [], []
    for swap in [*swap_walk(k), None]:
        orders.append("".join(filters[f] for f in order))
        steps.append(now.copy())
        shapley[:, order] += now[:, :, 1]
        if swap is not None:
            order[swap], order[swap + 1] = order[swap + 1], order[swap]
            renew(swap)
            renew(swap + 1)
    return orders, np.stack(steps, axis=1), shapley


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, with counts of documents within the part; zeros included.

    Columns: part, filter_order, step (from 1), kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley. Null parts count as the empty one, null texts as empty texts, and empty texts are identical to each
    other. Rows of equal id and text are each counted and none is a copy of the other. A null id has no label and
    is neither smaller nor larger than another: such a row never fails E. An id with several labels is good, or
    toxic, if any of them says so. Very long texts are judged within their row; other columns are not read. Without
    documents there are no parts and no rows.
    """
    cells = mask_cells(docs, labels, id_col, text_col, part_col)
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 a part at most
    numbers = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]

    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, PART_BLOCK):
                names, held = b.column(0).slice(s, PART_BLOCK), b.column(1).slice(s, PART_BLOCK).to_pylist()
                table = np.zeros((len(held), 3, 1 << len(FILTERS)), np.int64)
                for i, row in enumerate(held):
                    for c in row:
                        table[i, :, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, steps, shapley = walk_orders(table)
                n, m, k = steps.shape[:3]
                letters = np.array([[FILTERS.index(x) for x in o] for o in orders])
                yield pa.record_batch(
                    [
                        names.take(pa.array(np.repeat(np.arange(n), m * k))),
                        pa.array(np.tile(np.repeat(np.array(orders, dtype=object), k), n), pa.string()),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n * m)),
                        *[pa.array(steps[:, :, :, j].ravel()) for j in range(len(numbers))],
                        pa.array(shapley[:, letters].ravel()),
                    ],
                    ["part", "filter_order", "step", *numbers, "shapley"],
                )

    return parts.mapInArrow(audit, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*numbers, "shapley"]))
