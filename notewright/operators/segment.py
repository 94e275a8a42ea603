"""Pages to notes: section splits, layout islands, exact dedup, triage and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.functions import scores, vocab
from notewright.functions.text import clean_block, nz, strip, text_hash, word_count

MARK = "\x01"


def note_id(page: Column, ix: Column) -> Column:
    return F.format_string("p%04d_n%03d", page.cast("int"), ix.cast("int"))


def split_sections(pages: DataFrame, text: str = "text", min_words: int = 12) -> DataFrame:
    """One row per note: the columns of ``pages`` but the text, and note_ix, note. A header begins a note; the
    index counts the pieces dropped for having fewer than ``min_words`` words too."""
    # what no header begins with is passed over before any header is tried
    begins = "(?=[" + "".join(sorted({x for p in vocab.SECTION_STARTS for x in p.removeprefix(r"\b")[0].lower() + p.removeprefix(r"\b")[0].upper()})) + "])"
    marked = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), begins + "(?i)(" + "|".join(vocab.SECTION_STARTS) + ")", MARK + "$1")
    pieces = F.filter(F.transform(F.split(marked, MARK), strip), lambda x: x != "")
    rest = [c for c in pages.columns if c != text]
    notes = pages.select(*rest, F.posexplode(pieces).alias("note_ix", "note"))
    return notes.withColumn("note_ix", F.col("note_ix") + 1).where(word_count(F.col("note")) >= min_words)


def first_of_equal(notes: DataFrame, keys: list[str], order: list[str], text: str = "note") -> DataFrame:
    """Of notes with equal text in a document, the first."""
    hashed = notes.withColumn("text_hash", text_hash(F.col(text)))
    w = Window.partitionBy(*keys, "text_hash").orderBy(*order)
    return hashed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def layout_islands(blocks: DataFrame, keys: list[str], gap: float = 42.0) -> DataFrame:
    """``blocks`` with ``island``: by place on the page, a new one begins where the next block's top lies more than
    ``gap`` below the last block's bottom. Needs columns top, bottom, reading_order."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("top", F.lit(0.0)), "reading_order")
    jump = F.col("top") - F.lag("bottom").over(w) > gap
    return blocks.withColumn("__j", F.coalesce(jump, F.lit(False)).cast("long")).withColumn("island", F.sum("__j").over(w) + 1).drop("__j")


def join_islands(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """One note per island: text, number of blocks, their sorted roles and ids in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.coalesce("top", F.lit(0.0)).alias("t"), "reading_order", "text", "block_id")))
    return (
        blocks.groupBy(*keys, "island")
        .agg(parts.alias("p"), F.array_sort(F.collect_set("role")).alias("roles"), F.count("*").alias("n_blocks"))
        .select(
            *keys, "island", "roles", "n_blocks",
            F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"),
            F.transform("p", lambda x: x["block_id"]).alias("block_ids"),
        )
    )


def layout_notes(artifacts: DataFrame, doc: str, page: str, gap: float = 42.0, min_words: int = 12) -> DataFrame:
    """Notes of a document's artifacts (artifact_type, role, top, bottom, reading_order, text, block_id): text blocks and
    handwriting outside headers and footers, joined by their place on the page and cleaned. The index counts the pieces
    of a page that are dropped too, for few words or for a text that an earlier note of the document has."""
    outside = ~F.coalesce(F.col("role").isin("header", "footer"), F.lit(False))
    top = F.coalesce("top", F.lit(0.0))
    kept = artifacts.where(F.col("artifact_type").isin("text_block", "handwriting") & outside)
    kept = kept.withColumns({"top": top, "bottom": F.coalesce(F.col("bottom"), top), "text": nz(F.col("text")), "role": nz(F.col("role"))})
    joined = join_islands(layout_islands(kept, [doc, page], gap), [doc, page]).withColumn("note", clean_block(F.col("text")))
    notes = joined.where(word_count(F.col("note")) >= min_words).withColumnRenamed("island", "note_ix").drop("text")
    return first_of_equal(notes, [doc], [page, "note_ix"]).withColumn("note_id", note_id(F.col(page), F.col("note_ix")))


def triage(notes: DataFrame, keys: list[str], cap: int = 40) -> DataFrame:
    """``notes`` (with needs_model, signal, words, note_ix) with state: resolved, unresolved or, beyond the cap per
    document, overflow; and the rank among those that need the model."""
    w = Window.partitionBy(*keys, "needs_model").orderBy(F.desc("signal"), F.desc("words"), "note_ix")
    ranked = notes.withColumn("rank", F.when(F.col("needs_model"), F.row_number().over(w)))
    state = F.when(~F.col("needs_model"), "resolved").when(F.col("rank") <= cap, "unresolved").otherwise("overflow")
    return ranked.withColumn("state", state)


def page_zones(pages: DataFrame, zones: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """Each page's fixed relative zones as boxes; the zone list is a constant of a few rows, so it's an array."""
    table = F.array(*[F.struct(F.lit(n).alias("zone"), *[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), b)]) for n, *b in zones])
    out = pages.withColumn("z", F.explode(table))
    return out.select(
        *pages.columns, "z.zone",
        *[F.round(F.col(f"z.{k}") * F.col("width" if k[0] == "x" else "height"), 2).alias(k) for k in ("x0", "y0", "x1", "y1")],
    )


def candidate_crops(boxes: DataFrame, keys: list[str], cap: int = 8, grow: tuple[float, float] = (18.0, 14.0), least_area: float = 9000.0) -> DataFrame:
    """Boxes grown and clipped to the page, small and near-equal ones dropped, the first ``cap`` of each page by
    priority. Needs x0, y0, x1, y1, width, height, priority, box_id."""
    gx, gy = grow
    b = boxes.withColumns(
        {
            "x0": F.greatest(F.col("x0") - gx, F.lit(0.0)), "y0": F.greatest(F.col("y0") - gy, F.lit(0.0)),
            "x1": F.least(F.col("x1") + gx, F.col("width")), "y1": F.least(F.col("y1") + gy, F.col("height")),
        }
    ).where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= least_area)
    near = [F.round(F.col(k) / 8).cast("long") for k in ("x0", "y0", "x1", "y1")]
    b = b.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, *near).orderBy("priority", "box_id"))).where("__n = 1")
    return b.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("priority", "box_id"))).where(F.col("rank") <= cap).drop("__n")
