"""Blocks and crops of a page: native text blocks, the reading that is kept, boxes of polygons, crops for order readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.functions import scores
from notewright.functions.text import SPACES, filled, whitespace, with_value
from notewright.operators.orders import crop_priority, order_signal
from notewright.operators.pages import CHART_ZONES, ORDER_ZONES

BOX = ("x0", "y0", "x1", "y1")
#: Roles that are never cropped, roles that a crop keeps, kinds of artifact that are cropped, the text from
#: which on an artifact without an order signal is prose, and what a chart's zones stand for.
NO_CROP = ["header", "footer", "title", "figure"]
CROP_ROLES = ["orders", "vitals", "body", "table"]
CROP_TYPES = ["page_region", "table", "text_block", "handwriting"]
LONG_TEXT = 140
SHOWN_TEXT = 250
CHART_TEXT = "staff nurse medicines injections chart"


def native_blocks(blocks: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Artifact rows of a page's own text blocks: ``blocks`` has BOX, page_height, selected_source, and ``order``, the
    block's place. Blocks without text are left out and not counted in reading_order, which begins at one. Text of a
    native page is sure (1.0), of any other 0.65; a page without a known source is native."""
    native = F.startswith(F.coalesce("selected_source", F.lit("native")), F.lit("native"))
    kept = blocks.withColumn(text, whitespace(F.col(text))).where(F.col(text) != "").withColumns({k: F.round(k, 2) for k in BOX})
    w = Window.partitionBy(*keys).orderBy(order)
    return kept.select(
        *keys, F.row_number().over(w).alias("reading_order"), F.lit("text_block").alias("artifact_type"),
        scores.block_role(F.col("y0"), F.col("y1"), F.col("page_height"), F.col(text)).alias("role"), F.when(native, "native").otherwise("mixed").alias("backend"),
        F.col(text).alias("text"), F.when(native, 1.0).otherwise(0.65).alias("confidence"), F.array(*BOX).alias("bbox"),
    )


def choose_reading(readings: DataFrame, keys: list[str], order: str, sweep: bool = False) -> DataFrame:
    """(keys, backend, text, confidence, n_candidates): of a crop's readings (backend, text, confidence) with a text the
    best. That is the surest, of equally sure ones the longest; in a ``sweep`` the one whose confidence and length,
    120 characters counting as one, add up to most. The first by ``order`` wins a tie. ``confidence`` is the highest of
    all candidates; a crop without a text gives an empty one at 0.0. Partial results combine before the shuffle."""
    sure = F.coalesce("confidence", F.lit(0.0))
    t = whitespace(F.col("text")) if sweep else filled("text")
    r = readings.select(*keys, "backend", t.alias("text"), sure.alias("confidence"), F.col(order).alias("__o"))
    there = F.col("text") != ""
    long = F.length("text")
    rank = F.struct(F.col("confidence") + F.least(long, F.lit(120)) / 120.0, -F.col("__o")) if sweep else F.struct("confidence", long, -F.col("__o"))
    best = F.max_by(F.struct("backend", "text"), F.when(there, rank))
    g = r.groupBy(*keys).agg(best.alias("b"), F.coalesce(F.max(F.when(there, F.col("confidence"))), F.lit(0.0)).alias("confidence"), F.count_if(there).alias("n_candidates"))
    return g.select(*keys, "b.backend", filled("b.text").alias("text"), "confidence", "n_candidates")


def box_of_points(points: Column) -> Column:
    """[x0, y0, x1, y1] around an array of points; points of fewer than two numbers don't count, null without any."""
    whole = F.filter(points, lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
    side = lambda pick, i: pick(F.transform(whole, lambda p: p[i].cast("double")))
    return F.when(F.size(whole) > 0, F.array(side(F.array_min, 0), side(F.array_min, 1), side(F.array_max, 0), side(F.array_max, 1)))


def scale_box(box: Column, sx: Column, sy: Column) -> Column:
    """A box of four numbers in another page's units, to two decimals; null for any other array."""
    return F.when(F.size(box) == 4, F.array(*[F.round(F.get(box, F.lit(i)) * (sy if i % 2 else sx), 2) for i in range(4)]))


def _zones(zones: list[tuple], stage: int, backend: str, source_type: str, text: str) -> Column:
    side = lambda v, k: F.round(F.lit(float(v)) * F.col("width" if k[0] == "x" else "height"), 2).alias(k)
    return F.array(*[
        F.struct(F.lit(role).alias("role"), *[side(v, k) for v, k in zip(b, BOX, strict=True)], F.lit(backend).alias("source_backend"), F.lit(source_type).alias("source_type"),
                 F.lit(text).alias("source_text"), F.lit(stage).alias("stage"), F.lit(i).cast("long").alias("place"))
        for i, (role, *b) in enumerate(zones)
    ])


def order_crops(pages: DataFrame, artifacts: DataFrame, keys: list[str], order: list[str], cap: int = 8, grow: tuple[float, float] = (18.0, 14.0), least_area: float = 9000.0) -> DataFrame:
    """(keys, crop, role, BOX, source_backend, source_type): the crops of each page that an order reader is given.

    ``pages`` has width and height, ``artifacts`` BOX, role, artifact_type, backend, text, and the columns ``order`` that
    settle their place. Artifacts give grown boxes, clipped to the page; then come a chart's zones, where the page's
    texts show one, and the fixed zones, on every page. Of boxes that are equal in units of eight the first stays; the
    first ``cap`` of a page by priority, top and left are given. A box that is inside out or lacks a side is none; the
    cap is the feature. A page's texts are never put together in one row: words that two texts share are found by
    looking back one row.
    """
    a = artifacts.join(pages.select(*keys, "width", "height"), keys).where("x1 > x0 and y1 > y0")
    a = a.withColumns({k: F.greatest(F.lit(0.0), F.least(F.col("width" if k[0] == "x" else "height"), F.col(k))) for k in BOX})
    # a text that is nothing but space is told by its characters: the patterns would run once more for it
    some = F.btrim(filled("text"), F.lit(SPACES + "\x00")) != ""
    a = a.withColumns({"text": whitespace(F.col("text")), "__some": some, "role": F.lower(filled("role")), "artifact_type": filled("artifact_type")})

    w = Window.partitionBy(*keys).orderBy(*order)
    t = F.lower("text")
    given = F.contains(t, F.lit("medicine")) | F.contains(t, F.lit("injection"))
    # what is sought in a text is found before rows are moved and sorted: no text is in the window
    said = a.where("__some").select(*keys, *order, F.contains(t, F.lit("staff nurse")).alias("whole"), F.endswith(t, F.lit("staff")).alias("staff"), F.startswith(t, F.lit("nurse")).alias("nurse"), given.alias("given"))
    read = said.withColumn("split", F.coalesce(F.lag("staff").over(w) & F.col("nurse"), F.lit(False)))
    nurse, given = F.max(F.col("whole") | F.col("split")), F.max("given")
    charts = read.groupBy(*keys).agg((nurse & given).alias("chart")).where("chart").select(*keys)

    gx, gy = grow
    prose = with_value(F.col("text"), lambda x: (F.length(x) > LONG_TEXT) & ~order_signal(x))
    grown = a.where(~F.col("role").isin(NO_CROP) & F.col("artifact_type").isin(CROP_TYPES) & ~prose).withColumns({
        "x0": F.round(F.greatest(F.lit(0.0), F.col("x0") - gx), 2), "y0": F.round(F.greatest(F.lit(0.0), F.col("y0") - gy), 2),
        "x1": F.round(F.least(F.col("width"), F.col("x1") + gx), 2), "y1": F.round(F.least(F.col("height"), F.col("y1") + gy), 2),
    })
    grown = grown.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= least_area)
    boxes = grown.select(
        *keys, F.when(F.col("role").isin(CROP_ROLES), F.col("role")).otherwise("orders").alias("role"), *BOX, filled("backend").alias("source_backend"),
        F.col("artifact_type").alias("source_type"), F.left("text", F.lit(SHOWN_TEXT)).alias("source_text"), F.lit(0).alias("stage"), F.row_number().over(w).cast("long").alias("place"),
    )
    chart = pages.join(charts, keys, "left_semi").select(*keys, F.inline(_zones(CHART_ZONES, 1, "chart_page_signal", "page_region", CHART_TEXT)))
    fixed = pages.select(*keys, F.inline(_zones(ORDER_ZONES, 2, "fallback_zone", "region", "")))
    every = boxes.unionByName(chart).unionByName(fixed)

    near = [F.bround(F.col(k) / 8).cast("long") for k in BOX]
    first = every.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, *near).orderBy("stage", "place"))).where("__n = 1")
    best = Window.partitionBy(*keys).orderBy(crop_priority(F.col("role"), F.col("source_type"), F.col("source_text")), "y0", "x0", "stage", "place")
    return first.withColumn("crop", F.row_number().over(best)).where(F.col("crop") <= cap).select(*keys, "crop", "role", *BOX, "source_backend", "source_type")
