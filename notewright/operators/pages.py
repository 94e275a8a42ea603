"""Page artifacts: embedded images, vision zones, handwritten orders, profile photos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.functions.scores import photo_score
from notewright.functions.text import filled, nz, whitespace
from notewright.operators.extract import expand_short_forms, meaningful_order

# Fixed values: (role, zone, x0, y0, x1, y1) of the page sweep, as shares of the page.
SWEEP_ZONES = [
    ("identity", "full_header", 0.02, 0.00, 0.98, 0.24),
    ("identity", "case_header_left", 0.00, 0.00, 0.36, 0.24),
    ("identity", "case_header_right", 0.30, 0.00, 0.98, 0.24),
    ("vitals", "left_vitals_column", 0.00, 0.20, 0.22, 0.92),
    ("orders", "main_order_area", 0.20, 0.20, 0.98, 0.92),
    ("orders", "upper_orders", 0.20, 0.24, 0.98, 0.50),
    ("orders", "middle_orders", 0.20, 0.42, 0.98, 0.70),
    ("orders", "lower_orders", 0.20, 0.62, 0.98, 0.92),
    ("orders", "center_left_orders", 0.20, 0.25, 0.62, 0.82),
    ("orders", "center_right_orders", 0.55, 0.25, 0.98, 0.82),
    ("table", "full_body_grid", 0.00, 0.20, 0.98, 0.98),
]

# Zones of pages without usable boxes, and of order charts.
ORDER_ZONES = [
    ("vitals", 0.00, 0.20, 0.24, 0.92),
    ("orders", 0.20, 0.20, 0.98, 0.92),
    ("orders", 0.20, 0.24, 0.98, 0.52),
    ("orders", 0.20, 0.48, 0.98, 0.76),
    ("orders", 0.20, 0.68, 0.98, 0.95),
]
CHART_ZONES = [
    ("orders", 0.02, 0.12, 0.98, 0.95),
    ("orders", 0.18, 0.16, 0.98, 0.88),
    ("orders", 0.00, 0.24, 0.42, 0.96),
]

# The place of the photo where no image fits, as shares of the page.
PHOTO_PLACE = (0.06, 0.24, 0.25, 0.43)


def append_image_text(pages: DataFrame, images: DataFrame, keys: list[str], least_pixels: int = 40_000) -> DataFrame:
    """``pages`` (keys, text, source) with the texts read from their embedded images (keys, image_ix, width, height,
    image_text) behind their own, and ``+img`` behind the source. Smaller images don't count."""
    large = images.where((F.col("width").cast("long") * F.col("height") >= least_pixels) & (F.trim(filled("image_text")) != ""))
    ordered = F.array_sort(F.collect_list(F.struct("image_ix", F.trim("image_text").alias("t"))))
    read = large.groupBy(*keys).agg(whitespace(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n")).alias("__read"))
    joined = pages.join(read, keys, "left")
    added = filled("__read") != ""
    text = F.when(added & (filled("text") != ""), F.concat_ws("\n\n", "text", "__read")).when(added, F.col("__read")).otherwise(F.col("text"))
    return joined.withColumns({"text": text, "source": F.when(added, F.concat("source", F.lit("+img"))).otherwise(F.col("source"))}).drop("__read")


def image_artifacts(blocks: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, image_ix, artifact_type, role, backend, confidence, reading_order): one artifact per embedded image, in
    order behind the last block of its page; pages without blocks begin at one."""
    last = blocks.groupBy(*keys).agg(F.max("reading_order").alias("__last"))
    out = images.select(*keys, "image_ix").join(last, keys, "left")
    order = F.coalesce("__last", F.lit(0)) + F.col("image_ix")
    return out.select(
        *keys, "image_ix", F.lit("image").alias("artifact_type"), F.lit("embedded_figure").alias("role"), F.lit("embedded_image").alias("backend"),
        F.lit(0.0).alias("confidence"), order.cast("long").alias("reading_order"),
    )


def blank_crop(gray: Column, least: float = 7.0) -> Column:
    """Whether a crop's gray values (array of int) deviate by less than ``least``; no value is blank too.

    The deviation is that of the population, compared by squares of whole numbers, so that ties are exact.
    """
    n = F.size(gray).cast("long")
    s = F.aggregate(gray, F.lit(0).cast("long"), lambda a, x: a + x)
    q = F.aggregate(gray, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    return (F.coalesce(n, F.lit(0)) <= 0) | (n * q - s * s < least * least * n * n)


def vision_crops(pages: DataFrame, doc: str, page: str, zones: list[tuple] = SWEEP_ZONES, max_crops: int = 16, max_pages: int = 4) -> DataFrame:
    """``pages`` (with width and height) times the sweep's zones: zone_no, role, zone, x0, y0, x1, y1. The first
    ``max_pages`` pages of a document and ``max_crops`` zones of a page are the sweep's budget."""
    table = F.array(*[F.struct(F.lit(i).alias("zone_no"), F.lit(r).alias("role"), F.lit(z).alias("zone"), *[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), b)]) for i, (r, z, *b) in enumerate(zones[:max_crops], 1)])
    ranked = pages.withColumn("__p", F.dense_rank().over(Window.partitionBy(doc).orderBy(page))).where(F.col("__p") <= max_pages).drop("__p")
    place = [F.round(F.col(f"__z.{k}") * F.col("width" if k[0] == "x" else "height"), 2).alias(k) for k in ("x0", "y0", "x1", "y1")]
    return ranked.withColumn("__z", F.explode(table)).select(*pages.columns, "__z.zone_no", "__z.role", "__z.zone", *place)


def sweep_artifacts(crops: DataFrame, backend: str, least_chars: int = 3, least_deviation: float = 7.0, sure: float = 0.72) -> DataFrame:
    """Read crops (zone_no, role, gray, text, confidence) to artifacts behind the page's blocks, from 5000 on; blank
    crops and texts under ``least_chars`` go."""
    read = crops.where(~blank_crop(F.col("gray"), least_deviation))
    # a generator's output is computed once; a column that a filter reads would be computed for the filter too
    clean = read.select(*[c for c in read.columns if c not in ("text", "gray")], F.explode(F.array(whitespace(F.col("text")))).alias("text"))
    read = clean.where(F.length("text") >= least_chars)
    kind = F.when(F.col("role").isin("orders", "vitals", "identity"), "handwriting").otherwise("text_block")
    return read.withColumns(
        {
            "artifact_type": kind, "backend": F.lit(backend), "reading_order": (5000 + F.col("zone_no")).cast("long"),
            "confidence": F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(sure)),
        }
    )


def best_drug(order: Column) -> Column:
    """The drug that an order names, or else its first candidate; empty without either."""
    return F.coalesce(nz(whitespace(order["drug"])), F.get(order["drug_candidates"], F.lit(0))["normalized"], F.lit(""))


def order_lines(orders: Column, vitals: Column, fields: Column, raw: Column) -> Column:
    """The text of a handwriting artifact, a line for each meaningful order (drug, expanded_text, raw_text, text,
    drug_candidates), vital and field (label, value); the raw text with its short forms expanded where there is none.
    Null without any text."""
    none = F.array().cast("array<string>")
    pick = lambda o: F.coalesce(*[nz(whitespace(o[k])) for k in ("expanded_text", "raw_text", "text")], F.lit(""))

    def order_line(o: Column) -> Column:
        drug, shown = best_drug(o), pick(o)
        named = F.when((drug != "") & ~F.contains(F.lower(shown), F.lower(drug)), F.concat(drug, F.lit(": "), shown)).otherwise(shown)
        return F.when(meaningful_order(shown, drug) & (named != ""), F.concat(F.lit("Medication order: "), named))

    both = lambda x: (filled(x["label"]) != "") & (filled(x["value"]) != "")
    lines = F.concat(
        F.coalesce(F.transform(orders, order_line), none),
        F.coalesce(F.transform(vitals, lambda x: F.when(both(x), F.concat(F.lit("Vital: "), x["label"], F.lit(" "), x["value"]))), none),
        F.coalesce(F.transform(fields, lambda x: F.when(both(x), F.concat(x["label"], F.lit(": "), x["value"]))), none),
    )
    joined = F.array_join(F.array_compact(lines), "\n")
    return nz(whitespace(F.when(joined != "", joined).otherwise(expand_short_forms(whitespace(raw)))))


def photo_fits(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Whether an image can be the photo: below the top, to the left, neither tiny nor a scan, about upright."""
    area = (x1 - x0) * (y1 - y0) / F.greatest(width * height, F.lit(1.0))
    aspect = (x1 - x0) / F.greatest(y1 - y0, F.lit(1.0))
    return (x1 > x0) & (y1 > y0) & (y0 >= 0.12 * height) & (x0 <= 0.35 * width) & area.between(0.0008, 0.05) & aspect.between(0.35, 1.35)


def profile_photos(pages: DataFrame, images: DataFrame, doc: str) -> DataFrame:
    """(doc, method, image_ix, x0, y0, x1, y1): each document's best fitting image of its first page, the first of
    equals, or else the fixed place. ``pages``: doc, width, height of the first page; ``images``: doc, image_ix, box."""
    c = F.col
    box = [c(k) for k in ("x0", "y0", "x1", "y1")]
    sized = images.select(doc, "image_ix", "x0", "y0", "x1", "y1").join(pages.select(doc, "width", "height"), doc)
    fit = sized.where(photo_fits(*box, c("width"), c("height"))).withColumn("s", F.round(photo_score(*box, c("width"), c("height")), 6))
    best = fit.groupBy(doc).agg(F.max_by(F.struct("image_ix", "x0", "y0", "x1", "y1"), F.struct("s", -c("image_ix"))).alias("b"))
    place = [
        F.coalesce(f"b.{k}", F.round(share * c("width" if k[0] == "x" else "height"), 2)).alias(k)
        for k, share in zip(("x0", "y0", "x1", "y1"), PHOTO_PLACE)
    ]
    found = F.when(c("b").isNotNull(), "embedded_image").otherwise("page_crop_fallback")
    return pages.select(doc, "width", "height").join(best, doc, "left").select(doc, found.alias("method"), "b.image_ix", *place)
