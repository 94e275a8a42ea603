"""Parsers' payloads of any shape as block rows, read as VARIANT values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.text import filled, strip, whitespace

#: Type and role of a layout label; any other label is a region with the label as its role.
LAYOUT_ROLES = {
    "doc_title": ("text_block", "title"),
    "paragraph_title": ("text_block", "section_header"),
    "text": ("text_block", "body"),
    "table": ("table", "table"),
    "image": ("figure", "figure"),
    "figure": ("figure", "figure"),
    "figure_title": ("text_block", "caption"),
    "formula": ("text_block", "formula"),
    "seal": ("stamp", "stamp"),
    "header": ("header", "header"),
    "footer": ("footer", "footer"),
}
#: The lists of a document tree as (field, type, confidence), and the types that need no text.
TREE = [("texts", "text_block", 0.85), ("tables", "table", 0.8), ("pictures", "figure", 0.7)]
TEXTLESS = ("table", "figure", "page_region")


def _get(v: Column, path: str, kind: str = "string") -> Column:
    """The value at a path if it has the kind asked for, else null; a JSON null is null."""
    return F.try_variant_get(v, path, kind)


def _list(v: Column, path: str) -> Column:
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _text(v: Column, path: str) -> Column:
    """A string at a path; numbers and objects are none."""
    return F.when(F.schema_of_variant(_get(v, path, "variant")) == "STRING", _get(v, path))


def _number_list(v: Column) -> Column:
    """Four numbers of a list, or the box around a polygon's points; null if it is neither."""
    items = F.try_variant_get(v, "$", "array<variant>")
    flat = F.transform(items, lambda x: F.try_variant_get(x, "$", "double"))
    points = F.filter(F.transform(items, lambda x: F.try_variant_get(x, "$", "array<double>")), lambda p: F.size(p) >= 2)
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    around = F.when(F.size(points) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    return F.when((F.size(flat) >= 4) & ~F.exists(F.slice(flat, 1, 4), lambda x: x.isNull()), F.slice(flat, 1, 4)).otherwise(around)


def bounding_box(v: Column) -> Column:
    """A box as four numbers, from a list, from l, t, r, b, from x0, y0, x1, y1, or around a polygon; else null."""
    named = [F.array(*[_get(v, f"$.{k}", "double") for k in keys]) for keys in (("l", "t", "r", "b"), ("x0", "y0", "x1", "y1"))]
    whole = [F.when(~F.exists(x, lambda e: e.isNull()), x) for x in named]
    return F.coalesce(_number_list(v), *whole)


def _tree_item(kind: str, sure: float):
    """A function from an item of a document tree to its block."""

    def block(x: Column) -> Column:
        label = F.lower(filled(_text(x, "$.label")))
        role = F.when(label.rlike("header|title"), "header").when(label.contains("footer"), "footer").when(label.contains("table"), "table").otherwise("body")
        text = F.coalesce(*[F.nullif(strip(filled(_text(x, f"$.{k}"))), F.lit("")) for k in ("text", "orig", "content")], F.lit(""))
        page = F.coalesce(F.nullif(_get(x, "$.prov[0].page_no", "int"), F.lit(0)), _get(x, "$.prov[0].page_num", "int"), F.lit(0))
        return F.struct(
            F.lit(kind).alias("artifact_type"), (F.lit("table") if kind == "table" else F.lit("embedded_figure") if kind == "figure" else role).alias("role"),
            (F.lit("") if kind == "figure" else text).alias("text"), F.lit(sure).alias("confidence"), page.alias("page_num"),
            bounding_box(_get(x, "$.prov[0].bbox", "variant")).alias("bbox"), F.lit(kind != "text_block").alias("textless"),
        )

    return block


def _tree_blocks(p: Column) -> Column:
    """Blocks of a document tree: texts, tables and pictures with a place on a page; every item counts for the order,
    texts without text give no block."""
    parts = [F.transform(_list(p, f"$.{field}"), _tree_item(kind, sure)) for field, kind, sure in TREE]
    ordered = F.transform(F.concat(*parts), lambda b, i: F.struct((i + 1).alias("reading_order"), b.alias("b")))
    return F.filter(ordered, lambda x: x["b"]["textless"] | (x["b"]["text"] != ""))


def _layout_blocks(p: Column, page: Column, sx: Column, sy: Column) -> Column:
    """Blocks of a page's layout result: boxes, parsed blocks and lines of text; only those kept count for the order."""
    res = F.coalesce(_get(p, "$.res", "variant"), p)
    boxes = F.transform(F.concat(_list(res, "$.layout_det_res.boxes"), _list(res, "$.parsing_res_list")), lambda x: _layout_item(x))
    scores, polygons = _list(res, "$.overall_ocr_res.rec_scores"), _first_list(res)
    lines = F.transform(
        _list(res, "$.overall_ocr_res.rec_texts"),
        lambda x, i: F.struct(
            F.lit("text").alias("label"), filled(F.try_variant_get(x, "$", "string")).alias("text"),
            F.coalesce(F.try_variant_get(F.get(scores, i), "$", "double"), F.lit(0.0)).alias("confidence"), bounding_box(F.get(polygons, i)).alias("bbox"),
        ),
    )
    kinds, roles = (F.create_map(*[F.lit(x) for k, v in LAYOUT_ROLES.items() for x in (k, v[i])]) for i in (0, 1))

    def block(x: Column) -> Column:
        scaled = F.when(F.size(x["bbox"]) >= 4, F.array(*[F.round(x["bbox"][i] * s, 2) for i, s in enumerate((sx, sy, sx, sy))]))
        return F.struct(
            F.coalesce(F.try_element_at(kinds, x["label"]), F.lit("page_region")).alias("artifact_type"), F.coalesce(F.try_element_at(roles, x["label"]), F.translate(x["label"], " ", "_")).alias("role"),
            whitespace(x["text"]).alias("text"), x["confidence"].alias("confidence"), page.cast("int").alias("page_num"), scaled.alias("bbox"),
        )

    kept = F.filter(F.transform(F.concat(boxes, lines), block), lambda b: (b["text"] != "") | b["artifact_type"].isin(*TEXTLESS))
    return F.transform(kept, lambda b, i: F.struct((i + 1).alias("reading_order"), F.struct(*[b[c].alias(c) for c in ("artifact_type", "role", "text", "confidence", "page_num", "bbox")], F.lit(True).alias("textless")).alias("b")))


def _first_list(res: Column) -> Column:
    """The boxes of the lines, or else their polygons."""
    boxes, polygons = _list(res, "$.overall_ocr_res.rec_boxes"), _list(res, "$.overall_ocr_res.dt_polys")
    return F.when(F.size(boxes) > 0, boxes).otherwise(polygons)


def _layout_item(x: Column) -> Column:
    first = lambda *paths: F.coalesce(*[F.nullif(filled(_text(x, f"$.{k}")), F.lit("")) for k in paths], F.lit(""))
    label = F.lower(F.coalesce(F.nullif(first("label", "block_label", "type"), F.lit("")), F.lit("text")))
    sure = F.coalesce(F.nullif(_get(x, "$.score", "double"), F.lit(0.0)), _get(x, "$.confidence", "double"), F.lit(0.0))
    box = F.coalesce(*[bounding_box(_get(x, f"$.{k}", "variant")) for k in ("coordinate", "bbox", "box")])
    return F.struct(label.alias("label"), first("text", "content", "rec_text", "html").alias("text"), sure.alias("confidence"), box.alias("bbox"))


def payload_blocks(payloads: DataFrame, keys: list[str], payload: str, page: Column | None = None, scale: tuple[Column, Column] | None = None) -> DataFrame:
    """(keys, reading_order, artifact_type, role, text, confidence, page_num, bbox) of parsers' JSON, whatever its form.

    A payload with texts, tables or pictures is a document tree, any other a page's layout result, whose page is
    ``page`` and whose boxes are scaled. What is no JSON, or has no such lists, gives no rows. A box is four numbers or null.
    """
    sx, sy = scale or (F.lit(1.0), F.lit(1.0))
    v = payloads.withColumn("__p", F.try_parse_json(payload))
    tree = F.coalesce(*[_get(F.col("__p"), f"$.{f}", "array<variant>") for f, _, _ in TREE]).isNotNull()
    kind = "array<struct<reading_order:int,b:struct<artifact_type:string,role:string,text:string,confidence:double,page_num:int,bbox:array<double>,textless:boolean>>>"
    blocks = F.when(tree, _tree_blocks(F.col("__p")).cast(kind)).otherwise(_layout_blocks(F.col("__p"), page if page is not None else F.lit(0), sx, sy).cast(kind))
    flat = v.withColumn("__b", F.explode(blocks)).select(*keys, "__b.reading_order", "__b.b.*")
    return flat.drop("textless")
