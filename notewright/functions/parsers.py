"""Sub-field parsers: a mention's value to a struct, never failing; a field that isn't there is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright.functions import vocab
from notewright.functions.scores import first_of
from notewright.functions.text import filled, nz


def _get(c: Column, pattern: str, group: int = 1) -> Column:
    return nz(F.regexp_extract(c, pattern, group))


def _side(low: Column, at_start: bool) -> Column:
    right, left = F.contains(low, F.lit("right")) | F.contains(low, F.lit(" rt ")), F.contains(low, F.lit("left")) | F.contains(low, F.lit(" lt "))
    if at_start:
        right, left = right | low.startswith("rt "), left | low.startswith("lt ")
    return F.when(F.contains(low, F.lit("bilateral")), F.lit("Bilateral")).when(right, F.lit("Right")).when(left, F.lit("Left"))


def diagnosis(value: Column) -> Column:
    v, low = filled(value), F.lower(filled(value))
    stage = F.coalesce(F.concat(F.lit("Stage "), F.upper(_get(low, vocab.STAGE))), F.upper(_get(low, vocab.TNM)))
    histology = first_of(low, [(k, k.title()) for k in vocab.HISTOLOGY], regex=False)
    grade = F.concat(F.lit("Grade "), F.upper(_get(low, vocab.GRADE)))
    return F.struct(v.alias("full_text"), stage.alias("stage"), histology.alias("histology"), grade.alias("grade"), _side(low, True).alias("laterality"))


def medication(value: Column) -> Column:
    v, low = filled(value), F.lower(filled(value))
    drug = F.coalesce(_get(v, r"(?i)\b(?:tab|t\.|cap|inj|inj\.)\s*([A-Za-z][A-Za-z0-9\-]+)"), _get(v, r"\b([A-Z][a-z]{3,})\b"))
    return F.struct(
        drug.alias("drug_name"),
        _get(v, "(?i)" + vocab.DOSE, 0).alias("dose"),
        first_of(low, vocab.FREQUENCY).alias("frequency"),
        first_of(low, vocab.ROUTE, regex=False).alias("route"),
        _get(low, r"for\s+(\d+\s+(?:week|month|day)s?)").alias("duration"),
    )


def imaging(value: Column) -> Column:
    v, low = filled(value), F.lower(filled(value))
    modality = first_of(low, vocab.MODALITY)
    found = _get(v, r"(?id)(?:pet\s*ct|cect|mri|ct|usgs?|hrct)[^\n:]*[:\-]\s*(.+)")
    after = F.when(modality.isNotNull() & F.contains(v, F.lit(":")), F.substr(v, F.instr(v, ":") + 1))
    return F.struct(modality.alias("modality"), F.left(F.trim(F.coalesce(found, after)), F.lit(300)).alias("finding"))


def pathology(value: Column, label: Column) -> Column:
    v, low = filled(value), F.lower(filled(value))
    kind = F.coalesce(nz(label), first_of(low, [(k.lower(), k) for k in ("HPR", "IHC", "histopathology", "cytology")], regex=False))
    result = F.left(F.trim(_get(v, r"(?id)(?:hpr|ihc|histopath)[^\n:]*[:\-]\s*(.+)")), F.lit(300))
    return F.struct(kind.alias("report_type"), result.alias("result"), F.concat(F.lit("Grade "), F.upper(_get(low, vocab.GRADE))).alias("grade"))


def lab(value: Column, label: Column) -> Column:
    return F.struct(F.coalesce(label, F.lit("lab")).alias("test"), _get(filled(value), r"(\d+(?:\.\d+)?)").alias("value_raw"), filled(value).alias("full_text"))


def genomics(value: Column, label: Column) -> Column:
    v = filled(value)
    found = F.left(F.trim(_get(v, r"(?id)(?:ngs|wes|fish|ihc)[^\n:]*[:\-]\s*(.+)")), F.lit(300))
    return F.struct(F.coalesce(label, F.lit("genomics")).alias("test"), F.coalesce(nz(found), v).alias("finding"))


def performance_status(value: Column) -> Column:
    v = filled(value)
    return F.struct(_get(v, r"(?i)\bps\s*[-:]?\s*([0-4])\b").cast("int").alias("ecog"), _get(v, r"(?i)\bkps\s*(\d{2,3})\b").cast("int").alias("kps"))


def surgery(value: Column, label: Column) -> Column:
    low = F.lower(filled(value))
    procedure = F.coalesce(first_of(low, [(k, k) for k in vocab.OPERATIONS], regex=False), label, F.lit("surgery"))
    return F.struct(procedure.alias("procedure"), _side(low, False).alias("laterality"))


def radiotherapy(value: Column) -> Column:
    low = F.lower(filled(value))
    return F.struct(
        first_of(low, [(k, k.upper()) for k in vocab.RADIATION], regex=False).alias("modality"),
        F.concat(_get(low, r"(\d+(?:\.\d+)?)\s*gy\b"), F.lit(" Gy")).alias("dose"),
        _get(low, r"(\d+)\s*(?:#|fr(?:actions?)?)\b").cast("int").alias("fractions"),
    )


def parsed(category: Column, value: Column, label: Column) -> Column:
    """The parser of the category as JSON text; others pass label and value through."""
    table = {
        "diagnosis": diagnosis(value), "medication": medication(value), "imaging": imaging(value), "pathology": pathology(value, label),
        "lab": lab(value, label), "genomics": genomics(value, label), "performance_status": performance_status(value),
        "surgery": surgery(value, label), "radiotherapy": radiotherapy(value),
    }
    out = F.to_json(F.struct(filled(label).alias("label"), filled(value).alias("value")))
    for name, parser in table.items():
        out = F.when(category == name, F.to_json(parser)).otherwise(out)
    return out
