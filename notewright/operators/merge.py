"""Mentions to records: keyed merge, statistics, sections, validation, quality control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions import scores, vocab
from notewright.functions.text import filled, nz, section_title, whitespace_of

KEY = ["k_category", "k_label", "k_norm", "k_date"]


def normalized_mentions(mentions: DataFrame) -> DataFrame:
    """``mentions`` with their text fields normalised and defaults filled, and the four parts of their identity, lower-cased.

    The category is unknown by default, the normalised value the value, and the identity is taken from these; then
    the label is the category by default, the value the normalised value, and the certainty, lower-cased, unknown.
    """
    bare = mentions.withColumns({c: whitespace_of(c) for c in ("category", "label", "value", "normalized_value", "date_text", "evidence_quote")})
    bare = bare.withColumns({"category": F.coalesce(nz(F.col("category")), F.lit("unknown")), "normalized_value": F.coalesce(nz(F.col("normalized_value")), F.col("value"))})
    keyed = bare.withColumns({k: F.lower(c) for k, c in zip(KEY, ("category", "label", "normalized_value", "date_text"))})
    return keyed.withColumns(
        {
            "label": F.coalesce(nz(F.col("label")), F.col("category")),
            "value": F.coalesce(nz(F.col("value")), F.col("normalized_value")),
            "certainty": F.lower(F.coalesce(F.col("certainty").cast("string"), F.lit("unknown"))),
        }
    )


def merge_mentions(mentions: DataFrame, subject: str = "subject", seq: str = "seq") -> DataFrame:
    """One row per subject and identity of ``normalized_mentions``. Spelling, certainty and date come from the first
    mention by ``seq``; the quote, and the attributes (a map) if there are any, are the first that aren't empty; pages,
    evidence, artifacts (if there are any) and origins are sorted unions. Equal keys combine map-side; lists are gathered
    only inside one identity."""
    first = lambda name: F.min_by(name, seq).alias(name)
    union = lambda name, to: F.array_sort(F.collect_set(name)).alias(to)
    keyed = normalized_mentions(mentions)
    more = []
    if "attributes" in mentions.columns:
        more.append(F.min_by("attributes", F.when(F.size("attributes") > 0, F.col(seq))).alias("attributes"))
    if "evidence_artifact_id" in mentions.columns:
        more.append(union("evidence_artifact_id", "evidence_artifact_ids"))
    return keyed.groupBy(subject, *KEY).agg(
        *[first(x) for x in ("category", "label", "value", "normalized_value", "date_text", "certainty")],
        F.min(seq).alias(seq),
        F.count("*").alias("n_raw"),
        union("page", "source_pages"),
        union("evidence_id", "evidence_ids"),
        union("origin", "origins"),
        F.min_by("evidence_quote", F.when(filled("evidence_quote") != "", F.col(seq))).alias("evidence_quote"),
        *more,
    )


def union_mentions(sources: dict[str, DataFrame | None]) -> DataFrame:
    """The mentions of all sources (patterns, artifacts, a model) in one bag, each with its source as ``origin``; a
    source that isn't there adds nothing, columns that one lacks are null. Nothing is merged or dropped."""
    parts = [df.withColumn("origin", F.lit(name)) for name, df in sources.items() if df is not None]
    if not parts:
        raise ValueError("no source of mentions")
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def with_subject(mentions: DataFrame, notes: DataFrame, keys: list[str]) -> DataFrame:
    """``mentions`` with the columns of their note. ``keys`` names the subject too: note ids repeat between subjects."""
    return mentions.join(notes, keys)


def merged_stats(merged: DataFrame, subject: str = "subject") -> DataFrame:
    """(subject, n_merged, n_raw, n_categories) of each subject with mentions, from its merged mentions alone."""
    return merged.groupBy(subject).agg(F.count("*").alias("n_merged"), F.sum("n_raw").alias("n_raw"), F.countDistinct("k_category").alias("n_categories"))


def record_stats(subjects: DataFrame, mentions: DataFrame, merged: DataFrame, subject: str = "subject") -> DataFrame:
    """Per subject, also those without mentions: raw and merged counts, categories, pages and evidence, review flag."""
    raw = mentions.groupBy(subject).agg(F.count("*").alias("n_raw"), F.countDistinct("page").alias("n_pages"), F.countDistinct("evidence_id").alias("n_evidence"))
    kept = merged_stats(merged, subject).drop("n_raw")
    joined = subjects.select(subject).join(raw, subject, "left").join(kept, subject, "left").fillna(0)
    return joined.withColumn("review_flag", F.when(F.col("n_merged") == 0, "no_mentions_after_merge").otherwise(""))


def sections(merged: DataFrame, subject: str = "subject") -> DataFrame:
    """One row per subject and category: title, count, and the items in merge order as an array of structs."""
    item = F.struct("date_text", "label", "normalized_value", "value", "certainty")
    return merged.groupBy(subject, F.col("k_category").alias("category")).agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list(item)).alias("items")
    ).withColumn("title", section_title(F.col("category")))


def grouped_record(merged: DataFrame, subject: str = "subject") -> DataFrame:
    """One row per subject with a map from category to its section."""
    s = sections(merged, subject)
    entries = F.array_sort(F.collect_list(F.struct(F.col("category"), F.struct("title", "n_items", "items").alias("section"))))
    return s.groupBy(subject).agg(F.map_from_entries(entries).alias("sections"))


def section_items(record: DataFrame, subject: str = "subject") -> DataFrame:
    """The items of all sections of ``grouped_record``, one a row, each with its section's category; empty sections give
    none."""
    flat = record.select(subject, F.explode("sections").alias("category", "section"))
    return flat.select(subject, "category", F.explode("section.items").alias("item")).select(subject, "category", "item.*")


def validate(subjects: DataFrame, merged: DataFrame, subject: str = "subject") -> DataFrame:
    """The rule-based check of each record: missing medical categories, flags, confidence."""
    facts = merged.groupBy(subject).agg(
        F.count("*").alias("n"),
        F.sum((F.size("evidence_ids") > 0).cast("long")).alias("n_evidence"),
        F.collect_set("k_category").alias("categories"),
    )
    v = subjects.select(subject).join(facts, subject, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "n_evidence": F.coalesce("n_evidence", F.lit(0)), "categories": F.coalesce("categories", F.array().cast("array<string>"))})
    medical = F.array(*[F.lit(x) for x in vocab.MEDICAL])
    some = F.arrays_overlap("categories", medical)
    v = v.withColumn("missing", F.when(some, F.array_sort(F.array_except(medical, F.col("categories")))).otherwise(F.array().cast("array<string>")))
    no_mentions, no_evidence = F.col("n") == 0, (F.col("n_evidence") == 0) & (F.col("n") > 0)
    no_diagnosis = some & ~F.array_contains("categories", "diagnosis")
    flags = [
        (no_mentions, "no_mentions_after_merge"), (no_evidence, "mentions_without_source_evidence"),
        (F.size("categories") == 0, "no_categories_detected"), (no_diagnosis, "diagnosis_not_detected"),
        ((F.size("categories") <= 1) & (F.col("n") >= 5), "low_category_diversity"),
    ]
    return v.select(
        subject, "n", "n_evidence", "missing",
        F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))).alias("flags"),
        scores.confidence(no_mentions, no_evidence, no_diagnosis, F.size("missing")).alias("confidence"),
    )


QC_CATEGORIES = ("diagnosis", "medication", "imaging", "pathology")


def qc_rows(stats: DataFrame, merged: DataFrame, subject: str = "subject") -> DataFrame:
    """Per subject of ``record_stats``: mentions, categories, sizes of the trace, review flags, and whether the main
    categories are there."""
    has = [F.max(F.col("k_category") == x).alias(f"has_{x}") for x in QC_CATEGORIES]
    facts = merged.groupBy(subject).agg(F.array_sort(F.collect_set("k_category")).alias("categories"), *has)
    rows = stats.join(facts, subject, "left")
    return rows.select(
        subject, F.col("n_merged").alias("mention_count"), F.col("n_categories").alias("category_count"), F.col("n_pages").alias("trace_pages"),
        F.col("n_evidence").alias("trace_evidence_ids"), (F.col("review_flag") != "").cast("int").alias("review_flags"), F.col("n_raw").alias("raw_mentions_before_merge"),
        F.coalesce("categories", F.array().cast("array<string>")).alias("categories"), *[F.coalesce(f"has_{x}", F.lit(False)).alias(f"has_{x}") for x in QC_CATEGORIES],
    )


def qc_summary(rows: DataFrame) -> DataFrame:
    """One row over all subjects: totals, spread, flags and coverage."""
    share = lambda c: F.round(100 * F.count_if(c) / F.count("*")).cast("long")
    return rows.agg(
        F.count("*").alias("subjects"), F.sum("mention_count").alias("mentions"), F.round(F.avg("mention_count"), 1).alias("avg_mentions"),
        F.min("mention_count").alias("least"), F.max("mention_count").alias("most"), F.count_if(F.col("review_flags") > 0).alias("subjects_with_flags"),
        F.sum("review_flags").alias("total_review_flags"), *[F.count_if(f"has_{x}").alias(f"with_{x}") for x in QC_CATEGORIES],
        *[share(F.col(f"has_{x}")).alias(f"{x}_percent") for x in QC_CATEGORIES],
    )


def correction_report(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """How many fields and mentions a correction changed."""
    joined = before.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]).join(after.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]), key)
    changed = [(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("long") for c in columns]
    total = changed[0]
    for c in changed[1:]:
        total = total + c
    return joined.agg(*[F.sum(x).alias(f"changed_{c}") for x, c in zip(changed, columns)], F.count_if(total > 0).alias("changed_mentions"))
