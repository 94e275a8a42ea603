"""Inventories of a run: one row a document or subject for each stage, from counts that combine before they move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions import parsers, scores


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key of either side, null ones too; a count that one side doesn't know is zero."""
    counts = [c for c in [*left.columns, *right.columns] if c not in keys]
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counts])


def pass_inventory(pages: DataFrame, notes: DataFrame | None, keys: list[str], least_signal: int = 25) -> DataFrame:
    """(keys, page_count, ocr_pages, note_count, low_value_notes, high_signal_notes, status) of page rows with
    ``selected_source`` and note rows with ``low_value`` and ``signal``. A document without notes or pages keeps its row.
    Without ``notes`` each page row is its own note, with all three columns, and the rows are read once."""
    of_pages = [F.count("*").alias("page_count"), F.count_if(F.col("selected_source") == "ocr").alias("ocr_pages")]
    of_notes = [F.count("*").alias("note_count"), F.count_if("low_value").alias("low_value_notes"), F.count_if(F.col("signal") >= least_signal).alias("high_signal_notes")]
    if notes is None:
        return pages.groupBy(*keys).agg(*of_pages, *of_notes).withColumn("status", F.lit("ok"))
    return _beside(pages.groupBy(*keys).agg(*of_pages), notes.groupBy(*keys).agg(*of_notes), keys).withColumn("status", F.lit("ok"))


def counted_mentions(notes: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """``notes`` with ``n_mentions``, the mentions that the patterns found in each."""
    n = mentions.groupBy(*keys).agg(F.count("*").alias("n_mentions"))
    return notes.join(n, keys, "left").withColumn("n_mentions", F.coalesce("n_mentions", F.lit(0)))


def triage_inventory(notes: DataFrame, keys: list[str], **limits: int) -> DataFrame:
    """(keys, note_count, resolved_notes, unresolved_notes, status) of notes with ``low_value``, ``signal``, ``n_mentions``
    and ``words``; ``limits`` are those of ``needs_model``."""
    needs = scores.needs_model(F.col("low_value"), F.col("signal"), F.col("n_mentions"), F.col("words"), **limits)
    g = notes.groupBy(*keys).agg(F.count("*").alias("note_count"), F.count_if(~needs).alias("resolved_notes"), F.count_if(needs).alias("unresolved_notes"))
    return g.withColumn("status", F.lit("ok"))


def model_inventory(mentions: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, llm_mention_count, llm_failures, status): what the model found, and the calls that failed."""
    found = mentions.groupBy(*keys).agg(F.count("*").alias("llm_mention_count"))
    failed = failures.groupBy(*keys).agg(F.count("*").alias("llm_failures"))
    return _beside(found, failed, keys).withColumn("status", F.lit("ok"))


def final_inventory(merged: DataFrame, flags: DataFrame, subject: str) -> DataFrame:
    """(subject, mentions_after_merge, category_count, review_flags, status) of merged mentions and flag rows (subject, flag)."""
    m = merged.groupBy(subject).agg(F.count("*").alias("mentions_after_merge"), F.count_distinct("k_category").alias("category_count"))
    f = flags.groupBy(subject).agg(F.count_distinct("flag").alias("review_flags"))
    return _beside(m, f, [subject]).withColumn("status", F.lit("ok"))


def performance_summary(mentions: DataFrame, subject: str, value: Column, order: Column) -> DataFrame:
    """(subject, ecog, kps, mentions): the first of each, by ``order``, that is there; the two may come from different
    mentions. Partial results combine before the shuffle."""
    parsed = mentions.select(subject, order.alias("o"), parsers.performance_status(value).alias("p"))
    first = lambda name: F.min_by(f"p.{name}", F.when(F.col(f"p.{name}").isNotNull(), F.col("o"))).alias(name)
    return parsed.groupBy(subject).agg(first("ecog"), first("kps"), F.count("*").alias("mentions"))
