"""What a dashboard shows: totals, categories, runs, the health of records; and the joins and rankings behind it.

Every table may be of any size: counts combine before they move, top lists are Spark's own top-k, lookups are equi joins.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.text import filled
from notewright.operators.reads import first_of_each

# The states of a run that is under way.
ACTIVE = ["pending", "extracting", "triaging", "llm_processing", "merging", "qc"]


def totals(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, n): how many rows each table has; an empty one has zero."""
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def category_distribution(mentions: DataFrame) -> DataFrame:
    """(category, n) of mentions, the most frequent first, equal counts by name; a null category is one."""
    return mentions.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def recent_runs(runs: DataFrame, latest: int = 5) -> DataFrame:
    """The ``latest`` runs (run, status, created), newest first; of equal times the highest run."""
    return runs.orderBy(F.desc("created"), F.desc("run")).limit(latest)


def run_status(runs: DataFrame) -> DataFrame:
    """One row: total, completed and failed runs, and active_run, the newest that is under way (null without any)."""
    under_way = F.col("status").isin(ACTIVE)
    newest = F.max_by("run", F.when(under_way, F.struct("created", "run")))
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return runs.agg(F.count("*").alias("total"), of("completed"), of("failed"), F.count_if(under_way).alias("under_way"), newest.alias("active_run"))


def dashboard(tables: Mapping[str, DataFrame], mentions: DataFrame, runs: DataFrame, latest: int = 5) -> dict[str, DataFrame]:
    """The parts of the overview: stats, categories, recent_runs and status."""
    return {"stats": totals(tables), "categories": category_distribution(mentions), "recent_runs": recent_runs(runs, latest), "status": run_status(runs)}


def health_rows(records: DataFrame, profiles: DataFrame, corrected: DataFrame, subject: str = "subject") -> DataFrame:
    """One row a record: (subject, schema_version, document_type, auto_schema, sections, has_primary, spell_changes).

    ``records`` are those of ``deep_records``, ``profiles`` those of ``fallback_profile`` or of a model, ``corrected``
    has a row (subject) for each mention whose spelling was changed. A record without a profile keeps its row with
    nulls; without changes it has zero.
    """
    changes = corrected.groupBy(subject).agg(F.count("*").alias("spell_changes"))
    p = profiles.select(
        subject, F.col("document_profile.document_type").alias("document_type"), F.col("quality_checks.auto_schema.status").alias("auto_schema"),
        (filled("major_info.primary_finding") != "").alias("has_primary"),
    )
    r = records.select(subject, F.col("record.schema_version").alias("schema_version"), F.size("record.sections").alias("sections"))
    out = r.join(p, subject, "left").join(changes, subject, "left")
    return out.select(
        subject, "schema_version", "document_type", "auto_schema", "sections", F.coalesce("has_primary", F.lit(False)).alias("has_primary"), F.coalesce("spell_changes", F.lit(0)).alias("spell_changes")
    )


def valid_ratio(rows: DataFrame, required: list[str], by: list[str]) -> DataFrame:
    """(by, n, valid, ratio): rows in which every required column is there (not null), and their share."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required], F.lit(True))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(whole).alias("valid"), F.avg(whole.cast("int")).alias("ratio"))


def extremes(rows: DataFrame, measure: str, tie: str, n: int = 15) -> DataFrame:
    """``rows`` with the ``n`` highest (side "most") and the ``n`` lowest ("least") by ``measure``, ties by ``tie``; rows
    without a measure are in neither, a short table is in both."""
    there = rows.where(F.col(measure).isNotNull())
    most = there.orderBy(F.desc(measure), tie).limit(n).withColumn("side", F.lit("most"))
    return most.unionByName(there.orderBy(measure, tie).limit(n).withColumn("side", F.lit("least")))


def look_up(rows: DataFrame, key: str, table: DataFrame, columns: list[str], last: list[Column], required: bool = False) -> DataFrame:
    """``rows`` with ``columns`` of the entry of ``table`` that has the row's ``key``. Of entries with one key the last by
    ``last`` counts, so no row is multiplied; a row without an entry has nulls, or goes where one is ``required``.
    Null keys never meet."""
    entry = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*last)).alias("__e"))
    joined = rows.join(entry, key, "inner" if required else "left")
    return joined.select("*", *[F.col(f"__e.{c}").alias(c) for c in columns]).drop("__e")


def evidence_links(mentions: DataFrame, artifacts: DataFrame, subject: str = "subject", first: int = 6, shown: int = 120) -> DataFrame:
    """(subject, mention, artifact): the links of a map from each mention to its first ``first`` pieces of evidence, if
    they are among the subject's first ``shown`` artifacts by page, reading order, kind and name. Both bounds are the
    map's. ``mentions`` has mention and evidence_ids, ``artifacts`` artifact, page, reading_order, artifact_type. An id
    that a mention names twice is linked twice."""
    order = [F.col(c) for c in ("page", "reading_order", "artifact_type", "artifact")]
    seen = first_of_each(artifacts.select(subject, "artifact", "page", "reading_order", "artifact_type"), subject, order, shown).select(subject, "artifact").distinct()
    named = mentions.select(subject, "mention", F.explode(F.slice("evidence_ids", 1, first)).alias("artifact"))
    return named.join(seen, [subject, "artifact"]).select(subject, "mention", "artifact")
