"""Relations, timelines and the knowledge map over merged mentions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.functions import vocab
from notewright.functions.text import filled, nz


def mention_key() -> Column:
    """category::label::value::date, lower-cased."""
    return F.lower(F.concat_ws("::", filled("category"), filled("label"), F.coalesce(nz(F.col("normalized_value")), filled("value")), filled("date_text")))


def relation_edges(merged: DataFrame, subject: str = "subject", id_col: str | None = None) -> DataFrame:
    """(subject, source_key, target_key, relation_type, confidence, evidence_pages): pairs of a subject's mentions
    whose categories a rule connects; equal edges once, their pages united. With ``id_col`` they have source_id and
    target_id too, those of ``resolve_edges``, without a second reading of ``merged``; its k_category is then its
    category, lower-cased.

    The rule gives each source row its target category, so this is an equi-join on subject and category; values of
    one category are reduced to distinct keys before they meet.
    """
    targets = [t for _, t, _ in vocab.EDGE_RULES]
    keyed = merged.withColumn("key", mention_key())
    pages = F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_pages")))).alias("pages")
    if id_col:  # the last id of a key, whatever its categories: one that begins like a rule's may have the same key
        begun = reduce(lambda a, b: a | b, [F.startswith("k_category", F.lit(c + "::")) for c in {*targets, *(s for s, _, _ in vocab.EDGE_RULES)}])
        near = keyed.where(F.col("k_category").isin(*targets, *(s for s, _, _ in vocab.EDGE_RULES)) | begun).repartition(subject, "key")
        by_key = near.groupBy(subject, "k_category", "key").agg(pages, F.max(id_col).alias("id")).withColumn("id", F.max("id").over(Window.partitionBy(subject, "key")))
    else:
        by_key = keyed.groupBy(subject, "k_category", "key").agg(pages)
    ids = lambda name: [F.col("id").alias(name)] if id_col else []
    rules = F.array(*[F.struct(F.lit(t).alias("to"), F.lit(r).alias("relation_type")) for s, t, r in vocab.EDGE_RULES])
    source = by_key.where(F.col("k_category") == "diagnosis").select(subject, F.col("key").alias("source_key"), F.col("pages").alias("sp"), *ids("source_id"), F.explode(rules).alias("r"))
    source = source.select(*[c for c in source.columns if c != "r"], "r.*")
    target = by_key.where(F.col("k_category").isin(targets)).select(subject, F.col("k_category").alias("to"), F.col("key").alias("target_key"), F.col("pages").alias("tp"), *ids("target_id"))
    return source.join(target, [subject, "to"]).select(
        subject, "source_key", "target_key", "relation_type", F.lit(vocab.EDGE_CONFIDENCE).alias("confidence"),
        F.array_sort(F.array_union("sp", "tp")).alias("evidence_pages"), *(["source_id", "target_id"] if id_col else []),
    )


def resolve_edges(edges: DataFrame, merged: DataFrame, subject: str = "subject", id_col: str = "mention_id") -> DataFrame:
    """``edges`` with source_id and target_id; of mentions with an equal key the last id; null where none fits."""
    keys = merged.withColumn("key", mention_key()).groupBy(subject, "key").agg(F.max(id_col).alias("id"))
    source = keys.select(subject, F.col("key").alias("source_key"), F.col("id").alias("source_id"))
    target = keys.select(subject, F.col("key").alias("target_key"), F.col("id").alias("target_id"))
    return edges.join(source, [subject, "source_key"], "left").join(target, [subject, "target_key"], "left")


def timeline(merged: DataFrame) -> DataFrame:
    """Events of the three timeline categories; ``timeline_order`` sorts them."""
    kind = F.coalesce(*[F.when(F.col("k_category") == c, F.lit(e)) for c, e in vocab.TIMELINE])
    return merged.withColumn("event_type", kind).where(F.col("event_type").isNotNull())


def timeline_order() -> list[Column]:
    """Events without a date last, then by date as text, then by label."""
    return [(filled("date_text") == ""), filled("date_text"), filled("label")]


def knowledge_map(merged: DataFrame, edges: DataFrame, subject: str = "subject", id_col: str = "mention_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, links): categories, mentions and evidence with their weights; belongs_to, evidence and relation links."""
    category = F.concat(F.lit("cat_"), F.col("k_category"))
    mention = F.concat(F.lit("men_"), F.col(id_col).cast("string"))
    nodes = (
        merged.select(subject, category.alias("id"), F.col("k_category").alias("name"), F.lit(10).alias("val")).distinct()
        .unionByName(merged.select(subject, mention.alias("id"), F.col("value").alias("name"), F.lit(5).alias("val")))
    )
    evidence = merged.select(subject, mention.alias("source"), F.explode(F.slice("evidence_ids", 1, 6)).alias("e"))
    nodes = nodes.unionByName(evidence.select(subject, F.concat(F.lit("art_"), "e").alias("id"), F.col("e").alias("name"), F.lit(4).alias("val")).distinct())
    # a mention's own links come from one reading of it
    link = lambda target, kind: F.struct(target.alias("target"), F.lit(kind).alias("type"))
    shown = F.transform(F.coalesce(F.slice("evidence_ids", 1, 6), F.array().cast("array<string>")), lambda e: link(F.concat(F.lit("art_"), e), "evidence"))
    own = merged.select(subject, mention.alias("source"), F.explode(F.concat(F.array(link(category, "belongs_to")), shown)).alias("l")).select(subject, "source", "l.*")
    links = own.unionByName(
        edges.where("source_id is not null and target_id is not null").select(
            subject, F.concat(F.lit("men_"), F.col("source_id").cast("string")).alias("source"), F.concat(F.lit("men_"), F.col("target_id").cast("string")).alias("target"), F.col("relation_type").alias("type")
        )
    )
    return nodes, links
