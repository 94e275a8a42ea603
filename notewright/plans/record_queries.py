"""Merged records, validation, quality control, relations, timelines and the knowledge map."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import vocab
from notewright.operators import graph, merge
from notewright.plans.fixtures import MENTIONS_SQL, mentions
from notewright.plans.registry import query
from notewright.session import table

M = f"mentions as materialized ({MENTIONS_SQL})"
KEYED = f"""{M}, keyed as (select *, lower(coalesce(nullif(category, ''), 'unknown')) as k_category, lower(label) as k_label, lower(coalesce(nullif(normalized_value, ''), value)) as k_norm, lower(date_text) as k_date from mentions),
 merged as materialized (select subject, k_category, k_label, k_norm, k_date, arg_min(label, seq) as label, arg_min(value, seq) as value, arg_min(coalesce(nullif(normalized_value, ''), value), seq) as normalized_value, arg_min(date_text, seq) as date_text,
 arg_min(certainty, seq) as certainty, min(seq) as seq, count(*) as n_raw, list_sort(list_distinct(list(page))) as pages, list_sort(list_distinct(list(evidence_id))) as evidence, list_sort(list_distinct(list(origin))) as origins,
 arg_min(evidence_quote, seq) filter (where evidence_quote <> '') as quote from keyed group by all)"""
IDENTITY = "lower(concat_ws('::', k_category, label, coalesce(nullif(normalized_value, ''), value), date_text))"


def _merged(spark, sf_dir):
    return merge.merge_mentions(mentions(spark, sf_dir))


def _subjects(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"))


@query(f"with {KEYED} select subject, k_category, k_label, k_norm, k_date, label, value, certainty, n_raw, array_to_string(pages, ',') as pages, md5(array_to_string(evidence, ',')) as evidence, array_to_string(origins, ',') as origins, quote from merged")
def mrg_merge_mentions(spark, sf_dir):
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return _merged(spark, sf_dir).select(
        "subject", *merge.KEY, "label", "value", "certainty", "n_raw", join("source_pages").alias("pages"), F.md5(join("evidence_ids").cast("binary")).alias("evidence"),
        join("origins").alias("origins"), F.col("evidence_quote").alias("quote"),
    )


@query(f"""with {KEYED}, r as (select subject, count(*) as n_raw, count(distinct page) as n_pages, count(distinct evidence_id) as n_evidence from mentions group by subject),
 m as (select subject, count(*) as n_merged, count(distinct k_category) as n_categories from merged group by subject)
 select s_suppkey as subject, coalesce(n_raw, 0) as n_raw, coalesce(n_pages, 0) as n_pages, coalesce(n_evidence, 0) as n_evidence, coalesce(n_merged, 0) as n_merged, coalesce(n_categories, 0) as n_categories,
 case when coalesce(n_merged, 0) = 0 then 'no_mentions_after_merge' else '' end as review_flag from supplier left join r on r.subject = s_suppkey left join m on m.subject = s_suppkey""")
def mrg_group_stats(spark, sf_dir):
    return merge.record_stats(_subjects(spark, sf_dir), mentions(spark, sf_dir), _merged(spark, sf_dir))


@query(f"""with {KEYED} select subject, k_category as category, count(*) as n_items, upper(left(k_category, 1)) || replace(substr(k_category, 2), '_u', ' U') as title,
 md5(string_agg(concat_ws('|', date_text, label, normalized_value, value, certainty), ';' order by date_text, label, normalized_value, value, certainty)) as items from merged group by subject, k_category""")
def jsn_sections(spark, sf_dir):
    s = merge.sections(_merged(spark, sf_dir))
    rows = F.array_join(F.transform("items", lambda x: F.concat_ws("|", x["date_text"], x["label"], x["normalized_value"], x["value"], x["certainty"])), ";")
    return s.select("subject", "category", "n_items", "title", F.md5(rows.cast("binary")).alias("items"))


@query()
def jsn_grouped_record(spark, sf_dir):
    """The nested record as one map per subject; the flat form of it has an oracle above."""
    return merge.grouped_record(_merged(spark, sf_dir)).select("subject", F.to_json("sections").alias("record"))


MED = ", ".join(f"'{x}'" for x in vocab.MEDICAL)


@query(f"""with {KEYED}, f as (select subject, count(*) as n, sum((len(evidence) > 0)::int) as ev, list_distinct(list(k_category)) as cats from merged group by subject),
 v as (select s_suppkey as subject, coalesce(n, 0) as n, coalesce(ev, 0) as ev, coalesce(cats, []) as cats from supplier left join f on f.subject = s_suppkey),
 w as (select *, list_has_any(cats, [{MED}]) as medical, case when list_has_any(cats, [{MED}]) then list_sort(list_filter([{MED}], lambda x: not list_contains(cats, x))) else [] end as missing from v)
 select subject, array_to_string(missing, ',') as missing,
 array_to_string(list_sort(list_filter([case when n = 0 then 'no_mentions_after_merge' end, case when ev = 0 and n > 0 then 'mentions_without_source_evidence' end, case when len(cats) = 0 then 'no_categories_detected' end,
 case when medical and not list_contains(cats, 'diagnosis') then 'diagnosis_not_detected' end, case when len(cats) <= 1 and n >= 5 then 'low_category_diversity' end], lambda x: x is not null)), ',') as flags,
 round(greatest(0.25, least(0.88 - 0.18 * (n = 0)::int - 0.12 * (ev = 0 and n > 0)::int - 0.08 * (medical and not list_contains(cats, 'diagnosis'))::int - 0.015 * least(len(missing), 4), 0.98)), 3)::double as confidence from w""")
def val_confidence(spark, sf_dir):
    v = merge.validate(_subjects(spark, sf_dir), _merged(spark, sf_dir))
    return v.select("subject", F.array_join("missing", ",").alias("missing"), F.array_join("flags", ",").alias("flags"), "confidence")


_MAIN = merge.QC_CATEGORIES
QC = f"""r as (select subject, count(*) as n_raw, count(distinct page) as n_pages, count(distinct evidence_id) as n_evidence from mentions group by subject),
 f as (select subject, count(*) as n, array_to_string(list_sort(list_distinct(list(k_category))), ',') as cats from merged group by subject),
 qc as (select s_suppkey as subject, coalesce(n, 0) as mention_count, coalesce(len(string_split(cats, ',')), 0) as category_count, coalesce(n_pages, 0) as trace_pages, coalesce(n_evidence, 0) as trace_evidence_ids,
 case when n is null then 1 else 0 end as review_flags, coalesce(n_raw, 0) as raw_mentions_before_merge, coalesce(cats, '') as categories,
 {", ".join(f"list_contains(string_split(coalesce(cats, ''), ','), '{x}') as has_{x}" for x in _MAIN)} from supplier left join r on r.subject = s_suppkey left join f on f.subject = s_suppkey)"""


def _qc(spark, sf_dir):
    m, merged = mentions(spark, sf_dir), _merged(spark, sf_dir)
    return merge.qc_rows(merge.record_stats(_subjects(spark, sf_dir), m, merged), merged)


@query(f"with {KEYED}, {QC} select * from qc")
def qc_rows(spark, sf_dir):
    return _qc(spark, sf_dir).withColumn("categories", F.array_join("categories", ","))


@query(f"""with {KEYED}, {QC} select count(*) as subjects, sum(mention_count)::bigint as mentions, round(avg(mention_count), 1) as avg_mentions, min(mention_count) as least, max(mention_count) as most,
 count(*) filter (review_flags > 0) as subjects_with_flags, sum(review_flags)::bigint as total_review_flags, {", ".join(f"count(*) filter (has_{x}) as with_{x}" for x in _MAIN)},
 {", ".join(f"round(100 * count(*) filter (has_{x}) / count(*))::bigint as {x}_percent" for x in _MAIN)} from qc""")
def qc_summary(spark, sf_dir):
    return merge.qc_summary(_qc(spark, sf_dir))


@query(f"""with {KEYED} select subject, k_category, k_label, k_norm, k_date, arg_min('of ' || evidence_quote, seq) filter (evidence_quote <> '') as quote_of,
 coalesce(array_to_string(list_sort(list_distinct(list('a_' || evidence_id) filter (date_text <> ''))), ','), '') as artifacts from keyed group by all""")
def mrg_attributes_and_artifacts(spark, sf_dir):
    m = mentions(spark, sf_dir).withColumns(
        {
            "attributes": F.when(F.col("evidence_quote") == "", F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("quote_of"), F.concat(F.lit("of "), "evidence_quote"))),
            "evidence_artifact_id": F.when(F.col("date_text") != "", F.concat(F.lit("a_"), "evidence_id")),
        }
    )
    merged = merge.merge_mentions(m)
    return merged.select("subject", *merge.KEY, F.col("attributes")["quote_of"].alias("quote_of"), F.array_join("evidence_artifact_ids", ",").alias("artifacts"))


@query(f"""with {M}, bag as (select subject, category, value, 'regex' as origin from mentions where origin = 'regex' union all select subject, category, upper(value), 'llm' from mentions where origin = 'llm'
 union all select s_suppkey, 'form', s_name, 'artifact' from supplier) select subject, origin, count(*) as n, count(distinct value) as n_values from bag group by subject, origin""")
def mrg_union_sources(spark, sf_dir):
    m = mentions(spark, sf_dir).select("subject", "category", "value", "origin")
    sources = {
        "regex": m.where("origin = 'regex'").drop("origin"),
        "artifact": table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"), F.lit("form").alias("category"), F.col("s_name").alias("value")),
        "llm": m.where("origin = 'llm'").withColumn("value", F.upper("value")).drop("origin"),
        "vision": None,
    }
    return merge.union_mentions(sources).groupBy("subject", "origin").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query("""select l_suppkey as subject, l_linenumber as note_id, count(*) as n, count(distinct c_name) as owners from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey group by all""")
def jon_note_owner(spark, sf_dir):
    """Notes are named by order and line: the line alone repeats in every order."""
    notes = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc"), "c_name")
    m = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("note_id"))
    return merge.with_subject(m, notes, ["doc"]).groupBy("subject", "note_id").agg(F.count("*").alias("n"), F.countDistinct("c_name").alias("owners"))


@query(f"""with {KEYED} select subject, k_category as category, label, coalesce(nullif(normalized_value, ''), value) as shown, count(*) as n from merged where k_category <> 'plan' group by all""")
def jsn_section_items(spark, sf_dir):
    record = merge.grouped_record(_merged(spark, sf_dir).where("k_category <> 'plan'"))
    items = merge.section_items(record)
    return items.groupBy("subject", "category", "label", F.coalesce(F.nullif("normalized_value", F.lit("")), "value").alias("shown")).agg(F.count("*").alias("n"))


EDGES = f"""e0 as (select subject, k_category, {IDENTITY} as key, list_sort(list_distinct(flatten(list(pages)))) as pages from merged group by all),
 edges as (select s.subject, s.key as source_key, t.key as target_key, case t.k_category when 'medication' then 'treated_with' when 'imaging' then 'evidenced_by' else 'test_result' end as relation_type,
 array_to_string(list_sort(list_distinct(list_concat(s.pages, t.pages))), ',') as evidence_pages from e0 s join e0 t on s.subject = t.subject and s.k_category = 'diagnosis' and t.k_category in ('medication', 'imaging', 'lab'))"""


def _lower_merged(spark, sf_dir):
    return _merged(spark, sf_dir).withColumn("category", F.col("k_category"))


@query(f"with {KEYED.replace('group by all)', 'group by subject, k_category, k_label, k_norm, k_date)')}, {EDGES.replace('from merged group by all', 'from (select subject, k_category, label, value, normalized_value, date_text, pages from merged) group by subject, k_category, key')} select subject, source_key, target_key, relation_type, 0.72::double as confidence, evidence_pages from edges")
def rel_edges(spark, sf_dir):
    e = graph.relation_edges(_lower_merged(spark, sf_dir))
    return e.withColumn("evidence_pages", F.array_join(F.col("evidence_pages").cast("array<string>"), ","))


@query(f"""with {KEYED} select subject, case k_category when 'diagnosis' then 'diagnosis' when 'medication' then 'treatment' else 'follow_up' end as event_type, label, value, date_text,
 row_number() over (partition by subject order by date_text = '', date_text, label, seq) as place from merged where k_category in ('diagnosis', 'medication', 'follow_up')""")
def rel_timeline(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("subject").orderBy(*graph.timeline_order(), "seq")
    return graph.timeline(_merged(spark, sf_dir)).select("subject", "event_type", "label", "value", "date_text", F.row_number().over(w).cast("long").alias("place"))


@query(f"""with {KEYED}, k as (select subject, {IDENTITY} as key, max(seq) as id from merged group by 1, 2), {EDGES}
 select e.subject, relation_type, count(*) as n, count(s.id) as sources, count(t.id) as targets, sum(s.id % 1000)::bigint as s_sum, sum(t.id % 1000)::bigint as t_sum from edges e left join k s on s.subject = e.subject and s.key = source_key left join k t on t.subject = e.subject and t.key = target_key group by 1, 2""")
def rel_resolve_keys(spark, sf_dir):
    m = _lower_merged(spark, sf_dir)
    r = graph.relation_edges(m, id_col="seq")
    return r.groupBy("subject", "relation_type").agg(
        F.count("*").alias("n"), F.count("source_id").alias("sources"), F.count("target_id").alias("targets"),
        F.sum(F.col("source_id") % 1000).alias("s_sum"), F.sum(F.col("target_id") % 1000).alias("t_sum"),
    )


@query(f"""with {KEYED}, n as (select distinct subject, 'cat_' || k_category as id, k_category as name, 10 as val from merged union all select subject, 'men_' || seq, value, 5 from merged
 union all select distinct subject, 'art_' || e, e, 4 from (select subject, unnest(evidence[1:6]) as e from merged) x) select subject, val, count(*) as n, count(distinct name) as names from n group by subject, val""")
def map_nodes(spark, sf_dir):
    m = _lower_merged(spark, sf_dir)
    nodes, _ = graph.knowledge_map(m, graph.relation_edges(m, id_col="seq"), id_col="seq")
    return nodes.groupBy("subject", "val").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


@query(f"""with {KEYED}, k as (select subject, {IDENTITY} as key, max(seq) as id from merged group by 1, 2), {EDGES},
 l as (select subject, 'belongs_to' as type from merged union all select subject, 'evidence' from (select subject, unnest(evidence[1:6]) as e from merged) x union all select subject, relation_type from edges)
 select subject, type, count(*) as n from l group by subject, type""")
def map_links(spark, sf_dir):
    m = _lower_merged(spark, sf_dir)
    _, links = graph.knowledge_map(m, graph.relation_edges(m, id_col="seq"), id_col="seq")
    return links.groupBy("subject", "type").agg(F.count("*").alias("n"))


@query(f"""with {M}, a as (select seq, subject, value as b_value, 'Item ' || substr(value, 6) as a_value from mentions) select sum((b_value <> a_value)::int)::bigint as changed_value, count(*) filter (b_value <> a_value) as changed_mentions from a""")
def rep_corrections(spark, sf_dir):
    m = mentions(spark, sf_dir).withColumn("key", F.struct("subject", "seq"))
    after = m.withColumn("value", F.concat(F.lit("Item "), F.substr("value", F.lit(6))))
    return merge.correction_report(m, after, "key", ["value"])
