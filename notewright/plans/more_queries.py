"""Source rules, orders, deep records, top lists and joins that the other modules leave."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.functions import text, vocab
from notewright.operators import extract, hooks, merge, schema
from notewright.plans.fixtures import BOXES_SQL, boxes, mentions, notes
from notewright.plans.note_queries import KEYS, K, N
from notewright.plans.record_queries import KEYED
from notewright.plans.registry import query
from notewright.session import table


@query("""select conv_id, turn, case when length(coalesce(r, '')) > length(coalesce(text, '')) then 'read' else 'native' end as chosen, length(case when length(coalesce(r, '')) > length(coalesce(text, '')) then r else text end) as n
 from (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as r from conversations) c""")
def src_better_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("r", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    best = hooks.better_text(F.col("text"), F.col("r"))
    longer = F.length(F.coalesce("r", F.lit(""))) > F.length(F.coalesce("text", F.lit("")))
    return c.select("conv_id", "turn", F.when(longer, "read").otherwise("native").alias("chosen"), F.length(best).cast("long").alias("n"))


@query("select conv_id, arg_max(turn, (least(length(text), 120) + turn % 3, -turn)) as turn from conversations group by conv_id")
def prd_choose_text(spark, sf_dir):
    score = F.least(F.length("text"), F.lit(120)) + F.col("turn") % 3
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("turn", F.struct(score, -F.col("turn"))).alias("turn"))


@query(r"""select doc_id, s.i as reading_order, case when lang = 'en' then 1.0 else 0.65 end::double as confidence, md5(s.v) as digest
 from (select doc_id, lang, unnest(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x, i: {'i': i, 'v': x})) as s from documents) d""")
def src_native_blocks(spark, sf_dir):
    lines = F.filter(F.transform(F.split("text", "\n"), text.strip), lambda x: x != "")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(lines).alias("p", "v"))
    return d.select("doc_id", (F.col("p") + 1).cast("long").alias("reading_order"), F.when(F.col("lang") == "en", 1.0).otherwise(0.65).alias("confidence"), F.md5(F.col("v").cast("binary")).alias("digest"))


@query(f"with boxes as ({BOXES_SQL}) select doc, block_id, x0 / 2 as x0, bottom * 1.5 as y1, least(x0, x1) as low from boxes")
def seg_bbox_rescale(spark, sf_dir):
    points = F.array(F.col("x0"), F.col("x1"))
    return boxes(spark, sf_dir).select("doc", "block_id", F.round(F.col("x0") / 2, 2).alias("x0"), F.round(F.col("bottom") * 1.5, 2).alias("y1"), F.array_min(points).alias("low"))


ORDER_NOTE = "concat('Inj Palonosetron ', q, ' mg IV stat | Tab ', case when q % 2 = 0 then 'Ondansetron' else 'Docetaxel' end, ' ', line, ' ml BD', chr(10), 'advice: rest')"


def _match(c: str, p: str, g: int = 0) -> str:
    return f"nullif(regexp_extract({c}, '(?i){p}', {g}), '')"


@query(f"""with {N}, l as (select {K}, unnest(flatten(list_transform(list_filter(list_transform(regexp_split_to_array({ORDER_NOTE}, '[\\n|]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''),
 lambda x: regexp_extract_all(x, '(?i)({vocab.MEDICATION_LINE})', 1)))) as raw from notes), v as (select {K}, left(trim(regexp_replace(raw, '\\s+', ' ', 'g'), ' .,:;-'), 500) as value from l)
 select {K}, value, lower({_match('value', '(' + vocab.LINE_DRUG + ')', 1)}) as drug, {_match('value', vocab.LINE_ROUTE)} as route, {_match('value', vocab.LINE_DOSE)} as dose, {_match('value', vocab.LINE_FREQUENCY)} as frequency from v""")
def ext_medication_lines(spark, sf_dir):
    return extract.medication_lines(notes(spark, sf_dir).withColumn("order_note", F.expr(ORDER_NOTE)), KEYS, "order_note")


@query(f"""with {N}, o as (select {K}, concat_ws(' ', nullif(trim(case when q % 3 = 0 then '' else 'Saline' end), ''), nullif(trim(case when q % 4 = 0 then concat(q, ' ml') else ' ' end), ''), case when q % 5 = 0 then 'od' end) as t, case when q % 7 = 0 then 'x' else '' end as drug from notes)
 select {K}, t as order_text, t <> '' and (drug <> '' or regexp_matches(t, '(?i){vocab.ORDER_SIGN}')) as meaningful from o""")
def ext_order_items(spark, sf_dir):
    q = F.col("q")
    order = F.struct(
        F.when(q % 3 == 0, "").otherwise("Saline").alias("fluid"), F.when(q % 4 == 0, F.concat(q.cast("string"), F.lit(" ml"))).otherwise(" ").alias("dose"), F.when(q % 5 == 0, "od").alias("frequency")
    )
    n = notes(spark, sf_dir).withColumn("o", order).withColumn("order_text", extract.order_text(F.col("o"), ["fluid", "dose", "frequency"]))
    return n.select(*KEYS, "order_text", extract.meaningful_order(F.col("order_text"), F.when(q % 7 == 0, "x").otherwise("")).alias("meaningful"))


@query(f"with {N} select {K}, case when q % 3 = 0 then 'BP' when q % 3 = 1 then 'Pulse' else '' end as label, case when q % 3 = 2 then concat(q, '') else concat(q, '/', line) end as value from notes where q % 4 > 0 or q % 3 < 2")
def ext_vital_split(spark, sf_dir):
    q = F.col("q").cast("string")
    raw = (
        F.when((F.col("q") % 4 == 0) & (F.col("q") % 3 == 2), " : ")
        .when(F.col("q") % 3 == 0, F.concat(F.lit("BP: "), q, F.lit("/"), F.col("line").cast("string")))
        .when(F.col("q") % 3 == 1, F.concat(F.lit("Pulse= "), q, F.lit("/"), F.col("line").cast("string")))
        .otherwise(F.concat(F.lit("-"), q))
    )
    v = notes(spark, sf_dir).select(*KEYS, raw.alias("raw"))
    return v.withColumn("v", extract.split_vital(F.col("raw"))).where("v is not null").select(*KEYS, "v.label", "v.value")


def _records(spark, sf_dir):
    return schema.ordered_items(merge.merge_mentions(mentions(spark, sf_dir)))


def _first_sql(categories: list[str]) -> str:
    inside = ", ".join(f"'{c}'" for c in categories)
    order = "k_category, coalesce(date_text, ''), coalesce(label, ''), coalesce(normalized_value, ''), coalesce(value, '')"
    return f"first(coalesce(nullif(normalized_value, ''), value) order by {order}) filter (k_category in ({inside}))"


@query(f"""with {KEYED} select subject, {', '.join(f'{_first_sql(c)} as {k}' for k, c in schema.MAJOR.items())},
 array_to_string(list_sort(list_distinct(list(date_text) filter (date_text <> '')))[1:10], ',') as key_dates, 0.82::double as confidence, 'low' as hallucination_risk from merged group by subject""")
def jsn_major_info(spark, sf_dir):
    return schema.major_info(_records(spark, sf_dir)).withColumn("key_dates", F.array_join("key_dates", ","))


@query("with " + KEYED + " select subject, " + ", ".join(f"count(*) filter (k_category in ({', '.join(repr(x) for x in c)}))::int as {k}" for k, c in schema.BUCKETS.items()) + " from merged group by subject")
def jsn_summary_buckets(spark, sf_dir):
    return schema.summary_buckets(_records(spark, sf_dir))


@query()
def jsn_deep_record(spark, sf_dir):
    """The deep record as JSON; its parts have oracles above, its key order has none."""
    return schema.deep_record(_records(spark, sf_dir))


@query("select p_partkey, p_size % 2 = 0 as has_new, case when p_size % 2 = 0 then 'new' else 'old' end as a, 'kept' as b from part")
def jsn_overlay(spark, sf_dir):
    base = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept"))
    over = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"))).otherwise(F.create_map().cast("map<string,string>"))
    m = table(spark, sf_dir, "part").select("p_partkey", over.alias("o"), schema.overlay(base, over).alias("m"))
    return m.select("p_partkey", F.map_contains_key("o", "a").alias("has_new"), F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"))


@query(r"""select conv_id, count(*) as page_count, sum(length(text))::bigint as char_count, sum(case when trim(regexp_replace(text, '\s+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) end)::bigint as word_count from conversations group by conv_id""")
def jsn_source_payload(spark, sf_dir):
    return schema.source_payload(table(spark, sf_dir, "conversations"), "conv_id", "text")


@query("""with c as (select l_suppkey, count(*) as n from lineitem group by l_suppkey), t as (select 'most' as side, l_suppkey, n from c order by n desc, l_suppkey limit 15), b as (select 'least' as side, l_suppkey, n from c order by n, l_suppkey limit 15)
 select * from t union all select * from b""")
def srt_extremes(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    most = c.orderBy(F.desc("n"), "l_suppkey").limit(15).select(F.lit("most").alias("side"), "l_suppkey", "n")
    return most.unionByName(c.orderBy("n", "l_suppkey").limit(15).select(F.lit("least").alias("side"), "l_suppkey", "n"))


@query("select o_custkey, o_orderkey, n from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) o where n <= 4")
def srt_group_cap(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("n"))
    return o.where("n <= 4")


@query("select c_mktsegment, round(avg(((contains(c_name, '1'))::int + (c_acctbal > 0)::int = 2)::int), 4) as valid from customer group by c_mktsegment")
def agg_valid_ratio(spark, sf_dir):
    whole = F.contains("c_name", F.lit("1")) & (F.col("c_acctbal") > 0)
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.round(F.avg(whole.cast("int")), 4).alias("valid"))


@query("select 'l_quantity' as name, count(l_quantity) as n, round(avg(l_quantity), 4) as mean, round(stddev(l_quantity), 4) as deviation, min(l_quantity) as least, max(l_quantity) as most from lineitem")
def agg_describe(spark, sf_dir):
    q = "l_quantity"
    return table(spark, sf_dir, "lineitem").agg(
        F.lit(q).alias("name"), F.count(q).alias("n"), F.round(F.avg(q), 4).alias("mean"), F.round(F.stddev(q), 4).alias("deviation"), F.min(q).alias("least"), F.max(q).alias("most")
    ).select("name", "n", "mean", "deviation", "least", "most")


@query("select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey and r_name like 'A%'")
def jon_foreign_keys(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    r = r.where(F.col("r_name").startswith("A"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_returnflag = 'R')")
def jon_bridge_distinct(spark, sf_dir):
    run = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(run, "p_partkey", "left_semi")


@query(f"""with {KEYED}, a as (select evidence_id, row_number() over (order by evidence_id) as n from (select distinct evidence_id from mentions) x), e as (select subject, seq, unnest(evidence[1:6]) as evidence_id from merged)
 select subject, count(*) as links from e join a using (evidence_id) where n <= 20 group by subject""")
def jon_evidence(spark, sf_dir):
    m = mentions(spark, sf_dir)
    shown = m.select("evidence_id").distinct().orderBy("evidence_id").limit(20)
    e = merge.merge_mentions(m).select("subject", F.explode(F.slice("evidence_ids", 1, 6)).alias("evidence_id"))
    return e.join(shown, "evidence_id").groupBy("subject").agg(F.count("*").alias("links"))


@query("select doc_id, left(text, 700) as cut from documents where contains(text, 'License') or contains(text, 'token')")
def src_dataset_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("License")) | F.contains("text", F.lit("token")))
    return d.select("doc_id", F.left("text", F.lit(700)).alias("cut"))


@query("select event_id, case when event_type = 'error' then 'error' else 'info' end as level, upper(left(event_type, 1)) || substr(event_type, 2) as stage from events")
def st_audit_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.when(F.col("event_type") == "error", "error").otherwise("info").alias("level"), text.humanize(F.col("event_type")).alias("stage"))


@query(f"""with {N}, s as (select doc, count(*) as notes, count(*) filter (len(regexp_extract_all(note, '[\\p{{L}}\\p{{N}}_]+')) < 60) as short_notes from notes group by doc) select * from s""")
def agg_pass_inventory(spark, sf_dir):
    n = notes(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("notes"), F.count_if(text.word_count(F.col("note")) < 60).alias("short_notes"))
    return n


@query("select o_orderkey, o_custkey from orders join customer on c_custkey = o_custkey where contains(lower(c_name), '0001') order by o_orderkey limit 50")
def qry_run_filters(spark, sf_dir):
    """The command line's filters: a name, and a limit that is the feature."""
    c = table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit("0001"))).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(50)


