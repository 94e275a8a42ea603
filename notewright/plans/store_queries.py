"""Imports, upserts, cascades, exports and the read queries over runs, subjects and documents."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.functions import scores
from notewright.operators import hooks
from notewright.plans.fixtures import MENTIONS_SQL, mentions
from notewright.plans.registry import query
from notewright.session import table
from notewright.sources import store

M = f"mentions as materialized ({MENTIONS_SQL})"


@query("""with c as (select c_custkey as k, c_name as name, 1 as version from customer), u as (select o_custkey as k, 'order ' || max(o_orderkey) as name, 2 as version from orders group by o_custkey)
 select coalesce(u.k, c.k) as k, coalesce(u.name, c.name) as name, coalesce(u.version, c.version) as version from c full join u on c.k = u.k""")
def st_upsert_latest(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.lit(1).alias("version"))
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.concat(F.lit("order "), F.max("o_orderkey").cast("string")).alias("name"))
    return store.upsert(current, changes.withColumn("version", F.lit(2)), ["k"], "version")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)")
def st_anti_import(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return store.not_imported(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), seen, "c_custkey")


@query("""with gone as (select o_orderkey from orders where o_orderstatus = 'F') select (select count(*) from orders where o_orderstatus <> 'F') as parents,
 (select count(*) from lineitem where l_orderkey not in (select o_orderkey from gone)) as children""")
def st_cascade_delete(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"))
    parents, children = store.cascade_delete(orders, items, "k", orders.where("o_orderstatus = 'F'"))
    return parents.agg(F.count("*").alias("parents")).join(children.agg(F.count("*").alias("children")))


@query("select l_orderkey, l_linenumber, l_partkey, case when l_suppkey in (select s_suppkey from supplier where s_acctbal < 0) then null else l_suppkey end as l_suppkey from lineitem")
def st_set_null(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    gone = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return store.set_null(items, "l_suppkey", gone)


@query("select s_suppkey, s_name from supplier where not exists (select 1 from lineitem where l_suppkey = s_suppkey and l_returnflag = 'R' and l_quantity > 49)")
def st_orphans(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return store.orphans(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), children, "s_suppkey")


@query("""select l_suppkey, l_returnflag, count(*) as n from (select l_suppkey, 'X' as l_returnflag from lineitem where l_returnflag = 'A' union all select l_suppkey, l_returnflag from lineitem
 where l_suppkey not in (select l_suppkey from lineitem where l_returnflag = 'A')) x group by all""")
def st_partition_refresh(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag")
    fresh = items.where("l_returnflag = 'A'").withColumn("l_returnflag", F.lit("X"))
    return store.refresh(items, fresh, ["l_suppkey"]).groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))


@query("select user_id, sum(case when event_type = 'error' then 1 else 0 end)::bigint as failed, sum(case when event_type <> 'error' then 1 else 0 end)::bigint as done from events group by user_id")
def st_counter_increments(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    failed = (F.col("event_type") == "error").cast("long")
    return e.groupBy("user_id").agg(F.sum(failed).alias("failed"), F.sum(1 - failed).alias("done"))


@query(f"""with {M} select subject, count(*) as n, md5(string_agg(concat_ws('|', category, date_text, label, value, seq), ';' order by category, date_text, label, value, seq)) as digest from mentions group by subject""")
def st_export_order(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("category", "date_text", "label", "value", "seq")))
    g = mentions(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"), rows.alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat_ws("|", x["category"], x["date_text"], x["label"], x["value"], x["seq"].cast("string"))), ";")
    return g.select("subject", "n", F.md5(text.cast("binary")).alias("digest"))


@query(f"""with {M} select subject, row_number() over (partition by subject order by category, date_text, label, seq) - 1 as place, category, label, value, date_text from mentions""")
def st_export_json(spark, sf_dir):
    """The export documents, read back: their items in order."""
    j = store.export_json(mentions(spark, sf_dir), "subject", ["category", "label", "value", "date_text"], ["category", "date_text", "label", "seq"])
    items = F.from_json("json", "subject bigint, mentions array<struct<category:string,label:string,value:string,date_text:string>>")["mentions"]
    return j.select("subject", F.posexplode(items).alias("place", "m")).select("subject", F.col("place").cast("long").alias("place"), *[F.col(f"m.{c}").alias(c) for c in ("category", "label", "value", "date_text")])


@query(f"with {M} select category, count(*) as n from mentions group by category")
def qry_category_distribution(spark, sf_dir):
    return mentions(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))


@query("""with o as (select o_custkey, count(*) as documents from orders group by o_custkey), i as (select o_custkey, count(*) as mentions from orders join lineitem on l_orderkey = o_orderkey group by o_custkey)
 select c_custkey, c_name, coalesce(documents, 0) as documents, coalesce(mentions, 0) as mentions from customer left join o on o.o_custkey = c_custkey left join i on i.o_custkey = c_custkey
 where (contains(lower(c_name), '00012') or contains(lower(c_mktsegment), 'build')) and c_custkey in (select o_custkey from orders where o_orderstatus = 'F')""")
def qry_patient_search(spark, sf_dir):
    c, o, i = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    hit = F.contains(F.lower("c_name"), F.lit("00012")) | F.contains(F.lower("c_mktsegment"), F.lit("build"))
    has = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    documents = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("documents"))
    found = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("mentions"))
    out = c.where(hit).join(has, "c_custkey", "left_semi").join(documents, "c_custkey", "left").join(found, "c_custkey", "left")
    return out.select("c_custkey", "c_name", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("mentions", F.lit(0)).alias("mentions"))


@query("select l_suppkey, count(*) as n, count(*) filter (l_returnflag = 'R') as in_run, count(distinct l_orderkey) filter (l_returnflag = 'R') as documents from lineitem group by l_suppkey")
def qry_filtered_counts(spark, sf_dir):
    r = F.col("l_returnflag") == "R"
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(r).alias("in_run"), F.countDistinct(F.when(r, F.col("l_orderkey"))).alias("documents"))


@query("select event_id, user_id, event_type from events order by ts desc, event_id desc limit 100")
def qry_latest_runs(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "user_id", "event_type")


@query("""with r as (select user_id, count(*) as total, count(*) filter (event_type <> 'error') as done, epoch_us(max(ts)) - epoch_us(min(ts)) as us from events group by user_id)
 select user_id, case when total = 0 then 0 else (100 * done) // total end as percent, case when us > 0 then round(done / (us / 1000000.0) * 60, 2) else 0.0 end as per_minute, greatest(total - done, 0) as remaining from r""")
def qry_progress_eta(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    r = e.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("done"), (F.max("us") - F.min("us")).alias("us"))
    rate = F.when(F.col("us") > 0, F.round(F.col("done") / (F.col("us") / 1000000.0) * 60, 2)).otherwise(0.0)
    return r.select("user_id", F.expr("100 * done div total").alias("percent"), rate.alias("per_minute"), F.greatest(F.col("total") - F.col("done"), F.lit(0)).alias("remaining"))


@query("select (select count(*) from customer) as patients, (select count(*) from orders) as documents, (select count(*) from lineitem) as mentions, (select count(*) from events) as logs")
def qry_dashboard_totals(spark, sf_dir):
    names = {"patients": "customer", "documents": "orders", "mentions": "lineitem", "logs": "events"}
    every = None
    for k, n in names.items():
        part = table(spark, sf_dir, n).agg(F.count("*").alias("n")).withColumn("k", F.lit(k))
        every = part if every is None else every.unionByName(part)
    return every.groupBy().pivot("k", list(names)).agg(F.first("n"))


@query("select event_type, count(*) as n, arg_max(event_id, (ts, event_id)) as last_event from events group by event_type")
def qry_run_status(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"))


@query("select n_regionkey, n_nationkey, count(*) as n from nation join customer on c_nationkey = n_nationkey group by rollup (n_regionkey, n_nationkey)")
def ext_rollup_counts(spark, sf_dir):
    """An extension: counts with subtotals."""
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))


@query("""select p_partkey, case when p_size % 2 = 0 and p_size >= 20 then 20 when p_size % 2 = 0 then 40 else 180 end as seconds,
 least(coalesce(case when p_size % 3 = 0 then p_size::double end, case when p_size % 5 = 0 then p_size + 0.5 + 0.75 end, 2.5 * (p_size % 4 + 1)), 70.0) as delay from part""")
def prd_eta_and_delay(spark, sf_dir):
    size = F.col("p_size")
    message = F.when(size % 5 == 0, F.concat(F.lit("Rate limit, try again in "), size.cast("string"), F.lit(".5s"))).otherwise(F.lit("busy"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", scores.seconds_per_document(size % 2 == 0, size).alias("seconds"), scores.retry_delay(size % 4, F.when(size % 3 == 0, size), message).alias("delay")
    )


REPLY_SQL = """concat('```json', chr(10), '{"mentions": [{"category": "', case when p_size % 3 = 0 then '' else 'lab' end, '", "label": "', p_name, '", "value": "', case when p_size % 4 = 0 then '' else p_brand end,
 '", "certainty": "', case p_size % 3 when 0 then 'Confirmed' when 1 then 'likely' else 'possible' end, '"},]}', chr(10), '```')"""


@query(f"""with r as (select p_partkey, {REPLY_SQL} as reply from part), b as (select p_partkey, regexp_replace(regexp_replace(regexp_replace(reply, '(?i)```(?:json)?|</?json>', '', 'g'), ',\\s*([}}\\]])', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') as j from r)
 select p_partkey, md5(j) as digest, json_extract_string(j, '$.mentions[0].label') as label from b""")
def json_loose_strip(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(REPLY_SQL).alias("reply"))
    j = p.select("p_partkey", hooks.strip_reply(F.col("reply")).alias("j"))
    return j.select("p_partkey", F.md5(F.col("j").cast("binary")).alias("digest"), F.get_json_object("j", "$.mentions[0].label").alias("label"))


@query("""select p_partkey, case when p_size % 3 = 0 then 'unknown' else 'lab' end as category, p_name as label, case when p_size % 4 = 0 then p_name else p_brand end as value,
 case p_size % 3 when 0 then 'confirmed' when 1 then 'unknown' else 'possible' end as certainty, '1.1.2024' as date_text from part""")
def json_clean_mentions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(REPLY_SQL).alias("reply"), F.lit("1.1.2024").alias("note_date"))
    return hooks.clean_replies(p, ["p_partkey"], "reply", "note_date").select("p_partkey", "category", "label", "value", "certainty", "date_text")


@query("""with v as (select l_orderkey, 'd' || (l_partkey % 3) as drug, least(100, 80 + 4 * (count(*) - 1)) as score from lineitem group by all)
 select l_orderkey, '[' || string_agg('{"drug":"' || drug || '","score":' || score || ',"dose":""}', ',' order by score desc, drug) || ']' as merged from v group by l_orderkey""")
def agg_candidate_votes(spark, sf_dir):
    """Votes in order, folded one by one; the SQL knows that the nth vote of equal scores adds four."""
    c = F.struct(F.concat(F.lit("d"), (F.col("l_partkey") % 3).cast("string")).alias("drug"), F.lit(80).alias("score"), F.lit("").alias("dose"))
    votes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", c.alias("c")))), lambda x: x["c"])
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(votes.alias("votes"))
    return g.select("l_orderkey", F.to_json(hooks.merge_votes(F.col("votes"))).alias("merged"))


@query("""select user_id, event_type, count(*) as n, sum(case when gap > 3600 then 1 else 0 end)::bigint as breaks from (select user_id, event_type,
 (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1000000.0 as gap from events) e group by all""")
def seg_event_gaps(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("gap", (F.col("us") - F.lag("us").over(w)) / 1000000.0)
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.sum(F.when(F.col("gap") > 3600, 1).otherwise(0)).alias("breaks"))


@query("select source, lang, count(*) as documents, count(distinct md5(text)) as texts, max(n_chars) as longest, round(avg(n_chars), 1) as mean from documents group by source, lang")
def st_inventory(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(
        F.count("*").alias("documents"), F.countDistinct(F.md5("text")).alias("texts"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 1).alias("mean")
    )
