"""The reads of ``operators.reads`` over tables that stand in for patients, documents, runs, mentions and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.operators import reads
from notewright.plans.registry import query
from notewright.session import table

SQL = """patients as (select c_custkey as patient, c_name as code, c_mktsegment as name from customer), docs as (select o_orderkey as doc, o_custkey as patient, 'order_' || o_orderkey || '.pdf' as filename, o_orderdate as created from orders),
 bridge as (select o_orderstatus as run, o_orderkey as doc from orders), found as (select o_custkey as patient, o_orderstatus as run, l_returnflag as category, l_shipdate as date_text, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey as seq, l_suppkey as label
 from lineitem join orders on l_orderkey = o_orderkey)"""


def _tables(spark, sf_dir):
    c, o, i = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    patients = c.select(F.col("c_custkey").alias("patient"), F.col("c_name").alias("code"), F.col("c_mktsegment").alias("name"))
    docs = o.select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("patient"), F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"), F.col("o_orderdate").alias("created"))
    bridge = o.select(F.col("o_orderstatus").alias("run"), F.col("o_orderkey").alias("doc"))
    found = i.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("patient"), F.col("o_orderstatus").alias("run"), F.col("l_returnflag").alias("category"), F.col("l_shipdate").alias("date_text"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")).alias("seq"), F.col("l_suppkey").alias("label"),
    )
    return patients, docs, bridge, found


@query(f"""with {SQL}, d as (select patient, count(*) as documents from docs group by patient), m as (select patient, count(*) as mentions from found group by patient)
 select p.*, coalesce(documents, 0) as documents, coalesce(mentions, 0) as mentions from patients p left join d using (patient) left join m using (patient)
 where (contains(lower(code), '0001') or contains(lower(name), '0001')) and patient in (select patient from docs join bridge using (doc) where run = 'P') and patient in (select patient from found where category = 'R')""")
def qry_patient_list(spark, sf_dir):
    p, d, b, m = _tables(spark, sf_dir)
    return reads.patient_list(p, d, m, b, q="0001", run="P", has_results=True, results=m.where("category = 'R'"))


@query(f"""with {SQL} select doc, patient, filename, created, code, name from docs join patients using (patient) where doc in (select doc from bridge where run = 'F')
 and (contains(lower(filename), 'build') or contains(lower(code), 'build') or contains(lower(name), 'build'))""")
def qry_document_list(spark, sf_dir):
    p, d, b, _ = _tables(spark, sf_dir)
    return reads.document_list(d, p, b, q=" Build ", run="F")


def _detail(spark, sf_dir):
    p, d, b, m = _tables(spark, sf_dir)
    artifacts = m.select("patient", F.col("label").alias("page"), F.pmod("seq", F.lit(97)).alias("reading_order"), F.col("seq").alias("artifact"))
    relations = m.select("patient", F.col("category").alias("relation_type"), F.col("date_text").alias("created"), F.col("seq").alias("relation"))
    return reads.patient_detail(p.where("code like '%7'"), d, m, artifacts, relations, m.groupBy("patient").agg(F.count("*").alias("n")))


@query(f"""with {SQL}, own as (select * from found where patient in (select patient from patients where code like '%7')),
 a as (select patient, label as page, seq % 97 as reading_order, seq as artifact, row_number() over (partition by patient order by label, seq % 97, seq) as place from own)
 select * from a where place <= 200""")
def qry_patient_artifacts(spark, sf_dir):
    return _detail(spark, sf_dir)["artifacts"]


@query(f"""with {SQL}, own as (select * from found where patient in (select patient from patients where code like '%7')), docs7 as (select * from docs where patient in (select patient from patients where code like '%7'))
 select 'documents' as part, patient, count(*) as n, min(filename) as first from docs7 group by patient union all select 'mentions', patient, count(*), arg_min(label, (category, date_text, seq))::varchar from own group by patient
 union all select 'relations', patient, count(*), arg_min(seq, (category, date_text, seq))::varchar from own group by patient union all select 'record', patient, 1, count(*)::varchar from own group by patient""")
def qry_patient_detail(spark, sf_dir):
    d = _detail(spark, sf_dir)
    head = {"documents": F.min("filename"), "mentions": F.min_by("label", F.struct("category", "date_text", "seq")), "relations": F.min_by("relation", F.struct("relation_type", "created", "relation")), "record": F.max("n")}
    out = None
    for part, first in head.items():
        rows = d[part].groupBy("patient").agg(F.count("*").alias("n"), first.cast("string").alias("first")).withColumn("part", F.lit(part))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""with {SQL}, m as (select run, patient, count(*) as mentions from found group by all), d as (select run, patient, count(distinct doc) as documents from bridge join docs using (doc) group by all)
 select run, patient, documents, coalesce(mentions, 0) as mentions from d left join m using (run, patient)""")
def qry_run_patients(spark, sf_dir):
    _, d, b, m = _tables(spark, sf_dir)
    logs = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("ts").alias("created"), F.col("event_id").alias("log"))
    return reads.run_detail(b, d, m, logs)["patients"]


@query("select run, created, log, place from (select event_type as run, ts as created, event_id as log, row_number() over (partition by event_type order by ts desc, event_id desc) as place from events) e where place <= 100")
def qry_run_logs(spark, sf_dir):
    _, d, b, m = _tables(spark, sf_dir)
    logs = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("ts").alias("created"), F.col("event_id").alias("log"))
    return reads.run_detail(b, d, m, logs)["logs"]


@query(f"""with {SQL}, o as (select distinct run, patient from bridge join docs using (doc)), m as (select run, patient, count(*) as n, string_agg(category || ':' || label, ';' order by seq, category, label) as rows from found where category <> 'N' group by all)
 select run, patient, coalesce(n, 0) as n, md5(coalesce(rows, '')) as digest from o left join m using (run, patient)""")
def st_run_export(spark, sf_dir):
    """The JSON of each patient of a run, read back: engines write JSON differently."""
    _, d, b, m = _tables(spark, sf_dir)
    j = reads.run_export(b, d, m.where("category <> 'N'"), ["category", "label"])
    rows = F.from_json("json", "patient_code long, mentions array<struct<category:string,label:long>>")["mentions"]
    text = F.array_join(F.transform(rows, lambda x: F.concat(x["category"], F.lit(":"), x["label"].cast("string"))), ";")
    return j.select("run", "patient", F.size(rows).cast("long").alias("n"), F.md5(text.cast("binary")).alias("digest"))


@query(f"""with {SQL}, one as (select doc from docs order by created, doc limit 1), b as (select run, doc from bridge union all select 'chosen', doc from docs where doc % 10 = 3 union all select 'one', doc from one)
 select run, count(*) as n, min(doc) as least, max(doc) as most from b group by run""")
def qry_run_start(spark, sf_dir):
    _, d, b, _ = _tables(spark, sf_dir)
    chosen = d.where("doc % 10 = 3").select("doc").unionByName(d.where("doc % 20 = 13").selectExpr("doc")).unionByName(d.selectExpr("-doc - 1 as doc"))
    started = reads.start_one(reads.start_run(reads.start_run(b, d, "chosen", chosen), d, "chosen", chosen), d, "one")
    return started.groupBy("run").agg(F.count("*").alias("n"), F.min("doc").alias("least"), F.max("doc").alias("most"))


@query("""select o_orderkey as run, case when o_orderkey % 3 = 0 and o_orderstatus = 'O' then 'failed' when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'P' then 'failed' else 'running' end as status,
 case when o_orderkey % 3 = 0 and o_orderstatus = 'O' then 'Cancelled by user' else '' end as error_message, case when o_orderkey % 3 = 0 and o_orderstatus = 'O' then 9 else 0 end as completed from orders""")
def qry_run_cancel(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    runs = o.select(F.col("o_orderkey").alias("run"), status.alias("status"), F.lit("").alias("error_message"), F.lit(0).alias("completed"))
    return reads.cancel_runs(runs, runs.where("run % 3 = 0"), F.lit(9))
