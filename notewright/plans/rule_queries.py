"""Trims, stored forms, doses near a drug, order fields, votes, spelling and counters that the other modules leave."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import text, vocab
from notewright.operators import extract, hooks, orders, pages, reads, segment, spelling
from notewright.plans.fixtures import mentions, notes
from notewright.plans.note_queries import KEYS, K, N
from notewright.plans.order_queries import ORDER
from notewright.plans.record_queries import M
from notewright.plans.registry import query
from notewright.session import table
from notewright.sources import store

FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"""select doc_id, case when length(t) <= 5500 then t else left(t, 3575) || chr(10) || '...[middle omitted]...' || chr(10) || right(t, 1877) end as source_text,
 case when length(w) <= 9000 then w else rtrim(left(w, 5850), ' ' || chr(10)) || chr(10) || chr(10) || '...[middle truncated for token budget]...' || chr(10) || chr(10) || ltrim(right(w, 3118), ' ' || chr(10)) end as note_text
 from (select doc_id, {FLAT} as t, trim(regexp_replace(regexp_replace(replace(text, chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) as w from documents) d""")
def txt_trims(spark, sf_dir):
    """Texts of sources and of notes, cut in the middle to the limits of their prompts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.source_trim(F.col("text")).alias("source_text"), text.note_trim(F.col("text")).alias("note_text"))


@query(f"""with {M} select seq, left(coalesce(nullif(trim(case when seq % 5 = 0 then ' ' else category end), ''), 'unknown'), 50) as category, left(coalesce(nullif(trim(label), ''), ''), 200) as label,
 left(coalesce(nullif(trim(date_text), ''), ''), 100) as date_text, left(coalesce(nullif(trim(case when seq % 3 = 0 then null else certainty end), ''), 'unknown'), 20) as certainty from mentions""")
def txt_stored_fields(spark, sf_dir):
    m = mentions(spark, sf_dir).withColumns({"category": F.when(F.col("seq") % 5 == 0, " ").otherwise(F.col("category")), "certainty": F.when(F.col("seq") % 3 != 0, F.col("certainty"))})
    return text.stored_fields(m).select("seq", "category", "label", "date_text", "certainty")


NEAR = "concat(case when q % 3 = 0 then concat('give ', q, ' units ') else '' end, 'Sunitinib', case when q % 2 = 0 then concat(' ', q, ' mg') else ' as said' end)"


@query(f"with {N} select {K}, case when q % 2 = 0 then concat(q, ' mg') when q % 3 = 0 then concat(q, ' units') end as dose from notes")
def spl_dose_window(spark, sf_dir):
    """The dose behind a drug, or else the one shortly before it."""
    return notes(spark, sf_dir).select(*KEYS, extract.nearby_dose(F.expr(NEAR), "sunitinib").alias("dose"))


@query(f"""with {N}, o as (select {K}, case when q % 4 = 0 then '' else 'Inj saline' end as raw_text, case when q % 3 = 0 then concat(q, ' ml') else ' ' end as dose, 'IV' as route, case when q % 5 = 0 then 'bd' else '' end as frequency from notes),
 t as (select *, concat_ws(' ', nullif(trim(raw_text), ''), nullif(trim(dose), ''), route, nullif(frequency, '')) as t from o)
 select {K}, t as order_text, nullif(trim(dose), '') as found_dose, nullif(trim(dose), '') as volume, concat_ws(',', case when raw_text <> '' then 'inj' end, 'iv', case when frequency <> '' then 'bd' end) as short_forms from t""")
def ext_order_fields(spark, sf_dir):
    """All nine fields of an order in one text, with its dose, volume and short forms."""
    q = F.col("q")
    o = notes(spark, sf_dir).select(
        *KEYS,
        F.struct(
            F.when(q % 4 == 0, "").otherwise("Inj saline").alias("raw_text"), F.when(q % 3 == 0, F.concat(q.cast("string"), F.lit(" ml"))).otherwise(" ").alias("dose"),
            F.lit("IV").alias("route"), F.when(q % 5 == 0, "bd").otherwise("").alias("frequency"),
        ).alias("o"),
    )
    n = orders.normalized_order(o, "o")
    return n.select(*KEYS, "order_text", F.col("dose").alias("found_dose"), "volume", F.array_join("short_forms", ",").alias("short_forms"))


@query("""with v as (select l_orderkey, 'd' || (l_partkey % 3) as drug, row_number() over (partition by l_orderkey, l_partkey % 3 order by l_linenumber, l_partkey, l_suppkey) as n from lineitem)
 select l_orderkey, drug, least(100, 80 + 4 * (max(n) - 1))::int as score from v group by all""")
def agg_vote_scores(spark, sf_dir):
    """Votes for drugs without doses: each further one adds four."""
    c = F.struct(F.concat(F.lit("d"), (F.col("l_partkey") % 3).cast("string")).alias("drug"), F.lit(80).alias("score"), F.lit("").alias("dose"))
    votes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", c.alias("c")))), lambda x: x["c"])
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(votes.alias("votes"))
    return g.select("l_orderkey", F.explode(hooks.merge_votes(F.col("votes"))).alias("x")).select("l_orderkey", "x.drug", "x.score")


@query(f"""with {N}, w as (select distinct unnest(regexp_extract_all(lower({ORDER}), '[a-z]+')) as token from notes), c as (select distinct token, v as drug, case when v = token then 100 else 96 end as score from w, (values {', '.join(f"('{k}', '{v}')" for k, v in vocab.MISREADS)}) m(k, v) where starts_with(token, k)),
 r as (select *, row_number() over (partition by token order by score desc, drug desc) as n from c) select token, drug, score from r where n <= 4""")
def spl_misread_orders(spark, sf_dir):
    t = notes(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower(F.expr(ORDER)), F.lit("[a-z]+"), 0)).alias("token")).distinct()
    return spelling.misread_candidates(t)


WORDS = """select case when p_partkey % 40 = 0 then left(w, 2) || substr(w, 4) else w end as token from (select p_partkey, unnest(string_split(p_name, ' ')) as w from part) p"""


@query(f"""with c as (select lower(token) as token, count(*) as n from ({WORDS}) t group by all), r as (select a.token, b.token as suggestion, levenshtein(a.token, b.token)::int as edits, b.n from c a, c b
 where a.n < 20 and b.n >= 20 and length(a.token) between 4 and 20 and length(b.token) between 4 and 20 and levenshtein(a.token, b.token) <= 2), o as (select *, row_number() over (partition by token order by edits, n desc, suggestion) as place from r)
 select token, suggestion, edits, n from o where place = 1""")
def spl_corpus_typos(spark, sf_dir):
    """Corpus spelling on the words of names, some with a letter left out; the SQL compares all pairs."""
    w = F.explode(F.split("p_name", " ")).alias("w")
    t = table(spark, sf_dir, "part").select("p_partkey", w).select(F.when(F.col("p_partkey") % 40 == 0, F.concat(F.left("w", F.lit(2)), F.substr("w", F.lit(4)))).otherwise(F.col("w")).alias("token"))
    return spelling.corpus_spelling(t, least_count=20)


@query("select l_orderkey as doc, role, count(*) as zones, round(sum(x1 - x0), 2) as wide from (select distinct l_orderkey from lineitem) d cross join (values " + ", ".join(f"('{r}', {a * 600}::double, {c * 600}::double)" for r, a, _, c, _ in [*pages.ORDER_ZONES, *pages.CHART_ZONES]) + ") z(role, x0, x1) group by all")
def seg_order_zones(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc")).distinct().select("doc", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    z = segment.page_zones(p, [*pages.ORDER_ZONES, *pages.CHART_ZONES])
    return z.groupBy("doc", F.col("zone").alias("role")).agg(F.count("*").alias("zones"), F.round(F.sum(F.col("x1") - F.col("x0")), 2).alias("wide"))


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 4 = 0 and o_custkey is not null)")
def st_anti_import_some(spark, sf_dir):
    """Of customers, those that no order in four has brought in."""
    seen = table(spark, sf_dir, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return store.not_imported(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), seen, "c_custkey")


@query("""with c as (select user_id, count(*) as total, count(*) filter (event_type <> 'error') as done from events group by user_id) select user_id, (case when done > total then total else done end * 100 // total)::bigint as percent,
 case when done = 0 then null else ceil((total - done) * (30.0 / done))::bigint end as eta_seconds from c""")
def qry_eta(spark, sf_dir):
    """Percent done and whole seconds left at the pace so far, after half a minute."""
    c = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("done"))
    return reads.with_progress(c.withColumn("seconds", F.lit(30.0))).select("user_id", "percent", "eta_seconds")


@query("""select name, n, least, quarter, half, most from (select 'l_quantity' as name, count(l_quantity) as n, min(l_quantity)::double as least, quantile_disc(l_quantity, 0.25)::double as quarter, quantile_disc(l_quantity, 0.5)::double as half, max(l_quantity)::double as most from lineitem
 union all select 'l_discount', count(l_discount), min(l_discount)::double, quantile_disc(l_discount, 0.25)::double, quantile_disc(l_discount, 0.5)::double, max(l_discount)::double from lineitem) x""")
def agg_describe_columns(spark, sf_dir):
    """Counts, ends and quartiles of several columns in one pass."""
    d = reads.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return d.select("name", "n", "least", "quarter", "half", "most")
