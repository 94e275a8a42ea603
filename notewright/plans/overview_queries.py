"""The dashboard and what stands behind it; crops, blocks and readings of pages; counters and dataset pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import vocab
from notewright.operators import crops, merge, overview, records
from notewright.operators.pages import CHART_ZONES, ORDER_ZONES
from notewright.plans import run_queries
from notewright.plans.deep_queries import _record_parts
from notewright.plans.fixtures import BOXES_SQL, boxes, mentions, notes
from notewright.plans.record_queries import KEYED, M
from notewright.plans.registry import ORACLES, query
from notewright.session import table
from notewright.sources import store

#: Orders as runs.
RUNS = "select o_orderkey as run, case when o_orderstatus = 'F' then 'completed' when o_orderstatus = 'P' then 'pending' when o_orderkey % 5 = 0 then 'failed' else 'llm_processing' end as status, o_orderdate as created from {}"
STATS = {"patients": "customer", "documents": "orders", "mentions": "lineitem", "artifacts": "events", "relations": "labels"}


def _runs(spark, sf_dir):
    return spark.sql(RUNS.format("{orders}"), orders=table(spark, sf_dir, "orders"))


@query(f"""with {M}, runs as ({RUNS.format('orders')}), c as (select category, count(*) as n from mentions group by category), r as (select run, status from runs order by created desc, run desc limit 5)
 {' union all '.join(f"select 'stats' as part, '{k}' as name, count(*) as n from {t}" for k, t in STATS.items())}
 union all select 'categories', category, n from c union all select 'recent_runs', status, run from r
 union all select 'status', 'completed', count(*) filter (status = 'completed') from runs union all select 'status', 'failed', count(*) filter (status = 'failed') from runs
 union all select 'status', 'active_run', (select run from runs where status in ('pending', 'llm_processing') order by created desc, run desc limit 1)""")
def qry_dashboard(spark, sf_dir):
    """All parts of the overview as rows (part, name, n)."""
    d = overview.dashboard({k: table(spark, sf_dir, t) for k, t in STATS.items()}, mentions(spark, sf_dir), _runs(spark, sf_dir))
    row = lambda part, df, name, n: df.select(F.lit(part).alias("part"), name.alias("name"), n.cast("long").alias("n"))
    out = row("stats", d["stats"], F.col("name"), F.col("n")).unionByName(row("categories", d["categories"], F.col("category"), F.col("n")))
    out = out.unionByName(row("recent_runs", d["recent_runs"], F.col("status"), F.col("run")))
    status = d["status"].select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("long").alias("n")) for k in ("completed", "failed", "active_run")])))
    return out.unionByName(row("status", status, F.col("name"), F.col("n")))


@query(f"""with p as ({ORACLES[run_queries.jsn_fallback_profile.__name__]}), {M}, c as (select subject, count(*) as n from mentions where contains(value, 'ITEM') group by subject)
 select p.subject, (select max(version) from ({ORACLES['jsn_whole_record']}) w) as schema_version, document_type, 'fallback' as auto_schema, sections, coalesce(primary_finding, '') <> '' as has_primary, coalesce(c.n, 0) as spell_changes from p left join c on c.subject = p.subject""")
def agg_record_health(spark, sf_dir):
    """Every record's health; mentions in capitals are those that a correction changed."""
    r = _record_parts(spark, sf_dir)
    pages = notes(spark, sf_dir).select("subject", F.struct("doc", "line", "part").alias("page"), F.col("note").alias("text"))
    changed = mentions(spark, sf_dir).where(F.contains("value", F.lit("ITEM"))).select("subject")
    return overview.health_rows(r, records.fallback_profile(r, pages), changed).withColumn("sections", F.col("sections").cast("long"))


@query(f"""with {M} select category, count(*) as n, count(*) filter (normalized_value <> '' and date_text <> '' and evidence_quote <> '') as valid, avg((normalized_value <> '' and date_text <> '' and evidence_quote <> '')::int) as ratio from mentions group by category""")
def agg_valid_records(spark, sf_dir):
    keys = ["normalized_value", "date_text", "evidence_quote"]
    return overview.valid_ratio(mentions(spark, sf_dir).withColumns({k: F.nullif(k, F.lit("")) for k in keys}), keys, ["category"])


@query("""with c as (select l_orderkey as doc, count(*) as mention_count from lineitem group by l_orderkey) (select doc, mention_count, 'most' as side from c order by mention_count desc, doc limit 15)
 union all (select doc, mention_count, 'least' from c order by mention_count, doc limit 15)""")
def srt_mention_extremes(spark, sf_dir):
    """The fifteen documents with the most and with the fewest mentions."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.count("*").alias("mention_count"))
    return overview.extremes(c, "mention_count", "doc")


@query("""with o as (select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as run, max(o_orderdate) as started from orders group by o_custkey) select c_custkey as patient, c_name as name, run, started from customer left join o on o_custkey = c_custkey""")
def jon_last_entry(spark, sf_dir):
    """Each customer with the last of its orders: entries of equal key multiply no row."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient"), F.col("c_name").alias("name"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient"), F.col("o_orderkey").alias("run"), F.col("o_orderdate").alias("started"))
    return overview.look_up(c, "patient", o, ["run", "started"], [F.col("started"), F.col("run")])


@query("select l_orderkey as doc, l_linenumber as note, o_custkey as patient, c_name as name from lineitem join orders on o_orderkey = l_orderkey and o_orderstatus <> 'P' left join customer on c_custkey = o_custkey and c_acctbal > 0")
def jon_follow_keys(spark, sf_dir):
    """From notes to their document, which must be there, and on to its owner, who may lack."""
    n = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("note"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("doc"), F.col("o_custkey").alias("patient"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("patient"), F.col("c_name").alias("name"))
    owned = overview.look_up(n, "doc", o, ["patient"], [F.col("patient")], required=True)
    return overview.look_up(owned, "patient", c, ["name"], [F.col("name")]).select("doc", "note", "patient", "name")


NAMED = KEYED.replace("concat('e', doc % 50) as evidence_id", "concat(line, '-', (doc * 10 + line) * 1000000 + part) as evidence_id")


@query(f"""with {NAMED}, a as (select subject, evidence_id, row_number() over (partition by subject order by page, seq) as n from mentions), l as (select subject, seq, unnest(evidence[1:6]) as evidence_id from merged)
 select l.subject, l.seq as mention, l.evidence_id as artifact from l join a on a.subject = l.subject and a.evidence_id = l.evidence_id where n <= 120""")
def jon_evidence_links(spark, sf_dir):
    """Links of each subject's map, to the artifacts that the map shows."""
    m = mentions(spark, sf_dir).withColumn("evidence_id", F.concat_ws("-", F.col("page").cast("string"), F.col("seq").cast("string")))
    a = m.select("subject", F.col("evidence_id").alias("artifact"), "page", F.col("seq").alias("reading_order"), F.lit("text_block").alias("artifact_type"))
    return overview.evidence_links(merge.merge_mentions(m).select("subject", F.col("seq").alias("mention"), "evidence_ids"), a)


ARTIFACTS = """select doc, page % 2 as page, block_id, reading_order, x0, top as y0, x1, case when block_id % 13 = 0 then top else bottom end as y1, 'native' as backend,
 case reading_order % 5 when 0 then 'page_region' when 1 then 'table' when 2 then 'text_block' when 3 then 'handwriting' else 'photo' end as artifact_type,
 case block_id % 8 when 0 then 'Header' when 1 then 'orders' when 2 then 'vitals' when 3 then 'body' when 4 then 'table' when 5 then 'figure' else '' end as role,
 case reading_order % 7 when 0 then 'the staff' when 1 then 'nurse gave medicines' when 2 then '' when 3 then repeat('long words ', 20) when 4 then repeat('Inj given ', 20) when 5 then 'Staff Nurse on duty' else text end as text from {}"""
SIGNAL = "regexp_matches(lower({}), '" + "|".join(vocab.ORDER_WORDS) + "')"


def _zone_sql(zones, stage, backend, kind, text, pages):
    rows = ", ".join(f"({i}, '{r}', {x0}, {y0}, {x1}, {y1})" for i, (r, x0, y0, x1, y1) in enumerate(zones))
    return f"select doc, page, z.role, round(z.x0 * 600.0, 2)::double as x0, round(z.y0 * 800.0, 2)::double as y0, round(z.x1 * 600.0, 2)::double as x1, round(z.y1 * 800.0, 2)::double as y1, '{backend}' as source_backend, '{kind}' as source_type, '{text}' as t, {stage} as stage, i as place from {pages}, (values {rows}) z(i, role, x0, y0, x1, y1)"


@query(f"""with boxes as ({BOXES_SQL}), a as (select * replace (trim(text) as text, lower(role) as role) from ({ARTIFACTS.format('boxes')}) x where x1 > x0 and y1 > y0), p as (select distinct doc, page % 2 as page from boxes),
 s as (select doc, page, lower(string_agg(text, ' ' order by reading_order, block_id)) as t from a where text <> '' group by doc, page), c as (select doc, page from s where contains(t, 'staff nurse') and (contains(t, 'medicine') or contains(t, 'injection'))),
 g as (select doc, page, case when role in ('orders', 'vitals', 'body', 'table') then role else 'orders' end as role, round(greatest(0, x0 - 18), 2)::double as x0, round(greatest(0, y0 - 14), 2)::double as y0, round(least(600, x1 + 18), 2)::double as x1, round(least(800, least(800, y1) + 14), 2)::double as y1,
  backend as source_backend, artifact_type as source_type, left(text, 250) as t, 0 as stage, row_number() over (partition by doc, page order by reading_order, block_id) as place from a
  where role not in ('header', 'footer', 'title', 'figure') and artifact_type <> 'photo' and (length(text) <= 140 or {SIGNAL.format('text')})),
 e as (select * from g where (x1 - x0) * (y1 - y0) >= 9000 union all {_zone_sql(CHART_ZONES, 1, 'chart_page_signal', 'page_region', crops.CHART_TEXT, 'c')} union all {_zone_sql(ORDER_ZONES, 2, 'fallback_zone', 'region', '', 'p')}),
 f as (select *, row_number() over (partition by doc, page, round_even(x0 / 8, 0), round_even(y0 / 8, 0), round_even(x1 / 8, 0), round_even(y1 / 8, 0) order by stage, place) as n from e),
 k as (select *, row_number() over (partition by doc, page order by case when role = 'orders' or {SIGNAL.format('t')} then 0 when role = 'vitals' then 1 when source_type in ('table', 'page_region') then 2 else 3 end, y0, x0, stage, place) as crop from f where n = 1)
 select doc, page, crop, role, x0, y0, x1, y1, source_backend, source_type from k where crop <= 8""")
def seg_order_crops(spark, sf_dir):
    """Crops of every page: its artifacts, a chart's zones, the fixed zones."""
    b = boxes(spark, sf_dir)
    pages = b.select("doc", (F.col("page") % 2).alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height")).distinct()
    a = spark.sql(ARTIFACTS.format("{boxes}"), boxes=b)
    return crops.order_crops(pages, a, ["doc", "page"], ["reading_order", "block_id"]).withColumn("crop", F.col("crop").cast("long"))


POLYGON = "case when block_id % 9 = 0 then array(array(x0)) else array(array(x1, top), array(x0, bottom), array(x0), array(x0 + 5, top - 3)) end"


@query(f"with boxes as ({BOXES_SQL}) select doc, block_id, case when block_id % 9 > 0 then round(x0 * 0.5, 2)::double end as x0, case when block_id % 9 > 0 then round((top - 3) * 1.25, 2)::double end as y0, case when block_id % 9 > 0 then round(greatest(x1, x0 + 5) * 0.5, 2)::double end as x1, case when block_id % 9 > 0 then round(bottom * 1.25, 2)::double end as y1 from boxes")
def seg_polygon_boxes(spark, sf_dir):
    """Polygons to boxes in the page's units; points that are none don't count."""
    b = boxes(spark, sf_dir).withColumn("p", F.expr(POLYGON))
    b = b.withColumn("b", crops.scale_box(crops.box_of_points(F.col("p")), F.lit(0.5), F.lit(1.25)))
    return b.select("doc", "block_id", *[F.get("b", F.lit(i)).alias(k) for i, k in enumerate(crops.BOX)])


@query(f"""with boxes as ({BOXES_SQL}), b as (select *, row_number() over (partition by doc, page % 2 order by block_id) as n from boxes where reading_order % 4 > 0)
 select doc, page % 2 as page, n as reading_order, 'text_block' as artifact_type, case when top <= 96 then 'header' when bottom >= 736 then 'footer' when contains(text, 'dose') then 'table' when contains(text, 'signature') then 'stamp' else 'body' end as role,
 case when doc % 3 = 1 then 'mixed' else 'native' end as backend, text, case when doc % 3 = 1 then 0.65 else 1.0 end::double as confidence, x0, bottom as y1 from b""")
def src_block_artifacts(spark, sf_dir):
    """Each page's own text blocks as artifacts; a quarter have no text."""
    text = F.when(F.col("reading_order") % 4 == 0, " \t").otherwise(F.concat(F.lit(" "), "text"))
    source = F.when(F.col("doc") % 3 == 0, "native+img").when(F.col("doc") % 3 == 1, "ocr")
    b = boxes(spark, sf_dir).select("doc", (F.col("page") % 2).alias("page"), "block_id", "x0", F.col("top").alias("y0"), "x1", F.col("bottom").alias("y1"), F.col("height").alias("page_height"), source.alias("selected_source"), text.alias("text"))
    out = crops.native_blocks(b, ["doc", "page"], "block_id").withColumn("reading_order", F.col("reading_order").cast("long"))
    return out.select("*", F.get("bbox", F.lit(0)).alias("x0"), F.get("bbox", F.lit(3)).alias("y1")).drop("bbox")


LIGHT = r"trim(regexp_replace(regexp_replace(replace(replace(text, chr(9), ' '), chr(13), chr(10)), ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12))"


@query(f"""with r as (select conv_id, turn, role as backend, case when turn % 3 = 0 or conv_id % 10 = 0 then '' else coalesce(text, '') end as text, (turn % 5) / 4.0::double as confidence from conversations),
 s as (select * replace ({LIGHT} as text) from r), best as (select 'sure' as mode, conv_id, arg_max(turn, (confidence, length(text), -turn)) filter (text <> '') as turn, max(confidence) filter (text <> '') as confidence, count(*) filter (text <> '') as n_candidates from r group by conv_id
 union all select 'sweep', conv_id, arg_max(turn, (confidence + least(length(text), 120) / 120.0::double, -turn)) filter (text <> ''), max(confidence) filter (text <> ''), count(*) filter (text <> '') from s group by conv_id)
 select mode, b.conv_id, r.backend, md5(case when mode = 'sure' then coalesce(r.text, '') else coalesce(s.text, '') end) as digest, coalesce(b.confidence, 0.0) as confidence, n_candidates from best b left join r on r.conv_id = b.conv_id and r.turn = b.turn left join s on s.conv_id = b.conv_id and s.turn = b.turn""")
def prd_choose_reading(spark, sf_dir):
    """Turns as the readings of one crop, by both rules; every tenth conversation has no text."""
    none = (F.col("turn") % 3 == 0) | (F.col("conv_id") % 10 == 0)
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("backend"), F.when(none, "").otherwise(F.col("text")).alias("text"), (F.col("turn") % 5 / 4.0).alias("confidence"))
    out = [crops.choose_reading(r, ["conv_id"], "turn", sweep=mode == "sweep").withColumn("mode", F.lit(mode)) for mode in ("sure", "sweep")]
    return out[0].unionByName(out[1]).select("mode", "conv_id", "backend", F.md5(F.col("text").cast("binary")).alias("digest"), "confidence", "n_candidates")


@query("""select user_id, count(*) filter (event_type = 'error') as failed, count(*) filter (event_type <> 'error') as done from events where user_id in (select user_id from events where event_id % 2 = 0) group by user_id""")
def st_counters_raised(spark, sf_dir):
    """Counters of even events, raised by an increment for each odd one."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_type") == "error").cast("long").alias("failed"), (F.col("event_type") != "error").cast("long").alias("done"))
    current = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.sum("failed").alias("failed"), F.sum("done").alias("done"))
    return store.add_increments(current, e.where("event_id % 2 = 1"), "user_id", ["failed", "done"])


@query(r"""with r as (select doc_id as row_idx, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from documents) select row_idx, md5(left(text, 700)) as digest from (select * from r where contains(lower(text), 'license') or contains(lower(text), 'token') order by row_idx, text limit 40) x""")
def src_dataset_pages(spark, sf_dir):
    """Documents as a dataset's pages of ten rows, read back; the first forty with a keyword are the feature."""
    row = F.struct(F.col("doc_id").alias("row_idx"), F.struct("text").alias("row"))
    pages = table(spark, sf_dir, "documents").groupBy(F.expr("doc_id div 10").alias("page")).agg(F.to_json(F.struct(F.collect_list(row).alias("rows"))).alias("payload"))
    return store.dataset_rows(pages, "payload", ["license", "token"], 40).select("row_idx", F.md5(F.col("text").cast("binary")).alias("digest"))
