"""Parsed documents, page artifacts, layout notes and outside models, on rows made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.functions import parsers, scores
from notewright.operators import hooks, pages, segment, spelling
from notewright.plans.fixtures import boxes, mentions, notes
from notewright.plans.note_queries import _ROLE, KEYS, B, K, N
from notewright.plans.record_queries import M
from notewright.plans.registry import query
from notewright.session import table


@query(r"""select doc_id, i as reading_order, 'body' as role, md5(v) as digest from (select doc_id, unnest(s).i as i, unnest(s).v as v from (select doc_id,
 list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> ''), lambda x, i: {'i': i::int, 'v': x}) as s from documents) d) e""")
def src_page_scan(spark, sf_dir):
    """Bytes to block rows by a parser; the stand-in reads lines, after a parser that always fails."""
    files = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    blocks = hooks.parse_documents(files, [hooks.BrokenParser, hooks.LineParser], "doc_id", "content").where("reading_order is not null")
    return blocks.select(F.col("key").cast("long").alias("doc_id"), "reading_order", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""with c as (select conv_id, text, row_number() over (partition by conv_id order by turn) as n, turn from conversations), p as (select conv_id, max(text) filter (n = 1) as text from c group by conv_id),
 i as (select conv_id, string_agg(trim(text), chr(10) order by turn) as t from c where n > 1 and turn * 20000 >= 40000 and trim(text) <> '' group by conv_id)
 select p.conv_id, md5(case when i.t is null then p.text when p.text <> '' then p.text || chr(10) || chr(10) || i.t else i.t end) as digest, case when i.t is null then 'native' else 'native+img' end as source from p left join i using (conv_id)""")
def src_image_append(spark, sf_dir):
    """The first turn stands for a page's text, later ones for texts of its images of growing size."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "text", "turn")
    first = c.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"), F.min("turn").alias("first")).withColumn("source", F.lit("native"))
    images = c.join(first.select("conv_id", "first"), "conv_id").where("turn > first").select("conv_id", F.col("turn").alias("image_ix"), (F.col("turn") * 100).alias("width"), F.lit(200).alias("height"), F.col("text").alias("image_text"))
    out = pages.append_image_text(first.drop("first"), images, ["conv_id"])
    return out.select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"), "source")


@query(f"""with {B}, l as (select doc, max(reading_order) as last from boxes where x0 < 100 group by doc), i as (select doc, row_number() over (partition by doc order by block_id) as image_ix from boxes where x0 >= 100)
 select doc, image_ix, 'embedded_figure' as role, coalesce(last, 0) + image_ix as reading_order from i left join l using (doc)""")
def src_image_artifacts(spark, sf_dir):
    b = boxes(spark, sf_dir)
    images = b.where("x0 >= 100").select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("block_id")).cast("long").alias("image_ix"))
    return pages.image_artifacts(b.where("x0 < 100"), images, ["doc"]).select("doc", "image_ix", "role", "reading_order")


ZONE_ROWS = ", ".join(f"({i}, '{r}', '{z}', {', '.join(f'{v}::double' for v in b)})" for i, (r, z, *b) in enumerate(pages.SWEEP_ZONES, 1))


@query(f"""with p as (select distinct l_orderkey as doc, l_linenumber as page from lineitem), k as (select *, dense_rank() over (partition by doc order by page) as r from p),
 c as (select doc, page, n, role, zone, x0, y1, list_transform(range(0, 8), lambda i: (i * (doc + n) % 7 * (page + 1)) % 256) as gray, case when (doc + n) % 5 = 0 then ' x ' else concat(' read ', doc, ' in ', zone, ' ') end as t from k cross join (values {ZONE_ROWS}) z(n, role, zone, x0, y0, x1, y1) where r <= 4)
 select doc, page, zone, case when role in ('orders', 'vitals', 'identity') then 'handwriting' else 'text_block' end as artifact_type, (5000 + n)::bigint as reading_order, trim(t) as text, case when n % 3 = 0 then 0.5 else 0.72 end::double as confidence,
 round(x0 * 600, 2) as x0, round(y1 * 800, 2) as y1 from c where length(trim(t)) >= 3 and list_aggregate(gray, 'stddev_pop') >= 7""")
def src_zone_sweep(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")).distinct()
    crops = pages.vision_crops(p.select("doc", "page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height")), "doc", "page")
    read = crops.withColumns(
        {
            "gray": F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i * (F.col("doc") + F.col("zone_no")) % 7 * (F.col("page") + 1)) % 256),
            "text": F.when((F.col("doc") + F.col("zone_no")) % 5 == 0, " x ").otherwise(F.concat(F.lit(" read "), F.col("doc").cast("string"), F.lit(" in "), "zone", F.lit(" "))),
            "confidence": F.when(F.col("zone_no") % 3 == 0, 0.5),
        }
    )
    return pages.sweep_artifacts(read, "sweep").select("doc", "page", "zone", "artifact_type", "reading_order", "text", "confidence", "x0", "y1")


@query("select p_partkey, list_aggregate(list_transform(range(0, 6), lambda i: p_size + i * (p_partkey % 9)), 'stddev_pop') < 7 as blank from part")
def prd_blank_crop(spark, sf_dir):
    gray = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.col("p_size") + i * (F.col("p_partkey") % 9))
    return table(spark, sf_dir, "part").select("p_partkey", pages.blank_crop(gray).alias("blank"))


ORDER = """named_struct('drug', case when q % 3 = 0 then 'Docetaxel' else '' end, 'expanded_text', case when q % 4 = 0 then concat('give ', q, ' mg') else '' end, 'raw_text', case when q % 4 = 1 then concat('docetaxel ', q) else '' end,
 'text', case when q % 4 = 2 then 'rest well' else '' end, 'drug_candidates', case when q % 5 = 0 then array(named_struct('normalized', 'ondansetron')) else cast(array() as array<struct<normalized:string>>) end)"""
_DRUG = "case when q % 3 = 0 then 'Docetaxel' when q % 5 = 0 then 'ondansetron' else '' end"
_SHOWN = "case q % 4 when 0 then concat('give ', q, ' mg') when 1 then concat('docetaxel ', q) when 2 then 'rest well' else '' end"


@query(f"with {N} select {K}, {_DRUG} as drug from notes")
def ext_best_drug(spark, sf_dir):
    return notes(spark, sf_dir).withColumn("o", F.expr(ORDER)).select(*KEYS, pages.best_drug(F.col("o")).alias("drug"))


@query(f"""with {N}, o as (select {K}, q, {_DRUG} as drug, {_SHOWN} as shown from notes),
 l as (select {K}, q, case when shown <> '' and (drug <> '' or q % 4 = 0) then concat('Medication order: ', case when drug <> '' and not contains(lower(shown), lower(drug)) then drug || ': ' else '' end, shown) end as a,
 case when q % 2 = 0 then concat('Vital: BP ', q) end as b, case when q % 7 = 0 then concat('Ward: ', line) end as c from o)
 select {K}, case when a is null and b is null and c is null then 'saline OD (once daily)' else concat_ws(chr(10), a, b, c) end as text from l""")
def src_order_lines(spark, sf_dir):
    q = F.col("q")
    pair = lambda label, value: F.array(F.struct(F.lit(label).alias("label"), value.cast("string").alias("value")))
    n = notes(spark, sf_dir).withColumn("orders", F.array(F.expr(ORDER)))
    text = pages.order_lines(F.col("orders"), F.when(q % 2 == 0, pair("BP", q)), F.when(q % 7 == 0, pair("Ward", F.col("line"))), F.lit(" saline  od "))
    return n.select(*KEYS, text.alias("text"))


@query(f"""with {B}, c as (select doc, block_id, x0, top as y0, x1, top + 3 * (bottom - top) as y1 from boxes),
 f as (select *, (x1 - x0) * (y1 - y0) / 480000.0::double as area, (x1 - x0) / greatest(y1 - y0, 1) as aspect from c),
 s as (select *, round(case when x0 <= 150 then 3.0 else 0 end + case when y0 >= 144 and y0 <= 400 then 3.0 else 0 end + case when y1 - y0 >= x1 - x0 then 2.0 else 0 end + least(100 * area, 2.0), 6) as score from f
 where y0 >= 96 and x0 <= 210 and area between 0.0008 and 0.05 and aspect between 0.35 and 1.35), b as (select *, row_number() over (partition by doc order by score desc, block_id) as n from s)
 select d.doc, case when b.doc is null then 'page_crop_fallback' else 'embedded_image' end as method, coalesce(b.x0, 36.0)::double as x0, coalesce(b.y0, 192.0)::double as y0, coalesce(b.x1, 150.0)::double as x1, coalesce(b.y1, 344.0)::double as y1
 from (select distinct doc from boxes) d left join b on b.doc = d.doc and b.n = 1""")
def src_profile_photo(spark, sf_dir):
    b = boxes(spark, sf_dir)
    first = b.select("doc", "width", "height").distinct()
    images = b.select("doc", F.col("block_id").alias("image_ix"), "x0", F.col("top").alias("y0"), "x1", (F.col("top") + 3 * (F.col("bottom") - F.col("top"))).alias("y1"))
    return pages.profile_photos(first, images, "doc").drop("image_ix")


LINE = "concat(text, ' ', block_id, case when part % 3 = 0 then '' else ' stands here among other lines as one piece of that sheet' end)"


@query(f"""with boxes as (select *, reading_order as part from ({B.split(' as ', 1)[1]}) x), k as (select doc, block_id % 2 + 1 as sheet, block_id, top, bottom, reading_order, {_ROLE} as role, {LINE} as t from boxes),
 l as (select *, coalesce(top - lag(bottom) over (partition by doc, sheet order by top, reading_order, block_id) > 42, false) as j from k where role not in ('header', 'footer')),
 s as (select *, 1 + sum(j::int) over (partition by doc, sheet order by top, reading_order, block_id rows unbounded preceding) as note_ix from l),
 n as (select doc, sheet, note_ix, string_agg(t, chr(10) order by top, reading_order, block_id) as text, count(*) as n_blocks from s group by doc, sheet, note_ix)
 select doc, printf('p%04d_n%03d', sheet::int, note_ix::int) as note_id, n_blocks, md5(text) as digest from n where len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) >= 12""")
def seg_layout_notes(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("part", F.col("reading_order")).withColumn("reading_order", F.struct("reading_order", "block_id"))
    role = scores.block_role(F.col("top"), F.col("bottom"), F.col("height"), F.col("text"))
    a = b.withColumns({"sheet": F.col("block_id") % 2 + 1, "role": role, "artifact_type": F.lit("text_block"), "text": F.expr(LINE)})
    n = segment.layout_notes(a, "doc", "sheet")
    return n.select("doc", "note_id", "n_blocks", F.md5(F.col("note").cast("binary")).alias("digest"))


@query(f"""with {M} select seq, case when length(trim(value)) >= 8 then 'x' || value else value end as value, case when length(trim(label)) >= 8 then 'x' || label else label end as label,
 case when length(trim(normalized_value)) >= 8 then 'x' || normalized_value else normalized_value end as normalized_value, category from mentions""")
def spl_field_loop(spark, sf_dir):
    """The four correctable fields and no other, if they are long enough; the correction is a mark, to be seen."""
    fixed = spelling.correct_fields(mentions(spark, sf_dir), lambda c: F.concat(F.lit("x"), c))
    return fixed.select("seq", "value", "label", "normalized_value", "category")


# Written by hand from the rules, so that a wrong parser shows.
DISPATCH = [
    ("performance_status", "PS 1 and KPS 80", "ps", '{"ecog":1,"kps":80}'),
    ("radiotherapy", "sbrt 30 Gy 5 fr", "rt", '{"modality":"SBRT","dose":"30 Gy","fractions":5}'),
    ("follow_up", "after 2 weeks", "review", '{"label":"review","value":"after 2 weeks"}'),
    ("anything", "", "", '{"label":"","value":""}'),
]


@query("select n_nationkey, category, parsed from nation cross join (values " + ", ".join(f"('{c}', '{j}')" for c, _, _, j in DISPATCH) + ") d(category, parsed)")
def par_dispatch(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(v).alias("value"), F.lit(lb).alias("label")) for c, v, lb, _ in DISPATCH])
    x = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(rows).alias("x")).select("n_nationkey", "x.*")
    return x.select("n_nationkey", "category", parsers.parsed(F.col("category"), F.col("value"), F.col("label")).alias("parsed"))


@query(f"""with {M} select subject, 'second' as model, 'completed' as status, 0.5::double as confidence, 'few,model' as flags from mentions group by subject""")
def udf_validator(spark, sf_dir):
    """Records through two models: the first never answers in the contract's form, the second does."""
    s = mentions(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"))
    r = s.select("subject", F.format_string("%d mentions", "n").alias("prompt"), F.array(F.lit("few")).alias("flags"), F.lit(0.9).alias("confidence"), F.array().cast("array<string>").alias("missing"))
    v = hooks.validate_records(r, [("first", hooks.EchoGenerator), ("second", hooks.FixedVerdict)], "subject", "prompt")
    return v.select(F.col("key").cast("long").alias("subject"), "model", "status", "confidence", F.array_join("flags", ",").alias("flags"))
