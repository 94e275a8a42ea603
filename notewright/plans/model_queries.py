"""What goes to outside models and what comes back: batches, replies, payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import scores
from notewright.functions.text import word_count
from notewright.operators import batches, hooks, payloads
from notewright.plans.registry import query
from notewright.plans.text_queries import BUCKET_SQL, W
from notewright.session import table

BATCHES = f"""b as (select doc_id, prompt, bucket, n_chars, row_number() over (partition by bucket order by words, doc_id) - 1 as r, case bucket when 'short' then 6 when 'medium' then 4 when 'long' then 2 else 1 end as most,
  case bucket when 'short' then 0 when 'medium' then 1 when 'long' then 2 else 3 end as o from (select doc_id, case when doc_id % 97 = 0 then 'BUSY ' else '' end || text as prompt, length(text) as n_chars, {W} as words, {BUCKET_SQL} as bucket from documents) d),
 s as (select o, (count(*) + max(most) - 1) // max(most) as n from b group by o), f as (select a.o, coalesce(sum(c.n), 0) as start from s a left join s c on c.o < a.o group by a.o),
 g as (select b.*, (start + r // most)::bigint as batch_no from b join f using (o))"""


def _batched(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", word_count(F.col("text")).alias("words"))
    return batches.global_batches(d, "words", "doc_id")


@query(f"with {BATCHES} select doc_id, bucket, batch_no, (r % most)::int as batch_place from g")
def bat_batches(spark, sf_dir):
    return _batched(spark, sf_dir).select("doc_id", "bucket", "batch_no", "batch_place")


@query(f"""with {BATCHES}, c as (select *, count(*) over (partition by batch_no) as size, bool_or(starts_with(prompt, 'BUSY')) over (partition by batch_no) as busy, case when bucket in ('long', 'xlong') then 1536 else 1024 end as budget from g),
 t as (select *, size > 1 and busy as refused from c), e as (select *, case when refused then 'RuntimeError: 429 rate limit: try again in 1.5s' when length(prompt) > budget then 'no JSON in the reply' end as error from t)
 select batch_no, count(*) as notes, 1 + count(error) as calls, count(*) filter (error is null or length(prompt) <= 1536) as replies, count(*) filter (error is not null and length(prompt) > 1536) as failed, max(error) as error,
 max(case when refused then 2.25 else 0.0 end)::double as wait from e group by batch_no""")
def udf_batches(spark, sf_dir):
    """Documents sent to a stand-in with limits, one call a batch; refused and unread ones sent again alone."""
    prompt = F.concat(F.when(F.col("doc_id") % 97 == 0, "BUSY ").otherwise(""), F.col("text"))
    b = _batched(spark, sf_dir).withColumns({"prompt": prompt, "budget": scores.token_budget(F.col("bucket"))})
    r = batches.ask_batches(b, batches.StrainedGenerator, "doc_id", "prompt", "budget", pause=batches.no_pause)
    lost = F.col("retried") & F.col("retry_error").isNotNull()
    return r.groupBy("batch_no").agg(
        F.count("*").alias("notes"), (1 + F.count_if("retried")).alias("calls"), F.count_if(~lost).alias("replies"), F.count_if(lost).alias("failed"), F.max("error").alias("error"), F.max("wait").alias("wait")
    )


@query("""select concat_ws('-', conv_id, turn) as key, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[1:5], ' ') as value, null::varchar as error from conversations""")
def udf_generator_hook(spark, sf_dir):
    """The generation hook with its stand-in: a reply that quotes the prompt's first words."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text", F.lit(64).alias("budget"))
    r = hooks.run_generator(c, hooks.EchoGenerator, "key", "text", "budget", 16)
    return r.select("key", F.get_json_object("reply", "$.mentions[0].value").alias("value"), "error")


#: Replies in six states: sound, fenced with a trailing comma, single quotes beside an apostrophe, bare keys with Python's literals, cut off, none.
LOOSE = """case p_partkey % 6 when 0 then concat('{"label": "', p_name, '", "n": ', p_size, ', "sure": true}')
 when 1 then concat('```json', chr(10), '{"label": "', p_name, '", "n": ', p_size, ', "sure": true,}', chr(10), '```') when 2 then concat('Here: {''label'': ''', p_name, ' isn''t it'', ''n'': ', p_size, ', ''sure'': None}')
 when 3 then concat('{label: ', p_name, ', n: ', p_size, ', sure: True}') when 4 then concat('{"n": ', p_size, ', "sure": false, "label": "', p_name) else concat('no reply for ', p_name) end"""


@query("""select p_partkey::varchar as key, case p_partkey % 6 when 5 then null when 2 then p_name || ' isn''t it' else p_name end as label, case when p_partkey % 6 < 5 then p_size::varchar end as n,
 case p_partkey % 6 when 0 then 'true' when 1 then 'true' when 3 then 'true' when 4 then 'false' end as sure from part""")
def json_tolerant(spark, sf_dir):
    r = hooks.parse_replies(table(spark, sf_dir, "part").select("p_partkey", F.expr(LOOSE).alias("reply")), "p_partkey", "reply")
    return r.select("key", *[F.get_json_object("parsed", f"$.{k}").alias(k) for k in ("label", "n", "sure")])


#: A tree and a layout result of each part, with boxes of every form.
FORMS = """case when p_size % 2 = 0 then concat('{"texts": [{"text": "  "}, {"orig": " ', p_name, ' ", "label": "', case when p_size % 4 = 0 then 'page_header' else 'paragraph' end, '", "prov": [{"page_no": ', p_size, ', "bbox": ',
  case p_partkey % 3 when 0 then '[1, 2, 3, 4]' when 1 then '{"l": 1, "t": 2, "r": 3, "b": 4}' else '{"x0": 1, "y0": 2, "x1": 3, "y1": 4, "k": "x"}' end, '}]}], "tables": [{"label": "t"}], "pictures": [{"prov": [{"page_num": 7}]}]}')
 else concat('{"res": {"layout_det_res": {"boxes": [{"label": "seal", "score": 0.5, "coordinate": [1, 2, 3, 4]}, {"label": "Side Bar", "score": 0.25, "coordinate": [[2, 9], [8, 4], [5, 5]]}]}, "parsing_res_list": [{"block_label": "table", "html": "<t>', p_brand, '</t>", "bbox": [0, 0, 10, 20]}],
  "overall_ocr_res": {"rec_texts": ["', p_name, '", ""], "rec_scores": [0.75], "dt_polys": [[[1, 1], [4, 1], [4, 3], [1, 3]], []]}}}') end"""


@query("""with t as (select * from part where p_size % 2 = 0), l as (select * from part where p_size % 2 = 1)
 select p_partkey, 2 as reading_order, 'text_block' as artifact_type, case when p_size % 4 = 0 then 'header' else 'body' end as role, p_name as text, 0.85::double as confidence, p_size as page_num, '1.0,2.0,3.0,4.0' as box from t
 union all select p_partkey, 3, 'table', 'table', '', 0.8, 0, null from t union all select p_partkey, 4, 'figure', 'embedded_figure', '', 0.7, 7, null from t
 union all select p_partkey, 1, 'page_region', 'side_bar', '', 0.25, 3, '4.0,6.0,16.0,13.5' from l
 union all select p_partkey, 2, 'table', 'table', '<t>' || p_brand || '</t>', 0.0, 3, '0.0,0.0,20.0,30.0' from l
 union all select p_partkey, 3, 'text_block', 'body', p_name, 0.75, 3, '2.0,1.5,8.0,4.5' from l""")
def jsn_payload_forms(spark, sf_dir):
    """Both payload forms through one operator; boxes doubled in width and half as high again in height."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(FORMS).alias("payload"))
    b = payloads.payload_blocks(p, ["p_partkey"], "payload", F.lit(3), (F.lit(2.0), F.lit(1.5)))
    return b.select("p_partkey", "reading_order", "artifact_type", "role", "text", "confidence", "page_num", F.array_join(F.transform("bbox", lambda x: x.cast("string")), ",").alias("box"))
