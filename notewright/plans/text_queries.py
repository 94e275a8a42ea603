"""Text normalisation, page measures and classes over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.functions import scores, text, vocab
from notewright.operators import segment
from notewright.plans.registry import query
from notewright.session import table
from notewright.sources.store import upload_route


def _digest(spark: SparkSession, sf_dir: str, f) -> DataFrame:
    """(doc_id, digest, n_chars) of a function of the text."""
    t = table(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("t"))
    return t.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n_chars"))


def _digest_sql(expression: str) -> str:
    return f"select doc_id, md5(t) as digest, length(t) as n_chars from (select doc_id, {expression} as t from documents) x"


LIGHT = r"regexp_replace(regexp_replace(regexp_replace(translate(text, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _spaced(x: str) -> str:
    for a, b in vocab.SPACING:
        x = f"replace({x}, '{a}', '{b}')"
    return rf"regexp_replace({x}, '\s+[|¦]\s+', ' ', 'g')"


def _unnoised(x: str) -> str:
    noise = "|".join(f"(?:{p})" for p in vocab.NOISE_LINES)
    return f"array_to_string(list_filter(string_split({x}, chr(10)), lambda l: not regexp_matches(lower(l), '{noise}')), chr(10))"


WORD, TOKENS = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]+"


def _is_word(x: str) -> str:
    return f"regexp_full_match({x}, '{WORD}')"


UNREPEAT_SQL = rf"""with tok as (select doc_id, regexp_extract_all(text, '{TOKENS}') as k from documents)
select doc_id, array_to_string(list_filter(k, lambda x, i: not (
 ({_is_word('x')} and i > 2 and regexp_full_match(k[i-1], '\s+') and lower(k[i-2]) = lower(x))
 or (regexp_full_match(x, '\s+') and i > 1 and {_is_word("coalesce(k[i+1], '')")} and lower(k[i-1]) = lower(k[i+1])))), '') as t from tok"""


@query(r"""select source, count(*) as documents, sum(words)::bigint as words, count(*) filter (weak) as weak_pages, count(*) filter (bucket = 'xlong') as very_long
 from (select source, len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) as words,
  length(t) < 120 or len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) < 22 or (case when length(t) = 0 then 0 else round(length(regexp_replace(t, '[^\p{L}]', '', 'g')) / length(t), 4) end) < 0.28 as weak,
  case when len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) <= 120 then 'short' when len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) <= 220 then 'medium' when len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) <= 380 then 'long' else 'xlong' end as bucket
  from (select source, """ + LIGHT + " as t from documents) d) p group by source")
def inventory_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", text.whitespace(F.col("text")).alias("t"))
    d = d.withColumns({"words": text.word_count(F.col("t")), "weak": scores.weak_page(F.col("t"))})
    return d.withColumn("bucket", scores.length_bucket(F.col("words"))).groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("words").cast("long").alias("words"), F.count_if("weak").alias("weak_pages"), F.count_if(F.col("bucket") == "xlong").alias("very_long")
    )


@query(_digest_sql(LIGHT))
def txt_normalize_light(spark, sf_dir):
    return _digest(spark, sf_dir, text.whitespace)


@query(_digest_sql(_spaced("text")))
def txt_spacing_repair(spark, sf_dir):
    return _digest(spark, sf_dir, text.repair_spacing)


@query("select doc_id, md5(t) as digest, length(t) as n_chars from (" + UNREPEAT_SQL + ") x")
def txt_dupword(spark, sf_dir):
    return _digest(spark, sf_dir, text.drop_repeated_words)


@query(_digest_sql(_unnoised("text")))
def txt_noise_lines(spark, sf_dir):
    return _digest(spark, sf_dir, text.drop_noise_lines)


@query(r"""with l as (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'p': i, 'v': regexp_replace(x, '^\s+|\s+$', '', 'g')})) as s from documents),
 k as (select doc_id, s.p as p, s.v as v, row_number() over (partition by doc_id, lower(regexp_replace(s.v, '\s+', ' ', 'g')) order by s.p) as n from l where s.v <> ''),
 j as (select doc_id, string_agg(v, chr(10) order by p) as t from k where n = 1 group by doc_id)
 select d.doc_id, md5(coalesce(t, '')) as digest, length(coalesce(t, '')) as n_chars from documents d left join j using (doc_id)""")
def txt_line_dedup(spark, sf_dir):
    return _digest(spark, sf_dir, text.first_lines)


@query(r"""with a as (select doc_id, """ + _spaced(LIGHT) + r""" as text from documents),
 b as (""" + UNREPEAT_SQL.replace("with tok as", "with tok as materialized").replace("from documents", "from a") + r"""),
 c as (select doc_id, """ + _unnoised("t") + r""" as t from b),
 l as (select doc_id, unnest(list_transform(string_split(t, chr(10)), lambda x, i: {'p': i, 'v': regexp_replace(x, '^\s+|\s+$', '', 'g')})) as s from c),
 k as (select doc_id, s.p as p, s.v as v, row_number() over (partition by doc_id, lower(regexp_replace(s.v, '\s+', ' ', 'g')) order by s.p) as n from l where s.v <> ''),
 j as (select doc_id, string_agg(v, chr(10) order by p) as t from k where n = 1 group by doc_id)
 select d.doc_id, md5(regexp_replace(coalesce(t, ''), ' {2,}', ' ', 'g')) as digest, length(regexp_replace(coalesce(t, ''), ' {2,}', ' ', 'g')) as n_chars from documents d left join j using (doc_id)""")
def txt_clean_block(spark, sf_dir):
    return _digest(spark, sf_dir, text.clean_block)


@query(r"select doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::int as n_words from documents")
def txt_word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@query(r"select doc_id, case when length(text) = 0 then 0.0 else round(length(regexp_replace(text, '[^\p{L}]', '', 'g')) / length(text), 4) end as alpha from documents")
def txt_alpha_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.alpha_ratio(F.col("text")).alias("alpha"))


@query(f"select md5({LIGHT}) as text_hash, min(doc_id) as doc_id, count(*) as n from documents group by all")
def txt_hash_dedup(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.text_hash(F.col("text")).alias("text_hash"))
    return d.groupBy("text_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(_digest_sql(r"case when length(text) <= 5500 then text else left(text, 3570) || chr(10) || '[...]' || chr(10) || right(text, 1923) end"))
def txt_head_tail_trim(spark, sf_dir):
    return _digest(spark, sf_dir, lambda c: text.head_tail(c, 5500))


@query(_digest_sql(r"left(trim(regexp_replace(text, '\s+', ' ', 'g'), ' .,:;-'), 500)"))
def txt_clean_value(spark, sf_dir):
    return _digest(spark, sf_dir, text.clean_value)


@query(r"""select doc_id, coalesce(nullif(trim(regexp_replace(lower(x), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'uncategorized') as category,
 trim(replace(regexp_replace(x, '[^\p{L}\p{N}_.\- ]+', '_', 'g'), ' ', '_'), '._ ') as stem, left(x, 50) as bounded from (select doc_id, trim(left(regexp_replace(text, '\s+', ' ', 'g'), 60)) as x from documents) d""")
def txt_names(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.trim(F.left(F.regexp_replace("text", r"\s+", " "), F.lit(60))).alias("x"))
    return d.select("doc_id", text.category_key(F.col("x")).alias("category"), text.safe_stem(F.col("x")).alias("stem"), text.bounded(F.col("x"), 50).alias("bounded"))


@query(r"select doc_id, nullif(left(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 240), '') as sentence from documents")
def txt_first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("sentence"))


@query("""select event_id, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' || case when s % 60 > 0 then ' ' || (s % 60) || 's' else '' end
 when s < 86400 then (s // 3600) || 'h' || case when s % 3600 // 60 > 0 then ' ' || (s % 3600 // 60) || 'm' else '' end
 else (s // 86400) || 'd' || case when s % 86400 // 3600 > 0 then ' ' || (s % 86400 // 3600) || 'h' else '' end end as took from (select event_id, event_id * 37 as s from events) e""")
def txt_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.duration_text(F.col("event_id") * 37).alias("took"))


@query(_digest_sql(r"regexp_replace(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_]+)-\s+([\p{L}\p{N}_]+)', '\1\2', 'g'), ' {2,}', ' ', 'g'), '^[\s:;\-|,.]+', '')"))
def spl_join_broken(spark, sf_dir):
    return _digest(spark, sf_dir, text.join_broken_words)


def _display_sql(x: str) -> str:
    x = f"upper(left({x}, 1)) || substr({x}, 2)"
    for a, b in vocab.UNITS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"select p_partkey, {_display_sql(chr(39) + 'x' + chr(39)).replace(chr(39) + 'x' + chr(39), 'v')} as shown from (select p_partkey, concat(p_name, ' ', p_size, ' ml of 30 gy ') as v from part) p")
def spl_display_form(spark, sf_dir):
    v = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" ml of 30 gy "))
    return table(spark, sf_dir, "part").select("p_partkey", text.display_form(v).alias("shown"))


W = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))"


@query(rf"""select doc_id, length(text) < 120 or {W} < 22 or (case when length(text) = 0 then 0 else round(length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) / length(text), 4) end) < 0.28 as weak from documents""")
def prd_weak_page(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scores.weak_page(F.col("text")).alias("weak"))


def _hits_sql(c: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"regexp_matches({c}, '(?i){p}')::int" for p in patterns) + ")"


def dates_sql(c: str) -> str:
    return "list_concat(" + ", ".join(f"regexp_extract_all({c}, '(?i)({p})', 1)" for p in vocab.DATES) + ")"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


@query(rf"""select doc_id, {W} < 12 or {_hits_sql('text', vocab.LOW_VALUE)} >= 2 or (contains(lower(text), 'prescription has been issued') and {W} < 45) as low_value,
 (least(length(text) // 400, 4) + least(len({distinct_in_order('d')}), 3) + {_hits_sql('text', vocab.HINTS)})::int as signal from (select doc_id, text, {dates_sql('text')} as d from documents) x""")
def prd_signal(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", scores.low_value(t).alias("low_value"), scores.signal(t, scores.dates_in(t)).alias("signal"))


def _types_sql() -> str:
    cases = "".join(" when " + " or ".join(f"contains(lower(text), '{k}')" for k in keys) + f" then '{name}'" for keys, name in vocab.DOC_TYPES)
    return "case" + cases + " when text = '' then 'empty_or_unreadable_document' else 'unknown_medical_document' end"


@query(f"select doc_id, {_types_sql()} as doc_type from documents")
def prd_doc_type(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scores.document_type(F.col("text")).alias("doc_type"))


BUCKET_SQL = f"case when {W} <= 120 then 'short' when {W} <= 220 then 'medium' when {W} <= 380 then 'long' else 'xlong' end"


@query(f"select bucket, count(*) as n, max(tokens) as tokens from (select {BUCKET_SQL} as bucket, case when {W} <= 220 then 1024 else 1536 end as tokens from documents) d group by bucket")
def bat_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(scores.length_bucket(text.word_count(F.col("text"))).alias("bucket"))
    return d.withColumn("tokens", scores.token_budget(F.col("bucket"))).groupBy("bucket").agg(F.count("*").alias("n"), F.max("tokens").alias("tokens"))


@query(r"""with w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) as token from documents) select token, count(*) as documents from w group by token having count(*) >= 20""")
def txt_vocabulary(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0))
    d = table(spark, sf_dir, "documents").select(F.explode(words).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("documents")).where("documents >= 20")


@query(f"""with h as (select conv_id, turn, md5({LIGHT}) as h from conversations), m as (select conv_id, min(turn) as turn, h from h group by conv_id, h)
 select conv_id, turn, h as text_hash from m""")
def seg_exact_dedup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return segment.first_of_equal(c, ["conv_id"], ["turn"], "text").select("conv_id", "turn", "text_hash")


@query(r"select page_id, case when regexp_extract(lower(url), '\.([^./]+)$', 1) = 'json' then 'import' when regexp_extract(lower(url), '\.([^./]+)$', 1) in ('pdf', 'txt', 'text') then 'document' else 'error' end as route from pages")
def src_upload_route(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", upload_route(F.col("url")).alias("route"))
