"""Notes: sections, layout, extraction, parsing, triage, spelling; on notes made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewright.functions import parsers, scores, vocab
from notewright.functions.text import word_count
from notewright.operators import extract, segment, spelling
from notewright.plans.fixtures import BOXES_SQL, NOTES_SQL, boxes, notes
from notewright.plans.registry import query
from notewright.plans.text_queries import _hits_sql, dates_sql, distinct_in_order
from notewright.session import table

KEYS = ["doc", "line", "part", "subject"]
K = ", ".join(KEYS)
N = f"notes as ({NOTES_SQL})"
W = r"len(regexp_extract_all(note, '[\p{L}\p{N}_]+'))"


def _first(c: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({c}, '(?i){pattern}', {group}), '')"


def _case(c: str, table_: list[tuple[str, str]], regex: bool = True) -> str:
    test = (lambda p: f"regexp_matches({c}, '{p}')") if regex else (lambda p: f"contains({c}, '{p}')")
    return "case " + " ".join(f"when {test(p)} then '{v}'" for p, v in table_) + " end"


def _line_with(keyword: str) -> str:
    return f"regexp_replace(list_filter(string_split(note, chr(10)), lambda l: contains(lower(l), '{keyword}'))[1], '^\\s+|\\s+$', '', 'g')"


def _plan_sql(text: str = "note") -> str:
    """Lines after the header up to a stop, by the positions of both in the list of lines."""
    lines = f"list_filter(list_transform(regexp_split_to_array({text}, '\\n+'), lambda l: regexp_replace(l, '^\\s+|\\s+$', '', 'g')), lambda l: l <> '')"
    return f"""(select array_to_string(list_filter(ls, lambda l, i: i > h and i <= h + 6 and i < e), ' ') from (select ls, h,
 coalesce(list_min(list_filter(list_transform(ls, lambda l, i: case when i > h and regexp_matches(lower(l), '{vocab.PLAN_END}') then i end), lambda x: x is not null)), 1000000) as e
 from (select ls, coalesce(list_min(list_filter(list_transform(ls, lambda l, i: case when regexp_matches(lower(l), '{vocab.PLAN_START}') then i end), lambda x: x is not null)), 1000000) as h from (select {lines} as ls))))"""


def _mentions_sql() -> str:
    parts: list[str] = []

    def put(category: str, label: str, values: str) -> None:
        parts.append(f"select {K}, '{category}' as category, '{label}' as label, unnest(v) as value, generate_subscripts(v, 1) as i, {len(parts)} as g from (select {K}, {values} as v from notes)")

    def every(c: str, p: str) -> str:
        return f"regexp_extract_all({c}, '(?i){p}', 1)"

    diagnosis = "coalesce(" + ", ".join(_first("note", p) for p in vocab.DIAGNOSIS) + ")"
    put("diagnosis", "diagnosis", f"[regexp_split_to_array({diagnosis}, '[\\n|]')[1]]")
    for c, lb, p in vocab.FINDINGS:
        put(c, lb, every("note", p))
    put("medication", "medication", f"list_filter({every('note', vocab.TABLET)}, lambda v: length(trim(v)) >= 5)")
    for d in vocab.DRUGS:
        put("medication", "drug", f"case when contains(lower(note), '{d}') then [{_line_with(d)}] else [] end")
    for c, lb, p in [*vocab.SYMPTOMS, *vocab.STATUS]:
        put(c, lb, every("note", p))
    for k, c in vocab.PROCEDURES:
        put(c, k, f"case when regexp_matches(lower(note), '\\b{k}\\b') then [{_line_with(k)}] else [] end")
    put("lab", "serum creatinine", every("lower(note)", vocab.CREATININE))
    put("genomics", "NGS", every("note", vocab.GENOMICS))
    put("plan", "plan", f"[{_plan_sql()}]")
    put("follow_up", "follow_up", every("note", vocab.FOLLOW_UP))
    return " union all ".join(parts)


MENTIONS = f"""raw as ({_mentions_sql()}), bare as (select {K}, category, label, regexp_replace(value, '^\\s+|\\s+$', '', 'g') as value, g, i from raw),
 one as (select {K}, category, arg_min(label, (g, i)) as label, arg_min(value, (g, i)) as value from bare where value <> '' group by {K}, category, lower(label), lower(value))"""


@query(f"with {N}, {MENTIONS} select {K}, category, label, value, left(value, 240) as evidence_quote, coalesce({dates_sql('note')}[1], '') as date_text from one join notes using ({K})")
def ext_mentions(spark, sf_dir):
    m = extract.note_mentions(notes(spark, sf_dir), KEYS)
    return m.select(*KEYS, "category", "label", "value", "evidence_quote", "date_text")


@query(f"with {N} select {K}, array_to_string({distinct_in_order(dates_sql('note'))}, ';') as dates, coalesce({dates_sql('note')}[1], '') as first_date from notes")
def ext_dates_first(spark, sf_dir):
    d = notes(spark, sf_dir).withColumn("d", scores.dates_in(F.col("note")))
    return d.select(*KEYS, F.array_join("d", ";").alias("dates"), F.coalesce(F.get("d", F.lit(0)), F.lit("")).alias("first_date"))


@query(f"with {N} select {K}, {_plan_sql()} as plan from notes")
def ext_plan_block(spark, sf_dir):
    return notes(spark, sf_dir).select(*KEYS, extract.plan_block(F.col("note")).alias("plan"))


def _fields_sql() -> str:
    out = []
    for c, lb, p in [*vocab.FIELDS, *vocab.VITALS]:
        quoted = p.replace("'", "''")
        out.append(f"select {K}, '{c}' as category, '{lb}' as label, unnest(regexp_extract_all(form, '(?i){quoted}', 1)) as v from notes")
    return " union all ".join(out)


@query(f"with {N}, f as ({_fields_sql()}) select {K}, category, label, lower(left(trim(regexp_replace(v, '\\s+', ' ', 'g'), ' .,:;-'), 500)) as value from f where trim(regexp_replace(v, '\\s+', ' ', 'g'), ' .,:;-') <> '' group by all")
def ext_fields_vitals(spark, sf_dir):
    f = extract.field_mentions(notes(spark, sf_dir), KEYS, "form")
    return f.select(*KEYS, "category", "label", F.lower("value").alias("value"))


@query(f"with {N} select {K}, coalesce(nullif(regexp_extract(substr(note, p, 90), '(?i){vocab.ORDER_DOSE}', 0), ''), nullif(regexp_extract(substr(note, greatest(p - 20, 1), p + 60 - greatest(p - 20, 1)), '(?i){vocab.ORDER_DOSE}', 0), '')) as dose from (select *, position('sunitinib' in lower(note)) as p from notes) n where p > 0")
def spl_nearby_dose(spark, sf_dir):
    n = notes(spark, sf_dir).where(F.contains(F.lower("note"), F.lit("sunitinib")))
    return n.select(*KEYS, extract.nearby_dose(F.col("note"), "sunitinib").alias("dose"))


def _expanded_sql(x: str) -> str:
    for p, r in extract.short_form_steps():
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return x


@query(f"with {N} select {K}, md5({_expanded_sql('note')}) as digest from notes")
def ext_short_forms(spark, sf_dir):
    return notes(spark, sf_dir).select(*KEYS, F.md5(extract.expand_short_forms(F.col("note")).cast("binary")).alias("digest"))


def _parse_query(spark, sf_dir, struct, columns):
    n = notes(spark, sf_dir).withColumn("s", struct)
    return n.select(*KEYS, *[F.col(f"s.{c}").alias(c) for c in columns])


def _line(spark_side: bool, prefix: str):
    return F.regexp_extract(F.col("note"), f"(?id)({prefix}[^\n]*)", 1) if spark_side else f"regexp_extract(note, '(?i)({prefix}[^\\n]*)', 1)"


LOW = f"lower({_line(False, '(?:diagnosis|imp|case of)')})"
_SIDE = "case when contains({0}, 'bilateral') then 'Bilateral' when contains({0}, 'right') or contains({0}, ' rt ') {1} then 'Right' when contains({0}, 'left') or contains({0}, ' lt ') {2} then 'Left' end"


@query(f"""with {N}, v as (select {K}, {LOW} as low from notes) select {K},
 coalesce('Stage ' || upper({_first('low', vocab.STAGE)}), upper({_first('low', vocab.TNM)})) as stage, {_case('low', [(k, k.title()) for k in vocab.HISTOLOGY], False)} as histology,
 'Grade ' || upper({_first('low', vocab.GRADE)}) as grade, {_SIDE.format('low', "or starts_with(low, 'rt ')", "or starts_with(low, 'lt ')")} as laterality from v""")
def par_diagnosis(spark, sf_dir):
    return _parse_query(spark, sf_dir, parsers.diagnosis(_line(True, "(?:diagnosis|imp|case of)")), ["stage", "histology", "grade", "laterality"])


@query(f"""with {N}, v as (select {K}, {_line(False, 'tab ')} as v from notes) select {K},
 coalesce({_first('v', r'\b(?:tab|t\.|cap|inj|inj\.)\s*([A-Za-z][A-Za-z0-9\-]+)')}, nullif(regexp_extract(v, '\\b([A-Z][a-z]{{3,}})\\b', 1), '')) as drug_name,
 {_first('v', vocab.DOSE, 0)} as dose, {_case('lower(v)', vocab.FREQUENCY)} as frequency, {_case('lower(v)', vocab.ROUTE, False)} as route, {_first('lower(v)', r'for\s+(\d+\s+(?:week|month|day)s?)')} as duration from v""")
def par_medication(spark, sf_dir):
    return _parse_query(spark, sf_dir, parsers.medication(_line(True, "tab ")), ["drug_name", "dose", "frequency", "route", "duration"])


@query(f"""with {N}, v as (select {K}, {_line(False, 'pet ct')} as v from notes) select {K}, {_case('lower(v)', vocab.MODALITY)} as modality,
 left(trim({_first('v', r'(?:pet\s*ct|cect|mri|ct|usgs?|hrct)[^\n:]*[:\-]\s*(.+)')}), 300) as finding from v""")
def par_imaging(spark, sf_dir):
    return _parse_query(spark, sf_dir, parsers.imaging(_line(True, "pet ct")), ["modality", "finding"])


@query(f"""with {N}, v as (select {K}, {_line(False, 'hpr')} as v from notes) select {K}, {_case('lower(v)', [('hpr', 'HPR'), ('ihc', 'IHC'), ('histopathology', 'histopathology'), ('cytology', 'cytology')], False)} as report_type,
 left(trim({_first('v', r'(?:hpr|ihc|histopath)[^\n:]*[:\-]\s*(.+)')}), 300) as result, 'Grade ' || upper({_first('lower(v)', vocab.GRADE)}) as grade from v""")
def par_pathology(spark, sf_dir):
    return _parse_query(spark, sf_dir, parsers.pathology(_line(True, "hpr"), F.lit("")), ["report_type", "result", "grade"])


@query(f"""with {N}, v as (select {K}, {_line(False, 'serum creat')} as v from notes) select {K}, 'creatinine' as test, nullif(regexp_extract(v, '(\\d+(?:\\.\\d+)?)', 1), '') as value_raw from v""")
def par_lab(spark, sf_dir):
    return _parse_query(spark, sf_dir, parsers.lab(_line(True, "serum creat"), F.lit("creatinine")), ["test", "value_raw"])


@query(f"""with {N}, v as (select {K}, {_line(False, 'ngs')} as v from notes) select {K}, coalesce(nullif(left(trim({_first('v', r'(?:ngs|wes|fish|ihc)[^\n:]*[:\-]\s*(.+)')}), 300), ''), v) as finding from v""")
def par_genomics(spark, sf_dir):
    return _parse_query(spark, sf_dir, parsers.genomics(_line(True, "ngs"), F.lit("NGS")), ["finding"])


@query(f"""with {N} select {K}, try_cast({_first('note', r'\bps\s*[-:]?\s*([0-4])\b')} as int) as ecog, try_cast({_first('note', r'\bkps\s*(\d{2,3})\b')} as int) as kps from notes""")
def par_performance(spark, sf_dir):
    return _parse_query(spark, sf_dir, parsers.performance_status(F.col("note")), ["ecog", "kps"])


@query(f"""with {N} select {K}, coalesce({_case('lower(note)', [(k, k) for k in vocab.OPERATIONS], False)}, 'surgery') as procedure, {_SIDE.format('lower(note)', '', '')} as laterality from notes""")
def par_surgery(spark, sf_dir):
    return _parse_query(spark, sf_dir, parsers.surgery(F.col("note"), F.lit("surgery")), ["procedure", "laterality"])


@query(f"""with {N}, v as (select {K}, lower({_line(False, 'sbrt')}) as low from notes) select {K}, {_case('low', [(k, k.upper()) for k in vocab.RADIATION], False)} as modality,
 {_first('low', r'(\d+(?:\.\d+)?)\s*gy\b')} || ' Gy' as dose, try_cast({_first('low', r'(\d+)\s*(?:#|fr(?:actions?)?)\b')} as int) as fractions from v""")
def par_radiotherapy(spark, sf_dir):
    return _parse_query(spark, sf_dir, parsers.radiotherapy(_line(True, "sbrt")), ["modality", "dose", "fractions"])


STATE = f"""scored as (select {K}, note, ({W})::int as words, (least(length(note) // 400, 4) + least(len({distinct_in_order(dates_sql('note'))}), 3) + {_hits_sql('note', vocab.HINTS)})::int as signal,
 {W} < 12 or {_hits_sql('note', vocab.LOW_VALUE)} >= 2 as low_value from notes)"""


@query(f"""with {N}, {STATE}, need as (select *, not low_value and signal >= 14 and words >= 40 as needs_model from scored),
 r as (select *, row_number() over (partition by doc, needs_model order by signal desc, words desc, line, part, subject) as n from need)
 select {K}, signal, case when not needs_model then 'resolved' when n <= 3 then 'unresolved' else 'overflow' end as state from r""")
def tri_topk_overflow(spark, sf_dir):
    t = F.col("note")
    n = notes(spark, sf_dir).withColumn("words", word_count(t))
    n = n.withColumns({"signal": scores.signal(t, scores.dates_in(t)), "low": scores.low_value(t, counted=F.col("words"))})
    n = n.withColumn("needs_model", scores.needs_model(F.col("low"), F.col("signal"), F.lit(0), F.col("words"), least_signal=14))
    n = n.withColumn("note_ix", F.struct("line", "part", "subject"))
    return segment.triage(n, ["doc"], cap=3).select(*KEYS, "signal", "state")


@query(f"""with {N}, p as (select doc, string_agg(note, chr(10) order by line, part, subject) as text from notes group by doc),
 s as (select doc, list_filter(list_transform(string_split(regexp_replace(text, '(?i)({'|'.join(vocab.SECTION_STARTS)})', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ps from p),
 u as (select doc, unnest(list_transform(ps, lambda x, i: {{'i': i, 'v': x}})) as z from s)
 select doc, printf('p%04d_n%03d', 1, z.i) as note_id, md5(z.v) as digest from u where len(regexp_extract_all(z.v, '[\\p{{L}}\\p{{N}}_]+')) >= 12""")
def seg_header_split(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("line", "part", "subject", "note")))
    pages = notes(spark, sf_dir).groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["note"]), "\n").alias("text"))
    s = segment.split_sections(pages)
    return s.select("doc", segment.note_id(F.lit(1), F.col("note_ix")).alias("note_id"), F.md5(F.col("note").cast("binary")).alias("digest"))


B = f"boxes as ({BOXES_SQL})"
_ROLE = "case when top <= 0.12 * height then 'header' when bottom >= 0.92 * height then 'footer' when regexp_matches(lower(text), 'table|dose|vital') then 'table' when regexp_matches(lower(text), 'stamp|signature') then 'stamp' else 'body' end"


@query(f"""with {B}, l as (select *, {_ROLE} as role, coalesce(top - lag(bottom) over (partition by doc order by top, reading_order, block_id) > 42, false) as j from boxes),
 s as (select *, 1 + sum(j::int) over (partition by doc order by top, reading_order, block_id rows unbounded preceding) as island from l)
 select doc, island::bigint as island, count(*) as n_blocks, md5(string_agg(text, chr(10) order by top, reading_order, block_id)) as digest, array_to_string(list_sort(list_distinct(list(role))), ',') as roles from s group by doc, island""")
def seg_islands(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("role", scores.block_role(F.col("top"), F.col("bottom"), F.col("height"), F.col("text")))
    b = b.withColumn("reading_order", F.struct("reading_order", "block_id"))
    joined = segment.join_islands(segment.layout_islands(b, ["doc"]), ["doc"])
    return joined.select("doc", "island", "n_blocks", F.md5(F.col("text").cast("binary")).alias("digest"), F.array_join("roles", ",").alias("roles"))


@query(f"with {B} select doc, block_id, page, {_ROLE} as role from boxes")
def prd_block_role(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.select("doc", "block_id", "page", scores.block_role(F.col("top"), F.col("bottom"), F.col("height"), F.col("text")).alias("role"))


@query(f"""with {B}, g as (select doc, block_id, page, greatest(x0 - 18, 0) as x0, greatest(top - 14, 0) as y0, least(x1 + 18, width) as x1, least(bottom + 14, height) as y1, block_id % 4 as priority from boxes),
 a as (select *, row_number() over (partition by doc, round(x0 / 8)::bigint, round(y0 / 8)::bigint, round(x1 / 8)::bigint, round(y1 / 8)::bigint order by priority, block_id) as n from g where (x1 - x0) * (y1 - y0) >= 9000),
 r as (select *, row_number() over (partition by doc order by priority, block_id) as rank from a where n = 1)
 select doc, block_id, rank, x0, y0, x1, y1 from r where rank <= 8""")
def seg_candidate_crops(spark, sf_dir):
    b = boxes(spark, sf_dir).select("doc", F.col("block_id").alias("box_id"), "x0", F.col("top").alias("y0"), "x1", F.col("bottom").alias("y1"), "width", "height")
    crops = segment.candidate_crops(b.withColumn("priority", F.col("box_id") % 4), ["doc"])
    return crops.select("doc", F.col("box_id").alias("block_id"), F.col("rank").cast("long").alias("rank"), "x0", "y0", "x1", "y1")


@query("""select l_orderkey as doc, zone, round(x0 * 600.0, 2)::double as x0, round(y1 * 800.0, 2)::double as y1 from (select distinct l_orderkey from lineitem) d
 cross join (values ('top', 0.0, 0.0, 1.0, 0.2), ('middle', 0.0, 0.2, 1.0, 0.7), ('photo', 0.06, 0.24, 0.25, 0.43)) z(zone, x0, y0, x1, y1)""")
def seg_page_zones(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc")).distinct().select("doc", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    z = segment.page_zones(pages, [("top", 0.0, 0.0, 1.0, 0.2), ("middle", 0.0, 0.2, 1.0, 0.7), ("photo", 0.06, 0.24, 0.25, 0.43)])
    return z.select("doc", "zone", "x0", "y1")


@query(f"""with {B}, s as (select doc, block_id, (case when x0 <= 150 then 3.0 else 0 end + case when top >= 144 and top <= 400 then 3.0 else 0 end + case when bottom - top >= x1 - x0 then 2.0 else 0 end
 + least(100 * (x1 - x0) * (bottom - top) / 480000.0, 2.0))::double as score from boxes), r as (select *, row_number() over (partition by doc order by round(score, 6) desc, block_id) as n from s) select doc, block_id, floor(score * 100 + 0.000001)::bigint as score from r where n = 1""")
def prd_photo_choice(spark, sf_dir):
    c = F.col
    b = boxes(spark, sf_dir).select("doc", "block_id", scores.photo_score(c("x0"), c("top"), c("x1"), c("bottom"), c("width"), c("height")).alias("s"))
    best = b.groupBy("doc").agg(F.max_by(F.struct("block_id", "s"), F.struct(F.round("s", 6), -F.col("block_id"))).alias("b"))
    return best.select("doc", "b.block_id", F.floor(F.col("b.s") * 100 + 0.000001).cast("long").alias("score"))


def _misread_sql() -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in vocab.MISREADS)
    return f"""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents), c as (select distinct token, v as drug, case when v = token then 100 else 96 end as score from w, (values {rows}) m(k, v) where starts_with(token, k)),
 r as (select *, row_number() over (partition by token order by score desc, drug desc) as n from c) select token, drug, score from r where n <= 4"""


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("token")).distinct()


@query(_misread_sql())
def spl_misread_topk(spark, sf_dir):
    return spelling.misread_candidates(_tokens(spark, sf_dir))


TERMS = ["thation", "onerth", "andreea", "ertion", "stationed"]


@query(f"""with w as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from documents), c as (select token, term, round(100 * (1 - levenshtein(token, term) / greatest(length(token), length(term))), 2) as score from w, (values {', '.join(f"('{t}')" for t in TERMS)}) t(term) where length(token) >= 4)
 select token, term, score from c where score >= 82""")
def spl_levenshtein_join(spark, sf_dir):
    return spelling.fuzzy_matches(_tokens(spark, sf_dir), TERMS)


@query()
def spl_corpus_spelling(spark, sf_dir):
    """Corpus-frequency spelling; the oracle would need the full cross product of tokens."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("token"))
    return spelling.corpus_spelling(words, least_count=20)
