"""DuckDB SQL for the queries of this subpackage that SQL can say."""

from __future__ import annotations

from notewright.llm import centroids, suffix_dedup
from notewright.llm.license_texts import GRAM, LEAST_SHARE, templates
from notewright.llm.weak_supervision import ITERATIONS, PRIOR_VOTES, START_GOOD, START_IF_BAD, START_IF_GOOD, SYMBOLS

_WORD = r"[^\x20\x09-\x0D]"
# The rules of the operator, as (bad, good) conditions; nothing for good means that it never votes so.
_RULES = {
    "symbols": ("n_symbols > 0.08 * ch", ""),
    "symbol_words": ("n_runs > 0.25 * wd", ""),
    "letters": ("n_letters < 0.85 * ch", "n_words >= 20 and n_letters > 0.93 * ch"),
    "repeats": ("n_repeat_words > 0.4 * wd", "n_words >= 20 and n_repeat_words < 0.15 * wd"),
    "variety": ("n_words >= 50 and n_distinct < 0.2 * wd and n_distinct < 400", ""),
    "lines": ("n_lines >= 3 and n_dup_lines > 0.3 * n_lines", ""),
    "capitals": ("n_upper > 0.3 * ch", ""),
    "bangs": ("n_bangs > 0.2 * wd", ""),
    "lengths": ("word_chars / wd < 2.5 or word_chars / wd > 12", ""),
    "stops": ("n_words >= 50 and n_stops < 0.01 * wd", "n_words >= 20 and n_stops > 0.03 * wd and n_stops < 0.5 * wd"),
}


def quality_rules_sql() -> str:
    names = list(_RULES)
    n = len(names)

    def count(pattern: str) -> str:
        return f"length(regexp_replace(t, '{pattern}', '', 'g'))"

    def rates(values: tuple[float, ...]) -> str:
        return "[" + ", ".join(f"{x}::double" for x in values * n) + "]"

    votes = ", ".join(f"case when {bad} then -1 {'when ' + good + ' then 1' if good else ''} else 0 end as {r}" for r, (bad, good) in ((r, _RULES[r]) for r in names))
    code = "[" + ", ".join(f"{r} + {3 * j + 1}" for j, r in enumerate(names)) + "]"

    def renewed(weight: str, start: str) -> str:
        return f"""list_transform(range(0, {3 * n}), lambda k: (list_sum(list_transform(sc, lambda x: case when x.v[k // 3 + 1] = k then x.n * {weight} else 0.0 end)) + {PRIOR_VOTES} * {start}[k + 1])
 / (list_sum(list_transform(sc, lambda x: x.n * {weight})) + {PRIOR_VOTES}))"""

    return f"""with recursive w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') as w from documents),
 tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3) x),
 again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from tri) x where c > 1),
 cov as (select doc_id, count(distinct j) as n_repeat from (select doc_id, unnest([i, i + 1, i + 2]) as j from again) x group by doc_id),
 st as materialized (select w.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, {count(f'[^{SYMBOLS}]+')} as n_symbols, len(regexp_extract_all(t, '[{SYMBOLS}]+')) as n_runs,
  {count(r'\P{Lu}+')} as n_upper, {count(r'\P{L}+')} as n_letters, {count('[^.?!;:,]+')} as n_stops, {count('[^!]+')} as n_bangs, len(list_distinct(w)) as n_distinct,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) as n_lines,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))) as n_dup_lines,
  coalesce(n_repeat, 0) as n_repeat_words, greatest(len(w), 1) as wd, greatest(length(array_to_string(w, '')), 1) as ch from w left join cov using (doc_id)),
 vt as materialized (select *, {votes} from st),
 pt as materialized (select list({{'v': v, 'n': n}}) as p from (select {code} as v, count(*)::double as n from vt group by 1) x),
 em(it, good, g, b) as (select 0, {START_GOOD}::double, {rates(START_IF_GOOD)}, {rates(START_IF_BAD)} union all
  select it + 1, least(greatest((list_sum(list_transform(sc, lambda x: x.n * x.q)) + 1) / (list_sum(list_transform(sc, lambda x: x.n)) + 2), 0.02), 0.98),
   {renewed('x.q', rates(START_IF_GOOD))}, {renewed('(1 - x.q)', rates(START_IF_BAD))}
  from (select it, list_transform(p, lambda y: {{'v': y.v, 'n': y.n, 'q': 1 / (1 + exp(-(ln(good / (1 - good)) + list_sum(list_transform(y.v, lambda i: ln(g[i + 1] / b[i + 1]))))))}}) as sc from em, pt where it < {ITERATIONS}) s),
 fit as (select good, g, b from em where it = {ITERATIONS}),
 fin as (select vt.*, round(1 / (1 + exp(-(ln(good / (1 - good)) + list_sum(list_transform({code}, lambda i: ln(g[i + 1] / b[i + 1])))))), 6) as quality, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from vt, fit)
 select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
 not base_failed and quality >= 0.5 as kept, quality, {', '.join(names)} from fin"""


def suffix_dedup_sql() -> str:
    """Every 50-byte string with its smallest document, as hexadecimal text; ranges by gaps and islands."""
    k = suffix_dedup.LENGTH
    return f"""with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 p as materialized (select doc_id, i, md5(g) as m from (select doc_id, i, substr(h, 2 * i + 1, {2 * k}) as g from (select doc_id, h, unnest(range(0, length(h) // 2 - {k - 1})) as i from d where length(h) >= {2 * k}) x) y),
 f as (select m, min(doc_id) as first from p group by m having min(doc_id) < max(doc_id)),
 c as (select p.doc_id, i from p join f using (m) where p.doc_id > first),
 e as (select doc_id, i, case when i > coalesce(max(i) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), -1000) + {k} then 1 else 0 end as fresh from c),
 g as (select doc_id, i, sum(fresh) over (partition by doc_id order by i rows unbounded preceding) as span from e),
 r as (select doc_id, span, min(i) as low, max(i) + {k} as high from g group by doc_id, span),
 s as (select doc_id, sum(high - low) as n_removed, count(*) as n_spans, list({{'low': low, 'high': high}} order by low) as rs from r group by doc_id),
 q as (select d.doc_id, h, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, list_transform(range(0, coalesce(len(rs), 0) + 1), lambda j: substr(h, 1 + 2 * (case when j = 0 then 0 else rs[j].high end),
  2 * ((case when j = coalesce(len(rs), 0) then length(h) // 2 else rs[j + 1].low end) - (case when j = 0 then 0 else rs[j].high end)))) as parts from d left join s using (doc_id))
 select doc_id, (length(h) // 2)::bigint as n_bytes, n_removed::bigint as n_removed, n_spans::bigint as n_spans, sha256(unhex(array_to_string(parts, ''))) as kept_sha256 from q"""


def license_scan_sql() -> str:
    """Votes by diagonal, islands of diagonals, covered words; phrases and notices as one list of values."""
    rows = ", ".join(
        f"({t.number}, '{t.label}', {t.base}, '{' '.join(t.words)}', {list(t.must)}::bigint[], {t.band}, {t.least_votes}, {1.0 if t.whole else LEAST_SHARE})" for t in templates()
    )
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""with t as materialized (select n, label, base, string_split(words, ' ') as w, must, band, least, share from (values {rows}) v(n, label, base, words, must, band, least, share)),
 tg as materialized (select n, i - 1 as p, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select n, w, unnest(range(1, len(w) - {GRAM - 2})) as i from t) x),
 d as materialized (select doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
 h as (select doc_id, n, i - 1 as d, p from (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - {GRAM - 2})) as i from d where len(w) >= {GRAM}) x) y join tg using (g)),
 v as (select doc_id, n, d - p as a, min(d) as low, max(d) as high, list(p) as ps from h group by doc_id, n, d - p),
 k as (select v.*, t.* exclude (n), case when a - lag(a) over (partition by doc_id, n order by a) <= band then 0 else 1 end as fresh from v join t using (n) where len(ps) >= least),
 s as (select *, sum(fresh) over (partition by doc_id, n order by a rows unbounded preceding) as span from k),
 c as (select doc_id, n, span, min(low) as f, max(high) + {GRAM} as e, list_distinct(flatten(list(flatten([ps, list_transform(ps, lambda x: x + 1), list_transform(ps, lambda x: x + 2)])))) as cov,
  any_value(label) as label, any_value(base) as base, any_value(len(w)) as m, any_value(must) as must, any_value(share) as share from s group by doc_id, n, span),
 o as (select *, len(cov) / m as got, len(cov) / m >= share and len(list_filter(must, lambda x: not list_contains(cov, x))) = 0 and e - f <= 2 * m as ok from c),
 r as (select doc_id, count(*) filter (base and ok) as n_base, min(f) filter (base and ok) as first_word, max(f) filter (base and ok) as last_word,
  string_agg(distinct label, ',' order by label) filter (base and ok) as base_labels, string_agg(distinct label, ',' order by label) filter (ok) as labels, round(max(got), 6) as score from o group by doc_id)
 select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels,
 coalesce(labels, '') as labels, coalesce(score, 0.0)::double as score from d left join r using (doc_id)"""


def centroids_sql() -> str:
    """Rounds of assignment and exact floor means, one after another, on integers."""
    far = "list_sum(list_transform(list_zip(e, ce), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def assigned(name: str, cents: str) -> str:
        return f"{name} as materialized (select vec_id, e, c, dist from (select vec_id, e, c, {far} as dist, row_number() over (partition by vec_id order by {far}, c) as rk from v cross join {cents}) x where rk = 1)"

    steps = []
    for i in range(centroids.ROUNDS):
        steps.append(assigned(f"a{i}", f"c{i}"))
        steps.append(f"""m{i} as (select c, list((s - ((s % n) + n) % n) // n order by j) as me from (select c, j, sum(e[j])::bigint as s, count(*) as n from (select c, e, unnest(range(1, {centroids.DIMENSIONS + 1})) as j from a{i}) x group by c, j) y group by c)""")
        steps.append(f"c{i + 1} as materialized (select c, coalesce(me, ce) as ce from c{i} left join m{i} using (c))")
    last = f"c{centroids.ROUNDS}"
    return f"""with v as materialized (select vec_id, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::double)::bigint) as e from embeddings
  where len(embedding) = {centroids.DIMENSIONS} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {centroids.DIMENSIONS}),
 c0 as materialized (select row_number() over (order by k) - 1 as c, e as ce from (select sha256('1:' || vec_id) as k, e from v order by k limit {centroids.CLUSTERS}) x),
 {", ".join(steps)}, {assigned("fin", last)}
 select vec_id, fin.c::int as cluster, dist::bigint as distance, (sum(dist) over (partition by fin.c))::bigint as cluster_inertia, (sum(dist) over ())::bigint as inertia,
 sha256(array_to_string(ce, ',')) as centroid_sha256 from fin join {last} using (c)"""


def filter_audit_sql() -> str:
    """Every order spelled out, every step counted from the masks on its own."""
    letters = "(values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"
    return rf"""with l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as q, max(case when toxic = 1 then 1 else 0 end) as x from labels group by doc_id),
 w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}+') as w from documents),
 m as materialized (select part, case when len(w) < 200 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
  + case when 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
  + case when doc_id > min(doc_id) over (partition by t) then 16 else 0 end as mask, coalesce(q, 0) as q, coalesce(x, 0) as x from w left join l using (doc_id)),
 f(letter, bit) as {letters},
 o as (select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a join f b on b.bit <> a.bit join f c on c.bit not in (a.bit, b.bit)
  join f d on d.bit not in (a.bit, b.bit, c.bit) join f e on e.bit not in (a.bit, b.bit, c.bit, d.bit)),
 p as (select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::bigint as before from (select *, unnest([1, 2, 3, 4, 5]) as step from o) x),
 s as materialized (select part, filter_order, step, bit, count(*) filter (mask & (before | bit) = 0) as kept, count(*) filter (mask & bit <> 0 and mask & before = 0) as removed,
  count(*) filter (mask & bit <> 0 and mask & before <> 0) as redundant, count(*) filter (mask = bit) as unique_fails, count(*) filter (mask & bit <> 0 and mask & before = 0 and q = 1) as good_lost,
  count(*) filter (mask & bit <> 0 and mask & before = 0 and x = 1) as toxic_lost from m, p group by part, filter_order, step, bit)
 select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from s"""


ORACLES: dict[str, str] = {
    "op3_suffix_dedup": suffix_dedup_sql(),
    "op4_quality_rules": quality_rules_sql(),
    "op11_license_scan": license_scan_sql(),
    "op12_centroids": centroids_sql(),
    "op13_filter_audit": filter_audit_sql(),
}
