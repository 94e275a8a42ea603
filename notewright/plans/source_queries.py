"""Files read through adapters, incremental ingest, manifests and column profiles: each writes its files first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from notewright.operators.skew import kept, shared_folder
from notewright.plans.registry import query
from notewright.session import table
from notewright.sources import pages, profiles
from notewright.streaming import ingest


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(r"""with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as ls from documents)
 select doc_id, 'lines' as backend, 'ok' as status, len(ls) as blocks, md5(array_to_string(ls, chr(10))) as digest, null::varchar as error from l
 union all select doc_id, 'broken', 'failed', 0, md5(''), 'ValueError: not a document of this kind' from documents union all select doc_id, 'other', 'unknown_parser', 0, md5(''), null from documents""")
def src_file_pages(spark, sf_dir):
    """Documents written as text files, read back through three adapters: one reads, one fails, one is unknown."""
    folder = _folder(spark, "files")
    pages.write_files(table(spark, sf_dir, "documents"), "doc_id", "text", folder)
    pages.register_pages(spark)
    blocks, status = pages.read_pages(spark, folder, ["lines", "broken", "other"])
    doc = F.regexp_extract("path", "doc_id=([0-9]+)", 1).cast("long").alias("doc_id")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda x: x["text"]), "\n")
    by_file = blocks.groupBy("path", "backend").agg(F.count("*").alias("blocks"), lines.alias("lines"))
    joined = status.join(by_file, ["path", "backend"], "left")
    return joined.select(doc, "backend", "status", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.md5(F.coalesce("lines", F.lit("")).cast("binary")).alias("digest"), "error")


@query(r"""with t as (select conv_id, turn, text from conversations), c as (select conv_id, turn % 3 as batch, max(turn) as version from t group by all), w as (select conv_id, max(version) as version from c group by conv_id)
 select conv_id, turn as version, length(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13), chr(10)), chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) as char_count
 from t join w on t.conv_id = w.conv_id and t.turn = w.version""".replace("select conv_id, turn as version", "select t.conv_id, turn as version"))
def str_ingest_upsert(spark, sf_dir):
    """Turns of conversations that come as three overlapping micro-batches, the last one twice; the newest turn stays."""
    target = _folder(spark, "snapshot")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    for i in (0, 1, 2, 2):
        ingest.merge_batch(ingest.page_ledger(turns.where(F.col("turn") % 3 <= i)), i, target, ["conv_id"], "turn")
    return ingest.read_snapshot(spark, target).select("conv_id", F.col("turn").alias("version"), F.col("char_count").cast("long").alias("char_count"))


def _tree_sql(value: str, rows: str) -> str:
    return f"""(with d as (select distinct sha256({value}::varchar) as d from {rows} where {value} is not null), l4 as (select left(d, 4) as k, sha256(string_agg(d, '' order by d)) as d from d group by 1),
  l2 as (select left(k, 2) as k, sha256(string_agg(k || ':' || d, '' order by k)) as d from l4 group by 1) select sha256(coalesce(string_agg(k || ':' || d, '' order by k), '')) from l2)"""


@query(f"""with f as (select * from documents order by source, doc_id limit 300)
 select 'full' as mode, null::bigint as most, (select count(*) from documents) as n, {_tree_sql('doc_id', 'documents')} as codes, {_tree_sql('source', 'documents')} as files
 union all select 'pilot', 300, (select count(*) from f), {_tree_sql('doc_id', 'f')}, {_tree_sql('source', 'f')}""")
def st_manifest(spark, sf_dir):
    """Digests of a whole run, and of a pilot of its first documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return profiles.run_manifest(d, "full", "doc_id", "source").unionByName(profiles.run_manifest(d, "pilot", "doc_id", "source", 300).select("mode", "most", "n", "codes", "files"))


#: Columns profiled, and how far a quartile's rank may be off.
NUMBERS, WORDS, RANK_ERROR = ["l_quantity", "l_extendedprice", "l_partkey"], ["l_returnflag", "l_linestatus"], 0.02


@query(" union all ".join(
    [f"select '{c}' as name, count({c}) as n, count(*) - count({c}) as missing, round(avg({c}), 4) as mean, round(stddev({c}), 4) as deviation, min({c})::double as least, max({c})::double as most, true as ranks_fit, null::varchar as top, true as kinds_fit from lineitem" for c in NUMBERS]
    + [f"select '{c}', count({c}), count(*) - count({c}), null, null, null, null, null, (select {c} from lineitem group by {c} order by count(*) desc, {c} limit 1), true from lineitem" for c in WORDS]
))
def agg_profile(spark, sf_dir):
    """Profiles of columns merged from the sketches of their parts, written and read back; quartiles held against their ranks."""
    lines = table(spark, sf_dir, "lineitem").withColumn("part", F.col("l_orderkey") % 16)
    folder = _folder(spark, "sketches")
    profiles.column_sketches(lines, NUMBERS + WORDS, "part").write.parquet(folder)
    p = kept(profiles.merge_sketches(spark.read.parquet(folder)))
    by_name = {r["name"]: r for r in p.collect()}  # a row a column
    share = lambda c, q: F.abs(F.avg((F.col(c) <= by_name[c][q]).cast("int")) - {"quarter": 0.25, "half": 0.5, "three_quarters": 0.75}[q]) <= RANK_ERROR + F.avg((F.col(c) == by_name[c][q]).cast("int"))
    fits = lines.agg(*[(share(c, "quarter") & share(c, "half") & share(c, "three_quarters")).alias(c) for c in NUMBERS], *[(F.abs(F.countDistinct(c) - by_name[c]["kinds"]) <= 0.05 * F.countDistinct(c)).alias(f"k_{c}") for c in NUMBERS + WORDS])
    facts = fits.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (F.col(c) if c in NUMBERS else F.lit(None).cast("boolean")).alias("ranks_fit"), F.col(f"k_{c}").alias("kinds_fit")) for c in NUMBERS + WORDS])).alias("f")).select("f.*")
    number = F.col("quarter").isNotNull()
    return p.join(F.broadcast(facts), "name").select(
        "name", "n", "missing", F.round("mean", 4).alias("mean"), F.round("deviation", 4).alias("deviation"), F.when(number, F.col("least").cast("double")).alias("least"), F.when(number, F.col("most").cast("double")).alias("most"),
        "ranks_fit", F.when(~number, F.col("top")).alias("top"), "kinds_fit",
    )
