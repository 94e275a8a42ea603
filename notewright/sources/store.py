"""Sources and sinks: routing, imports, idempotent upserts, cascades, exports. All are table to table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.functions.text import strip

RECORD = (
    "patient_code string, source_pdf string, page_count int, note_count int, review_flags array<string>, "
    "mentions array<struct<category:string,label:string,value:string,normalized_value:string,date_text:string,certainty:string,"
    "evidence_quote:string,origin:string,origins:array<string>,source_pages:array<int>,evidence_ids:array<string>>>"
)


def upload_route(path: Column) -> Column:
    """json imports, pdf, txt and text become documents, all else is an error row."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "json", "import").when(ext.isin("pdf", "txt", "text"), "document").otherwise("error")


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def decode_text(content: Column) -> Column:
    """UTF-8, or else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def list_folder(spark: SparkSession, path: str, imported: DataFrame | None = None) -> DataFrame:
    """(path, size_mb, imported) of the files of a folder, by metadata only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.round(F.col("length") / 1048576, 2).alias("size_mb"))
    files = files.where(upload_route(F.col("path")) != "error")
    if imported is None:
        return files.withColumn("imported", F.lit(False))
    seen = imported.select("path").distinct().withColumn("imported", F.lit(True))
    return files.join(seen, "path", "left").withColumn("imported", F.coalesce("imported", F.lit(False)))


def not_imported(files: DataFrame, imported: DataFrame, key: str) -> DataFrame:
    return files.join(imported.select(key).distinct(), key, "left_anti")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Final-record files as mentions: code from the field or the file name, the first origin, or else regex."""
    raw = spark.read.schema(RECORD).option("multiLine", "true").json(path).withColumn("file", F.input_file_name())
    return record_mentions(raw)


def record_mentions(raw: DataFrame) -> DataFrame:
    code = F.coalesce(F.nullif(F.col("patient_code"), F.lit("")), F.regexp_replace(file_stem(F.col("file")), "_final$", ""))
    m = raw.select(code.alias("subject"), F.posexplode("mentions").alias("seq", "m"))
    origin = F.coalesce(F.get("m.origins", F.lit(0)), F.col("m.origin"), F.lit("regex"))
    return m.select(
        "subject", "seq", F.coalesce(F.nullif(F.col("m.category"), F.lit("")), F.lit("unknown")).alias("category"), "m.label", "m.value",
        "m.normalized_value", "m.date_text", "m.certainty", "m.evidence_quote", origin.alias("origin"),
    )


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key over both tables; of equal versions the change's, of equal changes the one whose columns
    hash highest, so that the result does not hang on the order of rows."""
    both = current.withColumn("__from", F.lit(0)).unionByName(changes.withColumn("__from", F.lit(1)), allowMissingColumns=True)
    rest = [F.to_json(F.struct(c)) for c in sorted(both.columns) if c != "__from"]
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__from"), F.desc(F.xxhash64(*rest)))
    return both.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__from")


def refresh(current: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """Delete, then insert: rows of the parts that ``part`` holds are replaced by its rows."""
    return current.join(part.select(*keys).distinct(), keys, "left_anti").unionByName(part)


def cascade_delete(parents: DataFrame, children: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parents, children) without the keys in ``gone``."""
    ids = gone.select(key).distinct()
    return parents.join(ids, key, "left_anti"), children.join(ids, key, "left_anti")


def set_null(children: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """``children`` with the reference to a deleted parent made null."""
    ids = gone.select(F.col(key).alias("__k")).distinct()
    joined = children.join(ids, children[key] == ids["__k"], "left")
    return joined.withColumn(key, F.when(F.col("__k").isNull(), F.col(key))).drop("__k")


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(key).distinct(), key, "left_anti")


def export_json(mentions: DataFrame, subject: str, columns: list[str], order: list[str]) -> DataFrame:
    """(subject, json): one document of a subject's mentions, in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return mentions.groupBy(subject).agg(F.to_json(F.struct(F.col(subject), rows.alias("mentions"))).alias("json"))


def write_stage(df: DataFrame, path: str, partition: str | None = None, fmt: str = "parquet") -> None:
    """A stage table, atomically by the committer; dynamic overwrite touches only the partitions that it holds."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    (writer.partitionBy(partition) if partition else writer).save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_inventory(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def union_adapters(parts: dict[str, DataFrame | None]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """(blocks of all adapters, status of each): an adapter that isn't there is a status row, never a failure."""
    out, status = None, []
    for name, df in parts.items():
        if df is None:
            status.append((name, "unknown_parser"))
            continue
        tagged = df.withColumn("backend", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
        status.append((name, "ok"))
    return out, status


def dispatch_uploads(files: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(taken, refused): files with their route and their subject, the name without its ending; and the rows that are of
    no known kind, with the error. A null path is refused."""
    routed = files.withColumn("route", F.coalesce(upload_route(F.col(path)), F.lit("error")))
    ending = F.coalesce(F.nullif(F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.lit("")), F.lit("none"))
    taken = routed.where("route <> 'error'").withColumn("subject", file_stem(F.col(path)))
    return taken, routed.where("route = 'error'").drop("route").withColumn("error", F.concat(F.lit("unsupported file type: "), ending))


def read_log(spark: SparkSession, path: str, stage: str | None = None) -> DataFrame:
    """All rows appended to a log, or those of a stage."""
    rows = spark.read.parquet(path)
    return rows if stage is None else rows.where(F.col("stage") == stage)


def add_increments(current: DataFrame, increments: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """``current`` with each row's counters raised by all increments of its key. Increments of one key add up before the
    join, in any order; a null one adds nothing, one of a key without a row is lost, as an update of no row is."""
    added = increments.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"__{c}") for c in counters])
    raised = {c: F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0)) for c in counters}
    return current.join(added, key, "left").withColumns(raised).drop(*[f"__{c}" for c in counters])


def dataset_rows(payloads: DataFrame, payload: str, keywords: list[str], limit: int, longest: int = 700) -> DataFrame:
    """(row_idx, text) of dataset pages ``{"rows": [{"row_idx": ..., "row": {"text": ...}}]}``: texts that hold any keyword
    in any case, bare of white space at their ends, their first ``longest`` characters; the first ``limit`` by row_idx
    and text, which is the feature. What is no such JSON gives no row."""
    kind = "struct<rows:array<struct<row_idx:bigint,row:struct<text:string>>>>"
    rows = payloads.select(F.inline(F.from_json(payload, kind)["rows"])).select("row_idx", strip(F.coalesce("row.text", F.lit(""))).alias("text"))
    low = F.lower("text")
    hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k.lower())) for k in keywords], F.lit(False))
    return rows.where(hit).select("row_idx", F.left("text", F.lit(longest)).alias("text")).orderBy("row_idx", "text").limit(limit)
