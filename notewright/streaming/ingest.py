"""Incremental ingest: a file stream of pages through the same functions as the batch, upserted by micro-batch.

The target is a versioned snapshot: rows lie in buckets by a hash of their key, and a micro-batch writes anew only the
buckets that it touches, under its own number. A commit names those buckets; a bucket's rows are those of its latest
commit. A micro-batch reads the commits before its own, so that one that is sent again replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notewright.functions.text import alpha_ratio, text_hash, whitespace, word_count
from notewright.sources.store import upsert

#: Buckets of a target; a micro-batch rewrites at most all of them.
BUCKETS = 64


def page_ledger(pages: DataFrame, text: str = "text") -> DataFrame:
    """``pages`` with the normalised text and its measures; works on a stream and on a table."""
    t = pages.withColumn(text, whitespace(F.col(text)))
    return t.withColumns({"char_count": F.length(text), "word_count": word_count(F.col(text)), "alpha_ratio": alpha_ratio(F.col(text)), "text_hash": text_hash(F.col(text))})


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def latest_commits(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """(bucket, batch): the latest commit of each bucket, of those before a micro-batch if one is given; BUCKETS rows at most."""
    if not _exists(spark, f"{target}/commits"):
        return None
    commits = spark.read.schema("bucket int, batch long").parquet(f"{target}/commits")
    if before is not None:
        commits = commits.where(F.col("batch") < before)
    return commits.groupBy("bucket").agg(F.max("batch").alias("batch"))


def read_snapshot(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The rows of a target as they stand, or stood before a micro-batch; None before the first."""
    latest = latest_commits(spark, target, before)
    if latest is None or latest.isEmpty():
        return None
    return spark.read.parquet(f"{target}/data").join(F.broadcast(latest), ["bucket", "batch"], "left_semi")


def merge_batch(rows: DataFrame, batch_id: int, target: str, keys: list[str], version: str, buckets: int = BUCKETS) -> None:
    """Upserts ``rows`` into a target as micro-batch ``batch_id``: the newest version of each key stays. Data first, then
    the commit; what was written without a commit is written over when the micro-batch comes again."""
    spark = rows.sparkSession
    fresh = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = fresh.select("bucket").distinct().cache()  # ``buckets`` rows at most
    current = read_snapshot(spark, target, batch_id)
    base = fresh.limit(0) if current is None else current.drop("batch").join(F.broadcast(touched), "bucket", "left_semi")
    upsert(base, fresh, keys, version).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/data/batch={batch_id}")
    touched.coalesce(1).write.mode("overwrite").parquet(f"{target}/commits/batch={batch_id}")
    touched.unpersist()


def ingest_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], version: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Reads new parquet files and upserts their ledger rows by ``keys``, the greatest ``version`` winning."""
    stream = spark.readStream.schema(schema)
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)

    def save(batch: DataFrame, batch_id: int) -> None:
        merge_batch(page_ledger(batch), batch_id, target, keys, version)

    return stream.parquet(source).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events_per_window(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts of a log's rows by window and kind, late rows dropped after the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"))
