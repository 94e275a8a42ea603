"""Invariants of the merge, the store and the stream."""

import json
import os

from pyspark.sql import functions as F

from notewright.operators import graph, merge
from notewright.plans.fixtures import mentions
from notewright.sources import store
from notewright.streaming import ingest


def test_merge_is_idempotent_and_keeps_first(spark):
    rows = [
        (1, 2, "Lab", "Hb", "9", "", "", "possible", 3, "e2", "late", "llm"),
        (1, 1, "lab", "HB", "9", "", "", "confirmed", 1, "e1", "", "regex"),
        (1, 3, None, None, None, None, None, None, None, None, None, None),
    ]
    m = spark.createDataFrame(rows, "subject int, seq int, category string, label string, value string, normalized_value string, date_text string, certainty string, page int, evidence_id string, evidence_quote string, origin string")
    got = {r["k_category"]: r for r in merge.merge_mentions(m).collect()}
    lab = got["lab"]
    assert (lab["label"], lab["certainty"], lab["evidence_quote"], lab["source_pages"], lab["origins"]) == ("HB", "confirmed", "late", [1, 3], ["llm", "regex"])
    assert got["unknown"]["n_raw"] == 1


def test_merge_counts(spark, small):
    m = mentions(spark, small)
    merged = merge.merge_mentions(m)
    assert merged.agg(F.sum("n_raw")).first()[0] == m.count() >= merged.count()
    edges = graph.resolve_edges(graph.relation_edges(merged.withColumn("category", F.col("k_category"))), merged.withColumn("category", F.col("k_category")), id_col="seq")
    assert edges.where("source_id is null or target_id is null").count() == 0


def test_empty_tables(spark, small):
    none = mentions(spark, small).limit(0)
    merged = merge.merge_mentions(none)
    subjects = spark.createDataFrame([(1,)], "subject long")
    assert merged.count() == 0
    assert merge.record_stats(subjects, none, merged).first()["review_flag"] == "no_mentions_after_merge"
    v = merge.validate(subjects, merged).first()
    assert (v["flags"], v["confidence"]) == (["no_categories_detected", "no_mentions_after_merge"], 0.7)


def test_record_import(spark, tmp_path):
    record = {"patient_code": "", "mentions": [{"category": "lab", "label": "Hb", "value": "9", "origins": ["llm", "regex"]}, {"value": "x"}]}
    (tmp_path / "p7_final.json").write_text(json.dumps(record))
    rows = store.read_records(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["subject"], r["category"], r["origin"]) for r in rows] == [("p7", "lab", "llm"), ("p7", "unknown", "regex")]


def test_write_stage_replaces_only_its_partitions(spark, tmp_path):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "p string, v int")
    store.write_stage(a, str(tmp_path / "t"), "p")
    store.write_stage(a.where("p = 'x'").withColumn("v", F.lit(9)), str(tmp_path / "t"), "p")
    assert {(r["p"], r["v"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("x", 9), ("y", 2)}


def test_upsert_and_folder(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, n int"), spark.createDataFrame([(1, "c", 1), (2, "d", 4)], "k int, v string, n int")
    assert {(r["k"], r["v"]) for r in store.upsert(old, new, ["k"], "n").collect()} == {(1, "c"), (2, "b")}
    (tmp_path / "a.PDF").write_bytes(b"x" * 20000)
    (tmp_path / "b.exe").write_bytes(b"x")
    assert [r["size_mb"] for r in store.list_folder(spark, str(tmp_path)).collect()] == [0.02]
    out, status = store.union_adapters({"a": old, "b": None})
    assert out.count() == 2 and status == [("a", "ok"), ("b", "unknown_parser")]


def test_stream_equals_batch(spark, small, tmp_path):
    """Three overlapping files, a micro-batch each, and one sent again give what one upsert gives."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.lit(1).alias("version"))
    parts = [docs.where("doc_id < 120"), docs.where("doc_id between 60 and 160").withColumns({"version": F.lit(3), "text": F.concat("text", F.lit(" again"))}), docs.where("doc_id > 20").withColumn("version", F.lit(2))]
    for i, p in enumerate(parts):
        p.coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"w{i}").glob("part-*")).rename(tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1000 + i, 1000 + i))
    target = str(tmp_path / "out")
    ingest.ingest_stream(spark, str(tmp_path / "in"), "doc_id long, text string, version int", target, str(tmp_path / "check"), ["doc_id"], "version", 1).awaitTermination(120)
    want = ingest.page_ledger(parts[0].limit(0))
    for p in parts:
        want = store.upsert(want, ingest.page_ledger(p), ["doc_id"], "version")
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "version", "text_hash", "word_count").collect())
    assert rows(ingest.read_snapshot(spark, target)) == rows(want)
    ingest.merge_batch(ingest.page_ledger(spark.read.parquet(str(tmp_path / "in" / "2.parquet"))), 2, target, ["doc_id"], "version")
    assert rows(ingest.read_snapshot(spark, target)) == rows(want)
    assert rows(ingest.read_snapshot(spark, target, 1)) == rows(ingest.page_ledger(parts[0]))


def test_upsert_is_settled(spark):
    rows = [(1, "a", 1), (1, "b", 1), (1, "c", 1), (2, None, 1), (2, "x", 1)]
    got = {tuple(sorted(tuple(r) for r in store.upsert(spark.createDataFrame([], "k int, v string, n int"), spark.createDataFrame(rows[i:] + rows[:i], "k int, v string, n int"), ["k"], "n").collect())) for i in range(5)}
    assert len(got) == 1
