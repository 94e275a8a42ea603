from pyspark.sql import functions as F

from notewright.operators import hooks, inventories
from notewright.plans import QUERIES
from notewright.sources import store


def test_counts_of_either_side(spark):
    pages = spark.createDataFrame([(1, "ocr"), (1, "native"), (2, None), (None, "ocr")], "doc int, selected_source string")
    notes = spark.createDataFrame([(1, True, 30), (1, False, 24), (3, False, 25), (None, None, None)], "doc int, low_value boolean, signal int")
    got = {r["doc"]: tuple(r)[1:] for r in inventories.pass_inventory(pages, notes, ["doc"]).collect()}
    assert got == {1: (2, 1, 2, 1, 1, "ok"), 2: (1, 0, 0, 0, 0, "ok"), 3: (0, 0, 1, 0, 1, "ok"), None: (1, 1, 1, 0, 0, "ok")}
    assert inventories.pass_inventory(pages.limit(0), notes.limit(0), ["doc"]).count() == 0


def test_triage_with_its_own_limits(spark):
    """25 points, fewer than three mentions, forty words: each limit by itself keeps a note from the model."""
    rows = [(1, False, 25, 40), (2, False, 24, 40), (3, False, 25, 39), (4, True, 99, 99), (5, False, 25, 40), (6, False, 25, 40)]
    notes = spark.createDataFrame(rows, "id int, low_value boolean, signal int, words int").withColumn("doc", F.lit(1))
    found = spark.createDataFrame([(5,)] * 3 + [(6,)] * 2, "id int")
    n = inventories.counted_mentions(notes, found, ["id"])
    assert [tuple(r) for r in inventories.triage_inventory(n, ["doc"]).collect()] == [(1, 6, 4, 2, "ok")]


def test_first_performance_status_there_is(spark):
    rows = [(1, 1, "no status"), (1, 2, "KPS 80"), (1, 3, "PS 2, KPS 60"), (1, 4, "PS 1"), (2, 1, None), (2, 2, "")]
    df = spark.createDataFrame(rows, "subject int, seq int, value string").repartition(4)
    got = sorted(tuple(r) for r in inventories.performance_summary(df, "subject", F.col("value"), F.col("seq")).collect())
    assert got == [(1, 2, 80, 4), (2, None, None, 2)]


def test_recogniser_rows_and_errors(spark):
    df = spark.createDataFrame([(1, b"short"), (2, b"\xff"), (3, None), (4, b"  "), (5, b"x" * 300)], "id int, content binary")
    got = {r["key"]: (r["text"], r["confidence"], (r["error"] or "").split(":")[0]) for r in hooks.recognise(df, hooks.PlainRecogniser, "id", "content").collect()}
    assert got["1"] == ("short", 0.5, "") and got["5"] == ("x" * 300, 0.9, "")
    assert [got[k][2] for k in "234"] == ["UnicodeDecodeError", "ValueError", "ValueError"]


def test_inventory_file_is_read_back(spark, small, tmp_path):
    rows = QUERIES["inv_pass"](spark, small)
    store.write_inventory(rows, str(tmp_path / "pass"))
    back = spark.read.option("header", "true").schema(rows.schema).csv(str(tmp_path / "pass"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_log_is_appended_not_replaced(spark, tmp_path):
    path = str(tmp_path / "log")
    for stage in ("ocr", "merge", "ocr"):
        store.append_log(spark.createDataFrame([(stage, "info", None)], "stage string, level string, details string"), path)
    assert store.read_log(spark, path).count() == 3 and store.read_log(spark, path, "ocr").count() == 2


def test_refused_uploads(spark):
    df = spark.createDataFrame([("a/b_1.JSON",), ("x.tar.gz",), ("noending",), ("dir.pdf/name",), (None,), ("p.text",)], "path string")
    taken, refused = store.dispatch_uploads(df, "path")
    assert sorted(map(tuple, taken.select("path", "route", "subject").collect())) == [("a/b_1.JSON", "import", "b_1"), ("p.text", "document", "p")]
    assert {r["path"]: r["error"].split(": ")[1] for r in refused.where("path is not null").collect()} == {"x.tar.gz": "gz", "noending": "none", "dir.pdf/name": "none"}
    assert refused.count() == 4


def test_made_inventories_have_both_kinds(spark, small):
    t = QUERIES["inv_triage"](spark, small).agg(F.sum("resolved_notes"), F.sum("unresolved_notes")).first()
    m = QUERIES["inv_model"](spark, small).agg(F.sum("llm_mention_count"), F.sum("llm_failures")).first()
    assert min(t) > 0 and min(m) > 0
    assert QUERIES["src_decode_latin"](spark, small).where("latin").count() > 0
