"""Golden rows for the text, parsing and extraction rules, with their surprises."""

import pytest
from pyspark.sql import functions as F

from notewright.functions import parsers, scores, text
from notewright.operators import extract, hooks, pages, segment


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "f,value,want",
    [
        (text.whitespace, None, ""),
        (text.whitespace, " a\t\t b\r\n\n\n\nc \n", "a b\n\nc"),
        (text.repair_spacing, "a , b ( c ) - d | e", "a, b (c)-d e"),
        (text.drop_repeated_words, "foo\nFOO foo bar bar2", "foo bar bar2"),
        (text.drop_repeated_words, "été Été là", "été là"),
        (text.drop_noise_lines, "keep\nPage 1 of 2\nsee http://x.y\nE-mail : a\ntelefax: no\nfax: 1", "keep\ntelefax: no"),
        (text.first_lines, "A  b\n\na b\nc\nC", "A  b\nc"),
        (text.clean_value, "  :x ,\n y-; ", "x , y"),
        (text.category_key, "Lab Result!", "lab_result"),
        (text.category_key, "--", "uncategorized"),
        (text.safe_stem, "a b/ç?.pdf", "a_b_ç_.pdf"),
        (text.join_broken_words, ": nephrect- omy  done", "nephrectomy done"),
        (text.display_form, "give 5 ml now", "Give 5 mL now"),
        (text.first_sentence, "   ", None),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


def test_counts(spark):
    assert one(spark, text.word_count, "l'été, c'est beau_x 5") == 6
    assert one(spark, text.alpha_ratio, "") == 0.0
    assert one(spark, text.alpha_ratio, "ab1 ") == 0.5
    assert one(spark, scores.document_type, "an oncology visit") == "radiation_record"  # "gy" inside the word
    assert one(spark, scores.document_type, "a visit") == "unknown_medical_document"
    assert one(spark, scores.document_type, None) == "empty_or_unreadable_document"
    assert one(spark, lambda c: text.head_tail(c, 20, "..."), "a" * 30 + "b" * 30) == "a" * 11 + "..." + "b" * 6


@pytest.mark.parametrize("s,want", [(0, "0s"), (60, "1m"), (61, "1m 1s"), (3600, "1h"), (90061, "1d 1h"), (86400, "1d")])
def test_duration(spark, s, want):
    assert spark.range(1).select(text.duration_text(F.lit(s)).alias("x")).first()["x"] == want


def test_parsers(spark):
    d = one(spark, parsers.diagnosis, "rt renal clear cell Ca Stage III grade 2")
    assert (d["stage"], d["histology"], d["grade"], d["laterality"]) == ("Stage III", "Clear Cell", "Grade 2", "Right")
    m = one(spark, parsers.medication, "Tablet Sunitinib 50mg OD for 4 weeks")
    assert (m["drug_name"], m["dose"], m["frequency"], m["route"], m["duration"]) == ("let", "50mg", "Once daily", "oral", "4 weeks")
    assert one(spark, parsers.medication, "given saline")["route"] == "intravenous"
    r = one(spark, parsers.radiotherapy, "SBRT spine 30Gy/5#")
    assert (r["modality"], r["dose"], r["fractions"]) == ("SBRT", "30 Gy", None)
    assert one(spark, parsers.performance_status, "PS 1 KPS 80").asDict() == {"ecog": 1, "kps": 80}
    assert one(spark, parsers.imaging, None).asDict() == {"modality": None, "finding": None}


def test_extraction(spark):
    note = "Diagnosis: RCC\nCECT abdomen shows\nmass\nPLAN:\nadv\nreview after 2 weeks\nSeen by X"
    rows = extract.note_mentions(spark.createDataFrame([(1, note), (2, None), (3, "")], "id int, note string"), ["id"]).collect()
    got = {(r["category"], r["label"], r["value"]) for r in rows if r["id"] == 1}
    assert ("imaging", "CECT", "CECT abdomen shows\nmass") in got
    assert ("plan", "plan", "review after 2 weeks") in got
    assert ("follow_up", "follow_up", "review after 2 weeks") in got
    assert {r["id"] for r in rows} == {1}
    assert one(spark, extract.expand_short_forms, "Inj X i/v BD") == "INJ (injection) X I/V (intravenous) BD (twice daily)"


def test_sections_and_islands(spark):
    words = " ".join(f"w{i}" for i in range(15))
    page = f"short\nDATE: 01/02/2023 {words}\nCLINICAL NOTE DETAILS {words}"
    notes = segment.split_sections(spark.createDataFrame([(1, page)], "doc int, text string")).collect()
    assert [r["note_ix"] for r in notes] == [2, 3]
    blocks = spark.createDataFrame([(1, 0.0, 10.0, 1), (1, 52.0, 60.0, 2), (1, 103.0, 110.0, 3)], "doc int, top double, bottom double, reading_order int")
    assert [r["island"] for r in segment.layout_islands(blocks, ["doc"]).orderBy("top").collect()] == [1, 1, 2]


def test_loose_json():
    assert hooks.loose_json('```json\n{"a": [1,],}\n```') == {"a": [1]}
    assert hooks.loose_json("assistant: here {'a': 1} done") == {"a": 1}
    assert hooks.loose_json('x {"a": "}"} y') == {"a": "}"}
    assert hooks.loose_json(None) is None and hooks.loose_json("none") is None


def test_hook_failures_are_rows(spark):
    class Broken:
        def generate(self, prompts, max_tokens):
            if "bad" in prompts[0]:
                raise ValueError("no")
            return ["{}" if max_tokens > 64 else "x"]

    rows = hooks.run_generator(spark.createDataFrame([("1", "ok", 64), ("2", "bad", 64)], "k string, p string, b int"), Broken, "k", "p", "b").collect()
    assert {r["key"]: (r["reply"], r["error"]) for r in rows} == {"1": ("{}", None), "2": (None, "ValueError: no")}


def test_votes(spark):
    df = spark.sql("select array(named_struct('drug','a','score',82,'dose',''), named_struct('drug','b','score',90,'dose','1mg'), named_struct('drug','a','score',88,'dose','5mg')) as c")
    assert [tuple(x) for x in df.select(hooks.merge_votes(F.col("c")).alias("x")).first()["x"]] == [("a", 92, "5mg"), ("b", 90, "1mg")]


def test_prompts_in_groups(spark):
    class Counts:
        def generate(self, prompts, max_tokens):
            if len(prompts) > 1 and "odd" in prompts:
                raise ValueError("one spoils the group")
            if prompts == ["odd"]:
                raise ValueError("no")
            return ['{"of": %d}' % len(prompts) for _ in prompts]

    rows = [("1", "a", 64), ("2", "b", 64), ("3", "odd", 32), ("4", "c", 32)]
    df = spark.createDataFrame(rows, "k string, p string, b int").coalesce(1)
    got = {r["key"]: (r["reply"], r["error"]) for r in hooks.run_generator(df, Counts, "k", "p", "b", size=2).collect()}
    assert got == {"1": ('{"of": 2}', None), "2": ('{"of": 2}', None), "3": (None, "ValueError: no"), "4": ('{"of": 1}', None)}


def test_parsers_and_validators_fail_by_row(spark):
    files = spark.createDataFrame([("1", b"a\n\nb"), ("2", b""), ("3", None)], "k string, c binary")
    rows = hooks.parse_documents(files, [hooks.BrokenParser, hooks.LineParser], "k", "c").collect()
    assert sorted((r["key"], r["reading_order"] or 0, r["text"]) for r in rows) == [("1", 1, "a"), ("1", 2, "b"), ("2", 0, None), ("3", 0, None)]
    assert {r["error"] for r in rows if r["key"] == "2"} == {"ValueError: not a document of this kind"}
    r = spark.createDataFrame([("1", "p", ["few"], 0.9, ["lab"])], "k string, p string, flags array<string>, confidence double, missing array<string>")
    v = hooks.validate_records(r, [("echo", hooks.EchoGenerator)], "k", "p").first()
    assert (v["status"], v["confidence"], v["flags"], v["missing"]) == ("failed", 0.9, ["few", "validation_model_failed"], ["lab"])


def test_artifacts_without_rows_or_values(spark):
    pages_ = spark.createDataFrame([(1, "own", "native"), (2, None, "native")], "doc int, text string, source string")
    images = spark.createDataFrame([(2, 1, 300, 200, " read "), (1, 1, 10, 10, "icon"), (1, 2, 300, 200, None)], "doc int, image_ix int, width int, height int, image_text string")
    got = {r["doc"]: (r["text"], r["source"]) for r in pages.append_image_text(pages_, images, ["doc"]).collect()}
    assert got == {1: ("own", "native"), 2: ("read", "native+img")}
    assert pages.append_image_text(pages_, images.limit(0), ["doc"]).count() == 2
    x = spark.range(1).select(pages.blank_crop(F.array().cast("array<int>")).alias("none"), pages.blank_crop(F.lit(None).cast("array<int>")).alias("null"), pages.blank_crop(F.array(F.lit(0), F.lit(14))).alias("tie")).first()
    assert tuple(x) == (True, True, False)
    empty = "array<struct<label:string,value:string>>"
    o = "array<struct<drug:string,expanded_text:string,raw_text:string,text:string,drug_candidates:array<struct<normalized:string>>>>"
    line = spark.range(1).select(pages.order_lines(F.lit(None).cast(o), F.lit(None).cast(empty), F.lit(None).cast(empty), F.lit(None).cast("string")).alias("t")).first()
    assert line["t"] is None


def test_layout_notes(spark):
    words = " ".join(f"w{i}" for i in range(12))
    rows = [
        (1, 1, 1, "text_block", "body", 10.0, 20.0, 1, words), (1, 1, 2, "text_block", "body", 30.0, 40.0, 2, None), (1, 1, 3, "text_block", None, 90.0, 99.0, 3, "few"),
        (1, 1, 4, "handwriting", "orders", 200.0, 210.0, 4, words), (1, 1, 5, "text_block", "footer", 260.0, 270.0, 5, words), (1, 1, 6, "image", "body", 300.0, 310.0, 6, words),
        (2, 1, 7, "text_block", "body", None, None, 1, words),
    ]
    a = spark.createDataFrame(rows, "doc int, page int, block_id int, artifact_type string, role string, top double, bottom double, reading_order int, text string")
    got = sorted((r["doc"], r["note_id"], r["n_blocks"], r["note"]) for r in segment.layout_notes(a, "doc", "page").collect())
    assert got == [(1, "p0001_n001", 2, words), (2, "p0001_n001", 1, words)]
