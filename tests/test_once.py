"""Costly steps are computed once a row: what the plans hold, and plain-loop versions of the steps."""

import random

from pyspark.sql import functions as F

from notewright.functions import scores
from notewright.functions.text import first_sentence, whitespace, whitespace_of
from notewright.operators import correct, crops, extract, graph, orders, records, segment
from notewright.plans import QUERIES
from notewright.plans.fixtures import notes, spread_notes
from notewright.plans.note_queries import KEYS


def plan_lines(df, what):
    """The lines of the optimised plan that hold an expression."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if what in x]


def test_drug_candidates_once(spark, small):
    assert len(plan_lines(QUERIES["spl_drug_candidates"](spark, small), "Contains(lambda")) == 1


def test_drug_candidates_order(spark):
    t = "docet and PAN 40, nivolumab, cisplatin; trastuzumab rituximab"
    rows = spark.createDataFrame([(t,), (None,), ("",)], "t string").select(orders.drug_candidates(F.col("t"), 9).alias("c")).collect()
    assert [[tuple(x) for x in r["c"]] for r in rows] == [
        [("trastuzumab", 100), ("cisplatin", 100), ("rituximab", 100), ("nivolumab", 100), ("pantoprazole", 96), ("docetaxel", 96)], [], []
    ]


def test_short_forms_in_one_reading(spark):
    """The same as the steps one by one, and one pattern in the plan."""
    rows = ["Inj. x IV i/v od.tab bd; TAB.od sos,d5.dns ns im.i/v.", "tablet pc po. q4h/q12h Sc\nAC hs", "", None, "od", ".od.", "iv/i/v/iv od od", "cap.cap. stat."]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    steps = F.col("t")
    for p, r in extract.short_form_steps():
        steps = F.regexp_replace(steps, p, r)
    out = df.select(extract.expand_short_forms(F.col("t")).alias("a"), steps.alias("b"))
    assert all(r["a"] == r["b"] for r in out.collect())
    assert "regexp_replace" not in df.select(extract.expand_short_forms(F.col("t")).alias("a"))._jdf.queryExecution().optimizedPlan().toString()


def test_edges_carry_the_last_ids(spark):
    """Edges with ids are those that are resolved afterwards, keys that two categories share too; one merge is read."""
    m = [("s", "diagnosis", "diagnosis", "a", 1, [1]), ("s", "diagnosis", "diagnosis", "a", 4, [2]), ("s", "lab", "lab", "x::v", 2, [1]), ("s", "lab::x", "LAB::x", "v", 9, [7]),
         ("s", "imaging", "imaging", "x", 3, None), ("t", "lab", "lab", "x", 5, [1]), ("s", "diagnosis", "Diagnosis", "b", 6, [])]
    schema = "subject string, k_category string, category string, label string, seq int, source_pages array<int>"
    merged = spark.createDataFrame(m, schema).withColumns({"value": F.when(F.col("seq").isin(2, 9), "").otherwise("v"), "normalized_value": F.lit(""), "date_text": F.lit(None).cast("string")})
    carried = graph.relation_edges(merged, id_col="seq")
    resolved = graph.resolve_edges(graph.relation_edges(merged), merged, id_col="seq").select(*carried.columns)
    assert carried.count() == 4 and carried.where("target_id = 9").count() == 2
    assert sorted(map(str, carried.collect())) == sorted(map(str, resolved.collect()))


def test_links_of_a_mention_from_one_reading(spark, small):
    assert len(plan_lines(QUERIES["map_links"](spark, small), "Generate explode(concat(array(struct(target")) == 1
    assert not plan_lines(QUERIES["rel_resolve_keys"](spark, small), "LeftOuter")  # the ids come with the edges, no mention is joined again


def test_swept_text_is_cleaned_once(spark, small):
    plan = QUERIES["src_zone_sweep"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[ \\t]+") == 1


def test_places_without_a_header_are_passed_over(spark):
    """Only what may begin a header is looked at, and the sections are the same."""
    body = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(f"{body}\ndate: 1.2.2020 {body} Remarks Details {body} UPDATE: 1.2.2020 {body} joint-clinic details x",)]
    df = segment.split_sections(spark.createDataFrame(rows, "text string"))
    assert [r["note"].split()[0] for r in df.orderBy("note_ix").collect()] == ["one", "date:", "Remarks"]
    assert "(?=[CDJPRcdjpr])(?i)" in df._jdf.queryExecution().optimizedPlan().toString()


def test_mentions_are_counted_in_their_note(spark, small):
    """As many as the rows of mentions, without rows of mentions."""
    n = notes(spark, small)
    want = {tuple(r[:4]): r["count"] for r in extract.note_mentions(n, KEYS).groupBy(*KEYS).count().collect()}
    got = {tuple(r[:4]): r["n_mentions"] for r in extract.mention_counts(n, KEYS).collect()}
    assert {k: v for k, v in got.items() if v} == want and len(got) == n.count()
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "Imp: a\nimp: b")], "k int, note string")
    assert {r["k"]: r["n_mentions"] for r in extract.mention_counts(empty, ["k"]).collect()} == {1: 0, 2: 0, 3: 1}
    assert not plan_lines(QUERIES["inv_triage"](spark, small), "Generate explode")


def test_pages_and_notes_of_a_pass_are_read_once(spark, small):
    assert len(plan_lines(QUERIES["inv_pass"](spark, small), "Relation [")) == 2  # lineitem and part


def test_only_notes_without_mentions_are_looked_at(spark, small):
    rows = spark.createDataFrame([(1, 99), (2, 99), (3, 1), (None, 99)], "subject int, signal int")
    merged, subjects = spark.createDataFrame([(1,), (1,)], "subject int"), spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "subject int")
    got = {r["subject"]: r["review_flags"] for r in records.review_flags(rows, merged, subjects).collect()}
    none = ["no_mentions_after_merge"]
    assert got == {1: [], 2: [*none, "clinical_signal_but_empty_output"], 3: none, 4: none, None: none}
    lines = plan_lines(QUERIES["mrg_review_flags"](spark, small), "Join LeftSemi")
    assert len(lines) == 1


def test_mention_patterns_are_tried_at_their_heads_alone(spark, small):
    """The matches of a search of the whole text; no expression steps through a note for each pattern."""
    rng = random.Random(5)
    pieces = ["HPR", "hpr:", "histopath - ", "ihc", "pet ct", "CECT", "ect ", "nephrectomy", "mri", "ct study reveals", "tab", "stable", "t.", " Abc 5 mg", "c/o", "pain", "PS", "-2", "kps 80", "rt",
              "Serum Creat 1.2", "NGS:", "review after", "r/s", "Follow-up", "followup", "ſ", "İ", "é", "PLAN:", "adv", " \n", "\n", "\n", " ", " one", ": ", "x-", "7", "|"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        low = text.translate({c: c + 32 for c in range(65, 91)})
        for i, heads, lead, pattern in extract._STEPS:
            assert extract._matches(text, low, heads, lead, pattern) == [m.group(1) for m in pattern.finditer(text)], (extract.NOTE_PATTERNS[i], text)
    rows = ["x\n plan \n\n a\nADV:\nb\nSeen by c\nd", "plan: x\n a", "tentative plan-\n1\n2\n3\n4\n5\n6\n7", "plan", "advice\nadv\n\n", "", "İplan\nadv:\n é"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [extract._plan_of(r, r.lower() if r.isascii() else r) for r in rows] == [r["p"] for r in df.select(extract.plan_block(F.col("t")).alias("p")).collect()]
    for name in ("ext_mentions", "inv_triage"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "hpr[" not in plan


def test_profiles_move_no_text(spark, small):
    """The numbers, kind and first words of the joined page texts, from what each page gives by itself."""
    rng = random.Random(3)
    pieces = ["", " ", "  ", "\n", "\t", "word", "CRP", "reference", " range", "Prescription", "cycle", "gy", "é", "x" * 130, "y z " * 70]
    rows = [(s, p, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 4)))) for s in range(300) for p in range(rng.randint(1, 5))] + [(301, 1, None), (302, 2, None), (302, 3, " ")]
    pages = spark.createDataFrame(rows, "subject int, page int, text string")
    got = {r["subject"]: r for r in records._sources(pages, "subject", "text").collect()}
    source = {}
    for s, _, t in sorted(rows, key=lambda r: r[:2]):
        source.setdefault(s, []).append(t or "")
    source = {s: "\n".join(ts).strip(" ") for s, ts in source.items()}
    whole = spark.createDataFrame([(s, t) for s, t in source.items()], "subject int, t string")
    want = whole.select("subject", F.length("t").alias("chars"), F.size(F.filter(F.split("t", r"\s+"), lambda x: x != "")).alias("words"), scores.document_type(F.col("t")).alias("kind"), first_sentence(F.col("t")).alias("first_words"))
    for r in want.collect():
        g = got[r["subject"]]
        kind = g["kind"] or "unknown_medical_document" if g["chars"] else "empty_or_unreadable_document"
        assert (g["chars"], g["words"], kind, g["first_words"]) == (r["chars"], r["words"], r["kind"], r["first_words"]), source[r["subject"]]
    assert len(got) == len(source)
    for name in ("jsn_fallback_profile", "agg_record_health"):
        assert not plan_lines(QUERIES[name](spark, small), "AS source#")  # no whole texts are put together


def test_blank_texts_of_crops_are_told_without_patterns(spark, small):
    """A filter on texts cleans them once, one on blank ones not at all; no text is in the window."""
    df = QUERIES["seg_order_crops"](spark, small)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[ \\t]+") == 3, plan.count("[ \\t]+")  # for the words of charts, for the boxes and in their filter
    assert not plan_lines(df, "lag(lower(")
    rows = [(1, i, t) for i, t in enumerate(["the STAFF", "\x00 \t", None, "\r\n", "nurse gave medicines"])] + [(2, 0, "staff"), (2, 1, "x"), (2, 2, "nurse medicine")]
    a = spark.createDataFrame(rows, "p int, o int, text string").selectExpr("*", "0D x0", "0D y0", "300D x1", "300D y1", "'body' role", "'table' artifact_type", "'b' backend")
    pages = spark.createDataFrame([(1,), (2,)], "p int").selectExpr("p", "600D width", "800D height")
    got = crops.order_crops(pages, a, ["p"], ["o"], cap=99).where("source_backend = 'chart_page_signal'").select("p").distinct().collect()
    assert [r["p"] for r in got] == [1]


def test_pairs_of_words_are_verified_once(spark):
    """The edit distance stands above the grouping of pairs, and few words are dealt to all tasks."""
    terms = spark.createDataFrame([("widget", 3), ("ladle", 2)], "term string, n int")
    found = correct.suggestions(spark.createDataFrame([("wigdet",), ("widget",), ("ladlle",), ("zzz",)], "word string"), correct.deletion_index(terms))
    assert sorted(map(tuple, found.select("word", "suggestion", "edits").collect())) == [("ladlle", "ladle", 1), ("wigdet", "widget", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    pairs = plan.index("Aggregate [word", plan.index("Aggregate [word") + 1)  # that of the best term comes first
    assert "levenshtein" not in plan[pairs:]
    assert plan.count("RepartitionByExpression") == 2


def test_artifact_and_field_patterns_are_tried_at_their_heads_alone(spark):
    import re

    from notewright.operators import artifacts, fields

    rng = random.Random(5)
    pieces = [
        "Name", "name of consultant", "Name of ", "Consultant", "U.H.I.D.", "UHID", "IPD", "i.p.d.", "sex", "Age", "address", "Date of Admission", "Date of Discharge", "DISEASE / DIAGNOSIS", "diagnosis", "Category",
        "Temp", "T", "Pulse", "P", "Resp", "RR", "BP", "B.P.", "SpO2", "spo 2", " ", ": ", "-", "\n", "98.6", "12", "M", "Female", "120/80", "é", "K", "_", "x", "No.", "|", "/min", "İ", "F", "pan", "Pantop", "inj.", "Cisplatin", "5 ml", ".",
    ]
    plain = [re.compile(p, re.I | re.A) for _, _, p in fields.FIELD_PATTERNS]
    line = re.compile(artifacts.LINE, re.I | re.A)
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    for t in texts:
        low = fields.ascii_lower(t)
        assert [(i, m.span(), m.span(1)) for i, m in fields.field_matches(low)] == [(i, m.span(), m.span(1)) for i, p in enumerate(plain) for m in p.finditer(t)]
        bare = [x.strip() for x in re.split(r"[\n|]+", t)]
        assert [(x, m.span(1)) for x in fields.drug_lines(t, low) for m in fields.line_matches(x)] == [(x, m.span(1)) for x in bare for m in line.finditer(x)]
    df = spark.createDataFrame([(1, "Name: Ab\n|Inj pan 40 mg")], "id int, text string")
    a = spark.createDataFrame([], f"id long, artifact_id long, page int, artifact_type string, role string, backend string, text string, order_items array<{artifacts.ORDER_ITEM}>, vitals array<{artifacts.VITAL}>")
    p = df.select("id", F.lit(1).alias("page"), F.lit("x").alias("backend"), "text")
    for out in (extract.field_mentions(df, ["id"]), artifacts.artifact_mentions(a, p, ["id"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "regexp_extract_all(t" not in plan and "Aggregate" not in plan


def test_first_of_equal_mentions_of_a_page_in_any_batch(spark):
    from notewright.operators import artifacts

    listed = [{"label": "Temperature", "value": "98 f"}]
    schema = f"id int, artifact_id long, page int, artifact_type string, role string, backend string, text string, order_items array<{artifacts.ORDER_ITEM}>, vitals array<{artifacts.VITAL}>"
    a = spark.createDataFrame([(i, n, 1, "t", "r", "b", f"Temp 98 F\nTab Ondansetron {n % 2} ml|rest", None, listed if n == 4 else None) for i in (1, None) for n in (5, 3, 4)] + [(2, 1, 1, "t", "r", "b", " \t", None, listed)], schema)
    p = spark.createDataFrame([(1, 1, None, "TEMP 98 f"), (1, 2, None, "temp 98 f")], "id int, page int, backend string, text string")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(1, 1, "temperature", "98 F", "3"), (1, 1, "medication_order", "Tab Ondansetron 1 ml", "3"), (1, 1, "medication_order", "Tab Ondansetron 0 ml", "4"), (1, 2, "temperature", "98 f", None)}
    want |= {(None, *w[1:]) for w in want if w[1] == 1}
    try:
        for n in ("1", "2", size):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
            got = artifacts.artifact_mentions(a, p, ["id"]).select("id", "page", "label", "value", "evidence_artifact_id").collect()
            assert set(map(tuple, got)) == want and len(got) == len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_a_run_deals_notes_to_all_tasks(spark, small):
    df = QUERIES["run_record"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2  # of patterns and of replies: adaptive plans leave these as many as they are
    dealt = spread_notes(spark, small)
    assert dealt.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
    assert dealt.exceptAll(notes(spark, small)).count() == notes(spark, small).exceptAll(dealt).count() == 0
    odd = [None, "", "a", " a  b\t", "a\n\n\nb", "a\n\nb", "\x00x\r", "é  ü", "\x0b a\x0c"]
    texts = spark.createDataFrame([(x,) for x in odd], "t string")
    assert [r["a"] for r in texts.select(whitespace_of("t").alias("a")).collect()] == [r["a"] for r in texts.select(whitespace(F.col("t")).alias("a")).collect()]
