import random

from pyspark.sql import functions as F

from notewright.functions import vocab
from notewright.operators import crops, overview
from notewright.operators.pages import CHART_ZONES, ORDER_ZONES
from notewright.plans import QUERIES
from notewright.sources import store


def near(box):
    return tuple(round(v / 8) for v in box)


def plain_crops(width, height, artifacts):
    """The crops of one page, artifact by artifact."""
    found, seen, texts = [], set(), []
    signal = lambda t: any(w in t.lower() for w in vocab.ORDER_WORDS)

    def put(role, box, kind, source, text):
        if near(box) not in seen:
            seen.add(near(box))
            first = 0 if role == "orders" or signal(text) else 1 if role == "vitals" else 2 if kind in ("table", "page_region") else 3
            found.append((first, box[1], box[0], len(found), role, box, source, kind))

    for x0, y0, x1, y1, role, kind, text in artifacts:
        if None in (x0, y0, x1, y1) or x1 <= x0 or y1 <= y0:
            continue
        text = (text or "").strip()
        texts += [text] if text else []
        if (role or "").lower() in crops.NO_CROP or kind not in crops.CROP_TYPES or (len(text) > 140 and not signal(text)):
            continue
        x0, x1 = (min(width, max(0.0, v)) for v in (x0, x1))
        y0, y1 = (min(height, max(0.0, v)) for v in (y0, y1))
        box = (round(max(0.0, x0 - 18), 2), round(max(0.0, y0 - 14), 2), round(min(width, x1 + 18), 2), round(min(height, y1 + 14), 2))
        if (box[2] - box[0]) * (box[3] - box[1]) >= 9000:
            put(role.lower() if (role or "").lower() in crops.CROP_ROLES else "orders", box, kind, "native", text[:250])
    every = " ".join(texts).lower()
    chart = "staff nurse" in every and ("medicine" in every or "injection" in every)
    for zones, source, kind, text in ((CHART_ZONES if chart else [], "chart_page_signal", "page_region", crops.CHART_TEXT), (ORDER_ZONES, "fallback_zone", "region", "")):
        for role, a, b, c, d in zones:
            put(role, (round(a * width, 2), round(b * height, 2), round(c * width, 2), round(d * height, 2)), kind, source, text)
    return [(i + 1, r, *box, source, kind) for i, (_, _, _, _, r, box, source, kind) in enumerate(sorted(found, key=lambda x: x[:4])[:8])]


def test_crops_against_a_plain_loop(spark):
    r = random.Random(7)
    texts = ["", None, "the staff", "Nurse gave medicines", "staff nurse", "injection at 8", "x" * 200, "Inj " * 60, " short "]
    pages, rows, want = [], [], set()
    for p in range(60):
        w, h = r.choice([(600.0, 800.0), (595.28, 841.89)])
        own = []
        for _ in range(r.choice([0, 1, 5, 30])):
            x, y = r.choice([r.uniform(-20, w), 4.0 * r.randint(0, 9)]), r.choice([r.uniform(-20, h), 4.0 * r.randint(0, 9)])
            x1 = r.choice([x + r.uniform(-5, 400), x + 200, None])
            own.append((x, y, x1, y + r.choice([80.0, 150.5]), r.choice(["orders", "Vitals", "header", "body", "other", None]), r.choice(["table", "text_block", "photo", None]), r.choice(texts)))
        pages.append((p, w, h))
        rows += [(p, i, *a, "native") for i, a in enumerate(own)]
        want |= {(p, *c) for c in plain_crops(w, h, own)}
    pages = spark.createDataFrame(pages, "page int, width double, height double")
    schema = "page int, n int, x0 double, y0 double, x1 double, y1 double, role string, artifact_type string, text string, backend string"
    got = crops.order_crops(pages, spark.createDataFrame(rows, schema).repartition(5), ["page"], ["n"])
    assert {tuple(x) for x in got.collect()} == want
    assert crops.order_crops(pages.limit(0), spark.createDataFrame([], schema), ["page"], ["n"]).count() == 0


def test_made_pages_have_all_three_kinds(spark, small):
    kinds = {x[0] for x in QUERIES["seg_order_crops"](spark, small).select("source_backend").distinct().collect()}
    assert kinds == {"native", "chart_page_signal", "fallback_zone"}


def test_reading_that_is_kept(spark):
    rows = [(1, 1, "a", "long enough", 0.5), (1, 2, "b", "long enough", 0.5), (1, 3, "c", "short", 0.9), (1, 4, "d", "", 1.0),
            (2, 1, "a", "x" * 120, 0.2), (2, 2, "b", "y", 0.9), (3, 1, "a", None, 0.7), (4, 1, "a", "t", None)]
    df = spark.createDataFrame(rows, "crop int, n int, backend string, text string, confidence double")
    at = lambda sweep: {x["crop"]: tuple(x)[1:] for x in crops.choose_reading(df, ["crop"], "n", sweep).collect()}
    assert at(False) == {1: ("c", "short", 0.9, 3), 2: ("b", "y", 0.9, 2), 3: (None, "", 0.0, 0), 4: ("a", "t", 0.0, 1)}
    assert at(True)[2] == ("a", "x" * 120, 0.9, 2) and at(True)[1][0] == "c"
    assert crops.choose_reading(df.where("n < 3"), ["crop"], "n").where("crop = 1").first()["backend"] == "a"


def test_boxes_of_points(spark):
    rows = [([[3.0, 4.0], [1.0, 9.0], [7.0]],), ([],), ([[1.0]],), (None,), ([[2.0, None], [5.0, 6.0]],)]
    df = spark.createDataFrame(rows, "p array<array<double>>").select(crops.scale_box(crops.box_of_points(F.col("p")), F.lit(2.0), F.lit(0.5)).alias("b"))
    assert [x["b"] for x in df.collect()] == [[2.0, 2.0, 6.0, 4.5], None, None, None, [10.0, 3.0, 10.0, 3.0]]


def test_runs_and_totals(spark):
    runs = spark.createDataFrame([(1, "completed", 5), (2, "merging", 4), (3, "pending", 4), (4, "failed", 9), (5, None, 1)], "run int, status string, created int")
    assert tuple(overview.run_status(runs).first()) == (5, 1, 1, 2, 3)
    assert tuple(overview.run_status(runs.limit(0)).first()) == (0, 0, 0, 0, None)
    assert [x["run"] for x in overview.recent_runs(runs, 3).collect()] == [4, 1, 3]
    assert {tuple(x) for x in overview.totals({"a": runs, "b": runs.limit(0)}).collect()} == {("a", 5), ("b", 0)}
    m = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "category string")
    assert [tuple(x) for x in overview.category_distribution(m).collect()] == [("b", 2), (None, 1), ("a", 1)]


def test_entries_of_equal_key_multiply_no_row(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z")], "k int, own string")
    table = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (None, "never", 9), (3, "other", 1)], "k int, name string, at int")
    got = overview.look_up(rows, "k", table, ["name"], [F.col("at")])
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, "x", "new"), (1, "x", "new"), (2, "y", None), (None, "z", None)]
    assert overview.look_up(rows, "k", table, ["name"], [F.col("at")], required=True).count() == 2


def test_links_to_shown_evidence(spark):
    artifacts = spark.createDataFrame([("s", f"a{i}", 1, i, "text_block") for i in range(130)] + [("t", "a0", 1, 0, "table")], "subject string, artifact string, page int, reading_order int, artifact_type string")
    mentions = spark.createDataFrame([("s", 1, ["a5", "a119", "a120", "gone", "a1", "a2", "a3"]), ("t", 2, ["a0", "a0"]), ("t", 3, None)], "subject string, mention int, evidence_ids array<string>")
    got = sorted(tuple(x)[1:] for x in overview.evidence_links(mentions, artifacts).collect())
    assert got == [(1, "a1"), (1, "a119"), (1, "a2"), (1, "a5"), (2, "a0"), (2, "a0")]


def test_ratio_and_extremes(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", None, "x"), ("b", 3, None), (None, 2, "y")], "k string, n int, t string")
    assert {tuple(x) for x in overview.valid_ratio(df, ["n", "t"], ["k"]).collect()} == {("a", 2, 1, 0.5), ("b", 1, 0, 0.0), (None, 1, 1, 1.0)}
    got = [(x["side"], x["n"]) for x in overview.extremes(df, "n", "k", 2).collect()]
    assert got == [("most", 3), ("most", 2), ("least", 1), ("least", 2)]


def test_counters_and_dataset_pages(spark):
    current = spark.createDataFrame([(1, 5, None), (2, 0, 0)], "run int, done int, failed int")
    more = spark.createDataFrame([(1, 1, 1), (1, 2, None), (3, 9, 9)], "run int, done int, failed int").repartition(3)
    assert sorted(map(tuple, store.add_increments(current, more, "run", ["done", "failed"]).collect())) == [(1, 8, 1), (2, 0, 0)]
    pages = spark.createDataFrame([('{"rows": [{"row_idx": 2, "row": {"text": "  The Medication list "}}, {"row_idx": 1, "row": {"text": "doctor_name: X"}}, {"row_idx": 0, "row": {}}]}',), ("no json",), (None,), ("{}",)], "p string")
    assert [tuple(x) for x in store.dataset_rows(pages, "p", ["medication", "doctor_name"], 5, longest=8).collect()] == [(1, "doctor_n"), (2, "The Medi")]
    assert store.dataset_rows(pages, "p", ["medication", "doctor_name"], 1).count() == 1
