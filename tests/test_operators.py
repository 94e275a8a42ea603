"""Operators against plain loops, and their edges: spelling, candidates, ranks, batches, replies, payloads, sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from notewright.functions import scores, vocab
from notewright.operators import artifacts, batches, candidates, correct, hooks, merge, orders, payloads, records, replies, skew
from notewright.operators.extract import plan_block
from notewright.sources import pages, profiles


def osa(a, b):
    """Edits with exchanges of neighbours, any order of operations up to two is covered by the unrestricted distance."""
    last, d = {}, {(-1, -1): len(a) + len(b)}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = len(a) + len(b), i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = len(a) + len(b), j
    for i in range(1, len(a) + 1):
        at = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), at
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, at = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def mutated(rng, w, n):
    for _ in range(n):
        i = rng.randrange(len(w) + 1)
        kind = rng.randrange(4)
        if kind == 0:
            w = w[:i] + rng.choice("abcé") + w[i:]
        elif kind == 1:
            w = w[:i] + w[i + 1 :]
        elif kind == 2:
            w = w[:i] + rng.choice("abcé") + w[i + 1 :]
        else:
            w = w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]
    return w


def test_edits_and_index_lose_nothing(spark):
    rng = random.Random(7)
    terms = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 12, 40]))) for _ in range(150)]
    words = [mutated(rng, rng.choice(terms), rng.randrange(4)) for _ in range(400)]
    words = sorted({w for w in words if w})
    pairs = spark.createDataFrame([(a, b) for a in words[:60] for b in terms], "a string, b string")
    for r in pairs.select("a", "b", correct.edits(F.col("a"), F.col("b")).alias("e")).collect():
        true = osa(r["a"], r["b"])
        assert r["e"] == true if true <= 2 else r["e"] > 2, (r, true)
    dictionary = spark.createDataFrame([(t, 10 + i % 3) for i, t in enumerate(terms)], "term string, n int")
    counts = {r["term"]: r["n"] for r in dictionary.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    got = {r["word"]: (r["suggestion"], r["edits"]) for r in correct.suggestions(spark.createDataFrame([(w,) for w in words], "word string"), correct.deletion_index(dictionary)).collect()}
    for w in words:
        near = min(((osa(w, t), -n, t) for t, n in counts.items()), default=(9, 0, ""))
        assert got.get(w) == ((near[2], near[0]) if 0 < near[0] <= 2 else None), w


def test_correction_keeps_what_must_stay(spark):
    index = correct.deletion_index(spark.createDataFrame([("carcinoma", 9), ("nephrectomy", 5), ("kidney", 7), ("the", 99)], "term string, n int"))
    texts = {
        "carcinorma of kidny, teh": "carcinoma of kidney, teh",
        "Carcinma\n kidney!": "Carcinoma kidney!",
        "Kidny kidn3y kid": "Kidny kidn3y kid",
        "no errors  here": "no errors  here",
        "sunitinlb kidney.": "sunitinlb kidney.",
        "": "",
        None: None,
        "nephretcomy " * 3000: ("nephrectomy " * 3000).strip(),
    }
    df = spark.createDataFrame([(i % 2, t, "x") for i, t in enumerate(texts)] + [(0, "carcinorma of kidny, teh", "y")], "id int, text string, corrected2 string")
    white = spark.createDataFrame([("sunitinlb",)], "w string")
    rows = correct.correct_text(df, ["id"], "text", index, white).collect()
    assert len(rows) == len(texts) + 1 and all(r["corrected"] == texts[r["text"]] for r in rows)
    assert correct.correct_text(df.limit(0), ["id"], "text", index).count() == 0


def test_near_terms_against_all_pairs(spark):
    rng = random.Random(2)
    terms = sorted({*vocab.DRUG_TERMS, *["".join(rng.choice("abcde") for _ in range(rng.randrange(4, 15))) for _ in range(80)]})
    words = sorted({mutated(rng, rng.choice(terms), rng.randrange(4)) for _ in range(500)} - {""})
    index = candidates.pair_index(spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, place int"))
    got = {(r["token"], r["term"]) for r in candidates.near_terms(spark.createDataFrame([(w,) for w in words], "token string"), index).collect()}
    lev = spark.createDataFrame([(w, t) for w in words for t in terms], "w string, t string").select("w", "t", candidates.similarity(F.col("w"), F.col("t")).alias("s"))
    assert got == {(r["w"], r["t"]) for r in lev.where("s >= 82").collect()}


def test_candidates_of_hot_and_empty_texts(spark):
    index = candidates.pair_index(candidates.drug_dictionary(spark))
    df = spark.createDataFrame([(i, "Inj docetaxol 20 mg") for i in range(3000)] + [(-1, None), (-2, ""), (-3, "pan 40 and cisplatin, ondansetrom")], "id int, t string")
    got = {r["id"]: [(c["raw"], c["normalized"], c["score"], c["method"]) for c in r["candidates"]] for r in candidates.text_candidates(df, ["id"], "t", index).collect()}
    assert len(got) == 3003 and got[-1] == got[-2] == []
    assert got[5] == [("docet", "docetaxel", 96, "misread_map")]
    assert got[-3] == [("cisplatin", "cisplatin", 100, "exact"), ("pan", "pantoprazole", 96, "misread_map"), ("ondan", "ondansetron", 96, "misread_map")]


def test_drugs_of_a_text_lower_it_once(spark):
    df = spark.createDataFrame([("PAN 40, Ondan and CISPLATIN",), ("pandemic panto",), ("5 Pantopx",), (None,)], "t string").select(orders.drug_candidates(F.col("t")).alias("c"))
    assert df._jdf.queryExecution().analyzed().toString().count("lower(") == 1
    assert [[(c["drug"], c["score"]) for c in r["c"]] for r in df.collect()] == [[("cisplatin", 100), ("pantoprazole", 96), ("ondansetron", 96)], [], [("pantoprazole", 96)], []]


def test_ranks_hold_one_group_with_all_rows(spark):
    df = spark.createDataFrame([(0, i % 5, i) for i in range(4000)] + [(1, 3, 9_000)], "g int, w int, k int").repartition(7)
    ranked = skew.exact_ranks(df, "g", ["w", "k"], partitions=16)
    rows = ranked.collect()
    want = {(g, w, k): n for n, (g, w, k) in enumerate(sorted((0, i % 5, i) for i in range(4000)))} | {(1, 3, 9_000): 0}
    assert {(r["g"], r["w"], r["k"]): r["rank"] for r in rows} == want
    largest = skew.kept(df.repartitionByRange(16, "g", "w", "k")).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 1000


def test_lookup_join_with_a_hot_key(spark):
    many = spark.createDataFrame([("hot", i) for i in range(5000)] + [(f"k{i}", i) for i in range(500)], "k string, v int")
    few = spark.createDataFrame([("hot", 1), ("k3", 2), ("none", 3)], "k string, x int")
    counts = many.groupBy("k").agg(F.count("*").alias("n"))
    assert skew.lookup_join(many, few, "k", counts).groupBy("k").count().collect() and skew.lookup_join(many, few, "k", counts).count() == 5001
    assert skew.lookup_join(many.limit(0), few, "k", counts.limit(0)).count() == 0


def test_batches_are_one_call_each(spark):
    rows = [(i, (i * 37) % 500, f"p{i}") for i in range(900)]
    b = batches.global_batches(spark.createDataFrame(rows, "id int, words int, prompt string").repartition(5), "words", "id", 8).collect()
    order, limits = ["short", "medium", "long", "xlong"], vocab.BATCH_LIMIT
    number, want = -1, {}
    for bucket in order:
        inside = sorted((w, i) for i, w, _ in rows if (w > 120) + (w > 220) + (w > 380) == order.index(bucket))
        for n, (_, i) in enumerate(inside):
            number += n % limits[bucket] == 0
            want[i] = (bucket, number, n % limits[bucket])
    assert {r["id"]: (r["bucket"], r["batch_no"], r["batch_place"]) for r in b} == want


def test_failed_batches_are_asked_again_alone(spark):
    rows = [(0, 0, "BUSY a", 10), (0, 1, "b", 10), (1, 0, "c", 10), (1, 1, "x" * 50, 10), (2, 0, "y" * 5000, 10), (3, 0, "BUSY alone", 10)]
    df = spark.createDataFrame([(n, p, f"k{i}", t, b) for i, (n, p, t, b) in enumerate(rows)], "batch_no long, batch_place int, key string, prompt string, budget int").repartition(6)
    got = {r["key"]: r for r in batches.ask_batches(df, batches.StrainedGenerator, "key", "prompt", "budget", pause=batches.no_pause).collect()}
    assert {k: (r["size"], r["retried"], r["reply"] is not None and "mentions" in r["reply"], r["wait"]) for k, r in got.items()} == {
        "k0": (2, True, True, 2.25), "k1": (2, True, True, 2.25), "k2": (2, False, True, 0.0), "k3": (2, True, True, 0.0), "k4": (1, True, False, 0.0), "k5": (1, False, True, 0.0),
    }
    assert got["k4"]["retry_error"] == "no JSON in the reply" and got["k0"]["error"].startswith("RuntimeError: 429")


@pytest.mark.parametrize(
    "text, want",
    [
        ("{'a': \"it's\"}", {"a": "it's"}), ("{'a': True, 'b': None}", {"a": True, "b": None}), ('{"m": [{"v": "x"}, {"v": "cut', {"m": [{"v": "x"}, {"v": "cut"}]}), ("{a: 1, b: two words}", {"a": 1, "b": "two words"}),
        ("Sure: {'a': 'it's ok'} thanks", {"a": "it's ok"}), ('{"a": "he said "no" twice"}', {"a": 'he said "no" twice'}), ("none", None), ("", None), (None, None), ('{"a": "x" "b": [1] "c": 2}', {"a": "x", "b": [1], "c": 2}),
        ('{"a": [1, 2}', {"a": [1, 2]}), ("[1, 2] and {3}", [1, 2]), ('{"a": "\\u00e9\\n"', {"a": "é\n"}), ("{" * 5000, None),
    ],
)
def test_replies_that_are_almost_json(text, want):
    assert hooks.loose_json(text) == want


def test_sound_json_is_read_alike():
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(7 if depth < 4 else 5)
        return [None, True, rng.randrange(-99, 99), rng.random(), rng.choice(["", "a b", "x'y", "ü"])][kind] if kind < 5 else [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 5 else {f"k{i}": value(depth + 1) for i in range(rng.randrange(4))}

    for _ in range(300):
        v = {"top": value(0)}
        assert replies.tolerant_json(json.dumps(v)) == v


def test_payloads_without_blocks(spark):
    df = spark.createDataFrame([(1, None), (2, "no json"), (3, "[]"), (4, '{"texts": "x"}'), (5, '{"texts": [{"text": 5}, 7, null, {"text": "ok"}]}'), (6, '{"res": null}')], "k int, p string")
    rows = payloads.payload_blocks(df, ["k"], "p").collect()
    assert [(r["k"], r["reading_order"], r["text"], r["bbox"]) for r in rows] == [(5, 4, "ok", None)]


def test_page_files_of_several_adapters(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(5):
        (tmp_path / "in" / f"{i}.txt").write_bytes(b"one\n two \n\fthree" if i else b"")
    pages.register_pages(spark)
    blocks, status = pages.read_pages(spark, f"file://{tmp_path}/in", ["lines", "broken", "nobody"], group_bytes=20)
    assert sorted((r["page_num"], r["reading_order"], r["text"]) for r in blocks.where("path like '%1.txt'").collect()) == [(1, 1, "one"), (1, 2, "two"), (2, 3, "three")]
    assert {(r["backend"], r["status"], r["n"]) for r in status.groupBy("backend", "status").agg(F.count("*").alias("n")).collect()} == {("lines", "ok", 5), ("broken", "failed", 5), ("nobody", "unknown_parser", 5)}
    assert blocks.rdd.getNumPartitions() == 4


def test_fields_of_a_page_are_told_apart_in_its_row(spark):
    from notewright.operators.extract import field_mentions

    df = spark.createDataFrame([(1, "Name: Ab Cd\nNAME: AB CD\nname - Ef Gh\nAge 7"), (1, "Age 7"), (2, None), (3, "Temp .")], "id int, text string")
    m = field_mentions(df, ["id"])
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort " not in plan and "Window" not in plan
    assert sorted((r["id"], r["label"], r["value"]) for r in m.collect()) == [(1, "age", "7"), (1, "age", "7"), (1, "patient_name", "Ab Cd"), (1, "patient_name", "Ef Gh")]


def test_a_run_makes_each_mention_once(spark, small):
    from notewright.plans import QUERIES

    df = QUERIES["run_record"](spark, small)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 2  # artifacts with pages, and the three sources
    merged = spark.createDataFrame([(1, "a", 3), (1, "a", 1), (1, "b", 1), (2, "a", 1)], "subject int, k_category string, n_raw long")
    assert sorted(map(tuple, merge.merged_stats(merged).collect())) == [(1, 3, 5, 2), (2, 1, 1, 1)]


def test_page_files_are_listed_by_tasks(spark, tmp_path):
    rows = [(i, f"one {i}\ntwo") for i in range(300)] + [(7, "again"), (8, None), (None, "x")]
    folder = f"file:{tmp_path}/out"
    for _ in range(2):  # a task that runs again replaces its files
        assert pages.write_files(spark.createDataFrame(rows, "doc int, t string").repartition(3, "doc"), "doc", "t", folder) == 303
    reader = pages.pages_source(pages.ADAPTERS)({"path": folder}).reader(None)
    groups = reader.partitions()
    assert len(groups) <= 3 * pages.FOLDERS and not any(g.paths for g in groups)  # the driver names folders, no files
    pages.register_pages(spark)
    blocks, status = pages.read_pages(spark, folder, ["lines"])
    found = [(r["path"].split("doc=")[1].split("-")[0], r["reading_order"], r["text"]) for r in blocks.collect()]
    assert sorted(found) == sorted(("" if i is None else str(i), n, x) for i, t in rows for n, x in enumerate((t or "").split("\n"), 1) if x) and status.count() == 303


def test_tree_digest_does_not_hang_on_order(spark):
    df = spark.createDataFrame([(f"v{i}",) for i in range(500)] + [("v1",), (None,)], "v string")
    roots = {profiles.tree_digest(d, F.col("v")).first()["digest"] for d in (df, df.repartition(9), df.orderBy(F.desc("v")))}
    assert len(roots) == 1 and profiles.tree_digest(df, F.col("v")).first()["n"] == 500
    assert profiles.tree_digest(df.where("v <> 'v7'"), F.col("v")).first()["digest"] not in roots
    assert profiles.tree_digest(df.limit(0), F.col("v")).first()["n"] == 0


def test_merged_sketches_equal_one_pass(spark):
    df = spark.range(20_000).select((F.col("id") % 7).alias("p"), F.when(F.col("id") % 10 > 0, F.col("id") % 1000).cast("double").alias("x"), F.concat(F.lit("t"), F.col("id") % 3).alias("t"))
    parts, whole = (profiles.merge_sketches(profiles.column_sketches(d, ["x", "t"], "p")).collect() for d in (df, df.withColumn("p", F.lit(0))))
    by = {r["name"]: r for r in parts}
    for r in whole:
        assert all(r[c] == by[r["name"]][c] for c in ("n", "missing", "least", "most"))
        assert abs(r["kinds"] - by[r["name"]]["kinds"]) <= 0.05 * r["kinds"]
    assert by["x"]["missing"] == 2000 and abs(by["x"]["half"] - 500) <= 25 and abs(by["x"]["three_quarters"] - 750) <= 25
    assert by["t"]["quarter"] is None and by["t"]["freq"] == 6667 and by["t"]["top"] == "t0"


def test_artifacts_first_then_pages(spark):
    a = spark.createDataFrame([(1, 7, 1, "hw", "orders", artifacts.ORDER_READER, "Temp 98 F\nInj pan 40 mg", [{"raw_text": "pan 40 mg", "dose": "40 mg"}], [{"label": "Heart Rate", "value": "70"}, {"label": "", "value": "1"}]), (1, 8, 1, "text", "body", "x", None, None, None)],
                              f"doc int, artifact_id long, page int, artifact_type string, role string, backend string, text string, order_items array<{artifacts.ORDER_ITEM}>, vitals array<{artifacts.VITAL}>")
    p = spark.createDataFrame([(1, 1, None, "temp 98 f\nInj pan 40 mg stat"), (1, 2, "ocr", "Temp 98 F")], "doc int, page int, backend string, text string")
    got = {(r["label"], r["value"], r["page"]): r for r in artifacts.artifact_mentions(a, p, ["doc"]).collect()}
    assert set(got) == {("temperature", "98 F", 1), ("temperature", "98 F", 2), ("handwritten_medication_order", "pan 40 mg", 1), ("heart_rate", "70", 1), ("medication_order", "Inj pan 40 mg stat", 1)}
    assert got["handwritten_medication_order", "pan 40 mg", 1]["normalized_value"] == "pantoprazole" and got["temperature", "98 F", 1]["evidence_artifact_id"] == "7"
    assert got["medication_order", "Inj pan 40 mg stat", 1]["attributes"]["drug_name"] == "pantoprazole" and got["medication_order", "Inj pan 40 mg stat", 1]["evidence_artifact_id"] is None


@pytest.mark.parametrize("copied", [100_000, 0])
def test_candidates_move_no_text_and_keep_no_row(spark, monkeypatch, copied):
    monkeypatch.setattr(candidates, "COPIED", copied)
    sizes = []
    monkeypatch.setattr(candidates, "kept", lambda df: sizes.append(df.columns) or skew.kept(df))
    texts = [(1, "Inj docetaxol and docetaxel"), (1, "Inj docetaxol and docetaxel"), (1, "cisplatim cisplatim"), (None, "pan 40 ondansetrom ondansetrn"), (2, None), (3, "rest")]
    df = spark.createDataFrame(texts, "id int, t string").repartition(3, "id")
    index = candidates.pair_index(candidates.drug_dictionary(spark))
    out = candidates.text_candidates(df, ["id"], "t", index)
    assert not any({"id", "t"} & set(c) for c in sizes)  # what is written holds words alone
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert copied == 0 or plan.count("Exchange hashpartitioning") == plan.count("Exchange hashpartitioning(id") <= 1
    got = sorted((str(r["id"]), str(r["t"]), [(c["raw"], c["normalized"], c["score"], c["method"]) for c in r["candidates"]]) for r in out.collect())
    doc = [("docetaxel", "docetaxel", 100, "exact")]
    assert got == sorted([("1", texts[0][1], doc), ("1", texts[0][1], doc), ("1", texts[2][1], got[2][2]), ("None", texts[3][1], got[-1][2]), ("2", "None", []), ("3", "rest", [])])
    assert [c[1] for c in got[2][2]] == ["cisplatin"] and {c[1] for c in got[-1][2]} == {"pantoprazole", "ondansetron"}


def test_mentions_of_a_page_meet_without_being_shuffled(spark):
    p = spark.range(40).select("id", F.lit(1).alias("page"), F.lit("x").alias("backend"), F.lit("Temp 98 F\nTEMP 98 f\nInj PALONOS 5 mg\nAge 7").alias("text"))
    a = spark.createDataFrame([], f"id long, artifact_id long, page int, artifact_type string, role string, backend string, text string, order_items array<{artifacts.ORDER_ITEM}>, vitals array<{artifacts.VITAL}>")
    m = artifacts.artifact_mentions(a, p, ["id"])
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")
    assert {(r["label"], r["value"], r["normalized_value"], r["n"]) for r in m.groupBy("label", "value", "normalized_value").agg(F.count("*").alias("n")).collect()} == {("temperature", "98 F", "98 F", 40), ("age", "7", "7", 40), ("medication_order", "Inj PALONOS 5 mg", "palonosetron", 40)}


def test_records_of_subjects_without_mentions(spark):
    merged = spark.createDataFrame([], "subject int, k_category string, label string, value string, normalized_value string, date_text string, certainty string")
    identity = spark.createDataFrame([(1, "a.pdf", 2, 0)], "subject int, source_pdf string, page_count long, note_count long")
    stats = spark.createDataFrame([], "subject int, n_raw long, n_merged long, n_categories long, review_flag string")
    notes = spark.createDataFrame([(1, 30)], "subject int, signal int")
    flags = records.review_flags(notes, merged, identity)
    r = records.deep_records(identity, merged, stats, flags).first()["record"]
    assert r["document_summary"]["mention_count"] == 0 and r["clinical_summary"] is None and r["review_flags"] == ["no_mentions_after_merge", "clinical_signal_but_empty_output"]
    profile = records.fallback_profile(records.deep_records(identity, merged, stats, flags), spark.createDataFrame([(1, 1, " CRP high ")], "subject int, page int, text string")).first()
    assert profile["document_profile"]["clinical_domain"] == "laboratory" and profile["quality_checks"]["missing_or_uncertain_fields"] == ["current_treatment", "investigation_summary", "plan_or_follow_up"]


def test_hits_and_plans_against_patterns(spark):
    import re

    texts = ["Diagnosis: RCC stage", "follow up followup follow-up", "PET CT and ect", "tab. tablets", "", None, "rt_ rt", "x" * 50 + " plan", "lymphoma éstage stage"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", scores.hits(F.col("t"), vocab.HINTS).alias("h")).collect():
        if r["t"] is not None:
            assert r["h"] == sum(bool(re.search(p, r["t"], re.I)) for p in vocab.HINTS), r
    notes = ["PLAN:\nrest\n\nplan\nwalk\nDATE: 1\nmore", "plan\n" + "\n".join("abcdefgh"), "no plan here", "Adv -\n x ", None, "plan:"]
    got = [r["p"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(notes)], "i int, t string").select("i", plan_block(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == ["rest walk", "a b c d e f", "", "x", "", ""]
