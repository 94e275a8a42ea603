import re
from itertools import permutations

from notewright.llm import filter_audit

FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """Each order applied document by document."""
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, x in labels if x == 1} - {None}
    judged = []
    for doc, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": doc is not None and any(d is not None and d < doc and (o or "") == t for d, o, _ in docs),
        }
        judged.append((lang or "", doc, {f for f in fails if fails[f]}))
    out = {}
    for part in {p for p, *_ in judged}:
        shapley = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in map("".join, permutations("ABCDE")):
            left, gone = [(d, f) for p, d, f in judged if p == part], []
            for i, x in enumerate(order):
                lost = [(d, f) for d, f in left if x in f]
                redundant = sum(x in f for _, f in gone)
                left, gone = [r for r in left if x not in r[1]], gone + lost
                unique = sum(f == {x} for p, _, f in judged if p == part)
                rows[order, i + 1] = [len(left), len(lost), redundant, unique, sum(d in good for d, _ in lost), sum(d in toxic for d, _ in lost)]
                shapley[x] += len(lost)
        out |= {(part, o, i): (*v, shapley[o[i - 1]]) for (o, i), v in rows.items()}
    return out


def check(spark, docs, labels):
    d = spark.createDataFrame([(*r, 1, "y") for r in docs], "doc_id long, text string, lang string, n int, mask string")
    m = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, text string")
    rows = filter_audit.audit_filters(d.repartition(3), m).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in FIGURES) for r in rows}
    assert len(rows) == len(got) and got == brute(docs, labels)


def test_orders_against_loops(spark):
    many = " ".join(f"w{i}" for i in range(250))
    base = [many, "a " * 300, many.upper(), many + " #", "short", "", None, " ", "A | b", "ÉÉ x"]
    docs = [(i, base[i * 7 % len(base)], ["en", "fr", None, ""][i % 4]) for i in range(60)]
    docs += [(5, "short", "en"), (5, "short", "en"), (None, "short", "en"), (None, "short", "fr"), (None, None, "en"), (-3, "only once", "de"), (70, "long " * 100_000, "de")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(40)] + [(3, None, None), (4, 1, 1), (4, 0, 0), (None, 1, 1), (999, 1, 1)]
    check(spark, docs, labels)
    check(spark, docs[:3], [])
    check(spark, [], labels)


def test_many_parts_and_one_hot_text(spark):
    docs = [(i, "same text" if i % 2 else f"text {i}", f"l{i % 90}") for i in range(400)]
    check(spark, docs, [(i, 1, 0) for i in range(0, 400, 3)])


def test_walk_visits_each_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        steps = list(filter_audit.swap_walk(n))
        for s in steps:
            order[s], order[s + 1] = order[s + 1], order[s]
            seen.add(tuple(order))
        assert len(seen) == len(steps) + 1 == len(list(permutations(range(n))))
