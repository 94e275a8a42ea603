import hashlib
import random
import re

from notewright.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TEXTS = [
    None, "", "no numbers", "a@b.c_d@e.f", "a@b@c.d", "x@y..z a.b@c-d.ef.", "1.2.3.4.5.6.7.8", "0256.1.1.1 0255.1.1.1 255.255.255.256", "é🙂 +1 (040) 555-0631.",
    "4539 1488 0343 6467 4539-1488-0343-6467", "45391488034364670", "+12345678 9 +1234567", "+1 23 45 67 89 01 23 45 67", "00000000000000000", "a1@b.c2", "%%@x.y", "1.2.3.4@x.y +1.2.3.4.5.6.7.8",
    "9" * 3000 + ".1.2.3", "q" * 20000 + "@x.y", ("a.b" * 3000) + " 5",
    " ".join(f"n{i} a{i}@b.c" for i in range(700)),
]


def test_base_spans(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, k int, value string")
    got = {r["doc_id"]: r for r in pii.span_digest(pii.find_personal_data(df)).collect()}
    for d, t in rows:
        want, r = brute(t), got[d]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t or "")[:80]
        assert [r[f"n_{k}"] for k in BASE] == [sum(x.startswith(k) for x in want) for k in BASE]
        assert set(want) <= set(filter(None, r["spans"].split(",")))


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"you can write to me at user{i}@mail.com any time") for i in range(8)]
    rows += [(20, "you can write to me at jd77#corp any time"), (21, "elsewhere jd77#corp is named"), (22, "version 4.0 of it"), (23, "they pay me 500 any time")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.span_digest(pii.find_personal_data(df)).collect()}
    assert got[20] == "email:23:32" and got[21] == "email:10:19" and got[22] == "" and got[23] == ""


def test_graph_scores_against_loops(spark):
    edges = [("p", f"v{i}") for i in range(6)] + [("p", "new"), ("q", "new"), ("q", "v1"), ("r", "far"), ("r", "new")]
    known = [(f"v{i}", 0) for i in range(5)]
    got = pii.score_graph(spark.createDataFrame(edges, "pattern string, value string"), spark.createDataFrame(known, "value string, k int"), rounds=1).collect()
    share = 5 / 7
    assert {r["value"]: round(r["belief"], 6) for r in got} == {"v5": round(share, 6), "new": round(share, 6)}


def plain_rounds(edges, known):
    """The graph's rounds as loops over dictionaries, until nothing changes."""
    of = {}
    for p, v in edges:
        of.setdefault(p, set()).add(v)
    new = {}
    while True:
        trust = {}
        for p, values in of.items():
            for k in range(4):
                w = [1.0 if known.get(v) == k else new[v][1] for v in values if known.get(v) == k or (v in new and new[v][0] == k)]
                if len(w) >= pii.LEAST_KNOWN and sum(w) / len(values) >= pii.LEAST_SHARE:
                    trust[p, k] = sum(w) / len(values)
        belief = {}
        for (p, k), share in trust.items():
            for v in of[p] - set(known):
                belief[v, k] = 1 - (1 - belief.get((v, k), 0.0)) * (1 - min(share, 0.999))
        now = {}
        for v in {v for v, _ in belief}:
            k = max(range(4), key=lambda k: (belief.get((v, k), 0.0), -k))
            if belief[v, k] >= pii.LEAST_BELIEF:
                now[v] = (k, belief[v, k])
        if {v: k for v, (k, _) in now.items()} == {v: k for v, (k, _) in new.items()} and abs(sum(b for _, b in now.values()) - sum(b for _, b in new.values())) < 1e-3:
            return now
        new = now


def test_graph_goes_on_to_its_fixed_point(spark):
    """A chain of patterns, each trusted only once the one before has brought in its values, and random graphs."""
    chain = [(f"p{i}", f"v{j}") for i in range(7) for j in range(i, i + 5)]
    graphs = [(chain, {f"v{j}": 1 for j in range(4)})]
    for seed in range(2):
        r = random.Random(seed)
        edges = sorted({(f"p{r.randrange(12)}", f"v{r.randrange(40)}") for _ in range(150)})
        graphs.append((edges, {f"v{i}": r.randrange(2) for i in range(26)}))
    for edges, known in graphs:
        want = plain_rounds(edges, known)
        found = pii.score_graph(spark.createDataFrame(edges, "pattern string, value string"), spark.createDataFrame(sorted(known.items()), "value string, k int")).collect()
        got = {r["value"]: (r["k"], r["belief"]) for r in found}
        assert {v: k for v, (k, _) in got.items()} == {v: k for v, (k, _) in want.items()}
        assert all(abs(got[v][1] - want[v][1]) < 1e-6 for v in want)
    assert len(plain_rounds(*graphs[0])) > 3


def test_long_texts_with_very_many_spans(spark):
    r = random.Random(2)
    words = [f"a{i}@b.c" if r.random() < 0.3 else r.choice(["é🙂", "word", "n5", "1.2.3.4", "+1 (040) 555-0631", "x" * 700]) for i in range(6000)]
    text = " ".join(words)
    df = spark.createDataFrame([(1, text), (2, "x" * 3000 + " a@b.c")], "doc_id long, text string")
    row = {x["doc_id"]: x for x in pii.span_digest(pii.find_personal_data(df)).collect()}
    want = brute(text)
    assert row[1]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in row[1]["spans"].split(",")))
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    shown = {x["doc_id"]: x["text"] for x in pii.redact(df).collect()}
    assert shown[1] == "".join(out) + text[at:] and shown[2] == "x" * 3000 + " [email]"


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a@b.c", "p", "q"), (1, "", "r", None)], "doc_id long, text string, __k0 string, value string")
    assert sorted(map(tuple, pii.redact(df).collect())) == [(1, "", "r", None), (1, "[email]", "p", "q")]


def test_redaction_and_edges(spark):
    rows = [(1, "a@b.c and é +1 (040) 555-0631.", 30), (1, "a@b.c and é +1 (040) 555-0631.", 30), (2, None, 0), (None, "x a@b.c", 7), (3, "plain", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = pii.redact(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, "[email] and é [phone].", 22)] * 2 + [(2, None, 0), (None, "x [email]", 9), (3, "plain", 5)], key=repr)
    assert pii.find_personal_data(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_redaction_unites_overlapping_spans(spark):
    df = spark.createDataFrame([(1, "call +1 555 123 4567john@x.com now")], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(df).collect()] == ["call [phone] now"]


def test_contexts_without_words_teach_nothing(spark):
    """Bare addresses, and addresses between bars or numbers, make no lone number an address."""
    rows = [(i, f"user{i}@mail.com") for i in range(6)] + [(10 + i, f"| u{i}@mail.org | 12 |") for i in range(6)]
    clean = {30: "4.0", 31: "2024", 32: "chapter 7", 33: "| 77 | 12 |", 34: "| 4.0 | 12 |"}
    df = spark.createDataFrame(rows + sorted(clean.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.span_digest(pii.find_personal_data(df)).collect()}
    assert all(got[d] == "" for d in clean) and all(got[d].startswith("email:") for d, _ in rows)


def test_shapes_bar_values_of_another_type(spark):
    """A trusted context takes up what can be of its kind, not the times, years and amounts that stand there too."""
    rows = [(i, f"please write to user{i}@mail.com today") for i in range(9)]
    rows += [(20, "please write to jane77(a)corp.example today"), (21, "please write to 4.0 today"), (22, "please write to 5pm today")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.span_digest(pii.find_personal_data(df)).collect()}
    assert got[20] == "email:16:37" and got[21] == "" and got[22] == ""


FRAMES = {
    "email": ["send the files to {} before noon", "E-Mail: {}", "her address is {} since may", "contact = \"{}\""],
    "ip": ["the login came from host {} last night", "server: {}", "blocked at {} by rule", "traffic of node {} rose"],
    "card": ["paid with card number {} on friday", "Card: {}", "please charge my card {} twice", "the card {} was refused"],
    "phone": ["call me under {} after five", "Tel: {}", "our office number is {} weekdays", "ring {} for help"],
}


def planted(seed):
    """Texts in which known and unknown identifiers share contexts, and others with numbers that are none: (texts, unknown, number of others)."""
    r = random.Random(seed)
    filler = "light stone river seven walks under amber clouds while paper boats drift toward silent harbour lamps".split()

    def number(n):
        return "".join(r.choice("0123456789") for _ in range(n))

    def card(good):
        while True:
            d = r.choice("45") + number(15)
            if luhn(d) == good:
                return d

    seen = {"email": lambda: f"p{number(5)}@mail.example", "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)), "card": lambda: card(True), "phone": lambda: f"+1 ({number(3)}) 555-{number(4)}"}
    unseen = {"email": lambda: f"p{number(5)}(at)mail.example", "ip": lambda: f"{r.randrange(300, 900)}.{r.randrange(256)}.{r.randrange(256)}.7", "card": lambda: card(False), "phone": lambda: f"0{number(3)}-555-{number(4)}"}
    texts, unknown, others = [], [], 0
    for kind, frames in FRAMES.items():
        for n in range(240):
            hidden = n % 6 == 0
            value = (unseen if hidden else seen)[kind]()
            head = " ".join(r.choices(filler, k=r.randrange(3, 9))) + ". " + r.choice(frames).split("{}")[0]
            frame = next(f for f in frames if head.endswith(f.split("{}")[0]))
            tail = frame.split("{}")[1] + ". " + " ".join(r.choices(filler, k=5))
            if hidden:
                unknown.append((len(texts), f"{kind}:{len(head)}:{len(head) + len(value)}"))
            texts.append(head + value + tail)
    decoys = ["order {} was shipped", "in the year {} they met", "page {} of the book", "serial {} of lot", "version {} is out"]
    for _ in range(300):
        value = r.choice([lambda: number(4), lambda: number(16), lambda: f"{number(1)}.{number(1)}", lambda: number(9), lambda: f"A{number(6)}"])()
        text = " ".join(r.choices(filler, k=6)) + " " + r.choice(decoys).format(value) + " " + " ".join(r.choices(filler, k=4))
        others += not brute(text)
        texts.append(text)
    return texts, unknown, others


def test_recall_and_precision_on_planted_identifiers(spark):
    texts, unknown, others = planted(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    added = set()
    for row in pii.span_digest(pii.find_personal_data(df)).collect():
        base = brute(texts[row["doc_id"]])
        added |= {(row["doc_id"], x) for x in row["spans"].split(",") if x and x not in base}
    hit = added & set(unknown)
    print("planted", len(unknown), "added", len(added), "right", len(hit))
    assert others > 250
    assert len(hit) >= 0.9 * len(unknown)
    assert len(hit) >= 0.95 * len(added)
