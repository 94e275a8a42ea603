import random
import re

from notewright.llm import license_scan
from notewright.llm.license_texts import PHRASES, templates


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(t):
    """Every template against every diagonal of the text, one by one."""
    w = words(t)
    places, base, labels, best = [], set(), set(), 0.0
    for x in templates():
        m, votes = len(x.words), {}
        for d in range(len(w) - 2):
            for p in range(m - 2):
                if w[d : d + 3] == list(x.words[p : p + 3]):
                    votes.setdefault(d - p, []).append(p)
        strong = sorted(a for a, ps in votes.items() if len(ps) >= x.least_votes)
        islands = []
        for a in strong:
            if islands and a - islands[-1][-1] <= x.band:
                islands[-1].append(a)
            else:
                islands.append([a])
        for island in islands:
            covered = {p + i for a in island for p in votes[a] for i in range(3)}
            low, high = min(a + min(votes[a]) for a in island), max(a + max(votes[a]) for a in island) + 3
            best = max(best, len(covered) / m)
            if len(covered) / m >= (1.0 if x.whole else 0.8) and set(x.must) <= covered and high - low <= 2 * m:
                labels.add(x.label)
                if x.base:
                    base.add(x.label)
                    places.append(low)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(best, 6)


def plain_places(t):
    w = words(t)
    return sorted(i for p in PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def notice(label, size):
    return next(" ".join(x.words) for x in templates() if x.label == label and len(x.words) > size)


def texts():
    rng = random.Random(3)
    gpl, mit = notice("gpl-3", 20), notice("mit", 20)
    out = [None, "", " \n--", "cc", "CC BY-NC", "cc by nc cc by nc sa", "Under the MIT License under the mit license", "apache license, version 2.0", "Ünder the MIT License", "cc\x00by\x7fnc"]
    out += [gpl, gpl.upper(), mit, notice("bsd", 20), notice("apache-2", 20), notice("mpl-2", 20)]
    out += ["x " * 7 + mit.replace("any person", "any one natural or legal person") + " y" * 5, gpl.replace("gnu general", "gnu lesser general"), gpl[: len(gpl) // 2]]
    out += [f"{gpl} and later {gpl}", " ".join([mit] * 3), "GNU Lesser General Public License, version 3", "GNU General Public License v2"]
    pool = sorted({w for t in templates() for w in t.words})
    for _ in range(40):
        w = (gpl + " " + mit).split()
        for _ in range(rng.randrange(12)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(2)] = [rng.choice(pool)]
        out.append(" ".join(w))
        out.append(" ".join(rng.choice(pool[:30]) for _ in range(300)))
    return out


def test_every_row_against_loops(spark):
    rows = [(i, t, "clash", 3) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string, row int")
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.scan_licenses(df).collect()}
    for i, t, *_ in rows:
        assert got[i] == brute(t), (i, t)
        assert got[i][1] == len(plain_places(t))


def test_notices_with_edits_are_labelled(spark):
    rng = random.Random(5)
    rows = []
    for k in range(100):
        label = rng.choice(["gpl-3", "mit", "bsd", "isc", "unlicense"])
        w = notice(label, 20).split()
        at = rng.randrange(len(w) // 2 + 8, len(w) - 3)  # behind the words that must stand
        w[at:at] = ["really"] * rng.randrange(1, 4)
        rows.append((k, "some words before " + " ".join(w) + " some words after", label))
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string, planted string")).collect()
    found = {r["doc_id"]: r["labels"].split(",") for r in got}
    assert sum(label in found[k] for k, _, label in rows) >= 95


def test_repeated_null_and_long_rows(spark):
    long = "lorem ipsum " * 200_000 + "cc by-nc " * 5_000
    rows = [(None, "cc by nc"), (None, "cc by nc"), (7, None), (7, None), (8, long)]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    by = sorted((r["doc_id"] or -1, r["n_base"], r["first_word"], r["last_word"], r["score"]) for r in got.collect())
    assert by == [(-1, 1, 0, 0, 1.0)] * 2 + [(7, 0, None, None, 0.0)] * 2 + [(8, 5_000, 400_000, 414_997, 1.0)]
    assert license_scan.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
