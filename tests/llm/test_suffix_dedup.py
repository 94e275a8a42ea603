import hashlib
import random

import numpy as np

from notewright.llm import suffix_dedup
from notewright.llm.bwt import build_shard, repeated_intervals


def brute(rows):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                m[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, m) if not y)
        spans = sum(1 for i in range(len(b)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((d, len(b), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def made_rows(seed, n=60):
    r = random.Random(seed)
    parts = ["".join(r.choice("ab cdé") for _ in range(r.randint(20, 120))) for _ in range(25)]
    rows = [(i, "".join(r.choice(parts) + r.choice(["", "x", "yz"]) for _ in range(r.randint(0, 6)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 49), (n + 3, "a" * 50), (n + 4, "a" * 500), (n + 5, "a" * 51), (n + 6, "ab" * 400), (n + 7, "ab" * 300)]
    rows += [(n + 8, parts[0] * 3), (n + 9, parts[0] * 3), (n + 10, "q" + parts[0] * 2)]
    r.shuffle(rows)
    return rows


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for df in (docs, spark.createDataFrame(made_rows(1), "doc_id long, text string"), spark.createDataFrame(made_rows(2), "doc_id long, text string")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert sorted(map(tuple, suffix_dedup.dedup_digest(df).collect())) == brute(rows)


def test_kept_bytes_and_edges(spark):
    shared = "The quick brown fox jumps over the lazy dog again and again and again."
    rows = [(1, shared, 1), (2, "é" + shared + "ü", 2), (None, shared, 3), (3, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ranges int")
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in suffix_dedup.dedup_texts(df).collect()}
    assert got[1] == (0, shared.encode()) and got[2] == (len(shared), "éü".encode()) and got[None] == (0, shared.encode()) and got[3] == (0, b"")
    assert suffix_dedup.dedup_digest(df.limit(0)).count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    r = random.Random(9)
    s, a, b = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (80, 200, 200))
    rows = [(1, s), (5, s + a), (5, b), (5, b), (7, b + "x"), (9, a + "y" + s)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, suffix_dedup.dedup_digest(df).collect()))
    assert got == brute(rows)
    assert sorted(x[2] for x in got if x[0] == 5) == [0, 0, 80]


def test_one_anchor_in_every_row(spark):
    """The same 24 bytes stand in all texts among ever different ones: their strings are told apart one by one."""
    r = random.Random(4)
    core = "0123456789abcdefghijklmnopqrstuvwxyz"
    sides = ["".join(r.choice("xyz") for _ in range(r.randint(8, 40))) for _ in range(60)]
    rows = [(i, r.choice(sides) + core + r.choice(sides)) for i in range(300)] + [(i, sides[0] + core + sides[1]) for i in range(300, 330)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute(rows)
    for hot_rows in (0, 5, 10**6):
        assert sorted(map(tuple, suffix_dedup.dedup_texts(df, digest_only=True, hot_rows=hot_rows).collect())) == want


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    """Parts of a text longer than a chunk share the bytes of a string: its places stay those of the text."""
    r = random.Random(8)
    passage = "".join(r.choice("abcdefg hij") for _ in range(90))
    fill = ["".join(r.choice("klmnopq rst") for _ in range(r.randint(180, 600))) for _ in range(6)]
    rows = [(i, passage.join(fill[i % 6 :] + fill[: i % 6])) for i in range(8)] + [(8, "a" * 700), (9, passage), (10, "a" * 60)]
    want = brute(rows)
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 128)
    texts = [t.encode() for _, t in rows]
    starts = {}
    for parts, owner, begin in suffix_dedup._chunks(texts):
        for p, o, at in zip(parts, owner, begin):
            assert texts[o][at : at + len(p)] == p and len(p) < 128 + 50
            starts.setdefault(int(o), []).extend(range(at, at + max(0, len(p) - 49)))
    assert all(starts[i] == list(range(max(0, len(t) - 49))) for i, t in enumerate(texts))
    keep = np.full(1 << (suffix_dedup.FILTER_BITS - 6), 2**64 - 1, np.uint64)
    for pieces, owner, start, place, _ in suffix_dedup._pieces(texts, keep):
        for p, o, at in zip(pieces, owner, start):
            assert texts[o][at : at + len(p)] == p and len(p) >= 50
    monkeypatch.undo()
    long = [(0, "".join(r.choice("ab cd") for _ in range(suffix_dedup.CHUNK_BYTES * 2 + 77)))]
    long += [(1, "x" + long[0][1][suffix_dedup.CHUNK_BYTES - 60 : suffix_dedup.CHUNK_BYTES + 60]), (2, long[0][1][5:])]
    for data in (rows, long):
        df = spark.createDataFrame(data, "doc_id long, text string")
        assert sorted(map(tuple, suffix_dedup.dedup_digest(df).collect())) == (want if data is rows else brute(data))


def test_merged_transforms_find_repeats():
    rng = random.Random(5)
    for depth in (3, 8):
        strings = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))).encode() for _ in range(40)]
        shards, where = [], []
        for at in range(0, 40, 10):
            part = strings[at : at + 10]
            text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int16) + 1, np.int16(0)) for s in part])
            ends = np.flatnonzero(text == 0)
            shard = build_shard(text, ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text)))
            shards.append(shard)
            begin = np.concatenate(([0], ends[:-1] + 1))
            owner = np.searchsorted(ends, shard.start)
            where += [(at + int(o), int(s - begin[o])) for o, s in zip(owner, shard.start)]
        rows, group, common = repeated_intervals(shards, depth)
        found = {}
        for r, g in zip(rows, group):
            s, i = where[r]
            found.setdefault(int(g), set()).add((s, i))
            assert len(strings[s]) - i >= depth
        by_text = {}
        for s, x in enumerate(strings):
            for i in range(len(x) - depth + 1):
                by_text.setdefault(x[i : i + depth], set()).add((s, i))
        assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in by_text.values() if len(v) > 1)
        for r, c in enumerate(common):
            s, i = where[r]
            x = strings[s][i:]
            best = 0
            for k in range(1, min(depth, len(x)) + 1):
                if sum(y[j : j + k] == x[:k] for y in strings for j in range(len(y) - k + 1)) > 1:
                    best = k
            assert c == best
