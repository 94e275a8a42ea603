import random

import numpy as np
import xxhash

from notewright.llm import graph, simhash


def brute(rows):
    def fp(t):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(rows))


def test_against_brute_force(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows += [(1000 + i, t) for i, t in enumerate([None, "", " \n", "One", "one", "A b", "a  B c", rows[0][1] + " x", rows[0][1]])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect())
    assert got == brute(rows)


def test_every_close_pair_shares_a_block():
    rng = random.Random(3)
    masks = [m & (2**64 - 1) for m in simhash.block_masks()]
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(a & m == b & m for m in masks)


def test_long_runs_give_a_spanning_tree():
    rng = np.random.default_rng(1)
    base = np.uint64(rng.integers(0, 1 << 63))
    fps = np.unique(np.array([base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))], np.uint64))
    same = np.zeros(len(fps), np.int64)
    a, b = (np.searchsorted(fps, x) for x in simhash._links(same, same, fps, 3))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    label = np.arange(len(fps))
    for _ in range(len(fps)):
        label = np.minimum(label, np.where(near, label[None], len(fps)).min(axis=1))
    found = np.arange(len(fps))
    for _ in range(len(fps)):
        np.minimum.at(found, a, found[b])
        np.minimum.at(found, b, found[a])
    assert (found == label).all() and len(a) < len(fps)


def test_edge_tables(spark):
    schema = "doc_id long, text string, fp string, rep int, component_id string"
    assert simhash.simhash_groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(5, "a b c d", "x", 1, "y"), (5, "a b c d", "x", 1, "y"), (None, "a b c d", None, None, None), (7, "a b c d", "x", 1, "y")]
    df = spark.createDataFrame(rows, schema)
    got = [(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(df).collect()]
    assert sorted(got, key=repr) == [(5, 5), (5, 5), (7, 5), (None, None)]
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=repr) == [5, None]


def test_an_id_on_several_texts_keeps_each(spark):
    """One row of each component stays, whatever ids the rows share."""
    rng = random.Random(5)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    rows = [(1, a, "p"), (5, a, "q"), (5, b, "r"), (7, b, "s"), (7, b, "s"), (7, c, "t"), (7, c, "t"), (7, c, "u"), (None, a, "v"), (None, None, "w"), (9, None, "x"), (9, "", "y"), (3, " ", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __k0 string")
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (5, b), (7, c), (None, a), (None, None), (3, " ")], key=repr)
    ids = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in simhash.simhash_groups(df).collect()}
    assert sorted(v for k, v in ids.items() if k[0] == 5) == [1, 5]
    assert simhash.keep_one_of_each(df.limit(0)).count() == 0


def test_runs_across_batches(spark):
    """A run of equal keys that goes on through many small batches is compared as one."""
    rows = [(i, 1 << (i % 60)) for i in range(60)] + [(100 + i, (1 << 40) * (i + 1) ^ (i << 3)) for i in range(400)]
    groups = spark.createDataFrame(rows, "rep long, fp long").dropDuplicates(["fp"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["node"]: r["component"] for r in graph.connected_components(simhash.links(groups)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    fps = sorted({f for _, f in rows})
    label = {f: f for f in fps}
    for _ in fps:
        now = {f: min(label[g] for g in fps if (f ^ g).bit_count() <= 3) for f in fps}
        if now == label:
            break
        label = now
    assert got == {f: m for f, m in label.items() if sum(v == m for v in label.values()) > 1}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 160)}}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
