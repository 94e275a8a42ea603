import hashlib
import math
import random

import numpy as np
import pytest

from notewright.llm import centroids


def brute(rows, dims, k, rounds):
    """Plain loops over Python's integers."""
    kept = [(i, [math.floor(x * 64) if abs(x) < 1e300 else int(x) * 64 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[0], []).append(v)
        cents = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cents)]
    last = [(i, *near(v)) for i, v in kept]
    fit = lambda x: x if x < 2**63 else None
    per = [sum(d for _, c, d in last if c == j) for j in range(len(cents))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, fit(d), fit(per[c]), fit(sum(per)), digest[c]) for i, c, d in last), key=repr)


@pytest.mark.parametrize("scale, kind", [(1.0, "float"), (1e4, "double"), (1e6, "double"), (3e7, "float"), (1e12, "double"), (1e307, "double")])
def test_exact_at_every_magnitude(spark, scale, kind):
    rng = np.random.default_rng(int(math.log10(scale)))
    v = rng.normal(size=(300, 8)) * scale * np.where(rng.random((300, 1)) < 0.7, 1, 1e-4)
    v = v.astype(np.float32 if kind == "float" else np.float64).astype(float)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, v[0].tolist()), (901, v[0].tolist())]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
    got = centroids.cluster_vectors(df, dimensions=8, clusters=5).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 8, 5, 3)


def test_ties_holes_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 0.0]), (8, [-inf, 0.0]), (None, [0.5, 0.0]), (9, [-0.001, 1.0])]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<double>, v int, m string")
    got = sorted((tuple(r) for r in centroids.cluster_vectors(df, dimensions=2, clusters=3).collect()), key=repr)
    assert got == brute(rows, 2, 3, 3) and len(got) == 5
    few = centroids.cluster_vectors(df, dimensions=2, clusters=40).collect()
    assert {r["inertia"] for r in few} == {0}
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert centroids.cluster_vectors(empty).count() == 0


def test_products_agree_with_integers():
    rng = random.Random(1)
    for top in (10, 2**20, 2**22, 2**26, 2**40):
        v = np.array([[rng.randint(-top, top) for _ in range(64)] for _ in range(50)], dtype=float)
        c = [tuple(rng.randint(-top, top) for _ in range(64)) for _ in range(16)]
        number, distance = centroids.nearest(v, c)
        for x, n, d in zip(v, number, distance):
            every = [sum((int(a) - b) ** 2 for a, b in zip(x, y)) for y in c]
            assert int(d) == min(every) and n == every.index(min(every))
