import math
import random
import time
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from notewright.llm import mixing


def brute_order(blocks, weights):
    """Slot by slot: of the blocks that may run by the plain definition of their windows, the one due first."""
    left, order = dict(blocks), []
    while any(left.values()):
        active = {s: Fraction(weights.get(s, 0.0)) for s, n in left.items() if n and weights.get(s, 0.0) > 0}
        active = active or {s: Fraction(blocks[s]) for s, n in left.items() if n}
        total = sum(active.values())
        share = {s: w / total for s, w in active.items()}
        done, begin = dict.fromkeys(active, 0), len(order)
        while all(left[s] for s in active):
            now = len(order) - begin
            may = [(math.ceil((done[s] + 1) / w), s) for s, w in share.items() if math.floor(done[s] / w) <= now]
            due, s = min(may)
            assert due >= now + 1
            order.append(s)
            done[s] += 1
            left[s] -= 1
    return order


@pytest.mark.parametrize("seed", range(8))
def test_order_against_a_plain_scan(seed):
    r = random.Random(seed)
    names = [f"=s{i}" for i in range(r.randint(1, 9))]
    blocks = {s: r.randint(0, 60) for s in names}
    weights = {s: r.choice([1.0, 2.0, r.random() + 0.01, math.sqrt(r.randint(1, 99)), 0.0]) for s in names}
    assert mixing.plan_order(blocks, weights) == brute_order(blocks, weights)


@pytest.mark.parametrize(
    "weights",
    [[0.7071, 0.2, 0.0929], [math.sqrt(50_000 + i) for i in range(20)], [1.0, 1e-4, math.sqrt(2)], [math.pi, math.e, 1.0, 1e-3, 7.0]],
)
def test_less_than_a_block_from_the_target_over_a_million_slots(weights):
    slots = 1_000_000
    total = sum(weights)
    share = mixing.exact_shares({f"{i:02d}": w for i, w in enumerate(weights)})
    # one more block than any source can run by then, so that no source runs out before
    order = mixing.edf_phase(share, {s: int(slots * weights[int(s)] / total) + 2 for s in share})
    ran = np.array([int(s) for s in order])
    now = np.arange(1, len(ran) + 1)
    assert len(ran) > 0.9 * slots
    for i, w in enumerate(weights):
        assert np.abs(np.cumsum(ran == i) - now * (w / total)).max() < 1


def test_plan_is_linear_in_the_blocks():
    blocks = {f"=s{i}": 3 + i % 5 for i in range(600)}
    order = mixing.plan_order(blocks, {s: math.sqrt(n) for s, n in blocks.items()})
    assert Counter(order) == Counter(blocks)


@pytest.mark.parametrize("weigh", [lambda i: math.sqrt(1000 + i), lambda i: 1.0, lambda i: 1.0 + i % 7])
def test_twenty_thousand_sources_are_planned_in_seconds(weigh):
    """Phases by the thousand, of all different, all equal and few different weights: no phase visits every source."""
    blocks = {f"=s{i}": 1 + i % 6 for i in range(20_000)}
    began = time.process_time()
    order = mixing.plan_order(blocks, {s: weigh(i) for i, s in enumerate(blocks)})
    assert time.process_time() - began < 20
    assert Counter(order) == Counter(blocks)


@pytest.mark.parametrize("seed", range(4))
def test_order_of_many_sources_with_ties_against_a_plain_scan(seed):
    r = random.Random(100 + seed)
    blocks = {f"=s{i}": r.randint(1, 4) for i in range(60)}
    weights = {s: r.choice([1.0, 1.0, 2.0, 3.0, r.random() + 0.5, 0.0]) for s in blocks}
    assert mixing.plan_order(blocks, weights) == brute_order(blocks, weights)


def test_positions_are_whole_and_follow_the_plan(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for weights, plan_blocks in ((None, 10**6), ({"src1": 3.0, "src2": 1.0, "nowhere": 5.0}, 10**6), (None, 40)):
        rows = mixing.mix_sources(docs, weights, block_rows=3, bucket_rows=4, plan_blocks=plan_blocks).collect()
        size = max(3, -(-len(rows) // plan_blocks))
        rows.sort(key=lambda r: r["mix_position"])
        assert [r["mix_position"] for r in rows] == list(range(docs.count()))
        assert [r["mix_slot"] for r in rows] == sorted(r["mix_slot"] for r in rows)
        by_slot = {}
        for r in rows:
            by_slot.setdefault(r["mix_slot"], []).append((r["source"], r["mix_block"]))
        assert all(len(set(x)) == 1 for x in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
        counts = Counter(r["source"] for r in rows)
        blocks = {f"={s}": -(-n // size) for s, n in counts.items()}
        assert all(len(x) == size or x[0][1] == blocks[f"={x[0][0]}"] - 1 for x in by_slot.values())
        targets = {f"={s}": n**0.5 for s, n in counts.items()} if weights is None else {f"={s}": w for s, w in weights.items()}
        turn, want = Counter(), {}
        for slot, s in enumerate(brute_order(blocks, targets)):
            want[(s[1:], turn[s])] = slot
            turn[s] += 1
        assert {(r["source"], r["mix_block"]): r["mix_slot"] for r in rows} == want


def test_edges(spark):
    schema = "doc_id long, source string, mix_slot string, n long, phases int, __k0 string, __k3 string, m map<string,int>"
    assert mixing.mix_sources(spark.createDataFrame([], schema)).count() == 0
    same = (1, "a", "x", 1, 1, "p", None, {"a": 1})
    df = spark.createDataFrame([same, same, (None,) * 8, (2, "", "x", 2, 2, "q", "r", None)], schema)
    out = mixing.in_mixed_order(mixing.mix_sources(df, block_rows=1)).collect()
    assert sorted(r["mix_position"] for r in out) == [0, 1, 2, 3] and len({(r["source"], r["mix_block"]) for r in out}) == 4
    assert sorted(((r["doc_id"], r["__k0"]) for r in out), key=repr) == [(1, "p"), (1, "p"), (2, "q"), (None, None)]


def test_rows_without_an_id_are_spread(spark):
    """A source whose ids are all null: its rows still fall into buckets of the wanted size, by their other columns."""
    df = spark.range(20_000).selectExpr("cast(null as long) as doc_id", "if(id % 3 = 0, 'hot', 'cold') as source", "cast(id as string) as text")
    mixed = mixing.mix_sources(df, bucket_rows=500)
    assert sorted(r[0] for r in mixed.select("mix_position").collect()) == list(range(20_000))
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "BatchEvalPython" not in plan and "InArrow" not in plan
