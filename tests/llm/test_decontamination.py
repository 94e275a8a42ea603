import numpy as np

from notewright.llm import decontamination as d

ITEM = "A farmer in the valley has 12 kg of apples and gives Anna 5 kg of them each day until none are left over."


def found(spark, docs, items):
    docs = spark.createDataFrame(docs, "doc_id long, text string, hash int, width string")
    items = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in d.find_leaks(docs, items).collect()}


def test_copies_and_new_parameters(spark):
    filler = "Nothing here is of any interest to anyone at all. " * 3
    other = ITEM.replace("12", "7").replace("Anna", "Bruno").replace(" 5 ", " 2 ").replace("kg", "lb")
    twice = ITEM.replace("12", "3").replace(" 5 ", " 3 ")
    docs = [(1, filler + ITEM + " " + filler), (2, filler + other), (3, filler), (4, ITEM.lower()), (5, None), (6, ""), (None, ITEM), (7, "A farmer in the valley has 12 kg"), (8, twice), (1, filler + ITEM)]
    got = found(spark, [(*x, 1, "w") for x in docs], [(10, ITEM), (11, ITEM), (12, "one two three"), (13, None)])
    assert {k for k in got} >= {(1, 10), (1, 11), (2, 10), (4, 10)} and not {k[0] for k in got} & {3, 5, 6, 7, None}
    assert got[(2, 10)]["slots_changed"] and not got[(1, 10)]["slots_changed"]


def test_inconsistent_slots_do_not_count(spark):
    item = "from 4 cats and 4 dogs we get 8 pets in 4 homes on this street"
    same = item.replace("4", "9").replace("8", "18")
    torn = "from 1 cats and 2 dogs we get 3 pets in 5 homes on this street"
    got = found(spark, [(1, same, 1, "w"), (2, torn, 1, "w")], [(1, item)])
    assert set(got) == {(1, 1)}


def test_short_items_match_whole(spark):
    got = found(spark, [(1, "x y alpha beta gamma delta z", 1, "w"), (2, "alpha beta gamma", 1, "w")], [(1, "Alpha beta gamma delta."), (2, "alpha beta gamma")])
    assert set(got) == {(1, 1)}


NAMES = "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy Mallory Niaj Olivia Peggy Rupert Sybil".split()
DENSE = {
    1: "we saw " + " ".join(NAMES[:10]),
    2: "Name " + " ".join(NAMES),
    3: "Alice Bob Carol Dave Erin",
    4: "Sort 14 3 27 8 91 6 and 52",
    5: "Alice gave Bob 3 kg of apples",
    6: "Was Grace Heidi or Ivan the founder of Judy Mallory and Peggy",
}


def test_items_dense_in_names_are_found_as_copies(spark):
    """Whatever stands around a copy, a name before or after it included, and whatever its number of tokens."""
    around = [("", ""), ("it is said that ", " and so on and on"), ("yesterday Rupert Olivia ", " Niaj Peggy came"), ("One. ", ". Two."), ("at 12 ", " 13 kg of it")]
    docs = [(100 * k + i, f"{a}{t}{b}", 1, "w") for k, t in DENSE.items() for i, (a, b) in enumerate(around)]
    docs += [(9, "we saw Xaver Yann Zoe Walter Victor today", 1, "w"), (8, "Sort 15 3 28 8 91 7 and 53", 1, "w"), (7, "Name is nothing but a name", 1, "w")]
    got = found(spark, docs, [*DENSE.items(), (50, "Alice Bob Carol")])
    assert {(100 * k + i, k) for k in DENSE for i in range(len(around))} <= set(got)
    assert not {d for d, _ in got} & {7, 8, 9} and not any(i == 50 for _, i in got)
    left = d.without_leaks(spark.createDataFrame([(r[0], r[1]) for r in docs], "doc_id long, text string"), spark.createDataFrame(list(DENSE.items()), "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {7, 8, 9}


def test_empty_tables_and_filter_stage(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, "no"), (None, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert d.find_leaks(docs.limit(0), items).count() == 0 and d.find_leaks(docs, items.limit(0)).count() == 0
    assert sorted((r["doc_id"] for r in d.without_leaks(docs, items).collect()), key=repr) == [2, None]


def test_against_plain_word_windows(spark, small):
    """Documents with twelve words of an item in a row are found, and none without five."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    words = lambda t: [w.strip(".,;:!?*#$%&|").lower() for w in t.split()]

    def grams(t, n):
        w = words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    long, short = ({k: grams(t, n) for k, t in ((r["doc_id"], r["text"]) for r in docs.collect())} for n in (14, 5))
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(docs, items).collect()}
    for r in items.collect():
        item = grams(r["text"], 14), grams(r["text"], 5)
        for k in long:
            if long[k] & item[0]:
                assert (k, r["item_id"]) in got
            if (k, r["item_id"]) in got:
                assert short[k] & item[1]


def test_window_hashes_tell_order():
    a = np.arange(10, dtype=np.uint64)
    assert len(set(d.window_hashes(a, 4))) == 7 and d.window_hashes(a[:2], 4).size == 0


def test_a_conflict_drops_only_the_windows_that_hold_it(spark):
    long = ITEM + " Then Bella buys 9 m of rope and sells 3 m of it to the old man next door for 20 dollars in cash."
    equal = ITEM.replace("12", "3").replace(" 5 ", " 3 ")
    altered = long.replace("3 m of it", "3 ft of it")
    got = found(spark, [(1, equal, 1, "w"), (2, altered, 1, "w")], [(10, ITEM), (11, long)])
    assert {(1, 10), (2, 11)} <= set(got)


def test_items_of_numbers_match_word_for_word(spark):
    item = "Sort 14 3 27 8 91 6 and 52 then add 17 5 33 to 21 9 4 68 2"
    names = "ask Alice, Bob or Carol, then Dave 3 and Erin 7 or Frank 9 on Monday 4"
    got = found(spark, [(1, "first " + item + " and so on", 1, "w"), (2, item.replace("27", "28").replace("17", "18").replace("68", "69"), 1, "w"), (3, names, 1, "w")], [(1, item), (2, names)])
    assert set(got) == {(1, 1), (3, 2)} and not got[1, 1]["slots_changed"]


def test_a_name_of_two_words_for_one_of_one(spark):
    other = ITEM.replace("Anna", "Mary Ann")
    got = found(spark, [(1, other, 1, "w")], [(1, ITEM)])
    assert set(got) == {(1, 1)} and got[1, 1]["slots_changed"]


def test_recall_on_questions_with_new_values(spark):
    """Items with numbers, units and names, each copied with all values changed one to one: nearly all are found, and a
    question with the values but another wording is not."""
    import random

    r = random.Random(6)
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    items, docs = [], []
    for i in range(200):
        shape = [r.choices(["w", "n", "p", "u"], [72, 12, 10, 6])[0] for _ in range(r.randint(18, 50))]
        for k in range(2):
            fill, names = {"w": random.Random(i), "x": random.Random(1000 * i + k)}, {}
            out = []
            for j, kind in enumerate(shape):
                if kind == "w" or j == 0:
                    out.append("".join(fill["w"].choice("bcdfglmnprst") + fill["w"].choice("aeiou") for _ in range(fill["w"].randint(1, 4))))
                elif kind == "p":
                    out.append(names.setdefault(j % 3, f"{fill['x'].choice('ABCDEF')}{'lmnop'[j % 3]}{fill['x'].choice(['a', 'eo', 'ira'])}{'xyz'[k]}"))
                else:
                    out.append(str(100 * (k + 1) + j) + (" kg" if kind == "u" and k == 0 else " lb" if kind == "u" else ""))
            (items if k == 0 else docs).append((i, " ".join(out)))
    filler = lambda: " ".join(word() for _ in range(40))
    docs = [(i, f"{filler()} {t} {filler()}", 1, "w") for i, t in docs] + [(1000 + i, filler() + " 101 kg 205 lb " + filler(), 1, "w") for i in range(200)]
    got = set(found(spark, docs, items))
    hit = sum((i, i) in got for i in range(200))
    print(f"recall {hit / 200}")
    assert hit >= 180 and all(a == b for a, b in got)
