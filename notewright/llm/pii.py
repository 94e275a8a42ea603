"""Personal data by bootstrapped contextual extraction, in DataFrame and SQL functions only.

Four expressions find base spans. Their values are the seeds: the words around them are patterns, and a graph of
patterns and the values they surround is scored in rounds. A pattern is trusted for a kind when most of the distinct
values it surrounds are known to be of that kind; a value is taken up when the patterns around it make it likely and its
own shape can be of the kind. Trusted patterns so find identifiers that no expression describes.

A pattern is made of words in lower case, without marks; tokens with a digit or an at sign are one placeholder. It is the
two words before, the two after, the one before with the one after, the one before with the third before (what stands
between is skipped), or a label with its colon or equals sign. One without any letter is no pattern.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import durable, fresh_names

#: The kinds in order, and their expressions. Possessive quantifiers and the look-behind only keep the
#: search linear: a match could not start inside a run that failed at its beginning.
KINDS = ("email", "ip", "card", "phone")
EXPRESSIONS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
#: A possible identifier: a token with a digit or an at sign, and number groups that follow it after one space.
CANDIDATE = r"(?<![^\s\"'<>,;=])[^\s\"'<>,;=]*[0-9@][^\s\"'<>,;=]*(?: \(?[0-9][0-9().-]*)*"
#: What a value taken up for a kind must look like: an address three letters, an ip four groups, a number its digits.
SHAPES = {
    "email": r"^(?=(?:.*\p{L}){3}).{6,}$",
    "ip": r"^(?=.*[0-9])[0-9a-f]*(?:[.:][0-9a-f]*){3,}$",
    "card": r"^(?:[^\p{L}0-9]*[0-9]){12,19}[^\p{L}0-9]*$",
    "phone": r"^(?:[^\p{L}0-9]*[0-9]){7,15}[^\p{L}0-9]*$",
}
#: A word with a colon or equals sign right before a value, and perhaps an opening mark.
LABEL = r"(\p{L}[\p{L}\p{M}0-9_-]*)\s*[:=]\s*[\"'(\[]?$"
#: Rounds go on until nothing is taken up or given up and the beliefs stand still; so many end them in any case.
MOST_ROUNDS = 50
#: A pattern is trusted with so many distinct known values of a kind, if they are this share of all it surrounds.
LEAST_KNOWN, LEAST_SHARE = 3, 0.6
#: A value is taken up at this probability of being of a kind, by noisy-or over its trusted patterns.
LEAST_BELIEF = 0.6
#: A pattern is made of the nearest words, of a word that goes on beyond so many characters the nearer part.
CONTEXT_CHARS = 60
#: Steps of a fold whose results are put together at once; characters of a text in one piece.
STEP, PIECE = 128, 512
#: Characters of a text whose base spans are looked through together for one that a candidate touches.
STRETCH = 8192


def _fold(n: Column, at: Column, kind: str, step) -> Column:
    """What ``step(state, i)`` has put into ``state.out`` (an array of ``kind``) for i from 0 to n - 1, n at least one.

    The running ``state.at`` is carried through chunks of STEP steps, so that no list is copied once for each step.
    """

    def chunk(state: Column, c: Column) -> Column:
        start = F.struct(state["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        part = F.aggregate(F.sequence(c * STEP, F.least((c + 1) * STEP, n) - 1), start, step)
        grown = F.transform(F.array(part), lambda p: F.struct(p["at"].alias("at"), F.concat(state["out"], F.array(p["out"])).alias("out")))
        return F.get(grown, F.lit(0))

    start = F.struct(at.alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.floor((n - 1) / STEP).cast("int")), start, chunk, lambda s: F.flatten(s["out"]))


def _spans(matches: str, pieces: str) -> Column:
    """Start, end (exclusive) and value of each match, from the matches and the pieces between them."""
    kind = "struct<start:int,end:int,value:string>"

    def step(state: Column, i: Column) -> Column:
        begin = state["at"] + F.length(F.get(pieces, i))
        end = begin + F.length(F.get(matches, i))
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), F.get(matches, i).alias("value")))
        return F.struct(end.alias("at"), F.concat(state["out"], one).alias("out"))

    run = _fold(F.size(matches), F.lit(0), kind, step)
    return F.when(F.col(matches).isNotNull() & (F.size(matches) > 0), run).otherwise(F.array().cast(f"array<{kind}>"))


def _cut(text: Column) -> Column:
    """The text in pieces of PIECE characters: a place in it is found without counting from the start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), 0)


def _between(parts: Column, a: Column, b: Column) -> Column:
    """Characters a to b - 1 of a text cut into pieces, as far as it goes."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")

    def part(at: Column) -> Column:
        return F.coalesce(F.get(parts, at), F.lit(""))

    first = F.substring(part(i), (a - i * PIECE + 1).cast("int"), F.lit(PIECE))
    apart = F.concat(first, F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(part(j), F.lit(1), (b - j * PIECE).cast("int")))
    return F.when(b <= a, F.lit("")).when(i == j, F.substring(part(i), (a - i * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise(apart)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by ten."""
    total = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2),
        ),
        F.lit(0),
        lambda s, d: s + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits).between(16, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _words(text: Column) -> Column:
    """The words of a text with one space between, tokens with a digit or an at sign as 0."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\S*[0-9@]\S*", " 0 "), r"[^\p{L}\p{M}0]+", " "))


def _patterns(around: Column) -> Column:
    """The patterns that the words around a value make: all their words are there, and one has a letter."""
    before, after = around["l"], around["r"]
    one, two, three, next_one, next_two = F.get(before, F.lit(0)), F.get(before, F.lit(1)), F.get(before, F.lit(2)), F.get(after, F.lit(0)), F.get(after, F.lit(1))

    def made(mark: str, *words: Column) -> Column:
        whole = F.concat(F.lit(mark), *[x for w in words for x in (F.lit("|"), F.nullif(w, F.lit("")))])
        return F.when(F.substring(whole, len(mark) + 1, CONTEXT_CHARS * 2 + 2).rlike(r"\p{L}"), whole)

    return F.array_compact(F.array(made("L", two, one), made("M", one, next_one), made("R", next_one, next_two), made("G", three, one), made("K", around["label"])))


def shaped(value: Column, k: Column) -> Column:
    """Whether a value can be of the kind with index k by its shape."""
    return F.coalesce(*[F.when(k == i, value.rlike(SHAPES[kind])) for i, kind in enumerate(KINDS)])


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, others): the base spans of each text by kind and start, and the possible identifiers outside
    them; each with its value, lower-cased, and the context patterns around it."""
    s = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    s = s.withColumn("some", F.col("t").rlike("[0-9@]"))
    steps = {**EXPRESSIONS, "other": CANDIDATE}
    cut = {}
    for kind, pattern in steps.items():
        here = F.col("some") & F.col("t").rlike(HINTS[kind]) if kind in HINTS else F.col("some")
        cut[f"{kind}_m"] = F.when(here, F.regexp_extract_all("t", F.lit(pattern), 0))
        cut[f"{kind}_p"] = F.when(here, F.split("t", pattern, -1))
    s = s.withColumns(cut)
    s = s.withColumns({f"{k}_s": _spans(f"{k}_m", f"{k}_p") for k in steps}).drop(*cut)

    def placed(k: int, kind: str) -> Column:
        kept = F.filter(f"{kind}_s", lambda x: _valid(kind, x["value"])) if kind in HINTS else F.col(f"{kind}_s")
        return F.transform(kept, lambda x: F.struct(F.lit(k).alias("k"), x["start"].alias("start"), x["end"].alias("end"), F.lower(x["value"]).alias("value")))

    s = s.withColumns(
        {"base": F.concat(*[placed(i, k) for i, k in enumerate(KINDS)]), "others": placed(-1, "other")}
    ).drop(*[f"{k}_s" for k in steps])
    # the base spans that touch each stretch of the text: a candidate is only held against those of its own stretches
    stretches = F.sequence(F.lit(0), F.floor(F.length("t") / STRETCH).cast("int"))
    near = F.transform(stretches, lambda c: F.filter("base", lambda b: (b["start"] < (c + 1) * STRETCH) & (b["end"] > c * STRETCH)))
    s = s.withColumn("parts", F.when(F.col("some"), _cut(F.col("t"))))

    def touched(o: Column, near: Column) -> Column:
        i, j = F.floor(o["start"] / STRETCH).cast("int"), F.floor(o["end"] / STRETCH).cast("int")
        return F.exists(F.flatten(F.slice(near, i + 1, j - i + 1)), lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"]))

    # bound as a variable, or else it would be made anew for each candidate
    outside = F.get(F.transform(F.array(near), lambda n: F.filter("others", lambda o: ~touched(o, n))), F.lit(0))
    # a candidate ends at its last letter or digit
    trimmed = F.transform(
        outside,
        lambda o: F.struct(
            o["k"].alias("k"),
            o["start"].alias("start"),
            (o["end"] - F.length(F.regexp_extract(o["value"], r"[^\p{L}\p{N}]*$", 0))).alias("end"),
            F.regexp_replace(o["value"], r"[^\p{L}\p{N}]+$", "").alias("value"),
        ),
    )

    def context(x: Column) -> Column:
        low = F.greatest(x["start"] - CONTEXT_CHARS, F.lit(0))
        left = F.lower(_between(F.col("parts"), low, x["start"]))
        right = F.lower(_between(F.col("parts"), x["end"], x["end"] + CONTEXT_CHARS))
        # a value's own token ends at white space
        around = F.struct(
            F.regexp_extract(left, LABEL, 1).alias("label"),
            F.reverse(F.split(_words(left), " ")).alias("l"),
            F.split(_words(F.regexp_replace(right, r"^\S+", "")), " ").alias("r"),
        )
        patterns = F.get(F.transform(F.array(around), _patterns), F.lit(0))
        return F.struct(x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), patterns.alias("patterns"))

    return s.select("doc_id", F.xxhash64("t").alias("text_hash"), F.transform("base", context).alias("base"), F.transform(trimmed, context).alias("others"))


def score_graph(edges: DataFrame, known: DataFrame, rounds: int = MOST_ROUNDS, fits: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Values taken up beyond the ``known`` ones: (value, k, belief). Only a value that ``fits`` a kind is taken up for it.

    ``edges``: distinct (pattern, value). ``known``: (value, k). Every round sums over distinct edges with map-side
    partial sums; the edges of a common value or pattern stream through joins with one row of the other side, which
    adaptive execution splits where they are skewed. Rounds go on to the fixed point; where kinds take values from each
    other by turns there is none, and a warning says that the last round's result is returned.
    """
    patterns = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = known.withColumn("belief", F.lit(1.0))
    believed, before = seeds, None
    for _ in range(rounds):
        held = edges.join(believed, "value").groupBy("pattern", "k").agg(F.count("*").alias("f"), F.sum("belief").alias("w"))
        trusted = held.where(F.col("f") >= LEAST_KNOWN).join(patterns, "pattern").withColumn("share", F.col("w") / F.col("n")).where(F.col("share") >= LEAST_SHARE)
        votes = edges.join(trusted.select("pattern", "k", "share"), "pattern")
        taken = votes.groupBy("value", "k").agg((1 - F.exp(F.sum(F.ln(1 - F.least("share", F.lit(0.999)))))).alias("belief"))
        if fits is not None:
            taken = taken.where(fits(F.col("value"), F.col("k")))
        best = taken.groupBy("value").agg(F.max(F.struct("belief", (-F.col("k")).alias("k"))).alias("b"))
        best = best.where(F.col("b.belief") >= LEAST_BELIEF).select("value", (-F.col("b.k")).alias("k"), F.col("b.belief").alias("belief"))
        new = durable(best.join(known.select("value").distinct(), "value", "left_anti"))
        now = new.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("value", "k")).alias("h"), F.coalesce(F.sum("belief"), F.lit(0.0)).alias("b")).first()
        if before is not None and (now["n"], now["h"]) == (before["n"], before["h"]) and abs(now["b"] - before["b"]) < 1e-3:
            break
        believed, before = seeds.unionByName(new), now
    else:
        warnings.warn(f"beliefs had not settled after {rounds} rounds", stacklevel=2)
    return new


def _labelled(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat(F.get(name, x["k"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, base (array of spans), found (array of spans the method adds).

    A span is (k: index in KINDS, start, end, value), in code points, end exclusive. Null and empty texts have none;
    repeated rows each get their row, and count once as evidence; a null id is passed on; rows that share an id are told
    apart by their text. Texts of any length are read whole. Other columns, whatever their names, are not read; an empty
    table gives an empty result. A value that two kinds of patterns claim alike is of the first kind whose shape it has. A
    text that is nothing but a value, or has no word near it, makes no pattern.
    """
    marked = durable(base_spans(docs, id_col, text_col))
    row = ["doc_id", "text_hash"]
    flat = marked.select(*row, F.explode(F.concat("base", "others")).alias("x")).select(*row, "x.*").where("value <> ''")
    edges = durable(flat.select(F.explode("patterns").alias("pattern"), "value").distinct())
    known = durable(flat.where("k >= 0").select("value", "k").distinct().groupBy("value").agg(F.min("k").alias("k")))
    taken = score_graph(edges, known, fits=shaped).select("value", F.col("k").alias("kind"))
    added = flat.where("k < 0").join(taken, "value").select(*row, F.struct(F.col("kind").alias("k"), "start", "end", "value").alias("x"))
    by_row = added.groupBy(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h")).agg(F.sort_array(F.collect_set("x")).alias("found"))
    plain = F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    none = F.array().cast("array<struct<k:int,start:int,end:int,value:string>>")
    joined = marked.select(*row, plain.alias("base")).join(by_row, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("text_hash") == F.col("__h")), "left")
    return joined.select(*row, "base", F.coalesce("found", none).alias("found"))


def span_digest(found: DataFrame) -> DataFrame:
    """The digest columns of ``find_personal_data``'s rows."""
    kinds = F.transform("base", lambda x: x["k"])
    counts = [F.size(F.array_remove(kinds, i)) for i in range(len(KINDS))]
    counts = [(F.size("base") - n).cast("long").alias(f"n_{k}") for k, n in zip(KINDS, counts, strict=True)]
    every = F.sort_array(F.concat("base", "found"))
    return found.select("doc_id", *counts, F.sha2(_labelled(F.col("base")).cast("binary"), 256).alias("base_sha256"), _labelled(every).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of personal data in the text replaced by its kind in square brackets.

    Overlapping spans become one, of the kind of the one that starts first, the longer of two that start together. The values that the
    method adds are replaced wherever they stand as candidates. Rows and columns, whatever their names, stay as they are
    but for the text and for ``n_chars`` where there is one, which follows the text. A null text stays null, an empty
    one empty; equal rows are changed alike; long texts are rebuilt whole; an empty table gives an empty result.
    """
    found = find_personal_data(docs, id_col, text_col).where((F.size("base") > 0) | (F.size("found") > 0))
    spans = F.transform(F.concat("base", "found"), lambda x: F.struct(x["start"].alias("s"), (-x["end"]).alias("e"), x["k"].alias("k")))
    one, two, spots, parts, shown = fresh_names(docs, 5)
    some = found.select(F.col("doc_id").alias(one), F.col("text_hash").alias(two), F.sort_array(spans).alias(spots)).dropDuplicates([one, two])
    same = docs[id_col].eqNullSafe(F.col(one)) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == F.col(two))
    joined = docs.join(some, same, "left").withColumn(parts, F.when(F.col(spots).isNotNull(), _cut(F.col(text_col))))
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(state: Column, i: Column) -> Column:
        x = F.get(spots, i)
        new = F.concat(_between(F.col(parts), state["at"], x["s"]), F.get(name, x["k"]))
        return F.struct(F.greatest(state["at"], -x["e"]).alias("at"), F.concat(state["out"], F.array(F.when(x["s"] >= state["at"], new).otherwise(""))).alias("out"))

    rebuilt = F.array_join(_fold(F.size(spots), F.lit(0), "string", step), "")
    rest = _between(F.col(parts), F.array_max(F.transform(spots, lambda x: -x["e"])), F.length(text_col))
    joined = joined.withColumn(shown, F.when(F.col(spots).isNull(), F.col(text_col)).otherwise(F.concat(rebuilt, rest)))
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(F.col(shown).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col(spots).isNull(), F.col(c)).otherwise(F.length(shown)).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)
