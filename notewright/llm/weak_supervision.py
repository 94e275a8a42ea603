"""Quality by weak supervision, in DataFrame and SQL functions only.

Rules over document statistics vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the table of
vote patterns estimates how often each rule votes how on good and on bad documents, and a document is kept by its posterior probability of being
good, not by passing every rule.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import SPACE_CLASS, SPACES, durable, words_of

#: The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
ITERATIONS = 25
START_GOOD = 0.8
#: Starting rates of the votes bad, abstain, good for good and for bad documents.
START_IF_GOOD, START_IF_BAD = (0.02, 0.38, 0.6), (0.4, 0.4, 0.2)
#: Each rule keeps so many pseudo-votes at the starting rates, so that one that rarely votes stays sane.
PRIOR_VOTES = 20.0


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base statistics of each whole text, all within its row: nothing is shuffled. Null is the empty text.

    Repeated three-word windows are found by sorting the windows' hashes with their places, only in texts that
    have an equal pair at all.
    """
    s = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    s = s.withColumn("w", words_of(F.col("t")))
    n = F.size("w")
    s = s.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate("t", SPACES, "")).cast("long"),
            "symbols_only": F.btrim(F.regexp_replace("t", f"[^{SYMBOLS}]+", " ")),
            "n_letters": F.length(F.regexp_replace("t", r"\P{L}+", "")).cast("long"),
            "n_upper": F.length(F.regexp_replace("t", r"\P{Lu}+", "")).cast("long"),
            "n_stops": F.length(F.regexp_replace("t", r"[^.?!;:,]+", "")).cast("long"),
            "n_bangs": F.length(F.regexp_replace("t", r"[^!]+", "")).cast("long"),
            "n_distinct": F.size(F.array_distinct("w")).cast("long"),
            "lines": F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""),
            "h": F.when(
                n >= 3,
                F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
            ).otherwise(F.array().cast("array<bigint>")),
        }
    ).drop("t", "w")
    s = s.withColumns(
        {
            "n_symbols": F.length(F.translate("symbols_only", " ", "")).cast("long"),
            "n_symbol_runs": F.when(F.col("symbols_only") == "", 0).otherwise(F.length("symbols_only") - F.length(F.translate("symbols_only", " ", "")) + 1).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "placed": F.when(
                F.size(F.array_distinct("h")) < F.size("h"),
                F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            ),
        }
    ).drop("lines", "h", "symbols_only")
    again = F.filter(
        "placed",
        lambda e, k: F.coalesce(F.get("placed", k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get("placed", k + 1)["h"] == e["h"], F.lit(False)),
    )
    covered = F.array_distinct(F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2))))
    repeat = F.when(F.col("placed").isNull(), F.lit(0)).otherwise(F.size(covered))
    return s.withColumn("n_repeat_words", repeat.cast("long")).drop("placed")


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, F.lit(-1))
    return (vote if good is None else vote.when(good, F.lit(1))).otherwise(F.lit(0)).cast("int")


def rules() -> dict[str, Column]:
    """The voting rules over the columns of ``statistics``.

    Most rules know a defect and abstain when they don't see it: that a text isn't shouting says nothing about
    its repeats. Only the rules on letters, repeats and sentence marks ever vote good.
    """
    c = F.col
    words, chars = F.greatest(c("n_words"), F.lit(1)), F.greatest(c("word_chars"), F.lit(1))
    mean = c("word_chars") / words
    enough = c("n_words") >= 20
    return {
        "symbols": _vote(c("n_symbols") > 0.08 * chars),
        "symbol_words": _vote(c("n_symbol_runs") > 0.25 * words),
        "letters": _vote(c("n_letters") < 0.85 * chars, enough & (c("n_letters") > 0.93 * chars)),
        "repeats": _vote(c("n_repeat_words") > 0.4 * words, enough & (c("n_repeat_words") < 0.15 * words)),
        "variety": _vote((c("n_words") >= 50) & (c("n_distinct") < 0.2 * words) & (c("n_distinct") < 400)),
        "lines": _vote((c("n_lines") >= 3) & (c("n_dup_lines") > 0.3 * c("n_lines"))),
        "capitals": _vote(c("n_upper") > 0.3 * chars),
        "bangs": _vote(c("n_bangs") > 0.2 * words),
        "lengths": _vote((mean < 2.5) | (mean > 12)),
        "stops": _vote((c("n_words") >= 50) & (c("n_stops") < 0.01 * words), enough & (c("n_stops") > 0.03 * words) & (c("n_stops") < 0.5 * words)),
    }


def fit_rules(votes: DataFrame, names: list[str], iterations: int = ITERATIONS) -> tuple[float, list[float], list[float]]:
    """(share of good, P(vote | good), P(vote | bad)), the latter by rule and vote (-1, 0, 1), by expectation-maximisation.

    A rule's accuracies are kept apart by class: a rule that rarely objects says much when it does and little when
    it agrees. All rounds run inside one SQL expression over the vote patterns, of which there are at most
    3 ** rules, whatever the number of documents. An empty table gives the starting values.
    """
    coded = [(F.col(r) + F.lit(3 * j + 1)).cast("int") for j, r in enumerate(names)]
    patterns = votes.groupBy(*names).agg(F.count("*").cast("double").alias("n"))
    packed = patterns.agg(F.collect_list(F.struct(F.array(*coded).alias("v"), F.col("n").alias("n"))).alias("p"))

    def values(xs: tuple[float, ...]) -> Column:
        return F.array(*[F.lit(x) for x in xs * len(names)])

    start = F.struct(F.lit(START_GOOD).alias("good"), values(START_IF_GOOD).alias("g"), values(START_IF_BAD).alias("b"))

    def posterior(v: Column, state: Column) -> Column:
        prior = F.ln(state["good"] / (1 - state["good"]))
        logit = F.aggregate(v, prior, lambda s, i: s + F.ln(F.get(state["g"], i) / F.get(state["b"], i)))
        return 1 / (1 + F.exp(-logit))

    def total(scored: Column, f) -> Column:
        return F.aggregate(scored, F.lit(0.0), lambda s, x: s + f(x))

    def step(state: Column) -> Column:
        scored = F.transform("p", lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), posterior(x["v"], state).alias("q")))

        def renew(sc: Column) -> Column:
            good, every = total(sc, lambda x: x["n"] * x["q"]), total(sc, lambda x: x["n"])

            def rates(weight, start_values: tuple[float, ...], mass: Column) -> Column:
                return F.array(
                    *[
                        (total(sc, lambda x, k=k: F.when(F.get(x["v"], F.lit(k // 3)) == k, weight(x)).otherwise(F.lit(0.0))) + PRIOR_VOTES * start_values[k % 3])
                        / (mass + PRIOR_VOTES)
                        for k in range(3 * len(names))
                    ]
                )

            share = F.least(F.greatest((good + 1) / (every + 2), F.lit(0.02)), F.lit(0.98))
            return F.struct(
                share.alias("good"),
                rates(lambda x: x["n"] * x["q"], START_IF_GOOD, good).alias("g"),
                rates(lambda x: x["n"] * (1 - x["q"]), START_IF_BAD, every - good).alias("b"),
            )

        return F.transform(F.array(scored), renew)[0]

    m = packed.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, lambda s, _: step(s)).alias("m")).first()["m"]
    return float(m["good"]), [float(x) for x in m["g"]], [float(x) for x in m["b"]]


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: base statistics, ``base_failed``, ``quality`` (posterior of good) and ``kept``.

    base_failed: under 50 words, or over half the words in repeated three-word windows. kept: not base_failed and
    quality >= threshold. Null and empty texts have no words and fail. Repeated rows each get their row; a null id
    is passed on. The statistics are computed once and kept in the checkpoint folder; an empty table gives an
    empty result.
    """
    named = rules()
    voted = durable(statistics(docs, id_col, text_col).withColumns(named))
    good, if_good, if_bad = fit_rules(voted, list(named))
    weight = [log(g / b) for g, b in zip(if_good, if_bad, strict=True)]
    logit = F.lit(log(good / (1 - good)))
    for j, r in enumerate(named):
        logit = logit + F.when(F.col(r) == -1, weight[3 * j]).when(F.col(r) == 0, weight[3 * j + 1]).otherwise(weight[3 * j + 2])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = voted.withColumn("quality", F.round(1 / (1 + F.exp(-logit)), 6)).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality", *named
    )

