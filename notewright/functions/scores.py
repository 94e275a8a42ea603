"""Predicates, scores and classes over columns."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from notewright.functions import vocab
from notewright.functions.text import alpha_ratio, filled, with_value, word_count

#: What ends a word for the patterns' ``\\b``.
WORD_BREAK = r"[^\p{L}\p{N}_]+"


def literal_of(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern holds; empty if none is sure."""
    if "|" in pattern or "(" in pattern:
        return ""
    runs = [""]
    for part in re.findall(r"\\.|\[[^\]]*\]|\{[^}]*\}|.", pattern, re.S):
        if part == r"\b":
            continue
        if part in "?*" or part[0] == "{":  # what stands before it may be missing
            runs[-1] = runs[-1][:-1]
            runs.append("")
        elif len(part) > 1 or part in "+.^$":
            runs.append("")
        else:
            runs[-1] += part
    return max(runs, key=len)


def occurs(low: Column, pattern: str) -> Column:
    """Whether a pattern of lower-case letters occurs in a lower-cased text: its literal is sought before the pattern is."""
    literal = literal_of(pattern)
    if literal == pattern:
        return F.contains(low, F.lit(literal))
    return F.contains(low, F.lit(literal)) & low.rlike(pattern) if literal else low.rlike(pattern)


def hits(c: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur, in any case.

    The text is lower-cased once and cut into words once: patterns that are one whole word are all looked up together
    among the words, the others one by one, behind a search for their literal.
    """
    whole = [m.group(1) for p in patterns if (m := re.fullmatch(r"\\b(\w+)\\b", p))]
    others = [p for p in patterns if not re.fullmatch(r"\\b\w+\\b", p)]

    def count(low: Column) -> Column:
        found = F.size(F.array_intersect(F.split(low, WORD_BREAK), F.array(*map(F.lit, whole)))) if whole else F.lit(0)
        return reduce(add, [occurs(low, p).cast("int") for p in others], found)

    return with_value(F.lower(c), count)


def first_of(c: Column, table: list[tuple[str, str]], regex: bool = True) -> Column:
    """The label of the first table row that occurs; null if none does."""
    test = (lambda p: c.rlike(p)) if regex else (lambda p: F.contains(c, F.lit(p)))
    return F.coalesce(*[F.when(test(p), F.lit(label)) for p, label in table])


def weak_page(c: Column, chars: int = 120, words: int = 22, alpha: float = 0.28) -> Column:
    return (F.length(filled(c)) < chars) | (word_count(c) < words) | (alpha_ratio(c) < alpha)


def low_value(c: Column, words: int = 12, counted: Column | None = None) -> Column:
    """Few words, two signs of no value, or a short text that only says a prescription was issued; ``counted`` is the
    number of words where it is known."""
    issued = lambda n: (n < words) | (F.contains(F.lower(c), F.lit("prescription has been issued")) & (n < 45))
    return with_value(word_count(c) if counted is None else counted, issued) | (hits(c, vocab.LOW_VALUE) >= 2)


def dates_in(c: Column) -> Column:
    """All dates, numeric ones first, each once in order."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit("(?i)(" + p + ")"), 1) for p in vocab.DATES]))


def signal(c: Column, dates: Column) -> Column:
    return F.least(F.floor(F.length(c) / 400).cast("int"), F.lit(4)) + F.least(F.size(dates), F.lit(3)) + hits(c, vocab.HINTS)


def needs_model(low: Column, score: Column, mentions: Column, words: Column, least_signal: int = 25, enough: int = 3, least_words: int = 40) -> Column:
    return ~low & (score >= least_signal) & (mentions < enough) & (words >= least_words)


def block_role(top: Column, bottom: Column, height: Column, text: Column) -> Column:
    t = F.lower(filled(text))
    return (
        F.when(top <= 0.12 * height, F.lit("header"))
        .when(bottom >= 0.92 * height, F.lit("footer"))
        .when(t.rlike("table|dose|vital"), F.lit("table"))
        .when(t.rlike("stamp|signature"), F.lit("stamp"))
        .otherwise(F.lit("body"))
    )


def length_bucket(words: Column) -> Column:
    (a, x), (b, y), (c, z) = vocab.BUCKETS
    return F.when(words <= x, F.lit(a)).when(words <= y, F.lit(b)).when(words <= z, F.lit(c)).otherwise(F.lit("xlong"))


def bucket_rank(bucket: Column) -> Column:
    return F.when(bucket == "short", 0).when(bucket == "medium", 1).when(bucket == "long", 2).otherwise(3)


def batch_limit(bucket: Column) -> Column:
    out = F.lit(vocab.BATCH_LIMIT["xlong"])
    for name in ("long", "medium", "short"):
        out = F.when(bucket == name, F.lit(vocab.BATCH_LIMIT[name])).otherwise(out)
    return out


def token_budget(bucket: Column, long: int = 1536, short: int = 1024) -> Column:
    return F.when(bucket.isin("long", "xlong"), F.lit(long)).otherwise(F.lit(short))


def document_type(c: Column) -> Column:
    t = F.lower(filled(c))
    out = F.when(t == "", F.lit("empty_or_unreadable_document")).otherwise(F.lit("unknown_medical_document"))
    for keys, name in reversed(vocab.DOC_TYPES):
        out = F.when(reduce(lambda x, y: x | y, [F.contains(t, F.lit(k)) for k in keys]), F.lit(name)).otherwise(out)
    return out


def photo_score(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """The photo rule: left, upper-middle, portrait and large boxes score."""
    area = (x1 - x0) * (y1 - y0) / (width * height)
    return (
        F.when(x0 <= 0.25 * width, 3.0).otherwise(0.0)
        + F.when((y0 >= 0.18 * height) & (y0 <= 0.5 * height), 3.0).otherwise(0.0)
        + F.when((y1 - y0) >= (x1 - x0), 2.0).otherwise(0.0)
        + F.least(100 * area, F.lit(2.0))
    )


def seconds_per_document(gpu: Column, memory_gb: Column) -> Column:
    return F.when(gpu & (memory_gb >= 20), 20).when(gpu, 40).otherwise(180)


def retry_delay(attempt: Column, retry_after: Column, message: Column) -> Column:
    """Seconds to wait: what the server asks, or what its message says and 0.75, or 2.5 a try; 70 at most."""
    said = F.regexp_extract(filled(message), r"try again in ([0-9.]+)s", 1).try_cast("double")
    return F.least(F.coalesce(retry_after.cast("double"), said + 0.75, 2.5 * (attempt + 1)), F.lit(70.0))


def confidence(no_mentions: Column, no_evidence: Column, no_diagnosis: Column, n_missing: Column) -> Column:
    flag = lambda c: c.cast("int")
    raw = F.lit(0.88) - 0.18 * flag(no_mentions) - 0.12 * flag(no_evidence) - 0.08 * flag(no_diagnosis) - 0.015 * F.least(n_missing, F.lit(4))
    return F.round(F.greatest(F.lit(0.25), F.least(raw, F.lit(0.98))), 3)
