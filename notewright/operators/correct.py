"""Running text corrected against a dictionary with counts, through an index of deletions.

Two words within two edits have a common form after at most two deletions from the first seven letters of each. Those
forms are kept as a table (``deletion_index``); distinct words of the texts meet it by an equi join, candidates are
verified by edit distance, and texts are put together again with the words that have a better spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions import vocab
from notewright.functions.text import display_form, filled, join_broken_words, strip
from notewright.operators.skew import kept, lookup_join
from notewright.operators.spelling import CORRECTABLE, LEAST_LENGTH

#: Edits that a correction may take, and the letters from the start that the index deletes from. Lossless as long as
#: the prefix is longer than the edits.
MOST_EDITS, PREFIX = 2, 7
#: A word of this length or less is never corrected, nor a capitalised one of that.
SHORT_WORD, SHORT_NAME = 3, 6
#: A word, and the punctuation behind it that stays.
WORD = r"(?U)^(\w[\w-]*)(\W*)$"


def deletions(word: Column, prefix: int = PREFIX) -> Column:
    """All forms of a word's first letters with up to two of them deleted, each once; at most 1 + 7 + 21."""
    head = F.left(word, F.lit(prefix))
    cut = lambda w, i: F.concat(F.left(w, i), F.substr(w, i + 2))
    ones = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(0), F.length(w) - 1), lambda i: cut(w, i))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(head), ones(head), F.flatten(F.transform(ones(head), ones))))


def _tasks(df: DataFrame) -> int:
    """How many tasks words are dealt to: few bytes of them make much work, so they aren't left to one task for their size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def deletion_index(dictionary: DataFrame, term: str = "term", n: str = "n") -> DataFrame:
    """(key, term, n): the dictionary under its deletions. Write it as a table bucketed by key to use it again."""
    terms = dictionary.groupBy(F.lower(F.col(term)).alias("term")).agg(F.sum(n).alias("n")).where("term <> ''")
    terms = terms.repartition(_tasks(dictionary), "term")
    return terms.select(F.explode(deletions(F.col("term"))).alias("key"), "term", "n")


def _swaps(w: Column) -> Column:
    """A word with each pair of neighbouring letters exchanged."""
    at = lambda i: F.concat(F.left(w, i), F.substr(w, i + 2, F.lit(1)), F.substr(w, i + 1, F.lit(1)), F.substr(w, i + 3))
    return F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(0), F.length(w) - 2), at)).otherwise(F.array().cast("array<string>"))


def edits(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and exchanges of neighbours between two words; exact up to two."""
    far = F.levenshtein(a, b)
    one = F.array_min(F.transform(_swaps(a), lambda x: F.levenshtein(x, b)))
    two = F.array_min(F.transform(_swaps(b), lambda x: F.levenshtein(a, x)))
    both = F.when(F.arrays_overlap(_swaps(a), _swaps(b)), F.lit(2))
    return F.when(far <= 1, far).otherwise(F.least(far, one + 1, two + 1, both))


def suggestions(words: DataFrame, index: DataFrame, word: str = "word", most: int = MOST_EDITS) -> DataFrame:
    """(word, suggestion, edits, n): for each distinct word the closest term, of equals the one with most counts, then the
    first by letters. Words that are terms themselves, or have none within reach, give no row."""
    distinct = words.select(F.lower(F.col(word)).alias("word")).distinct().repartition(_tasks(words), "word")
    keyed = distinct.select("word", F.explode(deletions(F.col("word"))).alias("key"))
    met = keyed.join(index, "key").where(F.abs(F.length("word") - F.length("term")) <= most)
    # a pair is verified once, not once for each form that its words share: the condition hangs on the pair's count, or it
    # would be moved ahead of the grouping
    pairs = met.groupBy("word", "term", "n").agg(F.count("*").alias("__shared"))
    near = pairs.withColumn("edits", F.when(F.col("__shared") > 0, edits(F.col("word"), F.col("term")))).where(F.col("edits") <= most)
    best = near.groupBy("word").agg(F.min(F.struct("edits", (-F.col("n")).alias("rarity"), "term")).alias("b"))
    return best.where("b.edits > 0").select("word", F.col("b.term").alias("suggestion"), F.col("b.edits").alias("edits"), (-F.col("b.rarity")).alias("n"))


def correctable(clean: Column) -> Column:
    """Whether a word may be corrected: over three letters, without digits, no short capitalised word."""
    first = F.left(clean, F.lit(1))
    name = (F.lower(first) != first) & (F.length(clean) <= SHORT_NAME)
    return (F.length(clean) > SHORT_WORD) & ~clean.rlike(r"(?U)\d") & ~name


def _tokens(text: Column) -> Column:
    """The words of a text as structs: as written, clean, and with the punctuation behind."""
    parts = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.struct(
            x.alias("raw"),
            F.coalesce(F.nullif(F.regexp_extract(x, WORD, 1), F.lit("")), x).alias("clean"),
            F.when(x.rlike(WORD), F.regexp_extract(x, WORD, 2)).otherwise(F.lit("")).alias("tail"),
        ),
    )


def correct_text(texts: DataFrame, keys: list[str], text: str, index: DataFrame, whitelist: DataFrame | None = None, out: str = "corrected") -> DataFrame:
    """``texts`` with ``out``: the text with every correctable word replaced by its suggestion, in its order.

    ``keys`` tell the rows apart; rows of equal keys and text get equal results. White space between words becomes one
    space if a word is replaced at all, else the text stays as it is. A capital first letter and the punctuation
    behind a word stay. ``whitelist`` (one column) holds words that are never corrected. Null stays null.
    """
    rows = kept(texts.withColumn("__text", filled(text)))
    identity = [*keys, "__text"]
    words = rows.select(*identity, F.explode(F.array_distinct(F.transform(F.filter(_tokens(F.col("__text")), lambda t: correctable(t["clean"])), lambda t: F.lower(t["clean"])))).alias("word"))
    words = words.select(F.md5(F.to_json(F.struct(*identity))).alias("__id"), "word").distinct()
    counts = kept(words.groupBy("word").agg(F.count("*").alias("n")))
    asked = counts.select("word") if whitelist is None else counts.select("word").join(whitelist.select(F.lower(F.col(whitelist.columns[0])).alias("word")).distinct(), "word", "left_anti")
    found = kept(suggestions(asked, index).select("word", "suggestion"))
    pairs = lookup_join(words, found, "word", counts).groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("word", "suggestion"))).alias("__map"))
    joined = rows.withColumn("__id", F.md5(F.to_json(F.struct(*identity)))).join(pairs, "__id", "left")

    def put(t: Column) -> Column:
        better = F.when(correctable(t["clean"]), F.try_element_at(F.col("__map"), F.lower(t["clean"])))
        first = F.left(t["clean"], F.lit(1))
        cased = F.when(F.lower(first) != first, F.concat(F.upper(F.left(better, F.lit(1))), F.substr(better, F.lit(2)))).otherwise(better)
        return F.coalesce(F.concat(cased, t["tail"]), t["raw"])

    rewritten = F.array_join(F.transform(_tokens(F.col("__text")), put), " ")
    return joined.withColumn(out, F.when(F.col("__map").isNull(), F.col(text)).otherwise(rewritten)).drop("__id", "__map", "__text")


def correct_mentions(mentions: DataFrame, keys: list[str], index: DataFrame, whitelist: DataFrame | None = None, fields: list[str] = CORRECTABLE, least: int = LEAST_LENGTH) -> DataFrame:
    """``mentions`` with their free-text fields corrected in three passes: broken words joined, words corrected,
    display form. Fields shorter than ``least`` and all other columns stay."""
    out = mentions
    for f in [f for f in fields if f in mentions.columns]:
        long = F.length(strip(filled(f))) >= least
        fixed = correct_text(out.withColumn("__in", F.when(long, strip(join_broken_words(strip(F.col(f)))))), [*keys, f], "__in", index, whitelist, "__out")
        out = fixed.withColumn(f, F.when(F.col("__in").isNull(), F.col(f)).otherwise(strip(display_form(F.col("__out"))))).drop("__in", "__out")
    return out


def protected_terms() -> list[str]:
    """Words of the engine's own tables: drugs, histologies, operations and short forms."""
    return sorted({*vocab.DRUG_TERMS, *vocab.DRUGS, *vocab.OPERATIONS, *vocab.RADIATION, *[w for h in vocab.HISTOLOGY for w in h.split()], *[k for k, _ in vocab.SHORT_FORMS]})
