"""License scan by diagonal voting.

Every rolling three-word gram of every text is joined by its hash with the template positions that hold it. A match of
text word d with template word p votes for the diagonal d - p: a notice quoted whole puts all its votes on one, and
a word put in or left out moves the rest to a neighbour. Votes are counted by diagonal, neighbouring diagonals merged,
and what is merged is verified against the template's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm.common import durable
from notewright.llm.license_texts import GRAM, LEAST_SHARE, Template, templates

#: What ends a word, as a Java character class, and the letters that are lower-cased.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def license_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased: runs of ASCII letters, digits and anything beyond ASCII."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), BREAKS), lambda x: x != "")


def gram_places(docs: DataFrame, found: list[Template], id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_words, d, template, p): the grams that templates hold, and for each row of ``docs`` one with d = -1.

    One pass over the texts. The templates' grams are a table that the library bounds (some hundred rows), so the
    join copies it to the tasks and no text is shuffled. A hash that fits by chance is refused by its words.
    """
    spark = docs.sparkSession
    held = spark.createDataFrame([(t.number, p, g) for t in found for p, g in enumerate(t.grams)], "template int, p int, gram string")
    held = held.select("template", "p", "gram", F.xxhash64("gram").alias("hash"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), license_words(F.col(text_col)).alias("w"))
    gram = F.transform("w", lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)))
    texts = texts.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.concat(F.array(F.lit("")), gram).alias("grams"))
    rolled = texts.select("row", "doc_id", "n_words", F.posexplode("grams").alias("d", "g")).withColumn("h", F.xxhash64("g"))
    same = (F.col("h") == F.col("hash")) & (F.col("g") == F.col("gram"))
    joined = rolled.join(F.broadcast(held), same, "left").where((F.col("d") == 0) | F.col("template").isNotNull())
    return joined.select("row", "doc_id", "n_words", (F.col("d") - 1).alias("d"), "template", "p")


def diagonals(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(row, template, diagonal, votes, places): diagonals with the votes that their template asks for.

    A diagonal meets each template position once, so ``places`` is no longer than the template.
    """
    voted = hits.where("template is not null").groupBy("row", "template", (F.col("d") - F.col("p")).alias("diagonal"))
    voted = voted.agg(F.count("*").alias("votes"), F.collect_list("p").alias("places"))
    return voted.join(F.broadcast(rules), "template").where("votes >= least_votes")


def merged_spans(voted: DataFrame) -> DataFrame:
    """(row, template, first_word, words, share, accepted): neighbouring diagonals as one span, verified.

    Diagonals no further apart than the template's band are one span. It is accepted if the words covered are the
    share asked for, all words that must stand are among them, and it is no longer than twice the template.
    """
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > F.col("band"), F.lit(True))
    marked = voted.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = marked.groupBy("row", "template", "span").agg(
        F.min(F.col("diagonal") + F.array_min("places")).alias("first_word"),
        F.max(F.col("diagonal") + F.array_max("places")).alias("last_gram"),
        F.array_distinct(F.flatten(F.collect_list(F.flatten(F.transform("places", lambda p: F.array(*[p + i for i in range(GRAM)])))))).alias("covered"),
        *[F.first(c).alias(c) for c in ("label", "base", "n_template", "must", "least_share")],
    )
    share = F.size("covered") / F.col("n_template")
    words = F.col("last_gram") + GRAM - F.col("first_word")
    fits = (share >= F.col("least_share")) & (F.size(F.array_except("must", "covered")) == 0) & (words <= 2 * F.col("n_template"))
    return spans.select("row", "template", "label", "base", "first_word", words.alias("words"), share.alias("share"), fits.alias("accepted"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: list[Template] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are the smallest and the largest of their
    starts (null if there is none). labels adds those of the notices. score is the greatest share of a phrase's or
    notice's words in one span, 0 without any. Null and empty texts have no words and no labels. Rows are told apart
    by their place in the input, so repeated rows and null ids each get their row; other columns of ``docs`` are not
    read, whatever their names. Places in a very long text are counted by groups, never gathered. An empty table
    gives no rows.
    """
    found = templates() if found is None else found
    rules = docs.sparkSession.createDataFrame(
        [(t.number, t.label, t.base, len(t.words), list(t.must), t.band, t.least_votes, 1.0 if t.whole else LEAST_SHARE) for t in found],
        "template int, label string, base boolean, n_template int, must array<int>, band int, least_votes int, least_share double",
    )
    hits = durable(gram_places(docs, found, id_col, text_col))
    spans = merged_spans(diagonals(hits, rules))
    place = F.when(F.col("base") & F.col("accepted"), F.col("first_word").cast("long"))
    named = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    by_row = spans.groupBy("row").agg(
        F.count(place).alias("n_base"),
        F.min(place).alias("first_word"),
        F.max(place).alias("last_word"),
        named(F.col("base") & F.col("accepted")).alias("base_labels"),
        named(F.col("accepted")).alias("labels"),
        F.round(F.max("share"), 6).alias("score"),
    )
    rows = hits.where("d = -1").select("row", "doc_id", "n_words")
    return rows.join(by_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
