"""Text functions on columns. Null is the empty text; patterns are Unicode-aware and ``.`` stops at a line feed only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions import vocab


def filled(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def nz(c: Column) -> Column:
    """Null for the empty string, so that ``coalesce(nz(a), b)`` means: a, or else b."""
    return F.nullif(c, F.lit(""))


#: White space as the patterns' ``\\s`` knows it.
SPACES = " \t\n\x0b\x0c\r"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def whitespace(c: Column) -> Column:
    """The light normalisation: NUL and tabs to spaces, carriage returns to line feeds, runs shortened, ends bare."""
    t = F.translate(filled(c), "\x00\r", " \n")
    return strip(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def whitespace_of(name: str) -> Column:
    """``whitespace`` of a column: one search tells the texts in which only the ends can change."""
    c = F.col(name)
    return F.when(c.rlike(r"[\x00\t\r]|  |\n\n\n"), whitespace(c)).otherwise(strip(filled(c)))


def repair_spacing(c: Column) -> Column:
    t = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), vocab.SPACING, c)
    return F.regexp_replace(t, r"\s+[|¦]\s+", " ")


def drop_repeated_words(c: Column) -> Column:
    """Runs of one word, in any case and over line ends, become its first occurrence."""
    return F.regexp_replace(c, r"(?iU)\b(\w+)(\s+\1\b)+", "$1")


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def drop_noise_lines(c: Column) -> Column:
    noise = "|".join(f"(?:{p})" for p in vocab.NOISE_LINES)
    return F.array_join(F.filter(_lines(c), lambda x: ~F.lower(x).rlike(noise)), "\n")


def with_value(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_lines(c: Column) -> Column:
    """Each line once, by its lower-cased words, the first spelling kept and blank lines dropped.

    Lines are sorted by key and place, the first of each key kept and put back in place: n log n in the lines.
    """
    bare = F.filter(F.transform(_lines(c), strip), lambda x: x != "")
    keyed = F.transform(bare, lambda x, i: F.struct(F.lower(F.regexp_replace(x, r"\s+", " ")).alias("k"), i.alias("i"), x.alias("v")))
    firsts = with_value(F.array_sort(keyed), lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["k"] != x["k"], F.lit(True))))
    placed = F.array_sort(F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"))))
    return F.array_join(F.transform(placed, lambda x: x["v"]), "\n")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, " {2,}", " "), r"\n{3,}", "\n\n"))


def clean_block(c: Column) -> Column:
    """The full cleaning, in its order: space, spacing, repeated words, noise lines, repeated lines, ends."""
    return squeeze(first_lines(drop_noise_lines(drop_repeated_words(repair_spacing(whitespace(c))))))


def word_count(c: Column) -> Column:
    return F.regexp_count(filled(c), F.lit(r"(?U)\w+"))


def alpha_ratio(c: Column) -> Column:
    t = filled(c)
    return F.when(F.length(t) == 0, F.lit(0.0)).otherwise(F.round(F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.length(t), 4))


def text_hash(c: Column) -> Column:
    """MD5 of the lightly normalised text: texts that differ in white space alone are equal."""
    return F.md5(whitespace(c).cast("binary"))


def clean_value(c: Column, limit: int = 500) -> Column:
    return F.left(F.btrim(F.regexp_replace(filled(c), r"\s+", " "), F.lit(" .,:;-")), F.lit(limit))


def head_tail(c: Column, limit: int, marker: str = "\n[...]\n", share: float = 0.65) -> Column:
    """Texts over ``limit`` keep their head, a marker and their tail."""
    room = limit - len(marker)
    head = int(room * share)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(marker), F.right(c, F.lit(room - head))))


def _cut_middle(c: Column, limit: int, spare: int, marker: str) -> Column:
    """Texts over ``limit`` to 65 % of it, a marker, and their end; ``spare`` is what the marker is reckoned with."""
    head = int(limit * 0.65)
    parts = [F.left(c, F.lit(head)), F.lit(marker), F.right(c, F.lit(limit - head - spare))]
    if marker.startswith("\n\n"):  # a marker in a paragraph of its own stands between bare ends
        parts[0], parts[2] = F.regexp_replace(parts[0], r"\s+$", ""), F.regexp_replace(parts[2], r"^\s+", "")
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(*parts))


def note_trim(c: Column, limit: int = 9000) -> Column:
    """A note cut in the middle for a prompt."""
    return _cut_middle(whitespace(c), limit, 32, "\n\n...[middle truncated for token budget]...\n\n")


def source_trim(c: Column, limit: int = 5500) -> Column:
    """A source text in one line, cut in the middle for a prompt."""
    return _cut_middle(F.trim(F.regexp_replace(filled(c), r"\s+", " ")), limit, 48, "\n...[middle omitted]...\n")


# Width and default of the stored fields of a mention.
STORED = {"category": (50, "unknown"), "label": (200, ""), "date_text": (100, ""), "certainty": (20, "unknown")}


def stored_fields(df: DataFrame) -> DataFrame:
    """``df`` with a mention's short fields as they are stored: bounded, blank ones by their default."""
    return df.withColumns({f: bounded(F.col(f), n, default) for f, (n, default) in STORED.items() if f in df.columns})


def category_key(c: Column) -> Column:
    return F.coalesce(nz(F.btrim(F.regexp_replace(F.lower(filled(c)), "[^a-z0-9]+", "_"), F.lit("_"))), F.lit("uncategorized"))


def safe_stem(c: Column) -> Column:
    return F.btrim(F.replace(F.regexp_replace(filled(c), r"(?U)[^\w.\- ]+", "_"), F.lit(" "), F.lit("_")), F.lit("._ "))


def section_title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def humanize(c: Column) -> Column:
    return strip(F.initcap(F.regexp_replace(F.replace(filled(c), F.lit("_"), F.lit(" ")), r"\s+", " ")))


def duration_text(seconds: Column) -> Column:
    """Seconds as ``5s``, ``2m 5s``, ``3h 1m`` or ``2d 4h``; a zero remainder is left out."""
    s = seconds.cast("long")

    def two(big: Column, big_unit: str, small: Column, small_unit: str) -> Column:
        return F.concat(big.cast("string"), F.lit(big_unit), F.when(small > 0, F.concat(F.lit(" "), small.cast("string"), F.lit(small_unit))).otherwise(F.lit("")))

    whole = lambda a, b: F.floor(a / F.lit(b)).cast("long")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(s < 3600, two(whole(s, 60), "m", s % 60, "s"))
        .when(s < 86400, two(whole(s, 3600), "h", whole(s % 3600, 60), "m"))
        .otherwise(two(whole(s, 86400), "d", whole(s % 86400, 3600), "h"))
    )


def first_sentence(c: Column, limit: int = 240) -> Column:
    return nz(F.left(strip(F.regexp_replace(filled(c), r"\s+", " ")), F.lit(limit)))


def bounded(c: Column, limit: int, default: str = "") -> Column:
    return F.left(F.coalesce(nz(F.trim(filled(c))), F.lit(default)), F.lit(limit))


def join_broken_words(c: Column) -> Column:
    """Spelling before-fixes: hyphenated breaks joined, spaces squeezed, hanging punctuation gone."""
    t = F.regexp_replace(filled(c), r"(?U)(\w+)-\s+(\w+)", "$1$2")
    return F.regexp_replace(F.regexp_replace(t, " {2,}", " "), r"^[\s:;\-|,.]+", "")


def display_form(c: Column) -> Column:
    """Spelling after-fixes: a capital first, units in their usual case."""
    t = F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), vocab.UNITS, t)
