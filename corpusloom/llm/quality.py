"""Quality rules, line first: lines that fail are removed, then documents that lose too much text are rejected."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, let, own_names, split_words, text_or_empty

MIN_WORDS = 50
FEW = 16  # different repeated windows up to which they are looked up one by one
REPEAT_PERCENT = 50  # words in repeated 3-word windows
LOSS_PERCENT = 50  # words in removed lines
SYMBOLS = "[#*$%&|<>]"
# Fixed values of the line rules.
NAVIGATION_MARKS = r"[|»›•→]"
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under", "privacy policy", "terms of use", "terms of service",
    "cookie", "enable javascript", "subscribe to", "sign up for", "log in to", "click here", "skip to content",
)
BOILERPLATE_WORDS = 30  # longer lines are prose that mentions such a phrase


def repeated_window_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more in the text, the first one included.

    Windows are sorted by digest, so a long text costs n log n and nothing leaves its row. Few repeated digests are looked
    up in the windows; many are found again by sorting the windows with their places. Both give the same.
    """

    def starts(w: Column) -> Column:
        digests = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        twice = lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) == x, F.lit(False))))
        return let(digests, lambda d: let(let(F.sort_array(d), twice), lambda t: F.when(F.size(t) <= FEW, few(d, t)).otherwise(many(d))))

    def few(d: Column, t: Column) -> Column:
        return F.filter(F.transform(d, lambda x, i: F.when(F.array_contains(t, x), i)), lambda p: p.isNotNull())

    def many(d: Column) -> Column:
        return let(F.sort_array(F.transform(d, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: F.sort_array(F.filter(F.transform(
            s, lambda x, i: F.when(F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)), x["i"]),
        ), lambda p: p.isNotNull())))

    def covered(at: Column) -> Column:
        state = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(at, state, lambda a, p: F.struct(
            p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n")), lambda a: a["n"])

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(covered(starts(w))))


def line_fails(line: Column, words: Column) -> Column:
    """Navigation, boilerplate or punctuation rule of one line of so many words. A line without words passes: it carries nothing."""
    navigation = let(F.regexp_count(line, F.lit(NAVIGATION_MARKS)), lambda marks: (marks >= 3) & (marks * 4 >= words))
    phrase = let(F.lower(line), lambda x: reduce(or_, [F.contains(x, F.lit(b)) for b in BOILERPLATE]))
    boilerplate = (words <= BOILERPLATE_WORDS) & phrase
    # Runs of symbols or exclamation marks glued to every other word.
    noisy = (words > 2) & (F.regexp_count(line, F.lit(r"[#*$%&<>]{2,}|!!")) * 2 >= words)
    # A long line without any sentence mark is a list of words, not prose.
    unpunctuated = (words >= 40) & ~line.rlike(r"[.,;:!?…。，！？؟]")
    return (words > 0) & (navigation | boilerplate | noisy | unpunctuated)


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its measures, verdict and cleaned text; all other columns stay.

    Adds a struct ``quality``: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``removed_words``
    (words in failing lines), ``base_failed``, ``kept`` and ``text`` (the lines that pass, in order). A null or empty text
    has no words, fails the base rule and keeps an empty text. Rows are judged one by one, so repeated rows and null ids
    get the verdict of their text. A column called ``quality`` of the input is replaced.
    """
    del id_col  # rows are not grouped; the name is part of the common signature of the operators

    def measures(words: Column, lines: Column, text: Column) -> Column:
        n_words = F.size(words).cast("long")
        judged = F.transform(lines, lambda x: let(F.regexp_count(x, F.lit(WORD)), lambda n: F.struct(x.alias("line"), n.alias("n"), line_fails(x, n).alias("fails"))))
        return F.struct(
            n_words.alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            repeated_window_words(words).alias("n_repeat_words"),
            judged.alias("lines"),
        )

    text = text_or_empty(text_col)
    measured = let(split_words(text), lambda w: let(F.split(text, "\n"), lambda x: measures(w, x, text)))
    # A filter on the verdict would otherwise be pushed below and work all of this out again for each field it reads.
    measured = F.when(F.monotonically_increasing_id() >= 0, measured)
    m, gone = own_names(docs, "_m", "_removed")
    base = (F.col(f"{m}.n_words") < MIN_WORDS) | (F.lit(100) * F.col(f"{m}.n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col(f"{m}.n_words"))
    worded = F.transform(F.filter(f"{m}.lines", lambda x: x["n"] > 0), lambda x: x["line"])
    removed = F.aggregate(f"{m}.lines", F.lit(0).cast("long"), lambda a, x: a + F.when(x["fails"], x["n"]).otherwise(0))
    passing = F.transform(F.filter(f"{m}.lines", lambda x: ~x["fails"]), lambda x: x["line"])
    return (
        docs.withColumn(m, measured)
        .withColumn(gone, removed)
        .withColumn("quality", F.struct(
            *[F.col(f"{m}.{n}") for n in ("n_words", "word_chars", "n_symbols")],
            let(worded, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.col(f"{m}.n_repeat_words"),
            F.col(gone).alias("removed_words"), base.alias("base_failed"),
            (~base & (F.lit(100) * F.col(gone) <= F.lit(LOSS_PERCENT) * F.col(f"{m}.n_words"))).alias("kept"),
            F.array_join(passing, "\n").alias("text"),
        ))
        .drop(m, gone)
    )


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Kept documents with their cleaned text, in the columns of the input."""
    judged = assess(docs, text_col=text_col).where("quality.kept")
    return judged.select(*[F.col("quality.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


