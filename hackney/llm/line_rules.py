"""Line-first cleaning: rules judge lines, and texts that lose too much are rejected.

Each line that has a word is judged by itself. It fails

* as navigation: it is a list of short entries between separators;
* by punctuation: many of its characters are symbols, or no word in it ends in
  closing punctuation;
* as boilerplate: it holds a phrase of the list, or is equal to an earlier line.

Failing lines are removed. A text is rejected if more than ``LOSS`` of the characters
in its lines go with them, or if the base rules fail.

DataFrame functions only, and no shuffle: each row is judged in its own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the contract has it; in Java's and DuckDB's expressions alike.
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Closing punctuation at the end of a word, with closing quotes after it.
CLOSED = r"[.!?;:…。！？][\"'”’»)\]]*([\x20\x09-\x0D]|$)"
SEPARATED = r"[|»›>•·]"
#: Phrases of page furniture (fixed values).
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "click here",
    "subscribe to our newsletter",
    "log in to",
    "sign up for",
    "skip to content",
    "lorem ipsum",
)
ENTRIES = 3  # separators of a navigation line
ENTRY_CHARS = 24  # characters to each of them, at most
SYMBOL_SHARE = 15  # hundredths of the characters of a line
LOSS = 50  # hundredths of the characters in lines
MIN_WORDS = 50
REPEATED = 50  # hundredths of the words


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first included.

    Few texts repeat a window, and those are told apart by a set of fingerprints. In
    the others windows are sorted by a 96-bit fingerprint with their place, so
    equal ones are neighbours; the places found are sorted again, and each adds
    the words that the one before it does not cover.
    """
    last = F.size(words) - 2
    places = F.sequence(F.lit(0), last - 1)
    three = lambda i: (F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    prints = F.transform(places, lambda i: F.xxhash64(*three(i)))
    windows = F.transform(
        places,
        lambda i: F.struct(F.xxhash64(*three(i)).alias("a"), F.hash(*three(i)).alias("b"), i.alias("at")),
    )
    none = (last < 2) | (F.size(F.array_distinct(prints)) == last)
    return F.when(none, F.lit(0)).otherwise(covered(F.sort_array(windows))).cast("long")


def covered(windows: Column) -> Column:
    # The array of one array makes the sorted windows a variable: sorted once.
    return F.get(F.transform(F.array(windows), _covered_of), F.lit(0))


def _covered_of(w: Column) -> Column:
    same = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))
    found = F.filter(w, lambda x, k: same(x, F.get(w, k - 1)) | same(x, F.get(w, k + 1)))
    return F.aggregate(
        F.sort_array(F.transform(found, lambda x: x["at"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("before")),
        lambda acc, x: F.struct(
            (acc["n"] + F.least(F.lit(3), x - acc["before"])).alias("n"), x.alias("before")
        ),
        lambda acc: acc["n"],
    )


def line_fails(line: Column) -> Column:
    # Products of 32-bit counts overflow on very long lines.
    separators = F.regexp_count(line, F.lit(SEPARATED)).cast("long")
    symbols = F.regexp_count(line, F.lit(SYMBOLS)).cast("long")
    chars = F.length(line).cast("long")
    lower = F.lower(line)
    phrase = F.lit(False)
    for p in BOILERPLATE:
        phrase = phrase | F.contains(lower, F.lit(p))
    return (
        ~F.regexp_like(line, F.lit(CLOSED))
        | ((separators >= ENTRIES) & (separators * ENTRY_CHARS >= chars))
        | (symbols * 100 > chars * SYMBOL_SHARE)
        | phrase
    )


def clean_lines(documents: DataFrame) -> DataFrame:
    """doc_id, the figures of the base rules, base_failed, kept and clean_text.

    Null text has no words, fails the base rules and has an empty clean text;
    repeated rows are judged alike, each; an empty table gives no rows. Other
    columns are not read.
    """
    d = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.split("text", "\n").alias("lines"), words_of(F.col("text")).alias("words"))
    d = d.select(
        "doc_id",
        F.filter("lines", lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    # array_distinct keeps the first of equal lines, by a set of hashes.
    d = d.withColumn("first_lines", F.array_distinct("lines"))
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size("first_lines")).cast("long"))
    d = d.withColumn("chars", F.length(F.array_join("lines", "")).cast("long"))
    d = d.withColumn("clean", F.filter("first_lines", lambda x: ~line_fails(x)))
    lost = F.col("chars") - F.length(F.array_join("clean", "")).cast("long")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED)
    return d.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (lost * 100 <= F.col("chars") * LOSS)).alias("kept"),
        F.array_join("clean", "\n").alias("clean_text"),
    )


def op5(documents: DataFrame) -> DataFrame:
    return clean_lines(documents).drop("clean_text")
