r"""Line-first quality rules, in DataFrame functions only.

Each line with a word is judged by itself:
- punctuation: more than 30 % of its characters other than white space are neither letters nor digits,
  or it has 3 or more words, over half of which end with two or more of ``!?#$%&*``;
- navigation: two or more of ``| » › • ·`` stand alone between its words, at most three words for each;
- boilerplate: it holds a fixed phrase of page furniture (listed below).
Lines that fail are removed; a document is rejected that loses over half of its words to them.
The base rules (few words, repeated five-word windows) reject before that.

Counts are of whole texts: words are runs other than ASCII white space; a repeated window is found by
its 64-bit hash among the text's own windows. Nothing is shuffled and nothing leaves the JVM.

Edge cases: null, empty and blank texts have no words and are rejected by the base rule of few words;
repeated rows each give a row; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.llm.common import let

WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT, MOST_LOST_PERCENT = 5, 10, 20, 50
SPACE = "[\\x20\\x09-\\x0D]+"
BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
ODD = "[^\\p{L}\\p{M}\\p{N}\\x20\\x09-\\x0D]"
BARS = ["|", "»", "›", "•", "·"]
SHOUTED = "[!?#$%&*]{2}\\z"
#: Phrases of page furniture, in lower case.
BOILERPLATE = ["all rights reserved", "accept all cookies", "enable javascript", "click here to", "terms of use", "terms of service", "privacy policy", "subscribe to our newsletter", "skip to main content", "lorem ipsum"]


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANK))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))


def n_repeat_words(own: Column, window: int = WINDOW) -> Column:
    """Words inside a window that occurs twice or more in the same text, the first occurrence included."""

    def of_windows(hashes: Column) -> Column:
        # Places of repeated windows, in order: neighbours with equal hashes once sorted by hash and place.
        places = let(
            F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < F.size(s) - 1) & (F.get(s, i + 1)["h"] == x["h"]))),
                    lambda x: x["i"],
                )
            ),
        )
        # Each place adds the words up to the next one's start, a window at most.
        covered = let(places, lambda p: F.aggregate(F.transform(p, lambda at, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - at, F.lit(window)))), F.lit(0).cast("long"), lambda n, x: n + x))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)

    hashes = F.transform(F.sequence(F.lit(0), F.size(own) - window), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(window)]))
    return F.when(F.size(own) <= window, F.lit(0).cast("long")).otherwise(let(hashes, of_windows))


def judged(line: Column) -> Column:
    """A line with its number of words and whether it fails one of the rules."""

    def verdict(x: Column) -> Column:
        # Words are looked at only where the count of odd characters allows a failure.
        n, odd = F.size(x["w"]), x["odd"]
        punctuation = (odd * 100 > F.length(F.array_join(x["w"], "")) * 30) | ((n >= 3) & (odd >= n) & (F.size(F.filter(x["w"], lambda w: w.rlike(SHOUTED))) * 2 > n))
        navigation = (odd >= 2) & (4 * odd + 3 >= n) & let(F.size(F.filter(x["w"], lambda w: w.isin(*BARS))), lambda bars: (bars >= 2) & (n - bars <= 3 * (bars + 1)))
        boilerplate = let(F.lower(line), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))
        return F.struct(line.alias("line"), n.alias("n"), (punctuation | navigation | boilerplate).alias("fails"))

    return let(F.struct(words(line).alias("w"), F.regexp_count(line, F.lit(ODD)).alias("odd")), verdict)


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost_percent: int = MOST_LOST_PERCENT) -> DataFrame:
    """doc_id, the base counts, n_lost_words, cleaned_text (the lines that passed), base_failed and kept, for every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def measured(lines: Column) -> Column:
        return let(
            F.transform(lines, judged),
            lambda own: F.struct(
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                F.aggregate(own, F.lit(0).cast("long"), lambda n, x: n + F.when(x["fails"], x["n"]).otherwise(0)).alias("n_lost_words"),
                F.array_join(F.transform(F.filter(own, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned_text"),
            ),
        )

    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANK))) > 0)
    out = own.select(
        "doc_id",
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), n_repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, measured).alias("m"),
    ).select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "m.n_dup_lines", "w.n_repeat_words", "m.n_lost_words", "m.cleaned_text")
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("kept", ~base & (100 * F.col("n_lost_words") <= most_lost_percent * F.col("n_words")))
