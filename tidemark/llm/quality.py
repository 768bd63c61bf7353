"""Line-first quality rules: lines are judged first, then what is left of the document.

Every line that holds a word passes three rules or goes:

- punctuation: runs of ``!`` or ``?`` are at most a fifth as many as its words, symbols make
  up at most a tenth of it, and a line of ``min_line_words`` words or more holds a stop;
- navigation: it is no row of links, that is of short pieces set apart by separators;
- boilerplate: a line of at most ``FURNITURE_WORDS`` words holds no phrase of site furniture
  (cookies, log-ins, rights reserved).

A document is kept unless it fails the base rules (too few words, too many of them in
repeated windows) or its failing lines hold more than ``max_lost_percent`` of its words.

Only DataFrame functions are used and no row leaves its task, so there is no shuffle and no
key that could be hot. Work grows with the length of a text, whatever it repeats.

Null and empty texts have no words: all counts are 0 and they fail the base rules. Repeated
rows and repeated ids are judged row by row. Extra columns are kept; result columns replace
columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bind, fresh, text_of

# The white space that parts words, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# What ends a sentence or a clause, in several scripts.
STOPS = r"[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}\x{061F}\x{06D4}\x{0964}]"
SHOUTS = r"[!?]{2,}"
SEPARATORS = r"[|>\xB7\xBB]"

# Phrases of site furniture, in lower case.
BOILERPLATE = (
    "accept all cookies|we use cookies|cookie policy|privacy policy|terms of use"
    "|terms of service|all rights reserved|enable javascript|javascript is disabled"
    "|click here to|subscribe to our|sign up for our|log in to continue|skip to content"
    "|back to top|lorem ipsum|share this article|powered by wordpress"
)

FURNITURE_WORDS = 30
WINDOW = 8


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def repeated_words(words: Column) -> Column:
    """Words covered by windows of eight words that are found twice or more in the array."""
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    return bind(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)),
    )


def _covered(hashes: Column) -> Column:
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(sorted_pairs: Column) -> Column:
        def repeats(pair: Column, at: Column) -> Column:
            before, after = F.get(sorted_pairs, at - 1)["h"], F.get(sorted_pairs, at + 1)["h"]
            twin = F.coalesce(before == pair["h"], F.lit(False)) | F.coalesce(
                after == pair["h"], F.lit(False)
            )
            return F.when(twin, pair["i"])

        return F.array_sort(F.array_compact(F.transform(sorted_pairs, repeats)))

    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    return bind(
        placed,
        lambda pairs: F.aggregate(
            starts(pairs),
            zero,
            lambda done, start: F.struct(
                (start + WINDOW).alias("end"),
                (done["total"] + start + WINDOW - F.greatest(start, done["end"])).alias("total"),
            ),
            lambda done: done["total"],
        ),
    )


def line_fails(line: Column, min_line_words: int) -> Column:
    """Whether a line that holds a word breaks one of the three rules."""
    has_word = line.rlike(NOT_SPACE)

    def judged(n_words: Column) -> Column:
        symbols = 10 * count(line, SYMBOLS) > F.length(line)
        shouting = 5 * count(line, SHOUTS) > n_words
        unstopped = (n_words >= min_line_words) & ~line.rlike(STOPS)
        navigation = bind(
            count(line, SEPARATORS), lambda marks: (marks >= 2) & (4 * marks >= n_words)
        )
        furniture = (n_words <= FURNITURE_WORDS) & F.lower(line).rlike(BOILERPLATE)
        return symbols | shouting | unstopped | navigation | furniture

    return has_word & bind(count(line, NOT_SPACE + "+"), judged)


def judge(
    docs: DataFrame,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_lost_percent: int = 50,
    min_line_words: int = 5,
    text: str = "text",
) -> DataFrame:
    """``docs`` with the counts of the base rules, the verdict and ``clean_text``."""

    def by_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
        )

    def by_lines(lines: Column) -> Column:
        with_words = F.filter(lines, lambda line: line.rlike(NOT_SPACE))
        tagged = F.transform(
            lines,
            lambda line: F.struct(
                line.alias("line"), line_fails(line, min_line_words).alias("fails")
            ),
        )
        return F.struct(
            bind(with_words, lambda a: F.size(a) - F.size(F.array_distinct(a)))
            .cast("long")
            .alias("n_dup_lines"),
            bind(
                tagged,
                lambda pairs: bind(
                    F.filter(pairs, lambda pair: pair["fails"]),
                    lambda bad: F.struct(
                        F.size(bad).cast("long").alias("n_failed_lines"),
                        count(F.array_join(bad["line"], "\n"), NOT_SPACE + "+")
                        .cast("long")
                        .alias("lost_words"),
                        F.array_join(F.filter(pairs, lambda pair: ~pair["fails"])["line"], "\n")
                        .alias("clean_text"),
                    ),
                ),
            ).alias("lines"),
        )

    whole = text_of(text)
    of_words, of_lines = fresh(docs, "_words"), fresh(docs, "_lines")
    counted = docs.withColumns(
        {
            of_words: bind(words_of(whole), by_words),
            of_lines: bind(F.split(whole, "\n"), by_lines),
            "n_symbols": count(whole, SYMBOLS).cast("long"),
        }
    )
    found = counted.withColumns(
        {
            "n_words": F.col(f"{of_words}.n_words"),
            "word_chars": F.col(f"{of_words}.word_chars"),
            "n_dup_lines": F.col(f"{of_lines}.n_dup_lines"),
            "n_repeat_words": F.col(f"{of_words}.n_repeat_words"),
            "n_failed_lines": F.col(f"{of_lines}.lines.n_failed_lines"),
            "lost_words": F.col(f"{of_lines}.lines.lost_words"),
            "clean_text": F.col(f"{of_lines}.lines.clean_text"),
        }
    ).drop(of_words, of_lines)
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    lost = 100 * F.col("lost_words") > max_lost_percent * F.col("n_words")
    return found.withColumns({"base_failed": failed, "kept": ~failed & ~lost})
