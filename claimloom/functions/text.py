"""Column functions over message text.

Offsets count code points, as Spark's length/substring do.  Java's ``\\s`` is
ASCII only, so whitespace is always spelled out as an explicit class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, running_sum
from .constants import (
    MONTH_MARKS,
    STOP_WORDS,
    TIME_MARKS,
    URGENCY_KEYWORDS,
)

SPACE = r"[\t-\r\x1c-\x1f\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x1f\x85\p{Z}]"
TRIM = f"^{SPACE}+|{SPACE}+$"
PUNCTUATION = r"[^\p{L}\p{N}_\t-\r\x1c-\x1f\x85\p{Z}]"
ALPHANUMERIC = r"[\p{L}\p{N}]"

# Patterns of the rule-based tagger; the same strings run in RE2 and Java.
ENTITY_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "URL": r"(https?://|www\.)[^\t-\r\p{Z}<>\x22']+",
    "PHONE": r"\+?([0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "AMOUNT": r"[$£€¥] ?[0-9][0-9,]*(\.[0-9]{1,2})?",
    "DATE": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}",
    "ACCOUNT": r"[0-9]{8,17}",
}


def strip(text: Column) -> Column:
    """Remove all leading and trailing whitespace, not only blanks."""
    return F.regexp_replace(text, F.lit(TRIM), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_SPACE}+"))


def words(text: Column) -> Column:
    """array<string>: the whitespace-separated words."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_SPACE}+"), F.lit(0))


def word_starts(text: Column) -> Column:
    """array<int>: the start offset of each word.

    A word starts after all earlier words and gaps, plus its own gap.
    """

    def build(gaps: Column) -> Column:
        lengths = F.transform(words(text), F.length)
        steps = F.zip_with(gaps, lengths, lambda g, n: g + F.coalesce(n, F.lit(0)))
        starts = F.zip_with(running_sum(steps), gaps, lambda before, g: before + g)
        return F.slice(starts, F.lit(1), F.size(gaps) - 1)

    return let(F.transform(F.split(text, f"{NOT_SPACE}+", -1), F.length), build)


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``w`` (words) and ``ws`` (their start offsets) as parallel arrays."""
    return df.withColumns({"w": words(F.col(text)), "ws": word_starts(F.col(text))})


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] for 0 <= start; an end before start gives ''."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def fingerprint(text: Column) -> Column:
    """MD5 of the lower-cased text without punctuation, whitespace collapsed."""
    bare = F.regexp_replace(F.lower(text), F.lit(PUNCTUATION), F.lit(""))
    return F.md5(strip(F.regexp_replace(bare, F.lit(f"{SPACE}+"), F.lit(" "))))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def length_bucket(text: Column) -> Column:
    n = F.length(text)
    return F.when(n < 50, "short").when(n <= 160, "normal").otherwise("long")


def good_span(text: Column, confidence: Column, threshold: float = 0.5) -> Column:
    """True for spans worth keeping: confident, long enough, not a stop word."""
    bare = strip(text)
    return (
        (confidence >= threshold)
        & (F.length(bare) >= 3)
        & ~F.lower(bare).isin(STOP_WORDS)
        & bare.rlike(ALPHANUMERIC)
    )


def strip_device_metadata(text: Column) -> Column:
    """Drop screenshot header lines, join the rest with blanks.

    A line goes when it starts with '<' or '+', names a text message, or
    holds both a month mark and a time mark.
    """

    def any_of(line: Column, marks: list[str]) -> Column:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | F.contains(line, F.lit(mark))
        return hit

    def keep(line: Column) -> Column:
        return ~(
            F.startswith(line, F.lit("<"))
            | F.startswith(line, F.lit("+"))
            | F.contains(line, F.lit("Text Message"))
            | (any_of(line, MONTH_MARKS) & any_of(line, TIME_MARKS))
        ) & (line != "")

    lines = F.transform(F.split(text, "\n", -1), strip)
    return F.array_join(F.filter(lines, keep), " ")


def urgency_keyword(text: Column) -> Column:
    """The first listed keyword that occurs anywhere in the text, else NULL."""
    low = F.lower(text)
    return F.coalesce(
        *[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in URGENCY_KEYWORDS]
    )


def pattern_matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of every match, in order.

    Offsets come from the pieces between matches, so they stay code-point
    based and exact even when a match's text also occurs elsewhere.
    """

    def build(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        steps = F.zip_with(gaps, F.transform(found, F.length), lambda g, m: g + F.coalesce(m, F.lit(0)))
        return let(
            gaps,
            lambda gap: let(
                running_sum(steps),
                lambda off: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(off, i) + F.get(gap, i)).alias("start"),
                        (F.get(off, i) + F.get(gap, i) + F.length(m)).alias("end"),
                        m.alias("text"),
                    ),
                ),
            ),
        )

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)
