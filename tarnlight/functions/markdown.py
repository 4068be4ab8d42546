"""Content metrics of markdown as native expressions (no Python, no exploding)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode defines it, for Java and RE2 alike.
SPACE = r"\s\p{Z}\x{85}\x1c-\x1f"
WORD = f"[^{SPACE}]+"
HEADING_LINE = r"(?md)^#{1,6}\s.*$"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def syllable_count(text: Column) -> Column:
    """Vowel groups of all words, at least one per word."""
    groups = F.regexp_count(text, F.lit("(?i)[aeiou]+"))
    mute = F.regexp_count(text, F.lit(f"(?<![^{SPACE}])[^{SPACE}aeiouAEIOU]+(?![^{SPACE}])"))
    return groups + mute


def sentence_count(text: Column) -> Column:
    n = F.size(F.filter(F.split(text, "[.!?]+"), lambda s: ~is_blank(s)))
    return F.greatest(F.lit(1), n)


def readability_grade(text: Column) -> Column:
    """Flesch-Kincaid grade, NULL below 30 words."""
    words = word_count(text)
    grade = 0.39 * (words / sentence_count(text)) + 11.8 * (syllable_count(text) / words) - 15.59
    return F.when(words >= 30, F.bround(grade, 1))


def heading_levels(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?md)^(#{1,6})\s"), F.lit(1)), F.length)


def headings_in_order(text: Column) -> Column:
    """True where no heading is more than one level deeper than the heading before it."""
    levels = heading_levels(text)
    pairs = F.arrays_zip(F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))).alias("a"), F.slice(levels, 2, F.size(levels)).alias("b"))
    return F.forall(pairs, lambda p: p["b"] <= p["a"] + 1)


def has_headings(text: Column) -> Column:
    return text.rlike(r"(?md)^#{1,6}\s")


def has_lists(text: Column) -> Column:
    return text.rlike(r"(?md)^[\s]*[-*+]\s")


def has_code(text: Column) -> Column:
    return text.contains("```")


def sections(text: Column) -> Column:
    """Texts between headings that are not blank."""
    return F.filter(F.split(text, HEADING_LINE), lambda s: ~is_blank(s))


def section_words(text: Column) -> Column:
    return F.transform(sections(text), word_count)


def answer_first_ratio(text: Column) -> Column:
    """Share of sections whose first sentence is no question."""

    def states(section: Column) -> Column:
        body = strip(section)
        head = F.regexp_extract(body, r"(?s)^(.*?[.!?])[\s]", 1)
        first = F.when(head == "", body).otherwise(head)
        return ~F.regexp_replace(first, f"[{SPACE}]+$", "").endswith("?")

    parts = sections(text)
    n = F.size(parts)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.bround(F.size(F.filter(parts, states)) / n, 2))


def content_metrics(text: Column) -> dict[str, Column]:
    """All metrics of one markdown text; NULL and empty texts count as empty."""
    t = F.coalesce(text, F.lit(""))
    chunks = section_words(t)
    n = F.size(chunks)
    total = F.aggregate(chunks, F.lit(0), lambda a, w: a + w)
    return {
        "word_count": word_count(t),
        "char_count": F.length(t),
        "has_headings": has_headings(t),
        "has_lists": has_lists(t),
        "has_code_blocks": has_code(t),
        "chunk_count": n,
        "avg_chunk_words": F.when(n == 0, F.lit(0)).otherwise(F.floor(total / n)).cast("int"),
        "chunks_in_sweet_spot": F.size(F.filter(chunks, lambda w: (w >= 50) & (w <= 150))),
        "readability_grade": readability_grade(t),
        "heading_count": F.size(heading_levels(t)),
        "headings_in_order": headings_in_order(t),
        "answer_first_ratio": answer_first_ratio(t),
    }


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def waste_pct(raw_tokens: Column, clean_tokens: Column) -> Column:
    """Share of the raw tokens that cleaning takes away, in percent; negative where the clean text is longer."""
    return F.when(raw_tokens == 0, F.lit(0.0)).otherwise(F.bround((raw_tokens - clean_tokens) / F.nullif(raw_tokens, F.lit(0)) * 100, 1))
