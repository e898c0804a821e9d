"""Text columns: normal forms, n-grams, similarity, terms, sentences, signatures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand alone: no letter, mark, digit or underscore of any script on either side.
NEGATION = r"(?<![\p{L}\p{M}\p{N}_])(?:no|not|never|none|without)(?![\p{L}\p{M}\p{N}_])"
HEDGE = r"(?<![\p{L}\p{M}\p{N}_])(?:may|might|maybe|perhaps|possibly|unsure)(?![\p{L}\p{M}\p{N}_])"


def nfkc(text: Column) -> Column:
    """NFKC, by the ICU classes that ship with Spark; null stays null."""
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(True))
    return F.when(text.isNotNull(), composed)


def nfkc_lower(text: Column) -> Column:
    """NFKC and lower case; null stays null."""
    return F.lower(nfkc(text))


def compact(text: Column) -> Column:
    """Without white space, punctuation and symbols."""
    return F.regexp_replace(text, r"[\s\p{P}\p{S}]", "")


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams in order of first occurrence; none for shorter texts."""
    # A capture inside a look-ahead moves on by one character at a time, in one pass over the text.
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def words(text: Column) -> Column:
    """Lower-case words of two ASCII letters or more."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))


def overlap_ratio(query: Column, document: Column) -> Column:
    """Share of the distinct query terms that the document has; 0 without terms."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, document)) / F.size(q)).otherwise(0.0)


def sentences(text: Column) -> Column:
    """Trimmed sentences, each up to its mark or line end."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def polarity(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike(HEDGE), "uncertain").when(low.rlike(NEGATION), "negated").otherwise("affirmed")


def certainty(text: Column) -> Column:
    return F.when(F.lower(text).rlike(HEDGE), 0.55).otherwise(1.0)


def quantities(text: Column, units: Sequence[str]) -> Column:
    """Numbers with a unit, joined by bars."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+(?:\.[0-9]+)? ?(?:" + "|".join(units) + r")\b"), F.lit(0)), "|")


def labels(text: Column, rules: Mapping[str, str]) -> Column:
    """Labels of a rule table whose pattern the text has, in the table's order."""
    return F.filter(F.array(*[F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules.items()]), lambda x: x.isNotNull())


def option_letters(text: Column) -> Column:
    """Distinct letters A to F that stand alone or before a mark, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[^\p{L}\p{N}_])([A-F])(?:[^\p{L}\p{N}_]|$)"), F.lit(1))))
