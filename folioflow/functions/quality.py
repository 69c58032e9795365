"""Text quality metrics as Catalyst expressions. Each metric is a penalty between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp


def _share(count: Column, text: Column) -> Column:
    return F.when(F.length(text) > 0, count / F.length(text)).otherwise(F.lit(1.0))


def upper_ratio(text: Column) -> Column:
    return _share(F.regexp_count(text, F.lit(r"\p{Lu}")), text)


def unprintable_ratio(text: Column) -> Column:
    return _share(F.regexp_count(text, F.lit(r"[\p{Cc}\x{FFFD}]")), text)


def repeated_ratio(text: Column) -> Column:
    """Share of characters in runs of three or more equal ones."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)((.)\2{2,})"), F.lit(1))
    return _share(F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r)), text)


def line_count_metric(lines: Column, chars: Column) -> Column:
    return F.when(chars == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), lines / chars))


def block_confidence(*metrics: Column) -> Column:
    """1 minus the mean penalty; 1 without any."""
    if not metrics:
        return F.lit(1.0)
    return clamp(1 - sum(metrics[1:], metrics[0]) / len(metrics), 0.0, 1.0)


def line_confidence(score: Column, *penalties: Column) -> Column:
    if not penalties:
        return clamp(score, 0.0, 1.0)
    return clamp(score * (1 - sum(penalties[1:], penalties[0]) / len(penalties)), 0.0, 1.0)


def accumulate(lines: Column) -> Column:
    """Join lines: a line ending in a hyphen loses it and meets the next without a space."""
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "-\n", ""), "\n", " ")


def text_lines(text: Column) -> Column:
    """Trimmed non-empty lines of a text."""
    return F.filter(F.transform(F.split(text, "\n"), lambda t: F.trim(t)), lambda t: t != "")


def not_blank(text: Column) -> Column:
    return text.rlike(r"\S")
