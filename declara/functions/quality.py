"""Explainable quality score of a recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from declara import catalog as c
from declara.functions.base import any_word, has, let, rounded, rx, strip


def _any_pattern(text: Column, patterns: list[str]) -> Column:
    """Whether a value pattern hits; all of them need a digit, which most noise lacks."""
    return text.rlike(r"\p{Nd}") & has(text, "|".join(f"(?:{p})" for p in patterns))


def quality(text: Column, confidence: Column) -> Column:
    """struct(score, confidence_score, keyword_score, pattern_score, density_score), 0 to 100.

    25 points for confidence, 35 for keyword groups hit, 30 for value patterns hit and 10 for the
    share of readable characters and the number of words.
    """
    def measure(raw: Column) -> Column:
        low = F.lower(raw)
        groups = sum((any_word(low, g).cast("int") for g in c.QUALITY_KEYWORD_GROUPS), F.lit(0))
        patterns = sum((_any_pattern(raw, p).cast("int") for p in (
            c.MRP_PATTERNS, c.QUANTITY_PATTERNS, c.DATE_PATTERNS)), F.lit(0))
        readable = F.length(F.regexp_replace(raw, rx(r"[^\p{L}\p{N}\s]+", False), ""))
        words = F.regexp_count(raw, F.lit(rx(r"\S+", False)))
        density = readable / F.length(raw).cast("double")
        return let(F.struct(
            (confidence.cast("double") * 25.0).alias("conf"),
            (groups / F.lit(6.0) * 35.0).alias("key"),
            (patterns / F.lit(3.0) * 30.0).alias("pat"),
            ((density * 0.6 + F.least(F.lit(1.0), words / F.lit(8.0)) * 0.4) * 10.0).alias("dens"),
        ), lambda m: F.struct(
            rounded(m["conf"] + m["key"] + m["pat"] + m["dens"], 2).alias("score"),
            rounded(m["conf"], 2).alias("confidence_score"), rounded(m["key"], 2).alias("keyword_score"),
            rounded(m["pat"], 2).alias("pattern_score"), rounded(m["dens"], 2).alias("density_score")))

    zero = F.struct(*[F.lit(0.0).alias(n) for n in (
        "score", "confidence_score", "keyword_score", "pattern_score", "density_score")])
    return let(strip(text), lambda raw: F.when(F.length(raw) < 3, zero).otherwise(measure(raw)))
