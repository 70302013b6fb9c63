"""Line splitting and repair of noisy recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from declara import catalog as c
from declara.functions.base import any_word, blank, let, rx, strip

_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"
_DIGIT = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"


def label_lines(text: Column) -> Column:
    """Trimmed non-empty lines of a label text."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda ln: ln != "")


def _replace_all(col: Column, repairs: list[tuple[str, str]], ignore_case: bool) -> Column:
    for pattern, replacement in repairs:
        col = F.regexp_replace(col, rx(pattern, ignore_case), replacement)
    return col


def repair_confusions(line: Column) -> Column:
    return _replace_all(line, c.TEXT_REPAIRS, True)


def repair_digits(line: Column) -> Column:
    """Letters read in place of digits, only where the line looks numeric."""
    numeric = line.rlike(_DIGIT) | any_word(F.lower(line), c.NUMERIC_LINE_WORDS)
    return F.when(numeric, _replace_all(line, c.NUMERIC_REPAIRS, False)).otherwise(line)


def standardize_units(line: Column) -> Column:
    return _replace_all(line, c.UNIT_REPAIRS, True)


def clean_line(line: Column) -> Column:
    """All repairs of one line; blank or NULL input gives the empty string."""
    fixed = let(
        repair_confusions(strip(line)),
        lambda x: let(repair_digits(x), lambda y: strip(F.regexp_replace(standardize_units(y), "[ \t]+", " "))),
    )
    return F.when(blank(line), F.lit("")).otherwise(fixed)


def clean_text(text: Column) -> Column:
    """Repair every non-blank line of a text; line order is kept."""
    lines = F.filter(F.split(text, _LINE_END), lambda ln: strip(ln) != "")
    return F.array_join(F.transform(lines, clean_line), "\n")


def clean_result(raw_text: Column, regions: Column, applied: Column) -> Column:
    """Repair a recognised result: regions first, the raw text only when no region survives.

    Regions whose text vanishes are dropped, unless all vanish.  Returns a struct of raw_text,
    regions and the list of applied steps with the repair marker added once.
    """
    def fold(region: Column) -> Column:
        return F.struct(clean_line(region["text"]).alias("text"), region["confidence"].alias("confidence"),
                        region["bounding_box"].alias("bounding_box"))

    def assemble(kept: Column) -> Column:
        texts = F.transform(kept, lambda r: r["text"])
        original = F.transform(regions, lambda r: F.struct(
            r["text"].alias("text"), r["confidence"].alias("confidence"), r["bounding_box"].alias("bounding_box")))
        return F.struct(
            F.when(F.size(kept) > 0, F.array_join(texts, "\n"))
            .otherwise(F.coalesce(clean_text(raw_text), F.lit(""))).alias("raw_text"),
            F.when(F.size(kept) > 0, kept).otherwise(original).alias("regions"),
            F.when(F.array_contains(applied, c.REPAIR_MARKER), applied)
            .otherwise(F.array_append(applied, c.REPAIR_MARKER)).alias("preprocessing_applied"),
        )

    return let(F.filter(F.transform(regions, fold), lambda r: r["text"] != ""), assemble)
