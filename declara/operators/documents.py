"""Metadata of legal documents from their file name and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara import catalog as c
from declara.functions.base import any_word, has, let, matched, rx, strip

DEVANAGARI = r"[\x{0900}-\x{097F}]"


def has_devanagari(text: Column) -> Column:
    return F.coalesce(text.rlike(DEVANAGARI), F.lit(False))


def language(text: Column) -> Column:
    """Hindi above 20 Devanagari characters, bilingual if more than 50 Latin letters join them."""
    hindi = F.length(F.regexp_replace(text, r"[^\x{0900}-\x{097F}]+", "")) > 20
    latin = F.length(F.regexp_replace(text, "[^a-zA-Z]+", "")) > 50
    return F.when(hindi & latin, "Bilingual (Hindi-English)").when(hindi, "Hindi").otherwise("English")


def document_type(filename: Column, text: Column) -> Column:
    name, body = F.lower(filename), F.lower(text)
    out = F.lit(c.DEFAULT_DOCUMENT_TYPE)
    for kind, in_name, in_text in reversed(c.DOCUMENT_TYPES):
        out = F.when(any_word(name, in_name) | any_word(body, in_text), kind).otherwise(out)
    return out


def document_date(filename: Column, text: Column) -> Column:
    """Full date in the file name, a 'dated' date in the text, a year in the name, or the default."""
    full = matched(filename, r"(\d{4}[\.\-_]\d{1,2}[\.\-_]\d{1,2}|\d{1,2}[\.\-_]\d{1,2}[\.\-_]\d{4})", 1, False)
    dated = matched(text, r"(?:dated|date)[:\s]+(\d{1,2}[\.\/\-]\d{1,2}[\.\/\-]20\d{2})", 1)
    year = matched(filename, r"(20\d{2})", 1, False)
    return F.coalesce(F.translate(full, "_-", ".."), dated, year, F.lit(c.DEFAULT_DOCUMENT_DATE))


def key_topics(filename: Column, text: Column) -> Column:
    combined = F.lower(F.concat(filename, F.lit(" "), text))
    hits = let(combined, lambda t: F.array_compact(F.array(*[
        F.when(any_word(t, words), F.lit(topic)) for topic, words in c.TOPICS])))
    return let(hits, lambda h: F.when(F.size(h) > 0, h).otherwise(F.array(F.lit(c.DEFAULT_TOPIC))))


def file_stem(filename: Column) -> Column:
    """File name without folder and last extension."""
    base = F.regexp_replace(filename, r"^.*/", "")
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def title(filename: Column, text: Column) -> Column:
    """Subject line or the cleaned file name."""
    subject = strip(F.regexp_extract(text, rx(r"Subject[:\s]+([^\n\r]+)"), 1))
    stem = F.regexp_replace(file_stem(filename), rx(r"_\d{8,12}$", False), "")
    cleaned = strip(F.translate(stem, "_-", "  "))
    return let(subject, lambda s: F.when(F.length(s) > 10, s).otherwise(cleaned))


def document_index(documents: DataFrame) -> DataFrame:
    """Index record of every document (filename, text), row by row."""
    name, text = F.col("filename"), F.col("text")
    return documents.withColumns({
        "title": title(name, text), "date": document_date(name, text), "document_type": document_type(name, text),
        "language": language(text), "key_topics": key_topics(name, text), "char_count": F.length(text)})
