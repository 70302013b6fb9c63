"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust (DataFrame functions only).

Base kinds, always reported: ``email``, ``ip``, ``card`` (16 to 19 digits, Luhn), ``phone`` (+ and 8 to 15
digits).  Added kinds, reported when their score reaches ``accept``: ``iban`` (mod-97), ``pan`` (13 to 15 digits,
Luhn, card words nearby), ``ssn`` (three groups of digits, identity words nearby).

All matches of a pattern and the pieces of text between them come from one left-to-right search each, so
positions are running sums of lengths; every step is linear in the text.  The patterns are possessive and start
only where a run of their first characters starts (or where the last match ended), which finds the same matches
as the plain patterns without trying a long run again from each of its characters.

Defined results: null text is empty; positions count code points, ends are exclusive; repeated rows and null
ids are kept as they are; an empty table gives no rows.  No shuffle, no state across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara.llm.common import running_starts, settled

# Patterns, and a cheap test that a text can hold a match at all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
HINTS = {
    "email": r"@[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){12}",
    "phone": r"\+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Score before looking around, after the checksum of the kind has held.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "pan": 0.3, "ssn": 0.3}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)",
    "ip": r"(?i)\b(?:ip|address|host|server|client)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|payment)",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|whatsapp)",
    "iban": r"(?i)\b(?:iban|bank|account|transfer|konto)",
    "pan": r"(?i)\b(?:card|visa|amex|american express|credit|debit|payment)",
    "ssn": r"(?i)\b(?:ssn|social security|tax id|identity)",
}
#: A version number or a measure is not an address: words that speak against a span.
AGAINST = {"ip": r"(?i)\b(?:version|v|release|section)\W*$", "card": r"(?i)\b(?:isbn|order|invoice|serial)\W*$"}
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "pan", "ssn"]


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a text of digits holds."""
    backwards = F.reverse(digits)

    def term(i: Column) -> Column:
        digit = backwards.substr(i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, 2 * digit - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code, first four characters moved to the end and letters as 10 to 35, leaves 1."""
    moved = F.concat(code.substr(F.lit(5), F.length(code)), code.substr(1, 4))

    def step(rest: Column, i: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), moved.substr(i, F.lit(1))) - 1
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), step) == 1


def _checks(kind: str, match: Column) -> Column:
    digits = digits_of(match)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "pan":
        return F.length(digits).between(13, 15) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "iban":
        code = F.replace(match, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & mod97(code)
    return F.lit(True)


def _score(kind: str, text: Column, start: Column, end: Column) -> Column:
    """Prior of the kind, plus 0.2 for a context word within 48 characters before or 24 after, less 0.3 for one against."""
    before = text.substr(F.greatest(start - 47, F.lit(1)).cast("int"), F.least(start, F.lit(48)).cast("int"))
    after = text.substr((end + 1).cast("int"), F.lit(24))
    score = F.lit(PRIOR[kind]) + F.when(before.rlike(CONTEXT[kind]) | after.rlike(CONTEXT[kind]), 0.2).otherwise(0.0)
    if kind in AGAINST:
        score = score - F.when(before.rlike(AGAINST[kind]), 0.3).otherwise(0.0)
    return F.round(score, 2)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5,
                       keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and ``spans``: kind, start, end, score of each, by kind as in ``KINDS``, then start.

    ``keep`` names further columns of ``docs`` to carry along.
    """
    text = F.col("_text")
    found = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(id_col).alias("_id"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    none = F.array().cast("array<string>")
    found = settled(found, **{
        name: part for kind, pattern in PATTERNS.items() for hint in [text.rlike(HINTS[kind])] for name, part in (
            (f"_{kind}_found", F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)),
            (f"_{kind}_gaps", F.when(hint, F.split(text, pattern, -1)).otherwise(none)))})

    def starts(kind: str) -> Column:
        hits, gaps = F.col(f"_{kind}_found"), F.col(f"_{kind}_gaps")
        steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.length(g) + F.length(h)).cast("long"))
        return F.when(F.size(hits) > 0, F.zip_with(
            F.slice(running_starts(steps), 1, F.size(hits)), F.slice(gaps, 1, F.size(hits)), lambda s, g: s + F.length(g)))

    found = settled(found, **{f"_{kind}_starts": starts(kind) for kind in PATTERNS})

    def spans(kind: str) -> Column:
        source = "card" if kind == "pan" else kind
        hits, begin = F.col(f"_{source}_found"), F.col(f"_{source}_starts")
        placed = F.zip_with(hits, begin, lambda h, s: F.struct(
            F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(h)).alias("end"), h.alias("match")))
        placed = F.filter(placed, lambda p: _checks(kind, p["match"]))
        scored = F.transform(placed, lambda p: F.struct(
            p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end"),
            _score(kind, text, p["start"], p["end"]).alias("score")))
        scored = scored if kind in BASE else F.filter(scored, lambda p: p["score"] >= accept)
        return F.when(F.size(hits) > 0, scored).otherwise(
            F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))

    found = settled(found, spans=F.concat(*[spans(kind) for kind in KINDS]))
    return found.select(*[F.col(f"`{c}`") for c in keep], F.col("_id").alias("doc_id"), text.alias("text"), "spans")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets; ``n_chars``, where there, is renewed.

    Spans that touch each other's characters are replaced together under the name of the first.  Null texts
    stay null, texts without spans stay as they are.
    """
    others = [c for c in docs.columns if c != "text"]
    hidden = docs.withColumnsRenamed({c: f"_in_{i}" for i, c in enumerate(others)}).withColumn("_null", F.col("text").isNull())
    kept = [f"_in_{i}" for i in range(len(others))]
    found = find_personal_data(hidden.withColumn("_row", F.lit(0)), "_row", "text", accept, keep=(*kept, "_null"))
    ordered = F.array_sort(F.transform(F.col("spans"), lambda s: F.struct(
        s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["kind"].alias("kind"))))
    text = F.col("text")
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(
            acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    clean = F.when(F.size("spans") > 0, F.aggregate(ordered, first, step, lambda acc: F.concat(
        acc["out"], text.substr(acc["at"] + 1, F.length(text))))).otherwise(text)
    out = settled(found, _clean=F.when(~F.col("_null"), clean))
    back = {c: F.col(f"_in_{i}").alias(c) for i, c in enumerate(others)}
    if "n_chars" in back:
        i = others.index("n_chars")
        back["n_chars"] = F.when(F.size("spans") > 0, F.length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(
            F.col(f"_in_{i}")).alias("n_chars")
    return out.select(*[F.col("_clean").alias("text") if c == "text" else back[c] for c in docs.columns])
