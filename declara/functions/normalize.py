"""Normal forms of prices, quantities, dates, countries, and the product-code test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from declara import catalog as c
from declara.functions.base import has, let, matched, rx, strip


def short_number(x: Column) -> Column:
    """Six significant digits without trailing zeros, exponent form outside 1e-4 .. 1e6."""
    def shape(sci: Column) -> Column:
        rounded = sci.cast("double")
        plain = F.regexp_replace(rounded.cast("decimal(20,10)").cast("string"), r"\.?0+$", "")
        exponent = F.regexp_replace(sci, r"\.?0+e", "e")
        small = F.abs(rounded) < 1e6
        tiny = (rounded != 0) & (F.abs(rounded) < 1e-4)
        return F.when(small & ~tiny, plain).otherwise(exponent)

    return let(F.format_string("%.5e", x), shape)


def price(raw: Column) -> Column:
    """struct(value, amount): '₹n[.nn][ incl. of all taxes]'; the cleaned text if no number is found."""
    cleaned = strip(raw)

    def shape(num: Column) -> Column:
        return let(F.regexp_replace(num, ",", "").cast("double"), lambda amount: worded(num, amount))

    def worded(num: Column, amount: Column) -> Column:
        shown = F.when(num.contains("."), F.format_string("%.2f", amount)).otherwise(
            amount.cast("decimal(30,0)").cast("string"))
        tax = F.when(has(cleaned, "incl"), F.lit(" incl. of all taxes")).otherwise(F.lit(""))
        return F.struct(
            F.when(num.isNull(), cleaned).otherwise(F.concat(F.lit("₹"), shown, tax)).alias("value"),
            amount.alias("amount"),
        )

    return let(matched(cleaned, c.MRP_AMOUNT, 1, ignore_case=False), shape)


def quantity(raw: Column) -> Column:
    """struct(value, amount, unit); the unit is kept as printed, also when it is not a legal one."""
    cleaned = strip(raw)
    parts = F.struct(matched(cleaned, c.QUANTITY_PARTS, 1, False).alias("num"),
                     matched(cleaned, c.QUANTITY_PARTS, 2, False).alias("unit"))

    def shape(p: Column) -> Column:
        return let(p["num"].cast("double"), lambda amount: F.struct(
            F.when(p["num"].isNull(), cleaned).otherwise(
                F.concat(short_number(amount), F.lit(" "), p["unit"])).alias("value"),
            amount.alias("amount"), p["unit"].alias("unit"),
        ))

    return let(parts, shape)


_MONTH_NUMBER = [(name, f"{i:02d}") for i, name in enumerate(c.MONTHS, 1)]


def _month_number(word: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, number in _MONTH_NUMBER:
        out = F.when(word.isin(name, name[:3]), number).otherwise(out)
    return out


def label_date(raw: Column) -> Column:
    """'MM/YYYY' from a numeric or a worded month; otherwise the text with '-' as separator."""
    bare = strip(F.regexp_replace(strip(raw), rx(c.DATE_PREFIX), ""))
    dashed = F.regexp_replace(bare, rx(r"[\-\/\.\s]+", False), "-")

    def year(text: Column, pattern: str) -> Column:
        return let(matched(text, pattern, 2, False), lambda found: F.when(
            F.length(found) == 2, F.concat(F.lit("20"), found)).otherwise(found))

    def shape(text: Column) -> Column:
        numeric = r"^(0?[1-9]|1[0-2])-(20\d{2}|\d{2})$"
        worded = r"^([a-zA-Z]+)-(20\d{2}|\d{2})$"
        by_number = F.concat(F.lpad(matched(text, numeric, 1, False), 2, "0"), F.lit("/"), year(text, numeric))
        by_word = F.concat(let(F.lower(matched(text, worded, 1, False)), _month_number), F.lit("/"), year(text, worded))
        return F.coalesce(by_number, by_word, text)

    return let(dashed, shape)


def country(raw: Column) -> Column:
    """Country name without its label or trailing punctuation; title case, short codes upper case."""
    bare = F.regexp_replace(strip(F.regexp_replace(strip(raw), rx(c.ORIGIN_PREFIX), "")), r"[.,;:\- ]+$", "")
    return let(bare, lambda x: F.when(F.length(x) > 2, F.initcap(x)).otherwise(F.upper(x)))


def is_code(text: Column) -> Column:
    """True if a text looks like a product or batch code rather than a name."""
    def test(s: Column) -> Column:
        digits = F.length(F.regexp_replace(s, r"\P{Nd}", ""))
        letters = F.length(F.regexp_replace(s, r"\P{L}", ""))
        return (digits > 0) & ((letters == 0) | (F.length(s) < 4) | (digits >= letters))

    return F.when(text.rlike(r"\p{Nd}"), let(strip(text), test)).otherwise(False)


def is_home_country(text: Column) -> Column:
    return F.lower(text).isin(c.HOME_COUNTRY_NAMES)
