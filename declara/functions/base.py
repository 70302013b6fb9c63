"""Small building blocks for native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce, wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character a Unicode-aware trim removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def rx(pattern: str, ignore_case: bool = True) -> str:
    """Java regex with Unicode character classes, like the text the patterns were written for."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def blank(col: Column) -> Column:
    """True for NULL or whitespace only."""
    return F.coalesce(strip(col) == "", F.lit(True))


def filled(col: Column) -> Column:
    """The value, or NULL where it is NULL or the empty string."""
    return F.nullif(col, F.lit(""))


def let(col: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``col`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(col), body), F.lit(0))


def matched(col: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """First match of ``pattern`` (group ``group``), NULL if there is none."""
    return filled(F.regexp_extract(col, rx(pattern, ignore_case), group))


def has(col: Column, pattern: str, ignore_case: bool = True) -> Column:
    return col.rlike(rx(pattern, ignore_case))


def any_word(lower_text: Column, words: Iterable[str]) -> Column:
    """True if the (already lower-cased) text contains one of the words.

    Words that contain another word of the list cannot change the answer and are left out.
    """
    unique = list(dict.fromkeys(words))
    needed = [w for w in unique if not any(o != w and o in w for o in unique)]
    return reduce(lambda a, b: a | b, [lower_text.contains(w) for w in needed])


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def number_text(col: Column) -> Column:
    """A double in plain notation with at least one decimal: 5 -> '5.0'."""
    plain = F.regexp_replace(
        F.regexp_replace(F.round(col, 6).cast("decimal(30,6)").cast("string"), r"0+$", ""), r"\.$", ".0")
    java = col.cast("string")
    return F.when(java.contains("E"), plain).otherwise(java)


def rounded(col: Column | str, digits: int = 0) -> Column:
    """Round half away from zero in double arithmetic, like SQL engines do on doubles."""
    x = F.col(col) if isinstance(col, str) else col
    scale = float(10 ** digits)
    return F.round(x.cast("double") * scale) / scale


def fixed_text(col: Column | str, digits: int) -> Column:
    """A non-negative double with a fixed number of decimals, rounded on its binary value.

    The fraction is split off before scaling, so 41.65 (stored as slightly less) shows as 41.6.
    """
    x = F.col(col) if isinstance(col, str) else col
    scale = 10 ** digits
    whole = F.floor(x)
    part = F.rint((x - whole) * float(scale)).cast("bigint")
    carry = F.when(part == scale, 1).otherwise(0)
    return F.concat((whole + carry).cast("string"), F.lit("."),
                    F.lpad((part - carry * scale).cast("string"), digits, "0"))


def planned_once(build: Callable) -> Callable:
    """Remember the column expressions a function builds, per argument and per JVM.

    Expressions are immutable and hold no data, so plans can share them; building the long ones
    anew for every query costs more than running them on small inputs.
    """
    kept: dict = {}

    @wraps(build)
    def wrapper(*args):
        key = (id(SparkContext._gateway), args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return wrapper


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns whose values are computed once, whatever is done with them later.

    A filter on a projected column is normally moved below it by repeating its expression; with
    expressions as long as a whole extraction, and staged upon each other, that multiplies.  A
    one-element generator stops this, while filters on other columns still reach the files.
    """
    keep = [n for n in df.columns if n not in columns]
    packed = F.struct(*[col.alias(n) for n, col in columns.items()])
    return df.select(*keep, F.explode_outer(F.array(packed)).alias("_settled")).select(*keep, "_settled.*")
