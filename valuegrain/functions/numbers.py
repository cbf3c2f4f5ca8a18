"""Columns that read numbers and dates out of one line of text.

A line's matches and the gaps between them (``split`` by the same pattern) give every token its left and
right context, so all rules are column expressions over one array; nothing is exploded before the values.
Dates are masked first: their digits become letters, but for the last run where a number goes on from it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuegrain.functions.values import try_cast

#: What counts as a date, a number and a currency sign.
DATE = r"(?U)\b(\d{4}-\d{2}-\d{2}(?:[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})?)?)\b"
NUMBER = r"(?U)\d[\d.,]*(?:[eE][+-]?\d+)?"
CURRENCY = "$€£¥"
#: Units that may follow a number without a blank.
UNIT_SUFFIXES = (
    "s", "ms", "us", "ns", "m", "min", "mins", "h", "hr", "hrs", "d", "w", "wk", "wks", "y", "yr", "yrs",
    "g", "kg", "mg", "ug", "lb", "lbs", "oz", "km", "cm", "mm", "um", "nm", "mi", "ft", "in", "yd", "l", "ml",
    "b", "kb", "mb", "gb", "tb", "pb", "kib", "mib", "gib", "tib", "hz", "khz", "mhz", "ghz",
    "px", "pt", "em", "rem", "vw", "vh", "v", "kv", "mv", "kw", "mw", "ma", "c", "k",
)
US_SHAPE, EU_SHAPE = r"^[0-9]{1,3}(,[0-9]{3})+\.[0-9]+$", r"^[0-9]{1,3}(\.[0-9]{3})+,[0-9]+$"
WORD = r"[\p{IsAlphabetic}\p{N}_]"


def dates(line: Column) -> Column:
    """Date texts of a line, in order."""
    return F.regexp_extract_all(line, F.lit(DATE), F.lit(1))


def date_value(text: Column) -> Column:
    """UTC timestamp of a date text; null for a day or time that doesn't exist. Without a zone it is UTC."""
    up = F.upper(text)
    zoned = F.when(up.rlike("(Z|[+-][0-9]{2}:[0-9]{2})$") & up.contains("T"), up).when(up.contains("T"), F.concat(up, F.lit("Z"))).otherwise(F.concat(up, F.lit("T00:00:00Z")))
    return F.try_to_timestamp(F.regexp_replace(zoned, r"(\.[0-9]{6})[0-9]+", "$1"))


def masked(line: Column) -> Column:
    """The line with its dates' digits replaced; a last run of digits that goes on as a number stays."""
    last = r"(?U)\b\d{4}-\d{2}-(?:\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?[+-]\d{2}:|\d{2}[Tt]\d{2}:\d{2}:)?(\d{2}(?:\.\d+)?)(?=[.,]\d)"
    whole = DATE + r"(?![.,]\d)"
    return F.regexp_replace(F.regexp_replace(line, whole, "DDDD-DD-DD"), last, "DDDD-DD-$1")


def shaped(text: Column) -> Column:
    """``us`` or ``eu`` by the first number of a text with both separators that fits one of them; else null."""
    fits = F.filter(F.regexp_extract_all(text, F.lit(r"(?U)\d[\d.,]*\d"), F.lit(0)), lambda m: m.rlike(US_SHAPE) | m.rlike(EU_SHAPE))
    return F.when(F.get(fits, F.lit(0)).rlike(EU_SHAPE), F.lit("eu")).when(F.size(fits) > 0, F.lit("us"))


def auto_format(content: Column) -> Column:
    """The format that a text's numbers tell; ``us`` if they tell none."""
    return F.coalesce(shaped(content), F.lit("us"))


def tokens(line: Column) -> Column:
    """Array of (raw, left, right): each number's text without trailing separators, and what stands beside it."""
    found = F.regexp_extract_all(line, F.lit(NUMBER), F.lit(0))
    gaps = F.split(line, NUMBER, -1)

    def token(i: Column) -> Column:
        raw = F.regexp_replace(F.get(found, i), "[.,]+$", "")
        tail = F.substring(F.get(found, i), F.char_length(raw) + 1, F.lit(1 << 30))
        left = F.concat(F.right(F.coalesce(F.get(found, i - 1), F.lit("")), F.lit(1)), F.get(gaps, i))
        right = F.concat(tail, F.coalesce(F.get(gaps, i + 1), F.lit("")), F.coalesce(F.get(found, i + 1), F.lit("")))
        return F.struct(raw.alias("raw"), left.alias("left"), right.alias("right"))

    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), F.size(found) - 1), token)).otherwise(F.array().cast("array<struct<raw:string,left:string,right:string>>"))


def admitted(t: Column) -> Column:
    """Not a part of a word, hash or ordinal; a unit may follow."""
    in_word = t["left"].rlike(f"{WORD}$")
    word_after = F.regexp_extract(t["right"], f"^{WORD}+", 0)
    exponent = t["raw"].rlike("[eE]")
    unit = F.lower(word_after).isin(*UNIT_SUFFIXES) & word_after.rlike("^[A-Za-z]+$")
    hex_part = exponent & ~t["raw"].contains(".") & t["left"].rlike("[A-Za-z0-9_]-$")
    return ~in_word & ((word_after == "") | (unit & ~exponent)) & ~hex_part


def number(text: Column, negative: Column) -> Column:
    """A finite double, signed, without a negative zero; null otherwise."""
    x = try_cast(F.when(text.rlike(r"^[0-9]*\.?[0-9]*([eE][+-]?[0-9]+)?$") & text.rlike("[0-9]"), text), "double")
    signed = F.when(negative, -x).otherwise(x)
    return F.when(F.abs(x) < float("inf"), F.when(x == 0, F.lit(0.0)).otherwise(signed))


def values(t: Column, eu: Column, blanks: Column) -> Column:
    """Array of doubles that a token stands for; an array of one null if it is malformed."""
    raw = t["raw"]
    bare = F.regexp_replace(t["left"], f"[{CURRENCY}]$", "")
    before = F.regexp_replace(bare, r"[-+(]+$", "")
    run = F.substring(bare, F.char_length(before) + 1, F.lit(1 << 30))
    currency = t["left"].rlike(f"[{CURRENCY}]$") | before.rlike(f"[{CURRENCY}]$")
    sign = F.when(before.rlike(f"{WORD}$") | (F.regexp_count(run, F.lit("-")) >= 2), F.lit("")).otherwise(run)
    negative = sign.startswith("-") != (sign.contains("(") & t["right"].startswith(")"))
    one = lambda text: F.array(number(text, negative))
    bad = F.array(F.lit(None).cast("double"))
    groups = r"^[1-9][0-9]{0,2}(,[0-9]{3})+"
    three = F.regexp_count(raw, F.lit(",")) >= 2
    us_one = ~before.endswith(",") & (raw.rlike(groups + r"\.[0-9]+$") | (raw.rlike(groups + "$") & (~three | currency | blanks | raw.rlike(",000(,|$)"))))
    pieces = F.split(raw, ",")
    split = F.transform(pieces, lambda p, i: number(p, negative & (i == 0)))
    us = (
        F.when(raw.rlike("[eE]") & ~raw.contains(","), one(raw)).when(~raw.contains(","), one(raw)).when(us_one, one(F.replace(raw, F.lit(","), F.lit(""))))
        .when(raw.rlike(EU_SHAPE) | F.exists(split, lambda x: x.isNull()), bad).otherwise(split)
    )
    comma = F.replace(raw, F.lit(","), F.lit("."))
    eu_groups = r"^[0-9]*(\.[0-9]{3})+(,[0-9]*)?$"
    eu_value = (
        F.when(raw.rlike("[eE]") & ~raw.contains("."), one(comma)).when(~raw.contains("."), F.when(raw.rlike("^[0-9]+(,[0-9]*)?$"), one(comma)).otherwise(bad))
        .when(raw.rlike(US_SHAPE) | ~raw.rlike(eu_groups), bad).otherwise(one(F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))))
    )
    return F.when(eu, eu_value).otherwise(us)
