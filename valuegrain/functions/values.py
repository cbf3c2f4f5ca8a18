"""Columns for values: canonical texts, durations and their units, exact claims, identities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The five units and their seconds.
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400, "weeks": 604800}
#: A claim's text is at most so long, its exponent at most so large, the result within the range of milliseconds in 63 bits.
CLAIM_BYTES, CLAIM_EXPONENT, CLAIM_SECONDS = 128, 128, 9_223_372_036_854_775
#: Separates fields of an identity.
US = "\x1f"


def try_cast(x: Column, kind: str) -> Column:
    """The cast, or null where there is none."""
    return x.try_cast(kind)


def number_text(x: Column) -> Column:
    """No exponent, no trailing zeros: integers below 10^15 as such, else nine decimals, else the plain cast."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    short = F.rtrim(F.rtrim(try_cast(x, "decimal(38,9)").cast("string"), F.lit("0")), F.lit("."))
    return F.when(whole, try_cast(x, "bigint").cast("string")).otherwise(F.coalesce(short, x.cast("string")))


def duration_text(secs: Column) -> Column:
    """``1d 2h 0m 5s``: leading and trailing zero units are left out, and all of hours and minutes between days and seconds if both are zero."""
    a = F.abs(secs)
    d, h, m, s = F.floor(a / 86400), F.floor((a % 86400) / 3600), F.floor((a % 3600) / 60), a % 60
    part = lambda x, unit: F.concat(x.cast("bigint").cast("string"), F.lit(unit))
    show_h = (h > 0) | ((d > 0) & (m > 0))
    show_m = (m > 0) | ((h > 0) & (s > 0))
    text = F.concat_ws(" ", F.when(d > 0, part(d, "d")), F.when(show_h, part(h, "h")), F.when(show_m, part(m, "m")), F.when((s > 0) | (a < 60), part(s, "s")))
    return F.when(secs == 0, F.lit("0s")).otherwise(F.concat(F.when(secs < 0, F.lit("-")).otherwise(F.lit("")), text))


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def value_text(kind: Column, number: Column, date: Column, secs: Column) -> Column:
    return F.when(kind == "NUMBER", number_text(number)).when(kind == "DATE", date_text(date)).when(kind == "DURATION", duration_text(secs))


def xsd_duration(secs: Column) -> Column:
    """Lexical form of xsd:duration."""
    a = F.abs(secs)
    d, h, m, s = (F.floor(a / 86400), F.floor((a % 86400) / 3600), F.floor((a % 3600) / 60), a % 60)
    part = lambda x, unit: F.when(x > 0, F.concat(x.cast("bigint").cast("string"), F.lit(unit))).otherwise(F.lit(""))
    time = F.when(a % 86400 > 0, F.concat(F.lit("T"), part(h, "H"), part(m, "M"), part(s, "S"))).otherwise(F.lit(""))
    return F.when(secs == 0, F.lit("PT0S")).otherwise(F.concat(F.when(secs < 0, F.lit("-")).otherwise(F.lit("")), F.lit("P"), part(d, "D"), time))


def unit_seconds(unit: Column) -> Column:
    """Seconds of a unit; null for an unknown one. Names are exact, plural and lower case."""
    return reduce(lambda acc, kv: acc.when(unit == kv[0], F.lit(kv[1]).cast("bigint")), list(UNITS.items())[1:], F.when(unit == "seconds", F.lit(1).cast("bigint")))


def unit_display(secs: Column, unit: Column) -> Column:
    """struct(decimal, approximate, text): twelve decimals, half up; ``approximately`` where that isn't exact.

    Below a unit there are at most 604,799 seconds, so the rest times 10^12 fits 63 bits and no decimal is needed.
    """

    def of_parts(x: Column) -> Column:
        scaled = x["rest"] * F.lit(10**12)
        exact = scaled % x["scale"] == 0
        up = F.when(exact, F.lit(0)).otherwise(F.floor(x["scale"] / 2))
        total = scaled + up
        return F.struct(x["secs"].alias("secs"), x["unit"].alias("unit"), x["whole"].alias("whole"), exact.alias("exact"), ((total - total % x["scale"]) / x["scale"]).cast("decimal(20,0)").cast("bigint").alias("fraction"))

    def of_fraction(x: Column) -> Column:
        carry = x["fraction"] == 10**12
        return F.struct(x["secs"].alias("secs"), x["unit"].alias("unit"), x["exact"].alias("exact"), (x["whole"] + carry.cast("bigint")).alias("whole"), F.when(carry, F.lit(0)).otherwise(x["fraction"]).alias("fraction"))

    def of_text(x: Column) -> Column:
        digits = F.rtrim(F.lpad(x["fraction"].cast("string"), 12, "0"), F.lit("0"))
        plain = F.when(x["fraction"] == 0, x["whole"].cast("string")).otherwise(F.concat(x["whole"].cast("string"), F.lit("."), digits))
        one = (x["whole"] == 1) & (x["fraction"] == 0)
        return F.struct(x["exact"].alias("exact"), F.when((x["secs"] < 0) & (plain != "0"), F.concat(F.lit("-"), plain)).otherwise(plain).alias("decimal"), F.when(one, F.regexp_replace(x["unit"], "s$", "")).otherwise(x["unit"]).alias("label"))

    def shown(x: Column) -> Column:
        text = F.concat(F.when(x["exact"], F.lit("")).otherwise(F.lit("approximately ")), x["decimal"], F.lit(" "), x["label"])
        return F.struct(x["decimal"].alias("decimal"), (~x["exact"]).alias("approximate"), text.alias("text"))

    scale, a = unit_seconds(unit), F.abs(secs)
    parts = F.struct(secs.alias("secs"), unit.alias("unit"), scale.alias("scale"), (a % scale).alias("rest"), F.floor(a / scale).cast("bigint").alias("whole"))
    return F.when(scale.isNotNull(), _let(_let(_let(_let(parts, of_parts), of_fraction), of_text), shown))


def claim_seconds(lexeme: Column, unit: Column) -> Column:
    """Whole seconds of a claimed decimal in a unit, exactly; null if it is no such number, not whole, or out of range.

    With zeros stripped, a valid significand has at most 26 digits and needs at most seven decimal
    places removed (604800 holds seven twos), so decimal(38,0) is exact.
    """
    shape = r"^([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]{1,4}))?$"
    scale = unit_seconds(unit)
    powers = F.array(*[F.lit(str(10**k)).cast("decimal(20,0)") for k in range(20)])
    ten = lambda n: F.element_at(powers, F.greatest(F.least(n, F.lit(19)), F.lit(0)) + 1)

    def of_parts(p: Column) -> Column:
        exponent = F.coalesce(try_cast(F.when(p["power"] == "", F.lit("0")).otherwise(p["power"]), "int"), F.lit(0))
        digits = F.ltrim(F.concat(p["whole"], p["frac"]), F.lit("0"))
        return F.struct(p["ok"].alias("ok"), p["sign"].alias("sign"), p["scale"].alias("scale"), exponent.alias("exponent"), (exponent - F.char_length(p["frac"])).alias("shift"), digits.alias("digits"))

    def of_digits(d: Column) -> Column:
        bare = F.rtrim(d["digits"], F.lit("0"))
        product = (try_cast(F.when(F.char_length(bare) <= 26, bare), "decimal(26,0)") * d["scale"].cast("decimal(6,0)")).cast("decimal(38,0)")
        shift = d["shift"] + F.char_length(d["digits"]) - F.char_length(bare)
        return F.struct((d["ok"] & (F.abs(d["exponent"]) <= CLAIM_EXPONENT)).alias("ok"), d["sign"].alias("sign"), bare.alias("bare"), product.alias("product"), shift.alias("shift"))

    def of_product(v: Column) -> Column:
        up = F.when((v["shift"] >= 0) & (F.char_length(v["bare"]) + v["shift"] <= 19), F.try_multiply(v["product"], ten(v["shift"])))
        down = F.when((v["shift"] < 0) & (v["shift"] >= -7) & (v["product"] % ten(-v["shift"]) == 0), F.floor(v["product"] / ten(-v["shift"])).cast("decimal(38,0)"))
        magnitude = F.coalesce(up.cast("decimal(38,0)"), down)
        seconds = F.when(magnitude <= CLAIM_SECONDS, magnitude.cast("bigint"))
        return F.when(~v["ok"], F.lit(None)).when(v["bare"] == "", F.lit(0).cast("bigint")).otherwise(F.when(v["sign"] == "-", -seconds).otherwise(seconds))

    def of_text(x: Column) -> Column:
        whole, frac = F.regexp_extract(x["text"], shape, 2), F.regexp_extract(x["text"], shape, 3)
        ok = x["text"].rlike(shape) & x["text"].rlike("^[+-]?[.]?[0-9]") & (F.octet_length(x["text"]) <= CLAIM_BYTES) & x["scale"].isNotNull()
        return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.regexp_extract(x["text"], shape, 1).alias("sign"), whole.alias("whole"), frac.alias("frac"), F.regexp_extract(x["text"], shape, 4).alias("power"), x["scale"].alias("scale"))

    text = F.struct(F.trim(lexeme).alias("text"), scale.alias("scale"))
    short = F.trim(lexeme).rlike(r"^[+-]?[0-9]{1,9}$")  # whole, and in range in any unit: no decimals are needed
    return F.when(short, try_cast(F.trim(lexeme), "bigint") * scale).otherwise(_let(_let(_let(_let(text, of_text), of_parts), of_digits), of_product))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a column that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def date_diff(first: Column, second: Column) -> Column:
    """Whole seconds from the first date to the second; null if negative or not whole."""
    micros = F.unix_micros(second) - F.unix_micros(first)
    return F.when((micros >= 0) & (micros % 1_000_000 == 0), F.floor(micros / 1_000_000).cast("bigint"))


def close(a: Column, b: Column) -> Column:
    """Equal within tolerance: 8 epsilon where one is zero, relative 1e-9 at equal signs, never across signs."""
    finite = ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))
    high = F.greatest(F.abs(a), F.abs(b))
    return F.coalesce(
        F.when(~finite, False).when(a == b, True).when((a == 0) | (b == 0), high <= 8 * 2.220446049250313e-16).when(F.signum(a) != F.signum(b), False).otherwise(F.abs(a - b) <= high * 1e-9),
        F.lit(False),
    )


def _digest(prefix: str, *fields: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(US, *fields), 256), 1, 32))


def packed_id(x: Column) -> Column:
    """An id as bytes, the 32 hex digits that it may end in as 16 of them: what is dealt out and joined by, exactly, in less room.

    A null gives no bytes rather than a null: joins then need no filter, which would make the id once more.
    """
    end = F.right(x, F.lit(32))
    start = F.left(x, F.char_length(x) - 32)
    return F.coalesce(F.when(end.rlike("^[0-9a-f]{32}$"), F.concat(F.lit(b"\x01"), start.cast("binary"), F.unhex(end))).otherwise(F.concat(F.lit(b"\x00"), x.cast("binary"))), F.lit(b""))


def unpacked_id(x: Column) -> Column:
    """The id that ``packed_id`` made the bytes from."""
    size = F.octet_length(x)
    end = F.lower(F.hex(F.substring(x, -16, 16)))
    return F.when(F.substring(x, 1, 1) == F.lit(b"\x01"), F.concat(x.substr(F.lit(2), size - 17).cast("string"), end)).when(size > 0, x.substr(F.lit(2), size).cast("string"))


def packed_hex(x: Column) -> Column:
    """A text as bytes, half as many if it is all hex digits, as fingerprints are; exact."""
    return F.when(x.rlike("^([0-9a-f]{2})+$"), F.concat(F.lit(b"\x01"), F.unhex(x))).when(x.isNotNull(), F.concat(F.lit(b"\x00"), x.cast("binary")))


def unpacked_hex(x: Column) -> Column:
    """The text that ``packed_hex`` made the bytes from."""
    rest = x.substr(F.lit(2), F.octet_length(x))
    return F.when(F.substring(x, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def root_id(path: Column, line: Column, occurrence: Column, kind: Column, text: Column) -> Column:
    """Identity of a value by path, line, occurrence on the line, kind and canonical text."""
    empty = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return _digest("node_raw_", empty(path), empty(line), empty(occurrence), kind, text)


def derived_id(parents: Column, operation: Column, text: Column) -> Column:
    """Identity of a derived number: parents in order, operation and value; not the formula."""
    return _digest("node_drv_", F.array_join(parents, ","), operation, text)


def duration_id(parents: Column, operation: Column, secs: Column) -> Column:
    """Identity of a derived duration: the order of parents counts for a date difference only."""
    ordered = F.when(operation == "DATE_DIFF", parents).otherwise(F.array_sort(parents))
    return _digest("node_drv_", F.lit("DURATION"), operation, secs.cast("string"), F.size(parents).cast("string"), F.array_join(ordered, ","))
