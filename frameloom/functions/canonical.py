"""Canonical JSON of values of any nesting, and its digest: keys sorted at all depths, no spaces, strings without ASCII escapes, numbers as Python writes them, no NaN.

The text is built from the column's type, by built-in functions: a struct's fields and a map's entries in the order of their names' code points, arrays element by element. Doubles are written
as the shortest decimal that reads back the same, which Java's text holds too, in another layout: that is taken apart and put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, ShortType, StringType, StructType

WHOLE = (ByteType, ShortType, IntegerType, LongType)


def _quoted(c: Column) -> Column:
    """Quotes and backslashes escaped, control characters as \\n, \\t and the like or \\u00xx, all else as it is."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    for code in range(32):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\{short[code]}" if code in short else f"\\u{code:04x}"))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _laid_out(sign: Column, digits: Column, point: Column) -> Column:
    """Digits, without zeros at either end, with the decimal point after so many of them: plain from 1e-4 to below 1e16, else with an exponent of two digits at least."""
    n, e = F.length(digits), point - 1
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0"))
    middle = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n))
    plain = F.when(point <= 0, small).when(point >= n, large).otherwise(middle)
    rest = F.when(n == 1, "").otherwise(F.concat(F.lit("."), F.substring(digits, F.lit(2), n)))
    shown = F.abs(e).cast("string")
    wide = F.concat(F.substring(digits, F.lit(1), F.lit(1)), rest, F.when(e < 0, "e-").otherwise("e+"), F.when(F.length(shown) == 1, "0").otherwise(""), shown)
    return F.concat(sign, F.when((point > -4) & (point <= 16), plain).otherwise(wide))


def _shortest(digits: Column, point: Column, body) -> Column:
    """``body`` of digits and point: one digit less, if that reads back the same (Java's text may have one too many)."""
    rounded = F.round(digits.cast("decimal(38,0)"), -1).cast("decimal(38,0)").cast("string")
    other = F.struct(F.regexp_replace(rounded, "0+$", "").alias("d"), (point + F.length(rounded) - F.length(digits)).alias("p"))
    value = lambda d, p: F.concat(F.lit("0."), d, F.lit("E"), p.cast("string")).cast("double")
    pick = lambda o: F.when((F.length(digits) > 1) & (value(o["d"], o["p"]) == value(digits, point)), o).otherwise(F.struct(digits.alias("d"), point.alias("p")))
    return _let(_let(other, pick), lambda x: body(x["d"], x["p"]))


def _of_whole(exact: Column, value: Column, body) -> Column:
    """``body`` of the digits and point of a whole number above 2**53, a decimal: as few of 15, 16, 17 digits as read back the same. (There Java's text may end in digits that were rounded twice.)"""

    def rounded(m: int) -> Column:
        p = F.rpad(F.lit("1"), F.length(exact.cast("string")) - (m - 1), F.lit("0")).cast("decimal(20,0)")
        return (F.floor((exact + p / 2) / p) * p).cast("decimal(38,0)")

    found = F.coalesce(*(F.when(rounded(m).cast("double") == value, rounded(m)) for m in (15, 16, 17)), exact).cast("string")
    return _let(found, lambda t: body(F.regexp_replace(t, "0+$", ""), F.length(t)))


def _number(c: Column) -> Column:
    """A finite double as Python writes it; others raise."""

    def of_text(text: Column) -> Column:
        bare = F.regexp_replace(text, "^-", "")
        sign = F.when(text.startswith("-"), "-").otherwise("")
        mantissa = F.substring_index(bare, "E", 1)
        power = F.when(F.contains(bare, F.lit("E")), F.substring_index(bare, "E", -1)).otherwise("0").cast("int")
        parts = F.struct(sign.alias("sign"), F.substring_index(mantissa, ".", 1).alias("whole"), F.substring_index(mantissa, ".", -1).alias("part"), power.alias("power"))
        split = lambda s: _let(F.concat(s["whole"], s["part"]), lambda all_: _let(F.regexp_replace(all_, "^0+", ""), lambda rest: _let(F.struct(F.regexp_replace(rest, "0+$", "").alias("d"), (F.length(s["whole"]) + s["power"] - F.length(all_) + F.length(rest)).alias("p")), lambda x: _shortest(x["d"], x["p"], lambda d, p: _laid_out(s["sign"], d, p)))))
        value = text.cast("double")
        whole = (F.abs(value) >= 2.0**53) & (F.abs(value) < 2.0**63)
        exact = F.abs(F.when(whole, value).otherwise(0.0).cast("bigint").cast("decimal(20,0)"))
        bad = text.isin("NaN", "Infinity", "-Infinity")
        return F.when(bad, F.raise_error(F.lit("canonical JSON has no such number")).cast("string")).when(text.isin("0.0", "-0.0"), text).when(whole, _let(exact, lambda x: _of_whole(x, F.abs(value), lambda d, p: _laid_out(sign, d, p)))).otherwise(_let(parts, split))

    return _let(c.cast("string"), of_text)


def _text(c: Column, kind: DataType) -> Column:
    """JSON text of a value that isn't null."""
    if isinstance(kind, StringType):
        return _quoted(c)
    if isinstance(kind, (BooleanType, *WHOLE)):
        return c.cast("string")
    if isinstance(kind, (DoubleType, FloatType)):
        return _number(c.cast("double"))
    if isinstance(kind, NullType):
        return F.lit("null")
    if isinstance(kind, ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _json(x, kind.elementType)), ","), F.lit("]"))
    if isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(c))  # keys differ, so only they decide
        return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), _json(e["value"], kind.valueType))), ","), F.lit("}"))
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(_quoted(F.lit(f.name)), F.lit(":"), _json(c[f.name], f.dataType)) for f in fields)), F.lit("}"))
    raise TypeError(f"canonical JSON has no {kind.simpleString()}")


def _json(c: Column, kind: DataType) -> Column:
    return F.when(c.isNull(), "null").otherwise(_text(c, kind))


def canonical_json(c: Column, kind: DataType) -> Column:
    """The value ``c`` of type ``kind`` as canonical JSON; null is null's text. Maps have string keys. A null field is written as null, as in a dictionary that has it."""
    return _json(c, kind)


def canonical_digest(c: Column, kind: DataType) -> Column:
    """SHA-256 in hex of the canonical JSON in UTF-8."""
    return F.sha2(canonical_json(c, kind), 256)
