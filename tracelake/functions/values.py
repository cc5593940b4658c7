"""Value semantics as Column expressions; nothing here is a UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

U128 = 1 << 128


def parse_target(raw: str) -> str:
    """Canonical form of a search literal: 128-bit hex (0x..) or decimal as an
    integer, anything else as lower-case text."""
    text = raw.strip().lower()
    digits, base = (text[2:], 16) if re.fullmatch(r"0x\+?[0-9a-f]+", text) else (text, 10)
    if base == 16 or re.fullmatch(r"\+?[0-9]+", text):
        number = int(digits, base)
        if number < U128:
            return str(number)
    return text


#: Digits of a limb, three of which hold 128 bits.
LIMB = 17


def hex_to_decimal(digits: Column) -> Column:
    """Decimal digits of up to 32 hexadecimal ones (lower case): by ``conv``
    where 64 bits suffice, else digit by digit in limbs of base 10^17."""
    base = F.lit(10**LIMB)
    start = F.struct(*[F.lit(0).cast("long").alias(k) for k in "abc"])

    def step(x: Column, d: Column) -> Column:
        c = x["c"] * 16 + F.conv(d, 16, 10).cast("long")
        b = x["b"] * 16 + F.call_function("div", c, base)
        return F.struct((x["a"] * 16 + F.call_function("div", b, base)).alias("a"), (b % base).alias("b"), (c % base).alias("c"))

    limbs = F.aggregate(F.split(digits, "(?!$)"), start, step)
    text = F.concat(limbs["a"].cast("string"), *[F.lpad(limbs[k].cast("string"), LIMB, "0") for k in "bc"])
    wide = F.regexp_replace(text, "^0+(?=.)", "")
    return F.when(F.length(F.regexp_replace(digits, "^0+", "")) <= 16, F.conv(digits, 16, 10)).otherwise(wide)


def decimal_fits(digits: Column, most: int) -> Column:
    """Whether decimal digits without leading zeros are a number up to most."""
    size = len(str(most))
    return (F.length(digits) < size) | ((F.length(digits) == size) & (digits <= str(most)))


def parse_target_column(raw: Column) -> Column:
    """``parse_target`` over a column."""
    text = F.lower(F.regexp_replace(raw, "^\\s+|\\s+$", ""))
    hexa = F.regexp_replace(F.regexp_replace(text, "^0x\\+?", ""), "^0+(?=.)", "")
    number = F.regexp_replace(F.regexp_replace(text, "^\\+", ""), "^0+(?=.)", "")
    return (
        F.when(text.rlike("^0x\\+?[0-9a-f]+$") & (F.length(hexa) <= 32), hex_to_decimal(hexa))
        .when(text.rlike("^\\+?[0-9]+$") & decimal_fits(number, U128 - 1), number)
        .otherwise(text)
    )


def decode_bits(bits: Column) -> list[Column]:
    """Columns kind, disp, norm and hex of a vector literal's digits (without
    its ``b``): up to 128 bits of 0 and 1 make an integer, others stay text."""
    low = F.lower(bits)
    whole = low.rlike("^[01]{0,128}$")
    full = F.concat(F.repeat(F.lit("0"), F.pmod(-F.length(low), F.lit(4))), low)
    nibbles = F.transform(F.sequence(F.lit(0), F.length(full) - 4, F.lit(4)), lambda i: F.lower(F.conv(F.substring(full, i + 1, F.lit(4)), 2, 16)))
    long = F.regexp_replace(F.array_join(nibbles, ""), "^0+(?=.)", "")
    short = F.length(low) <= 64
    hexa = F.when(F.length(low) == 0, F.lit("0")).when(short, F.lower(F.conv(low, 2, 16))).otherwise(long)
    number = F.when(F.length(low) == 0, F.lit("0")).when(short, F.conv(low, 2, 10)).otherwise(hex_to_decimal(long))
    return [
        F.when(whole, "int").otherwise("text").alias("kind"),
        F.when(whole, number).otherwise(low).alias("disp"),
        F.when(whole, number).otherwise(low).alias("norm"),
        F.when(whole, hexa).alias("hex"),
    ]


def padded(digits: Column, width: Column | int) -> Column:
    """Left-padded with zeros, never cut (lpad alone would cut)."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(F.repeat(F.lit("0"), F.greatest(width - F.length(digits), F.lit(0))), digits)


def sized(kind: Column, disp: Column, hexa: Column, size: Column) -> Column:
    """Display by declared width: integers wider than a bit as 0x with
    ceil(size/4) digits at least, everything else as it displays."""
    wide = (kind == "int") & (F.coalesce(size, F.lit(1)) > 1)
    return F.when(wide, F.concat(F.lit("0x"), padded(hexa, F.ceil(size / 4).cast("int")))).otherwise(disp)


def is_unknown(kind: Column, disp: Column) -> Column:
    """Whole-value x or z only; ``1x0`` is a known text."""
    return (kind == "text") & F.lower(disp).isin("x", "z")


def values_match(a: str, b: str, ignore_unknown: bool) -> Column:
    """Equality of struct columns a and b (kind, disp, norm, bits64): reals by
    raw bits, all else by normal form."""

    def at(s: str, f: str) -> Column:
        return F.col(s)[f]

    same = F.when((at(a, "kind") == "real") & (at(b, "kind") == "real"), at(a, "bits64") == at(b, "bits64")).otherwise(
        at(a, "norm") == at(b, "norm")
    )
    if ignore_unknown:
        same = is_unknown(at(a, "kind"), at(a, "disp")) | is_unknown(at(b, "kind"), at(b, "disp")) | same
    return same


def truth(kind: Column, disp: Column) -> Column:
    """True or false of an integer or of the texts 0 and 1; else null."""
    return F.when(kind == "int", disp != "0").when((kind == "text") & disp.isin("0", "1"), disp == "1")


def low64_hex(kind: Column, disp: Column, hexa: Column) -> Column:
    """Hexadecimal digits, without leading zeros, of a value's low 64 bits;
    null where it has no such number."""
    text = F.trim(disp)
    low = F.when(kind == "int", F.right(hexa, F.lit(16)))
    low = low.when((kind == "text") & text.rlike("^0[xX][0-9a-fA-F]{1,16}$"), F.lower(F.substring(text, 3, 16)))
    digits = F.regexp_replace(F.regexp_replace(text, "^\\+", ""), "^0+(?=.)", "")
    decimal = text.rlike("^\\+?[0-9]+$") & decimal_fits(digits, (1 << 64) - 1)
    low = low.when((kind == "text") & decimal, F.lower(F.conv(digits, 10, 16)))
    return F.when(F.regexp_replace(low, "^0+", "") == "", F.lit("0")).otherwise(F.regexp_replace(low, "^0+", ""))


def hex_with_x(bits: Column, width: int) -> Column:
    """Upper-case nibbles of a bit string padded to width; a nibble that holds
    an x or z is X."""
    full = padded(bits, width)
    full = padded(full, F.ceil(F.length(full) / 4).cast("int") * 4)
    nibbles = F.transform(
        F.sequence(F.lit(0), F.length(full).cast("int") - 4, F.lit(4)), lambda i: F.substring(full, i + 1, F.lit(4))
    )
    digits = F.transform(
        nibbles, lambda n: F.when(n.rlike("[xXzZ]"), F.lit("X")).otherwise(F.coalesce(F.conv(n, 2, 16), F.lit("0")))
    )
    return F.concat(F.lit("0x"), F.array_join(digits, ""))


def trace_data(kind: Column, disp: Column, hexa: Column) -> Column:
    """A register's value in a trace: 0x and eight digits at least, or by
    nibbles when some of its bits are unknown; null for reals."""
    text = F.trim(disp)
    return F.when((kind == "text") & text.rlike("[xXzZ]"), hex_with_x(text, 32)).otherwise(
        F.concat(F.lit("0x"), padded(low64_hex(kind, disp, hexa), 8))
    )


def sanitize_scope_line(line: Column) -> Column:
    """A header line with its $scope identifier escaped when it isn't a plain
    one; other lines unchanged. The line carries no line end."""
    body = F.ltrim(F.regexp_replace(line, "^[\\t\\x0B\\f\\r]+", ""))
    indent = F.regexp_extract(line, "^(\\s*)", 1)
    parts = F.filter(F.split(body, "\\s+"), lambda p: p != "")
    ident = F.get(parts, F.lit(2))
    plain = ident.rlike("^\\\\") | ident.rlike("^[A-Za-z_][A-Za-z0-9_$().]*$")
    fixed = F.when(plain, ident).otherwise(F.concat(F.lit("\\"), ident))
    rebuilt = F.concat(indent, F.lit("$scope "), F.get(parts, F.lit(1)), F.lit(" "), fixed, F.lit(" $end"))
    return F.when(line.rlike("^\\s*\\$scope ") & (F.size(parts) >= 4), rebuilt).otherwise(line)
