"""Codecs and formats as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = ("B", "KB", "MB", "GB", "TB")


def varint_hex(n: Column, most: int = 10) -> Column:
    """LEB128 of a non-negative integer, in upper-case hex."""
    groups = [F.shiftrightunsigned(n, 7 * i).bitwiseAND(F.lit(127).cast("bigint")) for i in range(most)]
    more = [F.shiftrightunsigned(n, 7 * (i + 1)) > 0 if 7 * (i + 1) < 64 else F.lit(False) for i in range(most)]
    first = [F.lit(True), *more[:-1]]
    return F.concat(*(F.when(u, F.lpad(F.hex(g + F.when(m, 128).otherwise(0)), 2, "0")).otherwise("") for g, m, u in zip(groups, more, first, strict=True)))


def varint_decode(hexed: Column) -> Column:
    """The integer of one LEB128 number in hex; null if it is cut short or too long."""
    size = F.length(hexed) / 2
    part = lambda i: F.conv(F.substring(hexed, 2 * i + 1, 2), 16, 10).cast("bigint")
    total = reduce(lambda a, b: a + b, (F.when(size > i, F.shiftleft(part(i).bitwiseAND(F.lit(127).cast("bigint")), 7 * i)).otherwise(F.lit(0).cast("bigint")) for i in range(9)))
    last = F.conv(F.substring(hexed, -2, 2), 16, 10).cast("bigint")
    return F.when((size >= 1) & (size <= 9) & (last < 128), total)


def byte_sum(text: Column) -> Column:
    """The sum of a string's UTF-8 bytes, modulo 2^32."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    at = F.sequence(F.lit(1), F.greatest(F.length(hexed) - 1, F.lit(1)), F.lit(2))
    value = lambda i: F.coalesce(F.conv(F.substring(hexed, i, 2), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(text.isNotNull(), F.aggregate(at, F.lit(0).cast("bigint"), lambda s, i: s + value(i)) % F.lit(1 << 32))


def human_size(n: Column) -> Column:
    """Bytes in the largest unit of 1024 steps up to TB, with two decimals (half to even)."""
    out = None
    for i, unit in enumerate(_UNITS):
        text = F.format_string(f"%.2f {unit}", F.bround(n.cast("double") / (1024.0**i), 2))
        fits = n < 1024 ** (i + 1) if i < len(_UNITS) - 1 else F.lit(True)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out


def file_number(name: Column) -> Column:
    """The number between the last underscore and the suffix of a file's name."""
    found = F.regexp_extract(name, r"_(\d+)\.", 1)
    return F.when(found != "", found.cast("bigint"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings, in characters; 0 where one is null."""
    same = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.eqNullSafe(y))  # the shorter one is filled up with nulls
    differs = F.array_position(same, False)
    return F.coalesce(F.when(differs > 0, differs - 1).otherwise(F.length(a)), F.lit(0)).cast("int")


def _sized(n: Column, width: int) -> Column:
    return F.lpad(F.hex(n.cast("bigint")), 2 * width, "0")


def entry_hex(kind: Column, seq: Column, key: Column, value: Column) -> Column:
    """One framed entry in upper-case hex: kind (1 byte), sequence (8), size of the key (4), key, size of the value (4), value.

    Numbers are big-endian; a null value is framed like an empty one.
    """
    value = F.coalesce(value, F.lit(bytearray()))
    return F.concat(_sized(kind, 1), _sized(seq, 8), _sized(F.octet_length(key), 4), F.hex(key), _sized(F.octet_length(value), 4), F.hex(value))


def entry_parse(hexed: Column) -> Column:
    """``kind, seq, key, value`` of a framed entry; an empty value is null, and so is the whole of a frame that is cut short."""
    number = lambda at, width: F.conv(F.substr(hexed, at, F.lit(2 * width)), 16, 10).cast("bigint")
    key_size = number(F.lit(19), 4)
    after = F.lit(27) + 2 * key_size
    value_size = number(after, 4)
    whole = F.length(hexed) == after + 7 + 2 * value_size
    key = F.unhex(F.substr(hexed, F.lit(27), 2 * key_size))
    value = F.when(value_size > 0, F.unhex(F.substr(hexed, after + 8, 2 * value_size)))
    return F.when(whole, F.struct(number(F.lit(1), 1).alias("kind"), number(F.lit(3), 8).alias("seq"), key.alias("key"), value.alias("value")))


def decode_text(data: Column, errors: str = "strict") -> Column:
    """The text of UTF-8 bytes. Broken bytes raise, become U+FFFD (``replace``) or give null (``null``)."""
    text = data.cast("string")
    return {"strict": F.validate_utf8, "replace": F.make_valid_utf8, "null": F.try_validate_utf8}[errors](text)
