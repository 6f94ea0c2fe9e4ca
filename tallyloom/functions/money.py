"""Amounts: text to integer cents and back. Cents are bigint throughout; nothing here uses a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an amount may look like in each decimal style, and the largest exact integer of the source format.
COMMA, DOT = r"^([0-9]{1,3}(?:\.[0-9]{3})*|[0-9]+)(?:,([0-9]{1,2}))?$", r"^([0-9]+)(?:\.([0-9]{1,2}))?$"
LARGEST = 2**53 - 1

#: White space as the source files mean it, no-break space included.
WS = r"[\s   -     　﻿]"


#: The same characters as a set.
WS_CHARACTERS = " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARACTERS))


def _whole(number: str, sign: str) -> str:
    """The whole text of an amount: EUR or the sign stand at either end and however often, never in the middle."""
    currency = "(?i:EUR|€)"
    return rf"^{WS}*+(?:{currency}{WS}*+)*+{sign}{number[1:-1]}(?:{WS}*+{currency})*+{WS}*+\z"


def _cents(text: Column, style: Column | str, sign: str) -> Column:
    """One match a text; what is left of digits, minus and point is the number. No lambda stands here and nothing long is
    repeated: these expressions run on every cell of every file."""

    def read(number: str, keep: str, to: str) -> Column:
        bare = F.translate(text, keep + "EUReur€+" + WS_CHARACTERS, to)
        cents = (bare.try_cast("decimal(18,2)") * 100).cast("bigint")
        # null beyond the largest; the sum keeps the cents outside the condition, so they are computed once
        return F.when(text.rlike(_whole(number, sign)), cents + F.when(F.abs(cents) <= LARGEST, 0))

    if isinstance(style, str):
        return read(COMMA, ",.", ".") if style == "comma" else read(DOT, ".", ".")
    return F.when(style == "comma", read(COMMA, ",.", ".")).otherwise(read(DOT, ".", "."))


def parse_cents(text: Column, style: Column | str) -> Column:
    """Signed amount text to cents; null if it is none. style: 'comma' or 'dot'."""
    return _cents(text, style, f"[-+]?{WS}*+")


def parse_unsigned_cents(text: Column, style: Column | str) -> Column:
    """The same for texts that must not carry a sign."""
    return _cents(text, style, "")


def display(cents: Column) -> Column:
    """-1.234,05 for -123405."""
    size = F.abs(cents)
    whole = F.translate(F.format_number((size - size % 100) / 100, 0), ",", ".")
    return F.concat(F.when(cents < 0, "-").otherwise(""), whole, F.lit(","), F.lpad((size % 100).cast("string"), 2, "0"))
