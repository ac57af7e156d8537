"""Obfuscated variants of texts, at full intensity, as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import fold
from tidewell.operators.obfuscate import CYRILLIC, DIGITS

#: Printable ASCII and its full-width forms, 0xFEE0 further on.
ASCII = "".join(map(chr, range(0x21, 0x7F)))
FULLWIDTH = "".join(chr(ord(c) + 0xFEE0) for c in ASCII)
ZERO_WIDTH = "​"


def fullwidth(text: Column) -> Column:
    return F.translate(text, ASCII, FULLWIDTH)


def zero_width(text: Column) -> Column:
    """A zero-width space after the first letter of each word of three letters or more."""
    return F.regexp_replace(text, r"([a-zA-Z])([a-zA-Z]{2,})", f"$1{ZERO_WIDTH}$2")


def lookalike_digits(text: Column) -> Column:
    """Letters as the digits they look like, capitals too."""
    return F.translate(text, "".join(DIGITS) + "".join(DIGITS).upper(), "".join(DIGITS.values()) * 2)


def cyrillic(text: Column) -> Column:
    return F.translate(text, "".join(CYRILLIC), "".join(CYRILLIC.values()))


def without_marks(text: Column) -> Column:
    return fold(text)


def survives(text: Column, normalized: Column) -> Column:
    """Whether a rule normaliser leaves the variant as it is: what a blind-spot variant needs."""
    return text == normalized
