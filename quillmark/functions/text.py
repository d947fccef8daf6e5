"""Column expressions for tokens, normalisation, white space and exact rounding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a token; a run of them that touches any other letter, digit or underscore is no token.
TOKEN_CLASS = "A-Za-záéíóúñüÁÉÍÓÚÑÜ0-9"
TOKEN = rf"(?<![\p{{L}}\p{{N}}_])[{TOKEN_CLASS}]+(?![\p{{L}}\p{{N}}_])"
#: White space as a class for both ends of a strip and for collapsing.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def _plain_letters() -> tuple[str, str]:
    """Accented letters up to U+024F that decompose into one ASCII letter and marks, and those letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isascii() and base[0] != chr(code):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _plain_letters()


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"{SPACE}+", " "))


def normalized(text: Column) -> Column:
    """Lower case without accents; runs of anything but a-z and 0-9 become one space."""
    low = F.lower(text)
    plain = F.when(F.octet_length(text) == F.length(text), low).otherwise(F.translate(low, ACCENTED, PLAIN))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def line_breaks(text: Column) -> Column:
    """NULs to spaces, blanks collapsed, at most one empty line, stripped."""
    text = F.regexp_replace(F.translate(text, "\x00", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase."""
    gone = F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))
    return (gone / F.lit(len(phrase))).cast("long")


def half_even(numerator: str, denominator: str) -> str:
    """SQL for numerator / denominator of non-negative integers, rounded half to even."""
    q, r = f"(({numerator}) div ({denominator}))", f"(({numerator}) % ({denominator}))"
    return f"({q} + case when 2 * {r} > ({denominator}) or (2 * {r} = ({denominator}) and {q} % 2 = 1) then 1 else 0 end)"


def percent(hundredths: Column) -> Column:
    """Integer hundredths of a percent as DECIMAL(5,2)."""
    return (hundredths.cast("decimal(7,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(5,2)")
