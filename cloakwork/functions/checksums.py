"""Checksum predicates of identity numbers, bank cards and credit codes."""

from __future__ import annotations

from functools import cache
from sys import maxunicode

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.fixed import ID_CHECKS, ID_WEIGHTS, USCC_ALPHABET


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


@cache
def _digits() -> tuple[str, str]:
    """All decimal digits of other scripts than ASCII, and what they are."""
    others = [chr(c) for c in range(128, maxunicode + 1) if chr(c).isdecimal()]
    return "".join(others), "".join(str(int(c)) for c in others)


def ascii_digits(s: Column) -> Column:
    """Decimal digits of any script, full-width ones too, as ASCII digits; other characters as they are."""
    return F.when(s.rlike(r"(?U)[\d&&[^0-9]]"), F.translate(s, *_digits())).otherwise(s)


def valid_id_number(s: Column) -> Column:
    """18 places; weighted digits, of any script, modulo 11 give the last one, whatever its case."""
    s = ascii_digits(s)
    digits = [F.substr(s, F.lit(i + 1), F.lit(1)).try_cast("int") * w for i, w in enumerate(ID_WEIGHTS)]
    check = F.substr(F.lit(ID_CHECKS), F.pmod(_sum(digits), F.lit(11)) + 1, F.lit(1))
    return (F.length(s) == 18) & F.coalesce(check == F.upper(F.substr(s, F.lit(18), F.lit(1))), F.lit(False))


def valid_luhn(s: Column) -> Column:
    """Every second digit, of any script, from the right doubled, nines cast out, the sum a multiple of ten."""
    s = ascii_digits(s)

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    digits = F.transform(F.filter(F.split(F.reverse(s), ""), lambda c: c != ""), value)
    return s.rlike("^[0-9]+$") & (F.aggregate(digits, F.lit(0), lambda a, x: a + x) % 10 == 0)


def valid_uscc(s: Column) -> Column:
    """18 places of 31 characters; powers of three as weights, modulo 31."""
    index = lambda i: F.position(F.substr(s, F.lit(i + 1), F.lit(1)), F.lit(USCC_ALPHABET)) - 1
    total = _sum([index(i) * (3**i % 31) for i in range(17)])
    known = s.rlike(f"^[{USCC_ALPHABET}]{{18}}$")
    return known & (F.pmod(31 - F.pmod(total, F.lit(31)), F.lit(31)) == index(17))


VALIDATORS = {"id": valid_id_number, "luhn": valid_luhn, "uscc": valid_uscc}
