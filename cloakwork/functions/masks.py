"""Masks and aliases of single values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.functions.fixed import ALIAS_SUFFIX, BRANCHES, KEEP, STEMS


def _keep(value: Column, head: int, tail: int) -> Column:
    """Head and tail stay; a value no longer than both keeps its first character only."""
    n = F.length(value)
    short = F.concat(F.substr(value, F.lit(1), F.lit(1)), F.repeat(F.lit("*"), n - 1))
    middle = F.repeat(F.lit("*"), n - head - tail)
    return F.when(n <= head + tail, short).otherwise(F.concat(F.substr(value, F.lit(1), F.lit(head)), middle, F.right(value, F.lit(tail))))


def mask_value(value: Column, category: Column, strict: bool = False) -> Column:
    """The mask of a value by its category. strict also masks birth dates whose two separators differ."""
    n = F.length(value)
    plate = F.concat(F.substr(value, F.lit(1), F.lit(2)), F.repeat(F.lit("*"), n - 3), F.right(value, F.lit(1)))
    spelled = F.regexp_replace(value, r"(?U)(\d{4})年\d{1,2}月\d{1,2}日", "$1年**月**日")
    second = "[-/]" if strict else r"\2"
    dashed = F.regexp_replace(value, rf"(?U)(\d{{4}})([-/])\d{{1,2}}{second}\d{{1,2}}", "$1$2**$2**")
    other = reduce(lambda rest, c: F.when(category == c, _keep(value, *KEEP[c])).otherwise(rest), reversed(KEEP), _keep(value, 2, 2))
    return (
        F.when(category == "email", F.concat(F.substr(value, F.lit(1), F.lit(1)), F.lit("***@***")))
        .when(category == "wechat", F.lit("***"))
        .when(category == "ethnicity", F.lit("某族"))
        .when(category == "plate", plate)
        .when(category == "birth_date", F.when(F.contains(value, F.lit("年")), spelled).otherwise(dashed))
        .otherwise(other)
    )


def is_alias_category(category: Column) -> Column:
    return category.isin(*ALIAS_SUFFIX)


def alias_suffix(category: Column) -> Column:
    """What follows the stem; person and custom share one, so they share their numbers."""
    return reduce(lambda rest, c: F.when(category == c, F.lit(ALIAS_SUFFIX[c])).otherwise(rest), reversed(ALIAS_SUFFIX), F.lit("某"))


def alias_at(suffix: Column, index: Column) -> Column:
    """The alias number `index`: ten stems, twelve branches, then the stems with 2, 3, ... behind."""
    base, n = STEMS + BRANCHES, len(STEMS + BRANCHES)
    later = (index - n).cast("long")
    stem = F.when(index < n, F.substr(F.lit(base), index.cast("int") + 1, F.lit(1))).otherwise(F.substr(F.lit(STEMS), F.pmod(later, F.lit(10)).cast("int") + 1, F.lit(1)))
    turn = F.when(index < n, F.lit("")).otherwise((F.floor(later / 10) + 2).cast("string"))
    return F.concat(stem, suffix, turn)
