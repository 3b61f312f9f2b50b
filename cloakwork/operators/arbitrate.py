"""From raw hits to findings: fragments merged, overlaps decided, confidence sorted into auto and pending.

Each paragraph is one row and each step a fold over its own hits, so a scan needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import fixed
from cloakwork.functions.lineage import fresh
from cloakwork.functions.matching import HIT, numbered
from cloakwork.operators.lexicon import Lexicon, all_lexicon_hits
from cloakwork.operators.rules import all_rule_hits

HITS = f"array<{HIT}>"


def _rank(value: Column, ranks: dict[str, int], other: int) -> Column:
    return reduce(lambda rest, k: F.when(value == k, ranks[k]).otherwise(rest), reversed(ranks), F.lit(other))


def merge_fragments(text: Column, hits: Column) -> Column:
    """Touching or overlapping entity hits become one of 60 characters at most; hits of rules stay, and come first.

    The longer fragment gives the category (at equal length the better rank); the first gives all else.
    """
    entity = lambda h: h["category"].isin(*fixed.ENTITIES)
    key = lambda h: F.struct(h["start"].alias("a"), (h["start"] - h["end"]).alias("b"), h["ord"].alias("c"), h.alias("h"))
    ordered = F.transform(F.array_sort(F.transform(F.filter(hits, entity), key)), lambda x: x["h"])

    def step(acc: Column, h: Column) -> Column:
        top = acc["top"]
        end = F.greatest(top["end"], h["end"])
        joins = top.isNotNull() & (h["start"] <= top["end"]) & (end - top["start"] <= fixed.MERGE_MAX)
        old, new = top["end"] - top["start"], h["end"] - h["start"]
        better = (new > old) | ((new == old) & (_rank(h["category"], fixed.MERGE_RANK, 9) < _rank(top["category"], fixed.MERGE_RANK, 9)))
        category = F.when((h["end"] > top["end"]) & better, h["category"]).otherwise(top["category"])
        wide = F.struct(
            top["start"].alias("start"), end.alias("end"), F.substr(text, top["start"] + 1, end - top["start"]).alias("text"), category.alias("category"),
            top["confidence"].alias("confidence"), top["source"].alias("source"), top["judicial"].alias("judicial"), top["ord"].alias("ord"),
        ).cast(HIT)
        done = F.when(top.isNull() | joins, acc["done"]).otherwise(F.concat(acc["done"], F.array(top)))
        return F.struct(done.cast(HITS).alias("done"), F.when(joins, wide).otherwise(h).cast(HIT).alias("top"))

    zero = F.struct(F.array().cast(HITS).alias("done"), F.lit(None).cast(HIT).alias("top"))
    merged = F.aggregate(ordered, zero, step, lambda a: F.when(a["top"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["top"]))))
    return numbered(F.concat(F.filter(hits, lambda h: ~entity(h)), merged))


def arbitrate(hits: Column) -> Column:
    """Non-overlapping hits, taken by start, then layer, category and length; an earlier start beats any layer."""

    def key(h: Column) -> Column:
        layer, category = _rank(h["source"], fixed.LAYER_RANK, 9), _rank(h["category"], fixed.CATEGORY_RANK, 50)
        return F.struct(h["start"].alias("a"), layer.alias("b"), category.alias("c"), (h["start"] - h["end"]).alias("d"), h["ord"].alias("e"), h.alias("h"))

    def step(acc: Column, h: Column) -> Column:
        free = h["start"] >= acc["end"]
        out = F.when(free, F.concat(acc["out"], F.array(h))).otherwise(acc["out"])
        return F.struct(F.when(free, h["end"]).otherwise(acc["end"]).alias("end"), out.cast(HITS).alias("out"))

    ordered = F.transform(F.array_sort(F.transform(hits, key)), lambda x: x["h"])
    return F.aggregate(ordered, F.struct(F.lit(0).alias("end"), F.array().cast(HITS).alias("out")), step, lambda a: a["out"])


def status_of(confidence: Column) -> Column:
    return F.when(confidence >= fixed.AUTO, "auto").when(confidence >= fixed.PENDING, "pending")


def raw_hits(text: Column, lex: Lexicon | None = None) -> Column:
    """Hits of the rules and of the lexicon, numbered in order of emission."""
    return numbered(F.concat(all_rule_hits(text), all_lexicon_hits(text, lex or Lexicon())))


def provided_hits(text: str, provider: Callable[[str], list[dict]]) -> Column:
    """Hits of any callable text -> list of dicts with start, end, category, confidence, for the text column.

    The callable runs in Python workers, one Arrow batch at a time; null and blank texts are not passed to it.
    """

    @F.pandas_udf("array<struct<start:int,end:int,category:string,confidence:double>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[] if t is None or not t.strip() else provider(t) for t in batch])

    t = F.col(text)
    full = lambda h: F.struct(h["start"], h["end"], F.substr(t, h["start"] + 1, h["end"] - h["start"]), h["category"], h["confidence"], F.lit("ner"), F.lit(False), F.lit(0))
    return F.transform(run(t), full).cast(HITS)


#: What findings() adds to the columns of a paragraph.
FOUND = ("start", "end", "original", "category", "confidence", "source", "judicial", "status")


def findings(
    paragraphs: DataFrame,
    lex: Lexicon | None = None,
    mask_judicial: bool = False,
    provider: Callable[[str], list[dict]] | None = None,
    text: str = "text",
) -> DataFrame:
    """One row per finding: the paragraph's columns but its text, and those of FOUND.

    A paragraph that is null or blank has none, and an empty table gives none. Repeated rows are scanned each. Columns of
    the input that are named as one of FOUND give way to it; any other name is allowed. Hits that begin alike are decided
    by layer, category, length and order of emission. Judicial names are dropped last, so they still keep others out.
    """
    hits_, h_ = fresh("hits"), fresh("h")
    rows = paragraphs.filter(F.col(text).rlike(r"(?U)[^\s\x1c-\x1f]"))
    if provider:
        ner_ = fresh("ner")
        rows = rows.withColumn(ner_, provided_hits(text, provider))
        rows = rows.withColumn(hits_, numbered(F.concat(raw_hits(F.col(text), lex), F.col(ner_))))
    else:
        rows = rows.withColumn(hits_, raw_hits(F.col(text), lex))
    some = lambda f: F.when(F.size(hits_) > 0, f).otherwise(F.array().cast(HITS))
    rows = rows.withColumn(hits_, some(merge_fragments(F.col(text), F.col(hits_))))
    rows = rows.withColumn(hits_, some(arbitrate(F.col(hits_))))
    rest = [c for c in paragraphs.columns if c != text and c not in FOUND]
    # explode_outer: for explode, Spark infers a filter on the array's size, which computes the whole array once more
    out = rows.select(*rest, F.explode_outer(hits_).alias(h_)).filter(F.col(h_).isNotNull())
    h = F.col(h_)
    if not mask_judicial:
        out = out.filter(~h["judicial"])
    out = out.select(*rest, h["start"].alias("start"), h["end"].alias("end"), h["text"].alias("original"), *[h[c].alias(c) for c in ("category", "confidence", "source", "judicial")], status_of(h["confidence"]).alias("status"))
    return out.filter(F.col("status").isNotNull())
