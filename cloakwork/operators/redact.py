"""Replacement of originals by aliases in paragraphs, in the runs of a paragraph, and in previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.lineage import cut, fresh
from cloakwork.functions.matching import REPLACED, apply_spans, replacement_spans
from cloakwork.operators.search import MOST, search



def chosen(found: Column) -> Column:
    """Of places (n, id, start, end, value) those that are still free, the longest string first, then by id and start."""

    def take(acc: Column, f: Column) -> Column:
        taken = F.exists(acc, lambda a: (a["start"] < f["end"]) & (f["start"] < a["end"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(F.struct(f["start"], f["end"], f["value"].alias("alias"))))).cast(REPLACED)

    return F.array_sort(F.aggregate(F.array_sort(found), F.array().cast(REPLACED), take))


def redact(paragraphs: DataFrame, pairs: DataFrame, file: str = "file", text: str = "text", most: int = MOST) -> DataFrame:
    """Paragraphs with `redacted` and `n_replaced`, which replace columns of these names.

    pairs: from mapping.pair_rows (file, null for all files; id, original, alias). Longest originals first, each at all
    places that are still free. A null text stays null, with nothing replaced; empty tables on either side are allowed.
    """
    found, spans = fresh("found"), fresh("spans")
    strings = cut(pairs.select("file", "id", F.col("original").alias("string"), F.col("alias").alias("value")))
    rows = search(paragraphs, strings, found, file, text, most)
    rows = rows.withColumn(spans, F.when(F.size(found) > 0, chosen(F.col(found))).otherwise(F.array().cast(REPLACED)))
    kept = [c for c in paragraphs.columns if c not in ("redacted", "n_replaced")]
    new = F.when(F.size(spans) > 0, apply_spans(F.col(text), F.col(spans))).otherwise(F.col(text))
    return rows.select(*kept, new.alias("redacted"), F.size(spans).alias("n_replaced"))


def redact_runs(runs: Column, pairs: Column) -> tuple[Column, Column]:
    """(new runs, number of replacements) of a paragraph made of runs: the alias goes into the run where the match
    starts, the matched characters of later runs go. Pass columns that are materialised."""
    text = F.array_join(runs, "")
    spans = replacement_spans(text, pairs)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int,t:string>>").alias("out"))
    step = lambda acc, r: F.struct((acc["at"] + F.length(r)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), (acc["at"] + F.length(r)).alias("b"), r.alias("t")))).alias("out"))
    placed = F.aggregate(runs, zero, step, lambda acc: acc["out"])

    def rewrite(r: Column) -> Column:
        mine = F.filter(spans, lambda s: (s["start"] < r["b"]) & (s["end"] > r["a"]))
        inner = F.transform(mine, lambda s: F.struct((F.greatest(s["start"], r["a"]) - r["a"]).alias("start"), (F.least(s["end"], r["b"]) - r["a"]).alias("end"), F.when(s["start"] >= r["a"], s["alias"]).otherwise("").alias("alias"))).cast(REPLACED)
        return apply_spans(r["t"], inner)

    return F.transform(placed, rewrite), F.size(spans)


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def preview(text: Column, pairs: Column, masked: bool) -> Column:
    """HTML of a paragraph, its matches marked: aliases in the masked view, originals in the other."""
    put = lambda s, old: F.concat(F.lit("<mark>"), escaped(s["alias"] if masked else old), F.lit("</mark>"))
    return apply_spans(text, replacement_spans(text, pairs), put, escaped)


def locate(text: Column, *wanted: Column) -> Column:
    """1-based place of the first wanted text that occurs; null if none does."""
    return F.coalesce(*[F.nullif(F.position(w, text), F.lit(0)) for w in wanted])
