"""Matches with positions, prefix stripping and replacement as column expressions. Positions are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIT = "struct<start:int,end:int,text:string,category:string,confidence:double,source:string,judicial:boolean,ord:int>"
SPAN = "array<struct<start:int,end:int,text:string>>"


#: Noncharacters: MARK is put around values; one that a text has is taken for SPARE, which no pattern tells from it.
MARK, SPARE = "\ufdd0", "\ufdd1"


def find_all(text: Column, value: str, before: str = "", after: str = "", need: str = "") -> Column:
    """Array of (start, end, text) of the values of all non-overlapping matches from the left; none for a null text.

    A match is `before`, `value` and `after`, none of them with groups of their own. One pass of the pattern marks the
    values, and the lengths of the pieces between the marks give the positions. Only texts in which `need` is found are
    searched.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(SPARE)), F.lit(f"(?Ud)({before})({value})({after})"), F.lit(f"$1{MARK}$2{MARK}$3"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["pos"] + F.length(piece)
        hit = F.struct(acc["pos"].alias("start"), end.alias("end"), F.substr(text, acc["pos"] + 1, F.length(piece)).alias("text"))
        found = F.when(acc["inside"], F.concat(acc["out"], F.array(hit))).otherwise(acc["out"])
        return F.struct(end.alias("pos"), (~acc["inside"]).alias("inside"), found.cast(SPAN).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("inside"), F.array().cast(SPAN).alias("out"))
    spans = F.aggregate(F.split(marked, MARK, -1), zero, step, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit("(?Ud)" + need)) if need else text.isNotNull(), spans).otherwise(F.array().cast(SPAN))


def as_hits(spans: Column, category: str, confidence: float, source: str, judicial: bool = False) -> Column:
    """Spans as hits; ord is set when all hits of a paragraph are together."""
    fields = lambda s: F.struct(s["start"], s["end"], s["text"], F.lit(category), F.lit(confidence), F.lit(source), F.lit(judicial), F.lit(0))
    return F.transform(spans, fields).cast(f"array<{HIT}>")


def numbered(hits: Column) -> Column:
    """Hits with ord, their place in the array: the order of emission, which decides ties."""
    return F.transform(hits, lambda h, i: h.withField("ord", i))


def alternation(words: list[str]) -> str:
    """Regular expression of the words, longest first."""
    return "|".join(rf"\Q{w}\E" for w in sorted(words, key=lambda w: -len(w)))


def strip_prefixes(value: Column, prefixes: list[str]) -> Column:
    """Passes over the prefixes in their order, each taken off wherever it leads and something stays, until none does."""
    words, leads = F.array(*[F.lit(p) for p in prefixes]), f"(?s)^(?:{alternation(list(prefixes))})."
    shorter = lambda v, p: F.when(F.startswith(v, p) & (F.length(v) > F.length(p)), F.substr(v, F.length(p) + 1)).otherwise(v)
    one = lambda v: F.when(v.rlike(leads), F.aggregate(words, v, shorter)).otherwise(v)
    # a pass that changes something takes a character at least, so there are no more passes than characters
    return F.when(value.rlike(leads), F.aggregate(F.sequence(F.lit(1), F.length(value)), value, lambda v, _: one(v))).otherwise(value)


def strip_words(value: Column, words: list[str]) -> Column:
    """Leading words taken off as long as something stays; for words of which none begins another."""
    return F.regexp_replace(value, f"(?s)^(?:{alternation(words)})+(?=.)", "")


def occurrences(text: Column, word: Column) -> Column:
    """0-based starts of all occurrences, overlapping ones too: the text is cut before each of them."""
    quoted = F.concat(F.lit(r"(?=\Q"), F.replace(word, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E)"))
    none = F.array().cast("array<int>")
    zero = F.struct(F.lit(0).alias("pos"), F.when(F.startswith(text, word), F.array(F.lit(0))).otherwise(none).alias("out"))
    step = lambda acc, piece: F.struct((acc["pos"] + F.length(piece)).alias("pos"), F.concat(acc["out"], F.array(acc["pos"] + F.length(piece))).alias("out"))
    starts = F.aggregate(F.split(text, quoted, -1), zero, step, lambda acc: F.slice(acc["out"], 1, F.size(acc["out"]) - 1))
    return F.when((F.length(word) > 0) & F.contains(text, word), starts).otherwise(none)  # the end of the text is no start


REPLACED = "array<struct<start:int,end:int,alias:string>>"


def replacement_spans(text: Column, pairs: Column) -> Column:
    """Spans (start, end, alias) in order: pairs (original, alias) in their order, each at all places still free."""

    def place(spans: Column, pair: Column) -> Column:
        def take(acc: Column, s: Column) -> Column:
            end = s + F.length(pair["original"])
            taken = F.exists(acc, lambda a: (a["start"] < end) & (s < a["end"]))
            new = F.array(F.struct(s.alias("start"), end.alias("end"), pair["alias"].alias("alias")))
            return F.when(taken, acc).otherwise(F.concat(acc, new)).cast(REPLACED)

        return F.aggregate(occurrences(text, pair["original"]), spans, take)

    present = F.filter(F.coalesce(pairs, F.array().cast("array<struct<original:string,alias:string>>")), lambda p: F.contains(text, p["original"]))
    return F.array_sort(F.aggregate(present, F.array().cast(REPLACED), place))


def apply_spans(text: Column, spans: Column, put=lambda s, old: s["alias"], keep=lambda t: t) -> Column:
    """The text with each span replaced; put gives the new text of a span, keep that of the text between spans."""

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(text, acc["pos"] + 1, s["start"] - acc["pos"])
        old = F.substr(text, s["start"] + 1, s["end"] - s["start"])
        return F.struct(s["end"].alias("pos"), F.concat(acc["out"], keep(between), put(s, old)).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], keep(F.substr(text, acc["pos"] + 1))))
