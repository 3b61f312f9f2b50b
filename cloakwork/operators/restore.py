"""Restoring: aliases back to originals, by the pairs of a mapping file."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.fixed import FORMAT_VERSION, RESTORABLE
from cloakwork.functions.matching import apply_spans, replacement_spans
from cloakwork.operators.search import MOST, Finder, blocks


def validate(mapping: dict) -> None:
    if mapping.get("version") != FORMAT_VERSION:
        raise ValueError(f"unsupported mapping version {mapping.get('version')}")
    if not isinstance(mapping.get("mappings"), list):
        raise ValueError("malformed mapping file")


def inverse_pairs(mapping: dict) -> list[tuple[str, str]]:
    """(alias, original) of enabled items, longest alias first, else in the file's order; pending ones take part."""
    return sorted(((m["alias"], m["original"]) for m in mapping["mappings"] if m.get("enabled", True)), key=lambda p: -len(p[0]))


def restorable(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1)).isin(*RESTORABLE)


def restored_name(name: Column) -> Column:
    return F.regexp_replace(name, r"^(.*?)((?:\.[^.]*)?)$", "$1_已还原$2")


def name_warnings(docs: DataFrame, mapping: dict, name: str = "name") -> DataFrame:
    """Documents that the mapping's list does not name; none if the list is empty. They are restored all the same."""
    known = [m.get("file") for m in mapping.get("doc_manifest", [])]
    if not known:
        return docs.limit(0)
    listed = docs.sparkSession.createDataFrame([(k,) for k in known], "_known string").distinct()
    return docs.join(F.broadcast(listed), F.col(name) == F.col("_known"), "left_anti")


def pair_array(pairs: list[tuple[str, str]]) -> Column:
    kind = "array<struct<original:string,alias:string>>"
    return F.array(*[F.struct(F.lit(a).alias("original"), F.lit(b).alias("alias")) for a, b in pairs]).cast(kind)


def restore_text(text: Column, pairs: Column) -> tuple[Column, Column]:
    """(text, number of replacements): one pair after the other, so later pairs see what earlier ones put in."""

    def step(acc: Column, p: Column) -> Column:
        old = F.length(acc["t"])
        without = F.replace(acc["t"], p["original"], F.lit(""))
        n = F.when(F.length(p["original"]) > 0, (old - F.length(without)) / F.length(p["original"])).otherwise(0)
        return F.struct(F.replace(acc["t"], p["original"], p["alias"]).alias("t"), (acc["n"] + n.cast("int")).alias("n"))

    done = F.aggregate(pairs, F.struct(text.alias("t"), F.lit(0).alias("n")), step)
    return done["t"], done["n"]


def restore_paragraph(text: Column, pairs: Column) -> tuple[Column, Column]:
    """(text, number of replacements) for paragraphs of documents: longest first, without overlaps."""
    spans = replacement_spans(text, pairs)
    return apply_spans(text, spans), F.size(spans)


def _absent(spark: SparkSession, items: list[tuple]) -> Callable[[str], Column]:
    """A function of a text column: the items (id, alias, original, occurrences) whose alias is not in the text."""
    shared = spark.sparkContext.broadcast(items)
    kind = pa.list_(pa.struct([("alias", pa.string()), ("original", pa.string()), ("occurrences", pa.int64())]))

    @F.arrow_udf("array<struct<alias:string,original:string,occurrences:long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder((k, a, "") for k, (_, a, _, _) in enumerate(shared.value))
        rows = [{"alias": a, "original": o, "occurrences": n} for _, a, o, n in shared.value]
        aliases = [r["alias"] for r in rows]
        for texts in batches:
            out = []
            for t in texts.to_pylist():
                there = {t[f["start"] : f["end"]] for f in finder.places(t)}
                out.append([r for r, a in zip(rows, aliases) if a not in there and a != ""])
            yield pa.array(out, kind)

    return run


def unrestored(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "name", most: int = MOST) -> DataFrame:
    """(key, alias, original, occurrences): enabled items whose alias is nowhere in a document before restoring.

    items: id, alias, original, occurrences, enabled. They are looked for in blocks of about `most` bytes, each in a pass
    of its own without a shuffle. Repeated rows are each reported; in a null text nothing is found.
    """
    kept = items.filter(F.coalesce("enabled", F.lit(True)) & F.col("alias").isNotNull()).orderBy("id")
    kept = kept.select("id", F.col("alias").alias("string"), F.col("original").alias("value"), F.col("occurrences").cast("long").alias("occurrences"))
    parts = [docs.select(F.col(key).alias("_k"), F.explode(_absent(docs.sparkSession, block)(F.col(text).cast("string"))).alias("x")) for block in blocks(kept, most)]
    out = reduce(DataFrame.unionByName, parts) if parts else docs.select(F.col(key).alias("_k"), F.expr("named_struct('alias', '', 'original', '', 'occurrences', 0L)").alias("x")).limit(0)
    return out.select(F.col("_k").alias(key), "x.*")


def report_line(alias: Column, original: Column, occurrences: Column) -> Column:
    return F.concat(alias, F.lit("\t"), original, F.lit("\t原出现 "), occurrences.cast("string"), F.lit(" 次"))
