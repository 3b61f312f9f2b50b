"""Queries for reviewing a mapping: filters, groups, labels, candidates for merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.fixed import ALIAS_SUFFIX, LABELS


def category_label(category: Column) -> Column:
    return reduce(lambda rest, c: F.when(category == c, LABELS[c]).otherwise(rest), reversed(LABELS), category)


def visible(mapping: DataFrame, file: str | None = None, pending_only: bool = False, keyword: str = "") -> DataFrame:
    """Items of a file (global ones included), pending ones only, with a keyword in original or alias."""
    keep = F.lit(True)
    if file is not None:
        keep &= F.col("files").isNull() | F.array_contains("files", file)
    if pending_only:
        keep &= F.col("pending")
    if keyword.strip():
        word = F.lit(keyword.strip())
        keep &= F.contains("original", word) | F.contains("alias", word)
    return mapping.filter(keep)


def groups(mapping: DataFrame) -> DataFrame:
    """(grp, n, first_id): pending items as one group, first in order; the others by label, in order of first item."""
    grp = F.when(F.col("pending"), "待确认").otherwise(category_label(F.col("category")))
    rows = mapping.groupBy(F.col("pending").alias("p"), grp.alias("grp")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return rows.orderBy(F.col("p").desc(), "first_id").drop("p")


def source_label(files: Column) -> Column:
    return F.when(files.isNull(), "全部文件").when(F.size(files) == 1, F.array_min(files)).otherwise(F.concat(F.size(files).cast("string"), F.lit("个文件")))


def accept_pending(mapping: DataFrame) -> DataFrame:
    return mapping.withColumns({"enabled": F.col("enabled") | F.col("pending"), "pending": F.lit(False)})


def ignore_pending(mapping: DataFrame, shown: DataFrame) -> DataFrame:
    """The mapping without the pending items that are shown."""
    return mapping.join(shown.filter("pending").select("id"), "id", "left_anti")


def merge_candidates(mapping: DataFrame, original: str) -> DataFrame:
    """Other items of the category of one item, if it is a category with aliases."""
    own = mapping.filter(F.col("original") == original).select(F.col("category").alias("_c"))
    rows = mapping.filter((F.col("original") != original) & F.col("category").isin(*ALIAS_SUFFIX))
    return rows.join(F.broadcast(own.limit(1)), F.col("category") == F.col("_c"), "left_semi")


def first_file(mapping: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, file): of each item's files the first in the queue (docs: name, doc_seq); global items have the queue's first."""
    first = docs.agg(F.min_by("name", "doc_seq").alias("name")).first()
    rows = mapping.select("id", "files", F.explode_outer("files").alias("file"))
    met = rows.join(docs.select(F.col("name").alias("_n"), "doc_seq"), F.col("file") == F.col("_n"), "left")
    chosen = met.groupBy("id").agg(F.min_by("_n", "doc_seq").alias("file"), F.first(F.col("files").isNull()).alias("_all"))
    return chosen.select("id", F.when(F.col("_all"), F.lit(first.name if first else None)).otherwise(F.col("file")).alias("file"))
