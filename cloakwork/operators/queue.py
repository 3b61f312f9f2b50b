"""The document queue: intake, order of scanning, states, names of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions.fixed import BIG_PAGES, INTAKE
from cloakwork.operators.mapping import ranked

# --- fixed values: states and their marks ---
PENDING, SCANNING, SCANNED, FAILED, REDACTED, EXPORTED = "待扫描", "扫描中", "已扫描", "扫描失败", "已脱敏", "已导出"
ICONS = {PENDING: "○", SCANNING: "…", SCANNED: "◆", FAILED: "⚠", REDACTED: "●", EXPORTED: "✔"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def intake(paths: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """path, accepted, reason: new paths, each once; others than docx and pdf are rejected, and so are unreadable PDFs
    (column `readable` false, if there is one)."""
    new = paths.dropDuplicates(["path"])
    new = new.join(known.select("path"), "path", "left_anti") if known is not None else new
    readable = F.coalesce(F.col("readable"), F.lit(True)) if "readable" in paths.columns else F.lit(True)
    reason = F.when(~extension(F.col("path")).isin(*INTAKE), "extension").when(~readable, "unreadable")
    return new.select("path", reason.isNull().alias("accepted"), reason.alias("reason"))


def is_big(pages: Column) -> Column:
    return F.coalesce(pages > BIG_PAGES, F.lit(False))


def scan_order(docs: DataFrame) -> DataFrame:
    """Documents that wait or have failed, with place: those with very many pages last, else in the queue's order."""
    todo = docs.filter(F.col("status").isin(PENDING, FAILED)).withColumn("big", is_big(F.col("pages")))
    return ranked(todo, ["big", "doc_seq"], name="place")


def mark_dirty(docs: DataFrame) -> DataFrame:
    """After a change of the mapping, redacted and exported documents are merely scanned and need a rescan."""
    done = F.col("status").isin(REDACTED, EXPORTED)
    return docs.withColumns({"need_rescan": F.when(done, True).otherwise(F.col("need_rescan")), "status": F.when(done, SCANNED).otherwise(F.col("status"))})


def after_export(docs: DataFrame, error: str = "export_error") -> DataFrame:
    """States after an export: documents that wait, are scanned now or have failed are passed over; each other is exported
    or, where its own export failed, failed."""
    skipped = F.col("status").isin(PENDING, SCANNING, FAILED)
    bad = F.col(error).isNotNull()
    status = F.when(skipped, F.col("status")).when(bad, FAILED).otherwise(EXPORTED)
    return docs.withColumns({"need_rescan": F.when(skipped | bad, F.col("need_rescan")).otherwise(False), "status": status, "exported": ~skipped & ~bad})


def unique_targets(names: DataFrame, existing: DataFrame, order: str = "doc_seq", name: str = "name") -> DataFrame:
    """Adds target: the name itself for the first of a name that does not exist yet, else name_1, name_2, ... passing
    over those that exist. existing: name. Only names of one stem meet."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    suffix = lambda c: F.regexp_extract(c, r"(\.[^.]*)$", 1)
    split = existing.select(F.regexp_extract("name", r"^(.*?)(?:_([1-9][0-9]*))?(\.[^.]*)?$", 1).alias("s"), F.regexp_extract("name", r"^(.*?)(?:_([1-9][0-9]*))?(\.[^.]*)?$", 2).alias("i"), suffix(F.col("name")).alias("x"))
    numbered = split.select(F.concat("s", "x").alias("_n"), F.when(F.col("i") == "", 0).otherwise(F.col("i").try_cast("int")).alias("i"))
    whole = existing.select(F.col("name").alias("_n"), F.lit(0).alias("i"))
    taken = numbered.union(whole).groupBy("_n").agg(F.sort_array(F.collect_set("i")).alias("taken"))
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    rows = names.withColumn("_at", nth).join(taken, F.col(name) == F.col("_n"), "left")
    at = F.aggregate(F.coalesce("taken", F.array().cast("array<int>")), F.col("_at"), lambda i, k: F.when(i >= k, i + 1).otherwise(i))
    target = F.when(at == 0, F.col(name)).otherwise(F.concat(stem(F.col(name)), F.lit("_"), at.cast("string"), suffix(F.col(name))))
    return rows.withColumn("target", target).select(*names.columns, "target")


def label(name: Column, status: Column, scanned: Column, big: Column, need_rescan: Column) -> Column:
    """One line for a document in a list."""
    icon = reduce(lambda rest, s: F.when(status == s, ICONS[s]).otherwise(rest), reversed(ICONS), F.lit("○"))
    flag = lambda c, t: F.when(c, t).otherwise("")
    return F.concat(icon, F.lit(" "), flag(scanned, "🖨 "), flag(big, "⏱ "), name, F.lit("  ["), status, flag(need_rescan, "（需重扫）"), F.lit("]"))
