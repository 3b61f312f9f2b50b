"""A queue of files: scanned, reviewed elsewhere, and exported. A file that fails is marked and does not stop the others.

queue: path, doc_seq, status, content and, for PDF files, pages and scanned. Names of files are what the mapping knows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.lineage import cut
from cloakwork.operators import envelope, queue
from cloakwork.operators.lexicon import Lexicon
from cloakwork.operators.mapping import pairs_by_file
from cloakwork.operators.search import MOST
from cloakwork.plans.scan import ScanSettings, scan
from cloakwork.sources import docx, files, sink

#: Reads files (path, content) of one kind: (path, para_index, text, error), an error row for each that fails.
Reader = Callable[[DataFrame], DataFrame]


def default_readers() -> dict[str, Reader]:
    """Readers by kind. PDF files need a library on the executors; without one each is an error of its own."""
    none = files.missing_provider("PDF files")
    return {"docx": docx.read, "pdf_text": lambda f: files.text_pages(f, none), "pdf_ocr": lambda f: files.text_pages(f, none)}


@dataclass(frozen=True)
class Scanned:
    """What a scan gives: the queue with new states and errors, the paragraphs, the findings and the mapping."""

    queue: DataFrame
    paragraphs: DataFrame
    findings: DataFrame
    mapping: DataFrame


def _queued(docs: DataFrame) -> DataFrame:
    missing = {"pages": "int", "scanned": "boolean", "need_rescan": "boolean", "error": "string"}
    return docs.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in docs.columns})


def read_paragraphs(todo: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """(path, para_index, text, error) of files, each by the reader of its kind; files of other kinds are errors."""
    routed = files.route(_queued(todo))
    readers = {**default_readers(), **(readers or {})}
    other = routed.filter(~F.col("reader").isin(*readers))
    rows = other.select("path", F.lit(None).cast("int").alias("para_index"), F.lit(None).cast("string").alias("text"), F.lit("no reader for this kind of file").alias("error"))
    for kind, read in readers.items():
        rows = rows.unionByName(read(routed.filter(F.col("reader") == kind)).select("path", "para_index", "text", "error"))
    return rows


def scan_batch(docs: DataFrame, lex: Lexicon | None = None, settings: ScanSettings = ScanSettings(), provider=None, readers: dict[str, Reader] | None = None) -> Scanned:
    """Files that wait or have failed, read and scanned; those with very many pages count last in the mapping.

    The others keep their state. A file without paragraphs is scanned, with no findings. An empty queue gives empty tables.
    """
    docs = _queued(docs)
    waits = F.col("status").isin(queue.PENDING, queue.FAILED)
    todo = docs.filter(waits)
    rows = cut(read_paragraphs(todo, readers))  # read once: for errors and for texts
    errors = rows.filter(F.col("error").isNotNull()).groupBy(F.col("path").alias("_path")).agg(F.min("error").alias("_error"))
    who = todo.select(F.col("path").alias("_path"), queue.base_name(F.col("path")).alias("file"), "doc_seq", queue.is_big(F.col("pages")).alias("big"))
    good = rows.join(errors, F.col("path") == F.col("_path"), "left_anti")
    paragraphs = good.join(who, F.col("path") == F.col("_path")).select("path", "file", "doc_seq", "big", "para_index", "text")
    found, mapping = scan(paragraphs, lex, settings, provider)
    after = docs.join(errors, F.col("path") == F.col("_path"), "left")
    failed = waits & F.col("_error").isNotNull()
    after = after.withColumns({"status": F.when(failed, queue.FAILED).when(waits, queue.SCANNED).otherwise(F.col("status")), "error": F.when(waits, F.col("_error")).otherwise(F.col("error"))})
    return Scanned(after.select(*docs.columns), paragraphs, found, mapping)


def pairs_for(names: DataFrame, mapping: DataFrame, name: str = "name", most: int = MOST) -> DataFrame:
    """`names` with pairs, the (original, alias) pairs of each file and of all files, longest original first, then by id.

    Pairs of all files are what users add by hand; more than `most` bytes of them are an error.
    """
    known = pairs_by_file(mapping)
    every = known.filter(F.col("file").isNull()).select(F.col("p").alias("_all")).collect()
    if sum(len(x.original) + len(x.alias) + 64 for r in every for x in r[0]) * 3 > most:
        raise ValueError("too many items for all files; give them the files they are in")
    kind = known.schema["p"].dataType
    own = known.filter(F.col("file").isNotNull()).select(F.col("file").alias("_file"), F.col("p").alias("_own"))
    shared = names.sparkSession.createDataFrame([(r[0],) for r in every] or [([],)], f"_all {kind.simpleString()}")
    met = names.join(own, F.col(name) == F.col("_file"), "left").join(F.broadcast(shared))  # one row
    both = F.array_sort(F.concat(F.coalesce("_own", F.array().cast(kind)), F.col("_all")))
    pair = lambda x: F.struct(x["original"].alias("original"), x["alias"].alias("alias"))
    return met.withColumn("pairs", F.transform(both, pair)).select(*names.columns, "pairs")


def export_batch(docs: DataFrame, mapping: DataFrame, folder: str, password: str, mapping_name: str = "mapping.json", writers: dict[str, docx.Writer] | None = None, batch_id: str | None = None) -> DataFrame:
    """The queue, without content, after its scanned files were rewritten into `folder`, with target, n_replaced and
    warnings. Runs at once.

    Files that wait, are scanned now or have failed are passed over. A name that the folder has, or that an earlier file
    of the queue takes, gets _1, _2, ...; a file that fails is marked, and the others go on. The sealed mapping is
    written even if all fail, in several files of the same batch where it is large (envelope.items_of_files reads them);
    an empty password is an error before anything is written.
    """
    spark = docs.sparkSession
    if not password:
        raise ValueError("the password is empty")
    docs = _queued(docs)
    skipped = F.col("status").isin(queue.PENDING, queue.SCANNING, queue.FAILED)
    todo = docs.filter(~skipped).select("path", "doc_seq", queue.base_name(F.col("path")).alias("name"), "scanned", "content")
    there = files.expand(spark, [folder]).select(queue.base_name(F.col("path")).alias("name"))
    targets = queue.unique_targets(todo.select("path", "doc_seq", "name"), there).select(F.col("path").alias("_t"), "target")
    pairs = pairs_for(todo.select("path", "name"), mapping).select("path", "pairs")
    made = cut(docx.write(files.route(todo), pairs, writers).join(targets, F.col("path") == F.col("_t")).drop("_t"))
    written = sink.write_files(made.filter(F.col("error").isNull()), folder).withColumnsRenamed({"error": "_failed", "target": "_target"})
    done = made.join(written, F.col("target") == F.col("_target"), "left")
    problem = F.coalesce("error", "_failed")
    done = done.select(F.col("path").alias("_path"), "target", "n_replaced", "warnings", F.when(problem.isNotNull(), F.concat(F.lit("导出失败："), problem)).alias("export_error"))
    sources = docs.filter(F.col("content").isNotNull()).select(queue.base_name(F.col("path")).alias("name"), envelope.sha256_of(F.col("content")).alias("sha"), "doc_seq")
    parts = envelope.mapping_parts(mapping, sources, batch_id)
    sealed = envelope.seal_parts(parts, mapping_name, password).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    lost = sink.write_files(sealed, folder).filter(F.col("error").isNotNull()).select("error").first()
    if lost:
        raise RuntimeError(f"the mapping was not written: {lost.error}")
    after = queue.after_export(docs.join(done, F.col("path") == F.col("_path"), "left"))
    target = F.when(F.col("exported"), F.col("target"))
    error = F.coalesce("export_error", "error")
    return cut(after.select(*[c for c in docs.columns if c not in ("error", "content")], error.alias("error"), target.alias("target"), "n_replaced", "warnings"))


