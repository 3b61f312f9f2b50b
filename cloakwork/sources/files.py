"""Files as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.queue import base_name, extension


def expand(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, length, modified, content): files below the paths, at any depth; a path that does not exist is passed over,
    and a path given twice counts once. Their order is that of path; nothing is sorted here, as contents would move."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if jvm.org.apache.hadoop.fs.Path(p).getFileSystem(conf).exists(jvm.org.apache.hadoop.fs.Path(p))]
    if not there:
        return spark.createDataFrame([], "path string, length long, modified timestamp, content binary")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(dict.fromkeys(there)))
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def lines_of(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per line that is not blank, with para_index counted over these."""
    line_ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
    kept = F.filter(F.split(text, line_ends, -1), lambda x: x.rlike(r"(?U)[^\s\x1c-\x1f]"))
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.posexplode(kept).alias("para_index", text))


def probe_pages(words: DataFrame) -> DataFrame:
    """(file, textual, pages) of a table of pages with their number of words: file, page_no, n_words."""
    return words.groupBy("file").agg(F.bool_or(F.col("n_words") > 0).alias("textual"), F.max("page_no").cast("long").alias("pages"))


def route(files: DataFrame) -> DataFrame:
    """Adds reader: docx, pdf_text, pdf_ocr (scanned) or none, by extension and the flag `scanned`."""
    ext = extension(F.col("path"))
    reader = F.when(ext == ".docx", "docx").when(ext == ".pdf", F.when(F.coalesce("scanned", F.lit(False)), "pdf_ocr").otherwise("pdf_text")).otherwise("none")
    return files.withColumn("reader", reader)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text): whole UTF-8 files."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return rows.select("path", base_name(F.col("path")).alias("name"), "text")


#: Rows, and characters of texts, that a worker gathers over files before it hands them on.
_ROWS, _CHARS = 10_000, 8 << 20


def by_provider(files: DataFrame, provider: Callable[[bytes], list[dict]], schema: str, nothing: str | None = None) -> DataFrame:
    """(path, error, …schema): what a provider (a PDF or OCR library on the executors) reads from each file, row by row of
    its list; a file that it fails on is one row with the error, and does not stop the others. nothing: the error of a
    file without rows, which else has no row. Each file is read once; rows of many files are handed on together."""
    names = [f.split()[0] for f in schema.split(", ")]
    frame = lambda rows: pd.DataFrame(rows, columns=["path", "error", *names], dtype=object)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    found, error = [tuple(map(r.get, names)) for r in provider(bytes(content))], nothing
                except Exception as e:  # a bad file is reported, not raised
                    found, error = [], f"{type(e).__name__}: {e}"
                if not found and error is not None:
                    rows.append((path, error, *[None] * len(names)))
                for r in found:
                    rows.append((path, None, *r))
                    size += sum(len(v) for v in r if isinstance(v, str))
                    if len(rows) >= _ROWS or size >= _CHARS:
                        yield frame(rows)
                        rows, size = [], 0
                if len(rows) >= _ROWS:
                    yield frame(rows)
                    rows, size = [], 0
        if rows:
            yield frame(rows)

    return files.select("path", "content").mapInPandas(run, f"path string, error string, {schema}")


def text_pages(files: DataFrame, provider: Callable[[bytes], list[dict]]) -> DataFrame:
    """(path, para_index, text, error): the lines that are not blank of files with a text layer, pages in their order.

    provider: content -> list of dicts with page_no and text. A file without any line is an error, as a scanned one is.
    Lines are cut and counted where the file is read, so nothing is shuffled; they are those of lines_of.
    """

    def read(content: bytes) -> list[dict]:
        pages = sorted(provider(content), key=lambda p: (p.get("page_no") is not None, p.get("page_no") or 0))
        lines = (x for p in pages for x in (p.get("text") or "").splitlines() if x.strip())
        return [{"para_index": i, "text": x} for i, x in enumerate(lines)]

    return by_provider(files, read, "para_index int, text string", "no text layer").select("path", "para_index", "text", "error")


def ocr_lines(files: DataFrame, render: Callable[[bytes], Iterable[object]], recognise: Callable[[object], list[tuple]], zoom: float = 200 / 72, chunk: int = 8) -> DataFrame:
    """(path, page_no, line_no, x0, y0, x1, y1, text, confidence, error): lines of scanned files that are not blank.

    render: content -> images of the pages, in order; recognise: image -> (four corners, text, confidence) of each line.
    Both run on the executors. A worker holds `chunk` images at a time; boxes are in page units. A file that fails is one
    row with the error, whatever was read of it before.
    """

    def read(content: bytes) -> list[dict]:
        images, out, page = iter(render(content)), [], 0
        while held := list(islice(images, chunk)):
            for found in map(recognise, held):
                kept = [x for x in found if x[1].strip()]
                for line, (corners, text, sure) in enumerate(kept):
                    xs, ys = [p[0] / zoom for p in corners], [p[1] / zoom for p in corners]
                    out.append({"page_no": page, "line_no": line, "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "text": text, "confidence": float(sure)})
                page += 1
        return out

    return by_provider(files, read, "page_no int, line_no int, x0 double, y0 double, x1 double, y1 double, text string, confidence double")


def read_cached(files: DataFrame, folder: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `read` makes of the files (path, modified, content), read once for each path and time of change.

    read: files -> rows with path. Its rows are kept as Parquet in `folder`, which executors must share; files that are
    there as they are now are not read again. A changed file is read anew, and its older rows are passed over.
    """
    spark = files.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    same = ["path", "modified"]
    new = files.join(spark.read.parquet(folder).select(*same).distinct(), same, "left_anti") if there else files
    read(new).join(new.select(*same), "path").write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(files.select(*same), same, "left_semi").drop("modified")


def missing_provider(kind: str) -> Callable[[bytes], list[dict]]:
    """Stands for a library that is not installed."""

    def run(content: bytes) -> list[dict]:
        raise RuntimeError(f"no library for {kind} is installed; pass a provider")

    return run
