"""Files written by the executors, one for each row."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.lineage import cut


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + os.path.abspath(folder))


def put(folder: str, name: str, content: bytes) -> None:
    """One file, whole or not at all: written beside its place and then moved there. name: a path below the folder."""
    parts = name.split("/")
    if not name or any(p in ("", ".", "..") for p in parts):
        raise ValueError(f"no name of a file: {name!r}")
    system, base = _place(folder)
    target = "/".join([base.rstrip("/"), *parts])
    beside = f"{target}.{uuid.uuid4().hex}.part"
    system.create_dir(target.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(beside) as out:
        out.write(content)
    system.move(beside, target)


def write_files(rows: DataFrame, folder: str, name: str = "target", content: str = "content") -> DataFrame:
    """(name, error): each row's content as the file `name` below `folder`, which executors must share. Runs at once.

    A row that cannot be written has its error and does not stop the others; a null content is one. A task that runs
    again writes the same files again. Of rows with one name the last that is written stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    if not c.is_valid:
                        raise ValueError("no content")
                    put(folder, n or "", c.as_py())
                    errors.append(None)
                except Exception as e:  # reported in the row
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], names=["name", "error"])

    done = rows.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "name string, error string")
    return cut(done).withColumnRenamed("name", name)


def read_files(rows: DataFrame, folder: str, name: str = "target") -> DataFrame:
    """(name, content, error): the files that the rows name below `folder`, read on the executors where the rows are.

    For the folders of write_files; no folder is listed, however many files it has. A file that cannot be read has its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _place(folder)
        found, size = [], 0
        for batch in batches:
            for n in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{base.rstrip('/')}/{n}") as f:
                        found.append((n, f.read(), None))
                    size += len(found[-1][1])
                except Exception as e:  # reported in the row
                    found.append((n, None, f"{type(e).__name__}: {e}"))
                if len(found) >= 5_000 or size >= 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.binary(), pa.string()))], names=["name", "content", "error"])
                    found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.binary(), pa.string()))], names=["name", "content", "error"])

    return rows.select(F.col(name).cast("string")).mapInArrow(run, "name string, content binary, error string").withColumnRenamed("name", name)
