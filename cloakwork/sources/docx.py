"""Reader and writer of docx files, with the standard library only."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"
_PARTS = ("document", "header", "footer", "footnotes", "endnotes", "comments")


def text_parts(archive: zipfile.ZipFile) -> list[str]:
    """Names of the parts that hold text: by content type and name, in the archive's order."""
    types = ElementTree.fromstring(archive.read("[Content_Types].xml"))
    by_name = {e.get("PartName", "").lstrip("/"): e.get("ContentType", "") for e in types.iter(f"{_TYPES}Override")}
    ok = lambda n: "wordprocessingml" in by_name.get(n, "") and any(p in posixpath.basename(n) for p in _PARTS)
    return [n for n in archive.namelist() if ok(n)]


def paragraphs(content: bytes) -> list[list[str]]:
    """The runs of every paragraph, nested ones too; text in a text box counts in the outer paragraph as well."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for part in text_parts(archive):
            for p in ElementTree.fromstring(archive.read(part)).iter(f"{_W}p"):
                out.append(["".join(t.text or "" for t in r.iter(f"{_W}t")) for r in p.iter(f"{_W}r")])
    return out


def build(runs: list[list[str]], parts: dict[str, list[list[str]]] | None = None) -> bytes:
    """A docx file with just these paragraphs of runs. parts: those of further parts, as header1 or footnotes."""
    space = "{http://www.w3.org/XML/1998/namespace}space"
    base = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    types = ElementTree.Element(f"{_TYPES}Types")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, paragraphs_ in {"document": runs, **(parts or {})}.items():
            kind = name.rstrip("0123456789")
            root = ElementTree.Element(f"{_W}{kind}")
            body = ElementTree.SubElement(root, f"{_W}body") if kind == "document" else root
            for paragraph in paragraphs_:
                p = ElementTree.SubElement(body, f"{_W}p")
                for text in paragraph:
                    t = ElementTree.SubElement(ElementTree.SubElement(p, f"{_W}r"), f"{_W}t", {space: "preserve"})
                    t.text = text
            ElementTree.SubElement(types, f"{_TYPES}Override", {"PartName": f"/word/{name}.xml", "ContentType": f"{base}.{kind}{'.main' if kind == 'document' else ''}+xml"})
            archive.writestr(f"word/{name}.xml", ElementTree.tostring(root, "UTF-8", xml_declaration=True))
        archive.writestr("[Content_Types].xml", ElementTree.tostring(types, "UTF-8", xml_declaration=True))
    return out.getvalue()


#: Rows, and bytes of files, that a worker gathers before it hands them on.
_ROWS, _BYTES = 5_000, 16 << 20


def read(files: DataFrame) -> DataFrame:
    """(path, para_index, runs, text, error): paragraphs that are not empty; a bad file is one row with its error."""
    names = ["path", "para_index", "runs", "text", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, k, r, "".join(r), None) for k, r in enumerate(r for r in paragraphs(bytes(content)) if "".join(r))]
                except Exception as e:  # a bad file is reported, not raised
                    rows.append((path, 0, None, None, f"{type(e).__name__}: {e}"))
                if len(rows) >= _ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, "path string, para_index int, runs array<string>, text string, error string")


def replace(content: bytes, pairs: list[tuple[str, str]]) -> tuple[bytes, int]:
    """The file with all originals replaced, and how often; the alias goes into the run where its match starts, and the
    style of the runs stays."""
    count, out = 0, io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as src, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as dst:
        parts = set(text_parts(src))
        for item in src.infolist():
            raw = src.read(item)
            if item.filename in parts:
                for _, (prefix, uri) in ElementTree.iterparse(io.BytesIO(raw), ["start-ns"]):
                    if not re.fullmatch(r"ns\d+", prefix):  # the library makes such prefixes itself
                        ElementTree.register_namespace(prefix, uri)
                root = ElementTree.fromstring(raw)
                count += sum(_replace_in(p, pairs) for p in root.iter(f"{_W}p"))
                raw = ElementTree.tostring(root, "UTF-8", xml_declaration=True)
            dst.writestr(item, raw)
    return out.getvalue(), count


def spans_of(text: str, pairs: list[tuple[str, str]]) -> list[tuple[int, int, str]]:
    """Places of the originals, in the order of the pairs, each at all places still free."""
    spans: list[tuple[int, int, str]] = []
    for old, new in pairs:
        at = text.find(old) if old else -1
        while at >= 0:
            if all(at + len(old) <= a or at >= b for a, b, _ in spans):
                spans.append((at, at + len(old), new))
            at = text.find(old, at + 1)
    return sorted(spans)


def _replace_in(paragraph: ElementTree.Element, pairs: list[tuple[str, str]]) -> int:
    nodes = [t for r in paragraph.iter(f"{_W}r") for t in r.iter(f"{_W}t")]
    texts = [t.text or "" for t in nodes]
    spans = spans_of("".join(texts), pairs)
    ends, total = [], 0
    for t in texts:
        total += len(t)
        ends.append(total)
    for a, b, new in reversed(spans):
        for k in range(len(texts) - 1, -1, -1):
            lo = ends[k - 1] if k else 0
            x, y = max(a, lo), min(b, ends[k])
            if x < y:
                texts[k] = texts[k][: x - lo] + (new if a >= lo else "") + texts[k][y - lo :]
    if spans:
        for node, t in zip(nodes, texts):
            node.text = t
            if t != t.strip():
                node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    return len(spans)


Writer = Callable[[bytes, list[tuple[str, str]]], tuple[bytes, int, list[str]]]


def rewrite_docx(content: bytes, pairs: list[tuple[str, str]]) -> tuple[bytes, int, list[str]]:
    """The writer of docx files; it has no warnings."""
    return (*replace(content, pairs), [])


def write(files: DataFrame, pairs: DataFrame, writers: dict[str, Writer] | None = None) -> DataFrame:
    """(path, content, n_replaced, warnings, error): files rewritten on the executors, each by the writer of its kind.

    files: path, content and, if there are others than docx, reader (the kind, from files.route). pairs: path, pairs
    array of (original, alias) in their order; a file without any is copied. writers: kind -> content, pairs -> content,
    number of replacements, warnings. A file that fails, or whose kind has no writer, has its error and no content.
    """
    known = {"docx": rewrite_docx, **(writers or {})}

    names = ["path", "content", "n_replaced", "warnings", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for batch in batches:
            for path, kind, content, own in zip(batch["path"], batch["reader"], batch["content"], batch["pairs"]):
                try:
                    if kind not in known:
                        raise ValueError(f"no writer for {kind}; pass one")
                    new, n, warnings = known[kind](bytes(content), [(p["original"], p["alias"]) for p in (own if own is not None else [])])
                    rows.append((path, new, n, warnings, None))
                    size += len(new)
                except Exception as e:  # a bad file is reported, not raised
                    rows.append((path, None, 0, [], f"{type(e).__name__}: {e}"))
                if size >= _BYTES or len(rows) >= _ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    kind = F.col("reader") if "reader" in files.columns else F.lit("docx")
    met = files.select("path", "content", kind.alias("reader")).join(pairs.select(F.col("path").alias("_p"), "pairs"), F.col("path") == F.col("_p"), "left")
    return met.select("path", "reader", "content", "pairs").mapInPandas(run, "path string, content binary, n_replaced long, warnings array<string>, error string")
