"""From paragraphs to a mapping and to redacted paragraphs, and back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.lineage import cut
from cloakwork.operators.arbitrate import findings
from cloakwork.operators.lexicon import Lexicon
from cloakwork.operators.mapping import build_mapping, pair_rows
from cloakwork.operators.redact import redact
from cloakwork.sources.files import lines_of


@dataclass(frozen=True)
class ScanSettings:
    """What a user sets for a scan: whether judicial names are masked, and whether the model is asked."""

    mask_judicial: bool = False
    use_model: bool = False


def scan(paragraphs: DataFrame, lex: Lexicon | None = None, settings: ScanSettings = ScanSettings(), provider: Callable[[str], list[dict]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, mapping) of paragraphs: file, doc_seq, big, para_index, text. The scan runs once."""
    if settings.use_model and provider is None:
        raise ValueError("the model is to be asked, but no provider is given")
    found = cut(findings(paragraphs, lex, settings.mask_judicial, provider if settings.use_model else None))
    return found, build_mapping(found)


def deidentify(paragraphs: DataFrame, lex: Lexicon | None = None, settings: ScanSettings = ScanSettings(), provider: Callable[[str], list[dict]] | None = None) -> DataFrame:
    """Paragraphs with redacted text and the number of replacements."""
    return redact(paragraphs, pair_rows(scan(paragraphs, lex, settings, provider)[1]))


def paragraphs_of(docs: DataFrame) -> DataFrame:
    """The lines of documents (doc_id, text) that are not blank as paragraphs: file, doc_seq, big, para_index, text."""
    rows = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), F.col("doc_id").alias("doc_seq"), F.lit(False).alias("big"), "text")
    return lines_of(rows).select("file", "doc_seq", "big", "para_index", "text")
