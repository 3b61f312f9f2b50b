"""Scanning of a stream of paragraphs: the per-paragraph stage needs no state, so it runs on streams as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cloakwork.operators.arbitrate import findings
from cloakwork.operators.lexicon import Lexicon


def stream_findings(paragraphs: DataFrame, lex: Lexicon | None = None, mask_judicial: bool = False) -> DataFrame:
    """Findings of a streaming DataFrame of paragraphs."""
    return findings(paragraphs, lex, mask_judicial)
