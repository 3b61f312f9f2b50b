"""Named-entity layer: word pieces, tags to spans, and a provider for ONNX models. Runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.fixed import NER_ALONE, NER_CATEGORIES, NER_CONFIDENCE, NER_LABELS, NER_MAX_TOKENS


def read_vocabulary(raw: str) -> dict[str, int]:
    """Word -> line number; lines end at \\n only, a \\r before it goes."""
    return {line.removesuffix("\r") if line.count("\r") < 2 else line.rstrip("\r"): i for i, line in enumerate(raw.split("\n"))}


def stands_alone(ch: str) -> bool:
    return "一" <= ch <= "鿿" or ch in NER_ALONE or ch.isspace()


def word_pieces(text: str, vocabulary: dict[str, int]) -> list[str]:
    """Ideographs, listed marks and blanks alone; other runs by the longest piece known, else a character or [UNK]."""
    out: list[str] = []
    at = 0
    while at < len(text):
        if stands_alone(text[at]):
            out.append(text[at])
            at += 1
            continue
        stop = next((i for i in range(at, len(text)) if stands_alone(text[i])), len(text))
        word, i = text[at:stop], 0
        while i < len(word):
            sizes = range(len(word) - i, 0, -1)
            n = next((n for n in sizes if ("##" if i else "") + word[i : i + n] in vocabulary), 0)
            out.append(("##" if i else "") + word[i : i + n] if n else word[i] if word[i] in vocabulary else "[UNK]")
            i += n or 1
        at = stop
    return out


def token_ids(tokens: list[str], vocabulary: dict[str, int]) -> list[int]:
    """Ids with [CLS] and [SEP]; tokens beyond the model's length are not seen."""
    return [vocabulary["[CLS]"], *(vocabulary.get(t, vocabulary["[UNK]"]) for t in tokens[:NER_MAX_TOKENS]), vocabulary["[SEP]"]]


def token_spans(tokens: list[str]) -> list[tuple[int, int]]:
    """Each token's place in the text; ## does not count, [UNK] is one character."""
    out, at = [], 0
    for t in tokens:
        n = 1 if t == "[UNK]" else len(t) - 2 if t.startswith("##") else len(t)
        out.append((at, at + n))
        at += n
    return out


SPANS = "array<struct<start:int,end:int,category:string,confidence:double>>"


def decode_tags(tags: Column, starts: Column, ends: Column) -> Column:
    """Entities of the tags of a sentence's tokens, as a fold: B and S close what is open, a fitting I goes on, another I
    opens anew; labels beyond the known ones are dropped."""
    names = F.create_map(*[F.lit(x) for kv in NER_CATEGORIES.items() for x in kv])
    sure = F.create_map(*[F.lit(x) for kv in NER_CONFIDENCE.items() for x in kv])
    row = F.arrays_zip(tags.alias("tag"), starts.alias("a"), ends.alias("b")).cast("array<struct<tag:string,a:int,b:int>>")

    def entity(name: Column, a: Column, b: Column) -> Column:
        category = F.element_at(names, name)
        return F.array(F.struct(a.alias("start"), b.alias("end"), category.alias("category"), F.element_at(sure, category).alias("confidence"))).cast(SPANS)

    def step(acc: Column, t: Column) -> Column:
        kind, name = F.substr(t["tag"], F.lit(1), F.lit(2)), F.substr(t["tag"], F.lit(3))
        known = F.element_at(names, name).isNotNull()
        goes_on = (kind == "I-") & acc["name"].isNotNull() & (name == acc["name"])
        closes = acc["name"].isNotNull() & kind.isin("B-", "S-", "I-") & ~goes_on
        out = F.when(closes, F.concat(acc["out"], entity(acc["name"], acc["a"], acc["b"]))).otherwise(acc["out"])
        out = F.when((kind == "S-") & known, F.concat(out, entity(name, t["a"], t["b"]))).otherwise(out)
        opens = kind.isin("B-", "I-") & ~goes_on & known
        now = F.when(opens, name).when(goes_on | ~kind.isin("B-", "S-", "I-"), acc["name"])
        a = F.when(opens, t["a"]).otherwise(acc["a"])
        b = F.when(opens | goes_on, t["b"]).otherwise(acc["b"])
        return F.struct(now.alias("name"), a.alias("a"), b.alias("b"), out.cast(SPANS).alias("out"))

    zero = F.struct(F.lit(None).cast("string").alias("name"), F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.array().cast(SPANS).alias("out"))
    return F.aggregate(row, zero, step, lambda s: F.when(s["name"].isNull(), s["out"]).otherwise(F.concat(s["out"], entity(s["name"], s["a"], s["b"]))))


def tokenized(rows: DataFrame, vocabulary: dict[str, int], text: str = "text") -> DataFrame:
    """Adds tokens: array of (token, start, end)."""

    @F.pandas_udf("array<struct<token:string,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[dict]:
            tokens = word_pieces(t or "", vocabulary)
            return [{"token": k, "start": a, "end": b} for k, (a, b) in zip(tokens, token_spans(tokens))]

        return texts.map(one) if len(texts) else pd.Series([], dtype=object)

    return rows.withColumn("tokens", run(F.col(text)))


def encoded(rows: DataFrame, vocabulary: dict[str, int], text: str = "text") -> DataFrame:
    """Adds ids, array<int>: [CLS], the tokens that the model sees and [SEP]; a null text is empty."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([token_ids(word_pieces(t or "", vocabulary), vocabulary) for t in texts], dtype=object)

    return rows.withColumn("ids", run(F.col(text)))


@cache
def _session(folder: str):
    import onnxruntime

    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # a task has one core
    return onnxruntime.InferenceSession(str(Path(folder, "ner.onnx")), options, providers=["CPUExecutionProvider"])


def onnx_provider(folder: str) -> Callable[[str], list[dict]]:
    """A provider for arbitrate.findings from a folder with ner.onnx and vocab.txt, which must be on all executors.

    A missing model is reported here, before any document is scanned.
    """
    for name in ("ner.onnx", "vocab.txt"):
        if not Path(folder, name).exists():
            raise FileNotFoundError(f"{Path(folder, name)} is missing; scan without a provider")
    vocabulary = read_vocabulary(Path(folder, "vocab.txt").read_text(encoding="utf-8"))

    def run(text: str) -> list[dict]:
        import json

        import numpy as np

        session = _session(folder)
        meta = session.get_modelmeta().custom_metadata_map
        labels = list(json.loads(meta["label_names"]).values()) if "label_names" in meta else NER_LABELS
        tokens = word_pieces(text, vocabulary)[:NER_MAX_TOKENS]
        ids = np.array([token_ids(tokens, vocabulary)], np.int64)
        logits = session.run(None, {session.get_inputs()[0].name: ids, "attention_mask": np.ones_like(ids)})[0]
        tags = [labels[t] if t < len(labels) else "O" for t in logits[0].argmax(-1)[1 : 1 + len(tokens)]]
        return spans_of(tags, token_spans(tokens))

    return run


def spans_of(tags: list[str], places: list[tuple[int, int]]) -> list[dict]:
    """decode_tags for one sentence, in Python."""
    out: list[dict] = []
    open_: list = []

    def close() -> None:
        if open_:
            category = NER_CATEGORIES[open_[0]]
            out.append({"start": open_[1], "end": open_[2], "category": category, "confidence": NER_CONFIDENCE[category]})
            open_.clear()

    for tag, (a, b) in zip(tags, places):
        kind, _, name = tag.partition("-")
        if kind == "I" and open_ and open_[0] == name:
            open_[2] = b
        elif kind in ("B", "S", "I"):
            close()
            if name in NER_CATEGORIES:
                open_[:] = [name, a, b]
                if kind == "S":
                    close()
    close()
    return out
