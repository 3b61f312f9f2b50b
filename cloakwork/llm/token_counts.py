"""Exact histogram of encoded lengths with suffix sums, which answers every question about a context limit.

Documents are counted by encoded length. Suffix sums run over blocks of neighbouring lengths first (as many rows as the
longest text has blocks) and then inside each block, so no task holds all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import cut, table
from cloakwork.llm.pieces import chunked, codec, model_path

BLOCK = 64


def encoded_lengths(docs: DataFrame, text: str = "text", by: tuple[str, ...] = (), model: str | None = None) -> DataFrame:
    """(by..., n_tokens): the number of ids of each row's whole text, begin and end included. Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model or model_path())
        for batch in batches:
            for lo, hi, texts in chunked(batch, 0):
                counts = one.encode_batch(texts)[1] + 2
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[1:]), pa.array(counts)], names=[*(f"g{i}" for i in range(len(by))), "n_tokens"])

    kinds = [f"g{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(by)]
    rows = docs.select(F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"g{i}") for i, c in enumerate(by)])
    return rows.mapInArrow(run, ", ".join([*kinds, "n_tokens long"])).toDF(*by, "n_tokens")


def length_histogram(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group and length: n_docs, and sums over the documents at least (…_from) and at most (…_to) as long.

    truncated_total is the number of tokens left if every text is cut at n_tokens. Equal rows count as often as they
    occur; an empty table gives no rows; null group values are a group.
    """
    g = [f"g{i}" for i in range(len(by))]
    rows = lengths.toDF(*g, "n").groupBy(*g, "n").agg(F.count("*").alias("docs")).withColumn("block", F.floor(F.col("n") / BLOCK))
    rows = cut(rows)  # used twice; texts are encoded once
    blocks = rows.groupBy(*g, "block").agg(F.sum("docs").alias("bd"), F.sum(F.col("docs") * F.col("n")).alias("bt"))
    whole = Window.partitionBy(*g)
    later = whole.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = blocks.select(*[F.col(c).alias(f"{c}b") for c in g], F.col("block").alias("bb"), zero(F.sum("bd").over(later)).alias("ld"), zero(F.sum("bt").over(later)).alias("lt"), F.sum("bd").over(whole).alias("all_docs"), F.sum("bt").over(whole).alias("all_tokens"))
    same = F.col("block") == F.col("bb")
    for c in g:
        same &= F.col(c).eqNullSafe(F.col(f"{c}b"))
    inside = Window.partitionBy(*g, "block").orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(sums, same)
    met = met.withColumns({"docs_from": F.col("ld") + F.sum("docs").over(inside), "tokens_from": F.col("lt") + F.sum(F.col("docs") * F.col("n")).over(inside)})
    n, docs = F.col("n"), F.col("docs")
    return met.select(
        *[F.col(c).alias(name) for c, name in zip(g, by)],
        n.alias("n_tokens"),
        docs.alias("n_docs"),
        "docs_from",
        "tokens_from",
        (F.col("all_docs") - F.col("docs_from") + docs).alias("docs_to"),
        (F.col("all_tokens") - F.col("tokens_from") + docs * n).alias("tokens_to"),
        (F.col("all_tokens") - F.col("tokens_from") + n * F.col("docs_from")).alias("truncated_total"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, docs_cut, truncated_total) for any limits, of a histogram without groups, in one pass over it."""
    totals = []
    for x in limits:
        over = F.col("n_tokens") > x
        kept = F.least("n_tokens", F.lit(x)) * F.col("n_docs")
        cut_docs = F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0))
        totals.append(F.struct(F.lit(x).cast("long").alias("context_limit"), cut_docs.alias("docs_cut"), F.coalesce(F.sum(kept), F.lit(0)).alias("truncated_total")))
    return histogram.agg(F.array(*totals).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least this share of all documents does not exceed."""
    total = F.col("docs_from") + F.col("docs_to") - F.col("n_docs")
    picks = [F.struct(F.lit(q).alias("share"), F.min(F.when(F.col("docs_to") >= F.ceil(F.lit(q) * total), F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return histogram.agg(F.array(*picks).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths of all documents, with its sums for every length as a context limit."""
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents")))


LIMITS, SHARES = [2**k for k in range(6, 18)], [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def token_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, at, n, total): from the histogram, for context limits the documents cut and the tokens left, and quantiles."""
    histogram = cut(op9_token_counts(spark, sf_dir))
    limits = at_limits(histogram, LIMITS).select(F.lit("limit").alias("kind"), F.col("context_limit").cast("double").alias("at"), F.col("docs_cut").alias("n"), F.col("truncated_total").alias("total"))
    shares = quantiles(histogram, SHARES).select(F.lit("quantile").alias("kind"), F.col("share").alias("at"), F.col("n_tokens").alias("n"), F.lit(None).cast("long").alias("total"))
    return limits.unionByName(shares)


QUERIES = {"op9_token_counts": op9_token_counts, "token_limits": token_limits}
ORACLES: dict[str, str] = {}
