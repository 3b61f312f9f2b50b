"""Recognition measured against gold spans: exact span sets, precision, recall, F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.fixed import ENTITIES, NER_CATEGORIES

GOLD = "text string, label map<string, map<string, array<array<int>>>>"


def parse_gold(lines: DataFrame, line: str = "value") -> DataFrame:
    """(…, text, label) from JSON lines; lines that are no JSON have nulls."""
    return lines.withColumn("_g", F.from_json(line, GOLD)).select(*lines.columns, F.col("_g.text").alias("text"), F.col("_g.label").alias("label"))


def gold_spans(samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, category, start, end): distinct spans, end exclusive; labels beyond the four categories are left out."""
    names = F.create_map(*[F.lit(x) for kv in NER_CATEGORIES.items() for x in kv])
    labels = samples.select(key, F.explode("label").alias("label", "entities")).select(key, F.element_at(names, F.col("label")).alias("category"), "entities")
    spans = labels.filter(F.col("category").isNotNull()).select(key, "category", F.explode("entities").alias("e", "spans")).select(key, "category", F.explode("spans").alias("s"))
    return spans.select(key, "category", F.get("s", F.lit(0)).alias("start"), (F.get("s", F.lit(1)) + 1).alias("end")).distinct()


def predicted_spans(found: DataFrame, key: str = "sample_id") -> DataFrame:
    """Distinct spans of the four categories, pending ones included."""
    return found.filter(F.col("category").isin(*ENTITIES)).select(key, "category", "start", "end").distinct()


def ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def scores(gold: DataFrame, predicted: DataFrame, key: str = "sample_id") -> DataFrame:
    """(category, tp, fp, fn, precision, recall, f1), one row for each category that occurs; one full outer join."""
    on = [key, "category", "start", "end"]
    met = gold.withColumn("g", F.lit(1)).join(predicted.withColumn("p", F.lit(1)), on, "full_outer")
    count = lambda c: F.count(F.when(c, 1))
    sums = met.groupBy("category").agg(count(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), count(F.col("g").isNull()).alias("fp"), count(F.col("p").isNull()).alias("fn"))
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumns({"precision": precision, "recall": recall}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
