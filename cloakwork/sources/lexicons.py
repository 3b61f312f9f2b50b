"""Word lists and gold samples from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.evaluate import parse_gold


def terms(lines: DataFrame, line: str = "value") -> DataFrame:
    """Stripped lines without blank ones and those that begin with #."""
    word = F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    return lines.withColumn("term", word).filter((F.col("term") != "") & ~F.startswith("term", F.lit("#")))


def load_terms(spark: SparkSession, path: str) -> list[str]:
    """The words of one file in its order; none if the file is missing. A word list is a driver-side parameter."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "value"))
    return [r.term for r in terms(whole).orderBy("n").collect()]


def load_gold(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(sample_id, text, label) of JSON lines, the first `limit` of the file if given."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n+\z", ""), "\n")).alias("sample_id", "value"))
    whole = whole.filter(F.col("sample_id") < limit) if limit is not None else whole
    return parse_gold(whole).drop("value")
