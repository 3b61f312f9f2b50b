"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.lineage import cut, remove, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The number of partitions that this session shuffles into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows spread evenly by their keys, for work that makes many rows or much of each; AQE leaves them spread."""
    return df.repartition(partitions(df.sparkSession), *keys)


class Steps:
    """Results of steps, written as Parquet to a folder of the shared one and removed as soon as they are done with.

    Lost executors cost only the step that runs: what a step has written is read again. While a step runs, Spark removes
    the shuffle files of each finished query, which nothing reads any more.
    """

    _CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_dir(spark).rstrip('/')}/{fresh_name('steps')}"
        self.paths: dict[int, tuple[str, DataFrame]] = {}
        self.made = 0

    def __enter__(self) -> Steps:
        self.before = self.spark.conf.get(self._CLEAN, "false")
        self.spark.conf.set(self._CLEAN, "true")
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self._CLEAN, self.before)

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows, written and read again."""
        self.made += 1
        path = f"{self.folder}/{self.made}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def leave(self, *steps: DataFrame) -> None:
        """The files of all other steps go: nothing reads them any more."""
        stay = {id(s) for s in steps}
        for name in [n for n in self.paths if n not in stay]:
            remove(self.spark, self.paths.pop(name)[0])


def fresh_name(stem: str) -> str:
    """A column name that no input column can clash with by chance."""
    return f"_{stem}_{uuid.uuid4().hex[:8]}"


def split_by_bytes(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [lo, hi) of neighbouring rows with at most `limit` bytes each (or one row)."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def look_up(big: DataFrame, small: DataFrame, keys: list[str], weight: str, parts: int = 10_000, total: int | None = None) -> DataFrame:
    """Left join of `big` with `small` on `keys`, even where a key holds a large share of `big`.

    `small` has one row per key, with the number of rows that the key has in `big` in `weight`; read twice, it should be
    cheap. total: the sum of the weights, if it is known. Keys with over 1/parts of the sum of weights are fewer than `parts` whatever the input, so they are broadcast.
    The others join by shuffle, each with 1/parts of the rows at most; rows that are already served get a key that
    spreads them and meets nothing. One pass over `big`, no row left out. Columns of `small` come back as they are.
    """
    values = [c for c in small.columns if c not in keys and c != weight]
    total = (small.agg(F.sum(weight)).first()[0] or 0) if total is None else total
    least = total // parts + 1
    packed = small.select(*keys, F.struct(F.lit(True).alias("_hit"), *values).alias("_v"), F.col(weight).alias("_w"))
    heavy = packed.filter(F.col("_w") >= least).select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("_v").alias("_hot"))
    light = packed.filter(F.col("_w") < least).select(*[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)], F.col("_v").alias("_cool"))
    on_heavy = [F.col(k) == F.col(f"_h{i}") for i, k in enumerate(keys)]
    marked = big.join(F.broadcast(heavy), on_heavy, "left").drop(*[f"_h{i}" for i in range(len(keys))])
    served = F.col("_hot").isNotNull()
    marked = marked.withColumns({f"_k{i}": F.when(~served, F.col(k)) for i, k in enumerate(keys)})
    marked = marked.withColumn("_spread", F.when(served, F.xxhash64(*big.columns)).otherwise(F.lit(0)))
    on_light = [F.col(f"_k{i}") == F.col(f"_l{i}") for i in range(len(keys))] + [F.col("_spread") == F.col("_none")]
    done = marked.join(light.withColumn("_none", F.lit(0).cast("long")).hint("merge"), on_light, "left")
    found = F.coalesce("_hot", "_cool")
    return done.select(*big.columns, F.coalesce(found["_hit"], F.lit(False)).alias("found"), *[found[c].alias(c) for c in values])


def least_hashed(keys: DataFrame, limit: int, key: str = "k") -> DataFrame:
    """The `limit` rows with the least hashes of their key; keys are distinct.

    Only keys with hashes under a bound, some twice as many as are taken (300 more for few), meet in one task.
    """
    h = F.xxhash64(key)
    n, some = keys.count(), 2 * limit + 300
    if n > some:
        keys = keys.filter(h / 2.0**64 + 0.5 < some / n)
    return keys.orderBy(h, key).limit(limit)


def upper_to_lower(c: Column) -> Column:
    """A-Z to a-z, all other characters as they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's text, modulo n."""
    return F.crc32(key.cast("string").cast("binary")) % n
