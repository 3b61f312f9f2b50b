"""Document fingerprints: invertible Bloom lookup sketches of a text's paragraphs.

A paragraph is a line, cut further behind the ends of sentences; its digest is 64 bits of XXH3 (with the number of the repeat,
so repeats count). Each digest is added to one cell in each third of the sketch: a count, the sum of digests and the sum of
check values, both modulo 2**64. Sketches of two versions subtract cell by cell; cells left with a single digest give it
back and are peeled until the sketch is empty, which recovers just the digests that differ. Where peeling stops early,
both sketches are made again with four times the cells.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cloakwork.llm.common import partitions, table

CELLS = 24
GROWTH = 4
CHUNK = 4 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def paragraphs(text: str) -> list[str]:
    for mark in (". ", "! ", "? "):
        text = text.replace(mark, mark + "\n")
    return [p for p in text.split("\n") if p]


def digests(text: str) -> np.ndarray:
    """One 64-bit digest for each paragraph; the second and later repeats have their own."""
    found = np.array([xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in paragraphs(text)], np.uint64)
    if len(found) > 1:
        order = np.argsort(found, kind="stable")
        s = found[order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        if not new.all():
            nth = np.arange(len(s)) - np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
            found[order] = np.where(nth > 0, _mix(s + nth.astype(np.uint64) * _M2), s)
    return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _cells(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each key in each third; another size gives unrelated places."""
    third = cells // 3
    return [(_mix(keys + np.uint64(cells * 8 + j)) % np.uint64(third)).astype(np.int64) + j * third for j in range(3)]


class Sketches:
    """One sketch per row: arrays (rows, cells) of counts, sums of keys and sums of checks."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, n: int, cells: int) -> None:
        self.cells = cells
        self.count = np.zeros(n * cells, np.int64)
        self.key, self.check = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
        self._add(keys, rows, np.ones(len(keys), np.int64))

    def _add(self, keys: np.ndarray, rows: np.ndarray, sign: np.ndarray) -> None:
        check, s = _mix(keys ^ _M2), sign.astype(np.uint64)
        for c in _cells(keys, self.cells):
            at = rows * self.cells + c
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, keys * s)
            np.add.at(self.check, at, check * s)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, self.cells)
        out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, rows, signs) that come out, and whether each row came out whole. Empties the sketch."""
        keys, rows, signs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        look = np.arange(len(self.count))
        while True:
            one = look[np.abs(self.count[look]) == 1]
            sign = self.count[one]
            key = self.key[one] * sign.astype(np.uint64)
            pure = self.check[one] * sign.astype(np.uint64) == _mix(key ^ _M2)
            if not pure.any():
                break
            key, sign, row = key[pure], sign[pure], one[pure] // self.cells
            order = np.lexsort((key, row))
            key, sign, row = key[order], sign[order], row[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
            key, sign, row = key[new], sign[new], row[new]
            self._add(key, row, -sign)
            keys.append(key)
            rows.append(row)
            signs.append(sign)
            look = np.unique(np.concatenate([row * self.cells + c for c in _cells(key, self.cells)]))
        whole = ~((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(-1, self.cells).any(axis=1)
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(signs), whole

    def strings(self, sizes: list[int]) -> list[str]:
        """Each sketch as text: paragraphs, cells, and the cells' values in base64 (counts and sums, little-endian)."""
        raw = np.empty((len(self.count), 20), np.uint8)
        raw[:, :4] = self.count.astype("<i4").view(np.uint8).reshape(-1, 4)
        raw[:, 4:12] = self.key.astype("<u8").view(np.uint8).reshape(-1, 8)
        raw[:, 12:] = self.check.astype("<u8").view(np.uint8).reshape(-1, 8)
        raw = raw.reshape(-1, self.cells * 20)
        return [f"{n}:{self.cells}:" + base64.b64encode(x.tobytes()).decode() for n, x in zip(sizes, raw)]


def sketches(sets: list[np.ndarray], cells: int = CELLS) -> Sketches:
    rows = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    return Sketches(np.concatenate([*sets, np.zeros(0, np.uint64)]), rows, len(sets), cells)


def differences(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair the digests only in a and only in b, recovered from subtracted sketches, larger where need be."""
    out: list = [None] * len(a)
    left = np.arange(len(a))
    while len(left):
        keys, rows, signs, whole = sketches([a[i] for i in left], cells).minus(sketches([b[i] for i in left], cells)).peel()
        order = np.argsort(rows, kind="stable")
        keys, signs, edges = keys[order], signs[order], np.searchsorted(rows[order], np.arange(len(left) + 1))
        for r in np.nonzero(whole)[0]:
            k, s = keys[edges[r] : edges[r + 1]], signs[edges[r] : edges[r + 1]]
            out[left[r]] = (k[s > 0], k[s < 0])
        left = left[~whole]
        cells *= GROWTH
    return out


def likeness(a: np.ndarray, b: np.ndarray, apart: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the paragraphs of both that both have; 1 for two texts without paragraphs."""
    total = len(a) + len(b)
    return 1.0 if not total else 1.0 - (len(apart[0]) + len(apart[1])) / total


def _bucket(cuts: list[int]) -> Callable[[Column], Column]:
    """A function of a key column: how many of the sorted cuts are at most the key, found by bisection."""
    edges = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def run(keys: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(edges, keys.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return run


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, bucket, extra): rows dealt into ranges of the key, one range a partition, and sorted downwards in each,
    so that the next row in a task's stream is the next document. The first document of the range below comes last in each
    range, marked extra; below the lowest range comes the highest document. Equal keys are ordered by text, null keys
    are below all others. Texts move once. The key is an integer; another type is an error.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be an integer to have a next document")
    rank = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    rows = docs.select(F.col(key).cast("long").alias("key"), rank.alias("rank"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = max(2, partitions(docs.sparkSession))
    cuts = docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)
    cuts = sorted({int(c) for c in cuts})
    bucket = _bucket(cuts)
    tops = docs.select(rank.alias("rank")).select("rank", bucket("rank").alias("b")).groupBy("b").agg(F.max("rank").alias("top")).orderBy("b").collect()
    above = [tops[i + 1].b if i + 1 < len(tops) else tops[0].b for i in range(len(tops))]
    bring = docs.sparkSession.createDataFrame([(t.top, b) for t, b in zip(tops, above)], "top long, to int")  # as many as there are ranges
    rows = rows.withColumn("bucket", bucket("rank")).join(F.broadcast(bring), F.col("rank") == F.col("top"), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra"))
    also = F.when(F.col("to").isNotNull(), F.array(own, F.struct(F.col("to").alias("bucket"), F.lit(1).alias("extra")))).otherwise(F.array(own))
    dealt = rows.select("key", "text", F.explode(also).alias("x")).select("key", "text", "x.bucket", "x.extra")
    return dealt.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "extra", F.col("key").desc_nulls_last(), "text")


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many, or all, of the following text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", cells: int = CELLS) -> DataFrame:
    """One row per row of `docs`: its sketch, that of its edited text, and their and its next document's likeness.

    Null is the empty text, whose sketch has no paragraphs. A lone document is its own next one. Repeated rows each have
    a row. Texts stream by, some megabytes at once, however many there are in a range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[1])
                if size > CHUNK and len(held) > 1:
                    yield from _judge(held, cells)
                    held, size = held[-1:], len(held[-1][1])
        yield from _judge(held, cells)

    schema = "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_recovered long"
    return with_next(docs, key, text).mapInArrow(run, schema).withColumnRenamed("key", key)


def _judge(held: list[tuple], cells: int) -> Iterator[pa.RecordBatch]:
    pairs = [(a, b) for a, b in zip(held, held[1:]) if not a[3] and a[2] == b[2]]
    if not pairs:
        return
    own = {id(x): digests(x[1]) for x in {id(x): x for p in pairs for x in p}.values()}
    changed = [edited(a[1], b[1]) for a, b in pairs]
    now, new, following = [own[id(a)] for a, _ in pairs], [digests(t) for t in changed], [own[id(b)] for _, b in pairs]
    d_new, d_next = differences(now, new, cells), differences(now, following, cells)
    out = {
        "key": pa.array([a[0] for a, _ in pairs], pa.int64()),
        "n_chars": pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array(sketches(now, cells).strings(list(map(len, now))), pa.string()),
        "edited_fingerprint": pa.array(sketches(new, cells).strings(list(map(len, new))), pa.string()),
        "near_edited": pa.array(list(map(likeness, now, new, d_new)), pa.float64()),
        "near_next": pa.array(list(map(likeness, now, following, d_next)), pa.float64()),
        "n_recovered": pa.array([len(x) + len(y) for x, y in d_new], pa.int64()),
    }
    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch beside those of its edited text and of the next document."""
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op2_fingerprints": op2_fingerprints}
ORACLES: dict[str, str] = {}
