"""Near duplicates by SimHash fingerprints, linked through Golay codewords.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints link when at
most four of their 64 bits differ. To find the links without comparing all pairs, the 64 bits are three segments of
23, 23 and 18 bits (the last padded to 23 by zeros). The binary Golay code of length 23 is perfect: each 23-bit word
lies within three bits of just one of 4096 codewords. near(s) is the set of codewords that s or a word one bit away
from s decodes to, six at most.

Four errors over three segments leave two segments with two errors together at most (pigeonhole), hence one of
* both have one error at most: the codeword of s lies in near(s') in both segments ("one" keys against "many" keys);
* one has none, one has two, and then the third has two: one segment is equal and in another the word half way
  decodes to a codeword in both near sets ("even" keys, on both sides).
Keys that meet are joined and the pair is verified on all 64 bits. No pair within four bits is missed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import cut, dealt, fresh_name, look_up, table

SEED = 42
MAX_BITS = 4
#: (shift, width) of the segments in the fingerprint.
SEGMENTS = ((41, 23), (18, 23), (0, 18))
#: Fixed value: a generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011
_PIECE = 1 << 18


def shingle_hashes(text: bytes, words: int = 4) -> Iterator[np.ndarray]:
    """XXH64 digests (rows of eight bytes) of the word shingles, in pieces of bounded size. None without words."""
    tokens = text.lower().split()  # on bytes: A-Z and the six ASCII spaces only
    size = max(1, len(tokens) - words + 1) if tokens else 0
    digest = xxhash.xxh64_digest
    for lo in range(0, size, _PIECE):
        n = min(_PIECE, size - lo)
        part = tokens[lo : lo + n + words - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        last = ends[min(words, len(part)) - 1 :][:n]
        raw = b"".join([digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())])
        yield np.frombuffer(raw, np.uint8).reshape(n, 8)


def majority(pieces: Iterable[np.ndarray]) -> bytes:
    """Eight bytes, the highest bit first: the bits set in over half of the digests; zeros for none."""
    ones, size = np.zeros(64, np.int64), 0
    for digests in pieces:
        ones += np.unpackbits(digests, axis=1).sum(axis=0, dtype=np.int64)
        size += len(digests)
    return np.packbits(2 * ones > size).tobytes()


def fingerprint(text: bytes, words: int = 4) -> bytes:
    """The majority of a text's shingles; zeros for a text without words. Any length of text, in bounded memory."""
    return majority(shingle_hashes(text, words))


def with_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, fp): one row per document, fp a signed 64-bit integer with the fingerprint's bits. Null text: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", words) for x in batch.column(1)])
            fps = pa.array(np.frombuffer(raw, ">u8").astype(np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, fp long")


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndrome of the high 12 and low 11 bits, and the error pattern of each syndrome."""

    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    high = np.array([remainder(i << 11) for i in range(4096)], np.int32)
    low = np.arange(2048, dtype=np.int32)
    errors = np.zeros(2048, np.int32)
    ones = [1 << i for i in range(23)]
    patterns = [0, *ones, *(a | b for a in ones for b in ones if a < b), *(a | b | c for a in ones for b in ones for c in ones if a < b < c)]
    for e in patterns:
        errors[high[e >> 11] ^ low[e & 2047]] = e
    return high, low, errors


def codeword(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the one Golay codeword within three bits of each 23-bit word."""
    high, low, errors = _syndromes()
    return (words ^ errors[high[words >> 11] ^ low[words & 2047]]) >> 11


def near(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codewords of each word and of its neighbours in `width` bits: an (n, width + 1) array and the mask of first ones."""
    flips = np.concatenate(([0], 1 << np.arange(width))).astype(np.int32)
    found = np.sort(codeword(words[:, None] ^ flips[None, :]), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, first


def _keys(fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(side, row, key): side 0 are the "one" keys, 1 the "many" keys, 2 the "even" keys."""
    rows = np.arange(len(fps))
    parts = [((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int32) for shift, width in SEGMENTS]
    own = [codeword(p).astype(np.int64) for p in parts]
    around = [near(p, width) for p, (_, width) in zip(parts, SEGMENTS)]
    for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        head = np.int64(k) << 40
        yield 0, rows, head | own[i] << 12 | own[j]
        (a, keep_a), (b, keep_b) = around[i], around[j]
        keep = keep_a[:, :, None] & keep_b[:, None, :]
        at = np.nonzero(keep)
        yield 1, at[0], head | a[at[0], at[1]].astype(np.int64) << 12 | b[at[0], at[2]]
    for k, (i, j) in enumerate(((0, 1), (1, 0), (2, 0))):
        b, keep = around[j]
        at = np.nonzero(keep)
        yield 2, at[0], np.int64(3 + k) << 40 | parts[i][at[0]].astype(np.int64) << 12 | b[at]


def _key_rows(fps: DataFrame, sides: dict[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(values), 2000):
                part = values[lo : lo + 2000]
                for side, at, key in _keys(part.view(np.uint64)):
                    if side in sides:
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[at])], names=["k", "fp"])

    return fps.select("fp").mapInArrow(run, "k long, fp long")


#: One fingerprint in SAMPLE shows which keys are hot: those of over HOT fingerprints, and of a part in PARTS of all rows.
SAMPLE, HOT, PARTS = 64, 2048, 100_000


def _hot_keys(fps: DataFrame) -> DataFrame | None:
    """(k): keys that many fingerprints have, or None. By a sample, which only decides how their links are found."""
    some = cut(_key_rows(fps.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0), {0: 0, 1: 1, 2: 2}).groupBy("k").agg(F.count("*").alias("n")).filter("n > 3"))
    rows = some.agg(F.sum("n")).first()[0] or 0
    hot = some.filter(F.col("n") >= max(HOT // SAMPLE, rows // PARTS)).select("k")  # fewer than PARTS
    return hot if hot.limit(1).count() else None


def _close(u: str, v: str) -> Column:
    return F.bit_count(F.col(u).bitwiseXOR(F.col(v))) <= MAX_BITS


def _adjacent(rows: DataFrame) -> DataFrame:
    """(u, v): fingerprints of one key k that are close and follow each other in the order of (k, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = (np.zeros(0, np.int64),) * 2
        for batch in batches:
            k, fp = [np.concatenate((b, c.to_numpy(zero_copy_only=False))) for b, c in zip(before, batch.columns)]
            at = np.nonzero((k[1:] == k[:-1]) & (fp[1:] != fp[:-1]) & (np.bitwise_count((fp[1:] ^ fp[:-1]).view(np.uint64)) <= MAX_BITS))[0]
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[at + 1])], names=["u", "v"])
            before = k[-1:], fp[-1:]

    return rows.select("k", "fp").repartitionByRange("k", "fp").sortWithinPartitions("k", "fp").mapInArrow(run, "u long, v long").distinct()


def _hot_links(rows: DataFrame) -> DataFrame:
    """(u, v) that link the fingerprints of hot keys as all their links would. rows: k, fp, side.

    Neighbours in order are linked first, which joins most of a large group. Then fingerprints outside a key's largest
    component meet the others of the key: no pairs are made within a component, and none within a large group.
    """
    first = cut(_adjacent(rows))
    roots = components(first)
    placed = look_up(rows, _weighted(roots, rows), ["fp"], "w").select("k", "fp", "side", F.coalesce("root", "fp").alias("root"))
    placed = cut(placed)
    sizes = placed.groupBy("k", "root").agg(F.count("*").alias("c"))
    keys = sizes.groupBy("k").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.count("*").alias("parts"), F.sum("c").alias("w")).filter("parts > 1")
    mixed = cut(look_up(placed, cut(keys.drop("parts")), ["k"], "w").filter("found"))
    few = mixed.filter("root <> most").select(F.col("k").alias("ku"), F.col("fp").alias("u"), F.col("root").alias("ru"), F.col("side").alias("su"))
    many = mixed.select(F.col("k").alias("kv"), F.col("fp").alias("v"), F.col("root").alias("rv"), F.col("side").alias("sv"))
    meets = (F.col("ku") == F.col("kv")) & (F.col("ru") != F.col("rv")) & _close("u", "v")
    return first.union(few.join(many, meets).select("u", "v").distinct())


def _weighted(roots: DataFrame, rows: DataFrame) -> DataFrame:
    """(fp, root, w): the roots of fingerprints with the number of rows that each has."""
    counts = rows.groupBy("fp").agg(F.count("*").alias("w"))
    return cut(roots.select(F.col("node").alias("fp"), "root").join(counts, "fp"))


def links(fps: DataFrame) -> DataFrame:
    """(u, v): pairs of the distinct fingerprints in column fp that differ in at most four bits.

    All such pairs, but for those that meet in a hot key alone: of these as many as give the same components. Keys have
    24 bits and more of a fingerprint, so far more than 10**8 distinct fingerprints meet by chance in every key, and
    candidates then grow with their square over 2**24.
    """
    fps = cut(dealt(fps.select("fp"), "fp"))
    hot = _hot_keys(fps)
    left, right = _key_rows(fps, {0: 0, 2: 2}).toDF("k", "u"), _key_rows(fps, {1: 1, 2: 2}).toDF("k", "v")
    if hot is not None:
        hot = F.broadcast(cut(hot))
        left, right = (x.join(hot, "k", "left_anti") for x in (left, right))
    pairs = left.hint("merge").join(right, (left["k"] == right["k"]) & (F.col("u") < F.col("v")) & _close("u", "v")).select("u", "v")
    if hot is not None:
        sides = [_key_rows(fps, {s: s}).join(hot, "k", "left_semi").withColumn("side", F.lit(s)) for s in (0, 1, 2)]
        pairs = pairs.union(_hot_links(cut(sides[0].unionByName(sides[1]).unionByName(sides[2]))))
    return pairs.distinct()


#: Fewer edges than this are little work for one task, whatever star they form.
FEW_EDGES = 1 << 18


def _with_least(edges: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """Edges (u, v) with m, the least node of u's star. A star that holds a large part of many edges is not one task's."""
    if n < FEW_EDGES:
        return edges.join(least.drop("w"), "u")
    return look_up(edges, cut(least), ["u"], "w", 1000, n)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (u, v) reaches.

    Alternates large and small stars until the edges stay as they are, which takes a number of rounds that grows with
    the logarithm of the longest path. Nothing but counts and a checksum comes to the driver.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not mark[0] or mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, n = mark, 2 * mark[0]
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w")).select("u", F.least("u", "m").alias("m"), "w")
        large = _with_least(both, least, n).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large) if n >= FEW_EDGES else large
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("w"))
        small = _with_least(large, least, n).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        small = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter(F.col("u") != F.col("v"))
        edges = cut(small.distinct())


def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(fp, component_id, docs): the smallest key of each fingerprint's component. nodes: fp, least, docs."""
    known = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "docs", F.coalesce("root", "fp").alias("root"))
    known = cut(known)
    ids = cut(known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("w")))
    return look_up(known, ids, ["root"], "w", 1000).select("fp", "component_id", "docs")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(key, fingerprint, component_id): one row per row of `docs`.

    component_id is the smallest key reachable by links, a row's own included. Equal fingerprints are one node, so
    copies cost no pairs. A null text has fingerprint zero, as a text without words has; all these link. Rows with a
    null key take part, and a component of null keys alone has a null id. Repeated rows stay. An empty table gives none.
    """
    rows = cut(with_fingerprints(docs, key, text, words))
    nodes = cut(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("docs")))
    labels = cut(labelled(nodes, components(links(nodes))))
    done = look_up(rows, labels, ["fp"], "docs", 1000)
    return done.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def smallest_of_each(docs: DataFrame, marked: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of `docs` that are the smallest key of their component in `marked` (key, component_id), as they are.

    Rows with equal key and text count as one. Rows with a null key stay only where no row of their component has a key.
    """
    stay_, hash_ = fresh_name("stay"), fresh_name("hash")
    stay = marked.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias(stay_)).distinct()
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.withColumn(hash_, F.struct(F.xxhash64(whole), F.xxhash64(F.lit("2"), whole)))
    kept = rows.join(stay, F.col(key).eqNullSafe(F.col(stay_)), "left_semi")
    return kept.dropDuplicates([key, hash_]).select(*docs.columns)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """The rows of `docs` that are the smallest key of their component of near_duplicates; see smallest_of_each."""
    return smallest_of_each(docs, near_duplicates(docs, key, text, words), key, text)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id of its component."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict[str, str] = {}
