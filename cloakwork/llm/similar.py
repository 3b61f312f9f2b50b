"""Near duplicates by similarity of word shingles: SimHash links first, then what four bits leave apart.

Texts of five-word shingles with a Jaccard similarity of 0.8 differ in some ten of 64 SimHash bits, where no keys of
Golay codewords are both few and selective. So the links of simhash.links (four bits) join copies and light edits, and
the rest is found by bands of shingle minima: two sets of similarity J share one of 20 bands of 5 with probability
1 - (1 - J^5)^20, which is 0.9996 at 0.8. Each candidate is verified on the whole sets of shingles.

A bucket may hold a third of all texts, so its pairs are never listed. Neighbours in the order of (bucket, set) are
verified first, which joins most of a large group. Sets in buckets that still hold several components are then compared
by their rarest shingles (prefix and position filters, which lose no pair): texts that share a passage but are not
similar, however many, meet in its frequent shingles, which are not among these. No pairs are listed within a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import Steps, cut, look_up
from cloakwork.llm.simhash import SEED, components, links, majority, shingle_hashes, smallest_of_each

#: Writes the rows of a step and reads them again.
Keep = Callable[[DataFrame], DataFrame]

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Shingles hashed for minima at once, hashes in one batch of sets, and the most of a set with 16 leading bits of each.
_BLOCK, _BATCH, _SMALL = 4096, 1 << 18, 1 << 12


@cache
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of the BANDS * ROWS hash functions."""
    rng = np.random.default_rng(SEED)
    masks, factors = rng.integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
    return masks, factors | np.uint64(1)


def shingle_set(pieces: list[np.ndarray]) -> np.ndarray:
    """The distinct digests in order, as unsigned integers."""
    return np.unique(np.concatenate([p.reshape(-1) for p in pieces]).view(">u8").astype(np.uint64)) if pieces else np.zeros(0, np.uint64)


def set_id(hashes: np.ndarray) -> bytes:
    """128 bits: sets with one id are taken for equal."""
    return xxhash.xxh3_128_digest(hashes.tobytes(), SEED)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    masks, factors = _hashes()
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), _BLOCK):
        mixed = (hashes[None, lo : lo + _BLOCK] ^ masks) * factors
        mixed ^= mixed >> np.uint64(31)
        mixed *= factors
        np.minimum(least, mixed.min(axis=1), out=least)
    raw = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(raw[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def _described(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, th, id, fp, n, bands): a hash of each row's text, the id and size of its shingle set, its fingerprint and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, fps, sizes, bands = [], [], [], []
            for x in batch.column(2):
                pieces = list(shingle_hashes(x.as_buffer().to_pybytes() if x.is_valid else b"", words))
                hashes = shingle_set(pieces)
                ids.append(set_id(hashes))
                fps.append(majority(pieces))
                sizes.append(len(hashes))
                bands.append(band_keys(hashes))
            fp = pa.array(np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), fp, pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["key", "th", "id", "fp", "n", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return _texts(docs, key, text).mapInArrow(run, f"key {kind}, th long, id binary, fp long, n long, bands array<long>")


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, text): each row's text in binary, and a hash of it."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).alias("key"), F.xxhash64(whole).alias("th"), whole.cast("binary").alias("text"))


def brief(hashes: np.ndarray) -> bytes:
    """The leading bits of each digest, in order: 16 of a smaller set's, 32 of a larger one's."""
    return (hashes >> np.uint64(48)).astype("<u2").tobytes() if len(hashes) <= _SMALL else (hashes >> np.uint64(32)).astype("<u4").tobytes()


def most_common(a: bytes, n: int, b: bytes, m: int) -> int:
    """No fewer than the digests that two sets of n and m digests share: what their leading bits have in common."""
    x, y = (np.frombuffer(v, "<u2" if k <= _SMALL else "<u4") for v, k in ((a, n), (b, m)))
    if x.dtype != y.dtype:
        x, y = (v if v.dtype.itemsize == 2 else (v >> np.uint32(16)).astype("<u2") for v in (x, y))
    (u, c), (w, d) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    at = np.minimum(np.searchsorted(u, w), len(u) - 1)
    return int(np.minimum(c[at], d)[u[at] == w].sum()) if len(u) else 0


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(s, hashes, brief) of rows (s, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(who: list, found: list[np.ndarray]) -> pa.RecordBatch:
            columns = [pa.array(who, pa.int64()), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())), pa.array(list(map(brief, found)), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["s", "hashes", "brief"])

        for batch in batches:
            found, who, size = [], [], 0
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                who.append(s)
                found.append(shingle_set(list(shingle_hashes(x.as_buffer().to_pybytes(), words))))
                size += len(found[-1])
                if size > _BATCH:
                    yield packed(who, found)
                    found, who, size = [], [], 0
            if found:
                yield packed(who, found)

    return texts.select("s", "text").mapInArrow(run, "s long, hashes array<long>, brief binary")


#: What describes the two sets u and v of a pair: fingerprints and sizes.
_PAIR = ["u", "v", "fu", "fv", "nu", "nv"]


def _near_size(similarity: float) -> Column:
    return F.least("nu", "nv") >= F.greatest("nu", "nv") * F.lit(similarity - 1e-9)


def _neighbours(members: DataFrame, similarity: float) -> DataFrame:
    """_PAIR: sets of one bucket k in different components that follow each other in the order of (k, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = (np.zeros(0, np.int64),) * 5
        for batch in batches:
            k, s, root, fp, n = columns = [np.concatenate((b, c.to_numpy(zero_copy_only=False))) for b, c in zip(before, batch.columns)]
            at = np.nonzero((k[1:] == k[:-1]) & (root[1:] != root[:-1]))[0]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s[at], s[at + 1], fp[at], fp[at + 1], n[at], n[at + 1])], names=_PAIR)
            before = tuple(x[-1:] for x in columns)

    rows = members.select("k", "s", "root", "fp", "n").repartitionByRange("k", "s").sortWithinPartitions("k", "s")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in _PAIR)).filter(_near_size(similarity)).distinct()


def _enough(common: Column, similarity: float) -> Column:
    return common >= (F.col("nu") + F.col("nv") - common) * F.lit(similarity) - 1e-9


def _alike(known: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v), fingerprints: the pairs of `known` whose similarity is high enough.

    The leading bits of the digests bound what two sets share from above. Few pairs stay; only for these do whole sets move.
    """

    @F.arrow_udf("int")
    def bound(a: pa.Array, n: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array([most_common(*row) for row in zip(*(c.to_pylist() for c in (a, n, b, m)))], pa.int32())

    short = sets.select("s", "brief")
    near = known.join(short.toDF("u", "a"), "u").join(short.toDF("v", "b"), "v").withColumn("c", bound("a", "nu", "b", "nv"))
    near = cut(near.filter(_enough(F.col("c"), similarity)).select(*_PAIR))
    whole = sets.select("s", "hashes")
    both = near.join(whole.toDF("u", "a"), "u").join(whole.toDF("v", "b"), "v")
    alike = _enough(F.size(F.array_intersect("a", "b")), similarity)
    return both.filter(alike).select(F.least("fu", "fv").alias("u"), F.greatest("fu", "fv").alias("v")).distinct()


def _placed(rows: DataFrame, roots: DataFrame, sizes: DataFrame) -> DataFrame:
    """`rows` with the component `root` of their fingerprint fp. sizes: fp, w: how many sets have a fingerprint."""
    known = cut(roots.select(F.col("node").alias("fp"), "root").join(sizes, "fp"))
    rows = rows.drop("root")
    return look_up(rows, known, ["fp"], "w").select(*rows.columns, F.coalesce("root", "fp").alias("root"))


def _between(rows: DataFrame) -> DataFrame:
    """Rows (k, root, ...) of the keys k that hold several components, with `most`, the key's largest component."""
    sizes = rows.groupBy("k", "root").agg(F.count("*").alias("c"))
    keys = cut(sizes.groupBy("k").agg(F.sum("c").alias("w"), F.max_by("root", F.struct("c", "root")).alias("most"), F.count("*").alias("parts")).filter("parts > 1").drop("parts"))
    return look_up(rows, keys, ["k"], "w").filter("found").drop("found")


def _prefixes(sets: DataFrame, known: DataFrame, similarity: float, keep: Keep = cut) -> DataFrame:
    """(k, s, root, fp, n, r): the shingles k of each set that the first shingle shared with a similar set is among.

    A set's shingles are ordered from rare to frequent; r counts those from k on. Two sets that share no shingle before
    k share r at most, so r >= similarity * n is needed. Shingles of one set alone come first and meet nothing.
    """
    tokens = sets.select("s", F.explode("hashes").alias("k"))
    counts = keep(tokens.groupBy("k").agg(F.count("*").alias("held")).filter("held > 1"))
    shared = tokens.join(counts, "k")  # AQE splits the rows of a shingle that very many sets hold
    place = F.row_number().over(Window.partitionBy("s").orderBy(F.desc("held"), F.desc("k")))
    rows = shared.select("s", "k", place.alias("r")).join(known.select("s", "root", "fp", "n"), "s")
    return keep(rows.filter(F.col("r") >= F.col("n") * F.lit(similarity) - 1e-9).select("k", "s", "root", "fp", "n", "r"))


def _across(rows: DataFrame, similarity: float, keep: Keep = cut) -> DataFrame:
    """_PAIR: the pairs of sets in different components that share a shingle of their prefixes and can be similar.

    Of two sets with at least the similarity, the first shingle they share has r >= similarity / (1 + similarity) *
    (n + n') in both (they share so many), which for the smaller one is r >= 2 * similarity / (1 + similarity) * n.
    """
    share = similarity / (1 + similarity)
    able = F.col("r") >= F.col("n") * F.lit(2 * share) - 1e-9
    rows = rows.join(rows.filter(able).select("k").distinct(), "k", "left_semi")
    mixed = keep(_between(keep(rows)))
    few = mixed.filter("root <> most").toDF(*[f"{c}u" for c in mixed.columns])
    many = mixed.toDF(*[f"{c}v" for c in mixed.columns])
    few, many = (x.withColumnsRenamed({f"s{y}": y, f"fp{y}": f"f{y}"}) for x, y in ((few, "u"), (many, "v")))
    enough = F.least("ru", "rv") >= (F.col("nu") + F.col("nv")) * F.lit(share) - 1e-9
    pairs = few.join(many, (F.col("ku") == F.col("kv")) & (F.col("rootu") != F.col("rootv")) & enough & _near_size(similarity))
    turned = F.col("u") > F.col("v")
    ordered = [F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in zip(_PAIR, ["v", "u", "fv", "fu", "nv", "nu"])]
    return pairs.select(*ordered).distinct()


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(key, component_id): one row per row of `docs`; component_id is the smallest key reachable by links.

    Texts link if their fingerprints differ in four bits or fewer, or if their sets of word shingles have at least the
    similarity. Texts without words, null and empty ones included, are all alike. Rows with a null key take part, and a
    component of null keys alone has a null id. Repeated rows stay. An empty table gives none.

    Fingerprints count repeated shingles and sets don't, so texts of one set may have several. Each is linked by its bits
    and joined to the least one of its set, which stands for the set; rows find their component by their set.
    """
    with Steps(docs.sparkSession) as steps:
        keep = steps.keep
        rows = keep(_described(docs, key, text, words))
        first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "th"))
        nodes = rows.groupBy("id").agg(F.min("key").alias("least"), first.alias("at"), F.min("fp").alias("fp"), F.max("fp").alias("top"), F.count("*").alias("docs"), *[F.first(c).alias(c) for c in ("n", "bands")])
        nodes = keep(nodes.withColumn("s", F.monotonically_increasing_id()))  # fixed as it is written: a short name of the set
        sizes = keep(nodes.groupBy("fp").agg(F.count("*").alias("w")))
        prints = keep(rows.select("id", "fp").distinct())
        twins = prints.join(nodes.filter("fp <> top").select("id", F.col("fp").alias("v")), "id").filter("fp <> v").select(F.col("fp").alias("u"), "v")
        roots = components(links(prints.select("fp").distinct()).union(twins))
        placed = keep(_placed(nodes.drop("top"), roots, sizes))
        shared = _between(placed.select(F.explode("bands").alias("k"), "s", "root"))
        mixed = keep(shared.join(placed.select("s", "fp", "n"), "s"))
        joined = keep(placed.select("s", "id", "fp", "least", "root", "docs"))
        needed = placed.select("s", "at").join(mixed.select("s").distinct(), "s", "left_semi").select("s", F.col("at.key").alias("_key"), F.col("at.th").alias("_th"))
        texts = _texts(docs, key, text)
        texts = texts.join(needed, F.col("key").eqNullSafe(F.col("_key")) & (F.col("th") == F.col("_th")))
        again = rows.groupBy("key", "th").agg(F.count("*").alias("c")).filter("c > 1").limit(1).count()
        sets = _sets(texts.dropDuplicates(["s"]) if again else texts, words)
        sets = keep(sets)
        steps.leave(rows, sizes, mixed, joined, sets)
        for nearest in (True, False):
            if nearest:
                pairs = keep(_neighbours(mixed, similarity))
            else:
                apart = _between(_placed(mixed.select("k", "s", "fp"), roots, sizes).select("k", "s", "root")).select("s", "root").distinct()
                apart = keep(apart.join(mixed.select("s", "fp", "n").distinct(), "s"))
                pairs = keep(_across(_prefixes(sets.join(apart, "s", "left_semi"), apart, similarity, keep), similarity, keep))
                steps.leave(rows, sizes, sets, joined, pairs)
            edges = joined.select(F.col("fp").alias("u"), F.col("root").alias("v")).filter("u <> v")
            roots = components(edges.union(_alike(pairs, sets, similarity)))
            joined = keep(_placed(joined, roots, sizes))
            steps.leave(rows, sizes, mixed, sets, joined) if nearest else steps.leave(rows, joined)
        ids = keep(joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("w")))
        labels = keep(look_up(joined, ids, ["root"], "w", 1000).select("id", "component_id", "docs"))
        out = keep(look_up(rows.select("key", "id"), labels, ["id"], "docs", 1000).select(F.col("key").alias(key), "component_id"))
        steps.leave(out)
    return out


def one_of_each_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` that are the smallest key of their component, all columns as they are.

    Rows with equal key and text count as one. Rows with a null key stay only where no row of their component has a key.
    """
    return smallest_of_each(docs, similar_documents(docs, key, text, words, similarity), key, text)
