"""Language by hierarchical discrimination: the family first, then one-versus-one linear SVMs within the family.

A text becomes the square roots of the shares of its hashed character n-grams (one to four letters, words apart), a
vector of length one. Families compete one against one by linear support vector machines, then the languages of the
family that wins do. All machines together are one small matrix. They are fitted on a bounded sample of documents, or
on all of them: in groups, each on its own, and then averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import crc_mod, cut, least_hashed, split_by_bytes, table
from cloakwork.llm.textgrams import is_letter, mix, points

BUCKETS = 1 << 12
#: The most documents of all languages that machines are fitted on at a time, chosen by a hash of their id, and those of each
#: language that are added where these hold fewer of it.
MAX_SAMPLE, EACH = 6_000, 200
#: The documents of a group, where all are learnt from: some 50 MB of vectors.
GROUP = 3_000
#: A text is recognised from this part of the score on that all but a hundredth of held-out documents reach.
SHARE = 0.65
ROWS, CHUNK = 128, 1 << 18
UNKNOWN = "und"
#: Families of languages by ISO 639-1 code; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows x BUCKETS matrix, whether each text has a letter); a long text is counted in pieces."""
    counts = np.zeros((len(texts), BUCKETS))
    lettered = np.zeros(len(texts), bool)
    for k0, k1 in split_by_bytes(list(map(len, texts)), CHUNK):
        for lo in range(0, max(map(len, texts[k0:k1])) or 1, CHUNK):
            flat, ends = points([t[lo : lo + CHUNK] for t in texts[k0:k1]])
            row = k0 + np.searchsorted(ends, np.arange(len(flat)), side="right")
            letter = is_letter(flat)
            lettered[row[letter]] = True
            spot = np.where(letter, flat.astype(np.uint64) + np.uint64(2), np.uint64(1))
            h = np.zeros(len(flat), np.uint64)
            for n in range(1, 5):
                if len(flat) < n:
                    break
                h = h[: len(flat) - n + 1] * np.uint64(0x100000001B3) + spot[n - 1 :]
                ok = letter[: len(h)] if n == 1 else letter[: len(h)] | letter[n - 1 :]
                for inner in range(1, n - 1):
                    ok = ok & letter[inner : inner + len(h)]
                ok = ok & (row[: len(h)] == row[n - 1 :])
                at = (mix(h[ok] + np.uint64(n)) >> np.uint64(64 - 12)).astype(np.int64)
                counts += np.bincount(row[: len(h)][ok] * BUCKETS + at, minlength=counts.size).reshape(counts.shape)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32), lettered


def svm(x: np.ndarray, y: np.ndarray, c: float = 8.0, epochs: int = 12, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights and bias of a linear SVM with squared hinge loss, by dual coordinate descent; y is 1 or -1.

    Both classes weigh the same, whatever their numbers. rows: those of x that y is for, in order; else all.
    """
    rows = np.arange(len(x)) if rows is None else rows
    w, bias = np.zeros(x.shape[1]), 0.0
    alpha = np.zeros(len(rows))
    cost = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * c
    norm = np.einsum("ij,ij->i", x, x, dtype=np.float64)[rows] + 1 + 0.5 / cost  # no copy of x
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            g = y[i] * (x[rows[i]] @ w + bias) - 1 + alpha[i] * 0.5 / cost[i]
            new = max(alpha[i] - g / norm[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * x[rows[i]]
                bias += step
                alpha[i] = new
    return np.append(w, bias)


class Model:
    """The machines (pairs of names with weights) and, of each family, its languages. Bounded by the languages seen."""

    def __init__(self, machines: dict[tuple[str, str, str], np.ndarray], langs: list[str]) -> None:
        self.keys = list(machines)
        self.w = np.array([machines[k] for k in self.keys]).reshape(len(self.keys), BUCKETS + 1).T.astype(np.float32)
        self.langs = langs
        self.families = sorted({family_of(x) for x in langs})

    def _duel(self, margins: np.ndarray, group: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner among names, and its chance: the least of its sigmoids against the others."""
        votes, total = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
        chance = np.ones((len(margins), len(names)))
        for k, (g, a, b) in enumerate(self.keys):
            if g == group:
                i, j, m = names.index(a), names.index(b), margins[:, k]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                total[:, i] += m
                total[:, j] -= m
                p = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
                chance[:, i], chance[:, j] = np.minimum(chance[:, i], p), np.minimum(chance[:, j], 1 - p)
        best = np.argmax(votes + 1e-3 * np.tanh(total), axis=1)
        return best, chance[np.arange(len(best)), best]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text; UNKNOWN with score 0 without letters, or if no language was learnt."""
        x, lettered = vectors(texts)
        margins = x @ self.w[:-1] + self.w[-1]
        family, sure = self._duel(margins, "", self.families) if self.langs else (np.zeros(len(texts), int), np.zeros(len(texts)))
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for f, name in enumerate(self.families):
            at = np.nonzero((family == f) & lettered)[0]
            names = [x for x in self.langs if family_of(x) == name]
            best, chance = self._duel(margins[at], name, names)
            score[at] = sure[at] * chance
            for i, b in zip(at.tolist(), best.tolist()):
                lang[i] = names[b]
        return lang, score.tolist()


#: A machine between two languages or families; of a language that was seen, a row with both names and no weights.
_MACHINE = "grp string, a string, b string, w binary"


def _lettered(langs: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """(lang, x): vectors of the texts that have a letter, as halves."""
    for lo in range(0, len(texts), ROWS):
        x, lettered = vectors(texts[lo : lo + ROWS])
        keep = np.nonzero(lettered)[0]
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(lo + keep)), pa.array([v.tobytes() for v in x[keep].astype(np.float16)], pa.binary())], names=["lang", "x"])


def _machines(batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch | None:
    """The machines that the vectors of all batches teach, whatever their order."""
    rows = sorted((lang, raw) for b in batches for lang, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
    if not rows:
        return None
    y = np.array([r[0] for r in rows], object)
    x = np.empty((len(rows), BUCKETS), np.float32)
    for i, (_, raw) in enumerate(rows):
        x[i], rows[i] = np.frombuffer(raw, np.float16), ("", b"")  # let go of as it is copied
    del rows
    langs = sorted(set(y))
    out = [("", lang, lang, b"") for lang in langs]
    of = np.array([family_of(v) for v in y], object)
    groups = [("", of, sorted(set(of)))] + [(f, y, [v for v in langs if family_of(v) == f]) for f in sorted(set(of))]
    for group, names, members in groups:
        for a, b in combinations(members, 2):
            at = np.nonzero((names == a) | (names == b))[0]
            out.append((group, a, b, svm(x, np.where(names[at] == a, 1.0, -1.0), rows=at).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.binary()))], names=["grp", "a", "b", "w"])


def _model(found: DataFrame) -> Model:
    rows = found.select("grp", "a", "b", "w").collect()
    return Model({(r.grp, r.a, r.b): np.frombuffer(r.w) for r in sorted(rows, key=lambda r: (r.grp, r.a, r.b)) if r.w}, sorted(r.a for r in rows if not r.w))


def fit(rows: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """The machines learnt from the rows, which the caller keeps to a bounded number; null languages are left out.

    Texts become vectors where they lie; one task fits all machines.
    """

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _lettered(batch.column(0), [t or "" for t in batch.column(1).to_pylist()])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _machines(batches)
        if made is not None:
            yield made

    some = rows.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return _model(some.mapInArrow(vector, "lang string, x binary").repartition(1).mapInArrow(learn, _MACHINE))


def groups_of(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", size: int = GROUP, each: int = EACH) -> DataFrame:
    """(grp, lang, text) of all documents with a language and outside the held-out quarter, in groups of some `size`.

    A document is in one group, by a hash of it. Those of a language too rare to give each group `each` of them are in
    as many groups as that takes, at most in all.
    """
    able = docs.filter(F.col(lang).isNotNull() & (crc_mod(F.col(key), 4) != 2)).select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    sizes = able.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"))  # as many as there are languages
    n = max(1, ceil((sizes.agg(F.sum("n")).first()[0] or 0) / size))
    often = F.least(F.lit(n), F.ceil(F.lit(each * n) / F.col("n"))).cast("int")
    first = F.pmod(F.xxhash64("k", "text"), F.lit(n))
    places = F.transform(F.sequence(F.lit(0), F.col("often") - 1), lambda i: F.pmod(F.col("first") + i, F.lit(n)))
    met = able.join(F.broadcast(sizes.select("l", often.alias("often"))), F.col("lang") == F.col("l")).withColumn("first", first)
    return met.select(F.explode(places).alias("grp"), "lang", "text")


def fit_all(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", size: int = GROUP, each: int = EACH) -> Model:
    """The machines learnt from all documents with a language and outside the held-out quarter.

    Each group of groups_of fits machines of its own, in one task each; a machine is the mean of those of all groups.
    One group, in tables of up to `size` such documents, gives what fit gives.
    """

    def learn(group: pa.Table) -> pa.Table:
        batch = group.combine_chunks()
        made = _machines(_lettered(batch.column("lang").combine_chunks(), [t or "" for t in batch.column("text").to_pylist()]))
        return pa.table({"grp": [], "a": [], "b": [], "w": []}, pa.schema([("grp", pa.string()), ("a", pa.string()), ("b", pa.string()), ("w", pa.binary())])) if made is None else pa.Table.from_batches([made])

    def mean(same: pa.Table) -> pa.Table:
        weights = sorted(w for w in same.column("w").to_pylist() if w)  # in one order, whatever that of the groups
        total = sum((np.frombuffer(w) for w in weights), np.zeros(BUCKETS + 1)) / max(1, len(weights))
        return same.slice(0, 1).set_column(same.column_names.index("w"), "w", pa.array([total.tobytes() if weights else b""], pa.binary()))

    found = groups_of(docs, key, lang, text, size, each).groupBy("grp").applyInArrow(learn, _MACHINE)
    return _model(found.groupBy("grp", "a", "b").applyInArrow(mean, _MACHINE))


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): one row per row; null, empty and letterless texts are `und` with score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), ROWS):
                lang, score = shared.value.predict(texts[lo : lo + ROWS])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(lang)), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def keep_recognised(docs: DataFrame, model: Model, text: str = "text", least: float = 0.2) -> DataFrame:
    """The rows of `docs` whose language is recognised with a score of `least` or more, all columns as they are.

    Null, empty and letterless texts are not recognised. One pass, without a shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for lo in range(0, len(texts), ROWS):
                lang, score = shared.value.predict(texts[lo : lo + ROWS])
                keep = [x != UNKNOWN and p >= least for x, p in zip(lang, score)]
                yield batch.slice(lo, len(keep)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def nth(scores: DataFrame, k: int, score: str = "score") -> float:
    """The k-th least score, from 0; there are more than k. Scores are counted in bins of the range that holds it, which
    narrows until it is one score."""
    lo, hi = (float(v) for v in scores.agg(F.min(score), F.max(score)).first())
    while lo < hi:
        inside = scores.filter(F.col(score).between(lo, hi))
        bins = inside.groupBy(F.floor((F.col(score) - lo) / (hi - lo) * 4096).alias("b")).agg(F.count("*").alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: r.b):
            if k < r.n:
                lo, hi = r.lo, r.hi
                break
            k -= r.n
    return lo


def least_score(docs: DataFrame, model: Model, key: str = "doc_id", lang: str = "lang", text: str = "text") -> float:
    """The score from which on a text is recognised, by all documents of the held-out quarter; 0 without any.

    Machines decide between the languages they know, so the winner's score alone never is low; a text of another
    language stays well below the scores that right answers have on documents the machines have not seen.
    """
    held = docs.filter(F.col(lang).isNotNull() & (crc_mod(F.col(key), 4) == 2)).select(F.col(lang).cast("string").alias("lang"), text)
    right = cut(predict(held, model, "lang", text).filter(F.col("lang") == F.col("lang_pred")).select("score"))
    n = right.count()
    if not n:
        return 0.0
    at = 0.01 * (n - 1)
    low, high = nth(right, floor(at)), nth(right, ceil(at))
    return SHARE * (low + (high - low) * (at - floor(at)))


def sample(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", limit: int = MAX_SAMPLE, each: int = EACH) -> DataFrame:
    """(lang, text) of documents with a language and outside the held-out quarter, by hash of their id.

    The least `limit` hashes of all, and the least `each` of every language, so that a rare one is learnt at any size.
    (Of a language whose rows repeat each id more than eight times they may be fewer than `each`.)
    """
    able = docs.filter(F.col(lang).isNotNull() & (crc_mod(F.col(key), 4) != 2))
    first = least_hashed(able.select(F.col(key).alias("k")).distinct(), limit)
    ids = able.select(F.col(lang).alias("l"), F.col(key).alias("k"), F.xxhash64(F.col(key)).alias("h"))
    sizes = ids.groupBy(F.col("l").alias("of")).agg(F.count("*").alias("rows"))  # as many as there are languages
    near = ids.join(F.broadcast(sizes), F.col("l") == F.col("of")).filter(F.col("h") / 2.0**64 + 0.5 < F.lit(8.0 * each) / F.col("rows"))
    place = F.dense_rank().over(Window.partitionBy("l").orderBy("h", "k"))  # among some eight times as many as are taken
    some = first.union(near.withColumn("place", place).filter(F.col("place") <= each).select("k")).distinct()
    rows = able.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    return rows.join(F.broadcast(some), F.col("key") == F.col("k"), "left_semi").select("lang", "text")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, by machines that learnt from documents outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, fit(sample(docs)))
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_language": op5_language}
ORACLES: dict[str, str] = {}
