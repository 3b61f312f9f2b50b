"""Places of many strings in many texts: one automaton for all strings of a file, run over its texts in Arrow batches.

Strings of at most MOST bytes in all are broadcast, and texts stay where they are. Beyond that, texts and the strings of
their file meet by one shuffle on the file, strings first, so a task holds the strings of one file at a time; a file with
many texts is dealt over several tasks. Strings for all files are then searched in blocks of MOST bytes, in passes
without a shuffle. Both ways give the same.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.lineage import fresh

#: The most bytes of strings that are broadcast at once; an automaton takes some thirty times as much.
MOST = 8 << 20
#: A place: minus the length of the string and its id, which order the strings, start and end, and what comes with it.
FOUND = "array<struct<n:int,id:long,start:int,end:int,value:string>>"
_TYPE = pa.list_(pa.struct([("n", pa.int32()), ("id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


class Finder:
    """An automaton of (id, string, value); empty and null strings are nowhere. Of equal strings the least id counts."""

    def __init__(self, strings: Iterable[tuple[int, str, str]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for id_, string, value in sorted(strings, key=lambda s: s[0], reverse=True):
            if string:
                self.automaton.add_word(string, (len(string), id_, value))
        if len(self.automaton):
            self.automaton.make_automaton()

    def places(self, text: str | None) -> list[dict]:
        """All places of all strings, overlapping ones too."""
        if not text or not len(self.automaton):
            return []
        return [{"n": -n, "id": i, "start": at + 1 - n, "end": at + 1, "value": v} for at, (n, i, v) in self.automaton.iter(text)]


def _array(lists: list[list[dict]]) -> pa.Array:
    return pa.array(lists, _TYPE)


def _broadcast_search(rows: DataFrame, strings: list, file: str, text: str) -> Column:
    by_file: dict = {}
    for f, *s in strings:
        by_file.setdefault(f, []).append(tuple(s))
    shared = rows.sparkSession.sparkContext.broadcast(by_file)

    @F.arrow_udf(FOUND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known = shared.value
        every, finders = Finder(known.get(None, [])), {}
        for files, texts in batches:
            out = []
            for f, t in zip(files.to_pylist(), texts.to_pylist()):
                found = every.places(t)
                if f in known and f is not None:
                    if f not in finders:
                        if len(finders) >= 64:
                            finders.clear()
                        finders[f] = Finder(known[f])
                    found = found + finders[f].places(t)
                out.append(found)
            yield _array(out)

    return run(F.col(file).cast("string"), F.col(text).cast("string"))


def _shuffled_search(rows: DataFrame, strings: DataFrame, file: str, text: str, found: str) -> DataFrame:
    """`rows` with `found`, by the strings of their own file."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.col(file).cast("string")
    sizes = rows.groupBy(own.alias("f")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = total // (4 * parts) + 1  # files with more rows than this are fewer than 4 * parts
    big = [(r.f, -(-r.n // share)) for r in sizes.filter((F.col("n") > share) & F.col("f").isNotNull()).collect()]
    deal = F.broadcast(spark.createDataFrame(big, "f string, k long"))
    plain = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]  # equal rows of one file stay together
    texts = rows.select(F.struct("*").alias("row"), own.alias("file"), F.col(text).cast("string").alias("text"), F.xxhash64(*plain).alias("h"))
    texts = texts.join(deal, texts["file"] == deal["f"], "left").withColumn("salt", F.pmod("h", F.coalesce("k", F.lit(1))))
    texts = texts.select("file", "salt", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("id"), "text", F.lit(None).cast("string").alias("value"), "row")
    given = strings.join(deal, strings["file"] == deal["f"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("k", F.lit(1)) - 1)))
    given = given.select("file", "salt", F.lit(0).alias("kind"), "id", F.col("string").alias("text"), "value", F.lit(None).cast(rows.schema).alias("row"))
    met = texts.unionByName(given).repartition(parts, "file", "salt").sortWithinPartitions("file", "salt", "kind")

    @F.arrow_udf(FOUND)
    def in_order(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        place, held, finder = None, [], None
        for columns in batches:
            out = []
            for f, salt, kind, id_, t, value in zip(*(c.to_pylist() for c in columns)):
                if (f, salt) != place:
                    place, held, finder = (f, salt), [], None
                if kind == 0:
                    held.append((id_, t, value))
                    out.append([])
                else:
                    if finder is None:
                        finder, held = Finder(held), []
                    out.append(finder.places(t) if f is not None else [])
            yield _array(out)

    # not deterministic: the filter must stay above, as strings have to pass before texts
    done = met.withColumn("found", in_order.asNondeterministic()("file", "salt", "kind", "id", "text", "value")).filter("kind = 1")
    return done.select("row.*", F.col("found").alias(found))


def search(rows: DataFrame, strings: DataFrame, found: str, file: str = "file", text: str = "text", most: int = MOST) -> DataFrame:
    """`rows` with the column `found`: all places of the strings of each row's file and of those for all files.

    strings: file (null: all files), id, string, value. Null texts have none; rows without a file have those for all
    files; repeated rows have each their own. Of equal strings of one file the least id counts.
    """
    size = F.coalesce(F.sum(F.octet_length("string") + F.coalesce(F.octet_length("value"), F.lit(0)) + 64), F.lit(0))
    by = strings.groupBy(F.col("file").isNull().alias("all")).agg(size.alias("size")).collect()
    sizes = {r["all"]: r["size"] for r in by}
    strings = strings.select("file", "id", "string", "value")
    if sum(sizes.values()) <= most:
        return rows.withColumn(found, _broadcast_search(rows, [tuple(r) for r in strings.collect()], file, text))
    out = _shuffled_search(rows, strings.filter(F.col("file").isNotNull()), file, text, found)
    for block in blocks(strings.filter(F.col("file").isNull()), most):
        more = fresh("more")
        out = out.withColumn(more, _broadcast_search(rows, block, file, text)).withColumn(found, F.concat(found, more)).drop(more)
    return out


def blocks(strings: DataFrame, most: int) -> Iterator[list[tuple]]:
    """All rows, in lists of about `most` bytes; the driver holds one row group at a time beside the list."""
    block, size = [], 0
    for r in strings.toLocalIterator():
        block.append(tuple(r))
        size += len((r.string or "").encode()) + len((r.value or "").encode()) + 64
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block
