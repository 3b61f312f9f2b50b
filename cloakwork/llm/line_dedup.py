"""Lines that many documents share, dropped everywhere. DataFrame functions only.

Lines are exploded as 128-bit hashes of their keys (stripped, A-Z lower-cased) and the documents of each hash are
counted with a map-side sum. Where the hashes over the threshold are few, each text is cleaned where it lies. Else they
meet the exploded (document, position, hash) rows, which gives the positions to drop in each document, and the text is put
together again from the runs of lines between them: texts then move once, in the last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import cut, fresh_name, look_up, table, upper_to_lower

BLANKS = " \t\n\v\f\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_keys(lines: Column) -> Column:
    return F.transform(lines, lambda x: upper_to_lower(F.btrim(x, F.lit(BLANKS))))


def _hashes(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("2"), k).alias("h2"), F.length(k).alias("n")))


#: The most common lines that are looked for in place.
MOST_IN_PLACE = 5_000


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with their text cleaned, and n_lines (before) and n_dropped added or replaced.

    A line goes if its key has `min_chars` code points or more and is found in `min_docs` rows or more (a row is a
    document and counts once however often it repeats the line; equal rows count as so many documents). Lines that are
    kept stay as they were, in their order. A null or empty text is one empty line and comes back empty; a text that loses
    all lines is empty too. Null keys, repeated rows, further columns of any name and empty tables are allowed.

    At most MOST_IN_PLACE common lines are a list of hashes, with which each text is cleaned where it lies. More meet the
    positions of their lines by a shuffle, and the positions meet the texts by another.
    """
    lines = _lines(F.col(text).cast("string"))
    once = docs.select(F.explode(_hashes(F.array_distinct(_line_keys(lines)))).alias("x")).select("x.*").filter(F.col("n") >= min_chars)
    common = cut(once.groupBy("h1", "h2").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs))
    few = common.select("h1", "h2").limit(MOST_IN_PLACE + 1).collect()
    if len(few) <= MOST_IN_PLACE:
        return _cleaned_in_place(docs, [tuple(r) for r in few], min_chars, text)
    return _cleaned_by_join(docs, common, min_chars, key, text)


def _cleaned_in_place(docs: DataFrame, common: list[tuple[int, int]], min_chars: int, text: str) -> DataFrame:
    """Lines whose two hashes are both in the list go. That these are of two different common lines is as unlikely as that
    128 bits agree by chance."""
    lines_, gone_ = fresh_name("lines"), fresh_name("gone")
    rows = docs.withColumn(lines_, _lines(F.col(text).cast("string")))
    first, second = ([h[i] for h in common] for i in (0, 1))

    def drops(line: Column) -> Column:
        k = upper_to_lower(F.btrim(line, F.lit(BLANKS)))
        return F.xxhash64(k).isin(first) & F.xxhash64(F.lit("2"), k).isin(second) & (F.length(k) >= min_chars)

    kept = F.filter(lines_, lambda x: ~drops(x)) if common else F.col(lines_)
    rows = rows.withColumn(gone_, kept)
    dropped = F.size(lines_) - F.size(gone_)
    clean = F.when(dropped == 0, F.coalesce(F.col(text).cast("string"), F.lit(""))).otherwise(F.array_join(gone_, "\n"))
    columns = [clean.alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*columns, F.size(lines_).cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def _cleaned_by_join(docs: DataFrame, common: DataFrame, min_chars: int, key: str, text: str) -> DataFrame:
    doc = docs.select(F.col(key).alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    places = doc.select("d", F.xxhash64("t").alias("th"), F.posexplode(_hashes(_line_keys(_lines(F.col("t"))))).alias("pos", "x"))
    places = places.filter(F.col("x.n") >= min_chars).select("d", "th", "pos", "x.h1", "x.h2")
    hits = look_up(places, common, ["h1", "h2"], "docs").filter("found")
    drops = hits.groupBy("d", "th").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("d"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("th", F.xxhash64("t"))
    drops = drops.select(F.col("d").alias("d2"), F.col("th").alias("th2"), "drop")
    met = rows.join(drops, rows["d"].eqNullSafe(drops["d2"]) & (rows["th"] == drops["th2"]), "left")
    met = met.select("row", "t", "drop", _lines(F.col("t")).alias("lines"))
    n = F.size("lines")
    gone = F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop"))

    def run(i: Column) -> Column:
        """Lines between dropped positions i - 1 and i (0-based positions; slice counts from 1)."""
        before = F.when(i == 0, -1).otherwise(F.get("drop", i - 1))
        after = F.when(i == gone, n).otherwise(F.get("drop", i))
        return F.slice("lines", before + 2, after - before - 1)

    left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), gone), run)), "\n")
    clean = F.when(gone == 0, F.col("t")).otherwise(left)
    kept = [F.col("row")[c].alias(c) if c != text else clean.alias(text) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return met.select(*kept, n.cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its line counts and the digest of the lines that it keeps."""
    done = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLES = {
    "op10_line_dedup": r"""
WITH docs AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
lines AS (
  SELECT r, doc_id, u.pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM docs, (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u),
common AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(c.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.k IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS kept_sha256
FROM lines l LEFT JOIN common c ON l.k = c.k
GROUP BY l.r, l.doc_id
"""
}
