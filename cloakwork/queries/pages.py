"""Queries of laid-out pages: boxes, sizes, overlaps, colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakwork.operators import geometry as G
from cloakwork.queries import synth as S
from cloakwork.queries.synth import K, Registry, customers

_R = Registry()
_D = f"CAST({K} % 40 AS DOUBLE)"


def _round(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def _s7(s, d):
    rows = customers(s, d, quad=f"array(array({_D} + 10, 20.0D), array({_D} + 110, 22.0D), array({_D} + 108, 40.0D), array({_D} + 12, 38.0D))")
    return rows.select(K, G.bounding_box(F.col("quad"), 200 / 72).alias("b")).select(K, "b.*").select(K, *_round("x0", "y0", "x1", "y1"))


_R.add("s7_ocr_bbox", _s7, f"SELECT {K}, round(({_D} + 10) * 72 / 200, 6) AS x0, round(20.0 * 72 / 200, 6)::DOUBLE AS y0, round(({_D} + 110) * 72 / 200, 6) AS x1, round(40.0 * 72 / 200, 6)::DOUBLE AS y1 FROM customer")
_R.add("d5_base_size", lambda s, d: customers(s, d, z=f"CASE WHEN {K} % 2 = 0 THEN array(CAST(NULL AS DOUBLE), 12.5D) ELSE array(CAST(NULL AS DOUBLE)) END", h=_D).select(K, G.base_size(F.col("z"), F.col("h")).alias("size")), f"SELECT {K}, CASE WHEN {K} % 2 = 0 THEN 12.5 ELSE greatest({_D} * 0.75, 6.0) END::DOUBLE AS size FROM customer")
# Two wide characters at size s take 2 s.
_R.add("d6_fitted_size", lambda s, d: customers(s, d, w=_D).select(K, G.fitted_size(F.lit("甲某"), F.col("w"), F.lit(14.0)).alias("size")), f"SELECT {K}, CASE WHEN {_D} >= 28 THEN 14.0 WHEN {_D} < 12 THEN NULL ELSE floor({_D}) / 2 END::DOUBLE AS size FROM customer")


def _d7(s, d):
    rows = customers(s, d, x0=_D, x1=f"{_D} + 100", t=f"concat({S.NAME}, 'ab')")
    box = G.part_of_line(F.col("x0"), F.col("x1"), F.col("t"), F.lit(0), F.lit(2))
    return rows.select(K, box.alias("b")).select(K, "b.*").select(K, *_round("x0", "x1"))


_R.add("d7_part_of_line", _d7, f"SELECT {K}, round({_D}, 6) AS x0, round({_D} + 100 * 2 / 3.1 + 2, 6)::DOUBLE AS x1 FROM customer")


def _lines(s, d):
    """Two lines a page: the name goes over both, with a blank inside."""
    one = customers(s, d, a=f"concat('甲方 ', {S.SURNAME})", b=f"concat(' ', {S.GIVEN}, '签字，', {S.SURNAME}, {S.GIVEN})")
    box = lambda n, c, y: F.struct(F.lit(n).alias("line_no"), F.lit(0.0).alias("x0"), F.lit(y).alias("y0"), F.lit(100.0).alias("x1"), F.lit(y + 10.0).alias("y1"), F.col(c).alias("text"))
    rows = one.select(F.col(K).cast("string").alias("file"), F.lit(1).alias("page_no"), F.explode(F.array(box(0, "a", 0.0), box(1, "b", 20.0))).alias("l"))
    return rows.select("file", "page_no", "l.*")


def _fragments(s, d):
    pairs = customers(s, d, original=S.NAME, alias="'甲某'").select("original", "alias").distinct()
    return G.page_fragments(_lines(s, d), pairs)


_FRAG = f"""
SELECT CAST({K} AS VARCHAR) AS file, {S.NAME} AS original, 2 AS hit, 0 AS line_no, CAST(0 AS BIGINT) AS off FROM customer
UNION ALL SELECT CAST({K} AS VARCHAR), {S.NAME}, 2, 1, 1 FROM customer
UNION ALL SELECT CAST({K} AS VARCHAR), {S.NAME}, 7, 1, 0 FROM customer"""
_R.add("d8_page_fragments", lambda s, d: _fragments(s, d).select("file", "original", "hit", "line_no", F.col("offset").alias("off")), _FRAG)


def _d9(s, d):
    box = lambda a, b: F.struct(F.lit(0.0).alias("x0") if a is None else a.alias("x0"), F.lit(0.0).alias("y0"), b.alias("x1"), F.lit(10.0).alias("y1"))
    rows = customers(s, d, x=_D)
    return rows.select(K, G.covered(box(F.col("x"), F.col("x") + 10), F.array(box(None, F.lit(20.0)))).alias("is_covered"))


_R.add("d9_covered", _d9, f"SELECT {K}, {_D} < 14 AS is_covered FROM customer")


_PAGE = f"CAST(floor({K} / 200) AS INT)"


def _d10(s, d):
    """Pages of four rows of 50 pixels, and three boxes on each: over row 1, beyond the pixels, and without width."""
    pixels = customers(s, d, page_no=_PAGE, px=f"CAST({K} % 50 AS INT)", py=f"CAST(floor({K} % 200 / 50) AS INT)", r=f"CAST({K} % 256 AS DOUBLE)", g="10.0D", b="255.0D").drop(K)
    boxes = pixels.select("page_no").distinct().selectExpr("page_no", "inline(array(struct('a', 5.0D, 2.0D, 10.0D, 100), struct('b', 5.0D, 90.0D, 9.0D, 100), struct('c', 9.0D, 2.0D, 9.0D, 100))) AS (kind, x0, y0, x1, height)")
    boxes = boxes.selectExpr("concat(CAST(page_no AS STRING), kind) AS box_id", "page_no", "x0", "y0", "x1", "height")
    return G.background(pixels, boxes, 2.0).select("box_id", *_round("r", "g", "b"))


# Row int(2 * 2) - 3 = 1, columns 10 to 19: the 60th to 69th customer of each page; pages without them are white there.
_R.add("d10_background", _d10, f"""
WITH p AS (SELECT DISTINCT {_PAGE} AS page FROM customer), m AS (SELECT {_PAGE} AS page, median({K} % 256) AS r FROM customer WHERE {K} % 200 BETWEEN 60 AND 69 GROUP BY 1)
SELECT concat(CAST(p.page AS VARCHAR), 'a') AS box_id, CASE WHEN r IS NULL THEN 1.0 ELSE round(r / 255, 6) END::DOUBLE AS r, CASE WHEN r IS NULL THEN 1.0 ELSE round(10.0 / 255, 6) END::DOUBLE AS g, 1.0::DOUBLE AS b FROM p LEFT JOIN m ON p.page = m.page
UNION ALL SELECT concat(CAST(page AS VARCHAR), k), 1.0, 1.0, 1.0 FROM p, (VALUES ('b'), ('c')) AS v(k)""")


def _d11(s, d):
    pairs = customers(s, d, original=f"{S.NAME}", alias="'甲某'").select("original", "alias").distinct()
    short = customers(s, d, original=S.SURNAME, alias="'乙某'").select("original", "alias").distinct()
    kept = G.claim(G.page_fragments(_lines(s, d), pairs.union(short)))
    return kept.groupBy("file").agg(F.count("*").alias("n"), F.count(F.when(F.col("writes"), 1)).alias("n_aliases"))


# The surnames lie inside the boxes of the names, which are longer and come first.
_R.add("d11_claim", _d11, f"SELECT CAST({K} AS VARCHAR) AS file, CAST(3 AS BIGINT) AS n, CAST(2 AS BIGINT) AS n_aliases FROM customer")


def _d4(s, d):
    """Overflow warnings: aliases that don't fit at the least size."""
    rows = customers(s, d, w=_D, alias=f"CASE WHEN {K} % 2 = 0 THEN '甲某' ELSE '甲公司12' END")
    size = G.fitted_size(F.col("alias"), F.col("w"), F.lit(10.0))
    return rows.select(K, F.coalesce(size, F.lit(G.MIN_SIZE)).alias("size"), size.isNull().alias("overflows"))


_ONE = f"CASE WHEN {K} % 2 = 0 THEN 2.0 ELSE 4.1 END"
_R.add("d4_overflow", _d4, f"SELECT {K}, CASE WHEN {_D} < 6 * {_ONE} THEN 6.0 ELSE least(10.0, floor({_D} / {_ONE} * 2 + 1e-9) / 2) END::DOUBLE AS size, {_D} < 6 * {_ONE} AS overflows FROM customer")

QUERIES, ORACLES = _R.queries, _R.oracles
