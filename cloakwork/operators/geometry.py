"""Redaction of laid-out pages: boxes of matches, font sizes, overlaps, background colours.

OCR lines: file, page_no, line_no, x0, y0, x1, y1, text. Writing pages is left to a provider; these operators say where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions.lineage import cut
from cloakwork.operators.search import MOST, search

MIN_SIZE, STEP = 6.0, 0.5
BLANKS = r"(?U)[\s\x1c-\x1f　]"


def bounding_box(quad: Column, zoom: Column | float) -> Column:
    """(x0, y0, x1, y1) of an array of (x, y) points, in page units."""
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    side = lambda f, v: f(v) / zoom
    return F.struct(side(F.array_min, xs).alias("x0"), side(F.array_min, ys).alias("y0"), side(F.array_max, xs).alias("x1"), side(F.array_max, ys).alias("y1"))


def text_width(text: Column, size: Column | float = 1.0) -> Column:
    """Width of a text: wide characters (above U+2E7F) count 1, others 0.55. Font metrics are a provider's matter."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0.0), lambda a, c: a + F.when(F.ascii(c) > 0x2E7F, 1.0).otherwise(0.55)) * size


def base_size(sizes: Column, height: Column, share: float = 0.75) -> Column:
    """The first known font size in the box, else a share of its height, at least the least size."""
    return F.coalesce(F.get(F.filter(sizes, lambda s: s.isNotNull() & (s > 0)), F.lit(0)), F.greatest(height * share, F.lit(MIN_SIZE)))


def fitted_size(alias: Column, width: Column, base: Column) -> Column:
    """The largest of base, base - 0.5, ... down to 6.0 at which the alias fits; null if none does."""
    one = text_width(alias)
    steps = F.floor((base - MIN_SIZE) / STEP).cast("int")
    sizes = F.when(base >= MIN_SIZE, F.transform(F.sequence(F.lit(0), steps), lambda i: base - i * STEP))
    return F.get(F.filter(sizes, lambda s: one * s <= width), F.lit(0))


def part_of_line(x0: Column, x1: Column, text: Column, start: Column, end: Column, pad: float = 2.0) -> Column:
    """(x0, x1) of characters [start, end) of a line's box, by character weights, padded and kept inside the line."""
    total = text_width(text)
    total = F.when(total == 0, 1.0).otherwise(total)
    at = lambda n: x0 + (x1 - x0) * text_width(F.substr(text, F.lit(1), n)) / total
    return F.struct(F.greatest(at(start) - pad, x0).alias("x0"), F.least(at(end) + pad, x1).alias("x1"))


def page_fragments(lines: DataFrame, pairs: DataFrame, most: int = MOST) -> DataFrame:
    """(file, page_no, original, alias, hit, line_no, offset, x0, y0, x1, y1): boxes of all, also overlapping, matches.

    A page's lines are joined without blanks, so a match may go over lines; it has a box in each. offset is the place of
    the box's first character in the match. pairs: original, alias and, if they are of single files, file (null: all).
    Originals of blanks alone are nowhere; null texts are empty lines; equal originals with several aliases have all of them.
    """
    kept = F.filter(F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"))), lambda x: ~x["c"].rlike(BLANKS))
    own = lines.withColumn("chars", kept)
    own = own.select("file", "page_no", "line_no", "x0", "y0", "x1", "y1", "text", "chars", F.array_join(F.transform("chars", lambda x: x["c"]), "").alias("norm"))
    before = Window.partitionBy("file", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("first", F.coalesce(F.sum(F.size("chars")).over(before), F.lit(0)))
    pages = own.groupBy("file", "page_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "norm"))).alias("l"))
    pages = pages.select("file", "page_no", F.array_join(F.transform("l", lambda x: x["norm"]), "").alias("text"))
    file = F.col("file").cast("string") if "file" in pairs.columns else F.lit(None).cast("string")
    pair = F.struct("original", "alias")
    wanted = pairs.select(file.alias("file"), F.regexp_replace("original", BLANKS, "").alias("string"), pair.alias("pair")).distinct()
    strings = wanted.groupBy("file", "string").agg(F.to_json(F.array_sort(F.collect_list("pair"))).alias("value")).withColumn("id", F.lit(0).cast("long"))
    met = search(pages, cut(strings), "found", most=most).select("file", "page_no", F.explode("found").alias("f"))
    met = met.select("file", "page_no", "f.n", "f.start", F.explode(F.from_json("f.value", "array<struct<original:string,alias:string>>")).alias("pair"))
    hits = met.select("file", "page_no", "pair.original", "pair.alias", (-F.col("n")).alias("n"), F.col("start").alias("hit"))
    on = own.withColumnsRenamed({"file": "_f", "page_no": "_p"})
    inside = F.col("file").eqNullSafe(F.col("_f")) & (F.col("page_no") == F.col("_p")) & (F.col("hit") < F.col("first") + F.size("chars")) & (F.col("hit") + F.col("n") > F.col("first"))
    parts = hits.join(on, inside)
    lo, hi = F.greatest(F.col("hit") - F.col("first"), F.lit(0)), F.least(F.col("hit") + F.col("n") - F.col("first"), F.size("chars"))
    parts = parts.withColumn("s", F.get("chars", lo.cast("int"))["i"]).withColumn("e", F.get("chars", (hi - 1).cast("int"))["i"] + 1)
    parts = parts.withColumn("offset", F.greatest(F.col("first") - F.col("hit"), F.lit(0)))
    box = part_of_line(F.col("x0"), F.col("x1"), F.col("text"), F.col("s"), F.col("e"))
    return parts.select("file", "page_no", "original", "alias", "hit", "line_no", "offset", box["x0"].alias("x0"), "y0", box["x1"].alias("x1"), "y1")


def covered(box: Column, claimed: Column, share: float = 0.6) -> Column:
    """Whether more than `share` of a box lies in one of the claimed boxes."""
    area = (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])

    def over(c: Column) -> Column:
        w = F.least(box["x1"], c["x1"]) - F.greatest(box["x0"], c["x0"])
        h = F.least(box["y1"], c["y1"]) - F.greatest(box["y0"], c["y0"])
        return (w > 0) & (h > 0) & (area > 0) & (w * h / area > share)

    return F.exists(claimed, over)


def claim(fragments: DataFrame) -> DataFrame:
    """Fragments that take part, longest original first: those mostly inside an earlier box go. Adds `writes`, whether
    the alias goes here (the first box of a match) or the box is only erased."""
    box = F.struct((-F.length("original")).alias("n"), "original", "hit", "line_no", "alias", "offset", "x0", "y0", "x1", "y1")
    pages = fragments.groupBy("file", "page_no").agg(F.sort_array(F.collect_list(box)).alias("all"))
    kind = "array<struct<n:int,original:string,hit:int,line_no:int,alias:string,offset:bigint,x0:double,y0:double,x1:double,y1:double>>"
    boxes = F.col("all").cast(kind)
    kept = F.aggregate(boxes, F.array().cast(kind), lambda acc, b: F.when(covered(b, acc), acc).otherwise(F.concat(acc, F.array(b))).cast(kind))
    out = pages.select("file", "page_no", F.explode(kept).alias("b"))
    return out.select("file", "page_no", "b.original", "b.alias", "b.hit", "b.line_no", "b.offset", "b.x0", "b.y0", "b.x1", "b.y1", (F.col("b.offset") == 0).alias("writes"))


def background(pixels: DataFrame, boxes: DataFrame, zoom: float) -> DataFrame:
    """(box_id, r, g, b): median colour, 0 to 1, of the pixel row three above a box; white where it has none.

    pixels: page_no, px, py, r, g, b; boxes: box_id, page_no, x0, y0, x1, height (of the image, in pixels).
    """
    y = F.greatest(F.lit(0), F.least((F.col("y0") * zoom).cast("int") - 3, F.col("height") - 1))
    rows = boxes.select("box_id", F.col("page_no").alias("_p"), y.alias("_y"), F.greatest(F.lit(0), (F.col("x0") * zoom).cast("int")).alias("_a"), (F.col("x1") * zoom).cast("int").alias("_b"))
    met = rows.join(pixels, (F.col("_p") == F.col("page_no")) & (F.col("_y") == F.col("py")) & (F.col("px") >= F.col("_a")) & (F.col("px") < F.col("_b")), "left")
    return met.groupBy("box_id").agg(*[F.coalesce(F.median(c) / 255.0, F.lit(1.0)).alias(c) for c in ("r", "g", "b")])
