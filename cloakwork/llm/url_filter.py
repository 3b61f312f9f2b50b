"""URL filter: rules first, then the ratio of two character language models. DataFrame functions only.

Both models are variable-order Markov models of characters with Witten-Bell smoothing: the estimate after a context of
k characters gives the weight of the context's distinct followers to the estimate after k - 1 characters, down to an
even spread over the characters seen. One learns from URLs that a rule allows, one from those that a rule blocks. All
n-gram counts come from one aggregation of the longest n-grams; shorter ones are sums of it. A URL's score is the mean
over its characters of the log-likelihood difference; the threshold between the classes is calibrated on the fifth of
the ruled URLs that neither model has seen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import cut, dealt, look_up, table, upper_to_lower

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
ORDER = 3
START, END = "\x02", "\x03"
#: The most grams of a model that is broadcast: some tens of megabytes.
MOST_GRAMS = 200_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or a text without ://."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url.cast("string"), F.lit(""))
    return upper_to_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls where none does. A rule is host/path."""

    def fits(rule: str) -> Column:
        domain, _, rest = rule.partition("/")
        on_host = (host == domain) | F.endswith(host, F.lit("." + domain))
        return on_host & F.startswith(path, F.lit("/" + rest))

    longest_first = sorted(rules, key=lambda r: (-len(r[1]), r))
    none = F.lit(None).cast("string")
    pick = lambda at: reduce(lambda other, r: F.when(fits(r[1]), r[at]).otherwise(other), reversed(longest_first), none)
    return pick(1), pick(0)


def _grams(chars: str) -> Column:
    """Each character with the ORDER characters before it, of an array column of padded characters."""
    return F.transform(F.sequence(F.lit(1), F.size(chars) - ORDER), lambda i: F.array_join(F.slice(chars, i, ORDER + 1), ""))


def _estimates(counts: DataFrame) -> DataFrame:
    """(gram, llr): log-likelihood difference of the last character after the others; counts: gram, a, b."""
    model = None
    for k in range(ORDER + 1):
        level = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        level = level.withColumn("ctx", F.substring("gram", 1, k) if k else F.lit(""))
        w = Window.partitionBy("ctx")
        seen = lambda c: F.sum((F.col(c) > 0).cast("long")).over(w)
        level = level.select("gram", "a", "b", F.sum("a").over(w).alias("na"), F.sum("b").over(w).alias("nb"), seen("a").alias("ta"), seen("b").alias("tb"), F.count("*").over(w).alias("v"))
        if model is None:
            lower = level.select("gram", "a", "b", "na", "nb", "ta", "tb", (1.0 / F.col("v")).alias("la"), (1.0 / F.col("v")).alias("lb"))
        else:
            below = model.select(F.col("gram").alias("tail"), F.col("pa").alias("la"), F.col("pb").alias("lb"))
            lower = level.join(below, F.substring(level["gram"], 2, k) == below["tail"]).drop("tail")
        p = lambda n, total, kinds, least: F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(least)) / (F.col(total) + F.col(kinds))).otherwise(F.col(least))
        model = lower.select("gram", p("a", "na", "ta", "la").alias("pa"), p("b", "nb", "tb", "lb").alias("pb"))
    return model.select("gram", (F.log("pa") - F.log("pb")).alias("llr"))


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(key, host, path, rule, verdict, score, threshold): one row per row of `pages`.

    verdict is that of the longest rule that fits; without one it is allow if the mean log-likelihood difference of
    host and path reaches the threshold, else block. Null URLs and those without :// have an empty host and path; the
    empty string is scored as any other. Null keys, repeated rows and an empty table are allowed. Where no rule has
    given one of the classes, the threshold is 0.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("key", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("s"))
    rows = rows.withColumns({"s1": F.xxhash64("s"), "s2": F.xxhash64(F.lit("2"), "s")})
    texts = rows.groupBy("s1", "s2", "s", "ruled").agg(F.count("*").alias("n"))
    texts = cut(dealt(texts.withColumn("held", F.pmod("s2", F.lit(5)) == 0), "s1", "s2"))
    chars = F.split(F.concat(F.lit(START * ORDER), "s", F.lit(END)), "")
    chars = F.filter(chars, lambda c: c != "")
    long = texts.select("s1", "s2", "ruled", "held", "n", chars.alias("chars"))
    placed = long.select("s1", "s2", "ruled", "held", "n", F.explode(_grams("chars")).alias("gram"))
    learn = lambda kind: F.sum(F.when((F.col("ruled") == kind) & ~F.col("held"), F.col("n")).otherwise(0))
    counts = cut(placed.groupBy("gram").agg(learn("allow").alias("a"), learn("block").alias("b"), F.count("*").alias("w")))
    model = cut(_estimates(counts).join(counts.select("gram", "w"), "gram"))
    scored = _scores(placed.select("s1", "s2", "ruled", "gram"), model)
    scored = scored.withColumnRenamed("ruled", "r").withColumnsRenamed({"s1": "u1", "s2": "u2"})
    scored = texts.join(scored, (F.col("s1") == F.col("u1")) & (F.col("s2") == F.col("u2")) & F.col("ruled").eqNullSafe(F.col("r")))
    scored = cut(scored.select("s1", "s2", "ruled", "held", "n", "score"))
    cutoff = _threshold(scored)
    known = look_up(rows, scored.select("s1", "s2", "n", "score"), ["s1", "s2"], "n")
    by_model = F.when(F.col("score") >= cutoff, "allow").otherwise("block")
    out = known.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
    return out.withColumn("threshold", F.lit(cutoff))


def _scores(spots: DataFrame, model: DataFrame) -> DataFrame:
    """(s1, s2, ruled, score): the mean over the grams of each URL. spots: one row per gram, those of a URL together.

    A model of at most MOST_GRAMS grams is broadcast, and each task sums up its URLs before anything moves. A larger one
    meets the grams by a shuffle of both.
    """
    if model.limit(MOST_GRAMS + 1).count() <= MOST_GRAMS:
        met = spots.join(F.broadcast(model.select("gram", "llr")), "gram")
    else:
        met = look_up(spots, model, ["gram"], "w")
    return met.groupBy("s1", "s2", "ruled").agg(F.avg("llr").alias("score"))


def _threshold(scored: DataFrame) -> float:
    """Between the means of both classes, nearer to the one that spreads less; on held-out URLs where there are any."""
    w, x = F.col("n"), F.col("score")
    sums = [F.sum(w), F.sum(w * x), F.sum(w * x * x)]
    rows = scored.filter(F.col("ruled").isNotNull()).groupBy("held", "ruled").agg(*sums).collect()
    by = {(r[0], r[1]): (r[3] / r[2], max(r[4] / r[2] - (r[3] / r[2]) ** 2, 1e-12) ** 0.5) for r in rows}
    for held in (True, False):
        if (held, "allow") in by and (held, "block") in by:
            (a, sa), (b, sb) = by[held, "allow"], by[held, "block"]
            return float((a * sb + b * sa) / (sa + sb))
    return 0.0


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its host, path, rule and verdict."""
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op3_url_filter": op3_url_filter}
ORACLES: dict[str, str] = {}
