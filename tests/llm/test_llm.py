"""The training-data operators against brute force and exact round trips, with nulls, empty, repeated and long rows."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cloakwork.llm import chat_format, decontaminate, iblt, language, line_dedup, pieces, similar, simhash, token_counts, toxicity, url_filter
from cloakwork.llm.common import least_hashed, look_up
from conftest import DATA

CLASH = "key string, fp int, pos int, t string, d int, row int, text_ string, h1 int, found boolean, n_lines string"
WORDS = "the of anin whhe lynt herent on in reti tion ed ing es".split()


def docs(spark, rows):
    """(doc_id, text) and columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "k", 1, 2, "t", 3, 4, "x", 5, True, "n") for i, t in rows], f"doc_id long, text string, {CLASH}")


def make_text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


EDGES = [(1, "One line.\nTwo"), (2, None), (3, ""), (None, "One line.\nTwo"), (1, "One line.\nTwo"), (4, " \t\n"), (5, "ab " * 20000), (6, "Ünïcødé 漢字 😀 \x00 end"), (7, "\n".join(["same"] * 40))]


@pytest.fixture
def empty(spark):
    return docs(spark, [])


# --- 1 ---
def edits_within(item, text):
    """Least edits of item against any part of text (semi-global alignment, in full)."""
    best = np.arange(len(item) + 1)
    least = best[-1]
    for c in text:
        new = np.empty_like(best)
        new[0] = 0
        for i in range(1, len(item) + 1):
            new[i] = min(best[i - 1] + (item[i - 1] != c), best[i] + 1, new[i - 1] + 1)
        best = new
        least = min(least, best[-1])
    return least


HAN = "的一是不了人我在有他这中大来上个国到说们"


def within(item, text):
    """Edits of the item's best place in the text if they are within its budget."""
    m = len(item)
    e = edits_within(item, text)
    return e if e <= min(int(0.1 * m), (m - 8) // 8) else None


def test_decontamination_equals_full_alignment(spark):
    """Also in Chinese, where a changed character is one edit; items and texts without blanks."""
    rng = random.Random(1)
    items = [(i, make_text(rng, rng.randrange(8, 20))) for i in range(6)] + [(10 + i, "".join(rng.choices(HAN, k=rng.randrange(16, 90)))) for i in range(6)] + [(98, None), (99, "")]
    rows = []
    for d in range(70):
        passage = list(rng.choice(items[:12])[1])
        for _ in range(rng.randrange(12)):
            k = rng.randrange(len(passage))
            passage[k : k + 1] = rng.choice([[], ["国"], ["x", passage[k]]])
        rows.append((d, make_text(rng, 5) + " " + "".join(passage).upper() + "\n" + "".join(rng.choices(HAN, k=9)) + make_text(rng, 4)))
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated_regions(docs(spark, rows), spark.createDataFrame(items, "item_id int, text string")).collect()}
    fold = lambda s: decontaminate.folded(s)
    want = {(d, i): within(fold(item), fold(t)) for d, t in rows for i, item in items[:12]}
    want = {k: e for k, e in want.items() if e is not None}
    assert got == want and sum(e > 0 for e in want.values()) > 5 and sum(i >= 10 for _, i in want) > 5


def test_decontamination_edges(spark, empty):
    bench = spark.createDataFrame([(1, "One line. Two"), (2, None), (3, "short"), (4, "ab ab ab ab ab ab ab ab ab ab"), (5, "o"), (6, "漢")], "item_id int, text string")
    table = docs(spark, EDGES)
    found = decontaminate.contaminated_regions(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (None, 1), (5, 4), (6, 6)}  # the letter o is in no text as a word
    assert [(r.start, r.end, r.edits) for r in found if r.doc_id is None] == [(0, 13, 0)]
    kept = decontaminate.without_contaminated(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 7]
    assert decontaminate.contaminated_regions(empty, bench).count() == 0 and decontaminate.without_contaminated(table, bench.limit(0)).count() == len(EDGES)
    wide = docs(spark, [(1, "é" * 10 + " One line. Two😀")])
    assert [(r.start, r.end) for r in decontaminate.contaminated_regions(wide, bench).collect()] == [(11, 24)]


def test_decontamination_by_several_blocks(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, make_text(rng, 12)) for i in range(9)]
    bench = spark.createDataFrame(items + items[:2], "item_id int, text string")
    rows = docs(spark, [(d, make_text(rng, 4) + " " + items[d % 9][1]) for d in range(20)] + [(77, "clean text")])
    one = sorted(map(tuple, decontaminate.contaminated_regions(rows, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK", 100)
    assert len(list(decontaminate.blocks(bench))) > 3
    assert sorted(map(tuple, decontaminate.contaminated_regions(rows, bench).collect())) == one and len(one) >= 20
    assert [r.doc_id for r in decontaminate.without_contaminated(rows, bench).collect()] == [77]


def test_decontamination_in_pieces(monkeypatch):
    index = decontaminate.Index([(7, "the quick brown fox jumps over the lazy dog again and again"), (8, "yy")])
    text = "zz " * 300 + "The quick brown fox jumps over the lazy dog again and again" + " yyy yy" * 100
    whole = index.regions([text])
    monkeypatch.setattr(decontaminate, "CHUNK", 64)
    assert index.regions([text]) == whole
    assert [f[1:] for f in whole if f[1] == 7] == [(7, 900, 959, 0)] and len(whole) == 101


def test_decontamination_does_not_depend_on_the_texts_beside():
    """Items without their first or last characters, at both ends of texts of one batch, and an item parted by two texts."""
    rng = random.Random(4)
    items = [make_text(rng, n) for n in (12, 30, 60)]
    index = decontaminate.Index(list(enumerate(items)))
    texts = [make_text(rng, 6)]
    for i, item in enumerate(items):
        k = int(index.k[i])
        for j in {0, 1, k // 2, k, k + 1}:
            texts += [item[j:] + " and more", "more and " + item[: len(item) - j], item[j:]]
            texts += ["other words " + item[: k + 4], item[k + 4 :] + " other words", ""]
    rows = index.regions(texts)
    assert rows == [(r, *f[1:]) for r, t in enumerate(texts) for f in index.regions([t])]
    got = {(f[0], f[1]): f[4] for f in rows}
    want = {(r, i): edits_within(item, t) for r, t in enumerate(texts) for i, item in enumerate(items)}
    assert got == {x: e for x, e in want.items() if e <= index.k[x[1]]}
    assert all(0 <= s < e <= len(texts[r]) for r, _, s, e, _ in rows)


def test_items_with_a_common_prompt():
    """A thousand items share a prompt, at their beginning or in their middle: results as one by one, in bounded time."""
    rng = random.Random(6)
    prompt = make_text(rng, 40) + " "
    items = [(i, (make_text(rng, i % 3) + " " if i % 2 else "") + prompt + make_text(rng, 3 + i % 9)) for i in range(1000)]
    index = decontaminate.Index(items)
    assert len(index.size) < 3 * len(items)
    text = "".join(c if rng.random() > 0.03 else "x" for c in items[3][1]) + " . " + items[8][1][4:]
    got = {}
    for f in index.regions([text]):
        got[f[1]] = min(f[4], got.get(f[1], 99))
    want = {i: within(t.strip(), text) for i, t in items[:60]}
    assert {i: e for i, e in got.items() if i < 60} == {i: e for i, e in want.items() if e is not None} and len(got) > 2
    began = time.time()
    index.regions([prompt * (27_000 // len(prompt))])
    assert time.time() - began < 15


def test_decontamination_is_linear_in_repeats():
    index = decontaminate.Index([(1, "a short item of some characters"), (2, "tiny")])
    took = []
    for n in (2000, 16000):
        began = time.time()
        found = index.regions(["a short item of some characters tiny " * n])
        took.append(time.time() - began)
        assert len(found) == 2 * n and not any(f[4] for f in found)
    assert took[1] < 24 * took[0] + 1


# --- 2 ---
def test_sketch_recovers_the_difference():
    rng = random.Random(2)
    for n in (0, 1, 5, 60, 700):
        a = "\n".join(make_text(rng, 6) + str(k) for k in range(n))
        b = a.replace("7", "x") + "\nmore\nmore"
        da, db = iblt.digests(a), iblt.digests(b)
        only_a, only_b = iblt.differences([da], [db])[0]
        assert set(only_a.tolist()) == set(da.tolist()) - set(db.tolist()) and set(only_b.tolist()) == set(db.tolist()) - set(da.tolist())
        assert len(set(db.tolist())) == len(iblt.paragraphs(b))


def test_fingerprints_of_neighbours(spark, empty):
    rng = random.Random(3)
    rows = [(i * 3, make_text(rng, rng.randrange(60)) + ". É" * (i % 4)) for i in range(50)] + [(1000, None), (-5, "")]
    got = {r.doc_id: r for r in iblt.fingerprints(docs(spark, rows)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        n = len(t) // 3
        new = t[: len(t) - n] + nxt[:n]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())

        def near(x, y):
            a, b = Counter(iblt.paragraphs(x)), Counter(iblt.paragraphs(y))
            total = a.total() + b.total()
            return 1 - ((a - b).total() + (b - a).total()) / total if total else 1.0

        assert r.near_edited == pytest.approx(near(t, new)) and r.near_next == pytest.approx(near(t, nxt))
    assert got[1000].fingerprint == got[-5].fingerprint
    edges = iblt.fingerprints(docs(spark, EDGES)).collect()
    assert len(edges) == len(EDGES) and len({r.fingerprint for r in edges if r.doc_id in (1, None)}) == 1
    assert iblt.fingerprints(empty).count() == 0
    assert iblt.fingerprints(docs(spark, [(1, "alone")])).first().near_next == 1.0
    with pytest.raises(TypeError):
        iblt.fingerprints(spark.createDataFrame([("a", "x")], "doc_id string, text string"))


def test_neighbours_meet_whatever_the_ranges(spark):
    """Every row has its next one, with many more ranges than documents, repeated and negative keys, and nulls."""
    keys = [5, 5, 5, -3, 0, 2**60, None, None, 17]
    rows = [(k, f"t{i}") for i, k in enumerate(keys)]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter((k, hashlib.sha256((t[:2] + nxt[:0] if len(t) < 3 else t).encode()).hexdigest()) for (k, t), (_, nxt) in zip(order, order[1:] + order[:1]))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("3", "40"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = iblt.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
            assert Counter((r.doc_id, r.edited_sha256) for r in got) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


# --- 3 ---
def brute_llr(urls, order=3):
    """The ratio by plain loops: dictionaries of contexts, one character at a time."""
    counts = {c: defaultdict(Counter) for c in ("allow", "block")}
    kinds = defaultdict(set)
    pad = lambda s: "\x02" * order + s + "\x03"
    for s, c, held in urls:
        p = pad(s)
        for i in range(order, len(p)):
            for k in range(order + 1):
                if c and not held:
                    counts[c][p[i - k : i]][p[i]] += 1
                if k == 0:
                    kinds[""].add(p[i])
    v = len(kinds[""])

    def prob(c, ctx, ch):
        least = prob(c, ctx[1:], ch) if ctx else 1 / v
        f = counts[c][ctx]
        return (f[ch] + len(f) * least) / (f.total() + len(f)) if f.total() else least

    out = {}
    for s, _, _ in urls:
        p = pad(s)
        out[s] = np.mean([np.log(prob("allow", p[i - order : i], p[i])) - np.log(prob("block", p[i - order : i], p[i])) for i in range(order, len(p))])
    return out


def test_url_scores_equal_plain_loops(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").limit(60)
    rows = url_filter.judge_urls(pages).join(pages.select(F.col("page_id").alias("p"), "url"), F.col("page_id") == F.col("p")).collect()
    held = {r.s: r.h for r in spark.createDataFrame([(r.host + r.path,) for r in rows], "s string").select("s", (F.pmod(F.xxhash64(F.lit("2"), "s"), F.lit(5)) == 0).alias("h")).collect()}
    want = brute_llr([(r.host + r.path, r.verdict if r.rule else None, held[r.host + r.path]) for r in rows])
    for r in rows:
        assert r.score == pytest.approx(want[r.host + r.path], abs=1e-9)
        host = r.url.split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0]
        assert r.host == host.lower()
        rules = [(len(u), u, v) for v, u in url_filter.RULES if (r.host == u.split("/")[0] or r.host.endswith("." + u.split("/")[0])) and r.path.startswith("/" + u.split("/", 1)[1])]
        assert (r.rule, r.verdict if r.rule else None) == (max(rules)[1:] if rules else (None, None))


def test_url_verdicts_and_threshold_equal_plain_loops(spark, monkeypatch):
    """Threshold from the means and spreads of held-out ruled URLs, verdicts from it; by a broadcast model and by a shuffle."""
    pages = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.1')}/pages.parquet")
    pages = pages.union(pages.limit(9)).select("page_id", "url")
    got = sorted(map(tuple, url_filter.judge_urls(pages).collect()), key=str)
    rows = [dict(zip(("id", "host", "path", "rule", "verdict", "score", "threshold"), r)) for r in got]
    texts = Counter((r["host"] + r["path"], r["verdict"] if r["rule"] else None) for r in rows)
    held = {r.s: r.h for r in spark.createDataFrame([(t,) for t, _ in texts], "s string").select("s", (F.pmod(F.xxhash64(F.lit("2"), "s"), F.lit(5)) == 0).alias("h")).collect()}
    score = {r["host"] + r["path"]: r["score"] for r in rows}
    spread = {}
    for kind in ("allow", "block"):
        x = np.repeat([score[t] for t, v in texts if v == kind and held[t]], [n for (t, v), n in texts.items() if v == kind and held[t]])
        spread[kind] = x.mean(), x.std()
    (a, sa), (b, sb) = spread["allow"], spread["block"]
    cutoff = (a * sb + b * sa) / (sa + sb)
    assert a > cutoff > b and {round(r["threshold"], 9) for r in rows} == {round(cutoff, 9)}
    free = [r for r in rows if not r["rule"]]
    assert len(free) > 10 and all((r["verdict"] == "allow") == (r["score"] >= cutoff) for r in free)
    right = [r["verdict"] == ("allow" if r["score"] >= cutoff else "block") for r in rows if r["rule"] and held[r["host"] + r["path"]]]
    assert np.mean(right) > 0.8
    monkeypatch.setattr(url_filter, "MOST_GRAMS", 0)
    again = sorted(map(tuple, url_filter.judge_urls(pages).collect()), key=str)
    assert [r[:5] for r in again] == [r[:5] for r in got] and np.allclose([r[5] for r in again], [r[5] for r in got])


def test_url_edges(spark):
    rows = [(1, None), (2, ""), (None, "no scheme"), (3, "HTTP://A.Example.NET/en/x?y#z"), (3, "HTTP://A.Example.NET/en/x?y#z"), (4, "x://net"), (5, "x://net/"), (6, "x://a://b/c"), (7, "x://h/" + "a" * 5000), (8, "http://notexample.net/en/")]
    table = spark.createDataFrame([(i, u, "c") for i, u in rows], "page_id long, url string, s1 string")
    got = sorted(((r.page_id, r.host, r.path[:5], r.rule) for r in url_filter.judge_urls(table).collect()), key=str)
    assert got == sorted([(1, "", "", None), (2, "", "", None), (None, "", "", None), (3, "a.example.net", "/en/x", "example.net/en/"), (3, "a.example.net", "/en/x", "example.net/en/"), (4, "net", "", None), (5, "net", "/", "net/"), (6, "a:", "//b/c", None), (7, "h", "/aaaa", None), (8, "notexample.net", "/en/", "net/")], key=str)
    assert url_filter.judge_urls(table.limit(0)).count() == 0


def test_least_hashes(spark):
    keys = spark.range(3000).select(F.col("id").alias("k"))
    want = [r.k for r in keys.orderBy(F.xxhash64("k")).limit(40).collect()]
    assert sorted(r.k for r in least_hashed(keys, 40).collect()) == sorted(want) and least_hashed(keys.limit(7), 40).count() == 7


def test_look_up_with_hot_keys(spark):
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    small = big.groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("m")).filter("k % 2 = 1")
    got = {r.id: (r.found, r.m) for r in look_up(big, small, ["k"], "w", parts=4).collect()}
    want = {r.id: (r.m is not None, r.m) for r in big.join(small, "k", "left").collect()}
    assert got == want


# --- 4 ---
def test_toxicity(spark, empty):
    rng = random.Random(5)
    rows = [(i, make_text(rng, 30) + (" you rotten scoundrel" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    train = spark.createDataFrame([(t, y) for _, t, y in rows[:300]] + [(None, 0), ("x", None)], "text string, label int")
    model = toxicity.fit(train)
    table = docs(spark, [(i, t) for i, t, _ in rows[300:]] + EDGES)
    got = {r.doc_id: r.score for r in toxicity.score(table, model).filter("doc_id >= 300").collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows[300:])
    assert toxicity.score(docs(spark, EDGES), model).count() == len(EDGES) and toxicity.score(empty, model).count() == 0
    blank = {r.score for r in toxicity.score(docs(spark, [(1, None), (2, "")]), model).collect()}
    assert len(blank) == 1 and 0 <= blank.pop() <= 1
    nothing = toxicity.fit(train.limit(0))
    assert nothing[2] == 0 and len(nothing[0]) == 0 and toxicity.score(docs(spark, [(1, "a")]), nothing).first().score == 0.5


def test_ftrl_equals_a_plain_loop():
    """Each coordinate by itself, in dictionaries; the L1 penalty leaves few weights."""
    rng = random.Random(15)
    rows = [(sorted(rng.sample(range(60), rng.randrange(1, 12))), rng.randrange(2)) for _ in range(300)]
    rows = [(x + [61] if y else x, y) for x, y in rows]
    model = toxicity.Ftrl()
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        l1 = 0.0 if i == "bias" else model.l1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((model.beta + n[i] ** 0.5) / model.alpha + model.l2)

    for x, y in rows:
        model.learn(np.array(x), y)
        on = [*x, "bias"]
        w = {i: weight(i) for i in on}
        g = (1 / (1 + np.exp(-sum(w.values()))) - y) * (model.positive if y else 1.0)
        for i in on:
            sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / model.alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
    got = model.weights()
    assert got[-1] == pytest.approx(weight("bias"), abs=1e-9)
    assert np.allclose(got[:62], [weight(i) for i in range(62)], atol=1e-9) and not got[62:-1].any()
    assert got[61] > 0.5 and np.count_nonzero(got[:60]) < 45


def test_toxicity_equals_a_plain_loop(spark):
    """The fitted model and its scores, by loops over the same features in the same order; whatever the partitions are."""
    rng = random.Random(16)
    rows = [(make_text(rng, 12) + (" rotten" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    at, w, bias = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    again = toxicity.fit(spark.createDataFrame(rows[::-1], "text string, label int").repartition(7))
    assert (at == again[0]).all() and (w == again[1]).all() and bias == again[2]
    seen = [(np.unique(toxicity.features([t])[1]).astype(np.int32), y) for t, y in rows]
    seen.sort(key=lambda r: (xxhash.xxh3_128_digest(r[0].tobytes()), r[1]))
    model = toxicity.Ftrl()
    for _ in range(5):
        for x, y in seen:
            model.learn(x, y)
    assert np.allclose(model.weights(at), w) and np.count_nonzero(model.weights()[:-1]) == len(at)
    table = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    known = dict(zip(at.tolist(), w.tolist()))
    for r in toxicity.score(table, (at, w, bias)).collect():
        total = bias + sum(known.get(i, 0.0) for i in set(toxicity.features([rows[r.doc_id][0]])[1].tolist()))
        assert r.score == pytest.approx(1 / (1 + np.exp(-total)))


def test_labels_that_clash(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1), (3, None), (9, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.sample_labelled(table, labels, "toxic").collect())) == [("a", 1), ("b", 1), ("c", 0)]
    assert toxicity.sample_labelled(table, labels, "toxic", limit=1).count() >= 1


def test_held_out_remainders(spark):
    from cloakwork.llm.common import crc_mod

    got = [r.m for r in spark.range(50).select(crc_mod(F.col("id"), 5).alias("m")).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]


def test_features_see_pairs_and_skips():
    a, b = (toxicity.features([t]) for t in ("one two three", "three two one"))
    assert len(a[1]) == 3 + 3 + 2 + 1 and set(a[1].tolist()) != set(b[1].tolist())
    row, at = toxicity.features(["One two", "", "one TWO"])
    assert set(at[row == 0].tolist()) == set(at[row == 2].tolist()) and 1 not in row


# --- 5 ---
def test_language_on_held_out_documents(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.op5_language(spark, DATA).join(table.select(F.col("doc_id").alias("d"), "lang"), F.col("doc_id") == F.col("d")).filter("held_out").collect()
    assert len(got) > 30 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_votes_equal_plain_loops():
    """Families duel first, then the languages of the winner: votes counted one by one, and the least chance of its duels."""
    rng = np.random.default_rng(3)
    langs = ["de", "en", "es", "fr", "it", "nl", "xx"]
    machines = {}
    families = sorted({language.family_of(x) for x in langs})
    for group, names in [("", families), *[(f, [x for x in langs if language.family_of(x) == f]) for f in families]]:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                machines[group, a, b] = np.append(rng.normal(0, 3, language.BUCKETS), 0.01)
    model = language.Model(machines, langs)
    texts = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz éß", k=12)) for i in range(60)]
    x, _ = language.vectors(texts)

    def duel(v, group, names):
        votes, total, chance = ({n: 0.0 for n in names} for _ in range(3))
        chance = {n: 1.0 for n in names}
        for (g, a, b), w in machines.items():
            if g == group:
                m = float(v @ w[:-1].astype(np.float32) + np.float32(w[-1]))
                votes[a if m >= 0 else b] += 1
                total[a] += m
                total[b] -= m
                p = 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
                chance[a], chance[b] = min(chance[a], p), min(chance[b], 1 - p)
        best = max(names, key=lambda n: votes[n] + 1e-3 * np.tanh(total[n]))
        return best, chance[best]

    got = list(zip(*model.predict(texts)))
    seen = set()
    for v, (lang, score) in zip(x, got):
        family, sure = duel(v, "", families)
        want, chance = duel(v, family, [n for n in langs if language.family_of(n) == family])
        assert lang == want and score == pytest.approx(sure * chance, rel=1e-3, abs=1e-6)
        seen.add(lang)
    assert len(seen) > 3


def test_svm_meets_its_optimality_conditions():
    """The machine's loss can't be made smaller along any coordinate, and both classes weigh the same."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 6)).astype(np.float32)
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0, 1]) + 0.3 * rng.normal(size=80) > 0.8, 1.0, -1.0)
    w = language.svm(x, y, epochs=400)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * 8.0

    def loss(v):
        return 0.5 * (v**2).sum() + (cost * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()

    for i in range(len(w)):
        for step in (-0.02, 0.02):
            moved = w.copy()
            moved[i] += step
            assert loss(moved) > loss(w)


def test_language_edges(spark, empty):
    model = language.Model({("", "a", "b"): np.append(np.zeros(language.BUCKETS), 1.0)}, ["a", "b"])
    got = {r.doc_id: r.lang_pred for r in language.predict(docs(spark, [*EDGES, (8, "123 !?")]), model).filter("doc_id is not null").collect()}
    assert got[2] == got[3] == got[4] == got[8] == "und" and got[1] == got[6] == "a"
    assert language.predict(empty, model).count() == 0
    none = language.fit(spark.createDataFrame([(None, "abc")], "lang string, text string"))
    assert language.predict(docs(spark, [(1, "abc")]), none).first().lang_pred == "und"
    one = language.fit(spark.createDataFrame([("xx", "abc")], "lang string, text string"))
    assert language.predict(docs(spark, [(1, "abc")]), one).first().lang_pred == "xx"
    kept = language.keep_recognised(docs(spark, [*EDGES, (8, "123")]), model)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "5", "6", "7", "None"]


def test_rare_languages_are_sampled(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    table = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    order = [r.doc_id for r in table.orderBy(F.xxhash64("doc_id")).collect()]
    lang = F.when(F.col("doc_id").isin(order[-3:]), "fi").otherwise("en")
    got = Counter(r.lang for r in language.sample(table.withColumn("lang", lang), limit=20).collect())
    assert got == {"en": 200, "fi": 3}


def test_documents_in_unlearnt_languages_go(spark):
    """German without labels, Cyrillic, Chinese and letters at random are not recognised; all that was learnt stays."""
    import corpus_pipeline

    rng = random.Random(13)
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", F.when(F.col("lang") != "de", F.col("lang")).alias("lang"))
    junk = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(60)) for _ in range(20)]
    junk += ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 3, "人人生而自由，在尊严和权利上一律平等。" * 9]
    rows = table.union(spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(junk)], table.schema)).cache()
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, rows, DATA).collect()}
    known, unknown = ({r.doc_id for r in rows.filter(F.col("lang").isNotNull() == x).collect()} for x in (True, False))
    assert known <= kept and not any(i >= 10**6 for i in kept)
    assert len(unknown) > 40 and len(kept & unknown) < len(unknown) / 10


def test_least_score_of_all_held_out_documents(spark):
    """More than 2,000 held-out documents: the threshold is the percentile of all their right answers' scores."""
    rng = random.Random(5)
    w = np.append(np.random.default_rng(5).normal(0, 0.4, language.BUCKETS), 0.3)
    model = language.Model({("", "a", "b"): w}, ["a", "b"])
    rows = [(i, "".join(rng.choices("abcdefgh ", k=rng.randint(1, 9))), rng.choice(["a", "b", None])) for i in range(16_000)]
    held = [(t, lang) for i, t, lang in rows if lang and zlib.crc32(str(i).encode()) % 4 == 2]
    lang, score = model.predict([t for t, _ in held])
    right = [s for p, s, (_, want) in zip(lang, score, held) if p == want]
    assert len(held) > 2_400
    got = language.least_score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model)
    assert got == pytest.approx(language.SHARE * np.percentile(right, 1), abs=1e-9)
    some = spark.createDataFrame([(s,) for s in right], "score double")
    assert [language.nth(some, k) for k in (0, 7, len(right) - 1)] == [sorted(right)[k] for k in (0, 7, len(right) - 1)]
    assert language.least_score(spark.createDataFrame([], "doc_id long, text string, lang string"), model) == 0


def test_machines_of_all_documents(spark):
    """Every document outside the held-out quarter is in a group, those of a rare language in all; a machine is the mean
    of the groups', and one group gives what fit gives."""
    rng = random.Random(6)
    abc = {"en": "abcdefgh ", "de": "efghijkl ", "fi": "xyzäö "}
    rows = [(i, "".join(rng.choices(abc.get(x, "abc "), k=30)), x) for i, x in enumerate(["en"] * 300 + ["de"] * 300 + ["fi"] * 8 + [None] * 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    in_groups = language.groups_of(table, size=100, each=10).collect()
    n = -(-len(learnt) // 100)
    fi = [t for _, t, x in learnt if x == "fi"]
    assert {r.text for r in in_groups} == {t for _, t, _ in learnt} and {r.grp for r in in_groups} == set(range(n)) and n > 3
    assert Counter(r.text for r in in_groups if r.lang == "fi") == {t: n for t in fi} and all(c == 1 for t, c in Counter(r.text for r in in_groups if r.lang != "fi").items())
    got = language.fit_all(table, size=100, each=10)
    one = [language.fit(spark.createDataFrame([(r.lang, r.text) for r in in_groups if r.grp == g], "lang string, text string")) for g in range(n)]
    assert got.langs == ["de", "en", "fi"] and sorted(got.keys) == [("", "fi", "germanic"), ("germanic", "de", "en")]
    for k, key in enumerate(got.keys):
        assert np.allclose(got.w[:, k], np.mean([m.w[:, m.keys.index(key)] for m in one], axis=0), atol=1e-6)
    whole, same = language.fit_all(table), language.fit(table.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
    assert np.array_equal(whole.w, same.w[:, [same.keys.index(k) for k in whole.keys]])


# --- 6 ---
def brute_components(rows, words=4, most=4):
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    least = {i: i for i in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= most and least[j] < least[i]:
                    least[i] = least[j]
                    changed = True
    by_row = [min(rows[k][0] for k in range(len(rows)) if least[k] == least[i]) for i in range(len(rows))]
    return [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, by_row)]


def test_simhash_components(spark, empty):
    rng = random.Random(6)
    rows = []
    for i in range(80):
        if i % 3 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            w[rng.randrange(len(w))] = "new"
            rows.append((100 - i, " ".join(w)))
        else:
            rows.append((100 - i, make_text(rng, rng.choice([2, 60, 400]))))
    rows += [(500, None), (501, " \n"), (100, rows[0][1])]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.near_duplicates(docs(spark, EDGES)).count() == len(EDGES)


def test_all_pairs_within_four_bits_link(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for k in range(7):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    want = {(min(a, b), max(a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 4}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    got = {tuple(sorted(x % 2**64 for x in r)) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()}
    assert got == want and len(want) > 100


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int32)[:: 97]
    index = simhash.codeword(words)
    assert set(range(4096)) == set(simhash.codeword(np.arange(1 << 23, dtype=np.int32)[::7]).tolist())
    high, low, errors = simhash._syndromes()
    code = words ^ errors[high[words >> 11] ^ low[words & 2047]]
    assert np.bitwise_count(code ^ words).max() == 3 and (code >> 11 == index).all()


def test_components_of_a_chain(spark, monkeypatch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (103, 101)], "u long, v long")
    want = {**{i: 0 for i in range(1, 31)}, 101: 100, 103: 100}
    assert {r.node: r.root for r in simhash.components(edges).collect()} == want
    monkeypatch.setattr(simhash, "FEW_EDGES", 0)
    short = edges.filter("u < 5 OR u >= 100")
    assert {r.node: r.root for r in simhash.components(short).collect()} == {k: v for k, v in want.items() if k <= 5 or k > 100}


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Keys that many fingerprints share: the components are those of all pairs, and far fewer links are made."""
    rng = random.Random(17)
    center, far = rng.getrandbits(64), rng.getrandbits(64)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = {flip(center, rng.randrange(3)) for _ in range(400)} | {flip(center, 7) for _ in range(30)} | {flip(far, rng.randrange(5)) for _ in range(30)}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    frame = spark.createDataFrame(signed, "fp long")
    roots = {f: f for f in fps}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    pairs = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    for a, b in pairs:
        roots[find(b)] = find(a)
    want = Counter(find(f) for f in fps)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    monkeypatch.setattr(simhash, "HOT", 20)
    found = simhash.links(frame).collect()
    assert {tuple(sorted((r.u % 2**64, r.v % 2**64))) for r in found} <= set(pairs) and len(found) < len(pairs) / 3
    for r in found:
        a, b = find(r.u % 2**64), find(r.v % 2**64)
        assert a == b
    again = {f: f for f in fps}

    def look(x):
        while again[x] != x:
            x = again[x]
        return x

    for r in found:
        again[look(r.v % 2**64)] = look(r.u % 2**64)
    assert sorted(Counter(look(f) for f in fps).values()) == sorted(want.values()) and len(want) > 3


def test_one_of_each(spark):
    table = docs(spark, [(3, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (9, "something else entirely here now")])
    kept = simhash.one_of_each(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [2, 9]


# --- 7 and 9 ---
def test_pieces_equal_the_library(spark, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(8)
    alphabet = ["a", "b", "aa", " ", "  ", "\n", "ab", "é", "▁", "漢", "😀", "\x00", "the", " the", "er", "<s>", "<0x41>", "1", "　", "\t", "\r\n"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(800)] + ["a" * 3000, "abab" * 700, " " * 50]
    rows = list(enumerate(texts)) + [(9000 + k, t) for k, (_, t) in enumerate(EDGES)]
    table = docs(spark, rows)
    ids = pieces.encoded(table)
    got = {r.doc_id: r for r in pieces.digests(table).collect()}
    lists = {r.doc_id: list(r.ids) for r in ids.collect()}
    back = {r.doc_id: r.text for r in pieces.decoded(ids).collect()}
    for i, t in rows:
        want = lib.encode(t or "", add_bos=True, add_eos=True)
        assert lists[i] == want and back[i] == lib.decode(want) and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256(lib.decode(want).encode()).hexdigest()
    assert pieces.digests(empty).count() == 0


def test_merging_all_at_once_equals_one_at_a_time():
    codec = pieces.PieceCodec(pieces.model_path())
    rng = random.Random(9)
    words = ["".join(rng.choices("aehinrst", weights=[3, 5, 2, 3, 3, 2, 4, 4], k=rng.randrange(1, 40))) for _ in range(3000)]
    lengths = np.array(list(map(len, words)))
    symbols = codec.char_symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    codec._input = symbols
    fast, slow = codec.merge(symbols, lengths), codec.merge(symbols, lengths, True)
    assert (fast[0] == slow[0]).all() and (fast[1] == slow[1]).all()


def test_all_words_of_a_batch_encoded_again(monkeypatch):
    """If all at once is wrong for every word, nothing is done before the second way."""
    codec = pieces.PieceCodec(pieces.model_path())
    words = ["thethe", "inin", "a"]
    lengths = np.array(list(map(len, words)))
    symbols = codec.char_symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    codec._input = symbols
    want = codec.merge(symbols, lengths, True)
    monkeypatch.setattr(codec, "_too_early", lambda symbols, word, best, hit, merged: np.unique(word))
    for n in (1, 2):
        codec._input = symbols[: lengths[:n].sum()]
        got = codec.merge(codec._input, lengths[:n])
        assert (got[1] == want[1][:n]).all() and (got[0] == want[0][: want[1][:n].sum()]).all()


def test_token_limits(spark):
    one = pieces.PieceCodec(pieces.model_path())
    sizes = sorted(len(one.encode(r.text or "")) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect())
    for r in token_counts.token_limits(spark, DATA).collect():
        if r.kind == "limit":
            assert (r.n, r.total) == (sum(s > r.at for s in sizes), sum(min(s, r.at) for s in sizes))
        else:
            assert r.n == sizes[max(0, int(np.ceil(r.at * len(sizes) - 1e-9)) - 1)] and r.total is None


def test_length_histogram(spark):
    rng = random.Random(10)
    sizes = [rng.choice([1, 2, 2, rng.randrange(5000)]) for _ in range(500)]
    table = spark.createDataFrame([(n, "ab"[n % 2]) for n in sizes], "n_tokens long, g string")
    hist = token_counts.length_histogram(table.select("n_tokens"))
    for r in hist.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_from, r.docs_to) == (sizes.count(n), sum(x >= n for x in sizes), sum(x <= n for x in sizes))
        assert (r.tokens_from, r.tokens_to, r.truncated_total) == (sum(x for x in sizes if x >= n), sum(x for x in sizes if x <= n), sum(min(x, n) for x in sizes))
    assert [(r.context_limit, r.docs_cut, r.truncated_total) for r in token_counts.at_limits(hist, [0, 3, 2048, 10**6]).collect()] == [(x, sum(s > x for s in sizes), sum(min(s, x) for s in sizes)) for x in (0, 3, 2048, 10**6)]
    assert [r.n_tokens for r in token_counts.quantiles(hist, [0.5, 1.0]).collect()] == [sorted(sizes)[249], max(sizes)]
    grouped = token_counts.length_histogram(table.select("g", "n_tokens"), ("g",))
    assert {(r.g, r.n_tokens): r.docs_to for r in grouped.collect()} == {(g, n): sum(x <= n for x in sizes if "ab"[x % 2] == g) for n in sizes for g in ["ab"[n % 2]]}
    assert token_counts.length_histogram(table.select("n_tokens").limit(0)).count() == 0


def test_encoded_lengths(spark):
    table = docs(spark, EDGES)
    one = pieces.PieceCodec(pieces.model_path())
    got = Counter((r.key, r.n_tokens) for r in token_counts.encoded_lengths(table, by=("key",)).collect())
    assert got == Counter(("k", len(one.encode(t or ""))) for _, t in EDGES)


# --- 8 ---
def test_chat_round_trip(spark):
    rng = random.Random(11)
    parts = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "user", "x", "<\\|", "im_end|>"]
    said = [(c, t, rng.choice(["user", "assistant", "system", "we\nird\\", "", "<|"]), "".join(rng.choices(parts, k=rng.randrange(9)))) for c in range(60) for t in range(rng.randrange(1, 6))]
    said += [(900, 1, None, None), (900, 0, "user", "a"), (901, 0, "user", "q"), (901, 1, "assistant", "r"), (901, 1, "assistant", "r"), (None, 5, "user", "z")]
    table = spark.createDataFrame([(*s, "x") for s in said], "conv_id long, turn long, role string, text string, formatted string")
    chats = {r.conv_id: r for r in chat_format.format_chats(table).collect()}
    read = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(table)).collect()}
    for c in {s[0] for s in said}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((s[0], s[1], s[2] or "", s[3] or "") for s in said if s[0] == c)] if c is not None else [("user", "z")]
        assert chat_format.parse(chats[c].formatted, chat_format.Template()) == turns
        assert "".join(x.text for x in chats[c].segments) == chats[c].formatted
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (read[c].n_turns, read[c].loss_chars, read[c].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert chats[c].formatted.count("<|im_end|>") == len(turns)
    assert chats[901].fault == 2 and not chats[901].valid and chats[None].fault == 1
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_machine_and_marks(spark):
    template = chat_format.Template()
    assert chat_format.first_fault(["system", "user", "assistant", "user", "assistant"], template) is None
    for roles, at in ((["assistant"], 0), (["user", "user"], 1), (["user", "system"], 1), (["system"], 1), ([], 0), (["user", "assistant", "assistant"], 2)):
        assert chat_format.first_fault(roles, template) == at
    tools = chat_format.Template(moves={"begin": {"user": "asked"}, "asked": {"assistant": "done", "call": "called"}, "called": {"result": "asked"}}, final=("done",))
    assert chat_format.first_fault(["user", "call", "result", "assistant"], tools) is None and chat_format.first_fault(["user", "result"], tools) == 1
    for wrong in ({"start": "[INST]"}, {"end": "</s>"}, {"end": "<|im_start|>"}, {"separator": ""}, {"separator": " "}):
        with pytest.raises(ValueError):
            chat_format.Template(**wrong)


def test_a_conversation_of_the_added_ones_number(spark, tmp_path):
    spark.createDataFrame([(-1, 0, "user", "x"), (3, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted((r.conv_id, r.n_turns, r.loss_chars) for r in chat_format.op8_chat_format(spark, str(tmp_path)).collect())
    assert got == [(-1, 1, 0), (-1, 2, len(chat_format.PROBE)), (3, 1, 0)]


# --- 10 ---
@pytest.mark.parametrize("most", [5000, 0])
def test_line_dedup(spark, empty, monkeypatch, most):
    """Cleaned in place, and by joins."""
    monkeypatch.setattr(line_dedup, "MOST_IN_PLACE", most)
    rng = random.Random(12)
    pool = ["Share this", " share THIS\t", "É", "é", "", "  ", "ok", "rare"]
    rows = [(i, "\n".join(rng.choices(pool, weights=[3, 2, 2, 1, 2, 1, 2, 0.1], k=rng.randrange(6)))) for i in range(40)] + EDGES
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\v\f\r"))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    table = docs(spark, rows)
    got = line_dedup.drop_common_lines(table)
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < 10]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == want
    assert set(got.columns) == set(table.columns) | {"n_dropped"} and line_dedup.drop_common_lines(empty).count() == 0


# --- pipeline ---
def test_pipeline_stages(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(90_001, "12 34 !!", "en", "s", 8), (90_002, None, None, None, None), (90_003, "", "en", "s", 0)], table.schema)
    rows, sizes = table.union(extra), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, DATA)
        if name != "sentencepiece":
            assert out.columns == table.columns
        rows = spark.createDataFrame(out.collect(), out.schema)
        sizes.append(rows.count())
    assert sizes[0] == sizes[1] == table.count() and sizes[2] < sizes[1] and sizes[3] < sizes[2] and sizes[4] == sizes[3]
    final = {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()}
    assert final == {r.doc_id for r in rows.collect()}


def test_similar_documents(spark, empty):
    rng = random.Random(11)
    rows = []
    for _ in range(60):
        base = make_text(rng, rng.choice((30, 120, 400))).split()
        for _ in range(rng.randint(1, 8)):
            copy = [rng.choice(WORDS) + "x" if rng.random() < rng.choice((0.0, 0.005, 0.02, 0.05)) else w for w in base]
            rows.append((len(rows) + 1, " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t")]

    def shingles(t):
        w = (t or "").split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    fps = {i: int.from_bytes(simhash.fingerprint((t or "").encode(), 5), "big") for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_sets = 0
    for i in root:
        for j in root:
            if i < j:
                close = (fps[i] ^ fps[j]).bit_count() <= 4
                alike = 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
                by_sets += alike and not close
                if close or alike:
                    a, b = sorted((find(i), find(j)))
                    root[b] = a
    assert by_sets > 30
    got = {r.doc_id: r.component_id for r in similar.similar_documents(docs(spark, rows)).collect()}
    assert got == {i: find(i) for i in root}
    kept = similar.one_of_each_similar(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in root}) and kept.columns == docs(spark, []).columns
    assert similar.similar_documents(empty).count() == 0 and similar.one_of_each_similar(empty).count() == 0
    assert similar.similar_documents(docs(spark, EDGES)).count() == len(EDGES)


def test_similar_texts_with_one_set_and_several_fingerprints(spark):
    """A line repeated 2, 3 and 40 times: one set of shingles, several fingerprints, a row and a component for each."""
    rng, rows, several, linked = random.Random(12), [], 0, 0
    for group in range(30):
        line = [f"{w}{group}" for w in rng.sample(WORDS, 9)]
        first = 10 * group + 1
        rows += [(first + k, " ".join(line * n)) for k, n in enumerate((2, 3, 40))]
        prints = [int.from_bytes(simhash.fingerprint(t.encode(), 5), "big") for _, t in rows[-3:]]
        several += len(set(prints)) > 1
        # A text with other words at the end, within four bits of some of the fingerprints and not similar by its set.
        for n in (2, 3, 40):
            for extra in range(3, 9):
                other = " ".join(line * n + [f"z{group}{x}" for x in range(extra)])
                bits = [(int.from_bytes(simhash.fingerprint(other.encode(), 5), "big") ^ p).bit_count() for p in prints]
                if min(bits) <= 4 < max(bits) and rows[-1][0] < first + 3:
                    rows.append((first + 3, other))
                    linked += 1
    assert several > 20 and linked > 3
    table = docs(spark, rows)
    got = sorted((r.doc_id, r.component_id) for r in similar.similar_documents(table).collect())
    assert got == [(i, i - (i - 1) % 10) for i, _ in rows]
    assert sorted(r.doc_id for r in similar.one_of_each_similar(table).collect()) == [10 * g + 1 for g in range(30)]


def test_leading_bits_never_hide_what_sets_share(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(similar, "_SMALL", 300)
    for n, m, both in ((0, 0, 0), (1, 1, 1), (40, 45, 38), (290, 310, 280), (500, 520, 400), (300, 301, 0)):
        shared = rng.integers(0, 2**64, both, np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**64, k - both, np.uint64)])) for k in (n, m))
        found = similar.most_common(similar.brief(a), len(a), similar.brief(b), len(b))
        assert both <= found <= both + 12


def test_similar_rows_without_keys_and_repeated_rows(spark):
    """Null keys beside others, and rows that repeat: a row for each, whatever text a key is the least of."""
    rng = random.Random(14)
    base = make_text(rng, 300).split()
    near = lambda: " ".join("x" if rng.random() < 0.01 else w for w in base)
    texts = [near() for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[2]), (7, make_text(rng, 80)), (5, texts[3]), (None, make_text(rng, 90)), (9, texts[4]), (9, texts[5])]
    got = Counter(map(tuple, similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == Counter({(None, 5): 2, (7, 5): 2, (7, 7): 1, (5, 5): 1, (None, None): 1, (9, 5): 2})


def test_similar_across_components(spark):
    """Every pair of similar sets in different components is listed, and none of the many that share a passage only."""
    rng, sets = random.Random(5), []
    for group in range(12):
        base = rng.sample(range(group * 1000, group * 1000 + 1000), rng.choice((1, 3, 9, 40)))
        for _ in range(6):
            kept = [x for x in base if rng.random() > rng.choice((0.0, 0.05, 0.15))] or base
            sets.append({*kept, *(rng.randrange(10**6, 10**9) for _ in range(rng.choice((0, 0, 1, 4))))})
    sets = [set(x) for x in {frozenset(s) for s in sets}]
    passage = range(10**10, 10**10 + 30)
    alone = len(sets)
    sets += [{*passage, *(rng.randrange(10**11, 10**12) for _ in range(10))} for _ in range(60)]
    held = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "s long, hashes array<long>")
    root = {i: i - i % 2 for i in range(len(sets))}
    known = spark.createDataFrame([(i, root[i], i, len(s)) for i, s in enumerate(sets)], "s long, root long, fp long, n long")
    got = {(r.u, r.v) for r in similar._across(similar._prefixes(held, known, 0.8), 0.8).collect()}
    pairs = {(i, j) for j in range(len(sets)) for i in range(j) if root[i] != root[j]}
    alike = {(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert alike and alike <= got <= pairs and not [p for p in got if p[1] >= alone]
