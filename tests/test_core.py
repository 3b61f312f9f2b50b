"""Operators against plain Python on random input, and literal cases."""

import io
import json
import random
import re
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cloakwork.functions import checksums, fixed, masks, matching
from cloakwork.operators import arbitrate, envelope, lexicon, mapping, ner, queue, redact, restore, search
from cloakwork.plans import batch
from cloakwork.sources import docx, files, lexicons, sink
from conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["r1_id_number", "r6_email", "r13_birth_lead", "f3_valid_uscc", "l2_prompted", "l7_company", "a1_merge", "a2_arbitrate", "a5_scan_paragraph", "m1_mask", "m2_add_findings", "d1_find_spans", "d2_runs", "d8_page_fragments", "d14_unique_target", "t5_restore_text", "e4_scores", "scan_documents", "flagship_lines", "r3_full_width", "p1_many_passes", "l2_rare_surnames", "l7_company_names", "d13_export_files", "b1_scan_batch", "s7_ocr_lines", "m3_add_custom", "g5_release", "d3_count"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, got[cols].values.tolist())) == sorted(map(str, want[cols].values.tolist()))
    assert len(got)


def test_find_all_equals_finditer(spark):
    random.seed(1)
    texts = ["".join(random.choices("原告：张三138 12345678９a@b.cn，。京A\ufdd0", k=random.randrange(60))) for _ in range(400)] + ["", "微信号:　abc12345x", "\ufdd013812345678\ufdd0"]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    for r in fixed.RULES.values():
        got = {x.i: [(h.start, h.end, h.text) for h in x.h] for x in df.select("i", matching.find_all(F.col("t"), r.value, r.before, r.after, r.need).alias("h")).collect()}
        assert got[-1] == []
        for i, t in enumerate(texts):
            found = [(*m.span(1), m.group(1)) for m in re.finditer(f"{r.before}({r.value}){r.after}", t)]
            assert got[i] == found and (not found or re.search(r.need, t)), (r.category, t)


def test_word_lists():
    sizes = {"SURNAMES": 489, "ETHNICITIES": 55, "STOPWORDS": 16, "PROMPTS": 58, "TITLES": 12, "REGIONS": 190, "NAME_BAD_SUFFIX": 15, "LEADING_BAD": 33, "NER_LABELS": 32}
    for name, n in sizes.items():
        words = getattr(fixed, name)
        assert len(words) == len(set(words)) == n and all(words), name
    assert "姓 名" in fixed.PROMPTS and "姓" not in fixed.PROMPTS and "名" not in fixed.PROMPTS
    assert {"卫", "华", "云", "欧阳", "褚师"} <= set(fixed.SURNAMES) and len(fixed.LABELS) == 19


def test_prompts_with_a_space_do_not_fall_apart(spark):
    texts = ["请在合同上签名张三", "名流置业有限公司", "姓 名：卫青，", "13８12345678"]
    found = arbitrate.findings(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert sorted((r.original, r.category) for r in found) == [("13８12345678", "phone"), ("卫青", "person"), ("名流置业有限公司", "company")]


def test_overlapping_occurrences(spark):
    rows = [("aaaa", "aa"), ("x😀😀a", "😀"), ("ab\\Ec\\Q", "\\E"), ("", "a"), ("abc", ""), ("a.b", "."), ("aXa", "a")]
    df = spark.createDataFrame(rows, "t string, w string")
    got = [r.o for r in df.select(matching.occurrences(F.col("t"), F.col("w")).alias("o")).collect()]
    assert got == [[i for i in range(len(t)) if w and t.startswith(w, i)] for t, w in rows]


def test_search_by_broadcast_and_by_shuffle(spark):
    """Both ways, with a file that holds most rows, files without strings, global strings, nulls and repeated rows."""
    random.seed(5)
    rows = [(random.choice("aaaaaab"), "".join(random.choices("xyz张", k=random.randrange(12)))) for _ in range(300)] + [(None, "xyz"), ("a", None), ("c", ""), ("c", "xyx"), ("c", "xyx")]
    words = [(f, i, "".join(random.choices("xyz张", k=random.randrange(1, 4))), f"<{i}>") for i, f in enumerate(["a", "a", "a", "b", None, None, "d"] * 3)] + [("a", 99, "", "?"), (None, 98, None, "?")]
    texts = spark.createDataFrame([(f, t, "mine", {"m": 1}) for f, t in rows], "file string, text string, found string, extra map<string,int>")
    strings = spark.createDataFrame(words, "file string, id long, string string, value string")
    want = []
    for f, t in rows:
        best = {}
        for g, i, w, v in words:
            if w and (g is None or g == f) and (g, w) not in best:
                best[g, w] = (i, v)
        want.append((f, t, sorted((-len(w), i, k, k + len(w), v) for (_, w), (i, v) in best.items() for k in range(len(t or "")) if (t or "").startswith(w, k))))
    for most in (search.MOST, 64):
        out = search.search(texts, strings, "_places", most=most)
        assert out.columns == [*texts.columns, "_places"]
        assert sorted(((r.file, r.text, sorted(map(tuple, r["_places"]))) for r in out.collect()), key=str) == sorted(want, key=str)
    assert search.search(texts.limit(0), strings, "_p", most=64).count() == 0
    assert all(r["_p"] == [] for r in search.search(texts, strings.limit(0), "_p").collect())


def test_redact_two_ways(spark):
    rows = [("a", "张三丰和张三"), ("b", "张三"), (None, "张三 x"), ("a", None)]
    pairs = spark.createDataFrame([("a", 2, "张三", "甲某"), ("a", 1, "张三丰", "乙某"), (None, 3, "x", "*")], "file string, id long, original string, alias string")
    texts = spark.createDataFrame([(*r, 7) for r in rows], "file string, text string, n_replaced int")
    for most in (search.MOST, 64):
        got = {(r.file, r.text): (r.redacted, r.n_replaced) for r in redact.redact(texts, pairs, most=most).collect()}
        assert got == {rows[0]: ("乙某和甲某", 2), rows[1]: ("张三", 0), rows[2]: ("张三 *", 1), rows[3]: (None, 0)}


def test_findings_edges(spark):
    """Nulls, blanks, repeated rows, empty tables and columns named as those of the result or inside."""
    rows = [(1, "电话13812345678。"), (1, "电话13812345678。"), (2, None), (3, "　 "), (4, "汉族" * 3000)]
    df = spark.createDataFrame([(i, t, "old", 5, "h", 1) for i, t in rows], "k int, text string, category string, start int, _hits string, ord int")
    found = arbitrate.findings(df)
    assert found.columns == ["k", "_hits", "ord", *arbitrate.FOUND]
    got = sorted((r.k, r.category, r.start) for r in found.collect())
    assert got[:2] == [(1, "phone", 2)] * 2 and got[2:] == [(4, "ethnicity", 2 * i) for i in range(3000)]
    assert arbitrate.findings(df.limit(0)).count() == 0
    paras = spark.createDataFrame([("f", 0, None, i, t) for i, t in rows], "file string, doc_seq int, big boolean, para_index int, text string")
    table = mapping.build_mapping(arbitrate.findings(paras))
    assert {(r.original, r.occurrences, r.id) for r in table.collect()} == {("13812345678", 2, 1), ("汉族", 3000, 2)}
    nothing = mapping.build_mapping(arbitrate.findings(paras.limit(0)))
    assert nothing.count() == 0 and mapping.edit(nothing, []).count() == 0 and redact.redact(paras, mapping.pair_rows(nothing)).count() == len(rows)


def test_free_numbers(spark):
    def table(names):
        return spark.createDataFrame([(i + 1, f"o{i}", "person", a, 1, True, "s", 0.9, False, ["f"]) for i, a in enumerate(names)], mapping.SCHEMA)

    used = [mapping.alias_text("某", i) for i in range(3000) if i not in (5, 1500, 1501)] + ["乙公司", "随便", "甲某02", "张某"]
    assert mapping.free_numbers(table(used), "某", 5) == [5, 1500, 1501, 3000, 3001]
    assert mapping.free_numbers(table(used), "公司", 2) == [0, 2] and mapping.free_numbers(table([]), "某", 2) == [0, 1]
    for i in (0, 9, 10, 21, 22, 31, 32, 1000):
        assert mapping.index_of_alias(mapping.alias_text("单位", i), "单位") == i
    edits = [("custom", f"n{i}", None) for i in range(3)] + [("split", "o1", ["zz"])]
    assert [r.alias for r in mapping.edit(table(used), edits).filter("category = 'custom'").orderBy("id").collect()] == ["己某", mapping.alias_text("某", 1500), mapping.alias_text("某", 1501)]


def test_mapping_too_large_for_one_row(spark):
    table = spark.createDataFrame([(i, f"o{i}", "phone", "*", 1, True, "rule", 0.9, False, ["f"]) for i in range(1, 6)], mapping.SCHEMA)
    with pytest.raises(ValueError):
        envelope.mapping_json(table, most=4)
    lines = envelope.mapping_lines(table, batch_id="b", created_at="t")
    assert lines.count() == 6 and envelope.items_of_lines(lines).count() == 5
    with pytest.raises(ValueError, match="version"):
        envelope.items_of_lines(lines.withColumn("json", F.replace("json", F.lit('"1.0"'), F.lit('"2"'))))


def test_sealed_mapping_of_any_size(spark, tmp_path, monkeypatch):
    """An export whose mapping and manifest are beyond one file: several sealed files, opened together or not at all."""
    monkeypatch.setattr(envelope, "PART_ITEMS", 4)
    monkeypatch.setattr(envelope, "MOST_ITEMS", 4)
    monkeypatch.setattr(envelope.mapping_parts, "__defaults__", (None, None, 4))
    items = [(2 * i, f"原{i}", "phone", "*", i, True, "rule", 0.9, False, ["f"]) for i in range(1, 11)]
    table = spark.createDataFrame(items[::-1], mapping.SCHEMA)
    docs = spark.createDataFrame([(f"/in/p{i}.pdf", i, queue.FAILED, b"x%d" % i) for i in range(14)], "path string, doc_seq int, status string, content binary")
    folder = str(tmp_path / "out")
    assert batch.export_batch(docs, table, folder, "secret-1").count() == 14
    names = ["mapping.json", "mapping_1.json", "mapping_2.json", "mapping_3.json"]
    assert sorted(p.name for p in (tmp_path / "out").glob("*.json")) == names
    parts = [envelope.load_mapping(envelope.unseal(spark, json.loads((tmp_path / "out" / n).read_text()), "secret-1")) for n in names]
    assert [[m["id"] for m in p["mappings"]] for p in parts] == [[2, 4, 6, 8], [10, 12, 14, 16], [18, 20], []]
    assert [d["file"] for p in parts for d in p["doc_manifest"]] == [f"p{i}.pdf" for i in range(14)] and len({p["batch_id"] for p in parts}) == 1
    got = envelope.items_of_files(spark, folder, "mapping.json", "secret-1").orderBy("id").collect()
    assert [(r.id, r.original, r.occurrences, r.confidence) for r in got] == [(m[0], m[1], m[4], m[7]) for m in items]
    with pytest.raises(envelope.WrongPassword):
        envelope.items_of_files(spark, folder, "mapping.json", "secret-2")
    kept = (tmp_path / "out" / names[1]).read_text()
    (tmp_path / "out" / names[1]).write_text((tmp_path / "out" / names[2]).read_text())  # one part twice, one missing
    with pytest.raises(envelope.WrongPassword):
        envelope.items_of_files(spark, folder, "mapping.json", "secret-1")
    (tmp_path / "out" / names[1]).write_text(kept.replace('"data":"', '"data":"AAAA'))
    with pytest.raises(envelope.WrongPassword):
        envelope.items_of_files(spark, folder, "mapping.json", "secret-1")
    batch.export_batch(docs.limit(0), table.limit(0), folder, "secret-1")  # an empty batch has one file
    assert envelope.items_of_files(spark, folder, "mapping.json", "secret-1").count() == 0


def test_unrestored_in_blocks(spark):
    docs = spark.createDataFrame([("a", "甲某与乙某"), ("b", None), ("b", "丙某")], "name string, text string")
    items = spark.createDataFrame([(1, "甲某", "张三", 2, True), (2, "乙某", "李四", 1, None), (3, "丙某", "王五", 3, False), (4, None, "x", 0, True)], "id long, alias string, original string, occurrences long, enabled boolean")
    for most in (1, search.MOST):
        got = sorted(tuple(r) for r in restore.unrestored(docs, items, most=most).collect())
        assert got == sorted([("b", "甲某", "张三", 2), ("b", "乙某", "李四", 1)] * 2)
    assert restore.unrestored(docs, items.limit(0)).count() == 0


def greedy_spans(text, pairs):
    taken, out = [False] * len(text), []
    for old, new in pairs:
        for i in range(len(text) - len(old) + 1):
            if text[i : i + len(old)] == old and not any(taken[i : i + len(old)]):
                taken[i : i + len(old)] = [True] * len(old)
                out.append((i, i + len(old), new))
    return sorted(out)


def test_replacement_equals_occupancy(spark):
    random.seed(2)
    rows = []
    for i in range(200):
        words = {"".join(random.choices("ab张", k=random.randrange(1, 4))) for _ in range(4)}
        pairs = [(w, f"<{k}>") for k, w in enumerate(sorted(words, key=lambda w: (-len(w), w)))]
        rows.append((i, "".join(random.choices("ab张c", k=20)), pairs))
    df = spark.createDataFrame(rows, "i int, t string, p array<struct<original:string,alias:string>>").withColumn("s", matching.replacement_spans(F.col("t"), F.col("p")))
    for r in df.select("i", "t", "p", "s", matching.apply_spans(F.col("t"), F.col("s")).alias("out")).collect():
        want = greedy_spans(r.t, [tuple(p) for p in r.p])
        assert [tuple(s) for s in r.s] == want
        text = r.t
        for a, b, new in reversed(want):
            text = text[:a] + new + text[b:]
        assert r.out == text
        assert docx.spans_of(r.t, [tuple(p) for p in r.p]) == want


def test_merge_and_arbitrate_random(spark):
    random.seed(3)
    text = "深" * 100
    rows = []
    for i in range(150):
        hits = []
        for k in range(random.randrange(1, 7)):
            a = random.randrange(40)
            hits.append((a, a + random.randrange(1, 35), "", random.choice(["person", "org", "address", "phone", "id_number"]), 0.8, random.choice(["rule", "lexicon", "ner"]), False, k))
        rows.append((i, text, hits))
    df = spark.createDataFrame(rows, f"i int, t string, h array<{matching.HIT}>")
    df = df.withColumn("m", arbitrate.merge_fragments(F.col("t"), F.col("h"))).withColumn("a", arbitrate.arbitrate(F.col("h")))
    for r in df.collect():
        top, merged = None, []
        for h in sorted((h for h in r.h if h.category in fixed.ENTITIES), key=lambda h: (h.start, h.start - h.end, h.ord)):
            h = [h.start, h.end, h.category]
            if top and h[0] <= top[1] and max(h[1], top[1]) - top[0] <= 60:
                if h[1] > top[1]:
                    old, new = top[1] - top[0], h[1] - h[0]
                    if new > old or (new == old and fixed.MERGE_RANK[h[2]] < fixed.MERGE_RANK[top[2]]):
                        top[2] = h[2]
                    top[1] = h[1]
            else:
                top = h
                merged.append(top)
        got = [[h.start, h.end, h.category] for h in r.m]
        assert got == [[h.start, h.end, h.category] for h in r.h if h.category not in fixed.ENTITIES] + merged
        key = lambda h: (h.start, fixed.LAYER_RANK[h.source], fixed.CATEGORY_RANK.get(h.category, 50), h.start - h.end, h.ord)
        free = []
        for h in sorted(r.h, key=key):
            if all(h.end <= g.start or h.start >= g.end for g in free):
                free.append(h)
        assert [h.ord for h in r.a] == [h.ord for h in free]


def test_prefix_passes(spark):
    row = spark.createDataFrame([("原告被告人被告人被圳",)], "t string").select(matching.strip_prefixes(F.col("t"), lexicon.Lexicon().prefixes()).alias("v")).first()
    assert row.v == "人被告人被圳"


def test_checksums_reject_and_accept(spark):
    rows = [("110105194912310021", "id"), ("110105194912310022", "id"), ("6222021001112345", "luhn"), ("4111111111111111", "luhn"), ("91350100M000100Y43", "uscc"), ("abc", "id")]
    got = {}
    for r in spark.createDataFrame(rows, "v string, k string").select("v", *[f(F.col("v")).alias(k) for k, f in checksums.VALIDATORS.items()]).collect():
        got[r.v] = r
    weights = fixed.ID_WEIGHTS
    check = lambda s: fixed.ID_CHECKS[sum(int(d) * w for d, w in zip(s, weights)) % 11] == s[-1]
    for v in ("110105194912310021", "110105194912310022"):
        assert got[v].id == check(v)
    assert got["4111111111111111"].luhn and not got["abc"].id
    assert got["91350100M000100Y43"].uscc


def test_aliases_by_hand():
    a = mapping.Aliases()
    names = [a.give("person") for _ in range(23)]
    assert names[0] == "甲某" and names[10] == "子某" and names[21] == "亥某" and names[22] == "甲某2"
    a.release("person", "乙某")
    assert a.give("person") == "乙某" and "乙某" in a.used
    assert mapping.index_of_alias("甲某2", "某") == 22 and mapping.index_of_alias("子某2", "某") is None


def test_mask_strict(spark):
    df = spark.createDataFrame([("1985-3/7", "birth_date")], "v string, c string")
    row = df.select(masks.mask_value(F.col("v"), F.col("c")).alias("a"), masks.mask_value(F.col("v"), F.col("c"), True).alias("b")).first()
    assert row.a == "1985-3/7" and row.b == "1985-**-**"


def test_contract_end_to_end(spark):
    text = "出借人（甲方）：张三，男，汉族，手机号13812345678。\n借款人（乙方）：李四，住北京市海淀区中关村大街27号。\n审判长：王五\n张三与李四签订合同。"
    lines = [("a.docx", 0, False, i, t) for i, t in enumerate(text.split("\n"))]
    paras = spark.createDataFrame(lines, "file string, doc_seq int, big boolean, para_index int, text string")
    found = arbitrate.findings(paras)
    assert {(r.original, r.category) for r in found.collect()} >= {("张三", "person"), ("李四", "person"), ("13812345678", "phone"), ("汉族", "ethnicity")}
    assert "王五" not in {r.original for r in found.collect()}
    table = mapping.edit(mapping.build_mapping(found), [("accept", "张三", None), ("accept", "李四", None)])
    out = {r.para_index: r.redacted for r in redact.redact(paras, mapping.pair_rows(table)).collect()}
    assert out[3] == "甲某与乙某签订合同。" and "138****5678" in out[0] and "某族" in out[0]


def test_envelope(spark):
    sealed = envelope.seal(spark, '{"a": "张三"}', "secret")
    assert envelope.unseal(spark, sealed, "secret") == '{"a": "张三"}'
    with pytest.raises(envelope.WrongPassword):
        envelope.unseal(spark, sealed, "other!")
    with pytest.raises(ValueError):
        envelope.seal(spark, "x", "")


def make_docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join("<w:p>" + "".join(f"<w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r>" for t in runs) + "</w:p>" for runs in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx_read_and_write(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(make_docx([["原告张", "三", "，男，手机13812345678。"], [], ["张三丰"]]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    found = files.expand(spark, [str(tmp_path), str(tmp_path / "missing")])
    rows = {(r.path.rsplit("/", 1)[1], r.para_index): r for r in docx.read(found).collect()}
    assert rows["a.docx", 0].runs == ["原告张", "三", "，男，手机13812345678。"] and rows["bad.docx", 0].error
    pairs = [("张三丰", "乙某"), ("张三", "甲某"), ("13812345678", "138****5678")]
    path = next(r.path for r in found.collect() if r.path.endswith("a.docx"))
    table = spark.createDataFrame([(path, pairs)], "path string, pairs array<struct<original:string,alias:string>>")
    out = {r.path.rsplit("/", 1)[1]: r for r in docx.write(found, table).collect()}
    assert out["a.docx"].n_replaced == 3 and out["bad.docx"].error
    assert docx.paragraphs(bytes(out["a.docx"].content)) == [["原告甲某", "", "，男，手机138****5678。"], [], ["乙某"]]
    back, n = docx.replace(bytes(out["a.docx"].content), [("甲某", "张三"), ("乙某", "张三丰"), ("138****5678", "13812345678")])
    assert n == 3 and "".join(docx.paragraphs(back)[0]) == "原告张三，男，手机13812345678。"


def test_docx_tables_text_boxes_and_other_parts(spark):
    """Paragraphs in table cells and text boxes, header, footer, footnotes and comments; styles are no text."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('原告：张三，')}<w:tbl><w:tr><w:tc>{p('内13812345678')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    box = f"<w:p><w:r><w:t>外</w:t></w:r><w:r><w:pict><w:txbxContent>{p('盒中张三')}</w:txbxContent></w:pict></w:r></w:p>"
    parts = {"document.main": ("document", f"<w:document xmlns:w='{w}'><w:body>{table}{box}</w:body></w:document>")}
    for kind, tag in (("header", "hdr"), ("footer", "ftr"), ("footnotes", "footnotes"), ("endnotes", "endnotes"), ("comments", "comments"), ("styles", "styles")):
        parts[kind] = (f"{kind}1" if kind in ("header", "footer") else kind, f"<w:{tag} xmlns:w='{w}'>{p(kind + '张三')}</w:{tag}>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        kinds = "".join(f'<Override PartName="/word/{n}.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.{k}+xml"/>' for k, (n, _) in parts.items())
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">{kinds}</Types>')
        for n, body in parts.values():
            z.writestr(f"word/{n}.xml", body)
    texts = ["".join(r) for r in docx.paragraphs(out.getvalue())]
    assert texts == ["原告：张三，", "内13812345678", "外盒中张三盒中张三", "盒中张三", "header张三", "footer张三", "footnotes张三", "endnotes张三", "comments张三"]
    new, n = docx.replace(out.getvalue(), [("13812345678", "138****5678"), ("张三", "甲某")])
    after = "|".join("".join(r) for r in docx.paragraphs(new))
    assert "张三" not in after and "138****5678" in after and after.count("甲某") == 9 and "styles" not in after and n == 9


def test_ocr_lines_in_chunks(spark):
    held = []

    def render(content):
        for i in range(int(content)):
            yield i

    found = files.ocr_lines(spark.createDataFrame([("a", b"19"), ("b", b"x"), ("c", b"0")], "path string, content binary"), render, lambda i: [([(0, 0), (2, 0), (2, 4), (0, 4)], f"p{i}", 0.5), ([(0, 0)], " ", 1.0)], 2.0).collect()
    assert [(r.page_no, r.line_no, r.text, r.x1, r.y1) for r in found if r.path == "a"] == [(i, 0, f"p{i}", 1.0, 2.0) for i in range(19)]
    assert [r.error[:10] for r in found if r.path == "b"] == ["ValueError"] and not [r for r in found if r.path == "c"] and not held


def test_text_pages_reads_each_file_once(spark, tmp_path):
    """Many files are read once each and handed on together, without a shuffle; lines are those of lines_of."""
    odd = "a\r\nb\x0bc\u2028 \u3000\x1dd\x85e"
    made = {"odd": [(1, "last"), (0, odd), (None, "first")], "blank": [(0, " \n"), (1, None)], "none": [], **{f"p{i}": [(0, str(i))] for i in range(500)}}
    log = tmp_path / "log"

    def provider(content):
        with open(log, "a") as f:
            f.write(content.decode() + "\n")
        if content == b"bad":
            raise ValueError("broken")
        return [{"page_no": n, "text": t} for n, t in made[content.decode()]]

    rows = spark.createDataFrame([(k, k.encode()) for k in [*made, "bad"]], "path string, content binary").coalesce(1)
    found = files.text_pages(rows, provider)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.collect()
    assert sorted(log.read_text().split()) == sorted([*made, "bad"])
    assert [(r.para_index, r.text, r.error) for r in got if r.path == "odd"] == list(zip(range(7), ["first", "a", "b", "c", "d", "e", "last"], [None] * 7))
    assert [r.text for r in files.lines_of(spark.createDataFrame([(odd,)], "text string")).collect()] == ["a", "b", "c", "d", "e"]
    assert {r.path: (r.para_index, r.text, r.error) for r in got if r.error} == {"blank": (None, None, "no text layer"), "none": (None, None, "no text layer"), "bad": (None, None, "ValueError: broken")}
    assert {r.path: r.text for r in got if r.path[1:].isdigit()} == {f"p{i}": str(i) for i in range(500)}


def test_provider_rows_of_many_files_go_together(spark, monkeypatch):
    """Three thousand short files make few tables, and no row is lost where one is handed on."""
    monkeypatch.setattr(files, "_ROWS", 7)
    caught = {}

    class Frame:
        def select(self, *names):
            return self

        def mapInPandas(self, f, schema):  # the function alone, in this process
            caught["f"] = f

    files.ocr_lines(Frame(), lambda c: iter(range(int(c))), lambda i: [([(0, 0), (2, 4)], f"p{i}", 0.5)], 2.0)
    sizes = [str(i % 3).encode() for i in range(3000)] + [b"x", None, b"40"]
    built = list(caught["f"](iter([pd.DataFrame({"path": [f"f{i}" for i in range(len(sizes))], "content": sizes})])))
    assert len(built) < 3043 / 7 + 2 and max(map(len, built)) <= 7
    every = pd.concat(built)
    assert len(every) == 3000 + 2 + 40 and every["error"].notna().sum() == 2
    assert every["page_no"][every["path"] == "f3002"].tolist() == list(range(40))


def test_batch_goes_on_after_failures(spark, tmp_path):
    """A broken file does not stop the scan; a name that is taken gets a number; sources stay as they are."""
    for name, text in (("a.docx", "出借人张三，手机号13812345678。"), ("b.docx", "借款人李四。")):
        (tmp_path / name).write_bytes(docx.build([[text]]))
    (tmp_path / "bad.docx").write_text("损坏内容", encoding="utf-8")
    found = files.expand(spark, [str(tmp_path)])
    waiting = found.select("path", "content", F.when(F.endswith("path", F.lit("a.docx")), 0).otherwise(F.length("path")).cast("int").alias("doc_seq"), F.lit(queue.PENDING).alias("status"))
    done = batch.scan_batch(waiting)
    states = {r.path.rsplit("/", 1)[1]: r for r in done.queue.collect()}
    assert states["bad.docx"].status == queue.FAILED and states["bad.docx"].error and states["a.docx"].status == states["b.docx"].status == queue.SCANNED
    items = {r.original: r for r in done.mapping.collect()}
    assert not items["13812345678"].pending and items["张三"].pending
    table = mapping.edit(done.mapping, [("accept", "张三", None)])
    out = tmp_path / "out"
    out.mkdir()
    (out / "a.docx").write_bytes(b"here before")
    with pytest.raises(ValueError):
        batch.export_batch(done.queue, table, str(out), "")
    after = {r.path.rsplit("/", 1)[1]: r for r in batch.export_batch(done.queue, table, str(out), "test-pw").collect()}
    assert after["a.docx"].status == queue.EXPORTED and after["a.docx"].target == "a_1.docx" and after["bad.docx"].status == queue.FAILED and after["bad.docx"].target is None
    text = "".join(docx.paragraphs((out / "a_1.docx").read_bytes())[0])
    assert text == "出借人甲某，手机号138****5678。" and (out / "a.docx").read_bytes() == b"here before"
    assert "张三" in "".join(docx.paragraphs((tmp_path / "a.docx").read_bytes())[0])
    opened = envelope.load_mapping(envelope.unseal(spark, json.loads((out / "mapping.json").read_text()), "test-pw"))
    assert {m["original"]: m["alias"] for m in opened["mappings"]}["张三"] == "甲某" and len(opened["doc_manifest"]) == 3
    dirty = {r.path.rsplit("/", 1)[1]: r for r in queue.mark_dirty(batch.export_batch(done.queue, table, str(tmp_path / "new"), "test-pw")).collect()}
    assert dirty["a.docx"].status == queue.SCANNED and dirty["a.docx"].need_rescan and not dirty["bad.docx"].need_rescan
    assert batch.scan_batch(waiting.limit(0)).mapping.count() == 0


def test_sink_refuses_names_outside(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", b"x"), ("../c.txt", b"y"), (None, b"z"), ("d.txt", None)], "target string, content binary")
    got = {r.target: r.error for r in sink.write_files(rows, str(tmp_path / "o")).collect()}
    assert got.pop("a/b.txt") is None and all(got.values()) and (tmp_path / "o/a/b.txt").read_bytes() == b"x"
    assert sorted(x.name for x in tmp_path.rglob("*")) == ["a", "b.txt", "o"]


def tiny_onnx(rows):
    """An ONNX model whose logits of a token are the row of its id: one Gather, written by hand."""
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    num = lambda k, n: varint(k << 3) + varint(n)
    sub = lambda k, b: varint(k << 3 | 2) + varint(len(b)) + b
    info = lambda name, kind, *dims: sub(1, name) + sub(2, sub(1, num(1, kind) + sub(2, b"".join(sub(1, sub(2, d)) for d in dims))))
    table = num(1, len(rows)) + num(1, len(rows[0])) + num(2, 1) + sub(8, b"w") + sub(9, np.array(rows, "<f4").tobytes())
    node = sub(1, b"w") + sub(1, b"input_ids") + sub(2, b"logits") + sub(4, b"Gather")
    mask = sub(1, b"attention_mask") + sub(2, b"same") + sub(4, b"Identity")
    graph = sub(1, node) + sub(1, mask) + sub(2, b"g") + sub(5, table) + sub(11, info(b"input_ids", 7, b"b", b"n")) + sub(11, info(b"attention_mask", 7, b"b", b"n")) + sub(12, info(b"logits", 1, b"b", b"n", b"c")) + sub(12, info(b"same", 7, b"b", b"n"))
    return num(1, 8) + sub(7, graph) + sub(8, sub(1, b"") + num(2, 13))


def test_onnx_provider(spark, tmp_path):
    """A model that tags by the token alone: 张 begins a name, 三 goes on with it, 京 is an address by itself."""
    pytest.importorskip("onnxruntime")
    words = "[PAD] [UNK] [CLS] [SEP] 张 三 京 在".split()
    tags = {"张": "B-name", "三": "I-name", "京": "S-address"}
    (tmp_path / "vocab.txt").write_text("\n".join(words), encoding="utf-8")
    (tmp_path / "ner.onnx").write_bytes(tiny_onnx([[float(label == tags.get(w, "O")) for label in fixed.NER_LABELS] for w in words]))
    provider = ner.onnx_provider(str(tmp_path))
    assert provider("张三在京") == [{"start": 0, "end": 2, "category": "person", "confidence": 0.8}, {"start": 3, "end": 4, "category": "address", "confidence": 0.7}]
    assert provider("张" + "在" * 520 + "京") == [{"start": 0, "end": 1, "category": "person", "confidence": 0.8}]
    rows = spark.createDataFrame([(0, "在张三", "x"), (1, " ", "x"), (2, None, "x")], "i int, text string, ner_hits string")
    found = arbitrate.findings(rows, provider=provider).collect()
    assert [(r.i, r.original, r.source, r.status, r.ner_hits) for r in found] == [(0, "张三", "ner", "pending", "x")]


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# note\n 张某某 \n\n李某某\n", encoding="utf-8")
    assert lexicons.load_terms(spark, str(tmp_path / "names.txt")) == ["张某某", "李某某"]
    assert lexicons.load_terms(spark, str(tmp_path / "none.txt")) == []
    (tmp_path / "gold.jsonl").write_text('{"text": "张三", "label": {"name": {"张三": [[0, 1]]}}}\nnot json\n', encoding="utf-8")
    assert lexicons.load_gold(spark, str(tmp_path / "gold.jsonl")).count() == 2


def test_ner_pieces_and_tags(spark):
    vocabulary = ner.read_vocabulary("[UNK]\n[CLS]\r\n[SEP]\nab\n##c\n张\n")
    assert vocabulary["[CLS]"] == 1
    tokens = ner.word_pieces("张abcz 张", vocabulary)
    assert tokens == ["张", "ab", "##c", "[UNK]", " ", "张"]
    assert ner.token_spans(tokens) == [(0, 1), (1, 3), (3, 4), (4, 5), (5, 6), (6, 7)]
    random.seed(4)
    rows = [(i, [random.choice(fixed.NER_LABELS) for _ in range(12)]) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, t array<string>").withColumn("a", F.sequence(F.lit(0), F.lit(11))).withColumn("b", F.sequence(F.lit(1), F.lit(12)))
    for r in df.select("i", "t", ner.decode_tags(F.col("t"), F.col("a"), F.col("b")).alias("h")).collect():
        assert [h.asDict() for h in r.h] == ner.spans_of(r.t, list(zip(range(12), range(1, 13))))
    with pytest.raises(FileNotFoundError):
        ner.onnx_provider("/nowhere")


def test_findings_run_on_a_stream(spark, tmp_path):
    from cloakwork.streaming import stream_findings

    spark.createDataFrame([(0, "电话13812345678。"), (1, None)], "para_index int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("para_index int, text string").parquet(str(tmp_path / "in"))
    q = stream_findings(stream).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.original for r in spark.sql("SELECT original FROM found").collect()] == ["13812345678"]


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
