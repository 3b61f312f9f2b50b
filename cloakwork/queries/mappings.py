"""Queries of aliases, masks and the mapping table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakwork.functions import masks
from cloakwork.functions.fixed import BRANCHES, KEEP, LABELS, STEMS
from cloakwork.operators import mapping, queue, review
from cloakwork.queries import synth as S
from cloakwork.queries.synth import K, Registry, customers, txt

_R = Registry()


def alias_sql(index: str, suffix: str) -> str:
    return f"CASE WHEN {index} < 22 THEN concat(substr('{STEMS + BRANCHES}', CAST({index} AS INT) + 1, 1), {suffix}) ELSE concat(substr('{STEMS}', CAST(({index} - 22) % 10 AS INT) + 1, 1), {suffix}, CAST(CAST(floor(({index} - 22) / 10) AS BIGINT) + 2 AS STRING)) END"


_R.add("g1_stem", lambda s, d: customers(s, d, i=K).select(K, masks.alias_at(F.lit(""), F.col("i")).alias("stem")), f"SELECT {K}, {alias_sql(K, repr(''))} AS stem FROM customer")
_SUFFIX = f"CASE CAST({K} % 3 AS INT) WHEN 0 THEN '某' WHEN 1 THEN '公司' ELSE '地址' END"
_CAT = f"CASE CAST({K} % 3 AS INT) WHEN 0 THEN 'person' WHEN 1 THEN 'company' ELSE 'address' END"
_R.add("g2_build", lambda s, d: customers(s, d, c=_CAT).select(K, masks.alias_at(masks.alias_suffix(F.col("c")), F.col(K)).alias("alias")), f"SELECT {K}, {alias_sql(K, _SUFFIX)} AS alias FROM customer")
_KINDS = ("person", "custom", "company")
_KIND = f"CASE CAST({K} % 3 AS INT) WHEN 0 THEN 'person' WHEN 1 THEN 'custom' ELSE 'company' END"
_KIND_SUFFIX = f"CASE WHEN {K} % 3 < 2 THEN '某' ELSE '公司' END"


def _numbered(s, d, reserved=()):
    rows = customers(s, d, kind=_KIND).withColumn("suffix", masks.alias_suffix(F.col("kind")))
    rows = mapping.ranked(rows, [K], ["suffix"], "i")
    return rows.select(K, masks.alias_at(F.col("suffix"), mapping.free_index(F.col("suffix"), F.col("i"), list(reserved))).alias("alias"))


_NUM = f"SELECT {K}, {_KIND_SUFFIX} AS suffix, row_number() OVER (PARTITION BY {_KIND_SUFFIX} ORDER BY {K}) - 1 AS i FROM customer"
_R.add("g3_next_alias", _numbered, f"SELECT {K}, {alias_sql('i', 'suffix')} AS alias FROM ({_NUM})")
# 乙某 is number 1 and 甲某2 number 22 of their suffix: later ones move up by one or two.
_SHIFT = "CASE WHEN suffix = '某' THEN i + CASE WHEN i >= 1 THEN 1 ELSE 0 END + CASE WHEN i >= 21 THEN 1 ELSE 0 END ELSE i END"
_R.add("g4_reserve", lambda s, d: _numbered(s, d, ["乙某", "甲某2", "其他"]), f"SELECT {K}, {alias_sql('j', 'suffix')} AS alias FROM (SELECT {K}, suffix, {_SHIFT} AS j FROM ({_NUM}))")

_MASK_CASES = [
    ("phone", S.PHONE, f"concat(substr({S.PHONE}, 1, 3), '****', right({S.PHONE}, 4))"),
    ("id_number", S.id_number(), f"concat(substr({S.id_number()}, 1, 3), repeat('*', 11), right({S.id_number()}, 4))"),
    ("email", f"concat('u', {txt(K)}, '@x.cn')", "'u***@***'"),
    ("wechat", f"concat('wx', {txt(K)})", "'***'"),
    ("ethnicity", "'汉族'", "'某族'"),
    ("plate", f"concat('京A', lpad({txt(f'{K} % 100000')}, 5, '0'))", f"concat('京A****', right({txt(K)}, 1))"),
    ("birth_date", S.DATE, f"concat(substr({S.DATE}, 1, 4), '年**月**日')"),
    ("birth_date", f"concat('1985-', {txt(f'1 + {K} % 12')}, '-7')", "'1985-**-**'"),
    ("passport", "'E123'", "'E***'"),
    ("bank_card", S.card(), f"concat(substr({S.card()}, 1, 4), repeat('*', 8), right({S.card()}, 4))"),
]
_N = len(_MASK_CASES)


def _case(at: int) -> str:
    return f"CASE CAST({K} % {_N} AS INT) " + " ".join(f"WHEN {i} THEN " + (c[at] if at else f"'{c[0]}'") for i, c in enumerate(_MASK_CASES)) + " END"


_R.add("m1_mask", lambda s, d: customers(s, d, category=_case(0), value=_case(1)).select(K, masks.mask_value(F.col("value"), F.col("category")).alias("masked")), f"SELECT {K}, {_case(2)} AS masked FROM customer")

_CATEGORY = f"CASE CAST({K} % 4 AS INT) WHEN 0 THEN 'person' WHEN 1 THEN 'phone' WHEN 2 THEN 'company' ELSE 'address' END"
_ORIGINAL = f"CASE CAST({K} % 4 AS INT) WHEN 0 THEN {S.NAME} WHEN 1 THEN {S.PHONE} WHEN 2 THEN concat({S.COMPANY}, {txt(f'{K} % 30')}) ELSE concat({S.ADDRESS}, '幢') END"
_CONF = f"CAST(CASE WHEN {K} % 4 = 1 THEN 0.99 WHEN {K} % 4 = 0 THEN 0.85 ELSE 0.7 END AS DOUBLE)"
_FOUND = {
    "file": S.FILE, "doc_seq": f"CAST({K} % 10 AS INT)", "big": f"{K} % 10 = 3", "para_index": f"CAST({K} AS INT)", "start": f"CAST({K} % 7 AS INT)",
    "original": _ORIGINAL, "category": _CATEGORY, "source": f"CASE WHEN {K} % 4 = 1 THEN 'rule' ELSE 'lexicon' END",
    "confidence": _CONF, "status": f"CASE WHEN {K} % 8 < 2 THEN 'auto' ELSE 'pending' END",
}


def found(s, d):
    return customers(s, d, **_FOUND).drop(K)


FOUND_SQL = "found AS (SELECT " + ", ".join(f"{v} AS \"{k}\"" for k, v in _FOUND.items()) + f", CASE WHEN {K} % 10 = 3 THEN 1000000000000000 ELSE 0 END + CAST({K} % 10 AS BIGINT) * 100000000000000 + {K} * 10 + {K} % 7 AS pos FROM customer)"
FIRST_SQL = """
first AS (SELECT original, arg_min(category, pos) AS category, arg_min(source, pos) AS source, arg_min(confidence, pos) AS confidence, arg_min(status, pos) = 'pending' AS pending,
                 count(*) AS occurrences, array_to_string(list_sort(list(DISTINCT file)), ',') AS files, min(pos) AS pos FROM found GROUP BY original),
ids AS (SELECT *, row_number() OVER (ORDER BY pos) AS id, CASE category WHEN 'person' THEN '某' WHEN 'company' THEN '公司' WHEN 'address' THEN '地址' END AS suffix FROM first),
nums AS (SELECT *, row_number() OVER (PARTITION BY suffix ORDER BY id) - 1 AS i FROM ids)"""
TABLE_SQL = f"""{FOUND_SQL}, {FIRST_SQL},
mapping AS (SELECT id, original, category, CASE WHEN suffix IS NULL THEN concat(substr(original, 1, 3), '****', right(original, 4)) ELSE {alias_sql('i', 'suffix')} END AS alias,
                   occurrences, true AS enabled, source, confidence, pending, files FROM nums)"""


def table(s, d):
    return mapping.build_mapping(found(s, d))


def flat(df):
    return df.withColumn("files", F.array_join("files", ","))


_COLS = "id, original, category, alias, occurrences, enabled, source, confidence, pending, files"
_R.add("m2_add_findings", lambda s, d: flat(table(s, d)), f"WITH {TABLE_SQL} SELECT {_COLS} FROM mapping")


def _m3(s, d):
    out = mapping.edit(table(s, d), [("custom", " 自定义甲 ", None), ("custom", "自定义乙", "特别代称"), ("custom", "张伟", None)])
    return flat(out).select("original", "category", "alias", "occurrences", "enabled", "pending", "confidence", "files")


_R.add("m3_add_custom", _m3, f"""
WITH {TABLE_SQL}, n AS (SELECT count(*) AS i FROM mapping WHERE category = 'person')
SELECT original, category, alias, occurrences, true AS enabled, pending AND original <> '张伟' AS pending, confidence, files FROM mapping
UNION ALL SELECT '自定义甲', 'custom', {alias_sql('i', "'某'")}, 0, true, false, 1.0, NULL FROM n
UNION ALL SELECT '自定义乙', 'custom', '特别代称', 0, true, false, 1.0, NULL""")
_R.add("m4_set_enabled", lambda s, d: mapping.edit(table(s, d), [("disable", "张伟", None), ("disable", "无此项", None)]).select("id", "alias", "enabled"), f"WITH {TABLE_SQL} SELECT id, alias, original <> '张伟' AS enabled FROM mapping")
_R.add("m5_set_pending", lambda s, d: mapping.edit(table(s, d), [("disable", "张伟", None), ("accept", "张伟", None), ("defer", "李芳", None)]).select("id", "enabled", "pending"), f"WITH {TABLE_SQL} SELECT id, enabled, CASE original WHEN '张伟' THEN false WHEN '李芳' THEN true ELSE pending END AS pending FROM mapping")


def _m6(s, d):
    out = mapping.edit(table(s, d), [("remove", "张伟", None), ("custom", "新人", None)])
    return out.select("original", "alias")


# Persons and custom items share their aliases: the one that has come back is the first that is free.
_R.add("m6_remove", _m6, f"""
WITH {TABLE_SQL}, gone AS (SELECT alias FROM mapping WHERE original = '张伟'), n AS (SELECT count(*) AS i FROM mapping WHERE category = 'person')
SELECT original, alias FROM mapping WHERE original <> '张伟' UNION ALL SELECT '新人', (SELECT alias FROM gone) FROM n""")


def _g5(s, d):
    """Two that come back are given out again, first to their own category, each once; then come new numbers."""
    out = mapping.edit(table(s, d), [("remove", "李伟", None), ("remove", "张伟", None), ("custom", "新甲", None), ("custom", "新乙", None), ("custom", "新丙", None)])
    return out.filter(F.col("category").isin("person", "custom")).select("original", "alias")


_R.add("g5_release", _g5, f"""
WITH {TABLE_SQL}, p AS (SELECT * FROM mapping WHERE category = 'person'), gone AS (SELECT alias, row_number() OVER (ORDER BY id) AS r FROM p WHERE original IN ('张伟', '李伟')), n AS (SELECT count(*) AS i FROM p)
SELECT original, alias FROM p WHERE original NOT IN ('张伟', '李伟') UNION ALL SELECT CASE r WHEN 1 THEN '新甲' ELSE '新乙' END, alias FROM gone
UNION ALL SELECT '新丙', {alias_sql('i', "'某'")} FROM n""")
_R.add("m7_merge", lambda s, d: mapping.edit(table(s, d), [("merge", "李伟", "张伟"), ("merge", "李伟", "无此项")]).select("original", "alias", "pending"), f"""
WITH {TABLE_SQL}, t AS (SELECT alias AS ta, pending AS tp FROM mapping WHERE original = '张伟')
SELECT original, CASE WHEN original = '李伟' THEN ta ELSE alias END AS alias, CASE WHEN original = '李伟' THEN tp ELSE pending END AS pending FROM mapping, t""")


def _m8(s, d):
    rows = s.createDataFrame([(1, "张伟", "person", "甲某", 3, True, "lexicon", 0.85, False, ["a.docx", "b.docx"]), (2, "13812345678", "phone", "138****5678", 2, True, "rule", 0.99, False, ["a.docx", "b.docx", "c.docx"])], mapping.SCHEMA)
    return flat(mapping.edit(rows, [("split", "张伟", ["b.docx"]), ("split", "13812345678", ["c.docx", "a.docx"]), ("split", "13812345678", ["b.docx"]), ("split", "张伟", ["x.docx"]), ("split", "无此项", ["a.docx"])])).select("id", "original", "alias", "occurrences", "files")


_R.add("m8_split", _m8, """
SELECT CAST(id AS BIGINT) AS id, original, alias, CAST(n AS BIGINT) AS occurrences, files
FROM (VALUES (1, '张伟', '甲某', 3, 'a.docx'), (2, '13812345678', '138****5678', 2, 'b.docx'), (3, '张伟', '乙某', 0, 'b.docx'),
             (4, '13812345678', '138****5678', 0, 'a.docx,c.docx')) AS v(id, original, alias, n, files)""")
_R.add("m9_get", lambda s, d: table(s, d).filter(F.col("original") == "王芳").select("original", "category", "occurrences"), f"WITH {TABLE_SQL} SELECT original, category, occurrences FROM mapping WHERE original = '王芳'")
_R.add("m10_effective_pairs", lambda s, d: mapping.pairs_of(table(s, d), "f1.docx").select("place", "original", "alias"), f"WITH {TABLE_SQL} SELECT CAST(row_number() OVER (ORDER BY length(original) DESC, id) AS INT) AS place, original, alias FROM mapping WHERE NOT pending AND list_contains(string_split(files, ','), 'f1.docx')")
# After clearing, numbers and aliases begin anew.
_R.add("m11_clear", lambda s, d: mapping.edit(mapping.clear(table(s, d)), [("custom", "新人", None)]).select("id", "original", "alias"), "SELECT CAST(1 AS BIGINT) AS id, '新人' AS original, '甲某' AS alias")
_R.add("m12_pending", lambda s, d: table(s, d).filter("pending").select("id", "original"), f"WITH {TABLE_SQL} SELECT id, original FROM mapping WHERE pending")
_R.add("m13_ambiguous", lambda s, d: mapping.ambiguous_aliases(table(s, d)).select("alias", F.size("originals").cast("long").alias("n")), f"WITH {TABLE_SQL} SELECT alias, count(DISTINCT original) AS n FROM mapping WHERE NOT pending GROUP BY alias HAVING count(DISTINCT original) > 1")

_LABEL = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items()) + " END"
_R.add("b4_visible", lambda s, d: review.visible(table(s, d), "f2.docx", True, " 公司 ").select("id", "original"), f"WITH {TABLE_SQL} SELECT id, original FROM mapping WHERE list_contains(string_split(files, ','), 'f2.docx') AND pending AND (contains(original, '公司') OR contains(alias, '公司'))")
_R.add("b5_groups", lambda s, d: review.groups(table(s, d)), f"WITH {TABLE_SQL} SELECT CASE WHEN pending THEN '待确认' ELSE {_LABEL} END AS grp, count(*) AS n, min(id) AS first_id FROM mapping GROUP BY 1")
_R.add("b6_source_label", lambda s, d: table(s, d).select("id", review.source_label(F.col("files")).alias("label")), f"WITH {TABLE_SQL} SELECT id, CASE WHEN contains(files, ',') THEN concat(CAST(len(string_split(files, ',')) AS VARCHAR), '个文件') ELSE files END AS label FROM mapping")


def _b7(s, d):
    t = table(s, d)
    return review.accept_pending(review.ignore_pending(t, review.visible(t, "f1.docx"))).select("id", "enabled", "pending")


_R.add("b7_bulk", _b7, f"WITH {TABLE_SQL} SELECT id, true AS enabled, false AS pending FROM mapping WHERE NOT (pending AND list_contains(string_split(files, ','), 'f1.docx'))")
_R.add("b8_merge_candidates", lambda s, d: review.merge_candidates(table(s, d), "张伟").select("id", "original"), f"WITH {TABLE_SQL} SELECT id, original FROM mapping WHERE category = 'person' AND original <> '张伟'")


def _b9(s, d):
    docs = customers(s, d, name=S.FILE, doc_seq=f"CAST(10 - {K} % 10 AS INT)").select("name", "doc_seq").distinct()
    return review.first_file(table(s, d), docs)


_R.add("b9_first_file", _b9, f"WITH {TABLE_SQL} SELECT id, list_last(list_sort(string_split(files, ','))) AS file FROM mapping")

# --- the document queue ---
_STATUS = f"CASE CAST({K} % 6 AS INT) " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(queue.ICONS)) + " END"
_QUEUE = {"doc_seq": K, "name": f"concat('c', {txt(K)}, '.pdf')", "status": _STATUS, "pages": f"CAST({K} % 1000 AS INT)", "need_rescan": f"{K} % 5 = 0", "scanned": f"{K} % 7 = 0"}


def _queue(s, d):
    return customers(s, d, **_QUEUE).drop(K)


_QSQL = "q AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _QUEUE.items()) + " FROM customer)"
_R.add("b1_scan_order", lambda s, d: queue.scan_order(_queue(s, d)).select("doc_seq", "place"), f"WITH {_QSQL} SELECT doc_seq, row_number() OVER (ORDER BY pages > 500, doc_seq) - 1 AS place FROM q WHERE status IN ('待扫描', '扫描失败')")
_R.add("b2_mark_dirty", lambda s, d: queue.mark_dirty(_queue(s, d)).select("doc_seq", "status", "need_rescan"), f"WITH {_QSQL} SELECT doc_seq, CASE WHEN status IN ('已脱敏', '已导出') THEN '已扫描' ELSE status END AS status, need_rescan OR status IN ('已脱敏', '已导出') AS need_rescan FROM q")
_R.add("b10_labels", lambda s, d: _queue(s, d).select("doc_seq", queue.label(F.col("name"), F.col("status"), F.col("scanned"), queue.is_big(F.col("pages")), F.col("need_rescan")).alias("label")), f"WITH {_QSQL} SELECT doc_seq, concat(CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in queue.ICONS.items()) + " END, ' ', CASE WHEN scanned THEN '🖨 ' ELSE '' END, CASE WHEN pages > 500 THEN '⏱ ' ELSE '' END, name, '  [', status, CASE WHEN need_rescan THEN '（需重扫）' ELSE '' END, ']') AS label FROM q")


def _d13(s, d):
    rows = _queue(s, d).withColumn("export_error", F.when(F.col("doc_seq") % 4 == 0, F.lit("boom")))
    return queue.after_export(rows).select("doc_seq", "status", "need_rescan", "exported")


_R.add("d13_export", _d13, f"WITH {_QSQL}, x AS (SELECT *, status IN ('待扫描', '扫描中', '扫描失败') AS skip, doc_seq % 4 = 0 AS bad FROM q) SELECT doc_seq, CASE WHEN skip THEN status WHEN bad THEN '扫描失败' ELSE '已导出' END AS status, CASE WHEN skip OR bad THEN need_rescan ELSE false END AS need_rescan, NOT skip AND NOT bad AS exported FROM x")


def _d14(s, d):
    rows = customers(s, d, name=S.FILE, doc_seq=K).select("name", "doc_seq")
    return queue.unique_targets(rows, s.createDataFrame([("f1.docx",), ("f1_2.docx",), ("f2_1.docx",), ("other.pdf",)], "name string")).select("doc_seq", "target")


_R.add("d14_unique_target", _d14, f"""
WITH n AS (SELECT {K} AS doc_seq, {K} % 10 AS f, row_number() OVER (PARTITION BY {K} % 10 ORDER BY {K}) - 1 AS i FROM customer),
j AS (SELECT doc_seq, f, CASE WHEN f = 1 THEN CASE WHEN i = 0 THEN 1 ELSE i + 2 END WHEN f = 2 AND i >= 1 THEN i + 1 ELSE i END AS i FROM n)
SELECT doc_seq, concat('f', CAST(f AS VARCHAR), CASE WHEN i = 0 THEN '' ELSE concat('_', CAST(i AS VARCHAR)) END, '.docx') AS target FROM j""")

QUERIES, ORACLES = _R.queries, _R.oracles
