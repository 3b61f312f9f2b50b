"""Queries of sources and of replacement, and the flagship over the documents table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from cloakwork.functions.fixed import ID_CHECKS, ID_WEIGHTS, KEEP, USCC_ALPHABET
from cloakwork.functions.lineage import cut, fresh, remove, shared_dir
from cloakwork.functions.matching import find_all
from cloakwork.operators import arbitrate, envelope, mapping, queue, redact, review
from cloakwork.operators.mapping import build_mapping, pair_rows
from cloakwork.plans import batch, scan
from cloakwork.queries import mappings as M
from cloakwork.queries import synth as S
from cloakwork.queries.synth import K, Registry, customers, load, txt
from cloakwork.sources import docx, files, lexicons, sink

_R = Registry()

# --- the whole scan of the documents table: all rules and the lexicon ---
_DOUBLED = "list_sum(list_transform(generate_series(1, length(v)), lambda i: CASE WHEN (length(v) - i) % 2 = 1 THEN CASE WHEN CAST(v[i] AS INT) > 4 THEN CAST(v[i] AS INT) * 2 - 9 ELSE CAST(v[i] AS INT) * 2 END ELSE CAST(v[i] AS INT) END))"
_ID_SUM = " + ".join(f"CAST(v[{i + 1}] AS INT) * {w}" for i, w in enumerate(ID_WEIGHTS))
_USCC_SUM = " + ".join(f"(instr('{USCC_ALPHABET}', v[{i + 1}]) - 1) * {3**i % 31}" for i in range(17))
_DATE = r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
#: category -> (runs of which a hit is a whole one, or the pattern itself; group; condition on the value v).
_PATTERNS = [
    ("id_number", "[0-9Xx]+", 0, rf"regexp_full_match(v, '[0-9]{{6}}(19|20)[0-9]{{2}}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{{3}}[0-9Xx]') AND substr('{ID_CHECKS}', 1 + CASE WHEN regexp_full_match(v, '[0-9]{{17}}.') THEN ({_ID_SUM}) % 11 ELSE 0 END, 1) = upper(v[18])"),
    ("phone", "[0-9]+", 0, "regexp_full_match(v, '1[3-9][0-9]{9}')"),
    ("bank_card", "[0-9]+", 0, f"length(v) BETWEEN 13 AND 19 AND {_DOUBLED} % 10 = 0"),
    ("passport", "[A-Za-z0-9]+", 0, "regexp_full_match(v, '[EGeg][0-9]{8}')"),
    ("permit_hk_macau", "[A-Za-z0-9]+", 0, "regexp_full_match(v, '[HMhm][0-9]{8,10}')"),
    ("email", r"(?:^|[^A-Za-z0-9_.%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})(?:$|[^A-Za-z0-9_.])", 1, "true"),
    ("uscc", "[0-9A-Z]+", 0, f"regexp_full_match(v, '[{USCC_ALPHABET}]{{2}}[0-9]{{6}}[{USCC_ALPHABET}]{{10}}') AND (31 - ({_USCC_SUM}) % 31) % 31 = instr('{USCC_ALPHABET}', v[18]) - 1"),
    ("plate", "[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-HJ-NP-Z][A-HJ-NP-Z0-9]{4,5}[A-HJ-NP-Z0-9挂学警港澳]", 0, "true"),
    ("wechat", r"(?:微信号?|WeChat)[:：\s]*([a-zA-Z][a-zA-Z0-9_-]{5,19})", 1, "true"),
    ("social_security", r"(?:社保(?:号|编号|卡号)?|社会保险号)[:：\s]*(\d{9,18})", 1, "true"),
    ("housing_fund", r"公积金(?:账号|账户|编号)?[:：\s]*(\d{9,18})", 1, "true"),
    ("securities_account", r"(?:证券账户|资金账号|股东账户)[:：\s]*([A-Za-z0-9]{6,20})", 1, "true"),
    ("birth_date", rf"(?:出生(?:日期|年月)?|生于)[:：\s]*({_DATE})|({_DATE})出生", 1, "v <> ''"),
]
_EACH = " UNION ALL ".join(f"SELECT doc_id, para, v, '{c}' AS category FROM (SELECT doc_id, para, unnest(regexp_extract_all(line, '{rx}', {g})) AS v FROM lines) WHERE {test}" for c, rx, g, test in _PATTERNS)
# The texts hold no ideograph, so the lexicon layer finds nothing. Where hits begin at one place the first category stays.
_HITS = f"""
kept AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS para FROM kept),
every_hit AS ({_EACH}),
hits AS (SELECT * FROM every_hit h WHERE category NOT IN ('bank_card', 'uscc', 'phone') OR NOT EXISTS (
  SELECT 1 FROM every_hit o WHERE o.doc_id = h.doc_id AND o.para = h.para AND o.category IN ('id_number', 'uscc') AND o.category < h.category AND starts_with(o.v, h.v)))"""
_SHOWN = " ".join(f"WHEN category = '{c}' THEN CASE WHEN length(v) <= {a + b} THEN concat(substr(v, 1, 1), repeat('*', length(v) - 1)) ELSE concat(substr(v, 1, {a}), repeat('*', length(v) - {a + b}), right(v, {b})) END" for c, (a, b) in KEEP.items())
_MASKED = f"CASE WHEN category = 'email' THEN concat(substr(v, 1, 1), '***@***') WHEN category = 'wechat' THEN '***' {_SHOWN} END"
_MAPPED = f"""
firsts AS (SELECT v, arg_min(category, doc_id * 1000000 + para) AS category, count(*) AS occurrences, list(DISTINCT doc_id) AS docs FROM hits GROUP BY v),
mapping AS (SELECT v AS original, category, {_MASKED} AS alias, occurrences, docs FROM firsts)"""


def _found(spark, sf_dir):
    return arbitrate.findings(scan.paragraphs_of(load(spark, sf_dir, "documents")))


_R.add("scan_documents", lambda s, d: _found(s, d).select("file", "para_index", "original", "category", "status"), f"WITH {_HITS} SELECT concat('d', CAST(doc_id AS VARCHAR)) AS file, CAST(para AS INT) AS para_index, v AS original, category, 'auto' AS status FROM hits")
_R.add("mapping_documents", lambda s, d: build_mapping(_found(s, d)).select("original", "category", "alias", "occurrences", F.size("files").cast("long").alias("n_files")), f"WITH {_HITS}, {_MAPPED} SELECT original, category, alias, occurrences, CAST(len(docs) AS BIGINT) AS n_files FROM mapping")


def flagship(spark, sf_dir):
    """Every line of the documents that is not blank, scanned by all rules and the lexicon, and redacted by the mapping."""
    return scan.deidentify(scan.paragraphs_of(load(spark, sf_dir, "documents"))).select("file", "para_index", "n_replaced", "redacted")


_R.add("flagship_lines", flagship, f"""
WITH {_HITS}, {_MAPPED},
pairs AS (SELECT doc_id, list(struct_pack(o := original, a := alias) ORDER BY length(original) DESC, original) AS p FROM (SELECT unnest(docs) AS doc_id, original, alias FROM mapping) GROUP BY doc_id),
met AS (SELECT l.doc_id, para, line, list_filter(p, lambda x: contains(line, x.o)) AS p FROM lines l LEFT JOIN pairs USING (doc_id)),
done AS (SELECT doc_id, para, CASE WHEN len(p) > 0 THEN list_reduce(list_prepend(struct_pack(o := line, a := '0'), p),
  lambda acc, x: struct_pack(o := replace(acc.o, x.o, x.a), a := CAST(CAST(acc.a AS INT) + (length(acc.o) - length(replace(acc.o, x.o, ''))) // length(x.o) AS VARCHAR)))
  ELSE struct_pack(o := line, a := '0') END AS r FROM met)
SELECT concat('d', CAST(doc_id AS VARCHAR)) AS file, CAST(para AS INT) AS para_index, CAST(r.a AS INT) AS n_replaced, r.o AS redacted FROM done""")

# --- sources ---
def _docx(spark, sf_dir):
    """Files made from customers, then read, rewritten and read again."""

    @F.pandas_udf("binary")
    def build(runs: pd.Series) -> pd.Series:
        return runs.map(lambda r: docx.build([list(r), ["第二段"], []]))

    rows = customers(spark, sf_dir, path=f"concat('/in/c', {txt(K)}, '.docx')", runs=f"array('原告', {S.SURNAME}, concat({S.GIVEN}, '，手机'), {S.PHONE})", name=S.NAME, phone=S.PHONE)
    pairs = F.array(F.struct(F.col("phone").alias("original"), F.lit("***").alias("alias")), F.struct(F.col("name").alias("original"), F.lit("甲某").alias("alias")))
    return rows.select("path", build("runs").alias("content"), pairs.alias("pairs"))


_R.add("s4_docx_read", lambda s, d: docx.read(_docx(s, d)).select("path", "para_index", F.array_join("runs", "|").alias("runs"), "text"), f"""
SELECT concat('/in/c', {txt(K)}, '.docx') AS path, 0 AS para_index, concat('原告|', {S.SURNAME}, '|', {S.GIVEN}, '，手机|', {S.PHONE}) AS runs, concat('原告', {S.NAME}, '，手机', {S.PHONE}) AS text FROM customer
UNION ALL SELECT concat('/in/c', {txt(K)}, '.docx'), 1, '第二段', '第二段' FROM customer""")


def _docx_written(s, d):
    made = _docx(s, d)
    done = docx.write(made, made)
    return docx.read(done).join(done.select(F.col("path").alias("_p"), "n_replaced"), F.col("path") == F.col("_p")).select("path", "para_index", F.array_join("runs", "|").alias("runs"), "n_replaced")


_R.add("d12_docx_write", _docx_written, f"""
SELECT concat('/in/c', {txt(K)}, '.docx') AS path, 0 AS para_index, '原告|甲某|，手机|***' AS runs, CAST(2 AS BIGINT) AS n_replaced FROM customer
UNION ALL SELECT concat('/in/c', {txt(K)}, '.docx'), 1, '第二段', 2 FROM customer""")


def _in_folder(make, read):
    """A query that writes files into a folder of its own (make: spark, sf_dir -> target, content), reads them and tidies up."""

    def query(s, d):
        folder = f"{shared_dir(s)}/{fresh('files')}"
        sink.write_files(make(s, d), folder)
        out = cut(read(s, d, folder))
        remove(s, folder)
        return out

    return query


_NATION = "concat('r', CAST(n_regionkey AS STRING), '/deep/n', CAST(n_nationkey AS STRING), '.txt')"


def _s1(s, d, folder):
    """A folder, a folder below it, a single file and two paths that don't exist; a path given twice counts once."""
    found = files.expand(s, [f"{folder}/r0", f"{folder}/r1", f"{folder}/r1", f"{folder}/r2/deep/n8.txt", f"{folder}/none", f"{folder}/r3/none.txt"])
    return found.select(F.regexp_extract("path", "r[0-9]/deep/n[0-9]+[.]txt$", 0).alias("name"), "length", F.col("content").cast("string").alias("text"))


_R.add("s1_expand", _in_folder(lambda s, d: load(s, d, "nation").selectExpr(f"{_NATION} AS target", "CAST(n_name AS BINARY) AS content"), _s1),
       f"SELECT {_NATION} AS name, CAST(strlen(n_name) AS BIGINT) AS length, n_name AS text FROM nation WHERE n_regionkey IN (0, 1) OR n_regionkey = 2 AND n_nationkey = 8")
_R.add("s12_read_whole", _in_folder(lambda s, d: customers(s, d, target=f"concat('c', {txt(K)}, '.md')", content=f"CAST(concat('# ', {S.NAME}, chr(10), {S.PHONE}, chr(10)) AS BINARY)"), lambda s, d, f: files.read_whole(s, f"{f}/*.md").select("name", "text")),
       f"SELECT concat('c', {txt(K)}, '.md') AS name, concat('# ', {S.NAME}, chr(10), {S.PHONE}, chr(10)) AS text FROM customer")
_GOLD_LINE = f"concat('{{\"text\": \"', {S.NAME}, '\", \"label\": {{\"name\": {{\"', {S.NAME}, '\": [[0, 1]]}}}}}}')"


def _gold_file(s, d):
    """One file of JSON lines in order of the key, with a line that is no JSON at the end."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(K, "line"))), lambda x: x["line"]), "\n")
    return customers(s, d, line=_GOLD_LINE).agg(F.concat(lines, F.lit("\nno json\n")).cast("binary").alias("content")).withColumn("target", F.lit("gold.jsonl"))


_R.add("s9_load_gold", _in_folder(_gold_file, lambda s, d, f: lexicons.load_gold(s, f"{f}/gold.jsonl", 40).select("sample_id", "text", F.to_json("label").alias("label"))),
       f"SELECT CAST({K} AS INT) AS sample_id, {S.NAME} AS text, concat('{{\"name\":{{\"', {S.NAME}, '\":[[0,1]]}}}}') AS label FROM customer WHERE {K} < 40")
_PATH = f"concat('/in/d', {txt(f'{K} % 3')}, '/c', {txt(f'{K} % 50')}, CASE CAST({K} % 4 AS INT) WHEN 0 THEN '.docx' WHEN 1 THEN '.PDF' WHEN 2 THEN '.txt' ELSE '.pdf' END)"


def _s2(s, d):
    rows = customers(s, d, path=_PATH, readable=f"{K} % 4 <> 3 OR {K} % 50 <> 7").select("path", "readable")
    return queue.intake(rows, s.createDataFrame([("/in/d0/c0.docx",)], "path string")).select("path", "accepted", "reason")


_R.add("s2_intake", _s2, f"""
WITH p AS (SELECT DISTINCT {_PATH} AS path, {K} % 50 AS c FROM customer)
SELECT path, NOT (path LIKE '%.txt' OR (path LIKE '%.pdf' AND c = 7)) AS accepted, CASE WHEN path LIKE '%.txt' THEN 'extension' WHEN path LIKE '%.pdf' AND c = 7 THEN 'unreadable' END AS reason
FROM p WHERE path <> '/in/d0/c0.docx'""")
_R.add("s3_route", lambda s, d: files.route(customers(s, d, path=_PATH, scanned=f"{K} % 5 = 0").drop(K).distinct()).groupBy("reader").agg(F.count("*").alias("n")), f"WITH p AS (SELECT DISTINCT {_PATH} AS path, {K} % 5 = 0 AS scanned FROM customer) SELECT CASE WHEN path LIKE '%.docx' THEN 'docx' WHEN path LIKE '%.txt' THEN 'none' WHEN scanned THEN 'pdf_ocr' ELSE 'pdf_text' END AS reader, count(*) AS n FROM p GROUP BY 1")
_R.add("s5_probe", lambda s, d: files.probe_pages(customers(s, d, file=S.FILE, page_no=f"CAST({K} AS INT)", n_words=f"CASE WHEN {K} % 10 < 5 THEN 0 ELSE CAST({K} % 3 AS INT) END")), f"SELECT {S.FILE} AS file, bool_or(CASE WHEN {K} % 10 < 5 THEN 0 ELSE {K} % 3 END > 0) AS textual, max({K}) AS pages FROM customer GROUP BY 1")


def _spread(s, rows):
    """Rows dealt over tasks by their key, as files would be, not one task's."""
    return rows.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), K)


_PAGES = f"concat('第一行', chr(10), '  ', chr(10), {S.NAME}, chr(12), {S.PHONE})"


def _pdf_pages(content: bytes) -> list[dict]:
    """Stands for a PDF library: pages end at form feeds; a file that begins with an x is broken."""
    if content.startswith(b"x"):
        raise ValueError("broken")
    return [{"page_no": i, "text": p} for i, p in enumerate(content.decode().split("\f"))]


def _s6(s, d):
    """Files with a text layer, files whose pages are blank (scanned), broken ones."""
    content = f"CASE CAST({K} % 3 AS INT) WHEN 0 THEN CAST({_PAGES} AS BINARY) WHEN 1 THEN CAST(concat(' ', chr(12)) AS BINARY) ELSE CAST('x' AS BINARY) END"
    rows = files.text_pages(_spread(s, customers(s, d, path=f"concat('c', {txt(K)})", content=content)), _pdf_pages)
    return rows.withColumn("para_index", F.coalesce("para_index", F.lit(-1)))


_R.add("s6_text_pages", _s6, f"""
SELECT concat('c', {txt(K)}) AS path, i AS para_index, CASE i WHEN 0 THEN '第一行' WHEN 1 THEN {S.NAME} ELSE {S.PHONE} END AS text, CAST(NULL AS VARCHAR) AS error FROM customer, (VALUES (0), (1), (2)) AS v(i) WHERE {K} % 3 = 0
UNION ALL SELECT concat('c', {txt(K)}), -1, NULL, CASE WHEN {K} % 3 = 1 THEN 'no text layer' ELSE 'ValueError: broken' END FROM customer WHERE {K} % 3 > 0""")


def _s7(s, d):
    """Nine pages or so a file, so that the last chunk is a short one; page 2 has a blank line, which goes."""
    render = lambda content: iter(range(int(content.decode())))
    recognise = lambda page: [([(10, 20), (110, 22), (108, 40), (12, 38)], t, 0.9) for t in ([" "] if page == 2 else []) + [f"p{page}"]]
    rows = files.ocr_lines(_spread(s, customers(s, d, path=f"concat('c', {txt(K)})", content=f"CAST({txt(f'7 + {K} % 4')} AS BINARY)")), render, recognise, 2.0)
    return rows.select("path", "page_no", "line_no", "x0", "y0", "x1", "y1", "text", "error")


_R.add("s7_ocr_lines", _s7, f"""
SELECT concat('c', {txt(K)}) AS path, CAST(p AS INT) AS page_no, 0 AS line_no, 5.0::DOUBLE AS x0, 10.0::DOUBLE AS y0, 55.0::DOUBLE AS x1, 20.0::DOUBLE AS y1, concat('p', CAST(p AS VARCHAR)) AS text, CAST(NULL AS VARCHAR) AS error
FROM customer, generate_series(0, 9) AS g(p) WHERE p < 7 + {K} % 4""")
_R.add("s6_lines", lambda s, d: files.lines_of(load(s, d, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")), "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) SELECT doc_id, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM l WHERE trim(x) <> '' GROUP BY 1")
_R.add("s8_lexicon", lambda s, d: lexicons.terms(customers(s, d, value=f"CASE CAST({K} % 4 AS INT) WHEN 0 THEN concat('  ', {S.NAME}, ' ') WHEN 1 THEN '# note' WHEN 2 THEN '   ' ELSE {S.GIVEN} END")).select(K, "term"), f"SELECT {K}, CASE WHEN {K} % 4 = 0 THEN {S.NAME} ELSE {S.GIVEN} END AS term FROM customer WHERE {K} % 4 IN (0, 3)")
# --- batches of files ---
def _build_docx(s, d):
    """Contracts as docx with a header; every fifth file is broken, every seventh a PDF, and one of nine has many pages."""

    @F.pandas_udf("binary")
    def build(bodies: pd.Series, heads: pd.Series) -> pd.Series:
        return pd.Series([docx.build([list(b), []], {"header1": [[h]]}) for b, h in zip(bodies, heads)])

    rows = customers(s, d, doc_seq=K, name=S.NAME, phone=S.PHONE, path=f"concat('/in/c', {txt(K)}, CASE WHEN {K} % 7 = 0 THEN '.pdf' ELSE '.docx' END)")
    body = F.array(F.lit("出借人（甲方）："), F.concat("name", F.lit("，男，手机")), F.col("phone"), F.lit("。"))
    made = F.when(F.col(K) % 5 == 0, F.lit("broken").cast("binary")).when(F.col(K) % 7 == 0, F.concat(F.lit("手机"), "phone").cast("binary")).otherwise(build(body, F.concat(F.lit("微信号：wx_"), F.col(K).cast("string"), F.lit("_a"))))
    status = F.when(F.col(K) % 11 == 0, F.lit(queue.SCANNED)).when(F.col(K) % 3 == 0, F.lit(queue.FAILED)).otherwise(F.lit(queue.PENDING))
    return cut(_spread(s, rows).select("path", "doc_seq", status.alias("status"), F.when(F.col(K) % 9 == 0, 501).alias("pages"), made.alias("content")))


_B_SQL = f"q AS (SELECT {K} AS k, {S.NAME} AS name, {S.PHONE} AS phone, concat('c', {txt(K)}, CASE WHEN {K} % 7 = 0 THEN '.pdf' ELSE '.docx' END) AS file, {K} % 11 <> 0 AS waits, {K} % 5 = 0 OR {K} % 7 = 0 AS bad FROM customer)"


def _scanned(s, d):
    return batch.scan_batch(_build_docx(s, d))


_R.add("b1_scan_batch", lambda s, d: _scanned(s, d).queue.select(queue.base_name(F.col("path")).alias("file"), "status", F.col("error").isNotNull().alias("has_error")), f"""
WITH {_B_SQL} SELECT file, CASE WHEN waits AND bad THEN '扫描失败' ELSE '已扫描' END AS status, waits AND bad AS has_error FROM q""")
# Numbers go by first appearance: files with very many pages last, a header before the body only if its part comes first.
_R.add("b1_scan_mapping", lambda s, d: _scanned(s, d).mapping.filter(F.col("category") == "person").select("original", "alias", "pending", "occurrences"), f"""
WITH {_B_SQL}, g AS (SELECT name, min(CASE WHEN k % 9 = 0 THEN 1000000000 ELSE 0 END + k) AS pos, count(*) AS occurrences FROM q WHERE waits AND NOT bad GROUP BY name),
n AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS i FROM g)
SELECT name AS original, {M.alias_sql('i', "'某'")} AS alias, true AS pending, occurrences FROM n""")


def _exported(s, d):
    """Scanned, all pending items accepted, exported into a folder that has one of the names, and read again."""
    folder = f"{shared_dir(s)}/{fresh('export')}"
    sink.put(folder, "c1.docx", b"here before")
    done = batch.scan_batch(_build_docx(s, d))
    pdf = lambda content, pairs: (content.replace(b"\xe6\x89\x8b", b""), 0, ["a warning"])
    after = batch.export_batch(done.queue, mapping.edit(review.accept_pending(done.mapping), [("custom", "男", "某人")]), folder, "secret-1", writers={"pdf_text": pdf})
    n_items = envelope.items_of_files(s, folder, "mapping.json", "secret-1").count()
    written = sink.read_files(after.filter(F.endswith("target", F.lit(".docx"))).select("target"), folder)
    texts = docx.read(written.select(F.col("target").alias("path"), "content")).groupBy(F.col("path").alias("_n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_index", "text"))), lambda x: x["text"]), "|").alias("text"))
    out = after.join(texts, F.col("target") == F.col("_n"), "left").withColumn("n_items", F.lit(n_items).cast("long"))
    out = cut(out.select(queue.base_name(F.col("path")).alias("file"), "status", "target", F.when(F.endswith("target", F.lit(".docx")), F.col("text")).alias("text"), F.array_join("warnings", ",").alias("warnings"), "n_items"))
    remove(s, folder)
    return out


# Of the scanned files those that are broken fail on export; PDF files are copied by the given writer.
_R.add("d13_export_files", _exported, f"""
WITH {_B_SQL}, ok AS (SELECT * FROM q WHERE waits AND NOT bad), x AS (SELECT *, NOT waits OR NOT bad AS scanned, k % 5 = 0 AS broken FROM q),
g AS (SELECT name, row_number() OVER (ORDER BY min(CASE WHEN k % 9 = 0 THEN 1000000000 ELSE 0 END + k)) - 1 AS i FROM ok GROUP BY name),
a AS (SELECT name, {M.alias_sql('i', "'某'")} AS alias FROM g), f AS (SELECT DISTINCT name, file FROM ok),
n AS (SELECT (SELECT count(*) FROM g) + 2 * (SELECT count(*) FROM ok) + 1 AS n)
SELECT x.file, CASE WHEN NOT scanned THEN '扫描失败' WHEN broken AND k % 7 <> 0 THEN '扫描失败' ELSE '已导出' END AS status,
       CASE WHEN scanned AND (NOT broken OR k % 7 = 0) THEN CASE WHEN x.file = 'c1.docx' THEN 'c1_1.docx' ELSE x.file END END AS target,
       CASE WHEN scanned AND NOT broken AND k % 7 <> 0 THEN concat('出借人（甲方）：', coalesce(CASE WHEN waits THEN alias END, x.name), '，某人，手机', CASE WHEN waits THEN concat(substr(phone, 1, 3), '****', right(phone, 4)) ELSE phone END, '。|微信号：', CASE WHEN waits THEN '***' ELSE concat('wx_', CAST(k AS VARCHAR), '_a') END) END AS text,
       CASE WHEN scanned AND k % 7 = 0 THEN 'a warning' WHEN scanned AND k % 5 = 0 THEN '' WHEN scanned THEN '' END AS warnings, n.n AS n_items
FROM n, x LEFT JOIN a ON a.name = x.name""")


def _cached(s, d):
    """Read twice through a folder, the second time with one file changed: the others are not read again."""
    folder, seen = f"{shared_dir(s)}/{fresh('cache')}", s.sparkContext.accumulator(0)
    rows = customers(s, d, path=f"concat('c', {txt(K)})", content=f"CAST({S.NAME} AS BINARY)").withColumn("modified", F.lit("2024-01-01 00:00:00").cast("timestamp"))

    def read(found):
        seen.add(found.count())
        return found.select("path", F.col("content").cast("string").alias("text"))

    files.read_cached(rows, folder, read)
    newer = rows.withColumns({"modified": F.when(F.col(K) == 1, F.lit("2024-02-01 00:00:00").cast("timestamp")).otherwise(F.col("modified")), "content": F.when(F.col(K) == 1, F.lit("新").cast("binary")).otherwise(F.col("content"))})
    out = cut(files.read_cached(newer, folder, read).withColumn("n_read", F.lit(seen.value).cast("long")))
    remove(s, folder)
    return out


_R.add("b3_paragraph_cache", _cached, f"SELECT concat('c', {txt(K)}) AS path, CASE WHEN {K} = 1 THEN '新' ELSE {S.NAME} END AS text, (SELECT count(*) + 1 FROM customer) AS n_read FROM customer")


def _b12(s, d):
    """Settings: judicial names are masked where the user says so."""
    rows = customers(s, d, file=S.FILE, doc_seq=K, para_index="0", text=f"concat('审判长：', {S.NAME}, '。原告：')").withColumn("big", F.lit(False))
    done, _ = scan.scan(rows, settings=scan.ScanSettings(mask_judicial=True))
    return done.select(K, "original", "judicial")


_R.add("b12_settings", _b12, f"SELECT {K}, {S.NAME} AS original, true AS judicial FROM customer")
_R.add("s_find_all", lambda s, d: load(s, d, "documents").select("doc_id", F.size(find_all(F.col("text"), "[0-9]+")).cast("long").alias("n")), "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS n FROM documents")

# --- replacement ---
_TEXT = f"concat('甲：', {S.NAME}, '丰与', {S.NAME}, '，', {S.GIVEN}, '。')"


def _para(s, d):
    """The longer original takes its place first, wherever it stands."""
    pairs = F.array(*[F.struct(F.col(o).alias("original"), F.lit(a).alias("alias")) for o, a in (("long", "乙某"), ("name", "甲某"), ("none", "丙某"))])
    return customers(s, d, text=_TEXT, long=f"concat({S.NAME}, '丰')", name=S.NAME, none="'无'").withColumn("pairs", pairs)


def _d1(s, d):
    rows = _para(s, d).withColumn("spans", redact.replacement_spans(F.col("text"), F.col("pairs")))
    return rows.select(K, redact.apply_spans(F.col("text"), F.col("spans")).alias("redacted"), F.size("spans").alias("n"))


_R.add("d1_find_spans", _d1, f"SELECT {K}, concat('甲：乙某与甲某，', {S.GIVEN}, '。') AS redacted, 2 AS n FROM customer")


def _d2(s, d):
    rows = customers(s, d, runs=f"array('原告', {S.SURNAME}, concat({S.GIVEN}, '，男，手机'), {S.PHONE}, '。')", name=S.NAME, phone=S.PHONE)
    rows = rows.withColumn("pairs", F.array(F.struct(F.col("phone").alias("original"), F.lit("***").alias("alias")), F.struct(F.col("name").alias("original"), F.lit("甲某").alias("alias"))))
    runs, n = redact.redact_runs(F.col("runs"), F.col("pairs"))
    return rows.withColumns({"out": F.array_join(runs, "|"), "n": n}).select(K, F.col("out").alias("runs"), "n")


_R.add("d2_runs", _d2, f"SELECT {K}, '原告|甲某|，男，手机|***|。' AS runs, 2 AS n FROM customer")


def _d3(s, d):
    lines = customers(s, d, file=S.FILE, para_index=f"CAST({K} AS INT)", text=f"concat('签字：', {M._ORIGINAL}, '；')")
    return redact.redact(lines, pair_rows(M.table(s, d))).groupBy("file").agg(F.sum("n_replaced").alias("n"))


# A line holds one original, and at most shorter ones that begin where it does: one replacement, if any of them takes part.
_R.add("d3_count", _d3, f"""
WITH {M.TABLE_SQL}, pairs AS (SELECT unnest(string_split(files, ',')) AS file, original FROM mapping WHERE NOT pending),
lines AS (SELECT {K}, {S.FILE} AS file, concat('签字：', {M._ORIGINAL}, '；') AS text FROM customer),
met AS (SELECT {K}, l.file, max(CASE WHEN contains(text, original) THEN 1 ELSE 0 END) AS n FROM lines l LEFT JOIN pairs p ON l.file = p.file GROUP BY ALL)
SELECT file, CAST(sum(n) AS BIGINT) AS n FROM met GROUP BY file""")


def _d15(s, d):
    rows = _para(s, d).withColumn("text", F.concat(F.lit("<a&b>"), F.col("text")))
    return rows.select(K, redact.preview(F.col("text"), F.col("pairs"), True).alias("masked"), redact.preview(F.col("text"), F.col("pairs"), False).alias("plain"))


_R.add("d15_preview", _d15, f"""
SELECT {K}, concat('&lt;a&amp;b&gt;甲：<mark>乙某</mark>与<mark>甲某</mark>，', {S.GIVEN}, '。') AS masked,
       concat('&lt;a&amp;b&gt;甲：<mark>', {S.NAME}, '丰</mark>与<mark>', {S.NAME}, '</mark>，', {S.GIVEN}, '。') AS plain FROM customer""")
_R.add("d16_locate", lambda s, d: customers(s, d, text=_TEXT, name=S.NAME).select(K, redact.locate(F.col("text"), F.lit("无"), F.col("name")).alias("at")), f"SELECT {K}, 3 AS at FROM customer")

QUERIES, ORACLES = _R.queries, _R.oracles
