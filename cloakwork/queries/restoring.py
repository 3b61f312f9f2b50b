"""Queries of the mapping file and of restoring."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cloakwork.operators import envelope, restore
from cloakwork.queries import mappings as M
from cloakwork.queries import synth as S
from cloakwork.queries.synth import K, Registry, customers, load, txt

_R = Registry()

_R.add("x0_sha256", lambda s, d: load(s, d, "documents").select("doc_id", envelope.sha256_of(F.col("text").cast("binary")).alias("sha")), "SELECT doc_id, sha256(text) AS sha FROM documents")


def _x1(s, d):
    rows = envelope.mapping_json(M.table(s, d), [("f1.docx", "00")], "b1", "2024-01-01T00:00:00+00:00")
    schema = f"struct<version:string,batch_id:string,doc_manifest:array<struct<file:string,sha256:string>>,mappings:array<struct<{', '.join(f.replace(' ', ':') for f in envelope.ITEM.split(', '))}>>>"
    rows = rows.select(F.from_json("json", schema.replace(", ", ",")).alias("j")).select("j.version", "j.batch_id", F.col("j.doc_manifest")[0]["file"].alias("file"), F.explode("j.mappings").alias("m"))
    return rows.select("version", "batch_id", "file", "m.id", "m.original", "m.alias", "m.occurrences", "m.enabled")


_R.add("x1_mapping_json", _x1, f"WITH {M.TABLE_SQL} SELECT '1.0' AS version, 'b1' AS batch_id, 'f1.docx' AS file, id, original, alias, occurrences, enabled FROM mapping")


_R.add("x1_mapping_lines", lambda s, d: envelope.items_of_lines(envelope.mapping_lines(M.table(s, d), [("f1.docx", "00")], "b1", "t")).select("id", "original", "category", "alias", "occurrences", "enabled", "source", "confidence"), f"WITH {M.TABLE_SQL} SELECT id, original, category, alias, occurrences, enabled, source, confidence FROM mapping")


def _s11(s, d):
    """The mapping file written, loaded with its checks, and its items as rows; files that are no mapping are refused."""
    text = envelope.mapping_json(M.table(s, d), [("f1.docx", "00")], "b1", "t").first().json
    refused = 0
    for bad in (text.replace('"1.0"', '"0.9"'), '{"version": "1.0", "mappings": []}', '{"version": "1.0", "batch_id": "b"}'):
        try:
            envelope.load_mapping(bad)
        except ValueError:
            refused += 1
    return envelope.items_of(s, envelope.load_mapping(text)).select("id", "original", "alias", F.lit(refused).alias("n_refused"))


_R.add("s11_load_mapping", _s11, f"WITH {M.TABLE_SQL} SELECT id, original, alias, 3 AS n_refused FROM mapping")


def _x2(s, d):
    """Sealed and opened again, with the right password, a wrong one and a changed envelope."""
    text = envelope.mapping_json(M.table(s, d), batch_id="b1", created_at="t").first().json
    sealed = envelope.seal(s, text, "secret-1")
    rows = [("right", envelope.unseal(s, sealed, "secret-1") == text)]
    for name, e, password in (("wrong", sealed, "secret-2"), ("changed", sealed | {"data": sealed["data"][:-8] + "AAAAAAA="}, "secret-1"), ("malformed", {"enc": "x"}, "secret-1")):
        try:
            rows.append((name, envelope.unseal(s, e, password) == text))
        except envelope.WrongPassword:
            rows.append((name, False))
    return s.createDataFrame([(n, ok, text[10:13] not in json.dumps(sealed["data"])) for n, ok in rows], "test string, opened boolean, hidden boolean").select("test", "opened")


_R.add("x2_envelope", _x2, "SELECT * FROM (VALUES ('right', true), ('wrong', false), ('changed', false), ('malformed', false)) AS v(test, opened)")

_KEY, _NONCE = bytes(range(32)), bytes(range(12))


def _x3(s, d):
    rows = customers(s, d, t=S.NAME).withColumn("c", envelope.encrypt(F.col("t"), _KEY, _NONCE))
    back = F.try_aes_decrypt("c", F.lit(_KEY), F.lit("GCM"), F.lit("DEFAULT")).cast("string")
    return rows.select(K, back.alias("t"), F.try_aes_decrypt("c", F.lit(_KEY[::-1]), F.lit("GCM"), F.lit("DEFAULT")).isNull().alias("wrong_is_null"))


_R.add("x3_cipher", _x3, f"SELECT {K}, {S.NAME} AS t, true AS wrong_is_null FROM customer")

_MAPPING = {
    "version": "1.0", "batch_id": "b", "doc_manifest": [{"file": "f1.docx", "sha256": ""}, {"file": "f2.docx", "sha256": ""}],
    "mappings": [
        {"id": 1, "alias": "甲某", "original": "张三", "occurrences": 2, "enabled": True}, {"id": 2, "alias": "甲某2", "original": "李四", "occurrences": 1},
        {"id": 3, "alias": "乙某", "original": "甲某某", "occurrences": 5, "enabled": True}, {"id": 4, "alias": "丙某", "original": "王五", "occurrences": 1, "enabled": False},
    ],
}


def _t1(s, d):
    rows = []
    for name, m in (("good", _MAPPING), ("version", _MAPPING | {"version": "2"}), ("shape", _MAPPING | {"mappings": {}})):
        try:
            restore.validate(m)
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return s.createDataFrame(rows, "test string, ok boolean")


_R.add("t1_validate", _t1, "SELECT * FROM (VALUES ('good', true), ('version', false), ('shape', false)) AS v(test, ok)")
_PATH = f"concat('/x/c', {txt(K)}, CASE CAST({K} % 4 AS INT) WHEN 0 THEN '.docx' WHEN 1 THEN '.TXT' WHEN 2 THEN '.md' ELSE '.pdf' END)"
_R.add("t2_guard", lambda s, d: customers(s, d, path=_PATH).filter(restore.restorable(F.col("path"))).select("path"), f"SELECT {_PATH} AS path FROM customer WHERE {K} % 4 < 3")
_R.add("t3_name_warning", lambda s, d: restore.name_warnings(customers(s, d, name=S.FILE), _MAPPING).groupBy("name").agg(F.count("*").alias("n")), f"SELECT {S.FILE} AS name, count(*) AS n FROM customer WHERE {K} % 10 NOT IN (1, 2) GROUP BY 1")
_R.add("t4_inverse_pairs", lambda s, d: s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(restore.inverse_pairs(_MAPPING))], "place int, alias string, original string"), "SELECT * FROM (VALUES (0, '甲某2', '李四'), (1, '甲某', '张三'), (2, '乙某', '甲某某')) AS v(place, alias, original)")
_EDITED = f"concat('甲某与甲某2签约，', CASE WHEN {K} % 2 = 0 THEN '乙某' ELSE '' END, '见证。丙某')"


def _restored(s, d, one):
    pairs = restore.pair_array(restore.inverse_pairs(_MAPPING))
    rows = customers(s, d, text=_EDITED).withColumn("pairs", pairs)
    text, n = one(F.col("text"), F.col("pairs"))
    return rows.withColumns({"restored": text, "n": n}).select(K, F.col("restored").alias("text"), "n")


_DONE = f"SELECT {K}, concat('张三与李四签约，', CASE WHEN {K} % 2 = 0 THEN '甲某某' ELSE '' END, '见证。丙某') AS text, CASE WHEN {K} % 2 = 0 THEN 3 ELSE 2 END AS n FROM customer"
_R.add("t5_restore_text", lambda s, d: _restored(s, d, restore.restore_text), _DONE)
_R.add("t6_restore_paragraph", lambda s, d: _restored(s, d, restore.restore_paragraph), _DONE)


def _t7(s, d):
    docs = customers(s, d, name=f"concat('c', {txt(K)})", text=_EDITED)
    return restore.unrestored(docs, envelope.items_of(s, _MAPPING))


_R.add("t7_unrestored", _t7, f"SELECT concat('c', CAST({K} AS VARCHAR)) AS name, '乙某' AS alias, '甲某某' AS original, CAST(5 AS BIGINT) AS occurrences FROM customer WHERE {K} % 2 = 1")
_R.add("t8_report", lambda s, d: customers(s, d, name=f"concat('c', {txt(K)}, '.v1.docx')", a="'甲某'", b=S.NAME).select(restore.restored_name(F.col("name")).alias("target"), restore.report_line(F.col("a"), F.col("b"), F.col(K)).alias("line")), f"SELECT concat('c', CAST({K} AS VARCHAR), '.v1_已还原.docx') AS target, concat('甲某', chr(9), {S.NAME}, chr(9), '原出现 ', CAST({K} AS VARCHAR), ' 次') AS line FROM customer")
_R.add("b11_password", lambda s, d: customers(s, d, a=f"concat('pw', {txt(K)})", b=f"concat('pw', {txt(f'{K} - {K} % 3')})").select(K, envelope.password_ok(F.col("a"), F.col("b")).alias("ok")), f"SELECT {K}, length({txt(K)}) >= 4 AND {K} % 3 = 0 AS ok FROM customer")

QUERIES, ORACLES = _R.queries, _R.oracles
