"""Queries of the recognition layers: rules, lexicon, named entities, arbitration, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakwork.functions import checksums, matching
from cloakwork.functions.fixed import ADDRESS_PREFIXES, LEADING_BAD, NER_LABELS, RULES
from cloakwork.functions.matching import HIT, numbered
from cloakwork.operators import arbitrate, evaluate, lexicon, ner, rules
from cloakwork.queries import synth as S
from cloakwork.queries.synth import K, Registry, customers, txt

_R = Registry()
LEX = lexicon.Lexicon(custom_names=["欧阳若兰", "张某某"])


def _spans(name: str, hits, value: str, around: list[tuple[str, str]], negative: str, category: str, expected: str | None = None, shift: int = 0) -> None:
    """Texts of three kinds: two hold a value between a prefix and a suffix, the third holds none. hits: text -> array.

    expected: the part of the value that is found, `shift` characters into it.
    """
    text = f"CASE CAST({K} % 3 AS INT) WHEN 0 THEN concat('{around[0][0]}', {value}, '{around[0][1]}') WHEN 1 THEN concat('{around[1][0]}', {value}, '{around[1][1]}') ELSE {negative} END"
    found = expected or value
    start = f"CASE CAST({K} % 3 AS INT) WHEN 0 THEN {len(around[0][0]) + shift} ELSE {len(around[1][0]) + shift} END"

    def query(spark, sf_dir):
        rows = customers(spark, sf_dir, text=text).select(K, F.explode(hits(F.col("text"))).alias("h"))
        return rows.select(K, F.col("h.start").alias("start_at"), F.col("h.end").alias("end_at"), F.col("h.text").alias("value"), F.col("h.category").alias("category"))

    sql = f"SELECT {K}, CAST({start} AS INT) AS start_at, CAST({start} + length({found}) AS INT) AS end_at, {found} AS value, '{category}' AS category FROM customer WHERE {K} % 3 < 2"
    _R.add(name, query, sql)


def _rule(rule: str):
    return lambda t: rules.rule_hits(t, rule)


def _lex(f):
    return lambda t: f(t, LEX)


_n9 = f"lpad({txt(K)}, 9, '0')"
_RULES = {
    "r1_id_number": ("id_number", S.id_number(), [("身份证号", "，"), ("id:", "")], f"concat('身份证号', {S.id_number(1)})"),
    "r2_phone": ("phone", S.PHONE, [("电话", "。"), ("", "")], f"concat({S.PHONE}, '0')"),
    "r3_bank_card": ("bank_card", S.card(), [("卡号", "。"), ("a", "b")], f"concat('卡号', {S.card(3)})"),
    "r4_passport": ("passport", f"concat('E', lpad({txt(K)}, 8, '0'))", [("护照", "，"), ("", " ")], f"concat('xE', lpad({txt(K)}, 8, '0'))"),
    "r5_permit": ("permit", f"concat('H', {_n9})", [("通行证", "，"), ("(", ")")], f"concat('H', {_n9}, '12')"),
    "r6_email": ("email", f"concat('u', {txt(K)}, '@mail.example.com')", [("邮箱", "，"), ("<", ">")], f"concat('u', {txt(K)}, '@mail.example.com.')"),
    "r7_uscc": ("uscc", S.uscc(), [("代码", "。"), ("：", " ")], f"concat('代码', {S.uscc(1)})"),
    "r8_plate": ("plate", f"concat('京A', lpad({txt(f'{K} % 100000')}, 5, '0'))", [("车牌", "。"), ("", "")], f"concat('京', lpad({txt(K)}, 6, '0'))"),
    "r9_wechat": ("wechat", f"concat('wx_', {_n9})", [("微信号：", "，"), ("WeChat: ", "")], f"concat('wx_', {_n9})"),
    "r10_social_security": ("social_security", f"concat('7', {_n9})", [("社保号：", "。"), ("社会保险号 ", "")], f"concat('社保号：', {txt(f'{K} % 1000')})"),
    "r11_housing_fund": ("housing_fund", f"concat('8', {_n9})", [("公积金账号：", "。"), ("公积金", "")], f"concat('公积金账号：A', {_n9})"),
    "r12_securities": ("securities", f"concat('A', {_n9})", [("证券账户：", "。"), ("股东账户", " ")], f"concat('证券账户：', {txt(f'{K} % 1000')})"),
    "r13_birth_lead": ("birth_lead", S.DATE, [("生于", "，"), ("出生日期：", "")], S.DATE),
    "r14_birth_tail": ("birth_tail", S.DATE, [("男，", "出生，"), ("", "出生")], f"concat({S.DATE}, '入职')"),
}
for _name, (_rule_name, _value, _around, _negative) in _RULES.items():
    _spans(_name, _rule(_rule_name), _value, _around, _negative, RULES[_rule_name].category)

_WIDE = "'0123456789', '０１２３４５６７８９'"
_spans("r1_full_width", _rule("id_number"), f"concat(translate(substr({S.id_number()}, 1, 6), {_WIDE}), substr({S.id_number()}, 7, 8), translate(substr({S.id_number()}, 15, 3), {_WIDE}), substr({S.id_number()}, 18, 1))", [("身份证号", "，"), ("id:", "")], f"translate({S.id_number(1)}, {_WIDE})", "id_number")
_spans("r3_full_width", _rule("bank_card"), f"translate({S.card()}, {_WIDE})", [("卡号", "。"), ("a", "b")], f"translate({S.card(3)}, {_WIDE})", "bank_card")

_ROOM = f"concat('工业大道', {txt(f'1 + {K} % 90')}, '附近')"
_spans("l1_judicial", _lex(lexicon.judicial_persons), S.NAME, [("审判长：", "\n"), ("书记员 ", "")], f"concat('审判长：', {S.GIVEN}, '中心')", "person")
_spans("l2_prompted", _lex(lexicon.prompted_persons), S.NAME, [("姓 名：", "，男"), ("借款人（乙方）：", "。")], f"concat('请在合同上签名', {S.NAME})", "person")
_spans("l2_rare_surnames", _lex(lexicon.prompted_persons), f"concat(substr('卫华云', 1 + CAST({K} % 7 % 3 AS INT), 1), {S.GIVEN})", [("原告：", "，男"), ("证人", "。")], f"concat('原告：', {S.GIVEN}, '公司')", "person")
_spans("l3_gendered", _lex(lexicon.gendered_persons), S.NAME, [("", "，男，汉族"), ("。", "，女。")], f"concat({S.NAME}, '，性别不详')", "person")
_spans("l6_persons", _lex(lexicon.persons), S.NAME, [("原告：", "，男，汉族"), ("审判员", "。")], f"concat({S.NAME}, '认为')", "person")
_spans("l7_company", _lex(lexicon.companies), S.COMPANY, [("原告", "诉称。"), ("确认", "，")], f"concat('北京', {S.GIVEN}, '律师事务所')", "company")
_spans("l7_company_names", _lex(lexicon.companies), f"concat('名流', {S.GIVEN}, '置业有限公司')", [("", "，"), ("原告", "")], f"concat('北京', {S.GIVEN}, '律师事务所')", "company")
_spans("l8_address", _lex(lexicon.addresses), S.ADDRESS, [("住", "，"), ("位于", "。")], f"concat({S.GIVEN}, {S.SURNAME}, '路')", "address")
_spans("l9_region_address", _lex(lexicon.region_addresses), f"concat('惠州市', {_ROOM})", [("，", "，"), ("", "")], f"concat('惠州市', {S.GIVEN}, '区人民法院')", "address")
_spans("l10_custom", _lex(lexicon.custom_names), f"CASE WHEN {K} % 2 = 0 THEN '欧阳若兰' ELSE '张某某' END", [("见", "签字"), ("", "")], "'欧阳'", "person")
_spans("l11_ethnicity", _lex(lexicon.ethnicities), f"CASE WHEN {K} % 2 = 0 THEN '汉族' ELSE '维吾尔族' END", [("男，", "，"), ("", "")], "'民族'", "ethnicity")


def _flag(name: str, value: str, test, sql: str) -> None:
    """(key, value, ok) of a predicate over made values."""

    def query(spark, sf_dir):
        return customers(spark, sf_dir, value=value).select(K, "value", test(F.col("value")).alias("ok"))

    _R.add(name, query, f"SELECT {K}, {value} AS value, {sql} AS ok FROM customer")


def _either(make) -> str:
    return f"CASE WHEN {K} % 2 = 0 THEN {make(0)} ELSE {make(1)} END"


def _wide(value: str) -> str:
    return f"CASE WHEN {K} % 4 < 2 THEN {value} ELSE translate({value}, {_WIDE}) END"


_flag("f1_valid_id", _wide(_either(S.id_number)), checksums.valid_id_number, f"{K} % 2 = 0")
_flag("f2_valid_luhn", _wide(_either(S.card)), checksums.valid_luhn, f"{K} % 2 = 0")
_flag("f3_valid_uscc", _either(S.uscc), checksums.valid_uscc, f"{K} % 2 = 0")
_flag("l4_valid_name", f"CASE WHEN {K} % 6 = 5 THEN concat('欧阳', {S.GIVEN}) WHEN {K} % 3 = 0 THEN concat({S.GIVEN}, '明') WHEN {K} % 3 = 1 THEN concat({S.SURNAME}, '局') ELSE {S.NAME} END", lambda v: lexicon.valid_name(v, LEX), f"{K} % 3 = 2 OR ({K} % 3 = 0 AND {S.GIVEN} = '强')")
_flag("l5_near_stopword", f"CASE WHEN {K} % 3 = 0 THEN '被告中级人民法院' WHEN {K} % 3 = 1 THEN '原告张法院长' ELSE concat('原告：', {S.NAME}, '，') END", lambda v: lexicon.near_stopword(v, F.lit(2), F.lit(5), LEX), f"{K} % 3 < 2")


def _p1(spark, sf_dir):
    rows = customers(spark, sf_dir, value=f"concat(CASE WHEN {K} % 2 = 0 THEN '原告被告人' ELSE '被告' END, {S.COMPANY})")
    return rows.select(K, matching.strip_prefixes(F.col("value"), LEX.prefixes()).alias("value"))


# Passes go by the list: behind 原告 the shorter 被告 comes off in the same pass, before 被告人 has its turn again.
_R.add("p1_strip_prefixes", _p1, f"SELECT {K}, CASE WHEN {K} % 2 = 0 THEN concat('人', {S.COMPANY}) ELSE {S.COMPANY} END AS value FROM customer")


def _p1_many(spark, sf_dir):
    rows = customers(spark, sf_dir, value=f"concat(repeat('住', CAST(25 + {K} % 40 AS INT)), '址', {S.NAME})")
    return rows.select(K, matching.strip_prefixes(F.col("value"), list(ADDRESS_PREFIXES)).alias("value"))


_R.add("p1_many_passes", _p1_many, f"SELECT {K}, {S.NAME} AS value FROM customer")


def _p2(spark, sf_dir):
    rows = customers(spark, sf_dir, value=f"concat(CASE WHEN {K} % 2 = 0 THEN '其曾在' ELSE '确认' END, {S.COMPANY})")
    return rows.select(K, matching.strip_words(F.col("value"), LEADING_BAD).alias("value"))


_R.add("p2_strip_words", _p2, f"SELECT {K}, {S.COMPANY} AS value FROM customer")


def _hit(start: str, end: str, category: str, confidence: float, source: str, judicial: bool = False) -> str:
    return f"named_struct('start', CAST({start} AS INT), 'end', CAST({end} AS INT), 'text', substr(text, CAST({start} AS INT) + 1, CAST({end} AS INT) - CAST({start} AS INT)), 'category', '{category}', 'confidence', CAST({confidence} AS DOUBLE), 'source', '{source}', 'judicial', {str(judicial).lower()}, 'ord', 0)"


def _hits(spark, sf_dir, *hits: str):
    rows = customers(spark, sf_dir, text="repeat('深圳市福田区莲花街道办事处', 8)")
    return rows.withColumn("hits", numbered(F.expr(f"array({', '.join(hits)})").cast(f"array<{HIT}>")))


def _flat(rows, hits):
    return rows.select(K, F.explode(hits).alias("h")).select(K, F.col("h.start").alias("start_at"), F.col("h.end").alias("end_at"), F.col("h.category").alias("category"))


def _a1(spark, sf_dir):
    at = f"{K} % 5"
    rows = _hits(spark, sf_dir, _hit(at, f"{at} + 6", "address", 0.7, "lexicon"), _hit(f"{at} + 6", f"{at} + 6 + {K} % 4 + 4", "org", 0.75, "ner"), _hit(f"{at} + 3", f"{at} + 5", "person", 0.8, "ner"), _hit("60", "71", "phone", 0.99, "rule"), _hit("30", "30 + 40", "org", 0.75, "ner"))
    return _flat(rows, arbitrate.merge_fragments(F.col("text"), F.col("hits")))


# The first two touch and become one, of the longer one's category (org wins at equal length); the third lies inside.
_R.add("a1_merge", _a1, f"""
SELECT {K}, CAST({K} % 5 AS INT) AS start_at, CAST({K} % 5 + 10 + {K} % 4 AS INT) AS end_at, CASE WHEN {K} % 4 >= 2 THEN 'org' ELSE 'address' END AS category FROM customer
UNION ALL SELECT {K}, 30, 70, 'org' FROM customer UNION ALL SELECT {K}, 60, 71, 'phone' FROM customer""")


def _a2(spark, sf_dir):
    rows = _hits(spark, sf_dir, _hit(f"5 + {K} % 3", f"16 + {K} % 3", "phone", 0.99, "rule"), _hit("6", "10", "person", 0.85, "lexicon"), _hit("6", "12", "person", 0.8, "ner"), _hit("30", "48", "bank_card", 0.99, "rule"), _hit("30", "48", "id_number", 0.99, "rule"))
    return _flat(rows, arbitrate.arbitrate(F.col("hits")))


# An earlier start wins over any layer; at the same start the rule does, and the identity number over the card.
_R.add("a2_arbitrate", _a2, f"""
SELECT {K}, CASE WHEN {K} % 3 = 2 THEN 6 ELSE CAST(5 + {K} % 3 AS INT) END AS start_at, CASE WHEN {K} % 3 = 2 THEN 10 ELSE CAST(16 + {K} % 3 AS INT) END AS end_at,
       CASE WHEN {K} % 3 = 2 THEN 'person' ELSE 'phone' END AS category FROM customer
UNION ALL SELECT {K}, 30, 48, 'id_number' FROM customer""")


def _a3(spark, sf_dir):
    rows = customers(spark, sf_dir, text=f"CASE WHEN {K} % 2 = 0 THEN concat('审判长：', {S.NAME}, '。') ELSE concat('原告：', {S.NAME}, '，') END")
    return arbitrate.findings(rows).select(K, F.col("original"), "judicial", "status")


_R.add("a3_judicial", _a3, f"SELECT {K}, {S.NAME} AS original, false AS judicial, 'pending' AS status FROM customer WHERE {K} % 2 = 1")


def _a4(spark, sf_dir):
    return customers(spark, sf_dir, confidence=f"CAST(CAST({K} % 100 AS INT) AS DOUBLE) / 100").select(K, arbitrate.status_of(F.col("confidence")).alias("status"))


_R.add("a4_status", _a4, f"SELECT {K}, CASE WHEN CAST({K} % 100 AS DOUBLE) / 100 >= 0.9 THEN 'auto' WHEN CAST({K} % 100 AS DOUBLE) / 100 >= 0.6 THEN 'pending' END AS status FROM customer")

_CONTRACT = f"concat('出借人（甲方）：', {S.NAME}, '，男，汉族，手机号', {S.PHONE}, '。')"


def _a5(spark, sf_dir):
    return arbitrate.findings(customers(spark, sf_dir, text=_CONTRACT)).select(K, F.col("start").alias("start_at"), F.col("end").alias("end_at"), "original", "category", "status")


_R.add("a5_scan_paragraph", _a5, f"""
SELECT {K}, 8 AS start_at, 10 AS end_at, {S.NAME} AS original, 'person' AS category, 'pending' AS status FROM customer
UNION ALL SELECT {K}, 13, 15, '汉族', 'ethnicity', 'auto' FROM customer
UNION ALL SELECT {K}, 19, 30, {S.PHONE}, 'phone', 'auto' FROM customer""")


def _a6(spark, sf_dir):
    rows = customers(spark, sf_dir, text=f"CASE WHEN {K} % 4 = 0 THEN '  ' WHEN {K} % 4 = 1 THEN CAST(NULL AS STRING) ELSE {_CONTRACT} END", para_index=f"CAST({K} AS INT)")
    return arbitrate.findings(rows).groupBy("para_index").agg(F.count("*").alias("n"))


_R.add("a6_scan_paragraphs", _a6, f"SELECT CAST({K} AS INT) AS para_index, CAST(3 AS BIGINT) AS n FROM customer WHERE {K} % 4 > 1")

_VOCAB = {w: i for i, w in enumerate("[PAD] [UNK] [CLS] [SEP] 张 三 在 ab ##c ##1 x ，".split())}


def _n2(spark, sf_dir):
    rows = ner.tokenized(customers(spark, sf_dir, text=f"concat('张三在abc', CASE WHEN {K} % 2 = 0 THEN '1' ELSE 'z' END, '，x')"), _VOCAB)
    return rows.select(K, F.array_join(F.transform("tokens", lambda t: F.concat(t["token"], F.lit(":"), t["start"].cast("string"), F.lit("-"), t["end"].cast("string"))), " ").alias("tokens"))


_R.add("n2_word_pieces", _n2, f"SELECT {K}, concat('张:0-1 三:1-2 在:2-3 ab:3-5 ##c:5-6 ', CASE WHEN {K} % 2 = 0 THEN '##1' ELSE '[UNK]' END, ':6-7 ，:7-8 x:8-9') AS tokens FROM customer")


_VOCAB_FILE = "[PAD]\n[UNK]\r\n[CLS]\n[SEP]\n张\n三\u2028\n\n##c"
_R.add("n1_vocabulary", lambda spark, d: spark.createDataFrame([(w, i) for w, i in ner.read_vocabulary(_VOCAB_FILE).items()], "word string, id int"), "SELECT * FROM (VALUES ('[PAD]', 0), ('[UNK]', 1), ('[CLS]', 2), ('[SEP]', 3), ('张', 4), (concat('三', chr(8232)), 5), ('', 6), ('##c', 7)) AS v(word, id)")


def _n4(spark, sf_dir):
    rows = ner.encoded(customers(spark, sf_dir, text=f"concat(repeat('张', CAST({K} % 700 AS INT)), '在')"), _VOCAB)
    ids = F.col("ids")
    return rows.select(K, F.size("ids").cast("long").alias("n"), F.element_at(ids, 1).alias("first"), F.element_at(ids, 2).alias("second"), F.element_at(ids, -2).alias("before_last"), F.element_at(ids, -1).alias("last"))


# A sentence is cut behind 510 tokens; 2 and 3 begin and end it.
_R.add("n4_encode", _n4, f"SELECT {K}, least(510, {K} % 700 + 1) + 2 AS n, 2 AS first, CASE WHEN {K} % 700 = 0 THEN 6 ELSE 4 END AS second, CASE WHEN {K} % 700 >= 510 THEN 4 ELSE 6 END AS before_last, 3 AS last FROM customer")
_LABEL_NAMES = "['address', 'book', 'company', 'game', 'government', 'movie', 'name', 'organization', 'position', 'scene']"
_R.add("n9_labels", lambda spark, d: spark.createDataFrame(list(enumerate(NER_LABELS)), "id int, label string"), f"""
WITH n AS (SELECT unnest({_LABEL_NAMES}) AS x, generate_subscripts({_LABEL_NAMES}, 1) AS i),
l AS (SELECT 0 AS a, 0 AS i, 'O' AS label UNION ALL SELECT 1, 2 * i, concat('B-', x) FROM n UNION ALL SELECT 1, 2 * i + 1, concat('I-', x) FROM n
      UNION ALL SELECT 2, CASE x WHEN 'address' THEN 1 WHEN 'book' THEN 2 WHEN 'company' THEN 3 WHEN 'game' THEN 4 WHEN 'government' THEN 5 WHEN 'movie' THEN 6 WHEN 'name' THEN 7 WHEN 'organization' THEN 8 WHEN 'position' THEN 9 ELSE 10 END, concat('S-', x) FROM n
      UNION ALL SELECT 3, 0, '[PAD]')
SELECT CAST(row_number() OVER (ORDER BY a, i) - 1 AS INT) AS id, label FROM l""")


def _n6(spark, sf_dir):
    tags = F.expr(f"array('B-name', 'I-name', 'O', CASE WHEN {K} % 2 = 0 THEN 'I-name' ELSE 'B-game' END, 'B-company', 'I-company', 'S-address')")
    rows = customers(spark, sf_dir, one="1").select(K, tags.alias("tags"), F.sequence(F.lit(0), F.lit(6)).alias("a"), F.sequence(F.lit(1), F.lit(7)).alias("b"))
    rows = rows.select(K, F.explode(ner.decode_tags(F.col("tags"), F.col("a"), F.col("b"))).alias("h"))
    return rows.select(K, F.col("h.start").alias("start_at"), F.col("h.end").alias("end_at"), F.col("h.category").alias("category"), F.col("h.confidence").alias("confidence"))


# An O does not close an entity, so an I of the same kind behind it goes on with it.
_R.add("n6_decode_tags", _n6, f"""
SELECT {K}, 0 AS start_at, CASE WHEN {K} % 2 = 0 THEN 4 ELSE 2 END AS end_at, 'person' AS category, CAST(0.8 AS DOUBLE) AS confidence FROM customer
UNION ALL SELECT {K}, 4, 6, 'company', CAST(0.8 AS DOUBLE) FROM customer UNION ALL SELECT {K}, 6, 7, 'address', CAST(0.7 AS DOUBLE) FROM customer""")


def _n10(spark, sf_dir):
    provider = lambda t: [{"start": 0, "end": 2, "category": "org", "confidence": 0.75}]
    rows = customers(spark, sf_dir, text=f"concat({S.GIVEN}, {S.SURNAME}, 'x')")
    return arbitrate.findings(rows, provider=provider).select(K, "original", "category", "source", "status")


_R.add("n10_provider", _n10, f"SELECT {K}, concat({S.GIVEN}, {S.SURNAME}) AS original, 'org' AS category, 'ner' AS source, 'pending' AS status FROM customer")

_GOLD = f"concat('{{\"text\": \"t\", \"label\": {{\"name\": {{\"a\": [[0, ', {txt(f'{K} % 3')}, ']]}}, \"government\": {{\"b\": [[4, 6], [8, 9]]}}, \"game\": {{\"c\": [[1, 2]]}}}}}}')"


def _gold(spark, sf_dir):
    return evaluate.gold_spans(evaluate.parse_gold(customers(spark, sf_dir, value=_GOLD)), K)


_GOLD_SQL = f"SELECT {K}, 'person' AS category, 0 AS s, CAST({K} % 3 + 1 AS INT) AS e FROM customer UNION ALL SELECT {K}, 'org', 4, 7 FROM customer UNION ALL SELECT {K}, 'org', 8, 10 FROM customer"
_R.add("e1_gold_spans", lambda spark, d: _gold(spark, d).toDF(K, "category", "s", "e"), _GOLD_SQL)


def _predicted(spark, sf_dir):
    rows = customers(spark, sf_dir, spans="array(named_struct('category', 'person', 'start', 0, 'end', 2), named_struct('category', 'org', 'start', 4, 'end', 7), named_struct('category', 'phone', 'start', 1, 'end', 3), named_struct('category', 'org', 'start', 4, 'end', 7))")
    return evaluate.predicted_spans(rows.select(K, F.explode("spans").alias("x")).select(K, "x.*"), K)


_PRED_SQL = f"SELECT {K}, 'person' AS category, 0 AS s, 2 AS e FROM customer UNION ALL SELECT {K}, 'org', 4, 7 FROM customer"
_R.add("e2_predicted_spans", lambda spark, d: _predicted(spark, d).toDF(K, "category", "s", "e"), _PRED_SQL)
_SCORE_SQL = f"""
WITH g AS ({_GOLD_SQL}), p AS ({_PRED_SQL}),
m AS (SELECT category, g.{K} IS NOT NULL AS ing, p.{K} IS NOT NULL AS inp FROM g FULL JOIN p USING ({K}, category, s, e)),
c AS (SELECT category, count(*) FILTER (ing AND inp) AS tp, count(*) FILTER (NOT ing) AS fp, count(*) FILTER (NOT inp) AS fn FROM m GROUP BY category),
r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS rc FROM c)
"""
_R.add("e3_counts", lambda spark, d: evaluate.scores(_gold(spark, d), _predicted(spark, d), K).select("category", "tp", "fp", "fn"), _SCORE_SQL + "SELECT category, tp, fp, fn FROM r")
_R.add("e4_scores", lambda spark, d: evaluate.scores(_gold(spark, d), _predicted(spark, d), K).select("category", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")]), _SCORE_SQL + 'SELECT category, round(pr, 9) AS "precision", round(rc, 9) AS recall, round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 9) AS f1 FROM r')

QUERIES, ORACLES = _R.queries, _R.oracles
