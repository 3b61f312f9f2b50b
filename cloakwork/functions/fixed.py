"""Word lists, patterns and tables that decide which results come out.

Patterns are for Java's engine; `(?Ud)` makes its classes as wide as Unicode and its `$` see only a final newline.
"""

from __future__ import annotations

from typing import NamedTuple

# --- fixed values: categories and their labels ---
LABELS = {
    "person": "人名", "company": "公司", "org": "单位", "address": "地址", "custom": "自定义",
    "id_number": "身份证号", "phone": "手机号", "bank_card": "银行卡号", "passport": "护照号",
    "permit_hk_macau": "港澳通行证", "social_security": "社保编号", "housing_fund": "公积金账号",
    "uscc": "统一社会信用代码", "email": "电子邮箱", "wechat": "微信号", "plate": "车牌号",
    "birth_date": "出生日期", "ethnicity": "民族", "securities_account": "证券账户",
}
ENTITIES = ("person", "company", "org", "address")
ALIAS_SUFFIX = {"person": "某", "company": "公司", "org": "单位", "address": "地址", "custom": "某"}
STEMS, BRANCHES = "甲乙丙丁戊己庚辛壬癸", "子丑寅卯辰巳午未申酉戌亥"
KEEP = {
    "id_number": (3, 4), "phone": (3, 4), "bank_card": (4, 4), "passport": (2, 2), "permit_hk_macau": (2, 2),
    "social_security": (2, 2), "housing_fund": (2, 2), "uscc": (2, 2), "securities_account": (2, 2),
}
AUTO, PENDING, MERGE_MAX = 0.90, 0.60, 60
LAYER_RANK = {"rule": 0, "lexicon": 1, "custom": 1, "ner": 2}
CATEGORY_RANK = {"id_number": 0, "uscc": 1, "phone": 2, "bank_card": 3}
MERGE_RANK = {"company": 0, "org": 1, "address": 2, "person": 3}

# --- fixed values: checksums ---
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECKS = "10X98765432"
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"

# --- fixed values: number patterns ---
class Rule(NamedTuple):
    """A pattern in three parts: what leads to the value, the value, what follows it; and its category and checksum.
    `need` is found in every text in which the rule finds something."""

    category: str
    before: str
    value: str
    after: str = ""
    check: str | None = None
    need: str = ""


RULES = {
    "id_number": Rule("id_number", r"(?<![0-9Xx])", r"\d{6}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[0-9Xx]", r"(?![0-9Xx])", "id", r"\d{6}"),
    "phone": Rule("phone", r"(?<!\d)", r"1[3-9]\d{9}", r"(?!\d)", None, r"\d{6}"),
    "bank_card": Rule("bank_card", r"(?<!\d)", r"\d{13,19}", r"(?!\d)", "luhn", r"\d{6}"),
    "passport": Rule("passport", r"(?<![A-Za-z0-9])", r"[EGeg]\d{8}", r"(?![A-Za-z0-9])", None, r"\d{6}"),
    "permit": Rule("permit_hk_macau", r"(?<![A-Za-z0-9])", r"[HMhm]\d{8,10}", r"(?![A-Za-z0-9])", None, r"\d{6}"),
    "email": Rule("email", r"(?<![A-Za-z0-9_.])", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"(?![A-Za-z0-9_.])", None, "@"),
    "uscc": Rule("uscc", r"(?<![0-9A-Z])", r"[0-9A-HJ-NPQRTUWXY]{2}\d{6}[0-9A-HJ-NPQRTUWXY]{10}", r"(?![0-9A-Z])", "uscc", r"\d{6}"),
    "plate": Rule("plate", "", r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-HJ-NP-Z][A-HJ-NP-Z0-9]{4,5}[A-HJ-NP-Z0-9挂学警港澳]", "", None, r"[一-龥][A-HJ-NP-Z]"),
    "wechat": Rule("wechat", r"(?:微信号?|WeChat)[:：\s\x1c-\x1f]*", r"[a-zA-Z][a-zA-Z0-9_-]{5,19}", "", None, "微信|WeChat"),
    "social_security": Rule("social_security", r"(?:社保(?:号|编号|卡号)?|社会保险号)[:：\s\x1c-\x1f]*", r"\d{9,18}", "", None, r"\d{6}"),
    "housing_fund": Rule("housing_fund", r"公积金(?:账号|账户|编号)?[:：\s\x1c-\x1f]*", r"\d{9,18}", "", None, r"\d{6}"),
    "securities": Rule("securities_account", r"(?:证券账户|资金账号|股东账户)[:：\s\x1c-\x1f]*", r"[A-Za-z0-9]{6,20}", "", None, "证券账户|资金账号|股东账户"),
    "birth_lead": Rule("birth_date", r"(?:出生(?:日期|年月)?|生于)[:：\s\x1c-\x1f]*", r"(?:\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/]\d{1,2}[-/]\d{1,2})", "", None, "出生|生于"),
    "birth_tail": Rule("birth_date", "", r"(?:\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/]\d{1,2}[-/]\d{1,2})", "(?=出生)", None, "出生|生于"),
}

# --- fixed values: word lists of the lexicon layer ---
ETHNICITIES = (
    "汉族", "壮族", "回族", "满族", "维吾尔族", "苗族", "彝族", "土家族", "藏族", "蒙古族", "侗族", "瑶族", "白族", "朝鲜族", "哈尼族", "哈萨克族",
    "黎族", "傣族", "畲族", "傈僳族", "仡佬族", "东乡族", "高山族", "拉祜族", "水族", "佤族", "纳西族", "羌族", "土族", "仫佬族", "锡伯族", "柯尔克孜族",
    "达斡尔族", "景颇族", "毛南族", "撒拉族", "布朗族", "塔吉克族", "阿昌族", "普米族", "鄂温克族", "怒族", "京族", "基诺族", "德昂族", "保安族", "俄罗斯族",
    "裕固族", "乌孜别克族", "门巴族", "鄂伦春族", "独龙族", "塔塔尔族", "赫哲族", "珞巴族",
)
STOPWORDS = (
    "人民法院", "人民检察院", "中级人民法院", "高级人民法院", "最高人民法院", "基层人民法院", "仲裁委员会", "公安局", "司法局", "公证处", "律师事务所", "检察院",
    "法院", "人民法庭", "执行局", "审判委员会",
)
PROMPTS = (
    "原告", "被告", "姓名", "姓 名", "名称", "联系人", "户名", "持卡人", "劳动者", "员工", "职工", "上诉人", "被上诉人", "申请人", "被申请人",
    "再审申请人", "申请执行人", "被执行人", "法定代表人", "负责人", "委托诉讼代理人", "委托代理人", "法定代理人", "证人", "第三人", "被害人", "犯罪嫌疑人", "被告人",
    "自诉人", "附带民事诉讼原告人", "附带民事诉讼被告人", "监护人", "继承人", "被继承人", "出借人", "借款人", "保证人", "抵押人", "质押人", "出租人", "承租人",
    "买受人", "出卖人", "发包人", "承包人", "转让人", "受让人", "居间人", "行纪人", "托运人", "承运人", "收货人", "保险人", "投保人", "被保险人", "受益人",
    "委托人", "受托人",
)
TITLES = (
    "审判长", "审判员", "代理审判员", "人民陪审员", "书记员", "执行员", "检察长", "检察员", "助理检察员", "公诉人", "辩护人", "值班律师",
)
REGIONS = (
    "北京市", "天津市", "上海市", "重庆市", "河北省", "山西省", "辽宁省", "吉林省", "黑龙江省", "江苏省", "浙江省", "安徽省", "福建省", "江西省", "山东省",
    "河南省", "湖北省", "湖南省", "广东省", "海南省", "四川省", "贵州省", "云南省", "陕西省", "甘肃省", "青海省", "台湾省", "内蒙古自治区", "广西壮族自治区",
    "西藏自治区", "宁夏回族自治区", "新疆维吾尔自治区", "香港特别行政区", "澳门特别行政区", "石家庄市", "唐山市", "保定市", "邯郸市", "沧州市", "廊坊市", "秦皇岛市",
    "太原市", "大同市", "呼和浩特市", "包头市", "鄂尔多斯市", "沈阳市", "大连市", "长春市", "吉林市", "哈尔滨市", "大庆市", "南京市", "苏州市", "无锡市",
    "常州市", "南通市", "徐州市", "扬州市", "杭州市", "宁波市", "温州市", "嘉兴市", "绍兴市", "金华市", "台州市", "合肥市", "芜湖市", "福州市", "厦门市",
    "泉州市", "漳州市", "莆田市", "南昌市", "赣州市", "九江市", "济南市", "青岛市", "烟台市", "潍坊市", "临沂市", "淄博市", "威海市", "郑州市", "洛阳市",
    "开封市", "新乡市", "武汉市", "宜昌市", "襄阳市", "长沙市", "株洲市", "湘潭市", "岳阳市", "常德市", "广州市", "深圳市", "珠海市", "佛山市", "东莞市",
    "中山市", "惠州市", "汕头市", "江门市", "湛江市", "肇庆市", "清远市", "揭阳市", "南宁市", "柳州市", "桂林市", "海口市", "三亚市", "成都市", "绵阳市",
    "德阳市", "宜宾市", "南充市", "泸州市", "贵阳市", "遵义市", "昆明市", "大理市", "曲靖市", "西安市", "咸阳市", "宝鸡市", "榆林市", "兰州市", "西宁市",
    "银川市", "乌鲁木齐市", "喀什市", "拉萨市", "东城区", "西城区", "朝阳区", "海淀区", "丰台区", "石景山区", "通州区", "顺义区", "昌平区", "大兴区",
    "房山区", "门头沟区", "平谷区", "密云区", "怀柔区", "延庆区", "黄浦区", "徐汇区", "长宁区", "静安区", "普陀区", "虹口区", "杨浦区", "浦东新区", "闵行区",
    "宝山区", "嘉定区", "金山区", "松江区", "青浦区", "奉贤区", "崇明区", "和平区", "河东区", "河西区", "南开区", "河北区", "红桥区", "滨海新区", "东丽区",
    "西青区", "津南区", "北辰区", "武清区", "宝坻区", "渝中区", "江北区", "南岸区", "九龙坡区", "沙坪坝区", "大渡口区", "渝北区", "巴南区", "北碚区",
    "万州区", "涪陵区",
)
#: The single surnames of the Hundred Family Surnames, a public text, in its verses; each character is one.
SURNAME_VERSES = """
赵钱孙李 周吴郑王 冯陈褚卫 蒋沈韩杨 朱秦尤许 何吕施张 孔曹严华 金魏陶姜 戚谢邹喻 柏水窦章 云苏潘葛 奚范彭郎
鲁韦昌马 苗凤花方 俞任袁柳 酆鲍史唐 费廉岑薛 雷贺倪汤 滕殷罗毕 郝邬安常 乐于时傅 皮卞齐康 伍余元卜 顾孟平黄
和穆萧尹 姚邵湛汪 祁毛禹狄 米贝明臧 计伏成戴 谈宋茅庞 熊纪舒屈 项祝董梁 杜阮蓝闵 席季麻强 贾路娄危 江童颜郭
梅盛林刁 钟徐邱骆 高夏蔡田 樊胡凌霍 虞万支柯 昝管卢莫 经房裘缪 干解应宗 丁宣贲邓 郁单杭洪 包诸左石 崔吉钮龚
程嵇邢滑 裴陆荣翁 荀羊於惠 甄曲家封 芮羿储靳 汲邴糜松 井段富巫 乌焦巴弓 牧隗山谷 车侯宓蓬 全郗班仰 秋仲伊宫
宁仇栾暴 甘钭厉戎 祖武符刘 景詹束龙 叶幸司韶 郜黎蓟薄 印宿白怀 蒲邰从鄂 索咸籍赖 卓蔺屠蒙 池乔阴鬱 胥能苍双
闻莘党翟 谭贡劳逄 姬申扶堵 冉宰郦雍 郤璩桑桂 濮牛寿通 边扈燕冀 郏浦尚农 温别庄晏 柴瞿阎充 慕连茹习 宦艾鱼容
向古易慎 戈廖庾终 暨居衡步 都耿满弘 匡国文寇 广禄阙东 欧殳沃利 蔚越夔隆 师巩厍聂 晁勾敖融 冷訾辛阚 那简饶空
曾毋沙乜 养鞠须丰 巢关蒯相 查後荆红 游竺权逯 盖益桓公
"""
COMPOUND_SURNAMES = (
    "欧阳", "太史", "端木", "上官", "司马", "东方", "独孤", "南宫", "万俟", "闻人", "夏侯", "诸葛", "尉迟", "公羊", "赫连", "澹台", "皇甫",
    "宗政", "濮阳", "公冶", "太叔", "申屠", "公孙", "慕容", "仲孙", "钟离", "长孙", "宇文", "司徒", "鲜于", "司空", "闾丘", "子车", "亓官",
    "司寇", "巫马", "公西", "颛孙", "壤驷", "公良", "漆雕", "乐正", "宰父", "谷梁", "拓跋", "夹谷", "轩辕", "令狐", "段干", "百里", "呼延",
    "东郭", "南门", "羊舌", "微生", "公户", "公玉", "公仪", "梁丘", "公仲", "公上", "公门", "公山", "公坚", "左丘", "公伯", "西门", "公祖",
    "第五", "公乘", "贯丘", "公皙", "南荣", "东里", "东宫", "仲长", "子书", "子桑", "即墨", "达奚", "褚师",
)
SURNAMES = tuple(c for c in SURNAME_VERSES if not c.isspace()) + COMPOUND_SURNAMES
NAME_BAD_SUFFIX = (
    "院", "局", "公司", "所", "会", "部", "庭", "处", "厅", "司", "署", "中心", "集团", "银行", "学校",
)
ADDRESS_BAD_SUFFIX = (*NAME_BAD_SUFFIX, "认为", "申请")
LEADING_BAD = (
    "确认", "认为", "其", "曾", "在", "于", "由", "向", "从", "到", "及", "和", "与", "被", "为", "是", "有", "称", "住", "对", "将",
    "该", "此", "现", "经", "并", "且", "或", "因", "按", "依", "据", "至",
)
ADDRESS_PREFIXES = ("住址", "位于", "住")

# --- fixed values: patterns of the lexicon layer; <…> stands for an alternation of words, longest first ---
NAME = r"[一-龥·]{2,4}"
NAME_END = r"(?=[，,。；;：:、\s\x1c-\x1f　（(【\-—~·男为女住身公民汉族]|$)"
JUDICIAL_LEAD = r"(?:<titles>)[:：\s\x1c-\x1f　]*"
PROMPTED_LEAD = r"(?:<prompts>)[:：\s\x1c-\x1f　]*(?:（[^）]{1,6}）[:：\s\x1c-\x1f　]*)?"
GENDER_TAIL = r"，(?:男|女)[，,。\s\x1c-\x1f]"
COMPANY = r"[一-龥A-Za-z0-9（）()]{2,40}?(?:有限责任公司|股份有限公司|有限公司|律师事务所|会计师事务所|事务所|银行|集团|分公司)"
COMPANY_NEED = "公司|事务所|银行|集团"
ADDRESS = (
    r"(?:[一-龥]{2,10}[\s\x1c-\x1f　]*(?:省|市|自治区|区|县|镇|乡|州)[\s\x1c-\x1f　]*){0,3}[一-龥0-9]{1,20}[\s\x1c-\x1f　]*"
    r"(?:路|街|巷|大道|大街|胡同|弄|里|号院|号楼|小区|大厦|广场|园|栋|幢|座|单元|室|楼|层|房)"
    r"(?:[\s\x1c-\x1f　]*[一-龥0-9]{1,8}(?:号|楼|层|室|栋|幢|座|单元|房)){0,4}"
)
ADDRESS_NEED = "[路街巷道同弄里院楼区厦场园栋幢座元室层房]"
REGION_LEAD = "(?:<regions>)"
REGION_PLACE = r"[\s\x1c-\x1f　]*[一-龥0-9]{4,25}"
REGION_END = r"(?=[，,。；;：:、\s\x1c-\x1f　）)]|$)"

# --- fixed values: the mapping file ---
FORMAT_VERSION = "1.0"
SCRYPT = {"n": 2**14, "r": 8, "p": 1, "dklen": 32}
RESTORABLE = (".docx", ".txt", ".md")
INTAKE = (".docx", ".pdf")
BIG_PAGES = 500

# --- fixed values: the named-entity layer ---
NER_CATEGORIES = {"name": "person", "company": "company", "government": "org", "organization": "org", "address": "address"}
NER_CONFIDENCE = {"person": 0.80, "company": 0.80, "org": 0.75, "address": 0.70}
NER_LABELS = (
    "O", "B-address", "I-address", "B-book", "I-book", "B-company", "I-company", "B-game", "I-game",
    "B-government", "I-government", "B-movie", "I-movie", "B-name", "I-name", "B-organization",
    "I-organization", "B-position", "I-position", "B-scene", "I-scene", "S-address", "S-book", "S-company",
    "S-game", "S-government", "S-movie", "S-name", "S-organization", "S-position", "S-scene", "[PAD]",
)
NER_MAX_TOKENS = 510
NER_ALONE = "，。；：、！？（）【】《》'—…·"
