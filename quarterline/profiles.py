"""Language profiles: every pattern, word list and threshold the text operators use.

An operator takes a profile, so the same plan serves Chinese reports (``ZH``) and
Latin-script text (``LATIN``). Patterns are Java regular expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# White space and line breaks as Unicode text has them. Operators first turn every such
# character into a plain space (or newline), so that patterns need only those.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    + chr(0x1680)
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "".join(map(chr, (0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
)
BREAK_CHARS = "\x0b\x0c\x1c\x1d\x1e\x85" + chr(0x2028) + chr(0x2029)
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]"
CJK = r"[\x{4e00}-\x{9fff}]"
LINE_BREAK = "\r\n|[\n\r]"


@dataclass(frozen=True)
class TextProfile:
    """Rules for turning paged text into clean sentences."""

    # headings and tables of contents
    heading: str
    section_keys: tuple[tuple[str, str], ...]
    toc_words: tuple[str, ...]
    toc_head_chars: int = 800
    # sentence ends
    sentence_end: str = "。！？"
    terminators: str = "。！？.!?"
    # header and footer detection
    repeat_share: float = 0.5
    repeat_floor: int = 3
    min_pages: int = 3
    # line and sentence rules
    stop_marks: tuple[str, ...] = ("。", "：", "；")
    list_heading: str = r"^[一二三四五六七八九十]+、"
    bracket_heading: str = r"^\(?[一二三四五六七八九十]+\)?"
    caption: str = rf"^(表|图|专栏) *\p{{Nd}}+"
    table_caption: str = rf"^(表|图) *\p{{Nd}}+"
    source_note: str = rf"^(数据来源|资料来源|来源|注|说明) *[：:]"
    unit_note: str = rf"^单位 *[：:]"
    table_words: tuple[str, ...] = ("表", "图", "专栏")
    note_words: tuple[str, ...] = ("来源", "注")
    narrative: str = (
        "(同比|环比|增长|下降|上升|提高|降低|增加|减少|分别|达到|为|较上年|较上季|较上月)"
    )
    clause_marks: str = "[，。；;：:]"
    end_marks: str = "[。！？；]"
    header_words: str = "单位|余额|同比|增速|项目|合计|小计|其中"
    # text without any native letter is noise only where the script is not Latin
    native_required: bool = True
    native: str = CJK
    min_sentence: int = 3


# ---- Fixed values: report layout, Chinese ---------------------------------------
ZH = TextProfile(
    heading=r"第[一二三四五]部分",
    section_keys=(
        ("第一部分", "S1"),
        ("第二部分", "S2"),
        ("第三部分", "S3"),
        ("第四部分", "S4"),
        ("第五部分", "S5"),
    ),
    toc_words=("目录", "目 录"),
)

# ---- The same rules with Latin-script markers -------------------------------------
LATIN = TextProfile(
    heading=r"Part (?:One|Two|Three)",
    section_keys=(("Part One", "S1"), ("Part Two", "S2"), ("Part Three", "S3")),
    toc_words=("Contents", "CONTENTS"),
    sentence_end=".!?",
    terminators=".!?",
    stop_marks=(".", ":", ";"),
    list_heading=r"^[IVX]+\.",
    bracket_heading=r"^\([a-z]\)",
    caption=rf"^(Table|Figure|Box) *\p{{Nd}}+",
    table_caption=rf"^(Table|Figure) *\p{{Nd}}+",
    source_note=rf"^(Source|Note) *:",
    unit_note=rf"^Unit *:",
    table_words=("Table", "Figure", "Box"),
    note_words=("Source", "Note"),
    narrative="(the|of|and|de|la|der|que)",
    clause_marks="[,.;:]",
    end_marks="[.!?;]",
    header_words="total|unit|item",
    native_required=False,
    native=r"[a-zA-Z]",
)


@dataclass(frozen=True)
class ToneProfile:
    """Word sets and windows of the lexicon scorer."""

    negators: tuple[str, ...]
    improvers: tuple[str, ...]
    bad_context: tuple[str, ...]
    volume_up: tuple[str, ...]
    price_topic: tuple[str, ...]
    price_bad: tuple[str, ...]
    price_good: tuple[str, ...]
    extra_positive: tuple[str, ...] = ()
    extra_negative: tuple[str, ...] = ()
    sheet_classes: tuple[tuple[tuple[str, ...], int], ...] = (
        (("pos", "正面"), 1),
        (("pol", "政治"), 1),
        (("neg", "负面"), -1),
    )
    header_word: str = "word"
    negation_window: int = 6
    context_window: int = 5
    improve_window: int = 3
    attenuation: float = 0.5
    max_digit_share: float = 0.5


# ---- Fixed values: lexicon scorer, Chinese ----------------------------------------
ZH_TONE = ToneProfile(
    negators=(
        "不", "没", "无", "非", "莫", "弗", "勿", "未", "否", "别",
        "不是", "不要", "没有", "难以", "未曾", "毫无", "摒弃", "休", "未必",
        "并非", "绝不", "从未", "切忌", "严禁",
    ),
    improvers=(
        "放缓", "趋缓", "缓解", "减轻", "收窄", "缩小", "企稳", "趋稳", "稳定", "温和",
        "改善", "好转", "回升", "回稳", "修复", "回暖",
    ),
    bad_context=(
        "CPI", "PPI", "物价", "通胀", "价格", "赤字", "不良", "坏账", "杠杆", "风险", "泡沫",
    ),
    volume_up=(
        "上涨", "上升", "增加", "增高", "攀升", "走高", "上行", "抬升", "反弹", "回升", "新高", "扩大",
    ),
    price_topic=(
        "CPI", "PPI", "通胀", "物价", "价格", "居民消费价格", "生产者价格", "工业品出厂价格",
    ),
    price_bad=(
        "上涨", "上升", "攀升", "走高", "抬升", "反弹", "回升", "上行", "新高", "高位", "严重",
    ),
    price_good=(
        "回落", "下降", "下行", "走低", "降低", "温和", "稳定", "企稳", "趋稳", "缓解", "趋缓", "收窄",
    ),
    extra_positive=("增长", "回升", "好转", "改善", "复苏", "繁荣", "稳健", "优化", "合理"),
    extra_negative=("衰退", "下滑", "萎缩", "低迷", "恶化", "疲软", "短缺", "不足", "困难"),
)


@dataclass(frozen=True)
class CountProfile:
    """Word sets of the older positive/negative share scorer."""

    negators: tuple[str, ...]
    stopwords: tuple[str, ...]
    reversal_phrases: tuple[str, ...]
    numeric_share: float = 0.15


# ---- Fixed values: share scorer, Chinese ------------------------------------------
ZH_COUNT = CountProfile(
    negators=(
        "不", "非", "没", "沒有", "无", "未", "莫", "勿", "难以", "并未", "不再", "无法", "未能",
    ),
    stopwords=(
        "的", "了", "在", "是", "和", "与", "对", "等", "及", "之", "其", "于", "但", "则", "所",
        "，", "。", "、", "：", "；", "！", "？", "（", "）", "“", "”", "%",
    ),
    reversal_phrases=(
        "降幅收窄", "降幅缩小", "跌幅收窄", "止跌回升",
        "由负转正", "低位回升", "触底反弹", "增速回升",
        "负增长收窄", "亏损减少", "降幅明显收窄",
    ),
)

# ---- Fixed values: stopwords used when no stopword file is given --------------------
FALLBACK_STOPWORDS = (
    "的", "了", "和", "及", "与", "在", "对", "为", "以", "于", "是", "将", "并", "等",
    "我们", "我国", "本期", "上期", "本", "该", "其", "这", "那", "而", "或", "及其",
    "以及", "其中", "有关", "进一步", "继续", "持续", "不断", "加强", "推进", "提高",
    "。", "，", "、", "；", "：", "！", "？", ".", ",", ";", ":", "!", "?", "（", "）", "(", ")",
)

# ---- Fixed values: topics and the prompt words listed for each -----------------------
TOPIC_WORDS = {
    "policy": (
        "货币政策", "流动性", "降准", "降息", "LPR", "MLF", "OMO", "再贷款", "信贷", "社融", "M2", "资金面",
    ),
    "macro": (
        "经济运行", "宏观", "基本面", "GDP", "就业", "消费", "投资", "外贸", "工业", "PMI", "景气度",
    ),
}

# ---- Fixed values: markers in indicator sheets -----------------------------------
UNIT_ROW = "单位"
SOURCE_NOTE = "数据来源"
ANNOUNCEMENT_MARKS = ("公告日期", "变动公告日期", "公布日期")
NULL_MARKS = ("--", "", "NA", "N/A")
CONTROL_KEYWORDS = {
    "shibor_1w": ("SHIBOR",),
    "usdcny_mid": ("美元兑人民币",),
    "ib_7d": ("7天回购利率",),
}


@dataclass(frozen=True)
class ToneRules:
    """Thresholds of the period roll-up."""

    taus: tuple[float, ...] = (0.50, 0.45, 0.40)
    gap: float = 0.10
    quota_share: float = 0.12
    quota_min: int = 30
    quota_max: int = 80
    confidence: float = 0.50
    topk_share: float = 0.20
    topk_min: int = 50
    topk_max: int = 200
    trim: float = 0.10
    tail: float = 0.90
    topics: tuple[str, ...] = ("policy", "macro")


TONE_RULES = ToneRules()

# Sections counted as fundamentals and as guidance; one period has its own split.
@dataclass(frozen=True)
class SectionFlags:
    real: tuple[str, ...] = ("S1", "S2", "S3", "S4")
    guidance: tuple[str, ...] = ("S5",)
    overrides: dict = field(
        default_factory=lambda: {(2002, 3): (("S1", "S2", "S3"), ("S4",))}
    )


SECTION_FLAGS = SectionFlags()
