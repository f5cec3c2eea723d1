"""Word lists of the content rules. All entries are fixed values."""

from __future__ import annotations

# Signs that a quoted line is a direction to the crew, not spoken text.
DIRECTIVES = (
    "🔴|⚠️|🔑|🎙|📐|촬영|금지|말 것|하지 마|하지 말|CTA|주의"
    "|규칙|확정|개정|삭제됨|되살리지|출처 표기|시그니처|클로징 시그"
)

# Headings that only mark a section of the running order.
SECTION_HEADING = r"[①②③④⑤⑥⑦⑧⑨]|\d+\s*[~-]\s*\d+\s*분|^#{1,2}\s"

# Phrases by the rule that forbids them.
FORBIDDEN_WORDS = ("혁신", "압도", "최초", "완벽", "차세대", "새로운")
CLOSING_SIGNALS = ("오늘은 여기까지", "정리하자면", "다음 영상에서 뵙겠습니다")
CLICHE_BRIDGES = ("다음 영상에서 알려드릴게요", "다음 편에서 만나요", "구독하고 기다려주세요")
SPOILERS = r"했습니다|됐습니다|정답은|이유는.*때문|결국.*였다|답입니다"
FUTURE_TENSE = r"할 예정|계획"
VERSION_SUFFIX = r"_v\d+|_최종"

BANNED = {
    "forbidden_word": "|".join(FORBIDDEN_WORDS),
    "closing_signal": "|".join(CLOSING_SIGNALS),
    "cliche_bridge": "|".join(CLICHE_BRIDGES),
    "spoiler": SPOILERS,
    "future_tense": FUTURE_TENSE,
    "version_suffix": VERSION_SUFFIX,
    "closing_question": r"\?\s*$",
}

# Words that show an intent to buy.
COMMERCIAL_MARKERS = ("가격", "비용", "추천", "근처")

# Final endings of Korean sentences, each a kind of its own; the longest one a sentence closes with counts.
# The six published kinds come first, then further common ones, then the four bare endings.
ENDINGS = (
    "니다", "한다", "이다", "었다", "였다", "있다",
    "했다", "된다", "없다", "겠다", "세요", "네요", "니까",
    "다", "요", "까", "죠",
)

# The turn of phrase "not A but B".
CONTRAST = r"(?:이|가) 아니라"

# Limits named in calls for proposals; only candidates until a person confirms.
LIMIT_PATTERNS = {
    "deadline": r"(20\d{2}\.\s*\d{1,2}\.\s*\d{1,2}[^\n]{0,8}?\d{1,2}시)",
    "font_size": r"(\d{1,2}(?:\.\d)?)\s*pt",
    "page_cap": r"(\d+)\s*(?:페이지|쪽)\s*이내",
    "min_length": r"([\d,]+)\s*자\s*이상",
}

# Character ranges per kind of page.
PAGE_LENGTHS = {
    "요약": (400, 600),
    "문제인식": (800, 1_200),
    "실현가능성": (1_000, 1_500),
    "시장·경쟁": (700, 1_000),
    "성장전략": (700, 1_200),
    "팀·역량": (500, 800),
    "이미지 중심 페이지": (200, 400),
}

# Characters and pages of a whole plan.
PLAN_CHARS = (22_000, 35_000)
PLAN_PAGES = (18, 40)

# Characters per line of thumbnail copy.
COPY_LENGTHS = {"main": (9, 13), "sub": (14, 22)}

# Published limits of the text-style axes: (axis, comparator, bound, severity).
STYLE_AXES = (
    ("symbols", "at_most", 0.0, "violation"),
    ("ending_ratio", "at_least", 58.0, "violation"),
    ("narrative_ratio", "at_least", 25.0, "warning"),
    ("digits_per_100", "at_most", 4.5, "warning"),
    ("ending_variety", "at_least", 3.0, "warning"),
    ("top_ending_share", "at_most", 75.0, "warning"),
    ("contrast_per_400", "at_most", 1.0, "warning"),
)
# Profiles and whether their limits are still provisional.
STYLE_PROFILES = {
    "business_plan": False,
    "blog_homepage": True,
    "blog_naver": True,
    "report": True,
    "cardnews": True,
}
# The two axes that hold for a profile without measured limits.
CORE_AXES = ("symbols", "ending_ratio")
