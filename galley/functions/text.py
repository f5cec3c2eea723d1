"""Text expressions. Every function takes and returns Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as scripts of the content team count it.
WHITE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Notation that differs between a manuscript and its spoken copy.
SOURCE_TAG = r"\[출처[^\]]*\]"
CODE_SPAN = r"`[^`]*`"
EMPHASIS = "*_~"
QUOTES = "「」『』«»“”‘’\"'`"
PUNCTUATION = ".,!?·—–-…"

# What may follow the last word of a sentence.
CLOSING = ".!?…\"'”’)]"

# Marks left where a person still has to fill something in. The look-arounds are the word bounds of
# the rule: \\b of Java takes other characters for parts of a word.
SCREEN_PLACEHOLDER = r"__+%?|<[A-Z][A-Z0-9_]{2,}>|(?<!\w)(?:TODO|FIXME)(?!\w)"
FORM_PLACEHOLDER = r"20\d\s*년\s+월|\(\s*우편\s*:\s+\)|년\s+월\s+일"

# Digits and Korean number words.
NUMBER_WORDS = (
    "[0-9]|퍼센트|포인트|하나|둘|셋|넷|다섯|여섯|일곱|여덟|아홉|열"
    "|스물|서른|마흔|쉰|예순|일흔|여든|아흔"
)

# The look-behind keeps the search from starting inside a word.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
PHONE = r"\+?\d{1,3}[ \-]\d{2,4}[ \-]\d{3,4}(?:[ \-]\d{2,4})?"
PRIVATE = {"email": EMAIL, "phone": PHONE}

# Symbols a plain-prose text should not carry.
PROSE_SYMBOLS = r"[→①-⑳]"
HANGUL = r"[가-힣]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once.

    A Column used twice is computed twice, and inside a lambda once per element.
    """
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE))


def _blanked(c: Column, blank: str, drop: str = "") -> Column:
    """Characters to blanks or to nothing, runs of blanks to one, none at the ends."""
    single = F.translate(c, blank + drop, " " * len(blank))
    return F.trim(F.regexp_replace(single, " {2,}", " "))


def collapse(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return _blanked(c, WHITE)


def squeeze(c: Column) -> Column:
    """The text without any white space."""
    return F.translate(c, WHITE, "")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: a symbol outside the basic plane counts two."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def preview(c: Column, n: int = 80) -> Column:
    """Line breaks become one blank, then the first n characters."""
    return F.substring(F.regexp_replace(c, r"\n+", " "), 1, n)


def normalize_copy(c: Column) -> Column:
    """Drop differences of notation and keep differences of wording."""

    def without(t: Column, sign: str, pattern: str) -> Column:
        return F.when(t.contains(sign), F.regexp_replace(t, pattern, " ")).otherwise(t)

    untagged = bind(c, lambda t: without(t, "[", SOURCE_TAG))
    words = bind(untagged, lambda t: without(t, "`", CODE_SPAN))
    return _blanked(words, WHITE + PUNCTUATION, EMPHASIS + QUOTES)


def has_number(c: Column) -> Column:
    return c.rlike(NUMBER_WORDS)


def lines(c: Column) -> Column:
    return F.split(c, r"\r?\n")


def sentences(c: Column) -> Column:
    """Pieces that end after . ! ? or at a line end; blank pieces are dropped."""
    marked = F.regexp_replace(c, r"([.!?]+)", "$1\n")
    pieces = F.transform(F.split(marked, r"[\r\n]+"), strip)
    return F.filter(pieces, lambda s: s != "")


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines; blank blocks are dropped."""
    blocks = F.split(c, r"\r?\n[ \t]*\r?\n\s*")
    return F.filter(F.transform(blocks, strip), lambda p: p != "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    pieces = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.filter(pieces, lambda t: t != "")


def literal_count(c: Column, needle: Column) -> Column:
    """How often needle occurs, counted without overlap."""
    removed = F.length(c) - F.length(F.replace(c, needle, F.lit("")))
    return (removed / F.length(needle)).cast("int")


def digits_per_100(c: Column) -> Column:
    digits = F.regexp_count(c, F.lit(r"[0-9]"))
    return F.when(F.length(c) > 0, digits * 100.0 / F.length(c))


def hangul_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(HANGUL)) / F.length(c))


def mask(c: Column, patterns: dict[str, str] | None = None) -> Column:
    """Put the kind in place of each matched span, and nothing else."""
    for kind, pattern in (patterns or PRIVATE).items():
        c = F.regexp_replace(c, pattern, f"[{kind}]")
    return c


def unescape(c: Column) -> Column:
    """Markup entities back to characters, the ampersand last."""
    for entity, char in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def escape(c: Column) -> Column:
    """Characters that markup reserves become entities, the ampersand first."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def is_absolute_url(c: Column) -> Column:
    return c.rlike(r"(?i)^https?:")


def minutes_text(seconds: Column) -> Column:
    """Whole minutes and the rest of the seconds with one decimal."""
    whole = F.floor(seconds / 60)
    return F.format_string("%dm %.1fs", whole, (seconds - whole * 60).cast("double"))


# Fixed value: a quote placed on a picture, as [!]text@x,y in percent.
PLACED_QUOTE = r"^(!?)(.*)@(\d+),(\d+)$"


def placed_quote(c: Column) -> Column:
    """Struct (text, x, y, accent) of a placed quote, NULL when it is none."""
    return F.when(
        c.rlike(PLACED_QUOTE),
        F.struct(
            F.regexp_extract(c, PLACED_QUOTE, 2).alias("text"),
            F.regexp_extract(c, PLACED_QUOTE, 3).cast("int").alias("x"),
            F.regexp_extract(c, PLACED_QUOTE, 4).cast("int").alias("y"),
            (F.regexp_extract(c, PLACED_QUOTE, 1) == "!").alias("accent"),
        ),
    )
