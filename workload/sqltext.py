"""Text expressions as SQL, written once for the queries on texts."""

from __future__ import annotations

# The white space class of the content rules.
W = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{W}+', ' ', 'g'), ' ')"


def squeeze(c: str) -> str:
    return f"regexp_replace({c}, '{W}+', '', 'g')"


def lines(c: str) -> str:
    return rf"string_split_regex({c}, '\r?\n')"


def sentences(c: str) -> str:
    marked = f"regexp_replace({c}, '([.!?]+)', '\\1' || chr(10), 'g')"
    pieces = rf"list_transform(string_split_regex({marked}, '[\r\n]+'), lambda s: {strip('s')})"
    return f"list_filter({pieces}, lambda s: s <> '')"


def paragraphs(c: str) -> str:
    blocks = rf"string_split_regex({c}, '\r?\n[ \t]*\r?\n\s*')"
    return f"list_filter(list_transform({blocks}, lambda p: {strip('p')}), lambda p: p <> '')"


def tokens(c: str) -> str:
    return rf"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def normalize_copy(c: str) -> str:
    steps = [
        (r"\[출처[^\]]*\]", " "),
        (r"`[^`]*`", " "),
        (r"[*_~]", ""),
        (r"""[「」『』«»“”‘’"''`]""", ""),
        (r"[.,!?·—–\-…]", " "),
    ]
    for pattern, new in steps:
        c = f"regexp_replace({c}, '{pattern}', '{new}', 'g')"
    return collapse(c)


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'))"
