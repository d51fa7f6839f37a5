"""Text cleaning as column expressions.

Everything stays in the JVM except `decode_entities`, whose table has more than two thousand names
and comes from the Python standard library.
"""

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
USER, URL, EMOJI = "[USER]", "[URL]", "[EMOJI]"
NAME_PATTERN = r"@[A-Za-z0-9_-]+"
MENTION_PATTERN = r"MENTION[0-9]*"
NEWLINE_MARK, TAB_MARK, HEADING_MARK = "NEWLINE_TOKEN", "TAB_TOKEN", "=="

# White space as Python sees it: the Unicode property plus the four information separators.
BLANK = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK_NOT_SPACE = BLANK.replace(r"\x{1C}-\x{20}", r"\x{1C}-\x{1F}")

# Code points with the Unicode `Emoji` property, without digits, `#` and `*`.
EMOJI_RANGES = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB
25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F
2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C
26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1 26D3-26D4 26E9-26EA
26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728 2733-2734 2744 2747
274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55
3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F1E6-1F1FF 1F201-1F202
1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0
1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570 1F573-1F57A 1F587
1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4 1F5D1-1F5D3
1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7
1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945
1F947-1F9FF 1FA70-1FAFF
"""

# Entities of the native decoder; `&amp;` comes last so that `&amp;lt;` yields `&lt;`.
COMMON_ENTITIES = [
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]
# ----------------------------------------------------------------------------------------------


def _char_class(ranges: str) -> str:
    ends = (item.split("-") for item in ranges.split())
    return "".join("-".join(rf"\x{{{end}}}" for end in pair) for pair in ends)


EMOJI_CLASS = f"[{_char_class(EMOJI_RANGES)}]"
# A long class costs one test per range and character. The intersection with the span of the class
# (Java syntax) answers almost every character after two tests.
EMOJI_PATTERN = rf"[\x{{A9}}\x{{AE}}\x{{203C}}-\x{{1FAFF}}&&{EMOJI_CLASS}]"
LINK_PATTERN = f"http[^{BLANK}]+"
ENDS_PATTERN = rf"\A[{BLANK}]+|[{BLANK}]+\z"
# Matches every run of blanks that is not already one plain space, so ordinary text is left alone.
BLANK_RUN_PATTERN = (
    rf"[\t\n\x{{0B}}\f\r\x{{1C}}\x{{1D}}\x{{1E}}\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}-\x{{3000}}&&[{BLANK_NOT_SPACE}]]"
    f"[{BLANK}]*| [{BLANK}]+"
)
LEAD_PATTERN = rf"\A[{BLANK}]*>*"


def decode_entities(text: Column) -> Column:
    """Decode every named, decimal and hexadecimal HTML entity.

    Rows without `&` reach Python as NULL and keep their text, so they cost next to nothing.
    """

    # Nested so that it is shipped by value: executors need not have this package installed.
    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        return values.map(unescape, na_action="ignore")

    return F.coalesce(decode(F.when(text.contains("&"), text)), text)


def decode_common_entities(text: Column) -> Column:
    """Decode the entities of `COMMON_ENTITIES` without leaving the JVM."""
    for entity, char in COMMON_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def mask_names(text: Column) -> Column:
    """`@name` to `[USER]`; the part of an e-mail address after its `@` counts as a name."""
    return F.regexp_replace(text, NAME_PATTERN, USER)


def mask_links(text: Column) -> Column:
    """`http` and everything up to the next blank to `[URL]`."""
    return F.regexp_replace(text, LINK_PATTERN, URL)


def strip_blanks(text: Column) -> Column:
    """Remove blanks of every kind from both ends."""
    # The trailing part starts only where a run starts, so long inner runs stay linear.
    return F.regexp_replace(text, rf"\A[{BLANK}]+|(?<![{BLANK}])[{BLANK}]+\z", "")


def mark_emoji(text: Column) -> Column:
    """Each emoji character to ` [EMOJI] `, then blanks off both ends."""
    return strip_blanks(F.regexp_replace(text, EMOJI_PATTERN, f" {EMOJI} "))


def mask_mentions(text: Column) -> Column:
    """`MENTION` and any digits after it to `[USER]`."""
    return F.regexp_replace(text, MENTION_PATTERN, USER)


def flatten_lines(text: Column) -> Column:
    """Newlines and tabs to spaces."""
    return F.translate(text, "\n\t", "  ")


def drop_quote_marks(text: Column) -> Column:
    """Remove all leading `>`."""
    return F.ltrim(text, F.lit(">"))


def collapse_blanks(text: Column) -> Column:
    """Every run of blanks to one space."""
    return F.regexp_replace(text, BLANK_RUN_PATTERN, " ")


def clean_text(text: Column, entities: str = "full") -> Column:
    """The whole cleaning in its fixed order.

    `entities` is `full` (every entity), `common` (JVM only) or `none`. Two steps are folded into
    neighbours with the same outcome: line breaks become spaces when blanks are collapsed, and the
    strip after emoji marking only matters at the front, where quote marks follow.
    """
    decoders = {"full": decode_entities, "common": decode_common_entities, "none": lambda c: c}
    text = mask_links(mask_names(decoders[entities](text)))
    text = F.regexp_replace(text, EMOJI_PATTERN, f" {EMOJI} ")
    # A mention never starts with a blank or `>`, so it may be masked before or after this.
    text = mask_mentions(F.regexp_replace(text, LEAD_PATTERN, ""))
    return F.trim(collapse_blanks(text))


def drop_corpus_marks(text: Column) -> Column:
    """Literal line and tab marks to spaces, heading marks to nothing."""
    text = F.replace(text, F.lit(NEWLINE_MARK), F.lit(" "))
    text = F.replace(text, F.lit(TAB_MARK), F.lit(" "))
    return F.replace(text, F.lit(HEADING_MARK), F.lit(""))


def only_mark(text: Column) -> Column:
    """True where the text is exactly one link mark or exactly one emoji mark."""
    return text.isin(URL, EMOJI)
