import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions import text as T

CASES = [
    ("a &amp; b &#39;c&#39;", "a & b 'c'"),
    ("hi @a-b_1!", "hi [USER]!"),
    ("x.19@mail5.example.com", "x.19[USER].example.com"),
    ("see http://x.y/@z now", "see [URL] now"),
    ("ok\U0001f600no", "ok [EMOJI] no"),
    ("MENTION3851 said", "[USER] said"),
    ("MENTION said", "[USER] said"),
    ("a\n\tb", "a b"),
    ("\n>> hello", "hello"),
    ("> > hello", "> hello"),
    ("a  b", "a b"),
    ("", ""),
    (" \t\n\x1c　 ", ""),
    ("\U0001f1e9\U0001f1ea", "[EMOJI] [EMOJI]"),
    ("© 2020", "[EMOJI] 2020"),
    ("#1 * 2", "#1 * 2"),
    ("&amp;lt;b&gt;", "&lt;b>"),
    ("&eacute;t&#233;&nbsp;&nbsp;x", "été x"),
    ("\U0001f600 > quoted", "[EMOJI] > quoted"),
    ("&gt; quoted", "quoted"),
    (None, None),
]


def run(spark, values, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [row[1] for row in df.select("i", function(F.col("text"))).orderBy("i").collect()]


def test_clean_text_cases(spark):
    assert run(spark, [case for case, _ in CASES], T.clean_text) == [want for _, want in CASES]


def test_steps(spark):
    assert run(spark, ["\t a\U0001f600 "], T.mark_emoji) == ["a [EMOJI]"]
    assert run(spark, ["a\nb\tc"], T.flatten_lines) == ["a b c"]
    assert run(spark, [">>a>", "> >b", None], T.drop_quote_marks) == ["a>", " >b", None]
    assert run(spark, ["a \n b", "\x1fa  "], T.collapse_blanks) == ["a b", " a "]
    assert run(spark, ["\u2003 a b \x85"], T.strip_blanks) == ["a b"]
    assert run(spark, ["aNEWLINE_TOKENbTAB_TOKENc==d="], T.drop_corpus_marks) == ["a b cd="]
    assert run(spark, ["[URL]", "[EMOJI]", "[URL] [EMOJI]", "x"], T.only_mark) == [True, True, False, False]


def test_native_entities_agree_with_full_decoder(spark):
    values = ["&lt;&gt;&quot;&#39;&copy;&middot;&amp;", "&amp;amp;", "no entity"]
    assert run(spark, values, T.decode_common_entities) == run(spark, values, T.decode_entities)


def test_every_blank_of_python_is_a_blank(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    others = [chr(c) for c in (0x200B, 0x180E, 0xFEFF, 0x61)]
    assert run(spark, blanks + others, T.strip_blanks) == [""] * len(blanks) + others


PIECES = st.sampled_from(
    ["@", "@ab", "http", "https://x", "MENTION", "12", ">", "> ", " ", "\n", "\t", "\x1c", "\xa0", "　", "&amp;",
     "&#62;", "&gt", "\U0001f600", "❤", "a", "é", "word", "[URL]", "-", "_"]
)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=20, max_size=40))
def test_what_clean_text_leaves(spark, values):
    """Whatever the pieces, clean text has no marks to replace, no blanks at its ends and no two in a row."""
    emoji = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), T.EMOJI_CLASS))
    cleaned = run(spark, values, T.clean_text)
    for value, text in zip(values, cleaned, strict=True):
        assert not re.search(r"@[A-Za-z0-9_-]|http\S|MENTION|[\n\t\x1c\xa0\u3000]|  ", text), ascii(value)
        assert text == text.strip() and not emoji.search(text)
    # Without entities and quote marks there is nothing left to do for a second pass.
    plain = [text for text in cleaned if "&" not in text and ">" not in text]
    assert run(spark, plain, T.clean_text) == plain


def test_unknown_entities_option():
    with pytest.raises(KeyError):
        T.clean_text(F.lit("a"), entities="some")
