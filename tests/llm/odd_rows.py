"""Rows with every awkward case."""

LONG = " ".join(f"word{i % 977} the" for i in range(30_000))

# Ids and texts with every awkward case: null id, null and empty texts, blanks only, very long, repeated rows, one id with
# two texts, and ties.
ROWS = [
    (1, "Plain text about nothing in particular, repeated often enough to count."),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, LONG),
    (6, "same row"),
    (6, "same row"),
    (7, "one id"),
    (7, "two texts"),
    (None, "no id at all"),
    (None, None),
    (8, "idiot! \x00 \x01 mail a.b@c.example.com_x@d.example.org 1.2.3.4.5.6.7.8 +1 (555) 010-9999"),
    (9, "é😀 ÀÉ 中文 <|endoftext|> </s>[INST] ok [/INST]"),
    (10, LONG),
]
CLASHING = (
    "text_key key score best total n passages print cell root start end kind value spans anchor doc words host rate "
    "base count n_words row at fingerprint"
).split()
