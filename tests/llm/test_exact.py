"""Operators against brute force on small tables."""

import collections
import hashlib
import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from llm import bpe, chat, components, decontaminate, grades, html, pii, repeats, simhash, toxicity, words
from llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Words and hashes


def test_words_and_hashes():

    texts = ["a b a b a b", "", "Ab\x00c\x0bé  ab", " a b "]
    hashes, n = collections.defaultdict(set), 0
    for _, _, data, offsets in words.blocks(pa.array(texts), most=4):
        found = words.split(data, offsets, words.SPACED)
        for word, value in zip(found.words(), words.word_hashes(found).tolist(), strict=True):
            hashes[word].add(value)
            n += 1
    assert n == 11 and all(len(x) == 1 for x in hashes.values()) and len({*map(min, hashes.values())}) == len(hashes)
    values = np.array([5, 3, 9, 1, 7, 7, 2], np.uint64)
    for width in range(1, 8):
        want = [int(min(values[i : i + width])) for i in range(len(values) - width + 1)]
        assert words.sliding_min(values, width).tolist() == want


# BPE


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(bpe.vocabulary_path())


def test_bpe_on_every_code_point(tokenizer):
    own = bpe.load(bpe.vocabulary_path())
    points = [*range(0xD800), *range(0xE000, 0x20000), *range(0x20000, 0x110000, 4099)]
    texts = [f"{chr(c)}A{chr(c)}{chr(c)} {chr(c)}" for c in points]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert list(own.encode(text)) == want.ids, ascii(text)


def test_bpe_on_documents(documents, texts, tokenizer):
    for row in bpe.encode_documents(documents, bpe.vocabulary_path()).collect():
        want = tokenizer.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.ids == want
        assert row.decoded == tokenizer.decode(want, skip_special_tokens=False)


def test_bpe_digests(spark, texts, tokenizer):
    for row in QUERIES["op2_bpe"](spark, FOLDER).collect():
        ids = tokenizer.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == sha(tokenizer.decode(ids, skip_special_tokens=False))


# SimHash


def slow_fingerprint(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not found:
        return 0
    runs = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(prints):
    """Smallest member that links of at most two bits reach, for distinct fingerprints."""
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def test_near_duplicates(spark, texts):
    prints = {i: slow_fingerprint(text) for i, text in texts.items()}
    roots = slow_roots(set(prints.values()))
    least = {}
    for i, p in sorted(prints.items()):
        least.setdefault(roots[p], i)
    for row in QUERIES["op3_simhash"](spark, FOLDER).collect():
        assert row.fingerprint == f"{prints[row.doc_id]:016x}"
        assert row.component_id == least[roots[prints[row.doc_id]]]


def test_links_in_crowded_and_thin_cells(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(600)}
    for _ in range(40):  # chains of two bits a step, and pairs that are three bits apart
        at = rng.getrandbits(64)
        for _ in range(6):
            prints.add(at)
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        prints |= {at, at ^ 0b111}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = components.components(simhash.links(spark.createDataFrame(signed, "print bigint"))).collect()
    root = {row.node % (1 << 64): row.root % (1 << 64) for row in found}
    groups, want = collections.defaultdict(set), collections.defaultdict(set)
    for p, r in slow_roots(prints).items():
        want[r].add(p)
        groups[root.get(p, p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(5, 5), (None, 7), (1000, 1001), (1001, 1000)]
    found = components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {(r.node, r.root) for r in found} == {(i, 0) for i in range(1, 301)} | {(1001, 1000)}


# Repeated passages


def slow_repeats(texts, window=50):
    found = {i: WORD.findall(text or "") for i, text in texts.items()}
    first = {}
    for i in sorted(found):
        for k in range(len(found[i]) - window + 1):
            first.setdefault(tuple(found[i][k : k + window]), i)
    out = {}
    for i, own in found.items():
        stay = [True] * len(own)
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                stay[k : k + window] = [False] * window
        out[i] = (len(own), stay.count(False), sha(" ".join(w for w, s in zip(own, stay, strict=True) if s)))
    return out


@pytest.mark.parametrize("group", [2, repeats.GROUP])
def test_repeats(spark, documents, texts, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # 2: nearly every anchor counts as crowded
    want = slow_repeats(texts)
    got = repeats.without_repeats(documents)[0].collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    assert sum(n for _, n, _ in want.values()) > 0


def test_repeats_planted(spark):
    rng = random.Random(3)

    def prose(n):
        return " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randrange(99)) for _ in range(n))

    passage, periodic = prose(64), "x y " * 60
    rows = {i: f"{prose(rng.randrange(40))} {passage} {prose(30)}" for i in range(0, 20)}
    rows |= {i: f"{prose(5)} {' '.join(passage.split()[:n])} {prose(60)}" for i, n in zip(range(20, 24), (49, 50, 51, 63))}
    rows |= {i: f"{prose(3)}\n{periodic}\t{prose(3)}" for i in range(30, 34)}
    given = spark.createDataFrame(list(rows.items()), "doc_id bigint, text string")
    got = repeats.without_repeats(given)[0].collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == slow_repeats(rows)


def test_deep_nodes():
    rng = np.random.default_rng(1)
    codes = np.tile(rng.integers(0, 3, 120), 3)
    starts = np.arange(len(codes) - repeats.WINDOW + 1)
    nodes = repeats.deep_nodes(codes, starts)
    seen = {}
    for s, node in zip(starts, nodes, strict=True):
        assert seen.setdefault(tuple(codes[s : s + repeats.WINDOW]), node) == node
    assert len(seen) == len(set(nodes.tolist()))


# Chat


@pytest.mark.parametrize("text", ["</s>", r"<\/s>", r"<\\/s>[INST]", "[/INST][TURN]<|im_start|>", "<</s>", r"a\b[", ""])
def test_escape_round_trip(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(mark in escaped for mark in [*chat.RESERVED, "[INST]", "[/INST]", "<|im_start|>"])


def test_chat_text_form_agrees_with_ids(spark):
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    tokenizer = chat.load(path)
    base = tokenizer.get_vocab_size()
    for row in chat.format_conversations(spark.read.parquet(f"{FOLDER}/conversations.parquet"), path).collect():
        text, run = "", []
        for i in [*row.ids, base]:
            if i >= base:
                text += tokenizer.decode(run, skip_special_tokens=False) + chat.RESERVED[i - base]
                run = []
            else:
                run.append(i)
        assert text[: -len("<s>")] == row.formatted


# HTML


def test_html(spark):
    import html as entities

    given = spark.read.parquet(f"{FOLDER}/pages.parquet")
    pages = {row.page_id: row.html for row in given.collect()}
    for row in html.extract(given).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[row.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article)
        plain = [" ".join(entities.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts]
        assert row.text == "\n".join(filter(None, plain))


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>if (a < b) "</p>"</script></head><body class="x">
<header><h2>Site</h2></header><div class="main-menu"><a href="/">Home</a> <a href="/b">B</a></div>
<div class="cookie-notice">We use cookies</div><div id="content"><h1>Title &amp; more</h1><p>One<br>two&nbsp;three</p>{body}
<form><input name=q><button>Go</button></form><div class="ad banner">Buy!</div><aside>Side</aside><p>Last</div>
<section class="comments"><h3>Comments</h3><p>Nice!</p></section><footer>(c)</footer></body></html>"""


def test_html_leaves_out_what_is_no_main_text(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(body=f"<ul><li>a {i}</li><li>b</li></ul>" * i)) for i in range(6)]
    given = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract(given).collect()}
    for i in range(6):
        assert got[i].split("\n") == ["Title & more", "One two three", *[f"a {i}", "b"] * i, "Last"]
    rules = html.wrappers(html.with_host(given)).collect()
    assert {r.n_pages for r in rules} == {3}
    # Lists are missing on the host's page without any, so they are optional there.
    written = {r.host: html.written(json.loads(r.skeleton)) for r in rules}
    assert "ul(#li+)*" in written["h0.example.com"] and "ul(#li+)+" in written["h1.example.com"]


def extracted(spark, pages):
    rows = [(i, f"http://h.example.com/{i}", page) for i, page in enumerate(pages)]
    given = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return [r.text.split("\n") for r in html.extract(given).orderBy("page_id").collect()]


def test_html_wrapper_tells_the_frame_of_a_host_without_telling_names(spark):
    page = (
        "<body><div class=c1><p>Home of all things</div>{advert}<div class=c2><h1>Title {i}</h1><p>Text {i}<p>More {i}</div>"
        "<div class=c3><p>We use crumbs</div><div class=c4>Imprint, all rights kept</div></body>"
    )
    pages = [page.format(i=i, advert="<div class=c5><p>Buy now</p></div>" * (i % 2)) for i in range(12)]
    assert extracted(spark, pages) == [[f"Title {i}", f"Text {i}", f"More {i}"] for i in range(12)]
    # Copies of one page are no frame.
    assert extracted(spark, pages[:1] * 12)[0][1] == "Title 0"


@pytest.mark.parametrize(
    "start,end",
    [
        ("<body class='has-sidebar'>", ""),
        ("<body id=no-sidebar><div class='content-sidebar-wrap'>", "</div>"),
        ("<body><div class='page-with-comments'><form action=/>", "</form></div>"),
    ],
)
def test_html_words_of_a_class_lose_no_article_and_hold_for_leaves(spark, start, end):
    page = (
        f"{start}<article class='post comments-open'><h1>Title</h1><p data-id=ad title='hidden words'>Some long text of it</p>"
        "<p class=advert>Buy</p><ul><li class=comment><div class=c1>Nice</div></li><li>One</ul><p hidden>Not seen</p>"
        f"<table><tr><td>Cell<td class='ad'><p>Buy</p><tr><td>Last</table></article><div class=comments>Great</div>{end}"
    )
    assert extracted(spark, [page]) == [["Title", "Some long text of it", "One", "Cell", "Last"]]


def test_html_takes_all_main_containers_but_no_teaser_alone(spark):
    long = "<p>" + "Long text. " * 30 + "</p>"
    text = ("Long text. " * 30).strip()
    for one, two in (
        ("<div class=entry-header><h1>Title</h1></div>", "<div class=entry-content>{}</div>"),
        ("<article id=intro>Title</article>", "<article id=part>{}</article>"),
        ("<div class=text>Title</div>", "<div class='content more'>{}</div>"),
        ("<div class=text>Title</div>", "<div class=c7>{}</div>"),
    ):
        assert extracted(spark, [f"<body>{one}{two.format(long)}<footer>f</footer>"]) == [["Title", text]]


def test_html_keeps_what_recurs_inside_an_article(spark):
    """A sentence that every article has, in a container without a telling name; the frame around it still goes."""
    page = "<body><div class=c1><p>Home of things</div><div class=c2><p>Own text number {i}, long enough<p>Always the same</div></body>"
    got = extracted(spark, [page.format(i=i) for i in range(20)])
    assert got == [[f"Own text number {i}, long enough", "Always the same"] for i in range(20)]


@pytest.mark.parametrize("name", ["id={}", "id=p-{}", "class={}", "class='a x-{}'"])
def test_html_wrapper_does_not_grow_with_pages(spark, name):
    """Ids and classes that each element has for itself."""
    sizes = []
    for n in (8, 64):
        pages = []
        for i in range(n):
            drawn = [f"{hashlib.md5(f"{i} {k}".encode()).hexdigest()[:6]}7a7" for k in range(10)]
            pages.append("<body>" + "".join(f"<p {name.format(d)}>text {d}</p>" for d in drawn) + "</body>")
        rows = [(i, f"http://h.example.com/{i}", page) for i, page in enumerate(pages)]
        given = spark.createDataFrame(rows, "page_id bigint, url string, html string")
        (rule,) = html.wrappers(html.with_host(given)).collect()
        sizes.append(len(rule.skeleton))
        texts = {r.page_id: r.text for r in html.extract(given).collect()}
        assert all(texts[i].count("text ") == 10 for i in range(n))
    assert sizes[1] < 2 * sizes[0]


def test_html_self_closed_and_unclosed_elements_drop_nothing_else():
    for start in ("<svg/>", "<math />", "<svg class=a/>", "<object data=x>", "<canvas>", "<svg><path/></svg>"):
        assert [b.text() for b in html.parse(f"<p>a</p>{start}<p>b</p>")[0]] == ["a", "b"]


def test_html_aligns_in_parts_of_bounded_size(spark, monkeypatch):
    from pyspark.sql import functions as F

    tags = ["p", "ul", "dl", "ol", "table", "pre", "h2"]
    rows = [
        ("h", json.dumps([["body", True, False, [[t, True, False, []] for b, t in enumerate(tags) if i >> b & 1]]]), 2)
        for i in range(128)
    ]
    given = spark.createDataFrame(rows, "host string, skeleton string, n bigint")
    monkeypatch.setattr(html, "PART", 10)
    (row,) = html.aligned(given).collect()
    assert row.n == 256 and all(tag in row.skeleton for tag in tags)
    assert html.aligned(given.filter(F.lit(False))).count() == 0


# Personal data

RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= sum(map(str.isdigit, v)) <= 19 and luhn(v)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= sum(map(str.isdigit, v)) <= 15),
}


def luhn(value):
    digits = [int(c) for c in value if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def base_spans(text):
    return [
        (number, m.start(), m.end())
        for number, (pattern, valid) in enumerate(RULES.values())
        for m in re.finditer(pattern, text)
        if valid(m[0])
    ]


def odd_numbers():
    rng = random.Random(11)
    alphabet = ["1", "4", "0", "4111111111111111", "4111 1111 1111 1111", " ", "-", ".", "+", "@", "a", "_", "é", "255", "256", "(", ")", "\n"]
    return {i: "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for i in range(400)}


def test_base_spans(spark, documents, texts):
    given = {**texts, **{1_000_000 + i: text for i, text in odd_numbers().items()}}
    rows = spark.createDataFrame(list(given.items()), "doc_id bigint, text string")
    for row in pii.personal_data(rows).collect():
        assert [tuple(s) for s in row.base] == base_spans(given[row.doc_id])
        assert {tuple(s) for s in row.base} <= {tuple(s) for s in row.spans}


def test_patterns_find_unseen_identifiers(spark):
    seen = [(i, f"Please call +1 (555) 010-{1000 + i} or write to the office") for i in range(40)]
    unseen = [(100 + i, f"please call 030 11{i}2 now, or call 555-010-{2000 + i} then") for i in range(3)]
    shaped = [(200 + i, f"Please call +4 (030) 555-{3000 + i} for the year {1990 + i}") for i in range(5)]
    plus = [(300, "please call +7 (999) 123-45678901234567 today, the year 1999")]
    given = spark.createDataFrame([*seen, *unseen, *shaped, *plus], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.personal_data(given).collect()}
    assert all(len(got[i].spans) == 1 for i, _ in seen + shaped)
    assert not any("199" in t[s.start : s.end] for i, t in [*shaped, *plus] for s in got[i].spans)

    cards = [(i, f"card no 4{i:03d}000000000000 x") for i in range(2000)]
    valid = [(i, t) for i, t in cards if base_spans(t)][:60]
    wrong = [(i, t) for i, t in cards if not base_spans(t)][:8]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(valid + wrong, "doc_id bigint, text string")).collect()}
    for i, text in valid + wrong:
        (span,) = got[i].spans
        assert (pii.KINDS[span.kind], text[span.start : span.end]) == ("card", text.split()[2])
        assert len(got[i].base) == (i in dict(valid))


def test_contexts_find_unseen_phones_and_mails(spark):
    texts = [f"Please call +1 (555) 010-{1000 + i} or write to the office" for i in range(40)]
    texts += [f"mail to: user{i}@h{i}.example.com for more" for i in range(40)]
    unseen = {
        100: ("please call 030 1112222 now, the year 1999", "phone", "030 1112222"),
        101: ("or call 555 123 4567", "phone", "555 123 4567"),
        102: ("call (030) 111-2223!", "phone", "(030) 111-2223"),
        103: ("mail to: jürgen@exämple for more", "email", "jürgen@exämple"),
        105: ("call 5551234567 400000000000000123", "phone", "5551234567"),
        104: ("it is 06151/77 88 99 or write", "phone", "06151/77 88 99"),
    }
    # Phones that "call" finds make "ring" a pattern of its own, without any seed.
    more = {}
    for i in range(5):
        more[200 + i] = (f"call 040 22233{i} x{i} y", "phone", f"040 22233{i}")
        more[210 + i] = (f"ring 040 22233{i} z{i} y", "phone", f"040 22233{i}")
    more[220] = ("ring 040 999888 w y", "phone", "040 999888")
    none = [(300, "sum 123456789 of"), (301, "in 1999 or write to us")]
    wanted = {**unseen, **more}
    rows = [*enumerate(texts), *[(i, text) for i, (text, *_) in wanted.items()], *none]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, (text, kind, value) in wanted.items():
        assert [(pii.KINDS[s.kind], text[s.start : s.end]) for s in got[i].spans] == [(kind, value)], text
        assert not got[i].base
    assert not any(got[i].spans for i, _ in none)


def test_masking(spark):
    from pyspark.sql import functions as F

    text = "é a@b.example.com, 1.2.3.4!"
    given = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id bigint, text string")
    found = pii.personal_data(given).select("doc_id", "spans")
    rows = given.join(found, "doc_id").select("doc_id", pii.masked(F.col("text"), F.col("spans")).alias("text"))
    assert {r.doc_id: r.text for r in rows.collect()} == {1: "é [EMAIL], [IP]!", 2: "clean", 3: None}


def test_masking_leaves_no_part_of_overlapping_spans(spark):
    from pyspark.sql import functions as F

    cases = {
        "write to +491234567@example.com now": "write to [EMAIL] now",
        "1.2.3.4@host.example.com ok": "[EMAIL] ok",
        "é 4111111111111111@a.example.com 1.2.3.4": "é [EMAIL] [IP]",
        "a@b.example.com_c@d.example.com": "[EMAIL][EMAIL]",  # the second begins where the first ends
        "+49 123 456 789 1.2.3.4 end": "[PHONE] end",
    }
    given = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    found = pii.personal_data(given).select("doc_id", "spans")
    rows = given.join(found, "doc_id").select("text", pii.masked(F.col("text"), F.col("spans")).alias("out"))
    assert {r.text: r.out for r in rows.collect()} == cases

    def union(text, spans):
        """Marks every covered character, then replaces runs; a run is cut where a span ends and none goes on."""
        out, at = [], 0
        for start, end, kind in sorted(spans):
            if at < start or not out or start >= at:
                out += [text[at:start], [start, end, kind, end - start]] if not out else [text[out[-1][1] : start], [start, end, kind, end - start]]
            else:
                last = out[-1]
                if end - start > last[3]:
                    last[2:] = [kind, end - start]
                last[1] = max(last[1], end)
            at = out[-1][1]
        joined = "".join(x if isinstance(x, str) else f"[{pii.KINDS[x[2]].upper()}]" for x in out)
        return joined + text[at:]

    draw = random.Random(5)
    tried = []
    for i in range(200):
        text = "".join(draw.choice("abé中") for _ in range(draw.randrange(1, 30)))
        starts = [draw.randrange(len(text)) for _ in range(draw.randrange(6))]
        tried.append((i, text, [(s, draw.randrange(s + 1, len(text) + 1), draw.randrange(4)) for s in starts]))
    kind = "doc_id bigint, text string, spans array<struct<start:bigint,end:bigint,kind:int>>"
    rows = spark.createDataFrame(tried, kind).select("doc_id", pii.masked(F.col("text"), F.col("spans")).alias("out"))
    assert {r.doc_id: r.out for r in rows.collect()} == {i: union(text, spans) for i, text, spans in tried}


def test_rows_without_quality_have_no_grade(spark):
    rows = [(None, None), (None, 1), (None, 0), (0, None), (0, 1), (1, None), (1, 0), (1, 1)]
    given = spark.createDataFrame(rows, "quality int, toxic int")
    assert [r[0] for r in given.select(grades.rating()).collect()] == [None, None, None, 0, 0, 2, 2, 1]


# Decontamination beyond the SQL check of the query


def test_bitmap(spark):
    prints = [0, 1, -1, 123456789123, (1 << 24) - 1, -(1 << 63)]
    bits = decontaminate.bitmap(spark.createDataFrame([(p,) for p in prints], "print bigint"))
    want = {p & ((1 << 24) - 1) for p in prints}
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == want


def test_every_long_shared_span_is_hit(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 4, 9, 10, 11, 40])))) for i in range(30)]
    rows = []
    for i in range(60):
        own = rng.choices(vocabulary, k=rng.randrange(0, 60))
        if i % 2:
            other = rng.choice(items)[1].split()
            at = rng.randrange(len(other))
            own[5:5] = [w.upper() for w in other[at : at + rng.randrange(1, 30)]]
        rows.append((i, ", ".join(own)))
    found = decontaminate.contamination(
        spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    ).collect()
    text = dict(rows)
    for row in found:
        own = re.findall(r"[a-z0-9]+", text[row.doc_id].lower())
        hit, hit_items = set(), set()
        for item, item_text in items:
            other = item_text.split()
            n = min(10, len(other))
            windows = {tuple(other[k : k + n]) for k in range(len(other) - n + 1)}
            places = [k for k in range(len(own) - n + 1) if tuple(own[k : k + n]) in windows]
            hit |= {j for k in places for j in range(k, k + n)}
            hit_items |= {str(item)} if places else set()
        assert (row.n_words, row.n_hit, row.items) == (len(own), len(hit), sorted(hit_items))


# Learned scores


def slow_segments(scores):
    """All maximal scoring segments, by recursion on the best one."""

    def best(a, b):
        top = (0.0, None)
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > top[0] + 1e-12:
                    top = (total, (i, j))
        if top[1] is None:
            return []
        i, j = top[1]
        return [*best(a, i), (i, j, round(top[0], 6)), *best(j + 1, b)]

    return best(0, len(scores))


def test_segments():
    rng = random.Random(4)
    for _ in range(200):
        places = sorted(rng.sample(range(60), rng.randrange(1, 9)))
        values = [rng.choice([0.5, 1.3, 2.71, 4.4, -0.8, -3.1]) + rng.random() / 100 for _ in places]
        scores = [-toxicity.GAP] * 61
        for place, value in zip(places, values, strict=True):
            scores[place] = value
        got = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(places, values)]
        assert got == slow_segments(scores)


def test_a_word_behind_itself_adds_no_score():
    bad = pa.array(["bad"])
    token = next(toxicity._tokens(bad))[3]
    none = np.zeros(0, np.uint64)
    model = toxicity.Model(token, np.array([2.0]), none, np.zeros(0))
    texts = pa.array(["bad", "bad bad BAD", "bad x bad", "bad", ""])
    batch = pa.RecordBatch.from_arrays([texts], names=["text"])
    found = [b.to_pydict() for b in toxicity._score(iter([batch]), model, [], False)]
    assert found[0]["best"] == [2.0, 2.0, 2.0 - toxicity.GAP + 2.0, 2.0, 0.0]


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in toxic]
    y = np.array([toxic[r.doc_id] for r in rows])
    order = np.argsort(np.argsort([r.score for r in rows], kind="stable")) + 1
    area = (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    hits = sum(r.predicted and toxic[r.doc_id] for r in rows)
    assert area > 0.93 and hits / y.sum() > 0.85 and hits / sum(r.predicted for r in rows) > 0.93


def test_held_out_grades(spark):
    folder = "/root/testdata/sf0.1"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", grades.rating().alias("grade"))
    part = "crc32(cast(doc_id AS string)) % 3"
    weights, cuts = grades.fit(documents, labels.filter(f"{part} != 1"))
    assert list(cuts) == sorted(cuts)
    rows = grades.graded(documents, weights, cuts).join(labels.filter(f"{part} = 1"), "doc_id").collect()
    assert np.mean([(r.tails[0] > 0.5) == (r.grade > 0) for r in rows]) > 0.95
    assert np.mean([round(r.expected_grade) == r.grade for r in rows]) > 0.85


# Pipeline


def test_pipeline_stages(spark, documents, texts, tokenizer, tmp_path):
    docs, kept = documents, [set(texts)]
    tables = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        tables[name] = {r.doc_id: r for r in docs.collect()}
        kept.append(set(tables[name]))
    scored = {r.doc_id: r.predicted for r in QUERIES["op10_toxicity"](spark, FOLDER).collect()}
    assert kept[1] == {i for i in texts if not scored[i]}
    prints = {i: slow_fingerprint(texts[i]) for i in kept[1]}
    roots = slow_roots(set(prints.values()))
    least = {}
    for i in sorted(prints):
        least.setdefault(roots[prints[i]], i)
    assert kept[2] == set(least.values())
    hit = {r.doc_id for r in QUERIES["op9_decontaminate"](spark, FOLDER).collect() if r.contaminated}
    assert kept[3] == kept[2] - hit
    assert kept[4] == kept[5] == kept[3]
    for i in kept[4]:
        row = tables["personal_data"][i]
        assert not base_spans(row.text)
        assert base_spans(texts[i]) or row.text == texts[i]
        assert row.n_chars == len(row.text)
        assert tables["encode"][i].ids == tokenizer.encode(row.text, add_special_tokens=False).ids


# Quality rules: what hosts do to their documents


def hosted(spark, hosts):
    """Documents by host from {host: (failing, good)}; a good text has 60 different words, a failing one has five."""
    rows, good = [], " ".join(f"w{i}" for i in range(60))
    for host, (n_bad, n_good) in hosts.items():
        rows += [(len(rows) + i, "too short to be kept here" if i < n_bad else good, host) for i in range(n_bad + n_good)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


HOSTED = {
    # Every good text of a large host that mostly fails goes; a small one with such a share is saved by the prior.
    "shrunk": ({"large": (90, 10), "small": (2, 1), None: (0, 8), **{f"h{i}": (i % 3, 30) for i in range(20)}}, {"large"}),
    "all alike": ({f"h{i}": (1, 3) for i in range(6)}, set()),
    "alike and bad": ({f"h{i}": (3, 1) for i in range(6)}, {f"h{i}" for i in range(6)}),
    "exactly one half": ({f"h{i}": (2, 2) for i in range(5)}, set()),
    "one host": ({"only": (5, 4)}, {"only"}),
}


@pytest.mark.parametrize("name", HOSTED)
def test_hosts_decide(spark, tmp_path, name):
    import duckdb

    from llm import quality_rules
    from tools.compare import compare

    hosts, rejected = HOSTED[name]
    documents = hosted(spark, hosts)
    rows = quality_rules.quality_rules(documents).collect()
    assert len(rows) == sum(map(sum, hosts.values()))
    for r in rows:
        assert r.kept == (not r.base_failed and r.host not in rejected)
    if name == "shrunk":
        rates = {r.host: r.rate for r in rows}
        assert rates["small"] < 0.5 < 2 / 3 and 0.5 < rates["large"] < 0.9
    if name == "exactly one half":
        assert {r.rate for r in rows} == {0.5}
    # The SQL on tables in which hosts are rejected.
    documents.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, connection, str(tmp_path), "op6_quality_rules")[0] == "same"


def test_fitted_grades_are_where_the_likelihood_has_no_slope():
    """The likelihood written out, its slopes by differences, on rows drawn from a model with three grades."""
    draw = np.random.default_rng(6)
    n, used = 400, 5
    x = draw.normal(size=(n, used))
    true, cuts = np.array([2.0, -1.0, 0.5, 0.0, 1.0]), np.array([-0.5, 1.0])
    z = x @ true + draw.logistic(size=n)
    grade = (z[:, None] > cuts).sum(axis=1)
    row, bucket = np.repeat(np.arange(n), used), np.tile(np.arange(used), n)
    weights, found = grades.fit_ordinal(grade, row, bucket, x.ravel(), 3)
    assert list(found) == sorted(found) and not weights[used:].any()

    def cost(w, c):
        total = 0.0
        for i in range(n):
            s = sum(x[i, j] * w[j] for j in range(used))
            tails = [1.0, *(1 / (1 + np.exp(-(s - t))) for t in c), 0.0]
            total -= np.log(tails[grade[i]] - tails[grade[i] + 1])
        return total / n + grades.RIDGE / 2 * sum(v * v for v in w)

    best = np.concatenate([weights[:used], found])
    step = 1e-4
    for j in range(used + 2):
        up, down = best.copy(), best.copy()
        up[j] += step
        down[j] -= step
        slope = (cost(up[:used], up[used:]) - cost(down[:used], down[used:])) / (2 * step)
        assert abs(slope) < 5e-3
    assert np.abs(weights[:used] - true).max() < 0.6 and np.abs(found - cuts).max() < 0.6
