"""Every operator on awkward rows, on tables without rows, and beside columns with clashing names."""

from tokenizers import Tokenizer

import corpus_pipeline
from llm import bpe, chat, decontaminate, grades, html, pii, quality_rules, repeats, simhash, toxicity

from odd_rows import LONG, ROWS


def none_of(df):
    return df.limit(0)


def benchmark(spark):
    return spark.createDataFrame(
        [(1, "word5 the word6"), (2, ""), (3, None), (4, None), (None, "one id"), (1, "word5 the word6")],
        "item_id bigint, text string",
    )


def labels(spark):
    rows = [(i, i % 2, int(i in (8, 3))) for i in range(20)] + [(None, 1, 1), (6, None, None), (8, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_grades(spark, odd_documents):
    rated = labels(spark).select("doc_id", grades.rating().alias("grade"))
    rows = grades.graded(odd_documents, *grades.fit(odd_documents, rated)).collect()
    assert len(rows) == len(ROWS)
    assert all(0 <= t <= 1 and list(r.tails) == sorted(r.tails, reverse=True) for r in rows for t in r.tails)
    assert len({round(r.expected_grade, 12) for r in rows if r.doc_id in (2, 3)}) == 1
    unfitted = grades.fit(odd_documents, none_of(rated))
    assert {r.tails[0] for r in grades.graded(odd_documents, *unfitted).collect()} == {0.5}
    assert grades.graded(none_of(odd_documents), *unfitted).count() == 0


def test_bpe(odd_documents):
    rows = bpe.encode_documents(odd_documents, bpe.vocabulary_path()).collect()
    assert len(rows) == len(ROWS)
    assert all(r.n_tokens == len(r.ids) for r in rows)
    assert all(r.n_tokens == 0 and r.decoded == "" for r in rows if r.doc_id in (2, 3, 4))
    assert bpe.encoded_digests(none_of(odd_documents), bpe.vocabulary_path()).count() == 0


def test_simhash(odd_documents):
    rows = simhash.near_duplicates(odd_documents).collect()
    assert len(rows) == len(ROWS)
    empty = [r for r in rows if r.doc_id in (2, 3, 4)]
    assert {(r.fingerprint, r.component_id) for r in empty} == {("0" * 16, 2)}
    assert {r.component_id for r in rows if r.doc_id in (5, 10)} == {5}
    assert simhash.near_duplicates(none_of(odd_documents)).count() == 0


def test_repeats(odd_documents):
    out, cut = repeats.without_repeats(odd_documents)
    rows = {(r.doc_id, r.n_words): r for r in out.collect()}
    n = len(LONG.split())
    assert out.count() == len(ROWS)
    assert rows[5, n].n_removed == 0 and rows[10, n].n_removed == n
    assert sum(r.n_removed for r in rows.values()) == n
    assert repeats.without_repeats(none_of(odd_documents))[0].count() == 0


def test_chat(spark):
    path = bpe.vocabulary_path("byte_bpe_50k.json")
    rows = [
        (1, 0, None, None, "x"),
        (1, 0, "assistant", "tie </s>", "x"),
        (1, 0, "assistant", "tie </s>", "x"),
        (1, None, "sys[TEXT]tem", r"<\\/s> <\s> \ ", "x"),
        (None, 3, "assistant", LONG, "x"),
    ]
    given = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, ids string")
    tokenizer = chat.load(path)
    seen = {}
    for row in chat.format_conversations(given, path).collect():
        import numpy as np

        assert len(row.ids) == len(row.loss_mask)
        seen[row.conv_id] = chat.read_back(tokenizer, np.array(row.ids), np.array(row.loss_mask))
    assert seen[1][0] == [
        ("sys[TEXT]tem", r"<\\/s> <\s> \ "),
        ("", ""),
        ("assistant", "tie </s>"),
        ("assistant", "tie </s>"),
    ]
    assert seen[1][1] == "tie </s>tie </s>"
    assert seen[None] == ([("assistant", LONG)], LONG)
    assert chat.format_conversations(none_of(given), path).count() == 0


def test_quality_rules(odd_documents):
    rows = quality_rules.quality_rules(odd_documents).collect()
    assert len(rows) == len(ROWS)
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (2, 3, 4))
    assert {r.host for r in rows} == {"s", None}
    assert quality_rules.quality_rules(none_of(odd_documents)).count() == 0


def test_html(spark):
    rows = [
        (1, "http://a.example.com/x", "<p>a&amp;b<p>c <!-- open"),
        (2, None, None),
        (3, "", ""),
        (4, "http://a.example.com/x", "<p>a&amp;b<p>c <!-- open"),
        (None, "nothing", "<div>" * 3_000 + "deep" + "<b unfinished"),
        (5, "HTTP://B.example.com:80/", "<article>" + "<p>long</p>" * 20_000 + "</article>"),
    ]
    given = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS host", "'y' AS text")
    got = {r.page_id: r.text for r in html.extract(given).collect()}
    assert got == {1: "a&b\nc", 2: "", 3: "", 4: "a&b\nc", None: "deep", 5: "\n".join(["long"] * 20_000)}
    assert html.extract(none_of(given)).count() == 0


def test_pii(odd_documents):
    rows = pii.personal_data(odd_documents).collect()
    assert len(rows) == len(ROWS)
    found = next(r for r in rows if r.doc_id == 8)
    text = dict(ROWS)[8]
    assert [(pii.KINDS[s.kind], text[s.start : s.end]) for s in found.base] == [
        ("email", "a.b@c.example.com"),
        ("email", "_x@d.example.org"),
        ("ip", "1.2.3.4"),
        ("ip", "5.6.7.8"),
        ("phone", "+1 (555) 010-9999"),
    ]
    assert not any(r.spans for r in rows if r.doc_id != 8)
    assert pii.personal_data(none_of(odd_documents)).count() == 0


def test_decontamination(spark, odd_documents):
    rows = decontaminate.contamination(odd_documents, benchmark(spark)).collect()
    assert len(rows) == len(ROWS)
    assert all(r.n_items == 1 and r.items == ["1"] and r.n_hit > 90 for r in rows if r.doc_id in (5, 10))
    assert sorted((r.n_words, r.contaminated) for r in rows if r.doc_id == 7) == [(2, False), (2, True)]
    assert decontaminate.contamination(odd_documents, none_of(benchmark(spark))).filter("contaminated").count() == 0
    assert decontaminate.contamination(none_of(odd_documents), benchmark(spark)).count() == 0


def test_toxicity(spark, odd_documents):
    given = labels(spark)
    rows = toxicity.toxicity(odd_documents, toxicity.fit(odd_documents, given)).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    nothing = toxicity.fit(odd_documents, none_of(given))
    assert {r.score for r in toxicity.toxicity(odd_documents, nothing).collect()} == {0.0}
    assert toxicity.toxicity(none_of(odd_documents), nothing).count() == 0


def test_pipeline_stages(spark, odd_documents, tmp_path):
    benchmark(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    tables = {}
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        tables[name] = docs.collect()
        if name != "encode":
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = {name: sorted((-1 if r.doc_id is None else r.doc_id) for r in rows) for name, rows in tables.items()}
    scored = toxicity.toxicity(odd_documents, toxicity.fit(odd_documents, labels(spark)))
    clean = [r.doc_id for r in scored.collect() if r.score < toxicity.TOXIC_FROM]
    assert ids["toxicity"] == sorted(-1 if i is None else i for i in clean)
    # Null, empty and blank texts are one group, as are the two long ones and the two equal rows.
    kept = ids["near_duplicates"]
    assert kept.count(2) == 1 and not {3, 4, 10} & set(kept) and kept.count(5) == 1 and kept.count(6) == 1
    assert kept.count(7) == 2 and kept.count(-1) == 1 and 1 in kept and 9 in kept
    # The items are "word5 the word6", in the long text, and "one id", one of the texts of 7.
    gone = {5, 7}
    assert [i for i in kept if i not in gone] == [i for i in ids["decontamination"] if i not in gone]
    assert 5 not in ids["decontamination"] and [r.text for r in tables["decontamination"] if r.doc_id == 7] == ["two texts"]
    before = {(r.doc_id, r.text): r for r in tables["decontamination"]}
    assert ids["personal_data"] == ids["decontamination"] == ids["encode"]
    for r in tables["personal_data"]:
        if r.doc_id == 8:
            assert r.text == "idiot! \x00 \x01 mail [EMAIL][EMAIL] [IP].[IP] [PHONE]" and r.n_chars == len(r.text)
        else:
            assert before[r.doc_id, r.text] == r
    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    want = []
    for r in tables["personal_data"]:
        ids_of_text = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((str(r.doc_id), ids_of_text, tokenizer.decode(ids_of_text, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in tables["encode"]) == sorted(want)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none_of(odd_documents.select(*corpus_pipeline.COLUMNS)), str(tmp_path)).count() == 0
