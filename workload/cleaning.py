"""Text cleaning, dedup and their reports."""

from pyspark.sql import functions as F

from tagloom.functions.text import clean_text, decode_entities, drop_corpus_marks
from tagloom.operators.clean import clean_rows, keep_first, length_summary, stage_report, store_by_id
from tagloom.session import new_path
from tagloom.streaming.rows import clean_stream, run_available
from workload.registry import SQL, query, quote, sql_clean, sql_entities, table, texts

MARKS = ("[URL]", "[EMOJI]")
# Every text twice, or in its place nothing, blanks, a bare link, a bare emoji, or a link and an emoji.
WITH_GAPS = """
  SELECT doc_id, text FROM documents UNION ALL
  SELECT doc_id + 1000000000, CASE source
    WHEN 'src0' THEN NULL WHEN 'src1' THEN repeat(' ', n_chars::INT) WHEN 'src2' THEN concat(' http://', doc_id::VARCHAR)
    WHEN 'src3' THEN concat(repeat(' ', n_chars::INT), '😀') WHEN 'src4' THEN concat('http://', doc_id::VARCHAR, ' 😀')
    ELSE text END FROM documents"""


def with_gaps(spark, folder):
    documents = texts(spark, folder)
    blanks = F.repeat(F.lit(" "), F.col("n_chars").cast("int"))
    link = F.concat(F.lit("http://"), F.col("doc_id").cast("string"))
    other = (
        F.when(F.col("source") == "src0", F.lit(None))
        .when(F.col("source") == "src1", blanks)
        .when(F.col("source") == "src2", F.concat(F.lit(" "), link))
        .when(F.col("source") == "src3", F.concat(blanks, F.lit("😀")))
        .when(F.col("source") == "src4", F.concat(link, F.lit(" 😀")))
        .otherwise(F.col("text"))
    )
    added = documents.select((F.col("doc_id") + 1_000_000_000).alias("doc_id"), other.alias("text"))
    return documents.select("doc_id", "text").unionByName(added)


CLEANED = f"""
  WITH firsts AS (SELECT * FROM ({WITH_GAPS}) WHERE text IS NOT NULL
                  QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1),
  cleaned AS (SELECT doc_id, {sql_clean('text')} AS clean_text FROM firsts)"""
KEPT = "clean_text <> '' AND clean_text NOT IN ('[URL]', '[EMOJI]')"


@query("clean_text_documents", f"SELECT doc_id, {sql_clean('text')} AS clean_text FROM documents")
def clean_text_documents(spark, folder):
    documents = texts(spark, folder)
    return documents.select("doc_id", clean_text(F.col("text")).alias("clean_text"))


@query("clean_text_pages", f"SELECT page_id, {sql_clean('concat_ws(chr(32), url, html)')} AS clean_text FROM pages")
def clean_text_pages(spark, folder):
    pages = texts(spark, folder, "pages", "page_id").withColumn("raw", F.concat_ws(" ", "url", "html"))
    return pages.select("page_id", clean_text(F.col("raw"), entities="common").alias("clean_text"))


# Whole texts with something for every step around them: quote marks, mentions, links, emoji, tabs.
DECORATED = (
    "concat(chr(10), '>>> MENTION', {id}, ' ', {text}, chr(9), 'http://', {source}, '.example/@', {id}, "
    "' @', {source}, ' \U0001f600\U0001f1e9❤', chr(160), chr(160), 'a@b-', {lang}, ' &amp;lt; MENTION ', chr(12288))"
).format(id="doc_id", text="text", source="source", lang="lang")


@query("clean_text_decorated", f"SELECT doc_id, {sql_clean(DECORATED)} AS clean_text FROM documents")
def clean_text_decorated(spark, folder):
    documents = texts(spark, folder)
    raw = F.concat(
        F.lit("\n>>> MENTION"), F.col("doc_id").cast("string"), F.lit(" "), F.col("text"), F.lit("\thttp://"),
        F.col("source"), F.lit(".example/@"), F.col("doc_id").cast("string"), F.lit(" @"), F.col("source"),
        F.lit(" \U0001f600\U0001f1e9❤  a@b-"), F.col("lang"), F.lit(" &amp;lt; MENTION 　"),
    )
    rows = documents.select("doc_id", raw.alias("raw"))
    return rows.select("doc_id", clean_text(F.col("raw"), entities="common").alias("clean_text"))


@query("html_unescape_full", f"SELECT page_id, {sql_entities('html')} AS html FROM pages")
def html_unescape_full(spark, folder):
    return table(spark, folder, "pages").select("page_id", decode_entities(F.col("html")).alias("html"))


@query(
    "corpus_markers",
    f"""SELECT doc_id, replace(replace(replace(marked, 'NEWLINE_TOKEN', ' '), 'TAB_TOKEN', ' '), '==', '') AS text
    FROM (SELECT doc_id, replace(replace(replace(text, chr(10), 'NEWLINE_TOKEN'), ', ', 'TAB_TOKEN'), '.', {quote('===')})
          AS marked FROM documents)""",
)
def corpus_markers(spark, folder):
    text = F.col("text")
    for old, new in (("\n", "NEWLINE_TOKEN"), (", ", "TAB_TOKEN"), (".", "===")):
        text = F.replace(text, F.lit(old), F.lit(new))
    marked = table(spark, folder, "documents").select("doc_id", text.alias("marked"))
    return marked.select("doc_id", drop_corpus_marks(F.col("marked")).alias("text"))


@query(
    "dedup_keep_first",
    """SELECT doc_id, text, lang FROM documents
    QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
)
def dedup_keep_first(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    return keep_first(documents, "text", "doc_id")


@query("dedup_in_buckets", SQL["dedup_keep_first"])
def dedup_in_buckets(spark, folder):
    """The same rows from a table in buckets of its ids, where texts never move again."""
    documents, buckets = store_by_id(table(spark, folder, "documents").select("doc_id", "text", "lang"), "doc_id")
    return keep_first(documents, "text", "doc_id", buckets)


@query(
    "clean_rows_documents",
    f"{CLEANED} SELECT doc_id, clean_text, length(clean_text)::INT AS text_length FROM cleaned WHERE {KEPT}",
)
def clean_rows_documents(spark, folder):
    return clean_rows(with_gaps(spark, folder), "doc_id").select("doc_id", "clean_text", "text_length")


@query(
    "drop_stages_report",
    f"""{CLEANED}, totals AS (
      SELECT 2 * (SELECT count(*) FROM documents) AS n,
             (SELECT count(text) FROM ({WITH_GAPS})) AS present,
             (SELECT count(*) FROM cleaned) AS texts,
             (SELECT count(*) FROM cleaned WHERE clean_text <> '') AS filled,
             (SELECT count(*) FROM cleaned WHERE {KEPT}) AS kept)
    SELECT 1 AS step, 'missing' AS stage, n AS rows_in, n - present AS dropped, present AS kept FROM totals
    UNION ALL SELECT 2, 'duplicate', present, present - texts, texts FROM totals
    UNION ALL SELECT 3, 'empty', texts, texts - filled, filled FROM totals
    UNION ALL SELECT 4, 'marks_only', filled, filled - kept, kept FROM totals""",
)
def drop_stages_report(spark, folder):
    return stage_report(with_gaps(spark, folder))


@query(
    "text_length_summary",
    f"""{CLEANED}, sizes AS (SELECT length(clean_text) AS size FROM cleaned WHERE {KEPT})
    SELECT count(*) AS n, round(avg(size), 6) AS mean_len, round(stddev_samp(size), 6) AS std_len,
      min(size)::BIGINT AS min_len, quantile_cont(size, 0.25)::DOUBLE AS q25, quantile_cont(size, 0.5)::DOUBLE AS q50,
      quantile_cont(size, 0.75)::DOUBLE AS q75, max(size)::BIGINT AS max_len FROM sizes""",
)
def text_length_summary(spark, folder):
    summary = length_summary(clean_rows(with_gaps(spark, folder), "doc_id"))
    return summary.withColumns({name: F.round(name, 6) for name in ("mean_len", "std_len")})


@query(
    "clean_stream_documents",
    f"""SELECT doc_id, clean_text, length(clean_text)::INT AS text_length
    FROM (SELECT doc_id, {sql_clean('text')} AS clean_text FROM documents WHERE text IS NOT NULL) WHERE {KEPT}""",
)
def clean_stream_documents(spark, folder):
    schema = table(spark, folder, "documents").schema
    # A pattern that matches the table alone, be it one file or a folder of part files.
    source = spark.readStream.schema(schema).parquet(f"{folder}/documents.parque[t]")
    out = new_path(spark, "stream")
    run_available(clean_stream(source, "doc_id"), f"{out}/rows", f"{out}/progress")
    return spark.read.parquet(f"{out}/rows")
