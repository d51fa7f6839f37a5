"""TF-IDF and fixed-length word ids on the documents."""

from pyspark.sql import functions as F

from tagloom.functions.text import clean_text
from tagloom.operators.features import (
    FIRST_WORD_ID,
    MAX_LENGTH,
    STOP_WORDS,
    TERM_PATTERN,
    WORD_PATTERN,
    encode_fixed,
    fit_tfidf,
    fit_transform_tfidf,
    fit_transform_tfidf_vectors,
    fit_word_ids,
    transform_tfidf,
    word_lists,
)
from tagloom.operators.sampling import flag_test
from tagloom.session import materialize
from workload.registry import query, quote, sql_clean, sql_rank, texts


def _parts(spark, folder):
    flagged = flag_test(texts(spark, folder).select("doc_id", "text"), id_col="doc_id")
    # Read by the fit and by the transform.
    flagged = materialize(flagged, "split")
    return flagged.filter("NOT is_test"), flagged.filter("is_test")


TFIDF = f"""
  WITH split AS (SELECT doc_id, text,
      {sql_rank('doc_id', '42')} <= ceil(0.101::DOUBLE * count(*) OVER ()) AS is_test FROM documents),
  found AS (SELECT doc_id, is_test, unnest(regexp_extract_all(lower(text), {quote(TERM_PATTERN)})) AS term FROM split),
  tf AS (SELECT doc_id, is_test, term, count(*) AS tf FROM found
         WHERE term NOT IN ({', '.join(map(quote, STOP_WORDS))}) GROUP BY ALL),
  idf AS (SELECT term, ln((1 + (SELECT count(*) FROM split WHERE NOT is_test))::DOUBLE / (1 + count(*))) + 1 AS idf
          FROM tf WHERE NOT is_test GROUP BY term),
  raw AS (SELECT doc_id, is_test, term, tf * idf AS raw FROM tf JOIN idf USING (term))
  SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw"""


def _rounded(weights):
    return weights.withColumn("weight", F.round("weight", 6))


@query("tfidf_fit", f"{TFIDF} WHERE NOT is_test")
def tfidf_fit(spark, folder):
    train, _ = _parts(spark, folder)
    return _rounded(fit_transform_tfidf(train, "doc_id")[1])


@query("tfidf_transform", f"{TFIDF} WHERE is_test")
def tfidf_transform(spark, folder):
    train, test = _parts(spark, folder)
    return _rounded(transform_tfidf(fit_tfidf(train), test, "doc_id"))


@query(
    "tfidf_vectors",
    f"""WITH weights AS ({TFIDF} WHERE NOT is_test),
        numbered AS (SELECT term, {sql_rank('term', '0')} - 1 AS term_id FROM (SELECT DISTINCT term FROM weights))
        SELECT doc_id, term_id, weight FROM weights JOIN numbered USING (term)""",
)
def tfidf_vectors(spark, folder):
    """The stored vectors, taken apart again."""
    train, _ = _parts(spark, folder)
    _, vectors = fit_transform_tfidf_vectors(train, "doc_id")
    parts = F.unwrap_udt("features")
    pairs = F.arrays_zip(parts["indices"].alias("term_id"), parts["values"].alias("weight"))
    return _rounded(vectors.select("doc_id", F.inline(pairs)).withColumn("term_id", F.col("term_id").cast("bigint")))


ENCODE = f"""
  WITH cleaned AS (SELECT doc_id, {sql_clean('text')} AS text FROM documents),
  found AS (SELECT doc_id, regexp_extract_all(text, {quote(WORD_PATTERN)}) AS words FROM cleaned),
  vocabulary AS (SELECT word, {sql_rank('word', '0')} - 1 + {FIRST_WORD_ID} AS word_id FROM
    (SELECT DISTINCT unnest(words) AS word FROM found) WHERE word NOT IN ('[USER]', '[URL]', '[EMOJI]')),
  spread AS (SELECT doc_id, unnest(words[:{MAX_LENGTH - 2}]) AS word, generate_subscripts(words[:{MAX_LENGTH - 2}], 1) AS place
             FROM found),
  ids AS (SELECT doc_id, list(CASE word WHEN '[USER]' THEN 4 WHEN '[URL]' THEN 5 WHEN '[EMOJI]' THEN 6
                              ELSE word_id END ORDER BY place) AS ids
          FROM spread LEFT JOIN vocabulary USING (word) GROUP BY doc_id),
  bodies AS (SELECT doc_id, list_concat(list_concat([2::BIGINT], coalesce(ids, []::BIGINT[])), [3::BIGINT]) AS body
             FROM found LEFT JOIN ids USING (doc_id))
  SELECT doc_id,
    array_to_string(body, ' ') || repeat(' 0', ({MAX_LENGTH} - len(body))::INT) AS input_ids,
    len(body)::INT AS n_tokens FROM bodies"""


@query("encode_fixed_length", ENCODE)
def encode_fixed_length(spark, folder):
    text = clean_text(F.col("text"))
    lists = word_lists(texts(spark, folder).select("doc_id", text.alias("text")), "doc_id")
    rows = encode_fixed(fit_word_ids(lists), lists, "doc_id")
    return rows.select(
        "doc_id",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda total, bit: total + bit).alias("n_tokens"),
    )
