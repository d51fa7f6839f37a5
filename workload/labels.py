"""Votes, categories, weak labels, class counts, scores."""

from pyspark.sql import functions as F

from tagloom.functions.keywords import SWEEP_THRESHOLDS
from tagloom.operators.labels import (
    attach_labels,
    binarize,
    by_label,
    label_domain,
    label_or_sentinel,
    majority_vote,
    replace_column,
    split_stored,
)
from tagloom.operators.metrics import binary_scores, class_balance, class_shares, label_mean, labelled_count
from tagloom.plans.corpus import add_weak_label, sweep
from tagloom.operators.clean import cleaned_rows, drop_missing, keep_first
from workload.registry import (
    KEYWORDS,
    LABELLED,
    labelled_documents,
    query,
    sql_cells,
    sql_clean,
    sql_density,
    sql_matches,
    sql_scores,
    table,
    texts,
)

VOTES = """SELECT l_orderkey, (avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.5)::INT AS label
  FROM lineitem GROUP BY l_orderkey"""


def _votes(spark, folder):
    vote = F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("attack")
    return table(spark, folder, "lineitem").select("l_orderkey", vote)


@query("majority_vote_label", VOTES)
def majority_vote_label(spark, folder):
    return majority_vote(_votes(spark, folder), "l_orderkey", "attack")


@query(
    "label_left_join",
    f"SELECT o_orderkey, o_orderstatus, v.label FROM orders LEFT JOIN ({VOTES}) v ON o_orderkey = l_orderkey",
)
def label_left_join(spark, folder):
    items = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    votes = majority_vote(_votes(spark, folder), "l_orderkey", "attack")
    return attach_labels(items, votes.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")


@query(
    "binarize_category",
    """SELECT event_id, category, CASE WHEN category IN ('view', 'click') THEN 0 ELSE 1 END AS label
    FROM (SELECT event_id, nullif(event_type, 'signup') AS category FROM events)""",
)
def binarize_category(spark, folder):
    category = F.nullif(F.col("event_type"), F.lit("signup")).alias("category")
    events = table(spark, folder, "events").select("event_id", category)
    return events.withColumn("label", binarize(F.col("category"), ("view", "click")))


@query(
    "keyword_matches",
    f"""SELECT doc_id, array_to_string(matches, ' ') AS matches, len(matches)::INT AS len_matches,
      len(string_split(text, ' '))::INT AS len_text, round(len(matches)::DOUBLE / len(string_split(text, ' ')), 9) AS norm_kw
    FROM (SELECT doc_id, text, {sql_matches('text')} AS matches FROM documents)""",
)
def keyword_matches(spark, folder):
    documents = texts(spark, folder).select("doc_id", "text")
    rows = add_weak_label(documents, KEYWORDS)
    return rows.select(
        "doc_id",
        F.array_join("matches", " ").alias("matches"),
        "len_matches",
        "len_text",
        F.round("norm_kw", 9).alias("norm_kw"),
    )


@query(
    "weak_label",
    f"SELECT doc_id, ({sql_density('text')} > 0.01)::INT AS weak_pos_keywords FROM documents",
)
def weak_label(spark, folder):
    documents = texts(spark, folder).select("doc_id", "text")
    return add_weak_label(documents, KEYWORDS, 0.01).select("doc_id", "weak_pos_keywords")


SWEEP_SQL = sql_scores(
    f"""SELECT threshold, {sql_cells('label', 'weak')} FROM (
      SELECT t.threshold, label, ({sql_density('text')} > t.threshold)::INT AS weak
      FROM (SELECT d.doc_id, {sql_clean('d.text')} AS text, l.toxic AS label
            FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1) d
            JOIN labels l USING (doc_id)) b,
           (SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE, 0.25::DOUBLE]) AS threshold) t
      WHERE text <> '' AND text NOT IN ('[URL]', '[EMOJI]')) GROUP BY threshold""",
    "threshold",
    2,
)


@query("threshold_sweep", SWEEP_SQL)
def threshold_sweep(spark, folder):
    """Clean, dedup, label, weak-label and compare: the whole data preparation."""
    documents = texts(spark, folder).select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    # Dedup needs ids and digests of all rows; only labelled rows are cleaned.
    rows = keep_first(drop_missing(documents, "text"), "text", "doc_id").join(labels, "doc_id")
    cleaned = cleaned_rows(rows).select("doc_id", F.col("clean_text").alias("text"), "label")
    return sweep(cleaned, KEYWORDS, SWEEP_THRESHOLDS)


@query(
    "weak_label_scores",
    sql_scores(
        f"""SELECT lang, {sql_cells('label', 'weak')} FROM (
          SELECT d.lang, l.toxic AS label, ({sql_density('d.text')} > 0.01)::INT AS weak
          FROM documents d JOIN labels l USING (doc_id)) GROUP BY lang""",
        "lang",
        6,
    ),
)
def weak_label_scores(spark, folder):
    documents = texts(spark, folder).select("doc_id", "lang", "text")
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    rows = add_weak_label(documents.join(labels, "doc_id"), KEYWORDS, 0.01)
    return binary_scores(rows, "label", "weak_pos_keywords", ["lang"], places=6)


@query(
    "class_balance",
    """SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS n_pos, count(*) FILTER (WHERE toxic = 0) AS n_neg,
      round(avg(toxic::DOUBLE), 6) AS label_mean,
      round_even(count(*) FILTER (WHERE toxic = 1)::DOUBLE / count(*) * 1000::DOUBLE, 0) / 1000::DOUBLE AS pos_share,
      CASE WHEN count(*) FILTER (WHERE toxic = 0) >= count(*) FILTER (WHERE toxic = 1)
        THEN 'negative' ELSE 'positive' END AS majority FROM labels""",
)
def class_balance_labels(spark, folder):
    balance = class_balance(table(spark, folder, "labels"), "toxic")
    return balance.withColumn("label_mean", F.round("label_mean", 6))


@query(
    "class_shares",
    """SELECT toxic, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
    FROM labels WHERE toxic IS NOT NULL GROUP BY toxic""",
)
def class_shares_labels(spark, folder):
    return class_shares(table(spark, folder, "labels"), "toxic").withColumn("share", F.round("share", 6))


@query(
    "label_domain",
    """SELECT array_to_string(list_sort(list(DISTINCT label)), ' ') AS labels, count(DISTINCT label)::INT AS n_labels
    FROM embeddings""",
)
def label_domain_embeddings(spark, folder):
    domain = label_domain(table(spark, folder, "embeddings"))
    return domain.withColumn("labels", F.array_join(F.col("labels").cast("array<string>"), " "))


@query("label_mean", "SELECT round_even(avg(quality::DOUBLE) * 1e4::DOUBLE, 0) / 1e4::DOUBLE AS label_mean FROM labels")
def label_mean_labels(spark, folder):
    return label_mean(table(spark, folder, "labels"), "quality", 4)


@query("null_label_sentinel", "SELECT doc_id, coalesce(toxic, -1) AS label FROM documents LEFT JOIN labels USING (doc_id)")
def null_label_sentinel(spark, folder):
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    rows = attach_labels(table(spark, folder, "documents").select("doc_id"), labels, "doc_id")
    return rows.select("doc_id", label_or_sentinel(F.col("toxic")).alias("label"))


@query(
    "stored_split",
    """SELECT doc_id, part, CASE WHEN part IS NOT DISTINCT FROM 'test' THEN 'test' ELSE 'train' END AS side FROM (
      SELECT doc_id, CASE source WHEN 'src0' THEN 'test' WHEN 'src3' THEN NULL ELSE source END AS part FROM documents)""",
)
def stored_split(spark, folder):
    source = F.col("source")
    part = F.when(source == "src0", "test").when(source != "src3", source)
    train, test = split_stored(table(spark, folder, "documents").select("doc_id", part.alias("part")), "part")
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@query(
    "class_subsets",
    """SELECT 'positive' AS subset, doc_id FROM labels WHERE toxic = 1
    UNION ALL SELECT 'negative', doc_id FROM labels WHERE toxic = 0""",
)
def class_subsets(spark, folder):
    labels = table(spark, folder, "labels")
    positive = by_label(labels, 1, "toxic").select(F.lit("positive").alias("subset"), "doc_id")
    return positive.unionByName(by_label(labels, 0, "toxic").select(F.lit("negative").alias("subset"), "doc_id"))


@query(
    "replace_labels",
    """SELECT doc_id, CASE WHEN quality = 0 THEN NULL WHEN toxic = 1 THEN 2 ELSE toxic END AS toxic, quality FROM labels""",
)
def replace_labels(spark, folder):
    labels = table(spark, folder, "labels")
    changed = labels.filter("quality = 0 OR toxic = 1").select(
        "doc_id", F.when(F.col("quality") != 0, 2).alias("toxic")
    )
    return replace_column(labels, changed, "doc_id", "toxic")


@query("labelled_count", f"SELECT count(label) AS num_examples FROM documents LEFT JOIN ({LABELLED}) x ON doc_id = id")
def labelled_count_documents(spark, folder):
    labels = labelled_documents(spark, folder).select(F.col("id").alias("doc_id"), "label")
    return labelled_count(table(spark, folder, "documents").select("doc_id").join(labels, "doc_id", "left"))
