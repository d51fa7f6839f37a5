r"""Quality rules with verdicts on hosts, in DataFrame functions alone.

Each text gets its counts and fails the base rules on its own. For every host (`source`) the share of failing
documents is then shrunk towards the share of all hosts by a beta prior whose two parameters come from the mean and
variance of the hosts' shares, so hosts with few documents are not judged by chance. A host whose shrunk share of
failures is over `MAX_RATE` is rejected with all its documents.

Counts of a text are made inside its row; only narrow rows (one per host and task) are shuffled, so a host that
holds a third of all documents is no hot group.

Defined cases: null and empty texts have no words and fail; a null source is a host of its own; repeated rows count
each; a table without documents gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.registry import query, table
from tagloom.session import materialize, spread

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MAX_RATE = 0.5
# Bounds for the prior's weight in documents, for hosts that are all alike or too few to tell.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 10_000.0


def _spread_out(column: str) -> Column:
    return F.translate(F.col(column), BLANKS, "")


def text_counts(documents: DataFrame) -> DataFrame:
    """Adds `n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`; drops `text`."""
    blank = r"[\x20\x09-\x0D]+"
    rest = [c for c in documents.columns if c != "text"]
    texts = documents.withColumn("text", F.coalesce("text", F.lit("")))
    trimmed = F.btrim("text", F.lit(BLANKS))
    counted = texts.select(
        *rest,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, blank)).alias("__words"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("__lines"),
        F.length(_spread_out("text")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    hashed = counted.select(
        *rest,
        "word_chars",
        "n_symbols",
        F.size("__words").cast("bigint").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(
            F.size("__words") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("__words") - 3),
                lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("__runs"),
    )
    # Runs side by side with their places; only texts in which some run repeats need the sort.
    repeats = F.size(F.array_distinct("__runs")) < F.size("__runs")
    placed = hashed.withColumn(
        "__sorted",
        F.when(repeats, F.sort_array(F.transform("__runs", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("__runs")

    def again(pair, j):
        def same(k):
            return F.coalesce(F.get("__sorted", k)["h"] == pair["h"], F.lit(False))

        return same(j - 1) | same(j + 1)

    covered = F.flatten(
        F.transform(F.filter("__sorted", again), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    )
    n_repeat = F.coalesce(F.size(F.array_distinct(covered)), F.lit(0))
    out = placed.withColumn("n_repeat_words", F.greatest(n_repeat, F.lit(0)).cast("bigint")).drop("__sorted")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def host_verdicts(counted: DataFrame, host: str = "source") -> DataFrame:
    """`<host, n_docs, n_failed, rate, host_kept>`: shares of failing documents, shrunk, and what follows."""
    hosts = counted.groupBy(host).agg(
        F.count("*").alias("n_docs"), F.count_if("base_failed").alias("n_failed")
    )
    share = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(share).alias("m"), F.var_pop(share).alias("v"))
    weight = F.coalesce(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1, F.lit(MOST_WEIGHT))
    prior = moments.select("m", F.least(F.greatest(weight, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)).alias("weight"))
    m, weight = prior.first() or (None, None)
    if m is None:
        m, weight = 0.0, LEAST_WEIGHT
    rate = (F.col("n_failed") + F.lit(m * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= MAX_RATE)


def quality_rules(documents: DataFrame, host: str = "source") -> DataFrame:
    """`<doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, rate>`."""
    counted = materialize(text_counts(documents.select("doc_id", "text", F.col(host).alias("host"))), "counts")
    verdicts = host_verdicts(counted, "host").select(F.col("host").alias("__host"), "rate", "host_kept")
    joined = counted.join(verdicts, F.col("host").eqNullSafe(F.col("__host")))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.col("host_kept")).alias("kept"),
        "host",
        "rate",
    )


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, i, list_slice(w, i, i + 2) AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r.doc_id, r.i FROM runs r
  JOIN (SELECT doc_id, run FROM runs GROUP BY doc_id, run HAVING count(*) > 1) USING (doc_id, run)),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM f GROUP BY source),
m AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h),
p AS (SELECT m, least(greatest(coalesce(m * (1 - m) / nullif(v, 0) - 1, 10000.0), 2.0), 10000.0) AS k FROM m)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (bad + m * k) / (n + k) <= 0.5 AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, p
"""


@query("op6_quality_rules", SQL)
def op6_quality_rules(spark, folder):
    return quality_rules(spread(table(spark, folder, "documents", "doc_id", "text", "source"))).drop("host", "rate")
