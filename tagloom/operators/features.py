"""TF-IDF in long form and as MLlib vectors, and fixed-length word ids."""

from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.functions.text import EMOJI, URL, USER
from tagloom.operators.joins import lookup_join
from tagloom.operators.ordering import with_position
from tagloom.session import materialize, new_path

# --- fixed values -----------------------------------------------------------------------------
# Runs of two or more word characters: letters, digits and the underscore of any script.
TERM_PATTERN = r"[\p{L}\p{N}_]{2,}"
WORD_PATTERN = r"\[URL\]|\[EMOJI\]|\[USER\]|[\p{L}\p{N}_]+"

# Common English function words. Pass another list where a different one is wanted.
STOP_WORDS = """
about above after again against all am an and any are as at be because been before being below
between both but by can cannot could did do does doing down during each few for from further had has
have having he her here hers herself him himself his how if in into is it its itself me more most my
myself no nor not of off on once only or other our ours ourselves out over own same she should so
some such than that the their theirs them themselves then there these they this those through to too
under until up very was we were what when where which while who whom why will with would you your
yours yourself yourselves
""".split()

PAD, UNKNOWN, START, END = 0, 1, 2, 3
RESERVED = {USER: 4, URL: 5, EMOJI: 6}
FIRST_WORD_ID = 7
MAX_LENGTH = 256
# ----------------------------------------------------------------------------------------------


def terms(text: Column) -> Column:
    """Lower-cased terms of a text, in order, stop words included."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM_PATTERN), F.lit(0))


def _without(stop_words) -> Column:
    return ~F.col("term").isin(list(stop_words)) if stop_words else F.lit(True)


@dataclass
class TfidfModel:
    """Fitted vocabulary `<term, df, idf>` as a stored table."""

    vocabulary: DataFrame
    stop_words: list[str]


def term_counts(df: DataFrame, id_col: str, text_col: str, stop_words=STOP_WORDS) -> DataFrame:
    """`<id, term, tf>`. Terms are counted inside each text, so no text and no term is shuffled for it."""
    listed = F.sort_array(terms(F.col(text_col)))
    # Equal terms are neighbours: a term's count is the gap between places where the term changes.
    # No filter on empty lists: it would be pushed to the scan and find all terms twice.
    places = F.when(F.size("_terms") > 0, F.sequence(F.lit(0), F.size("_terms") - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(
        places,
        lambda i: (i == 0) | (F.get("_terms", i) != F.coalesce(F.get("_terms", i - 1), F.lit(""))),
    )
    found = df.select(id_col, F.coalesce(listed, F.array().cast("array<string>")).alias("_terms"))
    found = found.select(id_col, "_terms", starts.alias("_at"))
    runs = F.transform(
        "_at",
        lambda at, i: F.struct(
            F.get("_terms", at).alias("term"),
            (F.coalesce(F.get("_at", i + 1), F.size("_terms")) - at).cast("bigint").alias("tf"),
        ),
    )
    return found.select(id_col, F.inline(runs)).filter(_without(stop_words))


def fit_tfidf(df: DataFrame, text_col: str = "text", stop_words=STOP_WORDS) -> TfidfModel:
    """Smoothed inverse document frequency `ln((1 + N) / (1 + df)) + 1` of every term."""
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    found = df.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term"))
    counts = found.filter(_without(stop_words)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n_docs + 1) / (F.col("df") + 1)) + 1
    return TfidfModel(materialize(counts.withColumn("idf", idf), "vocabulary"), list(stop_words))


def fit_transform_tfidf(
    df: DataFrame, id_col: str = "id", text_col: str = "text", stop_words=STOP_WORDS
) -> tuple[TfidfModel, DataFrame]:
    """The model fitted on `df` and what it makes of `df`. Terms are found and counted once per text; rows of one id are one
    text."""
    counts = materialize(term_counts(df, id_col, text_col, stop_words), "term-counts")
    model = _from_counts(counts, df, id_col, stop_words)
    return model, _weighted(_known(model.vocabulary, counts, id_col, "idf", stored=True), id_col, "term")


def _from_counts(counts: DataFrame, df: DataFrame, id_col: str, stop_words) -> TfidfModel:
    """The model from stored `<id, term, tf>`: a row per text and term, so rows are texts that have the term."""
    n_docs = df.agg(F.count(F.lit(1))).scalar()
    found = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((n_docs + 1) / (F.col("df") + 1)) + 1
    return TfidfModel(materialize(found.withColumn("idf", idf), "vocabulary"), list(stop_words))


def _known(vocabulary: DataFrame, counts: DataFrame, id_col: str, *columns: str, stored: bool = False) -> DataFrame:
    lookup = vocabulary.select("term", *columns, "df")
    return lookup_join(counts, lookup, "term", counts="df", spread_by=id_col, stored=stored)


def _gathered(known: DataFrame, id_col: str, *keep: str) -> DataFrame:
    """`<id, _norm, _rows>` from `<id, .., tf, idf>`; one text is one group and its norm is computed once."""
    raw = F.col("tf") * F.col("idf")
    gathered = known.groupBy(id_col).agg(F.collect_list(F.struct(*keep, raw.alias("raw"))).alias("_rows"))
    norm = F.sqrt(F.aggregate("_rows", F.lit(0.0), lambda total, row: total + row["raw"] * row["raw"]))
    return gathered.select(id_col, norm.alias("_norm"), "_rows")


def _weighted(known: DataFrame, id_col: str, *keep: str) -> DataFrame:
    """`<id, .., weight>` with length 1 per id, from `<id, .., tf, idf>`."""
    rows = _gathered(known, id_col, *keep).select(id_col, "_norm", F.inline("_rows"))
    return rows.select(id_col, *keep, (F.col("raw") / F.col("_norm")).alias("weight"))


def transform_tfidf(model: TfidfModel, df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """`<id, term, weight>`, each text with length 1. Terms outside the vocabulary vanish."""
    counts = term_counts(df, id_col, text_col, model.stop_words)
    return _weighted(_known(model.vocabulary, counts, id_col, "idf"), id_col, "term")


@dataclass
class TextVectors:
    """A fitted vocabulary whose terms are numbered 0, 1, .. in md5 order: `<term, df, idf, term_id>`, stored."""

    terms: DataFrame
    n_terms: int
    stop_words: list[str]

    def weights(self, df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
        """`<id, term_id, weight>`, the weights of `transform_tfidf`."""
        counts = term_counts(df, id_col, text_col, self.stop_words)
        return _weighted(_known(self.terms, counts, id_col, "term_id", "idf"), id_col, "term_id")

    def transform(self, df: DataFrame, id_col: str = "id", text_col: str = "text", out: str = "features") -> DataFrame:
        """`df` without its text but with sparse vectors, stored. Rows with one id have one text.

        Vectors are put together in Spark as the columns they consist of, and read back as vectors.
        """
        distinct = df.select(id_col, text_col).dropDuplicates([id_col])
        return self._stored(df, term_counts(distinct, id_col, text_col, self.stop_words), id_col, text_col, out)

    def _stored(
        self, df: DataFrame, counts: DataFrame, id_col: str, text_col: str, out: str, stored: bool = False
    ) -> DataFrame:
        known = _known(self.terms, counts, id_col, "term_id", "idf", stored=stored)
        # A text's rows are not taken apart for it. The norm is handed over as an array, else it is computed for every row.
        pairs = F.zip_with(
            "_rows",
            F.array_repeat("_norm", F.size("_rows")),
            lambda row, norm: F.struct(row["term_id"].cast("int").alias("i"), (row["raw"] / norm).alias("weight")),
        )
        gathered = _gathered(known, id_col, "term_id").select(id_col, F.sort_array(pairs).alias("_pairs"))
        vector = F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(self.n_terms).alias("size"),
            F.coalesce("_pairs.i", F.array().cast("array<int>")).alias("indices"),
            F.coalesce("_pairs.weight", F.array().cast("array<double>")).alias("values"),
        )
        others = [name for name in df.columns if name != text_col]
        rows = df.select(*others).join(gathered, id_col, "left").select(*others, vector.alias(out))
        path = new_path(df.sparkSession, "vectors")
        rows.write.parquet(path)
        schema = T.StructType([*(df.schema[name] for name in others), T.StructField(out, VectorUDT())])
        return df.sparkSession.read.schema(schema).parquet(path)


def fit_tfidf_vectors(df: DataFrame, text_col: str = "text", stop_words=STOP_WORDS) -> TextVectors:
    """Vocabulary for sparse vectors. It stays a table of any size; only a model fitted on the vectors holds a number
    per term. Vectors number their places with 32 bits, so 2 ** 31 terms are the end of the format."""
    return _numbered(fit_tfidf(df, text_col, stop_words))


def fit_transform_tfidf_vectors(
    df: DataFrame, id_col: str = "id", text_col: str = "text", stop_words=STOP_WORDS, out: str = "features"
) -> tuple[TextVectors, DataFrame]:
    """The vocabulary of `df`, whose ids are unique, and its rows with their vectors; terms are found once per text."""
    counts = materialize(term_counts(df, id_col, text_col, stop_words), "term-counts")
    model = _numbered(_from_counts(counts, df, id_col, stop_words))
    return model, model._stored(df, counts, id_col, text_col, out, stored=True)


def _numbered(model: TfidfModel) -> TextVectors:
    numbered = with_position(model.vocabulary, "term", 0, out="term_id")
    table = materialize(numbered, "numbered-vocabulary")
    n_terms = table.count()
    if n_terms >= 1 << 31:
        raise ValueError(f"{n_terms} terms: vectors number their places with 32 bits")
    return TextVectors(table, n_terms, model.stop_words)


def words(text: Column) -> Column:
    """Word tokens in order, case kept; the three marks stay whole."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


@dataclass
class WordIds:
    """Stored table `<word, n_texts, word_id>`; marks have reserved ids."""

    table: DataFrame


def word_lists(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """`<id, words>`, stored: the words of each text, found once for all that reads them."""
    return materialize(df.select(id_col, words(F.col(text_col)).alias("words")), "word-lists")


def fit_word_ids(lists: DataFrame, seed=0) -> WordIds:
    """Number the distinct words in `<.., words>` 7, 8, ... in md5 order, which needs no global sort."""
    found = lists.select(F.explode(F.array_distinct("words")).alias("word"))
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n_texts"))
    plain = materialize(counted.filter(~F.col("word").isin(list(RESERVED))), "distinct-words")
    numbered = with_position(plain, "word", seed).select(
        "word", "n_texts", (F.col("pos") + FIRST_WORD_ID).alias("word_id")
    )
    return WordIds(materialize(numbered, "words"))


def encode_fixed(ids: WordIds, lists: DataFrame, id_col: str = "id", max_length=MAX_LENGTH):
    """`<id, input_ids, attention_mask>` from `<id, words>`, both exactly `max_length` long.

    A text is start, its words, end, then padding; longer texts are cut to fit, which is what a
    fixed length means. Unseen words share one id, as do all words of rows without an id. Each place of a text looks its word up,
    at most `max_length` of them, and a row is put together by its places.
    """
    # Stored with a number per row, since it is read for the lookup and for the rest.
    words = F.slice("words", 1, max_length - 2)
    placed = materialize(lists.select(id_col, F.monotonically_increasing_id().alias("_row"), words.alias("_words")), "placed-words")
    spread = placed.select("_row", F.posexplode("_words").alias("_at", "word"))
    is_mark = F.coalesce(F.col("word").isin(list(RESERVED)), F.lit(False))
    known = lookup_join(spread.filter(~is_mark), ids.table, "word", "left", counts="n_texts", spread_by="_row", stored=True)
    reserved = F.coalesce(*(F.when(F.col("word") == mark, number) for mark, number in RESERVED.items()))
    marks = spread.filter(is_mark).withColumn("word_id", reserved.cast("bigint"))
    ends = F.array(
        F.struct(F.lit(-1).alias("_at"), F.lit(START).cast("bigint").alias("word_id")),
        F.struct(F.size("_words").alias("_at"), F.lit(END).cast("bigint").alias("word_id")),
    )
    ends = placed.select("_row", F.struct(id_col).alias("_id"), F.inline(ends))
    numbered = F.struct("_at", F.coalesce("word_id", F.lit(UNKNOWN).cast("bigint")).alias("word_id"))
    places = known.select("_row", "_at", "word_id").unionByName(marks.select("_row", "_at", "word_id"))
    rows = ends.unionByName(places, allowMissingColumns=True).groupBy("_row")
    rows = rows.agg(
        F.first("_id", ignorenulls=True)[id_col].alias(id_col),
        F.bool_or(F.col("_at").isNull()).alias("_none"),  # no list of words
        F.sort_array(F.collect_list(numbered))["word_id"].alias("_ids"),
    )
    unknown = F.transform("_ids", lambda x: F.when(x >= FIRST_WORD_ID, UNKNOWN).otherwise(x))
    body = F.when(~F.col("_none"), F.when(F.col(id_col).isNull(), unknown).otherwise(F.col("_ids")))
    padding = F.lit(max_length) - F.size("body")
    return rows.select(id_col, body.alias("body")).select(
        id_col,
        F.concat("body", F.array_repeat(F.lit(PAD), padding)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("body")), F.array_repeat(F.lit(0), padding)).alias("attention_mask"),
    )
