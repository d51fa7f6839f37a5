"""Registry of queries, table access, and SQL fragments used by several of them."""

from tagloom.functions.text import BLANK, COMMON_ENTITIES, EMOJI_CLASS
from tagloom.session import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}

# The words that mark toxic text in the `documents` table.
KEYWORDS = "trash clown idiot scum worthless moron pathetic loser disgusting stupid".split()


def query(name: str, sql: str | None = None):
    """Register a function of (spark, folder) under `name`, with its SQL if it has one."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark, folder: str, name: str = "documents", key: str = "doc_id"):
    """A text table, on all task slots even if it is one small file."""
    return spread(table(spark, folder, name), key)


def labelled_documents(spark, folder: str, source=table):
    """`<id, text, label>`: the documents that have a label. `source=texts` for work on the text."""
    documents = source(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").selectExpr("doc_id", "toxic AS label")
    return documents.join(labels, "doc_id").withColumnRenamed("doc_id", "id")


LABELLED = "SELECT d.doc_id AS id, d.text, l.toxic AS label FROM documents d JOIN labels l USING (doc_id)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_key(id_expr: str, seed: str) -> str:
    """The md5 order key."""
    return f"md5(concat_ws(':', {id_expr}, '{seed}'))"


def sql_rank(id_expr: str, seed: str, by: str = "") -> str:
    """1-based place in the md5 order, per group if `by` is given."""
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {sql_key(id_expr, seed)}, {id_expr})"


def sql_entities(expr: str) -> str:
    for entity, char in COMMON_ENTITIES:
        expr = f"replace({expr}, {quote(entity)}, {quote(char)})"
    return expr


def sql_clean(expr: str) -> str:
    """The cleaning steps one by one, without the shortcuts of the library."""

    def sub(inner: str, pattern: str, new: str) -> str:
        return f"regexp_replace({inner}, {quote(pattern)}, {quote(new)}, 'g')"

    expr = sql_entities(expr)
    expr = sub(expr, "@[A-Za-z0-9_-]+", "[USER]")
    expr = sub(expr, f"http[^{BLANK}]+", "[URL]")
    expr = sub(expr, EMOJI_CLASS, " [EMOJI] ")
    expr = sub(expr, rf"\A[{BLANK}]+|[{BLANK}]+\z", "")
    expr = sub(expr, "MENTION[0-9]*", "[USER]")
    expr = f"translate({expr}, chr(10) || chr(9), '  ')"
    expr = f"ltrim({expr}, '>')"
    expr = sub(expr, f"[{BLANK}]+", " ")
    return sub(expr, rf"\A[{BLANK}]+|[{BLANK}]+\z", "")


def sql_matches(expr: str) -> str:
    words = "|".join(sorted(KEYWORDS, key=lambda word: (-len(word), word)))
    return f"regexp_extract_all({expr}, {quote(rf'\b(?:{words})\b')})"


def sql_density(expr: str) -> str:
    return f"(len({sql_matches(expr)})::DOUBLE / len(string_split({expr}, ' ')))"


def sql_scores(cells: str, keys: str, places: int | None = None) -> str:
    """Scores from a relation with tn, fp, fn, tp."""

    def r(expr: str) -> str:
        return expr if places is None else f"round_even(({expr})::DOUBLE * 1e{places}::DOUBLE, 0) / 1e{places}::DOUBLE"

    def part(top: str, bottom: str) -> str:
        return f"(CASE WHEN {bottom} = 0 THEN 0.0::DOUBLE ELSE ({top})::DOUBLE / ({bottom}) END)"

    has_pos, has_neg = "(tp + fn + fp > 0)", "(tn + fn + fp > 0)"

    def macro(pos: str, neg: str) -> str:
        total = f"(CASE WHEN {has_pos} THEN {pos} ELSE 0 END + CASE WHEN {has_neg} THEN {neg} ELSE 0 END)"
        return f"({total} / ({has_pos}::INT + {has_neg}::INT))"

    return f"""
    SELECT {keys}, tn, fp, fn, tp,
      {r(part('tn + tp', 'tn + fp + fn + tp'))} AS accuracy,
      {r(macro(part('tp', 'tp + fp'), part('tn', 'tn + fn')))} AS precision_macro,
      {r(part('tp', 'tp + fn'))} AS recall_pos,
      {r(macro(part('2 * tp', '2 * tp + fp + fn'), part('2 * tn', '2 * tn + fp + fn')))} AS f1_macro,
      {r('fp::DOUBLE / nullif(fp + tn, 0)')} AS fpr,
      {r('fn::DOUBLE / nullif(fn + tp, 0)')} AS fnr
    FROM ({cells})"""


def sql_cells(label: str, prediction: str) -> str:
    pairs = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return ", ".join(
        f"count(*) FILTER (WHERE {label} = {a} AND {prediction} = {b}) AS {name}" for name, (a, b) in pairs.items()
    )
