r"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are spans of four kinds that fixed rules find (e-mail, IP address, payment card, phone). Every seed, and every
other chain of six to 25 digits with single separators or word with an `@`, is an instance with lexical patterns: the word
before it, or up to two words behind it, each with its coarse class (an `@`, four numbers with dots, 16 to 19 digits, other
digits). Patterns and instances form a graph that Spark scores in `ROUNDS` rounds:

* a pattern's confidence for a kind is the mean score of its instances (a seed has 1, others what they have so far), if at
  least `MIN_SEEDS` different seeds, or instances that are found by now, support it; so each round adds patterns;
* an instance's score is that no pattern around it is wrong about it: 1 - prod(1 - confidence).

Instances above `MIN_SCORE` with a pattern above `MIN_SCORE` are found, and at the end become spans of that kind: a card
number with a wrong check digit after "card no", a phone without country code after "call". Seeds always stay; of a
chain that overlaps one, numbers without blanks are instances of their own.

Places come from the text itself: matches are fenced with a mark that no pattern can match, the text is split at the
marks, and lengths of the pieces add up to code point offsets. Patterns are written so that no text length leads to
deep recursion or repeated scans of one run of characters.

Only narrow rows are shuffled. A frequent pattern is summed up before the shuffle; its confidence is one row.

Defined cases: null and empty texts have no spans; rows with the same id and text give equal results; repeated rows
count once per pattern and value; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.registry import query, table
from llm.rows import join_rows, text_key
from tagloom.session import materialize, spread

KINDS = ["email", "ip", "card", "phone"]
ROUNDS = 3
MIN_SEEDS = 5
MIN_SCORE = 0.8
CUE_CHARS = 48  # characters before and behind an instance in which its cues are looked for

_MARK, _OTHER = "\x01", "\x02"
_LOCAL = r"[A-Za-z0-9._%+-]"
# The leftmost start in a run of characters is its first, or where the match before ended.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"
# A chain of digits with single separators that can't be longer to either side and has 16 to 19 digits.
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Anything around an @, and digits with up to a blank, a sign and a blank between two of them.
AROUND = r"[^\s\x22'<>()\[\],;:@]"
JOINT = r"\x20?[().\x2F-]?\x20?"
TOKEN = (
    rf"(?<!{AROUND}){AROUND}++@{AROUND}*[0-9\p{{L}}]"
    rf"|(?<![0-9A-Za-z_@])(?<![0-9][\x20().\x2F-])(?:\+\x20?)?(?:\((?=[0-9]{{1,8}}\)))?[0-9](?:{JOINT}[0-9]){{5,24}}+"
    rf"(?![A-Za-z_@])(?!{JOINT}[0-9])"
)
# The same without blanks, for numbers side by side that are no chain of that length or touch a seed.
ALONE = r"(?<![^\s\x22'=:(\[])[0-9](?:[().\x2F-]?[0-9]){5,24}+(?![^\s\x22',;:!?.)\]])(?![.][0-9])"

_SPAN = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))

    def weight(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    places = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(F.transform(places, weight), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def _valid_ip(value: Column) -> Column:
    def small(part):
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) <= 3) & (_int(bare) <= 255)

    return F.forall(F.split(value, r"\."), small)


def _int(digits: Column) -> Column:
    return F.when(digits == "", F.lit(0)).otherwise(F.substring(digits, 1, 3).cast("int"))


def _valid_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


_RULES = {
    "email": (EMAIL, "@", None),
    "ip": (IP, r"[0-9]\.[0-9]", _valid_ip),
    "card": (CARD, r"[0-9](?:[\x20-]?[0-9]){15}", _luhn),
    "phone": (PHONE, r"\+[0-9]", _valid_phone),
}


def _found(text: Column, pattern: str) -> Column:
    """Matches as `<start, end, value, before, after>`, offsets in code points."""
    fenced = F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}")
    pieces = F.split(fenced, _MARK)  # every match has a piece behind it, which may be empty
    state = F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.lit("").alias("before"),
        F.lit(None).cast("string").alias("value"),
        F.lit(False).alias("inside"),
        F.array().cast(_SPAN).alias("found"),
    )

    def step(acc, piece):
        span = F.struct(
            (acc["at"] - F.length(acc["value"])).alias("start"),
            acc["at"].alias("end"),
            acc["value"].alias("value"),
            F.right(acc["before"], F.lit(CUE_CHARS)).alias("before"),
            F.left(piece, F.lit(CUE_CHARS)).alias("after"),
        )
        ended = ~acc["inside"] & acc["value"].isNotNull()
        return F.struct(
            (acc["at"] + F.length(piece)).alias("at"),
            F.when(acc["inside"], acc["before"]).otherwise(piece).alias("before"),
            F.when(acc["inside"], piece).alias("value"),
            (~acc["inside"]).alias("inside"),
            F.when(ended, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(pieces, state, step, lambda acc: acc["found"])


def _seeds(found: Column, kind: int, valid) -> Column:
    if valid is not None:
        found = F.filter(found, lambda x: valid(x["value"]))
    return F.transform(
        found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"], x["end"], x["value"], x["before"], x["after"])
    )


def base_spans(documents: DataFrame) -> DataFrame:
    """`<doc_id, text_key, seeds, others>`: seeds `<kind, start, end, value, before, after>` in order of kind and
    start, and the other instances."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast(_SPAN)
    kinds = []
    for number, name in enumerate(KINDS):
        pattern, needs, valid = _RULES[name]
        found = F.when(F.col("text").rlike(needs), _found(F.col("text"), pattern)).otherwise(none)
        kinds.append(_seeds(found, number, valid))
    seeded = documents.select("doc_id", text_key().alias("text_key"), text.alias("text")).select(
        "doc_id",
        "text_key",
        F.concat(*kinds).alias("seeds"),
        F.when(F.col("text").rlike("[0-9@]"), _found(F.col("text"), TOKEN)).otherwise(none).alias("tokens"),
        F.when(F.col("text").rlike("[0-9]"), _found(F.col("text"), ALONE)).otherwise(none).alias("alone"),
    )

    def free(spans, of):
        return F.filter(spans, lambda t: ~F.exists(of, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))

    seeded = seeded.withColumns({"tokens": free("tokens", "seeds"), "alone": free("alone", "seeds")})
    others = F.concat("tokens", free("alone", "tokens"))
    return seeded.select("doc_id", "text_key", "seeds", others.alias("others"))


def _patterns(span: Column) -> Column:
    """The word before, and up to two words behind, each with the class of the value; none where there is no word."""
    before = F.lower(F.regexp_extract(span["before"], r"([^\s\x22'(\[]+)[\s\x22'(\[]*\z", 1))
    after = F.lower(F.regexp_extract(span["after"], r"\A[\s\x22'),.;:!?\]]*([^\s\x22']+(?:\s+[^\s\x22']+)?)", 1))
    n = F.length(_digits(span["value"]))
    kind = (
        F.when(F.contains(span["value"], F.lit("@")), "@")
        .when(span["value"].rlike(r"\A[0-9]+(?:\.[0-9]+){3}\z"), "9.9.9.9")
        .when(n.between(16, 19), "16")
        .otherwise("9")
    )
    both = F.array(F.when(before != "", F.concat(before, F.lit(" < "), kind)), F.when(after != "", F.concat(kind, F.lit(" > "), after)))
    return F.array_compact(both)


def discovered(scanned: DataFrame) -> DataFrame:
    """`<doc_id, text_key, more>`: unseen instances that confident patterns find, per document."""
    seeds = scanned.select(F.explode("seeds").alias("s")).select(
        F.col("s.kind").alias("kind"), F.col("s.value").alias("value"), F.explode(_patterns(F.col("s"))).alias("pattern")
    )
    others = scanned.select("doc_id", "text_key", F.explode("others").alias("s")).select(
        "doc_id", "text_key", "s.start", "s.end", F.col("s.value").alias("value"), F.explode(_patterns(F.col("s"))).alias("pattern")
    )
    others = materialize(others, "instances")
    edges = materialize(others.select("pattern", "value").distinct(), "edges")
    totals = edges.groupBy("pattern").agg(F.count("*").alias("n_others"))
    seeded = seeds.distinct().groupBy("pattern", "kind").agg(F.count("*").alias("n_seeds"))
    # A pattern without other instances finds none.
    seeded = materialize(seeded.join(totals.select("pattern"), "pattern", "left_semi"), "patterns")
    scores = None
    for _ in range(ROUNDS):
        if scores is None:
            gained = seeded.withColumns({"gain": F.lit(0.0), "n_found": F.lit(0)})
        else:
            sums = edges.join(scores, "value").groupBy("pattern", "kind")
            sums = sums.agg(F.sum("score").alias("gain"), F.sum(F.col("found").cast("int")).alias("n_found"))
            gained = seeded.join(sums, ["pattern", "kind"], "full").fillna(0, ["n_seeds", "gain", "n_found"])
        supported = gained.filter(F.col("n_seeds") + F.col("n_found") >= MIN_SEEDS).join(totals, "pattern")
        confidence = supported.select(
            "pattern", "kind", ((F.col("n_seeds") + F.col("gain")) / (F.col("n_seeds") + F.col("n_others"))).alias("c")
        )
        confidence = materialize(confidence, "confidence")
        score = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("c"), F.lit(1e-9)))))
        scores = edges.join(confidence, "pattern").groupBy("value", "kind")
        scores = scores.agg(score.alias("score"), ((score >= MIN_SCORE) & (F.max("c") >= MIN_SCORE)).alias("found"))
        scores = materialize(scores, "instance-scores")
    best = (
        others.join(confidence.filter(F.col("c") >= MIN_SCORE), "pattern")
        .join(scores.filter("found"), ["value", "kind"])
        .groupBy("doc_id", "text_key", "start", "end")
        .agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.first("value").alias("value"))
    )
    return best.groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_set(F.struct("kind", "start", "end", "value"))).alias("more")
    )


def personal_data(documents: DataFrame) -> DataFrame:
    """`<doc_id, text_key, base, spans>` per row of `<doc_id, text>`: arrays of `<kind, start, end>`, kind as its number in
    KINDS, ordered by kind and start; `spans` has all of `base`."""
    scanned = materialize(base_spans(documents), "personal-data")
    joined = join_rows(scanned.drop("others"), discovered(scanned), ["doc_id", "text_key"])
    plain = "array<struct<kind:int,start:bigint,end:bigint>>"

    def bare(column):
        return F.transform(
            column, lambda x: F.struct(x["kind"].cast("int").alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
        ).cast(plain)

    none = F.array().cast(plain)
    return joined.select(
        "doc_id",
        "text_key",
        F.array_sort(bare("seeds")).alias("base"),
        F.array_sort(F.concat(bare("seeds"), F.coalesce(bare("more"), none))).alias("spans"),
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with personal data replaced by its kind in brackets.

    Spans that overlap are masked as one, from the first start to the last end, by the kind of the longest of them (the
    first of equals). Spans that only touch stay apart. One pass holds one union until a span begins behind it.
    """
    ordered = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    names = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS])
    zero = F.lit(0).cast("bigint")
    state = F.struct(
        F.lit("").alias("out"),
        zero.alias("at"),
        zero.alias("start"),
        zero.alias("end"),
        F.lit(0).alias("kind"),
        zero.alias("longest"),
    )

    def closed(acc):
        """The text up to the end of the union that is held."""
        between = F.substring(text, (acc["at"] + 1).cast("int"), (acc["start"] - acc["at"]).cast("int"))
        return F.when(acc["longest"] > 0, F.concat(acc["out"], between, F.get(names, acc["kind"]))).otherwise(acc["out"])

    def step(acc, s):
        joins = s["start"] < acc["end"]
        size = s["end"] - s["start"]
        wins = ~joins | (size > acc["longest"])
        return F.struct(
            F.when(joins, acc["out"]).otherwise(closed(acc)).alias("out"),
            F.when(joins, acc["at"]).otherwise(acc["end"]).alias("at"),
            F.when(joins, acc["start"]).otherwise(s["start"]).alias("start"),
            F.when(joins, F.greatest(acc["end"], s["end"])).otherwise(s["end"]).alias("end"),
            F.when(wins, s["kind"]).otherwise(acc["kind"]).alias("kind"),
            F.when(wins, size).otherwise(acc["longest"]).alias("longest"),
        )

    def finish(acc):
        return F.concat(closed(acc), F.substring(text, (acc["end"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(ordered) > 0, F.aggregate(ordered, state, step, finish)).otherwise(text)


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")


@query("op8_pii")
def op8_pii(spark, folder):
    found = personal_data(spread(table(spark, folder, "documents", "doc_id", "text")))
    return found.select(
        "doc_id",
        *[_count(kind) for kind in KINDS],
        F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed("spans").alias("spans"),
    )
