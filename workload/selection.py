"""Query strategies and pool joins on the embeddings."""

from pyspark.sql import functions as F

from tagloom.operators.experiments import map_predictions
from tagloom.operators.kmeans import OVERSAMPLING, START_ROUNDS
from tagloom.operators.metrics import set_scores
from tagloom.operators.ordering import take_first
from tagloom.operators.select import (
    coreset_query,
    dot,
    extend,
    kmeans_query,
    least_confident,
    mean_vectors,
    nearest_to_centre,
    random_query,
    reveal,
    rows_by_id,
    unit,
    unlabelled,
)
from workload.registry import query, sql_cells, sql_key, sql_rank, sql_scores, table

N_LABELLED, N_QUERY = 60, 25
LABELLED_IDS = f"SELECT vec_id FROM embeddings QUALIFY {sql_rank('vec_id', 'start')} <= {N_LABELLED}"
POOL = f"SELECT * FROM embeddings WHERE vec_id NOT IN ({LABELLED_IDS})"


def _vectors(spark, folder):
    return table(spark, folder, "embeddings")


def _labelled(vectors):
    return take_first(vectors, "vec_id", "start", N_LABELLED)


def _pool(vectors):
    return unlabelled(vectors, _labelled(vectors), "vec_id")


PICKED = f"SELECT vec_id FROM ({POOL}) QUALIFY {sql_rank('vec_id', 'next')} <= {N_QUERY}"


@query("query_random", PICKED)
def query_random(spark, folder):
    return random_query(_pool(_vectors(spark, folder)).select("vec_id"), N_QUERY, "next", "vec_id")


@query("rows_by_ids", f"SELECT vec_id, label FROM embeddings WHERE vec_id IN ({LABELLED_IDS})")
def rows_by_ids(spark, folder):
    vectors = _vectors(spark, folder).select("vec_id", "label")
    return rows_by_id(vectors, _labelled(vectors.select("vec_id")), "vec_id")


@query(
    "pool_update",
    f"""SELECT vec_id, 'labelled' AS part FROM ({LABELLED_IDS}) UNION ALL SELECT vec_id, 'labelled' FROM ({PICKED})
    UNION ALL SELECT vec_id, 'pool' FROM ({POOL}) WHERE vec_id NOT IN ({PICKED})""",
)
def pool_update(spark, folder):
    ids = _vectors(spark, folder).select("vec_id")
    labelled = extend(_labelled(ids), random_query(_pool(ids), N_QUERY, "next", "vec_id"))
    rest = unlabelled(ids, labelled, "vec_id")
    return labelled.withColumn("part", F.lit("labelled")).unionByName(rest.withColumn("part", F.lit("pool")))


@query("reveal_labels", f"SELECT vec_id, label FROM ({PICKED}) JOIN embeddings USING (vec_id)")
def reveal_labels(spark, folder):
    vectors = _vectors(spark, folder)
    picked = random_query(_pool(vectors).select("vec_id"), N_QUERY, "next", "vec_id")
    return reveal(picked, vectors.select("vec_id", "label"), "vec_id")


CENTRES = """
  SELECT {by} AS cls, place, avg(x::DOUBLE) AS x FROM (SELECT *, unnest(embedding) AS x,
    generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY ALL"""


@query(
    "query_least_confidence",
    f"""WITH centres AS ({CENTRES.format(by='(label < 5)::INT')}),
    w AS (SELECT place, sum(CASE cls WHEN 1 THEN x ELSE -x END) AS w FROM centres GROUP BY place),
    scored AS (SELECT vec_id, abs(sum(x::DOUBLE * w)) AS confidence
      FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM ({POOL})) JOIN w USING (place)
      GROUP BY vec_id)
    SELECT vec_id, round(confidence, 6) AS confidence FROM scored ORDER BY scored.confidence, vec_id LIMIT {N_QUERY}""",
)
def query_least_confidence(spark, folder):
    vectors = _vectors(spark, folder)
    classes = vectors.select((F.col("label") < 5).cast("int").alias("cls"), "embedding")
    centres = {row["cls"]: row["centre"] for row in mean_vectors(classes, "cls", "embedding").collect()}  # two rows
    weights = F.array(*(F.lit(a - b) for a, b in zip(centres[1], centres[0])))
    scored = _pool(vectors).select("vec_id", F.abs(dot(F.col("embedding"), weights)).alias("confidence"))
    return least_confident(scored, N_QUERY, id_col="vec_id").withColumn("confidence", F.round("confidence", 6))


@query(
    "set_scores",
    f"""WITH centres AS ({CENTRES.format(by='(label < 5)::INT')}),
    w AS (SELECT place, sum(CASE cls WHEN 1 THEN x ELSE -x END) AS w FROM centres GROUP BY place),
    scored AS (SELECT vec_id, label, sum(x::DOUBLE * w) > 0 AS positive
      FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings)
      JOIN w USING (place) GROUP BY vec_id, label),
    rows AS (SELECT concat('test_', vec_id % 4) AS test_set, (label < 5)::INT AS label, positive::INT AS prediction FROM scored)
    SELECT test_set, round(f1_macro, 6) AS f1, round((tp + fn)::DOUBLE / (tn + fp + fn + tp), 6) AS imbalance,
      tn + fp + fn + tp AS n
    FROM ({sql_scores(f"SELECT test_set, {sql_cells('label', 'prediction')} FROM rows GROUP BY test_set", 'test_set')})""",
)
def set_scores_embeddings(spark, folder):
    """A fixed linear model, the difference of the class means, scored on four test sets at once."""
    vectors = _vectors(spark, folder)
    positive = (F.col("label") < 5).cast("int")
    centres = mean_vectors(vectors.select(positive.alias("cls"), "embedding"), "cls", "embedding").collect()  # two rows
    centres = {row["cls"]: row["centre"] for row in centres}
    weights = F.array(*(F.lit(a - b) for a, b in zip(centres[1], centres[0])))
    rows = vectors.select(
        F.concat(F.lit("test_"), (F.col("vec_id") % 4).cast("string")).alias("test_set"),
        positive.alias("label"),
        (dot(F.col("embedding"), weights) > 0).cast("int").alias("prediction"),
    )
    return set_scores(rows).withColumns({name: F.round(name, 6) for name in ("f1", "imbalance")})


@query(
    "nearest_to_centre",
    f"""WITH centres AS ({CENTRES.format(by='label')}),
    gaps AS (SELECT vec_id, label, sqrt(sum((p.x::DOUBLE - c.x) * (p.x::DOUBLE - c.x))) AS distance
      FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) p
      JOIN centres c ON p.label = c.cls AND p.place = c.place GROUP BY ALL)
    SELECT label, vec_id, round(distance, 6) AS distance FROM gaps
    QUALIFY row_number() OVER (PARTITION BY label ORDER BY gaps.distance, vec_id) = 1""",
)
def nearest_to_centre_labels(spark, folder):
    vectors = _vectors(spark, folder)
    centres = mean_vectors(vectors, "label", "embedding")
    nearest = nearest_to_centre(vectors, centres, "label", "embedding", "vec_id")
    return nearest.withColumn("distance", F.round("distance", 6))


KMEANS_ROUNDS = 6


def kmeans_steps(pool: str, k: int, seed: int, rounds: int, x: str = "") -> list[str]:
    """The oversampled start, its thinning and all rounds, one relation after the other, without any bounds, up to
    `{x}picks`. Names begin with `x`."""
    more = OVERSAMPLING * k
    draw = "(('0x' || md5(concat_ws(':', vec_id, '{}'))[1:13])::BIGINT + 1)::DOUBLE / 4503599627370496::DOUBLE"
    steps = [
        f"""{x}units AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE /
          sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM ({pool}))""",
        f"{x}c0 AS MATERIALIZED (SELECT * FROM {x}units ORDER BY {sql_key('vec_id', str(seed))}, vec_id LIMIT 1)",
    ]
    for i in range(START_ROUNDS):
        steps.append(f"""{x}g{i} AS (SELECT u.vec_id, any_value(u.v) AS v, min(list_distance(u.v, c.v)) AS gap FROM {x}units u, {x}c{i} c GROUP BY u.vec_id)""")
        steps.append(f"""{x}c{i + 1} AS MATERIALIZED (SELECT * FROM {x}c{i} UNION ALL (SELECT vec_id, v FROM {x}g{i} WHERE gap > 1e-9
          ORDER BY ln({draw.format(f'{seed}:{i}')}) / (gap * gap) DESC, vec_id LIMIT {more}))""")
    last = f"{x}c{START_ROUNDS}"
    steps.append(f"""{x}near AS (SELECT u.vec_id, arg_min(c.vec_id, (list_distance(u.v, c.v), c.vec_id)) AS c FROM {x}units u, {last} c GROUP BY u.vec_id)""")
    steps.append(f"{x}weighted AS MATERIALIZED (SELECT c.vec_id, c.v, count(n.c)::DOUBLE AS w FROM {last} c LEFT JOIN {x}near n ON n.c = c.vec_id GROUP BY ALL)")
    steps.append(f"{x}t0 AS MATERIALIZED (SELECT *, 0 AS cluster FROM {x}weighted ORDER BY w DESC, vec_id LIMIT 1)")
    steps.append(f"{x}d0 AS MATERIALIZED (SELECT w.*, list_distance(w.v, t.v) ** 2 AS gap FROM {x}weighted w, {x}t0 t)")
    for i in range(1, k):
        steps.append(f"{x}t{i} AS MATERIALIZED (SELECT vec_id, v, w, {i} AS cluster FROM {x}d{i - 1} ORDER BY round(w * gap, 9) DESC, vec_id LIMIT 1)")
        steps.append(f"{x}d{i} AS MATERIALIZED (SELECT d.* EXCLUDE (gap), least(gap, list_distance(d.v, t.v) ** 2) AS gap FROM {x}d{i - 1} d, {x}t{i} t)")
    steps.append(f"{x}m0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT cluster, v FROM {x}t{i}" for i in range(k)) + ")")
    for i in range(rounds + 1):
        steps.append(f"""{x}a{i} AS MATERIALIZED (SELECT u.vec_id, any_value(u.v) AS v, arg_min(m.cluster, (list_distance(u.v, m.v), m.cluster)) AS cluster
          FROM {x}units u, {x}m{i} m GROUP BY u.vec_id)""")
        steps.append(f"""{x}p{i} AS (SELECT cluster, place, avg(x) AS x FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place
          FROM {x}a{i}) GROUP BY ALL)""")
        steps.append(f"""{x}m{i + 1} AS MATERIALIZED (SELECT m.cluster, coalesce(any_value(n.v), any_value(m.v)) AS v FROM {x}m{i} m
          LEFT JOIN (SELECT cluster, list(x ORDER BY place) AS v FROM {x}p{i} GROUP BY cluster) n USING (cluster) GROUP BY m.cluster)""")
    steps.append(f"""{x}picks AS MATERIALIZED (SELECT arg_min(a.vec_id, (list_distance(a.v, m.v), a.vec_id)) AS vec_id
      FROM {x}a{rounds} a JOIN {x}m{rounds} m USING (cluster) GROUP BY a.cluster)""")
    return steps


def sql_kmeans() -> str:
    steps = kmeans_steps(POOL, N_QUERY, 1, KMEANS_ROUNDS)
    return f"WITH {', '.join(steps)} SELECT vec_id, label FROM embeddings WHERE vec_id IN (FROM picks)"


@query("query_kmeans", sql_kmeans())
def query_kmeans(spark, folder):
    pool = _pool(_vectors(spark, folder))
    return kmeans_query(pool, N_QUERY, 1, "embedding", "vec_id", max_iter=KMEANS_ROUNDS).select("vec_id", "label")


N_CORESET = 50


def coreset_steps(pool: str, labelled: str, n: int, x: str = "") -> list[str]:
    """Greedy picks one after the other, each a farthest point given all before it, up to `{x}picks`."""
    unit = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))"
    steps = [
        f"{x}units AS MATERIALIZED (SELECT vec_id, {unit} AS v FROM ({pool}))",
        f"{x}labelled AS MATERIALIZED (SELECT vec_id, {unit} AS v FROM ({labelled}))",
        f"{x}d0 AS MATERIALIZED (SELECT p.vec_id, any_value(p.v) AS v, min(list_distance(p.v, l.v)) AS d "
        f"FROM {x}units p, {x}labelled l GROUP BY p.vec_id)",
    ]
    for i in range(n):
        steps.append(f"{x}p{i} AS MATERIALIZED (SELECT vec_id, v FROM {x}d{i} ORDER BY round(d, 9) DESC, vec_id LIMIT 1)")
        steps.append(
            f"{x}d{i + 1} AS MATERIALIZED (SELECT d.vec_id, d.v, least(d.d, list_distance(d.v, p.v)) AS d FROM {x}d{i} d, {x}p{i} p "
            f"WHERE d.vec_id <> p.vec_id)"
        )
    picks = " UNION ALL ".join(f"SELECT vec_id, {i} AS picked_rank FROM {x}p{i}" for i in range(n))
    return [*steps, f"{x}picks AS MATERIALIZED ({picks})"]


def sql_coreset() -> str:
    steps = coreset_steps(POOL, f"SELECT * FROM embeddings WHERE vec_id IN ({LABELLED_IDS})", N_CORESET)
    return f"WITH {', '.join(steps)} FROM picks"


@query("query_coreset", sql_coreset())
def query_coreset(spark, folder):
    vectors = _vectors(spark, folder)
    return coreset_query(_pool(vectors), _labelled(vectors), N_CORESET, "embedding", "vec_id")


@query(
    "unit_vectors",
    """SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
      round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first_part
    FROM embeddings""",
)
def unit_vectors(spark, folder):
    vector = F.col("embedding")
    return _vectors(spark, folder).select(
        "vec_id",
        F.round(F.sqrt(dot(vector, vector)), 6).alias("norm"),
        F.round(unit(vector)[0], 6).alias("first_part"),
    )


@query(
    "map_predictions",
    """SELECT r.run, e.vec_id, r.prediction, e.label FROM (
      SELECT vec_id AS run, vec_id + generate_subscripts(embedding, 1) - 1 AS id,
        (unnest(embedding) > 0)::INT AS prediction FROM embeddings) r JOIN embeddings e ON e.vec_id = r.id""",
)
def map_predictions_embeddings(spark, folder):
    """Signs of the vector parts as predictions for the following rows: parallel arrays of fixed length."""
    vectors = _vectors(spark, folder)
    first = F.col("vec_id")
    records = vectors.select(
        first.alias("run"),
        F.sequence(first, first + F.size("embedding") - 1).alias("ids"),
        F.transform("embedding", lambda x: (x > 0).cast("int")).alias("predictions"),
    )
    return map_predictions(records, "ids", "predictions", vectors.select("vec_id", "label"), "vec_id")
