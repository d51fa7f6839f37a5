"""Samples, splits and cold starts on the labelled documents."""

from pyspark.sql import functions as F

from tagloom.operators.sampling import (
    budget_sample,
    class_sizes,
    cold_start,
    flag_al_validation,
    flag_sl_validation,
    flag_test,
    head,
    shuffled,
    split_data,
)
from tagloom.operators.clean import clean_rows
from tagloom.plans.corpus import add_weak_label
from tagloom.session import materialize
from workload.registry import KEYWORDS, LABELLED, labelled_documents, query, sql_density, sql_key, sql_rank, table, texts

SEED = 7


def sql_budget_sample(share: float) -> str:
    """As many rows as there are positives, at the given share of negatives."""
    seed = f"{SEED}:{share}"
    return f"""
    SELECT id, label, text, {sql_rank('id', f'{seed}:order')} - 1 AS pos FROM (
      SELECT *, {sql_rank('id', seed, 'label')} AS place, count(*) FILTER (WHERE label = 1) OVER () AS budget
      FROM ({LABELLED}))
    WHERE place <= CASE label WHEN 0 THEN floor({share}::DOUBLE * budget)
                              ELSE budget - floor({share}::DOUBLE * budget) END"""


def _budget_sample(share: float):
    def run(spark, folder):
        rows = labelled_documents(spark, folder)
        budget = class_sizes(rows, "label")[1]
        return budget_sample(rows, budget, share, SEED).select("id", "label", "text", "pos")

    return run


for _share in (0.5, 0.9, 0.95):
    _name = f"budget_sample_{100 - int(_share * 100)}"
    query(_name, sql_budget_sample(_share))(_budget_sample(_share))


@query(
    "head_per_test_set",
    " UNION ALL ".join(
        f"SELECT 'test_{100 - int(share * 100)}' AS test_set, id, label, pos FROM ({sql_budget_sample(share)}) WHERE pos < 8"
        for share in (0.5, 0.9, 0.95)
    ),
)
def head_per_test_set(spark, folder):
    parts = []
    for share in (0.5, 0.9, 0.95):
        sample = _budget_sample(share)(spark, folder)
        parts.append(sample.select(F.lit(f"test_{100 - int(share * 100)}").alias("test_set"), "id", "label", "pos"))
    return head(parts[0].unionByName(parts[1]).unionByName(parts[2]), 8)


@query("shuffled_positions", f"SELECT doc_id, {sql_rank('doc_id', 'x')} - 1 AS pos FROM documents")
def shuffled_positions(spark, folder):
    return shuffled(table(spark, folder, "documents").select("doc_id"), "x", "doc_id")


@query(
    "random_split",
    f"SELECT doc_id, {sql_rank('doc_id', '42')} <= ceil(0.101::DOUBLE * count(*) OVER ()) AS is_test FROM documents",
)
def random_split(spark, folder):
    return flag_test(table(spark, folder, "documents").select("doc_id"), id_col="doc_id")


@query(
    "split_random",
    f"""SELECT id, label, {sql_rank('id', str(SEED))} > floor(count(*) OVER () * 0.9::DOUBLE) AS is_valid FROM ({LABELLED})""",
)
def split_random(spark, folder):
    return split_data(labelled_documents(spark, folder).select("id", "label"), "random", seed=SEED)


def sql_class_split(quota: str) -> str:
    return f"""
    WITH base AS ({LABELLED}),
    sizes AS (SELECT label, count(*) AS size FROM base WHERE label IS NOT NULL GROUP BY label),
    wanted AS (SELECT label, size, sum(size) OVER () AS total, count(*) OVER () AS classes,
               (sum(size) OVER () - floor(sum(size) OVER () * 0.9::DOUBLE))::BIGINT AS wanted FROM sizes),
    parts AS (SELECT *, {quota} FROM wanted),
    quotas AS (SELECT label, part + (CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
               <= wanted - sum(part) OVER () THEN 1 ELSE 0 END) AS n FROM parts)
    SELECT id, label, {sql_rank('id', str(SEED), 'label')} <= n AS is_valid FROM base JOIN quotas USING (label)"""


@query("split_stratified", sql_class_split("(wanted * size) // total AS part, (wanted * size) % total AS rest"))
def split_stratified(spark, folder):
    return split_data(labelled_documents(spark, folder).select("id", "label"), "stratified", seed=SEED)


@query("split_balanced", sql_class_split("wanted // classes AS part, 0 AS rest"))
def split_balanced(spark, folder):
    return split_data(labelled_documents(spark, folder).select("id", "label"), "balanced", seed=SEED)


def _weak(spark, folder):
    rows = add_weak_label(labelled_documents(spark, folder, texts), KEYWORDS, 0.01)
    return rows.select("id", "label", F.col("weak_pos_keywords").alias("weak_label"))


WEAK = f"SELECT id, label, ({sql_density('text')} > 0.01)::INT AS weak_label FROM ({LABELLED})"
INIT_N = 20


@query(
    "cold_true_random",
    f"SELECT id, label FROM ({LABELLED}) WHERE label IN (0, 1) QUALIFY {sql_rank('id', str(SEED))} <= {INIT_N}",
)
def cold_true_random(spark, folder):
    return cold_start(labelled_documents(spark, folder).select("id", "label"), "TrueRandom", INIT_N, SEED)


BALANCED = f"SELECT id, label FROM ({LABELLED}) QUALIFY {sql_rank('id', str(SEED), 'label')} <= {INIT_N // 2}"


@query("cold_balanced_true", BALANCED)
def cold_balanced_true(spark, folder):
    return cold_start(labelled_documents(spark, folder).select("id", "label"), "BalancedRandom", INIT_N, SEED)


def sql_cold_weak(n: int) -> str:
    """`n` may be larger than twice the weak positives: then negatives fill up."""
    return f"""
    SELECT id, label, weak_label FROM (
      SELECT *, {sql_rank('id', str(SEED), 'weak_label')} AS place, sum(weak_label) OVER () AS weak_pos FROM ({WEAK}))
    WHERE place <= CASE WHEN weak_label = 1 THEN least({n // 2}, weak_pos)
                        WHEN weak_pos > {n // 2} THEN {n // 2} ELSE {n} - weak_pos END"""


@query("cold_balanced_weak", sql_cold_weak(INIT_N))
def cold_balanced_weak(spark, folder):
    return cold_start(materialize(_weak(spark, folder), "weak"), "BalancedWeak", INIT_N, SEED)


@query("cold_balanced_weak_filled", sql_cold_weak(80))
def cold_balanced_weak_filled(spark, folder):
    return cold_start(materialize(_weak(spark, folder), "weak"), "BalancedWeak", 80, SEED)


@query(
    "al_validation",
    f"SELECT id, label, {sql_rank('id', f'{SEED}:valid', 'label')} <= 1 AS is_valid FROM ({BALANCED})",
)
def al_validation(spark, folder):
    initial = cold_balanced_true(spark, folder)
    return flag_al_validation(initial, INIT_N, SEED)


@query(
    "sl_validation",
    f"""SELECT id, label, {sql_rank('id', f'{SEED}:valid', 'label')}
      <= floor(0.1::DOUBLE * count(*) OVER (PARTITION BY label)) AS is_valid FROM ({LABELLED})""",
)
def sl_validation(spark, folder):
    return flag_sl_validation(labelled_documents(spark, folder).select("id", "label"), SEED)
