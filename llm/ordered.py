"""Places and running digests within groups of any size.

Rows are dealt by ranges of their order, so a group with a third of all rows lies on many tasks. Each task numbers its own
part; what the parts before it hold comes from one row per task, added to the group that a task's part begins with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import materialize


def _starts(column: pa.Array, last) -> np.ndarray:
    """Whether each value differs from the one before it; `last` is in front of the first, `...` differs from all."""
    n = len(column)
    out = np.zeros(n, bool)
    out[0] = last is ... or column[0].as_py() != last
    if n > 1:
        a, b = column.slice(0, n - 1), column.slice(1)
        differ = pc.fill_null(pc.not_equal(a, b), False)
        out[1:] = pc.or_(differ, pc.not_equal(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def _number(batches, group: str, digests: list[str]):
    """Places and running digests within the task, its number, and whether a row belongs to the task's first group."""
    pid = TaskContext.get().partitionId()
    last, carried, totals, first, at = ..., 0, [np.uint64(0)] * len(digests), True, 0
    for batch in batches:
        n = len(batch)
        if n == 0:
            continue
        starts = _starts(batch.column(group), last)
        begin = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
        place = np.where(begin < 0, np.arange(n) + carried, np.arange(n) - begin)
        running = []
        for k, name in enumerate(digests):
            values = batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64)
            total = np.bitwise_xor.accumulate(values)
            in_front = np.where(begin < 0, totals[k], (total ^ values)[np.maximum(begin, 0)])
            running.append(total ^ in_front)
            totals[k] = running[-1][-1]
        # The first group of the task goes on until the second start.
        opened = np.cumsum(starts) - (at == 0)
        head = (opened == 0) & first
        first = bool(head[-1])
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array(place, pa.int64()),
                *[pa.array(x.view(np.int64), pa.int64()) for x in running],
                pa.array(np.full(n, pid), pa.int32()),
                pa.array(np.arange(at, at + n), pa.int64()),
                pa.array(head),
            ],
            names=[*batch.schema.names, "place", *[f"{x}_running" for x in digests], "pid", "at", "head"],
        )
        last, carried, at = batch.column(group)[n - 1].as_py(), int(place[-1]) + 1, at + n


def running(df: DataFrame, group: str, order: list[str], digests: list[str] = ()) -> DataFrame:
    """`df` with `place`, counted from 0 within `group` in `order` (nulls first), and for each bigint column in `digests`
    `<name>_running`: the values up to and with the row, combined bit by bit with exclusive or.

    Null is a group like any other. Equal rows get places in some order. `df` should be a stored table, since ranges
    are found in a pass of their own.
    """
    spark = df.sparkSession
    digests = list(digests)
    keys = [group, *order, "salt"]  # the salt lets rows that are equal in all else go to several tasks
    sorted_rows = df.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    added = ["place bigint", *[f"{x}_running bigint" for x in digests], "pid int", "at bigint", "head boolean"]
    numbered = sorted_rows.drop("salt").mapInArrow(lambda batches: _number(batches, group, digests), ", ".join(kinds + added))
    numbered = materialize(numbered, "numbered")

    carried = ["place", *[f"{x}_running" for x in digests]]
    ends = numbered.groupBy("pid").agg(
        F.min_by(group, "at").alias("first"),
        F.max_by(F.struct(F.col(group).alias("group"), *carried), "at").alias("last"),
        F.min(F.col("head").cast("int")).alias("whole"),
    )
    before, held = [], None  # `held`: the group that the tasks so far end with, and what they hold of it
    for row in ends.orderBy("pid").collect():  # one row per task
        taken = held[1] if held is not None and held[0] == row["first"] else [0] * len(carried)
        if any(taken):
            before.append((row["pid"], *taken))
        own = [row["last"]["place"] + 1, *[row["last"][c] for c in carried[1:]]]
        if row["whole"]:
            own = [own[0] + taken[0], *[a ^ b for a, b in zip(own[1:], taken[1:], strict=True)]]
        held = (row["last"]["group"], own)
    fields = ", ".join(["pid int", *[f"before_{c} bigint" for c in carried]])
    offsets = F.broadcast(spark.createDataFrame(before, fields))  # one row per task at most
    joined = numbered.join(offsets, "pid", "left")
    moved = {}
    for c in carried:
        with_before = F.col(c) + F.col(f"before_{c}") if c == "place" else F.col(c).bitwiseXOR(F.col(f"before_{c}"))
        moved[c] = F.when(F.col("head") & F.col(f"before_{c}").isNotNull(), with_before).otherwise(F.col(c))
    return joined.withColumns(moved).select(*df.columns, *carried)
