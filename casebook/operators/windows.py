"""Window work that stays spread out when one key holds a large share of the rows.

``row_number() <= k`` needs nothing special: Spark keeps k rows per key in every task before the
shuffle. Anything else that reads neighbouring rows is done here per (key, block of the order
column), with the little that crosses a block edge carried over by per-block summaries. A block is
a range of the order column, so it follows from the data alone and a re-run task rebuilds it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows per key. The plan keeps k rows per key per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_row(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """One whole row per key, the first (or last) by ``order``; combined in the map tasks."""
    others = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*others), order)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in others])


def block_of(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width)).cast("bigint")


def numbered(df: DataFrame, keys: Sequence[str], order: str, width: int, name: str = "n") -> DataFrame:
    """Dense 1-based position per key along a numeric ``order`` column, plus its ``_block``."""
    keys = list(keys)
    blocks = df.withColumn("_block", block_of(F.col(order), width))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order))
    return (
        blocks.withColumn("_local", local)
        .join(offsets, [*keys, "_block"])
        .withColumn(name, (F.col("_offset") + F.col("_local")).cast("bigint"))
        .drop("_offset", "_local")
    )


def carried_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, width: int
) -> DataFrame:
    """The last non-null ``value`` at or before each row."""
    keys = list(keys)
    blocks = df.withColumn("_block", block_of(F.col(order), width)).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        blocks.groupBy(*keys, "_block")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_last"))
        .select(*keys, "_block", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    )
    within = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        blocks.withColumn("_within", F.last("_value", ignorenulls=True).over(within))
        .join(carry, [*keys, "_block"])
        .withColumn(name, F.coalesce("_within", "_carry"))
        .drop("_block", "_value", "_within", "_carry")
    )


def as_of(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Column, right_order: Column, value: Column, name: str, width: int
) -> DataFrame:
    """Each left row with the ``value`` of the latest right row of its keys at or before it, null where there is none.

    Both sides are merged along one numeric order, in blocks of ``width``; the latest value is carried into later blocks by
    per-block summaries, so a key that holds a third of either side is many tasks' work. Of right rows at one place the
    largest value counts. Null keys meet nothing.
    """
    keys = list(keys)
    # At one place right rows come first: doubled places leave room for that.
    events = right.select(*keys, (right_order.cast("bigint") * 2).alias("_at"), value.alias("_carried"))
    events = events.groupBy(*keys, "_at").agg(F.max("_carried").alias("_carried")).withColumn("_left", F.lit(None).cast(left.schema))
    asked = left.select(*keys, (left_order.cast("bigint") * 2 + 1).alias("_at"), F.lit(None).cast(events.schema["_carried"].dataType).alias("_carried"), F.struct("*").alias("_left"))
    merged = carried_forward(events.unionByName(asked), keys, "_at", F.col("_carried"), "_found", 2 * width)
    found = merged.filter("_left IS NOT NULL").select("_left.*", F.col("_found").alias(name))
    keyless = left.filter(reduce(Column.__or__, [F.col(k).isNull() for k in keys]))
    return found.unionByName(keyless.withColumn(name, F.lit(None).cast(found.schema[name].dataType)))


def with_preceding(
    df: DataFrame, keys: Sequence[str], order: str, payload: Column, size: int, name: str, width: int
) -> DataFrame:
    """The ``payload`` of the ``size`` rows before each row, oldest first.

    Rows are numbered densely, cut into blocks of that number, and the last ``size`` rows of a
    block are copied into the next one, so every frame is complete inside its block.
    """
    keys = list(keys)
    span = max(width, size)
    dense = numbered(df.withColumn("_payload", payload), keys, order, width, "_n").withColumn(
        "_span", F.floor((F.col("_n") - 1) / span)
    )
    near_end = (F.col("_n") - 1) % span >= span - size
    copies = F.when(near_end, F.array(F.struct(F.col("_span").alias("s"), F.lit(True).alias("own")),
                                      F.struct((F.col("_span") + 1).alias("s"), F.lit(False).alias("own"))))
    spread = dense.withColumn(
        "_copy", F.explode(copies.otherwise(F.array(F.struct(F.col("_span").alias("s"), F.lit(True).alias("own")))))
    ).withColumn("_span", F.col("_copy.s"))
    frame = Window.partitionBy(*keys, "_span").orderBy("_n").rowsBetween(-size, -1)
    return (
        spread.withColumn(name, F.collect_list("_payload").over(frame))
        .filter(F.col("_copy.own"))
        .drop("_payload", "_n", "_span", "_copy", "_block")
    )


def with_next(df: DataFrame, keys: Sequence[str], order: str, payload: Column, name: str, width: int) -> DataFrame:
    """The ``payload`` of the row after each row, null on a key's last row."""
    keys = list(keys)
    blocks = df.withColumn("_block", block_of(F.col(order), width)).withColumn("_payload", payload)
    after = Window.partitionBy(*keys).orderBy("_block")
    heads = (
        blocks.groupBy(*keys, "_block")
        .agg(F.min_by("_payload", order).alias("_head"))
        .select(*keys, "_block", F.lead("_head").over(after).alias("_carry"))
    )
    within = Window.partitionBy(*keys, "_block").orderBy(order)
    is_last = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(F.col(order).desc())) == 1
    return (
        blocks.withColumn("_lead", F.lead("_payload").over(within))
        .withColumn("_last", is_last)
        .join(heads, [*keys, "_block"])
        .withColumn(name, F.when(F.col("_last"), F.col("_carry")).otherwise(F.col("_lead")))
        .drop("_block", "_payload", "_lead", "_carry", "_last")
    )


def interleaved(df: DataFrame, keys: Sequence[str], group: str, rank: str, name: str = "rank") -> DataFrame:
    """Round-robin by ``group`` in first-seen order (W3). For short ranked lists, as top_k gives."""
    keys = list(keys)
    turn = F.row_number().over(Window.partitionBy(*keys, group).orderBy(rank))
    queue = F.min(rank).over(Window.partitionBy(*keys, group))
    staged = df.withColumn("_turn", turn).withColumn("_queue", queue)
    order = Window.partitionBy(*keys).orderBy("_turn", "_queue")
    return staged.withColumn(name, F.row_number().over(order)).drop("_turn", "_queue")
