"""Helpers that keep one hot key from landing in one task."""

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stoplens.session import cut_lineage, shuffle_partitions

BROADCAST_LIMIT_BYTES = 8 << 20
SALTS = 8


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (from file sizes and operators); no job runs. Joins of tables of unknown size
    multiply to numbers too long to convert, which count as the largest."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    except ValueError:
        return sys.maxsize


def lookup_join(rows: DataFrame, dimension: DataFrame, keys: list[str], how: str = "left",
                salts: int = SALTS) -> DataFrame:
    """Join rows to a dimension with unique keys.

    A dimension estimated below 8 MB is broadcast. A larger one is replicated over ``salts`` and the rows of each
    key spread over them; adaptive skew-join splitting divides what is still too large, so a key holding a third of
    all rows never stays in one task.
    """
    if estimated_bytes(dimension) <= BROADCAST_LIMIT_BYTES:
        return rows.join(F.broadcast(dimension), keys, how)
    spread = [c for c in rows.columns if c not in keys] or keys
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int"))
    copies = dimension.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def ordered_parts(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Range-partition by ``order`` and freeze the result, tagged with the ordinal ``_part`` of its range.

    The number of ranges is the session's shuffle width unless given.
    """
    ranged = df.repartitionByRange(parts or shuffle_partitions(df), *order).sortWithinPartitions(*order)
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))


def running_total(df: DataFrame, order: list[Column], amounts: dict[str, Column], parts: int | None = None) -> DataFrame:
    """Exact running sums over a total order without a single-task window.

    Each range keeps a local running sum; the totals of the earlier ranges (at most ``parts`` rows) are added.
    ``amounts`` maps new column names to the summed expressions; ``_position`` is the 1-based rank.
    """
    amounts = {**amounts, "_position": F.lit(1).cast("bigint")}
    for name, expression in amounts.items():
        df = df.withColumn(f"_in_{name}", expression)
    frozen = ordered_parts(df, order, parts)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = frozen.groupBy("_part").agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in amounts])
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}")
                                       for n in amounts])
    out = frozen.join(F.broadcast(offsets), "_part")
    for name in amounts:
        out = out.withColumn(name, F.sum(f"_in_{name}").over(local) + F.col(f"_off_{name}"))
    return out.drop("_part", *[f"_in_{n}" for n in amounts], *[f"_off_{n}" for n in amounts])


def places_within(df: DataFrame, partition: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """0-based ``_place`` and group ``_size`` of every row inside its group, however large a group is.

    The rows are ranked over one global range-partitioned order that starts with the group columns, so a hot group
    spans many ranges; the first rank of each group is then subtracted.
    """
    ranked = running_total(df, [*[F.col(c) for c in partition], *order], {}, parts)
    bounds = ranked.groupBy(*partition).agg(F.min("_position").alias("_first"), F.count(F.lit(1)).alias("_size"))
    return lookup_join(ranked, bounds, partition, "inner").withColumn("_place", F.col("_position") - F.col("_first"))\
        .drop("_position", "_first")
