"""Ordered work in range partitions: ranks, running sums and as-of values without one task for a key.

Rows are dealt by ranges of (part, order), so a part with all rows is spread over
all tasks. Each range is numbered and summed on its own, and what lies before it
is added back: one row for each range and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df with _p, the number of a row's range. The checkpoint keeps rows and numbers together."""
    return df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).checkpoint()


def running(df: DataFrame, parts: list[str], order: list[Column], sums: dict[str, Column] | None = None, rank: str = "_rank", total: str | None = None) -> DataFrame:
    """df with `rank` (from 1) within parts in a full order, and running sums by name; total: the number of a part's rows.

    Null parts are a part. Sums of doubles add up range by range.
    """
    sums = sums or {}
    dealt = in_ranges(df.withColumn("_key", F.struct(*parts)), F.col("_key"), *order)
    each = dealt.groupBy("_key", "_p").agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_sum_{s}") for s, c in sums.items()))
    w = Window.partitionBy("_key")
    before = w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    shifts = each.select("_key", "_p", none(F.sum("_n").over(before)).alias("_before"), F.sum("_n").over(w).alias("_all"), *(none(F.sum(f"_sum_{s}").over(before)).alias(f"_sum_{s}") for s in sums))
    here = Window.partitionBy("_key", "_p").orderBy(*order)
    own = dealt.withColumns({"_k": F.row_number().over(here)} | {f"_own_{s}": F.sum(c).over(here.rowsBetween(Window.unboundedPreceding, 0)) for s, c in sums.items()})
    out = own.join(shifts, ["_key", "_p"])
    named = [(F.col("_before") + F.col("_k")).alias(rank), *(none(F.col(f"_own_{s}") + F.col(f"_sum_{s}")).alias(s) for s in sums), *([F.col("_all").alias(total)] if total else [])]
    return out.select(*df.columns, *named)


def as_of(df: DataFrame, x: str, steps: DataFrame, at: str, values: list[str]) -> DataFrame:
    """df with the values of the largest step at or below x; null below the first step and where x is null.

    Both sides lie in one order of positions. A range takes its last step so far
    along, and where it has none yet, the last step of the ranges before it.
    Rows with equal x are told apart by a hash of the row, so that many of them
    are spread too. Of steps at one place the largest values count.
    """
    best = steps.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("double").alias("_at")).agg(F.max(F.struct(*values)).alias("_step"))
    facts = df.select(F.struct(*df.columns).alias("_row"), F.col(x).cast("double").alias("_at"), F.xxhash64(*df.columns).alias("_salt"))
    both = best.select("_at", "_step", F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_salt")).unionByName(facts.where(F.col("_at").isNotNull()).withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_at"), F.col("_kind"), F.col("_salt")]
    dealt = in_ranges(both, *order)
    here = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_step", ignorenulls=True)
    ends = dealt.where("_kind = 0").groupBy("_p").agg(F.max_by("_step", "_at").alias("_step"))
    ranges = dealt.select("_p").distinct().join(ends, "_p", "left")
    carried = ranges.select("_p", last.over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))  # a row for each range
    found = dealt.withColumn("_own", last.over(here)).where("_kind = 1").join(carried, "_p")
    out = found.select("_row.*", F.coalesce("_own", "_carried").alias("_step")).select(*df.columns, *(F.col("_step")[v].alias(v) for v in values))
    empty = facts.where(F.col("_at").isNull()).select("_row.*", *(F.lit(None).cast(steps.schema[v].dataType).alias(v) for v in values))
    return out.unionByName(empty)
