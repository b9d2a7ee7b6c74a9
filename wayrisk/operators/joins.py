"""Equi-joins in the ways that risk jobs use them (survey rows J1-J5, J30, X1-X3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_fill(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Left join with numeric gaps as 0."""
    new = [c for c in right.columns if c not in on]
    return left.join(right, on, how).fillna(0, subset=new)


def present_in(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """J2."""
    return df.join(other, on, "left_semi")


def absent_from(df: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """J3."""
    return df.join(other, on, "left_anti")


def outer_fill(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """J4."""
    return a.join(b, on, "full").fillna(0)


def one_to_many(one: DataFrame, many: DataFrame, on: list[str]) -> DataFrame:
    """Inner join whose left keys must be unique; a repeated key fails the query."""
    counted = one.groupBy(*on).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in one.columns if c not in on])).alias("_row"))
    sure = F.when(F.col("_n") == 1, F.col("_row")).otherwise(F.raise_error(F.lit("keys of the left side are not unique")))
    return counted.select(*on, sure.alias("_row")).select(*on, "_row.*").join(many, on)


def inherit_from_edges(bridges: DataFrame, edges: DataFrame, impact: str) -> DataFrame:
    """Bridges with their road edge's values, those with an impact above 0."""
    return left_fill(bridges, edges, ["edge_id"]).where(F.col(impact) > 0)


def transform_records(df: DataFrame, rule: Callable[[DataFrame], DataFrame], keep: Column | None = None) -> DataFrame:
    """A rule on all records, of which some may be dropped."""
    out = df.transform(rule)
    return out.where(keep) if keep is not None else out


MOST_SENT = 500_000  # rows of a side that is sent to all tasks


def dealt_pairs(many: DataFrame, few: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two sides of a join with few keys and many pairs: if one is small (counted), it is sent to all tasks and the rows of the other are dealt to these by ranges of their keys.

    Pairs under one key are then made in many tasks, not in one, but a task has
    few keys: files of its pairs repeat the few values of these.
    """
    if few.limit(MOST_SENT + 1).count() > MOST_SENT:
        return many, few
    n = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The hash of the row parts a key with many rows.
    return many.withColumn("_h", F.xxhash64(*many.columns)).repartitionByRange(n, *on, "_h").drop("_h"), F.broadcast(few)


def link_pairs(a: DataFrame, b: DataFrame, on: list[str], condition: Callable[[DataFrame, DataFrame], Column]) -> DataFrame:
    """Pairs under equal keys for which a predicate of both sides holds; b should be the smaller side."""
    x, y = dealt_pairs(a, b, on)
    x, y = x.alias("a"), y.alias("b")
    keys = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in on]
    hold = condition(a, b)
    for k in keys:
        hold = hold & k
    return x.join(y, hold)


def spread(df: DataFrame, value: Column) -> DataFrame:
    """The fields of a struct as columns of their own, computed once a row."""
    return df.withColumn("_s", value).select(*df.columns, "_s.*")
