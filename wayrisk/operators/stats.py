"""Statistics, adaptation reports and rankings (survey rows A18, A19, A24-A26, A29, A31-A33, P32, W4, W5, T1-T3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.functions import columns as C
from wayrisk.operators.ordered import running


def network_statistics(edges: DataFrame, by: list[str], length: str = "length") -> DataFrame:
    """Counts and lengths by each of several attributes, in one pass by grouping sets."""
    sets = F.grouping_id()
    out = edges.groupingSets([[b] for b in by], *by).agg(sets.alias("_g"), F.count("*").alias("n"), F.sum(length).alias("length"))
    n = len(by)
    which = F.coalesce(*(F.when(F.col("_g").bitwiseAND(1 << (n - 1 - i)) == 0, F.lit(b)) for i, b in enumerate(by)))
    value = F.coalesce(*(F.when(which == b, F.col(b).cast("string")) for b in by))
    return out.select(which.alias("attribute"), value.alias("value"), "n", "length")


def by_boundary(pieces: DataFrame, boundary: list[str]) -> DataFrame:
    """Number and length of the pieces of each boundary."""
    return pieces.groupBy(*boundary).agg(F.count("*").alias("n"), F.sum("length").alias("length"))


def sweep(assets: DataFrame, durations: list[int], growths: list[float], rate: float, start: int, end: int, period: int = 8) -> DataFrame:
    """Benefits and ratios of every asset at each point of the duration x growth grid (a fixed, small table).

    assets: id, ead, min_eael_per_day, max_eael_per_day, total (cost). The sums
    of discount factors are worked out once for each growth, not for each asset.
    """
    spark = assets.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, growths))).alias("growth")).withColumn("_f", C.discount_sums(rate, F.col("growth"), start, end, period))
    grid = grid.select(F.explode(F.array(*map(F.lit, durations))).alias("duration"), "growth", F.col("_f.plain").alias("_plain"), F.col("_f.growing").alias("_growing"))
    out = assets.join(F.broadcast(grid))
    for m in ("min", "max"):
        out = out.withColumn(f"_{m}", C.benefits(F.col("ead"), F.col(f"{m}_eael_per_day"), F.col("duration"), F.col("_plain"), F.col("_growing"), F.col("total")))
    cols = [F.col(f"_{m}.{f}").alias(f"{m}_{f}") for m in ("min", "max") for f in ("benefit", "bc_ratio", "bc_diff")]
    return out.select(*assets.columns, "duration", "growth", *cols)


def sensitivity(results: DataFrame, total_assets: int, length: str = "length") -> DataFrame:
    """By (duration, growth), number, percent and km of assets whose largest, and whose least, ratio is above 1."""
    best = results.groupBy("id", "duration", "growth").agg(F.max("max_bc_ratio").alias("hi"), F.max("min_bc_ratio").alias("lo"), F.max(length).alias("km"))
    cols = []
    for n, c in (("max", "hi"), ("min", "lo")):
        good = F.col(c) > 1
        cols += [F.count_if(good).alias(f"{n}_count"), (100 * F.count_if(good) / F.lit(float(total_assets))).alias(f"{n}_percent"), F.sum(F.when(good, F.col("km")).otherwise(0.0)).alias(f"{n}_km")]
    return best.groupBy("duration", "growth").agg(*cols)


def ratio_transitions(results: DataFrame, key: str, baseline: str, scenario: str, ratio: str) -> DataFrame:
    """How ratios move from the baseline to a scenario: equal, up, down, over 1 up, over 1 down."""
    side = results.groupBy(key).agg(*(F.max(F.when(F.col("climate_scenario") == s, F.col(ratio))).alias(n) for n, s in (("b", baseline), ("s", scenario))))
    b, s = F.coalesce(F.col("b"), F.lit(0.0)), F.coalesce(F.col("s"), F.lit(0.0))
    return side.agg(F.count_if(b == s).alias("equal"), F.count_if(s > b).alias("up"), F.count_if(s < b).alias("down"), F.count_if((b < 1) & (s >= 1)).alias("over_1_up"), F.count_if((b >= 1) & (s < 1)).alias("over_1_down"))


def differing_share(df: DataFrame, a: str, b: str) -> DataFrame:
    """Percent of rows whose two paths differ."""
    return df.agg(F.avg(F.when(F.col(a) != F.col(b), 100.0).otherwise(0.0)).alias("percent"))


def count_in_boxes(x: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Number of points in each box, borders included: points by x, and a count of smaller y in a stretch of them bit by bit of their ranks in y."""
    by_x, ys = np.argsort(x, kind="stable"), np.sort(y)
    first, last = np.searchsorted(x[by_x], x0, "left"), np.searchsorted(x[by_x], x1, "right")
    rank = np.empty(len(y), np.int64)
    rank[np.argsort(y, kind="stable")] = np.arange(len(y))
    i, j, k = np.tile(first, 2), np.tile(np.maximum(last, first), 2), np.concatenate([np.searchsorted(ys, y0, "left"), np.searchsorted(ys, y1, "right")])
    rank, n = rank[by_x], np.zeros(len(k), np.int64)
    for bit in reversed(range(len(y).bit_length())):
        one = (rank >> bit) & 1
        zeros = np.concatenate([[0], np.cumsum(1 - one)])
        high, a, b = (k >> bit) & 1 == 1, zeros[i], zeros[j]
        n += np.where(high, b - a, 0)
        i, j = np.where(high, zeros[-1] + i - a, a), np.where(high, zeros[-1] + j - b, b)
        rank = np.concatenate([rank[one == 0], rank[one == 1]])
    return np.maximum(n[len(first) :] - n[: len(first)], 0)


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """Number of points in each box (borders count), cell by cell; the pairs themselves are never made.

    A task counts a cell's points for the boxes that touch it, so work grows as
    points and boxes do, however many points a box holds.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    p = points.select("x", "y", at("x").alias("_cx"), at("y").alias("_cy"))
    b = boxes.select("box_id", "x0", "x1", "y0", "y1", F.explode(F.sequence(at("x0"), at("x1"))).alias("_cx")).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1"))))

    def count(p: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        sides = (b[c].to_numpy(float) for c in ("x0", "x1", "y0", "y1"))
        return pd.DataFrame({"box_id": b["box_id"], "n": count_in_boxes(p["x"].to_numpy(float), p["y"].to_numpy(float), *sides)})

    hit = p.groupBy("_cx", "_cy").cogroup(b.groupBy("_cx", "_cy")).applyInPandas(count, f"box_id {boxes.schema['box_id'].dataType.simpleString()}, n long")
    n = hit.groupBy("box_id").agg(F.sum("n").alias("n"))
    return boxes.select("box_id").join(n.hint("merge"), "box_id", "left").fillna(0, subset=["n"])


def log_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept, R2 and mean squared error of log y on log x, of rows where both are above 0."""
    lx, ly = F.log(x), F.log(y)
    ok = df.where((F.col(x) > 0) & (F.col(y) > 0))
    sums = ok.agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.regr_r2(ly, lx).alias("r2"), F.var_pop(ly).alias("_v"))
    return sums.select("slope", "intercept", "r2", (F.col("_v") * (1 - F.col("r2"))).alias("mse"))


def weight_bins(df: DataFrame, weight: str, steps: int, log: bool = False) -> DataFrame:
    """Rows with the number of their bin between the smallest and largest weight, linear or in logarithms."""
    ends = df.agg(F.min(weight).alias("_lo"), F.max(weight).alias("_hi"))
    w, lo, hi = F.col(weight), F.col("_lo"), F.col("_hi")
    if log:
        w, lo, hi = F.log(w), F.log(lo), F.log(hi)
    k = F.when(hi > lo, F.least(F.lit(steps - 1), F.floor((w - lo) * steps / (hi - lo)))).otherwise(0)
    return df.join(F.broadcast(ends)).withColumn("bin", k.cast("int")).drop("_lo", "_hi")


def largest_totals(curve: DataFrame, by: str) -> DataFrame:
    """A33."""
    return curve.groupBy(by).agg(F.max("total_cost").alias("total_cost"), F.max("total_benefit").alias("total_benefit"), F.max("investment").alias("investment"))


def investment_curve(results: DataFrame, parts: list[str], least_ratio: float = 1.0, budget: float | None = None) -> DataFrame:
    """An asset's best ratio, ratios from least_ratio on, running sums of cost and benefit by falling ratio within parts, up to a budget."""
    best = results.withColumn("_k", F.row_number().over(Window.partitionBy(*parts, "id").orderBy(F.desc("bc_ratio"), "cost"))).where((F.col("_k") == 1) & (F.col("bc_ratio") >= least_ratio))
    best = best.drop("_k")
    out = running(best, parts, [F.desc("bc_ratio"), F.col("id")], {"investment": F.col("cost"), "total_benefit": F.col("benefit")}).drop("_rank")
    return out.where(F.col("investment") <= budget) if budget is not None else out


def percentile_curve(df: DataFrame, parts: list[str], lo: str, hi: str, id_col: str) -> DataFrame:
    """Pairs in order, sorted by the maximum within parts, with the percentile 100 i / n."""
    paired = df.withColumn("_pair", C.order_pair(F.col(lo), F.col(hi)))
    order = running(paired, parts, [F.col("_pair.hi"), F.col(id_col)], rank="_i", total="_of")
    return order.select(id_col, *parts, F.col("_pair.lo").alias(lo), F.col("_pair.hi").alias(hi), (100.0 * (F.col("_i") - 1) / F.col("_of")).alias("percentile"))


def ranked(df: DataFrame, parts: list[str], value: str, id_col: str) -> DataFrame:
    """Rank by falling value within parts (a mode)."""
    return running(df, parts, [F.desc(value), F.col(id_col)], rank="rank").withColumn("rank", F.col("rank").cast("int"))


def top(df: DataFrame, n: int, value: Column, *ties: str) -> DataFrame:
    """The first n by falling value, without a full sort."""
    return df.orderBy(value.desc(), *ties).limit(n)


def by_row_total(df: DataFrame, cols: list[str], id_col: str) -> DataFrame:
    """The sum of several columns of a row, and rows by it."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    return df.withColumn("row_total", total).orderBy(F.desc("row_total"), id_col)
