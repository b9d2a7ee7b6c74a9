"""Multi-regional economy tables as long cells (survey rows M1-M10)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_sectors(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """M1: (row, col, value) summed to sectors on both axes. rows, cols: lookup tables (code, sector)."""
    r, c = rows.select(F.col("code").alias("row"), F.col("sector").alias("row_sector")), cols.select(F.col("code").alias("col"), F.col("sector").alias("col_sector"))
    return cells.join(r, "row").join(c, "col").groupBy("row_sector", "col_sector").agg(F.sum("value").alias("value"))


def technical_coefficients(cells: DataFrame) -> DataFrame:
    """M2: value over its column's total, 0 where that is 0."""
    total = cells.groupBy("col").agg(F.sum("value").alias("_t"))
    return cells.join(total, "col").select("row", "col", F.when(F.col("_t") != 0, F.col("value") / F.col("_t")).otherwise(0.0).alias("a"))


def totals(*tables: DataFrame) -> DataFrame:
    """M2, M7: row sums of several tables (row, value) together: intermediate use, final demand, exports."""
    return reduce(DataFrame.unionByName, (t.select("row", "value") for t in tables)).groupBy("row").agg(F.sum("value").alias("total"))


def product(d: DataFrame, b: DataFrame) -> DataFrame:
    """M3: the relational matrix product D.B: (row, k, value) times (k, col, value)."""
    joined = d.select("row", "k", F.col("value").alias("_d")).join(b.select("k", "col", F.col("value").alias("_b")), "k")
    return joined.groupBy("row", "col").agg(F.sum(F.col("_d") * F.col("_b")).alias("value"))


def shares_of(cells: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """M3, M4: each value's share of its group's total (market shares, regional proxies), 0 where that is 0."""
    t = F.sum(value).over(Window.partitionBy(*by))
    return cells.withColumn("share", F.when(t != 0, F.col(value) / t).otherwise(0.0))


def trade_proxy(od: DataFrame, output: DataFrame) -> DataFrame:
    """M5: a pair's share of what its destination receives in a sector, times the smaller of both regions' output.

    od: origin, destination, sector, value; output: region, sector, output.
    """
    shared = shares_of(od, ["destination", "sector"])
    o = output.select(F.col("region").alias("origin"), "sector", F.col("output").alias("_o"))
    d = output.select(F.col("region").alias("destination"), "sector", F.col("output").alias("_d"))
    return shared.join(o, ["origin", "sector"]).join(d, ["destination", "sector"]).select("origin", "destination", "sector", (F.col("share") * F.least("_o", "_d")).alias("trade"))


def balance(cells: DataFrame, rows: DataFrame, cols: DataFrame, eps: float = 1e-5, most_rounds: int = 100_000, save_every: int = 5) -> DataFrame:
    """M6: generalised RAS: (row, col, value) scaled to the given row and column totals (row, total), (col, total); negative cells keep their sign.

    A positive cell is multiplied by r and s, a negative one divided by them.
    Each round solves r, then s, from sums over rows or columns of the positive
    part P and the negative part N of the scaled cells:
    m = (t + sqrt(t^2 + 4 P N)) / (2 P), or -N / t without a positive part;
    it stops when no multiplier changes by more than eps, and raises an error
    if that is not so after `most_rounds` (the reference's bound) or if a
    multiplier is not a number.
    """
    s = cols.select("col", F.lit(1.0).alias("s"))
    r = None
    parts = cells.select("row", "col", F.greatest("value", F.lit(0.0)).alias("p"), F.greatest(-F.col("value"), F.lit(0.0)).alias("n"))

    def solved(p, n, t):
        root = (t + F.sqrt(t * t + 4 * p * n)) / (2 * p)
        return F.when(p > 0, root).when((n > 0) & (t != 0), -n / t).otherwise(1.0)

    for k in range(most_rounds):
        by_row = parts.join(s, "col").groupBy("row").agg(F.sum(F.col("p") * F.col("s")).alias("P"), F.sum(F.col("n") / F.col("s")).alias("N"))
        new_r = by_row.join(rows, "row").select("row", solved(F.col("P"), F.col("N"), F.col("total")).alias("r"))
        by_col = parts.join(new_r, "row").groupBy("col").agg(F.sum(F.col("p") * F.col("r")).alias("P"), F.sum(F.col("n") / F.col("r")).alias("N"))
        new_s = by_col.join(cols, "col").select("col", solved(F.col("P"), F.col("N"), F.col("total")).alias("s")).checkpoint()
        change = new_s.join(s.withColumnRenamed("s", "_s"), "col").agg(F.max(F.abs(F.col("s") - F.col("_s")))).first()[0]
        r, s = new_r, new_s
        if change is None or change <= eps:
            break
        if math.isnan(change):
            raise RuntimeError("a multiplier is not a number")
    else:
        raise RuntimeError(f"not balanced after {most_rounds} rounds: multipliers change by {change}")
    scaled = F.when(F.col("value") >= 0, F.col("value") * F.col("r") * F.col("s")).otherwise(F.col("value") / (F.col("r") * F.col("s")))
    return cells.join(r, "row").join(s, "col").select("row", "col", scaled.alias("value"))


def regional_trade(cells: DataFrame) -> DataFrame:
    """M8: cells between different regions summed by (region, other, sector), with the importing side's share of its imports."""
    between = cells.where("row_region <> col_region").groupBy(F.col("row_region").alias("region"), F.col("col_region").alias("other"), F.col("row_sector").alias("sector")).agg(F.sum("value").alias("trade"))
    t = F.sum("trade").over(Window.partitionBy("other", "sector"))
    return between.withColumn("import_share", F.when(t != 0, F.col("trade") / t).otherwise(0.0))


def total_trade(trade: DataFrame) -> DataFrame:
    """M8: exports and imports by region and sector."""
    sides = F.explode(F.array(F.struct(F.col("region").alias("r"), F.col("trade").alias("e"), F.lit(0.0).alias("i")), F.struct(F.col("other").alias("r"), F.lit(0.0).alias("e"), F.col("trade").alias("i"))))
    return trade.select("sector", sides.alias("x")).groupBy(F.col("x.r").alias("region"), "sector").agg(F.sum("x.e").alias("exports"), F.sum("x.i").alias("imports"))


def supply_shocks(failed: DataFrame, od: DataFrame, floor: float = 0.8, least: float = 0.05) -> DataFrame:
    """M9: (event, destination, sector, shock): 1 - failed share of the destination's tons; shares over 1 - floor are left at the floor.

    Events whose largest loss is below `least` are skipped; `same_as` names the
    smallest event with the same sum of shocks, whose result they share.
    """
    lost = failed.groupBy("event", "destination", "sector").agg(F.sum("tons").alias("_f"))
    total = od.groupBy("destination", "sector").agg(F.sum("tons").alias("_t"))
    shock = lost.join(total, ["destination", "sector"]).withColumn("shock", F.greatest(F.lit(floor), 1 - F.col("_f") / F.col("_t"))).drop("_f", "_t")
    per = shock.groupBy("event").agg(F.min("shock").alias("_m"), F.round(F.sum("shock"), 9).alias("_s")).where(F.col("_m") <= 1 - least)
    same = per.groupBy("_s").agg(F.min("event").alias("same_as"))
    return shock.join(per.join(same, "_s").select("event", "same_as"), "event")


def direct_losses(shocks: DataFrame, base: DataFrame) -> DataFrame:
    """(event, region, sector, loss) = -(1 - shock) x yearly base output."""
    b = base.select(F.col("region").alias("destination"), "sector", "output")
    return shocks.join(b, ["destination", "sector"]).select("event", F.col("destination").alias("region"), "sector", (-(1 - F.col("shock")) * F.col("output")).alias("loss"))


def losses_per_day(losses: DataFrame) -> DataFrame:
    """Region sums a day."""
    return losses.groupBy("event", "region").agg((F.sum("loss") / 365).alias("loss_per_day"))
