"""Line dedup by site-relative frequency (operator 5).

Lines are counted once for each page (document) of a host (source). A line in
more than `ratio` of its host's pages, and in at least `least_pages` of them,
is boilerplate and goes. A host can have at most (lines a page / ratio) such
lines, whatever its number of pages, so the lines to drop are one small list
for each host; counting groups by (host, hash of the line) with partial sums,
and texts are not shuffled for it.

Defined results: lines are compared without outer blanks; blank lines are never
boilerplate. A null text stays null with no lines, an empty one stays empty;
null hosts are one host. Every row stays, with an empty text if all its lines
go; repeated rows are separate pages. Other columns are kept as they are, but
for those that are named like the result's two counts, in small or capital
letters; `counts` gives these other names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.shared import all_columns, shared_table


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float = 0.08, least_pages: int = 3) -> DataFrame:
    """_host and _drop, the hashes of the host's boilerplate lines; hosts without any are left out."""
    pages = docs.select(F.coalesce(host, F.lit("")).alias("_host"), host.isNull().alias("_none"), text.alias("_text"))
    totals = pages.groupBy("_host", "_none").agg(F.count("*").alias("_pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: F.trim(x) != ""), _key))
    counted = pages.select("_host", "_none", F.explode(keys).alias("_line")).groupBy("_host", "_none", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= least_pages)
    often = counted.join(totals, ["_host", "_none"]).where(F.col("_n") > ratio * F.col("_pages"))
    return often.groupBy("_host", "_none").agg(F.collect_list("_line").alias("_drop"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.08, least_pages: int = 3, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with boilerplate lines taken out of text_col, and the columns `counts`: a page's lines, and how many of them are dropped."""
    # Written first, so that its true size decides whether texts are shuffled to meet it.
    gone = shared_table(boilerplate(docs, F.col(host_col), F.col(text_col), ratio, least_pages), "boilerplate")
    rows = docs.select(F.struct(*all_columns(docs)).alias("_row"), F.coalesce(F.col(host_col), F.lit("")).alias("_host"), F.col(host_col).isNull().alias("_none"))
    text = F.col("_row")[text_col]
    lines = F.when(text.isNotNull(), _lines(text))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("_drop"), _key(x)) | (F.trim(x) == ""))
    out = rows.join(gone, ["_host", "_none"], "left").withColumn("_kept", F.when(F.col("_drop").isNull(), lines).otherwise(kept))
    own = {c.lower() for c in counts}
    cols = [(F.array_join("_kept", "\n") if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns if c.lower() not in own]
    n = F.coalesce(F.size(lines), F.lit(0))
    n = F.when(text.isNull(), 0).otherwise(n)
    return out.select(*cols, n.alias(counts[0]), (n - F.when(text.isNull(), 0).otherwise(F.size("_kept"))).alias(counts[1]))
