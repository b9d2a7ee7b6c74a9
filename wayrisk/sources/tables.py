"""Sources and sinks (survey rows S1-S9)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayrisk.functions import geometry as G


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder named in spark.checkpoint.dir (or set as Spark's checkpoint folder), for tables that all executors write and read; it goes when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A headed CSV; columns go by position, so a byte-order mark in the header does no harm."""
    return spark.read.schema(schema).option("enforceSchema", True).csv(path, header=True, encoding="UTF-8")


def write_results(df: DataFrame, path: str, parameters: list[str], as_csv: bool = False) -> None:
    """One dataset whose folders carry the parameters (mode, percent, duration, growth ...)."""
    writer = df.write.mode("overwrite").partitionBy(*parameters)
    writer.option("header", True).csv(path) if as_csv else writer.parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All results of a parameter sweep as one table, parameters as columns."""
    return spark.read.parquet(path)


def melt_zones(wide: DataFrame, origin: str, commodity: Column | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """S3: a zone x zone matrix to rows (origin, destination, tons) above 0; names: corrections of commodity names."""
    zones = [c for c in wide.columns if c not in (origin, "commodity")]
    keep = [origin] + (["commodity"] if "commodity" in wide.columns else [])
    out = wide.unpivot(keep, zones, "destination", "tons").where(F.col("tons") > 0)
    if commodity is not None:
        out = out.withColumn("commodity", commodity)
    if names and "commodity" in out.columns:
        out = out.replace(names, subset=["commodity"])
    return out.withColumnRenamed(origin, "origin")


def scenario_of_file(name: Column) -> Column:
    """struct(return_period, min_depth, max_depth) of names like FU_1in100_50cm-1m.shp."""
    return F.struct(
        F.regexp_extract(name, r"1in(\d+)", 1).cast("int").alias("return_period"),
        F.regexp_extract(name, r"_(\d+c?m)-(\d+c?m)", 1).alias("min_depth"),
        F.regexp_extract(name, r"_(\d+c?m)-(\d+c?m)", 2).alias("max_depth"),
    )


def read_hazards(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """All headed CSV files below a folder, each row with the scenario that its file's path names."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).csv(path, header=True)
    return rows.withColumn("_s", scenario_of_file(F.col("_metadata.file_path"))).select(*rows.columns, "_s.*")


def with_scenarios(hits: DataFrame, files: DataFrame, file_col: str = "file_name") -> DataFrame:
    """Hazard attributes by file name; files is the lookup of one row for each hazard file."""
    return hits.join(files, file_col, "left")


def climate_of_file(name: Column) -> Column:
    """struct(year, climate_scenario, probability) of river-flood file names that end in a return period."""
    return F.struct(
        F.when(name.contains("2030"), 2030).otherwise(2016).alias("year"),
        F.when(name.contains("rcp4p5"), "rcp4p5").when(name.contains("rcp8p5"), "rcp8p5").otherwise("none").alias("climate_scenario"),
        (1 / F.regexp_replace(F.substring(name, -5, 5), "^[^0-9]*", "").cast("double")).alias("probability"),
    )


def points_of_wkt(wkt: Column) -> Column:
    """All coordinates of a text, as of a POINT, LINESTRING or ring, as array<struct<x, y>>."""
    pairs = F.regexp_extract_all(wkt, F.lit(r"(-?[0-9.]+(?:[eE]-?[0-9]+)?) +(-?[0-9.]+(?:[eE]-?[0-9]+)?)"), 0)
    return F.transform(pairs, lambda p: F.struct(F.split(p, " +")[0].cast("double").alias("x"), F.split(p, " +")[1].cast("double").alias("y")))


def polygon_of_wkt(wkt: Column) -> Column:
    """A POLYGON or MULTIPOLYGON text, also with holes, as one ring (see geometry.polygon)."""
    ring = F.lit(r"(\(?)\s*\(([^()]+)\)")
    rings = F.transform(F.regexp_extract_all(wkt, ring, 2), points_of_wkt)
    return G.polygon(rings, F.transform(F.regexp_extract_all(wkt, ring, 1), lambda head: head == "("))


def read_geometry(df: DataFrame, wkt_col: str = "wkt") -> DataFrame:
    """Geometry rows as `points` (polygons as one ring); rows without a geometry are dropped."""
    wkt = F.col(wkt_col)
    points = F.when(F.upper(wkt).contains("POLYGON"), polygon_of_wkt(wkt)).otherwise(points_of_wkt(wkt))
    return df.where(wkt.isNotNull()).withColumn("points", points).where(F.size("points") > 0).drop(wkt_col)


def path_list(text: Column) -> Column:
    """A list of ids stored as text, as ["a", "b"] or ['a', 'b']."""
    return F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")


def sub_table(lines: DataFrame, skip: int, first: int, last: int, names: list[str], order: str = "line_no", sep: str = ",") -> DataFrame:
    """Of numbered text lines (line_no, value) without the first `skip`, the fields first to last under new names."""
    fields = F.split("value", sep, -1)
    return lines.where(F.col(order) >= skip).select(*(F.get(fields, F.lit(i)).alias(n) for i, n in zip(range(first, last + 1), names, strict=True)))
