"""Lookups by rule order, range and name (survey rows J6-J11, J26-J29, W8).

Where file order decides elsewhere, an explicit `seq` column of the lookup
decides here. Lookups that are a few rows are broadcast by Spark, or behind a
check of their size; no plan depends on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.functions.columns import normal_name
from wayrisk.operators.ordered import as_of, running
from wayrisk.operators.spatial import nearest_k

MOST_STEPS = 10_000  # of a table that each row searches
MOST_SENT = 50_000  # names, and grams of names, that are sent to all tasks


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in a full order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def industry_of(df: DataFrame, industries: DataFrame) -> DataFrame:
    """Industry by (commodity_group, commodity_subgroup), without regard to case and accents."""
    keys = ["commodity_group", "commodity_subgroup"]
    table = industries.select(*(normal_name(F.col(k)).alias(f"_{k}") for k in keys), "industry").dropDuplicates([f"_{k}" for k in keys])
    return df.withColumns({f"_{k}": normal_name(F.col(k)) for k in keys}).join(table, [f"_{k}" for k in keys], "left").drop(*(f"_{k}" for k in keys))


def first_by_name(df: DataFrame, name: str, lookup: DataFrame, value: str, seq: str = "seq") -> DataFrame:
    """The value of the first lookup row with the same normal name; '' where there is none."""
    table = lookup.groupBy(normal_name(F.col(name)).alias("_n")).agg(F.min_by(value, seq).alias(value))
    return df.withColumn("_n", normal_name(F.col(name))).join(table, "_n", "left").drop("_n").fillna("", subset=[value])


def first_in_range(edges: DataFrame, lookup: DataFrame, key: str, lo: str, hi: str, start: str, end: str, values: list[str], seq: str = "seq") -> DataFrame:
    """Of the lookup rows with one of the edge's names (array `key`) whose [start, end] holds [lo, hi], the first one's values.

    Equal ranges of a name are one, and so are equal asks; each is looked up once.
    """
    table = lookup.groupBy(key, start, end).agg(F.min(seq).alias("_seq"), F.min_by(F.struct(*values), seq).alias("_v"))
    ids = edges.select("edge_id", F.explode(key).alias(key), lo, hi)
    hits = ids.select(key, lo, hi).distinct().join(table, key).where((F.col(lo) >= F.col(start)) & (F.col(hi) <= F.col(end)))
    asked = hits.groupBy(key, lo, hi).agg(F.min("_seq").alias("_seq"), F.min_by("_v", "_seq").alias("_v"))
    best = ids.join(asked, [key, lo, hi]).groupBy("edge_id").agg(F.min_by("_v", "_seq").alias("_v")).select("edge_id", "_v.*")
    return edges.join(best.hint("merge"), "edge_id", "left")


def floor_lookup(df: DataFrame, x: str, steps: DataFrame, at: str, values: list[str]) -> DataFrame:
    """Values of the largest step at or below x; below the first step null.

    Up to MOST_STEPS steps are one sorted array that each row searches; more are
    met in range partitions, where neither side is held in one place.
    """
    if steps.limit(MOST_STEPS + 1).count() > MOST_STEPS:
        return as_of(df, x, steps, at, values)
    table = steps.where(F.col(at).isNotNull()).agg(F.sort_array(F.collect_list(F.struct(at, *values))).alias("_steps"))
    found = F.element_at(F.filter("_steps", lambda s: s[at] <= F.col(x)), -1)
    out = df.join(F.broadcast(table)).withColumn("_s", F.when(F.exists("_steps", lambda s: s[at] <= F.col(x)), found))
    return out.select(*df.columns, *(F.col("_s")[v].alias(v) for v in values))


def surface_cost(surface: Column, earth: Column, gravel: Column, paved: Column) -> Column:
    """Which cost column a road surface takes."""
    s = F.lower(F.trim(surface))
    return F.when(s.isin("tierra", "de tierra"), earth).when(s.isin("ripio", "consolidado"), gravel).otherwise(paved)


def first_rule(df: DataFrame, id_col: str, rules: DataFrame, ways: Sequence[Sequence[tuple[str, str]]], values: list[str], default: float = 0.0, seq: str = "seq") -> DataFrame:
    """Values of the first rule that fits in any of several ways, else the default. A way is pairs of equal columns (row's, rule's), so each is a hash join."""
    first = F.struct(seq, *values)
    best = None
    for way in ways:
        own = rules.groupBy(*(F.col(r).alias(f"_{i}") for i, (_, r) in enumerate(way))).agg(F.min(first).alias("_v"))
        keyed = df.select(id_col, *(F.col(c).alias(f"_{i}") for i, (c, _) in enumerate(way)))
        hits = keyed.join(own, [f"_{i}" for i in range(len(way))]).select(id_col, "_v")
        best = hits if best is None else best.unionByName(hits)
    best = best.groupBy(id_col).agg(F.min("_v").alias("_v")).select(id_col, *(F.col(f"_v.{v}").alias(v) for v in values))
    return df.join(best, id_col, "left").fillna(default, subset=values)


#: Either order of the link's modes, or its port type with the mode it leads to.
MODE_PAIRS = [
    [("port_type", "one_mode"), ("to_mode", "other_mode")],
    [("to_mode", "one_mode"), ("from_mode", "other_mode")],
    [("to_mode", "one_mode"), ("port_type", "other_mode")],
    [("from_mode", "one_mode"), ("to_mode", "other_mode")],
]


def contained(texts: DataFrame, text_id: str, text: str, names: DataFrame, name_id: str, name: str, q: int = 3) -> DataFrame:
    """(text_id, name_id) of all texts that contain a name, by an inverted index of q-grams.

    A name is looked up by the one of its q-grams that the fewest texts have,
    and the hits are verified. Shorter names are grams themselves; the empty
    name is in every text. Null texts and names meet nothing.
    """
    t = texts.where(F.col(text).isNotNull()).select(F.col(text_id).alias("_tid"), F.col(text).alias("_text"))
    n = names.where(F.col(name).isNotNull()).select(F.col(name_id).alias("_nid"), F.col(name).alias("_name"))
    grams = lambda c, size: F.array_distinct(F.when(F.length(c) >= size, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>")))
    sizes = [r[0] for r in n.select(F.least(F.length("_name"), F.lit(q))).distinct().collect()]  # 0 to q
    of_text = lambda size: F.array(F.lit("")) if size == 0 else grams(F.col("_text"), size)
    own = n.select("_nid", "_name", F.explode(F.when(F.length("_name") == 0, F.array(F.lit(""))).otherwise(grams(F.col("_name"), F.least(F.length("_name"), F.lit(q))))).alias("_gram"))
    asked = own.select("_gram").distinct().checkpoint()
    # Spark takes an exploded index for as small as its table: what may be sent to all tasks is counted here, the rest is never sent.
    few = asked.limit(MOST_SENT + 1).count() <= MOST_SENT and n.limit(MOST_SENT + 1).count() <= MOST_SENT
    small = F.broadcast if few else lambda df: df.hint("shuffle_hash")
    kept = ["_tid", "_text"] if few else ["_tid"]
    index = t.select(*kept, F.explode(F.flatten(F.array(*(of_text(s) for s in sizes)))).alias("_gram")) if sizes else t.select(*kept, F.lit("").alias("_gram")).limit(0)
    index = index.join(small(asked), "_gram", "left_semi")
    often = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    # A gram that no text has rules its name out: the inner join below finds nothing for it.
    rarest = own.join(often, "_gram", "left").groupBy("_nid", "_name").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_g")).select("_nid", "_name", F.col("_g._gram").alias("_gram"))
    hits = index.join(small(rarest), "_gram")
    hits = (hits if few else hits.hint("merge").join(t, "_tid")).where(F.col("_text").contains(F.col("_name")))
    return hits.select(F.col("_tid").alias(text_id), F.col("_nid").alias(name_id)).distinct()


def first_contained(df: DataFrame, id_col: str, text: str, rules: DataFrame, name: str, values: list[str], default: float = 0.0, seq: str = "seq") -> DataFrame:
    """Values of the first rule whose name is a part of the text, else the default."""
    found = contained(df, id_col, text, rules, seq, name).join(rules.select(seq, *values), seq)
    best = found.groupBy(id_col).agg(F.min(F.struct(seq, *values)).alias("_v")).select(id_col, *(F.col(f"_v.{v}").alias(v) for v in values))
    return df.join(best.hint("merge"), id_col, "left").fillna(default, subset=values)


INSIDE, AROUND, EITHER = "inside", "around", "either"  # the record's text in the candidate's, the other way round, or one of both


def likenesses(records: DataFrame, record: str, own: str, candidates: DataFrame, candidate: str, other: str, how: str) -> DataFrame:
    """(record, candidate) pairs whose texts contain one another."""
    parts = []
    if how in (INSIDE, EITHER):
        parts.append(contained(candidates, candidate, other, records, record, own).select(record, candidate))
    if how in (AROUND, EITHER):
        parts.append(contained(records, record, own, candidates, candidate, other).select(record, candidate))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()


def cascade(records: DataFrame, id_col: str, candidates: DataFrame, levels: Sequence[tuple[list[tuple[str, str]], tuple[str, str, str] | None]], value: str) -> DataFrame:
    """Candidates of the first level that has any.

    levels: pairs of equal columns (record's, candidate's), and a likeness: the
    record's text column, the candidate's, and INSIDE, AROUND or EITHER. Each
    level takes the records that no earlier one has matched. Equal columns make
    it a hash join, likenesses an index of q-grams. Records with the same
    columns are one class: levels are found for classes, and their records
    follow in one last join, whose rows are neither shuffled nor written.
    """
    cols = list(dict.fromkeys([a for equal, _ in levels for a, _ in equal] + [like[0] for _, like in levels if like]))
    rows, classes = _classes(records, id_col, cols)
    hits = _cascade(classes, "_class", candidates, levels, value)
    return _expanded(rows, hits).select(id_col, value, "level")


def _classes(records: DataFrame, id_col: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Records as (id_col, _class), and (_class, cols) of the distinct columns; an id with several rows is a class of its own."""
    several = F.count("*").over(Window.partitionBy(id_col)) > 1
    own = F.concat(F.lit("id "), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    like = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    rows = records.select(id_col, *cols).distinct().withColumn("_class", F.when(several, own).otherwise(like)).checkpoint()
    return rows.select(id_col, "_class").distinct(), rows.select("_class", *cols).distinct()


def _expanded(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Rows (with _class) joined to the distinct hits of their classes. Few bytes mean much work here, so rows are dealt to a number of tasks before they meet their hits."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "_class").hint("shuffle_hash").join(hits.repartition(n, "_class"), "_class")


def _cascade(records: DataFrame, id_col: str, candidates: DataFrame, levels: Sequence[tuple[list[tuple[str, str]], tuple[str, str, str] | None]], value: str) -> DataFrame:
    left, found = records.checkpoint(), None
    for rank, (equal, like) in enumerate(levels, 1):
        c = candidates.select(F.col(value).alias("_value"), *(F.col(b).alias(f"_{i}") for i, (_, b) in enumerate(equal)))
        mine = left.select(id_col, *(F.col(a).alias(f"_{i}") for i, (a, _) in enumerate(equal)))
        keys = [f"_{i}" for i in range(len(equal))]
        if like is None:
            hits = mine.join(c, keys).select(id_col, "_value").distinct()
        else:
            # Equal texts are looked up once; their records and candidates follow.
            texts = left.select(F.col(like[0]).alias("_own")).distinct().withColumn("_r", F.col("_own"))
            others = candidates.select(F.col(like[1]).alias("_other")).distinct().withColumn("_c", F.col("_other"))
            alike = likenesses(texts, "_r", "_own", others, "_c", "_other", like[2])
            mine = left.select(id_col, F.col(like[0]).alias("_r"), *(F.col(a).alias(f"_{i}") for i, (a, _) in enumerate(equal)))
            c = candidates.select(F.col(value).alias("_value"), F.col(like[1]).alias("_c"), *(F.col(b).alias(f"_{i}") for i, (_, b) in enumerate(equal)))
            hits = mine.join(alike, "_r").join(c, ["_c", *keys]).select(id_col, "_value").distinct()
        hits = hits.select(id_col, F.col("_value").alias(value), F.lit(rank).alias("level"))
        if rank < len(levels):
            hits = hits.checkpoint()
            left = left.join(hits.select(id_col).distinct(), id_col, "left_anti").checkpoint()
        found = hits if found is None else found.unionByName(hits)
    return found


#: Port names that name no port, and the words that stand for any.
NO_PORT, ANY = ("rada", "rada exterior", "transito"), ("all", "other")


def port_cascade(records: DataFrame, nodes: DataFrame, renames: DataFrame, countries: DataFrame) -> DataFrame:
    """(record, node, named, level): the nodes of each record's port.

    records: record, reference (the port that reports), named (the port named),
    commodity_group, country; nodes: node, name; renames: od_port,
    commodity_group, port, seq; countries: port_name, country, node, seq.
    The named port is renamed by the first of: its rename for the commodity
    group, its rename for any group, its node among the countries' ports, its
    country's node for any port. Nodes are those whose name holds the reference
    (level 1, if the named port and the reference hold one another, or for the
    node that is named itself), else those whose name and the named port hold
    one another (level 2), else again those that hold the reference (level 3).
    Names count without regard to case, accents and outer blanks.
    """
    plain = lambda c: normal_name(F.col(c))
    r = records.select("record", plain("reference").alias("ref"), F.when(plain("named").isin(*NO_PORT), F.lit("Unknown")).otherwise(F.col("named")).alias("named"), plain("commodity_group").alias("grp"), plain("country").alias("land"))
    r = r.withColumn("key", plain("named"))
    to = renames.select(plain("od_port").alias("key"), plain("commodity_group").alias("grp"), "port", "seq")
    lands = countries.select(plain("port_name").alias("key"), plain("country").alias("land"), "node", "seq")
    first = lambda df, keys, c, name: df.groupBy(*keys).agg(F.min_by(c, "seq").alias(name))
    r = r.join(first(to, ["key", "grp"], "port", "_1"), ["key", "grp"], "left")
    r = r.join(first(to.where(F.col("grp").isin(*ANY)), ["key"], "port", "_2"), "key", "left")
    r = r.join(first(lands, ["key"], "node", "_3"), "key", "left")
    r = r.join(first(lands.where(F.col("key").isin(*ANY)), ["land"], "node", "_4"), "land", "left")
    # Records with the same texts are one class: levels are found for classes, and their records follow in one last join.
    rows, r = _classes(r.withColumn("named", F.coalesce("_1", "_2", "_3", "_4", "named")).withColumn("key", plain("named")), "record", ["ref", "named", "key"])
    r = r.checkpoint()
    n = nodes.select("node", plain("name").alias("name")).checkpoint()

    refs = r.select("ref").distinct().withColumn("_r", F.col("ref"))
    names = n.select("name").distinct().withColumn("_c", F.col("name"))
    holds = contained(names, "_c", "name", refs, "_r", "ref").select(F.col("_r").alias("ref"), F.col("_c").alias("name")).checkpoint()
    at_ref = lambda df: df.join(holds, "ref").join(n, "name").select("_class", "ref", "named", "key", "node")
    mutual = F.col("ref").contains(F.col("key")) | F.col("key").contains(F.col("ref"))
    one = at_ref(r).where(mutual | (F.col("named") == F.col("node"))).select("_class", "node", "named", F.lit(1).alias("level")).distinct().checkpoint()
    left = r.join(one.select("_class").distinct(), "_class", "left_anti").checkpoint()
    keys = left.select("key").distinct().withColumn("_r", F.col("key"))
    alike = likenesses(keys, "_r", "key", names, "_c", "name", EITHER).select(F.col("_r").alias("key"), F.col("_c").alias("name"))
    two = left.join(alike, "key").join(n, "name").select("_class", "node", "named").unionByName(left.join(n, F.col("named") == F.col("node")).select("_class", "node", "named")).distinct().withColumn("level", F.lit(2)).checkpoint()
    last = at_ref(left.join(two.select("_class").distinct(), "_class", "left_anti"))
    hits = one.unionByName(two).unionByName(last.select("_class", "node", "named", F.lit(3).alias("level")).distinct())
    return _expanded(rows, hits).select("record", "node", "named", "level")


def pair_in_order(records: DataFrame, places: DataFrame, route: str, by: str, distance: str) -> DataFrame:
    """The k-th record of a route (by start) with its k-th place (by distance), on routes where their numbers agree."""
    a = running(records, [route], [F.col(by), F.col("record_id")], rank="_k", total="_n")
    b = running(places, [route], [F.col(distance), F.col("place_id")], rank="_k", total="_n")
    return a.join(b, [route, "_k", "_n"]).drop("_k", "_n")


def nearer_direction(forward: DataFrame, backward: DataFrame, route: str, by: str, distance: str) -> DataFrame:
    """Of a route's places measured from both ends, those of the end whose distances differ less in total from the records' starts."""

    def cost(df, way):
        return df.groupBy(route).agg(F.abs(F.sum(F.col(distance) - F.col(by))).alias(way))

    best = cost(forward, "_f").join(cost(backward, "_b"), route).select(route, (F.col("_f") <= F.col("_b")).alias("_fwd"))
    return forward.withColumn("_way", F.lit(True)).unionByName(backward.withColumn("_way", F.lit(False))).join(best, route).where("_way = _fwd").drop("_way", "_fwd")


def marker_reading(points: DataFrame, markers: DataFrame, route: str, cell: float) -> DataFrame:
    """Of the two markers of the route nearest to a point, the smaller reading plus its distance in km.

    points: point_id, x, y, the route; markers: marker_id, x, y, reading, the route. Points of a route without markers are left out.
    """
    near = nearest_k(points, markers, 2, cell, "point_id", "marker_id", route).join(markers.select("marker_id", "reading"), "marker_id")
    return near.groupBy("point_id").agg(F.min_by(F.col("reading") + F.col("distance") / 1000, F.struct("reading", "k")).alias("reading_km"))
