"""Exact top-k search by inner product over a vector-approximation file (operator 2).

Every distinct vector is stored once, quantised to one cell number per
dimension. A scan of the cells bounds each inner product from below and above.
A task keeps the k highest lower bounds that each query has met so far, and
passes on only vectors whose upper bound reaches the lowest of these, so what
leaves a scan is some k rows for each query and task, whatever the table's size.
Queries are scanned in blocks of at most QUERY_BYTES, which are broadcast: the
cells stay where they are. The vectors that are left are read exactly in falling
upper bound: a first helping of each query fixes a k-th exact score, and only
vectors whose bound still reaches it are read after.

Vectors that are equal stand for one another: a class keeps the k + 1 smallest
ids of its members, as no others can be among k results. So a third of all rows
with the same vector costs no more than one row. Queries are classes too.

Defined results: vectors null, with null or non-finite components, or with a
null id take no part; empty vectors meet one another with score 0, and vectors
of different lengths do not meet. Ties go to the smaller id; fewer than k
candidates give fewer results; an empty table gives no rows. Repeated ids are
distinct rows with the same id. Scores rank exactly while they and the products
in them have at most 38 digits, beyond as doubles up to MOST_SCORE, where they
tie; the column of longs holds the nearest long. Other columns take no part,
whatever they are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.llm.shared import Scratch, shared_table, small_batches

BLOCK = 1024  # vectors of a block of the approximation file; also queries that are bounded at once
QUERY_BYTES = 32 << 20  # of the exact query vectors that are broadcast at once
HELD = 1 << 20  # candidates that a task gathers before it drops those that better bounds have ruled out
PAIRS = 1 << 34  # of queries and vectors that a task bounds, about
CELL_BITS = 8
MOST = 1e150  # of a component's magnitude: larger ones count as this, so that sums of products stay finite
MOST_SCORE = 9e37  # where 38 digits are not enough
EXACT = 2.0**53


def components(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as whole doubles: from 2**52 on a double is whole, so no long can overflow."""
    y = lambda c: c.cast("double") * scale
    return F.transform(vec, lambda c: F.when(F.abs(y(c)) < 2.0**52, F.floor(y(c)).cast("double")).otherwise(F.greatest(F.least(y(c), F.lit(MOST)), F.lit(-MOST))))


def takes_part(id_col: str, vec_col: str) -> Column:
    return F.col(vec_col).isNotNull() & F.col(id_col).isNotNull() & ~F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def vector_classes(vectors: DataFrame, id_col: str, vec_col: str, scale: int, keep: int) -> DataFrame:
    """class (smallest id), v (components: floor(scale * x)) and ids (the `keep` smallest, sorted) of each distinct vector."""
    rows = vectors.where(takes_part(id_col, vec_col)).select(F.col(id_col).cast("long").alias("id"), components(F.col(vec_col), scale).alias("v"))
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("k") <= keep)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("class"), "v", "ids")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (class, v) to blocks of at most BLOCK rows of equal length: classes, dim, base and step of the cells, cells."""
    for b in batches:
        by_dim: dict[int, list[tuple[int, list[float]]]] = {}
        for c, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            by_dim.setdefault(len(v), []).append((c, v))
        for dim, rows in by_dim.items():
            for i in range(0, len(rows), BLOCK):
                part = rows[i : i + BLOCK]
                m = np.array([v for _, v in part], np.float64)
                lo, hi = m.min(0), m.max(0)
                step = np.maximum(1, np.ceil((hi - lo + 1) / (1 << CELL_BITS)))
                cells = np.minimum((m - lo) // step, (1 << CELL_BITS) - 1).astype(np.uint8)
                yield pa.record_batch([pa.array([x]) for x in ([c for c, _ in part], dim, lo.tobytes(), step.tobytes(), cells.tobytes())], _BLOCK_ARROW)


_BLOCK_ARROW = pa.schema([("classes", pa.list_(pa.int64())), ("dim", pa.int32()), ("base", pa.binary()), ("step", pa.binary()), ("cells", pa.binary())])
_BLOCK = "classes array<long>, dim int, base binary, step binary, cells binary"


def approximation_file(classes: DataFrame) -> DataFrame:
    """The quantised cells, in blocks."""
    return classes.select("class", "v").mapInArrow(_packed, _BLOCK)


class _Asked:
    """Exact query vectors of one length, and what a task knows of them."""

    def __init__(self, classes: np.ndarray, q: np.ndarray, need: int):
        self.classes, self.q, self.need = classes, q, need
        self.best = np.full((len(q), need), -np.inf)  # the highest lower bounds so far
        self.found: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def bound(self, base: np.ndarray, step: np.ndarray, cells: np.ndarray, classes: np.ndarray) -> None:
        # A component lies in [edge, edge + step - 1]; doubles hold sums of integers below EXACT exactly.
        edge, width, d = base + cells * step, step - 1, len(base)
        for i in range(0, len(self.q), BLOCK):
            q = self.q[i : i + BLOCK]
            at_edge = q @ edge.T
            low = at_edge + (np.minimum(q, 0) @ width)[:, None]
            high = at_edge + (np.maximum(q, 0) @ width)[:, None]
            size = np.abs(q) @ (np.abs(base) + step * (1 << CELL_BITS))
            if (size >= EXACT).any():  # rounding of edges, products and sums, generously
                slack = np.where(size < EXACT, 0.0, size * (d + 8) * 2.0**-51)[:, None]
                low, high = low - slack, high + slack
            both = np.concatenate([self.best[i : i + BLOCK], low], 1)
            self.best[i : i + BLOCK] = np.partition(both, both.shape[1] - self.need, axis=1)[:, both.shape[1] - self.need :]
            r, c = np.nonzero(high >= self.best[i : i + BLOCK].min(1)[:, None])
            self.found.append((r + i, classes[c], low[r, c], high[r, c]))
            self.held += len(r)
        if self.held > HELD:
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """Only the candidates that the bounds so far leave."""
        r, c, low, high = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = high >= self.best.min(1)[r]
        self.found = [(r[keep], c[keep], low[keep], high[keep])]
        self.held = int(keep.sum())
        return self.found[0]


def _scan(asked, need: int):
    """Cell blocks to candidates (qclass, class, low, high) that can be among the task's k best of a query. asked: by length, classes and vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {d: _Asked(c, q, need) for d, (c, q) in asked.value.items()}
        for b in batches:
            for r in b.to_pylist():
                if (mine := known.get(r["dim"])) is not None:
                    cells = np.frombuffer(r["cells"], np.uint8).reshape(len(r["classes"]), r["dim"])
                    mine.bound(np.frombuffer(r["base"], np.float64), np.frombuffer(r["step"], np.float64), cells, np.array(r["classes"], np.int64))
        for mine in known.values():
            if mine.found:
                r, c, low, high = mine.settle()
                for i in range(0, len(r), HELD):
                    yield pa.record_batch([pa.array(x[i : i + HELD]) for x in (mine.classes[r], c, low, high)], ["qclass", "class", "low", "high"])

    return run


def query_blocks(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The exact query vectors (class, v) by length, QUERY_BYTES at once at most (one vector, if it is longer)."""
    rows, size = [], 0

    def block() -> dict:
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r["v"]), []).append(r)
        return {d: (np.array([r["class"] for r in x], np.int64), np.array([r["v"] for r in x], np.float64).reshape(len(x), d)) for d, x in by_dim.items()}

    for r in queries.toLocalIterator():
        if rows and size + 8 * len(r["v"]) > QUERY_BYTES:
            yield block()
            rows, size = [], 0
        rows.append(r)
        size += 8 * len(r["v"])
    if rows:
        yield block()


def candidates(classes: DataFrame, queries: DataFrame, need: int, scratch: Scratch) -> DataFrame:
    """qclass, class, low, high: what each scan of the approximation file leaves of each query."""
    spark = classes.sparkSession
    small_batches(spark)
    cells = scratch.table(approximation_file(classes), "cells")
    counted = cells.select(F.sum(F.size("classes")).alias("vectors"), F.count("*").alias("blocks")).first()
    out = None
    for block in query_blocks(queries):
        n = sum(len(c) for c, _ in block.values())
        tasks = min(counted["blocks"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * counted["vectors"] // PAIRS)))
        shared = spark.sparkContext.broadcast(block)
        found = scratch.table(cells.repartition(max(1, tasks)).mapInArrow(_scan(shared, need), "qclass long, class long, low double, high double"), "bounds")
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "qclass long, class long, low double, high double")


def topk(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, helping: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row for which the Column is_query holds, itself excepted.

    helping: multiples of k + 1 that the first exact reading takes of each query.
    """
    need = k + 1
    with Scratch(vectors.sparkSession) as scratch:
        return shared_table(_ranked(vectors, is_query, k, need, id_col, vec_col, scale, helping, scratch.table, scratch), "top-k")


def _ranked(vectors: DataFrame, is_query, k: int, need: int, id_col: str, vec_col: str, scale: int, helping: int, table, scratch: Scratch) -> DataFrame:
    classes = table(vector_classes(vectors, id_col, vec_col, scale, need), "vectors")
    asked = vectors.where(is_query & takes_part(id_col, vec_col)).select(F.col(id_col).cast("long").alias("query_id"), components(F.col(vec_col), scale).alias("v"))
    asked = table(asked.join(classes.select("v", "class"), "v").select("query_id", F.col("class").alias("qclass")), "asked")
    qids = asked.select(F.col("qclass").alias("class")).distinct()
    qclasses = table(classes.join(qids, "class", "left_semi").select("class", "v"), "queries")
    found = candidates(classes, qclasses, need, scratch)

    by_low = Window.partitionBy("qclass").orderBy(F.desc("low"), "class")
    kth = found.withColumn("k", F.row_number().over(by_low)).where(F.col("k") <= need).groupBy("qclass").agg(F.min("low").alias("kth"), F.count("*").alias("n"))
    kth = kth.select("qclass", F.when(F.col("n") == need, F.col("kth")).alias("kth"))
    able = found.join(kth, "qclass").where(F.col("kth").isNull() | (F.col("high") >= F.col("kth"))).select("qclass", "class", "high")
    by_high = Window.partitionBy("qclass").orderBy(F.desc("high"), "class")
    able = table(able.withColumn("k", F.row_number().over(by_high)), "candidates")

    exact = classes.select("class", "v")
    query = qclasses.select(F.col("class").alias("qclass"), F.col("v").alias("q"))

    def scored(pairs: DataFrame) -> DataFrame:
        met = pairs.join(exact, "class").join(query, "qclass")
        sizes = F.aggregate(F.zip_with("q", "v", lambda a, b: F.abs(a * b)), F.lit(0.0), lambda s, x: s + x)
        dot = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        # Beyond doubles' exact range by digits; a try_ gives null where 38 of them are not enough.
        whole = "decimal(38,0)"
        products = F.zip_with("q", "v", lambda a, b: F.try_multiply(a.try_cast(whole), b.try_cast(whole)).cast(whole))
        digits = F.aggregate(products, F.lit(0).cast(whole), lambda s, x: F.try_add(s, x).cast(whole))
        score = F.when(sizes < EXACT, dot.cast(whole)).otherwise(F.coalesce(digits, F.greatest(F.least(dot, F.lit(MOST_SCORE)), F.lit(-MOST_SCORE)).cast(whole)))
        return met.select("qclass", "class", score.alias("score"))

    first = table(scored(able.where(F.col("k") <= helping * need)), "first")
    by_score = Window.partitionBy("qclass").orderBy(F.desc("score"), "class")
    sure = first.withColumn("k", F.row_number().over(by_score)).where(F.col("k") == need).select("qclass", F.col("score").cast("double").alias("sure"))
    later = able.where(F.col("k") > helping * need).join(sure, "qclass").where(F.col("high") >= F.col("sure")).select("qclass", "class")
    both = first.unionByName(scored(later))
    # A class brings at least one result each, so the best k + 1 classes hold the best k rows besides the query's own.
    best = both.withColumn("k", F.row_number().over(by_score)).where(F.col("k") <= need).drop("k")
    members = best.join(classes.select("class", "ids"), "class").select("qclass", "score", F.explode("ids").alias("vec_id"))
    by_rank = Window.partitionBy("qclass").orderBy(F.desc("score"), "vec_id")
    members = members.withColumn("k", F.row_number().over(by_rank)).where(F.col("k") <= need)
    lists = members.groupBy("qclass").agg(F.sort_array(F.collect_list(F.struct("k", "vec_id", "score"))).alias("best"))
    # The query's own row is left out once; rows that repeat its id are other rows.
    own = F.array_position(F.transform("best", lambda x: x["vec_id"]), F.col("query_id")).cast("int")
    rest = F.when(own > 0, F.concat(F.slice("best", 1, own - 1), F.slice("best", own + 1, need))).otherwise(F.col("best"))
    out = asked.join(lists, "qclass").select("query_id", F.posexplode(F.slice(rest, 1, k)).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.greatest(F.least("x.score", F.lit(2**63 - 1)), F.lit(-(2**63))).cast("long").alias("score"))
