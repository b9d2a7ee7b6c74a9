"""Sharding on a consistent-hash ring with virtual nodes and bounded loads (operator 7).

Texts hash to a point of a ring of 2**CELL_BITS cells; a point belongs to the
next virtual node clockwise. No shard takes more than load_factor times the
mean number of bytes: what would overflow a full shard continues clockwise to
the next node whose shard has room. Large chunks are placed before small ones.

The walk runs over chunks of texts, never over documents. A chunk is a cell; a
cell of more than 1/HEAVY of a shard (so fewer than HEAVY cells a shard) is cut
into SPLIT chunks by a second hash of the text. Equal texts thus share a chunk
and a shard. Only a chunk that no shard has room for is dealt out by id, as no
other way keeps the bound. Slots count through a shard chunk by chunk.

Defined results: a null text has no bytes; every row, repeated or not, gets a
shard and slot, also without an id; an empty table gives no rows. A piece larger
than all room left goes to the least loaded shard. Rows that share a text and an
id stay together whatever their size. Other columns are left out, whatever they
are named.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.llm.shared import shared_table

CELL_BITS = 14
SPLIT = 512
HEAVY = 64


def ring(shards: int, nodes: int, seed: int) -> tuple[list[int], list[int]]:
    """Points of the virtual nodes, ascending, and their shards."""
    at = sorted((int.from_bytes(hashlib.md5(f"{seed}:{s}:{v}".encode()).digest()[:8], "big"), s) for s in range(shards) for v in range(nodes))
    return [p for p, _ in at], [s for _, s in at]


def walk(chunks: list[tuple[tuple[int, int], int, list[tuple[int, int, int]]]], shards: int, nodes: int, seed: int, load_factor: float) -> list[tuple[int, int, int, int, int]]:
    """((cell, part), bytes, pieces of (key, bytes, rows)) to (cell, part, key, shard, first slot); the pieces of a chunk stay together if a shard has room for it."""
    points, owner = ring(shards, nodes, seed)
    most = load_factor * sum(c[1] for c in chunks) / shards
    load, slot, out = [0] * shards, [0] * shards, []

    def with_room(cell: int, size: int) -> int | None:
        i, full = bisect_left(points, cell << (64 - CELL_BITS)), set()
        for k in range(len(owner)):
            s = owner[(i + k) % len(owner)]
            if s not in full:
                if load[s] + size <= most:
                    return s
                full.add(s)
                if len(full) == shards:
                    break
        return None

    for (cell, part), size, pieces in sorted(chunks, key=lambda c: (-c[1], c[0])):
        whole = with_room(cell, size)
        for key, piece, rows in sorted(pieces, key=lambda p: (-p[1], p[0])):
            s = with_room(cell, piece) if whole is None else whole
            if s is None:
                s = min(range(shards), key=lambda x: (load[x], x))
            out.append((cell, part, key, s, slot[s]))
            load[s] += piece
            slot[s] += rows
    return out


def shard(docs: DataFrame, shards: int = 8, nodes: int = 128, load_factor: float = 1.002, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size (bytes + 1), text_crc32, shard, slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - CELL_BITS).cast("int").alias("cell"),
        F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(SPLIT)).cast("int").alias("part"),
        F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(SPLIT)).cast("int").alias("key"),
    )
    rows = shared_table(rows, "ring")
    totals = [F.sum("size").alias("bytes"), F.count("*").alias("rows")]
    cells = rows.groupBy("cell").agg(*totals).collect()
    all_bytes, all_rows = sum(c.bytes for c in cells), sum(c.rows for c in cells)

    def heavy(c) -> bool:
        return c.rows > 1 and max(c.bytes / all_bytes, c.rows / all_rows) * shards * HEAVY > 1

    def marked(found: list, keys: list[str], flag: str) -> DataFrame:
        """Fewer than 2 * shards * HEAVY heavy ones, as each holds that share of the bytes or rows; so it can be broadcast."""
        table = spark.createDataFrame([tuple(c[k] for k in keys) for c in found], ", ".join(f"{k} int" for k in keys))
        return F.broadcast(table.withColumn(flag, F.lit(True)))

    big = [c for c in cells if heavy(c)]
    chunks = [((c.cell, -1), c.bytes, [(-1, c.bytes, c.rows)]) for c in cells if not heavy(c)]
    rows = rows.join(marked(big, ["cell"], "cut"), "cell", "left").withColumn("part", F.when(F.col("cut"), F.col("part")).otherwise(-1)).drop("cut")
    parts = rows.where("part >= 0").groupBy("cell", "part").agg(*totals).collect() if big else []
    huge = [c for c in parts if heavy(c)]
    chunks += [((c.cell, c.part), c.bytes, [(-1, c.bytes, c.rows)]) for c in parts if not heavy(c)]
    rows = rows.join(marked(huge, ["cell", "part"], "deal"), ["cell", "part"], "left").withColumn("key", F.when(F.col("deal"), F.col("key")).otherwise(-1)).drop("deal")
    pieces: dict = {}
    for c in rows.where("key >= 0").groupBy("cell", "part", "key").agg(*totals).collect() if huge else []:
        pieces.setdefault((c.cell, c.part), []).append((c.key, c.bytes, c.rows))
    chunks += [((c.cell, c.part), c.bytes, pieces[c.cell, c.part]) for c in huge]
    # Bounded as said above, so it can be broadcast.
    placed = spark.createDataFrame(walk(chunks, shards, nodes, seed, load_factor), "cell int, part int, key int, shard int, first long")
    k = F.row_number().over(Window.partitionBy("cell", "part", "key").orderBy(id_col, "text_crc32", "size"))
    out = rows.withColumn("k", k).join(F.broadcast(placed), ["cell", "part", "key"])
    return out.select(id_col, "size", "text_crc32", "shard", (F.col("first") + F.col("k") - 1).alias("slot"))
