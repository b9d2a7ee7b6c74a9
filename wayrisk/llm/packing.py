"""Best-fit packing of token pieces by large-item matching (operator 10).

Pieces are tokenised once into a narrow table. The packing is then decided on
the histogram of piece lengths, which has at most `capacity` rows however many
documents there are: pieces above a third of the capacity are matched greedily,
two to a bin at most; smaller ones go to the tightest gap that holds them, in
falling length, whole runs of equal bins at a time. Pieces take their places by
their rank among those of the same length.

Defined results: a null or empty text is its end token alone; repeated rows and
ties are placed one by one, also without an id; an empty table gives no rows.
Other columns are left out, whatever they are named. A document longer
than `capacity` is cut into pieces of `capacity`, a shorter one first.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.llm.shared import shared_table, small_batches
from wayrisk.llm.token_counts import safe_pattern

MEMO_ENTRIES = 200_000
LONGEST_MEMO = 64


class SpacedIds(dict):
    """Ids of a space and a chunk without outer white space, as little-endian unsigned 32-bit bytes; bounded memo.

    No pre-token crosses a lone space between two other characters, so a text
    is the first chunk followed by such spaced chunks. Raises ValueError where
    that does not hold.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise ValueError(chunk)
        ids = self.encode(" " + chunk)
        if len(chunk) <= LONGEST_MEMO:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids


def id_encoder(tokenizer_path: str):
    """A function from text to its ids as bytes, equal to the library's."""
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tok = Tokenizer.from_file(tokenizer_path)
    specials = [t.content for t in tok.get_added_tokens_decoder().values()]
    chars = {chr(b): b for b in (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))}
    chars |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in chars)}
    ranks = {bytes(chars[c] for c in s): i for s, i in tok.get_vocab(with_added_tokens=False).items() if s not in specials}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast, safe = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), safe_pattern()

    def plain(text: str) -> bytes:
        if safe.fullmatch(text):
            return array("I", fast.encode_ordinary(text)).tobytes()
        return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()

    spaced = SpacedIds(plain)

    def encode(text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in specials):
            return array("I", tok.encode(text, add_special_tokens=False).ids).tobytes()
        head, *tail = text.split(" ")
        if not head or head[-1].isspace():
            return plain(text)
        try:
            return plain(head) + b"".join(map(spaced.__getitem__, tail))
        except ValueError:
            return plain(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; the first may be shorter."""
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, first if first and s == 0 else capacity) for s in starts]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str, end_id: int = 0) -> DataFrame:
    """id, piece, start, length, ids_crc32: one row for each piece of every document."""
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(tokenizer_path)
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column(1)):
                ids = memoryview(encode(text.as_py()) + end)
                for k, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                    at.append(i)
                    rows.append((k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.record_batch([b.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], ["id", "piece", "start", "length", "ids_crc32"])

    return given.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def place(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, how many, first sequence, offset) for the histogram of lengths.

    The k-th of a placement's pieces goes to sequence first + k at the offset.
    """
    left, rank, out, bins = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free tokens: runs (first bin, bins)
    mask = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        out.append((length, rank[length], n, first, offset))
        rank[length] += n
        left[length] -= n

    def free(gap: int, first: int, n: int) -> None:
        nonlocal mask
        if gap and n:
            gaps[gap].append((first, n))
            mask |= 1 << gap

    large = sorted(x for x in counts if 3 * x > capacity)
    while large:
        x = large[-1]
        if not left[x]:
            large.pop()
            continue
        k = bisect_left(large, capacity - x + 1) - 1
        while k >= 0 and left[large[k]] < (2 if large[k] == x else 1):
            if not left[large[k]]:
                large.pop(k)
            k -= 1
        y = large[k] if k >= 0 else 0
        n = (left[x] // 2 if y == x else min(left[x], left[y])) if y else left[x]
        put(x, n, bins, 0)
        if y:
            put(y, n, bins, x)
        free(capacity - x - y, bins, n)
        bins += n
    for x in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[x]:
            if fit := mask >> x:
                gap = x + (fit & -fit).bit_length() - 1
                first, n = gaps[gap].pop()
                t = min(n, left[x])
                if t < n:
                    gaps[gap].append((first + t, n - t))
                if not gaps[gap]:
                    mask &= ~(1 << gap)
                put(x, t, first, capacity - gap)
                free(gap - x, first, t)
            else:
                each = min(capacity // x, left[x])
                n = left[x] // each
                for j in range(each):
                    put(x, n, bins, j * x)
                free(capacity - each * x, bins, n)
                bins += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces with the sequence and offset that hold them.

    Broadcast: the placements, whose number depends on capacity alone (under
    two runs of bins for each length, and as many placements as these hold pieces).
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = shared_table(token_pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = sorted(place(counts, capacity))
    base, before = {}, 0
    for x in sorted(counts):
        base[x], before = before, before + counts[x]
    # Ranks among equal lengths: each length is dealt to about as many parts as a part has rows.
    parts = {x: math.ceil(n / max(500, math.isqrt(n))) for x, n in counts.items()}
    lengths = spark.createDataFrame([(x, base[x], parts[x]) for x in counts], "length long, base long, parts long")
    dealt = pieces.join(F.broadcast(lengths), "length").withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.col("parts")))
    offsets = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    offsets = offsets.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = dealt.withColumn("k", F.row_number().over(within)).join(offsets, ["length", "part"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("before") + F.col("k") - 1).alias("place"))
    cols = np.array(placed, dtype=np.int64).reshape(-1, 5)
    table = spark.sparkContext.broadcast((np.array([base[x] for x, *_ in placed], np.int64) + cols[:, 1], cols[:, 3], cols[:, 4]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, first, offset = table.value
        for b in batches:
            p = b.column(5).to_numpy(zero_copy_only=False)
            i = np.searchsorted(starts, p, side="right") - 1
            yield pa.record_batch([*b.columns[:5], pa.array(first[i] + p - starts[i]), pa.array(offset[i])], [*b.schema.names[:5], "sequence_id", "offset"])

    out = ranked.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
