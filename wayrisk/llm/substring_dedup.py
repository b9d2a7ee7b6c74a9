r"""Substring dedup by relative Lempel-Ziv parsing (operator 11).

A window is `span` consecutive words; a word goes if a window over it has the
same words as a window that starts anywhere else. All documents are the
reference, cut in blocks by their content: of the ANCHOR-word grams in a window
the one with the smallest hash (ties: the first) is its anchor, and windows in a
row with one anchor are a block. Equal windows have equal anchors, so a window
can only recur in blocks of the same anchor.

1. The index counts each anchor and whether all its blocks are equal. Blocks of
   an anchor that occurs once are unique and go no further.
2. Documents are factored against the index from left to right: a block that
   recurs as a whole is a factor, and factors that touch or overlap are one.
3. At factor boundaries, where a block's anchor recurs but the block itself
   doesn't, its windows are checked one by one against those of the other blocks
   of the anchor; of equal blocks one stands for all.

Counts are partial sums by hash, so a passage in a third of all documents is one
row a task; blocks meet their counts by joins that Spark can split. Texts meet
their factors once, and those with boundaries a second time as what is left of
them. Equality is decided on 128 bits of two hashes of the words.

Defined results: words are `[^\x20\x09-\x0D]+`, unchanged; null and empty texts
have none. Kept words are joined by one space. Repeated rows and ids are
separate documents; a text shorter than a window keeps all words; an empty table
gives no rows. Windows are judged on the input, not on what is left. Other
columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayrisk.llm.shared import Scratch, shared_table, small_batches

SPAN = 35
ANCHOR = 12  # words
PLACE_BITS = 28  # of a gram's place within the texts hashed at once
AT_ONCE = 1 << 22  # bytes hashed at once; a longer text is hashed alone
BYTE_BASE, WORD_BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5  # odd, so they have inverses modulo 2**64
KNOWN, CHECK, STANDS = 0, 1, 2  # a block recurs; its windows are to be checked; it recurs and stands for its equals in checks

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a sequence of numbers, in constant time each."""

    def __init__(self, x: np.ndarray, base: int):
        self.inverse = pow(base, -1, 1 << 64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _power(base, len(x)), dtype=np.uint64)])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        stretch = (self.sums[start + size] - self.sums[start]) * _power(self.inverse, len(self.sums))[start]
        return mixed(stretch ^ mixed(np.atleast_1d(np.asarray(size, np.uint64))))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _SEPARATOR[raw], [True]])
    edge = np.diff(gap.view(np.int8))
    start, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    return start, Rolling(raw.astype(np.uint64) + np.uint64(1), BYTE_BASE).of(start, end - start)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the number of words in each text."""
    data = b" ".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts, hashes, at = [], [], 0
    while at < len(data):  # slices that end at a separator
        cut = at + AT_ONCE
        while cut < len(data) and not _SEPARATOR[data[cut]]:
            cut += 1
        start, h = _hashed(data[at:cut])
        starts.append(start + at)
        hashes.append(h)
        at = cut
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([[0], np.searchsorted(start, ends)]))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def smallest(x: np.ndarray, wide: int) -> np.ndarray:
    """Of each `wide` neighbours the smallest."""
    have, out = 1, x
    while 2 * have <= wide:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(x) - wide + 1], out[wide - have : wide - have + len(x) - wide + 1]) if have < wide else out


def content_blocks(words: np.ndarray, counts: np.ndarray, span: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Blocks of texts: text, start (word within the text), windows, hash of the anchor, hash of the block."""
    first = np.cumsum(counts) - counts
    windows = np.maximum(counts - span + 1, 0)
    text = np.repeat(np.arange(len(counts)), windows)
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    p = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    rolling = Rolling(words, WORD_BASE)
    gram = Rolling(words, OTHER_BASE).of(np.arange(len(words) - anchor + 1), anchor)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = smallest((gram & ~mask) | np.arange(len(gram), dtype=np.uint64), span - anchor + 1)
    at = (least[p] & mask).astype(np.int64)
    new = np.concatenate([[True], (np.diff(p) != 1) | (np.diff(at) != 0)])
    i = np.nonzero(new)[0]
    n = np.diff(np.concatenate([i, [len(p)]]))
    return text[i], p[i] - first[text[i]], n, gram[at[i]].view(np.int64), rolling.of(p[i], n + span - 1).view(np.int64)


def _groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts of at most AT_ONCE bytes together, or one longer text; and the first one's number."""
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) < AT_ONCE:
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def _blocks(span: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, texts in _groups(b.column(2).to_pylist()):
                text, start, n, gram, block = content_blocks(*word_hashes(texts), span, anchor)
                yield pa.record_batch([pa.array(x) for x in (d[at + text], k[at + text], start.astype(np.int64), n.astype(np.int32), gram, block)], ["d", "k", "s", "n", "anchor", "block"])

    return run


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text (bytes, null where null) and (d, k), which only rows with the same id and text share."""
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(doc.alias("id"), F.encode(text, "UTF-8").alias("text"), F.coalesce(doc, F.lit(0)).alias("d"), F.xxhash64(text, doc.isNull()).alias("k"))


def index(docs: DataFrame, scratch: Scratch, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """d, k, s (first window), n (windows) and state of all blocks of keyed() rows whose anchor recurs."""
    spark = docs.sparkSession
    with Scratch(spark) as own:
        blocks = own.table(docs.where("text is not null").select("d", "k", "text").mapInArrow(_blocks(span, anchor), "d long, k long, s long, n int, anchor long, block long"), "blocks")
        often = blocks.groupBy("anchor").agg(F.count("*").alias("times"), F.min("block").alias("low"), F.max("block").alias("high")).where("times > 1")
        often = own.table(often.select("anchor", (F.col("low") != F.col("high")).alias("differ")), "anchors")
        again = scratch.table(blocks.join(often, "anchor"), "recurring")
    ticket = F.xxhash64("d", "k", "s")
    differ = again.where("differ")
    contents = scratch.table(differ.groupBy("anchor", "block").agg(F.count("*").alias("times"), F.min(ticket).alias("ticket")), "contents")
    state = F.when(F.col("times") == 1, CHECK).when(F.col("ticket") == ticket, STANDS).otherwise(KNOWN)
    marked = differ.join(contents, ["anchor", "block"]).select("d", "k", "s", "n", state.alias("state"))
    return again.where("not differ").select("d", "k", "s", "n", F.lit(KNOWN).alias("state")).unionByName(marked)


def _runs(cover: np.ndarray) -> list[int]:
    """start, length, start, length ... of the stretches that are True."""
    edge = np.diff(np.concatenate([[0], cover.view(np.int8), [0]]))
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    return np.stack([start, end - start], 1).ravel().tolist()


def covered(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    change = np.bincount(start, minlength=n + 1) - np.bincount(np.minimum(start + size, n), minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def factors(n_words: int, blocks: list[dict], span: int) -> np.ndarray:
    """Greedy parse: which words lie in a factor, each made of recurring blocks that touch or overlap."""
    known = [x for x in blocks if x["state"] != CHECK]
    return covered(n_words, np.array([x["s"] for x in known], np.int64), np.array([x["n"] + span - 1 for x in known], np.int64))


_PARSED = "id long, d long, k long, n_words long, gone array<int>, sha string, text binary, open boolean, checks array<struct<p:int,x:long,y:long,ask:boolean>>"
_CHECKS = pa.list_(pa.struct([("p", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("ask", pa.bool_())]))
_PARSED_ARROW = pa.schema([("id", pa.int64()), ("d", pa.int64()), ("k", pa.int64()), ("n_words", pa.int64()), ("gone", pa.list_(pa.int32())), ("sha", pa.string()), ("text", pa.binary()), ("open", pa.bool_()), ("checks", _CHECKS)])


def _checks(text: bytes, blocks: list[dict], span: int) -> list[dict]:
    """The windows of blocks to be checked, and of those that stand for their equals."""
    words, _ = word_hashes([text])
    one, two = Rolling(words, WORD_BASE), Rolling(words, OTHER_BASE)
    out = []
    for x in blocks:
        if x["state"] != KNOWN:
            p = np.arange(x["s"], x["s"] + x["n"])
            for q, h, g in zip(p.tolist(), one.of(p, span).view(np.int64).tolist(), two.of(p, span).view(np.int64).tolist(), strict=True):
                out.append({"p": q, "x": h, "y": g, "ask": x["state"] == CHECK})
    return out


def _parsed(span: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for id_, text, d, k, blocks in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                words = (text or b"").split()
                checks = _checks(text, blocks, span) if blocks and any(x["state"] != KNOWN for x in blocks) else []
                gone = factors(len(words), blocks, span) if blocks else np.zeros(len(words), bool)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if blocks else words)
                asks = any(c["ask"] for c in checks)
                out.append((id_, d, k, len(words), _runs(gone), None if asks else hashlib.sha256(kept).hexdigest(), kept if asks or texts else None, asks, checks))
            yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_PARSED_ARROW)], schema=_PARSED_ARROW)

    return run


def _closed(span: int, texts: bool):
    """(id, n_words, gone, text, again): the windows that start at `again` recur as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for id_, n, gone, text, again in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                before = covered(n, np.array(gone[::2], np.int64), np.array(gone[1::2], np.int64))
                start = np.array(again or [], np.int64)
                after = before | covered(n, start, np.full(len(start), span))
                left = np.nonzero(~before)[0]
                kept = b" ".join([w for w, g in zip(text.split(b" ") if len(left) else [], after[left].tolist(), strict=True) if not g])
                out.append((id_, n, _runs(after), hashlib.sha256(kept).hexdigest(), kept if texts else None))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string(), pa.binary()]
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["id", "n_words", "gone", "sha", "text"])

    return run


def without_repeats(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """id, n_words, n_removed, spans (start and length in words of what goes), kept_sha256 and, if asked for, text: the kept words.

    anchor: words of a gram that selects a block, at most span; cost only.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs, id_col, text_col)
    with Scratch(spark) as scratch:
        by_row = scratch.table(index(rows, scratch, span, anchor).groupBy("d", "k").agg(F.collect_set(F.struct("s", "n", "state")).alias("blocks")), "factors")
        parsed = rows.join(by_row, ["d", "k"], "left").select("id", "text", "d", "k", "blocks").mapInArrow(_parsed(span, texts), _PARSED)
        parsed = scratch.table(parsed, "parsed")
        checks = parsed.select("d", "k", F.explode("checks").alias("c")).select("d", "k", "c.*")
        twice = scratch.table(checks.groupBy("x", "y").agg(F.count("*").alias("times")).where("times > 1").select("x", "y"), "windows")
        found = checks.where("ask").join(twice, ["x", "y"]).groupBy("d", "k").agg(F.collect_set("p").alias("again"))
        open_rows = parsed.where("open").select("id", "d", "k", "n_words", "gone", "text").join(found, ["d", "k"], "left")
        done = open_rows.select("id", "n_words", "gone", "text", "again").mapInArrow(_closed(span, texts), "id long, n_words long, gone array<int>, sha string, text binary")
        both = parsed.where("not open").select("id", "n_words", "gone", "sha", "text").unionByName(done)
        pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("gone") / 2).cast("int") - 1), lambda i: F.struct(F.get("gone", 2 * i).alias("start"), F.get("gone", 2 * i + 1).alias("length")))
        spans = F.when(F.size("gone") > 0, pairs).otherwise(F.array().cast("array<struct<start:int,length:int>>"))
        removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"])
        out = both.withColumn("spans", spans).select(F.col("id").alias(id_col), "n_words", removed.alias("n_removed"), "spans", F.col("sha").alias("kept_sha256"), *([F.decode("text", "UTF-8").alias(text_col)] if texts else []))
        return shared_table(out, "kept")
