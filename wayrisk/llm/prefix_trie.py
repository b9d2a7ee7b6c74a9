"""Prefix trie of conversations in double arrays (operator 12).

A turn is known by 120 bits of the SHA-256 of its role and text, a sequence of
turns by the exclusive or of 128 bits drawn from each turn and its place, so a
node is (depth, a, b) and its parent is found without its text. Long
conversations are cut in blocks of BLOCK turns, each with the hash of what goes
before it; equal blocks after equal prefixes become one row, counted.

Rows are dealt by ranges of their prefixes. A shard packs the blocks that it
gets at once into one double array: distinct prefixes and turns get dense ids,
BASE[s] + id is the slot of the child of slot s by that id, and CHECK names the
parent of a slot. Traversing the array gives each node what its members add:
their number, their smallest id, and bytes. Nodes on the upper levels lie in
several shards; their sums are merged in Spark by the node's key.

Sums over subtrees need no walk from the leaves. The smallest member of a node
owns it; a conversation owns the nodes of its path from some depth on. So each
node is counted once, by its owner, and a second traversal adds what a
conversation owns to all nodes above.

Hot keys: turns of a conversation are numbered in buckets of TURN_BUCKET turn
numbers, then shifted; equal conversations are one row before any shard sees
them; a common first turn is in many shards. The one work that can't be split is
the hash over the ids that end at one node, as SHA-256 reads in order: they come
as texts of at most 4,096 ids and are streamed.

Defined results: turns go by turn number, null first, ties by the hash of role
and text; null role or text is empty. Rows with a null conv_id take no part. An
empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.llm.shared import Scratch, shared_table

BLOCK = 32  # turns
TURN_BUCKET = 12  # bits of turn numbers
ID_BUCKET = 12  # bits of conversation ids in one text of ids
SHARD_ROWS = 4096  # blocks of one double array
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "a", "b"]
NEVER = 1 << 60  # depth at which a conversation that owns nothing would own


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, p (place from 0), k1, k2 (the turn), bytes (of its text)."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    part = lambda i: F.conv(F.substring(F.col("sha"), i, 15), 16, 10).cast("long")
    bucket = F.coalesce(F.shiftright(F.col("turn").cast("long"), TURN_BUCKET), F.lit(-(1 << 63)))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), sha.alias("sha"), F.octet_length(text).cast("long").alias("bytes"))
    rows = rows.select("conv_id", "turn", bucket.alias("bucket"), part(1).alias("k1"), part(16).alias("k2"), "bytes")
    own = Window.partitionBy("conv_id", "bucket").orderBy(F.asc_nulls_first("turn"), "k1", "k2")
    ranked = rows.withColumn("k", F.row_number().over(own) - 1)
    sizes = rows.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("conv_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return ranked.join(shifts, ["conv_id", "bucket"]).select("conv_id", (F.col("shift") + F.col("k")).alias("p"), "k1", "k2", "bytes")


def rebuilt(turns: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """numbered() turns to those of the rebuilt conversations; a row with place null stands for each conversation.

    The first h turns of the conversation that opens the id's group, h being crc32 of the id modulo most + 1, then the own turns after the first h.
    """
    conv = F.col("conv_id")
    opener = conv - conv % group
    convs = turns.select("conv_id").distinct().select("conv_id", opener.alias("opener"), (F.crc32(conv.cast("string").cast("binary")) % (most + 1)).cast("int").alias("h"))
    turn = F.struct("p", "k1", "k2", "bytes")
    heads = turns.where((F.col("p") < most) & (opener == conv)).groupBy(F.col("conv_id").alias("opener")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    plan = convs.join(heads, "opener", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<p:long,k1:long,k2:long,bytes:long>>")), 1, F.col("h")))
    taken = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.*")
    shift = plan.select("conv_id", "h", (F.size("head") - F.col("h")).alias("shift"))
    own = turns.join(shift, "conv_id").where(F.col("p") >= F.col("h")).select("conv_id", (F.col("p") + F.col("shift")).alias("p"), "k1", "k2", "bytes")
    none = F.lit(None).cast("long")
    return taken.unionByName(own).unionByName(plan.select("conv_id", none.alias("p"), none.alias("k1"), none.alias("k2"), none.alias("bytes")))


def blocks(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, j (block), a and b (hash of what goes before), turns (a, b, bytes in order), after (bytes of later blocks), len, and a1, b1 (hash with the block) of each block."""
    salted = lambda i: F.xxhash64(F.lit(i), "p", "k1", "k2")
    rows = turns.select("conv_id", F.coalesce(F.floor(F.col("p") / block), F.lit(0)).cast("long").alias("j"), "p", salted(1).alias("a"), salted(2).alias("b"), "bytes")
    there = F.col("p").isNotNull()
    only = lambda c: F.when(there, F.col(c))
    packed = rows.groupBy("conv_id", "j").agg(
        F.sort_array(F.collect_list(F.when(there, F.struct("p", "a", "b", "bytes")))).alias("t"),
        F.coalesce(F.bit_xor(only("a")), F.lit(0)).alias("xa"),
        F.coalesce(F.bit_xor(only("b")), F.lit(0)).alias("xb"),
        F.coalesce(F.sum(only("bytes")), F.lit(0)).alias("own_bytes"),
    )
    by = Window.partitionBy("conv_id").orderBy("j")
    past, future = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    none = lambda c: F.coalesce(c, F.lit(0))
    out = packed.select("conv_id", "j", none(F.bit_xor("xa").over(past)).alias("a"), none(F.bit_xor("xb").over(past)).alias("b"), F.transform("t", lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["bytes"].alias("bytes"))).alias("turns"), none(F.sum("own_bytes").over(future)).alias("after"), F.lead("j").over(by).isNull().alias("last"), "xa", "xb")
    return out.select("conv_id", "j", "a", "b", "turns", "after", "last", F.col("a").bitwiseXOR(F.col("xa")).alias("a1"), F.col("b").bitwiseXOR(F.col("xb")).alias("b1"))


class DoubleArray:
    """A trie over dense ids: slot 0 is the root; ids are 0 or more, -1 ends a path."""

    def __init__(self, paths: np.ndarray):
        """paths: one row of ids for each path, filled up with -1."""
        room = paths.size + 2
        self.base, self.check = np.zeros(room, np.int64), np.full(room, -1, np.int64)
        self.slots = np.full(paths.shape, -1, np.int64)  # of each path's nodes
        self.free, at = 1, np.zeros(len(paths), np.int64)
        for depth in range(paths.shape[1]):
            rows = np.nonzero(paths[:, depth] >= 0)[0]
            if not len(rows):
                break
            self._add(at[rows], paths[rows, depth])
            at[rows] = self.child(at[rows], paths[rows, depth])
            self.slots[rows, depth] = at[rows]

    def child(self, slots: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Slots of the children by these ids, -1 where there are none."""
        to = self.base[slots] + ids
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == slots), to, -1)

    def _add(self, parents: np.ndarray, ids: np.ndarray) -> None:
        pairs = np.unique(np.stack([parents, ids], 1), axis=0)
        parent, first, n = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        for i in np.nonzero(n > 1)[0]:  # several children: the first base where all their slots are free
            ids_of = pairs[first[i] : first[i] + n[i], 1]
            spot = self.free
            while True:
                spot = self._next_free(spot, int(ids_of[-1] - ids_of[0]) + 1)
                to = spot + ids_of - ids_of[0]
                if (self.check[to] < 0).all():
                    break
                spot += 1
            self.base[parent[i]] = spot - ids_of[0]
            self.check[to] = parent[i]
        one = n == 1  # an only child takes any free slot
        if one.any():
            want = int(one.sum())
            lacking = want - int((self.check[self.free :] < 0).sum())
            if lacking > 0:
                self._grow(len(self.check) + lacking)
            spots = self.free + np.nonzero(self.check[self.free :] < 0)[0][:want]
            self.base[parent[one]] = spots - pairs[first[one], 1]
            self.check[spots] = parent[one]
        taken = np.nonzero(self.check[self.free :] < 0)[0]
        self.free = self.free + int(taken[0]) if len(taken) else len(self.check)

    def _next_free(self, spot: int, span: int) -> int:
        while True:
            self._grow(spot + span + 1)
            free = np.nonzero(self.check[spot : len(self.check) - span] < 0)[0]
            if len(free):
                return spot + int(free[0])
            spot = len(self.check) - span

    def _grow(self, room: int) -> None:
        if room > len(self.check):
            more = max(room, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])


def _dense(*cols: np.ndarray) -> np.ndarray:
    return np.unique(np.stack(cols, 1), axis=0, return_inverse=True)[1].reshape(-1)


_SHARD = ["j", "a", "b", "rep", "n", "times", "own", "after"]
_PARTIAL = "depth long, a long, b long, pa long, pb long, bytes long, rep long, n long, total long"
_PARTIAL_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _PARTIAL.split(", ")])


def _shard(rows: list[np.ndarray], size: np.ndarray, turns: list[np.ndarray], block: int) -> pa.RecordBatch:
    """What the nodes of one double array get from its blocks.

    rows: j, a, b, rep, n, times, own, after of each block; size: its turns; turns: a, b, bytes of all turns.
    """
    j, a, b, rep, n, times, own, after = rows
    m, wide = len(j), int(size.max(initial=0))
    prefix = _dense(j, a, b)
    ids = _dense(turns[0], turns[1]) + int(prefix.max()) + 1 if len(turns[0]) else np.zeros(0, np.int64)
    row, place = np.repeat(np.arange(m), size), np.arange(len(turns[0])) - np.repeat(np.cumsum(size) - size, size)
    paths = np.full((m, wide + 1), -1, np.int64)
    paths[:, 0], paths[row, place + 1] = prefix, ids
    trie = DoubleArray(paths)

    def spread(x: np.ndarray) -> np.ndarray:
        out = np.zeros((m, wide), np.int64)
        out[row, place] = x
        return out

    ha, hb = np.bitwise_xor.accumulate(np.concatenate([a[:, None], spread(turns[0])], 1), 1), np.bitwise_xor.accumulate(np.concatenate([b[:, None], spread(turns[1])], 1), 1)
    nbytes = spread(turns[2])
    depth = j[:, None] * block + np.arange(1, wide + 1)
    owned = np.where(depth >= own[:, None], nbytes, 0)
    below = np.cumsum(owned[:, ::-1], 1)[:, ::-1] * times[:, None] + after[:, None]
    slots = trie.slots[:, 1:]
    at = slots >= 0
    found, first, which = np.unique(slots[at], return_index=True, return_inverse=True)
    pick = lambda x: x[at][first]
    count, total, least = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64), np.full(len(found), np.iinfo(np.int64).max)
    np.add.at(count, which, np.broadcast_to(n[:, None], slots.shape)[at])
    np.add.at(total, which, below[at])
    np.minimum.at(least, which, np.broadcast_to(rep[:, None], slots.shape)[at])
    cols = [pick(depth), pick(ha[:, 1:]), pick(hb[:, 1:]), pick(ha[:, :-1]), pick(hb[:, :-1]), pick(nbytes), least, count, total]
    if len(top := np.nonzero(j == 0)[0]):  # the root, of which all conversations are members
        whole = owned[top].sum(1) * times[top] + after[top]
        root = [0, 0, 0, 0, 0, 0, rep[top].min(), n[top].sum(), whole.sum()]
        cols = [np.append(c, x) for c, x in zip(cols, root, strict=True)]
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], schema=_PARTIAL_ARROW)


def _shards(block: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, most):
                part = whole.slice(i, most)
                lists = part.column(len(_SHARD))
                turns = lists.flatten()
                yield _shard([part.column(c).to_numpy() for c in range(len(_SHARD))], np.diff(lists.offsets.to_numpy()).astype(np.int64), [turns.field(c).to_numpy(zero_copy_only=False) for c in range(3)], block)

    return run


def in_shards(rows: DataFrame, block: int = BLOCK, most: int = SHARD_ROWS) -> DataFrame:
    """The partial sums of all nodes, from shards of near prefixes, of at most `most` blocks each."""
    return rows.select(*_SHARD, "turns").repartitionByRange("j", "a", "b", "turns").mapInArrow(_shards(block, most), _PARTIAL)


def ends(whole: DataFrame, block: int = BLOCK) -> DataFrame:
    """NODE and ends_sha256 of the nodes at which conversations end, from their last blocks."""
    rows = whole.where("last").select((F.col("j") * block + F.size("turns")).alias("depth"), F.col("a1").alias("a"), F.col("b1").alias("b"), "conv_id")
    texts = rows.groupBy(*NODE, F.shiftright("conv_id", ID_BUCKET).alias("bucket")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for depth, x, y, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if (depth, x, y) == now:
                    state.update(b",")
                else:
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (depth, x, y), hashlib.sha256()
                state.update(ids.encode())
            yield _ended(out)
        if now is not None:
            yield _ended([(*now, state.hexdigest())])

    return texts.repartition(*NODE).sortWithinPartitions(*NODE, "bucket").select(*NODE, "ids").mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*NODE, "ends_sha256"])


def trie_nodes(conversations: DataFrame, group: int = 5, most: int = 8, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    with Scratch(conversations.sparkSession) as scratch:
        turns = scratch.table(numbered(conversations), "turns")
        whole = scratch.table(blocks(rebuilt(turns, group, most), block), "blocks")
        key = ["j", "a", "b", "turns"]
        same = whole.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.sum("after").alias("after"))
        first = in_shards(same.select(*key, "rep", "n", F.col("n").alias("times"), F.lit(0).cast("long").alias("own"), "after"), block, shard_rows)
        merged = first.groupBy(*NODE, "pa", "pb", "bytes").agg(F.min("rep").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("total").alias("passed"))
        merged = scratch.table(merged, "nodes")
        children = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
        nodes = scratch.table(merged.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

        # What each conversation owns: all of its path from own on, and a leaf if its end has no child.
        owner = nodes.groupBy("conv_id").agg(F.min("depth").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
        mine = whole.join(owner, "conv_id", "left")
        own, inside = F.coalesce("own", F.lit(NEVER)), F.size("turns")
        kept = F.aggregate(F.slice("turns", F.least(F.greatest(own - F.col("j") * block, F.lit(1)), inside + 1).cast("int"), F.greatest(inside, F.lit(1))), F.lit(0).cast("long"), lambda s, t: s + t["bytes"])
        later = Window.partitionBy("conv_id").orderBy("j").rowsBetween(1, Window.unboundedFollowing)
        mine = mine.withColumn("kept", kept).withColumn("later", F.coalesce(F.sum("kept").over(later), F.lit(0)))
        # Of equal blocks only the smallest member's can own nodes inside; what the others own comes after it.
        again = mine.groupBy(*key).agg(F.min(F.struct("conv_id", F.coalesce("own", F.lit(NEVER)).alias("own"))).alias("m"), F.sum("later").alias("after"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n"))
        second = in_shards(again.select(*key, F.col("m.conv_id").alias("rep"), "n", F.lit(1).cast("long").alias("times"), F.col("m.own").alias("own"), "after"), block, shard_rows)
        below = second.groupBy(*NODE).agg(F.sum("n").alias("n_leaves"), F.sum("total").alias("distinct"))

        # Only the first node that a conversation owns has another owner's node above it.
        firsts = nodes.join(owner.select("conv_id", "own"), "conv_id").where((F.col("depth") == F.col("own")) & (F.col("depth") > 0)).select(*NODE, (F.col("depth") - 1).alias("up"), "pa", "pb")
        above = nodes.where("n_children > 0").select(F.col("depth").alias("up"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("other"))
        parents = firsts.join(above, ["up", "pa", "pb"]).select(*NODE, "other")
        parents = scratch.table(parents, "parents")
        out = nodes.join(below, NODE).join(parents, NODE, "left").join(ends(whole, block), NODE, "left")
        parent = F.when(F.col("depth") > 0, F.coalesce("other", "conv_id"))
        out = out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("passed") - F.col("distinct")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
        return shared_table(out, "trie")
