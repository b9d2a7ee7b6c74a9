"""N-gram Jaccard join with token-combination prefixes (operator 3).

A text's tokens are its distinct word shingles, as 64-bit hashes; equality of
tokens, also in the last check, is equality of hashes. Tokens are in two classes:
frequent ones (counted at least FREQUENT times, or more often where these would
be over MOST_FREQUENT) and rare ones. Of each chunk of the corpus the tokens that
it has twice or more are counted as they are, and of the others every ONE_OF-th,
drawn by token and chunk, for nearly as many; so the summed counts are near the
true ones however thinly a token is spread. The global order puts rare tokens
first. Of each set as long a prefix is indexed as makes its coverage reach the number of tokens
that a partner may lack, plus one: a rare token covers 1 and is indexed alone;
frequent tokens, dealt to GROUPS groups by hash, cover one less than a group has
in the prefix and are indexed as pairs of a group. Two sets that are similar
enough then share an index entry: if none of the shorter prefix's rare tokens
and at most one of each group were shared, more tokens would be missing than may
be. A set lacks less in a partner that is no smaller, so the entries of its
shorter prefix for that case are marked, and a pair is a candidate only where
the smaller set's entry is marked. So pages that share a passage without being
similar do not meet, however many they are, unless their sizes differ and bring
the passage into both prefixes. Sets of up to SMALL tokens cannot be covered by
pairs; they (and, so that sizes overlap, sets up to SMALL / 0.8) are indexed by
single tokens in a space of their own.

Equal sets are one class (128-bit digests), so copies never meet. Entries are
shuffled once, by signature; windows over that one exchange drop repeated and
lonely entries and pair the classes of entries of up to AT_ONCE classes.
Distinct pairs are filtered by sizes and by parity bitmaps, which differ in at
most as many bits as the sets in tokens; the others are verified on the whole
texts. The components of links are wanted, not each link. So classes of larger
entries meet in rounds: an entry's pivots (those of its classes that have the
most such entries, as an original has more than its altered copies) meet its
classes that they are not yet connected with and whose bitmaps are near, and leave. The number of pivots
grows sixteenfold by round, entries whose classes are all connected go, and entries that
are down to AT_ONCE classes are paired at once. So no link between components is
lost, a group of near copies costs in proportion to its size, and rounds grow
with the logarithm of the largest entry.

Defined results: words are runs of other than ASCII white space with A-Z
lowered; fewer than n words make one shingle; a null, empty or blank text has
no shingles and is alone in its component. Rows with a null id have no
component. Repeated rows are copies; rows that share an id but not a text count
as separate texts of that id, each with its own component. An empty table gives
no rows. Other columns are left out of near_duplicates and kept by
without_near_copies, whatever they are named.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.llm.shared import Scratch, all_columns, shared_table, small_batches

FREQUENT = 16  # a token is frequent from this count on, or from a higher one that leaves at most MOST_FREQUENT
MOST_FREQUENT = 1 << 21  # which are broadcast, 8 bytes each
BITS = 512  # of a parity bitmap; WIDE_BITS for sets from WIDE_FROM tokens on
WIDE_BITS, WIDE_FROM = 8192, 900
AT_ONCE = 8  # an entry of at most so many classes has all its pairs verified
PIVOTS = 4  # of an entry in the first round, sixteen times as many in each that follows
GROUPS = 16
SMALL = 24  # above it, pairs always suffice: size - GROUPS >= size - ceil(0.8 * size) + 1
CHUNK_TOKENS = 1_000_000
CHUNK_LEAST = 2
ONE_OF = 8  # of a chunk's other tokens one in so many is counted, as ONE_OF - 1, so that two draws do not make a token frequent
MEMO_WORDS = 150_000
MEMO_CLASSES = 100_000
COPIED, MOST_COPIED = 64, 50_000  # of the most copied classes, from COPIED rows on, only one row is indexed
BROADCAST_ROWS = 500_000  # of two or three numbers each; larger sides are shuffled
SALTS = 32  # to which the classes of an entry are dealt while its pivots are sought
_M = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; bounded memo."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    length = min(n, len(w))
    h = np.full(len(w) - length + 1, length, np.uint64)
    for j in range(length):
        h = h * _M + w[j : j + len(h)]
    return np.unique(_mixed(h))


def class_of(tokens: np.ndarray) -> tuple[int, int]:
    """A set's class: two signed 64-bit halves of a digest of all its tokens."""
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def lacking(size: int, percent: int) -> int:
    """How many of its tokens a set may lack in a partner."""
    return size - -(-percent * size // 100)


def lacking_in_larger(size: int, percent: int) -> int:
    """How many of its tokens a set may lack in a partner that is no smaller."""
    return size - -(-2 * percent * size // (100 + percent))


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set, and which of them its prefix for partners no smaller has; see the module's text."""
    cover, short = lacking(len(tokens), percent) + 1, lacking_in_larger(len(tokens), percent) + 1
    out, marked = [], []
    if len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens
        ordered = np.concatenate([tokens[~often], tokens[often]])
        rare = len(tokens) - int(often.sum())
    else:
        ordered, rare = tokens, len(tokens)
    if 100 * SMALL >= percent * len(tokens):
        out.append(_mixed(ordered[:cover] ^ np.uint64(0x5851F42D4C957F2D)))
        marked.append(np.arange(cover) < short)
    if len(tokens) > SMALL:
        out.append(ordered[: min(cover, rare)])
        marked.append(np.arange(len(out[-1])) < short)
        if rare < cover:
            groups: list[list[int]] = [[] for _ in range(GROUPS)]
            covered, pairs, early = rare, [], []
            for t in ordered[rare:].tolist():
                if covered >= cover:
                    break
                group = groups[t >> 7 & (GROUPS - 1)]
                pairs += [(u, t) for u in group]
                early += [covered < short] * len(group)
                covered += bool(group)
                group.append(t)
            both = np.array(pairs, np.uint64).reshape(-1, 2)
            out.append(_mixed(both[:, 0] * _M + both[:, 1]))
            marked.append(np.array(early, bool))
    return np.concatenate(out), np.concatenate(marked)


def parity(tokens: np.ndarray, bits: int) -> np.ndarray:
    """The parity of the number of tokens by hash value, a bit each."""
    return np.packbits(np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).view(np.int64)


def _sets(n: int, chunk_tokens: int = CHUNK_TOKENS):
    """(id, text) to (id, size, hi, lo, bits, wide), and with some rows a chunk's most common tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, gathered, many, seen, held = WordHashes(), [], 0, set(), None
        names, longs = ["id", "size", "hi", "lo", "bits", "wide", "tokens", "counts"], pa.list_(pa.int64())
        none = (np.empty(0, np.int64), np.empty(0, np.int64))

        def common() -> tuple[np.ndarray, np.ndarray]:
            if not gathered:
                return none
            token, count = np.unique(np.concatenate(gathered), return_counts=True)
            often = count >= CHUNK_LEAST
            drawn = ~often & (_mixed(token ^ _mixed(gathered[0][:1])) % np.uint64(ONE_OF) == 0)
            gathered.clear()
            return token[often | drawn].view(np.int64), np.where(often, count, ONE_OF - 1)[often | drawn].astype(np.int64)

        for b in batches:
            size, kind, bits, wide, tokens, counts = [], [], [], [], [], []
            for t in b.column(1):
                s = shingles(t.as_py(), n, hashes)
                size.append(len(s))
                kind.append(class_of(s) if len(s) else (None, None))
                bits.append(parity(s, BITS) if len(s) else None)
                wide.append(parity(s, WIDE_BITS) if len(s) >= WIDE_FROM else None)
                if len(s) and kind[-1] not in seen:
                    if len(seen) >= MEMO_CLASSES:
                        seen.clear()
                    seen.add(kind[-1])
                    gathered.append(s)
                    many += len(s)
                got = none
                if many >= chunk_tokens:
                    got, many = common(), 0
                tokens.append(got[0])
                counts.append(got[1])
            if not b.num_rows:
                continue
            # The last batch is held back, as the rest of the partition is a chunk too.
            if held:
                yield pa.record_batch([*held[0], *(pa.array(x, longs) for x in held[1:])], names)
            plain = [b.column(0), pa.array(size, pa.int32()), pa.array([k[0] for k in kind], pa.int64()), pa.array([k[1] for k in kind], pa.int64()), pa.array(bits, longs), pa.array(wide, longs)]
            held = plain, tokens, counts
        if held:
            plain, tokens, counts = held
            got = common()
            tokens[-1], counts[-1] = np.concatenate([tokens[-1], got[0]]), np.concatenate([counts[-1], got[1]])
            yield pa.record_batch([*plain, pa.array(tokens, longs), pa.array(counts, longs)], names)

    return run


def _index(n: int, percent: int, frequent, copied):
    """(id, text) to entries (sig, lo, mark), once for each class that a task meets; mark: twice the size, plus 1 if marked.

    copied: classes of which only the row with the given id is indexed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, often, only, seen = WordHashes(), frequent.value, copied.value, set()
        for b in batches:
            sigs, kinds, marks = [], [], []

            def rows() -> pa.RecordBatch:
                n = [len(s) for s in sigs]
                out = pa.record_batch([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(kinds, np.int64), n)), pa.array(np.concatenate(marks))], ["sig", "lo", "mark"])
                sigs.clear(), kinds.clear(), marks.clear()
                return out

            many = 0
            for i, t in zip(b.column(0), b.column(1), strict=True):
                s = shingles(t.as_py(), n, hashes)
                if not len(s) or (kind := class_of(s)) in seen or (kind in only and only[kind] != i.as_py()):
                    continue
                if len(seen) >= MEMO_CLASSES:
                    seen.clear()
                seen.add(kind)
                entries, marked = signatures(s, often, percent)
                sigs.append(entries)
                kinds.append(kind[1])
                marks.append((2 * len(s) + marked).astype(np.int32))
                many += len(entries)
                if many > 200_000:
                    yield rows()
                    many = 0
            if sigs:
                yield rows()

    return run


def _classified(n: int):
    """A function of texts that gives their class (hi, lo); both are null without words."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = WordHashes()
        for texts in batches:
            sets = [shingles(t.as_py(), n, hashes) for t in texts]
            kinds = [class_of(s) if len(s) else (None, None) for s in sets]
            yield pa.StructArray.from_arrays([pa.array([k[i] for k in kinds], pa.int64()) for i in (0, 1)], ["hi", "lo"])

    return F.arrow_udf(run, "hi long, lo long")


def _own_text(n: int):
    """(class, hi, lo, text) to (class, text) where the text is of that class (rows may share an id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            same = [class_of(shingles(t.as_py(), n, hashes)) == (hi, lo) for t, hi, lo in zip(b.column(3), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield b.select([0, 3]).filter(pa.array(same, pa.bool_()))

    return run


def _verified(n: int, percent: int):
    """(a, b, text of a, text of b) to the linked (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kept = WordHashes(), OrderedDict()

        def tokens(kind: int, text) -> np.ndarray:
            if kind not in kept:
                if len(kept) >= 64:
                    kept.popitem(last=False)
                kept[kind] = shingles(text.as_py(), n, hashes)
            return kept[kind]

        for b in batches:
            links = []
            for x, y, s, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                p, q = tokens(x, s), tokens(y, t)
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    links.append((x, y))
            yield pa.record_batch([pa.array([a for a, _ in links], pa.int64()), pa.array([c for _, c in links], pa.int64())], ["a", "b"])

    return run


def _small(df: DataFrame, rows: int, width: int = 1) -> DataFrame:
    """df to be broadcast if its counted rows (of `width` times two numbers) are few; else shuffled."""
    return F.broadcast(df) if rows * width <= BROADCAST_ROWS else df


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (its smallest node) of the nodes of links (a, b), by contraction: every node joins its smallest neighbour's neighbour until no link is left."""
    edges = scratch.table(links.select("a", "b").where("a <> b").distinct(), "links")
    labels, named = None, 2 * edges.count()
    left = named
    while left:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = scratch.table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")), "parents")
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = parent.join(_small(up, left), "p").select(F.col("a").alias("node"), F.col("pp").alias("component"))
        step = parent.select(F.col("node").alias("component"), F.col("component").alias("next"))
        labels = parent if labels is None else labels.join(_small(step, left), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        labels = scratch.table(labels, "labels")
        x, y = parent.select(F.col("node").alias("a"), F.col("component").alias("x")), parent.select(F.col("node").alias("b"), F.col("component").alias("y"))
        edges = edges.join(_small(x, left), "a").join(_small(y, left), "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = scratch.table(edges.distinct(), "links")
        left = 2 * edges.count()
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


def differing(a: list[Column], b: list[Column]) -> Column:
    """How many bits differ."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0))


def longs(bits: str) -> list[Column]:
    return [F.get(bits, i) for i in range(BITS // 64)]


class _Candidates:
    """Verification of candidate pairs (a, b: the classes' lo) of the sets of a table."""

    def __init__(self, given: DataFrame, sets: DataFrame, classes: DataFrame, n: int, percent: int, scratch: Scratch):
        self.given, self.sets, self.classes, self.n, self.percent, self.scratch = given, sets, classes, n, percent, scratch
        self.id_type = given.schema["id"].dataType.simpleString()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) between classes among pairs (lo_a, lo_b), written."""
        table, percent = self.scratch.table, self.percent
        pairs = table(pairs.distinct(), "pairs")
        n_pairs = pairs.count()
        if not n_pairs:
            return pairs.select(F.col("lo_a").alias("a"), F.col("lo_b").alias("b"))
        named = pairs.select(F.explode(F.array("lo_a", "lo_b")).alias("lo")).distinct()
        met = self.classes.join(_small(named, 2 * n_pairs), "lo", "left_semi").select("class", "id", "hi", "lo")
        own = self.sets.join(_small(met, 2 * n_pairs), ["id", "hi", "lo"]).select("class", "id", "hi", "lo", "size", "bits", "wide").dropDuplicates(["class"])
        own = table(own, "bits")
        a, b = (own.select(F.col("class").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("size", "lo", "bits", "wide"))) for c in "ab")
        widely = F.aggregate(F.zip_with("wide_a", "wide_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, x: t + x)
        able = (F.greatest(differing(longs("bits_a"), longs("bits_b")), widely) * (100 + percent)) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)
        able = table(pairs.join(_small(b, 2 * n_pairs, 32), "lo_b").join(_small(a, 2 * n_pairs, 32), "lo_a").where(able).select("a", "b"), "able")
        n_able = able.count()
        if not n_able:
            return able
        # Only the texts of these pairs are shuffled.
        wanted = own.select("class", "id", "hi", "lo").join(_small(able.select(F.explode(F.array("a", "b")).alias("class")).distinct(), 2 * n_able), "class", "left_semi")
        texts = self.given.join(_small(wanted, 2 * n_able, 2), "id").select("class", "hi", "lo", "text")
        texts = table(texts.mapInArrow(_own_text(self.n), "class long, text string").dropDuplicates(["class"]), "texts")
        a, b = (texts.select(F.col("class").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        both = able.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b")
        return table(both.mapInArrow(_verified(self.n, percent), "a long, b long"), "found")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None) -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id that links reach) of every row.

    percent: least Jaccard similarity of a link, at least 80. class_col: name of
    a further column, struct(hi, lo, component): the class of the row's set, and
    a number of its component (ids can be shared, so component_id may not tell).
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    sets = shared_table(given.mapInArrow(_sets(n), f"id {id_type}, size int, hi long, lo long, bits array<long>, wide array<long>, tokens array<long>, counts array<long>"), "sets")
    narrow = sets.select("id", "size", "hi", "lo")
    with Scratch(spark) as scratch:
        components_of = _components_of(given, sets, n, percent, scratch)
    out = narrow.join(components_of, ["hi", "lo"], "left")
    more = [F.when(F.col("lo").isNotNull(), F.struct("hi", "lo", "component")).alias(class_col)] if class_col else []
    return out.select(F.col("id").alias(id_col), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"), *more)


def _frequent(sets: DataFrame, scratch: Scratch) -> np.ndarray:
    """The sorted frequent tokens."""
    counts = sets.where(F.size("tokens") > 0).select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
    counts = scratch.table(counts.groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("n")).where(F.col("n") >= FREQUENT), "frequent")
    # By powers of two, so that the table of counts has some 40 rows.
    least, total = FREQUENT, 0
    for r in counts.groupBy(F.floor(F.log2("n")).alias("power")).agg(F.count("*").alias("tokens")).orderBy(F.desc("power")).collect():
        total += r.tokens
        if total > MOST_FREQUENT:
            least = 2 ** (r.power + 1)
            break
    found = counts.where(F.col("n") >= least).select("token").toArrow().column("token").to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def _components_of(given: DataFrame, sets: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """hi, lo, component and component_id of every class, written."""
    spark, table = given.sparkSession, scratch.table
    known_rows = sets.where("id is not null and lo is not null")
    classes = known_rows.groupBy("hi", "lo").agg(F.min("id").alias("id"), F.count("*").alias("n_rows"))
    classes = table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    copied = {(r.hi, r.lo): r.id for r in classes.where(F.col("n_rows") >= COPIED).orderBy(F.desc("n_rows"), "hi", "lo").limit(MOST_COPIED).toLocalIterator()}
    frequent, copied = spark.sparkContext.broadcast(_frequent(sets, scratch)), spark.sparkContext.broadcast(copied)

    entries = given.where("id is not null").mapInArrow(_index(n, percent, frequent, copied), "sig long, lo long, mark int")
    of_sig, in_order = Window.partitionBy("sig"), Window.partitionBy("sig").orderBy("mark", "lo")
    # One exchange by sig; the windows share it, and its sort by (mark, lo).
    entries = entries.withColumn("last", F.lag("lo").over(in_order)).withColumn("low", F.min("lo").over(of_sig)).withColumn("high", F.max("lo").over(of_sig))
    entries = entries.where("low <> high and (last is null or last <> lo)")
    entries = entries.withColumn("m", F.count("*").over(of_sig)).withColumn("marked", F.max(F.col("mark") % 2).over(of_sig)).where("m > 1 and marked = 1").select("sig", "lo", "mark", "m")

    def paired(rows: DataFrame, *more: str) -> DataFrame:
        """rows with before: those of its entry's up to AT_ONCE classes that come first."""
        return rows.withColumn("before", F.when(F.col("m") <= AT_ONCE, F.collect_list(F.struct("lo", "mark", *more)).over(in_order.rowsBetween(1 - AT_ONCE, -1))))

    def able(x: str, y: str):
        """Whether entries with these marks may link: sizes are near enough, and the smaller set's is marked."""
        x, y = F.col(x), F.col(y)
        p, q = F.shiftright(x, 1), F.shiftright(y, 1)
        return (F.least(p, q) * 100 >= percent * F.greatest(p, q)) & (F.when(p < q, x % 2).when(q < p, y % 2).otherwise(F.greatest(x % 2, y % 2)) == 1)

    def pairs_of(rows: DataFrame, *more: str) -> DataFrame:
        """The pairs of rows with before that may link, and that differ in the columns more."""
        met = rows.where("before is not null").select("lo", "mark", *more, F.explode("before").alias("x"))
        for c in ("lo", *more):
            met = met.where(F.col(c) != F.col(f"x.{c}"))
        met = met.withColumn("other_mark", F.col("x.mark")).where(able("mark", "other_mark"))
        return met.select(F.least("lo", "x.lo").alias("lo_a"), F.greatest("lo", "x.lo").alias("lo_b"))

    entries = table(paired(entries), "entries")
    frequent.unpersist(), copied.unpersist()
    candidates = _Candidates(given, sets, classes, n, percent, scratch)
    links = candidates.verified(pairs_of(entries))
    large = entries.where("before is null").select("sig", "lo", "mark")
    known, found, pivots, bit_cols = None, links, PIVOTS, [f"b{i}" for i in range(BITS // 64)]
    if not large.isEmpty():
        # Bitmaps of classes with one lo (as good as never more than one) are left out, so that these are all verified.
        degree = table(large.groupBy("lo").agg(F.count("*").alias("degree")), "degrees")
        own = known_rows.select("id", "hi", "lo", "bits").join(classes.select("id", "hi", "lo"), ["id", "hi", "lo"], "left_semi")
        own = own.join(_small(degree.select("lo"), degree.count()), "lo", "left_semi").groupBy("lo").agg(F.count_distinct("hi").alias("n"), F.min("bits").alias("bits"))
        bits = degree.join(own, "lo").select("lo", "degree", *(F.when(F.col("n") == 1, x).alias(f"b{i}") for i, x in enumerate(longs("bits"))))
        large = table(large.join(bits, "lo").withColumn("component", F.struct(F.lit(False).alias("linked"), F.col("lo").alias("k"))), "large")
    while not large.isEmpty():
        if known is None or not found.isEmpty():
            known = components(links, scratch)
            # Of classes with one lo (as good as never more than one) any component does: all are verified.
            of_lo = known.join(classes.select("class", "lo"), known["node"] == classes["class"]).select("lo", F.struct(F.lit(True).alias("linked"), F.col("component").alias("k")).alias("now"))
            large = table(large.join(_small(of_lo, known.count()), "lo", "left").select("sig", "lo", "mark", "degree", *bit_cols, F.coalesce("now", "component").alias("component")), "at")
        left = large.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x <> y").select("sig", "m")
        left = table(left, "left")
        live = large.join(_small(left, left.count()), "sig")
        few = paired(live.where(F.col("m") <= AT_ONCE).select("sig", "lo", "mark", "m", "component"), "component")
        # Pivots: the first of each salt, then the first of these.
        many = live.where(F.col("m") > AT_ONCE)
        first = Window.partitionBy("sig", F.pmod(F.xxhash64("lo"), F.lit(SALTS))).orderBy(F.desc("degree"), "lo")
        chosen = many.withColumn("k", F.row_number().over(first)).where(F.col("k") <= pivots)
        chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("degree"), "lo"))).where(F.col("k") <= pivots)
        chosen = table(chosen.select("sig", F.col("lo").alias("pivot"), F.col("mark").alias("pivot_mark"), F.col("component").alias("own"), *(F.col(c).alias(f"p{c}") for c in bit_cols)), "pivots")
        n_chosen = chosen.count()
        differ = differing([F.col(c) for c in bit_cols], [F.col(f"p{c}") for c in bit_cols])
        near = F.coalesce(differ * (100 + percent) <= (F.shiftright("mark", 1) + F.shiftright("pivot_mark", 1)) * (100 - percent), F.lit(True))
        met = many.join(_small(chosen, n_chosen, 8), "sig").where(able("mark", "pivot_mark") & (F.col("lo") != F.col("pivot")) & (F.col("component") != F.col("own")) & near)
        met = met.select(F.least("lo", "pivot").alias("lo_a"), F.greatest("lo", "pivot").alias("lo_b"))
        found = candidates.verified(met.unionByName(pairs_of(few, "component")))
        links = links.unionByName(found)
        gone = chosen.select("sig", F.col("pivot").alias("lo"))
        large = table(many.drop("m").join(_small(gone, n_chosen), ["sig", "lo"], "left_anti"), "large")
        pivots *= 16

    if known is None or not found.isEmpty():
        known = components(links, scratch)
    by_class = classes.join(known, classes["class"] == known["node"], "left").select("hi", "lo", "id", F.coalesce("component", "class").alias("component"))
    by_class = table(by_class, "labelled")
    least_id = by_class.groupBy("component").agg(F.min("id").alias("component_id"))
    return shared_table(by_class.join(least_id, "component").select("hi", "lo", "component", "component_id"), "component-ids")


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with the smallest id, and of several such rows the one that comes first as JSON.

    Rows without an id or without words stay. Rows that share an id but not a
    text are told apart by their texts. All columns stay, of whatever type and name.
    """
    found = shared_table(near_duplicates(docs, n, percent, id_col, text_col, class_col="class").select(F.col(id_col).alias("id"), "component_id", "class"), "found")
    known = found.where("id is not null and class is not null")
    if known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        gone = shared_table(known.where("id <> component_id").select(F.col("id").alias(id_col)), "gone")
        return docs.join(_small(gone, gone.count()), id_col, "left_anti").select(*all_columns(docs))
    stay = shared_table(known.groupBy("class.component").agg(F.min(F.struct("id", "class.hi", "class.lo")).alias("x")).select("x.*"), "stay")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.struct(*all_columns(docs)).alias("row"), _classified(n)(F.col(text_col)).alias("class")).select("id", "class.hi", "class.lo", "row")
    chosen = rows.join(_small(stay, stay.count(), 2), ["id", "hi", "lo"]).groupBy("id", "hi", "lo").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return chosen.unionByName(rows.where("id is null or lo is null").select("row.*"))
