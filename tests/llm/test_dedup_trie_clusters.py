"""Substring dedup, prefix tries and clustering against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayrisk.llm import clustering, prefix_trie, substring_dedup

# --- clustering


def brute_clusters(rows, k=8, rounds=10, dim=64, seed=3):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in ok[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in ok:
            own[near(v)[1]].append(v)
        centroids = [[sum(x) // len(own[c]) for x in zip(*own[c], strict=True)] if own[c] else centroids[c] for c in range(len(centroids))]
    out = [(i, near(v)) for i, v in ok]
    total, each = sum(d for _, (d, _) in out), Counter()
    for _, (d, c) in out:
        each[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    top = clustering.LONGEST
    return sorted((i is None, i, c, min(d, top), min(each[c], top), min(total, top), sha[c]) for i, (d, c) in out)


def got_clusters(df, **how):
    found = clustering.with_inertia(clustering.kmeans(df, **how))
    return sorted((r.vec_id is None, *r) for r in found.collect())


def vectors(rng, n, dim):
    spots = rng.normal(size=(6, dim)) * 2
    return [(spots[rng.integers(6)] + rng.normal(size=dim) * rng.choice([0.0, 0.1, 1.0])).astype(np.float32).tolist() for _ in range(n)]


@pytest.mark.parametrize("dim", [2, 64])
def test_clusters_equal_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = list(enumerate(vectors(rng, 150, dim)))
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])] + [(1000 + i, rows[0][1]) for i in range(60)]
    rows += [(500, None), (501, [1.0] * (dim - 1)), (502, [math.nan] * dim), (503, [None] * dim), (504, [math.inf] * dim), (505, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, V string")
    assert got_clusters(df, dim=dim) == brute_clusters(rows, dim=dim)


def test_few_no_and_large_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [-5.0, 0.25])]
    assert got_clusters(spark.createDataFrame(rows, kind), dim=2) == brute_clusters(rows, dim=2)
    assert got_clusters(spark.createDataFrame([], kind), dim=2) == []
    big = [(i, [1e12 * math.sin(i), -1e11 * i, 3.0]) for i in range(40)]
    assert got_clusters(spark.createDataFrame(big, kind), dim=3, k=3) == brute_clusters(big, dim=3, k=3)


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    v = np.floor(1024 * np.array(vectors(rng, 500, 16))).astype(np.int64)
    pivots = clustering.chosen_pivots(v[:100], 6)
    table = np.stack([clustering.roots(clustering.squared(v, p)) for p in pivots], 1)
    at, d2, measured = clustering.nearest(v, table, v[:8], table[:8])
    every = np.stack([clustering.squared(v, c) for c in v[:8]], 1)
    assert (d2 == every.min(1)).all() and (at == every.argmin(1)).all() and measured < every.size / 2


# --- prefix trie


def brute_trie(rows, group=5, most=8):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0), int(sha[:15], 16), int(sha[15:30], 16), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % (most + 1)
        whole[c] = tuple(own.get(c - c % group, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, s in sorted(whole.items()):
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p, m: hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p], sha(p, m)) for p, m in members.items())


def got_trie(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.trie_nodes(df, **how).collect())


@pytest.mark.parametrize("block, bucket, shard", [(32, 12, 4096), (2, 1, 3), (1, 12, 7)])
def test_trie_equals_brute_force(spark, monkeypatch, block, bucket, shard):
    for name in ("TURN_BUCKET", "ID_BUCKET"):
        monkeypatch.setattr(prefix_trie, name, bucket)
    rng = random.Random(block)
    words = ["", "é", "ab", "hello there", None]
    rows = []
    for c in range(90):
        n = rng.choice([1, 2, 4, 8, 11]) if c % 7 else 0
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "bot", None]), words[rng.randrange(5)] if t else "common") for t in range(n)]
    rows += [(c, t, "user", "same") for c in range(200, 240) for t in range(9)]  # one conversation, many times
    rows += [(301, t, "bot", f"long {t % 3}") for t in range(70)] + [(304, t, "bot", f"long {t % 3}") for t in range(75)]
    rows += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 0, "user", "nobody"), (1 << 40, 0, None, None)]
    rng.shuffle(rows)
    assert got_trie(spark, rows, block=block, shard_rows=shard) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless(spark):
    assert got_trie(spark, []) == []
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    assert got_trie(spark, [(c, 0, "user", "gone")]) == brute_trie([(c, 0, "user", "gone")]) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_double_array_finds_its_paths_and_no_others():
    rng = np.random.default_rng(0)
    paths = rng.integers(0, 40, (300, 5))
    for i in range(300):
        paths[i, rng.integers(1, 6) :] = -1
    trie = prefix_trie.DoubleArray(paths)
    known, seen = set(), {}
    for path in paths.tolist():
        known |= {tuple(path[: d + 1]) for d in range(5) if path[d] >= 0}
    for path in known:
        at = np.zeros(1, np.int64)
        for x in path:
            at = trie.child(at, np.array([x]))
        assert at[0] > 0 and seen.setdefault(int(at[0]), path) == path
    for path in {(*p[:-1], x) for p in known for x in range(40)} - known:
        at = np.zeros(1, np.int64)
        for x in path:
            at = trie.child(at, np.array([x]))
        assert at[0] == -1


# --- substring dedup


def brute_repeats(rows, span):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[p : p + span]) for _, w in words for p in range(len(w) - span + 1))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - span + 1):
            if seen[tuple(w[p : p + span])] > 1:
                gone |= set(range(p, p + span))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i is None, i or 0, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


def got_repeats(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, K int")
    found = substring_dedup.without_repeats(df, **how).collect()
    for r in found:
        assert sum(x.length for x in r.spans) == r.n_removed
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in found)


def test_words_are_hashed_alike_in_any_slices(monkeypatch):
    texts = [b"ab  c", b"", b" \t\n", b"c", "é ab\x0bab".encode(), b"x" * 90]
    whole, counts = substring_dedup.word_hashes(texts)
    assert counts.tolist() == [2, 0, 0, 1, 3, 1]
    assert whole[0] == whole[4] == whole[5] and whole[1] == whole[2] and len(set(whole.tolist())) == 4
    for at_once in (1, 3, 8):
        monkeypatch.setattr(substring_dedup, "AT_ONCE", at_once)
        again, n = substring_dedup.word_hashes(texts)
        assert (again == whole).all() and (n == counts).all()


@pytest.mark.parametrize("span, anchor", [(6, 3), (6, 6), (5, 1), (35, 12)])
def test_repeats_equal_brute_force(spark, span, anchor):
    rng = random.Random(span)
    word = lambda n: [f"w{rng.randrange(n)}" for _ in range(rng.choice([0, 3, span, 4 * span]))]
    passages = [[f"p{k}{rng.randrange(9)}" for _ in range(rng.choice([span - 1, span, span + 1, 3 * span]))] for k in range(6)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += word(500) + (passages[rng.randrange(6)] if rng.random() < 0.5 else [])
        if parts and rng.random() < 0.2:
            parts[rng.randrange(len(parts))] = "edit"
        rows.append((i, rng.choice([" ", "\n", "\t \x0b", "  "]).join(parts)))
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, "a " * 5 * span), (2001, "a b " * 2 * span), (2002, None), (2003, ""), (2004, " \n"), (2005, "é ü " * span)]
    rows += [(2006, rows[7][1]), (2006, rows[7][1]), (2006, "other text"), (None, rows[9][1]), (None, rows[9][1])]
    rows += [(3000 + i, " ".join([f"l{i}"] + passages[0] + [f"r{i}"])) for i in range(30)]  # one passage between unlike words
    assert got_repeats(spark, rows, span=span, anchor=anchor) == brute_repeats(rows, span)


def test_repeats_of_nothing_and_of_a_long_text(spark):
    assert got_repeats(spark, []) == []
    rng = random.Random(3)
    long = " ".join(f"v{rng.randrange(100000)}" for _ in range(60000))
    rows = [(1, long), (2, " ".join(long.split()[30000:30100]) + " tail"), (3, "x" * 300000)]
    assert got_repeats(spark, rows) == brute_repeats(rows, 35)


def test_window_hash_of_many_common_words(spark):
    rows = [(i, " ".join(f"{'a' if (i >> (p % 7)) & 1 else 'b'}" for p in range(60))) for i in range(130)]
    got = got_repeats(spark, rows, span=20, anchor=4)
    assert got == brute_repeats(rows, 20)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert "text" not in substring_dedup.without_repeats(df, span=20, anchor=4, texts=False).columns
    assert substring_dedup.without_repeats(df, texts=False).agg(F.count("*")).first()[0] == 130
