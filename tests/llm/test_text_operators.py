"""Token counts, packing, near duplicates, line dedup, quality and the pipeline against brute force."""

import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wayrisk.llm import jaccard_join, line_dedup, mixing, packing, quality, token_counts
from wayrisk.llm.shared import Scratch

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n", "a  b", "  a b ", "a\n b", "it's 've 'LL 12345 don't", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "\x1cab\u2003b\u3000", "ΣΑΣ ΣΣ", "İx ſ", "é a" + "e\u0301", "\u00a0a \u00ad b",
    "中文 字 кириллица", "🙂 ok👍🏽", "x" * 5000, "ab " * 3000, "!!!??? ... ---", "\t\ttabs\r\nnew", "naïve café — “quoted” €5",
]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None, first=0):
    rows = [(first + i, t, "en", (sources[i] if sources else "s"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_proved_tokens_are_single_and_cover_most_words():
    whole = token_counts.prove_whole_tokens(WORDS)
    tok = Tokenizer.from_file(WORDS)
    some = sorted(whole)[::997]
    assert len(whole) > 30_000 and all(len(tok.encode(w).ids) == 1 for w in some)


def test_token_counts_equal_the_library(spark):
    tok = Tokenizer.from_file(WORDS)
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, ODD).withColumnRenamed("lang", "n_tokens"), WORDS, limit=5).collect()}
    for i, t in enumerate(ODD):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 5), t
    assert token_counts.token_counts(docs(spark, ODD).limit(0), WORDS).count() == 0


def test_packed_pieces_are_the_documents(spark):
    tok = Tokenizer.from_file(BYTES)
    texts = ODD * 2
    rows = packing.pack(docs(spark, texts), BYTES, 64).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 64
    total = 0
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 64 or k == 0)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    assert len(bins) <= 1.1 * total / 64 + 1
    assert packing.pack(docs(spark, []), BYTES, 64).count() == 0


def test_large_items_pair_and_small_ones_fill():
    placed = packing.place({600: 3, 400: 2, 390: 1, 10: 4, 100: 1}, 1000)
    use = defaultdict(int)
    for length, _, n, first, _ in placed:
        for s in range(first, first + n):
            use[s] += length
    assert sum(n for length, _, n, _, _ in placed if length == 10) == 4 and max(use.values()) <= 1000 and len(use) == 4


def brute(texts, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def near_copies(seed, groups=6, copies=14, words=120):
    """Groups of altered copies around an original, a shared passage, short texts and exact copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, out = [word() for _ in range(60)], [None, "", "  ", "a", "A", "a b", "a  b", "one two three four five", "one two three four five six", "one two three four five six seven"]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([6, 12, 26, 40, words, 4 * words]))]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    for _ in range(40):
        out.append(" ".join([word() for _ in range(rng.randrange(5, 80))] + passage))
    return out + out[:30]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_duplicates_equal_brute_force(spark, seed, monkeypatch):
    if seed != 1:  # make tokens frequent early, so that pairs of tokens are indexed
        monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
        monkeypatch.setattr(jaccard_join, "CHUNK_LEAST", 2)
    if seed == 3:  # and let pivots do nearly all the work
        monkeypatch.setattr(jaccard_join, "AT_ONCE", 2)
        monkeypatch.setattr(jaccard_join, "COPIED", 2)
    texts = near_copies(seed)
    sizes, want = brute(texts)
    got = {r.doc_id: r for r in jaccard_join.near_duplicates(docs(spark, texts).withColumnRenamed("lang", "class")).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component_id for i in range(len(texts))] == want


def test_near_duplicates_of_nothing_and_of_null_ids(spark):
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in jaccard_join.near_duplicates(df).collect()) == [(0, None), (3, 3), (3, 3)]


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        pool = np.unique(rng.integers(0, 2**63, 2 * n, dtype=np.uint64))
        a = np.sort(rng.choice(pool, n, replace=False))
        drop = int(rng.integers(0, n // 5 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[: n - drop], rng.integers(0, 2**63, int(rng.integers(0, 2 + n // 9)), dtype=np.uint64)]))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        often = np.sort(rng.choice(pool, len(pool) * int(rng.integers(0, 4)) // 4, replace=False))
        if 100 * both >= 80 * either:
            (p, early_p), (q, early_q) = (jaccard_join.signatures(x, often, 80) for x in (a, b))
            # The smaller set's entry must be one of its shorter prefix.
            p, q = p if len(a) >= len(b) else p[early_p], q if len(b) > len(a) else q[early_q]
            assert len(np.intersect1d(p, q))


def test_pages_that_share_most_of_their_text_without_linking_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    asked = []
    verified = jaccard_join._Candidates.verified
    monkeypatch.setattr(jaccard_join._Candidates, "verified", lambda self, pairs: (asked.append(pairs.distinct().count()), verified(self, pairs))[1])
    # 82 % of each page's shingles are the same, which makes a similarity of 0.7.
    common = " ".join(f"c{i}" for i in range(250))
    texts = [common + "".join(f" p{k}x{i}" for i in range(54)) for k in range(2000)]
    got = jaccard_join.near_duplicates(docs(spark, texts)).collect()
    assert all(r.component_id == r.doc_id for r in got) and sum(asked) < 2000


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b, c = ("one two three four five six seven", "other words that are here in this text", "third text of quite some other words")
    rows = [(1, a), (1, b), (2, a), (2, c), (3, c), (3, c), (4, None), (4, ""), (None, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("kept")).withColumn("id", F.lit(7))
    got = jaccard_join.without_near_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, a), (0, a), (1, a), (1, b), (2, c), (4, ""), (4, "")]


def test_line_dedup_keeps_rows_and_other_columns(spark):
    texts = [f"menu\nown {i}\n\n menu " for i in range(30)] + ["menu", None, "", "alone"]
    sources = ["a"] * 30 + ["a", "a", None, None]
    df = docs(spark, texts, sources).withColumnRenamed("lang", "_host")
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[0].text == "own 0\n" and (got[0].n_lines, got[0].n_dropped) == (4, 2)
    assert got[30].text == "" and got[31].text is None and got[31].n_lines == 0 and got[32].text == "" and got[33].text == "alone"
    assert got[5]["_host"] == "en" and len(got) == 34
    assert line_dedup.drop_boilerplate(docs(spark, [])).count() == 0


def test_quality_of_held_out_rows(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["river", "road", "train", "moves", "cargo", "slowly", "the", "of"]) + rng.choice(["", "", "."]) for _ in range(60)) for _ in range(150)]
    bad = [" ".join(rng.choice(["BUY", "NOW", "$$$", "click!!"]) for _ in range(40)) for _ in range(150)]
    df = docs(spark, good + bad + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, labels, sample=200, dims=8)
    assert quality.score(df.limit(0), model).count() == 0
    one = next(i for i in range(300) if zlib.crc32(str(i).encode()) % 5)
    same_id = docs(spark, good).withColumn("doc_id", F.lit(one).cast("long"))
    assert len(quality.fit(same_id, labels.where(F.col("doc_id") == one), sample=20, dims=8).labels) == 20
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    test = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(model.labels) <= 200 and all((got[i] >= 0.3) == (i < 150) for i in test) and got[300] == got[301] == 0
    none = quality.score(df, quality.fit(df, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.0, 0.5}


def test_scores_are_the_exact_vote():
    rng = np.random.default_rng(1)
    rows, labels = rng.integers(0, 5, (40, quality.GRAMS + quality.SHAPES)).astype(np.float32), rng.integers(0, 2, 40)
    m = quality.Model(rows, labels, 12, 0.5, 7, 20.0)
    v = m.latent(rows)
    for i in (0, 9, 33):
        near = sorted(((float(v[i] @ v[j]), labels[j]) for j in range(40)), reverse=True)[:7]
        w = [np.exp(20 * (c - 1)) for c, _ in near]
        assert m.score(rows[i : i + 1])[0] == pytest.approx(sum(a * b for a, (_, b) in zip(w, near, strict=True)) / sum(w), rel=1e-3)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet")
    df, seen = given, []
    for name, stage in p.STAGES[:-1]:
        df = stage(spark, df, sf)
        df.write.parquet(str(tmp_path / name.replace(" ", "_")))
        df = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert df.columns == given.columns
        seen.append({r.doc_id: r for r in df.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = [labels[i] for i in labels if i in seen[0]]
    assert sum(kept) == sum(labels.values()) and kept.count(0) <= 2
    assert seen[1].keys() == seen[0].keys()
    order = sorted(seen[1])
    _, comp = brute([seen[1][i].text for i in order])
    assert seen[2].keys() == {order[c] for c in comp}
    assert seen[3].keys() <= seen[2].keys()
    packed = p.STAGES[-1][1](spark, df, sf)
    ids = [tuple(r) for r in packed.select("sequence_id", "offset").collect()]
    assert len(ids) == len(set(ids)) and packed.where("piece = 0").count() == df.count()
    assert mixing.n_words is not None


def test_a_token_spread_thinly_is_frequent(spark):
    """A passage on one document in each chunk, never twice in one, is in the frequent class; tokens of one document aren't."""
    own = lambda i: " ".join(f"u{i}_{k}" for k in range(60))
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(i, own(i) + (" " + passage if i % 22 == 0 else "")) for i in range(3300)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    sets = docs.mapInArrow(jaccard_join._sets(5, chunk_tokens=1200), "id long, size int, hi long, lo long, bits array<long>, wide array<long>, tokens array<long>, counts array<long>").checkpoint()
    assert sets.where("size(tokens) > 0").count() > 50
    with Scratch(spark) as scratch:
        frequent = set(jaccard_join._frequent(sets, scratch).tolist())
    hashes = jaccard_join.WordHashes()
    common = set(jaccard_join.shingles(passage, 5, hashes).tolist())
    assert len(common & frequent) >= 0.9 * len(common) and len(frequent - common) < 20
