"""The registered queries of this subpackage against their contracts, and the pipeline stage by stage."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wayrisk.llm import quality
from wayrisk.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(tables):
    return dict(tables.execute("SELECT doc_id, text FROM documents").fetchall())


def result(spark, name):
    return QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal_to_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    c = tables.execute(ORACLE_SQL[name])
    names = [d[0] for d in c.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, c.fetchall()))


def tokens(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_op1(spark, texts):
    ids = tokens("word_bpe_49k.json")
    rows = result(spark, "op1_token_counts")
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == {i: (len((t or "").encode()), n := len(ids(t)), n > 2048) for i, t in texts.items()} and len(rows) == len(texts)


def words(text):
    return len((text or "").encode().split())


def test_op4(spark, tables):
    docs = {i: (s, words(t)) for i, s, t in tables.execute("SELECT doc_id, source, text FROM documents").fetchall()}
    rows = result(spark, "op4_mixing")
    assert len(rows) == len(docs)
    total, taken, target = Counter(), Counter(), {}
    for s, n in docs.values():
        total[s] += n
    for r in rows:
        s, n = docs[r.doc_id]
        assert r.size == n and r.source_size == total[s] and r.taken in (0, n, 2 * n, 3 * n)
        taken[s] += r.taken
        target[s] = r.target
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight, want, open_ = {s: [5, 2, 1][i % 3] for i, s in enumerate(names)}, {}, set(names)
    while open_:  # fill up to three times a source's size, the excess to the others
        left = sum(total.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * total[s]}
        want |= {s: 3.0 * total[s] for s in full} if full else share
        open_ = open_ - full if full else set()
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= max(n for x, n in docs.values() if x == s)


def test_op6(spark, texts):
    rows = result(spark, "op6_media_jpeg")
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    of_text = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        pad = max(192, -(-len(data) // 192) * 192)
        payload = data.ljust(pad, b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), pad, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_bytes > 0 and re.fullmatch("[0-9a-f]{64}", r.media_sha256) and r.feature
        assert of_text.setdefault(data, tuple(r)[1:]) == tuple(r)[1:]


def test_op7(spark, texts):
    rows = result(spark, "op7_sharding")
    size, slots, shard_of = Counter(), defaultdict(set), defaultdict(set)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None) and 0 <= r.shard < 8
        size[r.shard] += r.size
        assert r.slot not in slots[r.shard]
        slots[r.shard].add(r.slot)
        shard_of[data].add(r.shard)
    assert all(x == set(range(len(x))) for x in slots.values()) and sum(map(len, slots.values())) == len(texts)
    assert max(size.values()) - min(size.values()) <= 2 * max(r.size for r in rows) and max(map(len, shard_of.values())) == 1


def test_op8(spark, texts):
    rows = result(spark, "op8_quality")
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op9(spark, tables):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    urls = dict(tables.execute("SELECT page_id, url FROM pages").fetchall())
    rows = result(spark, "op9_url_filter")
    assert len(rows) == len(urls)
    for r in rows:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "", re.S)
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path) and r.verdict in ("allow", "block")
        if fits:
            assert (r.verdict, r.rule) == max(fits)[1:]
        else:
            assert r.rule is None


def packed_right(rows, texts):
    """texts: id to text of the packed documents, each of them once or more."""
    ids, pieces, sequences = tokens("byte_bpe_50k.json"), defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc, own in pieces.items():
        whole = [*ids(texts[doc]), 0]
        copies = sum(r.piece == 0 for r in own)
        assert sum(r.length for r in own) == copies * len(whole)
        for r in own:
            part = whole[r.start : r.start + r.length]
            assert len(part) == r.length and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            assert r.length == 2048 or r.piece == 0
            assert len(whole) > 2048 or r.length == len(whole)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.1 * math.ceil(sum(r.length for r in rows) / 2048) + 1


def test_op10(spark, texts):
    rows = result(spark, "op10_packing")
    assert {r.doc_id for r in rows} == set(texts)
    packed_right(rows, texts)


def test_pipeline_decides_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).checkpoint()
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in after.select("doc_id").collect()} <= ids, name
        if name == "quality classifier":
            model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= corpus_pipeline.LEAST_QUALITY}
            assert {r.doc_id for r in after.collect()} == good and len(good) < len(ids)
        if name == "line dedup":
            assert after.count() == before.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert after.schema == before.schema
            before = after
    texts = {r.doc_id: r.text for r in before.collect()}
    packed_right(after.collect(), texts)
    rows = sorted(map(repr, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect()))
    assert rows == sorted(map(repr, after.drop("sequence_id", "offset").collect()))


def test_stages_keep_columns_of_any_name_and_type(spark):
    """Names that stages use themselves, blanks, dots and maps; repeated and null ids, null sources and texts."""
    rng = [f"This is sentence number {i} about topic {i % 7}, which says what others do not say {i * i}." for i in range(60)]
    rows = [(i, rng[i] if i % 9 else None, "en", ["a", "b", None][i % 3], 7) for i in range(60)]
    rows += [(3, rng[4], "en", "a", 7), (3, rng[5] + " more", "en", "b", 7), (None, rng[6], "en", None, 7), (None, rng[6], "en", "a", 7), (5, rng[5], "en", "c", 7), (5, rng[5], "en", "c", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {"n_dropped": F.lit("kept"), "N_LINES": F.col("doc_id") * 2, "score": F.lit(0.25), "a b": F.lit(1), "c.d": F.lit(2), "map": F.create_map(F.lit("k"), F.col("doc_id")), "id": F.lit("x"), "row": F.lit("y"), "copies": F.lit(9), "class": F.lit("z")}
    docs = docs.withColumns(extra).checkpoint()
    quoted = [F.col(f"`{c}`") for c in docs.columns]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).checkpoint()
        assert after.columns == docs.columns, name
        assert [f.dataType for f in after.schema] == [f.dataType for f in docs.schema], name
        for r in after.select(*quoted).collect():
            assert (r["n_dropped"], r["score"], r["a b"], r["c.d"], r["id"], r["row"], r["copies"], r["class"]) == ("kept", 0.25, 1, 2, "x", "y", 9, "z"), name
            assert r["N_LINES"] == (None if r["doc_id"] is None else 2 * r["doc_id"]) and r["map"] == {"k": r["doc_id"]}, name
        if name == "line dedup":
            assert after.count() == docs.count()
        if name == "n-gram Jaccard join":
            kept = after.select("doc_id", "text").collect()
            assert Counter(r.text for r in kept if r.doc_id == 5)[rng[5]] <= 1 and sum(r.doc_id is None for r in kept) == 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count()


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        assert after.count() == 0, name
