"""Top-k search, mixing, media, sharding and URL filters against brute force."""

import hashlib
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayrisk.llm import media_jpeg, mixing, sharding, topk_search, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("block", [5, 1024])
def test_topk_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk_search, "BLOCK", block)
    rng = np.random.default_rng(block)
    base = rng.normal(size=(60, 6)).astype(np.float32)
    vectors = [base[rng.integers(60)].tolist() if rng.random() < 0.5 else rng.normal(size=6).astype(np.float32).tolist() for _ in range(140)]
    rows = [(i, v, 0) for i, v in enumerate(vectors)] + [(i, vectors[0], 0) for i in range(200, 240)] + [(300, None, 0), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (400, [math.nan] * 6, 0), (500, [math.inf] * 6, 0), (600, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumnRenamed("label", "class")
    got = [tuple(r) for r in topk_search.topk(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    ok = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in sorted(i for i in ok if i % 20 == 0):
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want


def test_topk_with_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 2.0]), (7, [0.5, -1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r)[:3] for r in topk_search.topk(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7)]
    assert topk_search.topk(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_of_large_components_and_empty_vectors(spark):
    rng = np.random.default_rng(4)
    scale = lambda i: 10.0 ** (i % 5 * 4)
    vectors = [[float(x) for x in rng.normal(size=3) * scale(i)] for i in range(60)] + [[1e300, -1e300, 1.0], [1e17, 1e17, 1e17], [1e17, 1e17, 1e17 + 64]]
    rows = list(enumerate(vectors)) + [(200, []), (300, []), (301, [])]
    got = {}
    for r in topk_search.topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.pop(200) == [(300, 0), (301, 0)] and got.pop(300) == [(200, 0), (301, 0)]
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in enumerate(vectors)}
    for q, best in got.items():
        if q == 60:  # past 38 digits
            continue
        dots = {i: sum(a * b for a, b in zip(ints[q], v, strict=True)) for i, v in ints.items() if i not in (q, 60)}
        want = [(i, min(max(s, -(2**63)), 2**63 - 1)) for s, i in sorted(((s, i) for i, s in dots.items()), key=lambda x: (-x[0], x[1]))]
        assert [x for x in best if x[0] != 60][:9] == want[:9]


def test_targets_fill_up_to_three_times(spark):
    t = mixing.targets({"a": 10, "b": 1000, "c": 1000, None: 90}, [5, 2, 1])
    assert t["a"] == 30 and t[None] == pytest.approx(270) and sum(t.values()) == pytest.approx(2100)
    assert t["b"] == pytest.approx(2 * t["c"])
    assert mixing.targets({}, [1]) == {} and mixing.targets({"a": 0}, [1]) == {"a": 0}


def test_flow_meets_quotas_at_least_cost():
    flow = mixing.min_cost_flow({("a",): 10, ("b",): 10, ("a", "b"): 10}, {"a": 25, "b": 5}, 3)
    assert sum(f.get("a", 0) for f in flow.values()) == 25 and sum(f.get("b", 0) for f in flow.values()) == 5
    used = {p: sum(f.values()) for p, f in flow.items()}
    # 20 words at no cost from the patterns with a, 5 for b from its own, 5 repeats.
    assert used[("b",)] == 5 and used[("a",)] + used[("a", "b")] == 25 and max(used.values()) <= 20


def test_mix_takes_what_targets_say(spark):
    rows = [(i, "w " * (1 + i % 7), "en", ["x", "y", "z", None][i % 4] if i % 11 else "x", 0) for i in range(400)] + [(900, None, "en", "x", 0), (901, "", "en", "q", 0)]
    df = spark.createDataFrame(rows, DOCS)
    sizes = {}

    def quotas(found):
        sizes.update(found)
        return mixing.targets(found, [5, 2, 1])

    out = mixing.mix(df, F.array("source"), mixing.n_words(F.col("text")), quotas)
    got = sorted((r.id, r.size, len(r.copies), tuple(r.copies)) for r in out.collect())
    assert got == sorted((r.id, r.size, len(r.copies), tuple(r.copies)) for r in mixing.mix(df.repartition(7), F.array("source"), mixing.n_words(F.col("text")), quotas).collect())
    want, taken = mixing.targets(sizes, [5, 2, 1]), {}
    for _, size, n, copies in got:
        assert n <= 3
        for s in copies:
            taken[s] = taken.get(s, 0) + size
    assert all(abs(taken.get(s, 0) - want[s]) <= 7 for s in want)
    both = mixing.mix(df, F.when(F.col("doc_id") % 2 == 0, F.array("source", F.lit("all"))).otherwise(F.array(F.lit("all"))), mixing.n_words(F.col("text")), lambda s: {k: v / 2 for k, v in s.items()})
    total = {}
    for r in both.collect():
        for s in r.copies:
            total[s] = total.get(s, 0) + r.size
    assert all(abs(total[s] - sizes_half) <= 20 for s, sizes_half in (("all", 400 * 4 / 2 - 2),) if s in total)
    assert mixing.mix(df.limit(0), F.array("source"), mixing.n_words(F.col("text")), quotas).count() == 0
    odd = spark.createDataFrame([(None, "a b", ["x"]), (None, "a b", ["x"]), (1, "a b c", None), (2, "a", [None, "x"])], "doc_id long, text string, sources array<string>")
    got = [(r.id, len(r.copies)) for r in mixing.mix(odd, F.col("sources"), mixing.n_words(F.col("text")), lambda s: dict(s)).collect()]
    assert sorted(got, key=str) == [(1, 0), (2, 2), (None, 1), (None, 1)]


def brute_cost(patterns, quotas, repeats):
    """Least repetition cost and most words given, by trying the words one by one (successive cheapest paths over unit words)."""
    units = [(k, p) for p, n in patterns.items() for k in range(repeats) for _ in range(n)]
    free = [s for s, q in quotas.items() for _ in range(q)]
    match = {}

    def augment(u, seen):
        for j, s in enumerate(free):
            if s in units[u][1] and j not in seen:
                seen.add(j)
                if j not in match or augment(match[j], seen):
                    match[j] = u
                    return True
        return False

    # Matching cheaper units first is the matroid's greedy, so it is optimal.
    cost = sum(units[u][0] for u in sorted(range(len(units)), key=lambda u: units[u][0]) if augment(u, set()))
    return len(match), cost


def test_flow_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        names = ["a", "b", "c", None][: rng.randrange(1, 5)]
        patterns = {tuple(sorted(rng.sample(names, rng.randrange(1, len(names) + 1)), key=str)): rng.randrange(0, 5) for _ in range(4)}
        quotas = {s: rng.randrange(0, 12) for s in names}
        flow = mixing.min_cost_flow(patterns, quotas, 3)
        given = {p: sum(f.values()) for p, f in flow.items()}
        assert all(given[p] <= 3 * n for p, n in patterns.items())
        assert all(sum(f.get(s, 0) for f in flow.values()) <= quotas[s] for s in names)
        cost = sum(k * min(n, max(0, given[p] - k * n)) for p, n in patterns.items() for k in range(3))
        assert (sum(given.values()), cost) == brute_cost(patterns, quotas, 3)


def test_flow_of_many_patterns_ends_in_seconds():
    rng = random.Random(4)
    names = [f"s{i:03}" for i in range(400)]
    patterns = {tuple(sorted(rng.sample(names, rng.randrange(1, 6)))): rng.randrange(1, 1000) for _ in range(20_000)}
    total, began = sum(patterns.values()), time.time()
    flow = mixing.min_cost_flow(patterns, {s: total * rng.choice([1, 2, 5]) // 1000 for s in names}, 3)
    assert sum(sum(f.values()) for f in flow.values()) > 0.9 * total * 0.8 and time.time() - began < 60


def test_zigzag_begins_as_the_standard_says():
    assert media_jpeg.zigzag()[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and media_jpeg.zigzag()[-1] == 63


@pytest.mark.parametrize("n", [1, 192, 378, 379, 3000])
def test_media_round_trip_by_both_readers(n, monkeypatch):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    media = media_jpeg.encode(data)
    fast, rgb = media_jpeg.read_back(media)
    monkeypatch.setattr(media_jpeg.Picture, "_scan_of_one_length", lambda *_: False)
    slow, same = media_jpeg.read_back(media)
    assert fast == slow == data and (rgb == same).all() and rgb.shape[2] == 3


def test_flat_picture_and_runs_of_zeros():
    """A grey 4:2:0 picture by hand: DC differences, end-of-band runs, restarts of nothing."""
    j = media_jpeg
    frame = j.struct.pack(">BHHB", 8, 16, 16, 3) + bytes((1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0))
    dc = j._segment(j.DHT, bytes((0, 0, 2, *[0] * 14, 0, 5)))  # codes 00: size 0, 01: size 5
    ac = j._segment(j.DHT, bytes((0x10, 0, 1, *[0] * 14, 0x20)))  # code 00: run of 4 to 7 ended bands
    first = "01" + "10000" + "00" * 3 + "00" + "00"  # luma 16 (then no change), chroma 0
    bits = lambda s: int(s + "1" * (-len(s) % 8), 2).to_bytes(-(-len(s) // 8), "big")
    data = bytes((0xFF, j.SOI)) + j._segment(j.DQT, bytes((0, *[8] * 64))) + j._segment(j.SOF2, frame) + dc + ac + j._scan([1, 2, 3], 0, 0, 0, 0, bits(first)) + j._scan([1], 1, 63, 0, 0, bits("00" + "00")) + bytes((0xFF, j.EOI))
    assert (j.decode(data) == 128 + 16 * 8 // 8).all()


def test_media_rows(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "z" * 20000]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    stored = media_jpeg.store_media(df)
    got = {r.doc_id: r for r in media_jpeg.read_media(stored, tensors=False).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        data += b" " * (-len(data) % 192 if data else 192)
        assert (got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert got[0].feature == got[1].feature and got[0].media_sha256 == got[1].media_sha256
    t = media_jpeg.read_media(stored).where("doc_id = 2").first()
    assert len(t.rgb) == t.height * t.width * 3
    assert media_jpeg.read_media(media_jpeg.store_media(df.limit(0))).count() == 0


def test_shards_are_balanced_and_slots_gapless(spark):
    texts = [None, ""] + ["copy of one text"] * 300 + [f"text {i} " * (i % 40) for i in range(700)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).withColumnRenamed("lang", "cell")
    rows = sharding.shard(df).collect()
    load, slots = [0] * 8, [[] for _ in range(8)]
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(load) - min(load) <= 0.02 * sum(load) / 8 + 2 * 400 and all(sorted(s) == list(range(len(s))) for s in slots)
    assert sharding.shard(df.limit(0)).count() == 0


def test_equal_texts_share_a_shard_while_one_has_room(spark):
    texts = [f"group {i % 40} " * 9 for i in range(4000)] + [f"single text {i}" for i in range(9000)] + ["hot " * 20] * 6000
    rows = sharding.shard(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    shards, load, slots = {}, [0] * 8, [[] for _ in range(8)]
    for r in rows:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert [t[:4] for t, s in shards.items() if len(s) > 1] == ["hot "]
    assert len(rows) == len(texts) and max(load) <= 1.003 * sum(load) / 8 and all(sorted(s) == list(range(len(s))) for s in slots)


def test_bounded_walk_moves_little():
    rng = np.random.default_rng(3)
    chunks = [((i * 4, -1), int(b), [(-1, int(b), 1)]) for i, b in enumerate(rng.integers(50, 150, 4096))]
    a = {c[0]: c[3] for c in sharding.walk(chunks, 8, 128, 7, 1.05)}
    b = {c[0]: c[3] for c in sharding.walk(chunks, 9, 128, 7, 1.05)}
    assert sum(a[k] != b[k] for k in a) < 0.5 * len(a)


def test_rules_and_hosts(spark):
    urls = [
        ("http://A.Example.org/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("x://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://org", "org", "", None, "allow"), ("http://c.com/fr/", "c.com", "/fr/", "com/fr/", "allow"), ("http://d.com/de/1", "d.com", "/de/1", "com/de/", "block"),
        ("http://d.com/x", "d.com", "/x", None, "block"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://h.net?x://y/z", "h.net", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], None if i % 2 else "<p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert [got[i] for i in range(len(urls))] == [u[1:] for u in urls]
    assert url_filter.judge(df.limit(0)).count() == 0


def test_distrust_spreads_to_those_who_link(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/p">x</a> <a HREF=//{h}/q>y</a> <a href="/own">z</a>' for h in hosts)
    pages = [(1, "http://bad.com/de/", ""), (2, "http://good.org/", link("fine.net")), (3, "http://shady.net/", link("bad.com")), (4, "http://far.net/", link("shady.net", "fine.net")), (5, "http://fine.net/", link("good.org")), (6, "http://lone.net/", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: r for r in url_filter.judge(df, rounds=8).collect()}
    assert {h: r.verdict for h, r in got.items()} == {"bad.com": "block", "good.org": "allow", "shady.net": "block", "far.net": "block", "fine.net": "allow", "lone.net": "allow"}
    trust = {"good.org": 1.0}
    edges = {("good.org", "fine.net"): 1.0, ("shady.net", "bad.com"): 1.0, ("far.net", "shady.net"): 0.5, ("far.net", "fine.net"): 0.5, ("fine.net", "good.org"): 1.0}
    rank = dict(trust)
    for _ in range(8):
        new = {h: 0.15 * m for h, m in trust.items()}
        for (a, b), w in edges.items():
            new[b] = new.get(b, 0) + 0.85 * rank.get(a, 0) * w
        rank = new
    assert got["fine.net"].trust == pytest.approx(rank["fine.net"]) and got["good.org"].trust == pytest.approx(rank["good.org"])


def test_ranks_converge_over_long_chains(spark):
    link = lambda h: f'<a href="http://{h}/p">x</a>'
    n = 101  # hosts in the chain, the last one is blocked
    chain = [(i, f"http://h{i}.net/", link(f"h{i + 1}.net" if i + 1 < n else "bad.com")) for i in range(n)]
    loop = [(n, "http://good.org/", link("a.net")), (n + 1, "http://a.net/", link("b.net")), (n + 2, "http://b.net/", link("good.org")), (n + 3, "http://bad.com/de/", "")]
    got = {r.host: r for r in url_filter.judge(spark.createDataFrame(chain + loop, "page_id long, url string, html string")).collect()}
    assert all(got[f"h{i}.net"].verdict == "block" for i in range(n))
    assert all(got[f"h{i}.net"].distrust == pytest.approx(0.15 * 0.85 ** (n - i), rel=1e-5, abs=0) for i in range(n))
    ring = 0.15 / (1 - 0.85**3)  # good.org -> a.net -> b.net -> good.org, solved
    assert [got[h].trust for h in ("good.org", "a.net", "b.net")] == pytest.approx([ring, 0.85 * ring, 0.85**2 * ring], rel=1e-5)
