"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayrisk.llm import clustering, jaccard_join, line_dedup, media_jpeg, mixing, packing, prefix_trie, quality, sharding, substring_dedup, token_counts, topk_search, url_filter

SOURCE_WEIGHTS = [5.0, 2.0, 1.0]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk_search.topk(vectors, F.col("vec_id") % 100 == 0, k=10)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_documents(spark, sf_dir), n=5, percent=80)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    wanted: dict = {}
    sizes: dict = {}

    def quotas(found: dict) -> dict:
        sizes.update(found)
        wanted.update(mixing.targets(found, SOURCE_WEIGHTS))
        return wanted

    mixed = mixing.mix(docs, F.array("source"), mixing.n_words(F.col("text")), quotas)
    rows = [(s is None, s or "", sizes[s], float(wanted[s])) for s in wanted]
    table = spark.createDataFrame(rows, "none boolean, name string, source_size long, target double")
    own = mixed.select(F.col("id").alias("doc_id"), "size", F.col("pattern")[0]["none"].alias("none"), F.col("pattern")[0]["name"].alias("name"), (F.size("copies") * F.col("size")).alias("taken"))
    # One row for each membership pattern's source, which mix() has bounded.
    return own.join(F.broadcast(table), ["none", "name"]).select("doc_id", "size", "source_size", "target", "taken")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(_documents(spark, sf_dir)).select("doc_id", "source", "n_lines", "n_dropped", "text")


def op6_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media_jpeg.store_media(_documents(spark, sf_dir))
    return media_jpeg.read_media(stored, tensors=False).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(_documents(spark, sf_dir), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), 2048)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(_documents(spark, sf_dir), span=35, texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return clustering.with_inertia(clustering.kmeans(vectors, k=8, rounds=10, dim=64, scale=1024, seed=3))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_topk_search, op3_jaccard_join, op4_mixing, op5_line_dedup, op6_media_jpeg, op7_sharding, op8_quality, op9_url_filter, op10_packing, op11_substring_dedup, op12_prefix_trie, op13_clustering, pipeline)}


def _clustering_sql(k: int = 8, rounds: int = 10) -> str:
    """The rounds written out one after the other."""
    best = """a{0} AS MATERIALIZED (
        SELECT row, v, c, d FROM (
            SELECT row, v, c, d, row_number() OVER (PARTITION BY row ORDER BY d, c) AS n FROM (
                SELECT w.row, w.v, c.c, list_sum(list_transform(list_zip(w.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM w CROSS JOIN c{0} c
            )
        ) WHERE n = 1
    )"""
    move = """c{1} AS MATERIALIZED (
        SELECT c{0}.c, coalesce(m.v, c{0}.v) AS v FROM c{0} LEFT JOIN (
            SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
                SELECT c, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{0}) GROUP BY c, i
            ) GROUP BY c
        ) m ON c{0}.c = m.c
    )"""
    steps = [x for i in range(rounds) for x in (best.format(i), move.format(i, i + 1))] + [best.format(rounds)]
    return f"""
        WITH w AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), e) - 1 AS row, vec_id, e AS v FROM (
                SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
                WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            )
        ), c0 AS MATERIALIZED (SELECT row AS c, v FROM w WHERE row < {k}), {", ".join(steps)}
        SELECT w.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
            sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN w ON a.row = w.row JOIN c{rounds} c ON a.c = c.c
    """


ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op3_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w WHERE len(w) > 0
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)
        ), e AS (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), r AS (
            SELECT doc_id AS k, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.k = e.a
        )
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN r ON r.k = d.doc_id GROUP BY 1, 2
    """,
    "op5_line_dedup": """
        WITH l AS (
            SELECT source, doc_id, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS line FROM documents
        ), t AS (
            SELECT source, count(*) AS pages FROM documents GROUP BY source
        ), b AS (
            SELECT l.source, list(l.line) AS gone FROM (SELECT source, line, count(*) AS n FROM l GROUP BY source, line) l
            JOIN t ON l.source IS NOT DISTINCT FROM t.source WHERE n >= 3 AND n > 0.08 * pages GROUP BY l.source
        ), k AS (
            SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS lines,
                CASE WHEN b.gone IS NULL THEN string_split(d.text, chr(10))
                     ELSE list_filter(string_split(d.text, chr(10)), lambda x: trim(x) = '' OR NOT list_contains(b.gone, trim(x))) END AS kept
            FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
        )
        SELECT doc_id, source, coalesce(len(lines), 0)::INTEGER AS n_lines, coalesce(len(lines) - len(kept), 0)::INTEGER AS n_dropped,
            CASE WHEN kept IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text
        FROM k
    """,
    "op11_substring_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), g AS (
            SELECT row, unnest(range(1, len(w) - 33)) AS p, unnest(list_transform(range(1, len(w) - 33), lambda p: sha256(array_to_string(w[p:p + 34], ' ')))) AS k FROM d WHERE len(w) >= 35
        ), h AS (
            SELECT row, p, count(*) OVER (PARTITION BY k) AS n FROM g
        ), x AS (
            SELECT d.row, unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS i FROM d
        ), y AS (
            SELECT x.row, x.i, x.word, count(*) FILTER (WHERE h.n > 1) OVER (PARTITION BY x.row ORDER BY x.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) > 0 AS gone
            FROM x LEFT JOIN h ON x.row = h.row AND x.i = h.p
        ), z AS (
            SELECT row, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM y GROUP BY row
        )
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(z.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(z.kept, '')) AS kept_sha256 FROM d LEFT JOIN z ON d.row = z.row
    """,
    "op12_prefix_trie": """
        WITH t AS (
            SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k, strlen(coalesce(text, '')) AS bytes
            FROM conversations WHERE conv_id IS NOT NULL
        ), o AS MATERIALIZED (
            SELECT conv_id, list(k ORDER BY turn NULLS FIRST, k) AS w, list(bytes ORDER BY turn NULLS FIRST, k) AS b FROM t GROUP BY conv_id
        ), h AS (
            SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9 AS h FROM o
        ), r AS MATERIALIZED (
            SELECT o.conv_id, list_concat(coalesce(q.w[1:h], []), o.w[h + 1:]) AS w, list_concat(coalesce(q.b[1:h], []), o.b[h + 1:]) AS b
            FROM o JOIN h ON o.conv_id = h.conv_id LEFT JOIN o q ON q.conv_id = o.conv_id - o.conv_id % 5
        ), p AS (
            SELECT conv_id, d, array_to_string(w[1:d], '') AS node, CASE WHEN d > 0 THEN b[d] ELSE 0 END AS bytes, d = len(w) AS ends FROM (SELECT *, unnest(range(len(w) + 1)) AS d FROM r)
        ), n AS MATERIALIZED (
            SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
                sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY node, d
        ), c AS MATERIALIZED (
            SELECT left(node, (64 * (d - 1))::BIGINT) AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2
        ), s AS (
            SELECT left(n.node, (64 * e)::BIGINT) AS node, e AS d, sum((c.node IS NULL)::BIGINT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
            FROM (SELECT *, unnest(range(d + 1)) AS e FROM n) n LEFT JOIN c ON n.node = c.node AND n.d = c.d GROUP BY 1, 2
        )
        SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
        FROM n JOIN s ON n.node = s.node AND n.d = s.d LEFT JOIN c ON n.node = c.node AND n.d = c.d LEFT JOIN n u ON n.d > 0 AND u.d = n.d - 1 AND u.node = left(n.node, (64 * (n.d - 1))::BIGINT)
    """,
    "op13_clustering": _clustering_sql(),
}
