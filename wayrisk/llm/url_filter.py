"""URL filters by rules and link-graph propagation (operator 9).

Rules name a host (with all its subdomains) and a path prefix; the longest that
fits decides. For other urls the host decides: pages that rules allow seed a
personalised PageRank over host edges, and pages that rules block seed one over
the reversed edges, since who links to blocked hosts shares their distrust. A
host is blocked when its distrust is over `threshold` times its trust.

Defined results: a null url, or one without "://", has an empty host and path,
fits no rule and is allowed, as any host without trust and distrust. Links are
absolute or scheme-relative hrefs; links within a host make no edge. Null html
has no links. Repeated rows count as pages of their own. Other columns are left
out, whatever they are named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """src, dst, share: each host's links to other hosts, as shares of its links."""
    url = F.regexp_replace("link", "^//", "http://")
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)).alias("link")).select("src", host_of(url).alias("dst"))
    n = links.where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = n.groupBy("src").agg(F.sum("n").alias("total"))
    return n.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int | None = None, save_every: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """Personalised PageRank: host, score. seeds: host, mass (summing to 1); edges: src, dst, share.

    Without a number of rounds it goes on until, from one checkpoint to the
    next, no host's score changes by more than `tolerance` of itself. A host
    that is reached for the first time counts as changed, so distance is no
    limit, and small scores are as exact as large ones.
    """
    rank = saved = seeds.select("host", F.col("mass").alias("score"))
    i = 0
    while rounds is None or i < rounds:
        i += 1
        moved = rank.join(edges, rank.host == edges.src).select(F.col("dst").alias("host"), (damping * F.col("score") * F.col("share")).alias("score"))
        kept = seeds.select("host", ((1 - damping) * F.col("mass")).alias("score"))
        both = kept.unionByName(moved)
        if i % save_every or i == rounds:
            rank = both.groupBy("host").agg(F.sum("score").alias("score"))
            continue
        old = saved.select("host", F.lit(0.0).alias("score"), F.col("score").alias("old"))
        ranks = both.withColumn("old", F.lit(0.0)).unionByName(old).groupBy("host").agg(F.sum("score").alias("score"), F.sum("old").alias("old")).checkpoint()
        rank = saved = ranks.select("host", "score")
        if rounds is None and ranks.where(F.abs(F.col("score") - F.col("old")) > tolerance * F.col("score")).isEmpty():
            break
    return rank


def judge(pages: DataFrame, rules=RULES, threshold: float = 1.0, rounds: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id_col, host, path, rule, verdict, with the host's trust and distrust (converged, or after `rounds` rounds if given)."""
    from wayrisk.llm.shared import shared_dir, shared_table

    shared_dir(pages.sparkSession)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    by_host = rows.where("found is not null").groupBy("host").agg(F.count_if(F.col("found.verdict") == "allow").alias("allow"), F.count_if(F.col("found.verdict") == "block").alias("block"))
    by_host = shared_table(by_host, "seeds")
    # Links are few beside the pages' text; both directions read the same small table.
    edges = shared_table(host_edges(pages, host_of(url), F.col(html_col)), "edges")
    back = edges.groupBy("dst").agg(F.sum("share").alias("all")).join(edges, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("share") / F.col("all")).alias("share"))

    def mass(kind: str) -> DataFrame:
        total = by_host.agg(F.sum(kind)).first()[0] or 1
        return by_host.where(F.col(kind) > 0).select("host", (F.col(kind) / float(total)).alias("mass"))

    trust = propagate(mass("allow"), edges, rounds=rounds).withColumnRenamed("score", "trust")
    distrust = propagate(mass("block"), back, rounds=rounds).withColumnRenamed("score", "distrust")
    scores = trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])
    out = rows.join(scores, "host", "left").na.fill(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") > threshold * F.col("trust"), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce(F.col("found.verdict"), own).alias("verdict"), "trust", "distrust")
