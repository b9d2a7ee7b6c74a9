"""Mixing overlapping sources to target weights by min-cost flow (operator 4).

Documents are aggregated by membership pattern (the set of sources that hold
them). Token capacity flows from patterns to source quotas at the least cost,
where a further repetition of a pattern costs more than the one before, so
nothing repeats while unused words are left. The flow is solved on the driver
on one row for each pattern (at most MAX_PATTERNS, checked). Documents stand in
a seeded order within their pattern; a pattern that is used u times its words
takes every document floor(u) times, and once more those whose middle lies
before the remainder, so a source misses its quota by half a document at most.
So where a pattern's documents go follows from a few cuts in that order, and
documents meet these without a shuffle.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a null array of sources is none, and such a row is never taken;
no document is taken more than max_repeats times; rows that share an id (a null
one too) are taken alike; an empty table gives no rows. The order comes from a
hash of seed and id alone, so reruns agree.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import chain
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayrisk.llm.shared import all_columns, shared_table

MAX_PATTERNS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: list[float], max_repeats: int = 3) -> dict[str | None, float]:
    """Shares of the sum of sizes by repeating weights, none above max_repeats times its source; excess is reshared by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > max_repeats * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = float(max_repeats * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in out]
    return out


def min_cost_flow(patterns: dict[tuple, int], quotas: dict[str | None, int], max_repeats: int) -> dict[tuple, dict[str | None, int]]:
    """Words that each pattern gives each of its sources: as much of the quotas as can be met, at the least sum of repetition costs.

    Only a pattern's repetitions cost anything (0, 1, ... for each word), so the
    cheapest path that still carries flow starts at a pattern of the least
    repetition that can reach a quota. Each repetition's capacity is opened in
    turn and blocking flows fill what it can (shortest augmenting paths, by
    levels), which is the flow that successive shortest paths give.
    """
    names, sources = list(patterns), list(quotas)
    at = {s: i for i, s in enumerate(sources)}
    gives = [[at[s] for s in p] for p in names]
    words = [patterns[p] for p in names]
    flow: list[dict[int, int]] = [{} for _ in names]  # by source
    takers: list[dict[int, None]] = [{} for _ in sources]  # patterns that give a source something
    open_words, wanted = [0] * len(names), [quotas[s] for s in sources]
    for _ in range(max_repeats):
        open_words = [o + w for o, w in zip(open_words, words, strict=True)]
        while True:
            # Levels from the patterns that have words left; a source passes on by taking less from another pattern.
            level_p = {i: 0 for i, o in enumerate(open_words) if o > 0}
            level_s: dict[int, int] = {}
            front, depth, ends = list(level_p), 0, False
            while front and not ends:
                reached = dict.fromkeys(s for i in front for s in gives[i] if s not in level_s)
                depth += 1
                level_s |= dict.fromkeys(reached, depth)
                ends = any(wanted[s] > 0 for s in reached)
                front = [] if ends else list(dict.fromkeys(i for s in reached for i in takers[s] if i not in level_p))
                depth += 1
                level_p |= dict.fromkeys(front, depth)
            if not ends:
                break
            next_s = {i: iter(gives[i]) for i in level_p}
            next_p = {s: iter(list(takers[s])) for s in level_s}
            for start in [i for i, d in level_p.items() if d == 0]:
                while open_words[start] > 0:
                    path = [start]  # pattern, source, pattern, source, ...
                    while path:
                        here = path[-1]
                        if len(path) % 2:
                            step = next((s for s in next_s[here] if level_s.get(s) == level_p[here] + 1), None)
                        elif wanted[here] > 0:
                            break
                        else:
                            step = next((i for i in next_p[here] if level_p.get(i) == level_s[here] + 1 and flow[i].get(here)), None)
                        if step is not None:
                            path.append(step)
                            continue
                        path.pop()
                    if not path:
                        break
                    back = list(zip(path[2::2], path[1::2], strict=False))  # (pattern, source that takes less from it)
                    push = min([open_words[start], wanted[path[-1]], *(flow[i][s] for i, s in back)])
                    open_words[start] -= push
                    wanted[path[-1]] -= push
                    for i, s in zip(path[::2], path[1::2], strict=True):
                        flow[i][s] = flow[i].get(s, 0) + push
                        takers[s][i] = None
                    for i, s in back:
                        flow[i][s] -= push
                        if not flow[i][s]:
                            del flow[i][s], takers[s][i]
                    # Arcs of the path that still have room are tried again.
                    for k, here in enumerate(path[:-1]):
                        arcs = next_p if k % 2 else next_s
                        arcs[here] = chain([path[k + 1]], arcs[here])
    return {p: {sources[s]: n for s, n in flow[i].items() if n} for i, p in enumerate(names)}


def _pattern(sources: Column) -> Column:
    """The distinct sources of a row, a null one last; a null array is no source."""
    named = F.transform(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.struct(s.isNull().alias("none"), F.coalesce(s, F.lit("")).alias("name")))
    return F.array_sort(F.array_distinct(named))


def _draw(id_col: Column, seed: int) -> Column:
    """The seeded order: not negative."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 1)


class Mix(NamedTuple):
    """Which documents a mix takes, and how often.

    cuts: for each pattern a row with, for each repetition and source, the last
    document of the seeded order (draw, id) that goes there.
    """

    cuts: DataFrame
    rows: DataFrame  # id, pattern, size and draw of every document
    sources: Column
    present: Column  # whether a document has any words
    seed: int
    id_col: str
    sizes: dict
    wanted: dict


def plan(docs: DataFrame, sources: Column, size: Column, quotas, max_repeats: int = 3, seed: int = 4, id_col: str = "doc_id", present: Column | None = None) -> Mix:
    """A Mix of docs. sources: an array of sources; quotas: a function from the words of each source to the words wanted of each; present: size > 0, if that can be told for less than the size.

    Broadcast: one row for each pattern, at most MAX_PATTERNS, with up to
    max_repeats entries for each of its sources.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(id_col).alias("id"), _pattern(sources).alias("pattern"), size.alias("size"), _draw(F.col(id_col), seed).alias("draw"))
    narrow = shared_table(narrow, "mix")
    found = narrow.groupBy("pattern").agg(F.count("*").alias("n"), F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; map sources to fewer groups first")
    named = {tuple(None if s.none else s.name for s in r.pattern): r for r in found}
    of_source: dict[str | None, int] = defaultdict(int)
    for p, r in named.items():
        for s in p:
            of_source[s] += r.words
    wanted = quotas(dict(of_source))
    flow = min_cost_flow({p: r.words for p, r in named.items()}, {s: round(q) for s, q in wanted.items()}, max_repeats)

    rows = []
    for p, r in named.items():
        ends, total = [], 0
        for s in sorted(flow[p], key=lambda s: (s is None, s or "")):
            total += flow[p][s]
            ends.append((float(total), s is None, s))
        rows.append(([tuple(s) for s in r.pattern], max(1, math.ceil(r.n / max(500, math.isqrt(r.n)))), float(r.words), ends))
    table = spark.createDataFrame(rows, "pattern array<struct<none boolean, name string>>, parts long, words double, ends array<struct<upto double, none boolean, source string>>")
    # The draw's high bits part each pattern, so that parts follow one another in the seeded order.
    dealt = narrow.join(F.broadcast(table.select("pattern", "parts")), "pattern")
    share = F.shiftrightunsigned("draw", 32).cast("double") / float(1 << 31)
    dealt = dealt.withColumn("part", F.floor(share * F.col("parts")))
    before = dealt.groupBy("pattern", "part").agg(F.sum("size").alias("words"))
    before = before.select("pattern", "part", (F.sum("words").over(Window.partitionBy("pattern").orderBy("part")) - F.col("words")).alias("before"))
    order = Window.partitionBy("pattern", "part").orderBy("draw", "id", "size")
    placed = dealt.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(before, ["pattern", "part"])
    middle = F.col("before") + F.col("upto") - F.col("size") / 2
    # Of every repetition and end the last document whose middle lies before it.
    arcs = [(pattern, k, i, end[0] - k * words, end[2]) for pattern, _, words, ends in rows for k in range(max_repeats) for i, end in enumerate(ends) if end[0] > k * words]
    arcs = spark.createDataFrame(arcs, "pattern array<struct<none boolean, name string>>, k int, i int, upto double, source string")
    by_pattern = arcs.groupBy("pattern").agg(F.collect_list(F.struct("k", "i", "upto", "source")).alias("arcs"))
    last = placed.where("size > 0").withColumn("middle", middle).join(F.broadcast(by_pattern), "pattern")
    last = last.select("pattern", "draw", "id", F.explode(F.filter("arcs", lambda a: F.col("middle") <= a["upto"])).alias("a"))
    cuts = last.groupBy("pattern", "a").agg(F.max(F.struct("draw", "id")).alias("last"))
    cuts = cuts.groupBy("pattern").agg(F.sort_array(F.collect_list(F.struct("a.k", "a.i", "last", "a.source"))).alias("cuts"))
    return Mix(shared_table(cuts, "cuts"), narrow, sources, size > 0 if present is None else present, seed, id_col, dict(of_source), wanted)


def taken(docs: DataFrame, mix: Mix, name: str = "copies") -> DataFrame:
    """docs with the column `name`: the source that each copy of the row goes to. Needs no shuffle."""
    at = F.struct(_draw(F.col(mix.id_col), mix.seed).alias("draw"), F.col(mix.id_col).alias("id"))
    row = docs.select(F.struct(*all_columns(docs)).alias("row"), _pattern(mix.sources).alias("pattern"), mix.present.alias("present"), at.alias("at"))
    row = row.join(F.broadcast(mix.cuts), "pattern", "left")
    reached = F.filter("cuts", lambda c: (F.col("at") <= c["last"]) & F.col("present"))
    # Of each repetition the first end that the document lies before.
    first = F.filter(reached, lambda c, j: (j == 0) | (F.coalesce(F.get(reached, j - 1)["k"], F.lit(-1)) < c["k"]))
    copies = F.coalesce(F.transform(first, lambda c: c["source"]), F.array().cast("array<string>"))
    return row.withColumn("copies", copies).select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() != name.lower()), F.col("copies").alias(name))


def mix(docs: DataFrame, sources: Column, size: Column, quotas, max_repeats: int = 3, seed: int = 4, id_col: str = "doc_id") -> DataFrame:
    """id, size, pattern and copies (the source that each copy goes to) of every row of docs."""
    made = plan(docs, sources, size, quotas, max_repeats, seed, id_col)
    names = F.transform("pattern", lambda s: F.when(~s["none"], s["name"]))
    return taken(made.rows.select("id", "size", "pattern"), made._replace(sources=names, present=F.col("size") > 0, id_col="id"))
