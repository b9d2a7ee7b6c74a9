"""Paths, flows and failures (survey rows N13-N19, N21-N25, A9-A11).

Two engines find least-cost paths, and both give the same rows. Up to MOST_EDGES
edges a graph is broadcast and Dijkstra's method runs in tasks, one origin at a
time; beyond, `relaxation` grows the trees by joins. Graphs are undirected; ties
go to the path with fewer edges, then to the smaller edge id (as text).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayrisk.functions.columns import order_all_pairs
from wayrisk.operators import relaxation
from wayrisk.operators.joins import left_fill

MOST_EDGES = 10_000_000  # of a broadcast graph: 32 bytes and the id of each edge, some 500 MB
MOST_PAIRS = 2_000_000  # of nodes in relaxed_costs()
AT_ONCE = 8192  # arcs


def _bytes(texts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Texts without nulls as UTF-8 of one width, which sorts as they do."""
    chunks = texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]
    parts = []
    for c in chunks:
        for k in range(0, len(c), 65536):
            part = c.slice(k, 65536).cast(pa.large_string())
            at = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            size = np.diff(at)
            out = np.zeros((len(part), max(1, int(size.max()))), np.uint8)
            data = np.frombuffer(part.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            out[np.repeat(np.arange(len(part)), size), np.arange(len(data)) - np.repeat(at[:-1] - at[0], size)] = data
            parts.append(out.view(f"S{out.shape[1]}").reshape(-1))
    return np.concatenate(parts) if parts else np.array([], "S1")


class Names:
    """Texts by number, held as UTF-8 bytes."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw

    def __len__(self) -> int:
        return len(self.raw)

    def __getitem__(self, i: int) -> str:
        return self.raw[i].decode()

    def tolist(self) -> list[str]:
        return [x.decode() for x in self.raw.tolist()]


class Ids:
    """Numbers of sorted names, found by halving; of equal ones the last."""

    def __init__(self, names: Names):
        self.raw = names.raw

    def find(self, texts: list[str] | pa.Array) -> np.ndarray:
        """The number of each text, -1 of those that are not there."""
        want = _bytes(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        if not len(want) or not len(self.raw):
            return np.full(len(want), -1)
        at = np.searchsorted(self.raw, want, "right") - 1
        return np.where((at >= 0) & (self.raw[at] == want), at, -1)

    def of(self, texts: list[str] | pa.Array) -> np.ndarray:
        """Numbers of those of the texts that are there."""
        at = self.find(texts)
        return at[at >= 0]

    def get(self, name: str) -> int | None:
        at = self.of([name])
        return int(at[0]) if len(at) else None

    def __contains__(self, name: str) -> bool:
        return self.get(name) is not None

    def __getitem__(self, name: str) -> int:
        at = self.get(name)
        if at is None:
            raise KeyError(name)
        return at


class Graph:
    """Adjacency arrays of an undirected multigraph; nodes and edges are numbered in the order of their ids.

    Workers hold it as arrays only, 16 bytes an arc and its ids: a node's arcs
    become Python's numbers when they are asked for, and ids are found by halving.
    """

    def __init__(self, nodes: Names, at: np.ndarray, to: np.ndarray, edge: np.ndarray, cost: np.ndarray):
        self.nodes, self.at, self.to, self.edge, self.cost = nodes, at, to.astype(np.int32), edge.astype(np.int32), cost
        self.index = Ids(nodes)

    def arcs(self, u: int) -> zip:
        """Node, edge and cost of each arc that leaves a node."""
        i, j = self.at[u], self.at[u + 1]
        return zip(self.to[i:j].tolist(), self.edge[i:j].tolist(), self.cost[i:j].tolist())

    @classmethod
    def of(cls, edges: DataFrame, cost: str, sums: tuple[str, ...] = ()) -> Graph | None:
        """None above MOST_EDGES edges. sums: further edge attributes to be summed along paths.

        Tasks put edges in order and number their ends; the driver gets numbers
        and the edges' ids as Arrow, no row becomes Python's objects there.
        """
        edges = relaxation.usable(edges, cost)
        if edges.select("edge_id").count() > MOST_EDGES:
            return None
        text = lambda c: F.col(c).cast("string").alias(c)
        ends = edges.select(F.explode(F.array(text("from_node"), text("to_node"))).alias("node")).distinct().toArrow()
        nodes = np.unique(_bytes(ends["node"]))
        index = edges.sparkSession.sparkContext.broadcast(Ids(Names(nodes)))
        cols = ["cost", *(f"sum_{s}" for s in sums)]

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                both = (pa.array(index.value.find(b.column(c)), pa.int32()) for c in ("from_node", "to_node"))
                yield pa.RecordBatch.from_arrays([*both, b.column("edge_id"), *(b.column(c) for c in cols)], ["a", "b", "edge_id", *cols])

        rows = edges.select(text("from_node"), text("to_node"), text("edge_id"), F.col(cost).cast("double").alias("cost"), *(F.col(s).cast("double").alias(f"sum_{s}") for s in sums))
        rows = rows.orderBy("edge_id").mapInArrow(numbered, ", ".join(["a int", "b int", "edge_id string", *(f"{c} double" for c in cols)])).toArrow()
        own = rows["cost"].to_numpy()
        if (own < 0).any():
            raise ValueError("negative costs")
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        at = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(nodes)) + np.bincount(b, minlength=len(nodes)))])
        order = np.argsort(np.concatenate([a, b]), kind="stable")
        to = np.concatenate([b, a])[order]
        edge = np.remainder(order, max(1, len(a)), out=order).astype(np.int32)
        graph = cls(Names(nodes), at, to, edge, own[edge])
        graph.ids = Names(_bytes(rows["edge_id"]))
        graph.number = Ids(graph.ids)
        graph.sums = {s: rows[f"sum_{s}"].to_numpy() for s in sums}
        return graph

    def _parts(self, nodes: np.ndarray) -> list[np.ndarray]:
        """The nodes in parts of some AT_ONCE arcs."""
        if not len(nodes):
            return []
        end = np.cumsum(self.at[nodes + 1] - self.at[nodes])
        return np.split(nodes, np.unique(np.searchsorted(end, np.arange(AT_ONCE, end[-1], AT_ONCE), "right")))

    def _leaving(self, nodes: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the arcs that leave the nodes, and of each one's node."""
        at = self.at if at is None else at
        first, n = at[nodes], at[nodes + 1] - at[nodes]
        return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n), np.repeat(nodes, n)

    def costs(self, origin: int) -> np.ndarray:
        """Least costs from a node: nodes whose costs are near the least that waits go on at once, in parts."""
        cost, waits = np.full(len(self.nodes), np.inf), np.zeros(len(self.nodes), bool)
        apart = float(np.median(self.cost[: 8 * AT_ONCE])) / 8 if len(self.cost) else 0.0  # this changes the work only
        cost[origin], left = 0.0, np.array([origin])
        while len(left):
            c = cost[left]
            near = c <= c.min() + apart
            now, left = left[near], [left[~near]]
            waits[now] = False
            for part in self._parts(now):
                arc, node = self._leaving(part)
                new, to = cost[node] + self.cost[arc], self.to[arc]
                fell = np.flatnonzero(new < cost[to])
                new, to = new[fell], to[fell]
                more = np.unique(to[~waits[to]])
                while len(to):
                    # Of several costs of a node the last is put down, until none is less.
                    cost[to] = new
                    fell = np.flatnonzero(new < cost[to])
                    new, to = new[fell], to[fell]
                waits[more] = True
                left.append(more)
            left = np.concatenate(left)
        return cost

    def _settle(self, heap: list, cost, hops, by, before, inside=None, without: frozenset = frozenset()) -> None:
        """Dijkstra's loop from what is on the heap, on the nodes `inside` (all if None)."""
        while heap:
            c, h, u = heapq.heappop(heap)
            if (c, h) != (cost[u], hops[u]):
                continue
            for v, e, step in self.arcs(u):
                if e in without or inside is not None and v not in inside:
                    continue
                d = c + step
                if d < cost[v] or d == cost[v] and (h + 1, e) < (hops[v], by[v]):
                    if (d, h + 1) != (cost[v], hops[v]):
                        heapq.heappush(heap, (d, h + 1, v))
                    cost[v], hops[v], by[v], before[v] = d, h + 1, e, u

    def tree(self, origin: int, without: frozenset = frozenset()) -> Tree:
        """All least paths from origin; edges in `without` are closed."""
        n = len(self.nodes)
        if without:
            cost, hops, by, before = [math.inf] * n, [0] * n, [-1] * n, [-1] * n
            cost[origin] = 0.0
            self._settle([(0.0, 0, origin)], cost, hops, by, before, without=without)
            return Tree(self, cost, hops, by, before)
        cost, arcs = self.costs(origin), []
        # Arcs on least paths; along these the fewest edges, then the smallest.
        for part in self._parts(np.flatnonzero(np.isfinite(cost))):
            arc, node = self._leaving(part)
            on = np.flatnonzero(cost[node] + self.cost[arc] == cost[self.to[arc]])
            arcs.append((node[on], arc[on]))
        node, arc = (np.concatenate(x) for x in zip(*arcs)) if arcs else (np.array([], int), np.array([], int))
        at, hops, front, h = np.searchsorted(node, np.arange(n + 1)), np.full(n, -1), np.array([origin]), 0
        hops[origin] = 0
        while len(front):
            to = self.to[arc[self._leaving(front, at)[0]]]
            front, h = np.unique(to[hops[to] < 0]), h + 1
            hops[front] = h
        arc, node = arc[on := hops[self.to[arc]] == hops[node] + 1], node[on]
        by, before, last = np.full(n, -1), np.full(n, -1), np.argsort(-self.edge[arc], kind="stable")
        to = self.to[arc[last]]
        by[to], before[to] = self.edge[arc[last]], node[last]
        hops[hops < 0] = 0
        return Tree(self, cost.tolist(), hops.tolist(), by.tolist(), before.tolist())

    def path(self, tree: Tree, target: int) -> list[str]:
        """Edge ids of a tree's path, in order."""
        return [self.ids[e] for e in tree.steps(target)]

    def nearest_two(self, origins: list[int]) -> list[list[tuple[float, int]]]:
        """Of each node the two nearest of the origins, as (cost, rank among the origins); ties go to the one named first."""
        found: list[list[tuple[float, int]]] = [[] for _ in range(len(self.nodes))]
        best: list[list[tuple[float, int]]] = [[] for _ in range(len(self.nodes))]
        heap = [(0.0, rank, u) for rank, u in enumerate(origins)]
        while heap:
            c, rank, u = heapq.heappop(heap)
            if len(found[u]) == 2 or found[u] and found[u][0][1] == rank:
                continue
            found[u].append((c, rank))
            for v, _, step in self.arcs(u):
                # Only what may be among the node's two nearest goes on the heap.
                new, seen = (c + step, rank), best[v]
                if len(seen) == 2 and new >= seen[1] or any(old[1] == rank and new >= old for old in seen):
                    continue
                best[v] = sorted([*(old for old in seen if old[1] != rank), new])[:2]
                heapq.heappush(heap, (*new, v))
        return found


class Tree:
    """Least paths from one origin; `without` repairs it around closed edges."""

    places = costs = None

    def __init__(self, graph: Graph, cost, hops, by, before):
        self.graph, self.cost, self.hops, self.by, self.before = graph, cost, hops, by, before
        self.settled = 0  # nodes that repairs have settled anew

    def __getitem__(self, i: int):
        """Costs, edges or nodes before the nodes."""
        return (self.cost, self.by, self.before)[i]

    def steps(self, target: int) -> list[int]:
        """Numbers of the path's edges, in order."""
        out = []
        while self.by[target] >= 0:
            out.append(self.by[target])
            target = self.before[target]
        return out[::-1]

    def _walk(self) -> None:
        """Entry and exit numbers of a depth-first walk: a node's subtree is order[entry:exit]."""
        children: dict[int, list[int]] = {}
        for v, u in enumerate(self.before):
            if u >= 0:
                children.setdefault(u, []).append(v)
        self.order, self.entry, self.exit = [], {}, {}
        stack = [(v, False) for v, e in enumerate(self.by) if e < 0 and math.isfinite(self.cost[v])]
        while stack:
            v, left = stack.pop()
            if left:
                self.exit[v] = len(self.order)
                continue
            self.entry[v] = len(self.order)
            self.order.append(v)
            stack.append((v, True))
            stack += [(w, False) for w in children.get(v, ())]
        self.places = {e: v for v, e in enumerate(self.by) if e >= 0}  # the node that a tree edge leads to

    def without(self, shut: frozenset) -> Tree:
        """The tree with these edges closed: only nodes below them are settled anew, from their neighbours outside."""
        if self.places is None:
            self._walk()
        inside: set[int] = set()
        for e in shut:
            v = self.places.get(e)
            if v is not None and v not in inside:
                inside.update(self.order[self.entry[v] : self.exit[v]])
        if not inside:
            return self
        self.settled += len(inside)
        cost, hops, by, before = (_Patched(x) for x in (self.cost, self.hops, self.by, self.before))
        for v in inside:
            cost[v], hops[v], by[v], before[v] = math.inf, 0, -1, -1
        if self.costs is None:
            self.costs = np.array(self.cost)
        g, heap = self.graph, []
        for v in inside:
            best, i, j = None, g.at[v], g.at[v + 1]
            found = self.costs[g.to[i:j]] + g.cost[i:j]
            for k in found.argsort().tolist():
                c, u, e = found.item(k), g.to.item(i + k), g.edge.item(i + k)
                if best is not None and c > best[0] or c == math.inf:
                    break
                if u not in inside and e not in shut:
                    new = (c, self.hops[u] + 1, e, u)
                    best = new if best is None or new < best else best
            if best is not None:
                cost[v], hops[v], by[v], before[v] = best
                heap.append((*best[:2], v))
        if len(inside) > 1:
            heapq.heapify(heap)
            g._settle(heap, cost, hops, by, before, inside, shut)
        return Tree(g, cost, hops, by, before)


class _Patched(dict):
    """A list with some items replaced."""

    def __init__(self, under: list):
        super().__init__()
        self.under = under

    def __missing__(self, i: int):
        return self.under[i]


def _dealt(rows: DataFrame, origins: DataFrame, salt: Column, *order: str, each: int = 1) -> DataFrame:
    """Rows of one origin together and in order, unless there are fewer origins (counted) than tasks: then each is dealt to several salts.

    To a number of partitions, as few bytes mean much work here and would else be put into one task;
    `each` times as many where an origin has too many rows for one task's sort.
    """
    n = each * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, 2 * n // max(1, origins.select("origin_id").distinct().limit(2 * n).count()))
    return rows.withColumn("_salt", F.pmod(F.hash(salt), F.lit(salts))).repartition(n, "origin_id", "_salt").sortWithinPartitions("origin_id", "_salt", *order).drop("_salt")


def shortest_paths(od: DataFrame, edges: DataFrame, cost: str = "cost", name: str = "path") -> DataFrame:
    """Od (origin_id, destination_id, ...) with `path` (edge ids in order), cost and reachable.

    Rows are dealt by origin so that a task grows one tree for each of its
    origins; no path gives a null path and cost, and unknown nodes count so.
    """
    local = Graph.of(edges, cost)
    if local is None:
        return _joined_paths(od, edges, cost, name)
    graph = od.sparkSession.sparkContext.broadcast(local)
    schema = od.withColumns({name: F.lit(None).cast("array<string>"), cost: F.lit(None).cast("double"), "reachable": F.lit(True)}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, last, tree = graph.value, None, None
        for b in batches:
            paths, costs = [], []
            ends = (g.index.find(b[c].astype(str).tolist()).tolist() for c in ("origin_id", "destination_id"))
            for i, j in zip(*ends, strict=True):
                if i < 0 or j < 0:
                    paths.append(None)
                    costs.append(None)
                    continue
                if i != last:
                    last, tree = i, g.tree(i)
                ok = math.isfinite(tree.cost[j])
                paths.append(g.path(tree, j) if ok else None)
                costs.append(tree.cost[j] if ok else None)
            yield b.assign(**{name: paths, cost: pd.array(costs, "Float64"), "reachable": [p is not None for p in paths]})

    return _dealt(od, od, F.col("destination_id")).mapInPandas(run, schema)


def _joined_paths(od: DataFrame, edges: DataFrame, cost: str, name: str) -> DataFrame:
    arcs = relaxation.arcs_of(edges, cost)
    sources = od.select(F.col("origin_id").cast("string").alias("tree")).distinct().withColumn("node", F.col("tree"))
    state = relaxation.trees(sources, arcs)
    found = state.join(relaxation.paths(state), ["tree", "node"]).select(F.col("tree").alias("_o"), F.col("node").alias("_d"), F.col("path").alias(name), F.col("at.cost").alias(cost))
    rest = od.drop(name, cost, "reachable")
    out = rest.join(found, (rest["origin_id"].cast("string") == found["_o"]) & (rest["destination_id"].cast("string") == found["_d"]), "left")
    return out.select(*rest.columns, name, cost, F.col(name).isNotNull().alias("reachable"))


def relaxed_costs(origins: DataFrame, edges: DataFrame, cost: str = "cost", most_rounds: int | None = None) -> DataFrame:
    """N13 as relaxation: (origin_id, node, cost) of all reachable nodes; an origin on no edge reaches itself.

    Up to MOST_PAIRS pairs of nodes the arcs are broadcast, and tasks find the
    costs of one origin after the other, so no row is shuffled or written before
    it is final. Beyond, and where rounds are bounded, it goes by joins: only
    nodes whose cost fell go on, and a checkpoint cuts each round's lineage.
    Rounds go on until no cost falls, as many as the longest least path has
    edges; a bound on them raises an error when it is hit. Negative costs are
    refused, as they could fall for ever.
    """
    arcs = relaxation.usable(edges.withColumn("edge_id", F.lit(0)), cost).select(F.col("from_node").alias("node"), F.col("to_node").alias("next"), F.col(cost).cast("double").alias("step"))
    arcs = arcs.unionByName(arcs.select(F.col("next").alias("node"), F.col("node").alias("next"), "step")).where(F.col("step") < math.inf).groupBy("node", "next").agg(F.min("step").alias("step")).checkpoint()
    if not arcs.where("step < 0").isEmpty():
        raise ValueError("negative costs")
    if most_rounds is None and arcs.count() <= 2 * min(MOST_EDGES, MOST_PAIRS):
        return _costs_in_tasks(origins, arcs)
    return _joined_costs(origins, arcs, most_rounds)


class Arcs:
    """Arcs of numbered nodes, cheapest first, in rows of WIDE: a node's rows lie together, and their rest leads nowhere."""

    WIDE = 16

    def __init__(self, node: np.ndarray, next_: np.ndarray, step: np.ndarray, nodes: int):
        order, deg, wide = np.lexsort((step, node)), np.bincount(node, minlength=nodes), self.WIDE
        self.rows = -(-deg // wide)
        self.at = np.cumsum(self.rows) - self.rows
        place = np.arange(len(node)) + np.repeat(self.at * wide - np.cumsum(deg) + deg, deg)
        self.to, self.step = np.zeros((self.rows.sum(), wide), np.intp), np.full((self.rows.sum(), wide), np.inf)
        self.to.reshape(-1)[place], self.step.reshape(-1)[place] = next_[order], step[order]
        self.least = self.step[:, 0].copy()
        # Nodes whose costs differ by less go on together; this changes the work only.
        self.apart = float(np.median(step)) / 8 if len(step) else 0.0

    def costs(self, origin: int) -> np.ndarray:
        """Least costs from a node: those within `apart` of the least that waits go on at once, so nearly every arc is looked at once."""
        cost, waits, mark = np.full(len(self.at), np.inf), np.zeros(len(self.at), bool), np.empty(len(self.at), np.intp)
        cost[origin], left = 0.0, np.array([origin])
        while len(left):
            c = cost.take(left)
            near = c <= c.min() + self.apart
            now, c, left = left[near], c[near], left[~near]
            waits[now] = False
            n = self.rows.take(now)
            row = np.arange(n.sum()) + np.repeat(self.at.take(now) - np.cumsum(n) + n, n)
            c = np.repeat(c, n)
            # The arcs of a row are no shorter than its first, and costs above the largest are of no use.
            use = np.flatnonzero(c + self.least.take(row) < cost.max())
            row, c = row.take(use), c.take(use)
            new, to = self.step.take(row, 0) + c[:, None], self.to.take(row, 0)
            fell = np.flatnonzero(new < cost.take(to))
            new, to = new.reshape(-1).take(fell), to.reshape(-1).take(fell)
            more = to[~waits.take(to)]
            while len(to):
                # Of several costs of a node the last is put down, until none is less.
                cost[to] = new
                fell = np.flatnonzero(new < cost.take(to))
                new, to = new.take(fell), to.take(fell)
            waits[more] = True
            mark[more] = k = np.arange(len(more))
            left = np.concatenate([left, more[mark.take(more) == k]])
        return cost


def _costs_in_tasks(origins: DataFrame, arcs: DataFrame) -> DataFrame:
    """relaxed_costs() with broadcast arcs; a task takes one origin after the other."""
    kind, own = arcs.schema["node"].dataType, origins.schema["origin_id"].dataType
    rows = arcs.toPandas()
    nodes, ends = np.unique(np.concatenate([rows["node"].to_numpy(), rows["next"].to_numpy()]), return_inverse=True)
    graph = origins.sparkSession.sparkContext.broadcast((nodes, Arcs(ends[: len(rows)], ends[len(rows) :], rows["step"].to_numpy(), len(nodes))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes, arcs = graph.value
        index = {n: i for i, n in enumerate(nodes.tolist())}
        for b in batches:
            at = np.array([index.get(x, -1) for x in b["node"].tolist()], int)
            yield b[at < 0].assign(cost=0.0)
            for o, i in zip(b["origin_id"].to_numpy()[at >= 0], at[at >= 0], strict=True):
                cost = arcs.costs(i)
                to = np.flatnonzero(cost < np.inf)
                yield pd.DataFrame({"origin_id": np.full(len(to), o), "node": nodes.take(to), "cost": cost.take(to)})

    n = int(origins.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = origins.where("origin_id is not null").select("origin_id", F.col("origin_id").cast(kind).alias("node")).distinct().repartition(n)
    none = origins.where("origin_id is null").select("origin_id", F.lit(None).cast(kind).alias("node"), F.lit(0.0).alias("cost")).distinct()
    return known.mapInPandas(run, f"origin_id {own.simpleString()}, node {kind.simpleString()}, cost double").unionByName(none)


def _joined_costs(origins: DataFrame, arcs: DataFrame, most_rounds: int | None) -> DataFrame:
    best = origins.select("origin_id", F.col("origin_id").alias("node"), F.lit(0.0).alias("cost"))
    front, done = best, 0
    while True:
        reach = front.join(arcs, "node").groupBy("origin_id", F.col("next").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("new"))
        both = best.join(reach, ["origin_id", "node"], "full").checkpoint()
        front = both.where("new is not null and (cost is null or new < cost)").select("origin_id", "node", F.col("new").alias("cost"))
        best = both.select("origin_id", "node", F.least("cost", "new").alias("cost"))
        if front.isEmpty():
            return best
        done += 1
        if done == most_rounds:
            raise RuntimeError(f"costs still fall after {most_rounds} rounds")


def with_path_sums(paths: DataFrame, edges: DataFrame, sums: list[str], key: list[str], name: str = "path") -> DataFrame:
    """Sums of edge attributes (distance, time) along each path."""
    steps = paths.select(*key, F.explode(name).alias("edge_id")).join(edges.select("edge_id", *sums), "edge_id")
    return left_fill(paths, steps.groupBy(*key).agg(*(F.sum(s).alias(s) for s in sums)), key)


def od_path_assembly(od: DataFrame, edges: DataFrame, tons: str = "tons") -> DataFrame:
    """Least paths at minimum and at maximum cost of each pair with tons, and their costs times tons."""
    kept = od.where(F.col(tons) > 0)
    lo = shortest_paths(kept, edges, "min_gcost", "min_edge_path").withColumnRenamed("reachable", "_lo")
    both = shortest_paths(lo, edges, "max_gcost", "max_edge_path").withColumnRenamed("reachable", "_hi")
    return both.withColumns({c: F.col(c) * F.col(tons) for c in ("min_gcost", "max_gcost")}).withColumn("reachable", F.col("_lo") & F.col("_hi")).drop("_lo", "_hi")


def edge_flows(paths: DataFrame, path: str, values: list[str]) -> DataFrame:
    """Values of all pairs summed on each edge of their path; one explode and one sum that combines before the shuffle."""
    return paths.select(F.explode(path).alias("edge_id"), *values).groupBy("edge_id").agg(*(F.sum(v).alias(v) for v in values))


def min_max_edge_flows(paths: DataFrame, edges: DataFrame, stems: list[str]) -> DataFrame:
    """min_ and max_ flows of the min and max paths on all edges (0 where none), each pair in order. As in the reports, edges only in the max set stay since all edges are kept."""
    lo = edge_flows(paths, "min_edge_path", [f"min_{s}" for s in stems])
    hi = edge_flows(paths, "max_edge_path", [f"max_{s}" for s in stems])
    return order_all_pairs(left_fill(left_fill(edges, lo, ["edge_id"]), hi, ["edge_id"]))


def paths_by_edge(paths: DataFrame, path: str, keep: list[str]) -> DataFrame:
    """The inverted index, a row for each edge and pair that uses it."""
    return paths.select(F.explode(F.array_distinct(path)).alias("edge_id"), *keep)


def failure_set(hits: DataFrame, flows: DataFrame, flow: str) -> DataFrame:
    """Distinct edges that a hazard hits and that carry flow."""
    return hits.select("edge_id").distinct().join(flows.where(F.col(flow) > 0), "edge_id", "left_semi")


def failures(scenarios: DataFrame, paths: DataFrame, edges: DataFrame, cost: str = "cost", path: str = "path", values: tuple[str, ...] = ("tons",), keep_paths: bool = False, sums: tuple[str, ...] = ()) -> DataFrame:
    """Pairs whose path a scenario cuts, rerouted around its closed edges.

    sums: edge attributes such as distance and time, given as old_<name> from
    paths (see with_path_sums) and as new_<name> along the new path.

    scenarios: scenario_id, edge_id (one edge or several). A row is a pair under
    a scenario: no_access 1 and no new cost if nothing else connects it. Each
    origin's tree is grown once and repaired for each scenario: only what hangs
    below a closed edge is settled anew.
    """
    used = paths_by_edge(paths, path, ["origin_id", "destination_id", F.col(cost).alias("old_cost"), *(F.col(s).cast("double").alias(f"old_{s}") for s in sums), *values]).join(scenarios, "edge_id")
    cut = used.drop("edge_id")
    local = Graph.of(edges, cost, sums)
    if local is None:
        return _joined_failures(scenarios, cut.dropDuplicates(["scenario_id", "origin_id", "destination_id"]), edges, cost, keep_paths, sums)
    graph = scenarios.sparkSession.sparkContext.broadcast(local)
    closed = scenarios.groupBy("scenario_id").agg(F.sort_array(F.collect_set(F.col("edge_id").cast("string"))).alias("closed"))
    # The closed edges come once for each scenario and origin, in a row before its pairs.
    heads = cut.select("scenario_id", "origin_id").distinct().join(closed, "scenario_id")
    rows = heads.withColumn("_pair", F.lit(0)).unionByName(cut.withColumn("_pair", F.lit(1)), allowMissingColumns=True)
    schema = cut.withColumns({"no_access": F.lit(0), "new_cost": F.lit(None).cast("double"), "new_path": F.lit(None).cast("array<string>")} | {f"new_{s}": F.lit(None).cast("double") for s in sums}).schema
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, last, tree, now, seen = graph.value, None, None, None, set()
        for b in batches:
            # Closed edges stay in Arrow until it is their row's turn, as a row may close most of a network.
            shut, pairs, keep = b.column("closed"), b.column("_pair").to_pylist(), np.zeros(len(b), bool)
            access, costs, new, along = [], [], [], {s: [] for s in sums}
            ends = (g.index.find(b.column(c).cast(pa.string())).tolist() for c in ("origin_id", "destination_id"))
            for row, (i, j, pair) in enumerate(zip(*ends, pairs, strict=True)):
                if not pair:
                    if i != last:
                        last, tree = i, g.tree(i)
                    now, seen = tree.without(frozenset(g.number.of(shut[row].values).tolist())), set()
                    continue
                # Several closed edges of a path give its pair several times.
                if j in seen:
                    continue
                seen.add(j)
                keep[row] = True
                ok = math.isfinite(now.cost[j])
                access.append(0 if ok else 1)
                costs.append(now.cost[j] if ok else None)
                steps = now.steps(j) if ok and (sums or keep_paths) else []
                new.append([g.ids[e] for e in steps] if ok and keep_paths else None)
                for name, x in along.items():
                    x.append(float(g.sums[name][steps].sum()) if ok else None)
            kept = b.filter(pa.array(keep))
            cols = [pa.array(access, pa.int32()), pa.array(costs, pa.float64()), pa.array(new, pa.list_(pa.string())), *(pa.array(x, pa.float64()) for x in along.values())]
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), *cols], [*names, "no_access", "new_cost", "new_path", *(f"new_{s}" for s in along)])

    out = _dealt(rows, paths, F.col("scenario_id"), "scenario_id", "_pair", each=4).mapInArrow(run, schema)
    return out if keep_paths else out.drop("new_path")


def _joined_failures(scenarios: DataFrame, cut: DataFrame, edges: DataFrame, cost: str, keep_paths: bool, sums: tuple[str, ...]) -> DataFrame:
    arcs, cut = relaxation.arcs_of(edges, cost), cut.checkpoint()
    key = {"run": F.col("scenario_id"), "tree": F.col("origin_id").cast("string"), "node": F.col("destination_id").cast("string")}
    pairs = cut.select(*(c.alias(k) for k, c in key.items())).distinct()
    state = relaxation.trees(pairs.select("tree", F.col("tree").alias("node")).distinct(), arcs).checkpoint()
    closed = scenarios.select(F.col("scenario_id").alias("run"), F.col("edge_id").cast("string").alias("edge_id")).distinct()
    moved = relaxation.repaired(pairs.select("run", "tree").distinct(), closed, state, arcs).checkpoint()
    mine = moved.withColumnRenamed("origin", "tree").withColumn("touched", F.lit(True))
    # A pair whose given path is not the tree's may keep the tree's.
    found = pairs.join(mine, ["run", "tree", "node"], "left").join(state.withColumnRenamed("at", "was"), ["tree", "node"], "left")
    found = found.select("run", "tree", "node", F.when(F.col("touched"), F.col("at.cost")).otherwise(F.col("was.cost")).alias("new_cost"), F.coalesce("touched", F.lit(False)).alias("touched"))
    if keep_paths or sums:
        both = F.struct("run", "origin").alias("tree")
        inside = moved.where("at is not null").select(both, "node", "at")
        known = inside.select("tree", F.col("node").alias("prev"), F.lit(True).alias("known"))
        border = inside.withColumn("prev", F.col("at.prev")).join(known, ["tree", "prev"], "left").select("tree", "node", "at", F.col("known").isNull().alias("_out")).checkpoint()
        # Down from the last node outside the repaired part, whose own path is the tree's.
        outer = border.where("_out").select("tree", F.col("at.prev").alias("node"), relaxation.start().alias("at")).distinct()
        low = relaxation.paths(border.select("tree", "node", "at").unionByName(outer)).select(F.col("tree.run").alias("run"), F.col("tree.origin").alias("tree"), "node", "top", F.col("path").alias("low"))
        high = relaxation.paths(state).select("tree", F.col("node").alias("top"), F.col("path").alias("high"))
        found = found.join(low, ["run", "tree", "node"], "left").withColumn("top", F.when(F.col("touched"), F.col("top")).otherwise(F.col("node"))).join(high, ["tree", "top"], "left")
        found = found.select("run", "tree", "node", "new_cost", F.when(F.col("new_cost").isNotNull(), F.concat("high", F.coalesce("low", F.array().cast("array<string>")))).alias("new_path"))
        if sums:
            along = with_path_sums(found.where("new_path is not null"), edges.select(F.col("edge_id").cast("string").alias("edge_id"), *(F.col(s).cast("double").alias(f"new_{s}") for s in sums)), [f"new_{s}" for s in sums], ["run", "tree", "node"], "new_path")
            found = found.join(along.select("run", "tree", "node", *(f"new_{s}" for s in sums)), ["run", "tree", "node"], "left")
    out = cut.withColumns({f"_{k}": c for k, c in key.items()})
    out = out.join(found, (out["_run"] == found["run"]) & (out["_tree"] == found["tree"]) & (out["_node"] == found["node"]))
    return out.select(*cut.columns, F.col("new_cost").isNull().cast("int").alias("no_access"), "new_cost", *(["new_path"] if keep_paths else []), *(f"new_{s}" for s in sums))


def rerouting_losses(failed: DataFrame, tons: str = "tons", sums: tuple[str, ...] = ()) -> DataFrame:
    """What rerouting adds, per ton and in all, and <name>_diff of each of sums; isolated pairs add nothing."""
    extra = lambda name: F.coalesce((1 - F.col("no_access")) * (F.col(f"new_{name}") - F.col(f"old_{name}")), F.lit(0.0))
    kept = failed.where(F.col(tons) > 0).withColumns({"cost_diff": extra("cost")} | {f"{s}_diff": extra(s) for s in sums})
    return kept.withColumn("tr_loss", F.col(tons) * F.col("cost_diff"))


def isolated_losses(failed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A9."""
    return failed.where("no_access = 1").groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def reroute_losses(failed: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A10."""
    return failed.where("no_access = 0").groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def edge_summary(lo: DataFrame, hi: DataFrame, keys: list[str], values: list[str], how: str = "left") -> DataFrame:
    """Min and max results by (edge, no_access); by default keys only in hi are left out, as in the reports."""
    a = lo.groupBy(*keys).agg(*(F.sum(v).alias(f"min_{v}") for v in values))
    b = hi.groupBy(*keys).agg(*(F.sum(v).alias(f"max_{v}") for v in values))
    return order_all_pairs(left_fill(a, b, keys, how))


def multi_modal_edges(layers: list[DataFrame], rail_flows: DataFrame | None = None, flow: str = "tons") -> DataFrame:
    """Edge tables of several modes as one network: links that are not operational, and rail edges without flow (edge_id, `flow`), are closed."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    out = out.where(F.coalesce(F.col("operation_state"), F.lit("operational")) == "operational")
    if rail_flows is None:
        return out
    used = rail_flows.where(F.col(flow) > 0).select("edge_id", F.lit("rail").alias("mode")).distinct()
    return out.where("mode is distinct from 'rail'").unionByName(out.join(used, ["edge_id", "mode"], "left_semi"))


def layered(network: DataFrame, links: DataFrame) -> DataFrame:
    """One network of several modes: nodes are `mode:node`, edges `mode:edge_id`.

    network: mode, edge_id, from_node, to_node and attributes; links: edge_id,
    from_mode, from_node, to_mode, to_node and attributes, as edges of mode
    `link` that name both modes in `joins`. Columns that one side lacks are null.
    """
    named = lambda mode, c: F.concat(mode, F.lit(":"), F.col(c).cast("string")).alias(c)
    own = network.select(*(c for c in network.columns if c not in ("edge_id", "from_node", "to_node")), *(named(F.col("mode"), c) for c in ("edge_id", "from_node", "to_node")), F.array("mode").alias("joins"))
    rest = [c for c in links.columns if c not in ("edge_id", "from_node", "to_node", "from_mode", "to_mode")]
    between = links.select(*rest, F.lit("link").alias("mode"), named(F.lit("link"), "edge_id"), named(F.col("from_mode"), "from_node"), named(F.col("to_mode"), "to_node"), F.array("from_mode", "to_mode").alias("joins"))
    return own.unionByName(between, allowMissingColumns=True)


def mode_closures(network: DataFrame) -> DataFrame:
    """scenario_id, edge_id: each mode of a layered network closed as a whole, with the links that lead to it."""
    return network.select(F.explode("joins").alias("scenario_id"), "edge_id")


def modal_failures(scenarios: DataFrame, od: DataFrame, network: DataFrame, mode: str, cost: str = "cost", values: tuple[str, ...] = ("tons",), sums: tuple[str, ...] = ()) -> DataFrame:
    """Flows of one mode, cut by scenarios, rerouted over all modes: the rows of failures() with new_path, the new path's `modes` and `changed`.

    od: origin_id, destination_id (layered nodes of the mode) and values. A
    pair is lost if no_access is 1, and changed if its new path uses another mode.
    """
    paths = shortest_paths(od, network.where(F.col("mode") == mode), cost).where("reachable").checkpoint()
    if sums:
        paths = with_path_sums(paths, network, list(sums), ["origin_id", "destination_id"])
    key = ["scenario_id", "origin_id", "destination_id"]
    failed = failures(scenarios, paths, network, cost, values=values, keep_paths=True, sums=sums).checkpoint()
    steps = failed.select(*key, F.explode("new_path").alias("edge_id")).join(network.select("edge_id", "mode"), "edge_id")
    modes = steps.groupBy(*key).agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    out = failed.join(modes, key, "left").withColumn("modes", F.coalesce("modes", F.array().cast("array<string>")))
    return out.withColumn("changed", F.exists("modes", lambda m: m != mode))


def extra_failures(flagged: DataFrame, near: DataFrame, edges: DataFrame, kind: str, failed: DataFrame) -> DataFrame:
    """Edges flagged as flooded or near reported points, of one class, that have not failed already."""
    both = flagged.select("edge_id").unionByName(near.select("edge_id")).distinct()
    return both.join(edges.where(F.col("road_type") == kind), "edge_id", "left_semi").join(failed, "edge_id", "left_anti")


def speed_range(paths: DataFrame, path: str, speed: str) -> DataFrame:
    """Least and largest speed of the paths that used an edge."""
    return paths.select(F.explode(path).alias("edge_id"), speed).groupBy("edge_id").agg(F.min(speed).alias("min_speed"), F.max(speed).alias("max_speed"))


def nearest_stations(origins: DataFrame, asked: DataFrame, edges: DataFrame, cost: str = "cost") -> DataFrame:
    """Place, destination_id, origin_id, routed_km: of a place's stations (place, origin_id) the nearest other one to each asked (place, destination_id).

    One run from all stations of a place at once finds each node's two nearest
    of them. Beyond MOST_EDGES edges the pairs are routed one by one.
    """
    asked, origins = asked.distinct(), origins.distinct()
    local = Graph.of(edges, cost)
    if local is None:
        near = asked.join(origins, "place").where("origin_id <> destination_id")
        routed = shortest_paths(near.select("origin_id", "destination_id").distinct(), edges, cost).where("reachable").select("origin_id", "destination_id", F.col(cost).alias("routed_km"))
        best = near.join(routed, ["origin_id", "destination_id"]).groupBy("place", "destination_id").agg(F.min(F.struct("routed_km", "origin_id")).alias("o"))
        return best.select("place", "destination_id", "o.origin_id", "o.routed_km")
    graph = origins.sparkSession.sparkContext.broadcast(local)
    stations = origins.join(asked.select("place").distinct(), "place", "left_semi").select("place", F.col("origin_id").alias("node"), F.lit(0).alias("asks"))
    rows = stations.unionByName(asked.select("place", F.col("destination_id").alias("node"), F.lit(1).alias("asks")))
    kind = rows.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, place, own, found = graph.value, None, [], None
        for b in batches:
            out = []
            for p, x, i, asks in zip(b["place"].tolist(), b["node"].tolist(), g.index.find(b["node"].astype(str).tolist()).tolist(), b["asks"].tolist(), strict=True):
                if p != place:
                    place, own, found = p, [], None
                if not asks:
                    if i >= 0:
                        own.append((x, i))
                    continue
                if found is None:
                    found = g.nearest_two([i for _, i in own])
                best = [(c, own[rank][0]) for c, rank in found[i] if own[rank][0] != x] if i >= 0 else []
                if best:
                    out.append((p, x, best[0][1], best[0][0]))
            yield pd.DataFrame(out, columns=["place", "destination_id", "origin_id", "routed_km"])

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = f"place {rows.schema['place'].dataType.simpleString()}, destination_id {kind}, origin_id {kind}, routed_km double"
    return rows.repartition(n, "place").sortWithinPartitions("place", "asks", "node").mapInPandas(run, schema)


def closest_candidates(records: DataFrame, origins: DataFrame, edges: DataFrame, record: str, cost: str = "cost", share: float = 0.2) -> DataFrame:
    """Of all candidate station pairs of each record the one with the shortest path, flagged when it is off the reported km by over `share`.

    records: the record, its place, kms and a destination_id, a row for each
    candidate destination; origins: the candidate stations (place, origin_id).
    """
    nearest = nearest_stations(origins, records.select("place", "destination_id"), edges, cost).select("place", "destination_id", F.struct("routed_km", "origin_id", "destination_id").alias("o"))
    best = records.join(nearest, ["place", "destination_id"]).groupBy(record).agg(F.min_by(F.struct("o.origin_id", "o.destination_id", "o.routed_km", "kms"), "o").alias("b")).select(record, "b.*")
    return best.withColumn("mismatch", F.abs(F.col("routed_km") - F.col("kms")) > share * F.col("kms"))


def last_per_edge(results: DataFrame, order: str) -> DataFrame:
    """Of several result rows of an edge the last in an explicit order, pairs in order."""
    cols = [c for c in results.columns if c != "edge_id"]
    return order_all_pairs(results.groupBy("edge_id").agg(F.max_by(F.struct(*cols), order).alias("r")).select("edge_id", "r.*"))
