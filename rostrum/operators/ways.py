"""Shortest ways in tasks: each holds the whole network as arrays and searches from its share of the sources.

A network fits a task as long as its edges are at most MOST_EDGES; the network goes to each task through a shuffle, never to the
driver. Ways of any number of steps are one pass over arrays, with no job for each few steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.session import ship_package

#: Edges that a task holds, some 50 bytes each.
MOST_EDGES = 4_000_000
#: Places of a table of sources by nodes that a task works on at once, and rows of ways that a task returns.
CELLS = 4_000_000


class Network:
    """Edges between nodes 0 to n - 1, in the order of their starts and of their ends."""

    def __init__(self, u: np.ndarray, v: np.ndarray, cost: np.ndarray, n: int) -> None:
        self.n = n
        order = np.argsort(u, kind="stable")
        self.heads, self.costs = v[order], cost[order]
        self.first = np.searchsorted(u[order], np.arange(n + 1))
        back = np.lexsort((u, v))
        self.u, self.v, self.cost = u[back], v[back], cost[back]

    def spent(self, at: np.ndarray, size: int, goals: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Least sums from where they start at `at`, places source * n + node of `size` sources. With goals (source, place), what
        costs as much as the dearest goal of its source isn't gone on from: only what is nearer is sure to be least."""
        n, out = self.n, np.full(size * self.n, np.inf)
        mark = np.empty(size * n, np.int32)
        out[at] = 0.0
        front = np.unique(at)
        for _ in range(n + 1):
            if goals is not None:
                most = np.full(size, -np.inf)
                np.maximum.at(most, goals[0], out[goals[1]])
                front = front[out[front] < most[front // n]]
            if not len(front):
                return out
            node = front % n
            low = self.first[node]
            many = self.first[node + 1] - low
            rep = np.repeat(np.arange(len(front)), many)
            edge = np.arange(len(rep)) + np.repeat(low - (np.cumsum(many) - many), many)
            to = (front - node)[rep] + self.heads[edge]
            cost = out[front][rep] + self.costs[edge]
            better = cost < out[to]
            to, cost = to[better], cost[better]
            np.minimum.at(out, to, cost)
            mark[to] = np.arange(len(to))
            front = to[mark[to] == np.arange(len(to))]
        raise RuntimeError("shortest: a round trip takes less than no time")

    def previous(self, spent: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The node before each on its shortest way, -1 for starts and what isn't reached: the smallest from which a step that takes
        time ends a shortest way; for what only steps of no time reach, one that is reached."""
        out = np.full(self.n, -1)
        reached = spent[self.u] + self.cost == spent[self.v]
        reached &= np.isfinite(spent[self.v])
        on = np.flatnonzero(reached & (self.cost > 0))
        ends = self.v[on]
        on = on[np.append(True, ends[1:] != ends[:-1])] if len(on) else on
        out[self.v[on]] = self.u[on]
        out[starts] = -1
        known = out >= 0
        known[starts] = True
        flat = np.flatnonzero(reached & (self.cost == 0))
        while len(flat):
            flat = flat[~known[self.v[flat]]]
            now = flat[known[self.u[flat]]]
            if not len(now):
                break
            ends = self.v[now]
            now = now[np.append(True, ends[1:] != ends[:-1])]
            out[self.v[now]] = self.u[now]
            known[self.v[now]] = True
        return out

    @staticmethod
    def gathered(previous: np.ndarray, amount: np.ndarray) -> np.ndarray:
        """What passes each node: its own amount and that of all whose way passes it, passed on by 1, 2, 4, ... steps."""
        out, jump = amount.copy(), previous
        while True:
            on = np.flatnonzero((out != 0) & (jump >= 0))
            if not len(on):
                return out
            np.add.at(out, jump[on], out[on])
            jump = np.where(jump >= 0, jump[jump], -1)


def read_network(edges: pa.Table, *nodes: pa.ChunkedArray) -> tuple[Network, pa.Array, list[np.ndarray]]:
    """The network of (u, v, minutes), its nodes in their order, and the places of `nodes` among them."""
    parts = [edges["u"], edges["v"], *nodes]
    every = pa.chunked_array([c for p in parts for c in p.chunks], parts[0].type).unique()
    names = every.take(pc.sort_indices(every))
    place = lambda c: pc.index_in(c, value_set=names).to_numpy().astype(np.int64)
    return Network(place(parts[0]), place(parts[1]), edges["minutes"].to_numpy(), len(names)), names, [place(p) for p in nodes]


def sound(edges: DataFrame, *nodes: DataFrame) -> DataFrame:
    """(u, v, minutes) of the edges that lead somewhere, each pair of nodes once, the nodes of a type that those of `nodes` fit too."""
    every = edges.select("u")
    for n in (edges.select("v"), *nodes):
        every = every.union(n)
    kind = every.schema["u"].dataType
    own = edges.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"), F.col("minutes").cast("double").alias("minutes"))
    return own.where("u is not null and v is not null and minutes is not null and not isnan(minutes)").groupBy("u", "v").agg(F.min("minutes").alias("minutes"))


def held(edges: DataFrame) -> int:
    """At least as many as the nodes that the edges lead to, if a task can hold the edges; 0 if not."""
    n, to = edges.agg(F.count(F.lit(1)), F.countDistinct("v")).first()
    return to + 1 if n <= MOST_EDGES else 0


def dealt(sources: DataFrame, edges: DataFrame, by: str, parts: int):
    """sources, dealt by a hash of `by` to as many tasks as parts, each grouped with all edges."""
    spark = sources.sparkSession
    ship_package(spark)
    tries = spark.range(parts * 24).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p"))
    names = [r.id for r in tries.groupBy("p").agg(F.min("id").alias("id")).collect()]  # numbers that go to different tasks
    spread = F.array(*[F.lit(k).cast("long") for k in sorted(names)])
    own = sources.withColumn("_part", F.element_at(spread, (F.pmod(F.xxhash64(by), F.lit(len(names))) + 1).cast("int"))).repartition(parts, "_part")
    copies = edges.withColumn("_part", F.explode(spread)).repartition(parts, "_part")
    return own.groupBy("_part").cogroup(copies.groupBy("_part"))


def tasks(sources: DataFrame, by: str, nodes: int) -> int:
    """Tasks for sources: two for each core, and more where ways to all nodes would be too many for a task."""
    n = sources.agg(F.countDistinct(by)).first()[0]
    return max(1, min(n, max(2 * sources.sparkSession.sparkContext.defaultParallelism, -(-n * nodes // CELLS))))


def batches(of: np.ndarray, n: int):
    """(which rows, number of each row's source in the batch, sources) of as many sources as CELLS allow at once; rows are sorted by `of`."""
    size = max(1, CELLS // n)
    every = of[-1] + 1 if len(of) else 0
    for low in range(0, every, size):
        rows = np.arange(*np.searchsorted(of, [low, low + size]))
        yield rows, of[rows] - low, range(low, min(low + size, every))


def all_ways(edges: DataFrame, sources: DataFrame, nodes: int) -> DataFrame:
    """(source, node, minutes, previous) from sources (source, node)."""
    kinds = sources.schema

    def search(own: pa.Table, network: pa.Table) -> pa.Table:
        net, names, (at,) = read_network(network, own["node"])
        labels = own["source"].combine_chunks().dictionary_encode()
        of = labels.indices.to_numpy()
        order = np.argsort(of, kind="stable")
        of, at = of[order], at[order]
        out = [[labels.dictionary[:0], names[:0], pa.array([], pa.float64()), names[:0]]]
        for rows, local, few in batches(of, net.n):
            spent = net.spent(local * net.n + at[rows], len(few))
            for i, k in enumerate(few):
                one = spent[i * net.n : (i + 1) * net.n]
                there = np.flatnonzero(np.isfinite(one))
                before = net.previous(one, at[rows][local == i])[there]
                out.append([labels.dictionary.take(pa.array(np.full(len(there), k))), names.take(pa.array(there)), pa.array(one[there]), names.take(pa.array(before, mask=before < 0))])
        columns = [pa.chunked_array(c) for c in zip(*out, strict=True)]
        return pa.table(dict(zip(("source", "node", "minutes", "previous"), columns, strict=True)))

    source, node = kinds["source"].dataType.simpleString(), kinds["node"].dataType.simpleString()
    return dealt(sources, edges, "source", tasks(sources, "source", nodes)).applyInArrow(search, f"source {source}, node {node}, minutes double, previous {node}")


def all_loads(edges: DataFrame, loads: DataFrame) -> DataFrame:
    """(u, v, amount): what loads (source, node, amount) put on the steps of the shortest ways from source to node, of all sources
    together. The search from a source ends at its farthest node; what can't be reached puts nothing on any step."""
    node = loads.schema["node"].dataType.simpleString()

    def carry(own: pa.Table, network: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"u": network["u"][:0], "v": network["v"][:0], "amount": pa.array([], pa.float64())})
        net, names, (start, to) = read_network(network, own["source"], own["node"])
        order = np.argsort(start, kind="stable")
        start, to, amount = start[order], to[order], own["amount"].to_numpy()[order]
        first = np.append(True, start[1:] != start[:-1])
        of = np.cumsum(first) - 1
        starts = start[first]
        steps, sums = np.empty(0, np.int64), np.empty(0)
        for rows, local, few in batches(of, net.n):
            places = local * net.n + to[rows]
            spent = net.spent(np.arange(len(few)) * net.n + starts[few.start : few.stop], len(few), (local, places))
            for i, k in enumerate(few):
                one = spent[i * net.n : (i + 1) * net.n]
                mine = rows[local == i]
                put = np.bincount(to[mine], weights=amount[mine], minlength=net.n).astype(float)
                put[~np.isfinite(one)] = 0.0
                before = net.previous(one, starts[k : k + 1])
                passed = net.gathered(before, put)
                on = np.flatnonzero((passed != 0) & (before >= 0))
                steps, sums = np.append(steps, before[on] * net.n + on), np.append(sums, passed[on])
            steps, at = np.unique(steps, return_inverse=True)
            sums = np.bincount(at, weights=sums, minlength=len(steps)).astype(float)  # of nothing it has whole numbers
        return pa.table({"u": names.take(pa.array(steps // net.n)), "v": names.take(pa.array(steps % net.n)), "amount": pa.array(sums)})

    parts = dealt(loads, edges, "source", tasks(loads, "source", 1)).applyInArrow(carry, f"u {node}, v {node}, amount double")
    return parts.groupBy("u", "v").agg(F.sum("amount").alias("amount"))


def all_roots(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b) that one task holds: the smallest node connected with each."""

    def join(held: pa.Table) -> pa.Table:
        every = pa.chunked_array([*held["a"].chunks, *held["b"].chunks], held.schema.field("a").type).unique()
        names = every.take(pc.sort_indices(every))
        a, b = (pc.index_in(held[c], value_set=names).to_numpy().astype(np.int64) for c in "ab")
        root = np.arange(len(names))
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            apart = low != high
            if not apart.any():
                return pa.table({"node": names, "root": names.take(pa.array(root))})
            np.minimum.at(root, high[apart], low[apart])
            while (up := root[root]).tobytes() != root.tobytes():
                root = up

    kind = links.schema["a"].dataType.simpleString()
    ship_package(links.sparkSession)
    return links.groupBy(F.lit(0).alias("_all")).applyInArrow(join, f"node {kind}, root {kind}")
