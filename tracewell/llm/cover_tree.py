"""Exact cosine-threshold links inside groups of vectors by dual traversal of cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import components
from tracewell.session import materialize

COSINE = 0.93
CELL = 2048  # vectors of a cell from which on it is split
FANOUT = 32  # parts of a split at most, about; small cells are split into few
TOP_RADIUS = 1.0  # of the topmost level in a task; each further level halves it
LAST_RADIUS = 1 / 64
_SLACK = 1e-9


@dataclass
class Node:
    """A ball around one of its members that holds all of them."""

    centre: int
    members: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def net(x: np.ndarray, index: np.ndarray, radius: float) -> list[Node]:
    """Centres further apart than ``radius`` that cover all members within it, first come first."""
    least = 1 - radius * radius / 2  # cosine at that distance
    points = x[index]
    free = np.ones(len(index), dtype=bool)
    found = []
    for a in range(0, len(index), 512):
        dots = points[a : a + 512] @ points.T
        for i in range(a, min(a + 512, len(index))):
            if free[i]:
                row = dots[i - a]
                inside = np.flatnonzero(free & (row >= least))
                if not len(inside) or inside[0] != i:
                    inside = np.union1d(inside, [i])
                free[inside] = False
                far = math.sqrt(max(0.0, 2 - 2 * float(row[inside].min()))) if len(inside) > 1 else 0.0
                found.append(Node(int(index[i]), index[inside], far))
    return found


def cover_tree(x: np.ndarray) -> list[Node]:
    """Topmost nodes of the tree over unit vectors; levels below have half the radius each."""
    top = net(x, np.arange(len(x)), TOP_RADIUS)
    todo = [(n, TOP_RADIUS / 2) for n in top]
    while todo:
        node, radius = todo.pop()
        while radius >= LAST_RADIUS and radius >= node.radius > 0:
            radius /= 2  # the level would have this node alone
        if len(node.members) > 8 and radius >= LAST_RADIUS:
            node.children = net(x, node.members, radius)
            todo += [(n, radius / 2) for n in node.children]
    return top


class Links:
    """Counts of links per vector and a forest that connects linked vectors."""

    def __init__(self, weights: np.ndarray, cosine: float):
        self.weights, self.cosine = weights, cosine
        self.reach = math.sqrt(2 - 2 * cosine)
        self.count = np.zeros(len(weights), dtype=np.int64)
        self.up = np.arange(len(weights))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def connect(self, some) -> None:
        first = self.root(int(some[0]))
        for i in some[1:]:
            self.up[self.root(int(i))] = first

    def all_within(self, members: np.ndarray) -> None:
        self.count[members] += self.weights[members].sum() - self.weights[members]
        self.connect(members)

    def all_between(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count[a] += self.weights[b].sum()
        self.count[b] += self.weights[a].sum()
        self.connect(np.concatenate((a, b)))

    def pairs(self, i: np.ndarray, j: np.ndarray) -> None:
        np.add.at(self.count, i, self.weights[j])
        np.add.at(self.count, j, self.weights[i])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            self.up[self.root(a)] = self.root(b)


def within(x: np.ndarray, node: Node, links: Links) -> None:
    """All links between members of one node."""
    todo = [node]
    while todo:
        node = todo.pop()
        if len(node.members) < 2:
            continue
        if 2 * node.radius <= links.reach - _SLACK:
            links.all_within(node.members)
        elif not node.children:
            i, j = np.triu_indices(len(node.members), 1)
            near = (x[node.members] @ x[node.members].T)[i, j] >= links.cosine
            links.pairs(node.members[i[near]], node.members[j[near]])
        else:
            todo += node.children
            between(x, node.children, node.children, links, True)


def between(x: np.ndarray, a: list[Node], b: list[Node], links: Links, same: bool = False) -> None:
    """All links between members of nodes in ``a`` and in ``b``; of one list, each two nodes once.

    Pairs of nodes too far apart for their radii are pruned, pairs close enough with
    their radii are linked whole, others go down on the side with the larger radius.
    """
    todo = [(a, b, same)]
    while todo:
        a, b, same = todo.pop()
        radius_b = np.array([n.radius for n in b])
        points_b = x[[n.centre for n in b]]
        single_b = np.array([len(n.members) == 1 for n in b])
        for s in range(0, len(a), 512):
            part = a[s : s + 512]
            radius = np.array([n.radius for n in part])[:, None] + radius_b
            dots = x[[n.centre for n in part]] @ points_b.T
            lone = np.array([len(n.members) == 1 for n in part])[:, None] & single_b
            apart = np.sqrt(np.maximum(0.0, 2 - 2 * dots))
            near = np.where(lone, dots >= links.cosine, apart <= links.reach + radius + _SLACK)
            if same:
                near &= np.arange(s, s + len(part))[:, None] < np.arange(len(b))
            i, j = np.nonzero(near)
            single = lone[i, j]
            links.pairs(
                np.array([part[k].centre for k in i[single]], dtype=int), np.array([b[k].centre for k in j[single]], dtype=int)
            )
            for p, q in zip(i[~single].tolist(), j[~single].tolist(), strict=True):
                m, n = part[p], b[q]
                if apart[p, q] + radius[p, q] <= links.reach - _SLACK:
                    links.all_between(m.members, n.members)
                elif m.children and (m.radius >= n.radius or not n.children):
                    todo.append((m.children, [n], False))
                elif n.children:
                    todo.append(([m], n.children, False))
                else:
                    u, v = np.nonzero(x[m.members] @ x[n.members].T >= links.cosine)
                    links.pairs(m.members[u], n.members[v])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, cell, unit): the vector as a unit vector of doubles; no node if it has no direction."""
    for batch in batches:
        lists = batch.column(3)
        flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.fill_null(pc.list_value_length(lists), 0))
        units, nodes = [], []
        for start, end, node in zip([0, *ends[:-1].tolist()], ends.tolist(), batch.column(1).to_pylist(), strict=True):
            v = flat[start:end]
            largest = np.abs(v).max() if len(v) else 0.0
            good = node is not None and np.isfinite(largest) and largest > 0  # a null is NaN here, and so is its maximum
            if good:
                v = v / largest  # squares can neither overflow nor vanish
                v = v / np.sqrt(v @ v)
            units.append(v if good else None)
            nodes.append(node if good else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(nodes, pa.int64()), batch.column(2), pa.array(units, pa.list_(pa.float64()))],
            names=["key", "node", "cell", "unit"],
        )


def _split(nodes: DataFrame, big: DataFrame, level: int) -> DataFrame:
    """Deal the vectors of big cells to the nearest of some of their vectors, chosen by hash.

    Its first and last vector by id are always among them, and vectors as near to several
    are dealt out evenly, so every split makes cells smaller.  A cell is worked on in shares of about CELL vectors, each of which gets the centres.
    """
    members = nodes.join(big.select("cell", "n", "least", "most"), "cell")
    # every vector goes along with each cell that its own is paired with, so no more parts than needed
    parts = F.least(F.lit(FANOUT), 2 * F.ceil(F.col("n") / CELL))
    turn = F.pmod(F.xxhash64("node", F.lit(level)), F.greatest(F.col("n") / parts, F.lit(1)).cast("bigint"))
    centres = members.where((turn == 0) | F.col("node").isin(F.col("least"), F.col("most"))).select(
        # new names, since both sides of the cogroup come from the same rows
        F.col("cell").alias("cell"), F.col("node").alias("c"), F.col("unit").alias("unit")
    )
    shares = big.select("cell", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / CELL).cast("int"))).alias("share"))
    dealt = members.withColumn(
        "share", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CELL).cast("int") + 1).cast("int")
    ).drop("n", "least", "most")

    def nearest(vectors: pa.Table, pivots: pa.Table) -> pa.Table:
        if not len(vectors):
            return pa.table({k: pa.array([], t) for k, t in
                             (("node", pa.int64()), ("parent", pa.int64()), ("pivot", pa.int64()), ("distance", pa.float64()))})
        x = np.array(vectors["unit"].to_pylist())
        c = np.array(pivots["unit"].to_pylist())
        ids = pivots["c"].to_numpy()
        order = np.argsort(ids)
        dots = x @ c[order].T
        near = dots >= dots.max(axis=1, keepdims=True) - 1e-12
        place = vectors["node"].to_numpy().view(np.uint64) % near.sum(axis=1).astype(np.uint64)
        best = (near.cumsum(axis=1) > place.astype(np.int64)[:, None]).argmax(axis=1)
        far = np.sqrt(np.maximum(0.0, 2 - 2 * dots[np.arange(len(x)), best])) + _SLACK
        return pa.table({"node": vectors["node"], "parent": vectors["cell"], "pivot": ids[order][best], "distance": far})

    return (
        dealt.groupBy("cell", "share")
        .cogroup(centres.join(shares, "cell").groupBy("cell", "share"))
        .applyInArrow(nearest, "node bigint, parent bigint, pivot bigint, distance double")
        .withColumn("cell", F.xxhash64("parent", "pivot"))
    )


def cells_of(nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(node, unit, weight, cell) with cells of bounded size, and the pairs (a, b) of cells that may hold links.

    Big cells are split level by level.  After each level, pairs of the new cells come
    from pairs of their parents, and stay unless their centres are further apart than
    the reach and both covering radii.
    """
    size = lambda df: df.groupBy("cell").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"))
    cells = materialize(size(nodes), "cover-sizes")
    pairs = cells.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    level = 0
    while (big := cells.where(F.col("n") > CELL)).take(1):
        level += 1
        moved = materialize(_split(nodes, big, level), "cover-split")
        balls = moved.groupBy("parent", "cell", "pivot").agg(F.max("distance").alias("radius"))
        centre = nodes.select(F.col("node").alias("pivot"), "unit")
        balls = materialize(balls.join(centre, "pivot").select("parent", "cell", "radius", "unit"), "cover-balls")
        kept = cells.where(F.col("n") <= CELL).select(
            F.col("cell").alias("parent"), "cell", F.lit(None).cast("double").alias("radius"),
            F.lit(None).cast("array<double>").alias("unit"),
        )
        below = balls.unionByName(kept)
        side = lambda x: below.select(*(F.col(c).alias(f"{c}_{x}") for c in below.columns))  # noqa: E731,B023
        dot = F.aggregate(F.zip_with("unit_a", "unit_b", lambda p, q: p * q), F.lit(0.0), lambda acc, e: acc + e)
        apart = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot))
        near = F.coalesce(apart <= math.sqrt(2 - 2 * cosine) + F.col("radius_a") + F.col("radius_b") + _SLACK, F.lit(True))
        deeper = pairs.join(side("a"), F.col("a") == F.col("parent_a")).join(side("b"), F.col("b") == F.col("parent_b"))
        # of a cell with itself, its parts meet once; ids order them
        once = (F.col("a") != F.col("b")) | (F.col("cell_a") <= F.col("cell_b"))
        pairs = materialize(
            deeper.where(once & ((F.col("cell_a") == F.col("cell_b")) | near)).select(
                F.col("cell_a").alias("a"), F.col("cell_b").alias("b")
            ), "cover-pairs",
        )
        nodes = materialize(
            nodes.join(moved.select("node", F.col("cell").alias("to")), "node", "left")
            .select("node", "unit", "weight", F.coalesce("to", "cell").alias("cell")), "cover-nodes",
        )
        cells = materialize(size(nodes), "cover-sizes")
    return nodes, pairs


def _cell_links(nodes: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """(node, links, peer): per pair of cells, the weight of what a node links with and a node it is connected to."""
    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("cell"))
    dealt = nodes.join(sides, "cell").select("a", "b", "cell", "node", "weight", "unit")
    schema = "node bigint, links bigint, peer bigint"
    arrow = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("peer", pa.int64())])

    def search(t: pa.Table) -> pa.Table:
        ids, cell = t["node"].to_numpy(), t["cell"].to_numpy()
        flat = t["unit"].combine_chunks().flatten().to_numpy()
        x = flat.reshape(len(ids), -1)
        links = Links(t["weight"].to_numpy().astype(np.int64), cosine)
        first = np.flatnonzero(cell == t["a"][0].as_py())
        trees = []
        for own in (first, np.flatnonzero(cell != t["a"][0].as_py())):
            tree = cover_tree(x[own])
            todo = list(tree)
            while todo:  # numbers in the table instead of numbers in the cell
                n = todo.pop()
                n.centre, n.members = int(own[n.centre]), own[n.members]
                todo += n.children
            trees.append(tree)
        if len(first) == len(ids):
            for n in trees[0]:
                within(x, n, links)
            between(x, trees[0], trees[0], links, True)
        else:
            between(x, trees[0], trees[1], links)
        hit = np.flatnonzero(links.count)
        peers = [ids[links.root(int(i))] for i in hit]
        return pa.Table.from_arrays(
            [pa.array(ids[hit]), pa.array(links.count[hit]), pa.array(peers, pa.int64())], schema=arrow
        )

    return dealt.groupBy("a", "b").applyInArrow(search, schema)


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", group: str = "label", cosine: float = COSINE
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row; links join vectors of one group with that cosine or more.

    Equal vectors of a group are one node with a weight.  Groups beyond CELL vectors are
    split into cells by nested centres; pairs of cells that their covering radii keep
    apart are pruned.  Each remaining pair of cells is a group of bounded size in which
    two cover trees are traversed together.  Counts add up weights, components come from
    a forest per pair; pairs of vectors are never listed outside a task.

    * null group; null, empty or zero vector; null, NaN or infinite component: no links.
    * vectors of one group with different lengths are not compared.
    * ties: a cosine of exactly ``cosine`` links.  Repeated rows count as vectors of their own.
    * null keys: never the smallest; kept is false.  An empty table stays empty.
    """
    if not 0.5 <= cosine < 1:
        raise ValueError("the cosine must be from 0.5 to below 1")
    raw = vectors.select(
        F.col(key).alias("key"), F.when(F.col(group).isNotNull(), F.xxhash64(group, vector)).alias("node"),
        F.xxhash64(group, F.size(vector)).alias("cell"), F.col(vector).cast("array<double>").alias("raw"),
    )
    schema = f"key {dict(raw.dtypes)['key']}, node bigint, cell bigint, unit array<double>"
    rows = materialize(raw.mapInArrow(_units, schema), "cover-rows")
    nodes = materialize(
        rows.where("node is not null").groupBy("node").agg(
            F.first("unit").alias("unit"), F.count("*").alias("weight"), F.first("cell").alias("cell"), F.min("key").alias("least")
        ), "cover-nodes",
    )
    placed, pairs = cells_of(nodes.select("node", "unit", "weight", "cell"), cosine)
    found = materialize(_cell_links(placed, pairs, cosine), "cover-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = components(found.select("node", "peer"), "node", "peer", "cover-components")
    whole = whole.join(nodes.select("node", "least"), "node")
    best = whole.groupBy("root").agg(F.min("least").alias("best"))
    whole = whole.join(best, "root").select("node", "best")
    told = (
        nodes.select("node", "weight", "least").join(counts, "node", "left").join(whole, "node", "left")
        .select(F.col("node").alias("node_"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("best", "least").alias("best"))
    )
    component = F.coalesce("best", "key")
    return rows.select("key", "node").join(told, F.col("node") == F.col("node_"), "left").select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )
