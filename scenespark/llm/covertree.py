"""Embedding near-duplicates by dual traversal of cover trees.

A tree has nested levels with halving radii: a node's points lie within its radius, the
centres of its children are points of its own, further apart than their radius, and the
first is the node's own centre. Levels end where a ball lies wholly within the threshold, or
where points are so sparse that most of them would be centres. An upper tree is grown on a bounded sample;
every vector goes down it to the deepest ball that holds it, and what a ball holds is dealt
into blocks of bounded size. Pairs of nodes, then of blocks, and within a pair of blocks
those of the blocks' own trees are traversed together: a pair is pruned when its centres are further apart
than the threshold and both covering radii, counted whole when centres and radii are within the
threshold, and compared vector by vector only between leaves. Links are counted per vector and
reduced to spanning links where they are found: no list of all pairs is ever made. Copies of a
vector are one point with a weight.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_row, checkpoint, connected_components, labels_of, stored

#: Vectors in a block, about; two blocks meet in one task.
BLOCK = 32_768
#: Vectors that the upper tree is built on.
SAMPLE = 4096
#: A set of no more points than this is a leaf; so many points show how dense a set is.
LEAF, PROBE = 64, 256


@dataclass
class Node:
    center: np.ndarray
    radius: float
    points: np.ndarray
    children: list[int] = field(default_factory=list)
    #: Of its points those that are in no child.
    own: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def away(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between unit vectors, a row for each of x."""
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def separated(x: np.ndarray, r: float) -> list[int]:
    """Points further apart than r, the first among them, that have all others within r."""
    d = away(x, x)
    open_, out = np.ones(len(x), bool), []
    while open_.any():
        k = int(open_.argmax())
        out.append(k)
        open_ &= d[k] > r
        open_[k] = False
    return out


def grow(x: np.ndarray, far: float, least: int = 1) -> list[Node]:
    """A cover tree of unit vectors, the root first; sets of fewer than ``least`` points stay in their parent."""
    every = np.arange(len(x))
    nodes = [Node(x[0] if len(x) else np.zeros(0), 2.0, every, own=every)]
    todo = [0] if len(x) else []
    while todo:
        k = todo.pop()
        node, r = nodes[k], nodes[k].radius / 2
        if r < far / 4 or len(node.points) <= LEAF:
            continue
        rest, small, first = node.points, [], True
        while len(rest) > (0 if first else LEAF):
            probe = rest[np.linspace(0, len(rest) - 1, min(PROBE, len(rest))).astype(int)]
            some = np.concatenate([node.center[None], x[probe]]) if first else x[probe]
            net = separated(some, r)
            if 2 * len(net) > len(some):
                break
            first = False
            d = away(x[rest], some[net])
            near, least_d = d.argmin(1), d.min(1)
            for j, c in enumerate(net):
                inside = rest[(near == j) & (least_d <= r)]
                if len(inside) >= least:
                    node.children.append(len(nodes))
                    todo.append(len(nodes))
                    nodes.append(Node(some[c], r, inside, own=inside))
                else:
                    small.append(inside)
            rest = rest[least_d > r]
        if node.children:
            node.own = np.concatenate([rest, *small])
    return nodes


def descend(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    """For each vector the deepest node, by nearest child that covers it, that holds it."""
    at = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, rows = todo.pop()
        if nodes[k].children and len(rows):
            d = np.stack([np.linalg.norm(x[rows] - nodes[c].center, axis=1) for c in nodes[k].children])
            near = d.argmin(0)
            for j, c in enumerate(nodes[k].children):
                into = rows[(near == j) & (d.min(0) <= nodes[c].radius)]
                at[into] = c
                todo.append((c, into))
    return at


def node_pairs(nodes: list[Node], reach: dict[int, float], far: float) -> list[tuple[int, int, float]]:
    """Dual traversal: pairs of nodes with vectors of their own that the covering radii do not prune.

    ``reach`` is the largest distance of a node's own vectors from its centre.
    """
    below: dict[int, float] = {}

    def cover(k: int) -> float:
        below[k] = max([reach.get(k, 0.0), *(float(np.linalg.norm(nodes[k].center - nodes[c].center)) + cover(c) for c in nodes[k].children)])
        return below[k]

    cover(0)
    out, todo, seen = [], [(0, 0)], {(0, 0)}
    while todo:
        a, b = todo.pop()
        d = float(np.linalg.norm(nodes[a].center - nodes[b].center))
        if d - below[a] - below[b] > far:
            continue
        if a in reach and b in reach and d - reach[a] - reach[b] <= far:
            out.append((a, b, d))
        for pair in [(min(a, c), max(a, c)) for c in nodes[b].children] + [(min(b, c), max(b, c)) for c in nodes[a].children]:
            if pair not in seen:
                seen.add(pair)
                todo.append(pair)
    return out


def flat(x: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, list[list[int]], list[np.ndarray]]:
    """Centres, covering radii, children and points of a tree in which all points are in leaves."""
    nodes = list(nodes)
    children = [list(n.children) for n in nodes]
    for k in range(len(nodes)):
        if nodes[k].children and len(nodes[k].own):
            children[k].append(len(nodes))
            children.append([])
            nodes.append(Node(nodes[k].center, nodes[k].radius, nodes[k].own))
    centers = np.array([n.center for n in nodes])
    cover = np.array([np.linalg.norm(x[n.points] - n.center, axis=1).max(initial=0.0) for n in nodes])
    return centers, cover, children, [n.points for n in nodes]


def traverse(a: tuple, b: tuple, same: bool, far: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of leaves to compare, and pairs of nodes all of whose points are within the threshold."""
    (ca, ra, da, _), (cb, rb, db, _) = a, b
    leaves, whole, front = [], [], [(0, 0)]
    while front:
        i, j = np.array(front).T
        d = np.linalg.norm(ca[i] - cb[j], axis=1)
        reach = ra[i] + rb[j]
        near, sure = d - reach <= far, d + reach <= far * (1 - 1e-6)
        front = []
        for k in np.flatnonzero(near):
            p, q = int(i[k]), int(j[k])
            if sure[k]:
                whole.append((p, q))
            elif not da[p] and not db[q]:
                leaves.append((p, q))
            elif same and p == q:
                front += [(c, e) for n, c in enumerate(da[p]) for e in da[p][n:]]
            elif da[p] and (not db[q] or ra[p] >= rb[q]):
                front += [(c, q) for c in da[p]]
            else:
                front += [(p, c) for c in db[q]]
    return leaves, whole


def vectors_of(raw: pd.Series, kind: str) -> np.ndarray:
    """Unit vectors in double precision of vectors as bytes."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # lest squares overflow or vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def compare(a: pd.DataFrame, b: pd.DataFrame, same: bool, at_least: float, far: float, kind: str = "<f8", tile: int = 256, told: list | None = None) -> pd.DataFrame:
    """Rows (key, n, other): weights linked to a point, and a point of its component here, or null.

    ``told`` gets the number of pairs that were compared vector by vector.
    """
    x = vectors_of(a["raw"], kind)
    y = x if same else vectors_of(b["raw"], kind)
    keys = a["key"].to_numpy() if same else np.concatenate([a["key"].to_numpy(), b["key"].to_numpy()])
    weight = a["weight"].to_numpy() if same else np.concatenate([a["weight"].to_numpy(), b["weight"].to_numpy()])
    shift = 0 if same else len(x)
    n, us, vs, compared = np.zeros(len(keys), np.int64), [], [], 0
    one = flat(x, grow(x, far))
    two = one if same else flat(y, grow(y, far))
    leaves, whole = traverse(one, two, same, far)
    for p, q in whole:
        left, right = one[3][p], two[3][q] + shift
        n[left] += weight[right].sum()
        if same and p == q:
            n[left] -= weight[left]
        else:
            n[right] += weight[left].sum()
        ends = np.concatenate([left, right])
        us.append(ends)
        vs.append(np.full(len(ends), ends[0]))
    for p, q in leaves:
        left, right = one[3][p], two[3][q]
        z = y[right].T
        compared += len(left) * len(right)
        for k in range(0, len(left), tile):
            i, j = np.nonzero(x[left[k : k + tile]] @ z >= at_least)
            i, j = left[i + k], right[j] + shift
            if same and p == q:
                i, j = i[i != j], j[i != j]
                np.add.at(n, i, weight[j])
            else:
                np.add.at(n, i, weight[j])
                np.add.at(n, j, weight[i])
            if len(i):
                ends, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                u, v = np.split(at, 2)
                us.append(ends)
                vs.append(ends[labels_of(len(ends), u, v)])
    if told is not None:
        told.append(compared)
    if not us:
        return pd.DataFrame({"key": keys[:0], "n": n[:0], "other": keys[:0]})
    lab = labels_of(len(keys), np.concatenate(us), np.concatenate(vs))
    linked = n > 0
    return pd.DataFrame({"key": keys[linked], "n": n[linked], "other": keys[lab[linked]]})


def near_dups(vectors: DataFrame, at_least: float = 0.9, id_col: str = "vec_id", vector: str = "embedding", block: int = BLOCK, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept (the id is its component's).

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing; so do vectors of different length. Repeated rows are vectors of their own, linked to each
    other. A null id keeps its row, counts for others, and is never kept or a component's id,
    which is null if all of its ids are. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    kind = "<f4" if single else "<f8"

    def raws(cols):
        out = []
        for v in cols[1]:
            x = np.array([np.nan] if v is None or None in v else v, kind)
            out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
        return {id_col: cols[0], "raw": out}

    rows = stored(by_row(vectors, [F.col(id_col).cast("long").alias(id_col), F.col(vector).cast("array<float>" if single else "array<double>").alias("v")], f"{id_col} long, raw binary", raws))
    points = rows.where("raw is not null").groupBy("raw").agg(F.count(F.lit(1)).alias("weight"), F.min(id_col).alias("low"))
    points = stored(points.withColumn("key", F.monotonically_increasing_id()).withColumn("dims", F.expr(f"cast(octet_length(raw) div {np.dtype(kind).itemsize} as long)")))
    # The upper tree is built on a bounded sample; the length that most of it has is indexed by
    # it, other lengths by trees of their own.
    edges, counts = [], []
    for dims in [int(r["dims"]) for r in points.groupBy("dims").count().orderBy(F.desc("count")).collect()]:
        found = linked(points.where(F.col("dims") == dims), dims, at_least, block, sample, seed, kind)
        edges.append(found.where("other is not null and other <> key").select("key", "other"))
        counts.append(found.select("key", "n"))
    if not counts:
        nothing = spark.createDataFrame([], "key long, n long, other long")
        edges, counts = [nothing.select("key", "other")], [nothing.select("key", "n")]
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    total = union(counts).groupBy("key").agg(F.sum("n").alias("n"))
    parts = connected_components(union(edges), "key", "other").withColumnRenamed("node", "key")
    known = checkpoint(points.join(parts, "key", "left").withColumn("component", F.coalesce("component", "key")).join(total, "key", "left").select("raw", "component", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    named = known.join(lowest, "component").select("raw", "n_links", "component_id")
    out = rows.where("raw is not null").join(named, "raw").select(id_col, "n_links", "component_id")
    alone = rows.where("raw is null").select(id_col, F.lit(0).cast("long").alias("n_links"), F.col(id_col).alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def linked(points: DataFrame, dims: int, at_least: float, block: int, sample: int, seed: int, kind: str = "<f8") -> DataFrame:
    """(key, n, other) as compare gives, of all block pairs, for points of one length."""
    spark = points.sparkSession
    far = float(np.sqrt(max(0.0, 2 - 2 * at_least))) * (1 + 1e-9) + 1e-12
    count = points.count()
    picked = points.orderBy(F.xxhash64(F.lit(seed), "raw"), "raw").limit(sample).select("raw").collect()
    tree = grow(vectors_of([r["raw"] for r in picked], kind), far, max(8, min(len(picked) // 64, -(-block * len(picked) // max(count, 1)))))
    for node in tree:  # the points were the sample's; every vector is placed anew
        node.points = node.own = None
    shared = spark.sparkContext.broadcast(tree)

    def place(cols):
        x = vectors_of(cols[1], kind)
        at = descend(shared.value, x)
        off = np.linalg.norm(x - np.array([shared.value[k].center for k in at]).reshape(-1, dims), axis=1)
        return {"key": cols[0], "raw": cols[1], "weight": cols[2], "node": at, "away": off}

    placed = by_row(points, ["key", "raw", "weight"], "key long, raw binary, weight long, node long, away double", place, chunk=4096)
    sizes = F.broadcast(placed.groupBy("node").agg(F.count(F.lit(1)).alias("held")))  # a row for each node of the upper tree
    dealt = F.pmod(F.xxhash64(F.lit(seed), "key"), F.ceil(F.col("held") / block))
    placed = stored(placed.join(sizes, "node").select("key", "raw", "weight", "away", F.struct("node", dealt.alias("deal")).alias("block")))
    blocks = checkpoint(placed.groupBy("block").agg(F.max("away").alias("reach"), F.sum("weight").alias("weight"), F.min("key").alias("first")))
    own = {r["node"]: r for r in blocks.groupBy("block.node").agg(F.max("reach").alias("reach"), F.sum("weight").alias("weight"), F.min("first").alias("first")).collect()}
    near, whole = [], {}
    for a, b, d in node_pairs(tree, {k: r["reach"] for k, r in own.items()}, far):
        if d + own[a]["reach"] + own[b]["reach"] <= far * (1 - 1e-6):
            for x, y in {(a, b), (b, a)}:
                whole.setdefault(x, []).append(y)
        else:
            near.append((a, b, d))
    pairs_of = spark.createDataFrame(near, "na long, nb long, d double")
    one = blocks.select(F.col("block.node").alias("na"), F.col("block").alias("a"), F.col("reach").alias("ra"))
    two = blocks.select(F.col("block.node").alias("nb"), F.col("block").alias("b"), F.col("reach").alias("rb"))
    rest = pairs_of.join(one, "na").join(two, "nb").where("(na <> nb or a <= b) and d - ra - rb <= " + repr(far))
    rest = checkpoint(rest.select("a", "b").withColumn("pair", F.monotonically_increasing_id()))
    left = placed.join(rest.select("pair", F.col("a").alias("block"), (F.col("a") == F.col("b")).alias("same")), "block").select("pair", "key", "raw", "weight", "same")
    right = placed.join(rest.where("a <> b").select("pair", F.col("b").alias("block")), "block").select(*[F.col(c).alias(c) for c in ("pair", "key", "raw", "weight")])

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        return compare(one, two, bool(one["same"].iloc[0]), at_least, far, kind)

    found = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInPandas(meet, "key long, n long, other long")
    if whole:
        # Nodes within reach as a whole: every vector of one links with all of the other.
        sides = [(k, sum(own[j]["weight"] for j in others), k in others, [own[j]["first"] for j in others]) for k, others in whole.items()]
        side = F.broadcast(spark.createDataFrame(sides, "node long, linked long, same boolean, others array<long>"))  # a row for each node
        held = placed.withColumn("node", F.col("block.node")).join(side, "node")
        found = found.unionByName(held.select("key", (F.col("linked") - F.when(F.col("same"), F.col("weight")).otherwise(F.lit(0))).alias("n"), F.lit(None).cast("long").alias("other")))
        found = found.unionByName(held.select("key", F.lit(0).cast("long").alias("n"), F.explode("others").alias("other")))
    return stored(found)
