"""Near-duplicate vectors by cover trees and dual traversal.

Equal vectors of a label form a class, and classes are compared once. A bounded sample gives the top of
each large label's cover tree: pivots, to the nearest of which every class goes. A node's classes are dealt
by hash into blocks of about `block`; pairs of nodes whose pivots are farther apart than both covering
radii and the threshold radius are pruned. For each pair of blocks left, a task builds a cover tree of
each, nested levels with halving radii, and walks both at once, pruning pairs of tree nodes by the same bound
and taking pairs that lie wholly within the radius without looking inside. A task returns link counts and a
spanning forest of its links, so that a group of near copies never makes all its pairs.

Defined results: vectors that are null, empty or all zero or hold null or non-finite components, and those
without a label, link with nothing, as do vectors of different length. A row that repeats counts once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

_SLACK = 1e-7


class CoverTree:
    """Points in an order in which every node's descendants are a range."""

    def __init__(self, points: np.ndarray):
        """points: unit vectors. A node at radius r holds points within r of its centre; its children, the first with
        the same centre, have radius r / 2."""
        self.children: list[np.ndarray] = []
        lo, hi, centre, cover, order = [], [], [], [], []

        def add(members: np.ndarray, dist: np.ndarray) -> int:
            self.children.append(np.zeros(0, np.int64))
            centre.append(members[0])
            cover.append(dist.max())
            lo.append(0)
            hi.append(0)
            return len(centre) - 1

        def distances(c: int, members: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, 2 - 2 * (points[members] @ points[c])))

        everyone = np.arange(len(points))
        stack = [(add(everyone, distances(0, everyone)), everyone, None)]
        stack[0] = (*stack[0][:2], distances(0, everyone))
        while stack:
            node, members, dist = stack.pop()
            if members is None:
                hi[node] = len(order)
                continue
            lo[node] = len(order)
            stack.append((node, None, None))
            if cover[node] <= _SLACK:
                order.extend(members)
                continue
            radius, made, rest, d = cover[node] / 2, [], members, dist
            while len(rest):
                near = d <= radius
                near[0] = True
                made.append((add(rest[near], d[near]), rest[near], d[near]))
                rest = rest[~near]
                if len(rest):
                    d = distances(rest[0], rest)
            self.children[node] = np.array([m[0] for m in made])
            stack.extend(reversed(made))
        self.lo, self.hi, self.cover = np.array(lo), np.array(hi), np.array(cover)
        self.order, self.centres = np.array(order), points[np.array(centre)]
        self.leaf = np.array([not len(c) for c in self.children])


def near_pairs(a: CoverTree, b: CoverTree, radius: float):
    """Yields ('pairs', i, j), arrays of places whose points may be near, and ('all', node of a, node of b), ranges that
    are near throughout. Every pair within radius comes once; if a is b, unordered."""
    same, stack = a is b, [(0, 0)]
    while stack:
        x, y = stack.pop()
        xs = np.array([x]) if a.leaf[x] else a.children[x]
        ys = np.array([y]) if b.leaf[y] else b.children[y]
        for k in range(0, len(xs), 1024):
            part = xs[k : k + 1024]
            d = np.sqrt(np.maximum(0, 2 - 2 * (a.centres[part] @ b.centres[ys].T)))
            reach = a.cover[part][:, None] + b.cover[ys][None, :]
            alive = d <= reach + radius + _SLACK
            if same and x == y:
                alive &= np.arange(k, k + len(part))[:, None] <= np.arange(len(ys))[None, :]
            i, j = np.nonzero(alive)
            u, v, inside = part[i], ys[j], (d + reach)[i, j] <= radius - 2 * _SLACK
            single = (a.hi[u] - a.lo[u] == 1) & (b.hi[v] - b.lo[v] == 1)
            if single.any():
                yield "pairs", a.lo[u[single]], b.lo[v[single]]
            for p, q, whole in zip(u[~single], v[~single], inside[~single], strict=True):
                if whole:
                    yield "all", p, q
                elif a.leaf[p] and b.leaf[q]:
                    i2, j2 = np.meshgrid(np.arange(a.lo[p], a.hi[p]), np.arange(b.lo[q], b.hi[q]), indexing="ij")
                    yield "pairs", i2.ravel(), j2.ravel()
                else:
                    stack.append((p, q))


def _block_links(vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray, split: int, threshold: float) -> pd.DataFrame:
    """Links of one pair of blocks, vectors[:split] and vectors[split:]; split = len(vectors): of a block with itself.
    -> rows (a, links) of counts, with b null, and (a, b) of a spanning forest."""
    norm = np.linalg.norm(vectors, axis=1)
    unit = vectors / norm[:, None]
    left = CoverTree(unit[:split])
    right = left if split == len(vectors) else CoverTree(unit[split:])
    at_left, at_right = left.order, right.order + (0 if right is left else split)
    links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
    edges: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if not edges:
            return
        i, j = (np.concatenate(x) for x in zip(*edges, strict=True))
        edges.clear()
        while True:  # minimum labels along the new links, with shortcuts
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, before[i], low)
            np.minimum.at(label, before[j], low)
            np.minimum(label, label[label], out=label)
            if (label[i] == label[j]).all() and (label == label[label]).all():
                return

    waiting = 0
    for kind, x, y in near_pairs(left, right, math.sqrt(max(0.0, 2 - 2 * threshold))):
        if kind == "pairs":
            for k in range(0, len(x), 1 << 16):
                i, j = at_left[x[k : k + (1 << 16)]], at_right[y[k : k + (1 << 16)]]
                if right is left:
                    i, j = i[i != j], j[i != j]
                    once = (x[k : k + (1 << 16)] < y[k : k + (1 << 16)])[x[k : k + (1 << 16)] != y[k : k + (1 << 16)]]
                    i, j = i[once], j[once]
                linked = np.einsum("ij,ij->i", vectors[i], vectors[j]) / (norm[i] * norm[j]) >= threshold
                i, j = i[linked], j[linked]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                edges.append((i, j))
                waiting += len(i)
        else:
            i, j = at_left[left.lo[x] : left.hi[x]], at_right[right.lo[y] : right.hi[y]]
            if right is left and x == y:
                links[i] += copies[i].sum() - copies[i]
            else:
                links[i] += copies[j].sum()
                links[j] += copies[i].sum()
                edges.append((j, np.full(len(j), i[0])))
            edges.append((i, np.full(len(i), i[0])))
            waiting += len(i) + len(j)
        if waiting > 1 << 20:
            settle()
            waiting = 0
    settle()
    some, apart = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(ids)))
    return pd.DataFrame({"a": np.concatenate([ids[some], ids[apart]]), "b": pd.array([*[None] * len(some), *ids[label[apart]]], "Int64"), "links": np.concatenate([links[some], np.zeros(len(apart), np.int64)])})


def _pivots(sample: list, total: int, block: int, most: int) -> dict:
    """{(label, length): unit pivots} of labels that hold more than a block, farthest first."""
    groups: dict = {}
    for r in sample:
        groups.setdefault((r["label"], len(r["v"])), []).append(r["v"])
    out = {}
    for key, rows in groups.items():
        want = min(most, len(rows), int(total * len(rows) / max(1, len(sample)) / block))
        x = np.array(rows)
        x /= np.linalg.norm(x, axis=1)[:, None]
        chosen, nearest = [0], np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < want:
            chosen.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, np.linalg.norm(x - x[chosen[-1]], axis=1))
        out[key] = x[chosen]
    return out


def link_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = 2048, sample_rows: int = 16_384, most_pivots: int = 256) -> DataFrame:
    """vectors (vec_id, embedding, label) -> vec_id, n_links, component_id, kept; one row per input row."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "vectors")
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = finite & F.exists(v, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # a scale common to a vector leaves its cosines alone and keeps squares in range
    top = F.array_max(F.transform(v, F.abs))
    scaled = F.when((top > 1e150) | (top < 1e-150), F.transform(v, lambda x: x / top)).otherwise(v)
    rows = scratch.cut(vectors.select("vec_id", F.when(usable, F.col("label")).alias("label"), F.when(usable, scaled).alias("v")), "rows")
    good = rows.filter("v is not null")
    classes = scratch.cut(good.distinct().groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes")

    total = classes.count()
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("label", "v").collect()
    pivots = _pivots(sample, total, block, most_pivots)
    shared = spark.sparkContext.broadcast(pivots)

    def assign(frames):
        for f in frames:
            node, dist = np.zeros(len(f), np.int64), np.ones(len(f))
            sizes = f["v"].map(len)
            for (label, size), k in f.groupby(["label", sizes]).indices.items():
                if (p := shared.value.get((label, size))) is not None:
                    x = np.stack(f["v"].to_numpy()[k])
                    x /= np.linalg.norm(x, axis=1)[:, None]
                    d = np.sqrt(np.maximum(0, 2 - 2 * x @ p.T))
                    node[k], dist[k] = d.argmin(1), d.min(1)
            yield pd.DataFrame({"label": f["label"], "size": sizes, "node": node, "dist": dist, "rep": f["rep"], "copies": f["copies"], "v": f["v"]})

    label_type = classes.schema["label"].dataType.simpleString()
    dealt = scratch.cut(classes.mapInPandas(assign, f"label {label_type}, size int, node long, dist double, rep long, copies long, v array<double>"), "dealt")
    nodes = dealt.groupBy("label", "size", "node").agg(F.ceil(F.count("*") / block).alias("n"), F.max("dist").alias("radius"))
    nodes = scratch.cut(nodes, "nodes")
    apart = [pd.DataFrame({"label": [], "size": [], "node": [], "node2": [], "apart": []})]
    for (label, size), p in pivots.items():
        i, j = np.triu_indices(len(p), 1)
        apart.append(pd.DataFrame({"label": [label] * len(i), "size": size, "node": i, "node2": j, "apart": np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)[i, j]))}))
    apart = pa.Table.from_pandas(pd.concat(apart[1:] or apart), preserve_index=False)
    apart = spark.createDataFrame(apart).select(F.col("label").cast(label_type), F.col("size").cast("int"), F.col("node").cast("long"), F.col("node2").cast("long"), F.col("apart").cast("double")) if apart.num_rows else spark.createDataFrame([], f"label {label_type}, size int, node long, node2 long, apart double")
    other = nodes.select("label", "size", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("radius").alias("radius2"))
    pairs = nodes.join(other, ["label", "size"]).filter("node <= node2").join(apart, ["label", "size", "node", "node2"], "left")
    pairs = pairs.filter(F.coalesce("apart", F.lit(0.0)) <= F.col("radius") + F.col("radius2") + math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK)
    pairs = pairs.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).withColumn("sub2", F.explode(F.sequence(F.lit(0), F.col("n2").cast("int") - 1)))
    pairs = pairs.filter("node < node2 or sub <= sub2").select("label", "size", "node", "sub", "node2", "sub2", F.sha2(F.to_json(F.struct("label", "size", "node", "sub", "node2", "sub2")), 256).alias("pair"))
    pairs = scratch.cut(pairs, "pairs")
    blocks = dealt.join(nodes.select("label", "size", "node", "n"), ["label", "size", "node"]).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")).select("label", "size", "node", "sub", "rep", "copies", "v")
    key = ["label", "size", "node", "sub"]
    left = blocks.join(pairs.select(*key, "pair"), key).withColumn("side", F.lit(0))
    right = blocks.join(pairs.filter("node <> node2 or sub <> sub2").select("label", "size", F.col("node2").alias("node"), F.col("sub2").alias("sub"), "pair"), key).withColumn("side", F.lit(1))

    def traverse(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["side", "rep"])
        split = int((f["side"] == 0).sum())
        if not split:
            split = len(f)
        return _block_links(np.stack(f["v"].to_numpy()), f["rep"].to_numpy(), f["copies"].to_numpy(), split, threshold)

    found = scratch.cut(left.unionByName(right).select("pair", "side", "rep", "copies", "v").groupBy("pair").applyInPandas(traverse, "a long, b long, links long"), "found")
    components = connected_components(found.filter("b is not null").select("a", "b"), scratch)
    links = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    per_class = classes.join(links, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    per_class = scratch.cut(per_class.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "per_class")
    # rows that link with nothing have no key to be joined by
    linked = good.join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), ok AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
