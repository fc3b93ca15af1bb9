"""Exact top-k inner products by the three-phase uniform threshold.

Vector components are dealt into `lists` fragments, each a column of its own: a fragment gives each query a
list of local scores, and a total is the sum over the lists. Queries go in blocks of a bounded size, which
are broadcast with their cutoffs; candidates are scanned where they lie and never shuffled.

1. Every task keeps the `heads` best entries of its part of a list. Their totals are resolved; a query's
   k-th best is a safe cutoff, as so many totals reach it.
2. The cutoff is broadcast. A total that reaches it has an entry of at least cutoff / lists, so that only
   such entries leave the lists. Those seen in all lists raise the cutoff; an entry not seen in a list is
   below cutoff / lists there, which bounds its total from above and prunes it.
3. Of the candidates left, those with missing entries fetch their vectors; their totals are resolved exactly.

Defined results: vectors that are null or empty or hold null or non-finite components take no part; of rows
that share an id the smallest vector counts; a shorter vector is padded with zeros; scores beyond the range
of a long are its ends. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, release_memory

_EXACT = float(1 << 52)
_LONG = (1 << 63) - 1


def _matrix(column: pa.Array, scale: float, width: int) -> np.ndarray:
    """Rows of floor(scale * component), padded with zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = np.floor(scale * column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False))
    offsets = offsets - offsets[0]
    length = np.diff(offsets)
    if (length == width).all():
        return values.reshape(len(length), width)
    out = np.zeros((len(length), width))
    out[np.repeat(np.arange(len(length)), length), np.arange(offsets[-1]) - np.repeat(offsets[:-1], length)] = values
    return out


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products: exact in doubles below 2^52; the few rows or queries too large for that go through Python's integers,
    whose results come back rounded, so that they compare within a relative error."""
    width = max(queries.shape[1], 1)
    most_q, most_r = np.abs(queries).max(1, initial=0), np.abs(rows).max(1, initial=0)
    limit = np.sqrt(_EXACT / width)
    with np.errstate(over="ignore", invalid="ignore"):
        out = queries @ rows.T
    wild = (most_q > limit)[:, None] | (most_r > limit)[None, :]
    if wild.any():
        for i, j in zip(*np.nonzero(wild), strict=True):
            out[i, j] = _double(_exactly(queries[i], rows[j]))
    return out


def _exactly(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a, b, strict=True))


def _double(x: int) -> float:
    return float(max(-(10**300), min(10**300, x)))


class _Queries:
    """A block of queries in a task: ids, a matrix for each list, cutoffs."""

    def __init__(self, ids: np.ndarray, parts: list[np.ndarray], cutoff: np.ndarray | None = None):
        self.ids, self.parts, self.cutoff = ids, parts, cutoff


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, lists: int = 2, heads: int = 16, query_block: int = 4096) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score; queries are the rows whose id is divisible by every."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "topk")
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.filter(finite & (F.size("embedding") > 0) & F.col("vec_id").isNotNull()).select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = scratch.cut(rows, "vectors")
    asked = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    # of equal vectors the k + 1 smallest ids can be among a query's best, its own left out
    rows = _limited(rows, ["v"], ["vec_id"], k + 1)
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    cuts = [round(width * i / lists) for i in range(lists + 1)]
    parts = [F.slice("v", a + 1, b - a).alias(f"part{i}") for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    rows = scratch.cut(rows.select("vec_id", *parts), "rows")
    names, widths = [f"part{i}" for i in range(lists)], [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    asked = asked.select("vec_id", *parts)
    n_blocks = -(-asked.count() // query_block) or 1
    asked = scratch.cut(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")), "queries", ["block"])
    found = []
    for block in range(n_blocks):
        q = asked.filter(F.col("block") == block).select("vec_id", *names).toArrow().combine_chunks()
        if q.num_rows:
            columns = [q.column(n).chunk(0) for n in names]
            queries = _Queries(q.column("vec_id").to_numpy(), [_matrix(c, scale, w) for c, w in zip(columns, widths, strict=True)])
            found.append(_block(spark, scratch, rows, queries, names, widths, k, scale, max(heads, k)))
    out = found[0] if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _limited(rows: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each group; every task drops the rest of its own before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def _block(spark, scratch: Scratch, rows: DataFrame, queries: _Queries, names: list[str], widths: list[int], k: int, scale: float, heads: int) -> DataFrame:
    context, lists = spark.sparkContext, len(names)
    shared = context.broadcast(queries)

    def chunks(batches: Iterator[pa.RecordBatch], width: int, values: int = 1 << 20):
        """(ids, matrix) of a few rows at a time, so that their products with all queries stay small."""
        step = max(16, values // len(shared.value.ids))
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                yield part.column(0).to_numpy(), _matrix(part.column(1), scale, width)

    def local_heads(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            best, ids = np.full((len(asked.ids), 0), -np.inf), np.zeros((len(asked.ids), 0), np.int64)
            for own, matrix in chunks(batches, widths[number]):
                p = _products(asked.parts[number], matrix)
                p[asked.ids[:, None] == own[None, :]] = -np.inf
                best, ids = np.concatenate([best, p], 1), np.concatenate([ids, np.broadcast_to(own, p.shape)], 1)
                if best.shape[1] > heads:
                    top = np.argpartition(-best, heads - 1, axis=1)[:, :heads]
                    best, ids = np.take_along_axis(best, top, 1), np.take_along_axis(ids, top, 1)
            q, at = np.nonzero(best > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(ids[q, at]), pa.array(best[q, at])], ["query_id", "vec_id", "part"])
            release_memory()

        return run

    def union(make) -> DataFrame:
        """The lists one after another, each with its number; each reads its own column alone."""
        out = None
        for number, name in enumerate(names):
            mine = rows.select("vec_id", name).mapInArrow(make(number), "query_id long, vec_id long, part double").withColumn("list", F.lit(number))
            out = mine if out is None else out.unionByName(mine)
        return out

    def resolve(pairs: DataFrame) -> DataFrame:
        """pairs (query_id, vec_id) -> with score, the exact total, clamped to a long."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = shared.value
            order = np.argsort(asked.ids)
            for whole in batches:
                for at in range(0, whole.num_rows, 4096):
                    b = whole.slice(at, 4096)
                    q = order[np.searchsorted(asked.ids[order], b.column(0).to_numpy())]
                    sides = [(p[q], _matrix(b.column(2 + i), scale, w)) for i, (p, w) in enumerate(zip(asked.parts, widths, strict=True))]
                    with np.errstate(over="ignore", invalid="ignore"):
                        total = sum(np.einsum("ij,ij->i", x, y) for x, y in sides)
                        size = sum(np.abs(x).max(1, initial=0) * np.abs(y).max(1, initial=0) * max(1, x.shape[1]) for x, y in sides)
                    tame = size < _EXACT
                    score = np.where(tame, total, 0).astype(np.int64)
                    for i in np.flatnonzero(~tame):
                        score[i] = max(-_LONG - 1, min(_LONG, sum(_exactly(x[i], y[i]) for x, y in sides)))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["query_id", "vec_id", "score"])
            release_memory()

        return pairs.join(rows, "vec_id").select("query_id", "vec_id", *names).mapInArrow(run, "query_id long, vec_id long, score long")

    def kth(scores: DataFrame) -> dict[int, int]:
        """{query: its k-th best total} of queries that have so many."""
        best = _limited(scores.select("query_id", "score"), ["query_id"], [F.desc("score")], k)
        ranked = best.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n"))
        return {r["query_id"]: r["s"] for r in ranked.filter(F.col("n") == k).collect()}

    def cutoffs(*known: dict[int, int]) -> np.ndarray:
        """As doubles, rounded down; one at an end of the long range bounds nothing."""
        best = [max((x[i] for x in known if i in x), default=-_LONG) for i in queries.ids.tolist()]
        return np.array([-np.inf if abs(x) >= _LONG else (x if abs(x) < _EXACT else x - abs(x) * 1e-9) for x in best], float)

    # 1: the heads of the local lists of every task, the best of them by query and list, and their totals
    pairs = _limited(union(local_heads), ["query_id", "list"], [F.desc("part"), "vec_id"], heads).select("query_id", "vec_id").distinct()
    first = scratch.cut(resolve(pairs), "first")
    known = kth(first)
    cutoff = context.broadcast(cutoffs(known))

    # 2: entries that reach cutoff / lists
    def entries(number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked, least = shared.value, (cutoff.value / lists)[:, None]
            least = least - np.where(np.isfinite(least) & (np.abs(least) >= _EXACT / lists), np.abs(least) * 1e-9, 0)
            for own, matrix in chunks(batches, widths[number]):
                p = _products(asked.parts[number], matrix)
                q, at = np.nonzero((p >= least) & (asked.ids[:, None] != own[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(own[at]), pa.array(p[q, at])], ["query_id", "vec_id", "part"])
            release_memory()

        return run

    seen = union(entries).groupBy("query_id", "vec_id").agg(F.count("*").alias("seen"), F.sum("part").alias("low"), F.max(F.abs("part")).alias("size"))
    seen = scratch.cut(seen, "seen")
    whole = (F.col("seen") == lists) & (F.col("size") < _EXACT / lists)
    exact = seen.filter(whole).select("query_id", "vec_id", F.col("low").cast("long").alias("score"))
    raised = cutoffs(known, kth(exact))
    bounds = pd.DataFrame({"query_id": queries.ids, "cutoff": raised, "missing": cutoff.value / lists})
    bounds = F.broadcast(spark.createDataFrame(bounds, "query_id long, cutoff double, missing double"))

    # 3: candidates whose upper bound reaches the raised cutoff; what is missing is fetched
    upper = F.col("low") + (lists - F.col("seen")) * F.col("missing")
    left = seen.join(bounds, "query_id").filter((F.col("cutoff") == float("-inf")) | (F.col("size") >= _EXACT / lists) | (upper >= F.col("cutoff")))
    scores = exact.unionByName(resolve(left.filter(~whole).select("query_id", "vec_id")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    return scratch.cut(best, "best")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
