"""Packing token pieces into sequences by minimum bin slack.

Only lengths matter to a packing, so bins are found on the histogram of lengths, which has at most
`capacity` entries whatever the corpus: the longest available length opens a bin, a bitset subset-sum
over the other available lengths finds the fullest combination, and that combination is taken as often
as the counts allow. Pieces get a rank among those of their length from counts per task, and the rank
tells bin and place; no length's pieces ever meet in one task.

Defined results: a null or empty text is the single id 0. Repeated rows are packed each for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import Scratch


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the greatest sum up to room, as {length: times}."""
    mask, bits, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left and not bits >> room & 1:
            chunk = min(chunk, left)
            steps.append((length, chunk, bits))
            bits |= bits << length * chunk & mask
            left, chunk = left - chunk, chunk * 2
        if bits >> room & 1:
            break
    at, out = bits.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            out[length] = out.get(length, 0) + times
    return out


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(bin as {length: times}, number of such bins)] that use up the histogram."""
    left, out = {k: n for k, n in histogram.items() if n}, []
    while left:
        first = max(left)
        rest = {k: n - (k == first) for k, n in left.items() if n > (k == first)}
        one = fullest(rest, capacity - first)
        one[first] = one.get(first, 0) + 1
        times = min(left[k] // n for k, n in one.items())
        for k, n in one.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((one, times))
    return out


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (..., length, _part, _rank) -> with sequence_id and offset. _rank counts the pieces of a length in their part from 0."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    lots: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first rank, first bin, times in a bin, first offset
    used: dict[int, int] = {}
    bins = 0
    for one, times in minimum_bin_slack(histogram, capacity):
        offset = 0
        for length, n in sorted(one.items(), reverse=True):
            lots.setdefault(length, []).append((used.get(length, 0), bins, n, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        bins += times
    plan = {k: np.array(v, dtype=np.int64).T for k, v in lots.items()}
    shared = pieces.sparkSession.sparkContext.broadcast(plan)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = shared.value
        for f in frames:
            length, rank = f["length"].to_numpy(), f["_rank"].to_numpy() + f["_before"].to_numpy()
            bin_, offset = np.zeros_like(rank), np.zeros_like(rank)
            for x in np.unique(length):
                mine = length == x
                first, first_bin, n, at = plan[int(x)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                r = rank[mine] - first[k]
                bin_[mine], offset[mine] = first_bin[k] + r // n[k], at[k] + r % n[k] * x
            yield f.drop(columns=["_part", "_rank", "_before"]).assign(sequence_id=bin_, offset=offset)

    parts = pieces.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("length", "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    joined = pieces.join(parts, ["length", "_part"]).select(*pieces.columns, "_before")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name not in ("_part", "_rank"))
    return joined.mapInPandas(place, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """docs (doc_id, text) -> one row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    end = np.uint32(end_id).astype("<u4").tobytes()

    def finish() -> Callable:
        part, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)

        def cut(doc_ids: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
            rows = []
            for k, x in enumerate(ids):
                x += end
                n = len(x) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((k, piece, start, length, zlib.crc32(memoryview(x)[start * 4 : (start + length) * 4]), part, int(ranks[length])))
                    ranks[length] += 1
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            columns[0] = doc_ids.take(columns[0])
            columns[1] = columns[1].cast(pa.int32())
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"])

        return cut

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, _part long, _rank long"
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.cut(bpe.encoded(docs, path, finish, schema, **options), "pieces")
    return pack(pieces, capacity)


def sequences(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """The packed sequences themselves: placed as pack_documents returns it, ids (doc_id, ids) as bpe.encode_documents
    does, doc_id unique -> (sequence_id, ids binary). A sequence holds at most its capacity of ids."""
    whole = F.concat("ids", F.unhex(F.lit("00000000")))
    cut = placed.join(ids, "doc_id").select("sequence_id", "offset", F.substring(whole, (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("part"))
    gathered = cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    return gathered.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["part"])).alias("ids"))
