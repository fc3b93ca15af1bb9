"""Jaccard join of documents on word shingles by T-occurrence search.

Documents of one shingle set form a class; classes link when num / den of their union is shared, so a
class of n shingles needs partners that hold T = ceil(n * num / den) of them.

1. Heads. Under a fixed hash order the first n - T + t shingles of both of a linked pair share t or more.
   Only classes whose head has enough shingles that another class's head holds stay; one pass over the
   texts finds them, a second one gathers their sets.
2. DivideSkip. Shingles are ordered by the length of their inverted lists. Of a class the L longest lists are
   set aside, L = T / (mu * log2(longest) + 1); the short ones are merged (a sort-merge join on the shingle
   brings the postings of a list together) and occurrences are counted. Both of a linked pair hold their
   shared shingles in one order, so that T - L of them, by the smaller T - L of the two, lie in the short
   lists of both. A candidate that occurs so often is looked up by binary probes: of the class whose short
   lists end first, the long lists are probed in the other's sorted set, and the candidate is retained if
   the count and the probes together reach the required overlap.
3. Large groups. Only components are asked for, so each class first meets the most central class of its
   lists; then only candidates from different components are left, found from each list's postings outside
   its largest component, where the smaller one of a linked pair needs still fewer lists. Two classes that met
   the same leader compare by their differences from it. Groups of near copies thus never make all their
   pairs, and no link that could join two components is left out.

Defined results: a null or empty text, or one of white space, has an empty set and links with nothing.
Fewer words than a shingle has make one shingle of them all. Every row is judged by its own text: repeated
rows get one component, rows that share a doc_id but not a text may get different ones. A row without doc_id
links with nothing and has no component. Texts of any length are read whole; other columns are not read.
Shingles are compared by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, release_memory
from .components import connected_components
from .text_features import _MUL, SPACE, mix, segments, token_hashes


def shingle_sets(texts: list[bytes], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are hashed in segments of a long text."""
    tokens, counts = [], np.zeros(len(texts), np.int64)
    for run in segments(texts, 1 << 19, SPACE):
        joined = np.frombuffer(b"\n".join([*(t.lower() for _, t in run), b""]), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for _, t in run])])
        printing = ~((joined == 32) | (joined >= 9) & (joined <= 13))
        edge = np.flatnonzero(np.diff(printing.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
        first, last = edge[::2], edge[1::2]
        tokens.append(token_hashes(joined, first, last))
        np.add.at(counts, [k for k, _ in run], np.diff(np.searchsorted(first, starts)))
    token, cuts = np.concatenate(tokens or [np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum(counts)])
    h = np.zeros(max(len(token) - words + 1, 0), np.uint64)
    for k in range(words):
        h = mix(h * _MUL + token[k : len(h) + k] + np.uint64(k))
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b - a >= words:
            yield np.unique(h[a : b - words + 1])
        elif b > a:
            short = np.uint64(b - a)
            for k in range(a, b):
                short = mix(np.array([short]) * _MUL + token[k])[0]
            yield np.array([short])
        else:
            yield np.zeros(0, np.uint64)


def _runs(texts: pa.Array, run_bytes: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    at, out, size = 0, [], 0
    for k, t in enumerate(texts):
        out.append(t.as_py() or b"")
        size += len(out[-1])
        if size >= run_bytes:
            yield at, out
            at, out, size = k + 1, [], 0
    if out:
        yield at, out


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


class _Rule:
    """Sizes under: link when den * intersection >= num * union. extra: heads are longer than a prefix by this share of spare()."""

    def __init__(self, num: int, den: int, extra: float):
        self.num, self.den, self.extra = num, den, extra

    def needed(self, n: int) -> int:
        return -(-n * self.num // self.den)

    def spare(self, n: int) -> int:
        """Shingles that a partner of a set of n may lack."""
        return n - self.needed(n)

    def head(self, n: int) -> int:
        """None where sets of n link with no other size; a set that may lack nothing still links with one that has a shingle more."""
        if n * (self.den - self.num) < self.num:
            return 0
        return self.spare(n) + max(1, int(self.spare(n) * self.extra))

    def head_shared(self, n: Column) -> Column:
        """Shingles at least that the head of a set of n shares with the head of any partner, which has needed(n) or more."""
        return F.greatest(F.lit(1), F.floor(self.spare_column(F.ceil(n * self.num / self.den)) * F.lit(self.extra)))

    def spare_column(self, n: Column) -> Column:
        return F.floor(n * (self.den - self.num) / self.den).cast("long")

    def spare_smaller(self, n: Column) -> Column:
        """Shingles that a set of n may have and a linked set that is no smaller may lack."""
        return n - F.ceil(n * (2 * self.num) / (self.den + self.num))

    def may_link(self, n1: Column, u1: Column, n2: Column, u2: Column) -> Column:
        """u: shingles that no other class holds. The intersection leaves them out, the union holds both."""
        both = F.least(n1 - u1, n2 - u2)
        return both * self.den >= F.greatest(n1 + u2, n2 + u1) * self.num

    def links(self, shared: Column, n1: Column, n2: Column) -> Column:
        return shared * self.den >= (n1 + n2 - shared) * self.num


def _compared(pairs: DataFrame, sets: DataFrame, differences: bool) -> DataFrame:
    """pairs (a, b) -> a, b, n1, n2, shared, by binary probes of the smaller set's shingles in the larger; with
    differences also what a lacks of b and has beyond it, where the two are fewer than half of a."""
    one = sets.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("shingles").alias("s1"))
    two = sets.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("shingles").alias("s2"))
    wide = pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "s1", "s2")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for b in batches:
            shared, lacks, beyond = np.zeros(b.num_rows, np.int64), [], []
            left, right = (b.column(c) for c in (4, 5))
            lv, rv = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (left, right))
            lo, ro = (x.offsets.to_numpy() for x in (left, right))
            for k in range(b.num_rows):
                x, y = lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]]
                short, long = (x, y) if len(x) <= len(y) else (y, x)
                at = np.searchsorted(long, short)
                found = long[np.minimum(at, len(long) - 1)] == short
                shared[k] = np.count_nonzero(found)
                near = differences and len(x) + len(y) - 2 * shared[k] < len(x) // 2
                if near:
                    rest, gone = np.delete(long, at[found]), short[~found]
                    lacks.append(rest if long is y else gone)
                    beyond.append(gone if long is y else rest)
                else:
                    lacks.append(none)
                    beyond.append(none)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(shared), _lists(lacks), _lists(beyond)], ["a", "b", "n1", "n2", "shared", "lacks", "beyond"])

    return wide.mapInArrow(probe, "a long, b long, n1 long, n2 long, shared long, lacks array<long>, beyond array<long>")


def _probed(candidates: DataFrame, orders: DataFrame, sets: DataFrame, rule: _Rule) -> DataFrame:
    """candidates (a, b, c: short lists that both are in) -> (a, b) that link. The long lists of one of the two are probed
    in the other's sorted set."""
    cuts = lambda k: [F.col("id").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "early", "cut", "at_early", "at_cut")]]
    pairs = candidates.join(orders.select(*cuts("a")), "a").join(orders.select(*cuts("b")), "b")
    small = F.struct("n_a", "a") < F.struct("n_b", "b")
    of = lambda name, first, second: F.when(small, F.col(f"{name}_{first}")).otherwise(F.col(f"{name}_{second}"))
    # the smaller one's early lists met the larger one's short ones; past the first of the two ends nothing is counted
    by_small = of("at_early", "a", "b") <= of("at_cut", "b", "a")
    by_a = by_small == small
    pairs = pairs.select(
        "a", "b", "c", "n_a", "n_b", F.when(by_a, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(by_a, F.col("b")).otherwise(F.col("a")).alias("other"),
        F.when(by_small, of("early", "a", "b")).otherwise(of("cut", "b", "a")).alias("start"),
    )
    long = F.slice("order", F.col("start") + 1, F.greatest(F.size("order") - F.col("start"), F.lit(0))).alias("long")
    wide = pairs.join(orders.select("id", "order"), "id").select("a", "b", "c", "n_a", "n_b", "other", long).join(sets.select(F.col("id").alias("other"), "shingles"), "other")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shared = b.column(2).to_numpy().copy()
            left, right = b.column(5), b.column(6)
            lv, rv = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (left, right))
            lo, ro = (x.offsets.to_numpy() for x in (left, right))
            for k in range(b.num_rows):
                x, y = lv[lo[k] : lo[k + 1]], rv[ro[k] : ro[k + 1]]
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared[k] += np.count_nonzero(y[at] == x)
            linked = shared * rule.den >= (b.column(3).to_numpy() + b.column(4).to_numpy() - shared) * rule.num
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(linked)), b.column(1).filter(pa.array(linked))], ["a", "b"])
        release_memory()

    return wide.select("a", "b", "c", "n_a", "n_b", "long", "shingles").mapInArrow(probe, "a long, b long")


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, extra: float = 1.0, broadcast_ids: int = 2_000_000, mu: float = 0.0085, groups: bool = False) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id; one row per input row. extra: how much longer
    than necessary heads are, as a share; longer heads tell better which classes can have links. Ids of at most broadcast_ids
    classes are broadcast to gather their sets (16 bytes each); more are joined. mu: the weight that tells how many lists are
    long. groups: adds text_id, a hash of the text, and group, a number for each component."""
    spark, scratch, rule = docs.sparkSession, Scratch(docs.sparkSession, "jaccard"), _Rule(num, den, extra)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for at, run in _runs(texts):
                sizes, sigs, heads = [], [], []
                for s in shingle_sets(run, words):
                    sizes.append(len(s))
                    sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    heads.append(s[: rule.head(len(s))])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(run)), b.column(2).slice(at, len(run)), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), _lists(heads)], ["doc_id", "text_id", "n", "sig", "head"])
        release_memory()

    with_ids = docs.withColumn("text_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    signed = scratch.cut(with_ids.mapInArrow(signatures, f"doc_id {id_type}, text_id long, n long, sig binary, head array<long>"), "signed")
    members = signed.filter("n > 0 and doc_id is not null")
    classes = scratch.cut(members.groupBy("sig").agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.monotonically_increasing_id()), "classes")

    heads = members.select("doc_id", F.expr("conv(hex(substring(sig, 1, 7)), 16, 10)").cast("long").alias("mark"), "n", F.explode("head").alias("h"))
    shared_heads = heads.groupBy("h").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).filter("lo <> hi").select("h")
    shared_heads = scratch.cut(shared_heads, "shared_heads")
    alive = heads.join(shared_heads, "h").groupBy("doc_id", "n").agg(F.count("*").alias("c")).filter(F.col("c") >= rule.head_shared(F.col("n"))).select("doc_id")
    alive = scratch.cut(alive.distinct().join(classes.select("doc_id"), "doc_id", "left_semi"), "alive")

    # the sets of the classes that are left
    few = alive.limit(broadcast_ids + 1).count() <= broadcast_ids
    wanted = spark.sparkContext.broadcast(np.sort(alive.toArrow().column("doc_id").to_numpy().copy()) if few else None)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if wanted.value is not None:
                ids = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
                k = np.searchsorted(wanted.value, ids)
                b = b.filter(pa.array((k < len(wanted.value)) & (wanted.value[np.minimum(k, len(wanted.value) - 1)] == ids) if len(wanted.value) else np.zeros(len(ids), bool)))
            for at, run in _runs(b.column(1).cast(pa.binary())):
                sets = list(shingle_sets(run, words))
                sigs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["sig", "n", "shingles"])
        release_memory()

    source = docs.filter("doc_id is not null")
    source = source if few else source.join(alive, "doc_id", "left_semi")
    sets = source.mapInArrow(gather, "sig binary, n long, shingles array<long>").filter("n > 0").groupBy("sig").agg(F.max(F.struct("n", "shingles")).alias("s"))
    sets = scratch.cut(sets.join(classes.select("sig", "id"), "sig").select("id", "s.n", "s.shingles"), "sets")

    # lists by length, and each class's short ones; those of shingles that no other class holds come first, u of them
    postings = sets.select("id", F.explode("shingles").alias("h"))
    lengths = scratch.cut(postings.groupBy("h").agg(F.count("*").alias("length")).filter("length > 1"), "lengths")
    orders = postings.join(lengths, "h").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("length", "h"))).alias("lists"))
    orders = orders.join(sets.select("id", "n"), "id").withColumn("u", F.col("n") - F.size("lists")).filter(F.col("u") <= rule.spare_column(F.col("n")))
    needed = F.ceil(F.col("n") * num / den)
    long = F.least(needed - 1, F.floor(needed / (F.lit(mu) * F.log2(F.get("lists", F.size("lists") - 1)["length"]) + 1)))
    orders = orders.withColumn("few", (needed - long).cast("int")).withColumn("cut", (F.col("n") - long - F.col("u")).cast("int"))
    # early: the lists among which the smaller one of a linked pair shares `few` with the larger one's short lists
    orders = orders.withColumn("early", F.greatest(F.lit(0), rule.spare_smaller(F.col("n")) + F.col("few") - F.col("u")).cast("int"))
    end = lambda c: F.get("lists", F.col(c) - 1)
    orders = scratch.cut(orders.select("id", "n", "u", "few", "cut", "early", end("cut").alias("at_cut"), end("early").alias("at_early"), F.transform("lists", lambda x: x["h"]).alias("order")), "orders")
    short = orders.select("id", "n", "u", "few", "early", F.slice("order", 1, F.col("cut")).alias("s"))
    short = short.select("id", "n", "u", "few", F.col("early").alias("_early"), F.posexplode("s").alias("at", "h"))
    short = scratch.cut(short.select("id", "n", "u", "few", "h", (F.col("at") < F.col("_early")).alias("early")), "short")

    # every class with the most central class of its lists
    leaders = short.groupBy("h").agg(F.min(F.struct("u", "id", "n")).alias("l"), F.count("*").alias("c")).filter("c > 1").select("h", F.col("l.id").alias("b"), F.col("l.u").alias("u2"), F.col("l.n").alias("n2"))
    leaders = scratch.cut(leaders, "leaders")
    met = short.join(leaders, "h").filter(F.col("id") != F.col("b")).filter(rule.may_link(F.col("n"), F.col("u"), F.col("n2"), F.col("u2")))
    met = met.groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("c")).groupBy("a").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"))
    met = scratch.cut(_compared(met, sets, differences=True), "met")
    linked = rule.links(F.col("shared"), F.col("n1"), F.col("n2"))
    first = met.filter(linked).select("a", "b")
    comps = connected_components(first, scratch)
    # how a class differs from its leader, where it is near it: pairs with one leader compare by that alone
    near = met.filter(F.col("n1") + F.col("n2") - 2 * F.col("shared") < F.floor(F.col("n1") / 2)).select(F.col("a").alias("id"), F.col("b").alias("leader"), "lacks", "beyond")

    # candidates from different components: at least one of them is outside its list's largest component
    placed = short.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    placed = scratch.cut(placed, "placed")
    largest = placed.groupBy("h", "comp").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("h", "main")
    largest = scratch.cut(largest, "largest")
    mixed = scratch.cut(placed.join(largest, "h").join(near, "id", "left"), "mixed")
    side = lambda k, name: [F.col(c).alias(f"{c}{k}") for c in ("n", "u", "few", "comp", "early", "leader", "lacks", "beyond")] + [F.col("id").alias(name)]
    odd = mixed.filter("comp <> main").select("h", *side(1, "a"))
    every = mixed.select("h", "main", *side(2, "b"))
    smaller_early = F.when(F.struct("n1", "a") < F.struct("n2", "b"), F.col("early1")).otherwise(F.col("early2"))
    once = (F.col("comp2") == F.col("main")) | (F.col("a") < F.col("b"))
    # both near one leader: the intersection follows from what they lack of it and have beyond it
    leader_size = F.col("n1") + F.size("lacks1") - F.size("beyond1")
    shared = leader_size - F.size(F.array_union("lacks1", "lacks2")) + F.size(F.array_intersect("beyond1", "beyond2"))
    one_leader = F.coalesce(F.col("leader1") == F.col("leader2"), F.lit(False))
    pair = odd.join(every, "h").filter((F.col("comp1") != F.col("comp2")) & once & smaller_early & rule.may_link(F.col("n1"), F.col("u1"), F.col("n2"), F.col("u2")))
    pair = pair.filter(~one_leader | rule.links(shared, F.col("n1"), F.col("n2")))
    counted = pair.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("c"), F.first(F.least("few1", "few2")).alias("few"), F.first(one_leader).alias("linked"))
    candidates = scratch.cut(counted.filter(F.col("linked") | (F.col("c") >= F.col("few"))).select("a", "b", "c", "linked"), "candidates")
    second = _probed(candidates.filter("not linked").select("a", "b", "c"), orders, sets, rule).unionByName(candidates.filter("linked").select("a", "b"))
    comps = connected_components(first.unionByName(second), scratch)

    # a component is named by its smallest doc_id
    placed = classes.join(comps.withColumnRenamed("node", "id"), "id", "left").select("sig", "doc_id", F.coalesce("component", "id").alias("group"))
    placed = scratch.cut(placed, "by_class")
    named = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    by_class = scratch.cut(placed.join(named, "group").select("sig", "group", "component_id"), "by_class")
    out = signed.select("doc_id", "text_id", "n", "sig").join(by_class, "sig", "left")
    linkable = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    columns = ["doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(linkable, F.col("component_id")), F.col("doc_id")).alias("component_id")]
    return out.select(*columns, *(["text_id", F.when(linkable, F.col("group")).alias("group")] if groups else []))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, chr(10))]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2])) END) AS h
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.n + y.n - i)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""
