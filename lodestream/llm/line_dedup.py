"""Line de-duplication over levelled sorted runs of line hashes.

Documents are taken in batches of falling doc_id. A batch's line keys, counted, merge-anti-join the runs
written so far: a key that no run has enters the batch's own run with its keeper, the largest doc_id that
holds it, since every later batch has smaller ones. A key that a run has adds to its count, without a
keeper, until some run settles it: once it counts min_docs documents nothing can change its verdict, and
further batches anti-join it away. Each batch adds one run to level 0; a level that holds `fanout` runs is
compacted into one run of the next level. Runs are bucketed and sorted by key, so that the joins of a batch
with them shuffle nothing.

Defined results: a null or empty text is one empty line; a line's key is the line stripped of white
space with A-Z lower-cased; shorter keys than `min_chars` are never dropped. Rows that share a doc_id
count as one document and keep their own lines. Rows with a null doc_id neither count nor lose lines.
Other columns, whatever their names, stay as they are. Keys are compared by their 128-bit MD5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, ascii_lower, hex_sha256


class LineRuns:
    """Runs (key, n_docs, keeper), each bucketed and sorted by key; keeper is null in a row that only adds to a count.
    Of all rows of a key exactly one, the earliest, has a keeper."""

    def __init__(self, spark: SparkSession, scratch: Scratch, min_docs: int = 5, fanout: int = 3):
        self.spark, self.scratch, self.min_docs, self.fanout = spark, scratch, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, batch: DataFrame) -> None:
        """batch: (key, doc_id), a key at most once for a doc_id, every doc_id below those added before."""
        counted = self.scratch.cut_sorted(batch.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")), "key")
        fresh, open_ = counted, counted
        for run in self.runs():
            fresh = fresh.join(run.select("key"), "key", "left_anti")
            open_ = open_.join(run.filter(F.col("n_docs") >= self.min_docs).select("key"), "key", "left_anti")
        if not self.levels:
            self.levels.append([counted])
        else:
            fresh = self.scratch.cut_sorted(fresh, "key")
            again = open_.join(fresh.select("key"), "key", "left_anti").withColumn("keeper", F.lit(None).cast(counted.schema["keeper"].dataType))
            self.levels[0].append(self.scratch.cut_sorted(self.scratch.plain(fresh).unionByName(again), "key"))
            self.scratch.drop(counted, fresh)
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                self._compact(k)

    def _compact(self, k: int) -> None:
        old, self.levels[k] = self.levels[k], []
        if k + 1 == len(self.levels):
            self.levels.append([])
        self.levels[k + 1].append(self.scratch.cut_sorted(self._merged(old), "key"))
        self.scratch.drop(*old)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = self.scratch.plain(runs[0])
        for r in runs[1:]:
            rows = rows.unionByName(self.scratch.plain(r))
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.first("keeper", ignorenulls=True).alias("keeper"))

    def totals(self) -> DataFrame:
        return self._merged(self.runs())


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _deduplicated(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(row: docs' columns as a struct, text, n_lines, n_dropped): text has its kept lines."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")

    def key_of(line):
        stripped = F.btrim(line, F.lit(SPACES))
        return F.when(F.char_length(stripped) >= min_chars, F.unhex(F.md5(ascii_lower(stripped).cast("binary"))))

    text_id = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    named = docs.filter("doc_id is not null")
    bounds = named.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000).alias("b")).first()["b"] or []
    batch = F.lit(batches - 1)
    for b in bounds:
        batch = batch - F.when(F.col("doc_id") > b, 1).otherwise(0)
    # first the keys, then the explode: what a select makes beside a generator would carry the text along with every line
    keys = named.select("doc_id", text_id.alias("text_id"), F.transform(_lines(F.col("text")), key_of).alias("keys"))
    keys = keys.select("doc_id", "text_id", F.posexplode("keys").alias("pos", "key")).filter("key is not null")
    keys = scratch.cut(keys.withColumn("batch", batch), "keys", ["batch"])

    runs = LineRuns(spark, scratch, min_docs, fanout)
    for k in range(batches):
        runs.add(keys.filter(F.col("batch") == k).select("key", "doc_id").distinct())
    often = scratch.cut(runs.totals().filter(F.col("n_docs") >= min_docs).select("key", "keeper"), "often")
    scratch.drop(*runs.runs())

    gone = keys.join(often, "key").filter("doc_id <> keeper").groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", text_id.alias("text_id")).join(gone, ["doc_id", "text_id"], "left")
    # the lines are a column of their own: an expression inside the transform would split the text once for every line
    rows = rows.select("row", "gone", _lines(F.col("row.text")).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    joined = F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return rows.select("row", joined.alias("text"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs' columns with text replaced by its kept lines."""
    out = _deduplicated(docs, min_chars, min_docs, batches, fanout)
    return out.select(*[(F.col("text") if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3) -> DataFrame:
    out = _deduplicated(docs.select("doc_id", "text"), min_chars, min_docs, batches, fanout)
    return out.select("row.doc_id", "n_lines", "n_dropped", hex_sha256(F.col("text")).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, o.keeper IS NOT NULL AND o.keeper <> k.doc_id AS gone FROM keyed k LEFT JOIN often o USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
