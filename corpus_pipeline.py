"""A corpus pipeline: toxicity, quality, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last one returns packed pieces.
Every stage's rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import jaccard, line_dedup, packing, quality, toxicity
from lodestream.llm.common import Scratch, read
from lodestream.llm.queries import word_bpe

THRESHOLD = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold for toxicity; null and empty texts stay."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.select_rows(docs, model, lambda score: score < THRESHOLD)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the threshold for quality; null and empty texts score the model's bias, the share of good labels."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.select_rows(docs, model, lambda score: score >= THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines, n_chars made to fit; a null text becomes empty."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_ids: int = 2_000_000) -> DataFrame:
    """One row of each group of near copies, five words and a similarity of 0.8: that of smallest doc_id, of its rows the
    one of smallest text hash. Rows without doc_id or without words stay. The rows that go are told by doc_id and text; at
    most broadcast_ids of them are broadcast, more are joined."""
    groups = jaccard.jaccard_components(docs, words=5, num=80, den=100, extra=0.25, groups=True).filter("group is not null")
    scratch = Scratch(spark, "near-copies")
    row = F.struct("doc_id", "text_id")
    members = scratch.cut(groups.groupBy("group", "doc_id", "text_id").agg(F.count("*").alias("n")), "members")
    keepers = members.groupBy("group").agg(F.min(row).alias("keeper"), F.sum("n").alias("rows")).filter("rows > 1")
    told = scratch.cut(members.join(keepers, "group").select("doc_id", "text_id", "n", (row == F.col("keeper")).alias("keeps")), "told")
    small = lambda ids: F.broadcast(ids) if ids.limit(broadcast_ids + 1).count() <= broadcast_ids else ids
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"))
    kept, key = rows.join(small(told.filter("not keeps").select("doc_id", "text_id")), ["doc_id", "text_id"], "left_anti"), ["doc_id", "text_id"]
    again = told.filter("keeps and n > 1").select(*key)
    if not again.isEmpty():
        again = small(again)
        kept = kept.join(again, key, "left_anti").unionByName(kept.join(again, key, "left_semi").dropDuplicates(key))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, placed in sequences of at most 2048 tokens; a null or empty text is one id."""
    return packing.pack_documents(docs, word_bpe())


STAGES = [("toxicity", drop_toxic), ("quality classifier", keep_quality), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near_copies), ("best-fit packing", pack)]

#: SQL cannot express the two classifiers and the packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Rows that repeat, null ids and other columns pass each stage as it says; an
    empty table gives no rows."""
    docs, scratch = read(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        before, others = docs, len(Scratch.made)
        docs = scratch.cut(stage(spark, docs, sf_dir), "stage")
        for used in Scratch.made[others:]:  # what the stage wrote on its way
            used.clear()
        if hasattr(before, "_scratch_path"):
            scratch.drop(before)
    return docs
