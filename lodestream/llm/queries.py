"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, embedding_dedup, jaccard, line_dedup, packing, quality, topk, toxicity, url_filter
from .common import Scratch, read


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link_vectors(read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    messages = Scratch(spark, "turns").cut(chat.linear_messages(rows), "messages")
    return chat.digest(chat.format_trees(messages, unique=True))


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', NULL
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', NULL
), c AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(4 + 2 + 8 + length(role) + length(text)
        + 2 * length(role) + 2 * length(text)
        - length(replace(role, '\', '')) - length(replace(role, '<', '')) - length(replace(text, '\', '')) - length(replace(text, '<', ''))
        + length(role) - length(replace(role, '#', '')) + length(text) - length(replace(text, '#', ''))
        + 2 * length(role) - length(replace(role, ':', '')) - length(replace(role, chr(10), ''))) AS chars
  FROM t GROUP BY conv_id, own
)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars
FROM c
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")), 3, 1)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")), 4, 2)


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), word_bpe())


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(read(spark, sf_dir, "documents"), word_bpe())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_embedding_neardup, op2_chat_format, op3_toxicity, op4_packing, op5_bpe, op6_url_filter, op7_quality, op8_ngram_jaccard, op9_line_dedup, op10_topk)}
ORACLES = {"op8_ngram_jaccard": jaccard.ORACLE, "op1_embedding_neardup": embedding_dedup.ORACLE, "op10_topk": topk.ORACLE, "op2_chat_format": OP2_SQL, "op9_line_dedup": line_dedup.ORACLE}
