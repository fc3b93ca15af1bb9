import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import queries
from lodestream.llm.components import connected_components
from lodestream.llm.common import Scratch, bucket_of

from .. import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_duckdb(spark, name):
    oracle.check(spark, oracle.connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name])


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for _, stage in p.STAGES[:-1]:
        before = docs
        docs = Scratch(spark, "test").cut(stage(spark, docs, SF), "stage")
        assert docs.columns == columns and 0 < docs.count() <= before.count()
    placed = p.STAGES[-1][1](spark, docs, SF)
    assert placed.select("doc_id").distinct().count() == docs.count()
    # the near-copy stage keeps exactly one document of each group
    from lodestream.llm.jaccard import jaccard_components

    groups = jaccard_components(docs, words=5, num=80, den=100, extra=0.25)
    assert groups.filter("component_id <> doc_id").count() == 0


def test_stages_on_nothing(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_near_copies_keep_one_row_of_an_id(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"x{k}" for k in range(40))
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, text), (1, other), (5, other + " more")]
    for broadcast_ids in (0, 10):
        docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, text_id string, `group` int")
        got = p.drop_near_copies(spark, docs, SF, broadcast_ids=broadcast_ids)
        assert got.columns == docs.columns
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, text), (1, other), (3, None), (4, ""), (None, text)], key=str)


def test_buckets_are_those_of_spark(spark):
    ids = [0, 1, -1, 7, 1 << 32, (5 << 32) + 3, (1 << 63) - 1, -(1 << 63), *range(1000, 1100)]
    got = spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.pmod(F.hash("id"), F.lit(51)).alias("b")).collect()
    assert {r.id: r.b for r in got} == dict(zip(ids, bucket_of(np.array(ids), 51).tolist(), strict=True))


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 300)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 4000), (4000, 5000), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "cc")).collect()}
    want = {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1200)} | {4000: 4000, 5000: 4000}
    assert got == want
