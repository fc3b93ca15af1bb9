"""The pipeline's stages against plain versions of them, each on the stage's own input."""

import random

import corpus_pipeline as p
from lodestream.llm import quality, toxicity
from lodestream.llm.common import Scratch

from .test_text import brute_components, near_copies


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(5)) for _ in range(90)]
    shared = "this is a line of more than forty characters that repeats"
    rows = []
    for k in range(160):
        text = " ".join(rng.choice(words) for _ in range(50))
        text += " Qzxv qzxv" if k % 8 == 0 else ""
        text = " ".join(w + "!!" for w in text.split()) if k % 8 == 1 else text
        rows.append((k, f"{shared}\n{text}" if k % 3 == 0 else text))
    rows += [(1000 + k, t) for k, t in enumerate(near_copies(rng, 20, 80, 3))]
    rows += [(2000, rows[5][1]), (2001, None), (2002, ""), (2003, "one word\n\n")]
    labels = [(k, int(k % 8 != 1), int(k % 8 == 0)) for k in range(0, 160)]
    return rows, labels


def plain_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    gone = lambda i, x: len(key(x)) >= 40 and len(held[key(x)]) >= 5 and max(held[key(x)]) != i
    return sorted((i, "\n".join(x for x in (t or "").split("\n") if not gone(i, x))) for i, t in rows)


def test_stages_against_plain_versions(spark, tmp_path):
    rows, labels = corpus()
    sf = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled.write.parquet(f"{sf}/labels.parquet")
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark, "test")
    read = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=lambda r: r[0])
    stages = dict(p.STAGES)

    for name, fit, keep in (("toxicity", toxicity.fit, lambda s: s < 0.7), ("quality classifier", quality.fit, lambda s: s >= 0.7)):
        model, before = fit(docs, labelled), read(docs)
        docs = scratch.cut(stages[name](spark, docs, sf), "stage")
        assert read(docs) == [(i, t) for i, t in before if keep(model.score([t or ""])[0])]
    left = {i for i, _ in read(docs)}
    assert not any(k % 8 in (0, 1) and k < 160 for k in left) and len(left) > 120

    before = read(docs)
    docs = scratch.cut(stages["line dedup"](spark, docs, sf), "stage")
    assert read(docs) == plain_lines(before)
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    before = read(docs)
    docs = scratch.cut(stages["n-gram Jaccard join"](spark, docs, sf), "stage")
    groups = brute_components(before, 5, 80, 100)
    assert read(docs) == [(i, t) for i, t in before if groups[i][1] == i]

    placed = stages["best-fit packing"](spark, docs, sf).collect()
    assert {r.doc_id for r in placed} == {i for i, _ in read(docs)}
    assert len(p.run(spark, sf).collect()) == len(placed)
