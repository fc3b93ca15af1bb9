import numpy as np
import pytest

from lodestream.llm import embedding_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n_links int"


def rows_with_groups():
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist(), int(k % 3)) for k in range(150)]
    base = rng.normal(size=8)
    rows += [(200 + k, (base + rng.normal(size=8) * 0.09).tolist(), 1) for k in range(60)]
    rows += [(300 + k, base.tolist(), 1) for k in range(20)] + [(330, (2 * base).tolist(), 1), (331, base.tolist(), 2), (332, base.tolist(), None)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [None] + [1.0] * 7, 1), (404, [float("inf")] * 8, 1), (405, [], 1), (406, [1.0] * 4, 1), (407, [2.0] * 4, 1)]
    return [(*r, "clash", 7) for r in rows]


def brute_links(rows, threshold):
    ok = {}
    for i, e, label, *_ in rows:
        if e is not None and label is not None and len(e) and all(x is not None and np.isfinite(x) for x in e) and any(e):
            ok[i] = (np.array(e, np.float32).astype(float), label)
    links = {i: set() for i, *_ in rows}
    for a, (x, la) in ok.items():
        for b, (y, lb) in ok.items():
            if a != b and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a].add(b)
    return links


def components(links):
    comp = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for a, bs in links.items():
            m = min([comp[a], *(comp[b] for b in bs)])
            if m < comp[a]:
                comp[a], changed = m, True
    return comp


@pytest.mark.parametrize("block", [16, 2048])
def test_links_and_components(spark, block):
    rows = rows_with_groups()
    got = {r.vec_id: r for r in embedding_dedup.link_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()}
    links = brute_links(rows, 0.98)
    comp = components(links)
    assert len(got) == len(rows)
    for i in links:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), comp[i], comp[i] == i)


def test_cover_tree_pairs():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(60, 3)), rng.normal(size=(1, 3)) + rng.normal(size=(60, 3)) * 0.02])
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = embedding_dedup.CoverTree(x)
    assert sorted(t.order) == list(range(len(x)))
    seen = set()
    for kind, a, b in embedding_dedup.near_pairs(t, t, 0.2):
        pairs = zip(a, b, strict=True) if kind == "pairs" else [(i, j) for i in range(t.lo[a], t.hi[a]) for j in range(t.lo[b], t.hi[b]) if a != b or i < j]
        for i, j in pairs:
            if i != j:
                key = frozenset((int(t.order[i]), int(t.order[j])))
                seen.add(key)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    assert {frozenset((i, j)) for i in range(len(x)) for j in range(i) if d[i, j] <= 0.2} <= seen


def test_empty_vectors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert embedding_dedup.link_vectors(empty).count() == 0
    assert topk.top_k(empty).count() == 0


def brute_top(rows, every, k):
    ok = {}
    for i, e, *_ in rows:
        if e and all(x is not None and np.isfinite(x) for x in e):
            ok[i] = [int(np.floor(256 * float(np.float32(x)))) for x in e]
    out = []
    for q in (i for i in ok if i % every == 0):
        score = sorted((-sum(a * b for a, b in zip(ok[q], ok[c], strict=False)), c) for c in ok if c != q)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(score[:k])]
    return sorted(out)


@pytest.mark.parametrize("lists, heads, query_block", [(2, 16, 4096), (3, 1, 2), (1, 5, 1)])
def test_top_k_with_ties(spark, lists, heads, query_block):
    rows = rows_with_groups()
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), lists=lists, heads=heads, query_block=query_block).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 50, 5)


def test_top_k_of_large_groups_and_negative_scores(spark):
    rng = np.random.default_rng(5)
    hot = rng.normal(size=6)
    rows = [(k, hot.tolist(), 0, "", 0) for k in range(0, 300, 2)] + [(1000 + k, (hot + rng.normal(size=6) * 0.01).tolist(), 0, "", 0) for k in range(300)]
    rows += [(5000, (-hot).tolist(), 0, "", 0), (5050, (-hot * 2).tolist(), 0, "", 0)] + [(100, hot.tolist(), 0, "", 0)] * 3
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(list({r[0]: r for r in rows}.values()), 50, 5)
    alone = [(50 * k, [-1.0 * (k % 2 * 2 - 1), 0.5 * k], 0, "", 0) for k in range(6)] + [(1, [-9.0, -9.0], 0, "", 0)]
    got = topk.top_k(spark.createDataFrame(alone, SCHEMA)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(alone, 50, 5)


def test_repeated_vectors_count_once(spark):
    rows = [(1, [1.0, 0.0], 1, "", 0)] * 3 + [(2, [2.0, 0.0], 1, "", 0)] * 2 + [(None, [1.0, 0.0], 1, "", 0), (3, [0.0, 1.0], 1, "", 0)]
    got = embedding_dedup.link_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 0, 0)] + [(1, 1, 1)] * 3 + [(2, 1, 1)] * 2 + [(3, 0, 3)]


def test_top_k_fewer_than_k_and_huge_values(spark):
    rows = [(0, [1e6, 1e30], 1, "", 0), (1, [-1e6, 1e30], 1, "", 0), (2, [3.0, 4.0], 1, "", 0)]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, (1 << 63) - 1), (2, (1 << 63) - 1)]
