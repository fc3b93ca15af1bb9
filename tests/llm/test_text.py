import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import bpe, chat, jaccard, line_dedup, packing, quality, text_features, toxicity, url_filter
from lodestream.llm.common import Scratch
from lodestream.llm.queries import word_bpe
from lodestream.llm.text_features import SPACE, segments

DOCS = "doc_id long, text string, lang string, component_id int, n_lines int"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + k, t, "en", 1, 2) for k, t in enumerate(texts)], DOCS).repartition(3)


# line dedup


def brute_lines(rows, least=40, often=5):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= often and max(held[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def test_lines_against_brute_force(spark):
    rng = random.Random(4)
    pool = ["É" + "long line number %d " % k * 4 for k in range(12)] + ["short", "", "  ", "x" * 39, "y" * 40]
    texts = ["\n".join(rng.choice([str.upper, str.lower, lambda s: f" \t{s}\r"])(rng.choice(pool)) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts += [None, "", "\n", "\n\n"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(docs(spark, texts)).collect()}
    assert got == brute_lines(list(enumerate(texts)))


def test_lines_repeated_rows_and_null_ids(spark):
    line = "the same long line of more than forty characters"
    rows = [(k, line, "", 0, 0) for k in range(5)] + [(4, line, "", 0, 0), (4, "other\n" + line, "", 0, 0), (None, line, "", 0, 0)]
    got = [(r.doc_id, r.n_dropped) for r in line_dedup.digest(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=str) == sorted([(0, 1), (1, 1), (2, 1), (3, 1), (4, 0), (4, 0), (4, 0), (None, 0)], key=str)
    assert line_dedup.digest(docs(spark, [])).count() == 0


def test_lines_leave_clashing_columns_alone(spark):
    line = "the same long line of more than forty characters"
    d = spark.createDataFrame([(k, f"{line}\n{k}", k, "a", "b", "c", "d") for k in range(6)], "doc_id long, text string, _dropped long, text_id string, n_lines string, gone string, row string")
    got = line_dedup.dedup_lines(d)
    assert got.columns == d.columns
    assert sorted(tuple(r) for r in got.collect()) == [(k, f"{line}\n{k}" if k == 5 else str(k), k, "a", "b", "c", "d") for k in range(6)]


def test_runs_depend_on_the_anti_join(spark):
    # batches of falling ids; b is settled by the second batch, c by the third
    batches = [[("a", 90), ("b", 91), ("b", 92), ("c", 93)], [("b", 80), ("b", 81), ("c", 80)], [("b", 70), ("c", 71), ("d", 70)], [("b", 60), ("c", 61), ("c", 62), ("d", 60)]]
    runs = line_dedup.LineRuns(spark, Scratch(spark, "test"), min_docs=3, fanout=3)
    for rows in batches:
        runs.add(spark.createDataFrame([(k.encode(), i) for k, i in rows], "key binary, doc_id long"))
    got = {bytes(r.key): (r.n_docs, r.keeper) for r in runs.totals().collect()}
    assert got[b"a"] == (1, 90) and got[b"d"] == (2, 70)
    assert got[b"c"] == (3, 93)  # settled by the first three batches; the fourth adds nothing
    assert got[b"b"][0] >= 3 and got[b"b"][1] == 92
    assert sum(len(level) for level in runs.levels) == 2
    joined = runs.runs()[0].hint("merge").join(runs.runs()[1].select("key").hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in joined


def test_lines_of_a_very_long_text(spark):
    long = "\n".join(f"a line of a very long text, of more than forty characters, number {k % 50_000}" for k in range(100_000))
    texts = [long] + [f"a line of a very long text, of more than forty characters, number {k}" for k in (7, 7, 7, 7)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.digest(docs(spark, texts)).collect()}
    assert got == brute_lines(list(enumerate(texts)))


# Jaccard join


def brute_components(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def near_copies(rng, count, n, edits):
    base = [f"w{rng.randint(0, 400)}" for _ in range(n)]
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(n)] = f"v{rng.randint(0, 30)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("words", "num", "extra"), [(3, 90, 1.0), (5, 80, 0.25)])
def test_jaccard_against_brute_force(spark, words, num, extra):
    rng = random.Random(num)
    texts = near_copies(rng, 60, 150, 8) + near_copies(rng, 30, 60, 3) + near_copies(rng, 12, 14, 2) + near_copies(rng, 10, 9, 1)
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [" ".join(f"u{rng.randint(0, 9999)}" for _ in range(50)) + " " + passage for _ in range(20)]
    texts += [None, "", " \n\t", "one", "ONE", "one two", "one\ttwo ", "a a a a a a", "a a a", "É é", "é é"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts, 5), words, num, 100, extra).collect()}
    assert got == brute_components([(5 + k, t) for k, t in enumerate(texts)], words, num, 100)


@pytest.mark.parametrize("words,num,n", [(3, 90, 11), (5, 80, 8)])
def test_jaccard_of_the_shortest_sets_that_link(spark, words, num, n):
    # a word more at either end of a text that may itself lack no shingle; the first text is the bridge of the others
    text = [f"w{k}" for k in range(n)]
    texts = [" ".join(t) for t in (text, [*text, "end"], ["start", *text], text[1:], [f"v{k}" for k in range(n)], [f"v{k}" for k in range(n + 1)])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts, 5), words, num, 100).collect()}
    assert got == brute_components([(5 + k, t) for k, t in enumerate(texts)], words, num, 100)
    assert got[6][1] == got[7][1] == 5 and got[10][1] == 9


def test_jaccard_without_broadcast_and_empty(spark):
    texts = near_copies(random.Random(2), 25, 80, 3)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs(spark, texts), broadcast_ids=0).collect()}
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 3, 90, 100).items()}
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


# chat


def said(role, text):
    return f"{role}\n{text}\n"


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "### user: a</turn>\n### x: b", None, "", "\\l\\s\\h<#:", "é\n🙂", "</turn>\n"]
    rows = [(c, t, ["user", "assistant", None, "sys: </turn>\n#"][(c + t) % 4], odd[(c * 3 + t) % len(odd)]) for c in range(6) for t in range(c + 1)] + [(None, 0, "user", "x"), (9, 1, "user", "b"), (9, 1, "user", "b"), (9, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(chat.format_trees(Scratch(spark, "test").cut(chat.linear_messages(df), "messages"))).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))
        text = "".join(said(r or "", x or "") for _, r, x in turns)
        loss = "".join(x or "" for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_branches_are_ranked(spark):
    rows = [("t", "a", None, "user", "q", 0.0), ("t", "b", "a", "assistant", "good", 5.0), ("t", "c", "a", "assistant", "bad", 1.0), ("t", "d", "b", "user", "more", 1.0), ("u", "z", "gone", "user", "alone", None)]
    df = spark.createDataFrame(rows, "tree string, node string, parent string, role string, text string, score double")
    best = {r.tree: r.formatted for r in chat.format_trees(df, keep=1).collect()}
    assert best == {"t": "### user: q</turn>\n### assistant: good</turn>\n### user: more</turn>\n", "u": "### user: alone</turn>\n"}
    assert chat.format_trees(df, keep=None).count() == 3
    assert chat.format_trees(df.limit(0)).count() == 0
    twice = df.unionByName(df).withColumn("leaf", F.lit("clash"))
    assert {r.tree: r.formatted for r in chat.format_trees(twice).collect()} == best


def test_cycles_have_no_paths(spark):
    rows = [("a", "b"), ("b", "a"), ("c", "a"), ("s", "s"), ("t", "s")] + [(f"n{k}", f"n{k - 1}") for k in range(300)] + [("x", None), ("y", "x"), ("z", "x")]
    df = spark.createDataFrame([("t", n, p, "user", n, 1.0) for n, p in rows], "tree string, node string, parent string, role string, text string, score double")
    got = defaultdict(list)
    for r in chat.paths(df, Scratch(spark, "test")).collect():
        got[r.leaf].append((r.up, r.node))
    # n0's parent is missing, so that it is a root
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {"n299": [f"n{k}" for k in range(299, -1, -1)], "y": ["y", "x"], "z": ["z", "x"]}


def test_branches_against_brute_force(spark):
    rng = random.Random(9)
    parent = {k: (rng.randint(max(0, k - 9), k - 1) if k % 40 else None) for k in range(200)}
    tree = lambda k: k // 40
    parent = {k: p if p is not None and tree(p) == tree(k) else (None if k % 40 == 0 else tree(k) * 40) for k, p in parent.items()}
    score = {k: float(rng.randint(0, 9)) for k in parent}
    df = spark.createDataFrame([(tree(k), k, p, "user", str(k), score[k]) for k, p in parent.items()], "tree int, node long, parent long, role string, text string, score double")
    for keep in (1, 3, None):
        want = {}
        for t in range(5):
            walks = []
            for leaf in (k for k in parent if tree(k) == t and k not in parent.values()):
                walk = [leaf]
                while parent[walk[-1]] is not None:
                    walk.append(parent[walk[-1]])
                walks.append((-sum(score[k] for k in walk) / len(walk), leaf, walk))
            want |= {leaf: "".join(f"### user: {k}</turn>\n" for k in reversed(walk)) for _, leaf, walk in sorted(walks)[:keep]}
        assert {r.leaf: r.formatted for r in chat.format_trees(df, keep=keep).collect()} == want


def test_rows_without_a_conversation_stand_alone(spark):
    df = spark.createDataFrame([(None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = chat.digest(chat.format_trees(Scratch(spark, "test").cut(chat.linear_messages(df), "messages"))).collect()
    assert sorted((r.conv_id is None, r.n_turns, r.loss_chars) for r in got) == [(True, 1, 0), (True, 1, 0), (True, 1, 1)]


@pytest.mark.parametrize("mu", [0.0085, 0.5, 100.0])
def test_short_lists_of_every_length_find_the_links(spark, mu):
    rng = random.Random(21)
    shared = [[f"p{i}_{k}" for k in range(30)] for i in range(3)]  # passages that many texts hold: long lists
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(8, 60))] + rng.choice(shared) * rng.randint(0, 1)
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(t + [f"z{rng.randint(0, 9)}"] * rng.randint(0, 1)))
    texts += [" ".join(f"q{k}" for k in range(n)) for n in (11, 12, 8, 9, 2, 3)] + [None, "", "one"]
    for words, num in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs(spark, texts), words=words, num=num, mu=mu).collect()}
        assert got == brute_components(list(enumerate(texts)), words, num, 100)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    rows = [(7, a, "", 0, 0), (7, b, "", 0, 0), (3, b, "", 0, 0), (9, a + " more", "", 0, 0), (9, a + " more", "", 0, 0)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, DOCS), groups=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 28, 3), (7, 28, 3), (7, 28, 7), (9, 29, 7), (9, 29, 7)]
    assert len({r.group for r in got}) == 2


def test_shingles_of_a_very_long_text():
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 999)}" for _ in range(300_000)]
    long, short = " ".join(words).encode(), " ".join(words[:1000]).encode()
    both = list(jaccard.shingle_sets([long, short, b"", long], 3))
    assert len(both[0]) == len({tuple(words[k : k + 3]) for k in range(len(words) - 2)}) and (both[0] == both[3]).all()
    assert np.isin(both[1], both[0]).all() and not len(both[2])


# BPE and packing

ALPHABET = ["Kind", "kind***", "(x)", "A-b", "#", "a", "é", "É", ".", ",", "!", "\x1c", "\x85", "\xa0", " ", "\u200b", "\u0301", "İ", "ΣΑΣ", "ß", "1", "22", "\n", "\t", "\x0b", "\r", "'s", "'LL", "<|endoftext|>", "×", "ﬁ", "漢", "🙂", "_", "가", '"', "\x00", "SEÑOR.", "müßte***"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [None, "", "x " * 5000]


def encoded_by_the_library(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("most", [0, 30, 1 << 20])
def test_bpe_equals_the_library(spark, most):
    texts, t = odd_texts(400), bpe.tokenizer(word_bpe())
    got = {r.doc_id: r for r in bpe.digest(docs(spark, texts), word_bpe(), most=most).collect()}
    for k, x in enumerate(texts):
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == encoded_by_the_library(t, x)


def test_bpe_of_very_long_and_repeated_texts(spark):
    rng, t = random.Random(3), bpe.tokenizer(word_bpe())
    long = " ".join("".join(rng.choice("abcé,.1'") for _ in range(rng.randint(1, 9))) for _ in range(250_000))  # over a run and its segments
    texts = [long, "q" * 300_000, "z9" * 400, "z9" * 400, "z9" * 400]
    d = docs(spark, texts).unionByName(docs(spark, texts[2:], 2)).unionByName(docs(spark, [texts[2]]).withColumn("doc_id", F.lit(None).cast("long")))
    got = [(r.doc_id, (r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in bpe.digest(d, word_bpe(), most=100).collect()]
    want = [(k, encoded_by_the_library(t, x)) for k, x in enumerate(texts)]
    assert sorted(got, key=repr) == sorted(want + want[2:] + [(None, want[2][1])], key=repr)


def test_words_are_split_in_runs_and_segments_alike():
    text = " ".join(f"wörd{k},Ab <|Q{k}|>" for k in range(3000)).encode()
    words = lambda x: [b[i:j].tobytes() for b, f, l in [bpe.split_words(x)] for i, j in zip(f, l, strict=True)]  # noqa: E731, E741
    cut = [s for run in segments([text], 1000, SPACE) for _, s in run]
    assert len(cut) > 30 and b"".join(cut) == text and [w for s in cut for w in words(s)] == words(text)
    assert [[k for k, _ in run] for run in segments([b"ab cd", None, b"", b"e"], 5, SPACE)] == [[0], [1, 2, 3]]


def test_a_vocabulary_that_looks_across_words(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not bpe.splits_into_words(path) and bpe.splits_into_words(word_bpe())
    texts, t = odd_texts(60, 5), bpe.tokenizer(path)
    got = {r.doc_id: r for r in bpe.digest(docs(spark, texts), path).collect()}
    for k, x in enumerate(texts):
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == encoded_by_the_library(t, x)


def test_packing_is_whole_and_tight(spark):
    texts, t = odd_texts(150, 2) + ["word " * 3000], bpe.tokenizer(word_bpe())
    d = docs(spark, texts)
    placed = packing.pack_documents(d, word_bpe(), capacity=256)
    rows = placed.collect()
    ids = {k: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for k, x in enumerate(texts)}
    seen, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.start == r.piece * 256
        seen[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert seen == {k: len(v) for k, v in ids.items()}
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    assert len(bins) <= -(-sum(seen.values()) // 256) + 1
    whole = packing.sequences(placed, bpe.encode_documents(d, word_bpe())).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(seen.values())


def test_packing_of_nothing(spark):
    assert packing.pack_documents(docs(spark, []), word_bpe()).count() == 0


def test_packing_of_repeated_rows_and_other_columns(spark):
    rows = [(7, "same words here", "", 0, 0)] * 3 + [(None, "same words here", "", 0, 0), (8, None, "", 0, 0)]
    d = spark.createDataFrame(rows, DOCS).withColumns({"length": F.lit("clash"), "sequence_id": F.lit("clash")})
    got = packing.pack_documents(d, word_bpe(), capacity=8).collect()
    assert sorted((r.doc_id, r.length) for r in got if r.doc_id) == [(7, 4)] * 3 + [(8, 1)] and len(got) == 5
    assert len({(r.sequence_id, r.offset) for r in got}) == 5 and len({r.sequence_id for r in got}) == 3


def best_bins(lengths, capacity):
    """The fewest bins, by trying every placement."""
    best = [len(lengths)]

    def place(k, room):
        if len(room) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(room)
            return
        for i in {r: i for i, r in enumerate(room)}.values():
            if room[i] >= lengths[k]:
                place(k + 1, [*room[:i], room[i] - lengths[k], *room[i + 1 :]])
        place(k + 1, [*room, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def test_bins_against_brute_force():
    rng = random.Random(12)
    for _ in range(60):
        lengths = [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        histogram = {x: lengths.count(x) for x in lengths}
        bins = packing.minimum_bin_slack(histogram, 12)
        used = defaultdict(int)
        for one, times in bins:
            assert sum(k * n for k, n in one.items()) <= 12
            for k, n in one.items():
                used[k] += n * times
        assert used == histogram and sum(times for _, times in bins) <= best_bins(lengths, 12) + 1
        rest = {k: n for k, n in histogram.items()}
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums if s + x <= 12}
        assert sum(k * n for k, n in packing.fullest(rest, 12).items()) == max(sums)


def test_fullest_bin():
    assert sum(k * n for k, n in packing.fullest({5: 2, 4: 1, 3: 10}, 11).items()) == 11
    assert packing.minimum_bin_slack({7: 3}, 10) == [({7: 1}, 3)]


# classifiers


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(5)) for _ in range(80)]
    rows = [(k, " ".join(rng.choice(words) for _ in range(60)) + (" Qzxv" if k % 5 == 0 else ""), "", 0, 0) for k in range(400)]
    rows += [(1000, None, "", 0, 0), (1001, "", "", 0, 0), (None, "abc", "", 0, 0), (0, rows[0][1], "", 0, 0)]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, 1 - (k % 5 == 0), int(k % 5 == 0)) for k in range(400)] + [(None, 1, 1), (7777, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, toxicity.fit(d, labels), 3, 1).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert toxicity.select_rows(d, toxicity.fit(d, labels), lambda s: s < 0.7).count() < len(rows)


def test_quality_on_held_out_rows(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmno") for _ in range(4)) for _ in range(60)]
    make = lambda bad: " ".join(rng.choice(words) + ("!!" if bad else "") for _ in range(40))
    d = docs(spark, [make(k % 4 == 0) for k in range(400)] + [None, ""])
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, quality.fit(d, labels), 4, 2).collect()
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == (r.doc_id % 4 != 0) for r in held]) > 0.97


@pytest.mark.parametrize("fit", [toxicity.fit, quality.fit])
def test_classifiers_without_labels(spark, fit):
    d = docs(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 0.01 for r in toxicity.score(d, fit(d, none), 3, 1).collect())
    one = spark.createDataFrame([(0, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(d, fit(d, one), 3, 1).count() == 2
    assert toxicity.score(d.limit(0), fit(d.limit(0), one), 3, 1).count() == 0


def plain_char_counts(text, orders=(4, 5)):
    t = f" {text.lower()} "
    t = "".join(" " if ord(x) <= 32 else x for x in t)
    return {t[k : k + n] for n in orders for k in range(len(t) - n + 1)}


def test_long_texts_score_as_whole_ones():
    rng = random.Random(14)
    long = " ".join("".join(rng.choice("abcdeÉ!? ") for _ in range(rng.randint(1, 12))) for _ in range(60_000))
    nb = toxicity.NaiveBayesLinear()
    owner, bucket = nb.present([long, "abc", ""])
    one = lambda n, x: set(text_features.buckets(np.array([hash_of(x)], np.uint64) + np.uint64(n), 20).tolist())

    def hash_of(x):
        h = 0
        for ch in x:
            h = (h * int(text_features._BASE) + ord(ch) + 1) % (1 << 64)
        return h

    want = set().union(*(one(len(g), g) for g in plain_char_counts(long)))
    assert set(bucket[owner == 0].tolist()) == want and len(bucket[owner == 0]) == len(want)
    # a fit on whole texts and segments of any length give one score
    ftrl, size = quality.FollowTheLeader(), 1 << 20
    ftrl.weights, ftrl.bias = np.random.default_rng(1).normal(size=size).astype(np.float32), 0.1
    runs = [list(text_features.word_ngrams([long, "a b", long[:100]], 20, run)) for run in (1 << 12, 1 << 30)]
    counts = [sorted(zip(np.concatenate([o for o, _ in r]).tolist(), np.concatenate([b for _, b in r]).tolist(), strict=True)) for r in runs]
    assert counts[0] == counts[1]
    o, b, v = ftrl.features([long, ""])
    assert np.isclose(ftrl.score([long, ""])[0], 1 / (1 + np.exp(-(v * ftrl.weights[b]).sum() - 0.1)), atol=1e-6)


def test_fits_against_plain_versions():
    """The two classifiers against loops over dictionaries."""
    rng = random.Random(15)
    texts = ["".join(rng.choice("ab c") for _ in range(30)) + (" zzz" if k % 3 == 0 else "") for k in range(60)]
    y = np.array([float(k % 3 == 0) for k in range(60)])
    nb = toxicity.NaiveBayesLinear(min_z=2.0)
    rows = []
    for t in texts:
        rows.append(nb.present([t])[1])
    seen, pos = defaultdict(int), defaultdict(int)
    for r, label in zip(rows, y, strict=True):
        for b in r.tolist():
            seen[b] += 1
            pos[b] += label
    n, p, share = 60, y.sum(), y.mean()
    ratio = {b: np.log(((1 + pos[b]) / (2 + p)) / ((1 + c - pos[b]) / (2 + n - p))) for b, c in seen.items() if c >= 3 and abs(pos[b] - c * share) / np.sqrt(c * share * (1 - share)) >= 2}
    w, bias = dict.fromkeys(ratio, 0.0), float(np.log(share / (1 - share)))
    g2, gb2 = dict.fromkeys(ratio, 1e-6), 1e-6
    for _ in range(400):
        err = [1 / (1 + np.exp(-(sum(w[b] * ratio[b] for b in r.tolist() if b in ratio) + bias))) - label for r, label in zip(rows, y, strict=True)]
        grad = {b: 1e-4 * w[b] for b in ratio}
        for e, r in zip(err, rows, strict=True):
            for b in r.tolist():
                if b in ratio:
                    grad[b] += e * ratio[b] / n
        for b, g in grad.items():
            g2[b] += g * g
            w[b] -= 0.2 * g / np.sqrt(g2[b])
        gb2 += np.mean(err) ** 2
        bias -= 0.2 * np.mean(err) / np.sqrt(gb2)
    nb.fit(rows, y)
    want = [1 / (1 + np.exp(-(sum(w[b] * ratio[b] for b in r.tolist() if b in ratio) + bias))) for r in rows]
    assert np.allclose(nb.score(texts), want, atol=1e-4)

    ftrl = quality.FollowTheLeader(epochs=2)
    rows = []
    for t in texts:
        _, b, v = ftrl.features([t])
        rows.append((b, v))
    z, g2 = defaultdict(float), defaultdict(float)
    weight = lambda i: 0.0 if abs(z[i]) <= ftrl.l1 else (np.sign(z[i]) * ftrl.l1 - z[i]) / ((ftrl.beta + np.sqrt(g2[i])) / ftrl.alpha + ftrl.l2)
    start = np.log(share / (1 - share))
    for _ in range(2):
        for (b, v), label in zip(rows, y, strict=True):
            x = [*zip(b.tolist(), v.tolist(), strict=True), (-1, 1.0)]
            now = {i: weight(i) for i, _ in x}
            p = 1 / (1 + np.exp(-(sum(now[i] * a for i, a in x) + start)))
            for i, a in x:
                g = (p - label) * a
                z[i] += g - (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / ftrl.alpha * now[i]
                g2[i] += g * g
    ftrl.fit(rows, y)
    want = [1 / (1 + np.exp(-(sum(weight(i) * a for i, a in zip(b.tolist(), v.tolist(), strict=True)) + weight(-1) + start))) for b, v in rows]
    assert np.allclose(ftrl.score(texts), want, atol=1e-4)


# URLs


def test_url_rules_and_mined_rules(spark):
    urls = ["https://Example.COM/en/1", "http://www.example.com/en/x", "http://a.net/es/2?q=1", "http://net/fr/", "https://b.org/spam/9", "https://b.org/fine/9", "http://c.com", "http://c.com#/x", None, "nothing", "x://", "http://n.net/esx", "ftp://y.example.com/EN/"]
    pages = [(k, u, "clash") for k, u in enumerate(urls)] + [(100 + k, f"https://s{k}.org/{'spam' if k % 2 else 'fine'}/{k}", "") for k in range(200)] + [(4, urls[4], "again")]
    df = spark.createDataFrame(pages, "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(100 + k, int(k % 2 == 0), 0) for k in range(150)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = url_filter.judge(df, labels, min_support=0.05).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[0] == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.net", "/es/2", "net/es/", "block") and got[3] == ("net", "/fr/", "net/fr/", "block")
    assert got[4] == ("b.org", "/spam/9", None, "block") and got[5] == ("b.org", "/fine/9", None, "allow")
    assert got[6] == ("c.com", "", None, "allow") and got[7] == ("c.com", "", None, "allow")
    assert got[8] == ("", "", None, "allow") and got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow")
    assert got[11] == ("n.net", "/esx", None, "allow") and got[12] == ("y.example.com", "/EN/", "com/", "allow")
    assert all(got[100 + k][3] == ("block" if k % 2 else "allow") for k in range(200))


def test_a_long_url_leaves_the_rules_of_others(spark):
    # fourteen tokens that go together make 16,383 rules of full confidence; those of "spam" have 0.9
    long = lambda k: "https://x.biz/?" + "&".join(f"k{j}={k}" for j in range(12))
    rows = [(k, long(k), 0) for k in range(10)]
    rows += [(100 + k, f"https://s{k}.org/spam/{k}", int(k % 10 == 0)) for k in range(40)] + [(200 + k, f"https://s{k}.org/fine/{k}", 1) for k in range(100)]
    new = [(900, long(99)), (901, "https://new.org/spam/1"), (902, "https://new.org/fine/1")]
    df = spark.createDataFrame([r[:2] for r in rows] + new, "page_id long, url string")
    labels = spark.createDataFrame([(k, good, 0) for k, _, good in rows], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.judge(df, labels, min_support=0.05).collect()}
    assert [got[k] for k in (900, 901, 902)] == ["block", "block", "allow"]
    rules = [["a"], ["a", "b"], ["a", "b", "c"], ["b", "c"], ["c", "d", "e"]]
    left = url_filter.shortest(spark.createDataFrame([(r,) for r in rules], "tokens array<string>")).collect()
    assert sorted(r.tokens for r in left) == [["a"], ["b", "c"], ["c", "d", "e"]]


def plain_tokens(url):
    if not url or "://" not in url:
        return frozenset()
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    word = lambda mark, x: mark + ("0" if re.fullmatch("[0-9]+", x) else x)
    out = {word("h:", x) for x in host.lower().split(".") if x} | {word("p:", x) for x in re.split(r"[/._-]", path.lower()) if x}
    return frozenset(out | {"q:" + x.lower() for x in re.findall(r"[?&]([^=&#]+)", url)})


def test_mined_rules_against_brute_force(spark):
    """Every token set of every labelled URL, counted one by one, in place of FP-growth and the index."""
    from itertools import combinations

    rng = random.Random(31)
    pick = lambda *xs: rng.choice(xs)
    urls = [f"http://{pick('a', 'b', 'c')}.{pick('org', 'io')}/{pick('news', 'spam', 'x')}/{pick('7', 'win', 'y')}{pick('', '?ref=1', '?ref=1&win=2')}" for _ in range(90)] + [None, "no url"]
    bad = {k: int("spam" in (u or "") and rng.random() < 0.9 or "win=" in (u or "") and rng.random() < 0.8) for k, u in enumerate(urls) if rng.random() < 0.8}
    for least, sure, lift in ((0.05, 0.7, 1.5), (0.02, 0.9, 1.0)):
        rows = [(plain_tokens(urls[k]), b) for k, b in bad.items()]
        n, share, seen, with_bad = len(rows), sum(bad.values()) / len(rows), defaultdict(int), defaultdict(int)
        for tokens, b in rows:
            for size in range(1, len(tokens) + 1):
                for part in combinations(sorted(tokens), size):
                    seen[part] += 1
                    with_bad[part] += b
        rules = [frozenset(p) for p, c in with_bad.items() if c >= max(1, math.ceil(n * least)) and c / seen[p] >= sure and c / seen[p] / share >= lift]
        df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        labels = spark.createDataFrame([(k, 1, b) for k, b in bad.items()], "doc_id long, quality int, toxic int")
        got = {r.page_id: r.verdict for r in url_filter.judge(df, labels, rules=[], min_support=least, min_confidence=sure, min_lift=lift).collect()}
        assert rules and got == {k: "block" if any(r <= plain_tokens(u) for r in rules) else "allow" for k, u in enumerate(urls)}


def test_urls_without_labels_or_pages(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.verdict for r in url_filter.judge(df, none).collect()] == ["allow"]
    assert url_filter.judge(df.limit(0), none).count() == 0
    assert F is not None
