import random
import re

import numpy as np
import pandas as pd

from pagetide.llm import neardup

SCHEMA = "doc_id bigint, text string, source string, component string"


def shingles(text, size):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def brute(rows, size, percent):
    sets = {}
    for i, text, *_ in rows:
        sets[i] = shingles(text, size)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(rng.choices(words, k=60))
    for i in range(60):
        rows.append((i, " ".join(rng.choices(words, k=rng.randint(1, 120)))))
    base = rng.choices(words, k=120)
    for i in range(60, 140):  # a large group of near copies
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    for i in range(140, 180):  # unlike documents that share most of a passage
        rows.append((i, passage + " " + " ".join(rng.choices(words, k=rng.randint(5, 60)))))
    rows += [(180 + i, rows[i % 7][1].upper()) for i in range(30)]
    rows += [(300, ""), (301, None), (302, " \t\n"), (303, "one"), (304, "ONE"), (305, "É x"), (306, "é x")]
    return [(*r, "s", "clash") for r in rows]


def test_groups_equal_brute_force(spark):
    rows = corpus()
    for size in (4, 5):
        out = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.group(spark.createDataFrame(rows, SCHEMA), size).collect()}
        assert out == {i: (n, c, c == i) for i, (n, c) in brute(rows, size, 80).items()}


def test_shingles_of_whole_texts_in_any_grouping(monkeypatch):
    texts = [None, "", " \t", "Ab", "ab cD  e\x0bf\x0cg\r\nh", "É É é \x1c x \u2003 y", "a " * 400 + "b", *["w%d w%d w%d w%d w%d w%d" % tuple(range(i, i + 6)) for i in range(50)]]
    whole = [x.tolist() for x in neardup.shingle_sets(texts, 4)]
    assert [len(x) for x in whole] == [len(shingles(t, 4)) for t in texts]
    monkeypatch.setattr(neardup, "_CHARS_AT_ONCE", 10)
    assert [x.tolist() for x in neardup.shingle_sets(texts, 4)] == whole
    assert whole[3] == next(neardup.shingle_sets(["aB"], 4)).tolist()


def test_edges_of_the_input(spark):
    assert neardup.group(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a b c d e f", None, None), (1, "a b c d e f", None, None), (None, "a b c d e f", None, None), (7, "A b c d e f", None, None)]
    out = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.group(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(0, 0, True), (1, 1, True), (1, 1, True), (7, 1, False)]
    # one doc_id with two texts is one vertex, and joins what either is linked with
    rows = [(1, "a b c d e f", None, None), (9, "a b c d e f", None, None), (9, "k l m n o p", None, None), (10, "k l m n o p", None, None)]
    out = {(r.doc_id, r.component_id) for r in neardup.group(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {(1, 1), (9, 1), (10, 1)}
    kept = neardup.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "source", "component"] and [r.doc_id for r in kept.collect()] == [1]


def test_full_sets_are_made_of_likely_documents_alone(spark, monkeypatch):
    """Documents that share two sentences in five with others meet, but are out before any full set is made."""
    rng, made = random.Random(3), []
    sentences = [" ".join(f"s{k}w{i}" for i in range(20)) for k in range(6)]
    rows = [(i, " ".join(rng.sample(sentences, 2) + [f"own{i}x{k}" for k in range(60)]), "s", "c") for i in range(30)]
    rows += [(100 + i, rows[i][1] + " more", "s", "c") for i in range(3)]
    full = neardup._full_sets
    monkeypatch.setattr(neardup, "_full_sets", lambda docs, wanted, size: (made.extend(r.node for r in wanted.collect()), full(docs, wanted, size))[1])
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.group(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert out == brute(rows, 4, 80)
    assert {0, 1, 2, 100, 101, 102} <= set(made) and len(set(made)) < 12


def test_lists_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "ROUNDS", 1)
    rows = corpus(2)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.group(spark.createDataFrame(rows, SCHEMA), 4).collect()}
    assert out == brute(rows, 4, 80)


def test_common_counts_in_any_slices(monkeypatch):
    rng = np.random.default_rng(5)
    arrays = pd.Series([np.unique(rng.integers(0, 60, n)) for n in (1, 5, 40, 30, 2, 55, 9)])
    want = np.array([[len(np.intersect1d(a, b)) for b in arrays] for a in arrays])
    off = ~np.eye(len(arrays), dtype=bool)  # of itself, an array counts what others have too
    for most in (1, 30, 10**6):
        monkeypatch.setattr(neardup, "_AT_ONCE", most)
        got = np.concatenate([common for _, common in neardup._common(arrays)])
        assert (got[off] == want[off]).all() and got.shape == (7, 7)
