import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import product
from math import isclose, log10
from types import SimpleNamespace
from zlib import crc32

import numpy as np
import pandas as pd
import pytest

from pagetide.llm import pitman

TEXTS = [
    None, "", " \t\n", "The cat sat on the mat.", "the CAT sat on the mat", "the dog sat on the cat and the dog", "a a a a a a a b", "é É ünï", "x\x0by z",
    *[" ".join("alpha beta gamma delta of the to and".split()[(i * k) % 8] for k in range(1, 40)) for i in range(1, 14)], "of the " * 700, "unseen words everywhere here",
]


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), pitman.END]


def rows():
    return [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "clash"), (None, "the null id", "clash")]


def is_held(i):
    return i is not None and crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, names string")
    model = pitman.fit(docs)
    return model, sorted((tuple(r) for r in pitman.score(docs, model).collect()), key=str)


def test_counts_and_base_equal_brute_force(fitted):
    counts = Counter(w for i, t, _ in rows() if not is_held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i, is_held(i), len(w := tokens(t)), sum(counts[x] > 0 for x in w), n, sum(log10((counts[x] + 1) / (n + v + 1)) for x in w)) for i, t, _ in rows()), key=str)
    assert [r[:5] for r in fitted[1]] == [w[:5] for w in want]
    assert all(isclose(r[5], w[5], rel_tol=1e-9) for r, w in zip(fitted[1], want))


def test_scores_follow_from_the_sampled_seatings(fitted):
    """Every cell's customers, every restaurant's and the parent's tables, and the probabilities, by dictionaries."""
    model, got = fitted
    p = model.parameters
    names = {int(h): w for _, t, _ in rows() for w, h in zip(tokens(t), pitman._word_hashes([t or ""])[0])} | {int(pitman.END): pitman.END, int(pitman.BEGIN): None}
    c, t = {}, [{} for _ in p.tables]
    for row in model.state.toPandas().itertuples():
        cells = pitman.Cells(row)
        for k, (u, w, n) in enumerate(zip(cells.context, cells.word, cells.c.tolist())):
            key = (names[int(cells.names[u])], names[int(cells.names[w])])
            assert key not in c
            c[key] = n
            for s, table in enumerate(cells.tables):
                t[s][key] = int(table[k])
    counted = Counter(x for i, text, _ in rows() if not is_held(i) for x in zip([None, *tokens(text)], tokens(text)))
    assert {k: n for k, n in c.items() if n} == dict(counted)
    assert all(1 <= s[k] <= n if n else s[k] == 0 for s in t for k, n in c.items())
    customers, total, served = Counter(), [Counter() for _ in t], [Counter() for _ in t]
    for (u, w), n in c.items():
        customers[u] += n
        for s, seats in enumerate(t):
            total[s][u] += seats[u, w]
            served[s][w] += seats[u, w]

    def probability(u, w):
        out = 0
        for s, seats in enumerate(t):
            everyone = pitman.PARENT_STRENGTH + sum(served[s].values())
            parent = (served[s][w] - p.parent_discount) / everyone if served[s][w] else (pitman.PARENT_STRENGTH + p.parent_discount * p.v) / everyone
            own = c[u, w] - p.discount * seats[u, w] if c.get((u, w)) else 0
            out += (own + (pitman.STRENGTH + p.discount * total[s][u]) * parent) / (pitman.STRENGTH + customers[u])
        return out / len(t)

    want = sorted(((i, sum(log10(probability(u, w)) for u, w in zip([None, *tokens(text)], tokens(text)))) for i, text, _ in rows()), key=str)
    scores = defaultdict(list)
    for r in got:
        scores[r[0]].append(r[6])
    for i, value in want:
        assert any(isclose(value, x, rel_tol=1e-9) for x in scores[i])
    known = [w for w in served[0] if served[0][w]]
    for u in ["the", None, "unseen", pitman.END]:
        assert isclose(sum(probability(u, w) for w in known) + probability(u, "a word of no text"), 1, rel_tol=1e-9)
    assert all(r[6] <= 0 for r in got)
    assert sum(r[6] for r in got) > sum(r[5] for r in got)


def test_gibbs_rounds_reach_the_exact_posterior():
    """Cells of one restaurant and one dish each: tables and their sizes against all partitions."""
    n, customers = 20_000, 4
    cells = pitman.Cells.__new__(pitman.Cells)
    cells.c, cells.context, cells.word = np.full(n, customers), np.arange(n), np.arange(n)
    cells.slots = cells.sizes = np.empty(0, np.int64)
    p = pitman.Parameters(0.6, 0.4, 0, 0, [9 * n])
    totals = np.stack([np.zeros(n), np.zeros(n), np.full(n, 3), np.full(n, 3)]).astype(np.int64)
    everyone = 1e9
    p.parent = lambda had, more, sample: (had - p.parent_discount) / everyone * 3e8  # fixed number of all customers
    seating = pitman.Seating(cells, totals, p, np.random.default_rng(0))
    for _ in range(60):
        seating.round()
    weights = Counter()
    for labels in product(range(customers), repeat=customers):
        if any(x > max(labels[:i], default=-1) + 1 for i, x in enumerate(labels)):
            continue  # each partition once
        weight, sizes = 1.0, Counter()
        for x in labels:
            weight *= sizes[x] - p.discount if sizes[x] else (pitman.STRENGTH + p.discount * (2 + len(sizes))) * (2 + len(sizes) - p.parent_discount) / everyone * 3e8 if len(sizes) else 1
            sizes[x] += 1
        weights[tuple(sorted(sizes.values()))] += weight
    ends = np.cumsum(seating.t)
    found = Counter(tuple(sorted(s.tolist())) for s in np.split(seating.sizes, ends[:-1]))
    assert seating.sizes.sum() == n * customers and sum(found.values()) == n
    for sizes, weight in weights.items():
        assert abs(found[sizes] / n - weight / sum(weights.values())) < 0.015, (sizes, found, weights)


def test_first_seats_use_all_customers():
    cells = pitman.Cells.__new__(pitman.Cells)
    cells.c = np.array([2, 3, 1, 0, 5000, 17, 40_000])
    cells.context = cells.word = np.arange(7)
    cells.slots = cells.sizes = np.empty(0, np.int64)
    totals = np.tile(np.array([[0], [0], [50], [50]]), 7)
    seating = pitman.Seating(cells, totals, pitman.Parameters(0.7, 0.5, 100, 7, [400]), np.random.default_rng(1))
    for _ in range(5):
        seating.round()
        assert [int(x.sum()) for x in np.split(seating.sizes, np.cumsum(seating.t)[:-1])] == [2, 3, 5000, 17, 40_000] and (seating.sizes > 0).all()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert pitman.score(docs, pitman.fit(docs)).count() == 0
    held = next(i for i in range(99) if is_held(i))
    docs = spark.createDataFrame([(held, "never learned")], "doc_id long, text string")
    assert [tuple(r) for r in pitman.score(docs, pitman.fit(docs)).collect()] == [(held, True, 3, 0, 0, 0.0, 0.0)]


def test_first_seats_are_those_of_customers_one_by_one():
    m, d = 60_000, 0.5
    each, big = np.arange(m), 10**9

    def seated(c):
        cells = SimpleNamespace(c=np.full(m, c), context=each, word=each, slots=np.empty(0, np.int64), sizes=np.empty(0, np.int64))
        totals = np.stack([np.full(m, c), np.full(m, c), np.ones(m, np.int64), np.full(m, big)])
        return pitman.Seating(cells, totals, pitman.Parameters(d, d, m, m, [2 * big]), np.random.default_rng(7))

    def exact(sizes, left):
        """Chances of all seatings, by one customer after the other."""
        if not left:
            return {tuple(sizes): 1.0}
        new = (pitman.STRENGTH + d * len(sizes)) * 0.5
        out = {}
        for k in range(len(sizes) + 1):
            after = [*sizes, 1] if k == len(sizes) else [n + (i == k) for i, n in enumerate(sizes)]
            chance = (new if k == len(sizes) else sizes[k] - d) / (sum(sizes) - d * len(sizes) + new)
            for key, p in exact(after, left - 1).items():
                out[key] = out.get(key, 0) + chance * p
        return out

    for c in (2, 4, 6):
        seating, want = seated(c), exact([1], c - 1)
        found = Counter(tuple(x.tolist()) for x in np.split(seating.sizes, np.cumsum(seating.t)[:-1]))
        assert set(found) <= set(want)
        assert all(abs(found[key] / m - p) < 5 * (p * (1 - p) / m) ** 0.5 + 1e-4 for key, p in want.items()), c


def test_cells_of_a_bucket_are_merged_in_little_memory():
    rng = np.random.default_rng(4)
    pieces, counted = [], Counter()
    for _ in range(12):
        context, word = (rng.integers(1, 3000, 40_000).astype(np.uint64) << np.uint64(50) for _ in range(2))
        _, at = np.unique(pitman._cell_keys(context, word), return_index=True)
        context, word, c = context[at], word[at], rng.integers(0, 9, len(at))
        counted.update(dict(zip(zip(context.tolist(), word.tolist()), c.tolist())))
        spelled, order = pitman._spell(context, word)
        pieces.append({"bucket": 3, **spelled, "c": pitman._put(c[order])})
    rows = pd.DataFrame(pieces)
    tracemalloc.start()
    merged = pitman._merge(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    cells = pitman.Cells(merged.iloc[0])
    found = zip(cells.names[cells.context].tolist(), cells.names[cells.word].tolist())
    assert dict(zip(found, cells.c.tolist())) == dict(counted) and len(cells.c) == len(counted)
    assert (np.diff(cells.word * len(cells.names) + cells.context) > 0).all()
    assert peak < 60 * 12 * 40_000  # bytes for each cell of a run of documents


def test_tasks_have_as_many_buckets_each(spark, monkeypatch):
    """A hash of the few numbers of buckets put several into some tasks, which sorted and fetched all of them at once."""
    monkeypatch.setattr(pitman, "BUCKET_BYTES", 500)
    monkeypatch.setattr(pitman, "TASK_BYTES", 500, raising=False)
    texts = [" ".join(f"w{(i * k * k) % 97}" for k in range(60)) for i in range(100)]
    model = pitman.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    tasks = Counter(r[0] for frame in (model.state, model.sums) for r in frame.selectExpr("input_file_name()", "coalesce(owner, bucket)" if "owner" in frame.columns else "bucket").distinct().collect())
    assert model.n_buckets >= 30 and model.n_buckets <= model.state.count() + 4 and max(tasks.values()) == 1


def test_documents_of_a_bucket_are_scored_as_they_come():
    """The entries of a bucket are not held together: twenty times as many take no more memory."""
    rng, p = np.random.default_rng(5), pitman.Parameters(0.7, 0.5, 1000, 300, [500])
    context, word = (rng.integers(1, 300, 30_000).astype(np.uint64) << np.uint64(50) for _ in range(2))
    keys, at = np.unique(pitman._cell_keys(context, word), return_index=True)
    spelled, order = pitman._spell(context[at], word[at])
    state = {"bucket": 3, **spelled, "c": pitman._put(np.ones(len(at))[order].astype(np.int64)), "tables": pitman._put(np.ones(len(at), np.int64)), "sizes": pitman._put(at[:0]), "slots": pitman._put(at[:0])}
    sums = pitman.Cells(SimpleNamespace(**state)).sums()
    model = [{**state}, {"bucket": 3, "owner": 0, "totals": pitman._put(sums.ravel())}]
    schema = ", ".join(dict.fromkeys((pitman._STATE + ", " + pitman._REPLY + ", " + pitman._ENTRIES).split(", ")))

    def frames(n):
        yield pitman._frame(model[:1], schema)
        yield pitman._frame(model[1:], schema)
        for k in range(n):
            docs, times = rng.integers(0, 50, len(keys)), rng.integers(1, 4, len(keys))
            row = {"bucket": 3, "part": f"0-{k}", "cells": pitman._put_keys(keys), "docs": pitman._put(docs), "n": pitman._put(times), "per_cell": pitman._put(np.ones(len(keys), np.int64))}
            yield pitman._frame([row], schema)

    def scored(n):
        tracemalloc.start()
        n_known = 0
        for out in pitman._score(p)(frames(n)):
            assert list(out["part"]) and set(out["bucket"]) == {3}
            n_known += sum(int(pitman._get(x).sum()) for x in out["n_known"])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n * len(keys) <= n_known <= 3 * n * len(keys)
        return peak

    scored(2)
    assert scored(100) < 1.2 * scored(5)


def alike(n, c, tables, words, d=0.6, together=False):
    """n cells of c customers, each with a context and a word of its own that have so many tables in all, and a sampler of their seats."""
    each, none = np.arange(n), np.empty(0, np.int64)
    cells = SimpleNamespace(c=np.full(n, c), context=each, word=each, slots=np.ones(n, np.int64) if together else none, sizes=np.full(n, c) if together else none)
    totals = np.stack([cells.c, cells.c, np.full(n, tables), np.full(n, words)])
    return pitman.Seating(cells, totals, pitman.Parameters(d, 0.4, n, n, [10**9]), np.random.default_rng(11))


@pytest.mark.parametrize("c, tables, words", [(3, 50, 5 * 10**7), (16, 50, 5 * 10**7), (17, 50, 5 * 10**7), (60, 8, 3 * 10**8), (1000, 50, 5 * 10**7), (1500, 600, 5 * 10**7)])
def test_cells_of_any_size_reach_the_exact_posterior(c, tables, words):
    """By the recursion of the generalized Stirling numbers: frequent cells kept three times the tables, as only one customer of a cell moved in a round."""
    n, d = 1500 if c > 100 else 6000, 0.6
    log_s, t = np.full(c + 1, -np.inf), np.arange(1, c + 1)
    log_s[1] = 0
    for k in range(1, c):
        with np.errstate(divide="ignore"):
            log_s[1:] = np.logaddexp(log_s[1:] + np.log(np.maximum(k - d * t, 0)), log_s[:-1])
    new = (pitman.STRENGTH + d * (tables - 1 + t[:-1])) * (words - 1 + t[:-1] - 0.4) / (pitman.PARENT_STRENGTH + 10**9 - 1 + t[:-1])
    log_p = log_s[1:] + np.concatenate([[0], np.cumsum(np.log(new))])
    want = np.exp(log_p - log_p.max())
    want /= want.sum()
    seating = alike(n, c, tables, words, d)
    for _ in range(pitman.BURN_IN + pitman.ROUNDS):
        seating.round()
    found = np.bincount(seating.t, minlength=c + 1)[1:] / n
    mean, spread = (want * t).sum(), ((want * t * t).sum() - (want * t).sum() ** 2) ** 0.5
    assert seating.t.sum() == len(seating.sizes) and (np.add.reduceat(seating.sizes, np.cumsum(seating.t) - seating.t) == c).all()
    assert abs(seating.t.mean() - mean) < 6 * spread / n**0.5 + 0.01 * mean, (seating.t.mean(), mean)
    assert abs(seating.t.std() - spread) < 0.15 * spread
    if spread < 4:
        assert np.abs(np.cumsum(found - want)).max() < 0.04


@pytest.mark.parametrize("c", [2, 5, 16, 17, 100, 3000])
def test_every_customer_takes_a_seat_anew_in_a_round(c, monkeypatch):
    """Where a new table is all but sure, one round leaves nobody at the table that all shared."""
    monkeypatch.setattr(pitman, "BLOCK", 70, raising=False)
    seating = alike(20, c, 10, 10, together=True)
    seating.p.parent = lambda had, more, sample: np.full(np.shape(had), 1e9)
    seating.round()
    assert (seating.t == c).all() and (seating.sizes == 1).all()
    assert (seating.of_context == 9 + c).all() and (seating.of_word == 9 + c).all() and seating.more == 20 * (c - 1)
