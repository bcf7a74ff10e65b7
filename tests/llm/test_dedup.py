import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from pagetide.llm import linededup, suffixdedup

SPACE = " \t\n\x0b\x0c\r"


def brute_whole_runs(rows, min_words):
    """Lines left of each document if every repeated run of `min_words` words goes, whatever its length."""
    lines = {i: [(k, x.strip(SPACE)) for k, x in enumerate(t.split("\n")) if x.strip(SPACE)] for i, t in rows if t is not None}
    seen, gone = set(), {i: set() for i in lines}
    for i in sorted(lines):
        for a in range(len(lines[i])):
            for b in range(a + 1, len(lines[i]) + 1):
                run = tuple(x for _, x in lines[i][a:b])
                if sum(len(x.split()) for x in run) >= min_words:
                    if run in seen:
                        gone[i] |= {k for k, _ in lines[i][a:b]}
                    seen.add(run)
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows if t is not None}


def test_line_runs_equal_brute_force(spark):
    rng = random.Random(4)
    stock = [" ".join(rng.choices(["a", "b", "c", "d"], k=rng.randint(1, 4))) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([*stock, "", "  "]) for _ in range(rng.randint(0, 25)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n "), (53, rows[3][1]), (54, rows[3][1])]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, n_removed int")
    for words in (1, 5, 10):
        out = linededup.remove_repeats(docs, words)
        assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
        got = {r.doc_id: r.text for r in out.collect()}
        assert {i: got[i] for i in got if i != 50} == brute_whole_runs(rows, words)
        assert got[50] is None
    odd = docs.select("*", *[F.lit(7).alias(c) for c in ("gone", "_d", "_t", "_gd", "_gt", "row", "all", "name", "seq", "a.b")])
    for out in (linededup.remove_repeats(odd, 10), linededup.keep_worded(odd, 10)):
        assert out.where("gone = 7 AND _d = 7 AND row = 7 AND `a.b` = 7").count() == out.count() > 0
    kept = linededup.keep_worded(docs, 1)
    assert kept.columns == docs.columns and {50, 51, 52} <= {r.doc_id for r in kept.collect()}
    assert linededup.remove_repeats(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "one two three\nfour five six"), (1, "one two three\nfour five six"), (None, "one two three")], "doc_id long, text string")
    assert Counter(r.n_removed for r in linededup.remove_repeats(same, 3).collect()) == Counter([0, 1, 1])  # a null id sorts first


def brute_strings(rows, length):
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for x, before in zip(gone, b"\0" + gone) if x and not before)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_very_long_text_of_lines(spark):
    """A text of some megabytes that is mostly a copy: time grows with its lines, not with their square."""
    lines = [f"line number {i} of a text with many of them here" for i in range(60_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["own " + lines[0], *lines[1:]]))], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n) for r in linededup.remove_repeats(docs).select("*", F.length("text").alias("n")).collect()}
    assert got[1][:2] == (60_000, 0) and got[2] == (60_000, 59_999, len("own " + lines[0]))


def test_strings_equal_brute_force(spark):
    rng = random.Random(6)
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(15, 90))) for _ in range(6)]
    rows = [(i, "".join(rng.choice([*passages, "".join(rng.choice("xyzw ") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 6)))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, "a" * 300), (53, "ab" * 80), (54, "ab" * 81), (55, "x" * 19), (56, "q" * 20), (57, "r" * 20), (58, "r" * 20)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, n_spans string")
    for bucket in (suffixdedup.BUCKET, 3, 1):  # compared at once, and dealt by longer anchors
        out = suffixdedup.remove_repeated_strings(docs, length=20, gram=6, bucket=bucket)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in out.collect()}
        assert got == brute_strings(rows, 20)
    kept = suffixdedup.keep_unrepeated(docs.drop("n_spans"), 20)
    assert kept.columns == ["doc_id", "text"]
    assert suffixdedup.remove_repeated_strings(docs.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "z" * 5 + "k" * 3 + "y" * 20)] * 2 + [(None, "short")], "doc_id long, text string")
    assert sorted(r.n_removed for r in suffixdedup.remove_repeated_strings(twice, 20, 6).collect()) == [0, 28, 28]


def test_whole_runs_go_with_their_short_last_lines(spark):
    rng = random.Random(5)
    passage = " ".join(f"w{i}" for i in range(50)) + "\nof three words\nend"
    rows = [(1, f"{passage}\nfirst goes on"), (2, f"before it\n{passage}\nsecond ends"), (3, passage)]
    stock = [" ".join(rng.choices(["a", "b", "c", "d"], k=rng.randint(1, 6))) for _ in range(10)]
    rows += [(10 + i, "\n".join(rng.choice([*stock, " "]) for _ in range(rng.randint(0, 20)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for words in (1, 5, 10):
        got = {r.doc_id: r.text for r in linededup.remove_repeats(docs, words).collect()}
        assert got == brute_whole_runs(rows, words)
    # the whole run goes, also its last line of one word
    ten = "\n".join("one two three four five six seven eight nine ten".split())
    got = {r.doc_id: r.text for r in linededup.remove_repeats(spark.createDataFrame([(1, f"{ten}\nfoo\nx"), (2, f"{ten}\nfoo\ny")], "doc_id long, text string")).collect()}
    assert got == {1: f"{ten}\nfoo\nx", 2: "y"}
    kept = {r.doc_id: r.text for r in linededup.keep_worded(docs).collect()}
    assert kept[1] == rows[0][1] and kept[2] == "before it\nsecond ends" and 3 not in kept


def test_strings_of_200_bytes_around_one_hot_passage(spark):
    """A passage in every document, cut to other lengths, with and without context; at the real parameters."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    hot = text(60)
    rows = [(i, f"{text(rng.randint(0, 20))} {hot[rng.randint(0, 40) : len(hot) - rng.randint(0, 90)]} {text(rng.randint(0, 20))}") for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, hot[:199]), (201, hot[:200]), (202, "é" * 150 + hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bucket in (suffixdedup.BUCKET, 4):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept_bytes).hexdigest()) for r in suffixdedup.remove_repeated_strings(docs, bucket=bucket).collect()}
        assert got == brute_strings(rows, 200)


def test_a_long_text_goes_in_slices(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    data = text.encode()
    whole = {(int(a), int(n)) for a, n in zip(*suffixdedup.anchors(data, 20, 6)[:2])}
    cut = [(k + int(a), int(n)) for k in range(0, len(data) - 19, 500) for a, n in zip(*suffixdedup.anchors(data[k : k + 500 + 19], 20, 6)[:2])]
    assert [i for a, n in sorted(whole) for i in range(a, a + n + 1)] == [i for a, n in cut for i in range(a, a + n + 1)]
