import gzip
import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pagetide.llm import quality, topk, warc


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.integers(-3, 4, 8) / 16]) for i in range(300)] + [(i, [0.5] * 8) for i in range(300, 420)]
    odd = [(500, None), (501, [1.0, None]), (520, [float("nan")]), (521, [float("inf")]), (None, [1.0]), (540, []), (7, [9.0] * 8), (7, [9.0] * 8), (40, [8.0] * 8), (60, [-1.0] * 8)]
    schema = "vec_id long, embedding array<float>, rank string"
    df = spark.createDataFrame([(*v, "clash") for v in vectors + odd], schema)
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors + odd if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in whole if i % 20 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for i, v in whole if i == q for c, w in whole if c != q)[:20]
        want += [(q, k, c, -s) for k, (s, c) in enumerate(scored, 1)]
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted(want)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 1, 8192), (0, 2, 3, 8192)]
    assert topk.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0 and topk.top_k(few, F.col("vec_id") == 99).count() == 0


def test_quality_counts_equal_brute_force(spark):
    sentence = "This sentence has quite enough words in it to pass every rule."
    texts = [
        "", None, " \t\n", "one", "a b c d e a b c d e", "x " * 200, "# $ % & | < > *\n" * 3, f"{sentence}\n{sentence}\n", "\n".join([sentence, "Home | News | About", "Home", "All rights reserved."]),
        "Menu\nHome\nNews\nAbout us\nContact\n" + "short line here", "é ü w\x0bx\x0cy\rz " * 5, " ".join(f"w{i}" for i in range(3000)) + ".",
    ]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
        worded = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        base = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(worded) - len(set(worded)), len(covered))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base, t
        assert r.base_failed == (len(words) < 10 or 100 * len(covered) > 20 * len(words))
        assert not (r.base_failed and r.kept)
    assert got[8].kept and got[8].cleaned_text == sentence and not got[9].kept and got[11].kept
    assert quality.judge(docs.limit(0)).count() == 0


def test_archives(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>", "x"), (2, "http://a/2", "<p>same</p>", "x"), (5, "http://a/\r\n5", "<p>same</p>", "x"), (7, None, None, "x"), (9, "u", "", "x"), (11, "u", "WARC/1.1\r\n\r\n" * 3, "x"), (12, "u", "z" * 300_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    index = warc.archive_pages(pages)
    out = {r.page_id: r for r in warc.read_records(index).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in out.items()} == {1: ("response", None), 2: ("revisit", 5), 5: ("response", None), 7: ("revisit", 9), 9: ("response", None), 11: ("response", None), 12: ("response", None)}
    for i, _, html, _ in rows:
        payload = (html or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(payload), warc.base32_sha1(payload))
        assert out[i].payload is None or bytes(out[i].payload) == payload
    for row in index.collect():  # every record is a member of its own, and the sidecar says the same
        data = open(row.archive.removeprefix("file://"), "rb").read()
        assert gzip.decompress(data[row.offset : row.offset + row.length]).startswith(b"WARC/1.1\r\n")
        assert f'{{"offset": {row.offset}, "length": {row.length}}}' in open(row.archive.removeprefix("file://") + ".index").read()
    small = warc.mark_revisits(pages, min_bytes=5).where("refers_to IS NOT NULL").collect()
    assert [r.page_id for r in small] == [2]
    assert warc.archive_pages(pages.limit(0)).count() == 0
    assert hashlib.sha1(b"").digest() and warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
