import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagetide.llm import packing
from tests.llm.test_dedup import brute_strings, brute_whole_runs


def test_stages_keep_clean_and_drop_planted(spark, tmp_path):
    rng = random.Random(9)
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    stock = {"en": "the and of that with this from water house people after before".split(), "de": "der die und nicht mit haus wasser leute nach vor über eine".split()}

    def text(lang, n):
        return "\n".join(" ".join(rng.choices(stock[lang], k=14)).capitalize() + f" {rng.randrange(10**6)}." for _ in range(n))

    rows = [(i, text("en" if i % 2 else "de", 8), "en" if i % 2 else "de", "s", 0) for i in range(80)]
    rows += [(100 + i, rows[i][1], rows[i][2], "s", 0) for i in range(5)]  # exact copies
    near = rows[7][1].split(" ")
    near[len(near) // 2] = "other"
    rows += [(120, " ".join(near), "en", "s", 0), (130, None, None, "s", 0), (131, "123 456", None, "s", 0), (132, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    left, at = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        left = corpus_pipeline.materialize(stage(spark, left, str(tmp_path)), name)
        at[name] = {r.doc_id for r in left.select("doc_id").distinct().collect()}
        if name != "best_fit_packing":
            assert left.columns == docs.columns
    assert at["language_id"] == set(range(80)) | set(range(100, 105)) | {120}
    assert not at["line_dedup"] & set(range(100, 105)) and set(range(80)) <= at["line_dedup"]
    assert at["best_fit_packing"] == at["suffix_dedup"] and set(range(80)) - {7} <= at["suffix_dedup"]
    assert left.agg(F.sum("length")).first()[0] > 0 and base
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == left.count()


def test_stages_equal_brute_force(spark, tmp_path):
    """Counts and texts of the stages on planted long passages, against the brute force of the operators."""
    rng = random.Random(10)
    stock = "the and of that with this from water house people after before".split()

    def line(n):
        return " ".join(rng.choices(stock, k=n)).capitalize() + f" {rng.randrange(10**6)}."

    def text(n):
        return "\n".join(line(14) for _ in range(n))

    passage = f"{text(4)}\nThe short end."  # over 50 words and 200 bytes, with a last line of three words
    inner = " ".join(rng.choices(stock, k=60)) + " 31337"  # over 200 bytes inside of longer lines
    rows = [(i, text(6)) for i in range(30)]
    rows += [(30, f"{text(5)}\n{passage}\n{text(5)}"), (31, f"{text(5)}\n{passage}\n{text(5)}"), (32, passage)]
    rows += [(33, f"{text(5)}\n{line(5)} {inner} {line(5)}"), (34, f"{text(5)}\n{line(5)} {inner} {line(5)}")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def after(left, name):
        left = corpus_pipeline.materialize(dict(corpus_pipeline.STAGES)[name](spark, left, str(tmp_path)), name)
        return left, {r.doc_id: r for r in left.collect()} if name != "best_fit_packing" else left.collect()

    left, got = after(docs, "language_id")
    assert {i: r.text for i, r in got.items()} == dict(rows)
    left, got = after(left, "line_dedup")
    lined = {i: t for i, t in brute_whole_runs(rows, 10).items() if t or i != 32}
    assert lined[31] != rows[31][1] and "short end" not in lined[31]
    assert {i: r.text for i, r in got.items()} == lined and all(r.n_chars == len(r.text) for r in got.values())
    left, got = after(left, "near_dedup")
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.lower().split()) for i, t in lined.items())}
    assert all(len(a & b) < 0.7 * len(a | b) for i, a in shingles.items() for j, b in shingles.items() if i < j)
    assert {i: r.text for i, r in got.items()} == lined  # no pair is near
    left, got = after(left, "suffix_dedup")
    sums = brute_strings(lined.items(), 200)
    assert sums[33][1] >= 200 <= sums[34][1]
    assert {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in got.items()} == {i: s[3] for i, s in sums.items()}
    texts = {i: r.text for i, r in got.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())
    left, pieces = after(left, "best_fit_packing")
    lengths, crcs, places = {}, {}, {}
    for r in pieces:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
        crcs[r.doc_id] = r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids + [packing.END_ID] for i, t in texts.items()}
    assert lengths == {i: len(x) for i, x in ids.items()}
    assert crcs == {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in ids.items()}
    assert len(pieces) == len(texts) and len(places) == -(-sum(lengths.values()) // 4096)
    for spans in places.values():  # without gaps, and within a sequence
        spans.sort()
        assert spans[0][0] == 0 and sum(n for _, n in spans) <= 4096
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
