import random
import time

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagetide.llm import bpe, packing

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  a", "a  b\t c\n\n d", "<|endoftext|>x <|endoftext|> y", "汉字" * 900, "é" * 700, "a" * 3000, "I'm you'll  we're 's 's\r\n x", "a　b c d", "x y \x1c z",
    "é ﬁ Å", "a\x01b \x01", "ab. ab.. ab., x.y ÀB. İB Σας.", "\n a", "a\nb\n", "tab\tand nul\0 byte",
]


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("ab .,'st\n \t1é漢　<|>\U0001f600") for _ in range(rng.randint(0, 500))) for _ in range(300)]


def test_words_equal_the_library():
    library = Tokenizer.from_file(WORDS)
    for text, raw in zip(texts(), packing.WordIds(WORDS)(texts()), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]


def test_chunks_equal_the_library(monkeypatch):
    library = Tokenizer.from_file(BYTES)
    monkeypatch.setattr(bpe, "REACH", 3)  # so that many cuts fall inside words
    encoder = bpe.ChunkEncoder(BYTES, mean=16)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text).tolist() == ids, text[:50]
        assert encoder.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_long_texts_without_spaces_between_ascii(monkeypatch):
    library, rng = Tokenizer.from_file(BYTES), random.Random(8)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randint(1, 12)))
    scripts = {
        "cyrillic": " ".join(word("абвгдеёжзиклмнопрстуя") for _ in range(9000)),
        "chinese": "".join(word("汉字的一是不了人我在有他这为之大来以个中上") + rng.choice("，。！？") for _ in range(9000)),
        "one run": "".join(rng.choices("汉字的一是不了人我在有他", k=30_000)),
        "letters": "".join(rng.choices("acgt", k=60_000)),
        "same": "я" * 20_000,
        "base64": "".join(rng.choices("ABCDEFabcdefghijklmnopqrstuvwxyz0123456789+/", k=60_000)),
        "mixed": "".join(rng.choice(["'ve", "'s", " ", "  ", "x", "я", "，", "汉", "7", "\u3000", "\u00a0", "<|endoftext|>", "\n", ".", "'"]) for _ in range(30_000)),
    }
    for mean, reach in ((512, 64), (16, 3)):
        monkeypatch.setattr(bpe, "REACH", reach)
        for name, text in scripts.items():
            assert bpe.ChunkEncoder(BYTES, mean=mean).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, name


def test_time_is_linear_in_texts_of_any_script():
    rng = random.Random(9)
    for letters, between in (("абвгдежзиклмн", " "), ("汉字的一是不了人我", "，"), ("汉字的一是不了人我", ""), ("acgt", "")):
        text = between.join("".join(rng.choices(letters, k=6)) for _ in range(60_000))
        seconds = []
        for part in (text[: len(text) // 4], text):
            began = time.process_time()
            bpe.ChunkEncoder(BYTES).encode(part)
            seconds.append(time.process_time() - began)
        assert seconds[1] < 10 * seconds[0] + 2, (letters, between, seconds)


def test_cuts_follow_content():
    rng = random.Random(1)
    passage = " ".join(str(rng.random()) for _ in range(400)).encode()
    cuts = lambda data: {bytes(data[c : c + 20]) for c in bpe.cut_points(data)}
    assert len(cuts(passage)) > 3
    assert len(cuts(passage) - cuts(b"other words in front " + passage)) <= 1


def test_encode_and_decode_frames(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts()[:60])] + [(None, None, "x", 1), (2**60 + 1, "large id", "x", 1), (3, "same", "x", 1), (3, "same", "x", 1)], "doc_id long, text string, source string, ids int")
    encoded = bpe.encode(docs, BYTES)
    assert sorted(r.text for r in bpe.decode(encoded, BYTES).collect()) == sorted((r.text or "") for r in docs.collect())
    assert bpe.round_trip(docs, BYTES).count() == docs.count() and bpe.round_trip(docs.limit(0), BYTES).count() == 0
    assert encoded.where(F.col("doc_id") == 2**60 + 1).count() == 1
    assert {r.n_tokens for r in encoded.where("doc_id IS NULL").collect()} == {0}


def test_plan_is_best_fit():
    rng = random.Random(5)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    room, best = [], 0
    for n in sorted(lengths, reverse=True):  # best fit decreasing, one by one
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            best += 1
            room.append(100 - n)
    used = {}
    for length, _, pieces, first, each, offset in packing.plan(histogram, 100):
        for j in range(pieces):
            used.setdefault(first + j // each, []).append((offset + j % each * length, length))
    assert len(used) <= best
    check_sequences(used, 100)


def check_sequences(used, capacity):
    for slots in used.values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= capacity


def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "x"], k=rng.choice([1, 5, 5, 5, 300, 5000]))), "clash") for i in range(200)]
    rows += [(900, None, "clash"), (901, "", "clash"), (1, "again", "clash"), (None, "no id", "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string")
    library = Tokenizer.from_file(WORDS)
    pieces = packing.tokenize(docs, WORDS).withColumn("crc", F.crc32("ids"))
    out = packing.pack(pieces, buckets=3).collect()
    used, whole = {}, {}
    for r in out:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        whole.setdefault(r.doc_id, []).append((r.piece, r.start, bytes(r.ids)))
    check_sequences(used, 4096)
    total = sum(r.length for r in out)
    assert len(used) <= -(-total // 4096) + 2
    for i, text, _ in rows[:201]:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        if i != 1:
            parts = sorted(whole[i])
            assert b"".join(p[2] for p in parts) == np.array(ids, "<u4").tobytes()
            assert [p[1] for p in parts] == [4096 * k for k in range(len(parts))]
    assert packing.pack(packing.tokenize(docs.limit(0), WORDS)).count() == 0


def test_copies_follow_each_other_in_a_partition(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choices("abcdefgh ", k=3000)) for _ in range(60)]
    docs = spark.createDataFrame([(i, texts[i % 60]) for i in range(300)], "doc_id long, text string")
    parts = [[r.text for r in p] for p in bpe.gather(docs).rdd.glom().collect()]
    assert sum(map(len, parts)) == 300
    for part in parts:
        assert len([text for text, before in zip(part, [None, *part]) if text != before]) == len(set(part))
