import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from pagetide.llm import crosstok
from pagetide.llm.vocabulary import token_bytes

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")] + [public_tokenizers.PATTERN]
TEXTS = [
    "The quick brown fox jumps over the lazy dog.", None, "", " ", "   two   spaces\n\n\nand lines\t tabs ", "Déjà vu naïve façade — “quotes” … ", "<|endoftext|> <s> </s> <unk> <0x41>",
    "Привет, мир! Как дела?", "你好世界，这是一个测试。", "emoji 👩‍👩‍👧 zero​width 　wide \xa0nbsp", "x", "a\0b", "▁under▁score", "no" * 400, "12345 678,90 1e5", "don't we'll I'm", "The quick brown fox jumps over the lazy dog.",
    "of the " * 3000, "thentien erth inwhtion anhe " * 50,
]


def brute(texts):
    """By the contract alone: ends of whole tokens, all pairs that share one."""
    a_file, b_file = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_file.encode_special_tokens = True
    of_a = token_bytes(PATHS[0])
    of_b = [bytes([int(p[3:5], 16)]) if b_file.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b_file.id_to_piece, range(b_file.get_piece_size())))]
    rows = []
    for text in texts:
        a = a_file.encode(f" {text or ''}", add_special_tokens=False).ids
        b = b_file.encode(text or "")
        raw = f" {text or ''}".encode()
        if not text or b"".join(of_a[i] for i in a) != raw or b"".join(of_b[i] for i in b) != raw:
            a, b = [], []
        groups, links, at_a, at_b = [], [], {}, {}
        for ids, tokens, at in ((a, of_a, at_a), (b, of_b, at_b)):
            end = 0
            for k, i in enumerate(ids):
                at[end := end + len(tokens[i])] = k
        last_a = last_b = 0
        for end in sorted(set(at_a) & set(at_b)):
            i, j = at_a[end] + 1, at_b[end] + 1
            groups.append(",".join(map(str, a[last_a:i])) + "|" + ",".join(map(str, b[last_b:j])))
            links.append((a[i - 1], b[j - 1]))
            last_a, last_b = i, j
        rows.append((len(a), len(b), ";".join(groups), links))
    count = Counter(x for r in rows for x in r[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(na, nb, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if na else "") for na, nb, g, links in rows]


def test_alignment_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, 1, 2.0) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 1, 2.0), (None, "null id", 1, 2.0)], "doc_id long, text string, n_a int, links double")
    got = crosstok.digest(docs, *PATHS).collect()
    want = brute([*TEXTS, TEXTS[0], "null id"])
    ids = [*range(len(TEXTS)), 0, None]
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *w) for i, w in zip(ids, want)), key=str)
    assert crosstok.digest(docs.limit(0), *PATHS).count() == 0


def test_any_run_gives_one_alignment():
    v = crosstok.vocabularies(*PATHS)
    texts = [t or "" for t in TEXTS] * 2
    alone = [row for t in texts for row in crosstok.align_run(v, [t])]
    for size in (2, 7, len(texts)):
        together = [row for at in range(0, len(texts), size) for row in crosstok.align_run(v, texts[at : at + size])]
        assert [(*x[:3], x[3].tolist()) for x in together] == [(*x[:3], x[3].tolist()) for x in alone]


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    v = crosstok.vocabularies(*PATHS)
    want = [x[:3] for x in crosstok.align_run(v, [TEXTS[0], TEXTS[5]])]
    monkeypatch.setattr(crosstok, "_mix", lambda x: x * 0)
    assert [x[:3] for x in crosstok.align_run(v, [TEXTS[0], TEXTS[5]])] == want


def test_packed_links_come_back():
    import numpy as np

    links = np.array([5, 5, 70_000, 3, 324_000], np.uint32)
    assert crosstok._unpack(crosstok._pack(links)).tolist() == sorted(links.tolist())
