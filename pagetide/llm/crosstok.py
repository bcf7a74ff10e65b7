"""Alignment of two tokenizers' tokens over the same bytes.

Each whole text is encoded by both tokenizers. Byte offsets where tokens of both
end, and where both next tokens are marked by a space, are anchors: they cut the
text into windows, about a word each. A window is known by its token ids alone,
so in a run of texts its alignment is worked out once for each id tuple. Inside a
window, the offsets where both tokenizers end a token make groups; the two
tokens that end there are a link. A last pass over the links gives each how
often its id pair is linked in the corpus.

Two linked tokens end at the same byte, so the bytes of one are a suffix of the
other's: the vocabularies alone bound the different pairs (`Vocabularies.pairs`,
some hundred thousand), and only their counts reach the driver and every task.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import materialize, tidy
from pagetide.llm.neardup import _mix
from pagetide.llm.vocabulary import token_bytes

#: Characters of texts that are aligned together and share a memo of windows; a longer text goes alone.
_CHARS_AT_ONCE = 600_000
#: Characters that both libraries class alike, whatever version of Unicode they hold.
_PLAIN = re.compile("[\\n\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
_B = 1 << 16  # ids of B follow those of A in a window's key
_lasting: dict[tuple[str, str, str], Vocabularies] = {}


class Vocabularies:
    """The two tokenizers, the bytes of their tokens, and the pairs that can be linked."""

    def __init__(self, byte_path: str, piece_path: str, ranks_path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(byte_path)
        self._a.encode_special_tokens = True
        self._a.no_truncation()
        self._a.no_padding()
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        # the same vocabulary, several times faster
        self._fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.bytes_a = token_bytes(byte_path)
        self.bytes_b = [self._piece(i) for i in range(self._b.get_piece_size())]
        if len(self.bytes_a) > _B or len(self.bytes_b) > _B or not all(self.bytes_b):
            raise ValueError("ids beyond 65535 or tokens without bytes")
        size = lambda tokens: np.array([len(x) for x in tokens], np.int64)
        spaced = lambda tokens: np.array([x[:1] == b" " for x in tokens])
        self.size_a, self.size_b = size(self.bytes_a), size(self.bytes_b)
        self.spaced_a, self.spaced_b = spaced(self.bytes_a), spaced(self.bytes_b)
        self.pairs = self._pairs()
        self.table = self._table()
        #: Decimal ids and what may follow them: the text of id i before sign k is at 3 * i + k.
        self.spelled = [f"{i}{sign}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for sign in ",|;"]

    def _piece(self, i: int) -> bytes:
        piece = self._b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode()

    def _pairs(self) -> np.ndarray:
        """Sorted codes (A's id * 65536 + B's id) of all pairs in which one token's bytes end the other's."""
        of_a: dict[bytes, list[int]] = {}
        of_b: dict[bytes, list[int]] = {}
        for ids, tokens in ((of_a, self.bytes_a), (of_b, self.bytes_b)):
            for i, token in enumerate(tokens):
                ids.setdefault(token, []).append(i)
        found = {a * _B + b for a, token in enumerate(self.bytes_a) for k in range(len(token)) for b in of_b.get(token[k:], ())}
        found |= {a * _B + b for b, token in enumerate(self.bytes_b) for k in range(len(token)) for a in of_a.get(token[k:], ())}
        return np.array(sorted(found), np.int64)

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in a hash table: their codes by slot, -1 where free, and their places in `pairs`."""
        slots = np.full(1 << (2 * len(self.pairs)).bit_length(), -1, np.int64)
        places = np.zeros(len(slots), np.int64)
        rest, at = np.arange(len(self.pairs)), self._slot(self.pairs, len(slots))
        while len(rest):
            free = np.flatnonzero(slots[at] < 0)
            first = free[np.unique(at[free], return_index=True)[1]]
            slots[at[first]], places[at[first]] = self.pairs[rest[first]], rest[first]
            rest, at = np.delete(rest, first), (np.delete(at, first) + 1) % len(slots)
        return slots, places

    @staticmethod
    def _slot(codes: np.ndarray, n: int) -> np.ndarray:
        return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % n

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Places of linked pairs in `pairs`."""
        slots, places = self.table
        at = self._slot(codes, len(slots))
        wrong = np.flatnonzero(slots[at] != codes)
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(slots)
            wrong = wrong[slots[at[wrong]] != codes[wrong]]
        return places[at]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and of B for each text, or None where its bytes are not those of a space and the text."""
        empty = np.empty(0, np.int64)
        of_b = self._b.encode(texts, num_threads=1)
        for text, b in zip(texts, of_b, strict=True):
            if not text:
                yield empty, empty
                continue
            whole = " " + text
            raw = whole.encode()
            if plain := _PLAIN.fullmatch(text):
                a = self._fast.encode_ordinary(whole)  # merges bytes, so it keeps them all
            else:
                a = self._a.encode(whole, add_special_tokens=False).ids
            same = (plain or b"".join(map(self.bytes_a.__getitem__, a)) == raw) and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            yield (np.array(a, np.int64), np.array(b, np.int64)) if same else None


def vocabularies(*paths: str) -> Vocabularies:
    """Those of these files and this pattern, made once in a worker."""
    return _lasting.get(paths) or _lasting.setdefault(paths, Vocabularies(*paths))


class Windows:
    """The windows of a run of texts: cut at anchors, known by their ids, each different one aligned once.

    The texts' tokens stand one behind the other. Each text begins with a space
    for both tokenizers, so its end is an anchor.
    """

    def __init__(self, v: Vocabularies, a: np.ndarray, b: np.ndarray):
        self.v, self.a, self.b = v, a, b
        ends_a, ends_b = np.cumsum(v.size_a[a]), np.cumsum(v.size_b[b])
        mark = np.zeros(ends_a[-1] + 1, np.uint8)
        mark[ends_a] = 1
        mark[ends_b] += 1
        # verified shared ends: the places of the tokens that end there
        self.last_a, self.last_b = np.flatnonzero(mark[ends_a] == 2), np.flatnonzero(mark[ends_b] == 2)
        # an anchor is the last of them, or one before two tokens that are both marked by a space
        anchor = np.ones(len(self.last_a), bool)
        anchor[:-1] = v.spaced_a[a[self.last_a[:-1] + 1]] & v.spaced_b[b[self.last_b[:-1] + 1]]
        #: By window: its last group, and the ends of its tokens.
        self.last = np.flatnonzero(anchor)
        self.to_a, self.to_b = self.last_a[self.last] + 1, self.last_b[self.last] + 1

    def _beside(self, to_a: np.ndarray, to_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
        """Cut both rows of values at these places and lay each part of A before its part of B."""
        from_b = np.concatenate([[0], to_b[:-1]])
        out = np.empty(len(of_a) + len(of_b), np.int64)
        out[np.arange(len(of_a)) + np.repeat(from_b, np.diff(to_a, prepend=0))] = of_a
        out[np.arange(len(of_b)) + np.repeat(to_a, np.diff(to_b, prepend=0))] = of_b
        return out

    def same(self) -> np.ndarray:
        """For each window, one with the same ids, the same for all such windows.

        Windows meet by a hash of their id tuples, and the tuples are compared.
        """
        ids = self._beside(self.to_a, self.to_b, self.a, self.b + _B)
        ends = self.to_a + self.to_b
        starts = np.concatenate([[0], ends[:-1]])
        lengths = ends - starts
        place = np.arange(len(ids)) - np.repeat(starts, lengths)
        hashes = np.add.reduceat(_mix((ids + (place << 17)).astype(np.uint64)), starts)
        _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
        like = first[group]
        other = ids[np.minimum(np.repeat(starts[like], lengths) + place, len(ids) - 1)] != ids
        wrong = (lengths[like] != lengths) | np.logical_or.reduceat(other, starts)
        return np.where(wrong, np.arange(len(like)), like)

    def align(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups of each window as `a1,a2|b1;a3|b2;`, the places of all links in `pairs`, and each window's number of links.

        What follows an id is the end of its group, the bar between A and B, or a comma.
        """
        like = self.same()
        wanted, memo = np.unique(like, return_inverse=True)
        after_a, after_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        after_a[self.last_a], after_b[self.last_b] = 1, 2
        spelled = self._beside(self.last_a + 1, self.last_b + 1, 3 * self.a + after_a, 3 * self.b + after_b)
        ends, n_links = self.to_a + self.to_b, np.diff(self.last, prepend=-1)
        chosen = np.zeros(len(like), bool)
        chosen[wanted] = True
        texts = list(map(self.v.spelled.__getitem__, spelled[np.repeat(chosen, np.diff(ends, prepend=0))].tolist()))
        to = np.cumsum(np.diff(ends, prepend=0)[wanted]).tolist()
        groups = ["".join(texts[s:e]) for s, e in zip([0, *to], to)]
        linked = np.flatnonzero(np.repeat(chosen, n_links))
        links = self.v.place(self.a[self.last_a[linked]] * _B + self.b[self.last_b[linked]])
        first = (np.cumsum(n_links[wanted]) - n_links[wanted])[memo]
        every = np.arange(n_links.sum()) + np.repeat(first - (np.cumsum(n_links) - n_links), n_links)
        return list(map(groups.__getitem__, memo.tolist())), links[every], n_links


def align_run(v: Vocabularies, texts: list[str]) -> Iterator[tuple[int, int, str, np.ndarray]]:
    """Numbers of tokens of A and of B, groups, and links (places in `pairs`) of each text of a run."""
    empty = np.empty(0, np.int64)
    ids = [x or (empty, empty) for x in v.encode(texts)]
    a, b = (np.concatenate([empty, *(x[k] for x in ids)]) for k in (0, 1))
    if not len(a):
        yield from ((0, 0, "", empty) for _ in texts)
        return
    windows = Windows(v, a, b)
    groups, links, n_links = windows.align()
    ends = np.searchsorted(windows.to_a, np.cumsum([len(x[0]) for x in ids]), "right")
    upto = np.concatenate([[0], np.cumsum(n_links)])[ends].tolist()
    for (own_a, own_b), s, e, s_link, e_link in zip(ids, [0, *ends.tolist()], ends.tolist(), [0, *upto], upto):
        yield len(own_a), len(own_b), "".join(groups[s:e])[:-1], links[s_link:e_link]


def _pack(links: np.ndarray) -> bytes:
    """Sorted numbers as differences, their low bytes first: small when compressed."""
    steps = np.diff(np.sort(links), prepend=0).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.int64)


def _runs(texts: list[str]) -> Iterator[list[str]]:
    run, held = [], 0
    for text in texts:
        if run and held + len(text) > _CHARS_AT_ONCE:
            yield run
            run, held = [], 0
        run.append(text)
        held += len(text)
    if run:
        yield run


def align(docs: DataFrame, *paths: str) -> DataFrame:
    """doc_id, n_a, n_b, groups (the text of the contract) and links (packed) of every whole text.

    `paths`: A's tokenizer file, B's model, A's ranks for tiktoken, and A's
    pattern. Null and empty texts, and those that a tokenizer does not give back
    byte for byte, have no tokens. Repeated rows are aligned each; other columns
    are left out. A worker holds the tokens of about _CHARS_AT_ONCE characters,
    or of one longer text.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabularies(*paths)
        for batch in batches:
            at = 0
            for run in _runs([text or "" for text in batch["text"].tolist()]):
                out = [(n_a, n_b, groups, len(links), _pack(links)) for n_a, n_b, groups, links in align_run(v, run)]
                frame = pd.DataFrame(out, columns=["n_a", "n_b", "groups", "n_links", "links"])
                frame.insert(0, "doc_id", batch["doc_id"].to_numpy()[at : at + len(run)])
                at += len(run)
                yield frame

    # ids go through pandas as text, which beside nulls would make them floating point
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = keyed.mapInPandas(tidy(rows), "doc_id string, n_a long, n_b long, groups string, n_links long, links binary")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def pair_counts(aligned: DataFrame, n_pairs: int) -> DataFrame:
    """pair (place in `pairs`) and n, its links in the whole corpus; each task sums its own first."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(n_pairs, np.int64)
        for batch in batches:
            held = [np.empty(0, np.int64)]
            for raw in batch["links"]:
                held.append(_unpack(raw)) if raw else None
            total += np.bincount(np.concatenate(held), minlength=n_pairs)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"pair": used, "n": total[used]})

    return aligned.select("links").mapInPandas(tidy(rows), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def score_links(aligned: DataFrame, *paths: str) -> DataFrame:
    """The columns of `aligned` without its links, and n_best and count_sum over them.

    The counts that reach the driver and the tasks are one number for each pair
    that the two vocabularies allow, however large the corpus.
    """
    v = vocabularies(*paths)
    found = pair_counts(aligned, len(v.pairs)).toPandas()
    counts = np.zeros(len(v.pairs), np.int64)
    counts[found["pair"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    most = np.zeros(_B, np.int64)
    np.maximum.at(most, v.pairs % _B, counts)
    best = counts == most[v.pairs % _B]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            links = [_unpack(raw) if raw else np.empty(0, np.int64) for raw in batch["links"]]
            yield batch.drop(columns="links").assign(n_best=[int(best[x].sum()) for x in links], count_sum=[int(counts[x].sum()) for x in links])

    kept = aligned.withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "links")
    scored = kept.mapInPandas(tidy(rows), f"{schema}, n_best long, count_sum long")
    return scored.withColumn("doc_id", F.col("doc_id").cast(aligned.schema["doc_id"].dataType))


def digest(docs: DataFrame, *paths: str) -> DataFrame:
    """Counts and a digest of the groups of each document, by way of one written table of links."""
    aligned = align(docs, *paths).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2(F.col("groups"), 256)).otherwise(F.lit(""))).drop("groups")
    scored = score_links(materialize(aligned, "links"), *paths)
    # one link to each group, as both tokens end where the group does
    return scored.select("doc_id", "n_a", "n_b", F.col("n_links").alias("n_groups"), "n_links", "n_best", "count_sum", "groups_sha256")
