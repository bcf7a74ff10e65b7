"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A rolling hash cuts texts into chunks, so that equal passages of different
documents give equal chunks wherever they stand. Documents are brought together
by their smallest chunk hash and sorted by it, a task reuses the ids of a chunk
for every document that holds it while they are in its memo (MEMO_BYTES), and
the join of two chunks is repaired by encoding what stands around it again until
the ids agree on both sides: some letters of a run of letters, else the words.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import tidy
from pagetide.llm.vocabulary import token_bytes

#: A cut where the low bits of the rolling hash are zero: so many bytes apart on average.
MEAN_CHUNK = 512
#: Bytes under the rolling hash.
ROLL = 8
#: A cut moves up to so many bytes forward, to a place where a token surely begins.
REACH = 64
#: Limits of what a worker remembers: words, the longest of them, bytes of chunks.
MEMO_WORDS, MEMO_CHARS, MEMO_BYTES = 500_000, 48, 24_000_000

#: Letters of scripts whose places in Unicode are settled; a run of them is never split before its merges.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿΑ-ΡΣ-ώЀ-ҁא-תء-غف-يぁ-ゔァ-ヺ一-龥가-힣"
_LETTERS = re.compile(f"[{_LETTER}]+")
#: Places where a token begins in any context: a blank between two characters that are none, and behind a letter, at the
#: other kind of character here. One of the two is never ASCII but for digits, so no special token has such a place inside.
_BEGINS = re.compile(f"(?<=[!-~{_LETTER}])(?= [!-~{_LETTER}])|(?<=[^\\W\\d_A-Za-z])(?<=[{_LETTER}])(?=[0-9.,;:!?()\\n])|(?<=[{_LETTER}])(?=[、。！，：；？])|(?<=[、。！，：；？])(?=[{_LETTER}])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Bytes on either side of a join in a run of letters that are encoded again at first.
NEAR = 64
_UNEVEN = re.compile(r"\s[^\S ]|[^\S ] |  |[\0᠎​﻿]")
_PLAIN = re.compile(r"(?<=\0)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]*)(?=\0)")
_SPLIT = r"\n| ?[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,]+"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def cut_points(data: bytes, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Places inside UTF-8 data where chunks begin; they depend on the bytes just before only."""
    if len(data) <= ROLL:
        return np.empty(0, np.int64)
    # the bytes under the window as one number, at every place; its product's high bits are the hash
    windows = np.ndarray((len(data) - ROLL,), "<u8", data, strides=(1,))
    bits = np.uint64(mean.bit_length() - 1)
    cuts = []
    for at in (np.flatnonzero((windows * _FACTOR) >> (np.uint64(64) - bits) == 0) + ROLL).tolist():
        if cuts and at <= cuts[-1]:
            continue
        end = min(at + REACH, len(data))
        sure = at if _is_sure(data, at) else _sure(data, at, end, back=False)
        if sure < end:
            cuts.append(sure)
        elif data[at] & 0xC0 != 0x80:
            cuts.append(at)
    return np.array(cuts, np.int64)


def chunk_hashes(data: bytes, mean: int = MEAN_CHUNK) -> list[int]:
    """Signed 64-bit hashes of the chunks of UTF-8 data."""
    import xxhash

    ends = [0, *cut_points(data, mean).tolist(), len(data)]
    return [xxhash.xxh64_intdigest(data[a:b]) - (1 << 63) for a, b in zip(ends, ends[1:])]


class ChunkEncoder:
    """Encodes whole texts exactly as the tokenizer does, by way of shared chunks."""

    def __init__(self, path: str, mean: int = MEAN_CHUNK):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._mean = mean
        self._words: dict[str, bytes] = {"": b""}
        self._chunks: dict[bytes, np.ndarray] = {}
        self._held = 0
        self.token_bytes = token_bytes(path)
        # Plain words are merged by tiktoken from the same vocabulary, several times faster.
        ranks = {self.token_bytes[i]: i for i in self._tokenizer.get_vocab(with_added_tokens=False).values()}
        self._fast = tiktoken.Encoding("bytes", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._newline = ranks[b"\n"]
        self._length = np.array([len(x) for x in self.token_bytes], np.int64)

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        plain = _PLAIN.findall("\0".join(["", *words, ""]))
        out: dict[str, bytes] = {}
        if plain:
            ids = np.array(self._fast.encode_ordinary("\n".join([*plain, ""])), "<u4")
            ends = (4 * np.flatnonzero(ids == self._newline)).tolist()
            raw = ids.tobytes()
            out = dict(zip(plain, [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)], strict=True))
        rest = [w for w in words if w not in out]
        return out if not rest else out | dict(zip(rest, (np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch(rest, add_special_tokens=False))))

    def _plain(self, text: str) -> bytes:
        """Ids by words: a single space between two other characters begins a token, a newline is one."""
        if _UNEVEN.search(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        try:
            return b"".join(map(self._words.__getitem__, words))
        except KeyError:
            known, new = self._words, self._learn([w for w in dict.fromkeys(words) if w not in self._words])
        if len(known) + len(new) > MEMO_WORDS:
            self._words = {"": b""}
        self._words.update((w, ids) for w, ids in new.items() if len(w) <= MEMO_CHARS)
        return b"".join([new[w] if w in new else known[w] for w in words])

    def _chunk(self, data: bytes) -> np.ndarray:
        ids = self._chunks.get(data)
        if ids is None:
            ids = np.frombuffer(self._plain(data.decode()), "<u4")
            self._held += len(data) + ids.nbytes + 200
            if self._held > MEMO_BYTES:
                self._chunks, self._held = {}, len(data) + ids.nbytes + 200
            self._chunks[data] = ids
        return ids

    def _boundary(self, ids: np.ndarray, at: int) -> int | None:
        """Number of tokens in the first `at` bytes; None if a token crosses that place."""
        ends = np.cumsum(self._length[ids])
        i = int(np.searchsorted(ends, at))
        return 0 if at == 0 else i + 1 if i < len(ends) and ends[i] == at else None

    def encode(self, text: str) -> np.ndarray:
        data = text.encode()
        cuts = [0, *cut_points(data, self._mean).tolist(), len(data)]
        done: list[tuple[int, np.ndarray]] = []  # (first byte, ids); joined they encode data[:cut] exactly
        for begin, end in zip(cuts, cuts[1:]):
            ids = self._chunk(data[begin:end])
            if done and not _is_sure(data, begin):
                left, ids_at = self._repair(data, done, begin, end, ids)
                done.append((left, ids_at))
            else:
                done.append((begin, ids))
        return np.concatenate([ids for _, ids in done]) if done else np.empty(0, np.uint32)

    def _repair(self, data: bytes, done: list[tuple[int, np.ndarray]], cut: int, end: int, ids: np.ndarray) -> tuple[int, np.ndarray]:
        """Encode again from a sure boundary before the cut to one behind it; widen until both sides agree."""
        if near := self._repair_letters(data, done, cut, end, ids):
            return near
        first, last = cut, cut
        keep = skip = None
        while keep is None or skip is None:
            if keep is None:
                first = _sure(data, 0, first, back=True)
                while done and done[-1][0] > first:  # the window reaches into earlier chunks
                    begin, right = done.pop()
                    done[-1] = (done[-1][0], np.concatenate([done[-1][1], right]))
                keep = self._boundary(done[-1][1], first - done[-1][0])
            if skip is None:
                last = _sure(data, last, end, back=False)
                skip = len(ids) if last == end else self._boundary(ids, last - cut)
        begin, left = done[-1]
        done[-1] = (begin, left[:keep])
        return first, np.concatenate([np.frombuffer(self._plain(data[first:last].decode()), "<u4"), ids[skip:]])

    def _repair_letters(self, data: bytes, done: list[tuple[int, np.ndarray]], cut: int, end: int, ids: np.ndarray) -> tuple[int, np.ndarray] | None:
        """The same inside a run of letters, however long, by what stands near the cut; None where other characters are near.

        Ids of a run are those of its merges if each two neighbours are. So the
        ends of a window need one id each that the sides have there too: its
        neighbours outside are then as they were, and those inside are encoded.
        """
        near = NEAR
        right = cut + np.cumsum(self._length[ids])
        while True:
            while len(done) > 1 and done[-1][0] > cut - near:
                begin, own = done.pop()
                done[-1] = (done[-1][0], np.concatenate([done[-1][1], own]))
            begin, left = done[-1]
            starts = begin + np.cumsum(self._length[left]) - self._length[left]
            k = next((k for k in range(max(int(np.searchsorted(starts, cut - near, "right")) - 1, 0), -1, -1) if data[starts[k]] & 0xC0 != 0x80), None)
            j = next((j for j in range(min(int(np.searchsorted(right, cut + near)), len(right) - 1), len(right)) if right[j] == end or data[right[j]] & 0xC0 != 0x80), None)
            if k is None or j is None:
                return None
            first, last = int(starts[k]), int(right[j])
            # three letters stand before the window, so that it does not begin in a shortened word such as 've
            before = data[max(first - 12, 0) : first].decode("utf-8", "ignore")[-3:]
            if not _LETTERS.fullmatch(data[first:last].decode()) or len(before) < 3 or not _LETTERS.fullmatch(before):
                return None
            again = np.frombuffer(self._plain(data[first:last].decode()), "<u4")
            if again[0] == left[k] and (last == end or again[-1] == ids[j]):
                done[-1] = (begin, left[:k])
                return first, np.concatenate([again, ids[j + 1 :]])
            if first == begin and len(done) == 1 and last == end:
                return None
            near *= 2

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.token_bytes[i] for i in ids.tolist()]).decode("utf-8", "replace")


def _is_sure(data: bytes, at: int) -> bool:
    """Whether a token begins here in any context, so that joined ids agree as they are."""
    return _sure(data, at - 1, at + 1, back=False) == at if 0 < at < len(data) - 1 else False


def _sure(data: bytes, low: int, high: int, back: bool) -> int:
    """A place strictly between low and high where a token begins in any context, or low or high if there is none."""
    low, high = max(low, 0), min(high, len(data))
    step = REACH
    at = high if back else low
    while low < high:
        # the next piece to look at, with a character more on either side
        begin, end = (max(low, at - step), at) if back else (at, min(high, at + step))
        first = max(begin - 4, 0)
        while first and data[first] & 0xC0 == 0x80:
            first -= 1
        text = data[first : end + 8].decode("utf-8", "ignore")
        found = [first + len(text[: m.start()].encode()) for m in _BEGINS.finditer(text)]
        found = [x for x in found if low < x < high and begin <= x <= end]
        if found:
            return found[-1] if back else found[0]
        if (begin <= low) if back else (end >= high):
            break
        at, step = (begin if back else end), 2 * step
    return low if back else high


_encoders: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    return _encoders.get(path) or _encoders.setdefault(path, ChunkEncoder(path))


def gather(docs: DataFrame) -> DataFrame:
    """doc_id (as text) and text, dealt so that documents with equal chunks meet.

    The key is the smallest chunk hash, the choice least disturbed by edits. It
    is a rebalance: copies too many for one task are split over several. Within
    a partition they are sorted by the key, so that copies follow each other.
    """

    def smallest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([min(chunk_hashes((text or "").encode())) for text in batch], dtype="int64")

    # ids go through pandas as text, which beside nulls would make them floating point
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").withColumn("_chunk", F.pandas_udf(smallest, "long")("text"))
    return keyed.hint("rebalance", "_chunk").sortWithinPartitions("_chunk").drop("_chunk")


def _typed(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast(like.schema["doc_id"].dataType))


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, little-endian unsigned 32-bit) of every whole text.

    Null text counts as empty and has no tokens. Repeated rows and doc_ids are
    encoded each; other columns are left out.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            ids = [encoder.encode(text) if text else np.empty(0, np.uint32) for text in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(x) for x in ids], "ids": [x.astype("<u4").tobytes() for x in ids]})

    return _typed(gather(docs).mapInPandas(tidy(rows), "doc_id string, n_tokens bigint, ids binary"), docs)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and text of what `encode` gives, special tokens included."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [encoder.decode(np.frombuffer(raw, "<u4")) for raw in batch["ids"]]})

    return _typed(encoded.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(tidy(rows), "doc_id string, text string"), encoded)


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: `encode` and `decode` in one pass, digests only.

    Of ids, the digest is that of their decimals joined by commas. A
    task holds the ids of one document at a time.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer_path)
        decimal = [str(i) for i in range(len(encoder.token_bytes))]
        for batch in batches:
            out = []
            for text in batch["text"]:
                ids = encoder.encode(text) if text else np.empty(0, np.uint32)
                listed = ",".join(map(decimal.__getitem__, ids.tolist()))
                out.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids).encode()).hexdigest()))
            digests = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            digests.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield digests

    return _typed(gather(docs).mapInPandas(tidy(rows), "doc_id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"), docs)
