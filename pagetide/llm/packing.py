"""Best-fit packing of tokenized documents into fixed-length sequences.

The plan is made over a histogram of piece lengths, never over documents:
best-fit decreasing places whole counts at a time, so the driver sees at most
`capacity` lengths however many documents there are. Documents then take the
planned slots by a join on their rank within their length.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm.common import materialize, shuffle_partitions, tidy
from pagetide.llm.vocabulary import BYTE_OF

CAPACITY = 4096
END_ID = 1
#: Characters of text that are split into words at a time.
SPLIT_CHARS = 2_000_000

# The pieces of a word are those of the tokenizer's own pattern, for these characters.
_SIMPLE, _LETTERS = "^[!-~À-ÖØ-öø-ÿ]+$", "^[a-zß-öø-ÿ]+$"
_PIECES = "('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+)"
_BLANK = re.compile("[ \n]")
_END, _STOP = "\x01", "\x02"


class WordIds:
    """Ids of a text under a tokenizer that never joins what white space parts.

    A group of texts is split and its words are numbered by Arrow, so that every
    different word of a group is merged once, and numpy puts the ids in their
    places. Words of ASCII and Latin-1 letters are merged by tiktoken from the
    same vocabulary, which is several times faster; all others go to the
    tokenizers library itself. Nothing is remembered from group to group.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        # The last byte of a piece of a word carries the mark of its end. Here the mark is a byte
        # behind it, and joining both comes before every other merge, as those ids are lowest.
        ranks = {}
        for token, i in self._tokenizer.get_vocab(with_added_tokens=False).items():
            stem = token.removesuffix("</w>")
            ranks[bytes(map(BYTE_OF.__getitem__, stem)) + _END.encode() * (stem != token)] = i
        # the marks alone stand for no id; no word that comes here has their bytes
        ranks[_END.encode()] = 1 << 30
        self._stop = ranks[_STOP.encode()]
        self._fast = tiktoken.Encoding("words", pat_str=f"[^{_END}{_STOP}]+{_END}|{_STOP}", mergeable_ranks=ranks, special_tokens={})

    def _merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all the words, where each word's begin, and how many it has."""
        simple = pc.and_not(pc.match_substring_regex(words, _SIMPLE), pc.match_substring(words, "<|"))
        lower = pc.utf8_lower(words.filter(simple))
        letters = pc.match_substring_regex(lower, _LETTERS)
        marked = pc.replace_substring_regex(lower.filter(pc.invert(letters)), _PIECES, f"\\1{_END}")
        joined = lambda x, by: by.join([*x.to_numpy(zero_copy_only=False), ""])
        text = joined(lower.filter(letters), _END + _STOP) + joined(marked, _STOP)
        ids = self._fast.encode_to_numpy(text, disallowed_special=())
        stops = np.flatnonzero(ids == self._stop)
        other = [e.ids for e in self._tokenizer.encode_batch(words.filter(pc.invert(simple)).to_pylist(), add_special_tokens=False)]
        ids = np.concatenate([ids[ids != self._stop], np.fromiter(itertools.chain.from_iterable(other), np.uint32)])
        at, of = simple.to_numpy(zero_copy_only=False), letters.to_numpy(zero_copy_only=False)
        inside = np.flatnonzero(at)
        order = np.concatenate([inside[of], inside[~of], np.flatnonzero(~at)])  # of the words, as their ids come
        n = np.concatenate([np.diff(stops, prepend=-1) - 1, np.fromiter(map(len, other), np.int64, len(other))])
        width, begin = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        width[order], begin[order] = n, np.cumsum(n) - n
        return ids, begin, width

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the texts, one behind the other, and where each text ends."""
        lists = pc.split_pattern(pa.array([text.replace("\n", " ") for text in texts], pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        ids, begin, width = self._merge(coded.dictionary)
        codes = coded.indices.to_numpy()
        n = width[codes]
        ends = np.cumsum(n)
        places = np.repeat(begin[codes] - (ends - n), n) + np.arange(ends[-1])
        return ids[places].astype("<u4", copy=False), np.append(0, ends)[lists.offsets.to_numpy()[1:]]

    def __call__(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each whole text, as unsigned 32-bit numbers.

        A long text goes in parts that end at white space, so what is held for
        it beside its ids does not grow with it, unless one word does.
        """
        group, size, parts = [], 0, []

        def flush() -> Iterator[np.ndarray]:
            nonlocal group, size
            if group:
                ids, ends = self._group([part for part, _ in group])
                for (_, last), part in zip(group, np.split(ids, ends[:-1])):
                    parts.append(part)
                    if last:
                        yield parts[0] if len(parts) == 1 else np.concatenate(parts)
                        parts.clear()
            group, size = [], 0

        for text in texts:
            at = 0
            while len(text) - at > SPLIT_CHARS and (cut := _BLANK.search(text, at + SPLIT_CHARS)):
                group.append((text[at : cut.start()], False))
                yield from flush()
                at = cut.end()
            group.append((text[at:], True))
            size += len(text) - at
            if size >= SPLIT_CHARS:
                yield from flush()
        yield from flush()


_encoders: dict[str, WordIds] = {}


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32 and ids.

    A document is its text's ids and then `end_id`; null text counts as empty,
    so every document has at least one piece. Only documents longer than
    `capacity` are cut; all their pieces but the last are full. `ids` is binary,
    little-endian unsigned 32-bit, and ids_crc32 its CRC; without `with_ids` only
    the latter is made, which a plan needs no more than. Each row is a document
    of its own, repeated doc_ids included; other columns are left out.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoders.get(tokenizer_path) or _encoders.setdefault(tokenizer_path, WordIds(tokenizer_path))
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc_id, found in zip(batch["doc_id"], encode(text or "" for text in batch["text"])):
                ids = np.append(found, end)
                for i, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((doc_id, i, at, len(own), zlib.crc32(own), *([own.tobytes()] if with_ids else [])))
            yield pd.DataFrame(rows, columns=columns)

    # ids go through pandas as text, which beside nulls would make them floating point
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = keyed.mapInPandas(tidy(pieces), "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else ""))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Gives runs (length, first rank, pieces, first sequence, pieces in each
    sequence, first offset): the pieces of a length with ranks from the first
    on go to consecutive sequences, so many to each, one behind the other.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    levels: list[int] = []
    runs, made = [], 0

    def put(residual: int, first: int, n: int) -> None:
        if residual and n:
            if residual not in room:
                room[residual] = []
                bisect.insort(levels, residual)
            room[residual].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(levels, length)
            residual = levels[i] if i < len(levels) else capacity
            each = residual // length
            if i < len(levels):
                first, n = room[residual].pop()
                if not room[residual]:
                    del room[residual], levels[i]
            else:
                n = max(1, -(-left // each))
                first, made = made, made + n
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, each, capacity - residual))
                put(residual - each * length, first, full)
                left, rank = left - full * each, rank + full * each
            if full < n and left and left < each:
                runs.append((length, rank, left, first + full, left, capacity - residual))
                put(residual - left * length, first + full, 1)
                put(residual, first + full + 1, n - full - 1)
                left = 0
            elif full < n:
                put(residual, first + full, n - full)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """Give each piece its sequence_id and gapless offset.

    `pieces` needs doc_id, piece and length (1 to capacity); other columns stay,
    but for sequence_id and offset, which are replaced. Equal pieces take any of
    the slots of their length. An empty table stays empty. The ranks of a length
    are counted in buckets and then shifted, so that a length that most
    documents share is no single task's work.
    """
    spark = pieces.sparkSession
    buckets = buckets or max(64, shuffle_partitions(spark))
    pieces = pieces.drop("sequence_id", "offset")
    spread = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")
    # ranks must not change between two looks at them, and tokenizing is not free
    pieces = materialize(pieces.withColumn("_bucket", spread), "pieces")
    counts = materialize(pieces.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "lengths")
    # at most `capacity` rows, however large the corpus
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    runs = spark.createDataFrame(
        plan(histogram, capacity), "length bigint, _rank0 bigint, _pieces bigint, _seq0 bigint, _each bigint, _off0 bigint"
    )
    before = F.coalesce(F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("length", "_bucket", before.alias("_before"))
    rank = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece")) - 1
    ranked = pieces.withColumn("_rank", rank).join(shift, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    slot = F.col("_rank") - F.col("_rank0")
    # the plan has a few runs for each length, so it can be broadcast
    return (
        ranked.join(F.broadcast(runs), "length")
        .where((slot >= 0) & (slot < F.col("_pieces")))
        .withColumn("sequence_id", F.col("_seq0") + F.floor(slot / F.col("_each")))
        .withColumn("offset", F.col("_off0") + slot % F.col("_each") * F.col("length"))
        .select(*pieces.drop("_bucket").columns, "sequence_id", "offset")
    )
