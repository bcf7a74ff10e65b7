"""Removal of every byte that a repeated string of a given length covers.

A sort of all suffixes would move many times the corpus. Suffixes that share a
long prefix share its smallest k-gram, so they meet in the bucket of that
k-gram (their anchor), and only there are they compared. A bucket holds the
text around each anchor once for each different surrounding; a bucket of too
many is dealt into those of longer anchors, until each is small or its strings
are anchors themselves. Prefix polynomial hashes give the hash of any stretch in
constant time; suffixes of a bucket are sorted by comparing the hash of their
common extension, and equal neighbours are verified byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import discard, materialize, shuffle_partitions, tidy

LENGTH, GRAM = 200, 48
#: Different surroundings in a bucket; one of more is dealt by longer anchors.
BUCKET = 2_000
#: Surroundings whose windows are sorted at once, more only where one bucket has more.
LOT = 2_000
#: Places of a text that are looked at together, so that memory does not grow with a text.
SLICE = 1 << 20
_ROWS = 500

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_NULL_ID = -(1 << 63)
_POSITION = np.uint64((1 << 28) - 1)
_tables: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, mod 2^64."""
    if not _tables or len(_tables[0]) < n:
        size = max(n, 1 << 16)
        steps = [np.full(size, b, np.uint64) for b in (_BASE, _INVERSE)]
        for s in steps:
            s[0] = 1
        _tables[:] = [np.multiply.accumulate(s) for s in steps]
    return _tables[0][:n], _tables[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base^i before each place; differences give the hash of any stretch."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(len(data))[0], out=out[1:])
    return out


def stretch_hashes(prefix: np.ndarray, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    return _mix((prefix[starts + length] - prefix[starts]) * _powers(len(prefix))[1][starts])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with the same anchor: first start, further starts, anchor's place, its hash.

    The anchor of a window of `length` bytes is its k-gram with the smallest
    hash, the first if there are several, and so the same in every copy.
    """
    if len(data) < length:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64),)
    prefix = prefix_hashes(np.frombuffer(data, np.uint8))
    hashes = stretch_hashes(prefix, np.arange(len(data) - gram + 1), gram)
    places = np.arange(len(hashes), dtype=np.uint64) & _POSITION
    least = _sliding_min((hashes & ~_POSITION) | places, length - gram + 1) & _POSITION
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    more = np.diff(np.append(first, len(least))) - 1
    at = (first & ~int(_POSITION)) + least[first].astype(np.int64)
    at += (at < first) * (int(_POSITION) + 1)
    return first, more, at, hashes[at]


_CLASS = ["g", "u", "v"]


def _runs(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """_d, _t, lo, more, off (from the first start to the anchor), g (hash of the anchor) and u, v (128-bit hash of all that the windows of the run cover)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            for d, t, text in zip(batch["_d"], batch["_t"], batch["text"]):
                data = text.encode()
                for begin in range(0, len(data) - length + 1, SLICE):
                    first, more, at, g = anchors(data[begin : begin + SLICE + length - 1], length, gram)
                    cover = b"".join([xxhash.xxh3_128_digest(data[begin + a : begin + a + n + length]) for a, n in zip(first.tolist(), more.tolist())])
                    uv = np.frombuffer(cover, "<i8").reshape(-1, 2)
                    yield pd.DataFrame({"_d": d, "_t": t, "lo": first + begin, "more": more, "off": at - first, "g": g.view(np.int64), "u": uv[:, 0], "v": uv[:, 1]})

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for frame in rows(batches):
            held.append(frame)
            n += len(frame)
            if n >= 50_000:
                yield pd.concat(held)
                held, n = [], 0
        if held:
            yield pd.concat(held)

    return docs.where(F.octet_length("text") >= length).select("_d", "_t", "text").mapInPandas(tidy(gathered), "_d bigint, _t bigint, lo int, more int, off int, g bigint, u bigint, v bigint")


def _around(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Pieces: the bytes that each wanted class of runs covers, cut from its first document, with off."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, classes in zip(batch["text"], batch["classes"]):
                data = text.encode()
                out += [(c["g"], c["u"], c["v"], c["off"], data[c["lo"] : c["lo"] + c["more"] + length]) for c in classes]
            yield pd.DataFrame(out, columns=[*_CLASS, "off", "bytes"])

    lists = wanted.groupBy("_d", "_t").agg(F.collect_list(F.struct(*_CLASS, "off", "lo", "more")).alias("classes"))
    return docs.select("_d", "_t", "text").dropDuplicates(["_d", "_t"]).join(lists, ["_d", "_t"]).select("text", "classes").mapInPandas(tidy(rows), "g bigint, u bigint, v bigint, off int, bytes binary")


def sort_suffixes(prefix: np.ndarray, data: np.ndarray, starts: np.ndarray, segments: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by segment and then by their first `length` bytes, and the common extension with the one before.

    A bottom-up mergesort of all segments at once. `segments` is sorted. Each
    suffix of one half finds its rank in the other half by binary search, and
    a comparison finds the common extension by binary search over prefix
    hashes, which takes log(length) steps. The first suffix of a segment has
    extension 0.
    """
    n = len(starts)
    opens = np.concatenate([[True], segments[1:] != segments[:-1]])
    begin = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
    size = np.diff(np.append(np.flatnonzero(opens), n))[np.cumsum(opens) - 1]
    inverse = _powers(len(prefix))[1]

    def extension(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a), np.int64), np.full(len(a), length, np.int64)
        at_a, at_b, back_a, back_b = prefix[a], prefix[b], inverse[a], inverse[b]
        for _ in range(length.bit_length()):
            mid = (low + high + 1) // 2
            same = (prefix[a + mid] - at_a) * back_a == (prefix[b + mid] - at_b) * back_b
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(mid - 1, low))
        return low

    def before(a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        common = extension(a, b)
        equal = common >= length
        at = np.where(equal, 0, common)
        return np.where(equal, ties, data[a + at] < data[b + at])

    order, width = np.arange(n), 1
    while (at := np.flatnonzero(size > width)).size:
        first, m = begin[at], size[at]
        local = at - first
        block = local // (2 * width) * (2 * width)
        left = local - block < width
        low = np.where(left, np.minimum(block + width, m), block)
        high = np.where(left, np.minimum(block + 2 * width, m), np.minimum(block + width, m))
        base, own = low.copy(), np.where(left, local - block, local - block - width)
        while (busy := np.flatnonzero(low < high)).size:
            mid = (low[busy] + high[busy]) // 2
            less = before(starts[order[first[busy] + mid]], starts[order[at[busy]]], ~left[busy])
            low[busy] = np.where(less, mid + 1, low[busy])
            high[busy] = np.where(less, high[busy], mid)
        merged = order.copy()
        merged[first + block + own + low - base] = order[at]
        order, width = merged, 2 * width
    shared = np.zeros(n, np.int64)
    pair = np.flatnonzero(~opens)
    shared[pair] = extension(starts[order[pair - 1]], starts[order[pair]])
    return order, shared


def repeated_starts(pieces: list[bytes], buckets: np.ndarray, anchor: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its windows also begins elsewhere in the pieces of its bucket.

    Equal windows have the anchor at the same distance, so only windows with
    that distance in common are sorted together.
    """
    lengths = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    counts = lengths - length + 1
    piece = np.repeat(np.arange(len(pieces)), counts)
    nth = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + nth
    segments = np.unique(buckets, return_inverse=True)[1][piece] * (length + 1) + anchor[piece] - nth
    by = np.argsort(segments, kind="stable")
    found = np.zeros(len(starts), bool)
    order, shared = sort_suffixes(prefix_hashes(data), data, starts[by], segments[by], length)
    order = by[order]
    alike = np.flatnonzero(shared >= length)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    for at in range(0, len(alike), 1 << 15):  # equal hashes are verified byte by byte
        x, y = order[alike[at : at + (1 << 15)] - 1], order[alike[at : at + (1 << 15)]]
        equal = (windows[starts[x]] == windows[starts[y]]).all(axis=1)
        found[x[equal]] = True
        found[y[equal]] = True
    return np.split(found, np.cumsum(counts)[:-1])


def _spans(marks: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte stretches that marked windows cover, joined where they touch."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    out: list[tuple[int, int]] = []
    for a, b in zip(edges[::2].tolist(), (edges[1::2] + length - 1).tolist()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _compare(buckets: DataFrame, length: int) -> DataFrame:
    """g, u, v and spans of the classes whose pieces repeat something within their bucket `key`."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole = held["key"] != held["key"].iat[-1]  # the last bucket may go on
            if whole.any():
                yield frame(held[whole])
                held = held[~whole]
        if held is not None and len(held):
            yield frame(held)

    def frame(rows: pd.DataFrame) -> pd.DataFrame:
        # lots of whole buckets, small enough for their windows to be sorted at once
        key, off, pieces = rows["key"].to_numpy(), rows["off"].to_numpy(), rows["bytes"].tolist()
        names = list(zip(*(rows[c].tolist() for c in (*_CLASS, "base"))))
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        out, at = [], 0
        while at < len(key):
            end = int(ends[min(np.searchsorted(ends, at + LOT), len(ends) - 1)])
            marks = repeated_starts(pieces[at:end], key[at:end], off[at:end], length)
            for (*name, base), found in zip(names[at:end], marks):
                if spans := _spans(found, length):
                    out.append((*name, [{"a": base + a, "b": base + b} for a, b in spans]))
            at = end
        return pd.DataFrame(out, columns=[*_CLASS, "spans"])

    n = shuffle_partitions(buckets.sparkSession)
    return buckets.repartition(n, "key").sortWithinPartitions("key").mapInPandas(tidy(rows), "g bigint, u bigint, v bigint, spans array<struct<a:int,b:int>>")


_PIECE = "key bigint, g bigint, u bigint, v bigint, base int, core int, wide int, off int, bytes binary"


def _longer(pieces: DataFrame, length: int) -> DataFrame:
    """Pieces of large buckets, dealt by anchors of about half the slack more.

    `core` is where a piece's anchor begins and `wide` its bytes. Windows that
    reach far enough to the right go to the bucket of the anchor that is longer
    there, all others to that of the one longer to the left; equal windows hold
    the anchor at the same place, so they go to the same bucket.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            out = []
            for g, u, v, base, core, wide, off, data in zip(*(batch[c] for c in (*_CLASS, "base", "core", "wide", "off", "bytes"))):
                slack, last = length - wide, len(data) - length
                right = (slack + 1) // 2
                left = slack - right + 1
                split = max(0, core + wide + right - length)  # the first window that holds the anchor's longer right side
                for a, b, begin, size in ((split, last, core, wide + right), (0, min(split - 1, last), core - left, wide + left)):
                    if a <= b:
                        key = xxhash.xxh64_intdigest(data[begin : begin + size]) - (1 << 63)
                        out.append((key, g, u, v, base + a, begin - a, size, off - a, data[a : b + length]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")])

    return pieces.mapInPandas(tidy(rows), _PIECE)


def _same(pieces: DataFrame, length: int) -> DataFrame:
    """As `_compare`, for buckets whose anchors are whole windows: equal ones are counted, by their bytes."""
    counted = pieces.groupBy("bytes").agg(F.count("*").alias("n")).where("n > 1").select("bytes")
    span = F.array(F.struct(F.col("base").alias("a"), (F.col("base") + length).alias("b")))
    return pieces.join(materialize(counted, "same"), "bytes").select(*_CLASS, span.alias("spans"))


def _compare_all(pieces: DataFrame, length: int, gram: int, bucket: int) -> DataFrame:
    """As `_compare`, whatever the size of a bucket."""
    found, wide = [], gram
    pieces = materialize(pieces.select(F.col("g").alias("key"), *_CLASS, F.lit(0).alias("base"), F.col("off").alias("core"), F.lit(gram).alias("wide"), "off", "bytes"), "pieces")
    while True:
        # written before they are joined, so that the join can split the pieces of a large bucket
        large = materialize(pieces.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key"), "large")
        if large.isEmpty():
            return _union([*found, _compare(pieces, length)])
        found.append(_compare(pieces.join(large, "key", "left_anti"), length))
        pieces = materialize(_longer(pieces.join(large, "key"), length), "longer")
        done = F.col("wide") >= length
        found.append(_same(pieces.where(done), length))
        pieces = pieces.where(~done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bucket: int = BUCKET) -> DataFrame:
    """_d, _t and spans (a, b), the byte stretches to remove, of documents that have any.

    What is counted by a key is written before it is joined, so that joins can
    split the rows of an anchor or a surrounding that very many documents have.
    """
    runs = materialize(_runs(docs, length, gram), "runs")
    # an anchor that occurs once covers nothing
    met = materialize(runs.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "met")
    shared = materialize(runs.join(met, "g"), "shared")
    discard(runs)
    classes = materialize(shared.groupBy(*_CLASS).agg(F.count("*").alias("n"), F.min(F.struct("_d", "_t", "lo", "more", "off")).alias("at")).select(*_CLASS, "n", "at.*"), "classes")
    whole = classes.where("n > 1").select(*_CLASS, F.array(F.struct(F.lit(0).alias("a"), (F.col("more") + length).alias("b"))).alias("spans"))
    several = materialize(classes.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "several")
    pieces = _around(docs, classes.join(several, "g"), length)
    # pieces that occur several times are covered whole, but others are still compared with them
    compared = materialize(_compare_all(pieces, length, gram, bucket), "compared")
    covered = materialize(whole.union(compared.join(classes.where("n = 1").select(*_CLASS), _CLASS)), "covered")
    placed = shared.join(covered, _CLASS).select("_d", "_t", F.explode("spans").alias("s"), "lo")
    return placed.groupBy("_d", "_t").agg(F.collect_list(F.struct((F.col("lo") + F.col("s.a")).alias("a"), (F.col("lo") + F.col("s.b")).alias("b"))).alias("spans"))


def _cut(data: bytes, spans: list) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and the bytes left."""
    end, runs, removed, kept = 0, 0, 0, []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if a > end or not runs:
            kept.append(data[end:a])
            runs, removed = runs + 1, removed + b - a
        else:
            removed += max(0, b - end)
        end = max(end, b)
    return removed, runs, b"".join([*kept, data[end:]])


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """`docs`, all columns, with the repeated strings cut from `text`.

    Each byte that a string of `length` bytes covers goes if that string also
    begins anywhere else, in the same document or another; all copies go, and
    strings are judged on the input. Adds n_bytes, n_removed, n_spans and
    kept_bytes; `text` is what is left, without characters cut in two. Null
    text counts as empty. Rows that are equal in doc_id and text are copies of
    each other. An empty table stays empty.
    """
    gram = gram or min(GRAM, max(1, length // 4))
    added = ["n_bytes", "n_removed", "n_spans", "kept_bytes"]
    docs = docs.drop(*added)
    # the row as one column, so that no name of its own meets those of the joins
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID)).alias("_d"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    keyed = keyed.withColumn("_t", F.xxhash64("text"))
    spans = materialize(repeated_spans(keyed, length, gram, bucket), "spans")

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            for at in range(0, len(texts), _ROWS):  # what is held of the results is a part of the batch
                out = []
                for text, spans in zip(texts.iloc[at : at + _ROWS], lists.iloc[at : at + _ROWS]):
                    data = text.encode()
                    n, runs, kept = _cut(data, () if spans is None else spans)
                    out.append((len(data), n, runs, kept, kept.decode("utf-8", "ignore")))
                yield pd.DataFrame(out, columns=[*added, "text"])

    def tidied(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return tidy(cut)(batches)

    # once a row: a condition on the result must not have the texts cut again
    result = F.pandas_udf(tidied, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_bytes binary, text string").asNondeterministic()
    joined = keyed.join(spans, ["_d", "_t"], "left").withColumn("_cut", result("text", "spans"))
    left = joined.select(F.col("row").withField("text", F.col("_cut.text")).alias("row"), *[f"_cut.{c}" for c in added])
    return left.select("row.*", *added)


def keep_unrepeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The columns of `docs` with repeated strings cut; documents that lose all their text go."""
    out = remove_repeated_strings(docs.select(F.struct("*").alias("row"), "doc_id", "text"), length)
    left = out.where((F.col("n_removed") == 0) | (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != ""))
    return left.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")
