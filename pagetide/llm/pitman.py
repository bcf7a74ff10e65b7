"""A hierarchical Pitman-Yor language model over words, sampled on the cluster.

Every word is a context with a restaurant of its own, in which the words that
follow it are the dishes; all these restaurants share one parent, whose
customers are their tables. Seatings are sampled by Gibbs: a customer leaves its
table and takes a seat again, at a table of its dish or at a new one that its
parent serves. Texts are scored by the average of the predictive probabilities
of several sampled seatings.

A cell is a context and a word after it. Cells, not contexts or words, are dealt
to buckets by a hash of both, so that no frequent word fills a bucket. What a
restaurant or the parent needs of its cells elsewhere, sums by word, comes by an
exchange: each bucket sends its own sums to the owners of the words, which add
them up and send them back. Between two exchanges a bucket samples its cells
with its own changes and the others' sums as they were, in rounds in which every
customer of every cell takes a seat anew.

Counts and vocabulary are those of the whole training part of the corpus; only
a handful of sums over it reach the driver. Words are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from pagetide.llm.common import discard, materialize, shuffle_partitions, tidy, tidy_group, tidy_group_parts
from pagetide.llm.neardup import _CHARS_AT_ONCE, _mix, _word_hashes

#: Strength of a restaurant and of the parent; discounts come from the counts.
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
#: Rounds before the first exchange of sums, rounds after it, and after how many of these a sample is kept.
BURN_IN, ROUNDS, EVERY = 4, 6, 3
#: Parts in which the customers of a cell leave in a round, and customers that leave it together at most.
BLOCKS, BLOCK = 16, 1 << 16
#: Bytes of text for a bucket of cells, and tokens that a task counts at once.
BUCKET_BYTES, PART_TOKENS = 16_000_000, 1_200_000
#: Bytes of text from which there is a task more for the buckets; with as many tasks as buckets, each has one.
TASK_BYTES = 4_000_000
#: Documents that a worker is handed at a time, bytes of any rows, and cells that are worked on at once.
BATCH_ROWS, BATCH_BYTES, CELLS = 1000, 4_000_000, 1 << 17
#: Names of the context before the first word and of the end that follows the last.
BEGIN, END = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x5A5A5A5A5A5A5A5A)

_STATE = "bucket int, names binary, context binary, word binary, c binary, tables binary, sizes binary, slots binary"
_REPLY = "bucket int, owner int, totals binary, known long, ones long, twos long"


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text, mod 7, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows with all columns of a schema; what a row lacks is null."""
    return pd.DataFrame({name: pd.Series([row.get(name) for row in rows], dtype=object) for name in (x.split()[0] for x in schema.split(", "))})


def _put(numbers: np.ndarray) -> bytes:
    """Whole numbers, not below zero, compressed: the fewest bytes each that hold the largest, after one that says how many."""
    most = int(numbers.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + numbers.astype(f"<u{width}").tobytes())


def _get(raw: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _put_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as steps, their high bytes apart, compressed."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(planes.reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _share(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64-bit keys each is in; sorted keys give sorted ranges."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _cell_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    keys = np.empty(len(word), np.uint64)
    for s in range(0, len(word), CELLS):
        keys[s : s + CELLS] = _mix(_mix(context[s : s + CELLS]) + word[s : s + CELLS])
    return keys


def _dealt(rows: DataFrame, key: str, n_tasks: int, *then: str) -> GroupedData:
    """Rows by the number of a bucket or owner, in the order of `then`: all tasks have as many numbers, or one more.

    Dealt by a hash of so few numbers, some tasks would have several times the
    rows of others, which the executor sorts and fetches all at once.
    """
    return rows.repartitionById(n_tasks, key).sortWithinPartitions(key, *then).groupBy(key)


def _written(df: DataFrame, name: str) -> DataFrame:
    return materialize(df, name, BATCH_ROWS, BATCH_BYTES)


def _cut(places: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
    """Runs of equal numbers in sorted ones below n: number, begin and end."""
    edges = np.searchsorted(places, np.arange(n + 1)).tolist()
    for k, (s, e) in enumerate(zip(edges, edges[1:])):
        if e > s:
            yield k, s, e


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents: name, ids, held out or not, tokens of each, contexts and words of all tokens."""
    ids, held, counts, words, n, part = [], [], [], [], 0, 0

    def flush() -> tuple:
        lengths, hashes = np.concatenate(counts), np.concatenate(words)
        words.clear()
        ends = np.cumsum(lengths + 1)
        word = np.insert(hashes, np.cumsum(lengths), END)
        del hashes
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[ends - lengths - 1] = BEGIN
        return f"{TaskContext.get().partitionId() if TaskContext.get() else 0}-{part}", ids, np.array(held, bool), lengths + 1, context, word

    for batch in batches:
        texts = [text or "" for text in batch["text"].tolist()]
        at = 0
        while at < len(texts):
            to, chars = at + 1, len(texts[at])
            while to < len(texts) and chars + len(texts[to]) <= _CHARS_AT_ONCE:
                chars += len(texts[to])
                to += 1
            hashes, lengths = _word_hashes(texts[at:to])
            ids += batch["doc_id"].tolist()[at:to]
            held += batch["held_out"].tolist()[at:to]
            counts.append(lengths)
            words.append(hashes)
            n, at = n + len(hashes) + to - at, to
            if n >= PART_TOKENS:
                yield flush()
                ids, held, counts, words, n, part = [], [], [], [], 0, part + 1
    if ids:
        yield flush()


def _spell(context: np.ndarray, word: np.ndarray) -> tuple[dict, np.ndarray]:
    """Contexts and words as places in their sorted names, and the order in which the cells come: by word and context.

    Words are steps from one cell's to the next one's.
    """
    names, places = np.unique(np.concatenate([context, word]), return_inverse=True)
    context, word = places[: len(context)], places[len(context) :]
    order = np.argsort(word * len(names) + context, kind="stable")
    return {"names": _put_keys(names), "context": _put(context[order]), "word": _put(np.diff(word[order], prepend=0))}, order


def _spelled(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _keys(row.names), _get(row.context), np.cumsum(_get(row.word))


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin in sorted ones."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def _count(n_buckets: int):
    """Cells of each run of documents and how often the training documents have them; those of others count 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, held, lengths, context, word in _parts(batches):
            keys = _cell_keys(context, word)
            order = np.argsort(keys, kind="stable")
            first = _firsts(keys[order])
            c = np.add.reduceat(np.repeat(~held, lengths)[order], first, dtype=np.int64)
            at = order[first]
            del order, first
            for bucket, s, e in _cut(_share(keys[at], n_buckets), n_buckets):
                spelled, by = _spell(context[at[s:e]], word[at[s:e]])
                yield pd.DataFrame([{"bucket": bucket, **spelled, "c": _put(c[s:e][by])}])
            del context, word, keys, c, at, lengths  # not beside the next run of documents

    return count


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """The cells of a bucket, with one table each to begin with.

    A cell is one number, by the places of its word and context in all names;
    those of each run of documents ascend, as their names do.
    """
    names = np.unique(np.concatenate([_keys(x) for x in rows["names"]]))
    keys = []
    for row in rows.itertuples():
        own, context, word = _spelled(row)
        place = np.searchsorted(names, own)
        keys.append(place[word] * len(names) + place[context])
    keys, c = np.concatenate(keys), np.concatenate([_get(x) for x in rows["c"]])
    order = np.argsort(keys, kind="stable")
    keys, c = keys[order], c[order]
    del order
    first = _firsts(keys)
    c, keys = np.add.reduceat(c, first), keys[first]
    del first
    out = {"bucket": rows["bucket"].iat[0], "names": _put_keys(names), "c": _put(c), "tables": _put(np.minimum(c, 1)), "sizes": _put(c[:0]), "slots": _put(c[:0])}
    out |= {"context": _put(keys % len(names)), "word": _put(np.diff(keys // len(names), prepend=0))}
    return _frame([out], _STATE)


class Cells:
    """A bucket's cells: names, and by cell the places of its context and word, customers and tables.

    tables has a row for each kept sample. For cells of two customers and more,
    slots says how many tables they have and sizes how many customers each.
    """

    def __init__(self, row):
        self.names, self.context, self.word = _spelled(row)
        self.c = _get(row.c)
        self.tables = _get(row.tables).reshape(-1, len(self.c))
        self.sizes, self.slots = _get(row.sizes), _get(row.slots)

    def sums(self) -> np.ndarray:
        """By name: customers as a context and as a word, then the tables of either in each sample."""
        kinds = [(place, x) for x in (self.c, *self.tables) for place in (self.context, self.word)]
        out = np.empty((len(kinds), len(self.names)), np.int64)
        for k, (place, x) in enumerate(kinds):
            out[k] = np.bincount(place, x, len(self.names))
        return out


def _ask(n_owners: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                cells = Cells(row)
                names, sums = cells.names, cells.sums()
                del cells
                for owner, s, e in _cut(_share(names, n_owners), n_owners):
                    yield pd.DataFrame([{"owner": owner, "bucket": row.bucket, "names": _put_keys(names[s:e]), "sums": _put(sums[:, s:e].ravel())}])

    return ask


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """The totals of an owner's names for each bucket that asked, and counts of the names' own."""
    names = [_keys(x) for x in rows["names"]]
    every, places = np.unique(np.concatenate(names), return_inverse=True)
    names = [len(n) for n in names]
    ends, totals = np.cumsum(names), None
    for raw, n, e in zip(rows["sums"], names, ends):
        sums = _get(raw).reshape(-1, n)
        totals = np.zeros((len(sums), len(every)), np.int64) if totals is None else totals
        totals[:, places[e - n : e]] += sums  # a bucket has a name once
    known, ones, twos = (int((totals[1] > 0).sum()), *(int((totals[3] == k).sum()) for k in (1, 2)))
    return pd.DataFrame([
        {"bucket": bucket, "owner": owner, "totals": _put(totals[:, places[e - n : e]].ravel()), "known": known, "ones": ones, "twos": twos}
        for bucket, owner, n, e in zip(rows["bucket"], rows["owner"], names, ends)
    ])


def _exchange(state: DataFrame, n_buckets: int, n_tasks: int) -> DataFrame:
    asked = state.mapInPandas(tidy(_ask(n_buckets)), "owner int, bucket int, names binary, sums binary")
    return _written(_dealt(asked, "owner", n_tasks).applyInPandas(tidy_group(_answer), _REPLY), "sums")


class Parameters:
    """Discounts, sizes of the training part, and the tables of all restaurants in each sample."""

    def __init__(self, discount: float, parent_discount: float, n: int, v: int, tables: list[int]):
        self.discount, self.parent_discount, self.n, self.v, self.tables = discount, parent_discount, n, v, tables

    def parent(self, customers: np.ndarray, more: np.ndarray | int, sample: int) -> np.ndarray:
        """The parent's probability of words with so many of its customers; `more` are new ones of all words.

        A word without customers is the event of any new word, which takes what the known words leave.
        """
        all_ = PARENT_STRENGTH + self.tables[sample] + more
        return np.where(customers > 0, customers - self.parent_discount, PARENT_STRENGTH + self.parent_discount * self.v) / all_


def _discount(ones: int, twos: int) -> float:
    return min(max(ones / (ones + 2 * twos), 0.05), 0.95) if ones + twos else 0.5


def predictive(cells: Cells, totals: np.ndarray, p: Parameters) -> np.ndarray:
    """The probability of each cell's word after its context, the mean over the samples."""
    out = np.zeros(len(cells.c))
    for k, tables in enumerate(cells.tables):
        parent = p.parent(totals[3 + 2 * k], 0, k)
        for s in range(0, len(out), CELLS):
            at = slice(s, s + CELLS)
            c, context = cells.c[at], cells.context[at]
            own = np.where(c > 0, c - p.discount * tables[at], 0)
            new = STRENGTH + p.discount * totals[2 + 2 * k][context]
            out[at] += (own + new * parent[cells.word[at]]) / (STRENGTH + totals[0][context])
    out /= len(cells.tables)
    return out


class Seating:
    """The seats of the cells with two customers and more: the table of each customer, and how many sit at a table."""

    def __init__(self, cells: Cells, totals: np.ndarray, p: Parameters, rng: np.random.Generator):
        self.p, self.rng = p, rng
        self.many = np.flatnonzero(cells.c > 1)
        self.c, self.context, self.word = cells.c[self.many], cells.context[self.many], cells.word[self.many]
        # tables by context and by word, of all buckets
        self.of_context, self.of_word, self.more = totals[2].copy(), totals[3].copy(), 0
        if len(cells.slots):
            self.t, self.room = cells.slots, cells.sizes.copy()
        else:
            self.t = np.ones(len(self.c), np.int64)
            self._sit_down()
        self.begin = np.cumsum(self.c) - self.c
        # the seat of each customer; who of a cell is which one is drawn at random
        self.seat = np.repeat(np.arange(len(self.room), dtype=np.int32), self.room)
        self.seat = self.seat[np.argsort(np.repeat(np.arange(len(self.c)), self.c) + self.rng.random(len(self.seat)))]
        self.spare = np.empty(0, np.int64)

    @property
    def sizes(self) -> np.ndarray:
        """Customers of each table, cell by cell."""
        cell = np.zeros(len(self.room), np.int64)
        cell[self.seat] = np.repeat(np.arange(len(self.c)), self.c)
        taken = np.flatnonzero(self.room)
        return self.room[taken[np.argsort(cell[taken], kind="stable")]]

    def _new_table(self, tables: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Weight of a new table in each of the cells while it has so many, and all others have theirs."""
        more = tables - self.t[cells]
        parent = self.p.parent(np.maximum(self.of_word[self.word[cells]] + more, 1), self.more + more, 0)
        return (STRENGTH + self.p.discount * (self.of_context[self.context[cells]] + more)) * parent

    def _toll(self, n: np.ndarray, t: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """What one table more, opened after n customers at t tables, leaves of the weights of all who join until `upto`, nearly."""
        d = self.p.discount
        return ((n - d * t) / (upto - d * t)) ** d

    def _openings(self, cells: np.ndarray, n: np.ndarray, t: np.ndarray, upto: np.ndarray, foresee: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Customers come to each cell one by one, from n at t tables to `upto`: who opens its next table.

        Gives which of the cells have one and how many sit there before, until
        none has. How many join before a table is opened is geometric, with a
        beta variable as its chance. Where they foresee, the weight of a new
        table is less by its toll. `t` is counted on.
        """
        n, open_ = n.copy(), np.flatnonzero(n < upto)
        while len(open_):
            new, all_ = self._new_table(t[open_], cells[open_]), n[open_] - self.p.discount * t[open_]
            chance = self.rng.beta(new, all_)
            with np.errstate(divide="ignore", over="ignore"):
                join = np.floor(self.rng.standard_exponential(len(open_)) / -np.log1p(-chance))
            opens = join < upto[open_] - n[open_]
            open_, new = open_[opens], new[opens]
            n[open_] += join[opens].astype(np.int64)
            all_, toll = n[open_] - self.p.discount * t[open_], np.where(foresee[open_], self._toll(n[open_], t[open_], upto[open_]), 1)
            at = open_[self.rng.random(len(open_)) * (all_ + toll * new) < toll * (all_ + new)]
            t[at] += 1
            yield at, n[at]
            n[open_] += 1
            open_ = open_[n[open_] < upto[open_]]

    def _sit_down(self) -> None:
        """First seats, one customer after the other.

        Each step goes to the next table in every cell. Who joins a table and
        who those before it is an urn from its opening on, so sizes are
        beta-binomial, from the last table to the first. Both are the
        distributions of seating each customer alone. Cells of more than BLOCKS
        customers foresee: seated without, they begin with several times the
        tables that the rounds lead to.
        """
        d, all_ = self.p.discount, np.arange(len(self.c))
        cells, before = [all_], [np.zeros(len(self.c), np.int64)]
        t = self.t.copy()
        for opens, n in self._openings(all_, self.t.copy(), t, self.c, self.c > BLOCKS):
            cells.append(opens)
            before.append(n)
            self._moved(np.ones(len(opens), np.int64), opens)
        # the tables of a cell in the order of their opening, and the customers who sat before each
        order = np.argsort(np.concatenate(cells), kind="stable")
        before = np.concatenate(before)[order]
        begin = np.cumsum(t) - t
        later = np.ones(len(before), bool)
        later[begin] = False
        place = np.arange(len(before)) - np.repeat(begin, t)
        share = np.zeros(len(before))
        share[later] = self.rng.beta(1 - d, before[later] - d * place[later])
        self.room = np.ones(len(before), np.int64)
        # customers to come after the table at hand, of those who join it or one before it
        rest, many = self.c - before[begin + t - 1] - 1, np.flatnonzero(t > 1)
        at = begin + t - 1
        while len(many):
            last = at[many]
            joined = self.rng.binomial(rest[many], share[last])
            self.room[last] += joined
            rest[many] += before[last] - before[last - 1] - 1 - joined
            at[many] -= 1
            many = many[at[many] > begin[many]]
        self.room[begin] += rest

    def _moved(self, tables: np.ndarray, cells: np.ndarray) -> None:
        """Cells have so many tables more."""
        changed = np.flatnonzero(tables)
        cells, tables = cells[changed], tables[changed]
        self.t[cells] += tables
        np.add.at(self.of_context, self.context[cells], tables)
        np.add.at(self.of_word, self.word[cells], tables)
        self.more += int(tables.sum())

    def round(self) -> None:
        """Every customer of every cell leaves and takes a seat again.

        Of up to BLOCKS customers one leaves at a time, of more a block does.
        """
        size = np.minimum(-(-self.c // BLOCKS), BLOCK)
        self.spare = np.flatnonzero(self.room == 0)
        steps = -(-self.c // size)
        for k in range(steps.max(initial=0)):
            at = np.flatnonzero(steps > k)
            alone = size[at] == 1
            self._one(at[alone], k)
            at = at[~alone]
            for s in range(0, len(at), CELLS // 8):
                cells = at[s : s + CELLS // 8]
                start = k * size[cells]
                self._block(cells, start, np.minimum(size[cells], self.c[cells] - start))

    def _tables(self, n: int) -> np.ndarray:
        """Numbers of n tables at which nobody sits."""
        if n > len(self.spare):
            more = max(n, len(self.room) >> 4)
            self.spare = np.concatenate([self.spare, np.arange(len(self.room), len(self.room) + more)])
            self.room = np.concatenate([self.room, np.zeros(more, np.int64)])
        taken, self.spare = self.spare[:n], self.spare[n:]
        return taken

    def _joined(self, cells: np.ndarray, others: np.ndarray, t: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A table for each of the cells given, drawn by customers less the discount, of all others: not `size` ones from `start` on.

        A customer stands for its table, less its share of the discount.
        """
        out, open_ = self.seat[self.begin[cells] + np.where(start == 0, size, 0)], np.flatnonzero(t > 1)
        while len(open_):
            who = (self.rng.random(len(open_)) * others[open_]).astype(np.int64)
            who += np.where(who >= start[open_], size[open_], 0) + self.begin[cells[open_]]
            table = self.seat[who]
            settled = self.rng.random(len(open_)) * self.room[table] >= self.p.discount
            out[open_[settled]] = table[settled]
            open_ = open_[~settled]
        return out

    def _one(self, cells: np.ndarray, k: int) -> None:
        """The customer number k of each cell leaves and takes a seat again."""
        t = self.t[cells]
        several = np.flatnonzero(t > 1)
        t[several] -= self.room[self.seat[self.begin[cells[several]] + k]] == 1
        weight = self._new_table(t, cells)
        new = self.rng.random(len(cells)) * (self.c[cells] - 1 - self.p.discount * t + weight) < weight
        # who opens none beside the only table is back at it
        moves = np.flatnonzero(new | (self.t[cells] > 1))
        cells, t, new = cells[moves], t[moves], new[moves]
        customer, join, one = self.begin[cells] + k, np.flatnonzero(~new), np.ones(len(cells), np.int64)
        self.room[self.seat[customer]] -= 1
        taken = np.empty(len(cells), np.int64)
        taken[join] = self._joined(cells[join], self.c[cells[join]] - 1, t[join], k * one[join], one[join])
        taken[new] = self._tables(int(new.sum()))
        self.seat[customer] = taken
        self.room[taken] += 1
        self._moved(t + new - self.t[cells], cells)

    def _block(self, cells: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Customers of each cell, `size` from `start` on, leave and take seats again one after the other.

        They see those who stayed and those who are back, and foresee only
        nearly, so a block is drawn a little off its distribution given all
        else; by the rule of Metropolis and Hastings it keeps its old seats as
        often as mends that.
        """
        # where all sit at one table and no other is opened, all are back at it
        only, foresee = np.flatnonzero(self.t[cells] == 1), np.ones(len(cells), bool)
        t = np.ones(len(only), np.int64)
        openings = [(only[at], n) for at, n in self._openings(cells[only], (self.c[cells] - size)[only], t, self.c[cells[only]], foresee)]
        moves = np.ones(len(cells), bool)
        moves[only[t == 1]] = False
        number = np.cumsum(moves) - 1
        cells, start, size = cells[moves], start[moves], size[moves]

        d, edge, stay = self.p.discount, np.cumsum(size) - size, self.c[cells] - size
        cell = np.repeat(np.arange(len(cells)), size)
        place = np.arange(len(cell)) - edge[cell]
        customer = (self.begin[cells] + start)[cell] + place
        old = self.seat[customer]
        np.subtract.at(self.room, old, 1)
        # who would open the tables that are gone, were the old seats taken in the same order
        gone = np.flatnonzero(self.room[old] == 0)
        opened, opens = np.zeros(len(cell), bool), np.zeros(len(cell), bool)
        opened[gone[np.unique(old[gone], return_index=True)[1]]] = True
        left = self.t[cells] - np.bincount(cell[opened], minlength=len(cells))
        several = np.flatnonzero(self.t[cells] > 1)
        openings = [(number[at], n) for at, n in openings]
        openings += [(several[at], n) for at, n in self._openings(cells[several], stay[several], left[several], self.c[cells[several]], foresee)]
        for at, n in openings:
            opens[edge[at] + n - stay[at]] = True
        t = left + np.bincount(cell[opens], minlength=len(cells))

        differ = (t > left) | (left < self.t[cells])
        mine, keep = np.flatnonzero(differ[cell]), np.zeros(len(cells), bool)
        log = [np.bincount(cell[mine], self._log_all(cells, cell, place, stay, left, edge, x, mine), len(cells)) for x in (opened, opens)]
        keep[differ] = np.log1p(-self.rng.random(int(differ.sum()))) >= (log[1] - log[0])[differ]

        joins = np.flatnonzero(~keep[cell])
        opens &= ~keep[cell]
        joins = joins[~opens[joins]]
        taken = old.astype(np.int64)
        taken[opens] = self._tables(int(opens.sum()))
        # all others join: one who is back, or a table of those who stayed
        back, stayed, weight = np.arange(len(cell)), [joins[:0]], stay - d * left
        while len(joins):
            nth = self.rng.random(len(joins)) * (weight[cell[joins]] + place[joins]) - weight[cell[joins]]
            stayed.append(joins[nth < 0])
            joins, nth = joins[nth >= 0], nth[nth >= 0].astype(np.int64)
            whom = edge[cell[joins]] + np.minimum(nth, place[joins] - 1)
            settled = ~opens[whom] | (self.rng.random(len(joins)) >= d)
            back[joins[settled]] = whom[settled]
            joins = joins[~settled]
        stayed = np.concatenate(stayed)
        at = cell[stayed]
        taken[stayed] = self._joined(cells[at], stay[at], left[at], start[at], size[at])
        while ((further := back[back]) != back).any():
            back = further
        taken = taken[back]
        self.seat[customer] = taken
        np.add.at(self.room, taken, 1)
        self._moved(np.where(keep, 0, t - self.t[cells]), cells)

    def _log_all(self, cells, cell, place, stay, left, edge, opens, mine) -> np.ndarray:
        """By customer, the log of its seat's weight over its chance, where the given ones open tables; but for what is the same in any seats."""
        upto = np.cumsum(opens) - opens
        at, n = cells[cell[mine]], stay[cell[mine]] + place[mine]
        t = (left - upto[edge])[cell[mine]] + upto[mine]
        toll = self._toll(n, t, self.c[at])
        out = np.log(n - self.p.discount * t + toll * self._new_table(t, at))
        return np.where(opens[mine], out - np.log(toll), out)


def _totals(rows: pd.DataFrame, n: int) -> np.ndarray:
    """What the owners have answered, in the order of the bucket's names."""
    answers = rows[rows["totals"].notna()].sort_values("owner")
    sizes = [len(_get(x)) for x in answers["totals"]]
    kinds = sum(sizes) // n
    totals, at = np.empty((kinds, n), np.int64), 0
    for raw, size in zip(answers["totals"], sizes):
        totals[:, at : at + size // kinds] = _get(raw).reshape(kinds, -1)
        at += size // kinds
    return totals


def _sample(p: Parameters, rounds: int, every: int, seed: int, last: bool):
    def sample(rows: pd.DataFrame) -> pd.DataFrame:
        state = rows[rows["names"].notna()].iloc[0]
        cells = Cells(state)
        rng = np.random.default_rng((seed, int(state.bucket)))
        seating = Seating(cells, _totals(rows, len(cells.names)), p, rng)
        kept = []
        for k in range(1, rounds + 1):
            seating.round()
            if k % every == 0:
                kept.append(np.minimum(cells.c, 1))
                kept[-1][seating.many] = seating.t
        same = {k: state[k] for k in ("bucket", "names", "context", "word", "c")}
        n = 0 if last else None  # nobody sits down again after the last rounds
        return pd.DataFrame([{**same, "tables": _put(np.concatenate(kept)), "sizes": _put(seating.sizes[:n]), "slots": _put(seating.t[:n])}])

    return sample


def _keyed(docs: DataFrame) -> DataFrame:
    # ids go through pandas as text, which beside nulls would make them floating point
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")


class Model:
    """Sampled seatings (a written table), the sums that belong to them, and parameters."""

    def __init__(self, state: DataFrame, sums: DataFrame, parameters: Parameters, n_buckets: int, n_tasks: int):
        self.state, self.sums, self.parameters, self.n_buckets, self.n_tasks = state, sums, parameters, n_buckets, n_tasks


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples():
            cells = Cells(row)
            yield pd.DataFrame({"kind": [0, 1, 2, *range(3, 3 + len(cells.tables))], "n": [cells.c.sum(), (cells.c == 1).sum(), (cells.c == 2).sum(), *cells.tables.sum(axis=1)]})


def _parameters(state: DataFrame, sums: DataFrame) -> Parameters:
    found = state.mapInPandas(tidy(_statistics), "kind int, n long").groupBy("kind").agg(F.sum("n").alias("n"))
    s = {r.kind: r.n for r in found.collect()}
    owners = sums.groupBy("owner").agg(*[F.max(k).alias(k) for k in ("known", "ones", "twos")])
    known, ones, twos = (x or 0 for x in owners.agg(F.sum("known"), F.sum("ones"), F.sum("twos")).first())
    tables = [s[k] for k in sorted(s) if k >= 3]
    return Parameters(_discount(s.get(1, 0), s.get(2, 0)), _discount(ones, twos), s.get(0, 0), known, tables)


def fit(docs: DataFrame, seed: int = 1) -> Model:
    """Learn from the whole texts of all documents that are not held out.

    The cells of held-out documents are laid out beside the others, with no
    customers, so that their contexts' sums come along.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    n_tasks = min(n_buckets, max(1, -(-size // TASK_BYTES)))
    counted = _keyed(docs).mapInPandas(tidy(_count(n_buckets)), "bucket int, names binary, context binary, word binary, c binary")
    state = _written(_dealt(counted, "bucket", n_tasks).applyInPandas(tidy_group(_merge), _STATE), "cells")
    for phase, (rounds, every) in enumerate([(BURN_IN, BURN_IN), (ROUNDS, EVERY)]):
        sums = _exchange(state, n_buckets, n_tasks)
        if phase == 0:
            p = first = _parameters(state, sums)
        else:
            p = Parameters(first.discount, first.parent_discount, first.n, first.v, _parameters(state, sums).tables)
        both = state.unionByName(sums, allowMissingColumns=True)
        after = _written(_dealt(both, "bucket", n_tasks).applyInPandas(tidy_group(_sample(p, rounds, every, 2 * seed + phase, phase == 1)), _STATE), "cells")
        discard(state, sums)
        state = after
    sums = _exchange(state, n_buckets, n_tasks)
    return Model(state, sums, Parameters(first.discount, first.parent_discount, first.n, first.v, _parameters(state, sums).tables), n_buckets, n_tasks)


def _entries(n_buckets: int):
    """Which documents have a cell and how often, by run of documents and bucket, and a row on each run itself."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, ids, held, lengths, context, word in _parts(batches):
            keys, doc = _cell_keys(context, word), np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
            del context, word
            order = np.argsort(keys, kind="stable")  # so documents ascend within a cell
            keys, doc = keys[order], doc[order]
            cell = np.cumsum(np.diff(keys, prepend=~keys[:1]) != 0, dtype=np.int32) - 1
            del order
            first = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            n, doc, cell, keys = np.diff(np.append(first, len(doc))), doc[first], cell[first], keys[first]
            yield _frame([{"bucket": crc32(part.encode()) % n_buckets, "part": part, "doc_ids": ids, "held_out": _put(held.astype(np.int64)), "n_tokens": _put(lengths)}], _ENTRIES)
            for bucket, s, e in _cut(_share(keys, n_buckets), n_buckets):
                one = np.flatnonzero(np.diff(cell[s:e], prepend=-1) != 0)
                per_cell = _put(np.diff(np.append(one, e - s)))
                yield _frame([{"bucket": bucket, "part": part, "cells": _put_keys(keys[s:e][one]), "docs": _put(doc[s:e]), "n": _put(n[s:e]), "per_cell": per_cell}], _ENTRIES)
            del keys, doc, cell, first, n, lengths

    return entries


_ENTRIES = "bucket int, part string, doc_ids array<string>, held_out binary, n_tokens binary, cells binary, docs binary, n binary, per_cell binary"
_PARTIAL = "part string, bucket int, doc_ids array<string>, held_out binary, n_tokens binary, docs binary, n_known binary, sums binary"


def _known(rows: pd.DataFrame, p: Parameters) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a bucket's cells, ascending, the log10 probability of each and its word's customers in all training texts."""
    cells = Cells(rows[rows["c"].notna()].iloc[0])
    totals = _totals(rows, len(cells.names))
    log_p, seen = predictive(cells, totals, p), totals[1][cells.word]
    np.log10(log_p, out=log_p)
    del totals, cells.tables, cells.c
    keys = _cell_keys(cells.names[cells.context], cells.names[cells.word])
    del cells
    order = np.argsort(keys)
    return keys[order], log_p[order], seen[order]


def _score(p: Parameters):
    """Sums over the tokens of each document that lie in a bucket: its state and sums come first, and then the documents."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = [], None
        for batch in batches:
            of_model = batch["part"].isna()
            if of_model.any():
                if known is not None:
                    raise ValueError("a bucket's state and sums have to come before its documents")
                model.append(batch[of_model])
            found = batch[~of_model]
            out = found.loc[found["doc_ids"].notna(), ["part", "bucket", "doc_ids", "held_out", "n_tokens"]].to_dict("records")
            entries = found[found["docs"].notna()]
            if known is None and len(entries):
                known = _known(pd.concat(model), p)
                model.clear()
            for row in entries.itertuples():
                keys, log_p, seen = known
                at = np.repeat(np.searchsorted(keys, _keys(row.cells)), _get(row.per_cell))
                n, (docs, place) = _get(row.n), np.unique(_get(row.docs), return_inverse=True)
                total = lambda x: np.bincount(place, x * n, len(docs))
                sums = np.stack([total(np.log10(seen[at] + 1)), total(log_p[at])])
                out.append({"part": row.part, "bucket": row.bucket, "docs": _put(docs), "n_known": _put(total(seen[at] > 0).astype(np.int64)), "sums": sums.tobytes()})
            if out:
                yield _frame(out, _PARTIAL)

    return score


def _gather(p: Parameters):
    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        run = rows[rows["doc_ids"].notna()].iloc[0]
        n_tokens = _get(run.n_tokens)
        known, sums = np.zeros(len(n_tokens), np.int64), np.zeros((2, len(n_tokens)))
        for row in rows[rows["docs"].notna()].sort_values("bucket").itertuples():
            docs = _get(row.docs)
            known[docs] += _get(row.n_known)
            sums[:, docs] += np.frombuffer(row.sums).reshape(2, -1)
        base = sums[0] - n_tokens * np.log10(p.n + p.v + 1)
        return pd.DataFrame({"doc_id": list(run.doc_ids), "held_out": _get(run.held_out) > 0, "n_tokens": n_tokens, "n_known": known, "train_tokens": p.n, "base_score": base, "score": sums[1]})

    return gather


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of the documents that `fit` has seen, learned from or held out.

    Returns doc_id, held_out, n_tokens, n_known (tokens of training words),
    train_tokens, base_score (unigrams, one added to each count) and score (the
    model's log10 probability of the text). Tokens are the words, A-Z in lower
    case, and an end; a word that training has not is the event of a new word,
    for both. Null text counts as empty and has an end alone. Repeated rows are
    learned from and scored each, a null doc_id is not held out, and without any
    training text both scores are 0. Other columns are left out.
    """
    entries = _keyed(docs).mapInPandas(tidy(_entries(model.n_buckets)), _ENTRIES)
    all_ = model.state.unionByName(model.sums, allowMissingColumns=True).unionByName(entries, allowMissingColumns=True)
    # state and sums have no part and so come first
    partial = _dealt(all_, "bucket", model.n_tasks, "part").applyInPandas(tidy_group_parts(_score(model.parameters)), _PARTIAL)
    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = _written(partial.groupBy("part").applyInPandas(tidy_group(_gather(model.parameters)), schema), "scores")
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
