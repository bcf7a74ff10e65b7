"""Near-duplicate groups by bottom-k sketches of word-shingle sets.

One hash function gives each set a sketch, its k smallest hashes, with k so
large that no link is lost: of the shingles that two linked sets share, the
smallest are in both sketches. Inverted lists of retained hashes bring documents
together; what the sketch of their union leaves possible drops most chance
meetings, and full sets confirm the rest. Equal sets are one vertex from the
start, and a list is not expanded into pairs: its members meet one leader in
each of a few rounds. Members of lists that are then not in one component are
compared in blocks, by the values they share first; full sets are made only of
those that this leaves possible.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm.common import discard, materialize, tidy
from pagetide.llm.suffixdedup import prefix_hashes, stretch_hashes

#: Members of a list in a block; each task compares two blocks.
BLOCK = 1024
#: Of this many shingles of a set, one more is retained than links need, so that linked sets share as many.
EVERY = 10
#: At most so many rounds in which every list is led by one member, before what is left is compared in blocks.
ROUNDS = 4
#: Rounds end when one merges fewer than one in so many members.
FEW = 100
#: Counts that a task makes at once.
_AT_ONCE = 2_000_000
#: Characters of text that are hashed at a time.
_CHARS_AT_ONCE = 500_000
_BLANK = re.compile("[ \t-\r]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, one behind the other, and the number of each text's. Only A-Z are lower-cased."""
    parts = [text.encode() for text in texts]
    data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
    data = data + np.where(data - np.uint8(65) < 26, np.uint8(32), np.uint8(0))
    word = ~((data == 32) | (data - np.uint8(9) < 5))
    edges = np.flatnonzero(np.diff(word, prepend=False))
    begin, end = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(begin, np.cumsum([0, *[len(p) + 1 for p in parts]])))
    return stretch_hashes(prefix_hashes(data), begin, end - begin), counts


def _shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    rolled = np.full(n, np.uint64(size))
    for k in range(size):
        rolled = _mix(rolled * _MIX[0] + hashes[k : k + n])
    return rolled


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each whole text.

    Fewer words than `size` are one shingle; no words give none. Texts go in
    groups of bounded length, and a longer one in parts that end at white space;
    of it, some tens of bytes are held for each word.
    """
    group: list[str] = []

    def flush() -> Iterator[np.ndarray]:
        yield from _sets(*_word_hashes(group), size)

    held = 0
    for text in texts:
        text = text or ""
        if group and held + len(text) > _CHARS_AT_ONCE:
            yield from flush()
            group, held = [], 0
        if len(text) <= _CHARS_AT_ONCE:
            group.append(text)
            held += len(text)
            continue
        parts, at = [], 0
        while len(text) - at > _CHARS_AT_ONCE and (cut := _BLANK.search(text, at + _CHARS_AT_ONCE)):
            parts.append(_word_hashes([text[at : cut.start()]])[0])
            at = cut.end()
        hashes = np.concatenate([*parts, _word_hashes([text[at:]])[0]])
        yield from _sets(hashes, np.array([len(hashes)]), size)
    if group:
        yield from flush()


def _sets(hashes: np.ndarray, counts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    rolled = _shingles(hashes, size) if len(hashes) >= size else hashes[:0]
    for end, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
        if n >= size:
            yield np.unique(rolled[end - n : end - size + 1])
        else:
            yield _shingles(hashes[end - n : end], n) if n else hashes[:0]


def retained(n: int, percent: int) -> int:
    """How many of its n smallest hashes a set keeps.

    Linked sets share at least `percent` in 100 of either. The j-th of what they
    share, in ascending order, is no further behind than j and all that may
    differ, so both keep the first j: one for each EVERY shingles.
    """
    return n - -(-percent * n // 100) + -(-n // EVERY) if n else 0


def sketches(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, set_id (128-bit hash of the whole set) and sketch of every document."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            out = [(len(s), xxhash.xxh3_128_digest(s), s[: retained(len(s), percent)].view(np.int64)) for s in shingle_sets(batch["text"].tolist(), size)]
            frame = pd.DataFrame(out, columns=["n_shingles", "set_id", "sketch"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    # ids go through pandas as text, which beside nulls would make them floating point
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = keyed.mapInPandas(tidy(rows), "doc_id string, n_shingles bigint, set_id binary, sketch array<bigint>")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node and the whole set of hashes of each wanted document, written."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["doc_id"], "members": [s.view(np.int64) for s in shingle_sets(batch["text"].tolist(), size)]})

    found = docs.select("doc_id", "text").join(materialize(wanted.distinct().withColumnRenamed("node", "doc_id"), "wanted"), "doc_id")
    return materialize(found.mapInPandas(tidy(rows), "node bigint, members array<bigint>"), "sets")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and component, the smallest node that the undirected edges (a, b) reach.

    Labels take the smallest label of a neighbour and then that of the label
    itself, so that chains halve in each round.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        closer = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        after = closer.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("next", "component")).alias("component"))
        after = materialize(after, "labels")
        labels = after.select("node", "component")
        if after.where("component <> old").isEmpty():
            return labels


def _posts(classes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The inverted lists, and in brief the sets that are in them.

    The lists have value, node and n, without values and nodes that are in no link.
    brief has node, n, top (the set's largest retained value), room and `values`: 32 bits
    of each retained value that another set retains. What a set shares with one of no
    lesser top is no more than `room` above what their values have in common:
    the shingles that are not retained, and values that are equal in 32 bits.

    A linked set has at least `percent` in 100 of this one's shingles, so the
    two share at least `fewest` retained values, one for each EVERY of those.
    Sets that share fewer with all others are out, and so are values that one
    set alone then retains. Of the rest, each set is listed under all but its
    `fewest` - 1 most common values: linked ones still meet in a list.
    """
    fewest = F.ceil(F.ceil(percent * F.col("n") / F.lit(100.0)) / F.lit(float(EVERY)))
    lists = classes.select("node", F.explode("sketch").alias("value"))
    # most values are in one set only; one pass over them in order shows it, however many sets hold one
    beside = W.partitionBy("value").orderBy("node")
    met = lists.withColumn("met", F.coalesce(F.lag("node").over(beside), F.lead("node").over(beside))).where("met IS NOT NULL").select("value", "node")
    met = materialize(met, "met")
    nodes = met.groupBy("node").agg(F.count("*").alias("c")).join(classes.select("node", "n"), "node").where(F.col("c") >= fewest)
    lists = materialize(met.join(nodes.select("node", "n"), "node"), "lists")
    shared = materialize(lists.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "shared")
    nodes = lists.join(shared, "value").groupBy("node", "n").agg(F.count("*").alias("c"), F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v")).where(F.col("c") >= fewest)
    nodes = materialize(nodes.withColumn("values", F.array_distinct(F.transform("v.value", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")))), "nodes")
    rare = F.slice("v", 1, (F.col("c") - fewest + 1).cast("int"))
    posted = nodes.select("node", "n", F.explode(rare).alias("v")).select(F.col("v.value").alias("value"), "node", "n")
    posted = materialize(posted, "lists")
    brief = nodes.select("node", "n", "values", (F.col("c") - F.size("values")).alias("same")).join(classes.select("node", "n", "k", "top"), ["node", "n"])
    brief = materialize(brief.select("node", "n", "top", (F.col("n") - F.col("k") + F.col("same")).alias("room"), "values"), "brief")
    discard(nodes, met, lists)
    return posted, brief


def _distinct(lists: DataFrame) -> DataFrame:
    """One of all lists that have the same members, as values of one passage do."""
    of = lists.groupBy("value").agg(F.count("*").alias("c"), F.min("node").alias("x"), F.max("node").alias("y"), *[F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"s{k}") for k in (1, 2)])
    kept = materialize(of.groupBy("c", "x", "y", "s1", "s2").agg(F.min("value").alias("value")).select("value"), "distinct")
    return lists.join(kept, "value")


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists, with components, whose members are not all in one component yet."""
    known = materialize(lists.join(labels, "node"), "known")
    unresolved = known.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("value")
    return known.join(materialize(unresolved, "unresolved"), "value")


def _joint(lists: DataFrame) -> DataFrame:
    """All lists with the same smallest member as one, named by it: near copies that are not linked meet in many of them."""
    first = lists.groupBy("value").agg(F.min("node").alias("first"))
    return lists.join(first, "value").select(F.col("first").alias("value"), "node", "n", "component").distinct()


def _able(lists: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Open lists without the members that can't be linked with another component any more.

    A set can share with other components only the shingles that occur there,
    `reach` of them. Where that is too few for any size a partner in the list
    has, the member need not be met.
    """
    nodes = lists.select("node", "component").distinct()
    members = sets.join(nodes, "node").select("node", "component", F.explode("members").alias("shingle"))
    common = members.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("shingle")
    reach = members.join(common, "shingle").groupBy("node").agg(F.count("*").alias("reach"))
    lists = materialize(lists.join(reach, "node").where(f"100 * reach >= {percent} * n"), "able")
    smallest = lists.groupBy("value").agg(F.min("n").alias("least_n"))
    lists = lists.join(materialize(smallest, "smallest"), "value").where(f"least_n < reach OR 100 * reach >= {percent} * (least_n + n - reach)")
    return _open(lists.drop("component", "least_n", "reach"), labels)


def _merge(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """Labels after the components that the links (a, b) join have become one, and how many pairs of them there were."""
    links = materialize(links, "links")
    joined = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    joined = materialize(joined.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "merged")
    if not (pairs := joined.count()):
        return labels, 0
    roots = components(joined, joined.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    roots = roots.select(F.col("node").alias("component"), F.col("component").alias("root"))
    return materialize(labels.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels"), pairs


def _blocks(lists: DataFrame) -> DataFrame:
    """value, i, j, node and component: each list in blocks of about BLOCK members, and two of them in each group."""
    blocks = lists.groupBy("value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = lists.join(blocks, "value").withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return dealt.select("value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "component")


def _common(arrays: pd.Series) -> Iterator[tuple[slice, np.ndarray]]:
    """How many values each array has in common with each other one, for some arrays at a time."""
    m = len(arrays)
    holder = np.repeat(np.arange(m), arrays.map(len).to_numpy())
    _, code, held = np.unique(np.concatenate(arrays.to_list()), return_inverse=True, return_counts=True)
    holder, code = holder[held[code] > 1], code[held[code] > 1]
    holders = holder[np.argsort(code, kind="stable")]
    held = np.bincount(code, minlength=len(held))
    begin, work = (np.cumsum(held) - held)[code], held[code]
    upto = np.cumsum(np.bincount(holder, work, m))
    s = 0
    while s < m:
        e = np.searchsorted(upto, (upto[s - 1] if s else 0) + _AT_ONCE, "right")
        e = int(min(max(e, s + 1), s + max(1, _AT_ONCE // m)))
        lo, hi = np.searchsorted(holder, [s, e])
        w = work[lo:hi]
        at = np.repeat(begin[lo:hi] - (np.cumsum(w) - w), w) + np.arange(w.sum())
        yield slice(s, e), np.bincount(np.repeat(holder[lo:hi] - s, w) * m + holders[at], minlength=(e - s) * m).reshape(-1, m)
        s = e


def _possible(lists: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """The lists without the members that can be linked with no other component's, by the values that they share."""

    def possible(rows: pd.DataFrame) -> pd.DataFrame:
        component, n, top, room = (rows[k].to_numpy() for k in ("component", "n", "top", "room"))
        keep = np.zeros(len(rows), bool)
        for part, common in _common(rows["values"]):
            most = common + np.where(top[part, None] <= top, room[part, None], room)
            most = np.minimum(most, np.minimum(n[part, None], n))
            keep[part] = ((100 * most >= percent * (n[part, None] + n - most)) & (component[part, None] != component)).any(axis=1)
        return rows.loc[keep, ["value", "node"]]

    found = _blocks(lists).join(brief, "node").groupBy("value", "i", "j").applyInPandas(possible, "value bigint, node bigint")
    return lists.join(materialize(found.distinct(), "possible"), ["value", "node"])


def _compare_blocks(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of each open list, enough of them to join all that are linked.

    No pairs are made: a task counts common shingles of some members with all
    others at once, and hands on only links that join components.
    """

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, n = rows["node"].to_numpy(), rows["members"].map(len).to_numpy()
        _, group = np.unique(rows["component"].to_numpy(), return_inverse=True)
        parent = list(range(group.max() + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        links = []
        for part, common in _common(rows["members"]):
            linked = (100 * common >= percent * (n[part, None] + n - common)) & (group[part, None] != group)
            for k, other in zip(*(x.tolist() for x in np.nonzero(linked))):
                x, y = root(group[part.start + k]), root(group[other])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((nodes[part.start + k], nodes[other]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return _blocks(lists).join(sets, "node").groupBy("value", "i", "j").applyInPandas(compare, "a bigint, b bigint").distinct()


def group(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked if their sets of word shingles have a Jaccard
    similarity of `percent` in 100 or more; no link is lost. component_id is
    the smallest doc_id that links reach, and `kept` marks that document. A
    null or empty text has no shingles and no link. Rows that share a doc_id
    count as one vertex; a row with a null doc_id has no component and is kept.
    Other columns are left out, and an empty table stays empty.
    """
    sketched = materialize(sketches(docs.withColumn("doc_id", F.col("doc_id").cast("long")), size, percent), "sketches")
    everything = materialize(sketched.drop("sketch"), "rows")
    full = everything.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = sketched.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    # hashes are ordered as unsigned numbers, so the last of a sketch is its largest
    top = F.element_at("sketch", -1).bitwiseXOR(F.lit(-(1 << 63)))
    classes = materialize(classes.withColumns({"k": F.size("sketch"), "top": top}), "classes")
    discard(sketched)
    lists, brief = _posts(classes, percent)
    # labels of the vertices that meet any other; the others stay alone
    labels = materialize(lists.select("node", F.col("node").alias("component")).distinct(), "labels")
    of_set = materialize(classes.select("set_id", "node"), "sets_of")
    discard(classes)
    texts = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    # First every list is led by its smallest member: families of copies become one component.
    # A leader has met all others of its list and leaves it, so most lists are soon done with.
    for i in range(ROUNDS):
        lists = _open(lists.select("value", "node", "n"), labels)
        lists = materialize(lists if i else _distinct(materialize(lists, "open")), "open")
        if lists.isEmpty():
            break
        lead = lists.groupBy("value").agg(F.min(F.struct("node", "n", "component")).alias("l"))
        lead = materialize(lead.select("value", F.col("l.node").alias("a"), F.col("l.n").alias("n_a"), F.col("l.component").alias("c_a")), "lead")
        lists = materialize(lists.withColumnRenamed("node", "b").join(lead, "value").where("a <> b"), "met")
        near = lists.where(f"component <> c_a AND 100 * least(n, n_a) >= {percent} * greatest(n, n_a)")
        near = materialize(_likely(near.select("a", "b").distinct(), brief, percent), "likely")
        sets = _full_sets(texts, near.select(F.explode(F.array("a", "b")).alias("node")), size)
        labels, merged = _merge(labels, _confirm(near, sets, percent))
        discard(sets)
        met, lists = lists.count(), lists.select("value", F.col("b").alias("node"), "n")
        if merged * FEW < met:
            break
    # Then what is still open is compared in blocks.
    lists = materialize(_joint(materialize(_open(lists.select("value", "node", "n"), labels), "open")), "joint")
    # Of lists longer than a block, whose comparison grows with the square, those unable to reach others leave first.
    long = materialize(lists.groupBy("value").agg(F.count("*").alias("c")).where(f"c > {BLOCK}").select("value"), "long")
    if not long.isEmpty():
        some = materialize(lists.join(long, "value"), "some")
        able = _able(some, _full_sets(texts, some.select("node"), size), labels, percent)
        lists = materialize(lists.join(long, "value", "left_anti").unionByName(able), "open")
    lists = materialize(_possible(lists, brief, percent), "open")
    if not lists.isEmpty():
        sets = _full_sets(texts, lists.select("node"), size)
        labels, _ = _merge(labels, _compare_blocks(lists, sets, percent))
    # rows of one doc_id but different sets join their classes
    own = full.select("doc_id", "set_id").join(of_set, "set_id").join(labels, "node", "left")
    own = own.select("doc_id", F.coalesce("component", "node").alias("component")).distinct()
    own = materialize(own, "own")
    several = own.groupBy("doc_id").agg(F.count("*").alias("c"), F.collect_set("component").alias("all")).where("c > 1")
    several = materialize(several.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b"), "several")
    if not several.isEmpty():
        roots = components(several, several.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        own = own.join(roots.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
        own = own.select("doc_id", F.coalesce("root", "component").alias("component")).distinct()
    out = everything.select("doc_id", "n_shingles").join(own, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _likely(pairs: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """Pairs that the values they share leave possible.

    Up to the smaller of the two tops both sets are known whole. What they share
    there, and all that is left of the set with that top, bounds what they share
    at all, so no link is dropped.
    """
    side = lambda s: brief.select(F.col("node").alias(s), *[F.col(k).alias(f"{k}_{s}") for k in ("n", "top", "room", "values")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    room = F.when(F.col("top_a") <= F.col("top_b"), F.col("room_a")).otherwise(F.col("room_b"))
    most = F.size(F.array_intersect("values_a", "values_b")).cast("long") + room
    return both.where(100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)).select("a", "b").distinct()


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    side = lambda s: sets.select(F.col("node").alias(s), F.col("members").alias(f"set_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return both.where(100 * common.cast("long") >= percent * union.cast("long")).select("a", "b").distinct()


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, without those of documents that another stands for."""
    gone = group(docs, size, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
