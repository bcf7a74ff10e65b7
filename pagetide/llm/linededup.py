"""Removal of repeated runs of lines, in DataFrame functions only.

The corpus is a sequence of line names, and every line begins a suffix of its
document. Prefix doubling ranks the suffixes by longer and longer prefixes: the
class of 2^(k+1) lines at a place comes from the classes of 2^k lines there and
2^k lines further on, so equal classes are the places of one common-prefix
interval. A class is known by its first place instead of a number in sorted
order: which copy is the earliest decides, and no order of the classes does.
Lines that occur once are out from the start, which leaves a fraction of the
corpus for the doubling.

A maximal repeated run of `min_words` words is covered by the shortest such runs
that begin at its lines and the shortest that end at its lines, and those repeat
wherever it does. As every line has a word, none of them is longer than
`min_words` lines, so the doubling is done when a prefix holds that many; deeper
intervals only lie inside the ones found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import materialize

#: A run is worth removing from so many words on; shorter ones recur by chance.
MIN_WORDS = 10

_SPACE = " \t\n\x0b\x0c\r"
_NULL_ID = -(1 << 63)
_KEY = ["_d", "_t"]


def _key(docs: DataFrame) -> list[Column]:
    """Key of a document: its id and the hash of its text, as ids may repeat."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(_NULL_ID)).alias("_d"), F.xxhash64(docs["text"]).alias("_t")]


def _worded(text: Column) -> Column:
    """Lines with a word, in order: the line stripped, its number, its words."""
    all_lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line, i: F.struct(F.btrim(line, F.lit(_SPACE)).alias("s"), i.alias("no")))
    return F.filter(all_lines, lambda x: x["s"] != "")


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row for each line with a word: _d, _t, seq, no, h1, h2, reach and back.

    `reach` is the number of lines from here that first have `min_words` words
    together, null if the document ends before. `back` is the same number
    towards the start, null also where that run is the `reach` of its first line.
    """
    split = docs.select(*_key(docs), _worded(docs["text"]).alias("x"))
    counted = split.withColumn("w", F.transform("x", lambda x: F.regexp_count(x["s"], F.lit("[^ \t-\r]+"))))
    enough = lambda a, w: F.when(a["s"] >= min_words, a).otherwise(F.struct((a["s"] + w).alias("s"), (a["n"] + 1).alias("n")))
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("n"))
    # every line has a word, so no more than min_words lines are looked at
    ahead = F.transform("x", lambda x, i: F.aggregate(F.slice("w", i + 1, min_words), start, enough, lambda a: F.when(a["s"] >= min_words, a["n"])))
    near = lambda i: F.reverse(F.slice("w", F.greatest(i + 2 - min_words, F.lit(1)), F.least(i + 1, F.lit(min_words))))
    longer = lambda a, i: (a["s"] >= min_words) & (a["s"] - F.get("w", i) >= min_words)
    behind = F.transform("x", lambda x, i: F.aggregate(near(i), start, enough, lambda a: F.when(longer(a, i), a["n"])))
    named = F.transform("x", lambda x: F.struct(x["no"].alias("no"), F.xxhash64(x["s"]).alias("h1"), F.xxhash64(F.lit(1), x["s"]).alias("h2")))
    rows = counted.select(*_KEY, F.posexplode(F.arrays_zip(named.alias("a"), ahead.alias("r"), behind.alias("b"))).alias("seq", "z"))
    return rows.select(*_KEY, "seq", "z.a.no", "z.a.h1", "z.a.h2", F.col("z.r").alias("reach"), F.col("z.b").alias("back"))


def _classes(places: DataFrame, by: list[str]) -> DataFrame:
    """Places whose `by` columns occur elsewhere too, with the first such place as the name of their class.

    The classes are combined where their places are and written before they are
    joined, so that the join can split the places of a very common line.
    """
    place = F.struct(*_KEY, "seq")
    first = places.groupBy(*by).agg(F.min(place).alias("name"), F.max(place).alias("last")).where("name <> last").drop("last")
    return places.join(materialize(first, "classes"), by)


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_d, _t and gone, the numbers of the lines to remove, of documents that have any.

    A line goes if it lies in any run of lines that together have `min_words`
    words, and that also stands earlier, in a smaller doc_id or further up.
    """
    lines = materialize(_lines(docs, min_words), "lines")
    names = materialize(_classes(lines, ["h1", "h2"]).select(*_KEY, "seq", "no", "reach", "back", "name"), "names")
    ways = F.array(F.struct("seq", "reach"), F.struct((F.col("seq") - F.col("back") + 1).alias("seq"), F.col("back").alias("reach")))
    # only runs of repeated lines can repeat; they are known by the classes of their first and last 2^k lines
    found, width, active = [], 1, names.select(*_KEY, "seq", "name")
    while True:
        ends = active.select(*_KEY, (F.col("seq") - 0).alias("at"), F.col("name").alias("end"))
        runs = names.select(*_KEY, F.inline(ways)).where((F.col("reach") >= width) & (F.col("reach") < 2 * width))
        runs = runs.join(active, [*_KEY, "seq"]).withColumn("at", F.col("seq") + F.col("reach") - width).join(ends, [*_KEY, "at"])
        runs = materialize(runs.withColumnRenamed("name", "start"), "runs")
        again = _classes(runs, ["reach", "start", "end"])
        found.append(again.where(F.col("name") != F.struct(*_KEY, "seq")).select(*_KEY, "seq", "reach"))
        width *= 2
        if width > min_words:
            break
        ends = active.select(*_KEY, (F.col("seq") - width // 2).alias("seq"), F.col("name").alias("then"))
        active = materialize(active.join(ends, [*_KEY, "seq"]).withColumnRenamed("name", "here"), "pairs")
        active = materialize(_classes(active, ["here", "then"]).select(*_KEY, "seq", "name"), "active")
    spans = found[0]
    for more in found[1:]:
        spans = spans.union(more)
    covered = spans.select(*_KEY, F.explode(F.sequence("seq", F.col("seq") + F.col("reach") - 1)).alias("seq")).distinct()
    return covered.join(names.select(*_KEY, "seq", "no"), [*_KEY, "seq"]).groupBy(*_KEY).agg(F.collect_set("no").alias("gone"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs`, all columns, with the later copies of maximal repeated line runs cut from `text`.

    Adds n_lines, the lines with a word, and n_removed, and replaces columns of
    these names; any other column may have any name. Lines are compared without
    white space around them; lines without a word stay and never part a run.
    Null text stays null and has no lines. Rows that are equal in doc_id and
    text count as one document and fare alike, and a null doc_id counts as the
    smallest. An empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_removed")
    gone = materialize(later_copies(docs, min_words), "gone")
    # the row as one column, so that no name of its own meets those of the join
    rows = docs.select(*_key(docs), F.struct("*").alias("row")).join(gone, _KEY, "left")
    rows = rows.withColumns({"all": F.split("row.text", "\n"), "n_lines": F.size(_worded(F.col("row.text"))).cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long")})
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("all") - 1), "gone"), lambda i: F.get("all", i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, "\n"))
    return rows.select(F.col("row").withField("text", text).alias("row"), "n_lines", "n_removed").select("row.*", "n_lines", "n_removed")


def keep_worded(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of `docs` after `remove_repeats`; documents of which nothing is left but had words go."""
    out = remove_repeats(docs.select(F.struct("*").alias("row"), "doc_id", "text"), min_words)
    left = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return left.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")
