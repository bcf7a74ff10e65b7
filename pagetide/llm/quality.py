"""Line-first quality rules, in DataFrame functions only.

Punctuation, navigation and boilerplate rules judge each line; failing lines
are removed, and a document that loses too much of its text is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Rules of a line. Short lines without a sentence mark are menu entries, titles or labels.
MIN_LINE_WORDS = 4
LONG_LINE_WORDS = 30
MAX_SYMBOL_SHARE = 0.2
SENTENCE_MARK = "[.!?…。！？؟।:;]"
NAVIGATION = r"(?:[|»›•·→>].*){2,}"
BOILERPLATE = (
    r"(?i)\b(?:all rights reserved|cookie policy|enable javascript|javascript is disabled|lorem ipsum|privacy policy|"
    r"read more|share this|sign in|sign up|skip to content|subscribe to|terms of (?:use|service)|click here|use of cookies)\b"
)
#: Share of a document's characters in removed lines from which it is rejected.
MAX_LOST = 0.5
#: Base rules of a document.
MIN_WORDS = 10
WINDOW = 5
MAX_REPEAT_PERCENT = 20


def _stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def _length_without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _words(text: Column) -> Column:
    bare = _stripped(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \t-\r]+"))


def line_passes(line: Column) -> Column:
    """Whether a line stays. Lines without a word stay, as they lose nothing."""
    bare = _stripped(line)
    words = F.regexp_count(bare, F.lit("[^ \t-\r]+"))
    symbols = F.length(bare) - _length_without(bare, _SYMBOLS)
    no_sentence = ~bare.rlike(SENTENCE_MARK) & (words < LONG_LINE_WORDS)
    too_short = (words < MIN_LINE_WORDS) & ~bare.rlike(SENTENCE_MARK + r"[\"'”’»)\]]*$")
    fails = (
        ~bare.rlike(r"\p{L}")
        | no_sentence
        | too_short
        | (symbols > MAX_SYMBOL_SHARE * F.length(bare))
        | (bare.rlike(NAVIGATION) & (words < LONG_LINE_WORDS))
        | (bare.rlike(BOILERPLATE) & (words < LONG_LINE_WORDS))
    )
    return (bare == "") | ~fails


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and cleaned_text of every document.

    Null text counts as empty: no words, so the base rules fail and it is not
    kept. Repeated rows are judged each; other columns are left out. Windows of
    five words are compared by 64-bit hashes of their words.
    """
    steps = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    steps = steps.select("doc_id", "text", _words(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    steps = steps.select(
        "doc_id",
        "text",
        "lines",
        F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.filter("lines", line_passes).alias("passing"),
        F.filter("lines", lambda line: _stripped(line) != "").alias("worded"),
    )
    # Hashes of the windows; the four behind the last begin outside.
    window = lambda h, i: F.xxhash64(h, *[F.get("hashes", i + k) for k in range(1, WINDOW)])
    begun = F.slice("hashes", F.lit(1), F.greatest(F.lit(0), F.size("hashes") - F.lit(WINDOW - 1)))
    steps = steps.withColumn("windows", F.transform(begun, window)).drop("hashes")
    # Only texts that repeat a window have them sorted, so that equal ones are neighbours.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    steps = steps.withColumn("sorted", F.when(repeats, F.sort_array(placed))).drop("windows")
    near = lambda x, j, k: F.coalesce(F.get("sorted", j + k)["h"] == x["h"], F.lit(False))
    same = F.filter("sorted", lambda x, j: near(x, j, -1) | near(x, j, 1))
    steps = steps.withColumn("starts", F.array_sort(F.transform(same, lambda x: x["i"]))).drop("sorted")
    covered = F.transform("starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - p, F.lit(WINDOW))))
    n_repeat = F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    count = lambda c: c.cast("long")
    steps = steps.select(
        "doc_id",
        "n_words",
        count(_length_without(F.col("text"), _SPACE)).alias("word_chars"),
        count(F.length("text") - _length_without(F.col("text"), _SYMBOLS)).alias("n_symbols"),
        count(F.size("worded") - F.size(F.array_distinct("worded"))).alias("n_dup_lines"),
        n_repeat.alias("n_repeat_words"),
        F.array_join("passing", "\n").alias("cleaned_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    left = _length_without(F.col("cleaned_text"), _SPACE)
    return steps.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= (1 - MAX_LOST) * F.col("word_chars")))
