"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model over characters, all of them
in one table of sorted n-gram hashes with a column of log probabilities for
each language. A text goes to the language with the lowest cross-entropy per
character, and is rejected if that is higher than calibration allows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.llm.common import tidy

ORDER = 4
#: Bounds of the sample that the models are fitted on: documents of a language,
#: one in so many of which calibrates the rejection instead of counting.
DOCS_PER_LANGUAGE = 3000
CALIBRATE_EVERY = 5
#: Rejection: so much above what calibration documents reach.
MARGIN = 1.5
#: Characters beyond which a longer text no longer makes cross-entropy steadier.
STEADY = 400
UNKNOWN = "und"

_CHARS_AT_ONCE = 200_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether a code point is a letter, a table made once in each worker."""
    if not _letters:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _letters.append(table)
    return _letters[0]


def _sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters and the document of each: lower case, what is no letter becomes one space.

    Each document begins with ORDER - 1 zeros, which belong to no document (-1).
    """
    pad = "\0" * (ORDER - 1)
    lowered = [pad + t.lower().replace("\0", " ") for t in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    docs = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    letter, start = _is_letter()[chars], chars == 0
    docs[start] = -1
    chars[~letter & ~start] = 32
    keep = letter | start
    keep[1:] |= letter[:-1]
    return chars[keep].astype(np.uint64), docs[keep]


def _hashes(chars: np.ndarray) -> list[np.ndarray]:
    """For n = 1 to ORDER, the hash of the n characters that end at each place."""
    out = [chars]
    for _ in range(1, ORDER):
        longer = chars.copy()
        longer[1:] += out[-1][:-1] * _PRIME
        out.append(longer)
    return out


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded length, each with its first place; one long text is a run of its own."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > _CHARS_AT_ONCE:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, texts[at:]


@dataclass
class Models:
    languages: list[str]
    #: For each n from 1: sorted hashes, log probability and log backoff weight by language.
    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    log_backoff: list[np.ndarray]
    log_p0: np.ndarray
    #: Mean cross-entropy and the reach above it, for rejection.
    mean: np.ndarray
    reach: np.ndarray

    def _look(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[n - 1]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return at, keys[at] == hashes

    def _log_p(self, n: int, hashes: list[np.ndarray], where: np.ndarray) -> np.ndarray:
        """Log probability in each language of the characters at some places, given n - 1 before."""
        if n == 0:
            return np.broadcast_to(self.log_p0, (len(where), len(self.languages)))
        at, hit = self._look(n, hashes[n - 1][where])
        out = self.log_p[n - 1][at]
        if not hit.all():
            rest = where[~hit]
            lower = self._log_p(n - 1, hashes, rest)
            if n > 1:
                before, known = self._look(n - 1, hashes[n - 2][rest - 1])
                lower = lower + np.where(known[:, None], self.log_backoff[n - 2][before], 0)
            out[~hit] = lower
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character by language of each text, and its number of characters."""
        total, length = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for first, group in _groups(texts):
            chars, docs = _sequence(group)
            hashes, where = _hashes(chars), np.flatnonzero(docs >= 0)
            for part in np.array_split(where, max(1, len(where) // _CHARS_AT_ONCE)):
                log_p = self._log_p(ORDER, hashes, part)
                for k in range(len(self.languages)):
                    total[first : first + len(group), k] -= np.bincount(docs[part], log_p[:, k], len(group))
                length[first : first + len(group)] += np.bincount(docs[part], minlength=len(group))
        return total / np.maximum(length, 1)[:, None], length

    def predict(self, texts: list[str]) -> pd.DataFrame:
        """lang_pred, score (share of the likelihood), cross_entropy and rejected."""
        if not self.languages:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(texts), "score": 0.0, "cross_entropy": np.nan, "rejected": True})
        entropy, length = self.entropies(texts)
        best = entropy.argmin(axis=1)
        lowest = entropy[np.arange(len(texts)), best]
        odds = np.exp(-np.minimum((entropy - lowest[:, None]) * length[:, None], 700)).sum(axis=1)
        none = np.array([not any(map(str.isalpha, t)) for t in texts], bool)
        limit = self.mean[best] + self.reach[best] / np.sqrt(np.clip(length, 1, STEADY))
        return pd.DataFrame({
            "lang_pred": np.where(none, UNKNOWN, np.array(self.languages, object)[best]),
            "score": np.where(none, 0.0, 1 / odds),
            "cross_entropy": np.where(none, np.nan, lowest),
            "rejected": none | (lowest > limit),
        })


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, text and a flag for calibration, of about so many documents of each language.

    A language with fewer than CALIBRATE_EVERY documents, or where all would
    calibrate, has all of them counted and none that calibrate.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATE_EVERY)) == 0
    counts = known.groupBy("lang").agg(F.count("*").alias("_n"), F.count_if(~calibrates).alias("_c"))
    few = (F.col("_n") < CALIBRATE_EVERY) | (F.col("_c") == 0)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    # one row a language
    drawn = known.join(F.broadcast(counts), "lang").where(draw * F.col("_n") < F.lit(1_000_003 * per_language))
    return drawn.select("lang", "text", (calibrates & ~few).alias("calibrates"))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            for _, group in _groups(rows["text"].tolist()):
                chars, docs = _sequence(group)
                hashes, where = _hashes(chars), np.flatnonzero(docs >= 0)
                for n in range(1, ORDER + 1):
                    keys, first, counts = np.unique(hashes[n - 1][where], return_index=True, return_counts=True)
                    place = where[first]
                    suffix = hashes[n - 2][place] if n > 1 else np.zeros(len(keys), np.uint64)
                    context = hashes[n - 2][place - 1] if n > 1 else np.zeros(len(keys), np.uint64)
                    yield pd.DataFrame({"lang": lang, "n": n, "key": keys.view(np.int64), "suffix": suffix.view(np.int64), "context": context.view(np.int64), "c": counts})


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Models:
    """Fit the models on a bounded sample of the labelled documents that are not held out.

    The driver gets the n-gram counts of the sample, whose size `per_language`
    bounds, and nothing of the rest. Without any labelled text there are models
    of no language, which reject every text.
    """
    sample = _sample(docs, per_language)
    counted = sample.where(~F.col("calibrates")).select("lang", "text").mapInPandas(tidy(_count), "lang string, n int, key bigint, suffix bigint, context bigint, c bigint")
    grams = counted.groupBy("lang", "n", "key", "suffix", "context").agg(F.sum("c").alias("c")).toPandas()
    languages = sorted(grams["lang"].unique())
    if not languages:
        none = np.zeros(0)
        return Models([], [none.astype(np.uint64)] * ORDER, [np.zeros((0, 0), np.float32)] * ORDER, [np.zeros((0, 0), np.float32)] * ORDER, none, none, none)
    for c in ("key", "suffix", "context"):
        grams[c] = grams[c].to_numpy(np.int64).view(np.uint64)
    by_n = [grams[grams["n"] == n] for n in range(1, ORDER + 1)]
    keys = [np.unique(g["key"].to_numpy()) for g in by_n]
    log_p = [np.zeros((len(k), len(languages))) for k in keys]
    log_backoff = [np.zeros((len(k), len(languages))) for k in keys]
    log_p0 = np.zeros(len(languages))
    shape = [g.drop_duplicates("key").sort_values("key") for g in by_n]
    for column, lang in enumerate(languages):
        own = [g[g["lang"] == lang] for g in by_n]
        p0 = 1 / (len(keys[0]) + 1)
        log_p0[column] = np.log(p0)
        lower = np.empty(0)
        for n in range(1, ORDER + 1):
            count = np.zeros(len(keys[n - 1]))
            if n == ORDER:
                count[np.searchsorted(keys[n - 1], own[n - 1]["key"].to_numpy())] = own[n - 1]["c"].to_numpy()
            else:  # in how many ways a longer n-gram ends in this one
                np.add.at(count, np.searchsorted(keys[n - 1], own[n]["suffix"].to_numpy()), 1)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.75
            if n == 1:
                total, types = count.sum(), (count > 0).sum()
                p = np.maximum(count - discount, 0) / max(total, 1) + (discount * types / total if total else 1) * p0
                log_p0[column] += np.log(discount * types / total) if total else 0
            else:
                # a context at the start of a document holds padding and is in no table of its own
                context, suffix = shape[n - 1]["context"].to_numpy(), shape[n - 1]["suffix"].to_numpy()
                groups, inverse = np.unique(context, return_inverse=True)
                total = np.bincount(inverse, count, len(groups))
                types = np.bincount(inverse, count > 0, len(groups))
                backoff = np.where(total > 0, discount * types / np.maximum(total, 1), 1)
                p = np.maximum(count - discount, 0) / np.maximum(total, 1)[inverse] + backoff[inverse] * lower[np.searchsorted(keys[n - 2], suffix)]
                at = np.minimum(np.searchsorted(keys[n - 2], groups), len(keys[n - 2]) - 1)
                found = keys[n - 2][at] == groups
                log_backoff[n - 2][at[found], column] = np.log(backoff[found])
            log_p[n - 1][:, column] = np.log(p)
            lower = p
    blank = np.zeros(len(languages))
    models = Models(languages, keys, [x.astype(np.float32) for x in log_p], [x.astype(np.float32) for x in log_backoff], log_p0, blank, blank + np.inf)
    return _calibrate(models, sample.where("calibrates"))


def _calibrate(models: Models, sample: DataFrame) -> Models:
    """Set the rejection limits from documents that were not counted."""
    shared = sample.sparkSession.sparkContext.broadcast(models)
    languages = models.languages

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["lang"].isin(languages)]
            entropy, length = shared.value.entropies(batch["text"].tolist())
            own = np.array([languages.index(x) for x in batch["lang"]], int)
            yield pd.DataFrame({"lang": batch["lang"], "h": entropy[np.arange(len(own)), own], "n": length})

    # one row for each calibration document, so bounded as the sample is
    seen = sample.select("lang", "text").mapInPandas(tidy(measure), "lang string, h double, n bigint").toPandas()
    for column, lang in enumerate(languages):
        own = seen[(seen["lang"] == lang) & (seen["n"] > 0)]
        if len(own):
            models.mean[column] = own["h"].median()
            above = (own["h"] - models.mean[column]) * np.sqrt(own["n"].clip(1, STEADY))
            models.reach[column] = MARGIN * max(above.quantile(0.999), 12.0)
    return models


def identify(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy and rejected of every whole text.

    A null text and one without a letter are `und` with score 0, a null
    cross_entropy, and count as rejected, as any text is with models of no
    language. Each row is judged on its text alone,
    repeated rows each; ties go to the language that sorts first.
    """
    # a few megabytes, bounded by the sample that the models come from
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            out = shared.value.predict(texts)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    # ids go through pandas as text, which beside nulls would make them floating point
    keyed = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = keyed.mapInPandas(tidy(judge), "doc_id string, lang_pred string, score double, cross_entropy double, rejected boolean")
    own = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    return found.select(own, "lang_pred", "score", F.nanvl("cross_entropy", F.lit(None).cast("double")).alias("cross_entropy"), "rejected")


def keep_identified(docs: DataFrame, models: Models) -> DataFrame:
    """The rows of `docs`, all columns, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield ~shared.value.predict([t or "" for t in batch])["rejected"]

    def accepted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return tidy(judged)(batches)

    return docs.where(F.pandas_udf(accepted, "boolean")("text"))
