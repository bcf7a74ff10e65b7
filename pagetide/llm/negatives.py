"""Hard negatives by segment summaries that bound inner products.

Each vector is stored with the mean and the deviation of its segments, at
several lengths of segment. For two vectors, the products of the means plus or
minus the products of the deviations bound the inner product from above and
below. Anchors meet candidates block by block: coarse segments rule out most
pairs, finer ones most of the rest, and only what is then still possible is
scored exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm.common import materialize, shuffle_partitions, tidy
from pagetide.llm.topk import quantize

#: Components of a segment, level by level; each level divides the one before.
SEGMENTS = (64, 16, 4)
#: Rows of a block of anchors and of candidates, and anchors that are bounded at once.
ANCHOR_BLOCK, CANDIDATE_BLOCK, _AT_ONCE = 2048, 8192, 128
#: Room for rounding in the bounds, as a share of the lengths' product.
_SLACK = 1e-9


def padded(rows: pd.Series, width: int) -> np.ndarray:
    """Vectors as a matrix; shorter ones go on with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def summarise(vectors: np.ndarray) -> np.ndarray:
    """For each level, the segments' means times the root of their length, then their deviations.

    The deviation is the length of what is left of a segment without its mean,
    so that products of either add up to inner products.
    """
    out = []
    for size in SEGMENTS:
        n = -(-vectors.shape[1] // size)
        cut = np.zeros((len(vectors), n * size))
        cut[:, : vectors.shape[1]] = vectors
        cut = cut.reshape(len(vectors), n, size)
        mean = cut.mean(axis=2, keepdims=True)
        out += [mean[:, :, 0] * size**0.5, np.sqrt(((cut - mean) ** 2).sum(axis=2))]
    return np.hstack(out)


def store(vectors: DataFrame, scale: float) -> DataFrame:
    """row, vec_id, label, vec (floor(scale * x)) and summary of the rows that take part, written once.

    Left out are rows with a null vec_id, label or vector, and those with a null
    or non-finite component. Rows that share a vec_id all stay.
    """
    usable = vectors.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    # the label goes along under the id, as `quantize` keeps these two columns alone
    both = usable.select(F.struct("vec_id", F.col("label").cast("long").alias("label")).alias("vec_id"), "embedding")
    whole = quantize(both, scale).select(F.monotonically_increasing_id().alias("row"), "vec_id.vec_id", "vec_id.label", "vec")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, same in batch.groupby(batch["vec"].map(len)):
                yield same.assign(summary=list(summarise(padded(same["vec"], width))))

    return materialize(whole.mapInPandas(tidy(rows), f"{whole.schema.simpleString()[7:-1]}, summary array<double>".replace(":", " ", 4)), "summaries")


class Side:
    """Anchors or candidates of a block: exact vectors and, by level, summaries."""

    def __init__(self, rows: pd.DataFrame, width: int):
        self.vec_id, self.label = rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.vec = padded(rows["vec"], width)
        self.exact = self.vec.astype(np.float64)
        self.length = np.sqrt((self.exact**2).sum(axis=1))
        self.levels = []
        for size in SEGMENTS:
            self.levels.append([np.zeros((len(rows), -(-width // size))) for _ in range(2)])
        for own, at in rows.groupby(rows["vec"].map(len)).indices.items():
            values, k = np.array(rows["summary"].iloc[at].tolist()).reshape(len(at), -1), 0
            for size, level in zip(SEGMENTS, self.levels):
                n = -(-own // size)
                for part in level:
                    part[at, :n] = values[:, k : k + n]
                    k += n


def _products(a: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, by one matrix product where the pairs are many."""
    if 8 * len(i) > len(a) * len(c):
        return (a @ c.T)[i, j]
    return np.einsum("ns,ns->n", a[i], c[j])


def _bounds(a: Side, c: Side, i: np.ndarray, j: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of some pairs."""
    (mean_a, rest_a), (mean_c, rest_c) = a.levels[level], c.levels[level]
    middle = _products(mean_a, mean_c, i, j)
    reach = _products(rest_a, rest_c, i, j) + _SLACK * a.length[i] * c.length[j] + 1e-6
    return middle - reach, middle + reach


def _scores(a: Side, c: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    if len(i) and a.length.max() * c.length.max() < 2**53:  # exact in doubles
        return _products(a.exact, c.exact, i, j).astype(np.int64)
    return np.einsum("nd,nd->n", a.vec[i], c.vec[j])


def _kth(i: np.ndarray, j: np.ndarray, value: np.ndarray, shape: tuple[int, int], k: int) -> np.ndarray:
    """The kth largest value of each row of a matrix of which these places are filled, -inf where it has fewer."""
    if shape[1] < k:
        return np.full(shape[0], -np.inf)
    whole = np.full(shape, -np.inf)
    whole[i, j] = value
    return np.partition(whole, shape[1] - k, axis=1)[:, shape[1] - k]


def best_in_block(a: Side, c: Side, allowed: np.ndarray, k: int, limits: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of the limits, anchor, candidate and score of the k best allowed candidates that score from low to high.

    `limits` holds low and high scores by anchor. A pair leaves once for all of
    them its bounds lie outside, or k pairs of its anchor surely lie inside and
    above it.
    """
    i, j = np.nonzero(allowed)
    for level in range(len(SEGMENTS)):
        lower, upper = _bounds(a, c, i, j, level)
        stays = np.zeros(len(i), bool)
        for low, high in limits:
            sure = np.flatnonzero((lower >= low[i]) & (upper <= high[i]))
            kth = _kth(i[sure], j[sure], lower[sure], allowed.shape, k)
            stays |= (upper >= low[i]) & (lower <= high[i]) & (upper >= kth[i])
        i, j = i[stays], j[stays]
    score = _scores(a, c, i, j)
    for low, high in limits:
        inside = (score >= low[i]) & (score <= high[i])
        at = np.flatnonzero(inside)
        at = at[score[at] >= _kth(i[at], j[at], score[at].astype(float), allowed.shape, k)[i[at]]]
        at = at[np.lexsort((c.vec_id[j[at]], -score[at], i[at]))]
        first = np.arange(len(at)) - np.searchsorted(i[at], i[at]) < k
        yield i[at][first], j[at][first], score[at][first]


def _sides(anchors: pd.DataFrame, candidates: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Side, Side]]:
    if not len(anchors) or not len(candidates):
        return
    width = max(anchors["vec"].map(len).max(), candidates["vec"].map(len).max(), 1)
    c = Side(candidates, width)
    for at in range(0, len(anchors), _AT_ONCE):
        some = anchors.iloc[at : at + _AT_ONCE].reset_index(drop=True)
        yield some, Side(some, width), c


def _positives(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def find(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": [], "positive_id": [], "positive_score": []}, dtype="int64")]
        for some, a, c in _sides(anchors, candidates):
            allowed = (a.label[:, None] == c.label) & (a.vec_id[:, None] != c.vec_id)
            none = np.full(len(some), np.inf)
            ((i, j, score),) = best_in_block(a, c, allowed, k, [(-none, none)])
            out.append(pd.DataFrame({"anchor": some["row"].to_numpy()[i], "positive_id": c.vec_id[j], "positive_score": score}))
        return pd.concat(out)

    return find


def _negatives(k: int, k_positives: int, percent: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def find(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": [], "positive_score": [], "negative_id": [], "negative_score": []}, dtype="int64")]
        for some, a, c in _sides(anchors, candidates):
            most = np.array([list(x) + [-1] * (k_positives - len(x)) for x in some["positive_scores"]], np.int64)
            least = -(-percent * most // 100)
            different = a.label[:, None] != c.label
            # a positive below zero has no score between that share of it and itself
            limits = [(np.where(m < 0, np.inf, n), np.where(m < 0, -np.inf, m)) for m, n in zip(most.T, least.T)]
            for which, (i, j, score) in enumerate(best_in_block(a, c, different, k, limits)):
                out.append(pd.DataFrame({"anchor": some["row"].to_numpy()[i], "positive_score": most[i, which], "negative_id": c.vec_id[j], "negative_score": score}))
        return pd.concat(out)

    return find


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: float = 256.0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    `vectors` needs vec_id, label and embedding; other columns are left out, and
    `store` says which rows take part. `is_anchor` is a condition on vec_id. The
    positives of an anchor are its best rows of the same label with another
    vec_id; its negatives for one of them are the best rows of other labels that
    score at most what the positive does, and at least `percent` in 100 of it.
    Ties go to the smaller vec_id, fewer rows give all. Of rows that share a
    vec_id each takes part; if it is an anchor's, each of them is an anchor. No
    anchor, or no row at all, gives an empty result. Vectors of unequal length
    are compared as if the shorter went on with zeros.
    """
    spark = vectors.sparkSession
    rows = store(vectors, scale)
    n, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    blocks = max(shuffle_partitions(spark), -(-n // CANDIDATE_BLOCK))
    spread = lambda column, many: F.pmod(F.xxhash64(column), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))

    def search(asked: DataFrame, n_asked: int, function, schema: str) -> DataFrame:
        many = max(1, -(-n_asked // ANCHOR_BLOCK))
        left = asked.withColumn("anchor_block", spread("row", many)).withColumn("block", every(blocks))
        # other names for the same columns: the two sides of a cogroup must differ
        right = rows.select(*[F.col(c).alias(c) for c in rows.columns], spread("row", blocks).alias("block")).withColumn("anchor_block", every(many))
        return left.groupBy("anchor_block", "block").cogroup(right.groupBy("anchor_block", "block")).applyInPandas(function, schema)

    def first(found: DataFrame, by: list[str], score: str, vec_id: str, k: int) -> DataFrame:
        order = W.partitionBy(*by).orderBy(F.desc(score), vec_id)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anchors = rows.where(is_anchor)
    found = search(anchors, n_anchors, _positives(positives), "anchor long, positive_id long, positive_score long")
    best = materialize(first(found, ["anchor"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    # positives of equal score have the same negatives
    asked = anchors.join(best.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("positive_score").alias("positive_scores")), "row")
    found = search(asked, n_anchors, _negatives(negatives, positives, percent), "anchor long, positive_score long, negative_id long, negative_score long")
    hard = first(found, ["anchor", "positive_score"], "negative_score", "negative_id", negatives)
    named = best.join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return named.join(hard, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
