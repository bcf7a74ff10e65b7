"""Exact top-k inner products by distributed histogram selection.

All candidates are scored against all queries, block by block. Global
histograms of the scores, one bin level after the other, locate each query's
kth score exactly; a last pass keeps the scores above it and as many of its
ties as the query still needs, those with the smallest ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.llm.common import materialize, shuffle_partitions

#: Bins of a histogram level, and rows of a block of queries and of candidates.
BINS = 256
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16384
#: Queries scored at once inside a task.
_AT_ONCE = 256


def quantize(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id and vec, the components as floor(scale * x).

    Left out: rows with a null vec_id, a null vector, or a component that is
    null, NaN or infinite. Rows that share a vec_id all stay. Other columns are
    left out.
    """
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable).select("vec_id", whole.alias("vec"))


def _scores(queries: pd.DataFrame, candidates: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the query, scores, candidate ids) for each query of a block, its own row left out."""
    if not len(queries) or not len(candidates):
        return
    width = max(queries["vec"].map(len).max(), candidates["vec"].map(len).max())

    def matrix(rows: pd.Series) -> np.ndarray:
        out = np.zeros((len(rows), width), np.int64)
        for i, row in enumerate(rows):
            out[i, : len(row)] = row
        return out

    left, right = matrix(queries["vec"]), matrix(candidates["vec"])
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * width
    if most < 2**53:  # exact in doubles
        left, right = left.astype(np.float64), right.astype(np.float64)
    own, ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, right = ids[order], right[order]
    for at in range(0, len(left), _AT_ONCE):
        block = (left[at : at + _AT_ONCE] @ right.T).astype(np.int64)
        for i, row in enumerate(block, at):
            other = ids != own[i]
            yield i, row[other], ids[other]


def _count(width: int, low: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Counts of the bins of one level inside each query's current bin.

    A block leaves out the bins below the one in which it alone already has as
    many scores as the query needs: the kth score can't be there.
    """

    def count(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        rows = []
        inside, need = queries["inside"].to_numpy(), queries["need"].to_numpy()
        for i, scores, _ in _scores(queries, candidates):
            bins = (scores - low) // width
            bins = bins[bins // BINS == inside[i]]
            if len(bins) > need[i]:
                bins = bins[bins >= np.partition(bins, len(bins) - need[i])[len(bins) - need[i]]]
            values, counts = np.unique(bins, return_counts=True)
            rows.append(pd.DataFrame({"query_id": queries["vec_id"].iat[i], "bin": values, "n": counts}))
        return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "bin": [], "n": []}, dtype="int64")

    return count


def _keep(low: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The scores above the kth, and the smallest ids among its ties."""

    def keep(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        rows = []
        kth, need = queries["inside"].to_numpy() + low, queries["need"].to_numpy()
        for i, scores, ids in _scores(queries, candidates):
            picked = np.concatenate([np.flatnonzero(scores > kth[i]), np.flatnonzero(scores == kth[i])[: need[i]]])
            rows.append(pd.DataFrame({"query_id": queries["vec_id"].iat[i], "vec_id": ids[picked], "score": scores[picked]}))
        return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return keep


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query.

    `vectors` needs vec_id and embedding; `is_query` is a condition on vec_id.
    Candidates are all rows with another vec_id than the query's, fewer than k
    give all, and ties go to the smaller vec_id. Rows that share a vec_id are
    candidates each; if it is a query's, their scores go into one list. Vectors of unequal length are compared as if
    the shorter went on with zeros. `quantize` says which rows take part; with
    no query the result is empty.
    """
    spark = vectors.sparkSession
    # rows are dealt by numbers of their own, so that a vec_id of very many rows fills no block
    rows = materialize(quantize(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, n_queries, most = rows.agg(F.count("*"), F.count_if(is_query), F.max(squares)).first()
    bound = math.ceil(most or 0) + 1
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    blocks = max(shuffle_partitions(spark), -(-n // CANDIDATE_BLOCK))
    spread = lambda many: F.pmod(F.xxhash64("row"), F.lit(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    # other names for the same columns: the two sides of a cogroup must differ
    candidates = rows.select(F.col("vec_id").alias("vec_id"), F.col("vec").alias("vec"), spread(blocks).alias("block"), every(query_blocks).alias("query_block"))
    queries = rows.where(is_query).select("vec_id", "vec", spread(query_blocks).alias("query_block"))

    def run(state: DataFrame, function, schema: str) -> DataFrame:
        known = queries.join(state.withColumnRenamed("query_id", "vec_id"), "vec_id").withColumn("block", every(blocks))
        return known.groupBy("query_block", "block").cogroup(candidates.groupBy("query_block", "block")).applyInPandas(function, schema)

    levels = 1
    while BINS**levels < 2 * bound + 1:
        levels += 1
    state = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.lit(0).cast("long").alias("inside"), F.lit(k).cast("long").alias("need")).distinct()
    for level in reversed(range(levels)):
        counts = run(state, _count(BINS**level, -bound), "query_id bigint, bin bigint, n bigint").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = F.coalesce(F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        need = counts.withColumn("above", above).join(state.select("query_id", "need"), "query_id").where(F.col("above") < F.col("need"))
        state = need.groupBy("query_id").agg(F.min("bin").alias("inside"), F.min(F.col("need") - F.col("above")).alias("need"))
        state = materialize(state, "kth")
    best = run(state, _keep(-bound), "query_id bigint, vec_id bigint, score bigint")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
