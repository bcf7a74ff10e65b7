"""Sessions of web hits and app views.

A session ends where an actor pauses for more than half an hour, and at UTC
midnight. Time has second precision, and views of the same second belong to
the same session whatever the order of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_SECONDS = 1800
_ACTOR = ["project", "day", "actor_id"]


def _begins(t: Column, window, gap_s: int) -> Column:
    before = F.lag(t).over(window)
    return before.isNull() | (t - before > gap_s)


def web_sessions(hits: DataFrame, gap_s: int = GAP_SECONDS) -> DataFrame:
    """project, day, actor_id, session_no from 1, hit_count and duration_sec."""
    window = W.partitionBy(*_ACTOR).orderBy("t")
    timed = hits.select(*_ACTOR, F.unix_timestamp("ts").alias("t"))
    marked = timed.withColumn("new", _begins(F.col("t"), window, gap_s).cast("int"))
    numbered = marked.withColumn("session_no", F.sum("new").over(window))
    return numbered.groupBy(*_ACTOR, "session_no").agg(
        F.count("*").alias("hit_count"), (F.max("t") - F.min("t")).alias("duration_sec")
    )


def app_sessions(views: DataFrame, gap_s: int = GAP_SECONDS) -> DataFrame:
    """project, day, actor_id, session_key, view_count and duration_sec.

    A declared session_id is the key (d:...). Other views are split by gaps
    (g:...), where views with a declared session count as views before. Of the
    views of a second, that with the smallest id (by length, then as text, so
    numbers by their size) is the first: it alone can begin a session.
    """
    window = W.partitionBy(*_ACTOR).orderBy("t")
    one_by_one = W.partitionBy(*_ACTOR).orderBy("t", F.length("id"), "id")
    timed = views.select(*_ACTOR, "id", "session_id", F.unix_timestamp("ts").alias("t"))
    declared = F.col("session_id") != ""
    marked = timed.withColumn("new", F.when(declared, 0).otherwise(_begins(F.col("t"), one_by_one, gap_s).cast("int")))
    key = F.when(declared, F.concat(F.lit("d:"), "session_id")).otherwise(F.concat(F.lit("g:"), F.sum("new").over(window).cast("string")))
    return marked.withColumn("session_key", key).groupBy(*_ACTOR, "session_key").agg(
        F.count("*").alias("view_count"), (F.max("t") - F.min("t")).alias("duration_sec")
    )


def session_parts(hits: DataFrame, gap_s: int = GAP_SECONDS) -> DataFrame:
    """project, day, actor_id, started, ended and hit_count of the sessions within a batch of hits; times in seconds."""
    return merge_parts(hits.select(*_ACTOR, F.unix_timestamp("ts").alias("started"), F.unix_timestamp("ts").alias("ended"), F.lit(1).cast("long").alias("hit_count")), gap_s)


def merge_parts(parts: DataFrame, gap_s: int = GAP_SECONDS) -> DataFrame:
    """Sessions from their parts in several batches, which may come in any order; columns as of session_parts.

    A late hit may join two sessions. Merging parts that were merged before
    gives the same as merging all hits.
    """
    order = W.partitionBy(*_ACTOR).orderBy("started")
    before = F.max("ended").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = parts.select(*_ACTOR, "started", "ended", "hit_count", (before.isNull() | (F.col("started") - before > gap_s)).cast("int").alias("_new"))
    numbered = marked.withColumn("_no", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*_ACTOR, "_no").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("hit_count").alias("hit_count")).drop("_no")


def session_metrics(sessions: DataFrame) -> DataFrame:
    """sessions, bounces and duration_sec of web sessions by project and day."""
    return sessions.groupBy("project", "day").agg(
        F.count("*").alias("sessions"), F.count_if(F.col("hit_count") == 1).alias("bounces"), F.sum("duration_sec").alias("duration_sec")
    )
