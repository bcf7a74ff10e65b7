"""The ingest as Structured Streaming, and live metrics over its output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagetide import schemas
from pagetide.operators import cohorts, lifecycle, rollups
from pagetide.operators.normalise import authorise, explode_events, merge_minutes, minute_counters, outputs
from pagetide.operators.sessions import GAP_SECONDS, merge_parts, session_parts
from pagetide.sources import store

#: Tables whose rows several batches share a key of, and how such rows become one.
_MERGED = {"names": (schemas.NAMES, cohorts.merge_names), "minutes": (schemas.MINUTES, merge_minutes), "visits": (schemas.SESSION_PARTS, merge_parts)}


def ingest_stream(envelopes: DataFrame, projects: DataFrame, keys: DataFrame, salts: DataFrame | Callable[[], DataFrame], tables: str, checkpoint: str, trigger: dict | None = None, agg_days: DataFrame | Callable[[], DataFrame] | None = None, fold_every: int = 100) -> StreamingQuery:
    """Write the three families, quarantine, display names, notices, batch results and minute counters of a stream of envelopes.

    The checkpoint makes a batch run again after a failure, and appends leave
    out ids that are there already, so every event is stored once. Times are
    clamped before they are looked at, so nothing is dropped as late; rows for
    days that are stored already go to a table of late rows. A family and its
    late rows share an index of ids. Names and minute counters are read by
    `stream_names` and `stream_minutes`, sessions so far by `stream_visits`;
    every `fold_every` batches, those that can't run again are brought together,
    without the visits of days that are stored. Give functions for `salts` and
    `agg_days` where they change while the stream runs: each batch asks anew.
    """
    now = lambda given: given() if callable(given) else given

    def write(batch: DataFrame, number: int) -> None:
        spark, stored = batch.sparkSession, now(agg_days)

        def visits(new: DataFrame) -> None:
            # a batch that runs again may have stored some of its rows: what it wrote then covers them all
            if not store.finished(spark, f"{tables}/visits/batch={number}"):
                session_parts(new).write.mode("overwrite").parquet(f"{tables}/visits/batch={number}")

        # parsed once: every output below reads the kept batches and events
        batches = authorise(batch, projects, keys).persist()
        events = explode_events(batches, now(salts)).persist()
        out = outputs(batches, events)
        for family, rows in (("web", out.web), ("app", out.app), ("product", out.product)):
            ids, late = f"{tables}/{family}_ids", None
            if stored is not None:
                rows, late = lifecycle.late_rows(rows, stored, family)
            store.append_new(rows, f"{tables}/{family}", schemas.FAMILIES[family], ids, visits if family == "web" else None)
            if late is not None:
                store.append_new(late, f"{tables}/late_{family}", schemas.FAMILIES[family], ids)
        # a batch that runs again replaces what it wrote
        out.quarantine.write.mode("overwrite").parquet(f"{tables}/quarantine/batch={number}")
        for name, rows in (("names", out.names), ("notices", out.notices), ("results", out.batch_results), ("minutes", minute_counters(events))):
            rows.write.mode("overwrite").parquet(f"{tables}/{name}/batch={number}")
        if number and number % fold_every == 0:
            for name, (schema, merge) in _MERGED.items():
                if name == "visits" and stored is not None:
                    merge = lambda parts: merge_parts(lifecycle.late_rows(parts, stored, "web")[0])
                store.fold_log(spark, f"{tables}/{name}", schema, merge, number)
        events.unpersist()
        batches.unpersist()

    return envelopes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def stream_names(spark: SparkSession, tables: str) -> DataFrame:
    """The latest name of each id that a stream has written, for `cohorts.upsert_names`."""
    return store.read_log(spark, f"{tables}/names", *_MERGED["names"])


def stream_minutes(spark: SparkSession, tables: str) -> DataFrame:
    """accepted and rejected by key label and minute, over all batches that fall in the minute."""
    return store.read_log(spark, f"{tables}/minutes", *_MERGED["minutes"])


def stream_visits(spark: SparkSession, tables: str, agg_days: DataFrame | None = None) -> DataFrame:
    """Web sessions of the days that are not stored, open ones too, as far as the stream has written: see `session_parts`."""
    visits = store.read_log(spark, f"{tables}/visits", *_MERGED["visits"])
    return visits if agg_days is None else lifecycle.late_rows(visits, agg_days, "web")[0]


def live_web_daily(spark: SparkSession, tables: str, agg_days: DataFrame | None = None) -> DataFrame:
    """The live half of v_web_daily, from sessions instead of raw hits."""
    return rollups.live_daily(stream_visits(spark, tables, agg_days))


def unique_events(events: DataFrame, within: str = "1 day") -> DataFrame:
    """A stream of events without repeated ids; state is kept only as long as clients try again."""
    return events.withWatermark("received_at", within).dropDuplicatesWithinWatermark(["project", "id"])


def event_stream(envelopes: DataFrame, projects: DataFrame, keys: DataFrame, salts: DataFrame) -> DataFrame:
    return explode_events(authorise(envelopes, projects, keys), salts)


def live_counters(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """accepted and rejected by key label and minute of a stream of events."""
    return minute_counters(events.withWatermark("received_at", lateness))


def live_sessions(hits: DataFrame, gap_s: int = GAP_SECONDS, lateness: str = "10 minutes") -> DataFrame:
    """Sessions of a stream of hits: project, day, actor_id, hit_count and duration_sec.

    Hits exactly the gap apart are one session, and the day in the key cuts at
    midnight, as in the tables.
    """
    window = F.session_window("ts", f"{gap_s} seconds")
    sessions = hits.withWatermark("ts", lateness).groupBy("project", "day", "actor_id", window.alias("w")).agg(
        F.count("*").alias("hit_count"), (F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).alias("duration_sec")
    )
    return sessions.drop("w")
