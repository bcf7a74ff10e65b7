"""Actors, retention cohorts, and activity by user and by group."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.operators.rollups import DIMENSION_CAP

_DAY = ["project", "day"]
_SURFACES = {"app": ("app", 0), "web": ("web", 1), "product": ("web", 2)}


def _seen(app: DataFrame, web: DataFrame, product: DataFrame) -> DataFrame:
    """project, actor_id, day, surface and source order of every actor and day, no empty actors."""
    parts = []
    for family, frame in (("app", app), ("web", web), ("product", product)):
        surface, order = _SURFACES[family]
        parts.append(frame.where("actor_id <> ''").select("project", "actor_id", "day", F.lit(surface).alias("surface"), F.lit(order).alias("source")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def identified_only(df: DataFrame, projects: DataFrame) -> DataFrame:
    """Rows of identified projects; where actors change daily there are no cohorts."""
    keep = projects.where("identity = 'identified'").select(F.col("alias").alias("project"))
    return df.join(F.broadcast(keep), "project", "left_semi")


def actors(app: DataFrame, web: DataFrame, product: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """project, actor_id, surface, first_seen_day and last_seen_day.

    The surface is that of the first sighting, app before web before product,
    and stays with an actor that is already known.
    """
    first = F.struct("day", "source")
    seen = _seen(app, web, product).groupBy("project", "actor_id").agg(
        F.min_by("surface", first).alias("surface"), F.min("day").alias("first_seen_day"), F.max("day").alias("last_seen_day")
    )
    if existing is None:
        return seen
    both = existing.withColumn("_new", F.lit(0)).unionByName(seen.withColumn("_new", F.lit(1)))
    return both.groupBy("project", "actor_id").agg(
        F.min_by("surface", "_new").alias("surface"), F.min("first_seen_day").alias("first_seen_day"), F.max("last_seen_day").alias("last_seen_day")
    )


def retention(known: DataFrame, app: DataFrame, web: DataFrame, product: DataFrame, projects: DataFrame) -> DataFrame:
    """project, surface, cohort_day, day_offset and actors active at that offset."""
    active = identified_only(_seen(app, web, product).select("project", "actor_id", "day").distinct(), projects)
    joined = active.join(known, ["project", "actor_id"])
    return joined.groupBy("project", "surface", F.col("first_seen_day").alias("cohort_day"), F.datediff("day", "first_seen_day").cast("long").alias("day_offset")).agg(
        F.countDistinct("actor_id").alias("actors")
    )


def merge_actors(log: DataFrame) -> DataFrame:
    """A log to which passes append, one row for each actor: the surface of the first entry, the earliest and the latest day.

    The result beside the log it was made from, or beside later entries, merges to the same.
    """
    return log.groupBy("project", "actor_id").agg(
        F.min_by("surface", F.struct("seq", "first_seen_day")).alias("surface"),
        F.min("first_seen_day").alias("first_seen_day"), F.max("last_seen_day").alias("last_seen_day"), F.min("seq").alias("seq"),
    )


def known_actors(log: DataFrame) -> DataFrame:
    """The actors of such a log."""
    return merge_actors(log).drop("seq")


def merge_cell_log(log: DataFrame) -> DataFrame:
    """A log of retention cells, one row for each: the largest count, as a cell is complete while its day has all rows."""
    return log.groupBy("project", "surface", "cohort_day", "day_offset").agg(F.max("actors").alias("actors"))


def merge_cells(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Retention cells where a recomputed cell wins only if its day still had all rows: counts never shrink."""
    return merge_cell_log(existing.unionByName(fresh))


def with_cohort_size(cells: DataFrame) -> DataFrame:
    """Retention cells with the size of their cohort, its actors at offset 0."""
    cohort = ["project", "surface", "cohort_day"]
    sizes = cells.where("day_offset = 0").select(*cohort, F.col("actors").alias("cohort_size"))
    return cells.join(sizes, cohort)


def identity_daily(web: DataFrame, app: DataFrame, product: DataFrame, cap: int = DIMENSION_CAP) -> DataFrame:
    """actors, users, hits, views and events by kind (user, group) and id.

    The most active ids of a project, day and kind stay, ties by id; the tail
    is dropped, as a bucket of ids would mean nothing.
    """
    flags = {"hits": web, "views": app, "events": product}
    rows = None
    for flag, frame in flags.items():
        part = frame.select(*_DAY, "actor_id", "user_id", "group_id", *[F.lit(int(flag == f)).cast("long").alias(f) for f in flags])
        rows = part if rows is None else rows.unionByName(part)
    kinds = F.array(F.struct(F.lit("user").alias("kind"), F.col("user_id").alias("id")), F.struct(F.lit("group").alias("kind"), F.col("group_id").alias("id")))
    long = rows.select("*", F.explode(kinds).alias("k")).select(*_DAY, "k.*", "actor_id", "user_id", *flags).where("id <> ''")
    # one row for each actor and user of an id, so that both distinct counts see few rows
    brief = long.groupBy(*_DAY, "kind", "id", "actor_id", "user_id").agg(*[F.sum(f).alias(f) for f in flags])
    counted = brief.groupBy(*_DAY, "kind", "id").agg(
        F.countDistinct("actor_id").alias("actors"), F.countDistinct(F.nullif(F.col("user_id"), F.lit(""))).alias("users"), *[F.sum(f).alias(f) for f in flags]
    )
    order = W.partitionBy(*_DAY, "kind").orderBy(F.desc(F.col("hits") + F.col("views") + F.col("events")), "id")
    ranked = counted.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= cap).drop("_rank")
    return ranked.withColumn("users", F.when(F.col("kind") == "user", F.lit(1).cast("long")).otherwise(F.col("users")))


def refresh_last_seen(identities: DataFrame, activity: DataFrame) -> DataFrame:
    """Names with last_seen_day moved to their latest day of activity, if they have any."""
    latest = activity.groupBy("project", "kind", "id").agg(F.max("day").alias("_latest"))
    joined = identities.join(latest, ["project", "kind", "id"], "left")
    return joined.withColumn("last_seen_day", F.coalesce("_latest", "last_seen_day")).select(*identities.columns)


def merge_names(arrived: DataFrame) -> DataFrame:
    """project, kind, id, name, updated_at: one row for each id, with the latest name."""
    newest = F.struct("updated_at", "name")
    return arrived.groupBy("project", "kind", "id").agg(F.max_by("name", newest).alias("name"), F.max("updated_at").alias("updated_at"))


def upsert_names(existing: DataFrame, arrived: DataFrame) -> DataFrame:
    """project, kind, id, name, updated_at: the latest name wins; empty ids and names are skipped."""
    columns = ["project", "kind", "id", "name", "updated_at"]
    return merge_names(existing.select(*columns).unionByName(arrived.where("id <> '' AND name <> ''").select(*columns)))


def prune_actors(known: DataFrame, cells: DataFrame, cutoff: datetime.date) -> tuple[DataFrame, DataFrame]:
    """Actors last seen before the cutoff and cohorts that began before it go."""
    return known.where(F.col("last_seen_day") >= F.lit(cutoff)), cells.where(F.col("cohort_day") >= F.lit(cutoff))


def prune_identities(identities: DataFrame, daily: DataFrame, cutoff: datetime.date) -> tuple[DataFrame, DataFrame]:
    """Names last seen before the cutoff go, those never seen stay; days before it go."""
    stays = F.col("last_seen_day").isNull() | (F.col("last_seen_day") >= F.lit(cutoff))
    return identities.where(stays), daily.where(F.col("day") >= F.lit(cutoff))
