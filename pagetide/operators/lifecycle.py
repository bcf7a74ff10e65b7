"""Ageing of raw days into aggregates, pruning, erasure and renaming, for all projects at once."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide import schemas
from pagetide.operators import cohorts, normalise
from pagetide.plans.views import VIEWS, Lazy, Tables, noted_days, retention_cells
from pagetide.sources import store

_FAMILIES = ("web", "product", "app")


def retention_windows(projects: DataFrame) -> DataFrame:
    """project, family, raw_days and aggregate_days: what a project sets, else the defaults, field by field."""
    rows = []
    for family in _FAMILIES:
        raw, kept = schemas.RETENTION_DAYS[family]
        own = F.col(f"retention.{family}")
        rows.append(F.struct(F.lit(family).alias("family"), F.coalesce(own["raw_days"], F.lit(raw)).alias("raw_days"), F.coalesce(own["aggregate_days"], F.lit(kept)).alias("aggregate_days")))
    return projects.select(F.col("alias").alias("project"), F.explode(F.array(*rows)).alias("w")).select("project", "w.*")


def aged_out_days(web: DataFrame, app: DataFrame, product: DataFrame, windows: DataFrame, today: datetime.date) -> DataFrame:
    """family, project and day of the raw days older than their raw window."""
    days = None
    for family, frame in (("web", web), ("app", app), ("product", product)):
        part = frame.select(F.lit(family).alias("family"), "project", "day").distinct()
        days = part if days is None else days.unionByName(part)
    old = F.col("day") < F.date_sub(F.lit(today), F.col("raw_days"))
    return days.join(F.broadcast(windows), ["family", "project"]).where(old).select("family", "project", "day")


def frozen_identity_days(t: Tables, leaving: DataFrame) -> DataFrame:
    """Days whose identity counts must be stored now: the first family is about to drop its rows."""
    days = leaving.select("project", "day").distinct().select(F.lit("identity").alias("family"), "project", "day")
    return days if t.agg_days is None else days.join(t.agg_days, ["family", "project", "day"], "left_anti")


@dataclass
class Pass:
    """What a daily pass computed.

    Write `aggregates`, append `actors` and `retention` to their logs, then add
    `agg_days`, then drop the raw days.
    """

    aggregates: dict[str, DataFrame]
    agg_days: DataFrame
    actors: DataFrame
    retention: DataFrame
    raw: dict[str, DataFrame]


def leaving_days(t: Tables, today: datetime.date) -> DataFrame:
    """family, project and day that a pass must store now: aged out, and not stored yet. Archived projects have none."""
    leaving = aged_out_days(t.web, t.app, t.product, retention_windows(t.projects.where("NOT archived")), today)
    return leaving if t.agg_days is None else leaving.join(t.agg_days, ["family", "project", "day"], "left_anti")


def daily_pass(t: Tables, today: datetime.date, known_actors: DataFrame | None = None, leaving: DataFrame | None = None) -> Pass:
    """One plan for each aggregate over all projects and aged-out days.

    Archived projects are left alone. A day's identity counts are stored with
    the first family that leaves, while all its rows are still there; cohorts
    are computed over all raw days together, so no order of days matters.
    """
    live = t.projects.where("NOT archived")
    leaving = leaving_days(t, today) if leaving is None else leaving
    stored = leaving.unionByName(frozen_identity_days(t, leaving))
    noted = noted_days(stored)  # found once, so that each aggregate reads the partitions of its days alone
    aggregates = {name: compute(t.only(family, stored, noted)) for name, (family, compute) in VIEWS.items()}
    known = t.known if known_actors is None else known_actors
    days = leaving.select("project", "day").distinct()
    part = {name: getattr(t, name).join(days, ["project", "day"], "left_semi") for name in _FAMILIES}
    found = cohorts.identified_only(cohorts.actors(t.app, t.web, t.product, known), live)
    cells = cohorts.retention(found, part["app"], part["web"], part["product"], live)
    seen = cohorts.actors(part["app"], part["web"], part["product"]).select("project", "actor_id")
    found = found.join(seen, ["project", "actor_id"], "left_semi").withColumn("seq", F.lit(today))
    raw = {}
    for family, frame in (("web", t.web), ("app", t.app), ("product", t.product)):
        gone = leaving.where(F.col("family") == family).select("project", "day")
        raw[family] = frame.join(gone, ["project", "day"], "left_anti")
    days = stored if t.agg_days is None else t.agg_days.unionByName(stored.select(*t.agg_days.columns))
    return Pass(aggregates, days, found, cells, raw)


def _store_pass(spark: SparkSession, root: str, t: Tables, today: datetime.date) -> None:
    """Write what a pass over these tables computes; a rerun writes the same again, up to the note that ends it."""
    leaving = leaving_days(t, today).collect()  # a few days for each project
    if not leaving:
        return
    done = daily_pass(t, today, leaving=spark.createDataFrame(leaving, schemas.AGG_DAYS))
    noted = done.agg_days if t.agg_days is None else done.agg_days.join(t.agg_days, ["family", "project", "day"], "left_anti")
    days = noted.collect()  # those, and the identity days that must be stored with them
    for name, (family, _) in VIEWS.items():
        if any(r["family"] == family for r in days):
            store.replace_days(done.aggregates[name], f"{root}/aggregates/{name}")
    for name, rows in (("actors", done.actors), ("cells", done.retention)):
        rows.write.mode("append").partitionBy("project").parquet(f"{root}/{name}")
    note(spark, root, [(r["family"], r["project"], r["day"]) for r in days])


def note(spark: SparkSession, root: str, days: list[tuple]) -> None:
    """The step that makes days stored: from here on views take them from the aggregates."""
    spark.createDataFrame(days, schemas.AGG_DAYS).coalesce(1).write.mode("append").partitionBy("project").parquet(f"{root}/agg_days")


def age_out(spark: SparkSession, root: str, t: Tables, today: datetime.date) -> dict[str, str]:
    """Run the daily pass on the stored tables under `root`: families by name, aggregates, logs, agg_days.

    Aged-out days of all projects are aggregated and written, then noted, and
    only then dropped from the raw tables. A pass may stop anywhere: days that
    are not noted are computed again from their raw rows, over what an earlier
    try has written, and every later pass drops the raw rows of all noted days
    beyond their window, late ones that came in meanwhile too. If the pass
    fails, each project is tried alone, so that one with broken data leaves the
    others be; the result has the errors by project. Aggregates beyond their
    window go last, by folder, and with them actors last seen and cohorts begun
    before that.
    """
    failed: dict[str, str] = {}
    projects = [r["alias"] for r in t.projects.where("NOT archived").select("alias").collect()]
    try:
        _store_pass(spark, root, t, today)
    except Exception:  # which project it was shows below
        for project in projects:
            own = lambda df: df.where(F.col("project") == project)  # noqa: B023, E731
            part = replace(t, web=own(t.web), app=own(t.app), product=own(t.product), projects=t.projects.where(F.col("alias") == project))
            noted = store.read_table(spark, f"{root}/agg_days", schemas.AGG_DAYS)
            try:
                _store_pass(spark, root, replace(part, agg_days=noted), today)
            except Exception as error:
                failed[project] = str(error)
    windows = retention_windows(t.projects.where("NOT archived"))
    noted = store.read_table(spark, f"{root}/agg_days", schemas.AGG_DAYS)
    for r in aged_out_days(t.web, t.app, t.product, windows, today).join(noted, ["family", "project", "day"], "left_semi").collect():
        try:
            store.drop_partition(spark, f"{root}/{r['family']}", r["project"], r["day"])
        except Exception as error:
            failed[r["project"]] = str(error)
    prune_stored(spark, root, windows, today)
    prune_logs(spark, root, windows, today)
    return failed


def prune_stored(spark: SparkSession, root: str, windows: DataFrame, today: datetime.date) -> int:
    """Drop the folders of stored aggregate days beyond each project's window; how many went."""
    kept = {(r["project"], r["family"]): r["aggregate_days"] for r in windows.collect()}
    gone = 0
    for name, (family, _) in VIEWS.items():
        for (project, own), days in kept.items():
            if own == ("app" if family == "identity" else family) and days is not None:
                for day in store.stored_days(spark, f"{root}/aggregates/{name}", project):
                    if day < today - datetime.timedelta(days):
                        gone += store.drop_partition(spark, f"{root}/aggregates/{name}", project, day)
    return gone


def prune_logs(spark: SparkSession, root: str, windows: DataFrame, today: datetime.date) -> list[str]:
    """Leave actors last seen, and cohorts begun, before each project's aggregate window out of the stored logs; the projects rewritten.

    Only projects with such entries are read as a whole and written again, one
    row for each actor or cell, so the logs are compacted on the way. The
    cutoff is that of the app family.
    """
    kept = windows.where("family = 'app' AND aggregate_days IS NOT NULL").select("project", F.date_sub(F.lit(today), F.col("aggregate_days")).alias("_cutoff"))
    rewritten = set()
    for name, schema, merge, column in (("actors", schemas.ACTORS, cohorts.merge_actors, "last_seen_day"), ("cells", schemas.CELLS, cohorts.merge_cell_log, "cohort_day")):
        old = store.read_table(spark, f"{root}/{name}", schema).join(F.broadcast(kept), "project").where(F.col(column) < F.col("_cutoff"))
        projects = [r["project"] for r in old.select("project").distinct().collect()]
        if projects:
            new = lambda log, m=merge, c=column: m(log).join(F.broadcast(kept), "project", "left").where(F.col("_cutoff").isNull() | (F.col(c) >= F.col("_cutoff")))
            store.bring_together(spark, f"{root}/{name}", projects, schema, new)
            rewritten.update(projects)
    return sorted(rewritten)


def rotate_stored_salts(spark: SparkSession, path: str, now: datetime.datetime, hours: int = 24) -> DataFrame:
    """Rotate the stored salts in one step and give those that hold now; call it again and again, as a timer does.

    The new version is written whole before any reader takes it; then the old
    ones, whose salts may be over, are deleted. If it stops in between, the next
    call deletes them.
    """
    before = store.read_version(spark, path, schemas.SALTS)
    after = normalise.rotate_salts(before, now, hours).collect()  # a few salts
    if sorted(after) != sorted(before.collect()):
        store.write_version(spark.createDataFrame(after, schemas.SALTS), path)
    store.drop_old_versions(spark, path)
    return store.read_version(spark, path, schemas.SALTS)


def opened(spark: SparkSession, root: str, projects: DataFrame, identities: DataFrame, **caps: int) -> Tables:
    """The stored tables under `root`, raw and aggregated, for views and for the next pass."""
    raw = [store.read_table(spark, f"{root}/{family}", schemas.FAMILIES[family]) for family in ("web", "app", "product")]
    agg = {name: spark.read.parquet(path) for name in VIEWS if store.exists(spark, path := f"{root}/aggregates/{name}")}
    known = cohorts.known_actors(store.read_table(spark, f"{root}/actors", schemas.ACTORS))
    cells = store.read_table(spark, f"{root}/cells", schemas.CELLS)
    agg_days = store.read_table(spark, f"{root}/agg_days", schemas.AGG_DAYS)
    return Tables(*raw, projects, identities, agg=agg, agg_days=agg_days, noted=noted_days(agg_days), known=known, cells=cells, **caps)


#: Every table under a root, each with a folder for each project.
STORED = (*_FAMILIES, *[f"late_{f}" for f in _FAMILIES], *[f"{f}_ids" for f in _FAMILIES], *[f"aggregates/{v}" for v in VIEWS], "actors", "cells", "agg_days")


def erase_stored(spark: SparkSession, root: str, project: str) -> None:
    """Drop every partition of a project under `root`, its notes last; no other project's files are read or written."""
    for name in STORED:
        store.drop_partition(spark, f"{root}/{name}", project)


def rename_stored(spark: SparkSession, root: str, old: str, new: str) -> None:
    """Move every partition of a project under `root` to another alias; no file is read or written.

    A taken alias is an error before anything moves. One that stops halfway can
    run again: what has moved is left alone.
    """
    if not all(store.is_free(spark, f"{root}/{name}", old, new) for name in STORED):
        raise ValueError(f"alias {new} is taken")
    for name in STORED:
        store.move_project(spark, f"{root}/{name}", old, new)


merge_cells = cohorts.merge_cells


def late_rows(rows: DataFrame, agg_days: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """Rows for days that are still open, and late rows for days that are stored, which must not enter them."""
    stored = agg_days.where(F.col("family") == family).select("project", "day")
    return rows.join(stored, ["project", "day"], "left_anti"), rows.join(stored, ["project", "day"], "left_semi")


def prune_aggregates(aggregates: dict[str, DataFrame], windows: DataFrame, today: datetime.date) -> dict[str, DataFrame]:
    """Stored aggregates without the days beyond each project's window; identity days follow the app window."""
    out = {}
    for name, frame in aggregates.items():
        family = VIEWS[name][0]
        own = windows.where(F.col("family") == ("app" if family == "identity" else family)).select("project", "aggregate_days")
        kept = F.col("aggregate_days").isNull() | (F.col("day") >= F.date_sub(F.lit(today), F.col("aggregate_days")))
        out[name] = frame.join(F.broadcast(own), "project", "left").where(kept).select(*frame.columns)
    return out


def erase_project(tables: dict[str, DataFrame], project: str) -> dict[str, DataFrame]:
    """Every table without the rows of a project, by its project or alias column."""
    return {name: frame.where(F.col("alias" if "alias" in frame.columns else "project") != project) for name, frame in tables.items()}


def rename_project(tables: dict[str, DataFrame], old: str, new: str) -> dict[str, DataFrame]:
    """Every table with a project under another alias; a taken, equal or unknown alias is an error."""
    projects = tables["projects"]
    if old == new or not projects.where(F.col("alias") == new).isEmpty():
        raise ValueError(f"alias {new} is taken")
    if projects.where(F.col("alias") == old).isEmpty():
        raise ValueError(f"unknown project {old}")
    out = {}
    for name, frame in tables.items():
        column = "alias" if "alias" in frame.columns else "project"
        out[name] = frame.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))
    return out


def keyless_projects(projects: DataFrame, keys: DataFrame) -> DataFrame:
    """Active projects without any active key."""
    active = keys.where("NOT disabled").select(F.col("project").alias("alias"))
    return projects.where("NOT archived").join(active, "alias", "left_anti").select("alias").orderBy("alias")


def backfill_attributes(legacy: DataFrame, column: str = "attributes") -> DataFrame:
    """`legacy` with the event-keyed JSON map of attribute lists as one sorted list of distinct keys; broken JSON gives none."""
    parsed = F.from_json(column, "map<string,array<string>>")
    keys = F.array_sort(F.array_distinct(F.filter(F.flatten(F.map_values(parsed)), lambda x: x.isNotNull())))
    return legacy.withColumn(column, F.coalesce(keys, F.array().cast("array<string>")))


def stored_tables(t: Tables, days: DataFrame) -> Tables:
    """These tables with the given days stored as aggregates, beside raw rows that are not dropped yet."""
    makers = {name: lambda f=family, c=compute: c(t.only(f, days)) for name, (family, compute) in VIEWS.items()}
    return replace(t, agg=Lazy(makers | {"v_retention": lambda: retention_cells(t)}), agg_days=days)
