"""Stitched views: stored aggregates of finished days beside live ones of the others.

`agg_days` says which days of a family are stored. A stored day never comes
from raw rows as well, so numbers don't move or double when a day ages over.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.operators import cohorts, rollups

_DAY = ["project", "day"]
#: Runs of stored days that a condition on partitions may name; where there are more, the halves of a view are told apart by joins.
MOST_RUNS = 1000


def noted_days(agg_days: DataFrame) -> dict[str, Column] | None:
    """For each family the condition on project and day under which a day is stored; None beyond MOST_RUNS runs of days.

    Stored days follow one another, so a project has a run or two. As a
    condition they prune partitions when the plan is made, where a join would
    read the rows first.
    """
    order = W.partitionBy("family", "project").orderBy("day")
    days = agg_days.distinct().withColumn("_run", F.date_sub("day", F.row_number().over(order)))
    runs = days.groupBy("family", "project", "_run").agg(F.min("day").alias("first"), F.max("day").alias("last")).limit(MOST_RUNS + 1).collect()
    if len(runs) > MOST_RUNS:
        return None
    together = defaultdict(list)
    for r in runs:
        together[r["family"], r["first"], r["last"]].append(r["project"])
    by_family = defaultdict(list)
    for (family, first, last), projects in together.items():
        by_family[family].append(F.col("project").isin(projects) & F.col("day").between(F.lit(first), F.lit(last)))
    return {family: F.coalesce(_any(conditions), F.lit(False)) for family, conditions in by_family.items()}


def _any(conditions: list[Column]) -> Column:
    """One condition or another, as a tree that is no deeper than need be."""
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:]) if half else conditions[0]


class Lazy(Mapping):
    """Frames by name, each built when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


@dataclass
class Tables:
    web: DataFrame
    app: DataFrame
    product: DataFrame
    projects: DataFrame
    identities: DataFrame
    #: Stored aggregates by view name, and the days that they hold: family, project, day.
    agg: Mapping[str, DataFrame] = field(default_factory=dict)
    agg_days: DataFrame | None = None
    #: What `noted_days` gives for agg_days, if it was asked for.
    noted: Mapping[str, Column] | None = None
    #: Actors and retention cells of days whose raw rows may be gone.
    known: DataFrame | None = None
    cells: DataFrame | None = None
    attribute_cap: int = rollups.ATTRIBUTE_CAP
    dimension_cap: int = rollups.DIMENSION_CAP

    def without(self, family: str) -> Tables:
        """These tables with only the raw rows of days that `family` has not stored."""
        if self.noted is not None:
            return self._where(~self.noted.get(family, F.lit(False)))
        if self.agg_days is None:
            return self
        stored = self.agg_days.where(F.col("family") == family).select(*_DAY)
        return replace(self, **{name: getattr(self, name).join(stored, _DAY, "left_anti") for name in ("web", "app", "product")})

    def only(self, family: str, days: DataFrame, noted: Mapping[str, Column] | None = None) -> Tables:
        """These tables with only the raw rows of the given days of `family`; `noted` is what `noted_days` gives for them."""
        if noted is not None:
            return self._where(noted.get(family, F.lit(False)))
        wanted = days.where(F.col("family") == family).select(*_DAY)
        return replace(self, **{name: getattr(self, name).join(wanted, _DAY, "left_semi") for name in ("web", "app", "product")})

    def _where(self, condition: Column) -> Tables:
        return replace(self, **{name: getattr(self, name).where(condition) for name in ("web", "app", "product")})


def _web(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: rollups.web_dimension(t.web, name)


def _app(name: str) -> Callable[[Tables], DataFrame]:
    return lambda t: rollups.app_dimension(t.app, name, t.dimension_cap)


#: Family and aggregate of each view.
VIEWS: dict[str, tuple[str, Callable[[Tables], DataFrame]]] = {
    "v_web_daily": ("web", lambda t: rollups.web_daily(t.web)),
    **{f"v_web_{name}": ("web", _web(name)) for name in rollups.WEB_DIMENSIONS},
    "v_product_daily": ("product", lambda t: rollups.product_daily(t.product)),
    "v_product_totals": ("product", lambda t: rollups.product_totals(t.product)),
    "v_product_attrs": ("product", lambda t: rollups.product_attrs(t.product, t.projects, t.attribute_cap)),
    "v_app_daily": ("app", lambda t: rollups.app_daily(t.app)),
    **{f"v_app_{name}": ("app", _app(name)) for name in rollups.APP_DIMENSIONS},
    "v_identity_daily": ("identity", lambda t: cohorts.identity_daily(t.web, t.app, t.product, t.dimension_cap)),
}


def stitch(name: str, t: Tables) -> DataFrame:
    """The stored half of a view, the days that are noted, and the live half of all other days."""
    family, live = VIEWS[name]
    fresh = live(t.without(family))
    if name not in t.agg:  # no stored day has had a row
        return fresh
    stored = t.agg[name].select(*fresh.columns)
    # a pass that stopped may have written days that it did not note
    if t.noted is not None:
        stored = stored.where(t.noted.get(family, F.lit(False)))
    elif t.agg_days is not None:
        stored = stored.join(t.agg_days.where(F.col("family") == family).select(*_DAY), _DAY, "left_semi")
    return stored.unionByName(fresh)


def flat_events(product: DataFrame, keys: list[str]) -> DataFrame:
    """Product events with a column for each declared key; an absent attribute is null.

    Keys go in sorted order. What is no letter, digit or underscore becomes an
    underscore, and names that collide get _2, _3 and so on.
    """
    taken: set[str] = set()
    columns = []
    for key in sorted(set(keys)):
        base = name = "attr_" + re.sub(r"[^A-Za-z0-9_]", "_", key)
        n = 1
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        columns.append(F.try_element_at("attributes", F.lit(key)).alias(name))
    return product.select("project", "day", "ts", "event_name", "actor_id", "user_id", *columns)


def declared_keys(projects: DataFrame) -> DataFrame:
    """The attribute keys that any project declares, sorted."""
    return projects.select(F.explode("attributes").alias("key")).distinct().orderBy("key")


def view(name: str, t: Tables) -> DataFrame:
    if name == "v_retention":
        return cohorts.with_cohort_size(t.agg["v_retention"] if "v_retention" in t.agg else retention_cells(t))
    if name == "v_events_flat":
        # declared keys are the registry's, a few for each project
        return flat_events(t.product, [r["key"] for r in declared_keys(t.projects).collect()])
    if name not in VIEWS:
        raise ValueError(f"no view {name}; there are {', '.join([*VIEWS, 'v_retention', 'v_events_flat'])}")
    return stitch(name, t)


def retention_cells(t: Tables) -> DataFrame:
    """Cells of the raw days, by all actors ever known, beside the stored ones of days that have left."""
    fresh = cohorts.retention(cohorts.actors(t.app, t.web, t.product, t.known), t.app, t.web, t.product, t.projects)
    return fresh if t.cells is None else cohorts.merge_cells(t.cells, fresh)


def view_names() -> list[str]:
    return [*VIEWS, "v_retention", "v_events_flat", "projects", "identities"]


def register_views(spark: SparkSession, t: Tables, names: list[str] | None = None) -> list[str]:
    """Make views (all, if none are named), projects and identities temporary views of `spark`, which may be a session of its own."""
    names = view_names() if names is None else names
    for name in names:
        frame = extracted(name, t)
        if frame.sparkSession is not spark:
            plan = frame._jdf.queryExecution().analyzed()
            frame = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)
        frame.createOrReplaceTempView(name)
    return names


def extracted(name: str, t: Tables) -> DataFrame:
    """A view, or the projects or identities table."""
    return {"projects": t.projects, "identities": t.identities}[name] if name in ("projects", "identities") else view(name, t)


def export_extract(name: str, t: Tables, path: str, with_sentinel: bool = False) -> None:
    """Write a view as Parquet; on request an empty one gets a row of blanks, for readers that need one."""
    extract(name, t, with_sentinel).write.mode("overwrite").parquet(path)


def extract(name: str, t: Tables, with_sentinel: bool = False) -> DataFrame:
    df = extracted(name, t)
    if not with_sentinel:
        return df
    blank = {"string": F.lit(""), "date": F.lit("1970-01-01").cast("date"), "timestamp": F.lit("1970-01-01").cast("timestamp")}
    row = df.sparkSession.range(1).select(*[blank.get(kind, F.lit(None if "<" in kind else 0)).cast(kind).alias(c) for c, kind in df.dtypes])
    some = df.limit(1).agg(F.count("*").alias("_n"))
    return df.unionByName(row.crossJoin(some).where("_n = 0").drop("_n"))
