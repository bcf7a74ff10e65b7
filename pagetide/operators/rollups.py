"""Daily aggregates of the three raw families, for all projects and days at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.operators.sessions import GAP_SECONDS, app_sessions, web_sessions

OTHER = "(other)"
DIMENSION_CAP = 500
ATTRIBUTE_CAP = 50
_DAY = ["project", "day"]

#: Columns of each web breakdown, by the name they have there.
WEB_DIMENSIONS = {
    "pages": {"path": "path"},
    "hosts": {"host": "host"},
    "referrers": {"source": "referrer_source"},
    "countries": {"country": "country"},
    "devices": {"device": "device"},
    "browsers": {"browser": "browser"},
    "os": {"os": "os"},
    "utm": {"utm_source": "utm_source", "utm_medium": "utm_medium", "utm_campaign": "utm_campaign"},
}
#: Columns of each app breakdown; only the last one collapses into the tail.
APP_DIMENSIONS = {
    "screens": ["screen"],
    "versions": ["platform", "app_version"],
    "os": ["platform", "os_version"],
    "devices": ["device_model"],
    "countries": ["country"],
}


def web_daily(hits: DataFrame, gap_s: int = GAP_SECONDS) -> DataFrame:
    """visitors, pageviews, sessions, bounces and duration_sec.

    All five come from the sessions, so hits are shuffled once: every actor of
    a day has exactly one first session.
    """
    return web_sessions(hits, gap_s).groupBy(*_DAY).agg(
        F.count_if(F.col("session_no") == 1).alias("visitors"),
        F.sum("hit_count").alias("pageviews"),
        F.count("*").alias("sessions"),
        F.count_if(F.col("hit_count") == 1).alias("bounces"),
        F.sum("duration_sec").alias("duration_sec"),
    )


def live_daily(parts: DataFrame) -> DataFrame:
    """What web_daily gives, from merged session parts: one row for each session instead of one for each hit."""
    by_actor = parts.groupBy(*_DAY, "actor_id").agg(
        F.sum("hit_count").alias("hits"), F.count("*").alias("n"), F.count_if(F.col("hit_count") == 1).alias("single"), F.sum(F.col("ended") - F.col("started")).alias("s")
    )
    return by_actor.groupBy(*_DAY).agg(
        F.count("*").alias("visitors"), F.sum("hits").alias("pageviews"), F.sum("n").alias("sessions"), F.sum("single").alias("bounces"), F.sum("s").alias("duration_sec")
    )


def web_dimension(hits: DataFrame, name: str) -> DataFrame:
    """visitors and pageviews by one breakdown; for utm, hits without any campaign are left out."""
    columns = WEB_DIMENSIONS[name]
    if name == "utm":
        hits = hits.where("NOT (utm_source = '' AND utm_medium = '' AND utm_campaign = '')")
    named = hits.select(*_DAY, "actor_id", *[F.col(c).alias(k) for k, c in columns.items()])
    return named.groupBy(*_DAY, *columns).agg(F.countDistinct("actor_id").alias("visitors"), F.count("*").alias("pageviews"))


def web_dimensions(hits: DataFrame) -> DataFrame:
    """All web breakdowns from one scan: dimension, values (an array), visitors, pageviews."""
    campaign = F.array("utm_source", "utm_medium", "utm_campaign")
    every = [F.struct(F.lit(name).alias("dimension"), (campaign if name == "utm" else F.array(*columns.values())).alias("values")) for name, columns in WEB_DIMENSIONS.items()]
    long = hits.select(*_DAY, "actor_id", F.explode(F.array(*every)).alias("x")).select(*_DAY, "actor_id", "x.*")
    long = long.where(~((F.col("dimension") == "utm") & (F.array_join("values", "") == "")))
    # counting by actor first leaves little for the second shuffle
    actors = long.groupBy(*_DAY, "dimension", "values", "actor_id").agg(F.count("*").alias("n"))
    return actors.groupBy(*_DAY, "dimension", "values").agg(F.count("*").alias("visitors"), F.sum("n").alias("pageviews"))


def product_daily(events: DataFrame) -> DataFrame:
    return events.groupBy(*_DAY, "event_name").agg(F.count("*").alias("count"), F.countDistinct("actor_id").alias("unique_users"))


def product_totals(events: DataFrame) -> DataFrame:
    return events.groupBy(*_DAY).agg(F.count("*").alias("total_events"), F.countDistinct("actor_id").alias("active_users"))


def top_n_bucket(df: DataFrame, part: list[str], keys: list[str], last: str, n: int, actor: str, count: str, uniques: str) -> DataFrame:
    """Counts and exact distinct actors of the n most frequent keys of a part; the rest is one tail.

    Ranks go by count descending, then by the key columns. In the tail only
    `last` becomes "(other)"; a value that a client named so joins it. Rows
    are counted by actor first, so ranks and tail need no second look at them.
    """
    columns = [*part, *keys]
    actors = df.groupBy(*columns, actor).agg(F.count("*").alias("_n"))
    counts = actors.groupBy(*columns).agg(F.sum("_n").alias("_total"))
    order = W.partitionBy(*part).orderBy(F.desc("_total"), *keys)
    top = counts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_total")
    joined = actors.alias("a").join(top.alias("t"), [F.col(f"a.{c}").eqNullSafe(F.col(f"t.{c}")) for c in columns], "left")
    bucket = F.when(F.col("_rank").isNotNull(), F.col(f"a.{last}")).otherwise(F.lit(OTHER))
    kept = [F.col(f"a.{c}").alias(c) for c in columns if c != last]
    return joined.select(*kept, bucket.alias(last), F.col(f"a.{actor}").alias(actor), "_n").groupBy(*columns).agg(
        F.sum("_n").alias(count), F.countDistinct(actor).alias(uniques)
    )


def attribute_values(events: DataFrame, projects: DataFrame) -> DataFrame:
    """One row for each declared attribute, and each system dimension, that an event has."""
    declared = projects.select(F.col("alias").alias("project"), F.col("attributes").alias("_declared"))
    known = events.join(F.broadcast(declared), "project", "left")
    own = F.transform(F.coalesce("_declared", F.array().cast("array<string>")), lambda k: F.struct(k.alias("attr_key"), F.try_element_at("attributes", k).alias("attr_value")))
    system = F.array(*[F.struct(F.lit(f"${c}").alias("attr_key"), F.nullif(F.col(c), F.lit("")).alias("attr_value")) for c in ("platform", "app_version")])
    return known.select(*_DAY, "event_name", "actor_id", F.explode(F.concat(own, system)).alias("x")).select(*_DAY, "event_name", "actor_id", "x.*").where("attr_value IS NOT NULL")


def product_attrs(events: DataFrame, projects: DataFrame, top_n: int = ATTRIBUTE_CAP) -> DataFrame:
    """count and unique_users by event, attribute and value, the top values of each and a tail.

    A cap that is not positive means the usual one.
    """
    top_n = top_n if top_n > 0 else ATTRIBUTE_CAP
    return top_n_bucket(attribute_values(events, projects), [*_DAY, "event_name", "attr_key"], ["attr_value"], "attr_value", top_n, "actor_id", "count", "unique_users")


def app_daily(views: DataFrame, gap_s: int = GAP_SECONDS) -> DataFrame:
    """actives, views, sessions and duration_sec; a day without views has no row."""
    by_actor = app_sessions(views, gap_s).groupBy(*_DAY, "actor_id").agg(
        F.count("*").alias("sessions"), F.sum("view_count").alias("views"), F.sum("duration_sec").alias("duration_sec")
    )
    return by_actor.groupBy(*_DAY).agg(
        F.count("*").alias("actives"), F.sum("views").alias("views"), F.sum("sessions").alias("sessions"), F.sum("duration_sec").alias("duration_sec")
    )


def app_dimension(views: DataFrame, name: str, cap: int = DIMENSION_CAP) -> DataFrame:
    """actives and views by one breakdown, capped for each project and day."""
    keys = APP_DIMENSIONS[name]
    return top_n_bucket(views, _DAY, keys, keys[-1], cap, "actor_id", "views", "actives")
