"""The three raw families, registry tables and envelopes, derived from an `events` table.

The statements run unchanged on Spark and on any engine with standard SQL, so
results over them can be compared between engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EV = """
SELECT CAST(event_id AS STRING) AS id, 'p' || CAST(user_id % 3 AS STRING) AS project,
       date_trunc('second', ts) AS ts, CAST(ts AS DATE) AS day,
       'a' || CAST(user_id % 5 AS STRING) AS actor_id,
       CASE WHEN user_id % 2 = 0 THEN 'u' || CAST(user_id % 10 AS STRING) ELSE '' END AS user_id,
       CASE WHEN user_id % 5 <> 0 THEN 'g' || CAST(user_id % 7 AS STRING) ELSE '' END AS group_id,
       event_type, event_id AS n, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
FROM events
"""
WEB_HITS = """
SELECT id, project, day, ts, ts AS received_at, actor_id, user_id, group_id,
       CASE n % 3 WHEN 0 THEN 'shop.example.com' WHEN 1 THEN 'app.example.com' ELSE '' END AS host,
       '/p/' || CAST(k % 20 AS STRING) AS path,
       CASE k % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'hackernews' WHEN 2 THEN 'example.org' ELSE '' END AS referrer_source,
       CASE k % 4 WHEN 0 THEN 'hn' WHEN 1 THEN 'newsletter' ELSE '' END AS utm_source,
       CASE k % 4 WHEN 0 THEN 'social' WHEN 1 THEN 'email' ELSE '' END AS utm_medium,
       CASE k % 8 WHEN 0 THEN 'launch' WHEN 1 THEN 'weekly' ELSE '' END AS utm_campaign,
       CASE n % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE '' END AS country,
       CASE n % 10 WHEN 0 THEN 'tablet' WHEN 1 THEN 'mobile' WHEN 2 THEN 'mobile' ELSE 'desktop' END AS device,
       CASE n % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' ELSE 'Firefox' END AS browser,
       CASE n % 4 WHEN 0 THEN 'macOS' WHEN 1 THEN 'Windows' WHEN 2 THEN 'iOS' ELSE 'Android' END AS os
FROM ev WHERE event_type IN ('view', 'click')
"""
APP_VIEWS = """
SELECT id, project, day, ts, ts AS received_at, actor_id, user_id, group_id,
       CASE WHEN n % 3 = 0 THEN 's' || CAST(k % 4 AS STRING) ELSE '' END AS session_id,
       '/s/' || CAST(k % 30 AS STRING) AS screen,
       CASE n % 2 WHEN 0 THEN 'ios' ELSE 'android' END AS platform,
       CASE k % 3 WHEN 0 THEN '2.2.0' WHEN 1 THEN '2.3.0' ELSE '2.4.1' END AS app_version,
       CASE n % 4 WHEN 0 THEN '17.2' WHEN 2 THEN '16.6' WHEN 1 THEN '14' ELSE '13' END AS os_version,
       'm' || CAST(k % 9 AS STRING) AS device_model, 'en-US' AS locale,
       CASE n % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'DE' WHEN 2 THEN 'FR' ELSE '' END AS country
FROM ev WHERE event_type = 'error'
"""
PRODUCT_EVENTS = """
SELECT id, project, day, ts, ts AS received_at, event_type AS event_name, actor_id, user_id, group_id,
       CASE n % 3 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' ELSE '' END AS platform,
       CASE k % 3 WHEN 0 THEN '2.2.0' WHEN 1 THEN '2.3.0' ELSE '' END AS app_version,
       CASE k % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'team' END AS attr_plan,
       CASE WHEN k % 2 = 0 THEN 'b' || CAST(k AS STRING) END AS attr_button
FROM ev WHERE event_type IN ('signup', 'purchase')
"""
PROJECTS = """
SELECT 'p' || CAST(p AS STRING) AS alias, 'Project ' || CAST(p AS STRING) AS name,
       CASE WHEN p = 2 THEN 'anonymous' ELSE 'identified' END AS identity, p = 1 AS archived
FROM (SELECT DISTINCT user_id % 3 AS p FROM events) AS t
"""
IDENTITIES = """
SELECT project, 'user' AS kind, user_id AS id, 'User ' || user_id AS name, max(ts) AS updated_at FROM ev WHERE user_id IN ('u0', 'u2', 'u4') GROUP BY project, user_id
UNION ALL
SELECT project, 'group' AS kind, group_id AS id, 'Group ' || group_id AS name, max(ts) AS updated_at FROM ev WHERE group_id IN ('g1', 'g2', 'g3') GROUP BY project, group_id
"""
#: One row for each event as a client sends it, batched by user and day.
REQUESTS = """
SELECT CAST(user_id AS STRING) || '/' || CAST(CAST(ts AS DATE) AS STRING) AS batch_id, event_id AS n, user_id % 3 AS p, user_id AS u,
       CASE WHEN user_id % 11 = 0 THEN 'k9' ELSE 'k' || CAST(user_id % 3 AS STRING) END AS request_key,
       CASE user_id % 4 WHEN 0 THEN 'https://shop.example.com' WHEN 1 THEN '' WHEN 2 THEN 'https://a.b.example.com/' ELSE 'https://evil.example.net' END AS origin,
       '00000000-0000-4000-8000-' || lpad(CAST(event_id AS STRING), 12, '0') AS id, ts,
       CASE event_type WHEN 'view' THEN '$pageview' WHEN 'error' THEN '$screen_view' WHEN 'click' THEN '$odd' ELSE event_type END AS name,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day_start
FROM events
"""
PROJECT_ATTRIBUTES = {"p0": ["plan", "button"], "p1": ["plan"], "p2": []}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def from_ev(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A statement over `ev`, one row for each driver event."""
    source = _events(spark, sf_dir)
    ev = spark.sql(EV.replace("FROM events", "FROM {events}"), events=source)
    return spark.sql(statement.replace("FROM ev ", "FROM {ev} "), ev=ev)


def web_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ev(spark, sf_dir, WEB_HITS)


def app_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ev(spark, sf_dir, APP_VIEWS)


def product_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = from_ev(spark, sf_dir, PRODUCT_EVENTS)
    attributes = F.map_filter(F.create_map(F.lit("plan"), "attr_plan", F.lit("button"), "attr_button"), lambda _, v: v.isNotNull())
    return rows.withColumn("attributes", attributes).drop("attr_plan", "attr_button")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(PROJECTS.replace("FROM events", "FROM {events}"), events=_events(spark, sf_dir))
    declared = F.create_map(*[x for p, keys in PROJECT_ATTRIBUTES.items() for x in (F.lit(p), F.array(*map(F.lit, keys)).cast("array<string>"))])
    return rows.withColumn("attributes", F.try_element_at(declared, F.col("alias")))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ev(spark, sf_dir, IDENTITIES).withColumn("last_seen_day", F.lit(None).cast("date"))


def registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Projects with origins and retention, keys, and daily salts, for the ingest."""
    days = "struct<raw_days:int,aggregate_days:int>"
    known = projects(spark, sf_dir).withColumns({
        "archived": F.lit(False),
        "allowed_origins": F.when(F.col("alias") == "p2", F.array(F.lit("*"))).otherwise(F.array(F.lit("https://shop.example.com"), F.lit("https://*.example.com"))),
        "retention": F.lit(None).cast(f"struct<web:{days},product:{days},app:{days}>"),
    })
    keys = known.select(F.concat(F.lit("k"), F.substring("alias", 2, 9)).alias("key"), F.col("alias").alias("project"), F.concat(F.lit("label "), "alias").alias("label"), F.lit(False).alias("disabled"))
    salted = _events(spark, sf_dir).select(F.to_date("ts").cast("timestamp").alias("valid_from")).distinct()
    salts = salted.select("valid_from", (F.col("valid_from") + F.expr("interval 1 day")).alias("valid_to"), F.concat(F.lit("salt "), F.to_date("valid_from").cast("string")).alias("salt"))
    return known, keys, salts


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request envelopes: received at noon, an event in nine without a time, an odd key in ten, no path in every 13th page view.

    Times go out with all their digits: whether one is too far ahead is judged before it is cut to seconds.
    """
    rows = spark.sql(REQUESTS.replace("FROM events", "FROM {events}"), events=_events(spark, sf_dir))
    pairs = F.struct(
        F.when((F.col("name") == "$pageview") & (F.col("n") % 13 != 0), F.concat(F.lit("/p/"), F.col("k").cast("string"))).alias("$path"),
        F.when(F.col("name") == "$screen_view", F.concat(F.lit("/s/"), F.col("k").cast("string"))).alias("$screen"),
        F.when(F.col("n") % 10 == 0, F.lit("x")).alias("$unheard"),
        (F.col("k") / 2).alias("half"),
        (F.col("k") % 2 == 0).alias("even"),
    )
    event = F.struct(F.col("id"), F.when(F.col("n") % 9 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("ts"), F.col("name"), pairs.alias("attributes"))
    batches = rows.groupBy("batch_id", "u", "p", "request_key", "origin", "day_start").agg(F.array_sort(F.collect_list(event)).alias("events"))
    base = F.struct(F.when(F.col("u") % 2 == 0, F.concat(F.lit("u"), F.col("u").cast("string"))).alias("$user_id"), F.lit("shop.example.com").alias("$host"), F.lit("base").alias("plan"))
    body = F.struct(F.col("request_key").alias("key"), base.alias("attributes"), "events")
    return batches.select(
        "batch_id", (F.col("day_start") + F.expr("interval 12 hours")).alias("received_at"), F.concat(F.lit("10.0.0."), (F.col("u") % 250).cast("string")).alias("ip"),
        F.when(F.col("u") % 17 == 0, "curl/8").otherwise("Mozilla/5.0 (Windows) Firefox/1").alias("user_agent"), "origin", F.lit("de").alias("cf_country"), F.lit("").alias("header_key"), F.to_json(body).alias("body"),
    )
