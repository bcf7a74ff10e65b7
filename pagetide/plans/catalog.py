"""Registered queries over tables derived from the driver's, and DuckDB SQL with the same results."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide.functions import enrich, hashing, urls
from pagetide.operators import cohorts, lifecycle, normalise, rollups, sessions
from pagetide.plans import catalog_flows, reports, views
from pagetide.plans.views import Tables
from pagetide.sources import driver_tables as source
from pagetide.sources import store

Query = Callable[[SparkSession, str], DataFrame]

PROJECT, FROM, TO, DAYS = "p0", "2024-01-10", "2024-01-20", 30
FIRST_LIVE_DAY, TODAY = "2024-01-16", "2024-01-31"
ATTRIBUTE_CAP, DIMENSION_CAP = 10, 5

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Families with the days before FIRST_LIVE_DAY stored, so that views have both halves."""
    web, app, product = source.web_hits(spark, sf_dir), source.app_views(spark, sf_dir), source.product_events(spark, sf_dir)
    t = Tables(web, app, product, source.projects(spark, sf_dir), source.identities(spark, sf_dir), attribute_cap=ATTRIBUTE_CAP, dimension_cap=DIMENSION_CAP)
    raw_days = web.select("project", "day").union(app.select("project", "day")).union(product.select("project", "day")).distinct()
    families = F.explode(F.array(*map(F.lit, ("web", "app", "product", "identity"))))
    old = raw_days.where(F.col("day") < F.lit(FIRST_LIVE_DAY).cast("date")).select(families.alias("family"), "project", "day")
    return lifecycle.stored_tables(t, old)


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = f"{_COMMON}\n{sql}"


def _on(function: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(tables(spark, sf_dir))


def _capped(frame: str, part: str, keys: list[str], n: int, count: str, uniques: str) -> str:
    """Top values of a part and their tail, as SQL over the CTE `frame`."""
    columns = ", ".join(keys)
    kept = "".join(f"x.{k}, " for k in keys[:-1])
    same = " AND ".join(f"x.{k} = r.{k}" for k in [*part.split(", "), *keys])
    return f"""
SELECT {', '.join('x.' + p for p in part.split(', '))}, {kept}CASE WHEN r.rn <= {n} THEN x.{keys[-1]} ELSE '(other)' END AS {keys[-1]},
       count(*) AS {count}, count(DISTINCT x.actor_id) AS {uniques}
FROM {frame} x JOIN (SELECT {part}, {columns}, row_number() OVER (PARTITION BY {part} ORDER BY count(*) DESC, {columns}) AS rn
                     FROM {frame} GROUP BY {part}, {columns}) r ON {same}
GROUP BY ALL"""


def _dimension_sql(select: str, where: str = "") -> str:
    return f"SELECT project, day, {select}, count(DISTINCT actor_id) AS visitors, count(*) AS pageviews FROM web_hits {where} GROUP BY ALL"


_WEB_SQL = {
    name: _dimension_sql(", ".join(f"{c} AS {k}" for k, c in columns.items()), "WHERE NOT (utm_source = '' AND utm_medium = '' AND utm_campaign = '')" if name == "utm" else "")
    for name, columns in rollups.WEB_DIMENSIONS.items()
}
_DECLARED = " UNION ALL ".join(
    f"SELECT project, day, event_name, actor_id, '{key}' AS attr_key, attr_{key} AS attr_value FROM product_events WHERE project = '{p}' AND attr_{key} IS NOT NULL"
    for p, keys in source.PROJECT_ATTRIBUTES.items()
    for key in keys
)
_VIEW_SQL = {
    "v_web_daily": """SELECT a.project, a.day, visitors, pageviews, sessions, bounces, duration_sec
FROM (SELECT project, day, count(DISTINCT actor_id) AS visitors, count(*) AS pageviews FROM web_hits GROUP BY ALL) a
JOIN (SELECT project, day, count(*) AS sessions, count(*) FILTER (hit_count = 1) AS bounces, CAST(sum(duration_sec) AS BIGINT) AS duration_sec FROM web_sess GROUP BY ALL) b
  ON a.project = b.project AND a.day = b.day""",
    **{f"v_web_{name}": sql for name, sql in _WEB_SQL.items()},
    "v_product_daily": "SELECT project, day, event_name, count(*) AS count, count(DISTINCT actor_id) AS unique_users FROM product_events GROUP BY ALL",
    "v_product_totals": "SELECT project, day, count(*) AS total_events, count(DISTINCT actor_id) AS active_users FROM product_events GROUP BY ALL",
    "v_product_attrs": _capped("attrs", "project, day, event_name, attr_key", ["attr_value"], ATTRIBUTE_CAP, "count", "unique_users"),
    "v_app_daily": """SELECT a.project, a.day, actives, views, sessions, duration_sec
FROM (SELECT project, day, count(DISTINCT actor_id) AS actives, count(*) AS views FROM app_views GROUP BY ALL) a
JOIN (SELECT project, day, count(*) AS sessions, CAST(sum(duration_sec) AS BIGINT) AS duration_sec FROM app_sess GROUP BY ALL) b
  ON a.project = b.project AND a.day = b.day""",
    **{f"v_app_{name}": _capped("app_views", "project, day", keys, DIMENSION_CAP, "views", "actives") for name, keys in rollups.APP_DIMENSIONS.items()},
    "v_identity_daily": f"""SELECT project, day, kind, id, actors, CASE WHEN kind = 'user' THEN 1 ELSE users END AS users, hits, views, events
FROM (SELECT project, day, kind, id, count(DISTINCT actor_id) AS actors, count(DISTINCT nullif(user_id, '')) AS users,
        CAST(sum(h) AS BIGINT) AS hits, CAST(sum(v) AS BIGINT) AS views, CAST(sum(e) AS BIGINT) AS events,
        row_number() OVER (PARTITION BY project, day, kind ORDER BY count(*) DESC, id) AS rn
      FROM activity GROUP BY project, day, kind, id) WHERE rn <= {DIMENSION_CAP}""",
    "v_retention": """SELECT c.project, c.surface, c.cohort_day, c.day_offset, c.actors, s.actors AS cohort_size
FROM cells c JOIN cells s ON c.project = s.project AND c.surface = s.surface AND c.cohort_day = s.cohort_day AND s.day_offset = 0""",
    "v_events_flat": "SELECT project, day, ts, event_name, actor_id, user_id, attr_button, attr_plan FROM product_events",
}
_COMMON = f"""WITH ev AS ({source.EV}), web_hits AS ({source.WEB_HITS}), app_views AS ({source.APP_VIEWS}), product_events AS ({source.PRODUCT_EVENTS}),
projects AS ({source.PROJECTS}), identities AS ({source.IDENTITIES}), requests AS ({source.REQUESTS}),
web_marked AS (SELECT project, day, actor_id, t, CASE WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 1800 THEN 1 ELSE 0 END AS new
  FROM (SELECT project, day, actor_id, CAST(epoch(ts) AS BIGINT) AS t FROM web_hits) WINDOW w AS (PARTITION BY project, day, actor_id ORDER BY t)),
web_sess AS (SELECT project, day, actor_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS hit_count, max(t) - min(t) AS duration_sec
  FROM (SELECT *, sum(new) OVER (PARTITION BY project, day, actor_id ORDER BY t) AS session_no FROM web_marked) GROUP BY ALL),
app_marked AS (SELECT project, day, actor_id, session_id, t, CASE WHEN session_id <> '' THEN 0 WHEN lag(t) OVER w IS NULL OR t - lag(t) OVER w > 1800 THEN 1 ELSE 0 END AS new
  FROM (SELECT project, day, actor_id, session_id, CAST(epoch(ts) AS BIGINT) AS t FROM app_views) WINDOW w AS (PARTITION BY project, day, actor_id ORDER BY t)),
app_sess AS (SELECT project, day, actor_id, session_key, count(*) AS view_count, max(t) - min(t) AS duration_sec
  FROM (SELECT *, CASE WHEN session_id <> '' THEN 'd:' || session_id ELSE 'g:' || CAST(sum(new) OVER (PARTITION BY project, day, actor_id ORDER BY t) AS VARCHAR) END AS session_key FROM app_marked) GROUP BY ALL),
attrs AS ({_DECLARED}
  UNION ALL SELECT project, day, event_name, actor_id, '$platform', platform FROM product_events WHERE platform <> ''
  UNION ALL SELECT project, day, event_name, actor_id, '$app_version', app_version FROM product_events WHERE app_version <> ''),
every AS (SELECT project, day, actor_id, user_id, group_id, 1 AS h, 0 AS v, 0 AS e FROM web_hits UNION ALL
  SELECT project, day, actor_id, user_id, group_id, 0, 1, 0 FROM app_views UNION ALL SELECT project, day, actor_id, user_id, group_id, 0, 0, 1 FROM product_events),
activity AS (SELECT project, day, 'user' AS kind, user_id AS id, actor_id, user_id, h, v, e FROM every WHERE user_id <> '' UNION ALL
  SELECT project, day, 'group', group_id, actor_id, user_id, h, v, e FROM every WHERE group_id <> ''),
actors AS (SELECT project, actor_id, CASE WHEN min(day * 2 + CASE WHEN v = 1 THEN 0 ELSE 1 END) % 2 = 0 THEN 'app' ELSE 'web' END AS surface,
    DATE '1970-01-01' + CAST(min(day) AS INTEGER) AS first_seen_day, DATE '1970-01-01' + CAST(max(day) AS INTEGER) AS last_seen_day
  FROM (SELECT project, actor_id, v, date_diff('day', DATE '1970-01-01', day) AS day FROM every WHERE actor_id <> '') GROUP BY ALL),
cells AS (SELECT a.project, surface, first_seen_day AS cohort_day, date_diff('day', first_seen_day, day) AS day_offset, count(DISTINCT a.actor_id) AS actors
  FROM actors a JOIN (SELECT DISTINCT project, actor_id, day FROM every) x ON a.project = x.project AND a.actor_id = x.actor_id WHERE a.project <> 'p2' GROUP BY ALL)"""
# the views as further common table expressions, for reports
_VIEWS_COMMON = _COMMON + "".join(f",\n{name} AS ({sql})" for name, sql in _VIEW_SQL.items())


def _report(name: str, query: Query, sql: str) -> None:
    QUERIES[name] = query
    SQL[name] = f"{_VIEWS_COMMON}\n{sql}"


# Sources and sinks.
_add("src_2_raw_scan", lambda s, d: store.scan(source.web_hits(s, d), PROJECT, datetime.datetime(2024, 1, 10), datetime.datetime(2024, 1, 12, 12)), "SELECT * FROM web_hits WHERE project = 'p0' AND ts >= '2024-01-10' AND ts < '2024-01-12 12:00:00'")
_add("src_3_days_before", lambda s, d: store.days_before(source.web_hits(s, d), datetime.date(2024, 1, 10)), "SELECT DISTINCT day FROM web_hits WHERE day < '2024-01-10'")
_add("src_4_all_raw_days", lambda s, d: store.all_raw_days(source.web_hits(s, d), source.app_views(s, d), source.product_events(s, d)), "SELECT DISTINCT day FROM every")


def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = source.identities(spark, sf_dir)
    later = names.where("kind = 'user'").withColumn("name", F.concat("name", F.lit(" II"))).withColumn("updated_at", F.col("updated_at") + F.expr("interval 1 day"))
    older = names.withColumn("name", F.lit("old")).withColumn("updated_at", F.col("updated_at") - F.expr("interval 1 day"))
    return cohorts.upsert_names(names, later.unionByName(older).unionByName(later.withColumn("name", F.lit(""))))


_add("snk_3_upsert_names", _upsert, "SELECT project, kind, id, CASE WHEN kind = 'user' THEN name || ' II' ELSE name END AS name, CASE WHEN kind = 'user' THEN updated_at + INTERVAL 1 DAY ELSE updated_at END AS updated_at FROM identities")
_report("snk_4_extract", _on(lambda t: views.extract("v_web_daily", t, with_sentinel=True)), "SELECT * FROM v_web_daily")


# Ingest.
def _normalised(spark: SparkSession, sf_dir: str) -> normalise.Normalised:
    return normalise.normalise(source.envelopes(spark, sf_dir), *source.registry(spark, sf_dir))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    projects, keys, salts = source.registry(spark, sf_dir)
    return normalise.explode_events(normalise.authorise(source.envelopes(spark, sf_dir), projects, keys), salts)


_OPEN = "request_key <> 'k9' AND (origin = '' OR p = 2 OR origin LIKE '%.example.com%')"
_NOON = "day_start + INTERVAL 12 HOUR"
_ACCEPTED = f"""ok AS (SELECT *, 'p' || CAST(p AS VARCHAR) AS project, CASE WHEN n % 9 = 0 OR ts > {_NOON} + INTERVAL 5 MINUTE THEN {_NOON} ELSE date_trunc('second', ts) END AS moment,
  CASE WHEN u % 17 = 0 THEN 'curl/8' ELSE 'Mozilla/5.0 (Windows) Firefox/1' END AS ua, '10.0.0.' || CAST(u % 250 AS VARCHAR) AS ip, 'salt ' || CAST(CAST(day_start AS DATE) AS VARCHAR) AS salt,
  name = '$pageview' AND n % 13 = 0 AS bad FROM requests WHERE {_OPEN})"""
_add(
    "ing_1_2_batch_gate",
    lambda s, d: normalise.authorise(source.envelopes(s, d), *source.registry(s, d)[:2]).select("batch_id", F.coalesce("project", F.lit("")).alias("project"), F.coalesce("reject_reason", F.lit("")).alias("reject_reason")),
    f"SELECT DISTINCT batch_id, CASE WHEN request_key = 'k9' THEN '' ELSE 'p' || CAST(p AS VARCHAR) END AS project, CASE WHEN request_key = 'k9' THEN 'unauthorized' WHEN {_OPEN} THEN '' ELSE 'origin' END AS reject_reason FROM requests",
)
_add(
    "ing_4_12_15_events",
    lambda s, d: _events(s, d).select("id", "project", "event_name", "family", "ts", "actor_id", "user_id", F.coalesce("reject_reason", F.lit("")).alias("reject_reason")),
    f""", {_ACCEPTED}
SELECT id, project, name AS event_name, CASE name WHEN '$pageview' THEN 'web' WHEN '$screen_view' THEN 'app' ELSE 'product' END AS family, moment AS ts,
  CASE WHEN u % 2 = 0 AND p <> 2 THEN 'u' || CAST(u AS VARCHAR) WHEN u % 2 = 0 THEN left(sha256(salt || chr(0) || 'u' || CAST(u AS VARCHAR) || chr(0) || project || chr(0)), 16)
       ELSE left(sha256(salt || chr(0) || ip || chr(0) || ua || chr(0) || project || chr(0)), 16) END AS actor_id,
  CASE WHEN u % 2 <> 0 THEN '' WHEN p <> 2 THEN 'u' || CAST(u AS VARCHAR) ELSE left(sha256(salt || chr(0) || 'u' || CAST(u AS VARCHAR) || chr(0) || project || chr(0)), 16) END AS user_id,
  CASE WHEN bad THEN '$path is required' ELSE '' END AS reject_reason FROM ok""",
)
_add(
    "ing_13_14_web_family",
    lambda s, d: _normalised(s, d).web.select("id", "project", "day", "ts", "host", "path", "country", "device", "browser", "os"),
    f""", {_ACCEPTED}
SELECT id, project, CAST(moment AS DATE) AS day, moment AS ts, 'shop.example.com' AS host, '/p/' || CAST(k AS VARCHAR) AS path, 'DE' AS country, 'desktop' AS device, 'Firefox' AS browser, 'Windows' AS os
FROM ok WHERE name = '$pageview' AND NOT bad AND u % 17 <> 0""",
)
_add(
    "ing_13_app_family",
    lambda s, d: _normalised(s, d).app.select("id", "project", "day", "ts", "screen", "country"),
    f""", {_ACCEPTED} SELECT id, project, CAST(moment AS DATE) AS day, moment AS ts, '/s/' || CAST(k AS VARCHAR) AS screen, 'DE' AS country FROM ok WHERE name = '$screen_view'""",
)
_add(
    "ing_5_6_9_product_family",
    lambda s, d: _normalised(s, d).product.select("id", "event_name", *[F.try_element_at("attributes", F.lit(k)).alias(k) for k in ("plan", "half", "even")], F.size("attributes").cast("long").alias("n")),
    f""", {_ACCEPTED} SELECT id, name AS event_name, 'base' AS plan, CASE WHEN k % 2 = 0 THEN CAST(k // 2 AS VARCHAR) ELSE CAST(k // 2 AS VARCHAR) || '.5' END AS half,
  CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END AS even, CAST(3 AS BIGINT) AS n FROM ok WHERE name NOT IN ('$pageview', '$screen_view')""",
)
_add(
    "ing_8_17_batch_results",
    lambda s, d: _normalised(s, d).batch_results.select("batch_id", "project", "accepted", "rejected", F.coalesce(F.size("errors"), F.lit(0)).cast("long").alias("n_errors"), F.coalesce(F.size("warnings"), F.lit(0)).cast("long").alias("n_warnings")),
    f""", {_ACCEPTED} SELECT batch_id, project, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected, least(10, count(*) FILTER (bad)) AS n_errors,
  CAST(least(10, count(*) FILTER (NOT bad AND n % 10 = 0) + count(*) FILTER (name = '$odd')) AS BIGINT) AS n_warnings FROM ok GROUP BY ALL""",
)
_add(
    "ing_10_quarantine",
    lambda s, d: _normalised(s, d).quarantine.groupBy("reject_reason").agg(F.count("*").alias("n")),
    f""", {_ACCEPTED} SELECT '$path is required' AS reject_reason, count(*) AS n FROM ok WHERE bad HAVING count(*) > 0 UNION ALL
SELECT CASE WHEN request_key = 'k9' THEN 'unauthorized' ELSE 'origin' END, count(DISTINCT batch_id) FROM requests WHERE NOT ({_OPEN}) GROUP BY 1""",
)
_add(
    "ing_18_minute_counters",
    lambda s, d: normalise.minute_counters(_events(s, d)),
    f""", {_ACCEPTED} SELECT {_NOON} AS minute, 'label ' || project AS label, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected FROM ok GROUP BY ALL""",
)


def _hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.web_hits(spark, sf_dir)
    return rows.select("id", hashing.visitor_hash(F.lit("salt"), F.col("host"), F.col("browser"), F.col("project")).alias("visitor"), hashing.actor_hash(F.lit("salt"), F.col("user_id"), F.col("project")).alias("actor"))


_add("hash_1_2_keyed_hashes", _hash, "SELECT id, left(sha256('salt' || chr(0) || host || chr(0) || browser || chr(0) || project || chr(0)), 16) AS visitor, left(sha256('salt' || chr(0) || user_id || chr(0) || project || chr(0)), 16) AS actor FROM web_hits")


# Enrichment.
_UA = "CASE n % 7 WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0' WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) Version/17.2 Mobile/15E148 Safari/604.1' WHEN 2 THEN 'Mozilla/5.0 (Linux; Android 14; SM-X200 Tablet) SamsungBrowser/23.0 Chrome/115.0 Safari/537.36' WHEN 3 THEN 'Mozilla/5.0 (X11; CrOS x86_64 14541.0.0) Chrome/120.0 Safari/537.36' WHEN 4 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)' WHEN 5 THEN '' ELSE 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0' END"
_REFERRER = "CASE n % 8 WHEN 0 THEN 'https://www.google.de/search?q=x' WHEN 1 THEN 'https://news.ycombinator.com/item?id=1' WHEN 2 THEN 'http://WWW.Example.ORG:8080/a' WHEN 3 THEN 'https://shop.example.com/p/1' WHEN 4 THEN 'not an address' WHEN 5 THEN 'https://t.co/abc' WHEN 6 THEN 'https://my_host.example.net/x' ELSE '' END"
_RAW_HITS = f"SELECT id, n, {_UA} AS user_agent, {_REFERRER} AS referrer, 'www.shop.example.com' AS host, CASE n % 5 WHEN 0 THEN 'us' WHEN 1 THEN 'XX' WHEN 2 THEN 'T1' WHEN 3 THEN '' ELSE 'De' END AS cf_country FROM ev"
_add(
    "enr_1_6_enrich_hits",
    lambda s, d: enrich.enrich_hits(source.from_ev(s, d, _RAW_HITS + " ")).select("id", "device", "browser", "os", "referrer_source", "country"),
    """SELECT id, CASE n % 7 WHEN 1 THEN 'mobile' WHEN 2 THEN 'tablet' ELSE 'desktop' END AS device, CASE n % 7 WHEN 0 THEN 'Edge' WHEN 1 THEN 'Safari' WHEN 2 THEN 'Samsung Internet' WHEN 3 THEN 'Chrome' ELSE 'Firefox' END AS browser,
  CASE n % 7 WHEN 0 THEN 'Windows' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Android' WHEN 3 THEN 'ChromeOS' ELSE 'Linux' END AS os,
  CASE n % 8 WHEN 0 THEN 'google' WHEN 1 THEN 'hackernews' WHEN 2 THEN 'example.org' WHEN 5 THEN 'twitter' WHEN 6 THEN 'my_host.example.net' ELSE '' END AS referrer_source,
  CASE n % 5 WHEN 0 THEN 'US' WHEN 4 THEN 'DE' ELSE '' END AS country FROM ev WHERE n % 7 NOT IN (4, 5)""",
)


def _by_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = source.from_ev(spark, sf_dir, "SELECT id, '10.' || CAST(k % 4 AS STRING) || '.' || CAST(n % 256 AS STRING) || '.7' AS ip FROM ev ")
    ranges = hits.sparkSession.range(0, 4).select(*[(F.col("id") * 65536 + c).alias(n) for c, n in ((10 * 2**24, "ip_lo"), (10 * 2**24 + 40000, "ip_hi"))], F.concat(F.lit("C"), "id").alias("country"))
    return enrich.country_of_ip(hits, "ip", ranges).select("id", "country")


_add("enr_7_country_of_ip", _by_ip, "SELECT id, CASE WHEN (n % 256) * 256 + 7 <= 40000 THEN 'C' || CAST(k % 4 AS VARCHAR) ELSE '' END AS country FROM ev")

# Addresses.
_TAIL_SQL = r"regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')"
_PATH_SQL = rf"CASE WHEN regexp_extract({_TAIL_SQL}, '^([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({_TAIL_SQL}, '^([^?#]*)', 1) END"
_QUERY_SQL = rf"regexp_extract({_TAIL_SQL}, '^[^?#]*\?([^#]*)', 1)"
_MASKED_SQL = rf"array_to_string(list_transform(string_split({_PATH_SQL}, '/'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+$') OR regexp_matches(x, '(?i)^[0-9a-f]{{24,}}$') OR regexp_matches(x, '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') OR regexp_matches(x, '^[0-7][0-9A-HJKMNP-TV-Z]{{25}}$') THEN '[id]' ELSE x END), '/')"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


_add(
    "url_1_2_3_shape_urls",
    lambda s, d: urls.shape_urls(_pages(s, d), "url", {"numeric": True, "hex": True}),
    rf"""SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, {_MASKED_SQL} AS path,
  url_decode(regexp_extract({_QUERY_SQL}, '(?:^|&)utm_source=([^&]*)', 1)) AS utm_source, url_decode(regexp_extract({_QUERY_SQL}, '(?:^|&)utm_medium=([^&]*)', 1)) AS utm_medium,
  url_decode(regexp_extract({_QUERY_SQL}, '(?:^|&)utm_campaign=([^&]*)', 1)) AS utm_campaign FROM pages""",
)
_add(
    "url_1_hash_routing",
    lambda s, d: _pages(s, d).select("page_id", urls.path_of(F.col("url"), "hash").alias("path")),
    rf"""SELECT page_id, {_PATH_SQL} || CASE WHEN regexp_extract({_TAIL_SQL}, '#(.*)$', 1) = '' THEN '' ELSE '#' || regexp_extract({_TAIL_SQL}, '#([^?]*)', 1) END AS path FROM pages""",
)
_add(
    "url_4_mask_regex",
    lambda s, d: _pages(s, d).select("page_id", urls.mask_regex(urls.path_of(F.col("url")), "[0-9]+").alias("first"), urls.mask_regex(urls.path_of(F.col("url")), "[0-9]", True).alias("every")),
    rf"SELECT page_id, regexp_replace({_PATH_SQL}, '[0-9]+', '[id]') AS first, regexp_replace({_PATH_SQL}, '[0-9]', '[id]', 'g') AS every FROM pages",
)
_add(
    "url_6_with_query",
    lambda s, d: _pages(s, d).select("page_id", urls.with_query(urls.path_of(F.col("url")), F.col("url"), ["ref", "page"]).alias("path")),
    rf"""SELECT page_id, {_PATH_SQL} || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS path
FROM (SELECT page_id, url, list_filter([CASE WHEN regexp_matches({_QUERY_SQL}, '(?:^|&)page=') THEN 'page=' || regexp_extract({_QUERY_SQL}, '(?:^|&)page=([^&]*)', 1) END,
  CASE WHEN regexp_matches({_QUERY_SQL}, '(?:^|&)ref=') THEN 'ref=' || regexp_extract({_QUERY_SQL}, '(?:^|&)ref=([^&]*)', 1) END], lambda x: x IS NOT NULL) AS q FROM pages)""",
)
_add(
    "url_7_drop_consecutive",
    lambda s, d: urls.drop_consecutive(source.web_hits(s, d).withColumn("client", F.concat("project", "actor_id")), "client", "ts", "path", "id").select("id", "project", "actor_id", "path"),
    "SELECT id, project, actor_id, path FROM (SELECT *, lag(path) OVER (PARTITION BY project || actor_id ORDER BY ts, id) AS b FROM web_hits) WHERE b IS NULL OR b <> path",
)

# Sessions.
_add("ses_1_web_sessions", lambda s, d: sessions.web_sessions(source.web_hits(s, d)), "SELECT * FROM web_sess")
_add("ses_2_session_metrics", lambda s, d: sessions.session_metrics(sessions.web_sessions(source.web_hits(s, d))), "SELECT project, day, count(*) AS sessions, count(*) FILTER (hit_count = 1) AS bounces, CAST(sum(duration_sec) AS BIGINT) AS duration_sec FROM web_sess GROUP BY ALL")
_add("ses_3_app_sessions", lambda s, d: sessions.app_sessions(source.app_views(s, d)), "SELECT * FROM app_sess")

# Rollups and views share their SQL: a view is the same whatever days are stored.
_ROLLUPS = ["v_web_daily", *[f"v_web_{n}" for n in rollups.WEB_DIMENSIONS], "v_product_daily", "v_product_totals", "v_product_attrs", None, "v_app_daily", *[f"v_app_{n}" for n in rollups.APP_DIMENSIONS]]


def _rollup(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Tables(source.web_hits(spark, sf_dir), source.app_views(spark, sf_dir), source.product_events(spark, sf_dir), source.projects(spark, sf_dir), None, attribute_cap=ATTRIBUTE_CAP, dimension_cap=DIMENSION_CAP)
        return views.VIEWS[name][1](t)

    return run


for _i, _name in enumerate(_ROLLUPS, 1):
    if _name:
        _add(f"rol_{_i}_{_name[2:]}", _rollup(_name), _VIEW_SQL[_name])
_add("rol_13_system_dimensions", lambda s, d: rollups.product_attrs(source.product_events(s, d), source.projects(s, d), ATTRIBUTE_CAP).where("attr_key LIKE '$%'"), f"SELECT * FROM ({_VIEW_SQL['v_product_attrs']}) WHERE attr_key LIKE '$%'")
_add(
    "rol_2_9_web_dimensions_one_scan",
    lambda s, d: rollups.web_dimensions(source.web_hits(s, d)).withColumn("values", F.array_join("values", "|")),
    " UNION ALL ".join(f"SELECT project, day, '{n}' AS dimension, {' || chr(124) || '.join(c)} AS values, visitors, pageviews FROM ({_WEB_SQL[n]})" for n, c in ((n, list(c)) for n, c in rollups.WEB_DIMENSIONS.items())),
)
for _i, _name in enumerate(_VIEW_SQL, 1):
    _add(f"vw_{_i}_{_name[2:]}", _on(lambda t, n=_name: views.view(n, t)), _VIEW_SQL[_name])

# Cohorts.
_add("coh_1_actors", lambda s, d: cohorts.actors(source.app_views(s, d), source.web_hits(s, d), source.product_events(s, d)), "SELECT * FROM actors")


def _actors_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [source.app_views(spark, sf_dir), source.web_hits(spark, sf_dir), source.product_events(spark, sf_dir)]
    early = F.col("day") < F.lit(FIRST_LIVE_DAY).cast("date")
    return cohorts.actors(*[p.where(~early) for p in parts], existing=cohorts.actors(*[p.where(early) for p in parts]))


_add("coh_1_actors_merged", _actors_merged, "SELECT * FROM actors")
_add("coh_2_3_retention", _on(views.retention_cells), "SELECT * FROM cells")
_add("coh_4_identity_daily", _rollup("v_identity_daily"), _VIEW_SQL["v_identity_daily"])
_report(
    "coh_5_last_seen",
    _on(lambda t: cohorts.refresh_last_seen(t.identities, views.view("v_identity_daily", t)).select("project", "kind", "id", "name", "last_seen_day")),
    "SELECT i.project, i.kind, i.id, i.name, max(d.day) AS last_seen_day FROM identities i LEFT JOIN v_identity_daily d ON i.project = d.project AND i.kind = d.kind AND i.id = d.id GROUP BY ALL",
)
_CUTOFF = datetime.date(2024, 1, 3)
_add("coh_6_prune_actors", _on(lambda t: cohorts.prune_actors(cohorts.actors(t.app, t.web, t.product), views.retention_cells(t), _CUTOFF)[1]), "SELECT * FROM cells WHERE cohort_day >= '2024-01-03'")
_add("coh_7_prune_identities", _on(lambda t: cohorts.prune_identities(t.identities, views.view("v_identity_daily", t), datetime.date(2024, 1, 20))[1]), f"SELECT * FROM ({_VIEW_SQL['v_identity_daily']}) WHERE day >= '2024-01-20'")

# Read functions.
_RANGE = f"project = '{PROJECT}' AND day BETWEEN '{FROM}' AND '{TO}'"
_SUM = "CAST(sum({0}) AS BIGINT) AS {0}"
_report("rd_1_list_projects", _on(reports.list_projects), "SELECT p.alias, p.name, p.identity, p.archived, coalesce(CAST(w.a AS VARCHAR), '') AS web_from, coalesce(CAST(w.b AS VARCHAR), '') AS web_to, coalesce(CAST(v.a AS VARCHAR), '') AS app_from, coalesce(CAST(v.b AS VARCHAR), '') AS app_to FROM projects p LEFT JOIN (SELECT project, min(day) AS a, max(day) AS b FROM web_hits GROUP BY 1) w ON w.project = p.alias LEFT JOIN (SELECT project, min(day) AS a, max(day) AS b FROM app_views GROUP BY 1) v ON v.project = p.alias")
_report("rd_2_web_overview", _on(lambda t: reports.web_overview(t, PROJECT, FROM, TO)), f"SELECT day, visitors, pageviews, sessions, round(CAST(bounces AS DOUBLE) / greatest(sessions, 1), 3) AS bounce_rate, duration_sec // greatest(sessions, 1) AS avg_session_sec FROM v_web_daily WHERE {_RANGE}")
for _name, _columns in rollups.WEB_DIMENSIONS.items():
    _by = ", ".join(_columns)
    _report(f"rd_3_web_breakdown_{_name}", _on(lambda t, n=_name: reports.web_breakdown(t, PROJECT, FROM, TO, n, 10)), f"SELECT {_by}, {_SUM.format('visitors')}, {_SUM.format('pageviews')} FROM v_web_{_name} WHERE {_RANGE} GROUP BY {_by} ORDER BY sum(visitors) DESC, {_by} LIMIT 10")
_report("rd_4_app_overview", _on(lambda t: reports.app_overview(t, PROJECT, FROM, TO)), f"SELECT day, actives, views, sessions, duration_sec FROM v_app_daily WHERE {_RANGE}")
for _name, _keys in rollups.APP_DIMENSIONS.items():
    _report(f"rd_5_app_breakdown_{_name}", _on(lambda t, n=_name: reports.app_breakdown(t, PROJECT, FROM, TO, n, 10)), f"SELECT {_keys[-1]}, {_SUM.format('actives')}, {_SUM.format('views')} FROM v_app_{_name} WHERE {_RANGE} GROUP BY 1 ORDER BY sum(actives) DESC, 1 LIMIT 10")
_report("rd_6_product_events", _on(lambda t: reports.product_events(t, PROJECT, FROM, TO, "signup")), f"SELECT day, event_name, count, unique_users FROM v_product_daily WHERE {_RANGE} AND event_name = 'signup'")
_report("rd_6_product_totals", _on(lambda t: reports.product_totals(t, PROJECT, FROM, TO)), f"SELECT day, total_events, active_users FROM v_product_totals WHERE {_RANGE}")
_report("rd_7_product_attributes", _on(lambda t: reports.product_attributes(t, PROJECT, FROM, TO, "purchase", "plan")), f"SELECT day, event_name, attr_key, attr_value, count, unique_users FROM v_product_attrs WHERE {_RANGE} AND event_name = 'purchase' AND attr_key = 'plan'")
_report("rd_8_retention", _on(lambda t: reports.retention(t, PROJECT, "2024-01-01", TO, "web")), f"SELECT cohort_day, day_offset, actors, cohort_size, (SELECT max(cohort_day) FROM v_retention WHERE project = '{PROJECT}') AS aggregated_through FROM v_retention WHERE project = '{PROJECT}' AND surface = 'web' AND cohort_day BETWEEN '2024-01-01' AND '{TO}'")
for _kind in ("user", "group"):
    _report(f"rd_9_identities_{_kind}", _on(lambda t, k=_kind: reports.identities(t, PROJECT, FROM, TO, k, 5)), f"SELECT d.id, coalesce(i.name, '') AS name, {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in ('actors', 'users', 'hits', 'views', 'events'))} FROM v_identity_daily d LEFT JOIN identities i ON i.project = d.project AND i.kind = d.kind AND i.id = d.id WHERE d.project = '{PROJECT}' AND day BETWEEN '{FROM}' AND '{TO}' AND d.kind = '{_kind}' GROUP BY d.id, i.name ORDER BY sum(hits) + sum(views) + sum(events) DESC, d.id LIMIT 5")

# Dashboard reports.
_WINDOW = f"project = '{PROJECT}' AND day BETWEEN DATE '{TO}' - {DAYS - 1} AND DATE '{TO}'"
_R = "CASE WHEN {1} > 0 THEN CAST({0} AS DOUBLE) / {1} ELSE 0.0 END AS {2}"


def _ranked_sql(name: str, by: str, columns: list[str], limit: str = "") -> str:
    return f"SELECT {by}, {', '.join(_SUM.format(c) for c in columns)} FROM {name} WHERE {_WINDOW} AND {by} <> '' GROUP BY {by} ORDER BY sum({columns[0]}) DESC, {by} {limit}"


def _ids_sql(kind: str, more: str = "") -> str:
    return f"SELECT coalesce(i.name, d.id) AS name, {more}CAST(sum(hits + views + events) AS BIGINT) AS actions, count(DISTINCT d.day) AS active_days, max(d.day) AS last_seen FROM v_identity_daily d LEFT JOIN identities i ON i.project = d.project AND i.kind = d.kind AND i.id = d.id WHERE d.{_WINDOW} AND d.kind = '{kind}' GROUP BY d.id, i.name ORDER BY sum(hits + views + events) DESC, d.id LIMIT 50"


_CURVE = f"SELECT surface, day_offset, {_SUM.format('actors')}, {_SUM.format('cohort_size')}, {_R.format('sum(actors)', 'sum(cohort_size)', 'retention')} FROM v_retention WHERE project = '{PROJECT}' AND day_offset BETWEEN 0 AND 30 GROUP BY ALL"
_DASHBOARDS = {
    "index.active_projects": "SELECT alias, name FROM projects WHERE NOT archived",
    "index.archived_projects": "SELECT alias, name FROM projects WHERE archived",
    "web.daily": f"SELECT day, visitors, pageviews, sessions, {_R.format('bounces', 'sessions', 'bounce_rate')}, {_R.format('duration_sec', 'sessions', 'avg_session_sec')} FROM v_web_daily WHERE {_WINDOW}",
    "web.totals": f"SELECT {_SUM.format('visitors')}, {_SUM.format('pageviews')}, {_SUM.format('sessions')}, {_R.format('sum(bounces)', 'sum(sessions)', 'bounce_rate')}, {_R.format('sum(duration_sec)', 'sum(sessions)', 'avg_session_sec')} FROM v_web_daily WHERE {_WINDOW}",
    "web.pages": f"SELECT path, {_SUM.format('visitors')}, {_SUM.format('pageviews')}, '/web/{PROJECT}/page?path=' || path AS detail_url FROM v_web_pages WHERE {_WINDOW} GROUP BY path ORDER BY sum(pageviews) DESC, path LIMIT 20",
    "web.referrers": _ranked_sql("v_web_referrers", "source", ["visitors", "pageviews"], "LIMIT 20"),
    "web.hosts": _ranked_sql("v_web_hosts", "host", ["pageviews", "visitors"], "LIMIT 20"),
    "web.countries": _ranked_sql("v_web_countries", "country", ["visitors"], "LIMIT 20"),
    "web.devices": _ranked_sql("v_web_devices", "device", ["visitors"]),
    "web.browsers": _ranked_sql("v_web_browsers", "browser", ["visitors"], "LIMIT 10"),
    "web.oses": _ranked_sql("v_web_os", "os", ["visitors"], "LIMIT 10"),
    "web.campaigns": f"SELECT utm_source, utm_medium, utm_campaign, {_SUM.format('visitors')}, {_SUM.format('pageviews')} FROM v_web_utm WHERE {_WINDOW} AND utm_source <> '' GROUP BY 1, 2, 3 ORDER BY sum(visitors) DESC, 1, 2, 3 LIMIT 20",
    "page.page_daily": f"SELECT day, visitors, pageviews FROM v_web_pages WHERE {_WINDOW} AND path = '/p/3'",
    "page.page_totals": f"SELECT {_SUM.format('visitors')}, {_SUM.format('pageviews')}, {_R.format('sum(pageviews)', 'sum(visitors)', 'views_per_visitor')} FROM v_web_pages WHERE {_WINDOW} AND path = '/p/3'",
    "app.app_daily": f"SELECT day, actives, views, sessions, {_R.format('duration_sec', 'sessions', 'avg_session_sec')}, {_R.format('sessions', 'actives', 'sessions_per_active')} FROM v_app_daily WHERE {_WINDOW}",
    "app.app_totals": f"SELECT {_SUM.format('actives')}, {_SUM.format('views')}, {_SUM.format('sessions')}, {_R.format('sum(duration_sec)', 'sum(sessions)', 'avg_session_sec')} FROM v_app_daily WHERE {_WINDOW}",
    "app.app_versions": f"SELECT day, platform || ' ' || app_version AS version, actives FROM v_app_versions WHERE {_WINDOW} AND app_version <> ''",
    "app.app_screens": _ranked_sql("v_app_screens", "screen", ["views", "actives"], "LIMIT 20"),
    "app.app_platforms": _ranked_sql("v_app_versions", "platform", ["actives"]),
    "app.app_oses": f"SELECT platform || ' ' || os_version AS os, {_SUM.format('actives')} FROM v_app_os WHERE {_WINDOW} AND os_version <> '' GROUP BY 1 ORDER BY sum(actives) DESC, 1 LIMIT 15",
    "app.app_devices": _ranked_sql("v_app_devices", "device_model", ["actives"], "LIMIT 15"),
    "app.app_countries": _ranked_sql("v_app_countries", "country", ["actives"], "LIMIT 20"),
    "product.totals": f"SELECT day, total_events, active_users FROM v_product_totals WHERE {_WINDOW}",
    "product.headline": f"SELECT {_SUM.format('total_events')}, max(active_users) AS peak_dau, avg(active_users) AS avg_dau FROM v_product_totals WHERE {_WINDOW}",
    "product.events": f"SELECT day, event_name, count, unique_users FROM v_product_daily WHERE {_WINDOW}",
    "product.event_summary": f"SELECT event_name, CAST(sum(count) AS BIGINT) AS total, max(unique_users) AS peak_daily_uniques FROM v_product_daily WHERE {_WINDOW} GROUP BY 1",
    "product.attr_breakdowns": f"SELECT day, event_name, attr_key, attr_value, count, unique_users FROM v_product_attrs WHERE {_WINDOW}",
    "users.users_mode": f"SELECT identity FROM projects WHERE alias = '{PROJECT}'",
    "users.users_daily": f"SELECT day, count(DISTINCT id) AS active_users, CAST(sum(hits + views + events) AS BIGINT) AS actions FROM v_identity_daily WHERE {_WINDOW} AND kind = 'user' GROUP BY day",
    "users.users_totals": f"SELECT count(DISTINCT id) AS users, CAST(sum(hits + views + events) AS BIGINT) AS actions, {_R.format('sum(hits + views + events)', 'count(DISTINCT id)', 'per_user')} FROM v_identity_daily WHERE {_WINDOW} AND kind = 'user'",
    "users.users_top": _ids_sql("user"),
    "groups.groups_daily": f"SELECT day, count(DISTINCT id) AS active_groups FROM v_identity_daily WHERE {_WINDOW} AND kind = 'group' GROUP BY day",
    "groups.groups_totals": f"SELECT count(DISTINCT id) AS groups, CAST(sum(hits + views + events) AS BIGINT) AS actions FROM v_identity_daily WHERE {_WINDOW} AND kind = 'group'",
    "groups.groups_top": _ids_sql("group", "max(users) AS users, "),
    "retention.retention_mode": f"SELECT identity FROM projects WHERE alias = '{PROJECT}'",
    "retention.retention_curve": _CURVE,
    "retention.retention_milestones": f"SELECT surface, max(CASE WHEN day_offset = 1 THEN retention END) AS d1, max(CASE WHEN day_offset = 7 THEN retention END) AS d7, max(CASE WHEN day_offset = 30 THEN retention END) AS d30 FROM ({_CURVE}) WHERE day_offset IN (1, 7, 30) GROUP BY surface",
    "retention.retention_cohorts": f"SELECT surface, cohort_day, day_offset, cohort_size, actors, {_R.format('actors', 'cohort_size', 'retention')} FROM v_retention WHERE project = '{PROJECT}' AND day_offset BETWEEN 0 AND 30",
}
for _name, _sql in _DASHBOARDS.items():
    _more = {"path": "/p/3"} if _name.startswith("page.") else {}
    _report("dsh_" + _name.replace(".", "_"), _on(lambda t, n=_name, m=_more: reports.report(n, t, PROJECT, TO, DAYS, **m)), _sql)

# Lifecycle.
def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.from_ev(spark, sf_dir, "SELECT id, k FROM ev ")
    lists = F.to_json(F.struct(F.array(F.lit("y"), F.concat(F.lit("x"), "k")).alias("a"), F.array(F.lit("y")).alias("b")))
    return rows.select("id", F.when(F.col("k") % 3 == 0, lists).when(F.col("k") % 3 == 1, "broken").otherwise("{}").alias("attributes"))


_WINDOWS_SQL = "SELECT alias AS project, f AS family, CASE WHEN p AND f = 'web' THEN 3 WHEN f = 'web' THEN 7 ELSE 30 END AS raw_days, CASE WHEN f = 'app' THEN 90 ELSE 365 END AS aggregate_days FROM (SELECT alias, alias = 'p0' AS p FROM projects), LATERAL unnest(['web', 'product', 'app']) AS u(f)"


def _windows(t: Tables) -> DataFrame:
    web = F.when(F.col("alias") == "p0", F.struct(F.lit(3).alias("raw_days"), F.lit(None).cast("int").alias("aggregate_days")))
    app = F.struct(F.lit(None).cast("int").alias("raw_days"), F.lit(90).alias("aggregate_days"))
    none = F.lit(None).cast("struct<raw_days:int,aggregate_days:int>")
    return lifecycle.retention_windows(t.projects.withColumn("retention", F.struct(web.alias("web"), none.alias("product"), app.alias("app"))))


_add("lif_2_retention_windows", _on(_windows), _WINDOWS_SQL)
_add(
    "lif_3_aged_out_days",
    _on(lambda t: lifecycle.aged_out_days(t.web, t.app, t.product, _windows(t), datetime.date.fromisoformat(TODAY))),
    f""", windows AS ({_WINDOWS_SQL}), raw AS (SELECT DISTINCT 'web' AS family, project, day FROM web_hits UNION ALL SELECT DISTINCT 'app', project, day FROM app_views UNION ALL SELECT DISTINCT 'product', project, day FROM product_events)
SELECT r.family, r.project, r.day FROM raw r JOIN windows w ON r.family = w.family AND r.project = w.project WHERE r.day < DATE '{TODAY}' - w.raw_days""",
)
_report(
    "lif_1_daily_pass_web",
    _on(lambda t: lifecycle.daily_pass(Tables(t.web, t.app, t.product, t.projects.withColumn("retention", F.lit(None).cast("struct<web:struct<raw_days:int,aggregate_days:int>,product:struct<raw_days:int,aggregate_days:int>,app:struct<raw_days:int,aggregate_days:int>>")), t.identities), datetime.date.fromisoformat(TODAY)).aggregates["v_web_daily"]),
    f"SELECT * FROM v_web_daily WHERE project <> 'p1' AND day < DATE '{TODAY}' - 7",
)
_report(
    "lif_5_prune_aggregates",
    _on(lambda t: lifecycle.prune_aggregates({"v_app_daily": views.view("v_app_daily", t)}, _windows(t), datetime.date(2024, 4, 10))["v_app_daily"]),
    "SELECT * FROM v_app_daily WHERE day >= DATE '2024-04-10' - 90",
)
_report("lif_6_erase_project", _on(lambda t: lifecycle.erase_project({"w": views.view("v_web_daily", t)}, "p1")["w"]), "SELECT * FROM v_web_daily WHERE project <> 'p1'")
_report("lif_7_rename_project", _on(lambda t: lifecycle.rename_project({"projects": t.projects, "w": views.view("v_web_daily", t)}, "p1", "new")["w"]), "SELECT * REPLACE (CASE WHEN project = 'p1' THEN 'new' ELSE project END AS project) FROM v_web_daily")
_add("lif_8_declared_keys", _on(lambda t: views.declared_keys(t.projects)), "SELECT DISTINCT key FROM projects, LATERAL unnest(CASE alias WHEN 'p0' THEN ['plan', 'button'] WHEN 'p1' THEN ['plan'] ELSE [] END) AS u(key)")
_add(
    "lif_9_backfill_attributes",
    lambda s, d: lifecycle.backfill_attributes(_legacy(s, d)).select("id", F.array_join("attributes", ",").alias("attributes")),
    "SELECT id, CASE k % 3 WHEN 0 THEN 'x' || CAST(k AS VARCHAR) || ',y' ELSE '' END AS attributes FROM ev",
)
_add(
    "lif_10_keyless_projects",
    lambda s, d: lifecycle.keyless_projects(source.registry(s, d)[0], source.registry(s, d)[1].withColumn("disabled", F.col("project") == "p1")),
    "SELECT alias FROM projects WHERE alias = 'p1'",
)

catalog_flows.register(_add, _report, _on, _ACCEPTED, _NOON, _OPEN)
