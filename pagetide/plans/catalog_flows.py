"""Registered queries of whole flows: stored tables, streams, salts, and inputs at the edges of the ingest rules."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide import schemas
from pagetide.functions import enrich, urls
from pagetide.operators import cohorts, lifecycle, normalise, rollups, sessions
from pagetide.plans import reports, views
from pagetide.plans.views import Tables
from pagetide.sources import driver_tables as source
from pagetide.sources import store
from pagetide.streaming import ingest

_NOW = {"availableNow": True}
_LONG = "/" + "p" * 900
_NO_SALT = "TIMESTAMP '2001-01-01 12:00:00'"
_USERS = "SELECT DISTINCT user_id AS u, user_id % 3 AS p FROM events"


def _stored_envelopes(spark: SparkSession, sf_dir: str, times: int = 1) -> str:
    path = store.scratch(spark, "envelopes")
    for _ in range(times):
        source.envelopes(spark, sf_dir).write.mode("append").json(path)
    return path


def _sent(spark: SparkSession, sf_dir: str, body: str, received: str = "TIMESTAMP '2024-01-01 12:00:00'") -> DataFrame:
    """An envelope for each user, with a body from an SQL expression over u and p."""
    users = spark.sql(_USERS.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    constant = [F.lit(v).alias(c) for c, v in (("ip", "10.0.0.1"), ("user_agent", "Mozilla/5.0 (Windows) Firefox/1"), ("origin", ""), ("cf_country", ""), ("header_key", ""))]
    return users.select("u", "p", F.concat(F.lit("b"), F.col("u").cast("string")).alias("batch_id"), F.expr(received).alias("received_at"), *constant, F.expr(body).alias("body"))


def _body(events: str) -> str:
    return f"""concat('{{"key":"k', p, '","attributes":{{}},"events":[', {events}, ']}}')"""


def _read_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.read_envelopes(spark, _stored_envelopes(spark, sf_dir)).where("_corrupt_record IS NULL").select("batch_id", "received_at", "ip", "user_agent")


def _read_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.scratch(spark, "registry")
    projects, keys, _ = source.registry(spark, sf_dir)
    projects.drop("archived").write.json(f"{path}/projects")
    keys.write.json(f"{path}/ingest_keys")
    projects, keys = store.read_registry(spark, path)
    return keys.join(projects, keys["project"] == projects["alias"]).select("key", "project", "disabled", "archived", F.size("attributes").cast("long").alias("n_attributes"), F.size("allowed_origins").cast("long").alias("n_origins"))


def _append_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, all of them again on the next day, and once more beside themselves."""
    path, hits = store.scratch(spark, "web"), source.web_hits(spark, sf_dir)
    for rows in (hits, hits.withColumn("day", F.date_add("day", 1)), hits.unionByName(hits)):
        store.append_new(rows, path, schemas.WEB_HITS)
    return store.read_table(spark, path, schemas.WEB_HITS).groupBy("project", "day").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def _old_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, half of them with ids that hold their time, again 60 days on, and after all raw days of a project are gone."""
    path, hits = store.scratch(spark, "web"), source.web_hits(spark, sf_dir)
    at, tail = F.lpad(F.lower(F.hex(F.unix_millis("ts"))), 12, "0"), F.md5("id")
    timed = F.concat(F.substring(at, 1, 8), F.lit("-"), F.substring(at, 9, 4), F.lit("-7"), F.substring(tail, 1, 3), F.lit("-8"), F.substring(tail, 4, 3), F.lit("-"), F.substring(tail, 7, 12))
    hits = hits.withColumn("id", F.when(F.crc32("id") % 2 == 0, timed).otherwise(F.col("id")))
    store.append_new(hits, path, schemas.WEB_HITS)
    store.append_new(hits.withColumn("day", F.date_add("day", 60)), path, schemas.WEB_HITS)
    store.drop_partition(spark, path, "p0")
    store.append_new(hits, path, schemas.WEB_HITS)
    return store.read_table(spark, path, schemas.WEB_HITS).groupBy("project", "day").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def _replace_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rows, written, replaced for one project, and replaced by none."""
    path, hits = store.scratch(spark, "daily"), source.web_hits(spark, sf_dir)
    store.replace_days(rollups.web_daily(hits).withColumn("visitors", F.when(F.col("project") == "p1", -1).otherwise(F.col("visitors"))), path)
    store.replace_days(rollups.web_daily(hits.where("project = 'p1'")), path)
    store.replace_days(rollups.web_daily(hits.where("false")), path)
    return spark.read.parquet(path)


def _events_of(spark: SparkSession, sf_dir: str, sent: DataFrame) -> DataFrame:
    projects, keys, salts = source.registry(spark, sf_dir)
    return normalise.explode_events(normalise.authorise(sent, projects, keys), salts)


def _too_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _sent(spark, sf_dir, _body("""concat(repeat('{"name":"x"},', CAST(498 + u % 4 AS INT)), '{"name":"x"}')"""))
    return normalise.authorise(sent, *source.registry(spark, sf_dir)[:2]).select("batch_id", F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


def _made_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _sent(spark, sf_dir, _body("""'{"name":"x"},{"name":"y"}'"""))
    return _events_of(spark, sf_dir, sent).select("batch_id", F.col("index").cast("long").alias("index"), "id")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda n: f"""'{{"name":"x","attributes":{{"$user_id":"u', u, '","$user_name":"U{n}","$group_id":"g', u % 7, '","$group_name":"G{n}"}}}}'"""
    sent = _sent(spark, sf_dir, _body(f"{one(1)}, ',', {one(2)}"))
    return normalise.display_names(_events_of(spark, sf_dir, sent)).groupBy("project", "kind", "id", "name").agg(F.count("*").alias("n"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with exponents, a reserved value beyond its limit, and times without a salt."""
    event = f"""'{{"name":"$pageview","attributes":{{"$path":"{_LONG}","big":1.5e30,"small":1e-15,"whole":', u, '.0,"exact":0.1234567890123456}}}}'"""
    sent = _sent(spark, sf_dir, _body(event), f"CASE WHEN u % 5 = 0 THEN {_NO_SALT} ELSE TIMESTAMP '2024-01-05 12:00:00' END")
    rows = _events_of(spark, sf_dir, sent).where("project IS NOT NULL")
    values = [F.try_element_at("attributes", F.lit(k)).alias(k) for k in ("big", "small", "whole", "exact")]
    return rows.select("batch_id", F.length("path").cast("long").alias("path_length"), *values, F.coalesce("reject_reason", F.lit("")).alias("reject_reason"))


def _salts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise.rotate_salts(source.registry(spark, sf_dir)[2], datetime.datetime(2024, 1, 15, 12)).select("valid_from", "valid_to")


def _stored_salts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored salts after two rotations at the same time, the second of which has nothing to do."""
    path, now = store.scratch(spark, "salts"), datetime.datetime(2024, 1, 15, 12)
    store.write_version(source.registry(spark, sf_dir)[2], path)
    for _ in range(2):
        salts = lifecycle.rotate_stored_salts(spark, path, now)
    return salts.select("valid_from", "valid_to")


def _client_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.from_ev(spark, sf_dir, "SELECT id, CASE WHEN n % 3 = 0 THEN '1.2.3.4' ELSE '' END AS c, CASE WHEN n % 3 = 1 THEN ' 9.9.9.9 , 8.8.8.8' END AS f, CASE WHEN n % 2 = 0 THEN '[2001:db8::1]:80' ELSE '7.7.7.7:80' END AS p FROM ev ")
    return rows.select("id", enrich.client_ip(F.col("c"), F.col("f"), F.col("p")).alias("ip"))


def _any_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    ips = "CASE n % 8 WHEN 0 THEN '10.0.0.300' WHEN 1 THEN '2001:db8::1' WHEN 2 THEN '2001:DB8:0:0:0:0:0:ffff' WHEN 3 THEN '::1' WHEN 4 THEN 'nowhere' WHEN 5 THEN '10.0.1.44' WHEN 6 THEN '2001:db9::' WHEN 7 THEN CASE WHEN length(id) % 2 = 0 THEN '::ffff:10.0.1.44' ELSE '::FFFF:0A00:012C' END END"
    rows = source.from_ev(spark, sf_dir, f"SELECT id, {ips} AS ip FROM ev ")
    four = spark.range(1).select(F.lit(10 * 2**24).alias("ip_lo"), F.lit(10 * 2**24 + 65535).alias("ip_hi"), F.lit("C4").alias("country"))
    six = spark.range(1).select(F.lit("20010db8" + "0" * 24).alias("ip_lo"), F.lit("20010db8" + "f" * 24).alias("ip_hi"), F.lit("C6").alias("country"))
    return enrich.country_of_ip(rows, "ip", four, six).select("id", "country")


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    shaped = [urls.shape_urls(pages, "url", mask).withColumn("mask", F.lit(name)) for name, mask in (("none", None), ("valid", {"numeric": True}), ("broken", {"pattern": "("}), ("unknown", {"nope": 1}))]
    out = shaped[0]
    for more in shaped[1:]:
        out = out.unionByName(more)
    return out.groupBy("mask").agg(F.count("*").alias("n"))


def _defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source.product_events(spark, sf_dir).withColumn("a", urls.with_defaults(F.col("attributes"), {"button": "none", "region": "eu"}))
    return rows.select("id", *[F.try_element_at("a", F.lit(k)).alias(k) for k in ("plan", "button", "region")])


def _run_stream(frame: DataFrame, name: str) -> DataFrame:
    """Run a stream over what has arrived, into a table, and read it."""
    spark = frame.sparkSession
    path = store.scratch(spark, name)
    query = frame.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(**_NOW).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, hits = store.scratch(spark, "hits"), source.web_hits(spark, sf_dir).select("project", "day", "actor_id", "ts")
    later = hits.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).select(F.lit("~").alias("project"), F.to_date("ts").alias("day"), F.lit("~").alias("actor_id"), "ts")
    hits.unionByName(later).write.parquet(path)
    stream = spark.readStream.schema("project string, day date, actor_id string, ts timestamp").parquet(path)
    return _run_stream(ingest.live_sessions(stream), "sessions").where("project <> '~'")


def _arrived(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    return store.read_envelopes(spark, _stored_envelopes(spark, sf_dir, times), stream=True).drop("_corrupt_record")


def _ingested(spark: SparkSession, sf_dir: str, times: int = 1) -> str:
    path = store.scratch(spark, "ingested")
    ingest.ingest_stream(_arrived(spark, sf_dir, times), *source.registry(spark, sf_dir), f"{path}/t", f"{path}/checkpoint", _NOW).awaitTermination()
    return f"{path}/t"


def _stream_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families after every envelope has come twice."""
    path, out = _ingested(spark, sf_dir, 2), None
    for family, schema in schemas.FAMILIES.items():
        part = store.read_table(spark, f"{path}/{family}", schema).select(F.lit(family).alias("family"), "id", "project", "ts")
        out = part if out is None else out.unionByName(part)
    return out


def _stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _ingested(spark, sf_dir)
    notices = spark.read.parquet(f"{path}/notices").groupBy("batch_id").agg(F.count("*").alias("n_notices"))
    results = spark.read.parquet(f"{path}/results").select("batch_id", "accepted", "rejected")
    return results.join(notices, "batch_id", "left").fillna(0, ["n_notices"])


def _stream_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{_ingested(spark, sf_dir)}/minutes").select("minute", "label", "accepted", "rejected")


def _minutes_over_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of three batches that share their minutes, one of which ran twice; two are brought together on the way."""
    path, events = store.scratch(spark, "ingested"), _events_of(spark, sf_dir, source.envelopes(spark, sf_dir))
    for n in (0, 1, 1, 2):
        part = normalise.minute_counters(events.where(F.pmod(F.crc32("batch_id"), F.lit(3)) == n))
        part.write.mode("overwrite").parquet(f"{path}/minutes/batch={n}")
    store.fold_log(spark, f"{path}/minutes", schemas.MINUTES, normalise.merge_minutes, 2)
    return ingest.stream_minutes(spark, path)


def _stream_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a stream got in an older and a newer envelope of every user, merged into names that were there."""
    path, none = store.scratch(spark, "ingested"), spark.createDataFrame([], schemas.NAMES)
    for n in (2, 1):
        one = f"""'{{"name":"x","attributes":{{"$user_id":"u', u, '","$user_name":"U{n}","$group_id":"g', u % 7, '","$group_name":"G{n}"}}}}'"""
        sent = _sent(spark, sf_dir, _body(one), f"TIMESTAMP '2024-01-01 12:00:0{n}'").drop("u", "p")
        sent.withColumn("batch_id", F.concat("batch_id", F.lit(f"-{n}"))).coalesce(1).write.mode("append").json(f"{path}/in")
    arrived = store.read_envelopes(spark, f"{path}/in", stream=True, files_a_trigger=1).drop("_corrupt_record")
    ingest.ingest_stream(arrived, *source.registry(spark, sf_dir), f"{path}/t", f"{path}/checkpoint", _NOW, fold_every=1).awaitTermination()
    return cohorts.upsert_names(none, ingest.stream_names(spark, f"{path}/t")).select("project", "kind", "id", "name")


def _late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a stream where every day of one project is stored already: its rows are set apart, none is lost."""
    path = store.scratch(spark, "ingested")
    days = spark.sql("SELECT 'web' AS family, 'p1' AS project, explode(sequence(DATE '2023-01-01', DATE '2025-12-31')) AS day")
    ingest.ingest_stream(_arrived(spark, sf_dir), *source.registry(spark, sf_dir), f"{path}/t", f"{path}/checkpoint", _NOW, agg_days=lambda: days).awaitTermination()
    parts = [store.read_table(spark, f"{path}/t/{name}", schemas.WEB_HITS).select("id", "project", "ts", F.lit(late).alias("late")) for name, late in (("web", False), ("late_web", True))]
    return parts[0].unionByName(parts[1])


def _live_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from the sessions that four batches of mixed hits have written, one of them twice; two are brought together on the way."""
    path, hits = store.scratch(spark, "ingested"), source.web_hits(spark, sf_dir)
    for n in (3, 0, 1, 1, 2):
        sessions.session_parts(hits.where(F.pmod(F.crc32("id"), F.lit(4)) == n)).write.mode("overwrite").parquet(f"{path}/visits/batch={n}")
    store.fold_log(spark, f"{path}/visits", schemas.SESSION_PARTS, sessions.merge_parts, 2)
    return ingest.live_web_daily(spark, path)


def _event_stream(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    return ingest.event_stream(_arrived(spark, sf_dir, times), *source.registry(spark, sf_dir))


def _clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_stream(_event_stream(spark, sf_dir).select("id", "project", "ts"), "events")


def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir, 2).select("id", "project", "received_at")
    return _run_stream(ingest.unique_events(events, "60 days").select("id", "project"), "unique").groupBy("project").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


def _live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run_stream(ingest.live_counters(_event_stream(spark, sf_dir)), "counters")


def _plain_tables(spark: SparkSession, sf_dir: str) -> Tables:
    projects = source.projects(spark, sf_dir).withColumn("retention", F.lit(None).cast("struct<web:struct<raw_days:int,aggregate_days:int>,product:struct<raw_days:int,aggregate_days:int>,app:struct<raw_days:int,aggregate_days:int>>"))
    return Tables(source.web_hits(spark, sf_dir), source.app_views(spark, sf_dir), source.product_events(spark, sf_dir), projects, source.identities(spark, sf_dir))


def _store_web(spark: SparkSession, t: Tables) -> str:
    root = store.scratch(spark, "store")
    t.web.write.partitionBy("project", "day").parquet(f"{root}/web")
    return root


def _aged(spark: SparkSession, sf_dir: str) -> tuple[str, Tables]:
    """Stored hits after two daily passes, the second of which has nothing left to do."""
    t = _plain_tables(spark, sf_dir)
    root = _store_web(spark, t)
    for _ in range(2):
        failed = lifecycle.age_out(spark, root, lifecycle.opened(spark, root, t.projects, t.identities), datetime.date(2024, 1, 31))
        if failed:
            raise RuntimeError(str(failed))
    return root, t


def _aged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, t = _aged(spark, sf_dir)
    stored = lifecycle.opened(spark, root, t.projects, t.identities)
    raw = stored.web.groupBy("project", "day").agg(F.count("*").alias("raw_rows"))
    return views.view("v_web_daily", stored).join(raw, ["project", "day"], "left").fillna(0, ["raw_rows"])


def _store_families(spark: SparkSession, t: Tables) -> str:
    root = store.scratch(spark, "store")
    for family in schemas.FAMILIES:
        getattr(t, family).write.partitionBy("project", "day").parquet(f"{root}/{family}")
    return root


def _pass(spark: SparkSession, root: str, t: Tables, projects: DataFrame | None = None) -> Tables:
    """The stored tables after one more daily pass."""
    projects = t.projects if projects is None else projects
    failed = lifecycle.age_out(spark, root, lifecycle.opened(spark, root, projects, t.identities), datetime.date(2024, 1, 31))
    if failed:
        raise RuntimeError(str(failed))
    return lifecycle.opened(spark, root, projects, t.identities)


def _aged_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts after the raw rows of most days are gone."""
    t = _plain_tables(spark, sf_dir)
    root = _store_families(spark, t)
    return views.view("v_retention", _pass(spark, root, t))


def _pruned_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored cells after a pass that stores all days but the last; one project keeps its cohorts for 20 days, the others for a year."""
    t = _plain_tables(spark, sf_dir)
    root = _store_families(spark, t)
    one = "named_struct('raw_days', 1, 'aggregate_days', CASE alias WHEN 'p1' THEN 20 ELSE 365 END)"
    _pass(spark, root, t, t.projects.withColumn("retention", F.expr(f"named_struct('web', {one}, 'product', {one}, 'app', {one})")))
    return cohorts.merge_cell_log(store.read_table(spark, f"{root}/cells", schemas.CELLS))


def _renamed_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of a project that age, take another alias, get a late row each, and go through one more pass."""
    t = _plain_tables(spark, sf_dir)
    root = _store_web(spark, t)
    late = t.web.where("project = 'p2' AND day < '2024-01-20'").dropDuplicates(["project", "day"]).withColumn("project", F.lit("renamed"))
    late = late.withColumn("id", F.concat(F.lit("late"), F.col("id")))
    _pass(spark, root, t)
    lifecycle.rename_stored(spark, root, "p2", "renamed")
    late.write.mode("append").partitionBy("project", "day").parquet(f"{root}/web")
    renamed = t.projects.withColumn("alias", F.when(F.col("alias") == "p2", F.lit("renamed")).otherwise(F.col("alias")))
    return views.view("v_web_daily", _pass(spark, root, t, renamed))


def _interrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass that wrote and noted its days but dropped none of their rows, and the next one."""
    t = _plain_tables(spark, sf_dir)
    root = _store_web(spark, t)
    lifecycle._store_pass(spark, root, lifecycle.opened(spark, root, t.projects, t.identities), datetime.date(2024, 1, 31))
    stored = _pass(spark, root, t)
    raw = stored.web.groupBy("project", "day").agg(F.count("*").alias("raw_rows"))
    return views.view("v_web_daily", stored).join(raw, ["project", "day"], "left").fillna(0, ["raw_rows"])


def _erased(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _store_web(spark, _plain_tables(spark, sf_dir))
    lifecycle.erase_stored(spark, root, "p1")
    lifecycle.rename_stored(spark, root, "p2", "renamed")
    return store.read_table(spark, f"{root}/web", schemas.WEB_HITS).groupBy("project", "day").agg(F.count("*").alias("n"))


def _guarded(t: Tables) -> DataFrame:
    sql = "WITH d AS (SELECT day, pageviews FROM v_web_daily WHERE project = 'p0') SELECT day, pageviews, rank() OVER (ORDER BY pageviews DESC, day) AS place FROM d"
    return t.web.sparkSession.createDataFrame(reports.query(t, sql)[0], "day date, pageviews long, place int")


def register(add, report, on, accepted: str, noon: str, allowed: str) -> None:
    """Add the queries; `accepted`, `noon` and `allowed` are SQL of the ingest queries."""
    users = f"users AS ({_USERS})"
    add("src_1_read_envelopes", _read_envelopes, f"SELECT DISTINCT batch_id, {noon} AS received_at, '10.0.0.' || CAST(u % 250 AS VARCHAR) AS ip, CASE WHEN u % 17 = 0 THEN 'curl/8' ELSE 'Mozilla/5.0 (Windows) Firefox/1' END AS user_agent FROM requests")
    add("src_5_registry", _read_registry, "SELECT 'k' || substr(alias, 2) AS key, alias AS project, false AS disabled, false AS archived, CAST(CASE alias WHEN 'p0' THEN 2 WHEN 'p1' THEN 1 ELSE 0 END AS BIGINT) AS n_attributes, CAST(CASE WHEN alias = 'p2' THEN 1 ELSE 2 END AS BIGINT) AS n_origins FROM projects")
    add("snk_1_append_new", _append_new, "SELECT project, day, count(*) AS n, count(DISTINCT id) AS ids FROM web_hits GROUP BY ALL")
    add("snk_1_old_replays", _old_replays, "SELECT project, day, count(*) AS n, count(DISTINCT id) AS ids FROM web_hits WHERE project <> 'p0' GROUP BY ALL")
    report("rol_20_snk_2_replace_days", _replace_days, "SELECT * FROM v_web_daily")
    report("snk_4_extract_identities", on(lambda t: views.extract("identities", t, with_sentinel=True).select("project", "kind", "id", "name")), "SELECT project, kind, id, name FROM identities")
    add("snk_4_extract_empty", on(lambda t: views.extract("projects", Tables(t.web, t.app, t.product, t.projects.where("false"), t.identities), with_sentinel=True).select("alias", "name")), "SELECT '' AS alias, '' AS name")
    add("ing_3_too_many_events", _too_many, f", {users} SELECT 'b' || CAST(u AS VARCHAR) AS batch_id, CASE WHEN 499 + u % 4 > 500 THEN 'too many events' ELSE '' END AS reject_reason FROM users")
    made = "sha256('b' || CAST(u AS VARCHAR) || chr(0) || CAST(i AS VARCHAR))"
    add("ing_11_made_ids", _made_ids, f", {users}, h AS (SELECT u, i, {made} AS x FROM users, LATERAL unnest([0, 1]) AS v(i)) SELECT 'b' || CAST(u AS VARCHAR) AS batch_id, CAST(i AS BIGINT) AS index, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-' || substr(x, 13, 4) || '-' || substr(x, 17, 4) || '-' || substr(x, 21, 12) AS id FROM h")
    add(
        "ing_16_display_names",
        _names,
        f""", {users} SELECT 'p' || CAST(p AS VARCHAR) AS project, 'user' AS kind, 'u' || CAST(u AS VARCHAR) AS id, 'U1' AS name, 1 AS n FROM users WHERE p <> 2
UNION ALL SELECT 'p' || CAST(p AS VARCHAR), 'group', 'g' || CAST(u % 7 AS VARCHAR), 'G1', count(*) FROM users GROUP BY ALL""",
    )
    add(
        "ing_6_7_15_edges",
        _edges,
        f", {users} SELECT 'b' || CAST(u AS VARCHAR) AS batch_id, CAST(512 AS BIGINT) AS path_length, '1500000000000000000000000000000' AS big, '0.000000000000001' AS small, CAST(u AS VARCHAR) AS whole, '0.1234567890123456' AS exact, CASE WHEN u % 5 = 0 THEN 'no salt for its time' ELSE '' END AS reject_reason FROM users",
    )
    add("salt_1_rotate", _salts, "SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS valid_from, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS valid_to FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'")
    add("salt_1_stored_rotation", _stored_salts, "SELECT DISTINCT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS valid_from, CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY AS valid_to FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-15'")
    add("enr_8_client_ip", _client_ip, "SELECT id, CASE n % 3 WHEN 0 THEN '1.2.3.4' WHEN 1 THEN '9.9.9.9' ELSE CASE WHEN n % 2 = 0 THEN '2001:db8::1' ELSE '7.7.7.7' END END AS ip FROM ev")
    add("enr_7_any_address", _any_address, "SELECT id, CASE n % 8 WHEN 1 THEN 'C6' WHEN 2 THEN 'C6' WHEN 5 THEN 'C4' WHEN 7 THEN 'C4' ELSE '' END AS country FROM ev")
    add("url_5_fail_closed_masks", _masks, "SELECT m AS mask, count(*) AS n FROM pages, LATERAL unnest(['none', 'valid']) AS u(m) GROUP BY m")
    add("url_8_default_attributes", _defaults, "SELECT id, attr_plan AS plan, coalesce(attr_button, 'none') AS button, 'eu' AS region FROM product_events")
    add("ses_4_str_5_live_sessions", _live_sessions, "SELECT project, day, actor_id, hit_count, duration_sec FROM web_sess")
    stored = "NOT bad AND NOT (name = '$pageview' AND u % 17 = 0)"
    family = "CASE name WHEN '$pageview' THEN 'web' WHEN '$screen_view' THEN 'app' ELSE 'product' END AS family"
    add("str_1_2_stream_families", _stream_families, f", {accepted} SELECT {family}, id, project, moment AS ts FROM ok WHERE {stored}")
    add(
        "str_1_stream_results",
        _stream_results,
        f", {accepted} SELECT batch_id, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected, count(*) FILTER (bad) + count(*) FILTER (NOT bad AND n % 10 = 0) + count(*) FILTER (name = '$odd') AS n_notices FROM ok GROUP BY batch_id",
    )
    add("str_1_late_rows", _late_rows, f", {accepted} SELECT id, project, moment AS ts, project = 'p1' AS late FROM ok WHERE {stored} AND name = '$pageview'")
    report("str_5_vw_1_live_half", _live_half, "SELECT * FROM v_web_daily")
    minutes = f"SELECT {noon} AS minute, 'label ' || project AS label, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected FROM ok"
    add("str_1_stream_minutes", _stream_minutes, f", {accepted} {minutes} GROUP BY ALL")
    add("str_1_minutes_over_triggers", _minutes_over_triggers, f", {accepted} {minutes} GROUP BY ALL")
    add(
        "str_1_snk_3_stream_names",
        _stream_names,
        f""", {users} SELECT 'p' || CAST(p AS VARCHAR) AS project, 'user' AS kind, 'u' || CAST(u AS VARCHAR) AS id, 'U2' AS name FROM users WHERE p <> 2
UNION ALL SELECT DISTINCT 'p' || CAST(p AS VARCHAR), 'group', 'g' || CAST(u % 7 AS VARCHAR), 'G2' FROM users""",
    )
    add("str_3_clamped_times", _clamped, f", {accepted} SELECT id, project, moment AS ts FROM ok")
    add("str_2_unique_events", _unique, f", {accepted} SELECT project, count(*) AS n, count(DISTINCT id) AS ids FROM ok GROUP BY project")
    add("str_4_live_counters", _live_counters, f", {accepted} {minutes} WHERE day_start < (SELECT max(day_start) FROM ok) GROUP BY ALL")
    report("rd_10_guarded_query", on(_guarded), "SELECT day, pageviews, CAST(row_number() OVER (ORDER BY pageviews DESC, day) AS INTEGER) AS place FROM v_web_daily WHERE project = 'p0'")
    report("lif_1_4_stored_views", _aged_view, "SELECT v.*, CASE WHEN v.project = 'p1' OR v.day >= DATE '2024-01-24' THEN v.pageviews ELSE 0 END AS raw_rows FROM v_web_daily v")
    report("lif_4_interrupted_pass", _interrupted, "SELECT v.*, CASE WHEN v.project = 'p1' OR v.day >= DATE '2024-01-24' THEN v.pageviews ELSE 0 END AS raw_rows FROM v_web_daily v")
    report("lif_1_vw_20_aged_retention", _aged_retention, "SELECT * FROM v_retention")
    report("lif_5_coh_6_pruned_logs", _pruned_logs, "SELECT * FROM cells WHERE project <> 'p1' AND cohort_day + CAST(day_offset AS INTEGER) < DATE '2024-01-30'")
    report("lif_7_renamed_late_row", _renamed_late, "SELECT * REPLACE (CASE WHEN project = 'p2' THEN 'renamed' ELSE project END AS project) FROM v_web_daily")
    add("lif_6_7_stored_partitions", _erased, "SELECT CASE project WHEN 'p2' THEN 'renamed' ELSE project END AS project, day, count(*) AS n FROM web_hits WHERE project <> 'p1' GROUP BY ALL")
    add("coh_6_prune_known_actors", on(lambda t: cohorts.prune_actors(cohorts.actors(t.app, t.web, t.product), views.retention_cells(t), datetime.date(2024, 1, 25))[0]), "SELECT * FROM actors WHERE last_seen_day >= '2024-01-25'")
    report(
        "coh_7_prune_names",
        on(lambda t: cohorts.prune_identities(cohorts.refresh_last_seen(t.identities, views.view("v_identity_daily", t)), views.view("v_identity_daily", t), datetime.date(2024, 1, 29))[0].select("project", "kind", "id", "last_seen_day")),
        "SELECT * FROM (SELECT i.project, i.kind, i.id, max(d.day) AS last_seen_day FROM identities i LEFT JOIN v_identity_daily d ON i.project = d.project AND i.kind = d.kind AND i.id = d.id GROUP BY ALL) WHERE last_seen_day IS NULL OR last_seen_day >= '2024-01-29'",
    )
