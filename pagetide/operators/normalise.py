"""From request envelopes to the three event families, set-based, on tables or streams."""

from __future__ import annotations

import datetime
import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide import schemas
from pagetide.functions import enrich
from pagetide.functions.hashing import actor_hash, visitor_hash

MAX_EVENTS, MAX_ATTRIBUTES, MAX_KEY_BYTES, MAX_VALUE, MAX_NOTICES = 500, 50, 64, 512, 10
FUTURE_SKEW = "interval 5 minutes"

# The reserved attribute keys of the wire format.
RESERVED = [
    "$install_id", "$user_id", "$user_name", "$group_id", "$group_name", "$session_id", "$platform", "$app_version", "$os_version",
    "$device_model", "$locale", "$host", "$path", "$utm_source", "$utm_medium", "$utm_campaign", "$referrer", "$screen",
]
UUID = r"(?i)^(?:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|urn:uuid:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|\{[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|[0-9a-f]{32})$"


def stringify(value: Column) -> Column:
    """A JSON value as text: null is empty, numbers are shortest and without exponent, the rest is JSON."""
    kind = F.schema_of_variant(value)
    text = value.try_cast("string")
    number = plain_number(value.try_cast("double"))
    return (
        F.when(value.isNull() | (kind == "VOID"), "")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT|BIGINT|INT)"), number)
        .when(kind.rlike("^(OBJECT|ARRAY)"), F.to_json(value))
        .otherwise(F.coalesce(text, F.lit("")))
    )


def plain_number(number: Column) -> Column:
    """The shortest digits of a double, without an exponent however large or small it is."""
    text = number.cast("string")
    # written without an exponent as it is
    short = number.between(-9_999_999, 9_999_999) & ((F.abs(number) >= 0.001) | (number == 0))
    mantissa = F.regexp_extract(text, r"^-?([0-9.]+)", 1)
    whole, fraction = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits = F.concat(whole, fraction)
    point = F.length(whole) + F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    missing = point - F.length(digits)
    plain = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(missing >= 0, F.concat(digits, F.repeat(F.lit("0"), missing)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    )
    return F.when(short, F.regexp_replace(text, r"\.?0+$", "")).otherwise(F.concat(F.when(text.startswith("-"), "-").otherwise(""), plain))


def merge(batch: Column, event: Column) -> Column:
    """Attributes of the batch under those of the event."""
    none = F.create_map().cast("map<string,string>")
    under, over = F.coalesce(batch, none), F.coalesce(event, none)
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.map_contains_key(over, k)), over)


def custom_attributes(attributes: Column) -> Column:
    """Attributes that are not reserved: keys of a sane size, the first of them in key order, values cut."""
    own = F.map_filter(attributes, lambda k, _: ~k.startswith("$") & (F.octet_length(k) <= MAX_KEY_BYTES))
    keys = F.slice(F.array_sort(F.map_keys(own)), 1, MAX_ATTRIBUTES)
    return F.transform_values(F.map_filter(own, lambda k, _: F.array_contains(keys, k)), lambda _, v: F.left(v, F.lit(MAX_VALUE)))


def unknown_reserved(attributes: Column) -> Column:
    return F.filter(F.map_keys(attributes), lambda k: k.startswith("$") & ~k.isin(RESERVED))


def _origin_allowed(origin: Column, allowed: Column) -> Column:
    bare = F.regexp_replace(origin, "/+$", "")

    def fits(one: Column) -> Column:
        stripped = F.regexp_replace(one, "/+$", "")
        quoted = F.regexp_replace(stripped, r"([\\.\[\]{}()+?^$|])", r"\\$1")
        return (stripped == "*") | F.regexp_like(bare, F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", "[^/]*"), F.lit("$")))

    return F.coalesce(origin, F.lit("")).isin("") | F.coalesce(F.exists(allowed, fits), F.lit(False))


def clamp(ts: Column, received: Column, raw_days: Column) -> Column:
    """When an event counts as having happened, in whole seconds.

    No time, or one too far ahead, is the time received; one older than the
    raw days kept is the oldest of those. So no event is ever too late.
    """
    parsed = F.coalesce(F.try_to_timestamp(ts), received)
    oldest = received - F.make_dt_interval(raw_days)
    clamped = F.when(parsed > received + F.expr(FUTURE_SKEW), received).when(parsed < oldest, oldest).otherwise(parsed)
    return F.date_trunc("second", clamped)


@dataclass
class Normalised:
    web: DataFrame
    app: DataFrame
    product: DataFrame
    quarantine: DataFrame
    notices: DataFrame
    batch_results: DataFrame
    names: DataFrame


def authorise(envelopes: DataFrame, projects: DataFrame, keys: DataFrame) -> DataFrame:
    """Envelopes with project, label, body and reject_reason (null if the batch goes on).

    A key in the header wins over one in the body; only active keys of
    projects that are not archived count. The registry has one row a key.
    """
    parsed = envelopes.withColumn("b", F.from_json("body", schemas.BODY)).drop("body")
    parsed = parsed.withColumn("_key", F.coalesce(F.nullif(F.col("header_key"), F.lit("")), F.col("b.key")))
    active = keys.where("NOT disabled").join(projects.where("NOT archived"), keys["project"] == projects["alias"])
    registry = active.select(F.col("key").alias("_k"), "project", "label", "identity", "allowed_origins", "retention")
    known = parsed.join(F.broadcast(registry), F.col("_key") == F.col("_k"), "left").drop("_k", "_key")
    reason = (
        F.when(F.col("b").isNull() | F.col("b.events").isNull(), "malformed")
        .when(F.col("project").isNull(), "unauthorized")
        .when(~_origin_allowed(F.col("origin"), F.col("allowed_origins")), "origin")
        .when(F.size("b.events") > MAX_EVENTS, "too many events")
    )
    return known.withColumn("reject_reason", reason)


def check_salts(salts: DataFrame) -> None:
    """Refuse salts whose times overlap, as an event in both would be stored twice. There are a few at most."""
    after = F.lead("valid_from").over(W.orderBy("valid_from"))
    if not salts.withColumn("_next", after).where(F.col("_next") < F.col("valid_to")).isEmpty():
        raise ValueError("the times of two salts overlap")


def rotate_salts(salts: DataFrame, now: datetime.datetime, hours: int = 24) -> DataFrame:
    """Salts after a rotation: those whose time is over are destroyed, and now has one, drawn at random if need be.

    Write the result over the old table; with a salt its hashes can be linked no more.
    """
    kept = salts.where(F.col("valid_to") > F.lit(now))
    if not kept.where(F.col("valid_from") <= F.lit(now)).isEmpty():
        return kept
    later = kept.agg(F.min("valid_from")).first()[0]
    end = min(filter(None, (now + datetime.timedelta(hours=hours), later)))
    return kept.unionByName(salts.sparkSession.createDataFrame([(now, end, secrets.token_hex(32))], schemas.SALTS))


def explode_events(batches: DataFrame, salts: DataFrame, raw_days: dict[str, int] | None = None) -> DataFrame:
    """One row for each event of the accepted batches, validated, timed and with its identity."""
    check_salts(salts)
    days = raw_days or {family: kept for family, (kept, _) in schemas.RETENTION_DAYS.items()}
    good = batches.where("reject_reason IS NULL")
    # salts are few, one for each day that is still open
    salted = good.join(F.broadcast(salts), (F.col("received_at") >= F.col("valid_from")) & (F.col("received_at") < F.col("valid_to")), "left")
    text = lambda m: F.transform_values(m, lambda _, v: stringify(v))
    # values become text and attributes are merged before the events are rows of their own: filters on
    # the rows are moved below what the rows are made of, and would do all this once more for each use
    own = F.transform("b.events", lambda e: F.struct(e["id"].alias("id"), e["ts"].alias("ts"), e["name"].alias("name"), text(e["attributes"]).alias("own")))
    merged = F.transform(own, lambda e: F.struct(e["id"].alias("id"), e["ts"].alias("ts"), e["name"].alias("name"), merge(F.col("_batch"), e["own"]).alias("a")))
    rows = salted.withColumn("_batch", text(F.col("b.attributes"))).select(
        "batch_id", "received_at", "ip", "user_agent", "cf_country", "project", "label", "identity", "retention", "salt", F.posexplode(merged).alias("index", "e")
    ).withColumn("a", F.col("e.a"))
    value = lambda k: F.left(F.coalesce(F.try_element_at("a", F.lit(k)), F.lit("")), F.lit(MAX_VALUE))
    name = F.coalesce(F.col("e.name"), F.lit(""))
    family = F.when(name == "$pageview", "web").when(name == "$screen_view", "app").otherwise("product")
    given = F.coalesce(F.col("e.id"), F.lit(""))
    reason = (
        F.when(name == "", "name is required")
        .when((given != "") & ~given.rlike(UUID), "id is not a UUID")
        .when((name == "$pageview") & (value("$path") == ""), "$path is required")
        .when((name == "$screen_view") & (value("$screen") == ""), "$screen is required")
        # an id hashed without a secret could be guessed from the hash
        .when(F.col("salt").isNull() & ((F.col("identity") != "identified") | ((value("$user_id") == "") & (value("$install_id") == ""))), "no salt for its time")
    )
    kept = F.lit(None)
    for one, default in days.items():
        kept = F.when(F.col("family") == one, F.coalesce(F.col(f"retention.{one}.raw_days"), F.lit(default))).otherwise(kept)
    made = F.sha2(F.concat_ws("\0", "batch_id", F.col("index").cast("string")), 256)
    as_uuid = F.concat_ws("-", *[F.substring(made, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    rows = rows.withColumns({"event_name": name, "family": family, "reject_reason": reason, "id": F.when(given == "", as_uuid).otherwise(given)})
    rows = rows.withColumn("ts", clamp(F.col("e.ts"), F.col("received_at"), kept.cast("int"))).drop("e")
    rows = rows.withColumns({k[1:]: value(k) for k in RESERVED} | {"attributes": custom_attributes(F.col("a")), "unknown": unknown_reserved(F.col("a"))}).drop("a")
    raw = F.when(F.col("user_id") != "", F.col("user_id")).otherwise(F.col("install_id"))
    visitor = visitor_hash(F.col("salt"), F.col("ip"), F.col("user_agent"), F.col("project"))
    hashed = lambda c: actor_hash(F.col("salt"), c, F.col("project"))
    named = F.col("identity") == "identified"
    return rows.withColumns({
        "actor_id": F.when(raw == "", visitor).when(named, raw).otherwise(hashed(raw)),
        "raw_user_id": F.col("user_id"),
        "user_id": F.when(named | (F.col("user_id") == ""), F.col("user_id")).otherwise(hashed(F.col("user_id"))),
        "day": F.to_date("ts"),
        "bot": enrich.is_bot(F.col("user_agent")),
    })


def families(events: DataFrame) -> dict[str, DataFrame]:
    """The stored rows of accepted events; a bot's page views are accepted but not stored."""
    good = events.where("reject_reason IS NULL")
    columns = {family: [c.split(" ", 1)[0] for c in schemas.FAMILIES[family].replace("map<string,string>", "map").split(", ")] for family in schemas.FAMILIES}
    web = enrich.enrich_hits(good.where("family = 'web' AND NOT bot")).select(*columns["web"])
    app = good.where("family = 'app'").withColumn("country", enrich.edge_country(F.col("cf_country"))).select(*columns["app"])
    return {"web": web, "app": app, "product": good.where("family = 'product'").select(*columns["product"])}


def normalise(envelopes: DataFrame, projects: DataFrame, keys: DataFrame, salts: DataFrame, raw_days: dict[str, int] | None = None) -> Normalised:
    """All outputs of the ingest of a table of envelopes. No address or user agent is in any."""
    batches = authorise(envelopes, projects, keys)
    return outputs(batches, explode_events(batches, salts, raw_days))


def outputs(batches: DataFrame, events: DataFrame) -> Normalised:
    """What `normalise` gives, from authorised batches and their exploded events; keep those where several parts are used."""
    rejected_batches = batches.where("reject_reason IS NOT NULL").select("batch_id", "received_at", "project", F.lit(None).cast("int").alias("index"), "reject_reason")
    rejected = events.where("reject_reason IS NOT NULL").select("batch_id", "received_at", "project", "index", "reject_reason")
    unknown = events.where("reject_reason IS NULL").select("batch_id", "index", F.explode(F.transform("unknown", lambda k: F.concat(F.lit("unknown reserved key "), k))).alias("reason"))
    odd = events.where("reject_reason IS NULL AND event_name LIKE '$%' AND family = 'product'").select("batch_id", "index", F.concat(F.lit("unknown event "), "event_name").alias("reason"))
    warnings = unknown.unionByName(odd).withColumn("kind", F.lit("warning"))
    errors = rejected.select("batch_id", "index", F.col("reject_reason").alias("reason"), F.lit("error").alias("kind"))
    notices = errors.unionByName(warnings)
    results = batch_results(events)
    parts = families(events)
    return Normalised(parts["web"], parts["app"], parts["product"], rejected_batches.unionByName(rejected), notices, results, display_names(events))


def batch_results(events: DataFrame) -> DataFrame:
    """batch_id, project, label, accepted, rejected, and the first errors and warnings of each batch, from one pass over its events."""
    first = lambda notices: F.slice(F.array_sort(F.flatten(notices)), 1, MAX_NOTICES)
    good, none = F.col("reject_reason").isNull(), F.array().cast("array<struct<index:int,reason:string>>")
    said = lambda reason: F.struct(F.col("index").alias("index"), reason.alias("reason"))
    odd = F.when(F.col("event_name").startswith("$") & (F.col("family") == "product"), F.array(said(F.concat(F.lit("unknown event "), F.col("event_name"))))).otherwise(none)
    warned = F.concat(F.transform("unknown", lambda k: said(F.concat(F.lit("unknown reserved key "), k))), odd)
    counts = events.groupBy("batch_id", "project", "label").agg(
        F.count_if(good).alias("accepted"), F.count_if(~good).alias("rejected"),
        first(F.collect_list(F.when(~good, F.array(said(F.col("reject_reason")))))).alias("errors"),
        first(F.collect_list(F.when(good & (F.size(warned) > 0), warned))).alias("warnings"),
    )
    # a batch that came under several keys has one list
    of_batch = W.partitionBy("batch_id")
    counts = counts.withColumns({k: first(F.collect_list(k).over(of_batch)) for k in ("errors", "warnings")})
    any_ = F.col("batch_id").isNotNull() & (F.size("errors") + F.size("warnings") > 0)
    return counts.withColumns({k: F.when(any_, F.col(k)) for k in ("errors", "warnings")})


def display_names(events: DataFrame) -> DataFrame:
    """project, kind, id, name, updated_at: the first name of each id in a batch; users' only where identified."""
    kinds = F.array(
        F.struct(F.lit("group").alias("kind"), F.col("group_id").alias("id"), F.col("group_name").alias("name")),
        F.struct(F.lit("user").alias("kind"), F.when(F.col("identity") == "identified", F.col("raw_user_id")).otherwise("").alias("id"), F.col("user_name").alias("name")),
    )
    rows = events.where("reject_reason IS NULL").select("batch_id", "project", "index", F.col("received_at").alias("updated_at"), F.explode(kinds).alias("k"))
    rows = rows.select("batch_id", "project", "index", "updated_at", "k.*").where("id <> '' AND name <> ''")
    first = F.row_number().over(W.partitionBy("batch_id", "kind", "id").orderBy("index"))
    return rows.withColumn("_n", first).where("_n = 1").select("project", "kind", "id", "name", "updated_at")


def minute_counters(events: DataFrame) -> DataFrame:
    """accepted and rejected events by key label and minute, on a table or a stream."""
    return events.groupBy(F.window("received_at", "1 minute").alias("w"), "label").agg(
        F.count_if(F.col("reject_reason").isNull()).alias("accepted"), F.count_if(F.col("reject_reason").isNotNull()).alias("rejected")
    ).select(F.col("w.start").alias("minute"), "label", "accepted", "rejected")


def merge_minutes(counters: DataFrame) -> DataFrame:
    """Counters of one key label and minute from several batches, added up."""
    return counters.groupBy("minute", "label").agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
