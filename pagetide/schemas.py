"""Schemas of the raw families, the registry tables and the ingest envelope."""

from __future__ import annotations

_SHARED = "id string, project string, day date, ts timestamp, received_at timestamp, actor_id string, user_id string, group_id string"

WEB_HITS = f"{_SHARED}, host string, path string, referrer_source string, utm_source string, utm_medium string, utm_campaign string, country string, device string, browser string, os string"
APP_VIEWS = f"{_SHARED}, session_id string, screen string, platform string, app_version string, os_version string, device_model string, locale string, country string"
PRODUCT_EVENTS = f"{_SHARED}, event_name string, platform string, app_version string, attributes map<string,string>"
FAMILIES = {"web": WEB_HITS, "app": APP_VIEWS, "product": PRODUCT_EVENTS}

_DAYS = "struct<raw_days:int,aggregate_days:int>"
PROJECTS = f"alias string, name string, identity string, allowed_origins array<string>, retention struct<web:{_DAYS},product:{_DAYS},app:{_DAYS}>, attributes array<string>, archived boolean"
INGEST_KEYS = "key string, project string, label string, disabled boolean"
#: What a stream writes batch by batch and readers merge by key.
NAMES = "project string, kind string, id string, name string, updated_at timestamp"
MINUTES = "minute timestamp, label string, accepted long, rejected long"
SESSION_PARTS = "project string, day date, actor_id string, started long, ended long, hit_count long"
IDENTITIES = "project string, kind string, id string, name string, last_seen_day date, updated_at timestamp"
SALTS = "valid_from timestamp, valid_to timestamp, salt string"
#: Ids that were ever stored, beside each family; see `store.id_bucket`.
IDS = "id string, project string, bucket string"
AGG_DAYS = "family string, project string, day date"
#: Logs that a daily pass appends to; `seq` is the day of the pass, so that the first entry of an actor can be told.
ACTORS = "project string, actor_id string, surface string, first_seen_day date, last_seen_day date, seq date"
CELLS = "project string, surface string, cohort_day date, day_offset long, actors long"

#: A client's request body; attribute values are JSON scalars of any type.
BODY = "struct<key:string,attributes:map<string,variant>,events:array<struct<id:string,ts:string,name:string,attributes:map<string,variant>>>>"
ENVELOPES = "batch_id string, received_at timestamp, ip string, user_agent string, origin string, cf_country string, header_key string, body string"

#: Raw and aggregate days kept where a project sets none, by family.
RETENTION_DAYS = {"web": (7, 365), "product": (30, 365), "app": (30, 365)}
