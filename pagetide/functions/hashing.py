"""Keyed hashes of visitors and actors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_hash(*parts: Column) -> Column:
    """First 16 hex digits of SHA-256 over the parts, each followed by a NUL."""
    ended = [x for part in parts for x in (F.coalesce(part, F.lit("")), F.lit("\0"))]
    return F.substring(F.sha2(F.concat(*ended), 256), 1, 16)


def visitor_hash(salt: Column, ip: Column, user_agent: Column, project: Column) -> Column:
    return keyed_hash(salt, ip, user_agent, project)


def actor_hash(salt: Column, raw_id: Column, project: Column) -> Column:
    return keyed_hash(salt, raw_id, project)
