"""Shaping of page addresses: host and path, campaign, masked ids, kept parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagetide.functions.enrich import url_host

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
_TAIL = _SCHEME + r"[^/?#]*"
# The shapes of ids; the last two are masked only where a mask asks for them.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ULID = r"^[0-7][0-9A-HJKMNP-TV-Z]{25}$"
NUMERIC = r"^[0-9]+$"
HEX = r"(?i)^[0-9a-f]{24,}$"
MASK = "[id]"
CAMPAIGN = ["utm_source", "utm_medium", "utm_campaign"]


def _tail(href: Column) -> Column:
    """Path, query and fragment of an address."""
    return F.regexp_replace(F.coalesce(href, F.lit("")), _TAIL, "")


def path_of(href: Column, routing: str = "history") -> Column:
    """Path without query; with hash routing, the fragment that is the route stays behind it."""
    tail = _tail(href)
    bare = F.regexp_extract(tail, r"^([^?#]*)", 1)
    path = F.when(bare == "", "/").otherwise(bare)
    if routing != "hash":
        return path
    fragment = F.regexp_extract(tail, r"#([^?]*)", 1)
    return F.when(F.regexp_extract(tail, r"#(.*)$", 1) == "", path).otherwise(F.concat(path, F.lit("#"), fragment))


def query_value(href: Column, key: str) -> Column:
    """First value of a query parameter, decoded; null if it is not there."""
    query = F.regexp_extract(_tail(href), r"^[^?#]*\?([^#]*)", 1)
    pattern = f"(?:^|&){re.escape(key)}=([^&]*)"
    raw = F.regexp_replace(F.regexp_extract(query, pattern, 1), r"\+", " ")
    there = query.rlike(f"(?:^|&){re.escape(key)}(?:=|&|$)")
    return F.when(there, F.coalesce(F.try_url_decode(raw), raw))


def campaign(href: Column) -> list[Column]:
    """utm_source, utm_medium and utm_campaign of the address as it came."""
    return [F.coalesce(query_value(href, key), F.lit("")).alias(key) for key in CAMPAIGN]


def _mask_segments(path: Column, numeric: bool, hexadecimal: bool) -> Column:
    shapes = [UUID, ULID, *([NUMERIC] if numeric else []), *([HEX] if hexadecimal else [])]

    def mask(segment: Column) -> Column:
        hit = segment.rlike(shapes[0])
        for shape in shapes[1:]:
            hit = hit | segment.rlike(shape)
        return F.when(hit, MASK).otherwise(segment)

    return F.array_join(F.transform(F.split(path, "/"), mask), "/")


def mask_ids(value: Column, numeric: bool = False, hexadecimal: bool = False) -> Column:
    """Ids among the segments of the path and the fragment masked; host and query stay."""
    value = F.coalesce(value, F.lit(""))
    head = F.regexp_extract(value, f"({_TAIL})/", 1)
    tail = F.regexp_replace(value, _TAIL, "")
    path = F.regexp_extract(tail, r"^([^?#]*)", 1)
    query = F.regexp_extract(tail, r"^[^?#]*(\?[^#]*)", 1)
    fragment = F.regexp_extract(tail, r"#(.*)$", 1)
    masked = F.concat(head, _mask_segments(path, numeric, hexadecimal), query, F.when(fragment == "", "").otherwise(F.concat(F.lit("#"), _mask_segments(fragment, numeric, hexadecimal))))
    absolute = value.rlike(_SCHEME)
    return F.when(absolute & (head == ""), value).when(absolute, masked).otherwise(_mask_segments(value, numeric, hexadecimal))


def mask_regex(value: Column, pattern: str, every: bool = False) -> Column:
    """The first match of a pattern, or every one, masked."""
    if every:
        return F.regexp_replace(value, pattern, MASK)
    return F.regexp_replace(value, f"(?s)^(.*?)(?:{pattern})", "$1" + MASK.replace("[", r"\[").replace("]", r"\]"))


def with_query(path: Column, href: Column, keys: list[str]) -> Column:
    """A path with the allowed parameters behind it, sorted by key."""
    encode = lambda c: F.regexp_replace(F.url_encode(c), r"\+", "%20")
    pairs = [F.when(query_value(href, k).isNotNull(), F.concat(encode(F.lit(k)), F.lit("="), encode(query_value(href, k)))) for k in sorted(set(keys))]
    joined = F.array_join(F.array(*pairs), "&") if pairs else F.lit("")
    return F.when(joined == "", path).otherwise(F.concat(path, F.lit("?"), joined))


def valid_mask(mask: dict | None) -> bool:
    """Whether a mask can be applied: known options only, and a pattern that compiles."""
    if mask is None:
        return True
    if not isinstance(mask, dict) or set(mask) - {"numeric", "hex", "pattern", "every"}:
        return False
    try:
        re.compile(mask.get("pattern", ""))
    except (re.error, TypeError):
        return False
    return True


def shape_urls(hrefs: DataFrame, href: str = "href", mask: dict | None = None, routing: str = "history") -> DataFrame:
    """`hrefs` with host, path and campaign columns; the address itself goes.

    `mask` has numeric and hex, or a pattern and every. It fails closed: with a
    mask that can't be applied no row comes out, rather than an unmasked one.
    """
    address = F.col(href)
    path = path_of(address, routing)
    if mask is not None and valid_mask(mask):
        path = mask_regex(path, mask["pattern"], bool(mask.get("every"))) if mask.get("pattern") else mask_ids(path, bool(mask.get("numeric")), bool(mask.get("hex")))
    out = hrefs.withColumns({"host": url_host(address), "path": path} | {k: c for k, c in zip(CAMPAIGN, campaign(address))}).drop(href)
    return out.where(F.col("path").isNotNull()) if valid_mask(mask) else out.where(F.lit(False))


def drop_consecutive(views: DataFrame, client: str, ts: str, location: str, order: str) -> DataFrame:
    """Views but those whose location is the one before of the same client; `order` settles equal times."""
    before = F.lag(location).over(W.partitionBy(client).orderBy(ts, order))
    return views.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(location))).drop("_before")


def with_defaults(attributes: Column, defaults: dict[str, str]) -> Column:
    """Attributes over defaults: those of the event win key by key."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair]) if defaults else F.create_map().cast("map<string,string>")
    own = F.coalesce(attributes, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(own, k)), own)
