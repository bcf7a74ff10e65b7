"""Columns derived from user agents, referrers and addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of bots and names of referrers that results must agree on.
BOT_MARKERS = ["bot", "crawler", "spider", "crawling", "headless", "lighthouse", "slurp", "curl/", "wget/", "python-requests", "facebookexternalhit", "preview"]
REFERRER_NAMES = {
    "t.co": "twitter",
    "twitter.com": "twitter",
    "x.com": "twitter",
    "facebook.com": "facebook",
    "l.facebook.com": "facebook",
    "lm.facebook.com": "facebook",
    "linkedin.com": "linkedin",
    "lnkd.in": "linkedin",
    "reddit.com": "reddit",
    "old.reddit.com": "reddit",
    "news.ycombinator.com": "hackernews",
    "instagram.com": "instagram",
    "youtube.com": "youtube",
    "youtu.be": "youtube",
    "duckduckgo.com": "duckduckgo",
}
REFERRER_PREFIXES = {"google.": "google", "bing.": "bing", "yahoo.": "yahoo", "baidu.": "baidu", "yandex.": "yandex"}
# The first name with a marker in the user agent holds.
SYSTEMS = [("ChromeOS", ["CrOS"]), ("Windows", ["Windows"]), ("iOS", ["iPhone", "iPad"]), ("Android", ["Android"]), ("macOS", ["Mac OS X"]), ("Linux", ["Linux"])]
BROWSERS = [
    ("Edge", ["Edg/", "Edge/"]),
    ("Samsung Internet", ["SamsungBrowser/"]),
    ("Opera", ["OPR/", "Opera/"]),
    ("Firefox", ["Firefox/"]),
    ("Chrome", ["Chrome/", "CriOS/"]),
    ("Safari", ["Safari/"]),
]
DEVICES = [("tablet", ["iPad", "Tablet"]), ("mobile", ["Mobile", "iPhone"])]

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)"


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _first(ua: Column, table: list[tuple[str, list[str]]], otherwise: str) -> Column:
    found = F.lit(otherwise)
    for name, markers in reversed(table):
        found = F.when(_any([ua.contains(m) for m in markers]), name).otherwise(found)
    return found


def is_bot(user_agent: Column) -> Column:
    """An empty user agent is a bot's, and so is one with a marker in any case."""
    ua = F.coalesce(user_agent, F.lit(""))
    return (ua == "") | _any([F.lower(ua).contains(m) for m in BOT_MARKERS])


def ua_os(user_agent: Column) -> Column:
    return _first(F.coalesce(user_agent, F.lit("")), SYSTEMS, "")


def ua_browser(user_agent: Column) -> Column:
    return _first(F.coalesce(user_agent, F.lit("")), BROWSERS, "")


def ua_device(user_agent: Column) -> Column:
    return _first(F.coalesce(user_agent, F.lit("")), DEVICES, "desktop")


def url_host(url: Column) -> Column:
    """Host of an absolute address in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"^www\.", "")


def clean_referrer(referrer: Column, own_host: Column) -> Column:
    """Source of a visit: a known name, else the bare host; own pages and broken addresses give none."""
    host = _bare(url_host(referrer))
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in REFERRER_NAMES.items() for x in pair]), host)
    source = F.coalesce(named, *[F.when(host.startswith(p), F.lit(name)) for p, name in REFERRER_PREFIXES.items()], host)
    return F.when((host == "") | (host == _bare(own_host)), "").otherwise(source)


def edge_country(header: Column) -> Column:
    """Country that the edge reports, in upper case; unknown and Tor count as none."""
    code = F.upper(F.coalesce(header, F.lit("")))
    return F.when(code.isin("XX", "T1"), "").otherwise(code)


#: How the 32 digits of a mapped IPv4 address begin.
_MAPPED = "0" * 20 + "ffff"


def client_ip(connecting: Column, forwarded: Column, peer: Column) -> Column:
    """The connecting address that the edge names, else the first forwarded one, else the peer's host."""
    first = F.trim(F.substring_index(forwarded, ",", 1))
    host = F.regexp_extract(F.coalesce(peer, F.lit("")), r"^(\[[^\]]*\]|[^:]*)(?::\d+)?$", 1)
    return F.coalesce(F.nullif(connecting, F.lit("")), F.nullif(first, F.lit("")), F.regexp_replace(host, r"^\[|\]$", ""))


def ip_number(ip: Column) -> Column:
    """Number of an IPv4 address, also of one written as an IPv6 address (::ffff:1.2.3.4); null for anything else."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    bare = F.regexp_replace(ip, "(?i)^(?:::|(?:0{1,4}:){5})ffff:(?=[0-9.]+$)", "")
    parts = F.split(F.when(bare.rlike(rf"^{octet}(\.{octet}){{3}}$"), bare), r"\.")
    dotted = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    digits = ip6_digits(ip)
    return F.coalesce(dotted, F.when(digits.startswith(_MAPPED), F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")))


def ip6_digits(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address, which sort as the addresses do; null for anything else."""
    bare = F.lower(F.regexp_replace(ip, "%.*$", ""))
    halves = F.split(F.when(bare.contains(":") & ~bare.rlike("::.*::|:::"), bare), "::")
    groups = lambda i: F.filter(F.split(F.coalesce(F.get(halves, F.lit(i)), F.lit("")), ":"), lambda x: x != "")
    left, right = groups(0), groups(1)
    missing = F.lit(8) - F.size(left) - F.size(right)
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    valid = F.forall(full, lambda x: x.rlike("^[0-9a-f]{1,4}$")) & (F.size(full) == 8)
    # two colons stand for a group at least, and single ones neither begin nor end an address
    shape = F.when(F.size(halves) == 2, missing >= 1).otherwise(missing == 0) & ~bare.rlike("^:[^:]|[^:]:$")
    return F.when(valid & shape, F.array_join(F.transform(full, lambda x: F.lpad(x, 4, "0")), ""))


def country_of_ip(df: DataFrame, ip: str, ranges: DataFrame, ranges6: DataFrame | None = None, block_bits: int = 16) -> DataFrame:
    """`df` with `country` from tables of disjoint ranges; empty if in none, and for what is no address.

    `ranges` has ip_lo, ip_hi (numbers) and country; `ranges6` has them as the
    32 hex digits of IPv6 addresses. An address is in one range at most, so
    every lookup is a left join that gives one row for one row. Ranges are split
    by address blocks, so that the range join has a key and either side may be
    shuffled; a range over many blocks gives one row each. IPv6 ranges are split
    by blocks of /48, /32 or /16, the finest of which they fill no more than 256
    (of /16: whatever they fill), and looked up once for each size.
    """
    six, four = ip6_digits(F.col(ip)), ip_number(F.col(ip))
    found = df.drop("country").withColumn("_ip", four).withColumn("_ip6", F.when(F.col("_ip").isNull(), six))
    size = 1 << block_bits
    keyed = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col("ip_lo") / size), F.floor(F.col("ip_hi") / size))))
    found = _in_ranges(found, keyed, "_ip", F.floor(F.col("_ip") / size), "_c0")
    names = ["_c0"]
    if ranges6 is not None:
        number = lambda c, n: F.conv(F.substring(c, 1, n), 16, 10).cast("long")
        span = lambda n: number("ip_hi", n) - number("ip_lo", n)
        level = F.when(span(12) < 256, 12).when(span(8) < 256, 8).otherwise(4)
        for digits in (12, 8, 4):
            keyed = ranges6.where(level == digits).withColumn("_block", F.explode(F.sequence(number("ip_lo", digits), number("ip_hi", digits))))
            found = _in_ranges(found, keyed, "_ip6", number("_ip6", digits), f"_c{digits}")
            names.append(f"_c{digits}")
    return found.withColumn("country", F.coalesce(*names, F.lit(""))).select(*df.drop("country").columns, "country")


def _in_ranges(df: DataFrame, keyed: DataFrame, address: str, block: Column, name: str) -> DataFrame:
    """`df` with the country of the range that holds an address, if one does."""
    keyed = keyed.select(F.col("_block").alias("_key"), F.col("ip_lo").alias("_lo"), F.col("ip_hi").alias("_hi"), F.col("country").alias(name))
    # rows without an address have keys of their own, so that they don't meet in one task
    own = F.coalesce(block, -F.lit(1) - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    inside = (F.col("_own") == F.col("_key")) & F.col(address).between(F.col("_lo"), F.col("_hi"))
    return df.withColumn("_own", own).join(keyed, inside, "left").drop("_own", "_key", "_lo", "_hi")


def enrich_hits(raw: DataFrame) -> DataFrame:
    """Web hits with device, browser, os, referrer_source and country; bots' hits are left out.

    `raw` has user_agent, referrer, host and cf_country, which are dropped but
    for the host. Works on a table or a stream.
    """
    people = raw.where(~is_bot(F.col("user_agent")))
    ua = F.col("user_agent")
    return (
        people.withColumn("device", ua_device(ua))
        .withColumn("browser", ua_browser(ua))
        .withColumn("os", ua_os(ua))
        .withColumn("referrer_source", clean_referrer(F.col("referrer"), F.col("host")))
        .withColumn("country", edge_country(F.col("cf_country")))
        .drop("user_agent", "referrer", "cf_country")
    )
