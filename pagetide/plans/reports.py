"""Read functions and dashboard reports over the stitched views.

Visitors and other uniques of a range are sums of daily uniques, not uniques
of the range. Where rows are ranked, equal values go by the dimension.
"""

from __future__ import annotations

import datetime
import re
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetide.operators.rollups import APP_DIMENSIONS, WEB_DIMENSIONS
from pagetide.plans.views import Tables, register_views, view, view_names

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


#: Functions, and words that may stand before a bracket, in a guarded query.
QUERY_FUNCTIONS = frozenset(
    "select from where and or not in exists any all as over on using case when then else having by union except intersect between like values filter within distinct interval "
    "count sum avg min max count_if median stddev stddev_samp stddev_pop variance var_samp var_pop corr percentile approx_percentile approx_count_distinct mode first last any_value "
    "bool_and bool_or every some collect_list collect_set array_agg listagg string_agg max_by min_by grouping grouping_id rollup cube sets "
    "row_number rank dense_rank ntile lag lead first_value last_value nth_value percent_rank cume_dist "
    "abs ceil ceiling floor round bround sqrt exp ln log log2 log10 pow power mod pmod sign signum greatest least div "
    "coalesce nullif nvl nvl2 ifnull if isnull isnotnull cast try_cast try_divide "
    "concat concat_ws length char_length lower upper trim ltrim rtrim substring substr left right replace split split_part instr locate lpad rpad reverse initcap startswith endswith contains regexp_extract regexp_replace regexp_like regexp_count "
    "date date_add date_sub datediff date_diff date_trunc trunc date_format to_date to_timestamp year quarter month week weekofyear day dayofmonth dayofweek weekday dayofyear hour minute second last_day next_day add_months months_between make_date current_date extract unix_timestamp timestamp "
    "array map struct named_struct size cardinality element_at try_element_at map_keys map_values array_contains explode posexplode sort_array array_join array_distinct".split()
)


def _in_range(t: Tables, name: str, project: str, frm: str, to: str) -> DataFrame:
    for day in (frm, to):
        if not _DATE.fullmatch(day):
            raise ValueError(f"not a date (YYYY-MM-DD): {day}")
    if t.projects.where(F.col("alias") == project).isEmpty():
        known = [r["alias"] for r in t.projects.select("alias").orderBy("alias").collect()]
        raise ValueError(f"unknown project {project}; there are {', '.join(known)}")
    return view(name, t).where((F.col("project") == project) & F.col("day").between(F.lit(frm).cast("date"), F.lit(to).cast("date")))


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))


def _sums(df: DataFrame, by: list[str], *columns: str) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in columns])


def _top(df: DataFrame, by: list[str], columns: list[str], limit: int | None, order: str | None = None) -> DataFrame:
    ranked = _sums(df, by, *columns).orderBy(F.desc(order or columns[0]), *by)
    return ranked.limit(limit) if limit else ranked


def list_projects(t: Tables) -> DataFrame:
    """Every project with its first and last day of web and of app data, empty if it has none."""
    out = t.projects.select("alias", "name", "identity", "archived")
    for family in ("web", "app"):
        days = view(f"v_{family}_daily", t).groupBy(F.col("project").alias("alias")).agg(F.min("day").alias(f"{family}_from"), F.max("day").alias(f"{family}_to"))
        out = out.join(days, "alias", "left")
    return out.select("alias", "name", "identity", "archived", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("web_from", "web_to", "app_from", "app_to")])


def web_overview(t: Tables, project: str, frm: str, to: str) -> DataFrame:
    daily = _in_range(t, "v_web_daily", project, frm, to)
    some = F.greatest("sessions", F.lit(1))
    rate = F.round(F.col("bounces").cast("double") / some, 3).alias("bounce_rate")
    return daily.select("day", "visitors", "pageviews", "sessions", rate, F.floor(F.col("duration_sec") / some).alias("avg_session_sec")).orderBy("day")


def web_breakdown(t: Tables, project: str, frm: str, to: str, dimension: str, limit: int = 20) -> DataFrame:
    if dimension not in WEB_DIMENSIONS:
        raise ValueError(f"no dimension {dimension}; there are {', '.join(WEB_DIMENSIONS)}")
    rows = _in_range(t, f"v_web_{dimension}", project, frm, to)
    return _top(rows, list(WEB_DIMENSIONS[dimension]), ["visitors", "pageviews"], limit if limit > 0 else 20)


def app_overview(t: Tables, project: str, frm: str, to: str) -> DataFrame:
    return _in_range(t, "v_app_daily", project, frm, to).select("day", "actives", "views", "sessions", "duration_sec").orderBy("day")


def app_breakdown(t: Tables, project: str, frm: str, to: str, dimension: str, limit: int = 20) -> DataFrame:
    if dimension not in APP_DIMENSIONS:
        raise ValueError(f"no dimension {dimension}; there are {', '.join(APP_DIMENSIONS)}")
    rows = _in_range(t, f"v_app_{dimension}", project, frm, to)
    return _top(rows, APP_DIMENSIONS[dimension][-1:], ["actives", "views"], limit if limit > 0 else 20)


def product_events(t: Tables, project: str, frm: str, to: str, event: str | None = None) -> DataFrame:
    rows = _in_range(t, "v_product_daily", project, frm, to)
    rows = rows.where(F.col("event_name") == event) if event else rows
    return rows.select("day", "event_name", "count", "unique_users").orderBy("day", F.desc("count"), "event_name")


def product_totals(t: Tables, project: str, frm: str, to: str) -> DataFrame:
    return _in_range(t, "v_product_totals", project, frm, to).select("day", "total_events", "active_users").orderBy("day")


def product_attributes(t: Tables, project: str, frm: str, to: str, event: str | None = None, key: str | None = None) -> DataFrame:
    rows = _in_range(t, "v_product_attrs", project, frm, to)
    rows = rows.where(F.col("event_name") == event) if event else rows
    rows = rows.where(F.col("attr_key") == key) if key else rows
    return rows.select("day", "event_name", "attr_key", "attr_value", "count", "unique_users").orderBy("day", F.desc("count"), "event_name", "attr_key", "attr_value")


def retention(t: Tables, project: str, frm: str, to: str, surface: str) -> DataFrame:
    """Cohorts that began in the range, with the last cohort day there is over both surfaces."""
    if t.projects.where((F.col("alias") == project) & (F.col("identity") == "identified")).isEmpty():
        raise ValueError(f"project {project} is not identified, so it has no cohorts")
    cells = view("v_retention", t).where(F.col("project") == project)
    through = cells.agg(F.max("cohort_day").alias("aggregated_through"))
    inside = cells.where((F.col("surface") == surface) & F.col("cohort_day").between(F.lit(frm).cast("date"), F.lit(to).cast("date")))
    return inside.join(F.broadcast(through)).select("cohort_day", "day_offset", "actors", "cohort_size", "aggregated_through").orderBy("cohort_day", "day_offset")


def identities(t: Tables, project: str, frm: str, to: str, kind: str, limit: int = 50) -> DataFrame:
    if kind not in ("user", "group"):
        raise ValueError(f"kind must be user or group, not {kind}")
    rows = _in_range(t, "v_identity_daily", project, frm, to).where(F.col("kind") == kind)
    sums = _sums(rows, ["project", "kind", "id"], "actors", "users", "hits", "views", "events")
    named = sums.join(t.identities.select("project", "kind", "id", "name"), ["project", "kind", "id"], "left")
    top = named.orderBy(F.desc(F.col("hits") + F.col("views") + F.col("events")), "id").limit(limit if limit > 0 else 50)
    return top.select("id", F.coalesce("name", F.lit("")).alias("name"), "actors", "users", "hits", "views", "events")


def _outside(plan, allowed: set[str]) -> set[str]:
    """Relations that an analysed plan reads other than through the allowed views, and calls that leave the engine."""
    found: set[str] = set()
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]

    def inside(expression) -> None:
        kind = expression.getClass().getSimpleName()
        if "Reflect" in kind or kind.endswith(("UDF", "UDAF")) or "HiveGenericUDF" in kind:
            found.add(kind)
        if kind in ("ScalarSubquery", "LateralSubquery", "Exists", "ListQuery"):
            walk(expression.plan())
        for child in each(expression.children()):
            inside(child)

    def walk(node) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "SubqueryAlias" and node.identifier().name().lower() in allowed and node.child().getClass().getSimpleName() == "View":
            return
        for expression in each(node.expressions()):
            inside(expression)
        below = [*each(node.children()), *(each(node.innerChildren()) if kind == "WithCTE" else [])]
        if not below and kind not in ("OneRowRelation", "LocalRelation", "CTERelationRef"):
            found.add(kind)
        for child in below:
            walk(child)

    walk(plan)
    return found


def query(t: Tables, sql: str, max_rows: int = 1000, seconds: float = 10.0) -> tuple[list, bool]:
    """Rows of one SELECT over the views, and whether more were cut off.

    It runs as a subquery, which nothing but a query can be, in a session of its
    own, and is stopped when its time is over. It may read the views of
    `view_names` and no other table or file, and call QUERY_FUNCTIONS and no
    other function. The names are checked as they are parsed, and the relations
    and calls once more in the analysed plan. A common table expression may not
    have the name of a view, a table or a function.
    """
    body = sql.strip().rstrip(";")
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", body)
    if not re.match(r"(?i)(select|with)\b", body) or re.search(r";|--|/\*|`|\$\{", bare):
        raise ValueError("one SELECT or WITH statement, without comments and backquotes, is asked for")
    spark = t.web.sparkSession.newSession()
    # relations as the parser sees them, in subqueries too; a common table expression is one of the query's own
    tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(body).treeString()
    own = {x.strip().lower() for group in re.findall(r"CTE \[([^\]]*)\]", tree) for x in group.split(",")}
    own |= {x.lower() for x in re.findall(r"(?i)(?:\bwith|,)\s+(?:recursive\s+)?(\w+)\s*(?:\([^)]*\)\s*)?as\s*\(", bare)}
    calls = {name.lower() for name in re.findall(r"([A-Za-z_]\w*)\s*\(", bare)}
    read = {x.replace(" ", "").lower() for x in re.findall(r"UnresolvedRelation \[([^\]]*)\]", tree)}
    views = set(view_names())
    taken = {x for x in own if x in views or x in QUERY_FUNCTIONS or spark.catalog.functionExists(x) or spark.catalog.tableExists(x)}
    if refused := taken | (calls - QUERY_FUNCTIONS - own) | (read - own - views):
        raise ValueError(f"not allowed in a query: {', '.join(sorted(refused))}")
    register_views(spark, t, sorted(read & views))
    if refused := _outside(spark.sql(f"SELECT * FROM ({body})")._jdf.queryExecution().analyzed(), views):
        raise ValueError(f"not allowed in a query: {', '.join(sorted(refused))}")
    tag = f"pagetide-query-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, spark.interruptTag, [tag])
    spark.addTag(tag)
    timer.start()
    try:
        rows = spark.sql(f"SELECT * FROM ({body})").limit(max_rows + 1).collect()
    finally:
        timer.cancel()
        spark.removeTag(tag)
    return rows[:max_rows], len(rows) > max_rows


# Dashboard reports. Each takes the tables, a project, the last day and the number of days.


def _window(name: str, t: Tables, project: str, as_of: str, days: int) -> DataFrame:
    frm = datetime.date.fromisoformat(as_of) - datetime.timedelta(days - 1)
    return _in_range(t, name, project, frm.isoformat(), as_of)


def _ranked(name: str, by: str, columns: list[str], limit: int | None) -> Callable[..., DataFrame]:
    return lambda *a: _top(_window(name, *a).where(F.col(by) != ""), [by], columns, limit)


def _web_daily(*a) -> DataFrame:
    return _window("v_web_daily", *a).select("day", "visitors", "pageviews", "sessions", _ratio("bounces", "sessions").alias("bounce_rate"), _ratio("duration_sec", "sessions").alias("avg_session_sec")).orderBy("day")


def _web_totals(*a) -> DataFrame:
    sums = _sums(_window("v_web_daily", *a), [], "visitors", "pageviews", "sessions", "bounces", "duration_sec")
    return sums.select("visitors", "pageviews", "sessions", _ratio("bounces", "sessions").alias("bounce_rate"), _ratio("duration_sec", "sessions").alias("avg_session_sec"))


def _web_pages(t: Tables, project: str, *a) -> DataFrame:
    top = _top(_window("v_web_pages", t, project, *a), ["path"], ["pageviews", "visitors"], 20)
    return top.select("path", "visitors", "pageviews", F.concat(F.lit(f"/web/{project}/page?path="), "path").alias("detail_url"))


def _web_campaigns(*a) -> DataFrame:
    return _top(_window("v_web_utm", *a).where("utm_source <> ''"), list(WEB_DIMENSIONS["utm"]), ["visitors", "pageviews"], 20)


def page_daily(t: Tables, project: str, as_of: str, days: int, path: str) -> DataFrame:
    return _window("v_web_pages", t, project, as_of, days).where(F.col("path") == path).select("day", "visitors", "pageviews").orderBy("day")


def page_totals(t: Tables, project: str, as_of: str, days: int, path: str) -> DataFrame:
    sums = _sums(page_daily(t, project, as_of, days, path), [], "visitors", "pageviews")
    return sums.withColumn("views_per_visitor", _ratio("pageviews", "visitors"))


def _app_daily(*a) -> DataFrame:
    return _window("v_app_daily", *a).select("day", "actives", "views", "sessions", _ratio("duration_sec", "sessions").alias("avg_session_sec"), _ratio("sessions", "actives").alias("sessions_per_active")).orderBy("day")


def _app_totals(*a) -> DataFrame:
    sums = _sums(_window("v_app_daily", *a), [], "actives", "views", "sessions", "duration_sec")
    return sums.select("actives", "views", "sessions", _ratio("duration_sec", "sessions").alias("avg_session_sec"))


def _app_versions(*a) -> DataFrame:
    rows = _window("v_app_versions", *a).where("app_version <> ''")
    return rows.select("day", F.concat_ws(" ", "platform", "app_version").alias("version"), "actives").orderBy("day", "version")


def _app_oses(*a) -> DataFrame:
    rows = _window("v_app_os", *a).where("os_version <> ''").withColumn("os", F.concat_ws(" ", "platform", "os_version"))
    return _top(rows, ["os"], ["actives"], 15)


def _product_headline(*a) -> DataFrame:
    return _window("v_product_totals", *a).agg(F.sum("total_events").alias("total_events"), F.max("active_users").alias("peak_dau"), F.avg("active_users").alias("avg_dau"))


def _event_summary(*a) -> DataFrame:
    rows = _window("v_product_daily", *a).groupBy("event_name").agg(F.sum("count").alias("total"), F.max("unique_users").alias("peak_daily_uniques"))
    return rows.orderBy(F.desc("total"), "event_name")


def _actions() -> Column:
    return F.sum(F.col("hits") + F.col("views") + F.col("events"))


def _of_kind(kind: str, *a) -> DataFrame:
    return _window("v_identity_daily", *a).where((F.col("kind") == kind) & (F.col("id") != ""))


def _mode(t: Tables, project: str, *_) -> DataFrame:
    return t.projects.where(F.col("alias") == project).select("identity")


def _users_daily(*a) -> DataFrame:
    return _of_kind("user", *a).groupBy("day").agg(F.countDistinct("id").alias("active_users"), _actions().alias("actions")).orderBy("day")


def _users_totals(*a) -> DataFrame:
    return _of_kind("user", *a).agg(F.countDistinct("id").alias("users"), _actions().alias("actions")).withColumn("per_user", _ratio("actions", "users"))


def _top_ids(kind: str, t: Tables, *a) -> DataFrame:
    sums = _of_kind(kind, t, *a).groupBy("project", "kind", "id").agg(
        F.max("users").alias("users"), _actions().alias("actions"), F.countDistinct("day").alias("active_days"), F.max("day").alias("last_seen")
    )
    named = sums.join(t.identities.select("project", "kind", "id", "name"), ["project", "kind", "id"], "left")
    top = named.orderBy(F.desc("actions"), "id").limit(50)
    columns = ["actions", "active_days", "last_seen"] if kind == "user" else ["users", "actions", "active_days", "last_seen"]
    return top.select(F.coalesce("name", "id").alias("name"), *columns)


def _groups_daily(*a) -> DataFrame:
    return _of_kind("group", *a).groupBy("day").agg(F.countDistinct("id").alias("active_groups")).orderBy("day")


def _groups_totals(*a) -> DataFrame:
    return _of_kind("group", *a).agg(F.countDistinct("id").alias("groups"), _actions().alias("actions"))


def _cells(t: Tables, project: str) -> DataFrame:
    return view("v_retention", t).where((F.col("project") == project) & F.col("day_offset").between(0, 30))


def _curve(t: Tables, project: str, *_) -> DataFrame:
    return _sums(_cells(t, project), ["surface", "day_offset"], "actors", "cohort_size").withColumn("retention", _ratio("actors", "cohort_size")).orderBy("surface", "day_offset")


def _milestones(t: Tables, project: str, *_) -> DataFrame:
    at = lambda n: F.max(F.when(F.col("day_offset") == n, F.col("retention"))).alias(f"d{n}")
    return _curve(t, project).where(F.col("day_offset").isin(1, 7, 30)).groupBy("surface").agg(at(1), at(7), at(30))


def _cohort_rows(t: Tables, project: str, *_) -> DataFrame:
    rows = _cells(t, project).select("surface", "cohort_day", "day_offset", "cohort_size", "actors", _ratio("actors", "cohort_size").alias("retention"))
    return rows.orderBy(F.desc("cohort_day"), "surface", "day_offset")


REPORTS: dict[str, Callable[..., DataFrame]] = {
    "index.active_projects": lambda t, *_: t.projects.where("NOT archived").select("alias", "name").orderBy("name"),
    "index.archived_projects": lambda t, *_: t.projects.where("archived").select("alias", "name").orderBy("name"),
    "web.daily": _web_daily,
    "web.totals": _web_totals,
    "web.pages": _web_pages,
    "web.referrers": _ranked("v_web_referrers", "source", ["visitors", "pageviews"], 20),
    "web.hosts": _ranked("v_web_hosts", "host", ["pageviews", "visitors"], 20),
    "web.countries": _ranked("v_web_countries", "country", ["visitors"], 20),
    "web.devices": _ranked("v_web_devices", "device", ["visitors"], None),
    "web.browsers": _ranked("v_web_browsers", "browser", ["visitors"], 10),
    "web.oses": _ranked("v_web_os", "os", ["visitors"], 10),
    "web.campaigns": _web_campaigns,
    "page.page_daily": page_daily,
    "page.page_totals": page_totals,
    "app.app_daily": _app_daily,
    "app.app_totals": _app_totals,
    "app.app_versions": _app_versions,
    "app.app_screens": _ranked("v_app_screens", "screen", ["views", "actives"], 20),
    "app.app_platforms": _ranked("v_app_versions", "platform", ["actives"], None),
    "app.app_oses": _app_oses,
    "app.app_devices": _ranked("v_app_devices", "device_model", ["actives"], 15),
    "app.app_countries": _ranked("v_app_countries", "country", ["actives"], 20),
    "product.totals": lambda *a: _window("v_product_totals", *a).select("day", "total_events", "active_users").orderBy("day"),
    "product.headline": _product_headline,
    "product.events": lambda *a: _window("v_product_daily", *a).select("day", "event_name", "count", "unique_users").orderBy("day", "event_name"),
    "product.event_summary": _event_summary,
    "product.attr_breakdowns": lambda *a: _window("v_product_attrs", *a).drop("project").orderBy("day", "event_name", "attr_key", "attr_value"),
    "users.users_mode": _mode,
    "users.users_daily": _users_daily,
    "users.users_totals": _users_totals,
    "users.users_top": lambda *a: _top_ids("user", *a),
    "groups.groups_daily": _groups_daily,
    "groups.groups_totals": _groups_totals,
    "groups.groups_top": lambda *a: _top_ids("group", *a),
    "retention.retention_mode": _mode,
    "retention.retention_curve": _curve,
    "retention.retention_milestones": _milestones,
    "retention.retention_cohorts": _cohort_rows,
}


def report(name: str, t: Tables, project: str, as_of: str, days: int = 30, **more) -> DataFrame:
    if name not in REPORTS:
        raise ValueError(f"no report {name}; there are {', '.join(REPORTS)}")
    return REPORTS[name](t, project, as_of, days, **more)
