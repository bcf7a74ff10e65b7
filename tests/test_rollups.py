"""Hand-computed numbers of small fixtures, invariants and idempotency."""

import datetime

import pytest
from pyspark.sql import functions as F

from pagetide import schemas
from pagetide.operators import cohorts, lifecycle, rollups, sessions
from pagetide.plans import reports, views
from pagetide.plans.views import Tables
from pagetide.sources import store

D10, D11 = datetime.date(2026, 8, 10), datetime.date(2026, 8, 11)


def rows(spark, schema, *items):
    names = [c.split(" ")[0] for c in schema.replace("map<string,string>", "map").split(", ")]
    out = []
    for i, item in enumerate(items):
        base = {n: "" for n in names} | {"id": str(i), "project": "app", "attributes": {}} | item
        base["ts"] = base["received_at"] = datetime.datetime.combine(base["day"], datetime.time.fromisoformat(item["at"]))
        out.append(tuple(base[n] for n in names))
    return spark.createDataFrame(out, schema)


def hit(actor, at, path="/a", day=D10, **more):
    return {"actor_id": actor, "at": at, "path": path, "day": day} | more


@pytest.fixture
def hits(spark):
    us = {"country": "US", "device": "desktop", "browser": "Firefox", "os": "Linux", "host": "shop.example.com"}
    de = {"country": "DE", "device": "mobile", "browser": "Chrome", "os": "Android", "host": "shop.example.com", "referrer_source": "google", "utm_source": "hn", "utm_medium": "social", "utm_campaign": "launch"}
    return rows(spark, schemas.WEB_HITS, hit("v1", "10:00", **us), hit("v1", "10:10", "/b", **us), hit("v1", "12:00", **us), hit("v2", "11:00", **de))


def product(spark, *items):
    return rows(spark, schemas.PRODUCT_EVENTS, *[{"actor_id": a, "event_name": e, "attributes": m, "day": D10, "at": "10:00"} for a, e, m in items])


def projects(spark, attributes=("plan", "source")):
    return spark.createDataFrame([("app", "App", "identified", list(attributes), False)], "alias string, name string, identity string, attributes array<string>, archived boolean")


def first(df):
    return df.collect()[0].asDict()


def test_web_day(hits):
    assert first(rollups.web_daily(hits)) == {"project": "app", "day": D10, "visitors": 2, "pageviews": 4, "sessions": 3, "bounces": 2, "duration_sec": 600}
    assert first(rollups.web_dimension(hits, "pages").where("path = '/a'"))["pageviews"] == 3
    assert first(rollups.web_dimension(hits, "countries").where("country = 'DE'"))["visitors"] == 1
    assert rollups.web_dimension(hits, "utm").count() == 1
    long = {(r.dimension, tuple(r["values"])): (r.visitors, r.pageviews) for r in rollups.web_dimensions(hits).collect()}
    for name, columns in rollups.WEB_DIMENSIONS.items():
        own = {(name, tuple(r[c] for c in columns)): (r.visitors, r.pageviews) for r in rollups.web_dimension(hits, name).collect()}
        assert own == {k: v for k, v in long.items() if k[0] == name}


def test_session_edges(spark):
    near = rows(spark, schemas.WEB_HITS, hit("a", "10:00"), hit("a", "10:30"), hit("b", "10:00"), hit("b", "10:30:01"))
    assert {(r.actor_id, r.hit_count) for r in sessions.web_sessions(near).collect()} == {("a", 2), ("b", 1)}
    view = lambda a, s, t: {"actor_id": a, "session_id": s, "at": t, "screen": "/", "day": D10}
    apart = rows(spark, schemas.APP_VIEWS, view("a", "", "10:00"), view("a", "", "11:00"))
    assert first(rollups.app_daily(apart))["sessions"] == 2
    declared = rows(spark, schemas.APP_VIEWS, view("a", "s1", "10:00"), view("a", "s1", "12:00"))
    assert first(rollups.app_daily(declared)) == {"project": "app", "day": D10, "actives": 1, "views": 2, "sessions": 1, "duration_sec": 7200}
    # a declared id never merges with an inferred number
    mixed = rows(spark, schemas.APP_VIEWS, view("a", "1", "10:00"), view("a", "", "15:00"))
    assert first(rollups.app_daily(mixed))["sessions"] == 2


def test_app_sessions_do_not_depend_on_the_order_of_rows(spark):
    """Views of one second, with and without a declared session: the smallest id decides, 9 before 10."""
    at = lambda a, i, s, t: {"actor_id": a, "id": i, "session_id": s, "at": t, "screen": "/", "day": D10}
    views = [at("a", "9", "", "10:00"), at("a", "10", "s1", "10:00"), at("a", "11", "", "12:00"), at("b", "9", "s1", "10:00"), at("b", "10", "", "10:00"), at("b", "11", "", "12:00")]
    want = {("a", "g:1", 1), ("a", "d:s1", 1), ("a", "g:2", 1), ("b", "d:s1", 1), ("b", "g:0", 1), ("b", "g:1", 1)}
    for order in (views, views[::-1]):
        found = sessions.app_sessions(rows(spark, schemas.APP_VIEWS, *order).coalesce(1))
        assert {(r.actor_id, r.session_key, r.view_count) for r in found.collect()} == want


def test_attributes_and_tail(spark):
    events = product(spark, ("u1", "subscribed", {"plan": "pro", "source": "ads"}), ("u2", "subscribed", {"plan": "free", "source": "ads"}), ("u2", "subscribed", {"plan": "free"}), ("u1", "ping", {}))
    assert first(rollups.product_totals(events))["total_events"] == 4
    assert first(rollups.product_daily(events).where("event_name = 'subscribed'"))["unique_users"] == 2
    out = {(r.event_name, r.attr_key, r.attr_value): (r["count"], r.unique_users) for r in rollups.product_attrs(events, projects(spark)).collect()}
    assert out == {("subscribed", "plan", "free"): (2, 1), ("subscribed", "plan", "pro"): (1, 1), ("subscribed", "source", "ads"): (2, 2)}
    assert rollups.product_attrs(events, projects(spark, [])).count() == 0
    clicks = [(u, "clicked", {"button": f"v{v}"}) for v, users in enumerate((("u1", "u2", "u3"), ("u1", "u2"), ("u1",), ("u2",), ("u3",))) for u in users]
    capped = {r.attr_value: (r["count"], r.unique_users) for r in rollups.product_attrs(product(spark, *clicks), projects(spark, ["button"]), 2).collect()}
    assert capped == {"v0": (3, 3), "v1": (2, 2), "(other)": (3, 3)}
    named = product(spark, *clicks, ("u9", "clicked", {"button": "(other)"}))
    assert {r.attr_value: r["count"] for r in rollups.product_attrs(named, projects(spark, ["button"]), 2).collect()}["(other)"] == 4
    assert rollups.product_attrs(product(spark, *clicks), projects(spark, ["button"]), 0).count() == 5


def test_dimension_cap_counts_distinct_actors(spark):
    views_ = [{"actor_id": "a", "screen": f"/{i}", "day": D10, "at": "10:00"} for i in range(503)] + [{"actor_id": "a", "screen": "/hot", "day": D10, "at": "10:00"}] * 2
    out = rollups.app_dimension(rows(spark, schemas.APP_VIEWS, *views_), "screens")
    assert out.count() == 501
    assert first(out.where("screen = '(other)'")) == {"project": "app", "day": D10, "screen": "(other)", "views": 4, "actives": 1}


def test_cohorts(spark):
    day = lambda n: datetime.date(2026, 8, n)
    app = rows(spark, schemas.APP_VIEWS, *[{"actor_id": a, "day": day(d), "at": "10:00", "screen": "/"} for a, d in (("a", 1), ("b", 1), ("a", 8), ("", 1))])
    web, events = rows(spark, schemas.WEB_HITS), rows(spark, schemas.PRODUCT_EVENTS)
    known = cohorts.actors(app, web, events)
    assert {(r.actor_id, r.first_seen_day, r.last_seen_day, r.surface) for r in known.collect()} == {("a", day(1), day(8), "app"), ("b", day(1), day(1), "app")}
    cells = cohorts.with_cohort_size(cohorts.retention(known, app, web, events, projects(spark)))
    assert {(r.day_offset, r.actors, r.cohort_size) for r in cells.collect()} == {(0, 2, 2), (7, 1, 2)}
    anonymous = projects(spark).withColumn("identity", F.lit("anonymous"))
    assert cohorts.retention(known, app, web, events, anonymous).count() == 0


def test_identity_day(spark):
    who = {"group_id": "org9", "day": D10, "at": "10:00"}
    app = rows(spark, schemas.APP_VIEWS, who | {"actor_id": "a", "user_id": "u1"}, who | {"actor_id": "b", "user_id": "u2"})
    events, web = rows(spark, schemas.PRODUCT_EVENTS, who | {"actor_id": "a", "user_id": "u1"}), rows(spark, schemas.WEB_HITS, who | {"actor_id": "a", "user_id": "u1"})
    out = {(r.kind, r.id): (r.actors, r.users, r.hits, r.views, r.events) for r in cohorts.identity_daily(web, app, events).collect()}
    assert out == {("group", "org9"): (2, 2, 1, 2, 1), ("user", "u1"): (1, 1, 1, 1, 1), ("user", "u2"): (1, 1, 0, 1, 0)}


def test_views_do_not_move_when_a_day_ages(spark, hits):
    events = product(spark, ("u1", "subscribed", {"plan": "pro"}), ("u2", "subscribed", {"plan": "free"}))
    more = hits.unionByName(rows(spark, schemas.WEB_HITS, hit("v9", "09:00", day=D11)))
    app = rows(spark, schemas.APP_VIEWS, *[{"actor_id": "a", "screen": f"/{i}", "platform": "ios", "day": D10, "at": "10:00"} for i in range(4)])
    names = spark.createDataFrame([], schemas.IDENTITIES)
    t = Tables(more, app, events, projects(spark), names, dimension_cap=2)
    days = spark.createDataFrame([(f, "app", D10) for f in ("web", "app", "product", "identity")], schemas.AGG_DAYS)
    aged = lifecycle.stored_tables(t, days)
    for name in views.VIEWS:
        before, after = views.view(name, t), views.view(name, aged).select(*views.view(name, t).columns)
        assert sorted(map(str, before.collect())) == sorted(map(str, after.collect())), name
    assert {r.day: r.pageviews for r in views.view("v_web_daily", aged).collect()} == {D10: 4, D11: 1}


def test_daily_pass_and_late_rows(spark, hits):
    app, events = rows(spark, schemas.APP_VIEWS), rows(spark, schemas.PRODUCT_EVENTS)
    kept = "struct<raw_days:int,aggregate_days:int>"
    registry = projects(spark).withColumn("retention", F.lit(None).cast(f"struct<web:{kept},product:{kept},app:{kept}>"))
    t = Tables(hits, app, events, registry, None)
    out = lifecycle.daily_pass(t, datetime.date(2026, 8, 20))
    assert {(r.family, r.day) for r in out.agg_days.collect()} == {("web", D10), ("identity", D10)}
    assert out.raw["web"].count() == 0 and out.aggregates["v_web_daily"].count() == 1
    late = rows(spark, schemas.WEB_HITS, hit("v7", "13:00"), hit("v7", "13:00", day=D11))
    fresh, stored = lifecycle.late_rows(late, out.agg_days, "web")
    assert fresh.count() == 1 and stored.count() == 1
    assert lifecycle.daily_pass(t, datetime.date(2026, 8, 12)).agg_days.count() == 0


def test_a_failing_project_leaves_the_others_alone(spark, hits, tmp_path, monkeypatch):
    both = hits.unionByName(hits.withColumn("project", F.lit("other")))
    registry = projects(spark).unionByName(projects(spark).withColumn("alias", F.lit("other"))).withColumn("retention", F.lit(None).cast("struct<web:struct<raw_days:int,aggregate_days:int>,product:struct<raw_days:int,aggregate_days:int>,app:struct<raw_days:int,aggregate_days:int>>"))
    root = str(tmp_path)
    both.write.partitionBy("project", "day").parquet(f"{root}/web")
    drop = store.drop_partition

    def refuse(s, path, project, day=None):
        if project == "app":
            raise OSError("no disk")
        return drop(s, path, project, day)

    monkeypatch.setattr(store, "drop_partition", refuse)
    names = spark.createDataFrame([], schemas.IDENTITIES)
    failed = lifecycle.age_out(spark, root, lifecycle.opened(spark, root, registry, names), datetime.date(2026, 8, 20))
    assert set(failed) == {"app"}
    after = lifecycle.opened(spark, root, registry, names)
    assert {r.project for r in after.web.select("project").distinct().collect()} == {"app"}
    # the days are noted, so rows that could not be dropped are not counted twice
    assert {(r.project, r.pageviews) for r in views.view("v_web_daily", after).collect()} == {("app", 4), ("other", 4)}


_RETENTION = "struct<web:struct<raw_days:int,aggregate_days:int>,product:struct<raw_days:int,aggregate_days:int>,app:struct<raw_days:int,aggregate_days:int>>"


def _identified(spark):
    return projects(spark).withColumn("identity", F.lit("identified")).withColumn("retention", F.lit(None).cast(_RETENTION))


def _seen(t, *names):
    return {name: sorted(map(str, views.view(name, t).collect())) for name in names}


def test_a_pass_may_stop_anywhere(spark, hits, tmp_path, monkeypatch):
    root, registry, names = str(tmp_path), _identified(spark), spark.createDataFrame([], schemas.IDENTITIES)
    days = rows(spark, schemas.WEB_HITS, hit("v1", "10:00"), hit("v2", "11:00"), hit("v1", "10:00", day=D11), hit("v3", "10:00", day=D11))
    days.write.partitionBy("project", "day").parquet(f"{root}/web")
    t = lambda: lifecycle.opened(spark, root, registry, names)
    checked = ("v_web_daily", "v_web_pages", "v_retention")
    before = _seen(t(), *checked)
    assert len(before["v_retention"]) == 3

    def fail(*_):
        raise OSError("no disk")

    calls = []
    whole = store.replace_days

    def third(rows_, path):
        calls.append(path)
        return fail() if len(calls) % 3 == 0 else whole(rows_, path)

    for module, name, function in ((store, "replace_days", third), (lifecycle, "note", fail), (store, "drop_partition", fail)):
        with monkeypatch.context() as patch:
            patch.setattr(module, name, function)
            assert lifecycle.age_out(spark, root, t(), datetime.date(2026, 8, 30)) != {}
        assert _seen(t(), *checked) == before and t().web.count() == 4, name
    assert lifecycle.age_out(spark, root, t(), datetime.date(2026, 8, 30)) == {}
    assert t().web.count() == 0 and _seen(t(), *checked) == before


def test_renamed_and_erased_days_stay_so(spark, hits, tmp_path):
    root, registry, names = str(tmp_path), _identified(spark), spark.createDataFrame([], schemas.IDENTITIES)
    hits.write.partitionBy("project", "day").parquet(f"{root}/web")
    assert lifecycle.age_out(spark, root, lifecycle.opened(spark, root, registry, names), datetime.date(2026, 8, 30)) == {}
    lifecycle.rename_stored(spark, root, "app", "new")
    lifecycle.rename_stored(spark, root, "app", "new")  # a second try finds nothing to do
    registry = registry.withColumn("alias", F.lit("new"))
    store.append_new(rows(spark, schemas.WEB_HITS, hit("v9", "09:00")).withColumn("project", F.lit("new")).withColumn("id", F.lit("late")), f"{root}/web", schemas.WEB_HITS)
    t = lifecycle.opened(spark, root, registry, names)
    want = _seen(t, "v_web_daily")
    assert {(r.project, r.day, r.pageviews) for r in views.view("v_web_daily", t).collect()} == {("new", D10, 4)}
    assert lifecycle.age_out(spark, root, t, datetime.date(2026, 8, 30)) == {}
    t = lifecycle.opened(spark, root, registry, names)
    assert _seen(t, "v_web_daily") == want and t.web.count() == 0
    with pytest.raises(ValueError, match="taken"):
        spark.range(1).write.parquet(f"{root}/web/project=new/day={D10}")
        spark.range(1).write.parquet(f"{root}/web/project=old/day={D10}")
        lifecycle.rename_stored(spark, root, "old", "new")
    lifecycle.erase_stored(spark, root, "new")
    assert lifecycle.opened(spark, root, registry, names).agg_days.count() == 0
    # an alias that is used again begins anew
    store.append_new(rows(spark, schemas.WEB_HITS, hit("v1", "10:00")).withColumn("project", F.lit("new")), f"{root}/again", schemas.WEB_HITS)
    t = lifecycle.opened(spark, root, registry, names)
    assert views.view("v_web_daily", Tables(store.read_table(spark, f"{root}/again", schemas.WEB_HITS), t.app, t.product, registry, names, agg=t.agg, agg_days=t.agg_days)).count() == 1


def test_expired_aggregates_go_by_folder(spark, hits, tmp_path):
    root, registry, names = str(tmp_path), _identified(spark), spark.createDataFrame([], schemas.IDENTITIES)
    for day in ("2025-01-01", "2026-08-01"):
        rollups.web_daily(hits).withColumn("day", F.lit(day).cast("date")).write.mode("append").partitionBy("project", "day").parquet(f"{root}/aggregates/v_web_daily")
    assert lifecycle.prune_stored(spark, root, lifecycle.retention_windows(registry), datetime.date(2026, 8, 30)) == 1
    assert [r.day for r in lifecycle.opened(spark, root, registry, names).agg["v_web_daily"].collect()] == [datetime.date(2026, 8, 1)]


def test_stored_days_are_not_read_from_raw_rows(spark, hits, tmp_path, monkeypatch):
    root, registry, names = str(tmp_path), _identified(spark), spark.createDataFrame([], schemas.IDENTITIES)
    more = hits.unionByName(rows(spark, schemas.WEB_HITS, hit("v1", "10:00", day=datetime.date(2026, 8, 29))))
    more.write.partitionBy("project", "day").parquet(f"{root}/web")
    want = _seen(lifecycle.opened(spark, root, registry, names), *views.VIEWS)
    with monkeypatch.context() as patch:
        patch.setattr(store, "drop_partition", lambda *_: False)  # raw rows of stored days stay
        assert lifecycle.age_out(spark, root, lifecycle.opened(spark, root, registry, names), datetime.date(2026, 8, 30)) == {}
    for part in (tmp_path / "web" / "project=app" / f"day={D10}").glob("*.parquet"):
        part.write_bytes(b"no table")  # whoever reads this fails
    for crc in (tmp_path / "web" / "project=app" / f"day={D10}").glob(".*.crc"):
        crc.unlink()
    t = lifecycle.opened(spark, root, registry, names)
    assert t.noted is not None and _seen(t, *views.VIEWS) == want
    # beyond a bounded number of runs, joins tell the halves apart
    monkeypatch.setattr(views, "MOST_RUNS", 1)
    days = spark.createDataFrame([("web", "app", D10), ("web", "app", D11), ("web", "b", D10)], schemas.AGG_DAYS)
    assert views.noted_days(days) is None and set(views.noted_days(days.where("project = 'app'"))) == {"web"}
    assert views.noted_days(days.where("false")) == {}
    monkeypatch.undo()
    noted = views.noted_days(days.unionByName(days))["web"]
    found = spark.createDataFrame([("app", D10), ("app", D11), ("b", D10), ("b", D11), (None, D10)], "project string, day date").select("project", "day", noted.alias("n")).collect()
    assert [(r.project, r.day) for r in found if r.n] == [("app", D10), ("app", D11), ("b", D10)]
    assert all(r.n is not None for r in found)


def test_logs_are_pruned_and_compacted(spark, tmp_path, monkeypatch):
    root, today = str(tmp_path), datetime.date(2026, 8, 30)
    old, new = datetime.date(2025, 1, 1), datetime.date(2026, 8, 1)
    registry = _identified(spark).unionByName(_identified(spark).withColumn("alias", F.lit("b c")))
    windows = lifecycle.retention_windows(registry)
    actors = [("app", "gone", "app", old, old, old), ("app", "back", "web", old, old, old), ("app", "back", "app", new, new, new), ("b c", "x", "web", new, new, new)]
    for one in actors:
        spark.createDataFrame([one], schemas.ACTORS).write.mode("append").partitionBy("project").parquet(f"{root}/actors")
    spark.createDataFrame([("app", "web", old, 0, 1), ("app", "web", new, 0, 1), ("app", "web", new, 0, 2), ("b c", "web", old, 3, 1)], schemas.CELLS).write.partitionBy("project").parquet(f"{root}/cells")
    known = lambda: sorted((r.project, r.actor_id, r.surface, r.first_seen_day, r.last_seen_day) for r in cohorts.known_actors(store.read_table(spark, f"{root}/actors", schemas.ACTORS)).collect())
    want = [("app", "back", "web", old, new), ("b c", "x", "web", new, new)]
    # one that stops before it deletes what it has replaced leaves the same actors
    with monkeypatch.context() as patch:
        patch.setattr(cohorts, "merge_cell_log", lambda log: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            lifecycle.prune_logs(spark, root, windows, today)
    assert known() == want
    assert lifecycle.prune_logs(spark, root, windows, today) == ["app", "b c"]
    assert lifecycle.prune_logs(spark, root, windows, today) == []
    assert known() == want and store.read_table(spark, f"{root}/actors", schemas.ACTORS).count() == 2
    cells = store.read_table(spark, f"{root}/cells", schemas.CELLS).collect()
    assert [(r.project, r.cohort_day, r.actors) for r in cells] == [("app", new, 2)]


def test_salts_rotate_in_one_step(spark, tmp_path, monkeypatch):
    path, at = str(tmp_path / "salts"), datetime.datetime(2026, 8, 10, 12)
    first_ = lifecycle.rotate_stored_salts(spark, path, at).collect()
    assert len(first_) == 1 and lifecycle.rotate_stored_salts(spark, path, at).collect() == first_
    (tmp_path / "salts" / "version=7").mkdir()  # a version that was not finished
    assert store.read_version(spark, path, schemas.SALTS).collect() == first_
    with monkeypatch.context() as patch:
        patch.setattr(store, "_delete", lambda *_: False)
        second = lifecycle.rotate_stored_salts(spark, path, at + datetime.timedelta(2)).collect()
    assert len(second) == 1 and second != first_
    # the next call destroys what is over
    assert lifecycle.rotate_stored_salts(spark, path, at + datetime.timedelta(2)).collect() == second
    assert [p.name for p in (tmp_path / "salts").iterdir()] == ["version=8"]


def test_a_returning_actor_stays_in_its_cohort(spark):
    log = spark.createDataFrame([("app", "v1", "app", D10, D10, D10), ("app", "v1", "web", D10, D11, D11)], schemas.ACTORS)
    assert [(r.surface, r.first_seen_day, r.last_seen_day) for r in cohorts.known_actors(log).collect()] == [("app", D10, D11)]


def test_store_is_idempotent(spark, hits, tmp_path):
    path = str(tmp_path / "web")
    for _ in range(2):
        store.append_new(hits, path, schemas.WEB_HITS)
    assert store.read_table(spark, path, schemas.WEB_HITS).count() == 4
    daily = str(tmp_path / "daily")
    for _ in range(2):
        store.replace_days(rollups.web_daily(hits), daily)
    store.replace_days(rollups.web_daily(hits.where("false")), daily)
    assert spark.read.parquet(daily).count() == 1
    assert store.read_table(spark, str(tmp_path / "none"), schemas.WEB_HITS).count() == 0


def test_flat_view_names(spark):
    events = product(spark, ("u1", "x", {"plan": "pro", "a b": "1", "a-b": "2"}))
    out = views.flat_events(events, ["plan", "a b", "a-b", "absent"])
    assert out.columns[6:] == ["attr_a_b", "attr_a_b_2", "attr_absent", "attr_plan"]
    assert first(out)["attr_a_b"] == "1" and first(out)["attr_a_b_2"] == "2" and first(out)["attr_absent"] is None


def test_read_functions_refuse(spark, hits):
    t = Tables(hits, rows(spark, schemas.APP_VIEWS), rows(spark, schemas.PRODUCT_EVENTS), projects(spark), spark.createDataFrame([], schemas.IDENTITIES))
    with pytest.raises(ValueError, match="unknown project"):
        reports.web_overview(t, "none", "2026-08-01", "2026-08-31")
    with pytest.raises(ValueError, match="not a date"):
        reports.web_overview(t, "app", "yesterday", "2026-08-31")
    with pytest.raises(ValueError, match="no dimension"):
        reports.web_breakdown(t, "app", "2026-08-01", "2026-08-31", "nope")
    spark.range(3).createOrReplaceTempView("secret")
    outside = ["SELECT * FROM text.`/etc/passwd`", "SELECT * FROM secret", "SELECT java_method('java.lang.System', 'exit', '1')", "SELECT reflect('java.util.UUID', 'randomUUID')", "SELECT * FROM range(5)"]
    outside += ["SELECT (SELECT max(id) FROM secret) AS m FROM v_web_daily", "WITH a AS (SELECT * FROM secret) SELECT * FROM a", "SELECT 1 -- x", "SELECT * FROM v_web_daily WHERE EXISTS (SELECT 1 FROM secret)", "SELECT * FROM parquet.secret"]
    outside += ["WITH java_method AS (SELECT 1 AS a) SELECT java_method('java.lang.System','getProperty','user.home') AS h FROM java_method"]
    spark.range(3).write.mode("overwrite").saveAsTable("secret_table")
    outside += ["WITH secret_table AS (SELECT 1 AS a) SELECT * FROM (SELECT * FROM secret_table) b", "SELECT (WITH secret_table AS (SELECT 1 AS a) SELECT max(a) FROM secret_table) AS m, s.* FROM secret_table s"]
    outside += ["SELECT * FROM default.secret_table", "SELECT * FROM v_web_daily WHERE pageviews IN (SELECT id FROM secret_table)", "WITH count(a) AS (SELECT 1) SELECT * FROM count", "WITH v_web_daily AS (SELECT 1 AS a) SELECT * FROM v_web_daily", "SELECT input_file_name() AS f FROM v_web_daily", "SELECT `path` FROM v_web_pages"]
    for sql in ("DROP TABLE x", "SELECT 1; SELECT 2", "", *outside):
        with pytest.raises(ValueError):
            reports.query(t, sql)
    assert reports.query(t, "WITH a AS (SELECT path FROM v_web_pages WHERE path <> 'x;(y)') SELECT count(*) AS n FROM a")[0][0].n == 2
    nested = "SELECT path, visitors FROM v_web_pages p WHERE EXISTS (SELECT 1 FROM v_web_daily d WHERE d.day = p.day) AND day IN (SELECT day FROM v_web_daily) AND visitors <= (SELECT max(visitors) FROM v_web_daily)"
    assert len(reports.query(t, nested)[0]) == 2
    assert len(reports.query(t, "WITH a AS (SELECT day FROM v_web_daily), b AS (SELECT * FROM a) SELECT * FROM a JOIN b USING (day) UNION ALL SELECT day FROM v_web_daily")[0]) == 2
    assert reports.query(t, "SELECT path FROM v_web_pages", max_rows=1)[1] is True
    assert reports.query(t, "SELECT count(*) AS n FROM v_web_pages", max_rows=1)[1] is False
    assert views.extract("v_app_daily", t, with_sentinel=True).count() == 1
    assert views.extract("v_web_daily", t, with_sentinel=True).count() == 1


def test_rename_and_erase(spark, hits):
    tables = {"projects": projects(spark), "web": hits}
    with pytest.raises(ValueError):
        lifecycle.rename_project(tables, "app", "app")
    with pytest.raises(ValueError):
        lifecycle.rename_project(tables, "nope", "new")
    assert {r.project for r in lifecycle.rename_project(tables, "app", "new")["web"].select("project").distinct().collect()} == {"new"}
    assert all(frame.count() == 0 for frame in lifecycle.erase_project(tables, "app").values())
