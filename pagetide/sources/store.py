"""Partitioned Parquet tables: scans, idempotent appends, and keyed replacement of days."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetide import schemas

_PARTITION = ["project", "day"]
#: Hash buckets of an id index, in each project; ids without a time give nothing to prune by, so a few will do.
ID_BUCKETS = 8
_VERSION_7 = "^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
#: 2020-01-01 and 2099-12-31 in days since 1970.
_ID_DAYS = (18_262, 47_481)


def read_envelopes(spark: SparkSession, path: str, stream: bool = False, files_a_trigger: int = 1000) -> DataFrame:
    """JSON envelopes, a line each; a line that is none has all columns null but `_corrupt_record`."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_a_trigger) if stream else spark.read
    return reader.schema(f"{schemas.ENVELOPES}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Projects and ingest keys from JSON files; lists and structures are parsed, flags are never null."""
    projects = spark.read.schema(schemas.PROJECTS).json(f"{path}/projects")
    keys = spark.read.schema(schemas.INGEST_KEYS).json(f"{path}/ingest_keys")
    projects = projects.withColumn("archived", F.coalesce("archived", F.lit(False))).withColumn("attributes", F.coalesce("attributes", F.array().cast("array<string>")))
    return projects, keys.withColumn("disabled", F.coalesce("disabled", F.lit(False)))


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception as error:  # the error class is the portable way to learn this for any store
        if getattr(error, "getCondition", lambda: "")() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, empty if nothing was ever written; no file is opened to learn that."""
    return spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


def scan(table: DataFrame, project: str, frm: datetime.datetime, to: datetime.datetime) -> DataFrame:
    """Rows of a project with frm <= ts < to; the day condition prunes partitions."""
    days = F.col("day").between(F.lit(frm.date()), F.lit(to.date()))
    return table.where((F.col("project") == project) & days & (F.col("ts") >= F.lit(frm)) & (F.col("ts") < F.lit(to)))


def days_before(table: DataFrame, cutoff: datetime.date) -> DataFrame:
    return table.where(F.col("day") < F.lit(cutoff)).select("day").distinct().orderBy("day")


def all_raw_days(*tables: DataFrame) -> DataFrame:
    days = tables[0].select("day")
    for table in tables[1:]:
        days = days.union(table.select("day"))
    return days.distinct().orderBy("day")


def id_bucket(event_id: Column) -> Column:
    """The part of an id index that an id belongs to, from the id alone, whenever it comes.

    An id of UUID version 7 holds the time it was made, so it goes to that day:
    new events touch the latest days, a replay the day it was first sent. All
    other ids, and those of a time before 2020 or after 2099, are spread by hash.
    """
    ms = F.conv(F.concat(F.substring(event_id, 1, 8), F.substring(event_id, 10, 4)), 16, 10).cast("long")
    days = F.floor(F.when(event_id.rlike(_VERSION_7), ms) / 86_400_000).cast("int")
    day = F.when(days.between(*_ID_DAYS), F.date_add(F.lit(datetime.date(1970, 1, 1)), days))
    return F.coalesce(F.concat(F.lit("d"), day.cast("string")), F.concat(F.lit("h"), F.pmod(F.xxhash64(event_id), F.lit(ID_BUCKETS)).cast("string")))


def known_ids(spark: SparkSession, ids: str, touched: dict[str, list[str]]) -> DataFrame:
    """project and id from the named buckets of an id index; no other partition is listed or read."""
    paths = [path for project, buckets in touched.items() for bucket in buckets if _there(spark, path := f"{ids}/project={project}/bucket={bucket}")]
    return spark.read.option("basePath", ids).schema(schemas.IDS).parquet(*paths).select("project", "id") if paths else spark.createDataFrame([], "project string, id string")


def append_new(rows: DataFrame, path: str, schema: str, ids: str | None = None, first: Callable[[DataFrame], None] | None = None) -> None:
    """Add rows whose id was never stored; replays of any age add nothing, on whatever day they fall.

    The ids of a table are kept beside it in an index (`ids`, which tables may
    share), so they outlive raw days that were dropped. A batch reads the
    buckets of its own ids only, and the index is the side that need not be
    shuffled: it is cut down to the batch's ids first, and the few that are left
    are then taken off the batch. One writer at a time. A note of the days
    stands while rows are written and their ids are not yet; if it is found, the
    last writer was stopped, and the ids of those days are put in the index
    first. So are the ids of a table that has no index yet. `first` gets the
    new rows before any of them is stored.
    """
    spark = rows.sparkSession
    ids, note = ids or f"{path}_ids", f"{path}_writing"
    if _there(spark, note):
        _index(read_table(spark, path, schema).where(F.col("day").isin([r["day"] for r in spark.read.json(note, schema="day date").collect()])), ids)
    elif not _there(spark, f"{ids}/_SUCCESS") and exists(spark, path):
        _index(read_table(spark, path, schema), ids)
    fresh = _unknown(rows.dropDuplicates(["project", "id"]), ids).persist()
    try:
        days = fresh.select("day").distinct()
        if days.isEmpty():
            return
        if first is not None:
            first(fresh)
        days.coalesce(1).write.mode("overwrite").json(note)
        # else each task would write a small file for each of its days
        fresh.hint("rebalance", *_PARTITION).write.mode("append").partitionBy(*_PARTITION).parquet(path)
        _add_ids(fresh, ids)
        _delete(spark, note)
    finally:
        fresh.unpersist()


def _unknown(rows: DataFrame, ids: str) -> DataFrame:
    """Rows whose ids are not in the index."""
    keys = rows.select("project", "id").where("id IS NOT NULL")
    touched: dict[str, list[str]] = {}
    for r in keys.select("project", id_bucket(F.col("id")).alias("bucket")).distinct().collect():  # days and hash buckets of a batch
        touched.setdefault(r["project"], []).append(r["bucket"])
    met = known_ids(rows.sparkSession, ids, touched).join(keys, ["project", "id"], "left_semi")
    return rows.join(met.distinct(), ["project", "id"], "left_anti").select(*rows.columns)


def _add_ids(rows: DataFrame, ids: str) -> None:
    keyed = rows.select("project", "id").where("id IS NOT NULL").withColumn("bucket", id_bucket(F.col("id")))
    keyed.hint("rebalance", "project", "bucket").write.mode("append").partitionBy("project", "bucket").parquet(ids)


def _index(rows: DataFrame, ids: str) -> None:
    """Put the ids of stored rows in the index, unless they are there."""
    _add_ids(_unknown(rows.select("project", "id").distinct(), ids), ids)


def _there(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def _delete(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.delete(where, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to this path has come to its end."""
    return _there(spark, f"{path}/_SUCCESS")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def drop_partition(spark: SparkSession, path: str, project: str, day: datetime.date | None = None) -> bool:
    """Delete a project's partition of a stored table, or one day of it, without reading a row; whether it was there."""
    where, store = _files(spark, f"{path}/project={project}" + (f"/day={day}" if day else ""))
    return store.delete(where, True)


def is_free(spark: SparkSession, path: str, old: str, new: str) -> bool:
    """Whether a project's partition can take another alias: it is not there, or the new alias is free."""
    where, store = _files(spark, f"{path}/project={old}")
    return not store.exists(where) or not store.exists(_files(spark, f"{path}/project={new}")[0])


def move_project(spark: SparkSession, path: str, old: str, new: str) -> bool:
    """Give a project's partition another alias, without reading a row; whether it was there. The new one must be free."""
    if not is_free(spark, path, old, new):
        raise ValueError(f"alias {new} is taken")
    where, store = _files(spark, f"{path}/project={old}")
    return store.exists(where) and store.rename(where, _files(spark, f"{path}/project={new}")[0])


def stored_days(spark: SparkSession, path: str, project: str) -> list[datetime.date]:
    """Days of a project's partitions, from the folders' names."""
    where, store = _files(spark, f"{path}/project={project}")
    names = [x.getPath().getName() for x in store.listStatus(where)] if store.exists(where) else []
    return [datetime.date.fromisoformat(name[4:]) for name in names if name.startswith("day=")]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors see (spark.checkpoint.dir); a local one where all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{folder or 'file://' + tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


def replace_days(rows: DataFrame, path: str) -> None:
    """Replace exactly the (project, day) partitions that are in `rows`; no rows change nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTITION).parquet(path)


def read_log(spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], before: int | None = None) -> DataFrame:
    """One row for each key of what a stream wrote, a folder for each batch; `merge` brings rows of one key together.

    A batch that ran twice has replaced its own folder, so it counts once.
    Batches that `fold_log` has brought together are read from its last
    finished table, the others (those `before` a number) from their folders.
    """
    folded = _numbers(spark, f"{path}_folded", "below", finished=True)
    below = max(folded, default=0)
    batches = [n for n in _numbers(spark, path, "batch") if n >= below and (before is None or n < before)]
    paths = [f"{path}_folded/below={below}"] * bool(folded) + [f"{path}/batch={n}" for n in batches]
    return merge(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema))


def fold_log(spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame], before: int) -> None:
    """Bring the batches before a number together in one table; what the table before it had brought together goes.

    It may stop anywhere: a table that is not finished is not read, and the next
    call drops what this one has left. Batches from `before` on stay, as they
    may run again, and the last table and its batches stay until the next call,
    so that no reader loses a file.
    """
    done = max((n for n in _numbers(spark, f"{path}_folded", "below", finished=True) if n < before), default=0)
    target = f"{path}_folded/below={before}"
    if not _there(spark, f"{target}/_SUCCESS"):
        read_log(spark, path, schema, merge, before).write.mode("overwrite").parquet(target)
    for folder, key in ((path, "batch"), (f"{path}_folded", "below")):
        for n in _numbers(spark, folder, key):
            if n < done:
                _delete(spark, f"{folder}/{key}={n}")


def _numbers(spark: SparkSession, path: str, key: str, finished: bool = False) -> list[int]:
    """The numbers in the names of a table's folders, in order."""
    where, files = _files(spark, path)
    names = [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []
    found = sorted(int(name[len(key) + 1 :]) for name in names if name.startswith(f"{key}="))
    return [n for n in found if not finished or _there(spark, f"{path}/{key}={n}/_SUCCESS")]


def bring_together(spark: SparkSession, path: str, projects: list[str], schema: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Put what `merge` makes of the named projects' parts of a log in their place; other projects' files stay as they are.

    The new files are written first and the old ones deleted after. Where it
    stops in between both are there, so what `merge` makes of a log beside its
    own result must be that result; rows it left out go with the next call.
    """
    log = spark.read.option("basePath", path).schema(schema).parquet(*[f"{path}/project={project}" for project in projects])
    old = log.inputFiles()
    merge(log).select(*log.columns).hint("rebalance", "project").write.mode("append").partitionBy("project").parquet(path)
    for name in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, False)


def read_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last finished version of a small table; empty if there is none."""
    done = _numbers(spark, path, "version", finished=True)
    return spark.read.schema(schema).parquet(f"{path}/version={done[-1]}") if done else spark.createDataFrame([], schema)


def write_version(rows: DataFrame, path: str) -> None:
    """Write a version that readers take as soon as it is finished."""
    number = max(_numbers(rows.sparkSession, path, "version"), default=0) + 1
    rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={number}")


def drop_old_versions(spark: SparkSession, path: str) -> None:
    """Delete every version but the last finished one."""
    done = _numbers(spark, path, "version", finished=True)
    for number in _numbers(spark, path, "version"):
        if done and number != done[-1]:
            _delete(spark, f"{path}/version={number}")


def rewrite(rows: DataFrame, path: str, partition: list[str] | None = None) -> str:
    """Write a table's new version beside the old one and give its path; a reader of the old one is not disturbed."""
    writer = rows.write.mode("errorifexists")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    return path
