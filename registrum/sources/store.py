"""Tables on plain Parquet with versions: upserts, replaced partitions, snapshots with retention. Each writes beside what it reads, never over it, and
counts from the moment that its manifest is there."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from registrum.operators.linkage import merge
from registrum.session import staged


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


#: Where a table's manifests are, and the column that names a folder's partition while it is written.
MANIFESTS, PART = "_manifests", "__part"


class Conflict(RuntimeError):
    """Somebody else committed a version since the one that a write was made from."""


def _fs(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path
    return made, made(path).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> dict[int, dict]:
    """The whole manifests of a table by number. One that a dead writer left cut short counts for nothing."""
    made, fs = _fs(spark, path)
    folder = made(f"{path.rstrip('/')}/{MANIFESTS}")
    if not fs.exists(folder):
        return {}
    out = {}
    for status in fs.listStatus(folder):
        stream = fs.open(status.getPath())
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        with contextlib.suppress(ValueError):
            out[int(status.getPath().getName())] = json.loads(text)
    return out


def has(spark: SparkSession, path: str) -> bool:
    return bool(versions(spark, path))


def read(spark: SparkSession, path: str, version: int | None = None, parts: list[str] | None = None) -> DataFrame:
    """The table as of a version (none given: the newest), or only the given partitions of it. A plan reads the folders of this version whatever is
    committed later, as long as it is among those kept."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no table at {path}")
    manifest = known[max(known) if version is None else version]
    schema = StructType.fromJson(manifest["schema"])
    folders = [f"{path.rstrip('/')}/{e['folder']}" for e in manifest["entries"] if parts is None or e["part"] in parts]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _written(df: DataFrame, path: str, column: str | None) -> list[dict]:
    """df as new folders beside the table's, which no manifest names yet: one, or one for every value of the column."""
    folder = f"data-{uuid.uuid4().hex}"
    if column is None:
        df.write.parquet(f"{path.rstrip('/')}/{folder}")
        return [{"folder": folder, "part": None}]
    df.withColumn(PART, F.col(column).cast("string")).write.partitionBy(PART).parquet(f"{path.rstrip('/')}/{folder}")
    made, fs = _fs(df.sparkSession, path)
    names = [s.getPath().getName() for s in fs.listStatus(made(f"{path.rstrip('/')}/{folder}")) if s.isDirectory()]
    return [{"folder": f"{folder}/{n}", "part": unquote(n[len(PART) + 1 :])} for n in names if n.startswith(PART)]


def _merged(old: dict | None, schema: StructType) -> StructType:
    fields = {f.name: f for f in StructType.fromJson(old["schema"]).fields} if old else {}
    for f in schema.fields:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise ValueError(f"{f.name} is {fields[f.name].dataType.simpleString()} in the table, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, f)
    return StructType(list(fields.values()))


def commit(df: DataFrame, path: str, change: Callable[[list[dict], list[dict]], list[dict]], column: str | None = None, base: int | None = None, keep: int = 2, fresh: bool = False) -> int:
    """Writes df and makes it part of a new version, whose number is returned: change(entries before, entries of df) -> entries.

    A version is one manifest that names its folders, created only if no other has its number, so readers see the old table or the new one, on
    stores that can't rename too; a write that dies leaves folders that nothing names. `base`: the version that df was made from; if another came
    since, Conflict is raised and nothing changes. Without it the change is made again on top of what came. fresh: the schema is df's, not
    the table's with df's columns added. All but the newest `keep` versions go, with the folders that only they name."""
    spark = df.sparkSession
    made, fs = _fs(spark, path)
    root = path.rstrip("/")
    entries = _written(df, path, column)
    while True:
        known = versions(spark, path)
        latest = max(known, default=0)
        if base is not None and base != latest:
            raise Conflict(f"{path} is at version {latest}, the write was made from {base}")
        old = known.get(latest)
        schema = df.schema if fresh else _merged(old, df.schema)
        manifest = {"schema": json.loads(schema.json()), "entries": change(old["entries"] if old else [], entries)}
        taken = [int(s.getPath().getName()) for s in fs.listStatus(made(f"{root}/{MANIFESTS}"))] if fs.exists(made(f"{root}/{MANIFESTS}")) else []
        number = max([latest, *taken]) + 1
        try:
            out = fs.create(made(f"{root}/{MANIFESTS}/{number:012d}"), False)
        except Py4JJavaError as error:
            if "Exists" not in error.java_exception.getClass().getName():
                raise
            continue
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        break
    known[number] = manifest
    kept = sorted(known)[-keep:]
    named = {e["folder"] for v in kept for e in known[v]["entries"]}
    for v in set(known) - set(kept):
        for e in known[v]["entries"]:
            if e["folder"] not in named:
                fs.delete(made(f"{root}/{e['folder']}"), True)
        fs.delete(made(f"{root}/{MANIFESTS}/{v:012d}"), False)
    return number


def vacuum(spark: SparkSession, path: str, hours: float = 168.0) -> list[str]:
    """Removes, and returns, folders that no version names and nobody has touched for so long: what writes that died have left."""
    made, fs = _fs(spark, path)
    named = {e["folder"].split("/")[0] for v in versions(spark, path).values() for e in v["entries"]}
    before = (time.time() - hours * 3600) * 1000
    gone = [s.getPath().getName() for s in fs.listStatus(made(path)) if s.getPath().getName().startswith("data-") and s.getModificationTime() <= before]
    gone = [n for n in gone if n not in named]
    for name in gone:
        fs.delete(made(f"{path.rstrip('/')}/{name}"), True)
    return gone


def replace(df: DataFrame, path: str, base: int | None = None) -> int:
    """df in place of all rows; with `base`, only if that is still the newest version."""
    return commit(df, path, lambda old, new: new, base=base, fresh=True)


def append(df: DataFrame, path: str) -> int:
    return commit(df, path, lambda old, new: old + new)


def replace_partitions(df: DataFrame, path: str, column: str) -> int:
    """Rewrites only the partitions that df has. Other writers' partitions stay."""

    def change(old: list[dict], new: list[dict]) -> list[dict]:
        mine = {e["part"] for e in new}
        return [e for e in old if e["part"] not in mine] + new

    return commit(df, path, change, column)


def swap(df: DataFrame, path: str, *partitions: str) -> None:
    """A plain folder without versions: df is written beside it, then the two are renamed, so a failed write leaves the old one whole. On stores without
    renames, and between the two, readers may find none; for folders that nobody reads meanwhile."""
    spark = df.sparkSession
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.partitionBy(*partitions).parquet(new)
    made, fs = _fs(spark, path)
    if fs.exists(made(path)):
        fs.rename(made(path), made(old))
    if not fs.rename(made(new), made(path)):
        raise OSError(f"can't rename {new} to {path}")
    fs.delete(made(old), True)


def upsert(new: DataFrame, path: str, key: str, partial: bool = False, defaults: dict | None = None) -> None:
    """new rows in place of old ones of their key; partial: nulls leave old values as they are."""
    spark = new.sparkSession
    base = max(versions(spark, path), default=0)
    if base:
        old = read(spark, path, base)
        new = merge(old, new, key, defaults) if partial else old.join(new, key, "left_anti").unionByName(new)
    replace(new, path, base)


def ingested(new: DataFrame, path: str, log: str, source: str, ran_at: str) -> int:
    """Upserts a source's entities by uid and logs the run (source, record_count, ran_at); returns the number of records."""
    upsert(new, path, "uid")
    spark = new.sparkSession
    count = read(spark, path).where(F.col("source") == source).count()
    append(spark.createDataFrame([(source, count, ran_at)], "source string, record_count long, ran_at string"), log)
    return count


def append_new(new: DataFrame, path: str, key: list[str]) -> None:
    """Appends rows whose key the table doesn't have; if another writer came first, Conflict is raised."""
    spark = new.sparkSession
    new, base = new.dropDuplicates(key), max(versions(spark, path), default=0)
    if base:
        new = new.join(read(spark, path, base).select(*key), key, "left_anti")
    commit(new, path, lambda old, made: old + made, base=base)


def snapshot(rows: DataFrame, path: str, run_at: str, keep: int = 6) -> None:
    """Adds a run and drops all but the last `keep` runs."""

    def change(old: list[dict], new: list[dict]) -> list[dict]:
        entries = [e for e in old if e["part"] != run_at] + new
        runs = sorted({e["part"] for e in entries})[-keep:]
        return [e for e in entries if e["part"] in runs]

    commit(rows.withColumn("run_at", F.lit(run_at)), path, change, "run_at")


def operators_tables(operators: DataFrame, members: DataFrame, folder: str) -> None:
    """Replaces the operators and their members (operator_id, uid, ...), members first. Which operator an entity is of is a join with the members, not a column of the entity."""
    replace(members, f"{folder.rstrip('/')}/operator_members")
    replace(operators, f"{folder.rstrip('/')}/operators")


def watched_unseen(flags: DataFrame, triage: DataFrame) -> DataFrame:
    """triage (uid, state, note, watched) with every uid watched whose flags (entity_uid, evidence) say that money after its bar can't be seen yet."""
    unseen = F.try_variant_get(F.try_parse_json("evidence"), "$.after_unobservable", "boolean")
    new = flags.where(unseen).select(F.col("entity_uid").alias("uid")).distinct().withColumn("__new", F.lit(True))
    note = F.coalesce("note", F.when(F.col("__new") & F.col("state").isNull() & F.col("watched").isNull(), "watched by rule: the bar is newer than the data"))
    return triage.join(new, "uid", "full").select("uid", "state", note.alias("note"), (F.coalesce("watched", F.lit(False)) | F.coalesce("__new", F.lit(False))).alias("watched"))


def triaged(triage: DataFrame, changes: DataFrame, states: tuple[str, ...] = ("", "new", "reviewing", "reviewed", "escalated", "dismissed")) -> DataFrame:
    """triage with reviewers' changes (uid, state, note, watched) laid over it: nulls leave what is there. A state that isn't one of `states` raises where it is read."""
    known = F.when(F.col("state").isNull() | F.col("state").isin(*states), F.col("state")).otherwise(F.raise_error(F.concat(F.lit("unknown state: "), "state")).cast("string"))
    return merge(triage, changes.withColumn("state", known), "uid", {"watched": False})


def meta(spark: SparkSession, path: str, values: dict[str, str] | None = None) -> dict[str, str]:
    """The table's keys and values, with `values` written over them."""
    rows = dict(read(spark, path).collect()) if has(spark, path) else {}
    if values:
        rows |= values
        replace(spark.createDataFrame(sorted(rows.items()), "key string, value string"), path)
    return rows


def grown(spark: SparkSession, path: str, tracked: DataFrame, key: str, fetched: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of all of tracked (key), of which only those of keys not yet covered are fetched: fetched(missing keys) -> rows.

    path holds `rows` and `covered` (the keys that rows were made for, also those that have none), each in folders `batch=...`. A batch's keys are
    written last, and rows of batches without keys are not read, so a run that dies leaves nothing half known; it is fetched anew."""
    rows, covered = f"{path.rstrip('/')}/rows", f"{path.rstrip('/')}/covered"
    wanted = tracked.select(key).where(F.col(key).isNotNull()).distinct()
    known = spark.read.parquet(covered) if exists(spark, covered) else None
    missing = staged(wanted if known is None else wanted.join(known, key, "left_anti"), "missing")
    if missing.limit(1).count():
        batch = uuid.uuid4().hex
        fetched(missing).write.parquet(f"{rows}/batch={batch}")
        missing.write.parquet(f"{covered}/batch={batch}")
    batches = spark.read.parquet(covered).select("batch").distinct()
    return spark.read.option("basePath", rows).parquet(rows).join(F.broadcast(batches), "batch", "left_semi").drop("batch").join(wanted, key, "left_semi")  # a row a run
