"""Versioned tables without a table format: releases are directories, and a pointer names the current one."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import dataset_hash, release_id
from ..lineage import consecutive, cut


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of the same keys; twice the same gives the same. Of repeated new rows one is kept."""
    return current.join(new.select(keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys))


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of re-imported parents are replaced as a whole, also by none."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def get_or_create(existing: DataFrame, wanted: DataFrame, name: str, fill: str | None = None) -> DataFrame:
    """(id, name, ...) of a dimension with new names added behind the largest id; a blank `fill` is filled from `wanted`."""
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = wanted.where(F.coalesce(F.col(name), F.lit("")) != "").groupBy(name).agg(*([F.max(fill).alias(fill)] if fill else [F.count("*").alias("_n")]))
    out = existing
    if fill:
        got = new.select(name, F.col(fill).alias("_fill"))
        out = existing.join(got, name, "left").withColumn(fill, F.coalesce(F.nullif(fill, F.lit("")), F.col("_fill"))).select(existing.columns)
    fresh = consecutive(new.join(existing.select(name), name, "left_anti"), name, after=last)
    return out.unionByName(fresh.select(existing.columns))


def drafts(records: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Records with the newest edit as draft; extracted values stay as they are."""
    last = edits.groupBy(key).agg(F.max_by(F.struct("draft", "status"), "edited_at").alias("last"))
    rows = records.join(last, key, "left")
    return rows.withColumn("draft", F.coalesce("last.draft", "draft")).withColumn("status", F.coalesce("last.status", "status")).drop("last")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't done yet: a stage that is run again does the rest."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def flat_parameters(config: dict, prefix: str = "") -> list[tuple[str, str, str]]:
    """(key, value, type) of a nested configuration, keys joined by dots and sorted."""
    out = []
    for k in sorted(config):
        name, value = f"{prefix}{k}", config[k]
        out += flat_parameters(value, f"{name}.") if isinstance(value, dict) else [(name, json.dumps(value), type(value).__name__)]
    return out


class Moved(Exception):
    """The release that a publication builds on is no longer the current one."""


class Releases:
    """A directory of releases: `publish` writes tables and checks them before the pointer moves."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def publish(self, tables: dict[str, DataFrame], checks: Iterable = (), base: str | None = None) -> str:
        """Writes all tables under an id made of their hashes; each check gets the tables and raises to refuse.

        `base` is the release that the tables were made from, by default the current one. The pointer behind it is taken
        by renaming a finished file to a name that must not exist, so of two that build on the same base the second
        raises `Moved`, whatever comes between. A crash before that leaves the current release as it is.
        """
        number, current = self._last()
        if base is not None and base != current:
            raise Moved(f"the current release is {current}, not {base}")
        tables = {name: cut(df) for name, df in tables.items()}  # hashed and written from the same rows
        hashes = {name: dataset_hash(df).first()[0] for name, df in tables.items()}
        release = release_id(hashes)
        if release not in self._named():
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{self.root}/release={release}/{name}")
        stored = self.tables(release, tables)
        for check in checks:
            check(stored)
        rows = [(release, name, h) for name, h in hashes.items()]
        self.spark.createDataFrame(rows, "release string, name string, hash string").coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest={release}")
        self._point(number + 1, release)
        return release

    def _point(self, number: int, release: str) -> None:
        staged, _ = self._path(f"staged/{uuid.uuid4().hex}")
        self.spark.createDataFrame([(number, release)], "number long, release string").coalesce(1).write.json(staged.toString())
        path, fs = self._path(f"pointers/{number}")
        fs.mkdirs(path.getParent())
        jvm, context = self.spark.sparkContext._jvm, self.spark.sparkContext
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), context._jsc.hadoopConfiguration())
        options = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(staged, path, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception.toString()):
                raise
            raise Moved(f"pointer {number} was taken by {self.current()}") from None

    def _pointers(self) -> DataFrame | None:
        path, fs = self._path("pointers")
        if not fs.exists(path) or not len(fs.listStatus(path)):
            return None
        return self.spark.read.schema("number long, release string").json(f"{self.root}/pointers/*")

    def _last(self) -> tuple[int, str | None]:
        rows = self._pointers()
        row = rows.orderBy(F.desc("number")).first() if rows is not None else None
        return (row["number"], row["release"]) if row else (0, None)

    def _named(self) -> set[str]:
        """Releases that a pointer names: one for each publication."""
        rows = self._pointers()
        return {r["release"] for r in rows.select("release").distinct().collect()} if rows is not None else set()

    def current(self) -> str | None:
        """The release of the last pointer. Pointers appear whole and are never deleted."""
        return self._last()[1]

    def clean(self, older_than_seconds: int = 7 * 86_400) -> list[str]:
        """Deletes releases that no pointer names, and what crashes have left, if nothing in them is newer than that; returns
        their names. The time must be longer than any publication takes."""
        named, gone = self._named(), []
        path, fs = self._path("")
        limit = time.time() * 1000 - older_than_seconds * 1000
        newest = lambda p: max([p.getModificationTime(), *(newest(x) for x in fs.listStatus(p.getPath()) if p.isDirectory() and x.getPath() != p.getPath())])
        for entry in fs.listStatus(path) if fs.exists(path) else ():
            name = entry.getPath().getName()
            unused = name == "staged" or name.partition("=")[0] in ("release", "manifest") and name.partition("=")[2] not in named
            if unused and newest(entry) <= limit:
                fs.delete(entry.getPath(), True)
                gone.append(name)
        return sorted(gone)

    def tables(self, release: str, names: Iterable[str]) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(f"{self.root}/release={release}/{n}") for n in names}

    def compare(self, old: str, new: str) -> DataFrame:
        """(name, change) of tables: added, removed, changed or same."""
        a, b = (self.spark.read.json(f"{self.root}/manifest={x}").select("name", F.col("hash").alias(n)) for x, n in ((old, "a"), (new, "b")))
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
        return a.join(b, "name", "full").select("name", change.alias("change"))
