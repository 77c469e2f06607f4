"""Committed versions of a dataset: an append-only log of changes beside its tables, with snapshots at intervals.

A version is a folder of changed rows and one entry of the log. The folder is written first, under a name of its own; the
entry is then put in place by a step that fails if another writer's entry of that number is there. So a version is seen
whole or not at all, and of two writers one gets a Conflict. Version 0 is the dataset's own tables; contacts, weights and
resolutions never change.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligamap.schema import SCHEMAS, Assembly
from ligamap.sources import container

#: What edits change, with the columns that tell the rows apart.
KEYS = {"contig": ["contig_id"], "contig_res": ["res_order", "contig_id"], "contig_atu": ["res_order", "contig_id", "seq"], "layout": ["contig_id"], "scaffold": ["scaffold_id", "start_bp"]}

#: A version of which the number is a multiple holds all rows, so that opening one reads at most so many folders.
SNAPSHOT_EVERY = 16

ENTRY = "version bigint, folder string, snapshot boolean, frames array<string>, scaffold_counter int, said string"


class Conflict(Exception):
    """Another writer has committed a version since this one was opened."""


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


def log(spark: SparkSession, path: str) -> DataFrame:
    """(version, folder, snapshot, frames, scaffold_counter, said) of each committed version; version 0 has no entry."""
    try:
        return spark.read.schema(ENTRY).json(f"{path}/versions/log")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ENTRY)


def newest(spark: SparkSession, path: str) -> int:
    return log(spark, path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _put(spark: SparkSession, target: str, content: str) -> bool:
    """Write a file that isn't there yet, whole, or say that it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    hidden = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = system.create(hidden, False)
    out.write(bytearray(content.encode()))
    out.close()
    try:
        return _linked(system, hidden, path) if system.getScheme() == "file" else _renamed(spark, hidden, path)
    finally:
        system.delete(hidden, False)


def _linked(system, hidden, path) -> bool:
    """A local file system's rename would take the place of another file; a link doesn't."""
    source, target = (unquote(urlparse(system.makeQualified(p).toUri().toString()).path) for p in (hidden, path))
    try:
        os.link(source, target)
    except FileExistsError:
        return False
    return True


def _renamed(spark: SparkSession, hidden, path) -> bool:
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kinds, 1)
    options[0] = kinds.NONE
    try:
        context.rename(hidden, path, options)
    except Exception as e:  # py4j has one class for all of Java's
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True


def changes(name: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that ``old`` hasn't, and with ``gone`` the keys that ``new`` hasn't; one join on the keys."""
    keys, columns = KEYS[name], _columns(name)
    values = [c for c in columns if c not in keys]
    sides = [frame.select(*keys, F.struct(*values).alias(side)) for frame, side in ((old, "old"), (new, "new"))]
    met = sides[1].join(sides[0], keys, "full").where(~F.col("new").eqNullSafe(F.col("old")))
    return met.select(*keys, *(F.col(f"new.{c}").alias(c) for c in values), F.col("new").isNull().alias("gone"))


def commit(a: Assembly, base: Assembly, path: str, version: int, said: str = "") -> int:
    """Commit ``a``, made from ``base``, which was opened at ``version`` of the dataset at ``path``; the new version's number.

    Only frames that an edit replaced are compared. Raises Conflict, and leaves the log as it is, if the dataset has a
    newer version.
    """
    spark, number = a.layout.sparkSession, version + 1
    if newest(spark, path) != version:
        raise Conflict(f"the dataset has a version after {version}")
    folder, snapshot = uuid.uuid4().hex, number % SNAPSHOT_EVERY == 0
    frames = [name for name in KEYS if snapshot or getattr(a, name) is not getattr(base, name)]
    for name in frames:
        rows = getattr(a, name).select(*_columns(name)) if snapshot else changes(name, getattr(base, name), getattr(a, name))
        rows.write.parquet(f"{path}/versions/data/{folder}/{name}")
    entry = {"version": number, "folder": folder, "snapshot": snapshot, "frames": frames, "scaffold_counter": a.scaffold_counter, "said": said}
    if not _put(spark, f"{path}/versions/log/{number:010d}.json", json.dumps(entry) + "\n"):
        raise Conflict(f"another writer has committed version {number}")
    return number


def checkout(spark: SparkSession, path: str, version: int | None = None) -> Assembly:
    """The dataset as of ``version`` (the newest if None): the last snapshot up to it, and of each key the last change since."""
    a = container.load(spark, path)
    entries = log(spark, path)
    if version is not None:
        entries = entries.where(F.col("version") <= version)
    start = entries.where("snapshot").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    since = entries.where(F.col("version") >= start).orderBy("version").collect()  # at most SNAPSHOT_EVERY
    if version is not None and version != (since[-1]["version"] if since else 0):
        raise ValueError(f"there is no version {version}")
    if not since:
        return a
    frames = {}
    for name, keys in KEYS.items():
        columns = _columns(name)
        full = spark.read.schema(SCHEMAS[name]).parquet(f"{path}/versions/data/{since[0]['folder']}/{name}") if start else getattr(a, name)
        later = [e for e in since if e["version"] > start and name in e["frames"]]
        rows = full.select(*columns).withColumns({"gone": F.lit(False), "version": F.lit(start).cast("bigint")})
        for e in later:
            change = spark.read.schema(f"{SCHEMAS[name]}, gone boolean").parquet(f"{path}/versions/data/{e['folder']}/{name}")
            rows = rows.unionByName(change.withColumn("version", F.lit(e["version"])))
        if later:
            values = [c for c in columns if c not in keys]
            last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values, "gone"), "version").alias("last")).where("not last.gone")
            frames[name] = last.select(*(F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in columns))
        elif start:
            frames[name] = full.select(*columns)
    return a.with_(**frames, scaffold_counter=since[-1]["scaffold_counter"])
