"""Files below a data directory, by suffix."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes of each kind of file.
KINDS = {"all": ("",), "agp": (".agp",), "fasta": (".fasta",), "coolers": (".cool", ".mcool")}


def of_kind(path: Column, kind: str) -> Column:
    """Whether a path has a suffix of the kind, in any case."""
    wanted = F.lit(False)
    for end in KINDS[kind]:
        wanted |= F.lower(path).endswith(end)
    return wanted


def listed(spark: SparkSession, root: str, kind: str = "all") -> DataFrame:
    """(path): files of a kind below ``root``, relative to it, at any depth; suffixes in any case. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    start = found.select(F.expr("regexp_replace(path, '^[a-z0-9]+:/+', '/')").alias("path"))
    base = root.split(":", 1)[1] if ":" in root.split("/", 1)[0] else root
    base = "/" + base.strip("/") + "/"
    return start.select(F.expr(f"substring(path, {len(base) + 1})").alias("path")).where(of_kind(F.col("path"), kind))


def within(root: str, name: str) -> str:
    """``name`` below ``root``; anything that leads out of it is refused."""
    base = Path(root).resolve()
    path = (base / name).resolve()
    if not path.is_relative_to(base):
        raise ValueError(f"{name} isn't below the data directory")
    return str(path)
