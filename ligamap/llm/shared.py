"""Scratch tables in the cluster's shared folder, word columns and distributed prefix sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, for every operator that counts or compares words: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Upper limit of the salts of one key; beyond it the rows of a salt grow, which a window sorts and spills.
MOST_SALTS = 65536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset in local mode, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        own = spark.sparkContext.getCheckpointDir()
        named = own.rsplit("/", 1)[0] if own else None
    if not named:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='ligamap-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage and survives lost executors. The table stays until ``clean_scratch`` or the cluster removes it,
    because frames built on it are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ligamap-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean_scratch(spark: SparkSession) -> None:
    """Remove the scratch tables of this application; frames built on them can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/ligamap-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def carried(docs: DataFrame, **own: Column) -> DataFrame:
    """``docs`` as one struct ``row`` beside the columns ``own``, so that no name of the input can clash with an operator's; ``row.*`` gives it back."""
    return docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row"), *(c.alias(n) for n, c in own.items()))


#: Rows that a Python worker turns into objects at a time.
SLICE = 1024


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, SLICE at a time, so that a worker holds few texts as objects and gives its results away early."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


#: A key with at least one in so many of the rows is hot; there are at most that many hot keys, which bounds what is broadcast.
HOT = 1000


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, written and unique in ``key``, where ``n`` says how many rows hold the key; ``n`` is dropped.

    Rows of hot keys meet a broadcast of at most HOT rows where they lie, so that no key's rows meet in one task; the rest
    is joined by a shuffle. ``rows`` is read twice: pass a written table.
    """
    total = rows.count()
    is_hot = F.col(n) * HOT >= total
    hot, cold = keyed.where(is_hot).drop(n), keyed.where(~is_hot).drop(n)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def n_words(text: str | Column) -> Column:
    """Words of a text as BIGINT; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def salts_for(rows: int, to_a_salt: int = 256) -> int:
    """Salts that leave about ``to_a_salt`` rows of the largest key in each, or more beyond MOST_SALTS."""
    return max(1, min(MOST_SALTS, -(-rows // to_a_salt)))


def with_prefix(df: DataFrame, key: str, order: list[str], value: Column, salts: int, into: str) -> DataFrame:
    """Add ``into``: the sum of ``value`` over the rows of the same key that come before, in a fixed pseudorandom order.

    The rows of a key are dealt to salts by a hash of ``order``; a salt's rows are summed in a window of their own and
    the salts' totals (at most MOST_SALTS a key) in another, so no key meets in one task. Null keys form a key.
    Rows that agree in all of ``order`` may swap places, which changes no result that depends on these columns alone.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts))).withColumn("_value", value)
    totals = salted.groupBy(key, "_salt").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(key).alias("_key"), F.col("_salt").alias("_salt2"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = salted.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    joined = summed.join(totals, summed[key].eqNullSafe(totals["_key"]) & (summed["_salt"] == totals["_salt2"]))
    return joined.withColumn(into, (F.col("_base") + F.col("_inside")).cast("long")).drop("_salt", "_salt2", "_key", "_value", "_base", "_inside")
