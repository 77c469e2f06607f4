"""An assembly as a dataset of Parquet tables in one directory."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligamap.operators.matrix import unique_cells
from ligamap.schema import SCHEMAS, Assembly

FRAMES = ("resolution", "contig", "contig_res", "contig_atu", "stripe_weight", "contact", "layout", "scaffold")


def scratch(spark: SparkSession) -> str:
    """A new folder for a dataset, below spark.checkpoint.dir, which all executors share; a local one only in local mode where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or 'file://' + tempfile.mkdtemp(prefix='ligamap-')).rstrip('/')}/dataset-{uuid.uuid4().hex}"


def kept(frame: DataFrame) -> DataFrame:
    """``frame`` as written once to a new scratch folder, for several readers."""
    path = scratch(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def save(a: Assembly, path: str) -> None:
    """Write the tables; contacts by resolution, rows of a block next to each other so that row groups can be skipped."""
    for name in FRAMES:
        frame = getattr(a, name)
        if name == "contact":
            keyed = frame.repartitionByRange("res_order", "row_stripe", "col_stripe").sortWithinPartitions("res_order", "row_stripe", "col_stripe", "r")
            keyed.write.partitionBy("res_order").parquet(f"{path}/{name}")
        else:
            frame.write.parquet(f"{path}/{name}")
    a.contig.sparkSession.createDataFrame([(a.edge, a.scaffold_counter)], "edge int, scaffold_counter int").write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str, check: bool = False) -> Assembly:
    """Open a dataset lazily with fixed schemas; only the one row about it is read at once. ``check`` looks for cells stored twice."""
    frames = {name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}") for name in FRAMES}
    about = spark.read.schema("edge int, scaffold_counter int").parquet(f"{path}/about").first()
    if check and (twice := unique_cells(frames["contact"]).first()):
        raise ValueError(f"a cell is stored more than once: {twice.asDict()}")
    return Assembly(**frames, edge=about["edge"], scaffold_counter=about["scaffold_counter"])


def from_vectors(spark: SparkSession, stripes, contact, edge: int = 256):
    """Stripes (res_order, stripe_id, bin_weights array) and COO cells -> the tables stripe_weight and contact.

    Cells of the lower triangle are turned to the upper one.
    """
    weight = stripes.select("res_order", "stripe_id", F.posexplode("bin_weights").alias("off", "weight"))
    turned = (F.col("row_stripe") > F.col("col_stripe")) | ((F.col("row_stripe") == F.col("col_stripe")) & (F.col("r") > F.col("c")))
    pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    upper = contact.select("res_order", pick("row_stripe", "col_stripe", "row_stripe"), pick("col_stripe", "row_stripe", "col_stripe"), pick("r", "c", "r"), pick("c", "r", "c"), "v")
    return weight, upper.distinct()
