"""Lengths, resolutions and unit conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligamap.schema import Assembly


def clamp(x: Column, lowest: Column, highest: Column) -> Column:
    return F.greatest(lowest, F.least(x, highest))


def inverse(direction: str) -> Column:
    return 1 - F.col(direction)


def scaled(resolution: DataFrame, finest: int) -> DataFrame:
    """Add the scaling coefficients: 1 / q squared and 1 / q with q the whole ratio to the finest resolution; 1 for the base pairs and the finest."""
    q = F.expr(f"bp_resolution div {finest}").cast("double")
    coarse = F.col("res_order") > 1
    return resolution.select("res_order", "bp_resolution", F.when(coarse, 1 / (q * q)).otherwise(1.0).alias("quad_scale"), F.when(coarse, 1 / q).otherwise(1.0).alias("lin_scale"))


def discovered(names: DataFrame) -> DataFrame:
    """Group names -> resolutions: those that are numbers, ascending after the 0 of base pairs, with their order."""
    from pyspark.sql import Window

    numbers = names.where(F.col("name").rlike("^[0-9]+$")).select(F.col("name").cast("bigint").alias("bp_resolution")).where("bp_resolution > 0").distinct()
    every = numbers.union(names.sparkSession.range(1).select(F.lit(0).cast("bigint")))
    return every.select((F.row_number().over(Window.orderBy("bp_resolution")) - 1).alias("res_order"), "bp_resolution")


def at_least(resolution: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (requested_bp) -> res_order of the first resolution that is no finer; 0 below 1, null above the coarsest."""
    met = wanted.join(F.broadcast(resolution.select("res_order", "bp_resolution")), F.col("bp_resolution") >= F.col("requested_bp"), "left")
    found = met.groupBy("requested_bp").agg(F.min("res_order").alias("res_order"))
    return found.select("requested_bp", F.when(F.col("requested_bp") < 1, 0).otherwise(F.col("res_order")).alias("res_order"))


def level_to_order(level: int, n_resolutions: int) -> int:
    """Level 1 is the coarsest resolution; ``n_resolutions`` counts the base pairs."""
    if not 1 <= level < n_resolutions:
        raise ValueError(f"level must be between 1 and {n_resolutions - 1}")
    return n_resolutions - level


def lengths(a: Assembly) -> DataFrame:
    """(contig_id, res_order, bp, bins, pixels): bins count hidden contigs, pixels don't."""
    both = a.contig_res.join(a.contig.select("contig_id", F.col("length_bp").alias("bp")), "contig_id")
    return both.select("contig_id", "res_order", "bp", F.col("length_bins").alias("bins"), F.when(F.col("shown") == 1, F.col("length_bins")).otherwise(0).alias("pixels"))


def largest_edge(edge: str = "edge", default: int = 256) -> Column:
    """An aggregate: the largest edge that is named, or the default."""
    return F.coalesce(F.max(edge), F.lit(default))


def block_edge(edges: DataFrame, default: int = 256) -> int:
    """The largest edge that a resolution names (column ``edge``), or the default."""
    return edges.agg(largest_edge(default=default)).first()[0]
