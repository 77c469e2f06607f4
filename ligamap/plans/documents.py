"""JSON answers about an assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligamap.schema import Assembly


def contig_maps(a: Assembly) -> DataFrame:
    """(contig_id, bins, shown): each contig's length and presence by resolution, as maps."""
    at = a.contig_res.where("res_order > 0").join(F.broadcast(a.resolution.select("res_order", "bp_resolution")), "res_order")

    def by_bp(column: str):
        return F.map_from_entries(F.sort_array(F.collect_list(F.struct("bp_resolution", column))))

    return at.groupBy("contig_id").agg(by_bp("length_bins").alias("bins"), by_bp("shown").alias("shown"))


def contig_records(a: Assembly) -> DataFrame:
    """(ord, json) of each contig of the layout."""
    met = a.layout.join(a.contig, "contig_id").join(contig_maps(a), "contig_id")
    fields = F.struct(
        F.col("contig_id").alias("contigId"), F.col("name").alias("contigName"), F.col("dir").alias("contigDirection"), F.col("length_bp").alias("contigLengthBp"), F.col("bins").alias("contigLengthBins"), F.col("shown").alias("contigPresenceAtResolution")
    )
    return met.select("ord", F.to_json(fields).alias("json"))


def scaffold_records(a: Assembly) -> DataFrame:
    """(start_bp, json) of each scaffold."""
    fields = F.struct(F.col("scaffold_id").alias("scaffoldId"), F.col("name").alias("scaffoldName"), F.col("spacer").alias("spacerLength"), F.struct(F.col("start_bp").alias("startBP"), F.col("end_bp").alias("endBP")).alias("scaffoldBordersBP"))
    return a.scaffold.select("start_bp", F.to_json(fields).alias("json"))


def assembly(a: Assembly) -> DataFrame:
    """(kind, place, json): the records of contigs and scaffolds in order of place; a client concatenates them."""
    return contig_records(a).select(F.lit("contig").alias("kind"), F.col("ord").cast("bigint").alias("place"), "json").unionByName(scaffold_records(a).select(F.lit("scaffold").alias("kind"), F.col("start_bp").alias("place"), "json"))


def opened(a: Assembly) -> DataFrame:
    """(json): resolutions from the coarsest without the base pairs, their pixel ratios, the tile edge and the sizes of the map."""
    sizes = a.contig_res.where("res_order > 0").groupBy("res_order").agg(F.sum("length_bins").alias("bins"))
    at = a.resolution.join(sizes, "res_order")
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("bp_resolution", "bins"))))
    listed = at.agg(rows.alias("x"), F.min("bp_resolution").alias("least"))
    ratio = F.transform("x", lambda r: r["bp_resolution"] / F.col("least"))
    return listed.select(F.to_json(F.struct(F.col("x.bp_resolution").alias("resolutions"), ratio.alias("pixelResolutions"), F.lit(a.edge).alias("tileSize"), F.col("x.bins").alias("matrixSizesBins"))).alias("json"))
