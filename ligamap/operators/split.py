"""Splitting a contig at a bin: the bin goes, two contigs take the place of one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ligamap.operators.layout import spans
from ligamap.operators.scaffolds import ungroup
from ligamap.schema import Assembly


def split(a: Assembly, position_bp: int) -> Assembly:
    """Split the contig at ``position_bp`` of the layout. Nothing happens outside of it.

    The parts keep the direction; bins of the finest resolution lose the one at the position, coarser ones are shared out.
    """
    hit = spans(a).where((F.col("s") <= position_bp) & (F.col("e") > position_bp)).first()
    if hit is None:
        return a
    res = {r["res_order"]: r["bp_resolution"] for r in a.resolution.collect()}
    old = a.contig.where(F.col("contig_id") == hit["contig_id"]).first()
    top = a.contig.agg(F.coalesce(F.max("contig_id"), F.lit(0))).first()[0]
    finest, d, whole = res[1], position_bp - hit["s"], old["length_bp"]
    length = {1: d, 2: whole - d - finest}
    turned = "" if hit["dir"] == 1 else "_reversed"
    name = {1: f"{old['name']}{turned}_0_{d}", 2: f"{old['name']}{turned}_{length[2]}_{whole}"}
    source = {1: old["source_offset"] + (0 if hit["dir"] == 1 else finest), 2: old["source_offset"] + (finest if hit["dir"] == 1 else 0)}
    spark = a.contig.sparkSession
    parts = spark.createDataFrame([(top + n, name[n], length[n], old["source_name"], source[n]) for n in (1, 2)], "contig_id int, name string, length_bp bigint, source_name string, source_offset int")
    other = F.col("contig_id") != hit["contig_id"]
    a = ungroup(a, hit["s"], hit["s"] + 1)

    # Bins of the old contig that each part holds, counted along the contig itself: [first, last).
    bins = a.contig_res.where(~other)
    cut = F.when(F.col("res_order") == 0, F.lit(d)).otherwise(F.expr(f"{d} div greatest(bp, 1)"))
    sized = bins.join(F.broadcast(a.resolution.select("res_order", F.col("bp_resolution").alias("bp"))), "res_order").withColumn("cut", cut)
    lost = F.when(F.col("res_order") == 0, finest).when(F.col("res_order") == 1, 1).otherwise(0)
    forward = hit["dir"] == 1
    held = sized.select(
        "res_order",
        "bp",
        F.explode(
            F.array(
                F.struct(F.lit(top + 1).alias("contig_id"), F.lit(length[1]).alias("bps"), *_run(F.lit(0), F.col("cut"), forward)),
                F.struct(F.lit(top + 2).alias("contig_id"), F.lit(length[2]).alias("bps"), *_run(F.col("cut") + lost, F.col("length_bins"), forward)),
            )
        ).alias("x"),
    ).select("res_order", "bp", "x.*")
    shown = F.when((F.col("res_order") == 0) | (F.col("bps") >= F.col("bp")), 1).otherwise(0)
    new_res = held.select("res_order", "contig_id", (F.col("last") - F.col("first")).alias("length_bins"), shown.alias("shown"))
    pieces = a.contig_atu.where(~other).drop("contig_id", "seq").join(held.select("res_order", "contig_id", "first", "last"), "res_order")
    n = F.col("end") - F.col("start")
    x0, x1 = F.greatest(F.col("first") - F.col("off"), F.lit(0)), F.least(F.col("last") - F.col("off"), n)
    pieces = pieces.withColumn("x0", x0).withColumn("x1", x1).where("x0 < x1")
    straight = F.col("dir") == 1
    new_atu = pieces.select(
        "res_order",
        "contig_id",
        (F.row_number().over(Window.partitionBy("res_order", "contig_id").orderBy("off")) - 1).alias("seq"),
        "stripe_id",
        F.when(straight, F.col("start") + F.col("x0")).otherwise(F.col("end") - F.col("x1")).cast("int").alias("start"),
        F.when(straight, F.col("start") + F.col("x1")).otherwise(F.col("end") - F.col("x0")).cast("int").alias("end"),
        "dir",
        (F.col("off") + F.col("x0") - F.col("first")).cast("bigint").alias("off"),
    )
    # The parts take the contig's place and the next one.
    rows = F.when(other, F.array(F.struct((F.col("ord") + F.when(F.col("ord") > hit["ord"], 1).otherwise(0)).alias("ord"), "contig_id"))).otherwise(F.array(*(F.struct((F.col("ord") + n - 1).alias("ord"), F.lit(top + n).alias("contig_id")) for n in (1, 2))))
    # The scaffolds right of the contig come nearer by the bin that is gone.
    moved = F.when(F.col("start_bp") >= hit["e"], finest).otherwise(0)
    scaffold = a.scaffold.select("scaffold_id", "name", "spacer", (F.col("start_bp") - moved).alias("start_bp"), (F.col("end_bp") - moved).alias("end_bp"))
    return a.with_(
        contig=a.contig.where(other).unionByName(parts),
        contig_res=a.contig_res.where(other).unionByName(new_res),
        contig_atu=a.contig_atu.where(other).unionByName(new_atu),
        layout=a.layout.select(F.explode(rows).alias("x"), "dir").select("x.ord", "x.contig_id", "dir"),
        scaffold=scaffold,
    )


def _run(first, last, forward: bool) -> list:
    """Offsets of the layout turned to offsets of the contig."""
    a, b = (first, last) if forward else (F.col("length_bins") - last, F.col("length_bins") - first)
    return [a.cast("bigint").alias("first"), b.cast("bigint").alias("last")]


