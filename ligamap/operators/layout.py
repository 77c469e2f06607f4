"""Layouts: ordered, oriented contigs. Running sums are taken in ranges of places; windows are never run over contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligamap.functions.units import lengths
from ligamap.operators.ranges import RANGE_ROWS, Places, places, running
from ligamap.schema import Assembly


def splits(a: Assembly) -> list[int]:
    """Splitters of the layout's places, which have no gaps."""
    return list(range(RANGE_ROWS + 1, a.n_contigs + 1, RANGE_ROWS))


def spans(a: Assembly, units: str = "bp", order: int = 0) -> DataFrame:
    """(ord, contig_id, dir, len, s, e): each contig's half-open interval of the layout in ``units`` at ``order``."""
    at = lengths(a).where(F.col("res_order") == order).select("contig_id", F.col(units).alias("len"))
    placed = running(a.layout.join(at, "contig_id"), "ord", {"e": F.col("len")}, splits(a))
    return placed.select("ord", "contig_id", "dir", "len", (F.col("e") - F.col("len")).alias("s"), "e")


def positions(a: Assembly, order: int) -> DataFrame:
    """(ord, contig_id, s_bp, e_bp, s_bins, s_px) in one pass over the layout."""
    at = lengths(a).where(F.col("res_order") == order)
    placed = running(a.layout.join(at, "contig_id"), "ord", {f"e_{u}": F.col(u) for u in ("bp", "bins", "pixels")}, splits(a))
    return placed.select("ord", "contig_id", (F.col("e_bp") - F.col("bp")).alias("s_bp"), "e_bp", (F.col("e_bins") - F.col("bins")).alias("s_bins"), (F.col("e_pixels") - F.col("pixels")).alias("s_px"))


def contig_places(a: Assembly, units: str = "bp", order: int = 0) -> Places:
    """The layout's contigs (ord, contig_id, dir, len, s, e), ready for look-ups of positions and ranges by the million."""
    return places(spans(a, units, order), "ord")


def total(a: Assembly, units: str = "bp", order: int = 0) -> int:
    """Length of the whole layout."""
    at = lengths(a).where(F.col("res_order") == order)
    return a.layout.join(at, "contig_id").agg(F.coalesce(F.sum(units), F.lit(0))).first()[0]


def in_segment(a: int | Column, b: int | Column) -> Column:
    """Contigs of [a, b): those that overlap it; of length 0, those that lie in it."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (a, b))
    return F.when(F.col("len") > 0, (F.col("s") < b) & (F.col("e") > a)).otherwise((F.col("s") >= a) & (F.col("s") < b))


def expose(spanned: DataFrame, a: int, b: int) -> DataFrame:
    """Add ``part``: less, seg or greater. Contigs are never cut."""
    left = F.when(F.col("len") > 0, F.col("e") <= a).otherwise(F.col("s") < a)
    return spanned.withColumn("part", F.when(in_segment(a, b), "seg").when(left, "less").otherwise("greater"))


def split_by_count(layout: DataFrame, k: int) -> DataFrame:
    return layout.withColumn("side", F.when(F.col("ord") <= k, "left").otherwise("right"))


def visible(a: Assembly) -> DataFrame:
    """(res_order, ord, contig_id) of the contigs shown at each order above 0."""
    shown = a.contig_res.where("res_order > 0 and shown = 1").select("res_order", "contig_id")
    return a.layout.join(shown, "contig_id").select("res_order", "ord", "contig_id")


def edge_contigs(a: Assembly) -> DataFrame:
    """First and last contig, and first and last shown one, per order above 0."""
    at = a.layout.join(a.contig_res.where("res_order > 0"), "contig_id")
    seen = F.when(F.col("shown") == 1, F.col("ord"))
    return at.groupBy("res_order").agg(
        F.min_by("contig_id", "ord").alias("first_id"), F.max_by("contig_id", "ord").alias("last_id"), F.min_by("contig_id", seen).alias("first_visible"), F.max_by("contig_id", seen).alias("last_visible")
    )


def append(a: Assembly, contig_id: int, direction: int) -> DataFrame:
    """The layout with a contig at its end."""
    added = a.layout.agg((F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord")).select("ord", F.lit(contig_id).alias("contig_id"), F.lit(direction).alias("dir"))
    return a.layout.unionByName(added)


def segment_of(spanned: DataFrame, a: int, b: int) -> dict:
    """Scalars of the contigs of [a, b): first and last ord, their interval (null if there are none)."""
    return spanned.where(in_segment(a, b)).agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.min("s").alias("s"), F.max("e").alias("e")).first().asDict()


def reversed_layout(a: Assembly, lo: int, hi: int) -> DataFrame:
    """The layout with the places lo to hi mirrored and turned."""
    inside = F.col("ord").between(lo, hi)
    return a.layout.select(F.when(inside, lo + hi - F.col("ord")).otherwise(F.col("ord")).cast("int").alias("ord"), "contig_id", F.when(inside, 1 - F.col("dir")).otherwise(F.col("dir")).alias("dir"))


def moved_layout(a: Assembly, start: int, end: int, target: int) -> DataFrame:
    """The layout with the contigs of [start, end) moved so that they begin at ``target``.

    A target right of the segment counts in the layout that still holds it. Moving everything changes nothing.
    """
    spanned = spans(a)
    seg = segment_of(spanned, start, end)
    if seg["lo"] is None:
        return a.layout
    size = seg["e"] - seg["s"]
    k = target - (0 if seg["s"] > target else size)
    n = seg["hi"] - seg["lo"] + 1
    inside = F.col("ord").between(seg["lo"], seg["hi"])
    # Ends and starts in the layout without the segment, whose contigs left of the target are its first ones.
    after = F.when(F.col("ord") > seg["hi"], size).otherwise(0)
    stays_left = F.when(F.col("len") > 0, F.col("e") - after <= k).otherwise(F.col("s") - after < k)
    left = spanned.where(~inside & stays_left).agg(F.count("*").alias("_left"))
    place = F.col("ord") - F.when(F.col("ord") > seg["hi"], n).otherwise(0)
    ord_ = F.when(inside, F.col("_left") + F.col("ord") - (seg["lo"] - 1)).when(place <= F.col("_left"), place).otherwise(place + n)
    return a.layout.crossJoin(F.broadcast(left)).select(ord_.cast("int").alias("ord"), "contig_id", "dir")  # one row


def convert(a: Assembly, asked: DataFrame, unit_from: str, order_from: int, unit_to: str, order_to: int) -> DataFrame:
    """``asked`` (pos) -> (pos, result): the position in other units. Inside its contig only the distance from the contig's start counts."""
    res = {r["res_order"]: r["bp_resolution"] for r in a.resolution.collect()}
    goal = spans(a, unit_to, order_to).select("ord", F.col("s").alias("s_to"))
    both = places(spans(a, unit_from, order_from).join(goal, "ord"), "ord")
    met = both.at(asked, "pos", "s", "s_to", how="inner")
    delta = F.col("pos") - F.col("s")
    bp = delta if unit_from == "bp" else delta * res[order_from]
    inside = bp if unit_to == "bp" else F.floor(bp / res[order_to])
    return met.select("pos", (F.col("s_to") + inside).cast("bigint").alias("result"))
