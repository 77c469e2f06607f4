"""Scaffolds: disjoint named intervals of the layout; gaps between them are implicit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligamap.operators.layout import contig_places, in_segment, moved_layout, reversed_layout, segment_of, spans, splits, total
from ligamap.operators.ranges import Places, islands, places
from ligamap.schema import Assembly

AUTO_SPACER = 1000


def scaffold_places(a: Assembly) -> Places:
    """The scaffolds, which are disjoint, ready for look-ups of positions and ranges by the million."""
    return places(a.scaffold.select("scaffold_id", "name", "spacer", "start_bp", "end_bp", F.col("start_bp").alias("s"), F.col("end_bp").alias("e")), "scaffold_id")


def scaffold_at(a: Assembly, asked: DataFrame) -> DataFrame:
    """``asked`` (bp and other columns) with the scaffold that holds each point; nulls in a gap or outside."""
    return scaffold_places(a).at(asked, "bp", "scaffold_id", "start_bp", "end_bp")


def extended(a: Assembly, asked: DataFrame, start: str, end: str) -> DataFrame:
    """``asked`` with ext_start and ext_end, its ranges widened to the scaffolds that their start and their end cut."""
    found = scaffold_places(a)
    met = found.at(asked, start, "start_bp").withColumn("ext_start", F.coalesce("start_bp", start)).drop("start_bp")
    met = found.at(met, end, "start_bp", "end_bp")
    return met.withColumn("ext_end", F.when(F.col("start_bp") < F.col(end), F.col("end_bp")).otherwise(F.col(end))).drop("start_bp", "end_bp")


def snapped(a: Assembly, asked: DataFrame, start: str, end: str) -> DataFrame:
    """``asked`` with seg_start and seg_end: what an edit of each range takes, whole contigs and whole scaffolds (null where the range has no contig)."""
    met = contig_places(a).ends(asked, start, end, from_=F.col("first.s"), to_=F.col("last.e"))
    return extended(a, met, "from_", "to_").withColumnRenamed("ext_start", "seg_start").withColumnRenamed("ext_end", "seg_end").drop("from_", "to_")


def extend(a: Assembly, start: int, end: int) -> tuple[int, int]:
    """The range widened to the scaffolds that its start and its end cut."""
    left = F.min(F.when((F.col("start_bp") <= start) & (F.col("end_bp") > start), F.col("start_bp")))
    right = F.max(F.when((F.col("start_bp") < end) & (F.col("end_bp") > end), F.col("end_bp")))
    found = a.scaffold.agg(F.coalesce(left, F.lit(start)), F.coalesce(right, F.lit(end))).first()
    return found[0], found[1]


def _snapped(a: Assembly, start: int, end: int) -> tuple[int, int] | None:
    seg = segment_of(spans(a), start, end)
    return None if seg["lo"] is None else extend(a, seg["s"], seg["e"])


def _without(scaffold: DataFrame, start: int, end: int) -> DataFrame:
    return scaffold.where(~((F.col("start_bp") < end) & (F.col("end_bp") > start)))


def group(a: Assembly, start: int, end: int, name: str | None = None, spacer: int | None = None) -> Assembly:
    """One scaffold over the contigs of [start, end) and the scaffolds that they cut. ``name`` may hold {id}."""
    borders = _snapped(a, start, end)
    if borders is None:
        return a
    number = a.scaffold_counter + 1
    named = (name or "scaffold_auto_{id}").replace("{id}", str(number))
    new = a.scaffold.sparkSession.range(1).select(
        F.lit(number).cast("bigint").alias("scaffold_id"), F.lit(named).alias("name"), F.lit(AUTO_SPACER if spacer is None else spacer).cast("bigint").alias("spacer"), F.lit(borders[0]).cast("bigint").alias("start_bp"), F.lit(borders[1]).cast("bigint").alias("end_bp")
    )
    return a.with_(scaffold=_without(a.scaffold, *borders).unionByName(new), scaffold_counter=number)


def ungroup(a: Assembly, start: int, end: int) -> Assembly:
    """Every scaffold over the contigs of [start, end), widened, goes."""
    borders = _snapped(a, start, end)
    return a if borders is None else a.with_(scaffold=_without(a.scaffold, *borders))


def clear(a: Assembly, start: int, end: int) -> Assembly:
    """Every scaffold of the widened range goes; a number is used up, as when one is made."""
    return a.with_(scaffold=_without(a.scaffold, *extend(a, start, end)), scaffold_counter=a.scaffold_counter + 1)


def reverse(a: Assembly, start: int, end: int) -> Assembly:
    """Mirror and turn the contigs of the widened range, with the scaffolds inside."""
    seg = segment_of(spans(a), *extend(a, start, end))
    if seg["lo"] is None:
        return a
    inside = (F.col("start_bp") >= seg["s"]) & (F.col("end_bp") <= seg["e"])
    mirrored = a.scaffold.select(
        "scaffold_id",
        "name",
        "spacer",
        F.when(inside, seg["s"] + seg["e"] - F.col("end_bp")).otherwise(F.col("start_bp")).alias("start_bp"),
        F.when(inside, seg["s"] + seg["e"] - F.col("start_bp")).otherwise(F.col("end_bp")).alias("end_bp"),
    )
    return a.with_(layout=reversed_layout(a, seg["lo"], seg["hi"]), scaffold=mirrored)


def move(a: Assembly, start: int, end: int, target: int) -> Assembly:
    """Move the widened range to ``target``; scaffolds follow the contig at their start."""
    layout = moved_layout(a, *extend(a, start, end), target)
    now = a.with_(layout=layout)
    shift = spans(a).select("contig_id", "s", "e").join(spans(now).select("contig_id", F.col("s").alias("s2")), "contig_id")
    met = places(shift.withColumn("moved", F.col("s2") - F.col("s")), "contig_id").at(a.scaffold, "start_bp", "moved", how="inner")
    by = F.col("moved")
    return now.with_(scaffold=met.select("scaffold_id", "name", "spacer", (F.col("start_bp") + by).alias("start_bp"), (F.col("end_bp") + by).alias("end_bp")))


def debris(a: Assembly, start: int, end: int) -> Assembly:
    """The contigs of the range between the scaffolds that hold its ends become a scaffold of their own at the layout's end."""
    ends = a.scaffold.agg(
        F.max(F.when((F.col("start_bp") <= start) & (F.col("end_bp") > start), F.col("end_bp"))),
        F.min(F.when((F.col("start_bp") <= end - 1) & (F.col("end_bp") > end - 1), F.col("start_bp"))),
    ).first()
    first, last = start if ends[0] is None else ends[0], end - 1 if ends[1] is None else ends[1]
    if first >= last:
        return a
    return move(group(a, first, last, "scaffold_debris_{id}", AUTO_SPACER), first, last, total(a))


def members(a: Assembly) -> DataFrame:
    """(group_no, scaffold_id, contig_id, ord): contigs by the scaffold that holds their start, each other contig a group of its own."""
    placed = scaffold_places(a).at(spans(a), "s", "scaffold_id", "name", "spacer", "start_bp", "end_bp")
    return islands(placed, "ord", F.col("scaffold_id") == F.col("last_scaffold_id"), ["scaffold_id"], splits(a), "group_no")


def overlapping(a: Assembly, start: int, end: int) -> DataFrame:
    """Scaffolds that overlap [start, end)."""
    return a.scaffold.where((F.col("start_bp") < end) & (F.col("end_bp") > start))


__all__ = ["clear", "debris", "extend", "extended", "group", "in_segment", "members", "move", "overlapping", "reverse", "scaffold_at", "scaffold_places", "snapped", "ungroup"]
