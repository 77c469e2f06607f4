"""Lists of edits in one pass: reversals and moves composed to a piecewise map of places, which one join applies.

A list of edits leaves the layout as runs of its old contigs, each kept or turned: at most three more runs an edit. Where
an edit's range falls depends on the edits before it, so the map is composed on the driver, edit by edit, from the
contigs' ends and the scaffolds' borders (two numbers a row, up to SMALL_ROWS rows, as for a broadcast); nothing there
runs a job. A longer layout, or one with contigs of length 0, takes the edits one after the other.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from ligamap.operators import scaffolds
from ligamap.operators.layout import spans
from ligamap.operators.ranges import places
from ligamap.schema import SMALL_ROWS, Assembly


@dataclass(frozen=True)
class Reverse:
    """Mirror and turn the contigs of [start, end), widened to scaffolds."""

    start: int
    end: int


@dataclass(frozen=True)
class Move:
    """Move the contigs of [start, end), widened to scaffolds, to ``target``."""

    start: int
    end: int
    target: int


@dataclass
class PlaceMap:
    """The layout as runs (first, past, turned) of old places from 0 on, with the scaffolds' borders beside it."""

    ends: np.ndarray  # of the old contigs in base pairs, after a 0
    starts: np.ndarray  # of the scaffolds now
    stops: np.ndarray
    scaffolds: list[tuple[int, int]] = field(default_factory=list)  # id and old start of each, which tell them apart
    runs: list[tuple[int, int, bool]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.runs = self.runs or [(0, len(self.ends) - 1, False)]
        self.total = int(self.ends[-1])

    def _size(self, run: tuple[int, int, bool]) -> int:
        return int(self.ends[run[1]] - self.ends[run[0]])

    def contig(self, runs: list[tuple[int, int, bool]], position: int) -> tuple[int, int, int, int]:
        """(run, old place, start, end) of the contig that holds ``position``, which is in the layout of these runs."""
        at = 0
        for k, run in enumerate(runs):
            size, (first, past, turned) = self._size(run), run
            if position < at + size:
                off = position - at
                old = int(np.searchsorted(self.ends, self.ends[past] - 1 - off if turned else self.ends[first] + off, "right")) - 1
                start = at + int(self.ends[past] - self.ends[old + 1] if turned else self.ends[old] - self.ends[first])
                return k, old, start, start + int(self.ends[old + 1] - self.ends[old])
            at += size
        raise ValueError("the position lies outside of the layout")

    def cut(self, runs: list[tuple[int, int, bool]], border: int) -> tuple[list, list]:
        """The runs before and after ``border``, where a contig starts or the layout ends."""
        if border >= sum(map(self._size, runs)):
            return runs, []
        k, old, _, _ = self.contig(runs, border)
        first, past, turned = runs[k]
        head, tail = ((old + 1, past, True), (first, old + 1, True)) if turned else ((first, old, False), (old, past, False))
        return [*runs[:k], *([head] if head[0] < head[1] else [])], [tail, *runs[k + 1 :]]

    def segment(self, start: int, end: int) -> tuple[int, int] | None:
        """Borders of the contigs that [start, end) overlaps."""
        if not self.total or start >= self.total or end <= 0:
            return None
        s, e = self.contig(self.runs, max(start, 0))[2], self.contig(self.runs, min(end, self.total) - 1)[3]
        return (s, e) if s < e else None

    def extended(self, start: int, end: int) -> tuple[int, int]:
        """The range widened to the scaffolds that its start and its end cut."""
        left, right = (self.starts <= start) & (self.stops > start), (self.starts < end) & (self.stops > end)
        return int(self.starts[left].min()) if left.any() else start, int(self.stops[right].max()) if right.any() else end

    def apply(self, edit: Reverse | Move) -> None:
        found = self.segment(*self.extended(edit.start, edit.end))
        if isinstance(edit, Move):
            # A move drops the scaffolds that start outside of the layout, whether or not it moves anything.
            self._move(found, edit.target)
        elif found:
            s, e = found
            before, rest = self.cut(self.runs, s)
            inside, after = self.cut(rest, e - s)
            self.runs = [*before, *((first, past, not turned) for first, past, turned in reversed(inside)), *after]
            mirrored = (self.starts >= s) & (self.stops <= e)
            self.starts, self.stops = np.where(mirrored, s + e - self.stops, self.starts), np.where(mirrored, s + e - self.starts, self.stops)

    def _move(self, found: tuple[int, int] | None, target: int) -> None:
        there = (self.starts >= 0) & (self.starts < self.total)
        self.starts, self.stops = np.where(there, self.starts, -1), np.where(there, self.stops, -1)  # -1: gone
        if found is None:
            return
        s, e = found
        size = e - s
        before, rest = self.cut(self.runs, s)
        inside, after = self.cut(rest, size)
        others = [*before, *after]
        # The target in the layout without the segment, back to its contig's start.
        k = min(max(target - (0 if s > target else size), 0), self.total - size)
        c = self.contig(others, k)[2] if k < self.total - size else k
        left, right = self.cut(others, c)
        self.runs = [*left, *inside, *right]
        moved = (self.starts >= s) & (self.starts < e)
        out = np.where(self.starts >= e, self.starts - size, self.starts)
        by = np.where(moved, c - s, out + np.where(out >= c, size, 0) - self.starts)
        by = np.where(self.starts < 0, 0, by)
        self.starts, self.stops = self.starts + by, self.stops + by


def composed(a: Assembly, edits: list[Reverse | Move]) -> PlaceMap | None:
    """The map of a list of edits, or None where the layout is too long or has contigs of length 0."""
    if a.n_contigs > SMALL_ROWS:
        return None
    ends = spans(a).select("ord", "e").toPandas().sort_values("ord")["e"].to_numpy(np.int64)
    ends = np.concatenate([[0], ends])
    borders = a.scaffold.select("scaffold_id", "start_bp", "end_bp").limit(SMALL_ROWS + 1).toPandas()
    if len(borders) > SMALL_ROWS or (np.diff(ends) == 0).any():
        return None
    found = PlaceMap(ends, borders["start_bp"].to_numpy(np.int64), borders["end_bp"].to_numpy(np.int64), list(zip(borders["scaffold_id"].tolist(), borders["start_bp"].tolist(), strict=True)))
    for edit in edits:
        found.apply(edit)
    return found


def apply(a: Assembly, edits: list[Reverse | Move]) -> Assembly:
    """The assembly after ``edits``, each given in the layout that the ones before it leave. The jobs don't grow with the list."""
    if not edits:
        return a
    found = composed(a, edits)
    if found is None:
        for edit in edits:
            a = scaffolds.reverse(a, edit.start, edit.end) if isinstance(edit, Reverse) else scaffolds.move(a, edit.start, edit.end, edit.target)
        return a
    spark, rows, to = a.layout.sparkSession, [], 0
    for first, past, turned in found.runs:
        rows.append((first + 1, past + 1, to + 1, turned))
        to += past - first
    runs = places(spark.createDataFrame(rows, "s bigint, e bigint, to bigint, turned boolean"), "to")
    met = runs.at(a.layout, "ord", "s", "e", "to", "turned", how="inner")
    place = F.col("to") + F.when(F.col("turned"), F.col("e") - 1 - F.col("ord")).otherwise(F.col("ord") - F.col("s"))
    layout = met.select(place.cast("int").alias("ord"), "contig_id", F.when(F.col("turned"), 1 - F.col("dir")).otherwise(F.col("dir")).alias("dir"))
    kept = [(*key, s, e) for key, s, e in zip(found.scaffolds, found.starts.tolist(), found.stops.tolist(), strict=True) if s >= 0]
    borders = spark.createDataFrame(kept, "scaffold_id bigint, start_bp bigint, now_start bigint, now_end bigint")
    scaffold = a.scaffold.join(borders, ["scaffold_id", "start_bp"]).select("scaffold_id", "name", "spacer", F.col("now_start").alias("start_bp"), F.col("now_end").alias("end_bp"))
    return a.with_(layout=layout, scaffold=scaffold)
