"""Ordered work in many tasks: ranges of a sort key by sampled splitters, running sums, islands, and look-ups by position.

A range's rows meet in one task; what a range leaves to the next ones (a sum, its first and last row) is one row a range,
so the only windows over everything are over as many rows as there are ranges, at most MOST_RANGES.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligamap.schema import SMALL_ROWS

#: Rows of a range, and the most ranges there are; beyond their product the ranges grow.
RANGE_ROWS, MOST_RANGES = 50_000, 16_384

#: Disjoint intervals of a range: a position is compared with those of its range alone.
INTERVALS = 64

#: Rows that a task takes where rows are dealt by key; so its memory doesn't grow with the input.
TASK_ROWS = 200_000


def tasks(rows: int) -> int:
    """Partitions for ``rows`` rows. Dealt to so many by name, they aren't coalesced by their compressed bytes, which say little of their memory."""
    return rows // TASK_ROWS + 1


def splitters(rows: DataFrame, key: str, to_a_range: int = RANGE_ROWS) -> tuple[int, list[int]]:
    """(rows, splitters): values of the whole-number ``key`` that part its rows into even ranges, ascending and distinct.

    They come from one pass that keeps a sketch a task. A value that very many rows share is one splitter.
    """
    n, lowest = rows.agg(F.count(key), F.min(key)).first()
    parts = min(MOST_RANGES, n // to_a_range)
    if parts < 1:
        return n, []
    # One literal of the plan; as a list it would be thousands.
    shares = F.split(F.lit(",".join(str(i / parts) for i in range(1, parts))), ",").cast("array<double>")
    found = rows.agg(F.percentile_approx(key, shares, F.lit(max(10_000, 4 * parts)))).first()[0] if parts > 1 else []
    return n, sorted({x for x in found if x > lowest})


def range_of(key: Column, splits: list[int]) -> Column:
    """How many splitters are at or below ``key``, by binary search in a constant array; null for null."""
    if not splits:
        return F.when(key.isNotNull(), 0)
    # A constant of text is one literal of the plan; an array of literals would be as many.
    at = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(splits).bit_length()))))

    def halve(low: Column, step: Column) -> Column:
        return F.when((low + step <= len(splits)) & (F.try_element_at(at, low + step) <= key), low + step).otherwise(low)

    return F.when(key.isNotNull(), F.aggregate(steps, F.lit(0), halve))


def running(rows: DataFrame, key: str, sums: dict[str, Column], splits: list[int], ties: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the sum of its column over the rows up to and with this one in the order of ``key``, then ``ties``.

    Without splitters everything is one range, and one window does it.
    """
    order = [key, *ties]
    if not splits:
        inside = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({name: F.sum(column).over(inside) for name, column in sums.items()})
    ranged = rows.withColumn("_range", range_of(F.col(key), splits)).withColumns({f"_of_{name}": column for name, column in sums.items()})
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*(F.sum(f"_of_{name}").alias(f"_all_{name}") for name in sums))
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_all_{name}").over(before), F.lit(0)).alias(f"_before_{name}") for name in sums))
    summed = ranged.withColumns({name: F.sum(f"_of_{name}").over(inside) for name in sums})
    met = summed.join(F.broadcast(totals), "_range")  # a row a range
    return met.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in sums}).drop("_range", *(f"_{what}_{name}" for name in sums for what in ("of", "before")))


def islands(rows: DataFrame, key: str, follows: Column, columns: list[str], splits: list[int], into: str = "island") -> DataFrame:
    """``rows`` with the number of their island, from 1 on, in the order of the unique ``key``.

    A row continues the island of the one before it where ``follows`` says so; it is a condition on a row's ``columns``
    and, named ``last_`` and so on, those of the row before. A range's first row meets the last one of the range before.
    """
    if not splits:
        in_order = Window.orderBy(key)
        seen = rows.withColumns({f"last_{c}": F.lag(c).over(in_order) for c in columns})
        new = seen.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).drop(*(f"last_{c}" for c in columns))
        return new.withColumn(into, F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    ranged = rows.withColumn("_range", range_of(F.col(key), splits))
    inside = Window.partitionBy("_range").orderBy(key)
    ends = ranged.groupBy("_range").agg(F.max_by(F.struct(*columns), key).alias("_end"))
    ends = ends.select("_range", F.lag("_end").over(Window.orderBy("_range")).alias("_end"))
    # The first row of a range: what came before it is the end of the last range that holds any.
    seen = ranged.join(F.broadcast(ends), "_range").withColumn("_first", F.row_number().over(inside) == 1)
    seen = seen.withColumns({f"last_{c}": F.when(F.col("_first"), F.col(f"_end.{c}")).otherwise(F.lag(c).over(inside)) for c in columns})
    new = seen.withColumn("_new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).drop("_range", "_first", "_end", *(f"last_{c}" for c in columns))
    return running(new, key, {into: F.col("_new")}, splits).drop("_new")


def _marked(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL_ROWS else df


@dataclass(frozen=True)
class Places:
    """Disjoint intervals [s, e) of whole numbers, in order of ``s`` and then ``tie``, ready for look-ups of positions and ranges.

    A look-up is an equi-join on the range of a position, and there a comparison with at most the range's intervals; up to
    SMALL_ROWS intervals are broadcast, others shuffled by range, where a hot one is split by the planner.
    """

    frame: DataFrame  # the intervals' columns, with _place (from 1 on), _range and _next, the next interval's start
    n: int
    splits: list[int]

    def _last(self, asked: DataFrame, at: Column, *columns: Column | str) -> DataFrame:
        """``asked`` left-joined with ``columns`` of the last interval that starts at or before ``at``."""
        # Of intervals that start together only the last one has its start before the next one's.
        found = self.frame.where("s < _next or _next is null").select("_range", F.col("s").alias("_place_s"), F.col("_next"), *columns)
        met = asked.withColumn("_place_pos", at).withColumn("_place_range", range_of(F.col("_place_pos"), self.splits))
        inside = (F.col("_place_range") == F.col("_range")) & (F.col("_place_pos") >= F.col("_place_s")) & (F.col("_next").isNull() | (F.col("_place_pos") < F.col("_next")))
        return met.join(_marked(found, self.n), inside, "left").drop("_range", "_place_s", "_next", "_place_pos", "_place_range")

    def at(self, asked: DataFrame, position: str, *columns: str, how: str = "left") -> DataFrame:
        """``asked`` with ``columns`` of the interval that holds ``position``, or nulls (``how`` inner: without those rows)."""
        names = dict.fromkeys([*columns, "s", "e"])
        met = self._last(asked, F.col(position).cast("bigint"), F.struct(*names).alias("_place_held"))
        held = F.when(F.col(position) < F.col("_place_held.e"), F.col("_place_held"))
        met = met.withColumn("_place_held", held)
        if how == "inner":
            met = met.where("_place_held is not null")
        return met.withColumns({c: F.col(f"_place_held.{c}") for c in columns}).drop("_place_held")

    def runs(self, asked: DataFrame, start: str, end: str) -> DataFrame:
        """``asked`` with _first and _last, the places of the intervals that [start, end) overlaps; _first > _last if there are none.

        An interval of length 0 counts where it lies in the range.
        """
        # The last intervals that start before the range's start and before its end.
        met = self._last(asked, F.col(start).cast("bigint") - 1, F.struct("_place", "e").alias("_left"))
        met = self._last(met, F.col(end).cast("bigint") - 1, F.col("_place").alias("_last"))
        first = F.col("_left._place") + F.when(F.col("_left.e") > F.col(start), 0).otherwise(1)
        return met.withColumn("_first", F.coalesce(first, F.lit(1))).withColumn("_last", F.coalesce("_last", F.lit(0))).drop("_left")

    def over(self, asked: DataFrame, start: str, end: str, *columns: str) -> DataFrame:
        """A row for each interval that a row's [start, end) overlaps, with ``columns`` of it. No more rows are made than are returned."""
        met = self.runs(asked, start, end).where("_first <= _last")
        listed = met.withColumn("_at_place", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last")
        return listed.join(_marked(self.frame.select(F.col("_place").alias("_at_place"), *columns), self.n), "_at_place").drop("_at_place")

    def ends(self, asked: DataFrame, start: str, end: str, **columns: Column) -> DataFrame:
        """``asked`` with ``columns``, each a function of ``first`` and ``last``, structs of the outermost overlapped intervals (null if there are none)."""
        met = self.runs(asked, start, end)
        some = F.col("_first") <= F.col("_last")
        for name in ("first", "last"):
            found = self.frame.select(F.col("_place").alias("_p"), F.struct(*(c for c in self.frame.columns if not c.startswith("_"))).alias(name))
            met = met.join(_marked(found, self.n), some & (F.col(f"_{name}") == F.col("_p")), "left").drop("_p")
        return met.withColumns(columns).drop("_first", "_last", "first", "last")


def places(intervals: DataFrame, tie: str) -> Places:
    """``intervals`` (s, e and other columns, none with a leading underscore), disjoint and in the order of s and ``tie``."""
    n, splits = splitters(intervals, "s", INTERVALS)
    numbered = running(intervals.withColumn("s", F.col("s").cast("bigint")), "s", {"_place": F.lit(1)}, splits, (tie,)).withColumn("_range", range_of(F.col("s"), splits))
    after = F.lead("s").over(Window.partitionBy("_range").orderBy("s", tie))
    # The next range starts with a splitter, which is an interval's start.
    starts = F.split(F.lit(",".join(map(str, splits))), ",").cast("array<bigint>") if splits else F.array().cast("array<bigint>")
    return Places(numbered.withColumn("_next", F.coalesce(after, F.try_element_at(starts, F.col("_range") + 1))), n, splits)
