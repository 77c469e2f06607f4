"""Sub-matrices: contacts joined with the layout by stripe, both orientations of a cell made by one explode."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ligamap.operators.layout import spans, total
from ligamap.operators.ranges import RANGE_ROWS, islands, running
from ligamap.schema import Assembly, small


def placed_atus(a: Assembly, order: int, units: str = "pixels") -> DataFrame:
    """(stripe_id, start, end, dir, p0, p1): each atomic unit with its interval of the layout and its direction there.

    Hidden contigs have no pixels and so no units in the layout; in bins they count.
    """
    at = spans(a, units, order).where("len > 0").withColumnRenamed("dir", "contig_dir")
    n = F.col("end") - F.col("start")
    met = a.contig_atu.where(F.col("res_order") == order).select("contig_id", "stripe_id", "start", "end", "dir", "off").join(small(at, a.n_contigs), "contig_id")
    p0 = F.when(F.col("contig_dir") == 1, F.col("s") + F.col("off")).otherwise(F.col("e") - F.col("off") - n)
    same = F.when(F.col("contig_dir") == F.col("dir"), 1).otherwise(0)
    return met.select("stripe_id", "start", "end", same.alias("dir"), p0.alias("p0"), (p0 + n).alias("p1"))


def atus_for_range(a: Assembly, order: int, start: int, end: int, units: str = "pixels") -> DataFrame:
    """(seq, stripe_id, start, end, dir): the units of [start, end) in layout order, clipped to it."""
    met = placed_atus(a, order, units).where((F.col("p0") < end) & (F.col("p1") > start))
    head, tail = F.greatest(F.lit(start) - F.col("p0"), F.lit(0)), F.greatest(F.col("p1") - end, F.lit(0))
    forward = F.col("dir") == 1
    # A unit has a bin at least, so a range of positions has no more units than positions.
    met = running(met, "p0", {"seq": F.lit(1)}, list(range(start + RANGE_ROWS, end, RANGE_ROWS)))
    return met.select(
        F.col("seq").cast("int").alias("seq"),
        "stripe_id",
        (F.col("start") + F.when(forward, head).otherwise(tail)).cast("int").alias("start"),
        (F.col("end") - F.when(forward, tail).otherwise(head)).cast("int").alias("end"),
        "dir",
    )


def coalesced(atus: DataFrame, most: int = RANGE_ROWS) -> DataFrame:
    """Neighbours in ``seq``, which runs from 1 to at most ``most``, that continue each other in their direction become one unit."""
    follows = F.when(F.col("dir") == 1, F.col("last_end") == F.col("start")).otherwise(F.col("last_start") == F.col("end"))
    joined = (F.col("last_stripe_id") == F.col("stripe_id")) & (F.col("last_dir") == F.col("dir")) & follows
    runs = islands(atus, "seq", joined, ["stripe_id", "start", "end", "dir"], list(range(RANGE_ROWS + 1, most + 1, RANGE_ROWS)))
    return runs.drop("seq").withColumnRenamed("island", "seq").groupBy("seq").agg(F.first("stripe_id").alias("stripe_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.first("dir").alias("dir")).select(F.col("seq").cast("int").alias("seq"), "stripe_id", "start", "end", "dir")


def _at(prefix: str, index: str) -> Column:
    """Layout position of index ``index`` of the unit's stripe."""
    inside = F.when(F.col(f"{prefix}dir") == 1, F.col(index) - F.col(f"{prefix}start")).otherwise(F.col(f"{prefix}end") - 1 - F.col(index))
    return F.col(f"{prefix}p0") + inside


#: Ranges of stripes that a scan is bounded by.
MOST_RANGES = 32


def ranges(stripes: list[int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Up to ``most`` closed ranges that hold all stripes and skip the widest gaps between them."""
    stripes = sorted(set(stripes))
    gaps = sorted(range(1, len(stripes)), key=lambda i: stripes[i - 1] - stripes[i])[: most - 1]
    cuts = sorted(i for i in gaps if stripes[i] - stripes[i - 1] > 1)
    return [(stripes[a], stripes[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(stripes)], strict=True)] if stripes else []


def within(column: str, values: list[int]) -> Column:
    """``column`` in up to MOST_RANGES ranges that hold ``values``, as literals that reach a scan."""
    found = F.lit(False)
    for a, b in ranges(values):
        found |= F.col(column) == a if a == b else F.col(column).between(a, b)
    return found


def stored(a: Assembly, order: int, units: str = "pixels", window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(p, q, v) of the stored triangle in layout positions: each cell once, p and q in either order.

    With ``window`` (r0, r1, c0, c1) only blocks that may hold cells of it. Its stripes (as many as it has bins, over the edge,
    and contigs) are fetched first and bound the scan as literals, so that a dataset's other row groups are skipped.
    """
    contact = a.contact.where(F.col("res_order") == order)
    units_at = placed_atus(a, order, units)
    if window:
        r0, r1, c0, c1 = window
        near = ((F.col("p0") < r1) & (F.col("p1") > r0)) | ((F.col("p0") < c1) & (F.col("p1") > c0))
        units_at = units_at.where(near)
        touched = units_at.groupBy("stripe_id").agg(*(F.max((F.col("p0") < hi) & (F.col("p1") > lo)).alias(n) for n, lo, hi in (("row", r0, r1), ("col", c0, c1)))).collect()
        rows, cols = ([t["stripe_id"] for t in touched if t[n]] for n in ("row", "col"))
        # The stored triangle answers both orders of stripes.
        if a.read_blocks:
            contact = a.read_blocks(order, rows, cols)
        else:
            contact = contact.where((within("row_stripe", rows) & within("col_stripe", cols)) | (within("row_stripe", cols) & within("col_stripe", rows)))
    # A unit has a position at least, so a window has no more units than positions.
    units_at = small(units_at, r1 - r0 + c1 - c0 if window else None)
    sides = [units_at.select(*(F.col(c).alias(f"{x}_{c}") for c in units_at.columns)) for x in ("x", "y")]
    on_x = (F.col("row_stripe") == F.col("x_stripe_id")) & (F.col("r") >= F.col("x_start")) & (F.col("r") < F.col("x_end"))
    on_y = (F.col("col_stripe") == F.col("y_stripe_id")) & (F.col("c") >= F.col("y_start")) & (F.col("c") < F.col("y_end"))
    return contact.join(sides[0], on_x).join(sides[1], on_y).select(_at("x_", "r").alias("p"), _at("y_", "c").alias("q"), "v")


def cells(a: Assembly, order: int, units: str = "pixels", window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """(p, q, v) of the symmetric map in layout positions; with ``window`` (r0, r1, c0, c1) the cells of it alone. The stored triangle is read once."""
    one = F.struct("p", "q")
    turned = F.struct(F.col("q").alias("p"), F.col("p").alias("q"))
    both = stored(a, order, units, window).select(F.explode(F.when(F.col("p") == F.col("q"), F.array(one)).otherwise(F.array(one, turned))).alias("x"), "v").select("x.p", "x.q", "v")
    if window:
        r0, r1, c0, c1 = window
        both = both.where((F.col("p") >= r0) & (F.col("p") < r1) & (F.col("q") >= c0) & (F.col("q") < c1))
    return both


def submatrix(a: Assembly, order: int, r0: int, r1: int, c0: int, c1: int, units: str = "pixels") -> DataFrame:
    """(i, j, v): the cells other than 0 of [r0, r1) x [c0, c1), counted from the window's own start. The window may stick out of the layout."""
    found = cells(a, order, units, (r0, r1, c0, c1))
    return found.select((F.col("p") - r0).alias("i"), (F.col("q") - c0).alias("j"), "v")


def intersection(a: Assembly, order: int, row: tuple[int, int, int, int], col: tuple[int, int, int, int]) -> DataFrame:
    """(i, j, v) of one unit (stripe, start, end, dir) with another, in their own directions. The stored triangle answers both orders of stripes."""
    turned = row[0] > col[0]
    (s1, a1, b1, d1), (s2, a2, b2, d2) = (col, row) if turned else (row, col)
    block = a.contact.where((F.col("res_order") == order) & (F.col("row_stripe") == s1) & (F.col("col_stripe") == s2))
    cell = F.array(F.struct("r", "c"), F.struct(F.col("c").alias("r"), F.col("r").alias("c")))
    if s1 == s2:
        block = block.select(F.explode(F.array_distinct(cell)).alias("x"), "v").select("x.r", "x.c", "v")
    block = block.where((F.col("r") >= a1) & (F.col("r") < b1) & (F.col("c") >= a2) & (F.col("c") < b2))
    i = F.col("r") - a1 if d1 == 1 else b1 - 1 - F.col("r")
    j = F.col("c") - a2 if d2 == 1 else b2 - 1 - F.col("c")
    return block.select((j if turned else i).alias("i"), (i if turned else j).alias("j"), "v")


def dense(spark: SparkSession, sparse: DataFrame, rows: int, cols: int) -> DataFrame:
    """Every cell (i, j, v) of a rows x cols window, zeros included; the window is a tile, its size is the caller's."""
    grid = spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cols - 1).cast("bigint"))).alias("j"))
    return grid.join(sparse, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0)).alias("v"))


def dense_rows(dense_cells: DataFrame) -> DataFrame:
    """(i, row): a row's values in the order of j."""
    return dense_cells.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda x: x["v"]).alias("row"))


def range_weights(a: Assembly, order: int, start: int, end: int, units: str = "pixels") -> DataFrame:
    """(i, weight) of the positions of [start, end) that the layout has, counted from ``start``."""
    near = placed_atus(a, order, units).where((F.col("p0") < end) & (F.col("p1") > start))
    stripes = [r["stripe_id"] for r in near.select("stripe_id").distinct().collect()]  # the window's
    met = a.stripe_weight.where((F.col("res_order") == order) & within("stripe_id", stripes)).withColumnRenamed("off", "t").join(small(near, end - start), "stripe_id").where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    return met.select((_at("", "t") - start).alias("i"), "weight").where((F.col("i") >= 0) & (F.col("i") < end - start))


def block_directory(a: Assembly, order: int) -> DataFrame:
    """(row_stripe, col_stripe, nnz) of the blocks that hold anything."""
    counts = a.contact.where(F.col("res_order") == order).groupBy("res_order", "row_stripe", "col_stripe").agg(F.count("*").alias("nnz"))
    return counts.drop("res_order")


def mapped(sparse: DataFrame, value: Column) -> DataFrame:
    """``sparse`` with its values replaced."""
    return sparse.withColumn("v", value)


def unique_cells(contact: DataFrame) -> DataFrame:
    """Coordinates stored more than once; a valid dataset has none."""
    return contact.groupBy("res_order", "row_stripe", "col_stripe", "r", "c").agg(F.count("*").alias("n")).where("n > 1")


def tile_stats(a: Assembly, orders: list[int], edge: int, units: str = "pixels") -> DataFrame:
    """(res_order, tile_row, tile_col, nnz, min, max, sum) over the whole symmetric map of each order, in one pass over the contacts.

    The stored triangle is summed once by the unordered pair of a tile's row and column, which is mirrored afterwards; cells
    of a tile on the diagonal count twice there, but for those on the diagonal of the map.
    """
    contact = a.contact.where(F.col("res_order").isin(orders))
    placed = [placed_atus(a, order, units).withColumn("res_order", F.lit(order)) for order in orders]
    at = small(reduce(DataFrame.unionByName, placed))
    sides = [at.select(*(F.col(c).alias(f"{x}_{c}") for c in at.columns)) for x in ("x", "y")]
    on_x = (F.col("row_stripe") == F.col("x_stripe_id")) & (F.col("r") >= F.col("x_start")) & (F.col("r") < F.col("x_end"))
    on_y = (F.col("col_stripe") == F.col("y_stripe_id")) & (F.col("c") >= F.col("y_start")) & (F.col("c") < F.col("y_end"))
    on_x, on_y = (on & (F.col("res_order") == F.col(f"{x}_res_order")) for x, on in (("x", on_x), ("y", on_y)))
    met = contact.join(sides[0], on_x).join(sides[1], on_y).select("res_order", _at("x_", "r").alias("p"), _at("y_", "c").alias("q"), "v")
    tile = [F.expr(f"{x} div {edge}") for x in ("p", "q")]
    times = F.when((tile[0] == tile[1]) & (F.col("p") != F.col("q")), 2).otherwise(1)
    placed = met.select("res_order", F.least(*tile).alias("x"), F.greatest(*tile).alias("y"), times.alias("times"), "v")
    half = placed.groupBy("res_order", "x", "y").agg(F.sum("times").alias("nnz"), F.min("v").alias("min"), F.max("v").alias("max"), F.sum(F.col("v") * F.col("times")).alias("sum"))
    one = F.struct(F.col("x").alias("tile_row"), F.col("y").alias("tile_col"))
    turned = F.struct(F.col("y").alias("tile_row"), F.col("x").alias("tile_col"))
    mirrored = F.when(F.col("x") == F.col("y"), F.array(one)).otherwise(F.array(one, turned))
    return half.select("res_order", F.explode(mirrored).alias("t"), "nnz", "min", "max", "sum").select("res_order", "t.*", "nnz", "min", "max", "sum")


__all__ = ["atus_for_range", "block_directory", "cells", "coalesced", "dense", "dense_rows", "intersection", "mapped", "placed_atus", "range_weights", "stored", "submatrix", "tile_stats", "total", "unique_cells"]
