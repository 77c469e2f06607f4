"""An assembly derived from the order tables, for tests and benchmarks: parts are bins, order lines give contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ligamap.operators.ranges import MOST_RANGES, RANGE_ROWS, TASK_ROWS, range_of, running, splitters, tasks
from ligamap.schema import Assembly, small
from ligamap.sources.container import kept

EDGE = 64
BP = {0: 0, 1: 10, 2: 40, 3: 160}

#: Blocks of one resolution, at most; so (resolution, block) is one whole number.
MOST_BLOCKS = 1 << 48


def _orders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BP.items()), "res_order int, bp bigint")


def resolutions(spark: SparkSession) -> DataFrame:
    from ligamap.functions.units import scaled

    return scaled(_orders(spark).withColumnRenamed("bp", "bp_resolution"), BP[1])


def contigs(part: DataFrame) -> DataFrame:
    k = F.floor(F.sqrt("p_partkey")).cast("int")
    found = part.groupBy(k.alias("contig_id")).agg(F.count("*").alias("nb"), F.min("p_partkey").alias("b0"))
    return found.withColumn("name", F.concat(F.lit("ctg_"), F.col("contig_id"))).withColumn("length_bp", 10 * F.col("nb") - F.col("contig_id") % 10)


def _lengths(contig: DataFrame, orders: DataFrame) -> DataFrame:
    """Bins and presence at every order, with the first storage bin of each contig (c0)."""
    sized = contig.crossJoin(F.broadcast(orders))  # four orders
    bins = F.when(F.col("res_order") == 0, F.col("length_bp")).otherwise(F.expr("(length_bp + bp - 1) div greatest(bp, 1)"))
    shown = F.when((F.col("res_order") == 0) | (F.col("length_bp") >= F.col("bp")), 1).otherwise(0)
    before = Window.partitionBy("res_order").orderBy("contig_id").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("length_bins", bins).withColumn("shown", shown).withColumn("c0", F.coalesce(F.sum("length_bins").over(before), F.lit(0)))


def _bins(part: DataFrame, at: DataFrame, order: int) -> DataFrame:
    """(b, bin, p_retailprice) at one order. ``at`` are the contigs' first bins."""
    at = at.where(F.col("res_order") == order).drop("res_order")
    k = part.select(F.col("p_partkey").alias("b"), F.floor(F.sqrt("p_partkey")).cast("int").alias("contig_id"), "p_retailprice")
    return k.join(at, "contig_id").select("b", F.expr("c0 + ((b - b0) * 10) div bp").alias("bin"), "p_retailprice")


def atus(lengths: DataFrame, reversed_some: bool) -> DataFrame:
    """A contig's run of storage bins cut at block borders. ``reversed_some`` stores a quarter of the pieces backwards."""
    stripes = F.explode(F.sequence(F.expr(f"c0 div {EDGE}"), F.expr(f"(c0 + length_bins - 1) div {EDGE}"))).alias("t")
    cut = lengths.where("res_order > 0").select("res_order", "contig_id", "c0", "length_bins", stripes)
    first, last = F.greatest("c0", F.col("t") * EDGE), F.least(F.col("c0") + F.col("length_bins"), (F.col("t") + 1) * EDGE)
    backwards = F.when((F.col("contig_id") + F.col("t")) % 4 == 0, 0).otherwise(1) if reversed_some else F.lit(1)
    return cut.select(
        "res_order",
        "contig_id",
        (F.col("t") - F.expr(f"c0 div {EDGE}")).cast("int").alias("seq"),
        F.col("t").cast("int").alias("stripe_id"),
        (first - F.col("t") * EDGE).cast("int").alias("start"),
        (last - F.col("t") * EDGE).cast("int").alias("end"),
        backwards.cast("int").alias("dir"),
        (first - F.col("c0")).cast("bigint").alias("off"),
    )


def contacts(lineitem: DataFrame, at: DataFrame, orders: list[int]) -> DataFrame:
    """Pairs of lines of an order, by storage bin, summed once. A part's bin follows from its contig's place (``at``) alone.

    Lines and then pairs are dealt to as many tasks as their number asks for; those of a block meet in one.
    """
    n = lineitem.count()
    at = at.where(F.col("res_order").isin(orders))
    line = lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("b")).repartition(tasks(n), "l_orderkey")
    other = line.select("l_orderkey", F.col("l_linenumber").alias("n2"), F.col("b").alias("b2"))
    pairs = line.join(other, "l_orderkey").where("l_linenumber < n2").select("b", "b2")

    def placed(frame: DataFrame, part: str, keys: list[str], name: str) -> DataFrame:
        return frame.withColumn("contig_id", F.floor(F.sqrt(part)).cast("int")).join(at, keys).withColumn(name, F.expr(f"c0 + (({part} - b0) * 10) div bp")).select("res_order", *(c for c in ("b2", "x") if c in frame.columns and c != part), name)

    mapped = placed(placed(pairs, "b", ["contig_id"], "x"), "b2", ["contig_id", "res_order"], "y")
    cell = mapped.select("res_order", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).select(
        "res_order",
        *(F.expr(f"cast({n} div {EDGE} as int)").alias(s) for n, s in (("lo", "row_stripe"), ("hi", "col_stripe"))),
        *(F.expr(f"cast({n} % {EDGE} as int)").alias(s) for n, s in (("lo", "r"), ("hi", "c"))),
    )
    # An order has about four lines, so there are two pairs a line.
    dealt = cell.repartition(tasks(2 * n * len(orders)), "res_order", "row_stripe", "col_stripe")
    return dealt.groupBy(*dealt.columns).agg(F.count("*").alias("v"))


def _even(sizes: DataFrame) -> list[int]:
    """Splitters of the blocks' ``key`` by which a range holds TASK_ROWS cells, and at most a block's more; exact, from one running sum of ``length``."""
    cells = sizes.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    to_a_range = max(TASK_ROWS, cells // MOST_RANGES + 1)
    if cells <= to_a_range:
        return []
    upto = running(sizes.select("key", "length"), "key", {"upto": F.col("length")}, splitters(sizes, "key", RANGE_ROWS)[1])
    firsts = upto.groupBy(F.expr(f"(upto - length) div {to_a_range}").alias("range")).agg(F.min("key").alias("key"))
    return sorted(r["key"] for r in firsts.collect())[1:]


def _cell_arrays(a: Assembly, orders: DataFrame, counts: DataFrame, dense_from: int) -> dict[str, DataFrame]:
    """The arrays of cells and the directory of blocks. ``counts`` (bp, n) are the stripes of each resolution.

    A block's cells are gathered to one row, of edge * edge cells at most, where they were summed, and written once. So what
    is sampled, dealt and windowed is a row a block; cells are listed last. Blocks are dealt by ranges that hold equally many
    cells. A block's place is its place in its range, after the ranges before it: a row a range is windowed in one task. A
    range's cells lie in the order of their index, so that a scan by index skips pages.
    """
    listed = F.sort_array(F.collect_list(F.struct((F.col("r") * a.edge + F.col("c")).alias("at"), "v")))
    block = a.contact.groupBy("res_order", "row_stripe", "col_stripe").agg(listed.alias("cells"))
    block = block.join(F.broadcast(orders), "res_order").join(F.broadcast(counts), "bp").withColumn("block", F.col("row_stripe") * F.col("n") + F.col("col_stripe"))
    held = kept(block.select("res_order", "bp", "block", (F.col("res_order") * F.lit(MOST_BLOCKS) + F.col("block")).alias("key"), F.size("cells").cast("bigint").alias("length"), "cells"))
    held = held.withColumn("full", F.col("length") >= dense_from)
    sizes = held.drop("cells")
    splits = _even(sizes)
    sums = {"sparse_at": F.when(~F.col("full"), F.col("length")).otherwise(0), "dense_at": F.when(F.col("full"), 1).otherwise(0)}
    earlier = Window.partitionBy("res_order").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("res_order", range_of(F.col("key"), splits).alias("_range")).agg(*(F.sum(column).alias(name) for name, column in sums.items()))
    before = kept(totals.select("res_order", "_range", *(F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"{name}_before") for name in sums)))

    def numbered(blocks: DataFrame) -> DataFrame:
        ranged = blocks.withColumn("_range", range_of(F.col("key"), splits)).repartitionById(len(splits) + 1, "_range")
        so_far = Window.partitionBy("_range", "res_order").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        summed = ranged.withColumns({name: F.coalesce(F.sum(column).over(so_far), F.lit(0)) for name, column in sums.items()})
        met = summed.join(F.broadcast(before), ["res_order", "_range"])  # a row a range
        return met.withColumns({name: F.col(name) + F.col(f"{name}_before") for name in sums})

    # The map is an element of an array, so that it is made once a block and not once a cell.
    grid = F.expr(f"transform(array(map_from_entries(cells)), m -> transform(sequence(0, {a.edge - 1}), r -> transform(sequence(0, {a.edge - 1}), c -> coalesce(m[r * {a.edge} + c], 0L))))[0]")
    sparse = numbered(held.where("not full")).select("bp", "sparse_at", F.posexplode("cells").alias("pos", "cell"))
    return {
        "blocks": numbered(sizes).select("bp", F.col("block").cast("bigint").alias("i"), "length", F.when(F.col("full"), -F.col("dense_at") - 1).otherwise(F.col("sparse_at")).alias("offset")),
        "coo": sparse.select("bp", (F.col("sparse_at") + F.col("pos")).alias("i"), *(F.expr(f"cast(cell.at {x} {a.edge} as int)").alias(n) for n, x in (("r", "div"), ("c", "%"))), F.col("cell.v").alias("v")),
        "dense_blocks": numbered(held.where("full")).select("bp", F.col("dense_at").alias("i"), grid.alias("cells")),
    }


def as_arrays(a: Assembly, dense_from: int, cells: bool = True) -> dict[str, DataFrame]:
    """The tables of ``sources.arrays`` that hold this assembly; blocks of ``dense_from`` cells or more are dense, others sparse.

    Without ``cells`` those of the contacts are left out; with them the contacts are read at once.
    """
    orders = a.resolution.where("res_order > 0").select("res_order", F.col("bp_resolution").alias("bp"))
    by_order = lambda frame: frame.join(F.broadcast(orders), "res_order").drop("res_order")
    stripes = by_order(a.stripe_weight).groupBy("bp", F.col("stripe_id").alias("i")).agg(F.transform(F.sort_array(F.collect_list(F.struct("off", "weight"))), lambda x: x["weight"]).alias("bin_weights"))
    atu = by_order(a.contig_atu)
    numbered = atu.withColumn("atu_id", F.row_number().over(Window.partitionBy("bp").orderBy(F.desc("stripe_id"), "start")).cast("bigint") - 1)
    listed = numbered.select("bp", (F.row_number().over(Window.partitionBy("bp").orderBy("contig_id", "seq")) - 1).cast("bigint").alias("i"), "contig_id", "atu_id")
    counts = stripes.groupBy("bp").agg(F.count("*").alias("n"))
    names = orders.select(F.col("bp").cast("string").alias("name"), F.lit(a.edge).alias("edge"))
    others = a.contig.sparkSession.createDataFrame([("attributes", None)], "name string, edge int")
    info = a.contig.join(a.layout.select("contig_id", F.col("dir").alias("direction")), "contig_id").join(a.layout.select((F.col("ord") - 1).alias("at"), F.col("contig_id").alias("ordered_contig_id")), F.col("contig_id") == F.col("at"))
    return {
        "groups": names.unionByName(others),
        "contig_info": info.select(F.col("contig_id").alias("i"), "name", "length_bp", "direction", "ordered_contig_id"),
        "contigs": by_order(a.contig_res).select("bp", F.col("contig_id").alias("i"), "length_bins", F.col("shown").alias("hide_type")),
        "atl": listed,
        "basis_atu": numbered.select("bp", F.col("atu_id").alias("i"), "stripe_id", "start", "end", "dir"),
        "stripes": stripes,
    } | (_cell_arrays(a, orders, counts, dense_from) if cells else {})


def derive(spark: SparkSession, sf_dir: str, reversed_some: bool = False, contact_orders: tuple[int, ...] = (1,)) -> Assembly:
    """The derived assembly; everything is lazy. ``contact_orders`` are the orders whose contacts are made."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_retailprice")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    contig = contigs(part)
    lengths = _lengths(contig, _orders(spark))
    at = small(lengths.where("res_order > 0").select("res_order", "contig_id", "b0", "bp", "c0"))
    weights, n = None, tasks(part.count())
    for order in (1, 2, 3):
        # Dealt by number, for compressed bytes say little of a task's memory.
        weight = _bins(part, at, order).repartition(n, "bin").groupBy("bin").agg(F.avg(F.col("p_retailprice") / 1000).alias("weight"))
        weight = weight.select(F.lit(order).alias("res_order"), F.expr(f"cast(bin div {EDGE} as int)").alias("stripe_id"), F.expr(f"cast(bin % {EDGE} as int)").alias("off"), "weight")
        weights = weight if weights is None else weights.unionByName(weight)
    by_rank = Window.orderBy((F.col("contig_id") * 7) % 11, "contig_id")  # layout-sized
    layout = contig.select(F.row_number().over(by_rank).alias("ord"), "contig_id", F.when(F.col("contig_id") % 3 == 0, 0).otherwise(1).alias("dir"))
    ends = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    placed = layout.join(contig.select("contig_id", "length_bp"), "contig_id").withColumn("e", F.sum("length_bp").over(ends)).withColumn("g", F.expr("cast((ord - 1) div 4 as bigint)"))
    groups = placed.where("g % 2 = 1").groupBy("g").agg(F.min(F.col("e") - F.col("length_bp")).alias("start_bp"), F.max("e").alias("end_bp"))
    scaffold = groups.select(F.col("g").alias("scaffold_id"), F.concat(F.lit("scaffold_"), "g").alias("name"), (500 + F.col("g")).alias("spacer"), "start_bp", "end_bp")
    return Assembly(
        resolution=resolutions(spark),
        contig=contig.select("contig_id", "name", "length_bp", F.col("name").alias("source_name"), F.lit(0).alias("source_offset")),
        contig_res=lengths.select("res_order", "contig_id", "length_bins", "shown"),
        contig_atu=atus(lengths, reversed_some),
        stripe_weight=weights,
        contact=contacts(lineitem, at, list(contact_orders)),
        layout=layout,
        scaffold=scaffold,
        edge=EDGE,
    )
