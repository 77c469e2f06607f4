"""Import of a dataset kept as indexed arrays, one table for each kind of array.

A table has a row for each index ``i`` of an array, and the resolution ``bp`` where there is an array for each. So a
conversion from any array container is a plain copy; what the arrays mean together is worked out here by joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ligamap.functions.units import block_edge, discovered, scaled
from ligamap.operators.matrix import MOST_RANGES, within
from ligamap.operators.ranges import tasks
from ligamap.schema import SCHEMAS, SMALL_ROWS, Assembly, small

#: Cells of one resolution, at most; so (resolution, index) is one whole number.
MOST_CELLS = 1 << 44

#: Cells that meet the runs that overlap them; a cell is compared with these alone, however many runs there are.
CHUNK = 64

#: ``cells`` of a dense block are its rows; an ``offset`` below 0 is the dense block -(offset + 1), others start in ``coo``.
TABLES = {
    "groups": "name string, edge int",
    "contig_info": "i int, name string, length_bp bigint, direction int, ordered_contig_id int",
    "contigs": "bp bigint, i int, length_bins bigint, hide_type int",
    "atl": "bp bigint, i bigint, contig_id int, atu_id bigint",
    "basis_atu": "bp bigint, i bigint, stripe_id int, start int, end int, dir int",
    "stripes": "bp bigint, i int, bin_weights array<double>",
    "blocks": "bp bigint, i bigint, length bigint, offset bigint",
    "coo": "bp bigint, i bigint, r int, c int, v bigint",
    "dense_blocks": "bp bigint, i bigint, cells array<array<bigint>>",
}


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a folder, one Parquet table each."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in TABLES.items()}


def _orders(groups: DataFrame) -> DataFrame:
    return discovered(groups.select("name")).select(F.col("res_order").cast("int").alias("res_order"), F.col("bp_resolution").alias("bp"))


def atus(tables: dict[str, DataFrame], orders: DataFrame) -> DataFrame:
    """Each contig's atomic units in the order of ``atl``, looked up in the dictionary ``basis_atu``."""
    known = tables["basis_atu"].withColumnRenamed("i", "atu_id")
    met = tables["atl"].join(known, ["bp", "atu_id"]).join(F.broadcast(orders), "bp")  # orders: a row for each resolution
    of_contig = Window.partitionBy("res_order", "contig_id").orderBy("i")
    n = (F.col("end") - F.col("start")).cast("bigint")
    off = F.sum(n).over(of_contig.rowsBetween(Window.unboundedPreceding, 0)) - n
    return met.select("res_order", "contig_id", (F.row_number().over(of_contig) - 1).alias("seq"), "stripe_id", "start", "end", "dir", off.alias("off"))


def directory(tables: dict[str, DataFrame], orders: DataFrame) -> DataFrame:
    """(bp, res_order, length, offset, row_stripe, col_stripe) of the blocks of the upper triangle that hold anything."""
    counts = tables["stripes"].groupBy("bp").agg(F.count("*").alias("n"))
    blocks = tables["blocks"].where("length > 0").join(F.broadcast(counts), "bp").join(F.broadcast(orders), "bp")
    return blocks.select("bp", "res_order", "length", "offset", F.expr("cast(i div n as int)").alias("row_stripe"), F.expr("cast(i % n as int)").alias("col_stripe")).where("row_stripe <= col_stripe")


def contacts(blocks: DataFrame, coo: DataFrame, dense_blocks: DataFrame, orders: DataFrame) -> DataFrame:
    """The cells of ``blocks``, sparse and dense. Of a block on the diagonal the upper triangle counts, zeros don't.

    A sparse block is a run of cells. Runs don't overlap, so a chunk of CHUNK cells meets as many runs at most, and runs and
    cells meet by an equi-join on the chunk: a row a run and chunk is broadcast where the cells lie, or beyond SMALL_ROWS of
    them dealt with the cells to as many tasks as the cells ask for. No row a cell is made.
    """
    at = F.col("res_order") * MOST_CELLS
    chunks = F.sequence(F.expr(f"s div {CHUNK}"), F.expr(f"(e - 1) div {CHUNK}"))
    runs = blocks.where("offset >= 0").select("row_stripe", "col_stripe", (at + F.col("offset")).alias("s"), (at + F.col("offset") + F.col("length")).alias("e")).withColumn("chunk", F.explode(chunks))
    cells = coo.join(F.broadcast(orders), "bp").select("res_order", (at + F.col("i")).alias("at"), "r", "c", "v").withColumn("chunk", F.expr(f"at div {CHUNK}"))
    if runs.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        runs = F.broadcast(runs)
    else:
        n = tasks(coo.count())
        cells, runs = cells.repartition(n, "chunk"), runs.repartition(n, "chunk")
    sparse = cells.join(runs, "chunk").where("at >= s and at < e").select("res_order", "row_stripe", "col_stripe", "r", "c", "v")
    full = dense_blocks.join(small(blocks.where("offset < 0").withColumn("i", -(F.col("offset") + 1)).drop("offset", "length")), ["bp", "i"])
    rows = full.select("res_order", "row_stripe", "col_stripe", F.posexplode("cells").alias("r", "row"))
    dense = rows.select("res_order", "row_stripe", "col_stripe", "r", F.posexplode("row").alias("c", "v"))
    return sparse.unionByName(dense).where("v <> 0 and (row_stripe < col_stripe or r <= c)")


def in_runs(column: str, runs: list[tuple[int, int]], most: int = MOST_RANGES) -> Column:
    """``column`` in up to ``most`` ranges that hold all runs [a, b) and skip the widest gaps between them, as literals that reach a scan."""
    runs = sorted(runs)
    gaps = sorted(range(1, len(runs)), key=lambda k: runs[k - 1][1] - runs[k][0])[: most - 1]
    cuts = [0, *sorted(k for k in gaps if runs[k][0] > runs[k - 1][1]), len(runs)]
    found = F.lit(False)
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            found |= F.col(column).between(runs[a][0], runs[b - 1][1] - 1)
    return found


def block_reader(tables: dict[str, DataFrame], orders: DataFrame) -> Callable[[int, list[int], list[int]], DataFrame]:
    """Reads the blocks of a window's stripes alone: their runs are fetched first (a row a block) and reach the scan of the cells as literals."""
    blocks = directory(tables, orders)

    def read(order: int, rows: list[int], cols: list[int]) -> DataFrame:
        found = blocks.where((F.col("res_order") == order) & ((within("row_stripe", rows) & within("col_stripe", cols)) | (within("row_stripe", cols) & within("col_stripe", rows))))
        wanted = {(min(x, y), max(x, y)) for x in rows for y in cols}
        listed = [r for r in found.collect() if (r["row_stripe"], r["col_stripe"]) in wanted]
        spark = found.sparkSession
        own = spark.createDataFrame(listed, found.schema)
        bp = F.lit(listed[0]["bp"] if listed else -1)
        sparse = [(r["offset"], r["offset"] + r["length"]) for r in listed if r["offset"] >= 0]
        coo = tables["coo"].where((F.col("bp") == bp) & in_runs("i", sparse))
        dense = tables["dense_blocks"].where((F.col("bp") == bp) & within("i", [-(r["offset"] + 1) for r in listed if r["offset"] < 0]))
        return contacts(own, coo, dense, orders)

    return read


def assemble(tables: dict[str, DataFrame], cells: bool = True) -> Assembly:
    """The assembly that the arrays hold, with the layout they name and no scaffolds. The finest resolution is the least above 0.

    Without ``cells`` the contacts are left out, and the directory of blocks isn't read.
    """
    spark = tables["groups"].sparkSession
    orders = _orders(tables["groups"])
    finest = orders.where("bp > 0").agg(F.min("bp")).first()[0]
    info = tables["contig_info"]
    base = info.select(F.lit(0).alias("res_order"), F.col("i").alias("contig_id"), F.col("length_bp").alias("length_bins"), F.lit(1).alias("shown"))
    at = tables["contigs"].join(F.broadcast(orders), "bp").select("res_order", F.col("i").alias("contig_id"), "length_bins", F.col("hide_type").alias("shown"))
    ordered = info.select((F.col("i") + 1).alias("ord"), F.col("ordered_contig_id").alias("contig_id"))
    weights = tables["stripes"].join(F.broadcast(orders), "bp").select("res_order", F.col("i").alias("stripe_id"), F.posexplode("bin_weights").alias("off", "weight"))
    return Assembly(
        resolution=scaled(orders.withColumnRenamed("bp", "bp_resolution"), finest),
        contig=info.select(F.col("i").alias("contig_id"), "name", "length_bp", F.col("name").alias("source_name"), F.lit(0).alias("source_offset")),
        contig_res=base.unionByName(at),
        contig_atu=atus(tables, orders),
        stripe_weight=weights,
        contact=contacts(directory(tables, orders), tables["coo"], tables["dense_blocks"], orders) if cells else spark.createDataFrame([], SCHEMAS["contact"]),
        layout=ordered.join(info.select(F.col("i").alias("contig_id"), F.col("direction").alias("dir")), "contig_id").select("ord", "contig_id", "dir"),
        scaffold=spark.createDataFrame([], "scaffold_id bigint, name string, spacer bigint, start_bp bigint, end_bp bigint"),
        edge=block_edge(tables["groups"]),
        read_blocks=block_reader(tables, orders) if cells else None,
    )
