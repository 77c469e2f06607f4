"""Named queries over the derived assembly, one for each operator; windows and ranges scale with the layout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ligamap.functions import units
from ligamap.functions.signal import Gradient, Options, colour_of
from ligamap.operators import edits, layout, matrix, scaffolds, tiles
from ligamap.operators.split import split
from ligamap.plans import documents
from ligamap.schema import Assembly
from ligamap.sources import agp, arrays, container, files, requests, versions
from ligamap.sources.derived import EDGE, as_arrays, derive
from ligamap.streaming.gate import gated

Query = Callable[[SparkSession, str], DataFrame]
WINDOW = (37, 150, 37, 150)
SMALL = (37, 69, 37, 69)

#: One line for each error of the format, with one good line at the end.
BAD_AGP = [
    "o\t1\t10\t1\tW\tctg_0\t1\t10",
    "o\t1\t10\t1\tX\tctg_0\t1\t10\t+",
    "o\t1\t10\t1\tW\tctg_0\t1\t10\t*",
    "o\t11\t20\t2\tN\t10\tfoo\tyes\tproximity_ligation",
    "o\t11\t20\t2\tN\t10\tscaffold\tmaybe\tproximity_ligation",
    "o\t11\t20\t2\tN\t10\tscaffold\tyes\tguess",
    "o\t1\t10\t1\tW\tnone\t1\t10\t+",
    "o\t1\t11\t1\tW\tctg_0\t1\t10\t+",
    "o\t1\t20\t1\tW\tctg_0\t1\t20\t+",
    "o\t1\t10\t1\tW\tctg_2\t1\t10\t+",
    "",
    "# a comment",
    "o\t1\t29\t1\tW\tctg_1\t1\t29\t-",
]


def _range(a: Assembly) -> tuple[int, int, int]:
    t = layout.total(a)
    return t, t // 5, t // 2


def _asked(spark: SparkSession, name: str, values: list[int]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} bigint")


def _sized(a: Assembly) -> DataFrame:
    """The resolutions with the bins of the map at each."""
    return a.resolution.join(a.contig_res.groupBy("res_order").agg(F.sum("length_bins").alias("bins")), "res_order")


def resolutions(s, d):
    return _sized(derive(s, d))


def resolution_lower_bound(s, d):
    asked = s.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") * 7 % 200).alias("requested_bp")).distinct()
    return units.at_least(derive(s, d).resolution, asked)


def pixel_ratios(s, d):
    r = _sized(derive(s, d)).where("res_order > 0")
    return r.select("bp_resolution", "bins", (F.col("bp_resolution") / F.min("bp_resolution").over(Window.partitionBy())).alias("ratio"))  # a row a resolution


def contig_lengths_units(s, d):
    return units.lengths(derive(s, d))


def matrix_sizes(s, d):
    at = units.lengths(derive(s, d))
    return at.groupBy("res_order").agg(F.sum("bins").alias("bins"), F.sum("pixels").alias("pixels"), F.count("*").alias("contigs"))


def initial_layout(s, d):
    return derive(s, d).layout


def layout_positions(s, d):
    return layout.positions(derive(s, d), 1)


def visible_contigs(s, d):
    return layout.visible(derive(s, d)).select("res_order", "contig_id")


def edge_contigs(s, d):
    return layout.edge_contigs(derive(s, d))


def atu_dictionary(s, d):
    return derive(s, d).contig_atu.select("res_order", "stripe_id", "start", "end", "dir")


def atu_prefix_sums(s, d):
    before = Window.partitionBy("res_order", "contig_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("end") - F.col("start")
    return derive(s, d).contig_atu.select("res_order", "contig_id", "seq", (F.sum(n).over(before) - n).alias("off"))


def expose_range_bp(s, d):
    a = derive(s, d)
    _, lo, hi = _range(a)
    return layout.expose(layout.spans(a), lo, hi).select("part", "contig_id", "ord")


def expose_range_px(s, d):
    a = derive(s, d)
    t = layout.total(a, "pixels", 3)
    return layout.expose(layout.spans(a, "pixels", 3), t // 5, t // 2).select("part", "contig_id", "ord")


def split_by_count(s, d):
    return layout.split_by_count(derive(s, d).layout, 7).select("side", "contig_id")


def convert_units(s, d):
    a, asked, found = derive(s, d), _asked(s, "pos", [0, 5, 11, 57, 123]), None
    for source, goal in ((("bp", 0), ("bins", 1)), (("pixels", 1), ("bp", 0)), (("bins", 2), ("pixels", 1))):
        at = layout.convert(a, asked, *source, *goal).select("pos", *(F.lit(f"{u}@{o}").alias(n) for n, (u, o) in (("from", source), ("to", goal))), "result")
        found = at if found is None else found.unionByName(at)
    return found


def atus_for_range(s, d):
    return matrix.atus_for_range(derive(s, d, reversed_some=True), 1, *WINDOW[:2])


def atus_coalesced(s, d):
    return matrix.coalesced(matrix.atus_for_range(derive(s, d), 2, 0, 60))


def block_directory(s, d):
    return matrix.block_directory(derive(s, d), 1)


def atu_intersection(s, d):
    return matrix.intersection(derive(s, d), 1, (1, 5, 40, 1), (0, 10, 64, 0))


def submatrix_symmetric(s, d):
    return matrix.submatrix(derive(s, d), 1, *WINDOW)


def submatrix_asymmetric(s, d):
    a = derive(s, d)
    t = layout.total(a, "pixels", 1)
    return matrix.submatrix(a, 1, t // 10, t // 10 + 113, t // 2, t // 2 + 97)


def submatrix_padded(s, d):
    a = derive(s, d)
    t = layout.total(a, "pixels", 1)
    return matrix.dense(s, matrix.submatrix(a, 1, -8, 56, t - 40, t + 24), 64, 64)


def submatrix_bins_vs_pixels(s, d):
    a = derive(s, d, contact_orders=(3,))
    return matrix.submatrix(a, 3, 3, 60, 3, 60, "bins").withColumn("mode", F.lit("bins")).unionByName(matrix.submatrix(a, 3, 3, 60, 3, 60).withColumn("mode", F.lit("pixels")))


def submatrix_dense_rows(s, d):
    rows = matrix.dense_rows(matrix.dense(s, matrix.submatrix(derive(s, d), 1, *SMALL), 32, 32))
    return rows.select("i", F.array_join(F.col("row").cast("array<string>"), ",").alias("row"))


def submatrix_reversed_atu(s, d):
    return matrix.submatrix(derive(s, d, reversed_some=True), 1, *WINDOW)


def range_weights(s, d):
    return matrix.range_weights(derive(s, d), 1, *WINDOW[:2]).select("i", F.round("weight", 6).alias("weight"))


def _tile(options: Options, order: int = 1, window: tuple[int, int, int, int] = WINDOW) -> Query:
    def run(s, d):
        a = derive(s, d, contact_orders=(order,))
        return tiles.signals(a, order, *window, options).select("i", "j", F.round("signal", 6).alias("signal"))

    return run


def tile_apply_weights(s, d):
    found = tiles.weighted(derive(s, d), 1, *WINDOW)
    return found.select("i", "j", F.round(F.col("v") * F.col("row_weight") * F.col("col_weight"), 6).alias("signal"))


def tile_rgba(s, d):
    return tiles.colours(derive(s, d), 1, *SMALL, Options(colours=Gradient(highest=2.0)))


def tile_stats(s, d):
    return matrix.tile_stats(derive(s, d), [1], EDGE).drop("res_order")


def tile_grid_coarse(s, d):
    return matrix.tile_stats(derive(s, d, contact_orders=(1, 2, 3)), [1, 2, 3], EDGE).select("res_order", "tile_row", "tile_col", "sum")


def tile_raster(s, d):
    """The pixels of a tile, a row of hexadecimal RGBA for each line."""
    pixel = F.format_string("%02x%02x%02x%02x", "red", "green", "blue", "alpha")
    lines = tile_rgba(s, d).groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", pixel.alias("x")))).alias("line"))
    return lines.select("i", F.array_join(F.col("line.x"), "").alias("pixels"))


def tiles_encoded(s, d):
    """Every tile of the second resolution that holds a cell, encoded; what the images hold, by the raster's digest."""
    a = derive(s, d, contact_orders=(2,))
    return tiles.encoded(a, 2, Options(colours=Gradient(highest=2.0)), EDGE).drop("png")


def resolutions_discovered(s, d):
    """Resolutions among names of groups, some of which aren't numbers."""
    k = F.col("p_partkey")
    names = s.read.parquet(f"{d}/part.parquet").select(F.element_at(F.array((10 * (1 + k % 7)).cast("string"), F.concat(F.lit("res_"), k), F.lit("-5"), F.lit("0")), (1 + k % 4).cast("int")).alias("name"))
    return units.discovered(names).select(F.col("res_order").cast("int").alias("res_order"), "bp_resolution")


def block_edges(s, d):
    """The edge of datasets of which some name one: groups of contigs stand for datasets, their lengths for edges."""
    named = derive(s, d).contig_res.where("res_order = 1").select((F.col("contig_id") % 7).alias("dataset"), F.when(F.col("contig_id") % 7 < 3, F.col("length_bins")).cast("int").alias("edge"))
    return named.groupBy("dataset").agg(units.largest_edge().alias("edge"))


def listed_files(s, d):
    """Names of files by kind."""
    k, found = F.col("p_partkey"), None
    suffix = F.element_at(F.array(*map(F.lit, (".agp", ".FASTA", ".mcool", ".cool", ".txt", ".AGP.gz"))), (1 + k % 6).cast("int"))
    names = s.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("data/"), k, suffix).alias("path"))
    for kind in files.KINDS:
        own = names.where(files.of_kind(F.col("path"), kind)).select(F.lit(kind).alias("kind"), "path")
        found = own if found is None else found.unionByName(own)
    return found


def colours_parsed(s, d):
    """Colours as a client writes them, for each part; some aren't colours."""
    k = F.col("p_partkey")
    alpha = F.element_at(F.array(*map(F.lit, ("1", "0.5", "0,25", "0"))), (1 + k % 4).cast("int"))
    said = F.when(k % 10 == 3, "blue").otherwise(F.concat(F.lit(" rgba( "), k % 256, F.lit(", "), k % 200, F.lit(",17 ,"), alpha, F.lit(")")))
    return s.read.parquet(f"{d}/part.parquet").select(k.alias("k"), colour_of(said).alias("c")).select("k", "c.*")


def _imported(s, d, cells: bool = False) -> Assembly:
    tables = as_arrays(derive(s, d, reversed_some=True), EDGE * EDGE // 50, cells)
    if cells:  # as a container is: on file
        path = container.scratch(s)
        for name, frame in tables.items():
            frame.write.parquet(f"{path}/{name}")
        tables = arrays.read(s, path)
    return arrays.assemble(tables, cells)


def imported_atus(s, d):
    return _imported(s, d).contig_atu


def imported_contacts(s, d):
    return _imported(s, d, cells=True).contact


def imported_layout(s, d):
    return _imported(s, d).layout


def imported_presence(s, d):
    return _imported(s, d).contig_res


def imported_weights(s, d):
    return _imported(s, d).stripe_weight.select("res_order", "stripe_id", "off", F.round("weight", 6).alias("weight"))


def imported_submatrix(s, d):
    return matrix.submatrix(_imported(s, d, cells=True), 1, *WINDOW)


def append_contig(s, d):
    return layout.append(derive(s, d), 999_999, 1)


def _edited(edit: Callable[[Assembly, int, int, int], Assembly], frame: str) -> Query:
    def run(s, d):
        a = derive(s, d)
        t, lo, hi = _range(a)
        return getattr(edit(a, t, lo, hi), frame)

    return run


def scaffold_list(s, d):
    return derive(s, d).scaffold.select("scaffold_id", "name", "start_bp", "end_bp")


def scaffold_at_bp(s, d):
    a = derive(s, d)
    t, lo, hi = _range(a)
    return scaffolds.scaffold_at(a, _asked(s, "bp", [0, lo, hi, t - 1, t]))


def extend_borders(s, d):
    a = derive(s, d)
    _, lo, hi = _range(a)
    return s.createDataFrame([scaffolds.extend(a, lo, hi)], "start_bp bigint, end_bp bigint")


def scaffolds_in_range(s, d):
    a = derive(s, d)
    _, lo, hi = _range(a)
    return scaffolds.overlapping(a, lo, hi).agg(F.count("*").alias("n"))


def contigs_in_scaffolds(s, d):
    return scaffolds.members(derive(s, d)).select("group_no", "scaffold_id", "contig_id")


def _lines(s: SparkSession, d: str, a: Assembly) -> DataFrame:
    """A range of the layout for each order line: (l_orderkey, l_linenumber, lo, hi), some of them of length 0 or past the end."""
    line = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("n"))
    lo = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31 + F.col("l_orderkey")) % (layout.total(a) + 50)
    return line.select("l_orderkey", "l_linenumber", lo.alias("lo"), (lo + (F.col("n") - 1) * (F.col("n") - 1)).alias("hi"))


def ranges_to_contigs(s, d):
    """For each of the lines' ranges its first and last contig and how many it overlaps."""
    a = derive(s, d)
    first, last = F.col("first.ord"), F.col("last.ord")
    return layout.contig_places(a).ends(_lines(s, d, a), "lo", "hi", first_id=F.col("first.contig_id"), last_id=F.col("last.contig_id"), n=F.coalesce(last - first + 1, F.lit(0)).cast("bigint")).drop("lo", "hi")


def ranges_over_contigs(s, d):
    """How many of the lines' ranges overlap each contig, and by how many base pairs in sum."""
    a = derive(s, d)
    met = layout.contig_places(a).over(_lines(s, d, a), "lo", "hi", "contig_id", "s", "e")
    return met.groupBy("contig_id").agg(F.count("*").alias("n"), F.sum(F.least("hi", "e") - F.greatest("lo", "s")).alias("bp"))


def points_in_scaffolds(s, d):
    """The scaffold that holds each line's range's start, and where in it."""
    a = derive(s, d)
    found = scaffolds.scaffold_at(a, _lines(s, d, a).select("l_orderkey", "l_linenumber", F.col("lo").alias("bp")))
    return found.select("l_orderkey", "l_linenumber", "scaffold_id", (F.col("bp") - F.col("start_bp")).alias("off"))


def points_converted(s, d):
    """Each line's range's start in pixels of the second resolution."""
    a = derive(s, d)
    asked = _lines(s, d, a).select("lo").distinct().withColumnRenamed("lo", "pos")
    return layout.convert(a, asked, "bp", 0, "pixels", 2)


def ranges_snapped(s, d):
    """What an edit of each line's range takes: whole contigs, widened to whole scaffolds."""
    a = derive(s, d)
    return scaffolds.snapped(a, _lines(s, d, a), "lo", "hi").drop("lo", "hi")


def edits_composed(s, d):
    """A reversal and a move for each nation, one after the other, in a layout without scaffolds."""
    a = derive(s, d, contact_orders=())
    t = layout.total(a)
    told = []
    for (k,) in s.read.parquet(f"{d}/nation.parquet").select("n_nationkey").orderBy("n_nationkey").collect():
        at = (k * 7919 + 13) % t
        told.append(edits.Reverse(at, at + 1 + k * 104729 % (t // 3)))
        at = (k * 15485863 + 7) % t
        told.append(edits.Move(at, at + 1 + k * 32452843 % (t // 4), k * 49979687 % t))
    return edits.apply(a.with_(scaffold=a.scaffold.limit(0)), told).layout


def requests_decoded(s, d):
    """Bodies made of order lines, some cut off, some without a field, some with a number as text."""
    line = s.read.parquet(f"{d}/lineitem.parquet")
    endpoint = F.element_at(F.array(*(F.lit(e) for e in requests.NEEDED), F.lit("close")), (F.col("l_partkey") % 7 + 1).cast("int"))
    form, at = F.col("l_suppkey") % 9, F.col("l_partkey").cast("bigint")
    start = F.when(form == 2, F.concat(F.lit('"'), at, F.lit('"'))).otherwise(at.cast("string"))
    body = F.concat(
        F.lit("{"),
        F.when(form != 1, F.concat(F.lit('"startBP": '), start, F.lit(', "splitPx": '), at % 100, F.lit(", "))).otherwise(""),
        F.lit('"endBP": '), at + 10, F.lit(', "targetStartBP": '), at * 3, F.lit(', "bpResolution": 10, "scaffoldName": "s'), at % 5, F.lit('", "other": [1]'),
        F.when(form == 0, "").otherwise("}"),
    )
    return requests.decoded(line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("request_id"), endpoint.alias("endpoint"), body.alias("body")))


def edits_from_requests(s, d):
    """The edits of ``edits_composed``, as JSON bodies that Spark decodes."""
    a = derive(s, d, contact_orders=())
    t, k = layout.total(a), F.col("n_nationkey").cast("bigint")
    nation = s.read.parquet(f"{d}/nation.parquet")
    lo = (k * 7919 + 13) % t
    turned = nation.select((2 * k + 1).alias("request_id"), F.lit("reverse_selection_range").alias("endpoint"), F.to_json(F.struct(lo.alias("startBP"), (lo + 1 + k * 104729 % (t // 3)).alias("endBP"))).alias("body"))
    lo = (k * 15485863 + 7) % t
    moved = F.struct(lo.alias("startBP"), (lo + 1 + k * 32452843 % (t // 4)).alias("endBP"), (k * 49979687 % t).alias("targetStartBP"))
    asked = turned.unionByName(nation.select((2 * k + 2).alias("request_id"), F.lit("move_selection_range").alias("endpoint"), F.to_json(moved).alias("body")))
    return edits.apply(a.with_(scaffold=a.scaffold.limit(0)), requests.edits_of(requests.decoded(asked))).layout


def layout_versions(s, d):
    """The layout at three committed versions of a dataset, each opened again: after a reversal, a move and a split."""
    path = container.scratch(s)
    container.save(derive(s, d, contact_orders=()), path)
    base = first = versions.checkout(s, path)
    t, lo, hi = _range(first)
    for number, new in enumerate((scaffolds.reverse(first, lo, hi), scaffolds.move(first, lo, hi, 3 * t // 4), split(first, t // 3))):
        versions.commit(new, base, path, number)
        base = versions.checkout(s, path)
    every = [versions.checkout(s, path, number).layout.withColumn("version", F.lit(number)) for number in (1, 2, 3)]
    return every[0].unionByName(every[1]).unionByName(every[2])


def agp_export(s, d):
    return agp.export(derive(s, d))


def agp_parse(s, d):
    return agp.parse(agp.export(derive(s, d)))


def agp_read_back(s, d):
    """Exported lines, written as text by ranges, read back and parsed."""
    path = container.scratch(s)
    agp.write_lines(agp.export(derive(s, d)), path)
    return agp.parse(agp.read_lines(s, path))


def agp_validate(s, d):
    return agp.validate(s.createDataFrame(list(enumerate(BAD_AGP, 1)), "line_no int, line string"), derive(s, d).contig)


def agp_import_layout(s, d):
    a = derive(s, d)
    return agp.import_layout(agp.parse(agp.export(a)), a.contig)


def agp_import_scaffolds(s, d):
    return agp.import_scaffolds(agp.parse(agp.export(derive(s, d))))


def assembly_json(s, d):
    return documents.assembly(derive(s, d))


def contig_maps(s, d):
    return documents.contig_maps(derive(s, d)).select("contig_id", F.to_json("bins").alias("bins"), F.to_json("shown").alias("shown"))


def opened_json(s, d):
    return documents.opened(derive(s, d))


def version_gate(s, d):
    events = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("version"))
    return gated(events).withColumnRenamed("request_id", "event_id")


def version_gate_shared_ids(s, d):
    """Requests that share ids, lie far off or have none: the lines of an order are one arrival."""
    line = s.read.parquet(f"{d}/lineitem.parquet")
    asked = F.when(F.col("l_linenumber") < 7, F.when(F.col("l_orderkey") % 1000 == 1, F.col("l_orderkey") * 1_000_000_000).otherwise(F.col("l_orderkey")))
    version = F.when(F.col("l_partkey") % 50 > 0, F.expr("l_orderkey div 8") + F.col("l_partkey") % 97)
    return gated(line.select(asked.alias("request_id"), version.cast("bigint").alias("version")))


PLAIN = [
    resolutions, resolution_lower_bound, pixel_ratios, contig_lengths_units, matrix_sizes, initial_layout, layout_positions, visible_contigs, edge_contigs,
    atu_dictionary, atu_prefix_sums, expose_range_bp, expose_range_px, split_by_count, convert_units, atus_for_range, atus_coalesced, block_directory,
    atu_intersection, submatrix_symmetric, submatrix_asymmetric, submatrix_padded, submatrix_bins_vs_pixels, submatrix_dense_rows, submatrix_reversed_atu,
    range_weights, tile_apply_weights, tile_rgba, tile_stats, tile_grid_coarse, append_contig, scaffold_list, scaffold_at_bp, extend_borders, scaffolds_in_range,
    contigs_in_scaffolds, agp_export, agp_parse, agp_validate, agp_import_layout, agp_import_scaffolds, assembly_json, contig_maps, opened_json, version_gate,
    tile_raster, resolutions_discovered, block_edges, listed_files, colours_parsed, imported_atus, imported_contacts, imported_layout, imported_presence, imported_weights,
    imported_submatrix, ranges_to_contigs, ranges_over_contigs, points_in_scaffolds, points_converted, ranges_snapped, edits_composed, requests_decoded, edits_from_requests, layout_versions, version_gate_shared_ids, agp_read_back, tiles_encoded,
]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {f.__name__: f for f in PLAIN}
    found |= {
        "tile_prelog": _tile(Options()),
        "tile_scaled": _tile(Options(quad_scaling=True, linear_scaling=True), 2, (3, 50, 3, 50)),
        "tile_weighted": _tile(Options(weights=True)),
        "tile_postlog": _tile(Options(post_log_base=2.0)),
    }
    edits = {
        "reverse_range": (lambda a, t, lo, hi: scaffolds.reverse(a, lo, hi), "layout"),
        "reverse_scaffolds": (lambda a, t, lo, hi: scaffolds.reverse(a, lo, hi), "scaffold"),
        "move_range_right": (lambda a, t, lo, hi: scaffolds.move(a, lo, hi, 3 * t // 4), "layout"),
        "move_range_left": (lambda a, t, lo, hi: scaffolds.move(a, lo, hi, t // 10), "layout"),
        "move_scaffolds": (lambda a, t, lo, hi: scaffolds.move(a, lo, hi, 3 * t // 4), "scaffold"),
        "scaffold_region": (lambda a, t, lo, hi: scaffolds.group(a, lo, hi), "scaffold"),
        "unscaffold_region": (lambda a, t, lo, hi: scaffolds.ungroup(a, lo, hi), "scaffold"),
        "clear_scaffolds": (lambda a, t, lo, hi: scaffolds.clear(a, lo, hi), "scaffold"),
        "debris_layout": (lambda a, t, lo, hi: scaffolds.debris(a, lo, hi), "layout"),
        "debris_scaffolds": (lambda a, t, lo, hi: scaffolds.debris(a, lo, hi), "scaffold"),
        "split_contig": (lambda a, t, lo, hi: split(a, t // 3), "contig"),
        "split_contig_res": (lambda a, t, lo, hi: split(a, t // 3), "contig_res"),
        "split_contig_atus": (lambda a, t, lo, hi: split(a, t // 3), "contig_atu"),
        "split_contig_layout": (lambda a, t, lo, hi: split(a, t // 3), "layout"),
    }
    return found | {name: _edited(edit, frame) for name, (edit, frame) in edits.items()}
