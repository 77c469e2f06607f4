"""Edits and sub-matrices against plain Python models of a layout; negative cases; round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ligamap.functions import units
from ligamap.functions.signal import Gradient, Options, parse_colour, signal
from ligamap.operators import layout, matrix, scaffolds, tiles
from ligamap.operators.split import split
from ligamap.plans.service import Service, Stale
from ligamap.schema import SCHEMAS, Assembly
from ligamap.sources import agp, arrays, container, files
from ligamap.sources.derived import as_arrays
from ligamap.operators.ranges import splitters
from ligamap.streaming import gate
from ligamap.streaming.gate import gated, gated_stream

EDGE = 4
SCHEMA_NAMES = {name: [c.split()[0] for c in schema.split(", ")] for name, schema in SCHEMAS.items()}
RES = {0: 0, 1: 10, 2: 40}


def make(spark, lengths_bp, dirs=None, order=None, turned=(), shown=None, seed=1, scaffold=()):
    """An assembly of contigs of the given lengths, and its dense map by storage bin at order 1."""
    n = len(lengths_bp)
    contig = [(i, f"c{i}", bp, f"c{i}", 0) for i, bp in enumerate(lengths_bp)]
    res, atu, weight, at = [(0, i, bp, 1) for i, bp in enumerate(lengths_bp)], [], [], {}
    for o, bp in list(RES.items())[1:]:
        c0 = 0
        for i, size in enumerate(lengths_bp):
            bins = -(-size // bp)
            visible = int(size >= bp) if shown is None else shown[i]
            res.append((o, i, bins, visible))
            at[o, i] = c0
            for seq, t in enumerate(range(c0 // EDGE, (c0 + bins - 1) // EDGE + 1)):
                a, b = max(c0, t * EDGE), min(c0 + bins, (t + 1) * EDGE)
                atu.append((o, i, seq, t, a - t * EDGE, b - t * EDGE, 0 if (o, i, seq) in turned else 1, a - c0))
            c0 += bins
        weight += [(o, b // EDGE, b % EDGE, 1.0 + b) for b in range(c0)]
    size = sum(-(-bp // 10) for bp in lengths_bp)
    rng = np.random.default_rng(seed)
    full = np.triu(rng.integers(0, 3, (size, size)))
    contact = [(1, x // EDGE, y // EDGE, x % EDGE, y % EDGE, int(full[x, y])) for x in range(size) for y in range(x, size) if full[x, y]]
    dirs, order = dirs or [1] * n, order or list(range(n))
    frames = {
        "resolution": units.scaled(spark.createDataFrame(list(RES.items()), "res_order int, bp_resolution bigint"), 10),
        "contig": contig,
        "contig_res": res,
        "contig_atu": atu,
        "stripe_weight": weight,
        "contact": contact,
        "layout": [(k + 1, c, dirs[c]) for k, c in enumerate(order)],
        "scaffold": list(scaffold),
    }
    made = {k: spark.createDataFrame(v, SCHEMAS[k]) if isinstance(v, list) else v for k, v in frames.items()}
    return Assembly(**made, edge=EDGE), full + np.triu(full, 1).T


def listed(a):
    return [(r["contig_id"], r["dir"]) for r in a.layout.orderBy("ord").collect()]


def permutation(lengths_bp, dirs, order, turned=()):
    """Storage bin at each layout position of order 1."""
    starts = np.concatenate([[0], np.cumsum([-(-bp // 10) for bp in lengths_bp])])
    out = []
    for c in order:
        bins, seq, at = [], 0, int(starts[c])
        while at < starts[c + 1]:
            end = min(int(starts[c + 1]), (at // EDGE + 1) * EDGE)
            run = list(range(at, end))
            bins += run[::-1] if (1, c, seq) in turned else run
            at, seq = end, seq + 1
        out += bins if dirs[c] else bins[::-1]
    return np.array(out)


def dense_of(frame, rows, cols):
    out = np.zeros((rows, cols), np.int64)
    for r in frame.collect():
        out[r["i"], r["j"]] = r["v"]
    return out


@pytest.mark.parametrize("window", [(0, 14, 0, 14), (2, 9, 2, 9), (1, 6, 8, 13), (-3, 5, 10, 18), (4, 4, 0, 3), (20, 22, 20, 22)])
def test_submatrix_equals_a_permuted_dense_map(spark, window):
    bp, dirs, order = [30, 52, 9, 38], [1, 0, 1, 0], [2, 1, 3, 0]
    turned = {(1, 1, 1), (1, 3, 0)}
    a, full = make(spark, bp, dirs, order, turned, shown=[1, 1, 1, 1])
    p = permutation(bp, dirs, order, turned)
    wanted = np.zeros((window[1] - window[0], window[3] - window[2]), np.int64)
    for i in range(wanted.shape[0]):
        for j in range(wanted.shape[1]):
            r, c = i + window[0], j + window[2]
            if 0 <= r < len(p) and 0 <= c < len(p):
                wanted[i, j] = full[p[r], p[c]]
    assert (dense_of(matrix.submatrix(a, 1, *window), *wanted.shape) == wanted).all()


def test_hidden_contigs_take_bins_but_no_pixels(spark):
    a, _ = make(spark, [30, 20, 30], shown=[0, 1, 0])
    assert layout.total(a, "pixels", 1) == 2 and layout.total(a, "bins", 1) == 8
    assert [r["contig_id"] for r in layout.visible(a).where("res_order = 1").collect()] == [1]
    edge = layout.edge_contigs(a).where("res_order = 1").first()
    assert (edge["first_id"], edge["last_id"], edge["first_visible"], edge["last_visible"]) == (0, 2, 1, 1)
    assert matrix.submatrix(a, 1, 0, 2, 0, 2).agg(F.max("i")).first()[0] in (None, 0, 1)


def test_atus_of_a_range_sum_up_to_it_before_and_after_coalescing(spark):
    a, _ = make(spark, [100, 52, 38], [0, 1, 0], [1, 0, 2])
    for lo, hi in ((0, 20), (3, 17), (5, 6)):
        units_of = matrix.atus_for_range(a, 1, lo, hi)
        for frame in (units_of, matrix.coalesced(units_of)):
            assert frame.agg(F.sum(F.col("end") - F.col("start"))).first()[0] == min(hi, 20) - lo


def test_edits_follow_a_list_of_contigs(spark):
    rng = random.Random(5)
    bp = [30, 52, 9, 38, 21, 17]
    a, _ = make(spark, bp)
    model = [(i, 1) for i in range(len(bp))]
    for _ in range(6):
        total = sum(bp)
        lo = rng.randrange(total - 1)
        hi = rng.randrange(lo + 1, total + 1)
        starts = [sum(bp[c] for c, _ in model[:k]) for k in range(len(model))]
        seg = [k for k, (c, _) in enumerate(model) if starts[k] < hi and starts[k] + bp[c] > lo]
        if rng.random() < 0.5:
            a = scaffolds.reverse(a, lo, hi)
            model[seg[0] : seg[-1] + 1] = [(c, 1 - d) for c, d in model[seg[0] : seg[-1] + 1][::-1]]
        else:
            target = rng.randrange(total)
            a = scaffolds.move(a, lo, hi, target)
            part, rest = model[seg[0] : seg[-1] + 1], model[: seg[0]] + model[seg[-1] + 1 :]
            k = target - (0 if starts[seg[0]] > target else sum(bp[c] for c, _ in part))
            left = sum(1 for i in range(len(rest)) if sum(bp[c] for c, _ in rest[: i + 1]) <= k)
            model = rest[:left] + part + rest[left:]
        a = a.with_(layout=spark.createDataFrame([(k + 1, c, d) for k, (c, d) in enumerate(listed(a))], SCHEMAS["layout"]))
        assert listed(a) == model


def test_reversing_twice_changes_nothing(spark):
    scaffold = [(1, "s", 10, 30, 82)]
    a, _ = make(spark, [30, 52, 9, 38], scaffold=scaffold)
    twice = scaffolds.reverse(scaffolds.reverse(a, 0, 91), 0, 91)
    assert listed(twice) == listed(a) and [tuple(r) for r in twice.scaffold.collect()] == scaffold


def test_scaffolds_group_merge_and_ungroup(spark):
    a, _ = make(spark, [30, 52, 9, 38], scaffold=[(7, "s", 10, 30, 82)])
    b = scaffolds.group(a, 50, 85, "mine", 5)
    assert [tuple(r) for r in b.scaffold.collect()] == [(1, "mine", 5, 30, 91)]
    assert scaffolds.ungroup(b, 31, 32).scaffold.count() == 0
    assert scaffolds.extend(a, 40, 82) == (30, 82) and scaffolds.extend(a, 0, 30) == (0, 30)
    assert scaffolds.debris(a, 35, 60).scaffold.collect() == a.scaffold.collect()
    moved = scaffolds.debris(a, 0, 91)
    assert listed(moved)[-1] == (2, 1) or moved.scaffold.count() == 2


@pytest.mark.parametrize("direction", [1, 0])
def test_split_drops_one_fine_bin(spark, direction):
    bp, dirs = [30, 95, 38], [1, direction, 0]
    a, full = make(spark, bp, dirs, shown=[1, 1, 1])
    b = split(a, 30 + 41)
    assert layout.total(b) == layout.total(a) - 10 and layout.total(b, "bins", 1) == layout.total(a, "bins", 1) - 1
    assert layout.total(b, "bins", 2) == layout.total(a, "bins", 2)
    p = permutation(bp, dirs, [0, 1, 2])
    p = np.delete(p, 3 + 4)
    assert (dense_of(matrix.submatrix(b, 1, 0, len(p), 0, len(p), "bins"), len(p), len(p)) == full[np.ix_(p, p)]).all()


def test_agp_round_trip(spark, tmp_path):
    a, _ = make(spark, [30, 52, 9, 38], [1, 0, 1, 0], [2, 1, 3, 0], scaffold=[(1, "s", 10, 9, 99)])
    agp.write_lines(agp.export(a), str(tmp_path / "x"))
    lines = agp.read_lines(spark, str(next((tmp_path / "x").glob("*.txt"))))
    b = agp.load(a.with_(scaffold=a.scaffold.limit(0)), lines)
    assert listed(b) == listed(a)
    assert [tuple(r)[1:] for r in b.scaffold.collect()] == [("s", 10, 9, 99)]
    twice = spark.createDataFrame([(1, "a\t1\t30\t1\tW\tc0\t1\t30\t+"), (2, "b\t1\t9\t1\tW\tc2\t1\t9\t+"), (3, "a\t1\t38\t2\tW\tc3\t1\t38\t+")], "line_no int, line string")
    with pytest.raises(ValueError, match="follow each other"):
        agp.load(a, twice)
    with pytest.raises(ValueError, match="line 1: columns"):
        agp.load(a, spark.createDataFrame([(1, "")], "line_no int, line string"))


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    rng = random.Random(2)
    texts = {"a.agp": "".join("x" * rng.randrange(40) + rng.choice(["\n", "\r\n"]) for _ in range(900)), "b.agp": "one\n\nthree", "c.agp": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        lines = lambda text: [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")] if text else []
        one = agp.read_lines(spark, str(tmp_path / "a.agp"))
        assert one.rdd.getNumPartitions() > 10
        assert [r["line"] for r in one.orderBy("line_no").collect()] == lines(texts["a.agp"])
        every = agp.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
        assert [r["line_no"] for r in every] == list(range(1, len(every) + 1)) and [r["line"] for r in every] == [x for t in texts.values() for x in lines(t)]
        numbered = spark.createDataFrame([(k, f"line {k}") for k in rng.sample(range(1, 3001), 3000)], "line_no int, line string")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        agp.write_lines(numbered, str(tmp_path / "out"))
        files = sorted((tmp_path / "out").glob("part-*"))
        assert len(files) == 4 and "".join(f.read_text() for f in files) == "".join(f"line {k}\n" for k in range(1, 3001))
        assert [tuple(r) for r in agp.read_lines(spark, str(tmp_path / "out")).orderBy("line_no").collect()] == [(k, f"line {k}") for k in range(1, 3001)]
    finally:
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.adaptive.coalescePartitions.enabled"):
            spark.conf.unset(name)


def test_dataset_round_trip_and_service(spark, tmp_path):
    a, full = make(spark, [100, 60], scaffold=[(1, "s", 10, 0, 100)])
    container.save(a, str(tmp_path / "set"))
    (tmp_path / "y.AGP").write_text("x")
    s = Service(spark, str(tmp_path), tile_size=8)
    assert s.open("set")["resolutions"] == [40, 10] and s.list_agp_files() == ["y.AGP"]
    assert (dense_of(matrix.submatrix(container.load(spark, str(tmp_path / "set"), check=True), 1, 0, 16, 0, 16), 16, 16) == full).all()
    tile = s.get_tile(0, 1, 2, 5)
    assert tile["image"].startswith("data:image/png;base64,") and tile["ranges"]["upperBounds"] == {"2": 1.0, "1": 1.0}
    with pytest.raises(Stale):
        s.get_tile(0, 0, 2, 4)
    info = s.reverse_selection_range(0, 160)
    assert [c["contigId"] for c in info["contigDescriptors"]] == [1, 0] and info["scaffoldDescriptors"][0]["scaffoldBordersBP"] == {"startBP": 60, "endBP": 160}
    assert s.get_agp_for_assembly().count("\n") == 2
    assert s.set_visualization_options(s.get_visualization_options()) == s.get_visualization_options()
    assert len(s.split_contig_at_bin(2, 10)["contigDescriptors"]) == 3
    with pytest.raises(ValueError):
        s.open("../elsewhere")
    with pytest.raises(ValueError):
        files.within(str(tmp_path), "../x")


def test_signal_chain_and_colours(spark):
    one = spark.createDataFrame([(9,)], "v bigint")

    def of(options, *rest):
        return one.select(signal(F.col("v"), options, *rest)).first()[0]

    assert of(Options()) == pytest.approx(1.0) and of(Options(pre_log_base=1.0)) == 9.0
    assert of(Options(pre_log_base=0, quad_scaling=True, linear_scaling=True), 1 / 16, 1 / 4) == pytest.approx(9 / 64)
    assert of(Options(pre_log_base=0, post_log_base=2)) == pytest.approx(np.log(10) / np.log(2))
    assert parse_colour("rgba(1,2,3,0,5)") == (1, 2, 3, 127)
    with pytest.raises(ValueError):
        Gradient(lowest=1, highest=1)
    colours = spark.createDataFrame([(float("nan"),), (2.0,)], "s double").select(*Gradient().channels(F.col("s"))).collect()
    assert tuple(colours[0]) == (255, 255, 255, 0) and tuple(colours[1]) == (0, 96, 0, 255)
    image = tiles.png(1, 2, bytes(range(8)))
    assert zlib.decompress(image[41 : 41 + int.from_bytes(image[33:37], "big")]) == b"\0" + bytes(range(8))


def pixels_of(image):
    """Decode a PNG of 8-bit RGBA, unfiltered."""
    cols, rows = (int.from_bytes(image[at : at + 4], "big") for at in (16, 20))
    data = zlib.decompress(image[41 : 41 + int.from_bytes(image[33:37], "big")])
    assert all(data[k * (4 * cols + 1)] == 0 for k in range(rows))
    return b"".join(data[k * (4 * cols + 1) + 1 : (k + 1) * (4 * cols + 1)] for k in range(rows))


@pytest.mark.parametrize("weights", [False, True])
def test_encoded_tiles_equal_tiles_one_by_one(spark, weights):
    a, _ = make(spark, [100, 60, 90], [1, 0, 1], [2, 0, 1])
    # A weight that isn't a number, and colours in which 0 isn't the lowest signal.
    a = a.with_(stripe_weight=a.stripe_weight.withColumn("weight", F.when((F.col("stripe_id") == 2) & (F.col("off") == 1), F.lit(float("nan"))).otherwise(F.col("weight"))))
    options = Options(weights=weights, colours=Gradient(lowest=-0.5, highest=3.0))
    asked = spark.createDataFrame([(r, c) for r in range(4) for c in range(4)] + [(0, 0), (9, 2)], "tile_row bigint, tile_col bigint")
    got = {(r["tile_row"], r["tile_col"]): r for r in tiles.encoded(a, 1, options, 8, asked).collect()}
    assert len(got) == 17
    for row, col in [(0, 0), (0, 1), (1, 0), (2, 3), (3, 3), (9, 2)]:
        wanted = pixels_of(tiles.tile_png(a, 1, 8 * row, 8 * row + 8, 8 * col, 8 * col + 8, options))
        assert pixels_of(got[row, col]["png"]) == wanted and got[row, col]["raster_sha256"] == hashlib.sha256(wanted).hexdigest()
    held = tiles.encoded(a, 1, options, 8).collect()
    assert {(r["tile_row"], r["tile_col"]) for r in held} <= got.keys() and all(got[r["tile_row"], r["tile_col"]]["png"] == r["png"] for r in held)


def test_units(spark):
    names = spark.createDataFrame([("10",), ("x",), ("40",), ("0",)], "name string")
    assert [tuple(r) for r in units.discovered(names).orderBy("res_order").collect()] == [(0, 0), (1, 10), (2, 40)]
    assert units.level_to_order(1, 4) == 3
    with pytest.raises(ValueError):
        units.level_to_order(0, 4)
    assert units.block_edge(spark.createDataFrame([(None,)], "edge int")) == 256


def test_empty_layout(spark):
    a, _ = make(spark, [30, 52])
    a = a.with_(layout=a.layout.limit(0), scaffold=a.scaffold.limit(0))
    assert matrix.submatrix(a, 1, 0, 5, 0, 5).count() == 0 and layout.total(a) == 0 and agp.export(a).count() == 0
    assert scaffolds.reverse(a, 0, 10) is a and scaffolds.group(a, 0, 10) is a and split(a, 5) is a


def test_cells_from_vectors(spark):
    stripes = spark.createDataFrame([(1, 0, [0.5, 1.5])], "res_order int, stripe_id int, bin_weights array<double>")
    cells = spark.createDataFrame([(1, 1, 0, 2, 3, 7), (1, 0, 0, 3, 1, 2)], SCHEMAS["contact"])
    weight, contact = container.from_vectors(spark, stripes, cells)
    assert sorted(tuple(r) for r in weight.collect()) == [(1, 0, 0, 0.5), (1, 0, 1, 1.5)]
    assert sorted(tuple(r) for r in contact.collect()) == [(1, 0, 0, 1, 3, 2), (1, 0, 1, 3, 2, 7)]
    assert matrix.unique_cells(contact).count() == 0


def test_a_tile_of_a_dataset_reads_its_stripes_alone(spark, tmp_path, capsys):
    a, full = make(spark, [400, 300, 500], order=[2, 0, 1], dirs=[1, 0, 1])
    container.save(a, str(tmp_path / "set"))
    opened = container.load(spark, str(tmp_path / "set"))
    tile = matrix.submatrix(opened, 1, 0, 6, 8, 14)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    tile.explain("formatted")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line and "row_stripe" in line]
    assert pushed and all("EqualTo(row_stripe" in line or "GreaterThanOrEqual(row_stripe" in line for line in pushed)
    assert all("EqualTo(col_stripe" in line or "GreaterThanOrEqual(col_stripe" in line for line in pushed)
    assert sorted(map(tuple, tile.collect())) == sorted(map(tuple, matrix.submatrix(a, 1, 0, 6, 8, 14).collect()))
    assert matrix.submatrix(opened, 1, 900, 910, 900, 910).count() == 0


def test_ranges_hold_every_stripe():
    rng = random.Random(5)
    for _ in range(50):
        stripes = rng.sample(range(500), rng.randrange(60))
        found = matrix.ranges(stripes, 7)
        assert len(found) <= 7 and all(sum(a <= s <= b for a, b in found) == 1 for s in stripes)
    assert matrix.ranges([3, 4, 5, 9]) == [(3, 5), (9, 9)] and matrix.ranges([]) == []


def test_import_of_arrays(spark, tmp_path):
    a, full = make(spark, [400, 305, 5, 500], dirs=[1, 0, 1, 0], order=[2, 0, 3, 1], turned={(1, 0, 1), (1, 3, 0)}, shown=[1, 1, 0, 1])
    tables = as_arrays(a, 3)
    for name, frame in tables.items():
        frame.write.parquet(str(tmp_path / name))
    read = arrays.read(spark, str(tmp_path))
    assert read["dense_blocks"].count() > 0 and read["coo"].count() > 0
    b = arrays.assemble(read)
    for name in ("resolution", "contig", "contig_res", "contig_atu", "stripe_weight", "contact", "layout"):
        one, two = getattr(a, name), getattr(b, name)
        assert sorted(map(tuple, one.select(*SCHEMA_NAMES[name]).collect())) == sorted(map(tuple, two.select(*SCHEMA_NAMES[name]).collect())), name
    assert b.edge == EDGE and b.scaffold.count() == 0
    p = permutation([400, 305, 5, 500], [1, 0, 1, 0], [2, 0, 3, 1], {(1, 0, 1), (1, 3, 0)})
    p = np.delete(p, 0)  # the hidden contig has no pixels
    for window in ((0, 9, 0, 9), (3, 14, 60, 75), (100, 119, 0, 5), (500, 505, 500, 505)):
        wanted = full[np.ix_(p[window[0] : window[1]], p[window[2] : window[3]])]
        assert (dense_of(matrix.submatrix(b, 1, *window), *wanted.shape) == wanted).all() if wanted.size else matrix.submatrix(b, 1, *window).count() == 0


@pytest.mark.parametrize("dense_from", [1, 17])
def test_a_tile_of_imported_arrays_reads_its_runs_alone(spark, tmp_path, capsys, dense_from):
    a, _ = make(spark, [400, 305, 500], dirs=[1, 0, 1], order=[2, 0, 1])
    for name, frame in as_arrays(a, dense_from).items():
        frame.write.parquet(str(tmp_path / name))
    b = arrays.assemble(arrays.read(spark, str(tmp_path)))
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    matrix.submatrix(b, 1, 0, 6, 8, 14).explain("formatted")
    plan = capsys.readouterr().out
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [line for line in plan.splitlines() if "PushedFilters" in line and "(i," in line]
    # The cells are read by index and meet broadcast runs where they lie.
    assert len(scans) == 1 and ("GreaterThanOrEqual(i," in scans[0] or "EqualTo(i," in scans[0])
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_runs_are_held_by_ranges(spark):
    rng = random.Random(8)
    for most in (1, 3, 100):
        starts = sorted(rng.sample(range(0, 400, 10), 12))
        runs = [(s, s + rng.randrange(1, 11)) for s in starts]
        found = {r[0] for r in spark.range(450).where(arrays.in_runs("id", runs, most)).collect()}
        assert found >= {i for a, b in runs for i in range(a, b)}
        if most == 100:
            assert found == {i for a, b in runs for i in range(a, b)}
    assert spark.range(5).where(arrays.in_runs("id", [])).count() == 0


def test_endpoints_that_edit(spark, tmp_path):
    a, _ = make(spark, [400, 300, 500, 200], scaffold=[(7, "given", 500, 0, 700)])
    container.save(a, str(tmp_path / "set"))
    service = Service(spark, str(tmp_path))
    service.open("set")
    order = lambda info: [c["contigId"] for c in info["contigDescriptors"]]
    scaffold = lambda info: {s["scaffoldName"]: (s["scaffoldBordersBP"]["startBP"], s["scaffoldBordersBP"]["endBP"]) for s in info["scaffoldDescriptors"]}
    assert scaffold(service.assembly_info()) == {"given": (0, 700)}
    assert scaffold(service.ungroup_contigs_from_scaffold(10, 20)) == {}
    assert scaffold(service.group_contigs_into_scaffold(410, 710, "mine", 30)) == {"mine": (400, 1200)}
    said = service.get_agp_for_assembly()
    (tmp_path / "said.agp").write_text(said)
    assert order(service.move_selection_range(0, 400, 1400)) == [1, 2, 3, 0]
    assert order(service.move_selection_to_debris(810, 990)) == [1, 2, 0, 3]
    back = service.load_agp("said.agp")
    assert order(back) == [0, 1, 2, 3] and scaffold(back)["mine"] == (400, 1200) and service.get_agp_for_assembly() == said


def test_gate(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(50) + i // 4) for i in range(300)]
    high, wanted = None, {}
    for i, v in rows:
        wanted[i] = high is None or v >= high
        high = v if high is None else max(high, v)
    got = {r["request_id"]: r["accepted"] for r in gated(spark.createDataFrame(rows, "request_id bigint, version bigint").repartition(5)).collect()}
    assert got == wanted


def plain_gate(rows):
    """(id, version, accepted) by the requests of lesser ids; null ids come last."""
    out = []
    for i, v in rows:
        before = [w for j, w in rows if w is not None and j is not None and (i is None or j < i)]
        out.append((i, v, v is None or not before or v >= max(before)))
    return sorted(out, key=str)


@pytest.mark.parametrize("to_a_range", [3, 50_000])
def test_gate_with_null_equal_and_far_ids(spark, monkeypatch, to_a_range):
    rng = random.Random(6)
    rows = [(1, 5), (None, 3), (2, 4), (None, 9), (2**60, 1), (-(2**60), 2), (7, None)]
    rows += [(rng.choice([10, 11, rng.randrange(12, 40)]), rng.choice([None, rng.randrange(30)])) for _ in range(200)]
    monkeypatch.setattr(gate, "splitters", lambda frame, key: splitters(frame, key, to_a_range))
    for some in (rows, rows[:4], [(None, 1), (None, 2)], []):
        got = gated(spark.createDataFrame(some, "request_id bigint, version bigint").repartition(4)).collect()
        assert sorted(map(tuple, got), key=str) == plain_gate(some)


def test_gate_over_a_stream_that_is_started_again(spark, tmp_path):
    rng = random.Random(4)
    schema = "key string, request_id bigint, version bigint"
    batch = lambda lo, hi: [(k, rng.randrange(lo, hi), rng.choice([None, rng.randrange(hi)])) for k in "ab" for _ in range(20)]
    told, first, second = batch(0, 10), batch(10, 20), [*batch(20, 30), ("a", None, 3), ("c", None, None), ("c", 5, 1)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", gate.STORE)
    (tmp_path / "in").mkdir()
    seen = spark.createDataFrame(told, schema).groupBy("key").agg(F.max("version").alias("high"))

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = gated_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), seen)
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    run(first)
    run(second)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    for key in "abc":
        wanted = plain_gate([r[1:] for r in told + first + second if r[0] == key])
        for r in plain_gate([r[1:] for r in told if r[0] == key]):
            wanted.remove(r)
        assert sorted((tuple(r[c] for c in ("request_id", "version", "accepted")) for r in got if r["key"] == key), key=str) == wanted
