"""What keeps the work of a task bounded as the tables grow."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_engine import EDGE, make, permutation

from ligamap.functions.signal import Options
from ligamap.operators import matrix, ranges, tiles
from ligamap.plans.queries import queries
from ligamap.schema import SCHEMAS
from ligamap.sources import arrays, derived

SF_DIR = "/root/testdata/sf0.001"
NAMES = [c.split()[0] for c in SCHEMAS["contact"].split(", ")]


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_short_runs_meet_the_cells_of_their_chunk_alone(spark, monkeypatch, most):
    monkeypatch.setattr(arrays, "SMALL_ROWS", most)
    monkeypatch.setattr(ranges, "TASK_ROWS", 100)
    rng, at, blocks, coo, wanted = random.Random(3), 0, [], [], []
    for k in range(400):
        length = 150 if k == 7 else rng.randrange(1, 4)
        blocks.append((10, 1, length, at, k, k + 1))
        for i in range(at, at + length):
            coo.append((10, i, i % EDGE, k % EDGE, i + 1))
            wanted.append((1, k, k + 1, i % EDGE, k % EDGE, i + 1))
        at += length + k % 2
        if k % 2:
            coo.append((10, at - 1, 0, 0, 9))  # in no run
    frame = spark.createDataFrame(blocks, "bp bigint, res_order int, length bigint, offset bigint, row_stripe int, col_stripe int")
    found = arrays.contacts(frame, spark.createDataFrame(coo, arrays.TABLES["coo"]), spark.createDataFrame([], arrays.TABLES["dense_blocks"]), spark.createDataFrame([(1, 10)], "res_order int, bp bigint"))
    assert sorted(map(tuple, found.select(*NAMES).collect())) == sorted(wanted)
    if not most:
        assert found.rdd.getNumPartitions() >= ranges.tasks(len(coo)) > 4


@pytest.mark.parametrize("dense_from", [1, 9, 17])
def test_arrays_of_many_ranges_are_without_gaps(spark, monkeypatch, tmp_path, dense_from):
    monkeypatch.setattr(derived, "RANGE_ROWS", 40)
    monkeypatch.setattr(derived, "TASK_ROWS", 120)
    a, _ = make(spark, [400, 305, 500])
    coarse = a.contact.groupBy(F.lit(2).alias("res_order"), *(F.expr(f"{n} div 4").cast("int").alias(n) for n in ("row_stripe", "col_stripe")), *(F.expr(f"({s} % 4 * {EDGE} + {n}) div 4").cast("int").alias(n) for s, n in (("row_stripe", "r"), ("col_stripe", "c")))).agg(F.sum("v").alias("v"))
    a = a.with_(contact=a.contact.unionByName(coarse.select(*NAMES)))
    for name, frame in derived.as_arrays(a, dense_from).items():
        frame.write.parquet(str(tmp_path / name))
    read = arrays.read(spark, str(tmp_path))
    for name, column in (("coo", "i"), ("dense_blocks", "i")):
        for bp in (10, 40):
            found = sorted(r[0] for r in read[name].where(F.col("bp") == bp).select(column).collect())
            assert found == list(range(len(found)))
    ends = [(r["bp"], r["offset"], r["offset"] + r["length"]) for r in read["blocks"].where("offset >= 0").orderBy("bp", "i").collect()]
    assert all(x[0] != y[0] or x[2] == y[1] for x, y in zip(ends, ends[1:], strict=False))
    assert sorted(map(tuple, arrays.assemble(read).contact.select(*NAMES).collect())) == sorted(map(tuple, a.contact.select(*NAMES).collect()))


def test_blocks_and_not_cells_are_dealt_and_numbered(spark, monkeypatch, capsys):
    monkeypatch.setattr(derived, "RANGE_ROWS", 20)
    monkeypatch.setattr(derived, "TASK_ROWS", 120)
    a, _ = make(spark, [400, 305, 500])
    tables = derived.as_arrays(a, EDGE * EDGE + 1)  # no block is dense
    tables["coo"].explain()
    plan = capsys.readouterr().out
    assert 0 <= plan.find("Generate posexplode") < plan.find("Window") < plan.find("Exchange")  # cells are listed after the window over blocks
    in_a_task = [len(rows) for rows in tables["coo"].rdd.glom().collect()]
    largest = tables["blocks"].agg(F.max("length")).first()[0]
    cells = a.contact.count()
    assert sum(in_a_task) == cells and len(in_a_task) <= cells // 120 + 1 and max(in_a_task) < 120 + largest


def test_tiles_are_drawn_in_passes_over_sorted_batches(spark, capsys):
    a, _ = make(spark, [100, 60, 90], [1, 0, 1], [2, 0, 1])
    whole = sorted(map(tuple, tiles.encoded(a, 1, Options(), 8).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a tile goes on over many batches
    try:
        found = tiles.encoded(a, 1, Options(), 8)
        assert sorted(map(tuple, found.collect())) == whole and len({r[:2] for r in whole}) == len(whole) > 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert tiles.encoded(a.with_(contact=a.contact.limit(0)), 1, Options(), 8).count() == 0


@pytest.mark.parametrize("weights", [False, True])
def test_a_row_a_tile_is_moved_to_be_drawn(spark, monkeypatch, capsys, weights):
    a, _ = make(spark, [100, 60, 90], [1, 0, 1], [2, 0, 1])
    a = a.with_(contact=a.contact.coalesce(1))
    options, frame, moved = Options(weights=weights), type(a.contact), []
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, *by: moved.append(self) or repartition(self, *by))
    found = tiles.encoded(a, 1, options, 8)
    tile = {tuple(r[:2]): r["raster_sha256"] for r in found.drop("png").collect()}
    # Without weights a tile across the diagonal is its mirror, which isn't moved.
    assert moved[-1].count() == (len(tile) if weights else sum(r <= c for r, c in tile)) < a.contact.count() / 4
    found.explain()
    assert ("Generate explode(CASE" in capsys.readouterr().out) == weights
    for asked in ([(3, 1)], [(1, 3)], [(2, 2)], [(3, 1), (1, 3), (0, 2), (3, 3), (3, 3)]):
        got = tiles.encoded(a, 1, options, 8, spark.createDataFrame(asked, "tile_row int, tile_col int")).collect()
        assert {tuple(r[:2]): r["raster_sha256"] for r in got} == {x: tile[x] for x in asked} and len(got) == len(set(asked))


def test_tile_sums_need_one_exchange(spark, capsys):
    lengths, dirs, order = [400, 305, 500], [1, 0, 1], [2, 0, 1]
    a, full = make(spark, lengths, dirs, order)
    p = permutation(lengths, dirs, order)
    moved = full[np.ix_(p, p)]
    found = matrix.tile_stats(a, [1], 8)
    wanted = []
    for i in range(0, len(moved), 8):
        for j in range(0, len(moved), 8):
            held = moved[i : i + 8, j : j + 8]
            if held.any():
                held = held[held > 0]
                wanted.append((1, i // 8, j // 8, held.size, held.min(), held.max(), held.sum()))
    assert sorted(map(tuple, found.collect())) == wanted
    found.explain()
    assert capsys.readouterr().out.split("== Initial Plan ==")[0].count("Exchange hashpartitioning(res_order") == 1


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_contacts_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(ranges, "TASK_ROWS", 500)
    n = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    for orders in ((1,), (1, 2, 3)):
        contact = derived.derive(spark, SF_DIR, contact_orders=orders).contact
        assert contact.rdd.getNumPartitions() == ranges.tasks(2 * n * len(orders)) > 20
    # A block's cells meet in one task, so its directory needs no other exchange.
    assert queries()["block_directory"](spark, SF_DIR).rdd.getNumPartitions() == ranges.tasks(2 * n)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")
def test_weights_are_dealt_by_the_number_of_parts(spark, monkeypatch):
    monkeypatch.setattr(ranges, "TASK_ROWS", 20)
    n = spark.read.parquet(f"{SF_DIR}/part.parquet").count()
    assert derived.derive(spark, SF_DIR).stripe_weight.rdd.getNumPartitions() == 3 * ranges.tasks(n) > 20
