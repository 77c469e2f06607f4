"""Running sums, islands and look-ups of positions and ranges in many tasks, against plain loops."""

from __future__ import annotations

import contextlib
import io
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F
from test_engine import make

from ligamap.operators import layout, matrix, ranges, scaffolds
from ligamap.sources import agp


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(ranges, "INTERVALS", 5)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 7)
    for module in (layout, matrix):
        monkeypatch.setattr(module, "RANGE_ROWS", 3)


def plan_of(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("formatted")
    return out.getvalue()


def disjoint(rng, n):
    rows, at = [], 0
    for i in range(n):
        at += rng.choice([0, 0, 0, 4])
        end = at + rng.choice([0, 0, 1, 3, 10, 50])
        rows.append((i, at, end))
        at = end
    return rows, at


def test_splitters_and_ranges(spark):
    frame = spark.range(1000).select(F.when(F.col("id") < 400, 77).otherwise(F.col("id")).alias("k")).unionByName(spark.createDataFrame([(None,)], "k long"))
    n, splits = ranges.splitters(frame, "k", 50)
    assert n == 1000 and splits == sorted(set(splits)) and 5 < len(splits) <= 20
    found = frame.select("k", ranges.range_of(F.col("k"), splits).alias("r")).collect()
    assert all(r["r"] == (None if r["k"] is None else sum(s <= r["k"] for s in splits)) for r in found)
    assert ranges.splitters(frame.limit(0), "k", 50) == (0, []) and ranges.splitters(frame, "k", 5000)[1] == []
    n, many = ranges.splitters(spark.range(200_000).withColumnRenamed("id", "k"), "k", 13)
    assert len(many) > 12_000 and spark.range(3).select(ranges.range_of(F.lit(100_000), many)).first()[0] == sum(s <= 100_000 for s in many)


def test_running_sums_and_islands(spark):
    rng = random.Random(2)
    rows = [(i * 3, rng.randrange(3), rng.randrange(2)) for i in range(500)]
    frame = spark.createDataFrame(rows, "k long, v long, g long").repartition(5)
    splits = ranges.splitters(frame, "k", 7)[1]
    assert len(splits) > 30
    sums, island = list(accumulate(v for _, v, _ in rows)), []
    for i, r in enumerate(rows):
        island.append(1 if i == 0 else island[-1] + (rows[i - 1][2] != r[2]))
    for s in (splits, []):
        got = ranges.running(frame, "k", {"sum": F.col("v"), "n": F.lit(1)}, s).orderBy("k").collect()
        assert [(r["sum"], r["n"]) for r in got] == list(zip(sums, range(1, 501), strict=True))
        got = ranges.islands(frame, "k", F.col("g") == F.col("last_g"), ["g"], s).orderBy("k").collect()
        assert [r["island"] for r in got] == island and got[0].asDict().keys() == {"k", "v", "g", "island"}
    # No exchange brings all rows to one partition: the windows over everything are over a row a range.
    plan = plan_of(ranges.running(frame, "k", {"sum": F.col("v")}, splits))
    assert plan.count("SinglePartition") == 1 and plan.index("SinglePartition") > plan.index("HashAggregate")


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_look_ups_equal_plain_loops_and_have_no_nested_loop(spark, small_ranges, monkeypatch, most):
    monkeypatch.setattr(ranges, "SMALL_ROWS", most)
    monkeypatch.setattr("ligamap.schema.SMALL_ROWS", most)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1 if not most else 10 * 1024 * 1024)
    try:
        rng = random.Random(1)
        every, end = disjoint(rng, 200)
        points = [(i, rng.randrange(-5, end + 10)) for i in range(300)] + [(999, None)]
        asked = [(i, lo, lo + rng.choice([0, 1, 5, 100, -3])) for i in range(300) for lo in [rng.randrange(-5, end + 10)]] + [(1000, None, 5), (1001, -9, end + 9)]
        for rows in (every, every[:3], []):
            found = ranges.places(spark.createDataFrame(rows, "k long, s long, e long").repartition(3), "k")
            at = found.at(spark.createDataFrame(points, "i long, x long"), "x", "k")
            assert {r["i"]: r["k"] for r in at.collect()} == {i: next((k for k, s, e in rows if x is not None and s <= x < e), None) for i, x in points}
            given = spark.createDataFrame(asked, "i long, lo long, hi long")
            over = found.over(given, "lo", "hi", "k")
            pairs = sorted((i, k) for i, lo, hi in asked for k, s, e in rows if lo is not None and ((s < hi and e > lo) if e > s else lo <= s < hi))
            assert sorted((r["i"], r["k"]) for r in over.where("lo is not null").collect()) == pairs
            ends = found.ends(given.where("lo is not null"), "lo", "hi", first_k=F.col("first.k"), last_k=F.col("last.k"))
            own = {i: [k for j, k in pairs if j == i] for i, lo, _ in asked if lo is not None}
            assert {r["i"]: (r["first_k"], r["last_k"]) for r in ends.collect()} == {i: (k[0], k[-1]) if k else (None, None) for i, k in own.items()}
            for frame in (at, over, ends) if rows else ():
                plan = plan_of(frame)
                assert "NestedLoop" not in plan and "Cartesian" not in plan
                assert ("SortMergeJoin" in plan or "ShuffledHashJoin" in plan) if not most else "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_layouts_of_many_ranges_equal_those_of_one(spark, monkeypatch, small_ranges):
    rng = random.Random(9)
    bp = [rng.randrange(5, 90) for _ in range(40)]
    order = rng.sample(range(40), 40)
    ends = [0, *accumulate(bp[c] for c in order)]
    given = [(7, "one", 10, ends[2], ends[9]), (8, "two", 20, ends[9], ends[15]), (9, "three", 0, ends[30], ends[31])]

    def said():
        a, _ = make(spark, bp, [rng2.randrange(2) for _ in bp], order, scaffold=given)
        assert len(layout.splits(a)) == (13 if layout.RANGE_ROWS == 3 else 0)
        b = agp.load(a.with_(scaffold=a.scaffold.limit(0)), agp.export(a))
        frames = [
            layout.spans(a),
            layout.positions(a, 1),
            scaffolds.members(a).select("group_no", "scaffold_id", "contig_id"),
            agp.export(a),
            agp.export(a, 5),
            b.layout,
            b.scaffold,
            scaffolds.move(a, 100, 300, 900).layout,
            scaffolds.move(a, 100, 300, 900).scaffold,
            matrix.atus_for_range(a, 1, 3, 60),
            matrix.coalesced(matrix.atus_for_range(a, 1, 3, 60), 57),
        ]
        return [sorted(map(tuple, f.select(*sorted(f.columns)).collect()), key=str) for f in frames]

    rng2 = random.Random(1)
    many = said()
    for module in (layout, matrix, ranges):
        monkeypatch.setattr(module, "RANGE_ROWS", 50_000)
    rng2 = random.Random(1)
    assert said() == many
    assert {c for c, _, i in many[2] if i == 7} == set(order[2:9]) and len({g for _, g, i in many[2] if i == 7}) == 1


def test_ranges_snap_to_contigs_and_scaffolds(spark):
    rng = random.Random(3)
    bp = [30, 52, 9, 38, 21, 17, 60, 5]
    a, _ = make(spark, bp, scaffold=[(7, "s", 10, 30, 91), (8, "t", 10, 150, 167)])
    asked = [(i, lo, lo + rng.randrange(1, 120)) for i in range(60) for lo in [rng.randrange(-10, sum(bp) + 10)]]
    got = {r["i"]: (r["seg_start"], r["seg_end"]) for r in scaffolds.snapped(a, spark.createDataFrame(asked, "i long, lo long, hi long"), "lo", "hi").collect()}
    for i, lo, hi in asked[:12]:
        assert got[i] == (scaffolds._snapped(a, lo, hi) or (None, None))
