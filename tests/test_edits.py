"""Lists of edits in one pass against one edit after the other, and committed versions of a dataset."""

from __future__ import annotations

import random
import threading
from itertools import accumulate

import numpy as np
import pytest
from test_engine import listed, make

from ligamap.operators import edits, layout, scaffolds
from ligamap.operators.edits import Move, PlaceMap, Reverse
from ligamap.operators.split import split
from ligamap.plans.service import Service
from ligamap.schema import SCHEMAS
from ligamap.sources import container, requests, versions


def drawn(rng, total):
    out = []
    for _ in range(rng.randrange(1, 13)):
        lo = rng.randrange(-3, total + 3)
        hi = lo + rng.randrange(-2, total)
        out.append(Reverse(lo, hi) if rng.random() < 0.5 else Move(lo, hi, rng.randrange(-5, total + 5)))
    return out


def one_by_one(bp, borders, told):
    """A list of contigs and one of scaffold borders, edited in turn."""
    now, sc = [(i, 1) for i in range(len(bp))], [list(x) for x in borders]
    for edit in told:
        starts = [0, *accumulate(bp[c] for c, _ in now)]
        lo = min((s for s, e in sc if s <= edit.start < e), default=edit.start)
        hi = max((e for s, e in sc if s < edit.end < e), default=edit.end)
        seg = [k for k in range(len(now)) if starts[k] < hi and starts[k + 1] > lo]
        new = now
        if seg:
            a, b = seg[0], seg[-1] + 1
            s, e = starts[a], starts[b]
        if isinstance(edit, Reverse):
            if seg:
                now = now[:a] + [(c, 1 - d) for c, d in reversed(now[a:b])] + now[b:]
                sc = [[s + e - y, s + e - x] if x >= s and y <= e else [x, y] for x, y in sc]
            continue
        if seg:
            k, rest = edit.target - (0 if s > edit.target else e - s), now[:a] + now[b:]
            n = sum(x <= k for x in accumulate(bp[c] for c, _ in rest))
            new = rest[:n] + now[a:b] + rest[n:]
        old = {c: starts[k] for k, (c, _) in enumerate(now)}
        to = {c: x for (c, _), x in zip(new, [0, *accumulate(bp[c] for c, _ in new)], strict=False)}
        held = [next((c for c in old if old[c] <= x < old[c] + bp[c]), None) for x, _ in sc]
        sc = [[x + to[c] - old[c], y + to[c] - old[c]] if c is not None else [-1, -1] for (x, y), c in zip(sc, held, strict=True)]
        now = new
    return now, sc


def test_composed_maps_equal_edits_in_turn():
    rng = random.Random(7)
    for _ in range(400):
        bp = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))]
        ends = [0, *accumulate(bp)]
        at = sorted(rng.sample(ends, min(len(ends), 2 * rng.randrange(0, 3))))
        borders, told = list(zip(at[::2], at[1::2], strict=False)), drawn(rng, sum(bp))
        found = PlaceMap(np.array(ends), np.array([s for s, _ in borders], dtype=np.int64), np.array([e for _, e in borders], dtype=np.int64))
        for edit in told:
            found.apply(edit)
        now = [(c, 0 if turned else 1) for first, past, turned in found.runs for c in (range(first, past)[::-1] if turned else range(first, past))]
        assert (now, [list(x) for x in zip(found.starts.tolist(), found.stops.tolist(), strict=True)]) == one_by_one(bp, borders, told)
        assert len(found.runs) <= 3 * len(told) + 1


def test_a_list_of_edits_equals_the_engine_s_edits_in_turn(spark):
    rng = random.Random(12)
    bp = [30, 52, 9, 38, 21, 17, 60, 5]
    for k in range(4):
        a, _ = make(spark, bp, scaffold=[(7, "s", 10, 30, 91), (8, "t", 10, 150, 167)])
        told = drawn(rng, sum(bp))[:4]
        got, wanted = edits.apply(a, told), a
        for edit in told:
            wanted = scaffolds.reverse(wanted, edit.start, edit.end) if isinstance(edit, Reverse) else scaffolds.move(wanted, edit.start, edit.end, edit.target)
        assert listed(got) == listed(wanted)
        assert sorted(map(tuple, got.scaffold.collect())) == sorted(map(tuple, wanted.scaffold.collect()))


def test_jobs_do_not_grow_with_the_list(spark):
    a, _ = make(spark, [30, 52, 9, 38, 21, 17])
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (2, 60):
        spark.sparkContext.setJobGroup(f"edits {n}", "")
        edits.apply(a, [Reverse(k, k + 40) if k % 2 else Move(k, k + 30, 100 - k) for k in range(n)]).layout.collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"edits {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0]


def test_edits_of_long_or_odd_layouts_are_made_in_turn(spark, monkeypatch):
    a, _ = make(spark, [30, 52, 9, 38])
    told = [Reverse(10, 60), Move(0, 40, 129)]
    wanted = listed(edits.apply(a, told))
    monkeypatch.setattr(edits, "SMALL_ROWS", 3)
    assert edits.composed(a, told) is None and listed(edits.apply(a, told)) == wanted
    assert edits.apply(a, []) is a
    empty = a.with_(layout=a.layout.limit(0))
    assert edits.apply(empty, told).layout.count() == 0


ALL = ("contig", "contig_res", "contig_atu", "layout", "scaffold")


def rows_of(a):
    return {name: sorted((tuple(r) for r in getattr(a, name).select(*(c.split()[0] for c in SCHEMAS[name].split(", "))).collect()), key=str) for name in ALL}


def test_versions_open_as_they_were(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "SNAPSHOT_EVERY", 3)
    path = str(tmp_path / "set")
    container.save(make(spark, [130, 152, 90, 138], scaffold=[(7, "s", 10, 130, 282)])[0], path)
    base = versions.checkout(spark, path)
    kept = [rows_of(base)]
    steps = [
        lambda a: scaffolds.reverse(a, 0, 300),
        lambda a: scaffolds.group(a, 400, 500, "mine", 5),
        lambda a: split(a, 60),
        lambda a: scaffolds.ungroup(a, 0, layout.total(a)),
        lambda a: scaffolds.move(a, 0, 100, 350),
    ]
    for number, step in enumerate(steps):
        new = step(base)
        assert versions.commit(new, base, path, number, f"step {number}") == number + 1
        base = versions.checkout(spark, path)
        assert rows_of(base) == rows_of(new) and base.scaffold_counter == new.scaffold_counter
        kept.append(rows_of(base))
    other = spark.newSession()
    for number, rows in enumerate(kept):
        assert rows_of(versions.checkout(other, path, number)) == rows
    assert [(r["version"], r["snapshot"]) for r in versions.log(spark, path).orderBy("version").collect()] == [(1, False), (2, False), (3, True), (4, False), (5, False)]
    with pytest.raises(ValueError, match="no version 9"):
        versions.checkout(spark, path, 9)
    with pytest.raises(versions.Conflict):
        versions.commit(scaffolds.reverse(base, 0, 100), base, path, 2)
    # Of a frame that an edit leaves alone nothing is written, of one that it changes the changed rows are.
    entry = versions.log(spark, path).where("version = 2").first()
    assert entry["frames"] == ["scaffold"] and spark.read.parquet(f"{path}/versions/data/{entry['folder']}/scaffold").count() == 1


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "set")
    container.save(make(spark, [130, 152, 90])[0], path)
    base = versions.checkout(spark, path)
    ready, outcomes = threading.Barrier(2), []
    put = versions._put
    monkeypatch.setattr(versions, "_put", lambda *a: (ready.wait(60), put(*a))[1])  # both have written their rows

    def write(lo):
        try:
            outcomes.append(versions.commit(scaffolds.reverse(base, lo, lo + 10), base, path, 0, f"from {lo}"))
        except versions.Conflict:
            outcomes.append("conflict")

    threads = [threading.Thread(target=write, args=(lo,)) for lo in (0, 200)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(map(str, outcomes)) == ["1", "conflict"] and versions.log(spark, path).count() == 1


def test_an_entry_is_put_in_place_once(spark, tmp_path):
    (tmp_path / "log").mkdir()
    target = f"file://{tmp_path}/log/1.json"
    assert versions._put(spark, target, "first") and not versions._put(spark, target, "second")
    assert [p.name for p in (tmp_path / "log").iterdir() if not p.name.startswith(".1")] == ["1.json"] and (tmp_path / "log" / "1.json").read_text() == "first"
    # Other file systems rename without overwriting.
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in ("a", "b"):
        (tmp_path / name).write_text(name)
    assert versions._renamed(spark, path(f"file://{tmp_path}/a"), path(f"file://{tmp_path}/c"))
    assert not versions._renamed(spark, path(f"file://{tmp_path}/b"), path(f"file://{tmp_path}/c")) and (tmp_path / "c").read_text() == "a"


def test_the_service_commits_and_opens_versions(spark, tmp_path):
    container.save(make(spark, [100, 60, 80])[0], str(tmp_path / "set"))
    order = lambda info: [c["contigId"] for c in info["contigDescriptors"]]
    one, two = Service(spark, str(tmp_path)), Service(spark, str(tmp_path))
    one.open("set")
    two.open("set")
    assert order(one.apply_edits([{"start": 0, "end": 160}, {"start": 0, "end": 60, "target": 240}])) == [0, 2, 1]
    assert one.commit("turned") == 1 and order(one.assembly_info()) == [0, 2, 1]
    two.reverse_selection_range(0, 240)
    with pytest.raises(versions.Conflict):
        two.commit()
    assert order(two.assembly_info()) == [2, 1, 0]
    again = Service(spark, str(tmp_path))
    again.open("set")
    assert again.committed == 1 and order(again.assembly_info()) == [0, 2, 1] and again.list_versions() == [{"version": 1, "said": "turned"}]
    again.open("set", version=0)
    assert order(again.assembly_info()) == [0, 1, 2]


def test_request_bodies_are_decoded_or_say_what_is_wrong(spark):
    rows = [
        (1, "reverse_selection_range", '{"startBP": 5, "endBP": 9}'),
        (2, "move_selection_range", ' {"endBP": 9, "startBP": 5, "targetStartBP": 40, "more": {"a": 1}}'),
        (2, "move_selection_range", '{"endBP": 9}'),
        (3, "reverse_selection_range", '{"startBP": "5", "endBP": 9}'),
        (4, "reverse_selection_range", '{"startBP": 5, "endBP"'),
        (5, "reverse_selection_range", '[{"startBP": 5, "endBP": 9}]'),
        (6, "reverse_selection_range", None),
        (7, None, "{}"),
        (None, "close", "{}"),
        (8, "group_contigs_into_scaffold", '{"startBP": 1, "endBP": 2, "scaffoldName": null, "spacerLength": 500}'),
        (9, "split_contig_at_bin", '{"splitPx": 1.5, "bpResolution": 10}'),
        (10, "reverse_selection_range", ""),
    ]
    asked = requests.decoded(spark.createDataFrame(rows, "request_id long, endpoint string, body string"))
    got = sorted(((r["request_id"] or 0, r["start"], r["problem"]) for r in asked.collect()), key=str)
    bad = "unreadable body"
    wanted = [(0, None, "unknown endpoint"), (1, 5, None), (2, 5, None), (2, None, "missing startBP, targetStartBP"), (3, None, bad), (4, None, bad), (5, None, bad), (6, None, bad), (7, None, "unknown endpoint"), (8, 1, None), (9, None, bad), (10, None, bad)]
    assert got == sorted(wanted, key=str)
    assert asked.where("request_id = 8").first()["spacer"] == 500
    assert requests.edits_of(asked) == [edits.Reverse(5, 9), edits.Move(5, 9, 40)] and requests.edits_of(asked.limit(0)) == []
