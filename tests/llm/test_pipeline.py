"""The pipeline's stages on a small corpus: their decisions take effect and each works on what the one before kept."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from conftest_llm import AWKWARD, EXTRA, words

from ligamap.llm.registry import oracle_sql, queries
from ligamap.llm.shared import clean_scratch, materialize, shared_folder


def corpus():
    passage = words(80, 77, "p")
    rows = [(i, words(120, i) + (" vilewort vilewort" if i % 5 == 0 else ""), "en", f"s{i % 4}") for i in range(200)]
    rows += [(300 + i, rows[1][1], "en", "s1") for i in range(20)]
    rows += [(400 + i, f"{words(60, 400 + i)} {passage} {words(60, 500 + i)}", "en", "s2") for i in range(10)]
    labels = [(i, int(i % 5 == 0)) for i in range(200)]
    return rows, labels, passage


def test_stages(spark, docs, tmp_path):
    rows, labels, passage = corpus()
    made = docs(rows)
    made.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = made, {}
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)))
        kept[name] = now
        if name != "packing":
            assert now.columns == made.columns
            extra = now.select(*(f"`{c}`" for c in EXTRA)).distinct().collect()
            assert [tuple(r) for r in extra] == [tuple(None if c == "_salt" else f"own {c}" for c in EXTRA)]
    ids = {name: {r["doc_id"] for r in kept[name].select("doc_id").collect()} for name in kept}
    assert ids["toxicity"] == {r[0] for r in rows} - {i for i, y in labels if y}
    assert ids["near_duplicates"] == ids["toxicity"] - {300 + i for i in range(20)}
    assert ids["substrings"] == ids["near_duplicates"]
    holders = [r["doc_id"] for r in kept["substrings"].collect() if passage in r["text"]]
    assert holders == [400]
    mixed = Counter()
    for r in kept["mixing"].collect():
        mixed[r["source"]] += len(r["text"].split())
    assert len(mixed) == 4 and max(mixed.values()) > 2 * min(mixed.values())
    assert ids["packing"] <= ids["substrings"] and kept["packing"].count() >= len(ids["packing"])
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substrings", "mixing", "packing"]
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, ran.select("doc_id", "start", "length", "ids_crc32").collect())) == Counter(map(tuple, kept["packing"].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_stages_take_awkward_rows(spark, docs, tmp_path):
    long = [(50, "a" + " \t\n" * 700_000 + "b"), (51, "x" * 2_000_000), (None, words(80, 1)), (None, words(80, 2)), (60, words(80, 3)), (60, words(80, 4))]
    rows = [*AWKWARD, *long]
    for made in (docs(rows), docs([])):
        folder = str(tmp_path / f"{made.count()}")
        made.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 0), (7, 0)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
        assert got <= {r[0] for r in rows}
    kept = [r["text"] for r in corpus_pipeline.near_duplicates(spark, docs(rows), folder).collect()]
    assert {t for _, t in long} <= set(kept)


def test_registry_names_every_operator():
    names = list(queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and set(oracle_sql()) <= set(names)


def test_scratch_is_in_the_shared_folder_and_can_be_removed(spark):
    frame = materialize(spark.range(3))
    assert frame.count() == 3 and all(f.startswith(shared_folder(spark).rstrip("/")) for f in (x.replace("file:///", "file:///") for x in frame.inputFiles()))
    clean_scratch(spark)
