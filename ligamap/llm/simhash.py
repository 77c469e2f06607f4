"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r every bit gets a nonzero code of r + 1 bits, and table v keeps the bits whose code has an odd inner product
with v. Any r differing bits have codes that some nonzero v is orthogonal to, so two fingerprints within the radius agree
in at least one of the 2^(r+1) - 1 tables: no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligamap.llm.components import components
from ligamap.llm.shared import carried, join_hot, materialize, sliced

RADIUS = 2
WORDS = 3
SEED = 42

#: Fingerprints of a bucket that are compared with each other; larger buckets meet over shared neighbours instead.
PAIRWISE = 32


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is set if it is in over half of the shingles' hashes. No words give 0, under three words one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(WORDS)), strict=False) if len(words) >= WORDS else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), dtype="<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096]
        set_bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a BIGINT of the same bits; a null text has no words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The masks of the 2^(radius+1) - 1 tables, as signed 64-bit numbers."""
    codes = [1 + i % ((2 << radius) - 1) for i in range(bits)]
    masks = [sum(1 << i for i, c in enumerate(codes) if (c & v).bit_count() % 2) for v in range(1, 2 << radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links_within(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fps`` (fp), distinct -> links (a, b) whose components are those of all pairs within ``radius`` (1 or 2) bits.

    Buckets of up to ``PAIRWISE`` fingerprints are compared pair by pair. In a larger bucket every fingerprint goes to
    itself and to its neighbours at one differing free bit of the table; two fingerprints are within two bits there
    exactly if they share such a meeting point, where all are linked with the least. Links grow with the
    fingerprints, not with their pairs, and none is lost.
    """
    assert radius in (1, 2), "meeting points one bit away cover a radius of 1 or 2"
    masks = covering_masks(radius)
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)))).alias("k")
    buckets = fps.select("fp", keys).select("k.t", "k.key", "fp")
    shared = buckets.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = materialize(buckets.join(shared, ["t", "key"]))

    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius
    small = rows.where(F.col("n") <= PAIRWISE).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = small.select(F.explode("fps").alias("x"), "fps").select("x", F.explode("fps").alias("y")).where((F.col("x") < F.col("y")) & near)

    def free(mask: int) -> Column:
        flips = [1 << i for i in range(64) if not mask >> i & 1]
        return F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(b - (1 << 64) if b >> 63 else b)) for b in flips))

    spots = F.when(F.col("t") == 0, free(masks[0]))
    for t, m in enumerate(masks[1:], 1):
        spots = spots.when(F.col("t") == t, free(m))
    meet = rows.where(F.col("n") > PAIRWISE).select("fp", F.explode(spots).alias("spot")).distinct()
    least = meet.groupBy("spot").agg(F.min("fp").alias("y"), F.count("*").alias("n")).where("n > 1").drop("n")
    hubs = meet.join(least, "spot").where("fp <> y").select(F.col("fp").alias("x"), "y")
    return pairs.unionByName(hubs).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (doc_id, fp), written -> (fp, n, root, component_id): for each fingerprint its rows, the least fingerprint and the least doc_id reachable."""
    each = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(links_within(each.select("fp"), radius))
    grouped = materialize(each.join(roots, each["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")))
    sizes = materialize(grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")))
    return materialize(join_hot(grouped.drop("least"), sizes, "root", "fps"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs`` (``doc_id``, ``text``): the least doc_id reachable over fingerprints within ``radius``.

    Null and empty texts share fingerprint 0 and are linked like any other. Repeated rows each appear. A null doc_id is
    kept, never chosen as an id of a component that has another, and null where there is none. Empty in, empty out.
    Further columns of ``docs``, whatever their names, are not read.
    """
    rows = materialize(fingerprints(docs))
    return join_hot(rows, _components(rows, radius).drop("root"), "fp", "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least doc_id, null last; of rows that share it, the one least by a hash of the text.

    Rows are told apart by their place in a written copy, not by doc_id: a row whose text is like no other stays, also if
    its doc_id is null or repeated, and of rows that are alike in all columns one stays. Columns may have any names.
    """
    numbered = materialize(carried(docs, place=F.monotonically_increasing_id()))
    text = F.col("row.text").cast("string")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(fps)], names=["place", "doc_id", "key", "fp"])

    rows = materialize(numbered.select("place", F.col("row.doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key")).mapInArrow(scan, "place long, doc_id long, key long, fp long"))
    found = join_hot(rows, _components(rows, radius).drop("component_id"), "fp", "n")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "place")).alias("first")
    chosen = found.groupBy("root").agg(first).select(F.col("first.place").alias("place"))
    return numbered.join(chosen, "place", "left_semi").select("row.*")
