"""Passages that repeat across documents, by content-defined chunking with a gear rolling hash.

Chunks end where the hash of the last bytes is the least of its surroundings, so an insertion moves the boundaries beside
it only, and no surroundings are without a boundary. A digest is taken of the chunks that make up LEAST bytes from each
boundary on; it belongs to the least document that holds it, and is cut from others. So whatever is cut stands, LEAST
bytes at least in one piece, in one and the same lesser document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ligamap.llm.shared import carried, join_hot, materialize, sliced

#: Of each SPREAD places in turn where a chunk may end, the one of the least hash ends one.
SPREAD = 8

#: Bytes of the shortest passage that is compared and cut, white space counted once; bytes of a word after which each character may end a chunk, for texts without spaces.
LEAST, UNSPACED = 160, 32

SPAN = StructType([StructField("start", LongType()), StructField("end", LongType())])

#: Stands for a null doc_id: such rows come after all others.
NO_ID = (1 << 63) - 1


def _gear() -> np.ndarray:
    """A number for each byte value."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], dtype=np.uint16)


def rolling(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h[i] = 2 * h[i - 1] + gear[byte i] in 16 bits, which hold the last 16 bytes; by doubling the reach four times."""
    h = gear[data]
    for reach in (1, 2, 4, 8):
        moved = h[:-reach] << np.uint16(reach)
        h = h.copy()
        h[reach:] += moved
    return h


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of bytes that aren't ASCII white space."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


class Text(NamedTuple):
    """A text's bytes as they are and with single spaces between words; where its words start in both and end as they are; the passages to compare."""

    raw: bytes
    plain: bytes
    starts: np.ndarray
    ends: np.ndarray
    plain_starts: np.ndarray
    passages: list[tuple[int, int]]


def boundaries(plain: bytes, starts: np.ndarray, ends: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Where chunks end in ``plain``, whose words have these starts and ends: places of least hashes, the last of equal ones, and both ends of the text."""
    data = np.frombuffer(plain, dtype=np.uint8)
    places = ends
    if (long := np.flatnonzero(ends - starts > UNSPACED)).size:
        within = [np.arange(a + UNSPACED, b) for a, b in zip(starts[long], ends[long], strict=True)]
        within = np.concatenate(within)
        places = np.union1d(ends, within[data[within] & 0xC0 != 0x80])
    least = np.zeros(0, np.int64)
    if len(places) >= SPREAD:
        around = np.lib.stride_tricks.sliding_window_view(rolling(data, gear)[places - 1], SPREAD)
        least = places[np.arange(len(around)) + SPREAD - 1 - around[:, ::-1].argmin(axis=1)]
    return np.unique(np.concatenate([[0], least, [len(plain)]]))


def read(text: str, gear: np.ndarray) -> Text:
    """The passages start at each boundary and end at the first that is LEAST bytes on; one more ends with the text."""
    raw = text.encode()
    starts, ends = words_of(np.frombuffer(raw, dtype=np.uint8))
    plain = b" ".join(raw.split())
    plain_ends = np.cumsum(ends - starts + 1) - 1
    plain_starts = plain_ends - (ends - starts)
    passages: list[tuple[int, int]] = []
    if len(plain) >= LEAST:
        at = boundaries(plain, plain_starts, plain_ends, gear)
        to = np.searchsorted(at, at + LEAST)
        own = to < len(at)
        last = at[np.searchsorted(at, len(plain) - LEAST, side="right") - 1]
        passages = sorted({*zip(at[own].tolist(), at[to[own]].tolist(), strict=True), (int(last), len(plain))})
        # The space before a word isn't the passage's.
        passages = [(a + (plain[a] == 32), b) for a, b in passages]
    return Text(raw, plain, starts, ends, plain_starts, passages)


def passage_digests(docs: DataFrame) -> DataFrame:
    """``docs`` (doc, key, text) -> (doc, key, idx, digest) of each passage that is compared of each row's whole text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = _gear()
        for batch in sliced(batches):
            ids, keys, at, digests = [], [], [], []
            for doc, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                known = read(text or "", gear)
                n = len(known.passages)
                digests += [xxhash.xxh3_64_intdigest(known.plain[a:b]) for a, b in known.passages]
                at.append(np.arange(n, dtype=np.int32))
                ids.append(np.full(n, doc, np.int64))
                keys.append(np.full(n, key, np.int64))
            if ids:
                whole = np.array(digests, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in (ids, keys, at)), pa.array(whole)], names=["doc", "key", "idx", "digest"])

    return docs.mapInArrow(scan, "doc long, key long, idx int, digest long")


def cut_passages(text: str, repeated: list[int], gear: np.ndarray) -> tuple[str, list[tuple[int, int]]]:
    """The text without the passages of these numbers, and what goes as (first byte, byte after), with the white space after it."""
    known = read(text, gear)
    spans: list[list[int]] = []
    for i in sorted(repeated):
        first, after = known.passages[i]
        w, x = (int(np.searchsorted(known.plain_starts, p, side="right")) - 1 for p in (first, after - 1))
        a, b = (int(known.starts[v] + p - known.plain_starts[v]) for v, p in ((w, first), (x, after)))
        if b == known.ends[x]:
            b = int(known.starts[x + 1]) if x + 1 < len(known.starts) else len(known.raw)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    kept, at = [], 0
    for a, b in spans:
        kept.append(known.raw[at:a])
        at = b
    return b"".join([*kept, known.raw[at:]]).decode(), [(a, b) for a, b in spans]


def repeated_passages(keyed: DataFrame) -> DataFrame:
    """``keyed`` (doc, key, text) -> (doc, key, repeated): the passages of each text that belong to a lesser document, as an array; texts without any are left out."""
    found = materialize(passage_digests(keyed))
    owned = found.groupBy("digest").agg(F.min("doc").alias("owner"), F.max("doc").alias("other"), F.count("*").alias("n")).where("owner < other")
    owned = materialize(owned.drop("other"))
    return join_hot(found, owned, "digest", "n").where("doc > owner").groupBy("doc", "key").agg(F.collect_set("idx").alias("repeated"))


def _cut(docs: DataFrame) -> DataFrame:
    """(row, removed): ``docs`` as a struct, with the text without repeated passages, and these."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    doc, key, text = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.col("text").cast("string")), F.col("text").cast("string")
    found = repeated_passages(docs.select(doc.alias("doc"), key.alias("key"), text.alias("text")))
    marked = carried(docs, doc=doc, key=key).join(found, ["doc", "key"], "left").select("row", "repeated")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = _gear()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in sliced(batches):
            texts, spans = [], []
            rows = batch.column(0)
            for said, repeated in zip(rows.field("text").to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept, gone = cut_passages(said, repeated, gear) if repeated and said else (said, [])
                texts.append(kept)
                spans.append([{"start": a, "end": b} for a, b in gone])
            own = [pa.array(texts, pa.string()) if f.name == "text" else rows.field(i) for i, f in enumerate(rows.type)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(own, fields=list(rows.type)), pa.array(spans, kind)], names=["row", "removed"])

    done = marked.mapInArrow(cut, StructType([marked.schema["row"], StructField("removed", ArrayType(SPAN))]))
    if "n_chars" not in docs.columns:
        return done
    counted = F.when(F.size("removed") > 0, F.length("row.text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(F.col("row").withField("n_chars", counted).alias("row"), "removed")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``text`` and others) with the repeated passages cut from ``text``, and ``removed``: their (first byte, byte after).

    The passage stays in the document of the least doc_id. Repeats within a document and between rows that
    share a doc_id stay; a null doc_id counts as the greatest, so rows without one share it. Passages are compared without
    regard to the kind and amount of white space; those under LEAST bytes stay. Null texts stay null, repeated rows are
    cut alike. ``n_chars`` is counted again where a text was cut. A column ``removed`` of the input gives way, others keep
    their names and values. Empty in, empty out. Digests have 64 bits.
    """
    done = _cut(docs)
    return done.select(*(F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "removed"), "removed")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut; documents of which no word is left go. Columns may have any names."""
    done = _cut(docs)
    return done.where((F.size("removed") == 0) | F.col("row.text").rlike(r"[^\x20\x09-\x0D]")).select("row.*")
