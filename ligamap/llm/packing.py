"""Shortest-pack-first packing of token sequences over the histogram of lengths.

The histogram has at most ``capacity`` rows, whatever the corpus; the packs are planned on it alone and the pieces
find their places by rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ligamap.llm.shared import materialize, salts_for, sliced, with_prefix
from ligamap.llm.vocab import WordEndIds

CAPACITY = 2048
END_ID = 1

#: The least power of two that a document's last piece is cut to. Such lengths fill packs to the end; documents of one and the
#: same length below it, alone, leave a fifth of the packs empty at most.
LEAST_CUT = 512

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts_of(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths that ``length`` is cut to: ``capacity`` as often as it fits, falling powers of two from LEAST_CUT on, then the rest."""
    cuts, left = [capacity] * (length // capacity), length % capacity
    power = 1 << max(0, capacity.bit_length() - 1)
    while power >= LEAST_CUT:
        if left >= power:
            cuts.append(power)
            left -= power
        power //= 2
    return cuts + [left] * (left > 0)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: its ids and the closing id 1, cut as ``cuts_of`` says.

    A null text is empty and gives the closing id alone. Rows are independent, so repeated rows and rows that share a
    doc_id or have none give pieces each. Further columns of ``docs``, whatever their names, are not read.
    ``with_ids`` adds the piece's ids as little-endian unsigned 32-bit bytes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = WordEndIds(vocabulary), END_ID.to_bytes(4, "little")
        for batch in sliced(batches):
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                coded, start = ids.encode(text or "") + end, 0
                for n in cuts_of(len(coded) // 4, capacity):
                    piece = coded[4 * start : 4 * (start + n)]
                    rows.append((doc, start, n, zlib.crc32(piece), len(coded) // 4, *([piece] if with_ids else [])))
                    start += n
            if rows:
                kinds = [pa.int64()] * 5 + [pa.binary()] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns as (times used, [(length, copies), ...]).

    Lengths are placed longest first; each goes to the pack that is shortest so far if it fits there, else to a new one.
    Packs of equal content are one pattern with a count, so the work depends on the lengths and not on the documents.
    """
    open_packs: dict[int, list[list]] = defaultdict(list)  # free room -> [count, content]
    done: list[tuple[int, list[tuple[int, int]]]] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in open_packs if open_packs[r]), default=0)
            if room < length:
                # New packs take as many copies as they hold, so that a frequent length doesn't open a pack for each.
                copies = min(capacity // length, left)
                open_packs[capacity - copies * length].append([left // copies, [(length, copies)]])
                left %= copies
                continue
            count, content = open_packs[room].pop()
            used = min(count, left)
            if used < count:
                open_packs[room].append([count - used, content])
            last, copies = content[-1]
            grown = [*content[:-1], (length, copies + 1)] if last == length else [*content, (length, 1)]
            open_packs[room - length].append([used, grown])
            left -= used
        if open_packs.get(0):
            done += [(count, content) for count, content in open_packs.pop(0)]
    return done + [(count, content) for packs in open_packs.values() for count, content in packs]


def places(packs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), sorted by the first two; the ranks of a length are dealt out in turn."""
    rows, given, sequence = [], defaultdict(int), 0
    for count, content in packs:
        offset = 0
        for length, copies in content:
            for _ in range(copies):
                rows.append((length, given[length], sequence, offset))
                given[length] += count
                offset += length
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _histogram(pieces: DataFrame) -> dict[int, int]:
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows


def padded(packs: list[tuple[int, list[tuple[int, int]]]], capacity: int = CAPACITY) -> float:
    """Share of padding in the packs' sequences."""
    fills = [(count, sum(n * c for n, c in content)) for count, content in packs]
    pads = sum(count * padding(fill, capacity) for count, fill in fills)
    return pads / max(1, pads + sum(count * fill for count, fill in fills))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces as ``token_pieces`` makes them. ``pieces`` is read several times: pass a written table.

    Pieces of equal length are dealt to the places of that length in a fixed order; those that agree in all columns may
    swap. Further columns are kept. An empty table gives an empty result.
    """
    histogram = _histogram(pieces)
    packs = plan_packs(histogram, capacity)
    table = pieces.sparkSession.sparkContext.broadcast(places(packs))
    ranked = with_prefix(pieces, "length", ["doc_id", "start", "ids_crc32"], F.lit(1), salts_for(max(histogram.values(), default=1)), "_rank")
    kept = [f for f in ranked.schema.fields if f.name != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = table.value
        keys = at[:, 0] << 44 | at[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            row = at[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])], names=[*(f.name for f in kept), "sequence_id", "offset"])

    schema = StructType([*kept, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack ``docs`` (``doc_id``, ``text``): one row per piece, see ``token_pieces`` and ``pack``."""
    return pack(materialize(token_pieces(docs, vocabulary, capacity)), capacity)


def padding(fill: int, capacity: int = CAPACITY) -> int:
    """Ids of padding of a sequence: none at a power of two, else up to ``capacity``."""
    return 0 if fill & (fill - 1) == 0 else capacity - fill
