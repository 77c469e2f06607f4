"""Packed token-id matrices by best-fit decreasing, with cumulative segment lengths and position resets.

Packing happens on the map side over bounded groups of documents, so ids are never shuffled; the tightest open row for a
segment is found by a segment tree over the free capacities.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligamap.llm.shared import sliced
from ligamap.llm.vocab import BYTE_LEVEL

#: Ids of a row, ids of documents that are packed together, the id that ends a document and the one that fills rows.
CAPACITY, GROUP, END_ID, PAD_ID = 2048, 2_000_000, 50256, 50256

#: White space that is cut out before a text is encoded: Unicode's, in runs too long for the library's pattern; and a pattern that takes all.
LONG_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
ANYTHING = r"[\s\S]+"

ROWS = "row_id long, input_ids binary, n_ids int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, starts array<long>, ids_crc32 long"


class Capacities:
    """Open rows by free capacity, in a segment tree that finds the least capacity that is large enough in O(log capacity)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = np.zeros(2 * self.size, np.int64).tolist()
        self.rows: dict[int, list[int]] = defaultdict(list)

    def add(self, free: int, row: int) -> None:
        self.rows[free].append(row)
        self.change(free, 1)

    def change(self, free: int, by: int) -> None:
        at = free + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(free, row) of the tightest row with at least ``least`` free, taken out; None if there is none."""
        at = least + self.size
        if not self.count[at]:
            # Up to the first right neighbour that holds rows, then down its left side.
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        free = at - self.size
        row = self.rows[free].pop()
        self.change(free, -1)
        return free, row


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of segment numbers: longest first, each into the row it fills most; ties in the order given."""
    open_rows, rows = Capacities(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = open_rows.take(lengths[i])
        if found is None:
            rows.append([i])
            free = capacity - lengths[i]
            open_rows.add(free, len(rows) - 1)
        else:
            free, row = found
            rows[row].append(i)
            open_rows.add(free - lengths[i], row)
    return rows


def split(ids: bytes, capacity: int) -> list[tuple[int, bytes]]:
    """(start, ids) of a document's segments of at most ``capacity`` ids; their concatenation is the document."""
    return [(at // 4, ids[at : at + 4 * capacity]) for at in range(0, len(ids), 4 * capacity)]


def encoder(path: str) -> Callable[[str], bytes]:
    """Whole texts to ids by a file of byte-pair ranks; special strings in a text are ordinary text.

    The library's pattern runs out of stack on long white space. Such a run is one pre-token, but for its last character
    where text follows, so it is cut out and encoded as it is.
    """
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder, piece = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (BYTE_LEVEL.pattern, ANYTHING))

    def parts(text: str) -> Iterator[list[int]]:
        at = 0
        for run in LONG_SPACE.finditer(text):
            stop = run.end() - (run.end() < len(text))
            yield coder.encode_ordinary(text[at : run.start()])
            yield piece.encode_ordinary(text[run.start() : stop])
            at = stop
        yield coder.encode_ordinary(text[at:])

    return lambda text: b"".join(np.asarray(ids, dtype="<u4").tobytes() for ids in parts(text))


def packed_rows(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows of exactly ``capacity`` ids, little-endian unsigned 32 bits, that hold the documents' ids and END_ID after each.

    cu_seqlens runs from 0 over the segments' ends; positions restart at each of position_resets, the segments' starts.
    doc_ids and starts name each segment's document and its first id there. ids_crc32 is that of ``input_ids``.
    Unused ids at the end are PAD_ID. A null text is empty and gives END_ID alone. Repeated rows are documents of their
    own, also if they share a doc_id or have none; a document over ``capacity`` takes several segments and loses nothing;
    segments of equal length are placed in the order read; no documents give no rows. Further columns of ``docs``,
    whatever their names, are not read. row_id is unique; it follows from the input's partitions, as do the rows, since
    documents are packed with those near them and ids never shuffled.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = encoder(vocabulary), END_ID.to_bytes(4, "little")
        row_id = TaskContext.get().partitionId() << 33
        segments: list[tuple[int, int, bytes]] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal row_id
            rows = []
            for row in best_fit([len(s[2]) // 4 for s in segments], capacity):
                own = [segments[i] for i in row]
                ends = np.cumsum([0] + [len(s[2]) // 4 for s in own]).tolist()
                packed = b"".join(s[2] for s in own) + PAD_ID.to_bytes(4, "little") * (capacity - ends[-1])
                rows.append((row_id, packed, ends[-1], ends, ends[:-1], [s[0] for s in own], [s[1] for s in own], zlib.crc32(packed)))
                row_id += 1
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            names = ["row_id", "input_ids", "n_ids", "cu_seqlens", "position_resets", "doc_ids", "starts", "ids_crc32"]
            for at in range(0, len(rows), 512):
                columns = zip(*rows[at : at + 512], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in sliced(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start, piece in split(ids(text or "") + end, capacity):
                    segments.append((doc, start, piece))
                    held += len(piece) // 4
                if held >= GROUP:
                    yield from out()
                    segments, held = [], 0
        yield from out()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, ROWS)


def positions(position_resets: list[int], n_ids: int) -> np.ndarray:
    """The position of each id of a row: counted from the last reset."""
    resets = np.asarray(position_resets, dtype=np.int64)
    at = np.arange(n_ids)
    return at - resets[np.searchsorted(resets, at, side="right") - 1]


def write_matrices(rows: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: fixed-width binary rows of a matrix beside their segment columns."""
    rows.write.parquet(path)
