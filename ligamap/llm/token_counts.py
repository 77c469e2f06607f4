"""Token counts of whole texts by a two-tier lookup on the map side.

Tier one is a broadcast table of the token counts of frequent pre-tokens, learnt from a bounded sample; tier two is a
cache in each worker that encodes what the table lacks. Pre-tokens are never shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ligamap.llm.shared import sliced
from ligamap.llm.vocab import BYTE_LEVEL, LONGEST_KEY, Cache, Ids

#: Texts in the sample for the table, about, the most entries of the table and those counted at a time.
SAMPLE_TEXTS, TABLE_ENTRIES, MOST_COUNTED = 4_000, 32_768, 200_000


class Counts(Ids):
    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(path)
        self.lengths = Cache(self.count_piece, 400_000, frequent)
        for piece, n in frequent.items():
            self.lengths[piece] = n

    def count_piece(self, piece: str) -> int:
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def count(self, text: str) -> int:
        if self.odd(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.lengths.__getitem__, BYTE_LEVEL.findall(text)))


def frequent_counts(docs: DataFrame, vocabulary: str) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of about ``SAMPLE_TEXTS`` whole texts, drawn by a hash of the row's place over all partitions.

    The sample only decides which lookups are cheap: every count is the library's, whatever the sample. It is counted
    where it lies; each partition gives its TABLE_ENTRIES most frequent pre-tokens at most.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                seen.update(piece for piece in BYTE_LEVEL.findall(text) if len(piece) <= LONGEST_KEY)
                if len(seen) > MOST_COUNTED:
                    seen = Counter(dict(seen.most_common(TABLE_ENTRIES)))
        best = seen.most_common(TABLE_ENTRIES)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], names=["piece", "n"])

    drawn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(1, docs.count()))) < SAMPLE_TEXTS
    pieces = docs.where(drawn & F.col("text").isNotNull()).select(F.col("text").cast("string")).mapInArrow(frequent, "piece string, n long")
    best = pieces.groupBy("piece").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "piece").limit(TABLE_ENTRIES).collect()
    own = Counts(vocabulary, {})
    return {r["piece"]: own.count_piece(r["piece"]) for r in best}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): UTF-8 bytes, tokens without special tokens, and whether these exceed ``limit``.

    A null text is empty: 0 bytes, 0 tokens. Repeated rows and rows that share a doc_id or have none are counted each; an
    empty table gives an empty result. Further columns of ``docs``, whatever their names, are not read.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_counts(docs, vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(vocabulary, frequent.value)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = [counts.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
