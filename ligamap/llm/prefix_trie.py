"""A trie of conversations' beginnings: chained digests name the prefixes, equal prefixes are a node.

A node's digest is the SHA-256 of its parent's digest and its last turn's, so equal digests mean equal sequences. Texts
are digested where they are read and never shuffled. Every sum over a subtree is a sum over the prefixes of the node:
each conversation gives all its prefixes, which are the ancestors of its nodes, what it holds below them. So a hot node,
such as the root, is summed before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligamap.llm.shared import materialize

#: Conversations that share beginnings: ``FAMILY`` neighbours take up to ``MOST_HEAD`` turns of the first of them.
FAMILY, MOST_HEAD = 5, 8

#: Ids of conversations that are joined to one string before they meet the others of their node, and rows of a batch.
CHUNK, BATCH = 8192, 4096

PREFIXES = "conv_id long, depth long, digest binary, parent binary, n_bytes long, upto long, ends boolean"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_digest, n_bytes): each turn with its place in its conversation from 1 on, by turn, null first.

    Rows without a conv_id belong to no conversation. Rows with the same turn come in the order of their digests, so
    repeated rows keep all their places. Null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.lpad(F.length(role).cast("string"), 10, "0"), role, text).cast("binary"), 256))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("turn_digest"), F.octet_length(text).cast("long").alias("n_bytes")).where("conv_id is not null")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "turn_digest"))
    return rows.select("conv_id", place.cast("long").alias("place"), "turn_digest", "n_bytes")


def shared_heads(turns: DataFrame, family: int = FAMILY, most: int = MOST_HEAD) -> DataFrame:
    """Conversations that begin alike, made of ``turns``, and a row of place 0 for each conversation, turnless ones included.

    Conversation c takes the first h turns of conversation c - c % family (of c itself where that is c), then its own
    after its first h; h is crc32 of its decimal id % (most + 1).
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    ids = turns.select("conv_id").distinct()
    starts = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("_base"), h.alias("_h"))
    heads = turns.where((F.col("conv_id") % family == 0) & (F.col("place") <= most)).withColumnRenamed("conv_id", "_base")
    taken = starts.join(heads, "_base").where("place <= _h").select(*turns.columns)
    roots = ids.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("n_bytes"))
    return taken.unionByName(turns.where(F.col("place") > h)).unionByName(roots)


def prefixes(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation, the empty one included, with its chained digest; ``turns`` has a row of place 0 for each.

    A conversation is read in order and never held: its digest so far is all that is kept.
    """

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "digest", "parent", "n_bytes", "upto", "ends"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()]
        rows: list[tuple] = []
        # The last prefix seen; whether it ends its conversation shows with the next row.
        last: tuple | None = None
        for batch in batches:
            for conv, turn, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new = last is None or last[0] != conv
                if last is not None:
                    rows.append((*last, new))
                if new:
                    last = (conv, 0, hashlib.sha256(b"").digest(), None, 0, 0)
                else:
                    last = (conv, last[1] + 1, hashlib.sha256(last[2] + turn).digest(), last[2], n, last[5] + n)
                if len(rows) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
        if last is not None:
            rows.append((*last, True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    in_order = turns.select("conv_id", "turn_digest", "n_bytes", "place").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return in_order.drop("place").mapInArrow(chain, PREFIXES)


def members_digest(rows: DataFrame) -> DataFrame:
    """``rows`` (digest, conv_id) -> (digest, ends_sha256): SHA-256 of each digest's ids in decimal, ascending, with commas between.

    Ids are joined to strings of up to CHUNK of them where ranges of (digest, conv_id) put them, so that a digest with
    very many ids is spread over tasks; the strings of a digest are then digested one after the other as they are read.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], names=["digest", "first", "ids"])

        for batch in batches:
            for digest, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (digest != now or len(ids) >= CHUNK):
                    yield out()
                    ids = []
                now = digest
                ids.append(conv)
        if ids:
            yield out()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rows = None, None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.string()), strict=True)], names=["digest", "ends_sha256"])
        for batch in batches:
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or digest != now:
                    if state is not None:
                        rows.append((now, state.hexdigest()))
                    now, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
                if len(rows) >= BATCH:
                    yield out()
                    rows = []
        if state is not None:
            rows.append((now, state.hexdigest()))
            yield out()

    spread = rows.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    strings = spread.mapInArrow(joined, "digest binary, first long, ids string")
    return strings.repartition("digest").sortWithinPartitions("digest", "first").drop("first").mapInArrow(digested, "digest binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie over ``turns`` (conv_id, place, turn_digest, n_bytes), with a row of place 0 for each conversation.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest): conv_id is the
    least of the conversations that begin with the node; saved_tokens is what they needn't read again, by bytes of the
    nodes' last texts, summed over the subtree; the other columns are as in the query's contract.

    No conversations give no nodes; conversations without turns are the root's. Written twice: prefixes, then nodes.
    """
    every = materialize(prefixes(turns))
    nodes = materialize(
        every.groupBy("depth", "digest").agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("parent").alias("parent"), F.first("n_bytes").alias("n_bytes"), F.first("upto").alias("upto"), F.bool_and("ends").alias("leaf")
        )
    )
    # The nodes of which a conversation is the least member are the last ones of its path, from a depth on: it owns them.
    owned = nodes.groupBy("conv_id").agg(F.min(F.col("upto") - F.col("n_bytes")).alias("before"), F.sum("n_bytes").alias("own"), F.max(F.col("leaf").cast("long")).alias("leaf"))
    of_conv = every.where("ends").select("conv_id", F.col("upto").alias("whole")).join(owned, "conv_id", "left")
    # At a node, a conversation holds its bytes from there on, and of the bytes it owns those from there on.
    above = F.col("upto") - F.col("n_bytes")
    held = F.col("whole") - above
    own = F.coalesce(F.col("own") - F.greatest(above - F.col("before"), F.lit(0)), F.lit(0))
    below = every.join(of_conv, "conv_id").groupBy("digest").agg(F.sum(held - own).alias("saved_tokens"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    parents = nodes.where("not leaf").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    met = nodes.select("depth", "digest", "conv_id", "n_convs", "parent").join(parents, "parent", "left").join(below, "digest").join(children, "digest", "left").join(members_digest(every.where("ends")), "digest", "left")
    return met.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", _or_zero("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "digest"
    )


def _or_zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("long").alias(column)
