"""Reply trees to conversations: paths from root to leaf by iterative self-joins, each formatted by a chat template.

The self-joins double the reach of a reply's link to an ancestor, so their number grows with the logarithm of the depth.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligamap.llm.shared import materialize, sliced

#: The template: begin and end of a conversation and of a turn, and other templates' marks, which texts mustn't spell either.
BEGIN, END, TURN, TURN_END = "<s>", "</s>", "<|im_start|>", "<|im_end|>"
CONTROLS = (BEGIN, END, TURN, TURN_END, "[INST]", "[/INST]", "<|endoftext|>")
LEARNT = "assistant"

#: A control string, or one with backslashes after its first sign. None holds a backslash or, after its first, a first sign.
CONTROL = re.compile("(" + "|".join(sorted({re.escape(c[0]) for c in CONTROLS})) + r")(\\*)(" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")")
SPOKEN = re.compile(f"{re.escape(TURN)}([^\\n]*)\\n(.*?){re.escape(TURN_END)}\\n", re.S)

#: Conversations and code points after which formatted rows are given away.
BATCH, BATCH_CHARS = 512, 8_000_000


def escaped(text: str) -> str:
    """``text`` without a control string: each gets one backslash more after its first sign."""
    return CONTROL.sub(lambda m: f"{m[1]}\\{m[2]}{m[3]}", text)


def unescaped(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """A conversation of (role, text) as one text, and the spans of it, in code points, that a model learns: assistants' texts."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        head = f"{TURN}{escaped(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
        body = escaped(text)
        if role == LEARNT:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, TURN_END, "\n")
        at += len(head) + len(body) + len(TURN_END) + 1
    return "".join([*parts, END]), spans


def read_turns(text: str) -> list[tuple[str, str]]:
    """The turns that ``formatted`` wrote."""
    line = lambda m: "\n" if m[0] == "\\n" else "\\"
    return [(re.sub(r"\\n|\\\\", line, unescaped(m[1])), unescaped(m[2])) for m in SPOKEN.finditer(text)]


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def best_replies(messages: DataFrame, branches: int) -> DataFrame:
    """Replies that aren't among the ``branches`` of highest score to their message (equal scores: least id; null: last).

    Each task ranks its own first, so that a message with very many replies meets few rows of each.
    """
    by_score = Window.partitionBy("tree", "parent").orderBy(F.desc_nulls_last("score"), "id")
    replies = messages.where("parent is not null").select("tree", "parent", "id", "score")
    best = replies.withColumn("_rank", F.row_number().over(by_score)).where(F.col("_rank") <= branches).select(F.col("tree").alias("_tree"), F.col("id").alias("_id"))
    return replies.join(best, _same("tree", "_tree") & (F.col("id") == F.col("_id")), "left_anti").select("tree", "id")


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """``messages`` (tree, id, parent, score), written -> (tree, leaf, node, above): each path's nodes by their distance from its leaf.

    A message whose parent isn't in its tree is a root. With ``branches`` only so many replies to a message are followed,
    those of the highest scores. Messages on a circle of replies, and below one, have no root and lie on no path. Ids are
    unique in a tree and not null; a null tree is a tree.
    """
    every = messages.select("tree", "id", "parent")
    known = every.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"))
    links = every.where("parent is not null").join(known, _same("tree", "_tree") & (F.col("parent") == F.col("_id"))).select("tree", "id", F.col("parent").alias("up"))
    dropped = None
    if branches is not None:
        dropped = materialize(best_replies(messages, branches))
        gone = dropped.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"))
        links = links.join(gone, _same("tree", "_tree") & (F.col("id") == F.col("_id")), "left_anti")
    # reach[k]: each message with its ancestor 2^k replies above. A circle never runs out of ancestors.
    reach = [materialize(links)]
    total = every.count()
    circle = None
    while (n := reach[-1].count()) > 0:
        if 1 << (len(reach) - 1) > total:
            circle = reach[-1].select("tree", "id")
            break
        above = reach[-1].select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("up").alias("_up"))
        reach.append(materialize(reach[-1].join(above, _same("tree", "_tree") & (F.col("up") == F.col("_id"))).select("tree", "id", F.col("_up").alias("up"))))
    answered = reach[0].select(F.col("tree").alias("_tree"), F.col("up").alias("_id")).distinct()
    found = every.join(answered, _same("tree", "_tree") & (F.col("id") == F.col("_id")), "left_anti").select("tree", F.col("id").alias("leaf"))
    if circle is not None:
        lost = circle.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"))
        found = found.join(lost, _same("tree", "_tree") & (F.col("leaf") == F.col("_id")), "left_anti")
        reach = [r.join(lost, _same("tree", "_tree") & (F.col("id") == F.col("_id")), "left_anti") for r in reach]
    found = found.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    # From the longest step down, so that only few of a path's nodes are there before the last steps.
    for k, step in reversed(list(enumerate(reach))):
        up = step.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), "up")
        far = F.struct(F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        both = F.when(F.col("up").isNull(), F.array(F.struct("node", "above"))).otherwise(F.array(F.struct("node", "above"), far))
        found = found.join(up, _same("tree", "_tree") & (F.col("node") == F.col("_id")), "left").select("tree", "leaf", F.explode(both).alias("x")).select("tree", "leaf", "x.*")
    if dropped is None:
        return found
    # A path that ends at a reply that isn't followed is no path.
    found = materialize(found)
    gone = dropped.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"))
    ended = found.join(gone, _same("tree", "_tree") & (F.col("node") == F.col("_id"))).select("_tree", F.col("leaf").alias("_leaf"))
    return found.join(ended, _same("tree", "_tree") & (F.col("leaf") == F.col("_leaf")), "left_anti")


CONVERSATIONS = "tree long, leaf long, text string, loss_spans array<struct<start:int,stop:int>>"


def format_paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """``messages`` (tree, id, parent, role, text, score) -> (tree, leaf, text, loss_spans): a conversation for each path of replies.

    ``tree``, ``id`` and ``parent`` are whole numbers. Null roles and texts are empty; further columns aren't read; an
    empty table gives no rows. Texts of any length are kept whole; a conversation is one string, so it must fit in one
    row (2 GB), and a task holds one at a time.
    """
    written = materialize(messages.select(*(F.col(c).cast("long").alias(c) for c in ("tree", "id", "parent")), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")), F.col("score").cast("double").alias("score")))
    texts = written.select(F.col("tree").alias("_tree"), "id", "role", "text")
    said = paths(written, branches).join(texts, _same("tree", "_tree") & (F.col("node") == F.col("id")))
    in_order = said.select("tree", "leaf", "above", "role", "text").repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", F.desc("above")).drop("above")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tree", "leaf", "text", "loss_spans"])
        key, turns, rows, held = None, [], [], 0

        def close() -> None:
            nonlocal held
            text, spans = formatted(turns)
            rows.append((*key, text, [{"start": a, "stop": b} for a, b in spans]))
            held += len(text)

        for batch in sliced(batches):
            for tree, leaf, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is not None and key != (tree, leaf):
                    close()
                    turns = []
                    if len(rows) >= BATCH or held >= BATCH_CHARS:
                        yield out()
                        rows, held = [], 0
                key = (tree, leaf)
                turns.append((role, text))
        if key is not None:
            close()
            yield out()

    return in_order.mapInArrow(write, CONVERSATIONS)


def turns_as_replies(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees: each row replies to the one before it, by turn, null first.

    Rows with the same turn come by role and text. Rows without a conv_id are a conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn"), role.alias("role"), text.alias("text")).withColumn("id", place.cast("long"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score"))


CHECKED = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(conversations: DataFrame) -> DataFrame:
    """What formatted conversations hold, taken from their text and spans alone: digests of the turns and of what is learnt."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for tree, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns, learnt = hashlib.sha256(), hashlib.sha256()
                n = chars = 0
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for span in spans:
                    piece = unescaped(text[span["start"] : span["stop"]])
                    learnt.update(piece.encode())
                    chars += len(piece)
                rows.append((tree, n, turns.hexdigest(), chars, learnt.hexdigest(), len(text)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return conversations.select("tree", "text", "loss_spans").mapInArrow(read, CHECKED)
