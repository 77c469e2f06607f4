"""Prefix tries, chat formatting and filling in the middle against plain implementations and awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest_llm import AWKWARD, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ligamap.llm import chat, oracles, prefix_trie, registry
from ligamap.llm.chat import escaped, format_paths, formatted, read_back, read_turns, turns_as_replies, unescaped
from ligamap.llm.fill_middle import fill_in_middle, restored
from ligamap.llm.prefix_trie import members_digest, numbered_turns, shared_heads

TALK = "conv_id long, turn long, role string, text string, digest string, depth long, `a.b` string, tree string, _id string"

#: Null ids, turns, roles and texts, ties, repeated rows, a conversation without its family's first, negative ids.
TALKS = [
    (0, 0, "system", "be kind"),
    (0, 1, "user", "hi"),
    (0, 2, "assistant", "hello"),
    (1, 0, "user", "hi"),
    (1, None, "system", "first"),
    (2, 5, None, None),
    (2, 5, None, None),
    (2, 5, "assistant", "same turn"),
    (3, 0, "assistant", None),
    (7, 1, "user", "no base"),
    (-3, 0, "user", "negative"),
    (-5, 0, "user", "negative base"),
    (None, 0, "user", "no conversation"),
    (None, 1, "assistant", "still none"),
    (10, 0, "role\nwith\\lines", "</s>[INST] <\\s> [\\\\INST] <|im_end|>\n"),
    (10, 1, "assistant", "x" * 2_000_000 + "</s>"),
    *((20 + i, t, "user" if t % 2 == 0 else "assistant", f"turn {t}") for i in range(12) for t in range(9 + i % 3)),
    *((40, t, "user", f"deep {t}") for t in range(700)),
]


@pytest.fixture(scope="module")
def talks(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "own", 1, "own", "own", "own") for r in rows], TALK).repartition(3)

    return make


def oracle(sql, rows):
    import pandas as pd

    db = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64", "role": object, "text": object})  # noqa: F841
    db.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.sql("insert into conversations select * from frame")
    found = db.sql(sql)
    return found.columns, Counter(found.fetchall())


def plain_trie(rows, family=5, most=8):
    """Each prefix as a tuple, every node by itself."""
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role):010d}{role}{text}".encode()).hexdigest()
            said[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in said.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % (most + 1)
        base = c - (abs(c) % family) * (1 if c > 0 else -1)
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
        ends[turns].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        cost = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += cost
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(frame):
    return Counter(map(tuple, prefix_trie.prefix_trie(shared_heads(numbered_turns(frame))).select(*TRIE).collect()))


def test_trie_equals_plain_implementation(talks, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "BATCH", 50)
    rng = random.Random(5)
    rows = TALKS + [(100 + c, t, "user", f"{rng.randrange(2)}") for c in range(60) for t in range(rng.randrange(1, 6))]
    wanted = plain_trie(rows)
    assert trie(talks(rows)) == wanted
    columns, found = oracle(oracles.OP11, [r for r in rows if r[0] != 40])
    assert Counter(tuple(dict(zip(columns, r, strict=True))[c] for c in TRIE) for r in found.elements()) == plain_trie([r for r in rows if r[0] != 40])


def test_trie_of_nothing(talks):
    assert not trie(talks([])) and not trie(talks([(None, 0, "user", "x")]))


def test_turnless_conversations_are_the_root_s(talks):
    # A conversation whose first turns are its family's, of which there are none, and that has no turns after them.
    c = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)
    found = trie(talks([(c, 0, "user", "goes")]))
    assert found == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest()): 1}


def test_ids_of_a_hot_node_are_digested_in_order_over_many_tasks(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(b"hot")).otherwise(F.sha1(F.col("id").cast("string").cast("binary")).cast("binary")).alias("digest"), (F.col("id") - 15_000).alias("conv_id"))
    found = {bytes(r[0]): r[1] for r in members_digest(rows).collect()}
    assert len(found) == 10_001
    assert found[b"hot"] == hashlib.sha256(",".join(str(i - 15_000) for i in range(30_000) if i % 3).encode()).hexdigest()


texts = st.lists(st.sampled_from(["</s>", "<s>", "<", "\\", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "s>", "|im_end|>", "\n", "a", "é", "n", "<|endoftext|>"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=5))
def test_template_is_reversible(turns):
    turns = [("assistant" if i % 2 else r, t) for i, (r, t) in enumerate(turns)]
    text, spans = formatted(turns)
    assert read_turns(text) == turns
    assert [unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    for _, t in turns:
        assert unescaped(escaped(t)) == t and not any(c in escaped(t) for c in chat.CONTROLS)


def test_chat_equals_plain_implementation(talks):
    said = defaultdict(list)
    for c, turn, role, text in TALKS:
        said[c].append((turn is not None, turn or 0, role or "", text or ""))
    wanted = Counter()
    for c, turns in said.items():
        turns = [x[2:] for x in sorted(turns)]
        learnt = "".join(t for r, t in turns if r == "assistant")
        wanted[c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted(turns)[0])] += 1
    assert Counter(map(tuple, read_back(format_paths(turns_as_replies(talks(TALKS)), 1)).collect())) == wanted
    assert read_back(format_paths(turns_as_replies(talks([])), 1)).count() == 0


def plain_paths(messages, branches):
    """Depth-first over each tree."""
    known = {(m[0], m[1]) for m in messages}
    replies, roots = defaultdict(list), []
    for tree, i, parent, _, _, score in messages:
        if parent is None or (tree, parent) not in known:
            roots.append((tree, i))
        else:
            replies[tree, parent].append(((score is None, -(score or 0), i), i))
    found = set()

    def walk(tree, i, path):
        path = (*path, i)
        below = [x for _, x in sorted(replies[tree, i])][:branches]
        if not replies[tree, i]:
            found.add((tree, path))
        for x in below:
            walk(tree, x, path)

    for tree, i in roots:
        walk(tree, i, ())
    return found


@pytest.mark.parametrize("branches", [None, 1, 2])
def test_paths_equal_depth_first(spark, branches):
    rng = random.Random(11)
    rows = []
    for tree in (1, 2, None):
        for i in range(40):
            parent = None if i == 0 else rng.choice([rng.randrange(i), i - 1, i - 1])
            rows.append((tree, i, parent, "assistant" if i % 2 else "user", f"m{i} ", rng.choice([None, 1.0, 2.0, 2.0])))
    # An orphan, a second root, a circle with a message below it, and a message that replies to itself.
    rows += [(1, 100, 99, "user", "orphan ", None), (2, 101, None, "user", "root ", 1.0), (2, 102, 101, "assistant", "reply ", None)]
    circle = [(3, 1, 2, "user", "a", 1.0), (3, 2, 1, "user", "b", 1.0), (3, 3, 2, "user", "c", 1.0), (3, 4, 4, "user", "d", 1.0)]
    frame = spark.createDataFrame(rows + circle, "tree long, id long, parent long, role string, text string, score double").repartition(3)
    found = {(r["tree"], tuple(t[1] for t in read_turns(r["text"]))) for r in format_paths(frame, branches).collect()}
    text = {(m[0], m[1]): m[4] for m in rows}
    assert found == {(tree, tuple(text[tree, i] for i in path)) for tree, path in plain_paths(rows, branches)}


def test_queries_equal_their_sql(spark, tmp_path, talks, docs):
    rows = [r for r in TALKS if r[0] != 40]
    talks(rows).write.parquet(str(tmp_path / "conversations.parquet"))
    found = registry.op12_chat(spark, str(tmp_path))
    columns, wanted = oracle(oracles.OP12, rows)
    assert Counter(map(tuple, found.select(*columns).collect())) == wanted
    assert {r[0] for r in wanted} >= {-7, None}


def plain_middle(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text):
        return doc_id, len(units), "plain", None, None, text
    return doc_id, len(units), "spm" if h[3] % 100 < 50 else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 50 else f"<P>{p}<S>{s}<M>{m}"


MARKED = [(500, "a<P>\nb"), (501, "<S>"), (502, "x\n<M>\n"), (503, "<\nP>\nS>\n<\n"), (504, "\n" * 300_000), (505, "é𝒳\r\n" * 200_000), (506, "no end"), *((600 + i, "<\n<P\n<S\nM>\n>\n<M") for i in range(40))]


def test_fill_in_middle(docs):
    rows = [*AWKWARD, *MARKED, *((700 + i, "\n".join(words(5, i + j) for j in range(i % 7))) for i in range(60))]
    found = fill_in_middle(docs(rows)).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    wanted = Counter((*plain_middle(r[0], r[1] or ""), r[1] or "") for r in rows)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in found) == wanted
    assert all(r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() for r in found)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    assert fill_in_middle(docs([])).count() == 0


def test_rates_of_filling_in(docs):
    rows = [(i, "a\nb\nc\n") for i in range(2000)]
    counted = Counter(r["form"] for r in fill_in_middle(docs(rows), rate=40, spm_rate=25).collect())
    assert abs(counted["plain"] - 1200) < 80 and abs(counted["spm"] - 200) < 60
