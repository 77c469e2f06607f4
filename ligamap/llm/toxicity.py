"""Toxicity by the nearest labelled examples.

Texts are compared by exact TF-IDF cosine over the terms that tell the labels apart best. The examples stand in a block-max
inverted index: blocks whose bound can't reach the nearest found so far are passed over, which loses nothing. Texts meet
the index many at a time, so that a block's columns are multiplied by all texts that want it at once. The votes are
turned into probabilities by isotonic regression on the examples' own votes, each without itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ligamap.llm.shared import carried, materialize, sliced

#: Labelled examples of each label in the sample that is learnt from, and terms kept.
EXAMPLES, TERMS = 4096, 4096

#: Neighbours that vote (at most BLOCK), those named as evidence, examples of a block, blocks that are searched first, the share of examples (one in so many) that makes a term frequent, the share of texts (one in so many) up to which those that want a block are few, and texts that are searched for together.
NEIGHBOURS, EVIDENCE, BLOCK, FIRST_BLOCKS, FREQUENT, FEW, TOGETHER = 16, 3, 64, 8, 12, 1.25, 128

#: Lengths of word beginnings that are terms beside the words themselves: inflected and compounded forms share them.
STEMS = (4, 5, 6)

WORDS = re.compile(r"[^\W\d_]+")

#: Latin-1 with a space for every character that is in no word.
LETTERS = bytes(i if WORDS.match(chr(i)) else 32 for i in range(256))

NEAR = StructType([StructField("doc_id", LongType()), StructField("cosine", DoubleType()), StructField("toxic", IntegerType())])
SCORE = StructType([StructField("score", DoubleType()), StructField("evidence", ArrayType(NEAR))])


def terms_of(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in STEMS if len(word) > n]


def words_of(text: str) -> list[str]:
    """What WORDS finds in the text in lower case; most texts are Latin-1, which is translated and split at less cost."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(text)


def sample_examples(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Texts of up to EXAMPLES labelled documents of each label, least by a hash of the id, and how many there are of each label.

    Only rows whose crc32(doc_id as text) mod 5 is not 0 are used; of contradictory labels of a document the higher holds.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES) for y in (0, 1)]
    # Bounded: at most 2 * EXAMPLES rows of two numbers. Of texts that share an id one is taken, before anything is shuffled.
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    return materialize(docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))), totals


def ranked_terms(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """Up to TERMS terms by falling log-likelihood ratio between document frequency and label, without a threshold, and their idf."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[y][t] for t in names], pa.int64()) for y in (0, 1))], names=["term", "clean", "toxic"])

        seen = (Counter(), Counter())
        for batch in sliced(batches):
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label].update({t for w in set(words_of(text or "")) for t in terms_of(w)})
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield out(seen)
                    seen = (Counter(), Counter())
        yield out(seen)

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return [], np.zeros(0)
    counts = sample.select("toxic", "text").mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    every = n[0] + n[1]
    df = F.col("clean") + F.col("toxic")
    parts = [F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (df * (n[y] / every)))).otherwise(0.0) for y, c in enumerate(("clean", "toxic"))]
    best = counts.withColumn("ratio", F.round(2 * (parts[0] + parts[1]), 9)).orderBy(F.desc("ratio"), "term").limit(TERMS).collect()
    return [r["term"] for r in best], np.array([math.log((every + 1) / (r["clean"] + r["toxic"] + 1)) + 1 for r in best])


class Vectors:
    """Terms of texts with their counts."""

    def __init__(self, terms: list[str], idf: np.ndarray):
        self.number = {t: i for i, t in enumerate(terms)}
        self.idf = idf
        # A word whose first letters begin no term has no terms; most words have none.
        self.starts = {t.removesuffix("*")[: STEMS[0]] for t in terms}
        self.begins = [(n, {t[:n]: i for t, i in self.number.items() if t.endswith("*") and len(t) == n + 1}) for n in reversed(STEMS)]
        # A word's longest term tells its others, which are beginnings of that one: `shorter` is the next of them, -1 for none.
        self.shorter = np.array([self.longest(t.removesuffix("*")) for t in terms], dtype=np.int64)

    def longest(self, word: str) -> int:
        """The longest of the word's beginnings among the terms, -1 for none."""
        for n, begins in self.begins:
            if len(word) > n:
                found = begins.get(word[:n])
                if found is not None:
                    return found
        return -1

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the text, term number, count), by place and number."""
        n, number, longest, starts, first = len(self.idf), self.number, self.longest, self.starts, STEMS[0]
        own = [(np.zeros(0, np.int64),) * 3]
        for place, text in enumerate(texts):
            # Looked up in small tables: a cache of words is larger than the processor's, and rare words would fill it.
            found = Counter([w for w in words_of(text) if w[:first] in starts])
            numbers = np.fromiter([number[w] if w in number else longest(w) for w in found], np.int64, len(found))
            own.append((np.full(len(found), place), numbers, np.fromiter(found.values(), np.int64, len(found))))
        levels = []
        rows, numbers, counts = (np.concatenate(x) for x in zip(*own, strict=True))
        for _ in range(1 + len(STEMS)):
            rows, counts, numbers = (x[numbers >= 0] for x in (rows, counts, numbers))
            levels.append((rows * n + numbers, counts))
            numbers = self.shorter[numbers]
        keys, which = np.unique(np.concatenate([k for k, _ in levels]), return_inverse=True)
        counts = np.bincount(which, np.concatenate([c for _, c in levels]), len(keys)).astype(np.int64)
        return keys // max(1, n), keys % max(1, n), counts


def unit_weights(idf: np.ndarray, rows: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of the terms of texts, each text's of length 1."""
    weights = (1 + np.log(counts)) * idf[numbers]
    return weights / np.sqrt(np.bincount(rows, weights**2))[rows]


class BlockMaxIndex:
    """Exact nearest examples by cosine. ``rows``: (doc_id, label, term numbers, unit weights), none empty.

    A term's postings are in blocks of examples, each with its highest weight. Terms that many examples hold keep theirs
    as full columns, the others as lists. A block's columns stand together.
    """

    def __init__(self, rows: list[tuple], n_terms: int):
        # Examples with the same leading term stand together: that makes the blocks' bounds tight.
        rows = sorted(rows, key=lambda r: (int(r[2][np.argmax(r[3])]), r[0]))
        self.docs = np.array([r[0] for r in rows], dtype=np.int64)
        self.labels = np.array([r[1] for r in rows], dtype=np.int64)
        self.n_blocks = -(-len(rows) // BLOCK)
        terms = np.concatenate([r[2] for r in rows])
        examples = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        weights = np.concatenate([r[3] for r in rows])
        order = np.argsort(terms * len(rows) + examples)
        terms, examples, weights = terms[order], examples[order], weights[order]
        self.most = np.zeros((n_terms, self.n_blocks))
        np.maximum.at(self.most, (terms, examples // BLOCK), weights)
        # The columns of frequent terms; -1 for the terms that have lists.
        frequent = np.flatnonzero(np.bincount(terms, minlength=n_terms) * FREQUENT >= len(rows))
        self.column = np.full(n_terms, -1)
        self.column[frequent] = np.arange(len(frequent))
        self.columns = np.zeros((self.n_blocks, len(frequent), BLOCK))
        full = self.column[terms] >= 0
        self.columns[examples[full] // BLOCK, self.column[terms[full]], examples[full] % BLOCK] = weights[full]
        # A term's list is from its `first` to that of the next term.
        self.examples, self.weights = examples[~full].astype(np.int32), weights[~full]
        self.first = np.searchsorted(terms[~full], np.arange(n_terms + 1))

    @classmethod
    def of_parts(cls, parts: dict) -> BlockMaxIndex:
        """An index from its arrays (``vars`` of another), which cost nothing to take up."""
        index = cls.__new__(cls)
        vars(index).update(parts)
        return index

    def listed(self, n: int, rows: np.ndarray, numbers: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the lists add to the cosines, by block, text and example."""
        first, many = self.first[numbers], self.first[numbers + 1] - self.first[numbers]
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        blocks, places = np.divmod(self.examples[at], BLOCK)
        cells = (blocks * n + np.repeat(rows, many)) * BLOCK + places
        scores = np.bincount(cells, self.weights[at] * np.repeat(weights, many), self.n_blocks * n * BLOCK)
        return scores.astype(np.float64, copy=False).reshape(self.n_blocks, n, BLOCK)

    def add_columns(self, scores: np.ndarray, texts: np.ndarray, wanted: np.ndarray, done: np.ndarray) -> None:
        """Add what the columns add to the cosines of the texts (a row of weights by column each) in wanted blocks that aren't done yet."""
        for block in np.flatnonzero((wanted & ~done).any(1)):
            who = np.flatnonzero(wanted[block] & ~done[block])
            if len(who) * FEW > len(texts):
                who = np.flatnonzero(~done[block])
            scores[block, who] += texts[who] @ self.columns[block]
            done[block, who] = True

    def nearest_of(self, n: int, rows: np.ndarray, numbers: np.ndarray, weights: np.ndarray, k: int, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines), a row of k for each of n texts: the nearest with a cosine over 0, ties to the earlier example, then cosines of 0.

        ``rows``, ``numbers``, ``weights``: terms by text; examples of a text's document in ``but`` are passed over. Cosines
        are rounded to 9 digits, so that they don't depend on the texts that are searched for together.
        """
        starts = np.searchsorted(rows, np.arange(n + 1))
        bounds = np.stack([weights[a:b] @ self.most[numbers[a:b]] for a, b in zip(starts, starts[1:], strict=False)], axis=1)
        column = self.column[numbers]
        full = column >= 0
        texts = np.zeros((n, self.columns.shape[1]))
        texts[rows[full], column[full]] = weights[full]
        scores = self.listed(n, rows[~full], numbers[~full], weights[~full])
        if but is not None:
            same, text = np.nonzero(self.docs[:, None] == but)
            scores[same // BLOCK, text, same % BLOCK] = -np.inf
        # The blocks of the highest bounds, then all whose bound the nearest of those don't reach; the rounding of the cosines is left to the bound.
        each, done = np.arange(n), np.zeros(bounds.shape, bool)
        first = np.argsort(-bounds, axis=0, kind="stable")[:FIRST_BLOCKS]
        wanted = np.zeros(bounds.shape, bool)
        wanted[first, each] = bounds[first, each] > 0
        self.add_columns(scores, texts, wanted, done)
        least = np.maximum(np.partition(scores[first, each].transpose(1, 0, 2).reshape(n, -1), -k, axis=1)[:, -k], 0)
        self.add_columns(scores, texts, (bounds > 0) & (bounds + 1e-9 >= least), done)
        # Those that could be among the k nearest after rounding.
        may = (scores > 0) & (scores >= (least - 1e-8)[:, None]) & done[:, :, None]
        block, text, place = np.nonzero(may)
        near, c = block * BLOCK + place, np.round(scores[may], 9)
        order = np.lexsort((near, -c, text))
        near, c, text = near[order], c[order], text[order]
        rank = np.arange(len(text)) - np.searchsorted(text, each)[text]
        found, cosines = np.zeros((n, k), np.int64), np.zeros((n, k))
        best = rank < k
        found[text[best], rank[best]], cosines[text[best], rank[best]] = near[best], c[best]
        return found, cosines

    def nearest(self, numbers: np.ndarray, weights: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines) of the k nearest to one text, those with a cosine over 0."""
        found, cosines = self.nearest_of(1, np.zeros(len(numbers), np.int64), numbers, weights, k, None if but is None else np.array([but]))
        return found[cosines > 0], cosines[cosines > 0]


class Scorer:
    """Scores by weighted votes: a neighbour counts by its nearness and by how many labelled documents its example stands for."""

    def __init__(self, terms: list[str], idf: np.ndarray, base: float, stands: np.ndarray, index: dict | None, knots: tuple[np.ndarray, np.ndarray] | None = None):
        self.vectors, self.base, self.stands, self.knots = Vectors(terms, idf), base, stands, knots
        self.index = index and BlockMaxIndex.of_parts(index)

    def votes(self, n: int, rows: np.ndarray, numbers: np.ndarray, counts: np.ndarray, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share of the votes that are toxic, nearest examples, their cosines) of n texts. Texts without neighbours get the share of toxic labels."""
        found, cosines = np.zeros((n, NEIGHBOURS), np.int64), np.zeros((n, NEIGHBOURS))
        if self.index is None:
            return np.full(n, self.base), found, cosines
        weights = unit_weights(self.vectors.idf, rows, numbers, counts)
        for at in range(0, n, TOGETHER):
            a, b = np.searchsorted(rows, (at, at + TOGETHER))
            own = slice(at, min(n, at + TOGETHER))
            found[own], cosines[own] = self.index.nearest_of(own.stop - at, rows[a:b] - at, numbers[a:b], weights[a:b], NEIGHBOURS, None if but is None else but[own])
        labels = self.index.labels[found]
        # Far neighbours say little: the vote falls with the cosine's square beside the distance.
        votes = self.stands[labels] * cosines**2 / (0.05 + 1 - np.minimum(cosines, 1))
        return ((votes * labels).sum(1) + 0.5 * self.base) / (votes.sum(1) + 0.5), found, cosines

    def score(self, texts: list[str | None]) -> tuple[pa.Array, pa.Array]:
        """(scores, evidence) of texts; of equal texts one is searched for."""
        place = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        vectors = self.vectors.counts([t or "" for t in place])
        shares, found, cosines = self.votes(len(place), *vectors)
        scores = np.interp(shares, *self.knots) if self.knots else shares
        found, cosines = found[:, :EVIDENCE], cosines[:, :EVIDENCE]
        said = cosines > 0
        index = self.index
        docs, labels = (index.docs[found[said]], index.labels[found[said]]) if index else (found[said], found[said])
        near = pa.StructArray.from_arrays([pa.array(docs, pa.int64()), pa.array(cosines[said], pa.float64()), pa.array(labels, pa.int32())], names=["doc_id", "cosine", "toxic"])
        each = pa.array([place[t] for t in texts], pa.int64())
        return pa.array(scores, pa.float64()).take(each), pa.ListArray.from_arrays(pa.array(np.append(0, said.sum(1).cumsum()), pa.int32()), near).take(each)


def isotonic(shares: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (share, probability), both rising: weighted isotonic regression, each level drawn to the mean by one observation's weight."""
    points, which = np.unique(shares, return_inverse=True)
    heavy, toxic = np.bincount(which, weights), np.bincount(which, weights * labels)
    levels: list[list[float]] = []  # weight, weight of label 1, weighted sum of shares
    for w, y, x in zip(heavy.tolist(), toxic.tolist(), (heavy * points).tolist(), strict=True):
        levels.append([w, y, x])
        while len(levels) > 1 and levels[-2][1] * levels[-1][0] >= levels[-1][1] * levels[-2][0]:
            top = levels.pop()
            levels[-1] = [a + b for a, b in zip(levels[-1], top, strict=True)]
    base, one = float(np.average(labels, weights=weights)), float(np.mean(weights))
    at = np.array([x / w for w, _, x in levels])
    return at, np.maximum.accumulate([(y + one * base) / (w + one) for w, y, _ in levels])


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """What a Scorer needs, its index ready for use; its size is bounded by EXAMPLES and TERMS."""
    sample, totals = sample_examples(docs, labels)
    terms, idf = ranked_terms(sample)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vectors(terms, idf)
        for batch in sliced(batches):
            place, *held = own.counts([t or "" for t in batch.column(2).to_pylist()])
            starts = pa.array(np.searchsorted(place, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in held]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "toxic", "terms", "counts"])

    table = materialize(sample.mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, counts array<int>"))
    told = table.toArrow()
    rows = [(d, y, t.values.to_numpy().astype(np.int64), c.values.to_numpy().astype(np.int64)) for d, y, t, c in zip(*(told.column(i).to_pylist() for i in (0, 1)), *(list(told.column(i)) for i in (2, 3)), strict=True)]
    rows.sort(key=lambda r: (r[0], r[1], r[2].tolist(), r[3].tolist()))
    n, every = Counter(r[1] for r in rows), max(1.0, sum(totals.values()))
    own = [(d, y, t, unit_weights(idf, np.zeros(len(t), np.int64), t, c)) for d, y, t, c in rows if len(t)]
    index = vars(BlockMaxIndex(own, len(terms))) if own else None
    stands = np.array([totals.get(y, 0) / max(1, n[y]) for y in (0, 1)]) * len(rows) / every
    model = {"terms": terms, "idf": idf, "base": totals.get(1, 0) / every, "stands": stands, "index": index}
    if not terms:
        return model
    known = docs.sparkSession.sparkContext.broadcast(model)

    def own_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(**known.value)
        for batch in sliced(batches):
            terms_held = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy())
            held = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
            shares = scorer.votes(batch.num_rows, terms_held, *held, batch.column(0).to_numpy())[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.float64())], names=["doc_id", "toxic", "share"])

    voted = table.mapInArrow(own_votes, "doc_id long, toxic int, share double").toArrow()
    known.destroy()  # else workers would hold this model beside the one with knots
    shares, said = (voted.column(i).to_numpy() for i in (2, 1))
    return model | {"knots": isotonic(shares, said, np.array([totals[y] / n[y] for y in said.tolist()]))}


def _scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(row, score, evidence): ``docs`` as a struct with the score of its text."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learnt = docs.sparkSession.sparkContext.broadcast(learn(own, labels))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(**learnt.value)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *scorer.score(batch.column(0).field("text").to_pylist())], names=["row", "score", "evidence"])

    rows = carried(docs.withColumn("text", F.col("text").cast("string")))
    schema = StructType([rows.schema["row"], *SCORE])
    return rows.mapInArrow(scan, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) per row of ``docs`` (``doc_id``, ``text``); evidence holds the nearest examples.

    ``labels``: (doc_id, toxic); of contradictory labels the higher holds. A score depends on the text alone. Null and empty
    texts, and others without a term of the sample, get the calibrated share of toxic labels. Without labels of both kinds
    every score is the share of toxic labels, 0 if there are none. A row without doc_id isn't held out. Repeated rows each
    appear; of examples equally near the lesser counts; empty in, empty out. Further columns, whatever their names, are not read.
    """
    scored = _scored(docs.select("doc_id", "text"), labels)
    doc = F.col("row.doc_id").cast("long")
    held_out = F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select(doc.alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more. Columns may have any names."""
    return _scored(docs, labels).where("score < 0.5").select("row.*")
