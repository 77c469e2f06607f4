"""Fill-in-the-middle: a document is cut at two unit ends into prefix, middle and suffix, and written in another order.

An Arrow-batched pandas UDF keeps the ends of a text's units in a compact array; two look-ups there slice the text.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that mark prefix, suffix and middle; a unit is a line with its end.
PREFIX, SUFFIX, MIDDLE, LINE = "<P>", "<S>", "<M>", r"[^\n]*\n|[^\n]+"

#: Seed of the cuts, documents of a hundred that are cut, and of a hundred of those the ones written suffix first.
SEED, RATE, SPM_RATE = 7, 100, 50

CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """0 and the code point after each unit: four bytes a unit."""
    ends = array("I", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def draws(doc_id: str, seed: int) -> list[int]:
    """Four numbers of 32 bits that depend on the document's id and the seed alone."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def cut(doc_id: str, text: str, unit: regex.Pattern, seed: int, rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and the middle, output) of a text."""
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    first, second = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < spm_rate:
        return n, "spm", first, second - first, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", first, second - first, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = LINE, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256) of each document.

    ``n`` counts the units, which are matched from left to right over the whole text; a text that they don't cover loses
    nothing, since its last piece runs to its end. ``form`` is psm or spm, or plain where the output is the text itself:
    for empty texts, texts that hold a mark, and those that ``rate`` leaves. A null text is empty, a null id counts as an
    empty one. Repeated rows give equal rows; rows that share an id are cut by the same draws. An empty table gives none;
    further columns, whatever their names, are not read. Texts of any length are taken whole; Spark bounds a batch by bytes.
    """

    @F.pandas_udf(CUT)
    def written(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        for ids, texts in batches:
            rows = [cut(i or "", t, pattern, seed, rate, spm_rate) for i, t in zip(ids, texts, strict=True)]
            frame = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            frame = frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
            yield frame.assign(output_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in frame["output"]])

    whole = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), written(F.col("doc_id").cast("long").cast("string"), whole).alias("x")).select("doc_id", "x.*")


def restored(output: Column, form: Column) -> Column:
    """The text again. A mark begins with a sign that is in no mark's rest, so no piece's end can make up a mark with what follows."""
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")  # an empty piece before the first mark
    order = F.when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2])).when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1]))
    return F.coalesce(order, output)
