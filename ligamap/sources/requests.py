"""Request bodies of the service as tables: JSON texts decoded to typed columns where they lie, with what is wrong in each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligamap.operators.edits import Move, Reverse

#: The endpoints that edit, with the fields that their bodies must have.
NEEDED = {
    "reverse_selection_range": ["startBP", "endBP"],
    "move_selection_range": ["startBP", "endBP", "targetStartBP"],
    "split_contig_at_bin": ["splitPx", "bpResolution"],
    "group_contigs_into_scaffold": ["startBP", "endBP"],
    "ungroup_contigs_from_scaffold": ["startBP", "endBP"],
    "move_selection_to_debris": ["startBP", "endBP"],
}

#: The fields of all bodies, with their types and the columns they become.
FIELDS = {
    "startBP": ("bigint", "start"),
    "endBP": ("bigint", "end"),
    "targetStartBP": ("bigint", "target"),
    "splitPx": ("bigint", "split_px"),
    "bpResolution": ("bigint", "bp_resolution"),
    "scaffoldName": ("string", "scaffold_name"),
    "spacerLength": ("bigint", "spacer"),
}

#: Edits that one list holds at most; they are composed on the driver.
MOST_EDITS = 100_000


def _needed() -> Column:
    asked = F.lit(None).cast("array<string>")
    for endpoint, fields in NEEDED.items():
        asked = F.when(F.col("endpoint") == endpoint, F.array(*(F.lit(f) for f in fields))).otherwise(asked)
    return asked


def decoded(rows: DataFrame) -> DataFrame:
    """(request_id, endpoint, body) -> request_id, endpoint, the columns of FIELDS and ``problem``, null for a good request.

    Problems are an unknown endpoint (or none), an unreadable body (null, no object, cut off, or a field of another type)
    and missing fields, by name in the endpoint's order. Fields that the endpoint doesn't need are optional, others are not read. Each row
    gives a row, so repeated and null ids stay; a body's columns are null where it is unreadable.
    """
    schema = ", ".join(f"{name} {kind}" for name, (kind, _) in FIELDS.items()) + ", _unread string"
    said = rows.select("request_id", "endpoint", F.col("body"), F.from_json("body", schema, {"columnNameOfCorruptRecord": "_unread"}).alias("said"), _needed().alias("needed"))
    readable = F.coalesce(F.ltrim("body").startswith("{") & F.col("said._unread").isNull(), F.lit(False))
    lacks = F.filter("needed", lambda f: ~F.array_contains(F.array_compact(F.array(*(F.when(F.col(f"said.{n}").isNotNull(), n) for n in FIELDS))), f))
    problem = (
        F.when(F.col("needed").isNull(), "unknown endpoint")
        .when(~readable, "unreadable body")
        .when(F.size(lacks) > 0, F.concat(F.lit("missing "), F.array_join(lacks, ", ")))
    )
    return said.select("request_id", "endpoint", *(F.when(readable, F.col(f"said.{n}")).alias(c) for n, (_, c) in FIELDS.items()), problem.alias("problem"))


def edits_of(requests: DataFrame) -> list[Reverse | Move]:
    """The good reversals and moves among decoded requests, by request_id, as a list for ``edits.apply``. Raises ValueError beyond MOST_EDITS of them."""
    wanted = requests.where(F.col("problem").isNull() & F.col("endpoint").isin("reverse_selection_range", "move_selection_range"))
    found = wanted.orderBy("request_id", "endpoint", "start", "end", "target").limit(MOST_EDITS + 1).select("endpoint", "start", "end", "target").collect()
    if len(found) > MOST_EDITS:
        raise ValueError(f"more than {MOST_EDITS} edits in one list")
    return [Move(r["start"], r["end"], r["target"]) if r["endpoint"] == "move_selection_range" else Reverse(r["start"], r["end"]) for r in found]
