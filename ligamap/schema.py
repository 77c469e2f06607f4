"""Tables of an assembly and the enums that are stored as ordinals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame

#: Ordinals of directions (of contigs and of atomic units) and of contig presence.
REVERSED, FORWARD = 0, 1
HIDDEN, SHOWN = 0, 1

UNITS = ("bp", "bins", "pixels")

#: Rows and columns of a block of the stored matrix, unless a dataset names another edge.
DEFAULT_EDGE = 256

SCHEMAS = {
    "resolution": "res_order int, bp_resolution bigint, quad_scale double, lin_scale double",
    "contig": "contig_id int, name string, length_bp bigint, source_name string, source_offset int",
    "contig_res": "res_order int, contig_id int, length_bins bigint, shown int",
    "contig_atu": "res_order int, contig_id int, seq int, stripe_id int, start int, end int, dir int, off bigint",
    "stripe_weight": "res_order int, stripe_id int, off int, weight double",
    "contact": "res_order int, row_stripe int, col_stripe int, r int, c int, v bigint",
    "layout": "ord int, contig_id int, dir int",
    "scaffold": "scaffold_id bigint, name string, spacer bigint, start_bp bigint, end_bp bigint",
}


@dataclass(frozen=True)
class Assembly:
    """One version of an assembly: immutable frames; an edit returns another Assembly."""

    resolution: DataFrame
    contig: DataFrame
    contig_res: DataFrame
    contig_atu: DataFrame
    stripe_weight: DataFrame
    contact: DataFrame
    layout: DataFrame
    scaffold: DataFrame
    edge: int = DEFAULT_EDGE
    scaffold_counter: int = 0
    #: (order, row stripes, column stripes) -> the contacts of those blocks in either order, where the source finds blocks faster than by a filter.
    read_blocks: Callable[[int, list[int], list[int]], DataFrame] | None = None

    def with_(self, **frames) -> Assembly:
        return replace(self, **frames)

    @cached_property
    def n_contigs(self) -> int:
        """Contigs of the layout, counted once."""
        return self.layout.count()


#: Rows up to which a frame of a layout's size is broadcast.
SMALL_ROWS = 1_000_000


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has at most SMALL_ROWS rows, by the bound ``most`` that is known or by a count; else the planner chooses."""
    from pyspark.sql import functions as F

    if most is None:
        most = df.limit(SMALL_ROWS + 1).count()
    return F.broadcast(df) if most <= SMALL_ROWS else df
