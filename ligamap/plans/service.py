"""The service's functions: one open assembly, edits that make new versions, tiles with a version gate."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ligamap.functions.signal import Options
from ligamap.functions.units import level_to_order
from ligamap.operators import edits, layout, scaffolds, tiles
from ligamap.operators.split import split
from ligamap.plans import documents
from ligamap.schema import Assembly
from ligamap.sources import agp, container, files, versions

#: Layout and scaffold edits after which the layout's frames are written, so that plans stay short.
WRITE_EVERY = 5


class Stale(Exception):
    """The request is older than one already answered."""


@dataclass
class Service:
    """Functions named after the service's endpoints. ``data_dir`` holds the datasets and AGP files that clients may open."""

    spark: SparkSession
    data_dir: str
    tile_size: int = 256
    options: Options = field(default_factory=Options)
    assembly: Assembly | None = None
    version: int = 0
    ranges: dict[int, tuple[float, float]] = field(default_factory=dict)
    committed: int = 0
    _edits: int = 0
    _base: Assembly | None = None
    _path: str = ""

    def list_files(self) -> list[str]:
        return self._listed("all")

    def list_agp_files(self) -> list[str]:
        return self._listed("agp")

    def list_fasta_files(self) -> list[str]:
        return self._listed("fasta")

    def list_coolers(self) -> list[str]:
        return self._listed("coolers")

    def _listed(self, kind: str) -> list[str]:
        return sorted(r["path"] for r in files.listed(self.spark, self.data_dir, kind).collect())

    def open(self, filename: str, version: int | None = None) -> dict:
        """Open a dataset of the data directory in place of the one that is open, at a committed version or the newest."""
        self._path = files.within(self.data_dir, filename)
        self.committed = versions.newest(self.spark, self._path) if version is None else version
        self.assembly = self._base = versions.checkout(self.spark, self._path, self.committed)
        self._edits = 0
        self._reset_ranges()
        return json.loads(documents.opened(self.assembly).first()["json"])

    def _reset_ranges(self) -> None:
        """Signal ranges start from 0 and 1; the newest version stays."""
        orders = [r["res_order"] for r in self._open().resolution.where("res_order > 0").collect()]
        self.ranges = dict.fromkeys(orders, (0.0, 1.0))

    def _open(self) -> Assembly:
        if self.assembly is None:
            raise RuntimeError("no assembly is open")
        return self.assembly

    def _edit(self, new: Assembly) -> dict:
        self._edits += 1
        self.assembly = self._written(new) if self._edits % WRITE_EVERY == 0 else new
        return self.assembly_info()

    def _written(self, a: Assembly) -> Assembly:
        """Checkpoint what edits change, if the session names a folder for it."""
        if not self.spark.sparkContext.getCheckpointDir():
            return a
        return a.with_(**{name: getattr(a, name).checkpoint() for name in container.FRAMES if name not in ("contact", "stripe_weight", "resolution")})

    def commit(self, said: str = "") -> int:
        """Keep what was edited as the dataset's next version. Raises versions.Conflict if another writer was first; the edits stay."""
        self.committed = versions.commit(self._open(), self._base, self._path, self.committed, said)
        self.assembly = self._base = versions.checkout(self.spark, self._path, self.committed)
        self._edits = 0
        return self.committed

    def list_versions(self) -> list[dict]:
        return [r.asDict() for r in versions.log(self.spark, self._path).select("version", "said").orderBy("version").collect()]

    def apply_edits(self, said: list[dict]) -> dict:
        """Reversals {start, end} and moves {start, end, target} one after the other, in one pass."""
        return self._edit(edits.apply(self._open(), [edits.Move(e["start"], e["end"], e["target"]) if "target" in e else edits.Reverse(e["start"], e["end"]) for e in said]))

    def assembly_info(self) -> dict:
        rows = documents.assembly(self._open()).orderBy("kind", "place").collect()
        return {"contigDescriptors": [json.loads(r["json"]) for r in rows if r["kind"] == "contig"], "scaffoldDescriptors": [json.loads(r["json"]) for r in rows if r["kind"] == "scaffold"]}

    def get_agp_for_assembly(self, default_spacer: int = 0) -> str:
        """The assembly as AGP text; scaffolds without a spacer of their own get ``default_spacer``."""
        rows = agp.export(self._open(), default_spacer).orderBy("line_no").collect()
        return "".join(r["line"] + "\n" for r in rows)

    def load_agp(self, filename: str) -> dict:
        return self._edit(agp.load(self._open(), agp.read_lines(self.spark, files.within(self.data_dir, filename))))

    def reverse_selection_range(self, start: int, end: int) -> dict:
        return self._edit(scaffolds.reverse(self._open(), start, end))

    def move_selection_range(self, start: int, end: int, target: int) -> dict:
        return self._edit(scaffolds.move(self._open(), start, end, target))

    def split_contig_at_bin(self, split_px: int, bp_resolution: int) -> dict:
        """Split at a pixel of a resolution."""
        a = self._open()
        order = a.resolution.where(f"bp_resolution = {int(bp_resolution)}").first()["res_order"]
        asked = self.spark.createDataFrame([(split_px,)], "pos bigint")
        found = layout.convert(a, asked, "pixels", order, "bp", 0).first()
        return self._edit(a if found is None else split(a, found["result"]))

    def group_contigs_into_scaffold(self, start: int, end: int, name: str | None = None, spacer: int | None = None) -> dict:
        return self._edit(scaffolds.group(self._open(), start, end, name, spacer))

    def ungroup_contigs_from_scaffold(self, start: int, end: int) -> dict:
        return self._edit(scaffolds.ungroup(self._open(), start, end))

    def move_selection_to_debris(self, start: int, end: int) -> dict:
        return self._edit(scaffolds.debris(self._open(), start, end))

    def get_visualization_options(self) -> dict:
        return self.options.to_json()

    def set_visualization_options(self, said: dict) -> dict:
        self.options = Options.from_json(said)
        self._reset_ranges()
        return self.options.to_json()

    def get_tile(self, row: int, col: int, level: int, version: int, form: str = "JSON_PNG_WITH_RANGES", tile_size: int | None = None) -> bytes | dict:
        """A tile of the map; an older version than the newest asked for is refused. PNG_BY_PIXELS takes row and col as pixels."""
        if version < self.version:
            raise Stale(f"version {version} is older than {self.version}")
        self.version = version
        a, size = self._open(), tile_size or self.tile_size
        order = level_to_order(level, a.resolution.count())
        r0, c0 = (row, col) if form == "PNG_BY_PIXELS" else (row * size, col * size)
        image = tiles.tile_png(a, order, r0, r0 + size, c0, c0 + size, self.options)
        if form != "JSON_PNG_WITH_RANGES":
            return image
        n = len(self.ranges) + 1
        bounds = [{str(n - o): r[k] for o, r in self.ranges.items()} for k in (0, 1)]
        return {"image": "data:image/png;base64," + base64.b64encode(image).decode(), "ranges": {"lowerBounds": bounds[0], "upperBounds": bounds[1]}}

