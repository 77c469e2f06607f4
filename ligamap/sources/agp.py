"""AGP 2.1 text: export, parsing, validation and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ligamap.operators.layout import splits
from ligamap.operators.ranges import islands, running, splitters
from ligamap.operators.scaffolds import members
from ligamap.schema import Assembly

#: Fixed values of the format: letters of components and of gaps, orientations, kinds of gap, and evidence.
COMPONENTS = ("W", "A", "D", "F", "G", "O", "P")
GAPS = ("N", "U")
ORIENTATIONS = {"+": "plus", "-": "minus", "?": "unknown", "0": "unknown", "na": "irrelevant"}
GAP_TYPES = ("scaffold", "contig", "centromere", "short_arm", "heterochromatin", "telomere", "repeat", "contamination")
EVIDENCE = ("proximity_ligation", "na", "paired-ends", "paired_ends", "align_genus", "align_xgenus", "align_trnscpt", "within_clone", "clone_contig", "map", "pcr", "strobe", "unspecified")


def export(a: Assembly, spacer: int = 0) -> DataFrame:
    """(line_no, line): the assembly as AGP. Contigs of a scaffold follow each other with gaps of its spacer, or of ``spacer`` where it has none; others are objects of their own."""
    c = a.contig.select("contig_id", F.col("name").alias("contig_name"), "source_name", "source_offset")
    found = members(a)
    # A group's contigs follow each other, so that their places in it are differences; no group needs to meet in one task.
    groups = found.groupBy("group_no").agg(F.min("ord").alias("at"), F.count("*").alias("of"), F.min("s").alias("from"))
    n = found.join(groups, "group_no").join(c, "contig_id").withColumn("n", F.col("ord") - F.col("at") + 1)
    g = F.coalesce("spacer", F.lit(spacer))
    begin = 1 + F.col("s") - F.col("from") + (F.col("n") - 1) * g
    placed = n.withColumn("begin", begin).withColumn("stop", F.col("begin") + F.col("len") - 1).withColumn("gap", g)
    object_name = F.coalesce("name", F.concat(F.lit("unscaffolded_"), "contig_name"))
    part = F.when(F.col("gap") > 0, 2 * F.col("n") - 1).otherwise(F.col("n"))

    def line(*fields: Column | str) -> Column:
        return F.concat_ws("\t", *(F.col(f) if isinstance(f, str) else f for f in fields))

    component = line(object_name, "begin", "stop", part, F.lit("W"), "source_name", 1 + F.col("source_offset"), F.col("source_offset") + F.col("len"), F.when(F.col("dir") == 1, "+").otherwise("-"))
    gap = line(object_name, F.col("stop") + 1, F.col("stop") + F.col("gap"), 2 * F.col("n"), F.lit("N"), "gap", F.lit("scaffold"), F.lit("yes"), F.lit("proximity_ligation"))
    has_gap = (F.col("gap") > 0) & (F.col("n") < F.col("of"))
    rows = placed.select("ord", F.posexplode(F.when(has_gap, F.array(component, gap)).otherwise(F.array(component))).alias("k", "line"))
    return running(rows, "ord", {"line_no": F.lit(1)}, splits(a), ("k",)).select(F.col("line_no").cast("int").alias("line_no"), "line")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(line_no, line) of AGP files or folders of them; numbers are those of a file, and run on over several in the order of their names.

    Spark splits large files by byte ranges. A range's lines follow each other in its task, so a line's number is its
    place there after the counted lines of the ranges before, of which there is one row each.
    """
    found = spark.read.option("lineSep", "\n").text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    found = found.withColumn("id", F.monotonically_increasing_id())
    parts = found.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range of bytes, not of lines.
    parts = parts.select(F.col("file").alias("_file"), F.col("at").alias("_at"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    met = found.join(F.broadcast(parts), (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at")))
    return met.select((F.col("before") + F.col("id") - F.col("first") + 1).cast("int").alias("line_no"), F.regexp_replace("value", r"\r\z", "").alias("line"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files of which the names' order is the lines': ranges of line numbers are written in tasks of their own and committed together."""
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select(F.col("line").alias("value")).write.text(path)


def parse(lines: DataFrame, skip_comments: bool = False) -> DataFrame:
    """(line_no, kind, error and the record's columns). ``error`` names the first thing wrong with the line, else null."""
    trimmed = F.regexp_replace("line", r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    if skip_comments:
        lines = lines.where(~trimmed.startswith("#") & (trimmed != ""))
    f = lines.select("line_no", F.split(trimmed, "\t").alias("f")).withColumn("n", F.size("f"))
    at = {i: F.try_element_at("f", F.lit(i + 1)) for i in range(9)}
    number = {i: at[i].try_cast("bigint") for i in (1, 2, 3, 5, 6, 7)}
    component, gap = at[4].isin(*COMPONENTS), at[4].isin(*GAPS)
    error = (
        F.when(F.col("n") < 9, "columns")
        .when(number[1].isNull() | number[2].isNull() | number[3].isNull(), "number")
        .when(~(component | gap), "component_type")
        .when(component & (number[6].isNull() | number[7].isNull()), "number")
        .when(component & ~at[8].isin(*ORIENTATIONS), "orientation")
        .when(gap & number[5].isNull(), "number")
        .when(gap & ~at[6].isin(*GAP_TYPES), "gap_type")
        .when(gap & ~at[7].isin("yes", "no"), "linkage")
        .when(gap & ~at[8].isin(*EVIDENCE), "evidence")
    )
    good = error.isNull()

    def only(when: Column, value: Column) -> Column:
        return F.when(good & when, value)

    turns = F.create_map(*(F.lit(x) for pair in ORIENTATIONS.items() for x in pair))
    return f.select(
        "line_no",
        only(F.lit(True), F.when(component, "W").otherwise("gap")).alias("kind"),
        error.alias("error"),
        only(F.lit(True), at[0]).alias("object"),
        only(F.lit(True), number[1]).alias("object_beg"),
        only(F.lit(True), number[2]).alias("object_end"),
        only(F.lit(True), number[3].cast("int")).alias("part"),
        only(component, at[5]).alias("component"),
        only(component, number[6]).alias("component_beg"),
        only(component, number[7]).alias("component_end"),
        only(component, turns[at[8]]).alias("orientation"),
        only(gap, number[5]).alias("gap_length"),
        only(gap, at[6]).alias("gap_type"),
        only(gap, at[7] == "yes").alias("linkage"),
        only(gap, F.when(at[8] == "paired-ends", "paired_ends").otherwise(at[8])).alias("evidence"),
    )


def validate(lines: DataFrame, contig: DataFrame) -> DataFrame:
    """(line_no, error) of the lines that can't be imported: those that don't parse, and components that don't fit their contig."""
    parsed = parse(lines)
    known = contig.select(F.col("name").alias("component"), "length_bp")
    size = F.col("component_end") - F.col("component_beg") + 1
    twice = F.count("*").over(Window.partitionBy("component"))
    met = parsed.join(known, "component", "left").withColumn("times", F.when(F.col("component").isNotNull(), twice))
    fits = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("kind") != "W", None)
        .when(F.col("length_bp").isNull(), "unknown_contig")
        .when(F.col("object_end") - F.col("object_beg") + 1 != size, "length_mismatch")
        .when(size > F.col("length_bp"), "longer_than_contig")
        .when(size < F.col("length_bp"), "shorter_than_contig")
        .when(F.col("times") > 1, "repeated_contig")
    )
    return met.select("line_no", fits.alias("error")).where("error is not null")


def import_layout(parsed: DataFrame, contig: DataFrame) -> DataFrame:
    """The layout that valid records describe: components in the order of their lines; only ``-`` is reversed."""
    met = parsed.where("kind = 'W'").join(contig.select(F.col("name").alias("component"), "contig_id"), "component")
    numbered = running(met, "line_no", {"ord": F.lit(1)}, splitters(parsed, "line_no")[1])
    return numbered.select(F.col("ord").cast("int").alias("ord"), "contig_id", F.when(F.col("orientation") == "minus", 0).otherwise(1).alias("dir"))


def import_scaffolds(parsed: DataFrame, counter: int = 0) -> DataFrame:
    """Scaffolds of valid records: objects of more than one record, or not named unscaffolded; numbered in order of appearance after ``counter`` + 1."""
    size = F.sum(F.when(F.col("kind") == "W", F.col("object_end") - F.col("object_beg") + 1).otherwise(0))
    spacer = F.coalesce(F.max(F.when(F.col("kind") == "gap", F.col("gap_length"))), F.lit(1000))
    objects = parsed.groupBy("object").agg(F.min("line_no").alias("first"), F.count("*").alias("n"), size.alias("size"), spacer.alias("spacer"))
    named = objects.withColumn("is", (F.col("n") > 1) | ~F.col("object").startswith("unscaffolded"))
    made = running(named, "first", {"end_bp": F.col("size"), "k": F.col("is").cast("bigint")}, splitters(parsed, "line_no")[1]).where("is")
    return made.select((counter + 1 + F.col("k")).alias("scaffold_id"), F.col("object").alias("name"), "spacer", (F.col("end_bp") - F.col("size")).alias("start_bp"), "end_bp")


def load(a: Assembly, lines: DataFrame) -> Assembly:
    """The assembly in the order of an AGP. Everything is checked before anything changes; objects must be contiguous."""
    wrong = validate(lines, a.contig).orderBy("line_no").first()
    if wrong:
        raise ValueError(f"line {wrong['line_no']}: {wrong['error']}")
    parsed = parse(lines)
    runs = islands(parsed.select("line_no", "object"), "line_no", F.col("object") == F.col("last_object"), ["object"], splitters(parsed, "line_no")[1])
    counts = runs.agg(F.coalesce(F.max("island"), F.lit(0)), F.countDistinct("object")).first()
    if counts[0] != counts[1]:
        raise ValueError("the records of an object must follow each other")
    scaffold = import_scaffolds(parsed, a.scaffold_counter)
    return a.with_(layout=import_layout(parsed, a.contig), scaffold=scaffold, scaffold_counter=a.scaffold_counter + 1 + scaffold.count())
