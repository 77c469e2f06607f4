"""Order MinHash fingerprints in DataFrame functions only.

The k-mers are runs of K words. Each gets the number of its occurrence in the text, so that repeats count; a hash of
both gives it a place on a ring. Each of SKETCHES hashes selects the TUPLE k-mers that come first from a start of its own
on the ring, which is a random order of all k-mers, so every selection is made over the whole text, short or long. The
selected are put back in text order and hashed together: two texts agree there if they select the same k-mers in the same
order, which edits and moved passages break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligamap.llm.shared import materialize

K, SKETCHES, TUPLE = 3, 64, 2

#: Characters of scripts that set no spaces (Thai, Lao, Burmese, Khmer, Chinese, Japanese): each is a word. Characters of the longest word; longer runs are several.
UNSPACED, LONGEST = r"\\x{E00}-\\x{EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{2E80}-\\x{A4CF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}", 64

#: Stands for a null doc_id in keys and in the order of documents.
NO_ID = -(1 << 63)

#: Copies of one row that are made in one place.
RUN = 1024


def sketch(text: str) -> Column:
    """The SKETCHES hashes as ARRAY<INT>; a text without words gives an empty array, one of under K words has one k-mer."""
    words = f"regexp_extract_all({text}, '[{UNSPACED}]|[^\\\\x20\\\\x09-\\\\x0D{UNSPACED}]{{1,{LONGEST}}}', 0)"
    kmers = f"case when size(w) >= {K} then transform(sequence(0, size(w) - {K}), i -> xxhash64({', '.join(f'w[i + {j}]' for j in range(K))})) when size(w) > 0 then array(xxhash64(w)) else cast(array() as array<bigint>) end"

    # An entry: its place on the ring, its place in the text and its k-mer.
    def entries(of: str, each: str, i: str, h: str, occurrence: str) -> str:
        return f"transform({of}, {each} -> struct(xxhash64({h}, {occurrence}) as v, {i} as i, {h} as h))"

    plain = entries("h", "(x, k)", "k", "x", "1")
    # Repeats: `r` holds the second and later occurrences, sorted by k-mer and place; the start of each run of equal
    # k-mers is a running maximum, found by doubling the reach.
    starts = "transform(r, (x, k) -> if(coalesce(get(r, k - 1).h = x.h, false), 0, k))"
    reach = f"aggregate(sequence(0, 30), {starts}, (a, j) -> if(size(a) > shiftleft(1, j), transform(a, (x, k) -> greatest(x, coalesce(get(a, k - shiftleft(1, j)), 0))), a))"
    later = f"transform(array({reach}), b -> {entries('r', '(x, k)', 'x.i', 'x.h', '2 + k - b[k]')})[0]"
    first = entries("filter(s, (x, k) -> not coalesce(get(s, k - 1).h = x.h, false))", "x", "x.i", "x.h", "1")
    again = "filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false))"
    repeated = f"transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))), s -> concat({first}, transform(array({again}), r -> {later})[0]))[0]"
    every = f"transform(array({kmers}), h -> if(size(array_distinct(h)) = size(h), {plain}, {repeated}))[0]"
    # The ring has SKETCHES equal arcs; no start of an arc reaches more than TUPLE entries of an arc.
    arc = f"shiftright({{}}.v, {64 - SKETCHES.bit_length() + 1})"
    near = f"transform(array(sort_array({every})), e -> filter(e, (x, k) -> not coalesce({arc.format(f'get(e, k - {TUPLE})')} = {arc.format('x')}, false)))[0]"
    # The first entry of an arc is met from that arc's start and from the starts of empty arcs before it; the first of all also from those after the last.
    ordered = f"array_sort(slice(c, k + 1, {TUPLE}), (a, b) -> a.i - b.i)"
    hashed = f"cast(shiftright(xxhash64(transform({ordered}, y -> y.h)), 32) as int)"
    before = f"cast(if(k = 0, {-SKETCHES // 2 - 1}, {arc.format('get(p, k - 1)')}) as int)"
    own = f"cast({arc.format('x')} as int)"
    met = f"flatten(transform(p, (x, k) -> if({own} = {before}, cast(array() as array<int>), array_repeat({hashed}, {own} - {before}))))"
    rest = f"transform(array(0), k -> array_repeat({hashed}, {SKETCHES // 2 - 1} - cast({arc.format('p[size(p) - 1]')} as int)))[0]"
    around = f"transform(array({near}), p -> transform(array(concat(p, slice(p, 1, {TUPLE - 1}))), c -> if(size(p) = 0, cast(array() as array<int>), concat({met}, {rest})))[0])[0]"
    return F.expr(f"transform(array({words}), w -> {around})[0]")


def as_text(sketches: str) -> Column:
    """A string of 8 hex digits a hash; of dashes for a text without words."""
    shown = f"array_join(transform({sketches}, x -> lower(lpad(hex(cast(x as bigint) & 4294967295), 8, '0'))), '')"
    return F.expr(f"if(size({sketches}) = 0, repeat('-', {8 * SKETCHES}), {shown})")


def likeness(a: str, b: str) -> Column:
    """The share of hashes that agree place by place; 1 if neither text has words, 0 if one has none."""
    agree = f"size(filter(zip_with({a}, {b}, (x, y) -> x <=> y), z -> z))"
    return F.expr(f"if(size({a}) = 0 or size({b}) = 0, if(size({a}) = size({b}), 1.0D, 0.0D), {agree} / cast({SKETCHES} as double))")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, hashes, fingerprint) of each row's whole text; a null text is empty."""
    return docs.select("doc_id", sketch("coalesce(text, '')").alias("hashes")).withColumn("fingerprint", as_text("hashes"))


def successors(rows: DataFrame) -> DataFrame:
    """``rows`` (id, key, ...), unique in (id, key) -> with next_id and next_key: the row that follows by (id, key), the first after the last.

    Rows are dealt to ranges, followed within each, and the ranges' first rows (one each) link them.
    """
    dealt = materialize(rows.repartitionByRange("id", "key").withColumn("range", F.spark_partition_id()))
    me = F.struct("id", "key")
    firsts = dealt.groupBy("range").agg(F.min(me).alias("head"))
    in_order = Window.orderBy("range")
    firsts = firsts.select(F.col("range").alias("_range"), F.coalesce(F.lead("head").over(in_order), F.first("head").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    followed = dealt.withColumn("next", F.lead(me).over(Window.partitionBy("range").orderBy("id", "key"))).join(firsts, F.col("range") == F.col("_range"))
    after = F.coalesce("next", "after")
    return followed.select(*rows.columns, after["id"].alias("next_id"), after["key"].alias("next_key"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): its fingerprint, that of its edited text and both likenesses.

    The edited text has the last half of the code points (rounded down) replaced by the first as many, or all, of the
    next document's by doc_id. Rows that share a doc_id follow each other in the order of a hash of their text, equal
    rows are documents of their own; a null doc_id comes first. A single document follows itself; empty in, empty out.
    Further columns of ``docs``, whatever their names, are not read.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    # Equal rows are one here, counted on the map side; all but the last of them are followed by themselves.
    unique = keyed.groupBy("id", "key").agg(F.first(F.length("text").cast("long")).alias("n_chars"), F.count("*").alias("rows"))
    pairs = materialize(successors(unique))
    texts = keyed.groupBy("id", "key").agg(F.first("text").alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    last = F.struct("next_id", "next_key", F.lit(1).cast("long").alias("copies"))
    again = F.struct(F.col("id").alias("next_id"), F.col("key").alias("next_key"), (F.col("rows") - 1).alias("copies"))
    wanted = pairs.select("id", "key", "n_chars", F.inline(F.when(F.col("rows") > 1, F.array(last, again)).otherwise(F.array(last))))
    wanted = wanted.select(F.col("id").alias("for_id"), F.col("key").alias("for_key"), F.col("next_id").alias("id"), F.col("next_key").alias("key"), "n_chars", "copies")
    given = wanted.join(texts, ["id", "key"]).select(F.col("for_id").alias("id"), F.col("for_key").alias("key"), F.col("id").alias("next_id"), F.col("key").alias("next_key"), "n_chars", "copies", F.substring("text", F.lit(1), half).alias("tail"))
    met = texts.join(given, ["id", "key"])
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("tail"))
    made = met.select("id", "key", "next_id", "next_key", "copies", "n_chars", "text", edited.alias("edited"))
    made = made.select("id", "key", "next_id", "next_key", "copies", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch("text").alias("hashes"), sketch("edited").alias("edited_hashes"))
    made = materialize(made)
    others = made.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("hashes").alias("next_hashes")).dropDuplicates(["next_id", "next_key"])
    # Copies of one row are made in runs, which tasks share where a row has more than one run; few rows stand for many, so the number of tasks is given.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_many = F.col("copies") > RUN
    few = made.where(~is_many).join(others, ["next_id", "next_key"])
    many = made.where(is_many).join(others, ["next_id", "next_key"]).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))))
    many = many.withColumn("copies", F.least(F.lit(RUN).cast("long"), F.col("copies") - F.col("from"))).repartition(tasks, "id", "key", "from").drop("from")
    found = few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text("hashes").alias("fingerprint"),
        as_text("edited_hashes").alias("edited_fingerprint"),
        likeness("hashes", "edited_hashes").alias("near_edited"),
        likeness("hashes", "next_hashes").alias("near_next"),
    )
