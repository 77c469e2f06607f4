"""Mixing sources to target weights, in DataFrame functions only.

Each source's words are packed into blocks of fixed length. Output slots are grouped in shards; a shard's slots draw
their sources from the target shares (a multinomial draw per shard), the k-th slot of a source stands for the k-th block
of a pseudorandom permutation of its blocks, a new one for each pass, and slots meet blocks by index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ligamap.llm.shared import carried, materialize, n_words, salts_for, with_prefix

BLOCK = 256
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20_240_611

#: Slots of a shard, slots that a task makes, and cells of the lookup of draws.
SHARD_SLOTS, TASK_SLOTS, CELLS = 1024, 65_536, 4096

#: Multipliers of the index permutations; one that does not divide the count of blocks is taken by a hash.
PRIMES = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579)


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) -> with weight and target, one row per source.

    Sources by code point, null last, weigh 5, 2, 1, repeating, and share SHARE of all words. A target stops at MOST
    times its source's size and the excess is shared again by weight, until none is above: the targets are
    min(MOST * size, level * weight) for the one level at which they add up.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("double"))
    capped = weighed.withColumn("most", MOST * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    steps = capped.withColumn("all", SHARE * F.sum("source_size").over(everything)).withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
    steps = steps.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # The level if the sources before this one are full, and this one and the rest are not: the first that holds is it.
    steps = steps.withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    level = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return steps.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), F.col("most")))).select("source", "source_size", "target")


def quotas(goals: DataFrame) -> DataFrame:
    """Blocks, passes, slots and the last slot's words of each source, so that its words add up to its rounded target."""
    size, want = F.col("source_size"), F.round("target").cast("long")
    q = goals.withColumn("want", F.least(want, (F.lit(int(MOST)) * size))).withColumn("n_blocks", F.ceil(size / BLOCK).cast("long"))
    q = q.withColumn("passes", F.when(size > 0, F.floor(F.col("want") / size)).otherwise(0).cast("long"))
    q = q.withColumn("rest", F.when(size > 0, F.col("want") - F.col("passes") * size).otherwise(0))
    q = q.withColumn("quota", F.col("passes") * F.col("n_blocks") + F.ceil(F.col("rest") / BLOCK)).withColumn("full_blocks", F.floor(size / BLOCK).cast("long"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    q = q.withColumn("s", F.row_number().over(by_name)).withColumn("hi", F.sum("quota").over(by_name.rowsBetween(Window.unboundedPreceding, 0)))
    return q.withColumn("lo", F.col("hi") - F.col("quota"))


def permuted(index: Column, count: Column, key: Column) -> Column:
    """The place of ``index`` in a pseudorandom permutation of [0, count) that depends on ``key``; null for count 0.

    Multiplication modulo the count, a hashed rotation within runs of 1024 places, multiplication again: each is one to one.
    """
    run = 1024

    def stretched(x: Column, salt: int) -> Column:
        usable = F.filter(F.array(*(F.lit(p) for p in PRIMES)), lambda p: (count % p != 0) | (count == 0))
        factor = F.element_at(usable, (F.pmod(F.xxhash64(key, F.lit(salt)), F.size(usable)) + 1).cast("int")) % F.nullif(count, F.lit(0))
        shift = F.pmod(F.xxhash64(key, F.lit(salt + 1)), F.nullif(count, F.lit(0)))
        return ((x.cast("decimal(20,0)") * F.greatest(factor, F.lit(1)) + shift) % F.nullif(count, F.lit(0))).cast("long")

    first = stretched(index, 1)
    at = F.floor(first / run).cast("long")
    width = F.least(F.lit(run), count - at * run)
    turned = at * run + F.pmod(first - at * run + F.pmod(F.xxhash64(key, at), F.lit(run)), width)
    return stretched(turned, 3)


def slots(q: DataFrame, spark: SparkSession) -> DataFrame:
    """(s, shard, k) of every slot of the mix: each source has the slots 0 to quota - 1.

    A slot draws its source by a hash of its number. Draws beyond a source's quota, in the shards that come last in a
    pseudorandom order, are replaced by the sources that were drawn too rarely, so that the totals are exact; these
    replacements are a root of the slots' count.
    """
    n = q.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    n_shards = max(1, -(-n // SHARD_SLOTS))
    # Draw: a uniform number below n falls in one source's range [lo, hi); sources are found by cells of equal width.
    width = max(1, -(-n // CELLS))
    cells = q.where("quota > 0").select("s", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    drawn = spark.range(0, n, 1, max(1, -(-n // TASK_SLOTS))).select("id", F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(max(n, 1))).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") / width)).join(cells, "cell").where("u >= lo and u < hi")
    drawn = drawn.select("s", F.floor(F.col("id") / SHARD_SLOTS).alias("shard"))
    counts = materialize(drawn.groupBy("s", "shard").agg(F.count("*").alias("n")))  # the shards' multinomial counts
    counts = materialize(with_prefix(counts, "s", ["shard"], F.col("n"), salts_for(n_shards), "base"))
    totals = counts.groupBy("s").agg(F.sum("n").alias("drawn"))
    # The slots of a source in a shard follow on each other from `base`: its count is enough, its slots need no numbering.
    runs = counts.join(q.select("s", "quota"), "s").select("s", "shard", F.col("base").alias("first"), (F.least(F.col("base") + F.col("n"), F.col("quota")) - 1).alias("last")).where("last >= first")
    short = q.join(totals, "s", "left").select("s", F.coalesce("drawn", F.lit(0)).alias("first"), (F.col("quota") - 1).alias("last")).where("last >= first")
    short = short.select("s", F.explode(F.sequence("first", "last", F.lit(SHARD_SLOTS).cast("long"))).alias("first"), "last")
    short = short.select("s", F.pmod(F.xxhash64("s", "first"), F.lit(n_shards)).alias("shard"), "first", F.least(F.col("last"), F.col("first") + SHARD_SLOTS - 1).alias("last"))
    # A run has SHARD_SLOTS slots at most; so many tasks as the slots need, since there are far fewer runs than slots.
    every = runs.unionByName(short).repartition(max(1, -(-n // TASK_SLOTS)), "s", "first")
    return every.select("s", "shard", F.explode(F.sequence("first", "last")).alias("k"))


def mix(docs: DataFrame, place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``docs`` (``doc_id``, ``text``, ``source``) -> (documents, taken spans).

    documents: doc_id, key (a hash of the row), size (words), source_size, target, s and first_word, the place of the
    document's words among its source's. spans: (s, shard, pass, block, n_words), what the mix takes of each source.
    Null texts have no words, a null source is a source of its own, repeated rows are documents of their own, and a
    table without words has no spans. ``place`` names a column that tells rows apart and is carried.
    """
    spark = docs.sparkSession
    ties = [place] if place else []
    sized = materialize(docs.select("doc_id", "source", F.xxhash64("doc_id", "text", "source").alias("key"), n_words("text").alias("size"), *ties))
    sizes = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    most = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    q = materialize(quotas(targets(sizes.drop("n"))))
    placed = with_prefix(sized, "source", ["doc_id", "key", *ties], F.col("size"), salts_for(most), "first_word")
    placed = placed.join(q.select(F.col("source").alias("_source"), "source_size", "target", "s"), F.col("source").eqNullSafe(F.col("_source")))

    s = slots(q, spark).join(q.select("s", "n_blocks", "full_blocks", "source_size", "passes", "rest"), "s")
    s = s.withColumn("pass", F.floor(F.col("k") / F.col("n_blocks")).cast("long")).withColumn("j", F.col("k") % F.col("n_blocks"))
    # The last block of a source may be short; it comes last in each pass, so that the words of k slots are known.
    block = F.when(F.col("j") < F.col("full_blocks"), permuted(F.col("j"), F.col("full_blocks"), F.struct("s", "pass", F.lit(SEED)))).otherwise(F.col("j"))
    words = F.least(F.lit(BLOCK), F.col("source_size") - F.col("j") * BLOCK)
    words = F.when(F.col("pass") < F.col("passes"), words).otherwise(F.least(words, F.col("rest") - F.col("j") * BLOCK))
    return placed.drop("_source", "source"), s.select("s", "shard", "pass", block.alias("block"), words.alias("n_words"))


def overlaps(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """Join blocks by index: (s, first_word, pass, from_word, n_words) for each part of a document that the mix takes, counted from its first word."""
    end = F.col("first_word") + F.col("size")
    blocks = F.sequence(F.floor(F.col("first_word") / BLOCK), F.floor((end - 1) / BLOCK))
    met = placed.where("size > 0").select("s", "first_word", "size", F.explode(blocks).alias("block")).join(spans, ["s", "block"])
    start = F.greatest(F.col("first_word"), F.col("block") * BLOCK)
    stop = F.least(end, F.col("block") * BLOCK + F.col("n_words"))
    return met.select("s", "first_word", "pass", (start - F.col("first_word")).alias("from_word"), (stop - start).alias("n_words")).where("n_words > 0")


def mixed_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row: the words that the mix takes of it, repeats counted.

    Rows that share a doc_id or have none count each; further columns of ``docs``, whatever their names, are not read.
    """
    placed, spans = mix(docs.select("doc_id", "text", "source"))
    rows = materialize(placed)
    taken = overlaps(rows, spans).groupBy("s", "first_word").agg(F.sum("n_words").alias("taken"))
    busy = rows.where("size > 0").join(taken, ["s", "first_word"], "left")
    both = busy.unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return both.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each passage without gaps that a pass takes of a document.

    A row holds the passage's words with the white space after them; where a pass takes all, the text stays as it is.
    ``n_chars`` is counted again where ``docs`` has it. Documents without words are taken 0 times and go. Rows are told
    apart by their place in a written copy, so that equal rows, null and repeated ids are documents of their own.
    Columns may have any names. Empty in, empty out.
    """
    numbered = materialize(carried(docs, place=F.monotonically_increasing_id()))
    placed, spans = mix(numbered.select("place", *(F.col(f"row.{c}").cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("source", "string")))), "place")
    rows = materialize(placed)
    parts = overlaps(rows, spans).groupBy("s", "first_word", "pass").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("parts"), F.sum("n_words").alias("sum"))
    # Parts that follow on each other are one passage: its first part has none before it that ends there.
    firsts = "filter(parts, (p, i) -> i = 0 or parts[i - 1].from_word + parts[i - 1].n_words <> p.from_word)"
    lasts = "filter(parts, (p, i) -> i = size(parts) - 1 or parts[i + 1].from_word <> p.from_word + p.n_words)"
    passages = F.expr(f"zip_with({firsts}, {lasts}, (a, b) -> struct(a.from_word as at, b.from_word + b.n_words - a.from_word as n))")
    taken = rows.where("size > 0").join(parts, ["s", "first_word"]).select("place", passages.alias("passages"), (F.col("sum") == F.col("size")).alias("whole"))
    met = numbered.join(taken, "place").withColumn("text", F.col("row.text").cast("string"))
    words = r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0)"
    cut = F.expr(f"transform(array({words}), w -> transform(passages, p -> array_join(slice(w, cast(p.at + 1 as int), cast(p.n as int)), '')))[0]")
    met = met.select("row", F.explode(F.when(F.col("whole"), F.array("text")).otherwise(cut)).alias("text"))
    own = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        own = own.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return met.select(own.alias("row")).select("row.*")
