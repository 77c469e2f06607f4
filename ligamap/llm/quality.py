"""Quality rules: fixed limits on a document's statistics, then robust multivariate outliers per language and source.

The outliers come from a minimum-covariance-determinant estimate in DataFrame functions: from several starts, concentration
steps, each a quantile of distances and the moments of the rows below it, per group, both combined on the map side; the
start whose covariance has the least determinant is taken. The covariance is regularized by fixed smallest spreads, since
most texts have neither symbols nor repeats and their plain covariance is singular. A group too small for an estimate is
judged by that of its language, or of all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligamap.llm.shared import materialize

#: Share of a group's rows that the estimate rests on, concentration steps of each start and least rows of a group.
CORE, STEPS, LEAST_ROWS = 0.75, 3, 50

#: The squared distance that rejects: the 0.999 quantile of the chi-square distribution with as many degrees of freedom as FEATURES.
CUTOFF = 20.515

#: Names and smallest spreads of the transformed statistics; a spread below would make rare but harmless values extreme.
#: Each can reject alone: where a group has none, from 5 symbols to 100 words, 9 duplicate lines or a fifth of the words repeated.
FEATURES = {"words": 0.5, "word_length": 0.06, "symbols": 0.4, "dup_lines": 0.5, "repeats": 0.1}

#: The median of the chi-square distribution with as many degrees of freedom as FEATURES.
MEDIAN = 4.3515

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) per row, from the whole text; null: none.

    A window of three words is known by the 64-bit hash of its words; positions are looked up only in texts that repeat a window.
    """
    blank = "' \\t\\n\\u000B\\u000C\\r'"
    windows = "if(size(w) > 2, transform(sequence(0, size(w) - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])), cast(array() as array<bigint>))"
    twice = "filter(s, (x, k) -> coalesce(get(s, k - 1).h = x.h, false) or coalesce(get(s, k + 1).h = x.h, false))"
    covered = f"size(array_distinct(flatten(transform({twice}, x -> array(x.i, x.i + 1, x.i + 2)))))"
    placed = f"transform(array(sort_array(transform(h, (x, i) -> struct(x as h, i as i)))), s -> {covered})[0]"
    repeats = f"transform(array({windows}), h -> if(size(array_distinct(h)) = size(h), 0, {placed}))[0]"
    lines = f"transform(array(filter(split(text, '\\n', -1), x -> translate(x, {blank}, '') <> '')), l -> size(l) - size(array_distinct(l)))[0]"
    words = r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
    counted = f"transform(array({words}), w -> struct(cast(size(w) as bigint) as n_words, cast({repeats} as bigint) as n_repeat_words))[0]"
    text = docs.select(F.col("doc_id").cast("long"), "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    rows = text.select(
        "doc_id",
        "lang",
        "source",
        F.expr(counted).alias("c"),
        F.expr(f"cast(length(translate(text, {blank}, '')) as bigint)").alias("word_chars"),
        F.expr("cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint)").alias("n_symbols"),
        F.expr(f"cast({lines} as bigint)").alias("n_dup_lines"),
    )
    return rows.select("doc_id", "lang", "source", "c.n_words", "word_chars", "n_symbols", "n_dup_lines", "c.n_repeat_words")


def _features() -> dict[str, Column]:
    words = F.greatest("n_words", F.lit(1))
    return {
        "words": F.log1p("n_words"),
        "word_length": F.log1p(F.col("word_chars") / words),
        "symbols": F.log1p(100 * F.col("n_symbols") / words),
        "dup_lines": F.log1p("n_dup_lines"),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
    }


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["lang"].eqNullSafe(b["g_lang"]) & a["source"].eqNullSafe(b["g_source"])


KEYS = ["g_lang", "g_source", "start"]


def _with(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two tables of estimates by group and start."""
    other = b.withColumnsRenamed({c: f"h_{c}" for c in KEYS})
    return a.join(other, [a[c].eqNullSafe(other[f"h_{c}"]) for c in KEYS]).drop(*(f"h_{c}" for c in KEYS))


def _quantile(column: Column, share: float) -> Column:
    """An exact quantile of values rounded to 1/100 and held within [-10, 40], so that the counts it keeps are bounded and reruns agree."""
    return F.percentile(F.round(F.least(F.greatest(column, F.lit(-10.0)), F.lit(40.0)), 2), share)


def _by_group(rows: DataFrame, *what: Column) -> DataFrame:
    """Aggregates by group and start; rows that meet no estimate yet are of start 0."""
    start = F.col("start") if "start" in rows.columns else F.lit(0)
    return rows.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), start.alias("start")).agg(*what)


def _distance(names: list[str]) -> Column:
    """Squared distance under the centre m_* and the inverse factor w_i_j of the covariance."""
    total = F.lit(0.0)
    for i in range(len(names)):
        part = sum((F.col(f"w_{i}_{j}") * (F.col(names[j]) - F.col(f"m_{j}")) for j in range(i + 1)), F.lit(0.0))
        total += part * part
    return total


def _factor(moments: DataFrame, names: list[str]) -> DataFrame:
    """m_i, w_i_j, the inverse of the lower triangular factor of the covariance, and its log_det, from n, the offsets o_i, sums s_i and products p_i_j about the offsets."""
    p = len(names)
    now = moments
    for i in range(p):
        now = now.withColumn(f"a_{i}", F.col(f"s_{i}") / F.col("n"))
    for i in range(p):
        for j in range(i + 1):
            spread = F.lit(FEATURES[names[i]] ** 2) if i == j else F.lit(0.0)
            rest = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            value = F.col(f"p_{i}_{j}") / F.col("n") - F.col(f"a_{i}") * F.col(f"a_{j}") + spread - rest
            # The added spread keeps the factor positive; the floor is for rounding alone.
            now = now.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l_{j}_{j}"))
    for i in range(p):
        for j in range(i + 1):
            if i == j:
                now = now.withColumn(f"w_{i}_{i}", 1 / F.col(f"l_{i}_{i}"))
            else:
                now = now.withColumn(f"w_{i}_{j}", -sum((F.col(f"l_{i}_{k}") * F.col(f"w_{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l_{i}_{i}"))
    kept = [F.col(f"w_{i}_{j}") for i in range(p) for j in range(i + 1)]
    log_det = sum((2 * F.log(F.col(f"l_{i}_{i}")) for i in range(p)), F.lit(0.0))
    return now.select(*KEYS, log_det.alias("log_det"), *((F.col(f"o_{i}") + F.col(f"a_{i}")).alias(f"m_{i}") for i in range(p)), *kept)


def starts(rows: DataFrame, least: int) -> DataFrame:
    """Three first estimates of each group of ``least`` rows or more, all about the medians.

    Start 0 has the median absolute deviations alone; starts 1 and 2 add correlations that outliers can't bend far: of the
    deviations' hyperbolic tangents and of their signs in space (each row's deviations as a vector of unit length).
    """
    names = list(FEATURES)
    p = len(names)
    middle = _by_group(rows, F.count("*").alias("rows"), *(_quantile(F.col(c), 0.5).alias(f"o_{i}") for i, c in enumerate(names)))
    middle = materialize(middle.where(F.col("rows") >= least).drop("rows"))
    off = _by_group(rows.join(middle, _same(rows, middle)), *(_quantile(F.abs(F.col(c) - F.col(f"o_{i}")), 0.5).alias(f"d_{i}") for i, c in enumerate(names)))
    scaled = _with(middle, off)
    spread = {i: F.greatest(1.4826 * F.col(f"d_{i}"), F.lit(FEATURES[c])) for i, c in enumerate(names)}
    scaled = materialize(scaled.select(*KEYS, *(F.col(f"o_{i}") for i in range(p)), *(spread[i].alias(f"d_{i}") for i in range(p))))
    z = [(F.col(c) - F.col(f"o_{i}")) / F.col(f"d_{i}") for i, c in enumerate(names)]
    long = F.sqrt(sum((x * x for x in z), F.lit(0.0)))
    bent = {1: [F.tanh(x) for x in z], 2: [F.when(long > 0, math.sqrt(p) * x / long).otherwise(0.0) for x in z]}
    met = rows.join(scaled, _same(rows, scaled))
    plain = scaled.select(*KEYS, F.lit(0.0).alias("log_det"), *(F.col(f"o_{i}").alias(f"m_{i}") for i in range(p)), *((1 / F.col(f"d_{i}") if i == j else F.lit(0.0)).alias(f"w_{i}_{j}") for i in range(p) for j in range(i + 1)))
    every = plain
    for start, y in bent.items():
        # Deviations in units of the spreads: their mean counts as 0.
        products = [F.sum(y[i] * F.col(f"d_{i}") * y[j] * F.col(f"d_{j}")).alias(f"p_{i}_{j}") for i in range(p) for j in range(i + 1)]
        moments = _by_group(met, F.count("*").alias("n"), *(F.first(f"o_{i}").alias(f"o_{i}") for i in range(p)), *(F.lit(0.0).alias(f"s_{i}") for i in range(p)), *products)
        every = every.unionByName(_factor(moments, names).withColumn("start", F.lit(start)))
    return every


def fit(rows: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """``rows`` (lang, source and FEATURES), written -> per group of at least ``least`` rows: centre, inverse factor and ``scale``.

    Each start takes STEPS concentration steps; the one that ends with the least determinant is the group's, the lesser
    of equals. ``scale`` makes the median distance of a group that of the chi-square distribution, but never magnifies:
    that would undo the smallest spreads.
    """
    names = list(FEATURES)
    p = len(names)
    now = materialize(starts(rows, least))
    log = F.log(F.greatest(_distance(names), F.lit(1e-4)))
    for _ in range(STEPS):
        edge = _by_group(rows.join(now, _same(rows, now)).withColumn("log_d", log), _quantile(F.col("log_d"), CORE).alias("edge"))
        now = materialize(_with(now, edge))
        core = rows.join(now, _same(rows, now)).where(F.round(log, 2) <= F.col("edge"))
        about = {i: F.col(c) - F.col(f"m_{i}") for i, c in enumerate(names)}
        sums = [F.sum(about[i]).alias(f"s_{i}") for i in range(p)] + [F.sum(about[i] * about[j]).alias(f"p_{i}_{j}") for i in range(p) for j in range(i + 1)]
        moments = _by_group(core, F.count("*").alias("n"), *(F.first(f"m_{i}").alias(f"o_{i}") for i in range(p)), *sums)
        now = materialize(_factor(moments, names))
    # Determinants are rounded, so that rounding doesn't choose among starts that met.
    best = now.groupBy("g_lang", "g_source").agg(F.min(F.struct(F.round("log_det", 6), "start")).alias("b")).select("g_lang", "g_source", F.col("b.start").alias("start"))
    now = materialize(_with(now, best))
    edge = _by_group(rows.join(now, _same(rows, now)).withColumn("log_d", log), _quantile(F.col("log_d"), 0.5).alias("edge"))
    return _with(now, edge).withColumn("scale", F.greatest(F.exp("edge") / MEDIAN, F.lit(1.0))).drop("edge", "start", "log_det")


def fit_all(rows: DataFrame) -> DataFrame:
    """``rows`` (lang, source and FEATURES), written -> per language and source the estimate that judges it.

    It is the group's own from LEAST_ROWS rows on, else that of all rows of the language if they are as many, else that
    of all rows. Wider estimates rest on every row, also on those of groups that have their own.
    """
    sizes = materialize(rows.groupBy("lang", "source").agg(F.count("*").alias("own")))
    of_lang = sizes.groupBy(F.col("lang").alias("g_lang")).agg(F.sum("own").alias("of_lang"))
    no_lang, no_source = (F.lit(None).cast(rows.schema[c].dataType) for c in ("lang", "source"))
    levels = [F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source")) for k, (lang, source) in enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), no_source), (no_lang, no_source)])]
    level = F.when(F.col("own") >= LEAST_ROWS, levels[0]).when(F.col("of_lang") >= LEAST_ROWS, levels[1]).otherwise(levels[2])
    chosen = materialize(sizes.join(of_lang, sizes["lang"].eqNullSafe(of_lang["g_lang"])).select("lang", "source", level.alias("estimate")))
    dealt = rows.select(F.explode(F.array(*levels)).alias("lang"), F.lit(None).cast("string").alias("source"), *FEATURES)
    groups = fit(dealt.join(chosen.select("estimate").distinct(), F.col("lang").eqNullSafe(F.col("estimate")), "left_semi"), 1)
    judged = chosen.withColumnsRenamed({"lang": "of", "source": "of_source"}).join(groups, F.col("estimate").eqNullSafe(F.col("g_lang")))
    return judged.drop("g_lang", "g_source", "estimate").withColumnsRenamed({"of": "g_lang", "of_source": "g_source"})


def quality(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``, ``lang``, ``source``): the base counts, base_failed, distance and kept.

    base_failed: under 50 words, or more than half of the words in repeated windows. The estimates rest on the other
    rows; of these, one farther than CUTOFF from its group's centre isn't kept. Groups of under LEAST_ROWS such rows
    are judged by the estimate of their language or of all rows (see fit_all). A text isn't rejected for being long: more
    words than the centre's count as the centre's. A distance equal to CUTOFF keeps. distance is null where base_failed.
    Null lang or source are values like any other, null texts have no words and fail; repeated rows and rows that share a
    doc_id or have none each count; empty in, empty out. Further columns, whatever their names, are not read.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = materialize(statistics(docs).withColumn("base_failed", failed).withColumns(_features()))
    groups = materialize(fit_all(rows.where(~F.col("base_failed"))))
    measured = rows.join(groups, _same(rows, groups), "left").withColumn("words", F.least("words", "m_0"))
    measured = measured.withColumn("distance", F.when(~F.col("base_failed"), _distance(list(FEATURES)) / F.col("scale")))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return measured.select("doc_id", *BASE, "base_failed", kept.alias("kept"), "distance", "lang", "source")
