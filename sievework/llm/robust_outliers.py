"""Quality rules with robust multivariate outliers (operator 1), built of DataFrame functions only.

Each text yields counts of words, symbols, repeated lines and repeated five-word windows. Base rules reject short and
repetitive texts. The rest are transformed to a vector, and a minimum-covariance-determinant estimate for each language and
source (a start from medians, then concentration steps on the closest three quarters, then one reweighting) gives robust
means and covariances; a vector whose squared Mahalanobis distance exceeds CUTOFF is rejected.

A group of fewer than MIN_ROWS rows takes its language's estimate, and a language with fewer the table's. Quantiles are
mergeable sketches and moments are plain sums, so a group of any size is aggregated map-side first. Variances have a floor,
as a statistic that is constant in a group has none.

Defined cases: a null text has no words and fails the base rules; null languages and sources are groups of their own; repeated
rows are judged alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

MIN_WORDS, MAX_REPEAT_SHARE, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
MIN_ROWS, STEPS = 60, 3
CORE = 0.75
#: Fixed values of the chi-squared distribution with five degrees of freedom: the scale that makes the covariance of the
#: closest 75 % consistent, the 97.5 % point, and the point that one normal vector in a million exceeds.
CORE_SCALE, REWEIGHT_AT, CUTOFF = 1.41, 12.83, 35.9
#: (name, transformed statistic, least standard deviation)
STATISTICS = (
    ("length", "ln(1 + n_words)", 0.8),
    ("word_size", "ln(1 + word_chars / n_words)", 0.15),
    ("symbols", "ln(1 + 100 * n_symbols / word_chars)", 0.35),
    ("lines", "ln(1 + 100 * n_dup_lines / n_words)", 0.4),
    ("repeats", "ln(1 + 100 * n_repeat_words / n_words)", 0.6),
)
P = len(STATISTICS)
_WORD = "[^ \\t\\n\\u000B\\f\\r]+"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words within windows that occur twice or more in the array of words."""

    def covered(found: Column) -> Column:
        # found: the first places of repeated windows, in order; each covers up to the next one's start
        return F.coalesce(
            F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at")), lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"]),
            F.lit(0),
        )

    def sorted_places(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(pairs, lambda s: covered(F.sort_array(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i + 1)["h"]) | (x["h"] == F.get(s, i - 1)["h"])), lambda x: x["i"]))))

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(sorted_places(windows))

    def of_words(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return _let(windows, of_windows)

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(words, of_words))


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts and base_failed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(_WORD))
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        _let(
            F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")),
        ).alias("words"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
    )
    out = counted.select("doc_id", "lang", "source", "words.n_words", "words.word_chars", "n_symbols", "n_dup_lines", "words.n_repeat_words")
    return out.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_SHARE} * n_words"))


def _distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance from means m0.. and a lower triangular factor l00, l10, ...: by forward substitution."""
    y: list[Column] = []
    for i in range(P):
        left = F.col(f"x{i}") - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(f"l{i}{j}") * y[j]
        y.append(left / F.col(f"l{i}{i}"))
    return sum((v * v for v in y[1:]), y[0] * y[0])


def _factor(moments: DataFrame, scale: float) -> DataFrame:
    """key, rows, means and the triangular factor of the covariance, whose variances have their floors."""
    now = moments.select("level", "rows", *(F.col(f"s{i}").alias(f"m{i}") for i in range(P)), *((F.col(f"q{i}{j}") * scale + (F.lit(STATISTICS[i][2] ** 2) if i == j else F.lit(0.0))).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)))
    for i in range(P):  # Cholesky, a row at a time
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            now = now.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(STATISTICS[i][2] ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return now.drop(*(f"c{i}{j}" for i in range(P) for j in range(i + 1)))


def _moments(rows: DataFrame) -> DataFrame:
    """Means and covariances of x0.. by level; rows also has centres m0.., which keep the sums small."""
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(P)]
    sums = rows.groupBy("level").agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(P)),
        *(F.avg(d[i]).alias(f"a{i}") for i in range(P)),
        *(F.avg(d[i] * d[j]).alias(f"b{i}{j}") for i in range(P) for j in range(i + 1)),
    )
    return sums.select("level", "rows", *((F.col(f"m{i}") + F.col(f"a{i}")).alias(f"s{i}") for i in range(P)), *((F.col(f"b{i}{j}") - F.col(f"a{i}") * F.col(f"a{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)))


def covariance_estimates(vectors: DataFrame) -> DataFrame:
    """vectors: level, x0..x4 -> level, rows, means and factors of the minimum-covariance-determinant estimate."""
    middle = stage(vectors.groupBy("level").agg(F.count(F.lit(1)).alias("rows"), *(F.percentile_approx(f"x{i}", 0.5).alias(f"m{i}") for i in range(P))), "medians")
    spread = vectors.join(middle, "level").groupBy("level").agg(*(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5).alias(f"d{i}") for i in range(P)))
    start = middle.join(spread, "level").select(
        "level", "rows", *(f"m{i}" for i in range(P)), *((F.sqrt(F.pow(1.4826 * F.col(f"d{i}"), 2) + STATISTICS[i][2] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(P) for j in range(i + 1))
    )
    now = stage(start, "estimate")
    for _ in range(STEPS):
        far = vectors.join(now.drop("rows"), "level").withColumn("d2", _distance())
        core = stage(far.groupBy("level").agg(F.percentile_approx("d2", CORE).alias("core")), "core")
        now = stage(_factor(_moments(far.join(core, "level").filter("d2 <= core")), CORE_SCALE), "estimate")
    near = vectors.join(now.drop("rows"), "level").withColumn("d2", _distance()).filter(F.col("d2") <= REWEIGHT_AT)
    return stage(_factor(_moments(near), 1.0).drop("rows").join(middle.select("level", "rows"), "level"), "estimate")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance for every row."""
    counted = stage(text_statistics(docs), "statistics")
    group, lang = F.array(F.lit("group"), "lang", "source"), F.array(F.lit("lang"), "lang")
    whole = F.array(F.lit("table"))
    vectors = counted.filter("not base_failed").select("lang", "source", *(F.expr(e).alias(f"x{i}") for i, (_, e, _) in enumerate(STATISTICS)))
    # arrays with nulls are plain keys, so null languages and sources need no stand-in
    levels = vectors.select(F.explode(F.array(group, lang, whole)).alias("level"), *(f"x{i}" for i in range(P)))
    estimates = covariance_estimates(levels).filter(F.col("rows") >= F.when(F.get("level", F.lit(0)) == "table", 0).otherwise(MIN_ROWS))
    keys = counted.select("lang", "source").distinct().select("lang", "source", F.posexplode(F.array(group, lang, whole)).alias("order", "level"))
    chosen = keys.join(estimates, "level").groupBy("lang", "source").agg(F.min_by(F.struct(*estimates.columns), "order").alias("e"))
    chosen = chosen.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "e.*")
    joined = counted.join(chosen, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    placed = joined.withColumns({f"x{i}": F.when(~F.col("base_failed"), F.expr(e)) for i, (_, e, _) in enumerate(STATISTICS)}).withColumn("distance", _distance())
    kept = (~F.col("base_failed")) & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return placed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
