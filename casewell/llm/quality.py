"""Quality rules and robust multivariate outliers.

Base rules count words, symbols, repeated lines and repeated three-word windows of each text.
Transformed statistics of the texts that pass are then held against a minimum-covariance-
determinant estimate of their (language, source) group: starting from a deterministic robust
scale and from the plain covariance, concentration steps refit mean and covariance on the half
of the rows that is nearest, and the start with the smaller determinant wins. A text is rejected
when its Mahalanobis distance is beyond a cutoff.

All of it is DataFrame expressions. Groups of any size are combined before the shuffle: medians
and the nearest half come from histograms with fixed bins, moments from sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACE, SPACE, let, materialize, text_bytes, text_of

#: Base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rows that an estimate needs (smaller groups use their language's, then the corpus's),
#: concentration steps, and width of histogram bins.
LEAST_ROWS, STEPS, BIN = 40, 3, 0.02
#: Standard deviations below which a statistic is not resolved, in the order of STATISTICS.
#: They are the spread that texts of the least length show by chance.
FLOORS = (0.15, 0.10, 0.10, 0.15)
STATISTICS = ("z_length", "z_symbols", "z_lines", "z_repeats")
#: Squared distance beyond which a text is an outlier: six floors away in one statistic, far
#: beyond the 1e-6 quantile of four normal ones (33), because statistics have heavier tails.
CUTOFF = 64.0


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    text = F.col("text")
    n = F.size("w")
    base = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *keep)
    word = base.select(
        "doc_id", *keep,
        F.regexp_extract_all(text, F.lit(f"{NON_SPACE}+"), F.lit(0)).alias("w"),
        F.length(F.regexp_replace(text, f"{SPACE}+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NON_SPACE)),
            lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    def windows(w: Column) -> Column:
        """A hash of each three-word window, in order."""
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(
                F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2))))

    def repeated(h: Column) -> Column:
        """Words in windows that occur twice: the windows sorted with their places, equal
        neighbours taken, and the places they cover counted once."""
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        places = let(ordered, lambda s: F.flatten(F.filter(
            F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"]))),
            lambda x: x.isNotNull())))
        return F.size(F.array_distinct(F.flatten(F.transform(
            F.array_distinct(places), lambda p: F.array(p, p + 1, p + 2)))))

    return word.select(
        "doc_id", *keep, n.cast("bigint").alias("n_words"), "word_chars", "n_symbols",
        "n_dup_lines",
        let(F.transform(F.array(F.col("w")), windows)[0], lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(repeated(h)))
        .cast("bigint").alias("n_repeat_words"))


def base_failed() -> Column:
    return ((F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def statistics(counted: DataFrame) -> DataFrame:
    """Transformed statistics: logarithm of the mean word length, and of one plus ten times the
    symbols, repeated lines and repeated words per word, so that shares of any size compare."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.withColumns({
        "z_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "z_symbols": F.log1p(10 * F.col("n_symbols") / n),
        "z_lines": F.log1p(10 * F.col("n_dup_lines") / n),
        "z_repeats": F.log1p(F.col("n_repeat_words") / n)})


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(4) for j in range(i, 4)]


def factor(fit: DataFrame) -> DataFrame:
    """The fit with the Cholesky factor l{i}{j} of its covariance and the log determinant."""
    for i in range(4):
        for j in range(i + 1):
            total = F.col(f"c{j}{i}")
            for k in range(j):
                total = total - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            fit = fit.withColumn(f"l{i}{j}", F.sqrt(F.greatest(total, F.lit(1e-6)))
                                 if i == j else total / F.col(f"l{j}{j}"))
    return fit.withColumn("logdet", sum((2 * F.log(f"l{i}{i}") for i in range(1, 4)),
                                        2 * F.log("l00")))


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, to rows with a factored fit."""
    for i in range(4):
        total = F.col(STATISTICS[i]) - F.col(f"m{i}")
        for k in range(i):
            total = total - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", total / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, 4)),
                                     F.col("y0") * F.col("y0")))


def _moments(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean and covariance, with the floors added to the variances."""
    sums = [F.count("*").alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(STATISTICS)]
    sums += [F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"r{i}{j}") for i, j in _pairs()]
    return rows.groupBy(*by).agg(*sums).select(
        *by, "n", *[f"m{i}" for i in range(4)],
        *[(F.col(f"r{i}{j}") + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}")
          for i, j in _pairs()])


def _medians(rows: DataFrame) -> DataFrame:
    """Median and median absolute deviation of each statistic from histograms: (g, m0.., c..)."""
    def median_of(values: DataFrame) -> DataFrame:
        bins = values.groupBy("g", "k", F.floor(F.col("v") / BIN).alias("b")).agg(
            F.count("*").alias("n"))
        return half_of(bins, ["g", "k"]).select("g", "k", ((F.col("b") + 0.5) * BIN).alias("at"))

    long = rows.select("g", F.posexplode(F.array(*STATISTICS)).alias("k", "v"))
    centre = materialize(median_of(long))
    spread = median_of(long.join(centre, ["g", "k"]).select(
        "g", "k", F.abs(F.col("v") - F.col("at")).alias("v"))).withColumnRenamed("at", "mad")
    both = centre.join(spread, ["g", "k"])
    out = both.groupBy("g").agg(
        *[F.max(F.when(F.col("k") == i, F.col("at"))).alias(f"m{i}") for i in range(4)],
        *[F.max(F.when(F.col("k") == i, F.pow(1.4826 * F.col("mad"), F.lit(2.0)))).alias(f"v{i}")
          for i in range(4)])
    return out.select("g", *[f"m{i}" for i in range(4)],
                      *[(F.col(f"v{i}") + FLOORS[i] ** 2 if i == j else F.lit(0.0))
                        .alias(f"c{i}{j}") for i, j in _pairs()])


def half_of(bins: DataFrame, by: list[str]) -> DataFrame:
    """The bin (by..., b) in which the lower half of the counted rows ends. Bins are bounded in
    number, whatever the rows."""
    got = bins.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("b", "n"))).alias("a"))
    need = F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]) / 2
    state = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(None).cast("bigint").alias("b"))
    return got.withColumn("need", need).select(*by, F.aggregate(
        "a", state, lambda s, x: F.struct(
            (s["sum"] + x["n"]).alias("sum"),
            F.when(s["b"].isNull() & (s["sum"] + x["n"] >= F.col("need")), x["b"])
            .otherwise(s["b"]).alias("b")))["b"].alias("b"))


def robust_fit(rows: DataFrame) -> DataFrame:
    """(g, m0.., c00..): the minimum-covariance-determinant fit of each group of (g, z_...).
    Both starts take their steps side by side, as groups (g, start)."""
    by = ["g", "start"]
    fit = materialize(
        _medians(rows).withColumn("start", F.lit(0))
        .unionByName(_moments(rows, ["g"]).drop("n").withColumn("start", F.lit(1))))
    for _ in range(STEPS):
        near = with_distance(rows.select("g", *STATISTICS).join(factor(fit), "g"))
        # bins of the logarithm: about 2 % of a distance
        near = near.withColumn("b", F.floor(F.log(F.greatest("d2", F.lit(1e-9))) / BIN))
        cut = materialize(half_of(near.groupBy(*by, "b").agg(F.count("*").alias("n")), by))
        kept = near.select(*by, "b", *STATISTICS).join(
            cut.withColumnRenamed("b", "last"), by).where("b <= last")
        fit = materialize(_moments(kept, by).drop("n"))
    ends = factor(fit)
    best = ends.groupBy("g").agg(F.min(F.struct("logdet", *[
        c for c in ends.columns if c not in (*by, "logdet")])).alias("f"))
    return materialize(best.select("g", "f.*").drop("logdet"))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance, kept.

    A null text has no words. Texts that fail a base rule are not part of any estimate and are
    not kept. Null languages and sources are groups like others. A group of fewer than
    LEAST_ROWS passing rows uses the estimate of its language, then of the corpus; where even
    that is too small nothing but the base rules rejects. Repeated rows count as often as they
    occur. An empty table gives an empty result; other columns are not looked at."""
    return _judged(docs, id_col, text_col, lang_col, source_col).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "distance", "kept")


def _group_of(col: str) -> Column:
    """A language or source as a value, null included."""
    return F.coalesce(F.col(col).cast("string"), F.lit("\0"))


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str,
            keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of quality with lang, source and the columns `keep`."""
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                         _group_of(lang_col).alias("lang"), _group_of(source_col).alias("source"), *keep)
    counted = materialize(statistics(counts(marked, keep=("lang", "source", *keep)))
                          .withColumn("base_failed", base_failed()))
    keys = {2: F.to_json(F.struct("lang", "source")), 1: F.to_json(F.struct("lang")), 0: F.lit("")}
    passed = counted.where("not base_failed")
    sizes = materialize(passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
                        .withColumns({f"g{k}": key for k, key in keys.items()}))
    enough = materialize(
        sizes.select("n", F.explode(F.array("g2", "g1", "g0")).alias("g"))
        .groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_ROWS).select("g"))
    rows = passed.select(*STATISTICS, F.explode(F.array(*keys.values())).alias("g"))
    fit = robust_fit(rows.join(enough, "g", "left_semi"))
    chosen = sizes.select("lang", "source", "g2", "g1", "g0")
    for k in (2, 1, 0):
        chosen = chosen.join(enough.select(F.col("g").alias(f"g{k}"), F.lit(True).alias(f"ok{k}")),
                             f"g{k}", "left")
    group = F.when(F.col("ok2"), F.col("g2")).when(F.col("ok1"), F.col("g1")).when(
        F.col("ok0"), F.col("g0"))
    used = materialize(chosen.select("lang", "source", group.alias("g")).join(fit, "g"))
    held = with_distance(counted.join(used, ["lang", "source"], "left"))
    return held.select(
        "doc_id", "lang", "source", *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", F.when(F.col("g").isNotNull(), F.col("d2")).alias("distance")).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The kept rows of `documents` with all their columns. A verdict holds for the rows with the
    same id, text, language and source, and for no others under that id or a null id."""
    sha, lang, source = "__content_digest", "__lang", "__source"
    marked = docs.withColumns({sha: F.sha2(text_bytes(), 256), lang: _group_of("lang"),
                               source: _group_of("source")})
    kept = (_judged(marked, "doc_id", "text", "lang", "source", keep=(sha,)).where("kept")
            .select(F.col("doc_id").alias("__id"), F.col(sha).alias("__sha"),
                    F.col("lang").alias("__kept_lang"), F.col("source").alias("__kept_source"))
            .distinct())
    return marked.join(
        kept, marked["doc_id"].eqNullSafe(kept["__id"]) & (marked[sha] == kept["__sha"])
        & (marked[lang] == kept["__kept_lang"]) & (marked[source] == kept["__kept_source"]),
        "left_semi").select(*docs.columns)
