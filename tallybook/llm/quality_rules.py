"""Quality rules with a robust test for outliers: minimum covariance determinant per language and source.

Each text gives base statistics (word characters, symbols, repeated lines, words in repeated runs of three). A vector
of transformed statistics is compared with its group, language and source. Each group has several starts: its medians
and median deviations, and ``STARTS`` small subsets dealt by hash. From each, concentration steps keep the ``support`` share
of vectors nearest by Mahalanobis distance and estimate mean and covariance anew, so that the determinant falls with
every step; the start of lowest determinant is kept, and its estimate is taken once more over all vectors within the 97.5%
quantile of it. Half of the vectors suffice, so junk below a half does not pass for the group's centre. Exact copies of a
vector weigh once, so copied junk has no weight. A row is rejected if its squared distance from the robust centre,
scaled so that the group's median has its expected value, exceeds ``cutoff``.

Every step is two aggregates per group with partial sums in the map tasks and a quantile sketch; no group is ever
gathered, so a source with a third of all rows costs no more than its rows. ``floor`` is added to every variance: it
is the least spread that counts, and keeps statistics which are constant in a group from rejecting small deviations.

Defined cases: a null text has no words and fails the base rules; a null language or source is a group value of its own;
rows of a group with fewer than ``least_rows`` distinct vectors meet the estimate of all rows of their language, where even
those are fewer that of all rows, and where all rows are fewer the test decides nothing and keeps; rows that repeat get equal verdicts; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.llm.secret_scan import let
from tallybook.sources.scratch import stored_once

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Half of the chi-square distribution with five degrees of freedom lies below.
MEDIAN_CHI2 = 4.351
#: One normal row in a billion lies beyond: the chi-square quantile with five degrees of freedom.
CUTOFF = 50.692
FLOOR = 0.15**2
#: Chi-square quantile of 97.5% with five degrees of freedom: the vectors within make the last estimate.
NEAR_CHI2 = 12.833
SUPPORT = 0.5
#: Starts from subsets dealt by hash, and about how many vectors each has.
STARTS = 4
SUBSET = 8
LEAST_ROWS = 50
#: Parts into which the rows of a group are dealt when they meet its estimate.
PARTS = 32


def _repeat_words(words: Column) -> Column:
    """Words inside runs of three words that the text holds twice or more."""

    def of_runs(runs: Column) -> Column:
        def covered(places: Column) -> Column:
            return F.aggregate(
                places,
                F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
                lambda s, p: F.struct((s["n"] + p + 3 - F.greatest(p, s["to"])).alias("n"), (p + 3).alias("to")),
            )["n"]

        def repeated(ordered: Column) -> Column:
            twice = F.filter(
                ordered,
                lambda x, i: (F.get(ordered, i - 1)["code"] == x["code"]) | (F.get(ordered, i + 1)["code"] == x["code"]),
            )
            return covered(F.sort_array(F.transform(twice, lambda x: x["at"])))

        numbered = F.transform(runs, lambda r, i: F.struct(r.alias("code"), i.alias("at")))
        return F.when(F.size(F.array_distinct(runs)) < F.size(runs), let(F.sort_array(numbered), repeated)).otherwise(0)

    runs = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) >= 4, let(runs, of_runs)).otherwise(0)


def statistics(text: Column) -> Column:
    """The base statistics of a text as a struct."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    from_words = lambda words: F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _repeat_words(words).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    return let(F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)), from_words)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _vector() -> list[Column]:
    """Transformed statistics: near normal for ordinary texts of any length.

    Shares of repeated lines and words stay linear, so that heavy repetition alone can exceed the cutoff. They are taken of two lines
    and twenty words more than the text has, for one repeated line of a short text says little.
    """
    words, c = F.greatest(F.col("n_words"), F.lit(1)), F.col
    return [
        F.log(words),
        3.0 * F.log(F.greatest(c("word_chars"), F.lit(1)) / words),
        F.log1p(200.0 * c("n_symbols") / F.greatest(c("word_chars"), F.lit(1))),
        3.0 * c("n_dup_lines") / (c("n_lines") + 2),
        3.0 * c("n_repeat_words") / (c("n_words") + 20),
    ]


_D = 5
_PAIRS = [(i, j) for i in range(_D) for j in range(i + 1)]


_X = [f"x{i}" for i in range(_D)]
#: Every estimate is known by its group and its start.
_BY = ["group", "start"]


def _moments() -> list[Column]:
    x = [F.col(c) for c in _X]
    return [*[F.avg(x[i]).alias(f"m{i}") for i in range(_D)], *[F.avg(x[i] * x[j]).alias(f"c{i}{j}") for i, j in _PAIRS]]


def _factored(moments: DataFrame, floor: float) -> DataFrame:
    """Centre and inverse Cholesky factor of the covariance of every estimate, as one array column."""
    a = {(i, j): F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (floor if i == j else 0.0) for i, j in _PAIRS}
    df = moments
    for i, j in _PAIRS:
        rest = a[i, j]
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(floor))) if i == j else rest / F.col(f"l{j}{j}"))
    for i, j in _PAIRS:
        rest = F.lit(1.0 if i == j else 0.0)
        for k in range(j, i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"k{k}{j}")
        df = df.withColumn(f"k{i}{j}", rest / F.col(f"l{i}{i}"))
    return df.select(*_BY, F.array(*[f"m{i}" for i in range(_D)], *[f"k{i}{j}" for i, j in _PAIRS]).alias("fit"))


def _distance(fit: str) -> Column:
    """Squared Mahalanobis distance, in plain arithmetic that is compiled."""
    total = F.lit(0.0)
    for i in range(_D):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + (F.col(f"x{j}") - F.col(fit)[j]) * F.col(fit)[_D + _PAIRS.index((i, j))]
        total = total + F.pow(y, 2)
    return total


def _met(vectors: DataFrame, per_group: DataFrame) -> DataFrame:
    """Rows with the values of their group. A group's rows are dealt to several parts, and its values to each of them."""
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    return vectors.join(per_group.withColumn("part", part), ["group", "part"])


def _median(x: Column) -> Column:
    return F.percentile_approx(x, F.lit(0.5), F.lit(1000))


def _starts(vectors: DataFrame, floor: float, least_rows: int) -> DataFrame:
    """(group, start, fit): start 0 is the medians and median deviations, the others are subsets of about SUBSET vectors."""
    middle = vectors.groupBy("group").agg(F.count(F.lit(1)).alias("n"), *[_median(F.col(c)).alias(f"m{i}") for i, c in enumerate(_X)])
    middle = stored_once(middle.where(F.col("n") >= least_rows), "mcd-middle")
    met = _met(vectors, middle)
    spread = met.groupBy("group").agg(*[_median(F.abs(F.col(c) - F.col(f"m{i}"))).alias(f"s{i}") for i, c in enumerate(_X)])
    factor = [1.0 / F.sqrt(F.pow(1.4826 * F.col(f"s{i}"), 2) + floor) if i == j else F.lit(0.0) for i, j in _PAIRS]
    medians = middle.join(spread, "group").select("group", F.lit(0).alias("start"), F.array(*[f"m{i}" for i in range(_D)], *factor).alias("fit"))
    dealt = met.withColumn("start", F.explode(F.sequence(F.lit(1), F.lit(STARTS))))
    dealt = dealt.where(F.expr(f"pmod(xxhash64(start, {', '.join(_X)}), n div {SUBSET} + 1) = 0"))
    return medians.unionByName(_factored(dealt.groupBy(*_BY).agg(*_moments()), floor))


def _scaled(vectors: DataFrame, fit: DataFrame) -> DataFrame:
    """Estimates with the scale that gives the median distance its expected value, but never less than 1."""
    scale = _met(vectors, fit).groupBy(*_BY).agg((_median(_distance("fit")) / MEDIAN_CHI2).alias("scale"))
    return fit.join(scale, _BY).withColumn("scale", F.greatest("scale", F.lit(1.0)))


def fitted(vectors: DataFrame, support: float = SUPPORT, steps: int = 3, floor: float = FLOOR, least_rows: int = LEAST_ROWS) -> DataFrame:
    """(group, fit, scale) of the groups with enough rows; ``vectors`` has ``group``, ``part`` and ``x0`` to ``x4``, each vector once."""
    fit = stored_once(_starts(vectors, floor, least_rows), "mcd-fit")
    for _ in range(steps):
        edge = _met(vectors, fit).groupBy(*_BY).agg(F.percentile_approx(_distance("fit"), F.lit(support), F.lit(1000)).alias("edge"))
        bounded = stored_once(fit.join(edge, _BY), "mcd-edge")
        near = _met(vectors, bounded).where(_distance("fit") <= F.col("edge"))
        fit = stored_once(_factored(near.groupBy(*_BY).agg(*_moments()), floor), "mcd-fit")
    spread = F.lit(0.0)
    for i in range(_D):
        spread = spread - F.log(F.col("fit")[_D + _PAIRS.index((i, i))])
    best = fit.groupBy("group").agg(F.min_by(F.struct("start", "fit"), F.struct(spread, "start")).alias("best")).select("group", "best.*")
    raw = stored_once(_scaled(vectors, best), "mcd-fit")
    near = _met(vectors, raw).where(_distance("fit") <= NEAR_CHI2 * F.col("scale"))
    fit = stored_once(_factored(near.groupBy(*_BY).agg(*_moments()), floor), "mcd-fit")
    return _scaled(vectors, fit).drop("start")


def judged(
    docs: DataFrame, key: str = "doc_id", text: str = "text", group: tuple[str, ...] = ("lang", "source"), cutoff: float = CUTOFF, **how
) -> DataFrame:
    """One row per document row: doc_id, row_key, the statistics, base_failed, distance and kept."""
    name = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?")) for c in group])
    wide = F.coalesce(F.concat(F.lit("="), F.col(group[0]).cast("string")), F.lit("?"))
    stats = docs.select(F.col(key).alias("doc_id"), row_key(key, text, group).alias("row_key"), name.alias("own"), wide.alias("wide"), statistics(F.col(text)).alias("s"))
    stats = stats.select("doc_id", "row_key", "own", "wide", "s.*").withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    rows = stored_once(stats.select("*", *[x.cast("double").alias(f"x{i}") for i, x in enumerate(_vector())]), "quality-stats")
    passed = rows.where(~F.col("base_failed"))
    # Levels of a row: its source, its language, the table. The first with enough vectors, which sorts lowest, judges it.
    levels = F.explode(F.array(F.concat(F.lit("0:"), "own"), F.concat(F.lit("1:"), "wide"), F.lit("2:"))).alias("group")
    seen = stored_once(passed.select(levels, *_X).distinct(), "quality-seen")
    enough = seen.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= how.get("least_rows", LEAST_ROWS)).select("group")
    sources = rows.select("own", "wide").distinct().select("own", "wide", levels).join(enough, "group")
    sources = stored_once(sources.groupBy("own", "wide").agg(F.min("group").alias("group")), "quality-levels")
    rows = rows.join(sources, ["own", "wide"], "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row_key"), F.lit(PARTS)).cast("int"))
    vectors = seen.join(sources.select("group").distinct(), "group", "left_semi")
    vectors = stored_once(vectors.withColumn("part", F.pmod(F.xxhash64(*_X), F.lit(PARTS)).cast("int")), "quality-vectors")
    fits = fitted(vectors, **how)
    distance = _distance("fit") / F.col("scale")
    fits = fits.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return rows.join(fits, ["group", "part"], "left").select(
        "doc_id", "row_key", *STATS, "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & F.coalesce(distance <= cutoff, F.lit(True))).alias("kept"),
    )


def row_key(key: str, text: str, group: tuple[str, ...]) -> Column:
    """The same for rows of the same id, group and text, which have the same verdict."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("?")) for c in (key, *group)]
    return F.md5(F.concat_ws("\x1f", *parts, F.md5(F.coalesce(F.col(text), F.lit("")))))


def passing(docs: DataFrame, key: str = "doc_id", text: str = "text", group: tuple[str, ...] = ("lang", "source"), **how) -> DataFrame:
    """The documents that are kept, with their own columns."""
    good = judged(docs, key, text, group, **how).where("kept").select(F.col("row_key").alias("__key")).distinct()
    return docs.withColumn("__key", row_key(key, text, group)).join(good, "__key", "left_semi").select(*[f"`{c}`" for c in docs.columns])
