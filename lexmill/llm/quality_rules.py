"""Quality rules: base rules, then robust multivariate outliers. DataFrame functions only.

Each document gets six transformed statistics (``VECTOR``, in thousandths, so
that sums over any number of rows are exact): log word count, log mean word
length, and square roots of the shares of symbols, repeated lines, repeated
words and capitals. For each language and source the regularised minimum-
covariance-determinant estimate of centre and scatter is sought as in FastMCD
(Rousseeuw and Van Driessen, 1999; Boudt et al., 2020, for the regular target):
three starts take two concentration steps each (the ``SUPPORT`` nearest documents
give the next centre and scatter), the start whose scatter has the least
determinant goes on until its determinant falls no more. A scatter is the
covariance of the support times ``CONSISTENCY`` plus a target, the squares of
``FLOORS``: a statistic that is constant in most documents rejects nobody by a
trifle. A document is rejected whose squared Mahalanobis distance, scaled so that
its group's median is that of the normal model, is above ``CUTOFF``. Clean texts
have longer tails than the normal model: of the documents that the test tables
label as good, 2.3 in 100 are above its 0.999 quantile (22.5) and none above 45,
while planted outliers begin at 100; so the cutoff is a far quantile.

Groups under ``LEAST`` documents are pooled by language, then over all; a pool
that is still under ``LEAST`` rejects nobody. Null languages and sources are
values of their own. Documents that fail the base rules are left out of the
estimates. Every step is an aggregate over all rows with partial sums, so a
source with a third of the rows is one more group; estimates of up to
``FEW_GROUPS`` groups are broadcast, more are joined with salted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import WORD, checkpointed, discard, words_of

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words
SYMBOLS = "#*$%&|<>"
VECTOR = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats", "x_capitals")
#: Least standard deviations, in thousandths.
FLOORS = (1000, 100, 60, 250, 250, 100)
SUPPORT = 0.75
#: 0.75 divided by the share of chi-squared with eight degrees of freedom below the 0.75 quantile of that with six.
CONSISTENCY = 1.362
LEAST = 100
#: A step that lowers the log determinant by less is the last.
TOLERANCE = 1e-3
FEW_GROUPS = 10_000
SALTS = 64
#: Median of chi-squared with six degrees of freedom.
MEDIAN = 5.348
#: The quantile of chi-squared with six degrees of freedom at 1 - 5e-11.
CUTOFF = 60.0
#: Squared distances are ranked in steps of 0.2 per cent.
BINS = 500.0
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base statistics and n_lines, n_capitals. Null and empty texts have zeros everywhere."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n", -1), lambda line: line.rlike(WORD))
    step = docs.withColumns({"__plain": words_of(F.col(text)), "__lines": lines})
    step = step.withColumn("__words", F.transform("__plain", lambda w: F.xxhash64(w)))
    word = F.col("__words")
    # Hashes of runs of 1, 2, 4 and 8 words, each a column, so that none is computed twice; an array's last ones reach past its end.
    runs, width = word, 1
    while width < WINDOW:
        longer = F.zip_with(runs, F.slice(runs, width + 1, F.greatest(F.size(word), F.lit(1))), lambda a, b: F.xxhash64(a, b))
        width *= 2
        step = step.withColumn(f"__runs{width}", longer)
        runs = F.col(f"__runs{width}")
    step = step.withColumns(
        {
            "n_words": F.size(word).cast("long"),
            "word_chars": F.length(F.array_join("__plain", "")).cast("long"),
            "n_symbols": F.regexp_count(value, F.lit(f"[{SYMBOLS}]")).cast("long"),
            "n_capitals": F.regexp_count(value, F.lit("[A-Z]")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__windows": F.when(F.size(word) >= WINDOW, F.slice(runs, 1, F.greatest(F.size(word) - (WINDOW - 1), F.lit(1)))),
        }
    )
    windows = F.col("__windows")
    # Only texts with a repeated window are looked at more closely.
    step = step.withColumn("__sorted", F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    ranked = F.col("__sorted")

    def again(k: Column) -> Column:
        own = F.get(ranked, k)["h"]
        return F.coalesce(F.get(ranked, k - 1)["h"] == own, F.lit(False)) | F.coalesce(F.get(ranked, k + 1)["h"] == own, F.lit(False))

    found = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), again), lambda k: F.get(ranked, k)["i"]))
    step = step.withColumn("__found", F.when(ranked.isNotNull(), found))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("until"))
    total = F.aggregate("__found", start, lambda a, p: F.struct((a["total"] + WINDOW - F.greatest(F.lit(0), a["until"] - p)).alias("total"), (p + WINDOW).alias("until")), lambda a: a["total"])
    return step.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("__plain", "__words", "__runs2", "__runs4", "__runs8", "__lines", "__windows", "__sorted", "__found")


def _share(part: str, whole: str) -> Column:
    return F.sqrt(F.least(F.col(part) / F.greatest(F.col(whole), F.lit(1)), F.lit(1.0)))


def _vector() -> dict[str, Column]:
    exact = (
        F.log1p(F.col("n_words")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        _share("n_symbols", "word_chars"),
        _share("n_dup_lines", "n_lines"),
        _share("n_repeat_words", "n_words"),
        _share("n_capitals", "word_chars"),
    )
    return {name: F.round(x * 1000).cast("long") for name, x in zip(VECTOR, exact, strict=True)}


def _groups(rows: DataFrame) -> DataFrame:
    """__group of each language and source: its own, or the pool that takes in groups too small."""
    own = rows.groupBy("__lang", "__source").agg(F.count(F.lit(1)).alias("n"))
    pool = own.where(F.col("n") < LEAST).groupBy("__lang").agg(F.sum("n").alias("pooled"))
    named = F.when(F.col("n") >= LEAST, F.concat_ws("\x01", F.lit("source"), "__lang", "__source")).when(F.col("pooled") >= LEAST, F.concat_ws("\x01", F.lit("lang"), "__lang")).otherwise(F.lit("all"))
    return checkpointed(own.join(pool, "__lang", "left").select("__lang", "__source", named.alias("__group")), "groups")


def _matched(rows: DataFrame, found: DataFrame, on: list[str], few: bool, how: str = "inner") -> DataFrame:
    """rows with what was found for their group: by broadcast, or by keys with a salt, as one group may hold a third of the rows."""
    if few:
        return rows.join(F.broadcast(found), on, how)
    salted = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*VECTOR), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"], how).drop("__salt")


def _distance(rows: DataFrame) -> DataFrame:
    """Adds __d2 from centre m* and Cholesky factor l*."""
    for i, x in enumerate(VECTOR):
        rest = F.col(x) - F.col(f"m{i}") - sum((F.col(f"l{i}{j}") * F.col(f"z{j}") for j in range(i)), F.lit(0.0))
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("__d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(len(VECTOR))), F.lit(0.0)))


_CENTRE = [f"m{i}" for i in range(len(VECTOR))]
_LOWER = [f"l{i}{j}" for i in range(len(VECTOR)) for j in range(i + 1)]


def _factor(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Centre, Cholesky factor of the regularised scatter and the log of its determinant, from exact sums."""
    n = F.col("n").cast("double")
    out = sums.withColumns({f"m{i}": F.col(f"s{i}") / n for i in range(len(VECTOR))})
    for i in range(len(VECTOR)):
        for j in range(i + 1):
            cov = (F.col(f"q{j}{i}") / n - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY + (F.lit(float(FLOORS[i] ** 2)) if i == j else F.lit(0.0))
            rest = cov - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            # The target bounds what is left of a variance; the bound holds against rounding only.
            value = F.sqrt(F.greatest(rest, F.lit(0.999 * FLOORS[i] ** 2))) if i == j else rest / F.col(f"l{j}{j}")
            out = out.withColumn(f"l{i}{j}", value)
    return out.select(*keys, *_CENTRE, *_LOWER, (F.lit(2.0) * sum((F.log(f"l{i}{i}") for i in range(len(VECTOR))), F.lit(0.0))).alias("logdet"))


def _sums() -> list[Column]:
    size = range(len(VECTOR))
    products = [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"q{i}{j}") for i in size for j in size if j >= i]
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(VECTOR)], *products]


def _starts(rows: DataFrame) -> DataFrame:
    """Three starts for each group: medians with quartile scales, medians with the target's, all rows' mean and covariance."""
    size = range(len(VECTOR))
    quartiles = rows.groupBy("__group").agg(*[F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i, x in enumerate(VECTOR)])

    def diagonal(number: int, scales: list[Column]) -> DataFrame:
        lower = [(scales[i] if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in size for j in range(i + 1)]
        return quartiles.select("__group", F.lit(number).alias("__start"), *[F.col(f"p{i}")[1].alias(f"m{i}") for i in size], *lower, F.lit(1e300).alias("logdet"))

    spread = [F.greatest((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, F.lit(float(FLOORS[i]))) for i in size]
    whole = _factor(rows.groupBy("__group").agg(*_sums()).withColumn("__start", F.lit(2)), ["__group", "__start"])
    return diagonal(0, spread).unionByName(diagonal(1, [F.lit(float(x)) for x in FLOORS])).unionByName(whole.withColumn("logdet", F.lit(1e300)))


def _concentrated(rows: DataFrame, fit: DataFrame, few: bool) -> DataFrame:
    """The next centre and scatter of each group and start, from the rows nearest to the last ones."""
    keys = ["__group", "__start"]
    near = _distance(_matched(rows, fit.drop("logdet"), ["__group"], few)).withColumn("__bin", F.floor(F.log1p("__d2") * BINS))
    limit = near.groupBy(*keys).agg(F.percentile("__bin", F.lit(SUPPORT)).alias("__limit"))
    chosen = _matched(near, limit, keys, few).where(F.col("__bin") <= F.col("__limit"))
    return _factor(chosen.groupBy(*keys).agg(*_sums()), keys)


def estimates(rows: DataFrame, few: bool = True) -> DataFrame:
    """For each __group the centre, the factor and the log determinant of the scatter, the median of the squared distances and the size."""
    fit = checkpointed(_starts(rows), "mcd")
    for _ in range(2):
        last, fit = fit, checkpointed(_concentrated(rows, fit, few), "mcd")
        discard(last)
    best = F.min_by(F.struct("__start", *_CENTRE, *_LOWER, "logdet"), F.struct("logdet", "__start")).alias("best")
    fit = checkpointed(fit.groupBy("__group").agg(best).select("__group", "best.*"), "mcd")
    moving = fit.select("__group")  # the groups whose determinant still falls
    while True:
        old = fit.join(moving, "__group", "left_semi")
        new = checkpointed(_concentrated(_matched(rows, moving, ["__group"], few), old, few), "mcd")
        pairs = new.join(old.select("__group", F.col("logdet").alias("__old")), "__group")
        better = checkpointed(pairs.where(F.col("logdet") < F.col("__old")), "mcd")
        fit = checkpointed(fit.join(better.select("__group"), "__group", "left_anti").unionByName(better.select(*fit.columns)), "mcd")
        moving = better.where(F.col("logdet") < F.col("__old") - TOLERANCE).select("__group")
        if moving.isEmpty():
            break
    near = _distance(_matched(rows, fit, ["__group"], few))
    middle = near.groupBy("__group").agg(F.expm1(F.percentile(F.floor(F.log1p("__d2") * BINS), F.lit(0.5)) / BINS).alias("__middle"), F.count(F.lit(1)).alias("__n"))
    return checkpointed(fit.drop("__start").join(middle, "__group"), "mcd")


def judge(docs: DataFrame, keep: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Columns ``keep`` (all, if none are named), the base statistics, base_failed, distance2 (null if base_failed) and kept.

    Input columns of the added names are dropped.
    """
    added = [*BASE, "base_failed", "distance2", "kept"]
    own = [c for c in (keep if keep is not None else docs.columns) if c not in added]
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)], F.col(text).alias("__text"), F.coalesce(F.col(lang), F.lit("\x00")).alias("__lang"), F.coalesce(F.col(source).cast("string"), F.lit("\x00")).alias("__source"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    measured = with_statistics(plain, "__text").withColumn("base_failed", failed).drop("__text").withColumns(_vector())
    rows = checkpointed(measured, "statistics")
    good = rows.where(~F.col("base_failed")).select("__lang", "__source", *VECTOR)
    keys = _groups(good)
    few = keys.count() <= FEW_GROUPS
    fits = estimates(_matched(good, keys, ["__lang", "__source"], few), few)
    scored = _distance(_matched(rows, keys.join(fits, "__group", "left"), ["__lang", "__source"], few, "left"))
    distance = F.when(~F.col("base_failed") & (F.col("__n") >= LEAST), F.col("__d2") * MEDIAN / F.greatest(F.col("__middle"), F.lit(MEDIAN / 4)))
    scored = scored.withColumn("distance2", distance).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(True)))
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)], *added)


def keep_documents(docs: DataFrame, **options: str) -> DataFrame:
    """The documents that are kept, with their columns; a column named like an added one comes back as it was."""
    safe = [f"k{i}" for i in range(len(docs.columns))]
    names = dict(zip(docs.columns, safe, strict=True))
    renamed = docs.toDF(*safe)
    judged = judge(renamed, text=names[options.get("text", "text")], lang=names[options.get("lang", "lang")], source=names[options.get("source", "source")])
    return judged.where("kept").select(*safe).toDF(*docs.columns)
