"""Quality rules: base rules and robust multivariate outliers.  Only DataFrame
functions; no Python runs on the executors.

The statistics of a text become a vector whose bulk is close to normal: logarithm
of the words; mean word length against the median of its language and source, times
the root of the words (as the mean of many words varies less); and three rates per
page of ``PAGE`` words: symbols, repeated lines, repeated passages.  Most texts have
none of the latter, so a count stands for a draw above it: an exponential variate,
drawn from a hash of the text, is added before the power that makes such variates
near normal.  One event more or less is thus the scale of a rate that is zero in the bulk.

For every language and source a minimum-covariance-determinant estimate gives
centre and covariance of the bulk.  Three starts (spreads alone, moments of tanh,
moments of spatial signs, around medians) take ``EXPLORE`` concentration steps, each
the moments of the share ``BULK`` of the rows with the smallest distances; the start
of the smallest determinant goes on until no determinant falls.  Moments of the rows
within the 97.5% distance are the estimate.  Factors for either share follow from
the chi-squared distribution.  A row whose squared Mahalanobis distance exceeds
``CUT`` is an outlier.

Rows meet no others: each is read once, its numbers are written to a scratch table,
and every step is two partial aggregates, counts over (language, source, distance
class) and sums over (language, source), so a source with a third of all rows is no
hot key.  The estimates, a row per language and source, are joined back by Catalyst's
choice.  Groups of few rows lean on the estimate pooled over all groups, in
proportion; no variance has a floor but against division by zero.  Where the bulk of
a source is one text, any other text there is far from it.

Defined results: a null or empty text has no words and fails the base rules; a
null language or source is a group of its own.  Repeated rows give repeated
rows.  Windows are compared by 64-bit hashes of their words, within one text.
Columns besides those named are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 3
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent

X = [f"x{i}" for i in range(5)]
P = len(X)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
KEYS = ["__lang", "__source"]
START = "__start"


def chi_squared(x: float, p: int) -> float:
    """Distribution function of chi-squared with ``p`` degrees of freedom."""
    at, value = (1, math.erf(math.sqrt(x / 2))) if p % 2 else (2, 1 - math.exp(-x / 2))
    for k in range(at, p, 2):
        value -= (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return value


def chi_quantile(share: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared(mid, p) < share else (low, mid)
    return high


def consistent(share: float, p: int = P) -> float:
    """What the covariance of the nearest ``share`` of normal rows is too small by."""
    return share / chi_squared(chi_quantile(share, p), p + 2)


#: Share of a group's rows that the estimate rests on, and that of the final moments.
BULK, NEAR = 0.75, 0.975
#: Steps from every start, most steps of the best one, and the fall of the logarithm
#: of a determinant that counts as one.
EXPLORE, MOST_STEPS, FALL = 2, 30, 1e-3
#: Squared distance from which a row is an outlier: normal rows exceed it once in a million.
CUT = chi_quantile(1 - 1e-6, P)
#: Rows that the pooled estimate counts for in each group's own.
POOLED_ROWS = 30
#: Words of a page, the unit of the rates; words from which a mean length varies no less.
PAGE, STEADY = 250, 2000
#: Power that makes exponential variates near normal.
POWER = 1 / 3.6
FINE = 64  # classes a unit of a statistic, for medians and quartiles
CLASSES = 16  # classes of distances a doubling


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, keys, seed, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(f"__{c}") for c in ("lang", "source")]
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(F.col("t"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select("doc_id", *keys, text.alias("t"))
    seed = F.xxhash64("t").alias("seed")
    df = df.select("doc_id", *KEYS, seed, F.array_remove(F.split("t", SPACE + "+"), "").alias("w"), lines.alias("l"),
                   F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    n = F.size("w")
    at = lambda k: F.get("w", k)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)]))
    df = df.select("doc_id", *KEYS, "seed", n.cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), "n_symbols",
                   (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
                   F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("h"))
    # only where a window repeats: sorted with their places, equal windows are neighbours
    repeats = F.size(F.array_distinct("h")) < F.size("h")
    df = df.withColumn("s", F.when(repeats, F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda k: F.get("s", k)["x"] == F.get("s", k + 1)["x"]
    found = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda k: F.coalesce(same(k), F.lit(False)) | F.coalesce((k > 0) & same(k - 1), F.lit(False)))
    df = df.withColumn("p", F.when(F.col("s").isNotNull(), F.array_sort(F.transform(found, lambda k: F.get("s", k)["i"]))))
    covered = F.aggregate("p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                          lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")))["n"]
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.select("doc_id", *KEYS, "seed", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def quantiles(rows: DataFrame, columns: list[str], shares: tuple[float, ...]) -> DataFrame:
    """(keys, q<k>_<column>): quantiles per group, from counts of classes."""
    classes = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * FINE).alias("b")) for i, x in enumerate(columns)]))
    counted = rows.select(*KEYS, classes.alias("c")).groupBy(*KEYS, "c.i", "c.b").agg(F.count("*").alias("n"))
    of = Window.partitionBy(*KEYS, "i")
    share = counted.withColumn("to", F.sum("n").over(of.orderBy("b")) / F.sum("n").over(of))
    quantile = lambda q, i: F.min(F.when((F.col("i") == i) & (F.col("to") >= q), (F.col("b") + 0.5) / FINE))
    return share.groupBy(*KEYS).agg(*[quantile(q, i).alias(f"q{k}_{x}") for i, x in enumerate(columns) for k, q in enumerate(shares)])


def vector(stats: DataFrame) -> DataFrame:
    """The transformed statistics as columns x0, x1, ..."""
    n = F.greatest("n_words", F.lit(1))
    length = (F.col("word_chars") / n).alias("length")
    usual = written(quantiles(stats.where(~F.col("base_failed")).select(*KEYS, length), ["length"], (0.5,)), "quality-lengths")

    def rate(events: Column, i: int) -> Column:
        u = (F.pmod(F.xxhash64("seed", F.lit(i)), F.lit(1 << 52)) + 0.5) / (1 << 52)
        return F.pow((events - F.log(u)) / (1 + n / PAGE), F.lit(POWER))

    values = (F.log(n), (F.col("word_chars") / n - F.coalesce("q0_length", F.lit(0.0))) * F.sqrt(n / (1 + n / STEADY)),
              rate(F.col("n_symbols"), 2), rate(F.col("n_dup_lines"), 3), rate(F.col("n_repeat_words") / (2 * WINDOW), 4))
    joined = stats.join(usual, KEYS, "left")
    return joined.select(*[c for c in stats.columns if c != "seed"], *[v.cast("double").alias(x) for v, x in zip(values, X, strict=True)])


def cholesky(rows: DataFrame) -> DataFrame:
    """Adds the factor l00.. of the matrix c00.. and the logarithm of its determinant."""
    steps = []
    for i, j in PAIRS:
        rest = " - ".join([f"c{i}{j}", *[f"l{i}{k} * l{j}{k}" for k in range(j)]])
        steps.append(f"sqrt(greatest({rest}, 1e-9D * c{i}{i}, 1e-12D)) AS l{i}{j}" if i == j else f"({rest}) / l{j}{j} AS l{i}{j}")
    return rows.selectExpr("*", *steps, "2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(P)) + ") AS determinant")


ESTIMATE = [*KEYS, START, *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in PAIRS], "determinant"]


def starting(rows: DataFrame) -> DataFrame:
    """Three estimates per group: medians with quartile spreads, and with the
    correlations of tanh and of spatial signs of what these standardise."""
    q = quantiles(rows, X, (0.25, 0.5, 0.75))
    # half a class against groups without spread
    spread = lambda x: F.greatest((F.col(f"q2_{x}") - F.col(f"q0_{x}")) / 1.349, F.lit(0.5 / FINE))
    q = written(q.select(*KEYS, *[F.col(f"q1_{x}").alias(f"m{i}") for i, x in enumerate(X)], *[spread(x).alias(f"s{i}") for i, x in enumerate(X)]), "quality-medians")
    z = rows.join(q, KEYS).select(*KEYS, *[((F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}")).alias(f"z{i}") for i, x in enumerate(X)])
    z = z.withColumn("zz", reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)]) + 1e-9)
    sums = [*[F.sum(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}{j}") for i, j in PAIRS],
            *[F.sum(F.col(f"z{i}") * F.col(f"z{j}") / F.col("zz")).alias(f"g{i}{j}") for i, j in PAIRS]]
    of = q.join(z.groupBy(*KEYS).agg(F.count("*").alias("n"), *sums), KEYS)

    def start(kind: str) -> DataFrame:
        def c(i: int, j: int) -> Column:
            own = F.col(f"s{i}") * F.col(f"s{j}")
            if i == j or not kind:
                return own if i == j else F.lit(0.0)
            r = F.col(f"{kind}{i}{j}") / F.sqrt((F.col(f"{kind}{i}{i}") + 1e-9) * (F.col(f"{kind}{j}{j}") + 1e-9))
            return own * r * F.col("n") / (F.col("n") + POOLED_ROWS)

        return cholesky(of.select(*KEYS, F.lit(kind).alias(START), *[f"m{i}" for i in range(P)], *[c(i, j).alias(f"c{i}{j}") for i, j in PAIRS])).select(*ESTIMATE)

    return written(reduce(DataFrame.unionByName, [start(k) for k in ("", "t", "g")]), "quality-start")


def measured(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Adds the squared Mahalanobis distance, by forward substitution in the Cholesky factor."""
    steps = [f"({' - '.join([f'x{i} - m{i}', *[f'l{i}{j} * z{j}' for j in range(i)]])}) / l{i}{i} AS z{i}" for i in range(P)]
    joined = rows.join(estimate, KEYS, "left").selectExpr(*rows.columns, START, *steps, " + ".join(f"z{i} * z{i}" for i in range(P)) + " AS d")
    return joined.drop(*[f"z{i}" for i in range(P)])


def moments(near: DataFrame, factor: float, name: str) -> DataFrame:
    """Estimates from the moments of the rows ``near``, leaning on those pooled over all groups."""
    names = {f"m{i}": f"avg(x{i})" for i in range(P)} | {f"c{i}{j}": f"covar_pop(x{i}, x{j})" for i, j in PAIRS}
    own = near.groupBy(*KEYS, START).agg(F.count("*").alias("n"), *[F.expr(f"{e} AS own_{c}") for c, e in names.items()])
    # a row per start, three at most
    pooled = F.broadcast(own.groupBy(START).agg(*[F.expr(f"sum(own_{c} * n) / sum(n) AS all_{c}") for c in names]))
    blend = lambda c: f"(own_{c} * n + all_{c} * {POOLED_ROWS}) / (n + {POOLED_ROWS})"
    # about the centre that is used, which a group of few rows shares with others
    matrix = [f"{blend(f'c{i}{j}')} * {factor!r}D + (own_m{i} - m{i}) * (own_m{j} - m{j}) AS c{i}{j}" for i, j in PAIRS]
    e = own.join(pooled, START).selectExpr(*KEYS, START, *[f"{blend(f'm{i}')} AS m{i}" for i in range(P)], *matrix)
    return written(cholesky(e).select(*ESTIMATE), name)


def concentrate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step: moments of the share ``BULK`` of the rows that is nearest."""
    near = measured(rows, estimate).withColumn("b", F.floor(CLASSES * F.log2(F.col("d") + 1e-3)))
    of = Window.partitionBy(*KEYS, START)
    counted = near.groupBy(*KEYS, START, "b").agg(F.count("*").alias("n"))
    to = counted.withColumn("to", F.sum("n").over(of.orderBy("b"))).withColumn("all", F.sum("n").over(of))
    top = to.where(F.col("to") >= BULK * F.col("all")).groupBy(*KEYS, START).agg(F.min("b").alias("top"))
    return moments(near.join(top, [*KEYS, START]).where("b <= top"), consistent(BULK), "quality-estimate")


def estimated(rows: DataFrame) -> DataFrame:
    """The estimate of each language and source."""
    estimate = starting(rows)
    for _ in range(EXPLORE):
        estimate = concentrate(rows, estimate)
    least = F.row_number().over(Window.partitionBy(*KEYS).orderBy("determinant", START))
    estimate = written(estimate.withColumn("r", least).where("r = 1").drop("r").withColumn(START, F.lit("best")), "quality-best")
    for _ in range(MOST_STEPS):
        new = concentrate(rows, estimate)
        pair = estimate.alias("a").join(new.alias("b"), KEYS)
        fell = F.col("b.determinant") < F.col("a.determinant") - FALL
        chosen = pair.select(*KEYS, *[F.when(fell, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ESTIMATE[2:]], fell.alias("fell"))
        estimate = written(chosen, "quality-best")
        if estimate.where("fell").isEmpty():
            break
        estimate = estimate.drop("fell")
    estimate = estimate.select(*ESTIMATE)
    near = measured(rows, estimate).where(F.col("d") <= chi_quantile(NEAR, P))
    final = moments(near, consistent(NEAR), "quality-final")
    pair = estimate.alias("a").join(final.alias("b"), KEYS, "left")  # a group with no row that near keeps what it has
    return pair.select(*KEYS, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in ESTIMATE[2:]])


def assess(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """(doc_id, the statistics, base_failed, distance, kept) of every row."""
    rows = written(vector(written(statistics(docs), "quality-statistics")), "quality-vectors")
    found = measured(rows, estimated(rows.where(~F.col("base_failed"))))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        F.col("d").alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("d") <= cut, F.lit(False))).alias("kept"))
