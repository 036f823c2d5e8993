"""Ranking metrics and statistics over scored pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bipartia.operators.skew import running_sums


def _thresholds(scored: DataFrame, by: list[str]) -> DataFrame:
    """Positives and rows at each distinct score, so that sums run over scores, never over rows."""
    return scored.groupBy(*by, "score").agg(F.sum("label").cast("double").alias("tp"), F.count(F.lit(1)).cast("double").alias("n"))


def average_precision(scored: DataFrame, by: list[str]) -> DataFrame:
    """Step-wise average precision and tie-aware AUROC of (by, score, label): by, n_pos, n_neg, ap, auroc.

    Scores that are equal are one threshold. Null where a group has no positive (or, for auroc, no negative).
    """
    t = running_sums(_thresholds(scored, by).withColumn("_down", -F.col("score")), by, ["_down"], ["tp", "n"]).withColumnsRenamed({"_to_tp": "ctp", "_to_n": "cn"})
    total = t.groupBy(*by).agg(
        F.sum("tp").alias("p"), F.sum("n").alias("all"), F.sum(F.col("tp") * F.col("ctp") / F.col("cn")).alias("ap"),
        F.sum((F.col("n") - F.col("tp")) * (F.col("ctp") - F.col("tp") / 2)).alias("above"),
    )
    neg = F.col("all") - F.col("p")
    return total.select(
        *by, F.col("p").cast("bigint").alias("n_pos"), neg.cast("bigint").alias("n_neg"),
        F.when(F.col("p") > 0, F.col("ap") / F.col("p")).alias("ap"), F.when((F.col("p") > 0) & (neg > 0), F.col("above") / (F.col("p") * neg)).alias("auroc"),
    )


def mann_whitney(scored: DataFrame, by: list[str]) -> DataFrame:
    """AUC from average ranks, with z of the normal approximation without tie correction and its two-sided p: by, auc, z, p."""
    t = running_sums(_thresholds(scored, by), by, ["score"], ["n"])
    t = t.withColumn("rank", F.col("_to_n") - F.col("n") + (F.col("n") + 1) / 2)
    s = t.groupBy(*by).agg(F.sum("tp").alias("p"), (F.sum("n") - F.sum("tp")).alias("m"), F.sum(F.col("tp") * F.col("rank")).alias("r")).filter("p > 0 and m > 0")
    u = F.col("r") - F.col("p") * (F.col("p") + 1) / 2
    sd = F.sqrt(F.col("p") * F.col("m") * (F.col("p") + F.col("m") + 1) / 12)
    z = (u - F.col("p") * F.col("m") / 2) / sd
    return s.select(*by, (u / (F.col("p") * F.col("m"))).alias("auc"), z.alias("z"), erfc(F.abs(z) / F.lit(math.sqrt(2))).alias("p"))


# Coefficients of a rational approximation of erfc, error below 1.5e-7. Fixed values.
_ERFC = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0."""
    t = 1 / (1 + F.lit(0.3275911) * x)
    series = F.lit(0.0)
    for c in reversed(_ERFC):
        series = (series + F.lit(c)) * t
    return series * F.exp(-x * x)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with a whole number of degrees of freedom, by the finite series in cos(atan(t / sqrt(df)))."""
    cos2, sin = df / (df + t * t), F.abs(t) / F.sqrt(df + t * t)
    odd = df % 2 != 0
    # Terms c^0, 1/2 c^2, 1 3/(2 4) c^4, ... for even, c, 2/3 c^3, 2 4/(3 5) c^5, ... for odd numbers of degrees.
    ratio = lambda j: F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j)) * cos2
    first = F.when(odd, F.sqrt(cos2)).otherwise(1.0)
    steps = F.filter(F.sequence(F.lit(0), (df / 2).cast("int")), lambda j: (j > 0) & (2 * j < F.when(odd, df - 1).otherwise(df)))
    series = F.aggregate(steps, F.struct(first.alias("x"), first.alias("s")), lambda a, j: F.struct((a["x"] * ratio(j)).alias("x"), (a["s"] + a["x"] * ratio(j)).alias("s")), lambda a: a["s"])
    series = F.when(df == 1, 0.0).otherwise(series)
    return 1 - F.when(odd, F.lit(2 / math.pi) * (F.atan(F.abs(t) / F.sqrt(df)) + sin * series)).otherwise(sin * series)


def top_ranked(scored: DataFrame, by: list[str], k: int, tie: str) -> DataFrame:
    """The k best rows of each group, ties by ``tie``: with rank."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), tie))
    return scored.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)


def recall_at(scored: DataFrame, by: list[str], query: str, item: str, ks: list[int]) -> DataFrame:
    """Macro mean over queries with positives of the share of positives among the k best: by, k, n_queries, recall."""
    pos = scored.groupBy(*by, query).agg(F.sum("label").alias("p")).filter("p > 0")
    return recall_of_top(top_ranked(scored, [*by, query], max(ks), item), pos, by, query, ks)


def recall_of_top(top: DataFrame, pos: DataFrame, by: list[str], query: str, ks: list[int]) -> DataFrame:
    """``recall_at`` from the best rows (by, query, rank, label) and the positives ``p`` of each query that has any, by all or some of
    ``by``."""
    hits = top.groupBy(*by, query).agg(*[F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)).alias(f"h{k}") for k in ks])
    rows = pos.join(hits, [c for c in pos.columns if c != "p"])
    each = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), (F.col(f"h{k}") / F.col("p")).alias("r")) for k in ks])).alias("x")
    return rows.select(*by, each).groupBy(*by, F.col("x.k").alias("k")).agg(F.count(F.lit(1)).alias("n_queries"), F.avg("x.r").alias("recall"))


def precision_at(scored: DataFrame, by: list[str], k: int, tie: str) -> DataFrame:
    """Share of positives among the k best of each group (or all, if fewer): by, n, precision."""
    return top_ranked(scored, by, k, tie).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("label").cast("double")).alias("precision"))


def personalization(scored: DataFrame, by: list[str], item: str) -> DataFrame:
    """Mean over items of the population deviation of their scores across queries."""
    return scored.groupBy(*by, item).agg(F.stddev_pop("score").alias("s")).groupBy(*by).agg(F.avg("s").alias("personalization"))


def log_factorial(n: Column) -> Column:
    """ln(n!) of a whole number: summed logarithms up to 20, beyond that Stirling's series (error below 1e-13)."""
    x = n.cast("double")
    small = F.element_at(F.array(*[F.lit(math.lgamma(i + 1)) for i in range(21)]), (F.least(n, F.lit(20)) + 1).cast("int"))
    y = F.greatest(x, F.lit(1.0))
    large = (y + 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return F.when(n <= 20, small).otherwise(large)


def hypergeom_tail(k: Column | str, big_n: Column | str, good: Column | str, drawn: Column | str) -> Column:
    """P(at least k of ``drawn`` without replacement from big_n, of which ``good`` are good), from log-factorials."""
    k, n, g, m = ((F.col(c) if isinstance(c, str) else c).cast("bigint") for c in (k, big_n, good, drawn))
    choose = lambda a, b: log_factorial(a) - log_factorial(b) - log_factorial(a - b)
    low, high = F.greatest(k, m - (n - g), F.lit(0)), F.least(g, m)
    one = lambda i: F.exp(choose(g, i) + choose(n - g, m - i) - choose(n, m))
    total = F.aggregate(F.sequence(low, F.greatest(low, high)), F.lit(0.0), lambda s, i: s + one(i))
    return F.when(m <= n, F.when(low <= high, F.least(total, F.lit(1.0))).otherwise(0.0))


def summarize(values: DataFrame, by: list[str]) -> DataFrame:
    """Over folds: number, mean, population and sample deviation of ``value``, nulls left out."""
    return values.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_pop"), F.stddev_samp("value").alias("std_samp"))


def paired(values: DataFrame, by: list[str], pair: str, model: str, a: str, b: str) -> DataFrame:
    """Paired t against 0 with its two-sided p, and Cohen's d, of model a minus model b: by, n, mean_diff, t, d, p."""
    va = values.filter(F.col(model) == a).select(*by, pair, F.col("value").alias("va"))
    vb = values.filter(F.col(model) == b).select(*by, pair, F.col("value").alias("vb"))
    diff = va.join(vb, [*by, pair]).withColumn("x", F.col("va") - F.col("vb"))
    s = diff.groupBy(*by).agg(F.count("x").alias("n"), F.avg("x").alias("mean_diff"), F.stddev_samp("x").alias("sd"))
    ok = (F.col("n") > 1) & (F.col("sd") > 0)
    t = F.col("mean_diff") / (F.col("sd") / F.sqrt("n"))
    return s.select(*by, "n", "mean_diff", F.when(ok, t).alias("t"), F.when(ok, F.col("mean_diff") / F.col("sd")).alias("d"), F.when(ok, t_two_sided(t, F.col("n") - 1)).alias("p"))


def golden_compare(actual: DataFrame, expected: DataFrame, on: list[str], digits: int = 3) -> DataFrame:
    """Where ``value`` of the two differs after rounding, or one side has no row: the keys, actual, expected."""
    both = actual.select(*on, F.round("value", digits).alias("actual")).join(expected.select(*on, F.round("value", digits).alias("expected")), on, "full")
    return both.filter(~F.col("actual").eqNullSafe(F.col("expected")))
