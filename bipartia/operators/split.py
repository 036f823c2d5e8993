"""Folds, scenarios and negatives, the same on every run and in every engine: order comes from md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bipartia.functions.vectors import bucket
from bipartia.operators.skew import number_within_key
from bipartia.sources.tables import cut, release


def hash_order(seed: int, tag: str, *cols: str) -> Column:
    return F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(tag), *cols))


def folds(df: DataFrame, cols: list[str], tag: str, k: int = 5, seed: int = 2026) -> DataFrame:
    """``cols`` and fold 1..k: equal shares in hash order, the first n mod k folds have one more. Any number of rows."""
    rows = df.select(*cols, F.lit(tag).alias("_tag"), hash_order(seed, tag, *cols).alias("_h"))
    numbered = number_within_key(rows, ["_tag"], ["_h", *cols])
    n = df.count()
    big, size = n % k, n // k
    edge = big * (size + 1)
    fold = F.when(F.col("_seq") < edge, F.floor(F.col("_seq") / F.lit(size + 1))).otherwise(big + F.floor((F.col("_seq") - edge) / F.lit(max(size, 1))))
    return numbered.select(*cols, (fold + 1).cast("bigint").alias("fold"))


def scenario(pairs: DataFrame, fold_l: DataFrame, fold_d: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(train, eval) pairs of each fold, with column fold. name: disease (d cold), lncrna (l cold) or both.

    For ``both``, fold i holds out the l of fold i and the d of fold i together: k diagonal blocks.
    """
    k = F.broadcast(fold_d.select("fold").distinct())  # one row per fold
    tagged = pairs.join(fold_l.withColumnRenamed("fold", "fl"), "l").join(fold_d.withColumnRenamed("fold", "fd"), "d")
    each = tagged.crossJoin(k)
    cold_l, cold_d = F.col("fl") == F.col("fold"), F.col("fd") == F.col("fold")
    train, test = {"disease": (~cold_d, cold_d), "lncrna": (~cold_l, cold_l), "both": (~cold_l & ~cold_d, cold_l & cold_d)}[name]
    return each.filter(train).select("fold", "l", "d"), each.filter(test).select("fold", "l", "d")


def candidate_blocks(queries: DataFrame, candidates: DataFrame, on: list[str], block: int = 512) -> DataFrame:
    """Every one of ``queries`` (q and other columns) with every one of ``candidates`` (on, c) that agrees in ``on``.

    ``queries`` is a stated query set. It is cut into blocks of about ``block`` rows; each candidate goes once to each block,
    and the pairs of a block are made where its rows meet, by an equi-join on the block.
    """
    n = max(1, -(-queries.count() // block))
    qs = queries.withColumn("_b", F.pmod(F.xxhash64("q"), F.lit(n)))
    cs = candidates.select(*on, "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("_b"))
    return qs.join(cs, [*on, "_b"]).drop("_b")


def negatives(positives: DataFrame, known: DataFrame, tries: int = 3, seed: int = 2026) -> DataFrame:
    """As many unknown pairs as positives in each fold, or all there are if there are fewer: fold, l, d.

    Every positive's l proposes ``tries`` d of the fold's evaluated d, drawn by hash; proposals that are known pairs or
    come twice go, the first of the rest in hash order stay. A fold that is so dense that proposals do not suffice takes the
    rest from its unknown pairs of evaluated l and d, in hash order; only such a fold's grid is formed, in blocks.
    """
    pool = positives.select("fold", "d").distinct()
    n_pool = pool.groupBy("fold").agg(F.count(F.lit(1)).alias("np"))
    places = number_within_key(pool.withColumn("_h", hash_order(seed, "pool", "d")), ["fold"], ["_h", "d"]).select("fold", F.col("d").alias("nd"), F.col("_seq").alias("at"))
    draw = positives.join(F.broadcast(n_pool), "fold").select("fold", "l", "d", "np", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))).alias("t"))
    at = bucket(F.concat_ws("/", F.lit(str(seed)), "fold", "l", "d", F.col("t").cast("string")), F.col("np"))
    cand = draw.select("fold", "l", at.alias("at")).join(places, ["fold", "at"]).select("fold", "l", F.col("nd").alias("d")).distinct()
    tag = hash_order(seed, "neg", F.col("fold").cast("string"), "l", "d").alias("_h")
    cand = cand.join(known.select("l", "d"), ["l", "d"], "left_anti").select("fold", "l", "d", tag)
    want = cut(positives.groupBy("fold").agg(F.count(F.lit(1)).alias("want")))
    numbered = number_within_key(cand, ["fold"], ["_h"])
    got = cut(numbered.join(F.broadcast(want), "fold").filter("_seq < want").select("fold", "l", "d"))
    release(numbered._sorted)
    short = want.join(got.groupBy("fold").agg(F.count(F.lit(1)).alias("have")), "fold", "left").select("fold", (F.col("want") - F.coalesce("have", F.lit(0))).alias("lack"))
    short = cut(short.filter("lack > 0"))
    if short.isEmpty():
        return got
    ls = positives.join(F.broadcast(short), "fold", "left_semi").select("fold", F.col("l").alias("q")).distinct()
    grid = candidate_blocks(ls, pool.select("fold", F.col("d").alias("c")), ["fold"]).select("fold", F.col("q").alias("l"), F.col("c").alias("d"))
    rest = grid.join(known.select("l", "d"), ["l", "d"], "left_anti").join(got, ["fold", "l", "d"], "left_anti").select("fold", "l", "d", tag)
    more = number_within_key(rest, ["fold"], ["_h"]).join(F.broadcast(short), "fold").filter("_seq < lack").select("fold", "l", "d")
    return got.unionByName(more)


# Draws by hash for each positive before the exact draw.
ROUNDS = 3


def _draw_unknown(asked: DataFrame, places: DataFrame, sizes: DataFrame, tag: str, known: DataFrame, fallback: DataFrame, seed: int) -> DataFrame:
    """For each of ``asked`` (l, d, bin) an unknown pair (l, neg_d) with neg_d among the ``places`` (bin, at, neg_d) of its bin.

    A place is drawn by hash; where it is a known pair it is drawn again, ROUNDS times in all. What is left draws among
    the unknown neg_d of its bin, numbered in order, and, if there is none, among those of ``fallback`` (d). Only an l
    that is known with every d gets none.
    """
    taken = known.select("l", F.col("d").alias("neg_d"))
    left, out = asked, None
    for i in range(ROUNDS):
        text = F.concat_ws("/", F.lit(str(seed)), F.lit(tag), "l", "d", *([F.lit(str(i))] if i else []))
        drawn = left.join(F.broadcast(sizes), "bin").withColumn("at", bucket(text, F.col("nb"))).join(places, ["bin", "at"])
        good = cut(drawn.join(taken, ["l", "neg_d"], "left_anti").select("l", "d", "neg_d", "bin"))
        out = good if out is None else out.unionByName(good)
        left = cut(left.join(good, ["l", "d"], "left_anti"))
    for pool, on in ((places.select("bin", "neg_d").distinct(), ["bin"]), (fallback.select(F.col("d").alias("neg_d")).distinct(), [])):
        if left.isEmpty():
            break
        # Only the l that are left meet the pool.
        ls = left.select("l", *on).distinct()
        free = (ls.join(pool, on) if on else ls.crossJoin(pool)).join(taken, ["l", "neg_d"], "left_anti")
        free = cut(number_within_key(free.withColumn("_h", hash_order(seed, "free", "l", "neg_d")), ["l", *on], ["_h", "neg_d"]).select("l", *on, "neg_d", F.col("_seq").alias("at")))
        n = free.groupBy("l", *on).agg(F.count(F.lit(1)).alias("nb"))
        at = bucket(F.concat_ws("/", F.lit(str(seed)), F.lit(tag), "l", "d", F.lit("free")), F.col("nb"))
        good = cut(left.join(n, ["l", *on]).withColumn("at", at).join(free, ["l", *on, "at"]).select("l", "d", "neg_d", "bin"))
        out, left = out.unionByName(good), cut(left.join(good, ["l", "d"], "left_anti"))
    return out


def matched_negatives(positives: DataFrame, known: DataFrame, degree: DataFrame, bins: int = 10, seed: int = 2026) -> DataFrame:
    """For each positive (l, d) an unknown pair with a d of the same degree decile, drawn by hash: l, d, neg_d, bin.

    ``degree``: d, deg. Deciles by exact percentiles. A draw that is a known pair is drawn again; where the decile has
    no unknown d for l, any unknown d is taken. bin is that of the positive.
    """
    edges = degree.agg(F.expr(f"percentile(deg, array({', '.join(str(i / bins) for i in range(1, bins))}))").alias("e"))
    binned = cut(degree.crossJoin(F.broadcast(edges)).select("d", F.size(F.filter("e", lambda x: F.col("deg") >= x)).cast("bigint").alias("bin")))
    places = cut(number_within_key(binned.withColumn("_h", hash_order(seed, "bin", "d")), ["bin"], ["_h", "d"]).select("bin", F.col("d").alias("neg_d"), F.col("_seq").alias("at")))
    sizes = places.groupBy("bin").agg(F.count(F.lit(1)).alias("nb"))
    asked = cut(positives.select("l", "d").distinct().join(binned, "d").select("l", "d", "bin"))
    return _draw_unknown(asked, places, sizes, "m", known, degree, seed)


def edge_negatives(positives: DataFrame, known: DataFrame, seed: int = 2026) -> DataFrame:
    """For each positive (l, d) the d of a known pair drawn by hash: l, d, neg_d. Any d is drawn in proportion to its degree,
    without forming pairs of nodes. A draw that is a known pair is drawn again; what is left after some rounds takes any unknown d."""
    one = F.lit(0).cast("bigint")
    rows = known.select(one.alias("bin"), F.col("d").alias("neg_d"), hash_order(seed, "edge", "l", "d").alias("_h"), F.col("l").alias("_l"))
    places = cut(number_within_key(rows, ["bin"], ["_h", "_l", "neg_d"]).select("bin", "neg_d", F.col("_seq").alias("at")))
    sizes = places.groupBy("bin").agg(F.count(F.lit(1)).alias("nb"))
    asked = cut(positives.select("l", "d", one.alias("bin")).distinct())
    return _draw_unknown(asked, places, sizes, "deg", known, known, seed).select("l", "d", "neg_d")
