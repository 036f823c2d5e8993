"""Link scorers. A scorer sees training pairs only and scores the pairs asked for, so that nothing held out can leak."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bipartia.functions.vectors import dot, l2_added, uniform
from bipartia.operators.metrics import top_ranked
from bipartia.operators.similarity import classes, nearest, nearest_of_classes
from bipartia.operators.skew import join_salted
from bipartia.sources.tables import cut

# A scorer: (train pairs, asked pairs, contents of l, contents of d), each by fold, to fold, l, d, score.
Scorer = Callable[[DataFrame, DataFrame, DataFrame, DataFrame], DataFrame]
SCORERS: dict[str, Scorer] = {}


def scorer(f: Scorer) -> Scorer:
    """Register a scorer under its name: the plug-in point for further models."""
    SCORERS[f.__name__] = f
    return f


# What scorers know of the nodes and pairs of a fold: name -> (keys, maker); a maker gives fold, the other keys and the name. It
# gets the training pairs, the asked nodes of each axis (fold and l or d), contents of both and tables that features share.
FEATURES: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {}
K = 10


def feature(*keys: str):
    def add(f):
        FEATURES[f.__name__] = keys, f
        return f

    return add


def by_features(*needs: str, pairwise: bool = False):
    """Register a scorer that is a formula over features: those of several scorers are looked up in one pass over the pairs.
    ``pairwise`` if the formula looks at l and d themselves."""

    def add(f: Callable[[], Column]) -> Scorer:
        def run(train: DataFrame, asked: DataFrame, vec_l: DataFrame, vec_d: DataFrame) -> DataFrame:
            return _by_features(train, asked.select("fold", "l", "d"), vec_l, vec_d, [f.__name__]).withColumnRenamed(f.__name__, "score")

        run.__name__, run.__doc__, run.needs, run.formula, run.pairwise = f.__name__, f.__doc__, needs, f, pairwise
        return scorer(run)

    return add


def _by_features(train: DataFrame, asked: DataFrame, vec_l: DataFrame, vec_d: DataFrame, only: list[str]) -> DataFrame:
    """``asked`` with a column for each of ``only``, all of them made by ``by_features``."""
    needs = _needs(only)
    found: dict[str, DataFrame] = {}
    nodes = {axis: asked.select("fold", axis).distinct() for axis in ("l", "d")}
    out = asked
    for axis in ("l", "d"):
        if _of_axis(needs, axis):
            out = out.join(cut(_with_features(train, nodes, vec_l, vec_d, needs, axis, found)), ["fold", axis])
    for n in needs:
        keys, make = FEATURES[n]
        if len(keys) > 1:
            out = out.join(make(train, nodes, vec_l, vec_d, found), ["fold", *keys], "left")
    return out.select(*asked.columns, *[SCORERS[name].formula().alias(name) for name in only])


def _needs(only: list[str]) -> list[str]:
    return list(dict.fromkeys(n for name in only for n in SCORERS[name].needs))


def _of_axis(needs: list[str] | tuple[str, ...], axis: str) -> list[str]:
    return [n for n in needs if FEATURES[n][0] == (axis,)]


def _with_features(train: DataFrame, nodes: dict[str, DataFrame], vec_l: DataFrame, vec_d: DataFrame, needs: list[str], axis: str, found: dict) -> DataFrame:
    """The nodes of one axis with a column for each of its features."""
    out = nodes[axis]
    for n in _of_axis(needs, axis):
        out = out.join(FEATURES[n][1](train, nodes, vec_l, vec_d, found), ["fold", axis], "left")
    return out


def _degree(train: DataFrame, axis: str, name: str) -> DataFrame:
    return train.groupBy("fold", axis).agg(F.count(F.lit(1)).alias(name))


@feature("l")
def dl(train, nodes, vec_l, vec_d, found) -> DataFrame:
    """Training degree of l."""
    return _degree(train, "l", "dl")


@feature("d")
def dd(train, nodes, vec_l, vec_d, found) -> DataFrame:
    """Training degree of d."""
    return _degree(train, "d", "dd")


def _near(train: DataFrame, nodes: dict[str, DataFrame], vecs: DataFrame, axis: str, found: dict) -> DataFrame:
    """The K nearest training nodes of each class of asked nodes: fold, q (the class), node, sim."""
    if axis not in found:
        of = lambda df: df.select("fold", F.col(axis).alias("node")).distinct()
        found[axis] = cut(nearest_of_classes(of(nodes[axis]), of(train), classes(vecs), K, ["fold"]))
    return found[axis]


def _class(nodes: dict[str, DataFrame], vecs: DataFrame, axis: str, name: str) -> DataFrame:
    own = classes(vecs)[0].select(F.col("node").alias(axis), F.col("rep").alias(name))
    return nodes[axis].join(own, axis)


@feature("l")
def rl(train, nodes, vec_l, vec_d, found) -> DataFrame:
    """The class of l: all l of one vector."""
    return _class(nodes, vec_l, "l", "rl")


@feature("d")
def rd(train, nodes, vec_l, vec_d, found) -> DataFrame:
    """The class of d: all d of one vector."""
    return _class(nodes, vec_d, "d", "rd")


@feature("l")
def m(train, nodes, vec_l, vec_d, found) -> DataFrame:
    """Mean training degree of the K nearest training l."""
    top = _near(train, nodes, vec_l, "l", found).join(_degree(train, "l", "deg").withColumnRenamed("l", "node"), ["fold", "node"])
    mean = top.groupBy("fold", F.col("q").alias("rl")).agg(F.avg("deg").alias("m"))
    return _class(nodes, vec_l, "l", "rl").join(mean, ["fold", "rl"]).select("fold", "l", "m")


@feature("rl", "rd")
def s(train, nodes, vec_l, vec_d, found) -> DataFrame:
    """Sum of Lw(i, a) M(a, b) Dw(b, j) for classes i and j: nodes of one vector have the same neighbours, so that the sum is made
    once for them."""

    def weights(axis: str, vecs: DataFrame) -> DataFrame:
        top = _near(train, nodes, vecs, axis, found).withColumn("w", F.greatest("sim", F.lit(0.0)))
        total = top.groupBy("fold", "q").agg(F.sum("w").alias("t"))
        return top.join(total, ["fold", "q"]).filter("w > 0").select("fold", F.col("q").alias(f"r{axis}"), F.col("node").alias(f"n{axis}"), (F.col("w") / (F.col("t") + F.lit(1e-8))).alias(f"w{axis}"))

    # From the training pairs outwards, so that the work grows with them and not with the pairs asked for.
    wl, wd = weights("l", vec_l), weights("d", vec_d)
    pairs = train.select("fold", F.col("l").alias("nl"), F.col("d").alias("nd")).join(wl.select("fold", "nl").distinct(), ["fold", "nl"], "left_semi")
    to_d = pairs.join(wd, ["fold", "nd"]).groupBy("fold", "nl", "rd").agg(F.sum("wd").alias("wd"))
    return to_d.join(wl, ["fold", "nl"]).groupBy("fold", "rl", "rd").agg(F.sum(F.col("wl") * F.col("wd")).alias("s"))


@by_features(pairwise=True)
def random():
    """A hash of the pair."""
    return uniform(F.lit("random"), "l", "d")


@by_features("dl", "dd")
def popularity():
    """Training degree of l times that of d; 0 for nodes without training pairs."""
    return F.coalesce(F.col("dl") * F.col("dd"), F.lit(0)).cast("double")


@by_features("dl")
def popularity_one_sided():
    """Training degree of l alone."""
    return F.coalesce("dl", F.lit(0)).cast("double")


@by_features("rl", "rd", "s")
def knn_content():
    """S(i, j) = sum of Lw(i, a) M(a, b) Dw(b, j): training pairs between the k nearest training nodes of both sides by
    cosine of their contents (negative ones count 0), with weights that sum to 1."""
    return F.round(F.coalesce("s", F.lit(0.0)), 9)


@by_features("m", "dd")
def neighbour_popularity():
    """Mean training degree of the 10 nearest training l, times the degree of d plus 1."""
    return F.round(F.coalesce("m", F.lit(0.0)) * (F.coalesce("dd", F.lit(0)) + 1), 9)


@scorer
def knn_one_sided(train: DataFrame, asked: DataFrame, vec_l: DataFrame, vec_d: DataFrame, k: int = 10) -> DataFrame:
    """Training rows of the k diseases nearest to a cold one, weighted by cosine (at least 1e-8); popularity of l for a
    disease that is in training."""
    of = lambda df: df.select("fold", "d").distinct()
    cold, vec = of(asked).join(of(train), ["fold", "d"], "left_anti"), vec_d.withColumnRenamed("node", "d")
    placed = lambda df: df.join(vec, "d").select("fold", F.col("d").alias("node"), "vec")
    top = nearest(placed(cold), placed(of(train)), k, ["fold"]).withColumn("w", F.greatest("sim", F.lit(0.0)) + F.lit(1e-8))
    total = top.groupBy("fold", "q").agg(F.sum("w").alias("t"))
    w = top.join(total, ["fold", "q"]).select("fold", F.col("q").alias("d"), F.col("node").alias("b"), (F.col("w") / F.col("t")).alias("w"))
    score = w.join(train.select("fold", "l", F.col("d").alias("b")), ["fold", "b"]).groupBy("fold", "l", "d").agg(F.sum("w").alias("near"))
    degree = train.groupBy("fold", "l").agg(F.count(F.lit(1)).cast("double").alias("deg"))
    both = asked.select("fold", "l", "d").join(score, ["fold", "l", "d"], "left").join(degree, ["fold", "l"], "left")
    both = both.join(cold.withColumn("is_cold", F.lit(True)), ["fold", "d"], "left")
    chosen = F.when(F.col("is_cold"), F.coalesce("near", F.lit(0.0))).otherwise(F.coalesce("deg", F.lit(0.0)))
    return both.select("fold", "l", "d", F.round(chosen, 9).alias("score"))


@scorer
def content_popularity(train: DataFrame, asked: DataFrame, vec_l: DataFrame, vec_d: DataFrame) -> DataFrame:
    """(Sum over training l of their cosine to l times their degree) times the degree of d.

    The sum over all training l is one product: of the unit vector of l with the sum of theirs times their degrees, so that no
    pair of l is formed.
    """
    unit = vec_l.select(F.col("node").alias("l"), l2_added(F.col("vec")).alias("u"))
    degree = train.groupBy("fold", "l").agg(F.count(F.lit(1)).alias("deg"))
    each = degree.join(unit, "l").select("fold", "deg", F.posexplode("u").alias("i", "x")).groupBy("fold", "i").agg(F.sum(F.col("deg") * F.col("x")).alias("x"))
    pull = F.broadcast(each.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("pull")))  # one row for each fold
    dd = train.groupBy("fold", "d").agg(F.count(F.lit(1)).alias("dd"))
    both = asked.select("fold", "l", "d").join(unit, "l", "left").join(pull, "fold", "left").join(dd, ["fold", "d"], "left")
    return both.select("fold", "l", "d", (F.coalesce(dot(F.col("u"), F.col("pull")), F.lit(0.0)) * F.coalesce("dd", F.lit(0))).alias("score"))


def score_wide(train: DataFrame, asked: DataFrame, vec_l: DataFrame, vec_d: DataFrame, only: list[str]) -> DataFrame:
    """``asked`` (fold, l, d and other columns) with a column for each of ``only``."""
    plain = [n for n in only if hasattr(SCORERS[n], "needs")]
    out = _by_features(train, asked, vec_l, vec_d, plain) if plain else asked
    fitted = [n for n in only if hasattr(SCORERS[n], "together")]
    if fitted:
        out = SCORERS[fitted[0]].together(train, out, vec_l, vec_d, fitted)
    for name in only:
        if name not in plain and name not in fitted:
            out = out.join(SCORERS[name](train, asked.select("fold", "l", "d"), vec_l, vec_d).select("fold", "l", "d", F.col("score").alias(name)), ["fold", "l", "d"])
    return out


# Candidates of a fold whose pairs are made in one task, and the share of candidates that gives a bound of the k best.
MEET, BOUND_SHARE = 10_000, 16


def best_of_all(train: DataFrame, nodes: dict[str, DataFrame], side: str, vec_l: DataFrame, vec_d: DataFrame, only: list[str], k: int) -> DataFrame:
    """Of each node of ``side``, the k best of all nodes of the other axis in its fold by each of ``only``, ties by name: model,
    fold, l, d, score, rank.

    ``nodes``: of each axis (l, d) distinct fold and node; ``only`` are made by ``by_features``. No pair is scored that need
    not be: nodes that agree in the features of a formula are of one kind and have the same score. Kinds of both sides are
    scored against each other and ordered by score and first name. The k best nodes are in the first k kinds, each of which has a
    node before all of a later kind, and are among the first k nodes of these by name. A pairwise formula is computed for every
    pair.
    """
    other = "l" if side == "d" else "d"
    needs, found = _needs(only), {}
    known = {axis: cut(_with_features(train, nodes, vec_l, vec_d, needs, axis, found)) for axis in ("l", "d")}
    crossed = {n: cut(FEATURES[n][1](train, nodes, vec_l, vec_d, found)) for n in needs if len(FEATURES[n][0]) > 1}
    out = None
    for name in only:
        if SCORERS[name].pairwise:
            top = _best_pairs(name, known[side], known[other], side, other, crossed, k)
        else:
            top = _best_kinds(name, known[side], known[other], side, other, crossed, k)
        top = top.select(F.lit(name).alias("model"), "fold", "l", "d", "score", "rank")
        out = top if out is None else out.unionByName(top)
    return out


def _scored(pairs: DataFrame, name: str, crossed: dict[str, DataFrame]) -> DataFrame:
    for n in SCORERS[name].needs:
        if n in crossed:
            pairs = pairs.join(crossed[n], ["fold", *FEATURES[n][0]], "left")
    return pairs.withColumn("score", SCORERS[name].formula())


def _best_kinds(name: str, queries: DataFrame, others: DataFrame, side: str, other: str, crossed: dict[str, DataFrame], k: int) -> DataFrame:
    # A kind is a struct, so that features that are null agree.
    mine, theirs = (_of_axis(SCORERS[name].needs, axis) for axis in (side, other))
    kind = lambda cols: F.struct(F.lit(0).alias("_"), *cols)
    queries, others = queries.select("fold", side, *mine, kind(mine).alias("_of")), others.select("fold", other, *theirs, kind(theirs).alias("_kind"))
    kinds = others.groupBy("fold", "_kind", *theirs).agg(F.min(other).alias(other))
    met = join_salted(queries.select("fold", "_of", *mine).distinct(), cut(kinds), "fold", MEET)
    first = top_ranked(_scored(met, name, crossed), ["fold", "_of"], k, other).select("fold", "_of", "_kind", "score")
    place = F.row_number().over(W.partitionBy("fold", "_kind").orderBy(other))
    members = others.select("fold", "_kind", other, place.alias("_n")).filter(F.col("_n") <= k).drop("_n")
    best = cut(top_ranked(first.join(members, ["fold", "_kind"]).drop("_kind"), ["fold", "_of"], k, other))
    return queries.select("fold", side, "_of").join(best, ["fold", "_of"])


def _best_pairs(name: str, queries: DataFrame, others: DataFrame, side: str, other: str, crossed: dict[str, DataFrame], k: int) -> DataFrame:
    """The k-th best of a part of the candidates bounds the k best of all from below: every candidate is held against the bound,
    and only those that reach it are sorted. Where the part has fewer than k, all are."""
    part = others.filter(F.pmod(F.xxhash64(other), F.lit(BOUND_SHARE)) == 0)
    bound = top_ranked(_scored(join_salted(queries, part, "fold", MEET), name, crossed), ["fold", side], k, other)
    bound = cut(bound.filter(F.col("rank") == k).select("fold", side, F.col("score").alias("_least")))
    met = _scored(join_salted(queries.join(bound, ["fold", side], "left"), others, "fold", MEET), name, crossed)
    return top_ranked(met.filter("_least is null or score >= _least"), ["fold", side], k, other)


def long_scores(wide: DataFrame, only: list[str]) -> DataFrame:
    """A row for each model, from columns of their names; a filter on model reads the columns of that one only."""
    rest = [c for c in wide.columns if c not in only]
    out = None
    for name in only:
        one = wide.select(F.lit(name).alias("model"), *rest, F.col(name).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def score_all(train: DataFrame, asked: DataFrame, vec_l: DataFrame, vec_d: DataFrame, only: list[str]) -> DataFrame:
    """Scores of several models for ``asked`` (fold, l, d, label): model, fold, l, d, label, score."""
    return long_scores(cut(score_wide(train, asked, vec_l, vec_d, only)), only)
