"""Scorers fitted by distributed learners: forest, boosting and logistic regression over pair features, factorization."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartia.functions.vectors import dot, l2_added
from bipartia.operators.scoring import SCORERS, scorer
from bipartia.operators.similarity import classes
from bipartia.operators.skew import number_within_key
from bipartia.operators.split import negatives
from bipartia.sources.tables import BROADCAST_BYTES, collect_garbage, cut, release


# Columns of contents whose matrices (a fold's are three of this squared) go to the driver.
MAX_WIDTH = 2048


# Folds that are fitted at the same time, rows of a partition of a fold, bands of a matrix that is summed.
AT_ONCE, PART_ROWS, BANDS = 3, 150_000, 16


def concat(a, b):
    return np.hstack([a, b])


def product(a, b):
    return a * b


def interact(a, b):
    return np.hstack([a, b, a * b, np.abs(a - b)])


def _each_fold(asked: DataFrame, one) -> DataFrame:
    """``one(fold)`` for every fold of ``asked``, some at a time, as a fit is many small jobs: their written results together."""
    folds = [f for (f,) in asked.select("fold").distinct().orderBy("fold").collect()]
    def written(fold):
        out = cut(one(fold))
        collect_garbage(asked.sparkSession)
        return out

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(written, folds))


def _units(vecs: DataFrame, axis: str, name: str):
    """Nodes ``axis`` with ``name``, the place of their unit vector in a shared matrix, and the matrix; where distinct vectors
    are more than may be broadcast, with the vector itself, and no matrix."""
    member, reps = classes(vecs)
    units = reps.select("rep", l2_added(F.col("vec")).alias("_v"))
    n, width = reps.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if n * (width or 0) * 8 > BROADCAST_BYTES:
        return member.join(units, "rep").select(F.col("node").alias(axis), F.col("_v").alias(name)), None
    t, spark = units.toArrow(), vecs.sparkSession
    x = t["_v"].combine_chunks().flatten().to_numpy().reshape(n, width or 0)
    place = spark.createDataFrame(list(zip(t["rep"].to_pylist(), range(n))), f"rep string, {name} int")
    return cut(member.join(place, "rep").select(F.col("node").alias(axis), name)), spark.sparkContext.broadcast(x)


def _bands(m: np.ndarray, **other) -> pd.DataFrame:
    return pd.DataFrame({**other, "band": np.arange(BANDS, dtype=np.int32), "m": [x.tobytes() for x in np.array_split(m, BANDS)]})


def _add(p: pd.DataFrame) -> pd.DataFrame:
    return p[:1].assign(m=[sum(np.frombuffer(m) for m in p["m"]).tobytes()])


def _moments(rows: DataFrame, values) -> np.ndarray:
    """Sum of (x, 1)'(x, 1) over ``rows``, x being what ``values`` makes of a batch: one matrix per partition, as wide as x
    whatever the rows, summed in bands."""

    def run(batches):
        total = 0
        for b in batches:
            if b.num_rows:
                x = values(b)
                x = np.hstack([x, np.ones((len(x), 1))])
                total = total + x.T @ x
        if np.ndim(total):
            yield pa.RecordBatch.from_pandas(_bands(total))

    bands = rows.mapInArrow(run, "band int, m binary").groupBy("band").applyInPandas(_add, "band int, m binary").orderBy("band").collect()
    flat = np.concatenate([np.frombuffer(r["m"]) for r in bands])
    return flat.reshape(int(len(flat) ** 0.5), -1)


def _components(moments: np.ndarray, columns: int, k: int) -> np.ndarray:
    """The first k principal components of the first ``columns`` of x; of each, the entry that is largest is positive."""
    n, total = moments[-1, -1], moments[-1, :columns]
    cov = (moments[:columns, :columns] - np.outer(total, total) / n) / max(n - 1, 1)
    pc = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    return pc * np.where(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])] < 0, -1.0, 1.0)


def by_fit(join, k: int | None = None):
    """Register a scorer that fits an estimator on each fold, over ``join`` of both contents or its first ``k`` principal
    components: those of several scorers share training pairs, sums and features."""

    def add(f):
        def run(train, asked, vec_l, vec_d):
            return _fit_folds(train, asked.select("fold", "l", "d"), vec_l, vec_d, [f.__name__]).withColumnRenamed(f.__name__, "score")

        run.__name__, run.__doc__, run.features, run.estimator, run.together = f.__name__, f.__doc__, (join, k), f, _fit_folds
        return scorer(run)

    return add


def _fit_folds(train: DataFrame, asked: DataFrame, vec_l: DataFrame, vec_d: DataFrame, only: list[str]) -> DataFrame:
    """``asked`` with a column for each of ``only``: one model per fold on its training pairs and as many negatives.

    Rows are pairs of places in the matrices of distinct contents; features are made from them where they are needed, so that
    none are written. Concatenation is the first half of ``interact``: one matrix of sums gives the components of both.
    """
    (of_l, x_l), (of_d, x_d) = _units(vec_l, "l", "_a"), _units(vec_d, "d", "_b")
    placed = lambda df, *cols: df.join(of_l, "l").join(of_d, "d").select(*cols, "_a", "_b")
    not_known = negatives(train, train)
    labelled = train.select("fold", "l", "d", F.lit(1.0).alias("label")).unionByName(not_known.withColumn("label", F.lit(0.0)))
    rows, ask = cut(placed(labelled, "fold", "label")), cut(placed(asked, *asked.columns))
    if hasattr(not_known, "_cut_path"):
        release(not_known)
    collect_garbage(train.sparkSession)
    kinds = list(dict.fromkeys(SCORERS[name].features for name in only))
    reduced = [(join, k) for join, k in kinds if k]
    widest = interact if any(join is interact for join, _ in reduced) else concat

    def both(b: pa.RecordBatch):
        return (x.value[b.column(c).to_numpy()] if x else b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c, x in (("_a", x_l), ("_b", x_d)))

    def made(df: DataFrame, keep: list[str], shared: dict, which) -> DataFrame:
        def run(batches):
            for b in batches:
                if b.num_rows:
                    out = [b.column(c) for c in keep]
                    for i in which:
                        x = kinds[i][0](*both(b))
                        x = x @ shared[kinds[i]] if kinds[i] in shared else x
                        out.append(pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel()))
                    yield pa.RecordBatch.from_arrays(out, names=[*keep, *names])

        names = [f"_x{i}" for i in which]
        types = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], *[f"{x} array<double>" for x in names]])
        return df.mapInArrow(run, types).select(*keep, *[array_to_vector(x).alias(x) for x in names])

    def one(fold):
        own = F.col("fold").eqNullSafe(F.lit(fold))
        mine = rows.filter(own)
        mine = cut(mine.select("label", "_a", "_b").repartition(max(2, -(-mine.count() // PART_ROWS))))
        shared = {}
        if reduced:
            moments = _moments(mine, lambda b: widest(*both(b)))
            width = (len(moments) - 1) // (4 if widest is interact else 2)
            shared = {(join, k): _components(moments, width * (4 if join is interact else 2), k) for join, k in reduced}
        out = made(ask.filter(own), asked.columns, shared, range(len(kinds)))
        fits = [made(mine, ["label"], shared, [i]) for i in range(len(kinds))]
        for i, x in enumerate(fits):
            if sum(SCORERS[name].features == kinds[i] for name in only) > 1:
                x.persist()
        for name in only:
            i = kinds.index(SCORERS[name].features)
            estimator = SCORERS[name].estimator().setFeaturesCol(f"_x{i}").setProbabilityCol("_p").setRawPredictionCol("_r").setPredictionCol("_y")
            model = estimator.fit(fits[i])
            out = model.transform(out).withColumn(name, vector_to_array("_p")[1]).drop("_p", "_r", "_y")
        for x in fits:
            x.unpersist()
        return out.select(*asked.columns, *only)

    if ask.isEmpty():
        return ask.select(*asked.columns, *[F.lit(0.0).alias(name) for name in only])
    return _each_fold(ask, one)


@by_fit(concat, 16)
def pair_forest():
    """Random forest over principal components of both contents."""
    return RandomForestClassifier(numTrees=20, maxDepth=5, seed=7)


@by_fit(concat, 16)
def pair_boost():
    """Gradient-boosted trees over principal components of both contents."""
    return GBTClassifier(maxIter=5, maxDepth=4, seed=7)


@by_fit(product)
def product_logistic():
    """Logistic regression over the elementwise product of both contents: a diagonal bilinear form."""
    return LogisticRegression(regParam=0.01, maxIter=30)


@scorer
def factorization(train, asked, vec_l, vec_d, rank: int = 16):
    """Implicit-feedback matrix factorization; nodes without training pairs score 0."""

    def ids(c: str, name: str) -> DataFrame:
        """Dense numbers, as no hash of 32 bits keeps nodes apart."""
        nodes = train.select(c).union(asked.select(c)).distinct().withColumn("_all", F.lit(0))
        return cut(number_within_key(nodes, ["_all"], [c]).select(c, F.col("_seq").cast("int").alias(name)))

    i, j = ids("l", "i"), ids("d", "j")
    rows = cut(train.join(i, "l").join(j, "d").select("fold", "i", "j", F.lit(1.0).alias("r")))
    ask = cut(asked.select("fold", "l", "d").join(i, "l").join(j, "d"))

    def one(fold):
        own = F.col("fold").eqNullSafe(F.lit(fold))
        model = ALS(rank=rank, maxIter=8, regParam=0.05, implicitPrefs=True, alpha=10.0, userCol="i", itemCol="j", ratingCol="r", seed=7).fit(rows.filter(own))
        return model.transform(ask.filter(own)).select("fold", "l", "d", F.when(F.isnan("prediction"), 0.0).otherwise(F.coalesce(F.col("prediction").cast("double"), F.lit(0.0))).alias("score"))

    if ask.isEmpty():
        return ask.select("fold", "l", "d", F.lit(0.0).alias("score"))
    return _each_fold(ask, one)


@by_fit(interact, 24)
def pair_mlp():
    """Multilayer perceptron over principal components of both contents, their product and their distance."""
    return MultilayerPerceptronClassifier(layers=[24, 16, 2], maxIter=25, seed=7)


def _outer_sums(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sum of outer(a, b) by fold. Every partition gives one matrix per fold, as wide as the contents whatever the rows."""

    def run(batches):
        total = {}
        for b in batches:
            for fold, g in b.groupby("fold"):
                total[fold] = total.get(fold, 0) + np.stack(g["a"].to_numpy()).T @ np.stack(g["b"].to_numpy())
        for fold, m in total.items():
            yield _bands(m, fold=fold, width=m.shape[1])

    kinds = "fold bigint, width int, band int, m binary"
    out = {}
    for r in rows.select("fold", "a", "b").mapInPandas(run, kinds).groupBy("fold", "band").applyInPandas(_add, kinds).orderBy("fold", "band").collect():
        out.setdefault(r["fold"], [r["width"]]).append(np.frombuffer(r["m"]))
    return {k: np.concatenate(v[1:]).reshape(-1, v[0]) for k, v in out.items()}


@scorer
def inductive_ridge(train, asked, vec_l, vec_d, penalty: float = 1.0):
    """Bilinear form a' W b that fits the whole training block with ridge ``penalty``, all unobserved pairs being 0.

    Minimises |M - A W B'|^2 + penalty |W|^2 exactly: with eigenvectors U, V and values s, t of A'A and B'B,
    W = U ((U' A'M B V) / (s t + penalty)) V'. The three matrices are summed over partitions and are as wide as the contents,
    which are at most MAX_WIDTH.
    """
    for vecs in (vec_l, vec_d):
        width = vecs.agg(F.max(F.size("vec"))).first()[0] or 0
        if width > MAX_WIDTH:
            raise ValueError(f"contents of {width} columns, at most {MAX_WIDTH} can be solved for on the driver")
    unit = lambda df, c: df.select(F.col("node").alias(c), l2_added(F.col("vec")).alias("_v"))
    a, b = cut(unit(vec_l, "l")), cut(unit(vec_d, "d"))
    own = lambda c, v: train.select("fold", c).distinct().join(v, c).select("fold", F.col("_v").alias("a"), F.col("_v").alias("b"))
    cross = train.select("fold", "l", "d").join(a.withColumnRenamed("_v", "a"), "l").join(b.withColumnRenamed("_v", "b"), "d")
    left, right, mixed = _outer_sums(own("l", a)), _outer_sums(own("d", b)), _outer_sums(cross)
    forms = {}
    for fold, m in mixed.items():
        (s, u), (t, v) = np.linalg.eigh(left[fold]), np.linalg.eigh(right[fold])
        forms[fold] = u @ ((u.T @ m @ v) / (np.outer(s, t) + penalty)) @ v.T

    def turn(batches):
        for p in batches:
            p = p[p["fold"].isin(list(forms))]
            yield pd.DataFrame({"fold": p["fold"], "l": p["l"], "_p": [list(forms[f].T @ x) for f, x in zip(p["fold"], p["_v"])]})

    turned = asked.select("fold", "l").distinct().join(a, "l").select("fold", "l", "_v").mapInPandas(turn, "fold bigint, l string, _p array<double>")
    both = asked.select("fold", "l", "d").join(turned, ["fold", "l"], "left").join(b, "d", "left")
    return both.select("fold", "l", "d", F.round(F.coalesce(dot(F.col("_p"), F.col("_v")), F.lit(0.0)), 9).alias("score"))


LEARNED = ["pair_forest", "pair_boost", "product_logistic", "factorization", "pair_mlp", "inductive_ridge"]
