"""Similarities and neighbours. Query nodes are held against all nodes; nothing is done for all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bipartia.functions.vectors import as_double, bucket
from bipartia.operators.skew import hot_keys, join_hot, join_salted
from bipartia.sources.tables import cut

# Rows of a block in the block product of queries and corpus.
QUERY_BLOCK, CORPUS_BLOCK = 512, 8192
# Nodes of a block of which every pair comes out, and columns of a block of profiles.
PAIR_BLOCK, MAX_COLUMNS = 1024, 2048


def content(nodes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Content vectors of ``node``: that of the node's bucket among the embeddings; a tenth of the buckets has none and
    gets the zero vector, which stands for missing content."""
    n = embeddings.count()
    vecs = embeddings.select(F.col("vec_id").alias("_v"), as_double(F.col("embedding")).alias("vec"))
    width = embeddings.select(F.size("embedding").alias("n")).groupBy().agg(F.max("n")).first()[0] or 0
    zero = F.array_repeat(F.lit(0.0), width)
    return nodes.select("node", bucket("node", n + n // 10).alias("_v")).join(vecs, "_v", "left").select("node", F.coalesce("vec", zero).alias("vec"))


# Vectors of a list of the index; lists up to which it is not worth one; vectors its centres are fitted on at most.
LIST_SIZE, FEW_LISTS, SAMPLE = 4096, 16, 100_000
# Queries on which recall is measured when the index is made, and the recall that decides how many lists are probed.
TRIALS, RECALL = 200, 0.95


def nearest(queries: DataFrame, corpus: DataFrame, k: int, group: list[str], digits: int = 9, positive: bool = False) -> DataFrame:
    """Like ``top_cosine``, for query sets that grow with the corpus: an index of lists around centres.

    Every vector of the corpus is in the list of its nearest centre, one for LIST_SIZE vectors; a query looks in the lists of
    its nearest centres. Centres are vectors drawn by hash from at most SAMPLE, refined by three rounds of means; they are
    broadcast, LIST_SIZE times fewer than vectors. How many lists are probed is measured: TRIALS queries are held
    against the whole corpus, and the least number is taken that finds RECALL of their neighbours; vectors that do not
    cluster take many. With up to FEW_LISTS lists the search is exact.
    """
    lists = -(-corpus.select("node").distinct().count() // LIST_SIZE)
    if lists <= FEW_LISTS:
        return top_cosine(queries, corpus, k, group, digits, positive)
    sample = corpus.select("node", "vec").groupBy("node").agg(F.first("vec").alias("vec")).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vec").toPandas()
    x = np.stack(sample["vec"].to_numpy()).astype(float)
    x /= np.sqrt((x * x).sum(1))[:, None] + 1e-8
    centres = x[:lists]
    for _ in range(3):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([np.bincount(own, x[:, j], len(centres)) for j in range(x.shape[1])], axis=1)
        centres = np.where(np.bincount(own, minlength=len(centres))[:, None] > 0, sums, centres)
        centres /= np.sqrt((centres * centres).sum(1))[:, None] + 1e-8
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    def place(probes: int):
        def run(batches):
            for p in batches:
                if len(p):
                    far = -(np.stack(p["vec"].to_numpy()).astype(float) @ shared.value.T)
                    best = np.argpartition(far, min(probes, far.shape[1]) - 1, axis=1)[:, :probes] if probes > 1 else far.argmin(axis=1)[:, None]
                    p["_list"] = [list(map(int, b)) for b in best]
                    yield p

        return run

    def placed(df: DataFrame, probes: int) -> DataFrame:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        return cut(df.mapInPandas(place(probes), f"{kinds}, _list array<int>").withColumn("_list", F.explode("_list")))

    columns = [*group, "node", "vec"]
    listed = placed(corpus.select(*columns), 1)
    tried = queries.select(*columns).orderBy(F.xxhash64("node"), *group).limit(TRIALS)
    truth = top_cosine(cut(tried), corpus.select(*columns), k, group, digits, positive)
    truth = truth.join(listed.select(*group, "node", "_list"), [*group, "node"]).select("q", "_list").toPandas()
    vecs = {r["node"]: np.array(r["vec"]) for r in tried.select("node", "vec").collect()}
    places = [int((x @ centres.T > (x @ centres[own])).sum()) for x, own in ((vecs[q], own) for q, own in zip(truth["q"], truth["_list"]))]
    probes = int(np.quantile(places, RECALL, method="higher")) + 1 if places else 1
    hits = top_cosine(placed(queries.select(*columns), probes), listed, k, [*group, "_list"], digits, positive)
    rank = F.row_number().over(W.partitionBy(*group, "q").orderBy(F.desc("sim"), "node"))
    return hits.drop("_list").withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)


def top_cosine(queries: DataFrame, corpus: DataFrame, k: int, group: list[str], digits: int = 9, positive: bool = False) -> DataFrame:
    """The k nearest of ``corpus`` (group, node, vec) for each of ``queries`` (group, node, vec): group, q, node, sim, rank.

    Cosine rounded to ``digits``, ties by node. Exact, in blocks: every block of queries meets every block of the corpus
    of its group in one task, which keeps k rows for each query; the k best of all blocks remain. ``positive`` keeps
    similarities above 0 only. Zero vectors have cosine 0 with all. A corpus may have ``names``, the nodes of a vector, instead
    of one node for each.
    """
    n_q, n_c = queries.groupBy(*group).count().agg(F.max("count")).first()[0] or 0, corpus.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    bq, bc = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_c // CORPUS_BLOCK))
    qs = queries.select(*group, "node", "vec", (F.abs(F.xxhash64("node")) % bq).alias("_q"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bc - 1).cast("bigint"))).alias("_c"))
    # Other names than the queries', so that both may come from one table.
    cs = corpus.select(
        *[F.col(g).alias(f"_of_{g}") for g in group], (F.col("names") if "names" in corpus.columns else F.array("node")).alias("names"), F.col("vec").alias("other"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bq - 1).cast("bigint"))).alias("_bq"), (F.abs(F.xxhash64("node")) % bc).alias("_bc"),
    )
    keys, other_keys = [*group, "_q", "_c"], [*[f"_of_{g}" for g in group], "_bq", "_bc"]

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(a["vec"].to_numpy()).astype(float), np.stack(b["other"].to_numpy()).astype(float)
        nx, ny = np.sqrt((x * x).sum(1)) + 1e-8, np.sqrt((y * y).sum(1)) + 1e-8
        sim = np.round((x @ y.T) / (nx[:, None] * ny[None, :]), digits) + 0.0
        # Every vector that is as near as the k-th has its nodes listed, and the first k of them by similarity and name stay.
        least = np.partition(sim, sim.shape[1] - min(k, sim.shape[1]), axis=1)[:, sim.shape[1] - min(k, sim.shape[1])]
        rows, cols = np.nonzero(sim >= least[:, None])
        sizes, names = b["names"].map(len).to_numpy(), np.concatenate(b["names"].to_list())
        each, ends = sizes[cols], np.cumsum(sizes)
        at = np.repeat(ends[cols] - np.cumsum(each), each) + np.arange(each.sum())
        rows, near_ = np.repeat(rows, each), np.repeat(sim[rows, cols], each)
        place = np.empty(len(names), int)
        place[np.argsort(names, kind="stable")] = np.arange(len(names))
        order = np.lexsort((place[at], -near_, rows))
        rows, at, near_ = rows[order], at[order], near_[order]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        rows, at, near_ = rows[best], at[best], near_[best]
        return pd.DataFrame({**{g: a[g].to_numpy()[rows] for g in group}, "q": a["node"].to_numpy()[rows], "node": names[at], "sim": near_})

    kinds = ", ".join(f"{g} {queries.schema[g].dataType.simpleString()}" for g in group)
    pairs = qs.groupBy(*keys).cogroup(cs.groupBy(*other_keys)).applyInPandas(lambda a, b: near(a, b) if len(a) and len(b) else pd.DataFrame(columns=[*group, "q", "node", "sim"]), (kinds + ", " if kinds else "") + "q string, node string, sim double")
    if positive:
        pairs = pairs.filter("sim > 0")
    rank = F.row_number().over(W.partitionBy(*group, "q").orderBy(F.desc("sim"), "node"))
    return pairs.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= k)


def classes(vecs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of one and the same vector: (node, rep) with the class's first node by name, and (rep, vec). Both are written,
    once for a table ``vecs`` (node, vec)."""
    if not hasattr(vecs, "_classes"):
        reps = cut(vecs.groupBy("vec").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")))
        hot = hot_keys(reps, "vec", "n", reps.agg(F.sum("n")).first()[0] or 0)
        vecs._classes = cut(join_hot(vecs.select("node", "vec"), reps.select("vec", "rep"), "vec", hot, "inner").select("node", "rep")), reps.select("rep", "vec")
    return vecs._classes


def nearest_of_classes(queries: DataFrame, corpus: DataFrame, of: tuple[DataFrame, DataFrame], k: int, group: list[str], digits: int = 9) -> DataFrame:
    """The k nearest of ``corpus`` (group, node) for each class that ``queries`` (group, node) have a node of: group, q (the
    class), node, sim, rank; the same as ``nearest`` gives for each node of the class.

    Vectors are compared once, however many nodes have them: of a class of the corpus, only its first k nodes by name can be
    among the k nearest, as ties go by name. ``of`` is what ``classes`` gives.
    """
    member, reps = of
    asked = queries.join(member, "node").select(*group, "rep").distinct().join(reps, "rep").select(*group, F.col("rep").alias("node"), "vec")
    first = F.row_number().over(W.partitionBy(*group, "rep").orderBy("node"))
    named = corpus.join(member, "node").select(*group, "rep", "node", first.alias("_n")).filter(F.col("_n") <= k)
    named = named.groupBy(*group, "rep").agg(F.array_sort(F.collect_list("node")).alias("names"))
    listed = cut(named.join(reps, "rep").select(*group, F.col("rep").alias("node"), "names", "vec"))
    if -(-(listed.groupBy(*group).count().agg(F.max("count")).first()[0] or 0) // LIST_SIZE) > FEW_LISTS:
        return nearest(cut(asked), cut(listed.select(*group, F.explode("names").alias("node"), "vec")), k, group, digits)
    return top_cosine(cut(asked), listed, k, group, digits)


def cooccurrence(pairs: DataFrame, is_query) -> DataFrame:
    """Shared d of query l (a) with every l that shares one (b): a, b, n."""
    a = pairs.filter(is_query).select(F.col("l").alias("a"), "d")
    return join_salted(a, pairs.select("d", F.col("l").alias("b")), "d").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def profile_pairs(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Every one of ``queries`` with every one of ``corpus`` (both node, train, ds, vec): a, b, train (of both), da, db,
    n (shared d, also 0), cos.

    ``ds`` are a node's distinct d. Cosine rounded to 9 digits; a node without content (null) counts as the zero vector.
    In blocks as in ``top_cosine``: a task counts the shared d of two blocks as matrix products over MAX_COLUMNS d at a
    time, so that no product of nodes is shuffled.
    """
    n_q, n_c, wide = queries.count(), corpus.count(), MAX_COLUMNS
    bq, bc = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_c // PAIR_BLOCK))
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    qs = queries.select("node", "train", "ds", "vec", (F.abs(F.xxhash64("node")) % bq).alias("_q"), copies(bc).alias("_c"))
    # Other names than the queries', so that both may come from one table.
    cs = corpus.select(F.col("node").alias("name"), F.col("train").alias("also"), F.col("ds").alias("others"), F.col("vec").alias("other"), copies(bq).alias("_bq"), (F.abs(F.xxhash64("node")) % bc).alias("_bc"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        da, db = a["ds"].map(len).to_numpy(), b["others"].map(len).to_numpy()
        d_of_a, d_of_b = np.concatenate(a["ds"].to_list()), np.concatenate(b["others"].to_list())
        columns = pd.Index(pd.unique(d_of_a))
        sides = [(np.repeat(np.arange(len(deg)), deg), columns.get_indexer(ds), len(deg)) for deg, ds in ((da, d_of_a), (db, d_of_b))]
        shared = np.zeros((len(a), len(b)))
        for start in range(0, len(columns), wide):
            x, y = (np.zeros((size, wide)) for _, _, size in sides)
            for m, (row, col, _) in zip((x, y), sides):
                here = (col >= start) & (col < start + wide)
                m[row[here], col[here] - start] = 1
            shared += x @ y.T
        size = max((len(v) for v in [*a["vec"], *b["other"]] if v is not None), default=1)
        x, y = (np.stack([np.zeros(size) if v is None else v for v in vs]).astype(float) for vs in (a["vec"], b["other"]))
        nx, ny = np.sqrt((x * x).sum(1)) + 1e-8, np.sqrt((y * y).sum(1)) + 1e-8
        cos = np.round((x @ y.T) / (nx[:, None] * ny[None, :]), 9) + 0.0
        i, j = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
        train = a["train"].to_numpy()[i] & b["also"].to_numpy()[j]
        return pd.DataFrame({"a": a["node"].to_numpy()[i], "b": b["name"].to_numpy()[j], "train": train, "da": da[i], "db": db[j], "n": shared.ravel().astype("int64"), "cos": cos.ravel()})

    kinds = "a string, b string, train boolean, da bigint, db bigint, n bigint, cos double"
    none = [k.split()[0] for k in kinds.split(", ")]
    return qs.groupBy("_q", "_c").cogroup(cs.groupBy("_bq", "_bc")).applyInPandas(lambda a, b: meet(a, b) if len(a) and len(b) else pd.DataFrame(columns=none), kinds)


def gip(pairs: DataFrame, is_query, contents: DataFrame | None = None, is_train=None) -> DataFrame:
    """Gaussian profile kernel of query l with every l, also where no d is shared: a, b, n (shared d), cos,
    w = exp(-g (deg_a + deg_b - 2 n)), g = nodes / sum of degrees.

    ``contents`` (node, vec) gives the cosine of each pair, else it is 0. With ``is_train``, a condition on l, g is that
    of the l for which it holds, and w is null unless it holds for a and b.
    """
    train = F.lit(True) if is_train is None else is_train
    gamma = pairs.filter(train).agg((F.countDistinct("l") / (F.count(F.lit(1)) + F.lit(1e-8))).alias("gamma"))
    nodes = pairs.groupBy("l").agg(F.collect_list("d").alias("ds")).select(F.col("l").alias("node"), "ds", is_query.alias("asked"), train.alias("train"))
    nodes = cut(nodes.withColumn("vec", F.lit(None).cast("array<double>")) if contents is None else nodes.join(contents.select("node", "vec"), "node", "left"))
    both = profile_pairs(nodes.filter("asked"), nodes).crossJoin(F.broadcast(gamma))
    far = F.greatest(F.col("da") + F.col("db") - 2 * F.col("n"), F.lit(0))
    return both.select("a", "b", "n", "cos", F.when(F.col("train"), F.exp(-F.col("gamma") * far)).alias("w"))


def normalized_graph(edges: DataFrame, self_loops: bool) -> DataFrame:
    """Edges (i, j, w) made symmetric by max, with self loops, as D^-1/2 A D^-1/2: i, j, w."""
    sym = edges.filter("i <> j").select("i", "j", "w")
    sym = sym.unionByName(sym.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.max("w").alias("w"))
    if self_loops:
        nodes = edges.select(F.explode(F.array("i", "j")).alias("i")).distinct()
        sym = sym.unionByName(nodes.select("i", F.col("i").alias("j"), F.lit(1.0).alias("w")))
    deg = sym.groupBy("i").agg(F.sum("w").alias("deg"))
    by = sym.join(deg, "i").join(deg.select(F.col("i").alias("j"), F.col("deg").alias("dj")), "j")
    return by.select("i", "j", (F.col("w") / F.sqrt(F.col("deg") * F.col("dj"))).alias("w"))


def walks(pairs: DataFrame, is_query, hops: int) -> DataFrame:
    """Numbers of walks l-d-l-d... from query l to nodes after each hop: q, hop, node, n."""
    step = pairs.filter(is_query).select(F.col("l").alias("q"), F.col("d").alias("node")).groupBy("q", "node").agg(F.count(F.lit(1)).cast("double").alias("n"))
    out = step.select("q", F.lit(1).cast("bigint").alias("hop"), "node", "n")
    for h in range(2, hops + 1):
        a, b = ("d", "l") if h % 2 == 0 else ("l", "d")
        step = join_salted(step, pairs.select(F.col(a).alias("node"), F.col(b).alias("to")), "node").groupBy("q", "to").agg(F.sum("n").alias("n")).withColumnRenamed("to", "node")
        out = out.unionByName(step.select("q", F.lit(h).cast("bigint").alias("hop"), "node", "n"))
    return out


def spectral_radius(pairs: DataFrame, rounds: int = 5) -> DataFrame:
    """Largest eigenvalue of the adjacency of the pairs' graph, by power iteration: rho, one row (null without pairs).

    Each round goes from d to l and back, both ways joins with sums; vectors are written each round.
    """
    x = cut(pairs.select("d").distinct().select("d", F.lit(1.0).alias("x")))
    for i in range(rounds):
        up = pairs.join(x, "d").groupBy("l").agg(F.sum("x").alias("y"))
        y = pairs.join(up, "l").groupBy("d").agg(F.sum("y").alias("x"))
        if i == rounds - 1:
            before, after = x.agg(F.sum(F.col("x") * F.col("x")).alias("b")), y.agg(F.sum(F.col("x") * F.col("x")).alias("a"))
            return after.crossJoin(before).select(F.pow(F.col("a") / F.col("b"), 0.25).alias("rho"))
        y = cut(y)
        top = y.agg(F.max("x")).first()[0] or 1.0
        x = y.select("d", (F.col("x") / F.lit(top)).alias("x"))


def propagate(graph: DataFrame, seeds: DataFrame, alpha: float, steps: int) -> DataFrame:
    """Labels spread over a graph (i, j, w): F = alpha A F + (1 - alpha) F0, ``steps`` times from F0 = ``seeds`` (q, node, w)."""
    now, start = seeds, seeds.select("q", "node", (F.col("w") * (1 - alpha)).alias("w"))
    for _ in range(steps):
        moved = now.join(graph.select("i", F.col("j").alias("node"), F.col("w").alias("_a")), "node").select("q", F.col("i").alias("node"), (F.col("w") * F.col("_a") * alpha).alias("w"))
        now = moved.unionByName(start).groupBy("q", "node").agg(F.sum("w").alias("w"))
    return now


def weighted_rows(neighbours: DataFrame, pairs: DataFrame, weight) -> DataFrame:
    """Neighbours' associations summed with weights that sum to 1 (or 0) for each query: q, d, score.

    ``neighbours``: q, node, sim, rank. ``weight`` is a Column over them.
    """
    w = neighbours.withColumn("w", weight)
    total = w.groupBy("q").agg(F.sum("w").alias("t"))
    w = w.join(total, "q").select("q", "node", (F.col("w") / (F.col("t") + F.lit(1e-8))).alias("w"))
    return w.join(pairs.select(F.col("l").alias("node"), "d"), "node").groupBy("q", "d").agg(F.sum("w").alias("score"))
