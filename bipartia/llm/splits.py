"""Splits that keep related records together: connected components, then totals as near as possible to the shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bipartia.operators.skew import join_lookup, number_within_key
from bipartia.sources.tables import cut, release

def _spread(rows: DataFrame, lookup: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` with one lookup row per ``key``, where a third of the rows may have one key (see join_lookup)."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return join_lookup(rows, lookup, key, counts, "_n", how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b, strings): node, root, with root the smallest node of the component.

    Each round hooks every vertex to the smallest of itself and its neighbours, shortcuts the parent table by joining
    it with itself until all parents are roots, and replaces the edges by edges between different roots. A round at
    least halves the vertices of each unfinished component. Parent tables are written each round, the ones they replace are
    removed; nothing but counts reaches the driver. Joins by root or by parent, of which a giant component has one for
    most of its rows, broadcast the rows of hot keys (see join_hot) and shuffle the others only. Edges that repeat, reversed
    or from a node to itself are allowed (the latter make a component of one node), edges with a null end are left
    out, an empty input gives no rows.
    """
    edges = edges.select(F.col("a").cast("string"), F.col("b").cast("string")).filter("a is not null and b is not null")
    given = cut(edges.distinct())
    labels = cut(given.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    edges = cut(given.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(given)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("g"))
            jumped = cut(_spread(parent, up, "p", "left").select("a", F.coalesce("g", "p").alias("p"), (F.coalesce("g", "p") != F.col("p")).alias("moved")))
            release(parent)
            parent = jumped
            if jumped.filter("moved").isEmpty():
                break
        old = labels, edges, parent
        to = parent.select(F.col("a").alias("root"), F.col("p").alias("_p"))
        labels = cut(_spread(labels, to, "root", "left").select("node", F.coalesce("_p", "root").alias("root")))
        pa, pb = parent.select("a", F.col("p").alias("pa")), parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        half = cut(_spread(edges, pa, "a", "inner"))
        moved = _spread(half, pb, "b", "inner").filter("pa <> pb")
        edges = cut(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        release(*old, half)
    return labels


def closest_subset(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many components of each size to take so that their total is as near to ``target`` as possible.

    ``sizes``: number of components by size. Exact at any size: a subset sum over a bitset of reachable totals, with the
    multiplicities split into powers of two. Totals farther from the target than the one that taking the largest first
    gives are left out of the bitset, and it is done as soon as the target itself is reachable. The items of the total are
    found by halving the list of items and meeting in the middle, so that at most four bitsets of about ``target`` bits (an
    eighth of a byte for each row of the split) are held at once. Of two totals equally near, the lower.
    """
    greedy, left = {}, target
    for s in sorted(sizes, reverse=True):
        if k := min(sizes[s], left // s):
            greedy[s], left = k, left - k * s
    if not left:
        return greedy
    limit = target + left
    items = []
    for s in sorted(sizes, reverse=True):
        n, k = min(sizes[s], limit // s), 1
        while n > 0:
            items.append((s, min(k, n)))
            n, k = n - k, 2 * k
    mask, reach, used = (1 << (limit + 1)) - 1, 1, 0
    for used, (s, k) in enumerate(items, 1):
        reach |= (reach << (s * k)) & mask
        if reach >> target & 1:
            break
    below = (reach & ((1 << (target + 1)) - 1)).bit_length() - 1
    above = reach >> (target + 1)
    total = target + (above & -above).bit_length() if above and (above & -above).bit_length() < target - below else below
    take: dict[int, int] = {}
    parts = [(0, used, total)]
    while parts:
        lo, hi, t = parts.pop()
        if not t:
            continue
        if hi - lo == 1:
            s, k = items[lo]
            take[s] = take.get(s, 0) + k
            continue
        # What the first half reaches, and what the second half leaves of t: any total in both will do.
        mid, up, down, within = (lo + hi) // 2, 1, 1 << t, (1 << (t + 1)) - 1
        for s, k in items[lo:mid]:
            up |= (up << (s * k)) & within
        for s, k in items[mid:hi]:
            down |= down >> (s * k)
        at = (up & down).bit_length() - 1
        parts += [(lo, mid, at), (mid, hi, t - at)]
    return take


def assign_splits(sizes: DataFrame, shares: dict[str, float], rest: str) -> DataFrame:
    """A split for each component: assignment, root, split.

    ``sizes``: assignment, root, n (rows). ``shares``: split -> share of the rows; ``rest`` gets what is left.
    Only the number of components by size goes to the driver. Components of one size are numbered (see
    number_within_key) and taken in that order.
    """
    spark = sizes.sparkSession
    many: dict[str, dict[int, int]] = {}
    for r in sizes.groupBy("assignment", "n").agg(F.count(F.lit(1)).alias("k")).collect():
        many.setdefault(r["assignment"], {})[r["n"]] = r["k"]
    quota = []
    for a, left in many.items():
        total = sum(s * k for s, k in left.items())
        begin = dict.fromkeys(left, 0)
        for split, share in shares.items():
            for s, k in closest_subset(left, round(total * share)).items():
                quota.append((a, s, split, begin[s], begin[s] + k))
                begin[s], left[s] = begin[s] + k, left[s] - k
    table = spark.createDataFrame(quota, "assignment string, n bigint, split string, lo bigint, hi bigint")
    numbered = number_within_key(sizes.select("assignment", "n", "root"), ["assignment", "n"], ["root"])
    # At most two ranges per size: bounded like the sizes.
    table = table.groupBy("assignment", "n").agg(F.collect_list(F.struct("split", "lo", "hi")).alias("q"))
    hit = F.filter("q", lambda x: (x["lo"] <= F.col("_seq")) & (F.col("_seq") < x["hi"]))
    return numbered.join(table, ["assignment", "n"], "left").select("assignment", "root", F.when(F.size(hit) > 0, hit[0]["split"]).otherwise(F.lit(rest)).alias("split"))


def group_members(rows: DataFrame, edges: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with the key they go by (row_id, assignment, k), the rows of each key (assignment, k, n), and each key's
    component (assignment, k, n, root). See grouped_splits; the last two are written tables."""
    sep = F.lit("\u0001")
    whole = F.concat(F.col("assignment"), sep, F.when(F.coalesce("key", F.lit("")) == "", F.concat(F.lit("\u0002"), F.col(row_id).cast("string"))).otherwise(F.col("key")))
    keyed = rows.select(row_id, "assignment", whole.alias("k"))
    counts = cut(keyed.groupBy("assignment", "k").agg(F.count(F.lit(1)).alias("n")))
    named = edges.select(F.concat("assignment", sep, "a").alias("a"), F.concat("assignment", sep, "b").alias("b"))
    member = counts.join(components(named).withColumnRenamed("node", "k"), "k", "left")
    return keyed, counts, cut(member.select("assignment", "k", "n", F.coalesce("root", "k").alias("root")))


def group_sizes(member: DataFrame) -> DataFrame:
    """Rows of each component: assignment, root, n."""
    return member.groupBy("assignment", "root").agg(F.sum("n").alias("n"))


def grouped_splits(rows: DataFrame, edges: DataFrame, row_id: str, shares: dict[str, float] | None = None, rest: str = "train") -> DataFrame:
    """One split for each row and assignment: row_id, assignment, split.

    ``rows``: row_id, assignment, key. ``edges``: assignment, a, b, links between keys of one entity (keys need not
    occur in rows). All rows whose keys are linked, however far, share a split. Rows with a null or empty key belong to
    nothing and are placed one by one. Each split's total is as near to its share as the components allow that the splits
    named before it have left.
    """
    keyed, counts, member = group_members(rows, edges, row_id)
    chosen = assign_splits(cut(group_sizes(member)), shares or {"test": 0.1, "validation": 0.1}, rest)
    lookup = cut(_spread(member, cut(chosen.select("root", "split")), "root", "inner").select("k", "split"))
    return join_lookup(keyed, lookup, "k", counts, "n", "inner").select(row_id, "assignment", "split")


def split_totals(splits: DataFrame) -> DataFrame:
    """Rows and share of each split, by assignment."""
    n = splits.groupBy("assignment", "split").agg(F.count(F.lit(1)).alias("n_rows"))
    return n.withColumn("share", F.round(F.col("n_rows") / F.sum("n_rows").over(W.partitionBy("assignment")), 6))
