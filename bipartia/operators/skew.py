"""Work on keys of very different frequency: numbering, per-key results and joins that no hot key slows down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bipartia.sources.tables import cut

# A key with at least 1 row in HOT of all is hot: by pigeonhole there are at most HOT such keys.
HOT = 2000


def number_within_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``_seq``, the row's 0-based place within its key in the order of ``order``.

    Rows are range-partitioned by key and order (the order splits hot keys over partitions) and written.
    Rows are counted per key and partition file; prefix sums of the counts give each file's offset within the
    key, and a row's number is that offset plus its place in the file. No task sees more than one range partition,
    however hot a key is; the window runs over counts, at most one row per key and file.
    Null keys are keys like others. Ties in ``order`` are numbered in any order. An empty input gives no rows. The written
    rows are ``_sorted`` of the result, for a caller that can release them.
    """
    rows, offsets, sorted_ = _offsets(df, keys, order)
    shifts = offsets.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_in"), (F.col("_off") - F.col("_start")).alias("_shift"))
    same = F.col("_part") == F.col("_in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = rows.join(shifts, same).select(*df.columns, (F.col("_pos") + F.col("_shift")).alias("_seq"))
    out._sorted = sorted_
    return out


def _offsets(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    sorted_ = cut(df, *keys, *order)
    rows = sorted_.select("*", F.col("_metadata.file_name").alias("_part"), F.col("_metadata.row_index").alias("_pos"))
    per_file = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_start"))
    w = W.partitionBy(*keys)
    before = w.orderBy(F.length("_part"), "_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_file.select(
        *keys, "_part", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.count(F.lit(1)).over(w).alias("_parts")
    )
    return rows, offsets, sorted_


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``_to_<value>``: for each of ``values``, its sum over the rows of the key up to and including this one.

    As in number_within_key, rows are range-partitioned by key and order and written; sums by key and file, prefix-summed,
    are what precedes a file, so that windows over rows never go beyond one file and a hot key is as good as any other.
    Keys are not null; ties in ``order`` come in any order.
    """
    rows = cut(df, *keys, *order).select("*", F.col("_metadata.file_name").alias("_part"), F.col("_metadata.row_index").alias("_pos"))
    per_file = rows.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_s_{v}") for v in values])
    before = W.partitionBy(*keys).orderBy(F.length("_part"), "_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_file.select(*keys, "_part", *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values])
    within = W.partitionBy(*keys, "_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(v).over(within).alias(f"_w_{v}") for v in values])
    return local.join(offsets, [*keys, "_part"]).select(*df.columns, *[(F.col(f"_w_{v}") + F.col(f"_o_{v}")).alias(f"_to_{v}") for v in values])


def per_key_profile(df: DataFrame, field: str, key: str, partner: str, at: str, tie: str, chunk_rows: int = 100_000) -> DataFrame:
    """Rows, distinct partners, first and last ``at`` for every (``field``, ``key``), by exact offset chunking.

    Rows are sorted by key, partner and ``tie`` over range partitions. Keys that span files get the offset of each
    file by prefix sums over the counts; every row then has an exact number within its key, and number //
    ``chunk_rows`` is its chunk. Keys inside one file are one chunk. Each chunk is reduced to a state (rows, distinct
    partners, its first and last partner, first and last time); the states of a key, in order, are merged, and a
    partner that ends one chunk and begins the next is counted once.

    Only keys that span files need offsets: at most one key crosses each file border, so their table has at most two
    rows per file and is broadcast. Columns out: field, key, n_rows, n_partners, first_at, last_at.
    Null or empty partners count as rows, not as partners; null times are ignored; rows with a null or empty key
    are left out; an empty input gives no rows.
    """
    named = df.select(F.col(field).alias("_field"), F.col(key).alias("_key"), F.nullif(F.col(partner), F.lit("")).alias("_partner"), F.col(tie).alias("_tie"), F.col(at).alias("_at"))
    named = named.filter((F.col("_key").isNotNull()) & (F.col("_key") != ""))
    rows, offsets, _ = _offsets(named, ["_field", "_key"], ["_partner", "_tie"])
    spans = offsets.filter("_parts > 1").select("_field", "_key", "_part", (F.col("_off") - F.col("_start")).alias("_shift"))
    chunk = F.floor((F.col("_pos") + F.col("_shift")) / F.lit(chunk_rows)).cast("bigint")
    chunked = rows.join(F.broadcast(spans), ["_field", "_key", "_part"], "left").withColumn("_chunk", F.coalesce(chunk, F.lit(0).cast("bigint")))
    pairs = chunked.groupBy("_field", "_key", "_chunk", "_partner").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("lo"), F.max("_at").alias("hi"))
    states = pairs.groupBy("_field", "_key", "_chunk").agg(
        F.sum("n").alias("n"), F.count("_partner").alias("p"), F.min("_partner").alias("p_first"), F.max("_partner").alias("p_last"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    # Of a key's chunks in order, an earlier chunk ends with the partner with which this one begins.
    last_before = F.max("p_last").over(W.partitionBy("_field", "_key").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    merged = states.withColumn("_shared", (F.col("p_first") == last_before).cast("bigint"))
    return merged.groupBy(F.col("_field").alias(field), F.col("_key").alias(key)).agg(
        F.sum("n").alias("n_rows"),
        (F.sum("p") - F.coalesce(F.sum("_shared"), F.lit(0))).alias("n_partners"),
        F.min("lo").alias("first_at"),
        F.max("hi").alias("last_at"),
    )


def hot_keys(counts: DataFrame, key: str, n: str, total: int, share: int = HOT) -> DataFrame:
    """The keys with at least total / share rows, at most ``share`` of them."""
    return counts.filter(F.col(n) * F.lit(share) >= F.lit(total)).select(key)


def join_hot(rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """Equi-join of ``rows`` with a ``lookup`` that has one row per key, safe where a few keys hold most rows.

    ``hot`` has at most HOT keys (see hot_keys), so the hot part of the lookup is small by proof and is broadcast;
    its rows stay where they are. Only the other rows, no key of which is frequent, are shuffled. ``how`` is left or
    inner. Rows with a null key match nothing.
    """
    mark = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    tagged = rows.join(mark, key, "left")
    small = F.broadcast(lookup.join(F.broadcast(hot), key, "left_semi"))
    a = tagged.filter("_hot").drop("_hot").join(small, key, how)
    b = tagged.filter("_hot is null").drop("_hot").join(lookup, key, how)
    return a.unionByName(b)


def join_lookup(rows: DataFrame, lookup: DataFrame, key: str, counts: DataFrame, n: str, how: str = "left", max_rows: int = 200_000) -> DataFrame:
    """Join ``rows`` with one lookup row per key: broadcast while the lookup has at most ``max_rows`` rows, else join_hot.

    ``lookup`` and ``counts`` (key, rows of it as ``n``) should be written tables (see cut): they are counted first.
    """
    if lookup.count() <= max_rows:
        return rows.join(F.broadcast(lookup), key, how)
    total = counts.agg(F.sum(n)).first()[0] or 0
    return join_hot(rows, lookup, key, hot_keys(counts, key, n, total), how)


def join_salted(rows: DataFrame, other: DataFrame, key: str, part: int = 50_000) -> DataFrame:
    """Inner equi-join on ``key`` where ``other`` may hold many rows of one key: those are met in parts of about ``part``
    rows, to each of which the key's ``rows`` go. Keys with more than one part are at most rows of other / part, so that
    their list is broadcast. Null keys match nothing.
    """
    load = other.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(part)).cast("int").alias("_parts")).filter("_parts > 1")
    load = cut(load)
    if load.isEmpty():
        return rows.join(other, key)
    load = F.broadcast(load)
    parts = F.coalesce("_parts", F.lit(1))
    right = other.join(load, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*[c for c in other.columns if c != key]), parts)).drop("_parts")
    left = rows.join(load, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (parts - 1).cast("bigint")))).drop("_parts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def long_form(df: DataFrame, fields: dict[str, Column], other: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per field of each row: key_field, key_value, partner and the kept columns."""
    items = [F.struct(F.lit(name).alias("key_field"), c.alias("key_value"), other[name].alias("partner")) for name, c in fields.items()]
    return df.select(*keep, F.explode(F.array(*items)).alias("_f")).select(*keep, "_f.*")
