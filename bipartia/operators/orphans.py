"""References to records that do not exist, or did not at the time of loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bipartia.functions.text import folded, is_blank
from bipartia.operators.skew import hot_keys, join_hot
from bipartia.sources.tables import cut


def child_references(df: DataFrame, ref_field: str, parent_table: str, key: str, row_id: str, at: str) -> DataFrame:
    """The references of one field in long form: ref_field, parent_table, key, row_id, at. Blank ones are left out."""
    return df.filter(~is_blank(key)).select(
        F.lit(ref_field).alias("ref_field"), F.lit(parent_table).alias("parent_table"), folded(key).alias("key"), F.col(row_id).alias("row_id"), F.col(at).alias("at")
    )


def parents_valid(df: DataFrame, parent_table: str, keys: Column, begins: str, ends: str) -> DataFrame:
    """Parents that are valid from ``begins`` until before ``ends`` (null: for ever), one row per key of the array ``keys``."""
    return df.select(F.lit(parent_table).alias("parent_table"), F.explode(keys).alias("key"), F.col(begins).alias("begins"), F.col(ends).alias("ends")).filter("key <> ''")


def parents_newest(df: DataFrame, parent_table: str, key: Column, at: str, usable: Column) -> DataFrame:
    """Parents with versions: of a key's rows, the newest one at a time decides by ``usable`` whether the key exists.

    Of versions with the same time, a usable one wins.
    """
    versions = df.select(key.alias("key"), F.col(at).alias("begins"), usable.alias("usable")).filter("key <> '' and begins is not null")
    versions = versions.groupBy("key", "begins").agg(F.max("usable").alias("usable"))
    until = F.lead("begins").over(W.partitionBy("key").orderBy("begins"))
    return versions.withColumn("ends", until).filter("usable").select(F.lit(parent_table).alias("parent_table"), "key", "begins", "ends")


def orphan_references(children: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of ``children`` whose key no parent holds at the child's time, with ``missing``: never or not_then.

    Parent and child keys are unioned in long form with a tag and grouped by parent table and key; children are
    counted before the shuffle, so a hot key is one row of each task. Groups without the parent flag are orphans at
    any time. For the others the group carries the parents' periods (as many as the parent table has for the key),
    against which each child's time is held. A period covers begins <= time < ends.
    A null time is covered by no period. Extra columns are ignored. Without parents every child is an orphan.
    """
    by_key = children.groupBy("parent_table", "key").agg(F.count(F.lit(1)).alias("n"))
    no_period = F.lit(None).cast("struct<begins:timestamp_ntz,ends:timestamp_ntz>")
    tagged = by_key.select("parent_table", "key", "n", F.lit(False).alias("is_parent"), no_period.alias("period")).unionByName(
        parents.select(
            "parent_table", "key", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("is_parent"),
            F.struct(F.col("begins").cast("timestamp_ntz").alias("begins"), F.col("ends").cast("timestamp_ntz").alias("ends")).alias("period"),
        )
    )
    groups = tagged.groupBy("parent_table", "key").agg(F.sum("n").alias("n"), F.max("is_parent").alias("has_parent"), F.collect_list("period").alias("periods"))
    groups = cut(groups.filter("n > 0").withColumn("pk", F.concat_ws("\u0001", "parent_table", "key")))
    total = groups.agg(F.sum("n")).first()[0] or 0
    rows = children.withColumn("pk", F.concat_ws("\u0001", "parent_table", "key"))
    joined = join_hot(rows, groups.select("pk", "has_parent", "periods"), "pk", hot_keys(groups, "pk", "n", total), "inner")
    time = F.col("at").cast("timestamp_ntz")
    covered = F.exists("periods", lambda p: (p["begins"] <= time) & (p["ends"].isNull() | (p["ends"] > time)))
    return joined.filter(~F.coalesce(covered, F.lit(False))).select(
        "ref_field", "parent_table", "key", "row_id", "at", F.when(F.col("has_parent"), "not_then").otherwise("never").alias("missing")
    )


def orphan_counts(children: DataFrame, parents: DataFrame) -> DataFrame:
    """What ``orphan_report`` gives for the orphans of ``children``, from sums of the groups: no child is joined whose month
    is wholly within or wholly outside the parent's periods.

    Children are counted by field, key and month before they meet the parents in one group for each key. A group without
    the parent flag gives its counts as they are, a group with it those of the months that no period touches; only the
    months in which a period begins or ends are looked at row by row.
    """
    month = F.date_format("at", "yyyy-MM")
    time = F.col("at").cast("timestamp_ntz")
    cells = children.groupBy("parent_table", "key", "ref_field", month.alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"), F.min(time).alias("lo"), F.max(time).alias("hi")
    )
    period = F.struct(F.col("begins").cast("timestamp_ntz").alias("begins"), F.col("ends").cast("timestamp_ntz").alias("ends")).alias("period")
    cell = F.struct("ref_field", "month", "n", "first", "lo", "hi").alias("cell")
    tagged = cells.select("parent_table", "key", F.lit(False).alias("is_parent"), cell, F.lit(None).cast("struct<begins:timestamp_ntz,ends:timestamp_ntz>").alias("period"))
    tagged = tagged.unionByName(parents.select("parent_table", "key", F.lit(True).alias("is_parent"), period), allowMissingColumns=True)
    groups = tagged.groupBy("parent_table", "key").agg(F.max("is_parent").alias("has_parent"), F.collect_list("cell").alias("cells"), F.collect_list("period").alias("periods"))
    each = groups.select("parent_table", "key", "has_parent", "periods", F.explode("cells").alias("c")).select("parent_table", "key", "has_parent", "periods", "c.*")
    within = F.exists("periods", lambda p: (p["begins"] <= F.col("lo")) & (p["ends"].isNull() | (p["ends"] > F.col("hi"))))
    touched = F.exists("periods", lambda p: (p["begins"] <= F.col("hi")) & (p["ends"].isNull() | (p["ends"] > F.col("lo"))))
    state = F.when(~F.coalesce(touched, F.lit(False)), "out").when(within, "in").otherwise("mixed")
    each = cut(each.select("parent_table", "key", "ref_field", "month", "n", "first", "has_parent", state.alias("state")))
    whole = each.filter("state = 'out'").select("ref_field", "month", F.when(F.col("has_parent"), "not_then").otherwise("never").alias("missing"), "n", "first")
    # A month is mixed only where a parent's period begins or ends in it.
    mixed = each.filter("state = 'mixed'").select("parent_table", "key", "ref_field", "month")
    rows = children.withColumn("month", month).join(mixed, ["parent_table", "key", "ref_field", "month"], "left_semi").drop("month")
    single = orphan_references(rows, parents.join(mixed.select("parent_table", "key").distinct(), ["parent_table", "key"], "left_semi"))
    both = whole.unionByName(single.select("ref_field", month.alias("month"), "missing", F.lit(1).cast("bigint").alias("n"), F.col("row_id").alias("first")))
    names = F.split("ref_field", r"\.")
    return both.groupBy(names[0].alias("tab"), names[1].alias("field"), "month", "missing").agg(F.sum("n").alias("n_orphans"), F.min("first").alias("first_row_id"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted for each table, field and month of loading; a null time is its own period."""
    month = F.date_format("at", "yyyy-MM")
    names = F.split("ref_field", r"\.")
    return orphans.groupBy(names[0].alias("tab"), names[1].alias("field"), month.alias("month"), "missing").agg(
        F.count(F.lit(1)).alias("n_orphans"), F.min("row_id").alias("first_row_id")
    )
