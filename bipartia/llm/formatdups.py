"""Duplicates hidden by formatting: canonical records, Bloom filters of repeated hashes, exact groups."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from bipartia.functions.text import folded
from bipartia.operators.skew import hot_keys, join_hot
from bipartia.sources.tables import cut, release

BITS_PER_ROW = 16
HASHES = 3
SEGMENT_BITS = 1 << 20
# Filters of more than this many bytes are made one after another, each for one range of the hash.
ROUND_BYTES = 64 << 20


def canonical_record(*fields: Column) -> Column:
    """The folded fields joined, or null where one of them folds to nothing."""
    return F.when(F.array_min(F.transform(F.array(*fields), lambda f: F.length(f))) > 0, F.array_join(F.array(*fields), "\u0001"))


# The fields that a submitted form may have. Fixed values.
FORM_FIELDS = ["RNA Symbol", "DO ID", "Disease Name", "PubMed ID", "Species"]


def canonical_pairs(payload: Column, fields: list[str] = FORM_FIELDS) -> Column:
    """The sorted set of folded field=value pairs of a form, or null where there are none.

    A form is a JSON object, or pairs with : or = between field and value, and | or ; or line ends between pairs.
    Pairs whose field or value folds to nothing are left out; what is left without a pair of one of the ``fields``, such as
    an error message with a colon, is no form and has no record.
    """
    text = F.trim(F.coalesce(payload, F.lit("")))
    from_json = F.map_entries(F.from_json(text, "map<string,string>"))
    pair = r"(?:^|[|;\r\n])\s*([\p{L}][\p{L}\p{N}_ \p{Z}\p{Pd}]*?)\s*[:=]([^|;\r\n]*)"
    names, values = F.regexp_extract_all(text, F.lit(pair), F.lit(1)), F.regexp_extract_all(text, F.lit(pair), F.lit(2))
    plain = F.transform(F.arrays_zip(names.alias("key"), values.alias("value")), lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value")))
    pairs = F.when(text.startswith("{"), F.coalesce(from_json, F.array().cast("array<struct<key:string,value:string>>"))).otherwise(plain)
    both = F.filter(F.transform(pairs, lambda p: F.struct(folded(p["key"]).alias("k"), folded(p["value"]).alias("v"))), lambda p: (p["k"] != "") & (p["v"] != ""))
    text_of = F.array_sort(F.array_distinct(F.transform(both, lambda p: F.concat(p["k"], F.lit("="), p["v"]))))
    is_form = F.exists(both, lambda p: p["k"].isin([re.sub(r"[\W_]+", "", f).upper() for f in fields]))
    return F.when(is_form, F.array_join(text_of, "\u0001"))


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and bits (rows: hashes, columns: HASHES) of 64-bit hashes."""
    u = h.astype(np.uint64)
    step = (u >> np.uint64(40)) | np.uint64(1)
    bits = ((u & np.uint64(0xFFFFFFFF))[:, None] + step[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :]) % np.uint64(SEGMENT_BITS)
    return ((u >> np.uint64(20)) % np.uint64(segments)).astype(np.int64), bits.astype(np.int64)


def _pack(bits: np.ndarray) -> bytes:
    at = np.zeros(SEGMENT_BITS, bool)
    at[bits.ravel()] = True
    return zlib.compress(np.packbits(at).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8)


def _build(segments: int):
    def build(batches):
        h = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        h = np.concatenate(h) if h else np.empty(0, np.int64)
        once, n = np.unique(h, return_counts=True)
        out = []
        seg, bits = _places(once, segments)
        order = np.argsort(seg, kind="stable")
        seg, bits, again = seg[order], bits[order], (n > 1)[order]
        edges = np.searchsorted(seg, np.arange(segments + 1))
        for s in range(segments):
            lo, hi = edges[s], edges[s + 1]
            if lo < hi:
                rep = again[lo:hi]
                out.append((s, _pack(bits[lo:hi]), _pack(bits[lo:hi][rep]) if rep.any() else None))
        for i in range(0, len(out), 64):
            part = out[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.binary()), pa.array([x[2] for x in part], pa.binary())], names=["segment", "once", "again"])

    return build


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once = np.zeros(SEGMENT_BITS // 8, np.uint8)
    again = np.zeros(SEGMENT_BITS // 8, np.uint8)
    for a, b in zip(pdf["once"], pdf["again"]):
        one = _unpack(a)
        again |= once & one
        once |= one
        if b is not None:
            again |= _unpack(b)
    return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "again": [zlib.compress(again.tobytes(), 1)]})


def possible_repeats(records: DataFrame, n_rows: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``records`` (first column h, a 64-bit hash, not null) with ``maybe``: whether the hash may occur more than once.

    Each input partition makes a Bloom filter of the hashes it saw and one of those it saw repeatedly, in segments.
    Segments are merged: a hash may repeat if a partition saw it repeatedly, or if all its bits are set in the filters of
    two partitions; so no repeat is lost. The merged filter of repeats, at most ROUND_BYTES, is broadcast. Where that is
    too small for all rows, ranges of the hash take turns, each with a filter of its own: its result is written and its
    filter is dropped before the next one is made, so that driver and executors never hold more than one. A turn reads
    only the row groups of its range if the rows of each file are sorted by h. ``keep`` (a filter or selection) is applied
    before a result is written; with it, the result is a written table.
    """
    total = max(1, -(-n_rows * BITS_PER_ROW // SEGMENT_BITS))
    rounds = max(1, -(-total * SEGMENT_BITS // 8 // ROUND_BYTES))
    segments = -(-total // rounds)
    edges = [-(2**63) + r * 2**64 // rounds for r in range(rounds)]
    sc, out = records.sparkSession.sparkContext, None
    schema = StructType([*records.schema.fields, StructField("maybe", BooleanType())])
    for r in range(rounds):
        mine = records
        if r:
            mine = mine.filter(F.col("h") >= F.lit(edges[r]))
        if r + 1 < rounds:
            mine = mine.filter(F.col("h") < F.lit(edges[r + 1]))
        parts = mine.select("h").mapInArrow(_build(segments), "segment int, once binary, again binary")
        merged = parts.groupBy("segment").applyInPandas(_merge, "segment int, again binary").collect()
        shared = sc.broadcast({row["segment"]: bytes(row["again"]) for row in merged})
        part = mine.mapInArrow(_test(segments, shared), schema)
        if keep is not None:
            part = keep(part)
        if keep is not None or rounds > 1:
            part = cut(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _test(segments: int, shared):
    def test(batches):
        bits = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
        for s, data in shared.value.items():
            bits[s] = _unpack(data)
        for b in batches:
            seg, at = _places(b.column(0).to_numpy(zero_copy_only=False), segments)
            hit = (bits[seg[:, None], at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit, pa.bool_())], names=[*b.schema.names, "maybe"])

    return test


def _hashed(records: DataFrame) -> DataFrame:
    """h, tab, id, key of every row, written once and sorted by h in each file; h and key are null where canon is."""
    key = F.when(F.col("canon").isNotNull(), F.concat_ws("\u0002", "tab", "canon"))
    rows = records.select("tab", F.col("id").cast("bigint").alias("id"), key.alias("key"))
    return cut(rows.select(F.when(F.col("key").isNotNull(), F.xxhash64("key")).alias("h"), "tab", "id", "key").sortWithinPartitions("h"))


def repeats(records: DataFrame) -> DataFrame:
    """The repeated rows of ``records`` (tab, id, canon): tab, keep_id (the smallest id of the record), dup_id.

    Rows whose hash certainly repeats nowhere are dropped before the shuffle. Possible repeats are grouped by the
    canonical text itself, so a shared hash or a false hit of the filter does no harm. A hot record is counted before
    the shuffle and joined apart (see join_hot). Rows with a null canon repeat nothing; empty tables give no rows; ids
    are unique within a tab.
    """
    hashed = _hashed(records)
    maybe = possible_repeats(hashed.filter("h is not null"), hashed.count(), lambda t: t.filter("maybe").select("tab", "id", "key"))
    release(hashed)
    groups = cut(maybe.groupBy("tab", "key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    members = join_hot(maybe.select("id", "key"), groups, "key", hot_keys(groups, "key", "copies", total), "inner")
    return members.filter("id <> keep_id").select("tab", "keep_id", F.col("id").alias("dup_id"))


def collapse(records: DataFrame) -> DataFrame:
    """Every record once: tab, keep_id (the smallest id), copies. Rows with a null canon are records of their own.

    Rows that the filter of repeats does not hold are emitted as records of one copy, without a shuffle.
    """
    hashed = _hashed(records)
    tested = possible_repeats(hashed.filter("h is not null"), hashed.count(), lambda t: t.select("tab", "id", F.when(F.col("maybe"), F.col("key")).alias("key")))
    single = F.lit(1).cast("bigint").alias("copies")
    groups = tested.filter("key is not null").groupBy("tab", "key").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    alone = tested.filter("key is null").unionByName(hashed.filter("h is null").select("tab", "id", "key"))
    return groups.select("tab", "keep_id", "copies").unionByName(alone.select("tab", F.col("id").alias("keep_id"), single))
