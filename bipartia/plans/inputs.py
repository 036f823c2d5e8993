"""Queries of sources, sinks and streams: given tables are written in a format, read back and reported."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bipartia.operators import metrics
from bipartia.operators.learned import LEARNED
from bipartia.operators.scoring import score_all
from bipartia.plans import associations as A
from bipartia.sources import formats
from bipartia.sources.tables import cut, shared_dir, table
from bipartia.streaming import counters


def _place(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/format-{uuid.uuid4().hex}"


def obo_roundtrip(spark, sf_dir):
    at = _place(spark)
    formats.write_obo(table(spark, sf_dir, "doid_terms"), at)
    t = formats.read_obo(spark, at)
    return t.select("id", "name", "def", *[F.array_join(c, "|").alias(c) for c in ("synonym", "alt_id", "is_a")])


def tsv_roundtrip(spark, sf_dir):
    at = _place(spark)
    formats.write_tsv(table(spark, sf_dir, "diseases_textmined").select("tm_id", "ens", "symbol", "doid", "conf"), at)
    t = formats.read_tsv(spark, at)
    band = F.when(F.trim("conf").try_cast("double") >= 2, "high").otherwise("other")
    return t.groupBy(band.alias("band"), (F.trim("doid") == "").alias("no_doid")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tm_id").alias("n_ids"), F.countDistinct(F.trim("symbol")).alias("n_symbols"))


def gct_roundtrip(spark, sf_dir):
    """Mean z of each gene and year as a GCT table, read back with log(1 + value)."""
    at = _place(spark)
    z = table(spark, sf_dir, "diseases_textmined").filter("ens is not null and trim(ens) <> ''").withColumn("y", F.date_format("mined_at", "yyyy"))
    years = [r[0] for r in z.filter("y is not null").select("y").distinct().orderBy("y").collect()]  # as many as years go by
    wide = z.groupBy(F.concat(F.substring_index(F.trim("ens"), ".", 1), F.lit(".1")).alias("name")).agg(F.lit("x").alias("symbol"), *[F.coalesce(F.round(F.sum(F.when(F.col("y") == y, F.col("z"))), 3), F.lit(0.0)).alias(y) for y in years])
    lines = wide.select(F.concat_ws("\t", "name", "symbol", *years).alias("value"))
    head = spark.createDataFrame([("#1.2",), ("\t".join(["Name", "Description", *years]),)], "value string")
    head.unionByName(lines).write.option("compression", "gzip").text(at)
    back = formats.read_gct(spark, at).select("name", F.explode("tissues").alias("year", "v"))
    return back.filter("v > 0").groupBy("year").agg(F.count(F.lit(1)).alias("n_genes"), A.r(F.sum(F.log1p("v")), 3).alias("log_total"))


def json_map_roundtrip(spark, sf_dir):
    at = _place(spark)
    newest = table(spark, sf_dir, "lncrna_seq").filter("urs is not null and trim(urs) <> ''").groupBy("urs").agg(F.max_by(F.struct("status", "length"), F.struct("fetched_at", "status", "length", "name")).alias("v"))
    formats.write_json_map(newest, "urs", "v", at)
    back = formats.read_json_map(spark, at, "struct<status:string,length:int>")
    return back.groupBy(F.col("value.status").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.sum("value.length").alias("total_length"))


def result_documents(spark, sf_dir):
    """Fold results written as JSON documents with nested maps, read back by path and flattened."""
    at = _place(spark)
    e = A.evaluated(spark, sf_dir, "both")
    doc = e.groupBy("model").agg(F.struct(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda x: x["value"]).alias("folds")).alias("ap"))
    doc.select("model", F.create_map(F.lit("both"), F.create_map(F.lit("AUPR_1to1"), "ap")).alias("scenarios")).repartition("model").write.option("maxRecordsPerFile", 1).json(at)
    back = formats.read_results(spark, at, "model string, scenarios map<string,map<string,struct<mean:double,std:double,folds:array<double>>>>")
    ap = F.col("scenarios")["both"]["AUPR_1to1"]
    return back.select("model", A.r(ap["mean"]).alias("mean"), A.r(ap["std"]).alias("std"), F.size(ap["folds"]).cast("bigint").alias("n"))


def stream_event_counts(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    t = counters.run_once(counters.window_counts(events), spark)
    return t.select(F.date_format("begins", "yyyy-MM-dd").alias("day"), "event_type", "n", A.r("total", 2).alias("total"))


def eval_learned_both(spark, sf_dir):
    """Learned scorers on both-cold folds."""
    train, asked = cut(A.blocks(spark, sf_dir, "both")[0]), A.drawn(spark, sf_dir, "both")
    s = score_all(train, asked, A.contents(spark, sf_dir, "l"), A.contents(spark, sf_dir, "d"), LEARNED)
    return metrics.average_precision(s, ["model", "fold"])


QUERIES = {f.__name__: f for f in (obo_roundtrip, tsv_roundtrip, gct_roundtrip, json_map_roundtrip, result_documents, stream_event_counts, eval_learned_both)}

SQL = {
    "obo_roundtrip": "SELECT id, name, def, array_to_string(synonym, '|') AS synonym, array_to_string(alt_id, '|') AS alt_id, array_to_string(is_a, '|') AS is_a FROM doid_terms",
    "tsv_roundtrip": """SELECT CASE WHEN try_cast(trim(conf) AS DOUBLE) >= 2 THEN 'high' ELSE 'other' END AS band, regexp_replace(coalesce(doid, ''), '[ \\t\\r\\n]+', '', 'g') = '' AS no_doid,
count(*) AS n, count(DISTINCT tm_id) AS n_ids, count(DISTINCT trim(regexp_replace(coalesce(symbol, ''), '[\\t\\r\\n]', ' ', 'g'))) AS n_symbols FROM diseases_textmined GROUP BY 1, 2""",
    "gct_roundtrip": """WITH s AS (SELECT split_part(trim(ens), '.', 1) AS name, strftime(mined_at, '%Y') AS year, round(sum(z), 3) AS v FROM diseases_textmined WHERE trim(coalesce(ens, '')) <> '' GROUP BY 1, 2)
SELECT year, count(*) AS n_genes, round(sum(ln(1 + v)), 3) AS log_total FROM s WHERE v > 0 AND year IS NOT NULL GROUP BY 1""",
    "json_map_roundtrip": """WITH n AS (SELECT urs, arg_max({'s': status, 'l': length}, (fetched_at, status, length, name)) AS v FROM lncrna_seq WHERE trim(coalesce(urs, '')) <> '' GROUP BY 1)
SELECT v.s AS status, count(*) AS n, CAST(sum(v.l) AS BIGINT) AS total_length FROM n GROUP BY 1""",
    "result_documents": f"{A._VALUE_SQL} SELECT model, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM val GROUP BY model",
    "stream_event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
