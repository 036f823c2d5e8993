"""Queries of the general problems: few keys with most records, references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipartia.functions.text import folded, is_blank
from bipartia.operators import orphans
from bipartia.operators.skew import long_form, per_key_profile
from bipartia.sources.tables import table


def p3_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "rnadisease").select("rec_id", "loaded_at", folded("rna_symbol").alias("s"), folded("do_id").alias("d"))
    long = long_form(rows, {"rna_symbol": F.col("s"), "do_id": F.col("d")}, {"rna_symbol": F.col("d"), "do_id": F.col("s")}, ["rec_id", "loaded_at"])
    out = per_key_profile(long, "key_field", "key_value", "partner", "loaded_at", "rec_id")
    return out.select("key_field", "key_value", "n_rows", "n_partners", "first_at", "last_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "rnadisease").count()
    return p3_profile(spark, sf_dir).filter(F.col("n_rows") * 50 >= F.lit(total)).select("key_field", "key_value")


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Children and parents of all three references."""
    main, mined = table(spark, sf_dir, "rnadisease"), table(spark, sf_dir, "diseases_textmined")
    terms, seqs = table(spark, sf_dir, "doid_terms"), table(spark, sf_dir, "lncrna_seq")
    children = (
        orphans.child_references(main, "rnadisease.do_id", "doid_terms", "do_id", "rec_id", "loaded_at")
        .unionByName(orphans.child_references(main, "rnadisease.urs", "lncrna_seq", "urs", "rec_id", "loaded_at"))
        .unionByName(orphans.child_references(mined, "diseases_textmined.doid", "doid_terms", "doid", "tm_id", "mined_at"))
    )
    ids = F.array_distinct(F.transform(F.concat(F.array("id"), F.coalesce("alt_id", F.array().cast("array<string>"))), folded))
    parents = orphans.parents_valid(terms, "doid_terms", ids, "created_at", "obsoleted_at").unionByName(
        orphans.parents_newest(seqs, "lncrna_seq", folded("urs"), "fetched_at", ~is_blank("seq"))
    )
    return children, parents


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_references(*_references(spark, sf_dir)).select("ref_field", F.col("row_id").cast("bigint").alias("row_id"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_counts(*_references(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_profile": p3_profile, "p5_found": p5_found, "p5_report": p5_report}

_FOLD = "upper(regexp_replace(coalesce({0}, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
_BLANK = "regexp_replace(coalesce({0}, ''), '[\\s\\p{{Z}}\\p{{C}}]+', '', 'g') = ''"

_P3 = f"""
WITH r AS (SELECT rec_id, loaded_at, {_FOLD.format('rna_symbol')} AS s, {_FOLD.format('do_id')} AS d FROM rnadisease),
l AS (SELECT 'rna_symbol' AS key_field, s AS key_value, nullif(d, '') AS partner, loaded_at FROM r WHERE s <> ''
      UNION ALL SELECT 'do_id', d, nullif(s, ''), loaded_at FROM r WHERE d <> ''),
p AS (SELECT key_field, key_value, count(*) AS n_rows, count(DISTINCT partner) AS n_partners, min(loaded_at) AS first_at, max(loaded_at) AS last_at
      FROM l GROUP BY 1, 2)
"""

_P5 = f"""
WITH c AS (
  SELECT 'rnadisease.do_id' AS ref_field, rec_id AS row_id, {_FOLD.format('do_id')} AS k, loaded_at AS t FROM rnadisease WHERE NOT ({_BLANK.format('do_id')})
  UNION ALL SELECT 'diseases_textmined.doid', tm_id, {_FOLD.format('doid')}, mined_at FROM diseases_textmined WHERE NOT ({_BLANK.format('doid')})),
t AS (SELECT {_FOLD.format('i')} AS k, created_at, obsoleted_at FROM (
  SELECT id AS i, created_at, obsoleted_at FROM doid_terms UNION ALL SELECT unnest(alt_id), created_at, obsoleted_at FROM doid_terms) x),
u AS (SELECT rec_id AS row_id, {_FOLD.format('urs')} AS k, loaded_at AS t FROM rnadisease WHERE NOT ({_BLANK.format('urs')})),
v AS (SELECT {_FOLD.format('urs')} AS k, fetched_at, max(CASE WHEN {_BLANK.format('seq')} THEN 0 ELSE 1 END) AS ok FROM lncrna_seq GROUP BY 1, 2),
vv AS (SELECT k, fetched_at, lead(fetched_at) OVER (PARTITION BY k ORDER BY fetched_at) AS until, ok FROM v),
o AS (
  SELECT ref_field, row_id, t, EXISTS (SELECT 1 FROM t AS a WHERE a.k = c.k) AS known FROM c
  WHERE NOT EXISTS (SELECT 1 FROM t AS a WHERE a.k = c.k AND a.created_at <= c.t AND (a.obsoleted_at IS NULL OR a.obsoleted_at > c.t))
  UNION ALL
  SELECT 'rnadisease.urs', row_id, t, EXISTS (SELECT 1 FROM vv WHERE vv.k = u.k AND ok = 1) FROM u
  WHERE NOT EXISTS (SELECT 1 FROM vv WHERE vv.k = u.k AND ok = 1 AND fetched_at <= u.t AND (until IS NULL OR until > u.t)))
"""

SQL = {
    "p3_found": _P3 + "SELECT key_field, key_value FROM p WHERE n_rows * 50 >= (SELECT count(*) FROM rnadisease)",
    "p3_profile": _P3 + "SELECT * FROM p",
    "p5_found": _P5 + "SELECT ref_field, row_id FROM o",
    "p5_report": _P5
    + """SELECT split_part(ref_field, '.', 1) AS tab, split_part(ref_field, '.', 2) AS field, strftime(t, '%Y-%m') AS month,
  CASE WHEN known THEN 'not_then' ELSE 'never' END AS missing, count(*) AS n_orphans, min(row_id) AS first_row_id FROM o GROUP BY 1, 2, 3, 4""",
}
