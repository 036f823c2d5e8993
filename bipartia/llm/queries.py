"""Queries of the problems tagged llm, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bipartia.functions.text import folded, is_blank, word_bag
from bipartia.llm import canonical, formatdups, leaks, moderation, splits, tokens
from bipartia.operators.skew import join_lookup
from bipartia.sources.tables import cut, table


def _gene_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.reference_names(table(spark, sf_dir, "hgnc_complete_set"), "hgnc_id", "symbol", ["alias_symbol", "prev_symbol"])


def symbol_mapping(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (rec_id, rna_symbol, value), the mapping of their values, and the values' counts."""
    rows = table(spark, sf_dir, "rnadisease").select("rec_id", "rna_symbol", folded("rna_symbol").alias("value"))
    counts = cut(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")))
    return rows, canonical.map_to_canonical(counts, cut(_gene_names(spark, sf_dir))), counts


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mapping, counts = symbol_mapping(spark, sf_dir)
    approved = table(spark, sf_dir, "hgnc_complete_set").groupBy(folded("symbol").alias("value")).agg(F.collect_set("symbol").alias("spelt"))
    lookup = cut(mapping.join(approved, "value", "left").select("value", "symbol", "spelt"))
    out = join_lookup(rows.filter(~is_blank("rna_symbol")), lookup, "value", counts, "n")
    out = out.filter(~F.coalesce(F.array_contains("spelt", F.col("rna_symbol")), F.lit(False)))
    return out.select("rec_id", F.coalesce("symbol", F.lit("")).alias("symbol"))


def p1_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, mapping, counts = symbol_mapping(spark, sf_dir)
    # Values such as '-' are not blank but fold to nothing: they belong to no entry, and come as one empty value.
    nothing = rows.filter((F.col("value") == "") & ~is_blank("rna_symbol")).groupBy("value").agg(F.count(F.lit(1)).alias("n_rows"))
    return mapping.filter("how = 'none'").join(counts, "value").select("value", F.col("n").alias("n_rows")).unionByName(nothing)


def _related(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keys of the rows for both assignments, and what links them."""
    rows, mapping, _ = symbol_mapping(spark, sf_dir)
    terms = table(spark, sf_dir, "doid_terms")
    diseases = table(spark, sf_dir, "rnadisease").select("rec_id", F.lit("disease").alias("assignment"), folded("do_id").alias("key"))
    keyed = rows.select("rec_id", F.lit("lncrna").alias("assignment"), F.col("value").alias("key")).unionByName(diseases)
    # A value that may mean one of several entries keeps them all together: whichever is meant, it is not split.
    meant = mapping.select("value", F.explode(F.coalesce("rivals", F.array("entry"))).alias("entry")).filter("entry is not null")
    spelt = meant.select(F.lit("lncrna").alias("assignment"), F.col("value").alias("a"), F.concat(F.lit("\u0001"), "entry").alias("b"))
    # Values of no entry belong together if only words of kind or species differ.
    core = canonical.without_kind_words(F.col("value"))
    bare = mapping.filter("entry is null and rivals is null").select(F.lit("lncrna").alias("assignment"), F.col("value").alias("a"), core.alias("b")).filter("b <> '' and a <> b")
    same = terms.select(F.lit("disease").alias("assignment"), folded("id").alias("a"), F.explode("alt_id").alias("b"))
    edges = spelt.unionByName(bare).unionByName(same.withColumn("b", folded("b")).filter("a <> '' and b <> ''"))
    return keyed, edges


def p2_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped_splits(*_related(spark, sf_dir), "rec_id")


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of components by their rows, for each assignment."""
    sizes = splits.group_sizes(splits.group_members(*_related(spark, sf_dir), "rec_id")[2])
    return sizes.groupBy("assignment", F.col("n").alias("n_rows")).agg(F.count(F.lit(1)).alias("n_components"))


def p2_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_totals(p2_splits(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, web, raw = (table(spark, sf_dir, t) for t in ("rnadisease", "website_alldata", "raw_submissions"))
    fold = lambda *names: [folded(n) for n in names]
    web_canon = formatdups.canonical_record(*fold("ncrna_category", "species", "ncrna_symbol", "pubmed_id"), word_bag("disease_name"))
    return (
        main.select(F.lit("rnadisease").alias("tab"), F.col("rec_id").alias("id"), formatdups.canonical_record(*fold("specise", "rna_symbol", "do_id", "pubmed_id")).alias("canon"))
        .unionByName(web.select(F.lit("website_alldata").alias("tab"), F.col("row_id").alias("id"), web_canon.alias("canon")))
        .unionByName(raw.select(F.lit("raw_submissions").alias("tab"), F.col("sub_id").alias("id"), formatdups.canonical_pairs(F.col("payload")).alias("canon")))
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdups.repeats(_records(spark, sf_dir))


def p4_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatdups.collapse(_records(spark, sf_dir))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("chars", F.length("text"))
    ids = tokens.encode_texts(docs, "doc_id", "text", keep=("source", "chars"))
    return ids.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("ids")).alias("n_tokens"), F.sum("chars").alias("n_chars"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 12 words of an item in a row, with the first such passage in capitals and single spaces."""
    words = F.array_join(F.filter(F.split(F.upper("passage"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), " ")
    return _leaks(spark, sf_dir).filter("kind = 'run'").select("doc_id", "item_id", words.alias("passage"))


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(_leaks(spark, sf_dir))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).filter("score >= 0.5").select("doc_id", "category")


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return moderation.rates(docs, moderation.score_documents(docs, table(spark, sf_dir, "moderation_labels"), keep=("source",)))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_unmatched, p2_splits, p2_sizes, p2_totals, p4_found, p4_copies, p6_ids, p6_sizes, p7_found, p7_passages, p7_runs, p7_items, p8_found, p8_scores, p8_rates)
}

FOLD = "upper(regexp_replace(coalesce({0}, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"
BLANK = "regexp_replace(coalesce({0}, ''), '[\\s\\p{{Z}}\\p{{C}}]+', '', 'g') = ''"
_KIND = "(?:" + "|".join(canonical.KIND_WORDS) + ")+"

_P1 = f"""
WITH h AS (SELECT symbol, CAST(regexp_extract(hgnc_id, '([0-9]+)$', 1) AS BIGINT) AS e, alias_symbol, prev_symbol FROM hgnc_complete_set),
names AS (
  SELECT DISTINCT n, e, symbol, a FROM (
    SELECT {FOLD.format('symbol')} AS n, e, symbol, 0 AS a FROM h
    UNION ALL SELECT {FOLD.format('x')}, e, symbol, 1 FROM (SELECT unnest(string_split(alias_symbol, '|')) AS x, e, symbol FROM h)
    UNION ALL SELECT {FOLD.format('x')}, e, symbol, 1 FROM (SELECT unnest(string_split(prev_symbol, '|')) AS x, e, symbol FROM h)) WHERE n <> ''),
own AS (SELECT n, arg_min(e, a * 100000000 + e) AS e, arg_min(symbol, a * 100000000 + e) AS symbol FROM names GROUP BY n),
r AS (SELECT rec_id, rna_symbol, {FOLD.format('rna_symbol')} AS v FROM rnadisease WHERE NOT ({BLANK.format('rna_symbol')})),
v AS (SELECT v, regexp_replace(regexp_replace(replace(v, 'ALIAS', ''), '^{_KIND}', ''), '{_KIND}$', '') AS core FROM (SELECT DISTINCT v FROM r WHERE v <> '')),
t01 AS (SELECT v, symbol FROM v JOIN own ON n = v),
t1 AS (SELECT v, symbol FROM v JOIN own ON n = core WHERE v NOT IN (SELECT v FROM t01)),
rest AS (SELECT v, core FROM v WHERE v NOT IN (SELECT v FROM t01) AND v NOT IN (SELECT v FROM t1)),
cuts AS (SELECT v, t[1:i] AS l, t[i + 1:] AS rr FROM (SELECT v, t, unnest(range(1, len(t))) AS i FROM (SELECT v, v AS t FROM rest UNION SELECT v, core FROM rest))),
t2 AS (SELECT v, arg_min(a.symbol, a.e) AS symbol FROM cuts JOIN names AS a ON a.n = l JOIN names AS b ON b.n = rr AND b.e = a.e GROUP BY v),
ed AS (SELECT v, regexp_replace(v, '[^0-9]', '', 'g') AS dg, len(v) AS k FROM rest WHERE v NOT IN (SELECT v FROM t2)),
od AS (SELECT n, e, symbol, regexp_replace(n, '[^0-9]', '', 'g') AS dg, len(n) AS k FROM own),
t3 AS (SELECT v, min(symbol) AS symbol FROM ed JOIN od ON ed.dg = od.dg AND abs(ed.k - od.k) <= 1 AND damerau_levenshtein(v, n) = 1
       GROUP BY v HAVING count(DISTINCT e) = 1),
m AS (SELECT * FROM t01 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)
"""

# Components by reachability over the links; totals nearest to a tenth by the subset sums of all sizes. A validation total
# as near as if nothing had been taken before is the best there is.
_P2 = f"""
{_P1.replace('WITH h AS', 'WITH RECURSIVE h AS', 1)},
ref AS (SELECT v, symbol FROM m UNION SELECT v, symbol FROM ed JOIN od ON ed.dg = od.dg AND abs(ed.k - od.k) <= 1 AND damerau_levenshtein(v, n) = 1),
link AS (SELECT 'lncrna' AS assignment, v AS a, '=' || symbol AS b FROM ref
  UNION ALL SELECT 'lncrna', v, core FROM v WHERE core <> '' AND core <> v AND v NOT IN (SELECT v FROM ref)
  UNION ALL SELECT 'disease', {FOLD.format('id')}, {FOLD.format('x')} FROM (SELECT id, unnest(alt_id) AS x FROM doid_terms) WHERE {FOLD.format('id')} <> '' AND {FOLD.format('x')} <> ''),
both_ways AS MATERIALIZED (SELECT assignment, a, b FROM link UNION SELECT assignment, b, a FROM link),
reach AS (SELECT assignment, a AS node, a AS seen FROM both_ways UNION SELECT r.assignment, r.node, e.b FROM reach AS r JOIN both_ways AS e ON e.assignment = r.assignment AND e.a = r.seen),
root AS (SELECT assignment, node, min(seen) AS root FROM reach GROUP BY 1, 2),
placed AS (SELECT 'lncrna' AS assignment, rec_id, {FOLD.format('rna_symbol')} AS node FROM rnadisease UNION ALL SELECT 'disease', rec_id, {FOLD.format('do_id')} FROM rnadisease),
comp AS (SELECT assignment, CASE WHEN node = '' THEN '#' || rec_id ELSE coalesce(root, node) END AS g, count(*) AS n FROM placed LEFT JOIN root USING (assignment, node) GROUP BY 1, 2),
sizes AS MATERIALIZED (SELECT assignment, n AS n_rows, count(*) AS n_components FROM comp GROUP BY 1, 2)
"""

_P2_TOTALS = """,
want AS (SELECT assignment, sum(n_rows * n_components)::BIGINT AS total, round(sum(n_rows * n_components) / 10)::BIGINT AS target FROM sizes GROUP BY 1),
item AS MATERIALIZED (SELECT assignment, w, row_number() OVER (PARTITION BY assignment ORDER BY w DESC) AS i FROM (
  SELECT assignment, n_rows * least(1 << j, n_components - ((1 << j) - 1)) AS w FROM sizes, (SELECT unnest(range(0, 30))::INTEGER AS j) WHERE (1 << j) - 1 < n_components)),
sums AS (SELECT assignment, 0::BIGINT AS i, 0::BIGINT AS t FROM want UNION ALL
  SELECT DISTINCT s.assignment, s.i + 1, s.t + x.add FROM sums AS s JOIN (SELECT assignment, i, 0::BIGINT AS add FROM item UNION ALL SELECT assignment, i, w::BIGINT FROM item) AS x
  ON x.assignment = s.assignment AND x.i = s.i + 1 JOIN want AS q ON q.assignment = s.assignment WHERE s.t + x.add <= 2 * q.target),
best AS (SELECT assignment, total, arg_min(t, abs(t - target) + t / 1e12) AS t FROM sums JOIN want USING (assignment) GROUP BY 1, 2),
totals AS (SELECT assignment, total, 'test' AS split, t AS n_rows FROM best UNION ALL SELECT assignment, total, 'validation', t FROM best UNION ALL SELECT assignment, total, 'train', total - 2 * t FROM best)
SELECT assignment, split, n_rows, round(n_rows / total, 6) AS share FROM totals WHERE n_rows > 0"""

_P4 = f"""
WITH a AS (SELECT 'rnadisease' AS tab, rec_id AS id, [{', '.join(FOLD.format(c) for c in ('specise', 'rna_symbol', 'do_id', 'pubmed_id'))}] AS f FROM rnadisease
  UNION ALL SELECT 'website_alldata', row_id, [{', '.join(FOLD.format(c) for c in ('ncrna_category', 'species', 'ncrna_symbol', 'pubmed_id'))},
    array_to_string(list_sort(list_filter(regexp_split_to_array(upper(coalesce(disease_name, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')), ' ')] FROM website_alldata),
p AS (SELECT sub_id, trim(payload, chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM raw_submissions),
j AS (SELECT sub_id, k, json_extract_string(t, '$."' || k || '"') AS v FROM (SELECT sub_id, t, unnest(json_keys(t)) AS k FROM p WHERE t LIKE '{{%' AND json_valid(t))
  UNION ALL SELECT sub_id, regexp_extract(x, '^([^:=]*)[:=]', 1), regexp_replace(x, '^[^:=]*[:=]', '') FROM (
    SELECT sub_id, unnest(regexp_split_to_array(t, '[|;\r\n]+')) AS x FROM p WHERE t NOT LIKE '{{%') WHERE regexp_matches(x, '[:=]')),
b AS (SELECT DISTINCT sub_id, {FOLD.format('k')} || '=' || {FOLD.format('v')} AS kv FROM j WHERE {FOLD.format('k')} <> '' AND {FOLD.format('v')} <> ''),
r AS (SELECT tab, id, array_to_string(f, '|') AS canon FROM a WHERE len(list_filter(f, lambda x: x = '')) = 0
  UNION ALL SELECT 'raw_submissions', sub_id, string_agg(kv, '|' ORDER BY kv) FROM b GROUP BY sub_id
    HAVING bool_or(regexp_extract(kv, '^([^=]*)=', 1) IN ('RNASYMBOL', 'DOID', 'DISEASENAME', 'PUBMEDID', 'SPECIES'))),
g AS (SELECT tab, canon, min(id) AS keep_id, count(*) AS copies FROM r GROUP BY 1, 2),
alls AS (SELECT 'rnadisease' AS tab, rec_id AS id FROM rnadisease UNION ALL SELECT 'website_alldata', row_id FROM website_alldata UNION ALL SELECT 'raw_submissions', sub_id FROM raw_submissions)
"""

# Windows of 12 words of documents and items that are the same, the first one of each document and item.
_WINDOWS = """SELECT {id}, i, array_to_string(w[i:i + 11], ' ') AS passage FROM (SELECT {id}, w, unnest(range(1, len(w) - 10)) AS i FROM (
  SELECT {id}, list_filter(regexp_split_to_array(upper(coalesce({text}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {tab}))"""
_P7_RUNS = f"""WITH a AS ({_WINDOWS.format(id='doc_id', text='text', tab='documents')}), b AS (SELECT DISTINCT item_id, passage FROM ({_WINDOWS.format(id='item_id', text='item_text', tab='eval_items')}))
SELECT doc_id, item_id, arg_min(passage, i) AS passage FROM a JOIN b USING (passage) GROUP BY 1, 2"""

SQL = {
    "p7_runs": _P7_RUNS,
    "p2_sizes": _P2 + "SELECT assignment, n_rows, n_components FROM sizes",
    "p2_totals": _P2 + _P2_TOTALS,
    "p4_found": _P4 + "SELECT r.tab, keep_id, id AS dup_id FROM r JOIN g ON g.tab = r.tab AND g.canon = r.canon WHERE id <> keep_id",
    "p4_copies": _P4
    + """SELECT tab, keep_id, copies FROM g
  UNION ALL SELECT tab, id, 1 FROM alls WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.tab = alls.tab AND r.id = alls.id)""",
    "p1_found": _P1 + "SELECT rec_id, coalesce(m.symbol, '') AS symbol FROM r LEFT JOIN m ON m.v = r.v WHERE rna_symbol NOT IN (SELECT symbol FROM hgnc_complete_set)",
    "p1_unmatched": _P1 + f"SELECT v AS value, count(*) AS n_rows FROM (SELECT {FOLD.format('rna_symbol')} AS v FROM rnadisease WHERE NOT ({BLANK.format('rna_symbol')})) WHERE v NOT IN (SELECT v FROM m) GROUP BY v",
}
