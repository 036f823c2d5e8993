"""Queries of the association analytics, over the whole tables of the domain, with the same results in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bipartia.functions import vectors as V
from bipartia.functions.text import folded, is_blank, squeezed, word_bag
from bipartia.operators import metrics, prep, similarity, skew, split
from bipartia.operators.scoring import best_of_all, long_scores, score_all, score_wide
from bipartia.sources.tables import collect_garbage, cut, state_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CORE = (2, 5)
MODELS = ["random", "popularity", "popularity_one_sided", "knn_content", "neighbour_popularity"]
# Tables that several queries start from, written once for a session and the state of a folder.
_kept: dict[tuple, DataFrame] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def kept(name: str, spark: SparkSession, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    # A table that is written anew is another table.
    key = (name, spark.sparkContext.applicationId, sf_dir, state_of(spark, sf_dir))
    if key not in _kept:
        _kept[key] = cut(make())
    return _kept[key]


def forget() -> None:
    """Drop kept tables, so that the next query starts from the given tables (for measuring)."""
    _kept.clear()


def pairs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept("pairs", spark, sf_dir, lambda: prep.association_pairs(table(spark, sf_dir, "rnadisease"), table(spark, sf_dir, "doid_terms")))


def core_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept("core", spark, sf_dir, lambda: prep.kcore(pairs_of(spark, sf_dir), *CORE))


def contents(spark: SparkSession, sf_dir: str, axis: str) -> DataFrame:
    nodes = core_of(spark, sf_dir).select(F.col(axis).alias("node")).distinct()
    return kept(f"content_{axis}", spark, sf_dir, lambda: similarity.content(nodes, table(spark, sf_dir, "embeddings")))


def is_query(name: str):
    """The stated query set: nodes whose hash is divisible by 50."""
    return V.bucket(name, 50) == 0


def r(c, digits: int = 6):
    return F.round(c, digits)


# --- SQL building blocks -------------------------------------------------------------------------------------------
def fold_sql(x: str) -> str:
    return f"upper(regexp_replace(coalesce({x}, ''), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def bucket_sql(x: str, n) -> str:
    return f"(CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT) % {n})"


PAIRS_SQL = f"""term_key AS (SELECT {fold_sql('id')} AS k, id AS d FROM doid_terms),
alt_key AS (SELECT {fold_sql('x')} AS k, min(id) AS d FROM (SELECT id, unnest(alt_id) AS x FROM doid_terms) GROUP BY 1),
entered AS (SELECT DISTINCT {fold_sql('rna_symbol')} AS l, {fold_sql('do_id')} AS k FROM rnadisease WHERE {fold_sql('specise')} = 'HOMOSAPIENS'),
pairs AS MATERIALIZED (SELECT DISTINCT l, coalesce(t.d, a.d) AS d FROM entered LEFT JOIN term_key AS t USING (k) LEFT JOIN alt_key AS a USING (k)
  WHERE l <> '' AND k <> '' AND coalesce(t.d, a.d) IS NOT NULL)"""


def kcore_sql(name: str, start: str, ml: int, md: int, rounds: int = 12) -> str:
    out, at = [], start
    for i in range(1, rounds + 1):
        to = name if i == rounds else f"{name}_{i}"
        out.append(
            f"{to} AS MATERIALIZED (SELECT l, d FROM {at} WHERE l IN (SELECT l FROM {at} GROUP BY l HAVING count(*) >= {ml}) AND d IN (SELECT d FROM {at} GROUP BY d HAVING count(*) >= {md}))"
        )
        at = to
    return ",\n".join(out)


CORE_SQL = f"{PAIRS_SQL},\n{kcore_sql('core', 'pairs', *CORE)}"
CONTENT_SQL = f"""size AS (SELECT count(*) AS n FROM embeddings),
vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
nodes AS (SELECT DISTINCT 'l' AS axis, l AS node FROM core UNION SELECT DISTINCT 'd', d FROM core),
content AS MATERIALIZED (SELECT axis, node, coalesce(vec, [0.0::DOUBLE for x in range(64)]) AS vec,
  sqrt(list_sum(list_transform(coalesce(vec, [0.0::DOUBLE for x in range(64)]), lambda x: x * x))) AS len
  FROM nodes CROSS JOIN size LEFT JOIN vecs ON vec_id = {bucket_sql('node', '(n + n // 10)')})"""
COS_SQL = "round(list_dot_product(a.vec, b.vec) / ((a.len + 1e-8) * (b.len + 1e-8)), 9)"


# --- Preparation ---------------------------------------------------------------------------------------------------
@query(f"WITH {PAIRS_SQL} SELECT l, d FROM pairs")
def assoc_pairs(spark, sf_dir):
    return pairs_of(spark, sf_dir)


@query(f"""WITH {PAIRS_SQL.split('entered AS')[0].rstrip().rstrip(',')},
r AS (SELECT 'rnadisease' AS tab, {fold_sql('do_id')} AS k FROM rnadisease UNION ALL SELECT 'diseases_textmined', {fold_sql('doid')} FROM diseases_textmined)
SELECT tab, CASE WHEN t.d IS NOT NULL THEN 'id' WHEN a.d IS NOT NULL THEN 'alt' ELSE 'none' END AS route, count(*) AS n_rows, count(DISTINCT k) AS n_keys
FROM r LEFT JOIN term_key AS t USING (k) LEFT JOIN alt_key AS a USING (k) WHERE k <> '' GROUP BY 1, 2""")
def id_resolve(spark, sf_dir):
    keys = table(spark, sf_dir, "rnadisease").select(F.lit("rnadisease").alias("tab"), folded("do_id").alias("k"))
    keys = keys.unionByName(table(spark, sf_dir, "diseases_textmined").select(F.lit("diseases_textmined").alias("tab"), folded("doid").alias("k")))
    n = keys.filter("k <> ''").groupBy("tab", "k").agg(F.count(F.lit(1)).alias("n"))
    return prep.resolve_ids(n, table(spark, sf_dir, "doid_terms"), "k", "d").groupBy("tab", "route").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_keys"))


@query(f"""WITH {PAIRS_SQL}, g AS (SELECT 'l' AS axis, count(*) AS deg FROM pairs GROUP BY l UNION ALL SELECT 'd', count(*) FROM pairs GROUP BY d),
n AS (SELECT count(*)::DOUBLE AS p, count(DISTINCT l)::DOUBLE AS nl, count(DISTINCT d)::DOUBLE AS nd FROM pairs)
SELECT axis, count(*) AS n_nodes, min(deg) AS min_deg, max(deg) AS max_deg, round(avg(deg), 6) AS mean_deg, round((SELECT p / (nl * nd) FROM n), 9) AS density FROM g GROUP BY axis""")
def degree_stats(spark, sf_dir):
    p = pairs_of(spark, sf_dir)
    deg = p.groupBy("l").agg(F.count(F.lit(1)).alias("deg")).select(F.lit("l").alias("axis"), "deg").unionByName(p.groupBy("d").agg(F.count(F.lit(1)).alias("deg")).select(F.lit("d").alias("axis"), "deg"))
    per = deg.groupBy("axis").agg(F.count(F.lit(1)).alias("n_nodes"), F.min("deg").alias("min_deg"), F.max("deg").alias("max_deg"), r(F.avg("deg")).alias("mean_deg"), F.sum("deg").alias("_p"))
    size = F.broadcast(per.agg((F.max("_p").cast("double") / F.product(F.col("n_nodes").cast("double"))).alias("x")))
    return per.crossJoin(size).select("axis", "n_nodes", "min_deg", "max_deg", "mean_deg", r("x", 9).alias("density"))


@query(f"WITH {CORE_SQL} SELECT l, d FROM core")
def kcore_fixpoint(spark, sf_dir):
    return core_of(spark, sf_dir)


_GRID = [(a, b) for a in range(2, 6) for b in range(2, 6)]


@query(f"WITH {PAIRS_SQL},\n" + ",\n".join(kcore_sql(f"c{a}{b}", "pairs", a, b) for a, b in _GRID) + "\n" + "\nUNION ALL ".join(f"SELECT CAST({a} AS BIGINT) AS min_l, CAST({b} AS BIGINT) AS min_d, count(*) AS n_pairs, count(DISTINCT l) AS n_l, count(DISTINCT d) AS n_d FROM c{a}{b}" for a, b in _GRID))
def kcore_grid(spark, sf_dir):
    out, cores = None, {}
    for a, b in _GRID:
        # A core lies inside every looser core, so the tightest one found so far that is looser is the start.
        start = max((k for k in cores if k[0] <= a and k[1] <= b), key=sum, default=None)
        cores[a, b] = prep.kcore(cores[start] if start else pairs_of(spark, sf_dir), a, b)
        one = cores[a, b].agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("l").alias("n_l"), F.countDistinct("d").alias("n_d"))
        one = one.select(F.lit(a).cast("bigint").alias("min_l"), F.lit(b).cast("bigint").alias("min_d"), "n_pairs", "n_l", "n_d")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT lower(replace(replace(trim(regexp_replace(ncrna_category, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '-', ''), '_', '')) AS category,
lower(replace(trim(regexp_replace(species, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '_', ' ')) AS species, count(*) AS n FROM website_alldata
WHERE coalesce(trim(ncrna_symbol), '') <> '' GROUP BY 1, 2""")
def name_normalize(spark, sf_dir):
    t = table(spark, sf_dir, "website_alldata").filter(F.coalesce(F.trim("ncrna_symbol"), F.lit("")) != "")
    category = F.lower(F.translate(squeezed("ncrna_category"), "-_", ""))
    return t.groupBy(category.alias("category"), F.lower(F.replace(squeezed("species"), F.lit("_"), F.lit(" "))).alias("species")).agg(F.count(F.lit(1)).alias("n"))


_ROUTES_SQL = ", ".join(
    f"{n} AS (SELECT {fold_sql('x')} AS v, arg_min(symbol, hgnc_id) AS s FROM (SELECT unnest(string_split({c}, '|')) AS x, symbol, hgnc_id FROM hgnc_complete_set) GROUP BY 1)"
    for n, c in (("ap", "symbol"), ("al", "alias_symbol"), ("pr", "prev_symbol"))
)


@query(f"""WITH {_ROUTES_SQL}, w AS (SELECT {fold_sql('ncrna_symbol')} AS v, count(*) AS n FROM website_alldata GROUP BY 1)
SELECT w.v AS value, coalesce(ap.s, al.s, pr.s) AS symbol, CASE WHEN ap.s IS NOT NULL THEN 'approved' WHEN al.s IS NOT NULL THEN 'alias' WHEN pr.s IS NOT NULL THEN 'previous' ELSE 'none' END AS route, n
FROM w LEFT JOIN ap ON ap.v = w.v LEFT JOIN al ON al.v = w.v LEFT JOIN pr ON pr.v = w.v WHERE w.v <> ''""")
def alias_cascade(spark, sf_dir):
    n = table(spark, sf_dir, "website_alldata").groupBy(folded("ncrna_symbol").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter("value <> ''")
    return prep.name_cascade(n.select("value"), table(spark, sf_dir, "hgnc_complete_set")).join(n, "value")


@query("""SELECT CASE WHEN try_cast(trim(conf) AS DOUBLE) IS NULL THEN 'none' WHEN try_cast(trim(conf) AS DOUBLE) >= 2 THEN 'high' ELSE 'low' END AS band,
count(*) AS n, count(DISTINCT split_part(ens, '.', 1)) AS n_ens, round(avg(z), 6) AS mean_z FROM diseases_textmined GROUP BY 1""")
def safe_cast_filter(spark, sf_dir):
    conf = F.trim("conf").try_cast("double")
    band = F.when(conf.isNull(), "none").when(conf >= 2, "high").otherwise("low")
    return table(spark, sf_dir, "diseases_textmined").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.substring_index("ens", ".", 1)).alias("n_ens"), r(F.avg("z")).alias("mean_z"))


_TEXT_SQL = """texts AS (SELECT id, array_to_string(list_filter([trim(coalesce(name, '')), trim(coalesce(def, '')),
  CASE WHEN array_to_string(synonym[1:6], '; ') <> '' THEN 'Synonyms: ' || array_to_string(synonym[1:6], '; ') ELSE '' END], lambda x: x <> ''), '. ') AS text FROM doid_terms)"""


@query(f"WITH {_TEXT_SQL} SELECT id, text FROM texts")
def term_texts(spark, sf_dir):
    return prep.term_text(table(spark, sf_dir, "doid_terms"))


@query(f"""WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_split_to_array(upper(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'))) AS symbol FROM documents)
SELECT DISTINCT doc_id, symbol FROM d WHERE length(symbol) >= 4 AND symbol IN (SELECT {fold_sql('symbol')} FROM hgnc_complete_set)""")
def text_leak(spark, sf_dir):
    symbols = table(spark, sf_dir, "hgnc_complete_set").select(folded("symbol").alias("symbol"))
    return prep.token_leaks(table(spark, sf_dir, "documents"), symbols, "doc_id", "text")


_SEQ_SQL = f"""newest AS (SELECT {fold_sql('urs')} AS urs, arg_max(seq, (fetched_at, seq, name)) AS s FROM lncrna_seq WHERE urs IS NOT NULL AND trim(coalesce(seq, '')) <> '' GROUP BY 1),
seqs AS (SELECT urs, regexp_replace(replace(upper(trim(s)), 'T', 'U'), '[^ACGU]', 'N', 'g') AS seq FROM newest)"""


def _seqs(spark, sf_dir):
    return prep.clean_sequences(table(spark, sf_dir, "lncrna_seq"))


@query(f"""WITH {_SEQ_SQL}, g AS (SELECT urs, substr(seq, i, 3) AS kmer FROM (SELECT urs, seq, unnest(range(1, length(seq) - 1)) AS i FROM seqs)),
n AS (SELECT urs, kmer, count(*) AS n FROM g WHERE kmer NOT LIKE '%N%' GROUP BY 1, 2)
SELECT urs, kmer, n, round(n / sum(n) OVER (PARTITION BY urs), 12) AS freq, round(n / sqrt(sum(n::DOUBLE * n) OVER (PARTITION BY urs)), 12) AS unit FROM n""")
def kmer_spectrum(spark, sf_dir):
    return prep.kmer_spectrum(_seqs(spark, sf_dir), 3).select("urs", "kmer", "n", r("freq", 12).alias("freq"), r("unit", 12).alias("unit"))


_WIN_SQL = f"""{_SEQ_SQL}, wins AS (SELECT urs, CAST(i AS BIGINT) AS win, substr(seq, CAST(i * 1022 + 1 AS BIGINT), 1022) AS part
FROM (SELECT urs, seq, unnest(range(0, CAST(greatest(1, ceil(length(seq) / 1022.0)) AS BIGINT))) AS i FROM seqs))"""


@query(f"WITH {_WIN_SQL} SELECT urs, win, part FROM wins")
def seq_windows(spark, sf_dir):
    return prep.windows(_seqs(spark, sf_dir), 1022)


@query(f"""WITH {_WIN_SQL}, c AS (SELECT urs, {', '.join(f"length(regexp_replace(part, '[^{x}]', '', 'g')) AS {x.lower()}" for x in 'ACGU')} FROM wins)
SELECT urs, count(*) AS n_windows, {', '.join(f'round(avg({x}::DOUBLE / (a + c + g + u)), 9) AS {x}' for x in 'acgu')} FROM c WHERE a + c + g + u > 0 GROUP BY urs""")
def window_pooling(spark, sf_dir):
    """Mean over a sequence's windows of a vector for each window."""
    p = prep.pooled_composition(prep.windows(_seqs(spark, sf_dir), 1022))
    return p.select("urs", "n_windows", *[r(F.col("vec")[i], 9).alias(x) for i, x in enumerate("acgu")])


@query(f"""WITH {_SEQ_SQL}, c AS (SELECT urs, length(seq) AS n, length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc,
len(regexp_extract_all(seq, '[GC]+')) AS rg, len(regexp_extract_all(seq, '[^GC]+')) AS ra FROM seqs)
SELECT urs, n, round(gc / n, 12) AS gc, round((rg + ra - 1) / n, 12) AS changes, round(CASE WHEN rg > 0 THEN gc / rg ELSE 0 END, 12) AS mean_gc_run, round(CASE WHEN ra > 0 THEN (n - gc) / ra ELSE 0 END, 12) AS mean_au_run FROM c""")
def run_lengths(spark, sf_dir):
    f = prep.run_features(_seqs(spark, sf_dir))
    return f.select("urs", "n", *[r(c, 12).alias(c) for c in ("gc", "changes", "mean_gc_run", "mean_au_run")])


_CLOSURE_SQL = """is_a AS (SELECT DISTINCT id AS child, unnest(is_a) AS parent FROM doid_terms),
walk AS (SELECT t AS term, t AS anc, 0 AS dist FROM (SELECT child AS t FROM is_a UNION SELECT parent FROM is_a)
  UNION SELECT w.term, i.parent, w.dist + 1 FROM walk AS w JOIN is_a AS i ON i.child = w.anc WHERE w.dist < 40),
anc AS MATERIALIZED (SELECT term, anc, CAST(min(dist) AS BIGINT) AS dist FROM walk GROUP BY 1, 2)"""


def _closure(spark, sf_dir):
    terms = table(spark, sf_dir, "doid_terms")
    return kept("closure", spark, sf_dir, lambda: prep.closure(terms.select(F.col("id").alias("child"), F.explode("is_a").alias("parent")).distinct()))


@query(f"WITH RECURSIVE {_CLOSURE_SQL} SELECT term, anc, dist FROM anc")
def ontology_closure(spark, sf_dir):
    return _closure(spark, sf_dir)


@query(f"""WITH RECURSIVE {_CLOSURE_SQL}, s AS (SELECT term, anc, power(0.5::DOUBLE, dist) AS s FROM anc), v AS (SELECT term, sum(s) AS v FROM s GROUP BY term)
SELECT a.term AS a, b.term AS b, round(sum(a.s + b.s) / (any_value(va.v) + any_value(vb.v)), 6) AS sim FROM s AS a JOIN s AS b ON a.anc = b.anc
JOIN v AS va ON va.term = a.term JOIN v AS vb ON vb.term = b.term WHERE {bucket_sql('a.term', 50)} = 0 GROUP BY 1, 2""")
def wang_similarity(spark, sf_dir):
    return prep.wang_similarity(_closure(spark, sf_dir), is_query("term")).select("a", "b", r("sim").alias("sim"))


_NAMES_SQL = ", ".join(
    f"{n} AS (SELECT {fold_sql('x')} AS k, arg_min(symbol, hgnc_id) AS s FROM (SELECT {x} AS x, symbol, hgnc_id FROM hgnc_complete_set) WHERE {fold_sql('x')} <> '' GROUP BY 1)"
    for n, x in (("g1", "symbol"), ("g2", "ensembl_gene_id"), ("g3", "unnest(string_split(alias_symbol, '|'))"), ("g4", "unnest(string_split(prev_symbol, '|'))"))
)


@query(f"""WITH {_NAMES_SQL}, v AS (SELECT DISTINCT {fold_sql('symbol')} AS symbol, {fold_sql("split_part(ens, '.', 1)")} AS ens FROM diseases_textmined)
SELECT v.symbol, ens, coalesce(g1.s, g2.s, g3.s, g4.s) AS approved, CASE WHEN g1.s IS NOT NULL THEN 'direct' WHEN g2.s IS NOT NULL THEN 'by_ens' WHEN g3.s IS NOT NULL THEN 'alias'
WHEN g4.s IS NOT NULL THEN 'previous' ELSE 'none' END AS route FROM v LEFT JOIN g1 ON g1.k = v.symbol LEFT JOIN g2 ON g2.k = ens LEFT JOIN g3 ON g3.k = v.symbol LEFT JOIN g4 ON g4.k = v.symbol""")
def gene_cascade(spark, sf_dir):
    """Text-mined genes to approved symbols by symbol, Ensembl id without version, alias and previous name."""
    values = table(spark, sf_dir, "diseases_textmined").select(folded("symbol").alias("symbol"), folded(F.substring_index("ens", ".", 1)).alias("ens")).distinct()
    return prep.gene_cascade(values, table(spark, sf_dir, "hgnc_complete_set"))


def _kmers_sql(k: int) -> str:
    return f"""SELECT {k} AS k, urs, kmer, n / sqrt(sum(n::DOUBLE * n) OVER (PARTITION BY urs)) AS x FROM (SELECT urs, kmer, count(*) AS n
  FROM (SELECT urs, substr(seq, i, {k}) AS kmer FROM (SELECT urs, seq, unnest(range(1, length(seq) - {k - 2})) AS i FROM seqs)) WHERE kmer NOT LIKE '%N%' GROUP BY 1, 2)"""


@query(f"""WITH {_SEQ_SQL}, v AS ({_kmers_sql(3)} UNION ALL {_kmers_sql(4)})
SELECT urs, count(*) AS n_terms, count(*) FILTER (k = 3) AS n_three, round(sum(x * x), 9) AS length2, arg_max(kmer, (round(x, 12), kmer)) FILTER (k = 4) AS top_four FROM v GROUP BY urs""")
def kmer_concat(spark, sf_dir):
    """Vectors of 3-mers and 4-mers, each of length 1, side by side (320 columns): what is known of each."""
    seqs = cut(_seqs(spark, sf_dir))
    both = [prep.kmer_spectrum(seqs, k).select("urs", F.lit(k).alias("k"), "kmer", F.col("unit").alias("x")) for k in (3, 4)]
    four = F.max_by("kmer", F.when(F.col("k") == 4, F.struct(F.round("x", 12), "kmer"))).alias("top_four")
    out = both[0].unionByName(both[1]).groupBy("urs").agg(F.count(F.lit(1)).alias("n_terms"), F.count_if(F.col("k") == 3).alias("n_three"), r(F.sum(F.col("x") * F.col("x")), 9).alias("length2"), four)
    return out


# Patterns of disease names, in any case. Fixed values.
PATTERNS = {"tumour": "cancer|carcinoma|tumou?r|neoplasm|sarcoma|lymphoma|leuk", "syndrome": "syndrome|disease", "numbered": "[0-9]"}


@query("SELECT pattern, regexp_matches(coalesce(disease_name, ''), rule, 'i') AS hit, count(*) AS n_rows, count(DISTINCT disease_name) AS n_names FROM website_alldata, (VALUES "
       + ", ".join(f"('{k}', '{v}')" for k, v in PATTERNS.items()) + ") AS p(pattern, rule) GROUP BY 1, 2")
def pattern_counts(spark, sf_dir):
    """Rows and names that a pattern is found in; a null name is none of them."""
    names = table(spark, sf_dir, "website_alldata").groupBy("disease_name").agg(F.count(F.lit(1)).alias("n"))
    hits = [F.struct(F.lit(k).alias("pattern"), F.coalesce(F.col("disease_name").rlike(f"(?i)(?:{v})"), F.lit(False)).alias("hit")) for k, v in PATTERNS.items()]
    return names.select("disease_name", "n", F.explode(F.array(*hits)).alias("x")).groupBy("x.pattern", "x.hit").agg(F.sum("n").alias("n_rows"), F.count("disease_name").alias("n_names"))


# --- Contents and similarities ---------------------------------------------------------------------------------------
def _both_contents(spark, sf_dir):
    both = [contents(spark, sf_dir, a).select(F.lit(a).alias("axis"), "node", "vec") for a in ("l", "d")]
    return both[0].unionByName(both[1])


@query(f"WITH {CORE_SQL}, {CONTENT_SQL} SELECT axis, node, len > 0 AS known, round(len, 6) AS length, round(vec[1], 6) AS first FROM content")
def content_reindex(spark, sf_dir):
    n = V.norm(F.col("vec"))
    return _both_contents(spark, sf_dir).select("axis", "node", (n > 0).alias("known"), r(n).alias("length"), r(F.col("vec")[0]).alias("first"))


@query("""SELECT CAST(len(embedding) AS BIGINT) AS width, count(*) AS n, round(sum(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN isfinite(x) THEN x ELSE 0 END))), 3) AS total FROM embeddings GROUP BY 1""")
def content_check(spark, sf_dir):
    """Vectors with what is not finite made 0, and checked for their width while they are read."""
    e = table(spark, sf_dir, "embeddings").select(V.scrubbed(V.as_double(F.col("embedding"))).alias("v"))
    width = e.select(F.size("v").alias("w")).first()[0]
    v = e.select(V.asserted(F.col("v"), width).alias("v"))
    return v.groupBy(F.size("v").cast("bigint").alias("width")).agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.aggregate("v", F.lit(0.0), lambda s, x: s + x)), 3).alias("total"))


@query("""SELECT split_part(coalesce(symbol, ''), '-', 1) = coalesce(symbol, '') AS plain, count(*) AS n, round(avg(1 / (1 + exp(-z))), 6) AS squashed, round(avg(greatest(z - 2, 0)), 6) AS above,
round(avg(least(greatest(z, 1), 3)), 6) AS clipped, round(avg(abs(z - 2.5)), 6) AS away FROM diseases_textmined GROUP BY 1""")
def elementwise(spark, sf_dir):
    """Means of z after sigmoid, cut at 2, clipped to 1..3, and its distance from 2.5."""
    z, symbol = F.col("z"), F.coalesce("symbol", F.lit(""))
    return table(spark, sf_dir, "diseases_textmined").groupBy((F.substring_index(symbol, "-", 1) == symbol).alias("plain")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(V.sigmoid(z))).alias("squashed"), r(F.avg(F.greatest(z - 2, F.lit(0.0)))).alias("above"),
        r(F.avg(F.least(F.greatest(z, F.lit(1.0)), F.lit(3.0)))).alias("clipped"), r(F.avg(F.abs(z - 2.5))).alias("away"),
    )


@query(f"""WITH {CORE_SQL}, {CONTENT_SQL}, v AS (SELECT axis, node, list_concat(list_transform(vec, lambda x: x / (len + 1e-8)), list_transform(vec[1:8], lambda x: x / greatest(sqrt(list_sum(list_transform(vec[1:8], lambda y: y * y))), 1e-8))) AS c FROM content)
SELECT axis, node, CAST(len(c) AS BIGINT) AS dims, round(sqrt(list_sum(list_transform(c, lambda x: x * x))), 6) AS length, round(c[65], 6) AS second FROM v""")
def content_concat_l2(spark, sf_dir):
    both = F.concat(V.l2_added(F.col("vec")), V.l2_floored(F.slice("vec", 1, 8)))
    out = _both_contents(spark, sf_dir).withColumn("c", both)
    return out.select("axis", "node", F.size("c").cast("bigint").alias("dims"), r(V.norm(F.col("c"))).alias("length"), r(F.col("c")[64]).alias("second"))


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id AS node, {COS_SQL} AS sim FROM e AS a, e AS b WHERE a.vec_id % 50 = 0),
k AS (SELECT q, node, sim, row_number() OVER (PARTITION BY q ORDER BY sim DESC, lpad(CAST(node AS VARCHAR), 19, '0')) AS rank FROM s)
SELECT q, node, round(sim, 6) AS sim, rank FROM k WHERE rank <= 20""")
def cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.lpad(F.col("vec_id").cast("string"), 19, "0").alias("node"), V.as_double(F.col("embedding")).alias("vec"), "vec_id")
    top = similarity.top_cosine(e.filter("vec_id % 50 = 0").select("node", "vec"), e.select("node", "vec"), 20, [])
    return top.select(F.col("q").cast("bigint").alias("q"), F.col("node").cast("bigint").alias("node"), r("sim").alias("sim"), "rank")


_COOC_SQL = f"cooc AS MATERIALIZED (SELECT a.l AS a, b.l AS b, count(*) AS n FROM core AS a JOIN core AS b ON a.d = b.d WHERE {bucket_sql('a.l', 50)} = 0 GROUP BY 1, 2)"
# Every query l with every l; n is 0 where they share no d.
_PROFILE_SQL = f"""{_COOC_SQL}, deg AS (SELECT l, count(*) AS deg FROM core GROUP BY l),
met AS MATERIALIZED (SELECT x.l AS a, y.l AS b, greatest(x.deg + y.deg - 2 * coalesce(n, 0), 0) AS far, coalesce(n, 0) AS n
  FROM deg AS x CROSS JOIN deg AS y LEFT JOIN cooc AS c ON c.a = x.l AND c.b = y.l WHERE {bucket_sql('x.l', 50)} = 0)"""
_GIP_SQL = f"""{_PROFILE_SQL}, gamma AS (SELECT count(*) / (sum(deg) + 1e-8) AS g FROM deg),
gip AS MATERIALIZED (SELECT a, b, n, exp(-(SELECT g FROM gamma) * far) AS w FROM met)"""


@query(f"WITH {CORE_SQL}, {_COOC_SQL} SELECT a, b, n FROM cooc")
def cooccurrence(spark, sf_dir):
    return similarity.cooccurrence(core_of(spark, sf_dir), is_query("l"))


@query(f"WITH {CORE_SQL}, {_GIP_SQL} SELECT a, b, round(w, 6) AS w FROM gip")
def gip_kernel(spark, sf_dir):
    return similarity.gip(core_of(spark, sf_dir), is_query("l")).select("a", "b", r("w").alias("w"))


_BLEND_SQL = f"both_sims AS (SELECT g.a, g.b, g.w, {COS_SQL} AS cos FROM gip AS g JOIN content AS a ON a.axis = 'l' AND a.node = g.a JOIN content AS b ON b.axis = 'l' AND b.node = g.b)"


@query(f"WITH {CORE_SQL}, {CONTENT_SQL}, {_GIP_SQL}, {_BLEND_SQL} SELECT a, b, round(0.5 * cos + 0.5 * w, 6) AS sim FROM both_sims")
def integrated_sim(spark, sf_dir):
    """Content and profile kernel of query l with every l; all nodes are in training."""
    both = similarity.gip(core_of(spark, sf_dir), is_query("l"), contents(spark, sf_dir, "l"))
    return both.select("a", "b", r(0.5 * F.col("cos") + 0.5 * F.col("w")).alias("sim"))


def in_training(name: str):
    """Four fifths of the nodes, by another hash than that of the query set."""
    return V.bucket(F.concat(F.lit("blend/"), name), 5) != 0


def _in_training_sql(x: str) -> str:
    return f"{bucket_sql(f"'blend/' || {x}", 5)} <> 0"


@query(f"""WITH {CORE_SQL}, {CONTENT_SQL}, {_PROFILE_SQL}, gamma AS (SELECT count(*) / (sum(deg) + 1e-8) AS g FROM deg WHERE {_in_training_sql('l')})
SELECT met.a, met.b, round(0.3 * greatest({COS_SQL}, 0) + CASE WHEN {_in_training_sql('met.a')} AND {_in_training_sql('met.b')} THEN 0.7 * exp(-(SELECT g FROM gamma) * far) ELSE 0 END, 6) AS sim
FROM met JOIN content AS a ON a.axis = 'l' AND a.node = met.a JOIN content AS b ON b.axis = 'l' AND b.node = met.b""")
def blend_sim_full(spark, sf_dir):
    """Content everywhere, the profile kernel on the training block only; a fifth of the nodes, by hash, is not in it."""
    both = similarity.gip(core_of(spark, sf_dir), is_query("l"), contents(spark, sf_dir, "l"), in_training("l"))
    return both.select("a", "b", r(0.3 * F.greatest("cos", F.lit(0.0)) + F.coalesce(0.7 * F.col("w"), F.lit(0.0))).alias("sim"))


_KNN_SQL = f"""knn AS MATERIALIZED (SELECT q AS i, node AS j, sim AS w FROM (SELECT a.node AS q, b.node, {COS_SQL} AS sim,
  row_number() OVER (PARTITION BY a.node ORDER BY {COS_SQL} DESC, b.node) AS rank FROM content AS a, content AS b WHERE a.axis = 'd' AND b.axis = 'd') WHERE rank <= 6 AND sim > 0),
half AS (SELECT i, j, w FROM knn WHERE i <> j), sym AS (SELECT i, j, max(w) AS w FROM (SELECT i, j, w FROM half UNION ALL SELECT j, i, w FROM half) GROUP BY 1, 2),
full_ AS (SELECT * FROM sym UNION ALL SELECT DISTINCT x, x, 1.0::DOUBLE FROM (SELECT i AS x FROM knn UNION SELECT j FROM knn)), dg AS (SELECT i, sum(w) AS deg FROM full_ GROUP BY i),
graph AS MATERIALIZED (SELECT f.i, f.j, f.w / sqrt(p.deg * q.deg) AS w FROM full_ AS f JOIN dg AS p ON p.i = f.i JOIN dg AS q ON q.i = f.j)"""


def _disease_graph(spark, sf_dir):
    vec = contents(spark, sf_dir, "d")
    top = similarity.nearest(vec, vec, 6, [], positive=True)
    return similarity.normalized_graph(top.select(F.col("q").alias("i"), F.col("node").alias("j"), F.col("sim").alias("w")), True)


@query(f"WITH {CORE_SQL}, {CONTENT_SQL}, {_KNN_SQL} SELECT i, j, round(w, 6) AS w FROM graph")
def knn_graph_norm(spark, sf_dir):
    return _disease_graph(spark, sf_dir).select("i", "j", r("w").alias("w"))


def _propagate_sql(alpha: float, steps: int) -> str:
    out = [f"f0 AS (SELECT l AS q, d AS node, 1.0::DOUBLE AS w FROM core WHERE {bucket_sql('l', 50)} = 0)"]
    for i in range(1, steps + 1):
        moved = f"SELECT q, i AS node, f.w * g.w * {alpha} AS w FROM f{i - 1} AS f JOIN graph AS g ON g.j = f.node"
        out.append(f"f{i} AS MATERIALIZED (SELECT q, node, sum(w) AS w FROM ({moved} UNION ALL SELECT q, node, w * {1 - alpha} FROM f0) GROUP BY 1, 2)")
    return ", ".join(out)


@query(f"WITH {CORE_SQL}, {CONTENT_SQL}, {_KNN_SQL}, {_propagate_sql(0.5, 3)} SELECT q, node, round(w, 6) AS w FROM f3")
def label_propagation(spark, sf_dir):
    """Associations of query l spread over the graph of nearest diseases."""
    seeds = core_of(spark, sf_dir).filter(is_query("l")).select(F.col("l").alias("q"), F.col("d").alias("node"), F.lit(1.0).alias("w"))
    return similarity.propagate(cut(_disease_graph(spark, sf_dir)), seeds, 0.5, 3).select("q", "node", r("w").alias("w"))


def _power_sql(rounds: int) -> str:
    out = ["x0 AS (SELECT DISTINCT d, 1.0::DOUBLE AS x FROM core)"]
    for i in range(1, rounds + 1):
        out.append(f"y{i} AS MATERIALIZED (SELECT l, sum(x) AS y FROM core JOIN x{i - 1} USING (d) GROUP BY l)")
        out.append(f"x{i} AS MATERIALIZED (SELECT d, sum(y) AS x FROM core JOIN y{i} USING (l) GROUP BY d)")
    return ", ".join(out)


@query(f"WITH {CORE_SQL}, {_power_sql(5)} SELECT round(power((SELECT sum(x * x) FROM x5) / (SELECT sum(x * x) FROM x4), 0.25), 6) AS rho")
def spectral_radius(spark, sf_dir):
    return similarity.spectral_radius(core_of(spark, sf_dir), 5).select(r("rho").alias("rho"))


@query(f"""WITH {CORE_SQL}, {CONTENT_SQL}, {_KNN_SQL}, {_GIP_SQL},
e AS (SELECT 'l-d' AS kind, 1.0::DOUBLE AS w FROM core UNION ALL SELECT 'd-l', 1.0 FROM core UNION ALL SELECT 'd-d', w FROM graph UNION ALL SELECT 'l-l', w FROM gip WHERE n > 0)
SELECT kind, count(*) AS n_edges, round(sum(w), 4) AS weight FROM e GROUP BY kind""")
def hetero_adjacency(spark, sf_dir):
    core = core_of(spark, sf_dir)
    one = F.lit(1.0).alias("w")
    edges = core.select(F.lit("l-d").alias("kind"), one).unionByName(core.select(F.lit("d-l").alias("kind"), one))
    edges = edges.unionByName(_disease_graph(spark, sf_dir).select(F.lit("d-d").alias("kind"), "w")).unionByName(similarity.gip(core, is_query("l")).filter("n > 0").select(F.lit("l-l").alias("kind"), "w"))
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n_edges"), r(F.sum("w"), 4).alias("weight"))


_WALK_SQL = f"""w1 AS MATERIALIZED (SELECT l AS q, d AS node, count(*)::DOUBLE AS n FROM core WHERE {bucket_sql('l', 50)} = 0 GROUP BY 1, 2),
w2 AS MATERIALIZED (SELECT q, l AS node, sum(n) AS n FROM w1 JOIN core ON d = node GROUP BY 1, 2),
w3 AS MATERIALIZED (SELECT q, d AS node, sum(n) AS n FROM w2 JOIN core ON l = node GROUP BY 1, 2),
walks AS (SELECT q, 1 AS hop, node, n FROM w1 UNION ALL SELECT q, 2, node, n FROM w2 UNION ALL SELECT q, 3, node, n FROM w3)"""


@query(f"WITH {CORE_SQL}, {_WALK_SQL} SELECT q, CAST(hop AS BIGINT) AS hop, node, round(n / max(n) OVER (PARTITION BY hop), 6) AS w FROM walks")
def path_powers(spark, sf_dir):
    w = cut(similarity.walks(core_of(spark, sf_dir), is_query("l"), 3))
    return w.join(F.broadcast(w.groupBy("hop").agg(F.max("n").alias("top"))), "hop").select("q", "hop", "node", r(F.col("n") / F.col("top")).alias("w"))


@query(f"""WITH {CORE_SQL}, {_WALK_SQL}, s AS (SELECT q, hop, count(*) AS reach, sum(n) AS mass FROM walks GROUP BY 1, 2)
SELECT q, CAST(hop AS BIGINT) AS hop, reach, round((reach - avg(reach) OVER h) / (stddev_pop(reach) OVER h + 1e-8), 6) AS z_reach, round((mass - avg(mass) OVER h) / (stddev_pop(mass) OVER h + 1e-8), 6) AS z_mass
FROM s WINDOW h AS (PARTITION BY hop)""")
def hop_stats(spark, sf_dir):
    s = cut(similarity.walks(core_of(spark, sf_dir), is_query("l"), 3).groupBy("q", "hop").agg(F.count(F.lit(1)).alias("reach"), F.sum("n").alias("mass")))
    m = s.groupBy("hop").agg(*[f(c).alias(f"{n}_{c}") for c in ("reach", "mass") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda c: r((F.col(c) - F.col(f"m_{c}")) / (F.col(f"s_{c}") + F.lit(1e-8))).alias(f"z_{c}")
    return s.join(F.broadcast(m), "hop").select("q", "hop", "reach", z("reach"), z("mass"))


@query(f"WITH {CORE_SQL}, {_WALK_SQL} SELECT q AS l, node AS d, round(sum(CASE hop WHEN 1 THEN 0.01 * n ELSE 0.000001 * n END), 9) AS score FROM walks WHERE hop <> 2 GROUP BY 1, 2")
def katz_truncated(spark, sf_dir):
    """Walks of 1 and 3 steps weighted by 0.01 ** steps, for query l."""
    w = similarity.walks(core_of(spark, sf_dir), is_query("l"), 3).filter("hop <> 2")
    return w.groupBy(F.col("q").alias("l"), F.col("node").alias("d")).agg(r(F.sum(F.when(F.col("hop") == 1, 0.01).otherwise(0.000001) * F.col("n")), 9).alias("score"))


_NEAR_SQL = f"""near AS MATERIALIZED (SELECT * FROM (SELECT a.node AS q, b.node, {COS_SQL} AS sim, row_number() OVER (PARTITION BY a.node ORDER BY {COS_SQL} DESC, b.node) AS rank
  FROM content AS a, content AS b WHERE a.axis = 'l' AND b.axis = 'l' AND {bucket_sql('a.node', 50)} = 0 AND {bucket_sql('b.node', 50)} <> 0) WHERE sim > 0)"""


def _near(spark, sf_dir, k):
    vec = contents(spark, sf_dir, "l")
    return similarity.top_cosine(vec.filter(is_query("node")), vec.filter(~is_query("node")), k, [], positive=True)


def _rows_sql(k: int, weight: str) -> str:
    return f"""{_NEAR_SQL}, wt AS (SELECT q, node, {weight} AS w FROM near WHERE rank <= {k}), wn AS (SELECT q, node, w / (sum(w) OVER (PARTITION BY q) + 1e-8) AS w FROM wt)
SELECT q, d, round(sum(w), 6) AS score FROM wn JOIN core ON l = node GROUP BY 1, 2"""


@query(f"WITH {CORE_SQL}, {CONTENT_SQL}, {_rows_sql(5, 'power(0.7::DOUBLE, rank - 1) * sim')}")
def wknkn(spark, sf_dir):
    """Rows of query l imputed from their 5 nearest known neighbours, weight 0.7 ** place * similarity."""
    w = F.pow(F.lit(0.7), F.col("rank") - 1) * F.col("sim")
    return similarity.weighted_rows(_near(spark, sf_dir, 5), core_of(spark, sf_dir), w).select("q", "d", r("score").alias("score"))


@query(f"WITH {CORE_SQL}, {CONTENT_SQL}, {_rows_sql(10, 'sim')}")
def foldin_scores(spark, sf_dir):
    return similarity.weighted_rows(_near(spark, sf_dir, 10), core_of(spark, sf_dir), F.col("sim")).select("q", "d", r("score").alias("score"))


_IMPUTE = 5


def _sides_sql(axis: str, name: str, only: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT q, node, power(0.7::DOUBLE, rank - 1) * sim / (sum(sim) OVER (PARTITION BY q) + 1e-8) AS w FROM (SELECT a.node AS q, b.node, {COS_SQL} AS sim,
  row_number() OVER (PARTITION BY a.node ORDER BY {COS_SQL} DESC, b.node) AS rank FROM content AS a, content AS b WHERE a.axis = '{axis}' AND b.axis = '{axis}' AND a.node <> b.node{only}) WHERE rank <= {_IMPUTE} AND sim > 0)"""


@query(f"""WITH {CORE_SQL}, {CONTENT_SQL}, {_sides_sql('l', 'wl', f" AND {bucket_sql('a.node', 50)} = 0")}, {_sides_sql('d', 'wd', '')},
y AS MATERIALIZED (SELECT q AS l, d, sum(w) AS v FROM wl JOIN core ON l = node GROUP BY 1, 2), own AS (SELECT l, d, 1.0::DOUBLE AS v FROM core WHERE {bucket_sql('l', 50)} = 0),
parts AS (SELECT * FROM y UNION ALL SELECT l, q, sum(v * w) FROM own JOIN wd ON node = d GROUP BY 1, 2 UNION ALL SELECT l, q, sum(v * w) FROM y JOIN wd ON node = d GROUP BY 1, 2)
SELECT l, d, round(max(v), 6) AS v FROM (SELECT l, d, sum(v) / 3 AS v FROM parts GROUP BY 1, 2 UNION ALL SELECT * FROM own) GROUP BY 1, 2""")
def wknkn_both(spark, sf_dir):
    """Rows of query l imputed from the nearest known l, from the nearest d, and from both: the mean of the three, and at least
    what is observed. Weights 0.7 ** place * similarity over the sum of similarities, positive ones only."""

    def weights(axis: str, only):
        vec = contents(spark, sf_dir, axis)
        top = similarity.nearest(vec.filter(only), vec, _IMPUTE + 1, [], positive=True).filter("q <> node")
        top = top.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy("rank"))).filter(F.col("place") <= _IMPUTE)  # six rows for each q
        total = top.groupBy("q").agg(F.sum("sim").alias("t"))
        return cut(top.join(total, "q").select("q", "node", (F.pow(F.lit(0.7), F.col("place") - 1) * F.col("sim") / (F.col("t") + F.lit(1e-8))).alias("w")))

    core = core_of(spark, sf_dir)
    wl, wd = weights("l", is_query("node")), weights("d", F.lit(True))
    rows = cut(skew.join_salted(wl, core.select(F.col("l").alias("node"), "d"), "node").groupBy(F.col("q").alias("l"), "d").agg(F.sum("w").alias("v")))
    own = core.filter(is_query("l")).select("l", "d", F.lit(1.0).alias("v"))
    columns = lambda y: y.join(wd.withColumnsRenamed({"q": "to", "node": "d"}), "d").groupBy("l", F.col("to").alias("d")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    mean = rows.unionByName(columns(own)).unionByName(columns(rows)).groupBy("l", "d").agg((F.sum("v") / 3).alias("v"))
    return mean.unionByName(own).groupBy("l", "d").agg(r(F.max("v")).alias("v"))


# --- Folds, negatives, scores ----------------------------------------------------------------------------------------
def _folds_sql(name: str, cols: str, source: str, tag: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT {cols}, CAST(ntile(5) OVER (ORDER BY md5(concat_ws('/', '2026', '{tag}', {cols})), {cols}) AS BIGINT) AS fold FROM (SELECT DISTINCT {cols} FROM {source}))"


FOLDS_SQL = f"{_folds_sql('fl', 'l', 'core', 'l')}, {_folds_sql('fd', 'd', 'core', 'd')}, {_folds_sql('fp', 'l, d', 'core', 'pair')}"


def _fold(spark, sf_dir, cols, tag):
    return kept(f"folds_{tag}", spark, sf_dir, lambda: split.folds(cut(core_of(spark, sf_dir).select(*cols).distinct()), cols, tag))


@query(f"WITH {CORE_SQL}, {FOLDS_SQL} SELECT 'l' AS axis, l AS node, fold FROM fl UNION ALL SELECT 'd', d, fold FROM fd")
def node_folds(spark, sf_dir):
    both = [_fold(spark, sf_dir, [a], a).select(F.lit(a).alias("axis"), F.col(a).alias("node"), "fold") for a in ("l", "d")]
    return both[0].unionByName(both[1])


@query(f"WITH {CORE_SQL}, {FOLDS_SQL} SELECT l, d, fold FROM fp")
def pair_folds(spark, sf_dir):
    return _fold(spark, sf_dir, ["l", "d"], "pair")


PROTOCOLS = ("disease", "lncrna", "both", "warm")


def blocks(spark, sf_dir, protocol):
    """Train and evaluated pairs of each fold."""
    core = core_of(spark, sf_dir)
    if protocol == "warm":
        fp = _fold(spark, sf_dir, ["l", "d"], "pair")
        return core.join(fp.withColumnRenamed("fold", "f"), ["l", "d"]).crossJoin(F.broadcast(fp.select("fold").distinct())).filter("f <> fold").select("fold", "l", "d"), fp.select("fold", "l", "d")
    return split.scenario(core, _fold(spark, sf_dir, ["l"], "l"), _fold(spark, sf_dir, ["d"], "d"), protocol)


def _blocks_sql(protocol: str) -> str:
    train, test = {
        "disease": ("fd.fold <> f", "fd.fold = f"), "lncrna": ("fl.fold <> f", "fl.fold = f"),
        "both": ("fl.fold <> f AND fd.fold <> f", "fl.fold = f AND fd.fold = f"), "warm": ("fp.fold <> f", "fp.fold = f"),
    }[protocol]
    rows = "FROM core JOIN fl USING (l) JOIN fd USING (d) JOIN fp USING (l, d), (SELECT unnest(range(1, 6)) AS f)"
    return f"train AS MATERIALIZED (SELECT f AS fold, l, d {rows} WHERE {train}), pos AS MATERIALIZED (SELECT f AS fold, l, d {rows} WHERE {test})"


_NEG_SQL = f"""pool AS (SELECT fold, d AS nd, row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws('/', '2026', 'pool', d)), d) - 1 AS place, count(*) OVER (PARTITION BY fold) AS np FROM (SELECT DISTINCT fold, d FROM pos)),
want AS (SELECT fold, count(*) AS want FROM pos GROUP BY fold),
draw AS (SELECT fold, l, {bucket_sql("concat_ws('/', '2026', fold, l, d, t)", 'np')} AS place FROM pos JOIN (SELECT DISTINCT fold, np FROM pool) USING (fold), (SELECT unnest(range(0, 3)) AS t)),
cand AS (SELECT DISTINCT fold, l, nd AS d FROM draw JOIN pool USING (fold, place)),
got AS MATERIALIZED (SELECT fold, l, d FROM (SELECT fold, l, d, row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws('/', '2026', 'neg', fold, l, d))) AS rn FROM cand ANTI JOIN core USING (l, d)) JOIN want USING (fold) WHERE rn <= want),
short AS (SELECT fold, want - (SELECT count(*) FROM got WHERE got.fold = want.fold) AS lack FROM want),
more AS (SELECT fold, l, d FROM (SELECT fold, l, nd AS d, row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws('/', '2026', 'neg', fold, l, nd))) AS rn
  FROM (SELECT DISTINCT fold, l FROM pos) JOIN pool USING (fold) ANTI JOIN core AS c ON c.l = pos.l AND c.d = nd ANTI JOIN got AS g ON g.fold = pos.fold AND g.l = pos.l AND g.d = nd) JOIN short USING (fold) WHERE rn <= lack),
neg AS MATERIALIZED (SELECT * FROM got UNION ALL SELECT * FROM more)"""
_NEG_SQL = _NEG_SQL.replace("FROM (SELECT DISTINCT fold, l FROM pos) JOIN pool", "FROM (SELECT pos.fold, pos.l, nd FROM (SELECT DISTINCT fold, l FROM pos) AS pos JOIN pool USING (fold) WHERE pos.fold IN (SELECT fold FROM short WHERE lack > 0)) AS pos ANTI").replace("ANTI USING (fold) ANTI JOIN core", "ANTI JOIN core")


@query(f"WITH {CORE_SQL}, {FOLDS_SQL}\n" + "\nUNION ALL ".join(f"SELECT protocol, fold, part, count(*) AS n_pairs, count(DISTINCT l) AS n_l, count(DISTINCT d) AS n_d FROM (WITH {_blocks_sql(p)} SELECT '{p}' AS protocol, fold, 'train' AS part, l, d FROM train UNION ALL SELECT '{p}', fold, 'eval', l, d FROM pos) GROUP BY 1, 2, 3" for p in PROTOCOLS))
def scenario_blocks(spark, sf_dir):
    out = None
    for p in PROTOCOLS:
        for part, df in zip(("train", "eval"), blocks(spark, sf_dir, p)):
            one = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("l").alias("n_l"), F.countDistinct("d").alias("n_d"))
            one = one.select(F.lit(p).alias("protocol"), "fold", F.lit(part).alias("part"), "n_pairs", "n_l", "n_d")
            out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {CORE_SQL}, {FOLDS_SQL}, {_blocks_sql('both')}, {_NEG_SQL} SELECT fold, l, d FROM neg")
def uniform_negatives(spark, sf_dir):
    return split.negatives(blocks(spark, sf_dir, "both")[1], core_of(spark, sf_dir))


def _draw_sql(tag: str) -> str:
    """Draws from ``places`` (bin, at, neg_d) for ``want`` (l, d, bin): three by hash, then one among the unknown of the bin,
    then one among all unknown."""
    out = ["w0 AS (SELECT l, d, bin FROM want)", "sizes AS (SELECT bin, count(*) AS nb FROM places GROUP BY bin)"]
    for i in range(3):
        text = ", ".join([f"'2026', '{tag}', w.l, w.d", *([f"'{i}'"] if i else [])])
        out.append(f"""g{i} AS MATERIALIZED (SELECT w.l, w.d, neg_d, w.bin FROM w{i} AS w JOIN sizes AS s ON s.bin = w.bin JOIN places AS p ON p.bin = w.bin AND p.at = {bucket_sql(f"concat_ws('/', {text})", 'nb')}
  ANTI JOIN core AS c ON c.l = w.l AND c.d = neg_d)""")
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT * FROM w{i} ANTI JOIN g{i} USING (l, d))")
    for i, (cols, pool) in enumerate((("l, bin", "SELECT DISTINCT bin, neg_d FROM places"), ("l", "SELECT DISTINCT d AS neg_d FROM core")), 3):
        met = "JOIN pool USING (bin)" if i == 3 else "CROSS JOIN pool"
        out.append(f"""free{i} AS MATERIALIZED (WITH pool AS ({pool}), x AS (SELECT DISTINCT {cols} FROM w{i}), y AS (SELECT x.*, neg_d FROM x {met})
  SELECT y.*, row_number() OVER (PARTITION BY {cols} ORDER BY md5(concat_ws('/', '2026', 'free', y.l, neg_d)), neg_d) - 1 AS at, count(*) OVER (PARTITION BY {cols}) AS nb FROM y ANTI JOIN core AS c ON c.l = y.l AND c.d = neg_d)""")
        out.append(f"""g{i} AS MATERIALIZED (SELECT w.l, w.d, neg_d, w.bin FROM w{i} AS w JOIN free{i} AS f ON f.l = w.l {'AND f.bin = w.bin ' if i == 3 else ''}AND f.at = {bucket_sql(f"concat_ws('/', '2026', '{tag}', w.l, w.d, 'free')", 'f.nb')})""")
        out.append(f"w{i + 1} AS MATERIALIZED (SELECT * FROM w{i} ANTI JOIN g{i} USING (l, d))")
    return ",\n".join(out) + ",\ndrawn AS (" + " UNION ALL ".join(f"SELECT l, d, neg_d, bin FROM g{i}" for i in range(5)) + ")"


@query(f"""WITH {CORE_SQL}, deg AS (SELECT d, count(*) AS deg FROM core GROUP BY d), e AS (SELECT unnest(quantile_cont(deg, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e FROM deg),
b AS MATERIALIZED (SELECT d, (SELECT count(*) FROM e WHERE deg >= e) AS bin FROM deg),
places AS MATERIALIZED (SELECT bin, d AS neg_d, row_number() OVER (PARTITION BY bin ORDER BY md5(concat_ws('/', '2026', 'bin', d)), d) - 1 AS at FROM b),
want AS (SELECT l, d, bin FROM core JOIN b USING (d)), {_draw_sql('m')} SELECT l, d, neg_d, bin FROM drawn""")
def degree_matched_negatives(spark, sf_dir):
    core = core_of(spark, sf_dir)
    return split.matched_negatives(core, core, core.groupBy("d").agg(F.count(F.lit(1)).alias("deg")))


@query(f"""WITH {CORE_SQL}, places AS MATERIALIZED (SELECT 0 AS bin, d AS neg_d, row_number() OVER (ORDER BY md5(concat_ws('/', '2026', 'edge', l, d)), l, d) - 1 AS at FROM core),
want AS (SELECT l, d, 0 AS bin FROM core), {_draw_sql('deg')} SELECT l, d, neg_d FROM drawn""")
def degree_weighted_negatives(spark, sf_dir):
    core = core_of(spark, sf_dir)
    return split.edge_negatives(core, core)


@query(f"""WITH {CORE_SQL}, {FOLDS_SQL}, {_blocks_sql('both')}, n AS (SELECT fold, count(*) AS n_pos, count(DISTINCT l) * count(DISTINCT d) AS cells FROM pos GROUP BY fold),
k AS (SELECT p.fold, count(*) AS n_known FROM (SELECT DISTINCT fold, l FROM pos) AS p JOIN (SELECT DISTINCT fold, d FROM pos) AS q USING (fold) JOIN core USING (l, d) GROUP BY 1)
SELECT fold, n_pos, least(n_pos, cells - n_known) AS n_neg FROM n JOIN k USING (fold)""")
def negative_counts(spark, sf_dir):
    """Negatives of each fold: as many as positives, or as many unknown pairs as there are."""
    pos = cut(blocks(spark, sf_dir, "both")[1])
    n = split.negatives(pos, core_of(spark, sf_dir)).groupBy("fold").agg(F.count(F.lit(1)).alias("n_neg"))
    return pos.groupBy("fold").agg(F.count(F.lit(1)).alias("n_pos")).join(n, "fold", "left").select("fold", "n_pos", F.coalesce("n_neg", F.lit(0)).cast("bigint").alias("n_neg"))


def drawn(spark, sf_dir, protocol):
    """fold, l, d, label: the evaluated pairs and as many negatives."""

    def make():
        pos = cut(blocks(spark, sf_dir, protocol)[1])
        return pos.withColumn("label", F.lit(1)).unionByName(split.negatives(pos, core_of(spark, sf_dir)).withColumn("label", F.lit(0)))

    return kept(f"drawn_{protocol}", spark, sf_dir, make)


def scored(spark, sf_dir, protocol):
    """model, fold, l, d, label, score for the evaluated pairs and as many negatives."""

    def make():
        train, asked = cut(blocks(spark, sf_dir, protocol)[0]), drawn(spark, sf_dir, protocol)
        return score_wide(train, asked, contents(spark, sf_dir, "l"), contents(spark, sf_dir, "d"), MODELS)

    return long_scores(kept(f"scored_{protocol}", spark, sf_dir, make), MODELS).select("model", "fold", "l", "d", "label", "score")


# Of each protocol, the side whose query set is ranked for: its candidates are all nodes of the other side in the block.
QUERY_SIDE = {"lncrna": "l", "disease": "d", "both": "d", "warm": "d"}
# The query set: every 50th l by hash, and, as diseases are a list of fixed length, every 10th d.
QUERY_SHARE = {"l": 50, "d": 10}


def ranked_wide(spark, sf_dir, protocol, models=MODELS):
    """fold, l, d, label and a column for each model: every candidate for the protocol's query set, whatever their number.

    lncrna: cold l of the query set with all d; disease: cold d with all l; both: cold d with the fold's cold l; warm: d with
    all l, but for pairs of the training block.
    """

    def make():
        core = core_of(spark, sf_dir)
        train, _ = blocks(spark, sf_dir, protocol)
        train = cut(train)
        if protocol == "warm":
            folds_ = F.broadcast(_fold(spark, sf_dir, ["l", "d"], "pair").select("fold").distinct())  # one row per fold
            queries = core.select(F.col(side).alias("q")).distinct().crossJoin(folds_)
        else:
            queries = _fold(spark, sf_dir, [side], side).select("fold", F.col(side).alias("q"))
        queries = queries.filter(V.bucket("q", QUERY_SHARE[side]) == 0)
        if protocol == "both":
            grid = split.candidate_blocks(queries, _fold(spark, sf_dir, [other], other).select("fold", F.col(other).alias("c")), ["fold"])
        else:
            grid = split.candidate_blocks(queries, core.select(F.col(other).alias("c")).distinct(), [])
        grid = grid.select("fold", F.col("q").alias(side), F.col("c").alias(other))
        if protocol == "warm":
            grid = grid.join(train, ["fold", "l", "d"], "left_anti")
        label = F.coalesce(F.col("_known"), F.lit(0)).alias("label")
        asked = cut(grid.join(core.withColumn("_known", F.lit(1)), ["l", "d"], "left").select("fold", "l", "d", label))
        collect_garbage(spark)
        return score_wide(train, asked, contents(spark, sf_dir, "l"), contents(spark, sf_dir, "d"), models)

    side, other = QUERY_SIDE[protocol], "l" if QUERY_SIDE[protocol] == "d" else "d"
    return kept(f"ranked_{protocol}_{'_'.join(models)}", spark, sf_dir, make)


def ranked(spark, sf_dir, protocol, models=MODELS):
    """model, fold, q, c, l, d, label, score of every candidate for the protocol's query set."""
    return by_query(ranked_wide(spark, sf_dir, protocol, models), protocol, models)


def by_query(wide, protocol, models=MODELS):
    side, other = QUERY_SIDE[protocol], "l" if QUERY_SIDE[protocol] == "d" else "d"
    out = long_scores(wide, models)
    return out.select("model", "fold", F.col(side).alias("q"), F.col(other).alias("c"), "l", "d", "label", "score", *[c for c in wide.columns if c not in ("fold", "l", "d", "label", *models)])


def _near_fold_sql(name: str, axis: str, k: int = 10) -> str:
    return f"""{name} AS MATERIALIZED (SELECT fold, q, node, greatest(sim, 0) AS w FROM (SELECT e.fold, e.node AS q, t.node, {COS_SQL} AS sim,
  row_number() OVER (PARTITION BY e.fold, e.node ORDER BY {COS_SQL} DESC, t.node) AS rank
  FROM (SELECT DISTINCT fold, {axis} AS node FROM asked) AS e JOIN (SELECT DISTINCT fold, {axis} AS node FROM train) AS t ON t.fold = e.fold
  JOIN content AS a ON a.axis = '{axis}' AND a.node = e.node JOIN content AS b ON b.axis = '{axis}' AND b.node = t.node) WHERE rank <= {k})"""


_DRAWN_SQL = f"{_NEG_SQL},\nasked AS MATERIALIZED (SELECT fold, l, d, 1 AS label FROM pos UNION ALL SELECT fold, l, d, 0 FROM neg)"


def _whole_sql(protocol: str) -> str:
    """All candidates of the protocol's query set."""
    side = QUERY_SIDE[protocol]
    pairs = {
        "lncrna": "FROM fl, (SELECT DISTINCT d FROM core)", "disease": "FROM fd, (SELECT DISTINCT l FROM core)", "both": "FROM fd JOIN fl USING (fold)",
        "warm": "FROM (SELECT DISTINCT d FROM core), (SELECT DISTINCT l FROM core), (SELECT unnest(range(1, 6)) AS fold) ANTI JOIN train AS t ON t.fold = g.fold AND t.l = g.l AND t.d = g.d",
    }[protocol]
    if protocol == "warm":
        pairs = "FROM (SELECT fold, l, d FROM (SELECT DISTINCT d FROM core), (SELECT DISTINCT l FROM core), (SELECT unnest(range(1, 6)) AS fold)) AS g ANTI JOIN train USING (fold, l, d)"
    return f"asked AS MATERIALIZED (SELECT fold, l, d, CASE WHEN k.one IS NULL THEN 0 ELSE 1 END AS label FROM (SELECT fold, l, d {pairs} WHERE {bucket_sql(side, QUERY_SHARE[side])} = 0) LEFT JOIN (SELECT l, d, 1 AS one FROM core) AS k USING (l, d))"


def scored_sql(protocol: str, asked: str = _DRAWN_SQL) -> str:
    return f"""{CORE_SQL}, {CONTENT_SQL}, {FOLDS_SQL}, {_blocks_sql(protocol)}, {asked},
dl AS (SELECT fold, l, count(*) AS dl FROM train GROUP BY 1, 2), dd AS (SELECT fold, d, count(*) AS dd FROM train GROUP BY 1, 2),
{_near_fold_sql('nl', 'l')}, {_near_fold_sql('nd', 'd')},
nlw AS (SELECT fold, q, node, w / (sum(w) OVER (PARTITION BY fold, q) + 1e-8) AS w FROM nl), ndw AS (SELECT fold, q, node, w / (sum(w) OVER (PARTITION BY fold, q) + 1e-8) AS w FROM nd),
knn AS (SELECT s.fold, s.l, s.d, sum(a.w * b.w) AS score FROM asked AS s JOIN nlw AS a ON a.fold = s.fold AND a.q = s.l JOIN ndw AS b ON b.fold = s.fold AND b.q = s.d
  JOIN train AS t ON t.fold = s.fold AND t.l = a.node AND t.d = b.node GROUP BY 1, 2, 3),
np AS (SELECT nl.fold, q AS l, avg(dl) AS m FROM nl JOIN dl ON dl.fold = nl.fold AND dl.l = nl.node GROUP BY 1, 2),
scored AS MATERIALIZED (
  SELECT 'random' AS model, fold, l, d, label, {bucket_sql("concat_ws('/', 'random', l, d)", 4294967296)} / 4294967296.0::DOUBLE AS score FROM asked
  UNION ALL SELECT 'popularity', fold, l, d, label, coalesce(dl * dd, 0)::DOUBLE FROM asked LEFT JOIN dl USING (fold, l) LEFT JOIN dd USING (fold, d)
  UNION ALL SELECT 'popularity_one_sided', fold, l, d, label, coalesce(dl, 0)::DOUBLE FROM asked LEFT JOIN dl USING (fold, l)
  UNION ALL SELECT 'knn_content', fold, l, d, label, round(coalesce(score, 0), 9) FROM asked LEFT JOIN knn USING (fold, l, d)
  UNION ALL SELECT 'neighbour_popularity', fold, l, d, label, round(coalesce(m, 0) * (coalesce(dd, 0) + 1), 9) FROM asked LEFT JOIN np USING (fold, l) LEFT JOIN dd USING (fold, d))"""


SCORED_SQL = {p: scored_sql(p) for p in PROTOCOLS}
RANKED_SQL = {p: f"{scored_sql(p, _whole_sql(p))},\nranked AS MATERIALIZED (SELECT *, {s} AS q, {'l' if s == 'd' else 'd'} AS c FROM scored)" for p, s in QUERY_SIDE.items()}


def _add_scores(name: str, model: str):
    def f(spark, sf_dir):
        return scored(spark, sf_dir, "both").filter(F.col("model") == model).select("fold", "l", "d", F.col("label").cast("bigint").alias("label"), r("score").alias("score"))

    f.__name__ = name
    query(f"WITH {SCORED_SQL['both']} SELECT fold, l, d, CAST(label AS BIGINT) AS label, round(score, 6) AS score FROM scored WHERE model = '{model}'")(f)


for _name, _model in (("score_random", "random"), ("score_popularity", "popularity"), ("score_popularity_one_sided", "popularity_one_sided"), ("score_knn_content", "knn_content"), ("score_template", "neighbour_popularity")):
    _add_scores(_name, _model)

_UNIT_SQL = "unit AS MATERIALIZED (SELECT node AS l, list_transform(vec, lambda x: x / (len + 1e-8)) AS u FROM content WHERE axis = 'l')"


def _add_more_scores(name: str, model: str, protocol: str, sql: str):
    """Scores of a model that the evaluations do not hold, for the evaluated pairs of a protocol."""

    def f(spark, sf_dir):
        asked = cut(scored(spark, sf_dir, protocol).filter("model = 'random'").select("fold", "l", "d", "label"))
        out = score_all(cut(blocks(spark, sf_dir, protocol)[0]), asked, contents(spark, sf_dir, "l"), contents(spark, sf_dir, "d"), [model])
        return out.select("fold", "l", "d", F.col("label").cast("bigint").alias("label"), r("score", 4).alias("score"))

    f.__name__ = name
    query(f"WITH {SCORED_SQL[protocol]}, {sql}")(f)


_add_more_scores("score_knn_one_sided", "knn_one_sided", "disease", """near_d AS (SELECT fold, q AS d, node AS b, (w + 1e-8) / sum(w + 1e-8) OVER (PARTITION BY fold, q) AS w FROM nd),
near_s AS (SELECT n.fold, l, n.d, sum(w) AS s FROM near_d AS n JOIN train AS t ON t.fold = n.fold AND t.d = n.b GROUP BY 1, 2, 3)
SELECT fold, l, d, CAST(label AS BIGINT) AS label, round(coalesce(s, 0), 4) AS score FROM asked LEFT JOIN near_s USING (fold, l, d)""")
_add_more_scores("score_content_popularity", "content_popularity", "lncrna", f"""{_UNIT_SQL}, pull AS (SELECT a.fold, a.l, sum(list_dot_product(x.u, y.u) * dl) AS s
FROM (SELECT DISTINCT fold, l FROM asked) AS a JOIN dl ON dl.fold = a.fold JOIN unit AS x ON x.l = a.l JOIN unit AS y ON y.l = dl.l GROUP BY 1, 2)
SELECT fold, l, d, CAST(label AS BIGINT) AS label, round(coalesce(s, 0) * coalesce(dd, 0), 4) AS score FROM asked LEFT JOIN pull USING (fold, l) LEFT JOIN dd USING (fold, d)""")

_EVAL_SQL = """th AS (SELECT model, fold, score, sum(label)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM scored GROUP BY 1, 2, 3),
cu AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM th WINDOW w AS (PARTITION BY model, fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ev AS (SELECT model, fold, CAST(sum(tp) AS BIGINT) AS n_pos, CAST(sum(n) - sum(tp) AS BIGINT) AS n_neg, sum(tp * ctp / cn) / sum(tp) AS ap, sum((n - tp) * (ctp - tp / 2)) / (sum(tp) * (sum(n) - sum(tp))) AS auroc FROM cu GROUP BY 1, 2)"""


def _add_eval(name: str, protocol: str):
    def f(spark, sf_dir):
        e = metrics.average_precision(scored(spark, sf_dir, protocol), ["model", "fold"])
        return e.select("model", "fold", "n_pos", "n_neg", r("ap").alias("ap"), r("auroc").alias("auroc"))

    f.__name__ = name
    query(f"WITH {SCORED_SQL[protocol]}, {_EVAL_SQL} SELECT model, fold, n_pos, n_neg, round(ap, 6) AS ap, round(auroc, 6) AS auroc FROM ev")(f)


for _p in PROTOCOLS:
    _add_eval("eval_warm" if _p == "warm" else f"eval_cold_{_p}", _p)


# Ten draws of negatives at once: fold * 10 + draw takes the fold's place.
_TEN_SQL = f"""pos10 AS MATERIALIZED (SELECT fold * 10 + i AS fold, l, d FROM pos, (SELECT unnest(range(0, 10)) AS i)), {re.sub(r'\bpos\b', 'pos10', _NEG_SQL)},
asked AS MATERIALIZED (SELECT fold, l, d, 1 AS label FROM pos UNION ALL SELECT DISTINCT fold // 10, l, d, 0 FROM neg)"""


@query(f"""WITH {scored_sql('both', _TEN_SQL)}, each AS (SELECT model, fold * 10 + i AS fold, label, score FROM scored, (SELECT unnest(range(0, 10)) AS i) WHERE label = 1
  UNION ALL SELECT model, n.fold, 0, score FROM neg AS n JOIN scored AS s ON s.fold = n.fold // 10 AND s.l = n.l AND s.d = n.d AND label = 0), {_EVAL_SQL.replace('FROM scored', 'FROM each')}
SELECT model, fold // 10 AS fold, count(*) AS n_draws, round(avg(ap), 6) AS ap, round(stddev_pop(ap), 6) AS ap_std, round(avg(auroc), 6) AS auroc FROM ev GROUP BY 1, 2""")
def eval_ten_draws(spark, sf_dir):
    """Mean over ten draws of negatives of the 1:1 average precision and AUROC on both-cold folds; every pair is scored once."""
    train, pos = (cut(x) for x in blocks(spark, sf_dir, "both"))
    draws = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")
    pos10 = cut(pos.select("fold", "l", "d", draws).select((F.col("fold") * 10 + F.col("i")).alias("fold"), "l", "d"))
    neg = cut(split.negatives(pos10, core_of(spark, sf_dir)))
    drawn = pos10.withColumn("label", F.lit(1)).unionByName(neg.withColumn("label", F.lit(0))).withColumnRenamed("fold", "f10").withColumn("fold", F.floor(F.col("f10") / 10).cast("bigint"))
    asked = cut(drawn.select("fold", "l", "d").distinct())
    s = cut(score_all(train, asked, contents(spark, sf_dir, "l"), contents(spark, sf_dir, "d"), MODELS))
    e = metrics.average_precision(drawn.join(s, ["fold", "l", "d"]), ["model", "f10"])
    by = e.groupBy("model", F.floor(F.col("f10") / 10).cast("bigint").alias("fold"))
    return by.agg(F.count(F.lit(1)).alias("n_draws"), r(F.avg("ap")).alias("ap"), r(F.stddev_pop("ap")).alias("ap_std"), r(F.avg("auroc")).alias("auroc"))


def _add_native(protocol: str):
    def f(spark, sf_dir):
        e = metrics.average_precision(ranked(spark, sf_dir, protocol), ["model", "fold"])
        return e.select("model", "fold", "n_pos", "n_neg", r("ap").alias("ap"), r("auroc").alias("auroc"))

    f.__name__ = f"native_{protocol}"
    f.__doc__ = "Average precision at native prevalence: all candidates of the query set."
    query(f"WITH {RANKED_SQL[protocol]}, {_EVAL_SQL.replace('FROM scored', 'FROM ranked')} SELECT model, fold, n_pos, n_neg, round(ap, 6) AS ap, round(auroc, 6) AS auroc FROM ev")(f)


for _p in PROTOCOLS:
    _add_native(_p)


# --- Metrics and reports ---------------------------------------------------------------------------------------------
_TOP_SQL = "tops AS (SELECT *, row_number() OVER (PARTITION BY model, fold, q ORDER BY score DESC, c) AS rank FROM ranked)"
_RECALL_SQL = ", ".join(f"sum(CASE WHEN rank <= {k} THEN label ELSE 0 END) AS h{k}" for k in (10, 20, 50))
_RECALLS_SQL = " UNION ALL ".join(f"SELECT model, fold, CAST({k} AS BIGINT) AS k, count(*) AS n_queries, round(avg(h{k} / p), 6) AS recall FROM h GROUP BY 1, 2" for k in (10, 20, 50))


def _disease_recall(spark, sf_dir, ks):
    """The candidates are all l, so that all pairs of a d are its positives; only the best are labelled."""
    core, train = core_of(spark, sf_dir), cut(blocks(spark, sf_dir, "disease")[0])
    queries = cut(_fold(spark, sf_dir, ["d"], "d").filter(V.bucket("d", QUERY_SHARE["d"]) == 0).select("fold", "d"))
    every = core.select("l").distinct().crossJoin(F.broadcast(queries.select("fold").distinct())).select("fold", "l")  # one row per fold
    collect_garbage(spark)
    top = best_of_all(train, {"l": cut(every), "d": queries}, "d", contents(spark, sf_dir, "l"), contents(spark, sf_dir, "d"), MODELS, max(ks))
    known = core.join(queries, "d").select("fold", "l", "d", F.lit(1).alias("_known"))
    top = top.join(known, ["fold", "l", "d"], "left").withColumn("label", F.coalesce("_known", F.lit(0)))
    return metrics.recall_of_top(top, known.groupBy("fold", "d").agg(F.count(F.lit(1)).alias("p")), ["model", "fold"], "d", ks)


def _add_recall(name: str, protocol: str, doc: str):
    def f(spark, sf_dir):
        ks = [10, 20, 50]
        out = _disease_recall(spark, sf_dir, ks) if protocol == "disease" else metrics.recall_at(ranked(spark, sf_dir, protocol), ["model", "fold"], "q", "c", ks)
        return out.select("model", "fold", "k", "n_queries", r("recall").alias("recall"))

    f.__name__, f.__doc__ = name, doc
    query(f"WITH {RANKED_SQL[protocol]}, {_TOP_SQL}, h AS (SELECT model, fold, q, sum(label) AS p, {_RECALL_SQL} FROM tops GROUP BY 1, 2, 3 HAVING sum(label) > 0) {_RECALLS_SQL}")(f)


_add_recall("recall_at_k", "lncrna", "Of each cold l of the query set, the share of its d among the 10, 20 and 50 best of all d.")
_add_recall("recall_at_k_disease", "disease", "Of each cold d of the query set, the share of its l among the best of all l.")
_add_recall("recall_warm", "warm", "Of each d of the query set, the share of its held-out l among the best of all l but those of the training block.")


@query(f"""WITH {RANKED_SQL['lncrna']}, t AS (SELECT *, row_number() OVER (PARTITION BY model, fold ORDER BY score DESC, l || '/' || d) AS rank FROM ranked)
SELECT model, fold, count(*) AS n, round(avg(label), 6) AS precision FROM t WHERE rank <= 20 GROUP BY 1, 2""")
def precision_at_k(spark, sf_dir):
    """Share of known pairs among the 20 best of all candidates of the query set together."""
    tied = ranked(spark, sf_dir, "lncrna").withColumn("tie", F.concat_ws("/", "l", "d"))
    return metrics.precision_at(tied, ["model", "fold"], 20, "tie").select("model", "fold", "n", r("precision").alias("precision"))


@query(f"WITH {RANKED_SQL['lncrna']}, s AS (SELECT model, fold, c, stddev_pop(score) AS s FROM ranked GROUP BY 1, 2, 3) SELECT model, fold, round(avg(s), 6) AS personalization FROM s GROUP BY 1, 2")
def personalization(spark, sf_dir):
    return metrics.personalization(ranked(spark, sf_dir, "lncrna"), ["model", "fold"], "c").select("model", "fold", r("personalization").alias("personalization"))


_TAIL_SQL = "list_sum(list_transform(range({k}, least({g}, {m}) + 1), lambda i: exp(lgamma({g} + 1) - lgamma(i + 1) - lgamma({g} - i + 1) + CASE WHEN {m} - i <= {n} - {g} THEN lgamma({n} - {g} + 1) - lgamma({m} - i + 1) - lgamma({n} - {g} - {m} + i + 1) - (lgamma({n} + 1) - lgamma({m} + 1) - lgamma({n} - {m} + 1)) ELSE -1000 END)))"


@query(f"""WITH {RANKED_SQL['lncrna']}, tops AS (SELECT *, row_number() OVER (PARTITION BY model, fold, q ORDER BY score DESC, md5('2026/' || c), c) AS rank FROM ranked),
a AS (SELECT model, q, fold, count(*)::DOUBLE AS n, sum(label)::DOUBLE AS g, least(count(*), 20)::DOUBLE AS m, sum(CASE WHEN rank <= 20 THEN label ELSE 0 END)::DOUBLE AS k, count(DISTINCT score) AS n_scores FROM tops GROUP BY 1, 2, 3)
SELECT model, fold, q, CAST(k AS BIGINT) AS hits, round(k / m, 6) AS precision, n_scores, n_scores <= 1 AS degenerate, round(m * g / n, 6) AS expected,
round({_TAIL_SQL.format(k='CAST(k AS BIGINT)', g='CAST(g AS BIGINT)', m='CAST(m AS BIGINT)', n='CAST(n AS BIGINT)')}, 6) AS p FROM a WHERE g > 0""")
def hits_at_k(spark, sf_dir):
    """Hits among the 20 best of all candidates of each query, ties by hash; a scorer with one score for all is degenerate."""
    s = ranked(spark, sf_dir, "lncrna").withColumn("tie", F.concat(F.md5(F.concat(F.lit("2026/"), "c")), "c"))
    top = metrics.top_ranked(s, ["model", "fold", "q"], 20, "tie").groupBy("model", "fold", "q").agg(F.sum("label").alias("hits"))
    size = s.groupBy("model", "fold", "q").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("g"), F.countDistinct("score").alias("n_scores")).withColumn("m", F.least("n", F.lit(20))).filter("g > 0")
    both = size.join(top, ["model", "fold", "q"])
    return both.select(
        "model", "fold", "q", "hits", r(F.col("hits") / F.col("m")).alias("precision"), "n_scores", (F.col("n_scores") <= 1).alias("degenerate"),
        r(F.col("m") * F.col("g") / F.col("n")).alias("expected"), r(metrics.hypergeom_tail("hits", "n", "g", "m")).alias("p"),
    )


@query(f"""WITH {SCORED_SQL['both']}, th AS (SELECT model, fold, score, sum(label)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM scored GROUP BY 1, 2, 3),
rk AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model, fold ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank FROM th),
s AS (SELECT model, fold, sum(tp) AS p, sum(n) - sum(tp) AS m, sum(tp * rank) - sum(tp) * (sum(tp) + 1) / 2 AS u FROM rk GROUP BY 1, 2),
x AS (SELECT model, fold, u / (p * m) AS auc, (u - p * m / 2) / sqrt(p * m * (p + m + 1) / 12) AS z FROM s WHERE p > 0 AND m > 0), y AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM x)
SELECT model, fold, round(auc, 6) AS auc, round(z, 6) AS z, round(t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x), 6) AS p FROM y""")
def auroc_mannwhitney(spark, sf_dir):
    return metrics.mann_whitney(scored(spark, sf_dir, "both"), ["model", "fold"]).select("model", "fold", *[r(c).alias(c) for c in ("auc", "z", "p")])


@query(f"""WITH {RANKED_SQL['lncrna']}, deg AS (SELECT fold, d AS c, count(*) AS deg FROM train GROUP BY 1, 2), m AS (SELECT model, fold, c, avg(score) AS s FROM ranked GROUP BY 1, 2, 3),
x AS (SELECT model, m.fold, row_number() OVER (PARTITION BY model, m.fold ORDER BY round(s, 9), c) AS a, row_number() OVER (PARTITION BY model, m.fold ORDER BY coalesce(deg, 0), c) AS b FROM m LEFT JOIN deg USING (fold, c))
SELECT model, fold, round(corr(a, b), 6) AS rho FROM x GROUP BY 1, 2""")
def spearman_degree(spark, sf_dir):
    """Rank correlation, ties by name, of a candidate's mean score over the query set with its training degree."""
    deg = blocks(spark, sf_dir, "lncrna")[0].groupBy("fold", F.col("d").alias("c")).agg(F.count(F.lit(1)).alias("deg"))
    m = ranked(spark, sf_dir, "lncrna").groupBy("model", "fold", "c").agg(F.round(F.avg("score"), 9).alias("s")).join(deg, ["fold", "c"], "left")
    m = m.select("model", "fold", "c", "s", F.coalesce("deg", F.lit(0)).alias("deg"))
    a = skew.number_within_key(m, ["model", "fold"], ["s", "c"]).select("model", "fold", "c", F.col("_seq").alias("a"))
    b = skew.number_within_key(m, ["model", "fold"], ["deg", "c"]).select("model", "fold", "c", F.col("_seq").alias("b"))
    return a.join(b, ["model", "fold", "c"]).groupBy("model", "fold").agg(r(F.corr("a", "b")).alias("rho"))


@query(f"""WITH {RANKED_SQL['disease']}, deg AS (SELECT fold, l, count(*) AS deg FROM train GROUP BY 1, 2), s AS (SELECT x.* FROM ranked AS x LEFT JOIN deg USING (fold, l) WHERE coalesce(deg, 0) <= 5),
one AS (SELECT l FROM core WHERE {bucket_sql('d', QUERY_SHARE['d'])} = 0 GROUP BY l HAVING count(*) = 1), t AS (SELECT s.*, one.l IS NOT NULL AS only_one, row_number() OVER (PARTITION BY model, fold, q ORDER BY score DESC, c) AS rank FROM s LEFT JOIN one USING (l))
SELECT model, fold, q, count(*) AS n_pool, sum(label)::BIGINT AS n_pos, sum(CASE WHEN rank <= 20 THEN label ELSE 0 END)::BIGINT AS hits, sum(CASE WHEN only_one THEN label ELSE 0 END)::BIGINT AS n_only, sum(CASE WHEN rank <= 20 AND only_one THEN label ELSE 0 END)::BIGINT AS hits_only
FROM t GROUP BY 1, 2, 3""")
def pop_control(spark, sf_dir):
    """For each d of the query set, hits among the 20 best l when hubs (training degree over 5) are out of the pool; and those
    hits that have no other d of the query set."""
    one = core_of(spark, sf_dir).filter(V.bucket("d", QUERY_SHARE["d"]) == 0).groupBy("l").agg(F.count(F.lit(1)).alias("k")).filter("k = 1").select("l", F.lit(1).alias("only_one"))
    # The score of popularity_one_sided is the training degree of l.
    return _pool_hits(ranked_wide(spark, sf_dir, "disease").filter(F.col("popularity_one_sided") <= 5), one)


def _pool_hits(pool, one, models=MODELS):
    """Sizes of the pool (fold, l, d, label, a column for each model) are those of all models and counted once; a mark of
    ``one`` (l, only_one) matters for known pairs only and is looked up for them and for the 20 best."""
    only = F.sum(F.col("label") * F.coalesce("only_one", F.lit(0)))
    size = pool.groupBy("fold", F.col("d").alias("q")).agg(F.count(F.lit(1)).alias("n_pool"), F.sum("label").alias("n_pos"))
    marked = pool.filter("label = 1").select("fold", "l", "d", "label").join(one, "l").groupBy("fold", F.col("d").alias("q")).agg(only.alias("n_only"))
    top = metrics.top_ranked(by_query(pool, "disease", models), ["model", "fold", "q"], 20, "c")
    hits = top.join(one, "l", "left").groupBy("model", "fold", "q").agg(F.sum("label").alias("hits"), only.alias("hits_only"))
    out = hits.join(size, ["fold", "q"]).join(marked, ["fold", "q"], "left")
    return out.select("model", "fold", "q", "n_pool", "n_pos", F.coalesce("n_only", F.lit(0).cast("bigint")).alias("n_only"), "hits", "hits_only")


def _bag_sql(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array(upper(coalesce({x}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')), ' ')"


_EXT_SQL = f"""ext AS MATERIALIZED (SELECT DISTINCT {fold_sql('ncrna_symbol')} AS l, t.id AS d FROM website_alldata AS w JOIN (SELECT {_bag_sql('name')} AS bag, min(id) AS id FROM doid_terms GROUP BY 1) AS t ON t.bag = {_bag_sql('w.disease_name')}
  WHERE {fold_sql('species')} = 'HOMOSAPIENS' AND {fold_sql('ncrna_category')} = 'LNCRNA' AND {fold_sql('ncrna_symbol')} <> '' AND t.bag <> '')"""


def external_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "doid_terms").groupBy(word_bag("name").alias("bag")).agg(F.min("id").alias("d")).filter("bag <> ''")
    web = table(spark, sf_dir, "website_alldata").filter((folded("species") == "HOMOSAPIENS") & (folded("ncrna_category") == "LNCRNA"))
    return web.select(folded("ncrna_symbol").alias("l"), word_bag("disease_name").alias("bag")).filter("l <> ''").distinct().join(names, "bag").select("l", "d").distinct()


@query(f"""WITH {PAIRS_SQL}, {_EXT_SQL}, n AS (SELECT count(*) AS n FROM (SELECT l FROM pairs UNION SELECT l FROM ext)), o AS (SELECT d, count(*) AS g FROM pairs GROUP BY d), e AS (SELECT d, count(*) AS m FROM ext GROUP BY d),
b AS (SELECT d, count(*) AS k FROM pairs JOIN ext USING (l, d) GROUP BY d), x AS (SELECT d, g, m, coalesce(k, 0) AS k, n FROM o JOIN e USING (d) LEFT JOIN b USING (d), n)
SELECT d, g AS n_ours, m AS n_ext, k AS n_both, m - k AS n_novel, round(m * g / n, 6) AS expected, round({_TAIL_SQL.format(k='k', g='g', m='m', n='n')}, 6) AS p FROM x""")
def external_agreement(spark, sf_dir):
    x = _agreement(spark, sf_dir)
    return x.select("d", F.col("g").alias("n_ours"), F.col("m").alias("n_ext"), F.col("k").alias("n_both"), (F.col("m") - F.col("k")).alias("n_novel"), r(F.col("m") * F.col("g") / F.col("n")).alias("expected"), r(metrics.hypergeom_tail("k", "n", "g", "m")).alias("p"))


def _agreement(spark, sf_dir):
    """For each d of both corpora: pairs of ours (g), of theirs (m), of both (k), and all l (n)."""
    ours, ext = pairs_of(spark, sf_dir), cut(external_pairs(spark, sf_dir))
    n = ours.select("l").union(ext.select("l")).distinct().agg(F.count(F.lit(1)).alias("n"))
    count = lambda df, name: df.groupBy("d").agg(F.count(F.lit(1)).alias(name))
    return count(ours, "g").join(count(ext, "m"), "d").join(count(ours.join(ext, ["l", "d"], "left_semi"), "k"), "d", "left").fillna(0, ["k"]).crossJoin(F.broadcast(n))


@query(f"""WITH {RANKED_SQL['disease']}, {_EXT_SQL}, t AS (SELECT d, l, score, row_number() OVER (PARTITION BY d ORDER BY score DESC, l) AS rank FROM ranked WHERE model = 'knn_content' AND label = 0 AND score > 0)
SELECT t.d, t.l, round(score, 6) AS score, rank, ext.l IS NOT NULL AS in_second FROM t LEFT JOIN ext ON ext.d = t.d AND ext.l = t.l WHERE rank <= 20""")
def novel_candidates(spark, sf_dir):
    """The 20 best-scored of all unknown pairs of each d of the query set, and whether the second corpus has them."""
    c = ranked(spark, sf_dir, "disease", ["knn_content"]).filter("label = 0 and score > 0")
    ext = external_pairs(spark, sf_dir).withColumn("in_second", F.lit(True))
    top = metrics.top_ranked(c, ["d"], 20, "l").join(ext, ["l", "d"], "left")
    return top.select("d", "l", r("score").alias("score"), "rank", F.coalesce("in_second", F.lit(False)).alias("in_second"))


@query(f"""WITH {PAIRS_SQL}, t AS (SELECT {_bag_sql('name')} AS bag, min(id) AS id FROM doid_terms GROUP BY 1),
w AS (SELECT DISTINCT {fold_sql('ncrna_symbol')} AS l, t.id AS d, {fold_sql('pubmed_id')} AS pmid FROM website_alldata AS w JOIN t ON t.bag = {_bag_sql('w.disease_name')} WHERE t.bag <> '' AND {fold_sql('pubmed_id')} <> '')
SELECT l, d, count(*) AS n_papers, array_to_string(list_sort(list(pmid))[1:3], '|') AS first_papers FROM w JOIN pairs USING (l, d) GROUP BY 1, 2""")
def external_support(spark, sf_dir):
    """Papers of the second corpus for pairs of the first: how many, and the first three in order."""
    names = table(spark, sf_dir, "doid_terms").groupBy(word_bag("name").alias("bag")).agg(F.min("id").alias("d")).filter("bag <> ''")
    web = table(spark, sf_dir, "website_alldata").select(folded("ncrna_symbol").alias("l"), word_bag("disease_name").alias("bag"), folded("pubmed_id").alias("pmid")).filter("pmid <> ''")
    papers = web.join(names, "bag").select("l", "d", "pmid").distinct().join(pairs_of(spark, sf_dir), ["l", "d"], "left_semi")
    # The three least are kept in order of their number, so that no pair's papers are gathered.
    placed = skew.number_within_key(papers, ["l", "d"], ["pmid"])
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("_seq") < 3, F.col("pmid")))), "|")
    return placed.groupBy("l", "d").agg(F.count(F.lit(1)).alias("n_papers"), first.alias("first_papers"))


@query(f"""WITH {PAIRS_SQL}, {_EXT_SQL}, n AS (SELECT count(*) AS n FROM (SELECT l FROM pairs UNION SELECT l FROM ext)), o AS (SELECT d, count(*) AS g FROM pairs GROUP BY d), e AS (SELECT d, count(*) AS m FROM ext GROUP BY d),
b AS (SELECT d, count(*) AS k FROM pairs JOIN ext USING (l, d) GROUP BY d), x AS (SELECT d, g, m, coalesce(k, 0) AS k, n FROM o JOIN e USING (d) LEFT JOIN b USING (d), n),
p AS (SELECT d, k, {_TAIL_SQL.format(k='k', g='g', m='m', n='n')} AS p FROM x)
SELECT d, split_part(name, ' (', 1) AS label, k AS n_both, CASE WHEN p < 0.0001 THEN '<1e-4' ELSE printf('%.4f', p) END AS shown FROM p JOIN doid_terms ON id = d""")
def agreement_report(spark, sf_dir):
    """Agreement with the second corpus as a table is printed: short labels, small p as a bound."""
    x = _agreement(spark, sf_dir).select("d", F.col("k").alias("n_both"), metrics.hypergeom_tail("k", "n", "g", "m").alias("p"))
    names = table(spark, sf_dir, "doid_terms").select(F.col("id").alias("d"), F.substring_index("name", " (", 1).alias("label"))
    return x.join(names, "d").select("d", "label", "n_both", F.when(F.col("p") < 0.0001, "<1e-4").otherwise(F.format_string("%.4f", "p")).alias("shown"))


@query(f"""WITH {RANKED_SQL['disease']}, {_EXT_SQL}, t AS (SELECT d, l, row_number() OVER (PARTITION BY d ORDER BY score DESC, l) AS rank FROM ranked WHERE model = 'knn_content' AND label = 0),
x AS (SELECT t.d, count(*)::BIGINT AS n, count(e.l)::BIGINT AS g, count(e.l) FILTER (rank <= 20)::BIGINT AS h20, count(e.l) FILTER (rank <= 50)::BIGINT AS h50 FROM t LEFT JOIN ext AS e ON e.d = t.d AND e.l = t.l GROUP BY 1)
SELECT d, n AS n_unknown, g AS n_novel, h20, h50, round(20.0 * g / n, 6) AS expected20, round({_TAIL_SQL.format(k='h20', g='g', m='least(20, n)', n='n')}, 6) AS p20 FROM x WHERE g > 0""")
def external_hits(spark, sf_dir):
    """For each d of the query set, how many pairs that only the second corpus has are among the 20 and 50 best unknown ones."""
    ext = external_pairs(spark, sf_dir).withColumn("_novel", F.lit(1))
    c = ranked(spark, sf_dir, "disease", ["knn_content"]).filter("label = 0").join(ext, ["l", "d"], "left").withColumn("novel", F.coalesce("_novel", F.lit(0)))
    top = metrics.top_ranked(c, ["d"], 50, "l")
    hits = top.groupBy("d").agg(F.sum(F.when(F.col("rank") <= 20, F.col("novel")).otherwise(0)).alias("h20"), F.sum("novel").alias("h50"))
    x = c.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.sum("novel").alias("g")).filter("g > 0").join(hits, "d")
    p = metrics.hypergeom_tail(F.col("h20"), F.col("n"), F.col("g"), F.least(F.lit(20), F.col("n")))
    return x.select("d", F.col("n").alias("n_unknown"), F.col("g").alias("n_novel"), "h20", "h50", r(F.lit(20.0) * F.col("g") / F.col("n")).alias("expected20"), r(p).alias("p20"))


def evaluated(spark, sf_dir, protocol):
    return kept(f"evaluated_{protocol}", spark, sf_dir, lambda: metrics.average_precision(scored(spark, sf_dir, protocol), ["model", "fold"]).select("model", "fold", F.round("ap", 9).alias("value")))


_VALUE_SQL = f"WITH {SCORED_SQL['both']}, {_EVAL_SQL}, val AS (SELECT model, fold, round(ap, 9) AS value FROM ev)"


@query(f"{_VALUE_SQL} SELECT model, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std_pop, round(stddev_samp(value), 6) AS std_samp FROM val GROUP BY model")
def fold_summary(spark, sf_dir):
    return metrics.summarize(evaluated(spark, sf_dir, "both"), ["model"]).select("model", "n", *[r(c).alias(c) for c in ("mean", "std_pop", "std_samp")])


@query(f"""{_VALUE_SQL}, df AS (SELECT b.model, a.value - b.value AS x FROM val AS a JOIN val AS b USING (fold) WHERE a.model = 'knn_content' AND b.model <> 'knn_content')
SELECT model, count(x) AS n, round(avg(x), 6) AS mean_diff, round(CASE WHEN stddev_samp(x) > 0 THEN avg(x) / (stddev_samp(x) / sqrt(count(x))) END, 4) AS t, round(CASE WHEN stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) END, 4) AS d,
CASE WHEN stddev_samp(x) > 0 AND count(x) = 5 THEN round(1 - 1.5 * abs(avg(x)) / sqrt(4 * var_samp(x) / 5 + avg(x) ** 2) * (1 - avg(x) ** 2 / (4 * var_samp(x) / 5 + avg(x) ** 2) / 3), 6) END AS p FROM df GROUP BY model""")
def paired_stats(spark, sf_dir):
    v, out = evaluated(spark, sf_dir, "both"), None
    for other in MODELS:
        if other != "knn_content":
            one = metrics.paired(v, [], "fold", "model", "knn_content", other).withColumn("model", F.lit(other))
            out = one if out is None else out.unionByName(one)
    return out.filter("n > 0").select("model", "n", r("mean_diff").alias("mean_diff"), r("t", 4).alias("t"), r("d", 4).alias("d"), F.when(F.col("n") == 5, r("p")).alias("p"))


@query(f"""{_VALUE_SQL}, o AS (SELECT model, value, row_number() OVER (PARTITION BY model ORDER BY fold) - 1 AS place, count(*) OVER (PARTITION BY model) AS n FROM val),
dr AS (SELECT DISTINCT model, n, b, i, {bucket_sql("concat_ws('/', 'boot', model, b, i)", 'n')} AS place FROM (SELECT DISTINCT model, n FROM o), (SELECT unnest(range(0, 1000)) AS b), (SELECT unnest(range(0, 5)) AS i) WHERE i < n),
m AS (SELECT model, b, avg(value) AS m FROM dr JOIN o USING (model, place) GROUP BY 1, 2)
SELECT model, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY model""")
def bootstrap_ci(spark, sf_dir):
    """Percentile interval of the mean over folds from 1000 resamples drawn by hash."""
    v = evaluated(spark, sf_dir, "both").groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("fold", "value"))), lambda x: x["value"]).alias("v"))
    draws = v.select("model", "v", F.explode(F.sequence(F.lit(0), F.lit(999))).alias("b"))
    one = lambda i: F.col("v")[V.bucket(F.concat_ws("/", F.lit("boot"), "model", F.col("b").cast("string"), i.cast("string")), F.size("v")).cast("int")]
    means = draws.select("model", (F.aggregate(F.transform(F.sequence(F.lit(0), F.size("v") - 1), one), F.lit(0.0), lambda s, x: s + x) / F.size("v")).alias("m"))
    return means.groupBy("model").agg(r(F.expr("percentile(m, 0.025)")).alias("low"), r(F.expr("percentile(m, 0.975)")).alias("high"))


def _all_means(spark, sf_dir, protocols=PROTOCOLS):
    out = None
    for p in protocols:
        one = evaluated(spark, sf_dir, p).groupBy("model").agg(F.avg("value").alias("value")).withColumn("protocol", F.lit(p))
        out = one if out is None else out.unionByName(one)
    return out


_MEANS_SQL = "means AS (" + " UNION ALL ".join(f"SELECT '{p}' AS protocol, model, avg(round(ap, 9)) AS value FROM (WITH {SCORED_SQL[p]}, {_EVAL_SQL} SELECT model, ap FROM ev) GROUP BY model" for p in PROTOCOLS) + ")"


@query(f"WITH {_MEANS_SQL} SELECT model, " + ", ".join(f"round(max(CASE WHEN protocol = '{p}' THEN value END), 6) AS {p}" for p in PROTOCOLS) + " FROM means GROUP BY model")
def model_pivot(spark, sf_dir):
    return _all_means(spark, sf_dir).groupBy("model").pivot("protocol", list(PROTOCOLS)).agg(r(F.max("value")))


@query(f"""WITH {_MEANS_SQL} SELECT protocol, arg_max(model, value) FILTER (model <> 'knn_content') AS best_other, round(max(value) FILTER (model <> 'knn_content'), 6) AS other,
round(max(value) FILTER (model = 'knn_content') - max(value) FILTER (model <> 'knn_content'), 6) AS margin FROM means GROUP BY protocol""")
def margin(spark, sf_dir):
    m = _all_means(spark, sf_dir)
    other, mine = F.when(F.col("model") != "knn_content", F.col("value")), F.max(F.when(F.col("model") == "knn_content", F.col("value")))
    return m.groupBy("protocol").agg(F.max_by("model", other).alias("best_other"), r(F.max(other)).alias("other"), r(mine - F.max(other)).alias("margin"))


@query(f"""WITH {_MEANS_SQL}, p AS (SELECT model, protocol, value, row_number() OVER (PARTITION BY model ORDER BY CASE protocol WHEN 'both' THEN 1 WHEN 'disease' THEN 2 WHEN 'lncrna' THEN 3 ELSE 4 END) AS place FROM means WHERE value >= 0.55)
SELECT model, protocol, printf('%.3f', value) AS shown FROM p WHERE place = 1""")
def preferred_result(spark, sf_dir):
    """Results of several runs merged by model: the hardest protocol with a mean of at least 0.55 wins; shown to three digits."""
    rank = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(("both", "disease", "lncrna", "warm")) for x in (p, i)]), F.col("protocol"))
    best = _all_means(spark, sf_dir).filter("value >= 0.55").groupBy("model").agg(F.min_by(F.struct("protocol", "value"), rank).alias("x"))
    return best.select("model", "x.protocol", F.format_string("%.3f", "x.value").alias("shown"))


@query(f"""WITH {_MEANS_SQL}, a AS (SELECT model, round(value, 3) AS actual FROM means WHERE protocol = 'both'), e AS (SELECT model, round(value, 3) AS expected FROM means WHERE protocol = 'lncrna')
SELECT model, actual, expected FROM a FULL JOIN e USING (model) WHERE actual IS DISTINCT FROM expected""")
def golden_compare(spark, sf_dir):
    """Models whose mean on both-cold folds is not, to three digits, that on lncRNA-cold folds."""
    m = cut(_all_means(spark, sf_dir, ("both", "lncrna")))
    return metrics.golden_compare(m.filter("protocol = 'both'"), m.filter("protocol = 'lncrna'"), ["model"])


@query(f"{_VALUE_SQL}, done AS (SELECT model, fold FROM val WHERE value >= 0.5) SELECT model, fold FROM (SELECT DISTINCT model FROM val), (SELECT unnest(range(1, 6)) AS fold) ANTI JOIN done USING (model, fold)".replace(", (SELECT unnest(range(1, 6)) AS fold) ANTI", " CROSS JOIN (SELECT unnest(range(1, 6)) AS fold) ANTI"))
def resume_worklist(spark, sf_dir):
    """Work still to do: model and fold without a finished result (here: a value of at least 0.5)."""
    v = evaluated(spark, sf_dir, "both")
    work = v.select("model").distinct().select("model", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))).alias("fold"))
    return work.join(v.filter("value >= 0.5"), ["model", "fold"], "left_anti")


@query()
def energy_rank(spark, sf_dir):
    """Principal components of the contents needed for 0.6, 0.8 and 0.95 of the variance."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=64, inputCol="v", outputCol="p").fit(table(spark, sf_dir, "embeddings").select(array_to_vector(V.as_double(F.col("embedding"))).alias("v")))
    share = [float(x) for x in model.explainedVariance]
    total, ranks = 0.0, {}
    for i, x in enumerate(share):
        total += x
        for e in (0.6, 0.8, 0.95):
            if total >= e:
                ranks.setdefault(e, i + 1)
    return spark.createDataFrame([(e, k) for e, k in ranks.items()], "energy double, components bigint")
