"""From raw tables to a clean association table: resolving ids and names, k-core, sequences, ontology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bipartia.functions.text import folded
from bipartia.operators.skew import join_lookup, join_salted
from bipartia.sources.tables import cut, release


SMALL = 500_000


def resolve_ids(rows: DataFrame, terms: DataFrame, key: str, out: str) -> DataFrame:
    """Left-join ``key`` (folded) to terms by id, else by alternative id: ``out`` and ``route`` (id, alt or none)."""
    direct = terms.select(folded("id").alias(key), F.col("id").alias("_by_id"))
    alt = terms.select("id", F.explode("alt_id").alias("a")).groupBy(folded("a").alias(key)).agg(F.min("id").alias("_by_alt"))
    joined = rows.join(direct, key, "left").join(alt, key, "left")
    route = F.when(F.col("_by_id").isNotNull(), "id").when(F.col("_by_alt").isNotNull(), "alt").otherwise("none")
    return joined.withColumns({out: F.coalesce("_by_id", "_by_alt"), "route": route}).drop("_by_id", "_by_alt")


def association_pairs(rows: DataFrame, terms: DataFrame, species: str = "HOMOSAPIENS") -> DataFrame:
    """The distinct pairs (l, d) of a species: folded symbol and resolved disease id."""
    keys = rows.filter(folded("specise") == species).select(folded("rna_symbol").alias("l"), folded("do_id").alias("k")).filter("l <> '' and k <> ''")
    return resolve_ids(keys.distinct(), terms, "k", "d").filter("d is not null").select("l", "d").distinct()


def kcore(pairs: DataFrame, min_l: int, min_d: int) -> DataFrame:
    """The largest set of pairs in which every l has at least min_l and every d at least min_d of them.

    Both degrees of a round come from the same pairs; rounds go on until no pair is dropped. Degrees are counted before
    the shuffle; each round's pairs are written, those of the round before removed. Hot nodes are joined apart (see
    join_lookup) where there are more than SMALL pairs, which one task could hold.
    """
    # A written table is taken as it is, and stays.
    given, n = hasattr(pairs, "_cut_path"), -1
    pairs = pairs if given else cut(pairs)
    while n != (n := pairs.count()):
        kept, used, given = pairs, [] if given else [pairs], False
        for c, least in (("l", min_l), ("d", min_d)):
            degree = pairs.groupBy(c).agg(F.count(F.lit(1)).alias("n"))
            if n <= SMALL:
                kept = kept.join(degree.filter(F.col("n") >= least).select(c), c, "left_semi")
                continue
            degree = cut(degree)
            kept = join_lookup(kept, degree.filter(F.col("n") >= least).select(c), c, degree, "n", "inner")
            used.append(degree)
        pairs = cut(kept.select("l", "d"))
        release(*used)
    return pairs


def gene_cascade(values: DataFrame, genes: DataFrame) -> DataFrame:
    """(symbol, ens), both folded, to an approved symbol by the first route that knows it: the symbol itself, the gene with the
    Ensembl id, an alias, a previous name: symbol, ens, approved, route. Ties by the lowest hgnc_id."""
    one = lambda key, name: genes.select(key.alias(name), "symbol", "hgnc_id").filter(F.col(name) != "").groupBy(name).agg(F.min_by("symbol", "hgnc_id").alias(f"_{name}"))
    out = values
    for key, name, on in ((folded("symbol"), "direct", "symbol"), (folded("ensembl_gene_id"), "by_ens", "ens")):
        out = out.join(one(key, name).withColumnRenamed(name, on), on, "left")
    for c, name in (("alias_symbol", "alias"), ("prev_symbol", "previous")):
        each = genes.select(F.explode(F.split(F.coalesce(c, F.lit("")), r"\|")).alias("n"), F.col("symbol").alias("s"), "hgnc_id")
        each = each.select(folded("n").alias("symbol"), "s", "hgnc_id").filter("symbol <> ''").groupBy("symbol").agg(F.min_by("s", "hgnc_id").alias(f"_{name}"))
        out = out.join(each, "symbol", "left")
    routes = ["direct", "by_ens", "alias", "previous"]
    route = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in routes], F.lit("none"))
    return out.select("symbol", "ens", F.coalesce(*[F.col(f"_{n}") for n in routes]).alias("approved"), route.alias("route"))


def name_cascade(values: DataFrame, genes: DataFrame) -> DataFrame:
    """Folded ``value`` -> symbol by the first route that knows it: approved, alias, previous; ties by lowest hgnc_id."""

    def names(c: str) -> DataFrame:
        each = F.explode(F.split(F.coalesce(c, F.lit("")), r"\|"))
        return genes.select(each.alias("n"), "symbol", "hgnc_id").groupBy(folded("n").alias("value")).agg(F.min_by("symbol", "hgnc_id").alias(f"_{c}"))

    out = values
    for c in ("symbol", "alias_symbol", "prev_symbol"):
        out = out.join(names(c).filter("value <> ''"), "value", "left")
    route = F.when(F.col("_symbol").isNotNull(), "approved").when(F.col("_alias_symbol").isNotNull(), "alias").when(F.col("_prev_symbol").isNotNull(), "previous")
    return out.select("value", F.coalesce("_symbol", "_alias_symbol", "_prev_symbol").alias("symbol"), F.coalesce(route, F.lit("none")).alias("route"))


def clean_sequences(seqs: DataFrame) -> DataFrame:
    """The newest usable fetch of each urs: urs, name, seq in upper case with U for T and N for other letters."""
    usable = seqs.filter("urs is not null and trim(coalesce(seq, '')) <> ''")
    newest = usable.groupBy(folded("urs").alias("urs")).agg(F.max_by(F.struct("name", "seq"), F.struct("fetched_at", "seq", "name")).alias("x"))
    seq = F.regexp_replace(F.translate(F.upper(F.trim("x.seq")), "T", "U"), "[^ACGU]", "N")
    return newest.select("urs", F.col("x.name").alias("name"), seq.alias("seq"))


def kmer_spectrum(seqs: DataFrame, k: int) -> DataFrame:
    """Frequency of each k-mer among those in the alphabet, and its share of the vector's length: urs, kmer, n, freq, unit."""
    at = F.sequence(F.lit(1), F.length("seq") - (k - 1))
    grams = seqs.filter(F.length("seq") >= k).select("urs", F.explode(F.transform(at, lambda i: F.substring("seq", i, F.lit(k)))).alias("kmer"))
    n = grams.filter(~F.col("kmer").contains("N")).groupBy("urs", "kmer").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("urs").agg(F.sum("n").alias("t"), F.sqrt(F.sum(F.col("n").cast("double") * F.col("n"))).alias("len"))
    return n.join(total, "urs").select("urs", "kmer", "n", (F.col("n") / F.col("t")).alias("freq"), (F.col("n") / F.col("len")).alias("unit"))


def windows(seqs: DataFrame, size: int) -> DataFrame:
    """Consecutive windows of whole sequences: urs, win, part."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size))
    return seqs.select("urs", "seq", F.posexplode(starts).alias("win", "at")).select("urs", F.col("win").cast("bigint").alias("win"), F.expr(f"substring(seq, at + 1, {size})").alias("part"))


def pooled_composition(wins: DataFrame) -> DataFrame:
    """Mean over a sequence's windows of their shares of A, C, G and U: urs, n_windows, vec. Windows of unknown letters only are masked."""
    share = [F.length(F.regexp_replace("part", f"[^{c}]", "")) for c in "ACGU"]
    known = sum(share[1:], share[0])
    per = wins.filter(known > 0).select("urs", *[(s / known).alias(c) for s, c in zip(share, "acgu")])
    return per.groupBy("urs").agg(F.count(F.lit(1)).alias("n_windows"), F.array(*[F.avg(c) for c in "acgu"]).alias("vec"))


def run_features(seqs: DataFrame) -> DataFrame:
    """GC share, changes between GC and AU per letter, mean runs of both kinds: urs, n, gc, changes, mean_gc_run, mean_au_run."""
    gc = F.length(F.regexp_replace("seq", "[^GC]", ""))
    runs_gc, runs_au = F.size(F.regexp_extract_all("seq", F.lit("[GC]+"), 0)), F.size(F.regexp_extract_all("seq", F.lit("[^GC]+"), 0))
    n = F.length("seq")
    return seqs.select(
        "urs", n.cast("bigint").alias("n"), (gc / n).alias("gc"), ((runs_gc + runs_au - 1) / n).alias("changes"),
        F.when(runs_gc > 0, gc / runs_gc).otherwise(0.0).alias("mean_gc_run"), F.when(runs_au > 0, (n - gc) / runs_au).otherwise(0.0).alias("mean_au_run"),
    )


def term_text(terms: DataFrame) -> DataFrame:
    """id and text: name, definition and the first six synonyms, without blank parts."""
    syn = F.array_join(F.slice(F.coalesce("synonym", F.array().cast("array<string>")), 1, 6), "; ")
    parts = F.array(F.trim(F.coalesce("name", F.lit(""))), F.trim(F.coalesce("def", F.lit(""))), F.when(syn != "", F.concat(F.lit("Synonyms: "), syn)).otherwise(""))
    return terms.select("id", F.array_join(F.filter(parts, lambda p: p != ""), ". ").alias("text"))


def token_leaks(texts: DataFrame, symbols: DataFrame, id_col: str, text_col: str, least: int = 4) -> DataFrame:
    """Symbols of at least ``least`` characters that stand as a word in a text: id, symbol."""
    token = F.explode(F.array_distinct(F.split(F.upper(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+")))
    tokens = texts.select(id_col, token.alias("symbol")).filter(F.length("symbol") >= least)
    return tokens.join(symbols.filter(F.length("symbol") >= least).select("symbol").distinct(), "symbol", "left_semi").select(id_col, "symbol").distinct()


def closure(is_a: DataFrame) -> DataFrame:
    """Ancestors of every term with the shortest distance, itself at 0: term, anc, dist. Cycles end the walk."""
    terms = is_a.select(F.explode(F.array("child", "parent")).alias("term")).distinct()
    done = cut(terms.select("term", F.col("term").alias("anc"), F.lit(0).cast("bigint").alias("dist")))
    front = done
    while not front.isEmpty():
        up = front.join(is_a.select(F.col("child").alias("anc"), "parent"), "anc").select("term", F.col("parent").alias("anc"), (F.col("dist") + 1).alias("dist")).distinct()
        front = cut(up.join(done, ["term", "anc"], "left_anti"))
        done = cut(done.unionByName(front))
    return done


def wang_similarity(anc: DataFrame, queries: Column) -> DataFrame:
    """Semantic similarity of query terms with all terms that share an ancestor: a, b, sim.

    A term's ancestor weighs 0.5 ** distance; sim is the weights of the common ancestors over all weights of both.
    """
    s = anc.select("term", "anc", F.pow(F.lit(0.5), "dist").alias("s"))
    sv = s.groupBy("term").agg(F.sum("s").alias("sv"))
    a = s.filter(queries).select(F.col("term").alias("a"), "anc", F.col("s").alias("sa"))
    # Every term has the root: its terms are met in parts.
    common = join_salted(a, s.select("anc", F.col("term").alias("b"), F.col("s").alias("sb")), "anc").groupBy("a", "b").agg(F.sum(F.col("sa") + F.col("sb")).alias("c"))
    with_a = common.join(sv.select(F.col("term").alias("a"), F.col("sv").alias("va")), "a")
    return with_a.join(sv.select(F.col("term").alias("b"), F.col("sv").alias("vb")), "b").select("a", "b", (F.col("c") / (F.col("va") + F.col("vb"))).alias("sim"))
