"""Mapping free-entered values to a canonical list.

Distinct folded values are probed against the folded reference names with an inverted index over character 4-grams,
candidates are scored by weighted cosine, and the accepted candidate must pass an exact check. All of it is joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bipartia.functions.text import folded
from bipartia.sources.tables import BROADCAST_BYTES, cut

# Words that only tell the kind of molecule or the species, folded. Fixed values.
KIND_WORDS = ["HOMOSAPIENS", "HUMAN", "HSA", "MUSMUSCULUS", "MOUSE", "MMU", "RATTUSNORVEGICUS", "RNO", "LONGINTERGENICNCRNA", "LONGINTERGENICNONCODINGRNA",
              "LONGNONCODINGRNA", "NONCODINGRNA", "LINCRNA", "LNCRNA", "NCRNA", "RNA", "GENE", "TRANSCRIPT"]
# Words that join two names of one entry. Fixed values.
JOIN_WORDS = ["ALIAS"]

GRAM = 4
# One wrong, missing or extra letter changes at most GRAM of a value's grams, so of any GRAM + 1 one is left.
# A swap may change GRAM + 1, but keeps the sorted letters, which are indexed as one more gram.
PROBES = GRAM + 1
# Indexes of up to this many bytes are broadcast; larger ones are joined by shuffle, where a gram with more probes than
# SALT is met in several parts.
BROADCAST_INDEX = BROADCAST_BYTES
SALT = 50_000


def reference_names(df: DataFrame, entry: str, approved: str, others: list[str], sep: str = r"\|") -> DataFrame:
    """Names of a reference list: name (folded), entry, rank (order of entries), symbol, approved.

    ``others`` hold further names, separated by ``sep``. Names that fold to nothing are left out.
    """
    rank = F.coalesce(F.regexp_extract(entry, r"(\d+)\s*$", 1).try_cast("bigint"), F.lit(2**62))
    parts = [F.array(F.struct(F.col(approved).alias("n"), F.lit(True).alias("approved")))]
    parts += [F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda n: F.struct(n.alias("n"), F.lit(False).alias("approved"))) for c in others]
    names = df.select(F.col(entry).alias("entry"), rank.alias("rank"), F.col(approved).alias("symbol"), F.explode(F.concat(*parts)).alias("x"))
    names = names.select(folded("x.n").alias("name"), "entry", "rank", "symbol", F.col("x.approved").alias("approved")).filter("name <> ''")
    return names.groupBy("name", "entry", "rank", "symbol").agg(F.max("approved").alias("approved"))


def _grams(text: Column) -> Column:
    padded = F.concat(F.lit("^" * (GRAM - 1)), text, F.lit("$" * (GRAM - 1)))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (GRAM - 1)), lambda i: F.substring(padded, i, F.lit(GRAM))))


def _sorted_letters(text: Column) -> Column:
    return F.concat(F.lit("#"), F.array_join(F.array_sort(F.split(text, "")), ""))


def _vector(text: Column) -> Column:
    return F.concat(_grams(text), F.array(_sorted_letters(text)))


def _whole(text: Column) -> Column:
    return F.concat(F.lit("="), text)


def without_kind_words(value: Column) -> Column:
    """A folded value without words of kind or species at its ends."""
    words = "(?:" + "|".join(KIND_WORDS) + ")+"
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "|".join(JOIN_WORDS), ""), "^" + words, ""), words + "$", "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{N}]", "")


def _one_edit(a: Column, b: Column) -> Column:
    """One letter wrong, missing, extra, or swapped with its neighbour; the digits are the same."""
    at = F.sequence(F.lit(1), F.length(a) - 1)
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    swap = (F.length(a) == F.length(b)) & (F.length(a) > 1) & (_sorted_letters(a) == _sorted_letters(b)) & F.exists(at, lambda i: swapped(i) == b)
    return (_digits(a) == _digits(b)) & (a != b) & ((F.levenshtein(a, b, 1) == 1) | swap)


def _meet(probes: DataFrame, postings: DataFrame) -> DataFrame:
    """Join on ``gram``; grams with many probes are salted, and their postings repeated for each salt. Such grams are at
    most probes / SALT many, so their list is broadcast."""
    load = probes.groupBy("gram").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT)).cast("int").alias("_parts")).filter("_parts > 1")
    load = F.broadcast(cut(load))
    parts = F.coalesce("_parts", F.lit(1))
    left = probes.join(load, "gram", "left").withColumn("_salt", F.pmod(F.hash("value"), parts)).drop("_parts")
    right = postings.join(load, "gram", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, ["gram", "_salt"]).drop("_salt")


def map_to_canonical(values: DataFrame, names: DataFrame, threshold: float = 0.0, margin: float = 1.0) -> DataFrame:
    """Map each distinct ``value`` (folded) to an entry of ``names``: value, symbol, entry, how, score.

    Normalise: the value as it is, and its core without words of kind or species at its ends.
    Retrieve: a text that is a name probes with the whole text; every other text with its PROBES rarest 4-grams (enough for one edit, for a whole name and for
    a text made of two names: at most GRAM - 1 grams span the border) and its sorted letters. No posting is capped.
    Score: cosine of idf-weighted gram vectors; candidates below ``threshold`` go. The default drops none: one letter
    of a short name may leave a single, common gram shared, which in a long list weighs next to nothing, so no threshold
    above 0 keeps all that the rules accept. Among the candidates of a rule the best cosine comes first.
    Accept, by the first rule that holds: ``exact`` the value is a name; ``core`` the core is a name; ``pair`` a name
    and the rest are two names of one entry; ``edit`` one letter of the value differs. A name belongs to the entry that
    has it approved, else to the lowest ``rank``. By ``edit``, a value whose best entry does not lead every other
    entry by ``margin`` is unmatched. Cosines are at most 1, so the default, 1.0, means exactly one entry: two entries
    that one letter leads to are equally likely whatever their cosines. A lower margin lets a clear lead decide.
    Unmatched values come with symbol '' and how 'none', and with ``rivals``, the entries that none of them leads, if any. Null and empty values are left out; an empty list of names
    leaves all unmatched; repeated values come once.
    """
    # Small tables come in few partitions; they are spread, as their texts are taken apart.
    cores = values.sparkSession.sparkContext.defaultParallelism
    values = cut(values.select("value").filter("value <> ''").distinct().repartition(max(cores, values.count() // 1_000_000), "value"))
    owner = F.min_by(F.struct("entry", "rank", "symbol"), F.struct(~F.col("approved"), F.col("rank"), F.col("entry"))).alias("o")
    owners = cut(names.groupBy("name").agg(owner, F.array_sort(F.collect_list(F.struct("rank", "entry", "symbol"))).alias("claims")).repartition(min(cores, 64), "name"))
    n_names = owners.count()
    postings = owners.select("name", _digits(F.col("name")).alias("digits"), F.explode(F.concat(_vector(F.col("name")), F.array(_whole(F.col("name"))))).alias("gram"))
    df = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    weight2 = F.pow(F.log(F.lit(1.0 + n_names) / F.col("df")), 2)
    postings = cut(postings.join(df.select("gram", weight2.alias("w2")), "gram").select("gram", "name", "digits", "w2"))
    # Bytes of the widest side that is broadcast below: postings, or names with their claims.
    wide = postings.agg(F.sum(F.octet_length("gram") + F.octet_length("name") + 48)).first()[0] or 0
    small = max(wide, owners.agg(F.sum(F.octet_length("name") + F.size("claims") * 96 + 96)).first()[0] or 0) <= BROADCAST_INDEX
    near = F.broadcast if small else (lambda x: x)

    # Probes with the weight of their grams; a gram that no name has weighs most and finds nothing. A text that is
    # indexed whole has found its name with cosine 1 and probes no further.
    core = without_kind_words(F.col("value"))
    pair = F.struct(F.col("value").alias("text"), F.lit(True).alias("whole")), F.struct(core.alias("text"), (core == F.col("value")).alias("whole"))
    texts = values.select("value", F.explode(F.array_distinct(F.array(*pair))).alias("t")).select("value", "t.text", "t.whole").filter("text <> ''")
    weights = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("df"), F.first("w2").alias("w2"))
    most = math.log(1.0 + max(n_names, 1)) ** 2
    grams = texts.select("value", "text", "whole", F.explode(F.concat(_vector(F.col("text")), F.array(_whole(F.col("text"))))).alias("gram")).join(near(weights), "gram", "left")
    is_whole = F.col("gram").startswith("=")
    probes = grams.groupBy("value", "text", "whole").agg(
        F.slice(F.array_sort(F.collect_list(F.when(~F.col("gram").rlike("^[#=]"), F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")))), 1, PROBES).alias("rare"),
        F.max(F.when(is_whole & F.col("df").isNotNull(), F.col("gram"))).alias("known"),
        F.sum(F.when(~is_whole, F.coalesce("w2", F.lit(most)))).alias("norm2"),
        F.array_sort(F.collect_list(F.when(~is_whole & F.col("w2").isNotNull(), F.struct("gram", "w2")))).alias("vec"),
    )
    sought = F.when(F.col("whole"), F.array(_sorted_letters(F.col("text")))).otherwise(F.array().cast("array<string>"))
    sought = F.concat(F.transform(F.filter("rare", lambda g: g["df"] > 0), lambda g: g["gram"]), sought)
    sought = F.when(F.col("known").isNotNull(), F.array("known")).otherwise(sought)
    probes = probes.select("value", "text", "whole", "norm2", "vec", _digits(F.col("text")).alias("text_digits"), F.explode(sought).alias("gram"))
    listed = postings.select("gram", "name", "digits")
    found = probes.join(F.broadcast(listed), "gram") if small else _meet(cut(probes), listed)
    text, name = F.col("text"), F.col("name")
    close = F.col("whole") & (F.abs(F.length(text) - F.length(name)) <= 1) & (F.col("text_digits") == F.col("digits"))
    # Written, so that neither scores nor checks are pushed down to every posting.
    found = cut(found.filter(close | text.startswith(name) | text.endswith(name)).select("value", "text", "whole", "norm2", "vec", "name").distinct())

    # Score: the weights of the text's grams that the name has too, over both lengths.
    vectors = postings.filter(~F.col("gram").startswith("=")).groupBy("name").agg(F.sum("w2").alias("n2")).join(owners, "name")
    shared = F.filter("vec", lambda g: F.array_contains(_vector(name), g["gram"]))
    common = F.aggregate(shared, F.lit(0.0), lambda a, g: a + g["w2"])
    cand = found.join(near(vectors), "name").withColumn("score", common / F.sqrt(F.col("norm2") * F.col("n2")))
    cand = cut(cand.select("value", "text", "whole", "name", "score", "o", "claims")).filter(F.col("score") >= threshold)

    # Exact check: which rule accepts the candidate.
    rests = [(text.startswith(name), F.expr("substring(text, length(name) + 1)")), (text.endswith(name), F.expr("substring(text, 1, length(text) - length(name))"))]
    rest = F.array_distinct(F.filter(F.array(*[F.when(hit, r).otherwise(F.lit("")) for hit, r in rests]), lambda r: r != ""))
    one = cand.select(
        "value", "score", "o",
        F.when((text == name) & (text == F.col("value")), 0).when(text == name, 1).when(F.col("whole") & (text == F.col("value")) & _one_edit(text, name), 3).alias("tier"),
    ).filter("tier is not null")
    two = cand.filter(text != name).select("value", "score", "claims", F.explode(rest).alias("rest"))
    other = owners.select(F.col("name").alias("rest"), F.col("claims").alias("also"))
    two = two.join(near(other), "rest").withColumn("both", F.filter("claims", lambda c: F.exists("also", lambda d: d["entry"] == c["entry"]))).filter("size(both) > 0")
    best = F.expr("both[0]")
    two = two.select("value", "score", F.struct(best["entry"].alias("entry"), best["rank"].alias("rank"), best["symbol"].alias("symbol")).alias("o"), F.lit(2).alias("tier"))
    checked = one.unionByName(two)
    per_entry = checked.groupBy("value", "tier", "o").agg(F.max("score").alias("score"))
    per_tier = per_entry.groupBy("value", "tier").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "o"))).alias("by"), F.min(F.struct(F.col("o.rank"), F.col("o.entry"), F.col("o.symbol"))).alias("low"))
    first = per_tier.groupBy("value").agg(F.min_by(F.struct("tier", "by", "low"), "tier").alias("m"))
    lead = F.when(F.size("m.by") > 1, F.expr("m.by[1].s - m.by[0].s")).otherwise(F.lit(1.0))
    ok = (F.col("m.tier") < 3) | (lead >= margin)
    entry = F.when(F.col("m.tier") == 3, F.expr("m.by[0].o.entry")).otherwise(F.col("m.low.entry"))
    symbol = F.when(F.col("m.tier") == 3, F.expr("m.by[0].o.symbol")).otherwise(F.col("m.low.symbol"))
    how = F.element_at(F.array(F.lit("exact"), F.lit("core"), F.lit("pair"), F.lit("edit")), F.col("m.tier") + 1)
    rivals = F.when(~ok, F.transform("m.by", lambda b: b["o"]["entry"]))
    given = lambda c, name: F.when(ok, c).alias(name)
    chosen = first.select("value", given(symbol, "symbol"), given(entry, "entry"), given(how, "how"), F.expr("-m.by[0].s").alias("score"), rivals.alias("rivals"))
    out = values.join(chosen, "value", "left")
    return out.select("value", F.coalesce("symbol", F.lit("")).alias("symbol"), "entry", F.coalesce("how", F.lit("none")).alias("how"), "score", "rivals")
