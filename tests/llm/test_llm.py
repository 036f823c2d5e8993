"""Operators tagged llm: small cases, brute force, exact round trips, SQL."""

import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import oracle
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bipartia.llm import canonical, formatdups, leaks, moderation, queries, splits, tokens


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    oracle.compare(spark, sf, queries.QUERIES[name], queries.SQL[name])


# --- canonical -----------------------------------------------------------------------------------------------------
GENES = [("H:1", "VIRE", "lnc-VU2|Old One", None), ("H:2", "TEKO12", '"SAME"|', "PREV7"), ("H:3", "MABU", "SAME", ""), ("H:4", "MABO", None, None), ("H:10", "AB", " | ", None)]


def mapped(spark, values, genes=GENES, **kw):
    g = spark.createDataFrame(genes, "id string, symbol string, alias string, prev string")
    names = canonical.reference_names(g, "id", "symbol", ["alias", "prev"])
    v = spark.createDataFrame([(x, 1) for x in values], "value string, extra int")
    return {r["value"]: (r["symbol"], r["how"]) for r in canonical.map_to_canonical(v, names, **kw).collect()}


def test_values_that_fold_to_nothing_are_unmatched(spark, tmp_path):
    symbols = ["-", " - ", "?", "", "  ", "\u200b", None, "lnc-VU2", "nowhere"]
    spark.createDataFrame(list(enumerate(symbols)), "rec_id bigint, rna_symbol string").write.parquet(str(tmp_path / "rnadisease.parquet"))
    spark.createDataFrame(GENES, "hgnc_id string, symbol string, alias_symbol string, prev_symbol string").write.parquet(str(tmp_path / "hgnc_complete_set.parquet"))
    got = {r["value"]: r["n_rows"] for r in queries.p1_unmatched(spark, str(tmp_path)).collect()}
    assert got == {"": 3, "NOWHERE": 1}
    found = {r["rec_id"] for r in queries.p1_found(spark, str(tmp_path)).filter("symbol = ''").collect()}
    assert found == {0, 1, 2, 8}


def test_canonical_rules(spark):
    got = mapped(spark, ["VIRE", "VIRE", "OLDONE", "SAME", "LNCRNAVIRE", "VIREHUMAN", "VIREALIASLNCVU2", "TEKO12SAME", "VRIE", "VIR", "VIREE", "VITE", "TEKO13", "TEK12", "MABE", "BA", "NOTHING", "", None])
    assert got["VIRE"] == ("VIRE", "exact") and got["OLDONE"] == ("VIRE", "exact")
    assert got["SAME"] == ("TEKO12", "exact")  # claimed twice: the lowest id
    assert got["LNCRNAVIRE"] == got["VIREHUMAN"] == ("VIRE", "core")
    assert got["VIREALIASLNCVU2"] == ("VIRE", "pair") and got["TEKO12SAME"] == ("TEKO12", "pair")
    assert {got[x] for x in ("VRIE", "VIR", "VIREE", "VITE")} == {("VIRE", "edit")}
    assert got["TEKO13"] == ("", "none")  # digits never differ
    assert got["TEK12"] == ("TEKO12", "edit")
    assert got["MABE"] == ("", "none")  # one letter from two entries
    assert got["BA"] == ("AB", "edit") and got["NOTHING"] == ("", "none")
    assert "" not in got and None not in got


def test_canonical_rivals(spark):
    g = spark.createDataFrame(GENES, "id string, symbol string, alias string, prev string")
    out = canonical.map_to_canonical(spark.createDataFrame([("MABE",), ("MABU",)], "value string"), canonical.reference_names(g, "id", "symbol", ["alias", "prev"]))
    assert {r["value"]: sorted(r["rivals"] or []) for r in out.collect()} == {"MABE": ["H:3", "H:4"], "MABU": []}


def test_canonical_empty_tables(spark):
    assert mapped(spark, []) == {}
    assert mapped(spark, ["X"], genes=[]) == {"X": ("", "none")}


def test_canonical_edits_against_brute_force(spark):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("ABCDE12") for _ in range(rng.randint(3, 7))) for _ in range(60)})
    values = sorted({"".join(rng.choice("ABCDE12") for _ in range(rng.randint(3, 7))) for _ in range(150)} - set(names))
    got = mapped(spark, values, [(f"H:{i}", n, None, None) for i, n in enumerate(names)])
    digits = lambda s: "".join(c for c in s if c.isdigit())

    def near(v):
        out = {v[:i] + v[i + 1 :] for i in range(len(v))}
        out |= {v[:i] + c + v[j:] for i in range(len(v) + 1) for j in (i, i + 1) for c in "ABCDE12"}
        return out | {v[:i] + v[i + 1] + v[i] + v[i + 2 :] for i in range(len(v) - 1)}

    for v in values:
        close = [n for n in names if n in near(v) and digits(n) == digits(v)]
        if got[v][1] in ("edit", "none"):
            assert got[v][0] == (close[0] if len(close) == 1 else ""), v


def test_no_candidate_is_pruned(spark):
    """One common gram that three thousand names share is all that Q1 and A1 have in common."""
    names = [f"N{chr(65 + i // 676)}{chr(65 + i // 26 % 26)}{chr(65 + i % 26)}Z1" for i in range(3000)] + ["A1"]
    got = mapped(spark, ["Q1", "NAAAZ1"], [(f"H:{i}", n, None, None) for i, n in enumerate(names)])
    assert got == {"Q1": ("A1", "edit"), "NAAAZ1": ("NAAAZ1", "exact")}


@pytest.mark.parametrize("limit", [None, 0])
def test_edits_in_a_list_of_many_names(spark, monkeypatch, limit):
    """Against all single edits of each value; with the index broadcast and joined by shuffle with salted grams."""
    if limit is not None:
        monkeypatch.setattr(canonical, "BROADCAST_INDEX", limit)
        monkeypatch.setattr(canonical, "SALT", 20)
    rng, letters = random.Random(8), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    size = 100_000 if limit is None else 3000
    names = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) + str(rng.randint(0, 99)) for _ in range(size)})
    known, values = set(names), set()
    for n in rng.sample(names, 800):
        i = rng.randrange(len(n) - 2)
        values.add(rng.choice([n[:i] + n[i + 1 :], n[:i] + rng.choice(letters) + n[i:], n[:i] + n[i + 1] + n[i] + n[i + 2 :], n[:i] + rng.choice(letters) + n[i + 1 :]]))
    values = sorted(values - known)
    got = mapped(spark, values, [(f"H:{i}", n, None, None) for i, n in enumerate(names)])
    digits = lambda s: "".join(c for c in s if c.isdigit())
    for v in values:
        near = {v[:i] + v[i + 1 :] for i in range(len(v))} | {v[:i] + c + v[j:] for i in range(len(v) + 1) for j in (i, i + 1) for c in letters + "0123456789"}
        near |= {v[:i] + v[i + 1] + v[i] + v[i + 2 :] for i in range(len(v) - 1)}
        close = [n for n in near & known if digits(n) == digits(v)]
        if got[v][1] in ("edit", "none"):
            assert got[v][0] == (close[0] if len(close) == 1 else ""), v


# --- splits ----------------------------------------------------------------------------------------------------------
def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(str(rng.randint(0, 300)), str(rng.randint(0, 300))) for _ in range(220)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("s", "s"), ("x", None)]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        if b is not None:
            parent[find(a)] = find(b)
    got = splits.components(spark.createDataFrame(edges, "a string, b string")).collect()
    assert len(got) == len({r["node"] for r in got}) == len(parent)
    mine, want = defaultdict(set), defaultdict(set)
    for r in got:
        mine[r["root"]].add(r["node"])
    for a in parent:
        want[find(a)].add(a)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))
    assert all(root == min(nodes) for root, nodes in mine.items())
    assert splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 40))
def test_closest_subset(sizes, target):
    take = splits.closest_subset(sizes, target)
    assert all(0 <= k <= sizes[s] for s, k in take.items())
    reach = {0}
    for s, k in sizes.items():
        reach = {t + s * i for t in reach for i in range(k + 1)}
    assert abs(sum(s * k for s, k in take.items()) - target) == min(abs(t - target) for t in reach)


def test_closest_subset_beyond_the_bitset():
    sizes = {1: 1000, 7: 50, 100_003: 9, 1_000_000: 2}
    take = splits.closest_subset(sizes, 1_300_123)
    assert sum(s * k for s, k in take.items()) == 1_300_123


@pytest.mark.parametrize("sizes, target, total", [({500_000: 1, 300_000: 2}, 600_000, 600_000), ({400_000: 1, 270_000: 2}, 540_000, 540_000), ({200_000: 1, 150_000: 2, 1_200_000: 2}, 300_000, 300_000)])
def test_largest_first_would_miss_the_total(sizes, target, total):
    assert sum(s * k for s, k in splits.closest_subset(sizes, target).items()) == total


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(100_000, 900_000), st.integers(1, 3), max_size=4), st.integers(262_145, 2_000_000))
def test_closest_subset_of_large_components(sizes, target):
    take = splits.closest_subset(sizes, target)
    assert all(0 <= k <= sizes[s] for s, k in take.items())
    reach = {0}
    for s, k in sizes.items():
        reach = {t + s * i for t in reach for i in range(k + 1)}
    assert abs(sum(s * k for s, k in take.items()) - target) == min(abs(t - target) for t in reach)


def test_components_with_a_hub_beyond_the_broadcast(spark, monkeypatch):
    from bipartia.operators import skew

    monkeypatch.setattr(skew.join_lookup, "__defaults__", ("left", 5))
    edges = [("hub", f"x{i}") for i in range(300)] + [(f"x{i}", f"y{i}") for i in range(0, 300, 7)] + [("b", "c"), ("c", "d")]
    got = splits.components(spark.createDataFrame(edges, "a string, b string")).collect()
    sizes = Counter(r["root"] for r in got)
    assert sorted(sizes.values()) == [3, 344] and sizes["b"] == 3 and sizes["hub"] == 344


def test_grouped_splits(spark):
    rows = [(i, "a", f"k{i % 40}" if i % 9 else None, i) for i in range(400)] + [(i, "b", "hot" if i < 150 else f"z{i}", i) for i in range(400)]
    edges = [("a", "k1", "k2"), ("a", "k2", "elsewhere"), ("a", "elsewhere", "k3")]
    got = splits.grouped_splits(spark.createDataFrame(rows, "id bigint, assignment string, key string, split int"), spark.createDataFrame(edges, "assignment string, a string, b string"), "id").collect()
    assert len(got) == 800
    split = {(r["assignment"], r["id"]): r["split"] for r in got}
    by = defaultdict(set)
    for i, a, k, _ in rows:
        if k:
            by[a, "k1" if k in ("k2", "k3") else k].add(split[a, i])
    assert all(len(s) == 1 for s in by.values())
    n = Counter((a, s) for (a, _), s in split.items())
    assert {k: v for k, v in n.items() if k[1] != "train"} == {(a, s): 40 for a in "ab" for s in ("test", "validation")}


def test_grouped_splits_empty(spark):
    rows, edges = spark.createDataFrame([], "id bigint, assignment string, key string"), spark.createDataFrame([], "assignment string, a string, b string")
    assert splits.grouped_splits(rows, edges, "id").count() == 0


def test_p2_keeps_entities_together(spark, sf):
    got = queries.p2_splits(spark, sf)
    rows = spark.read.parquet(f"{sf}/rnadisease.parquet").select("rec_id", "rna_symbol", "do_id")
    by = got.join(rows, "rec_id").cache()
    assert got.count() == 2 * rows.count() == by.select("rec_id", "assignment").distinct().count()
    for a, c in (("lncrna", "rna_symbol"), ("disease", "do_id")):
        folded = by.filter(F.col("assignment") == a).groupBy(queries.folded(c).alias("k")).agg(F.countDistinct("split").alias("n"))
        assert folded.filter("k <> '' and n > 1").count() == 0
    unmatched = queries.p1_unmatched(spark, sf).select(F.col("value").alias("v"))
    bare = by.filter("assignment = 'lncrna'").join(unmatched, queries.folded("rna_symbol") == F.col("v")).withColumn("core", canonical.without_kind_words(F.col("v")))
    same = bare.filter("core <> ''").groupBy("core").agg(F.countDistinct("split").alias("n"), F.countDistinct("v").alias("spelt"))
    assert same.filter("n > 1").count() == 0
    share = {(r["assignment"], r["split"]): r["share"] for r in queries.p2_totals(spark, sf).collect()}
    assert all(abs(share[a, s] - w) < 0.005 for a in ("lncrna", "disease") for s, w in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))


# --- hidden duplicates ---------------------------------------------------------------------------------------------
def test_bloom_loses_no_repeat(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 5000), np.full(3000, 77)])
    values = np.concatenate([values, values[:500]])
    df = spark.createDataFrame([(int(v),) for v in values], "h bigint").repartition(7)
    for n_rows in (1, len(values), 3_000_000):
        out = formatdups.possible_repeats(df, n_rows).collect()
        assert len(out) == len(values)
        n = Counter(r["h"] for r in out)
        assert all(r["maybe"] for r in out if n[r["h"]] > 1)
    assert sum(r["maybe"] for r in out) < 4100


def test_bloom_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(formatdups, "ROUND_BYTES", formatdups.SEGMENT_BITS // 8)
    values = [int(x) for x in np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 2000)]
    out = formatdups.possible_repeats(spark.createDataFrame([(v,) for v in values + values[:300]], "h bigint"), 250_000).collect()
    n = Counter(r["h"] for r in out)
    assert len(out) == 2300 and all(r["maybe"] for r in out if n[r["h"]] > 1)


def test_one_bounded_filter_at_a_time(spark, monkeypatch):
    """However many rows, a filter is never larger than ROUND_BYTES, and it is gone before the next one is made."""
    from pyspark import SparkContext

    monkeypatch.setattr(formatdups, "ROUND_BYTES", formatdups.SEGMENT_BITS // 8)
    sent, original = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda sc, value: sent.append(original(sc, value)) or sent[-1])
    values = [int(x) for x in np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 1500)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values + values[:200])], "h bigint, i int").sortWithinPartitions("h")
    for rows, turns in ((60_000, 1), (400_000, 7)):
        sent.clear()
        kept = formatdups.possible_repeats(df, rows, lambda t: t.filter("maybe").select("i"))
        assert len(sent) == turns and {r["i"] for r in kept.collect()} >= {*range(200), *range(1500, 1700)}
        for b in sent:
            with pytest.raises(Exception):
                b._jbroadcast.value()


def test_repeats_and_collapse(spark):
    rows = [("a", 5, "x", 0), ("a", 3, "x", 0), ("a", 9, "y", 0), ("b", 3, "x", 0), ("b", 4, None, 0), ("b", 6, None, 0), ("c", 1, "h", 1), *[("c", i, "h", 1) for i in range(2, 200)]]
    df = spark.createDataFrame(rows, "tab string, id bigint, canon string, keep_id int")
    got = {(r["tab"], r["keep_id"], r["dup_id"]) for r in formatdups.repeats(df).collect()}
    assert got == {("a", 3, 5)} | {("c", 1, i) for i in range(2, 200)}
    groups = sorted((r["tab"], r["keep_id"], r["copies"]) for r in formatdups.collapse(df).collect())
    assert groups == [("a", 3, 2), ("a", 9, 1), ("b", 3, 1), ("b", 4, 1), ("b", 6, 1), ("c", 1, 199)]
    empty = spark.createDataFrame([], df.schema)
    assert formatdups.repeats(empty).count() == formatdups.collapse(empty).count() == 0


def test_forms_in_every_layout(spark):
    forms = ['{"RNA Symbol": "AB-1", "do_id": "DOID:7"}', '{"DO ID":"doid 7","rna_symbol":"ab 1","Species":" "}', "DO-ID: DOID:7; RNA Symbol: AB1", "RNA Symbol=ab1. | DO ID=(DOID:7)", "rna_symbol:  AB1 \r\nDo Id: DOID_7\n"]
    other = ["", None, "   ", "(no content)", "ERROR: empty form", "{broken", "[1]", "{}", '{"a": null}', "x: ; y: -"]
    df = spark.createDataFrame([(f,) for f in forms + other], "p string").select(formatdups.canonical_pairs(F.col("p")).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert len(set(got[:5])) == 1 and got[0] == "DOID=DOID7\u0001RNASYMBOL=AB1"
    assert got[5:] == [None] * 10


# --- tokens ----------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def exact():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokens.WORDS, mergeable_ranks=tokens.SpeculativeBpe.load(tokens.VOCABULARY).ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("abeinstr _'\n0", max_size=80))
def test_tokens_exact(text):
    import tiktoken

    bpe = tokens.SpeculativeBpe.load(tokens.VOCABULARY)
    enc = tiktoken.Encoding("own", pat_str=tokens.WORDS, mergeable_ranks=bpe.ranks, special_tokens={})
    ids = [t for w in bpe.encode([text])[0] for t in w]
    assert ids == enc.encode_ordinary(text)
    assert b"".join(bpe.bytes[i] for i in ids).decode() == text


def test_tokens_of_documents(spark, sf, exact):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.p6_ids(spark, sf).collect()
    assert len(got) == len(docs)
    assert all(list(r["ids"]) == exact.encode_ordinary(docs[r["doc_id"]] or "") for r in got)


def test_tokens_edges(spark, exact):
    texts = [None, "", " ", "<|endoftext|>", "a" * 30_000, "​�é" * 50, "x y" * 20_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: list(r["ids"]) for r in tokens.encode_texts(df, "doc_id", "text").collect()}
    assert got == {i: exact.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert tokens.encode_texts(df.limit(0), "doc_id", "text").count() == 0


# --- leaks -----------------------------------------------------------------------------------------------------------
def brute(text, items, run=12):
    found, out = leaks.words(text), set()
    for i, item in items:
        w = leaks.words(item)
        if not w:
            continue
        grams = {tuple(w[s : s + run]) for s in range(len(w) - run + 1)}
        if any(tuple(found[s : s + run]) in grams for s in range(len(found) - run + 1)):
            out.add(i)
            continue
        need, most = -(-3 * len(w) // 4), 2 * len(w)
        for s in range(len(found)):
            part = found[s : s + most]
            row = [0] * (len(w) + 1)
            for x in part:
                prev = 0
                for j, y in enumerate(w, 1):
                    row[j], prev = (prev + 1 if x == y else max(row[j], row[j - 1])), row[j]
            if row[-1] >= need:
                out.add(i)
                break
    return out


def test_leaks_against_brute_force():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 9, 14, 20])))) for i in range(12)]
    index = leaks.LeakIndex(items)
    for _ in range(150):
        text = [rng.choice(vocab) for _ in range(rng.randint(0, 30))]
        w = items[rng.randrange(12)][1].split()
        kept = [x for x in w if rng.random() > 0.25]
        mixed = [y for x in kept for y in ([x, rng.choice(vocab)] if rng.random() < 0.4 else [x])]
        at = rng.randint(0, len(text))
        text = " ".join(text[:at] + mixed + text[at:])
        assert {h[0] for h in index.find(text)} == brute(text, items), text


def test_leak_offsets_and_edges(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    text = "Before!  " + item.upper().replace(" ", " -- ", 3) + "  after."
    index = leaks.LeakIndex([(1, item), (2, item), (3, ""), (4, "  ")])
    hits = index.find(text)
    assert [h[:2] for h in hits] == [(1, "run"), (2, "run")] and text[hits[0][2] : hits[0][3]].startswith("ALPHA")
    assert index.find(None) == index.find("") == index.find("--") == leaks.LeakIndex([]).find("x") == []
    docs = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "x " * 50_000 + text, 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([(7, item, "s"), (8, None, "s")], "item_id bigint, item_text string, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items).collect()} == {(1, 7), (3, 7)}
    assert leaks.find_leaks(docs, items.limit(0)).count() == leaks.find_leaks(docs.limit(0), items).count() == 0


def test_leak_offsets_where_lower_case_is_longer(spark):
    item = " ".join(f"Wort{i}" for i in range(14))
    text = "\u0130stanbul, \u0130zmir: " + item + " \u0130"
    ((_, kind, begin, end),) = leaks.LeakIndex([(1, item)]).find(text)
    assert kind == "run" and text[begin:end] == " ".join(item.split()[:12])
    ((_, kind, begin, end),) = leaks.LeakIndex([(1, "\u0130stanbul Ankara Bursa")]).find(text.lower() + " and \u0130STANBUL ankara BURSA.")
    assert kind == "part" and (end - begin) == len("\u0130STANBUL ankara BURSA")


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 60)
    items = spark.createDataFrame([(i, f"one{i} two three{i} four five{i} six") for i in range(6)], "item_id bigint, item_text string")
    docs = spark.createDataFrame([(i, f"so one{i} two three{i} x four five{i}") for i in range(6)], "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(docs, items).collect()} == {(i, i) for i in range(6)}


# --- moderation ------------------------------------------------------------------------------------------------------
def test_plain_words():
    assert moderation.plain_word("CRÉTIN") == "cretin" and moderation.plain_word("p47h371c") == "pathetic"
    assert moderation.plain_word("uselllless") == "useles" and moderation.plain_word("idiоt") == "idiot"
    assert moderation.plain_word("12345") == moderation.plain_word("x98765") == "0"
    assert moderation.sentences("g a r b a g e here. Sec​ond!\nthird") == ["garbage here", " Second", "third"]
    assert moderation.sentences(None) == moderation.sentences(" \n ") == []
    s = moderation.Speller({"pathetic": 5, "naked": 4, "moron": 3})
    assert [s(w) for w in ("pa*hetic", "nkaed", "m***n", "patheic", "PATHETIC", "zzz")] == ["pathetic", "naked", "moron", "pathetic", "pathetic", "z"]


def test_gradient_of_the_machine():
    """The fitted machine separates what only a pair of terms tells: additive weights cannot."""
    rows, yes = [], []
    for a, b, y in ((0, 2, 1), (0, 3, 0), (1, 2, 0), (1, 3, 1)):
        rows += [[a, b]] * 30
        yes += [y] * 30
    yes = np.array(yes, float)
    m = moderation.fit(rows, yes, 1 - yes, epochs=200)
    n = np.full(len(rows), 2)
    p = m.score(np.concatenate(rows), np.cumsum(n) - n, n)
    assert ((p > 0.5) == (yes > 0.5)).all()


@pytest.mark.parametrize("fit_on, held_out, least", [("sf0.1", "check_s", 0.8), ("check_s", "sf0.1", 0.9), ("check_l", "check_s", 0.9), ("check_l", "sf0.1", 0.9)])
def test_held_out_accuracy(spark, sf, monkeypatch, fit_on, held_out, least):
    """The operator, fitted on one set, is held against documents of another that two annotators agree on."""
    root = Path(sf).parent
    if not (root / fit_on).exists() or not (root / held_out).exists():
        pytest.skip("no such tables")
    read = lambda n, t: spark.read.parquet(f"{root}/{n}/{t}.parquet")
    model = moderation.train(read(fit_on, "documents"), read(fit_on, "moderation_labels"))
    monkeypatch.setattr(moderation, "train", lambda *_: model)
    docs, labels = read(held_out, "documents"), read(held_out, "moderation_labels")
    found, said = defaultdict(set), defaultdict(list)
    for r in moderation.score_documents(docs.join(labels.select("doc_id").distinct(), "doc_id"), labels).filter("score >= 0.5").collect():
        found[r["category"]].add(r["doc_id"])
    for r in labels.select("doc_id", F.lower(F.trim("category")).alias("c")).filter("c is not null").collect():
        said[r["doc_id"]].append(r["c"])
    for category in moderation.CATEGORIES:
        agreed = [d in found[category] for d in said if said[d].count(category) > 1]
        wrong = np.mean([d in found[category] for d in said if category not in said[d]])
        assert np.mean(agreed) >= least and wrong < 0.01, (category, np.mean(agreed), wrong)


def test_words_in_tags_are_scored():
    assert moderation.sentences("hello <you are a worthless idiot> bye <b>now</b> a <c") == ["hello ", "you are a worthless idiot", " bye ", "now", " a ", "c"]
    assert moderation.sentences("<" + "xyz " * 300 + ">")[0].split() == ["xyz"] * 300


def test_long_words_are_led_back():
    s = moderation.Speller({"a" * 20 + "bcdef": 5})
    assert s("A" * 45) == "a" and s("abcd*f" * 9) == "abcdf" * 9


def test_gradient_against_differences():
    rng = np.random.default_rng(3)
    m = moderation.Machine(2)
    p = m.p
    p[: moderation.BUCKETS] = rng.normal(0, 1, p[: moderation.BUCKETS].shape)
    yes, no = np.array([[2.0, 0.5], [1.0, 0.0], [0.0, 1.0]]), np.array([[1.0, 3.0], [0.5, 2.0], [1.0, 1.0]])
    want = None
    for block in (1, 2, 10):
        s = moderation.Sentences(np.array([1, 2, 3, 2, 9, 4]), np.array([3, 2, 1]), block)

        def loss(q):
            z = moderation.probabilities(q, s)
            return -(yes * np.log(z) + no * np.log(1 - z)).sum()

        g = moderation.gradient(p, s, yes, no)
        assert want is None or np.allclose(g, want)
        want = g
        for place in ((moderation._W0, 0, 0), (2, 0, 0), (9, 1, 0), (3, 0, 2), (2, 1, 6), (4, 1, 3)):
            q = p.copy()
            q[place] += 1e-5
            assert abs((loss(q) - loss(p)) / 1e-5 - g[place]) < 1e-3
        assert not g[5].any() and not g[moderation._NO_TERM].any()


def test_terms_of_sentences():
    words = np.array([3, 5, 7, 5, 3, 5], np.uint64)
    h, many, single = moderation.terms(words, np.array([3, 1, 2]))
    assert many.tolist() == [5, 1, 3] and single.tolist() == [True, True, True, False, False, True, True, True, False]
    assert h[single].tolist() == words.tolist() and h[3] == h[8] != h[4] and not (h[~single] & np.uint64(1)).any()


def test_rates_with_and_without_a_join(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "moderation_labels"))
    plain = moderation.score_documents(docs, labels)
    with_source = plain.join(docs.select("doc_id", "source"), "doc_id")
    both = [sorted(map(str, moderation.rates(docs, x).drop("rate", "n_found").collect())) for x in (plain, with_source)]
    assert both[0] == both[1]


def test_moderation_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 0), (2, "", "a", 0), (3, "you fool " * 30_000, " a ", 0), (4, "you fool", "b", 0), (5, "fine text here", "", 0)], "doc_id bigint, text string, source string, score int")
    labels = spark.createDataFrame([(1, 4, "Abuse "), (2, 4, "abuze"), (3, 5, "none"), (4, 2, None), (5, 5, "none"), (6, 99, "hate")], "label_id bigint, doc_id bigint, category string")
    got = moderation.score_documents(docs, labels)
    rows = {(r["doc_id"], r["category"]): r["score"] for r in got.collect()}
    assert len(rows) == 15 and rows[1, "abuse"] == rows[2, "abuse"] == 0 and rows[4, "abuse"] > rows[5, "abuse"] and rows[4, "hate"] == 0
    rates = {(r["source"], r["category"]): r["n_docs"] for r in moderation.rates(docs, got).collect()}
    assert rates == {(s, c): n for s, n in ((None, 2), ("a", 2), ("b", 1)) for c in moderation.CATEGORIES}
    assert moderation.score_documents(docs, labels.limit(0)).filter("score > 0").count() == 0
    assert moderation.score_documents(docs.limit(0), labels).count() == 0
