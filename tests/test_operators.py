"""Properties of the core operators on small cases."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bipartia.functions import text as T
from bipartia.functions import vectors as V
from bipartia.operators import metrics, orphans, prep, scoring, similarity, skew, split
from bipartia.sources import formats

DAY = dt.datetime(2020, 1, 1)


# --- text and keys ---------------------------------------------------------------------------------------------------
def test_folding(spark):
    cases = [("DOID: 12", "DOID12", False), ("a​b-ß", "ABSS", False), (None, "", True), ("  ​", "", True), ("--", "", False), ("é", "É", False)]
    got = spark.createDataFrame([(c[0],) for c in cases], "x string").select(T.folded("x"), T.is_blank("x")).collect()
    assert [tuple(g) for g in got] == [c[1:] for c in cases]
    bag = spark.createDataFrame([("b A, a",), (None,), ("--",)], "x string").select(T.word_bag("x")).collect()
    assert [b[0] for b in bag] == ["A A B", "", ""]


# --- skew ------------------------------------------------------------------------------------------------------------
def test_numbering_is_exact(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{rng.randint(0, 20)}", rng.randint(0, 50), i) for i in range(5000)] + [(None, 1, 5000), (None, 0, 5001)]
    out = skew.number_within_key(spark.createDataFrame(rows, "key string, o int, i int"), ["key"], ["o", "i"]).collect()
    want = defaultdict(list)
    for k, o, i in sorted(rows, key=lambda r: (r[1], r[2])):
        want[k].append(i)
    assert len(out) == len(rows) and all(want[r["key"]][r["_seq"]] == r["i"] for r in out)
    assert skew.number_within_key(spark.createDataFrame([], "key string, o int"), ["key"], ["o"]).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_profile_against_plain_grouping(spark, chunk):
    rng = random.Random(5)
    rows = [("f", "hot" if i % 2 else rng.choice(["a", "b", "", None]), rng.choice(["x", "y", "z", "", None]), DAY + dt.timedelta(days=rng.randint(0, 99)) if i % 10 else None, i, "clash") for i in range(3000)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "field string, key string, partner string, at timestamp, tie int, n string").repartition(5)
    got = {r["key"]: (r["n_rows"], r["n_partners"], r["first_at"], r["last_at"]) for r in skew.per_key_profile(df, "field", "key", "partner", "at", "tie", chunk).collect()}
    want = defaultdict(list)
    for _, k, p, at, _, _ in rows:
        if k:
            want[k].append((p, at))
    assert got == {k: (len(v), len({p for p, _ in v if p}), min(a for _, a in v if a), max(a for _, a in v if a)) for k, v in want.items()}
    assert skew.per_key_profile(df.limit(0), "field", "key", "partner", "at", "tie").count() == 0


def test_join_hot_equals_plain_join(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(100)] + [(None, -1)], "k string, i int")
    lookup = spark.createDataFrame([("hot", "H")] + [(f"k{i}", str(i)) for i in range(0, 100, 2)], "k string, v string")
    counts = rows.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = skew.hot_keys(counts, "k", "n", 1001, share=10)
    assert [r[0] for r in hot.collect()] == ["hot"]
    for how, n in (("left", 1001), ("inner", 950)):
        got, want = skew.join_hot(rows, lookup, "k", hot, how), rows.join(lookup, "k", how)
        assert got.count() == n and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        assert skew.join_lookup(rows, lookup, "k", counts, "n", how, max_rows=1).count() == n == skew.join_lookup(rows, lookup, "k", counts, "n", how).count()


# --- orphans ---------------------------------------------------------------------------------------------------------
def test_orphans_in_time(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    child = spark.createDataFrame([(1, "A-1", d(5)), (2, "a1", d(0)), (3, "B", d(9)), (4, "none", d(1)), (5, " ", d(1)), (6, None, d(1)), (7, "A1", None), (8, "a_1", d(10)), (9, "alt", d(1))], "id bigint, ref string, at timestamp")
    kids = orphans.child_references(child, "t.ref", "p", "ref", "id", "at")
    parent = spark.createDataFrame([(["A1", "ALT"], d(1), d(10)), (["B"], d(0), None), ([""], d(0), None)], "keys array<string>, begins timestamp, ends timestamp")
    got = {(r["row_id"], r["missing"]) for r in orphans.orphan_references(kids, orphans.parents_valid(parent, "p", F.col("keys"), "begins", "ends")).collect()}
    assert got == {(2, "not_then"), (4, "never"), (7, "not_then"), (8, "not_then")}
    none = orphans.orphan_references(kids, orphans.parents_valid(parent.limit(0), "p", F.col("keys"), "begins", "ends"))
    assert none.count() == 7 and orphans.orphan_references(kids.limit(0), orphans.parents_valid(parent, "p", F.col("keys"), "begins", "ends")).count() == 0
    assert sum(r["n_orphans"] for r in orphans.orphan_report(none).collect()) == 7


def test_newest_version_decides(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    versions = spark.createDataFrame([("u1", d(0), "ACG"), ("u1", d(5), " "), ("u1", d(8), None), ("u1", d(9), "A"), ("u1", d(9), "")], "urs string, at timestamp, seq string")
    parents = orphans.parents_newest(versions, "s", T.folded("urs"), "at", ~T.is_blank("seq"))
    child = spark.createDataFrame([(i, "U1", d(t)) for i, t in enumerate((-1, 0, 4, 5, 8, 9, 20))], "id bigint, urs string, at timestamp")
    got = orphans.orphan_references(orphans.child_references(child, "t.urs", "s", "urs", "id", "at"), parents)
    assert sorted(r["row_id"] for r in got.collect()) == [0, 3, 4]


# --- preparation -----------------------------------------------------------------------------------------------------
def pairs(spark, text):
    return spark.createDataFrame([tuple(p) for p in text.split()], "l string, d string")


def test_kcore(spark):
    got = prep.kcore(pairs(spark, "ax ay bx by cy"), 2, 2)
    assert {tuple(r) for r in got.collect()} == {("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")}
    assert prep.kcore(got, 2, 2).count() == 4 and prep.kcore(pairs(spark, "ax"), 2, 2).count() == 0


def test_closure_and_similarity(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "c"), ("c", "a")][:4], "child string, parent string")
    dist = {(r["term"], r["anc"]): r["dist"] for r in prep.closure(tree).collect()}
    assert dist["a", "c"] == 1 and dist["a", "a"] == 0 and dist["a", "b"] == 1
    siblings = prep.closure(spark.createDataFrame([("a", "r"), ("b", "r")], "child string, parent string"))
    sim = {(r["a"], r["b"]): r["sim"] for r in prep.wang_similarity(siblings, F.lit(True)).collect()}
    assert sim["a", "b"] == pytest.approx(1 / 3) and sim["a", "a"] == 1 and sim["b", "a"] == sim["a", "b"]
    loop = prep.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"))
    assert loop.count() == 4


def test_sequences(spark):
    raw = spark.createDataFrame([("n", "U-1", "acgt", DAY), ("n", "u1", "ACGTX ", DAY + dt.timedelta(1)), ("n", "u2", " ", DAY), ("n", None, "A", DAY)], "name string, urs string, seq string, fetched_at timestamp")
    seqs = prep.clean_sequences(raw)
    assert [(r["urs"], r["seq"]) for r in seqs.collect()] == [("U1", "ACGUN")]
    spectrum = {r["kmer"]: r["freq"] for r in prep.kmer_spectrum(seqs, 3).collect()}
    assert spectrum == {"ACG": 0.5, "CGU": 0.5}
    assert [r["part"] for r in prep.windows(seqs, 2).orderBy("win").collect()] == ["AC", "GU", "N"]


# --- similarity, splits, metrics -------------------------------------------------------------------------------------
def test_gip_kernel(spark):
    w = {(r["a"], r["b"]): r["w"] for r in similarity.gip(pairs(spark, "ax ay bx"), F.lit(True)).collect()}
    assert w["a", "a"] == 1 and w["a", "b"] == w["b", "a"] == pytest.approx(2.718281828 ** (-2 / 3))


def test_gip_kernel_has_pairs_that_share_nothing(spark, monkeypatch):
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 2)
    monkeypatch.setattr(similarity, "PAIR_BLOCK", 3)
    monkeypatch.setattr(similarity, "MAX_COLUMNS", 2)
    rng = np.random.default_rng(3)
    names = [f"l{i}" for i in range(9)]
    ds = {x: set(rng.choice(list("uvwxyz"), size=1 + i % 3, replace=False)) for i, x in enumerate(names)}
    vec = {x: [float(v) for v in rng.normal(size=4)] for x in names[1:]}
    p = spark.createDataFrame([(x, str(d)) for x in names for d in ds[x]], "l string, d string")
    content = spark.createDataFrame(list(vec.items()), "node string, vec array<double>")
    held_out = ["l1", "l4"]
    asked = F.col("l").isin("l0", "l1", "l2", "l3", "l5")
    got = {(r["a"], r["b"]): r for r in similarity.gip(p, asked, content, ~F.col("l").isin(held_out)).collect()}
    assert set(got) == {(a, b) for a in ("l0", "l1", "l2", "l3", "l5") for b in names}
    assert any(r["n"] == 0 for r in got.values())
    train = [x for x in names if x not in held_out]
    gamma = len(train) / (sum(len(ds[x]) for x in train) + 1e-8)
    for (a, b), r in got.items():
        u, v = (np.array(vec.get(x, [0.0] * 4)) for x in (a, b))
        assert r["n"] == len(ds[a] & ds[b])
        assert r["cos"] == pytest.approx(u @ v / ((np.linalg.norm(u) + 1e-8) * (np.linalg.norm(v) + 1e-8)), abs=1e-8)
        assert r["w"] == (None if a in held_out or b in held_out else pytest.approx(np.exp(-gamma * len(ds[a] ^ ds[b]))))


def test_spectral_radius_and_propagation(spark):
    p = pairs(spark, "ax ay bx by cx")
    m = np.array([[1, 1], [1, 1], [1, 0]])
    assert similarity.spectral_radius(p, 12).first()["rho"] == pytest.approx(np.linalg.svd(m)[1][0], abs=1e-6)
    assert similarity.spectral_radius(p.limit(0), 3).first()["rho"] is None
    graph = spark.createDataFrame([("x", "y", 0.5), ("y", "x", 0.5), ("x", "x", 0.5)], "i string, j string, w double")
    seeds = spark.createDataFrame([("q", "x", 1.0)], "q string, node string, w double")
    got = {r["node"]: r["w"] for r in similarity.propagate(graph, seeds, 0.5, 2).collect()}
    adjacency, start = np.array([[0.5, 0.5], [0.5, 0.0]]), np.array([1.0, 0.0])
    want = 0.5 * adjacency @ (0.5 * adjacency @ start + 0.5 * start) + 0.5 * start
    assert got == pytest.approx({"x": want[0], "y": want[1]})


def test_inductive_ridge_against_kronecker(spark):
    from bipartia.operators import learned

    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(6, 3)), rng.normal(size=(5, 3))
    unit = lambda v: v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-8)
    m = (rng.random((6, 5)) < 0.5).astype(float)
    m[:, 0] = m[0, :] = 1
    vec = lambda v, p: spark.createDataFrame([(f"{p}{i}", [float(y) for y in x]) for i, x in enumerate(v)], "node string, vec array<double>")
    train = spark.createDataFrame([(1, f"l{i}", f"d{j}") for i, j in zip(*m.nonzero())], "fold bigint, l string, d string").repartition(3)
    asked = spark.createDataFrame([(1, f"l{i}", f"d{j}") for i in range(6) for j in range(5)] + [(1, "gone", "d0"), (2, "l0", "d0")], "fold bigint, l string, d string")
    x = np.kron(unit(a), unit(b))
    w = np.linalg.solve(x.T @ x + np.eye(9), x.T @ m.ravel())
    got = {(r["fold"], r["l"], r["d"]): r["score"] for r in learned.inductive_ridge(train, asked, vec(a, "l"), vec(b, "d")).collect()}
    assert len(got) == 32 and got[1, "gone", "d0"] == got[2, "l0", "d0"] == 0
    want = (x @ w).reshape(6, 5)
    assert all(got[1, f"l{i}", f"d{j}"] == pytest.approx(want[i, j], abs=1e-6) for i in range(6) for j in range(5))


def test_top_cosine_in_blocks(spark, monkeypatch):
    rng = random.Random(0)
    df = spark.createDataFrame([(f"n{i:02}", [rng.uniform(-1, 1) for _ in range(4)]) for i in range(40)] + [("zero", [0.0] * 4)], "node string, vec array<double>")
    whole = sorted(map(str, similarity.top_cosine(df, df, 5, []).collect()))
    monkeypatch.setattr(similarity, "QUERY_BLOCK", 7)
    monkeypatch.setattr(similarity, "CORPUS_BLOCK", 11)
    assert sorted(map(str, similarity.top_cosine(df, df, 5, []).collect())) == whole
    assert similarity.top_cosine(df.limit(0), df, 5, []).count() == 0


def test_folds(spark):
    df = spark.createDataFrame([(f"n{i}",) for i in range(17)], "l string")
    sizes = sorted(r["count"] for r in split.folds(df, ["l"], "t").groupBy("fold").count().collect())
    assert sizes == [3, 3, 3, 4, 4]
    assert sorted(r["count"] for r in split.folds(df.limit(3), ["l"], "t").groupBy("fold").count().collect()) == [1, 1, 1]


def test_every_positive_gets_its_negative(spark):
    ds = [f"d{i}" for i in range(8)]
    have = {"hub": ds[:7], "a": ds[:2], "b": ds[2:3], "c": ds[7:], "all": ds}
    known = spark.createDataFrame([(l, d) for l in have for d in have[l]], "l string, d string")
    degree = known.groupBy("d").agg(F.count(F.lit(1)).alias("deg"))
    for got in (split.matched_negatives(known, known, degree), split.edge_negatives(known, known)):
        rows = [(r["l"], r["d"], r["neg_d"]) for r in got.collect()]
        # Only an l that is known with every d has no negative.
        assert sorted(r[:2] for r in rows) == sorted((l, d) for l in have if l != "all" for d in have[l])
        assert all(n in ds and n not in have[l] for l, _, n in rows)


def test_cold_blocks_share_no_node(spark):
    rng = random.Random(1)
    p = spark.createDataFrame(sorted({(f"l{rng.randint(0, 30)}", f"d{rng.randint(0, 12)}") for _ in range(200)}), "l string, d string")
    fl, fd = split.folds(p.select("l").distinct(), ["l"], "l"), split.folds(p.select("d").distinct(), ["d"], "d")
    train, test = split.scenario(p, fl, fd, "both")
    for axis in "ld":
        assert train.select("fold", axis).join(test.select("fold", axis), ["fold", axis]).count() == 0
    neg = split.negatives(test, p)
    assert neg.join(p, ["l", "d"]).count() == 0 and neg.distinct().count() == neg.count()
    # Scores depend on training pairs only: pairs outside the block may be scrambled.
    vec = lambda a: p.select(F.col(a).alias("node")).distinct().select("node", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: V.uniform("node", i.cast("string"))).alias("vec"))
    for name in ("popularity", "knn_content"):
        out = scoring.SCORERS[name](train, test, vec("l"), vec("d"))
        assert out.count() == test.count() and out.filter("score is null or isnan(score)").count() == 0


@pytest.mark.parametrize(("rows", "ap", "auroc"), [([(0, 1)] * 3 + [(0, 0)] * 3, 0.5, 0.5), ([(2, 1), (1, 1), (0, 0), (0, 0)], 1, 1), ([(2, 1), (1, 1), (1, 0), (0, 0)], 5 / 6, 7 / 8), ([(1, 0)], None, None)])
def test_metrics(spark, rows, ap, auroc):
    df = spark.createDataFrame([(1, float(s), y) for s, y in rows], "g int, score double, label int")
    r = metrics.average_precision(df, ["g"]).first()
    assert (r["ap"], r["auroc"]) == ((None, None) if ap is None else (pytest.approx(ap), pytest.approx(auroc)))
    if ap is not None:
        assert metrics.mann_whitney(df, ["g"]).first()["auc"] == pytest.approx(auroc)


def test_hypergeometric_tail(spark):
    assert spark.range(1).select(metrics.hypergeom_tail(F.lit(1), F.lit(10), F.lit(5), F.lit(2))).first()[0] == pytest.approx(7 / 9)


def test_results_do_not_depend_on_partitions(spark):
    p = spark.createDataFrame([(f"l{i % 13}", f"d{i % 7}") for i in range(91)], "l string, d string")
    got = []
    for n in ("1", "4", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(str, split.folds(p, ["l", "d"], "x").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1] == got[2]


# --- formats ---------------------------------------------------------------------------------------------------------
def test_obo(spark, tmp_path):
    (tmp_path / "o.obo").write_text('format-version: 1.2\n\n[Term]\nid: D:1\nname: one\ndef: "a \\"b\\" c" [x]\nsynonym: "s1" EXACT []\nsynonym: "s2" RELATED []\nalt_id: D:9\nis_a: D:2 ! two\n\n[Term]\nid: D:2\nname: two\n\n[Typedef]\nid: part_of\n')
    got = [r.asDict() for r in formats.read_obo(spark, str(tmp_path / "o.obo")).orderBy("id").collect()]
    assert got == [{"id": "D:1", "name": "one", "def": 'a \\"b\\" c', "synonym": ["s1", "s2"], "alt_id": ["D:9"], "is_a": ["D:2"]}, {"id": "D:2", "name": "two", "def": None, "synonym": [], "alt_id": [], "is_a": []}]


def test_gct_and_tables(spark, tmp_path):
    (tmp_path / "x.gct").write_text("#1.2\n2\t2\nName\tDescription\tliver\tskin\nE1.5\tAB\t1.5\tx\nE2\tCD\t0\t2\n")
    got = {r["name"]: (r["symbol"], r["tissues"]) for r in formats.read_gct(spark, str(tmp_path / "x.gct")).collect()}
    assert got == {"E1": ("AB", {"liver": 1.5, "skin": None}), "E2": ("CD", {"liver": 0.0, "skin": 2.0})}
    (tmp_path / "x.tsv").write_text('a\tb\n1\t"q\n\tz\n')
    assert sorted(map(tuple, formats.read_tsv(spark, str(tmp_path / "x.tsv")).collect())) == [("", "z"), ("1", '"q')]
    assert formats.read_tsv(spark, str(tmp_path / "x.tsv"), ["p", "q"]).count() == 3
    (tmp_path / "n.txt").write_text("a\n\n b\n")
    assert formats.read_lines(spark, str(tmp_path / "n.txt")).count() == 2


def test_results_skip_unreadable(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"model": "m", "v": 1.5}')
    (tmp_path / "b.json").write_text('{"model": ')
    assert [(r["model"], r["file"]) for r in formats.read_results(spark, str(tmp_path), "model string, v double").collect()] == [("m", "a.json")]


# --- index, running sums, complete negatives ---------------------------------------------------------------------------
def test_index_recall_against_brute_force(spark, sf, monkeypatch):
    """63 lists of about 32 vectors; vectors that do not cluster, and vectors in clusters, for which few lists are enough."""
    from pathlib import Path

    monkeypatch.setattr(similarity, "LIST_SIZE", 32)
    e = spark.read.parquet(f"{Path(sf).parent}/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("string").alias("node"), V.as_double(F.col("embedding")).alias("vec"), F.lit(1).alias("g"))
    queries = e.filter("node % 10 = 0")
    near = lambda f: {(r["q"], r["node"]) for r in f(queries, e, 10, ["g"]).collect()}
    exact, found = near(similarity.top_cosine), near(similarity.nearest)
    assert len(exact & found) / len(exact) >= 0.9
    rng = np.random.default_rng(5)
    rows = [(str(i), list(map(float, rng.normal(0, 1, 16) * 0.1 + np.eye(16)[i % 16] * 3)), 1) for i in range(1500)]
    e = spark.createDataFrame(rows, "node string, vec array<double>, g int")
    queries = e.filter("node % 10 = 0")
    exact, found = near(similarity.top_cosine), near(similarity.nearest)
    assert len(exact & found) / len(exact) >= 0.9


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 4 else f"k{i % 12}", rng.random(), rng.randint(0, 9), i) for i in range(4000)]
    got = {r["i"]: r["_to_n"] for r in skew.running_sums(spark.createDataFrame(rows, "k string, o double, n bigint, i int").repartition(6), ["k"], ["o"], ["n"]).collect()}
    total = defaultdict(int)
    for k, _, n, i in sorted(rows, key=lambda r: r[1]):
        total[k] += n
        assert got[i] == total[k]


def test_negatives_of_dense_folds(spark):
    """Fold 1 has 9 of 16 cells known, fold 2 all but one, fold 3 all: 7, 1 and 0 negatives."""
    cells = [(f, f"{f}l{i}", f"{f}d{j}") for f, skip in ((1, 7), (2, 1), (3, 0)) for n, (i, j) in enumerate((i, j) for i in range(4) for j in range(4)) if n >= skip]
    pos = spark.createDataFrame(cells, "fold bigint, l string, d string")
    neg = [tuple(r) for r in split.negatives(pos, pos.select("l", "d")).select("fold", "l", "d").collect()]
    known = {c[1:] for c in cells}
    assert len(neg) == len(set(neg)) and not {n[1:] for n in neg} & known
    pools = {f: ({c[1] for c in cells if c[0] == f}, {c[2] for c in cells if c[0] == f}) for f in (1, 2, 3)}
    want = {f: min(sum(c[0] == f for c in cells), len(a) * len(b) - sum(c[0] == f for c in cells)) for f, (a, b) in pools.items()}
    assert {f: sum(n[0] == f for n in neg) for f in (1, 2, 3)} == want


def test_p_values(spark):
    import math

    df = spark.createDataFrame([(0.5, 4), (-2.776, 4), (12.706, 1), (2.228, 10), (3.182, 3)], "t double, n int")
    p = [r[0] for r in df.select(metrics.t_two_sided(F.col("t"), F.col("n"))).collect()]
    assert p[1:] == pytest.approx([0.05] * 4, abs=1e-4) and p[0] == pytest.approx(0.6433, abs=1e-4)
    e = [r[0] for r in spark.createDataFrame([(0.0,), (0.3,), (1.4,), (3.0,)], "x double").select(metrics.erfc(F.col("x"))).collect()]
    assert e == pytest.approx([math.erfc(x) for x in (0.0, 0.3, 1.4, 3.0)], abs=2e-7)
    rows = [(k, n, g, m) for n, g, m in ((50, 10, 7), (3000, 900, 100), (30, 30, 5), (30, 3, 30)) for k in range(0, min(g, m) + 1, 3)]
    exact = lambda k, n, g, m: sum(math.comb(g, i) * math.comb(n - g, m - i) for i in range(k, min(g, m) + 1)) / math.comb(n, m)
    got = [r[0] for r in spark.createDataFrame(rows, "k int, n int, g int, m int").select(metrics.hypergeom_tail("k", "n", "g", "m")).collect()]
    assert got == pytest.approx([exact(*x) for x in rows], abs=1e-9)


def test_orphan_counts_equal_the_report_of_rows(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot", "hot", "a", "b", "none", "-", None]), DAY + dt.timedelta(hours=rng.randint(0, 24 * 400)) if i % 50 else None, rng.choice("xy")) for i in range(4000)]
    child = spark.createDataFrame(rows, "id bigint, ref string, at timestamp, key string")
    kids = orphans.child_references(child.filter("key = 'x'"), "t.ref", "p", "ref", "id", "at").unionByName(orphans.child_references(child.filter("key = 'y'"), "u.ref", "p", "ref", "id", "at"))
    d = lambda n: DAY + dt.timedelta(days=n)
    periods = [(["HOT"], d(10), d(75)), (["HOT"], d(75), d(160)), (["HOT"], d(300), None), (["A"], d(-5), None), (["B"], d(500), None)]
    parents = orphans.parents_valid(spark.createDataFrame(periods, "keys array<string>, begins timestamp, ends timestamp"), "p", F.col("keys"), "begins", "ends")
    for some in (parents, parents.limit(0)):
        want = sorted(map(str, orphans.orphan_report(orphans.orphan_references(kids, some)).collect()))
        got = orphans.orphan_counts(kids, some)
        assert sorted(map(str, got.select("tab", "field", "month", "missing", "n_orphans", "first_row_id").collect())) == want and len(want) > 5
    assert orphans.orphan_counts(kids.limit(0), parents).count() == 0


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(5)] + [("k", 9), (None, 1)], "k string, a int")
    right = spark.createDataFrame([("hot", i) for i in range(200)] + [("hot", 1), ("k", 1), ("z", 1), (None, 1)], "k string, b int")
    want = sorted(map(str, left.join(right, "k").select("k", "a", "b").collect()))
    for part in (7, 1000):
        assert sorted(map(str, skew.join_salted(left, right, "k", part).select("k", "a", "b").collect())) == want


def test_kcore_with_joins_of_hot_nodes(spark, monkeypatch):
    rng = random.Random(11)
    pairs = spark.createDataFrame({(f"l{rng.randint(0, 40)}", "hot" if rng.random() < 0.4 else f"d{rng.randint(0, 30)}") for _ in range(300)}, "l string, d string")
    want = sorted(map(tuple, prep.kcore(pairs, 2, 3).collect()))
    monkeypatch.setattr(prep, "SMALL", 0)
    assert sorted(map(tuple, prep.kcore(pairs, 2, 3).collect())) == want and want


def test_gct_of_one_sample_and_of_many_files(spark, tmp_path):
    (tmp_path / "a.gct").write_text("#1.2\n1\t1\nName\tDescription\tliver\nE1.5\tAB\t1.5\n")
    (tmp_path / "b.gct").write_text("#1.2\n1\t2\nName\tDescription\tskin\tlung\nE2\tCD\t2\t3\n\n")
    got = {r["name"]: r["tissues"] for r in formats.read_gct(spark, str(tmp_path)).collect()}
    assert got == {"E1": {"liver": 1.5}, "E2": {"skin": 2.0, "lung": 3.0}}
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "c.gct").write_text("#1.2\nE1.5\tAB\t1.5\n")
    assert formats.read_gct(spark, str(tmp_path / "none")).count() == 0


def test_scorers_of_further_models(spark):
    from bipartia.operators import scoring as S

    train = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "y")], "fold bigint, l string, d string")
    asked = spark.createDataFrame([(1, "a", "z"), (1, "b", "z"), (1, "c", "y")], "fold bigint, l string, d string")
    vec_l = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 4.0])], "node string, vec array<double>")
    vec_d = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [0.6, 0.8])], "node string, vec array<double>")
    one = {(r["l"], r["d"]): r["score"] for r in S.knn_one_sided(train, asked, vec_l, vec_d).collect()}
    assert one == {("a", "z"): pytest.approx(1.0), ("b", "z"): pytest.approx(0.8 / 1.4), ("c", "y"): 0.0}
    pop = {(r["l"], r["d"]): r["score"] for r in S.content_popularity(train, asked, vec_l, vec_d).collect()}
    assert pop == {("a", "z"): 0.0, ("b", "z"): 0.0, ("c", "y"): pytest.approx((0.6 * 2 + 0.8 * 1) * 2, abs=1e-6)}


def test_vectors_are_scrubbed_and_asserted(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([float("inf"), None],)], "v array<double>")
    clean = df.select(V.scrubbed(F.col("v")).alias("v"))
    assert [r["v"] for r in clean.select(V.asserted(F.col("v"), 2).alias("v")).collect()] == [[1.0, 0.0], [0.0, 0.0]]
    for bad, width in ((df, 2), (clean, 3)):
        with pytest.raises(Exception, match="finite vector"):
            bad.select(V.asserted(F.col("v"), width)).collect()


def test_vectors_of_many_nodes_are_compared_once(spark, monkeypatch):
    rng = random.Random(4)
    kinds = [[rng.uniform(-1, 1) for _ in range(4)] for _ in range(5)] + [[0.0] * 4]
    vecs = spark.createDataFrame([(f"n{i:02}", kinds[i % 6]) for i in range(60)], "node string, vec array<double>")
    nodes = vecs.select(F.lit(1).cast("bigint").alias("fold"), "node")
    member, reps = similarity.classes(vecs)
    assert reps.count() == 6
    train = nodes.filter("node < 'n40'")
    want = similarity.top_cosine(nodes.join(vecs, "node"), train.join(vecs, "node"), 10, ["fold"])
    of_node = similarity.nearest_of_classes(nodes, train, (member, reps), 10, ["fold"]).join(member.select("rep", F.col("node").alias("n")), F.col("q") == F.col("rep"))
    assert sorted(map(tuple, of_node.select("n", "node", "sim", "rank").collect())) == sorted(map(tuple, want.select("q", "node", "sim", "rank").collect()))
    compared = []
    plain = similarity.top_cosine
    monkeypatch.setattr(similarity, "top_cosine", lambda q, c, *a: compared.append((q.count(), c.count())) or plain(q, c, *a))
    pairs = nodes.select("fold", F.col("node").alias("l"), F.lit("d").alias("d"))
    scoring.score_all(pairs, pairs.withColumn("label", F.lit(1)), vecs, spark.createDataFrame([("d", [1.0])], "node string, vec array<double>"), ["knn_content", "neighbour_popularity"]).count()
    # Both scorers share one search of l, over its six vectors.
    assert sorted(compared) == [(1, 1), (6, 6)]


def _models_made(monkeypatch):
    from bipartia.plans import associations as A

    made = []
    whole = A.score_wide
    monkeypatch.setattr(A, "score_wide", lambda train, asked, a, b, only: made.append(list(only)) or whole(train, asked, a, b, only))
    A.forget()
    return A, made


def test_golden_compare_evaluates_what_it_compares(spark, sf, monkeypatch):
    A, made = _models_made(monkeypatch)
    A.QUERIES["golden_compare"](spark, sf).count()
    assert len(made) == 2


@pytest.mark.parametrize("name", ["novel_candidates", "external_hits"])
def test_only_the_model_that_comes_out_is_scored(spark, sf, monkeypatch, name):
    A, made = _models_made(monkeypatch)
    A.QUERIES[name](spark, sf).count()
    assert made == [["knn_content"]]


# --- learned scorers and the pool without hubs -------------------------------------------------------------------------
def _learned_case(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(30, 6)), rng.normal(size=(12, 6))
    pairs = sorted({(int(rng.integers(3)), f"l{i}", f"d{j}") for i in range(20) for j in rng.permutation(8)[:4]})
    train = spark.createDataFrame([(f + 1, a, b) for f, a, b in pairs], "fold bigint, l string, d string")
    asked = spark.createDataFrame([(f, f"l{i}", f"d{j}") for f in (1, 2, 3) for i in range(20, 30) for j in range(8, 12)], "fold bigint, l string, d string")
    vec = lambda m, c: spark.createDataFrame([(f"{c}{i}", [float(v) for v in r]) for i, r in enumerate(m)], "node string, vec array<double>")
    return train, asked, vec(x, "l"), vec(y, "d")


def test_learned_scorers_share_negatives_and_rows(spark, monkeypatch):
    from bipartia.operators import learned

    calls, real = [], learned.negatives
    monkeypatch.setattr(learned, "negatives", lambda *a: calls.append(1) or real(*a))
    train, asked, a, b = _learned_case(spark)
    names = ["pair_forest", "product_logistic", "pair_boost"]
    monkeypatch.setattr(learned.SCORERS["pair_forest"], "features", (learned.concat, 4), raising=False)
    monkeypatch.setattr(learned.SCORERS["pair_boost"], "features", (learned.concat, 4), raising=False)
    got = {(r["fold"], r["l"], r["d"]): r for r in scoring.score_wide(train, asked, a, b, names).collect()}
    assert len(calls) == 1 and len(got) == asked.count()
    alone = {(r["fold"], r["l"], r["d"]): r["score"] for r in scoring.SCORERS["product_logistic"](train, asked, a, b).collect()}
    assert all(abs(alone[k] - r["product_logistic"]) < 1e-6 and 0 <= r["pair_forest"] <= 1 for k, r in got.items())


def test_components_are_those_of_spark(spark):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    from bipartia.operators import learned

    x = np.random.default_rng(5).normal(size=(200, 5)) * [5, 4, 3, 2, 1] + 1
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>").repartition(3)
    m = learned._moments(df, lambda b: b.column("x").flatten().to_numpy().reshape(b.num_rows, -1))
    want = PCA(k=3, inputCol="v", outputCol="p").fit(df.select(array_to_vector("x").alias("v"))).pc.toArray()
    assert np.allclose(np.abs(learned._components(m, 5, 3)), np.abs(want), atol=1e-6)


def test_pool_is_not_written_for_each_model(spark, monkeypatch):
    from bipartia.plans import associations as A

    rows = [(1, f"l{i:02}", f"d{j}", int((i + j) % 7 == 0), float(i * (j + 1) % 11), float(i % 3)) for i in range(40) for j in range(3)]
    pool, one = spark.createDataFrame(rows, "fold bigint, l string, d string, label int, a double, b double"), spark.createDataFrame([(f"l{i:02}", 1) for i in range(0, 40, 2)], "l string, only_one int")
    monkeypatch.setattr(A, "cut", lambda *a, **k: pytest.fail("a table is written"))
    got = {(r["model"], r["q"]): (r["n_pool"], r["n_pos"], r["n_only"], r["hits"], r["hits_only"]) for r in A._pool_hits(pool, one, ["a", "b"]).collect()}
    for at, model in ((4, "a"), (5, "b")):
        for q in ("d0", "d1", "d2"):
            own = sorted((r for r in rows if r[2] == q), key=lambda r: (-r[at], r[1]))
            even = lambda rs: sum(r[3] for r in rs if int(r[1][1:]) % 2 == 0)
            assert got[model, q] == (40, sum(r[3] for r in own), even(own), sum(r[3] for r in own[:20]), even(own[:20]))


# --- the best of all candidates -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("share", [2, 16])
def test_best_of_all_is_the_whole_ranking(spark, monkeypatch, share):
    """As from every pair, with nodes of one vector, nodes without training pairs, ties and more l than are asked for."""
    monkeypatch.setattr(scoring, "BOUND_SHARE", share)
    monkeypatch.setattr(scoring, "MEET", 9)
    rng = np.random.default_rng(8)
    vec = lambda c, n: spark.createDataFrame([(f"{c}{i:02}", [float(v) for v in np.eye(4)[i % 4] + i % 7]) for i in range(n)], "node string, vec array<double>")
    pairs = sorted({(int(rng.integers(1, 3)), f"l{rng.integers(36):02}", f"d{rng.integers(9):02}") for _ in range(150)})
    train = spark.createDataFrame([p for p in pairs if int(p[2][1:]) % 2 == p[0] % 2], "fold bigint, l string, d string")
    ls, ds = ([(f, f"{c}{i:02}") for f in (1, 2) for i in range(n) if c == "l" or i % 2 != f % 2] for c, n in (("l", 40), ("d", 12)))
    nodes = {"l": spark.createDataFrame(ls, "fold bigint, l string"), "d": spark.createDataFrame(ds, "fold bigint, d string")}
    names = ["random", "popularity", "popularity_one_sided", "knn_content", "neighbour_popularity"]
    for side in ("d", "l"):
        wide = scoring.score_wide(train, nodes["l"].join(nodes["d"], "fold"), vec("l", 40), vec("d", 12), names)
        want = metrics.top_ranked(scoring.long_scores(wide, names), ["model", "fold", side], 10, "l" if side == "d" else "d")
        got = scoring.best_of_all(train, nodes, side, vec("l", 40), vec("d", 12), names, 10)
        key = lambda r: (r["model"], r["fold"], r["l"], r["d"], round(r["score"], 8), r["rank"])
        assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_recall_of_diseases_makes_no_table_of_all_pairs(spark, sf, monkeypatch):
    from bipartia.plans import associations as A

    monkeypatch.setattr(A, "ranked_wide", lambda *a, **k: pytest.fail("every pair is scored and written"))
    assert A.QUERIES["recall_at_k_disease"](spark, sf).count() > 0
