"""Scores for abusive, hateful and sexual language: a factorization machine over hashed terms of sentences."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartia.sources.tables import cut, release

CATEGORIES = ("abuse", "hate", "sexual")
# Labelled rows used for fitting, at most; the ones with the lowest hash of their id are taken.
MAX_LABELLED = 50_000
BUCKETS = 1 << 16
FACTORS = 6
# Size of the model besides its weights: spellings known, and terms with counts of their own, the most frequent first.
MAX_WORDS, MAX_TERMS = 50_000, 1 << 20
# Steps of the fit; sentences that one task sums gradients over, and tasks of a step at most.
STEPS, SHARD, SHARDS = 30, 2048, 16

# Letters of other scripts that look like Latin ones. Fixed values.
_LOOKALIKE = str.maketrans("абвгеёзіјкмнорѕстухүһԁԛԝαβεηικνορτυχ", "abbreezijkmhopsctyxyhdqwabenikvoptux")
# Signs that stand for letters. Fixed values.
_LEET = str.maketrans("0134578$@", "oieastbsa")
_INVISIBLE = re.compile("[­᠎​-‏‪-‮⁠-⁤﻿︀-️]")
_SPACED = re.compile(r"(?<![^\W_])[^\W_](?:[ .\-_*]{1,3}[^\W_](?![^\W_])){2,}")
_SENTENCE = re.compile(r"[.!?;。！？؟]+(?=\s|$)|[。！？\r\n]+|(?<=\w)\.(?=\s)")
_TOKEN = re.compile(r"(?:[^\W_]|[*$@](?=[^\W_*])|(?<=[^\W_*])\*+)+")
_PLAIN = re.compile(r"[^\W_]+")
_REPEAT = re.compile(r"([^*])\1+")
_CODE = re.compile(r"^(?=.*\d)[\w]+$")


# Names of tags that are no words of a text. Fixed values.
_TAG = re.compile(r"</?(?:a|abbr|b|blockquote|br|code|del|div|em|h[1-6]|hr|i|img|kbd|li|ol|p|pre|s|span|strong|sub|sup|table|tbody|td|th|thead|tr|u|ul)(?=[\s/>])|[<>]")
# Longer sentences are scored in windows of so many words, half overlapping.
WINDOW = 14


def sentences(text: str | None) -> list[str]:
    """Sentences of a text, without invisible characters; letters set apart are joined.

    Names and signs of tags are left out, the words inside a tag are a sentence like others."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "<" in text or ">" in text:
        text = _TAG.sub("\n", text)
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]+", "", m.group()), text)
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def words_of(sentence: str) -> list[str]:
    masked = "*" in sentence or "$" in sentence or "@" in sentence
    return (_TOKEN if masked else _PLAIN).findall(sentence)


def plain_word(word: str) -> str:
    """A word in lower case without accents, lookalikes, letter signs and repeated letters; numbers become 0."""
    w = "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))
    if any("a" <= c <= "z" for c in w) or "*" in w:
        w = w.translate(_LOOKALIKE)
    elif w.isdigit():
        return "0"
    letters = sum(c.isalpha() for c in w)
    if letters and any(c in "0134578$@" for c in w):
        if sum(c.isdigit() for c in w) > letters + 2:
            return "0"
        w = w.translate(_LEET)
        if any(c.isdigit() for c in w):
            return "0"
    return _REPEAT.sub(r"\1", w)


class Speller:
    """Plain words of a vocabulary; masked, scrambled or clipped spellings are led back to the word they stand for.

    Only words of up to LONGEST letters have other spellings."""

    LONGEST = 30

    def __init__(self, counts: dict[str, int]):
        self.known, self.by = set(counts), {}
        for w in sorted(counts, key=lambda w: (-counts[w], w)):
            if len(w) > self.LONGEST:
                continue
            if len(w) >= 4:
                for key in self._keys(w):
                    self.by.setdefault(key, w)
            if len(w) >= 3:
                self.by.setdefault(w[0] + "*" + w[-1] + str(len(w)), w)
        self.cache: dict[str, str] = {}

    @staticmethod
    def _keys(w):
        yield "#" + "".join(sorted(w))
        for i in range(1, len(w) - 1):
            yield w[:i] + "*" + w[i + 1 :]
            yield "-" + w[:i] + w[i + 1 :]

    def __call__(self, word: str) -> str:
        if (got := self.cache.get(word)) is None:
            got = self.cache[word] = self._seek(plain_word(word))
            if len(self.cache) > 500_000:
                self.cache.clear()
        return got

    def _seek(self, w: str) -> str:
        if w in self.known or len(w) < 3:
            return w
        if "*" in w:
            one = _REPEAT.sub(r"\1", w)
            return self.by.get(w) or self.by.get(w[0] + "*" + w[-1] + str(len(w))) or self.by.get(one) or w.replace("*", "")
        if len(w) >= 4:
            return self.by.get("#" + "".join(sorted(w))) or self.by.get("-" + w) or w
        return w


class Reader(dict):
    """The number that stands for a word as it is written: a hash of its known spelling, odd if that is all letters."""

    def __init__(self, speller: Speller):
        super().__init__()
        self.speller = speller

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        known = self.speller(word)
        got = self[word] = xxhash.xxh64_intdigest(known.encode("utf-8", "replace")) & ~1 | known.isalpha()
        return got


def terms(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and of the pairs of neighbours of many sentences, sentence by sentence: the words of all
    sentences and the number of words of each, to hashes, terms of each sentence, and which hashes are words."""
    first = np.cumsum(sizes) - sizes
    inner = np.ones(len(words), bool)
    inner[first] = False
    right = np.flatnonzero(inner)
    pair = words[right - 1] * np.uint64(0x9E3779B97F4A7C15) + (words[right] << np.uint64(23) | words[right] >> np.uint64(41))
    pair = (pair ^ pair >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) & ~np.uint64(1)
    owner, many = np.repeat(np.arange(len(sizes)), sizes), 2 * sizes - 1
    begin = np.cumsum(many) - many
    place = np.arange(len(words)) - first[owner] + begin[owner]
    out, single = np.empty(int(many.sum()), np.uint64), np.zeros(int(many.sum()), bool)
    out[place], single[place] = words, True
    out[place[right] + sizes[owner[right]] - 1] = pair
    return out, many, single


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(8) & np.uint64(BUCKETS - 1)).astype(np.int64)


def pieces(text: str | None, reader: Reader) -> list[tuple[int, ...]]:
    """The sentences of a text in the numbers of their words, long ones in windows."""
    out = []
    for s in sentences(text):
        if ws := [reader[w] for w in words_of(s)]:
            starts = range(0, len(ws) - WINDOW // 2, WINDOW // 2) if len(ws) > WINDOW else (0,)
            out += [tuple(ws[i : i + WINDOW]) for i in starts]
    return out


# Rows of a model that are no term's: an empty place in a sentence, and w0.
_NO_TERM, _W0 = BUCKETS, BUCKETS + 1


class Sentences:
    """Buckets of the terms of many sentences, one after another: ``flat``, with the number of terms of each in ``sizes``;
    in blocks of bounded size, as matrices with a row for each sentence."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, block: int = 20_000):
        self.flat, self.sizes, self.block = flat, sizes, block

    def blocks(self):
        """Places of a block's sentences, their terms, and x = 1 / sqrt(terms of the sentence)."""
        ends = np.cumsum(self.sizes)
        for lo in range(0, len(self.sizes), self.block):
            n = self.sizes[lo : lo + self.block]
            begin = ends[lo : lo + self.block] - n
            rows = np.full((len(n), int(n.max())), _NO_TERM)
            rows[np.arange(rows.shape[1]) < n[:, None]] = self.flat[begin[0] : begin[0] + int(n.sum())]
            yield slice(lo, lo + len(n)), rows, 1 / np.sqrt(n)


class Machine:
    """score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j), x = 1 / sqrt(terms of the sentence).

    ``p`` holds w and v of ``n`` machines side by side, a row for each bucket, and w0 in a row of its own. Fitted by Adam on
    the logistic loss; ``step`` takes sums of gradients, wherever they were summed."""

    def __init__(self, n: int = 1, seed: int = 7):
        self.p = np.zeros((BUCKETS + 2, n, 1 + FACTORS))
        self.p[:BUCKETS, :, 1:] = np.random.default_rng(seed).normal(0, 0.05, (BUCKETS, 1, FACTORS))
        self.p[_W0, :, 0] = -2.0
        self.m, self.q, self.t = 0.0, 0.0, 0

    def score(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return probabilities(self.p, Sentences(flat, sizes))[:, 0]

    def step(self, g: np.ndarray, n: int, rate: float = 0.2, decay: float = 2e-5) -> None:
        self.t += 1
        g = g + decay * n * self.p
        g[_W0] -= decay * n * self.p[_W0]
        self.m, self.q = 0.9 * self.m + 0.1 * g, 0.99 * self.q + 0.01 * g * g
        self.p = self.p - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.q / (1 - 0.99**self.t)) + 1e-8)


def _squares(p: np.ndarray) -> np.ndarray:
    return (p[:, :, 1:] ** 2).sum(axis=2)


def _block(p: np.ndarray, squares: np.ndarray, rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (a column for each machine), and the sums of the terms' weights and factors times x."""
    total = np.einsum("stcf->scf", p[rows]) * x[:, None, None]
    own = squares[rows].sum(axis=1) * (x * x)[:, None]
    z = p[_W0, :, 0] + total[:, :, 0] + 0.5 * ((total[:, :, 1:] ** 2).sum(axis=2) - own)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), total


def probabilities(p: np.ndarray, s: Sentences) -> np.ndarray:
    """A row for each sentence, a column for each machine."""
    squares, out = _squares(p), np.empty((len(s.sizes), p.shape[1]))
    for at, rows, x in s.blocks():
        out[at] = _block(p, squares, rows, x)[0]
    return out


def gradient(p: np.ndarray, s: Sentences, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """Sums over the sentences of the gradient of the logistic loss, shaped like ``p``; yes and no are weights of the votes,
    a column for each machine.

    A term's factors get error times x times (sum of the sentence's factors times x, less its own): the first part is summed
    over the term's sentences, the second is its factors times the sum of error times x squared.
    """
    squares, g = _squares(p), np.zeros(p.shape)
    for at, rows, x in s.blocks():
        prob, total = _block(p, squares, rows, x)
        err = (yes[at] + no[at]) * prob - yes[at]
        each = total * (err * x[:, None])[:, :, None]
        each[:, :, 0] = err * x[:, None]
        flat, owner = rows[rows != _NO_TERM], np.repeat(np.arange(len(rows)), (rows != _NO_TERM).sum(axis=1))
        add = lambda values: np.bincount(flat, values[owner], len(p))
        for c in range(p.shape[1]):
            for f in range(1 + FACTORS):
                g[:, c, f] += add(each[:, c, f])
            g[:, c, 1:] -= p[:, c, 1:] * add(err[:, c] * x * x)[:, None]
        g[_W0, :, 0] += err.sum(axis=0)
    return g


def _more(yes_total: float, no_total: float) -> float:
    """How much more a yes weighs where it is rare."""
    return float(np.sqrt(min(100.0, max(1.0, no_total / max(1.0, yes_total)))))


def fit(rows: list[list[int]], yes: np.ndarray, no: np.ndarray, epochs: int = STEPS) -> Machine:
    """One machine for sentences (their buckets) with ``yes`` and ``no`` votes, in this process."""
    s = Sentences(np.concatenate([np.array(r, np.int64) for r in rows]), np.array([len(r) for r in rows]))
    machine, more, votes = Machine(), _more(yes.sum(), no.sum()), np.sqrt(np.maximum(1, yes + no))
    for _ in range(epochs):
        machine.step(gradient(machine.p, s, (yes * more / votes)[:, None], (no / votes)[:, None]), len(rows))
    return machine


def _lower(yes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Lower end of Wilson's interval, one deviation wide, of the rate yes / n; 0 for a single observation."""
    p = yes / n
    low = (p + 0.5 / n - np.sqrt(p * (1 - p) / n + 0.25 / n**2)) / (1 + 1 / n)
    return np.where(n > 1, low, 0.0)


def labelled(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The texts of at most ``max_labelled`` labels: label_id, said, text.

    Category names count without case and spaces around, a misspelt one as the category within two letters of it;
    others, and null, are no label. Documents read by several annotators vote once for each. The labels, bounded by
    max_labelled, are broadcast; the documents stay where they are.
    """
    name = F.lower(F.trim("category"))
    nearest = F.array_min(F.array(*[F.struct(F.levenshtein(name, F.lit(c)).alias("d"), F.lit(c).alias("c")) for c in ("none", *CATEGORIES)]))
    known = labels.select("label_id", "doc_id", F.when(nearest["d"] <= F.when(nearest["c"] == "none", 1).otherwise(2), nearest["c"]).alias("said")).filter("said is not null")
    few = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("label_id", "said", "text")


def _vocabulary(read: DataFrame, rare: int = 2) -> Speller:
    """Words seen more than ``rare`` times in the labelled texts."""

    def count(batches):
        for b in batches:
            n: Counter[str] = Counter()
            for w, k in Counter(w for t in b.column(0).to_pylist() for x in sentences(t) for w in words_of(x)).items():
                n[plain_word(w)] += k
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    words = read.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return Speller({r["word"]: r["n"] for r in words.filter((F.col("n") > rare) & ~F.col("word").contains("*")).orderBy(F.desc("n"), "word").limit(MAX_WORDS).collect()})


def _pieces(read: DataFrame, speller) -> DataFrame:
    """The distinct sentences of each labelled text: said, sizes (words of each sentence), words (their numbers)."""

    def run(batches):
        reader = Reader(speller.value)
        for b in batches:
            own = [list(dict.fromkeys(pieces(t, reader))) for t in b.column(1).to_pylist()]
            sizes = pa.array([[len(p) for p in ps] for ps in own], pa.list_(pa.int64()))
            words = [np.fromiter(chain.from_iterable(ps), np.uint64).astype(np.int64) for ps in own]
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(words, pa.list_(pa.int64()))], names=["said", "sizes", "words"])

    return read.select("said", "text").mapInArrow(run, "said string, sizes array<bigint>, words array<bigint>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: category (-1 for none) and sentences of each, and words of each sentence, one after another."""
    said = np.array([CATEGORIES.index(c) if c in CATEGORIES else -1 for c in batch.column(0).to_pylist()], np.int64)
    sizes, words = batch.column(1), batch.column(2)
    return said, np.diff(sizes.offsets.to_numpy()), sizes.flatten().to_numpy(), words.flatten().to_numpy().astype(np.uint64)


def _term_rates(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms that count, in order, and how surely each tells of each category.

    A term's rate is the share of the texts with it that have the label, at the lower end of its interval. A word seen
    once, in a text with the label, tells a little: a sentence with three of them is unlike the rest. Pairs seen once are
    left out.
    """

    def count(batches):
        for b in batches:
            said, many, sizes, words = _flat(b)
            if not len(words):
                continue
            h, n_terms, _ = terms(words, sizes)
            text = np.repeat(np.repeat(np.arange(len(said)), many), n_terms)
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])]
            h, label = h[new], said[text[new]]
            at, begin = np.unique(h, return_index=True)
            sums = [np.add.reduceat(x, begin) for x in (np.ones(len(h), np.int64), *[(label == c).astype(np.int64) for c in range(len(CATEGORIES))])]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), *map(pa.array, sums)], names=["h", "n", *CATEGORIES])

    kinds = "h bigint, n bigint, " + ", ".join(f"{c} bigint" for c in CATEGORIES)
    rates = texts.mapInArrow(count, kinds).groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", *CATEGORIES)])
    once = (F.col("n") == 1) & (F.col("h") % 2 != 0) & (F.greatest(*CATEGORIES) == 1)
    got = rates.filter((F.col("n") > 1) | once).orderBy(F.desc("n"), "h").limit(MAX_TERMS).toPandas()
    h, n, yes = got["h"].to_numpy(np.int64).astype(np.uint64), got["n"].to_numpy(float), got[list(CATEGORIES)].to_numpy(float)
    low = np.where((n == 1)[:, None], 0.36 * yes, _lower(yes, np.maximum(n, 1)[:, None]))
    order = np.argsort(h)
    return h[order], low[order]


def _votes(texts: DataFrame, rates, least: float = 0.35) -> DataFrame:
    """Distinct sentences with their votes: keys (buckets of their terms), yes and no for each category.

    Labels hold for documents, but the machine learns sentences. A sentence is as telling as its three best terms. A
    text with the label votes yes for its most telling sentences and no for the others; if none is telling, the label is
    taken for an error and left out, as are telling sentences of texts without the label.
    """
    names = [f"{v}_{c}" for c in CATEGORIES for v in ("yes", "no")]

    def run(batches):
        known, low = rates.value
        known, low = np.r_[known, np.uint64(2**64 - 1)], np.vstack([low, np.zeros(len(CATEGORIES))])
        for b in batches:
            said, many, sizes, words = _flat(b)
            if not len(words):
                continue
            h, n_terms, single = terms(words, sizes)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            owner, begin = np.repeat(np.arange(len(sizes)), n_terms), np.cumsum(n_terms) - n_terms
            best = np.zeros((len(sizes), 2 * WINDOW, len(CATEGORIES)))
            best[owner, np.arange(len(h)) - begin[owner]] = np.where(hit[:, None], low[at], 0)
            telling = np.partition(best, -3, axis=1)[:, -3:].sum(axis=1) / np.minimum(3, n_terms)[:, None]
            # Texts without a sentence have no place among the sentences.
            has = np.flatnonzero(many)
            top = np.zeros((len(said), len(CATEGORIES)))
            top[has] = np.maximum.reduceat(telling, (np.cumsum(many) - many)[has], axis=0)
            text = np.repeat(np.arange(len(said)), many)
            votes = np.zeros((len(sizes), len(names)))
            for c in range(len(CATEGORIES)):
                mine, t, most = said[text] == c, telling[:, c], top[text, c]
                yes = mine & (most >= least) & (t >= np.maximum(least, 0.7 * most))
                votes[:, 2 * c], votes[:, 2 * c + 1] = yes, np.where(mine, (most >= least) & ~yes, t < 0.6)
            first = np.cumsum(sizes) - sizes
            place = np.arange(len(words)) - np.repeat(first, sizes)
            piece = np.add.reduceat((words ^ words >> np.uint64(29)) * (np.uint64(0x94D049BB133111EB) * (2 * place.astype(np.uint64) + 1)), first)
            used = hit | single
            offsets = np.r_[0, np.cumsum(np.add.reduceat(used.astype(np.int64), begin))].astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(buckets(h[used])))
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int64)), keys, *[pa.array(votes[:, i].copy()) for i in range(len(names))]], names=["piece", "keys", *names])

    kinds = "piece bigint, keys array<bigint>, " + ", ".join(f"{n} double" for n in names)
    return texts.mapInArrow(run, kinds).groupBy("piece").agg(F.first("keys").alias("keys"), *[F.sum(n).alias(n) for n in names])


def _gradients(weights, more: np.ndarray):
    """The sum of a partition's gradients; only buckets that occur are sent."""

    def run(batches):
        total = 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0)
            s = Sentences(keys.flatten().to_numpy(), np.diff(keys.offsets.to_numpy()))
            both = np.stack([b.column(1 + i).to_numpy() for i in range(2 * len(more))], axis=1)
            yes, no = both[:, ::2], both[:, 1::2]
            votes = np.sqrt(np.maximum(1, yes + no))
            total = total + gradient(weights.value, s, yes * more / votes, no / votes)
        if not np.isscalar(total):
            at = np.flatnonzero(np.abs(total).sum(axis=(1, 2)))
            yield pa.RecordBatch.from_arrays([pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([total[at].astype(np.float32).tobytes()], pa.binary())], names=["at", "g"])

    return run


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[Speller, np.ndarray, list[bool]]:
    """The spellings, the weights of the machines, and which categories have a machine (those with a telling label).

    Every step sums the gradients of all categories over the partitions of the labelled sentences; what reaches the driver
    is as large as the model, at most SHARDS times. No text or list of sentences does.
    """
    sc = docs.sparkSession.sparkContext
    read = cut(labelled(docs, labels, max_labelled))
    speller = _vocabulary(read)
    texts = cut(_pieces(read, sc.broadcast(speller)))
    votes = cut(_votes(texts, sc.broadcast(_term_rates(texts))).drop("piece"))
    names = votes.columns[1:]
    n, *totals = votes.agg(F.count(F.lit(1)), *[F.sum(c) for c in names]).first()
    sets = cut(votes.repartition(max(1, min(SHARDS, n // SHARD)), F.xxhash64("keys")))
    release(read, texts, votes)
    taught = [bool(n and totals[2 * c] > 0 and totals[2 * c + 1] > 0) for c in range(len(CATEGORIES))]
    more = np.array([_more(totals[2 * c] or 0, totals[2 * c + 1] or 0) for c in range(len(CATEGORIES))])
    machine = Machine(len(CATEGORIES))
    for _ in range(STEPS if any(taught) else 0):
        weights = sc.broadcast(machine.p.astype(np.float32))
        g = np.zeros(machine.p.shape)
        for r in sorted(sets.mapInArrow(_gradients(weights, more), "at binary, g binary").collect()):
            g[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["g"], np.float32).reshape(-1, *g.shape[1:])
        machine.step(g, n)
        weights.destroy()
    release(sets)
    return speller, machine.p.astype(np.float32), taught


_readers: dict = {}


def score_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores between 0 and 1: doc_id, category, score, and the columns ``keep``; one row for each document and category.

    A document's score is that of its most telling sentence. All sentences of whole texts are scored, in any script.
    Null, empty and wordless texts score 0; without labels of a category all its scores are 0.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_labelled)), uuid.uuid4().hex

    def run(batches):
        speller, p, taught = shared.value
        if key not in _readers:
            _readers.clear()
            _readers[key] = Reader(speller)
        reader = _readers[key]
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                own = [pieces(t, reader) if any(taught) else [] for t in part.column(1).to_pylist()]
                scores = np.zeros((part.num_rows, len(CATEGORIES)))
                many = np.array([len(ps) for ps in own])
                if many.any():
                    sizes = np.array([len(p) for ps in own for p in ps])
                    h, n_terms, _ = terms(np.fromiter(chain.from_iterable(chain.from_iterable(own)), np.uint64, int(sizes.sum())), sizes)
                    has = np.flatnonzero(many)
                    scores[has] = np.maximum.reduceat(probabilities(p, Sentences(buckets(h), n_terms)), (np.cumsum(many) - many)[has], axis=0)
                for c, category in enumerate(CATEGORIES):
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([category] * part.num_rows), pa.array(scores[:, c] * taught[c]), *part.columns[2:]], names=["doc_id", "category", "score", *keep])

    kinds = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, f"doc_id bigint, category string, score double{kinds}")


def rates(docs: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """For each source and category: documents, documents at or above ``threshold``, and their share. Sources count
    without spaces around; null and blank ones are one source, null. Scores that have kept their source need no join."""
    hit = (F.col("score") >= threshold).cast("bigint")
    both = scores if "source" in scores.columns else scores.join(docs.select("doc_id", "source"), "doc_id")
    source = F.nullif(F.trim("source"), F.lit("")).alias("source")
    out = both.groupBy(source, "category").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(hit).alias("n_found"))
    return out.withColumn("rate", F.col("n_found") / F.col("n_docs"))
