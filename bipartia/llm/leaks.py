"""Evaluation texts inside training texts: one automaton over all items, one scan of each text, exact verification."""

from __future__ import annotations

import bisect
import re
import uuid
from collections import Counter, defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
# Characters of items in one automaton; more items are scanned for in several blocks.
BLOCK_CHARS = 2_000_000

_built: dict = {}


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the text as it is, each in lower case (which may add marks within a word, but no word)."""
    return " ".join(_WORD.findall(text)).lower().split(" ") if text and _WORD.search(text) else []


class LeakIndex:
    """Finds items in texts. An item is found where ``run`` of its words stand in a row, or where at least ``part`` of its
    words stand in its order within ``spread`` times its length.

    The automaton holds every window of ``run`` words of each item, and for each item so many of its rarest words that
    at least one must be in any passage with ``part`` of its words. Hits of windows are finds; hits of words are
    candidates, to be verified over the text's words.
    """

    def __init__(self, items: list[tuple[int, str]], run: int = 12, part: float = 0.75, spread: int = 2):
        self.items = [(i, w) for i, t in items if (w := words(t))]
        self.spread, self.bags = spread, [Counter(w) for _, w in self.items]
        self.need = [-(-int(round(part * 1000)) * len(w) // 1000) for _, w in self.items]
        spread_of = Counter(w for bag in self.bags for w in bag)
        windows, singles = defaultdict(set), defaultdict(set)
        for k, (_, w) in enumerate(self.items):
            for s in range(len(w) - run + 1):
                windows[" " + " ".join(w[s : s + run]) + " "].add(k)
            rare = sorted(range(len(w)), key=lambda p: (spread_of[w[p]], w[p].isdigit(), -len(w[p]), w[p]))
            for p in rare[: len(w) - self.need[k] + 1]:
                singles[w[p]].add(k)
        self.run = run
        self.automaton = ahocorasick.Automaton()
        for text, ks in windows.items():
            self.automaton.add_word(text, (True, tuple(ks)))
        for word, ks in singles.items():
            self.automaton.add_word(f" {word} ", (False, tuple(ks)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, str, int, int]]:
        """(item_id, kind, begin, end) of each item in the text, once, with offsets in the text as it came."""
        found = words(text)
        if not found or not len(self.automaton):
            return []
        normal = " " + " ".join(found) + " "
        runs, maybe = {}, set()
        for end, (window, ks) in self.automaton.iter(normal):
            if window:
                for k in ks:
                    runs.setdefault(k, end)
            else:
                maybe.update(ks)
        hits = []
        if runs:
            ends, at = [], 0
            for w in found:
                at += len(w) + 1
                ends.append(at)
            for k, end in runs.items():
                last = bisect.bisect_left(ends, end)
                hits.append((k, "run", last - self.run + 1, last))
        bag = None
        for k in sorted(maybe - runs.keys()):
            bag = Counter(found) if bag is None else bag
            if sum(min(n, bag[w]) for w, n in self.bags[k].items() if w in bag) >= self.need[k] and (span := self._in_order(found, k)):
                hits.append((k, "part", *span))
        if not hits:
            return []
        # Lower case may change a text's length; offsets come from the words of the text as it is.
        spans = [m.span() for m in _WORD.finditer(text)]
        return sorted((self.items[k][0], kind, spans[a][0], spans[b][1]) for k, kind, a, b in hits)

    def _in_order(self, found: list[str], k: int) -> tuple[int, int] | None:
        """First and last word of a passage of at most spread times the item's length that has enough of it in order."""
        item, need = self.items[k][1], self.need[k]
        places = defaultdict(list)
        for p, w in enumerate(item):
            places[w].append(p)
        at = [(p, places[w]) for p, w in enumerate(found) if w in places]
        most = self.spread * len(item)
        stop = 0
        for s in range(len(at)):
            while stop < len(at) and at[stop][0] < at[s][0] + most:
                stop += 1
            if stop - s < need:
                continue
            chain: list[int] = []
            for p, where in at[s:stop]:
                for q in reversed(where):
                    c = bisect.bisect_left(chain, q)
                    chain[c : c + 1] = [q]
                if len(chain) >= need:
                    return at[s][0], p
        return None


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 12, part: float = 0.75, spread: int = 2) -> DataFrame:
    """Every document and item found in it: doc_id, item_id, kind (run or part), begin, end, passage.

    One row for each pair; begin and end are character offsets of the first passage found in the document as it is,
    and passage is the text between them.
    Items are the bounded side: they are read on the driver and go to all workers in blocks of BLOCK_CHARS characters,
    one scan of the documents for each block. Null, empty and wordless texts and items match nothing; equal items
    are all found; an empty table gives no rows. Texts are scanned whole.
    """
    sc = docs.sparkSession.sparkContext
    blocks, chars = [[]], 0
    for r in items.select("item_id", "item_text").filter("item_text is not null").orderBy("item_id").toLocalIterator():
        if chars and chars + len(r[1]) > BLOCK_CHARS:
            blocks.append([])
            chars = 0
        blocks[-1].append((r[0], r[1]))
        chars += len(r[1])
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id bigint, kind string, begin int, `end` int, passage string"
    out = None
    for block in blocks:
        shared, key = sc.broadcast(block), uuid.uuid4().hex

        def scan(batches, shared=shared, key=key):
            if key not in _built:
                _built.clear()
                _built[key] = LeakIndex(shared.value, run, part, spread)
            index = _built[key]
            for b in batches:
                ids, hits = b.column(0).to_pylist(), []
                for i, text in enumerate(b.column(1).to_pylist()):
                    hits += [(ids[i], *h, text[h[2] : h[3]]) for h in index.find(text)]
                if hits:
                    cols = list(zip(*hits))
                    kinds = [b.column(0).type, pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[id_col, "item_id", "kind", "begin", "end", "passage"])

        part_ = docs.select(id_col, text_col).mapInArrow(scan, schema)
        out = part_ if out is None else out.unionByName(part_)
    return out


def leak_report(leaks: DataFrame) -> DataFrame:
    """Leaked items with the number of documents, whole runs and the first document."""
    return leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("kind") == "run").cast("bigint")).alias("n_runs"), F.min("doc_id").alias("first_doc_id"))
