"""Problem 7: documents that hold passages of held-out items, found by winnowed fingerprints and extended to exact spans.

A document gives away an item if it holds ``span`` following words of it, or the whole item if that is shorter. Items of at
least ``span`` words are fingerprinted for runs of ``span`` words, items of SHORT words to under ``span`` for runs of SHORT
words, and still shorter ones as they are, each length for itself; so a shared run always leaves a common fingerprint, and a
short item does not make those of the others coarser. Null, empty and blank texts hold nothing; items without words match nothing;
a repeated item row counts once; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans import spread
from .words import WordHash, gram_hashes, winnow, words

SPAN = 12
#: Up to so many words of items the items go to the executors as they are; beyond, fingerprints are joined by shuffle.
ITEM_WORDS = 2_000_000


SHORT = 6


def run_of(words: int, span: int) -> int:
    """The run for which an item of so many words is fingerprinted."""
    return span if words >= span else SHORT if words >= SHORT else words


def _shape(run: int) -> tuple[int, int]:
    """k of the k-grams and the window for shared runs of ``run`` words; runs under SHORT words are kept whole."""
    k = run if run < SHORT else (run + 1) // 2
    return k, run - k + 1


def longest_shared(a: np.ndarray, b: np.ndarray, i: int, j: int, most: int) -> int:
    """Length of the run of equal entries of a and b through places i and j, counted up to ``most``."""
    left = 0
    if i >= len(a) or a[i] != b[j]:
        return 0
    while left < most and i > left and j > left and a[i - left - 1] == b[j - left - 1]:
        left += 1
    right = 0
    while left + right < most and i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
        right += 1
    return left + right


class Items:
    """Hashed items and their fingerprints, by run length."""

    def __init__(self, rows: list[tuple[int, str | None]], span: int = SPAN):
        hashed = WordHash()
        self.items = [(i, h) for i, h in ((i, hashed(words(t))) for i, t in rows) if len(h)]
        self.runs = sorted({run_of(len(h), span) for _, h in self.items})
        self.need = [min(span, len(h)) for _, h in self.items]
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.sorted: dict[int, np.ndarray] = {}
        for run in self.runs:
            k, window = _shape(run)
            found = defaultdict(list)
            for n, (_, h) in enumerate(self.items):
                if run_of(len(h), span) == run:
                    g = gram_hashes(h, k)
                    for p in winnow(g, window):
                        found[int(g[p])].append((n, int(p)))
            self.at[run] = dict(found)
            self.sorted[run] = np.sort(np.fromiter(found, dtype=np.uint64, count=len(found)))

    def given_away(self, docs: list[np.ndarray]) -> list[tuple[int, int]]:
        """(place in docs, item id) for each item that a document of these word hashes gives away.

        The documents are fingerprinted end to end; a run that crosses from one to the next cannot pass the extension.
        """
        out: set[tuple[int, int]] = set()
        joined = np.concatenate(docs) if docs else np.empty(0, dtype=np.uint64)
        ends = np.cumsum([len(h) for h in docs])
        for run in self.runs:
            known = self.sorted[run]
            k, window = _shape(run)
            if len(joined) < run or not len(known):
                continue
            g = gram_hashes(joined, k)
            places = winnow(g, window)
            near = np.searchsorted(known, g[places])
            places = places[known[np.minimum(near, len(known) - 1)] == g[places]]
            for p, d in zip(places.tolist(), np.searchsorted(ends, places, side="right").tolist()):
                h = docs[d]
                for n, q in self.at[run][int(g[p])]:
                    item, own = self.items[n]
                    if (d, item) not in out and longest_shared(h, own, p - int(ends[d]) + len(h), q, self.need[n]) >= self.need[n]:
                        out.add((d, item))
        return sorted(out)


def _scan(documents: DataFrame, items: Items) -> DataFrame:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        for b in batches:
            ids = b["doc_id"].tolist()
            pairs = [(ids[n], i) for n, i in items.given_away([hashed(words(t)) for t in b["text"]])]
            yield pd.DataFrame(pairs, columns=["doc_id", "item_id"], dtype="int64")

    return spread(documents.select("doc_id", "text")).mapInPandas(find, "doc_id bigint, item_id bigint")


def _fingerprints(rows: DataFrame, key: str, runs: list[int], span: int, by_length: bool) -> DataFrame:
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        for b in batches:
            out = []
            for i, t in zip(b[key], b["text"]):
                h = hashed(words(t))
                for run in runs:
                    if len(h) < run or by_length and run_of(len(h), span) != run:
                        continue
                    k, window = _shape(run)
                    g = gram_hashes(h, k)
                    out += [(i, run, x) for x in np.unique(g[winnow(g, window)]).view(np.int64)]
            yield pd.DataFrame(out, columns=[key, "run", "mark"])

    return rows.select(key, "text").mapInPandas(make, f"{key} bigint, run int, mark bigint")


def _joined(documents: DataFrame, items: DataFrame, runs: list[int], span: int) -> DataFrame:
    """The same result with nothing broadcast: fingerprints are joined, then the spans of the pairs are checked in full."""
    hits = _fingerprints(documents, "doc_id", runs, span, False).join(_fingerprints(items, "item_id", runs, span, True), ["run", "mark"]).select("doc_id", "item_id").distinct()

    @F.pandas_udf("boolean")
    def holds(texts: pd.Series, own: pd.Series) -> pd.Series:
        hashed = WordHash()

        def one(text: str, item: str) -> bool:
            h, g = hashed(words(text)), hashed(words(item))
            need = min(span, len(g))
            marks = set(gram_hashes(g, need).tolist())
            return any(x in marks for x in gram_hashes(h, need).tolist())

        return pd.Series([one(t, o) for t, o in zip(texts, own)], dtype=bool)

    texts = documents.select("doc_id", "text")
    own = items.select("item_id", F.col("text").alias("item_text"))
    return hits.join(own, "item_id").join(texts, "doc_id").where(holds("text", "item_text")).select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, span: int = SPAN, item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id) for each document that gives away an item; see the module's text.

    The items' size is counted first. Up to ``item_words`` words they are sent to the executors and the corpus is read once
    without a shuffle; beyond that, fingerprints of both sides are joined.
    """
    items = items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words(t)) for t in texts], dtype="int32")

    n = F.col("n")
    run = F.when(n >= span, span).when(n >= SHORT, SHORT).otherwise(n).alias("run")
    by_run = items.select(count("text").alias("n")).where("n > 0").groupBy(run).agg(F.sum("n").alias("words")).collect()  # one row a run
    if sum(r["words"] for r in by_run) <= item_words:
        held = Items([(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()], span)
        return _scan(documents, held)
    return _joined(documents, items, sorted(r["run"] for r in by_run), span)


def leaks_by_suite(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(suite, source, n_items, n_docs): leaked items and the documents that hold them; a missing suite is 'none'."""
    found = leaked_items(documents, items)
    named = found.join(items.select("item_id", F.coalesce("suite", F.lit("none")).alias("suite")).dropDuplicates(["item_id"]), "item_id")
    return named.join(documents.select("doc_id", "source"), "doc_id").groupBy("suite", "source").agg(
        F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_docs"))
