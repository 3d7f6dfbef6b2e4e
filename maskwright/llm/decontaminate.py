"""Benchmark decontamination: BM25 over test items with block-max WAND.

The test items form an inverted index; every passage of every document is a
query. A posting's impact is its BM25 weight divided by the item's score against
itself, so one threshold holds for all items: an item is retrieved where a
passage reaches ``THRESHOLD`` of that self-score. What is retrieved is verified:
of the five-word shingles of the item's question and of its answer, a share of at
least ``OVERLAP`` each must stand in the document around the passage. Parts of under
20 words take shorter shingles (a quarter of their words), so that one changed word
does not hide a short item.

Passages are 96 words, one every 48. Items of more than 64 words are indexed in
segments of at most 48, so that a passage can hold a whole segment. An item's
answer is its last sentence; a single sentence is divided after two thirds.

Before the search of a passage, an exact bound is taken for many passages at
once: the impacts of its rarer terms by segment, plus all that a segment's common
terms could add. Where no segment's bound reaches the threshold, nothing can be
retrieved and WAND need not run.

The index goes to all executors in blocks of about ``BLOCK_ITEMS`` items, dealt by a
hash; a larger benchmark takes several passes. Numbers of segments, their mean length
and the terms' frequencies are those of the whole benchmark in each block, so nothing
that is found depends on the size of a block.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices, stored, unpacked, whole_rows
from .substrings import sentences

BLOCK_ITEMS = 10_000
#: Bytes of a block's items, whatever their number.
BLOCK_BYTES = 16 << 20
STRIDE = 48
WHOLE_ITEM = 64
THRESHOLD = 0.5
OVERLAP = 0.6
SHINGLE = 5
K1, B = 1.2, 0.75
#: Postings that share one maximum.
BLOCK = 32
#: A term in more than this share of the segments is common.
COMMON = 0.03

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    parts = [w for w in map(words, sentences(text)) if w]
    if len(parts) > 1:
        return [x for p in parts[:-1] for x in p], parts[-1]
    flat = parts[0] if parts else []
    cut = -(-len(flat) * 2 // 3)
    return flat[:cut], flat[cut:]


def shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, max(1, len(tokens) // 4))
    return {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()


def segments_of(tokens: list[str]) -> list[list[str]]:
    pieces = 1 if len(tokens) <= WHOLE_ITEM else -(-len(tokens) // STRIDE)
    return [tokens[p * len(tokens) // pieces : (p + 1) * len(tokens) // pieces] for p in range(pieces)] if tokens else []


@dataclass
class Statistics:
    """Of the whole benchmark: segments, their mean length, and in how many of them a term stands."""

    segments: int
    mean: float
    df: Mapping[str, int]


class Index:
    """Postings by term, sorted by segment, in blocks with their maxima; ``of`` are the statistics of the whole benchmark, if the items are a part of it."""

    def __init__(self, items: list[tuple[object, str]], of: Statistics | None = None):
        self.items, self.parts, segments = [], [], []
        for item_id, text in sorted(items, key=lambda x: (str(x[0]), x[1])):
            tokens = words(text)
            if not tokens:
                continue
            segments += [(len(self.items), s) for s in segments_of(tokens)]
            self.items.append((item_id, len(tokens)))
            self.parts.append(tuple(map(shingles, question_answer(text))))
        self.segment_item = [i for i, _ in segments]
        here = Counter(t for _, s in segments for t in set(s))
        of = of or Statistics(len(segments), sum(len(s) for _, s in segments) / max(1, len(segments)), here)
        n_segments, mean, df = of.segments, of.mean, of.df
        self.term = {t: i for i, t in enumerate(sorted(here))}
        lists: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for k, (_, s) in enumerate(segments):
            impact = {t: np.log(1 + (n_segments - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(s) / mean)) for t, n in Counter(s).items()}
            own = sum(impact.values())
            for t, x in impact.items():
                lists[self.term[t]].append((k, x / own))
        self.docs = [[k for k, _ in p] for p in lists]
        self.impacts = [[x for _, x in p] for p in lists]
        self.block_max = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impacts]
        self.most = [max(x) for x in self.impacts]
        # for the bound: postings of the rarer terms as one array, the common terms' sums by segment
        rare = [len(p) <= max(1, COMMON * len(segments)) for p in lists]
        kept = [p if r else [] for p, r in zip(lists, rare, strict=True)]
        self.start = np.concatenate([[0], np.cumsum([len(p) for p in kept])]).astype(np.int64)
        self.rare_segment = np.array([k for p in kept for k, _ in p], np.int64)
        self.rare_impact = np.array([x for p in kept for _, x in p])
        self.common = np.zeros(len(segments))
        for p, r in zip(lists, rare, strict=True):
            for k, x in [] if r else p:
                self.common[k] += x

    def possible(self, ids: np.ndarray, threshold: float) -> np.ndarray:
        """The passages (numbers of their first stride) that some segment's bound lets reach the threshold."""
        known = np.flatnonzero(ids >= 0)
        if not len(known) or not len(self.common):
            return np.zeros(0, np.int64)
        pairs = np.unique((known // STRIDE) * len(self.term) + ids[known])  # a term counts once in a stride
        stride, term = pairs // len(self.term), pairs % len(self.term)
        n = self.start[term + 1] - self.start[term]
        at = np.repeat(self.start[term] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        key, back = np.unique(np.repeat(stride, n) * len(self.common) + self.rare_segment[at], return_inverse=True)
        mass = np.bincount(back, self.rare_impact[at], len(key))
        after = np.searchsorted(key, key + len(self.common))
        after = np.minimum(after, max(0, len(key) - 1))
        both = mass + np.where(key[after] == key + len(self.common), mass[after], 0) if len(key) else mass
        segment, first = key % len(self.common), key // len(self.common)
        here = first[both + self.common[segment] >= threshold - 1e-9]
        # with nothing in its first stride, a passage is bounded by its second
        alone = first[mass + self.common[segment] >= threshold - 1e-9]
        found = [here, alone - 1]
        if (self.common >= threshold - 1e-9).any():
            found.append(np.arange(-(-len(ids) // STRIDE)))
        return np.unique(np.concatenate(found).clip(0))

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(segment, score) of all segments whose score is at least ``threshold``: block-max WAND."""
        end = len(self.common)
        cursors = [[self.docs[t][0], 0, t] for t in terms]
        out = []
        while True:
            cursors.sort()
            total, pivot = 0.0, None
            for i, c in enumerate(cursors):
                total += self.most[c[2]]
                if total >= threshold - 1e-9:
                    pivot = i
                    break
            if pivot is None or cursors[pivot][0] >= end:
                return out
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            bound, border = 0.0, end
            for c in cursors[: pivot + 1]:  # the blocks that would hold the pivot
                docs = self.docs[c[2]]
                at = bisect_left(docs, doc, c[1])
                if at < len(docs):
                    block = at // BLOCK
                    bound += self.block_max[c[2]][block]
                    border = min(border, docs[min(len(docs), (block + 1) * BLOCK) - 1] + 1)
            if bound >= threshold - 1e-9:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    docs = self.docs[c[2]]
                    at = bisect_left(docs, doc, c[1])
                    if at < len(docs) and docs[at] == doc:
                        score += self.impacts[c[2]][at]
                if score >= threshold - 1e-9:
                    out.append((doc, score))
                target = doc + 1
            else:
                target = max(doc + 1, border)
                if pivot + 1 < len(cursors):
                    target = min(target, max(doc + 1, cursors[pivot + 1][0]))
            for c in cursors[: pivot + 1]:
                docs = self.docs[c[2]]
                c[1] = bisect_left(docs, target, c[1])
                c[0] = docs[c[1]] if c[1] < len(docs) else end

    def matches(self, text: str, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[object, float, float, float, int]]:
        """(item, score, question overlap, answer overlap, first word of the passage) for each item that a text holds, best passage first."""
        tokens = words(text)
        get = self.term.get
        ids = np.array([get(t, -1) for t in tokens], np.int64)
        best: dict[int, tuple[float, float, float, int]] = {}
        for p in self.possible(ids, threshold).tolist():
            lo, hi = p * STRIDE, (p + 2) * STRIDE
            here = ids[lo:hi]
            for segment, score in self.search(np.unique(here[here >= 0]).tolist(), threshold):
                item = self.segment_item[segment]
                length = self.items[item][1]
                around = tokens[max(0, lo - length) : hi + length]
                got = {n: {tuple(around[i : i + n]) for i in range(len(around) - n + 1)} for n in {min(len(s), SHINGLE) for part in self.parts[item] for s in part}}
                share = [sum(s in got[len(s)] for s in part) / len(part) if part else 1.0 for part in self.parts[item]]
                if min(share) >= overlap and score > best.get(item, (0.0,))[0]:
                    best[item] = (score, *share, lo)
        return [(self.items[i][0], *best[i]) for i in sorted(best)]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, segments that hold it, 0) and, with a null term, (segments, their words) of each slice."""
    for batch in slices(batches):
        parts = [s for text in batch.column(0).to_pylist() for s in segments_of(words(text))]
        df = Counter(t for s in parts for t in set(s))
        columns = [pa.array([*df, None], pa.string()), pa.array([*df.values(), len(parts)], pa.int64()), pa.array([0] * len(df) + [sum(map(len, parts))], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "n", "words"])


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The index in blocks; what goes to the driver is a block's items and the frequencies of their terms."""
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), (size["bytes"] or 0) // BLOCK_BYTES)
    if blocks == 1:
        yield Index([(r["item_id"], r["text"]) for r in items.collect()])
        return
    found = stored(items.select("text").mapInArrow(_terms, "term string, n long, words long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words")), "terms")
    whole = found.filter("term IS NULL").first()
    for b in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        own = part.select("text").mapInArrow(_terms, "term string, n long, words long").select("term").distinct()
        df = {r["term"]: r["n"] for r in found.join(own, "term").select("term", "n").collect()}
        yield Index([(r["item_id"], r["text"]) for r in part.collect()], Statistics(whole["n"], whole["words"] / max(1, whole["n"]), df))


def _find(index: Index, threshold: float, overlap: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parent, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for m in index.matches(text, threshold, overlap):
                    parent.append(i)
                    rows.append(m)
            c = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(parent, pa.int64())), pa.array(c[0], item_type), *[pa.array(x, pa.float64()) for x in c[1:4]], pa.array(c[4], pa.int64())], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """One row per document and test item that it holds: doc_id, item_id, score, question_overlap, answer_overlap, first_word.

    Null or empty texts of either table match nothing; a repeated document row
    gives its rows again; an empty table of either kind gives an empty result. Very
    long texts are searched whole, passage by passage. Of passages with equal scores
    the first one counts. Columns but the ids and texts play no part.
    """
    rows, out = documents.filter(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text")), None
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((documents, "doc_id"), (benchmark, "item_id"))]
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    for index in indexes(benchmark):
        found = rows.mapInArrow(_find(index, threshold, overlap, item_type), f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double, first_word long")
        out = found if out is None else out.unionByName(found)
    return out


def _keep(index: Index, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            clean = [not t or not index.matches(t, threshold, overlap) for t in batch.column(1).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``documents`` that hold no test item, columns unchanged, repeated rows too; null and empty texts stay. Columns may have any names."""
    rows = whole_rows(documents, F.col("text").cast("string").alias("text"))
    for index in indexes(benchmark):
        rows = rows.mapInArrow(_keep(index, threshold, overlap), rows.schema)
    return unpacked(rows, documents.columns)
