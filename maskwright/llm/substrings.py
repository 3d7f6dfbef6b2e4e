"""Substring deduplication over sliding runs of sentences.

A run begins at every sentence and takes the fewest consecutive sentences, two at
least, that have ``MIN_WORDS`` words together (one suffices if it alone has
``LONE_WORDS``); with ``both_ends``, another ends at every sentence and takes the
fewest before it in the same way. Whether sentences are such a run depends on them
alone, so equal passages give equal runs wherever they stand, and with ``both_ends``
the first and the last sentence of a repeated passage are both in one. The hashes of
all runs of all documents are grouped globally; each run that is not the first of its
hash, by (doc_id, text hash, place), marks its sentences, and marked sentences go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, slices, stored, whole_rows

MIN_WORDS = 25
LONE_WORDS = 30

#: A sentence with the white space after it: up to a mark that white space follows, a full-width mark, or a line's end.
SENTENCE = re.compile(r".+?(?:[.!?][\"')\]»”]*(?=\s)|[。！？]|(?=\n)|\Z)\s*|\s+", re.DOTALL)
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> list[str]:
    """Pieces that make up the text when put together again."""
    return SENTENCE.findall(text)


def runs(pieces: list[str], min_words: int = MIN_WORDS, lone: int = LONE_WORDS, both_ends: bool = False) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, sentences, 128-bit hash) of every run; letter case and all but letters and digits don't count."""
    words = [_WORD.findall(p.lower()) for p in pieces]
    filled = [i for i, w in enumerate(words) if w]
    upto = np.concatenate([[0], np.cumsum([len(words[i]) for i in filled])]).astype(np.int64)
    flat = [" ".join(words[i]) for i in filled]
    short = (np.diff(upto) < lone).tolist()
    found = set()
    for a, end in enumerate(np.searchsorted(upto, upto[:-1] + min_words).tolist()):
        found.add((a, end + (end == a + 1 and short[a])))
    for e, a in enumerate((np.searchsorted(upto, upto[1:] - min_words, "right") - 1).tolist() if both_ends else []):
        found.add((a - (a == e and short[e]), e + 1))
    for a, end in sorted(found):
        if a >= 0 and end <= len(filled):
            yield filled[a], filled[end - 1] - filled[a] + 1, xxhash.xxh3_128_digest("\n".join(flat[a:end]))


def _spans(min_words: int, lone: int, both_ends: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parent, at, size, hashes = [], [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for i, n, h in runs(sentences(text), min_words, lone, both_ends):
                    parent.append(row)
                    at.append(i)
                    size.append(n)
                    hashes.append(h)
            who = pa.array(parent, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), batch.column(0).take(who), batch.column(1).take(who), pa.array(at, pa.int32()), pa.array(size, pa.int32())], names=["hash", "doc_id", "row", "at", "size"])

    return run


def _clean(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = names.index("text")
        for batch in slices(batches):
            texts, gone = [], []
            for text, marks in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if not marks:
                    texts.append(text)
                    gone.append(0)
                    continue
                pieces = sentences(text)
                out = np.zeros(len(pieces), bool)
                for m in marks:
                    out[m["at"] : m["at"] + m["size"]] = True
                texts.append("".join(p for p, x in zip(pieces, out.tolist(), strict=True) if not x).rstrip())
                gone.append(int(out.sum()))
            columns = list(batch.columns[: len(names)])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.int32())], names=[*batch.schema.names[: len(names)], "gone"])

    return run


def dedup(documents: DataFrame, min_words: int = MIN_WORDS, lone: int = LONE_WORDS, both_ends: bool = False) -> DataFrame:
    """All rows and columns of ``documents`` with ``text`` cleaned, and ``removed_sentences``.

    Null text stays null. A row whose sentences all repeat earlier ones stays with
    empty text. Rows that repeat both doc_id and text count as one document: they
    come out alike. A column of the name ``removed_sentences`` is replaced; others may
    have any names. Very long texts are cut whole; of equal runs the least
    (doc_id, text hash, place) stays. An empty table gives no rows.
    """
    names = [c for c in documents.columns if c != "removed_sentences"]
    row = F.xxhash64(F.col("doc_id"), F.col("text").cast("string"))
    there = documents.filter(F.col("text").isNotNull()).select("doc_id", row.alias("row"), F.col("text").cast("string").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    spans = stored(there.mapInArrow(_spans(min_words, lone, both_ends), f"hash binary, doc_id {kind}, row long, at int, size int"), "spans")
    place = F.struct("doc_id", "row", "at")
    first = stored(spans.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last")).select("hash", "first"), "first")
    later = spans.join(first, "hash").filter(~place.eqNullSafe(F.col("first")))
    marks = later.select(F.col("doc_id").alias("in_doc"), F.col("row").alias("marked"), "at", "size").distinct().groupBy("in_doc", "marked").agg(F.collect_list(F.struct("at", "size")).alias("marks"))
    rest = documents.select(*[F.col(quoted(c)) if c != "text" else F.col("text").cast("string").alias("text") for c in names])
    packed = whole_rows(rest, F.col("doc_id").alias("own_id"), row.alias("own")).join(marks.hint("shuffle_hash"), (F.col("own") == F.col("marked")) & F.col("own_id").eqNullSafe(F.col("in_doc")), "left")
    flat = packed.select(*[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(names)], "marks")
    kinds = [f"c{i} {rest.schema[c].dataType.simpleString()}" for i, c in enumerate(names)]
    clean = flat.mapInArrow(_clean(names), ", ".join([*kinds, "gone int"]))
    return clean.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("gone").alias("removed_sentences"))
