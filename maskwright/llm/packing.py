"""Packing documents into windows of equal length by minimum bin slack.

A document's full windows stand alone; what is left of it (its remainder, shorter
than a window) is packed with other remainders. The remainders' lengths form a
histogram of at most ``capacity - 1`` counts, which is all that the driver needs:
it seeds a window with the longest remaining length and lets a bitset subset-sum
dynamic program find the multiset of remaining lengths that fills the rest
closest to capacity, backtracks the counts, and applies that pattern as often as
the counts allow. Lengths for which nothing comes within ``MAX_SLACK`` of capacity
are laid end to end and cut at window borders instead.

The plan speaks of "the r-th remainder of length l"; rows find their r by numbers
within (length, bucket) groups, so neither the driver nor one task sees all rows.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_text, bucketed, buckets_for, slices, stored

CAPACITY = 2048
END = 1
#: A window may stay this much short before its lengths are cut instead.
MAX_SLACK = 8
#: Rows whose remainder is cut: up to so many of them are sent to all executors, else they are joined by shuffle.
BROADCAST_CUTS = 50_000
#: Entries of a worker's caches of words and of their parts; they start afresh when full.
WORDS, PARTS = 60_000, 250_000

_PIECE = "doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """A ``tokenizers`` BPE file whose text is split at white space, word by word, with caches.

    Words in Latin-1 are split and mapped to bytes here and go straight to the
    BPE model; all others go through the library's whole pipeline.
    """

    _latin_parts = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\s0-9a-zªµºß-öø-ÿ²³¹¼-¾]+")
    _odd = re.compile("[\x1c-\x1f]")  # white space for str.split alone

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        shape = json.loads(self.whole.to_str())
        kinds = [n["type"] for n in (shape["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or shape["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError("the tokenizer must drop white space and lower case, with ends of words")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.byte_char = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            mapped = part if part.isascii() and part.isprintable() else "".join([self.byte_char[b] for b in part.encode()])
            got = np.array([x.id for x in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(part) < 64:
                if len(self.parts) >= PARTS:
                    self.parts.clear()
                self.parts[part] = got
        return got

    def _word(self, word: str) -> bytes:
        try:
            word.encode("latin-1")
            got = self._library(word) if "<|" in word else b"".join(map(self._part, self._latin_parts.findall(word.lower())))
        except UnicodeEncodeError:
            got = self._library(word)
        if len(word) < 64:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = got
        return got

    def ids(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        if self._odd.search(text):
            return self._library(text)
        known, word = self.words.get, self._word
        return b"".join([known(w) or word(w) for w in text.split()])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The fullest multiset with sum at most ``room``: (its sum, counts by length). Bit s of the set says that s can be reached."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    goal = 1 << room
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0:
            take = min(copies, left)
            grown = (reach | (reach << (length * take))) & mask
            if grown != reach:
                steps.append((reach, length, take))
                reach = grown
            left, copies = left - take, copies * 2
        if reach & goal:
            break
    total = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not (before >> at) & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return total, used


@dataclass
class Plan:
    """Where the r-th remainder of each length goes. segments[length]: rows of (from rank, per window, first window, offset), by rank."""

    capacity: int
    segments: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    windows: int = 0
    tail_from: dict[int, int] = field(default_factory=dict)
    tail_at: dict[int, int] = field(default_factory=dict)
    tail: int = 0

    @property
    def tail_windows(self) -> int:
        return -(-self.tail // self.capacity)


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY, max_slack: int = MAX_SLACK) -> Plan:
    """Minimum bin slack over a histogram of lengths, each below ``capacity``."""
    plan, counts, ranks = Plan(capacity), dict(histogram), dict.fromkeys(histogram, 0)
    for seed in sorted(counts, reverse=True):
        while counts[seed] > 0:
            counts[seed] -= 1
            total, used = fill(counts, capacity - seed)
            counts[seed] += 1
            if capacity - seed - total > max_slack:
                plan.tail_from[seed], plan.tail_at[seed] = ranks[seed], plan.tail
                plan.tail += seed * counts[seed]
                counts[seed] = 0
                break
            used[seed] = used.get(seed, 0) + 1
            times, offset = min(counts[x] // n for x, n in used.items()), 0
            for length, n in sorted(used.items(), reverse=True):
                plan.segments.setdefault(length, []).append((ranks[length], n, plan.windows, offset))
                ranks[length], counts[length], offset = ranks[length] + n * times, counts[length] - n * times, offset + n * length
            plan.windows += times
    return plan


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of the ``rank``-th remainders of their lengths; a tail row gets the window in which it begins."""
    window, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    for one in np.unique(length):
        rows = np.flatnonzero(length == one)
        r, start = rank[rows], plan.tail_from.get(int(one), 1 << 62)
        late = r >= start
        if late.any():
            at = plan.tail_at[int(one)] + (r[late] - start) * int(one)
            window[rows[late]], offset[rows[late]] = plan.windows + at // plan.capacity, at % plan.capacity
        if not late.all():
            seg = np.array(plan.segments[int(one)], np.int64)
            s = seg[np.searchsorted(seg[:, 0], r[~late], side="right") - 1]
            into = r[~late] - s[:, 0]
            window[rows[~late]], offset[rows[~late]] = s[:, 2] + into // s[:, 1], s[:, 3] + into % s[:, 1] * int(one)
    return window, offset


def cut_rows(plan: Plan, histogram: dict[int, int]) -> int:
    """How many tail rows lie across a window's border."""
    total = 0
    for length, start in plan.tail_from.items():
        rows, at = histogram[length] - start, plan.tail_at[length]
        period = plan.capacity // math.gcd(plan.capacity, length)  # the places within windows recur
        cut = (at + np.arange(min(rows, period)) * length) % plan.capacity + length > plan.capacity
        total += int(cut.sum()) * (rows // period if rows > period else 1) + int(cut[: rows % period].sum() if rows > period else 0)
    return total


def _measure(path: str, capacity: int):
    """Per document: ids, checksums of the full windows and of the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end, step = tokenizer(path), np.array([END], "<u4").tobytes(), capacity * 4
        for batch in slices(batches):
            tokens, full, rest, crc = [], [], [], []
            for text in batch.column(2).to_pylist():
                ids = tok.ids(text) + end
                whole = len(ids) // step
                tokens.append(len(ids) // 4)
                full.append([zlib.crc32(ids[i * step : (i + 1) * step]) for i in range(whole)])
                rest.append(len(ids) // 4 - whole * capacity)
                crc.append(zlib.crc32(ids[whole * step :]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.int32()), pa.array(crc, pa.int64())], names=["doc_id", "key", "doc_tokens", "full_crc", "rest", "rest_crc"])

    return run


def _pieces(plan: Plan):
    """Rows with rank to pieces; full windows follow the packed ones. Remainders that are cut are left to ``_cut``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            rest, rank, tokens = (col[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("rest", "rank", "doc_tokens"))
            window, offset, some = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64), np.flatnonzero(rest > 0)
            window[some], offset[some] = place(plan, rest[some], rank[some])
            packed = np.flatnonzero((rest > 0) & (offset + rest <= plan.capacity))
            sizes = np.diff(col["full_crc"].offsets.to_numpy())
            parent = np.repeat(np.arange(len(rest)), sizes)
            nth = np.arange(len(parent)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = col["full_before"].to_numpy(zero_copy_only=False).astype(np.int64)
            who = np.concatenate([packed, parent])
            both = lambda a, b: pa.array(np.concatenate([a, b]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pc.take(col["doc_id"], pa.array(who)),
                    both(tokens[packed] - rest[packed], nth * plan.capacity),
                    both(rest[packed], np.full(len(parent), plan.capacity)),
                    both(col["rest_crc"].to_numpy(zero_copy_only=False)[packed], col["full_crc"].flatten().to_numpy(zero_copy_only=False)),
                    pa.array(tokens[who]),
                    both(window[packed], plan.windows + plan.tail_windows + first[parent] + nth),
                    both(offset[packed], np.zeros(len(parent))),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def _crosses(plan: Plan):
    """The rows whose remainder lies across a border, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.array([plan.tail_from.get(i, 1 << 62) for i in range(plan.capacity)], np.int64)
        for batch in batches:
            rest, rank = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("rest", "rank"))
            late = np.flatnonzero((rest > 0) & (rank >= starts[rest]))
            window, offset = place(plan, rest[late], rank[late])
            cut = offset + rest[late] > plan.capacity
            part = batch.select(["doc_id", "key", "doc_tokens", "rest"]).take(pa.array(late[cut]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(window[cut]), pa.array(offset[cut])], names=["doc_id", "key", "doc_tokens", "rest", "window", "offset"])

    return run


def _cut(path: str, capacity: int):
    """Both pieces of each remainder that lies across a border; its text is tokenized again for their checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(path), np.array([END], "<u4").tobytes()
        names, last, ids = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], None, b""
        for batch in slices(batches):
            rows = []
            for r in batch.to_pylist():
                if r["key"] != last:
                    ids, last = tok.ids(r["text"]) + end, r["key"]
                start, first = r["doc_tokens"] - r["rest"], capacity - r["offset"]
                rows.append((r["doc_id"], start, first, zlib.crc32(ids[start * 4 : (start + first) * 4]), r["doc_tokens"], r["window"], r["offset"]))
                rows.append((r["doc_id"], start + first, r["rest"] - first, zlib.crc32(ids[(start + first) * 4 :]), r["doc_tokens"], r["window"] + 1, 0))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field("doc_id").type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=names)

    return run


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty: the document is its end id alone. Repeated rows are
    packed each for itself. An empty table gives no pieces. A very long text fills
    windows of its own, and its remainder is packed; remainders of equal length go by
    (doc_id, tokens, checksum). Columns but doc_id and text play no part. What lies across a
    border is found again by the MD5 of its text, so ids that repeat or are null cost no more.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.unhex(F.md5(as_text().cast("binary"))).alias("key"), as_text().alias("text"))
    measured = rows.mapInArrow(_measure(path, capacity), f"doc_id {kind}, key binary, doc_tokens long, full_crc array<long>, rest int, rest_crc long")
    dealt = bucketed(measured, buckets_for(documents.count()), "packing").withColumn("full", F.size("full_crc"))
    groups = dealt.groupBy("rest", "_bucket").agg(F.count("*").alias("n"), F.sum("full").alias("f"))
    before = W.partitionBy("rest").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    groups_before = groups.select("rest", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("f").over(before), F.lit(0)).alias("f_before"))
    lengths = groups.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("f").alias("f")).orderBy("rest").collect()  # at most `capacity` rows
    histogram = {r["rest"]: r["n"] for r in lengths if r["rest"]}
    plan = plan_windows(histogram, capacity)
    base, at = [], 0
    for r in lengths:
        base.append((r["rest"], at))
        at += r["f"]
    bases = documents.sparkSession.createDataFrame(base, "rest int, base long")  # a row a length
    groups_before = groups_before.join(F.broadcast(bases), "rest")
    within = W.partitionBy("rest", "_bucket").orderBy("doc_id", "doc_tokens", "rest_crc")
    running = within.rowsBetween(W.unboundedPreceding, 0)
    numbered = dealt.withColumn("rank", F.row_number().over(within) - 1).withColumn("full_before", F.sum("full").over(running) - F.col("full")).join(groups_before, ["rest", "_bucket"])
    numbered = numbered.withColumn("rank", (F.col("rank") + F.col("n_before")).cast("long"))
    numbered = numbered.withColumn("full_before", (F.col("full_before") + F.col("f_before") + F.col("base")).cast("long")).select("doc_id", "key", "doc_tokens", "full_crc", "rest", "rest_crc", "rank", "full_before")
    pieces = numbered.mapInArrow(_pieces(plan), _PIECE.format(kind=kind))
    cuts = cut_rows(plan, histogram)
    if not cuts:
        return pieces
    crossing = stored(numbered.mapInArrow(_crosses(plan), f"doc_id {kind}, key binary, doc_tokens long, rest int, window long, offset long"), "crossing")
    keys = crossing.select("key").distinct()
    # each text once, however many rows have it
    texts = rows.select("key", "text").join(F.broadcast(keys) if cuts <= BROADCAST_CUTS else keys, "key", "left_semi").dropDuplicates(["key"])
    return pieces.unionByName(crossing.join(texts, "key").mapInArrow(_cut(path, capacity), _PIECE.format(kind=kind)))


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequences, tokens and padding of a packing: a sequence as long as a power of two is not padded."""
    size = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    two = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long") == F.col("n")
    return size.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(two, 0).otherwise(capacity - F.col("n"))).alias("padding"))
