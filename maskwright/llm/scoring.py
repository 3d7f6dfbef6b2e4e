"""Language-model scores by a weighted backoff automaton.

Tasks read the texts in blocks. A block's n-grams, with the counts of those that are for
training, go as sorted hashes to shards; each shard adds up the counts of all blocks and
answers every block with the totals of what it has asked for. So a block learns the
counts in the whole corpus of just the n-grams that it holds itself, whatever their
number, and no task sees the model of the corpus as a whole. An n-gram is told apart by
64 bits within a shard that other bits have chosen.

With them a block builds its part of the automaton. The states are the contexts seen in
training, root included; an n-gram seen there is an arc from its context, which carries
its smoothed log probability

    p(w | h) = (c(h w) + mu p(w | h')) / (c(h) + mu)      h' is h without its first word
    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))               V + 1: all unknown words together

and a failure arc leads from h to h' with weight mu / (c(h) + mu). All texts of a block,
in segments that begin with the context they need, go through it from left to right, a
step at a time: each keeps its state, takes the arc of its next word, or fails until there
is one, and adds up the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collocations import merged
from .common import as_text, slices, stored, text_parts

ORDER = 2
MU = 200.0
ADD = 0.1
#: Tokens of a block, and of a segment.
BLOCK, SEGMENT = 1_200_000, 1024
#: Bytes of text for each shard of n-grams, and the fewest shards.
SHARD_BYTES, SHARDS = 12 << 20, 8
#: What stands before and after a text; neither can be a word.
BEGIN, FINISH = b" ", b"\n"

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def tokens(part: bytes) -> list[bytes]:
    """Words with capital letters A-Z made small."""
    return part.lower().split()


def packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit integers, bytes of one weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class NGrams:
    """The distinct n-grams of a block, by order: ``keys[n]`` (place of the context of n - 1 words, word), sorted; ``at[n]`` the place of the one that ends at each token, or -1."""

    def __init__(self, ids: np.ndarray, room: np.ndarray, order: int, words: int) -> None:
        """``room``: how many tokens of its segment stand before each token."""
        self.keys, self.at, self.suffix = [np.arange(words)], [ids.astype(np.int64)], [np.zeros(words, np.int64)]
        for n in range(1, order):
            here = np.flatnonzero(room >= n)
            keys, _, place = merged((self.at[-1][here - 1] << 32) | ids[here], np.ones(len(here), np.int64))
            at, suffix = np.full(len(ids), -1, np.int64), np.zeros(len(keys), np.int64)
            at[here] = place
            suffix[place] = self.at[-1][here]  # the n-gram without its first word
            self.keys.append(keys)
            self.at.append(at)
            self.suffix.append(suffix)

    def counts(self, counted: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(at[counted & (at >= 0)], minlength=len(keys)) for at, keys in zip(self.at, self.keys, strict=True)]

    def requests(self, words: list[bytes], shards: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(order, shard, places of its n-grams, their hashes), in the order of the hashes."""
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        word = (both[:, 0].copy(), both[:, 1].copy())
        name = word
        for n, keys in enumerate(self.keys):
            if n:
                context, last = keys >> 32, keys & 0xFFFFFFFF
                name = tuple(_mix(x[context] * _M3 + w[last]) for x, w in zip(name, word, strict=True))
            shard = (name[1] % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((name[0], shard))
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(edges)).tolist():
                places = order[edges[s] : edges[s + 1]]
                yield n, s, places, name[0][places]


class Block:
    """Texts in segments, as numbers of words."""

    def __init__(self, order: int) -> None:
        self.order, self.words, self.ids, self.sizes, self.starts, self.text = order, {BEGIN: 0, FINISH: 1}, [], [], [], []
        self.docs, self.trains, self.rows, self.held = [], [], [], 0

    def number(self, found: list[bytes]) -> np.ndarray:
        known = self.words
        return np.fromiter((known.setdefault(w, len(known)) for w in found), np.int32, len(found))

    def begin(self, doc, train: bool, row: int) -> None:
        self.docs.append(doc)
        self.trains.append(train)
        self.rows.append(row)

    def add(self, before: list[bytes], found: list[bytes]) -> None:
        """Tokens of the text begun last, after the ``before`` ones."""
        whole = np.concatenate([self.number(before), self.number(found)])
        for at in range(len(before), len(whole), SEGMENT):
            start = max(0, at - self.order + 1)
            self.ids.append(whole[start : at + SEGMENT])
            self.sizes.append(len(self.ids[-1]))
            self.starts.append(at - start)
            self.text.append(len(self.docs) - 1)
        self.held += len(found)


def arrays(ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the tokens before it in its segment, and whether it is to be scored (context is not)."""
    room = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return room, room >= np.repeat(starts, sizes)


_LISTS = {"trains": pa.bool_(), "rows": pa.int64(), "sizes": pa.int32(), "starts": pa.int32(), "texts": pa.int32()}


def _read(order: int):
    """Documents to blocks, a row each: ids, vocabulary, and lists over its texts and segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial, row = TaskContext.get().partitionId(), 0, 0
        now, kind = Block(order), pa.int64()

        def flush() -> pa.RecordBatch:
            nonlocal now, serial
            words = zstandard.ZstdCompressor(level=1).compress(b" ".join(list(now.words)[2:]))
            lists = [pa.array([x], pa.list_(t)) for x, t in zip((now.trains, now.rows, now.sizes, now.starts, now.text), _LISTS.values(), strict=True)]
            out = pa.RecordBatch.from_arrays([pa.array([(task << 32) | serial]), pa.array([packed(np.concatenate(now.ids))], pa.binary()), pa.array([words], pa.binary()), pa.array([now.docs], pa.list_(kind)), *lists], names=["block", "ids", "words", "docs", *_LISTS])
            now, serial = Block(order), serial + 1
            return out

        for batch in slices(batches):
            kind = batch.schema.field(0).type
            for doc, held_out, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row += 1
                before = [BEGIN]
                now.begin(doc, not held_out, (task << 32) | row)
                for part in text_parts(text):
                    found = tokens(part)
                    now.add(before, found)
                    before = [*before, *found][1 - order :] if order > 1 else []
                    if now.held >= BLOCK:  # a very long text goes on in the next block
                        yield flush()
                        now.begin(doc, not held_out, (task << 32) | row)
                now.add(before, [FINISH])
        if now.ids:
            yield flush()

    return run


def _opened(row: dict, order: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, NGrams]:
    """Words, ids, segments' sizes and starts, tokens to score, and n-grams of a block's row."""
    text = zstandard.ZstdDecompressor().decompress(row["words"])
    words = [BEGIN, FINISH, *(text.split(b" ") if text else [])]
    ids, sizes, starts = unpacked(row["ids"]).astype(np.int64), np.array(row["sizes"], np.int64), np.array(row["starts"], np.int64)
    room, scored = arrays(ids, sizes, starts)
    return words, ids, sizes, starts, scored, NGrams(ids, room, order, len(words))


def _ask(order: int, shards: int):
    """Blocks to what they ask each shard for: hashes of n-grams, as differences, and their counts in the block's training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            row = batch.to_pylist()[0]
            words, _, sizes, _, scored, grams = _opened(row, order)
            counts = grams.counts(scored & np.repeat(np.array(row["trains"])[np.array(row["texts"])], sizes))
            made = [(row["block"], n, s, packed(np.diff(names, prepend=np.uint64(0))), packed(counts[n][places])) for n, s, places, names in grams.requests(words, shards)]
            for i in range(0, len(made), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[i : i + 64], strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "level", "shard", "data", "counts"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Totals of what each block asks a shard for; at level 0 also tokens and distinct tokens of the shard, under block -1."""
    block, level, out = table.column("block").to_pylist(), np.array(table.column("level").to_pylist()), []
    for n in np.unique(level).tolist():
        rows = np.flatnonzero(level == n).tolist()
        names = [np.cumsum(unpacked(table.column("data")[i].as_py()), dtype=np.uint64) for i in rows]
        counts = np.concatenate([unpacked(table.column("counts")[i].as_py()) for i in rows]).astype(np.int64)
        _, totals, place = merged(np.concatenate(names), counts)
        for i, part in zip(rows, np.split(totals[place], np.cumsum([len(x) for x in names])[:-1]), strict=True):
            out.append((block[i], n, table.column("shard")[i].as_py(), packed(part), 0, 0))
        if n == 0:
            out.append((-1, 0, 0, b"", int(totals.sum()), int((totals > 0).sum())))
    columns = list(zip(*out, strict=True))
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("block", "level", "shard", "totals", "n", "v"), columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)})


class Automaton:
    """States, arcs and failure arcs of a block's n-grams. State 0 is the root; further ones are n-grams that may go on."""

    def __init__(self, grams: NGrams, totals: list[np.ndarray], n: int, v: int, mu: float) -> None:
        order = len(grams.keys)
        self.known = totals[0] > 0
        chance = [(totals[0] + ADD) / (n + ADD * (v + 1))]
        self.base = np.log10(chance[0])
        context = [totals[0].astype(float)]
        context[0][0], context[0][1] = totals[0][1], 0  # a text begins as often as it ends, and nothing follows its end
        for k in range(1, order):
            above = context[k - 1][grams.keys[k] >> 32]
            chance.append((totals[k] + mu * chance[k - 1][grams.suffix[k]]) / (above + mu))
            context.append(np.where((grams.keys[k] & 0xFFFFFFFF) == 1, 0, totals[k]).astype(float))
        sizes = [len(k) for k in grams.keys]
        first = np.concatenate([[1], 1 + np.cumsum(sizes)])  # number of the first state of each order
        states = [np.where(c > 0, first[k] + np.arange(len(c)), 0) for k, c in enumerate(context)]
        for k in range(1, order):  # what has not been seen stands for its longest suffix that has
            states[k] = np.where(states[k] > 0, states[k], states[k - 1][grams.suffix[k]])
        self.start = states[0]
        self.fail, self.back = np.zeros(1, np.int64), np.zeros(1)
        arcs, weights, ends = [], [], []
        for k in range(order - 1):
            self.fail = np.append(self.fail, states[k - 1][grams.suffix[k]] if k else np.zeros(sizes[0], np.int64))
            self.back = np.append(self.back, np.log10(mu / (context[k] + mu)))
            seen = np.flatnonzero(totals[k + 1] > 0)
            arcs.append(((first[k] + (grams.keys[k + 1][seen] >> 32)) << 32) | (grams.keys[k + 1][seen] & 0xFFFFFFFF))
            weights.append(np.log10(chance[k + 1][seen]))
            ends.append((states[k + 1] if k + 2 < order else states[k][grams.suffix[k + 1]])[seen])
        self.arcs, self.weights, self.ends = (np.concatenate([*x, np.array([], t)]) for x, t in ((arcs, np.int64), (weights, float), (ends, np.int64)))
        if order == 1:
            self.start = np.zeros(sizes[0], np.int64)

    def walk(self, ids: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log probability of each segment, all read together from left to right."""
        order = np.argsort(-sizes, kind="stable")
        begins, length, skipped = (np.cumsum(sizes) - sizes)[order], sizes[order], starts[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order))
        upto = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")  # segments longer than each step
        for t, lanes in enumerate(upto.tolist()):
            word, now, sum_ = ids[begins[:lanes] + t].astype(np.int64), state[:lanes], np.zeros(lanes)
            left = np.flatnonzero(now > 0)
            while len(left):
                key = (now[left] << 32) | word[left]
                arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
                hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(left), bool)
                there, rest = left[hit], left[~hit]
                sum_[there] += self.weights[arc[hit]]
                now[there] = -1 - self.ends[arc[hit]]  # below 0: done, the next state
                sum_[rest] += self.back[now[rest]]
                now[rest] = self.fail[now[rest]]
                left = rest[now[rest] > 0]
            root = now == 0
            sum_[root] += self.base[word[root]]
            state[:lanes] = np.where(root, self.start[word], -1 - now)
            total[:lanes] += np.where(t >= skipped[:lanes], sum_, 0)
        out = np.empty(len(order))
        out[order] = total
        return out


def _score(order: int, shards: int, n: int, v: int, mu: float):
    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        one = {c: left.column(c)[0].as_py() for c in left.column_names if c != "docs"}
        words, ids, sizes, starts, scored, grams = _opened(one, order)
        owner = np.array(one["texts"], np.int64)
        totals = [np.zeros(len(k), np.int64) for k in grams.keys]
        answers = {(lv, s): t for lv, s, t in zip(right.column("level").to_pylist(), right.column("shard").to_pylist(), right.column("totals"), strict=True)}
        for level, shard, places, _ in grams.requests(words, shards):
            totals[level][places] = unpacked(answers[level, shard].as_py())
        model = Automaton(grams, totals, n, v, mu)
        texts, doc = len(one["rows"]), np.repeat(owner, sizes)[scored]
        kept = ids[scored]
        sums = lambda who, values: pa.array(np.bincount(who, values, texts))
        whole = lambda who, values: pa.array(np.bincount(who, values, texts).astype(np.int64))
        columns = [pa.array(one["rows"], pa.int64()), left.column("docs").combine_chunks().flatten(), pa.array([not t for t in one["trains"]]), whole(doc, np.ones(len(doc))), whole(doc, model.known[kept].astype(float)), sums(doc, model.base[kept]), sums(owner, model.walk(ids, sizes, starts))]
        return pa.table(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def scored(documents: DataFrame, order: int = ORDER, mu: float = MU) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Texts with crc32(doc_id as text) mod 10 other than 0 are learned from; a null doc_id
    counts as empty text. ``base_score`` is by single tokens, ``score`` by the automaton of
    ``order`` words; both are log10 probabilities of the text with its end.

    Null text counts as empty, which is its end alone. Repeated rows count as often as they
    stand there and are scored each for itself; very long texts count whole. An empty table
    gives no rows; where nothing is learned from, all words are unknown. Columns but doc_id
    and text play no part.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = documents.select("doc_id", held_out.alias("held_out"), as_text().cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, size // SHARD_BYTES)
    shape = f"block long, ids binary, words binary, docs array<{kind}>, trains array<boolean>, rows array<long>, sizes array<int>, starts array<int>, texts array<int>"
    texts = stored(rows.mapInArrow(_read(order), shape), "blocks")
    asked = texts.drop("docs").mapInArrow(_ask(order, shards), "block long, level int, shard int, data binary, counts binary")
    answers = stored(asked.groupBy("shard").applyInArrow(_answer, "block long, level int, shard int, totals binary, n long, v long"), "answers")
    whole = answers.filter("block = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = whole["n"] or 0, whole["v"] or 0
    told = answers.filter("block >= 0").select("block", "level", "shard", "totals")
    parts = texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_score(order, shards, n, v, mu), f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    # a very long text has a part in each of its blocks
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    return parts.groupBy("row", "doc_id", "held_out").agg(*sums).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
