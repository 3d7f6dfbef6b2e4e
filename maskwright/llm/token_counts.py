"""Token counts under a unigram model, with a trie of pre-tokens.

A pre-token is a word between white space with the word mark before it. Its best
segmentation into vocabulary pieces is found by forward scores: the best score of
a prefix is the best over its last piece. Scores depend on the prefix alone, so
the distinct pre-tokens of many texts go into a trie, each shared prefix is scored
once, and the node at a pre-token's end has its count; texts only look counts up.
A character in no piece takes one token per UTF-8 byte.

The vocabulary file has merge ranks instead of log probabilities. By Zipf's law a
piece of rank r is given the log probability ``-ln(r + 1) - ln(H)`` (H the
harmonic number of the vocabulary's size). Ties go to fewer tokens.

The trie is built and scored depth by depth, all nodes of a depth at once (NumPy
arrays, sorted pre-tokens in, at most ``NODES_WORDS`` of them at a time). The
vocabulary is a trie of pieces too. A node holds the pieces that have begun above it
and may still go on, each as its state in the trie of pieces; a child takes its
parent's, adds the one that begins at it, and moves all by its character. What ends
there is a candidate for its score.

Every worker keeps the counts of what it has read, in two generations of about
``WORDS`` pre-tokens: what was met since the last change of generations stays, so
frequent pre-tokens are not scored again. There is no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

MARK = "▁"
#: Pre-tokens that go into one trie.
NODES_WORDS = 20_000
#: Pre-tokens of a generation of counts.
WORDS = 150_000
#: Longer pre-tokens are scored on their own, and their counts don't stay.
LONG = 48


def zipf_scores(path: str) -> tuple[dict[str, float], float]:
    """Log probability of each piece of a sentencepiece model, and that of a single byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 1) for r in range(size)))
    ranked = sorted(plain, key=lambda i: (-model.get_score(i), i))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(ranked)}, -math.log(size) - total


class Pieces:
    """The trie of pieces: moves from a state by a character, for whole arrays; state 0 is the root, -1 none."""

    def __init__(self, scores: Mapping[str, float]):
        moves: dict[tuple[int, str], int] = {}
        ends, n = {}, 1
        for piece, score in scores.items():
            at = 0
            for ch in piece:
                down = moves.setdefault((at, ch), n)
                n += down == n
                at = down
            ends[at] = score
        self.score = np.full(n, -np.inf)
        self.score[list(ends)] = list(ends.values())
        # open addressing: at most a quarter of the places are taken
        self.bits = max(4, len(moves) * 4 - 1).bit_length()
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys = np.array([s << 21 | ord(c) for s, c in moves], np.int64)
        to, place = np.array(list(moves.values()), np.int32), self._place(keys)
        while len(keys):
            free = self.keys[place] < 0
            self.keys[place[free]] = keys[free]  # of several, the last one written has it
            done = self.keys[place] == keys
            self.to[place[done]] = to[done]
            keys, to, place = keys[~done], to[~done], (place[~done] + 1) & (len(self.keys) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def move(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        keys = states.astype(np.int64) << 21 | chars
        place = self._place(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.to[place], -1)
        late = np.flatnonzero((found != keys) & (found >= 0))
        while len(late):
            place[late] = (place[late] + 1) & (len(self.keys) - 1)
            found = self.keys[place[late]]
            hit = found == keys[late]
            out[late[hit]] = self.to[place[late[hit]]]
            late = late[~hit & (found >= 0)]
        return out


class Trie:
    """Forward scores by prefix; counts at the ends of pre-tokens."""

    def __init__(self, scores: Mapping[str, float], byte: float, words: int = WORDS, at_once: int = NODES_WORDS):
        self.scores, self.byte, self.words, self.at_once = scores, byte, words, at_once
        self.longest, self.pieces = max(map(len, scores), default=1), Pieces(scores)
        self.clear()

    def clear(self) -> None:
        self.terminal: dict[str, int] = {}
        self.before: dict[str, int] = {}
        self.scored = 0  # nodes whose forward score was taken

    def _alone(self, word: str) -> int:
        """Tokens of one word, prefix by prefix."""
        best, tokens, get = [0.0], [0], self.scores.get
        for d in range(1, len(word) + 1):
            n = len(word[d - 1].encode("utf-8", "surrogatepass"))
            top, count = best[d - 1] + n * self.byte, tokens[d - 1] + n
            for s in range(max(0, d - self.longest), d):
                x = get(word[s:d])
                if x is not None and (best[s] + x > top or best[s] + x == top and tokens[s] + 1 < count):
                    top, count = best[s] + x, tokens[s] + 1
            best.append(top)
            tokens.append(count)
        return tokens[-1]

    def _together(self, words: list[str]) -> np.ndarray:
        """Tokens of each of sorted distinct words (without mark, at most LONG characters with it)."""
        width = max(map(len, words)) + 1
        chars = np.array([MARK + w for w in words], f"<U{width}").view(np.uint32).reshape(len(words), width).astype(np.int64)
        length = np.array([len(w) + 1 for w in words])
        shared = np.zeros(len(words), np.int64)  # characters in common with the word before
        inside = np.arange(width) < np.minimum(length[1:], length[:-1])[:, None]
        shared[1:] = np.logical_and.accumulate((chars[1:] == chars[:-1]) & inside, axis=1).sum(1)
        out = np.zeros(len(words), np.int64)
        # of the depth above: where each word's node is, and of the nodes score, tokens and open pieces (node, score and tokens before, state)
        node, best, tokens = np.zeros(len(words), np.int64), np.zeros(1), np.zeros(1, np.int64)
        first, base, base_tokens, state = np.zeros(2, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for d in range(1, width + 1):
            rows = np.flatnonzero((length >= d) & (shared < d))
            above, ch = node[rows], chars[rows, d - 1]
            self.scored += len(rows)
            n = first[above + 1] - first[above]
            at = np.repeat(first[above] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            who = np.concatenate([np.repeat(np.arange(len(rows)), n), np.arange(len(rows))])
            base, base_tokens = np.concatenate([base[at], best[above]]), np.concatenate([base_tokens[at], tokens[above]])
            state = self.pieces.move(np.concatenate([state[at], np.zeros(len(rows), np.int64)]), ch[who])
            live = np.flatnonzero(state >= 0)
            live = live[np.argsort(who[live], kind="stable")]
            who, base, base_tokens, state = who[live], base[live], base_tokens[live], state[live]
            size = 1 + (ch >= 0x80) + (ch >= 0x800) + (ch >= 0x10000)
            best, tokens = best[above] + size * self.byte, tokens[above] + size
            x = base + self.pieces.score[state]
            np.maximum.at(top := best.copy(), who, x)
            tokens = np.where(top > best, 1 << 62, tokens)
            ends = x == top[who]
            np.minimum.at(tokens, who[ends], base_tokens[ends] + 1)
            best, first = top, np.searchsorted(who, np.arange(len(rows) + 1))
            fresh = np.zeros(len(words), np.int64)
            fresh[rows] = np.arange(len(rows))
            node = np.maximum.accumulate(fresh)
            over = np.flatnonzero(length == d)
            out[over] = tokens[node[over]]
        return out

    def insert(self, words: list[str]) -> None:
        """Stores the counts of the given pre-tokens (without mark)."""
        short = sorted(w for w in words if len(w) < LONG and w.isprintable())  # NumPy ends a string at its last NUL
        for s in range(0, len(short), self.at_once):
            part = short[s : s + self.at_once]
            self.terminal.update(zip(part, self._together(part).tolist(), strict=True))
        for w in words:
            if w not in self.terminal:
                self.terminal[w] = self._alone(MARK + w)

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        """(tokens, pre-tokens) of each text."""
        if len(self.terminal) > self.words:
            self.terminal, self.before = {}, self.terminal
        split = [t.split() for t in texts]
        new = set().union(*split) - self.terminal.keys()
        known = new & self.before.keys()
        self.terminal.update((w, self.before[w]) for w in known)
        self.insert(list(new - known))
        get = self.terminal.__getitem__
        out = [(sum(map(get, ws)), len(ws)) for ws in split]
        for w in new:  # long ones would fill the worker
            if len(w) >= LONG:
                del self.terminal[w]
        return out


_tries: dict[str, Trie] = {}


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tries:
            _tries[path] = Trie(*zipf_scores(path))
        for batch in slices(batches):
            got = _tries[path].count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], names=["doc_id", "n_tokens", "n_pretokens"])

    return run


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_pretokens of every row, a repeated row once for each time it stands there.

    Null, empty and blank texts have 0 of both; an empty table gives no rows. A very
    long text is counted whole; a pre-token of more than ``LONG`` characters is scored
    without the trie. Segmentations that tie count as the one of fewer tokens. Columns
    but doc_id and text play no part, whatever their names.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_count(path), f"doc_id {kind}, n_tokens long, n_pretokens long")
