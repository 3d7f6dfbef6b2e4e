"""Generation by beam search over scores of next tokens, for many rows at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logits of the next token, (rows, beams, vocabulary), from a batch of rows and the tokens so far, (rows, beams, length).
Scores = Callable[[pa.RecordBatch, np.ndarray], np.ndarray]
_CELLS = 4_000_000
#: Log probabilities are multiples of this, so that their sums are exact and ties don't hang on the order of adding.
_GRAIN = 2.0**-24


def transition_scores(column: str, vocabulary: int) -> Scores:
    """Logits that depend on the last token alone: row ``last`` of the matrix (vocabulary x vocabulary) that each row has in ``column``."""

    def scores(batch: pa.RecordBatch, tokens: np.ndarray) -> np.ndarray:
        values = batch.column(column)
        if (np.diff(values.offsets.to_numpy()) != vocabulary * vocabulary).any():
            raise ValueError("a matrix must have vocabulary x vocabulary numbers")
        matrix = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, vocabulary, vocabulary)
        return matrix[np.arange(len(matrix))[:, None], tokens[:, :, -1]]

    return scores


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return np.rint((x - np.log(np.exp(x).sum(-1, keepdims=True))) / _GRAIN) * _GRAIN


def _penalised(logp: np.ndarray, tokens: np.ndarray, penalty: float, ngram: int) -> np.ndarray:
    """Tokens used before are made less likely; those that would repeat an n-gram, impossible."""
    seen = np.zeros(logp.shape, bool)
    np.put_along_axis(seen, tokens, True, -1)
    logp = np.where(seen, np.where(logp < 0, logp * penalty, logp / penalty), logp)
    if 0 < ngram <= tokens.shape[-1]:
        grams = np.lib.stride_tricks.sliding_window_view(tokens, ngram, -1)
        again = (grams[..., :-1] == tokens[:, :, None, tokens.shape[-1] - ngram + 1 :]).all(-1)
        row, beam, place = np.nonzero(again)
        logp[row, beam, grams[row, beam, place, -1]] = -np.inf
    return logp


def _greatest(values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of each row's ``k`` greatest, in order; ties to the first place."""
    left, rows = values.copy(), np.arange(len(values))
    at = np.empty((len(values), k), np.int64)
    found = np.full((len(values), k), -np.inf)
    for i in range(k):
        at[:, i] = left.argmax(1)
        found[:, i] = left[rows, at[:, i]]
        left[rows, at[:, i]] = -np.inf
    return at, found


class _Best:
    """The best finished sequence of each row, and how many were finished."""

    def __init__(self, n: int, length: int) -> None:
        self.score, self.count = np.full(n, -np.inf), np.zeros(n, np.int64)
        self.tokens, self.size, self.ended = np.zeros((n, length), np.int64), np.zeros(n, np.int64), np.zeros(n, bool)

    def offer(self, rows: np.ndarray, score: np.ndarray, tokens: np.ndarray, ended: bool) -> None:
        self.count[rows] += 1
        better = score > self.score[rows]
        rows, tokens = rows[better], tokens[better]
        self.score[rows], self.size[rows], self.ended[rows] = score[better], tokens.shape[1], ended
        self.tokens[rows, : tokens.shape[1]] = tokens


def _search(batch: pa.RecordBatch, scores: Scores, beams: int, max_length: int, min_length: int, penalty: float, power: float, ngram: int, start: int, end: int) -> _Best:
    n = batch.num_rows
    best = _Best(n, max_length)
    alive = np.arange(n)  # rows that go on
    tokens = np.full((n, beams, 1), start, np.int64)
    total = np.where(np.arange(beams) == 0, 0.0, -np.inf) + np.zeros((n, 1))
    for length in range(1, max_length):
        logp = _penalised(_log_softmax(np.asarray(scores(batch.take(pa.array(alive)), tokens), float)), tokens, penalty, ngram)
        if length < min_length:
            logp[:, :, end] = -np.inf
        vocabulary = logp.shape[-1]
        at, score = _greatest((logp + total[:, :, None]).reshape(len(alive), -1), min(2 * beams, beams * vocabulary))
        beam, token = at // vocabulary, at % vocabulary
        for rank in range(min(beams, at.shape[1])):
            hit = np.flatnonzero((token[:, rank] == end) & (score[:, rank] > -np.inf))
            whole = np.concatenate([tokens[hit, beam[hit, rank], 1:], np.full((len(hit), 1), end)], 1)
            best.offer(alive[hit], score[hit, rank] / length**power, whole, True)
        going = np.argsort(token == end, axis=1, kind="stable")[:, :beams]
        pick = lambda x: np.take_along_axis(x, going, 1)  # noqa: B023, E731
        total = np.where(pick(token) == end, -np.inf, pick(score))
        tokens = np.concatenate([np.take_along_axis(tokens, pick(beam)[:, :, None], 1), pick(token)[:, :, None]], 2)
        on = (best.count[alive] < beams) & (total > -np.inf).any(1)
        alive, tokens, total = alive[on], tokens[on], total[on]
        if not len(alive):
            return best
    for k in range(total.shape[1]):
        hit = np.flatnonzero(total[:, k] > -np.inf)
        best.offer(alive[hit], total[hit, k] / max(1, max_length - 1) ** power, tokens[hit, k, 1:], False)
    return best


def beam_search(
    rows: DataFrame, key: str, columns: Sequence[str], scores: Scores, vocabulary: int, *, beams: int = 4, max_length: int = 256, min_length: int = 3,
    repetition_penalty: float = 2.5, length_penalty: float = 1.5, no_repeat_ngram: int = 4, start: int = 0, end: int = 1,
) -> DataFrame:
    """key, tokens (after ``start``; the end's among them), score, ended: the best sequence found for each row.

    ``scores`` gives the logits of the next token from a batch of ``columns`` and the
    tokens so far; it runs in the tasks, so what it needs should be loaded there. In each
    step the log probabilities of tokens used before are multiplied by the penalty (divided
    where positive), tokens that would repeat an n-gram are impossible, and so is the end
    while there are fewer than ``min_length`` tokens, the start included. Of the 2 x beams
    best continuations those by the end are finished if among the first ``beams``, and the
    first ``beams`` others go on. A finished sequence has its summed log probabilities
    divided by its count of tokens, to the power of ``length_penalty``; log probabilities
    are rounded to 2^-24, so that equal sums tie in any order. A row is done with
    ``beams`` finished ones, or with none going on; at ``max_length`` tokens, the start
    included, what goes on counts as finished. Ties go to the beam, then the token, that
    comes first, and to what was finished first. Rows with a null among ``columns`` are
    left out; one without any possible sequence has no tokens and a null score.

    Nothing is shuffled; a task holds a few million scores at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, _CELLS // (beams * vocabulary))
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                got = _search(part, scores, beams, max_length, min_length, repetition_penalty, length_penalty, no_repeat_ngram, start, end)
                tokens = pa.array([t[:n] for t, n in zip(got.tokens, got.size, strict=True)], pa.list_(pa.int32()))
                score = pa.array(got.score, mask=np.isinf(got.score))
                yield pa.RecordBatch.from_arrays([part.column("_key"), tokens, score, pa.array(got.ended)], names=["_key", "tokens", "score", "ended"])

    kind = rows.schema[key].dataType.simpleString()
    given = rows.select(F.col(key).alias("_key"), *columns).dropna(subset=list(columns))
    return given.mapInArrow(run, f"_key {kind}, tokens array<int>, score double, ended boolean").withColumnRenamed("_key", key)
