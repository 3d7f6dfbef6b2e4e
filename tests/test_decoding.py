"""Beam search, against all sequences and against a plain loop over rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright.operators import decoding


def weights(row, tokens, penalty, ngram, end, min_length):
    """Log probability of each possible next token."""
    top = max(row)
    logs = [round((x - top - math.log(sum(math.exp(y - top) for y in row))) * 2**24) / 2**24 for x in row]
    out = {}
    for t, x in enumerate(logs):
        grams = [tokens[i : i + ngram] for i in range(len(tokens) - ngram + 1)] if ngram else []
        if (*tokens[len(tokens) - ngram + 1 :], t) in grams or (t == end and len(tokens) < min_length):
            continue
        out[t] = x * penalty if t in tokens and x < 0 else x
    return out


def every(m, tokens, total, o):
    """All sequences with their scores."""
    if len(tokens) == o["max_length"]:
        yield total / (len(tokens) - 1) ** o["length_penalty"], tokens[1:]
        return
    for t, x in weights(m[tokens[-1]], tokens, o["repetition_penalty"], o["no_repeat_ngram"], 1, o["min_length"]).items():
        if t == 1:
            yield (total + x) / len(tokens) ** o["length_penalty"], (*tokens[1:], 1)
        else:
            yield from every(m, (*tokens, t), total + x, o)


def plain(m, beams, o):
    """The search of one row with lists."""
    live, done = [(0.0, (0,))], []
    while live and len(done) < beams and len(live[0][1]) < o["max_length"]:
        new = [(s + x, i, t) for i, (s, tokens) in enumerate(live) for t, x in weights(m[tokens[-1]], tokens, o["repetition_penalty"], o["no_repeat_ngram"], 1, o["min_length"]).items()]
        new = sorted(new, key=lambda v: (-v[0], v[1:]))[: 2 * beams]
        done += [(s / len(live[i][1]) ** o["length_penalty"], (*live[i][1][1:], 1)) for s, i, t in new[:beams] if t == 1]
        live = [(s, (*live[i][1], t)) for s, i, t in new if t != 1][:beams]
    if len(done) < beams:
        done += [(s / (len(tokens) - 1) ** o["length_penalty"], tokens[1:]) for s, tokens in live]
    return max(done, key=lambda x: x[0], default=(None, ()))


def frame(spark, matrices):
    return spark.createDataFrame([(i, [float(x) for x in np.ravel(m)]) for i, m in enumerate(matrices)], "id long, m array<double>").repartition(3)


def found(df):
    return {r.id: (r.score, tuple(r.tokens), r.ended) for r in df.collect()}


OPTIONS = {"max_length": 5, "min_length": 3, "repetition_penalty": 2.5, "length_penalty": 1.5, "no_repeat_ngram": 2}


@pytest.mark.parametrize("ngram", [0, 1, 2])
def test_wide_beams_find_the_best_of_all(spark, ngram):
    rng = np.random.default_rng(ngram)
    matrices, o = rng.normal(0, 2, (40, 4, 4)), OPTIONS | {"no_repeat_ngram": ngram}
    got = found(decoding.beam_search(frame(spark, matrices), "id", ["m"], decoding.transition_scores("m", 4), 4, beams=300, **o))
    for i, m in enumerate(matrices):
        scores = {tokens: s for s, tokens in every(m, (0,), 0.0, o)}
        score, tokens, _ = got[i]
        # orders of the same transitions tie but for rounding
        assert math.isclose(score, max(scores.values())) and math.isclose(scores[tokens], score)


@pytest.mark.parametrize("beams", [1, 2, 4])
@pytest.mark.parametrize("scale", [0.5, 4])
def test_equals_a_plain_search(spark, beams, scale):
    o = OPTIONS | {"max_length": 12, "no_repeat_ngram": 4}
    matrices = np.random.default_rng(beams).normal(0, scale, (60, 6, 6))
    matrices[:30, :, 1] += 2  # half of them end soon, half hardly
    matrices[30:, :, 1] -= 9
    got = found(decoding.beam_search(frame(spark, matrices), "id", ["m"], decoding.transition_scores("m", 6), 6, beams=beams, **o))
    for i, m in enumerate(matrices):
        score, tokens = plain(m, beams, o)
        assert got[i][1] == tokens and math.isclose(got[i][0], score) and got[i][2] == (tokens[-1] == 1)
    assert {v[2] for v in got.values()} == {True, False}


def test_batches_do_not_matter(spark, monkeypatch):
    matrices = np.random.default_rng(9).normal(0, 1, (50, 5, 5))
    run = lambda: found(decoding.beam_search(frame(spark, matrices), "id", ["m"], decoding.transition_scores("m", 5), 5, max_length=9))
    whole = run()
    monkeypatch.setattr(decoding, "_CELLS", 60)
    assert run() == whole and len(whole) == 50


def test_scores_of_any_history(spark):
    """A model that writes its row's number in tokens 2 and 3, then ends."""

    def scores(batch, tokens):
        out = np.full((*tokens.shape[:2], 4), -9.0)
        for i, n in enumerate(batch.column("n").to_pylist()):
            bits = [2 + int(b) for b in f"{n:b}"]
            for j, done in enumerate(tokens[i]):
                k = len(done) - 1
                out[i, j, bits[k] if k < len(bits) else 1] = 9.0
        return out

    df = spark.range(40).select(F.col("id").cast("string").alias("name"), F.when(F.col("id") != 7, F.col("id")).alias("n"))
    got = {r.name: r for r in decoding.beam_search(df, "name", ["n"], scores, 4, beams=1, repetition_penalty=1.0, no_repeat_ngram=0, min_length=1, max_length=20).collect()}
    assert set(got) == {str(i) for i in range(40) if i != 7}
    assert all(r.ended and r.tokens == [2 + int(b) for b in f"{int(name):b}"] + [1] for name, r in got.items())


def test_no_rows_and_wrong_shapes(spark):
    search = lambda df: decoding.beam_search(df, "id", ["m"], decoding.transition_scores("m", 2), 2)
    assert search(frame(spark, [np.zeros((2, 2))]).limit(0)).collect() == []
    # one token besides the end, and that cannot come twice: nothing is possible before the end may
    none = decoding.beam_search(frame(spark, [np.zeros((2, 2))]), "id", ["m"], decoding.transition_scores("m", 2), 2, no_repeat_ngram=1).collect()
    assert [(r.tokens, r.score, r.ended) for r in none] == [([], None, False)]
    with pytest.raises(Exception, match="vocabulary x vocabulary"):
        search(frame(spark, [np.zeros((2, 3))])).collect()
