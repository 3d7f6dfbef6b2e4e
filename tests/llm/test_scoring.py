import math
import random
import re
import zlib
from collections import Counter

import pytest

from maskwright.llm import queries as Q
from maskwright.llm import scoring as S


def brute(rows, order=S.ORDER, mu=S.MU):
    """The model as recursion over dictionaries, from rows (doc_id, text): rows of results."""
    texts = []
    for doc, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        texts.append((doc, zlib.crc32(b"" if doc is None else str(doc).encode()) % 10 == 0, [*re.findall(r"[^\x20\x09-\x0D]+", text), "\n"]))
    count, context = Counter(), Counter()
    for _, held_out, words in texts:
        if not held_out:
            line = [" ", *words]
            for i in range(1, len(line)):
                for k in range(order):
                    if k <= i:
                        count[tuple(line[i - k : i + 1])] += 1
                        context[tuple(line[i - k : i])] += 1
    n, v = context[()], sum(len(g) == 1 for g in count)

    def chance(history, word):
        if not history:
            return (count[(word,)] + 0.1) / (n + 0.1 * (v + 1))
        return (count[(*history, word)] + mu * chance(history[1:], word)) / (context[history] + mu)

    out = []
    for doc, held_out, words in texts:
        line = [" ", *words]
        score = math.fsum(math.log10(chance(tuple(line[max(0, i - order + 1) : i]), line[i])) for i in range(1, len(line)))
        base = math.fsum(math.log10(chance((), w)) for w in words)
        out.append((doc, held_out, len(words), sum(count[(w,)] > 0 for w in words), n, base, score))
    return out


def same(df, want):
    key = lambda r: str(r[:4]) + f"{r[5]:.6f}"
    have = sorted((tuple(r) for r in df.collect()), key=key)
    assert len(have) == len(want)
    for a, b in zip(have, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-11) and a[6] == pytest.approx(b[6], rel=1e-11)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    words = "The the of É a\x00b cat sat Mat on x,y z.".split(" ")
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", " ", "\n", "\t ", "\x0b"]) for _ in range(draw.randint(0, 60)))
    out = [(i, text()) for i in range(150)]
    return out + out[:5] + [(200, None), (201, ""), (None, "the cat"), (202, "new words only " * 3), (203, "the cat sat on the mat " * 900)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, block long, score string")


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_recursion(spark, rows, order):
    same(S.scored(frame(spark, rows), order, 3.0), brute(rows, order, 3.0))


@pytest.mark.parametrize("order", [2, 3])
def test_blocks_segments_and_shards_change_nothing(spark, rows, order, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 300)
    monkeypatch.setattr(S, "SEGMENT", 7)
    monkeypatch.setattr(S, "SHARD_BYTES", 500)
    monkeypatch.setattr("maskwright.llm.common.TEXT_PART", 200)
    same(S.scored(frame(spark, rows), order, 3.0), brute(rows, order, 3.0))


def test_chances_add_up():
    rows = [(1, "a b a c"), (2, "a b b"), (3, "c a b")]
    rows = [(d, t) for d, t in rows if zlib.crc32(str(d).encode()) % 10]
    words = ["a", "b", "c", "\n", "unknown"]
    import numpy as np

    names = [S.BEGIN, S.FINISH, b"a", b"b", b"c", b"unknown"]
    number = {w: i for i, w in enumerate(names)}
    line = [[0, *(number[w.encode()] for w in t.split()), 1] for _, t in rows]
    probe = [[0, 2, w] for w in (2, 3, 4, 1, 5)]  # each word after "a"
    ids, sizes = np.array([x for s in line + probe for x in s]), np.array([len(s) for s in line + probe])
    room, scored = S.arrays(ids, sizes, np.array([1] * len(line) + [2] * len(probe)))
    grams = S.NGrams(ids, room, 2, len(names))
    totals = grams.counts(scored & (np.arange(len(ids)) < sizes[: len(line)].sum()))
    model = S.Automaton(grams, totals, int(totals[0].sum()), int((totals[0] > 0).sum()), 5.0)
    got = model.walk(ids, sizes, np.array([1] * len(line) + [2] * len(probe)))[len(line) :]
    assert sum(10**x for x in got) == pytest.approx(1) and len(got) == len(words)


def test_nothing_to_learn_from_and_empty_table(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    same(S.scored(frame(spark, [(held, "some words"), (held, None)])), brute([(held, "some words"), (held, None)]))
    assert S.scored(frame(spark, [])).count() == 0


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Q.op13_backoff_automaton(spark, sf)
    want = brute(rows)
    same(got, want)
    held_out = [r for r in want if r[1]]
    assert sum(r[6] for r in held_out) > sum(r[5] for r in held_out)
