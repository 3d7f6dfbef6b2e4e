import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import langid as L


def slow_grams(text):
    """Buckets one by one: every letter, pair and triple of the text between gaps, gaps as one."""
    x = [32, *[ord(c) if c.isalpha() else 32 for c in text.lower()], 32]
    x = x[:1] + [b for a, b in zip(x, x[1:], strict=False) if (a, b) != (32, 32)]
    m, out = (1 << 32) - 1, []
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        two = (a * 0x9E3779B1 & m) ^ (b * 0x85EBCA77 & m)
        hashes = [two + 1 & m, two ^ (c * 0xC2B2AE3D & m)] + ([b * 0x27D4EB2F & m] if b != 32 else [])
        out += [(((h ^ (h >> 15)) * 0x2C1B3C6D) & m) >> 17 for h in hashes]
    return sorted(out)


@settings(max_examples=80, deadline=None)
@given(st.text("abéßñÇ漢 \n.1x", max_size=30))
def test_grams(text):
    got = [g for g in L.grams(text)]
    assert sorted(np.concatenate(got).tolist() if got else []) == slow_grams(text)


@settings(max_examples=60, deadline=None)
@given(st.text("abéßΣ漢 \n.1x", max_size=40), st.integers(1, 7))
def test_pieces_give_the_grams_of_the_whole(text, size):
    whole, L.CHUNK = L.CHUNK, size
    try:
        got = [g for g in L.grams(text)]
    finally:
        L.CHUNK = whole
    assert sorted(np.concatenate(got).tolist() if got else []) == slow_grams(text)


@pytest.mark.parametrize("n", [2, 4, 5, 12])
def test_codewords_differ(n):
    code = L.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n
    assert all(abs(c.sum()) < n for c in code.astype(int).T)
    if n == 4:
        assert min((code[i] != code[j]).sum() for i in range(4) for j in range(i)) == 4


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = L.identify(docs).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in lang}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    text = {"en": "the cat sat on the mat and the dog was there", "de": "der hund und die katze sind nicht hier im haus"}
    rows = [(i, text["en" if i % 2 else "de"], "en" if i % 2 else "de") for i in range(12)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "123 ...", None), (None, text["de"], None), (103, text["en"] * 4000, None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(df).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[None][0] == "de" and got[103][0] == "en"
    kept = L.accepted(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(12)) | {None, 103}
    assert L.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in L.identify(df.withColumn("lang", df["lang"].substr(9, 9)).filter("lang IS NULL OR lang <> ''").limit(0)).collect()} == set()
