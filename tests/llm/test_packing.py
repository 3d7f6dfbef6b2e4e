import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from maskwright.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string"


@cache
def library():
    return Tokenizer.from_file(PATH)


def brute_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids + [1]


def check(pieces, texts, capacity):
    """Every id in exactly one piece, checksums right, sequences gapless."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append((p.offset, p.length))
    for doc, text in texts.items():
        ids, at = brute_ids(text), 0
        for p in sorted(by_doc[doc], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(ids)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_tokenizer_equals_library():
    tok, whole = packing.WordTokenizer(PATH), library()
    for text in ["", "  ", "it's DON'T we'll x", "a\x1cb c", "a\x85b\xa0c d　e", "É é é ﬁ Ünï b½²", "İstanbul ΣΑΣ 漢字 テスト１２３ 👩‍👩‍👧", "x<|endoftext|>y <|endoftext|>", "***!!'s 'S", "soft­hyphen ªµº ÿŸ", "w" * 3000, "\u0000\u0007 a_b"]:
        assert tok.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = packing.pack(docs, PATH).collect()
    check(pieces, {r.doc_id: r.text for r in docs.collect()}, 2048)
    facts = packing.padding(spark.createDataFrame(pieces)).first()
    assert facts.padding <= 0.002 * facts.tokens + 2048


def test_edges(spark):
    long = "The quick brown fox jumps over it. " * 900
    rows = [(1, None), (2, ""), (3, long), (4, long), (5, "word " * 30), (6, "word " * 30), (7, "1 2 3")]
    docs = spark.createDataFrame([(i, t, None, None, 0, "x") for i, t in rows], DOCS)
    check(packing.pack(docs, PATH, 64).collect(), dict(rows), 64)
    assert packing.pack(docs.limit(0), PATH).collect() == []
    twice = packing.pack(docs.filter("doc_id = 5").union(docs.filter("doc_id = 5")), PATH, 64).collect()
    assert sum(p.length for p in twice) == 2 * len(brute_ids("word " * 30))
    none = packing.pack(spark.createDataFrame([(None, "a b")], "doc_id long, text string"), PATH).collect()
    assert [(p.doc_id, p.length) for p in none] == [(None, 3)]


def test_hot_length_is_cut(spark):
    docs = spark.createDataFrame([(i, "word " * 39) for i in range(200)], "doc_id long, text string")
    pieces = packing.pack(docs, PATH, 64).collect()
    check(pieces, {i: "word " * 39 for i in range(200)}, 64)
    assert len({p.sequence_id for p in pieces}) == 200 * 40 // 64


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), max_size=6), st.integers(0, 60))
def test_fill_is_best(counts, room):
    total, used = packing.fill(counts, room)
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    assert total == max(s for s in sums if s <= room)
    assert sum(x * n for x, n in used.items()) == total and all(n <= counts[x] for x, n in used.items())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 300), max_size=20))
def test_plan_places_each_once(histogram):
    plan = packing.plan_windows(histogram, 64, 2)
    seen, cuts = defaultdict(list), 0
    for length, n in histogram.items():
        window, offset = packing.place(plan, np.full(n, length), np.arange(n))
        for w, o in zip(window.tolist(), offset.tolist(), strict=True):
            first = min(length, 64 - o)
            seen[w].append((o, first))
            if first < length:
                cuts += 1
                seen[w + 1].append((0, length - first))
    assert cuts == packing.cut_rows(plan, histogram)
    assert sorted(seen) == list(range(plan.windows + plan.tail_windows))
    for w, parts in seen.items():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= 64 and (w >= plan.windows or at >= 62)


def test_one_id_for_all_rows_takes_linear_time(spark):
    """Remainders that are cut are found by their texts, whatever the ids."""
    words = "one two three four five six seven".split()
    texts = [" ".join(words[(i * j) % 7] for j in range(i % 61 + 2)) for i in range(20_000)]
    for one in (5, None):
        df = spark.createDataFrame([(one, t, "en", "s", 1, "x") for t in texts], DOCS)
        pieces = packing.pack(df, PATH, 64).collect()
        assert sum(p.length for p in pieces) == sum(map(len, map(brute_ids, texts)))
        by_seq = defaultdict(list)
        for p in pieces:
            by_seq[p.sequence_id].append((p.offset, p.length))
        for parts in by_seq.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64
