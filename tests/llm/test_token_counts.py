import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCORES = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.5, "▁a": -4.0, "aba": -6.0, "ba": -4.5, "é": -5.0}


def brute(word, scores, byte):
    """All segmentations: (score, -tokens) at its best."""
    if not word:
        return 0.0, 0
    n = len(word[-1].encode())
    s, c = brute(word[:-1], scores, byte)
    best = (s + n * byte, c - n)
    for i in range(len(word)):
        if word[i:] in scores:
            s, c = brute(word[:i], scores, byte)
            best = max(best, (s + scores[word[i:]], c - 1))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé漢", min_size=1, max_size=7), min_size=1, max_size=6))
def test_trie_equals_all_segmentations(words):
    trie = T.Trie(SCORES, -9.0)
    got = trie.count([" ".join(words)])[0]
    assert got == (sum(-brute("▁" + w, SCORES, -9.0)[1] for w in words), len(words))


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(12)
    scores, byte = T.zipf_scores(PATH)
    one = T.Trie(scores, byte)
    got = {r.doc_id: (r.n_tokens, r.n_pretokens) for r in T.token_counts(docs, PATH).collect()}
    for r in docs.collect():
        total = 0
        for w in r.text.split():
            one.clear()
            total += one.count([w])[0][0]
        assert got[r.doc_id] == (total, len(r.text.split()))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n ", 1), (4, "x" * 3000, 1), (4, "x" * 3000, 1), (None, "a a", 1)], "doc_id long, text string, n_tokens int")
    got = T.token_counts(df, PATH).collect()
    assert [(r.doc_id, r.n_pretokens) for r in got] == [(1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (None, 2)]
    assert all((r.n_tokens == 0) == (r.n_pretokens == 0) for r in got) and got[3].n_tokens == got[4].n_tokens
    assert T.token_counts(df.limit(0), PATH).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abé漢\x00\U0001f600", min_size=1, max_size=60), min_size=1, max_size=30), st.integers(1, 5), st.integers(1, 6))
def test_limits_change_nothing(words, at_once, kept):
    texts = [" ".join(words[i : i + 4]) for i in range(0, len(words), 4)] * 2
    small = T.Trie(SCORES, -9.0, words=kept, at_once=at_once)
    whole = T.Trie(SCORES, -9.0).count(texts)
    assert [small.count([t])[0] for t in texts] == whole
    assert len(small.terminal) <= kept + 4 and len(small.before) <= kept + 4


def test_shared_prefixes_are_scored_once():
    words = ["ab", "aba", "abab", "b", "ba"]
    trie = T.Trie(SCORES, -9.0)
    trie.count([" ".join(words)])
    assert trie.scored == len({("▁" + w)[:d] for w in words for d in range(1, len(w) + 2)})
