import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.llm import substrings as S

PASSAGE = " ".join(f"Sentence {i} of the passage has {i} special words in it." for i in range(8))


def brute(rows):
    """The rule as loops: rows of (doc_id, text) to cleaned texts."""
    first, found = {}, []
    for doc, text in sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        pieces = S.sentences(text)
        words = [re.findall(r"[^\W_]+", p.lower()) for p in pieces]
        filled = [i for i, w in enumerate(words) if w]
        for a in range(len(filled)):
            n, b = 0, a
            while b < len(filled) and n < 25:
                n += len(words[filled[b]])
                b += 1
            if b == a + 1 and n < 30:
                n += len(words[filled[b]]) if b < len(filled) else -99
                b += 1
            if n >= 25 and b <= len(filled):
                key = tuple(tuple(words[i]) for i in filled[a:b])
                found.append((key, (doc, text), filled[a], filled[b - 1]))
                first.setdefault(key, ((doc, text), filled[a]))
    gone = defaultdict(set)
    for key, row, a, b in found:
        if first[key] != (row, a):
            gone[row].update(range(a, b + 1))
    return {r: None if r[1] is None else "".join(p for i, p in enumerate(S.sentences(r[1])) if i not in gone[r]).rstrip() if gone[r] else r[1] for r in rows}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .!?\n。\"é ", max_size=60))
def test_pieces_make_the_text(text):
    assert "".join(S.sentences(text)) == text


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = S.dedup(docs)
    assert got.columns == [*docs.columns, "removed_sentences"]
    assert {(i, want[i, t]) for i, t in rows} == {(r.doc_id, r.text) for r in got.collect()}


def test_edges(spark):
    rows = [(1, "Intro here. " + PASSAGE + " End one."), (2, "Other start.\n" + PASSAGE.upper() + "\nEnd two."), (3, None), (4, ""), (5, "Short. Short. Short."), (6, PASSAGE), (6, PASSAGE), (None, "x " + PASSAGE), (7, "Line. " * 400), (8, "w" * 50000)]
    df = spark.createDataFrame([(*r, 7, "c") for r in rows], "doc_id long, text string, removed_sentences int, hash string")
    out = sorted(((r.doc_id, r.text, r.hash) for r in S.dedup(df).collect()), key=str)
    want = brute(rows)
    assert out == sorted(((i, want[i, t], "c") for i, t in rows), key=str)
    texts = dict(x[:2] for x in out)
    assert texts[2] == "Other start.\nEnd two." and texts[6] == "" and texts[5] == "Short. Short. Short." and texts[3] is None
    assert S.dedup(df.limit(0)).collect() == []


def test_ends_of_passages(spark):
    # the last sentences have under 25 words together, and the run before closes earlier
    for sizes in ((30, 22), (10, 20, 16, 8), (40, 3), (12, 12, 12, 12, 1)):
        passage = " ".join(" ".join(f"w{k}x{i}" for i in range(n)) + "." for k, n in enumerate(sizes))
        rows = [(1, f"One begins. {passage} It goes on in one way."), (2, f"Two begins. {passage} Here another way is taken.")]
        got = {r.doc_id: r.text for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string"), both_ends=True).collect()}
        assert got == {1: rows[0][1], 2: "Two begins. Here another way is taken."}


def test_documents_by_both_ends(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, found = {}, []
    for row in sorted({(r.doc_id, r.text) for r in docs.collect()}):
        pieces = S.sentences(row[1])
        words = [re.findall(r"[^\W_]+", p.lower()) for p in pieces]
        filled = [i for i, w in enumerate(words) if w]

        def fits(a, b):
            n = sum(len(words[i]) for i in filled[a:b])
            return n >= 25 and (b - a > 1 or n >= 30)

        spans = set()
        for i in range(len(filled)):
            spans |= {(i, b) for b in [next((b for b in range(i + 1, len(filled) + 1) if fits(i, b)), None)] if b}
            spans |= {(a, i + 1) for a in [next((a for a in range(i, -1, -1) if fits(a, i + 1)), None)] if a is not None}
        for a, b in sorted(spans):
            key = tuple(tuple(words[i]) for i in filled[a:b])
            found.append((key, row, filled[a], filled[b - 1]))
            first.setdefault(key, (row, filled[a]))
    gone = defaultdict(set)
    for key, row, a, b in found:
        if first[key] != (row, a):
            gone[row].update(range(a, b + 1))
    got = {(r.doc_id, r.text): r.removed_sentences for r in S.dedup(docs, both_ends=True).collect()}
    want = {(r.doc_id, "".join(p for i, p in enumerate(S.sentences(r.text)) if i not in gone[r]).rstrip() if gone[r] else r.text): len(gone[r]) for r in docs.select("doc_id", "text").collect()}
    assert got == want


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, "X y. " + PASSAGE, 1, 2, 3, 4), (2, PASSAGE, 1, 2, 3, 4)], "doc_id long, text string, _row int, _marks int, row int, `a.b` int")
    got = S.dedup(df)
    assert got.columns == [*df.columns, "removed_sentences"]
    assert sorted((r.doc_id, r.text, r["a.b"], r.row) for r in got.collect()) == [(1, "X y. " + PASSAGE, 4, 3), (2, "", 4, 3)]
