import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from maskwright.llm import collocations as C
from maskwright.llm import queries as Q

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=10, top=2000):
    """The contract as loops, from rows (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        dropped = {x for p, a in candidates.items() if len(p) == 3 for x in (p[:2], p[1:]) if x in candidates and 100 * a >= 50 * candidates[x]}
        found = []
        for p, a in candidates.items():
            if p not in dropped:
                score, _, l, r = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, words int, phrase string")


@pytest.fixture(scope="module")
def mixed():
    draw = random.Random(3)
    words = ["New", "york", "city", "the", "of", "a\x00b", "É", "x'y", "–", "z" * 50]
    glue = [" "] * 8 + ["\t", "  ", ". ", ",", "\n", "\x0b", " ", "! "]
    text = lambda: "".join(draw.choice(words) + draw.choice(glue) for _ in range(draw.randint(0, 120)))
    rows = [(text(), draw.choice(["en", "en", "en", None, "a\nb", "de"])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), ("one two. " * 9, "few"), ("one two. " * 10, "enough")] + [("same phrase here", "en")] * 30


def test_equals_loops(spark, mixed):
    assert got(C.collocations(frame(spark, mixed))) == brute(mixed)
    assert got(C.collocations(frame(spark, mixed), top=3)) == brute(mixed, top=3)


def test_ranges_hashes_and_blocks_change_nothing(spark, mixed, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 500)
    monkeypatch.setattr("maskwright.llm.common.TEXT_PART", 100)
    df = frame(spark, mixed)
    plain = sorted(tuple(r) for r in C.nodes(df).filter("words > 0").collect())
    for ranges, most in ((300, 4), (1000, 1), (2000, 64)):
        cut = sorted(tuple(r) for r in C.nodes(df, range_bytes=ranges, most_ranges=most).filter("words > 0").collect())
        assert cut == plain


def test_tries_keep_their_counts():
    draw = random.Random(1)
    words = [b".", *sorted({f"w{draw.randint(0, 40)}".encode() for _ in range(30)}, reverse=True)]
    import numpy as np

    halves = [np.array([draw.randint(0, len(words) - 1) for _ in range(900)], np.int32) for _ in range(2)]
    tries = [C.build(words, h, 3) for h in halves]
    want = Counter()
    for h in halves:
        ids = h.tolist()
        for k in (1, 2, 3):
            want.update(b" ".join(words[w] for w in ids[i : i + k]) for i in range(len(ids) - k + 1) if 0 not in ids[i : i + k])
    back = [C.unpacked(C.packed(t)) for t in tries]
    assert {p: n for _, p, n in C.phrases(C.merge(back), 1)} == want
    pieces = [t for trie in tries for _, _, t in C.shard_tries(trie, b"en", [(b"en", b"w2", b"w3"), (b"en", b"w2", b"w7")], 3)]
    assert {p: n for _, p, n in C.phrases(C.merge(pieces), 1)} == want


def test_counts_beyond_32_bits(spark):
    """a * a * 1,000,000 passes 64 bits."""
    df = frame(spark, [("ab cd. " * 400_000, "en")] * 12)
    assert got(C.collocations(df)) == [("en", 1, "ab cd", 4_800_000, 4_800_000, 4_800_000, 9_600_000, 1_000_000)]


def test_empty_table(spark):
    assert got(C.collocations(frame(spark, []))) == []


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(con.execute("SELECT " + ", ".join(COLUMNS) + f" FROM ({Q.COLLOCATION_SQL})").fetchall())
    assert got(Q.op12_phrase_tries(spark, sf)) == want
    assert want == brute([(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
