import math
import random
import re
from collections import Counter

import numpy as np

from maskwright.llm import near_duplicates as N


def make(n, seed):
    rng = random.Random(seed)
    return [rng.choice("abcdefgh") + rng.choice("aeiou") + str(rng.randrange(400)) for _ in range(n)]


def edited(words, changes, seed):
    rng, out = random.Random(seed), list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return " ".join(out)


def grams(text):
    w = re.findall(r"\w+", text.lower())
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def brute_vector(text, df, n):
    """Weight of each shingle, one at a time, by exact document frequencies."""
    return {g: k * math.log(1 + 1 / max(df[g] / n, N.LEAST_SHARE)) for g, k in grams(text).items()}


def brute_similarity(x, y):
    least = sum(min(x[g], y[g]) for g in x if g in y)
    most = sum(x.values()) + sum(y.values()) - least
    return least / most if most else 0


def brute_classes(rows):
    df = Counter(g for _, t in rows if t is not None for g in grams(t))
    n = sum(t is not None for _, t in rows)
    texts = sorted({t for _, t in rows if t is not None})
    parent, vectors = {t: t for t in texts}, [brute_vector(t, df, n) for t in texts]

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            if root(a) != root(b) and brute_similarity(vectors[i], vectors[j]) >= 0.8:
                parent[root(a)] = root(b)
    least = {}
    for d, t in rows:
        if t is not None:
            least[root(t)] = min(d, least.get(root(t), d))
    return {d: d if t is None else least[root(t)] for d, t in rows}


def test_samples_follow_similarity():
    a = make(400, 1)
    for changes in (5, 20, 60):
        x, y = N.shingles(" ".join(a)), N.shingles(edited(a, changes, 2))
        want = N.weighted_jaccard(x, y)
        got = (N.samples(*x) == N.samples(*y)).mean()
        assert abs(want - got) < 0.2


def test_classes_equal_brute_force(spark):
    rows, base = [], [make(150, s) for s in range(12)]
    for s, words in enumerate(base):
        rows += [(100 * s + i, edited(words, i % 5, 1000 * s + i)) for i in range(15)]
    rows += [(5000 + i, " ".join(base[3])) for i in range(30)]  # copies
    rows += [(6000, None), (6001, None), (6002, ""), (6003, ""), (6004, "two words"), (6005, "Two words!"), (6006, "..."), (6007, "lone " * 40000), (6008, "lone " * 39990)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, label string")
    got = {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()}
    assert got == brute_classes([r for r in rows if r[0] not in (6007, 6008)]) | {6007: 6007, 6008: 6007}
    kept = N.distinct_documents(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "other text here")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id) for r in N.near_duplicates(df).collect()), key=str) == [(1, 1), (1, 1), (2, 1), (None, 1), (None, None)]
    assert sorted([r.doc_id for r in N.distinct_documents(df).collect()], key=str) == [1, None]
    assert N.near_duplicates(df.limit(0)).collect() == [] and N.distinct_documents(df.limit(0)).collect() == []


def test_large_bucket_rounds(spark):
    # one text with many edited copies: more than SMALL share each bucket
    words = make(200, 77)
    rows = [(0, " ".join(words))] + [(i, edited(words, 3, i)) for i in range(1, 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.near_duplicates(df).collect()
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want


def test_every_pair_of_a_bucket_is_met(spark):
    # 45 pairs of near copies dealt at random into one bucket of 90; few stand near each other or have the leader
    rng, texts = random.Random(5), []
    for s in range(45):
        words = make(60, 9000 + s)
        texts += [" ".join(words), edited(words, 1, s)]
    order = rng.sample(range(90), 90)
    rows = [(0, 7, [order[i], 0, 0], bytes([i]), i, 90, 1.0 * len(t.split()), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "band int, hash long, next array<long>, key binary, weight long, n long, total double, text string")
    sketch = np.ones((N.SKETCH_ROWS, 1 << N.SKETCH_BITS), np.float32)
    found = N._links(df.drop("text"), df.select("key", "text"), sketch, 0.8)
    assert {(r.a[0], r.b[0]) for r in found.collect()} == {(2 * s, 2 * s + 1) for s in range(45)}


def test_chains_equal_brute_force(spark):
    # each text is the one before with some words changed, so that similarities straddle 0.8
    rows = []
    for s in range(6):
        words = make(150, 500 + s)
        for i in range(25):
            rows.append((100 * s + i, " ".join(words)))
            words = edited(words, 3, 100 * s + i).split()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()} == brute_classes(rows)


def test_words_are_those_of_the_pattern():
    for text in ("It's a_b 12 x2.5", "Ünï ﬁ 漢字 テスト１ b½² É", "\U0001f600 a\x00b", "", "... !", "a b " * 40000, "x" * 70000 + " y " + "z_1 " * 20000 + "w" * 140000):
        words = re.findall(r"\w+", text.lower())
        hashes = N.word_hashes(text).tolist()
        assert len(words) == len(hashes)
        by_word = dict(zip(words, hashes, strict=True))
        assert [by_word[w] for w in words] == hashes and len(set(hashes)) == len(by_word)


def test_weights_do_not_depend_on_the_size(spark):
    # a line in a fifth of all documents, and one in a 256th, in tables of unlike sizes
    def table(n):
        text = lambda i: " ".join(make(40, i)) + (" a line that very many documents share" if i % 5 == 0 else "") + (" and this one is in rather few of all" if i % 256 == 0 else "")
        return spark.createDataFrame([(text(i),) for i in range(n)], "text string")

    sketch = [N.document_shares(table(n)) for n in (1280, 5120)]
    for line, share in (("a line that very many", 1 / 5), ("and this one is in", 1 / 256), ("never seen by any document", 0)):
        got = [float(N.weights(*N.shingles(line), x)[0]) for x in sketch]
        want = math.log(1 + 1 / max(share, N.LEAST_SHARE))
        assert all(abs(g - want) < 0.03 * want for g in got), (line, got, want)


def test_clashing_columns(spark):
    rows = [(i, "one two three four five six seven " + ("x" if i < 3 else "y" * i), i) for i in range(5)]
    df = spark.createDataFrame([(*r, *[7] * 6) for r in rows], "doc_id long, text string, key long, row_key int, id int, n int, row int, `a.b` int, kept_key int")
    got = N.distinct_documents(df)
    assert got.columns == df.columns and {r.key for r in got.collect()} == {0, 3, 4}


def test_join_by_rare_shingles_finds_all(spark):
    # families whose similarities lie around the threshold, beside a passage that all of them share
    rng, texts, passage = random.Random(3), [], make(60, 1)
    for s in range(40):
        words = make(rng.randrange(60, 160), 100 + s)
        texts += [" ".join(passage + words), *[edited(passage + words, rng.randrange(1, 9), 10 * s + i) for i in range(3)]]
    df = spark.createDataFrame([(bytes([i // 256, i % 256]), t) for i, t in enumerate(texts)], "key binary, text string")
    sketch = N.document_shares(df.select("text"))
    vectors = [(v, N.weights(v, k, sketch)) for v, k in map(N.shingles, texts)]
    rest = spark.createDataFrame([(bytes([i // 256, i % 256]), float(vectors[i][1].sum()), bytes([i // 256, i % 256]), t) for i, t in enumerate(texts)], "key binary, total double, label binary, text string")
    got = {(r.a[0] * 256 + r.a[1], r.b[0] * 256 + r.b[1]) for r in N._alike(rest, sketch, 0.8).collect()}
    want = {(j, i) for i in range(len(texts)) for j in range(i) if N.weighted_jaccard(vectors[j], vectors[i]) >= 0.8}
    assert want and want <= got and len(got) < 6 * len(texts)


def test_large_group_of_texts_that_are_not_alike(spark):
    # each copy of a short text has edits of its own: they share buckets, but no two are similar
    words = make(40, 5)
    rows = [(i, edited(words, 4, i)) for i in range(400)] + [(1000, " ".join(make(50, 6))), (1001, " ".join(make(50, 6)) + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.near_duplicates(df).collect()} == brute_classes(rows)


def test_recall_over_a_whole_table(spark):
    # by exact document frequencies; every similar pair of different texts must share a class
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    classes = {r.doc_id: r.class_id for r in N.near_duplicates(rows).collect()}
    texts = {r.doc_id: r.text for r in rows.filter("text IS NOT NULL").collect()}
    df = Counter(g for t in texts.values() for g in grams(t))
    first = {t: d for d, t in sorted(texts.items(), reverse=True)}
    vectors = sorted(((sum(v.values()), d, v) for t, d in first.items() if (v := brute_vector(t, df, len(texts)))), key=lambda x: x[:2])
    pairs = missed = 0
    for i, (total, d, x) in enumerate(vectors):
        for more, e, y in vectors[i + 1 :]:
            if total < 0.8 * more:  # too unlike in weight
                break
            if x.keys() & y.keys() and brute_similarity(x, y) >= 0.8:
                pairs, missed = pairs + 1, missed + (classes[d] != classes[e])
    print("similar pairs", pairs, "missed", missed)
    assert pairs > 0 and missed == 0  # this table has five such pairs and 73 copies
    assert all(classes[d] == classes[first[t]] for d, t in texts.items())


def test_one_large_group_is_linked_by_few_rows(spark, monkeypatch):
    # each text has links to a few others only, and no round reads again what is of one class already
    words = make(600, 11)
    rows = [(i, edited(words, 1, i)) for i in range(400)]
    read, stored = [], N.stored
    monkeypatch.setattr(N, "stored", lambda df, name: (out := stored(df, name), read.append((name, out.count())))[0])
    got = {r.doc_id: r.class_id for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and len(got) == 400
    assert sum(n for name, n in read if name == "links") < 6 * 400


def test_components_are_those_of_a_loop(spark):
    rng, pairs = random.Random(8), [(i, i + 1) for i in range(200, 260)]  # a path beside chance pairs
    pairs += [tuple(rng.sample(range(200), 2)) for _ in range(120)] + [(300, 300 + i) for i in range(1, 40)]
    name = rng.sample(range(400), 400)
    key = lambda i: bytes([name[i] // 256, name[i] % 256])
    least = {key(i): key(i) for p in pairs for i in p}
    for _ in least:
        for a, b in pairs:
            least[key(a)] = least[key(b)] = min(least[key(a)], least[key(b)])
    links = spark.createDataFrame([(key(a), key(b)) for a, b in pairs], "a binary, b binary")
    assert {bytes(r.key): bytes(r.label) for r in N.components(links).collect()} == least
    assert N.components(links.limit(0)).collect() == []


def test_few_texts_but_the_wanted_are_shuffled(spark, monkeypatch):
    rows = spark.range(20000).selectExpr("CASE WHEN id % 1000 > 0 THEN id END AS doc_id", "unhex(md5(cast(id AS string))) AS key", "concat('text ', id) AS text")
    wanted = rows.filter("crc32(text) % 40 = 0").selectExpr("doc_id AS _id", "key AS _key")
    want = {r.text for r in rows.filter("crc32(text) % 40 = 0").collect()}
    got = [r.text for r in N.likely(rows, wanted).collect()]
    assert want <= set(got) and len(got) < len(want) + 100 and len(set(got)) == len(got)
    monkeypatch.setattr(N, "FILTER_WORDS", 1)  # full: all pass
    assert N.likely(rows, wanted).count() == 20000 and N.likely(rows, wanted.limit(0)).count() == 0
