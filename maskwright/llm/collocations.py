"""Collocations of each language, by count tries of limited depth.

Each task counts the texts of its shard in blocks: a block's trie has a node for each
word sequence of up to three words, children sorted by their words' bytes. It is written
level by level (parent, word, count) and cut into ranges of prefixes (language, first
word, second word), whose borders come from a bounded sample of the texts and only
balance the work; a large corpus deals each range out further by a hash of the prefix.
One task gets all tries of a range and merges them, k sorted runs at a level, adding up
counts; nodes below the least count go. Of what is left, each phrase meets its left
parts, the nodes on the walk to it, and its right parts, the nodes that its suffix links
lead to: a part of a phrase is at least as frequent as the phrase, so none is missing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_text, slices, stored, text_parts

DEPTH, LEAST, TOP = 3, 10, 2000
#: A phrase goes where a longer one that holds it has at least so many hundredths of its count.
INSIDE = 50
#: Words of a block.
BLOCK = 2_000_000
#: Bytes of text for each range, ranges at most (more text: each is dealt out by a hash), and documents sampled for their borders.
RANGE_BYTES, RANGES, SAMPLE = 8 << 20, 4096, 4096
#: Words sampled of a document.
SAMPLE_WORDS = 32

# capital letters to small ones, tabs to spaces, what separates pieces to full stops
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz .........")


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, and ``.`` between its pieces."""
    return text.translate(_PLAIN).replace(b".", b" . ").split()


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their summed counts, and the place of each given key; the stable sort merges sorted runs."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    first, place = np.flatnonzero(new), np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return ranked[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0], place


#: A trie: sorted words; for each level the parents (at the first level 0), words and counts of its nodes, sorted.
Trie = tuple[list[bytes], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def build(words: list[bytes], ids: np.ndarray, depth: int) -> Trie:
    """The trie of a block of ``ids``: 0 stands between pieces, i for ``words[i]``."""
    order = pc.array_sort_indices(pa.array(words[1:], pa.binary())).to_numpy().astype(np.int64)
    rank = np.full(len(words), -1, np.int64)
    rank[order + 1] = np.arange(len(order))
    at = rank[ids]
    node, levels = np.zeros(len(at), np.int64), []
    for level in range(depth):
        here = np.flatnonzero((node[: len(at) - level] >= 0) & (at[level:] >= 0))
        keys, counts, place = merged((node[here] << 32) | at[here + level], np.ones(len(here), np.int64))
        node = np.full(len(at), -1, np.int64)
        node[here] = place
        levels.append((keys >> 32, keys & 0xFFFFFFFF, counts))
    return [words[i + 1] for i in order.tolist()], levels


def selected(trie: Trie, chosen: list[np.ndarray]) -> Trie:
    """The nodes whose places ``chosen`` has for each level, with the nodes above them; those count 0 where they are not chosen."""
    words, levels = trie
    there = [c for c in chosen]
    for d in range(len(levels) - 1, 0, -1):
        there[d - 1] = np.union1d(there[d - 1], levels[d][0][there[d]])
    used = np.unique(np.concatenate([levels[d][1][there[d]] for d in range(len(levels))]))
    out = []
    for d, (parent, word, count) in enumerate(levels):
        own = np.isin(there[d], chosen[d], assume_unique=True)
        above = np.searchsorted(there[d - 1], parent[there[d]]) if d else parent[there[d]]
        out.append((above, np.searchsorted(used, word[there[d]]), np.where(own, count[there[d]], 0)))
    return [words[i] for i in used.tolist()], out


def packed(trie: Trie) -> bytes:
    """Serialised level by level, parents as differences, bytes of one weight together."""
    words, levels = trie
    text = b" ".join(words)
    head = np.array([len(text), len(levels), *(len(x[0]) for x in levels)], "<u4")
    planes = [np.ascontiguousarray(a.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes() for parent, word, count in levels for a in (np.diff(parent, prepend=0), word, count)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), text, *planes]))


def unpacked(blob: bytes) -> Trie:
    data = zstandard.ZstdDecompressor().decompress(blob)
    size, depth = np.frombuffer(data, "<u4", 2).tolist()
    nodes = np.frombuffer(data, "<u4", depth, 8).tolist()
    at = 8 + 4 * depth
    words, at, levels = data[at : at + size].split(b" ") if size else [], at + size, []
    for n in nodes:
        three = [np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at + 4 * n * k).reshape(4, n).T).view("<u4").ravel().astype(np.int64) for k in range(3)]
        levels.append((np.cumsum(three[0]), three[1], three[2]))
        at += 12 * n
    return words, levels


def merge(tries: list[Trie]) -> Trie:
    """One trie with the counts of all."""
    words = sorted(set().union(*(t[0] for t in tries)))
    number = {w: i for i, w in enumerate(words)}
    local = [np.array([number[w] for w in t[0]], np.int64) for t in tries]
    places, levels = [np.zeros(1, np.int64)] * len(tries), []
    for d in range(len(tries[0][1])):
        keys = np.concatenate([(p[t[1][d][0]] << 32) | w[t[1][d][1]] for p, w, t in zip(places, local, tries, strict=True)])
        keys, counts, place = merged(keys, np.concatenate([t[1][d][2] for t in tries]))
        places = np.split(place, np.cumsum([len(t[1][d][0]) for t in tries])[:-1])
        levels.append((keys >> 32, keys & 0xFFFFFFFF, counts))
    return words, levels


def phrases(trie: Trie, least: int) -> Iterator[tuple[int, bytes, int]]:
    """(words, phrase, count) of the nodes with ``least`` or more, walked down from the root."""
    words, levels = trie
    text: dict[int, bytes] = {0: b""}
    for d, (parent, word, count) in enumerate(levels):
        kept = np.flatnonzero(count >= least) if d + 1 == len(levels) else np.flatnonzero((count >= least) | np.isin(np.arange(len(count)), levels[d + 1][0][levels[d + 1][2] >= least]))
        below = {}
        for i, p, w, c in zip(kept.tolist(), parent[kept].tolist(), word[kept].tolist(), count[kept].tolist(), strict=True):
            below[i] = text[p] + b" " + words[w] if d else words[w]
            if c >= least:
                yield d + 1, below[i], c
        text = below


def _cuts(borders: list[tuple[bytes, bytes, bytes]], lang: bytes, words: list[bytes]) -> tuple[int, np.ndarray]:
    """The first range of a language, and where in its trie's prefixes each further one begins."""
    low = bisect_left(borders, (lang, b"", b""))
    cuts = []
    for other, one, two in borders[low:]:
        if other != lang:
            break
        i = bisect_left(words, one)
        cuts.append((i << 32) | (bisect_left(words, two) if i < len(words) and words[i] == one else 0))
    return low, np.array(cuts, np.int64)


def shard_tries(trie: Trie, lang: bytes, borders: list[tuple[bytes, bytes, bytes]], subs: int) -> Iterator[tuple[int, int, Trie]]:
    """(range, sub, trie): the trie cut by prefix ranges, each dealt to ``subs`` by a hash of the prefix."""
    words, levels = trie
    low, cuts = _cuts(borders, lang, words)
    hashed = np.array([zlib.crc32(w) for w in words], np.int64) if subs > 1 else np.zeros(len(words), np.int64)
    first = levels[0][1]
    group = [(low + np.searchsorted(cuts, first << 32, "right")) * subs + hashed[first] % subs]
    for d, (parent, word, _) in enumerate(levels[1:]):
        if d:
            group.append(group[-1][parent])
        else:
            one = first[parent]
            group.append((low + np.searchsorted(cuts, (one << 32) | word, "right")) * subs + (hashed[one] * 31 + hashed[word]) % subs)
    order = [np.argsort(g, kind="stable") for g in group]
    ranked = [g[o] for g, o in zip(group, order, strict=True)]
    for g in np.unique(np.concatenate(ranked)).tolist():
        yield g // subs, g % subs, selected(trie, [o[np.searchsorted(r, g) : np.searchsorted(r, g, "right")] for o, r in zip(order, ranked, strict=True)])


def _count(borders: list[tuple[bytes, bytes, bytes]], subs: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, _Words] = {}
        ids: dict[str, list[np.ndarray]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in words:
                trie = build(list(words[lang]), np.concatenate(ids[lang]), depth)
                rows = [(r, s, packed(t)) for r, s, t in shard_tries(trie, lang.encode(), borders, subs)]
                for i in range(0, len(rows), 64):
                    a, b, c = zip(*rows[i : i + 64], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], names=["lang", "range", "sub", "trie"])
            words.clear()
            ids.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = words.setdefault(lang, _Words({b".": 0}))
                mine = ids.setdefault(lang, [])
                for part in text_parts(text):
                    found = tokens(part)
                    mine.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                    held += len(found)
                mine.append(np.zeros(1, np.int32))
                if held >= BLOCK:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _merge(least: int):
    def run(table: pa.Table) -> pa.Table:
        tries: dict[str, list[Trie]] = {}
        for lang, blob in zip(table.column("lang").to_pylist(), table.column("trie").to_pylist(), strict=True):
            tries.setdefault(lang, []).append(unpacked(blob))
        rows = []
        for lang, some in tries.items():
            trie = merge(some)
            rows.append((lang, 0, b"", int(trie[1][0][2].sum())))
            rows += [(lang, *p) for p in phrases(trie, least)]
        a, b, c, d = zip(*rows, strict=True)
        return pa.table({"lang": pa.array(a, pa.string()), "words": pa.array(b, pa.int32()), "phrase": pa.array(c, pa.binary()), "f": pa.array(d, pa.int64())})

    return run


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = [w for part in text_parts(text) for w in tokens(part)]
            rows += [(lang.encode(), found[i], found[i + 1]) for i in range(0, len(found) - 1, max(1, len(found) // SAMPLE_WORDS)) if b"." not in found[i : i + 2]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (zip(*rows, strict=True) if rows else [[]] * 3)], names=["lang", "one", "two"])


def borders_of(rows: DataFrame, ranges: int, documents: int) -> list[tuple[bytes, bytes, bytes]]:
    """At most ``ranges - 1`` borders of prefix ranges, by a sample of some ``SAMPLE`` documents."""
    if ranges < 2:
        return []
    sample = rows.sample(min(1.0, SAMPLE / max(1, documents)), 7) if documents > SAMPLE else rows
    keys = sorted(tuple(bytes(x) for x in r) for r in sample.limit(2 * SAMPLE).mapInArrow(_sampled, "lang binary, one binary, two binary").collect())
    return sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []


def nodes(documents: DataFrame, least: int = LEAST, depth: int = DEPTH, range_bytes: int = RANGE_BYTES, most_ranges: int = RANGES) -> DataFrame:
    """lang, words, phrase, f of all word sequences with ``least`` occurrences or more, and rows of 0 words whose f add up to all words of the language."""
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), as_text().cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    wanted = max(1, (size["bytes"] or 0) // range_bytes)
    ranges = min(wanted, most_ranges)
    borders = borders_of(rows, ranges, size["n"])
    pieces = rows.mapInArrow(_count(borders, -(-wanted // ranges), depth), "lang string, range int, sub int, trie binary")
    found = pieces.groupBy("range", "sub").applyInArrow(_merge(least), "lang string, words int, phrase binary, f long")
    return found.withColumn("phrase", F.col("phrase").cast("string"))


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two or three words of each language.

    ``a`` counts a phrase, ``l`` and ``r`` the parts left and right of the cut with the
    least score, floor(1000000 a a / (l r)), in exact arithmetic; ``n`` counts all words.
    Phrases inside a longer one with ``inside`` hundredths of their count go. Ties go to
    the more frequent, then to the lesser phrase in UTF-8 byte order.

    Null text counts as empty, null language as ``und``. Repeated rows count as often as
    they stand there; very long texts count whole. An empty table gives no rows. Columns
    but text and lang play no part.
    """
    found = stored(nodes(documents, least), "nodes")
    total = found.groupBy("lang").agg(F.sum(F.when(F.col("words") == 0, F.col("f")).otherwise(0)).alias("n"))
    part = lambda n: F.substring_index("phrase", " ", n)
    candidates = found.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    # a suffix link leads from a phrase to what follows its first word
    pair, triple = F.array(cut(1, part(1), part(-1))), F.array(cut(1, part(1), part(-2)), cut(2, part(2), part(-1)))
    cuts = candidates.select("lang", "words", "phrase", "a", F.explode(F.when(F.col("words") == 2, pair).otherwise(triple)).alias("cut")).select("lang", "words", "phrase", "a", "cut.*")
    sides = found.filter("words > 0")
    side = lambda on, count: sides.select(F.col("lang").alias(f"_{count}"), F.col("phrase").alias(f"_{on}"), F.col("f").alias(count))
    met = lambda df, on, count: df.join(side(on, count), (F.col("lang") == F.col(f"_{count}")) & (F.col(on) == F.col(f"_{on}"))).drop(f"_{count}", f"_{on}")
    parts = met(met(cuts, "left", "l"), "right", "r")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = (F.lit(1_000_000).cast("decimal(7,0)") * (whole("a") * whole("a")).cast("decimal(31,0)"))
    parts = parts.withColumn("over", score.cast("decimal(38,0)")).withColumn("under", (whole("l") * whole("r")).cast("decimal(38,0)"))
    best = parts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(F.expr("over div under").cast("long").alias("score"), "k", "l", "r")).alias("best"))
    longer = candidates.filter("words = 3").select("lang", F.explode(F.array(part(2), part(-2))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    best = best.join(longer, ["lang", "phrase"], "left").filter((F.col("words") == 3) | F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a")))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: each of 64 buckets gives its first, one task a language ranks those
    some = best.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(W.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
