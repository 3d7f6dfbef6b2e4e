"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words (a shorter text is one shingle),
weighted by how often each occurs times ``ln(1 + 1 / share)``, where ``share`` is the
share of all documents that hold it, ``LEAST_SHARE`` at least: what fewer documents
hold counts as rare and weighs the same in a table of any size. Shares come from a
count-mean sketch over all documents: three rows of counters, of each counter what
is expected of other shingles taken off, the median of the three. The error is a
share of the documents that does not grow with the table, well below ``LEAST_SHARE``,
and the sketch, which goes to the executors, has a fixed size.

Consistent weighted sampling draws ``BANDS x ROWS`` samples from a text, each equal
for two texts with the probability of their weighted Jaccard similarity; texts that
agree in all samples of a band share a bucket.

Pairs of a bucket grow with the square of its size, so buckets are spanned by a
number of candidate pairs that is linear in their texts: each text with the
bucket's leader, the text that shares most buckets with others, and then, unless
they are of one class by now, with the ``NEAREST`` texts before it when the bucket is
sorted by the hashes of the next bands, where texts that agree in more bands stand
together (a bucket of up to ``NEAREST + 1`` texts gets all its pairs). Texts that are
not in the leader's class get a leader of their own, again and again until a round
links nothing new.

What that leaves is joined exactly: of the texts of each bucket that still holds more
than one class, all similar pairs. Two texts of total weights W <= V are similar only
if the shingles they share weigh at least ``t / (1 + t) (W + V)``. So with shingles
ordered by document share, the rarest first, one of the shingles that begin the
lighter text, up to a weight of ``(1 - 2 t / (1 + t)) W``, must be among those that begin
the heavier one, up to ``(1 - t) V``; and from the first that they share, what is left
of either must weigh enough. Texts that share common passages but are not alike
begin with rare shingles of their own and so never meet; those alike are of one class
by then. So in the end any two texts that share a bucket are in one class or have been
compared, or their weights rule the similarity out. Each candidate pair is verified by
its exact weighted Jaccard similarity. Verified links make components; equal texts are
one node throughout.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, stored, unpacked, whole_rows

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Rows of the sketch, and counters of a row as a power of two.
SKETCH_ROWS, SKETCH_BITS = 3, 17
#: Shingles in fewer of all documents than this share weigh alike.
LEAST_SHARE = 1 / 512
#: Neighbours in a bucket's order that a text is compared with.
NEAREST = 3
#: Shingles that are sampled at once.
CHUNK = 1024
#: Words of 64 bits of the filter that spares texts without a bucket mate a shuffle.
FILTER_WORDS = 1 << 17
#: Characters whose words are hashed at once.
PIECE = 1 << 16

_rng = np.random.default_rng(20)
_SKETCH_MUL = (_rng.integers(1, 1 << 63, SKETCH_ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)
_C1, _C2, _C3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
#: Whether a code point below 0x250 is of a word.
_LATIN = np.array([chr(c).isalnum() or c == 95 for c in range(0x250)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> list[np.ndarray]:
    """Powers of the odd base modulo 2^64, and their inverses."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, PIECE), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word (run of letters, digits and underscores, in lower case) of a whole text."""
    text = text.lower()
    if text.isascii():
        x = np.frombuffer(text.encode(), np.uint8)
        part = _LATIN[x]
    else:
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        part = _LATIN[np.minimum(x, 0x24F)]
        far = np.flatnonzero(x >= 0x250)
        if len(far):
            kinds, at = np.unique(x[far], return_inverse=True)
            part[far] = np.array([chr(c).isalnum() for c in kinds.tolist()])[at]
    out, start, gaps = [], 0, np.flatnonzero(~part) if len(x) > PIECE else None
    while start < len(x):
        end = len(x)
        if end - start > PIECE:  # a piece ends at the last gap within reach, or else at the next one
            k = int(np.searchsorted(gaps, start + PIECE, "right"))
            if k and gaps[k - 1] >= start:
                end = int(gaps[k - 1]) + 1
            elif k < len(gaps):
                end = int(gaps[k]) + 1
        edge = np.diff(part[start:end], prepend=False, append=False)
        first, last = np.flatnonzero(edge).reshape(-1, 2).T
        up, down = _powers_to(end - start)
        c = (x[start:end].astype(np.uint64) + np.uint64(1)) * _C1
        c ^= c >> np.uint64(29)
        c *= up[: end - start]
        total = np.concatenate([[np.uint64(0)], np.cumsum(c, dtype=np.uint64)])
        out.append(_mix((total[last] - total[first]) * down[first]))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the distinct shingles of a whole text, and how often each occurs."""
    w = word_hashes(text)
    if not len(w):
        return w, np.zeros(0)
    n = min(SHINGLE, len(w))
    x = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        x = x * _C3 + w[i : len(w) - n + 1 + i]
    values, times = np.unique(_mix(x), return_counts=True)
    return values, times.astype(float)


def counters(values: np.ndarray, row: int) -> np.ndarray:
    return ((values * _SKETCH_MUL[row]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shares(values: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The share of all documents that hold each shingle: the median of its three counters."""
    a, b, c = (sketch[r][counters(values, r)] for r in range(SKETCH_ROWS))
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def weights(values: np.ndarray, times: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return times * np.log1p(1 / np.maximum(shares(values, sketch), np.float32(LEAST_SHARE)))


def _gamma_quantiles(n: int) -> np.ndarray:
    """The middle of each n-th part of the gamma(2, 1) distribution, by halving."""
    p, low, high = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return low


_R = _gamma_quantiles(1 << 12)
_R, _PER_R, _LN_C = _R.astype(np.float32), (1 / _R).astype(np.float32), np.log(_gamma_quantiles(1 << 16)).astype(np.float32)
_U1, _U2 = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_LOW, _HIGH, _NEXT = ((_rng.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) << np.uint32(1)) | np.uint32(1) for _ in range(3))
_ADD = _rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def samples(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One 64-bit sample (shingle and level) for each draw.

    A draw's r and c of a shingle are gamma(2, 1) and its beta uniform, all three from
    32-bit hashes of shingle and draw. ``level = floor(ln weight / r + beta)``; the
    least ``ln c - r (level - beta) - r`` wins.
    """
    n = BANDS * ROWS
    best, out, draws = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64), np.arange(n)
    log_weight = np.log(weight).astype(np.float32)
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    for s in range(0, len(values), CHUNK):
        x, y = low[None, s : s + CHUNK] * _LOW, high[None, s : s + CHUNK] * _HIGH
        x ^= y
        x += _ADD
        x ^= x >> np.uint32(16)
        x *= _U1
        x ^= x >> np.uint32(13)
        x *= _U2
        x ^= x >> np.uint32(16)
        y = x * _NEXT
        y ^= y >> np.uint32(15)
        x >>= np.uint32(20)
        beta = (y & np.uint32(0xFFFF)).astype(np.float32)
        beta *= np.float32(2.0**-16)
        y >>= np.uint32(16)
        level = _PER_R.take(x)
        level *= log_weight[None, s : s + CHUNK]
        level += beta
        np.floor(level, out=level)
        beta -= level
        beta -= np.float32(1)
        beta *= _R.take(x)
        beta += _LN_C.take(y)
        j = beta.argmin(1)
        found = beta[draws, j]
        less = found < best
        best = np.where(less, found, best)
        sample = values[s + j] ^ (level[draws, j].astype(np.int64).astype(np.uint64) * _C3)
        out = np.where(less, sample, out)
    return out


def bands(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = samples(values, weight).reshape(BANDS, ROWS)
    out = np.arange(BANDS).astype(np.uint64)
    for i in range(ROWS):
        out = _mix(out * _C3 + x[:, i])
    return out.astype(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser weights over sum of the greater, of two sorted sparse vectors."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most else 0.0


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((SKETCH_ROWS, 1 << SKETCH_BITS), np.int64)
    for batch in slices(batches):
        for r in range(0, batch.num_rows, 64):
            found = [shingles(t)[0] for t in batch.column(0).slice(r, 64).to_pylist()]
            values = np.concatenate(found)
            for row in range(SKETCH_ROWS):
                total[row] += np.bincount(counters(values, row), minlength=1 << SKETCH_BITS)
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total.ravel()[there], pa.int64())], names=["counter", "n"])


def document_shares(texts: DataFrame) -> np.ndarray:
    """The sketch over all rows of ``texts``: by row and counter the share of rows, of one row at least."""
    table = texts.mapInArrow(_frequencies, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SKETCH_ROWS << SKETCH_BITS)
    n[table.column("counter").to_numpy()] = table.column("n").to_numpy()
    n = n.reshape(SKETCH_ROWS, -1)
    others = (n.sum(1, keepdims=True) - n) / (n.shape[1] - 1)
    return np.clip(np.maximum((n - others) / (1 - 1 / n.shape[1]), 1) / max(1, texts.count()), 0, 1).astype(np.float32)


def _sign(sketch: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # a text that came before in this task need not be sampled again
        for batch in slices(batches):
            out: list[np.ndarray | None] = []
            totals: list[float | None] = []
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key in done:
                    out.append(None)
                    totals.append(None)
                    continue
                if len(done) < 1_000_000:
                    done.add(key)
                values, times = shingles(text)
                weight = weights(values, times, sketch)
                out.append(bands(values, weight) if len(values) else None)
                totals.append(float(weight.sum()) if len(values) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64())), pa.array(totals, pa.float64())], names=["doc_id", "key", "bands", "total"])

    return run


def _verify(sketch: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()

        def vector(key: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            if key not in recent:
                values, times = shingles(text)
                recent[key] = values, weights(values, times, sketch)
                if len(recent) > 64:
                    recent.popitem(last=False)
            return recent[key]

        for batch in slices(batches):
            a, b, x, y = (batch.column(n).to_pylist() for n in ("a", "b", "text_a", "text_b"))
            same = [weighted_jaccard(vector(*p), vector(*q)) >= least for p, q in zip(zip(a, x, strict=True), zip(b, y, strict=True), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return run


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def components(links: DataFrame) -> DataFrame:
    """key, label: the least key of each key's component, for the pairs (a, b) of ``links``.

    A round sends each key to the least neighbour of its least neighbour (itself among them),
    and links to those between the keys sent to: what is linked stays linked. Only links
    that still tell keys apart reach the next round, so all rounds together read few more than the first.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not rounds or not edges.isEmpty():
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("near"))
        near = stored(near, "near")
        jump = near.select(F.col("key").alias("_k"), F.col("near").alias("label"))
        sent = stored(near.join(jump, F.col("near") == F.col("_k")).select("key", "label"), "labels")
        side = lambda n: sent.select(F.col("key").alias(n), F.col("label").alias(f"_{n}"))  # noqa: B023, E731
        left = edges.join(side("a"), "a").join(side("b"), "b").filter("_a != _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        left = stored(left.distinct(), "links")
        discard(edges, near)
        edges = left
        rounds.append(sent)
    discard(edges)
    labels = rounds.pop()
    while rounds:
        last, before = labels, rounds.pop()
        ends = last.select(F.col("key").alias("_k"), F.col("label").alias("_l"))
        labels = stored(before.join(ends, F.col("label") == F.col("_k"), "left").select("key", F.coalesce("_l", "label").alias("label")), "labels")
        discard(last, before)
    return labels


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (band, hash, key) to pairs of rows of one bucket at most ``NEAREST`` places apart."""
    last: list[tuple[int, int, bytes]] = []
    for batch in batches:
        a, b = [], []
        for row in zip(*(batch.column(n).to_pylist() for n in ("band", "hash", "key")), strict=True):
            for before in last:
                if before[:2] == row[:2] and before[2] != row[2]:
                    a.append(min(before[2], row[2]))
                    b.append(max(before[2], row[2]))
            last = [*last[1 - NEAREST :], row] if NEAREST > 1 else [row]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _links(buckets: DataFrame, texts: DataFrame, sketch: np.ndarray, least: float) -> DataFrame | None:
    """Verified pairs (a, b), a < b, of the texts that share buckets: rows (band, hash, next, key, weight, n, total).

    Their components are those of all similar pairs that share a bucket.
    """
    if buckets.isEmpty():
        return None
    side = lambda n: texts.select(F.col("key").alias(n), F.col("text").alias(f"text_{n}"))

    def star(rows: DataFrame) -> DataFrame:
        # stored, so that the join deals a large bucket anew instead of taking it where it was summed
        tops = stored(rows.groupBy("band", "hash").agg(F.max(F.struct("weight", "key")).alias("top")), "tops")
        return rows.join(tops, ["band", "hash"]).filter(F.col("key") != F.col("top.key")).select("band", "hash", "key", "weight", F.col("top.key").alias("leader"))

    def verified(pairs: DataFrame) -> DataFrame:
        return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_verify(sketch, least), "a binary, b binary"), "same")

    def ordered(x: DataFrame) -> DataFrame:
        return x.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()

    order = ["band", "hash", "next", "key"]
    near = stored(buckets.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, "a binary, b binary").distinct(), "near")
    led = stored(star(buckets), "led")
    found = verified(ordered(led))
    while True:
        labels = components(found)
        side_of = lambda n: labels.select(F.col("key").alias(n), F.col("label").alias(f"_{n}"))  # noqa: B023, E731
        apart = lambda rows, x, y: rows.join(side_of(x), x, "left").join(side_of(y), y, "left").filter(F.coalesce(f"_{x}", x) != F.coalesce(f"_{y}", y))  # noqa: B023, E731
        led = stored(star(apart(led, "key", "leader").select("band", "hash", "key", "weight")), "led")
        if led.isEmpty():  # then all of a bucket are in one class, neighbours too
            break
        pairs = ordered(led)
        if near is not None:  # neighbours that the leaders already brought together need no link of their own
            pairs, near = pairs.union(apart(near, "a", "b").select("a", "b")).distinct(), None
        more = verified(pairs.join(found, ["a", "b"], "left_anti"))
        if more.isEmpty():
            break
        found = found.unionByName(more)
    named = buckets.filter(F.col("n") > NEAREST + 1).select("band", "hash", "key", "total").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = stored(named.groupBy("band", "hash").agg(F.min("label").alias("_least"), F.max("label").alias("_most")).filter("_least != _most").select("band", "hash"), "mixed")
    if mixed.isEmpty():
        return found
    rest = stored(named.join(mixed, ["band", "hash"]).groupBy("key").agg(F.first("total").alias("total"), F.first("label").alias("label")), "rest")
    more = verified(_alike(rest.join(texts, "key"), sketch, least))
    return found if more.isEmpty() else found.unionByName(more)


def _beginnings(sketch: np.ndarray, least: float):
    """The rarest shingles of each text: of what it must share one with any text that is no lighter (``lighter``) or no heavier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parent, found, lighter, left, total = [], [], [], [], []
            for row, text in enumerate(batch.column(3).to_pylist()):
                values, times = shingles(text)
                weight = weights(values, times, sketch)
                order = np.lexsort((values, shares(values, sketch)))
                before = np.cumsum(weight[order]) - weight[order]  # a shingle is taken if those before it don't fill the beginning
                n = int(np.searchsorted(before, (1 - least) * weight.sum() + 1e-6, "right"))
                parent.append(np.full(n, row))
                found.append(values[order[:n]])
                lighter.append(before[:n] <= (1 - 2 * least / (1 + least)) * weight.sum() + 1e-6)
                left.append(weight.sum() - before[:n])
                total.append(np.full(n, weight.sum()))
            who = pa.array(np.concatenate(parent))
            columns = [pa.array(np.concatenate(found).view(np.int64)), batch.column(0).take(who), pa.array(np.concatenate(total)), batch.column(2).take(who), pa.array(np.concatenate(lighter)), pa.array(np.concatenate(left))]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "key", "total", "label", "lighter", "left"])

    return run


def _alike(rest: DataFrame, sketch: np.ndarray, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of unlike labels among the rows (key, total, label, text), with all whose similarity is ``least`` or more."""
    rows = rest.select("key", "total", "label", "text").mapInArrow(_beginnings(sketch, least), "shingle long, key binary, total double, label binary, lighter boolean, left double")
    rows = stored(rows, "beginnings")
    met = stored(rows.groupBy("shingle").agg(F.min("label").alias("_least"), F.max("label").alias("_most")).filter("_least != _most").select("shingle"), "met")
    rows = stored(rows.join(met, "shingle"), "meeting")
    side = lambda df, n: df.select("shingle", F.col("key").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("total", "label", "left")])
    order = (F.col("total_x") < F.col("total_y")) | (F.col("total_x") == F.col("total_y")) & (F.col("x") < F.col("y"))
    # at the first shingle that two texts share, they share no more than what is left of either
    enough = F.least("left_x", "left_y") >= F.lit(least / (1 + least)) * (F.col("total_x") + F.col("total_y")) - 1e-6
    pairs = side(rows.filter("lighter"), "x").join(side(rows, "y"), "shingle").filter((F.col("label_x") != F.col("label_y")) & order & enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows (doc_id, key, text) that ``wanted`` (_id, _key) may hold: all that it does, and few others.

    Each wanted row sets a bit of a filter of fixed size, which goes to the executors. A
    full filter lets all rows pass, so what follows must join exactly.
    """
    spot = lambda key, doc: F.xxhash64(key, doc)
    word, bit = F.pmod(F.shiftright("_spot", 6), F.lit(FILTER_WORDS)), F.expr("shiftleft(1L, cast(_spot & 63 as int))")
    bits = wanted.select(spot("_key", "_id").alias("_spot")).select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_spot", spot("key", "doc_id")).withColumn("_at", word).join(F.broadcast(bits), F.col("_at") == F.col("_word"))
    return found.filter(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)


def _classes(documents: DataFrame, least: float) -> DataFrame:
    """doc_id, key, class_id, kept_key: for every row its text's key, the class, and the text that stands for the class."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.filter(F.col("text").isNotNull()).select("doc_id", text_key(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
    sketch = document_shares(rows.select("text"))
    signed = stored(rows.mapInArrow(_sign(sketch), f"doc_id {kind}, key binary, bands array<long>, total double"), "signed")
    texts = stored(signed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("bands").alias("bands"), F.max("total").alias("total")), "texts")
    spread = texts.filter(F.col("bands").isNotNull()).select("key", "total", "bands", F.posexplode("bands").alias("band", "hash"))
    spread = spread.withColumn("next", F.array(*[F.get("bands", (F.col("band") + i) % BANDS) for i in (1, 2, 3)])).drop("bands")
    sizes = stored(spread.groupBy("band", "hash").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    shared = stored(spread.join(sizes, ["band", "hash"]), "shared")
    central = stored(shared.groupBy("key").agg(F.sum("n").alias("weight")), "central")
    wanted = stored(texts.join(central, "key", "left_semi").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")), "wanted")
    there = likely(rows, wanted).join(wanted, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "text").dropDuplicates(["key"])
    found = _links(shared.join(central, "key"), stored(there, "there"), sketch, least)
    if found is None:
        return signed.join(texts.select("key", F.col("doc_id").alias("class_id")), "key").select("doc_id", "key", "class_id", F.col("key").alias("kept_key"))
    labels = components(found)
    named = texts.select("key", "doc_id").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    heads = named.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("head"))
    named = named.join(heads, "label").select("key", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("kept_key"))
    return signed.select("doc_id", "key").join(named, "key").select("doc_id", "key", "class_id", "kept_key")


def near_duplicates(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id for every row; class_id is the least doc_id of the class.

    Equal texts (empty ones too) share a class; texts without a word have no other
    likeness. A null text is a class of its own row: class_id is its doc_id. Repeated
    rows come out as often as they stand there, in one class; very long texts count
    whole; a table without rows gives none. Columns but doc_id and text play no part.
    """
    alone = documents.filter(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id"))
    return _classes(documents, similarity).select("doc_id", "class_id").unionByName(alone)


def distinct_documents(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with its columns unchanged: a row of the least doc_id. Rows of null text all stay.

    Of rows that repeat both doc_id and text, one stays. An empty table gives no
    rows. Any further columns, of whatever names, come along.
    """
    found = stored(_classes(documents, similarity), "classes")
    kept = found.filter((F.col("key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    rows = whole_rows(documents.filter(F.col("text").isNotNull()), F.col("doc_id").alias("id"), text_key(F.col("text").cast("string")).alias("row_key"))
    rows = rows.join(kept, (F.col("row_key") == F.col("key")) & F.col("id").eqNullSafe(F.col("doc_id")))
    once, many = rows.filter("n = 1"), rows.filter("n > 1").dropDuplicates(["doc_id", "key"])
    return unpacked(once.unionByName(many), documents.columns).unionByName(documents.filter(F.col("text").isNull()))
