"""Language identification with error-correcting output codes.

Each language gets a codeword; each bit has a binary classifier over hashed
character n-grams that tells the languages with a 1 from those with a 0. A bit's
classifier is a log-odds (naive Bayes) model, fitted to n-gram counts over *all*
training texts: the counts are summed per language where the texts lie, so only
``BUCKETS`` numbers a language reach the driver. A text's margin for a bit is the
mean weight of its n-grams, through tanh; decoding chooses the codeword with the
least loss, each bit's hinge loss weighted by how well it separated the training
texts. Where the two nearest codewords' losses are close, the row is ambiguous.

Texts without a letter, and null texts, are ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, unpacked, whole_rows

#: Hash buckets of n-grams; with the number of languages, the bound of what is collected and sent out.
BUCKETS = 1 << 15
MAX_LANGUAGES = 256
#: Characters that are hashed at once; a long text goes in several pieces.
CHUNK = 1 << 20
#: Codeword length for more languages than the exhaustive code (2^(k-1) - 1 bits) allows.
MAX_BITS = 31
#: Two codewords whose weighted losses differ by less than this share of the whole are too close to call.
AMBIGUOUS = 0.05


def codewords(n: int) -> np.ndarray:
    """n x bits of -1 and 1. Exhaustive for few languages; else columns drawn from a seeded generator, all unlike and none constant."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if 2 ** (n - 1) - 1 <= MAX_BITS:
        bits = [[1 if (column >> row) & 1 else -1 for row in range(n)] for column in range(1, 2 ** (n - 1))]
        return np.array(bits, np.int8).T
    rng, best, best_gap = np.random.default_rng(0), None, -1
    for _ in range(200):  # of several random codes, the one with the widest gap between its rows
        code = rng.choice(np.array([-1, 1], np.int8), (n, MAX_BITS))
        if (abs(code.astype(int).sum(0)) == n).any():
            continue
        apart = (MAX_BITS - code.astype(int) @ code.astype(int).T) // 2
        gap = int(apart[~np.eye(n, dtype=bool)].min())
        if gap > best_gap:
            best, best_gap = code, gap
    return best


def _codes(text: str) -> np.ndarray:
    """Code points of a text in lower case, everything but letters as one kind of gap."""
    if text.isascii():
        x = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
        return np.where((x >= 97) & (x <= 122), x, 32)
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if x.max() < 0x250:
        return np.where(((x >= 97) & (x <= 122)) | ((x >= 0xC0) & (x != 0xD7) & (x != 0xF7)) | (x == 0xAA) | (x == 0xB5) | (x == 0xBA), x, 32)
    kinds, at = np.unique(x, return_inverse=True)
    return np.where(np.array([chr(c).isalpha() for c in kinds])[at], x, 32)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams of a whole text, a gap at either end, in pieces; of several gaps in a row one counts."""
    text, gap = text.lower(), np.array([32], np.uint32)
    before = gap  # the two symbols with which grams of the next piece may begin
    for start in range(0, max(len(text), 1), CHUNK):
        x = np.concatenate([before, _codes(text[start : start + CHUNK]), gap if start + CHUNK >= len(text) else gap[:0]]).astype(np.uint32)
        x = x[np.concatenate([[True], (x[1:] != 32) | (x[:-1] != 32)])]
        before = x[-2:]
        if len(x) < 3:
            continue
        a, b, c = x[:-2], x[1:-1], x[2:]
        with np.errstate(over="ignore"):
            two = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))
            three = two ^ (c * np.uint32(0xC2B2AE3D))
            one = b * np.uint32(0x27D4EB2F)
        letters = b != 32
        yield np.concatenate([(h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17) for h in (one[letters], two + np.uint32(1), three)])


def _count(languages: list[str]):
    """Per task: how often each bucket occurs in each language."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(place), BUCKETS), np.int64)
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g in grams(text):
                    total[place[lang]] += np.bincount(g, minlength=BUCKETS)
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[row, bucket], pa.int64())], names=["row", "bucket", "n"])

    return run


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # buckets x bits
    trust: np.ndarray  # bits

    def margins(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(self.code.shape[1]), 0
        for g in grams(text):
            if len(g) < 1000:
                total += self.weight[g].sum(0)
            else:  # fewer rows to gather: a text repeats most of its n-grams
                times = np.bincount(g, minlength=BUCKETS)
                there = np.flatnonzero(times)
                total += times[there] @ self.weight[there]
            n += len(g)
        return np.tanh(4 * total / n) if n else None

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """language, score, whether it is too close to call"""
        m = self.margins(text) if text and any(map(str.isalpha, text)) else None
        if m is None or not self.languages:
            return "und", 0.0, False
        loss = np.maximum(0, 1 - self.code * m) @ self.trust
        order = np.argsort(loss, kind="stable")
        near = np.exp(-(loss - loss[order[0]]) * 4)
        close = len(order) > 1 and loss[order[1]] - loss[order[0]] < AMBIGUOUS * self.trust.sum()
        return self.languages[order[0]], float(1 / near.sum()), bool(close)


def fit(training: DataFrame) -> Model:
    """A model from all rows of (text, lang) that have both. No rows: no languages, all texts ``und``."""
    rows = training.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    languages = sorted(r["lang"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros((0, 1), np.int8), np.zeros((BUCKETS, 1), np.float32), np.ones(1))
    counts = np.zeros((len(languages), BUCKETS))
    for r in rows.mapInArrow(_count(languages), "row int, bucket int, n long").groupBy("row", "bucket").agg(F.sum("n").alias("n")).toArrow().to_batches():
        counts[r.column("row").to_numpy(), r.column("bucket").to_numpy()] = r.column("n").to_numpy()
    code = codewords(len(languages))
    # every language counts the same, whatever its share of the texts
    share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
    weight, trust = np.zeros((BUCKETS, code.shape[1])), np.ones(code.shape[1])
    for b in range(code.shape[1]):
        one, zero = code[:, b] > 0, code[:, b] < 0
        if one.any() and zero.any():
            weight[:, b] = np.log(share[one].mean(0)) - np.log(share[zero].mean(0))
            means = share @ weight[:, b]
            trust[b] = np.tanh(max(0.0, means[one].min() - means[zero].max())) + 0.05
    return Model(languages, code, weight.astype(np.float32), trust / trust.mean())


def _predict(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [model.decode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            lang, score, close = (list(x) for x in zip(*got, strict=True)) if got else ([], [], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=[*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    return run


def predict(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The other columns of ``rows``, then lang_pred, score and ambiguous, from the whole of ``text``."""
    rest = [c for c in rows.columns if c not in (text, "lang_pred", "score", "ambiguous")]
    kinds = rows.select(*rest, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")).schema
    return rows.select(*rest, F.col(text).cast("string").alias("_text")).mapInArrow(_predict(model), kinds)


def held_out(doc_id: Column) -> Column:
    """Rows kept from training: crc32 of the id as text, mod 3, is 1. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document; learnt from those not held out.

    Repeated rows come out as often as they stand there, and count as often in
    training; very long texts are read whole, in pieces. Codewords that tie: the first
    language by name. Without rows, or without labels to learn from, there are no rows
    or all are ``und``. Further columns play no part.
    """
    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", "lang")
    model = fit(rows.filter(~F.col("held_out")).select("text", "lang"))
    return predict(rows.select("doc_id", "held_out", "text"), model)


def accepted(documents: DataFrame) -> DataFrame:
    """The documents whose language is known: not ``und`` (null texts are) and not too close to call. Columns and repeated rows stay as they are."""
    model = fit(documents.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    kept = predict(whole_rows(documents, F.col("text")), model).filter((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return unpacked(kept, documents.columns)
