"""Ordinal cumulative-link regression on graded ratings (operator 5).

P(grade >= k) = logistic(w . x - t_k): one weight per hashed text feature, shared by all
grades, and ordered thresholds t_1 < t_2 < ...  Features of a whole text: its distinct
lower-case words and their first four letters, and bands of shares that tell junk (symbols, capitals, digits, table
bars, repeated lines, word lengths).  Fitted on a bounded sample of rated documents by
AdaGrad on the exact likelihood with an L1 penalty; every document is scored.

The grade of a rating is the number of its good marks: quality, and not toxic (0, 1, 2).

Edge cases: ratings with a null in any column are not used, of several ratings of a
document the lowest counts; documents without any word (or null) get expected grade 0,
tail probability 0 and are not kept; with fewer than two grades rated every document with a
word gets the only grade (the top grade if none) for certain, and is kept if that is the top
grade; repeated rows are scored alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import operator
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, schema_with, slices, texts

BUCKETS, BANDS, SAMPLE, LEAST_DOCS = 1 << 18, 12, 10_000, 5
PASSES, RATE, LASSO = 150, 0.3, 7e-4
TOP_GRADE, KEEP = 2, 0.5
SLICE = 2_000_000  # bytes of text at a time
WORD = re.compile(r"[^\W\d_]+")
SYMBOLS = "#*$%&<>=@^~"
N_SHARES = 9


def shares(text: str) -> list[float]:
    """Shares of a non-empty text that tell junk from prose, each from 0 to 1."""
    n = len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    words = text.split()
    return [sum(map(text.count, SYMBOLS)) / n, sum(c.isupper() for c in text) / n,
            sum(c.isdigit() for c in text) / n, text.count("|") / n, text.count("!") / n,
            1 - len(set(lines)) / max(1, len(lines)), min(1.0, sum(map(len, words)) / max(1, len(words)) / 20),
            sum(map(operator.eq, words, words[1:])) / max(1, len(words)),
            sum(w.isupper() for w in words) / max(1, len(words))]


def features(text: str) -> list[int]:
    """Ids of a text's features; empty for a text without words."""
    words = set(WORD.findall(text.lower()))
    if not words:
        return []
    bands = [BUCKETS + k * BANDS + min(BANDS - 1, int(BANDS * s ** 0.5)) for k, s in enumerate(shares(text))]
    words |= {f"^{w[:4]}" for w in words if len(w) > 4}
    return [zlib.crc32(w.encode()) % BUCKETS for w in words] + bands


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    only: int | None = None

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 ... top."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -40, 40)))


def summed(weights: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of the weights of each document's features."""
    ends = np.concatenate([[0.0], np.cumsum(weights[flat])])
    at = np.cumsum(sizes)
    return ends[at] - ends[at - sizes]


def fit(rows: list[np.ndarray], grades: np.ndarray, top: int = TOP_GRADE) -> Ordinal:
    n_features = BUCKETS + N_SHARES * BANDS
    w = np.zeros(n_features)
    t = np.linspace(-1.0, 1.0, top)
    if len(set(grades.tolist())) < 2:
        return Ordinal(w, t, int(grades[0]) if len(grades) else top)
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=n_features) >= min(LEAST_DOCS, len(rows))
    keep = seen[flat]
    flat, row = flat[keep], row[keep]
    used, flat = np.unique(flat, return_inverse=True)
    sizes = np.bincount(row, minlength=len(rows))
    own, past, past_t = np.zeros(len(used)), np.full(len(used), 1e-6), np.full(top, 1e-6)
    at = np.arange(len(rows))
    for _ in range(PASSES):
        f = summed(own, flat, sizes)
        p = 1 / (1 + np.exp(-np.clip(f[:, None] - t, -40, 40)))  # P(grade >= k)
        full = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1)
        like = np.maximum(full[at, grades] - full[at, grades + 1], 1e-9)
        slope = full * (1 - full)
        g_f = -(slope[at, grades] - slope[at, grades + 1]) / like
        g_t = np.zeros(top + 2)
        np.add.at(g_t, grades, slope[at, grades] / like)
        np.add.at(g_t, grades + 1, -slope[at, grades + 1] / like)
        g = np.bincount(flat, weights=g_f[row], minlength=len(used)) / len(rows)
        past += g * g
        step = RATE / np.sqrt(past)
        own -= step * g
        own = np.sign(own) * np.maximum(np.abs(own) - step * LASSO, 0)  # words that tell nothing drop out
        g_t = g_t[1:-1] / len(rows)
        past_t += g_t * g_t
        t = np.maximum.accumulate(t - RATE * g_t / np.sqrt(past_t))  # stay ordered
    w[used] = own
    return Ordinal(w, t)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the ratings without nulls."""
    rows = pick(labels, doc_id="long", quality="int", toxic="int").dropna()
    good = (F.col("quality") > 0).cast("int") + (F.col("toxic") <= 0).cast("int")
    return rows.groupBy("doc_id").agg(F.min(good).alias("grade"))


def train(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fits on the ``sample`` rated documents whose ids hash lowest; their features come to the driver,
    packed as 32-bit integers, one row per id (of rows that repeat an id the text that hashes lowest)."""
    rows = pick(docs, doc_id="long", text="string")
    # ids first, so that only sampled texts move
    chosen = rows.select("doc_id").join(ratings, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = (rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade")
              .agg(F.min(F.struct(F.xxhash64("text"), F.col("text").alias("text"))).alias("t")).select("grade", "t.text"))

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            found = [np.sort(np.array(features(t), "<i4")).tobytes() for t in texts(batch).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["grade", "features"])

    got = picked.mapInArrow(run, "grade int, features binary").collect()
    got = sorted((r["grade"], bytes(r["features"])) for r in got if r["features"])  # an order of its own
    return fit([np.frombuffer(f, "<i4") for _, f in got], np.array([g for g, _ in got], np.int64))


def score(docs: DataFrame, model: Ordinal, keep: float = KEEP) -> DataFrame:
    """Every document: expected_grade, tail_prob = P(top grade), kept; other columns as they are
    (columns of those three names are replaced)."""
    names = ["expected_grade", "tail_prob", "kept"]
    docs = docs.drop(*names)
    top = len(model.thresholds)

    def run(batches):
        for batch in slices(batches, "text", SLICE):
            found = [features(t) for t in texts(batch).to_pylist()]
            sizes = np.array([len(f) for f in found], np.int64)
            flat = np.array([x for f in found for x in f], np.int64)
            if model.only is None:
                p = model.tails(summed(model.weights, flat, sizes))
            else:
                p = np.tile(np.arange(1, top + 1) <= model.only, (len(found), 1)).astype(float)
            p[sizes == 0] = 0
            kept = (sizes > 0) & (p[:, -1] >= keep)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(1)), pa.array(p[:, -1]), pa.array(kept)],
                                             names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema_with(docs, expected_grade="double", tail_prob="double", kept="boolean"))
