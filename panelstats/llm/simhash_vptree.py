"""SimHash near-duplicates by vantage-point trees (operator 12).

A document's fingerprint has a bit set where more than half of its 3-word shingles' XXH64
values have it.  Documents with equal fingerprints are one node; nodes link when at most
``MOST_BITS`` bits differ.

A vantage-point tree over a bounded sample of the fingerprints cuts their space into shards:
each inner node holds a vantage fingerprint and a radius, and a fingerprint goes inside if its
Hamming distance to the vantage is at most the radius, else outside.  By the triangle
inequality two linked fingerprints differ by at most ``MOST_BITS`` in that distance, so a
pair that a cut separates has its inner member within ``MOST_BITS`` of the border: those
members are also sent outside, and no link is lost.  All other branches are pruned.  Every
fingerprint is routed, a shard is one task's work, and there the same cuts go on down to
small leaves whose pairs are compared; a leaf that no cut can divide is compared in blocks.
A shard gives a spanning forest of its links, at most one row per fingerprint in it, and the
forests are joined to components in rounds.

The sample decides only where the cuts lie.  Its size bounds the tree (``MOST_SHARDS``);
beyond that the shards grow with the table and the cuts inside them become more.

Edge cases: a null or empty text, or one without words, has fingerprint zero, which links
like any other; texts of fewer than three words are one shingle; repeated rows and rows with
equal doc_id are rows of their own with the same rules; a null doc_id takes part in links
but is never a component_id (a component of null ids only has none); texts may be of any
length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, pick, slices, texts, written
from .partenum_join import components

SHINGLE, SEED, MOST_BITS = 3, 42, 2
SAMPLE, SHARD, MOST_SHARDS = 65_536, 1_024, 4_096
#: Within a shard: leaves of at most so many are compared pair by pair, in blocks of rows.
LEAF, BLOCK, HELD = 128, 1_024, 1_000_000
SLICE = 4_000_000
ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str) -> list[int]:
    words = text.encode().translate(LOWER_BYTES).split()
    if not words:
        return []
    runs = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    return list(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(SEED)))


def fingerprints_of(batch: list[str]) -> np.ndarray:
    """The fingerprint of each text; bits are counted in byte lanes, 255 hashes at a time."""
    hashed = [shingle_hashes(t) for t in batch]
    sizes = np.array([len(h) for h in hashed], np.int64)
    out = np.zeros(len(batch), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    sizes = sizes[some]
    h = np.fromiter((x for one in hashed for x in one), np.uint64, int(sizes.sum()))
    blocks = -(-sizes // 255)
    first = np.cumsum(blocks) - blocks
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + (np.arange(blocks.sum()) - np.repeat(first, blocks)) * 255
    lanes = np.stack([np.add.reduceat(h >> np.uint64(k) & ONES, starts) for k in range(8)], 1)
    counts = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8, 8), first, axis=0, dtype=np.int64)
    bits = counts.transpose(0, 2, 1).reshape(-1, 64) * 2 > sizes[:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""
    def run(batches):
        for batch in slices(batches, "text", SLICE):
            fp = fingerprints_of(texts(batch).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int64)


def best_cut(points: np.ndarray, seed: int) -> tuple[np.uint64, int] | None:
    """(vantage, radius) that divides the points with the fewest sent to both sides; None if no
    cut leaves both sides clearly smaller."""
    picks = np.random.default_rng(seed).choice(len(points), min(8, len(points)), replace=False)
    best, found = 0.85 * len(points), None
    for vantage in points[np.sort(picks)]:
        upto = np.cumsum(np.bincount(distance(points, vantage), minlength=65))
        inner = upto[:-1]
        near = inner - np.concatenate([np.zeros(MOST_BITS, np.int64), inner])[:len(inner)]
        outer = len(points) - inner + near
        larger = np.maximum(inner, outer)
        radius = int(np.argmin(larger + near))
        if larger[radius] < best:
            best, found = larger[radius], (vantage, radius)
    return found


def sides(points: np.ndarray, vantage, radius) -> tuple[np.ndarray, np.ndarray]:
    """(inside, outside) as flags; the points just inside the border are also outside."""
    d = distance(points, vantage)
    return d <= radius, d > radius - MOST_BITS


class Tree:
    """The cuts as arrays: vantage, radius and the two children; a child below zero is shard -1 - child."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.vantage, self.radius, self.inner, self.outer = [], [], [], []
        self.shards = 0
        sample = np.sort(sample)
        self.root = self._grow(sample, max(64, len(sample) // shards), 1)
        self.vantage = np.array(self.vantage, np.uint64)
        self.radius, self.inner, self.outer = (np.array(x, np.int64) for x in (self.radius, self.inner, self.outer))

    def _grow(self, points: np.ndarray, enough: int, seed: int) -> int:
        cut = best_cut(points, seed) if len(points) > enough else None
        if cut is None:
            self.shards += 1
            return -self.shards
        at = len(self.vantage)
        self.vantage.append(cut[0])
        self.radius.append(cut[1])
        self.inner.append(0)
        self.outer.append(0)
        into, out = sides(points, *cut)
        self.inner[at] = self._grow(points[into], enough, 2 * seed % 1_000_003)
        self.outer[at] = self._grow(points[out], enough, (2 * seed + 1) % 1_000_003)
        return at

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, shard) for every shard that a point belongs to."""
        index, node = np.arange(len(points)), np.full(len(points), self.root)
        done = []
        while len(index):
            leaf = node < 0
            done.append((index[leaf], -1 - node[leaf]))
            index, node = index[~leaf], node[~leaf]
            if len(index):
                into, out = sides(points[index], self.vantage[node], self.radius[node])
                index, node = (np.concatenate([index[into], index[out]]),
                               np.concatenate([self.inner[node[into]], self.outer[node[out]]]))
        if not done:
            return index, node
        return np.concatenate([i for i, _ in done]), np.concatenate([s for _, s in done])


def merged(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest index of each group) after the links i-j."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not np.array_equal(further := label[label], label):
            label = further


def forest(points: np.ndarray) -> np.ndarray:
    """Per distinct, sorted fingerprint the index of the smallest one that its links in the shard reach."""
    label = np.arange(len(points))
    held, n = [], 0

    def flush():
        nonlocal label, held, n
        if held:
            label = merged(label, np.concatenate([i for i, _ in held]), np.concatenate([j for _, j in held]))
        held, n = [], 0

    todo = [(np.arange(len(points)), 1)]
    while todo:
        at, seed = todo.pop()
        cut = best_cut(points[at], seed) if len(at) > LEAF else None
        if cut is not None:
            into, out = sides(points[at], *cut)
            todo += [(at[into], 2 * seed % 1_000_003), (at[out], (2 * seed + 1) % 1_000_003)]
            continue
        for x in range(0, len(at), BLOCK):
            for y in range(x, len(at), BLOCK):
                i, j = np.nonzero(distance(points[at[x:x + BLOCK], None], points[at[y:y + BLOCK]][None]) <= MOST_BITS)
                i, j = at[x + i], at[y + j]
                held.append((i[i < j], j[i < j]))
                n += len(held[-1][0])
                if n > HELD:
                    flush()
    flush()
    return label


def links(prints: DataFrame) -> DataFrame:
    """(a, b): spanning links of the distinct fingerprints (fp) that differ in at most ``MOST_BITS`` bits."""
    n = prints.count()
    shards = min(MOST_SHARDS, max(8, n // SHARD))
    rows = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()
    tree = Tree(np.array([r["fp"] for r in rows], np.int64).view(np.uint64), shards)

    def route(batches):
        for batch in batches:
            points = batch.column(0).to_numpy()
            index, shard = tree.route(points.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(points[index])], names=["shard", "fp"])

    def link(shard: pa.Table) -> pa.Table:
        points = np.sort(shard.column("fp").to_numpy().view(np.uint64))
        label = forest(points)
        at = np.flatnonzero(label != np.arange(len(points)))
        return pa.table({"a": points[at].view(np.int64), "b": points[label[at]].view(np.int64)})

    placed = prints.select("fp").mapInArrow(route, "shard int, fp long")
    return placed.groupBy("shard").applyInArrow(link, "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    told = written(fingerprints(pick(docs, doc_id="long", text="string")), "fingerprints")
    prints = written(told.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    labels = components(written(links(prints), "links"))
    grouped = (prints.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
               .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    found = grouped.join(least, "component").select("fp", "component_id")
    return told.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
