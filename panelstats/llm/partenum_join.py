"""N-gram Jaccard join by PartEnum signatures (operator 10).

A document's set holds its distinct 5-word shingles.  Sets are banded by size (factor 2),
with a further band around each border for pairs that lie on both sides of it, so two sets
with Jaccard similarity >= 0.75 share a band; their symmetric difference is at most
k = (|x| + |y|) / 7 there.  Per band the feature domain is cut by hash into n1 groups of n2
parts, and a signature is the content of n2 - k2 parts of a group, for every such subset.
Of n1 > k / (k2 + 1) groups some has at most k2 differences, and one of its subsets then is
equal in both sets.

Subsets without a feature would be common to unrelated sets and are not used.  That is
exact: a set with so many groups with an empty subset that they might be all the good ones
(``thin``) also gets signatures under another hash, and again, until it is not thin; the
set of a pair that stops first has a good group with a feature, and the other set has
signatures under that hash too.

Equal sets are found by fingerprint and joined once.  Documents that share a signature are
candidates.  First each is compared with the one it shares most with; verified links are
closed to components, which leaves few buckets with members of several components.  Only
those are searched, first for each member's nearest in every other component, then, with
what that links closed again, in full: pairs of different components, in blocks, behind an
exact filter: the distance of parity bitmaps never exceeds that of the sets.  Every
surviving pair is verified on its whole sets.  All links between different components are
found, so components are those of all links.

Edge cases: documents without words (or null) have an empty set, n_shingles 0, and link
with nothing; rows with equal doc_id count as versions of one document; a null doc_id has a
null component; texts may be of any length; an empty table gives an empty result; other
columns are ignored.  Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER_BYTES, among, pick, slices, stored, texts

SHINGLE, OVER, UNDER = 5, 75, 100  # similarity of at least OVER / UNDER
SMALL_DISTANCE, SLACK, BLOCK, AT_ONCE = 16, 0.1, 1_000, 100
SLICE = 2_000_000
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sets_of(batch: list[str], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    docs = [t.encode().translate(LOWER_BYTES).split() for t in batch]
    flat = [w for d in docs for w in d]
    if not flat:
        return [np.empty(0, np.uint64) for _ in docs]
    hashed = pd.util.hash_array(np.array(flat, dtype=object))
    h = hashed.copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            h[:-k] = mixed(h[:-k] * MULTIPLIER + hashed[k:])
        out, at = [], 0
        for d in docs:
            if len(d) >= n:
                out.append(np.unique(h[at:at + len(d) - n + 1]))
            elif d:
                short = np.uint64(len(d))
                for x in hashed[at:at + len(d)]:
                    short = mixed(np.array([short * MULTIPLIER + x]))[0]
                out.append(np.array([short], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
            at += len(d)
    return out


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def most_distance(x: int, y: int) -> int:
    """Largest symmetric difference of sets of these sizes that are similar enough."""
    return (UNDER - OVER) * (x + y) // (UNDER + OVER)


def parity_bits(s: np.ndarray) -> np.ndarray:
    """A bit per hash bucket, flipped by each element; the width is a power of two >= 4 |s|."""
    width = max(64, 1 << (4 * len(s) - 1).bit_length())
    bits = np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def bands_of(size: int) -> list[tuple[int, int, int]]:
    """(band, k of the band, most distance of a set of this size from any partner there)."""
    j = size.bit_length() - 1
    low, high = 1 << j, (2 << j) - 1
    widest = size * UNDER // OVER
    out = [(2 * j, most_distance(high, high), most_distance(size, min(high, widest)))]
    if size * UNDER >= (high + 1) * OVER:  # partners above the upper border
        out.append((2 * j + 1, most_distance(high, high * UNDER // OVER), most_distance(size, widest)))
    if j and size * OVER <= (low - 1) * UNDER:  # partners below the lower border
        out.append((2 * j - 1, most_distance(low - 1, (low - 1) * UNDER // OVER), most_distance(size, low - 1)))
    return out


def shape_of(k: int) -> tuple[int, int, int]:
    """(n1, n2, k2) for distance k: few differences allow larger, more telling subsets."""
    n2, k2 = (3, 1) if k <= SMALL_DISTANCE else (1, 0)
    return k // (k2 + 1) + 1 + int(np.ceil(SLACK * k / (k2 + 1))) + 1, n2, k2


def signatures(s: np.ndarray) -> np.ndarray:
    """All signatures of a set; empty where only an equal set can be similar."""
    out = []
    with np.errstate(over="ignore"):
        for band, k, own in bands_of(len(s)):
            if own == 0:
                continue
            n1, n2, k2 = shape_of(k)
            subsets = list(combinations(range(n2), n2 - k2))
            good = n1 - own // (k2 + 1)  # groups sure to have at most k2 differences
            seed = 0
            while True:
                salt = np.uint64(band * 1_000_003 + seed * 7_919 + 1)
                where = mixed(s ^ mixed(np.array([salt]))[0])
                part = ((where >> np.uint64(33)) % np.uint64(n1 * n2)).astype(np.int64)
                content = np.zeros(n1 * n2, np.uint64)
                np.add.at(content, part, mixed(where + MULTIPLIER))
                filled = (np.bincount(part, minlength=n1 * n2) > 0).reshape(n1, n2)
                content = content.reshape(n1, n2)
                thin = np.zeros(n1, bool)
                for at, subset in enumerate(subsets):
                    has = filled[:, subset].any(1)
                    thin |= ~has
                    sig = np.full(n1, salt * MULTIPLIER + np.uint64(at), np.uint64)
                    for p in subset:
                        sig = mixed(sig * MULTIPLIER + content[:, p])
                    sig = mixed(sig + np.arange(n1, dtype=np.uint64) * MIX)
                    out.append(sig[has])
                if thin.sum() < good:
                    break
                seed += 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return UNDER * both >= OVER * (len(x) + len(y) - both)


def _sets(docs: DataFrame, schema: str, emit) -> DataFrame:
    def run(batches):
        for batch in slices(batches, "text", SLICE):
            rows = emit(batch, sets_of(texts(batch).to_pylist()))
            if rows.num_rows:
                yield rows

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, n, fp, bits) of every document; fp is null for an empty set."""
    def emit(batch, sets):
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
             pa.array([parity_bits(s).tobytes() if len(s) else None for s in sets], pa.binary())],
            names=["doc_id", "n", "fp", "bits"])

    return _sets(docs, "doc_id long, n long, fp binary, bits binary", emit)


def signed(docs: DataFrame) -> DataFrame:
    """(sig, node) for every signature of every document."""
    def emit(batch, sets):
        sigs = [signatures(s) for s in sets]
        node = batch.column(0).take(pa.array(np.repeat(np.arange(len(sigs)), [len(x) for x in sigs])))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sigs, np.empty(0, np.uint64)]).view(np.int64)), node],
                                          names=["sig", "node"])

    return _sets(docs, "sig long, node long", emit)


def whole_sets(docs: DataFrame) -> DataFrame:
    def emit(batch, sets):
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "elements"])

    return _sets(docs, "node long, elements binary", emit)


def close_enough(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that their sizes and bitmaps do not rule out.  ``nodes``: (node, n, bits)."""
    def run(frames):
        for f in frames:
            keep = []
            for n1, n2, x, y in zip(f["na"], f["nb"], f["ba"], f["bb"], strict=True):
                ok = UNDER * min(n1, n2) >= OVER * max(n1, n2)
                if ok:
                    p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                    w = min(len(p), len(q))
                    ok = np.bitwise_count(folded(p, w) ^ folded(q, w)).sum() <= most_distance(n1, n2)
                keep.append(bool(ok))
            yield f.loc[keep, ["a", "b"]]

    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"b{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Of the stored pairs (a, b) those whose whole sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = stored(whole_sets(among(docs, stored(ids, f"{name}-ids"), "doc_id")), f"{name}-sets")

    def run(frames):
        for f in frames:
            yes = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(f["xa"], f["xb"], strict=True)]
            yield f.loc[yes, ["a", "b"]]

    side = lambda s: sets.select(F.col("node").alias(s), F.col("elements").alias(f"x{s}"))
    return stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long"), f"{name}-links")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component of the links (a, b).

    Each round a node takes the smallest label among its neighbours' and its own, and then
    its label's label, so the number of rounds grows with the logarithm of the longest chain.
    """
    edges = stored(links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
                    .select("e.a", "e.b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        better = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = stored(better.join(jump, "component", "left")
                      .select("node", "old", F.least("component", "further").alias("component")), "labels")
        if not new.where("component < old").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")


def _runs(batches, keys: int):
    """Lists of columns of the consecutive rows with equal values in the first ``keys`` columns."""
    wait = None
    for batch in batches:
        cols = [np.asarray(c) if pa.types.is_integer(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if wait is not None:
            cols = [np.concatenate(x) for x in zip(wait, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:keys]])
        cuts = (np.flatnonzero(new) + 1).tolist()
        for a, b in zip([0, *cuts], cuts, strict=False):
            yield [c[a:b] for c in cols]
        wait = [c[cuts[-1] if cuts else 0:] for c in cols]
    if wait is not None:
        yield wait


def cross_pairs(shared: DataFrame, nodes: DataFrame, labels: DataFrame, tested: DataFrame, nearest: bool) -> DataFrame:
    """Untested pairs in a bucket of ``shared`` (sig, node) whose components differ and that sizes
    and bitmaps do not rule out; with ``nearest``, per node and other component the nearest one."""
    rows = shared.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    buckets = rows.groupBy("sig").agg(F.count("*").alias("m"), F.min("component").alias("low"), F.max("component").alias("high"),
                                      F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.hash("node")).alias("s"))
    # buckets with the same members are searched once
    buckets = (buckets.where("low < high").groupBy("m", "low", "high", "x", "s").agg(F.min("sig").alias("sig")).select("sig", "m"))
    rows = rows.join(buckets, "sig").join(nodes, "node")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = (rows.withColumn("blocks", blocks).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other")))
    rows = rows.select("sig", "p", "q", "own", "node", "component", "n", "bits")

    def run(batches):
        out, held = [], 0
        for _, p, q, own, node, comp, n, data in _runs(batches, 3):
            if len(node) < 2 or (comp == comp[0]).all():
                continue
            width = min(map(len, data)) // 8
            bits = np.stack([folded(np.frombuffer(b, "<u8"), width) for b in data])
            coarse = folded(bits, max(1, width // 4))
            m = len(node)
            # small buckets at once, large ones row by row
            for lot in [np.triu_indices(m, 1)] if m <= AT_ONCE else ((np.full(m - i - 1, i), np.arange(i + 1, m)) for i in range(m - 1)):
                i, j = lot
                ok = (comp[i] != comp[j]) & (UNDER * np.minimum(n[i], n[j]) >= OVER * np.maximum(n[i], n[j]))
                if p[0] != q[0]:
                    ok &= own[i] != own[j]
                i, j = i[ok], j[ok]
                for b in (coarse, bits):
                    if len(i):
                        most = (UNDER - OVER) * (n[i] + n[j]) // (UNDER + OVER)
                        d = np.bitwise_count(b[i] ^ b[j]).sum(1, dtype=np.int64) - most
                        i, j, d = i[d <= 0], j[d <= 0], d[d <= 0]
                if nearest and len(i):  # of each other component
                    order = np.lexsort((node[j], d, comp[j], i))
                    i, j = i[order], j[order]
                    first = np.ones(len(i), bool)
                    first[1:] = (i[1:] != i[:-1]) | (comp[j][1:] != comp[j][:-1])
                    i, j = i[first], j[first]
                if len(i):
                    out.append((np.minimum(node[i], node[j]), np.maximum(node[i], node[j])))
                    held += len(i)
            if held > 50_000:
                yield _pairs(out)
                out, held = [], 0
        if held:
            yield _pairs(out)

    def _pairs(out):
        pairs = np.unique(np.concatenate([np.stack(x, 1) for x in out]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    found = rows.repartition("sig", "p", "q").sortWithinPartitions("sig", "p", "q", "node").mapInArrow(run, "a long, b long")
    return close_enough(found.distinct().join(tested, ["a", "b"], "left_anti"), nodes)


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    docs = pick(docs, doc_id="long", text="string")
    told = stored(described(docs), "documents")
    filled = told.where("fp is not null and doc_id is not null")
    reps = stored(filled.groupBy("fp").agg(F.min("doc_id").alias("rep")), "representatives")
    nodes = filled.join(reps.withColumnRenamed("rep", "doc_id"), ["fp", "doc_id"], "left_semi").dropDuplicates(["fp", "doc_id"])
    nodes = stored(nodes.select(F.col("doc_id").alias("node"), "n", "bits"), "nodes")
    ids = stored(reps.select(F.col("rep").alias("doc_id")).distinct(), "ids")

    sigs = signed(among(docs, ids, "doc_id"))
    bucket = Window.partitionBy("sig")
    shared = stored(sigs.withColumn("leader", F.min("node").over(bucket)).withColumn("last", F.max("node").over(bucket))
                     .where("leader < last").select("sig", "leader", "node"), "shared")
    best = (shared.where("leader < node").groupBy("node", "leader").agg(F.count("*").alias("c"))
            .groupBy("node").agg(F.max(F.struct("c", (-F.col("leader")).alias("l"))).alias("m"))
            .select((-F.col("m.l")).alias("a"), F.col("node").alias("b")))
    first = stored(close_enough(best, nodes), "first")
    links = verified(first, docs, "first")
    # versions of one document are one document
    versions = (filled.join(reps, "fp").groupBy("doc_id").agg(F.collect_set("rep").alias("r")).where(F.size("r") > 1)
                .select(F.col("doc_id").alias("a"), F.explode("r").alias("b")).where("a <> b"))
    links = links.unionByName(versions)
    tested, members = first, shared.select("sig", "node").distinct()
    # the nearest of another component is most likely to link; what is left then is searched in full
    for name, nearest in (("second", True), ("third", False)):
        labels = components(links)
        pairs = stored(cross_pairs(members, nodes, labels, tested, nearest), name)
        links, tested = links.unionByName(verified(pairs, docs, name)), tested.unionByName(pairs)
    labels = components(links)

    out = told.join(reps, "fp", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
