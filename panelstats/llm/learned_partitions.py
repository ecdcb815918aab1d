"""Nearest neighbours by learned partitions (operator 2).

Fit, on a bounded sample: the sample's neighbour graph is cut into balanced parts with few
edges between them, and a small classifier learns to name a vector's part from the parts
of its neighbours.  Index: every row goes to its most probable part.  Search: each query
goes to its several most probable parts, and their rows are reranked by the exact inner
product in double precision.  The number of probed parts is the smallest that reaches
``RECALL`` on rows of the sample that were held out of the fit.

A part gives only rows that can still be among the answer: a query's best rows of the sample
bound the score at first, and after the tenth of its parts that are most probable the best
rows found so far do.

Equal vectors are searched once: a query's answer holds at most k rows of equal vectors,
so of each distinct vector the k + 1 smallest ids are candidates (exact, since ties go to
the smaller id and a query excludes itself alone).  Parts are split into blocks of rows
and of queries, so no task holds a whole part, however large.

Edge cases: vectors that are null, empty, zero, of another length than most, or that hold
null or non-finite components take no part, neither as queries nor as candidates; with
fewer than k candidates all are returned; repeated rows of one vec_id count once; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Parts: half the square root of the number of rows, within these bounds.
LEAST_PARTS, MOST_PARTS, SAMPLE, HELD_OUT = 8, 256, 8_192, 1_024
GRAPH_NEIGHBOURS, HIDDEN, EPOCHS, RECALL = 12, 128, 25, 0.93
BLOCK_ROWS, BLOCK_QUERIES = 2_048, 2_048


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vec) of the vectors that take part, one row per vec_id."""
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & fine & F.exists("vec", lambda x: x != 0))
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("vec") == (most["d"] if most else 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def nearest_in(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest others by inner product, in blocks."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a:a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[a:a + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """Parts of nearly equal size with few neighbour edges between them: median splits along
    the widest direction to start, then moves to the part that most neighbours are in, the
    largest gains first, while that part has room."""
    label = np.zeros(len(x), np.int64)
    cuts = [(np.arange(len(x)), parts)]
    n = 0
    while cuts:
        rows, k = cuts.pop()
        if k == 1:
            label[rows] = n
            n += 1
            continue
        own = x[rows] - x[rows].mean(0)
        d = np.ones(x.shape[1])
        for _ in range(8):  # power iteration
            d = own.T @ (own @ d)
            d /= np.linalg.norm(d) or 1.0
        order = rows[np.argsort(own @ d, kind="stable")]
        at = len(rows) * (k // 2) // k
        cuts += [(order[:at], k // 2), (order[at:], k - k // 2)]
    room = int(np.ceil(slack * len(x) / parts))
    edge_from = np.concatenate([np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()])
    edge_to = np.concatenate([near.ravel(), np.repeat(np.arange(len(x)), near.shape[1])])
    for _ in range(rounds):
        votes = np.bincount(edge_from * parts + label[edge_to], minlength=len(x) * parts).reshape(len(x), parts)
        want = votes.argmax(1)
        gain = votes[np.arange(len(x)), want] - votes[np.arange(len(x)), label]
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[want[i]] < room:
                size[label[i]] -= 1
                size[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if not moved:
            break
    return label


@dataclass
class Router:
    """A one-hidden-layer classifier from vectors to parts."""
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def top(self, x: np.ndarray) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :self.probes]


def fit(x: np.ndarray, parts: int, k: int, seed: int = 7) -> Router:
    """Graph, balanced parts and classifier from a sample of vectors; the number of probes from
    those of its rows (an eighth) that took no part in the fit."""
    rng = np.random.default_rng(seed)
    whole = x
    away = rng.permutation(len(x))[:max(1, min(HELD_OUT, len(x) // 8))]
    x = np.delete(x, away, 0) if len(x) > 8 else x
    d = x.shape[1]
    parts = max(1, min(parts, len(x) // 4))
    scale = float(np.sqrt(d) / (np.sqrt((x ** 2).sum(1)).mean() or 1.0))
    r = Router(scale, rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN),
               rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts), 1)
    if parts == 1:
        return r
    near = nearest_in(x, min(GRAPH_NEIGHBOURS, len(x) - 1))
    label = balanced_parts(x, near, parts)
    # targets: shares of the parts among a vector and its neighbours
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x))[:, None], label[near]), 0.6 / near.shape[1])
    goal[np.arange(len(x)), label] += 0.4
    weights = [r.w1, r.b1, r.w2, r.b2]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a:a + 256]
            inp = x[rows] * scale
            hid = np.maximum(inp @ r.w1 + r.b1, 0)
            out = hid @ r.w2 + r.b2
            p = np.exp(out - out.max(1, keepdims=True))
            err = (p / p.sum(1, keepdims=True) - goal[rows]) / len(rows)
            back = (err @ r.w2.T) * (hid > 0)
            t += 1
            for w, g, mm, vv in zip(weights, (inp.T @ back, back.sum(0), hid.T @ err, err.sum(0)), m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                w -= 0.003 * (mm / (1 - 0.9 ** t)) / (np.sqrt(vv / (1 - 0.999 ** t)) + 1e-8)
    home = r.scores(whole).argmax(1)
    true = nearest_in(whole, min(k, len(whole) - 1))[away]
    order = np.argsort(-r.scores(whole[away]), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :].repeat(len(away), 0), 1)
    needed = np.sort(np.take_along_axis(place, home[true], 1).ravel())
    r.probes = int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1
    return r


def best_of(q: np.ndarray, ids: np.ndarray, mat: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's ``k`` best rows that score at least ``least``, best first,
    ties to the smaller id; ``ids`` ascend."""
    top = min(k, len(ids))
    rough = q @ mat.T
    # the product's last bits depend on the block; what may be among the first is scored in one fixed order
    edge = np.maximum(np.partition(rough, len(ids) - top, axis=1)[:, len(ids) - top], least)
    slack = 1e-9 * (np.abs(q) @ np.abs(mat).max(0) + 1e-300)
    qi, ci = np.nonzero(rough >= (edge - slack)[:, None])
    score = np.zeros(len(qi))
    for j in range(mat.shape[1]):
        score += q[qi, j] * mat[ci, j]
    fine = score >= least[qi]
    qi, ci, score = qi[fine], ci[fine], score[fine]
    order = np.lexsort((ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[keep], ids[ci[keep]], score[keep]


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found.

    ``is_query``: a condition on the column vec_id.
    """
    rows = written(usable(vectors, key, vector).withColumn("vkey", F.xxhash64("vec")), "vectors")
    by_value = Window.partitionBy("vkey", "vec").orderBy("vec_id")
    first = written(rows.withColumn("r", F.row_number().over(by_value)).where(F.col("r") <= k + 1)
                    .select("vec_id", "vec", F.col("r").alias("nth")), "first")
    n = first.count()
    chosen = first.where("nth = 1").select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)  # ids first, they are small
    picked = first.join(F.broadcast(chosen), "vec_id").select("vec_id", "vec").orderBy("vec_id").collect()
    x = np.array([r["vec"] for r in picked]) if picked else np.ones((1, 1))
    x_ids = np.array([r["vec_id"] for r in picked], np.int64)
    router = fit(x, max(LEAST_PARTS, min(MOST_PARTS, int(n ** 0.5 / 2))), k)

    def homes(batches):
        for batch in batches:
            if batch.num_rows:
                vec = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(router.scores(vec).argmax(1).astype(np.int32))],
                                                 names=["vec_id", "vec", "part"])

    index = written(first.select("vec_id", "vec").mapInArrow(homes, "vec_id long, vec array<double>, part int"), "index")
    asked = rows.where(is_query).select("vec_id", "vkey", "vec")
    unique = written(asked.groupBy("vkey", "vec").agg(F.min("vec_id").alias("query")).select("query", "vkey", "vec"), "queries")

    def routed(batches):
        """Each query's parts, most probable first, and its best rows of the sample: their last
        score bounds what any other row must reach."""
        for batch in batches:
            vec = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1))
            for a in range(0, len(vec), 256):
                q = vec[a:a + 256]
                qi, ids, score = best_of(q, x_ids, x, k + 1, np.full(len(q), -np.inf))
                ends = np.searchsorted(qi, np.arange(len(q) + 1))
                least = np.where(np.diff(ends) > k, score[ends[1:] - 1], -np.inf)
                top = router.top(q).astype(np.int32)
                lists = lambda v, at: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, len(q)), lists(top.ravel(), np.arange(len(q) + 1) * top.shape[1]), pa.array(least),
                     lists(ids, ends), lists(score, ends)], names=["query", "parts", "least", "ids", "scores"])

    told = written(unique.select("query", "vec").mapInArrow(
        routed, "query long, parts array<int>, least double, ids array<long>, scores array<double>"), "routed")
    own = told.select("query", F.explode(F.arrays_zip("ids", "scores")).alias("f")).select("query", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def merged(*found: DataFrame) -> DataFrame:
        both = reduce(DataFrame.unionByName, found).distinct()  # a row of the sample is met again in its part
        return both.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)

    soon = max(1, router.probes // 10)
    parts = told.select("query", "least", F.posexplode("parts").alias("nth", "part"))
    near = written(merged(own, _reranked(index, unique, parts.where(F.col("nth") < soon), k)).drop("r"), "near")
    # the k + 1 best so far: the other parts give only what reaches the last of them
    least = near.groupBy("query").agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    later = parts.where(F.col("nth") >= soon).drop("least").join(least, "query")
    found = merged(near, _reranked(index, unique, later, k))

    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    lists = unique.join(lists, "query").drop("query")
    each = asked.select(F.col("vec_id").alias("query_id"), "vkey", "vec").join(lists, ["vkey", "vec"])
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k)
    return (each.select("query_id", F.posexplode(others).alias("pos", "f"))
            .select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "f.vec_id", "f.score"))


def _reranked(index: DataFrame, queries: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, score): of every probed part the rows among a block's ``k`` + 1 best that
    reach the query's ``least`` score.  ``probes``: (query, part, least)."""
    # blocks: the sizes are per part, at most MOST_PARTS rows
    def blocks(df, most, name):
        return df.groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias(name))

    sizes = F.broadcast(blocks(index, BLOCK_ROWS, "row_blocks").join(blocks(probes, BLOCK_QUERIES, "query_blocks"), "part"))
    left = (index.join(sizes, "part").withColumn("rb", F.pmod(F.xxhash64("vec_id", "part"), F.col("row_blocks")).cast("int"))
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
            .select("part", "rb", "qb", "vec_id", "vec"))
    right = (probes.join(queries.select("query", F.col("vec").alias("qvec")), "query").join(sizes, "part")
             .withColumn("qb", F.pmod(F.xxhash64("query", "part"), F.col("query_blocks")).cast("int"))
             .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
             .select("part", "rb", "qb", "query", "qvec", "least"))

    def rerank(key, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})]
        if len(l) and len(r):
            l = l.sort_values("vec_id")
            ids, mat = l["vec_id"].to_numpy(), np.stack(l["vec"].to_numpy())
            for a in range(0, len(r), 256):
                part = r.iloc[a:a + 256]
                qi, found, score = best_of(np.stack(part["qvec"].to_numpy()), ids, mat, k + 1, part["least"].to_numpy())
                out.append(pd.DataFrame({"query": part["query"].to_numpy()[qi], "vec_id": found, "score": score}))
        return pd.concat(out)

    keys = ["part", "rb", "qb"]
    return (left.groupBy(*keys).cogroup(right.groupBy(*keys))
            .applyInPandas(rerank, "query long, vec_id long, score double"))
