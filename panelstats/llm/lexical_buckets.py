"""Ranked lexical search with norm buckets in the manner of LEMP (operator 11).

A document's impact vector holds, for every term of the queries that it contains, the whole
number (10^9 tf) div (1000 tf + 8 m), m from its length; a query's vector holds the terms'
weights, and the score is their inner product.

The vectors are range-partitioned by length (Euclidean norm), longest first, and each
partition is cut into buckets of like length.  A query has a threshold, a score that
``k`` documents are known to reach, which starts from the longest vectors of all and rises
as its partition is read.  Bucket by bucket:

* Cauchy-Schwarz prunes the bucket if the product of the two lengths is below the threshold;
* coordinate bounds filter inside: with the query's terms by falling weight, and each term's
  largest impact in the bucket, a shortest prefix of focus terms is found such that the other
  terms alone stay below the threshold.  Only documents with a focus term are candidates, and
  of those only the ones stay whose focus score plus the smaller of the other terms' largest
  impacts and the other terms' Cauchy-Schwarz bound reaches the threshold;
* survivors are rescored exactly, in 64-bit integers, from their whole vectors.

All bounds are inclusive, so documents that tie with the threshold stay; each partition
gives its ``k`` best of every query, and the best of those are the answer, exactly.

Queries are taken in blocks whose terms are bounded in number (``BLOCK_TERMS``); a block's
terms, weights and thresholds go to the tasks, and document statistics (N, L, df) are sums
over all documents.

Edge cases: an item or document without terms (null, empty) takes part in nothing, but N
counts only documents with a term; rows of one item_id are one item with the terms of all of
them; rows of one doc_id are documents of their own; a null item_id is an item, a null doc_id
a document that comes after all others at ties; texts may be of any length; an empty table of
either kind gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, slices, texts, written

#: Letters, digits and all bytes from 0x80 on are term bytes; A-Z become a-z, the rest spaces.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
SEED_ROWS, BUCKET, BLOCK_TERMS = 4_096, 2_048, 1_000_000
NO_ID = np.iinfo(np.int64).max
ABOVE = 1 + 1e-9  # over the rounding of a bound in doubles
INDEX = "doc_id long, n long, terms array<int>, tfs array<long>"
VECTORS = "doc_id long, norm double, terms array<int>, impacts array<long>"


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of every item."""
    def run(batches):
        for batch in slices(batches, "text"):
            found = [sorted(set(terms_of(t))) for t in texts(batch).to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array([t.decode() for f in found for t in f], pa.string())],
                                             names=["item_id", "term"])

    return pick(items, item_id="long", text="string").mapInArrow(run, "item_id long, term string").distinct()


def ragged(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def indexed(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Of every document with a term: how many it has, and its counts of the vocabulary's terms."""
    width = max(len(vocabulary), 1)

    def run(batches):
        for batch in slices(batches, "text"):
            words = [terms_of(t) for t in texts(batch).to_pylist()]
            n = np.array([len(w) for w in words], np.int64)
            ids = np.fromiter((vocabulary.get(w, -1) for one in words for w in one), np.int64, int(n.sum()))
            cell = (np.repeat(np.arange(len(n)), n) * width + ids)[ids >= 0]
            cell, tf = np.unique(cell, return_counts=True)
            sizes = np.bincount(cell // width, minlength=len(n))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), ragged((cell % width).astype(np.int32), sizes),
                                              ragged(tf.astype(np.int64), sizes)], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


def flat(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, number of them in each row) of a list column without nulls."""
    lists = batch.column(column)
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(), sizes


def impacts(index: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            terms, sizes = flat(batch, 2)
            tf, _ = flat(batch, 3)
            m = 10 + 90 * batch.column(1).to_numpy() * n_docs // n_terms
            value = 1_000_000_000 * tf // (1_000 * tf + 8 * np.repeat(m, sizes))
            row = np.repeat(np.arange(len(sizes)), sizes)
            norm = np.sqrt(np.bincount(row, value.astype(float) ** 2, minlength=len(sizes)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(norm), ragged(terms, sizes), ragged(value, sizes)],
                                             names=["doc_id", "norm", "terms", "impacts"])

    return index.where(F.size("terms") > 0).mapInArrow(run, VECTORS)


class Queries:
    """A block of items: per item its terms by falling weight, the weights and what bounds need."""

    def __init__(self, ids: list, terms: list[np.ndarray], weight: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.terms = [t[np.lexsort((t, -weight[t]))] for t in terms]
        self.weights = [weight[t] for t in self.terms]
        self.norm = np.array([np.sqrt((w.astype(float) ** 2).sum()) for w in self.weights])
        # length of the vector of the terms from each on
        self.tails = [np.sqrt(np.append(np.cumsum((w.astype(float) ** 2)[::-1])[::-1], 0.0)) for w in self.weights]
        self.width = len(weight)
        self.least = np.ones(len(ids), np.int64)  # a score must be above 0

    def scan(self, batches):
        """The ``k`` best (item, doc_id, score) of every item among the rows of :data:`VECTORS`."""
        least = self.least.copy()
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in self.ids]
        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy()
            norms = batch.column(1).to_numpy()
            terms, sizes = flat(batch, 2)
            values, _ = flat(batch, 3)
            ends = np.cumsum(sizes)
            for a in range(0, len(ids), BUCKET):
                b = min(a + BUCKET, len(ids))
                lo, hi = ends[a] - sizes[a], ends[b - 1]
                self._bucket(ids[a:b], norms[a:b], terms[lo:hi], values[lo:hi], sizes[a:b], least, best)
        rows = [(np.full(len(s), q), i, s) for q, (i, s) in enumerate(best)]
        q, i, s = (np.concatenate(x) if rows else np.empty(0, np.int64) for x in (zip(*rows, strict=True) if rows else [(), (), ()]))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(i, pa.int64(), mask=i == NO_ID), pa.array(s)],
                                         names=["item", "doc_id", "score"])

    def _bucket(self, ids, norms, terms, values, sizes, least, best):
        longest = norms.max() * ABOVE
        # the bucket by term: rows and impacts of each, and the largest impact
        order = np.argsort(terms, kind="stable")
        row = np.repeat(np.arange(len(ids)), sizes)[order]
        by_term, value = terms[order], values[order]
        starts = np.searchsorted(by_term, np.arange(self.width + 1))
        held = np.flatnonzero(np.diff(starts))
        largest = np.zeros(self.width, np.int64)
        largest[held] = np.maximum.reduceat(value, starts[held])
        first = np.cumsum(sizes) - sizes
        dense = np.zeros(self.width, np.int64)
        for q in np.flatnonzero(self.norm * longest >= least):
            t, w, floor_ = self.terms[q], self.weights[q], least[q]
            rest = np.append(np.cumsum((w * largest[t])[::-1])[::-1], 0)  # most that the terms from each on can give
            focus = int(np.argmax(np.minimum(rest, self.tails[q] * longest) < floor_))
            if not focus:
                continue
            score = np.zeros(len(ids), np.int64)
            for x, y in zip(t[:focus].tolist(), w[:focus].tolist(), strict=True):
                at = slice(starts[x], starts[x + 1])
                score[row[at]] += y * value[at]
            some = np.flatnonzero(score)
            most = score[some] + np.minimum(rest[focus], self.tails[q][focus] * norms[some] * ABOVE)
            some = some[most >= floor_]
            if not len(some):
                continue
            # survivors from their whole vectors
            dense[t] = w
            n = sizes[some]
            entry = np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            exact = np.add.reduceat(dense[terms[entry]] * values[entry], np.cumsum(n) - n)
            dense[t] = 0
            some, exact = some[exact >= floor_], exact[exact >= floor_]
            i, s = np.concatenate([best[q][0], ids[some]]), np.concatenate([best[q][1], exact])
            top = np.lexsort((i, -s))[:self.k]
            best[q] = i[top], s[top]
            if len(top) == self.k:
                least[q] = max(floor_, s[top[-1]])


def search_block(docs: DataFrame, rows: list, k: int, name: str) -> DataFrame:
    """The best documents of the items whose distinct terms are ``rows`` (item_id, term)."""
    spark = docs.sparkSession
    names = sorted({r["term"] for r in rows})
    vocabulary = {t.encode(): i for i, t in enumerate(names)}
    wanted: dict = {}
    for r in rows:
        wanted.setdefault(r["item_id"], []).append(vocabulary[r["term"].encode()])
    ids = sorted(wanted, key=lambda i: (i is None, i or 0))

    index = written(indexed(docs, vocabulary), f"{name}-index")
    total = index.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = total["n"], total["l"] or 1
    df = np.zeros(len(names), np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    queries = Queries(ids, [np.array(wanted[i], np.int64) for i in ids], weight, k)
    vectors = impacts(index, n_docs, n_terms)
    schema = "item int, doc_id long, score long"
    by_item = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(by_item)).where(F.col("rank") <= k)

    # thresholds: the k-th best among the longest vectors
    seeds = written(vectors.orderBy(F.desc("norm"), "doc_id").limit(SEED_ROWS), f"{name}-seeds")
    for r in ranked(seeds.mapInArrow(queries.scan, schema)).where(F.col("rank") == k).collect():
        queries.least[r["item"]] = r["score"]
    rows_by_norm = (vectors.repartitionByRange(F.desc("norm"), F.xxhash64("doc_id", "terms"))
                    .sortWithinPartitions(F.desc("norm")))
    found = written(ranked(rows_by_norm.mapInArrow(queries.scan, schema)), f"{name}-found")
    numbered = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return found.join(F.broadcast(numbered), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0."""
    docs = pick(docs, doc_id="long", text="string")
    asked = written(item_terms(items), "item-terms")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    found = [search_block(docs, asked.where(of == b).collect(), k, f"block-{b}") for b in range(blocks)]
    return reduce(DataFrame.unionByName, found)


#: DuckDB SQL of the query.
ORACLE_SQL = r"""
WITH low AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM low),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM size),
asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total
           WHERE term IN (SELECT term FROM asked) GROUP BY term),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // l))))::BIGINT AS score
           FROM asked JOIN weight USING (term) JOIN tf USING (term) JOIN size USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""
