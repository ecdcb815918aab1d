"""Language-model scores by a probabilistic suffix tree (operator 4).

A text is lower-cased (A-Z), cut into words, and read as the bytes of the words, one space
between, and an end symbol.  Contexts are the last 0 to ``DEPTH`` bytes.  A context becomes
a state of the tree if its next-symbol distribution diverges from that of the next shorter
context, and does so significantly: by ``DIVERGENCE`` nats a symbol and by ``SIGNIFICANT``
nats over all its symbols, a number that does not depend on the corpus.  Distributions are
smoothed towards the shorter context's.  Scoring uses the longest suffix that is a state at
every byte.

Counts come from all training documents, and every context of them is asked.  Documents are
dealt into slices of about ``DEALT`` bytes; each task tells the words and the distinct
(DEPTH + 1)-grams of its slices, and these are summed by key; shorter grams are sums of longer
ones.  The tree is a table of one row per distinct gram, made length by length: a gram is
joined with the gram without its oldest byte, and the grams of a context are looked at
together.  At most 256 grams share a key in either, so no key is hot and the table may grow
with the corpus.  The grams of each slice are joined with it, and what was found comes
together with the slice's documents; nothing of the tree is on the driver.

Word counts for the base score: words that make up ``COMMON_SHARE`` of the tokens (at most
1 / COMMON_SHARE of them) are known to every task; the others, none of which can be a hot
key, are joined.

Edge cases: a null or empty text is the end symbol alone; texts may be of any length;
repeated rows count and are scored each; with no training document every byte has
probability 1/256 and every c, N and V is 0; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, slices, stored, texts

DEPTH, DIVERGENCE, SIGNIFICANT = 5, 0.002, 5.0
COMMON_SHARE = 2e-6
END = 10  # a line feed, which no word holds
SLICE, DEALT = 1_500_000, 24_000_000
WORDS_HELD, GRAMS_HELD = 150_000, 2_000_000


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(LOWER_BYTES).split()


def stream_of(docs: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, stop): document i's symbols are bytes[start:stop], the end symbol last;
    before each there are ``depth`` end symbols."""
    pad = bytes([END]) * depth
    parts, start, stop, at = [], [], [], 0
    for words in docs:
        own = b" ".join(words) + bytes([END])
        parts += [pad, own]
        start.append(at + depth)
        at += depth + len(own)
        stop.append(at)
    return np.frombuffer(b"".join(parts), np.uint8), np.array(start, np.int64), np.array(stop, np.int64)


def codes_of(data: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The (depth + 1)-gram that ends at each byte as an integer, the symbol in the low byte."""
    code = data.astype(np.int64)
    for k in range(1, depth + 1):
        code[k:] |= data[:-k].astype(np.int64) << (8 * k)
    return code


def grams_of(docs: list[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (depth + 1)-grams as integers, the symbol in the low byte, and their counts."""
    data, start, stop = stream_of(docs, depth)
    mark = np.zeros(len(data) + 1, np.int8)
    np.add.at(mark, start, 1)
    np.add.at(mark, stop, -1)
    return np.unique(codes_of(data, depth)[np.cumsum(mark[:-1]) > 0], return_counts=True)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return code, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def count(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Of (doc_id, text, held_out) rows of three kinds.

    With ``row``: every document, with its slice.  With ``gram``: each slice's distinct grams and
    how often the slice's training documents have them, 0 for those of held-out documents only.
    With ``word``: counts of the words of training documents.
    """
    schema = "slice long, row long, doc_id long, held_out boolean, text string, word binary, gram long, n long"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def told(size, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t)
                                           for c, t in zip(names, types, strict=True)], names=names)

    def of_slice(number, grams):
        code, n = merged(grams)
        return told(len(code), slice=np.full(len(code), number), gram=code, n=n)

    def run(batches):
        row = number = TaskContext.get().partitionId() << 33
        words, grams, held = Counter(), [], 0
        for batch in slices(batches, "text", SLICE):
            text = texts(batch)
            own = [words_of(t) for t in text.to_pylist()]
            out = batch.column(2).fill_null(True).to_pylist()
            yield told(len(own), slice=np.full(len(own), number), row=np.arange(row, row + len(own)), doc_id=batch.column(0),
                       held_out=batch.column(2), text=text.cast(pa.string()))
            row += len(own)
            learned = [w for w, o in zip(own, out, strict=True) if not o]
            for w in learned:
                words.update(w)
            code, _ = grams_of([w for w, o in zip(own, out, strict=True) if o], depth)
            grams += [grams_of(learned, depth), (code, np.zeros(len(code), np.int64))]
            if sum(len(g[0]) for g in grams) > GRAMS_HELD:
                grams = [merged(grams)]
            if len(words) > WORDS_HELD:
                yield told(len(words), word=list(words), n=list(words.values()))
                words = Counter()
            held += text.nbytes
            if held >= DEALT:
                yield of_slice(number, grams)
                grams, held, number = [], 0, number + 1
        if grams:
            yield of_slice(number, grams)
        yield told(len(words), word=list(words), n=list(words.values()))

    return docs.mapInArrow(run, schema)


def smoothed(grams: DataFrame, depth: int = DEPTH, divergence: float = DIVERGENCE, significant: float = SIGNIFICANT) -> DataFrame:
    """(gram, log_p): log10 probability of each gram's symbol after the longest suffix of its
    context that is a state; of (gram, n), n being 0 for grams to score but not to learn from."""
    symbols = grams.agg(F.sum("n")).first()[0] or 0

    def shorter(k: int) -> DataFrame:  # grams of a context of k bytes
        return grams.groupBy(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"))

    out = shorter(0).select("gram", ((F.col("n") + 1) / F.lit(float(symbols + 256))).alias("p"))
    # both keys below have at most 256 rows each; in order, for equal sums at every run
    context = Window.partitionBy("context").orderBy("gram").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for k in range(1, depth + 1):
        own = (shorter(k) if k < depth else grams).withColumn("suffix", F.col("gram").bitwiseAND((1 << 8 * k) - 1))
        rows = (own.join(out.select(F.col("gram").alias("suffix"), F.col("p").alias("base")), "suffix")
                .withColumn("context", F.shiftright("gram", 8)))
        seen = F.when(F.col("n") > 0, F.col("n"))
        rows = (rows.withColumn("total", F.sum("n").over(context)).withColumn("kinds", F.count(seen).over(context))
                .withColumn("sum", F.sum(seen * F.log(seen / F.col("base"))).over(context)))
        gain = F.col("sum") - F.col("total") * F.log(F.col("total"))
        state = (F.col("total") > 0) & (gain >= F.greatest(F.lit(significant), F.lit(divergence) * F.col("total")))
        p = (F.col("n") + F.col("kinds") * F.col("base")) / (F.col("total") + F.col("kinds"))
        out = rows.select("gram", F.when(state, p).otherwise(F.col("base")).alias("p"))
    return out.select("gram", F.log10("p").alias("log_p"))


def looked_up(docs: list[list[bytes]], grams: pd.Index, log_p: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """log10 probability of each document; ``grams`` holds all of theirs, each once, and keeps its
    hash table from call to call."""
    data, start, stop = stream_of(docs, depth)
    per = np.zeros(len(data) + 1)
    for a in range(0, len(data), SLICE):
        code = codes_of(data[max(0, a - depth):a + SLICE], depth)[min(a, depth):]
        # what ends in the padding is in no document
        per[a:a + len(code)] = log_p[grams.get_indexer(code)]
    return np.add.reduceat(per, np.stack([start, stop], 1).ravel())[::2]


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document;
    learns from the documents that are not held out."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))
    counts = stored(count(rows, depth), "counts")
    dealt = counts.where("row is not null").select("slice", "row", "doc_id", "held_out", "text")
    words = stored(counts.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_docs = dealt.where(~F.col("held_out")).count()
    told = words.agg(F.sum("n"), F.count("*")).first()
    total, kinds = (told[0] or 0) + n_docs, told[1] + (n_docs > 0)
    own_grams = counts.where("gram is not null").select("slice", "gram", "n")
    tree = stored(smoothed(stored(own_grams.groupBy("gram").agg(F.sum("n").alias("n")), "grams"), depth), "tree")
    often = COMMON_SHARE * total
    common = {bytes(r["word"]): r["n"] for r in words.where(F.col("n") >= often).collect()}  # at most 1 / COMMON_SHARE
    shared = spark.sparkContext.broadcast(common)

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        logs = {w: log10(n + 1) for w, n in shared.value.items()}
        grams, log_p = pd.Index(found["gram"].to_numpy()), np.append(found["log_p"].to_numpy(), 0.0)
        out = []
        for batch in slices(docs.to_batches(), "text", SLICE):
            own = [words_of(t) for t in texts(batch).to_pylist()]
            known, sums, rare = [], [], []
            for ws in own:
                seen = Counter(ws)
                k, s, left = int(n_docs > 0), log10(n_docs + 1), []
                for w, n in seen.items():
                    if w in logs:
                        k += n
                        s += n * logs[w]
                    else:
                        left.append((w, n))
                known.append(k)
                sums.append(s)
                rare.append(left)
            sizes = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array([w for r in rare for w, _ in r], pa.binary()),
                                                pa.array([n for r in rare for _, n in r], pa.int64())], names=["word", "m"])
            out.append(pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "held_out")),
                 pa.array([len(w) + 1 for w in own], pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()),
                 pa.array(looked_up(own, grams, log_p, depth)), pa.ListArray.from_arrays(pa.array(sizes), pairs)],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "sums", "score", "rare"]))
        return pa.Table.from_batches(out)

    schema = ("row long, doc_id long, held_out boolean, n_tokens long, known long, sums double, score double, "
              "rare array<struct<word: binary, m: long>>")
    found = own_grams.select(F.col("slice").alias("of"), "gram").join(tree, "gram").select("of", "gram", "log_p")
    # a partition per slice: what a task gets does not grow with the corpus
    parts = max(1, own_grams.select("slice").distinct().count())
    scored = stored(dealt.repartition(parts, "slice").groupBy("slice")
                    .cogroup(found.repartition(parts, "of").groupBy("of")).applyInArrow(run, schema), "scored")
    rest = words.where(F.col("n") < often)
    found = (scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.m").join(rest, "word")
             .groupBy("row").agg(F.sum("m").alias("more"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("more_sums")))
    out = scored.drop("rare").join(found, "row", "left").fillna(0, ["more", "more_sums"])
    base = F.col("sums") + F.col("more_sums") - F.col("n_tokens") * F.lit(log10(total + (kinds + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"),
                      F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
