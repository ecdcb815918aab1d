"""The corpus pipeline against a plain Python version of its four stages, and its edge cases."""
import collections
import itertools
import math

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from panelstats.llm import crf_language, ordinal_quality
from panelstats.llm.common import crc_bucket, pick
from pyspark.sql import functions as F
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_quality(rows, model):
    out = []
    for r in rows:
        ids = ordinal_quality.features(r["text"] or "")
        score = sum(model.weights[i] for i in ids)
        if ids and 1 / (1 + math.exp(-(score - model.thresholds[-1]))) >= 0.5:
            out.append(r)
    return out


def plain_language(rows, model):
    out = []
    for r in rows:
        words = crf_language.words_of(r["text"] or "")
        if words:
            emit = np.array([model.weights[crf_language.features(w)].sum(0) for w in words])
            post, _, _ = crf_language.marginals(emit[None], model.trans, np.array([len(words)]))
            if post[0].mean(0).max() >= 0.5:
                out.append(r)
    return out


def shingles(text):
    w = (text or "").translate(LOWER).split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_near_duplicates(rows):
    sets = [shingles(r["text"]) for r in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            group[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(r["doc_id"], least.get(root(i), r["doc_id"]))
    return [r for i, r in enumerate(rows) if least[root(i)] == r["doc_id"]]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_stage_equals_its_plain_version(spark, documents):
    docs, rows = documents, documents.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "language ID", "n-gram Jaccard join", "packing"]
    stages = dict(corpus_pipeline.STAGES)

    grades = ordinal_quality.graded(spark.read.parquet(f"{SF}/labels.parquet"))
    want = plain_quality(rows, ordinal_quality.train(docs, grades))
    docs = stages["quality classifier"](spark, docs, SF)
    assert docs.columns == documents.columns and sorted(map(tuple, docs.collect())) == sorted(map(tuple, want))
    assert 0 < len(want) < len(rows)

    want = plain_language(want, crf_language.train(docs, crc_bucket("doc_id", 4) != 2))
    docs = stages["language ID"](spark, docs, SF)
    assert docs.columns == documents.columns and sorted(map(tuple, docs.collect())) == sorted(map(tuple, want))

    kept = plain_near_duplicates(want)
    docs = stages["n-gram Jaccard join"](spark, docs, SF)
    assert docs.columns == documents.columns and sorted(map(tuple, docs.collect())) == sorted(map(tuple, kept))
    assert len(kept) < len(want)

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sizes = {r["doc_id"]: len(tok.encode(r["text"], add_special_tokens=False).ids) + 1 for r in kept}
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, SF).collect():
        assert p["doc_tokens"] == sizes[p["doc_id"]]
        pieces[p["doc_id"]].append((p["start"], p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert pieces.keys() == sizes.keys()
    for found, ends in ((pieces, sizes), (sequences, None)):
        for key, spans in found.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == ends[key] if ends else at <= 1024


def test_edge_cases_of_the_stages(spark, documents):
    """Nulls in every column, repeated ids and rows, and further columns named like the operators' own."""
    stages = dict(corpus_pipeline.STAGES)
    base = documents.limit(40)
    clash = (base.withColumn("kept", F.lit("mine")).withColumn("score", F.col("doc_id") * 2).withColumn("lang_pred", F.lit("xx"))
             .withColumn("expected_grade", F.lit(7)).withColumn("tail_prob", F.lit(None).cast("string")))
    for name in ("quality classifier", "language ID"):
        got = stages[name](spark, clash, SF)
        assert got.columns == clash.columns and got.dtypes == clash.dtypes
        rows = got.collect()
        assert rows and all(r["kept"] == "mine" and r["score"] == 2 * r["doc_id"] and r["lang_pred"] == "xx" and r["expected_grade"] == 7 for r in rows)
    first = base.first()
    odd = spark.createDataFrame([(None, first["text"], None, None, None), (900, None, None, None, None), (901, "", "en", "s", 0),
                                 (902, "one two three four five six", "en", "s", 1), (902, "seven eight nine ten eleven twelve", None, None, 2)],
                                base.schema)
    mixed = base.unionByName(odd).unionByName(odd)
    got = [tuple(r) for r in stages["n-gram Jaccard join"](spark, mixed, SF).collect()]
    ids = collections.Counter(r[0] for r in got)
    assert ids[None] == 2 and all(n == 1 for i, n in ids.items() if i is not None)
    assert got[0] is not None and ids[900] == ids[901] == ids[902] == 1
    again = [tuple(r) for r in stages["n-gram Jaccard join"](spark, mixed.repartition(7), SF).collect()]
    assert sorted(got, key=repr) == sorted(again, key=repr)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, base.limit(0), SF).count() == 0
        stage(spark, mixed, SF).count()
    assert pick(base, doc_id="long").count() == 40
