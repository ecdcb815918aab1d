"""Work that is done once, and memory that is bounded, in the training-data operators."""

import random
import string
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelstats.llm import byte_bpe, common, crf_language, ngram_ratio

import corpus_pipeline


def test_a_word_is_learned_once_whatever_follows_it(monkeypatch):
    tokenizers = pytest.importorskip("public_tokenizers")
    enc = byte_bpe.ChunkEncoder(byte_bpe.load_tokenizer(tokenizers.path("byte_bpe_50k.json")))
    learned = []
    real = enc._learn_pieces
    monkeypatch.setattr(enc, "_learn_pieces", lambda chunks: learned.extend(chunks) or real(chunks))
    found = ["so wordly, wordly. wordly\nThe wordly!! don't I'm, été, été. éte1 x", "a wordly, b wordly.", "Ωword, ſo- привет. 中文, 中文."]
    for _ in range(2):
        ids, at = enc.encode(pa.array(found, pa.large_string()))
        for i, t in enumerate(found):
            assert ids[at[i]:at[i + 1]].tolist() == enc.tok.encode(t, add_special_tokens=False).ids
    assert learned.count("wordly") == 1 and len(learned) == len(set(learned))
    assert not {"wordly,", "wordly.", "wordly!!", "été,"} & set(learned)


def test_emissions_take_some_words_at_a_time():
    rnd = random.Random(1)
    words = ["".join(rnd.choices(string.ascii_lowercase, k=8)) for _ in range(12_000)]
    weights = np.random.default_rng(1).normal(size=(crf_language.BUCKETS, 4))
    tracemalloc.start()
    try:
        got = crf_language.emissions(words, weights)
        assert tracemalloc.get_traced_memory()[1] < 15e6
    finally:
        tracemalloc.stop()
    for i in (0, 2_047, 2_048, 11_999):
        assert np.allclose(got[i], weights[crf_language.features(words[i])].sum(0))
    assert crf_language.emissions([], weights).shape == (0, 4)


def test_pipeline_hands_over_small_batches(spark, tmp_path, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.range(3).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("look", lambda spark, docs, _: seen.append(spark.conf.get(key)) or docs)])
    before = spark.conf.get(key)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 3
    assert int(seen[0]) == corpus_pipeline.BATCH_ROWS and spark.conf.get(key) == before


def test_grams_of_short_and_long_sequences(spark):
    rows = spark.createDataFrame([([],), ([5],), ([5, 7],), ([5, 7, 5],)], "h array<long>")
    got = [r[0] for r in rows.select(ngram_ratio.grams_of(F.col("h"))).collect()]
    pair = lambda a, b: spark.range(1).select(F.xxhash64(F.lit(a).cast("long"), F.lit(b).cast("long"))).first()[0]
    assert got == [[], [5], [5, 7, pair(5, 7)], [5, 7, 5, pair(5, 7), pair(7, 5)]]
    for h in (-3, 0, 1 << 40, -(1 << 62) + 9):
        word, shape = spark.range(1).select(ngram_ratio.word_bucket(F.lit(h).cast("long")), ngram_ratio.shape_bucket(F.lit(h).cast("long"))).first()
        assert (word, shape) == (h % ngram_ratio.WORD_BUCKETS, ngram_ratio.WORD_BUCKETS + h % ngram_ratio.SHAPE_BUCKETS)


def test_chunks_are_cut_by_arrow_and_not_one_by_one():
    """Fewer Python calls than chunks: each word and each rest is met once, a chunk itself never."""
    tokenizers = pytest.importorskip("public_tokenizers")
    enc = byte_bpe.ChunkEncoder(byte_bpe.load_tokenizer(tokenizers.path("byte_bpe_50k.json")))
    words = [f"{a}{b}ßж" for a in "abcdefghijklmnopqrstuvwxy" for b in "zxwv"]
    rests = [*(f"{a}{b}" for a in ".,;:!?)]}" for b in ["", "1", "x", "\nx", "\r1", "é'", "\n\nb.", "\u2028q", "🙂", "]"])]
    chunks = [w + r for w in words for r in rests] + ["'s", "don't", "3.14", "x", "漢字.", "a\x00", "¡ay!"]
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        enc._learn(chunks)
    finally:
        sys.setprofile(None)
    assert len(chunks) > 9_000 and len(calls) < 4_000
    for c in chunks[::97] + chunks[-8:]:
        k = enc.code[c]
        got = enc.flat[enc.begin[k]:enc.begin[k] + enc.size[k]].tolist()
        assert got == enc.whole(f" {c}").tolist()


def test_language_of_a_batch_takes_little_memory():
    rnd = random.Random(2)
    words = ["".join(rnd.choices(string.ascii_lowercase, k=5)) for _ in range(500)]
    batch = [" ".join(rnd.choices(words, k=400)) for _ in range(800)]  # 1.9 MB: more than a task takes at a time
    r = np.random.default_rng(2)
    model = crf_language.Crf(list("abcdef"), r.normal(size=(crf_language.BUCKETS, 6)), r.normal(size=(6, 6)))
    labeller = crf_language.Labeller(model)
    labeller.documents(batch[:1])
    peaks = []
    for part in common.slices([pa.RecordBatch.from_arrays([pa.array(batch)], names=["text"])], "text", crf_language.SLICE):
        tracemalloc.start()
        try:
            names, score = labeller.documents(part.column(0).to_pylist())
            peaks.append(tracemalloc.get_traced_memory()[1])
        finally:
            tracemalloc.stop()
        assert len(names) == len(score) == part.num_rows
    assert max(peaks) < 40e6
    whole = labeller.documents(batch)
    alone = [labeller.documents([t]) for t in batch[:20]]
    assert whole[0][:20] == [a[0][0] for a in alone] and np.allclose(whole[1][:20], [a[1][0] for a in alone])


def test_emissions_of_batches_are_those_of_all_words():
    rnd = random.Random(3)
    words = list({"".join(rnd.choices(string.ascii_lowercase, k=4)) for _ in range(3_000)})
    weights = np.random.default_rng(3).normal(size=(crf_language.BUCKETS, 3))
    labeller = crf_language.Labeller(crf_language.Crf(list("abc"), weights, np.zeros((3, 3))))
    codes = np.concatenate([labeller._codes(words[a:a + 170]) for a in range(0, len(words), 170)])
    assert len(np.unique(codes)) == len(words) and np.allclose(labeller.emit[codes], crf_language.emissions(words, weights))


def test_pipeline_leaves_no_chunks_in_its_workers(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    from panelstats.llm import packing
    from panelstats.llm.queries import vocabulary

    path = vocabulary("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"some words and w{i} more of them") for i in range(40)], "doc_id long, text string").coalesce(1)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([byte_bpe.encoder(path).n] * batch.num_rows)], names=["n"])

    def left():
        return max(r["n"] for r in docs.select("doc_id").mapInArrow(held, "n long").collect())

    found = {}
    for lasting in (True, False):
        found[lasting] = sorted(map(str, packing.pieces_of(docs, path, 0, lasting=lasting).collect()))
        assert lasting or left() == 0
    assert found[True] == found[False]
    corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert left() == 0
