"""Each operator against brute force on small tables, with nulls, empties, repeats and clashes."""
import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import plain_suffix_tree
import public_tokenizers as P
import tiktoken
from panelstats.llm import (
    byte_bpe, crf_language, learned_partitions, ngram_ratio, ordinal_quality, packing, partenum_join,
    suffix_tree_lm, token_planes, warc)
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORDS = "the of and zu aber être mañana don't x1 3.14 $$$ A!! <b> — naïve 漢字 🙂 a b".split(" ")
JSON = P.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, length int, score double, fp string"


def make_texts(seed=3, n=60):
    r = random.Random(seed)
    out = [None, "", " ", "\n\n", "a  b \n\n c", "x" * 5000, " lead", "tail ", "tail\n", "<|endoftext|> a"]
    for _ in range(n):
        out.append("".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", "  ", "\t", ". "]) for _ in range(r.randint(1, 300))))
    return out


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", 7, 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    return tok.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_byte_bpe_equals_tiktoken(docs, texts, empty):
    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    for r in byte_bpe.round_trip(docs, path).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert byte_bpe.round_trip(empty, path).count() == 0


def test_offsets_and_split_characters():
    enc = byte_bpe.encoder(JSON)
    ids = enc.whole("漢字 🙂 a")
    spans = byte_bpe.character_offsets(ids, enc.token_bytes)
    assert spans[0][0] == 0 and spans[-1][1] == len("漢字 🙂 a")
    assert "".join(byte_bpe.decode_stream([[i] for i in ids], enc.token_bytes)) == "漢字 🙂 a"


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(docs, texts, empty, bits):
    rows = token_planes.read_planes(token_planes.write_planes(docs, JSON, 2, bits=bits, block_ids=64)).orderBy("start").collect()
    at = 0
    for i, r in enumerate(rows):
        ids = [*ids_of(texts[i]), 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), crc(ids))
        at += len(ids)
    if not bits:
        assert token_planes.read_planes(token_planes.write_planes(empty, JSON, 2)).count() == 0


def test_packing_is_gapless_and_whole(docs, texts, empty):
    rows = packing.pack_documents(docs.unionByName(docs.where("doc_id = 12")), JSON, keep_ids=True).collect()
    used, seqs = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        ids = [*ids_of(texts[r["doc_id"]]), 0]
        piece = ids[r["start"]:r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids) and piece == r["ids"] and crc(piece) == r["ids_crc32"]
        used[r["doc_id"]] += r["length"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"], r["window"]))
    assert used == {i: (len(ids_of(t)) + 1) * (2 if i == 12 else 1) for i, t in enumerate(texts)}
    for parts in seqs.values():
        at = 0
        for offset, length, window in sorted(parts):
            assert offset == at
            at += length
        assert at <= window <= 1024
    assert packing.pack_documents(empty, JSON).count() == 0


@pytest.mark.parametrize("histogram", [{600: 1700}, {40: 1000}, {k: 3 for k in range(1, 1025)}, {513: 10, 1: 3}, {}])
def test_window_plan_uses_every_id_once(histogram):
    total = collections.Counter()
    for window, count, lots in packing.plan_windows(histogram):
        assert sum(x.length for x in lots) <= window
        for x in lots:
            assert x.count == count
            total[x.origin] += x.length * count
    assert total == {k: k * n for k, n in histogram.items()}


def test_neighbours_reach_recall(spark):
    """On a table of which the fit sees a quarter: recall, exact scores, order and ties."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[500:700] = x[499]
    rows = [(i, [float(v) for v in x[i]], "clash") for i in range(3000)]
    rows += [(3000, None, ""), (3001, [0.0] * 16, ""), (3002, [float("nan")] * 16, ""), (3020, [1.0], ""), (40, rows[40][1], ""), (None, rows[41][1], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = collections.defaultdict(list)
    for r in learned_partitions.search(df, F.col("vec_id") % 20 == 0, k=20, sample=750).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 20))
    y, hits = x.astype(float), 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and len({v for _, v, _ in found}) == 20
        for _, v, s in found:
            assert v != q and abs(s - y[v] @ y[q]) < 1e-9
        # highest first, equal scores by ascending id
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -np.round(s, 9)))[:20]
        hits += len(set(best.tolist()) & {v for _, v, _ in found})
    assert hits >= 0.9 * 20 * len(got)
    # 201 equal vectors: a query among them finds the smallest ids of the others first
    assert [v for _, v, _ in got[500]] == [499, *range(501, 520)]
    assert learned_partitions.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "vec_id long, embedding array<double>")
    got = learned_partitions.search(df, F.col("vec_id") == 0, k=20).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == [(i, i, 1.0) for i in range(1, 6)]


def test_base_counts_of_quality_rules(docs, texts, empty, spark):
    trusted = spark.createDataFrame([(i,) for i in range(20, 40)], "doc_id long")
    rows = ngram_ratio.judge(docs, trusted).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(win)
        repeat = len({j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 5)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), repeat)
        assert r["base_failed"] == (len(w) < 10 or 100 * repeat > 20 * len(w))
    assert ngram_ratio.judge(empty, trusted).count() == 0


def test_ngram_ratio_equals_a_plain_ratio(spark):
    """Scores and verdicts against a plain Python ratio with the same buckets, which Spark's hash gives."""
    import regex

    r = random.Random(12)
    prose = ["The quick brown fox jumps over a lazy dog", "Seven brave sailors crossed the northern sea", "x9 $$ #4f !!", "zzq xxv qqk vvj wwp kkt ppl"]
    rows = [(i, " ".join(r.choice(prose[:2] if i < 20 else prose).split()[k] for k in range(4) for _ in range(r.randint(1, 5))), "c") for i in range(60)]
    rows += [(100, None, "c"), (101, "", "c"), (102, "The", "c"), (None, rows[3][1], "c"), (5, rows[40][1], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    trusted = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")

    def shaped(t):
        for p, to in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"[\p{Lo}\p{Lt}\p{Lm}]+", "o"), (r"\p{N}+", "0")):
            t = regex.sub(p, to, t)
        return t

    sets = [[w.lower() for w in (t or "").split()] for _, t, _ in rows], [shaped(t or "").split() for _, t, _ in rows]
    hashes = dict(map(tuple, spark.createDataFrame([(w,) for w in {w for s in sets for d in s for w in d}], "w string").select("w", F.xxhash64("w")).collect()))
    pairs = {(hashes[a], hashes[b]) for s in sets for d in s for a, b in zip(d, d[1:])}
    two = {(a, b): h for a, b, h in spark.createDataFrame(sorted(pairs), "a long, b long").select("a", "b", F.xxhash64("a", "b")).collect()}
    grams, ratio = [[] for _ in rows], {}
    for s, size, first in ((sets[0], ngram_ratio.WORD_BUCKETS, 0), (sets[1], ngram_ratio.SHAPE_BUCKETS, ngram_ratio.WORD_BUCKETS)):
        raw, good = collections.Counter(), collections.Counter()
        for at, d in enumerate(s):
            h = [hashes[w] for w in d]
            own = [first + x % size for x in h + [two[a, b] for a, b in zip(h, h[1:])]]
            grams[at] += own
            if rows[at][1] is not None:
                raw.update(own)
                if rows[at][0] is not None and rows[at][0] < 20:
                    good.update(own)
        for g in raw:
            ratio[g] = math.log((good[g] + 1) / (sum(good.values()) + size)) - math.log((raw[g] + 1) / (sum(raw.values()) + size))
    want = [sum(ratio[g] for g in own) / len(own) if own else None for own in grams]
    got = ngram_ratio.judge(df, trusted).collect()
    key = lambda i, n, s: (str(i), n, -9.0 if s is None else round(s, 9))
    assert sorted(key(x["doc_id"], x["n_words"], x["score"]) for x in got) == sorted(
        key(row[0], len(d), s) for row, d, s in zip(rows, sets[0], want))
    assert all(x["kept"] == (not x["base_failed"] and (x["score"] is None or x["score"] >= ngram_ratio.THRESHOLD)) for x in got)
    # equal shapes, other words: other scores
    a, b = (ngram_ratio.judge(spark.createDataFrame([*rows, (200, t, "c")], df.schema), trusted).where("doc_id = 200").first()["score"]
            for t in ("the quick brown fox jumps over a lazy dog again", "zzq qqqqq vvvvv kkt wwwww pppp a llll ttt sssss"))
    assert a > b
    assert all(x["score"] is None for x in ngram_ratio.judge(df, trusted.limit(0)).collect())


def test_suffix_tree_is_a_distribution_and_base_is_exact(docs, texts, empty):
    held = F.col("doc_id") % 7 == 2
    rows = suffix_tree_lm.score(docs, held).collect()
    words = [suffix_tree_lm.words_of(t or "") for t in texts]
    c = collections.Counter()
    for i, w in enumerate(words):
        if i % 7 != 2:
            c.update([*w, b"\n"])
    n, v = sum(c.values()), len(c)
    for r in rows:
        own = [*words[r["doc_id"]], b"\n"]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in own), abs=1e-6)
    grams = collections.Counter()
    for w in words:
        for g, k in zip(*suffix_tree_lm.grams_of([w]), strict=True):
            grams[int(g)] += int(k)
    contexts = collections.defaultdict(collections.Counter)
    for g, k in grams.items():
        for d in range(6):
            contexts[d, (g >> 8) & ((1 << 8 * d) - 1)][g & 255] += k
    tree = plain_suffix_tree.build(contexts)
    mass = 10.0 ** tree.log_p
    mass[:, -1] *= 256 - (tree.log_p.shape[1] - 1)
    assert np.allclose(mass.sum(1), 1)
    assert suffix_tree_lm.score(empty, held).count() == 0


def test_with_one_grade_only_the_top_one_is_kept(spark):
    df = spark.createDataFrame([(i, f"some words {i}", "x") for i in range(6)] + [(0, "some other words", "x"), (None, "words", "y")], "doc_id long, text string, kept string")
    for q, t, want in ((0, 1, False), (1, 0, True)):
        marks = spark.createDataFrame([(i, q, t) for i in range(6)], "doc_id long, quality int, toxic int")
        rows = ordinal_quality.score(df, ordinal_quality.train(df, ordinal_quality.graded(marks))).collect()
        assert len(rows) == 8 and all(r["kept"] is want for r in rows)


def test_ordinal_model_orders_grades_and_rejects_empty(spark, empty):
    r = random.Random(2)
    def text(g):
        return " ".join(r.choice(["good", "fine"] if g == 2 else ["moron"] if g == 1 else ["$$$", "buy"]) if r.random() < .3
                        else r.choice("abcdefgh") * 3 for _ in range(40))
    rows = [(i, text(i % 3), "en", 1, 0.0, "") for i in range(300)] + [(300, None, "", 0, 0.0, ""), (301, "!!", "", 0, 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 < 2)) for i in range(300)] + [(None, 1, None)], "doc_id long, quality int, toxic int")
    model = ordinal_quality.train(df, ordinal_quality.graded(labels))
    assert (np.diff(model.thresholds) >= 0).all()
    got = {x["doc_id"]: x for x in ordinal_quality.score(df, model).collect()}
    for i, text in list(zip((x["doc_id"] for x in df.collect()), (x["text"] for x in df.collect())))[:20]:
        ids = ordinal_quality.features(text or "")
        tails = [1 / (1 + math.exp(-(sum(model.weights[j] for j in ids) - t))) if ids else 0.0 for t in model.thresholds]
        assert got[i]["expected_grade"] == pytest.approx(sum(tails), abs=1e-6) and got[i]["tail_prob"] == pytest.approx(tails[-1], abs=1e-6)
        assert got[i]["kept"] == (bool(ids) and tails[-1] >= ordinal_quality.KEEP)
    assert sum(got[i]["kept"] == (i % 3 == 2) for i in range(300)) > 280
    assert not got[300]["kept"] and not got[301]["kept"]
    assert ordinal_quality.score(empty, ordinal_quality.train(empty, ordinal_quality.graded(labels))).count() == 0


def test_forward_backward_equals_enumeration():
    from itertools import product
    rng = np.random.default_rng(0)
    emit, trans, lengths = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), np.array([4, 2])
    post, _, logz = crf_language.marginals(emit, trans, lengths)
    for c, n in enumerate(lengths):
        paths = list(product(range(3), repeat=int(n)))
        w = np.exp([sum(emit[c, s, y] for s, y in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert np.isclose(np.log(w.sum()), logz[c])
        for s in range(n):
            for y in range(3):
                assert np.isclose(sum(x for x, p in zip(w, paths) if p[s] == y) / w.sum(), post[c, s, y])


def test_language_of_documents_and_words(spark, empty):
    r = random.Random(5)
    vocab = {"en": "the of and thing house", "de": "und der die haus dass", "fr": "le les des maison être"}
    rows = [(i, " ".join(r.choice(vocab[l].split()) for _ in range(30)), l, 0, 0.0, "") for i in range(120) for l in [sorted(vocab)[i % 3]]]
    rows += [(500, None, "en", 0, 0.0, ""), (501, "123 !", None, 0, 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = crf_language.train(df, F.col("doc_id") % 4 != 2)
    got = {x["doc_id"]: x for x in crf_language.label(df, model).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] for i in range(120))
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[500]["score"] == 0
    post, _, found = crf_language.Labeller(model).words(["the of and thing house und der die haus dass"])
    assert [model.labels[k] for k in post.argmax(1)] == ["en"] * 5 + ["de"] * 5
    assert crf_language.label(empty, crf_language.train(empty, F.lit(True))).count() == 0


def test_letters_marks_and_other_numbers():
    assert crf_language.words_of("½ ² ① 12 !") == [] and crf_language.words_of("\u0939\u093f\u0928\u094d\u0926\u0940 A1b") == ["\u0939\u093f\u0928\u094d\u0926\u0940", "a", "b"]
    model = crf_language.fit([(["en"] * 2, ["the", "of"]), (["de"] * 2, ["und", "der"])])
    names, score = crf_language.Labeller(model).documents(["½", "①②", "the", "", "\u0301"])
    assert names == ["und", "und", "en", "und", "und"] and score.tolist()[:2] == [0, 0]


def test_a_long_text_is_one_chain(monkeypatch):
    """Code-switched texts of up to 1,000 words, labelled together in pieces and small lots, as one unbroken chain each."""
    r = random.Random(8)
    vocab = {"de": "und der die haus dass", "en": "the of and thing house"}
    chains = [(lang, [r.choice(vocab[lang].split()) for _ in range(24)]) for lang in vocab for _ in range(40)]
    r.shuffle(chains)
    model = crf_language.fit(crf_language.joined(chains))
    # learned from the joined chains: a change is rarer than staying, and not left to a penalty alone
    assert (np.diag(model.trans) > model.trans.min(1)).all()
    assert any(len(set(langs)) == 2 for langs, _ in crf_language.joined(chains))
    long = [" ".join(r.choice(vocab[lang].split() + ["ab", "cd"]) for lang in ("en", "de") * n for _ in range(25)) for n in (1, 20, 3)]
    monkeypatch.setattr(crf_language, "PIECE", 7)
    monkeypatch.setattr(crf_language, "LOT", 5)
    post, sizes, found = crf_language.Labeller(model).words([*long, "", "the"])
    assert sizes.tolist() == [50, 1000, 150, 0, 1]
    at = 0
    for words in found:
        if words:
            emit = crf_language.emissions(words, model.weights)[None]
            want, _, _ = crf_language.marginals(emit, model.trans, np.array([len(words)]))
            assert np.allclose(post[at:at + len(words)], want[0])
        at += len(words)


def test_warc_round_trip(spark):
    r = random.Random(4)
    pages = [(i, f"http://h/{i}", "<p>" + r.choice(["same", str(i)]) + "é" * (i % 50), 1) for i in range(300)]
    pages += [(900, None, None, 1), (901, "u", "", 1), (None, "u", "lone", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, record_type int")
    got = {x["page_id"]: x for x in warc.read_archives(warc.write_archives(df)).collect()}
    first = {}
    for i, _, html, _ in sorted((p for p in pages if p[0] is not None)):
        first.setdefault(html or "", i)
    for i, _, html, _ in pages:
        data = (html or "").encode()
        x = got[i]
        assert (x["payload_bytes"], x["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        own = i if i is None else first[html or ""]
        assert (x["record_type"], x["refers_to"]) == (("response", None) if own == i else ("revisit", own))
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    def find(i):
        return i if comp[i] == i else find(comp[i])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                comp[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_partenum_join_equals_brute_force(spark, empty):
    r = random.Random(8)
    rows = []
    for base in range(25):
        words = [f"w{r.randint(0, 9999)}" for _ in range(r.choice([3, 6, 9, 15, 40, 150]))]
        for _ in range(r.randint(1, 7)):
            copy = words[:]
            for _ in range(r.randint(0, max(1, len(words) // 30))):
                copy[r.randrange(len(copy))] = f"x{r.randint(0, 99)}"
            if r.random() < 0.3:
                copy = copy[r.randint(0, len(copy) // 4):]
            rows.append((len(rows), r.choice([" ", "\n", "  "]).join(copy).upper() if r.random() < 0.2 else " ".join(copy)))
    rows += [(1000, None), (1001, ""), (1002, " \n")]
    df = spark.createDataFrame([(*x, "en", 0, 0.0, "") for x in rows], SCHEMA)
    want = brute_components(rows)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in partenum_join.join(df).collect()}
    assert got == want
    assert partenum_join.join(empty).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(6)
    for size in [*range(4, 40), 100, 127, 128, 129, 700]:
        for _ in range(4):
            x = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            for lost in range(len(x) // 4 + 1):
                y = np.unique(np.concatenate([x[lost:], rng.integers(0, 1 << 62, max(0, len(x) // 7 - lost)).astype(np.uint64)]))
                if 0 < len(np.setxor1d(x, y)) and partenum_join.similar(x, y):
                    assert np.intersect1d(partenum_join.signatures(x), partenum_join.signatures(y)).size


def test_suffix_tree_asks_every_context(spark):
    r = random.Random(11)
    texts = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega", "q"]) for _ in range(6000)) for _ in range(14)]
    texts += ["qzxvk " * 6, "Qzxvk qzxvé", None, "unseen 漢字 qzxvj"]  # 7 of half a million symbols
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x["score"] for x in suffix_tree_lm.score(df, F.col("doc_id") == len(texts) - 1).collect()}
    words = [suffix_tree_lm.words_of(t or "") for t in texts]
    contexts = collections.defaultdict(collections.Counter)
    for g, n in zip(*suffix_tree_lm.grams_of(words[:-1]), strict=True):
        for d in range(6):
            contexts[d, (int(g) >> 8) & ((1 << 8 * d) - 1)][int(g) & 255] += int(n)
    want = plain_suffix_tree.log_probabilities(plain_suffix_tree.build(contexts), words)
    assert [got[i] for i in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-6)
