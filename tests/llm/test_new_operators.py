"""Operators 11 to 13 against brute force, with nulls, empties, repeats, ties and clashing columns."""
import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash
from panelstats.llm import filter_audit, lexical_buckets, simhash_vptree
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string, fp string, n long, component string, label int, score double"
LABELS = "doc_id long, quality int, toxic int, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, s, "f", 1, "c", 2, 0.5) for i, t, s in rows], DOCS).repartition(parts)


def prose(r, n):
    return " ".join(r.choice(["alpha", "beta", "Gamma", "delta", "épsilon", "ZETA", "漢字", "x1", "$5", "b c"]) + r.choice(["", "", ",", "."])
                    for _ in range(n))


def variants(seed=5):
    r = random.Random(seed)
    base = [prose(r, n) for n in (1, 2, 3, 40, 150, 400)]
    rows = [(0, None, "a"), (1, "", None), (2, " \n", "a"), (3, "\x85", "b")]
    for i in range(150):
        words = r.choice(base).split(" ")
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            words[r.randrange(len(words))] = "new%d" % r.randrange(50)
        rows.append((10 + i, r.choice([" ", "\n", "  "]).join(words), r.choice(["a", "b", None])))
    rows += [(20, "another version " * 30, "a"), (21, rows[25][1], "b"), (21, rows[25][1], "b"), (None, rows[30][1], "c"), (None, "lonely words here", "c")]
    return rows


# -- operator 11 ---------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(rows, items, k):
    counted = [(i, collections.Counter(TERM.findall(lowered(t)))) for i, t, _ in rows]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(TERM.findall(lowered(t)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bucket", "seeds", "block"), [(2048, 4096, 10**6), (16, 8, 10**6), (7, 1, 150)])
def test_lexical_search_equals_brute_force(spark, monkeypatch, bucket, seeds, block):
    for name, value in (("BUCKET", bucket), ("SEED_ROWS", seeds), ("BLOCK_TERMS", block)):
        monkeypatch.setattr(lexical_buckets, name, value)
    r = random.Random(4)
    rare = [f"t{i}" for i in range(300)]
    rows = variants() + [(1000 + i, " ".join(r.choice(rare) for _ in range(r.randrange(1, 120))), "a") for i in range(400)]
    rows += [(2000 + i, "same words T1 t2-t3", "a") for i in range(30)] + [(2000, "t5 " * 3000, "b"), (None, "t1 t2 t7", "c")]
    items = [(0, "T1, t2 & t3 t4"), (1, "alpha beta \u00e9psilon"), (2, None), (3, "?!"), (4, "nowhere"), (5, "t9"), (5, "T10 t9"), (None, "t1 t7"),
             (6, " ".join(rare)), (7, "same same words")]
    asked = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, rank int, score long")
    got = lexical_buckets.search(frame(spark, rows), asked, k=10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(rows, items, 10)
    assert lexical_buckets.search(frame(spark, rows).limit(0), asked).count() == 0
    assert lexical_buckets.search(frame(spark, rows), asked.limit(0)).count() == 0


def test_lexical_bounds_prune_and_lose_nothing():
    """The scan's answer is that of rescoring every vector, though bounds leave few to rescore."""
    import pyarrow as pa

    r = np.random.default_rng(2)
    n, width = 3000, 200
    terms = [np.sort(r.choice(width, 12, replace=False)).astype(np.int32) for _ in range(n)]
    value = [r.integers(1, 10**6, 12) for _ in range(n)]
    norm = np.array([np.sqrt((v.astype(float) ** 2).sum()) for v in value])
    order = np.argsort(-norm)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(order), pa.array(norm[order]), lexical_buckets.ragged(np.concatenate([terms[i] for i in order]), np.full(n, 12)),
         lexical_buckets.ragged(np.concatenate([value[i] for i in order]), np.full(n, 12))], names=["doc_id", "norm", "terms", "impacts"])
    weight = r.integers(1, 13_000, width)
    queries = lexical_buckets.Queries([0, 1], [np.array([3, 5, 8]), np.arange(0, 60)], weight, 10)
    got = next(queries.scan([batch.slice(0, 1500), batch.slice(1500)])).to_pydict()
    for q, asked in enumerate(queries.terms):
        w = np.zeros(width, np.int64)
        w[asked] = weight[asked]
        scores = sorted(((-int((w[terms[i]] * value[i]).sum()), i) for i in range(n)))[:10]
        assert [(s, d) for x, d, s in zip(got["item"], got["doc_id"], got["score"], strict=True) if x == q] == [(-s, i) for s, i in scores]


# -- operator 12 ---------------------------------------------------------------

def plain_fingerprint(text):
    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, ids):
    prints, n = list(prints), len(prints)
    group = list(range(n))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = root(i), root(j)
            group[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if ids[i] is not None:
            least[root(i)] = min(ids[i], least.get(root(i), ids[i]))
    return [least.get(root(i)) for i in range(n)]


def test_simhash_equals_brute_force(spark):
    rows = variants()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    want = sorted(zip(((i is None, i or 0) for i, _, _ in rows), (f"{p:016x}" for p in prints), plain_groups(prints, [i for i, _, _ in rows]), strict=True), key=repr)
    got = simhash_vptree.join(frame(spark, rows)).collect()
    assert sorted((((r["doc_id"] is None, r["doc_id"] or 0), r["fingerprint"], r["component_id"]) for r in got), key=repr) == want
    assert any(c != i for i, _, c in [(r["doc_id"], 0, r["component_id"]) for r in got])
    assert simhash_vptree.join(frame(spark, rows).limit(0)).count() == 0


def test_simhash_of_a_very_long_text():
    text = " ".join(f"w{i % 977} Q" for i in range(60_000))
    assert int(simhash_vptree.fingerprints_of(["a", text])[1]) == plain_fingerprint(text)


@pytest.mark.parametrize("spread", [3, 64])
def test_forest_loses_no_link(spread):
    r = np.random.default_rng(spread)
    flips = np.uint64(1) << r.integers(0, spread if spread < 64 else 64, (1500, 6)).astype(np.uint64)
    points = np.unique(np.bitwise_xor.reduce(flips, 1) ^ r.integers(0, 4, 1500).astype(np.uint64) << np.uint64(40))
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 2
    label = np.arange(len(points))
    while True:
        new = np.where(near, label[None], len(points)).min(1)
        if (new == label).all():
            break
        label = new
    assert (simhash_vptree.forest(points) == label).all()


def test_tree_brings_every_near_pair_together():
    r = np.random.default_rng(1)
    points = np.unique(r.integers(0, 1 << 63, 4000, np.int64).view(np.uint64))
    points = np.unique(np.concatenate([points, points ^ np.uint64(5), points ^ (np.uint64(1) << np.uint64(60))]))
    tree = simhash_vptree.Tree(points[::3], 40)
    assert tree.shards >= 20
    index, shard = tree.route(points)
    together = collections.defaultdict(set)
    for i, s in zip(index.tolist(), shard.tolist(), strict=True):
        together[i].add(s)
    assert len(index) < 8 * len(points)
    at = {int(p): i for i, p in enumerate(points)}
    for i, p in enumerate(points):
        j = at.get(int(p) ^ 5)
        assert j is None or together[i] & together[j]


# -- operator 13 ---------------------------------------------------------------

def plain_audit(rows, labels):
    letters = "ABCDE"
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    failed = []
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
             "D": bool(re.search("[#$%&*|]", t)),
             "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        failed.append((s or "", i, {c for c in letters if f[c]}))
    out, shapley = [], collections.Counter()
    for order in itertools.permutations(letters):
        left = list(failed)
        for step, c in enumerate(order, 1):
            gone = [x for x in left if c in x[2]]
            left = [x for x in left if c not in x[2]]
            for part in {p for p, _, _ in failed}:
                here = [x for x in gone if x[0] == part]
                fails = [x for x in failed if x[0] == part and c in x[2]]
                shapley[part, c] += len(here)
                out.append((part, "".join(order), step, sum(x[0] == part for x in left), len(here), len(fails) - len(here),
                            sum(x[2] == {c} for x in fails), sum(x[1] in good for x in here), sum(x[1] in toxic for x in here)))
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def test_filter_audit_equals_walking_all_orders(spark):
    rows = variants(9)
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 160, 3)] + [(12, None, 1), (12, 1, None), (None, 1, 1), (13, 0, 0)]
    marks = spark.createDataFrame([(*x, "t") for x in labels], LABELS)
    got = filter_audit.run(frame(spark, rows), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    assert filter_audit.run(frame(spark, rows).limit(0), marks).count() == 0


def test_least_squares_are_shapley_values():
    for k in (1, 2, 3, 5):
        table = [random.Random(k).randrange(1000) for _ in range(1 << k)]
        want = [sum((table[s | 1 << i] - table[s]) * math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count())
                    for s in range(1 << k) if not s >> i & 1) for i in range(k)]
        assert [sum(w * v for w, v in zip(row, table, strict=True)) for row in filter_audit.shapley_map(k)] == want


def test_ngram_ratio_looks_up_no_single_character(spark):
    """Words, symbols and lines are found by searches; translate takes a look-up per character."""
    from panelstats.llm import ngram_ratio

    text = "a\tb\x0bc\x0c d\r\n \t\x0b\x0c\r\n#x|<> é z\nq q\nq q\n 😀 "
    df = spark.createDataFrame([(text,), ("",), (" \n ",)], "text string")
    words = ngram_ratio.words_of(F.col("text"))
    out = df.select(words.alias("words"), *[c.alias(k) for k, c in ngram_ratio.base_columns(F.col("text"), words).items()])
    assert "translate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in out.collect()]
    assert rows[0][0] == ["a", "b", "c", "d", "#x|<>", "é z", "q", "q", "q", "q", "😀"]
    assert rows[0][1:] == (11, 17, 4, 1, 0) and rows[1][1:] == rows[2][1:] == (0, 0, 0, 0, 0)
