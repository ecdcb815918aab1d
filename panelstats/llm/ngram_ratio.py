"""Quality rules with a hashed n-gram log-likelihood ratio (operator 3), in DataFrame functions only.

The unigrams and bigrams of a text's lower-cased words are hashed into buckets, and so, into
buckets of their own, are those of its word shapes (runs of lower-case letters, capitals,
other letters and digits become one character each, everything else stays).  For each of the
two kinds two smoothed multinomials over the buckets are estimated, one from the trusted
documents and one from the raw corpus, all documents of each.  A document's score is the sum
over its n-grams of log(p_trusted / p_raw), divided by their number, and every document is
kept or not by one fixed threshold on it.

One scan counts both multinomials.  The log ratios, a number per bucket, become one array in
the scoring plan, so a document's n-grams are looked up where its text is read: nothing is
joined or shuffled per n-gram.

Within a text, repeated 5-word windows are found by sorting the windows' hashes with their
positions, so a text of n words costs n log n; texts without any repeat skip that.

Edge cases: a null text has no words; a text without words has score null and fails the
base rules; with no trusted document the scores are null and the base rules decide alone;
texts may be of any length; repeated rows are judged alike, each on its own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, SPACES, pick, written

WORD_BUCKETS, SHAPE_BUCKETS, SMOOTHING, THRESHOLD = 1 << 16, 1 << 14, 1.0, -0.15
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def words_of(text: Column) -> Column:
    for space in SPACES:  # byte searches; translate looks up every character
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, also where ``then`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def after(values: Column, n: int) -> Column:
    """The array without its first ``n`` elements."""
    return F.slice(values, F.lit(n + 1), F.greatest(F.size(values) - n, F.lit(0)))


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Number of words in n-word windows that occur twice or more."""
    def of_hashes(h: Column) -> Column:
        return F.transform(after(h, n - 1), lambda last, i: F.xxhash64(F.get(h, i), *(F.get(h, i + k) for k in range(1, n - 1)), last))

    def covered(windows: Column) -> Column:
        rows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            return F.sort_array(F.transform(twice, lambda x: x["i"]))

        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-n).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(n), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(bound(rows, starts), first, step, lambda acc: acc["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return bound(bound(hashes, of_hashes), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w))
                 .otherwise(F.lit(0).cast("long")))


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    length = F.char_length(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (length - F.char_length(F.regexp_replace(text, f"[{SYMBOLS}]", ""))).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def grams_of(hashes: Column) -> Column:
    """Hashes of the unigrams and bigrams of a sequence of hashes."""
    return bound(hashes, lambda h: F.concat(h, F.transform(after(h, 1), lambda x, i: F.xxhash64(F.get(h, i), x))))


def text_grams(text: Column, words: Column) -> Column:
    """Hashes of a text's word n-grams and of its shape n-grams, as a struct of two arrays."""
    shape = text
    for pattern, to in ((r"\p{Ll}++", "a"), (r"\p{Lu}++", "A"), (r"[\p{Lo}\p{Lt}\p{Lm}]++", "o"), (r"\p{N}++", "0")):
        shape = F.regexp_replace(shape, pattern, to)
    return F.struct(grams_of(F.transform(words, lambda w: F.xxhash64(F.lower(w)))).alias("words"),
                    grams_of(F.transform(words_of(shape), lambda w: F.xxhash64(w))).alias("shapes"))


def word_bucket(h: Column) -> Column:
    return h.bitwiseAND(WORD_BUCKETS - 1).cast("int")  # a power of two


def shape_bucket(h: Column) -> Column:
    """Bucket of a shape n-gram; they come after those of the words."""
    return (h.bitwiseAND(SHAPE_BUCKETS - 1) + WORD_BUCKETS).cast("int")


def log_ratios(docs: DataFrame, trusted: DataFrame, smoothing: float = SMOOTHING) -> str | None:
    """log p_trusted - log p_raw of every bucket, in order, as a JSON array; None without trusted
    n-grams.  ``trusted``: the distinct doc_ids of the trusted documents, stored.
    """
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    ids = trusted.withColumn("good", F.lit(1))
    rows = rows.join(F.broadcast(ids) if trusted.count() <= BROADCAST_IDS else ids, "doc_id", "left")
    grams = bound(text_grams(F.col("text"), words_of(F.col("text"))),
                  lambda g: F.struct(F.size(g["words"]).alias("n"), F.concat(g["words"], g["shapes"]).alias("h")))
    grams = rows.select("good", grams.alias("g")).select("good", "g.n", F.posexplode("g.h").alias("at", "h"))
    found = grams.select("good", F.when(F.col("at") < F.col("n"), word_bucket(F.col("h"))).otherwise(shape_bucket(F.col("h"))).alias("bucket"))
    counts = written(found.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("good")), "ngrams")  # a row per bucket
    size = WORD_BUCKETS + SHAPE_BUCKETS
    both = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left")
    both = both.fillna(0, ["raw", "good"]).withColumn("shape", F.col("bucket") >= WORD_BUCKETS)
    totals = both.groupBy("shape").agg(F.sum("raw").alias("all_raw"), F.sum("good").alias("all_good"), F.count("*").alias("n"))
    both = both.join(F.broadcast(totals), "shape")

    def log_p(count: str, total: str) -> Column:
        return F.log((F.col(count) + smoothing) / (F.col(total) + smoothing * F.col("n")))

    rows = both.select("bucket", "all_good", (log_p("good", "all_good") - log_p("raw", "all_raw")).alias("ratio"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ratio"))), lambda x: x["ratio"])
    told = rows.agg(F.to_json(ordered).alias("ratios"), F.min("all_good").alias("good")).first()
    return told["ratios"] if told["good"] else None


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the base columns, base_failed, score, kept."""
    rows = pick(docs, doc_id="long", text="string")
    ratios = log_ratios(rows, trusted)
    full = rows.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", words_of(F.col("text")))
    base = base_columns(F.col("text"), F.col("words"))
    if ratios is None:
        score = F.lit(None).cast("double")
    else:
        table = F.from_json(F.lit(ratios), "array<double>")

        def mean(g: Column) -> Column:
            of_words = F.aggregate(g["words"], F.lit(0.0), lambda sum_, h: sum_ + F.get(table, word_bucket(h)))
            both = F.aggregate(g["shapes"], of_words, lambda sum_, h: sum_ + F.get(table, shape_bucket(h)))
            return F.try_divide(both, F.size(g["words"]) + F.size(g["shapes"]))

        score = bound(text_grams(F.col("text"), F.col("words")), mean)
    scored = full.select("doc_id", *(c.alias(k) for k, c in base.items()), score.alias("score"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (scored.withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("score").isNull() | (F.col("score") >= threshold))))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents rated good and not toxic."""
    rows = pick(labels, doc_id="long", quality="int", toxic="int").dropna()
    return written(rows.where("quality > 0 and toxic <= 0").select("doc_id").distinct(), "trusted")
