"""Language of each word by a linear-chain conditional random field (operator 6).

A word's features are its affixes, its character n-grams and the word itself (the
lexicon); each has a learned weight per language, and so has each transition between the
languages of adjacent words.  Words are labelled by forward-backward, so in code-switched
text each stretch gets its own language.  A text is one chain, however long.  A document's
language has the largest sum of word posteriors, and its score is that language's share of
them.

Fitted on a bounded sample of chains of documents with a known language, every word of
which is taken to be in that language.  Pieces of chains of two languages are joined to
further chains, from which the transitions between languages are learned.

A word is a run of letters (Unicode categories L and M, starting with an L): marks stay in
their word, and numbers of any kind are no letters.

Edge cases: a text that is null or has no letter is ``und`` with score 0, and so is every
text if no document has a known language; ties go to the first language by name; texts may
be of any length; repeated rows are labelled alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, schema_with, slices, texts

BUCKETS = 1 << 17
SAMPLE_DOCS, SAMPLE_CHAINS, SAMPLE_WORDS, MIXED = 4_000, 6_000, 24, 6
PASSES, RATE, RIDGE = 30, 0.4, 1e-4
#: Words whose emissions a task keeps; words of a piece of a chain; new words, pieces and bytes of text at a time.
WORDS_KEPT, PIECE, LOT, PIECES, SLICE = 400_000, 64, 2_048, 256, 500_000


WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(word: str) -> list[int]:
    """Ids of a lower-case word's features."""
    w = f"^{word}$"
    found = {f"w{word}"}
    for n in (1, 2, 3):
        found |= {f"p{word[:n]}", f"s{word[-n:]}"}
    for n in (2, 3, 4):
        found |= {w[i:i + n] for i in range(len(w) - n + 1)}
    return [zlib.crc32(f.encode()) % BUCKETS for f in found]


def marginals(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray, before: np.ndarray | None = None,
              after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains in step.

    ``emit``: (chains, steps, labels) log potentials; ``lengths``: words per chain, in
    descending order.  Returns posteriors, the sum of pair posteriors and log partitions.
    For pieces of longer chains, ``before`` and ``after`` (chains, labels) are the messages
    into their first and last word; then only the posteriors count.
    """
    n, steps, k = emit.shape
    top = emit.max(2, keepdims=True)
    e, t = np.exp(emit - top), np.exp(trans - trans.max())
    live = [int(np.searchsorted(-lengths, -s, "left")) for s in range(steps)]  # chains longer than s words
    alpha, scale = np.zeros((n, steps, k)), np.ones((n, steps))
    for s in range(steps):
        m = live[s]
        a = (e[:m, s] if before is None else e[:m, s] * before[:m]) if s == 0 else (alpha[:m, s - 1] @ t) * e[:m, s]
        scale[:m, s] = a.sum(1)
        alpha[:m, s] = a / scale[:m, s, None]
    beta = np.zeros((n, steps, k))
    pairs = np.zeros((k, k))
    for s in range(steps - 1, -1, -1):
        m, more = live[s], live[s + 1] if s + 1 < steps else 0
        beta[:m, s] = 1.0 if after is None else after[:m]
        if more:
            ahead = beta[:more, s + 1] * e[:more, s + 1] / scale[:more, s + 1, None]
            beta[:more, s] = ahead @ t.T
            pairs += (alpha[:more, s].T @ ahead) * t
    mask = np.arange(steps) < lengths[:, None]
    logz = ((np.log(scale) + top[:, :, 0]) * mask).sum(1) + np.maximum(lengths - 1, 0) * trans.max()
    post = alpha * beta
    if after is not None:
        post /= np.where(mask[:, :, None], post.sum(2, keepdims=True), 1.0)
    return post, pairs, logz


def transfers(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per piece of a chain the matrix from a message into its first word to its last word's
    (first label, last label), up to a factor; ``lengths`` in descending order."""
    n, steps, k = emit.shape
    e, t = np.exp(emit - emit.max(2, keepdims=True)), np.exp(trans - trans.max())
    out = np.eye(k) * e[:, 0, None, :]
    for s in range(1, steps):
        m = int(np.searchsorted(-lengths, -s, "left"))
        a = (out[:m].reshape(-1, k) @ t).reshape(m, k, k) * e[:m, s, None, :]
        out[:m] = a / a.sum((1, 2), keepdims=True)
    return out


def messages(moves: np.ndarray, trans: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, after) of every piece of several chains, from their :func:`transfers`; ``pieces``:
    number of each chain, whose pieces follow each other."""
    t = np.exp(trans - trans.max())
    k = len(t)
    before, after = np.ones((len(moves), k)), np.ones((len(moves), k))
    first = np.cumsum(pieces) - pieces
    for at in range(1, int(pieces.max(initial=0))):  # all chains in step
        i = first[pieces > at] + at
        a = np.einsum("ni,nij->nj", before[i - 1], moves[i - 1]) @ t
        before[i] = a / a.sum(1, keepdims=True)
        j = (first + pieces)[pieces > at] - at  # the piece behind the one whose message is made
        b = np.einsum("nij,nj->ni", moves[j], after[j]) @ t.T
        after[j - 1] = b / b.sum(1, keepdims=True)
    return before, after


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS, labels)
    trans: np.ndarray


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), weights.shape[1]))
    for a in range(0, len(words), LOT):  # a word has some dozens of features
        found = [features(w) for w in words[a:a + LOT]]
        sizes = np.array([len(f) for f in found])
        flat = np.fromiter((x for f in found for x in f), np.int64, int(sizes.sum()))
        out[a:a + LOT] = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)
    return out


def joined(chains: list[tuple[str, list[str]]]) -> list[tuple[list[str], list[str]]]:
    """(label of each word, words) of the chains, and of one more for every ``MIXED`` chains: the
    first half of a chain followed by the second half of the next one of another language."""
    out = [([lang] * len(c), c) for lang, c in chains]
    for at in range(0, len(chains), MIXED):
        lang, words = chains[at]
        for other, more in chains[at + 1:at + 1 + MIXED]:
            if other != lang and len(words) > 1 and len(more) > 1:
                a, b = words[:len(words) // 2], more[len(more) // 2:]
                out.append(([lang] * len(a) + [other] * len(b), a + b))
                break
    return out


def fit(chains: list[tuple[list[str], list[str]]]) -> Crf:
    """Maximum likelihood by AdaGrad over all chains: (label of each word, words)."""
    chains = sorted((c for c in chains if c[1]), key=lambda c: (-len(c[1]), c))
    labels = sorted({lang for langs, _ in chains for lang in langs})
    k = len(labels)
    w, trans = np.zeros((BUCKETS, k)), np.zeros((k, k))
    if k < 2:
        return Crf(labels, w, trans)
    vocab = {x: i for i, x in enumerate(sorted({x for _, c in chains for x in c}))}
    found = [features(x) for x in vocab]
    sizes = np.array([len(f) for f in found])
    used, flat = np.unique(np.fromiter((x for f in found for x in f), np.int64, int(sizes.sum())), return_inverse=True)
    owner, starts = np.repeat(np.arange(len(vocab)), sizes), np.cumsum(sizes) - sizes
    lengths = np.array([len(c) for _, c in chains])
    steps = int(lengths.max())
    index = np.zeros((len(chains), steps), np.int64)
    mask = np.arange(steps) < lengths[:, None]
    index[mask] = [vocab[x] for _, c in chains for x in c]
    truth = np.zeros((len(chains), steps), np.int64)
    truth[mask] = [labels.index(lang) for langs, _ in chains for lang in langs]
    gold = np.eye(k)[truth] * mask[:, :, None]
    after = mask[:, 1:]
    gold_pairs = np.bincount((truth[:, :-1] * k + truth[:, 1:])[after], minlength=k * k).reshape(k, k).astype(float)
    own, past, past_t, n = np.zeros((len(used), k)), np.full((len(used), k), 1e-8), np.full((k, k), 1e-8), lengths.sum()
    for _ in range(PASSES):
        by_word = np.add.reduceat(own[flat], starts, axis=0)
        post, pairs, _ = marginals(by_word[index], trans, lengths)
        err = (post - gold) / n
        at_word = np.stack([np.bincount(index[mask], weights=err[:, :, j][mask], minlength=len(vocab)) for j in range(k)], 1)
        g = np.stack([np.bincount(flat, weights=at_word[owner, j], minlength=len(used)) for j in range(k)], 1)
        g += RIDGE / len(used) * own
        past += g * g
        own -= RATE * g / np.sqrt(past)
        g_t = (pairs - gold_pairs) / n + 0.02 * trans
        past_t += g_t * g_t
        trans -= 0.2 * g_t / np.sqrt(past_t)
    w[used] = own
    return Crf(labels, w, trans)


class Labeller:
    """Labels whole texts; emissions of words seen lately are kept, which changes no result."""

    def __init__(self, model: Crf):
        self.model = model
        self.weights = np.asarray(model.weights, np.float64)
        self._forget()

    def _forget(self):
        self.code: dict[str, int] = {}
        self.emit = np.zeros((0, len(self.model.labels)))

    def _codes(self, words: list[str]) -> np.ndarray:
        if len(self.code) > WORDS_KEPT:
            self._forget()
        if new := [w for w in set(words) if w not in self.code]:
            n = len(self.code)
            if n + len(new) > len(self.emit):  # room for half as many more: small batches are added often
                more = np.empty((n + len(new) + n // 2, self.emit.shape[1]))
                more[:n] = self.emit[:n]
                self.emit = more
            self.emit[n:n + len(new)] = emissions(new, self.weights)
            self.code.update(zip(new, range(len(self.code), len(self.code) + len(new)), strict=True))
        return np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))

    def words(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """(posteriors of all words, words per text, the words themselves)."""
        found = [words_of(t) for t in batch]
        sizes = np.array([len(f) for f in found], np.int64)
        total, k = int(sizes.sum()), len(self.model.labels)
        if not total:
            return np.zeros((0, k)), sizes, found
        codes = self._codes([w for f in found for w in f])
        # a chain per text, in pieces that are worked on in step; the messages between them make
        # the result that of the unbroken chain
        pieces = -(-sizes // PIECE)
        text_of = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(len(text_of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(sizes) - sizes)[text_of] + nth * PIECE
        length = np.minimum(PIECE, sizes[text_of] - nth * PIECE)
        order = np.argsort(-length, kind="stable")
        moves = np.broadcast_to(np.eye(k), (len(order), k, k)).copy()
        broken = (pieces > 1)[text_of]

        def lots(rows):
            for a in range(0, len(rows), PIECES):
                own = rows[a:a + PIECES]
                mask = np.arange(int(length[own[0]])) < length[own, None]
                place = np.where(mask, begin[own, None] + np.arange(mask.shape[1]), 0)
                yield own, mask, place, self.emit[codes[place]]

        for own, _, _, emit in lots(order[broken[order]]):
            moves[own] = transfers(emit, self.model.trans, length[own])
        before, after = messages(moves, self.model.trans, pieces)
        post = np.empty((total, k))
        for own, mask, place, emit in lots(order):
            p, _, _ = marginals(emit, self.model.trans, length[own], before[own], after[own])
            post[place[mask]] = p[mask]
        return post, sizes, found

    def documents(self, batch: list[str]) -> tuple[list[str], np.ndarray]:
        post, sizes, _ = self.words(batch)
        sums = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0)])
        ends = np.cumsum(sizes)
        mass = sums[ends] - sums[ends - sizes]
        best = mass.argmax(1)
        score = np.where(sizes > 0, mass[np.arange(len(best)), best] / np.maximum(sizes, 1), 0.0)
        names = [self.model.labels[b] if n else "und" for b, n in zip(best.tolist(), sizes.tolist(), strict=True)]
        return names, np.clip(score, 0, 1)


def train(docs: DataFrame, condition, sample_docs: int = SAMPLE_DOCS, sample_chains: int = SAMPLE_CHAINS) -> Crf:
    """Fits on a sample of the documents with ``condition`` and a known language: of at most
    ``sample_docs`` documents, whole texts, at most ``sample_chains`` chains come to the driver."""
    known = (pick(docs.where(condition), doc_id="long", text="string", lang="string")
             .where(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    chosen = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    picked = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "text")

    def run(batches):
        for batch in slices(batches, "text"):
            out = []
            for doc, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words_of(text)
                for i in range(0, len(found), SAMPLE_WORDS):
                    out.append((lang, " ".join(found[i:i + SAMPLE_WORDS]), zlib.crc32(f"{doc}:{i}".encode())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["lang", "words", "h"])

    chains = picked.mapInArrow(run, "lang string, words string, h long").orderBy("h", "lang", "words").limit(sample_chains)
    return fit(joined([(r["lang"], r["words"].split(" ")) for r in chains.collect()]))


def label(docs: DataFrame, model: Crf) -> DataFrame:
    """Every document with lang_pred and score; other columns as they are (columns of those
    two names are replaced)."""
    docs = docs.drop("lang_pred", "score")

    def run(batches):
        labeller = Labeller(model) if model.labels else None
        for batch in slices(batches, "text", SLICE):
            found = texts(batch).to_pylist()
            names, score = labeller.documents(found) if labeller else (["und"] * len(found), np.zeros(len(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)],
                                             names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema_with(docs, lang_pred="string", score="double"))
