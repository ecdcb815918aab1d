"""Byte-level BPE over Arrow batches with the tokenizers library (operator 8).

Every byte has a printable character; the vocabulary is written in those characters.
A text is cut at spaces into chunks ("word with the space before it").  The splitting
pattern never joins a non-space character with a following space, so a chunk between
two non-space characters encodes alone as it does inside its text, and so do a word and what
follows it in the chunk.  Distinct chunks of a
batch are encoded once by the tokenizers library, and the ids are gathered by index.
Texts for which that cut is not proven safe (runs of white space around a cut) are
encoded whole.  The memory of encoded chunks is bounded and is only a memory: ids do
not depend on it.

Edge cases: a null or empty text has no ids; texts may be of any length; repeated rows
give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import pick, slices, texts

CHUNKS_KEPT = 600_000
JOINED = 512
#: A chunk of letters, then a mark that is no letter: the splitting pattern always cuts between them.
#: Apostrophes are left out, as some patterns keep contractions with their word.
WORD_AND_REST = r"(?s)\A(?P<word>[A-Za-zÀ-ÖØ-öø-ſА-я]+)(?P<rest>[!-&(-@\[-`{-~\n].*)\z"


def byte_characters() -> list[str]:
    """Printable stand-in of each byte: itself if printable in Latin-1, else 256, 257, ... in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def tokenizer_of_ranks(ranks: dict[bytes, int], pattern: str | None = None):
    """A tokenizers BPE that encodes as the rank file does.

    Ranks name only results of merges, so every way of making a token from two tokens
    becomes a merge, in order of the result's rank; a piece that is a token is kept whole.
    """
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    chars = byte_characters()
    name = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((rank, ranks[left], name[left], name[right]))
    merges.sort()
    tok = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()},
                               merges=[(a, b) for *_, a, b in merges], ignore_merges=True))
    plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=pattern is None)
    tok.pre_tokenizer = plain if pattern is None else pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), plain])
    tok.decoder = decoders.ByteLevel()
    return tok


def load_tokenizer(path: str):
    """A ``.json`` file of the tokenizers library or a ``.tiktoken`` rank file; special
    tokens' strings inside a text are ordinary text."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".tiktoken"):
        return tokenizer_of_ranks(read_ranks(path))
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return tok


def token_bytes(tok) -> list[bytes]:
    """The bytes of each id, by reversing the byte table; special tokens stand for their text."""
    back = {c: b for b, c in enumerate(byte_characters())}
    out = [b""] * tok.get_vocab_size()
    for token, i in tok.get_vocab().items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def _open_ends(chunks: pa.Array) -> np.ndarray:
    """Whether white space may run on from each chunk into the next."""
    last = pc.utf8_slice_codeunits(chunks, -1).dictionary_encode()
    found = [not c or c.isspace() or c in "\u180e\u200b\ufeff" for c in last.dictionary.to_pylist()]
    return np.array(found, bool)[np.asarray(last.indices)]


class ChunkEncoder:
    """Encodes columns of texts; see the module's docstring."""

    def __init__(self, tok, kept: int = CHUNKS_KEPT):
        self.tok, self.kept = tok, kept
        self.token_bytes = token_bytes(tok)
        self.token_len = np.array([len(t) for t in self.token_bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.begin, self.size, self.n = np.empty(1 << 17, np.int64), np.empty(1 << 17, np.int64), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _room(self, ids: int, chunks: int) -> None:
        while self.used + ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + chunks > len(self.begin):
            self.begin, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.begin, self.size))

    def _add(self, names: list[str], ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        """Stores ids of which ``names[i]`` has ``size[i]`` from ``first[i]`` on."""
        self._room(len(ids), len(names))
        self.flat[self.used:self.used + len(ids)] = ids
        self.begin[self.n:self.n + len(names)] = self.used + first
        self.size[self.n:self.n + len(names)] = size
        self.code.update(zip(names, range(self.n, self.n + len(names)), strict=True))
        self.used, self.n = self.used + len(ids), self.n + len(names)

    def _learn(self, chunks: list[str]) -> None:
        """A word and what follows it are learned apart, and each once: many chunks share them."""
        cuts = pc.extract_regex(pa.array(chunks, pa.large_string()), WORD_AND_REST)
        cut = np.asarray(cuts.is_valid())
        words, rests = (cuts.drop_null().field(f).dictionary_encode() for f in ("word", "rest"))
        own, after = words.dictionary.to_pylist(), [f" {r}" for r in rests.dictionary.to_pylist()]
        fresh = dict.fromkeys([*compress(chunks, ~cut), *own, *after])
        self._learn_pieces([c for c in fresh if c not in self.code])
        if not own:
            return
        parts = np.empty(2 * len(words), np.int64)
        for k, (names, coded) in enumerate(((own, words), (after, rests))):
            parts[k::2] = np.array([self.code[c] for c in names])[np.asarray(coded.indices)]
        n = self.size[parts]
        end = np.cumsum(n)
        ids = self.flat[np.repeat(self.begin[parts] - (end - n), n) + np.arange(end[-1])]
        size = n[::2] + n[1::2]
        self._add(list(compress(chunks, cut)), ids, end[1::2] - size, size)

    def _learn_pieces(self, chunks: list[str]) -> None:
        """Chunks, and rests of chunks (marked by a space in front), which are encoded behind the word "a"."""
        for k in range(0, len(chunks), JOINED):
            some = chunks[k:k + JOINED]
            rest = np.fromiter((c[:1] == " " for c in some), bool, len(some))
            ids = self.whole(" " + " ".join([f"a{c[1:]}" if c[:1] == " " else c for c in some]))
            length = np.array([len(c.encode()) + 1 for c in some])
            ends, until = np.cumsum(length), np.cumsum(self.token_len[ids])
            at = np.searchsorted(until, ends) + 1
            first = np.where(rest, np.searchsorted(until, ends - length + 2) + 1, np.concatenate([[0], at[:-1]]))
            self._add(some, ids, first, at - first)

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets): text ``i`` has ``ids[offsets[i]:offsets[i + 1]]``."""
        if not len(col):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        parts = pc.split_pattern(col, " ")
        at = np.asarray(parts.offsets).astype(np.int64)
        words = parts.flatten()
        at -= at[0]
        coded = words.dictionary_encode()
        uniq = coded.dictionary.to_numpy(zero_copy_only=False)
        index = np.asarray(coded.indices)
        if self.n > self.kept:
            self.forget()
        loose = _open_ends(coded.dictionary)
        bad = np.add.reduceat(loose[index].astype(np.int64), at[:-1]) > 0
        codes = np.fromiter(map(self.code.get, uniq, repeat(-1)), np.int64, len(uniq))
        if len(new := np.flatnonzero((codes < 0) & ~loose)):
            self._learn(names := uniq[new].tolist())
            codes[new] = [self.code[c] for c in names]
        known = codes >= 0
        begin, size = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64)
        begin[known], size[known] = self.begin[codes[known]], self.size[codes[known]]
        # a text's first chunk has no space before it, and unsafe texts are encoded whole
        lone, heads = {}, uniq[index[at[:-1]]].tolist()
        for i in np.flatnonzero(bad).tolist():
            heads[i] = col[i].as_py()
        flat, used, b, n = [self.flat[:self.used]], self.used, begin[index], size[index]
        for i in np.flatnonzero(bad).tolist():
            n[at[i]:at[i + 1]] = 0
        for i, head in enumerate(heads):
            if head not in lone:
                ids = self.whole(head)
                flat.append(ids)
                lone[head] = (used, len(ids))
                used += len(ids)
            b[at[i]], n[at[i]] = lone[head]
        end = np.cumsum(n)
        ids = np.concatenate(flat)[np.repeat(b - (end - n), n) + np.arange(end[-1])]
        return ids, np.concatenate([[0], end[at[1:] - 1]])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file, built once per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(load_tokenizer(path))
    return _ENCODERS[path]


def decode_bytes(ids, table: list[bytes]) -> bytes:
    """The bytes of the ids; a character split over ids is whole again once they are joined."""
    return b"".join(map(table.__getitem__, ids))


def decode_stream(pieces, table: list[bytes]) -> Iterator[str]:
    """Text of consecutive lists of ids; bytes of a character that is not yet whole wait."""
    import codecs

    wait = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in pieces:
        yield wait.decode(decode_bytes(ids, table))
    yield wait.decode(b"", True)


def character_offsets(ids: np.ndarray, table: list[bytes]) -> list[tuple[int, int]]:
    """For each id the characters [from, to) of the text that its bytes touch."""
    data = np.frombuffer(decode_bytes(ids, table), np.uint8)
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
    end = np.cumsum([len(table[i]) for i in ids]).astype(np.int64)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)
    if not len(ids):
        return []
    inside = (data[start] & 0xC0) == 0x80  # begins within a character
    return list(zip((before[start] - inside).tolist(), before[end].tolist(), strict=True))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
           offsets: bool = False) -> DataFrame:
    """(key, ids array<int>[, starts array<int>, ends array<int>]) of every text."""
    schema = f"`{key}` long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets

    def run(batches):
        enc = encoder(path)
        for batch in slices(batches, text):
            ids, at = enc.encode(texts(batch, text))
            at32 = pa.array(at.astype(np.int32))
            cols = [batch.column(0), pa.ListArray.from_arrays(at32, pa.array(ids.astype(np.int32)))]
            if offsets:
                spans = [character_offsets(ids[a:b], enc.token_bytes) for a, b in zip(at, at[1:], strict=False)]
                cols += [pa.array([[x[k] for x in s] for s in spans], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "ids", "starts", "ends"][:len(cols)])

    return pick(docs, **{key: "long", text: "string"}).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, data binary, text string): ids back to bytes; invalid UTF-8 reads as U+FFFD."""
    def run(batches):
        table = encoder(path).token_bytes
        for batch in batches:
            data = [decode_bytes(x or [], table) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(data, pa.binary()),
                 pa.array([d.decode("utf-8", "replace") for d in data], pa.string())], names=[key, "data", "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` long, data binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each text's ids and of the bytes they decode to, in one pass."""
    def run(batches):
        enc = encoder(path)
        names = [str(i) for i in range(len(enc.token_bytes))]
        for batch in slices(batches, "text"):
            ids, at = enc.encode(texts(batch))
            n, told, back = [], [], []
            for a, b in zip(at.tolist(), at[1:].tolist(), strict=False):
                own = ids[a:b].tolist()
                n.append(len(own))
                told.append(hashlib.sha256(" ".join(map(names.__getitem__, own)).encode()).hexdigest())
                back.append(hashlib.sha256(decode_bytes(own, enc.token_bytes)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(told), pa.array(back)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, doc_id="long", text="string").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
