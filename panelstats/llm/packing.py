"""Hierarchical multi-length packing (operator 1).

A document's ids are cut into windows of the longest context and a remainder.  Each
remainder is routed to the smallest context tier (a power of two) that holds it.  Tiers
are packed from the longest down: a remainder opens a window of its tier, and the gap is
filled by the longest remainders that fit, which come from shorter tiers.  Where nothing
fits, a longer remainder is cut at a multiple of ``grain`` ids, its front fills the gap
and its rest goes back to the stock, so no distribution of lengths leaves large gaps.
Windows are then dealt to step groups so that each group gets its share of every tier.

The plan depends on the histogram of piece lengths alone (at most ``longest`` rows,
whatever the corpus), so it is made on the driver; pieces find their windows by their rank
within their length.  Ranks are counted in buckets of pieces, not in one task per length:
a length that a third of all documents share is spread over many buckets.

Edge cases: a null or empty text is the end id alone; texts may be of any length; repeated
rows are packed once each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import encoder
from .common import pick, slices, texts, written
from .token_planes import with_end

LONGEST, SHORTEST, GRAIN = 1024, 64, 32
BUCKET_ROWS, STEP_IDS = 2_000, 65_536
SLICE = 8_000_000  # bytes of text at a time: the larger, the fewer chunks are looked up again
PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, grain_crcs array<long>"


def grains(length: int, grain: int) -> list[int]:
    return [min(grain, length - k) for k in range(0, length, grain)]


def pieces_of(docs: DataFrame, path: str, end_id: int, longest: int = LONGEST, grain: int = GRAIN,
              keep_ids: bool = False, most: int = SLICE, lasting: bool = True) -> DataFrame:
    """Windows of ``longest`` ids and a remainder per document; a remainder also carries the
    crc32 of each grain, from which that of any part cut at grains follows.  ``keep_ids``
    adds the ids themselves.  A task takes ``most`` bytes of text at a time; what it learned stays
    for its worker's next task, unless that serves other work too (``lasting`` false)."""
    def run(batches):
        enc = encoder(path)
        for batch in slices(batches, "text", most):
            ids, at = with_end(*enc.encode(texts(batch)), end_id)
            data = ids.astype("<u4", copy=False)
            total = np.diff(at)
            n = -(-total // longest)
            row = np.repeat(np.arange(len(total)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * longest
            length = np.minimum(longest, total[row] - start)
            begin = at[row] + start
            crcs, parts = [], []
            for b, k in zip(begin.tolist(), length.tolist(), strict=True):
                crcs.append(zlib.crc32(data[b:b + k]))
                parts.append(None if k == longest else
                             [zlib.crc32(data[b + g:b + min(g + grain, k)]) for g in range(0, k, grain)])
            cols = [batch.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
                    pa.array(crcs, pa.int64()), pa.array(total[row], pa.int64()), pa.array(parts, pa.list_(pa.int64()))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "grain_crcs"]
            if keep_ids:
                cols.append(pa.array([ids[b:b + k].astype(np.int32) for b, k in zip(begin, length, strict=True)],
                                     pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)
        if not lasting:
            enc.forget()

    return pick(docs, doc_id="long", text="string").mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


@dataclass
class Lot:
    """``count`` like parts: of the pieces of length ``origin`` with ranks from ``rank``, the ids from ``cut``."""
    origin: int
    rank: int
    cut: int
    length: int
    count: int

    def take(self, n: int) -> Lot:
        got = Lot(self.origin, self.rank, self.cut, self.length, n)
        self.rank += n
        self.count -= n
        return got


class Stock:
    """Lots by length."""

    def __init__(self, histogram: dict[int, int]):
        self.lots: dict[int, list[Lot]] = {}
        self.lengths: list[int] = []
        for length, count in histogram.items():
            self.put(Lot(length, 0, 0, length, count))

    def put(self, lot: Lot) -> None:
        if lot.length not in self.lots:
            self.lots[lot.length] = []
            insort(self.lengths, lot.length)
        self.lots[lot.length].append(lot)

    def take(self, length: int, most: int) -> Lot:
        lots = self.lots[length]
        got = lots[-1].take(min(most, lots[-1].count))
        if not lots[-1].count:
            lots.pop()
        if not lots:
            del self.lots[length]
            self.lengths.remove(length)
        return got

    def fitting(self, gap: int) -> int | None:
        k = bisect_right(self.lengths, gap)
        return self.lengths[k - 1] if k else None


def tier_of(length: int, shortest: int, longest: int) -> int:
    return min(longest, max(shortest, 1 << max(0, length - 1).bit_length()))


def _part(lots: list[Lot], skip: int, count: int) -> list[Lot]:
    """The same lots for ``count`` windows after the first ``skip``."""
    return [Lot(x.origin, x.rank + skip, x.cut, x.length, count) for x in lots]


def plan_windows(histogram: dict[int, int], longest: int = LONGEST, shortest: int = SHORTEST,
                 grain: int = GRAIN) -> list[tuple[int, int, list[Lot]]]:
    """(window length, number of windows, the lots in them in order) for every piece length."""
    stock, done = Stock({k: v for k, v in histogram.items() if v}), []
    while stock.lengths:
        lot = stock.take(stock.lengths[-1], 1 << 62)
        todo = [(tier_of(lot.length, shortest, longest), lot.count, [lot])]
        while todo:
            tier, count, lots = todo.pop()
            used = sum(x.length for x in lots)
            gap = tier - used
            if not gap:
                done.append((tier, count, lots))
                continue
            cut = gap // grain * grain
            if length := stock.fitting(gap):
                added = stock.take(length, count)
            elif cut and stock.lengths and stock.lengths[-1] > gap:
                front = stock.take(stock.lengths[bisect_right(stock.lengths, gap)], count)
                stock.put(Lot(front.origin, front.rank, front.cut + cut, front.length - cut, front.count))
                added = Lot(front.origin, front.rank, front.cut, cut, front.count)
            elif tier < longest:  # only full windows stay short
                todo.append((tier * 2, count, lots))
                continue
            elif (each := min(longest // used, count)) > 1:  # like windows share one
                whole, rest = divmod(count, each)
                todo.append((tier, whole, [x for i in range(each) for x in _part(lots, i * whole, whole)]))
                if rest:
                    todo.append((tier, rest, _part(lots, whole * each, rest)))
                continue
            elif cut and (keep := -(-count * used // longest)) < count:  # some are taken apart to fill the others
                for x in _part(lots, keep, count - keep):
                    stock.put(x)
                todo.append((tier, keep, _part(lots, 0, keep)))
                continue
            else:
                done.append((tier, count, lots))
                continue
            if added.count < count:
                todo.append((tier, count - added.count, _part(lots, added.count, count - added.count)))
            todo.append((tier, added.count, [*_part(lots, 0, added.count), added]))
    # a window whose ids fit a shorter power of two exactly is that long
    total = [sum(x.length for x in lots) for _, _, lots in done]
    return [(n if n & (n - 1) == 0 else longest, count, lots) for n, (_, count, lots) in zip(total, done, strict=True)]


def _shift_columns(n_bytes: int) -> np.ndarray:
    """For each bit of a crc32, that crc after ``n_bytes`` zero bytes (as a linear map of the crc register)."""
    out = []
    for bit in range(32):
        # crc32 is affine: the constant part drops out against the shift of the register 0
        a = zlib.crc32(b"\0" * n_bytes, 1 << bit) ^ zlib.crc32(b"\0" * n_bytes, 0)
        out.append(a)
    return np.array(out, np.uint64)


def joined_crc(crcs: list[int], sizes: list[int], shifts: dict[int, np.ndarray]) -> int:
    """crc32 of the concatenation of parts with these crcs and byte sizes."""
    total = crcs[0]
    for crc, size in zip(crcs[1:], sizes[1:], strict=True):
        bits = (total >> np.arange(32)) & 1
        total = int(np.bitwise_xor.reduce(np.where(bits, shifts[size], 0).astype(np.uint64))) ^ crc
    return total


def pack(pieces: DataFrame, longest: int = LONGEST, shortest: int = SHORTEST, grain: int = GRAIN,
         step_ids: int = STEP_IDS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pieces (of ``pieces_of``, stored) with the window each goes to.

    A piece that the plan cuts gives a row for each part.  Columns: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, window (padded length of the sequence),
    step_group[, ids].
    """
    n = pieces.count()
    buckets = max(1, -(-n // bucket_rows))
    held = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = held.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = sorted(plan_windows(histogram, longest, shortest, grain), key=lambda x: -x[0])

    lots: dict[int, list[tuple]] = {}
    first, tiers = 0, {}
    for window, count, _ in plan:
        tiers[window] = tiers.get(window, 0) + count
    steps = max(1, sum(w * c for w, c in tiers.items()) // step_ids)
    seen: dict[int, int] = {}
    for window, count, parts in plan:
        at = 0
        for x in parts:
            lots.setdefault(x.origin, []).append((x.rank, x.rank + count, x.cut, x.length, first, at, window,
                                                  seen.get(window, 0)))
            at += x.length
        first += count
        seen[window] = seen.get(window, 0) + count
    shifts = {4 * g: _shift_columns(4 * g) for g in range(1, grain + 1)}

    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (held.withColumn("local", F.row_number().over(within) - 1)
              .join(bases, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("local"))
              .drop("base", "local", "bucket"))
    keep_ids = "ids" in pieces.columns
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step_group"]
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank", "grain_crcs",
                           *["ids"] * keep_ids)

    def run(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in (2, 5))
            order = np.lexsort((rank, length))
            out = []
            for origin in np.unique(length).tolist():
                own = order[np.searchsorted(length[order], origin):np.searchsorted(length[order], origin, "right")]
                ranks = rank[own]
                for lo, hi, cut, size, seq, at, window, nth in lots[origin]:
                    a, b = np.searchsorted(ranks, [lo, hi])
                    if a < b:
                        k = b - a
                        j = ranks[a:b] - lo
                        out.append((own[a:b], *(np.full(k, v, np.int64) for v in (cut, size)), seq + j,
                                    np.full(k, at, np.int64), np.full(k, window, np.int64),
                                    (nth + j) * steps // tiers[window]))
            if not out:
                continue
            row, cut, size, seq, at, window, step = (np.concatenate(x) for x in zip(*out, strict=True))
            take = pa.array(row)
            crc = np.asarray(batch.column(3).take(take)).copy()
            for i in np.flatnonzero(size < length[row]).tolist():
                parts = batch.column(6)[int(row[i])].as_py()
                a = int(cut[i]) // grain
                sizes = [4 * g for g in grains(int(length[row[i]]), grain)]
                b = a + len(grains(int(size[i]), grain))
                crc[i] = joined_crc(parts[a:b], sizes[a:b], shifts)
            cols = [batch.column(0).take(take), pa.array(np.asarray(batch.column(1).take(take)) + cut),
                    pa.array(size), pa.array(crc, pa.int64()), batch.column(4).take(take), pa.array(seq),
                    pa.array(at), pa.array(window), pa.array(step.astype(np.int64))]
            if keep_ids:
                whole = batch.column(7).take(take).to_pylist()
                cols.append(pa.array([w[c:c + s] for w, c, s in zip(whole, cut.tolist(), size.tolist(), strict=True)],
                                     pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * keep_ids)

    schema = ", ".join(f"{c} long" for c in names) + ", ids array<int>" * keep_ids
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, end_id: int = 0, keep_ids: bool = False, most: int = SLICE,
                   lasting: bool = True, **settings) -> DataFrame:
    """Tokenizes, cuts and packs ``docs`` (doc_id, text); the pieces are stored, so texts are
    tokenized once."""
    cuts = {k: v for k, v in settings.items() if k in ("longest", "grain")}
    return pack(written(pieces_of(docs, path, end_id, keep_ids=keep_ids, most=most, lasting=lasting, **cuts), "pieces"), **settings)


def sequences(packed: DataFrame, pad_id: int = 0) -> DataFrame:
    """(sequence_id, window, step_group, ids) with each sequence's ids in order, padded to its window."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most one window's ids
    ids = F.flatten(F.transform(parts, lambda x: x["ids"]))
    pad = F.array_repeat(F.lit(pad_id), (F.col("window") - F.size("ids")).cast("int"))
    return (packed.groupBy("sequence_id", "window", "step_group").agg(ids.alias("ids"))
            .withColumn("ids", F.concat("ids", pad)))
