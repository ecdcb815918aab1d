"""Token ids in bit or byte planes with a chunk index (operator 9).

File: magic, blocks, documents, block index, trailer.  A block holds a fixed number of ids
(the last may be shorter); its little-endian 32-bit ids are transposed into 4 byte planes
or 32 bit planes, each a zstandard frame of its own, and planes of zero bits take a few
bytes.  The index gives each block's place and its planes' sizes, so a reader decompresses
only the blocks that cover the ids it wants.

Documents are range-partitioned by id and sorted, so files in order of their number hold
all ids in ascending doc_id order.  Each task writes a file with a fresh name and reports
it; the manifest of the successful tasks is written as a table, and only files it names
are read, so a retried or lost task leaves no trace in the result.

Edge cases: a null or empty text has just the end id; a null doc_id sorts first; rows with
equal doc_id are ordered by text; an empty table writes no file and gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import encoder
from .common import file_system, pick, shared_folder, slices, texts, written

MAGIC = b"IDPLANE1"
BLOCK_IDS = 65_536


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [x.tobytes() for x in np.packbits(np.ascontiguousarray(rows.T), axis=1, bitorder="little")]
    return [x.tobytes() for x in np.ascontiguousarray(rows.T)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little")
        return np.ascontiguousarray(rows).view("<u4").ravel()
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


class PlaneWriter:
    """Streams documents' ids into one file; memory holds a block and 16 bytes a document."""

    def __init__(self, out, bits: bool = False, block_ids: int = BLOCK_IDS, level: int = 1):
        self.out, self.bits, self.block, self.pack = out, bits, block_ids, zstandard.ZstdCompressor(level=level)
        self.wait: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.index: list[tuple] = []
        self.at = out.write(MAGIC + struct.pack("<BI", bits, block_ids))

    def add(self, doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids)
        self.sizes.append(sizes)
        self.wait.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            have = np.concatenate(self.wait)
            full = len(have) // self.block * self.block
            for k in range(0, full, self.block):
                self._block(have[k:k + self.block])
            self.wait, self.waiting = [have[full:]], len(have) - full

    def _block(self, ids: np.ndarray) -> None:
        packed = [self.pack.compress(p) for p in to_planes(ids, self.bits)]
        self.index.append((self.at, len(ids), *map(len, packed)))
        self.at += self.out.write(b"".join(packed))
        self.total += len(ids)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.wait))
        docs = np.concatenate([*self.docs, np.empty(0, np.int64)]).astype("<i8").tobytes()
        sizes = np.concatenate([*self.sizes, np.empty(0, np.int64)]).astype("<i8").tobytes()
        tail = self.pack.compress(docs + sizes)
        rows = np.array(self.index, "<i8").reshape(len(self.index), -1).tobytes()
        self.out.write(tail + rows + struct.pack("<QQQQ", self.at, len(tail), len(self.index), len(docs) // 8) + MAGIC)


class PlaneReader:
    """Random access to a file of ``PlaneWriter``."""

    def __init__(self, f):
        self.f = f
        f.seek(0)
        head = f.read(len(MAGIC) + 5)
        f.seek(f.size() - 32 - len(MAGIC))
        tail = f.read(32 + len(MAGIC))
        if head[:len(MAGIC)] != MAGIC or tail[32:] != MAGIC:
            raise ValueError("not a file of id planes, or cut short")
        self.bits, self.block = struct.unpack("<BI", head[len(MAGIC):])
        at, size, blocks, n = struct.unpack("<QQQQ", tail[:32])
        self.unpack = zstandard.ZstdDecompressor()
        f.seek(at)
        both = np.frombuffer(self.unpack.decompress(f.read(size)), "<i8") if size else np.empty(0, "<i8")
        self.doc_ids, self.sizes = both[:n], both[n:]
        planes = 32 if self.bits else 4
        self.index = np.frombuffer(f.read(blocks * 8 * (2 + planes)), "<i8").reshape(blocks, 2 + planes)

    def read_block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.index[k].tolist()
        self.f.seek(at)
        return from_planes([self.unpack.decompress(self.f.read(s)) for s in sizes], n, bool(self.bits))

    def read_ids(self, start: int, count: int) -> np.ndarray:
        """Ids [start, start + count) of the file, from the blocks that cover them."""
        if count <= 0:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (start + count - 1) // self.block
        have = np.concatenate([self.read_block(k) for k in range(first, last + 1)])
        return have[start - first * self.block:][:count]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts' ids with ``end_id`` after each."""
    to = at + np.arange(len(at))
    out = np.full(to[-1], end_id, np.uint32)
    keep = np.ones(to[-1], bool)
    keep[to[1:] - 1] = False
    out[keep] = ids
    return out, to


def write_planes(docs: DataFrame, path: str, end_id: int, bits: bool = False, block_ids: int = BLOCK_IDS,
                 folder: str | None = None) -> DataFrame:
    """Writes all documents' ids in ascending doc_id order; returns the manifest (part, file, n_docs, n_ids)."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "id-planes")

    def run(batches):
        enc, fs, writer, n_docs = encoder(path), None, None, 0
        for batch in slices(batches, "text"):
            if writer is None:
                fs, base = file_system(folder)
                fs.create_dir(base, recursive=True)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.planes"
                out = fs.open_output_stream(f"{base}/{name}")
                writer = PlaneWriter(out, bits, block_ids)
            ids, at = with_end(*enc.encode(texts(batch)), end_id)
            own = batch.column(0)
            # a null id is kept as the smallest long, which a real id may not be
            keys = np.asarray(pc.fill_null(own, np.iinfo(np.int64).min))
            writer.add(keys, np.diff(at), ids)
            n_docs += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]),
                 pa.array([n_docs], pa.int64()), pa.array([writer.total], pa.int64())],
                names=["part", "file", "n_docs", "n_ids"])

    rows = (pick(docs, doc_id="long", text="string").repartitionByRange("doc_id")
            .sortWithinPartitions("doc_id", "text"))
    files = written(rows.mapInArrow(run, "part int, file string, n_docs long, n_ids long"), "manifest")
    return files.withColumn("folder", F.lit(folder))


def read_planes(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest."""
    order = Window.orderBy("part")  # one row a file
    files = manifest.withColumn("base", F.sum("n_ids").over(order) - F.col("n_ids"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, base = file_system(row["folder"])
                with fs.open_input_file(f"{base}/{row['file']}") as f:
                    reader = PlaneReader(f)
                    ends = np.cumsum(reader.sizes)
                    starts = ends - reader.sizes
                    crcs = np.zeros(len(ends), np.int64)
                    doc, seen = 0, 0
                    for k in range(len(reader.index)):
                        data = reader.read_block(k).astype("<u4", copy=False)
                        upto = seen + len(data)
                        while doc < len(ends) and starts[doc] < upto:
                            part = data[max(starts[doc] - seen, 0):ends[doc] - seen]
                            crcs[doc] = zlib.crc32(part, int(crcs[doc]))
                            if ends[doc] > upto:
                                break
                            doc += 1
                        seen = upto
                    none = reader.doc_ids == np.iinfo(np.int64).min
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, pa.int64(), mask=none), pa.array(starts + row["base"], pa.int64()),
                         pa.array(reader.sizes, pa.int64()), pa.array(crcs, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.repartition(max(1, manifest.count()))
    return spread.select("folder", "file", "base").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")
