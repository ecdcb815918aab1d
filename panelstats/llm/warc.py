"""Dictionary-compressed WARC archives (operator 7).

Each task writes one archive: a leading skippable Zstandard frame with the dictionary,
then every record as a frame of its own, compressed with that dictionary.  The dictionary
is built from a bounded sample of the records.  Of records with equal payloads the one
with the smallest page_id is the response and the others are revisits that refer to it.
Only archives in the written manifest are read back, so retried tasks leave no trace.

Groups of equal payloads are found by digest; the digests are counted with partial
aggregation and joined back under a salt, so a payload that a third of all pages share
is spread over many tasks.

Edge cases: a null html is an empty payload; a null url is an empty target; rows with a
null page_id are never referred to (alone with their payload they are responses); rows
that repeat the smallest page_id of a payload are each a response; payloads may be of any
length; an empty table writes nothing and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, pick, shared_folder, slices, written

SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
SALTS, DICT_BYTES, DICT_RECORDS, DICT_RECORD_BYTES = 32, 65_536, 800, 32_768
#: Fixed namespace of the record ids made from page ids.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the response's headers but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {' '.join(url.split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
            f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block); the block's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[:int(headers["Content-Length"])]
    if first != "WARC/1.1" or headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("damaged WARC record")
    return headers, block


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of samples too few to train on, their ends as raw content."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def read_archive(f, chunk: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, streamed frame by frame."""
    magic, size = struct.unpack("<II", f.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(f.read(size)))
    wait = f.read(chunk)
    while wait:
        frame, parts = unpack.decompressobj(), []
        while True:
            parts.append(frame.decompress(wait))
            if frame.eof:
                wait = frame.unused_data or f.read(chunk)
                break
            wait = f.read(chunk)
            if not wait:
                raise ValueError("archive cut short")
        yield parse_record(b"".join(parts))


def decide(pages: DataFrame, least_bytes: int = 0, salts: int = SALTS) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to) of every page."""
    rows = pick(pages, page_id="long", url="string", html="string").select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    groups = (rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
              .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    joined = rows.join(groups, ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, least_bytes: int = 0, level: int = 3, folder: str | None = None) -> DataFrame:
    """Writes all pages' records; returns the manifest (folder, file, n_records)."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")
    rows = pick(pages, page_id="long", url="string", html="string")
    # ids first: every task sends its candidates to the driver
    chosen = rows.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(DICT_RECORDS).distinct()
    sample = (rows.select("page_id", "url", F.substring("html", 1, DICT_RECORD_BYTES).alias("html"))
              .join(F.broadcast(chosen), "page_id").dropDuplicates(["page_id"]).orderBy("page_id").collect())
    dictionary = build_dictionary([record(r["page_id"], r["url"] or "", (r["html"] or "").encode(), "response", None)
                                   for r in sample])

    def run(batches):
        out, n = None, 0
        for batch in slices(batches, "payload"):
            if out is None:
                fs, base = file_system(folder)
                fs.create_dir(base, recursive=True)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                out = fs.open_output_stream(f"{base}/{name}")
                out.write(dictionary_frame(dictionary))
                press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
            for row in batch.to_pylist():
                out.write(press.compress(record(row["page_id"], row["url"], row["payload"], row["record_type"],
                                                row["refers_to"])))
            n += batch.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_records"])

    files = decide(pages, least_bytes).mapInArrow(run, "file string, n_records long")
    return written(files, "warc-manifest").withColumn("folder", F.lit(folder))


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; a
    response's size and digest are taken from its payload and checked against its headers."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def told(headers: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        own = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != own):
            raise ValueError("payload differs from its headers")
        ids = (headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id"))
        page, refers = (None if x is None else int(x) for x in ids)
        return page, size, own, headers["WARC-Type"], refers

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, base = file_system(row["folder"])
                rows = []
                with fs.open_input_stream(f"{base}/{row['file']}") as f:
                    for headers, block in read_archive(f):
                        rows.append(told(headers, block))
                        if len(rows) == 10_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                          names=names)

    spread = manifest.select("folder", "file").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
