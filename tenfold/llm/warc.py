"""WARC archives in Zstandard: a dictionary in a leading skippable frame, one frame per record.

The writer makes files of bounded size through pyarrow's file systems and returns a manifest;
only files named there count, so those of lost or repeated tasks are ignored.  The reader
loads the dictionary, decodes frame after frame, and validates headers, lengths and digests.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, staged

#: Fixed values of the formats: magic numbers of the dictionary's frame, of the first skippable frame and of a compressed one, first line of a record.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE, ZSTD_MAGIC = 0x184D2A50, bytes.fromhex("28b52ffd")
VERSION = b"WARC/1.1"
#: Payload bytes of one archive; payloads of fewer bytes are never revisits; sample and size for the dictionary.
ARCHIVE_BYTES = 16 << 20
REVISIT_BYTES = 100
SAMPLE_RECORDS, DICTIONARY_BYTES = 200, 16 << 10
#: Bytes given to the decompressor at once.
SLICE = 8 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def record(page_id: int | None, url: str | None, kind: str, refers_to: int | None, digest: str, payload: bytes) -> bytes:
    """One record. A revisit has no block; its header tells the length and digest of the whole payload."""
    block = payload if kind == "response" else b""
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("X-Page-ID", page_id), ("WARC-Target-URI", url and url.replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", len(payload)), ("Content-Type", "text/html"), ("Content-Length", len(block))]
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", refers_to)]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode() for k, v in head if v is not None), b"", block, b"", b""])


def parse(data: bytes) -> dict:
    """A record's fields; ``error`` tells what does not hold, and is None for a valid one."""
    out = dict.fromkeys(("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "error"))
    head, end, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not end or first != VERSION:
        return out | {"error": "no WARC header"}
    fields = {k.strip().lower().decode(): v.removeprefix(b" ").decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines)}
    fields |= {k: v.strip() for k, v in fields.items() if k != "warc-target-uri"}  # an address is given back as it was written
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        return out | {"error": f"no {missing[0]}"}
    try:
        length = int(fields["content-length"])
        number = lambda k: int(fields[k]) if k in fields else None
        out |= {"page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload_bytes": number("x-payload-length"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:")}
    except ValueError as e:
        return out | {"error": f"bad number: {e}"}
    block = rest[:length]
    if length < 0 or len(block) != length or rest[length:] != b"\r\n\r\n":
        return out | {"error": "Content-Length does not hold"}
    if out["record_type"] == "response":
        if len(block) != out["payload_bytes"]:
            return out | {"error": "payload length does not hold"}
        if hashlib.sha256(block).hexdigest() != out["payload_digest"]:
            return out | {"error": "payload digest does not hold"}
        out["payload"] = block
    return out


def archive(records: list[bytes]) -> bytes:
    """The bytes of one archive."""
    import zstandard

    dictionary = b""
    if sum(map(len, records[:SAMPLE_RECORDS])) > 8 * DICTIONARY_BYTES and len(records) > 16:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, records[:SAMPLE_RECORDS]).as_bytes()
        except zstandard.ZstdError:  # records too much alike
            dictionary = b""
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + b"".join(map(packer.compress, records))


def _dictionary(data: bytes) -> tuple[object, int]:
    """The dictionary of an archive's leading frame, if it has one, and where the records begin. A dictionary may be compressed itself."""
    import zstandard

    if not data:
        raise ValueError("no frame")
    if data[:4] == ZSTD_MAGIC:
        return None, 0
    if len(data) < 8:
        raise ValueError("no leading frame")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC or len(data) < 8 + size:
        raise ValueError("no dictionary frame")
    held = data[8 : 8 + size]
    if held[:4] == ZSTD_MAGIC:
        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
    return zstandard.ZstdCompressionDict(held) if held else None, 8 + size


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame; skippable frames between them are passed over. The bytes are handed on in slices, of which only the last is copied again."""
    import zstandard

    dictionary, at = _dictionary(data)
    view = memoryview(data)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        if len(view) >= at + 8 and SKIPPABLE <= int.from_bytes(view[at : at + 4], "little") < SKIPPABLE + 16:
            at += 8 + int.from_bytes(view[at + 4 : at + 8], "little")
            continue
        reader, parts = decompressor.decompressobj(), []
        while not reader.eof:
            if at >= len(view):
                raise ValueError("a frame ends early")
            piece = view[at : at + SLICE]
            parts.append(reader.decompress(piece))
            at += len(piece)
        at -= len(reader.unused_data)
        yield b"".join(parts)


def classified(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, record_type, refers_to): the first page of equal payloads is the response.

    A hot payload is counted with partial sums; the join back may be split by Spark.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    later = F.expr(f"first IS NOT NULL AND octet_length(html) >= {REVISIT_BYTES} AND NOT (page_id <=> first)")
    return rows.join(first, "payload_digest", "left").select("page_id", "url", "html", "payload_digest", F.when(later, "revisit").otherwise("response").alias("record_type"), F.when(later, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as archives; returns the manifest (path, n_records, n_bytes), itself a stored table.

    A null html is an empty payload; payloads under 100 bytes are always responses; equal
    page_ids with equal payloads are all responses; a null page_id comes after all others
    and is kept as null; other columns are left out; an empty table makes no archive.
    """
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _fs(folder)
        files.create_dir(root, recursive=True)
        task, held, size, n = TaskContext.get(), [], 0, 0

        def put() -> pa.RecordBatch:
            data, name = archive(held), f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{n:05d}.warc.zst"
            with files.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [len(held)], "n_bytes": [len(data)]})

        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, digest, kind, refers_to = (batch.column(c)[row].as_py() for c in range(6))
                held.append(record(page_id, url, kind, refers_to, digest, html))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield put()
                    held, size, n = [], 0, n + 1
        if held:
            yield put()

    return staged(classified(pages).mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """The records of the archives named in ``path``; rows that do not hold have an ``error``, which the caller decides about.

    A page without html comes back with an empty payload, one without an id with a null id; equal
    pages come as often as they were written; a manifest without rows gives none.  An archive is
    read whole; it holds ARCHIVE_BYTES of records and the last record's rest at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, RECORD.split(", "), strict=True)])

        def rows(path: str) -> Iterator[dict]:
            files, at = _fs(path)
            with files.open_input_stream(at) as f:
                data = f.read()
            try:
                yield from map(parse, frames(data))
            except Exception as e:  # noqa: BLE001  what the archive holds decides which; the row tells it
                yield dict.fromkeys(names) | {"error": f"{path}: {e}"}

        for batch in batches:
            for path in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(tasks).mapInArrow(run, RECORD)
