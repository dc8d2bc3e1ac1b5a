"""WARC archives compressed with a Zstandard dictionary, and their reader.

Each ``.warc.zst`` file starts with a skippable frame (magic 0x184D2A5D) that holds a dictionary trained on
records of that file; every record then is a frame of its own, compressed with that dictionary. Files that
hold too few records for training have no dictionary frame.

Writing is one shuffle: pages are joined on their payload digest with the smallest id of each digest that
occurs more than once (pre-aggregated, so a hot payload is counted before it moves), and each task writes its
rows as files of about FILE_BYTES of records. Names hold the task attempt, and only files listed in the
manifest, which commits with its task, are read: a lost executor leaves unlisted files and no wrong rows.

Defined results: null html is an empty payload. A null url leaves WARC-Target-URI out. Rows with a null id
are responses unless an id is known for their payload. Rows that repeat an id and payload are all responses
if the id is the smallest. Line ends in urls are percent-encoded. Only id, url and html are read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.llm.common import shared_dir, table, written

DICTIONARY_MAGIC = 0x184D2A5D
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
SAMPLES = 256
MIN_SAMPLES = 16
LEAST_PIECE, MOST_PIECE = 256, 4096
LEVEL = 3
FILE_BYTES = 16 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ROW_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _record(record_id: str, page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {DATE}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_for(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on pieces spread evenly over all of the records, SAMPLE_BYTES at most; None if they are too few.

    Records of any size are cut into pieces first, so a few large ones give as many samples as many small ones.
    """
    total = sum(map(len, records))
    piece = max(LEAST_PIECE, min(MOST_PIECE, total // SAMPLES))
    pieces = [r[i : i + piece] for r in records for i in range(0, len(r), piece)]
    samples = pieces[:: max(1, total // SAMPLE_BYTES)]
    if len(samples) < MIN_SAMPLES:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 8), samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive_bytes(records: list[bytes]) -> bytes:
    """One archive: the dictionary in a skippable frame, then a frame for each record."""
    dictionary = dictionary_for(records)
    out = io.BytesIO()
    if dictionary is not None:
        dictionary.precompute_compress(level=LEVEL)
        content = dictionary.as_bytes()
        out.write(struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    for record in records:
        out.write(compressor.compress(record))
    return out.getvalue()


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, payload) of each record of an archive."""
    magic, size = struct.unpack_from("<II", archive) if len(archive) >= 8 else (0, 0)
    dictionary, start = None, 0
    if magic == DICTIONARY_MAGIC:
        start = 8 + size
        dictionary = zstandard.ZstdCompressionDict(archive[8:start])
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj(read_across_frames=True)
    stream = io.BytesIO(reader.decompress(memoryview(archive)[start:]))
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("not at a WARC record")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b": ")
            headers[name.decode()] = value.decode("utf-8", "surrogatepass")
        block = stream.read(int(headers["Content-Length"]))
        stream.read(4)
        yield headers, block.partition(b"\r\n\r\n")[2]


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes a record for each page below folder; returns the manifest (path, n_records, n_bytes), itself written."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha1(payload).alias("digest"), (F.octet_length(payload) >= min_bytes).alias("counts"))
    firsts = rows.where("counts").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id")
    firsts = written(firsts, "warc-firsts")  # read back, so that adaptive execution may split a hot digest or broadcast few
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("counts") & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    ready = joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        stem = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        files, records, held = 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal files, held
            name = f"{stem}-{files:05d}.warc.zst"
            data = archive_bytes(records)
            with store.open_output_stream(f"{top}/{name}", compression=None) as out:
                out.write(data)
            done = pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [len(records)], "n_bytes": [len(data)]})
            files, held = files + 1, 0
            records.clear()
            return done

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{stem}/{files}/{len(records)}"))
                records.append(_record(record_id, page_id, url, html, name, refers_to, refers_to is not None))
                held += len(records[-1])
                if held >= FILE_BYTES:
                    yield flush()
        if records:
            yield flush()

    return written(ready.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the listed archives; raises if a response's payload doesn't have its digest."""
    n = manifest.count()
    schema = ROW_SCHEMA + (", payload binary" if with_payload else "")
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())] + [("payload", pa.binary())] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    archive = file.read()
                rows = []
                for headers, payload in records_of(archive):
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(headers["WARC-Payload-Length"])
                    if kind == "response" and (len(payload) != size or _digest(payload) != digest):
                        raise ValueError(f"{path}: a payload doesn't have its digest")
                    page_id, refers_to = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
                    row = (None if page_id is None else int(page_id), size, digest, kind, None if refers_to is None else int(refers_to), headers.get("WARC-Target-URI"))
                    rows.append((*row, payload if kind == "response" else None) if with_payload else row)
                for start in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows[start : start + 2000], strict=True), fields, strict=True)], [f for f, _ in fields])

    return manifest.select("path").repartition(max(1, n), "path").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
