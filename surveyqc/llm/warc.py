"""WARC archives: written by tasks with an index, read back through coalesced byte ranges of the index.

Each record is a gzip member of its own, so that any record can be read from its offset and length. Equal payloads are stored
once: the record with the largest page_id is the response, the others are revisits that refer to it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyqc.llm.common import shared_dir, small_or_shuffled, written

MIN_REVISIT_BYTES = 1000
#: Ranges of one file that lie within this gap are read at once, up to RANGE_BYTES.
GAP_BYTES = 64 << 10
RANGE_BYTES = 1 << 20
TASK_BYTES = 16 << 20
FILE_BYTES = 1 << 30
INDEX = "page_id long, url string, file string, offset long, length long, digest string, record_type string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def classify(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) with payload_bytes, digest, record_type, refers_to.

    A null html is an empty payload; payloads under min_bytes are always responses. Of repeated rows with the largest
    page_id, all are responses. Equal digests are counted and written before they are joined: a row a common payload is broadcast. If
    there are too many for that, revisits are told by narrow rows, and payloads are shuffled by page, never by a common digest.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first_"), F.count("*").alias("n_"))
    repeated = written(shared.where("n_ > 1").drop("n_"), "digests")
    if (small := small_or_shuffled(repeated)) is repeated:
        told = written(rows.select("page_id", "digest").join(repeated, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_"))).distinct(), "revisits")
        same = rows["page_id"].eqNullSafe(told["page_id"]) & (rows["digest"] == told["digest"])
        joined = rows.join(told, same, "left").select(*[rows[c] for c in rows.columns], told["first_"])
    else:
        joined = rows.join(small, "digest", "left")
    revisit = F.col("first_").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_")).alias("refers_to"))


def _header(value: object) -> str:
    return " ".join(str("" if value is None else value).split())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP headers only; Content-Length there is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if record_type == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The inverse of `record`."""
    import hashlib

    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda x: None if x in (None, "<urn:x-page:none>") else int(x[len("<urn:x-page:") : -1])
    kind, told = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != told:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": int(named["Content-Length"]), "payload_digest": told, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def write_archives(classified: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the records, returns their index (a written table): page_id, url, file, offset, length, digest, record_type.

    Each task attempt writes files of its own; the index names only those of attempts that Spark committed, so a lost or
    repeated task leaves no wrong entry. The folder is shared by all executors.
    """
    folder = folder or f"{shared_dir(classified.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        name, out, at, n = "", None, 0, 0
        for batch in batches:
            index = []
            for r in batch.to_pylist():
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n}.warc.gz", 0, n + 1
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = record(r["page_id"], r["url"], r["payload"], r["digest"], r["record_type"], r["refers_to"])
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                out.write(member)
                index.append((r["page_id"], r["url"], f"{folder}/{name}", at, len(member), r["digest"], r["record_type"]))
                at += len(member)
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*index, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["page_id", "url", "file", "offset", "length", "digest", "record_type"])
        if out is not None:
            out.close()

    return written(classified.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that the index rows name: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Rows are dealt by file and stretch of RANGE_BYTES and sorted by offset; neighbours are read in one request. Any
    selection of the index may be given; an empty one gives no rows. A revisit has a null payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]

        def emit(file: str, group: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            store, path = fs.FileSystem.from_uri(file) if "://" in file else (fs.LocalFileSystem(), file)
            begin, end = group[0][0], max(o + n for o, n in group)
            with store.open_input_file(path) as f:
                data = f.read_at(end - begin, begin)
            rows = [parse(zlib.decompress(data[o - begin : o - begin + n], 31)) for o, n in group]
            if not payloads:
                for r in rows:
                    r["payload"] = None
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types, strict=True)], names)

        file, group = None, []
        for batch in batches:
            for f, o, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if group and (f != file or o - (group[-1][0] + group[-1][1]) > GAP_BYTES or o + n - group[0][0] > RANGE_BYTES):
                    yield from emit(file, group)
                    group = []
                file = f
                group.append((o, n))
        if group:
            yield from emit(file, group)

    ranges = index.select("file", "offset", "length")
    total = ranges.agg(F.sum("length")).first()[0] or 0  # index rows are narrow: the tasks are counted by what they will read
    dealt = ranges.repartition(max(1, -(-total // TASK_BYTES)), "file", F.expr(f"offset div {RANGE_BYTES}")).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, RECORD)
