"""WARC archives in which every record is a Zstandard frame with the archive's own dictionary.

Of pages with equal payloads of at least ``least`` bytes the smallest page_id becomes
the response record and the others revisit it; smaller payloads are all responses. A
task takes its rows in page order, buffers records up to a bound, trains a dictionary
on the first TRAINING_BYTES of them, and writes an archive: first a skippable frame (magic 0x184D2A5D) that holds
the dictionary, then one frame per record. Archive names depend on the task's place
and files appear by renaming, so a repeated task overwrites what it wrote before.

Null html is an empty payload, a null url ``about:blank``. Null page_ids are written
but never referred to. Rows that repeat a page_id are records of their own; of equal
payloads all rows with the smallest page_id are responses. A very long payload is one
record, however large. Extra columns are ignored; no pages give no archives.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes, urlparse

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filter_of, materialise, may_hold

LEAST = 100
#: Raw bytes of the records in one archive, about; a single record may exceed it.
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes of an archive's records that its dictionary is trained on.
TRAINING_BYTES = 4 << 20
LEVEL = 3
DATE = "2026-01-01T00:00:00Z"
MAGIC = 0x184D2A5D


def classify(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to, refers_uri.

    Payloads stay where they are read, unless their digest may occur again; of those only
    one that may be a group's first goes through the join with its html. Both are told by
    filters of fixed size, whose errors only cost a shuffled payload.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2("html", 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    large = rows.where(F.col("payload_bytes") >= least)
    # written, so that the join below deals both sides anew and AQE can split a frequent payload
    first = materialise(large.groupBy("payload_digest").agg(F.min_by(F.struct(F.col("page_id").alias("id"), F.col("url").alias("uri")), F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first.id is not null").drop("n"))
    again, lead = filter_of(first, "payload_digest"), filter_of(first.select("payload_digest", F.col("first.id").alias("page_id")), "payload_digest", "page_id")
    marked = may_hold(may_hold(rows, again, "payload_digest", name="again"), lead, "payload_digest", "page_id", name="lead")
    whole = ["page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to", "refers_uri"]
    marked = marked.withColumn("again", F.col("again") & (F.col("payload_bytes") >= least))
    alone = marked.where("not again").withColumns({"payload": F.col("html"), "refers_to": F.lit(None).cast(pages.schema["page_id"].dataType), "refers_uri": F.lit(None).cast("string")})
    # a page without id refers to the first like any other; it is no first itself
    met = marked.where("again").withColumn("html", F.when(F.col("lead"), F.col("html"))).join(first, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.id"))
    met = met.withColumns({"refers_to": F.when(revisit, F.col("first.id")), "refers_uri": F.when(revisit, F.col("first.uri"))})
    told = met.where(F.col("refers_to").isNotNull() | F.col("html").isNotNull()).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("html")))
    out = alone.select(whole).unionByName(told.select(whole))
    # digests that the filter wrongly took for repeated ones: few pages, whose html is fetched
    lost = materialise(met.where(F.col("refers_to").isNull() & F.col("html").isNull()).select("page_id", "payload_digest").distinct())
    if not lost.isEmpty():
        back = may_hold(marked.where("again and not lead"), filter_of(lost, "payload_digest", "page_id"), "payload_digest", "page_id", name="fetch").where("fetch")
        found = lost.select(F.col("payload_digest").alias("lost_digest"), F.col("page_id").alias("lost_id"))
        back = back.join(found, F.col("page_id").eqNullSafe(F.col("lost_id")) & (F.col("payload_digest") == F.col("lost_digest")), "left_semi")
        back = back.withColumns({"payload": F.col("html"), "refers_to": F.lit(None).cast(pages.schema["page_id"].dataType), "refers_uri": F.lit(None).cast("string")})
        out = out.unionByName(back.select(whole))
    return out


def _name(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _uri(url: str | None) -> str:
    return quote(url, safe="%:/?#[]@!$&'()*+,;=-._~") if url else "about:blank"


def record(page_id, url, payload, digest: str, size: int, refers_to, refers_uri) -> bytes:
    """One WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or "").encode()
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}",
            f"WARC-Refers-To-Target-URI: {_uri(refers_uri)}", f"WARC-Refers-To-Date: {DATE}", f"Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> bytes:
    """A dictionary from the records; with too few to train on, their own bytes serve as one."""
    sample, size = [], 0
    for r in records:
        if size >= TRAINING_BYTES:
            break
        sample.append(r[: TRAINING_BYTES // 16])
        size += len(sample[-1])
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, size // 16)), sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[: DICTIONARY_BYTES // 8] or b"WARC/1.1"


def archive(records: list[bytes]) -> bytes:
    raw = train(records)
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    return struct.pack("<II", MAGIC, len(raw)) + raw + b"".join(map(coder.compress, records))


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the archive does not begin with its dictionary")
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        frame, out = coder.decompressobj(), []
        while not frame.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            part = view[at : at + 65536]
            out.append(frame.decompress(part))
            at += len(part)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's named fields, its HTTP head and its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def _store(uri: str, data: bytes) -> None:
    """Write a file under another name, then rename it."""
    where = urlparse(uri)
    if where.scheme in ("", "file"):
        path = unquote_to_bytes(where.path).decode()
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{uuid.uuid4().hex}.tmp", "wb") as f:
            f.write(data)
        os.replace(f.name, path)
    else:
        from pyarrow.fs import FileSystem

        # Hadoop's names of stores, as arrow knows them
        fs, path = FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}.get(where.scheme, where.scheme) + uri[len(where.scheme) :])
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        temporary = f"{path}.{uuid.uuid4().hex}.tmp"
        with fs.open_output_stream(temporary) as f:
            f.write(data)
        fs.move(temporary, path)


def _write(folder: str, limit: int):
    def run(batches):
        task, n = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal n, held, size
            path = f"{folder}/part-{task:06d}-{n:05d}.warc.zst"
            data = archive(held)
            _store(path, data)
            out = pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(held)], pa.int64()), pa.array([size], pa.int64()), pa.array([len(data)], pa.int64())], ["path", "records", "raw_bytes", "bytes"])
            n, held, size = n + 1, [], 0
            return out

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(*row))
                size += len(held[-1])
                if size >= limit:
                    yield flush()
        if held:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write every page as a record of the archives in ``folder``, which all executors share."""
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)  # also without pages
    rows = classify(pages, least).sortWithinPartitions("page_id")
    rows.mapInArrow(_write(folder, archive_bytes), "path string, records long, raw_bytes long, bytes long").write.format("noop").mode("overwrite").save()


def _read(batches):
    for batch in batches:
        for data in batch.column("content"):
            rows = []
            for r in records_of(data.as_py()):
                fields, http, payload = parse(r)
                named = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                full = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                kind = fields["WARC-Type"]
                if kind == "response" and (hashlib.sha256(payload).hexdigest() != named or len(payload) != full):
                    raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not match its digest")
                number = lambda k, f=fields: int(f[k]) if k in f else None
                rows.append((number("Page-ID"), fields["WARC-Target-URI"], full, named, kind, number("Refers-To-Page-ID"), payload.decode()))
            cols = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["page_id", "uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, uri, payload_bytes, payload_digest, record_type, refers_to and payload (empty for revisits) of every record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(_read, "page_id long, uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM d
"""
