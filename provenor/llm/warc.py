"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id, each task writes its range to files rolled by
compressed size, and nothing counts until the manifest names it: files are
written under the name of the task attempt, moved to their final name, and one
manifest per write lists the files with sizes and digests. Record ids, dates and
gzip headers carry nothing that changes between runs, so a repeated task writes
the same bytes. Paths are URIs that pyarrow opens (``file:``, ``hdfs:``, ``s3:``, ``gs:``);
the folder must be one that all executors share.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.llm.packing import record_batch, shuffle_size, spark_schema
from provenor.session import materialise

#: Fixed values of the record format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ROLL_BYTES = 8 << 20
FILES = pa.schema([("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])
RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_()), ("file", pa.string()),
])


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record with fresh headers and digests; control characters of a url are percent-encoded."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without time or name."""
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + body + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


def with_revisits(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """The rows of ``pages`` (``page_id``, ``url``, ``html``, ``digest``) and, for each (id, digest) that is a revisit, a row with ``latest``.

    ``latest`` is the id of the record that holds the equal payload. Both kinds
    of rows go through the same range shuffle, so payloads are moved once and
    never joined.
    """
    rows = pages.select(pages[key].cast("bigint").alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(pages[payload].cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("html", 256)))
    ids = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "digest")
    groups = ids.groupBy("digest").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1 and latest is not null").drop("n")
    earlier = ids.join(groups, "digest").where("page_id is null or page_id < latest").select("page_id", "digest", "latest").distinct()
    return materialise(earlier, "revisits").unionByName(rows.withColumn("latest", F.lit(None).cast("bigint")), allowMissingColumns=True)


def _open(folder: str):
    from pyarrow import fs

    filesystem, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return filesystem, root.rstrip("/")


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0, roll: int = ROLL_BYTES) -> DataFrame:
    """Writes one record per row under ``folder`` and returns the manifest (file, bytes, records, sha256).

    Of rows with equal payloads of at least ``least_bytes``, those with the largest
    id hold the payload, the others are revisits of it. A null payload is empty, a
    null url is an empty target, null ids come first and count as smaller than
    others; repeated rows are records of their own. Other columns are not
    written. An empty table gives an empty manifest. Rows are ordered by (id, payload
    digest, url). A file takes records until it reaches ``roll`` compressed bytes.
    """
    spark = pages.sparkSession
    rows = with_revisits(pages, key, url, payload, least_bytes)
    ranged = rows.repartitionByRange(shuffle_size(spark), "page_id", "digest").sortWithinPartitions(
        "page_id", "digest", F.col("latest").asc_nulls_last(), "url"
    ).select("page_id", "url", "html", "digest", "latest")

    def run(batches):
        task = TaskContext.get()
        filesystem, root = _open(folder)
        filesystem.create_dir(f"{root}/data", recursive=True)
        name, held, size, records = 0, [], 0, 0
        revisit: tuple = ()

        def close() -> pa.RecordBatch:
            final = f"data/part-{task.partitionId():05d}-{name:05d}.warc.gz"
            temporary = f"{root}/data/.tmp-{task.partitionId()}-{name}-{task.taskAttemptId()}"
            data = b"".join(held)
            with filesystem.open_output_stream(temporary, compression=None) as out:
                out.write(data)
            filesystem.move(temporary, f"{root}/{final}")
            return record_batch(FILES, file=[final], bytes=[len(data)], records=[records], sha256=[hashlib.sha256(data).hexdigest()])

        for batch in batches:
            for page, target, html, digest, latest in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "latest")), strict=True):
                own = (page.as_py(), digest.as_py())
                if latest.is_valid:  # stands before the rows that it is about
                    revisit = (*own, latest.as_py())
                    continue
                earlier = revisit[2] if revisit[:2] == own else None
                member = gzip_member(record(own[0], target.as_py(), html.as_buffer().to_pybytes(), earlier, earlier is not None))
                held.append(member)
                size, records = size + len(member), records + 1
                if size >= roll:
                    yield close()
                    name, held, size, records = name + 1, [], 0, 0
        if held:
            yield close()

    manifest = f"{folder}/manifest"
    ranged.mapInArrow(run, spark_schema(FILES)).write.parquet(manifest)  # its own commit makes the write whole
    return spark.read.parquet(manifest)


def parse(data: bytes, name: str) -> Iterator[tuple]:
    """The records of a file, member by member."""
    at = 0
    while at < len(data):
        inflate, found = zlib.decompressobj(31), []
        while not inflate.eof:
            piece = data[at : at + 65_536]
            if not piece:
                raise ValueError(f"{name} ends within a record")
            found.append(inflate.decompress(piece))
            at += len(piece)
        at -= len(inflate.unused_data)
        raw = b"".join(found)
        head, rest = raw.split(b"\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        block = rest[: int(fields["Content-Length"])]
        http, body = block.split(b"\r\n\r\n", 1)
        length = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = fields["WARC-Type"] == "revisit"
        ok = fields["WARC-Block-Digest"] == f"sha1:{base32_sha1(block)}" and (revisit or (digest == base32_sha1(body) and length == len(body)))
        yield (
            _page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], length, digest, _page_of(fields.get("WARC-Refers-To")),
            None if revisit else body, ok, name,
        )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all files that the manifest names; a file left by a failed attempt is not read, a missing or changed one raises."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("file", "bytes", "sha256")
    spread = manifest.repartition(shuffle_size(spark), F.col("file"))

    def run(batches):
        filesystem, root = _open(folder)
        for batch in batches:
            for file, size, sha in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "sha256")), strict=True):
                with filesystem.open_input_stream(f"{root}/{file}", compression=None) as stream:
                    data = stream.read()
                if len(data) != size or hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{file} is not the file that the manifest names")
                rows, held = [], 0
                for row in parse(data, file):
                    rows.append(row)
                    held += row[3]
                    if held > 4 << 20:
                        yield record_batch(RECORDS, **dict(zip(RECORDS.names, map(list, zip(*rows, strict=True)), strict=True)))
                        rows, held = [], 0
                if rows:
                    yield record_batch(RECORDS, **dict(zip(RECORDS.names, map(list, zip(*rows, strict=True)), strict=True)))

    return spread.mapInArrow(run, spark_schema(RECORDS))
