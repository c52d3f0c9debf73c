"""Dictionary-compressed WARC archives of web pages, and their reader.

Every page is one record. Of pages with equal payloads of at least ``MIN_REVISIT`` bytes, the
one with the largest id is a ``response``, the others are ``revisit`` records that name it;
smaller payloads are always stored. Equality is that of the SHA-1 digest. The largest id of a
digest is a grouped maximum (combined map-side), joined back by digest, so a payload shared by
a third of all pages is no group in one task.

Each task writes its partition as archives of about ``ARCHIVE_BYTES`` of payload to the shared
folder: a Zstandard dictionary trained on a spread of the archive's own payloads goes into a
leading skippable frame (magic 0x184D2A5D), then each record is one frame compressed with it.
Archive names hold the task attempt; only those reported by successful attempts are read, so
a lost executor leaves no wrong record. The reader streams an archive, checks each payload
against its digest, and never holds more than one record.

Null html is an empty payload; null url omits the target. Rows sharing an id and a payload
are stored alike (all response, or all revisit). Pages with a null id are never referred to.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import urllib.parse
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, shared_path

MIN_REVISIT = 1000
ARCHIVE_BYTES = 32 << 20
DICT_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20  # payload bytes a dictionary is trained on
SAMPLE_PIECE = 8 << 10
SKIPPABLE = 0x184D2A5D
FULL_DICT = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def _headers(fields: list[tuple[str, object]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in fields if v is not None) + b"\r\n"


def build_record(page: int | None, url: str | None, payload: bytes, digest: str, owner: int | None, length: int) -> bytes:
    """A response record, or a revisit of page ``owner`` (whose payload is not repeated)."""
    http = b"HTTP/1.1 200 OK\r\n" + _headers([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", length)])
    block = http if owner is not None else http + payload
    target = None if url is None else urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")
    label = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = b"WARC/1.1\r\n" + _headers([
        ("WARC-Type", "response" if owner is None else "revisit"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", DATE),
        ("WARC-Target-URI", target), ("WARC-Payload-Digest", label), ("X-Payload-Length", length), ("X-Page-Id", page),
        ("WARC-Profile", None if owner is None else PROFILE), ("WARC-Refers-To", None if owner is None else record_id(owner, digest)),
        ("X-Refers-To-Page", owner), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))])
    return head + block + b"\r\n\r\n"


def train(payloads: list[bytes]) -> bytes:
    """A dictionary from a spread of the payloads; their own bytes where there are too few."""
    full = [p for p in payloads if p]
    step = max(1, sum(min(len(p), SAMPLE_PIECE) for p in full) // SAMPLE_BYTES)
    samples = [p[:SAMPLE_PIECE] for p in full[::step]]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES]


def as_dict(data: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if data.startswith(FULL_DICT) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archive(uri: str, records: list[bytes], dictionary: bytes) -> int:
    """The archive file; written under a temporary name, then renamed."""
    fs, path = filesystem(uri)
    with_dict = zstandard.ZstdCompressor(level=3, **({"dict_data": as_dict(dictionary)} if dictionary else {}))
    size = 0
    with fs.open_output_stream(path + ".part", compression=None) as out:
        frames = [struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary] if dictionary else []
        for frame in (*frames, *(with_dict.compress(r) for r in records)):
            out.write(frame)
            size += len(frame)
    fs.move(path + ".part", path)
    return size


def read_archive(uri: str):
    """(headers, block) of each record, streamed."""
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as raw:
        head = raw.read(8)
        magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
        dictionary = raw.read(size) if magic == SKIPPABLE else b""
        rest = raw if magic == SKIPPABLE else io.BytesIO(head + raw.read())
        ctx = zstandard.ZstdDecompressor(**({"dict_data": as_dict(dictionary)} if dictionary else {}))
        text = io.BufferedReader(ctx.stream_reader(rest, read_across_frames=True, closefd=False), 1 << 16)
        while line := text.readline():
            if line.strip() != b"WARC/1.1":
                raise ValueError(f"not a record: {line[:40]!r} in {uri}")
            headers = {}
            while (line := text.readline()).strip():
                name, _, value = line.decode().partition(":")
                headers[name] = value.strip()
            block = text.read(int(headers["Content-Length"]))
            if text.read(4) != b"\r\n\r\n":
                raise ValueError(f"record of wrong length in {uri}")
            yield headers, block


def _write(folder: str):
    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        tag, number = f"{context.partitionId():06d}-{context.taskAttemptId()}", 0
        held, size, names, counts, sizes = [], 0, [], [], []

        def flush():
            nonlocal held, size, number
            if held:
                uri = f"{folder}/pages-{tag}-{number:05d}.warc.zst"
                dictionary = train([p for _, _, p, _, o, _ in held if o is None])
                sizes.append(write_archive(uri, [build_record(*h) for h in held], dictionary))
                names.append(uri)
                counts.append(len(held))
                held, size, number = [], 0, number + 1

        for b in batches:
            for page, url, payload, digest, owner, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((page, url, payload or b"", digest, owner, length))
                size += len(held[-1][2]) + 512
                if size >= ARCHIVE_BYTES:
                    flush()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())],
                                         names=["archive", "records", "bytes"])

    return write


def _read(batches):
    for b in batches:
        for uri in b.column(0).to_pylist():
            rows = []
            for headers, block in read_archive(uri):
                digest = base64.b32decode(headers["WARC-Payload-Digest"].partition(":")[2]).hex()
                kind, length = headers["WARC-Type"], int(headers["X-Payload-Length"])
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != length:
                        raise ValueError(f"{headers['WARC-Record-ID']} in {uri} is damaged")
                page, owner = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page")
                rows.append((None if page is None else int(page), length, digest, kind, None if owner is None else int(owner),
                             headers.get("WARC-Target-URI"), uri))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "archive"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, archive string"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives into ``folder``; returns (archive, records, bytes)."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("length"))
    owners = base.where(F.col("length") >= MIN_REVISIT).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    owners = materialise(owners.where("n > 1 and owner is not null").select("digest", "owner"), "owners")
    # A hot digest is split by the planner's skew handling; a revisit carries no payload on.
    rows = base.join(owners, "digest", "left")
    owner = F.when(F.col("page_id").eqNullSafe(F.col("owner")), F.lit(None)).otherwise(F.col("owner"))
    rows = rows.select("page_id", "url", F.when(owner.isNull(), F.col("payload")).alias("payload"), "digest", owner.alias("owner"), "length")
    return materialise(rows.mapInArrow(_write(folder), "archive string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of the listed archives; payloads are checked against their digests."""
    n = max(1, archives.count())
    return archives.select("archive").repartition(min(n, 10_000)).mapInArrow(_read, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    folder = shared_path(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    jvm = pages.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    return read_archives(write_archives(pages, folder))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
o AS (SELECT digest, max(page_id) AS owner FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN o.owner IS NULL OR o.owner = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN o.owner <> d.page_id THEN o.owner END AS refers_to
FROM d LEFT JOIN o ON o.digest = d.digest AND d.n >= 1000
"""
