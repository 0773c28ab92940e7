"""WARC: writer and reader of ``.warc.zst`` archives with an embedded dictionary.

The dictionary is built from a bounded, documented sample of the records (about ``sample_rows`` records, chosen by hash, and
``sample_bytes`` bytes of each at most: only compression depends on it). Each archive begins with a skippable frame
(magic 0x184D2A5D) that holds it; every record follows as a frame of its own, so that one can be read alone.
Records of equal payload are found by digest: the largest page_id of a digest is the response, the others become revisit
records that name it; payloads under ``min_revisit`` bytes are always responses.

Defined cases: a null html is an empty payload; a null url is written as an empty URI; a null page_id as an empty id (read back as
null) and, among equal payloads, as the smallest; rows that tie for the largest page_id are all responses. An empty table
writes no archive and reads back empty. Other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batches, fresh_path, join_small, spill

MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def classify(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """page_id, url, html, digest, and refers_to: the page whose response this row's payload repeats."""
    html = F.coalesce(F.col("html"), F.lit(""))
    base = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("size"))
    # One row a repeated digest; while those are few, the pages' texts needn't be exchanged to learn their keeper.
    last = base.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
    last = spill(last.where("copies > 1").drop("copies"), "warc-keepers")
    both = join_small(base, last, ["digest"], "left")
    refers = F.when((F.col("size") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return both.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    payload = html.encode("utf-8")
    own = f"<urn:page:{'' if page_id is None else page_id}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(url.split()) if url else "WARC-Target-URI:", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), f"WARC-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block = http + payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        block = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; a response's payload is digested again and held against its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    size = int(fields["warc-payload-length"])
    ident = lambda v: int(x) if (x := v.removeprefix("<urn:page:").rstrip(">")) else None
    if fields["warc-type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"{fields['warc-record-id']}: its payload doesn't match its digest")
        fields["payload"] = payload
    return fields | {
        "page_id": ident(fields["warc-record-id"]), "url": fields.get("warc-target-uri") or None, "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["warc-type"], "refers_to": ident(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
    }


def train_dictionary(records: list[bytes], size: int = 65_536) -> bytes:
    """A dictionary of the sampled records; where they are too few to train one, their own bytes as a raw-content dictionary."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-size:] or b"WARC/1.1\r\n"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "", 1))


def write_archives(classified: DataFrame, path: str, sample_rows: int = 1000, sample_bytes: int = 16_384, max_bytes: int = 1 << 30, total: int | None = None) -> DataFrame:
    """Write archives of at most about ``max_bytes`` below ``path``, and return their manifest, itself stored in ``path``/manifest.

    A task writes each archive under a name of its own attempt; only archives of attempts that Spark committed are in the manifest,
    so a lost or repeated task leaves no record twice.
    """
    spark = classified.sparkSession
    # A hash below a bound picks the sample, so the driver gets about as many rows from any number of partitions.
    share = sample_rows / max(1, total if total is not None else classified.count())
    some = classified if share >= 1 else classified.where(F.pmod(F.xxhash64("digest", "page_id"), F.lit(1_000_000_007)) < int(share * 1_000_000_007))
    sample = some.select("page_id", "url", F.substring("html", 1, sample_bytes).alias("html"), "digest", "refers_to").limit(2 * sample_rows).collect()
    dictionary = train_dictionary([record(*r)[:sample_bytes] for r in sample])
    shared = spark.sparkContext.broadcast(dictionary)  # 64 KB

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        fs, root = _filesystem(path)
        packed = zstandard.ZstdCompressor(level=19).compress(shared.value)
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared.value), write_checksum=True, write_content_size=True)
        out, name, count, size = None, "", 0, 0
        done = []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")]):
                if out is None:
                    name = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out, count, size = fs.open_output_stream(name, compression=None), 0, 0
                    out.write(struct.pack("<II", MAGIC, len(packed)) + packed)
                frame = coder.compress(record(*row))
                out.write(frame)
                count, size = count + 1, size + len(frame)
                if size >= max_bytes:
                    out.close()
                    done.append((name, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    fs, root = _filesystem(path)
    fs.create_dir(root, recursive=True)
    with arrow_batches(spark):
        classified.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def frames(stream) -> Iterator[bytes]:
    """The records of an open archive, one at a time: the dictionary comes from the leading skippable frame."""
    import zstandard

    head = stream.read(8)
    if not head:
        return
    magic, n = struct.unpack("<II", head)
    if magic != MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    words = zstandard.ZstdDecompressor().decompress(stream.read(n))
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    rest = b""
    while True:
        one, parts = coder.decompressobj(), []
        while True:
            if not rest:
                rest = stream.read(1 << 20)
                if not rest:
                    if parts:
                        raise ValueError("the archive ends inside a record")
                    return
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
            if one.eof:
                break
        yield b"".join(parts)


def read_archives(manifest: DataFrame, uri: str) -> DataFrame:
    """A row per record of the manifest's archives, each archive read by one task as a stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        schema = pa.schema([(n, pa.string() if n in ("url", "payload_digest", "record_type") else pa.int64()) for n in names])
        fs, _ = _filesystem(uri)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for raw in frames(stream):
                        got = parse(raw)
                        rows.append({n: got[n] for n in names})
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    spread = max(1, manifest.count())
    return manifest.repartition(min(spread, 100_000)).mapInArrow(read, READ)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = fresh_path(spark, "warc")
    return read_archives(write_archives(classify(pages), path, total=pages.count()), path)


def sql_columns(read: DataFrame) -> DataFrame:
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


