"""Dictionary-compressed WARC archives.

An archive file starts with a skippable Zstandard frame (magic number
0x184D2A5D) that holds the dictionary, itself compressed. Then each record is
a frame of its own, compressed with that dictionary, so that any record can be
read by its offset once the dictionary is. The dictionary is trained on a
bounded sample of the records.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import join_hot, null_safe_join, slices
from tessella.sources.scratch import fresh, written
from tessella.sources.tables import table

#: Magic number of the skippable frame that holds a dictionary; a fixed value of the format.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Records, and characters of each, that the dictionary is trained on: about so many, and twice as many at most.
SAMPLE_RECORDS, SAMPLE_BYTES = 1_000, 16 << 10
LEVEL = 6
#: Payloads of so many bytes or more are written once.
LEAST_REVISIT = 0


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, sha: str) -> str:
    """Of a response: by page and payload, so that revisits can name it before it is written."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}/{sha}')}"


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None, revisit: bool, place: str = "") -> bytes:
    """One record. A revisit has the HTTP headers of the response but no payload, and an id of its own by its ``place``.

    The pages stand in fields of their own, as record ids are unique but page ids may not be.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    uri = "".join(c if 32 < ord(c) else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{record_id(page_id, f'{sha}/{place}' if revisit else sha)}>",
        f"Page-ID: {page_id}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to, sha)}>", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(raw: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(raw)
    return struct.pack("<II", DICTIONARY_FRAME, len(body)) + body


def read_dictionary(data: memoryview | bytes) -> tuple[bytes, int]:
    """The dictionary at the start of an archive, and where its records begin."""
    magic, size = struct.unpack("<II", bytes(data[:8]))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    body = bytes(data[8 : 8 + size])
    return (zstandard.ZstdDecompressor().decompress(body) if body[:4] == zstandard.FRAME_HEADER else body), 8 + size


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, in order; one record is in memory at a time."""
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(name, compression=None) as f:
        head = f.read(8)
        raw, _ = read_dictionary(head + f.read(struct.unpack("<II", head)[1]))
        decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
        rest = b""
        while True:
            one, out = decompressor.decompressobj(), []
            while not one.eof:
                rest = rest or f.read(1 << 20)
                if not rest:
                    break
                out.append(one.decompress(rest))
                rest = one.unused_data
            if not out:
                return
            if not one.eof:
                raise ValueError(f"{path} ends within a record")
            head, _, body = b"".join(out).partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
            yield fields, body[: int(fields["Content-Length"])]


def trained(pages: DataFrame) -> bytes:
    """A dictionary from about SAMPLE_RECORDS records, those of a hash below a share; empty where they are too few.

    Twice as many come to the driver at most.
    """
    n = pages.count()
    hashed = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 30))
    picked = pages.where(hashed < min(1.0, SAMPLE_RECORDS / max(1, n)) * (1 << 30)).select("page_id", "url", F.substring("html", 1, SAMPLE_BYTES).alias("html"))
    # Rows that agree in page and URL share their hash, so that there may be more of them than wanted.
    some = picked.orderBy(F.xxhash64("page_id", "url", "html"), "page_id", "url", "html").limit(2 * SAMPLE_RECORDS).collect()
    samples = []
    for r in some:
        body = (r.html or "").encode("utf-8", "surrogatepass")
        samples.append(record(r.page_id, r.url, body, digest(body), None, False))
    if len(samples) < 16 or sum(map(len, samples)) < 4 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def _body() -> Column:
    return F.coalesce(F.col("html"), F.lit("")).cast("binary")


def _sha() -> Column:
    return F.sha1(_body())


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, sha, refers_to for the pages whose payload, of that SHA-1, one with a larger page_id has too. No page_id is smaller than any."""
    rows = written(pages.select("page_id", _sha().alias("sha"), F.octet_length(_body()).alias("n")), "digests")
    most = rows.where(F.col("n") >= least).groupBy("sha").agg(F.max("page_id").alias("most"), F.count("*").alias("same")).where("same > 1 AND most IS NOT NULL")
    found = join_hot(rows, most, ["sha"], "same", rows.count())
    return written(found.where("page_id IS NULL OR page_id < most").select("page_id", "sha", F.col("most").alias("refers_to")).distinct(), "revisits")


def write(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes the archives; returns path, records of each. The write happens when the result is first used.

    A task writes under another name and renames at the end, so one that runs
    twice leaves one whole archive.
    """
    spark = pages.sparkSession
    raw = spark.sparkContext.broadcast(trained(pages))  # DICTIONARY_BYTES at most
    plan = planned(pages, least)
    rows = null_safe_join(pages.select("page_id", "url", "html", _sha().alias("sha")), plan, ["page_id", "sha"]).drop("sha") if not plan.isEmpty() else pages.select("page_id", "url", "html", F.lit(None).cast("bigint").alias("refers_to"))
    rows = rows.withColumn("_part", F.spark_partition_id())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        given = zstandard.ZstdCompressionDict(raw.value) if raw.value else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_content_size=True)
        sink, n, final = None, 0, ""
        temporary = f"{base}/_{uuid.uuid4().hex}"
        for batch in slices(batches, "html", 8 << 20):
            if sink is None:
                final = f"{base}/pages-{batch.column('_part')[0].as_py():06d}.warc.zst"
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(temporary, compression=None)
                sink.write(dictionary_frame(raw.value))
            for page_id, url, html, to in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")], strict=True):
                body = (html or "").encode("utf-8", "surrogatepass")
                sink.write(compressor.compress(record(page_id, url, body, digest(body), to, to is not None, f"{final.rpartition('/')[2]}/{n}")))
                n += 1
        if sink is not None:
            sink.close()
            fs.move(temporary, final)
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{final.rpartition('/')[2]}"], "records": [n]})

    return rows.mapInArrow(run, "path string, records bigint")


def read(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives ``paths.path``.

    The digest of a response is taken from its payload and held against its header.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows: list[tuple] = []
                for fields, block in records(path):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    sha = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if fields["WARC-Type"] == "response" and (len(payload) != size or digest(payload) != sha):
                        raise ValueError(f"{path}: {fields['WARC-Record-ID']} has another payload than its header says")
                    number = lambda s: None if s in (None, "None") else int(s)
                    rows.append((number(fields["Page-ID"]), size, sha, fields["WARC-Type"], number(fields.get("Refers-To-Page-ID"))))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return paths.select("path").repartition(parts, "path").mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def archived(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes ``pages`` as archives under the shared folder and reads them back; one row per page.

    A null html is an empty payload. Of records with equal payloads, those of
    the largest page_id are responses; a page without page_id revisits where any
    has one. Repeated rows are all written; those that agree in page_id and
    payload and are responses have one record id. An empty table writes no archive.
    """
    spark = pages.sparkSession
    made = written(write(pages, fresh(spark, "warc"), least), "archives")
    return read(spark, made)


def query(spark, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


#: The bits of each hexadecimal digit of the digest, five at a time, are the base-32 digits.
ORACLE_SQL = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
b AS (SELECT *, list_reduce(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', sha[i]) - 1) * 4 + 1, 4)), lambda x, y: x || y) AS bits FROM d),
e AS (SELECT page_id, payload_bytes, list_reduce(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
  + 16 * (bits[5*k+1])::INT + 8 * (bits[5*k+2])::INT + 4 * (bits[5*k+3])::INT + 2 * (bits[5*k+4])::INT + (bits[5*k+5])::INT, 1)), lambda x, y: x || y) AS payload_digest FROM b),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS most FROM e)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM most THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM most THEN most END AS refers_to FROM m
"""
