"""WARC archives with a Zstandard dictionary of their own, written and read by executors.

An archive starts with a skippable frame that holds its dictionary, built from pieces spread evenly over the archive's own
records; every record after it is a frame of its own, so that a reader can start at any record. Archives are rolled at a
size and held in memory until then, so memory and files are bounded whatever a partition holds; only a record longer than
that is an archive of its own size. Files lie in the shared folder under names of their own; the table of archives, written
by Spark, names those of the attempts that succeeded, and readers go by that table alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Format constants: a skippable frame for dictionaries, and the formats' own magic numbers.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, b"\x37\xa4\x30\xec", b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Production parameters of op4: bytes that a dictionary is built from, in pieces of, its size, bytes of an archive's records,
#: level, least payload of a revisit.
SAMPLE_BYTES, PIECE_BYTES, DICTIONARY_BYTES, ROLL_BYTES, LEVEL, LEAST_BYTES = 2_000_000, 4_096, 65_536, 32_000_000, 3, 0
DATE = "2024-01-01T00:00:00Z"

#: Tasks that read archives at most.
MOST_TASKS = 20_000

ARCHIVES = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("dictionary_bytes", T.LongType())])
RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("intact", T.BooleanType()), T.StructField("payload", T.BinaryType()),
])


def record_id(page: int | None, digest: str, copy: str = "") -> str:
    """The identifier of a page's record; `copy` tells records of one page and payload apart."""
    return f"<urn:page:{'none' if page is None else page}:{digest}{copy and ':' + copy}>"


def page_of(identifier: str) -> int | None:
    page = identifier.strip("<>").split(":")[2]
    return None if page == "none" else int(page)


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, repeated: bool = False) -> bytes:
    """One record: a response with its payload, or a revisit of the response of page `first`.

    A record whose page and payload are those of others too has an identifier of its own beyond them.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    own = record_id(page, digest, uuid.uuid4().hex if repeated or page is None else "")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {target}"] if target is not None else []), f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}"] if first is not None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def dictionary_of(records: list[bytes]):
    """A dictionary from pieces spread evenly over the records' bytes.

    Few or short records are not enough to build one from: a record's usual head and as many copies as it takes help then.
    """
    import zstandard

    step = max(PIECE_BYTES, -(-sum(map(len, records)) // SAMPLE_BYTES) * PIECE_BYTES)
    pieces, skip = [], 0
    for one in records:
        while skip < len(one):
            pieces.append(one[skip : skip + PIECE_BYTES])
            skip += step
        skip -= len(one)
    total = sum(map(len, pieces))
    if len(pieces) < 16 or total < 16_384:
        pieces.append(record(None, None, b"", base32_sha1(b""), None))
        pieces *= max(1, -(-16 // len(pieces)), -(-16_384 // sum(map(len, pieces))))
    return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 8)), pieces, k=512, d=8)


def write_archive(records: list[bytes], folder: str) -> tuple[str, int, int, int]:
    """An archive of these records as a row of ARCHIVES."""
    import zstandard
    from pyarrow.fs import FileSystem

    uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
    system, path = FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    dictionary = dictionary_of(records)
    raw = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
    size = 8 + len(packed)
    # Frames are written here: the stream must not compress by the file's name.
    with system.open_output_stream(path, compression=None) as file:
        file.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        for one in records:
            frame = compressor.compress(one)
            file.write(frame)
            size += len(frame)
    return uri, len(records), size, len(raw)


def write_archives(records: Iterator[bytes], folder: str, roll: int = ROLL_BYTES) -> Iterator[tuple[str, int, int, int]]:
    held, size = [], 0
    for one in records:
        if held and size + len(one) > roll:
            yield write_archive(held, folder)
            held, size = [], 0
        held.append(one)
        size += len(one)
    if held:
        yield write_archive(held, folder)


def frames(path: str) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard
    from pyarrow.fs import FileSystem

    system, inner = FileSystem.from_uri(path)
    with system.open_input_stream(inner, compression=None) as file:
        head, dictionary = file.read(8), None
        if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
            raw = file.read(struct.unpack("<I", head[4:])[0])
            raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME else raw
            dictionary, head = zstandard.ZstdCompressionDict(raw), b""
        reader = zstandard.ZstdDecompressor(dict_data=dictionary)
        data = head
        while True:
            if not data:
                data = file.read(1 << 20)
                if not data:
                    return
            frame, out = reader.decompressobj(), []
            while not frame.eof:
                if not data:
                    data = file.read(1 << 20)
                    if not data:
                        raise ValueError(f"{path} ends inside a record")
                out.append(frame.decompress(data))
                data = frame.unused_data if frame.eof else b""
            yield b"".join(out)


def read_record(data: bytes) -> tuple:
    """A record as a row of RECORDS."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].partition(":")[2], fields["WARC-Type"]
    refers = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
    intact = kind == "revisit" or (len(payload) == size and base32_sha1(payload) == digest)
    return page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, digest, kind, refers, intact, payload if kind == "response" else None


def archived(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row into archives under `folder` (the shared folder if none) and return the table of archives.

    The payload is the html in UTF-8, a null one is empty. Of records with equal payloads of at least `least` bytes that
    with the smallest id is the response and the others revisit it; repeated rows of that id are responses too. Rows
    without an id are responses unless an equal payload has one. Other columns are ignored; an empty table writes none.

    Copies are found in a table of ids and digests alone; payloads move once, by id and digest, so that a payload that many
    pages share is no key of its own.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    folder = folder or f"{scratch.path}/archives"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    ids = rows.groupBy("page_id", "sha1").agg(F.count(F.lit(1)).alias("copies"), F.first(F.octet_length("payload")).alias("size"))
    ids = scratch.save(ids, "ids")
    heads = ids.where(F.col("size") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.sum("copies").alias("all")).where("all > 1 AND first IS NOT NULL")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    told = ids.join(heads, "sha1", "left").select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), first.alias("first"), (F.col("copies") > 1).alias("repeated"))
    told = told.where("first IS NOT NULL OR repeated")
    told = rows.join(told, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left")
    told = told.select("page_id", "url", "payload", "sha1", "first", F.coalesce("repeated", F.lit(False)).alias("repeated"))

    def lines(batches):
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "sha1", "first", "repeated")]
            for page, url, payload, sha1, first, again in zip(*columns, strict=True):
                yield record(page.as_py(), url.as_py(), payload.as_py(), base64.b32encode(bytes.fromhex(sha1.as_py())).decode(), first.as_py(), again.as_py())

    def run(batches):
        for row in write_archives(lines(batches), folder):
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=ARCHIVES.names)

    return scratch.save(told.mapInArrow(run, ARCHIVES), "table")


def read_archives(archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of a table of archives; RECORDS, without payloads if not kept. Repeated archives are read as often.

    Archives are dealt evenly over as many tasks as there are archives, MOST_TASKS at most; a task reads its own one after
    the other. An empty table gives no rows; a cut or damaged archive is an error.
    """
    schema = RECORDS if keep_payload else T.StructType(RECORDS.fields[:-1])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.binary()][: len(schema)]

    def run(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for data in frames(path):
                    rows.append(read_record(data)[: len(kinds)])
                    size += len(data)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return archives.select("path").repartition(min(MOST_TASKS, max(1, archives.count()))).mapInArrow(run, schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(archived(spark.read.parquet(f"{sf_dir}/pages.parquet")), keep_payload=False)
    checked = F.when(F.col("intact"), F.col("payload_digest")).otherwise(F.raise_error("a record's payload differs from its digest"))
    return found.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


#: The same from the table itself; five hexadecimal digits are four of base 32.
SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
    d AS (SELECT page_id, payload, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - i % 4 * 5)::INT) & 31)::INT + 1, 1)), 'string_agg', '') AS digest,
        min(page_id) OVER (PARTITION BY payload) AS head FROM p)
    SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> head THEN head END AS refers_to FROM d"""
