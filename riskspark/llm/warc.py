"""Dictionary-compressed WARC archives (.warc.zst): writer and reader.

A Zstandard dictionary is trained on response records of at most SAMPLE bytes in all, those whose digests' hashes are the
least, so that they are spread over all pages and a page of many copies counts once. It goes to every write task, which
puts it into a skippable frame at the head of its archive (magic 0x184D2A5D) and compresses each record as a frame of
its own with it. Where there are too few long pages to learn from, a task trains its own on the first SAMPLE bytes of
records that it archives. Of pages with equal payloads of at least `least` bytes the one with the largest page_id becomes a
response record, the others revisit records of the identical-payload-digest profile, whose block holds the HTTP header
alone. The largest page_id per digest is an aggregate with map-side combine, joined back on the digest; a digest that
many pages share is split for that (common.spread_join), and short pages, the empty ones among them, join nothing.

Archives have names of their own per task attempt; the table of archives that is written with them names only those of
successful tasks, so a task that is run again leaves at most an unused file. They live in the shared folder and are
written and read as streams, record by record.

Defined results: null html is an empty payload; html of any length is one record, which its tasks hold whole; a null url gives a record without a target URI, line breaks in a url
are percent-encoded; rows that share the largest page_id of a digest are all responses; a row of null page_id comes
back as null, and revisits the largest page_id there is; repeated rows give repeated records; an empty table gives an
empty result; other columns are ignored.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread_join, written

LEAST = 1000
SAMPLE, DICTIONARY, LEVEL = 1 << 20, 1 << 15, 3
#: At most so many records teach the dictionary, none above so many bytes; a longer one would leave no room for others.
TEACHERS, TEACHER = 1024, 1 << 17
#: A task starts another archive beyond so many compressed bytes.
ROLL = 1 << 30
MAGIC = 0x184D2A5D
DATE = "2000-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None, refers_to: int | None) -> bytes:
    """One record; payload None makes a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from records; None where they are too few or too short for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY, records, k=1024, d=8)
    except (zstandard.ZstdError, ValueError):
        return None


def taught(long: DataFrame, last: DataFrame) -> bytes | None:
    """The dictionary from a spread of records: chosen from last (digest, last, size), read from the pages of long."""
    one = last.where(F.col("last").isNotNull() & (F.col("size") <= TEACHER))
    chosen, size = {}, 0
    for r in one.orderBy(F.xxhash64("digest"), "digest").select("digest", "last", "size").limit(TEACHERS).collect():
        if size + r["size"] <= SAMPLE:
            chosen[r["digest"]] = r["last"]
            size += r["size"]
    if not chosen:
        return None
    d = long.where(F.col("page_id").isin(*chosen.values()) & F.col("digest").isin(*chosen)).dropDuplicates(["digest"])  # at most SAMPLE bytes
    rows = sorted(d.select("digest", "url", "size", "html").collect(), key=lambda r: r["digest"])
    found = train([record(chosen[r["digest"]], r["url"], r["digest"], r["size"], bytes(r["html"]), None) for r in rows])
    return found and found.as_bytes()


class Writer:
    def __init__(self, folder: str, dictionary: zstandard.ZstdCompressionDict | None):
        self.path, self.records, self.size = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
        system, where = fs.FileSystem.from_uri(self.path)
        system.create_dir(where.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(where, compression=None)
        if dictionary is not None:
            raw = dictionary.as_bytes()
            self.out.write(struct.pack("<II", MAGIC, len(raw)) + raw)
        self.frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)

    def add(self, data: bytes) -> None:
        frame = self.frames.compress(data)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1

    def close(self) -> tuple[str, int]:
        self.out.close()
        return self.path, self.records


def read(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record of an archive."""
    system, where = fs.FileSystem.from_uri(path)
    with system.open_input_file(where) as f:
        first = f.read(8)
        dictionary = None
        if len(first) == 8 and struct.unpack("<I", first[:4])[0] == MAGIC:
            dictionary = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", first[4:])[0]))
        else:
            f.seek(0)
        reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(f, read_across_frames=True)
        text = io.BufferedReader(reader, 1 << 16)
        while line := text.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{path}: no record begins with {line[:40]!r}")
            fields = {}
            while (line := text.readline().decode("utf-8", "surrogatepass").rstrip("\r\n")):
                name, _, value = line.partition(": ")
                fields[name.lower()] = value
            block = text.read(int(fields["content-length"]))
            if text.read(4) != b"\r\n\r\n":
                raise ValueError(f"{path}: a record's end is missing")
            yield fields, block


def write(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Archives pages (page_id, url, html) below folder; (path, records) per archive."""
    data = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), data.alias("html"))
    p = p.withColumn("digest", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    long, short = p.where(F.col("size") >= least), p.where(F.col("size") < least)
    last = written(long.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"), F.max("size").alias("size")), "last", f"{folder}-last")
    raw = taught(long, last)
    last = last.drop("size")
    d = spread_join(long, last, ["digest"], "n", salt=["page_id"])
    revisits = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    d = d.select("page_id", "url", "digest", "size", F.when(~revisits, F.col("html")).alias("payload"), F.when(revisits, F.col("last")).alias("refers_to"))
    d = d.unionByName(short.select("page_id", "url", "digest", "size", F.col("html").alias("payload"), F.lit(None).cast("long").alias("refers_to")))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer, held, size = [], None, [], 0
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None

        def flush() -> None:
            nonlocal writer, dictionary, held
            if writer is None and held:
                dictionary = dictionary or train(held)
                writer = Writer(folder, dictionary)
            for r in held:
                if writer.size >= ROLL:
                    done.append(writer.close())
                    writer = Writer(folder, dictionary)
                writer.add(r)
            held = []

        for b in batches:
            columns = [b.column(c) for c in ("page_id", "url", "digest", "size", "payload", "refers_to")]
            for i in range(b.num_rows):
                held.append(record(*(c[i].as_py() for c in columns)))
                size += len(held[-1])
                if writer is not None or raw or size >= SAMPLE:
                    flush()
        flush()
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return d.mapInArrow(archive, "path string, records long")


def records(archives: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the archives (path), from their bytes."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def number(urn: str | None) -> int | None:
        value = (urn or "").strip("<>").rpartition(":")[2]
        return int(value) if value and value != "null" else None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for path in b.column("path").to_pylist():
                for fields, block in read(path):
                    http, _, body = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if fields["warc-type"] == "response":
                        if len(body) != size or hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{path}: a payload differs from its digest")
                    rows.append((number(fields["warc-record-id"]), size, digest, fields["warc-type"], number(fields.get("warc-refers-to"))))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = archives.select("path").repartition(n, "path")
    return dealt.mapInArrow(each, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    folder = scratch(pages.sparkSession)
    return records(written(write(pages, f"{folder}/warc", least), "archives", folder))


ORACLE_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to FROM w"""
