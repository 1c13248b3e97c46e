"""Media columns: content-addressed payloads in tar shards.

store() turns every text into a payload (UTF-8, zero-padded to a positive multiple of 64 bytes), stores that as the
samples of an 8-bit greyscale PNG 64 pixels wide, and appends it to a tar shard under its digest's name. Rows carry
digest, shard, start and length only. Digests, not payloads, are shuffled: of the tasks whose rows hold a digest the
first one is its owner, each task is handed the digests that it shares with others, and only owners store those; the
rows of other tasks learn the place by a join, in which a digest of many rows is split. So a digest is stored once,
whatever the number of its copies. The rows are read twice for that. Should the second reading deal them to other tasks
than the first, a digest may be stored once more, and one whose owner has not met it is stored afterwards.

read_rows() reads back in one deal: a task gets a range of places and reads it from front to back, so that rows of one
place stand side by side; a place of many rows may lie in several ranges. A range read of the first HEADER bytes alone fills the metadata
columns (width, height, bits); a read of the whole range decodes the samples, and everything else is computed from those.

A task's shard has a name of its own, which its rows carry; a task that is run again writes another file, and what the
lost one left is never referred to. Shards go through pyarrow's file systems to the shared folder, never to local disk.

Defined results: a null text is an empty one; both give 64 zero bytes. Equal texts share a digest and so every value;
repeated rows give repeated rows; null ids come back as null; a text of any length is one payload, held whole by one
task; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, spread_join, written

WIDTH, HEADER, LEVEL = 64, 33, 6
#: A task starts another shard beyond so many bytes.
ROLL = 1 << 30
_MAGIC = b"\x89PNG\r\n\x1a\n"


def payload(text: Column) -> Column:
    """The text's bytes, padded with zero bytes to a positive multiple of WIDTH."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(WIDTH), F.ceil(F.octet_length(data) / WIDTH) * WIDTH).cast("int")
    return F.rpad(data, size, F.lit(bytearray(1)))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    lines = np.hstack([np.zeros((len(rows), 1), np.uint8), rows])  # each line starts with filter 0
    return _MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bits from a PNG's first HEADER bytes."""
    if first[:8] != _MAGIC or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("not the head of a PNG")
    return struct.unpack(">IIB", first[16:25])


def from_png(data: bytes) -> np.ndarray:
    width, height, _ = header(data[:HEADER])
    packed, at = b"", 8
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation and a 64-bit hash of which columns are brighter than the mean."""
    bright = samples.mean(axis=0) > samples.mean()
    return f"{samples.shape[1]}x{samples.shape[0]};mean={samples.mean():.4f};sd={samples.std():.4f};hash={int(''.join('1' if b else '0' for b in bright), 2):016x}"


class _Shard:
    """A tar file written from front to back; add() gives the offset of the data."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.tar"
        system, where = fs.FileSystem.from_uri(self.path)
        system.create_dir(where.rpartition("/")[0], recursive=True)
        self.out, self.at = system.open_output_stream(where, compression=None), 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf()
        self.out.write(head + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE))
        start = self.at + len(head)
        self.at = start + len(data) + -len(data) % tarfile.BLOCKSIZE
        return start

    def close(self) -> None:
        self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
        self.out.close()


_FACTS = {
    "width": pa.int32(),
    "height": pa.int32(),
    "bits": pa.int32(),
    "payload_bytes": pa.int64(),
    "payload_sha256": pa.string(),
    "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(),
    "media_sha256": pa.string(),
    "feature": pa.string(),
}
_SQL = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}


def _shared(payloads: DataFrame) -> DataFrame:
    """(digest, n, tasks, ids) of each digest that rows of several tasks hold: its rows and these tasks, the owner first.

    ids, of no further use, keeps doc_id in the plan: a round-robin dealing upstream depends on the columns that are read.
    """
    d = payloads.select("digest", F.xxhash64("doc_id").alias("id"), F.spark_partition_id().alias("task"))
    d = d.groupBy("digest").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("task")).alias("tasks"), F.bit_xor("id").alias("ids"))
    return d.where(F.size("tasks") > 1)


def _listed(folder: str, task: int) -> dict[bytes, bool]:
    """The shared digests of a task, and whether it is the one to store them."""
    system, where = fs.FileSystem.from_uri(f"{folder}/task={task}")
    files = system.get_file_info(fs.FileSelector(where, allow_not_found=True))
    read = [pq.ParquetFile(system.open_input_file(f.path)).read(["digest", "owner"]) for f in files if f.path.endswith(".parquet")]
    return {k: v for t in read for k, v in zip(t["digest"].to_pylist(), t["owner"].to_pylist(), strict=True)}


def _append(payloads: DataFrame, folder: str, lists: str | None) -> DataFrame:
    """(doc_id, n_bytes, digest, shared, shard, start, length) per row; no place where another task is to store the digest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _listed(lists, TaskContext.get().partitionId()) if lists else {}
        places: dict[bytes, tuple] = {k: (None, None, None) for k, owner in shared.items() if not owner}
        shard = None
        for b in batches:
            rows = []
            for data, digest in zip(b.column("payload"), b.column("digest").to_pylist(), strict=True):
                if digest not in places:
                    if shard is None or shard.at >= ROLL:
                        if shard is not None:
                            shard.close()
                        shard = _Shard(folder)
                    media = to_png(data.as_py())
                    places[digest] = shard.path, shard.add(f"{digest.hex()}.png", media), len(media)
                rows.append((digest in shared, *places[digest]))
            if rows:
                kinds = pa.bool_(), pa.string(), pa.int64(), pa.int64()
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                names = ["doc_id", "n_bytes", "digest"]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *cols], [*names, "shared", "shard", "start", "length"])
        if shard is not None:
            shard.close()

    kind = payloads.schema["doc_id"].dataType.simpleString()
    return payloads.mapInArrow(write, f"doc_id {kind}, n_bytes long, digest binary, shared boolean, shard string, start long, length long")


def store(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the payloads below folder; (doc_id, n_bytes, digest, shard, start, length) per row."""
    data = payload(F.col(text))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    d = docs.select(F.col(doc_id).alias("doc_id"), size.alias("n_bytes"), F.unhex(F.sha2(data, 256)).alias("digest"), data.alias("payload"))
    shared = written(_shared(d), "shared", folder)
    each = shared.select("digest", F.posexplode("tasks").alias("at", "task")).select("digest", "task", (F.col("at") == 0).alias("owner"))
    each.repartition("task").write.partitionBy("task").parquet(f"{folder}/lists")
    out = written(_append(d, folder, f"{folder}/lists"), "stored", folder)
    discard(docs.sparkSession, f"{folder}/lists")
    have, want = out.where(F.col("shard").isNotNull()), out.where(F.col("shard").isNull())
    place = ["digest", "shard", "start", "length"]
    known = written(shared.select("digest", "n").join(index(have.where("shared")), "digest", "left"), "known", folder)
    lost = known.where(F.col("shard").isNull()).select("digest", "n")
    if not lost.isEmpty():  # owners that have not met their digest
        again = _append(d.join(lost, "digest", "left_semi").dropDuplicates(["digest"]), folder, None)
        known = known.where(F.col("shard").isNotNull()).unionByName(lost.join(written(again, "again", folder).select(*place), "digest"))
        known = written(known, "found", folder)
    rest = spread_join(want.select("doc_id", "n_bytes", "digest"), known, ["digest"], "n", salt=["doc_id"])
    return have.select("doc_id", "n_bytes", *place).unionByName(rest.select("doc_id", "n_bytes", *place))


def index(refs: DataFrame) -> DataFrame:
    """(digest, shard, start, length): the least place of each digest."""
    return refs.groupBy("digest").agg(F.min(F.struct("shard", "start", "length")).alias("at")).select("digest", "at.*")


class _Reader:
    """Range reads; the shard read last stays open."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def read(self, shard: str, start: int, length: int) -> bytes:
        if shard != self.path:
            system, where = fs.FileSystem.from_uri(shard)
            self.path, self.file = shard, system.open_input_file(where)
        return self.file.read_at(length, start)


def _whole(media: bytes) -> tuple:
    samples = from_png(media)
    data = samples.tobytes()
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)


def read_rows(refs: DataFrame, whole: bool = True) -> DataFrame:
    """refs (with shard, start, length) and what their media hold; without whole, header reads and the metadata columns alone."""
    names = list(_FACTS)[: None if whole else 3]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, at, facts = _Reader(), None, ()
        for b in batches:
            rows = []
            for place in zip(*(b.column(c).to_pylist() for c in ("shard", "start", "length")), strict=True):
                if place != at:
                    shard, start, length = at = place
                    facts = header(reader.read(shard, start, min(HEADER, length)))
                    if whole:
                        facts += _whole(reader.read(shard, start, length))
                rows.append(facts)
            if rows:
                new = [pa.array(c, _FACTS[n]) for n, c in zip(names, zip(*rows, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    n = max(1, int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = refs.repartitionByRange(n, "shard", "start", F.xxhash64("doc_id")).sortWithinPartitions("shard", "start")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in refs.schema)
    return dealt.mapInArrow(read, f"{kept}, " + ", ".join(f"{n} {_SQL[_FACTS[n]]}" for n in names))


def headers(refs: DataFrame) -> DataFrame:
    """refs with width, height and bits, from range reads of the first HEADER bytes of each medium alone."""
    return read_rows(refs, whole=False)


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the place of the medium and everything read back from there, for every row of docs."""
    folder = scratch(docs.sparkSession)
    return read_rows(written(store(docs, folder), "refs", folder))


def read_tar(path: str) -> dict[str, bytes]:
    """Members of a shard, for tests and tools."""
    system, where = fs.FileSystem.from_uri(path)
    with tarfile.open(fileobj=io.BytesIO(system.open_input_file(where).read())) as t:
        return {m.name: t.extractfile(m).read() for m in t.getmembers()}
