"""MinHash near-dedup with HyperMinHash registers.

1. One pass over the texts makes, per document, the number of its distinct word shingles, a 128-bit key of the set, and
   BANDS * ROWS registers. Each shingle falls into one bucket by its hash; a bucket's register keeps the minimum of a
   second hash as a count of leading zeros (6 bits) and the MANTISSA bits that follow it, so 2 bytes instead of 8. An
   empty bucket takes the register of the first one that is not, in an order of its own: two sets then agree in a
   register as often as their similarity says, whether they hold three shingles or a million.
2. Documents of equal sets form a class; only one row a class goes on, so exact copies cost nothing below.
3. ROWS registers side by side make a band; classes that share a band are candidates. In each band bucket every class
   meets the bucket's leader first; what is linked is clustered. Buckets that still hold several clusters are
   compared in blocks, a pair of blocks per group of rows. A cluster of many classes has blocks of its own, which never
   meet each other; the small clusters of a bucket share blocks. So a pair is compared only across clusters, and only in
   the first band that its two classes share: each candidate pair is either compared or already known to be connected,
   no bucket is capped and no group's pairs are all made.
4. A pair of registers goes on when its collision-corrected Jaccard estimate is within SLACK standard deviations of
   the threshold; then 100 * intersection >= percent * union is tested on the full sets of shingle hashes. Where both
   sets have at most KEPT[0] hashes the block's task holds them whole and tests there, so that it sends on true links
   alone, one fewer than the classes it connects. For larger sets a first pass sends each class's few best partners, by
   an estimate from the sets' least hashes, to be joined with the full sets. What is still apart after that meets in a
   second pass, whose smaller blocks carry KEPT[1] hashes and decide likewise; only sets larger still, whose estimate
   from that many hashes (0.77 at least for a threshold of 0.8) leaves it open, are sent out as pairs.
5. Components come from iterative star joins (components.py); a class's least doc_id names it.

With 24 bands of 4 registers a pair at similarity 0.8 is missed with probability (1 - 0.8**4)**24 = 3e-6; the estimate
drops a pair at 0.8 with a probability below 1e-6. Shingle hashes have 64 bits. Keys that many rows share (copies of one
text, leaders of large buckets) are split by common.spread_join; documents without words take no part in any join.

Defined results: words are maximal runs of other than ASCII white space after A-Z lower-casing; a document with fewer
words than a shingle is one shingle, its whole sequence; without words (null, empty) it has an empty set and is linked
with nothing, not even another empty one. A text of any length counts whole; its task holds one set at a time beside
those of 63 other texts. A repeated row is a copy. A null doc_id takes part; its class is named by the least doc_id
known. Columns other than doc_id and text are ignored, except by deduplicated(), which carries them under any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, row_hash, scratch, spread_join, written
from .components import components

BANDS, ROWS, MANTISSA = 24, 4, 10
#: Standard deviations that an estimate may fall short, for registers (small sets' spread is up to 1.2 times as wide) and for least hashes.
SLACK = (6.5, 5.0)
#: Classes in a block, and least hashes that a class brings along, in the first and the second pass.
BLOCK, KEPT = (1024, 128), (256, 4096)
_REGISTERS = BANDS * ROWS
_RNG = np.random.default_rng(42)
_SEEDS = _RNG.integers(1, 1 << 63, 2, dtype=np.uint64)
#: Per bucket, the order in which it asks the others when it is empty.
_PROBES = np.argsort(_RNG.random((_REGISTERS, _REGISTERS)), axis=1)


class _Words(dict):
    """64-bit hashes of words; emptied when large, so that its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int, seen: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(seen.__getitem__, tokens), np.uint64, len(tokens))
    n = max(1, len(h) - words + 1)
    k = min(words, len(h))
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (uint16) of a non-empty set of 64-bit hashes: leading zeros of a bucket's least hash, then MANTISSA bits."""
    none = np.iinfo(np.uint64).max
    least = np.full(_REGISTERS, none, np.uint64)
    bucket = (_mix64(hashes ^ _SEEDS[0]) >> np.uint64(32)) * np.uint64(_REGISTERS) >> np.uint64(32)
    np.minimum.at(least, bucket.astype(np.int64), _mix64(hashes ^ _SEEDS[1]))
    empty = np.flatnonzero(least == none)
    if len(empty):
        asked = least[_PROBES[empty]]
        least[empty] = asked[np.arange(len(empty)), (asked != none).argmax(axis=1)]
    zeros = np.zeros(_REGISTERS, np.uint64)
    rest = least.copy()
    for step in (32, 16, 8, 4, 2, 1):
        low = rest < np.uint64(1 << 64 - step)
        zeros[low] += np.uint64(step)
        rest[low] <<= np.uint64(step)
    mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((np.minimum(zeros, 63) << np.uint64(MANTISSA)) | mantissa).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from equal registers, less the share that collides by chance (0.16992 * 4nm/(n+m)**2 / 2**MANTISSA)."""
    by_chance = 0.169919487159739 * 4.0 * n * m / (n + m) ** 2 / (1 << MANTISSA)
    return ((a == b).mean(axis=-1) - by_chance) / (1 - by_chance)


def _floor(percent: float, of: int, slack: float) -> float:
    """The least estimate from so many independent comparisons that a pair at the threshold may have."""
    p = percent / 100
    return p - slack * (p * (1 - p) / of) ** 0.5


def sketches(docs: DataFrame, words: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, rid, n_shingles, set_key, registers) per row; rid is a 128-bit hash of (doc_id, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        for b in (whole.slice(at, 64) for whole in batches for at in range(0, whole.num_rows, 64)):
            sets = [shingles(t, words, seen) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("rid"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "rid", "n_shingles", "set_key", "registers"],
            )

    d = docs.select(F.col(doc_id).alias("doc_id"), rid(F.col(doc_id), F.col(text)).alias("rid"), F.col(text).alias("text"))
    return d.mapInArrow(make, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, rid struct<x:bigint,y:bigint>, n_shingles long, set_key binary, registers binary")


def rid(*cols: Column) -> Column:
    return F.struct(row_hash(cols, 1).alias("x"), row_hash(cols, 2).alias("y"))


def _sets(docs: DataFrame, wanted: DataFrame, words: int, doc_id: str, text: str) -> DataFrame:
    """(key, hashes): the full shingle sets of the classes in wanted (rid, key)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Words()
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = [shingles(t, words, seen).view(np.int64) for t in part.column("text").to_pylist()]  # in the order of unsigned hashes
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sets, pa.list_(pa.int64()))], ["key", "hashes"])

    d = docs.select(rid(F.col(doc_id), F.col(text)).alias("rid"), F.col(text).alias("text"))
    d = d.join(wanted, "rid").select("key", "text")
    return d.mapInArrow(make, "key binary, hashes array<bigint>").dropDuplicates(["key"])


def linked(docs: DataFrame, words: int = 5, percent: float = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, rid, n_shingles, component_id and component for every row.

    component is the component's own key, null without words; component_id only names it, and may be null or shared.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    sk = written(sketches(docs, words, doc_id, text), "sketches", folder)
    first = F.min(F.struct("rid", "n_shingles", "registers"))
    classes = sk.where("n_shingles > 0").groupBy(F.col("set_key").alias("key")).agg(first.alias("s"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.select("key", "s.*", "least", "copies"), "classes", folder)
    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * width + 1, width)))
    # a band's number is part of its hash; chance collisions of the 64 bits only add candidates
    buckets = classes.select("key", F.posexplode(bands).alias("band", "bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("key").alias("leader")).where("n > 1")
    members = written(spread_join(buckets, written(shared, "shared", folder), ["bucket"], "n").select("bucket", "band", "key", "leader"), "members", folder)
    # one pass over the texts gives the full sets of all classes that share any band
    wanted = classes.join(members.select("key").distinct(), "key", "left_semi").select("rid", "key")
    sets = written(_sets(docs, wanted, words, doc_id, text), "sets", folder)
    info = classes.select("key", "n_shingles", "registers")
    low = _floor(percent, _REGISTERS, SLACK[0])

    pairs = members.where(F.col("key") != F.col("leader")).select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = pairs.join(info.select(F.col("key").alias("a"), F.col("n_shingles").alias("na"), F.col("registers").alias("ra")), "a")
    pairs = _beside(written(pairs, "met", folder), info.select(F.col("key").alias("b"), F.col("n_shingles").alias("nb"), F.col("registers").alias("rb")))
    pairs = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    pairs = written(pairs.mapInArrow(lambda it: _close(it, low), "a binary, b binary, na long, nb long"), "pairs0", folder)
    links = written(_verified(pairs, sets, percent), "links0", folder)
    root = written(components(links), "roots0", folder)

    for k, best in ((1, 3), (2, 0)):
        clusters = members.select("bucket", "band", "key").join(root, members["key"] == root["node"], "left").select("bucket", "band", "key", F.coalesce("root", "key").alias("cluster"))
        clusters = written(clusters, f"clusters{k}", folder)
        if k == 2:  # small sets are settled, so only buckets with a large one remain
            large = clusters.join(info.where(F.col("n_shingles") > KEPT[0]).select("key"), "key", "left_semi").select("bucket").distinct()
            clusters = clusters.join(large, "bucket", "left_semi")
        mixed = clusters.groupBy("bucket").agg(F.min("cluster").alias("x"), F.max("cluster").alias("y")).where("x != y").select("bucket")
        clusters = written(clusters.join(mixed, "bucket", "left_semi"), f"mixed{k}", folder)
        carried = info.join(sets.select("key", F.slice("hashes", 1, KEPT[k - 1]).alias("least_hashes")), "key")
        found = written(_across(clusters, carried, percent, low, best, k, folder), f"pairs{k}", folder)
        if found.isEmpty():
            break
        more = found.where("sure").select("a", "b").unionByName(_verified(found.where("not sure"), sets, percent))
        more = written(more, f"links{k}", folder)
        if not more.isEmpty():
            links = links.unionByName(more)
            root = written(components(links), f"roots{k}", folder)
    named = classes.select("key", "least", "copies").join(root.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = spread_join(named, written(names, "names", folder), ["root"], "n")
    named = written(named.select(F.col("key").alias("set_key"), "component_id", F.col("root").alias("component"), "copies"), "named", folder)
    rows = sk.select("doc_id", "rid", "n_shingles", "set_key")
    known = spread_join(rows.where("n_shingles > 0"), named, ["set_key"], "copies", salt=["rid"])
    known = known.select("doc_id", "rid", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "component")
    empty = rows.where("n_shingles = 0").select("doc_id", "rid", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    out = written(known.unionByName(empty), "linked")
    discard(spark, folder)
    return out


def _beside(pairs: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the row of b, which many pairs may share; pairs is evaluated twice."""
    counts = written(pairs.groupBy("b").agg(F.count("*").alias("_n")))
    return spread_join(pairs, counts.join(right, "b"), ["b"], "_n", salt=["a"]).drop("_n")


def _close(batches: Iterator[pa.RecordBatch], low: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            a, c = (np.frombuffer(b"".join(b.column(x).to_pylist()), "<u2").reshape(-1, _REGISTERS) for x in ("ra", "rb"))
            n, m = (b.column(x).to_numpy().astype(float) for x in ("na", "nb"))
            yield b.select(["a", "b", "na", "nb"]).filter(pa.array(estimate(a, c, n, m) >= low))


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Number of values that two sorted sets share."""
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _least_estimate(x: np.ndarray, y: np.ndarray, kept: int) -> float:
    """Jaccard estimate from two sets' `kept` least hashes: the share of common ones among the least of the union."""
    both = np.union1d(x, y)[:kept]
    return _common(both[np.isin(both, x, assume_unique=True)], y) / len(both)


def _blocks(members: DataFrame, size: int, folder: str, k: int) -> DataFrame:
    """members (bucket, key, cluster, ...) once for each block that they meet: with i and j, the two blocks, and block, their own.

    A cluster of at least half a block has blocks of its own and meets all but those; the others are pooled, and a pooled
    block meets itself too.
    """
    sizes = written(members.groupBy("bucket", "cluster").agg(F.count("*").alias("n")), f"sizes{k}", folder)
    own = F.col("n") >= size // 2
    count = F.when(own, F.ceil(F.col("n") / size)).otherwise(0)
    per = sizes.groupBy("bucket").agg(F.ceil(F.sum(F.when(own, 0).otherwise(F.col("n"))) / size).alias("pool"), F.sum(count).alias("owned"), F.sum("n").alias("all"))
    before = Window.partitionBy("bucket").orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.where(own).select("bucket", "cluster", count.alias("many"), F.coalesce(F.sum(count).over(before), F.lit(0)).alias("start"))
    m = spread_join(members, sizes.join(starts, ["bucket", "cluster"], "left"), ["bucket", "cluster"], "n").drop("n")
    m = spread_join(m, written(per, f"per{k}", folder), ["bucket"], "all", salt=["key"])
    m = m.withColumn("lo", F.when(F.col("many").isNull(), 0).otherwise(F.col("pool") + F.col("start")).cast("int")).withColumn("hi", F.when(F.col("many").isNull(), F.col("pool")).otherwise(F.col("lo") + F.col("many")).cast("int"))
    m = m.withColumn("block", (F.col("lo") + F.pmod(F.xxhash64("key"), F.col("hi") - F.col("lo"))).cast("int")).withColumn("last", (F.col("pool") + F.col("owned") - 1).cast("int"))
    upto = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    others = F.when(F.col("many").isNull(), upto(F.lit(0), F.col("last"))).otherwise(F.concat(upto(F.lit(0), F.col("lo") - 1), upto(F.col("hi"), F.col("last"))))
    m = m.withColumn("o", F.explode(others)).withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o"))
    return m.select("bucket", "i", "j", "block", *[c for c in members.columns if c != "bucket"])


_ROW = "a binary, b binary, na long, nb long, sure boolean"


def _meet(rows: pa.RecordBatch, percent: float, low: float, best: int, k: int) -> list[tuple]:
    """(a, b, na, nb, sure) of a pair of blocks, given as the rows of one (bucket, i, j)."""
    kept, settled = KEPT[k - 1], KEPT[0] if k == 2 else 0
    fine = _floor(percent, kept, SLACK[1])
    r = np.frombuffer(b"".join(rows.column("registers").to_pylist()), "<u2").reshape(-1, _REGISTERS)
    n, block, band = rows.column("n_shingles").to_numpy().astype(float), rows.column("block").to_numpy(), rows.column("band")[0].as_py()
    codes: dict[bytes, int] = {}
    cluster = np.array([codes.setdefault(c, len(codes)) for c in rows.column("cluster").to_pylist()])
    key, hashes = rows.column("key").to_pylist(), rows.column("least_hashes")
    values, ends = hashes.values.to_numpy().view(np.uint64), hashes.offsets.to_numpy()
    least = [values[ends[x] : ends[x + 1]] for x in range(len(key))]
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    large = n > kept
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    out = []
    for x in left:
        y = right[right > x] if i == j else right
        y = y[(cluster[y] != cluster[x]) & (np.minimum(n[y], n[x]) * 100 >= np.maximum(n[y], n[x]) * percent)]
        if n[x] <= settled:
            y = y[n[y] > settled]
        if not len(y):
            continue
        e = estimate(r[y], r[x], n[y], n[x])
        y, e = y[e >= low], e[e >= low]
        if band and len(y):  # met in an earlier band
            again = (r[y] == r[x])[:, : band * ROWS].reshape(len(y), band, ROWS).all(2).any(1)
            y, e = y[~again], e[~again]
        sent = 0
        for z in y[np.argsort(-e, kind="stable")]:
            if cluster[z] == cluster[x]:
                continue
            if large[x] or large[z]:
                if (best == 0 or sent < best) and _least_estimate(least[x], least[z], kept) >= fine:
                    out.append((key[x], key[z], int(n[x]), int(n[z]), False))
                    sent += 1
            elif (both := _common(least[x], least[z])) * 100 >= percent * (n[x] + n[z] - both):
                out.append((key[x], key[z], int(n[x]), int(n[z]), True))
                cluster[cluster == cluster[z]] = cluster[x]
    return out


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.bool_()
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], ["a", "b", "na", "nb", "sure"])


def _across(members: DataFrame, info: DataFrame, percent: float, low: float, best: int, k: int, folder: str) -> DataFrame:
    """Links (sure) and candidate pairs (not sure: of large sets) across the clusters of a bucket; best > 0: only so many candidates of a class in a pair of blocks.

    In the second pass (k = 2) a pair of small sets has been settled.
    """
    m = _blocks(members, BLOCK[k - 1], folder, k).join(info, "key")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    m = m.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")  # so many tasks however few bytes: the work is in the comparisons

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups lie one after the other; the last one of a batch waits for the next batch, as it may go on there."""
        held: list[pa.RecordBatch] = []
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
            place = np.stack([b.column(c).to_numpy() for c in ("bucket", "i", "j")], axis=1)
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1), b.num_rows]
            goes_on = held and all(held[-1].column(c)[-1].as_py() == b.column(c)[0].as_py() for c in ("bucket", "i", "j"))
            if held and not goes_on:
                yield _batch(_meet(_joined(held), percent, low, best, k))
                held = []
            for at, to in zip(cuts, cuts[1:], strict=False):
                held.append(b.slice(at, to - at))
                if to < b.num_rows:
                    if out := _meet(_joined(held), percent, low, best, k):
                        yield _batch(out)
                    held = []
        if held:
            yield _batch(_meet(_joined(held), percent, low, best, k))

    p = m.mapInArrow(run, _ROW)
    swap = F.col("a") < F.col("b")
    return p.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"), "sure").distinct()


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _verified(pairs: DataFrame, sets: DataFrame, percent: float) -> DataFrame:
    j = _beside(pairs, sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb")))
    j = j.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha")), "a")
    common = F.size(F.array_intersect("ha", "hb"))
    return j.withColumn("both", common).where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: float = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    d = linked(docs, words, percent, doc_id, text)
    return d.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, percent: float = 80) -> DataFrame:
    """docs without near-duplicates: of each component the row of least doc_id known; of rows equal in doc_id and text, one."""
    d = linked(docs, words, percent)
    # within a component: the least doc_id, nulls last, then the least rid, as several rows may share a doc_id
    best = d.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "rid")).alias("m")).select("m.rid")
    keep = best.unionByName(d.where("n_shingles = 0").select("rid")).distinct()
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]
    d = docs.select(F.struct(*docs.columns).alias("_row"), rid(F.col("doc_id"), F.col("text")).alias("_rid"), row_hash(others).alias("_order"))  # a row's own names clash with nothing
    w = Window.partitionBy("_rid").orderBy("_order")
    kept = d.join(keep.withColumnRenamed("rid", "_rid"), "_rid", "left_semi").withColumn("_k", F.row_number().over(w))
    return kept.where("_k = 1").select("_row.*")
