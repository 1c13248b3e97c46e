"""Sharding by balanced label propagation.

Documents are linked through groups (here: equal texts). Each starts in a shard drawn by hash. A round joins every
linked document with its group's counts per shard and proposes the shard where most of its neighbours are; proposals
are accepted in the order of gain, then of a hash of the group, while the target keeps within its quota of linked rows. Quotas are found from
a histogram of priorities per shard (at most LEVELS * shards rows), so no shard's proposals are gathered anywhere. At
last rows move out of overfull shards into short ones, unlinked rows first, until the counts are at most one apart:
law `rows`. Slots number a shard's rows without gaps.

A group larger than a shard's quota has to be cut; the rows that find no room stay where they are. Groups that many rows
share are split wherever rows are joined with their group's facts (common.spread_join); rows without links join nothing.

Defined results: a null text has size 1, CRC 0 and no links; a very long text is only hashed and measured; equal texts, the empty one included, are one group; a
repeated row is a document of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, row_hash, scratch, spread_join, written

SHARDS, ROUNDS, LEVELS = 16, 4, 1024


def propagated(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, seed: int = 42) -> DataFrame:
    """Adds shard to docs (doc_id, grp: a 64-bit group or null): after `rounds` rounds, not yet balanced exactly."""
    folder = scratch(docs.sparkSession)
    total = docs.count()
    quota = -(-total // shards)
    start = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "grp"), F.lit(shards)).cast("int")
    docs = docs.withColumn("shard", start)
    grouped = docs.where(F.col("grp").isNotNull())
    sizes = written(grouped.groupBy("grp").agg(F.count("*").alias("members")).where("members > 1"), "sizes", folder)
    d = written(spread_join(grouped, sizes, ["grp"], "members", "left", salt=["doc_id"]), "grouped", folder)
    linked = d.where("members > 1")
    for k in range(1, rounds + 1):
        here = linked.groupBy("grp", "shard").agg(F.count("*").alias("n"))
        pull = F.struct("n", F.xxhash64(F.lit(seed), "grp", "shard").alias("h"), "shard")
        want = here.groupBy("grp").agg(F.max(pull).alias("m"), F.sum("n").alias("rows")).select("grp", F.col("m.shard").alias("to"), F.col("m.n").alias("there"), "rows")
        want = written(want, f"want{k}", folder)
        p = spread_join(linked, want, ["grp"], "rows", salt=["doc_id"]).withColumn("moves", F.col("to") != F.col("shard"))
        # priority: the larger share of its group a move joins, the earlier; a group's rows stay together by its hash
        gain = F.col("there") / F.col("members")
        level = F.least(F.lit(LEVELS - 1), F.floor((1 - gain) * (LEVELS // 16)).cast("int") * 16 + F.pmod(F.xxhash64("grp"), F.lit(16)).cast("int"))
        p = written(p.withColumn("level", level.cast("int")), f"proposed{k}", folder)
        if k > 1 and p.where("moves").isEmpty():
            break
        stay = p.where("not moves").groupBy("shard").agg(F.count("*").alias("stay"))
        ask = p.where("moves").groupBy(F.col("to").alias("shard"), "level").agg(F.count("*").alias("ask"))
        w = Window.partitionBy("shard").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
        room = ask.join(stay, "shard", "left").withColumn("room", F.lit(quota) - F.coalesce("stay", F.lit(0)) - F.coalesce(F.sum("ask").over(w), F.lit(0)))
        room = room.select(F.col("shard").alias("to"), "level", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("room") / F.col("ask"))).alias("share"))
        moved = p.join(F.broadcast(room), ["to", "level"], "left")  # at most shards * LEVELS rows
        u = F.shiftrightunsigned(row_hash(["doc_id"], seed + k), 1) / F.lit(float(1 << 63))
        go = F.col("moves") & (u < F.coalesce("share", F.lit(0.0)))
        linked = written(moved.withColumn("shard", F.when(go, F.col("to")).otherwise(F.col("shard"))).select(*linked.columns), f"linked{k}", folder)
    alone = d.where("members is null").unionByName(docs.where(F.col("grp").isNull()).withColumn("members", F.lit(None).cast("long")))
    return linked.withColumn("linked", F.lit(1)).unionByName(alone.withColumn("linked", F.lit(0)))


def balanced(d: DataFrame, shards: int = SHARDS, seed: int = 42, per: int = 4096) -> DataFrame:
    """Moves rows (shard, linked) until the shards' counts are at most one apart, and adds slot; unlinked rows move first."""
    folder = scratch(d.sparkSession)
    d = written(d, "labelled", folder)
    counts = {(r["shard"], r["linked"]): r["count"] for r in d.groupBy("shard", "linked").count().collect()}  # at most 2 * shards rows
    n = [counts.get((s, 0), 0) + counts.get((s, 1), 0) for s in range(shards)]
    total = sum(n)
    by_size = sorted(range(shards), key=lambda s: (-n[s], s))
    goal = {s: total // shards + (i < total % shards) for i, s in enumerate(by_size)}
    surplus = {s: max(0, n[s] - goal[s]) for s in range(shards)}
    # of a shard's rows, the first `alone` of the unlinked go, then the first of the linked
    leave = {(s, k): x for s in range(shards) for k, x in ((0, min(surplus[s], counts.get((s, 0), 0))), (1, max(0, surplus[s] - counts.get((s, 0), 0))))}
    first, at = {}, 0
    for key in sorted(leave):
        first[key] = at
        at += leave[key]
    takers, at = [], 0
    for s in range(shards):
        short = max(0, goal[s] - n[s])
        takers += [(at, at + short, s)] * (short > 0)
        at += short

    def pick(name: str, values: dict) -> F.Column:
        return F.element_at(F.array(*[F.lit(int(values[(s, k)])) for s in range(shards) for k in (0, 1)]), F.col("shard") * 2 + F.col("linked") + 1).alias(name)

    buckets = F.lit(max(1, total // shards // per))
    key = row_hash(["doc_id", "grp"], seed)
    r = ranked(d, ["shard", "linked"], buckets, key, [F.col("doc_id")], "_rank")
    r = r.select("*", pick("_leave", leave), pick("_first", first))
    place = F.col("_first") + F.col("_rank")
    to = F.lit(None).cast("int")
    for a, b, s in takers:
        to = F.when((place >= a) & (place < b), F.lit(s)).otherwise(to)
    moved = r.withColumn("shard", F.when(F.col("_rank") < F.col("_leave"), to).otherwise(F.col("shard"))).drop("_rank", "_leave", "_first", "linked")
    return ranked(written(moved, "balanced", folder), ["shard"], buckets, key, [F.col("doc_id")], "slot")


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text)."""
    data = F.encode("text", "utf-8")
    base = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(data), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text", F.crc32(data), F.octet_length("text"))).alias("grp"),
    )
    out = balanced(propagated(written(base, "base"), shards, rounds), shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(out: DataFrame, docs: DataFrame) -> DataFrame:
    """For reports: groups of equal texts, by number of shards that hold them. Columns: shards, groups."""
    g = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("grp"))
    return out.join(g, "doc_id").groupBy("grp").agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("n")).where("n > 1").groupBy("shards").agg(F.count("*").alias("groups"))
