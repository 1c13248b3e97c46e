"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only.

A run is a table (h1, h2, n): 128-bit hashes of line keys with the number of documents that hold them, bucketed and
sorted by hash, so that a merge join reads it in order without a shuffle. Documents come in batches. A batch counts its
keys, merge-anti-joins the runs to leave out keys already known to be common, and adds the rest as a run of level 0;
whenever a level holds FANOUT runs they are compacted into one of the next level, which adds up the counts. In the end
the keys whose counts over all runs reach `common` lose all their lines in every document.

Hot lines are counted map-side first; what is joined back to the documents is per row and line position, and a hot
line's positions are dealt to several tasks (common.spread_join). Runs and batches are dropped, from the catalog and from
the shared folder, as soon as the common keys and the lines that go are known.

Defined results: a line ends at \\n only; a null or empty text is one empty line; a text of any length, or of any number
of lines, is one row that its task holds whole; keys shorter than `least` code points are never common; a document whose
lines all go has an empty text (of sha256 e3b0...); each row counts as a document, also a repeated one or one of null
doc_id; an empty table gives an empty result. Other columns are carried by deduplicated(), whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CHARS, discard, lower_ascii, row_hash, scratch, spread_join, written

COMMON, LEAST, BATCHES, FANOUT = 10, 1, 4, 2


def key_of(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(WHITE_CHARS)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class Runs:
    """The levelled runs of one corpus, kept in the shared folder."""

    def __init__(self, folder: str, buckets: int, common: int = COMMON, fanout: int = FANOUT):
        self.folder, self.buckets, self.common, self.fanout = folder, buckets, common, fanout
        self.levels: list[list[str]] = [[]]
        self.made: list[str] = []

    def _save(self, counts: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        self.made.append(name)
        d = counts.repartition(self.buckets, "h1", "h2")
        d.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def tables(self, spark) -> list[DataFrame]:
        return [spark.table(n) for level in self.levels for n in level]

    def _merge(self, spark, names: list[str]) -> DataFrame:
        """The runs' counts added up by a full merge join: both sides lie bucketed and sorted, so nothing is shuffled."""
        out = spark.table(names[0])
        for name in names[1:]:
            b = spark.table(name).withColumnRenamed("n", "m")
            out = out.join(b, ["h1", "h2"], "full_outer").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def totals(self, spark) -> DataFrame:
        """(h1, h2, n) over all runs."""
        return self._merge(spark, [n for level in self.levels for n in level])

    def add(self, batch: DataFrame) -> None:
        """Counts the batch (hashes: array of structs h1, h2 per document) and adds its run; compacts full levels."""
        spark = batch.sparkSession
        counts = batch.select(F.explode(F.array_distinct("hashes")).alias("h")).select("h.h1", "h.h2").groupBy("h1", "h2").agg(F.count("*").alias("n"))
        for run in self.tables(spark):
            counts = counts.join(run.where(F.col("n") >= self.common), ["h1", "h2"], "left_anti")
        self._save(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._save(self._merge(spark, full), level + 1)
            level += 1


    def drop(self, spark) -> None:
        """Takes all runs, compacted ones included, out of the catalog and the shared folder."""
        for name in self.made:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(spark, f"{self.folder}/{name}")
        self.made, self.levels = [], [[]]


def _located(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    """(x, y, hashes, at): a hash of each row, and its lines' key hashes and positions where the key is long enough."""
    keys = F.transform(lines_of(F.col(text)), key_of)
    hashed = F.transform(keys, lambda k: F.struct(F.xxhash64(F.lit(1), k).alias("h1"), F.xxhash64(F.lit(2), k).alias("h2"), (F.char_length(k) >= least).alias("long")))
    return docs.select(row_hash([doc_id, text], 1).alias("x"), row_hash([doc_id, text], 2).alias("y"), hashed.alias("hashes"))


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", common: int = COMMON, least: int = LEAST, batches: int = BATCHES, buckets: int | None = None) -> DataFrame:
    """_row, a struct of the row's columns, and _drop: the positions (from 0, ascending) of the lines that go, null where none goes."""
    spark = docs.sparkSession
    folder, out = scratch(spark), scratch(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    located = _located(docs, doc_id, text, least).withColumn("batch", F.pmod("x", F.lit(batches)).cast("int"))
    located.write.partitionBy("batch").parquet(f"{folder}/lines")  # a batch later reads its own files alone
    located = spark.read.schema(located.schema).parquet(f"{folder}/lines")
    runs = Runs(folder, n, common)
    for k in range(batches):
        part = located.where(F.col("batch") == k)
        runs.add(part.select(F.transform(F.filter("hashes", lambda h: h["long"]), lambda h: F.struct(h["h1"].alias("h1"), h["h2"].alias("h2"))).alias("hashes")))
    often = written(runs.totals(spark).where(F.col("n") >= common), "often", folder)
    runs.drop(spark)
    each = located.select("x", "y", F.posexplode("hashes").alias("pos", "h")).where("h.long").select("x", "y", "pos", "h.h1", "h.h2")
    hit = spread_join(each, often, ["h1", "h2"], "n", salt=["x", "y", "pos"])
    drop = hit.groupBy("x", "y").agg(F.array_sort(F.collect_set("pos")).alias("_drop"))  # repeated rows share their positions
    drop = written(drop.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "_drop"), "drop", out)
    discard(spark, folder)
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), row_hash([doc_id, text], 1).alias("_x"), row_hash([doc_id, text], 2).alias("_y"))  # a row's own names clash with nothing
    return keyed.join(drop, ["_x", "_y"], "left").select("_row", "_drop")


def kept_text(text: Column, drop: Column) -> Column:
    """The text without the lines at the positions in drop, in time proportional to its lines."""
    lines = lines_of(text)
    ends = F.concat(drop, F.array(F.size(lines)))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(drop, i - 1) + 1)
    pieces = F.transform(ends, lambda end, i: F.slice(lines, before(i) + 1, end - before(i)))
    return F.when(drop.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(pieces), "\n"))


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of docs."""
    m = marked(docs.select(doc_id, text), doc_id, text, **options)
    whole = F.col("_row")[text]
    return m.select(
        F.col("_row")[doc_id].alias(doc_id),
        F.size(lines_of(whole)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(F.encode(kept_text(whole, F.col("_drop")), "utf-8"), 256).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs with their texts less the common lines; a text that loses none stays as it is, null included."""
    text = F.col("_row")["text"]
    kept = F.when(F.col("_drop").isNull(), text).otherwise(kept_text(text, F.col("_drop"))).alias("text")
    return marked(docs, **options).select(*[kept if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT r, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM d),
k AS (SELECT r, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t FROM k WHERE key NOT IN (SELECT key FROM often) GROUP BY r)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)"""
