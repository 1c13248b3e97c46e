"""Benchmark decontamination by a prefix-filtered set join of documents and item-sized windows; DataFrame functions only.

A window is WIDTH consecutive words of a benchmark item, or all words of a shorter item. As a set of shingles of SHINGLE
words (fewer only where the window is shorter) it occurs in a document only if all its shingles do. The necessary prefix
for that is one shingle, and the rarest prunes most:

1. Documents are scanned once for the shingles of the benchmark. A shingle first has to pass a bitmap of their hashes, a
   literal of at most BITS[1] longs whatever the benchmark's size; only those that pass are kept, with the words around
   them, so no row is made for every position. A larger benchmark fills the bitmap and lets more pass to the joins, which
   are right without it.
2. What passed is counted over all documents. A shingle that occurs nowhere ends its windows; every other window is known
   by its rarest shingle and that one's place in it, a choice that overlapping windows mostly share.
3. Documents join the prefix shingles. A shingle's place in document and window gives the place where the window would
   begin; it must lie in the document from its first word to its last (length and position), and the document's own words
   there must be the window's (exact check).

Counts are combined before the shuffle; equal texts are searched as one after the scan; a shingle, window or text that
many rows share is dealt to several tasks (common.spread_join).

Defined results: a null text has no words, nor has one without letters and digits; a null item likewise has no windows;
items without item_id mark words but are neither counted nor listed; equal items all count; repeated rows, of any doc_id
or none, get equal results; texts of any length are one row that its task holds whole; an empty table of documents gives
an empty result, an empty benchmark none that is contaminated. marked() and clean() carry other columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, row_hash, scratch, spread_join, written

WIDTH, SHINGLE = 10, 5
#: Longs in the bitmap: least, and most; else sixteen for each shingle.
BITS = (1 << 10, 1 << 17)
#: ASCII but letters and digits: what words are separated by.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """The words in lower case (A-Z alone): translated, split at single spaces, and without the empty pieces."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " "), "")


def windows_of(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """item_id, window (its words joined by spaces), len: the distinct windows of each item."""
    d = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    d = d.select("item_id", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))).alias("at"))
    own = F.slice("words", F.col("at"), width)
    return d.select("item_id", F.array_join(own, " ").alias("window"), F.size(own).alias("len")).distinct()


def _hash(words: Column, at: Column, k: int) -> Column:
    """The hash of the k words from place at (from 0)."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(k)])


def shingles_of(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """window, len, k, h, off: each shingle of each window (a row per window) and its place."""
    d = windows.withColumn("words", F.split("window", " ")).withColumn("k", F.least(F.lit(shingle), F.col("len")))
    d = d.withColumn("off", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))))
    h = F.coalesce(*[F.when(F.col("k") == k, _hash(F.col("words"), F.col("off"), k)) for k in range(1, shingle + 1)])
    return d.select("window", "len", "k", h.alias("h"), "off")


def _hashes(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: _hash(words, i, k)))


def _passing(hashes: Column, bits: Column, n: int) -> Column:
    """The places whose hash has its bit in the map."""

    def there(i: Column) -> Column:
        h = F.get(hashes, i)
        return F.getbit(F.get(bits, F.shiftrightunsigned(h, 64 - n).cast("int")), h.bitwiseAND(F.lit(63)).cast("int")) == 1

    return F.when(F.size(hashes) > 0, F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), there))


def _found(words: Column, k: int, width: int) -> Column:
    """(pos, k, h, from, words): each place that passed, with the words from `from` on in which its windows lie."""

    def one(i: Column) -> Column:
        begin = F.greatest(i - (width - k), F.lit(0))
        return F.struct(i.alias("pos"), F.lit(k).alias("k"), F.get(f"h{k}", i).alias("h"), begin.alias("from"), F.slice(words, begin + 1, 2 * width - k).alias("words"))

    return F.coalesce(F.transform(f"at{k}", one), F.array())


def _bitmap(hashes: DataFrame) -> tuple[Column, int]:
    """(array of longs, number of the hash's leading bits that choose one): a bit for every h. At most BITS[1] longs reach the driver."""
    n = hashes.count()
    bits = next((b for b in range(BITS[0].bit_length() - 1, BITS[1].bit_length()) if 1 << b >= 16 * n), BITS[1].bit_length() - 1)
    word = F.shiftrightunsigned("h", 64 - bits).cast("int").alias("i")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    longs = [0] * (1 << bits)
    for r in hashes.select(word, one.alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).collect():
        longs[r.i] = r.b
    return F.split(F.lit(",".join(map(str, longs))), ",").cast("array<long>"), bits  # a constant


def scan(docs: DataFrame, text: str, shingles: DataFrame, keep: list[str], width: int = WIDTH) -> DataFrame:
    """keep, n_words and found: the shingles of each document that may be among shingles (k, h). Write it before filtering it."""
    hashes = shingles.select("k", "h").distinct()
    lengths = sorted(r.k for r in hashes.select("k").distinct().collect())  # at most SHINGLE
    d = docs.select(*keep, words_of(F.col(text)).alias("words")).withColumn("n_words", F.size("words"))
    d = d.withColumns({f"h{k}": _hashes(F.col("words"), k) for k in lengths})
    d = d.withColumns({f"at{k}": _passing(F.col(f"h{k}"), *_bitmap(hashes.where(F.col("k") == k))) for k in lengths})
    parts = [_found(F.col("words"), k, width) for k in lengths]
    kind = "array<struct<pos:int,k:int,h:bigint,from:int,words:array<string>>>"
    return d.select(*keep, F.col("n_words").cast("long").alias("n_words"), (F.concat(*parts) if parts else F.lit(None)).cast(kind).alias("found"))


def prefixes(scanned: DataFrame, shingles: DataFrame) -> DataFrame:
    """window, len, k, h, off, rows: of each window that can occur the shingle that is rarest in the documents, and its count there."""
    seen = scanned.select(F.explode("found").alias("f")).groupBy("f.k", "f.h").agg(F.count("*").alias("rows"))
    counted = shingles.join(seen, ["k", "h"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    rare = counted.groupBy("window", "len", "k").agg(F.min(F.struct("rows", "h", "off")).alias("p"))
    return rare.where("p.rows > 0").select("window", "len", "k", "p.h", "p.off", "p.rows")


def _by_text(docs: DataFrame, text: str) -> list[Column]:
    return [row_hash([text], 1).alias("_x"), row_hash([text], 2).alias("_y")]


def search(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(documents: _x, _y, keep, n_words; hits: _x, _y, spans, items, _rows). A text is known by _x and _y, hashes of it; only texts with hits are in hits.

    spans: the stretches of hit words (from, to), from 0, `to` not included, apart and in order; items: the ids of the items whose
    windows occur, as strings, in order; _rows: the number of documents with the text.
    """
    folder, keep = scratch(docs.sparkSession), keep or []
    windows = written(windows_of(benchmark, item_id, item_text, width), "windows", folder)
    shingles = written(shingles_of(windows.select("window", "len").distinct(), shingle), "shingles", folder)
    named = docs.select(*_by_text(docs, text), *([F.struct(*keep).alias("_row")] if keep else []), F.col(text).alias("_text"))
    scanned = written(scan(named, "_text", shingles, [c for c in named.columns if c != "_text"], width), "scanned", folder)
    prefix = written(prefixes(scanned, shingles), "prefixes", folder)

    some = scanned.where(F.size("found") > 0)
    each = some.select("_x", "_y", "n_words", F.explode("found").alias("f"))
    each = each.groupBy("_x", "_y", "f.k", "f.pos").agg(F.count("*").alias("_rows"), F.first("n_words").alias("n_words"), F.first("f").alias("f"))
    each = each.select("_x", "_y", "_rows", "n_words", "k", "pos", "f.h", "f.from", "f.words")
    j = spread_join(each, prefix, ["k", "h"], "rows", salt=["_x", "_y", "pos"])
    begin = F.col("pos") - F.col("off")
    inside = (begin >= 0) & (begin + F.col("len") <= F.col("n_words"))
    same = F.array_join(F.slice("words", F.greatest(begin - F.col("from") + 1, F.lit(1)), F.col("len")), " ") == F.col("window")
    hits = written(j.where(inside & same).select("_x", "_y", "_rows", begin.alias("from"), (begin + F.col("len")).alias("to"), "window"), "hits", folder)

    within = F.transform(F.collect_set(F.struct("from", "to")), lambda x: F.sequence(x["from"], x["to"] - 1))
    places = hits.groupBy("_x", "_y").agg(F.max("_rows").alias("_rows"), F.array_sort(F.array_distinct(F.flatten(within))).alias("at"))
    first = F.filter("at", lambda p, i: (i == 0) | (F.get("at", i - 1) != p - 1))
    last = F.filter("at", lambda p, i: F.coalesce(F.get("at", i + 1) != p + 1, F.lit(True)))
    spans = places.select("_x", "_y", "_rows", F.zip_with(first, last, lambda a, b: F.struct(a.alias("from"), (b + 1).alias("to"))).alias("spans"))
    occurring = hits.groupBy("window").agg(F.count("*").alias("times"))
    members = written(windows.select("window", F.col("item_id").cast("string").alias("item")).where("item is not null").join(occurring, "window"), "members", folder)
    items = spread_join(hits.select("_x", "_y", "window").distinct(), members, ["window"], "times", salt=["_x", "_y"]).select("_x", "_y", "item").distinct()
    items = items.groupBy("_x", "_y").agg(F.array_sort(F.collect_list("item")).alias("items"))
    hit = spans.join(items, ["_x", "_y"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return scanned.drop("found"), written(hit, "hit", folder)


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """_row, a struct of the row's columns, with spans and items as in search(), empty where nothing is hit."""
    _, hits = search(docs.select(text), benchmark, None, text, **options)
    keyed = docs.select(*_by_text(docs, text), F.struct(*docs.columns).alias("_row"))  # a row's own names clash with nothing
    d = spread_join(keyed, hits, ["_x", "_y"], "_rows", "left", salt=["_row"])
    return d.select("_row", *[F.coalesce(c, F.array().cast(hits.schema[c].dataType)).alias(c) for c in ("spans", "items")])


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that hold no window of any item."""
    return marked(docs, benchmark, **options).where(F.size("spans") == 0).select("_row.*")


def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    rows, hits = search(docs.select(doc_id, text), benchmark, [doc_id], text, **options)
    d = spread_join(rows, hits, ["_x", "_y"], "_rows", "left", salt=["_row"])
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0), lambda s, x: s + x["to"] - x["from"]), F.lit(0)).cast("long")
    return d.select(
        F.col("_row")[doc_id].alias(doc_id), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_CLASS}')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS k, array_to_string(list_slice(w, p, p + {WIDTH - 1}), ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT r, k, p, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hit AS (SELECT r, k, p, item_id FROM dw JOIN iw USING (k, s)),
places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM hit) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""
