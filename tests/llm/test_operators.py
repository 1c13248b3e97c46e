"""Each operator against a brute-force version on a small fixture, and its edge cases."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import line_dedup, media, mixing, near_dedup, neighbours, packing, sharding, toxicity, urls, warc
from riskspark.llm.components import components

WHITE = " \t\n\x0b\x0c\r"


def low(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def word_list(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1 mixing


def brute_targets(sizes: dict, weights=(5, 2, 1), most=3.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and rest * weight[s] / open_ > most * sizes[s]}
        if not new:
            return {s: most * sizes[s] if s in full else rest * weight[s] / open_ for s in order}
        full |= new


def test_mixing_meets_the_targets(docs, rows):
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size = {r[0]: len(word_list(r[1])) for r in rows}
    per = defaultdict(int)
    for r in rows:
        per[r[3]] += size[r[0]]
    goals, taken = brute_targets(per), defaultdict(int)
    for r in got:
        assert (r["size"], r.source_size) == (size[r.doc_id], per[r.source])
        assert r.target == pytest.approx(goals[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        assert r["size"] == 0 or r.taken % r["size"] == 0
        taken[r.source] += r.taken
    for s, goal in goals.items():
        # documents are taken whole, so half the longest one is the least that can be promised
        assert abs(taken[s] - goal) <= max(2, max(size[r[0]] for r in rows if r[3] == s) / 2), (s, taken[s], goal)
    again = mixing.mix(docs.repartition(5)).select("doc_id", "size", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r["size"], r.taken) for r in got)


def test_mixing_fit_is_a_bounded_knapsack():
    for lengths, counts, budget in (([3, 5], [2, 2], 11), ([7], [10], 33), ([2, 4, 9], [1, 1, 1], 7), ([5], [1], 0), ([1, 1000], [3, 2], 1002)):
        took = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= n for t, n in zip(took, counts, strict=True))
        sums = {0}
        for length, n in zip(lengths, counts, strict=True):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        best = min(abs(s - budget) for s in sums)
        assert abs(sum(a * b for a, b in zip(lengths, took, strict=True)) - budget) == best


def test_mixing_fit_in_blocks_and_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(11)
    for _ in range(150):
        lengths = sorted({int(x) for x in rng.integers(1, 40, rng.integers(1, 9))})
        counts = [int(x) for x in rng.integers(1, 6, len(lengths))]
        budget = int(rng.integers(0, sum(a * b for a, b in zip(lengths, counts, strict=True)) + 2))
        took = mixing.fit(lengths, counts, budget, window=int(rng.integers(1, 200)))
        assert all(0 <= t <= n for t, n in zip(took, counts, strict=True))
        sums = {0}
        for length, n in zip(lengths, counts, strict=True):
            sums = {s + k * length for s in sums for k in range(n + 1)}
        if sum(a * b for a, b in zip(lengths, counts, strict=True)) <= 2 * max(lengths):  # else the bulk is set first
            assert abs(sum(a * b for a, b in zip(lengths, took, strict=True)) - budget) == min(abs(s - budget) for s in sums)
    tracemalloc.start()
    for lengths in (list(range(2, 40_002, 2)), [1, *range(2, 40_002, 2)]):
        took = mixing.fit(lengths, [3] * len(lengths), 20_001)
        assert abs(sum(a * b for a, b in zip(lengths, took, strict=True)) - 20_001) <= (lengths[0] != 1)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_mixing_edges(odd, no_docs, spark):
    assert mixing.mix(no_docs).count() == 0
    out = mixing.mix(odd)
    assert dict(out.dtypes)["size"] == "bigint" and out.count() == odd.count()
    blank = spark.createDataFrame([(1, None, None), (None, "", "a"), (2, " ", "a")], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.mix(blank).select("size", "source_size", "target", "taken").distinct().collect()] == [(0, 0, 0.0, 0)]
    assert sorted(mixing.mixed(blank).columns) == ["doc_id", "source", "text"]


# 2 urls


def test_urls_against_the_rules(spark):
    cases = [
        ("http://example.com/en/x", "example.com", "/en/x", "example.com/en/", "block"),
        ("HTTP://WWW.Example.COM/en/?q=1", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("https://a.b.net/es/1#f", "a.b.net", "/es/1", "net/es/", "block"),
        ("https://notnet/es/1", "notnet", "/es/1", None, "allow"),
        ("//example.com/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("https://x.org/xxx-page", "x.org", "/xxx-page", None, "block"),
        ("https://x.org/xxxpage", "x.org", "/xxxpage", None, "allow"),
        ("https://casino.org/poker", "casino.org", "/poker", None, "block"),
        ("https://casino.org/casino?casinos", "casino.org", "/casino", None, "allow"),
        ("http://m.casino-win.example.org/de/1", "m.casino-win.example.org", "/de/1", None, "block"),
        ("http://cheap-pills.org/", "cheap-pills.org", "/", None, "block"),
        ("http://free-win-bonus.org/", "free-win-bonus.org", "/", None, "allow"),
        ("http://x.org/%70%4FRNO", "x.org", "/%70%4FRNO", None, "block"),
        ("http://x.org/%2570orno%20x", "x.org", "/%2570orno%20x", None, "allow"),
        ("http://x.org/pornotube1 pornotube", "x.org", "/pornotube1 pornotube", None, "block"),
        ("a://" + "y" * 100_000, "y" * 100_000, "", None, "allow"),
        ("http://com", "com", "", None, "allow"),
        ("http://com/", "com", "/", "com/", "allow"),
    ]
    df = spark.createDataFrame([(i, u[0], "clash") for i, u in enumerate(cases)] * 2, "page_id long, url string, host string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {(i, *c[1:]) for i, c in enumerate(cases)}
    assert urls.judge(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.judge(df, terms=[("", "", None)])
    table = spark.createDataFrame([("Foo", None, None), ("bar", "b", 1.0), ("bars", "b", 1.5), ("baz", None, 0.5)], "term string, root string, weight double")
    own = spark.createDataFrame([(1, "//foo"), (2, "//bar/bars"), (3, "//bars/baz"), (4, "//foobar")], "page_id long, url string")
    assert {r.page_id: (r.verdict, r.soft_weight) for r in urls.judge(own, terms=urls.vocabulary(table)).collect()} == {1: ("block", 0.0), 2: ("allow", 1.5), 3: ("block", 2.0), 4: ("allow", 0.0)}


def test_url_terms_against_plain_search_and_sql(spark, tmp_path):
    """The automaton against one regular expression a term, and against the query's SQL, over urls made of terms, escapes and debris."""
    import duckdb

    terms, rng = urls.built_in(), np.random.default_rng(8)
    assert len({t for t, _, _ in terms}) == len(terms) > 300
    bits = [t for t, _, _ in terms] + ["-", "/", "x", "1", "é", ".", "%", "%3", "%37", "%4", "%61", "%4A", "%33", "3%35", "?q=", "Free", "WIN"]
    made = ["http://h.org/" + "".join(("-" if rng.random() < 0.5 else "") + bits[i] for i in rng.integers(0, len(bits), 4)) for _ in range(400)]
    made += ["%%331", "%%335", "%%370orn", "%4%61", "%3%31", "%%36%66"]
    words = urls.Vocabulary(terms)
    for u in made:
        text = re.sub("%([0-9a-f]{2})", lambda m: low(chr(int(m[1], 16))) if re.fullmatch("[0-9A-Za-z]", chr(int(m[1], 16))) else m[0], low(u))
        assert urls.plain(u) == text
        found = [(r, w) for t, r, w in terms if re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", text)]
        soft = {r: w for r, w in found if w is not None}
        assert words.hits(text) == (len({r for r, w in found if w is None}), len(soft), sum(soft.values()))
    spark.createDataFrame(list(enumerate(made)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(urls.oracle_sql().replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, urls.judge(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect())) == sorted(want)


# 3 near-dedup


def brute_components(rows: list[tuple], n: int, percent: int) -> dict:
    sets = {}
    for doc, text, *_ in rows:
        w = low(text or "").split() if text and not re.search(r"[\x1c-\x1f\x85\xa0]", text) else word_list(low(text or ""))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_against_all_pairs(docs, rows, n):
    want = brute_components(rows, n, 80)
    got = near_dedup.near_duplicates(docs, words=n).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize(("block", "kept"), [((4, 2), (256, 4096)), ((6, 4), (4, 12)), ((2, 2), (1, 2))])
def test_near_duplicates_in_small_blocks(docs, rows, monkeypatch, block, kept):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "KEPT", kept)
    want = brute_components(rows, 2, 80)
    assert all(r.component_id == want[r.doc_id][1] for r in near_dedup.near_duplicates(docs, words=2).collect())


def test_blocks_meet_only_across_clusters(spark):
    """A cluster of many classes and a stranger: each class is sent out once, the stranger once a block; pooled blocks meet all."""
    rows = [("b", 0, i, "big") for i in range(100)] + [("b", 0, 100, "far")] + [("c", 0, i, f"c{i}") for i in range(30)]
    m = spark.createDataFrame(rows, "bucket string, band int, key int, cluster string")
    got = near_dedup._blocks(m, 10, near_dedup.scratch(spark), 1).collect()
    big = [r for r in got if r.cluster == "big"]
    assert len(big) == 100 and sum(r.cluster == "far" for r in got) == 1 + len({(r.i, r.j) for r in big})
    together = defaultdict(set)
    for r in got:
        together[r.bucket, r.i, r.j].add((r.key, r.cluster, r.block))
    met = Counter()
    for (bucket, i, j), g in together.items():
        for x in g:
            for y in g:
                if x[0] < y[0] and x[1] != y[1] and {x[2], y[2]} == {i, j}:
                    met[bucket, x[0], y[0]] += 1
    assert set(met.values()) == {1}
    assert set(met) == {("b", i, 100) for i in range(100)} | {("c", i, j) for i in range(30) for j in range(i + 1, 30)}


def test_near_dedup_edges(odd, no_docs, rows, spark):
    assert near_dedup.near_duplicates(no_docs).count() == 0
    out = near_dedup.deduplicated(odd, words=2)
    assert out.columns == odd.columns
    want = {d for d, (size, root) in brute_components(rows, 2, 80).items() if d == root}
    assert sorted(r.doc_id for r in out.collect()) == sorted(want)
    none = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert near_dedup.near_duplicates(none).count() == 3


def test_dedup_keeps_unlinked_texts_of_null_or_repeated_ids(spark):
    a, b, c, d, e, f = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcdef")
    rows = [(None, a), (None, b), (None, c), (None, c), (7, d), (7, e), (9, e), (3, f), (None, f), (None, None), (None, "")]
    out = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = [(None, a), (None, b), (None, c), (7, d), (7, e), (3, f), (None, None), (None, "")]
    assert Counter(tuple(r) for r in out.collect()) == Counter(want)


def test_dedup_carries_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "a b c d e f", 7, "p", "q"), (2, "a b c d e f", 8, "r", "s"), (3, None, 9, None, "t")], "doc_id long, text string, _k int, _rid string, _row string")
    got = near_dedup.deduplicated(d)
    assert got.columns == d.columns and sorted(map(tuple, got.collect())) == [(1, "a b c d e f", 7, "p", "q"), (3, None, 9, None, "t")]


def test_spread_join_splits_hot_keys(spark):
    from riskspark.llm import common

    left = spark.range(20_000).select(F.when(F.col("id") < 15_000, 0).otherwise(F.col("id") % 700).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    got = common.spread_join(left, right, ["k"], "n", salt=["id"])
    assert got.count() == 20_000 and got.where("v != 2 * k").count() == 0 and got.columns == ["k", "id", "n", "v"]
    plan = common.spread_join(left, right, ["k"], "n", salt=["id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(1)
    common, a, b = rng.integers(0, 1 << 62, 800).astype(np.uint64), rng.integers(0, 1 << 62, 100).astype(np.uint64), rng.integers(0, 1 << 62, 100).astype(np.uint64)
    x, y = near_dedup.registers(np.concatenate([common, a])), near_dedup.registers(np.concatenate([common, b]))
    assert near_dedup.estimate(x, y, np.array(900.0), np.array(900.0)) == pytest.approx(0.8, abs=0.15)


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 105: 100}


# 4 nearest neighbours


@pytest.mark.parametrize("shard", [8192, 64])
def test_nearest_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[100:300] = x[100]  # ties, more than a shard holds
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)]
    rows += [(900, None, ""), (920, [0.0] * 8, ""), (940, [float("nan")] * 8, ""), (960, [1.0, None] * 4, ""), (980, [float("inf")] + [1.0] * 7, ""), (1000, [1.0, 2.0], ""), (1020, [2.0, 2.0], ""), (None, [1.0] * 8, "")]
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(4)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, factor=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    full = x.astype(np.float64)
    assert got.pop(1000) == [(1, 1020, 6.0)] and got.pop(1020) == [(1, 1000, 6.0)]
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        s = np.array([math.fsum(full[q] * v) for v in full])
        want = [i for i in sorted(range(900), key=lambda i: (-round(s[i], 9), i)) if i != q][:20]
        assert [v for _, v, _ in found] == want
        assert [k for k, _, _ in found] == list(range(1, 21))
        np.testing.assert_allclose([v for *_, v in found], s[want], rtol=1e-12)


def test_pruning_on_clusters_and_recall_when_relaxed(spark, monkeypatch):
    """On clustered vectors exact search scores a small share; on vectors without clusters only a relaxed one prunes."""
    rng = np.random.default_rng(5)

    def measure(x, queries, factor):
        ids, top, count = np.arange(len(x)), float(np.linalg.norm(x, axis=1).max()) * (1 + 1e-12), []
        got, _ = neighbours.search(neighbours.build(ids, x, top), x[:queries], ids[:queries], 10, top, factor, count=count)
        s = x[:queries] @ x.T
        np.fill_diagonal(s[:, :queries], -np.inf)
        want = np.argsort(-s, axis=1)[:, :10]
        return sum(count) / queries / len(x), np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, want, strict=True)])

    centres = rng.normal(size=(60, 16))
    near = centres[rng.integers(0, 60, 6000)] + 0.05 * rng.normal(size=(6000, 16))
    near /= np.linalg.norm(near, axis=1)[:, None]
    share, recall = measure(near, 60, 1.0)
    assert recall == 1.0 and share < 0.4
    far = rng.normal(size=(6000, 64))
    far /= np.linalg.norm(far, axis=1)[:, None]
    assert measure(far, 60, 1.0)[1] == 1.0
    share, recall = measure(far, 300, neighbours.FACTOR)
    assert recall > 0.93 and share < 0.95
    # the whole job, in many regions and shards, at the same factor
    monkeypatch.setattr(neighbours, "SHARD", 400)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(far[:3000])], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.vec_id) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=10).collect()}
    s = far[:3000:20] @ far[:3000].T
    s[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
    want = {(20 * q, int(i)) for q, row in enumerate(np.argsort(-s, axis=1)[:, :10]) for i in row}
    assert len(found & want) / len(want) > 0.9 and len(found) == 1500


def test_nearest_edges(spark):
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 2.0)]
    assert neighbours.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# 5 sharding


def test_shards_are_even_and_keep_groups(docs, rows, no_docs, odd):
    got = sharding.sharded(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    again = sharding.sharded(odd.repartition(6)).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.shard, r.slot) for r in got)
    assert sharding.sharded(no_docs).count() == 0


def test_propagation_cuts_fewer_links_than_hashing(spark):
    pairs = spark.range(1600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), (F.col("id") / 2).cast("long")).alias("text"))
    out = sharding.sharded(pairs)
    cut = {r.shards: r.groups for r in sharding.cut_links(out, pairs).collect()}
    assert cut.get(1, 0) > 600  # by hash alone, 50 of 800 pairs would stay whole
    hot = spark.range(800).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 500, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    n = [r["count"] for r in sharding.sharded(hot).groupBy("shard").count().collect()]
    assert n == [50] * 16


# 6 media


def decode_png(data: bytes) -> list[bytes]:
    """A PNG's rows, read by the format's own rules: chunks, checksums, filters."""
    assert data[:8] == bytes.fromhex("89504e470d0a1a0a")
    at, chunks = 8, []
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        kind, body, crc = data[at + 4 : at + 8], data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(crc, "big")
        chunks.append((kind, body))
        at += n + 12
    assert chunks[0][0] == b"IHDR" and chunks[-1] == (b"IEND", b"")
    width, height = int.from_bytes(chunks[0][1][:4], "big"), int.from_bytes(chunks[0][1][4:8], "big")
    assert chunks[0][1][8:] == bytes([8, 0, 0, 0, 0])  # 8 bits, greyscale, deflate, adaptive filters, no interlace
    raw = zlib.decompress(b"".join(body for kind, body in chunks if kind == b"IDAT"))
    assert len(raw) == height * (width + 1)
    lines = [raw[i : i + width + 1] for i in range(0, len(raw), width + 1)]
    assert all(line[0] == 0 for line in lines)  # no filter
    return [line[1:] for line in lines]


def feature_of(data: bytes) -> str:
    n, h = len(data), len(data) // 64
    mean = sum(data) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in data) / n)
    bits = "".join("1" if sum(data[c::64]) / h > mean else "0" for c in range(64))
    return f"64x{h};mean={mean:.4f};sd={sd:.4f};hash={int(bits, 2):016x}"


def test_media_round_trip(docs, rows, no_docs, odd):
    got = media.media_table(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    text, same, shards = {r[0]: r[1] for r in rows}, defaultdict(set), {}
    for r in got:
        data = (text[r.doc_id] or "").encode()
        padded = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        if r.shard not in shards:
            shards[r.shard] = open(r.shard.removeprefix("file://"), "rb").read()
        stored = shards[r.shard][r.start : r.start + r.length]
        assert b"".join(decode_png(stored)) == padded and r.digest == hashlib.sha256(padded).digest()
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert (r.width, r.height, r.bits) == (64, len(padded) // 64, 8)
        assert r.feature == feature_of(padded)
        same[text[r.doc_id]].add((r.n_bytes, r.digest, r.payload_sha256, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in same.values())
    assert media.media_table(no_docs).count() == 0


def test_media_shards_are_tar_files(docs, spark):
    folder = media.scratch(spark)
    refs = media.written(media.store(docs, folder), "refs", folder)
    places = {tuple(r) for r in refs.select("digest", "shard", "start", "length").collect()}
    for path in {p[1] for p in places}:
        members = media.read_tar(path)
        assert members
        for name, data in members.items():
            assert name == hashlib.sha256(media.from_png(data).tobytes()).hexdigest() + ".png"
            assert any(p[0].hex() == name[:64] and p[3] == len(data) for p in places)
    assert len(places) == len({p[0] for p in places}) == media.index(refs).count()  # one place for each digest


def stored_digests(folder: str) -> Counter:
    from pathlib import Path

    return Counter(name[:64] for f in Path(folder.removeprefix("file://")).glob("*.tar") for name in media.read_tar(f"file://{f}"))


COPIES = [(i, "a common text" if i % 3 == 0 else f"text {i % 40}" if i % 3 == 1 else f"alone {i}") for i in range(600)] + [(None, None), (None, ""), (None, None), (7, "\0"), (8, "a common text\0")]


def test_media_stores_copies_of_many_tasks_once(spark):
    d = spark.createDataFrame(COPIES, "doc_id long, text string").repartition(12)
    folder = media.scratch(spark)
    refs = media.written(media.store(d, folder), "refs", folder)
    padded = {(t or "").encode() + b"\0" * (max(64, -(-len((t or "").encode()) // 64) * 64) - len((t or "").encode())) for _, t in COPIES}
    assert stored_digests(folder) == Counter(hashlib.sha256(p).hexdigest() for p in padded)
    assert Counter((r.doc_id, r.n_bytes) for r in refs.collect()) == Counter((i, len((t or "").encode())) for i, t in COPIES)
    assert refs.where("shard is null").count() == 0 and refs.select("digest", "shard", "start").distinct().count() == len(padded)


def test_media_of_one_row_many_times(spark):
    d = spark.range(20_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("again and again").alias("text")).repartition(8)
    folder = media.scratch(spark)
    refs = media.written(media.store(d, folder), "refs", folder)
    assert sum(stored_digests(folder).values()) == 1
    got = media.read_rows(refs)
    assert got.count() == 20_000 and got.select("payload_sha256", "media_sha256", "feature").distinct().count() == 1


def test_media_whose_owner_does_not_meet_it_is_stored_afterwards(spark, monkeypatch):
    d = spark.createDataFrame(COPIES, "doc_id long, text string").repartition(12)
    shared = media._shared
    monkeypatch.setattr(media, "_shared", lambda p: shared(p).withColumn("tasks", F.concat(F.array(F.lit(10_000)), "tasks")))
    folder = media.scratch(spark)
    refs = media.written(media.store(d, folder), "refs", folder)
    assert refs.count() == len(COPIES) and refs.where("shard is null").count() == 0
    assert set(stored_digests(folder).values()) == {1}
    assert media.read_rows(refs).where("payload_sha256 <> lower(hex(digest))").count() == 0


def test_media_headers_alone_and_null_ids(spark):
    d = spark.createDataFrame([(None, "a" * 200, 1), (1, "a" * 200, 2), (2, None, 3), (None, "x" * 3_000_000, 4)], "doc_id long, text string, width int").repartition(2)
    folder = media.scratch(spark)
    refs = media.written(media.store(d, folder), "refs", folder)
    assert sorted((r.width, r.height, r.bits) for r in media.headers(refs).collect()) == [(64, 1, 8), (64, 4, 8), (64, 4, 8), (64, 46875, 8)]
    got = media.media_table(d).collect()
    assert sorted((r.doc_id is None, r.n_bytes) for r in got) == [(False, 0), (False, 200), (True, 200), (True, 3_000_000)]


# 7 line dedup


def brute_lines(rows: list[tuple], common: int = 10) -> Counter:
    key = lambda line: low(line.strip(WHITE))
    seen = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = Counter()
    for doc, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= common)]
        out[doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


def test_lines_against_brute_force(docs, rows, odd, no_docs):
    want = brute_lines(rows)
    assert Counter(map(tuple, line_dedup.report(docs).collect())) == want
    assert Counter(map(tuple, line_dedup.report(odd.repartition(5), batches=5).collect())) == want
    assert sum(n for (_, _, dropped, _), n in want.items() if dropped) > 10
    out = line_dedup.deduplicated(odd)
    assert out.columns == odd.columns
    text = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out.collect()}
    assert text == {(d, h) for d, _, _, h in want}
    assert line_dedup.report(no_docs).count() == 0


def test_line_dedup_carries_columns_of_any_name_and_drops_its_runs(spark):
    rows = [(i, f"Same line\nown {i}", 7, "y", [i]) for i in range(12)] + [(None, "Same line", 8, None, [0])] * 2 + [(99, "x\n" * 200_000, 9, "z", [])]
    d = spark.createDataFrame(rows, "doc_id long, text string, _x int, _y string, _drop array<int>").repartition(3)
    got = line_dedup.deduplicated(d)
    assert got.columns == d.columns
    assert Counter((r.doc_id, r.text, r["_x"], r["_y"], tuple(r["_drop"])) for r in got.collect()) == Counter([(i, f"own {i}", 7, "y", (i,)) for i in range(12)] + [(None, "", 8, None, (0,))] * 2 + [(99, "x\n" * 200_000, 9, "z", ())])
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_merge_counts(spark):
    runs = line_dedup.Runs(line_dedup.scratch(spark), 3, common=4)
    for k in range(5):
        batch = spark.range(3).select(F.array(F.struct(F.lit(1).cast("long").alias("h1"), F.lit(2).cast("long").alias("h2")), F.struct((F.col("id") + 10 * k).alias("h1"), F.lit(0).cast("long").alias("h2"))).alias("hashes"))
        runs.add(batch)
    got = {(r.h1, r.h2): r.n for r in runs.totals(spark).collect()}
    assert got[1, 2] >= 4 and sum(v for k, v in got.items() if k != (1, 2)) == 15
    assert len(runs.tables(spark)) == 2  # one of four batches, one of the last
    runs.drop(spark)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


# 8 warc


def test_archives_round_trip(spark):
    big = "<html>" + "word " * 400
    rows = [(i, f"http://h/{i}", f"{big}{i % 7}", "clash") for i in range(60)] + [(60, None, None, ""), (61, "http://a\nb", "", ""), (62, "u", "short", ""), (63, "u", "short", ""), (None, "u", big, ""), (64, "u", big, ""), (65, "é", "ü" * 500, ""), (66, "", "ü" * 500, ""), (66, "", "ü" * 500, "")]
    rows += [(70 + i, "v", "<p>" + f"{i} unlike {i * i} " * 200, "") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    want, last = Counter(), {}
    for page, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1000 and page is not None:
            last[data] = max(last.get(data, page), page)
    for page, _, html, _ in rows:
        data = (html or "").encode()
        revisit = data in last and page != last[data]
        want[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last[data] if revisit else None] += 1
    assert Counter(map(tuple, warc.archived(df).collect())) == want
    assert warc.archived(df.limit(0)).count() == 0


def test_archives_roll_over_and_take_very_long_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROLL", 20_000)
    rng = np.random.default_rng(2)
    rows = [(i, "u", "".join(chr(97 + c) for c in rng.integers(0, 26, 4000))) for i in range(60)] + [(60, "u", "é" * 4_000_000), (61, "u", "é" * 4_000_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = warc.scratch(spark)
    archives = warc.written(warc.write(d, f"{folder}/warc"), "archives", folder)
    assert archives.count() > 2 and archives.agg(F.sum("records")).first()[0] == 62
    for path in [r.path.removeprefix("file://") for r in archives.collect()]:
        with open(path, "rb") as f:
            assert int.from_bytes(f.read(4), "little") == warc.MAGIC  # each archive carries the dictionary
    got = {r.page_id: r for r in warc.records(archives).collect()}
    assert len(got) == 62 and got[60].refers_to == 61 and got[61].payload_bytes == 8_000_000


def test_archives_begin_with_their_dictionary(spark):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<html><body class=article>"), F.col("id"), F.repeat(F.concat(F.lit("<p>"), F.col("id") % 50, F.lit("</p>")), 12)).alias("html")).coalesce(1)
    folder = warc.scratch(spark)
    path = warc.write(df, folder).first().path.removeprefix("file://")
    with open(path, "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc.MAGIC
        assert 0 < int.from_bytes(f.read(4), "little") <= warc.DICTIONARY


def test_archives_share_a_dictionary_from_a_spread_of_pages(spark):
    html = F.concat(F.lit("<html><body class=article>"), F.col("id"), F.repeat(F.concat(F.lit("<p>"), F.col("id") % 50, F.lit("</p>")), 130))
    df = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    hot = df.where("page_id = 1999").crossJoin(spark.range(3000)).drop("id")  # one row many times
    df = df.unionByName(hot).withColumn("html", F.when(F.col("page_id") == 3, F.repeat(F.lit("long "), 200_000)).otherwise(F.col("html"))).repartition(4)
    folder = warc.scratch(spark)
    archives = warc.written(warc.write(df, f"{folder}/warc"), "archives", folder)
    heads = set()
    for r in archives.collect():
        with open(r.path.removeprefix("file://"), "rb") as f:
            assert int.from_bytes(f.read(4), "little") == warc.MAGIC
            heads.add(f.read(int.from_bytes(f.read(4), "little")))
    assert archives.count() > 1 and len(heads) == 1
    assert warc.records(archives).count() == 5000


# 9 packing


def test_packing_against_the_tokenizer(docs, rows, no_docs, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    got = packing.packed(odd).collect()
    bins, by_doc = defaultdict(list), defaultdict(Counter)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r["length"]], "<u4").tobytes())
        bins[r.sequence_id].append((r.offset, r["length"]))
        by_doc[r.doc_id][r.piece, r.start, r["length"]] += 1
    repeats = Counter(r[0] for r in rows)
    for doc, parts in by_doc.items():
        assert set(parts.values()) == {repeats[doc]}
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at) and (k == 0 or length == packing.CAPACITY)
            at += length
        assert at == len(ids[doc]) and len(parts) == -(-at // packing.CAPACITY)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(len(ids[r[0]]) for r in rows)
    assert len(bins) <= math.ceil(total / packing.CAPACITY) + 1
    assert packing.packed(no_docs).count() == 0


def test_token_ids_agree_with_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", " ", "a\u00a0b", "Hello, world! it's", "\n\n  x\t", "<|endoftext|> in <|endoftext|>", "日本語 Ünïcode 😀", "x" * 3000, "don't I'll 'S 's", "1234 12,5", "\u2028 \u3000 y", "e\u0301"]
    for text in texts:
        assert packing.token_ids(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("n", [1_000_000, 5_000_000])
def test_very_long_runs_are_tokenized_whole(n):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in (" " * n, "\n" * n, "x" * n):
        assert packing.token_ids(text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def test_packing_takes_very_long_blanks_and_null_ids(spark):
    d = spark.createDataFrame([(1, " " * 1_000_000), (None, "\n" * 1_000_000), (None, None), (2, "a b")], "doc_id long, text string")
    got = packing.packed(d).collect()
    n = {1: 1_000_001, 2: len(packing.token_ids("a b")), None: len(packing.token_ids("\n" * 1_000_000)) + 1}
    total = Counter()
    for r in got:
        total[r.doc_id] += r.length
    assert total == n
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(n.values()) // 2048)


def test_fullest_is_a_subset_sum():
    rng = np.random.default_rng(0)
    for _ in range(30):
        counts = [0] + rng.integers(0, 3, 30).tolist()
        goal = int(rng.integers(1, 31))
        sums = {0}
        for length, n in enumerate(counts):
            sums |= {s + k * length for s in sums for k in range(n + 1) if s + k * length <= goal}
        got = packing.fullest(counts + [0] * (goal + 1 - len(counts)), goal)
        assert sum(a * b for a, b in got) == max(sums) and all(b <= counts[a] for a, b in got)


# 10 toxicity


def test_grammar_scores_clauses_not_words():
    g = toxicity.Grammar([("idiot", "I", 1.0), ("kill", "T", 1.0), ("scum*", "I", 1.0)])
    kind = lambda text: [toxicity.KINDS[i] for i in np.flatnonzero(g.features(text)[:-1])]
    assert kind("You idiot!") == ["targeted insult"]
    assert kind("what an idiot") == ["insult"]
    assert kind("you are not an idiot") == ["negated"]
    assert kind('he said you idiot') == ["reported"]
    assert kind("I will kill you.") == ["targeted threat"]
    assert kind("scumbags") == ["insult"] and kind("idiotic skills") == [] and kind("") == [] and kind(None) == []


def test_grammar_takes_hits_inside_tokens():
    g = toxicity.Grammar([("idiote", "I", 1.0), ("ordure", "I", 1.0), ("imbécile", "I", 1.0), ("idiot", "I", 1.0), ("tuer", "T", 1.0)])
    kind = lambda text: [toxicity.KINDS[i] for i in np.flatnonzero(g.features(text)[:-1])]
    for text in ("c'est l'idiote", "tas d’ordure", "l'imbécile", "_idiot_", "such_an_idiot", "idiot"):
        assert kind(text) == ["insult"], text
    assert kind("toi, l'idiote") == ["insult"] and kind("toi l'idiote") == ["targeted insult"] and kind("you_idiot") == ["targeted insult"]
    assert kind("tu n'es pas un peu l'idiote") == ["negated"] and kind("you aren't it, don't") == []
    assert kind("l'idiote d'tuer") == ["insult", "threat"] and kind("idiot'tuer") == ["insult", "threat"]


def plain_grammar(text: str | None, terms: list[tuple[str, str, float]], reach: int) -> dict[str, float]:
    """The grammar by direct rules: one pass over each distinct clause's tokens, no automaton and no transducers."""
    out, seen = defaultdict(float), set()
    for clause in re.split(r"[.!?;:\n]+|,(?=\s)", (text or "").lower()):
        if clause.strip(" .!?;:,\n\t") in seen:
            continue
        seen.add(clause.strip(" .!?;:,\n\t"))
        since, free, said, quoted, addressed, last = 99, False, False, False, False, None
        for token in re.findall(r"[^\W_]+(?:['’][^\W_]+)*|[\"“”„«»]", clause):
            found = [(w, k) for t, k, w in terms if (token.startswith(t[:-1]) if t[-1] == "*" else token == t)]
            if found:
                weight, k = max(found)
                negated, free = free and since < reach, False
                if said or quoted:
                    out["reported"] += weight
                elif negated:
                    out["negated"] += weight
                else:
                    name = "insult" if k == "I" else "threat"
                    out["targeted " + name if addressed else name] += weight
                    last = last if addressed else (name, weight)
            elif token in toxicity.QUOTES:
                quoted = not quoted if not said else quoted
            elif token in toxicity.NEGATIONS:
                since, free = 0, True
            elif token in toxicity.REPORTS:
                said = said or not quoted
            else:
                since += 1
                if token in toxicity.TARGETS:
                    if last and not addressed:
                        out[last[0]] -= last[1]
                        out["targeted " + last[0]] += last[1]
                    addressed, last = True, None
    return {k: v for k, v in out.items() if abs(v) > 1e-9}


@pytest.mark.parametrize("reach", toxicity.REACHES)
def test_grammar_against_plain_rules(reach):
    terms = [("idiot", "I", 2.0), ("scum*", "I", 1.5), ("trash", "I", 1.25), ("kill", "T", 3.0), ("burn*", "T", 2.5)]
    bits = ["idiot", "scum", "scumbags", "trash", "kill", "burning", "you", "they", "not", "never", "said", '"', "so", "very", "house", "idiots", ".", ",", "\n", "!"]
    rng, g = np.random.default_rng(9), toxicity.Grammar(terms, reach=reach)
    for _ in range(3000):
        text = " ".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 25)))
        got = {toxicity.KINDS[i]: v for i, v in enumerate(g.features(text)[:-1]) if abs(v) > 1e-9}
        assert got == pytest.approx(plain_grammar(text, terms, reach)), text


def test_toxicity_learns_beginnings_threats_and_targets(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 6))
    rows = []
    for i in range(400):
        talk = " ".join(word() for _ in range(20))
        if i % 2:
            talk += f". you zorblax{word()} thing. we will frund you, {word()} zobnar zorblax{word()}. frund zobnar"
        rows.append((i, talk, i % 2))
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    found = dict(toxicity.learned_terms(sample))
    assert "zorblax*" in found or "zorbla*" in found or "zorb*" in found or "zorbl*" in found
    assert {"frund"} <= set(found) and len(found) < 20
    terms = [("zorblax*", "I", 3.0), ("frund", "I", 3.0)]
    threats, targets = toxicity.neighbours(sample, terms)
    assert threats == {"frund"} and {"zobnar"} <= targets <= {"zobnar", "thing", "we", "will"}  # what always stands beside hits


def test_cut_falls_between_the_classes():
    z, y = np.array([-3.0, -2.0, -1.0, 0.5, 2.0]), np.array([0.0, 0.0, 0.0, 1.0, 1.0])
    shift = toxicity.at_cut(z, y, np.ones(5))
    assert ((1 / (1 + np.exp(-(z + shift))) >= toxicity.CUT) == (y > 0)).all()


def test_toxicity_learns_without_the_held_out(spark):
    bad = ["you grobnik trelf", "such a grobnik", "all grobniks must go"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        name = "".join(chr(97 + int(c)) * 3 for c in str(i))
        rows.append((i, f"the {name} and {name[::2]}x of it. " + (bad[i % 9 // 3] if toxic else f"good day {i % 11}"), "s"))
        labels.append((i, int(toxic)))
    rows += [(1000, None, "s"), (1001, "", "s"), (None, "you grobnik", "s"), (5, rows[5][1], "s"), (1002, "fine words " * 20000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    assert len(got) == len(rows)
    truth = dict(labels)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert toxicity.toxicity(docs.limit(0), known).count() == 0
    assert toxicity.toxicity(docs, known.limit(0)).count() == len(rows)
    assert toxicity.judged(docs, toxicity.fit(docs, known)).columns == ["doc_id", "text", "score", "predicted"]
