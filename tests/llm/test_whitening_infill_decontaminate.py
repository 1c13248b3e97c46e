"""Whitening, fill-in-middle and decontamination against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.llm import decontaminate, infill, whitening

# 11 whitening


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n long, x string, dim string, whitened string")


def table_of(*vs):
    return [(i, v, 0, 1, "clash", "clash", "clash") for i, v in vs]


def brute_fit(xs):
    n, d = len(xs), len(xs[0])
    s = [sum(x[j] for x in xs) for j in range(d)]
    cov = [[Fraction(sum((n * x[j] - s[j]) * (n * x[k] - s[k]) for x in xs), n**3) for k in range(d)] for j in range(d)]
    return n, s, np.array([[float(v) for v in row] for row in cov])


def test_residues_join_to_exact_integers():
    ps = whitening.primes(6)
    assert ps == sorted(ps, reverse=True) and all(p < 1 << 21 and all(p % k for k in range(2, 1500)) for p in ps)
    rng = random.Random(5)
    values = [[rng.randrange(-(10**34), 10**34) for _ in range(3)] for _ in range(3)]
    residues = [np.array([[v % p for v in row] for row in values]) for p in ps]
    assert whitening.joined(residues, ps).tolist() == values
    x = np.array([[rng.randrange(-(1 << 62), 1 << 62) for _ in range(5)] for _ in range(whitening.BLOCK + 7)])
    for p in ps[:2]:
        exact = [[sum(int(a) * int(b) for a, b in zip(x[:, j], x[:, k], strict=True)) % p for k in range(5)] for j in range(5)]
        assert whitening.scatter_mod(x, p).tolist() == exact


@pytest.mark.parametrize("size", [1.0, 3e9])
def test_whitening_against_fractions(spark, size):
    rng = random.Random(3)
    rows = [(i, [size * (rng.gauss(0, 1) + (i % 3)) * (k + 1) for k in range(5)]) for i in range(90)]
    rows += [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [float("nan")] * 5), (93, [float("inf")] * 5), (94, [0.0] * 5), (3, rows[3][1]), (None, rows[4][1])]
    got = whitening.whitened(vectors(spark, table_of(*rows)).repartition(4)).collect()
    cast = lambda v: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]
    fine = [(i, cast(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n, s, cov = brute_fit([x for _, x in fine])
    assert len(got) == len(fine) == n
    dev = sorted((str(i), sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True))) for i, x in fine)
    assert sorted((str(r.vec_id), int(r.deviation)) for r in got) == dev
    e = np.linalg.eigvalsh(cov)[::-1]
    for r in got:
        assert r.n == n and r.identity_error < 1e-9 and r.explained == pytest.approx(list(e / e.sum()), rel=1e-9)
    for a in got[:10]:  # squares of whitened values add up to the distance under the inverse covariance, whatever the signs
        x = next(x for i, x in fine if i == a.vec_id and abs(sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)) - int(a.deviation)) == 0)
        c = np.array([float(Fraction(n * v - t, n)) for v, t in zip(x, s, strict=True)])
        assert sum(v * v for v in a.whitened) == pytest.approx(c @ np.linalg.inv(cov) @ c, rel=1e-6)


def test_whitening_edges(spark):
    assert whitening.whitened(vectors(spark, [])).count() == 0
    assert whitening.components_of(whitening.whitened(vectors(spark, table_of((1, None), (2, []))))).count() == 0
    same = whitening.whitened(vectors(spark, table_of((1, [1.0, 2.0]), (2, [1.0, 2.0])))).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in same] == [(2, 0, [None, None], [None, None], None)] * 2
    flat = whitening.whitened(vectors(spark, table_of(*[(i, [float(i), 5.0]) for i in range(4)]))).collect()
    assert all(r.whitened[1] is None and r.explained[0] == pytest.approx(1) and r.identity_error < 1e-12 for r in flat)
    mixed = whitening.components_of(whitening.whitened(vectors(spark, table_of(*[(i, [float(i)] * (1 + i % 2)) for i in range(6)])))).collect()
    assert {(r.vec_id, r.n) for r in mixed} == {(i, 3) for i in range(6)} and len(mixed) == 9
    huge = whitening.whitened(vectors(spark, table_of((1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [1e30, 2.0])))).collect()
    x = [64 * (1 << 56) + 1_000_000, -64 * (1 << 56) + 1_000_000, 64 * (1 << 56) + 1_000_000]
    y = [1_000_000, 1_000_064, 1_000_128]
    exact = {i + 1: (3 * a - sum(x)) ** 2 + (3 * b - sum(y)) ** 2 for i, (a, b) in enumerate(zip(x, y, strict=True))}
    assert all(int(r.deviation) == exact[r.vec_id] if exact[r.vec_id] < 10**38 else r.deviation is None for r in huge)
    with pytest.raises(ValueError, match="lengths"):
        whitening.whitened(vectors(spark, table_of(*[(i, [1.0] * (i + 1)) for i in range(whitening.LENGTHS + 1)])))


# 12 infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_infill(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 80 else (n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def test_checkpoints_find_every_cut():
    rng = random.Random(2)
    for stride in (1, 2, 7, 64):
        for _ in range(40):
            text = "".join(rng.choice("ab é\U0001f600 \t\n\x0b") for _ in range(rng.randrange(0, 400)))
            units, index = UNIT.findall(text), infill.Checkpoints(text.encode(), stride)
            assert index.n == len(units)
            for u in range(len(units) + 1):
                before = "".join(units[:u])
                assert index.cut(u) == (len(before.encode()), len(before)), (text, u)
    assert len(infill.Checkpoints(b"word " * 10_000).units) == 10_000 // infill.STRIDE + 1


def test_infill_against_brute_force(odd, rows, spark):
    more = [(k, t, "en", "web", 0) for k, t in ((900, "a <P> b"), (901, "<S>"), (902, "x<M"), (903, "<" * 50 + " P>" * 50), (904, "\U0001f600" * 2000 + " z " * 3000), (905, " \n"), (None, "one two three"), (906, "w " * 300_000))]
    docs = odd.select("doc_id", "text", "size", "n", "score").unionByName(spark.createDataFrame([(a, b, "c", "c", "c") for a, b, *_ in more], "doc_id long, text string, size string, n string, score string"))
    got = infill.with_infill(docs).select("doc_id", "text", "size", "infill.*", infill.restored(F.col("infill.output"), F.col("infill.form")).alias("back")).toDF("doc_id", "text", "size", "n", "form", "p", "m", "output", "back").collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        assert (r.n, r.form, r.p, r.m, r.output) == brute_infill(r.doc_id, r.text), r.doc_id
        assert r.back == (r.text or "") and r["size"] in ("clash", "c")
    assert {"plain", "spm", "psm"} == {r.form for r in got}
    report = {tuple(r) for r in infill.digests(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert report == {(r.doc_id, *b[:4], sha(b[4]), sha(r.text or "")) for r in got for b in [brute_infill(r.doc_id, r.text)]}


def test_infill_edges(no_docs, docs):
    assert infill.digests(no_docs).count() == 0
    with pytest.raises(ValueError, match="infill"):
        infill.with_infill(docs.withColumn("infill", F.lit(1)))
    all_ = infill.with_infill(docs, into="made", rate=100, spm=0).select("text", "made.form").collect()
    assert {r.form for r in all_ if r.text} == {"psm"}


# 13 decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_hits(text, items):
    w, places, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(10, len(v))
        for i in range(len(v) - k + 1 if v else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == v[i : i + k]:
                    places |= set(range(j, j + k))
                    found |= {str(item)} if item is not None else set()
    ids = ",".join(sorted(found))
    return len(w), len(places), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(places)


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(8)
    some = lambda n: " ".join(rng.choice("Ab cd EF gh1 é. ñu, x-y 9".split()) for _ in range(n))
    items = [(i, some(rng.choice((1, 2, 4, 5, 9, 10, 11, 30)) + 12)) for i in range(12)]
    items += [(100, "one two"), (101, "Solo"), (9, items[9][1]), (102, items[3][1]), (None, "null item has ten words in it so that counts"), (103, None), (104, "?!"), (105, "a b c d e f g h i")]
    docs = []
    for i in range(60):
        t = some(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items)[1] or "").split(" ")
            at = rng.randrange(0, max(1, len(w) - 5))
            t = t + rng.choice((" ", "\n", "")) + " ".join(w[at:]) + " " + some(rng.randrange(0, 9))
        docs.append((i, t))
    docs += [(60, None), (61, ""), (62, "solo"), (63, "SOLO solo, one TWO one two"), (64, some(20_000) + " " + items[11][1]), (65, "null item has ten words in it so that counts"), (5, docs[5][1]), (None, docs[6][1]), (5, docs[5][1]), (66, "A B-C d.e f g h i a b c d")]
    return docs, items


def test_decontamination_against_brute_force(spark, leaks):
    docs, items = leaks
    extra = ("n", "k", "h", "pos", "found", "window", "spans", "items", "_x")
    d = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit("clash").alias(c) for c in extra]).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("clash"))
    want = sorted(((i, *brute_hits(t, items)) for i, t in docs), key=str)
    assert sorted(map(tuple, decontaminate.report(d, b).collect()), key=str) == want
    assert 20 < sum(w[5] for w in want) < len(want)
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect() if r.text) == sorted((i, t) for i, t in docs if i is not None and t and not brute_hits(t, items)[4])
    for r in decontaminate.marked(d, b).collect():
        n, hit, *_ = brute_hits(r._row.text, items)
        assert sum(s["to"] - s["from"] for s in r.spans) == hit and all(a["to"] < c["from"] for a, c in zip(r.spans, r.spans[1:], strict=False))


def test_decontamination_with_a_full_bitmap(spark, leaks, monkeypatch):
    docs, items = leaks
    monkeypatch.setattr(decontaminate, "BITS", (2, 2))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.report(d, b).collect()), key=str) == sorted(((i, *brute_hits(t, items)) for i, t in docs), key=str)


def test_decontamination_edges(spark, no_docs, docs, rows):
    b = spark.createDataFrame([(1, "w1 w2")], "item_id long, text string")
    assert decontaminate.report(no_docs, b).count() == 0
    none = decontaminate.report(docs, b.where("false")).collect()
    assert len(none) == len(rows) and all((r.n_hit, r.n_items, r.contaminated) == (0, 0, False) for r in none)
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "w1 w2 w1").alias("text"))
    got = decontaminate.report(many, b).groupBy("n_words", "n_hit", "n_items").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0, 6667), (3, 2, 1, 13333)]


def test_decontamination_has_no_python(spark, leaks):
    docs, items = leaks
    out = decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
