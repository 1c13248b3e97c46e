"""The sample that toxicity learns from: near copies count once, and no other text is taken for one."""

from __future__ import annotations

import random

from riskspark.llm import toxicity

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def text_of(rng, n, of):
    return " ".join(rng.choice(of) for _ in range(n))


def test_near_copies_share_a_group_and_no_other_text_does(spark):
    rng = random.Random(4)
    of = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(3, 9))) for _ in range(3000)]
    texts = ["are " + text_of(rng, rng.randrange(20, 60), of) for _ in range(300)]  # a word that all of them share
    copies = []
    for k in range(60):
        words = texts[k].split(" ")
        words[rng.randrange(1, len(words))] = "changed"
        copies.append((k, " ".join(words)))
    rows = [(i, t, i % 2) for i, t in enumerate(texts)] + [(1000 + k, t, k % 2) for k, t in copies] + [(2000, texts[0].upper(), 0), (2001, None, 0), (2002, "", 0)]
    got = {r.doc_id: r.group for r in toxicity.grouped(spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)).collect()}
    assert len(got) == len(rows)
    assert len({got[i] for i in range(300)}) == 300
    assert all(got[1000 + k] == got[k] for k, _ in copies) and got[2000] == got[0] and got[2001] == got[2002]


def test_learned_terms_against_plain_counts(spark):
    rng = random.Random(9)
    of = ["".join(rng.choice(LETTERS) for _ in range(6)) for _ in range(400)]
    rows = [(text_of(rng, 30, of) + (" zounds grumbold" if i % 3 == 0 else ""), 1) for i in range(60)] + [(text_of(rng, 30, of), 0) for _ in range(120)]
    got = dict(toxicity.learned_terms(spark.createDataFrame(rows, "text string, toxic int")))
    sets = [({w for w in t.split(" ") if len(w) >= 3}, y) for t, y in rows]
    size = {y: sum(len(w) for w, z in sets if z == y) for y in (0, 1)}

    def odds(word):
        n = {y: sum(word in w for w, z in sets if z == y) for y in (0, 1)}
        return n[1], ((n[1] + 0.5) / size[1]) / ((n[0] + 0.5) / size[0])

    whole = {w for s, _ in sets for w in s}
    want = {w for w in whole for n, o in [odds(w)] if n >= toxicity.MIN_TEXTS and o >= toxicity.MIN_ODDS}
    covers = lambda term, w: w == term or (term.endswith("*") and w.startswith(term[:-1]))
    assert {"zounds", "grumbold"} <= want and all(any(covers(t, w) for t in got) for w in want)
    assert all(t.endswith("*") or t in want for t in got)


def test_the_cut_is_the_best_there_is():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        z, y, w = np.round(rng.normal(size=40), 1), rng.integers(0, 2, 40).astype(float), rng.random(40) + 0.1
        y[0] = 1.0
        shift = toxicity.at_cut(z, y, w)
        f1 = lambda yes: 2 * (w * y)[yes].sum() / (w[yes].sum() + (w * y).sum())  # noqa: E731, B023
        at = np.log(toxicity.CUT / (1 - toxicity.CUT))
        assert abs(f1(z + shift >= at) - max(f1(z >= v) for v in z)) < 1e-12
