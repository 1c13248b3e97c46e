"""Fixtures for the operators' tests: small tables with nulls, ties, repeated rows, empty and long texts, odd columns."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def words(rng: random.Random, n: int, of: int = 300) -> str:
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def corpus(seed: int = 7, n: int = 120) -> list[tuple]:
    """Documents with exact and near copies, shared lines, a hot source, null, empty, blank and very long texts."""
    rng = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            text = rng.choice(texts)
        elif texts and kind < 0.4:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(1000)}"
            text = " ".join(t)
        else:
            text = words(rng, rng.choice((1, 2, 3, 12, 40, 80)))
        texts.append(text)
        if rng.random() < 0.4:
            text = text + "\n" + rng.choice(("Shared line", " shared LINE \t", "another one", "")) + "\n" + words(rng, 3)
        rows.append((i, text, "en", rng.choice(("web", "web", "web", "books", None, "wiki", "Ünï"))))
    extra = [(n, None), (n + 1, ""), (n + 2, "  \t\n "), (n + 3, words(rng, 20000, 5000)), (n + 4, "Ω \U0001f600 é x\x0by"), (n + 5, "one"), (n + 6, "ONE")]
    rows += [(i, t, None, "web") for i, t in extra]
    rows += [rows[3], rows[3]]  # rows repeated whole
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(docs):
    """The same documents with columns whose names clash with what operators add."""
    more = ("size", "source_size", "target", "taken", "score", "predicted", "piece", "offset", "rank", "count", "n", "key", "bucket", "component_id", "kept", "shard", "slot", "host", "digest", "batch", "x", "y")
    return docs.select("*", *[F.lit("clash").alias(c) for c in more])


@pytest.fixture(scope="session")
def rows(docs):
    return [tuple(r) for r in docs.collect()]
