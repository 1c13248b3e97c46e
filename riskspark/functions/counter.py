"""Random numbers as a function of a counter: Threefry with two words of 32 bits and twenty rounds, as Column arithmetic, as SQL and in NumPy.

A draw depends on seed, stream, simulation and step alone, so it is the same in every engine, plan, order and partitioning,
and draws of different counters are independent for all practical purposes. The words are kept in longs and masked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The generator's rotations, its parity word, and the rounds after which a key is injected.
ROTATIONS = (13, 15, 26, 6, 17, 29, 16, 24)
PARITY = 0x1BD11BDA
ROUNDS, INJECT = 20, 4
MASK = 0xFFFFFFFF

SEED = 42
#: Streams: draws of blocks, draws of tails.
BLOCKS, TAILS = 0, 1


def threefry(key0: Column, key1: Column, counter0: Column, counter1: Column) -> Column:
    """A struct of the words x0 and x1."""
    word = lambda c: c.cast("long").bitwiseAND(F.lit(MASK))
    k0, k1 = word(key0), word(key1)
    k2 = k0.bitwiseXOR(k1).bitwiseXOR(F.lit(PARITY))
    turns = F.array(*[F.lit(ROTATIONS[i % len(ROTATIONS)]) for i in range(ROUNDS)])
    start = F.struct(word(word(counter0) + k0).alias("x0"), word(word(counter1) + k1).alias("x1"), k0.alias("k0"), k1.alias("k1"), k2.alias("k2"), F.lit(0).alias("i"))

    def rotated(x: Column, turn: Column) -> Column:
        return F.call_function("shiftleft", x, turn).bitwiseOR(F.call_function("shiftright", x, F.lit(32) - turn)).bitwiseAND(F.lit(MASK))

    def one(s: Column, turn: Column) -> Column:
        x0 = word(s["x0"] + s["x1"])
        mixed = F.struct(x0.alias("x0"), rotated(s["x1"], turn).bitwiseXOR(x0).alias("x1"), s["k0"].alias("k0"), s["k1"].alias("k1"), s["k2"].alias("k2"), (s["i"] + 1).alias("i"))
        return F.element_at(F.transform(F.array(mixed), injected), 1)

    def injected(s: Column) -> Column:
        """Every fourth round adds the next two key words, which go round, and the number of the injection."""
        now = s["i"] % INJECT == 0
        kept = lambda name: s[name].alias(name)
        x0 = F.when(now, word(s["x0"] + s["k1"])).otherwise(s["x0"])
        x1 = F.when(now, word(s["x1"] + s["k2"] + F.floor(s["i"] / INJECT))).otherwise(s["x1"])
        turned = [F.when(now, s[b]).otherwise(s[a]).alias(a) for a, b in (("k0", "k1"), ("k1", "k2"), ("k2", "k0"))]
        return F.struct(x0.alias("x0"), x1.alias("x1"), *turned, kept("i"))

    return F.aggregate(turns, start, one, lambda s: F.struct(s["x0"].alias("x0"), s["x1"].alias("x1")))


def uniform(stream: int, sim: Column, step: Column, seed: int = SEED) -> Column:
    """A double in [0, 1) of 52 bits for each simulation (a long) and step (below 2**32)."""
    sim = sim.cast("long")
    words = threefry(F.lit(seed), F.shiftright(sim, 32).cast("long") + stream * (1 << 20), sim, step)
    return F.element_at(F.transform(F.array(words), lambda w: (w["x0"] * (1 << 20) + F.shiftright(w["x1"], 12)) / float(1 << 52)), 1)


def uniforms(stream: int, sim: Column, step: Column, seed: int = SEED) -> Column:
    """uniform() for a table of draws, neither sim nor step null: a batch of rows at a time, where the Column takes some tenths of a millisecond a draw. Not for lambdas."""
    draw = F.pandas_udf(lambda sims, steps: pd.Series(drawn(stream, sims.to_numpy("int64"), steps.to_numpy("int64"), seed)), "double")
    return draw(sim.cast("long"), step.cast("long"))


def drawn(stream: int, sim: np.ndarray, step: np.ndarray, seed: int = SEED) -> np.ndarray:
    """uniform() of two arrays of longs."""
    k0, k1 = np.int64(seed & MASK), ((sim >> 32) + stream * (1 << 20)) & MASK
    keys = (k0, k1, k0 ^ k1 ^ PARITY)
    x0, x1 = ((sim & MASK) + k0) & MASK, ((step & MASK) + k1) & MASK
    for i in range(ROUNDS):
        turn = ROTATIONS[i % len(ROTATIONS)]
        x0 = (x0 + x1) & MASK
        x1 = ((x1 << turn | x1 >> (32 - turn)) & MASK) ^ x0
        j, last = divmod(i + 1, INJECT)
        if last == 0:
            x0, x1 = (x0 + keys[j % 3]) & MASK, (x1 + keys[(j + 1) % 3] + j) & MASK
    return (x0 * (1 << 20) + (x1 >> 12)) / float(1 << 52)


def uniform_sql(source: str, stream: int, sim: str, step: str, name: str = "u", seed: int = SEED) -> str:
    """A DuckDB SELECT of all columns of source and the draw, as name."""
    word = lambda x: f"(({x}) & {MASK})"
    high = f"({sim} >> 32) + {stream * (1 << 20)}"
    keys = ["k0", "k1", "k2"]
    sql = f"SELECT *, CAST({seed} AS BIGINT) AS k0, {word(high)} AS k1, xor(xor(CAST({seed} AS BIGINT), {word(high)}), {PARITY}) AS k2, {word(f'CAST({sim} AS BIGINT)')} AS c0, {word(f'CAST({step} AS BIGINT)')} AS c1 FROM {source}"
    sql = f"SELECT *, {word('c0 + k0')} AS a, {word('c1 + k1')} AS b FROM ({sql})"
    for i in range(1, ROUNDS + 1):
        turn = ROTATIONS[(i - 1) % len(ROTATIONS)]
        sql = f"SELECT * REPLACE ({word('a + b')} AS a, xor({word(f'(b << {turn}) | (b >> {32 - turn})')}, {word('a + b')}) AS b) FROM ({sql})"
        if i % INJECT == 0:
            keys = [*keys[1:], keys[0]]
            sql = f"SELECT * REPLACE ({word(f'a + {keys[0]}')} AS a, {word(f'b + {keys[1]} + {i // INJECT}')} AS b) FROM ({sql})"
    return f"SELECT * EXCLUDE (k0, k1, k2, c0, c1, a, b), (a * {1 << 20} + (b >> 12))/CAST({1 << 52} AS DOUBLE) AS {name} FROM ({sql})"
