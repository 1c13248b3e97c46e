"""Embedding whitening over an exact scatter matrix: modular products over several primes, joined by Chinese remainders.

Every component c becomes the integer x = floor(scale * c) + shift. Each task takes its rows a block at a time, puts a 1
before each x-vector, and multiplies the block with itself modulo several primes below 2**21: residues around zero are
at most 2**20 in size, so that a block of 4096 rows gives sums below 2**53, which products of doubles hold exactly. Tasks
hold one matrix per prime and length of vector, whatever their number of rows; their rows are summed in pieces of WIDTH
residues before and after the shuffle. As many primes are taken as the number of rows and the largest x ask for. The driver joins
the residues into whole numbers: n, the sums S and the exact scatter. From these it has n*scatter - S*S', a matrix of
integers that is divided by n*n once, in one rounding, and decomposed twice: the second decomposition, of the covariance turned
into the first one's axes, takes out what rounding left beside the diagonal.

Vectors are then centred as integers (n*x - S), projected, and scaled; their covariance is taken from all rows in one
more pass and its largest distance from the identity is reported with them. What the driver holds grows with the square
of the vectors' length, never with the rows; lengths above MAX_DIM are refused with an error.

Defined results: vectors null or holding null or non-finite components take no part, zero vectors do; empty vectors have
no component and no row; a component beyond 2**56 in size counts as that; vectors of different lengths are fitted apart,
and more than LENGTHS lengths are refused with an error; a component of no variance (below 1e-12 of the largest one's) has
a null whitened value and no part in identity_error, which is null where no component has any; where all vectors are
equal, explained is null too; rows may repeat a vec_id or have none, each is whitened and counts; a deviation of more than
38 digits is null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, written

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
BLOCK, WIDTH = 4096, 64
MAX_DIM, LENGTHS = 2048, 64
#: x fits a long with room for the shift.
LARGEST = float(1 << 56)


def primes(count: int, below: int = 1 << 21) -> list[int]:
    """The largest primes below a bound, in falling order."""
    out, n = [], below - 1
    while len(out) < count:
        if n % 2 and all(n % k for k in range(3, isqrt(n) + 1, 2)):
            out.append(n)
        n -= 1
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues modulo p in -p/2 .. p/2, as doubles."""
    r = (x % p).astype(np.float64)
    return np.where(r > p // 2, r - p, r)


def scatter_mod(x: np.ndarray, p: int) -> np.ndarray:
    """x' x modulo p of a matrix of integers, exactly, by products of doubles over blocks of rows."""
    out = np.zeros((x.shape[1], x.shape[1]), np.int64)
    for at in range(0, len(x), BLOCK):
        r = centred(x[at : at + BLOCK], p)
        out = (out + (r.T @ r).astype(np.int64)) % p
    return out


def joined(residues: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers of least size with these residues, as an array of Python integers."""
    value, product = np.array([int(v) for v in residues[0].ravel()], dtype=object), moduli[0]
    for r, p in zip(residues[1:], moduli[1:], strict=True):
        step = (np.array([int(v) for v in r.ravel()], dtype=object) - value) * pow(product, -1, p) % p
        value, product = value + step * product, product * p
    value = np.array([v - product if v > product // 2 else v for v in value], dtype=object)
    return value.reshape(residues[0].shape)


@dataclass(frozen=True)
class Whitening:
    """A fit: n vectors with sums (integers), axes (columns, by falling variance), and the components' variances."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S as integers: longs where they fit, else Python's."""
        largest = max(1, int(np.abs(x).max(initial=0)))
        if self.n * largest + max(map(abs, self.sums), default=0) < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def deviation(self, d: np.ndarray) -> list[int]:
        """The sum of squares of each row of centred(), exactly."""
        largest = int(np.abs(d).max(initial=0))
        if d.dtype == np.int64 and largest * largest * d.shape[1] < 1 << 63:
            return [int(v) for v in np.einsum("ij,ij->i", d, d)]
        d = d.astype(object)
        return [int(v) for v in (d * d).sum(axis=1)]

    def whiten(self, d: np.ndarray) -> np.ndarray:
        """Projections of the rows of centred() in units of each component's deviation; not a number where it has none."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.variances > 0, 1 / np.sqrt(self.variances), np.nan)
        return ((d.astype(np.float64) / self.n) @ self.axes) * scale


def fitted(gram: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """From the exact scatter of vectors with a 1 before each."""
    n, sums = int(gram[0, 0]), [int(v) for v in gram[0, 1:]]
    d = len(sums)
    cov = np.array([[(n * gram[j + 1, k + 1] - sums[j] * sums[k]) / (n * n) for k in range(d)] for j in range(d)], np.float64)
    _, first = np.linalg.eigh(cov)
    turned = first.T @ cov @ first
    e, second = np.linalg.eigh((turned + turned.T) / 2)
    axes = first @ second
    axes, e = axes[:, ::-1][:, :components], e[::-1][:components]
    axes = axes / np.linalg.norm(axes, axis=0)
    return Whitening(n, sums, axes, np.where(e > max(e.max(initial=0), 0) * 1e-12, e, 0.0), float(np.trace(cov)))


def usable(v: Column) -> Column:
    fine = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, fine), F.lit(False))


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, dim and x, the integers of each usable vector."""
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(usable(F.col("v")))
    of = lambda c: F.floor(F.lit(float(scale)) * F.greatest(F.least(c, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + F.lit(shift)
    return v.select("vec_id", F.size("v").alias("dim"), F.transform("v", of).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(length, rows of that length, their matrix), a batch at a time."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims):
            part = b.filter(pa.array(dims == dim))
            yield int(dim), part, part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def scatter(x: DataFrame, moduli: dict[int, list[int]]) -> dict[int, np.ndarray]:
    """The exact scatter of the vectors of each length, with a 1 before each vector."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for dim, _, m in _blocks(batches):
            m = np.hstack([np.ones((len(m), 1), np.int64), m])
            for p in moduli[dim]:
                s = scatter_mod(m, p)
                sums[dim, p] = (sums[dim, p] + s) % p if (dim, p) in sums else s
        for (dim, p), s in sums.items():
            for at in range(0, dim + 1, WIDTH):
                part = s[:, at : at + WIDTH]
                part = np.pad(part, ((0, 0), (0, WIDTH - part.shape[1])))
                same = lambda v: pa.array(np.full(dim + 1, v, np.int32))  # noqa: B023, E731
                piece = pa.FixedSizeListArray.from_arrays(pa.array(part.ravel()), WIDTH).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([same(dim), same(p), pa.array(np.arange(dim + 1, dtype=np.int32)), same(at), piece], ["dim", "prime", "row", "at", "piece"])

    pieces = x.select("dim", "x").mapInArrow(products, "dim int, prime int, row int, at int, piece array<long>")
    total = pieces.groupBy("dim", "prime", "row", "at").agg(F.array(*[F.sum(F.col("piece")[k]) for k in range(WIDTH)]).alias("piece"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in total.toLocalIterator():  # dim squared numbers for each prime
        m = out.setdefault((r.dim, r.prime), np.zeros((r.dim + 1, r.dim + 1), np.int64))
        m[r.row, r.at : r.at + WIDTH] = np.array(r.piece, np.int64)[: r.dim + 1 - r.at] % r.prime
    return {dim: joined([out[dim, p] for p in ps], ps) for dim, ps in moduli.items()}


def moduli_for(x: DataFrame) -> dict[int, list[int]]:
    """By length of vector the primes whose product exceeds twice any entry of the scatter."""
    size = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    known = x.groupBy("dim").agg(F.count("*").alias("n"), F.max(size).alias("largest")).limit(LENGTHS + 1).collect()
    if len(known) > LENGTHS or any(r.dim > MAX_DIM for r in known):
        raise ValueError(f"vectors of at most {LENGTHS} lengths and {MAX_DIM} components are fitted")
    most = {r.dim: 2 * r.n * max(1, r.largest) ** 2 for r in known}
    return {dim: primes(most[dim].bit_length() // 20 + 1) for dim in most}


def whitened_rows(x: DataFrame, fits: dict[int, Whitening]) -> DataFrame:
    """vec_id, dim, deviation and whitened, an array; the components' values, null where one has no variance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, part, m in _blocks(batches):
            fit = fits[dim]
            d = fit.centred(m)
            deviation = fit.deviation(d)
            if max(deviation) < 1 << 63:
                exact = pa.array(deviation, pa.int64()).cast(pa.decimal128(38, 0))
            else:
                exact = pa.array([Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0))
            w = fit.whiten(d)
            values = pa.array(w.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), values)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("dim"), exact, lists], ["vec_id", "dim", "deviation", "whitened"])

    kind = x.schema["vec_id"].dataType.simpleString()
    return x.mapInArrow(run, f"vec_id {kind}, dim int, deviation decimal(38,0), whitened array<double>")


def identity_errors(x: DataFrame, fits: dict[int, Whitening]) -> dict[int, float]:
    """By length the largest entry of the whitened vectors' covariance less the identity, over the components with variance.

    Tasks give counts, means and centred products of their rows, which are put together as such.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, tuple] = {}
        for dim, _, m in _blocks(batches):
            fit = fits[dim]
            own = _moments(fit.whiten(fit.centred(m))[:, fit.variances > 0])
            parts[dim] = _together(parts[dim], own) if dim in parts else own
        for dim, (n, mean, products) in parts.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], ["dim", "n", "mean", "products"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: dict[int, tuple] = {}
        for b in batches:
            for dim, n, mean, products in zip(*(b.column(c).to_pylist() for c in ("dim", "n", "mean", "products")), strict=True):
                own = (n, np.array(mean), np.array(products).reshape(len(mean), len(mean)))
                whole[dim] = _together(whole[dim], own) if dim in whole else own
        for dim, (n, mean, products) in whole.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([n], pa.int64()), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], ["dim", "n", "mean", "products"])

    kind = "dim int, n long, mean array<double>, products array<double>"
    some = x.select("dim", "x").mapInArrow(moments, kind).repartition(16).mapInArrow(merged, kind)  # a row a task, then 16 rows a length
    whole: dict[int, tuple] = {}
    for r in some.toLocalIterator():
        own = (r.n, np.array(r.mean), np.array(r.products).reshape(len(r["mean"]), len(r["mean"])))
        whole[r.dim] = _together(whole[r.dim], own) if r.dim in whole else own
    return {dim: float(np.abs(products / n - np.eye(len(mean))).max()) for dim, (n, mean, products) in whole.items() if len(mean)}


def _moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = w.mean(axis=0)
    c = w - mean
    return len(w), mean, c.T @ c


def _together(a: tuple, b: tuple) -> tuple:
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def fit(x: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """By length of vector the whitening of quantised() vectors."""
    moduli = moduli_for(x)
    return {dim: fitted(gram, components) for dim, gram in (scatter(x, moduli) if moduli else {}).items()}


def whitened(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, n, deviation (a decimal), whitened and explained (arrays by component), identity_error; a row per usable vector."""
    spark = vectors.sparkSession
    x = written(quantised(vectors, vec_id, embedding, scale, shift), "x", scratch(spark))
    fits = fit(x, components)
    if not fits:
        kind = x.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    errors = identity_errors(x, fits)
    facts = [(dim, f.n, [float(e) / f.trace if f.trace > 0 else None for e in f.variances], errors.get(dim)) for dim, f in fits.items()]
    known = F.broadcast(spark.createDataFrame(facts, "dim int, n long, explained array<double>, identity_error double"))  # at most LENGTHS rows
    return whitened_rows(x, fits).join(known, "dim").select("vec_id", "n", "deviation", "whitened", "explained", "identity_error")


def components_of(w: DataFrame) -> DataFrame:
    """whitened() with a row per component: vec_id, component (from 1), n, deviation (null where it exceeds a long), whitened, explained, identity_error."""
    d = w.select("vec_id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return d.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
