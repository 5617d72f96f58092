"""Whitening of embeddings from an exact scatter matrix.

Entries become integers, so sums of products are integers too. A task multiplies its vectors, with a 1 behind
each, by themselves modulo several primes: residues are so small that a product in double precision is exact.
Residues of tasks are added modulo each prime, and the Chinese remainder theorem gives the integers
themselves: the number of vectors, their sums and their products, however many vectors there are and in
whatever order they came. Primes are chosen so that their product is beyond any value that can come out. From
the exact scatter about the mean, eigenvectors come in double precision.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped. Vectors of
different lengths are fitted apart; empty vectors have no components. Equal vectors count once in the fit, and
every row is projected. Entries beyond a long's range once scaled are held at 2**62. Components beyond the
rank of the scatter (found exactly, modulo primes) have explained 0 and whitened null; explained is null where
all vectors of a length are equal. deviation is a decimal of 38 digits, null beyond. Null and repeated ids stay;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import frames, kernel

#: Fixed values of the contract: entries are scaled, rounded down and shifted.
SCALE, SHIFT = 64, 1_000_000
#: Primes are below this; so many rows are multiplied at once. Residues lie within half a prime of zero: products' sums stay below 2**53.
PRIME_LIMIT, ROWS = 1 << 20, 1 << 14
WIDTHS = {1: np.dtype("<i1"), 2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<i8")}

CODED = "vec_id long, dim int, code binary"
RESIDUES = "prime long, line int, residues array<long>"
PROJECTED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def primes(product: int) -> list[int]:
    """The largest primes below PRIME_LIMIT, two at least, whose product is more than this."""
    out, total, p = [], 1, PRIME_LIMIT - 1
    while total <= product or len(out) < 2:
        if all(p % q for q in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            total *= p
        p -= 2
    return out


def coded(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) as int64, held at 2**62."""
    return np.clip(np.floor(values * SCALE), -(2.0**62), 2.0**62).astype(np.int64)


def _code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A vector's integers as bytes: as many for an entry as its largest one needs, so equal vectors have equal bytes."""
    for batch in batches:
        column = kernel.column(batch, "embedding")
        row = np.flatnonzero(np.asarray(column.is_valid()))
        column = column.take(pa.array(row))
        flat = column.flatten()
        size = np.asarray(column.value_lengths(), np.int64)
        values = np.asarray(flat.fill_null(np.nan), np.float64)
        whole = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
        at = np.cumsum(size) - size
        keep = np.flatnonzero(whole[at + size] == whole[at])
        codes = np.zeros(len(values), np.int64)
        finite = np.isfinite(values)
        codes[finite] = coded(values[finite])
        packed = []
        for a, n in zip(at[keep].tolist(), size[keep].tolist(), strict=True):
            v = codes[a : a + n]
            most = int(np.abs(v).max()) if n else 0
            width = next(w for w in WIDTHS if most < 1 << 8 * w - 1)
            packed.append(v.astype(WIDTHS[width]).tobytes())
        ids = kernel.column(batch, "vec_id").take(pa.array(row[keep]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(size[keep], pa.int32()), kernel.binary(packed)], names=["vec_id", "dim", "code"])


def codes_of(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers of vectors of one length."""
    out = np.empty((len(column), dim), np.int64)
    raw = [x.as_py() for x in column]
    widths = np.fromiter((len(x) // dim for x in raw), np.int64, len(raw))
    for w, kind in WIDTHS.items():
        mine = np.flatnonzero(widths == w)
        if len(mine):
            out[mine] = np.frombuffer(b"".join([raw[i] for i in mine]), kind).reshape(-1, dim)
    return out


def residues(y: np.ndarray, p: int) -> np.ndarray:
    """y modulo p, as doubles within half of p of zero."""
    r = y % p
    return np.where(r > p // 2, r - p, r).astype(np.float64)


def product(y: np.ndarray, p: int) -> np.ndarray:
    """(y 1)' (y 1) modulo p."""
    d = y.shape[1] + 1
    total = np.zeros((d, d), np.int64)
    for a in range(0, len(y), ROWS):
        r = residues(y[a : a + ROWS], p)
        r = np.concatenate((r, np.ones((len(r), 1))), 1)
        total = (total + (r.T @ r).astype(np.int64)) % p
    return total


def _scatter(dim: int, moduli: list[int]):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {p: np.zeros((dim + 1, dim + 1), np.int64) for p in moduli}
        some = False
        for batch in batches:
            y, some = codes_of(kernel.column(batch, "code"), dim), True
            for p in moduli:
                total[p] = (total[p] + product(y, p)) % p
        if some:
            yield from _lines({(p, i): m[i] for p, m in total.items() for i in range(dim + 1)})

    return run


def _lines(total: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    keys = [*total]
    for a in range(0, len(keys), 1024):
        part = keys[a : a + 1024]
        lines = pa.ListArray.from_arrays(np.arange(len(part) + 1) * len(total[part[0]]), np.concatenate([total[k] for k in part]))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in part]), pa.array([i for _, i in part], pa.int32()), lines], names=["prime", "line", "residues"])


@kernel.released
def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        keys = zip(kernel.column(batch, "prime").to_pylist(), kernel.column(batch, "line").to_pylist(), strict=True)
        for key, line in zip(keys, kernel.column(batch, "residues"), strict=True):
            v = line.values.to_numpy()
            total[key] = (total[key] + v) % key[0] if key in total else v
    if total:
        yield from _lines(total)


def remaindered(by_prime: dict[int, np.ndarray]) -> np.ndarray:
    """The integers nearest to zero that have these residues."""
    whole = 1
    for p in by_prime:
        whole *= p
    out = sum(r.astype(object) * ((whole // p) * pow(whole // p, -1, p)) for p, r in by_prime.items()) % whole
    return np.where(out > whole // 2, out - whole, out)


def rank(m: np.ndarray, p: int) -> int:
    """Rank of an integer matrix modulo p: its rank, or less where p happens to divide a minor."""
    a = (m % p).astype(np.int64)
    done = 0
    for c in range(a.shape[1]):
        at = np.flatnonzero(a[done:, c])
        if not len(at):
            continue
        a[[done, done + at[0]]] = a[[done + at[0], done]]
        a[done] = a[done] * pow(int(a[done, c]), -1, p) % p
        a[done + 1 :] = (a[done + 1 :] - a[done + 1 :, c : c + 1] * a[done] % p) % p
        done += 1
        if done == a.shape[0]:
            break
    return done


class Fit(NamedTuple):
    """n vectors, their sums of floor(SCALE * c), variances e from the largest on, vectors (a column each), all variances together."""

    n: int
    sums: list[int]
    e: np.ndarray
    vectors: np.ndarray
    trace: float
    rank: int

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n * y - sums, exactly: as int64 where that holds it and the sum of its squares, else as Python's integers."""
        most = (int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)) ** 2 * max(1, y.shape[1])
        kind = np.int64 if most < 1 << 63 else object
        return y.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Projections over the square root of their variance; NaN beyond the rank."""
        with np.errstate(invalid="ignore", divide="ignore"):
            root = np.where((np.arange(len(self.e)) < self.rank) & (self.e > 0), np.sqrt(self.e), np.nan)
        return (centred / self.n).astype(np.float64) @ self.vectors / root


def fitted(augmented: np.ndarray, components: int) -> Fit:
    """From the exact products of (y 1) with itself."""
    n, sums, g = int(augmented[-1, -1]), augmented[-1, :-1], augmented[:-1, :-1]
    about = g * n - sums[:, None] * sums[None, :]  # n * n times the covariance
    v = np.array([[int(x) / (n * n) for x in line] for line in about], np.float64)
    e, vectors = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    of_rank = max(rank(about, p) for p in primes(PRIME_LIMIT))
    trace = sum(int(about[i, i]) for i in range(len(about))) / (n * n)
    return Fit(n, [int(x) for x in sums], e[order], vectors[:, order], trace, of_rank)


def _check(dim: int, fit: Fit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(fit.e) + 1
        total = np.zeros((d, d))
        for batch in batches:
            w = fit.whitened(fit.centred(codes_of(kernel.column(batch, "code"), dim)))
            w = np.concatenate((np.nan_to_num(w), np.ones((len(w), 1))), 1)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["at", "value"])

    return run


def _project(dim: int, fit: Fit):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(fit.e)
        share = np.where((np.arange(many) < fit.rank) & (fit.e > 0), fit.e, 0.0) / fit.trace if fit.trace else None
        for batch in batches:
            centred = fit.centred(codes_of(kernel.column(batch, "code"), dim))
            w = fit.whitened(centred).ravel()
            squares = (centred * centred).sum(1)
            if squares.dtype == object:
                squares = pa.array([Decimal(x) if x < 10**38 else None for x in squares.tolist()], pa.decimal128(38, 0))
            else:
                squares = pa.array(squares).cast(pa.decimal128(38, 0))
            rows = len(centred)
            each = pa.array(np.repeat(np.arange(rows), many))
            explained = pa.nulls(rows * many, pa.float64()) if share is None else pa.array(np.tile(share, rows))
            yield pa.RecordBatch.from_arrays(
                [kernel.column(batch, "vec_id").take(each), pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), rows)), pa.array(np.full(rows * many, fit.n)), squares.take(each), pa.array(w, mask=np.isnan(w)), explained],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return run


def scatter(fit_list: DataFrame, dim: int, n: int, width: int) -> np.ndarray:
    """Exact products of (y 1) with itself over all vectors of one length; what reaches the driver depends on that length alone."""
    moduli = primes(2 * n << 2 * (8 * width - 1))
    parts = fit_list.mapInArrow(_scatter(dim, moduli), RESIDUES)
    tasks = min(len(moduli) * (dim + 1), 2 * fit_list.sparkSession.sparkContext.defaultParallelism)
    summed = parts.repartitionById(tasks, F.pmod(F.xxhash64("prime", "line"), F.lit(tasks)).cast("int")).mapInArrow(_add, RESIDUES).toArrow()
    by_prime = {p: np.zeros((dim + 1, dim + 1), np.int64) for p in moduli}
    for p, i, line in zip(*(summed[c].to_pylist() for c in ("prime", "line", "residues")), strict=True):
        by_prime[p][i] = line
    return remaindered(by_prime)


def identity_error(fit_list: DataFrame, dim: int, fit: Fit) -> float:
    """Largest entry of the whitened vectors' covariance minus the identity, over components within the rank."""
    d = len(fit.e) + 1
    total = np.zeros(d * d)
    for at, value in fit_list.mapInArrow(_check(dim, fit), "at long, value double").groupBy("at").agg(F.sum("value")).collect():  # d * d rows
        total[at] = value
    total = total.reshape(d, d) / fit.n
    some = np.flatnonzero((np.arange(d - 1) < fit.rank) & (fit.e > 0))
    off = total[:-1, :-1] - np.outer(total[-1, :-1], total[-1, :-1]) - np.eye(d - 1)
    return float(np.abs(off[np.ix_(some, some)]).max(initial=0.0))


def whiten(rows: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, embedding) whitened: a row for each vector and component, with the fit's error beside it."""
    spark: SparkSession = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    codes = frames.written(rows.mapInArrow(_code, CODED), "codes")
    distinct = frames.written(codes.select("dim", "code").distinct(), "distinct")
    lengths = distinct.where("dim > 0").groupBy("dim").agg(F.count("*").alias("n"), F.max(F.expr("length(code) div dim")).alias("width")).orderBy("dim").collect()  # a row for each length
    out = spark.createDataFrame([], f"{PROJECTED}, identity_error double")
    for dim, n, width in lengths:
        mine = distinct.where(F.col("dim") == dim).select("code")
        fit = fitted(scatter(mine, dim, n, width), components)
        error = identity_error(mine, dim, fit)
        out = out.union(codes.where(F.col("dim") == dim).mapInArrow(_project(dim, fit), PROJECTED).withColumn("identity_error", F.lit(error)))
    frames.drop(distinct)
    return out
