"""Whitening of embeddings on their leading components, found by spectrum slicing.

Three passes over the vectors gather only sums: counts and exact integer sums, the centred products that make the
covariance, and the same of the whitened values, which measures the error. The eigenvalues of the covariance (one matrix, its size
is that of a vector squared) are isolated by inertia counts: the signs of the pivots in LDL' of the shifted matrix tell how many
eigenvalues lie above the shift. Rayleigh quotient iteration then converges within each isolated interval, and two more counts
certify that the pair found is the k-th one. A last pass projects every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: grid of the integer vectors; fixed values of the data format
SCALE, SHIFT = 1024, 100_000
#: entries beyond this are held at it, so that differences stay within a long
FARTHEST = 1 << 60
#: most bisections for one eigenvalue, and steps of one iteration
BISECTIONS, STEPS = 200, 30
#: threshold of Bunch and Parlett for a pivot on the diagonal
ON_DIAGONAL = (1 + 17 ** 0.5) / 8
#: values of a batch that are worked on at once
VALUES = 1 << 20


# ---- the spectrum of one symmetric matrix


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: positive pivots of P(A - shift)P' = LDL'.

    Pivots are chosen from the whole remainder, of order one or two; one of order two always has a positive and a negative side.
    """
    a = matrix - shift * np.eye(len(matrix))
    count = 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal()
        p = int(diagonal.argmax())
        off = size - np.diag(diagonal)
        q, r = divmod(int(off.argmax()), len(a))
        if diagonal[p] >= ON_DIAGONAL * off[q, r]:
            if diagonal[p] == 0:
                break
            count += a[p, p] > 0
            rest = np.arange(len(a)) != p
            column = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[p, p])
        else:
            count += 1
            both = [q, r]
            rest = np.ones(len(a), bool)
            rest[both] = False
            columns = a[np.ix_(rest, both)]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_(both, both)], columns.T)
        a = (a + a.T) / 2
    return int(count)


def refined(matrix: np.ndarray, low: float, high: float, others: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from within (low, high), at right angles to the vectors found before: (value, unit vector)."""
    rng = np.random.default_rng(len(others))
    vector = rng.standard_normal(len(matrix))
    value = (low + high) / 2
    identity = np.eye(len(matrix))
    best = (np.inf, value, vector / np.linalg.norm(vector))
    for step in range(STEPS):
        vector = vector - others.T @ (others @ vector)
        vector /= np.linalg.norm(vector)
        if step > 1:  # two steps with the middle of the interval lead to the pair nearest to it
            value = float(vector @ matrix @ vector)
        error = float(np.linalg.norm(matrix @ vector - (vector @ matrix @ vector) * vector))
        if error < best[0]:
            best = (error, float(vector @ matrix @ vector), vector)
        elif step > 3 and best[0] <= 64 * np.finfo(float).eps * scale:
            break
        try:
            solved = np.linalg.solve(matrix - value * identity, vector)
        except np.linalg.LinAlgError:
            solved = np.linalg.solve(matrix - (value + np.finfo(float).eps * scale) * identity, vector)
        if not np.isfinite(solved).all():
            break
        vector = solved / np.abs(solved).max()
    return best[1], best[2]


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest eigenvalues, falling, and their unit eigenvectors as rows.

    Equal eigenvalues (closer than rounding tells apart) get any orthonormal vectors of their common space.
    """
    n = len(matrix)
    k = min(k, n)
    scale = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
    values, vectors = np.zeros(k), np.zeros((0, n))
    if scale == 0:
        return values, np.eye(n)[:k]
    blur = 64 * n * np.finfo(float).eps * scale
    counts: dict[float, int] = {-2 * scale: n, 2 * scale: 0}  # every eigenvalue lies within the greatest absolute row sum

    def count(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(matrix, shift)
        return counts[shift]

    for i in range(k):
        low = max(s for s, c in counts.items() if c > i)
        high = min(s for s, c in counts.items() if c <= i)
        for _ in range(BISECTIONS):
            alone = counts[low] == i + 1 and counts[high] == i
            if alone or high - low <= blur:
                value, vector = refined(matrix, low, high, vectors, scale)
                # the counts around the value certify its number, unless equal values leave it open
                close = high - low <= blur
                if low - blur <= value <= high + blur and (close or count(value - blur) > i >= count(value + blur)):
                    break
                if close:
                    raise ArithmeticError("no eigenvector was found in an isolated interval")
            middle = (low + high) / 2
            low, high = (middle, high) if count(middle) > i else (low, middle)
        else:
            raise ArithmeticError("an eigenvalue could not be isolated")
        values[i] = value
        vectors = np.vstack((vectors, vector))
    return values, vectors


# ---- passes over the vectors


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` learns: all of it has the size of a vector or of its square.

    n: vectors; sums: exact sums of the integer vectors; values, vectors: leading eigenvalues (falling) and unit eigenvectors as rows;
    trace: of the covariance; identity_error: largest absolute entry of the whitened values' covariance minus the identity.
    """

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    @property
    def floor(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """The mean minus ``floor``."""
        return np.array([(s % self.n) / self.n for s in self.sums])

    @property
    def usable(self) -> np.ndarray:
        """Whether a component has any spread, beyond rounding."""
        return self.values > 64 * len(self.sums) * np.finfo(float).eps * max(self.trace, 0)


def usable_rows(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null and holds finite numbers only; of the vectors left, those of the commonest length.

    Empty vectors take no part. Of lengths equally common the greater one is taken.
    """
    finite = vectors.where(vectors[vector].isNotNull()).where(F.size(vector) > 0).where(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    lengths = finite.groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(2).collect()
    return finite.where(F.size(vector) == lengths[0]["length"]) if len(lengths) > 1 else finite


def integers(batch: pa.RecordBatch, vector: str) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integer vectors as rows) for bounded parts of a batch."""
    lists = batch.column(batch.schema.get_field_index(vector))
    if not len(lists):
        return
    width = len(lists[0])
    step = max(1, VALUES // width)
    for start in range(0, len(lists), step):
        values = lists.slice(start, step).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore"):
            grid = np.clip(np.floor(SCALE * values), -FARTHEST, FARTHEST).astype(np.int64) + SHIFT
        yield start, grid.reshape(-1, width)


def summed(partial: DataFrame) -> dict[tuple[int, int], float]:
    """The sums of partial results (i, j, value) over all partitions; their number is that of a matrix's entries."""
    return {(r.i, r.j): r.value for r in partial.groupBy("i", "j").agg(F.sum("value").alias("value")).collect()}


def exact_sums(rows: DataFrame, vector: str) -> tuple[int, tuple[int, ...]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for _, grid in integers(batch, vector):
                n += len(grid)
                # halves of 32 bits cannot overflow in a part of bounded size
                own = [(h << 32) + low for h, low in zip((grid >> 32).sum(axis=0).tolist(), (grid & 0xFFFFFFFF).sum(axis=0).tolist(), strict=True)]
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            values = [Decimal(v) for v in (n, *total)]
            places = pa.array(range(-1, len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array([0] * len(values), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "j", "value"])

    found = summed(rows.select(vector).mapInArrow(run, "i int, j int, value decimal(38,0)"))
    return int(found.pop((-1, 0), 0)), tuple(int(found[k]) for k in sorted(found))


def products(rows: DataFrame, vector: str, floor: np.ndarray, rest: np.ndarray, onto: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(sums, sums of products) of the centred vectors, or of their projections on the columns of ``onto``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, grid in integers(batch, vector):
                centred = (grid - floor) - rest
                if onto is not None:
                    centred = centred @ onto
                own = np.vstack((centred.T @ centred, centred.sum(axis=0)))
                total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape).reshape(2, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "value"])

    found = summed(rows.select(vector).mapInArrow(run, "i int, j int, value double"))
    size = len(rest) if onto is None else onto.shape[1]
    whole = np.zeros((size + 1, size))
    for (i, j), value in found.items():
        whole[i, j] = value
    return whole[-1], whole[:-1]


def covariance(n: int, sums: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Divisor n; ``sums`` are what rounding leaves of the centred values."""
    found = squares / n - np.outer(sums / n, sums / n)
    return (found + found.T) / 2


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """The whitening of the integer vectors x = floor(1024 c) + 100000, or None if no vector takes part (see ``usable_rows``).

    Every usable vector is read, repeated ones as often as they occur. Fewer dimensions than ``components`` give that many components.
    """
    rows = usable_rows(vectors, vector)
    n, sums = exact_sums(rows, vector)
    if not n:
        return None
    draft = Whitening(n, sums, np.zeros(0), np.zeros((0, len(sums))), 0.0, 0.0)
    matrix = covariance(n, *products(rows, vector, draft.floor, draft.rest))
    values, axes = leading(matrix, components)
    found = Whitening(n, sums, values, axes, float(np.trace(matrix)), 0.0)
    onto = projection(found)[:, found.usable]
    error = 0.0
    if onto.shape[1]:
        error = float(np.abs(covariance(n, *products(rows, vector, found.floor, found.rest, onto)) - np.eye(onto.shape[1])).max())
    return Whitening(n, sums, values, axes, found.trace, error)


def projection(found: Whitening) -> np.ndarray:
    """Columns that take a centred vector to its whitened values; zero for components without spread."""
    scale = np.where(found.usable, np.sqrt(np.where(found.usable, found.values, 1)), np.inf)
    return (found.vectors / scale[:, None]).T


def deviations(grid: np.ndarray, found: Whitening) -> list[int]:
    """Exact sums over the dimensions of (n x - S)^2."""
    n, floor = found.n, found.floor
    rest = np.array([s % n for s in found.sums], np.int64)
    away = grid - floor
    most = int(np.abs(away).max(initial=0)) + 1
    if (n * most) ** 2 * grid.shape[1] < 1 << 63:
        own = n * away - rest
        return (own * own).sum(axis=1).tolist()
    return [sum((n * a - r) ** 2 for a, r in zip(row, rest.tolist(), strict=True)) for row in away.tolist()]


def transform(vectors: DataFrame, found: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per usable row and component (from 1): ``key``, component, n, deviation, deviation_digits, whitened, explained, identity_error.

    ``deviation`` is the exact sum of (n x - S)^2 as a long, null where it exceeds one; ``deviation_digits`` holds it as text always.
    A component without spread (all vectors equal in its direction) has a null ``whitened`` and takes no part in the error. A null
    key is kept, repeated rows are projected like any other, no usable vector gives no rows. Other columns are not read.
    """
    kind = vectors.schema[key].dataType
    ddl = "component int, n long, deviation long, deviation_digits string, whitened double, explained double, identity_error double"
    schema = T.StructType([T.StructField(key, kind), *T.StructType.fromDDL(ddl)])
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    rows = usable_rows(vectors.select(vectors[key].alias("own_key"), vectors[vector].alias("own_vector")), "own_vector")
    floor, rest, onto, k = found.floor, found.rest, projection(found), len(found.values)
    usable = found.usable
    explained = found.values / found.trace if found.trace > 0 else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, grid in integers(batch, "own_vector"):
                m = len(grid)
                white = (((grid - floor) - rest) @ onto).ravel()
                exact = deviations(grid, found)
                longs = [d if d < 1 << 63 else None for d in exact]
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(start, m).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, found.n, np.int64)),
                    pa.array(longs, pa.int64()).take(each), pa.array([str(d) for d in exact], pa.string()).take(each),
                    pa.array(white, mask=np.tile(~usable, m)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, found.identity_error))], schema.fieldNames())

    return rows.select("own_key", "own_vector").mapInArrow(run, schema)
