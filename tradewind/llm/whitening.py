"""Whitening by Chebyshev-filtered subspace iteration.

The covariance V of the vectors is never formed. It is applied to a narrow block Q of ``width``
directions by a pass over all rows, which sums (x - mean) (x - mean)'Q; a task returns one matrix of
the size of Q. A round applies a Chebyshev polynomial of V to the block by its three-term recurrence, one
pass per degree. The polynomial stays small on the interval from 0 to the least Ritz value of the
block, where the unwanted spectrum lies, and grows fast above it. Then the block is made orthonormal
(QR) and one more pass gives the Rayleigh-Ritz pairs and their residuals |Vq - eq|. Rounds end when the residuals of
all wanted pairs are certified to be at most ``TOLERANCE`` of the largest eigenvalue. A round's degree is so small that directions
grow apart by ``GROWTH`` at most, which QR can still tell from rounding.

Components are taken as whole numbers, floor(scale * component) + offset. Their sums are exact, and so is
what is subtracted: the whole part of the mean as integers, the rest as a fraction. So a large offset costs no
digits. Passes read a table of blocks that was written once; what goes through the driver are matrices of
the number of components times ``width``.

Defined results: vectors that are NULL, empty or hold NULL, NaN or infinite components take no part.
All others must have the same number of components, or the job fails. Repeated rows count as rows, and a NULL
id stays NULL. Directions whose eigenvalue is rounding (at most ``RANK`` of the largest) cannot be whitened and are
left out, so fewer than ``components`` may come back, and none if all vectors are equal. A deviation that does
not fit 64 bits is NULL. An empty table gives no rows. Columns other than id and vector are not read.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.operators.storage import materialise

from .columns import whole_vectors

COMPONENTS = 32
DEGREE = 12
GROWTH = 1e10
TOLERANCE = 1e-13
RANK = 1e-11
ROUNDS = 100
ROWS = 2048  # of a block that are returned together


@dataclass
class Model:
    """``n`` vectors with ``sums`` per dimension; unit eigenvectors as columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float = 0.0  # the largest |Vq - eq| of the pairs over the largest eigenvalue
    passes: int = 0
    identity_error: float = 0.0

    @property
    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


class Centre:
    """x - sums / n, without loss."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum over the dimensions of (n * x - sum) ** 2 of each row."""
        away = x - self.whole
        most = max(abs(int(away.min(initial=0))), abs(int(away.max(initial=0)))) * self.n + self.n
        if most**2 * x.shape[1] < 2**63:
            return ((away * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = ((away.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1).tolist()
        return [v if v < 2**63 else None for v in exact]


def pack(vectors: DataFrame, id: str, vector: str, scale: float, offset: int) -> DataFrame:
    """A stored table of blocks: ids, the number of components, and the rows' whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            sizes = np.unique(lists.value_lengths().to_numpy(zero_copy_only=False))
            if len(sizes) > 1:
                raise ValueError(f"vectors have {sizes[0]} to {sizes[-1]} components")
            x = lists.flatten().to_numpy(zero_copy_only=False)
            kind = "<i4" if -(2**31) <= x.min() and x.max() < 2**31 else "<i8"
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            data = pa.array([x.astype(kind).tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array([int(sizes[0])], pa.int32()), data, pa.array([kind])], ["ids", "size", "data", "kind"])

    rows = whole_vectors(vectors, vector, scale, offset).select(F.col(id).cast("long").alias("id"), "x")
    return materialise(rows.mapInArrow(run, "ids array<long>, size int, data binary, kind string"), "whitening-blocks")


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The rows of each block, of batches that end in size, data and kind."""
    for batch in batches:
        sizes, data, kinds = (batch.column(batch.num_columns - i) for i in (3, 2, 1))
        for size, blob, kind in zip(sizes, data, kinds, strict=True):
            yield np.frombuffer(blob.as_buffer(), kind.as_py()).astype(np.int64).reshape(-1, size.as_py())


def _summed(blocks: DataFrame, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all blocks of a matrix of doubles. A task sends one matrix, and entries are summed in a shuffle."""

    def run(batches):
        total = np.zeros(shape)
        for x in _arrays(batches):
            total += of(x)
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.ravel()], pa.list_(pa.float64()))})

    parts = blocks.select("size", "data", "kind").mapInArrow(run, "part array<double>").select(F.posexplode("part"))
    sums = parts.groupBy("pos").agg(F.sum("col").alias("total")).toArrow()
    total = np.zeros(shape).ravel()
    total[sums.column("pos").to_numpy()] = sums.column("total").to_numpy()
    return total.reshape(shape)


def _sums(blocks: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches):
        for x in _arrays(batches):
            sums = x.sum(axis=0)
            yield pa.RecordBatch.from_pydict(
                {"at": pa.array(range(len(sums)), pa.int32()), "n": pa.array([len(x)] * len(sums), pa.int64()), "total": pa.array(sums)}
            )

    parts = blocks.select("size", "data", "kind").mapInArrow(run, "at int, n long, total long")
    total = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), total).orderBy("at").toArrow().to_pylist()
    if len({r["n"] for r in found}) > 1:
        raise ValueError("vectors have different numbers of components")
    return (found[0]["n"], [int(r["total"]) for r in found]) if found else (0, [])


def _filtered(apply: Callable[[np.ndarray], np.ndarray], block: np.ndarray, least: float, largest: float) -> np.ndarray:
    """The block under a Chebyshev polynomial that is small from 0 to ``least``, scaled to 1 at ``largest``."""
    half = centre = least / 2
    ratio = (largest - centre) / half
    degree = int(np.clip(np.arccosh(GROWTH) // np.arccosh(max(ratio, 1 + 1e-12)), 1, DEGREE))
    scale = first = half / (largest - centre)
    before, now = block, (apply(block) - centre * block) * (scale / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - scale)
        before, now = now, (apply(now) - centre * now) * (2 * after / half) - before * (scale * after)
        scale = after
    return now


def fit(blocks: DataFrame, components: int = COMPONENTS, seed: int = 0) -> Model:
    """The leading eigenvectors of the covariance of all rows."""
    n, sums = _sums(blocks)
    if not n:
        return Model(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    size, centre, passes = len(sums), Centre(n, sums), 0
    width = min(size, components + max(8, components // 2))

    def apply(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(x):
            y = centre.centred(x)
            return y.T @ (y @ block)

        return _summed(blocks, product, block.shape) / n

    trace = float(_summed(blocks, lambda x: (centre.centred(x) ** 2).sum(axis=0), (size,)).sum()) / n
    if trace == 0:
        return Model(n, sums, np.zeros((size, 0)), np.zeros(0), 0.0)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, width)))[0]
    for _ in range(ROUNDS):
        applied = apply(block)
        small = block.T @ applied
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, applied = block @ turn, applied @ turn
        wanted = values[:components] > RANK * values[0]
        residuals = np.linalg.norm(applied - block * values, axis=0)[: len(wanted)][wanted] / values[0]
        if residuals.max() <= TOLERANCE:
            kept = int(wanted.sum())
            return Model(n, sums, block[:, :kept], values[:kept], trace, float(residuals.max()), passes)
        block = np.linalg.qr(_filtered(apply, block, max(values[-1], 1e-14 * values[0]), values[0]))[0]
    raise RuntimeError(f"residual {residuals.max():.1e} after {ROUNDS} rounds")


def checked(model: Model, blocks: DataFrame) -> Model:
    """The model with ``identity_error``: how far the covariance of the whitened rows is from the identity."""
    kept = len(model.values)
    if kept:
        centre, weights = Centre(model.n, model.sums), model.weights

        def moments(x):
            z = centre.centred(x) @ weights
            return np.vstack([z.sum(axis=0), z.T @ z])

        found = _summed(blocks, moments, (kept + 1, kept)) / model.n
        model.identity_error = float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(kept)).max())
    return model


def whitened(model: Model, blocks: DataFrame, id: str = "vec_id") -> DataFrame:
    """A row for each row and component: id, component, n, deviation, whitened, explained, identity_error."""
    kept = len(model.values)
    centre = Centre(model.n, model.sums) if kept else None
    weights, explained = (model.weights, model.explained) if kept else (None, None)

    def run(batches):
        for batch in batches if kept else ():
            for ids, x in zip(batch.column(0), _arrays([batch]), strict=True):
                ids = ids.values
                for start in range(0, len(x), ROWS):
                    rows = x[start : start + ROWS]
                    place = np.repeat(np.arange(len(rows)), kept)
                    count = len(place)
                    columns = [
                        ids.slice(start, len(rows)).take(pa.array(place)),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(count, model.n, np.int64)),
                        pa.array(centre.deviations(rows), pa.int64()).take(pa.array(place)),
                        pa.array((centre.centred(rows) @ weights).ravel()),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array(np.full(count, model.identity_error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)

    names = [id, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"`{id}` long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return blocks.mapInArrow(run, schema)


def whiten(
    vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", scale: float = 64.0, offset: int = 1_000_000, components: int = COMPONENTS
) -> DataFrame:
    """Fit on all rows and whiten them."""
    blocks = pack(vectors, id, vector, scale, offset)
    return whitened(checked(fit(blocks, components), blocks), blocks, id)
