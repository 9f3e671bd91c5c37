"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Every entry becomes a whole number, floor(64 * entry) + 1 000 000. The rows are kept
once as blocks of whole numbers; column sums and squared deviations come from them
in exact integer arithmetic. The bidiagonalisation then alternates the products X v
and X' u with the centred rows X, a row's difference n * x - S being exact before
it becomes a double. A left vector u is as long as the table and never leaves the tasks: it
is X p for a short vector p, so one pass over the blocks forms X v for its block and
sends back X'(X v) at once. Left and right vectors are fully reorthogonalised, the
left ones through the same short vectors. Where the recurrence breaks off, at equal or
vanishing singular values, it goes on from a new direction orthogonal to all before.

After as many passes as there are dimensions the bidiagonal matrix is complete: its
singular value decomposition, of that small size, gives all components, equal ones
included, and their deviations. What comes to the driver is a vector of that length
in each pass, summed up in tasks and by key before.

Rows whose vector is null, or holds null or non-finite entries, are dropped; so are
vectors that have not the length that most vectors have (the smaller of two equally
frequent ones). Repeated rows and repeated ids count and return as often as they stand
there. Directions without deviation cannot be whitened and have no component; with no
deviation at all, or no row, the result is empty. Numbers that leave 64 bits are an
error, never a wrong result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlore.llm.shared import Scratch

COMPONENTS = 32
# Scale and offset of the whole numbers.
SCALE, OFFSET = 64, 1_000_000
# Bytes of whole numbers in one block.
BLOCK_BYTES = 1 << 19
# Singular values below this share of the largest are rounding.
RELATIVE_RANK = 1e-11
# Below this share a norm taken from X'X is too coarse, and X is applied again.
COARSE = 1e-4
# The largest whole number: a block's column sum then fits in 64 bits.
LARGEST = 1 << 40

BLOCKS = "ids binary, known binary, x binary"


def _valid(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """``(vec_id, x)``: whole numbers of the vectors that count."""
    infinite = F.lit(float("inf"))
    sound = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < infinite))
    kept = vectors.where(F.col(column).isNotNull() & F.coalesce(sound, F.lit(False)))
    whole = F.transform(column, lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)
    return kept.select(F.col(id_column).cast("bigint").alias("vec_id"), whole.alias("x"))


def _dimension(rows: DataFrame) -> int:
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    commonest = sizes.orderBy(F.desc("n"), "size").first()
    return commonest["size"] if commonest else 0


def _pack(dim: int, block_bytes: int):
    """Rows as blocks: ids, whether each is known, and the numbers row by row."""
    rows = max(1, block_bytes // (8 * dim))

    def run(batches):
        for batch in batches:
            ids = batch["vec_id"]
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, dim)
            if np.abs(x).max(initial=0) > LARGEST:
                raise OverflowError(f"An entry is beyond {LARGEST // SCALE}")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            for at in range(0, len(x), rows):
                part = slice(at, at + rows)
                values = [numbers[part].tobytes()], [known[part].tobytes()], [x[part].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()) for v in values], ["ids", "known", "x"])

    return run


def _matrices(batch, dim):
    return (np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dim) for x in batch["x"])


def _summed(blocks: DataFrame, run, kind: str, largest_at: int = -1) -> dict[int, object]:
    """Sums by position of the vectors that ``run`` returns, one a task; at one place the largest value."""
    sent = blocks.mapInArrow(run, f"at int, value {kind}")
    value = F.when(F.col("at") == largest_at, F.max("value")).otherwise(F.sum("value")).alias("value")
    return {r["at"]: r["value"] for r in sent.groupBy("at").agg(value).collect()}


def _vector(values, kind):
    return pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, kind)], ["at", "value"])


@dataclass(frozen=True)
class Centre:
    """Length, number and column sums of the rows."""

    dim: int
    n: int
    sums: np.ndarray

    def apart(self, x: np.ndarray) -> np.ndarray:
        return self.n * x - self.sums

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x) / float(self.n)


def _product(blocks: DataFrame, centre: Centre, v: np.ndarray) -> np.ndarray:
    """X'(X v), each block's X v being formed and used up in its task."""

    def run(batches):
        total = np.zeros(centre.dim)
        for batch in batches:
            for x in _matrices(batch, centre.dim):
                rows = centre.rows(x)
                total += rows.T @ (rows @ v)
        yield _vector(total, pa.float64())

    found = _summed(blocks.select("x"), run, "double")
    return np.array([found.get(i, 0.0) for i in range(centre.dim)])


def _rows(work: Scratch, vectors: DataFrame, id_column: str, column: str, block_bytes: int) -> tuple[DataFrame, Centre] | None:
    valid = _valid(vectors, id_column, column)
    dim = _dimension(valid)
    if dim == 0:
        return None
    blocks = work.write(valid.where(F.size("x") == dim).mapInArrow(_pack(dim, block_bytes), BLOCKS), "blocks")

    def sums(batches):
        # Sums of blocks fit; Python adds them up without a bound.
        totals, largest = [0] * (dim + 1), 0
        for batch in batches:
            for x in _matrices(batch, dim):
                totals = [a + int(b) for a, b in zip(totals, [*x.sum(axis=0), len(x)], strict=True)]
                largest = max(largest, int(np.abs(x).max(initial=0)))
        yield _vector([*totals, largest], pa.int64())

    found = _summed(blocks.select("x"), sums, "bigint", dim + 1)
    if found[dim] * found[dim + 1] >= 1 << 62:
        raise OverflowError("n * x does not fit in 64 bits")
    return blocks, Centre(dim, found[dim], np.array([found[i] for i in range(dim)], np.int64))


@dataclass(frozen=True)
class Bidiagonal:
    """X V = U B with B upper bidiagonal: ``right`` holds the columns of V."""

    right: np.ndarray
    diagonal: np.ndarray
    above: np.ndarray

    def components(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Unit components as columns and their variances, largest first, those of rounding left out."""
        matrix = np.diag(self.diagonal) + np.diag(self.above[: len(self.diagonal) - 1], 1)
        _, values, turned = np.linalg.svd(matrix)
        kept = values > RELATIVE_RANK * values[0] if len(values) and values[0] > 0 else np.zeros(len(values), bool)
        return (self.right @ turned.T)[:, kept], (values[kept] ** 2) / n


def _orthogonal(vector: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    """Without its parts along ``to``; twice, which is enough."""
    for _ in range(2):
        for other in to:
            vector = vector - (other @ vector) * other
    return vector


def bidiagonalise(product, dim: int, seed: int = 1) -> Bidiagonal:
    """Golub-Kahan-Lanczos over ``product(v) = X'(X v)``, to the full dimension.

    A left vector u = X p is held as p, and as z = X'u; u_i'u_j is p_i'z_j. Each
    step is one call of ``product``, and two more where X p nearly vanishes.
    """

    def clear(short, z):
        for p, pz in lefts:
            along = p @ z
            short, z = short - along * p, z - along * pz
        return short, z

    pick = np.random.default_rng(seed)
    rights: list[np.ndarray] = []
    lefts: list[tuple[np.ndarray, np.ndarray]] = []
    diagonal, above = [], []
    right, beta, largest = None, 0.0, 0.0
    while len(rights) < dim:
        if right is None:
            right = _orthogonal(pick.standard_normal(dim), rights)
            right /= np.linalg.norm(right)
            right, beta = _orthogonal(right, rights), 0.0
            right /= np.linalg.norm(right)
        rights.append(right)
        # X v, without its parts along all left vectors. The part along the last one is beta.
        short, z = clear(*clear(right, product(right)))
        alpha = np.sqrt(max(0.0, float(short @ z)))
        largest = max(largest, alpha, beta)
        if 0 < largest and alpha < COARSE * largest:
            short, _ = clear(short, product(short))
            z = product(short)
            alpha = np.sqrt(max(0.0, float(short @ z)))
        diagonal.append(alpha)
        above.append(0.0)
        if len(above) > 1:
            above[-2] = beta
        if alpha <= RELATIVE_RANK * largest or alpha == 0.0:
            # The direction adds no left vector.
            diagonal[-1], right = 0.0, None
            continue
        lefts.append((short / alpha, z / alpha))
        rest = _orthogonal(z / alpha - alpha * right, rights)
        beta = float(np.linalg.norm(rest))
        right = rest / beta if beta > RELATIVE_RANK * largest else None
    return Bidiagonal(np.array(rights).T.reshape(dim, -1), np.array(diagonal), np.array(above))


def _identity_error(blocks: DataFrame, centre: Centre, scaled: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity."""
    count = scaled.shape[1]

    def run(batches):
        total, products = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            for x in _matrices(batch, centre.dim):
                found = centre.rows(x) @ scaled
                total += found.sum(axis=0)
                products += found.T @ found
        yield _vector(np.concatenate([total, products.ravel()]), pa.float64())

    found = _summed(blocks.select("x"), run, "double")
    values = np.array([found[i] for i in range(count + count * count)]) / centre.n
    mean, second = values[:count], values[count:].reshape(count, count)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(count)).max())


def _deviations(apart: np.ndarray) -> list[int]:
    """Sums of squares of the rows' differences n * x - S, exact."""
    if (apart.astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
        return (apart * apart).sum(axis=1).tolist()
    return [sum(int(v) ** 2 for v in row) for row in apart]


COLUMNS = "vec_id component n deviation whitened explained identity_error".split()
RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, "
    "whitened double, explained double, identity_error double"
)


def whiten_embeddings(
    vectors: DataFrame,
    components: int = COMPONENTS,
    id_column: str = "vec_id",
    column: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for every remaining row of ``vectors`` and every component, up to ``components`` of them.

    ``vec_id, component, n, deviation, whitened, explained, identity_error``: the
    component's number from 1 by falling variance, the number of rows, the exact sum of
    squares of n * x - S, the coordinate divided by the component's standard
    deviation, the component's share of all variance, and how far the whitened
    rows' covariance is from the identity.
    """
    spark = vectors.sparkSession
    work = Scratch(spark, "whitening")
    found = _rows(work, vectors, id_column, column, block_bytes)
    if found is None:
        return spark.createDataFrame([], RESULT)
    blocks, centre = found
    form = bidiagonalise(partial(_product, blocks, centre), centre.dim)
    axes, variances = form.components(centre.n)
    explained = (variances / variances.sum())[:components]
    scaled = (axes / np.sqrt(variances))[:, :components]
    count = scaled.shape[1]
    if count == 0:
        return spark.createDataFrame([], RESULT)
    error = _identity_error(blocks, centre, scaled)

    def run(batches):
        for batch in batches:
            for ids, known, x in zip(batch["ids"], batch["known"], _matrices(batch, centre.dim), strict=True):
                size, apart = len(x), centre.apart(x)
                numbers = np.repeat(np.frombuffer(ids.as_buffer(), "<i8"), count)
                missing = np.repeat(~np.frombuffer(known.as_buffer(), bool), count)
                deviations = pa.array(_deviations(apart), pa.int64())
                columns = [
                    pa.array(numbers, pa.int64(), mask=missing),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)),
                    pa.array(np.full(size * count, centre.n)),
                    deviations.take(pa.array(np.repeat(np.arange(size), count))),
                    pa.array((centre.rows(x) @ scaled).ravel()),
                    pa.array(np.tile(explained, size)),
                    pa.array(np.full(size * count, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, COLUMNS)

    return blocks.mapInArrow(run, RESULT)
