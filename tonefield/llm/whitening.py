"""Whitening of embeddings along their leading components, found by a matrix-free block Lanczos iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: A component has converged when its residual is under this share of the largest eigenvalue.
TOLERANCE = 1e-12
#: A direction that loses all but this share of its length to the basis has broken down.
BROKEN = 1e-10
#: An eigenvalue under this share of the largest is none: there is nothing to whiten.
NULL_SHARE = 1e-9
#: Columns of the basis at most, in blocks, and passes over the data at most.
BASIS, PASSES = 12, 500
#: Vectors that a task multiplies at once.
ROWS = 4096


def usable(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows with a vector of finite entries, x as whole numbers; of the commonest length, if there are several.

    An entry beyond the range of a long ends the job with an overflow.
    """
    v = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    good = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False)) & (F.size(v) > 0)
    rows = rows.where(good).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (length["d"] if length else 0))


def matrix(column: pa.ListArray, at: int) -> np.ndarray:
    part = column.slice(at, ROWS)
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def summed(rows: DataFrame, column: str, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of of(block) over all blocks of rows. Tasks give one matrix each; those are added by cell before the driver gets them."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                one = of(matrix(b.column(0), at))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["part"])

    each = rows.select(column).mapInArrow(parts, "part array<double>").select(F.posexplode("part").alias("cell", "y"))
    out = np.zeros(shape)
    for r in each.groupBy("cell").agg(F.sum("y").alias("y")).collect():
        out.ravel()[r["cell"]] = r["y"]
    return out


def fresh(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthonormal block orthogonal to the basis, from the columns of block; those that broke down are begun again at random."""
    room = len(basis) - basis.shape[1]
    out = basis[:, :0]
    for column in block.T[:room]:
        while True:
            size = np.linalg.norm(column)
            left = column.copy()
            for _ in range(3):  # full reorthogonalisation, more than once so that rounding leaves nothing
                left -= basis @ (basis.T @ left)
                left -= out @ (out.T @ left)
            if size > 0 and np.linalg.norm(left) > BROKEN * size:
                break
            column = rng.normal(size=len(column))
        out = np.column_stack([out, left / np.linalg.norm(left)])
    return out


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int | None = None, seed: int = 13) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, vectors, passes): the k largest eigenpairs of the symmetric matrix that `times` multiplies blocks by.

    The basis grows by a block a pass; its image is kept, so that values, vectors and residuals come from one small
    matrix. It ends when every wanted residual is small, or when the basis spans the whole space. A basis of BASIS
    blocks is cut to its best vectors (a thick restart).
    """
    rng = np.random.default_rng(seed)
    k = min(k, d)
    block = min(block or k, d)
    most = max(BASIS * block, 3 * k)
    basis = image = np.zeros((d, 0))
    new = fresh(rng.normal(size=(d, block)), basis, rng)
    for passes in range(1, PASSES + 1):
        basis, image = np.column_stack([basis, new]), np.column_stack([image, times(new)])
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors, images = basis @ turn[:, :k], image @ turn[:, :k]
        residuals = images - vectors * values[:k]
        sizes = np.linalg.norm(residuals, axis=0)
        if basis.shape[1] == d or basis.shape[1] >= k and (sizes <= TOLERANCE * max(values[0], 1e-300)).all():
            return values[:k], vectors, passes
        if basis.shape[1] + block > most:
            keep = min(k + block, basis.shape[1])
            basis, image = basis @ turn[:, :keep], image @ turn[:, :keep]
            new = fresh(residuals[:, np.argsort(-sizes)[:block]], basis, rng)
        else:
            new = fresh(image[:, -new.shape[1] :], basis, rng)
    raise RuntimeError(f"the components did not converge in {PASSES} passes")


def fitted(x: DataFrame, components: int = COMPONENTS) -> dict | None:
    """What whitens: n, sums S, values, vectors and shares of the components, passes and the largest error against the identity.

    The fit list is each different vector once, written to the shared folder and read once a pass: centred as
    (n * x - S) / n, exact until the division, so no digits are lost to the mean. None if there is no vector.
    """
    some = stored(x.select("x").distinct(), "fit-list")
    n = some.count()
    if not n:
        return None
    sums = some.select(F.posexplode("x").alias("j", "c")).groupBy("j").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s")).collect()
    s = np.array([int(r["s"]) for r in sorted(sums, key=lambda r: r["j"])], np.int64)
    d = len(s)
    centred = lambda a: (n * a - s) / n

    def times(q: np.ndarray) -> np.ndarray:
        def of(a: np.ndarray) -> np.ndarray:
            c = centred(a)
            return c.T @ (c @ q)

        return summed(some, "x", of, q.shape) / n

    squares = some.select(deviation(n, s).cast("decimal(38,0)").alias("q")).agg(F.sum("q")).first()[0]
    trace = int(squares) / n**3
    values, vectors, passes = lanczos(times, d, components)
    wide = (values > 0) & (values > NULL_SHARE * max(values[0], 0))
    values, vectors = values[wide], vectors[:, wide]
    to = vectors / np.sqrt(values)

    def products(a: np.ndarray) -> np.ndarray:
        w = centred(a) @ to
        return w.T @ w

    k = len(values)
    error = float(np.abs(summed(some, "x", products, (k, k)) / n - np.eye(k)).max()) if k else 0.0
    return {"n": n, "sums": s, "values": values, "vectors": vectors, "explained": values / trace if k else values, "passes": passes, "identity_error": error}


def deviation(n: int, s: np.ndarray):
    """The sum of (n * x - S)^2 over the dimensions, exact; beyond the range of a long it ends the job."""
    sums = F.split(F.lit(",".join(map(str, s))), ",").cast("array<long>")
    parts = F.zip_with("x", sums, lambda a, b: (F.lit(n).cast("long") * a - b) * (F.lit(n).cast("long") * a - b))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda t, y: t + y)


def whitened(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each usable row and component.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out, and those of another than the
    commonest length. Rows with a null id and repeated rows come out like others, and count once in the fit. Fewer
    components come out where vectors have fewer dimensions or vary in fewer; none where all are equal, or for an
    empty table. Components are numbered by falling eigenvalue, ties in the order they were found. Other columns
    play no part.
    """
    x = usable(rows, id_col, vec_col)
    found = fitted(x, components)
    schema = f"vec_id {dict(x.dtypes)['vec_id']}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None or not len(found["values"]):
        return rows.sparkSession.createDataFrame([], schema)
    n, s, shares, error = found["n"], found["sums"], found["explained"], found["identity_error"]
    to = found["vectors"] / np.sqrt(found["values"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                w = (n * matrix(b.column(2), at) - s) / n @ to
                each = pa.array(at + np.repeat(np.arange(len(w)), len(shares)))
                ids, squares = b.column(0).take(each), b.column(1).take(each)
                m = w.size
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, len(shares) + 1, dtype=np.int32), len(w))), pa.array(np.full(m, n)), squares, pa.array(w.ravel()), pa.array(np.tile(shares, len(w))), pa.array(np.full(m, error))], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.select("vec_id", deviation(n, s).alias("deviation"), "x").mapInArrow(of, schema)
