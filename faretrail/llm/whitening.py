"""Whitening of embeddings: blockwise QR, bidiagonal form, qd singular values, twisted factorisations."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faretrail.llm.common import Scratch, prepare

SCALE, OFFSET = 64, 1_000_000
EPS = np.finfo(np.float64).eps
#: Triangles that one task stacks and reduces to one.
FAN = 32
#: Rows of a block whose triangle is taken at once.
BLOCK_ROWS = 4096
#: Entries beyond this are no exact integers after scaling; their vectors are dropped.
LARGEST = float(1 << 52)


# ---------------------------------------------------------------------------
# Dense solver of one small triangle (driver; d x d whatever the corpus)
# ---------------------------------------------------------------------------


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, tau, alpha) with (I - tau v v^T) x = alpha e1 and v[0] = 1."""
    tail = float(np.linalg.norm(x[1:]))
    v = x.copy()
    if tail == 0.0:
        v[0] = 1.0
        return v, 0.0, float(x[0])
    alpha = -math.copysign(math.hypot(float(x[0]), tail), float(x[0]))
    v[1:] /= x[0] - alpha
    v[0] = 1.0
    return v, (alpha - float(x[0])) / alpha, alpha


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, w) with U^T r w upper bidiagonal: diagonal ``a``, above it ``b``.

    Householder reflections from the left clear columns, from the right rows;
    only the right ones are accumulated, into the orthogonal ``w``.
    """
    m = r.astype(np.float64).copy()
    d = len(m)
    w = np.eye(d)
    for k in range(d):
        v, tau, _ = _reflector(m[k:, k])
        m[k:, k:] -= tau * np.outer(v, v @ m[k:, k:])
        if k + 2 <= d - 1:
            v, tau, _ = _reflector(m[k, k + 1 :])
            m[k:, k + 1 :] -= tau * np.outer(m[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= tau * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), w


def _qd_step(q: list, e: list, shift: float) -> tuple[list, list, float]:
    """One differential quotient-difference transform; also its smallest d."""
    n = len(q)
    nq, ne = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    low = d
    for i in range(n - 1):
        nq[i] = d + e[i]
        ratio = q[i + 1] / nq[i] if nq[i] != 0.0 else math.inf
        ne[i] = e[i] * ratio
        d = d * ratio - shift
        if not d >= low:  # also for a NaN
            low = d
    nq[n - 1] = d
    return nq, ne, low


def squared_singular_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by dqds.

    The transforms work on the squares q, e. A shift that makes a d negative
    is refused and tried again smaller, at last with zero, so every transform
    made keeps high relative accuracy; what was shifted is added back. An e
    that no longer counts splits the array.
    """
    out: list[float] = []
    stack = [(0.0, [float(x) ** 2 for x in a], [float(x) ** 2 for x in b])]
    while stack:
        base, q, e = stack.pop()
        shift = 0.0
        rounds = 0
        while q:
            n = len(q)
            if n == 1:
                out.append(base + q[0])
                break
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= EPS * EPS * (base + q[i]) or e[i] <= EPS * EPS * q[i + 1]
                        or e[i] < 1e-300), None)
            if cut is not None:
                stack.append((base, q[cut + 1 :], e[cut + 1 :]))
                q, e = q[: cut + 1], e[:cut]
                shift = 0.0
                continue
            if q[0] < q[-1] and rounds % 16 == 0:  # graded the wrong way round
                q, e = _reversed(q, e)
            while True:
                nq, ne, low = _qd_step(q, e, shift)
                if low >= 0.0 and math.isfinite(low) or shift == 0.0:
                    break
                shift = shift / 4 if shift > EPS * (base + max(q)) else 0.0
            q, e, base = [max(x, 0.0) for x in nq], ne, base + shift
            # the next shift: the smaller value of the last two rows, or the smallest d if that is less
            half, det = (q[-2] + e[-1] + q[-1] + (e[-2] if n > 2 else 0.0)) / 2, q[-2] * q[-1]
            small = det / (half + math.sqrt(max(half * half - det, 0.0))) if half > 0 else 0.0
            shift = max(0.0, min(low, small)) * (1 - 4 * EPS)
            rounds += 1
            if rounds > 60 * n + 1000:
                raise ArithmeticError("qd iteration does not settle")
    return np.sort(np.array(out))[::-1]


def _reversed(q: list, e: list) -> tuple[list, list]:
    """The squares of a matrix with the same singular values: B^T is lower
    bidiagonal, and flipping its rows and columns gives an upper one."""
    return q[::-1], e[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, lam: float, rank: int = 0) -> tuple[np.ndarray, int]:
    """Eigenvector of B^T B for ``lam`` from the twisted factorisation whose
    twist has the ``rank``-th smallest remainder."""
    d, n = a * a, len(a)
    l = b / a[:-1]
    tiny = EPS * EPS * max(float(d.max()), 1e-300)
    s, up = np.empty(n), np.empty(n - 1)
    s[0] = -lam
    for i in range(n - 1):
        plus = s[i] + d[i]
        plus = plus if abs(plus) > tiny else tiny
        up[i] = d[i] * l[i] / plus
        s[i + 1] = up[i] * l[i] * s[i] - lam
    p, down = np.empty(n), np.empty(n - 1)
    p[-1] = d[-1] - lam
    for i in range(n - 2, -1, -1):
        minus = d[i] * l[i] * l[i] + p[i + 1]
        minus = minus if abs(minus) > tiny else tiny
        t = d[i] / minus
        down[i] = l[i] * t
        p[i] = p[i + 1] * t - lam
    gamma = s + p + lam
    r = int(np.argsort(np.abs(gamma), kind="stable")[min(rank, n - 1)])
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -down[i] * z[i]
    return z / np.linalg.norm(z), r


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Unit right singular vectors (columns) of the ``count`` largest values.

    The matrix splits where an off-diagonal entry is negligible; each vector
    lives in one part. Vectors of values closer than a thousandth of
    themselves are made orthogonal to each other; where nothing is left of
    one, the next twist is tried.
    """
    n = len(a)
    top = max(float(np.abs(a).max()), float(np.abs(b).max()) if n > 1 else 0.0)
    if top == 0.0:
        return np.eye(n)[:, :count]
    a, b = a / top, b / top
    a = np.where(np.abs(a) < EPS, EPS, a)
    cuts = [0, *[i + 1 for i in range(n - 1) if abs(b[i]) <= EPS * (abs(a[i]) + abs(a[i + 1]))], n]
    parts = []
    for lo, hi in zip(cuts, cuts[1:]):
        own = squared_singular_values(a[lo:hi], b[lo : hi - 1])
        parts += [(float(v), lo, hi) for v in own]
    parts.sort(key=lambda x: -x[0])
    out = np.zeros((n, count))
    for k, (lam, lo, hi) in enumerate(parts[:count]):
        near = [j for j in range(k) if parts[j][0] - lam <= 1e-3 * max(parts[j][0], EPS)]
        for rank in range(hi - lo):
            z = np.zeros(n)
            z[lo:hi] = _twisted(a[lo:hi], b[lo : hi - 1], lam, rank)[0] if hi - lo > 1 else 1.0
            for _ in range(2):
                for j in near:
                    z -= (out[:, j] @ z) * out[:, j]
            size = float(np.linalg.norm(z))
            if size > 0.1:
                break
        else:  # a part whose twists are used up: any direction left
            z = next(c for c in (v - out[:, :k] @ (out[:, :k].T @ v) for v in np.eye(n)) if np.linalg.norm(c) > 0.5 / math.sqrt(n))
            size = float(np.linalg.norm(z))
        out[:, k] = z / size
    return out


def directions(r: np.ndarray, n: int, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(variances, unit directions as columns, total variance) of ``count``
    leading components from the triangle of the centred rows."""
    a, b, w = bidiagonalise(r)
    values = squared_singular_values(a, b)
    z = right_vectors(a, b, values, count)
    vectors = w @ z
    vectors /= np.linalg.norm(vectors, axis=0)
    return values[:count] / n, vectors, float(math.fsum(values)) / n


# ---------------------------------------------------------------------------
# Spark stages
# ---------------------------------------------------------------------------


def scaled_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` with ``x``, the vector as whole numbers floor(64 c) + 1000000;
    rows whose vector is null, empty, or holds a null or non-finite entry go."""
    v = F.col(vector).cast("array<double>")
    usable = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST / SCALE))
    x = F.transform(v, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long") + F.lit(OFFSET).cast("long"))
    return rows.where(F.col(vector).isNotNull() & (F.size(v) > 0) & usable).withColumn("x", x)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column of length ``d`` as a matrix."""
    flat = column.flatten() if not isinstance(column, pa.ChunkedArray) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, dtype=object)
        for b in batches:
            n += b.num_rows
            total += _matrix(b.column(0), d).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d + 1), pa.int32()), pa.array([n, *[int(x) for x in total]], pa.decimal128(38, 0))], names=["i", "v"])

    return run


def _triangles(d: int, n: int, sums: list[int]):
    s = np.array(sums, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = np.zeros((0, d))
        for b in batches:
            rows = _centred(_matrix(b.column(0), d), n, s) / n
            for at in range(0, len(rows), BLOCK_ROWS):
                kept = np.linalg.qr(np.vstack([kept, rows[at : at + BLOCK_ROWS]]), mode="r")
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array([kept.ravel().tolist()], pa.list_(pa.float64()))], names=["r"])

    return run


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n x - S without rounding; whole numbers of any size where they may pass 64 bits."""
    if n * int(x.max(initial=0)) < 1 << 62:
        return x * n - s
    return x.astype(object) * n - s.astype(object)


def _stack(d: int):
    def run(table: pa.Table) -> pa.Table:
        flat = [np.array(r).reshape(-1, d) for r in table.column("r").to_pylist()]
        r = np.linalg.qr(np.vstack(flat), mode="r")
        return pa.table({"r": pa.array([r.ravel().tolist()], pa.list_(pa.float64()))})

    return run


def triangle(fit: DataFrame, d: int, n: int, sums: list[int], scratch: Scratch) -> np.ndarray:
    """R of the QR factorisation of all centred rows: each task reduces its
    rows block by block, then triangles are stacked ``FAN`` at a time."""
    level = scratch.keep(fit.select("x").mapInArrow(_triangles(d, n, sums), "r array<double>").withColumn(
        "at", F.monotonically_increasing_id()))
    while (left := level.count()) > 1:
        at = F.pmod(F.xxhash64("at"), F.lit(-(-left // FAN)))
        nxt = scratch.keep(level.select("r", at.alias("g")).groupBy("g").applyInArrow(_stack(d), "r array<double>").withColumn(
            "at", F.monotonically_increasing_id()))
        scratch.drop(level)
        level = nxt
    r = np.array(level.first()["r"]).reshape(-1, d)
    scratch.drop(level)
    return np.vstack([r, np.zeros((d - len(r), d))])


def _projector(n: int, sums: list[int], vectors: np.ndarray, scale: np.ndarray, explained: list[float]):
    s = np.array(sums, dtype=np.int64)
    d, k = vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = _centred(_matrix(b.column(1), d), n, s)
            white = (far / n).astype(np.float64) @ vectors * scale
            deviation = [sum(int(c) * int(c) for c in row) for row in far] if int(np.abs(far).max(initial=0)) ** 2 * d >= 1 << 62 else (
                far * far).sum(axis=1).tolist()
            m = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, n, dtype=np.int64)),
                    pa.array(np.repeat(np.array(deviation, dtype=np.int64), k)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(np.array(explained), m)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return run


def _moments(n: int, sums: list[int], vectors: np.ndarray, scale: np.ndarray):
    s = np.array(sums, dtype=np.int64)
    d, k = vectors.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k + k)
        for b in batches:
            white = (_centred(_matrix(b.column(0), d), n, s) / n).astype(np.float64) @ vectors * scale
            total += np.r_[(white.T @ white).ravel(), white.sum(axis=0)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    return run


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """Rows projected on the leading principal directions, with unit variance.

    Returns per row and component (from 1, by falling variance; all of them if
    the vectors are shorter than ``components``): ``vec_id, component, n``
    (distinct vectors), ``deviation`` (sum over dimensions of (n x - S)^2),
    ``whitened, explained, identity_error``.

    The directions are fitted on each distinct vector once. Per-task sums give
    n and S; the rows, centred exactly, become one triangle per task, and the
    triangles are reduced ``FAN`` at a time. Only d sums, one d x d triangle and
    the second moments of the components reach the driver, where the triangle
    is solved. Nothing depends on how rows are dealt but the last bits.

    Rows whose vector is null, empty or holds null or non-finite entries, or
    entries beyond 2^46, are dropped, as are vectors whose length is not the
    most frequent one of the table (the longer one of a tie). A null ``vec_id``
    is kept; repeated rows give results of their own and count once in the
    fit. A direction without variance (fewer distinct vectors than dimensions)
    has ``whitened`` 0 and is left out of ``identity_error``. An empty table
    gives no rows.
    """
    spark = rows.sparkSession
    prepare(spark)
    scratch = Scratch(spark, "whitening")
    known = scaled_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")), "v").select("vec_id", "x")
    kept = scratch.keep(known)
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        scratch.drop(kept)
        return spark.createDataFrame([], schema)
    d = lengths["d"]
    kept_d = kept.where(F.size("x") == d)
    fit = scratch.keep(kept_d.select("x").distinct())
    moments = fit.mapInArrow(_sums(d), "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    n, sums = int(moments[0]["v"]), [int(m["v"]) for m in moments[1:]]
    k = min(components, d)
    variances, vectors, total = directions(triangle(fit, d, n, sums, scratch), n, k)
    real = variances > total * d * EPS
    scale = np.where(real, 1.0 / np.sqrt(np.where(real, variances, 1.0)), 0.0)
    explained = [float(v) / total if total > 0 else 0.0 for v in variances]
    second = fit.mapInArrow(_moments(n, sums, vectors, scale), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([m["v"] for m in second]) / n
    mean = flat[k * k :]
    off = np.abs(flat[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k))
    error = float(off[np.ix_(real, real)].max(initial=0.0))
    out = kept_d.mapInArrow(_projector(n, sums, vectors, scale, explained), schema.rsplit(",", 1)[0])
    return scratch.result(out.withColumn("identity_error", F.lit(error)))
