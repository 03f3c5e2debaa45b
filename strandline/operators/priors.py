"""Prior precisions of stacked component means, as matrices and as sparse DataFrames.

Component k's mean occupies rows (k-1)*d+1 .. k*d. Both priors couple near components only, so above DENSE rows they are held as
block bands, whose systems are solved in time and memory linear in the number of components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Rows up to which a prior is a plain matrix, unless asked for otherwise.
DENSE = 200


@dataclass
class Banded:
    """A symmetric matrix as block tridiagonal: diagonal blocks (m, b, b), and the blocks below them (m - 1, b, b).

    A last block that isn't full is padded by ones on the diagonal, which change neither solutions nor determinants.
    """

    size: int
    diagonal: np.ndarray
    below: np.ndarray

    @classmethod
    def zeros(cls, size: int, block: int) -> Banded:
        m = -(-size // block)
        out = cls(size, np.zeros((m, block, block)), np.zeros((max(0, m - 1), block, block)))
        for i in range(size, m * block):
            out.diagonal[i // block, i % block, i % block] = 1
        return out

    def add(self, at: int, values: np.ndarray) -> None:
        """Add a small symmetric matrix at rows and columns from ``at`` on."""
        b, rows = self.diagonal.shape[1], at + np.arange(len(values))
        r, c = np.repeat(rows, len(rows)), np.tile(rows, len(rows))
        down, v = r // b - c // b, values.ravel()
        if v[np.abs(down) > 1].any():
            raise ValueError("the matrix reaches beyond the band")
        for blocks, use in ((self.diagonal, down == 0), (self.below, down == 1)):
            blocks[c[use] // b, r[use] % b, c[use] % b] += v[use]

    def __matmul__(self, u: np.ndarray) -> np.ndarray:
        v = self._padded(u)
        out = np.einsum("mij,mj->mi", self.diagonal, v)
        out[1:] += np.einsum("mij,mj->mi", self.below, v[:-1])
        out[:-1] += np.einsum("mji,mj->mi", self.below, v[1:])
        return out.ravel()[: self.size]

    def _padded(self, u: np.ndarray) -> np.ndarray:
        m, b = self.diagonal.shape[:2]
        return np.concatenate([np.asarray(u, float), np.zeros(m * b - self.size)]).reshape(m, b)

    def factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Block Cholesky: lower triangles of the diagonal blocks, and the blocks below."""
        low, side = np.empty_like(self.diagonal), np.empty_like(self.below)
        for i in range(len(self.diagonal)):
            d = self.diagonal[i] - (side[i - 1] @ side[i - 1].T if i else 0)
            low[i] = np.linalg.cholesky(d)
            if i < len(side):
                side[i] = np.linalg.solve(low[i], self.below[i].T).T
        return low, side

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        low, side = self.factors()
        y = self._padded(rhs)
        for i in range(len(y)):
            y[i] = np.linalg.solve(low[i], y[i] - (side[i - 1] @ y[i - 1] if i else 0))
        for i in range(len(y) - 1, -1, -1):
            y[i] = np.linalg.solve(low[i].T, y[i] - (side[i].T @ y[i + 1] if i < len(side) else 0))
        return y.ravel()[: self.size]

    def log_det(self) -> float:
        return float(2 * np.log(np.diagonal(self.factors()[0], axis1=1, axis2=2)).sum())

    def entries(self) -> list[tuple[int, int, float]]:
        b, out = self.diagonal.shape[1], []
        for blocks, down in ((self.diagonal, 0), (self.below, 1)):
            for m, i, j in np.argwhere(blocks != 0).tolist():
                r, c, v = (m + down) * b + i, m * b + j, float(blocks[m, i, j])
                if r < self.size:
                    out += [(r, c, v)] + [(c, r, v)] * down
        return sorted(out)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.size, self.size))
        for i, j, v in self.entries():
            out[i, j] = v
        return out


def random_walk(k: int, d: int, order: int = 1, strength: float = 1.0, ridge: float = 1e-6, banded: bool | None = None) -> np.ndarray | Banded:
    """Precision of a random walk of the given order: strength * (D'D + ridge I) on components, the same for each dimension."""
    if not 1 <= order < k:
        raise ValueError(f"the order must be from 1 to {k - 1}")
    step = np.diff(np.eye(order + 1), n=order, axis=0)[0]  # one difference
    if banded is None:
        banded = k * d > DENSE
    out = Banded.zeros(k * d, order * d)
    for j in range(k - order):
        out.add(j * d, strength * np.kron(np.outer(step, step), np.eye(d)))
    for j in range(k):
        out.add(j * d, strength * ridge * np.eye(d))
    return out if banded else out.dense()


def var1(k: int, d: int, transition: np.ndarray | None = None, noise_cov: np.ndarray | None = None, banded: bool | None = None) -> np.ndarray | Banded:
    """Precision of mu_1 ~ N(0, I), mu_k = transition mu_(k-1) + N(0, noise_cov): the sum over steps of the quadratic forms."""
    a = 0.8 * np.eye(d) if transition is None else np.asarray(transition, float)
    w = np.linalg.inv(0.5 * np.eye(d) if noise_cov is None else np.asarray(noise_cov, float))
    out = Banded.zeros(k * d, d)
    out.add(0, np.eye(d))
    step = np.hstack([-a, np.eye(d)])  # innovation of one step from (mu_(k-1), mu_k)
    block = step.T @ w @ step
    for j in range(k - 1):
        out.add(j * d, block)
    return out if (k * d > DENSE if banded is None else banded) else out.dense()


def solved(q: np.ndarray | Banded, blocks: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """u (K, d) from (q + blockdiag(blocks)) u = rhs, with blocks (K, d, d) and rhs (K, d)."""
    k, d = rhs.shape
    if isinstance(q, Banded):
        system = Banded(q.size, q.diagonal.copy(), q.below)
        for j in range(k):
            system.add(j * d, blocks[j])
        return system.solve(rhs.ravel()).reshape(k, d)
    system = np.array(q, float)
    for j in range(k):
        system[j * d : (j + 1) * d, j * d : (j + 1) * d] += blocks[j]
    return np.linalg.solve(system, rhs.ravel()).reshape(k, d)


def log_det(q: np.ndarray | Banded) -> float:
    return q.log_det() if isinstance(q, Banded) else float(np.linalg.slogdet(q)[1])


def as_frame(spark: SparkSession, q: np.ndarray | Banded) -> DataFrame:
    """Non-zero entries as (i, j, value), from 1."""
    at = q.entries() if isinstance(q, Banded) else [(i, j, q[i, j]) for i, j in np.argwhere(q != 0)]
    return spark.createDataFrame([(int(i) + 1, int(j) + 1, float(v)) for i, j, v in at], "i int, j int, value double")
