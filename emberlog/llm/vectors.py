"""What the operators on vectors share: sound rows, directions, and a coarse index of cells fitted on a bounded sample.

The cells are leaders and rest blocks. Leaders are the middles of the dense regions of the sample: in hash order, a vector that
at least ``least`` others of the sample are near to. A leader that would hold more than ``max_cell`` rows is split by k-means of
its sample, and where the sample is too small for that into cells of one direction. A row that a leader is as near as ``hold`` to is at home with the nearest one. It visits every leader that is as near
as ``near``, so all parts of a split region, however many. The other rows are loose: each is at home in one of the rest blocks
(drawn by hash) and visits them all, so every two loose rows meet. A loose row also visits the ``probes`` nearest leaders and
all as near as ``reach``, and the rows at home there find it too. A cell that expects more than ``2 * max_cell`` visitors is
searched in pieces, to each of which its own rows are sent, so that a task's rows stay bounded. The model has at most ``sample`` vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.plans.session import shuffle_tasks

DIMS = 128


def matrix(column: pa.Array, dims: int = DIMS) -> np.ndarray:
    """An Arrow list column of equally long, null-free lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def list_column(m: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(m)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def valid_rows(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """seq, key, vector of the rows with a key and ``dims`` finite numbers, not all zero."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select("seq", "key", F.col("vector").cast("array<float>").alias("vector")).filter(
        F.col("key").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") == dims) & finite & F.exists("vector", lambda x: x != 0)
    )


def _merit() -> Column:
    """What orders a key's valid rows: seq (null last), then two hashes of the vector."""
    return F.struct(F.col("seq").isNull(), "seq", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))


def sound_vectors(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """(key, vector): of every key its valid row with the lowest seq; of equal seq the vector with the smaller hash, null seq last."""
    return valid_rows(rows, dims).groupBy("key").agg(F.min_by("vector", _merit()).alias("vector"))


def sound_hashes(rows: DataFrame, dims: int = DIMS) -> DataFrame:
    """(key, h1, h2): two hashes of every key's sound vector, found without moving vectors."""
    return valid_rows(rows, dims).groupBy("key").agg(F.min(_merit()).alias("m")).select("key", "m.h1", "m.h2")


def directions(m: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in double."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # very small and very large lengths
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


class Cells:
    """The coarse index: unit centres, the first ``leaders`` of them leaders; the others are rest blocks, without a direction."""

    def __init__(self, leaders: np.ndarray, blocks: int, hold: float, near: float, reach: float, probes: int, once: bool = False):
        self.leaders, self.hold, self.near, self.reach, self.probes, self.once = len(leaders), hold, near, reach, probes, once
        self.centres = np.concatenate([leaders, np.zeros((blocks, leaders.shape[1]))]).astype(np.float32)
        self.pieces = np.ones(len(self.centres), np.int64)
        self.first, self.copies = np.arange(len(leaders)), np.ones(len(leaders), np.int64)

    def repeat(self, copies: np.ndarray) -> None:
        """Every leader as several cells of one direction, between which its rows are drawn by hash; all are visited."""
        self.first, self.copies = np.cumsum(copies) - copies, copies
        self.centres = np.concatenate([np.repeat(self.centres[: self.leaders], copies, axis=0), self.centres[self.leaders :]])
        self.leaders = int(copies.sum())
        self.pieces = np.ones(len(self.centres), np.int64)

    def met(self) -> np.ndarray:
        """Does a row of one rest block visit the other? Of every two blocks one visits the other: the half of them that follow it in a ring."""
        n = len(self.centres) - self.leaders
        at = np.arange(n)
        ahead = (at[None, :] - at[:, None]) % n
        return (2 * ahead < n) | ((2 * ahead == n) & (at[:, None] < at[None, :]))

    def visits(self, unit: np.ndarray, drawn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, at home?) of every cell that a row belongs to or visits; drawn: a number of each row that draws its rest block."""
        drawn = np.arange(len(unit)) if drawn is None else drawn
        parts = [(a, self._visits(unit[a : a + 8192], drawn[a : a + 8192])) for a in range(0, len(unit), 8192)] or [(0, self._visits(unit, drawn))]
        return tuple(np.concatenate(c) for c in zip(*((rows + a, cells, home) for a, (rows, cells, home) in parts)))

    def _visits(self, unit: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = unit @ self.centres[: self.leaders].T
        loose = ~(s >= self.hold).any(axis=1)
        home = np.zeros(len(s), np.int64)
        if self.leaders:
            best = s[:, self.first].argmax(axis=1)
            home = self.first[best] + drawn % self.copies[best]
        home[loose] = self.leaders + drawn[loose] % (len(self.centres) - self.leaders)
        out = np.zeros((len(s), len(self.centres)), bool)
        out[:, : self.leaders] = s >= np.where(loose, self.reach, self.near)[:, None]
        out[loose, self.leaders :] = self.met()[home[loose] - self.leaders] if self.once else True
        k = min(self.probes, self.leaders)
        if k and loose.any():
            top = np.argpartition(-s[loose], k - 1, axis=1)[:, :k]
            out[np.repeat(np.flatnonzero(loose), k), top.ravel()] = True
        out[np.arange(len(s)), home] = True
        rows, cells = np.nonzero(out)
        return rows, cells, home[rows] == cells


def kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means of unit vectors, begun with every n-th."""
    centres = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            m = x[at == c].sum(axis=0)
            n = np.linalg.norm(m)
            if n > 0:
                centres[c] = m / n
    return centres


def fit_cells(
    sample: np.ndarray, rows: int, *, lead: float = 0.6, hold: float = 0.5, near: float = 0.45, reach: float = 0.3, least: int = 4, max_cell: int = 32_000, probes: int = 8, spread: int = 8, once: bool = False
) -> Cells:
    """The cells for ``rows`` rows, of a sample of unit vectors in hash order. Loose rows are spread over up to ``spread`` blocks, more where one would exceed ``max_cell``.

    once: of two rest blocks only one visits the other, for searches that answer for both sides.
    """
    dims = sample.shape[1]
    left, leaders = np.ones(len(sample), bool), []
    scale = rows / max(1, len(sample))
    for i in range(len(sample)):
        if not left[i]:
            continue
        open_ = np.flatnonzero(left)
        near_i = sample[open_] @ sample[i] >= lead
        if near_i.sum() < least:
            left[i] = False
            continue
        c = sample[open_[near_i]].sum(axis=0)
        c /= np.linalg.norm(c) or 1.0
        mine = open_[near_i | (sample[open_] @ c >= lead)]
        left[mine] = False
        parts = int(np.ceil(len(mine) * scale / max_cell))
        if parts <= 1:
            leaders.append(c[None, :])
        else:
            leaders.append(kmeans(sample[mine], min(parts, len(mine))))
    lead_m = np.concatenate(leaders) if leaders else np.zeros((0, dims), np.float32)
    held = sum(int((sample[a : a + 8192] @ lead_m.T >= hold).any(axis=1).sum()) for a in range(0, len(sample), 8192))
    loose = int((len(sample) - held) * scale)
    blocks = max(1, -(-loose // max_cell), min(spread, loose // 1000))
    model = Cells(lead_m, blocks, hold, near, reach, probes, once)
    _, cells, home = model.visits(sample)
    expected = np.bincount(cells[home], minlength=len(model.centres))[: model.leaders] * scale
    model.repeat(np.maximum(1, np.ceil(expected / (2 * max_cell))).astype(np.int64))  # where the sample has too few vectors to split a region by
    _, cells, home = model.visits(sample)
    visitors = np.bincount(cells[~home], minlength=len(model.centres)) * scale
    model.pieces = np.maximum(1, np.ceil(visitors / (2 * max_cell))).astype(np.int64)
    return model


def hash_sample(rows: DataFrame, total: int, most: int, dims: int = DIMS) -> np.ndarray:
    """About ``most`` unit vectors (never more than 1.2 times that) of the valid rows, drawn by the hash of their key: the same in every run."""
    share = F.pmod(F.xxhash64(F.lit(77), F.col("key")), F.lit(1_000_000)) < F.lit(int(min(1_000_000, 1_000_000 * most / max(1, total) + 1)))
    got = valid_rows(rows.filter(share), dims).select("key", "vector").orderBy(F.xxhash64(F.lit(77), F.col("key")), "key", "vector").limit(most * 6 // 5).toArrow()
    if not got.num_rows:
        return np.zeros((0, dims), np.float32)
    single = matrix(got.column("vector"), dims)
    unit = np.concatenate([directions(single[i : i + 8192]).astype(np.float32) for i in range(0, len(single), 8192)])
    keys = np.array(got.column("key").to_pylist(), dtype=object)
    _, first = np.unique(keys, return_index=True)
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(first))
    return unit[first[order]]


def visiting(vectors: DataFrame, model: Cells, dims: int = DIMS) -> DataFrame:
    """(cell, piece, home, loose, key, vector): every row of (key, vector) once for each cell that it visits, and in every piece of its home.

    home: at home in the cell; loose: at home in a rest block.
    """
    held = vectors.sparkSession.sparkContext.broadcast(model)  # at most the sample's size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                part = b.slice(i, 4096)
                drawn = part.column(2).to_numpy()
                rows, cells, home = m.visits(directions(matrix(part.column(1), dims)).astype(np.float32), drawn)
                loose = np.zeros(part.num_rows, bool)
                loose[rows[home]] = cells[home] >= m.leaders
                times = np.where(home, m.pieces[cells], 1)
                piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)  # a row at home is in all of them
                rows, cells, home = (np.repeat(x, times) for x in (rows, cells, home))
                piece = np.where(home, piece, drawn[rows] // len(m.centres) % m.pieces[cells])
                at = pa.array(rows)
                columns = [pa.array(cells.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(home), pa.array(loose[rows]), part.column(0).take(at), part.column(1).take(at)]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "piece", "home", "loose", "key", "vector"])

    drawn = F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(1 << 60))
    placed = vectors.select("key", "vector", drawn.alias("drawn")).mapInArrow(place, "cell int, piece int, home boolean, loose boolean, key string, vector array<float>")
    # a cell's work grows faster than its bytes, so cells are not merged into few tasks by their bytes
    return placed.repartition(min(int(model.pieces.sum()), shuffle_tasks(vectors.sparkSession, 4)), "cell", "piece")
