"""The k most similar vectors of every vector: score-aware four-bit quantisation, table scans, exact reranking.

Vectors are taken as directions, so the greatest inner product is the greatest cosine. The residual of a vector to its cell's
centre, scaled by the cell's usual residual, is coded by product quantisation: ``dims / 2`` blocks of two dimensions, sixteen
codewords each, two codes to a byte. Codes are chosen by coordinate descent on the anisotropic loss, in which the error
parallel to the vector itself counts ``weight`` times the orthogonal one, since it is the parallel error that changes the
inner products with queries near to the vector. In a cell, every query's tables of codeword products are summed along the
members' codes (as a product with the decoded members), the best ``rerank`` (and one more for every ``rerank_step`` members) by that score are measured exactly in double.

Defined results
    * distances are 1 - cosine in double, rounded to nine decimals; ties: the smaller key. A key is not its own neighbour.
    * keys without a valid vector have no neighbours and are none; of a key's valid rows that with the lowest seq counts.
    * equal vectors under different keys are indexed once, and all of them are answered for, exactly.
    * fewer than k other keys: as many as there are. Empty input: empty. Extra columns are ignored.

Scale: one shuffle of the vectors by key and one by cell. A task has a bounded number of rows (hot regions are split, and cells
with many visitors are searched in pieces), copies of a vector are one member. A query visits all parts of its region and a loose row all
loose ones, so the work grows with the square of a region and of the loose rows. With ``within``, loose rows are measured exactly against all
that they meet, by half of the numbers where those exclude a pair, and two of them meet in one task, which answers for both. Codebooks are fitted
on at most ``FITTED`` vectors, cells on ``sample`` (default: growing with the square root of the rows, so that small regions have leaders in large
tables); every row is indexed. The approximation is in the leaders visited and in the reranked set; recall is measured in the tests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.vectors import DIMS, Cells, directions, fit_cells, hash_sample, matrix, sound_hashes, sound_vectors, visiting
from emberlog.plans.session import cut

BLOCK, WORDS = 2, 16
MARGIN = 2e-5  # above the error of a product of two directions in single precision
SCORES = 4_000_000
FITTED = 19_200


class Codebook:
    """Codewords (blocks, 16, 2) for scaled residuals, and each cell's scale."""

    def __init__(self, words: np.ndarray, scales: np.ndarray, weight: float):
        self.words, self.scales, self.weight = words.astype(np.float32), scales.astype(np.float32), weight

    def encode(self, unit: np.ndarray, residual: np.ndarray, passes: int = 1) -> np.ndarray:
        """Codes (rows, blocks) of scaled residuals by coordinate descent on the anisotropic loss."""
        n, blocks = len(unit), len(self.words)
        r, u = (np.ascontiguousarray(x.astype(np.float32).reshape(n, blocks, BLOCK).transpose(1, 2, 0)) for x in (residual, unit))  # block, dimension, row
        errors, alongs = np.empty((blocks, WORDS, n), np.float32), np.empty((blocks, WORDS, n), np.float32)
        codes = np.empty((blocks, n), np.uint8)
        rows, parallel = np.arange(n), np.zeros(n, np.float32)
        for b in range(blocks):
            e0, e1 = r[b, 0][None] - self.words[b, :, :1], r[b, 1][None] - self.words[b, :, 1:]
            alongs[b] = u[b, 0] * e0 + u[b, 1] * e1
            errors[b] = e0 * e0 + e1 * e1
            codes[b] = errors[b].argmin(axis=0)
            parallel += alongs[b][codes[b], rows]
        for _ in range(passes):
            for b in range(blocks):
                rest = parallel - alongs[b][codes[b], rows]
                total = rest + alongs[b]
                total *= total
                total *= np.float32(self.weight - 1)
                total += errors[b]
                codes[b] = total.argmin(axis=0)
                parallel = rest + alongs[b][codes[b], rows]
        return np.ascontiguousarray(codes.T)


def fit_codebook(sample: np.ndarray, model: Cells, *, threshold: float = 0.2, rounds: int = 15) -> Codebook:
    """Codebook of a sample's residuals. ``threshold`` is the inner product from which on a score matters; it sets the loss's weight."""
    dims = sample.shape[1]
    weight = (dims - 1) * threshold**2 / (1 - threshold**2)
    rows, cells, at_home = model.visits(sample)
    home = cells[at_home]
    residual = sample - model.centres[home]
    scales = np.ones(len(model.centres))
    usual = float(np.sqrt((residual**2).mean())) or 1.0 if len(sample) else 1.0
    for c in range(len(scales)):
        own = residual[home == c]
        scales[c] = np.sqrt((own**2).mean()) if len(own) > 1 else usual
    scales = np.maximum(scales, 1e-6)
    held = home < model.leaders
    if held.sum() >= 16 * WORDS:  # the words are fitted where many are near; loose rows stand far apart under any words
        sample, residual, home = sample[held], residual[held], home[held]
    sample, residual, home = sample[:FITTED], residual[:FITTED], home[:FITTED]  # the sample has no order
    scaled = (residual / scales[home][:, None]).reshape(len(sample), dims // BLOCK, BLOCK).astype(np.float32)
    rng = np.random.Generator(np.random.PCG64(11))
    words = np.empty((dims // BLOCK, WORDS, BLOCK), np.float32)
    for b in range(dims // BLOCK):
        x = np.ascontiguousarray(scaled[:, b])
        w = x[rng.integers(0, len(x), WORDS)].copy() if len(x) else rng.normal(size=(WORDS, BLOCK)).astype(np.float32)
        for _ in range(rounds if len(x) else 0):
            at = ((w * w).sum(axis=1)[None, :] - 2 * (x @ w.T)).argmin(axis=1)
            n = np.bincount(at, minlength=WORDS)
            for d in range(BLOCK):
                s = np.bincount(at, weights=x[:, d], minlength=WORDS)
                w[:, d] = np.where(n > 0, s / np.maximum(n, 1), w[:, d])
        words[b] = w
    book = Codebook(words, scales, weight)
    # score-aware step: the words are the means of what the anisotropic loss assigns to them
    for _ in range(2 if len(sample) else 0):
        codes = book.encode(sample, scaled.reshape(len(sample), dims), passes=1)
        for b in range(dims // BLOCK):
            n = np.bincount(codes[:, b], minlength=WORDS)
            for d in range(BLOCK):
                s = np.bincount(codes[:, b], weights=scaled[:, b, d], minlength=WORDS)
                book.words[b][:, d] = np.where(n > 0, s / np.maximum(n, 1), book.words[b][:, d])
    return book


def decode(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What codes (rows, blocks) stand for, (rows, dims): its product with a query is the sum of the query's table entries along the codes."""
    return words[np.arange(len(words)), codes].reshape(len(codes), -1)


def pairs_where(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix, row by row and faster."""
    at = np.flatnonzero(held.ravel())
    q = at // held.shape[1]
    return q, at - q * held.shape[1]


def scan(queries: np.ndarray, decoded: np.ndarray, keep: int, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) pairs, by query: of each query at least the ``keep`` members with the highest table score.

    All scores come from one matrix product with the decoded members, which is several times cheaper than looking entries up and adding them.
    The score from which on members are kept is estimated on every fourth one; a query that gets too few by it is ranked in full.
    """
    nq, n = len(queries), len(decoded)
    score = np.matmul(queries, decoded.T, out=None if room is None else room[: nq * n].reshape(nq, n))
    if keep >= n:
        return np.repeat(np.arange(nq), n), np.tile(np.arange(n), nq)
    some = score[:, :: 4 if n >= 4096 else 1]
    share = keep * some.shape[1] / n
    place = max(0, some.shape[1] - (keep if some.shape[1] == n else int(share + 2 * share**0.5) + 1))
    floor = np.partition(some, place, axis=1)[:, place]
    q, m = pairs_where(score >= floor[:, None])
    few = np.flatnonzero(np.bincount(q, minlength=nq) < keep)
    if len(few):
        floor[few] = np.partition(score[few], n - keep, axis=1)[:, n - keep]
        q, m = pairs_where(score >= floor[:, None])
    return q, m


def closest(q: np.ndarray, m: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k pairs of each q with the smallest (d, m)."""
    order = np.lexsort((m, d, q))
    q, m, d = q[order], m[order], d[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], m[first], d[first]


def exact_distances(x: np.ndarray, members: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    d = np.empty(len(q))
    for i in range(0, len(q), 1024):
        d[i : i + 1024] = np.einsum("ij,ij->i", x[q[i : i + 1024]], members[m[i : i + 1024]])
    return np.round(1.0 - d, 9)


def rerank_exactly(x: np.ndarray, members: np.ndarray, near: np.ndarray, q: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, distance) of the k closest of each query's proposals (q, m), by query. near: the members in single precision.

    Single precision says which can be among the k, by a margin above its error; those are measured in double.
    """
    if len(q) * 20 > len(x) * len(members):  # so many that one product is cheaper
        d = np.full((len(x), len(members)), 9.0)
        d[q, m] = np.round(1.0 - x @ members.T, 9)[q, m]
        kth = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        q, m = np.nonzero((d <= kth[:, None]) & (d < 9.0))
        return closest(q, m, d[q, m], k)
    single = x.astype(np.float32)
    bounds = np.searchsorted(q, np.arange(len(x) + 1))
    held = []
    for i in range(len(x)):
        a, b = bounds[i], bounds[i + 1]
        s = np.take(near, m[a:b], axis=0) @ single[i]
        floor = np.partition(s, b - a - k)[b - a - k] - MARGIN if b - a > k else -np.inf
        held.append(np.flatnonzero(s >= floor) + a)
    at = np.concatenate(held)
    return closest(q[at], m[at], exact_distances(x, members, q[at], m[at]), k)


def search_cell(exact: np.ndarray, n: int, asking: np.ndarray, decoded: np.ndarray, k: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, member, distance) of the k closest members (of equal ones the first) of the rows ``asking``; the first n rows are the members, and none is its own."""
    found = []
    members, near = exact[:n], exact[:n].astype(np.float32)
    chunk = int(np.clip(SCORES // n, 16, 512))
    room = np.empty(chunk * n, np.float32)
    for a in range(0, len(asking), chunk):
        rows = asking[a : a + chunk]
        x = exact[rows]
        q, m = scan(x.astype(np.float32), decoded, keep + 1, room)
        other = rows[q] != m
        q, m, d = rerank_exactly(x, members, near, q[other], m[other], k)
        found.append((rows[q], m, d))
    return tuple(np.concatenate(c) for c in zip(*found))


def search_close(a: np.ndarray, b: np.ndarray | None, within: float, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of a row of a and one of b (None: two of a) up to the distance ``within``, seen from both sides: [(row of a, row of b, distance), (row of b, row of a, distance)],
    of each row the k closest (of equal ones the first).

    Exact, with half the numbers: for an orthogonal basis cut in two, x y <= x1 y1 + |x2| |y2|, which is one product of half the width and one number more.
    Only pairs for which that reaches the least product are measured.
    """
    own, b = b is None, a if b is None else b
    dims = a.shape[1]
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(17)).normal(size=(dims, dims)))[0][:, : dims // 2]

    def bounding(x: np.ndarray) -> np.ndarray:
        one = x @ basis
        rest = np.sqrt(np.maximum(0.0, 1.0 - (one * one).sum(axis=1)))
        return np.concatenate([one, rest[:, None]], axis=1).astype(np.float32)

    ua, ub = (bounding(a), bounding(b)) if not own else (bounding(a),) * 2
    least, open_ = np.float32(1.0 - within - MARGIN), 0
    rooms = np.empty(1024 * 4096, np.float32), np.empty(1024 * 4096, bool)
    sides = [[(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] for _ in range(2)]
    for i in range(0, len(a), 1024):
        for j in range(i - i % 4096 if own else 0, len(b), 4096):
            x, y = a[i : i + 1024], b[j : j + 4096]
            bound, held = (room[: len(x) * len(y)].reshape(len(x), len(y)) for room in rooms)
            q, m = pairs_where(np.greater_equal(np.matmul(ua[i : i + 1024], ub[j : j + 4096].T, out=bound), least, out=held))
            if len(q) * 20 > len(x) * len(y):  # dense: one product is cheaper, and of its rows and columns only the k closest go on
                d = np.round(1.0 - x @ y.T, 9)
                if own:
                    d[np.arange(len(x))[:, None] + i >= np.arange(len(y))[None, :] + j] = 9.0
                q, m = pairs_where((d <= within) & (d <= np.partition(d, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1 :][:, :1]))
                m2, q2 = pairs_where(((d <= within) & (d <= np.partition(d, min(k, len(x)) - 1, axis=0)[min(k, len(x)) - 1])).T)
                got = (q + i, m + j, d[q, m]), (m2 + j, q2 + i, d[q2, m2])
            else:
                if own:
                    q, m = q[q + i < m + j], m[q + i < m + j]
                d = exact_distances(x, y, q, m)
                q, m, d = q[d <= within] + i, m[d <= within] + j, d[d <= within]
                got = (q, m, d), (m, q, d)
            for side, pairs in zip(sides, got):
                side.append(pairs)
            open_ += len(got[0][0]) + len(got[1][0])
            if open_ > 2_000_000:
                sides, open_ = [[closest(*map(np.concatenate, zip(*side)), k)] for side in sides], 0
    return [closest(*map(np.concatenate, zip(*side)), k) for side in sides]


def search_guests(exact_q: np.ndarray, exact_g: np.ndarray, k: int, chunk: int = 192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``search_cell`` among rows given by key that the cell's codes don't fit: all are measured."""
    out_q, out_m, out_d = [], [], []
    k = min(k, len(exact_g))
    for a in range(0, len(exact_q), chunk):
        d = np.round(1.0 - exact_q[a : a + chunk] @ exact_g.T, 9)
        q, m = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k])
        order = np.lexsort((m, d[q, m], q))
        q, m = q[order], m[order]
        first = np.arange(len(q)) - np.searchsorted(q, np.arange(len(d)))[q] < k
        out_q.append(q[first] + a)
        out_m.append(m[first])
        out_d.append(d[q[first], m[first]])
    return np.concatenate(out_q), np.concatenate(out_m), np.concatenate(out_d)


def sample_size(total: int) -> int:
    """Vectors to fit the cells on: regions become more, and the least of them smaller a share, with the square root of the rows."""
    return max(16_000, int(25 * total**0.5))


def nearest(rows: DataFrame, *, k: int = 3, within: float | None = None, sample: int | None = None, rerank: int = 128, rerank_step: int = 64, dims: int = DIMS, **index) -> DataFrame:
    """key, rank (1..k), neighbour, distance of every key with a sound vector; within: only neighbours up to that distance, which costs less for loose rows."""
    total = rows.count()
    vectors = hash_sample(rows, total, sample or sample_size(total), dims)
    model = fit_cells(vectors, total, once=within is not None, **index)
    book = fit_codebook(vectors, model)
    sound = sound_vectors(rows, dims)
    # equal vectors: the smallest key stands for all; up to k + 1 of its keys can be anyone's neighbours
    ids = cut(sound_hashes(rows, dims))
    copies = ids.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("first")).filter("n > 1")
    copied = cut(ids.join(copies, ["h1", "h2"]).select("key", "first"))
    few = copied.withColumn("r", F.row_number().over(Window.partitionBy("first").orderBy("key"))).filter(F.col("r") <= k + 1).select("first", "key")
    single = sound.join(copied.filter("key <> first").select("key"), "key", "left_anti")
    held = rows.sparkSession.sparkContext.broadcast(book)  # 64 x 16 x 2 numbers and a scale per cell

    def search(t: pa.Table) -> pa.Table:
        home, loose = (t.column(c).to_numpy(zero_copy_only=False) for c in ("home", "loose"))
        b, cell, piece = held.value, t.column("cell")[0].as_py(), t.column("piece")[0].as_py()
        keys = np.array(t.column("key").to_pylist(), dtype=object)
        guest = loose & ~home if cell < leaders or within is not None else np.zeros(len(keys), bool)  # the rows at home search these too
        order = np.lexsort((keys, np.where(home, 0, np.where(guest, 1, 2))))  # members first, then guests, each by key
        keys, exact = keys[order], directions(matrix(t.column("vector"), dims))[order]
        n, g = int(home.sum()), int(guest.sum())
        found = []
        # rows at home search members in the first piece only, visitors where they are; guests are searched by the rows at home
        asking = np.arange(0 if piece == 0 else n, len(keys))
        if within is not None:  # what is loose is measured against all, in a rest block the rows at home as well
            asking = np.concatenate([asking[asking < n] if cell < leaders else asking[:0], np.arange(n + g, len(keys))])
            if cell >= leaders and piece == 0:
                found += [(keys[q], keys[m], d) for q, m, d in search_close(exact[:n], None, within, k + 1)]
            if n and g:
                (q, m, d), (q2, m2, d2) = search_close(exact[:n], exact[n : n + g], within, k + 1)
                found += [(keys[q], keys[n + m], d), (keys[n + q2], keys[m2], d2)]
        elif n and g:
            q, m, d = search_guests(exact[:n], exact[n : n + g], k + 1)
            found.append((keys[q], keys[n + m], d))
        if n and len(asking):
            unit = exact[:n].astype(np.float32)
            decoded = np.concatenate([decode(b.encode(part, (part - model_centre(cell)) / b.scales[cell]), b.words) for part in np.split(unit, range(2048, n, 2048))])
            q, m, d = search_cell(exact, n, asking, decoded, k + 1, rerank + n // rerank_step)
            found.append((keys[q], keys[m], d))
        none = (np.zeros(0, object), np.zeros(0, object), np.zeros(0))
        out_k, out_n, out_d = (np.concatenate(c) for c in zip(none, *found))
        if within is not None:
            out_k, out_n, out_d = (c[out_d <= within] for c in (out_k, out_n, out_d))
        return pa.table({"key": pa.array(out_k, pa.string()), "neighbour": pa.array(out_n, pa.string()), "distance": pa.array(out_d)})

    leaders = model.leaders
    centres = rows.sparkSession.sparkContext.broadcast(model.centres)

    def model_centre(cell: int) -> np.ndarray:
        return centres.value[cell]

    found = visiting(single, model, dims).groupBy("cell", "piece").applyInArrow(search, "key string, neighbour string, distance double")
    ranked = Window.partitionBy("key").orderBy("distance", "neighbour")
    best = found.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= k + 1).drop("r")
    # copies of a neighbour are neighbours too, and copies of a key are its neighbours at distance 0
    spread = best.join(few.select(F.col("first").alias("neighbour"), F.col("key").alias("copy")), "neighbour", "left").select("key", F.coalesce("copy", "neighbour").alias("neighbour"), "distance")
    own = few.select(F.col("first").alias("key"), F.col("key").alias("neighbour"), F.lit(0.0).alias("distance"))
    merged = spread.unionByName(own).withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= k + 1).drop("r")
    asked = merged.join(copied.select(F.col("first").alias("key"), F.col("key").alias("asked")), "key", "left").select(F.coalesce("asked", "key").alias("key"), "neighbour", "distance")
    return asked.filter("key <> neighbour").withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("key", "rank", "neighbour", "distance")
