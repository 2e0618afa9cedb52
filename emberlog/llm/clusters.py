"""Clusters of similar vectors: parallel pivot correlation clustering, and the groups that its clusters' links form.

In every cell of the coarse index: rows in the order of a hash; in rounds, a row that has no similar row before it among those
left (a local minimum of the hash order) is a pivot and absorbs the similar rows left. Then members go to their closest pivot,
the medoid of each cluster (the member closest to the members' mean direction) becomes its pivot, and members are assigned
once more. Links between different clusters are found without all pairs: only a row u with angle(u, Q) <= limit + radius(Q)
can have a similar row in cluster Q, so only those are held against Q's members. Clusters with links are one group of the
cell; groups that share a row in several cells are joined by alternating minimum propagation over the (few) links.

Defined results
    * similar: cosine distance at most ``distance``; keys without a valid vector are left out; of a key's valid rows that with the lowest seq counts.
    * ``cluster_key`` is the smallest key (by code points) of the group; a key with no similar key is a group of one.
    * repeated rows and keys count once; equal vectors under different keys are similar. Empty input: empty. Extra columns are ignored.

Scale: one shuffle of the vectors by key, one by cell; a cell's task has a bounded number of home rows. Two similar rows meet
if one visits the other's cell (measured: see the README); links are kept as key pairs in DataFrames, never on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.vectors import DIMS, directions, fit_cells, hash_sample, matrix, sound_vectors, visiting
from emberlog.plans.session import cut

CHUNK = 1024


def pivots_of(unit: np.ndarray, cos: float) -> np.ndarray:
    """Indices of the pivots of rows given in hash order: hash-ordered local minima that absorb in rounds, chunk after chunk."""
    found: list[int] = []
    for a in range(0, len(unit), CHUNK):
        x = unit[a : a + CHUNK]
        left = np.ones(len(x), bool)
        if found:
            left = ~((x @ unit[found].T) >= cos).any(axis=1)
        at = np.flatnonzero(left)
        if not len(at):
            continue
        y = x[at]
        alike = (y @ y.T) >= cos
        np.fill_diagonal(alike, True)
        active = np.ones(len(at), bool)
        order = np.arange(len(at))
        while active.any():
            least = np.where(alike & active[None, :], order[None, :], len(at)).min(axis=1)
            pivot = active & (least == order)
            found += [int(i) for i in a + at[pivot]]
            active &= ~alike[:, pivot].any(axis=1)
    return np.array(sorted(found), np.int64)


def closest(unit: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the closest pivot (index into pivots) and its similarity."""
    at, s = np.empty(len(unit), np.int64), np.empty(len(unit), unit.dtype)
    for a in range(0, len(unit), CHUNK):
        m = unit[a : a + CHUNK] @ unit[pivots].T
        at[a : a + CHUNK] = m.argmax(axis=1)
        s[a : a + CHUNK] = m.max(axis=1)
    return at, s


def group_cell(exact: np.ndarray, cos: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (unit vectors in double, in hash order) -> group number of each, and how typical it is of its cluster."""
    unit = exact.astype(np.float32)
    slack = 1e-5  # single precision proposes, double decides
    pivots = pivots_of(unit, cos)
    at, s = closest(unit, pivots)
    for _ in range(1):  # medoids
        mean = np.zeros((len(pivots), unit.shape[1]))
        np.add.at(mean, at, exact)
        typical = (exact * mean[at]).sum(axis=1)
        best = np.lexsort((-typical, at))
        first = best[np.concatenate([[True], np.diff(at[best]) > 0])]
        pivots = np.sort(first)
        at, s = closest(unit, pivots)
    far = s < cos - slack  # a row that the new pivots don't reach is a pivot of its own
    near = np.flatnonzero(np.abs(s - cos) <= slack)
    far[near] = (exact[near] * exact[pivots[at[near]]]).sum(axis=1) < cos - 1e-12
    pivots = np.unique(np.concatenate([pivots, np.flatnonzero(far)]))
    at, s = closest(unit, pivots)
    at[pivots] = np.arange(len(pivots))
    s[pivots] = 1.0
    mean = np.zeros((len(pivots), unit.shape[1]))
    np.add.at(mean, at, exact)
    size = np.bincount(at, minlength=len(pivots))
    typical = (exact * mean[at]).sum(axis=1) / np.sqrt((mean[at] ** 2).sum(axis=1)).clip(1e-30)
    radius = np.zeros(len(pivots))
    np.maximum.at(radius, at, np.arccos(np.clip(s.astype(np.float64), -1, 1)))
    limit = np.cos(np.minimum(np.arccos(cos) + radius + 1e-3, np.pi)) - slack
    group = np.arange(len(pivots))  # of each cluster

    members = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[members], np.arange(len(pivots) + 1))
    reach: dict[int, list[np.ndarray]] = {}
    for a in range(0, len(unit), CHUNK):
        m = unit[a : a + CHUNK] @ unit[pivots].T
        rows, cl = np.nonzero(m >= limit[None, :])
        other = at[a + rows] != cl
        rows, cl = a + rows[other], cl[other]
        order = np.argsort(cl, kind="stable")
        rows, cl = rows[order], cl[order]
        edges = np.flatnonzero(np.diff(cl)) + 1
        for part, q in zip(np.split(rows, edges), cl[np.concatenate([[0], edges])] if len(cl) else []):
            reach.setdefault(int(q), []).append(part)
    for q, parts in reach.items():
        mine, rows = members[bounds[q] : bounds[q + 1]], np.concatenate(parts)
        for a in range(0, len(rows), CHUNK):
            for b in range(0, len(mine), 8 * CHUNK):
                part = rows[a : a + CHUNK]
                part = part[group[at[part]] != group[q]]  # clusters that are linked already need no further look
                if not len(part):
                    break
                some = mine[b : b + 8 * CHUNK]
                s2 = unit[part] @ unit[some].T
                for n in np.flatnonzero(s2.max(axis=1) >= cos - slack):
                    r = part[n]
                    near = some[s2[n] >= cos - slack]
                    if group[at[r]] != group[q] and (exact[near] @ exact[r]).max() >= cos - 1e-12:
                        group[group == group[at[r]]] = group[q]
    return group[at], typical


def join_links(links: DataFrame) -> DataFrame:
    """(node, root): the connected components of undirected links (a, b) of strings, root the smallest node.

    Alternating large-star and small-star steps; each round's links are a checkpoint, and the number of rounds grows with the
    logarithm of the longest chain. Nodes without a link don't appear.
    """
    e = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:  # ends: every round that changes links brings them nearer to their smallest node
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours to the minimum
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small_least.select("a", F.col("m").alias("b")))
        new = cut(small.filter("a <> b").distinct())
        same = new.join(e, ["a", "b"], "left_anti").isEmpty() and e.join(new, ["a", "b"], "left_anti").isEmpty()
        e = new
        if same:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def similarity_clusters(rows: DataFrame, *, distance: float = 0.30, sample: int = 16_000, dims: int = DIMS, **index) -> DataFrame:
    """key, cluster_key, typical (how near the key is to its cluster's mean direction) of every key with a sound vector."""
    total = rows.count()
    model = fit_cells(hash_sample(rows, total, sample, dims), total, **({"spread": 1} | index))
    cos = 1.0 - distance

    def grouped(t: pa.Table) -> pa.Table:
        keys = np.array(t.column("key").to_pylist(), dtype=object)
        order = np.lexsort((keys, t.column("h").to_numpy()))
        exact = directions(matrix(t.column("vector"), dims))[order]
        keys, home = keys[order], (t.column("home").to_numpy(zero_copy_only=False) & (t.column("piece").to_numpy() == 0))[order]
        number, typical = group_cell(exact, cos)
        by_key = np.argsort(keys, kind="stable")
        label = np.empty(len(keys), dtype=object)
        for i in by_key[::-1]:
            label[number[i]] = keys[i]  # the smallest key is written last
        return pa.table({"key": pa.array(keys, pa.string()), "home": pa.array(home), "label": pa.array(label[number], pa.string()), "typical": pa.array(typical)})

    visits = visiting(sound_vectors(rows, dims), model, dims).withColumn("h", F.xxhash64("key"))
    labelled = cut(visits.groupBy("cell", "piece").applyInArrow(grouped, "key string, home boolean, label string, typical double"))
    several = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    cross = labelled.join(several, "key", "left_semi").select(F.col("key").alias("a"), F.col("label").alias("b"))
    roots = join_links(cross)
    home = labelled.filter("home").select("key", "label", "typical")
    own, of_label = roots.select(F.col("node").alias("key"), F.col("root").alias("r1")), roots.select(F.col("node").alias("label"), F.col("root").alias("r2"))
    found = home.join(own, "key", "left").join(of_label, "label", "left")
    return found.select("key", F.least(F.coalesce("r1", "label"), F.coalesce("r2", "label")).alias("cluster_key"), "typical")


def cluster_report(clusters: DataFrame, least: int = 3, members: int = 3) -> DataFrame:
    """cluster_key, size and the ``members`` most typical keys (ties: smaller key) of the clusters of at least ``least`` keys."""
    sizes = clusters.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    ranked = clusters.withColumn("r", F.row_number().over(Window.partitionBy("cluster_key").orderBy(F.desc("typical"), "key"))).filter(F.col("r") <= members)
    typical = ranked.groupBy("cluster_key").agg(F.sort_array(F.collect_list(F.struct("r", "key"))).alias("t"))
    return sizes.join(typical, "cluster_key").select("cluster_key", "size", F.transform("t", lambda x: x["key"]).alias("typical_keys"))
