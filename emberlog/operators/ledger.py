"""History of changing attributes: a bitemporal ledger of (valid time x recorded time).

Every update says: over ``[valid_from, valid_to)`` the attributes were these, and the store learned it at ``recorded_at``.
The ledger keeps each belief with the period in which it was held. A late update splits the intervals it overlaps; the
earlier rows get a ``recorded_to`` and stay, nothing is overwritten.

Defined results
    * ``valid_to`` null: open end. Empty intervals (``valid_to <= valid_from``) and rows without valid_from, recorded_at
      or a key: dropped. Key parts may be null only when ``null_keys`` is set.
    * repeated rows count once; of two updates with the same recorded_at the one with the greater attributes wins (nulls least).
    * a null attribute means "as in the segment before", as that was known at the same recorded time (``carry_nulls``);
      without a segment before it stays null. Gaps don't stop the carrying.
    * an empty input gives an empty ledger; extra columns are ignored, whatever their names.

Scale: the rows are hash partitioned by entity, sorted, and swept as a stream of Arrow batches; only one entity's updates
are held at a time. Repeats, the way in which one entity gets very many rows, are removed before the shuffle by a
map-side combined aggregation, so an entity has at most one row per valid start and distinct load.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from emberlog.functions.times import epoch_micros, to_epoch_seconds

OPEN = 2**62


def _sweep(rows: list[tuple], carry_nulls: bool) -> Iterator[tuple]:
    """Rows (vf, vt, rec, attrs) of one entity -> rectangles (vf, vt, rec_from, rec_to | None, attrs), joined along valid time."""
    starts: dict[int, list[tuple]] = {}
    bounds = set()
    for vf, vt, rec, attrs in rows:
        starts.setdefault(vf, []).append((rec, tuple((a is not None, a) for a in attrs), attrs, vt))
        bounds.add(vf)
        bounds.add(vt)
    order = sorted(bounds)
    active: list[tuple] = []
    steps_at: list[int] = []  # carried values as a step function of recorded time
    steps: list[tuple] = []
    open_rects: dict[tuple, int] = {}
    for at, until in zip(order, order[1:]):
        active = [a for a in active if a[3] > at]
        for a in starts.get(at, ()):
            bisect.insort(active, a, key=lambda x: x[:2])
        rects: list[tuple] = []
        for i, (rec, _, attrs, _) in enumerate(active):
            end = active[i + 1][0] if i + 1 < len(active) else None
            if end is not None and end <= rec:
                continue  # same load: the greater one follows
            if not carry_nulls or None not in attrs:
                rects.append((rec, end, attrs))
                continue
            lo, hi = bisect.bisect_right(steps_at, rec), bisect.bisect_left(steps_at, end) if end is not None else len(steps_at)
            cuts = [rec, *steps_at[lo:hi]]
            for j, cut in enumerate(cuts):
                k = bisect.bisect_right(steps_at, cut) - 1
                known = steps[k] if k >= 0 else (None,) * len(attrs)
                rects.append((cut, cuts[j + 1] if j + 1 < len(cuts) else end, tuple(b if a is None else a for a, b in zip(attrs, known))))
        if rects and carry_nulls:
            k = bisect.bisect_left(steps_at, rects[0][0])
            del steps_at[k:], steps[k:]
            steps_at += [r[0] for r in rects]
            steps += [r[2] for r in rects]
        now = dict.fromkeys(rects, at)
        for r, since in open_rects.items():
            if r in now:
                now[r] = since
            else:
                yield (since, at, *r)
        open_rects = now
    for r, since in open_rects.items():
        yield (since, order[-1], *r)


def _sweep_batches(batches: Iterable[pa.RecordBatch], n_keys: int, carry_nulls: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    key: tuple | None = None
    rows: list[tuple] = []
    out: list[tuple] = []

    def flush() -> None:
        if rows:
            out.extend((*key, vf, vt if vt < OPEN else None, since, until, *attrs) for vf, vt, since, until, attrs in _sweep(rows, carry_nulls))

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found) if found else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns)):
            if r[:n_keys] != key:
                flush()
                key, rows = r[:n_keys], []
            rows.append((*r[n_keys : n_keys + 3], r[n_keys + 3 :]))
        if len(out) > 20_000:
            yield batch_of(out)
            out = []
    flush()
    yield batch_of(out)


def bitemporal_ledger(updates: DataFrame, keys: list[str], attrs: list[str], *, valid_from: str = "valid_from", valid_to: str = "valid_to", recorded_at: str = "recorded_at", carry_nulls: bool = False, null_keys: bool = False) -> DataFrame:
    """The ledger of ``updates`` (times as BIGINT): keys, valid_from, valid_to, recorded_from, recorded_to, attrs.

    ``valid_to`` null: still valid; ``recorded_to`` null: still believed. See the module for the defined results.
    """
    kinds = {f.name: f.dataType for f in updates.schema.fields}
    picked = updates.select(
        *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)],
        F.col(valid_from).cast("bigint").alias("vf"),
        F.coalesce(F.col(valid_to).cast("bigint"), F.lit(OPEN)).alias("vt"),
        F.col(recorded_at).cast("bigint").alias("rec"),
        *[F.col(a).alias(f"a{i}") for i, a in enumerate(attrs)],
    ).filter("vf is not null and rec is not null and vt > vf")
    if not null_keys:
        picked = picked.dropna(subset=[f"k{i}" for i in range(len(keys))])
    ks = [f"k{i}" for i in range(len(keys))]
    swept = picked.distinct().repartition(*ks).sortWithinPartitions(*ks, "vf", "rec")
    names = [*ks, "valid_from", "valid_to", "recorded_from", "recorded_to", *[f"a{i}" for i in range(len(attrs))]]
    schema = T.StructType(
        [T.StructField(f"k{i}", kinds[k]) for i, k in enumerate(keys)]
        + [T.StructField(n, T.LongType()) for n in names[len(keys) : len(keys) + 4]]
        + [T.StructField(f"a{i}", kinds[a]) for i, a in enumerate(attrs)]
    )
    n, arrow = len(keys), to_arrow_schema(schema)
    ledger = swept.mapInArrow(lambda it: _sweep_batches(it, n, carry_nulls, arrow), schema)
    return ledger.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], *names[n : n + 4], *[F.col(f"a{i}").alias(a) for i, a in enumerate(attrs)])


def as_believed(ledger: DataFrame, recorded: int | None = None) -> DataFrame:
    """The rows of the ledger that the store believed at ``recorded`` (now, if None)."""
    if recorded is None:
        return ledger.filter("recorded_to is null")
    return ledger.filter((F.col("recorded_from") <= recorded) & (F.col("recorded_to").isNull() | (F.col("recorded_to") > recorded)))


def coalesce_runs(history: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """Join touching intervals of one entity with equal attributes (nulls equal) into the longest runs."""
    by = Window.partitionBy(*keys).orderBy("valid_from")
    same = (F.lag("valid_to").over(by) == F.col("valid_from")) & F.lag(F.struct(*attrs)).over(by).eqNullSafe(F.struct(*attrs))
    runs = history.withColumn("__run", F.sum(F.when(same, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    latest_end = F.max(F.coalesce("valid_to", F.lit(OPEN)))
    return (
        runs.groupBy(*keys, "__run")
        .agg(*[F.first(a).alias(a) for a in attrs], F.min("valid_from").alias("valid_from"), F.nullif(latest_end, F.lit(OPEN)).alias("valid_to"))
        .drop("__run")
    )


#: The registry's stages.
STAGES = ("Development", "Staging", "Production", "Archived")


def clean_stage(stage: Column) -> Column:
    """One of the four stages, whatever blanks, control characters or case surround it; anything else is null."""
    letters = F.regexp_replace(F.lower(stage), "[^a-z]", "")
    out = F.lit(None).cast("string")
    for s in STAGES:
        out = F.when(letters == s.lower(), F.lit(s)).otherwise(out)
    return out


def snapshot_updates(snapshots: DataFrame) -> DataFrame:
    """Registry dumps as ledger updates: a row of the dump at s holds over [s, next dump), recorded at its loaded_at.

    Times in microseconds. The list of dump times is aggregated first; a version without a row in a dump has no update
    there, so it does not exist in that interval. Rows without name, version or snapshot_at are dropped by the ledger;
    without loaded_at a row counts as loaded at its snapshot.
    """
    rows = snapshots.select(
        "name", "version", epoch_micros("snapshot_at").alias("valid_from"), F.coalesce(epoch_micros("loaded_at"), epoch_micros("snapshot_at")).alias("recorded_at"),
        clean_stage(F.col("stage")).alias("stage"), to_epoch_seconds(F.col("created_at")).alias("created_at"),
    )
    taken = rows.select("valid_from").filter("valid_from is not null").distinct()
    nexts = taken.withColumn("valid_to", F.lead("valid_from").over(Window.orderBy("valid_from")))  # one row per dump
    return rows.join(nexts, "valid_from")


def version_ledger(snapshots: DataFrame) -> DataFrame:
    """The bitemporal ledger of (name, version) -> (stage, created_at); a null field is as in its previous snapshot."""
    return bitemporal_ledger(snapshot_updates(snapshots), ["name", "version"], ["stage", "created_at"], carry_nulls=True)


def version_history(snapshots: DataFrame, recorded: int | None = None) -> DataFrame:
    """Every state of every version with its period, as believed now or at ``recorded`` (microseconds)."""
    return coalesce_runs(as_believed(version_ledger(snapshots), recorded), ["name", "version"], ["stage", "created_at"])
