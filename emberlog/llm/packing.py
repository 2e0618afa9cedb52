"""Pages into containers of a fixed number of tokens, with every window of containers at the target mixture of sources.

Pages are counted in tokens and queued by source, in the order of a hash. Deficit round-robin gives every source its share of a
window's tokens as credit, draws pages while the credit lasts, and carries what is left over. As a queue's credit after w windows
is known beforehand, a page's window follows from the tokens queued up to and with it (``window_of``): all deficits are carried
exactly, over windows and over partitions, and no task waits for another. A run of windows is packed by one task, window by window:
the drawn pages, best fit decreasing; containers that stay too empty go back into the next window of the run.

Defined results
    * null and empty texts: left out. Null source: a source of its own. Rows without doc_id are left out.
    * a page longer than a container gives full containers and a rest (``piece`` 0, 1, ...), which is packed like a page; no other page is split.
    * repeated ids are packed as often as they come. Empty input: empty. Extra columns are ignored.
    * targets: token share by source; sources not named get their own share of what is left. None: the corpus' own shares.
      A source that runs dry leaves its share to the others, so nothing is dropped; one without any share comes after all others.
    * more than ``max_sources`` sources raise a ValueError: their totals are held on the driver.

Scale: texts are read and tokenised once, in Arrow batches; only (id, source, tokens) is kept and shuffled. Tokens queued before a page are
running sums in buckets of about ``bucket_rows`` rows and over the buckets' totals. A run has the same number of tokens whatever the sources' sizes.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlog.plans.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the word pattern that the public vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str):
    """The byte-level BPE of a .tiktoken file of ranks."""
    return tokenizer_of(Path(path).read_bytes())


@cache
def tokenizer_of(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens of every page with a text. The tokenizer's file is read here and sent to the workers."""
    held = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer_of(held.value).encode_ordinary
        for b in batches:
            n = [len(encode(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return rows.filter("doc_id is not null and text is not null and text <> ''").mapInArrow(count, "doc_id bigint, source string, n_tokens bigint")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: indices of the items of each bin. Open bins are kept sorted by the room that is left."""
    rooms: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = bisect.bisect_left(rooms, (sizes[i], -1))
        if k == len(rooms):
            room, b = capacity, len(bins)
            bins.append([])
        else:
            room, b = rooms.pop(k)
        bins[b].append(i)
        if room > sizes[i]:
            bisect.insort(rooms, (room - sizes[i], b))
    return bins


def shares_of(tokens: dict, targets: dict | None) -> dict:
    """Share of every source: its target, and for sources without one their part of what the targets leave."""
    if not targets:
        targets = {}
    free = sum(n for s, n in tokens.items() if s not in targets) or 1
    rest = max(0.0, 1.0 - sum(targets.values()))
    return {s: max(targets[s] if s in targets else rest * n / free, 1e-9) for s, n in tokens.items()}


def dry_points(tokens: dict, shares: dict, window_tokens: float) -> tuple[list[float], list[float]]:
    """Rounds against windows, as points of a line: after how many rounds and windows each source runs dry.

    A round gives every source its share of a window; once some are dry, a round fills a part of a window only, and the next one goes on in it.
    """
    ends = sorted((n / (shares[s] * window_tokens), shares[s]) for s, n in tokens.items())
    rounds, filled, alive, last, at = [0.0], [0.0], sum(x for _, x in ends), 0.0, 0.0
    for end, share in ends:
        at += alive * (end - last)
        alive, last = max(0.0, alive - share), end
        rounds.append(end)
        filled.append(at)
    return rounds, filled


def packed_run(items: list[tuple], capacity: int, full: float) -> Iterator[tuple[int, bool, list[tuple]]]:
    """(window, filled?, items) of the containers of one run. items: (window, source, tokens, ...), sorted by window."""
    pool: list[tuple] = []
    for n, it in enumerate(items):
        pool.append(it)
        last = n + 1 == len(items)
        if not last and items[n + 1][0] == it[0]:
            continue
        again: list[tuple] = []
        for b in sorted(([pool[i] for i in b] for b in best_fit([x[2] for x in pool], capacity)), key=lambda got: sum(x[2] for x in got)):
            filled = sum(x[2] for x in b) >= full * capacity
            if filled or last:
                yield it[0], filled, b
            else:
                again += b
        pool = again


def drawn(pieces: DataFrame, *, capacity: int, window: int, targets: dict | None = None, bucket_rows: int = 200_000, max_sources: int = 100_000) -> DataFrame:
    """Every piece (doc_id, piece, source, n_tokens, h) with ``window``: the window of ``window`` containers that deficit round-robin draws it for."""
    totals = pieces.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")).limit(max_sources + 1).collect()  # one row a source, checked
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources: their totals don't fit on the driver")
    tokens = {r["source"]: r["tokens"] for r in totals}
    shares = shares_of(tokens, targets)
    rounds, filled = dry_points(tokens, shares, float(window * capacity))
    per_round = pieces.sparkSession.createDataFrame([(s, shares[s] * window * capacity) for s in tokens], "of string, per_round double")
    buckets = max(1, -(-sum(r["rows"] for r in totals) // bucket_rows))
    placed = pieces.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source", F.col("bucket").alias("of_bucket"), before.alias("before")).join(F.broadcast(per_round), F.col("source").eqNullSafe(F.col("of"))).drop("source")
    own = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "piece", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    queued = placed.withColumn("own", own).join(offsets, (F.col("bucket") == F.col("of_bucket")) & F.col("source").eqNullSafe(F.col("of")))

    @F.pandas_udf("bigint")
    def window_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.ceil(np.interp(x.to_numpy(), rounds, filled) - 1e-9).astype(np.int64) - 1, 0))

    return queued.select("doc_id", "piece", "source", "n_tokens", window_of((F.col("before") + F.col("own")) / F.col("per_round")).alias("window"))


def pack(docs: DataFrame, *, capacity: int = 2048, tokenizer: str = TOKENIZER, targets: dict | None = None, window: int = 256, run: int = 16, full: float = 0.985, bucket_rows: int = 200_000, max_sources: int = 100_000) -> DataFrame:
    """doc_id, piece, source, n_tokens, window, container, place: every page's container, the window it belongs to and where the page starts in it.

    ``window`` containers make a window, ``run`` windows are packed by one task, so that at most the last of a run's containers stay below ``full``.
    """
    counted = token_counts(docs, tokenizer).withColumn("h", F.xxhash64("doc_id"))
    each = F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("int")))
    size = F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece") * capacity).cast("bigint")
    pieces = cut(counted.select("doc_id", "source", "h", each.alias("piece"), "n_tokens").withColumn("n_tokens", size))
    placed = drawn(pieces, capacity=capacity, window=window, targets=targets, bucket_rows=bucket_rows, max_sources=max_sources)

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["window", "doc_id", "piece"], kind="stable")
        sources = rows["source"].where(rows["source"].notna(), None)
        items = list(zip(rows["window"].tolist(), sources, rows["n_tokens"].tolist(), rows["doc_id"].tolist(), rows["piece"].tolist()))
        out = []
        for n, (at, _, got) in enumerate(packed_run(items, capacity, full)):
            place = 0
            for _, source, tokens, doc, piece in got:
                out.append((doc, piece, source, tokens, at, int(key[0]) << 32 | n, place))
                place += tokens
        return pd.DataFrame(out, columns=["doc_id", "piece", "source", "n_tokens", "window", "container", "place"])

    schema = "doc_id bigint, piece int, source string, n_tokens bigint, window bigint, container bigint, place bigint"
    return placed.withColumn("run", F.floor(F.col("window") / run)).groupBy("run").applyInPandas(packed, schema)


def mixture(packed: DataFrame) -> DataFrame:
    """window, source, tokens, share: what every window's containers hold of each source."""
    per = packed.groupBy("window", "source").agg(F.sum("n_tokens").alias("tokens"))
    whole = packed.groupBy("window").agg(F.sum("n_tokens").alias("all_tokens"))
    return per.join(whole, "window").select("window", "source", "tokens", (F.col("tokens") / F.col("all_tokens")).alias("share"))


def mixture_report(packed: DataFrame, targets: dict | None = None, *, capacity: int = 2048) -> DataFrame:
    """One row: windows, worst (greatest sum of differences between a window's shares and the targets, the last window left out), containers, ideal (all tokens over ``capacity``).

    For targets that no source runs dry of before the others; None: the corpus' own shares.
    """
    packed = cut(packed)
    tokens = {r["source"]: r["tokens"] for r in packed.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}  # one row a source
    shares = shares_of(tokens, targets)
    target = packed.sparkSession.createDataFrame([(s, x / sum(shares.values())) for s, x in shares.items()], "of string, target double")
    share = mixture(packed)
    last = share.agg(F.max("window")).scalar()
    both = share.join(F.broadcast(target), F.col("source").eqNullSafe(F.col("of"))).filter(F.col("window") < last)
    # a source that a window has nothing of counts with its whole target: the targets add up to 1
    apart = both.groupBy("window").agg((F.sum(F.abs(F.col("share") - F.col("target"))) + 1 - F.sum("target")).alias("apart"))
    fill = {"containers": F.countDistinct("container"), "ideal": F.ceil(F.sum("n_tokens") / capacity)}
    worst = apart.agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.max("apart"), F.lit(0.0)).alias("worst"))
    return worst.withColumns({name: packed.agg(c).scalar() for name, c in fill.items()})
