"""Reader of the binary append-only log format: 15-byte headers, keys and tagged values, with recovery from damaged bytes.

Entry: timestamp u64 (microseconds), key length u16, value length u32, flags u8, key (UTF-8), value; all little endian.
Value: u32 tag (0 null, 1 f64, 2 i64, 3 text, 4 bytes, 5 f32 vector with u16 dimensions), lengths as u64; LZ4 block with the
plain size in front if flag 2 is set. Flag 1: the float is a difference to the key's value before. Flag 4: tombstone.

A header must be plausible (time zero or in 2000-2100, key not empty, entry inside the file, known flags); where it is not,
reading goes on at the next byte. Each file is one task, read as one row of Spark's binaryFile source.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = struct.Struct("<QHIB")
# Flag bits, value tags, and the microseconds of the years 2000 and 2100.
DELTA, COMPRESSED, TOMBSTONE = 1, 2, 4
NAMES = ("null", "float", "int", "text", "bytes", "vector")
YEAR_2000, YEAR_2100 = 946_684_800_000_000, 4_102_444_800_000_000
SCHEMA = "path string, seq bigint, ts_micros bigint, key string, op string, tag string, is_delta boolean, f double, i bigint, s string, b binary, v array<float>"


def lz4_block(data: bytes) -> bytes:
    """Decodes one LZ4 block that begins with its plain size (u32)."""
    size, p, out = int.from_bytes(data[:4], "little"), 4, bytearray()

    def longer(n: int) -> int:
        nonlocal p
        while n >= 15:
            b = data[p]
            p += 1
            n += b
            if b != 255:
                break
        return n

    while p < len(data):
        token = data[p]
        p += 1
        n = longer(token >> 4)
        out += data[p : p + n]
        p += n
        if p >= len(data):
            break
        back = int.from_bytes(data[p : p + 2], "little")
        p += 2
        n = longer(token & 15) + 4
        if not 0 < back <= len(out):
            raise ValueError("bad offset")
        for _ in range(n):
            out.append(out[-back])
    if len(out) != size:
        raise ValueError("bad size")
    return bytes(out)


def decode_value(data: bytes) -> tuple:
    """(tag, payload)"""
    tag = NAMES[int.from_bytes(data[:4], "little")]
    rest = data[4:]
    if tag == "null":
        return tag, None
    if tag == "float":
        return tag, struct.unpack("<d", rest[:8])[0]
    if tag == "int":
        return tag, struct.unpack("<q", rest[:8])[0]
    n = int.from_bytes(rest[:8], "little")
    body = rest[8:]
    if tag == "vector":
        if len(body) < 4 * n + 2:
            raise ValueError("short vector")
        return tag, list(struct.unpack(f"<{n}f", body[: 4 * n]))
    if len(body) < n:
        raise ValueError("short value")
    return tag, body[:n].decode() if tag == "text" else bytes(body[:n])


def encode_value(tag: str, payload=None) -> bytes:
    head = struct.pack("<I", NAMES.index(tag))
    if tag == "null":
        return head
    if tag in ("float", "int"):
        return head + struct.pack("<d" if tag == "float" else "<q", payload)
    if tag == "vector":
        return head + struct.pack(f"<Q{len(payload)}fH", len(payload), *payload, len(payload))
    body = payload.encode() if tag == "text" else payload
    return head + struct.pack("<Q", len(body)) + body


def encode_entry(key: str, tag: str, payload=None, ts: int = 0, flags: int = 0) -> bytes:
    k, v = key.encode(), encode_value(tag, payload)
    return HEADER.pack(ts, len(k), len(v), flags) + k + v


def plausible(ts: int, key_len: int, val_len: int, flags: int, left: int) -> bool:
    return (ts == 0 or YEAR_2000 <= ts < YEAR_2100) and key_len >= 1 and key_len + val_len <= left and flags <= 7


def scan(data: bytes) -> tuple[list[tuple], int]:
    """Entries (offset, ts, key, flags, tag, payload) of a file, and the number of damaged places that were passed over."""
    entries, skipped, at, bad = [], 0, 0, False
    while at + HEADER.size <= len(data):
        ts, kl, vl, flags = HEADER.unpack_from(data, at)
        body = at + HEADER.size
        entry = None
        if plausible(ts, kl, vl, flags, len(data) - body):
            try:
                key = data[body : body + kl].decode()
                raw = data[body + kl : body + kl + vl]
                tag, payload = decode_value(lz4_block(raw) if flags & COMPRESSED else raw)
                entry = (at, ts, key, flags, tag, payload)
            except (ValueError, IndexError, struct.error):
                entry = None
        if entry is None:
            skipped += not bad
            bad = True
            at += 1
            continue
        bad = False
        entries.append(entry)
        at = body + kl + vl
    return entries, skipped + (at < len(data) and not bad)


def read_raw_logs(spark: SparkSession, path: str) -> DataFrame:
    """The entries of the files as log rows; ``seq`` is the byte offset, differences are still encoded (is_delta)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, data in zip(f["path"], f["content"]):
                rows = []
                for at, ts, key, flags, tag, x in scan(data)[0]:
                    payload = [x if tag == t else None for t in NAMES[1:]]
                    rows.append((p, at, ts, key, "D" if flags & TOMBSTONE else "P", tag, bool(flags & DELTA), *payload))
                yield pd.DataFrame(rows, columns=names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, SCHEMA)


def recovery(spark: SparkSession, path: str) -> DataFrame:
    """path, recovered, skipped: entries read and damaged places passed over in each file."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = [scan(x) for x in f["content"]]
            yield pd.DataFrame({"path": f["path"], "recovered": [len(e) for e, _ in got], "skipped": [s for _, s in got]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(count, "path string, recovered bigint, skipped bigint")


def undo_differences(rows: DataFrame) -> DataFrame:
    """Float rows with their absolute values: differences are summed from the last absolute value of the key."""
    from emberlog.operators.log import delta_decode

    floats = rows.filter("op <> 'D' and tag = 'float'")
    decoded = delta_decode(floats, "key", "seq", "f", "is_delta", "decoded", block=None).withColumn("f", F.col("decoded")).drop("decoded")
    return decoded.unionByName(rows.filter("not (op <> 'D' and tag = 'float')")).withColumn("is_delta", F.lit(False))
