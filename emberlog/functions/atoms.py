"""Atoms: values with one of six tags, kept in one struct of typed columns of which at most one is set.

tag is 'null', 'float', 'int', 'text', 'bytes' or 'vector'. A stored null is a value: it exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.errors import TypeMismatch

#: tag -> payload column
PAYLOAD = {"float": "f", "int": "i", "text": "s", "bytes": "b", "vector": "v"}
TYPES = {"f": "double", "i": "bigint", "s": "string", "b": "binary", "v": "array<float>"}
TAGS = ("null", *PAYLOAD)


def atom(**payload: Column) -> list[Column]:
    """The columns tag, f, i, s, b, v of an atom with the given payload (one of the payload columns), null if its value is null."""
    if len(payload) > 1 or not payload.keys() <= TYPES.keys():
        raise ValueError("an atom has at most one payload")
    (name, value), *_ = payload.items() or [(None, None)]
    tag = next((t for t, c in PAYLOAD.items() if c == name), "null")
    kind = F.lit("null") if name is None else F.when(value.isNull(), F.lit("null")).otherwise(F.lit(tag))
    return [kind.alias("tag"), *[(value if c == name else F.lit(None)).cast(t).alias(c) for c, t in TYPES.items()]]


def typed(df: DataFrame, tag: str) -> DataFrame:
    """The rows of one tag with their payload as ``value``; other tags are left out."""
    if tag not in PAYLOAD:
        raise ValueError(f"no such tag: {tag}")
    return df.filter(F.col("tag") == tag).withColumn("value", F.col(PAYLOAD[tag]))


def strict(df: DataFrame, tag: str) -> DataFrame:
    """As ``typed``, but a row of another tag (a stored null too) fails the job with the type mismatch code."""
    code = TypeMismatch().code
    wrong = F.raise_error(F.concat(F.lit(f"[{code}] type mismatch: asked for {tag}, found "), F.col("tag"))).cast("string")
    return df.withColumn("tag", F.when(F.col("tag") == tag, F.col("tag")).otherwise(wrong)).withColumn("value", F.col(PAYLOAD[tag]))


def as_double(to: str = "double") -> Column:
    """The number a tensor of dtype ``to`` takes from an atom: float64, float32, int32 or int64; null where it has none.

    float to integer truncates and saturates, int64 to int32 keeps the low 32 bits, a vector gives its first element;
    null, text and bytes give nothing.
    """
    first = F.get("v", F.lit(0)).cast("double")
    if to in ("float64", "double"):
        return F.when(F.col("tag") == "float", F.col("f")).when(F.col("tag") == "int", F.col("i").cast("double")).when(F.col("tag") == "vector", first)
    if to == "float32":
        return F.when(F.col("tag") == "float", F.col("f").cast("float")).when(F.col("tag") == "int", F.col("i").cast("float")).when(F.col("tag") == "vector", first.cast("float"))
    if to not in ("int32", "int64"):
        raise ValueError(f"no such dtype: {to}")
    kind, low, high = ("int", -(2**31), 2**31 - 1) if to == "int32" else ("bigint", -(2**63), 2**63 - 1)

    def cut(x: Column) -> Column:
        return F.when(F.isnan(x), F.lit(0)).when(x >= float(high), F.lit(high)).when(x <= float(low), F.lit(low)).otherwise(x.cast("bigint")).cast(kind)

    low_bits = F.when(F.col("i").bitwiseAND(F.lit(0x80000000)) != 0, F.col("i").bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(2**32)).otherwise(F.col("i").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int")
    whole = low_bits if to == "int32" else F.col("i")
    return F.when(F.col("tag") == "float", cut(F.col("f"))).when(F.col("tag") == "int", whole).when(F.col("tag") == "vector", cut(first))


def printable() -> Column:
    """The atom's value as text: bytes in lower-case hex, vectors as JSON arrays."""
    return (
        F.when(F.col("tag") == "float", F.col("f").cast("string"))
        .when(F.col("tag") == "int", F.col("i").cast("string"))
        .when(F.col("tag") == "text", F.col("s"))
        .when(F.col("tag") == "bytes", F.lower(F.hex("b")))
        .when(F.col("tag") == "vector", F.to_json("v"))
    )
